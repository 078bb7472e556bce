"""Coefficient blocks in long form (id, gx, gy, k, v): transforms without decoding.

Block-level operators are projections (k is moved, signs change); grid-level
ones are projections of (gx, gy). Nothing here shuffles but the joins on k,
whose other side has 64 rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..workers import map_array

OPS = ("none", "flip_h", "flip_v", "transpose", "transverse", "rot90", "rot180", "rot270")
SWAPS = ("transpose", "transverse", "rot90", "rot270")


def row_col(k: Column) -> tuple[Column, Column]:
    return F.floor(k / 8), F.pmod(k, F.lit(8))


def spatial(op: str, k: Column, v: Column) -> tuple[Column, Column]:
    """Where coefficient k goes (natural order) and its value."""
    r, c = row_col(k)
    to = c * 8 + r if op in SWAPS else k
    odd = {
        "none": F.lit(0), "transpose": F.lit(0), "flip_h": c, "flip_v": r, "rot180": r + c, "transverse": r + c,
        "rot90": r, "rot270": c,
    }[op]
    return to, F.when(F.pmod(odd, F.lit(2)) == 1, -v).otherwise(v)


def place(op: str, bx: Column, by: Column, full_w: int, full_h: int) -> tuple[Column, Column, Column]:
    """Target (gx, gy) of a block, and the operator its coefficients take.

    Only the first ``full_w`` x ``full_h`` blocks lie in whole MCUs and mirror;
    edge zones keep their place on the axis that can't."""
    in_w, in_h = bx < full_w, by < full_h
    mx = F.when(in_w, full_w - 1 - bx).otherwise(bx)
    my = F.when(in_h, full_h - 1 - by).otherwise(by)
    plain = F.lit(op)
    if op == "flip_h":
        return mx, by, F.when(in_w, plain).otherwise("none")
    if op == "flip_v":
        return bx, my, F.when(in_h, plain).otherwise("none")
    if op == "rot180":
        return mx, my, F.when(in_w & in_h, plain).when(in_h, "flip_v").when(in_w, "flip_h").otherwise("none")
    if op == "transpose":
        return by, bx, plain
    if op == "rot90":
        return my, bx, F.when(in_h, plain).otherwise("transpose")
    if op == "rot270":
        return by, mx, F.when(in_w, plain).otherwise("transpose")
    if op == "transverse":
        return my, mx, F.when(in_w & in_h, plain).when(in_w, "rot270").when(in_h, "rot90").otherwise("transpose")
    return bx, by, plain


def transform(blocks: DataFrame, op: str, full_w: int, full_h: int) -> DataFrame:
    """A whole lossless transform of a block table."""
    tx, ty, which = place(op, F.col("gx"), F.col("gy"), full_w, full_h)
    k, v = F.col("k"), F.col("v")
    nk, nv = k, v
    for name in OPS[1:]:
        a, b = spatial(name, k, v)
        nk, nv = F.when(F.col("_op") == name, a).otherwise(nk), F.when(F.col("_op") == name, b).otherwise(nv)
    return blocks.withColumns({"_x": tx, "_y": ty, "_op": which}).select("id", F.col("_x").alias("gx"), F.col("_y").alias("gy"), nk.alias("k"), nv.alias("v"))


def perfect(op: str, width: Column, height: Column, mcu_w: int, mcu_h: int) -> Column:
    """Whether the transform has no edge zone."""
    need_w, need_h = op in ("flip_h", "transverse", "rot90", "rot180", "rot270"), op in ("flip_v", "transverse", "rot90", "rot180", "rot270")
    return (F.lit(not need_w) | (width % mcu_w == 0)) & (F.lit(not need_h) | (height % mcu_h == 0))


def trim(blocks: DataFrame, op: str, width: int, height: int, mcu_w: int, mcu_h: int) -> DataFrame:
    """Blocks left when partial MCUs that can't mirror are cut off; rot90 cuts rows only, rot270 columns only."""
    cut_w = op in ("flip_h", "transverse", "rot180", "rot270") and width % mcu_w
    cut_h = op in ("flip_v", "transverse", "rot180", "rot90") and height % mcu_h
    w, h = (width // mcu_w * mcu_w if cut_w else width), (height // mcu_h * mcu_h if cut_h else height)
    if not w or not h:
        raise ValueError("trim would remove all image data")
    return blocks.filter((F.col("gx") < -(-w // 8)) & (F.col("gy") < -(-h // 8)))


def crop(blocks: DataFrame, x: int, y: int, w: int, h: int, width: int, height: int, mcu_w: int = 8, mcu_h: int = 8) -> DataFrame:
    """A region whose origin is rounded down to an MCU and whose size grows by the remainder."""
    x0, y0 = x // mcu_w, y // mcu_h
    out_w, out_h = min(w + x % mcu_w, width - x0 * mcu_w), min(h + y % mcu_h, height - y0 * mcu_h)
    bx0, by0, nx, ny = x0 * mcu_w // 8, y0 * mcu_h // 8, -(-out_w // mcu_w) * mcu_w // 8, -(-out_h // mcu_h) * mcu_h // 8
    inside = F.col("gx").between(bx0, bx0 + nx - 1) & F.col("gy").between(by0, by0 + ny - 1)
    return blocks.filter(inside).withColumns({"gx": F.col("gx") - bx0, "gy": F.col("gy") - by0})


def grayscale(blocks: DataFrame) -> DataFrame:
    """Component 0 of a table that has a component column."""
    return blocks.filter("component = 0")


def lookup(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("bigint") for v in values]), (at + 1).cast("int"))


def to_zigzag(k: Column) -> Column:
    return lookup(fixed.natural(), k)


def to_natural(position: Column) -> Column:
    return lookup(fixed.zigzag(), position)


def dc_only_sample(dc: Column, q: Column) -> Column:
    """The one sample of a 1x1 reconstruction."""
    v = F.shiftright(dc.cast("bigint") * q + 4, 3) + 128
    return F.least(F.lit(255).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), v))


def filter_blocks(blocks: DataFrame, function, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Blocks (keys, k, v) with ``function`` applied to their coefficients: it
    maps an (n, 64) matrix in zigzag order to another. A coefficient that is
    missing is 0; blocks are gathered by key, 64 rows each."""
    order = np.array(fixed.zigzag())

    def apply(x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[:, order] = function(x[:, order])
        return out

    gathered = blocks.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("k").cast("int"), "v"))).alias("m"))
    whole = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0)).cast("bigint"))
    done = map_array(gathered.select(*keys, whole.alias("block")), "block", 64, apply)
    return done.select(*keys, F.posexplode("block").alias("k", "v")).withColumn("k", F.col("k").cast("bigint"))


def critical_parameters(headers: DataFrame) -> DataFrame:
    """What a file made from another's coefficients takes over: size, precision, components, restart interval."""
    f = F.col("frame")
    return headers.filter("frame IS NOT NULL").select("key", f["width"].alias("width"), f["height"].alias("height"), f["precision"].alias("precision"), f["components"].alias("components"), "restart")
