"""A lossless transform as one plan: check, trim, gray, move blocks, crop; of one
image with options on the driver, or of many with options as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks as B


@dataclass(frozen=True)
class TransformOptions:
    op: str = "none"
    perfect: bool = False
    trim: bool = False
    grayscale: bool = False
    crop: tuple[int, int, int, int] | None = None  # x, y, width, height after the transform
    mcu: tuple[int, int] = (8, 8)

    def __post_init__(self):
        if self.op not in B.OPS:
            raise ValueError(f"unknown transform {self.op}")
        if any(m % 8 or not 8 <= m <= 32 for m in self.mcu):
            raise ValueError("MCU sides are 8 to 32 in steps of 8")


def transform(blocks: DataFrame, width: int, height: int, options: TransformOptions) -> tuple[DataFrame, int, int]:
    """(blocks, width, height) after ``options``; the DataFrame stays lazy."""
    (mw, mh), op = options.mcu, options.op
    mirrors_w, mirrors_h = op in ("flip_h", "transverse", "rot90", "rot180", "rot270"), op in ("flip_v", "transverse", "rot90", "rot180", "rot270")
    if options.perfect and (mirrors_w and width % mw or mirrors_h and height % mh):
        raise ValueError("the transform isn't perfect for this size")
    if options.trim:
        blocks = B.trim(blocks, op, width, height, mw, mh)
        if mirrors_w and op != "rot90":
            width = width // mw * mw
        if mirrors_h and op != "rot270":
            height = height // mh * mh
    if options.grayscale:
        blocks = B.grayscale(blocks)
    if op != "none":
        blocks = B.transform(blocks, op, width // mw * mw // 8, height // mh * mh // 8)
    if op in B.SWAPS:
        width, height, mw, mh = height, width, mh, mw
    if options.crop:
        x, y, w, h = options.crop
        blocks = B.crop(blocks, x, y, w, h, width, height, mw, mh)
        x0, y0 = x // mw * mw, y // mh * mh
        width, height = min(w + x - x0, width - x0), min(h + y - y0, height - y0)
    return blocks, width, height


def transform_images(blocks: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lossless transforms of many images in one job, each with options of its own.

    ``images`` has a row per image: image, width, height, op, perfect, trim,
    grayscale, mcu_w, mcu_h and crop (struct x, y, width, height after the
    transform, or null). ``blocks``: image, gx, gy, k, v and others, with a column
    ``component`` if any image is made gray. Returns (blocks, images with the new
    width and height and ``problem``): an image whose options can't be met has a
    problem, keeps its size and has no blocks. Options meet blocks by one join on
    the image; blocks of images that aren't listed are left out."""
    c, op, no = F.col, F.col("op"), F.lit(False)
    asked = lambda name: F.coalesce(F.col(name), no)
    mirrors_w, mirrors_h = op.isin("flip_h", "transverse", "rot90", "rot180", "rot270"), op.isin("flip_v", "transverse", "rot90", "rot180", "rot270")
    over_w, over_h = c("width") % c("mcu_w") > 0, c("height") % c("mcu_h") > 0
    cut_w, cut_h = asked("trim") & mirrors_w & (op != "rot90") & over_w, asked("trim") & mirrors_h & (op != "rot270") & over_h
    whole = lambda size, mcu: F.floor(c(size) / c(mcu)) * c(mcu)
    sides = [8, 16, 24, 32]
    listed = images.withColumns({"_w": F.when(cut_w, whole("width", "mcu_w")).otherwise(c("width")), "_h": F.when(cut_h, whole("height", "mcu_h")).otherwise(c("height"))})
    listed = listed.withColumn("problem", (
        F.when(~F.coalesce(op.isin(*B.OPS), no), F.concat(F.lit("unknown transform "), F.coalesce(op, F.lit("null"))))
        .when(~F.coalesce(c("mcu_w").isin(sides) & c("mcu_h").isin(sides), no), "MCU sides are 8 to 32 in steps of 8")
        .when(asked("perfect") & (mirrors_w & over_w | mirrors_h & over_h), "the transform isn't perfect for this size")
        .when((c("_w") == 0) | (c("_h") == 0), "trim would remove all image data")
    ))
    swaps = op.isin(*B.SWAPS)
    listed = listed.withColumns({
        "_tw": F.when(swaps, c("_h")).otherwise(c("_w")), "_th": F.when(swaps, c("_w")).otherwise(c("_h")),
        "_mw": F.when(swaps, c("mcu_h")).otherwise(c("mcu_w")), "_mh": F.when(swaps, c("mcu_w")).otherwise(c("mcu_h")),
    })
    # a region's origin is rounded down to an MCU and its size grows by the remainder
    x0, y0 = c("crop.x") - F.pmod(c("crop.x"), c("_mw")), c("crop.y") - F.pmod(c("crop.y"), c("_mh"))
    out_w, out_h = F.least(c("crop.width") + c("crop.x") - x0, c("_tw") - x0), F.least(c("crop.height") + c("crop.y") - y0, c("_th") - y0)
    units = lambda size, mcu: F.ceil(size / c(mcu)) * c(mcu) / 8
    listed = listed.withColumn("_crop", F.when(c("crop").isNotNull(), F.struct((x0 / 8).cast("long").alias("x"), (y0 / 8).cast("long").alias("y"), units(out_w, "_mw").cast("long").alias("nx"), units(out_h, "_mh").cast("long").alias("ny"), out_w.alias("w"), out_h.alias("h"))))

    held = [n for n in blocks.columns if n not in ("gx", "gy", "k", "v")]
    own = listed.filter("problem IS NULL").select("image", "op", "grayscale", "_crop", *[F.ceil(c(s) / 8).alias(f"{s}b") for s in ("_w", "_h")], (F.floor(c("_w") / c("mcu_w")) * c("mcu_w") / 8).cast("long").alias("_fw"), (F.floor(c("_h") / c("mcu_h")) * c("mcu_h") / 8).cast("long").alias("_fh"))
    rows = blocks.join(own, "image").filter((c("gx") < c("_wb")) & (c("gy") < c("_hb")))
    if "component" in blocks.columns:
        rows = rows.filter(~asked("grayscale") | (c("component") == 0))
    tx, ty, which = c("gx"), c("gy"), F.lit("none")
    for name in B.OPS[1:]:
        x, y, done = B.place(name, c("gx"), c("gy"), c("_fw"), c("_fh"))
        tx, ty, which = F.when(op == name, x).otherwise(tx), F.when(op == name, y).otherwise(ty), F.when(op == name, done).otherwise(which)
    rows = rows.withColumns({"_x": tx, "_y": ty, "_op": which})
    nk, nv = c("k"), c("v")
    for name in B.OPS[1:]:
        a, b = B.spatial(name, c("k"), c("v"))
        nk, nv = F.when(c("_op") == name, a).otherwise(nk), F.when(c("_op") == name, b).otherwise(nv)
    inside = c("_crop").isNull() | (c("_x").between(c("_crop.x"), c("_crop.x") + c("_crop.nx") - 1) & c("_y").between(c("_crop.y"), c("_crop.y") + c("_crop.ny") - 1))
    at = lambda v, s: (c(v) - F.coalesce(c(f"_crop.{s}"), F.lit(0))).alias("g" + s)
    moved = rows.filter(inside).select(*held, at("_x", "x"), at("_y", "y"), nk.alias("k"), nv.alias("v"))
    size = lambda s, t, old: F.when(c("problem").isNotNull(), c(old)).otherwise(F.coalesce(c(f"_crop.{s}"), c(t))).cast("long").alias(old)
    told = listed.select(*[n for n in images.columns if n not in ("width", "height")], size("w", "_tw", "width"), size("h", "_th", "height"), "problem")
    return moved, told
