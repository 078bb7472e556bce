"""Smoothing across blocks of an image that isn't wholly refined yet.

Until all scans of a progressive image are in, low coefficients of a block that
are zero and not exactly known are predicted from the DC values of the 5x5
blocks around it. ``coefficient_bits`` tells from the scans seen how exactly
each of the ten lowest coefficients is known.

* While some AC bits are known, predictions read DC values only and don't change
  them: two windows, along rows and along columns, bring the 25 values together.
* While no AC bit is known, the DC itself is smoothed, in reading order: blocks
  see the new values of earlier ones and the old values of later ones. The
  blocks with equal gx + 3 gy don't read each other, so an image takes W + 3 H
  steps over vectors, one image and component a group.

A block grid is expected without gaps; windows take the nearest block present.
Blocks are rows (image, component, gx, gy, block of 64 in natural order).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workers import ready

KEYS = ("image", "component")
#: Coefficients by zigzag position 0..9, as places in natural order.
PLACES = (0, 1, 8, 16, 9, 2, 3, 10, 17, 24)
# fixed values: weights of the 5x5 DC values, row by row, by zigzag position; 2, 3 and 5, 8 and 9 by symmetry
KNOWN = {
    1: [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, -7, 50, 0, -50, 7, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0],
    4: [0, -1, 0, 1, 0, -1, 10, 0, -10, 1, 0, 0, 0, 0, 0, 1, -10, 0, 10, -1, 0, 1, 0, -1, 0],
    5: [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, -1, 13, -24, 13, -1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0],
}
UNKNOWN = {
    0: [-2, -6, -8, -6, -2, -6, 6, 42, 6, -6, -8, 42, 152, 42, -8, -6, 6, 42, 6, -6, -2, -6, -8, -6, -2],
    1: [-1, -1, 0, 1, 1, -3, 13, 0, -13, 3, -3, 38, 0, -38, 3, -3, 13, 0, -13, 3, -1, -1, 0, 1, 1],
    4: [-1, 0, 0, 0, 1, 0, 9, 0, -9, 0, 0, 0, 0, 0, 0, 0, -9, 0, 9, 0, 1, 0, 0, 0, -1],
    5: [0, 0, 0, 0, 0, 0, 2, -5, 2, 0, 1, 7, -14, 7, 1, 0, 2, -5, 2, 0, 0, 0, 0, 0, 0],
    6: [0, 0, 0, 0, 0, 0, 1, 0, -1, 0, 0, 2, 0, -2, 0, 0, 1, 0, -1, 0, 0, 0, 0, 0, 0],
    7: [0, 0, 0, 0, 0, 0, 1, -3, 1, 0, 0, 0, 0, 0, 0, 0, -1, 3, -1, 0, 0, 0, 0, 0, 0],
}


def turned(weights: dict[int, list[int]]) -> dict[int, list[int]]:
    """``weights`` with those of the transposed coefficients."""
    across = {1: 2, 5: 3, 6: 9, 7: 8}
    return weights | {across[k]: np.reshape(w, (5, 5)).T.reshape(-1).tolist() for k, w in weights.items() if k in across}


KNOWN, UNKNOWN = turned(KNOWN), turned(UNKNOWN)


def coefficient_bits(scans: DataFrame) -> DataFrame:
    """image, component, bits: of each of the ten lowest coefficients the low bit of
    the last scan that held it, 0 if exact, -1 if none did.

    ``scans``: image, scan (their order), component, ss, se (zigzag range), al."""
    last = [F.coalesce(F.max_by("al", F.when(F.lit(k).between(F.col("ss"), F.col("se")), F.col("scan"))).cast("int"), F.lit(-1)) for k in range(len(PLACES))]
    return scans.groupBy(*KEYS).agg(F.array(*last).alias("bits"))


def useful(bits: Column, quant: Column) -> Column:
    """Whether smoothing applies: DC known, an AC value inexact, none of the ten divisors 0."""
    return (bits[0] >= 0) & F.exists(F.slice(bits, 2, 9), lambda b: b != 0) & ~F.exists(F.array(*[quant[k] for k in PLACES]), lambda q: q == 0)


def dc_changes(bits: Column) -> Column:
    """Whether no AC bit is known, so that DC values are smoothed too."""
    return F.forall(F.slice(bits, 2, 9), lambda b: b == -1)


def predicted(total: Column, q0: Column, q: Column, al: Column) -> Column:
    """The prediction from a weighted sum of DC values, within the bits still to come."""
    size = F.call_function("div", F.shiftleft(q.cast("bigint"), 7) + F.abs(total * q0), F.shiftleft(q.cast("bigint"), 8))
    most = F.call_function("shiftleft", F.lit(1).cast("bigint"), al.cast("int")) - 1
    size = F.when((al > 0) & (size > most), most).otherwise(size)
    return F.when(total < 0, -size).otherwise(size)


def around(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``near``: the 25 DC values around, row by row, edges repeated."""

    def five(value: Column, window) -> list[Column]:
        one, two = F.coalesce(F.lag(value, 1).over(window), value), F.coalesce(F.lead(value, 1).over(window), value)
        return [F.coalesce(F.lag(value, 2).over(window), one), one, value, two, F.coalesce(F.lead(value, 2).over(window), two)]

    along, down = Window.partitionBy(*KEYS, "gy").orderBy("gx"), Window.partitionBy(*KEYS, "gx").orderBy("gy")
    rows = blocks.withColumn("near", F.array(*five(F.col("block")[0].cast("bigint"), along)))
    return rows.withColumn("near", F.flatten(F.array(*five(F.col("near"), down))))


def smooth_known(blocks: DataFrame) -> DataFrame:
    """Blocks with ``bits`` and ``quant`` whose DC values stay; a projection over two windows."""
    near, bits, quant = F.col("near"), F.col("bits"), F.col("quant")
    value = {}
    for z, weights in sorted(KNOWN.items()):
        total = sum((near[i] * w for i, w in enumerate(weights) if w), F.lit(0).cast("bigint"))
        value[PLACES[z]] = F.when(bits[z] != 0, predicted(total, quant[0].cast("bigint"), quant[PLACES[z]], bits[z])).otherwise(F.lit(0).cast("bigint"))
    low = F.array(*[value.get(k, F.lit(0).cast("bigint")) for k in range(17)])
    filled = around(blocks).withColumn("low", low)
    new = F.transform("block", lambda v, k: F.when((v == 0) & (k < 17), F.element_at("low", F.least(k, F.lit(16)) + 1)).otherwise(v.cast("bigint")))
    return filled.withColumn("block", new).drop("near", "low")


def wavefront(low: np.ndarray, bits: list[int], quant: list[int]) -> np.ndarray:
    """(10, H, W) lowest coefficients of an image, zigzag order, to smoothed ones; DC values change in reading order."""
    out = low.astype(np.int64)
    _, height, width = out.shape
    weights = np.array([UNKNOWN[z] for z in range(len(PLACES))], np.int64)
    q = np.array([quant[k] for k in PLACES], np.int64)[:, None]
    most = np.array([0, *[(1 << b) - 1 if b > 0 else 0 for b in bits[1:]]], np.int64)[:, None]
    for t in range(width + 3 * (height - 1)):
        y = np.arange(max(0, -(-(t - width + 1) // 3)), min(height - 1, t // 3) + 1)
        x = t - 3 * y
        rows = np.clip(y[None] + np.arange(-2, 3)[:, None], 0, height - 1)
        columns = np.clip(x[None] + np.arange(-2, 3)[:, None], 0, width - 1)
        near = out[0][rows[:, None], columns[None]].reshape(25, -1)
        total = weights @ near * q[0]
        size = ((q << 7) + np.abs(total)) // (q << 8)
        size = np.where((most > 0) & (size > most), most, size)
        value = np.where(total < 0, -size, size)
        keep = out[:, y, x]
        fill = (keep == 0) & (np.array(bits)[:, None] != 0)
        fill[0] = True
        out[:, y, x] = np.where(fill, value, keep)
    return out


def smooth_unknown(blocks: DataFrame) -> DataFrame:
    """Blocks with ``bits`` and ``quant`` whose DC values are smoothed too; one image and component a group."""
    ready(blocks.sparkSession)
    names = [*KEYS, "gx", "gy"]
    low = blocks.select(*names, F.array(*[F.col("block")[k].cast("bigint") for k in PLACES]).alias("low"), "bits", "quant")

    def run(table: pa.Table) -> pa.Table:
        gx, gy = (np.unique(table[k].to_numpy(), return_inverse=True)[1] for k in ("gx", "gy"))
        flat = np.asarray(table["low"].combine_chunks().flatten()).reshape(-1, len(PLACES))
        grid = np.zeros((len(PLACES), gy.max() + 1, gx.max() + 1), np.int64)
        grid[:, gy, gx] = flat.T
        new = wavefront(grid, table["bits"][0].as_py(), table["quant"][0].as_py())[:, gy, gx].T
        ends = pa.array(np.arange(len(gx) + 1) * len(PLACES), pa.int32())
        return pa.table([*[table[k] for k in names], pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(new).reshape(-1)))], names=[*names, "low"])

    kinds = ", ".join(f"{k} {low.schema[k].dataType.simpleString()}" for k in names)
    done = low.groupBy(*KEYS).applyInArrow(run, f"{kinds}, low array<bigint>")
    at = {k: z for z, k in enumerate(PLACES)}
    pick = F.array(*[F.lit(at.get(k, -1) + 1) for k in range(25)])  # place in ``low`` of each natural index
    new = F.transform("block", lambda v, k: F.when((k < 25) & (F.element_at(pick, F.least(k, F.lit(24)) + 1) > 0), F.element_at("low", F.greatest(F.element_at(pick, F.least(k, F.lit(24)) + 1), F.lit(1)))).otherwise(v.cast("bigint")))
    return blocks.join(done, names).withColumn("block", new).drop("low")


def smooth(blocks: DataFrame, bits: DataFrame, quant: DataFrame) -> DataFrame:
    """``blocks`` smoothed where it is useful; ``bits`` and ``quant`` have a row per image and component.

    Blocks of an image without bits or table, or to which smoothing doesn't
    apply, stay as they are."""
    names = blocks.columns
    every = blocks.withColumn("block", F.col("block").cast("array<bigint>")).join(bits.select(*KEYS, "bits"), list(KEYS), "left").join(quant.select(*KEYS, "quant"), list(KEYS), "left")
    apply, change = F.coalesce(useful(F.col("bits"), F.col("quant")), F.lit(False)), F.coalesce(dc_changes(F.col("bits")), F.lit(False))
    plain = every.filter(~apply).select(names)
    return plain.unionByName(smooth_known(every.filter(apply & ~change)).select(names)).unionByName(smooth_unknown(every.filter(apply & change)).select(names))
