"""Sample planes (y, x, v): resampling, smoothing and prediction.

Neighbours in a row come from windows over the row, neighbours in a column
from windows over the column, so a task never holds more than a line of one
image; add key columns (an image id) to ``keys`` for many images.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workers import ready


def along(axis: str, keys: tuple[str, ...] = ()):
    other = "y" if axis == "x" else "x"
    return Window.partitionBy(*keys, other).orderBy(axis)


def neighbour(axis: str, step: int, default, value: str = "v", keys: tuple[str, ...] = ()) -> Column:
    w = along(axis, keys)
    return F.coalesce(F.lead(value, step).over(w) if step > 0 else F.lag(value, -step).over(w), default)


def pairs(rows: DataFrame, axis: str, value: str) -> DataFrame:
    """Two samples for each row along ``axis``, from its columns _0 and _1."""
    rest = [c for c in rows.columns if c not in ("_0", "_1", axis)]
    both = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(f"_{d}").alias("v")) for d in (0, 1)])).alias("_o")
    return rows.select(*rest, axis, both).select(*rest, (F.col(axis) * 2 + F.col("_o.d")).alias(axis), F.col("_o.v").alias(value))


def replicate(plane: DataFrame, fx: int, fy: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Nearest upsampling."""
    dx, dy = F.explode(F.sequence(F.lit(0), F.lit(fx - 1))).alias("dx"), F.explode(F.sequence(F.lit(0), F.lit(fy - 1))).alias("dy")
    return plane.select("*", dx).select("*", dy).select(*keys, (F.col("y") * fy + F.col("dy")).alias("y"), (F.col("x") * fx + F.col("dx")).alias("x"), "v")


def fancy_h2v1(plane: DataFrame, keys: tuple[str, ...] = (), narrow: int = 2) -> DataFrame:
    """Triangle filter to twice the width; the outer samples are copied, and all of planes up to ``narrow`` wide."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys, "y"))
    c, left, right = F.col("v"), F.lag("v").over(along("x", keys)), F.lead("v").over(along("x", keys))
    even = F.when(left.isNull() | (n <= narrow), c).otherwise(F.shiftright(3 * c + left + 1, 2))
    odd = F.when(right.isNull() | (n <= narrow), c).otherwise(F.shiftright(3 * c + right + 2, 2))
    return pairs(plane.select(*keys, "y", "x", even.alias("_0"), odd.alias("_1")), "x", "v")


def fancy_h1v2(plane: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Triangle filter to twice the height: +1 above, +2 below, edges repeated."""
    c = F.col("v")
    above, below = neighbour("y", -1, c, keys=keys), neighbour("y", 1, c, keys=keys)
    return pairs(plane.select(*keys, "y", "x", F.shiftright(3 * c + above + 1, 2).alias("_0"), F.shiftright(3 * c + below + 2, 2).alias("_1")), "y", "v")


def fancy_h2v2(plane: DataFrame, keys: tuple[str, ...] = (), narrow: int = 2) -> DataFrame:
    """Triangle filter on both axes: column sums first, then rows with +8 and +7; planes up to ``narrow`` wide aren't filtered across."""
    c = F.col("v")
    sums = [(3 * c + neighbour("y", step, c, keys=keys)).alias(name) for name, step in (("_0", -1), ("_1", 1))]
    cols = pairs(plane.select(*keys, "y", "x", *sums), "y", "s")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys, "y"))
    s, left, right = F.col("s"), F.lag("s").over(along("x", keys)), F.lead("s").over(along("x", keys))
    even = F.shiftright(F.when(left.isNull() | (n <= narrow), 4 * s).otherwise(3 * s + left) + 8, 4)
    odd = F.shiftright(F.when(right.isNull() | (n <= narrow), 4 * s).otherwise(3 * s + right) + 7, 4)
    return pairs(cols.select(*keys, "y", "x", even.alias("_0"), odd.alias("_1")), "x", "v")


def fancy_12_bit(plane: DataFrame, fx: int, fy: int, width: int | None = None, height: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Upsampling of 12-bit planes by ``fx`` and ``fy``: triangle filters for 2 x 1, 1 x 2
    and 2 x 2 whatever the width, nearest for other factors; cut to ``width`` and ``height``."""
    kinds = {(2, 1): lambda: fancy_h2v1(plane, keys, 1), (1, 2): lambda: fancy_h1v2(plane, keys), (2, 2): lambda: fancy_h2v2(plane, keys, 1)}
    out = kinds.get((fx, fy), lambda: replicate(plane, fx, fy, keys))()
    return out.filter((F.lit(width is None) | (F.col("x") < F.lit(width))) & (F.lit(height is None) | (F.col("y") < F.lit(height))))


def downsample(plane: DataFrame, fx: int, fy: int, mean: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Box average of fx x fy samples. The encoder's bias alternates by column
    for 2x1 (0, 1) and 2x2 (1, 2); ``mean`` rounds to nearest instead.

    Planes whose sides aren't multiples take part with the samples they have
    where ``mean``; else pad them first (``pad_edges``)."""
    cx, cy = F.floor(F.col("x") / fx), F.floor(F.col("y") / fy)
    sums = plane.groupBy(*keys, cy.alias("y"), cx.alias("x")).agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    if mean:
        v = F.floor((F.col("s") + F.floor(F.col("n") / 2)) / F.col("n"))
    else:
        odd = F.pmod(F.col("x"), F.lit(2))
        bias = odd if (fx, fy) == (2, 1) else odd + 1 if (fx, fy) == (2, 2) else F.lit(fx * fy // 2)
        v = F.floor((F.col("s") + bias) / (fx * fy))
    return sums.select(*keys, "y", "x", v.alias("v"))


def pad_edges(plane: DataFrame, width: int, height: int, to_w: int, to_h: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """The last column and row repeated up to the given size: edge samples are exploded, inner ones pass."""
    more_x = F.when(F.col("x") == width - 1, F.sequence(F.lit(width - 1), F.lit(to_w - 1))).otherwise(F.array(F.col("x").cast("int")))
    more_y = F.when(F.col("y") == height - 1, F.sequence(F.lit(height - 1), F.lit(to_h - 1))).otherwise(F.array(F.col("y").cast("int")))
    wide = plane.select(*keys, "y", F.explode(more_x.cast("array<bigint>")).alias("x"), "v")
    return wide.select(*keys, F.explode(more_y.cast("array<bigint>")).alias("y"), "x", "v")


def triangle(plane: DataFrame, axis: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(a + 2 b + c + 2) >> 2 along one axis; both ends untouched."""
    w = along(axis, keys)
    a, c = F.lag("v").over(w), F.lead("v").over(w)
    v = F.when(a.isNull() | c.isNull(), F.col("v")).otherwise(F.shiftright(a + 2 * F.col("v") + c + 2, 2))
    return plane.select(*keys, "y", "x", v.alias("v"))


def predictor(number: int, ra: Column, rb: Column, rc: Column) -> Column:
    """Lossless predictors 1..7 of the left, upper and upper left sample."""
    return [ra, rb, rc, ra + rb - rc, ra + F.shiftright(rb - rc, 1), rb + F.shiftright(ra - rc, 1), F.shiftright(ra + rb, 1)][number - 1]


def lossless_difference(plane: DataFrame, number: int, precision: int = 8, shift: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sample minus prediction, modulo 2**precision, as a signed number."""
    full = 1 << precision
    at = plane.withColumn("v", F.shiftright("v", shift)).withColumns({"_a": F.lag("v").over(along("x", keys)), "_b": F.lag("v").over(along("y", keys))})
    at = at.withColumn("_c", F.lag("_b").over(along("x", keys)))
    first = F.lit(1 << (precision - shift - 1)).cast("bigint")
    guess = F.when(F.col("_a").isNull() & F.col("_b").isNull(), first).when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull(), F.col("_b"))
    d = F.pmod(F.col("v") - guess.otherwise(predictor(number, F.col("_a"), F.col("_b"), F.col("_c"))), F.lit(full))
    return at.select(*keys, "y", "x", F.when(d >= full // 2, d - full).otherwise(d).alias("d"))


def undo_left_prediction(diffs: DataFrame, precision: int = 8, shift: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Samples from the differences of predictor 1: prefix sums, the first column's down, then each row's."""
    w = Window.partitionBy(*keys, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    start = diffs.filter("x = 0").withColumn("s", F.sum("d").over(Window.partitionBy(*keys, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)) + (1 << (precision - shift - 1)))
    joined = diffs.join(start.select(*keys, "y", "s"), [*keys, "y"])
    inner = F.sum(F.when(F.col("x") == 0, 0).otherwise(F.col("d"))).over(w)
    return joined.select(*keys, "y", "x", F.pmod(F.col("s") + inner, F.lit(1 << precision)).alias("v"))


def undo_above_prediction(diffs: DataFrame, precision: int = 8, shift: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Samples from the differences of predictor 2: prefix sums, the first row's across, then each column's."""
    turned = diffs.select(*keys, F.col("x").alias("y"), F.col("y").alias("x"), "d")
    return undo_left_prediction(turned, precision, shift, keys).select(*keys, F.col("x").alias("y"), F.col("y").alias("x"), "v")


def undo_prediction(diffs: DataFrame, number: int, precision: int = 8, shift: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Samples from the differences of any predictor. 1 and 2 are prefix sums; the
    others need a sample's restored neighbours, so a plane (one for each value of
    ``keys``) is restored in one task, an antidiagonal at a time."""
    if number < 3:
        return (undo_left_prediction if number == 1 else undo_above_prediction)(diffs, precision, shift, keys)
    ready(diffs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in diffs.schema}

    def restore(table: pa.Table) -> pa.Table:
        y, x, d = (table[c].to_numpy() for c in ("y", "x", "d"))
        v = restore_plane(y, x, d, number, precision, shift)
        return pa.table([*[table[k].combine_chunks() for k in keys], pa.array(y), pa.array(x), pa.array(v)], names=[*keys, "y", "x", "v"])

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"y {kinds['y']}, x {kinds['x']}, v long"])
    return diffs.groupBy(*keys).applyInArrow(restore, schema)


def restore_plane(y: np.ndarray, x: np.ndarray, d: np.ndarray, number: int, precision: int, shift: int) -> np.ndarray:
    """Samples of a whole plane from its differences, given in any order."""
    h, w, full = int(y.max()) + 1, int(x.max()) + 1, 1 << precision
    diff, out = np.zeros((h, w), np.int64), np.zeros((h, w), np.int64)
    diff[y, x] = d
    guess = {3: lambda a, b, c: c, 4: lambda a, b, c: a + b - c, 5: lambda a, b, c: a + ((b - c) >> 1), 6: lambda a, b, c: b + ((a - c) >> 1), 7: lambda a, b, c: (a + b) >> 1}[number]
    start = 1 << (precision - shift - 1)
    out[0] = (start + np.cumsum(diff[0])) % full
    out[:, 0] = (start + np.cumsum(diff[:, 0])) % full
    for s in range(2, h + w - 1):  # cells with y + x = s depend on earlier sums only
        r = np.arange(max(1, s - w + 1), min(h - 1, s - 1) + 1)
        c = s - r
        out[r, c] = (diff[r, c] + guess(out[r, c - 1], out[r - 1, c], out[r - 1, c - 1])) % full
    return out[y, x]


def smooth(plane: DataFrame, factor: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """3x3 smoothing of strength ``factor`` 0..100; edges are repeated."""
    c = F.col("v")
    sums = plane.withColumn("_s", c + neighbour("y", -1, c, keys=keys) + neighbour("y", 1, c, keys=keys))
    around = neighbour("x", -1, F.col("_s"), "_s", keys) + F.col("_s") - c + neighbour("x", 1, F.col("_s"), "_s", keys)
    v = F.shiftright(c * (65536 - factor * 512) + around * (factor * 64) + 32768, 16)
    return sums.select(*keys, "y", "x", F.least(F.lit(255).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), v)).alias("v"))


def smooth_downsample(plane: DataFrame, width: int, height: int, factor: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """2x2 averages with smoothing from the 4x4 neighbourhood, for planes of even sides.

    Every sample is a member of its own cell and an outer neighbour of the next
    one (at an edge: of its own), along each axis; one aggregation sums the four
    parts it plays. Sides count twice, corners once. A plane may lack blocks of
    its last rows: cells without a sample of their own have no average."""
    def parts(axis: str, size: int):
        cell = F.floor(F.col(axis) / 2)
        next_ = F.when(F.pmod(F.col(axis), F.lit(2)) == 0, F.greatest(cell - 1, F.lit(0))).otherwise(F.least(cell + 1, F.lit(size // 2 - 1)))
        return F.explode(F.array(F.struct(cell.cast("bigint").alias("c"), F.lit(0).alias("out")), F.struct(next_.cast("bigint").alias("c"), F.lit(1).alias("out"))))

    played = plane.select(*keys, "x", "v", parts("y", height).alias("_y")).select(*keys, "v", "_y", parts("x", width).alias("_x"))
    outer = F.col("_y.out") + F.col("_x.out")
    weight = F.when(outer == 0, 16384 - factor * 80).when(outer == 1, factor * 32).otherwise(factor * 16)
    sums = played.groupBy(*keys, F.col("_y.c").alias("y"), F.col("_x.c").alias("x")).agg(F.sum(F.col("v") * weight).alias("s"), F.count_if(outer == 0).alias("own"))
    v = F.shiftright(F.col("s") + 32768, 16)
    return sums.filter("own > 0").select(*keys, "y", "x", F.least(F.lit(255).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), v)).alias("v"))


def row_range(first: int, last: int, factor: int = 1, context: int = 1, size: int = 8) -> tuple[int, int]:
    """First and last row of blocks that give the output rows ``first`` to ``last`` of a
    plane enlarged ``factor`` times, with ``context`` more samples for filters."""
    if not 0 <= first <= last:
        raise ValueError("an empty range of rows")
    return max(0, first // factor - context) // size, (last // factor + context) // size


def cut_rows(plane: DataFrame, first: int, last: int) -> DataFrame:
    """The rows asked for, numbered from 0."""
    return plane.filter(F.col("y").between(first, last)).withColumn("y", F.col("y") - first)
