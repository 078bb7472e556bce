"""Symbols and tables of entropy coding as aggregates and windows.

What goes into the bit stream (categories, runs, frequencies, codes) is
relational; packing bits is left out, see the README.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.quality import category
from ..workers import ready

#: Ids compared in one window where prediction runs through.
RANGE = 4096


def dc_differences(dc: DataFrame, restart: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """id, v, d: difference to the block before; prediction starts anew every ``restart`` blocks.

    Without restarts blocks are compared inside ranges of ``RANGE`` ids; only the
    last value of each range travels on to the next, so no task holds all."""
    if restart:
        w = Window.partitionBy(*keys, F.floor(F.col("id") / restart)).orderBy("id")
        return dc.withColumn("d", F.col("v") - F.coalesce(F.lag("v").over(w), F.lit(0)))
    at = dc.withColumn("_range", F.floor(F.col("id") / RANGE))
    ends = at.groupBy(*keys, "_range").agg(F.max_by("v", "id").alias("_end"))
    ends = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_range"))).drop("_end")
    inside = Window.partitionBy(*keys, "_range").orderBy("id")
    seen = at.withColumn("_lag", F.lag("v").over(inside)).join(ends, [*keys, "_range"])
    return seen.select(*dc.columns, (F.col("v") - F.coalesce("_lag", "_before", F.lit(0))).alias("d"))


def dc_restore(diffs: DataFrame, restart: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """The values of differences: running sums, without restarts by range and offset as above."""
    if restart:
        w = Window.partitionBy(*keys, F.floor(F.col("id") / restart)).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
        return diffs.withColumn("v", F.sum("d").over(w))
    at = diffs.withColumn("_range", F.floor(F.col("id") / RANGE))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = at.groupBy(*keys, "_range").agg(F.sum("d").alias("_sum"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys, "_range").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return at.withColumn("_run", F.sum("d").over(inside)).join(sums, [*keys, "_range"]).select(*diffs.columns, (F.col("_run") + F.col("_before")).alias("v"))


def dc_frequencies(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy(category(F.col("d")).alias("symbol")).agg(F.count(F.lit(1)).alias("n"))


def ac_frequencies(coeffs: DataFrame) -> DataFrame:
    """symbol, n over blocks (id, z: zigzag position, v): runs of zeros and
    categories, 240 for each 16 zeros inside, 0 for an end before position 63."""
    w = Window.partitionBy("id").orderBy("z")  # the DC coefficient stays as the start of the first run
    seen = coeffs.filter("z = 0 OR v <> 0").select("z", "v", (F.col("z") - F.lag("z").over(w) - 1).alias("run"), F.lead("z").over(w).isNull().alias("last"))
    part = lambda symbol, n: F.struct(symbol.cast("bigint").alias("symbol"), n.cast("bigint").alias("n"))
    plain = part(F.pmod("run", F.lit(16)) * 16 + category(F.col("v")), F.lit(1))
    zeros = part(F.lit(240), F.floor(F.col("run") / 16))
    end = part(F.lit(0), F.when(F.col("last") & (F.col("z") < 63), 1).otherwise(0))
    symbols = F.when(F.col("z") > 0, F.array(plain, zeros, end)).otherwise(F.array(end))
    found = seen.select(F.explode(F.filter(symbols, lambda s: s.n > 0)).alias("s"))
    return found.groupBy("s.symbol").agg(F.sum("s.n").alias("n"))


def canonical_codes(spark: SparkSession, bits: list[int], values: list[int] | None = None) -> DataFrame:
    """position, length, code, symbol of a table given by its counts per length.

    The code of a symbol is the sum of 2**-length of those before it, scaled to its own length."""
    values = list(range(sum(bits))) if values is None else values
    lengths = [n for n, c in enumerate(bits, 1) for _ in range(c)]
    if len(values) < len(lengths):
        raise ValueError("fewer values than codes")
    rows = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(zip(lengths, values, strict=False))], "position long, length long, symbol long")
    share = F.shiftright(F.lit(65536).cast("bigint"), 0) / F.pow(F.lit(2.0), F.col("length"))
    before = F.coalesce(F.sum(share).over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.select("position", "length", (before / share).cast("bigint").alias("code"), "symbol")


def progressive_script(components: int) -> list[tuple[list[int], int, int, int, int]]:
    """The default scans as (components, first, last, high bit, low bit)."""
    every, each = list(range(components)), [[i] for i in range(components)]
    first = [(every, 0, 0, 0, 1)] + [(c, 1, 5, 0, 2) for c in each] + [(c, 6, 63, 0, 2) for c in each]
    return first + [(c, 1, 63, 2, 1) for c in each] + [(every, 0, 0, 1, 0)] + [(c, 1, 63, 1, 0) for c in each]


def optimal_code(counts: dict[int, int]) -> tuple[list[int], list[int]]:
    """(codes per length 1..16, symbols in code order) of least total length.

    A reserved symbol 256 keeps the code of all ones free. Of equal counts the
    larger symbol is merged first; a merged node stands at the place of the
    smaller. Lengths over 16 are shortened as the standard's annex K does."""
    depth = {s: 0 for s, n in counts.items() if n > 0} | {256: 0}
    heap = [(counts.get(s, 0) if s < 256 else max(1, counts.get(256, 0)), -s, [s]) for s in depth]
    heapq.heapify(heap)
    while len(heap) > 1:
        (n, place, low), (m, _, high) = heapq.heappop(heap), heapq.heappop(heap)
        for s in (*low, *high):
            depth[s] += 1
        heapq.heappush(heap, (n + m, place, low + high))
    lengths = [0] * 258
    for d in depth.values():
        lengths[d] += 1
    for d in range(257, 16, -1):
        while lengths[d]:
            shorter = next(x for x in range(d - 2, 0, -1) if lengths[x])
            lengths[d] -= 2
            lengths[d - 1] += 1
            lengths[shorter + 1] += 2
            lengths[shorter] -= 1
    longest = max(d for d in range(17) if lengths[d])
    lengths[longest] -= 1
    return lengths[1:17], sorted((s for s in depth if s < 256), key=lambda s: (depth[s], s))


def optimal_tables(frequencies: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, position, length, code, symbol from (keys, symbol, n): one table per
    key from at most 256 counts. A key without counts has no row."""
    ready(frequencies.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in frequencies.schema}

    def build(table: pa.Table) -> pa.Table:
        bits, symbols = optimal_code(dict(zip(table["symbol"].to_pylist(), table["n"].to_pylist(), strict=True)))
        lengths = [d for d, k in enumerate(bits, 1) for _ in range(k)]
        codes, code = [], 0
        for i, d in enumerate(lengths):
            code = (code + 1) << (d - lengths[i - 1]) if i else 0
            codes.append(code)
        held = [table[k].combine_chunks().take(pa.array([0] * len(codes), pa.int64())) for k in keys]
        return pa.table([*held, *[pa.array(c, pa.int64()) for c in (range(len(codes)), lengths, codes, symbols)]], names=[*keys, "position", "length", "code", "symbol"])

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "position long, length long, code long, symbol long"])
    return frequencies.groupBy(*keys).applyInArrow(build, schema)
