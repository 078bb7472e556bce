"""Symbols of progressive scans, for many scans of many blocks at once.

A scan codes the coefficients ss..se of every block (zigzag positions) at bit
position ``al``: a first scan those that are not zero there, a refinement those
that become one there, with a bit for each that was known before. Runs of zeros,
ends of band and correction bits are windows over a block's coefficients; runs
of ends of band over blocks are gaps and islands over block order.

Coefficients are rows (keys, id: block order, z, v); zeros needn't be there, but
a block without any row isn't one. Scans are rows (scan, ss, se, al), at most a
few dozen, and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.quality import category
from .bitpack import running
from .entropy import RANGE, progressive_script

#: Longest run of ends of band that one symbol can state.
LONGEST = 32767


def scan_table(spark: SparkSession, components: int = 1) -> DataFrame:
    """The default script: scan, component, ss, se, ah, al, one row per scan and component."""
    rows = [(n, c, ss, se, ah, al) for n, (cs, ss, se, ah, al) in enumerate(progressive_script(components)) for c in cs]
    return spark.createDataFrame(rows, "scan long, component long, ss long, se long, ah long, al long")


def _banded(coeffs: DataFrame, scans: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, scan, id, z, t, ss, se: magnitudes at the scan's bit position inside its
    band, and a row without ``t`` for every block."""
    small = F.broadcast(scans.select("scan", "ss", "se", "al"))
    blocks = coeffs.select(*keys, "id").distinct().crossJoin(small).select(*keys, "scan", "id", F.lit(None).cast("bigint").alias("z"), F.lit(None).cast("bigint").alias("t"), "ss", "se")
    t = F.expr("shiftright(abs(v), cast(al as int))")
    held = coeffs.filter("v <> 0").join(small, F.col("z").between(F.col("ss"), F.col("se"))).withColumn("t", t.cast("bigint")).filter("t > 0")
    return held.select(*keys, "scan", "id", F.col("z").cast("bigint").alias("z"), "t", "ss", "se").unionByName(blocks)


def _symbols(rows: DataFrame, by: list[str], value: Column, zeros: Column, end: Column) -> DataFrame:
    """by, symbol, n: of rows with a value, sixteens of zeros inside and ends of band."""
    part = lambda symbol, n: F.struct(symbol.cast("bigint").alias("symbol"), n.cast("bigint").alias("n"))
    found = F.filter(F.array(part(value, F.when(value.isNotNull(), 1).otherwise(0)), part(F.lit(240), F.coalesce(zeros, F.lit(0))), part(F.lit(0), F.when(end, 1).otherwise(0))), lambda s: s.n > 0)
    return rows.select(*by, F.explode(found).alias("s")).groupBy(*by, "s.symbol").agg(F.sum("s.n").alias("n"))


def first_frequencies(coeffs: DataFrame, scans: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, scan, symbol, n of first AC scans: runs of zeros and categories, 240 for 16
    zeros inside, 0 for a block that ends before the band does."""
    w = Window.partitionBy(*keys, "scan", "id").orderBy(F.col("z").asc_nulls_first())
    seen = _banded(coeffs, scans, keys).withColumns({"run": F.col("z") - F.coalesce(F.lag("z").over(w), F.col("ss") - 1) - 1, "last": F.lead("scan").over(w).isNull()})
    value = F.when(F.col("z").isNotNull(), F.pmod("run", F.lit(16)) * 16 + category(F.col("t")))
    end = F.col("last") & (F.coalesce("z", F.col("ss") - 1) < F.col("se"))
    return _symbols(seen, [*keys, "scan"], value, F.floor(F.col("run") / 16), end)


def refined(coeffs: DataFrame, scans: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of refinement scans: keys, scan, id, z, fresh (becomes one in this scan),
    known (was there before), run (zeros since the last fresh one), end (the block
    has zeros after its last fresh one)."""
    w = Window.partitionBy(*keys, "scan", "id").orderBy(F.col("z").asc_nulls_first())
    before, so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    rows = _banded(coeffs, scans, keys).withColumns({"fresh": F.coalesce(F.col("t") == 1, F.lit(False)), "known": F.coalesce(F.col("t") > 1, F.lit(False))})
    rows = rows.withColumn("held", F.sum(F.col("known").cast("bigint")).over(so_far))
    mark = F.when(F.col("fresh"), F.struct("z", "held"))
    since, upto = F.last(mark, ignorenulls=True).over(before), F.last(mark, ignorenulls=True).over(so_far)
    start = F.col("ss") - 1
    rows = rows.withColumns({"since": since, "upto": upto, "last": F.lead("scan").over(w).isNull()})
    run = F.col("z") - F.coalesce("since.z", start) - 1 - (F.col("held") - F.coalesce("since.held", F.lit(0)))
    rest = F.col("se") - F.coalesce("upto.z", start) - (F.col("held") - F.coalesce("upto.held", F.lit(0)))
    return rows.select(*keys, "scan", "id", "z", "fresh", "known", F.when(F.col("fresh"), run).alias("run"), (F.col("last") & (rest > 0)).alias("end"))


def refine_frequencies(coeffs: DataFrame, scans: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, scan, symbol, n of refinement scans: fresh coefficients with the zeros before
    them (known ones aren't counted), 240 for 16 zeros, 0 for an end of band."""
    rows, run = refined(coeffs, scans, keys), F.col("run")
    return _symbols(rows, [*keys, "scan"], F.when(F.col("fresh"), F.pmod(run, F.lit(16)) * 16 + 1), F.floor(run / 16), F.col("end"))


def correction_bits(coeffs: DataFrame, scans: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, scan, n: bits that refine coefficients known before."""
    return refined(coeffs, scans, keys).groupBy(*keys, "scan").agg(F.sum(F.col("known").cast("bigint")).alias("n"))


def end_runs(coeffs: DataFrame, scans: DataFrame, keys: tuple[str, ...] = (), longest: int = LONGEST) -> DataFrame:
    """keys, scan, start, blocks, symbol, bits, size: ends of band of first scans joined to
    runs over block order, each at most ``longest``, with the ``size`` bits after it.

    A block with a coefficient in the band ends the run before it; its own end, if
    it has one, starts the next. Runs are numbered by a running count in two levels
    and counted by an aggregation, so an empty image isn't one task's."""
    by = [*keys, "scan"]
    blocks = _banded(coeffs, scans, keys).groupBy(*by, "id").agg(F.max("z").alias("z"), F.first("se").alias("se"), F.first("ss").alias("ss"))
    blocks = blocks.withColumns({"opens": F.col("z").isNotNull(), "ends": F.coalesce("z", F.col("ss") - 1) < F.col("se")})
    numbered = running(blocks, F.col("opens").cast("bigint"), by, F.floor(F.col("id") / RANGE), ["id"], "earlier")
    run = F.col("earlier") + F.col("opens").cast("bigint")
    runs = numbered.filter("ends").groupBy(*by, run.alias("run")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("start"))
    whole = F.floor(F.col("n") / longest)
    each = lambda i: F.when(i < whole, F.lit(longest).cast("bigint")).otherwise(F.pmod("n", F.lit(longest)).cast("bigint"))
    sizes = F.filter(F.transform(F.sequence(F.lit(0).cast("bigint"), whole), each), lambda n: n > 0)
    parts = runs.select(*by, "start", F.posexplode(sizes).alias("part", "blocks"))
    size = category(F.col("blocks")) - 1
    bits = F.col("blocks") - F.pow(F.lit(2.0), size).cast("bigint")
    return parts.select(*by, "start", F.col("part").cast("bigint").alias("part"), "blocks", (size * 16).alias("symbol"), bits.alias("bits"), size.alias("size"))
