"""Progressive display as a streaming aggregation.

Scans arrive as rows (image_id, scan, block, k, bits, al): the coefficient bits a
scan adds at bit position ``al``. The state of a coefficient is the set of what
its scans added, kept by Spark: a scan that comes late or twice changes nothing
else. At any time ``preview`` shows the best image so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import dct, smoothing

SCHEMA = "image_id long, scan int, block long, k int, bits long, al int"


def coefficients(scans: DataFrame) -> DataFrame:
    """image_id, block, k, v, scans: works on batch and streaming input (complete or
    update mode). A coefficient's state has an entry per scan, a dozen at most."""
    value = lambda s: s.bits * F.pow(F.lit(2.0), s.al).cast("bigint")
    held = scans.groupBy("image_id", "block", "k").agg(F.collect_set(F.struct("scan", "bits", "al")).alias("s"))
    return held.select("image_id", "block", "k", F.aggregate("s", F.lit(0).cast("bigint"), lambda v, s: v + value(s)).alias("v"), F.array_max(F.transform("s", lambda s: s.scan)).alias("scans"))


def progress(scans: DataFrame) -> DataFrame:
    """image_id, scans (the largest number seen), whole: how many scans from the first on are there without a gap."""
    seen = scans.groupBy("image_id").agg(F.collect_set("scan").alias("s"))
    whole = F.aggregate(F.array_sort("s"), F.lit(0), lambda n, s: F.when(s == n, n + 1).otherwise(n))
    return seen.select("image_id", F.array_max("s").alias("scans"), whole.alias("whole"))


def preview(held: DataFrame, layout: DataFrame, bits: DataFrame, quant: DataFrame, smooth: bool = True) -> DataFrame:
    """image, component, gx, gy, block (64 samples) of the coefficients ``held`` so far.

    ``layout`` has image, component, block, gx, gy for every block: those without
    a coefficient yet are flat. ``bits`` tells how exactly coefficients are known
    (``smoothing.coefficient_bits`` of the scans seen), ``quant`` is the table."""
    values = held.groupBy(F.col("image_id").alias("image"), "block").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))  # 64 at most
    blocks = layout.join(values, ["image", "block"], "left")
    at = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0)).cast("bigint"))
    blocks = blocks.select("image", "component", "gx", "gy", F.when(F.col("m").isNull(), F.array_repeat(F.lit(0).cast("bigint"), 64)).otherwise(at).alias("block"))
    shown = smoothing.smooth(blocks, bits, quant) if smooth else blocks
    scaled = shown.join(quant.select("image", "component", "quant"), ["image", "component"])
    return dct.inverse_sizes(scaled.withColumn("_n", F.lit(8)), "_n", quant="quant").drop("quant", "_n")


def default_tables(images: DataFrame) -> DataFrame:
    """image, component, quant: the luminance table for component 0, the chrominance table for others."""
    return images.withColumn("quant", F.when(F.col("component") == 0, F.array(*map(F.lit, fixed.LUMA))).otherwise(F.array(*map(F.lit, fixed.CHROMA))))
