"""Lenient reading: damaged coded blocks become zero blocks with a warning.

Prediction of DC values starts anew after a damaged block as it does at a restart
marker, so values are running sums between resets; resets are a running count.
Both run in two levels (``bitpack.running``). An image whose data end too early
is gray as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitpack import running
from .entropy import RANGE


def recover(coded: DataFrame, images: DataFrame, keys: tuple[str, ...] = ("image",)) -> tuple[DataFrame, DataFrame]:
    """(keys, id, v: the DC value of every block; warnings: keys, kind, id, blocks).

    ``coded``: keys, id (block order), d (difference) and error: null, ``code`` for
    a block that can't be read, or ``end`` where the data end. ``images``: keys,
    total (blocks) and restart (interval, 0 for none). A block that isn't there
    counts as unreadable. ``end`` warns with the number of blocks before it, and
    nothing after it counts."""
    every = images.select(*keys, "total", "restart", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("total").cast("bigint") - 1)).alias("id")).filter("id BETWEEN 0 AND total - 1")
    stop = coded.filter("error = 'end'").groupBy(*keys).agg(F.min("id").alias("stop"))
    rows = every.join(coded.select(*keys, "id", F.col("d").cast("bigint").alias("d"), "error", F.lit(True).alias("there")), [*keys, "id"], "left").join(stop, list(keys), "left")
    bad = F.col("error").isNotNull() | F.col("there").isNull()
    rows = rows.withColumns({"bad": bad, "segment": F.when(F.col("restart") > 0, F.floor(F.col("id") / F.greatest("restart", F.lit(1)))).otherwise(F.lit(0).cast("bigint"))})
    place = F.floor(F.col("id") / RANGE)
    resets = running(rows, F.col("bad").cast("bigint"), [*keys, "segment"], place, ["id"], "resets")
    amount = F.when(F.col("bad"), 0).otherwise(F.col("d"))
    summed = running(resets, amount, [*keys, "segment", "resets"], place, ["id"], "earlier")
    v = F.when(F.col("bad") | F.col("stop").isNotNull(), F.lit(0).cast("bigint")).otherwise(F.col("earlier") + F.col("d"))
    blocks = summed.select(*keys, "id", v.alias("v"))
    before = F.col("stop").isNull() | (F.col("id") < F.col("stop"))
    codes = rows.filter(F.col("bad") & before).select(*keys, F.lit("code").alias("kind"), "id", F.lit(None).cast("bigint").alias("blocks"))
    ends = stop.join(images.select(*keys), list(keys)).select(*keys, F.lit("end").alias("kind"), F.col("stop").alias("id"), F.col("stop").cast("bigint").alias("blocks"))
    return blocks, codes.unionByName(ends)
