"""Image-like inputs derived from the driver's tables, which hold no images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` dealt to all cores: a table of few narrow rows is a split or two,
    which alone would make what grows out of them many times over."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), by)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, r, g, b: a 20 pixel wide image."""
    p = F.col("p_partkey").cast("bigint")
    return table(spark, sf_dir, "part").select(
        p.alias("id"), (p % 20).alias("x"), F.floor(p / 20).alias("y"),
        (p * 7 % 256).alias("r"), (F.col("p_size").cast("bigint") * 5 % 256).alias("g"), (F.floor("p_retailprice") % 256).alias("b"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, gx, gy, k, v: 8x8 coefficient blocks on a grid 20 blocks wide, natural order."""
    long = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("k", "e"))
    return long.select("id", (F.col("id") % 20).alias("gx"), F.floor(F.col("id") / 20).alias("gy"), F.col("k").cast("bigint").alias("k"), F.floor(F.col("e").cast("double") * 256).alias("v"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, w, h, q (quality), size (of a transform), mh, mv (largest factors): the numbers of an image for each row of ``part``."""
    p = F.col("p_partkey").cast("bigint")
    return table(spark, sf_dir, "part").select(
        p.alias("id"), (p % 997 + 1).alias("w"), (F.col("p_size").cast("bigint") * 7 + 1).alias("h"), (p * 31 % 101).alias("q"),
        (p % 16 + 1).alias("size"), (p % 4 + 1).alias("mh"), (F.floor(p / 4) % 4 + 1).alias("mv"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, x, v: one plane of samples 0..255 from the blocks."""
    k = F.col("k")
    v = F.least(F.lit(255).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.col("v") + 128))
    return blocks(spark, sf_dir).select((F.col("gy") * 8 + F.floor(k / 8)).alias("y"), (F.col("gx") * 8 + k % 8).alias("x"), v.alias("v"))


def _hex(value, size: int):
    return F.lpad(F.hex(value), 2 * size, "0")


def file_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, content: a file's headers, tables and a few coded bytes made of each
    row of ``part``. Odd ids are progressive, every fourth has an Adobe segment,
    every fifth an orientation; those with id % 11 = 10 end early."""
    from ..functions import fixed

    i, z = F.col("p_partkey").cast("bigint"), F.lit("")
    name = F.hex(F.encode("p_name", "UTF-8"))
    quant = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: _hex((i + k) % 255 + 1, 1)), "")
    codes = "".join(f"{b:02X}" for b in [*fixed.DC_LUMA_BITS, *range(12)])
    text = F.concat(
        F.lit("FFD8FFE000104A464946000102"), _hex(i % 3, 1), _hex(F.col("p_size"), 2), _hex(F.col("p_size") + 1, 2), F.lit("0000"),
        F.when(i % 4 == 0, F.concat(F.lit("FFEE000E41646F626500640000" + "0000"), _hex(i % 3, 1))).otherwise(z),
        F.when(i % 5 == 0, F.concat(F.lit("FFE10022457869660000" + "49492A0008000000" + "0100" + "1201030001000000"), _hex(i % 8 + 1, 1), F.lit("00000000000000"))).otherwise(z),
        F.lit("FFFE"), _hex(F.length(name) / 2 + 2, 2), name, F.lit("FFDB004300"), quant,
        F.when(i % 2 == 1, F.lit("FFC2")).otherwise(F.lit("FFC0")), F.lit("001108"), _hex(i % 900, 2), _hex(F.col("p_size") * 3, 2), F.lit("03012200021101031101"),
        F.lit("FFDD0004"), _hex(i % 7, 2), F.lit("FFC4001F00" + codes + "FFDA000C03010002110311003F00" + "1234FF0056FFD078"),
        F.when(i % 2 == 1, F.lit("FFDA000801010001050" + "2" + "ABFF00")).otherwise(z), F.lit("FFD9"),
    )
    cut = F.when(i % 11 == 10, F.substring(text, 1, 44)).otherwise(text)
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    return rows.select(i.alias("id"), F.unhex(cut).alias("content"))
