"""Operator 1, exact dedup.

Texts are equal when identical after lower-casing A-Z only. Documents are
grouped by a 128-bit hash (MD5) of the normalised text. Inside hash groups of
two and more rows the bytes themselves are grouped, so a collision splits the
group. One row of each group stays: the one with the smallest or the largest
id (``keep``).

Plan: the hash pass shuffles ids and 16-byte hashes, with partial aggregation
(a hot group sends one row per task). Only texts whose hash occurs twice are
shuffled for the byte comparison, and there too equal texts of a task leave it
once.

Defined results: a null text is the empty text. A row with a null id never
stands for a group that has an id; if no row of a group has one, ``keep_id`` is
null and one of its rows stays. Of repeated rows (same id and text) one stays.
An empty table gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import base


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", scratch: base.Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, h."""
    spark = docs.sparkSession
    scratch = scratch or base.Scratch(spark, "exact")
    pick = {"min": F.min, "max": F.max}[keep]
    norm = base.ascii_lower(docs[text_col].cast("string"))
    keyed = docs.select(docs[id_col].alias("doc_id"), norm.alias("norm")).withColumn("h", F.unhex(F.md5("norm")))

    ids = scratch.table(keyed.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256")))
    n = ids.count()
    groups = scratch.table(ids.groupBy("h").agg(F.count(F.lit(1)).alias("group_size"), pick("doc_id").alias("keep_id")), rows=n)

    # Bytes inside hash groups: the text is a grouping key, compared byte by byte.
    repeated = base.small(scratch.table(groups.filter("group_size > 1").select("h"), rows=n))
    variants = scratch.table(
        keyed.join(repeated, "h").groupBy("h", "norm").agg(F.count(F.lit(1)).alias("group_size"), pick("doc_id").alias("keep_id"))
        .select("h", "group_size", "keep_id", F.sha2("norm", 256).alias("text_sha256")),
        rows=n, per_file=50_000,
    )
    collided = base.small(scratch.table(variants.groupBy("h").count().filter("count > 1").select("h"), rows=n))

    plain = ids.join(collided, "h", "left_anti").join(groups, "h")
    # Within one 128-bit collision SHA-256 tells the byte groups apart.
    split = ids.join(collided, "h", "left_semi").join(variants.withColumnRenamed("text_sha256", "v"), ["h"]).filter("text_sha256 = v")
    cols = ["doc_id", "keep_id", "group_size", "text_sha256", "h"]
    out = plain.select(cols).unionByName(split.select(cols)).coalesce(max(1, -(-n // 50_000)))  # no task for a handful of rows

    stands = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    extra = ids.groupBy("h", "doc_id").count().filter("count > 1").limit(1)
    if extra.isEmpty():
        return out.select("doc_id", "keep_id", "group_size", stands.alias("kept"), "text_sha256", "h")
    nth = F.row_number().over(Window.partitionBy("h", "text_sha256", "doc_id").orderBy("group_size"))
    return out.select("doc_id", "keep_id", "group_size", (stands & (nth == 1)).alias("kept"), "text_sha256", "h")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept."""
    scratch = base.Scratch(docs.sparkSession, "exact")
    said = exact_dedup(docs, id_col, text_col, keep, scratch)
    gone = scratch.table(said.groupBy("doc_id", "h").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).filter("NOT kept OR n > 1"))
    if gone.isEmpty():
        return docs
    h, i, n = (base.fresh_name(docs, x) for x in ("_h", "_i", "_n"))
    mark = gone.select(F.col("h").alias(h), F.col("doc_id").alias(i), F.col("n").alias(n), F.col("kept").alias(n + "k"))
    hashed = docs.withColumn(h, F.unhex(F.md5(base.ascii_lower(docs[text_col].cast("string")))))
    clear = hashed.join(base.small(mark), (hashed[h] == mark[h]) & hashed[id_col].eqNullSafe(mark[i]), "left_anti").select(docs.columns)
    once = gone.filter("kept AND n > 1").select(F.col("h").alias(h), F.col("doc_id").alias(i))
    if once.isEmpty():
        return clear
    again = hashed.join(base.small(once), (hashed[h] == once[h]) & hashed[id_col].eqNullSafe(once[i]), "left_semi").dropDuplicates([h, id_col]).select(docs.columns)
    return clear.unionByName(again)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(base.read(spark, sf_dir, "documents"), keep="max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""
