"""Operator 11, Merkle manifest of a data set by superblock reduction.

Every row is a leaf: the SHA-256 of its columns, each written as ``-`` if null,
else as byte count, colon and value. The leaves of a group ascend by id;
``fanout`` consecutive nodes become the hash of their hexadecimal texts, level by
level, to the group's root. The groups' roots, ordered by group (null first, then
bytewise), make the manifest's root likewise.

1. Leaves. One narrow pass hashes the rows; texts aren't shuffled.
2. Order. Leaves are range-partitioned by group, id and leaf; places inside a
   partition and prefix sums over the partitions' counts by group give every
   leaf its index. A group's rows lie in as many partitions as they fill, and so
   do rows that are all equal: the place they are read from is the last key.
3. Superblocks. Leaves are bucketed by index div fanout**k; ``applyInPandas``
   collapses k levels of a bucket at once (1,024 leaves where fanout is 2) and
   gives each leaf its siblings and the bucket its root. Bucket roots are the
   nodes of the next reduction, with another k levels, until a group has one
   node: log(n) / (k log(fanout)) rounds, each on a thousandth of the nodes.
   The groups' roots are reduced in the same way.
4. Proofs. The siblings of a leaf are those in its bucket followed by those of
   the bucket's root, found by joining down from the last round. A round's proofs
   are broadcast only if counted small.

A proof has two arrays with an entry a level: the digests left and right of the
path. ``fold`` recomputes the root that a leaf and a proof claim.

Defined results: a row with a null id comes first in its group, rows with one id
are ordered by leaf. Repeated rows are leaves of their own with proofs of their
own. Null or empty texts, null groups and long texts are values like others. A
group of one row has that leaf as its root, a single group's root is the
manifest's. An empty table gives an empty manifest. Extra columns don't matter
unless named as ``columns``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import base

COLUMNS, FANOUT, LEVELS = ("doc_id", "source", "lang", "n_chars", "text"), 2, 10


def digest(*values: Column) -> Column:
    """SHA-256 of the values' fields, as lowercase hexadecimal text."""
    fields = []
    for v in values:
        text = v.cast("string")
        fields.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*fields), 256)


def text(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def numbered(rows: DataFrame, within: str, order: list[str], name: str, scratch: base.Scratch) -> DataFrame:
    """``rows`` with their place from 0 among the rows of one ``within`` (not null), by ``order``."""
    keys = [within, *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = scratch.table(dealt)
    part = F.shiftright("_at", 33)  # the partition's number; the low bits count its rows
    totals = placed.groupBy(within, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(within, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_start"))
    starts = base.small(scratch.table(starts))
    return placed.withColumn("_part", part).join(starts, [within, "_part"]).withColumn(name, F.col("_at") + F.col("_start")).drop("_at", "_part", "_start")


def collapse(fanout: int, levels: int):
    """Grouped function: up to ``levels`` levels of one bucket of a tree of ``n`` nodes."""

    def run(rows):
        rows = rows.sort_values("idx")
        n = int(rows["n"].iloc[0])
        nodes = [bytes(h) for h in rows["h"]]
        lefts, rights = [[] for _ in nodes], [[] for _ in nodes]
        width = 1  # leaves under a node
        for _ in range(levels):
            if n == 1:
                break
            n = -(-n // fanout)
            above, left, right = [], [], []
            for a in range(0, len(nodes), fanout):
                run_ = nodes[a : a + fanout]
                above.append(hashlib.sha256("".join(h.hex() for h in run_).encode()).digest())
                for i in range(len(run_)):
                    left.append(b"".join(run_[:i]))
                    right.append(b"".join(run_[i + 1 :]))
            for i in range(len(lefts)):
                lefts[i].append(left[i // width])
                rights[i].append(right[i // width])
            nodes, width = above, width * fanout
        return rows.drop(columns="n").assign(left=lefts, right=rights, top=[nodes[0]] * len(rows))

    return run


def forest(leaves: DataFrame, scratch: base.Scratch, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Proofs and roots of one tree per ``g``; ``leaves`` has g, idx and h (binary).

    Returns the leaves with ``left`` and ``right``, and (g, h) of the roots."""
    if fanout < 2 or levels < 1:
        raise ValueError("a tree needs a fanout of two and more, and a level at a time")
    block = fanout**levels
    leaves = scratch.table(leaves)
    sizes = scratch.table(leaves.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    rounds, nodes = [], leaves
    most = sizes.agg(F.max("n")).first()[0] or 0
    while True:
        sized = nodes.join(base.small(sizes), "g").withColumn("bucket", F.expr(f"idx div {block}"))
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
        done = sized.groupBy("g", "bucket").applyInPandas(collapse(fanout, levels), f"{kinds}, bucket long, left array<binary>, right array<binary>, top binary")
        rounds.append(scratch.table(done))
        nodes = rounds[-1].filter(F.col("idx") % block == 0).select("g", F.col("bucket").alias("idx"), F.col("top").alias("h"))
        if most <= block:
            break
        nodes = scratch.table(nodes)
        sizes = sizes.withColumn("n", F.expr(f"(n + {block - 1}) div {block}"))
        most = -(-most // block)
    proofs = rounds.pop().drop("bucket", "top")
    while rounds:
        upper = proofs.select("g", F.col("idx").alias("bucket"), F.col("left").alias("_l"), F.col("right").alias("_r"))
        joined = rounds.pop().join(base.small(scratch.table(upper)), ["g", "bucket"])
        proofs = joined.withColumn("left", F.concat("left", "_l")).withColumn("right", F.concat("right", "_r")).drop("bucket", "top", "_l", "_r")
    return proofs, nodes.select("g", "h")


def manifest(
    docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", id_col: str = "doc_id",
    fanout: int = FANOUT, levels: int = LEVELS, carried: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, leaf, subroot, root (hexadecimal), proof
    (``left``, ``right``) and the columns ``carried``, computed beside the leaf."""
    scratch = base.Scratch(docs.sparkSession, "merkle")
    name = F.coalesce(F.concat(F.lit("="), docs[group].cast("string")), F.lit(""))  # null first, then bytewise
    leaf = F.unhex(digest(*[docs[c] for c in columns]))
    extra = [c.alias(f"carried_{k}") for k, c in (carried or {}).items()]
    hashed = scratch.table(docs.select(docs[id_col].alias("id"), name.alias("g"), leaf.alias("h"), *extra).withColumn("tie", F.monotonically_increasing_id()))
    proofs, subroots = forest(numbered(hashed, "g", ["id", "h", "tie"], "idx", scratch).drop("tie"), scratch, fanout, levels)
    trees = scratch.table(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "h"))
    above, root = forest(numbered(trees, "g", ["name"], "idx", scratch), scratch, fanout, levels)
    tops = above.select(F.col("name").alias("g"), F.col("h").alias("subroot"), F.col("left").alias("_l"), F.col("right").alias("_r")).crossJoin(F.broadcast(root.select(F.col("h").alias("root"))))  # one row
    out = proofs.join(base.small(scratch.table(tops)), "g")
    return out.select(
        F.col("id").alias(id_col), text(F.col("h")).alias("leaf"), text(F.col("subroot")).alias("subroot"), text(F.col("root")).alias("root"),
        F.concat("left", "_l").alias("left"), F.concat("right", "_r").alias("right"), *[F.col(f"carried_{k}").alias(k) for k in carried or {}],
    )


def fold(leaf: Column, left: Column, right: Column) -> Column:
    """The root that a leaf (hexadecimal) and its proof lead to."""
    steps = F.arrays_zip(left.alias("left"), right.alias("right"))
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(text(s["left"]), h, text(s["right"])), 256))


def proof_digest(left: Column, right: Column) -> Column:
    steps = F.zip_with(left, right, lambda a, b: F.concat(text(a), text(b)))
    return F.sha2(F.array_join(steps, ""), 256)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents, and what their proofs say of rows some of which were changed."""
    docs = base.read(spark, sf_dir, "documents")
    altered = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    claim = digest(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in COLUMNS])
    rows = manifest(docs, carried={"claim": F.when(altered, F.unhex(claim))})
    left, right = F.col("left"), F.col("right")
    folded = rows.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(left, right).alias("proof_sha256"),
        fold(F.coalesce(text(F.col("claim")), F.col("leaf")), left, right).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels as lists per tree; checksums bit by bit.
OP11_SQL = """
WITH RECURSIVE f AS (
  SELECT doc_id, lang, n_chars, concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-')) AS a,
    coalesce(strlen(text) || ':' || text, '-') AS z,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
      lambda x, c: list_reduce(list_prepend(xor(x, c), range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))) AS crc
  FROM documents),
h AS MATERIALIZED (
  SELECT doc_id, lang, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || z) AS leaf,
    CASE WHEN n_chars IS NOT NULL AND xor(crc, 4294967295) % 7 = 0 THEN sha256(a || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || z) END AS claim
  FROM f),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM h),
t AS (
  SELECT lang, 0 AS lvl, list(leaf ORDER BY idx) AS nodes FROM l GROUP BY lang
  UNION ALL
  SELECT lang, lvl + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) FROM t WHERE len(nodes) > 1),
tree AS MATERIALIZED (SELECT * FROM t),
subs AS MATERIALIZED (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx FROM tree WHERE len(nodes) = 1),
u AS (
  SELECT 0 AS lvl, list(subroot ORDER BY idx) AS nodes FROM subs
  UNION ALL
  SELECT lvl + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) FROM u WHERE len(nodes) > 1),
tops AS MATERIALIZED (SELECT * FROM u),
step AS (
  SELECT l.doc_id, l.lang, l.idx, t.lvl, (l.idx >> t.lvl) & 1 AS odd, coalesce(t.nodes[xor(l.idx >> t.lvl, 1) + 1], '') AS sibling FROM l JOIN tree t ON l.lang IS NOT DISTINCT FROM t.lang AND len(t.nodes) > 1
  UNION ALL
  SELECT l.doc_id, l.lang, l.idx, 1000 + u.lvl, (s.idx >> u.lvl) & 1, coalesce(u.nodes[xor(s.idx >> u.lvl, 1) + 1], '') FROM l JOIN subs s ON l.lang IS NOT DISTINCT FROM s.lang JOIN tops u ON len(u.nodes) > 1),
p AS MATERIALIZED (SELECT lang, idx, string_agg(sibling, '' ORDER BY lvl) AS proof, list({'odd': odd, 'sibling': sibling} ORDER BY lvl) AS steps FROM step GROUP BY lang, idx),
w AS (
  SELECT lang, idx, coalesce(claim, leaf) AS x, 1 AS k FROM l
  UNION ALL
  SELECT w.lang, w.idx, CASE WHEN p.steps[k].odd = 1 THEN sha256(p.steps[k].sibling || x) ELSE sha256(x || p.steps[k].sibling) END, k + 1
  FROM w JOIN p ON w.lang IS NOT DISTINCT FROM p.lang AND w.idx = p.idx WHERE k <= len(p.steps)),
e AS (SELECT lang, idx, arg_max(x, k) AS folded_root FROM w GROUP BY lang, idx)
SELECT l.doc_id, leaf, subroot, r.nodes[1] AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = r.nodes[1] AS verified
FROM l JOIN subs s ON l.lang IS NOT DISTINCT FROM s.lang JOIN e ON l.lang IS NOT DISTINCT FROM e.lang AND l.idx = e.idx
LEFT JOIN p ON l.lang IS NOT DISTINCT FROM p.lang AND l.idx = p.idx CROSS JOIN (SELECT nodes FROM tops WHERE len(nodes) = 1) r
"""
