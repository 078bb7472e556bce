"""Operator 6, sharding: histogram sort by bytes.

Rows are ordered by size class (powers of four, largest first), then by a
60-bit hash of the text, then by a 60-bit hash of the id, so equal texts lie
together. Splitters are found by counting, never by sampling: each round counts
the exact bytes below every candidate boundary (4,096 per splitter) in one
partial aggregation, keeps a boundary that meets the tolerance and otherwise
probes inside the bin that holds the target. When a bin holds a single text, the
cut goes beside it if the smaller size classes have twice its bytes for every
shard, so that they can even it out; only larger groups of copies are cut
between shards, by the id hash.
The driver sees at most 4,096 counts per class or splitter and round. Then rows
are exchanged once, by range.

A cut misses its target by up to half of the text that lies on it. Each class
is therefore cut so that the shards' bytes so far end level: what the long
texts leave uneven the shorter ones even out, and shards differ by about a text
of the smallest classes. One rule holds for all rows and table sizes.

A row's slot is its position in its shard, from the positions in the sorted
partitions and a prefix sum over the partitions' row counts; no task holds a
whole shard.

Defined results: a null text has no bytes (size 1 with the row's overhead of
1). Null ids hash to a constant. Repeated rows share a key and may stay
together; they get slots of their own. An empty table gives an empty result.
The result columns are called shard and slot; columns of the input with these
names (in any case) are left out, others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import base

BITS, LEVELS = 12, 5


def hash60(c: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(c), 4)


def room(loads: list[int], rest: int) -> list[float]:
    """Bytes of ``rest`` each shard takes so that all end level, as far as loads allow."""
    free, order = float(rest), sorted(loads)
    level = order[0]
    for i, x in enumerate(order[1:], 1):
        if (x - level) * i > free:
            break
        free -= (x - level) * i
        level = x
    level += free / sum(x <= level for x in loads)
    return [max(0.0, level - x) for x in loads]


def size_class(size: Column) -> Column:
    """0 for 0 and 1, then one class per factor of four."""
    return F.when(size < 2, 0).otherwise(F.ceil(F.length(F.bin(size)) / 2)).cast("int")


def splitters(rows: DataFrame, targets: list[float], slack: float, first: list[tuple[int, int, int]] | None = None, whole: float = 0) -> tuple[list[tuple[int, int]], list[int]]:
    """Boundaries (k1, k2) with ``targets`` bytes below them, and those bytes; a
    row belongs left of one if its keys are below it.

    ``rows`` has k1, k2 and size; ``first``: the (digit, bytes, rows) of its
    first level, if counted before. A boundary is accepted within ``slack``
    bytes of its target, else refined as far as the keys allow; rows of one k1
    with at most ``whole`` bytes aren't parted."""
    found: dict[int, tuple[tuple[int, int], int]] = {}
    #: splitter -> (prefix as tuple of known key digits, bytes below the prefix)
    active = {i: ((), 0) for i in range(len(targets))}
    for level in range(2 * LEVELS):
        if not active:
            break
        wanted = sorted({p for p, _ in active.values()})
        counts = {0: first} if first is not None and level == 0 else _count(rows, level, wanted)
        for i, (prefix, below) in list(active.items()):
            target, at, best, inside = targets[i], below, None, None
            for d, b, n in sorted(counts.get(wanted.index(prefix), [])):
                for edge, bytes_below in ((d, at), (d + 1, at + b)):
                    if best is None or abs(bytes_below - target) < abs(best[0] - target):
                        best = (bytes_below, prefix + (edge,))
                if at <= target < at + b:
                    inside = (prefix + (d,), at, n, b)
                at += b
            if best is None:
                found[i] = (0, 0), 0
                del active[i]
            elif abs(best[0] - target) <= slack or level == 2 * LEVELS - 1 or inside is None or inside[2] == 1 or (level == LEVELS - 1 and inside[3] <= whole):
                found[i] = _bound(best[1]), best[0]
                del active[i]
            else:
                active[i] = inside[:2]
    return [found[i][0] for i in sorted(found)], [found[i][1] for i in sorted(found)]


def _count(rows: DataFrame, level: int, wanted: list[tuple]) -> dict[int, list[tuple[int, int, int]]]:
    """(next digit, bytes, rows) of the rows under each of the ``wanted`` prefixes."""
    key, depth = ("k1", level) if level < LEVELS else ("k2", level - LEVELS)
    shift = BITS * (LEVELS - 1 - depth)
    head = F.shiftright(key, shift + BITS)
    tag = F.when(F.lit(False), -1)
    for t, (a, b) in enumerate(_value(p) for p in wanted):
        tag = tag.when((head == (a if level < LEVELS else b)) & (F.lit(True) if level < LEVELS else F.col("k1") == a), t)
    seen = rows.select(tag.alias("t"), F.shiftright(key, shift).bitwiseAND((1 << BITS) - 1).alias("d"), "size").filter("t IS NOT NULL")
    counts: dict[int, list] = {}
    for r in seen.groupBy("t", "d").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():  # <= 4096 rows a splitter
        counts.setdefault(r["t"], []).append((r["d"], r["b"], r["n"]))
    return counts


def _value(digits: tuple) -> tuple[int, int]:
    """The known leading digits of k1 and of k2 as numbers."""
    a = b = 0
    for x in digits[:LEVELS]:
        a = a << BITS | x
    for x in digits[LEVELS:]:
        b = b << BITS | x
    return a, b


def _bound(digits: tuple) -> tuple[int, int]:
    """The lowest keys with these digits; a last digit of 4096 carries over."""
    a = b = 0
    for i in range(LEVELS):
        a = (a << BITS) + (digits[i] if i < len(digits) else 0)
        b = (b << BITS) + (digits[LEVELS + i] if LEVELS + i < len(digits) else 0)
    return a, b


def level_cuts(sized: DataFrame, n_shards: int, tolerance: float) -> dict[int, list[tuple[int, int]]]:
    """Boundaries between the shards for each size class, from the largest.

    ``sized`` has k1, k2, size and kind (the size class)."""
    digit = F.shiftright("k1", BITS * (LEVELS - 1)).cast("int")
    first: dict[int, list[tuple[int, int, int]]] = {}
    for r in sized.groupBy("kind", digit.alias("d")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():  # <= 4096 rows a class
        first.setdefault(r["kind"], []).append((r["d"], r["b"], r["n"]))
    slack = tolerance * sum(b for bins in first.values() for _, b, _ in bins) / n_shards
    loads, cuts = [0] * n_shards, {}
    rest = sum(b for bins in first.values() for _, b, _ in bins)
    for kind in sorted(first, reverse=True):
        total = sum(b for _, b, _ in first[kind])
        rest -= total
        shares = room(loads, total)
        targets = [sum(shares[:i]) for i in range(1, n_shards)]
        cuts[kind], below = splitters(sized.filter(F.col("kind") == kind), targets, slack, first[kind], rest / n_shards / 2)
        ends = [0, *below, total]
        loads = [x + b - a for x, a, b in zip(loads, ends, ends[1:], strict=False)]
    return cuts


def shard(rows: DataFrame, key: Column, tie: Column, size: Column, n_shards: int = 16, tolerance: float = 0.001) -> DataFrame:
    """``rows`` with the columns shard and slot, of near-equal bytes by shard.

    ``key`` groups rows that should lie together, ``tie`` orders within them.
    ``rows`` is read several times and should be a written table."""
    scratch = base.Scratch(rows.sparkSession, "shard")
    own = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    k1, k2, kind, row, pid, mid, p, shift = (base.fresh_name(rows, c) for c in ("_k1", "_k2", "_kind", "_row", "_pid", "_mid", "_p", "_shift"))
    keyed = rows.withColumns({k1: hash60(key), k2: hash60(tie), kind: size_class(size)}).select(*own, k1, k2, kind, size.cast("bigint").alias(row))
    sized = keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(kind).alias("kind"), F.col(row).alias("size"))
    number = F.lit(0)
    for c, cuts in level_cuts(sized, n_shards, tolerance).items():
        bounds = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in cuts])
        passed = F.size(F.filter(bounds, lambda s: (F.col(k1) > s.a) | ((F.col(k1) == s.a) & (F.col(k2) >= s.b)))) if cuts else F.lit(0)
        number = F.when(F.col(kind) == c, passed).otherwise(number)
    order = ["shard", F.desc(kind), k1, k2, row]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows that share every key (repeated ones) are told apart by where they were read, so that no range is indivisible
    dealt = keyed.select(*own, k1, k2, kind, F.monotonically_increasing_id().alias(row), number.cast("int").alias("shard"))
    dealt = dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = scratch.table(dealt.select(*own, "shard", F.spark_partition_id().alias(pid), F.monotonically_increasing_id().alias(mid)))
    held = dealt.groupBy("shard", pid).agg(F.min(mid).alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row per shard and partition
    offsets = base.small(scratch.table(held.select("shard", F.col(pid).alias(p), (before - F.col("first")).alias(shift))))
    return dealt.join(offsets.withColumnRenamed("shard", k1), (F.col("shard") == F.col(k1)) & (F.col(pid) == F.col(p))).select(*own, "shard", (F.col(mid) + F.col(shift)).alias("slot"))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 16) -> None:
    """Write ``docs`` as one folder per shard, ordered by slot inside files.

    Columns of ``docs`` called shard or slot are left out. A null text counts
    as empty; an empty table writes no shard."""
    size = F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long") + 1
    out = shard(docs, F.coalesce(docs[text_col], F.lit("")), docs[id_col], size, n_shards)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.read(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    meta = base.Scratch(spark, "shard").table(docs.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key")))
    out = shard(meta, F.col("key"), F.col("doc_id"), F.col("size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))
