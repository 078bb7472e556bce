"""Operator 10, substring dedup with a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words of one document. A word is removed
when a window that covers it has a word sequence that also starts earlier: in a
document of smaller id or earlier in the same one.

Fingerprints. Indexing every window would store ten times the text. A window's
anchor is its 10-gram of least hash, and a segment is a maximal run of windows
with one anchor: about one per six words. Equal windows have equal anchors, so

* an occurrence of a segment that isn't its first is removed as a whole;
* only where an anchor has several different segments their first occurrences
  are opened and compared window by window.

Verification. The anchor hash only brings rows together; a clash of it opens
more segments and changes nothing. What is removed is decided by the 128-bit
BLAKE2b digest of the very words (one space between them) of a segment or an
opened window, so the earlier and the later words are equal.

The index holds bucketed, sorted, immutable runs of segments (anchor hash,
digest, document, position). ``add`` takes the next batch, whose ids have to be
larger than all before: shuffled once to buckets of the anchor it is merge-joined
with the earlier runs, which lie in such buckets already, and written as a new
run; then it opens what shares an anchor and returns the word ranges to remove.
A segment is first in one run only, so ``FANOUT`` runs of one level are compacted
to one of the next by merging their buckets, without a shuffle. A manifest in
the index's folder names the runs: ``FingerprintIndex.open`` goes on in another
session. Earlier documents are read again (one column scan a batch), but only
words of those that share a newly met anchor are hashed.

Before the shuffle a task keeps the first occurrence of each segment it read
and turns the others into word ranges, so a hot passage sends one row per task.

Defined results: a null text has no words. Rows with a null id come first, then
by id; rows with one id (or none) are ordered by a hash of their text, and of
repeated rows (same id and text) the first keeps what a single one would and
the others lose every word that a window covers. An empty table gives an empty
result. Extra columns don't matter.
"""

from __future__ import annotations

import uuid
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import base, grams

#: The registered query adds BATCHES batches and compacts FANOUT runs of a level.
WINDOW, ANCHOR, FANOUT, BATCHES = 20, 10, 2, 3
CHUNK, FLUSH = 256, 1_000_000
SEGMENT = ("h", "g", "k")
COLUMNS = "h long, g long, k long, doc long, at long"
#: Rows of a run: segments met first here, later occurrences, ranges a task had found itself.
FIRST, AGAIN, LOCAL = 0, 1, 2


def plain_words(text: bytes | None) -> bytes:
    """The text's words with one space between them."""
    return b" ".join((text or b"").split())


def digests(bodies: list[bytes], text: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digests (n, 2) of the words [at, end) of the bodies numbered ``text`` (ascending)."""
    out = []
    bounds = np.searchsorted(text, np.arange(len(bodies) + 1))
    for i, (lo, hi) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
        if lo < hi:
            body = bodies[i]
            gap = np.flatnonzero(np.frombuffer(body, np.uint8) == 32)
            a = np.concatenate(([0], gap + 1))[at[lo:hi]].tolist()
            b = np.append(gap, len(body))[end[lo:hi] - 1].tolist()
            out += [blake2b(body[x:y], digest_size=16).digest() for x, y in zip(a, b, strict=True)]
    return np.frombuffer(b"".join(out), "<i8").reshape(-1, 2)


def segments(bodies: list[bytes], window: int = WINDOW, anchor: int = ANCHOR):
    """(text number, first window, number of windows, anchor hash, digest) of all segments, as arrays."""
    words, counts = grams.word_hashes(bodies)
    ends = np.cumsum(counts)
    width = window - anchor + 1
    text = np.repeat(np.arange(len(bodies)), counts)
    n = len(words) - window + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(grams.U), empty.reshape(0, 2)
    hashes = grams.gram_hashes(words, anchor)
    least = np.arange(n) + np.lib.stride_tricks.sliding_window_view(hashes, width)[:n].argmin(axis=1)
    whole = np.arange(n) + window <= ends[text[:n]]  # the window lies in one text
    new = np.concatenate(([True], (least[1:] != least[:-1]) | (text[1:n] != text[: n - 1]) | ~whole[:-1]))
    first = np.flatnonzero(new & whole)
    last = np.append(np.flatnonzero(new)[1:], n)
    last = last[np.searchsorted(last, first, "right")]
    # windows beyond the text's end follow its last whole one and start a new run only at the next text
    size = np.minimum(last, np.maximum(ends[text[first]] - window + 1, first + 1)) - first
    start = first - (ends - counts)[text[first]]
    return text[first], start, size, hashes[least[first]], digests(bodies, text[first], start, start + size + window - 1)


def merge_ranges(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [a, b) by document, overlapping and touching ones joined."""
    if len(doc) == 0:
        return doc, a, b
    order = np.lexsort((b, a, doc))
    doc, a, b = doc[order], a[order], b[order]
    rank = np.concatenate(([0], np.cumsum(doc[1:] != doc[:-1])))
    span = np.int64(b.max()) + 2
    reach = np.maximum.accumulate(rank * span + b)
    new = np.concatenate(([True], (rank[1:] * span + a[1:]) > reach[:-1]))
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(doc)) - 1
    return doc[start], a[start], reach[stop] - rank[stop] * span


def _batch(columns, names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list(names))


def _emit_segments(window: int, anchor: int):
    """mapInArrow: first occurrences of segments in the task, and the ranges of the others (g: end, no windows)."""

    def flush(parts):
        doc, start, size, h, g, k = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((start, doc, k, g))
        same = np.zeros(len(order), bool)
        same[1:] = (g[order][1:] == g[order][:-1]) & (k[order][1:] == k[order][:-1])
        keep, again = order[~same], order[same]
        yield h[keep].view(np.int64), g[keep], k[keep], doc[keep], start[keep] << 8 | size[keep]
        d, a, b = merge_ranges(doc[again], start[again], start[again] + size[again] + window - 1)
        yield grams.mix(d.astype(grams.U)).view(np.int64), b, np.zeros(len(d), np.int64), d, a << 8

    def run(batches):
        base.cached()
        parts, held = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                ids = part.column(0).to_numpy()
                text, start, size, h, g = segments([plain_words(t) for t in part.column(1).cast(pa.binary()).to_pylist()], window, anchor)
                parts.append((ids[text], start, size, h, g[:, 0], g[:, 1]))
                held += len(text)
                if held > FLUSH:
                    yield from (_batch(out, (*SEGMENT, "doc", "at")) for out in flush(parts))
                    parts, held = [], 0
        if held:
            yield from (_batch(out, (*SEGMENT, "doc", "at")) for out in flush(parts))

    return run


def _emit_windows(window: int):
    """mapInArrow over (doc, text, opened): the digest of every window of the opened segments."""

    def run(batches):
        base.cached()
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                bodies = [plain_words(t) for t in part.column(1).cast(pa.binary()).to_pylist()]
                opened = part.column(2)
                flat = np.asarray(opened.flatten(), np.int64)
                row = np.repeat(np.arange(part.num_rows), np.asarray(opened.value_lengths(), np.int64))
                size = flat & 255
                row = np.repeat(row, size)
                start = np.repeat(flat >> 8, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                found = digests(bodies, row, start, start + window)
                one, two = found[:, 0].copy(), found[:, 1]
                ids = part.column(0).to_numpy()[row]
                order = np.lexsort((start, ids, two, one))
                one, two, ids, start = one[order], two[order], ids[order], start[order]
                late = np.zeros(len(one), bool)
                late[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
                # later ones of these documents are known; they needn't meet under the window's key
                one[late] = grams.mix(ids[late].astype(grams.U) + start[late].astype(grams.U)).view(np.int64)
                yield _batch((one, two, ids, start, late), ("w1", "w2", "doc", "start", "late"))

    return run


def _join_ranges(batches):
    """mapInArrow over (doc, ranges): touching ranges joined."""
    for batch in batches:
        lists, flat = batch.column(1), batch.column(1).flatten()
        row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths(), np.int64))
        row, a, b = merge_ranges(row, np.asarray(flat.field(0), np.int64), np.asarray(flat.field(1), np.int64))
        ends = np.searchsorted(row, np.arange(len(lists) + 1)).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["a", "b"])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), spans)], names=["doc", "ranges"])


def bounded(df: DataFrame, arrays: str, rows: int = base.BROADCAST_ROWS) -> DataFrame:
    """``df`` for broadcast if its rows and array elements together are few enough."""
    n, m = df.agg(F.count(F.lit(1)), F.sum(F.size(arrays))).first()
    return F.broadcast(df) if n + (m or 0) <= rows else df


class FingerprintIndex:
    """Runs of segments of all documents added so far, in the folder ``root``.

    ``documents`` holds what was added: rows of (doc, text). The runs are
    catalog tables over that folder; ``open`` declares them again."""

    def __init__(self, spark: SparkSession, root: str, window: int = WINDOW, anchor: int = ANCHOR, fanout: int = FANOUT):
        if not 0 < anchor <= window <= 127:
            raise ValueError("needs 0 < anchor <= window <= 127")
        if fanout < 2:
            raise ValueError("needs a fanout of 2 at least")
        self.spark, self.root, self.window, self.anchor, self.fanout = base.ready(spark), root, window, anchor, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str]] = []  # (level, table), the earliest documents first
        self.documents: list[DataFrame] = []
        self.size, self.version, self.compactions = 0, 0, 0
        self.last: int | None = None  # the largest document so far

    @classmethod
    def open(cls, spark: SparkSession, root: str, documents: DataFrame) -> FingerprintIndex:
        """The index last saved in ``root``; ``documents`` are all (doc, text) it was given."""
        said = spark.read.schema(cls.MANIFEST).json(f"{root}/manifest/*").orderBy(F.desc("version")).first()
        index = cls(spark, root, said["window"], said["anchor"], said["fanout"])
        index.buckets, index.size, index.version, index.last = said["buckets"], said["size"], said["version"], said["last"]
        index.documents = [documents.select("doc", "text").filter(F.col("doc") <= said["last"])] if said["last"] is not None else []
        for level, name in (r.split(":") for r in said["runs"]):
            keys = ", ".join(SEGMENT)
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({COLUMNS}, kind int) USING parquet CLUSTERED BY (h) SORTED BY ({keys}) INTO {index.buckets} BUCKETS LOCATION '{index._path(name)}'")
            index.runs.append((int(level), name))
        return index

    MANIFEST = "version long, window int, anchor int, fanout int, buckets int, size long, last long, runs array<string>"

    def _save(self) -> None:
        """The manifest of the next version; the one before is left until then."""
        self.version += 1
        row = (self.version, self.window, self.anchor, self.fanout, self.buckets, self.size, self.last, [f"{level}:{name}" for level, name in self.runs])
        self.spark.createDataFrame([row], self.MANIFEST).coalesce(1).write.json(f"{self.root}/manifest/{self.version}")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _write(self, rows: DataFrame) -> str:
        """``rows``, whose tasks hold whole buckets, as a run."""
        name = f"run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "h").sortBy(*SEGMENT).format("parquet").option("path", self._path(name)).saveAsTable(name)
        return name

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        base.delete(self.spark, *map(self._path, names))

    def _firsts(self, name: str) -> DataFrame:
        """The segments a run is first to hold, each once; buckets stay as they are."""
        return self.spark.table(name).filter(F.col("kind") == FIRST).drop("kind")

    def _copartitioned(self):
        """Buckets by the anchor are enough for joins on anchor and digest."""
        return base.conf(self.spark, spark__sql__requireAllClusterKeysForCoPartition="false")

    def compact(self) -> None:
        """While the latest runs of one level are ``fanout``, they become one of
        the next: sorted runs with no segment in common, merged two at a time."""
        while len(self.runs) >= self.fanout and len({level for level, _ in self.runs[-self.fanout :]}) == 1:
            level, names = self.runs[-1][0], [name for _, name in self.runs[-self.fanout :]]
            merged, made = names[0], []
            for name in names[1:]:
                both = self._firsts(merged).withColumnsRenamed({"doc": "doc0", "at": "at0"}).join(self._firsts(name), list(SEGMENT), "full")
                with self._copartitioned():
                    merged = self._write(both.select(*SEGMENT, F.coalesce("doc0", "doc").alias("doc"), F.coalesce("at0", "at").alias("at"), F.lit(FIRST).alias("kind")))
                made.append(merged)
            self.runs[-self.fanout :] = [(level + 1, merged)]
            self.compactions += 1
            self._save()
            self._forget([*names, *made[:-1]])

    def add(self, docs: DataFrame) -> DataFrame:
        """doc, ranges (array of [from, to) word positions) to remove from ``docs``.

        ``docs`` has doc (long, not null, unique, above all before) and text;
        ids that aren't above those before raise ValueError."""
        n, low, top = docs.agg(F.count(F.lit(1)), F.min("doc"), F.max("doc")).first()
        if self.last is not None and low is not None and low <= self.last:
            raise ValueError(f"documents have to come in order: {low} after {self.last}")
        self.compact()
        with self._copartitioned():
            ranges = self._add(docs, n)
        self.documents.append(docs.select("doc", "text"))
        self.size, self.last = self.size + n, self.last if top is None else top
        self._save()
        base.sweep(self.spark)  # the files of this batch's shuffles
        return ranges

    def _add(self, docs: DataFrame, n: int) -> DataFrame:
        window, scratch = self.window, base.Scratch(self.spark, "passages")
        size, start = F.col("at").bitwiseAND(255), F.shiftright("at", 8)
        older = [self._firsts(r) for _, r in self.runs]

        # The new run: its segments are told apart from those of earlier runs by one bucketed merge join per run.
        rows = docs.mapInArrow(_emit_segments(window, self.anchor), COLUMNS).repartition(self.buckets, "h")
        rows, known = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*SEGMENT).orderBy("doc", "at"))), F.lit(False)
        for i, old in enumerate(older):
            rows, known = rows.join(old.select(*SEGMENT, F.lit(True).alias(f"old{i}")), list(SEGMENT), "left"), known | F.coalesce(f"old{i}", F.lit(False))
        kind = F.when(size == 0, LOCAL).when(known | (F.col("nth") > 1), AGAIN).otherwise(FIRST)
        name = self._write(rows.select(*SEGMENT, "doc", "at", kind.alias("kind")))
        batch, firsts = self.spark.table(name), self._firsts(name)
        again = batch.filter(F.col("kind") == AGAIN).select("doc", start.cast("int").alias("a"), (start + size + window - 1).cast("int").alias("b"))
        local = batch.filter(F.col("kind") == LOCAL).select("doc", start.cast("int").alias("a"), F.col("g").cast("int").alias("b"))

        # Anchors with a new segment and at least one other: their first occurrences are opened.
        shared = firsts.groupBy("h").agg(F.count(F.lit(1)).alias("all"))
        for i, old in enumerate(older):
            shared = shared.join(old.groupBy("h").agg(F.count(F.lit(1)).alias(f"n{i}")), "h", "left")
        shared = shared.filter(sum((F.coalesce(f"n{i}", F.lit(0)) for i in range(len(older))), F.col("all")) > 1).select("h")
        opened = firsts.join(shared, "h", "left_semi").select("doc", "at")
        for old in older:
            opened = opened.unionByName(old.join(shared, "h", "left_semi").select("doc", "at"))
        opened = scratch.table(opened.groupBy("doc").agg(F.collect_list("at").alias("opened")), rows=n + self.size, per_file=20_000)
        every = docs.select("doc", "text")
        for d in self.documents:
            every = every.unionByName(d)
        windows = every.join(bounded(opened, "opened"), "doc").select("doc", "text", "opened").mapInArrow(_emit_windows(window), "w1 long, w2 long, doc long, start long, late boolean")
        order = F.row_number().over(Window.partitionBy("w1", "w2", "late").orderBy("doc", "start"))
        # opened segments of earlier documents are there to be first; their own ranges are long returned
        late = windows.withColumn("nth", order).filter("late OR nth > 1").filter(F.lit(True) if self.last is None else F.col("doc") > self.last).select("doc", F.col("start").cast("int").alias("a"), (F.col("start") + window).cast("int").alias("b"))
        gone = again.unionByName(local).unionByName(late)
        ranges = scratch.table(gone.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("ranges")).mapInArrow(_join_ranges, "doc long, ranges array<struct<a:int,b:int>>"), rows=n, per_file=20_000)
        scratch.drop(opened)
        self.runs.append((0, name))
        return ranges

    def drop(self) -> None:
        """Delete the runs and the manifest."""
        self._forget([name for _, name in self.runs])
        base.delete(self.spark, self.root)
        self.runs = []


def _cut(window: int, id_type: str):
    """mapInArrow over (doc_id, text, copies, ranges): words kept, one row per copy."""

    def run(batches):
        base.cached()
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                at, n_words, n_gone, kept = [], [], [], []
                rows = zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)
                for i, (text, copies, ranges) in enumerate(rows):
                    words = (text or b"").split()
                    left, end = words, 0
                    if ranges:
                        left = []
                        for a, b in sorted((r["a"], r["b"]) for r in ranges):
                            left += words[end:a]
                            end = max(end, b)
                        left += words[end:]
                    at.append(i)
                    n_words.append(len(words))
                    n_gone.append(len(words) - len(left))
                    kept.append(b" ".join(left))
                    for _ in range(copies - 1):
                        rest = [] if len(words) >= window else words
                        at.append(i)
                        n_words.append(len(words))
                        n_gone.append(len(words) - len(rest))
                        kept.append(b" ".join(rest))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    return run


def _ordered(docs: DataFrame, scratch: base.Scratch) -> DataFrame:
    """doc_id, text, doc (the order as a unique long), copies."""
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    plain = docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    if plain and ids.filter("n > 1 OR doc_id IS NULL").limit(1).isEmpty():
        return docs.select("doc_id", "text", F.col("doc_id").cast("long").alias("doc"), F.lit(1).alias("copies"))
    # Ids don't order the rows by themselves: number the distinct rows by id and hash of the text.
    rows = docs.withColumn("th", F.xxhash64("text"))
    counted = scratch.table(rows.groupBy("doc_id", "th").agg(F.count(F.lit(1)).cast("int").alias("copies")))

    def local(batches):
        from pyspark import TaskContext

        pid, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            at = np.arange(seen, seen + b.num_rows)
            seen += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, pid, np.int32)), pa.array(at)], names=[*b.schema.names, "pid", "nr"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    placed = scratch.table(counted.repartitionByRange(parts, "doc_id", "th").sortWithinPartitions("doc_id", "th").mapInArrow(local, f"doc_id {id_type}, th long, copies int, pid int, nr long"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = base.small(scratch.table(placed.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).select("pid", before.alias("base"))))
    keys = placed.join(offsets, "pid").select(F.col("doc_id").alias("i"), F.col("th").alias("t"), "copies", (F.col("base") + F.col("nr")).alias("doc"))
    joined = rows.join(keys, rows.doc_id.eqNullSafe(keys.i) & (rows.th == keys.t)).select("doc_id", "text", "doc", "copies")
    return scratch.table(joined.dropDuplicates(["doc"]))


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, text (kept words joined by a space)."""
    spark = docs.sparkSession
    scratch = base.Scratch(spark, "passages")
    rows = _ordered(docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")), scratch)
    bounds = rows.select(F.percentile_approx("doc", [i / batches for i in range(1, batches)] or [0.5], 1000)).first()[0] or []
    edges = sorted(set(bounds)) if batches > 1 else []
    index, found = FingerprintIndex(spark, scratch.path(), window, anchor, fanout), None
    for lo, hi in zip([None, *edges], [*edges, None], strict=True):
        part = rows.select("doc", "text")
        part = part.filter(F.col("doc") > lo) if lo is not None else part
        part = part.filter(F.col("doc") <= hi) if hi is not None else part
        ranges = index.add(part)
        found = ranges if found is None else found.unionByName(ranges)
    index.drop()
    id_type = docs.schema[id_col].dataType.simpleString()
    joined = rows.join(bounded(found, "ranges"), "doc", "left").select("doc_id", "text", "copies", "ranges")
    return joined.mapInArrow(_cut(window, id_type), f"doc_id {id_type}, n_words long, n_removed long, text string")


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(base.read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
s AS (SELECT doc_id, pos, word, string_agg(word, ' ') OVER win AS seq, count(*) OVER win AS n FROM p WINDOW win AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
f AS (SELECT doc_id, pos, word, n = 20 AND row_number() OVER (PARTITION BY n = 20, seq ORDER BY doc_id, pos) > 1 AS late FROM s),
g AS (SELECT doc_id, pos, word, bool_or(late) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS kept FROM g GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN a USING (doc_id)
"""
