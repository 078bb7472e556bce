"""Operator 12, phrase collocation mining over suffix arrays.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and
pieces into words. Per language a phrase of 2 to ``most`` words that occurs
``least`` times or more is a candidate; cutting it after its first k words gives
the score floor(10**6 a a / (l r)) of its count a against those of the parts, and
the lowest-scoring cut (ties: smallest k) counts. A candidate that lies in a
longer one with at least half its count is dropped; the best ``top`` stay.

1. Shards. A task codes its documents in shards of about ``SHARD`` words: a list
   of the distinct words with their counts, and one code per word, 0 between
   pieces. Counts of words are merged by language and word; words of ``least``
   and more occurrences get global ids, and each shard learns those of its own.
   Rarer words end a piece, as no candidate holds them.
2. Suffix arrays. For phrases of m words a shard sorts its suffixes by their
   first m words by prefix doubling over word ids in numpy (ranks by 1, 2, 4, ..
   words, then by m), takes the common prefix of neighbours, and the intervals
   where it has m words are its distinct phrases with their counts.
3. Merge. A phrase is keyed by the ids of its first and its last m - 1 words,
   phrases or single words themselves. All shards' counts of a key meet in one
   place; phrases that reach ``least`` get ids and go back to the shards they
   occur in, where a longer suffix is followed only across frequent phrases: no
   longer phrase can reach ``least`` otherwise. Nothing is approximated by this.
4. Scores. The counts of a candidate's beginnings and ends come with its key.
   Products are decimals of 38 digits: exact for counts up to 10**15.

Sizes: a shard is at most ``SHARD`` words and its last piece (pieces aren't
split, and a worker holds the text anyway). A key has at most one row per
shard, so the most frequent phrase costs one task a row per shard, which sorts
and spills. Words and phrases are joined by shuffles unless counted small.

Defined results: null and empty texts have no words, a null language is
``und``. Null and repeated ids don't matter: rows are counted one by one. Equal
scores are ordered by count, then phrase, bytewise. An empty table gives an
empty result. Extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import base

MOST, LEAST, TOP, HALF, SHARD = 3, 10, 2000, 50, 1 << 18
#: Upper case to lower, every mark that ends a piece to a full stop, tabs to spaces.
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
PLAIN = bytes.maketrans(UPPER + b",;:!?\n\x0b\x0c\r\t", LOWER + b"." * 9 + b" ")
CODED = "shard long, codes binary, words array<struct<lang:string,word:string,n:bigint>>"
WORD = pa.struct([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


class Codes(dict):
    """Word to code within a shard, by order of appearance; code 0 ends a piece."""

    def __init__(self, lang: str, known: list):
        super().__init__({b".": 0})
        self.lang, self.known = lang, known

    def __missing__(self, word: bytes) -> int:
        self.known.append((self.lang, word))
        self[word] = code = len(self.known)
        return code


class Shard:
    def __init__(self):
        self.known: list[tuple[str, bytes]] = []
        self.langs: dict[str, Codes] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, words: list[bytes]) -> None:
        codes = self.langs.get(lang)
        if codes is None:
            codes = self.langs[lang] = Codes(lang, self.known)
        self.parts.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def batch(self, name: int) -> pa.RecordBatch:
        codes = np.concatenate(self.parts)
        n = np.bincount(codes, minlength=len(self.known) + 1)[1:]
        words = pa.StructArray.from_arrays([pa.array([x for x, _ in self.known], pa.string()), pa.array([w for _, w in self.known], pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], fields=list(WORD))
        ends = pa.array([0, len(n)], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([codes.tobytes()], pa.binary()), pa.ListArray.from_arrays(ends, words)], names=["shard", "codes", "words"])


def code_shards(size: int):
    def run(batches):
        from pyspark import TaskContext

        base.cached()
        first, shard = TaskContext.get().partitionId() << 32, Shard()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                words = (text.as_py() or b"").translate(PLAIN).replace(b".", b" . ").split()
                for a, b in cuts(words, size):
                    shard.add(lang, words[a:b])
                    shard.parts.append(np.zeros(1, np.int32))
                    if shard.size >= size:
                        yield shard.batch(first)
                        first, shard = first + 1, Shard()
        if shard.size:
            yield shard.batch(first)

    return run


def cuts(words: list[bytes], size: int):
    """Ranges of ``words`` of about ``size``, cut between pieces."""
    a = 0
    while a < len(words):
        b = a + size
        if b >= len(words):
            b = len(words)
        else:
            try:
                b = words.index(b".", b)
            except ValueError:
                b = len(words)
        yield a, b
        a = b


def room_for(starts: np.ndarray, m: int) -> np.ndarray:
    """Words to be read from each place, where m are from ``starts``."""
    room = np.where(starts, m, 0)
    for k in range(1, m):
        room[k:] = np.maximum(room[k:], np.where(starts[:-k], m - k, 0))
    return room


def suffix_array(ids: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """Places with ``room`` for ``depth`` words, in order of the words from there.

    Prefix doubling: ranks by h words and of the places h further on give ranks
    by 2 h words; the last step overlaps where ``depth`` is no power of two."""
    rank = np.zeros(len(ids), np.int64)
    at = np.flatnonzero(room >= 1)
    rank[at] = np.unique(ids[at], return_inverse=True)[1] + 1
    h = 1
    while h < depth:
        step = min(h, depth - h)
        at = np.flatnonzero(room >= h + step)
        key = rank[at] * (len(ids) + 2) + rank[at + step]
        rank[:] = 0
        rank[at] = np.unique(key, return_inverse=True)[1] + 1
        h += step
    places = np.flatnonzero(room >= depth)
    return places[np.argsort(rank[places], kind="stable")]


def common_prefixes(ids: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Words that each suffix of ``order`` has in common with the one before, up to ``depth``."""
    out, same = np.zeros(len(order), np.int64), np.ones(max(len(order) - 1, 0), bool)
    for k in range(depth):
        same &= ids[order[1:] + k] == ids[order[:-1] + k]
        out[1:] += same
    return out


def phrase_intervals(ids: np.ndarray, room: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes with m words in order, the start of each interval with a common prefix of m, its length."""
    order = suffix_array(ids, room, m)
    starts = np.flatnonzero(common_prefixes(ids, order, m) < m)
    return order, starts, np.diff(np.append(starts, len(order)))


def phrases_of(name: int, ids: np.ndarray, gram: np.ndarray, m: int):
    """Batches (shard, head, tail, n) of a shard's phrases of m words, by the ids
    of their first and last m - 1. ``ids``: the words; ``gram``: ids of the m - 1
    words from each place, -1 where they aren't frequent."""
    # a phrase of m words starts where two frequent ones of m - 1 start in a row
    begins = np.zeros(len(ids), bool)
    begins[:-1] = (gram[:-1] >= 0) & (gram[1:] >= 0)
    order, starts, n = phrase_intervals(ids, room_for(begins, m), m)
    for a in range(0, len(starts), 1 << 16):
        at, some = order[starts[a : a + (1 << 16)]], n[a : a + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), name)), pa.array(gram[at]), pa.array(gram[at + 1]), pa.array(some)], names=["shard", "head", "tail", "n"])


def named_words(codes: bytes, found: pa.StructArray) -> np.ndarray:
    """The ids of a shard's words, -1 between pieces and for rare ones; ``found``: place and id of the frequent."""
    codes, (place, ids) = np.frombuffer(codes, np.int32), (np.asarray(x) for x in found.flatten())
    table = np.full(max(int(codes.max(initial=0)), int(place.max(initial=0))) + 1, -1, np.int64)
    table[place] = ids
    words = table[codes]
    near = np.concatenate(([-1], words, [-1])) >= 0
    return words[near[1:-1] | near[:-2]]  # one end of piece is enough


def named_phrases(gram: np.ndarray, found: pa.StructArray) -> np.ndarray:
    """Ids of the phrases of one word more from each place; ``found``: head, tail and id of the frequent."""
    head, tail, ids = (np.asarray(x) for x in found.flatten())
    # pairs as one number: places of their parts among the parts that occur
    parts = np.unique(np.concatenate((head, tail)))
    key = np.searchsorted(parts, head) * len(parts) + np.searchsorted(parts, tail)
    order = np.argsort(key)
    key, ids = key[order], ids[order]
    met, which = np.unique(gram, return_inverse=True)
    at = np.minimum(np.searchsorted(parts, met), len(parts) - 1)
    at = np.where(parts[at] == met, at, -1)[which]
    both = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
    pair, back = np.unique(at[both] * len(parts) + at[both + 1], return_inverse=True)
    slot = np.minimum(np.searchsorted(key, pair), len(key) - 1)
    longer = np.full(len(gram), -1, np.int64)
    longer[both] = np.where(key[slot] == pair, ids[slot], -1)[back]
    return longer


def _shards(batches):
    base.cached()
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.column(0)[k].as_py(), [x[k] for x in batch.columns[1:]]


def _stream(name: int, words: np.ndarray, gram: np.ndarray | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([words.tobytes()], pa.binary()), pa.array([None if gram is None else gram.tobytes()], pa.binary())], names=["shard", "words", "grams"])


def _read(words, grams) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(words.as_py(), np.int64)
    return ids, np.frombuffer(grams.as_py(), np.int64) if grams.is_valid else ids


def name_words(batches):
    """(shard, codes, ids of its frequent words) to (shard, words, grams)."""
    for name, (codes, found) in _shards(batches):
        yield _stream(name, named_words(codes.as_py(), found.values), None)


def name_phrases(batches):
    """(shard, words, grams, frequent phrases) to (shard, words, grams of one word more)."""
    for name, (words, grams, found) in _shards(batches):
        ids, gram = _read(words, grams)
        yield _stream(name, ids, named_phrases(gram, found.values))


def count_phrases(m: int, named: bool):
    """(shard, words, grams) to its phrases of m words; unless ``named``, grams are those
    of m - 2 words, and a fourth column has the frequent ones of m - 1."""

    def run(batches):
        for name, (words, grams, *found) in _shards(batches):
            ids, gram = _read(words, grams)
            yield from phrases_of(name, ids, gram if named else named_phrases(gram, found[0].values), m)

    return run


STREAMS = "shard long, words binary, grams binary"


def with_ids(rows: DataFrame, scratch: base.Scratch) -> DataFrame:
    """``rows`` written with a column ``id``, from 0 without gaps."""
    placed = scratch.table(rows.withColumn("_at", F.monotonically_increasing_id()))
    named = placed.withColumn("_part", F.shiftright("_at", 33))
    totals = named.groupBy("_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = scratch.table(totals.select("_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_start")))
    return named.join(base.small(starts), "_part").withColumn("id", F.col("_at") + F.col("_start")).drop("_at", "_part", "_start")


def phrase_counts(docs: DataFrame, scratch: base.Scratch, lang_col: str = "lang", text_col: str = "text", most: int = MOST, least: int = LEAST, shard: int = SHARD) -> tuple[DataFrame, list[DataFrame]]:
    """(words of each language: lang, total; for m = 1 .. most the frequent phrases).

    A phrase has id, lang, phrase (array), n, head and tail (ids of its first and
    last m - 1 words), heads and tails (counts of its first and last 1 .. m words)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].cast("string").alias("text"))
    with base.conf(spark, spark__sql__parquet__columnarReaderBatchSize="16"):  # a row is megabytes
        coded = scratch.table(texts.mapInArrow(code_shards(shard), CODED))
        listed = coded.select("shard", F.posexplode("words").alias("place", "w")).select("shard", (F.col("place") + 1).alias("place"), "w.lang", "w.word", "w.n")
        merged = scratch.table(listed.groupBy("lang", "word").agg(F.sum("n").alias("n")))
        totals = scratch.table(merged.groupBy("lang").agg(F.sum("n").alias("total")))
        words = scratch.table(with_ids(merged.filter(F.col("n") >= least), scratch))
        scratch.drop(merged)
        own = listed.join(base.small(words.select("lang", "word", "id")), ["lang", "word"]).groupBy("shard").agg(F.collect_list(F.struct("place", "id")).alias("ids"))  # at most a shard's words
        stream = scratch.table(coded.select("shard", "codes").join(own, "shard").mapInArrow(name_words, STREAMS))
        scratch.drop(coded)
        base.sweep(spark)
        one = words.select("id", "lang", F.array("word").alias("phrase"), "n", F.lit(None).cast("long").alias("head"), F.lit(None).cast("long").alias("tail"), F.array("n").alias("heads"), F.array("n").alias("tails"))
        levels = [one]
        read, named = stream, True
        for m in range(2, most + 1):
            found = read.mapInArrow(count_phrases(m, named), "shard long, head long, tail long, n long")
            if m == most:
                frequent = found.groupBy("head", "tail").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
                level = scratch.table(frequent.withColumn("id", F.lit(None).cast("long")))
            else:
                of_key = Window.partitionBy("head", "tail")
                there = scratch.table(found.withColumn("total", F.sum("n").over(of_key)).filter(F.col("total") >= least).select("shard", "head", "tail", F.col("total").alias("n")))
                base.sweep(spark)
                level = scratch.table(with_ids(there.groupBy("head", "tail").agg(F.first("n").alias("n")), scratch))
                own = there.join(base.small(level.select("head", "tail", "id")), ["head", "tail"]).groupBy("shard").agg(F.collect_list(F.struct("head", "tail", "id")).alias("ids"))
                read, named = stream.join(own, "shard"), False  # named and counted in one pass
                if m + 1 < most:
                    stream = read = scratch.table(read.mapInArrow(name_phrases, STREAMS))
                    named = True
                    base.sweep(spark)
            first = base.small(levels[-1].select(F.col("id").alias("head"), "lang", F.col("phrase").alias("p"), F.col("heads").alias("h")))
            last = base.small(levels[-1].select(F.col("id").alias("tail"), F.col("phrase").alias("q"), F.col("tails").alias("t")))
            joined = level.join(first, "head").join(last, "tail")
            phrase = F.concat("p", F.slice("q", -1, 1))
            levels.append(scratch.table(joined.select("id", "lang", phrase.alias("phrase"), "n", "head", "tail", F.concat("h", F.array("n")).alias("heads"), F.concat("t", F.array("n")).alias("tails"))))
    return totals, levels


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = MOST, least: int = LEAST, top: int = TOP, half: int = HALF, shard: int = SHARD,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    if most < 2:
        raise ValueError("phrases have two words and more")
    spark = docs.sparkSession
    scratch = base.Scratch(spark, "phrases")
    totals, levels = phrase_counts(docs, scratch, lang_col, text_col, most, least, shard)
    kept = []
    for m in range(2, most + 1):
        level = levels[m - 1]
        if m < most:
            longer = levels[m]
            # where a phrase lies in any longer one, it lies in one of a single word more that is at least as frequent
            around = longer.select(F.col("head").alias("id"), "n").unionByName(longer.select(F.col("tail").alias("id"), "n")).groupBy("id").agg(F.max("n").alias("around"))
            level = level.join(base.small(scratch.table(around)), "id", "left").filter(F.col("around").isNull() | (100 * F.col("around") < half * F.col("n")))
        cut = F.array(*[F.struct(*_score(F.col("n"), F.element_at("heads", k), F.element_at("tails", m - k), F.lit(k))) for k in range(1, m)])
        kept.append(level.select("lang", F.array_join("phrase", " ").alias("phrase"), F.col("n").alias("a"), F.array_min(cut).alias("cut")))
    every = kept[0]
    for more in kept[1:]:
        every = every.unionByName(more)
    every = every.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    # each task keeps its best before they meet
    with base.conf(spark, spark__sql__optimizer__windowGroupLimitThreshold=str(max(top, 1000))):
        ranked = scratch.table(every.withColumn("rank", best.cast("long")).filter(F.col("rank") <= top))
    return ranked.join(base.small(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def _score(a, left, right, k):
    """The score of a cut first, so the least struct is the least score, then the smallest k."""
    a, parts = a.cast("decimal(19,0)"), (left.cast("decimal(19,0)") * right.cast("decimal(19,0)")).cast("decimal(38,0)")
    over = (a * a).cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", over.cast("decimal(38,0)"), parts).alias("score"), k.alias("k"), left.alias("l"), right.alias("r")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(base.read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
q AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(t, '[^\x20\x09]+') AS ws FROM p),
u AS (SELECT lang, piece, unnest(ws) AS w1, generate_subscripts(ws, 1) AS pos FROM q),
t AS MATERIALIZED (SELECT lang, w1, lead(w1) OVER x AS w2, lead(w1, 2) OVER x AS w3 FROM u WINDOW x AS (PARTITION BY piece ORDER BY pos)),
g AS MATERIALIZED (
  SELECT lang, 1 AS m, w1 AS phrase, count(*)::HUGEINT AS f FROM t GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM t WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM t WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE m > 1),
s AS (
  SELECT c.lang, c.m, c.phrase, a, k, x.f AS l, y.f AS r, (1000000 * a * a) // (x.f * y.f) AS score
  FROM c, (VALUES (1), (2)) v(k), g x, g y
  WHERE k < c.m AND x.lang = c.lang AND y.lang = c.lang AND x.phrase = array_to_string(ws[1 : k], ' ') AND y.phrase = array_to_string(ws[k + 1 : c.m], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT lang, array_to_string(ws[j : j + 1], ' ') AS phrase, max(a) AS f FROM c, (VALUES (1), (2)) v(j) WHERE m = 3 GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN d ON b.m = 2 AND b.lang = d.lang AND b.phrase = d.phrase WHERE d.f IS NULL OR 100 * d.f < 50 * a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""
