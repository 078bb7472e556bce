"""Operator 2, n-gram Jaccard join by prefix trees.

Documents with equal n-gram sets form a class; classes are joined at Jaccard
``PERCENT``/100 and more, and documents get the smallest id they are linked to.

1. Filter. In any fixed order of n-grams, two sets that link share one in their
   first n - ceil(0.75 n) + 1. With the order of the hashes, classes that share
   none of theirs can't link and leave.
2. Global order. Of the classes left, the document frequency of every n-gram is
   counted; sets are ordered by (frequency, hash), rarest first, and n-grams of
   one class are set aside: no overlap contains them. A class with too few
   shared n-grams leaves.
3. Classes that share an n-gram of their new prefixes are candidates. Connected
   candidates are brought together, at most about ``GROUP`` of them and ``GRAMS``
   n-grams in a task (about 200 MB; one class with more is alone).
4. Prefix-tree join. A task stores the ordered sets of a group in a trie, so
   equal beginnings are stored and compared once. A probe walks the trie with
   its overlap so far; a subtree is left when the overlap so far and the
   remaining lengths can't reach the least overlap any of its sets needs, or
   when all of it is already linked to the probe.
5. A larger candidate group is dealt out in blocks by the rarest n-gram of its
   sets, each block joined as above. Where that leaves several components, a
   class outside the largest one probes the other blocks that hold an n-gram of
   its prefix at a length that may link. This is exact: only classes already
   linked, or that can't link, are not compared.
6. Every link found is verified on the words of the n-grams of both texts. If a
   hash misled, all is done again under another seed.

N-grams travel as packed arrays of 64-bit hashes, sorted by bucket in the
task, so equal ones meet in one task per bucket with one record per class; a
bucket holds about ``BUCKET`` of them. N-grams of over ``HOT`` classes (which
can only be where there are so many) are found by counting first; they don't
travel to meet, but come last in the global order. The frequency filter uses 48
bits and can only keep too much. Classes are keyed by 128 bits per n-gram.

Defined results: null and white-space texts have an empty set and link with
nothing; texts of fewer words than n have one n-gram, the whole sequence.
Rows with a null id form links like others but never name a component unless
all its ids are null. Repeated rows fall in one class. An empty table gives an
empty result. Extra columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base, grams, graph

N, PERCENT, GROUP, GRAMS, CHUNK = 5, 75, 1500, 2_000_000, 256
#: N-grams in a bucket, classes that make an n-gram hot, n-grams a task counts at once.
BUCKET, HOT, COUNTED = 4_000_000, 1_000_000, 2_000_000
#: Times the hashes may mislead before it is an error.
SEEDS = 5


def least_shared(n: int, percent: int) -> int:
    """Fewest n-grams of a set of ``n`` that any partner has."""
    return -(-percent * n // 100)


def _texts(batch: pa.RecordBatch, k: int, step: int = CHUNK):
    base.cached()
    for a in range(0, batch.num_rows, step):
        part = batch.slice(a, step)
        yield part, [t or b"" for t in part.column(k).cast(pa.binary()).to_pylist()]


def _pack(buckets: np.ndarray, n_buckets: int, *columns: np.ndarray):
    """Records dealt to buckets: yields (bucket, each column's rows)."""
    order = np.argsort(buckets, kind="stable")
    ends = np.searchsorted(buckets[order], np.arange(n_buckets + 1))
    columns = [c[order] for c in columns]
    for b in np.flatnonzero(np.diff(ends)):
        yield int(b), [c[ends[b] : ends[b + 1]] for c in columns]


def _six(x: np.ndarray) -> np.ndarray:
    """The low 48 bits of each number as 6 bytes."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def _from_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


PACKED = "bucket int, tokens binary, which binary, cids binary"


def _gather(table: pa.Table, six: bool) -> tuple[np.ndarray, np.ndarray]:
    """All (token, cid) of a bucket, ordered by token."""
    tokens, cids = [], []
    for t, w, c in zip(table["tokens"].to_pylist(), table["which"].to_pylist(), table["cids"].to_pylist(), strict=True):
        tokens.append(_from_six(t) if six else np.frombuffer(t, "<u8"))
        cids.append(np.frombuffer(c, "<i8")[np.frombuffer(w, "<u2")])
    token, cid = np.concatenate(tokens), np.concatenate(cids)
    order = np.argsort(token, kind="stable")
    return token[order], cid[order]


def _runs(token: np.ndarray) -> np.ndarray:
    """For each record of ordered tokens how many records its token has."""
    first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    size = np.diff(np.append(first, len(token)))
    return np.repeat(size, size)


def classes_of(docs: DataFrame, n: int, scratch: base.Scratch, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, carrier, n_shingles, set_key, clash; classes with their carrier row)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def sets(batches):
        for batch in batches:
            for part, texts in _texts(batch, 2):
                size, keys, clash = [], [], []
                for a, b in grams.shingle_pairs(texts, n, seed):
                    size.append(len(a))
                    keys.append(hashlib.blake2b(a.tobytes() + b.tobytes(), digest_size=16).digest() if len(a) else None)
                    clash.append(bool((a[1:] == a[:-1]).any()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size, pa.int64()), pa.array(keys, pa.binary()), pa.array(clash, pa.bool_())], names=["doc_id", "carrier", "n_shingles", "set_key", "clash"])

    rows = scratch.table(docs.mapInArrow(sets, f"doc_id {id_type}, carrier long, n_shingles long, set_key binary, clash boolean"))
    carrier = F.min(F.struct("doc_id", "carrier", "copies")).alias("row")
    repeats = rows.filter("set_key IS NOT NULL").groupBy("set_key", "doc_id", "carrier").agg(F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n"))
    grouped = repeats.groupBy("set_key").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), carrier)
    named = grouped.select("set_key", "least", "n", "row.doc_id", "row.carrier", "row.copies", F.monotonically_increasing_id().alias("cid"))
    return rows, scratch.table(named, rows=rows.count())


def hot_grams(texts: DataFrame, n: int, seed: int, least: int, scratch: base.Scratch) -> np.ndarray:
    """The n-gram hashes that may have over ``least`` holders, at most about
    total / least. A task counts ``COUNTED`` n-grams at a time and reports those
    with a share of them that such an n-gram has somewhere."""

    def count(batches):
        held, size = [], 0

        def report():
            token, k = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(token[k > 1].view("<i8")), pa.array(k[k > 1])], names=["token", "k"])

        for batch in batches:
            for _, bodies in _texts(batch, 1):
                held += grams.shingle_sets(bodies, n, seed)
                size += sum(map(len, held[-len(bodies) :]))
                if size > COUNTED:
                    yield report()
                    held, size = [], 0
        if held:
            yield report()

    counted = texts.mapInArrow(count, "token long, k long").groupBy("token").agg(F.sum("k").alias("k"))
    # n-grams met once by a task at a time aren't reported; half the bound leaves room for them
    found = scratch.table(counted.filter(F.col("k") > least // 2).select("token"))
    return np.sort(np.array([r[0] for r in found.collect()], "<i8").view("<u8"))  # at most 2 n-grams / least rows


def join_classes(texts: DataFrame, n_classes: int, n: int, percent: int, scratch: base.Scratch, group: int = GROUP, seed: int = 0, n_grams: int = 0, hot: int = HOT, most: int = GRAMS) -> tuple[DataFrame, DataFrame]:
    """((node, label) of linked classes, the links); ``texts`` has cid and text."""
    spark = texts.sparkSession
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_grams // BUCKET))
    # an n-gram has one holder per class, so fewer classes have no hot one; the bound keeps the list small
    hot = max(hot, n_grams // 100_000)
    common = hot_grams(texts, n, seed, hot, scratch) if n_classes > hot else np.zeros(0, "<u8")
    shipped = spark.sparkContext.broadcast(common)  # at most 200,000 numbers

    def emit(prefix_only: bool):
        def run(batches):
            known = shipped.value
            for batch in batches:
                for part, bodies in _texts(batch, 1):
                    sets = list(grams.shingle_sets(bodies, n, seed))
                    if prefix_only:
                        sets = [s[: len(s) - least_shared(len(s), percent) + 1] for s in sets]
                    token = np.concatenate(sets)
                    which = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                    cids = np.asarray(part.column(0), "<i8")
                    bucket = (token % np.uint64(n_buckets)).astype(np.int64)
                    if len(known):  # hot n-grams go to buckets of their own, by class
                        isin = np.isin(token, known)
                        bucket[isin] = n_buckets + cids[which[isin]] % n_buckets
                    out = {"bucket": [], "tokens": [], "which": [], "cids": []}
                    for b, (t, w) in _pack(bucket, 2 * n_buckets, _six(token) if prefix_only else token.astype("<u8"), which):
                        used, place = np.unique(w, return_inverse=True)
                        for name, value in zip(out, (b, t.tobytes(), place.astype("<u2").tobytes(), cids[used].tobytes()), strict=True):
                            out[name].append(value)
                    yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), *[pa.array(out[c], pa.binary()) for c in ("tokens", "which", "cids")]], names=list(out))

        return run

    def sharing(table: pa.Table) -> pa.Table:
        token, cid = _gather(table, six=True)
        if table["bucket"][0].as_py() < n_buckets:
            cid = cid[_runs(token) > 1]
        return pa.table({"cid": np.unique(cid)})

    first = texts.mapInArrow(emit(True), PACKED).groupBy("bucket").applyInArrow(sharing, "cid long")
    active = scratch.table(first.distinct(), rows=n_classes, per_file=5_000)  # up to a row per class and bucket comes in

    def frequencies(table: pa.Table) -> pa.Table:
        token, cid = _gather(table, six=False)
        df = _runs(token) if table["bucket"][0].as_py() < n_buckets else np.full(len(token), 2**31 - 1)
        shared = df > 1
        token, cid, df = token[shared], cid[shared], df[shared]
        out = list(_pack((cid % n_buckets).astype(np.int32), n_buckets, token, df.astype("<i4"), cid.astype("<i8")))
        return pa.table({"chunk": pa.array([b for b, _ in out], pa.int32()), **{k: pa.array([x[i].tobytes() for _, x in out], pa.binary()) for i, k in enumerate(("tokens", "dfs", "cids"))}})

    def sizes(batches):
        for batch in batches:
            for part, bodies in _texts(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in grams.shingle_sets(bodies, n, seed)], pa.int32())], names=["cid", "n"])

    some = texts.join(base.small(active), "cid", "left_semi")
    counted = some.mapInArrow(emit(False), PACKED).groupBy("bucket").applyInArrow(frequencies, "chunk int, tokens binary, dfs binary, cids binary")
    lengths = some.mapInArrow(sizes, "cid long, n int").groupBy(F.pmod("cid", F.lit(n_buckets)).cast("int").alias("chunk")).agg(F.collect_list(F.struct("cid", "n")).alias("ns"))

    def order_sets(table: pa.Table) -> pa.Table:
        ns = {r["cid"]: r["n"] for x in table["ns"].to_pylist() if x for r in x}
        token, df, cid = (np.concatenate([np.frombuffer(b, t) for b in table[k].to_pylist() if b] or [np.zeros(0, t)]) for k, t in (("tokens", "<u8"), ("dfs", "<i4"), ("cids", "<i8")))
        order = np.lexsort((token, df, cid))
        token, cid = token[order], cid[order]
        first = np.flatnonzero(np.concatenate(([True], cid[1:] != cid[:-1]))) if len(cid) else np.zeros(0, int)
        out = {"cid": [], "n": [], "prefix": [], "tokens": []}
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(cid)], strict=True):
            c = int(cid[a])
            spare = b - a - least_shared(ns[c], percent)
            if spare >= 0:
                out["cid"].append(c)
                out["n"].append(ns[c])
                out["prefix"].append(token[a : a + spare + 1].view("<i8").tolist())
                out["tokens"].append(token[a:b].tobytes())
        return pa.table([pa.array(out["cid"], pa.int64()), pa.array(out["n"], pa.int32()), pa.array(out["prefix"], pa.list_(pa.int64())), pa.array(out["tokens"], pa.binary())], names=list(out))

    parts = counted.select("chunk", "tokens", "dfs", "cids", F.lit(None).cast("array<struct<cid:bigint,n:int>>").alias("ns"))
    ns = lengths.select("chunk", *[F.lit(None).cast("binary").alias(c) for c in ("tokens", "dfs", "cids")], "ns")
    sets = scratch.table(parts.unionByName(ns).groupBy("chunk").applyInArrow(order_sets, "cid long, n int, prefix array<long>, tokens binary"))

    held = sets.select("cid", F.explode("prefix").alias("token"))
    heads = held.groupBy("token").agg(F.min("cid").alias("head"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    near = held.join(heads, "token").select(F.col("cid").alias("u"), F.col("head").alias("v")).distinct()
    candidates = graph.components(near, scratch)

    lengths = sets.select("cid", (F.octet_length("tokens") / 8).cast("long").alias("size"))

    def groups_of(rows, per: int = 1):
        """Groups of at most ``per`` times ``group`` rows and of ``most`` n-grams that ``rows`` and the sum of ``size`` take."""
        return F.ceil(F.greatest(rows / (per * group), F.sum("size") / most))

    sized = candidates.join(lengths, candidates.node == lengths.cid).groupBy("label").agg(groups_of(F.count(F.lit(1))).alias("blocks"), F.sum("size").alias("size"))
    sized = scratch.table(sized, rows=n_classes)
    placed = candidates.join(sized.drop("size"), "label").select(F.col("node").alias("cid"), F.col("label").alias("comp"), (F.col("blocks") > 1).alias("large"), "blocks")
    placed = placed.join(sets, "cid").withColumn("rarest", F.col("prefix")[0]).withColumn("size", F.octet_length("tokens") / 8)
    bins = max(n_buckets, -(-2 * (sized.filter("blocks = 1").agg(F.sum("size")).first()[0] or 0) // most))
    small_bin = F.pmod(F.xxhash64("comp"), F.lit(bins)).cast("long")
    small_ones = placed.filter("NOT large").select("cid", "comp", "large", "n", "tokens", (-1 - small_bin).alias("bin"), F.lit(0).cast("long").alias("block"))
    # sets with one rarest n-gram lie together; many of them are dealt to blocks of their own
    family = placed.filter("large").groupBy("comp", "rarest").agg(groups_of(F.count(F.lit(1))).alias("parts"))
    block = F.when(F.col("parts") > 1, F.xxhash64("rarest", F.pmod(F.xxhash64("cid"), F.col("parts")))).otherwise(F.pmod(F.xxhash64("rarest"), F.col("blocks")))
    dealt = placed.filter("large").join(family, ["comp", "rarest"]).select("cid", "comp", "large", "n", "tokens", F.col("comp").alias("bin"), block.cast("long").alias("block"))
    members = scratch.table(small_ones.unionByName(dealt))
    links = members.withColumn("asks", F.lit(True)).withColumn("known", F.col("cid")).groupBy("bin", "block").applyInArrow(trie_links(percent), "u long, v long")
    links = scratch.table(links)
    if sized.filter("blocks > 1").isEmpty():
        return graph.components(links, scratch), links

    # The classes outside the largest component of their large group probe the other blocks they may link in.
    large = members.filter("large")
    linked = graph.components(links.unionByName(large.select(F.col("cid").alias("u"), F.col("cid").alias("v"))), scratch)
    large = scratch.table(large.join(linked.withColumnRenamed("node", "cid"), "cid", "left").withColumn("known", F.coalesce("label", "cid")).drop("label"))
    parts_of = large.groupBy("comp", "known").agg(F.count(F.lit(1)).alias("k"))
    largest = parts_of.groupBy("comp").agg(F.max(F.struct("k", "known")).alias("m")).select("comp", F.col("m.known").alias("main"))
    rest = large.join(largest, "comp").filter("known <> main").drop("main")
    heads = large.select("cid", "comp", "block", "n").join(sets.select("cid", "prefix"), "cid").select("cid", "comp", "block", "n", F.explode("prefix").alias("token"))
    places = heads.groupBy("comp", "token", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    asked = heads.join(rest.select("cid"), "cid", "left_semi").select("cid", "comp", "token", F.col("block").alias("own"), "n")
    fits = (F.col("block") != F.col("own")) & (100 * F.col("high") >= percent * F.col("n")) & (percent * F.col("low") <= 100 * F.col("n"))
    visits = scratch.table(asked.join(places, ["comp", "token"]).filter(fits).select("cid", "comp", "block").distinct())
    # a block with many visitors is held by several tasks
    shares = scratch.table(visits.join(lengths, "cid").groupBy("comp", "block").agg(groups_of(F.count(F.lit(1)), 4).alias("shares")))
    probes = visits.join(shares, ["comp", "block"]).withColumn("share", F.pmod(F.xxhash64("cid"), F.col("shares"))).join(rest.drop("comp", "block"), "cid").withColumn("asks", F.lit(True))
    stored = large.join(shares, ["comp", "block"]).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).withColumn("asks", F.lit(False))
    columns = ["bin", "block", "share", "comp", "cid", "n", "tokens", "known", "asks"]
    again = stored.select(columns).unionByName(probes.select(columns)).groupBy("bin", "block", "share").applyInArrow(trie_links(percent), "u long, v long")
    links = scratch.table(links.unionByName(again))
    return graph.components(links, scratch), links


def false_links(links: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The links whose texts' n-grams, compared as words, aren't similar enough."""

    def check(batches):
        base.cached()
        for batch in batches:
            bad = []
            for i, (a, b) in enumerate(zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist(), strict=True)):
                x, y = grams.exact_shingles(a, n), grams.exact_shingles(b, n)
                both = len(x & y)
                if 100 * both < percent * (len(x) + len(y) - both):
                    bad.append(i)
            yield batch.select([0, 1]).take(pa.array(bad, pa.int32()))

    first = links.join(texts.select(F.col("cid").alias("u"), F.col("text").alias("a")), "u")
    both = first.join(texts.select(F.col("cid").alias("v"), F.col("text").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(check, "u long, v long")


class Trie:
    """Ordered sets as paths of a tree; a node holds a run of tokens."""

    __slots__ = ("tokens", "children", "ends", "most", "least", "link")

    def __init__(self, tokens):
        self.tokens, self.children, self.ends = tokens, {}, []
        self.most, self.least = 0, 1 << 62  # longest rest below this node's run, smallest set size below
        self.link = None  # a set of this subtree if all its sets are linked

    def insert(self, tokens: np.ndarray, size: int, name: int) -> None:
        node = self
        while True:
            node.least = min(node.least, size)
            node.link = None
            if len(tokens) == 0:
                node.ends.append((name, size))
                return
            node.most = max(node.most, len(tokens))
            child = node.children.get(tokens[0])
            if child is None:
                leaf = node.children[tokens[0]] = Trie(tokens)
                leaf.least = size
                leaf.ends.append((name, size))
                return
            run = child.tokens
            m = min(len(run), len(tokens))
            differs = np.flatnonzero(run[:m] != tokens[:m])
            same = int(differs[0]) if len(differs) else m
            if same < len(run):  # split the run
                upper = Trie(run[:same])
                upper.most, upper.least = child.most + len(run) - same, child.least
                child.tokens = run[same:]
                upper.children[child.tokens[0]] = child
                node.children[tokens[0]] = upper
                child = upper
            node, tokens = child, tokens[same:]


def trie_links(percent: int):
    """Grouped function: links that connect all sets of a group that are linked.

    Rows: cid, comp, n, tokens, asks, known (a class the set is known to be
    linked to). Sets that ask are compared with all others of their comp."""

    def find(up: dict, a):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def probe(root: Trie, mark: np.ndarray, size: int, length: int, me, up: dict, links: list) -> None:
        def settle(node: Trie):
            """The subtree's link if all of it is linked."""
            if node.link is None or find(up, node.link) != node.link:
                names = [find(up, e[0]) for e in node.ends]
                names += [settle(c) for c in node.children.values()] if len(set(names)) <= 1 else [None]
                node.link = names[0] if None not in names and len(set(names)) == 1 else None
            return node.link

        stack = [(root, 0, length)]
        while stack:
            node, shared, left = stack.pop()
            if node.link is not None and find(up, node.link) == find(up, me):
                continue
            hit = int(mark[node.tokens].sum()) if len(node.tokens) else 0
            shared, left = shared + hit, left - hit
            # least overlap o with 100 o >= percent (size + other - o)
            if (100 + percent) * (shared + min(left, node.most)) < percent * (size + node.least):
                continue
            for name, other in node.ends:
                if (100 + percent) * shared >= percent * (size + other):
                    a, b = find(up, me), find(up, name)
                    if a != b:
                        up[max(a, b)] = min(a, b)
                        links.append((me, name))
            stack.extend((c, shared, left) for c in node.children.values())
        settle(root)

    def run(table: pa.Table) -> pa.Table:
        comp, cid, n = (table[k].to_numpy() for k in ("comp", "cid", "n"))
        asks, known = table["asks"].to_numpy(), table["known"].to_numpy()
        tokens = table["tokens"].combine_chunks()
        links: list = []
        order = np.argsort(comp, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(comp[order]) != 0)))
        for rows in np.split(order, starts[1:]):
            sets = [np.frombuffer(tokens[int(i)].as_buffer(), "<u8") for i in rows]
            every, local = np.unique(np.concatenate(sets), return_inverse=True)
            local = np.split(local, np.cumsum([len(s) for s in sets])[:-1])
            up = {}
            for i in rows:
                up[int(cid[i])] = up[int(known[i])] = int(known[i])
            root, stored, mark = Trie(local[0][:0]), set(), np.zeros(len(every), bool)
            # sets that don't ask first: then every asking set meets all others once
            for i, s in sorted(zip(rows.tolist(), local, strict=True), key=lambda x: bool(asks[x[0]])):
                me = int(cid[i])
                if asks[i]:
                    mark[s] = True
                    probe(root, mark, int(n[i]), len(s), me, up, links)
                    mark[s] = False
                if me not in stored:
                    stored.add(me)
                    root.insert(s, int(n[i]), me)
        return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})

    return run


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT, group: int = GROUP, hot: int = HOT, most: int = GRAMS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, carrier (hash of the text)."""
    scratch = base.Scratch(docs.sparkSession, "ngram")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    docs = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("carrier"), text.alias("text"))
    for seed in range(0, 2 * SEEDS, 2):
        rows, classes = classes_of(docs, n, scratch, seed)
        if classes.isEmpty():
            return rows.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "carrier")
        if not rows.filter("clash").isEmpty():
            continue
        which = base.small(classes.select(F.col("doc_id").alias("i"), F.col("carrier").alias("h"), "cid", "copies"))
        found = docs.join(which, docs.doc_id.eqNullSafe(which.i) & (docs.carrier == which.h))
        texts = found.select("cid", "text")
        if not classes.filter("copies > 1").isEmpty():  # of a repeated carrier row one text is kept
            texts = found.filter("copies = 1").select("cid", "text").unionByName(found.filter("copies > 1").select("cid", "text").dropDuplicates(["cid"]))
        linked, links = join_classes(texts, classes.count(), n, percent, scratch, group, seed, classes.agg(F.sum("n")).first()[0], hot, most)
        if false_links(links, texts, n, percent).isEmpty():
            break
    else:
        raise RuntimeError(f"n-gram hashes misled under {SEEDS} seeds")
    names = classes.join(linked.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = names.groupBy("label").agg(F.min("least").alias("component_id"))
    named = names.join(least, "label").select("set_key", "component_id")
    out = rows.join(named, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "carrier")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the rows of the smallest id of each component; rows with an
    empty set or without an id stay. Rows are told apart by id and text, so a
    row whose id names another text too is judged by its own text: of a
    component it stays only if its id is the component's."""
    scratch = base.Scratch(docs.sparkSession, "near")
    said = ngram_join(docs, id_col, text_col, n, percent).filter("n_shingles > 0 AND component_id IS NOT NULL AND doc_id <> component_id")
    i, h = base.fresh_name(docs, "_i"), base.fresh_name(docs, "_h")
    gone = base.small(scratch.table(said.select(F.col("doc_id").alias(i), F.col("carrier").alias(h)).distinct()))
    carrier = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(gone, (docs[id_col] == gone[i]) & (carrier == gone[h]), "left_anti")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(base.read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: Every pair that shares an n-gram, then paths over links: right for any table, quadratic for large ones.
OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS total, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
s AS (SELECT doc_id, pos, total, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS g FROM p),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM s WHERE pos = 1 OR pos <= total - 4),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY x, y),
l AS MATERIALIZED (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 75 * (a.n + b.n - o)),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.m, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) c ON c.x = d.doc_id
"""
