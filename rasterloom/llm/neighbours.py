"""Operator 9, approximate nearest neighbours by shifted Hilbert curves.

Every distinct vector is projected at random to ``DIMS`` dimensions, shifted
and ordered along a Hilbert curve, ``CURVES`` times; a sample of ``FIT`` vectors
sets centre and scales. Spark range-partitions
each ordering; partition totals and prefix sums turn sort positions into
ranks, and runs of consecutive ranks form cells. On every curve a query visits
its own cell and the one to either side. Within a cell distances are exact
doubles on the original vectors, taken for those that a matrix product finds
near enough; the cells of all curves are merged and reranked.

A cell is a share of the rows (``WINDOW``, ``CELL`` vectors at least), as the
recall of a curve depends on it; isotropic data such as the test tables needs a
wide one. So a query has three visits a curve and k + 1 rows of each, whatever
the table's size: what is shuffled grows with the rows. Distances, which stay
inside the tasks, grow with their square. The queries of a cell come first in
its sorted rows and its vectors pass by ``POOL`` at a time, so a task holds the
queries and their best. Recall against brute force is tested to be at least 0.9.
Equal vectors are indexed once: a hot vector is one entry, and of its rows only
the k + 1 smallest ids can be answers.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do rows with a null id. Vectors of several lengths
are searched among their own. Repeated rows (same id and vector) count once; rows with one id
and several vectors are each a row of that id. With fewer than k other rows all
are returned. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import base

CURVES, DIMS, BITS, CELL, WINDOW = 20, 8, 7, 256, 0.0175
#: Vectors that are compared at once, and queries they are compared with.
POOL, ASKS = 4096, 512
#: Vectors that set the centre and scales of the projections.
FIT = 10_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (n, d), each coordinate below 2**bits."""
    x = cells.astype(np.int64)
    d = x.shape[1]
    for q in (1 << b for b in range(bits - 1, 0, -1)):  # undo the excess work of the transposed form
        p = q - 1
        for i in range(d):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(high, p, swap)
            x[:, i] ^= swap
    for i in range(1, d):  # Gray code
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip ^= np.where((x[:, d - 1] & q) != 0, q - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | ((x[:, i] >> b) & 1)
    return key


def curve(number: int, width: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The projection (width, dims) and shift (0..1 of the range) of a curve."""
    rng = np.random.default_rng([number, width])
    basis = np.linalg.qr(rng.normal(size=(width, width)))[0][:, :dims]
    return basis, rng.random(basis.shape[1])


def _matrix(column) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1)


def valid_rows(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    vec = F.col("vec")
    rows = table.select(table[id_col].alias("vec_id"), table[vec_col].cast("array<double>").alias("vec")).filter("vec_id IS NOT NULL AND vec IS NOT NULL")
    good = ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vec, lambda x: x != 0)
    return rows.filter(good)


def search(table: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10,
           curves: int = CURVES, dims: int = DIMS, bits: int = BITS, cell: int = CELL, window: float = WINDOW) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for every
    row whose id satisfies ``is_query`` (a function of the column vec_id), among
    the vectors of its length; lengths are searched one after the other."""
    scratch = base.Scratch(table.sparkSession, "ann")
    rows = scratch.table(valid_rows(table, id_col, vec_col))
    lengths = sorted(r[0] for r in rows.select(F.size("vec")).distinct().collect())  # a number per length
    out = None
    for n in lengths or [0]:
        found = _search(rows if len(lengths) < 2 else rows.filter(F.size("vec") == n), scratch, is_query, k, curves, dims, bits, cell, window)
        out = found if out is None else out.unionByName(found)
    return out


class _Best:
    """The ``k`` + 1 nearest vectors of a cell for the queries that visit it."""

    def __init__(self, k: int, most: int):
        self.k, self.most, self.asks, self.pool, self.held, self.best = k, most, [], [], 0, None

    def add(self, rows: pa.RecordBatch) -> None:
        """Rows curve, cell, asks, c, lead, vec: all queries before the first vector."""
        asks = rows.column(2)
        n = asks.true_count
        if n:
            self.asks.append(rows.slice(0, n))
        if self.asks and n < len(asks):
            self.pool.append(rows.slice(n))
            self.held += len(asks) - n
            if self.held >= self.most:
                self.compare()

    def compare(self) -> None:
        if not self.pool:
            return
        if self.best is None:
            own = pa.Table.from_batches(self.asks)
            self.q, self.vec = own["c"].to_numpy(), _matrix(own["vec"].combine_chunks())
            self.norm, self.kind = (self.vec * self.vec).sum(axis=1), own.schema.field("lead").type
            self.best = [(np.zeros(0), own["lead"].slice(0, 0).to_numpy(), np.zeros(0, np.int64))] * len(self.q)
            self.edge = np.full(len(self.q), np.inf)  # the square beyond which nothing is taken any more
        pool = pa.Table.from_batches(self.pool)
        self.pool, self.held = [], 0
        vec, c, lead = _matrix(pool["vec"].combine_chunks()), pool["c"].to_numpy(), pool["lead"].to_numpy()
        norm, k = (vec * vec).sum(axis=1), min(self.k, len(vec) - 1)
        for ask in np.array_split(np.arange(len(self.q)), -(-len(self.q) // ASKS)):
            # squares by one product pick those that can be nearest; their distances are then taken on the vectors
            square = self.norm[ask][:, None] + norm - 2 * (self.vec[ask] @ vec.T)
            edge = np.minimum(self.edge[ask], np.partition(square, k, axis=1)[:, k] if k == self.k else np.inf)
            near = square <= (edge + 1e-9 * (self.norm[ask] + norm.max()))[:, None]
            for q, row in zip(ask, near, strict=True):
                some = np.flatnonzero(row)
                if len(some):
                    d, of, who = self.best[q]
                    d = np.concatenate((d, np.sqrt(((vec[some] - self.vec[q]) ** 2).sum(axis=1))))
                    of, who = np.concatenate((of, lead[some])), np.concatenate((who, c[some]))
                    top = np.lexsort((who, of, d))[: self.k + 1]
                    self.best[q] = d[top], of[top], who[top]
                    if len(top) > self.k:
                        self.edge[q] = d[top[-1]] ** 2

    def rows(self):
        self.compare()
        if self.best:
            d, of, who = (np.concatenate(x) for x in zip(*self.best, strict=True))
            q = np.repeat(self.q, [len(b[0]) for b in self.best])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(who), pa.array(of, self.kind), pa.array(d)], names=["q", "c", "lead", "score"])


def _search(rows: DataFrame, scratch: base.Scratch, is_query, k: int, curves: int, dims: int, bits: int, cell: int, window: float) -> DataFrame:
    """``search`` over valid vectors of one length."""
    spark = rows.sparkSession
    vectors = scratch.table(rows.groupBy("vec").agg(F.min("vec_id").alias("lead")).select(F.monotonically_increasing_id().alias("c"), "lead", "vec"))
    first = vectors.select(F.size("vec")).first()
    if first is None:
        return spark.createDataFrame([], f"query_id {rows.schema['vec_id'].dataType.simpleString()}, rank int, vec_id {rows.schema['vec_id'].dataType.simpleString()}, score double")
    width = first[0]
    dims = min(dims, width)
    members = rows.join(vectors, "vec").select("c", "vec_id")
    top = Window.partitionBy("c").orderBy("vec_id")
    answers = scratch.table(members.distinct().withColumn("n", F.row_number().over(top)).filter(F.col("n") <= k + 1).drop("n"))
    queries = scratch.table(members.filter(is_query(F.col("vec_id"))).distinct())

    total = vectors.count()
    fit = np.array([r[0] for r in vectors.orderBy(F.xxhash64("c"), "c").limit(FIT).select("vec").collect()])  # at most FIT vectors
    mean = fit.mean(axis=0)
    made = []
    for i in range(curves):
        basis, shift = curve(i, width, dims)
        made.append((basis / ((fit - mean) @ basis).std(axis=0).clip(1e-300), shift))

    def order(batches):
        base.cached()
        for b in batches:
            v = _matrix(b.column(1)) - mean
            for i, (basis, shift) in enumerate(made):
                at = np.clip((v @ basis + 4 + shift) / 9 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(hilbert_keys(at, bits)), b.column(0)], names=["curve", "key", "c"])

    keyed = scratch.table(vectors.select("c", "vec").mapInArrow(order, "curve int, key long, c long"))

    def local(batches):
        from pyspark import TaskContext

        base.cached()
        pid, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            which = b.column(0).to_numpy()
            at = np.empty(len(which), np.int64)
            for i in np.unique(which):
                mine = which == i
                at[mine] = seen.get(i, 0) + np.arange(mine.sum())
                seen[i] = seen.get(i, 0) + int(mine.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.full(len(which), pid, np.int32)), pa.array(at)], names=["curve", "c", "pid", "at"])

    size = max(cell, int(np.ceil(window * total)))
    last, most = -(-total // size) - 1, POOL
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = scratch.table(keyed.repartitionByRange(parts, "curve", "key", "c").sortWithinPartitions("curve", "key", "c").mapInArrow(local, "curve int, c long, pid int, at long"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = base.small(scratch.table(placed.groupBy("curve", "pid").agg(F.count(F.lit(1)).alias("n")).select("curve", "pid", before.alias("base"))))
    cells = placed.join(offsets, ["curve", "pid"]).select("curve", "c", F.floor((F.col("base") + F.col("at")) / size).alias("cell"))

    asked = cells.join(base.small(scratch.table(queries.select("c").distinct())), "c", "left_semi")
    near = F.sequence(F.greatest(F.lit(0), F.col("cell") - 1), F.least(F.lit(last), F.col("cell") + 1))
    visits = asked.select("curve", "c", F.explode(near).alias("cell"))
    both = cells.withColumn("asks", F.lit(False)).unionByName(visits.withColumn("asks", F.lit(True))).join(vectors.select("c", "lead", "vec"), "c")

    id_type = rows.schema["vec_id"].dataType.simpleString()

    def nearest(batches):
        base.cached()
        at, found = None, None
        for b in batches:
            place = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1)
            cuts = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
            for first, end in zip([0, *cuts], [*cuts, len(place)], strict=True):
                if tuple(place[first]) != at:
                    if found:
                        yield from found.rows()
                    at, found = tuple(place[first]), _Best(k, most)
                found.add(b.slice(first, end - first))
        if found:
            yield from found.rows()

    # the queries of a cell come before its vectors
    dealt = both.select("curve", "cell", "asks", "c", "lead", "vec").repartition(parts, "curve", "cell").sortWithinPartitions("curve", "cell", F.desc("asks"), "c")
    hits = dealt.mapInArrow(nearest, f"q long, c long, lead {id_type}, score double")
    hits = scratch.table(hits.dropDuplicates(["q", "c"]))
    best = hits.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("score", "lead"))).filter(F.col("n") <= k + 1)
    pairs = queries.select(F.col("c").alias("q"), F.col("vec_id").alias("query_id")).join(best.select("q", "c", "score"), "q").join(answers, "c").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(base.read(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)
