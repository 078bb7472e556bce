import math
import random

import numpy as np

from rasterloom.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, c long, vec string"


def brute(rows, k=10):
    good = {(i, tuple(np.float32(x) for x in v)) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, a in good:
        if q % 100 == 0:
            d = sorted((math.sqrt(sum((float(x) - float(y)) ** 2 for x, y in zip(a, b, strict=True))), i) for i, b in good if i != q)
            out[q] = d[:k]
    return out


def data(n, seed=1, width=16):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(width)], None, 5, "x") for i in range(n)]
    hot = [rng.gauss(0, 1) for _ in range(width)]
    for i in range(0, n, 3):
        rows[i] = (i, hot, 1, None, None)
    bad = [(n, None, 1, 1, ""), (n + 1, [0.0] * width, 1, 1, ""), (n + 2, [float("nan")] + [1.0] * (width - 1), 1, 1, ""), (n + 3, [None] + [1.0] * (width - 1), 1, 1, ""), (None, [1.0] * width, 1, 1, ""), rows[4]]
    return rows + bad


def test_small_is_exact(spark):
    rows = data(450)
    got = neighbours.search(spark.createDataFrame(rows, SCHEMA), lambda i: i % 100 == 0).collect()
    want = brute(rows)
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert by.keys() == want.keys()
    for q in want:
        assert [i for _, i in by[q]] == [i for _, i in want[q]] and np.allclose([d for d, _ in by[q]], [d for d, _ in want[q]], rtol=1e-12, atol=0)
    assert neighbours.search(spark.createDataFrame([], SCHEMA), lambda i: i % 100 == 0).count() == 0


def test_recall_with_many_cells(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(6000, 64)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, x.tolist(), 0, 0, "") for i, x in enumerate(v)], SCHEMA)
    got = neighbours.search(table, lambda i: i % 100 == 0, cell=128).collect()
    near = {}
    for r in got:
        near.setdefault(r.query_id, set()).add(r.vec_id)
    w = v.astype(np.float64)
    hits = 0
    for q in range(0, 6000, 100):
        d = ((w - w[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(near[q] & set(np.argsort(d)[:10].tolist()))
    assert hits / 600 >= 0.9


def test_hilbert_neighbours_touch():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    key = neighbours.hilbert_keys(grid, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_recall_of_stretched_vectors(spark):
    """Scales that differ by dimension, far from the origin; every distance is exact."""
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(3000, 12)) * np.geomspace(100, 0.1, 12) + 1000).astype(np.float32)
    table = spark.createDataFrame([(i, x.tolist(), 0, 0, "") for i, x in enumerate(v)], SCHEMA)
    got = neighbours.search(table, lambda i: i % 100 == 0, cell=64).collect()
    w, hits = v.astype(np.float64), 0
    for r in got:
        d = ((w - w[r.query_id]) ** 2).sum(axis=1)
        d[r.query_id] = np.inf
        assert math.isclose(r.score, math.sqrt(d[r.vec_id]), rel_tol=1e-12)
        hits += r.vec_id in np.argsort(d)[:10]
    assert len(got) == 300 and hits / 300 >= 0.9


def test_registered_query(spark, tmp_path):
    rows = data(450, seed=4)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = brute(rows)
    got = neighbours.op9_neighbours(spark, str(tmp_path)).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == {(q, n, i) for q, best in want.items() for n, (_, i) in enumerate(best, 1)}


def test_lengths_are_searched_apart(spark):
    rng = random.Random(17)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3 if i % 4 == 0 else 5)], None, None, None) for i in range(420)] + [(1000, [1.0], None, None, None), (1001, [], None, None, None)]
    got = {}
    for r in neighbours.search(spark.createDataFrame(rows, SCHEMA), lambda i: (i % 100 == 0) | (i == 101)).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    by = {i: [np.float32(x) for x in v] for i, v, *_ in rows if v}
    for q in (0, 100, 101, 200, 300, 400):
        want = sorted((math.dist(map(float, by[q]), map(float, v)), i) for i, v in by.items() if i != q and len(v) == len(by[q]))[:10]
        assert [got[q][k] for k in range(1, 11)] == [i for _, i in want]
    assert 1000 not in got


def test_rows_of_cells_grow_with_the_table(spark, monkeypatch):
    """Each query has three cells a curve with k + 1 rows each, whatever the table's size; vectors pass in parts."""
    kind = type(spark.range(1))
    made, kept = [], kind.dropDuplicates

    def counted(self, subset=None):
        if subset == ["q", "c"]:
            made.append(self.count())
        return kept(self, subset)

    monkeypatch.setattr(kind, "dropDuplicates", counted)
    got = []
    for n, pool in ((4000, 4096), (16000, 4096), (4000, 50)):
        v = np.random.default_rng(9).normal(size=(n, 8)).astype(np.float32)
        table = spark.createDataFrame([(i, x.tolist(), 0, 0, "") for i, x in enumerate(v)], SCHEMA)
        monkeypatch.setattr(neighbours, "POOL", pool)
        found = neighbours.search(table, lambda i: i % 100 == 0, cell=32, curves=3).collect()
        got.append({(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found})
    assert made[1] <= 4.4 * made[0] and made[2] == made[0] and got[2] == got[0]
    assert all(math.isclose(s, math.dist(map(float, v[q]), map(float, v[i])), rel_tol=1e-12) for (q, _), (i, s) in got[2].items())
