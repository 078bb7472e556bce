import random
import re
from collections import Counter
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from data import SCHEMA, awkward, frame, write
from pyspark.sql import functions as F

from rasterloom.llm import collocations as col
from rasterloom.llm import registry

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
        yield tuple(w for w in re.split("[ \t]+", piece) if w)


def plain(rows, most=3, least=10, top=2000, half=50):
    """rows of (lang, text) to result rows, with Python's whole numbers."""
    f, out = {}, []
    for lang, text in rows:
        c = f.setdefault("und" if lang is None else lang, Counter())
        for p in pieces(text):
            for m in range(1, most + 1):
                c.update(p[i : i + m] for i in range(len(p) - m + 1))
    for lang, c in f.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        cands = {k: a for k, a in c.items() if len(k) > 1 and a >= least}
        found = []
        for k, a in cands.items():
            if any(len(x) > len(k) and 100 * b >= half * a and any(x[i : i + len(k)] == k for i in range(len(x))) for x, b in cands.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (c[k[:j]] * c[k[j:]]), j, c[k[:j]], c[k[j:]]) for j in range(1, len(k)))
            found.append((-score, -a, " ".join(k).encode(), left, right))
        out += [(lang, r, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def texts(seed=4, n=150):
    """Few words, so phrases recur; punctuation, tabs, odd spaces, rare words."""
    rng = random.Random(seed)
    pool = ["the", "New", "york", "of", "a", "É", "x y", "漢", "in", "The", "\x1c", "rare"]
    out = []
    for i in range(n):
        words = [rng.choice(pool[:3] if rng.random() < 0.5 else pool) + rng.choice(["", "", "", ",", ".", "\n", "\t"]) for _ in range(rng.randrange(60))]
        if rng.random() < 0.1:
            words.append(f"only{i}")
        out.append((rng.choice(["en", "en", "de", None, "und", ""]), " ".join(words)))
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    return sorted(map(tuple, col.collocations(df, **options).collect()))


@pytest.mark.parametrize("options", [{}, {"shard": 50}, {"most": 4, "shard": 300}, {"most": 2, "least": 3}, {"most": 5, "least": 2, "half": 80, "top": 40}])
def test_against_plain(spark, options):
    rows = texts()
    want = plain(rows, **{k: v for k, v in options.items() if k != "shard"})
    assert len(want) > 20
    assert run(spark, rows, **options) == want


def test_registered(spark, tmp_path):
    rows = awkward(3) + [(900 + i, t, lang, None, None, None, None) for i, (lang, t) in enumerate(texts(8))]
    sf = write(spark, tmp_path, rows)
    got = sorted(map(tuple, registry.QUERIES["op12_collocations"](spark, sf).collect()))
    assert got == plain([(r[2], r[1]) for r in rows])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet/*.parquet')")
    sql = con.execute(registry.SQL["op12_collocations"])
    names = [d[0] for d in sql.description]
    at = [names.index(c) for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")]
    assert sorted(tuple(r[i] for i in at) for r in sql.fetchall()) == got


def test_empty_and_clashing(spark):
    assert col.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert col.collocations(frame(spark, [(1, None, None, None, None, None, None), (2, " \n. ", "en", None, None, None, None)])).count() == 0
    odd = spark.createDataFrame([(i, "b c", "n", 7, 8) for i in range(10)], "id long, text string, lang string, n int, shard int")
    assert [tuple(r) for r in col.collocations(odd).collect()] == [("n", 1, "b c", 10, 10, 10, 20, 1_000_000)]


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 5, 7])
def test_suffix_array(depth):
    rng = np.random.default_rng(depth)
    for _ in range(30):
        ids = rng.integers(0, 4, rng.integers(1, 80)) * 1_000_003
        starts = np.append(rng.random(len(ids)) < 0.8, np.zeros(depth, bool))[: len(ids)]
        starts[max(0, len(ids) - depth + 1) :] = False
        order, first, n = col.phrase_intervals(ids, col.room_for(starts, depth), depth)
        places = [i for i in range(len(ids)) if starts[i]]
        key = {i: tuple(ids[i : i + depth]) for i in places}
        assert [key[i] for i in order.tolist()] == sorted(key.values())
        assert {key[order[a]]: k for a, k in zip(first.tolist(), n.tolist(), strict=True)} == Counter(key.values())


def test_prefixes():
    ids = np.array([1, 2, 1, 2, 3, 1, 2, 3])
    order = col.suffix_array(ids, np.array([3, 3, 3, 3, 3, 3, 2, 1]), 3)
    assert order.tolist() == [0, 2, 5, 1, 3, 4]
    assert col.common_prefixes(ids, order, 3).tolist() == [0, 2, 3, 0, 1, 0]


def test_large_counts_are_exact(spark):
    cases = [(10**12, 10**12 + 7, 10**12 + 1), (999_999_999_999, 10**12, 10**12), (3_037_000_500, 3_037_000_501, 9 * 10**18 // 4)]
    df = spark.createDataFrame(cases, "a long, l long, r long").select("a", "l", "r", *col._score(F.col("a"), F.col("l"), F.col("r"), F.lit(1))[:1])
    assert [r.score for r in df.collect()] == [10**6 * a * a // (x * y) for a, x, y in cases]
    assert Decimal(10**6) * cases[0][0] ** 2 > 2**64
