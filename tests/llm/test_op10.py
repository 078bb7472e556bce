import hashlib
import random
import re
from collections import Counter

import pytest
from data import SCHEMA, awkward, frame, words, write

from rasterloom.llm import passages


def brute(rows, window):
    order = {}
    out, seen = [], set()
    # rows of one id are ordered by a hash only the engine has; the tests' texts under one id are equal
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, order.setdefault(r[1], len(order)))):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone, mine = set(), set()
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen or k in mine:
                gone.update(range(s, s + window))
            mine.add(k)
        seen |= mine
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def corpus(seed, vocab=4):
    rng = random.Random(seed)
    passages_ = [words(rng, rng.randrange(18, 60), 500) for _ in range(8)]
    rows = []
    for i in range(150):
        parts = [words(rng, rng.randrange(0, 40), 500 if rng.random() < 0.7 else vocab) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages_).split()
            a = rng.randrange(len(p) // 2)
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edit"
            parts.insert(rng.randrange(4), " ".join(p[a:]))
        rows.append((i * 7 - 100, "\n".join(parts), None, None, None, None, None))
    rows += [(5000 + i, rows[i % 5][1], None, None, None, None, None) for i in range(40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,batches,fanout", [(1, 1, 4), (2, 2, 4), (3, 5, 2)])
def test_against_all_windows(spark, seed, batches, fanout):
    rows = corpus(seed)
    from pyspark.sql import functions as F

    got = passages.dedup_passages(frame(spark, rows), batches=batches, fanout=fanout).withColumn("sha", F.sha2("text", 256)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.sha) for r in got) == brute(rows, 20)


def test_nulls_and_repeated_rows(spark, tmp_path):
    rows = [r for r in awkward() if r[0] is not None or r[1] is None]
    got = passages.op10_passages(spark, write(spark, tmp_path, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows, 20)
    assert passages.dedup_passages(spark.createDataFrame([], SCHEMA)).count() == 0


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_that_defeat_polynomial_hashes(spark):
    """Two words of 1,024 letters that a polynomial modulo 2**64 can't tell apart, alone and as words."""
    one, two = thue_morse(1024), thue_morse(1024, "b", "a")
    rest = [f"w{i}" for i in range(20)]
    texts = [" ".join([*rest[:10], w, *rest[10:]]) for w in (one, two)]
    texts += [" ".join(thue_morse(64, x, y)) for x, y in (("c", "d"), ("d", "c"))]
    rows = [(i, t, None, None, None, None, None) for i, t in enumerate(texts)]
    from pyspark.sql import functions as F

    got = passages.dedup_passages(frame(spark, rows)).withColumn("sha", F.sha2("text", 256)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.sha) for r in got) == brute(rows, 20)


def test_index_is_opened_again(spark, tmp_path):
    """Batches into an index that is closed and opened between them; compaction by levels; files go."""
    import os

    rows = [r for r in corpus(5) if r[0] < 5000]
    rows.sort()
    table = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], "doc long, text string")
    root, removed = str(tmp_path / "index"), {}
    passages.FingerprintIndex(spark, root, fanout=2)._save()
    for lo in range(0, len(rows), 30):
        index = passages.FingerprintIndex.open(spark, root, table)
        for r in index.add(table.filter(f"doc >= {lo} AND doc < {lo + 30}")).collect():
            removed[r.doc] = {x for a, b in r.ranges for x in range(a, b)}
        spark.sql(f"DROP TABLE {index.runs[-1][1]}")  # the catalog forgets, the files stay
    levels = [level for level, _ in index.runs]
    assert levels == sorted(levels, reverse=True) and len(levels) <= 4 and max(levels) >= 1
    assert sum(x.startswith("run_") for x in os.listdir(root)) == len(index.runs)
    with pytest.raises(ValueError):
        index.add(table.filter("doc = 3"))
    want = Counter()
    for i, n, gone, _ in brute(rows, 20):
        want[(i, n, gone)] += 1
    assert Counter((r[0], len((r[1] or "").split()), len(removed.get(i, ()))) for i, r in enumerate(rows)) == want
    index.drop()
    assert not os.path.exists(root)


def test_registered_query_compacts(spark, tmp_path, monkeypatch):
    made, compact = [], passages.FingerprintIndex.compact

    def seen(self):
        compact(self)
        made.append(self.compactions)

    monkeypatch.setattr(passages.FingerprintIndex, "compact", seen)
    rows = corpus(6)
    got = passages.op10_passages(spark, write(spark, tmp_path, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows, 20)
    assert max(made) >= 1


def test_segments_cover_all_windows():
    rng = random.Random(1)
    texts = [words(rng, n, 5).encode() for n in (0, 3, 19, 20, 21, 60, 200)] + [b"a " * 49 + b"a"]
    text, start, size, _, _ = passages.segments(texts)
    for i, t in enumerate(texts):
        got = [s for a, n in zip(start[text == i], size[text == i]) for s in range(a, a + n)]
        assert got == list(range(len(t.split()) - 19))
