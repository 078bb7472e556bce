import random
import re
import uuid
from collections import Counter

import pytest
from data import SCHEMA, awkward, frame, words

from rasterloom.llm import grams, graph, ngram_join
from rasterloom.llm.base import Scratch


def shingles(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows))


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def corpus(seed):
    rng = random.Random(seed)
    texts = [words(rng, rng.randrange(1, 60), 30) for _ in range(60)]
    for _ in range(6):
        texts += family(rng, words(rng, rng.randrange(20, 90)), 12, 7)
    boiler = words(rng, 30)
    texts += [boiler + " " + words(rng, rng.randrange(5, 60)) for _ in range(60)]
    rows = [(i, t, None, None, None, None, None) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(1000 + (r[0] or 0), *r[1:]) if r[0] is not None else r for r in awkward(seed)]


@pytest.mark.parametrize("seed,group", [(1, 1500), (2, 7), (3, 3)])
def test_against_all_pairs(spark, seed, group):
    rows = corpus(seed)
    got = ngram_join.ngram_join(frame(spark, rows), group=group).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_edges(spark):
    assert ngram_join.ngram_join(spark.createDataFrame([], SCHEMA)).count() == 0
    only = [(1, None, None, None, None, None, None), (2, "", None, None, None, None, None)]
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(frame(spark, only)).collect()} == {(1, 0, 1), (2, 0, 2)}


def test_drop_near_copies(spark):
    rng = random.Random(9)
    rows = [(10 + i, t, None, None, None, None, None) for i, t in enumerate(family(rng, words(rng, 100), 5, 3))] + [(99, "alone here", None, None, None, None, None), (100, "", None, None, None, None, None)]
    left = ngram_join.drop_near_copies(frame(spark, rows))
    assert sorted(r.doc_id for r in left.collect()) == [10, 99, 100]


def test_rows_of_one_id_are_judged_by_their_text(spark):
    rng = random.Random(5)
    a = words(rng, 60, 10**6)
    rows = [(1, a, None, None, None, None, None), (2, a + " x", None, None, None, None, None), (2, words(rng, 60, 10**6), None, None, None, None, None)]
    left = ngram_join.drop_near_copies(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in left) == sorted([(1, a), rows[2][:2]])


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    up = {x: x for e in edges for x in e}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_a_long_path_is_one_component(spark):
    """As many rounds as it takes."""
    n = 3000
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    edges = list(zip(ids, ids[1:], strict=False))
    got = graph.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t"))
    assert got.count() == n and {r.label for r in got.select("label").distinct().collect()} == {0}


def test_repeats_beside_partial_overlap(spark):
    """Repeated rows and null-id copies don't add to the overlap of their set."""
    rng = random.Random(12)
    rows = []
    for i, keep in enumerate([22, 30, 36, 42, 48, 54]):
        text = words(rng, 60, 10**6)
        other = " ".join(text.split()[:keep]) + " " + words(rng, 60 - keep, 10**6)
        rows += [(None if i % 2 else 10 * i, text, None, None, None, None, None)] * 3
        rows += [(None if i % 2 else 10 * i + 1, other, None, None, None, None, None)] * 2 + [(10 * i + 2, other, None, None, None, None, None)]
    got = ngram_join.ngram_join(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_that_defeat_polynomial_hashes(spark):
    one, two = thue_morse(1024), thue_morse(1024, "b", "a")
    rows = [(i, t, None, None, None, None, None) for i, t in enumerate([one, two, thue_morse(200), thue_morse(200, "b", "a"), " ".join(["x", one]), " ".join(["x", two])])]
    got = ngram_join.ngram_join(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_word_hashes_tell_words_apart():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abAB") * rng.randrange(1, 4) + rng.choice("xy") for _ in range(300)) for _ in range(20)] + [thue_morse(256), thue_morse(257), thue_morse(300), thue_morse(300, "b", "a"), "", "  a\tb\n"]
    seen = {}
    for seed in (0, 1):
        h, counts = grams.word_hashes([t.encode() for t in texts], seed=seed)
        words_ = [w for t in texts for w in t.split()]
        assert counts.tolist() == [len(t.split()) for t in texts] and len(h) == len(words_)
        by = {}
        for w, x in zip(words_, h.tolist(), strict=True):
            assert by.setdefault(w, x) == x
        assert len(set(by.values())) == len(by)
        seen[seed] = by
    assert not set(seen[0].values()) & set(seen[1].values())


def test_a_misleading_hash_is_noticed(spark, monkeypatch):
    """A false link is found on the words, and everything is done again under another seed."""
    texts = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e g"), (3, "A B c d e f")], "cid long, text string")
    links = spark.createDataFrame([(1, 2), (1, 3)], "u long, v long")
    assert [(r.u, r.v) for r in ngram_join.false_links(links, texts, 5, 75).collect()] == [(1, 2)]
    seeds, check = [], ngram_join.false_links

    def misled(links, *rest):
        seeds.append(1)
        return check(links, *rest) if len(seeds) > 1 else spark.createDataFrame([(1, 2)], "u long, v long")

    monkeypatch.setattr(ngram_join, "false_links", misled)
    rows = corpus(4)[:60]
    got = ngram_join.ngram_join(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows) and len(seeds) == 2


@pytest.mark.parametrize("most", [60, 700, 20_000])
def test_groups_are_bounded_by_their_n_grams(spark, monkeypatch, tmp_path, most):
    """No task gets far more n-grams than asked for, and results don't change."""
    folder, rows = str(tmp_path), corpus(6) + [(5000 + i, t, None, None, None, None, None) for i, t in enumerate(chain(80, 9))]
    links = ngram_join.trie_links

    def measured(percent):
        run = links(percent)

        def wrapped(table):
            tokens = [len(t) // 8 for t in table["tokens"].to_pylist()]
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(f"{sum(tokens)} {max(tokens)}")
            return run(table)

        return wrapped

    monkeypatch.setattr(ngram_join, "trie_links", measured)
    got = ngram_join.ngram_join(frame(spark, rows), most=most).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    seen = [tuple(map(int, f.read_text().split())) for f in tmp_path.iterdir()]
    assert seen and all(total <= 4 * (most + largest) for total, largest in seen)


@pytest.mark.parametrize("hot", [2, 5])
def test_hot_grams_change_nothing(spark, hot):
    rows = corpus(7)
    got = ngram_join.ngram_join(frame(spark, rows), hot=hot, group=9).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def chain(n, step=7):
    """Texts that each share n-grams with the next, so that all are candidates of all."""
    rng = random.Random(21)
    long = words(rng, step * n + 60, 10**6).split()
    return [" ".join(long[step * i : step * i + 60]) for i in range(n)]


def test_giant_candidate_component(spark):
    """One candidate group of many components: right, and the second round meets few blocks of each class."""
    texts = chain(300, 9) + chain(120, 2)
    rows = [(i, t, None, None, None, None, None) for i, t in enumerate(texts)]
    got = ngram_join.ngram_join(frame(spark, rows), group=10).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
