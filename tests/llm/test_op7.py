import random
import re
from collections import Counter
from hashlib import md5

import numpy as np
from data import SCHEMA, awkward, frame, words, write

from rasterloom.llm import toxicity

LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(n=1500, seed=4):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.15
        text = words(rng, rng.randrange(5, 80), 400).split()
        if toxic:
            for w in rng.sample(["Idiot!", "moron", "scumbag", "scumlike,", "scumful", "clown"], 2):
                text.insert(rng.randrange(len(text)), w)
        rows.append((i, " ".join(text), None, None, None, None, None))
        labels.append((i, int(rng.random() < 0.8), int(toxic), None))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    vocabulary, models = toxicity.train(frame(spark, rows), spark.createDataFrame(labels[:1000] + [(None, 1, 1, None), (3, None, 1, None)], LABELS))
    got = {r.doc_id: r.p_b for r in toxicity.score(frame(spark, rows), vocabulary, models, ["p_a", "p_b"]).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(t) for i, _, t, _ in labels[1000:]]) > 0.97


def test_later_models_use_earlier_probabilities():
    rng = np.random.default_rng(0)
    x = (rng.random((2000, 3)) < 0.5).astype(float)
    first = (x[:, 0] + x[:, 1] > 1).astype(float)
    models = toxicity.fit_chain(x, [first, first])
    assert len(models[0]) == 4 and len(models[1]) == 5 and models[1][3] > 1
    assert ((toxicity.predict_chain(x, models)[1] >= 0.5) == first).all()


def test_awkward_rows(spark):
    rows = awkward()
    docs = frame(spark, rows)
    none = spark.createDataFrame([], LABELS)
    kept = toxicity.drop_toxic(docs, none)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    one = spark.createDataFrame([(1, 1, 0, None), (2, 1, 0, None)], LABELS)
    assert toxicity.drop_toxic(docs, one).count() == len(rows)
    assert toxicity.drop_toxic(spark.createDataFrame([], SCHEMA), one).count() == 0


def test_sample_is_bounded_by_ids(spark):
    """10,000 rows of a labelled id give one row of the sample, the same whatever the order."""
    rows = [(1, f"text {i % 50}", None, None, None, None, None) for i in range(10_000)] + [(i, "x", None, None, None, None, None) for i in range(2, 40)]
    labels = spark.createDataFrame([(i, 1, i % 2, None) for i in range(1, 40)], LABELS)
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        got = toxicity.labelled(frame(spark, rows).repartition(5), labels, toxicity.CATEGORIES, "doc_id", "text", 1000).collect()
        assert sorted(r.doc_id for r in got) == list(range(1, 40))
        assert next(r.text for r in got if r.doc_id == 1) == min((f"text {i}" for i in range(50)), key=lambda t: md5(t.encode()).hexdigest())
    assert toxicity.labelled(frame(spark, rows), labels, toxicity.CATEGORIES, "doc_id", "text", 10).count() == 10


def plain_features(text):
    """Words of ASCII letters and digits (other bytes are letters) and the starts of longer ones."""
    out = set()
    for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)):
        if w:
            out |= {w, *[w[:n] + "*" for n in (4, 5) if len(w) > n]}
    return out


def plain_logistic(x, y, ridge):
    """Minimum of the penalised loss by plain gradient steps of Newton's kind on whole matrices."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    if y.min() == y.max():
        return np.array([0.0] * (x.shape[1] - 1) + [30.0 if y[0] else -30.0])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-(x @ w)))
        w = w + np.linalg.inv(x.T @ np.diag(p * (1 - p)) @ x + penalty) @ (x.T @ (y - p) - penalty @ w)
    return w


def test_registered_against_a_plain_chain(spark, tmp_path):
    """Words, weights, folds and the chain made again without the package."""
    rows, labels = corpus(260, 9)
    sf = write(spark, tmp_path, [*rows, (9001, "", None, None, None, None, None), (9002, None, None, None, None, None, None)])
    spark.createDataFrame(labels[:200], LABELS).drop("text").write.parquet(f"{sf}/labels.parquet")
    texts = {r[0]: plain_features(r[1]) for r in rows} | {9001: set(), 9002: set()}
    ids = [i for i, *_ in labels[:200]]
    ys = [np.array([1.0 - q for _, q, _, _ in labels[:200]]), np.array([float(t) for _, _, t, _ in labels[:200]])]
    n, chosen = Counter(f for i in ids for f in texts[i]), set()
    for y in ys:
        share = y.mean()
        hit = Counter(f for i, v in zip(ids, y, strict=True) if v for f in texts[i])
        score = {f: (hit[f] - k * share) ** 2 / (k * share * (1 - share)) for f, k in n.items() if k >= 3}
        chosen |= set(sorted(score, key=lambda f: (-score[f], f))[: toxicity.WORDS])
    words_ = sorted(chosen)
    x = np.array([[float(f in texts[i]) for f in words_] for i in ids])
    every = np.array([[float(f in texts[i]) for f in words_] for i in texts])
    for y in ys:
        w = plain_logistic(x, y, toxicity.RIDGE)
        unseen = np.zeros(len(ids))
        for k in range(toxicity.FOLDS):
            there = np.arange(len(ids)) % toxicity.FOLDS == k
            v = plain_logistic(x[~there], y[~there], toxicity.RIDGE)
            unseen[there] = 1 / (1 + np.exp(-(x[there] @ v[:-1] + v[-1])))
        p = 1 / (1 + np.exp(-(every @ w[:-1] + w[-1])))
        x, every = np.hstack([x, unseen[:, None]]), np.hstack([every, p[:, None]])
    want = dict(zip(texts, every[:, -2:].tolist(), strict=True))
    got = toxicity.op7_toxicity(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert abs(r.p_low_quality - want[r.doc_id][0]) < 1e-4 and abs(r.p_toxic - want[r.doc_id][1]) < 1e-4 and r.toxic == (r.p_toxic >= 0.5)
