"""The pipeline against a plain Python version of every stage."""

import random
from collections import defaultdict

import numpy as np
import test_op2
import test_op5
import test_op7
from data import words
from tokenizers import Tokenizer

import corpus_pipeline
from rasterloom.llm import packing, toxicity


def data():
    rng = random.Random(11)
    rows, labels = test_op7.corpus(400)
    rows = [r[:5] for r in rows]
    base = [words(rng, 80, 5000) for _ in range(10)]
    extra = base + [b.upper() for b in base[:4]] + test_op2.family(rng, base[0], 6, 3) + [f"{words(rng, 30, 5000)} token = abcdefgh1234 end", None, "", "dup dup", "dup dup"]
    rows += [(1000 + i, t, "en", "s", len(t) if t else None) for i, t in enumerate(extra)]
    return rows, labels


def toxic(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    vocabulary, models = toxicity.train(docs, spark.createDataFrame(labels, test_op7.LABELS))
    out = set()
    for i, t, *_ in rows:
        have = {f.decode() for w in toxicity.words_of((t or "").encode()) for f in toxicity.features_of(w)}
        x = np.array([[float(f in have) for f in vocabulary]])
        if toxicity.predict_chain(x, models)[-1][0] >= 0.5:
            out.add(i)
    return out


def redacted(t):
    spans = [x.split(":") for x in test_op5.brute(t).split(",") if x]
    for _, a, b in sorted(spans, key=lambda s: -int(s[1])):
        t = t[: int(a)] + "[SECRET]" + t[int(b) :]
    return t


def test_pipeline(spark, tmp_path):
    rows, labels = data()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, test_op7.LABELS).drop("text").write.parquet(f"{tmp_path}/labels.parquet")
    gone = toxic(spark, rows, labels)
    left = [r for r in rows if r[0] not in gone]
    first = {}
    for r in sorted(left):
        first.setdefault((r[1] or "").lower(), r)
    left = list(first.values())
    left = [r for r in left if (r[0], r[0]) in {(i, c) for i, _, c in test_op2.brute(left)}]
    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = {r[0]: tok.encode(redacted(r[1] or ""), add_special_tokens=False).ids + [1] for r in left}
    pieces = defaultdict(dict)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id][r.start] = np.frombuffer(r.ids, "<u4").tolist()
    assert {i: [x for s in sorted(p) for x in p[s]] for i, p in pieces.items()} == want


def test_stages_keep_the_columns(spark, tmp_path):
    rows, labels = data()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, test_op7.LABELS).drop("text").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


def test_stages_on_awkward_rows(spark, tmp_path):
    from data import SCHEMA, awkward, frame

    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (awkward(), []):
        docs = frame(spark, rows) if rows else spark.createDataFrame([], SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert (out.count() > 0) == bool(rows), name
            if name != "packing":
                assert out.columns == docs.columns, name
