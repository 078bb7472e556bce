"""The registered queries as they are, against their SQL or a plain version."""

import random

import duckdb
import numpy as np
import pytest
import test_op2
import test_op3
import test_op7
from data import awkward, words, write
from pyspark.sql import functions as F

from rasterloom.llm import exact_dedup, ngram_join, passages, registry, sentencepiece_codec, toxicity


def documents(seed=3):
    """Unique ids: awkward texts, near copies, shared passages."""
    rng = random.Random(seed)
    texts = [r[1] for r in awkward(seed)] + test_op2.family(rng, words(rng, 70), 8, 5)
    passage = words(rng, 45, 900)
    texts += [f"{words(rng, rng.randrange(30))}\n{passage} {words(rng, rng.randrange(30))}" for _ in range(12)]
    rng.shuffle(texts)
    return [(3 * i - 50, t, None, None, None, None, None) for i, t in enumerate(texts)]


@pytest.mark.parametrize("name,run", [("op1_exact_dedup", exact_dedup.op1_exact_dedup), ("op2_ngram_join", ngram_join.op2_ngram_join), ("op10_passages", passages.op10_passages)])
def test_against_sql(spark, tmp_path, name, run):
    sf = write(spark, tmp_path, documents())
    assert registry.QUERIES[name] is run
    got = run(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet/*.parquet')")
    want = con.execute(registry.SQL[name])
    at = [[d[0] for d in want.description].index(c) for c in got.columns]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_toxicity(spark, tmp_path):
    rows, labels = test_op7.corpus(300)
    rows = [(r[0], r[1], None, None, None, None, None) for r in rows] + [(9000, None, None, None, None, None, None), (9001, "", None, None, None, None, None)]
    sf = write(spark, tmp_path, rows)
    table = spark.createDataFrame(labels, test_op7.LABELS)
    table.drop("text").write.parquet(f"{sf}/labels.parquet")
    vocabulary, models = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), table)
    texts = {r[0]: r[1] for r in rows}
    got = toxicity.op7_toxicity(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        have = {f.decode() for w in toxicity.words_of((texts[r.doc_id] or "").encode()) for f in toxicity.features_of(w)}
        ps = toxicity.predict_chain(np.array([[float(f in have) for f in vocabulary]]), models)
        assert abs(r.p_toxic - ps[1][0]) < 1e-9 and abs(r.p_low_quality - ps[0][0]) < 1e-9 and r.toxic == (r.p_toxic >= 0.5)


def test_sentencepiece(spark, tmp_path):
    rows = documents(5)
    got = {r.doc_id: r for r in sentencepiece_codec.op3_sentencepiece(spark, write(spark, tmp_path, rows)).collect()}
    from hashlib import sha256

    assert len(got) == len(rows)
    for i, t, *_ in rows:
        assert got[i].decoded_sha256 == sha256((t or "").encode()).hexdigest()


def test_sentencepiece_ids(spark, tmp_path):
    """The registered counts and hashes are those of ids whose score no other segmentation beats."""
    rows = [(i, t, None, None, None, None, None) for i, t in enumerate([*test_op3.MARKED, "the international Device 2024", "", None, "é漢🎉 ab  c"])]
    got = {r.doc_id: r for r in sentencepiece_codec.op3_sentencepiece(spark, write(spark, tmp_path, rows)).collect()}
    encoded = sentencepiece_codec.encode(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    model = sentencepiece_codec.Model.load(sentencepiece_codec.model_path())
    kept = [i for i in range(len(model.pieces)) if i not in model.skip]
    byte_ids = set(model.bytes.values())
    for r in encoded.select("doc_id", "ids", F.xxhash64("ids").alias("h")).collect():
        assert got[r.doc_id].n_ids == len(r.ids) and got[r.doc_id].ids_hash == r.h
        text = rows[r.doc_id][1]
        if text:
            score = sum(sentencepiece_codec.BYTE_SCORE if i in byte_ids else model.scores[i] for i in r.ids)
            marked = sentencepiece_codec.MARK + text.replace(" ", sentencepiece_codec.MARK)
            best = test_op3.brute_score(marked, [model.pieces[i] for i in kept], [model.scores[i] for i in kept], sentencepiece_codec.BYTE_SCORE)
            assert abs(score - best) < 1e-6
