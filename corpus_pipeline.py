"""Corpus pipeline over ``documents``.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``:

* toxicity: documents the classifier chain rejects go;
* exact dedup: of equal texts the smallest id stays;
* near dedup: of each group of linked texts the smallest id stays;
* secrets: found spans are replaced by a mark, documents stay;
* packing: token pieces of fixed sequences.

The first stage's model and the tokenizer can't be expressed in SQL, so there
is no ORACLE_SQL; a brute-force version in the tests covers the stages.
"""

from __future__ import annotations

from rasterloom.llm import base, exact_dedup, ngram_join, packing, secrets, toxicity


def toxicity_stage(spark, docs, sf_dir):
    return toxicity.drop_toxic(docs, base.read(spark, sf_dir, "labels"))


def exact_stage(spark, docs, sf_dir):
    return exact_dedup.drop_copies(docs)


def near_stage(spark, docs, sf_dir):
    return ngram_join.drop_near_copies(docs)


def secrets_stage(spark, docs, sf_dir):
    return secrets.redact(docs)


def packing_stage(spark, docs, sf_dir):
    return packing.pack(docs)


STAGES = [("toxicity", toxicity_stage), ("exact_dedup", exact_stage), ("ngram_join", near_stage), ("secrets", secrets_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark, sf_dir):
    scratch = base.Scratch(spark, "pipeline")
    docs = base.read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        base.ready(spark)
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.table(docs)
    return docs
