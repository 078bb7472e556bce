"""Operator 7, toxicity by a classifier chain.

Categories are predicted one after another by logistic models; the model of a
category sees the words and the probabilities of all earlier categories. For
training these probabilities are out-of-fold predictions, so a later model
learns from what an unseen document would give. The labels table has two
categories, low quality and toxic; ``CATEGORIES`` maps names to label columns
and may hold more.

Features are words and their first four and five letters (families of one
stem), chosen by chi-squared against each category. The models are fitted on a
bounded sample of labelled rows: the ``SAMPLE`` ids with the smallest hash, and of
several rows with one of these ids the one whose text has the smallest hash.
Feature counts and the design matrix of that sample are made by
Spark; the driver fits on at most SAMPLE x (categories x ``WORDS``) zeros and
ones. Scoring reads every whole text in one narrow pass.

Defined results: a null or empty text has no feature and gets the model's
intercept. Labels with a null id or value are left out; of repeated labels the
largest counts; a labelled id trains with one of its rows. A category with one value only gets a constant probability,
and no labels at all give probability 0. Null and repeated document ids are
scored row by row. Extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import base

CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}
SAMPLE, WORDS, FOLDS, RIDGE, MEMO = 12_000, 128, 3, 0.1, 400_000
SPACES = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))


def words_of(text: bytes) -> set[bytes]:
    return set(text.lower().translate(SPACES).split())


def features_of(word: bytes) -> tuple[bytes, ...]:
    """The word and, of longer words, its first four and five letters."""
    w = word.decode()
    return (word, *((w[:n] + "*").encode() for n in (4, 5) if len(w) > n))


def labelled(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str, text_col: str, size: int = SAMPLE) -> DataFrame:
    """The training sample: doc_id, text, and 0/1 per category."""
    y = labels.select(F.col(id_col).alias("doc_id"), *[F.expr(e).cast("int").alias(f"y{i}") for i, e in enumerate(categories.values())]).dropna()
    y = y.groupBy("doc_id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(categories))])
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    texts = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    least = F.min(F.struct(F.md5("text").alias("h"), "text")).alias("row")
    rows = texts.join(F.broadcast(y), "doc_id").groupBy("doc_id", *y.columns[1:]).agg(least)  # at most ``size`` rows of integers
    return rows.select("doc_id", "row.text", *y.columns[1:])


def choose_words(sample: DataFrame, n_categories: int, words: int = WORDS) -> list[str]:
    """The features with the largest chi-squared against each category."""

    def count(batches):
        base.cached()
        seen: dict[bytes, list[int]] = {}
        for b in batches:
            for text, *y in zip(b["text"].cast(pa.binary()).to_pylist(), *[b[f"y{i}"].to_pylist() for i in range(n_categories)], strict=True):
                for f in {f for w in words_of(text) for f in features_of(w)}:
                    c = seen.setdefault(f, [0] * (n_categories + 1))
                    c[-1] += 1
                    for i, v in enumerate(y):
                        c[i] += v
        if seen:
            cols = list(zip(*seen.values(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([k.decode() for k in seen]), *[pa.array(c, pa.int64()) for c in cols]], names=["f", *[f"c{i}" for i in range(n_categories)], "n"])

    counts = [F.sum(c).alias(c) for c in [*[f"c{i}" for i in range(n_categories)], "n"]]
    table = sample.mapInArrow(count, "f string, " + ", ".join(f"c{i} long" for i in range(n_categories)) + ", n long").groupBy("f").agg(*counts).filter("n >= 3")
    sums = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"y{i}").alias(f"y{i}") for i in range(n_categories)]).first()
    chosen = set()
    for i in range(n_categories):
        share = (sums[f"y{i}"] or 0) / max(sums["n"], 1)
        if 0 < share < 1:
            expected = F.col("n") * share
            score = (F.col(f"c{i}") - expected) ** 2 / (expected * (1 - share))
            chosen |= {r["f"] for r in table.orderBy(score.desc(), "f").limit(words).collect()}  # at most ``words`` rows
    return sorted(chosen)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights and intercept by Newton's method; the intercept isn't shrunk."""
    w = np.zeros(x.shape[1] + 1)
    if len(y) == 0 or y.min() == y.max():
        w[-1] = 30 if len(y) and y[0] else -30
        return w
    shrink = np.full(len(w), ridge)
    shrink[-1] = 1e-6
    for _ in range(12):
        slope, bend = -shrink * w, np.diag(shrink)
        for a in range(0, len(x), 1024):  # blocks keep the copies small
            b = np.hstack([x[a : a + 1024], np.ones((len(x[a : a + 1024]), 1))])
            p = sigmoid(b @ w)
            slope += b.T @ (y[a : a + 1024] - p)
            bend += (b * (p * (1 - p))[:, None]).T @ b
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_chain(x: np.ndarray, ys: list[np.ndarray], folds: int = FOLDS) -> list[np.ndarray]:
    """One weight vector per category, over words, earlier probabilities, intercept."""
    fold, models = np.arange(len(x)) % folds, []
    for y in ys:
        models.append(fit_logistic(x, y))
        unseen = np.zeros(len(x))
        for k in range(folds):
            w = fit_logistic(x[fold != k], y[fold != k])
            unseen[fold == k] = sigmoid(x[fold == k] @ w[:-1] + w[-1])
        x = np.hstack([x, unseen[:, None].astype(np.float32)])
    return models


def predict_chain(x: np.ndarray, models: list[np.ndarray]) -> list[np.ndarray]:
    out = []
    for w in models:
        out.append(sigmoid(x @ w[:-1] + w[-1]))
        x = np.hstack([x, out[-1][:, None]])
    return out


class Matrix:
    """Texts to 0/1 rows over a vocabulary; remembers the features of words."""

    def __init__(self, vocabulary: list[str]):
        self.at, self.memo, self.width = {f.encode(): i for i, f in enumerate(vocabulary)}, {}, len(vocabulary)

    def row(self, text: bytes) -> set[int]:
        found: set[int] = set()
        memo, at = self.memo, self.at
        if len(memo) > MEMO:
            memo.clear()
        for w in words_of(text):
            hit = memo.get(w)
            if hit is None:
                hit = memo[w] = tuple(at[f] for f in features_of(w) if f in at)
            if hit:
                found.update(hit)
        return found

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        x = np.zeros((len(texts), self.width))
        for i, t in enumerate(texts):
            x[i, list(self.row(t))] = 1
        return x


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = SAMPLE):
    """(vocabulary, models) of the chain."""
    categories = CATEGORIES if categories is None else categories
    n = len(categories)
    sample = base.Scratch(docs.sparkSession, "toxicity").table(labelled(docs, labels, categories, id_col, text_col, size))
    vocabulary = choose_words(sample, n)

    def rows(batches):
        base.cached()
        matrix = Matrix(vocabulary)
        for b in batches:
            found = [sorted(matrix.row(t)) for t in b["text"].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(found, pa.list_(pa.int32())), *[b[f"y{i}"] for i in range(n)]], names=["doc_id", "f", *[f"y{i}" for i in range(n)]])

    kind = sample.schema["doc_id"].dataType.simpleString()
    got = sorted(sample.mapInArrow(rows, f"doc_id {kind}, f array<int>, " + ", ".join(f"y{i} int" for i in range(n))).collect())  # the bounded sample
    x = np.zeros((len(got), len(vocabulary)), np.float32)
    for i, r in enumerate(got):
        x[i, r["f"]] = 1
    return vocabulary, fit_chain(x, [np.array([r[f"y{i}"] for r in got], float) for i in range(n)])


def score(docs: DataFrame, vocabulary: list[str], models: list[np.ndarray], names: list[str], text_col: str = "text") -> DataFrame:
    """``docs`` with a probability column per name; names that are taken must not be passed."""
    k = docs.columns.index(text_col)

    def run(batches):
        base.cached()
        matrix = Matrix(vocabulary)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                b = batch.slice(a, 512)
                ps = predict_chain(matrix([t or b"" for t in b.column(k).cast(pa.binary()).to_pylist()]), models)
                yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(p) for p in ps]], names=[*b.schema.names, *names])

    out = StructType([*docs.schema.fields, *[StructField(name, DoubleType()) for name in names]])
    return docs.mapInArrow(run, out)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose last category is at least as probable as ``threshold``."""
    vocabulary, models = train(docs, labels)
    names = [base.fresh_name(docs, f"_p_{c}") for c in CATEGORIES]
    return score(docs, vocabulary, models, names).filter(F.col(names[-1]) < threshold).select(docs.columns)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.read(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary, models = train(docs, base.read(spark, sf_dir, "labels"))
    scored = score(docs, vocabulary, models, [f"p_{c}" for c in CATEGORIES])
    return scored.select("doc_id", *[f"p_{c}" for c in CATEGORIES], (F.col("p_toxic") >= 0.5).alias("toxic"))
