"""Small tables with the awkward cases every operator has to handle."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, _k1 string"


def words(rng, n, vocab=200):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def awkward(seed=1, n=60):
    """Nulls in any column, empty and long texts, copies, ties, repeated rows, clashing names."""
    rng = random.Random(seed)
    texts = [words(rng, rng.randrange(1, 120)) for _ in range(n)]
    texts += [texts[0], texts[0].upper(), texts[1], None, "", " \n\t ", words(rng, 20_000), "é" * 50, "one two", "\x00\x1f x  y"]
    rows = [(i, t, "en" if i % 3 else None, "src0", len(t) if t else None, "x", None) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], rows[5], (None, texts[2], None, None, None, None, None), (None, None, None, None, None, None, None), (None, "null id", None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def write(spark, tmp_path, rows, name="documents"):
    frame(spark, rows).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
