"""Operator 8, packing: concatenate and cut.

All documents' token ids, each document closed by a separator id, form one
stream that is cut every ``length`` ids. Only the very last sequence can be
short, so there is next to no padding.

Two passes. The first tokenizes each input partition once, keeps the running
count of ids inside the partition with every document and writes the ids to
the shared folder. Prefix sums over the partitions' totals (one row per
partition) then give global offsets. The second pass cuts every document at
the window borders its offset implies and returns one boundary record per
piece. Nothing is shuffled but the partition totals.

Tokens are looked up by word: the tokenizer drops white space, so a text's ids
are those of its white-space separated chunks, and most chunks recur. The
cache of a worker is bounded: the last ``CACHE`` chunks of at most 64 bytes and as
many before them, under 100 MB.

Defined results: a null or empty text is one separator. Null and repeated ids
are packed like others, one document per row. Very long texts are cut like
others. An empty table gives no piece. Extra columns don't matter.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import base

LENGTH, SEPARATOR, CACHE, GROUP = 2048, 1, 300_000, 128


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"


def text_encoder(path: str):
    """A function from lists of UTF-8 texts to lists of little-endian uint32 id bytes.

    It lives as long as the Python worker, so tasks share its cache. A new
    chunk is taken as a word and its closing ASCII punctuation, which the
    tokenizer splits anyway, and only new words are encoded."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    model = tok.model
    # The byte-level alphabet: printable bytes stand for themselves, the rest for 256 and on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = [chr(b if b in printable else 256 + b - sum(p < b for p in printable)) for b in range(256)]

    def packed(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def ids_of(chunk: bytes) -> bytes:
        """Letters of the Latin blocks are one word of the model in any case; the rest takes the whole tokenizer."""
        if chunk.isalpha():  # of bytes: ASCII letters
            return packed([t.id for t in model.tokenize(chunk.decode().lower())])
        head = chunk.rstrip(PUNCTUATION)
        if head and len(head) < len(chunk) and head[-1:].isalnum() and b"<|" not in chunk:
            return seen[head] + seen[chunk[len(head) :]]
        if not chunk.isascii() and (word := chunk.decode().lower()).isalpha() and max(word) < "\u0180":
            return packed([t.id for t in model.tokenize("".join([letter[b] for b in word.encode()]))])
        return packed(tok.encode(chunk.decode(), add_special_tokens=False).ids)

    seen = base.Seen(ids_of, CACHE)

    def encode(texts: list[bytes]) -> list[bytes]:
        out = []
        for text in texts:
            # Special tokens and combining marks (UTF-8 CC, CD) are sensitive to case; else case doesn't matter.
            plain = b"<|" not in text and b"\xcc" not in text and b"\xcd" not in text
            out.append(b"".join(map(seen.__getitem__, (text.lower() if plain else text).split())))
            seen.age()
        return out

    return encode


def token_ids(docs: DataFrame, path: str, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, n, ids (uint32), pid, local: the ids of each document with the
    separator, its input partition, and the partition's ids before it."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, ids binary, pid int, local long"
    end = np.asarray([separator], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        encode = base.cached(f"tokens {path}", lambda: text_encoder(path))
        pid, local = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for a in range(0, batch.num_rows, GROUP):
                part = [t or b"" for t in texts[a : a + GROUP].to_pylist()]
                ids = [x + end for x in encode(part)]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                starts = local + np.cumsum(n) - n
                local += int(n.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a : a + GROUP], pa.array(n), pa.array(ids, pa.binary()), pa.array(np.full(len(n), pid, np.int32)), pa.array(starts)], names=["doc_id", "n", "ids", "pid", "local"])

    return docs.mapInArrow(run, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = LENGTH, separator: int = SEPARATOR) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian
    uint32), doc_tokens, sequence_id, offset."""
    scratch = base.Scratch(docs.sparkSession, "pack")
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    tokens = scratch.table(token_ids(texts, path or tokenizer_path(), separator))
    totals = tokens.groupBy("pid").agg(F.sum("n").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = base.small(scratch.table(totals.select("pid", before.alias("base"))))
    placed = tokens.join(offsets, "pid").withColumn("at", F.col("base") + F.col("local"))
    n, at, ids = F.col("n"), F.col("at"), F.col("ids")

    def piece(w):
        start = F.greatest(F.lit(0), w * length - at)
        size = F.least(n, (w + 1) * length - at) - start
        part = F.substring(ids, (start * 4 + 1).cast("int"), (size * 4).cast("int"))
        return F.struct(start.alias("start"), size.alias("length"), part.alias("ids"), w.alias("sequence_id"), (at + start - w * length).alias("offset"))

    windows = F.sequence(F.floor(at / length), F.floor((at + n - 1) / length))
    pieces = placed.select("doc_id", n.alias("doc_tokens"), F.explode(F.transform(windows, piece)).alias("p"))
    return pieces.select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(base.read(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
