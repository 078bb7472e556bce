"""Operator 13, byte-level BPE encoding and decoding with a rank queue.

A text is split by the pattern; each match (pre-token) is a linked list of byte
runs whose neighbouring pairs wait in a queue of merge ranks:

* a bucket per rank holds the list positions whose pair has this rank, leftmost
  first;
* a hierarchical bitmap of two levels, each about as wide as the square root of
  the vocabulary, marks the buckets in use: two find-first-set steps give the
  lowest rank;
* a merge joins a run with the next, looks up the two new pairs and puts them
  into their buckets. Entries whose pair has changed meanwhile are stale and are
  skipped when they come up, so nothing is ever searched or removed.

A pre-token of n bytes takes O(n log n) steps and about 60 n bytes, whatever its
repeats. Most pre-tokens recur, so a worker remembers the ids of those of at most
64 characters: the last ``CACHE`` and as many before them (under 150 MB). Long
texts are split ``STEP`` pre-tokens at a time.

Both directions are one narrow pass over the rows; nothing is shuffled.

Defined results: a null or empty text has no ids and decodes to nothing. Null
and repeated ids of documents are kept, one row per input row. Special tokens
are ordinary text. Null ids decode to null; an id outside the vocabulary is an
error. An empty table gives an empty result. Extra columns don't matter to
``encode`` and are kept by ``decode``.
"""

from __future__ import annotations

import base64
import sys
from array import array
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from . import base

CACHE, STEP, GROUP = 350_000, 200_000, 128
#: Bytes from which a pre-token's lists are packed arrays.
LONG = 4096


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, which is the token's id."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path} has no token for some byte")
    return ranks


class Codec:
    """Encoder and decoder of one vocabulary, with the pre-tokens seen lately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern)
        self.longest = max(map(len, ranks))
        size = max(ranks.values()) + 1
        self.tokens: list[bytes | None] = [None] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        # Two levels of about equal width: rank = width * word + bit.
        self.shift = (size.bit_length() + 1) // 2
        self.words = [0] * ((size >> self.shift) + 1)
        self.bit = [1 << k for k in range(max(1 << self.shift, len(self.words)))]
        self.buckets: list = [None] * size
        self.seen = base.Seen(lambda word: self.packed(word.encode()), CACHE)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token. ``top`` and ``words`` are the bitmap, all zero between calls."""
        ranks, longest, n = self.ranks, self.longest, len(piece)
        if piece in ranks:
            return [ranks[piece]]
        words, bit, buckets, shift, low, top = self.words, self.bit, self.buckets, self.shift, (1 << self.shift) - 1, 0
        get = ranks.get
        if n < LONG:
            end, before, pair = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        else:
            end, before, pair = array("q", range(1, n + 1)), array("q", range(-1, n - 1)), array("q", [-1]) * n
        # end: of the run that starts here, and start of the next; before: start of
        # the run before; pair: rank of the run with the next
        waiting = [(rank, i) for i in range(n - 1) if (rank := get(piece[i : i + 2])) is not None]
        while True:
            for rank, i in waiting:
                pair[i] = rank
                bucket = buckets[rank]
                if bucket is None:  # most buckets have one place
                    buckets[rank] = i
                    word = rank >> shift
                    words[word] |= bit[rank & low]
                    top |= bit[word]
                elif type(bucket) is list:
                    heappush(bucket, i)
                else:
                    buckets[rank] = [bucket, i] if bucket < i else [i, bucket]
            while top:
                word = (top & -top).bit_length() - 1  # find first set, level by level
                inside = words[word]
                rank = (word << shift) + (inside & -inside).bit_length() - 1
                i = buckets[rank]
                if type(i) is list and len(i) > 1:
                    i = heappop(i)
                else:
                    if type(i) is list:
                        i = i[0]
                    buckets[rank] = None
                    words[word] = inside = inside & (inside - 1)
                    if not inside:
                        top &= top - 1
                if pair[i] == rank:
                    break  # else the entry is stale
            else:
                break
            gone = end[i]
            stop = end[i] = end[gone]
            pair[gone] = pair[i] = -1
            waiting = []
            if stop < n:
                before[stop] = i
                after = end[stop]
                if after - i <= longest and (new := get(piece[i:after])) is not None:
                    waiting.append((new, i))
            left = before[i]
            if left >= 0:
                pair[left] = -1
                if stop - left <= longest and (new := get(piece[left:stop])) is not None:
                    waiting.append((new, left))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def packed(self, piece: bytes) -> bytes:
        ids = array("I", self.merge(piece))
        if sys.byteorder != "little":
            ids.byteswap()
        return ids.tobytes()

    def pre_tokens(self, text: str):
        """Lists of the text's pre-tokens."""
        if len(text) <= STEP:
            yield self.find.findall(text)
            return
        matches = self.find.finditer(text)
        while part := [m[0] for m in islice(matches, STEP)]:
            yield part

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        seen, out = self.seen, []
        for words in self.pre_tokens(text):
            out += map(seen.__getitem__, words)
            seen.age()
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        try:
            return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        except (IndexError, TypeError):
            raise ValueError("an id outside the vocabulary") from None


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec, the same for both directions."""
    return base.cached(f"bpe {path} {pattern}", lambda: Codec(load_ranks(path), pattern))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit)."""
    path, pattern = path or ranks_path(), pattern or default_pattern()
    base.ready(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(batches):
        enc = codec(path, pattern).encode
        for batch in batches:
            for a in range(0, batch.num_rows, GROUP):
                part = batch.slice(a, GROUP)
                ids = [enc(t) if t else b"" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``encoded`` with the bytes of its ids in ``decoded``."""
    path, pattern = path or ranks_path(), pattern or default_pattern()
    base.ready(encoded.sparkSession)
    k = encoded.columns.index(ids_col)
    schema = StructType([*encoded.schema.fields, StructField(base.fresh_name(encoded, "decoded"), BinaryType())])

    def run(batches):
        dec = codec(path, pattern).decode
        for batch in batches:
            for a in range(0, batch.num_rows, GROUP):
                part = batch.slice(a, GROUP)
                texts = [None if x is None else dec(x) for x in part.column(k).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=schema.names)

    return encoded.mapInArrow(run, schema)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the hash of what they decode to."""
    back = decode(encode(base.read(spark, sf_dir, "documents")))
    tokens = F.floor(F.octet_length("ids") / 4).cast("long")
    return back.select("doc_id", tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
