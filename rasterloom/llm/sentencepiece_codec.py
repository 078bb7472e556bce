"""Operator 3, SentencePiece encoding and decoding by a unigram Viterbi search.

Encoding marks white space with U+2581, looks pieces up in a double-array trie
over their UTF-8 bytes and takes the segmentation with the largest sum of log
scores; ties go to the longest last piece. A character that is no piece of its
own has its bytes as one more choice, each a byte piece at ``BYTE_SCORE``; other
characters never become bytes. The only model at hand is a BPE model, whose
scores are merge ranks; ``log_scores`` turns them into log probabilities, and
the ids are those of that search, not of the model's own merges. Pieces the
model gives no usable score (runs of the mark, and the mark alone) rank by their
place in the file. Decoding joins pieces and bytes, turns marks into
spaces and drops the one put in front: it returns the text exactly (a U+2581 of
the text itself comes back as a space).

Pieces never hold a mark after another character, and a character that no piece
holds stands alone, so the best segmentation of a text is that of its words
(with the marks before them) and of the lines in them. A worker remembers words
it has seen (``CACHE``). Documents are encoded where they are read: no shuffle, and the trie
(two integer arrays) is shipped once per task.

Defined results: null and empty texts have no ids and decode to the empty
text. Byte sequences that aren't UTF-8, and ids outside the model, decode to
U+FFFD. Null and repeated ids are kept row by row. Extra columns don't matter.
"""

from __future__ import annotations

import math
import re
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

MARK, CACHE, CHUNK, BYTE_SCORE, NO_SCORE, OFFSET = "▁", 800_000, 128, -1e6, -1e8, 10
WORDS = re.compile(f"{MARK}+[^{MARK}]*")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def log_scores(scores: list[float], skip: set[int]) -> list[float]:
    """Log probabilities of the pieces.

    Scores of a BPE model (whole numbers that fall with the id) are ranks r as
    -r; a piece of rank r gets the share 1 / (r + OFFSET) of all pieces' shares,
    as word frequencies fall with their rank. Others are log scores already."""
    kept = [i for i in range(len(scores)) if i not in skip]
    ranks = [-scores[i] for i in kept]
    if any(r != int(r) or r < 0 for r in ranks) or any(a >= b for a, b in zip(ranks, ranks[1:], strict=False)):
        return scores
    total = math.log(math.fsum(1 / (r + OFFSET) for r in ranks))
    out = list(scores)
    for i, r in zip(kept, ranks, strict=True):
        out[i] = -math.log(r + OFFSET) - total
    return out


class Model:
    """Pieces, scores and byte ids of a SentencePiece model file."""

    def __init__(self, pieces: list[str], scores: list[float], bytes_: dict[int, int], skip: set[int]):
        self.pieces, self.scores, self.bytes, self.skip = pieces, scores, bytes_, skip

    @staticmethod
    def load(path: str) -> Model:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        bytes_ = {int(p[3:5], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}
        skip = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)}
        first = min(i for i in range(n) if i not in skip)
        scores = [sp.get_score(i) for i in range(n)]
        scores = [s if s > NO_SCORE else float(first - i) for i, s in enumerate(scores)]
        return Model(pieces, log_scores(scores, skip), bytes_, skip)


class DoubleArray:
    """Trie as two arrays: the child of node s by byte c is t = base[s] + c + 1 if check[t] == s.

    ``value[t]`` is the id of the piece that ends at t, or -1."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for key, i in keys:
            node = 0
            for c in key:
                node = children[node].setdefault(c, len(children))
                if node == len(children):
                    children.append({})
                    ends.append(-1)
            ends[node] = i
        size = len(children) * 3 + 1024  # room for every search below
        used = np.zeros(size, bool)
        self.base, self.check, self.value = array("i", [0]) * size, array("i", [-1]) * size, array("i", [-1]) * size
        self.check[0], used[0] = 0, True
        free = dense = 1  # no free slot before ``free``; few before ``dense``
        queue = [(0, 0)]
        for node, slot in queue:
            self.value[slot] = ends[node]
            if not children[node]:
                continue
            codes = sorted(children[node])
            if len(codes) == 1:
                while used[free] or free <= codes[0]:
                    free += 1
                b = free - codes[0] - 1
            else:
                b, dense = self._search(used, np.array(codes), dense)
            self.base[slot] = b
            for c in codes:
                used[b + c + 1] = True
                self.check[b + c + 1] = slot
                queue.append((children[node][c], b + c + 1))
        last = int(np.flatnonzero(used)[-1]) + 1
        self.base, self.check, self.value = self.base[:last], self.check[:last], self.value[:last]

    @staticmethod
    def _search(used: np.ndarray, codes: np.ndarray, start: int, step: int = 1024) -> tuple[int, int]:
        """The first base whose slots for all codes are free, and where the next search may start."""
        at = dense = start
        while True:
            open_ = np.flatnonzero(~used[at : at + step]) + at
            bases = open_ - codes[0] - 1
            bases = bases[(bases >= 0) & (bases + codes[-1] + 1 < len(used))]
            fits = ~used[bases[:, None] + codes[1:] + 1].any(axis=1)
            if fits.any():
                return int(bases[fits.argmax()]), dense
            if len(open_) < step // 16 and at == dense:
                dense = at + step
            at += step


class Encoder:
    """Viterbi search over words; scores by id."""

    def __init__(self, trie: DoubleArray, scores: list[float], bytes_: dict[int, int], lines: bool = False):
        self.trie, self.scores, self.bytes, self.cache = trie, scores, bytes_, {}
        self.limit = len(trie.check)
        self.lines, self.tails = lines, {}

    def word(self, text: bytes) -> list[int]:
        """Best segmentation of UTF-8 bytes without a look at what surrounds them."""
        n = len(text)
        best, back = [-math.inf] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        base_, check, value, scores, limit = self.trie.base, self.trie.check, self.trie.value, self.scores, self.limit
        for i in range(n):
            if best[i] == -math.inf:
                continue
            c = text[i]
            end = min(n, i + (1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4))
            slot, j, covered = 0, i, False
            while j < n:
                t = base_[slot] + text[j] + 1
                if t >= limit or check[t] != slot:
                    break
                slot, j = t, j + 1
                if value[t] >= 0:
                    covered = covered or j == end
                    s = best[i] + scores[value[t]]
                    if s > best[j]:
                        best[j], back[j] = s, (i, value[t])
            if covered:
                continue
            s = best[i] + BYTE_SCORE * (end - i)
            if s > best[end]:
                best[end], back[end] = s, (i, -1)
        out: list[int] = []
        while n:
            i, piece = back[n]
            out.extend([piece] if piece >= 0 else [self.bytes[b] for b in reversed(text[i:n])])
            n = i
        return out[::-1]

    def piece(self, key: str, mark: str) -> bytes:
        return array("i", self.word((mark + key).encode())).tobytes()

    def new_word(self, key: str) -> bytes:
        """Ids of a mark and the word; lines are looked up apart, as no piece holds a line feed."""
        if "\n" not in key or not self.lines:
            return self.piece(key, MARK)
        first, *rest = key.split("\n")
        out = [self.cache[first] if first in self.cache else self.piece(first, MARK)]
        for line in rest:
            tail = "\n" + line
            if tail not in self.tails:
                self.tails[tail] = self.piece(tail, "")
            out.append(self.tails[tail])
        return b"".join(out)

    def __call__(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian 32-bit integers."""
        if not text:
            return b""
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            words = [w[1:] for w in WORDS.findall(MARK + text.replace(" ", MARK))]
        else:
            words = text.split(" ")
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        if len(self.tails) > CACHE // 4:
            self.tails.clear()
        new = {w: self.new_word(w) for w in set(words) if w not in cache}
        cache.update((w, x) for w, x in new.items() if len(w) <= 64 and "\n" not in w)
        return b"".join([cache[w] if w in cache else new[w] for w in words])


def decode_ids(ids, pieces: list[bytes]) -> str:
    n = len(pieces)
    return b"".join([pieces[i] if 0 <= i < n else b"\xff" for i in ids]).decode("utf-8", "replace").replace(MARK, " ")[1:]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int)."""
    model = Model.load(path or model_path())
    keys = [(p.encode(), i) for i, p in enumerate(model.pieces) if i not in model.skip]
    shipped = base.ready(docs.sparkSession).sparkContext.broadcast((DoubleArray(keys), model.scores, model.bytes, all(b"\n" not in k for k, _ in keys)))  # bounded by the vocabulary
    name = uuid.uuid4().hex
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(batches):
        enc = base.cached(name, lambda: Encoder(*shipped.value))
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                part = batch.slice(a, CHUNK)
                ids = [enc(t) if t else b"" for t in part.column(1).to_pylist()]
                ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, text: the text of each row's ids."""
    model = Model.load(path or model_path())
    byte_of = {i: b for b, i in model.bytes.items()}
    pieces = [bytes([byte_of[i]]) if i in byte_of else b"" if i in model.skip else p.encode() for i, p in enumerate(model.pieces)]

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            flat, ends = np.asarray(lists.flatten()), np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))))
            texts = [decode_ids(flat[a:b].tolist(), pieces) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the hash of what they decode to."""
    back = decode(encode(base.read(spark, sf_dir, "documents")))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), F.sha2("text", 256).alias("decoded_sha256"))
