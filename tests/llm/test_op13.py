import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import tiktoken
from data import SCHEMA, awkward, frame, words, write

from rasterloom.llm import byte_bpe, registry

RANKS = byte_bpe.load_ranks(byte_bpe.ranks_path())
REFERENCE = tiktoken.Encoding("own", pat_str=byte_bpe.default_pattern(), mergeable_ranks=RANKS, special_tokens={})
TEXTS = ["a", "'s it's I'LL", "  two   spaces \n\n\t x ", "漢字 日本 ½ ٣ 🎉👨‍👩‍👧 é é", "<|endoftext|> x", "\x00\x1c\x85  　y", "a" * 9000, " " * 5000 + "b", "ab" * 3000 + "!" * 4500, "1234567890" * 900]


def ids_of(b):
    return np.frombuffer(b, "<u4").tolist()


def plain(piece, ranks):
    """The lowest-ranked neighbouring pair, leftmost first, until there is none."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_against_plain_merging():
    """Made vocabularies whose ranks needn't come from merges, so a merge may bring a lower rank up."""
    rng = random.Random(5)
    for _ in range(40):
        tokens = [bytes([b]) for b in range(256)]
        tokens += list({bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(40)})
        rng.shuffle(tokens)
        ranks = {t: i for i, t in enumerate(tokens)}
        codec = byte_bpe.Codec(ranks, byte_bpe.default_pattern())
        for _ in range(40):
            piece = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 40)))
            assert codec.merge(piece) == ([ranks[piece]] if piece in ranks else plain(piece, ranks))
        assert not any(codec.words)


def test_against_library():
    codec = byte_bpe.Codec(RANKS, byte_bpe.default_pattern())
    rng = random.Random(6)
    pool = [*"abcdeé漢🎉 \n\t'.,!?0123", "the", " and", "ing", "  ", "\r\n", " ", "ſ", "ß"]
    made = ["".join(rng.choice(pool) for _ in range(rng.randrange(200))) for _ in range(400)]
    for t in [*TEXTS, *made, words(rng, 3000, 900)]:
        assert ids_of(codec.encode(t)) == REFERENCE.encode_ordinary(t)
        assert codec.decode(codec.encode(t)) == t.encode()
    assert codec.encode("") == b""
    with pytest.raises(ValueError):
        codec.decode(np.array([len(RANKS) + 5], "<u4").tobytes())


def test_full_cache_and_long_texts(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE", 50)
    monkeypatch.setattr(byte_bpe, "STEP", 40)
    codec = byte_bpe.Codec(RANKS, byte_bpe.default_pattern())
    rng = random.Random(7)
    for _ in range(30):
        t = words(rng, 60, 300) + " " + "z" * 90
        assert ids_of(codec.encode(t)) == REFERENCE.encode_ordinary(t)
        assert len(codec.seen) <= 50 and len(codec.seen.older) <= 50 + 40


def test_awkward_rows(spark):
    rows = awkward()
    back = byte_bpe.decode(byte_bpe.encode(frame(spark, rows)))
    assert Counter((r.doc_id, bytes(r.decoded)) for r in back.collect()) == Counter((r[0], (r[1] or "").encode()) for r in rows)
    clash = spark.createDataFrame([(1, bytearray(RANKS[b"a"].to_bytes(4, "little")), "x"), (2, None, "y")], "doc_id long, ids binary, decoded string")
    assert {(r.doc_id, r.decoded, r.decoded_ and bytes(r.decoded_)) for r in byte_bpe.decode(clash).collect()} == {(1, "x", b"a"), (2, "y", None)}
    assert byte_bpe.decode(byte_bpe.encode(spark.createDataFrame([], SCHEMA))).count() == 0


def test_registered(spark, tmp_path):
    rows = awkward() + [(900 + i, t, None, None, None, None, None) for i, t in enumerate(TEXTS)]
    got = registry.QUERIES["op13_byte_bpe"](spark, write(spark, tmp_path, rows)).collect()
    want = []
    for i, t, *_ in rows:
        ids = REFERENCE.encode_ordinary(t or "")
        want.append((i, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256((t or "").encode()).hexdigest()))
    assert Counter(map(tuple, got)) == Counter(want)
