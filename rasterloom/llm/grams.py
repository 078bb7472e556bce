"""Words and word n-grams of whole texts as 64-bit hashes, in numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Its hash is the sum of
random numbers drawn for (place in the word, byte) by ``seed``: for any two
different words chance alone makes them equal, one time in 2**64. Words of over
``LONG`` bytes take a keyed BLAKE2b. n-grams are polynomials over word hashes,
from prefix sums modulo 2**64, and mixed; other seeds give independent hashes.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes hashed at a time; longer texts are cut between words.
BLOCK = 1 << 18
U = np.uint64
WORD_BASE = 0xC2B2AE3D27D4EB4F
#: Bytes of a word with numbers of their own; longer words are hashed one by one.
LONG = 256
_powers: dict[int, np.ndarray] = {}
_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base % 2**64, U)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=U)
    return have[:n]


def table(seed: int) -> np.ndarray:
    """A random number for each place in a word and byte; none for white space."""
    if seed not in _tables:
        made = np.random.default_rng([seed, LONG]).integers(0, 2**64, (LONG, 256), U)
        made[:, SPACE] = 0
        _tables[seed] = made.reshape(-1)
    return _tables[seed]


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _blocks(texts: list[bytes]):
    """Lists of (text number, bytes) of about BLOCK bytes, long texts cut between words."""
    part, size = [], 0
    for i, t in enumerate(texts):
        a = 0
        while True:
            b = len(t)
            if b - a > BLOCK:
                b = a + BLOCK
                while b < len(t) and not SPACE[t[b]]:
                    b += 1
            if size + b - a > BLOCK and part:
                yield part
                part, size = [], 0
            part.append((i, t[a:b] if a or b < len(t) else t))
            size += b - a
            a = b
            if a >= len(t):
                break
    if part:
        yield part


def word_hashes(texts: list[bytes], lower: bool = False, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, words per text)."""
    out, counts = [], np.zeros(len(texts), np.int64)
    for part in _blocks(texts):
        buf = np.frombuffer(b" ".join([t for _, t in part]) + b" ", np.uint8)
        if lower:
            buf = LOWER[buf]
        word = np.concatenate(([False], ~SPACE[buf]))
        edge = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edge[0::2], edge[1::2]
        if len(starts) == 0:
            continue
        own = buf[starts[0] :].astype(np.int32)
        place = np.arange(len(own), dtype=np.int32) - np.repeat((starts - starts[0]).astype(np.int32), np.diff(np.append(starts, len(buf))))
        own += np.minimum(place, LONG - 1) << 8
        sums = np.add.reduceat(table(seed)[own], starts - starts[0])
        for i in np.flatnonzero(ends - starts > LONG).tolist():
            sums[i] = int.from_bytes(blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8, key=b"%d" % seed).digest(), "little")
        out.append(mix(sums))
        at = np.cumsum([0] + [len(t) + 1 for _, t in part])
        np.add.at(counts, [i for i, _ in part], np.diff(np.searchsorted(starts, at)))
    return (np.concatenate(out) if out else np.zeros(0, U)), counts


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams starting at each of the first len(words) - n + 1 words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    sums = np.zeros(len(words) + 1, U)
    np.cumsum(words * powers(WORD_BASE, len(words)), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * powers(inverse(WORD_BASE), m))


def shingle_sets(texts: list[bytes], n: int = 5, seed: int = 0):
    """Per text the sorted distinct n-gram hashes; of a shorter text its one whole sequence; lower case."""
    words, counts = word_hashes(texts, True, seed)
    for g in _grams_of(words, counts, n):
        g = np.sort(g)
        yield g[np.concatenate((np.ones(min(len(g), 1), bool), g[1:] != g[:-1]))]


def _grams_of(words: np.ndarray, counts: np.ndarray, n: int):
    grams, at = gram_hashes(words, n), 0
    for c in counts.tolist():
        yield grams[at : at + c - n + 1] if c >= n else gram_hashes(words[at : at + c], c) if c else grams[:0]
        at += c


def shingle_pairs(texts: list[bytes], n: int = 5, seed: int = 0):
    """Per text its distinct n-grams as 128-bit hashes, ordered: two arrays of 64
    bits, the first as in ``shingle_sets``, the second of the next seed."""
    words, counts = word_hashes(texts, True, seed)
    others, _ = word_hashes(texts, True, seed + 1)
    for a, b in zip(_grams_of(words, counts, n), _grams_of(others, counts, n), strict=True):
        order = np.argsort(a)
        a, b = a[order], b[order]
        same = a[1:] == a[:-1]
        if (same & (b[1:] != b[:-1])).any():
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        new = np.concatenate((np.ones(min(len(a), 1), bool), ~same))
        yield a[new], b[new]


def exact_shingles(text: bytes, n: int = 5) -> set[bytes]:
    """The distinct n-grams of a text as their words; lower case."""
    words = text.lower().split()
    if len(words) < n:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}
