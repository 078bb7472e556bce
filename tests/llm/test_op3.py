import functools
import math
import random
from collections import Counter

import numpy as np
from data import SCHEMA, awkward, frame

from rasterloom.llm import sentencepiece_codec as spc


def brute_score(text, pieces, scores, byte_score):
    """Best total score of any segmentation, by recursion over the whole text."""
    by = dict(zip(pieces, scores, strict=True))
    longest = max(map(len, pieces))

    @functools.cache
    def best(i):
        if i == len(text):
            return 0.0
        out = [by[text[i:j]] + best(j) for j in range(i + 1, min(len(text), i + longest) + 1) if text[i:j] in by]
        return max([*out, byte_score * len(text[i].encode()) + best(i + 1)])

    return best(0)


def test_viterbi_is_optimal():
    rng = random.Random(2)
    pieces = [spc.MARK, spc.MARK * 2, "a", "b", "ab", "ba", "aab", spc.MARK + "a", spc.MARK + "ab", "é", "bé"]
    scores = [-rng.random() * 9 for _ in pieces]
    trie = spc.DoubleArray([(p.encode(), i + 300) for i, p in enumerate(pieces)])
    enc = spc.Encoder(trie, [0.0] * 300 + scores, {b: b for b in range(256)}, True)
    for _ in range(500):
        t = "".join(rng.choice(["a", "b", " ", "é", "c", "漢", "\n"]) for _ in range(rng.randrange(1, 14)))
        ids = np.frombuffer(enc(t), np.int32).tolist()
        got = sum(scores[i - 300] if i >= 300 else spc.BYTE_SCORE for i in ids)
        assert abs(got - brute_score(spc.MARK + t.replace(" ", spc.MARK), pieces, scores, spc.BYTE_SCORE)) < 1e-6
        assert spc.decode_ids(ids, [bytes([b]) for b in range(256)] + [b""] * 44 + [p.encode() for p in pieces]) == t


def test_round_trip(spark):
    rows = awkward() + [(900, "  two  spaces and tail ", None, None, None, None, None), (901, "漢字 🎉 é\n\n x", None, None, None, None, None)]
    back = spc.decode(spc.encode(frame(spark, rows)))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r[0], r[1] or "") for r in rows)
    assert spc.decode(spc.encode(spark.createDataFrame([], SCHEMA))).count() == 0


def test_double_array_holds_every_piece():
    model = spc.Model.load(spc.model_path())
    trie = spc.DoubleArray([(p.encode(), i) for i, p in enumerate(model.pieces) if i not in model.skip])
    for i in range(300, len(model.pieces), 97):
        slot = 0
        for c in model.pieces[i].encode():
            t = trie.base[slot] + c + 1
            assert trie.check[t] == slot
            slot = t
        assert trie.value[slot] == i


MARKED = ["a 5  b", "in 2024, 17 of 300", "  two   spaces and tail  ", "漢字 日本 5 🎉 x", "a" + " " * 17 + "b 9", "é 名前 10\n 3  ٣", " "]


def test_real_model_against_brute_force():
    """Marks have pieces of their own: before digits, in runs and before unmarked characters."""
    model = spc.Model.load(spc.model_path())
    kept = [i for i in range(len(model.pieces)) if i not in model.skip]
    enc = spc.Encoder(spc.DoubleArray([(model.pieces[i].encode(), i) for i in kept]), model.scores, model.bytes, True)
    byte_ids = set(model.bytes.values())
    covered = {model.pieces[i] for i in kept}
    for t in MARKED:
        marked = spc.MARK + t.replace(" ", spc.MARK)
        ids = np.frombuffer(enc(t), np.int32).tolist()
        got = sum(spc.BYTE_SCORE if i in byte_ids else model.scores[i] for i in ids)
        want = brute_score(marked, [model.pieces[i] for i in kept], [model.scores[i] for i in kept], spc.BYTE_SCORE)
        assert abs(got - want) < 1e-6
        assert sum(i in byte_ids for i in ids) == sum(len(c.encode()) for c in marked if c not in covered)


def test_scores_are_log_probabilities():
    """Ranks become log probabilities, so frequent words stay whole."""
    model = spc.Model.load(spc.model_path())
    kept = [i for i in range(len(model.pieces)) if i not in model.skip]
    assert abs(sum(math.exp(model.scores[i]) for i in kept) - 1) < 1e-9
    assert all(model.scores[a] > model.scores[b] for a, b in zip(kept, kept[1:], strict=False))
    enc = spc.Encoder(spc.DoubleArray([(model.pieces[i].encode(), i) for i in kept]), model.scores, model.bytes, True)
    ids = np.frombuffer(enc("the Device international"), np.int32).tolist()
    assert [model.pieces[i] for i in ids] == ["▁the", "▁Device", "▁international"]
    assert spc.log_scores([0.0, -1.5, -2.25], {0}) == [0.0, -1.5, -2.25]
