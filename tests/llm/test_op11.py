import random
import zlib
from collections import Counter
from hashlib import sha256

import pytest
from data import SCHEMA, awkward, frame, words, write

from rasterloom.llm import base, merkle, registry


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves, fanout):
    """(root, proof per leaf); a proof is a list of (left, right) texts."""
    proofs, level, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(level) > 1:
        for i, k in enumerate(at):
            a = k // fanout * fanout
            proofs[i].append(("".join(level[a:k]), "".join(level[k + 1 : a + fanout])))
        level = [h(*level[a : a + fanout]) for a in range(0, len(level), fanout)]
        at = [k // fanout for k in at]
    return level[0], proofs


def plain(rows, fanout=2):
    """(id, leaf, subroot, root, proof, folded root) of rows (id, text, lang, source, n_chars)."""
    groups = {}
    for i, text, lang, source, n, *_ in rows:
        leaf = h(*map(field, (i, source, lang, n, text)))
        changed = n is not None and i is not None and zlib.crc32(str(i).encode()) % 7 == 0
        claim = h(*map(field, (i, source, lang, n + 1, text))) if changed else leaf
        groups.setdefault(lang, []).append((i is not None, i, leaf, claim))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0], r[1] or 0, r[2]))
        below[g] = tree([r[2] for r in groups[g]], fanout)
    if not order:
        return []
    root, above = tree([below[g][0] for g in order], fanout)
    out = []
    for g, up in zip(order, above, strict=True):
        for (_, i, leaf, claim), proof in zip(groups[g], below[g][1], strict=True):
            x = claim
            for a, b in proof + up:
                x = h(a, x, b)
            out.append((i, leaf, below[g][0], root, h(*[a + b for a, b in proof + up]), x))
    return out


def wide(n=700):
    rng = random.Random(11)
    rows = [(i, words(rng, 5), rng.choice(["en", "de", None, "", "é", "a"]), None, rng.choice([None, 5]), None, None) for i in rng.sample(range(-500, 5000), n)]
    return rows + [(9000, "only", "zz", "s", 1, None, None)]


@pytest.mark.parametrize("rows", [awkward(), wide(), wide(0), []])
def test_registered(spark, tmp_path, rows):
    got = registry.QUERIES["op11_merkle"](spark, write(spark, tmp_path, rows)).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter((i, leaf, sub, root, proof, folded) for i, leaf, sub, root, proof, folded in plain(rows))
    assert all(r.verified == (r.folded_root == r.root) for r in got)
    if len(rows) > 500:
        assert {r.doc_id for r in got if not r.verified} == {r[0] for r in rows if r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0}


@pytest.mark.parametrize("fanout,levels", [(2, 1), (2, 3), (3, 2), (5, 1), (16, 3)])
def test_rounds_and_fanouts(spark, fanout, levels):
    """Several superblock rounds give the proofs of one plain tree."""
    rows = wide(260)
    got = merkle.manifest(frame(spark, rows), fanout=fanout, levels=levels)
    got = got.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(got.left, got.right), merkle.fold(got.leaf, got.left, got.right)).collect()
    want = {r[0]: r for r in plain(rows, fanout)}
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[:5] == want[r.doc_id][:5] and r[5] == r.root


def test_numbered(spark):
    """Places have no gaps, even if most rows are equal."""
    rows = [("a", 1, k) for k in range(300)] + [("b", k, 0) for k in range(40)] + [("a", 0, 0)]
    df = spark.createDataFrame(rows, "g string, x long, tie long").repartition(5)
    got = merkle.numbered(df, "g", ["x", "tie"], "idx", base.Scratch(spark, "t")).collect()
    assert sorted(map(tuple, got)) == sorted([("a", 0, 0, 0), *[("a", 1, k, k + 1) for k in range(300)], *[("b", k, 0, k) for k in range(40)]])


def test_bad_tree(spark):
    with pytest.raises(ValueError):
        merkle.manifest(spark.createDataFrame([], SCHEMA), fanout=1)
