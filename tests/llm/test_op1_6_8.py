import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from data import SCHEMA, awkward, frame, words, write

from rasterloom.llm import exact_dedup, packing, sharding


def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


@pytest.mark.parametrize("keep,best", [("min", min), ("max", max)])
def test_exact_dedup(spark, keep, best):
    rows = awkward()
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    got = exact_dedup.exact_dedup(frame(spark, rows), keep=keep).collect()
    assert len(got) == len(rows)
    sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = [i for i in sha[r.text_sha256] if i is not None]
        assert r.group_size == len(sha[r.text_sha256]) and r.keep_id == (best(ids) if ids else None)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert kept == Counter(dict.fromkeys(sha, 1))
    left = exact_dedup.drop_copies(frame(spark, rows), keep=keep)
    assert left.columns == frame(spark, rows).columns
    assert Counter(lower(r.text) for r in left.collect()) == Counter(dict.fromkeys(groups, 1))
    assert exact_dedup.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_exact_dedup_collision(spark, monkeypatch):
    """With a hash that always collides, the bytes still tell texts apart."""
    from pyspark.sql import functions as F

    rows = awkward()
    want = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(frame(spark, rows)).collect())
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("ab"))
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(frame(spark, rows)).collect())
    assert got == want


def test_sharding(spark, tmp_path):
    rows = awkward(n=300) + [(1000 + i, "the same text in many rows", None, None, None, None, None) for i in range(400)]
    sf = write(spark, tmp_path, rows)
    got = sharding.op6_sharding(spark, sf).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots, size = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(16))
    total, longest = sum(size.values()), max(r.size for r in got)
    rest = (total - longest) / 15
    assert all(abs(size[s] - rest) <= 0.02 * rest for s in range(16) if size[s] != longest)

    # in a shard rows lie by size class, so that one rule holds for all sizes
    for k in range(16):
        mine = [r.size for r in sorted((r for r in got if r.shard == k), key=lambda r: r.slot)]
        classes = [0 if s < 2 else -(-s.bit_length() // 2) for s in mine]
        assert classes == sorted(classes, reverse=True)
    sharding.write_shards(spark.read.parquet(f"{sf}/documents.parquet"), f"{sf}/out")
    back = spark.read.parquet(f"{sf}/out")
    assert back.count() == len(rows) and {"shard", "slot", "_k1"} <= set(back.columns)
    write(spark, tmp_path / "none", [])
    assert sharding.op6_sharding(spark, str(tmp_path / "none")).count() == 0


def test_shard_on_clashing_columns(spark):
    names = "shard int, Slot string, _before long, _place long, _n int, _a int, _b int, _k1 long, _pid int, _mid long, _row long, _kind int, id long"
    rows = spark.createDataFrame([(*[None] * 12, i) for i in range(50)], names)
    from pyspark.sql import functions as F

    out = sharding.shard(rows, F.col("id"), F.col("id"), F.lit(10), 4)
    assert out.columns == ["_before", "_place", "_n", "_a", "_b", "_k1", "_pid", "_mid", "_row", "_kind", "id", "shard", "slot"]
    got = out.collect()
    assert sorted(r.id for r in got) == list(range(50)) and max(Counter(r.shard for r in got).values()) == 13


def test_splitters_against_sorted_rows(spark):
    """Boundaries are the best of all row borders, by brute force over the sorted keys."""
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(1 << 60)), int(rng.integers(1 << 60)), int(rng.integers(1, 500))) for _ in range(3000)] + [(7 << 40, int(rng.integers(1 << 60)), 300) for _ in range(1500)]
    table = spark.createDataFrame(rows, "k1 long, k2 long, size long").cache()
    total = sum(r[2] for r in rows)
    targets = [total * i / 9 for i in range(1, 9)]
    bounds, below = sharding.splitters(table, targets, 0.0)
    edges = np.concatenate(([0], np.cumsum([s for *_, s in sorted(rows)])))
    for t, b, got in zip(targets, bounds, below, strict=True):
        assert got == sum(s for *k, s in rows if tuple(k) < b)
        assert abs(got - t) == np.abs(edges - t).min()


def test_room_levels_the_shards():
    assert sharding.room([5, 0, 1], 4) == [0.0, 2.5, 1.5]
    assert sharding.room([0, 0], 4) == [2.0, 2.0] and sharding.room([9, 1], 0) == [0.0, 0.0]


def test_sharding_even_without_long_texts(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20_000).select("id", (F.col("id") % 3 == 0).alias("hot"), (F.col("id") % 90 + 10).alias("size"))
    out = sharding.shard(rows, F.when(F.col("hot"), F.lit(-1)).otherwise(F.col("id")), F.col("id"), F.col("size"))
    size = [r[0] for r in out.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(size) == 16 and max(size) - min(size) <= 0.01 * sum(size) / 16


def test_packing(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = awkward()
    got = packing.op8_packing(spark, write(spark, tmp_path, rows)).collect()
    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [1])) for i, t, *_ in rows)
    full = packing.pack(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    assert sorted(map(str, [(r.doc_id, r.start, r.length, zlib.crc32(r.ids)) for r in full])) == sorted(map(str, [(r.doc_id, r.start, r.length, r.ids_crc32) for r in got]))
    seqs = defaultdict(list)
    for r in full:
        seqs[r.sequence_id].append(r)
        assert r.length > 0 and len(r.ids) == 4 * r.length
    stream, ends = [], []
    for s in range(len(seqs)):
        at = 0
        for r in sorted(seqs[s], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
            stream.append(r)
        assert at == 2048 or s == len(seqs) - 1
    docs, i = Counter(), 0
    while i < len(stream):
        first, ids = stream[i], []
        while len(ids) < first.doc_tokens:
            assert stream[i].start == len(ids) and stream[i].doc_id == first.doc_id
            ids += np.frombuffer(stream[i].ids, "<u4").tolist()
            i += 1
        docs[(first.doc_id, tuple(ids))] += 1
    assert docs == want
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_small_groups_stay_whole(spark, tmp_path):
    """Only groups that smaller texts can't even out are parted, and sizes are near equal still."""
    rng = random.Random(3)
    texts = [words(rng, rng.randrange(1, 400)) for _ in range(900)]
    texts += [t for t in rng.sample(texts, 120) for _ in range(rng.randrange(1, 4))] + ["a hot text of many rows " * 9] * 700
    rows = [(i, t, None, None, None, None, None) for i, t in enumerate(texts)]
    got = sharding.op6_sharding(spark, write(spark, tmp_path, rows)).collect()
    size, where, held = Counter(), defaultdict(set), Counter()
    for r in got:
        size[r.shard] += r.size
        where[texts[r.doc_id]].add(r.shard)
        held[texts[r.doc_id]] += r.size
    mean = sum(size.values()) / 16
    assert max(abs(size[s] - mean) for s in range(16)) <= 0.01 * mean
    classes = {t: 0 if len(t) < 1 else -(-(len(t) + 1).bit_length() // 2) for t in held}
    for t, shards in where.items():
        smaller = sum(b for x, b in held.items() if classes[x] < classes[t])
        assert len(shards) == 1 or held[t] > smaller / 16 / 2
    assert sum(len(s) > 1 for s in where.values()) <= 3
