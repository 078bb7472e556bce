"""Operators over many images at once, against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import queries
from rasterloom.functions import fixed
from rasterloom.operators import bitpack, dct, entropy, palette, planes, recovery, scan_symbols, smoothing
from rasterloom.operators import blocks as B
from rasterloom.plans.transform import TransformOptions, transform_images
from rasterloom.streaming import progressive

RNG = random.Random(7)


# Inverse transforms to any size


def plain_inverse(block, size):
    """One output after the other with real cosines, not rounded before the end."""
    out = []
    for y in range(size):
        for x in range(size):
            total = 0.0
            for r in range(min(size, 8)):
                for c in range(min(size, 8)):
                    w = (1 if r == 0 else math.sqrt(2)) * (1 if c == 0 else math.sqrt(2))
                    total += w * block[r * 8 + c] * math.cos((2 * y + 1) * r * math.pi / (2 * size)) * math.cos((2 * x + 1) * c * math.pi / (2 * size))
            out.append(min(255, max(0, total / 8 + 128)))
    return out


@pytest.mark.parametrize("size", [1, 3, 5, 6, 7, 9, 10, 11, 12, 13, 14, 15, 16])
def test_sizes_are_cosine_transforms(size):
    x = np.array([[RNG.randrange(-300, 300) if k < 3 else RNG.randrange(-60, 60) for k in range(64)] for _ in range(6)])
    got = dct.inverse_integer(x, size)
    want = np.array([plain_inverse(b, size) for b in x])
    assert got.shape == (6, size * size) and np.abs(got - want).max() <= 1.0


def test_weights_by_hand():
    """Size 3: factors 0.707106781 and 1.224744871 in 13 bits, the first taken twice for the middle."""
    a, b = int(0.707106781 * 8192 + 0.5), int(1.224744871 * 8192 + 0.5)
    assert dct.INVERSE[3][0].tolist() == [[8192, b, a, 0, 0, 0, 0, 0], [8192, 0, -2 * a, 0, 0, 0, 0, 0], [8192, -b, a, 0, 0, 0, 0, 0]]
    # size 6: a sum of two products for the odd frequencies 1 and 3 of the first output
    c = int(0.366025404 * 8192 + 0.5)
    assert dct.INVERSE[6][0][0].tolist() == [8192, c + 8192, b, 8192, a, c, 0, 0]
    for n, (w, _) in dct.INVERSE.items():
        assert (w[::-1] == w * np.array([1, -1] * 4)).all(), n


def test_mixed_sizes(spark):
    rows = [(i, [RNG.randrange(-200, 200) for _ in range(64)], RNG.choice([*range(0, 18), None]), [RNG.randrange(1, 4) for _ in range(64)]) for i in range(80)]
    rows += [(100, None, 8, [1] * 64), (101, [1] * 63, 8, [1] * 64), (102, [1] * 64, 8, None), (103, [None] * 64, 3, [1] * 64)]
    df = spark.createDataFrame(rows, "id long, block array<long>, size int, q array<long>")
    got = {r.id: r.block for r in dct.inverse_sizes(df, quant="q").collect()}
    for i, b, n, q in rows:
        if i >= 100 or n not in dct.SIZES:
            assert got[i] is None
        else:
            assert got[i] == dct.inverse_integer(np.array([b]) * np.array([q]), n)[0].tolist()
    assert dct.inverse_sizes(df.limit(0)).count() == 0


# Smoothing


def plain_smooth(blocks, width, height, bits, quant):
    """In place, in reading order, one block after the other."""
    known = {1: (1, "01"), 2: (8, "10"), 3: (16, "20"), 4: (9, "11"), 5: (2, "02"), 6: (3, "03"), 7: (10, "12"), 8: (17, "21"), 9: (24, "30")}
    change = all(b == -1 for b in bits[1:])
    out = [list(b) for b in blocks]
    for y in range(height):
        for x in range(width):
            near = [[out[min(height - 1, max(0, y + i)) * width + min(width - 1, max(0, x + j))][0] for j in range(-2, 3)] for i in range(-2, 3)]
            new = list(out[y * width + x])
            tables = smoothing.UNKNOWN if change else smoothing.KNOWN
            for z, (k, _) in known.items():
                if z in tables and bits[z] != 0 and new[k] == 0:
                    num = quant[0] * sum(tables[z][5 * i + j] * near[i][j] for i in range(5) for j in range(5))
                    p = ((quant[k] << 7) + abs(num)) // (quant[k] << 8)
                    if bits[z] > 0 and p >= 1 << bits[z]:
                        p = (1 << bits[z]) - 1
                    new[k] = p if num >= 0 else -p
            if change:
                num = quant[0] * sum(tables[0][5 * i + j] * near[i][j] for i in range(5) for j in range(5))
                p = ((quant[0] << 7) + abs(num)) // (quant[0] << 8)
                new[0] = p if num >= 0 else -p
            out[y * width + x] = new
    return out


def test_stencils():
    """Weights of a flat neighbourhood: DC keeps its value, AC is none; gradients by hand."""
    for z, w in smoothing.UNKNOWN.items():
        assert sum(w) == (256 if z == 0 else 0)
    assert all(sum(w) == 0 for w in smoothing.KNOWN.values())
    assert smoothing.KNOWN[2] == [0, 0, -7, 0, 0, 0, 0, 50, 0, 0, 0, 0, 0, 0, 0, 0, 0, -50, 0, 0, 0, 0, 7, 0, 0]
    assert smoothing.KNOWN[3] == [0, 0, -1, 0, 0, 0, 0, 13, 0, 0, 0, 0, -24, 0, 0, 0, 0, 13, 0, 0, 0, 0, -1, 0, 0]
    assert smoothing.UNKNOWN[3] == [0, 0, 1, 0, 0, 0, 2, 7, 2, 0, 0, -5, -14, -5, 0, 0, 2, 7, 2, 0, 0, 0, 1, 0, 0]
    assert smoothing.UNKNOWN[9] == [0, 0, 0, 0, 0, 0, 1, 2, 1, 0, 0, 0, 0, 0, 0, 0, -1, -2, -1, 0, 0, 0, 0, 0, 0]
    assert smoothing.UNKNOWN[8] == [0, 0, 0, 0, 0, 0, 1, 0, -1, 0, 0, -3, 0, 3, 0, 0, 1, 0, -1, 0, 0, 0, 0, 0, 0]


def test_smoothing_of_many_images(spark):
    sizes = {1: (7, 5), 2: (1, 6), 3: (6, 1), 4: (2, 2), 5: (1, 1), 6: (9, 8), 7: (4, 3), 8: (3, 3), 9: (5, 4)}
    bits = {1: [0] + [-1] * 9, 2: [2] + [-1] * 9, 3: [0] + [-1] * 9, 4: [1] + [-1] * 9, 5: [0] + [-1] * 9, 6: [0, 2, 0, -1, 1, 3, 0, 0, 0, 0], 7: [0] * 10, 8: [-1] * 10, 9: [1, 1, 1, 1, 1, 1, -1, -1, -1, -1]}
    quant = {i: [RNG.randrange(1, 40) for _ in range(64)] for i in sizes}
    blocks, rows = {}, []
    for i, (w, h) in sizes.items():
        blocks[i] = [[RNG.randrange(-200, 200) if k == 0 else RNG.choice([0, 0, 3, -2]) for k in range(64)] for _ in range(w * h)]
        rows += [(i, 0, n % w, n // w, b) for n, b in enumerate(blocks[i])]
    rows.append((99, 0, 0, 0, [0] * 64))
    RNG.shuffle(rows)
    df = spark.createDataFrame(rows, "image int, component int, gx int, gy int, block array<int>").repartition(3)
    tables = spark.createDataFrame([(i, 0, b) for i, b in bits.items()], "image int, component int, bits array<int>")
    quants = spark.createDataFrame([(i, 0, q) for i, q in quant.items()], "image int, component int, quant array<int>")
    got = {(r.image, r.gx, r.gy): r.block for r in smoothing.smooth(df, tables, quants).collect()}
    assert len(got) == len(rows) and got[99, 0, 0] == [0] * 64
    for i, (w, h) in sizes.items():
        want = blocks[i] if i in (7, 8) else plain_smooth(blocks[i], w, h, bits[i], quant[i])
        assert all(got[i, n % w, n // w] == b for n, b in enumerate(want)), i
    zero = quants.withColumn("quant", F.transform("quant", lambda q, k: F.when(k == 10, 0).otherwise(q)))
    same = {(r.image, r.gx, r.gy): r.block for r in smoothing.smooth(df, tables, zero).collect()}
    assert all(same[r[0], r[2], r[3]] == r[4] for r in rows)


def test_bits_of_scans(spark):
    scans = [(1, 0, 0, 0, 0, 1), (1, 1, 0, 1, 5, 2), (1, 2, 0, 3, 63, 1), (1, 3, 0, 0, 0, 0), (2, 0, 1, 0, 63, 0)]
    got = {(r.image, r.component): r.bits for r in smoothing.coefficient_bits(spark.createDataFrame(scans, "image int, scan int, component int, ss int, se int, al int")).collect()}
    assert got == {(1, 0): [0, 2, 2, 1, 1, 1, 1, 1, 1, 1], (2, 1): [0] * 10}


# Palettes by image


def half_away(v):
    return math.floor(v + 0.5) if v >= 0 else math.ceil(v - 0.5)


def plain_diffusion(image, width, height, entries):
    buffer = [[float(v) for v in p] for p in image]
    out = []
    for y in range(height):
        for x in range(width):
            shown = [min(255, max(0, half_away(v))) for v in buffer[y * width + x]]
            at = min(range(len(entries)), key=lambda i: (sum((a - b) ** 2 for a, b in zip(shown, entries[i], strict=True)), i))
            out.append(at)
            for dy, dx, share in ((0, 1, 7), (1, -1, 3), (1, 0, 5), (1, 1, 1)):
                if y + dy < height and 0 <= x + dx < width:
                    for c in range(3):
                        buffer[(y + dy) * width + x + dx][c] += (shown[c] - entries[at][c]) * share / 16
    return out


def test_error_diffusion_of_many_images(spark):
    sizes = {1: (9, 7), 2: (1, 5), 3: (6, 1), 4: (1, 1), 5: (12, 12)}
    images = {i: [tuple(RNG.randrange(256) for _ in range(3)) for _ in range(w * h)] for i, (w, h) in sizes.items()}
    rows = [(i, n // sizes[i][0], n % sizes[i][0], *p, f"p{n}") for i, ps in images.items() for n, p in enumerate(ps)]
    RNG.shuffle(rows)
    df = spark.createDataFrame(rows, "image int, y int, x int, r long, g long, b long, note string").repartition(3)
    for method, colors in (("median_cut", 5), ("uniform", 27), ("uniform", 3)):
        entries, got = palette.quantize_images(df, colors, method, "diffused")
        tables = {}
        for r in entries.collect():
            tables.setdefault(r.image, {})[r.idx] = (r.r, r.g, r.b)
        got = {(r.image, r.y, r.x): (r.idx, r.note) for r in got.collect()}
        assert len(got) == len(rows)
        for i, (w, h) in sizes.items():
            want = plain_diffusion(images[i], w, h, [tables[i][k] for k in sorted(tables[i])])
            assert [got[i, n // w, n % w] for n in range(w * h)] == [(k, f"p{n}") for n, k in enumerate(want)]
    with pytest.raises(ValueError):
        palette.quantize_images(df, 5, dither="diffused", keys=())


@pytest.mark.parametrize("dither", ["none", "ordered"])
def test_images_are_quantized_one_by_one(spark, dither):
    rows = [(i, y, x, *[RNG.randrange(256) for _ in range(3)]) for i in range(3) for y in range(6) for x in range(5)]
    df = spark.createDataFrame(rows, "image int, y int, x int, r long, g long, b long")
    got = {(r.image, r.y, r.x): r.idx for r in palette.quantize_images(df, 6, "median_cut", dither)[1].collect()}
    for i in range(3):
        alone = palette.quantize(df.filter(F.col("image") == i).drop("image"), 6, "median_cut", dither)[1].collect()
        assert all(got[i, r.y, r.x] == r.idx for r in alone) and len(alone) == 30


# Bit packing


def plain_bits(blocks, dc, ac, restart):
    """A bit writer: {segment: bytes} of blocks of zigzag coefficients."""
    out, bits, before = {}, "", 0

    def put(table, symbol):
        code, length = table[symbol]
        return f"{code:0{length}b}"

    def low(v):
        size = abs(v).bit_length()
        return f"{v if v >= 0 else v + (1 << size) - 1:0{size}b}" if size else ""

    def close(segment):
        data = bits + "1" * (-len(bits) % 8)
        out[segment] = bytes(b for k in range(0, len(data), 8) for b in ([255, 0] if data[k : k + 8] == "1" * 8 else [int(data[k : k + 8], 2)]))

    for n, block in enumerate(blocks):
        if restart and n and n % restart == 0:
            close(n // restart - 1)
            bits, before = "", 0
        d, before = block[0] - before, block[0]
        bits += put(dc, abs(d).bit_length()) + low(d)
        run = 0
        for v in block[1:]:
            if v == 0:
                run += 1
                continue
            while run > 15:
                bits += put(ac, 240)
                run -= 16
            bits += put(ac, run << 4 | abs(v).bit_length()) + low(v)
            run = 0
        if run:
            bits += put(ac, 0)
    close((len(blocks) - 1) // restart if restart else 0)
    return out


def tables_of(spark):
    dc = entropy.canonical_codes(spark, fixed.DC_LUMA_BITS, list(range(12)))
    ac = entropy.canonical_codes(spark, fixed.AC_LUMA_BITS, fixed.AC_LUMA)
    both = dc.withColumn("kind", F.lit("dc")).unionByName(ac.withColumn("kind", F.lit("ac")))
    codes = {"dc": {}, "ac": {}}
    for r in both.collect():
        codes[r.kind][r.symbol] = (r.code, r.length)
    return both, codes


def made_blocks(n):
    """Sparse, dense, empty and long-run blocks; large values make bytes of ones."""
    out = []
    for _ in range(n):
        kind = RNG.randrange(5)
        block = [0] * 64
        block[0] = RNG.choice([0, 1000, -1000, RNG.randrange(-1023, 1023)])
        for k in range(1, 64):
            if kind == 1 or (kind == 2 and RNG.random() < 0.1) or (kind == 3 and k in (17, 49)) or (kind == 4 and k == 63):
                block[k] = RNG.choice([1023, -1, 1, 511, RNG.randrange(-1023, 1024)])
        out.append(block)
    return out


@pytest.mark.parametrize("restart", [0, 3, 1])
def test_packing_against_a_bit_writer(spark, monkeypatch, restart):
    monkeypatch.setattr(bitpack, "RANGE", 4)
    monkeypatch.setattr(bitpack, "BYTES", 16)
    monkeypatch.setattr(entropy, "RANGE", 4)
    both, codes = tables_of(spark)
    images = {i: made_blocks(n) for i, n in ((1, 13), (2, 1), (3, 6))}
    rows = [(i, n, z, v) for i, blocks in images.items() for n, b in enumerate(blocks) for z, v in enumerate(b) if v or z == 0 or RNG.random() < 0.2]
    RNG.shuffle(rows)
    coeffs = spark.createDataFrame(rows, "image int, id int, z int, v int").repartition(3)
    chunks = bitpack.pack(bitpack.code_words(bitpack.block_symbols(coeffs, restart), both), chunk=50)
    got = {}
    for r in sorted(chunks.collect(), key=lambda r: (r.image, r.segment, r.chunk)):
        got.setdefault(r.image, {}).setdefault(r.segment, []).append(bytes(r.content))
    for i, blocks in images.items():
        want = plain_bits(blocks, codes["dc"], codes["ac"], restart)
        assert {s: b"".join(c) for s, c in got[i].items()} == want
        assert all(len(c) == 50 for cs in got[i].values() for c in cs[:-1])
    # with markers in between, and cut again
    scans = {}
    for r in sorted(bitpack.with_markers(chunks).collect(), key=lambda r: (r.image, r.segment, r.chunk)):
        scans[r.image] = scans.get(r.image, b"") + bytes(r.content)
    files = spark.createDataFrame([(i, bytearray(b"head" + s + b"\xff\xd9")) for i, s in scans.items()], "id int, content binary").withColumn("start", F.lit(4))
    cut = {}
    for r in bitpack.restart_segments(files).collect():
        assert r.marker == ((r.segment - 1) % 8 if r.segment else -1)
        cut[r.id, r.segment] = bytes(r.bytes)
    assert cut == {(i, s): b.replace(b"\xff\x00", b"\xff") for i, blocks in images.items() for s, b in plain_bits(blocks, codes["dc"], codes["ac"], restart).items()}


def test_a_symbol_without_code(spark):
    both, _ = tables_of(spark)
    coeffs = spark.createDataFrame([(1, 0, 0, 1 << 13)], "image int, id int, z int, v int")
    with pytest.raises(Exception, match="no code for symbol"):
        bitpack.pack(bitpack.code_words(bitpack.block_symbols(coeffs), both)).collect()


@pytest.mark.parametrize("data,want", [
    (b"", [(0, -1, b"")]), (b"ab\xff\x00c\xff", [(0, -1, b"ab\xffc")]), (b"a\xff\xd3b\xff\xd4\xff\xd9zz", [(0, -1, b"a"), (1, 3, b"b"), (2, 4, b"")]),
    (b"\xff\xff\xd0x\ny\xff\xff\xc4q", [(0, -1, b""), (1, 0, b"x\ny")]), (b"\xff\xff\x00a", [(0, -1, b"\xffa")]),
])
def test_restart_segments(spark, data, want):
    files = spark.createDataFrame([(1, bytearray(b"\xff\xd8" + data), 2), (2, None, 0), (3, bytearray(b"x"), 9)], "id int, content binary, start int")
    rows = bitpack.restart_segments(files).collect()
    assert sorted((r.segment, r.marker, bytes(r.bytes)) for r in rows if r.id == 1) == want
    assert [(r.segment, bytes(r.bytes)) for r in rows if r.id == 3] == [(0, b"")] and not [r for r in rows if r.id == 2]


def test_long_scans_are_cut(spark):
    """A scan of 3 MB without a marker, and one of 100,000 segments."""
    one, many = bytes(range(255)) * 12_000, b"\xff\xd0".join([b"ab"] * 100_000)
    files = spark.createDataFrame([(1, bytearray(one), 0), (2, bytearray(many), 0)], "id int, content binary, start int")
    got = {r.id: (r.n, r.size) for r in bitpack.restart_segments(files).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("bytes")).alias("size")).collect()}
    assert got == {1: (1, len(one)), 2: (100_000, 200_000)}


# Progressive scans


def plain_scan(block, ss, se, al, refine):
    """(symbols, known bits) of one block of zigzag coefficients, position by position."""
    t = [abs(v) >> al for v in block]
    out, run, known = [], 0, 0
    last = max((k for k in range(ss, se + 1) if (t[k] == 1 if refine else t[k])), default=ss - 1)
    for k in range(ss, se + 1):
        if t[k] == 0:
            run += 1
            continue
        while run > 15 and k <= last:
            out.append(240)
            run -= 16
        if refine and t[k] > 1:
            known += 1
            continue
        out.append(run << 4 | (1 if refine else t[k].bit_length()))
        run = 0
    return (out + [0] if run else out), known


def test_scan_symbols(spark):
    blocks = {1: made_blocks(9), 2: made_blocks(4), 3: [[5] + [0] * 63]}
    for b in blocks[1]:
        for k in range(1, 64):
            if RNG.random() < 0.3:
                b[k] = RNG.choice([0, 1, -2, 3, 4, -9])
    rows = [(i, n, z, v) for i, bs in blocks.items() for n, b in enumerate(bs) for z, v in enumerate(b) if v or z == 0 or RNG.random() < 0.3]
    coeffs = spark.createDataFrame(rows, "image int, id int, z int, v int").repartition(3)
    scans = [(0, 1, 5, 0), (1, 6, 63, 1), (2, 1, 63, 0), (3, 10, 10, 2)]
    table = spark.createDataFrame(scans, "scan int, ss int, se int, al int")
    for refine, run in ((False, scan_symbols.first_frequencies), (True, scan_symbols.refine_frequencies)):
        want, bits = {}, {}
        for i, bs in blocks.items():
            for n, ss, se, al in scans:
                for b in bs:
                    symbols, known = plain_scan(b, ss, se, al, refine)
                    bits[i, n] = bits.get((i, n), 0) + known
                    for s in symbols:
                        want[i, n, s] = want.get((i, n, s), 0) + 1
        assert {(r.image, r.scan, r.symbol): r.n for r in run(coeffs, table, ("image",)).collect()} == want
    assert {(r.image, r.scan): r.n for r in scan_symbols.correction_bits(coeffs, table, ("image",)).collect()} == bits


def test_runs_of_ends_of_band(spark, monkeypatch):
    monkeypatch.setattr(scan_symbols, "RANGE", 4)
    blocks = {1: [[1] + [0] * 63 for _ in range(23)], 2: [[1] + [0] * 63 for _ in range(40)]}
    for k, z in ((3, 5), (4, 63), (5, 7), (16, 63), (17, 2)):
        blocks[1][k][z] = 7
    rows = [(i, n, z, v) for i, bs in blocks.items() for n, b in enumerate(bs) for z, v in enumerate(b) if v]
    coeffs = spark.createDataFrame(rows, "image int, id int, z int, v int").repartition(3)
    table = spark.createDataFrame([(0, 1, 63, 0), (1, 1, 5, 0)], "scan int, ss int, se int, al int")
    got = {}
    for r in scan_symbols.end_runs(coeffs, table, ("image",), longest=6).collect():
        assert r.symbol == r.size * 16 and r.blocks == (1 << r.size) + r.bits
        got.setdefault((r.image, r.scan), []).append((r.start, r.part, r.blocks))
    for i, bs in blocks.items():
        for n, ss, se, _ in [(0, 1, 63, 0), (1, 1, 5, 0)]:
            want, run, start = [], 0, 0

            def flush():
                part = 0
                while run - 6 * part > 0:
                    want.append((start, part, min(6, run - 6 * part)))  # noqa: B023
                    part += 1

            for k, b in enumerate(bs):
                held = [z for z in range(ss, se + 1) if b[z]]
                if held:
                    flush()
                    run = 0
                if not held or held[-1] < se:
                    start, run = (k if run == 0 else start), run + 1
            flush()
            assert sorted(got[i, n]) == sorted(want)


# Transforms of many images


def test_transforms_of_many_images(spark):
    """One job over images with options of their own gives what one image at a time does."""
    options, sizes = {}, {}
    n = 0
    for op in B.OPS:
        for trim, mcu, crop in ((False, (8, 8), None), (True, (16, 8), None), (False, (16, 16), (9, 17, 20, 11)), (True, (8, 16), (0, 5, 100, 30))):
            n += 1
            sizes[n] = (RNG.randrange(33, 60), RNG.randrange(33, 60))
            options[n] = TransformOptions(op, trim=trim, grayscale=n % 3 == 0, crop=crop, mcu=mcu)
    rows, images = [], []
    for i, o in options.items():
        w, h = sizes[i]
        images.append((i, w, h, o.op, False, o.trim, o.grayscale, *o.mcu, o.crop))
        rows += [(i, comp, x, y, k, RNG.randrange(-50, 50)) for comp in (0, 1) for y in range(-(-h // 8)) for x in range(-(-w // 8)) for k in (0, 1, 8, 27)]
    images += [(900, 20, 16, "rot180", True, False, False, 8, 8, None), (901, 7, 40, "flip_h", False, True, False, 8, 8, None), (902, 8, 8, "spin", False, False, False, 8, 8, None), (903, 8, 8, "none", None, None, None, 7, 8, None), (904, 8, 8, None, False, False, False, 8, 8, None)]
    rows += [(i, 0, 0, 0, 0, 5) for i in range(900, 906)]
    table = spark.createDataFrame(images, "image int, width int, height int, op string, perfect boolean, trim boolean, grayscale boolean, mcu_w int, mcu_h int, crop struct<x:int,y:int,width:int,height:int>")
    df = spark.createDataFrame(rows, "image int, component int, gx int, gy int, k int, v int").repartition(3)
    moved, told = transform_images(df, table)
    got = {}
    for r in moved.collect():
        got.setdefault(r.image, set()).add((r.component, r.gx, r.gy, r.k, r.v))
    told = {r.image: (r.width, r.height, r.problem) for r in told.collect()}
    assert set(got) == set(options)
    assert [told[i][2] for i in range(900, 905)] == ["the transform isn't perfect for this size", "trim would remove all image data", "unknown transform spin", "MCU sides are 8 to 32 in steps of 8", "unknown transform null"] and told[900][:2] == (20, 16)
    for i, o in options.items():
        want = set()
        width, height = sizes[i]
        full = {comp: [(r[2], r[3], r[4], r[5]) for r in rows if r[0] == i and r[1] == comp] for comp in ((0,) if o.grayscale else (0, 1))}
        for comp, part in full.items():
            out, w, h = plain_transform(part, width, height, o)
            want |= {(comp, *b) for b in out}
        assert got[i] == want and told[i] == (w, h, None), (i, o)


def plain_transform(blocks, width, height, o):
    """Blocks (gx, gy, k, v) of one component, one after the other."""
    (mw, mh), op = o.mcu, o.op
    across, down = op in ("flip_h", "transverse", "rot90", "rot180", "rot270"), op in ("flip_v", "transverse", "rot90", "rot180", "rot270")
    if o.trim:
        width = width // mw * mw if across and op != "rot90" else width
        height = height // mh * mh if down and op != "rot270" else height
    fw, fh = width // mw * mw // 8, height // mh * mh // 8
    out = []
    for x, y, k, v in blocks:
        if x >= -(-width // 8) or y >= -(-height // 8):
            continue
        r, c = divmod(k, 8)
        fx, fy = {"flip_h": (True, False), "flip_v": (False, True), "rot180": (True, True), "rot90": (False, True), "rot270": (True, False), "transverse": (True, True)}.get(op, (False, False))
        fx, fy = fx and x < fw, fy and y < fh
        nx, ny = fw - 1 - x if fx else x, fh - 1 - y if fy else y
        v = -v if (c * fx + r * fy) % 2 else v
        out.append((ny, nx, c * 8 + r, v) if op in B.SWAPS else (nx, ny, k, v))
    if op in B.SWAPS:
        width, height, mw, mh = height, width, mh, mw
    if o.crop:
        x, y, w, h = o.crop
        x0, y0 = x // mw * mw, y // mh * mh
        width, height = min(w + x - x0, width - x0), min(h + y - y0, height - y0)
        nx, ny = -(-width // mw) * mw // 8, -(-height // mh) * mh // 8
        out = [(a - x0 // 8, b - y0 // 8, k, v) for a, b, k, v in out if 0 <= a - x0 // 8 < nx and 0 <= b - y0 // 8 < ny]
    return out, width, height


# Damage, rows, display


def test_recovery_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(recovery, "RANGE", 4)
    images, rows, want, warned = [], [], {}, set()
    for i, (total, restart, stop) in enumerate([(30, 7, None), (25, 0, None), (20, 4, 11), (1, 0, 0), (9, 3, None), (0, 2, None)]):
        images.append((i, total, restart))
        value, values, seen = 0, [], []
        for n in range(total):
            if restart and n % restart == 0:
                value = 0
            d = RNG.randrange(-50, 50)
            error = "end" if n == stop else "code" if RNG.random() < 0.15 else None
            lost = RNG.random() < 0.1 and n != stop
            if not lost:
                rows.append((i, n, d, error))
            if lost or error:
                value = 0
                values.append(0)
                seen.append(("code", n, None) if n != stop else ("end", n, n))
            else:
                value += d
                values.append(value)
        if stop is not None:
            values, seen = [0] * total, [w for w in seen if w[1] <= stop]
        want |= {(i, n): v for n, v in enumerate(values)}
        warned |= {(i, *w) for w in seen}
    RNG.shuffle(rows)
    coded = spark.createDataFrame(rows, "image int, id long, d int, error string").repartition(3)
    blocks, warnings = recovery.recover(coded, spark.createDataFrame(images, "image int, total int, restart int"))
    assert {(r.image, r.id): r.v for r in blocks.collect()} == want
    assert {(r.image, r.kind, r.id, r.blocks) for r in warnings.collect()} == warned


@pytest.mark.parametrize("first,last,factor", [(0, 0, 1), (37, 122, 2), (8, 15, 1), (5, 40, 3)])
def test_row_ranges_hold_what_filters_need(first, last, factor):
    low, high = planes.row_range(first, last, factor)
    assert low * 8 <= max(0, first // factor - 1) and high * 8 + 7 >= last // factor + 1 and high - low <= (last - first) // factor // 8 + 3


def test_only_the_rows_asked_for_are_read(spark):
    plan = queries.QUERIES["decode_row_range"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(vec_id,40)" in plan and "LessThanOrEqual(vec_id,159)" in plan


def scans_of(images):
    """Rows of progressive.SCHEMA: DC at bit 1, AC at bit 1, then the rest."""
    rows = []
    for i, blocks in images.items():
        for b, block in enumerate(blocks):
            for k, v in enumerate(block):
                high, low = v >> 1, v & 1
                rows += [(i, 0 if k == 0 else 1, b, k, high, 1), (i, 2, b, k, low, 0)]
    return rows


def test_display_with_late_and_repeated_scans(spark, tmp_path):
    """Scans in any order and twice give what they give in order; gaps are told."""
    images = {i: [[RNG.randrange(-40, 40) if k < 4 else 0 for k in range(64)] for _ in range(4)] for i in (1, 2)}
    rows = scans_of(images)
    src = tmp_path / "scans"
    parts = [[r for r in rows if r[1] == 2 and r[0] == 1], [r for r in rows if r[1] == 0], [r for r in rows if r[1] == 2 and r[0] == 1], [r for r in rows if r[1] == 1]]
    src.mkdir()
    stream = progressive.coefficients(spark.readStream.schema(progressive.SCHEMA).parquet(str(src))).writeStream.outputMode("complete").format("memory").queryName("shown").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        have = []
        for part in parts:
            spark.createDataFrame(part, progressive.SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
            stream.processAllAvailable()
            have += part
            want = {}
            for i, _, b, k, bits, al in set(have):
                want[i, b, k] = want.get((i, b, k), 0) + (bits << al)
            held = spark.table("shown")
            assert {(r.image_id, r.block, r.k): r.v for r in held.collect()} == want
            seen = progressive.progress(spark.createDataFrame(have, progressive.SCHEMA)).collect()
            assert {r.image_id: r.whole for r in seen} == {i: min(set(range(4)) - {r[1] for r in have if r[0] == i}) for i in {r[0] for r in have}}
        layout = spark.createDataFrame([(i, 0, b, b % 2, b // 2) for i in images for b in range(4)], "image long, component int, block long, gx int, gy int")
        one = spark.createDataFrame([(i, 0) for i in images], "image long, component int")
        quant, bits = progressive.default_tables(one), one.withColumn("bits", F.array(*[F.lit(0)] * 10))
        shown = {(r.image, r.gx, r.gy): r.block for r in progressive.preview(held, layout, bits, quant).collect()}
        x = np.array([want.get((1, 3, k), 0) * fixed.LUMA[k] for k in range(64)])[None]
        assert shown[1, 1, 1] == dct.inverse_integer(x)[0].tolist() and len(shown) == 8
        rough = bits.withColumn("bits", F.array(F.lit(0), *[F.lit(-1)] * 9))
        flat = held.filter("k = 0")
        smooth = {(r.image, r.gx, r.gy): r.block for r in progressive.preview(flat, layout, rough, quant).collect()}
        dc = {i: [[want[i, b, 0]] + [0] * 63 for b in range(4)] for i in images}
        for i in images:
            out = plain_smooth(dc[i], 2, 2, [0] + [-1] * 9, fixed.LUMA)
            for b in range(4):
                assert smooth[i, b % 2, b // 2] == dct.inverse_integer(np.array([out[b]]) * np.array([fixed.LUMA]))[0].tolist()
        none = progressive.preview(flat.limit(0), layout, rough, quant, smooth=False).collect()
        assert all(r.block == [128] * 64 for r in none) and len(none) == 8
    finally:
        stream.stop()
