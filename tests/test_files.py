"""Segments of files, pixel files, transforms, palettes and tables against plain Python versions."""

import itertools
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import fixed, pixels
from rasterloom.operators import blocks as B
from rasterloom.operators import dct, entropy, metadata, palette, planes
from rasterloom.sources import images
from rasterloom.sources import segments as S

SOF = bytes.fromhex("FFC0000B08000200030101" + "2200")
SOS = bytes.fromhex("FFDA0008010100003F00")


def table(spark, *contents):
    return spark.createDataFrame(list(enumerate(contents)), "path long, content binary")


@pytest.mark.parametrize("content,error", [
    (b"", "no start marker"), (b"\xff\xd8", "unexpected end"), (b"\xff\xd8\xff\xd9", "missing frame header"), (b"GIF89a", "no start marker"),
    (b"\xff\xd8" + SOF + b"\xff\xd9", "missing scan"), (b"\xff\xd8\xff\xfe\x00\x09ab", "segment cut off"), (b"\xff\xd8\xff\xfe\x00\x01", "segment cut off"),
    (b"\xff\xd8\xff\x00", "invalid marker"), (b"\xff\xd8" + SOF + SOS + b"\x00\xff\x00\xff\xd0x", None),
])
def test_malformed_files(content, error):
    rows = list(S.file_segments(content))
    assert (rows[-1][3] if rows[-1][3] else None) == error


def test_segments_and_headers(spark):
    wide = SOF.replace(b"\x00\x03\x01", b"\x00\x00\x01")  # width 0
    five = b"\xff\xc2\x00\x08\x08\x00\x02\x00\x03\x05"
    com = lambda t: b"\xff\xfe" + struct.pack(">H", len(t) + 2) + t
    files = table(spark, b"\xff\xd8" + com(b"one") + b"\xff\xff" + com(b"two") + SOF + SOS + b"\xff\xd9", b"\xff\xd8" + wide + SOS, b"\xff\xd8" + five + SOS, None, b"")
    segments = S.scan(files)
    got = {r.key: r for r in S.headers(segments).collect()}
    assert set(got) == {0, 1, 2, 4}
    assert (got[0].frame.width, got[0].frame.height, got[0].comment, got[0].scans, got[0].error) == (3, 2, "two", 1, None)
    assert got[1].frame is None and got[1].error == "bad frame header" and got[2].frame is None
    assert [r.marker for r in segments.filter("key = 0").orderBy("ordinal").collect()] == [0xFE, 0xFE, 0xC0, 0xDA]
    assert S.headers(S.scan(spark.createDataFrame([], "path long, content binary"))).count() == 0


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_scan_plan_reads_files_once(spark):
    segment = lambda marker, p: b"\xff" + bytes([marker]) + struct.pack(">H", len(p) + 2) + p
    sof = segment(0xC2, bytes([8, 0, 2, 0, 3, 4, 1, 0x22, 0, 2, 0x11, 0, 2, 0x12, 0, 3, 0x11, 0]))
    codes = lambda kind, n: bytes([kind, n]) + bytes(15) + bytes(range(n))
    dht = segment(0xC4, codes(0x00, 1) + codes(0x12, 0) + codes(0x11, 2) + codes(0x03, 1)[:-1]) + segment(0xC4, codes(0x05, 1) + codes(0x01, 1))
    sos = lambda *parts: segment(0xDA, bytes([len(parts), *[b for p in parts for b in p], 0, 63, 0])) + b"ab"
    files = table(spark, b"\xff\xd8" + sof + dht + sos((1, 0x01), (2, 0x00)) + sos() + sos((9, 0x01), (3, 0x31), (3, 0x02), (3, 0x11)) + b"\xff\xd9", b"\xff\xd8" + sos((1, 0x00)), None)
    dc, ac = "missing DC table", "missing AC table"
    want = [(0, 3, 1, 1, 4, None), (0, 3, 1, 2, 1, ac), (0, 3, 1, 2, 2, ac), (0, 5, 2, 3, 1, dc), (0, 5, 2, 3, 1, ac), (0, 5, 2, 3, 1, dc), (0, 5, 2, 9, None, "unknown component"), (1, 0, 1, 1, None, "unknown component")]
    for segments in (S.scan_files(files), S.scan(files)):
        got = S.scan_plan(segments).select("key", "ordinal", "scan", "id", "blocks", "error").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    plan = S.scan_plan(S.scan_files(files))
    assert shuffles(plan) == 0 and plan._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_headers_and_tables_without_shuffles(spark):
    """Rows per file give what rows per segment do, and no task gathers files."""
    one = b"\xff\xdb\x00\x43\x00" + bytes(range(1, 65))
    both = b"\xff\xdb\x00\x84\x00" + bytes([7] * 64) + b"\x01" + bytes([9] * 64) + one.replace(b"\x00\x01\x02", b"\x00\x05\x05")
    com = b"\xff\xfe\x00\x05one\xff\xfe\x00\x05two"
    files = table(spark, b"\xff\xd8" + one + com + SOF + SOS, b"\xff\xd8" + both + SOF.replace(b"\x08\x00\x02", b"\x08\x00\x07") + SOF + SOF.replace(b"\x00\x03\x01", b"\x00\x00\x01") + b"\xff\xdd\x00\x04\x00\x09" + SOS, None, b"", b"\xff\xd8" + one[:20])
    rows = lambda df: sorted(map(repr, df.collect()))
    for made in (S.headers, S.quant_tables, S.huffman_tables, S.arithmetic_tables, lambda s: B.critical_parameters(S.headers(s))):
        assert rows(made(S.scan_files(files))) == rows(made(S.scan(files))) and shuffles(made(S.scan_files(files))) == 0
    got = {r.key: r for r in S.headers(S.scan_files(files)).collect()}
    assert (got[0].comment, got[1].frame.height, got[1].restart, got[3].error, got[4].error) == ("two", 2, 9, "no start marker", "segment cut off")
    assert {(r.tq, r.q) for r in S.quant_tables(S.scan_files(files)).filter("key = 1 AND k = 0").collect()} == {(0, 5), (1, 9)}


def test_small_tables_that_grow_are_spread(spark):
    """A table of one split is dealt out before each row becomes many, or a file."""
    from rasterloom import queries

    for name in ("per_table_quality", "scale_quant_tables", "scaled_dimensions", "file_headers", "file_quant_tables"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").select(F.spark_partition_id().alias("p")).distinct().count() == 4, name


def tiff(order, tag=0x0112, kind=3, value=6, magic=42, n=1):
    e = "<" if order == b"II" else ">"
    return order + struct.pack(e + "HI", magic, 8) + struct.pack(e + "H", n) + struct.pack(e + "HHIHH", tag, kind, 1, value, 0)


def test_orientation_and_thumbnail(spark):
    cases = [(tiff(b"II"), 6), (tiff(b"MM", value=8), 8), (tiff(b"MM", value=9), None), (tiff(b"II", kind=4), None), (tiff(b"II", tag=1), None), (tiff(b"XX"), None), (tiff(b"II", magic=41), None), (tiff(b"II", n=0), None), (tiff(b"II", tag=1, n=2), None), (b"II", None), (None, None)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t binary")
    assert [r.o for r in rows.select("i", S.orientation(F.col("t")).alias("o")).orderBy("i").collect()] == [o for _, o in cases]
    head = b"JFIF\0\x01\x02\x01\0\x48\0\x48"
    shots = spark.createDataFrame([(0, head + b"\x01\x02abcdef"), (1, head + b"\0\0"), (2, head + b"\x02\x02abc"), (3, b"Exif" * 5)], "i int, t binary")
    got = [r.x for r in shots.select("i", S.thumbnail(F.col("t")).alias("x")).orderBy("i").collect()]
    assert (got[0].width, got[0].height, bytes(got[0].rgb)) == (1, 2, b"abcdef") and got[1:] == [None] * 3


def test_tables_defined_again(spark):
    one = b"\xff\xdb\x00\x43\x00" + bytes(range(1, 65))
    both = b"\xff\xdb\x00\xc4\x00" + bytes([7] * 64) + b"\x11" + struct.pack(">64H", *range(300, 364))
    dac = b"\xff\xcc\x00\x08" + bytes([0x00, 0x31, 0x10, 0x07, 0x04, 0xFF])
    dht = b"\xff\xc4\x00\x16\x10" + bytes([1, 1, 1] + [0] * 13) + bytes([14, 0, 16])
    segments = S.scan(table(spark, b"\xff\xd8" + one + both + dac + dht + SOF + SOS))
    got = {(r.tq, r.k): r.q for r in S.quant_tables(segments).collect()}
    order = fixed.zigzag()
    assert got == {(0, k): 7 for k in range(64)} | {(1, order[z]): 300 + z for z in range(64)}
    assert {(r.cls, r.id, r.low, r.high, r.kx) for r in S.arithmetic_tables(segments).collect()} == {(0, 0, 1, 3, None), (1, 0, None, None, 7)}
    assert [(r.code, r.length, r.symbol) for r in S.huffman_tables(segments).orderBy("position").collect()] == [(0, 1, 14), (2, 2, 0), (6, 3, 16)]


def test_injected_segments_are_read_again(spark):
    rows = table(spark, b"\xff\xd8" + SOF + SOS)
    tif = F.lit(bytearray(tiff(b"MM", value=3)))
    made = rows.select("path", metadata.inject(F.col("content"), metadata.exif_segment(tif), metadata.comment_segment(F.lit("é"))).alias("content"))
    h = S.headers(S.scan(made)).first()
    assert (h.orientation, h.comment) == (3, "é")
    with_adobe = made.withColumn("content", metadata.inject(F.col("content"), metadata.adobe_segment(F.lit(2))))
    assert S.headers(S.scan(with_adobe)).first().adobe == 2
    back = metadata.strip_segments(S.scan(with_adobe), with_adobe, F.col("marker") == 0xEE)
    assert bytes(back.first().content) == bytes(made.first().content)


def test_pixel_files(spark, tmp_path):
    rng = random.Random(4)
    w, h = 5, 3
    raw = {f: bytes(rng.randrange(256) for _ in range(w * h * n)) for f, n in (("rgb", 3), ("bgr", 3), ("gray", 1), ("rgba", 4), ("bgra", 4))}
    for fmt, data in raw.items():
        rows = spark.createDataFrame([(fmt, w, h, data), ("short", w, h, data[:-1]), ("none", None, h, data)], "path string, width int, height int, data binary")
        made = images.bmp_bytes(rows, fmt)
        assert {r.path for r in made.filter("content IS NULL").collect()} == {"short", "none"}
        got = {(r.x, r.y): (r.r, r.g, r.b) for r in images.bmp_pixels(made.filter("content IS NOT NULL")).collect()}
        n = len(data) // (w * h)
        at = {c: i for i, c in enumerate(fmt)} if fmt != "gray" else dict.fromkeys("rgb", 0)
        assert got == {(x, y): tuple(data[(y * w + x) * n + at[c]] for c in "rgb") for x in range(w) for y in range(h)}
    images.write_files(made.filter("content IS NOT NULL").select(F.lit("a.bmp").alias("name"), "content"), f"file://{tmp_path}/out")
    assert (tmp_path / "out" / "a.bmp").read_bytes()[:2] == b"BM"
    pnm = [b"P5\n# a comment\n5 # another\n3\n255\n" + raw["gray"], b"P6 5 3 255 " + raw["rgb"], b"P6 5 3 254 " + raw["rgb"], b"P6 5 3 255 " + raw["rgb"][:-1], b"P4 5 3 255 " + raw["rgb"]]
    got = {}
    for r in images.load_pixels(table(spark, *pnm)).collect():
        got.setdefault(r.path, {})[r.x, r.y] = (r.r, r.g, r.b)
    assert set(got) == {0, 1}
    assert got[0] == {(x, y): (raw["gray"][y * w + x],) * 3 for x in range(w) for y in range(h)}
    assert got[1] == {(x, y): tuple(raw["rgb"][(y * w + x) * 3 : (y * w + x) * 3 + 3]) for x in range(w) for y in range(h)}


def test_transforms_are_near_the_exact_ones():
    rng = np.random.default_rng(6)
    x = rng.integers(-128, 128, (200, 64))
    basis = np.array([[math.cos((2 * i + 1) * u * math.pi / 16) * (math.sqrt(0.5) if u == 0 else 1) / 2 for i in range(8)] for u in range(8)])
    exact = basis @ x.reshape(-1, 8, 8) @ basis.T
    for y, slack in ((dct.forward_integer(x), 2), (dct.forward_float(x), 0.51), (dct.forward_fast(x), 60), (dct.forward_integer(x, 12), 3)):
        assert np.abs(y.reshape(-1, 8, 8) - 8 * exact).max() <= slack
    coefficients = np.rint(exact).astype(np.int64).reshape(-1, 64)
    one = np.ones(64, np.int64)
    want = np.clip(np.rint(basis.T @ coefficients.reshape(-1, 8, 8) @ basis) + 128, 0, 255).reshape(-1, 64)
    for y in (dct.inverse_integer(coefficients), dct.inverse_float(coefficients, one)):
        assert np.abs(y - want).max() <= 1
    coarse = np.rint(exact / 16).astype(np.int64).reshape(-1, 64)  # the fast one needs a table whose scaled entries are large
    want = np.clip(np.rint(basis.T @ (coarse * 16).reshape(-1, 8, 8) @ basis) + 128, 0, 255).reshape(-1, 64)
    assert np.abs(dct.inverse_fast(coarse, 16 * one) - want).max() <= 8
    flat = np.zeros((1, 64), np.int64)
    flat[0, 0] = 400
    assert all((dct.inverse_integer(flat, n) == 178).all() for n in (1, 2, 4, 8))
    assert (dct.inverse_integer(flat, 8, 12) == 2098).all()


def test_transforms_of_awkward_blocks(spark):
    rows = spark.createDataFrame([(1, [1] * 64), (2, None), (3, [1] * 63), (4, [None] + [1] * 63), (5, [])], "id long, block array<long>")
    assert {r.id: r.block is not None for r in dct.forward(rows).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert dct.inverse(rows.filter("id = 1"), size=2, quant=[2] * 64).first().block == dct.inverse_integer(np.full((1, 64), 2), 2)[0].tolist()
    for bad in ({"method": "fast"}, {"precision": 10}, {"method": "float", "precision": 12}):
        with pytest.raises(ValueError):
            dct.forward(rows, **bad)
    with pytest.raises(ValueError):
        dct.inverse(rows, size=3)


def test_float_inverse_against_lanes():
    """Single precision, one lane at a time."""
    f = np.float32
    rng = np.random.default_rng(8)
    x, q = rng.integers(-40, 40, (20, 64)), rng.integers(1, 30, 64)

    def lane(v):
        a, b, c, d = v[0] + v[4], v[0] - v[4], v[2] + v[6], (v[2] - v[6]) * f(1.414213562)
        d = d - c
        e = [a + c, b + d, b - d, a - c]
        z13, z10, z11, z12 = v[5] + v[3], v[5] - v[3], v[1] + v[7], v[1] - v[7]
        o7, o11, z5 = z11 + z13, (z11 - z13) * f(1.414213562), (z10 + z12) * f(1.847759065)
        o10, o12 = z5 - z12 * f(1.082392200), z5 - z10 * f(2.613125930)
        o6 = o12 - o7
        o5 = o11 - o6
        o4 = o10 - o5
        return [e[0] + o7, e[1] + o6, e[2] + o5, e[3] + o4, e[3] - o4, e[2] - o5, e[1] - o6, e[0] - o7]

    got = dct.inverse_float(x, q)
    scale = [f(s) for s in dct.AAN]
    for n in range(len(x)):
        m = [[f(x[n, r * 8 + c]) * (f(q[r * 8 + c]) * scale[r] * scale[c] * f(0.125)) for c in range(8)] for r in range(8)]
        cols = [lane([m[r][c] for r in range(8)]) for c in range(8)]
        for r in range(8):
            v = [cols[c][r] for c in range(8)]
            v[0] = v[0] + f(128.5)
            assert got[n, r * 8 : r * 8 + 8].tolist() == [min(255, max(0, int(s))) for s in lane(v)]


def slow_cut(counts, colors):
    """Median cut over lists of colours."""
    boxes = [sorted(counts)]
    if len(counts) <= colors:
        return sorted(counts)
    while len(boxes) < colors:
        scores = []
        for b in boxes:
            spans = [max(c[i] for c in b) - min(c[i] for c in b) for i in range(3)]
            scores.append(max(spans) * sum(counts[c] for c in b) if len(b) > 1 else 0)
        if max(scores) == 0:
            break
        b = boxes.pop(scores.index(max(scores)))
        spans = [max(c[i] for c in b) - min(c[i] for c in b) for i in range(3)]
        b.sort(key=lambda c: c[spans.index(max(spans))])
        half, run, at = sum(counts[c] for c in b) // 2, 0, 1
        for i, c in enumerate(b):
            run += counts[c]
            if run >= half and i > 0:
                at = i
                break
        boxes += [b[:at], b[at:]]
    return [tuple(sum(c[i] * counts[c] for c in b) // sum(counts[c] for c in b) for i in range(3)) for b in boxes]


def test_median_cut(spark):
    rng = random.Random(3)
    for image, colors in ((0, 13), (1, 256), (2, 1)):
        dots = [(image, i, *[min(255, int(rng.gauss(90, 40)) % 256 // 4 * 4) for _ in range(3)]) for i in range(500)]
        dots += [(image, 500 + i, 8, 8, 8) for i in range(200)]
        counts = {}
        for *_, r, g, b in dots:
            counts[r, g, b] = counts.get((r, g, b), 0) + 1
        got = palette.median_cut(spark.createDataFrame(dots, "image long, id long, r long, g long, b long"), colors, ("image",)).orderBy("idx").collect()
        assert [(r.r, r.g, r.b) for r in got] == slow_cut(counts, colors) and {r.image for r in got} == {image}
    with pytest.raises(ValueError):
        palette.median_cut(spark.createDataFrame([], "id long, r long, g long, b long"), 257)


def test_quantize_with_dither(spark):
    rng = random.Random(9)
    dots = [(y * 20 + x, x, y, *[rng.randrange(256) for _ in range(3)]) for y in range(8) for x in range(20)]
    px = spark.createDataFrame(dots, "id long, x long, y long, r long, g long, b long")
    entries, got = palette.quantize(px, 9, "median_cut", "ordered")
    pal = {r.idx: (r.r, r.g, r.b) for r in entries.collect()}
    spread = np.float32(255) / np.float32(len(pal) - 1)
    for r in got.collect():
        _, x, y, *c = dots[r.id]
        t = np.float32(fixed.BAYER[y % 4 * 4 + x % 4] / 16) * spread
        moved = [min(255, max(0, math.floor(abs(v) + 0.5) * (1 if v >= 0 else -1))) for v in (float(np.float32(u) + t) for u in c)]
        assert r.idx == min(pal, key=lambda i: (sum((a - b) ** 2 for a, b in zip(pal[i], moved, strict=True)), i))


def test_optimal_tables(spark):
    """Least total length as long as no code is over 16 bits; always a code, never all ones."""
    rng = random.Random(5)
    cases = [{7: 1}, {1: 5, 2: 5}, {s: rng.randrange(1, 1000) for s in range(40)}, {s: 1 for s in range(256)}, {s: int(1.7**s) + 1 for s in range(30)}]
    for counts in cases:
        bits, symbols = entropy.optimal_code(counts)
        lengths = [d for d, k in enumerate(bits, 1) for _ in range(k)]
        assert sorted(symbols) == sorted(counts) and len(lengths) == len(symbols) and sum(2.0**-d for d in lengths) < 1
        heap = sorted([*counts.values(), 1])
        best = 0
        while len(heap) > 1:
            a, b, *heap = heap
            best += a + b
            heap = sorted([*heap, a + b])
        cost = sum(counts[s] * d for s, d in zip(symbols, lengths, strict=True))
        if max(lengths) < 16:
            assert cost < best <= cost + max(lengths) + 1  # the reserved code's own length is the difference
    rows = [(t, s, n) for t, c in enumerate(cases) for s, n in c.items()]
    got = entropy.optimal_tables(spark.createDataFrame(rows, "t int, symbol long, n long"), ("t",)).collect()
    for t, c in enumerate(cases):
        mine = sorted((r.position, r.length, r.code) for r in got if r.t == t)
        words = [f"{code:0{length}b}" for _, length, code in mine]
        assert len(words) == len(c) and not any(a != b and b.startswith(a) for a, b in itertools.product(words, words)) and not any(set(w) == {"1"} for w in words)


def test_dc_differences_across_ranges(spark, monkeypatch):
    rng = random.Random(7)
    ids = sorted(rng.sample(range(-3 * entropy.RANGE, 9 * entropy.RANGE), 300))
    values = [rng.randrange(-999, 999) for _ in ids]
    rows = spark.createDataFrame(list(zip(ids, values, strict=True)), "id long, v long")
    diffs = entropy.dc_differences(rows)
    assert {r.id: r.d for r in diffs.collect()} == {i: v - p for i, v, p in zip(ids, values, [0, *values], strict=False)}
    assert {r.id: r.v for r in entropy.dc_restore(diffs.drop("v")).collect()} == dict(zip(ids, values, strict=True))


@pytest.mark.parametrize("number", range(1, 8))
def test_lossless_round_trip_of_several_planes(spark, number):
    rng = random.Random(number)
    rows = [(i, y, x, rng.randrange(256)) for i in range(2) for y in range(7 + i) for x in range(9 - 4 * i)]
    plane = spark.createDataFrame(rows, "image long, y long, x long, v long")
    diffs = planes.lossless_difference(plane, number, shift=1, keys=("image",))
    back = planes.undo_prediction(diffs, number, shift=1, keys=("image",))
    assert {(r.image, r.y, r.x): r.v for r in back.collect()} == {(i, y, x): v >> 1 for i, y, x, v in rows}


def test_filter_blocks_fills_gaps(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 8, 7), (2, 63, 1)], "id long, k long, v long")
    got = {(r.id, r.k): r.v for r in B.filter_blocks(rows, lambda x: x + 1).collect()}
    assert len(got) == 128 and got[1, 0] == 6 and got[1, 8] == 8 and got[2, 63] == 2 and got[2, 0] == 1


def test_output_formats_that_do_not_exist():
    for space, fmt in (("YCbCr", "gray"), ("YCbCr", "cmyk"), ("RGB", "bgr"), ("CMYK", "gray"), ("YCCK", "rgb565"), ("Grayscale", "cmyk")):
        with pytest.raises(ValueError):
            pixels.output_pixel(space, fmt, *map(F.lit, [1] * 4))
