"""Identities and known values; the registered queries are checked against SQL in test_queries."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rasterloom.functions import color, fixed, quality
from rasterloom.operators import blocks as B
from rasterloom.operators import dct, entropy, metadata, palette, planes
from rasterloom.sources import images
from rasterloom.streaming import progressive


def grid(spark, w=4, h=3, seed=1):
    rng = random.Random(seed)
    return [(y * w + x, x, y, k, rng.randrange(-99, 99)) for y in range(h) for x in range(w) for k in range(64)]


COLS = "id long, gx long, gy long, k long, v long"


def rows(df):
    return sorted((r.id, r.gx, r.gy, r.k, r.v) for r in df.collect())


def test_zigzag_is_a_permutation_along_diagonals():
    z = fixed.zigzag()
    assert sorted(z) == list(range(64)) and z[:6] == [0, 1, 8, 16, 9, 2] and z[-3:] == [55, 62, 63]
    assert [fixed.natural()[k] for k in z] == list(range(64))


@pytest.mark.parametrize("op,times", [("flip_h", 2), ("flip_v", 2), ("transpose", 2), ("transverse", 2), ("rot180", 2), ("rot90", 4), ("rot270", 4)])
def test_transforms_come_back(spark, op, times):
    data = grid(spark)
    df, w, h = spark.createDataFrame(data, COLS), 4, 3
    for _ in range(times):
        df = B.transform(df, op, w, h)
        if op in B.SWAPS:
            w, h = h, w
    assert rows(df) == sorted(data)


def test_rot90_then_rot270(spark):
    df = spark.createDataFrame(grid(spark), COLS)
    assert rows(B.transform(B.transform(df, "rot90", 4, 3), "rot270", 3, 4)) == rows(df)


def test_known_colours(spark):
    df = spark.createDataFrame([(255, 255, 255), (0, 0, 0), (255, 0, 0), (0, 0, 255)], "r int, g int, b int")
    got = [tuple(r) for r in df.select(*color.rgb_to_ycbcr("r", "g", "b")).collect()]
    assert got[0] == (255, 128, 128) and got[1] == (0, 128, 128) and (got[2][0], got[2][2]) == (76, 255) and got[3][0] == 29


def test_dct_against_the_definition(spark):
    rng = random.Random(2)
    block = [rng.randrange(-128, 128) for _ in range(64)]
    df = spark.createDataFrame([(1, block)], "id int, block array<bigint>")
    got = dct.forward(df).first()["block"]
    c = lambda u: math.sqrt(0.5) if u == 0 else 1.0
    for v in range(8):
        for u in range(8):
            exact = c(u) * c(v) / 4 * sum(block[y * 8 + x] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16) for y in range(8) for x in range(8))
            assert abs(got[v * 8 + u] / 8 - exact) < 1
    coded = dct.forward(df).withColumn("block", F.transform("block", lambda x: quality.quantize(x, F.lit(8))))
    back = dct.inverse(coded).first()["block"]
    assert max(abs(a - 128 - b) for a, b in zip(back, block)) <= 2


def test_quality_points(spark):
    q = spark.createDataFrame([(0,), (1,), (50,), (75,), (100,)], "q int")
    assert [r[0] for r in q.select(quality.scaling(F.col("q"))).collect()] == [5000, 5000, 100, 50, 0]


def test_lossless_rows(spark):
    diffs = spark.createDataFrame([(0, i, d) for i, d in enumerate([10, 5, -3, 2])], "y long, x long, d long")
    assert [r.v for r in planes.undo_left_prediction(diffs).orderBy("x").collect()] == [138, 143, 140, 142]
    ra, rb, rc = (F.lit(v).cast("bigint") for v in (100, 200, 150))
    got = spark.range(1).select(*[planes.predictor(n, ra, rb, rc) for n in range(1, 8)]).first()
    assert list(got) == [100, 200, 150, 150, 125, 175, 150]


def test_canonical_codes(spark):
    got = entropy.canonical_codes(spark, [1, 1, 1], [14, 0, 16]).orderBy("position").collect()
    assert [(r.length, r.code, r.symbol) for r in got] == [(1, 0, 14), (2, 2, 0), (3, 6, 16)]


def test_progressive_script():
    assert len(entropy.progressive_script(3)) == 14 and len(entropy.progressive_script(1)) == 6
    for comps in (1, 3):
        bits = {}
        for cs, first, last, high, low in entropy.progressive_script(comps):
            for c in cs:
                for k in range(first, last + 1):
                    assert bits.get((c, k), 0) == high
                    bits[c, k] = low
        assert set(bits.values()) == {0} and len(bits) == 64 * comps


@pytest.mark.parametrize("chunks,want", [
    ([(2, 3, "bc"), (1, 3, "a"), (3, 3, "d")], "abcd"), ([(1, 2, "a")], None), ([(1, 2, "a"), (1, 2, "b")], None), ([(0, 1, "a")], None), ([(1, 2, "a"), (2, 3, "b")], None), ([(3, 2, "a"), (1, 2, "b")], None),
])
def test_reassemble(spark, chunks, want):
    df = spark.createDataFrame([(7, *c) for c in chunks], "image_id int, seq_no int, num int, data string")
    assert metadata.reassemble(df).first()["profile"] == want


def test_small_planes_use_the_box(spark):
    two = spark.createDataFrame([(0, 0, 10), (0, 1, 50)], "y long, x long, v long")
    assert [r.v for r in planes.fancy_h2v1(two).orderBy("x").collect()] == [10, 10, 50, 50]


def test_palette(spark):
    px = spark.createDataFrame([(i, i % 7 * 30, i % 5 * 40, i % 3 * 80) for i in range(105)], "id long, r long, g long, b long")
    pal = palette.uniform_palette(spark, 27)
    assert pal.count() == 27 and palette.uniform_palette(spark, 300).count() == 216 and palette.uniform_palette(spark, 1).first()["r"] == 128
    assert palette.index_pixels(px, pal).count() == 105
    cut = palette.median_cut_boxes(px, 3)
    assert cut.agg(F.sum("n")).first()[0] == 105 and palette.box_palette(cut).count() <= 8


def test_raster_files(spark, tmp_path):
    w, h = 3, 2
    px = {(x, y): (10 * x + y, 20 * y, 5 * x) for x in range(w) for y in range(h)}
    lines = [b"".join(bytes(px[x, y][::-1]) for x in range(w)) + b"\0" * 3 for y in reversed(range(h))]
    head = b"BM" + (54 + 24).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + w.to_bytes(4, "little") + h.to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    (tmp_path / "a.bmp").write_bytes(head + b"".join(lines))
    (tmp_path / "b.ppm").write_bytes(b"P6\n3 2\n255\n" + bytes(18))
    files = images.read_images(spark, str(tmp_path))
    assert {r[0] for r in files.select(images.image_kind(F.col("content"))).collect()} == {"BMP", "PNM"}
    got = {(r.x, r.y): (r.r, r.g, r.b) for r in images.bmp_pixels(files).collect()}
    assert got == px
    pnm = files.select(images.pnm_header(F.col("content")).alias("h")).filter("h IS NOT NULL").first()["h"]
    assert (pnm.channels, pnm.width, pnm.height, pnm.offset) == (3, 3, 2, 11)


def test_progressive_stream(spark, tmp_path):
    src = tmp_path / "scans"
    data = [(1, 0, 0, 0, 3, 2), (1, 1, 0, 0, 1, 1), (1, 2, 0, 0, 1, 0), (1, 2, 0, 5, -1, 0)]
    batch = spark.createDataFrame(data, progressive.SCHEMA)
    batch.repartition(2).write.parquet(str(src))
    query = progressive.coefficients(spark.readStream.schema(progressive.SCHEMA).parquet(str(src))).writeStream.outputMode("complete").format("memory").queryName("coefs").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.k, r.v, r.scans) for r in spark.table("coefs").collect()) == [(0, 15, 2), (5, -1, 2)]
    assert progressive.progress(batch).first()["scans"] == 2


def test_transform_plan(spark):
    from rasterloom.plans.transform import TransformOptions, transform

    df = spark.createDataFrame(grid(spark), COLS)
    out, w, h = transform(df, 30, 24, TransformOptions("rot180", trim=True))
    assert (w, h) == (24, 24) and out.count() == 9 * 64 and rows(out) == rows(B.transform(df.filter("gx < 3"), "rot180", 3, 3))
    out, w, h = transform(df, 32, 24, TransformOptions("rot90", crop=(9, 1, 7, 9)))
    assert (w, h) == (8, 10) and out.select("gx", "gy").distinct().count() == 2
    with pytest.raises(ValueError):
        transform(df, 30, 24, TransformOptions("flip_h", perfect=True))
    with pytest.raises(ValueError):
        TransformOptions("spin")
