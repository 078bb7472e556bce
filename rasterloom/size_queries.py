"""Registered queries of sizes, factors, qualities and codes: one image per row of
``part``, with the numbers a header would hold, or the symbols of the blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import color, fixed, geometry, quality
from .operators import blocks as B
from .operators import entropy, metadata, palette
from .queries import CATEGORY, COEF, NEAR, PIX, QUANT, SQL, UNIFORM, quantized, query
from .sources import derived

IMG = """img AS (SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_partkey % 997 + 1 AS BIGINT) AS w, CAST(p_size * 7 + 1 AS BIGINT) AS h, CAST(p_partkey * 31 % 101 AS BIGINT) AS q,
 CAST(p_partkey % 16 + 1 AS BIGINT) AS size, CAST(p_partkey % 4 + 1 AS BIGINT) AS mh, CAST(floor(p_partkey / 4.0) AS BIGINT) % 4 + 1 AS mv FROM part)"""
SCALE = "CAST(CASE WHEN q <= 0 THEN 5000 WHEN q < 50 THEN floor(5000.0 / q) ELSE 200 - 2 * q END AS BIGINT)"
SAMPLINGS = "s AS (SELECT CAST(n AS BIGINT) AS n, name, CAST(sh AS BIGINT) AS sh, CAST(sv AS BIGINT) AS sv FROM (VALUES " + ", ".join(f"({i}, '{n}', {a}, {b})" for i, (n, (a, b)) in enumerate(fixed.SAMPLING.items())) + ") t(n, name, sh, sv))"


def sampled(spark, sf_dir):
    """Images with the name and factors of one of the subsamplings."""
    kinds = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).cast("bigint").alias("sh"), F.lit(b).cast("bigint").alias("sv")) for n, (a, b) in fixed.SAMPLING.items()])
    return derived.images(spark, sf_dir).withColumn("s", F.element_at(kinds, (F.col("id") % len(fixed.SAMPLING) + 1).cast("int"))).select("*", "s.*")


@query(f"""WITH {IMG}, c AS (SELECT id, id % 5 + 1 AS n, CASE WHEN id % 4 = 0 THEN NULL ELSE id % 4 - 1 END AS a FROM img)
SELECT id, n, a, CASE WHEN n = 1 THEN 'Grayscale' WHEN n = 3 AND a = 0 THEN 'RGB' WHEN n = 3 THEN 'YCbCr' WHEN n = 4 AND (a IS NULL OR a = 0) THEN 'CMYK' WHEN n = 4 THEN 'YCCK' ELSE 'Unknown' END AS space FROM c""")
def color_space_detect(spark, sf_dir):
    """Components and, in three of four files, the transform that a marker names."""
    t = derived.images(spark, sf_dir).select("id", (F.col("id") % 5 + 1).alias("n"), F.when(F.col("id") % 4 > 0, F.col("id") % 4 - 1).alias("a"))
    return t.withColumn("space", color.color_space(F.col("n"), F.col("a")))


@query(f"WITH {IMG} SELECT id, q, {SCALE} AS scale FROM img")
def quality_scaling(spark, sf_dir):
    return derived.images(spark, sf_dir).select("id", "q", quality.scaling(F.col("q")).alias("scale"))


def _scaled_tables(spark, sf_dir):
    t = derived.spread(derived.images(spark, sf_dir), "id").select("id", quality.scaling(F.col("q")).alias("scale"))
    both = F.arrays_zip(F.array(*map(F.lit, fixed.LUMA)).alias("l"), F.array(*map(F.lit, fixed.CHROMA)).alias("c"))
    return t.select("*", F.posexplode(both).alias("k", "t")).withColumn("k", F.col("k").cast("bigint"))


@query(f"""WITH {QUANT}, {IMG}, s AS (SELECT id, {SCALE} AS scale FROM img)
SELECT id, k, CAST(least(255, greatest(1, floor((q * scale + 50) / 100.0))) AS BIGINT) AS luma, CAST(least(32767, greatest(1, floor((c * scale + 50) / 100.0))) AS BIGINT) AS chroma,
 CAST(least(65535, q * 16) AS BIGINT) AS twelve FROM s, quant""")
def scale_quant_tables(spark, sf_dir):
    """The tables of every image at its quality."""
    t = _scaled_tables(spark, sf_dir)
    return t.select("id", "k", quality.scaled_entry(F.col("t.l"), F.col("scale")).alias("luma"), quality.scaled_entry(F.col("t.c"), F.col("scale"), False).alias("chroma"), quality.entry_12_bit(F.col("t.l")).alias("twelve"))


@query(f"WITH {QUANT}, {IMG}, s AS (SELECT id, {SCALE} AS scale FROM img) SELECT id, (k % 8) * 8 + CAST(floor(k / 8.0) AS BIGINT) AS k, CAST(least(255, greatest(1, floor((q * scale + 50) / 100.0))) AS BIGINT) AS q FROM s, quant")
def transpose_quant_table(spark, sf_dir):
    """The luminance table of every image, turned with the image."""
    t = _scaled_tables(spark, sf_dir)
    k, _ = B.spatial("transpose", F.col("k"), F.col("k"))
    return t.select("id", k.alias("k"), quality.scaled_entry(F.col("t.l"), F.col("scale")).alias("q"))


@query(f"WITH {IMG}, t AS (SELECT id, id * 7 % 6001 AS s FROM img) SELECT id, s, CAST(least(100, greatest(1, CASE WHEN s >= 100 THEN floor(5000.0 / s) ELSE floor((200 - s) / 2.0) END)) AS BIGINT) AS quality FROM t")
def linear_quality(spark, sf_dir):
    return derived.images(spark, sf_dir).select("id", (F.col("id") * 7 % 6001).alias("s")).withColumn("quality", quality.linear_quality(F.col("s")))


@query(f"""WITH {QUANT}, {IMG}, t AS (SELECT id, tq, q AS s, CASE tq WHEN 0 THEN q WHEN 1 THEN 100 - q WHEN 2 THEN 50 ELSE q % 7 * 10 END AS q FROM img, range(4) a(tq)), e AS (SELECT id, tq, {SCALE} AS scale FROM t)
SELECT id, tq, k, CASE WHEN tq = 3 AND k < 8 THEN 255 ELSE CAST(least(255, greatest(1, floor(((CASE WHEN tq = 0 THEN quant.q ELSE c END) * scale + 50) / 100.0))) AS BIGINT) END AS q FROM e, quant""")
def per_table_quality(spark, sf_dir):
    """Four tables an image with a quality each; the first row of the last is set by the caller and cut for baseline."""
    s, k, tq = F.col("s"), F.col("k"), F.col("tq")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n).cast("bigint")))
    rows = derived.spread(derived.images(spark, sf_dir).select("id", F.col("q").alias("s")), "id").select("id", "s", each(3).alias("tq")).select("*", each(63).alias("k"))
    custom = F.when((tq == 3) & (k < 8), 300)
    entry = quality.table_entry(tq, B.lookup(fixed.LUMA, k), B.lookup(fixed.CHROMA, k), F.array(s, 100 - s, F.lit(50).cast("bigint"), s % 7 * 10), custom, True)
    return rows.select("id", "tq", "k", entry.alias("q"))


@query(f"WITH {IMG} SELECT id, w % 16 = 0 AND h % 16 = 0 AS rot180, w % 16 = 0 AS flip_h, h % 16 = 0 AS flip_v FROM img")
def perfect_transform(spark, sf_dir):
    return derived.images(spark, sf_dir).select("id", *[B.perfect(op, F.col("w"), F.col("h"), 16, 16).alias(op) for op in ("rot180", "flip_h", "flip_v")])


@query(f"WITH {COEF} SELECT id, k, v, {CATEGORY.format('v')} AS category, CASE WHEN v >= 0 THEN v ELSE v + CAST(pow(2, {CATEGORY.format('v')}) AS BIGINT) - 1 END AS bits, v AS back FROM coef")
def magnitude_categories(spark, sf_dir):
    """Category and bits of every coefficient, and the value they are read back as."""
    t = derived.blocks(spark, sf_dir).select("id", "k", "v")
    t = t.withColumns({"category": quality.category(F.col("v")), "bits": quality.magnitude_bits(F.col("v"))})
    return t.withColumn("back", quality.extend(F.col("bits"), F.col("category")))


def _codes(name, bits, symbols, counts, frequencies):
    lengths = [n for n, c in enumerate(bits, 1) for _ in range(c)]
    rows = ", ".join(f"({i}, {n}, {s})" for i, (n, s) in enumerate(zip(lengths, symbols, strict=True)))
    sql = f"""WITH t AS (SELECT CAST(p AS BIGINT) AS position, CAST(l AS BIGINT) AS length, CAST(s AS BIGINT) AS symbol FROM (VALUES {rows}) t(p, l, s)),
    s AS (SELECT *, coalesce(sum(pow(2, 16 - length)) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
    SELECT position, length, CAST(before / pow(2, 16 - length) AS BIGINT) AS code, s.symbol, f.n, f.n * length AS bits FROM s JOIN ({counts}) f ON f.symbol = s.symbol"""

    @query(sql, name)
    def run(spark, sf_dir):
        """The codes that the symbols of all blocks take, and the bits of all of them."""
        codes = F.broadcast(entropy.canonical_codes(spark, bits, symbols))  # at most 256 rows
        return frequencies(spark, sf_dir).join(codes, "symbol").select("position", "length", "code", "symbol", "n", (F.col("n") * F.col("length")).alias("bits"))


def _ac(spark, sf_dir):
    return entropy.ac_frequencies(quantized(spark, sf_dir))


def _dc(spark, sf_dir):
    dc = quantized(spark, sf_dir).filter("k = 0").select("id", "v")
    return entropy.dc_frequencies(entropy.dc_differences(dc, 20))


_DC_COUNTS = f"""WITH {COEF}, {QUANT}, d AS (SELECT id, CAST(CASE WHEN v < 0 THEN -floor((-v + floor(q / 2.0)) / q) ELSE floor((v + floor(q / 2.0)) / q) END AS BIGINT) AS v FROM coef JOIN quant USING (k) WHERE k = 0),
e1 AS (SELECT v - coalesce(lag(v) OVER (PARTITION BY CAST(floor(id / 20.0) AS BIGINT) ORDER BY id), 0) AS d FROM d) SELECT {CATEGORY.format('d')} AS symbol, count(*) AS n FROM e1 GROUP BY 1"""
_codes("huffman_codes_dc_luma", fixed.DC_LUMA_BITS, list(range(12)), _DC_COUNTS, _dc)
_codes("huffman_codes_dc_chroma", fixed.DC_CHROMA_BITS, list(range(12)), _DC_COUNTS, _dc)
_codes("huffman_codes_ac_luma", fixed.AC_LUMA_BITS, fixed.AC_LUMA, SQL["huff_ac_freq"], _ac)
_codes("huffman_codes_ac_chroma", fixed.AC_CHROMA_BITS, fixed.AC_CHROMA, SQL["huff_ac_freq"], _ac)


@query(f"WITH {PIX}, {UNIFORM}, {NEAR} SELECT idx, pr AS r, pg AS g, pb AS b, count(*) AS n FROM near JOIN pal USING (idx) GROUP BY ALL")
def uniform_palette(spark, sf_dir):
    """The entries of the even grid that the pixels take, with their numbers."""
    pal = palette.uniform_palette(spark, 128)
    counts = palette.index_pixels(derived.pixels(spark, sf_dir), pal).groupBy("idx").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(pal), "idx").select("idx", "r", "g", "b", "n")  # at most 216 rows


@query(f"""WITH {SAMPLINGS}, {IMG} SELECT id, name, CAST(ceil(w / (sh*8.0)) * sh*8 * ceil(h / (sv*8.0)) * sv*8 * (2 + floor(4.0 / (sh*sv))) + 2048 AS BIGINT) AS jpeg,
 CAST(ceil(w / (sh*1.0)) * sh * ceil(h / (sv*1.0)) * sv + 2 * ceil(w / (sh*1.0)) * ceil(h / (sv*1.0)) AS BIGINT) AS yuv, CAST(ceil(w / (sh*1.0)) AS BIGINT) AS chroma_w, CAST(ceil(h / (sv*1.0)) AS BIGINT) AS chroma_h
FROM img JOIN s ON s.n = id % 6""")
def buffer_sizes(spark, sf_dir):
    w, h, sh, sv = (F.col(c) for c in ("w", "h", "sh", "sv"))
    return sampled(spark, sf_dir).select("id", "name", geometry.jpeg_buffer(w, h, sh, sv).alias("jpeg"), geometry.yuv_buffer(w, h, sh, sv).alias("yuv"), geometry.plane_width(1, w, sh).alias("chroma_w"), geometry.plane_height(1, h, sv).alias("chroma_h"))


@query(f"WITH {IMG} SELECT id, n, CAST(ceil(w * n / 8.0) AS BIGINT) AS scaled_w, CAST(ceil(h * n / 8.0) AS BIGINT) AS scaled_h FROM img, range(1, 17) b(n)")
def scaled_dimensions(spark, sf_dir):
    t = derived.spread(derived.images(spark, sf_dir), "id").select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(16).cast("bigint"))).alias("n"))
    return t.select("id", "n", *[geometry.scaled(F.col(c), F.col("n"), F.lit(8)).alias(f"scaled_{c}") for c in ("w", "h")])


@query(f"WITH {SAMPLINGS}, {IMG} SELECT id, CASE WHEN id % 7 = 6 THEN 'Unknown' ELSE name END AS found FROM img JOIN s ON s.n = id % 6")
def subsampling_detect(spark, sf_dir):
    """Factors of luminance and chrominance; every seventh image has a pair without a name."""
    t, i = sampled(spark, sf_dir), F.col("id")
    ch, cv = i % 2 + 1, i % 3 + 1  # factors of the chrominance; those of the luminance are multiples
    mh = F.when(i % 7 == 6, ch * 3).otherwise(F.col("sh") * ch)
    return t.select("id", geometry.subsampling(mh, F.col("sv") * cv, ch, cv).alias("found"))


_DOUBLE = "CASE WHEN {0} < 8 AND (mh * size) % (ch * {0} * 2) = 0 AND (mv * size) % (cv * {0} * 2) = 0 THEN {0} * 2 ELSE {0} END"


@query(f"""WITH {IMG}, g AS (SELECT *, CAST(floor(id / 16.0) AS BIGINT) % mh + 1 AS ch, CAST(floor(id / 64.0) AS BIGINT) % mv + 1 AS cv FROM img),
s1 AS (SELECT *, {_DOUBLE.format('size')} AS s1 FROM g), s2 AS (SELECT *, {_DOUBLE.format('s1')} AS s2 FROM s1) SELECT id, {_DOUBLE.format('s2')} AS out FROM s2""")
def component_block_size(spark, sf_dir):
    t = derived.images(spark, sf_dir)
    ch, cv = F.floor(F.col("id") / 16) % F.col("mh") + 1, F.floor(F.col("id") / 64) % F.col("mv") + 1
    return t.select("id", geometry.component_block_size(F.col("size"), F.col("mh"), F.col("mv"), ch, cv).alias("out"))


@query(f"WITH {IMG} SELECT id, w * h <= 90000 AND w * h * 3 + w * h * 3 <= 700000 AS ok FROM img")
def decode_limits(spark, sf_dir):
    return derived.images(spark, sf_dir).select("id", metadata.within_limits(F.col("w"), F.col("h"), F.lit(3), F.lit(3), 90000, 700000).alias("ok"))


@query(f"WITH {IMG} SELECT id, CASE WHEN id % 2 = 1 THEN 'own' WHEN id % 3 > 0 THEN 'w0' END AS stopped, CASE WHEN id % 2 = 1 THEN 'own' END AS going FROM img")
def stop_on_warning(spark, sf_dir):
    """Every second image ends with an error of its own, two of three have warnings."""
    i = F.col("id")
    error = F.when(i % 2 == 1, "own")
    warnings = F.filter(F.array(F.lit("w0"), F.lit("w1")), lambda w: F.substring(w, 2, 1).cast("bigint") < i % 3)
    return derived.images(spark, sf_dir).select("id", metadata.stop_on_warning(error, warnings).alias("stopped"), metadata.stop_on_warning(error, warnings, False).alias("going"))


@query(f"""WITH {IMG}, c AS (SELECT *, id % 110 AS x, id % 61 AS y, id % 59 AS cw, CASE WHEN id % 2 = 0 THEN 8 ELSE mh * 8 END AS unit FROM img)
SELECT id, unit, least(x, w) - least(x, w) % unit AS left_x, least(cw + least(x, w) % unit, w - least(x, w) + least(x, w) % unit) AS out_w, least(y, h) AS top_y, least(cw, h - least(y, h)) AS out_h FROM c""")
def crop_region(spark, sf_dir):
    """A region asked of every image; every second one is gray."""
    i = F.col("id")
    n = F.when(i % 2 == 0, 1).otherwise(3)
    region = geometry.crop_region(i % 110, i % 61, i % 59, i % 59, F.col("w"), F.col("h"), n, F.col("mh"))
    out = derived.images(spark, sf_dir).withColumn("c", region)
    return out.select("id", F.when(n == 1, 8).otherwise(F.col("mh") * 8).alias("unit"), F.col("c.x").alias("left_x"), F.col("c.w").alias("out_w"), F.col("c.y").alias("top_y"), F.col("c.h").alias("out_h"))


@query(f"""WITH {IMG}, t AS (SELECT id, mh AS a, mv AS b, id % 2 = 0 AS merged, id % 3 = 0 AS rgb, id % 5 = 0 AS fast, w % 9 AS cw FROM img)
SELECT id, CASE WHEN a = 1 AND b = 1 THEN 'none' WHEN merged AND rgb AND a = 2 AND b < 3 THEN 'merged' WHEN fast OR cw <= 2 THEN 'box'
 WHEN a = 2 AND b = 2 THEN 'fancy h2v2' WHEN a = 2 AND b = 1 THEN 'fancy h2v1' WHEN a = 1 AND b = 2 THEN 'fancy h1v2' ELSE 'box' END AS path FROM t""")
def upsample_path(spark, sf_dir):
    i, one = F.col("id"), F.lit(1)
    path = geometry.upsampling(F.col("mh"), F.col("mv"), one, one, i % 2 == 0, i % 3 == 0, i % 5 == 0, F.col("w") % 9, F.lit(8))
    return derived.images(spark, sf_dir).select("id", path.alias("path"))
