"""Registered queries over the driver's tables, and the SQL that checks them.

The tables hold no images; ``sources.derived`` says how pixels, planes and
coefficient blocks are read from them. Queries cover their whole table, but
``smooth_downsample``, ``pad_edges``, ``trim_blocks`` and ``transform_*`` keep
the fixed size of their SQL; each has a ``_whole`` version that takes width and
height from the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import color, fixed, quality
from .operators import blocks as B
from .operators import dct, entropy, metadata, palette, planes
from .sources import derived

QUERIES: dict = {}
SQL: dict = {}

PIX = """pix AS (SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_partkey % 20 AS BIGINT) AS x, CAST(floor(p_partkey / 20.0) AS BIGINT) AS y,
 CAST(p_partkey * 7 % 256 AS BIGINT) AS r, CAST(p_size * 5 % 256 AS BIGINT) AS g, CAST(floor(p_retailprice) AS BIGINT) % 256 AS b FROM part)"""
COEF = """e AS (SELECT vec_id AS id, unnest(embedding) AS e, unnest(range(64)) AS k FROM embeddings),
coef AS (SELECT id, id % 20 AS gx, CAST(floor(id / 20.0) AS BIGINT) AS gy, k, CAST(floor(CAST(e AS DOUBLE) * 256.0) AS BIGINT) AS v FROM e)"""
PLANE = COEF + """,
plane AS (SELECT gy * 8 + CAST(floor(k / 8.0) AS BIGINT) AS y, gx * 8 + k % 8 AS x, least(255, greatest(0, v + 128)) AS v FROM coef)"""
CLAMP = "CAST(least(255, greatest(0, {})) AS BIGINT)"
KEY64 = ", ".join(f"({i}, {q}, {c})" for i, (q, c) in enumerate(zip(fixed.LUMA, fixed.CHROMA, strict=True)))
QUANT = f"quant AS (SELECT CAST(k AS BIGINT) AS k, CAST(q AS BIGINT) AS q, CAST(c AS BIGINT) AS c FROM (VALUES {KEY64}) t(k, q, c))"
ZIG = "zig AS (SELECT CAST(z AS BIGINT) AS z, CAST(k AS BIGINT) AS k FROM (VALUES " + ", ".join(f"({z}, {k})" for z, k in enumerate(fixed.zigzag())) + ") t(z, k))"
QBLOCK = f"qb AS (SELECT id, coef.k, z, CAST(CASE WHEN v < 0 THEN -floor((-v + floor(q / 2.0)) / q) ELSE floor((v + floor(q / 2.0)) / q) END AS BIGINT) AS v FROM coef JOIN quant USING (k) JOIN zig ON zig.k = coef.k)"
CATEGORY = "CAST(" + " + ".join(f"(CASE WHEN abs({{0}}) >= {1 << i} THEN 1 ELSE 0 END)" for i in range(17)) + " AS BIGINT)"


def query(sql: str | None = None, name: str | None = None):
    """Register a query function, with its SQL where SQL can express it."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


# Colour

YCC = """ycc AS (SELECT id, x, y, (19595*r + 38470*g + 7471*b + 32768) >> 16 AS yy, (-11059*r - 21709*g + 32768*b + 8421375) >> 16 AS cb,
 (32768*r - 27439*g - 5329*b + 8421375) >> 16 AS cr FROM pix)"""
RGB = f"""rgb AS (SELECT id, x, y, yy, {CLAMP.format('yy + ((91881*(cr-128) + 32768) >> 16)')} AS r,
 {CLAMP.format('yy - ((22554*(cb-128) + 46802*(cr-128) + 32768) >> 16)')} AS g, {CLAMP.format('yy + ((116130*(cb-128) + 32768) >> 16)')} AS b FROM ycc)"""


def ycc(spark, sf_dir):
    p = derived.pixels(spark, sf_dir)
    yy, cb, cr = color.rgb_to_ycbcr("r", "g", "b")
    return p.select("id", "x", "y", yy.alias("yy"), cb.alias("cb"), cr.alias("cr"))


def rgb(spark, sf_dir, merged=False):
    r, g, b = color.ycbcr_to_rgb("yy", "cb", "cr", merged)
    return ycc(spark, sf_dir).select("id", "x", "y", "yy", r.alias("r"), g.alias("g"), b.alias("b"))


@query(f"WITH {PIX}, {YCC} SELECT yy, count(*) AS n, CAST(sum(cb) AS BIGINT) AS cb, CAST(sum(cr) AS BIGINT) AS cr FROM ycc GROUP BY yy")
def rgb_to_ycbcr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ycc(spark, sf_dir).groupBy("yy").agg(F.count(F.lit(1)).alias("n"), F.sum("cb").alias("cb"), F.sum("cr").alias("cr"))


@query(f"WITH {PIX}, {YCC} SELECT id, yy, cb, cr FROM ycc")
def rgb_to_ycbcr(spark, sf_dir):
    return ycc(spark, sf_dir).select("id", "yy", "cb", "cr")


@query("""WITH p AS (SELECT l_partkey % 256 AS r, l_suppkey % 256 AS g, CAST(floor(l_quantity * 5) AS BIGINT) % 256 AS b FROM lineitem)
SELECT (19595*r + 38470*g + 7471*b + 32768) >> 16 AS luma, count(*) AS n FROM p GROUP BY luma""")
def luminance_histogram(spark, sf_dir):
    p = derived.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 256).alias("r"), (F.col("l_suppkey") % 256).alias("g"), (F.floor(F.col("l_quantity") * 5) % 256).alias("b"))
    return p.groupBy(color.luma("r", "g", "b").alias("luma")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PIX}, {YCC}, {RGB} SELECT id, r, g, b FROM rgb")
def ycbcr_to_rgb(spark, sf_dir):
    return rgb(spark, sf_dir).select("id", "r", "g", "b")


@query(f"WITH {PIX}, {YCC} SELECT id, {CLAMP.format('yy + ((-22554*(cb-128) - 46802*(cr-128) + 32768) >> 16)')} AS g FROM ycc")
def merged_green(spark, sf_dir):
    return rgb(spark, sf_dir, merged=True).select("id", "g")


@query(f"WITH {PIX}, {YCC}, {RGB} SELECT id, ((b*256 + g)*256 + r)*256 + 255 AS bgra, ((255*256 + r)*256 + g)*256 + b AS argb, (r*256 + g)*256 + b AS rgb FROM rgb")
def channel_orders(spark, sf_dir):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return rgb(spark, sf_dir).select("id", (((b * 256 + g) * 256 + r) * 256 + 255).alias("bgra"), (((255 * 256 + r) * 256 + g) * 256 + b).alias("argb"), ((r * 256 + g) * 256 + b).alias("rgb"))


@query(f"WITH {PIX}, {YCC}, {RGB} SELECT id, (r >> 3) * 2048 + (g >> 2) * 32 + (b >> 3) AS packed FROM rgb")
def rgb565_pack(spark, sf_dir):
    return rgb(spark, sf_dir).select("id", color.rgb565("r", "g", "b").alias("packed"))


DITHER_SQL = "d AS (SELECT CAST(i AS BIGINT) AS i, CAST(d AS BIGINT) AS d FROM (VALUES " + ", ".join(f"({i}, {v})" for i, v in enumerate(fixed.DITHER)) + ") t(i, d))"


@query(f"""WITH {PIX}, {YCC}, {RGB}, {DITHER_SQL}
SELECT id, (least(255, r + d) >> 3) * 2048 + (least(255, g + (d >> 1)) >> 2) * 32 + (least(255, b + d) >> 3) AS packed,
 (least(255, yy + d) >> 3) * 2048 + (least(255, yy + (d >> 1)) >> 2) * 32 + (least(255, yy + d) >> 3) AS gray
FROM rgb JOIN d ON i = (y % 4) * 4 + x % 4""")
def rgb565_dither(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    return rgb(spark, sf_dir).select("id", color.rgb565_dithered("r", "g", "b", x, y).alias("packed"), color.rgb565_dithered("yy", "yy", "yy", x, y).alias("gray"))


@query(f"WITH {PIX} SELECT id, CAST(floor((r*g + 127) / 255.0) AS BIGINT) AS r, CAST(floor((b*g + 127) / 255.0) AS BIGINT) AS g, CAST(floor((x*12*g + 127) / 255.0) AS BIGINT) AS b FROM pix")
def cmyk_to_rgb(spark, sf_dir):
    p = derived.pixels(spark, sf_dir)
    r, g, b = color.cmyk_to_rgb("r", "b", F.col("x") * 12, "g")
    return p.select("id", r.alias("r"), g.alias("g"), b.alias("b"))


@query(f"WITH {PIX}, {YCC}, {RGB} SELECT rgb.id, 255 - rgb.r AS c, 255 - rgb.g AS m, 255 - rgb.b AS ye, pix.r AS k FROM rgb JOIN pix USING (id)")
def ycck_to_cmyk(spark, sf_dir):
    p = derived.pixels(spark, sf_dir)
    yy, cb, cr = color.rgb_to_ycbcr("r", "g", "b")
    q = p.select("id", yy.alias("yy"), cb.alias("cb"), cr.alias("cr"), F.col("r").alias("k"))
    return q.select("id", *[c.alias(n) for c, n in zip(color.ycck_to_cmyk("yy", "cb", "cr", "k"), ("c", "m", "ye", "k"), strict=True)])


@query(f"WITH {PIX} SELECT id, CAST(floor((r*16 + 7) * 255 / 4095.0) AS BIGINT) AS eight, (77*r + 150*g + 29*b) >> 8 AS gray FROM pix")
def twelve_bit_to_eight(spark, sf_dir):
    p = derived.pixels(spark, sf_dir)
    return p.select("id", color.from_12_bit(F.col("r") * 16 + 7).alias("eight"), color.gray_of_rgb8("r", "g", "b").alias("gray"))


# Quality and quantization


def quantized(spark, sf_dir):
    c = derived.blocks(spark, sf_dir)
    return c.select("id", "k", B.to_zigzag(F.col("k")).alias("z"), quality.quantize(F.col("v"), B.lookup(fixed.LUMA, F.col("k"))).alias("v"))


@query(f"WITH {COEF}, {QUANT}, {ZIG}, {QBLOCK} SELECT id, z, v FROM qb")
def quantize_blocks(spark, sf_dir):
    return quantized(spark, sf_dir).select("id", "z", "v")


@query(f"WITH {COEF}, {QUANT}, {ZIG}, {QBLOCK} SELECT id, qb.k, CAST(((v * q + 32768) % 65536 + 65536) % 65536 - 32768 AS BIGINT) AS v FROM qb JOIN quant ON quant.k = qb.k")
def dequantize_blocks(spark, sf_dir):
    q = quantized(spark, sf_dir)
    v = F.col("v") * B.lookup(fixed.LUMA, F.col("k"))
    return q.select("id", "k", (F.pmod(v + 32768, F.lit(65536)) - 32768).alias("v"))


@query(f"WITH {COEF}, {ZIG} SELECT id, z, v FROM coef JOIN zig USING (k)")
def zigzag(spark, sf_dir):
    return derived.blocks(spark, sf_dir).select("id", B.to_zigzag(F.col("k")).alias("z"), "v")


@query(f"WITH {COEF} SELECT id, CAST(least(255, greatest(0, ((v * 16 + 4) >> 3) + 128)) AS BIGINT) AS sample FROM coef WHERE k = 0")
def idct_1x1(spark, sf_dir):
    return derived.blocks(spark, sf_dir).filter("k = 0").select("id", B.dc_only_sample(F.col("v"), F.lit(16)).alias("sample"))


# Lossless transforms

SIGN = {"flip_h": "c", "flip_v": "r", "transpose": "0", "transverse": "r + c", "rot90": "r", "rot180": "r + c", "rot270": "c"}
#: full zone of the grid in blocks: the last column and row of the test grid count as partial
FULL_W, FULL_H = 19, 20
_x, _y = f"CASE WHEN gx < {FULL_W} THEN {FULL_W - 1} - gx ELSE gx END", f"CASE WHEN gy < {FULL_H} THEN {FULL_H - 1} - gy ELSE gy END"
GRID = {"flip_h": (_x, "gy"), "flip_v": ("gx", _y), "transpose": ("gy", "gx"), "transverse": (_y, _x), "rot90": (_y, "gx"), "rot180": (_x, _y), "rot270": ("gy", _x)}


def _spatial(op):
    to = "c * 8 + r" if op in B.SWAPS else "k"
    sql = f"WITH {COEF}, n AS (SELECT *, CAST(floor(k / 8.0) AS BIGINT) AS r, k % 8 AS c FROM coef) SELECT id, {to} AS k, CASE WHEN ({SIGN[op]}) % 2 = 1 THEN -v ELSE v END AS v FROM n"

    @query(sql, f"spatial_{op}")
    def run(spark, sf_dir):
        k, v = B.spatial(op, F.col("k"), F.col("v"))
        return derived.blocks(spark, sf_dir).select("id", k.alias("k"), v.alias("v"))

    w, h = f"gx < {FULL_W}", f"gy < {FULL_H}"
    signs = {
        "flip_h": f"CASE WHEN {w} THEN c ELSE 0 END", "flip_v": f"CASE WHEN {h} THEN r ELSE 0 END", "transpose": "0",
        "transverse": f"(CASE WHEN {h} THEN r ELSE 0 END) + (CASE WHEN {w} THEN c ELSE 0 END)", "rot90": f"CASE WHEN {h} THEN r ELSE 0 END",
        "rot270": f"CASE WHEN {w} THEN c ELSE 0 END", "rot180": f"(CASE WHEN {h} THEN r ELSE 0 END) + (CASE WHEN {w} THEN c ELSE 0 END)",
    }
    gx, gy = GRID[op]
    whole = f"WITH {COEF}, n AS (SELECT *, CAST(floor(k / 8.0) AS BIGINT) AS r, k % 8 AS c FROM coef) SELECT id, {gx} AS gx, {gy} AS gy, {to} AS k, CASE WHEN ({signs[op]}) % 2 = 1 THEN -v ELSE v END AS v FROM n"

    @query(whole, f"transform_{op}")
    def full(spark, sf_dir):
        return B.transform(derived.blocks(spark, sf_dir), op, FULL_W, FULL_H)


for _op in B.OPS[1:]:
    _spatial(_op)


def sized(rows: DataFrame, x: str, y: str) -> DataFrame:
    """``rows`` with the width and height of their grid."""
    return rows.crossJoin(F.broadcast(rows.agg((F.max(x) + 1).alias("w"), (F.max(y) + 1).alias("h"))))  # one row


GRID_SIZE = "g AS (SELECT max(gx) + 1 AS w, max(gy) + 1 AS h FROM coef)"


def _transform_whole(op):
    """The last column and row of the whole grid count as partial."""
    cols, rows = "gx < w - 1", "gy < h - 1"
    x, y = f"CASE WHEN {cols} THEN w - 2 - gx ELSE gx END", f"CASE WHEN {rows} THEN h - 2 - gy ELSE gy END"
    gx, gy = {"flip_h": (x, "gy"), "flip_v": ("gx", y), "transpose": ("gy", "gx"), "transverse": (y, x), "rot90": (y, "gx"), "rot180": (x, y), "rot270": ("gy", x)}[op]
    c, r = f"CASE WHEN {cols} THEN c ELSE 0 END", f"CASE WHEN {rows} THEN r ELSE 0 END"
    sign = {"c": c, "r": r, "0": "0", "r + c": f"({r}) + ({c})"}[SIGN[op]]
    to = "c * 8 + r" if op in B.SWAPS else "k"
    sql = f"WITH {COEF}, {GRID_SIZE}, n AS (SELECT coef.*, w, h, CAST(floor(k / 8.0) AS BIGINT) AS r, k % 8 AS c FROM coef, g) SELECT id, {gx} AS gx, {gy} AS gy, {to} AS k, CASE WHEN ({sign}) % 2 = 1 THEN -v ELSE v END AS v FROM n"

    @query(sql, f"transform_{op}_whole")
    def run(spark, sf_dir):
        return B.transform(sized(derived.blocks(spark, sf_dir), "gx", "gy"), op, F.col("w") - 1, F.col("h") - 1)


for _op in B.OPS[1:]:
    _transform_whole(_op)


@query(f"WITH {COEF}, {GRID_SIZE} SELECT id, gx, gy FROM coef, g WHERE k = 0 AND gx < CAST(floor((w * 8 - 5) / 16.0) AS BIGINT) * 2 AND gy < CAST(floor((h * 8 - 1) / 16.0) AS BIGINT) * 2")
def trim_blocks_whole(spark, sf_dir):
    """The image ends 5 columns and a row before its last blocks do."""
    dc = derived.blocks(spark, sf_dir).filter("k = 0")
    w, h = dc.agg(F.max("gx") + 1, F.max("gy") + 1).first()
    return B.trim(dc, "rot180", w * 8 - 5, h * 8 - 1, 16, 16).select("id", "gx", "gy")


@query(f"WITH {COEF} SELECT id, gx, gy FROM coef WHERE k = 0 AND gx < 18 AND gy < 24")
def trim_blocks(spark, sf_dir):
    return B.trim(derived.blocks(spark, sf_dir).filter("k = 0"), "rot180", 155, 199, 16, 16).select("id", "gx", "gy")


@query(f"WITH {COEF} SELECT id, gx - 2 AS gx, gy - 4 AS gy, k, v FROM coef WHERE gx BETWEEN 2 AND 5 AND gy BETWEEN 4 AND 9")
def crop_blocks(spark, sf_dir):
    return B.crop(derived.blocks(spark, sf_dir), 17, 37, 30, 40, 160, 200, 16, 16)


# Symbols


@query(f"WITH {COEF} SELECT id, v - coalesce(lag(v) OVER (ORDER BY id), 0) AS d, v - coalesce(lag(v) OVER (PARTITION BY CAST(floor(id / 7.0) AS BIGINT) ORDER BY id), 0) AS restarted FROM coef WHERE k = 0")
def dc_differential(spark, sf_dir):
    dc = derived.blocks(spark, sf_dir).filter("k = 0").select("id", "v")
    return entropy.dc_differences(dc, 7).withColumnRenamed("d", "restarted").join(entropy.dc_differences(dc).select("id", "d"), "id").select("id", "d", "restarted")


@query(f"WITH {COEF} SELECT id, v FROM coef WHERE k = 0")
def dc_restore(spark, sf_dir):
    dc = derived.blocks(spark, sf_dir).filter("k = 0").select("id", "v")
    return entropy.dc_restore(entropy.dc_differences(dc, 7).drop("v"), 7).select("id", "v")


@query(f"""WITH {COEF}, {QUANT}, {ZIG}, {QBLOCK}, d AS (SELECT v - coalesce(lag(v) OVER (ORDER BY id), 0) AS d FROM qb WHERE k = 0)
SELECT {CATEGORY.format('d')} AS symbol, count(*) AS n FROM d GROUP BY symbol""")
def huff_dc_freq(spark, sf_dir):
    return entropy.dc_frequencies(entropy.dc_differences(quantized(spark, sf_dir).filter("k = 0").select("id", "v")))


@query(f"""WITH {COEF}, {QUANT}, {ZIG}, {QBLOCK},
r AS (SELECT id, v, z - coalesce(lag(z) OVER (PARTITION BY id ORDER BY z), 0) - 1 AS run FROM qb WHERE z > 0 AND v <> 0),
l AS (SELECT id, max(CASE WHEN z > 0 AND v <> 0 THEN z END) AS last FROM qb GROUP BY id),
s AS (SELECT run % 16 * 16 + {CATEGORY.format('v')} AS symbol, 1 AS n FROM r UNION ALL SELECT 240, CAST(floor(run / 16.0) AS BIGINT) FROM r WHERE run > 15
 UNION ALL SELECT 0, 1 FROM l WHERE last IS NULL OR last < 63)
SELECT CAST(symbol AS BIGINT) AS symbol, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY symbol""")
def huff_ac_freq(spark, sf_dir):
    return entropy.ac_frequencies(quantized(spark, sf_dir))


# Lossless prediction

GUESS = ["a", "b", "c", "a + b - c", "a + ((b - c) >> 1)", "b + ((a - c) >> 1)", "(a + b) >> 1"]


def _lossless(n):
    sql = f"""WITH {PLANE}, n1 AS (SELECT *, lag(v) OVER (PARTITION BY y ORDER BY x) AS a, lag(v) OVER (PARTITION BY x ORDER BY y) AS b FROM plane),
    n2 AS (SELECT *, lag(b) OVER (PARTITION BY y ORDER BY x) AS c FROM n1),
    d AS (SELECT y, x, ((v - CASE WHEN a IS NULL AND b IS NULL THEN 128 WHEN b IS NULL THEN a WHEN a IS NULL THEN b ELSE {GUESS[n - 1]} END) % 256 + 256) % 256 AS d FROM n2)
    SELECT y, x, CASE WHEN d >= 128 THEN d - 256 ELSE d END AS d FROM d"""

    @query(sql, f"lossless_predictor_{n}")
    def run(spark, sf_dir):
        return planes.lossless_difference(derived.samples(spark, sf_dir), n)


for _n in range(1, 8):
    _lossless(_n)


@query(f"WITH {PLANE} SELECT y, x, v FROM plane")
def lossless_restore(spark, sf_dir):
    return planes.undo_left_prediction(planes.lossless_difference(derived.samples(spark, sf_dir), 1))


# Resampling

@query(f"WITH {PLANE} SELECT y * 2 + dy AS y, x * 2 + dx AS x, v FROM plane, range(2) a(dx), range(2) b(dy)")
def upsample_nearest(spark, sf_dir):
    return planes.replicate(derived.samples(spark, sf_dir), 2, 2)


@query(f"""WITH {PLANE}, n AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS c FROM plane WINDOW w AS (PARTITION BY y ORDER BY x))
SELECT y, x * 2 AS x, CASE WHEN a IS NULL THEN v ELSE (3*v + a + 1) >> 2 END AS v FROM n UNION ALL SELECT y, x * 2 + 1, CASE WHEN c IS NULL THEN v ELSE (3*v + c + 2) >> 2 END FROM n""")
def upsample_fancy_h2v1(spark, sf_dir):
    return planes.fancy_h2v1(derived.samples(spark, sf_dir))


@query(f"""WITH {PLANE}, n AS (SELECT *, coalesce(lag(v) OVER w, v) AS a, coalesce(lead(v) OVER w, v) AS c FROM plane WINDOW w AS (PARTITION BY x ORDER BY y))
SELECT y * 2 AS y, x, (3*v + a + 1) >> 2 AS v FROM n UNION ALL SELECT y * 2 + 1, x, (3*v + c + 2) >> 2 FROM n""")
def upsample_fancy_h1v2(spark, sf_dir):
    return planes.fancy_h1v2(derived.samples(spark, sf_dir))


@query(f"""WITH {PLANE}, n AS (SELECT *, coalesce(lag(v) OVER w, v) AS a, coalesce(lead(v) OVER w, v) AS c FROM plane WINDOW w AS (PARTITION BY x ORDER BY y)),
s AS (SELECT y * 2 AS y, x, 3*v + a AS s FROM n UNION ALL SELECT y * 2 + 1, x, 3*v + c FROM n),
m AS (SELECT *, lag(s) OVER w AS a, lead(s) OVER w AS c FROM s WINDOW w AS (PARTITION BY y ORDER BY x))
SELECT y, x * 2 AS x, (coalesce(3*s + a, 4*s) + 8) >> 4 AS v FROM m UNION ALL SELECT y, x * 2 + 1, (coalesce(3*s + c, 4*s) + 7) >> 4 FROM m""")
def upsample_fancy_h2v2(spark, sf_dir):
    return planes.fancy_h2v2(derived.samples(spark, sf_dir))


def _box(fx, fy, bias):
    return f"""WITH {PLANE}, s AS (SELECT CAST(floor(y / {fy}.0) AS BIGINT) AS y, CAST(floor(x / {fx}.0) AS BIGINT) AS x, CAST(sum(v) AS BIGINT) AS s FROM plane GROUP BY 1, 2)
    SELECT y, x, CAST(floor((s + {bias}) / {fx * fy}.0) AS BIGINT) AS v FROM s"""


@query(_box(2, 1, "x % 2"))
def downsample_h2v1(spark, sf_dir):
    return planes.downsample(derived.samples(spark, sf_dir), 2, 1)


@query(_box(2, 2, "x % 2 + 1"))
def downsample_h2v2(spark, sf_dir):
    return planes.downsample(derived.samples(spark, sf_dir), 2, 2)


@query(_box(4, 1, "2"))
def downsample_h4v1(spark, sf_dir):
    return planes.downsample(derived.samples(spark, sf_dir), 4, 1)


@query(f"""WITH {PLANE}, s AS (SELECT CAST(floor(y / 3.0) AS BIGINT) AS y, CAST(floor(x / 3.0) AS BIGINT) AS x, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM plane GROUP BY 1, 2)
SELECT y, x, CAST(floor((s + floor(n / 2.0)) / n) AS BIGINT) AS v FROM s""")
def downsample_mean(spark, sf_dir):
    return planes.downsample(derived.samples(spark, sf_dir), 3, 3, mean=True)


@query(f"""WITH {PLANE}, n AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS c FROM plane WINDOW w AS (PARTITION BY y ORDER BY x)),
h AS (SELECT y, x, coalesce((a + 2*v + c + 2) >> 2, v) AS v FROM n), m AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS c FROM h WINDOW w AS (PARTITION BY x ORDER BY y))
SELECT y, x, coalesce((a + 2*v + c + 2) >> 2, v) AS v FROM m""")
def triangle_prefilter(spark, sf_dir):
    return planes.triangle(planes.triangle(derived.samples(spark, sf_dir), "x"), "y")


@query(f"""WITH {PLANE}, a AS (SELECT *, v + coalesce(lag(v) OVER w, v) + coalesce(lead(v) OVER w, v) AS s FROM plane WINDOW w AS (PARTITION BY x ORDER BY y)),
b AS (SELECT *, coalesce(lag(s) OVER w, s) + s - v + coalesce(lead(s) OVER w, s) AS n FROM a WINDOW w AS (PARTITION BY y ORDER BY x))
SELECT y, x, {CLAMP.format('(v * (65536 - 40 * 512) + n * 40 * 64 + 32768) >> 16')} AS v FROM b""")
def smooth_full(spark, sf_dir):
    return planes.smooth(derived.samples(spark, sf_dir), 40)


@query(f"""WITH {PLANE}, d AS (SELECT CAST(d AS BIGINT) AS d FROM range(-1, 3) t(d)), whole AS (SELECT y, x, v FROM plane WHERE y < 192),
c AS (SELECT DISTINCT CAST(floor(y / 2.0) AS BIGINT) AS cy, CAST(floor(x / 2.0) AS BIGINT) AS cx FROM whole),
n AS (SELECT cy, cx, least(191, greatest(0, cy*2 + a.d)) AS y, least(159, greatest(0, cx*2 + b.d)) AS x,
 CASE WHEN a.d IN (0, 1) AND b.d IN (0, 1) THEN 16384 - 40*80 WHEN a.d IN (0, 1) OR b.d IN (0, 1) THEN 40*32 ELSE 40*16 END AS w FROM c, d a, d b)
SELECT cy AS y, cx AS x, {CLAMP.format('(CAST(sum(v * w) AS BIGINT) + 32768) >> 16')} AS v FROM n JOIN whole USING (y, x) GROUP BY cy, cx""")
def smooth_downsample(spark, sf_dir):
    return planes.smooth_downsample(derived.samples(spark, sf_dir).filter("y < 192"), 160, 192, 40)


@query(f"WITH {PIX}, s AS (SELECT DISTINCT px, least(px, 19) AS x FROM range(24) t(px)) SELECT y, px AS x, r AS v FROM pix JOIN s USING (x) WHERE id >= 20 AND y <= 4")
def pad_edges(spark, sf_dir):
    p = derived.pixels(spark, sf_dir).filter("id >= 20 AND y <= 4").select("y", "x", F.col("r").alias("v"))
    return planes.pad_edges(p, 20, 5, 24, 5)


@query(f"""WITH {PLANE}, d AS (SELECT CAST(d AS BIGINT) AS d FROM range(-1, 3) t(d)), g AS (SELECT max(x) AS w, max(y) AS h FROM plane),
c AS (SELECT DISTINCT CAST(floor(y / 2.0) AS BIGINT) AS cy, CAST(floor(x / 2.0) AS BIGINT) AS cx FROM plane),
n AS (SELECT cy, cx, least(h, greatest(0, cy*2 + a.d)) AS y, least(w, greatest(0, cx*2 + b.d)) AS x,
 CASE WHEN a.d IN (0, 1) AND b.d IN (0, 1) THEN 16384 - 40*80 WHEN a.d IN (0, 1) OR b.d IN (0, 1) THEN 40*32 ELSE 40*16 END AS w FROM c, g, d a, d b)
SELECT cy AS y, cx AS x, {CLAMP.format('(CAST(sum(v * w) AS BIGINT) + 32768) >> 16')} AS v FROM n JOIN plane USING (y, x) GROUP BY cy, cx""")
def smooth_downsample_whole(spark, sf_dir):
    plane = derived.samples(spark, sf_dir)
    w, h = plane.agg(F.max("x") + 1, F.max("y") + 1).first()
    return planes.smooth_downsample(plane, w, h, 40)


@query(f"""WITH {PIX}, g AS (SELECT max(x) AS w, max(y) AS h FROM pix), px AS (SELECT px, least(px, w) AS x FROM g, unnest(range(CAST(floor(w / 8.0) AS BIGINT) * 8 + 8)) t(px)),
py AS (SELECT py, least(py, h) AS y FROM g, unnest(range(CAST(floor(h / 8.0) AS BIGINT) * 8 + 8)) t(py))
SELECT py AS y, px AS x, r AS v FROM pix JOIN px USING (x) JOIN py USING (y)""")
def pad_edges_whole(spark, sf_dir):
    """Both sides padded to whole blocks."""
    p = derived.pixels(spark, sf_dir).select("y", "x", F.col("r").alias("v"))
    w, h = p.agg(F.max("x") + 1, F.max("y") + 1).first()
    return planes.pad_edges(p, w, h, -(-w // 8) * 8, -(-h // 8) * 8)


@query(f"""WITH {COEF}, c AS (SELECT id, CAST(sum(v) AS BIGINT) AS dc FROM coef GROUP BY id) SELECT id, dc FROM c""")
def fdct_dc(spark, sf_dir):
    """The DC coefficient of the forward transform is the sum of the samples."""
    rows = derived.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda e: F.floor(e.cast("double") * 256)).alias("block"))
    return dct.forward(rows).select("id", F.element_at("block", 1).alias("dc"))


# Planar images

MEAN = "CAST(floor((sum({0}) + floor(count(*) / 2.0)) / count(*)) AS BIGINT)"


@query(f"""WITH {PIX}, {YCC} SELECT 0 AS plane, y, x, yy AS v FROM ycc
UNION ALL SELECT 1, CAST(floor(y / 2.0) AS BIGINT) AS cy, CAST(floor(x / 2.0) AS BIGINT) AS cx, {MEAN.format('cb')} FROM ycc GROUP BY cy, cx
UNION ALL SELECT 2, CAST(floor(y / 2.0) AS BIGINT) AS cy, CAST(floor(x / 2.0) AS BIGINT) AS cx, {MEAN.format('cr')} FROM ycc GROUP BY cy, cx""")
def yuv420_encode(spark, sf_dir):
    """Planes of a 4:2:0 image: full luma, rounded means of both chroma planes."""
    full = ycc(spark, sf_dir)
    out = full.select(F.lit(0).alias("plane"), "y", "x", F.col("yy").alias("v"))
    for i, c in ((1, "cb"), (2, "cr")):
        out = out.unionByName(planes.downsample(full.select("y", "x", F.col(c).alias("v")), 2, 2, mean=True).select(F.lit(i).alias("plane"), "y", "x", "v"))
    return out


@query(f"""WITH {PIX}, {YCC}, c AS (SELECT y, CAST(floor(x / 2.0) AS BIGINT) AS cx, {MEAN.format('cb')} AS cb, {MEAN.format('cr')} AS cr FROM ycc GROUP BY 1, 2)
SELECT id, {CLAMP.format('yy + ((91881*(c.cr-128) + 32768) >> 16)')} AS r, {CLAMP.format('yy + ((-22554*(c.cb-128) - 46802*(c.cr-128) + 32768) >> 16)')} AS g,
 {CLAMP.format('yy + ((116130*(c.cb-128) + 32768) >> 16)')} AS b FROM ycc JOIN c ON c.y = ycc.y AND c.cx = CAST(floor(x / 2.0) AS BIGINT)""")
def merged_upsample_h2v1(spark, sf_dir):
    """4:2:2 planes to RGB with shared chroma: a lookup join of luma with its chroma sample."""
    full = ycc(spark, sf_dir)
    chroma = full.groupBy("y", F.floor(F.col("x") / 2).alias("cx")).agg(*[F.floor((F.sum(c) + F.floor(F.count(F.lit(1)) / 2)) / F.count(F.lit(1))).alias(c) for c in ("cb", "cr")])
    joined = full.select("id", "y", F.floor(F.col("x") / 2).alias("cx"), "yy").join(chroma, ["y", "cx"])
    return joined.select("id", *[v.alias(n) for v, n in zip(color.ycbcr_to_rgb("yy", "cb", "cr", merged=True), "rgb", strict=True)])


# Palette

@query(f"WITH {PIX} SELECT r, g, b, count(*) AS n FROM pix GROUP BY r, g, b")
def palette_histogram(spark, sf_dir):
    return palette.histogram(derived.pixels(spark, sf_dir))


UNIFORM = "pal AS (SELECT i AS idx, CAST(floor(CAST(floor(i / 25.0) AS BIGINT) * 255 / 4.0) AS BIGINT) AS pr, CAST(floor(CAST(floor(i / 5.0) AS BIGINT) % 5 * 255 / 4.0) AS BIGINT) AS pg, CAST(floor(i % 5 * 255 / 4.0) AS BIGINT) AS pb FROM range(125) t(i))"
NEAR = "near AS (SELECT id, min(((r-pr)*(r-pr) + (g-pg)*(g-pg) + (b-pb)*(b-pb)) * 1000 + idx) % 1000 AS idx FROM pix, pal GROUP BY id)"


@query(f"WITH {PIX}, {UNIFORM}, {NEAR} SELECT id, idx FROM near")
def nearest_palette(spark, sf_dir):
    return palette.index_pixels(derived.pixels(spark, sf_dir), palette.uniform_palette(spark, 128)).select("id", "idx")


@query(f"WITH {PIX}, {UNIFORM}, {NEAR} SELECT id, idx, pr AS r, pg AS g, pb AS b FROM near JOIN pal USING (idx)")
def dequantize_palette(spark, sf_dir):
    pal = palette.uniform_palette(spark, 128)
    return palette.color_of(palette.index_pixels(derived.pixels(spark, sf_dir), pal), pal).select("id", "idx", "r", "g", "b")


@query(f"""WITH {PIX}, {UNIFORM}, {NEAR}, q AS (SELECT id, pr AS r, pg AS g, pb AS b FROM near JOIN pal USING (idx)),
small AS (SELECT i AS idx, CAST(floor(CAST(floor(i / 9.0) AS BIGINT) * 255 / 2.0) AS BIGINT) AS pr, CAST(floor(CAST(floor(i / 3.0) AS BIGINT) % 3 * 255 / 2.0) AS BIGINT) AS pg, CAST(floor(i % 3 * 255 / 2.0) AS BIGINT) AS pb FROM range(27) t(i))
SELECT id, min(((r-pr)*(r-pr) + (g-pg)*(g-pg) + (b-pb)*(b-pb)) * 1000 + idx) % 1000 AS idx FROM q, small GROUP BY id""")
def requantize_palette(spark, sf_dir):
    """Indices of one palette to those of another: colours are looked up, then mapped."""
    pal = palette.uniform_palette(spark, 128)
    shown = palette.color_of(palette.index_pixels(derived.pixels(spark, sf_dir), pal), pal).select("id", "r", "g", "b")
    return palette.index_pixels(shown, palette.uniform_palette(spark, 30)).select("id", "idx")


@query()
def median_cut_palette(spark, sf_dir):
    return palette.median_cut(derived.pixels(spark, sf_dir), 16)


# Metadata

@query("""WITH c AS (SELECT conv_id AS image_id, turn + 1 AS seq_no, text FROM conversations),
g AS (SELECT image_id, count(*) AS n, count(DISTINCT seq_no) AS d, min(seq_no) AS lo, max(seq_no) AS hi, string_agg(text, '' ORDER BY seq_no) AS profile FROM c GROUP BY image_id)
SELECT image_id, CASE WHEN n = d AND lo = 1 AND hi = n THEN profile END AS profile FROM g""")
def icc_reassemble(spark, sf_dir):
    """Chunks by conversation; the count every chunk states is that of its turns."""
    t = derived.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("image_id"), (F.col("turn") + 1).alias("seq_no"), F.col("text").alias("data"))
    counts = t.groupBy("image_id").agg(F.count(F.lit(1)).alias("num"))
    return metadata.reassemble(t.join(counts, "image_id"))


MARK = "m AS (SELECT event_id AS ordinal, user_id AS image_id, 224 + event_id % 31 AS marker, event_type AS payload FROM events)"


def segments(spark, sf_dir):
    e = derived.table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("ordinal"), F.col("user_id").alias("image_id"), (224 + F.col("event_id") % 31).alias("marker"), F.col("event_type").alias("payload"))


@query(f"WITH {MARK} SELECT ordinal, marker FROM m WHERE marker BETWEEN 224 AND 239 OR marker = 254")
def saved_markers(spark, sf_dir):
    return metadata.saved_markers(segments(spark, sf_dir)).select("ordinal", "marker")


@query(f"WITH {MARK} SELECT ordinal, marker FROM m WHERE marker BETWEEN 225 AND 239 OR marker = 254")
def copied_markers(spark, sf_dir):
    return metadata.copied_markers(segments(spark, sf_dir)).select("ordinal", "marker")


@query(f"WITH {MARK} SELECT image_id, arg_max(payload, ordinal) AS comment FROM m WHERE marker = 254 GROUP BY image_id")
def last_comment(spark, sf_dir):
    return metadata.last_comment(segments(spark, sf_dir))


from . import file_queries  # noqa: E402, F401  registers its own here
from . import batch_queries, size_queries  # noqa: E402, F401  as well
