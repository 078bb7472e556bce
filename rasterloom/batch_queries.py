"""Registered queries over many images at once: smoothing across blocks, inverse
transforms to any size, quantization, restoring and transforms by image, bit
packing, progressive scans, ranges of rows and damaged data."""

from __future__ import annotations

from pyspark.sql import functions as F

from .file_queries import _idct, _inverse_sql, _matrix, _samples
from .functions import fixed
from .functions.quality import quantize
from .operators import bitpack, dct, entropy, palette, planes, recovery, scan_symbols, smoothing
from .operators import blocks as B
from .plans import transform
from .queries import COEF, PIX, PLANE, QUANT, ZIG, query
from .sources import derived, images

# Inverse transforms to any size

for _n in dct.CORRECTIONS:
    _idct(f"idct_{_n}x{_n}", dct.INVERSE[_n][0].tolist(), _n, 11, 18)

_WEIGHTS = ", ".join(f"({n}, {11 + more}, {18 + more}, {o}, {f}, {w})" for n, (rows, more) in dct.INVERSE.items() for o, r in enumerate(rows.tolist()) for f, w in enumerate(r))
_MIXED = f"""WITH {_samples(64)}, w AS (SELECT * FROM (VALUES {_WEIGHTS}) t(n, s1, s2, o, f, w)),
y AS (SELECT id, id % 16 + 1 AS n, r, c, v * 16 AS v FROM x),
a AS (SELECT id, n, o AS r, c, (CAST(sum(w * v) AS BIGINT) + (1 << (s1 - 1))) >> s1 AS v FROM y JOIN w USING (n) WHERE f = r GROUP BY id, n, s1, o, c),
b AS (SELECT id, n, r, o AS c, (CAST(sum(w * v) AS BIGINT) + (1 << (s2 - 1))) >> s2 AS v FROM a JOIN w USING (n) WHERE f = c GROUP BY id, n, s2, r, o)
SELECT id, n, r * n + c AS k, least(255, greatest(0, v + 128)) AS v FROM b
UNION ALL SELECT id, n, 0, least(255, greatest(0, ((v + 4) >> 3) + 128)) FROM y WHERE n = 1 AND r = 0 AND c = 0"""


@query(_MIXED)
def idct_mixed_sizes(spark, sf_dir):
    """Every block to the size its row asks for, 1 to 16."""
    rows = derived.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda e: F.floor(e.cast("double") * 64)).alias("block"), (F.col("vec_id") % 16 + 1).alias("n"))
    out = dct.inverse_sizes(rows.withColumn("q", F.array_repeat(F.lit(16), 64)), "n", quant="q")
    return out.select("id", "n", F.posexplode("block").alias("k", "v")).withColumn("k", F.col("k").cast("bigint"))


# Smoothing

#: Images of 20 x 5 blocks; each has scans enough to know some AC bits, or DC only.
_IMAGE = "floor(gy / 5)"


def _block_images(spark, sf_dir):
    coef = derived.blocks(spark, sf_dir).withColumn("v", quantize(F.col("v"), B.lookup(fixed.LUMA, F.col("k")) * 2))
    gathered = coef.groupBy("id", "gx", "gy").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda s: s.v).alias("block"))  # 64 numbers
    return gathered.select(F.floor(F.col("gy") / 5).alias("image"), F.lit(0).alias("component"), "gx", (F.col("gy") % 5).alias("gy"), "block", "id")


def _tables(blocks, bits):
    each = blocks.select("image", "component").distinct()
    return each.withColumn("bits", bits), each.withColumn("quant", F.array(*map(F.lit, fixed.LUMA)))


def _low(smoothed):
    return smoothed.select("id", F.posexplode("block").alias("k", "v")).withColumn("k", F.col("k").cast("bigint"))


def _stencils() -> str:
    places = ", ".join(f"({z}, {smoothing.PLACES[z]}, {i // 5}, {i % 5}, {w})" for z, weights in smoothing.KNOWN.items() for i, w in enumerate(weights) if w)
    return f"st AS (SELECT * FROM (VALUES {places}) t(z, k, i, j, w))"


_BLOCKS = f"""qb AS (SELECT id, CAST(floor(gy / 5.0) AS BIGINT) AS image, gx, gy % 5 AS gy, coef.k, CAST(CASE WHEN v < 0 THEN -floor((-v + q) / (2 * q)) ELSE floor((v + q) / (2 * q)) END AS BIGINT) AS v FROM coef JOIN quant USING (k)),
size AS (SELECT image, max(gx) AS mx, max(gy) AS my FROM qb GROUP BY image)"""


@query(f"""WITH {COEF}, {QUANT}, {_BLOCKS}, {_stencils()},
al AS (SELECT image, z, (image + z) % 4 - 1 AS al FROM size, (SELECT DISTINCT z FROM st)),
near AS (SELECT b.id, b.image, st.z, st.k, CAST(sum(st.w * n.v) AS BIGINT) AS total FROM qb b JOIN size USING (image), st, qb n
  WHERE b.k = 0 AND n.k = 0 AND n.image = b.image AND n.gy = least(my, greatest(0, b.gy + st.i - 2)) AND n.gx = least((SELECT max(gx) FROM qb r WHERE r.image = b.image AND r.gy = n.gy), greatest(0, b.gx + st.j - 2)) GROUP BY ALL),
p AS (SELECT id, near.k, al, total, CAST(floor((q * 128 + abs(total * 16)) / (q * 256)) AS BIGINT) AS s FROM near JOIN al USING (image, z) JOIN quant USING (k)),
f AS (SELECT id, k, CASE WHEN total < 0 THEN -1 ELSE 1 END * CASE WHEN al > 0 AND s >= (1 << al) THEN (1 << al) - 1 ELSE s END AS s FROM p WHERE al <> 0)
SELECT id, k, CASE WHEN qb.v = 0 THEN coalesce(f.s, 0) ELSE qb.v END AS v FROM qb LEFT JOIN f USING (id, k)""")
def block_smoothing(spark, sf_dir):
    """Images of which some AC bits are known: predictions from the DC values around."""
    blocks = _block_images(spark, sf_dir)
    image = F.col("image").cast("int")
    bits, quant = _tables(blocks, F.array(F.lit(0), *[(image + z) % 4 - 1 for z in range(1, 6)], *[F.lit(0)] * 4))
    return _low(smoothing.smooth(blocks, bits, quant))


@query()
def block_smoothing_dc(spark, sf_dir):
    """Images of which only DC values are known: these are smoothed in reading order too."""
    blocks = _block_images(spark, sf_dir)
    only = F.transform("block", lambda v, k: F.when(k == 0, v).otherwise(0))
    blocks = blocks.withColumn("block", only)
    bits, quant = _tables(blocks, F.array(F.lit(1), *[F.lit(-1)] * 9))
    return _low(smoothing.smooth(blocks, bits, quant))


@query("""WITH s AS (SELECT user_id AS image, event_id % 3 AS component, event_id AS scan, event_id * 7 % 10 AS ss, event_id * 7 % 10 + event_id % 5 AS se, event_id % 4 AS al FROM events),
g AS (SELECT image, component, k, arg_max(al, scan) FILTER (k BETWEEN ss AND se) AS al FROM s, range(10) r(k) GROUP BY image, component, k)
SELECT image, component, k, coalesce(al, -1) AS bits FROM g""")
def coefficient_bits(spark, sf_dir):
    """How exactly the ten lowest coefficients are known after a table of scans."""
    e = derived.table(spark, sf_dir, "events")
    i = F.col("event_id")
    scans = e.select(F.col("user_id").alias("image"), (i % 3).alias("component"), i.alias("scan"), (i * 7 % 10).alias("ss"), (i * 7 % 10 + i % 5).alias("se"), (i % 4).alias("al"))
    return smoothing.coefficient_bits(scans).select("image", "component", F.posexplode("bits").alias("k", "bits"))


# Many images of pixels

def _pixel_images(spark, sf_dir):
    """Images of 20 x 25 pixels."""
    p = derived.pixels(spark, sf_dir)
    return p.withColumns({"image": F.floor(F.col("y") / 25), "y": F.col("y") % 25})


@query()
def error_diffusion(spark, sf_dir):
    """Every image to 16 colours of its own with error diffusion."""
    return palette.quantize_images(_pixel_images(spark, sf_dir), 16, "median_cut", "diffused")[1].select("id", "idx")


@query()
def quantize_images(spark, sf_dir):
    """Every image to 16 colours of its own with ordered dither."""
    return palette.quantize_images(_pixel_images(spark, sf_dir), 16, "median_cut", "ordered")[1].select("id", "idx")


for _p in range(3, 8):

    def _restore(spark, sf_dir, number=_p):
        """Planes of 40 rows, each restored by itself."""
        whole = derived.samples(spark, sf_dir).withColumns({"image": F.floor(F.col("y") / 40), "y": F.col("y") % 40})
        return planes.undo_prediction(planes.lossless_difference(whole, number, keys=("image",)), number, keys=("image",))

    query(f"WITH {PLANE} SELECT CAST(floor(y / 40.0) AS BIGINT) AS image, y % 40 AS y, x, v FROM plane", f"lossless_restore_images_{_p}")(_restore)


# Bit packing

def _luma_tables(spark):
    """Codes of the luminance tables by kind."""
    dc = entropy.canonical_codes(spark, fixed.DC_LUMA_BITS, list(range(12)))
    ac = entropy.canonical_codes(spark, fixed.AC_LUMA_BITS, fixed.AC_LUMA)
    return dc.withColumn("kind", F.lit("dc")).unionByName(ac.withColumn("kind", F.lit("ac")))


def coded_blocks(spark, sf_dir):
    """Quantized blocks in zigzag order: image, id, z, v."""
    coef = derived.blocks(spark, sf_dir)
    v = quantize(F.col("v"), B.lookup(fixed.LUMA, F.col("k")))
    return coef.select(F.floor(F.col("gy") / 5).alias("image"), (F.col("gy") % 5 * 20 + F.col("gx")).alias("id"), B.to_zigzag(F.col("k")).alias("z"), v.alias("v"))


@query()
def pack_bits(spark, sf_dir):
    """Entropy-coded segments of every image, restarted every 20 blocks, in rows of bytes with markers."""
    words = bitpack.code_words(bitpack.block_symbols(coded_blocks(spark, sf_dir), 20), _luma_tables(spark))
    return bitpack.with_markers(bitpack.pack(words)).select("image", "segment", "chunk", F.hex("content").alias("content"))


@query(f"""WITH {COEF}, {QUANT}, {ZIG}, q AS (SELECT id, z, CAST(CASE WHEN v < 0 THEN -floor((-v + floor(q / 2.0)) / q) ELSE floor((v + floor(q / 2.0)) / q) END AS BIGINT) AS v FROM coef JOIN quant USING (k) JOIN zig ON zig.k = coef.k),
d AS (SELECT id, z, v - coalesce(lag(v) OVER (PARTITION BY CAST(floor(id / 20.0) AS BIGINT) ORDER BY id), 0) AS v FROM q WHERE z = 0 UNION ALL SELECT id, z, v FROM q WHERE z > 0 AND v <> 0),
r AS (SELECT *, z - lag(z) OVER w - 1 AS run, lead(z) OVER w IS NULL AS last FROM d WINDOW w AS (PARTITION BY id ORDER BY z)),
s AS (SELECT id, CASE WHEN z = 0 THEN 'dc' ELSE 'ac' END AS kind, length(ltrim(bin(abs(v)), '0')) AS size, run, z FROM r),
sy AS (SELECT kind, CASE WHEN kind = 'dc' THEN size ELSE run % 16 * 16 + size END AS symbol, size FROM s
  UNION ALL SELECT 'ac', 240, 0 FROM s, range(1, 4) t(i) WHERE kind = 'ac' AND i <= run // 16
  UNION ALL SELECT 'ac', 0, 0 FROM r WHERE last AND z < 63)
SELECT kind, CAST(symbol AS BIGINT) AS symbol, count(*) AS n, CAST(sum(size) AS BIGINT) AS bits FROM sy GROUP BY kind, symbol""")
def block_symbols(spark, sf_dir):
    """The symbols that are packed, and the plain bits after them."""
    s = bitpack.block_symbols(coded_blocks(spark, sf_dir), 20)
    return s.groupBy("kind", "symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bits"))


@query()
def restart_segments(spark, sf_dir):
    """Coded bytes of every header file, cut at restart markers."""
    files = derived.file_headers(spark, sf_dir)
    at = F.expr("locate('ÿÚ', decode(content, 'ISO-8859-1'))")
    start = F.when(at > 0, at + 13).otherwise(F.length("content"))  # behind the scan's 14 bytes
    cut = bitpack.restart_segments(files.withColumn("start", start.cast("int")))
    return cut.select("id", "segment", "marker", F.hex("bytes").alias("bytes"))


# Progressive scans

_FINE = "q AS (SELECT id, z, CAST(CASE WHEN v < 0 THEN -floor((-v + floor(q / 8.0)) / floor(q / 4.0)) ELSE floor((v + floor(q / 8.0)) / floor(q / 4.0)) END AS BIGINT) AS v FROM coef JOIN quant USING (k) JOIN zig ON zig.k = coef.k)"


def fine_blocks(spark, sf_dir):
    """Blocks quantized finely enough that bits remain for later scans."""
    v = quantize(F.col("v"), F.floor(B.lookup(fixed.LUMA, F.col("k")) / 4))
    return derived.blocks(spark, sf_dir).select("id", B.to_zigzag(F.col("k")).alias("z"), v.alias("v"))


def _scans(spark, first):
    """The default script's AC scans of one component."""
    return scan_symbols.scan_table(spark).filter("ss > 0 AND ah = 0" if first else "ss > 0 AND ah > 0")


_SCRIPT = [(n, ss, se, ah, al) for n, (_, ss, se, ah, al) in enumerate(entropy.progressive_script(1)) if ss]
_FIRST = "sc AS (SELECT * FROM (VALUES " + ", ".join(f"({n}, {ss}, {se}, {al})" for n, ss, se, ah, al in _SCRIPT if not ah) + ") t(scan, ss, se, al))"
_LATER = "sc AS (SELECT * FROM (VALUES " + ", ".join(f"({n}, {ss}, {se}, {al})" for n, ss, se, ah, al in _SCRIPT if ah) + ") t(scan, ss, se, al))"
#: Every coefficient of a band, zeros too.
_BAND = "b AS (SELECT scan, id, z, ss, se, abs(v) >> al AS t FROM q JOIN sc ON z BETWEEN ss AND se)"


@query(f"""WITH {COEF}, {QUANT}, {ZIG}, {_FINE}, {_FIRST}, {_BAND},
n AS (SELECT scan, id, z, t, z - coalesce(lag(z) OVER (PARTITION BY scan, id ORDER BY z), ss - 1) - 1 AS run FROM b WHERE t > 0),
l AS (SELECT scan, id, max(se) AS se, max(CASE WHEN t > 0 THEN z END) AS z FROM b GROUP BY scan, id),
sy AS (SELECT scan, run % 16 * 16 + length(ltrim(bin(t), '0')) AS symbol FROM n
  UNION ALL SELECT scan, 240 FROM n, range(1, 4) r(i) WHERE i <= run // 16
  UNION ALL SELECT scan, 0 FROM l WHERE z IS NULL OR z < se)
SELECT CAST(scan AS BIGINT) AS scan, CAST(symbol AS BIGINT) AS symbol, count(*) AS n FROM sy GROUP BY scan, symbol""")
def progressive_first_freq(spark, sf_dir):
    """Symbols of the default script's first AC scans."""
    return scan_symbols.first_frequencies(fine_blocks(spark, sf_dir), _scans(spark, True))


_REFINED = f"""{_BAND}, n AS (SELECT *, count(CASE WHEN t = 0 THEN 1 END) OVER (PARTITION BY scan, id ORDER BY z) AS zeros FROM b),
f AS (SELECT scan, id, z, zeros - coalesce(lag(zeros) OVER (PARTITION BY scan, id ORDER BY z), 0) AS run FROM n WHERE t = 1),
l AS (SELECT scan, id, max(zeros) - coalesce(max(CASE WHEN t = 1 THEN zeros END), 0) AS rest FROM n GROUP BY scan, id)"""


@query(f"""WITH {COEF}, {QUANT}, {ZIG}, {_FINE}, {_LATER}, {_REFINED},
sy AS (SELECT scan, run % 16 * 16 + 1 AS symbol FROM f UNION ALL SELECT scan, 240 FROM f, range(1, 4) r(i) WHERE i <= run // 16 UNION ALL SELECT scan, 0 FROM l WHERE rest > 0)
SELECT CAST(scan AS BIGINT) AS scan, CAST(symbol AS BIGINT) AS symbol, count(*) AS n FROM sy GROUP BY scan, symbol""")
def progressive_refine_freq(spark, sf_dir):
    """Symbols of the default script's refinement scans."""
    return scan_symbols.refine_frequencies(fine_blocks(spark, sf_dir), _scans(spark, False))


@query(f"WITH {COEF}, {QUANT}, {ZIG}, {_FINE}, {_LATER}, {_BAND} SELECT CAST(scan AS BIGINT) AS scan, count(CASE WHEN t > 1 THEN 1 END) AS n FROM b GROUP BY scan")
def correction_bits(spark, sf_dir):
    return scan_symbols.correction_bits(fine_blocks(spark, sf_dir), _scans(spark, False))


@query(f"""WITH {COEF}, {QUANT}, {ZIG}, {_FINE}, {_FIRST}, {_BAND},
l AS (SELECT scan, id, max(se) AS se, max(CASE WHEN t > 0 THEN z END) AS z FROM b GROUP BY scan, id),
r AS (SELECT *, count(z) OVER (PARTITION BY scan ORDER BY id) AS run FROM l),
g AS (SELECT scan, min(id) AS start, count(*) AS n FROM r WHERE z IS NULL OR z < se GROUP BY scan, run),
p AS (SELECT scan, start, i AS part, least(n - i * 32767, 32767) AS blocks FROM g, range(1000) t(i) WHERE i * 32767 < n),
ru AS (SELECT *, length(ltrim(bin(blocks), '0')) - 1 AS size FROM p)
SELECT CAST(scan AS BIGINT) AS scan, start, part, blocks, CAST(size * 16 AS BIGINT) AS symbol, blocks - (1 << size) AS bits, CAST(size AS BIGINT) AS size FROM ru""")
def end_of_band_runs(spark, sf_dir):
    """Ends of band joined over blocks, for the default script's first AC scans."""
    return scan_symbols.end_runs(fine_blocks(spark, sf_dir), _scans(spark, True))


@query()
def progressive_tables(spark, sf_dir):
    """The best table for every AC scan of the default script."""
    blocks = fine_blocks(spark, sf_dir)
    first, later = scan_symbols.first_frequencies(blocks, _scans(spark, True)), scan_symbols.refine_frequencies(blocks, _scans(spark, False))
    return entropy.optimal_tables(first.unionByName(later), ("scan",))


# Transforms, rows and damage

@query()
def transform_images(spark, sf_dir):
    """Images of 20 x 5 blocks, each with a transform, a crop and an MCU of its own."""
    blocks = derived.blocks(spark, sf_dir).withColumns({"image": F.floor(F.col("gy") / 5), "gy": F.col("gy") % 5})
    i, ops = F.col("image"), F.array(*map(F.lit, B.OPS))
    asked = blocks.select("image").distinct().select(
        "image", F.lit(157).alias("width"), F.lit(37).alias("height"), F.element_at(ops, (i % 8 + 1).cast("int")).alias("op"), F.lit(False).alias("perfect"), (i % 2 == 1).alias("trim"), F.lit(False).alias("grayscale"),
        F.when(i % 3 == 0, 16).otherwise(8).alias("mcu_w"), F.when(i % 5 == 0, 16).otherwise(8).alias("mcu_h"),
        F.when(i % 4 == 1, F.struct((i % 7).cast("int").alias("x"), F.lit(9).alias("y"), F.lit(21).alias("width"), F.lit(13).alias("height"))).alias("crop"),
    )
    return transform.transform_images(blocks, asked)[0].select("image", "id", "gx", "gy", "k", "v")


_ROWS = (37, 122)


@query(f"""WITH {_samples(64)}, {_matrix('m2', dct.INVERSE[8][0].tolist())}, y0 AS (SELECT id, r, c, v * 16 AS v FROM x), {_inverse_sql(11, 18, 128, 'y0')},
plane AS (SELECT CAST(floor(id / 20.0) AS BIGINT) * 8 + r AS y, id % 20 * 8 + c AS x, v FROM z),
n AS (SELECT *, coalesce(lag(v) OVER w, v) AS a, coalesce(lead(v) OVER w, v) AS b FROM plane WINDOW w AS (PARTITION BY x ORDER BY y)),
u AS (SELECT y * 2 AS y, x, (3*v + a + 1) >> 2 AS v FROM n UNION ALL SELECT y * 2 + 1, x, (3*v + b + 2) >> 2 FROM n)
SELECT y - {_ROWS[0]} AS y, x, v FROM u WHERE y BETWEEN {_ROWS[0]} AND {_ROWS[1]}""")
def decode_row_range(spark, sf_dir):
    """Rows of the decoded plane, twice as high: only the rows of blocks that give them are read."""
    low, high = planes.row_range(*_ROWS, factor=2)
    stored = derived.table(spark, sf_dir, "embeddings").filter(F.col("vec_id").between(low * 20, high * 20 + 19))  # reaches the scan
    blocks = stored.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda e: F.floor(e.cast("double") * 64)).alias("block"))
    out = dct.inverse(blocks, quant=[16] * 64).select("id", F.posexplode("block").alias("k", "v"))
    plane = out.select((F.floor(F.col("id") / 20) * 8 + F.floor(F.col("k") / 8)).alias("y"), (F.col("id") % 20 * 8 + F.col("k") % 8).alias("x"), "v")
    return planes.cut_rows(planes.fancy_h1v2(plane), *_ROWS)


def _damaged(spark, sf_dir):
    """DC differences of images of 100 blocks: every 17th can't be read, every 13th is lost, some images end early."""
    dc = derived.blocks(spark, sf_dir).filter("k = 0").select(F.floor(F.col("gy") / 5).alias("image"), (F.col("gy") % 5 * 20 + F.col("gx")).alias("id"), F.col("v").alias("d"))
    ends = (F.col("image") % 3 == 2) & (F.col("id") == 60)
    error = F.when(ends, "end").when(F.col("id") % 17 == 3, "code")
    return dc.withColumn("error", error).filter("id % 13 <> 5"), dc.groupBy("image").agg(F.count(F.lit(1)).alias("total"), F.lit(7).alias("restart"))


_DAMAGE = f"""{COEF}, e0 AS (SELECT CAST(floor(gy / 5.0) AS BIGINT) AS image, gy % 5 * 20 + gx AS id, v AS d FROM coef WHERE k = 0),
g AS (SELECT *, CASE WHEN image % 3 = 2 AND id = 60 THEN 'end' WHEN id % 17 = 3 THEN 'code' WHEN id % 13 = 5 THEN 'code' END AS error, max(CASE WHEN image % 3 = 2 AND id = 60 THEN id END) OVER (PARTITION BY image) AS stop FROM e0)"""


@query(f"""WITH {_DAMAGE}, r AS (SELECT *, CAST(floor(id / 7.0) AS BIGINT) AS s, count(error) OVER (PARTITION BY image, CAST(floor(id / 7.0) AS BIGINT) ORDER BY id) AS resets FROM g)
SELECT image, id, CAST(CASE WHEN stop IS NOT NULL OR error IS NOT NULL THEN 0 ELSE sum(CASE WHEN error IS NULL THEN d ELSE 0 END) OVER (PARTITION BY image, s, resets ORDER BY id) END AS BIGINT) AS v FROM r""")
def lenient_blocks(spark, sf_dir):
    """DC values of damaged images: prediction starts anew after what can't be read."""
    return recovery.recover(*_damaged(spark, sf_dir))[0]


@query(f"WITH {_DAMAGE} SELECT image, error AS kind, id, CASE WHEN error = 'end' THEN id END AS blocks FROM g WHERE error = 'end' OR (error IS NOT NULL AND (stop IS NULL OR id < stop))")
def lenient_warnings(spark, sf_dir):
    return recovery.recover(*_damaged(spark, sf_dir))[1]


# 12 bits: images two columns wide, which 8-bit filters would copy

_TWELVE = f"""WITH {PLANE}, t AS (SELECT CAST(floor(x / 2.0) AS BIGINT) AS image, y, x % 2 AS x, v * 16 + x % 16 AS v FROM plane),
n AS (SELECT *, coalesce(lag(v) OVER d, v) AS above, coalesce(lead(v) OVER d, v) AS below, lag(v) OVER r AS a, lead(v) OVER r AS c FROM t WINDOW d AS (PARTITION BY image, x ORDER BY y), r AS (PARTITION BY image, y ORDER BY x))"""


def _twelve(spark, sf_dir):
    x = F.col("x")
    return derived.samples(spark, sf_dir).select(F.floor(x / 2).alias("image"), "y", (x % 2).alias("x"), (F.col("v") * 16 + x % 16).alias("v"))


@query(f"{_TWELVE} SELECT image, y, x * 2 AS x, coalesce((3*v + a + 1) >> 2, v) AS v FROM n UNION ALL SELECT image, y, x * 2 + 1, coalesce((3*v + c + 2) >> 2, v) FROM n")
def upsample_12_bit_h2v1(spark, sf_dir):
    return planes.fancy_12_bit(_twelve(spark, sf_dir), 2, 1, keys=("image",))


@query(f"{_TWELVE} SELECT image, y * 2 AS y, x, (3*v + above + 1) >> 2 AS v FROM n UNION ALL SELECT image, y * 2 + 1, x, (3*v + below + 2) >> 2 FROM n")
def upsample_12_bit_h1v2(spark, sf_dir):
    return planes.fancy_12_bit(_twelve(spark, sf_dir), 1, 2, keys=("image",))


@query(f"""{_TWELVE}, s AS (SELECT image, y * 2 AS y, x, 3*v + above AS s FROM n UNION ALL SELECT image, y * 2 + 1, x, 3*v + below FROM n),
m AS (SELECT *, lag(s) OVER w AS a, lead(s) OVER w AS c FROM s WINDOW w AS (PARTITION BY image, y ORDER BY x)),
o AS (SELECT image, y, x * 2 AS x, (coalesce(3*s + a, 4*s) + 8) >> 4 AS v FROM m UNION ALL SELECT image, y, x * 2 + 1, (coalesce(3*s + c, 4*s) + 7) >> 4 FROM m) SELECT * FROM o WHERE x < 3""")
def upsample_12_bit_h2v2(spark, sf_dir):
    """Cut to three columns."""
    return planes.fancy_12_bit(_twelve(spark, sf_dir), 2, 2, width=3, keys=("image",))


# Pixel files

def _pixel_rows(spark, sf_dir, order):
    """width, height and interleaved samples of every image, 25 rows of 20 pixels."""
    p = _pixel_images(spark, sf_dir)
    data = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", *order))), lambda s: F.concat(*[F.lpad(F.hex(s[c]), 2, "0") for c in order])), ""))
    return p.groupBy("image").agg(F.lit(20).alias("width"), (F.max("y") + 1).cast("int").alias("height"), data.alias("data"), F.count(F.lit(1)).alias("n")).filter("n = width * height").drop("n")


_FILES = f"""WITH {PIX}, i AS (SELECT *, CAST(floor(y / 25.0) AS BIGINT) AS image FROM pix), whole AS (SELECT image FROM i GROUP BY image HAVING count(*) = 20 * (max(y % 25) + 1))
SELECT image, y % 25 AS y, x, r, g, b FROM i JOIN whole USING (image)"""


@query(_FILES)
def bmp_round_trip(spark, sf_dir):
    """Every image written as a BMP file's bytes, told by its kind and read again."""
    files = images.bmp_bytes(_pixel_rows(spark, sf_dir, "rgb"), "rgb").select(F.col("image").alias("key"), "content")
    return _read_again(files)


@query(_FILES)
def pnm_round_trip(spark, sf_dir):
    """Every image written as a PPM file's bytes, told by its kind and read again."""
    rows = _pixel_rows(spark, sf_dir, "rgb")
    files = rows.select(F.col("image").alias("key"), images.pnm_bytes(F.col("width"), F.col("height"), F.col("data"), 3).alias("content"))
    return _read_again(files)


def _read_again(files):
    back = images.load_pixels(files, "key")
    return back.select(F.col("key").alias("image"), *[F.col(c).cast("bigint").alias(c) for c in ("y", "x", "r", "g", "b")])
