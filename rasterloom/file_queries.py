"""Registered queries over file headers, transforms of blocks, pixel formats and
palettes, and the SQL that checks them; ``queries`` holds the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import color, fixed, pixels, quality
from .operators import blocks as B
from .operators import dct, entropy, metadata, palette, planes
from .queries import CLAMP, COEF, NEAR, PIX, PLANE, QUANT, UNIFORM, YCC, ZIG, query, quantized, ycc
from .sources import derived
from .sources import segments as S

# Files: headers made of the part table and parsed again

FILE = """f AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS name, CAST(p_size AS BIGINT) AS size, p_partkey % 11 <> 10 AS whole, p_partkey % 2 = 1 AS progressive FROM part)"""


def files(spark, sf_dir):
    return derived.file_headers(spark, sf_dir)


def parsed(spark, sf_dir):
    return S.scan_files(files(spark, sf_dir), "id")


@query(f"""WITH {FILE} SELECT id, CASE WHEN whole THEN size * 3 END AS width, CASE WHEN whole THEN id % 900 END AS height, CASE WHEN whole THEN progressive END AS progressive,
 CASE WHEN whole THEN 2 END AS h, CASE WHEN id % 4 = 0 AND whole THEN id % 3 END AS adobe, CASE WHEN id % 3 = 1 THEN 'dpi' WHEN id % 3 = 2 THEN 'dpcm' ELSE 'unknown' END AS unit, size + 1 AS density,
 CASE WHEN whole THEN name END AS comment, CASE WHEN id % 5 = 0 AND whole THEN id % 8 + 1 END AS orientation, CASE WHEN whole THEN id % 7 END AS restart,
 CASE WHEN NOT whole THEN 0 WHEN progressive THEN 2 ELSE 1 END AS scans, whole AS good FROM f""")
def file_headers(spark, sf_dir):
    """Frame, density, Adobe, comment, orientation, restart and scans of every file."""
    h, f = S.headers(parsed(spark, sf_dir)), F.col("frame")
    long = lambda c: c.cast("bigint")
    return h.select(
        F.col("key").alias("id"), long(f["width"]).alias("width"), long(f["height"]).alias("height"), f["progressive"].alias("progressive"), f["components"][0]["h"].alias("h"),
        long(F.col("adobe")).alias("adobe"), F.col("density.unit").alias("unit"), long(F.col("density.y")).alias("density"), "comment", long(F.col("orientation")).alias("orientation"),
        long(F.col("restart")).alias("restart"), "scans", F.col("error").isNull().alias("good"))


@query(f"WITH {FILE}, z AS (SELECT CAST(z AS BIGINT) AS z, CAST(k AS BIGINT) AS k FROM (VALUES {', '.join(f'({z}, {k})' for z, k in enumerate(fixed.zigzag()))}) t(z, k)) SELECT id, k, (id + z) % 255 + 1 AS q FROM f, z WHERE whole")
def file_quant_tables(spark, sf_dir):
    return S.quant_tables(parsed(spark, sf_dir)).select(F.col("key").alias("id"), F.col("k").cast("bigint").alias("k"), F.col("q").cast("bigint").alias("q"))


_LENGTHS = [n for n, c in enumerate(fixed.DC_LUMA_BITS, 1) for _ in range(c)]


@query(f"""WITH {FILE}, t AS (SELECT CAST(p AS BIGINT) AS position, CAST(l AS BIGINT) AS length FROM (VALUES {', '.join(f'({i}, {n})' for i, n in enumerate(_LENGTHS))}) t(p, l)),
s AS (SELECT *, coalesce(sum(pow(2, 16 - length)) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
SELECT id, position, length, CAST(before / pow(2, 16 - length) AS BIGINT) AS code FROM f, s WHERE whole""")
def file_huffman_tables(spark, sf_dir):
    t = S.huffman_tables(parsed(spark, sf_dir)).filter("cls = 0 AND symbol = position")
    return t.select(F.col("key").alias("id"), *[F.col(c).cast("bigint").alias(c) for c in ("position", "length", "code")])


@query(f"""WITH {FILE}, c AS (SELECT unnest([1, 2, 3]) AS c, unnest([4, 1, 1]) AS blocks)
SELECT id, n AS scan, c AS component, blocks, 'missing AC table' AS error FROM f, c, range(1, 3) s(n) WHERE whole AND (n = 1 OR (progressive AND c = 1)) AND NOT (n = 1 AND c > 1)
UNION ALL SELECT id, 1, c, blocks, 'missing DC table' FROM f, c WHERE whole AND c > 1""")
def scan_plan(spark, sf_dir):
    """Components of every scan with the tables they lack: the files define one DC table only."""
    return S.scan_plan(parsed(spark, sf_dir)).select(F.col("key").alias("id"), F.col("scan").cast("bigint").alias("scan"), F.col("id").alias("component"), "blocks", "error")


@query(f"WITH {FILE} SELECT id, size * 3 AS width, id % 900 AS height, 8 AS precision, 3 AS components FROM f WHERE whole")
def critical_parameters(spark, sf_dir):
    c = B.critical_parameters(S.headers(parsed(spark, sf_dir)))
    return c.select(F.col("key").alias("id"), F.col("width").cast("bigint"), F.col("height").cast("bigint"), "precision", F.size("components").alias("components"))


HEAD = "'FFD8FFE000104A4649460001{v}' || lpad(upper(to_hex(id % 3)), 2, '0') || lpad(upper(to_hex(size)), 4, '0') || lpad(upper(to_hex(size + 1)), 4, '0') || '0000'"
COMMENT = "'FFFE' || lpad(upper(to_hex(strlen(name) + 2)), 4, '0') || hex(name)"


@query(f"WITH {FILE} SELECT id, {HEAD.format(v='01')} AS head FROM f")
def patch_version(spark, sf_dir):
    return files(spark, sf_dir).select("id", F.hex(F.substring(metadata.patch_version(F.col("content"), 1, 1), 1, 20)).alias("head"))


@query(f"WITH {FILE} SELECT id, {HEAD.format(v='02')} || 'FFEE000E41646F6265006400000000' || '02' || {COMMENT} AS head FROM f")
def inject_metadata(spark, sf_dir):
    """A comment, then an Adobe segment injected behind APP0: the later one comes first."""
    named = files(spark, sf_dir).join(derived.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name"), "id")
    out = metadata.inject(metadata.inject(F.col("content"), metadata.comment_segment(F.col("p_name"))), metadata.adobe_segment(F.lit(2)))
    return named.select("id", F.hex(F.substring(out, F.lit(1), (F.octet_length(F.encode("p_name", "UTF-8")) + 40).cast("int"))).alias("head"))


@query(f"WITH {FILE} SELECT id, CASE WHEN whole AND id % 4 = 0 THEN 16 ELSE 0 END AS gone, id % 4 = 0 AND NOT whole AS left_over FROM f")
def strip_adobe(spark, sf_dir):
    """Bytes that go with the Adobe segment; files that end inside it keep what there is."""
    f = files(spark, sf_dir)
    is_adobe = (F.col("marker") == 0xEE) & S.starts(F.col("payload"), "41646F6265")
    out = metadata.strip_segments(S.scan(files(spark, sf_dir), "id"), f.withColumn("n", F.octet_length("content")), is_adobe, "id")
    return out.select("id", (F.col("n") - F.octet_length("content")).alias("gone"), F.hex("content").contains("FFEE").alias("left_over"))


@query("""WITH p AS (SELECT p_partkey AS id, repeat(p_name, 3) AS profile FROM part) SELECT id, hex(profile) AS profile FROM p""")
def icc_round_trip(spark, sf_dir):
    """A profile cut to chunks of 20 bytes, injected, parsed and joined again."""
    p = derived.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.encode(F.repeat("p_name", F.lit(3)), "UTF-8").alias("profile"))
    made = files(spark, sf_dir).join(p, "id").select("id", metadata.inject(F.col("content"), metadata.icc_segments(F.col("profile"), 20)).alias("content"))
    back = metadata.reassemble_bytes(S.icc_chunks(S.scan(made, "id")))
    return back.select(F.col("image_id").alias("id"), F.hex("profile").alias("profile"))


# Transforms

def _matrix(name, rows):
    return f"{name} AS (SELECT CAST(o AS BIGINT) AS o, CAST(f AS BIGINT) AS f, CAST(w AS BIGINT) AS w FROM (VALUES " + ", ".join(f"({o}, {f}, {w})" for o, r in enumerate(rows) for f, w in enumerate(r)) + ") t(o, f, w))"


def _samples(scale, low=None):
    v = f"CAST(floor(CAST(e AS DOUBLE) * {scale}.0) AS BIGINT)"
    v = f"least({-low - 1}, greatest({low}, {v}))" if low else v
    return f"e AS (SELECT vec_id AS id, unnest(embedding) AS e, unnest(range(64)) AS k FROM embeddings), x AS (SELECT id, CAST(floor(k / 8.0) AS BIGINT) AS r, k % 8 AS c, {v} AS v FROM e)"


def _blocks(spark, sf_dir, scale, low=None):
    v = lambda e: F.floor(e.cast("double") * scale)
    cut = (lambda e: F.least(F.lit(-low - 1).cast("bigint"), F.greatest(F.lit(low).cast("bigint"), v(e)))) if low else v
    return derived.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", cut).alias("block"))


def _forward_sql(shift1, shift2, source="x", name="y"):
    """Rows, then columns: two joins with the weights."""
    return f"""{name}1 AS (SELECT id, r, o AS c, (CAST(sum(w * v) AS BIGINT) + {1 << (shift1 - 1)}) >> {shift1} AS v FROM {source} JOIN m ON f = c GROUP BY id, r, o),
    {name} AS (SELECT id, o AS r, c, (CAST(sum(w * v) AS BIGINT) + {1 << (shift2 - 1)}) >> {shift2} AS v FROM {name}1 JOIN m ON f = r GROUP BY id, o, c)"""


def _inverse_sql(shift1, shift2, center, source="y", weights="m2", name="z"):
    return f"""{name}1 AS (SELECT id, o AS r, c, (CAST(sum(w * v) AS BIGINT) + {1 << (shift1 - 1)}) >> {shift1} AS v FROM {source} JOIN {weights} ON f = r GROUP BY id, o, c),
    {name} AS (SELECT id, r, o AS c, least({2 * center - 1}, greatest(0, ((CAST(sum(w * v) AS BIGINT) + {1 << (shift2 - 1)}) >> {shift2}) + {center})) AS v FROM {name}1 JOIN {weights} ON f = c GROUP BY id, r, o)"""


FORWARD = _matrix("m", dct.FORWARD.tolist())
K = "r * 8 + c AS k"


def _exploded(rows):
    return rows.select("id", F.posexplode("block").alias("k", "v")).withColumn("k", F.col("k").cast("bigint"))


def _named(name, sql):
    """Registers a query under its name, with SQL also where ``queries`` had it without."""
    return query(sql, name)


@_named("fdct_islow", f"WITH {_samples(128)}, {FORWARD}, {_forward_sql(11, 15)} SELECT id, {K}, v FROM y")
def _fdct_islow(spark, sf_dir):
    return _exploded(dct.forward(_blocks(spark, sf_dir, 128)))


@_named("fdct_12_bit", f"WITH {_samples(2048)}, {FORWARD}, {_forward_sql(12, 14)} SELECT id, {K}, v FROM y")
def _fdct_12(spark, sf_dir):
    return _exploded(dct.forward(_blocks(spark, sf_dir, 2048), precision=12))


@_named("fdct_divided", f"WITH {_samples(128)}, {FORWARD}, {_forward_sql(11, 15)}, {QUANT} SELECT id, k, CAST(CASE WHEN v < 0 THEN -floor((-v + q * 4) / (q * 8)) ELSE floor((v + q * 4) / (q * 8)) END AS BIGINT) AS v FROM (SELECT id, {K}, v FROM y) JOIN quant USING (k)")
def _fdct_divided(spark, sf_dir):
    """Transformed and quantized: coefficients scaled by 8 are divided by 8 times the entry."""
    rows = _fdct_islow(spark, sf_dir)
    return rows.select("id", "k", quality.quantize(F.col("v"), quality.transform_divisor(B.lookup(fixed.LUMA, F.col("k")))).alias("v"))


def _idct(name, weights, size, shift1, shift2, precision=8):
    center = 1 << (precision - 1)
    sql = f"WITH {_samples(64)}, {_matrix('m2', weights)}, y AS (SELECT id, r, c, v * 16 AS v FROM x), {_inverse_sql(shift1, shift2, center)} SELECT id, r * {size} + c AS k, v FROM z"

    @_named(name, sql)
    def run(spark, sf_dir):
        return _exploded(dct.inverse(_blocks(spark, sf_dir, 64), size=size, precision=precision, quant=[16] * 64))


_idct("idct_islow", dct.INVERSE[8][0].tolist(), 8, 11, 18)
_idct("idct_12_bit", dct.INVERSE[8][0].tolist(), 8, 12, 17, 12)
_idct("idct_4x4", dct.INVERSE[4][0].tolist(), 4, 12, 19)
_idct("idct_2x2", dct.INVERSE[2][0].tolist(), 2, 13, 20)


def _lanes(source, by, along, name="l"):
    return f"{name} AS (SELECT id, {by} AS i, list(v ORDER BY {along}) AS l FROM {source} GROUP BY id, {by})"


def _aan_forward_sql(source, name, mul):
    """One pass over lists of eight as chained projections."""
    s = f"""{name}a AS (SELECT id, i, l[1]+l[8] AS s0, l[2]+l[7] AS s1, l[3]+l[6] AS s2, l[4]+l[5] AS s3, l[1]-l[8] AS d0, l[2]-l[7] AS d1, l[3]-l[6] AS d2, l[4]-l[5] AS d3 FROM {source}),
    {name}b AS (SELECT *, s0+s3 AS p, s1+s2 AS q, s0-s3 AS r, d3+d2 AS u, d2+d1 AS m, d1+d0 AS w FROM {name}a),
    {name}c AS (SELECT *, {mul(1, '(r + s1 - s2)')} AS t, {mul(0, '(u - w)')} AS z5, {mul(1, 'm')} AS z3, {mul(2, 'u')} AS zu, {mul(3, 'w')} AS zw FROM {name}b)"""
    out = "p+q, d0+z3+zw+z5, r+t, d0-z3-zu-z5, p-q, d0-z3+zu+z5, r-t, d0+z3-zw-z5"
    return s + f", {name} AS (SELECT id, i, unnest([{out}]) AS v, unnest(range(8)) AS j FROM {name}c)"


def _fast_mul(constants):
    return lambda i, v: f"(({v} * {constants[i]}) >> 8)"


FAST = f"{_samples(128)}, {_lanes('x', 'r', 'c')}, {_aan_forward_sql('l', 'y', _fast_mul([98, 181, 139, 334]))}, {_lanes('y', 'j', 'i', 'l2')}, {_aan_forward_sql('l2', 'z', _fast_mul([98, 181, 139, 334]))}, o AS (SELECT id, j * 8 + i AS k, v FROM z)"
AAN_12 = "s AS (SELECT CAST(k AS BIGINT) AS k, CAST(s AS BIGINT) AS s FROM (VALUES " + ", ".join(f"({r * 8 + c}, {a * b})" for r, a in enumerate(dct.AAN_12) for c, b in enumerate(dct.AAN_12)) + ") t(k, s))"


@_named("fdct_ifast_raw", f"WITH {FAST} SELECT id, k, v FROM o")
def _fdct_ifast_raw(spark, sf_dir):
    return _exploded(dct.forward(_blocks(spark, sf_dir, 128), method="ifast_raw"))


@_named("fdct_ifast", f"WITH {FAST}, {AAN_12} SELECT id, k, (v * 16777216) // s AS v FROM o JOIN s USING (k) WHERE v >= 0 UNION ALL SELECT id, k, -((-v * 16777216) // s) FROM o JOIN s USING (k) WHERE v < 0")
def _fdct_ifast(spark, sf_dir):
    return _exploded(dct.forward(_blocks(spark, sf_dir, 128), method="ifast"))


AAN = "s AS (SELECT CAST(k AS BIGINT) AS k, CAST(s AS DOUBLE) AS s FROM (VALUES " + ", ".join(f"({r * 8 + c}, {a * b!r}::DOUBLE)" for r, a in enumerate(dct.AAN) for c, b in enumerate(dct.AAN)) + ") t(k, s))"
_FLOAT = [0.382683433, 0.5**0.5, 0.541196100, 1.306562965]
FLOATS = f"{_samples(128)}, xd AS (SELECT id, r, c, CAST(v AS DOUBLE) AS v FROM x), {_lanes('xd', 'r', 'c')}, {_aan_forward_sql('l', 'y', lambda i, v: f'({v} * {_FLOAT[i]!r}::DOUBLE)')}, {_lanes('y', 'j', 'i', 'l2')}, {_aan_forward_sql('l2', 'z', lambda i, v: f'({v} * {_FLOAT[i]!r}::DOUBLE)')}, o AS (SELECT id, j * 8 + i AS k, v FROM z)"


@_named("fdct_float", f"WITH {FLOATS}, {AAN} SELECT id, k, CAST(CASE WHEN v >= 0 THEN floor(v / s + 0.5) ELSE -floor(-v / s + 0.5) END AS BIGINT) AS v FROM o JOIN s USING (k)")
def _fdct_float(spark, sf_dir):
    return _exploded(dct.forward(_blocks(spark, sf_dir, 128), method="float"))


def _aan_inverse_sql(source, name, mul, one=""):
    """One pass over lists of eight; ``one`` is added to the first."""
    s = f"""{name}a AS (SELECT id, i, (l[1]{one})+l[5] AS a, (l[1]{one})-l[5] AS b, l[3]+l[7] AS c, l[3]-l[7] AS d, l[6]+l[4] AS p, l[6]-l[4] AS m, l[2]+l[8] AS o, l[2]-l[8] AS n FROM {source}),
    {name}b AS (SELECT *, {mul(1, 'd')} - c AS t, {mul(2, '(m + n)')} AS z, o + p AS o0 FROM {name}a), {name}c AS (SELECT *, {mul(3, 'm')} + z - o0 AS o1 FROM {name}b),
    {name}d AS (SELECT *, {mul(1, '(o - p)')} - o1 AS o2 FROM {name}c), {name}e AS (SELECT *, {mul(0, 'n')} - z + o2 AS o3 FROM {name}d)"""
    out = "a+c+o0, b+t+o1, b-t+o2, a-c-o3, a-c+o3, b-t-o2, b+t-o1, a+c-o0"
    return s + f", {name} AS (SELECT id, i, unnest([{out}]) AS v, unnest(range(8)) AS j FROM {name}e)"


_INVERSE_FAST = [277, 362, 473, -669]
FAST_TABLE = "s AS (SELECT CAST(k AS BIGINT) AS k, CAST(s AS BIGINT) AS s FROM (VALUES " + ", ".join(f"({r * 8 + c}, {(16 * round(16384 * a * b) + 2048) >> 12})" for r, a in enumerate(dct.AAN) for c, b in enumerate(dct.AAN)) + ") t(k, s))"


@_named("idct_ifast", f"""WITH {_samples(2)}, {FAST_TABLE}, q AS (SELECT id, r, c, v * s AS v FROM x JOIN s ON k = r * 8 + c), {_lanes('q', 'c', 'r')}, {_aan_inverse_sql('l', 'y', _fast_mul(_INVERSE_FAST))},
{_lanes('y', 'j', 'i', 'l2')}, {_aan_inverse_sql('l2', 'z', _fast_mul(_INVERSE_FAST))} SELECT id, i * 8 + j AS k, least(255, greatest(0, (v >> 5) + 128)) AS v FROM z""")
def _idct_ifast(spark, sf_dir):
    return _exploded(dct.inverse(_blocks(spark, sf_dir, 2), method="ifast", quant=[16] * 64))


@_named("idct_float", None)
def _idct_float(spark, sf_dir):
    return _exploded(dct.inverse(_blocks(spark, sf_dir, 16), method="float", quant=[16] * 64))


ROUND_TRIP = f"""{_samples(256, -128)}, {FORWARD}, {_matrix('m2', dct.INVERSE[8][0].tolist())}, {_forward_sql(11, 15)},
q AS (SELECT id, r, c, CAST(CASE WHEN v < 0 THEN -floor((-v + 4) / 8) ELSE floor((v + 4) / 8) END AS BIGINT) AS v FROM y), {_inverse_sql(11, 18, 128, 'q')}"""
_named("fdct_blocks", f"WITH {_samples(128)}, {FORWARD}, {_forward_sql(11, 15)} SELECT id, CAST({K.removesuffix(' AS k')} AS INTEGER) AS k, v FROM y")(
    lambda spark, sf_dir: dct.forward(_blocks(spark, sf_dir, 128)).select("id", F.posexplode("block").alias("k", "v"))
)


@_named("dct_round_trip", f"WITH {ROUND_TRIP} SELECT id, max(abs(z.v - 128 - x.v)) AS error FROM z JOIN x USING (id, r, c) GROUP BY id")
def _dct_round_trip(spark, sf_dir):
    """Samples, forward transform, quantization by 1, inverse transform: the largest error by block."""
    rows = _blocks(spark, sf_dir, 256, -128)
    coded = dct.forward(rows.withColumn("first", F.col("block"))).withColumn("block", F.transform("block", lambda v: quality.quantize(v, F.lit(8))))
    error = F.array_max(F.zip_with("block", "first", lambda a, b: F.abs(a - 128 - b)))
    return dct.inverse(coded).select("id", error.alias("error"))


@query(f"WITH {COEF}, {ZIG} SELECT id, k, CASE WHEN z >= 10 THEN 0 ELSE v * 2 END AS v FROM coef JOIN zig USING (k)")
def custom_filter(spark, sf_dir):
    """A caller's function on zigzag blocks: the first ten coefficients doubled, the rest removed."""

    def low_pass(x):
        out = x * 2
        out[:, 10:] = 0
        return out

    return B.filter_blocks(derived.blocks(spark, sf_dir), low_pass)


@query(f"WITH {COEF} SELECT id, gx, gy, k, v FROM coef WHERE id % 3 = 0")
def grayscale_blocks(spark, sf_dir):
    """Of blocks dealt to three components the first."""
    return B.grayscale(derived.blocks(spark, sf_dir).withColumn("component", F.col("id") % 3)).drop("component")


# Lossless restore by every predictor

def _restore(n):
    @query(f"WITH {PLANE} SELECT y, x, v FROM plane", f"lossless_restore_{n}")
    def run(spark, sf_dir):
        return planes.undo_prediction(planes.lossless_difference(derived.samples(spark, sf_dir), n), n)


for _n in range(2, 8):
    _restore(_n)


# Tables and symbols

@query()
def huff_optimal_ac(spark, sf_dir):
    """The best AC table for the quantized blocks."""
    return entropy.optimal_tables(entropy.ac_frequencies(quantized(spark, sf_dir)).withColumn("table", F.lit(0)), ("table",))


# Pixel formats

def _digits(fmt, **sql):
    out = "0"
    for c in pixels.FORMATS[fmt]:
        out = f"({out}) * 256 + {'255' if c in 'ax' else sql[c]}"
    return out


RGB_SQL = f"rgb AS (SELECT id, {CLAMP.format('yy + ((91881*(cr-128) + 32768) >> 16)')} AS r, {CLAMP.format('yy - ((22554*(cb-128) + 46802*(cr-128) + 32768) >> 16)')} AS g, {CLAMP.format('yy + ((116130*(cb-128) + 32768) >> 16)')} AS b, yy, cb, cr FROM ycc)"
COLOURS = [f for f in pixels.FORMATS if f not in ("cmyk", "gray")]


@query(f"WITH {PIX}, {YCC}, {RGB_SQL} SELECT id, " + ", ".join(f"{_digits(f, r='r', g='g', b='b')} AS {f}" for f in COLOURS) + " FROM rgb")
def output_formats(spark, sf_dir):
    return ycc(spark, sf_dir).select("id", *[pixels.output_pixel("YCbCr", f, "yy", "cb", "cr").alias(f) for f in COLOURS])


@query(f"WITH {PIX}, {YCC}, {RGB_SQL} SELECT id, " + ", ".join(f"{_digits(f, r='yy', g='yy', b='yy')} AS {f}" for f in COLOURS) + ", yy AS gray, (yy >> 3) * 2048 + (yy >> 2) * 32 + (yy >> 3) AS rgb565 FROM rgb")
def gray_expand(spark, sf_dir):
    return ycc(spark, sf_dir).select("id", *[pixels.output_pixel("Grayscale", f, "yy").alias(f) for f in [*COLOURS, "gray", "rgb565"]])


_INK = {c: f"CAST(floor(({v} * g + 127) / 255.0) AS BIGINT)" for c, v in (("r", "r"), ("g", "b"), ("b", "x*12"))}
_YINK = {c: f"CAST(floor(((255 - rgb.{c}) * pix.r + 127) / 255.0) AS BIGINT)" for c in "rgb"}


@query(f"WITH {PIX} SELECT id, " + ", ".join(f"{_digits(f, **_INK)} AS {f}" for f in COLOURS) + f", {_digits('cmyk', c='r', m='b', y='x*12', k='g')} AS cmyk FROM pix")
def cmyk_output(spark, sf_dir):
    p = derived.pixels(spark, sf_dir)
    return p.select("id", *[pixels.output_pixel("CMYK", f, "r", "b", F.col("x") * 12, "g").alias(f) for f in [*COLOURS, "cmyk"]])


@query(f"WITH {PIX}, {YCC}, {RGB_SQL} SELECT rgb.id, {_digits('rgb', **_YINK)} AS rgb, {_digits('bgra', **_YINK)} AS bgra, {_digits('cmyk', c='(255 - rgb.r)', m='(255 - rgb.g)', y='(255 - rgb.b)', k='pix.r')} AS cmyk FROM rgb JOIN pix USING (id)")
def ycck_output(spark, sf_dir):
    p = derived.pixels(spark, sf_dir)
    parts = [c.alias(n) for c, n in zip(color.rgb_to_ycbcr("r", "g", "b"), ("yy", "cb", "cr"), strict=True)]
    return p.select("id", "r", *parts).select("id", *[pixels.output_pixel("YCCK", f, "yy", "cb", "cr", "r").alias(f) for f in ("rgb", "bgra", "cmyk")])


@query(f"WITH {PIX}, {YCC} SELECT id, yy AS gray, {_digits('rgb', r='yy', g='cb', b='cr')} AS ycbcr FROM ycc")
def colorspace_override(spark, sf_dir):
    return ycc(spark, sf_dir).select("id", pixels.overridden("Grayscale", "yy").alias("gray"), pixels.overridden("YCbCr", "yy", "cb", "cr").alias("ycbcr"))


@query(f"WITH {PIX} SELECT id, (r * 4) % 256 AS gray, {_digits('rgb', r='least(255, r * 2)', g='least(255, g * 2)', b='least(255, b * 2)')} AS rgb FROM pix")
def lossless_output(spark, sf_dir):
    """Gray is scaled back by a point transform of 2 in one byte, colour of wider samples is cut at 255."""
    p = derived.pixels(spark, sf_dir)
    return p.select("id", pixels.lossless_output(2, "r").alias("gray"), pixels.lossless_output(2, F.col("r") * 2, F.col("g") * 2, F.col("b") * 2).alias("rgb"))


@query(f"WITH {PIX}, {YCC} SELECT id, f.f AS format, yy, cb, cr, yy AS luma FROM ycc, (SELECT unnest({COLOURS}) AS f) f UNION ALL SELECT id, 'gray', r, NULL, NULL, r FROM pix")
def encoder_planes(spark, sf_dir):
    """Packed pixels of every format to the encoder's planes and to luma."""
    rows = []
    for f in [*COLOURS, "gray"]:  # a struct per format, from one scan
        packed = pixels.pack(f, r="r", g="g", b="b", v="r")
        found = [*pixels.encoder_planes(f, packed), *[F.lit(None).cast("bigint")] * 2][:3]
        rows.append(F.struct(F.lit(f).alias("format"), *[c.cast("bigint").alias(n) for c, n in zip([*found, pixels.luminance(f, packed)], ("yy", "cb", "cr", "luma"), strict=True)]))
    return derived.pixels(spark, sf_dir).select("id", F.explode(F.array(*rows)).alias("p")).select("id", "p.*")


CHROMA = "c AS (SELECT CAST(floor(y / 2.0) AS BIGINT) AS cy, CAST(floor(x / 2.0) AS BIGINT) AS cx, CAST(floor((sum(cb) + floor(count(*) / 2.0)) / count(*)) AS BIGINT) AS cb, CAST(floor((sum(cr) + floor(count(*) / 2.0)) / count(*)) AS BIGINT) AS cr FROM ycc GROUP BY 1, 2)"


def _with_chroma(spark, sf_dir):
    full = ycc(spark, sf_dir)
    at = {"cy": F.floor(F.col("y") / 2), "cx": F.floor(F.col("x") / 2)}
    chroma = full.groupBy(*[c.alias(n) for n, c in at.items()]).agg(*[F.floor((F.sum(c) + F.floor(F.count(F.lit(1)) / 2)) / F.count(F.lit(1))).alias(c) for c in ("cb", "cr")])
    return full.select("id", "yy", *[c.alias(n) for n, c in at.items()]).join(chroma, ["cy", "cx"])


@query(f"""WITH {PIX}, {YCC}, {CHROMA} SELECT id, {CLAMP.format('yy + ((91881*(c.cr-128) + 32768) >> 16)')} AS r, {CLAMP.format('yy + ((-22554*(c.cb-128) - 46802*(c.cr-128) + 32768) >> 16)')} AS g,
 {CLAMP.format('yy + ((116130*(c.cb-128) + 32768) >> 16)')} AS b FROM ycc JOIN c ON cy = CAST(floor(y / 2.0) AS BIGINT) AND cx = CAST(floor(x / 2.0) AS BIGINT)""")
def merged_upsample_h2v2(spark, sf_dir):
    """4:2:0 planes to RGB, chroma shared by four pixels."""
    return _with_chroma(spark, sf_dir).select("id", *[v.alias(n) for v, n in zip(color.ycbcr_to_rgb("yy", "cb", "cr", merged=True), "rgb", strict=True)])


@query(f"""WITH {PIX}, {YCC}, {CHROMA}, rgb AS (SELECT id, {CLAMP.format('yy + ((91881*(c.cr-128) + 32768) >> 16)')} AS r, {CLAMP.format('yy - ((22554*(c.cb-128) + 46802*(c.cr-128) + 32768) >> 16)')} AS g,
 {CLAMP.format('yy + ((116130*(c.cb-128) + 32768) >> 16)')} AS b FROM ycc JOIN c ON cy = CAST(floor(y / 2.0) AS BIGINT) AND cx = CAST(floor(x / 2.0) AS BIGINT))
SELECT id, {_digits('rgb', r='r', g='g', b='b')} AS rgb, {_digits('bgra', r='r', g='g', b='b')} AS bgra FROM rgb""")
def yuv420_decode(spark, sf_dir):
    """4:2:0 planes to packed pixels, chroma repeated."""
    return _with_chroma(spark, sf_dir).select("id", *[pixels.output_pixel("YCbCr", f, "yy", "cb", "cr").alias(f) for f in ("rgb", "bgra")])


# Regions and plans


# Palettes

BAYER = "t AS (SELECT CAST(i AS BIGINT) AS i, CAST(b / 16.0 AS FLOAT) AS th FROM (VALUES " + ", ".join(f"({i}, {v})" for i, v in enumerate(fixed.BAYER)) + ") t(i, b))"
_DITHERED = "CAST(CAST({0} AS FLOAT) + th * (CAST(255 AS FLOAT) / CAST(124 AS FLOAT)) AS DOUBLE)"
_MOVED = ", ".join(f"{CLAMP.format(f'CASE WHEN {_DITHERED.format(c)} >= 0 THEN floor({_DITHERED.format(c)} + 0.5) ELSE ceil({_DITHERED.format(c)} - 0.5) END')} AS {c}" for c in "rgb")


@query(f"WITH pix0 AS ({PIX.removeprefix('pix AS (')}, {BAYER}, pix AS (SELECT id, {_MOVED} FROM pix0 JOIN t ON i = (y % 4) * 4 + x % 4), {UNIFORM}, {NEAR} SELECT id, idx FROM near")
def ordered_dither(spark, sf_dir):
    """The uniform palette of 125 entries with ordered dither."""
    return palette.quantize(derived.pixels(spark, sf_dir), 128, "uniform", "ordered")[1].select("id", "idx")


@query()
def median_cut(spark, sf_dir):
    """200 entries for each of ten images, split box by box."""
    p = derived.pixels(spark, sf_dir).withColumn("image", F.floor(F.col("y") / 100))
    return palette.median_cut(p, 200, ("image",))


@query()
def quantize_image(spark, sf_dir):
    """A whole image to 16 colours of its own, with ordered dither."""
    return palette.quantize(derived.pixels(spark, sf_dir), 16, "median_cut", "ordered")[1].select("id", "idx")
