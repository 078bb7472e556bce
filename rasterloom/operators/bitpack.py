"""Entropy coding of blocks as joins and prefix sums: no loop over bits.

``block_symbols`` turns coefficients into symbols with the bits that follow
them, ``code_words`` looks their codes up, ``pack`` places the words:

* the bit offset of a word is a running sum of lengths, in two levels: inside
  ranges of ``RANGE`` blocks, plus the sums of earlier ranges, so that no task
  holds a whole file;
* a word covers up to five bytes; the parts that meet in a byte are added;
* the last byte of a segment is filled with ones, and a zero byte follows every
  0xFF: places move by the number of 0xFF before them, a second running sum in
  two levels.

A segment is what lies between restart markers (a whole scan without them).
Segments are independent, so one large file spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quality import category, magnitude_bits
from .entropy import RANGE, dc_differences

#: Bytes of a segment summed in one window, and bytes of a row of the result.
BYTES, CHUNK = 1 << 14, 1 << 12


def block_symbols(coeffs: DataFrame, restart: int = 0, keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """keys, segment, id, z, part, kind (dc or ac), symbol, bits, size: in order of
    (id, z, part) the symbols of ``coeffs`` (keys, id: block order, z: zigzag
    position, v), each with ``size`` plain bits after it.

    Zeros needn't be there. Every 16 zeros inside a block are a symbol 240, an end
    before position 63 is 0. DC values are differences, anew in every segment of
    ``restart`` blocks (0: one segment)."""
    long = coeffs.select(*keys, F.col("id").cast("bigint").alias("id"), F.col("z").cast("bigint").alias("z"), F.col("v").cast("bigint").alias("v"))
    blocks = long.groupBy(*keys, "id").agg(F.max(F.when(F.col("z") == 0, F.col("v"))).alias("v"))
    dc = dc_differences(blocks.withColumn("v", F.coalesce("v", F.lit(0).cast("bigint"))), restart, keys).select(*keys, "id", F.lit(0).cast("bigint").alias("z"), F.col("d").alias("v"))
    rows = dc.unionByName(long.filter("z > 0 AND v <> 0"))
    w = Window.partitionBy(*keys, "id").orderBy("z")
    seen = rows.withColumns({"run": F.col("z") - F.lag("z").over(w) - 1, "last": F.lead("z").over(w).isNull()})
    size = category(F.col("v"))
    one = lambda part, kind, symbol, bits, size: F.struct(part.cast("int").alias("part"), F.lit(kind).alias("kind"), symbol.cast("bigint").alias("symbol"), bits.cast("bigint").alias("bits"), size.cast("bigint").alias("size"))
    none = F.lit(0)
    end = F.when(F.col("last") & (F.col("z") < 63), F.array(one(F.lit(9), "ac", none, none, none))).otherwise(F.array())
    start = F.array(one(none, "dc", size, magnitude_bits(F.col("v")), size))
    zeros = F.when(F.col("run") >= 16, F.transform(F.sequence(F.lit(1), F.greatest(F.floor(F.col("run") / 16), F.lit(1)).cast("int")), lambda i: one(i, "ac", F.lit(240), none, none))).otherwise(F.array())
    value = F.array(one(F.lit(8), "ac", F.pmod("run", F.lit(16)) * 16 + size, magnitude_bits(F.col("v")), size))
    symbols = F.when(F.col("z") == 0, F.concat(start, end)).otherwise(F.concat(zeros, value, end))
    segment = F.floor(F.col("id") / restart) if restart else F.lit(0).cast("bigint")
    return seen.select(*keys, segment.alias("segment"), "id", "z", F.explode(symbols).alias("s")).select(*keys, "segment", "id", "z", "s.*")


def code_words(symbols: DataFrame, tables: DataFrame) -> DataFrame:
    """``symbols`` as (keys, segment, id, z, part, value, length); ``tables`` has kind,
    symbol, code and length, at most 512 rows. A symbol without a code is an error."""
    found = symbols.join(F.broadcast(tables.select("kind", "symbol", "code", F.col("length").alias("_length"))), ["kind", "symbol"], "left")
    code = F.when(F.col("_length").isNull(), F.raise_error(F.concat(F.lit("no code for symbol "), F.col("symbol").cast("string")))).otherwise(F.col("code"))
    value = code * F.pow(F.lit(2.0), "size").cast("bigint") + F.col("bits")
    rest = [c for c in symbols.columns if c not in ("kind", "symbol", "bits", "size")]
    return found.select(*rest, value.cast("bigint").alias("value"), (F.col("_length") + F.col("size")).cast("bigint").alias("length"))


def running(rows: DataFrame, amount: Column, by: list[str], place: Column, order: list[str], name: str) -> DataFrame:
    """``rows`` with the sum of ``amount`` over earlier rows of the same ``by``, in two
    levels: ``place`` numbers the ranges, which ascend with ``order``."""
    at = rows.withColumns({"_range": place, "_amount": amount})
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    sums = at.groupBy(*by, "_range").agg(F.sum("_amount").alias("_sum"))
    sums = sums.select(*by, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = at.withColumn("_run", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    return run.join(sums, [*by, "_range"]).withColumn(name, F.col("_run") + F.col("_before")).drop("_range", "_amount", "_run", "_before")


def packed_bytes(words: DataFrame, keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """keys, segment, at, byte: the stuffed bytes of every segment of ``words``."""
    by = [*keys, "segment"]
    placed = running(words, F.col("length"), by, F.floor(F.col("id") / RANGE), ["id", "z", "part"], "bit")
    total = words.groupBy(*by).agg(F.sum("length").alias("bit"))
    fill = F.pmod(-F.col("bit"), F.lit(8))
    ones = total.select(*by, (F.pow(F.lit(2.0), fill) - 1).cast("bigint").alias("value"), fill.alias("length"), "bit").filter("length > 0")
    every = placed.select(*by, "value", "length", "bit").filter("length > 0").unionByName(ones)
    first, last = F.floor(F.col("bit") / 8), F.floor((F.col("bit") + F.col("length") - 1) / 8)
    # the part of the word in byte b: moved so that its end lies at the byte's end, then cut to eight bits
    move = lambda b: (b + 1) * 8 - F.col("bit") - F.col("length")
    part = lambda b: F.struct(b.alias("at"), F.when(move(b) >= 0, F.col("value") * F.pow(F.lit(2.0), F.greatest(move(b), F.lit(0))).cast("bigint")).otherwise(F.floor(F.col("value") / F.pow(F.lit(2.0), F.greatest(-move(b), F.lit(0))).cast("bigint"))).bitwiseAND(F.lit(255)).alias("byte"))
    parts = every.select(*by, F.explode(F.transform(F.sequence(first, last), part)).alias("p"))
    whole = parts.groupBy(*by, "p.at").agg(F.sum("p.byte").alias("byte"))
    moved = running(whole, F.when(F.col("byte") == 255, 1).otherwise(0), by, F.floor(F.col("at") / BYTES), ["at"], "_stuffed").withColumn("at", F.col("at") + F.col("_stuffed"))
    zero = F.when(F.col("byte") == 255, F.array(F.struct("at", "byte"), F.struct((F.col("at") + 1).alias("at"), F.lit(0).cast("bigint").alias("byte")))).otherwise(F.array(F.struct("at", "byte")))
    return moved.select(*by, F.explode(zero).alias("p")).select(*by, "p.at", "p.byte")


def pack(words: DataFrame, keys: tuple[str, ...] = ("image",), chunk: int = CHUNK) -> DataFrame:
    """keys, segment, chunk, content (binary): each segment's bytes, ``chunk`` to a row."""
    bytes_ = packed_bytes(words, keys)
    rows = bytes_.groupBy(*keys, "segment", F.floor(F.col("at") / chunk).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("at", "byte"))).alias("b"))
    text = F.array_join(F.transform("b", lambda x: F.lpad(F.hex(x["byte"]), 2, "0")), "")
    return rows.select(*keys, "segment", "chunk", F.unhex(text).alias("content"))


def with_markers(chunks: DataFrame, keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """``chunks`` of segments with the restart marker before the first chunk of every
    segment but a scan's first; in order of (segment, chunk) they are the scan's bytes."""
    marker = F.unhex(F.concat(F.lit("FFD"), F.pmod(F.col("segment") - 1, F.lit(8)).cast("string")))
    first = (F.col("segment") > 0) & (F.col("chunk") == 0)
    return chunks.withColumn("content", F.when(first, F.concat(marker, F.col("content"))).otherwise(F.col("content")))


def restart_segments(files: DataFrame, key: str = "id", content: str = "content", start: str = "start") -> DataFrame:
    """key, segment, marker, bytes: the entropy-coded bytes of each row from ``start`` (0-based),
    cut at restart markers, byte stuffing undone.

    Ends before any other marker or with the data; ``marker`` is the restart
    number that opened the segment (-1: the first). A lone 0xFF at the end is
    dropped. A start beyond the data gives one empty segment, null data none."""
    # one character a byte, so that patterns can find markers
    data = F.expr(f"substring(decode(`{content}`, 'ISO-8859-1'), `{start}` + 1)")
    scan = F.regexp_replace(data, "(?s)ÿ+(?![\u0000Ð-×ÿ]).*$", "")
    rows = files.filter(F.col(content).isNotNull()).select(key, F.posexplode(F.split(scan, "ÿ+(?=[Ð-×])")).alias("segment", "part"))
    later = F.col("segment") > 0
    body = F.when(later, F.substring("part", 2, 2**31 - 1)).otherwise(F.col("part"))
    number = F.when(later, F.ascii(F.substring("part", 1, 1)) - 0xD0).otherwise(-1)
    plain = F.regexp_replace(body, "ÿ+\u0000", "ÿ")
    return rows.select(key, F.col("segment").cast("bigint").alias("segment"), number.cast("int").alias("marker"), F.encode(plain, "ISO-8859-1").alias("bytes"))
