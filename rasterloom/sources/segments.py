"""Files to tables of their segments, and header fields as columns of payloads.

``scan_files`` reads the headers of each file once, in an Arrow pass, to a row
per file with the array of its segments; ``scan`` has a row per segment (key,
ordinal, marker, offset, payload). What is asked of files takes either. Rows per
file pass without a shuffle or a sort, so a task holds a batch of files; rows
per segment are gathered by key first. Tables with many entries (quantization,
Huffman) are long tables, where the last definition of a file counts.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..workers import ready

FRAMES = (0xC0, 0xC1, 0xC2, 0xC3, 0xC9, 0xCA, 0xCB)
#: The next marker after entropy-coded data: neither a stuffed zero nor a restart.
NEXT = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.DOTALL)


def file_segments(content: bytes):
    """(marker, offset of the payload, payload, error) of a file, in order.

    Reading ends at the end marker and at the first scan of an interleaved
    sequential file. What is missing or cut off gives a last row with an error."""
    if content[:2] != b"\xff\xd8":
        yield None, 0, None, "no start marker"
        return
    at, size, parts, progressive, scans = 2, len(content), 0, False, 0
    while True:
        while at < size and content[at] == 0xFF:
            at += 1
        if at >= size:
            yield None, at, None, "unexpected end"
            return
        marker, at = content[at], at + 1
        if marker == 0xD9:
            break
        if marker == 0:
            yield None, at, None, "invalid marker"
            return
        length = int.from_bytes(content[at : at + 2], "big")
        if at + 2 > size or length < 2 or at + length > size:
            yield marker, at + 2, None, "segment cut off"
            return
        payload = content[at + 2 : at + length]
        yield marker, at + 2, payload, None
        at += length
        if marker in FRAMES:
            progressive, parts = marker in (0xC2, 0xCA), payload[5] if len(payload) > 5 else 0
        if marker == 0xDA:
            scans += 1
            if not progressive and payload[:1] >= bytes([parts]):
                break
            found = NEXT.search(content, at)
            at = found.start() if found else size
    if not parts:
        yield None, at, None, "missing frame header"
    elif not scans:
        yield None, at, None, "missing scan"


SEGMENTS = "array<struct<ordinal:int,marker:int,offset:bigint,payload:binary,error:string>>"
_ITEM = pa.struct([("ordinal", pa.int32()), ("marker", pa.int32()), ("offset", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])


def scan_files(images: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, segments: the segments of every file in order, the last one (marker
    null) says what the file lacks. A null file has no row."""
    ready(images.sparkSession)
    kind = images.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            at, ends, items, size = [], [0], [], 0

            def gathered():
                fields = [pa.array(c, f.type) for c, f in zip(zip(*items, strict=True), _ITEM, strict=True)]  # noqa: B023
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_ITEM)))  # noqa: B023
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), lists], names=["key", "segments"])  # noqa: B023

            for i in range(b.num_rows):
                data = b.column(1)[i].as_py()
                if data is not None:
                    items += [(n, *s) for n, s in enumerate(file_segments(data))]
                    at.append(i)
                    ends.append(len(items))
                    size += len(data)
                    if size > 4 << 20:  # small files share a batch
                        yield gathered()
                        at, ends, items, size = [], [0], [], 0
            if at:
                yield gathered()

    narrow = images.select(F.col(key).alias("key"), F.col(content).alias("content"))
    return narrow.mapInArrow(run, f"key {kind}, segments {SEGMENTS}")


def scan(images: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, ordinal, marker, offset, payload, error: a row per segment of every
    file, and a last one (marker null) for what the file lacks. A null file has
    no row."""
    return scan_files(images, key, content).select("key", F.inline("segments"))


def per_file(segments: DataFrame) -> DataFrame:
    """Rows of ``scan_files`` as they are, those of ``scan`` gathered by key."""
    if "segments" in segments.columns:
        return segments
    one = F.struct("ordinal", "marker", "offset", "payload", "error")
    return segments.groupBy("key").agg(F.sort_array(F.collect_list(one)).alias("segments"))


def number(payload: Column, at, size: int = 1, little=None) -> Column:
    """The unsigned integer of ``size`` bytes at offset ``at``; null beyond the end."""
    at = at if isinstance(at, Column) else F.lit(at)
    part = F.hex(F.substring(payload, at + 1, F.lit(size)))
    if little is not None:
        swapped = F.concat(*[F.substring(part, 2 * i + 1, 2) for i in reversed(range(size))])
        part = F.when(little, swapped).otherwise(part)
    return F.when(F.octet_length(payload) >= at + size, F.conv(part, 16, 10)).cast("int")


def starts(payload: Column, text: str) -> Column:
    """Whether the payload begins with ``text`` given in hexadecimal."""
    return F.hex(F.substring(payload, 1, len(text) // 2)) == text


def frame_header(marker: Column, payload: Column) -> Column:
    """Struct of a frame segment; null where its width is 0, it has no or over
    four components, or a sampling factor isn't 1 to 4. A height of 0 is allowed."""
    n = number(payload, 5)
    part = lambda i: F.struct(number(payload, 6 + 3 * i).alias("id"), F.shiftright(number(payload, 7 + 3 * i), 4).alias("h"), number(payload, 7 + 3 * i).bitwiseAND(15).alias("v"), number(payload, 8 + 3 * i).alias("tq"))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.least(n, F.lit(4))) - 1), part)
    good = (number(payload, 3, 2) > 0) & n.between(1, 4) & F.forall(parts, lambda c: F.coalesce(c.h.between(1, 4) & c.v.between(1, 4), F.lit(False)))
    return F.when(good, F.struct(
        number(payload, 0).alias("precision"), number(payload, 1, 2).alias("height"), number(payload, 3, 2).alias("width"), parts.alias("components"),
        marker.isin(0xC2, 0xCA).alias("progressive"), marker.isin(0xC3, 0xCB).alias("lossless"), (marker >= 0xC9).alias("arithmetic")))


def scan_header(payload: Column) -> Column:
    """Struct of a scan segment: its components with their tables, the band and the bits; null without 1 to 4 components."""
    n = number(payload, 0)
    part = lambda i: F.struct(number(payload, 1 + 2 * i).alias("id"), F.shiftright(number(payload, 2 + 2 * i), 4).alias("dc"), number(payload, 2 + 2 * i).bitwiseAND(15).alias("ac"))
    bits = number(payload, 3 + 2 * n)
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), n) - 1), part)
    return F.when(n.between(1, 4), F.struct(parts.alias("components"), number(payload, 1 + 2 * n).alias("first"), number(payload, 2 + 2 * n).alias("last"), F.shiftright(bits, 4).alias("high"), bits.bitwiseAND(15).alias("low")))


def density(payload: Column) -> Column:
    """Struct unit, x, y of an APP0 segment; null if it isn't a whole JFIF one."""
    unit = F.when(number(payload, 7) == 1, "dpi").when(number(payload, 7) == 2, "dpcm").otherwise("unknown")
    return F.when(starts(payload, "4A46494600") & (F.octet_length(payload) >= 14), F.struct(unit.alias("unit"), number(payload, 8, 2).alias("x"), number(payload, 10, 2).alias("y")))


def thumbnail(payload: Column) -> Column:
    """Struct width, height, rgb of the picture in an APP0 segment; null if there is none or it is cut off."""
    w, h = number(payload, 12), number(payload, 13)
    size = w * h * 3
    good = starts(payload, "4A46494600") & (size > 0) & (F.octet_length(payload) >= 14 + size)
    return F.when(good, F.struct(w.alias("width"), h.alias("height"), F.substring(payload, F.lit(15), size).alias("rgb")))


def adobe_transform(payload: Column) -> Column:
    return F.when(starts(payload, "41646F6265") & (F.octet_length(payload) >= 12), number(payload, 11))


def exif(payload: Column) -> Column:
    """The TIFF data of an APP1 segment, or null."""
    return F.when(starts(payload, "457869660000"), F.substring(payload, F.lit(7), F.octet_length(payload)))


def orientation(tiff: Column) -> Column:
    """Orientation 1 to 8 of TIFF data: the first entry with its tag counts; null if there is none or it is malformed."""
    little = F.when(starts(tiff, "4949"), True).when(starts(tiff, "4D4D"), False)
    start = number(tiff, 4, 4, little)
    n = number(tiff, start, 2, little)
    place = lambda i: start + 2 + 12 * i
    entry = lambda i: F.struct(number(tiff, place(i), 2, little).alias("tag"), number(tiff, place(i) + 2, 2, little).alias("kind"), number(tiff, place(i) + 8, 2, little).alias("value"), (F.octet_length(tiff) >= place(i) + 12).alias("whole"))
    entries = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), entry)
    hit = F.try_element_at(F.filter(entries, lambda e: (e.tag == 0x0112) | ~e.whole), F.lit(1))
    good = little.isNotNull() & (number(tiff, 2, 2, little) == 42) & (n > 0) & hit["whole"] & (hit["kind"] == 3) & hit["value"].between(1, 8)
    return F.when(good, hit["value"])


def icc_chunks(segments: DataFrame) -> DataFrame:
    """image_id, seq_no, num, data of the profile chunks, as ``metadata.reassemble`` takes them."""
    p = F.col("payload")
    own = segments.filter("marker = 226").filter(starts(p, "4943435F50524F46494C4500") & (F.octet_length(p) >= 14))
    return own.select(F.col("key").alias("image_id"), number(p, 12).alias("seq_no"), number(p, 13).alias("num"), F.substring(p, F.lit(15), F.octet_length(p)).alias("data"))


def headers(segments: DataFrame) -> DataFrame:
    """A row per file: key, frame, adobe, density, comment (the last), exif (the
    first), orientation, restart, scans, error. Of repeated frames, densities and
    restart intervals the last counts."""

    def pick(which, value, at: int) -> Column:
        found = F.transform(F.filter("segments", which), value)
        return F.try_element_at(F.filter(found, lambda v: v.isNotNull()), F.lit(at))

    def last(value, *markers: int) -> Column:
        return pick(lambda s: s.marker.isin(*markers), value, -1)

    rows = per_file(segments).select(
        "key", last(lambda s: frame_header(s.marker, s.payload), *FRAMES).alias("frame"), last(lambda s: adobe_transform(s.payload), 0xEE).alias("adobe"),
        last(lambda s: density(s.payload), 0xE0).alias("density"), last(lambda s: F.decode(s.payload, "UTF-8"), 0xFE).alias("comment"),
        pick(lambda s: s.marker == 0xE1, lambda s: exif(s.payload), 1).alias("exif"), last(lambda s: number(s.payload, 0, 2), 0xDD).alias("restart"),
        F.size(F.filter("segments", lambda s: s.marker == 0xDA)).cast("bigint").alias("scans"), F.array_max(F.col("segments.error")).alias("error"))
    bad = F.when(F.col("frame").isNull() & F.col("error").isNull(), "bad frame header").otherwise(F.col("error"))
    return rows.select("key", "frame", "adobe", "density", "comment", "exif", orientation(F.col("exif")).alias("orientation"), "restart", "scans", bad.alias("error"))


def _table_rows(segments: DataFrame, marker: int, parse, columns: list[str], identity: int) -> DataFrame:
    """Rows that ``parse`` finds in the segments with this marker; of a table
    (the first ``identity`` columns) defined again in a file the last stays."""
    kind = segments.schema["key"].dataType.simpleString()

    def run(batches):
        for b in batches:
            at, rows = [], []

            def gathered():
                cols = list(zip(*rows, strict=True)) or [()] * len(columns)  # noqa: B023
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, pa.int32()) for c in cols]], names=["key", *columns])  # noqa: B023

            for i in range(b.num_rows):
                newest: dict = {}
                for n, payload in enumerate(b.column(1)[i].as_py()):
                    for nth, row in parse(payload):
                        made, found = newest.get(row[:identity], (None, None))
                        if made != (n, nth):
                            found = []
                            newest[row[:identity]] = (n, nth), found
                        found.append(row)
                for _, found in newest.values():
                    at += [i] * len(found)
                    rows += found
                if len(rows) > 1 << 16:
                    yield gathered()
                    at, rows = [], []
            yield gathered()

    ready(segments.sparkSession)
    own = F.filter("segments", lambda s: (s.marker == marker) & s.payload.isNotNull())
    payloads = per_file(segments).select("key", F.transform(own, lambda s: s.payload).alias("payloads"))
    return payloads.mapInArrow(run, f"key {kind}, " + ", ".join(f"{c} int" for c in columns))


def quant_tables(segments: DataFrame) -> DataFrame:
    """key, tq, k (natural order), q. Tables with an id over 3 and cut-off ones are left out."""
    order = fixed.zigzag()

    def parse(payload: bytes):
        at = nth = 0
        while at < len(payload):
            width, tq = 1 + (payload[at] >> 4 > 0), payload[at] & 15
            body = payload[at + 1 : at + 1 + 64 * width]
            if tq > 3 or len(body) < 64 * width:
                return
            for z in range(64):
                yield nth, (tq, order[z], int.from_bytes(body[z * width : (z + 1) * width], "big"))
            at, nth = at + 1 + 64 * width, nth + 1

    return _table_rows(segments, 0xDB, parse, ["tq", "k", "q"], 1)


def huffman_tables(segments: DataFrame) -> DataFrame:
    """key, cls (0: DC), id, position, length, code, symbol. Tables with an id
    over 3 and cut-off ones are left out."""

    def parse(payload: bytes):
        at = nth = 0
        while at + 17 <= len(payload):
            bits = payload[at + 1 : at + 17]
            symbols = payload[at + 17 : at + 17 + sum(bits)]
            if payload[at] & 15 > 3 or len(symbols) < sum(bits):
                return
            code = position = 0
            for length, n in enumerate(bits, 1):
                for _ in range(n):
                    yield nth, (payload[at] >> 4, payload[at] & 15, position, length, code, symbols[position])
                    code, position = code + 1, position + 1
                code <<= 1
            at, nth = at + 17 + sum(bits), nth + 1

    return _table_rows(segments, 0xC4, parse, ["cls", "id", "position", "length", "code", "symbol"], 2)


def arithmetic_tables(segments: DataFrame) -> DataFrame:
    """key, cls, id, low, high (DC bounds) or kx (AC) as defined by the file; ids over 3 are left out."""

    def parse(payload: bytes):
        for nth, at in enumerate(range(0, len(payload) - 1, 2)):
            cls, id_, v = payload[at] >> 4, payload[at] & 15, payload[at + 1]
            if id_ < 4:
                yield nth, (cls, id_, v & 15 if cls == 0 else None, v >> 4 if cls == 0 else None, None if cls == 0 else v)

    return _table_rows(segments, 0xCC, parse, ["cls", "id", "low", "high", "kx"], 2)


def defined_huffman(payload: Column) -> Column:
    """The first bytes (class and id) of the tables with codes in a Huffman segment, as ``huffman_tables`` reads them.

    A step per table at most; the state is the next table's place, null behind the last whole one."""
    none = F.lit(None).cast("int")

    def step(state: Column, _: Column) -> Column:
        at, kind = state.at, number(payload, state.at)
        codes = F.aggregate(F.sequence(F.lit(1), F.lit(16)), F.lit(0), lambda n, i: n + number(payload, at + i))
        whole = at.isNotNull() & (F.octet_length(payload) >= at + 17 + codes) & (kind.bitwiseAND(15) < 4)
        return F.struct(F.when(whole, at + 17 + codes).otherwise(none).alias("at"), F.when(whole & (codes > 0), F.array_append(state.found, kind)).otherwise(state.found).alias("found"))

    steps = F.sequence(F.lit(0), F.floor(F.octet_length(payload) / 17).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found")), step)["found"]


def scan_plan(segments: DataFrame) -> DataFrame:
    """key, ordinal, scan, id, blocks, dc, ac, error: the components of every scan
    (numbered from 1 among those with components) with their blocks in a unit;
    error names what a scan refers to and the file lacks."""
    of = lambda marker: F.filter("segments", lambda s: s.marker == marker)
    scans = F.filter(F.transform(of(0xDA), lambda s: F.struct(s.ordinal.alias("ordinal"), scan_header(s.payload)["components"].alias("asked"))), lambda s: s.asked.isNotNull())
    frames = F.transform(F.filter("segments", lambda s: s.marker.isin(*FRAMES)), lambda s: frame_header(s.marker, s.payload)["components"])
    tables = F.flatten(F.transform(F.filter(of(0xC4), lambda s: s.payload.isNotNull()), lambda s: defined_huffman(s.payload)))
    files = per_file(segments).select("key", F.try_element_at(F.filter(frames, lambda f: f.isNotNull()), F.lit(-1)).alias("parts"), tables.alias("tables"), scans.alias("scans"))
    asked = files.select("key", "parts", "tables", F.posexplode("scans").alias("n", "s")).select("key", "parts", "tables", "n", "s.ordinal", F.explode("s.asked").alias("c"))
    # a component that the frame lists twice is planned twice
    out = asked.select("key", "tables", "n", "ordinal", "c", F.explode_outer(F.filter("parts", lambda f: f.id == F.col("c.id"))).alias("f"))
    has = lambda kind: F.coalesce(F.array_contains("tables", kind), F.lit(False))
    error = F.when(F.col("f").isNull(), "unknown component").when(~has(F.col("c.dc")), "missing DC table").when(~has(F.col("c.ac") + 16), "missing AC table")
    return out.select("key", "ordinal", (F.col("n") + 1).alias("scan"), "c.id", (F.col("f.h") * F.col("f.v")).alias("blocks"), "c.dc", "c.ac", error.alias("error"))
