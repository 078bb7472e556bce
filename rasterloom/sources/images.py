"""Image files as rows: the binary file source, and headers of plain raster files.

Headers are read in SQL expressions, so size filters work before pixels are
touched and the ``content`` column is pruned where it isn't used. Pixels are cut
from the content by Arrow workers, files are made and written by them.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..workers import ready

#: Pixels handed on at once.
LINES = 1 << 20


def read_images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def unsigned(content: Column, at: int, size: int, big_endian: bool = False) -> Column:
    """The unsigned integer of ``size`` bytes at offset ``at``."""
    part = F.substring(content, at + 1, size)
    digits = F.hex(part) if big_endian else F.concat(*[F.hex(F.substring(content, at + 1 + i, 1)) for i in reversed(range(size))])
    return F.conv(digits, 16, 10).cast("bigint")


def image_kind(content: Column) -> Column:
    """BMP, PNM (P5, P6), JPEG or null by the first bytes."""
    two = F.hex(F.substring(content, 1, 2))
    return F.when(two == "424D", "BMP").when(two.isin("5035", "5036"), "PNM").when(two == "FFD8", "JPEG")


def bmp_header(content: Column) -> Column:
    """Struct of a BMP's size and layout; null where the file is none that is supported."""
    width, height = unsigned(content, 18, 4), unsigned(content, 22, 4)
    signed = F.when(height >= 1 << 31, height - (1 << 32)).otherwise(height)
    bits = unsigned(content, 28, 2)
    good = (image_kind(content) == "BMP") & (unsigned(content, 14, 4) >= 40) & bits.isin(24, 32) & (unsigned(content, 30, 4) == 0)
    row = F.floor((width * bits + 31) / 32) * 4
    return F.when(good, F.struct(width.alias("width"), F.abs(signed).alias("height"), (signed < 0).alias("top_down"), bits.alias("bits"), unsigned(content, 10, 4).alias("offset"), row.alias("row_bytes")))


def _pixels(files: DataFrame, key: str, header: Column, sample) -> DataFrame:
    """Pixel rows of the files whose ``header`` isn't null: lines are cut from the
    content once, in the worker, some at a time; ``sample`` gives a line's RGB rows."""
    ready(files.sparkSession)
    rows = files.select(key, "content", header.alias("h")).filter("h IS NOT NULL AND h.width > 0 AND h.height > 0")
    kind = files.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                h, content = batch.column(2)[i].as_py(), np.frombuffer(batch.column(1)[i].as_buffer(), np.uint8)
                step = max(1, LINES // h["width"])
                for y0 in range(0, h["height"], step):
                    y = np.arange(y0, min(y0 + step, h["height"]))
                    rgb = sample(content, h, y)
                    n = len(y) * h["width"]
                    columns = [pa.array(np.tile(np.arange(h["width"]), len(y))), pa.array(np.repeat(y, h["width"])), *[pa.array(rgb[:, :, c].reshape(-1).astype(np.int64)) for c in range(3)]]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(n, i))), *columns], names=[key, "x", "y", "r", "g", "b"])

    return rows.mapInArrow(run, f"`{key}` {kind}, x long, y long, r long, g long, b long")


def bmp_pixels(images: DataFrame, key: str = "path") -> DataFrame:
    """key, x, y, r, g, b of every pixel of the BMP rows of ``images`` (key,
    content). Files that end early are left out."""

    def sample(content, h, y):
        stored = y if h["top_down"] else h["height"] - 1 - y
        step = h["bits"] // 8
        at = h["offset"] + stored[:, None] * h["row_bytes"] + np.arange(h["width"] * step)
        return content[at].reshape(len(y), h["width"], step)[:, :, 2::-1]

    h = bmp_header(F.col("content"))
    return _pixels(images, key, F.when(F.octet_length("content") >= h["offset"] + h["height"] * h["row_bytes"], h), sample)


def pnm_header(content: Column) -> Column:
    """Struct of a P5 or P6 file: channels, width, height, offset of the samples;
    null if it is another file or its largest value isn't 255. Comments from # to
    the end of a line may stand between the numbers."""
    text = F.decode(F.substring(content, 1, 65536), "ISO-8859-1")  # headers end before
    gap = r"(?:\s|#[^\n]*\n)+"
    pattern = rf"(?s)^P([56])\s{gap[:-1]}*(\d+){gap}(\d+){gap}(\d+)\s.*$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    size = F.length(F.regexp_extract(text, rf"(?s)^(P[56]\s{gap[:-1]}*\d+{gap}\d+{gap}\d+\s)", 1))
    kind = F.hex(F.substring(content, 1, 2)).isin("5035", "5036")
    return F.when(kind & text.rlike(pattern) & (part(4) == "255"), F.struct((F.when(part(1) == "6", 3).otherwise(1)).alias("channels"), part(2).cast("bigint").alias("width"), part(3).cast("bigint").alias("height"), size.alias("offset")))


def pnm_pixels(images: DataFrame, key: str = "path") -> DataFrame:
    """key, x, y, r, g, b of every pixel of the P5 (gray in all channels) and P6
    rows of ``images``. Files that end early are left out."""

    def sample(content, h, y):
        at = h["offset"] + y[:, None] * h["width"] * h["channels"] + np.arange(h["width"] * h["channels"])
        return np.broadcast_to(content[at].reshape(len(y), h["width"], h["channels"]), (len(y), h["width"], 3))

    h = pnm_header(F.col("content"))
    return _pixels(images, key, F.when(F.octet_length("content") >= h["offset"] + h["width"] * h["height"] * h["channels"], h), sample)


def load_pixels(images: DataFrame, key: str = "path") -> DataFrame:
    """Pixels of all BMP and PNM rows of ``images``; other kinds are left out."""
    kind = image_kind(F.col("content"))
    return bmp_pixels(images.filter(kind == "BMP"), key).unionByName(pnm_pixels(images.filter(kind == "PNM"), key))


def bmp_bytes(images: DataFrame, fmt: str, data: str = "data", out: str = "content") -> DataFrame:
    """``images`` (width, height, ``data``: interleaved samples in the byte order
    ``fmt``) with a BMP file as the column ``out``: 24 bits, or 32 for four
    channels. Null where ``data`` doesn't hold width x height pixels."""
    order = {"rgb": [2, 1, 0], "bgr": [0, 1, 2], "gray": [0, 0, 0], "rgba": [2, 1, 0, 3], "bgra": [0, 1, 2, 3]}
    if fmt not in order:
        raise ValueError(f"no BMP of {fmt} pixels")
    ready(images.sparkSession)
    channels = 1 if fmt == "gray" else len(fmt)
    at = [images.columns.index(c) for c in ("width", "height", data)]
    schema = StructType([*images.schema.fields, StructField(out, BinaryType())])

    def run(batches):
        for b in batches:
            files = []
            for w, h, raw in zip(*[b.column(i).to_pylist() for i in at], strict=True):
                if w is None or h is None or raw is None or min(w, h) < 1 or len(raw) != w * h * channels:
                    files.append(None)
                    continue
                dots = np.frombuffer(raw, np.uint8).reshape(h, w, channels)[::-1][:, :, order[fmt]]
                depth = dots.shape[2]
                line = -(-w * depth // 4) * 4
                body = np.zeros((h, line), np.uint8)
                body[:, : w * depth] = dots.reshape(h, -1)
                head = b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + line * h, 0, 54, 40, w, h, 1, depth * 8, 0, line * h, 2835, 2835, 0, 0)
                files.append(head + body.tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(files, pa.binary())], names=schema.names)

    return images.mapInArrow(run, schema)


def write_files(files: DataFrame, folder: str, name: str = "name", content: str = "content") -> None:
    """Each row's content as a file of a store that the executors reach; the name
    is a column. A task that runs again writes the same files."""

    def write(rows):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for r in rows:
            if r[0] is not None and r[1] is not None:
                with store.open_output_stream(f"{root}/{r[0]}") as f:
                    f.write(r[1])

    files.select(name, content).foreachPartition(write)


def pnm_bytes(width: Column, height: Column, data: Column, channels: int) -> Column:
    """A P5 or P6 file of interleaved samples."""
    head = F.concat(F.lit(f"P{6 if channels == 3 else 5}\n"), width.cast("string"), F.lit(" "), height.cast("string"), F.lit("\n255\n"))
    return F.concat(F.encode(head, "ISO-8859-1"), data)
