"""Segments of image files (image_id, ordinal, marker, payload) and chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def saved_markers(segments: DataFrame, mode: str = "all", codes: tuple[int, ...] = ()) -> DataFrame:
    """APPn and comment segments to keep: all, app (no comment), none, or the listed codes."""
    m = F.col("marker")
    keep = {"all": m.between(0xE0, 0xEF) | (m == 0xFE), "app": m.between(0xE0, 0xEF), "none": F.lit(False), "specific": m.isin(*codes) if codes else F.lit(False)}[mode]
    return segments.filter(keep)


def copied_markers(segments: DataFrame, mode: str = "all") -> DataFrame:
    """What a transform copies: all but APP0, APP2 only (icc), or nothing."""
    m = F.col("marker")
    return saved_markers(segments).filter({"all": m != 0xE0, "icc": m == 0xE2, "none": F.lit(False)}[mode])


def last_comment(segments: DataFrame) -> DataFrame:
    return segments.filter("marker = 254").groupBy("image_id").agg(F.max_by("payload", "ordinal").alias("comment"))


def reassemble(chunks: DataFrame) -> DataFrame:
    """image_id, profile: chunks (seq_no from 1, num, data) joined in order, or
    null if the numbers disagree, repeat, are out of range or leave a gap.

    One aggregation; an image's chunks are at most 255 by their one-byte number."""
    g = chunks.groupBy("image_id").agg(
        F.min("num").alias("lo"), F.max("num").alias("hi"), F.count(F.lit(1)).alias("n"), F.countDistinct("seq_no").alias("d"),
        F.min("seq_no").alias("first"), F.max("seq_no").alias("last"), F.sort_array(F.collect_list(F.struct("seq_no", "data"))).alias("parts"),
    )
    good = (F.col("lo") == F.col("hi")) & (F.col("n") == F.col("lo")) & (F.col("d") == F.col("n")) & (F.col("first") == 1) & (F.col("last") == F.col("n"))
    return g.select("image_id", F.when(good, F.array_join(F.col("parts.data"), "")).alias("profile"))


def reassemble_bytes(chunks: DataFrame) -> DataFrame:
    """As ``reassemble`` for binary chunks."""
    return reassemble(chunks.withColumn("data", F.hex("data"))).select("image_id", F.unhex("profile").alias("profile"))


def rest_from(content: Column, at: Column) -> Column:
    return F.substring(content, at + 1, F.octet_length(content))


def big_endian(value: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * size, "0"))


def segment(marker: int, payload: Column) -> Column:
    """A segment with its marker and length."""
    return F.concat(F.unhex(F.lit(f"FF{marker:02X}")), big_endian(F.octet_length(payload) + 2, 2), payload)


def behind_app0(content: Column) -> Column:
    """Offset behind the APP0 segment if the file begins with one, else behind the start marker."""
    first = F.hex(F.substring(content, 3, 2)) == "FFE0"
    return F.when(first, F.conv(F.hex(F.substring(content, 5, 2)), 16, 10).cast("int") + 4).otherwise(F.lit(2))


def inject(content: Column, *segments: Column) -> Column:
    """A file with whole segments put behind its APP0 segment; of two calls the later one's come first."""
    at = behind_app0(content)
    return F.concat(F.substring(content, F.lit(1), at), *segments, rest_from(content, at))


def exif_segment(tiff: Column) -> Column:
    return segment(0xE1, F.concat(F.unhex(F.lit("457869660000")), tiff))


def comment_segment(text: Column) -> Column:
    return segment(0xFE, F.encode(text, "UTF-8"))


def adobe_segment(transform: Column) -> Column:
    return segment(0xEE, F.concat(F.unhex(F.lit("41646F626500640000" + "0000")), big_endian(transform, 1)))


def icc_segments(profile: Column, size: int = 65519) -> Column:
    """The profile as numbered chunks of at most ``size`` bytes, joined."""
    n = F.ceil(F.octet_length(profile) / size).cast("int")
    chunk = lambda i: segment(0xE2, F.concat(F.unhex(F.lit("4943435F50524F46494C4500")), big_endian(i, 1), big_endian(n, 1), F.substring(profile, (i - 1) * size + 1, F.lit(size))))
    parts = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.hex(chunk(i)))
    return F.when(n > 0, F.unhex(F.array_join(parts, ""))).otherwise(F.unhex(F.lit("")))


def patch_version(content: Column, major: int, minor: int) -> Column:
    """The JFIF version of a file that begins with a JFIF segment; other files stay."""
    jfif = (F.hex(F.substring(content, 3, 2)) == "FFE0") & (F.hex(F.substring(content, 7, 5)) == "4A46494600") & (F.octet_length(content) > 12)
    patched = F.concat(F.substring(content, 1, 11), F.unhex(F.lit(f"{major:02X}{minor:02X}")), rest_from(content, F.lit(13)))
    return F.when(jfif, patched).otherwise(content)


def strip_segments(segments: DataFrame, images: DataFrame, which: Column, key: str = "path", content: str = "content") -> DataFrame:
    """``images`` without their first segment that satisfies ``which`` (of marker and payload)."""
    hit = segments.filter(which).groupBy("key").agg(F.min(F.struct("ordinal", "offset", F.octet_length("payload").alias("n"))).alias("s"))
    hit = hit.select(F.col("key").alias(key), F.col("s.offset").alias("_at"), F.col("s.n").alias("_n"))
    cut = F.concat(F.substring(content, F.lit(1), (F.col("_at") - 4).cast("int")), rest_from(F.col(content), (F.col("_at") + F.col("_n")).cast("int")))
    return images.join(hit, key, "left").withColumn(content, F.when(F.col("_at").isNotNull(), cut).otherwise(F.col(content))).drop("_at", "_n")


def stop_on_warning(error: Column, warnings: Column, stop: bool = True) -> Column:
    """The error of a decoded file: its own, or its first warning where warnings stop the decode."""
    first = F.when(F.size(warnings) > 0, F.get(warnings, F.lit(0)))
    return F.coalesce(error, first) if stop else error


def within_limits(width: Column, height: Column, bytes_per_pixel: Column, components: Column, max_pixels: int | None = None, max_memory: int | None = None) -> Column:
    """The check made on header columns before any pixel is decoded."""
    ok = F.lit(True)
    if max_pixels is not None:
        ok = ok & (width * height <= max_pixels)
    if max_memory is not None:
        ok = ok & (width * height * bytes_per_pixel + width * height * components <= max_memory)
    return ok
