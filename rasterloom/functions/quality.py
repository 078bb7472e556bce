"""Quality settings and quantization tables as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaling(q: Column) -> Column:
    """Percent by which the standard tables are scaled at a quality of 0..100."""
    return F.when(q <= 0, 5000).when(q < 50, F.floor(F.lit(5000) / q)).otherwise(200 - 2 * q).cast("bigint")


def scaled_entry(entry: Column, scale: Column, baseline: bool = True) -> Column:
    top = 255 if baseline else 32767
    return F.least(F.lit(top).cast("bigint"), F.greatest(F.lit(1).cast("bigint"), F.floor((entry.cast("bigint") * scale + 50) / 100)))


def linear_quality(scale: Column) -> Column:
    """The quality that a linear scale factor stands for, 1..100."""
    q = F.when(scale >= 100, F.floor(F.lit(5000) / F.greatest(scale, F.lit(1)))).otherwise(F.floor((200 - scale) / 2))
    return F.least(F.lit(100).cast("bigint"), F.greatest(F.lit(1).cast("bigint"), q))


def entry_12_bit(entry: Column) -> Column:
    return F.least(entry.cast("bigint") * 16, F.lit(65535).cast("bigint"))


def quantize(v: Column, divisor: Column) -> Column:
    """Round half away from zero."""
    v, half = v.cast("bigint"), F.floor(divisor / 2)
    return F.when(v < 0, -F.floor((-v + half) / divisor)).otherwise(F.floor((v + half) / divisor))


def category(v: Column) -> Column:
    """Bit length of the magnitude."""
    a = F.abs(v.cast("bigint"))
    return sum((F.when(a >= 1 << i, 1).otherwise(0) for i in range(17)), F.lit(0)).cast("bigint")


def magnitude_bits(v: Column) -> Column:
    """The bits sent after the category: the value, or for negatives its one's complement in category bits."""
    v = v.cast("bigint")
    return F.when(v >= 0, v).otherwise(v + F.pow(F.lit(2.0), category(v)).cast("bigint") - 1)


def extend(bits: Column, size: Column) -> Column:
    """Sign extension: what magnitude bits of a category stand for."""
    bits, full = bits.cast("bigint"), F.pow(F.lit(2.0), size).cast("bigint")
    return F.when(size == 0, 0).when(bits < F.floor(full / 2), bits - full + 1).otherwise(bits).cast("bigint")


def table_entry(table: Column, luma: Column, chroma: Column, qualities: Column, custom: Column, baseline: bool = False) -> Column:
    """Entry of table 0 to 3: the custom one (cut at 255 for baseline), else the
    standard luminance (table 0) or chrominance entry at the table's own quality."""
    scale = scaling(F.element_at(qualities, (table + 1).cast("int")))
    own = F.when(F.lit(baseline) & (custom > 255), 255).otherwise(custom).cast("bigint")
    return F.coalesce(own, scaled_entry(F.when(table == 0, luma).otherwise(chroma), scale, baseline))


def transform_divisor(entry: Column) -> Column:
    """What coefficients of the forward transform, which are scaled by 8, are divided by."""
    return entry.cast("bigint") * 8
