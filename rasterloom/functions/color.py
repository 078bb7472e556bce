"""Colour conversion as column expressions; all stay in generated JVM code.

Inputs are integer columns with samples 0..255, widened to bigint before
products. ``>> 16`` of the fixed-point forms is an arithmetic shift.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def long(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def clamp(c: Column, low: int = 0, high: int = 255) -> Column:
    return F.least(F.lit(high).cast("bigint"), F.greatest(F.lit(low).cast("bigint"), c))


def luma(r, g, b) -> Column:
    return F.shiftright(19595 * long(r) + 38470 * long(g) + 7471 * long(b) + 32768, 16)


def rgb_to_ycbcr(r, g, b) -> tuple[Column, Column, Column]:
    r, g, b = long(r), long(g), long(b)
    half = (128 << 16) + 32767
    return luma(r, g, b), F.shiftright(-11059 * r - 21709 * g + 32768 * b + half, 16), F.shiftright(32768 * r - 27439 * g - 5329 * b + half, 16)


def ycbcr_to_rgb(y, cb, cr, merged: bool = False) -> tuple[Column, Column, Column]:
    """``merged`` rounds green as the merged upsampler does: the negated sum is shifted."""
    y, cb, cr = long(y), long(cb) - 128, long(cr) - 128
    green = y + F.shiftright(-22554 * cb - 46802 * cr + 32768, 16) if merged else y - F.shiftright(22554 * cb + 46802 * cr + 32768, 16)
    return clamp(y + F.shiftright(91881 * cr + 32768, 16)), clamp(green), clamp(y + F.shiftright(116130 * cb + 32768, 16))


def rgb565(r, g, b) -> Column:
    """Packed 5-6-5, to be stored little-endian."""
    return F.shiftright(long(r), 3) * 2048 + F.shiftright(long(g), 2) * 32 + F.shiftright(long(b), 3)


def dither_at(x: Column, y: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("bigint") for v in fixed.DITHER]), (F.pmod(y, F.lit(4)) * 4 + F.pmod(x, F.lit(4)) + 1).cast("int"))


def rgb565_dithered(r, g, b, x: Column, y: Column) -> Column:
    d = dither_at(x, y)
    return rgb565(clamp(long(r) + d), clamp(long(g) + F.shiftright(d, 1)), clamp(long(b) + d))


def cmyk_to_rgb(c, m, y, k) -> tuple[Column, ...]:
    """Inverted ink samples, as such files store them."""
    return tuple(F.floor((long(s) * long(k) + 127) / 255) for s in (c, m, y))


def ycck_to_cmyk(y, cb, cr, k) -> tuple[Column, ...]:
    return (*(255 - s for s in ycbcr_to_rgb(y, cb, cr)), long(k))


def from_12_bit(v) -> Column:
    return F.floor(long(v) * 255 / 4095)


def gray_of_rgb8(r, g, b) -> Column:
    """The short form used for 12-bit colour shown as 8-bit gray."""
    return F.shiftright(77 * long(r) + 150 * long(g) + 29 * long(b), 8)


def color_space(components: Column, adobe: Column) -> Column:
    """Colour space of a file by number of components and Adobe transform (null: no such marker)."""
    four = F.when(adobe.isNull() | (adobe == 0), "CMYK").otherwise("YCCK")
    return F.when(components == 1, "Grayscale").when(components == 3, F.when(adobe == 0, "RGB").otherwise("YCbCr")).when(components == 4, four).otherwise("Unknown")
