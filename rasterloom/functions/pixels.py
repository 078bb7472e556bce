"""Pixel formats: channel order of packed pixels, conversion to and from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import clamp, cmyk_to_rgb, long, luma, rgb565, rgb_to_ycbcr, ycbcr_to_rgb, ycck_to_cmyk

#: Channels of a pixel in byte order; a and x are 255.
FORMATS = {f: f for f in ("rgb", "rgba", "rgbx", "bgr", "bgra", "bgrx", "argb", "xrgb", "abgr", "xbgr", "cmyk")} | {"gray": "v"}


def pack(fmt: str, **channels) -> Column:
    """A pixel as one number, its first byte the most significant."""
    out = F.lit(0).cast("bigint")
    for c in FORMATS[fmt]:
        out = out * 256 + (F.lit(255).cast("bigint") if c in "ax" else long(channels[c]))
    return out


def unpack(fmt: str, pixel: Column) -> dict[str, Column]:
    """The channels of a packed pixel."""
    names = FORMATS[fmt]
    return {c: F.shiftright(pixel, 8 * (len(names) - 1 - i)).bitwiseAND(255) for i, c in enumerate(names)}


def encoder_planes(fmt: str, pixel: Column) -> tuple[Column, ...]:
    """Component samples an encoder makes of a packed pixel: gray alone, CMYK as it is, else YCbCr."""
    c = unpack(fmt, pixel)
    if fmt in ("gray", "cmyk"):
        return tuple(c.values())
    return rgb_to_ycbcr(c["r"], c["g"], c["b"])


def luminance(fmt: str, pixel: Column) -> Column:
    """Luma of a packed pixel; CMYK has the constant 128."""
    c = unpack(fmt, pixel)
    return c["v"] if fmt == "gray" else F.lit(128).cast("bigint") if fmt == "cmyk" else luma(c["r"], c["g"], c["b"])


def output_pixel(space: str, fmt: str, *s) -> Column:
    """A decoded pixel of component samples ``s`` in colour space ``space`` as ``fmt``.

    As files are decoded: gray comes only from gray, CMYK only from four
    components, an RGB file only as rgb, 5-6-5 not from four components;
    anything else is not supported and raises ValueError."""
    if space == "Grayscale":
        if fmt == "rgb565":
            return rgb565(*[s[0]] * 3)
        if fmt != "cmyk":
            return pack(fmt, v=s[0], r=s[0], g=s[0], b=s[0])
    elif space == "RGB" and fmt == "rgb":
        return pack(fmt, r=s[0], g=s[1], b=s[2])
    elif space == "YCbCr" and fmt not in ("gray", "cmyk"):
        r, g, b = ycbcr_to_rgb(*s)
        return rgb565(r, g, b) if fmt == "rgb565" else pack(fmt, r=r, g=g, b=b)
    elif space in ("CMYK", "YCCK") and fmt not in ("gray", "rgb565"):
        inks = ycck_to_cmyk(*s) if space == "YCCK" else tuple(map(long, s))
        if fmt == "cmyk":
            return pack(fmt, **dict(zip("cmyk", inks, strict=True)))
        return pack(fmt, **dict(zip("rgb", cmyk_to_rgb(*inks), strict=True)))
    raise ValueError(f"no {fmt} output of {space}")


def overridden(space: str, *s) -> Column:
    """Output under a colour-space override: the first component, or YCbCr samples as they are in three bytes."""
    if space == "Grayscale":
        return pack("gray", v=s[0])
    if space == "YCbCr" and len(s) >= 3:
        return pack("rgb", r=s[0], g=s[1], b=s[2])
    raise ValueError(f"no output as {space}")


def lossless_output(shift: int, *s) -> Column:
    """Decoded lossless samples: gray is scaled back by the point transform (one byte), colour is cut at 255."""
    if len(s) == 1:
        return (F.shiftleft(long(s[0]), shift)).bitwiseAND(255)
    return pack("rgb", **{c: clamp(long(v)) for c, v in zip("rgb", s, strict=True)})

