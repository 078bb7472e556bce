"""Sizes of planes, buffers and outputs as integer column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def up(a: Column, b) -> Column:
    """Smallest whole number not below a / b."""
    return F.ceil(a / b)


def pad(a: Column, b) -> Column:
    return up(a, b) * b


def jpeg_buffer(w: Column, h: Column, sh: Column, sv: Column) -> Column:
    return pad(w, sh * 8) * pad(h, sv * 8) * (2 + F.floor(F.lit(4) / (sh * sv))) + 2048


def plane_width(component: int, w: Column, sh: Column) -> Column:
    return pad(w, sh) if component == 0 else up(w, sh)


def plane_height(component: int, h: Column, sv: Column) -> Column:
    return pad(h, sv) if component == 0 else up(h, sv)


def yuv_buffer(w: Column, h: Column, sh: Column, sv: Column) -> Column:
    return plane_width(0, w, sh) * plane_height(0, h, sv) + 2 * plane_width(1, w, sh) * plane_height(1, h, sv)


def scaled(dim: Column, num: Column, denom: Column) -> Column:
    return up(dim * num, denom)


def component_block_size(size: Column, max_h: Column, max_v: Column, h: Column, v: Column) -> Column:
    """Inverse transform size of a component: doubled while that absorbs its subsampling."""
    out = size
    for _ in range(3):  # from 1 to 8
        more = (out < 8) & (F.pmod(max_h * size, h * out * 2) == 0) & (F.pmod(max_v * size, v * out * 2) == 0)
        out = F.when(more, out * 2).otherwise(out)
    return out


def subsampling(max_h: Column, max_v: Column, h: Column, v: Column) -> Column:
    from .fixed import SAMPLING

    out = F.lit("Unknown")
    for name, (a, b) in SAMPLING.items():
        out = F.when((max_h == h * a) & (max_v == v * b), name).otherwise(out)
    return out


def crop_region(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, components: Column, max_h: Column) -> Column:
    """Struct of the region a cropped decode gives: x at the start of a unit
    column, the right edge kept, all inside the image; w or h 0 if nothing is left."""
    unit = F.when(components == 1, 8).otherwise(max_h * 8)
    left, top = F.least(x, width), F.least(y, height)
    start = left - F.pmod(left, unit)
    return F.struct(start.alias("x"), top.alias("y"), F.least(w + left - start, width - start).alias("w"), F.least(h, height - top).alias("h"))


def upsampling(max_h: Column, max_v: Column, h: Column, v: Column, merged: Column, rgb: Column, fast: Column, chroma_width: Column, block: Column) -> Column:
    """How chroma of factors (h, v) is brought to full size: none for equal
    factors, merged with the colour conversion where asked for RGB, fancy for
    both axes, else by component; boxes if fast, narrow or one sample a block."""
    across, down = max_h / h, max_v / v
    box = fast | (chroma_width <= 2) | (block == 1)
    return (
        F.when((across == 1) & (down == 1), "none").when(merged & rgb & (across == 2) & down.isin(1, 2), "merged").when(box, "box")
        .when((across == 2) & (down == 2), "fancy h2v2").when((across == 2) & (down == 1), "fancy h2v1").when((across == 1) & (down == 2), "fancy h1v2").otherwise("box")
    )
