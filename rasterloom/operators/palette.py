"""Palettes: histogram, median cut, uniform palette, dither, nearest entry, lookup.

Pixels are reduced to distinct colours before they meet the palette (at most
256 entries), so the nearest search costs colours x entries, not pixels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.color import clamp
from ..workers import ready


def histogram(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("r", "g", "b").agg(F.count(F.lit(1)).alias("n"))


def uniform_palette(spark: SparkSession, colors: int) -> DataFrame:
    """idx, r, g, b: an even grid of at most ``colors`` colours, 6 steps a channel at most."""
    n = max(i for i in range(1, 7) if i == 1 or i**3 <= colors)
    step = lambda c: F.floor(c * 255 / (n - 1)) if n > 1 else F.lit(128).cast("bigint")
    i = F.col("id")
    return spark.range(n**3).select(i.alias("idx"), step(F.floor(i / (n * n))).alias("r"), step(F.floor(i / n) % n).alias("g"), step(i % n).alias("b"))


def nearest(colors: DataFrame, palette: DataFrame) -> DataFrame:
    """r, g, b, idx: the entry of least squared distance, the first of equals.

    The palette (at most 256 rows) goes to the tasks as one matrix; distinct
    colours meet it block by block. A null channel gets the first entry; without
    a palette ``idx`` is null."""
    ready(colors.sparkSession)
    rows = sorted(tuple(r) for r in palette.select("idx", "r", "g", "b").limit(257).collect())
    if len(rows) > 256:
        raise ValueError("a palette has at most 256 entries")
    if not rows:
        return colors.select("r", "g", "b").distinct().withColumn("idx", F.lit(None).cast("bigint"))
    entries = np.array(rows, np.float64)
    names = ["r", "g", "b"]
    schema = ", ".join(f"{c} {colors.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        for b in batches:
            rgb = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(3)], 1)
            at = [((rgb[a : a + 2048, None] - entries[None, :, 1:]) ** 2).sum(axis=2).argmin(axis=1) for a in range(0, len(rgb), 2048)]
            idx = entries[np.concatenate(at), 0].astype(np.int64) if at else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(idx)], names=[*names, "idx"])

    return colors.select(*names).distinct().mapInArrow(run, f"{schema}, idx bigint")


def index_pixels(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    return pixels.join(nearest(pixels, palette), ["r", "g", "b"])


def color_of(indexed: DataFrame, palette: DataFrame) -> DataFrame:
    """Pixels of palette indices: a lookup join."""
    return indexed.select("id", "idx").join(F.broadcast(palette), "idx")


def median_cut(pixels: DataFrame, colors: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, idx, r, g, b: at most ``colors`` entries for each image.

    Pixels are reduced to a histogram first; an image's distinct colours (2**24
    at most) meet in one task. The box of largest range times pixels is split at
    its weighted median until there are enough; entries are truncated weighted
    means. With fewer distinct colours these are the palette, in order. A total
    order of colours makes the result independent of partitioning."""
    if not 1 <= colors <= 256:
        raise ValueError("1 to 256 colours")
    ready(pixels.sparkSession)
    counts = pixels.groupBy(*keys, "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema}

    def cut(table: pa.Table) -> pa.Table:
        found = cut_boxes(np.stack([table[c].to_numpy() for c in "rgb"], 1).astype(np.int64), table["n"].to_numpy(), colors)
        held = [table[k].combine_chunks().take(pa.array([0] * len(found))) for k in keys]
        return pa.table([*held, pa.array(range(len(found)), pa.int64()), *[pa.array(found[:, i]) for i in range(3)]], names=[*keys, "idx", "r", "g", "b"])

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "idx long, r long, g long, b long"])
    return counts.groupBy(*keys).applyInArrow(cut, schema)


def cut_boxes(rgb: np.ndarray, n: np.ndarray, colors: int) -> np.ndarray:
    """Palette (m, 3) of the distinct colours ``rgb`` met ``n`` times."""
    order = np.lexsort(rgb.T[::-1])
    rgb, n = rgb[order], n[order]
    if len(rgb) <= colors:
        return rgb

    def box(at: np.ndarray):
        spans = np.ptp(rgb[at], axis=0)
        return at, int(spans.argmax()), int(spans.max() * n[at].sum())

    boxes = [box(np.arange(len(rgb)))]
    while len(boxes) < colors:
        i = max(range(len(boxes)), key=lambda j: (boxes[j][2], -j))
        at, channel, score = boxes[i]
        if score == 0:
            break
        at = at[np.argsort(rgb[at, channel], kind="stable")]
        run = np.cumsum(n[at])
        middle = max(1, int(np.searchsorted(run, run[-1] // 2)))
        boxes[i : i + 1] = []
        boxes += [box(at[:middle]), box(at[middle:])]
    return np.array([(rgb[at] * n[at, None]).sum(axis=0) // n[at].sum() for at, *_ in boxes])


def median_cut_boxes(pixels: DataFrame, levels: int) -> DataFrame:
    """r, g, b, n, box: colours in 2**levels boxes, each split at the weighted
    median of its widest channel: a variant that splits all boxes at a time and
    stays distributed, for colours of very many images as one. One aggregation and one window per level; a
    total order of colours makes the result independent of partitioning."""
    from pyspark.sql import Window

    boxes = histogram(pixels).withColumn("box", F.lit(0).cast("bigint"))
    for _ in range(levels):
        spans = boxes.groupBy("box").agg(*[(F.max(c) - F.min(c)).alias(f"s{c}") for c in "rgb"], F.sum("n").alias("total"))
        joined = boxes.join(spans, "box")
        widest = F.greatest("sr", "sg", "sb")
        key = F.when(F.col("sr") == widest, F.col("r")).when(F.col("sg") == widest, F.col("g")).otherwise(F.col("b"))
        below = F.sum("n").over(Window.partitionBy("box").orderBy(key, "r", "g", "b").rowsBetween(Window.unboundedPreceding, -1))
        upper = F.coalesce(below, F.lit(0)) * 2 >= F.col("total")
        boxes = joined.select("r", "g", "b", "n", (F.col("box") * 2 + F.when(upper, 1).otherwise(0)).alias("box"))
    return boxes


def box_palette(boxes: DataFrame) -> DataFrame:
    """idx, r, g, b: truncated weighted means of the boxes."""
    mean = lambda c: F.floor(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
    return boxes.groupBy(F.col("box").alias("idx")).agg(mean("r"), mean("g"), mean("b"))


def dithered(pixels: DataFrame, colors: int | Column) -> DataFrame:
    """``pixels`` with the ordered 4x4 thresholds added for a palette of ``colors``
    entries, in single precision, rounded half away from zero and clamped."""
    n = F.lit(colors) if isinstance(colors, int) else colors
    spread = F.when(n > 1, F.lit(255.0).cast("float") / F.greatest(n - 1, F.lit(1)).cast("float")).otherwise(128.0).cast("float")
    at = F.element_at(F.array(*[F.lit(v / 16).cast("float") for v in fixed.BAYER]), (F.pmod("y", F.lit(4)) * 4 + F.pmod("x", F.lit(4)) + 1).cast("int"))
    moved = {c: (F.col(c).cast("float") + (at * spread).cast("float")).cast("float").cast("double") for c in "rgb"}
    return pixels.withColumns({c: clamp(F.when(v >= 0, F.floor(v + 0.5)).otherwise(F.ceil(v - 0.5))) for c, v in moved.items()})


def diffuse(y: np.ndarray, x: np.ndarray, rgb: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Entry numbers of one image's pixels, given in any order, with error diffusion.

    A pixel takes 7/16, 3/16, 5/16 and 1/16 of the errors of its left, upper
    right, upper and upper left neighbour, in single precision; it is rounded
    half away from zero and clamped before its entry is chosen (the first of
    equally near ones) and its own error taken. Pixels with equal x + 2 y don't
    wait for each other: an image takes W + 2 H steps over vectors."""
    height, width = int(y.max()) + 1, int(x.max()) + 1
    own = np.zeros((height, width, 3), np.float32)
    own[y, x] = rgb
    error = np.zeros((height + 1, width + 2, 3), np.float32)  # a border without errors: above, left and right
    out = np.zeros((height, width), np.int64)
    shares = [np.float32(n / 16) for n in (1, 5, 3, 7)]
    for t in range(width + 2 * (height - 1)):
        r = np.arange(max(0, -(-(t - width + 1) // 2)), min(height - 1, t // 2) + 1)
        c = t - 2 * r
        v = own[r, c]
        for share, (dr, dc) in zip(shares, ((0, 0), (0, 1), (0, 2), (1, 0)), strict=True):
            v = v + error[r + dr, c + dc] * share
        shown = np.clip(np.trunc(v + np.copysign(np.float32(0.5), v)), 0, 255).astype(np.int64)
        near = ((shown[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
        out[r, c] = near
        error[r + 1, c + 1] = shown - entries[near]
    return out[y, x]


def error_diffused(pixels: DataFrame, palette: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``pixels`` (keys, y, x, r, g, b and others) with idx, images apart by ``keys``.

    ``palette`` has idx, r, g, b of every image. An image is a group, as every
    pixel waits for those before it; images run side by side. Images without a
    palette have no result."""
    if not keys:
        raise ValueError("error diffusion needs the columns that tell images apart")
    ready(pixels.sparkSession)

    def run(image: pa.Table, entries: pa.Table) -> pa.Table:
        if not image.num_rows or not entries.num_rows:
            return image.slice(0, 0).append_column("idx", pa.array([], pa.int64()))
        entries = entries.sort_by("idx")
        colors = np.stack([entries[c].to_numpy() for c in "rgb"], 1).astype(np.int64)
        at = diffuse(image["y"].to_numpy(), image["x"].to_numpy(), np.stack([image[c].to_numpy() for c in "rgb"], 1), colors)
        return image.append_column("idx", pa.array(entries["idx"].to_numpy()[at]))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pixels.schema)
    own = [f"_k{i}" for i in range(len(keys))]  # the palettes may come from the same table
    entries = palette.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col("idx").cast("bigint").alias("idx"), *[F.col(c).alias(c) for c in "rgb"])
    return pixels.groupBy(*keys).cogroup(entries.groupBy(*own)).applyInArrow(run, f"{kinds}, idx bigint")


def quantize_images(pixels: DataFrame, colors: int = 256, method: str = "median_cut", dither: str = "none", keys: tuple[str, ...] = ("image",)) -> tuple[DataFrame, DataFrame]:
    """(palettes, pixels with idx) of many images told apart by ``keys``, each with a palette of its own.

    method: median_cut or uniform; dither: none, ordered or diffused. Images
    meet only their own palettes, by a join on the keys."""
    if method not in ("median_cut", "uniform") or dither not in ("none", "ordered", "diffused"):
        raise ValueError(f"no quantization {method} with dither {dither}")
    if method == "median_cut":
        entries = median_cut(pixels, colors, keys)
    else:
        entries = pixels.select(*keys).distinct().join(F.broadcast(uniform_palette(pixels.sparkSession, colors)))  # at most 216 entries
    if dither == "diffused":
        return entries, error_diffused(pixels, entries, keys)
    gathered = entries.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", "r", "g", "b"))).alias("entries"))  # at most 256 an image
    shown = pixels.join(gathered, list(keys))
    if dither == "ordered":
        shown = dithered(shown, F.size("entries"))
    near = F.array_min(F.transform("entries", lambda e: F.struct(
        ((F.col("r") - e.r) * (F.col("r") - e.r) + (F.col("g") - e.g) * (F.col("g") - e.g) + (F.col("b") - e.b) * (F.col("b") - e.b)).alias("d"), e.idx.alias("idx"))))
    return entries, shown.select(*pixels.columns, near["idx"].alias("idx"))


def quantize(pixels: DataFrame, colors: int = 256, method: str = "median_cut", dither: str = "none") -> tuple[DataFrame, DataFrame]:
    """(palette, pixels with idx) of one image: median_cut or uniform, plain or ordered."""
    if method not in ("median_cut", "uniform") or dither not in ("none", "ordered"):
        raise ValueError(f"no quantization {method} with dither {dither}")
    entries = median_cut(pixels, colors) if method == "median_cut" else uniform_palette(pixels.sparkSession, colors)
    shown = dithered(pixels, entries.count()) if dither == "ordered" else pixels  # at most 256 rows
    return entries, index_pixels(shown, entries)
