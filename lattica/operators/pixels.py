"""Per-pixel preprocessing of pixels(image_id, r, c, height, width, channels..., mask)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.color import rgb_to_hsv, rgb_to_lab
from lattica.operators.graphs import grid_graph, image_components

CHANNELS = ["b", "g", "red"]


def resize(pixels: DataFrame, max_pixels: int = 15_000) -> DataFrame:
    """Images with more than max_pixels kept pixels are shrunk by averaging blocks; our reading of an unspecified rule."""
    n = pixels.groupBy("image_id").agg(F.count_if(F.col("mask") != 0).alias("n"))
    s = F.least(F.lit(1.0), F.sqrt(F.lit(float(max_pixels)) / F.greatest("n", F.lit(1))))
    p = pixels.join(n, "image_id").withColumn("s", s)
    new = [F.floor(F.col(a) * F.col("s")).cast("int").alias(a) for a in ("r", "c")]
    size = [F.max(F.ceil(F.col(a) * F.col("s"))).cast("int").alias(a) for a in ("height", "width")]
    out = p.groupBy("image_id", *new).agg(*size, *(F.avg(c).alias(c) for c in CHANNELS), F.when(F.avg("mask") >= 0.5, 1.0).otherwise(0.0).alias("mask"))
    return out.select("image_id", "r", "c", "height", "width", *CHANNELS, "mask")


def largest_component(pixels: DataFrame) -> DataFrame:
    """Only the largest 4-connected part of each mask is kept (ties: that with the first pixel)."""
    fg = pixels.where("mask >= 0.5").select("image_id", (F.col("r") * F.col("width") + F.col("c")).alias("v"))
    comps = image_components(fg, grid_graph(pixels, 4, features=CHANNELS[:1]))
    w = Window.partitionBy("image_id").orderBy(F.desc("size"), "root")
    best = comps.groupBy("image_id", "root").agg(F.count("*").alias("size")).withColumn("n", F.row_number().over(w)).where("n = 1").select("image_id", "root")
    keep = comps.join(best, ["image_id", "root"], "left_semi").select("image_id", "v", F.lit(1.0).alias("kept"))
    p = pixels.withColumn("v", F.col("r") * F.col("width") + F.col("c")).join(keep, ["image_id", "v"], "left")
    return p.withColumn("mask", F.coalesce("kept", F.lit(0.0))).drop("v", "kept")


def smoothed(x: np.ndarray, half: int) -> np.ndarray:
    """kuwahara() of one image [row, column, channel]."""
    h, w, k = x.shape
    out, least = x.copy(), np.full((h, w), np.inf)
    if h <= half or w <= half:
        return out
    for left in (True, False):
        for up in (True, False):
            rows = np.arange(half, h) if up else np.arange(h - half)
            cols = np.arange(half, w) if left else np.arange(w - half)
            window = np.lib.stride_tricks.sliding_window_view(x, (half, half), axis=(0, 1))  # [row, column, channel, half, half]
            seen = window[(rows - half if up else rows)[:, None], (cols - half if left else cols)[None, :]]
            mean = seen.mean(axis=(3, 4))
            spread = np.sqrt(((seen - mean[..., None, None]) ** 2).sum(axis=2)).mean(axis=(2, 3)).round(9)
            at = np.ix_(rows, cols)
            better = spread < least[at]
            least[at] = np.where(better, spread, least[at])
            out[at] = np.where(better[..., None], mean, out[at])
    return out


def kuwahara(pixels: DataFrame, half: int = 5, channels: list[str] | None = None) -> DataFrame:
    """Each pixel becomes the mean of the quadrant with the least mean distance to its mean (ties: the first quadrant).

    Quadrants are half-open squares of `half` pixels up or down and left or right, in that order; one is used only where it
    lies strictly inside the image. Where none does, the pixel stays as it is. The mask plays no part. An image, whose size
    resize() bounds, is one task's work.
    """
    channels = channels or CHANNELS
    names = ["image_id", "r", "c", *channels]

    def run(d: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((int(d["height"].iloc[0]), int(d["width"].iloc[0]), len(channels)))
        x[d["r"], d["c"]] = d[channels].to_numpy(float)
        d = d[names].copy()
        d[channels] = smoothed(x, half)[d["r"], d["c"]]
        return d

    smooth = pixels.select(*names, "height", "width").groupBy("image_id").applyInPandas(run, "image_id long, r int, c int, " + ", ".join(f"{c} double" for c in channels))
    rest = pixels.drop(*channels)
    return rest.join(smooth, ["image_id", "r", "c"]).select(*pixels.columns)


def to_lab(pixels: DataFrame, scale: float = 255.0) -> DataFrame:
    """pixels with l, a, bb from BGR channels over scale."""
    lab = rgb_to_lab(F.col("red") / scale, F.col("g") / scale, F.col("b") / scale)
    return pixels.withColumns(dict(zip(("l", "a", "bb"), lab, strict=True)))


def preprocess(pixels: DataFrame, half: int = 5, max_pixels: int = 15_000, scale: float = 255.0) -> DataFrame:
    """Resize, keep the largest part of the mask, smooth, and convert to Lab."""
    return pixels.transform(resize, max_pixels).transform(largest_component).transform(kuwahara, half).transform(to_lab, scale)


def crop(pixels: DataFrame) -> DataFrame:
    """The bounding box of each mask, moved to the origin."""
    box = pixels.where("mask > 0").groupBy("image_id").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    p = pixels.join(box, "image_id").where("r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1")
    return p.withColumns({"r": F.col("r") - F.col("r0"), "c": F.col("c") - F.col("c0"), "height": F.col("r1") - F.col("r0") + 1, "width": F.col("c1") - F.col("c0") + 1}).drop("r0", "r1", "c0", "c1")


def equalize(pixels: DataFrame, channel: str, low: float, high: float) -> DataFrame:
    """A channel's values by their rank among an image's kept pixels, spread over a range."""
    w = Window.partitionBy("image_id", F.col("mask") > 0).orderBy(channel)
    return pixels.withColumn(channel, F.when(F.col("mask") > 0, low + F.cume_dist().over(w) * (high - low)).otherwise(F.col(channel)))


def channel_histograms(pixels: DataFrame, bins: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(image_id, channel, bin, n) of kept pixels, bins from 0; values at the upper end are in the last."""
    each = pixels.where("mask > 0").select("image_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, CHANNELS)), F.array(*CHANNELS))).alias("channel", "x"))
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("x") - low) / (high - low) * bins))).cast("int")
    return each.groupBy("image_id", "channel", b.alias("bin")).agg(F.count("*").alias("n"))


def foreground_count(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg(F.count_if(F.col("mask") != 0).alias("n"))


#: The spellings of "kept" that operators use, each with its own bound.
PREDICATES = {"at_least_half": lambda m: m >= 0.5, "above_zero": lambda m: m > 0, "above_half": lambda m: m > 0.5, "not_above_zero": lambda m: m <= 0, "below_half": lambda m: m < 0.5, "not_zero": lambda m: m != 0}


def kept(mask: Column, predicate: str) -> Column:
    return PREDICATES[predicate](mask)


def rescale_channels(pixels: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """Each channel of an image spread from its least to its greatest value over 0 to 1 (for display); a flat one is 0."""
    w = Window.partitionBy("image_id")
    spread = lambda c: F.max(c).over(w) - F.min(c).over(w)
    return pixels.withColumns({c: F.when(spread(c) > 0, (F.col(c) - F.min(c).over(w)) / spread(c)).otherwise(0.0) for c in channels or CHANNELS})


def equalize_hue(pixels: DataFrame) -> DataFrame:
    """pixels with hue: degrees, by rank among an image's kept pixels spread over the circle."""
    return equalize(pixels.withColumn("hue", rgb_to_hsv(F.col("red"), F.col("g"), F.col("b"))[0]), "hue", 0.0, 360.0)


def stacked(top: DataFrame, bottom: DataFrame, keys: list[str]) -> DataFrame:
    """Matrices (keys, i, j, v) one above the other: the lower one's rows are counted on from the upper one's last."""
    n = top.groupBy(*keys).agg((F.max("i") + 1).alias("n"))
    low = bottom.join(n, keys, "left").select(*keys, (F.col("i") + F.coalesce("n", F.lit(0))).alias("i"), "j", "v")
    return top.select(*keys, "i", "j", "v").unionByName(low)
