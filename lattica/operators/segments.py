"""Partitions of images and what is summed up for their segments.

components(image_id, pix, root): root names a pixel's segment; segments(image_id, pix, seg_idx) adds a dense index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.color import lab_to_rgb, rgb_to_hsv
from lattica.functions.vectors import euclidean
from lattica.operators.graphs import connected_components, grid_graph, image_components
from lattica.operators.kernels import felzenszwalb, fuse_small


def root_index(components: DataFrame) -> DataFrame:
    """seg_idx: segments counted from 0 by their first pixel."""
    first = components.groupBy("image_id", "root").agg(F.min("pix").alias("first"))
    w = Window.partitionBy("image_id").orderBy("first")
    return components.join(first.withColumn("seg_idx", F.row_number().over(w) - 1).drop("first"), ["image_id", "root"])


def component_sizes(components: DataFrame) -> DataFrame:
    n = components.groupBy("image_id", "root").agg(F.count("*").alias("size"))
    return components.join(n, ["image_id", "root"])


def partition_counts(components: DataFrame) -> DataFrame:
    """Elements and components of each partition."""
    return components.groupBy("image_id").agg(F.count("*").alias("elements"), F.count_distinct("root").alias("components"))


def singletons(pixels: DataFrame) -> DataFrame:
    p = F.col("r") * F.col("width") + F.col("c")
    return pixels.select("image_id", p.alias("pix"), p.alias("root"))


def union_pairs(elements: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Sets after all unions (src, dst) at once; the least member is the root."""
    return connected_components(elements, pairs, keys)


def segment_lists(segments: DataFrame) -> DataFrame:
    """(image_id, seg_idx, members): the printed form's braces, one row for each segment."""
    return segments.groupBy("image_id", "seg_idx").agg(F.concat(F.lit("{"), F.concat_ws(", ", F.array_sort(F.collect_list("pix"))), F.lit("}")).alias("members"))


def index_color(index: Column) -> list[Column]:
    """Blue, green and red of an index: bytes of its product with a large odd number, so that near indexes look unlike."""
    h = (index.cast("long") + 1) * 2_654_435_761
    return [F.pmod(F.floor(h / (1 << s)), F.lit(256)).cast("int") for s in (8, 16, 24)]


def region_image(segments: DataFrame, palette: DataFrame | None = None) -> DataFrame:
    """(image_id, pix, b, g, red): each segment in its palette(seg_idx, b, g, red) colour, else one by its index."""
    if palette is not None:
        return segments.join(palette, "seg_idx", "left").select("image_id", "pix", "b", "g", "red")
    return segments.select("image_id", "pix", *(x.alias(n) for x, n in zip(index_color(F.col("seg_idx")), ("b", "g", "red"), strict=True)))


def matching_image(segments: DataFrame, matches: DataFrame) -> DataFrame:
    """Pixels of matched segments (image_id, seg_idx, match) in the match's colour, the others black."""
    s = segments.join(matches, ["image_id", "seg_idx"], "left")
    return s.select("image_id", "pix", *(F.when(F.col("match").isNull(), 0).otherwise(x).alias(n) for x, n in zip(index_color(F.col("match")), ("b", "g", "red"), strict=True)))


def _hue(lightness: Column, a: Column, b: Column) -> Column:
    return rgb_to_hsv(*lab_to_rgb(lightness, a, b))[0]


def segment_attributes(pixels: DataFrame, segments: DataFrame, channels: list[str], *, lab: bool = False) -> DataFrame:
    """(image_id, seg_idx, area, is_background, color, center, center_all, hue): all segment labels in one group-by.

    Sums are over pixels with mask > 0 and divided by the segment's size, masked or not; center is that of the mask over
    height and width, center_all the mean place. hue (with lab: channels are L, a, b) is averaged linearly, in degrees.
    """
    p = pixels.withColumn("pix", F.col("r") * F.col("width") + F.col("c")).join(segments, ["image_id", "pix"])
    fg = F.col("mask") > 0
    n = F.count("*")
    part = lambda x: F.coalesce(F.sum(F.when(fg, x)), F.lit(0.0)) / n
    hue = _hue(*map(F.col, channels)) if lab else rgb_to_hsv(*(F.col(c) for c in reversed(channels)))[0]
    return p.groupBy("image_id", "seg_idx").agg(
        n.alias("area"), (F.count_if(fg) == 0).alias("is_background"), F.array(*(part(F.col(c)) for c in channels)).alias("color"),
        F.array(part(F.col("r").cast("double")) / F.max("height"), part(F.col("c").cast("double")) / F.max("width")).alias("center"), F.array(F.avg("r"), F.avg("c")).alias("center_all"), part(hue).alias("hue"),
    )


def segment_ellipses(pixels: DataFrame, segments: DataFrame) -> DataFrame:
    """(image_id, seg_idx, major, minor, angle): axes of the pixels' scatter over the diagonal, and the angle from the row axis.

    The angle lies in 0 to pi/2, as an axis has no sign, and is 0 where the axes are equal. The mask plays no part. Sums are
    of whole numbers, so that a round segment's scatter has no direction by rounding.
    """
    p = pixels.withColumn("pix", F.col("r") * F.col("width") + F.col("c")).join(segments, ["image_id", "pix"])
    r, c, n = F.col("r").cast("long"), F.col("c").cast("long"), F.count("*")
    scatter = lambda a, b: (n * F.sum(a * b) - F.sum(a) * F.sum(b)) / n
    s = p.groupBy("image_id", "seg_idx").agg(scatter(r, r).alias("rr"), scatter(c, c).alias("cc"), scatter(r, c).alias("rc"), F.max("height").alias("h"), F.max("width").alias("w"))
    mid, gap = (F.col("rr") + F.col("cc")) / 2, F.sqrt(F.pow((F.col("rr") - F.col("cc")) / 2, F.lit(2.0)) + F.col("rc") * F.col("rc"))
    diag = F.sqrt(F.col("h") * F.col("h") + F.col("w") * F.col("w"))
    axis = lambda v: 2 * F.sqrt(F.greatest(F.lit(0.0), v)) / diag
    angle = F.abs(F.atan2(2 * F.col("rc"), F.col("rr") - F.col("cc")) / 2)
    return s.select("image_id", "seg_idx", axis(mid + gap).alias("major"), axis(mid - gap).alias("minor"), angle.alias("angle"))


LAB_RANGES = ((0.0, 100.0), (-127.0, 127.0), (-127.0, 127.0))


def bin_of(x: Column, low: float, high: float, bins: int) -> Column:
    """Bin from 0, the upper end in the last; null outside the range."""
    return F.when((x >= low) & (x <= high), F.least(F.lit(bins - 1), F.floor((x - low) / (high - low) * bins)).cast("int"))


def color_histogram(pixels: DataFrame, channels: list[str], bins: int = 5, ranges=LAB_RANGES) -> DataFrame:
    """(image_id, b0, b1, b2, n) of kept pixels; bins without pixels are not listed."""
    b = [bin_of(F.col(c), *r, bins).alias(f"b{i}") for i, (c, r) in enumerate(zip(channels, ranges, strict=True))]
    return pixels.where("mask > 0").select("image_id", *b).where("b0 IS NOT NULL AND b1 IS NOT NULL AND b2 IS NOT NULL").groupBy("image_id", "b0", "b1", "b2").agg(F.count("*").alias("n"))


def full_histogram(hist: DataFrame, bins: int = 5) -> DataFrame:
    """The histogram with rows for bins that no pixel is in."""
    every = hist.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(bins**3 - 1))).alias("k"))
    every = every.select("image_id", F.floor(F.col("k") / bins**2).cast("int").alias("b0"), F.floor(F.col("k") / bins % bins).cast("int").alias("b1"), (F.col("k") % bins).alias("b2"))
    return every.join(hist, ["image_id", "b0", "b1", "b2"], "left").fillna(0, ["n"])


def palette(hist: DataFrame, bins: int = 5, ranges=LAB_RANGES, *, center: bool = False) -> DataFrame:
    """(image_id, place, n, colour): bins in rising order of count, then bin; colour is a bin's lower edge or its centre."""
    w = Window.partitionBy("image_id").orderBy("n", "b0", "b1", "b2")
    edge = [r[0] + (F.col(f"b{i}") + (0.5 if center else 0.0)) * (r[1] - r[0]) / bins for i, r in enumerate(ranges)]
    return hist.select("image_id", (F.row_number().over(w) - 1).alias("place"), "n", *(e.alias(f"p{i}") for i, e in enumerate(edge)))


def palette_rewrite(pixels: DataFrame, channels: list[str], colors: DataFrame, bins: int = 5, ranges=LAB_RANGES) -> DataFrame:
    """Kept pixels take the colour (c0, c1, c2) that colors(b0, b1, b2) has for their bin; others stay."""
    b = {f"b{i}": bin_of(F.col(c), *r, bins) for i, (c, r) in enumerate(zip(channels, ranges, strict=True))}
    out = pixels.withColumns({f"_{k}": v for k, v in b.items()}).join(colors.select(*(F.col(k).alias(f"_{k}") for k in b), "c0", "c1", "c2"), [f"_{k}" for k in b], "left")
    for i, c in enumerate(channels):
        out = out.withColumn(c, F.when(F.col("mask") > 0, F.coalesce(f"c{i}", F.col(c))).otherwise(F.col(c)))
    return out.drop(*(f"_{k}" for k in b), "c0", "c1", "c2")


def run_length_stats(rows: DataFrame, key: str, order: list[str], x: str, y: str) -> DataFrame:
    """(key, run, x, low, mean, high, n): consecutive rows of equal x are a run; a later repeat is a new one."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.when(F.lag(x).over(w).eqNullSafe(F.col(x)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run").agg(F.first(x).alias("x"), F.min(y).alias("low"), F.avg(y).alias("mean"), F.max(y).alias("high"), F.count("*").alias("n"))


def block_labels(rows: DataFrame, place: str, step: int) -> DataFrame:
    """block: rows of `step` consecutive places share a label."""
    return rows.withColumn("block", F.floor(F.col(place) / step).cast("long"))


def segment_extremes(segments: DataFrame) -> DataFrame:
    n = segments.groupBy("image_id").agg(F.count_distinct("seg_idx").alias("n"))
    return n.agg(F.min("n").alias("least"), F.max("n").alias("most"))


def fuse_by_hue(segments: DataFrame, hues: DataFrame) -> DataFrame:
    """(image_id, seg_idx, root): of all pairs of segments but the first, the tenth with the least hue difference is fused.

    hues(image_id, seg_idx, hue). Differences are linear, ties go by indexes, and segments need not touch.
    """
    h = hues.where("seg_idx > 0")
    a, b = h.select("image_id", F.col("seg_idx").alias("src"), F.col("hue").alias("ha")), h.select("image_id", F.col("seg_idx").alias("dst"), F.col("hue").alias("hb"))
    p = a.join(b, "image_id").where("src < dst").withColumn("diff", F.round(F.abs(F.col("ha") - F.col("hb")), 9))
    w = Window.partitionBy("image_id").orderBy("diff", "src", "dst")
    n = F.count("*").over(Window.partitionBy("image_id"))
    near = p.withColumns({"k": F.row_number().over(w), "n": n}).where(F.col("k") <= F.floor(F.col("n") / 10)).select("image_id", "src", "dst")
    vertices = segments.select("image_id", F.col("seg_idx").alias("v")).distinct()
    return image_components(vertices, near).withColumnRenamed("v", "seg_idx")


def fuse_close(segments: DataFrame, adjacency: DataFrame, labels: DataFrame, limit: float) -> DataFrame:
    """(image_id, v, root): adjacent segments whose labels (image_id, seg_idx, x) are at most `limit` apart are fused."""
    s, d = labels.select("image_id", F.col("seg_idx").alias("src"), F.col("x").alias("xa")), labels.select("image_id", F.col("seg_idx").alias("dst"), F.col("x").alias("xb"))
    near = adjacency.join(s, ["image_id", "src"]).join(d, ["image_id", "dst"]).where(euclidean(F.col("xa"), F.col("xb")) <= limit).select("image_id", "src", "dst")
    return image_components(segments.select("image_id", F.col("seg_idx").alias("v")).distinct(), near)


def color_segmentation(pixels: DataFrame, channels: list[str]) -> DataFrame:
    """components: kept pixels of one exact colour are a segment, wherever they lie; the others join an element after the last."""
    pix = F.col("r") * F.col("width") + F.col("c")
    first = F.min(pix).over(Window.partitionBy("image_id", F.col("mask") > 0, *channels))
    return pixels.select("image_id", pix.alias("pix"), F.when(F.col("mask") > 0, first).otherwise(F.col("height") * F.col("width")).alias("root"))


def manual_segmentation(pixels: DataFrame, channels: list[str], least: int = 25) -> DataFrame:
    """color_segmentation() of a colour-coded image, with kept parts of fewer than `least` pixels fused to a neighbour."""
    p = pixels.select("image_id", (F.col("r") * F.col("width") + F.col("c")).alias("pix"), "mask")
    parts = color_segmentation(pixels, channels).join(p, ["image_id", "pix"])
    kept = parts.where("mask > 0").select("image_id", "pix", "root")
    fused = fuse_small(kept, grid_graph(pixels, 4, features=channels[:1]), p, least)
    return fused.unionByName(parts.where("mask <= 0").select(*fused.columns))


def segment(pixels: DataFrame, channels: list[str], k: float = 1000.0, parts: int = 500, *, lab: bool = False) -> DataFrame:
    """segments(image_id, pix, root, seg_idx) of pixels: the grid graph of colour distances, cut by felzenszwalb() with the
    volume's scale and a least size of kept pixels over `parts`, and then fused by hue.

    lab: the channels are L, a, b. All pixels that the mask leaves out are one segment, which hue fuses with no other as
    long as it holds the first pixel.
    """
    first = root_index(felzenszwalb(pixels, grid_graph(pixels, 4, euclidean, channels), k, parts))
    hues = segment_attributes(pixels, first, channels, lab=lab).select("image_id", "seg_idx", "hue")
    fused = fuse_by_hue(first, hues).withColumnRenamed("root", "into")
    least = first.groupBy("image_id", F.col("seg_idx").alias("into")).agg(F.min("pix").alias("root"))
    joined = first.select("image_id", "pix", "seg_idx").join(fused, ["image_id", "seg_idx"]).join(least, ["image_id", "into"])
    return root_index(joined.select("image_id", "pix", "root"))
