"""Weighted graphs as relations: edges(graph, src, dst, w) built by joins, and what is read off them.

`graph` is any key column (an image id); an edge is stored once unless mirrored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.vectors import constant_one, gaussian, squared_distance
from lattica.operators.neighbours import distances, pair_values
from lattica.plans.stored import components, cut

OFFSETS = {4: [(1, 0), (0, 1)], 8: [(1, -1), (1, 0), (1, 1), (0, 1)]}


def mirrored(edges: DataFrame) -> DataFrame:
    names = edges.columns
    return edges.unionByName(edges.select(*[F.col({"src": "dst", "dst": "src"}.get(n, n)).alias(n) for n in names]))


def grid_graph(pixels: DataFrame, connectivity: int = 4, weight: Callable[[Column, Column], Column] = constant_one, features: list[str] = ("v",), *, both_ways: bool = False) -> DataFrame:
    """(image_id, edge_no, src, dst, w) between neighbours with mask >= 0.5; weight takes two feature arrays.

    Neighbours meet by an equality join on image, row and column. edge_no is the order of a scan by pixel and offset.
    """
    fg = pixels.where("mask >= 0.5")
    x = F.array(*(F.col(f).cast("double") for f in features))
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for i, (dr, dc) in enumerate(OFFSETS[connectivity])))).alias("o")
    a = fg.select("image_id", (F.col("r") * F.col("width") + F.col("c")).alias("src"), "r", "c", x.alias("xa"), at)
    a = a.select("image_id", "src", (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"), "xa", (F.col("src") * len(OFFSETS[connectivity]) + F.col("o.k")).alias("edge_no"))
    b = fg.select("image_id", "r", "c", (F.col("r") * F.col("width") + F.col("c")).alias("dst"), x.alias("xb"))
    e = a.join(b, ["image_id", "r", "c"]).select("image_id", "edge_no", "src", "dst", weight(F.col("xa"), F.col("xb")).cast("double").alias("w"))
    return mirrored(e) if both_ways else e


def pixel_features(pixels: DataFrame) -> DataFrame:
    """(image_id, pix, x): column over width, row over height, first channel over 500, of pixels with mask > 0."""
    return pixels.where("mask > 0").select("image_id", (F.col("r") * F.col("width") + F.col("c")).alias("pix"), F.array(F.col("c") / F.col("width"), F.col("r") / F.col("height"), F.col("b") / 500).alias("x"))


def pairs(samples: DataFrame, keys: list[str]) -> DataFrame:
    """All ordered pairs (keys, i, j, xi, xj), i <> j, of samples(keys, id, x) within each group of bounded size (an image)."""
    a = samples.select(*keys, F.col("id").alias("i"), F.col("x").alias("xi"))
    b = samples.select(*keys, F.col("id").alias("j"), F.col("x").alias("xj"))
    return a.join(b, keys).where("i <> j")


def similarity(samples: DataFrame, score: Callable[[Column, Column], Column], keys: list[str]) -> DataFrame:
    """sim(keys, i, j, s) over ordered pairs of a group. For pairs of one large set see neighbours."""
    return pairs(samples, keys).select(*keys, "i", "j", score(F.col("xi"), F.col("xj")).alias("s"))


def all_similarities(samples: DataFrame, sigma2: float = 1.0) -> DataFrame:
    """sim(i, j, s) of all ordered pairs: exp(-d^2 / sigma2). As many rows as pairs, for what needs them all."""
    d = distances(samples).select("i", "j", F.exp(-F.col("d2") / sigma2).alias("s"))
    return d.unionByName(d.select(F.col("j").alias("i"), F.col("i").alias("j"), "s"))


def masked(samples: DataFrame, mask: DataFrame) -> DataFrame:
    """Samples whose id is in mask(id): a view, to be given to any builder."""
    return samples.join(mask.select("id").distinct(), "id", "left_semi")


def epsilon_graph(samples: DataFrame, radius: float) -> DataFrame:
    """(src, dst, w = 1) for i < j at a distance of at most the radius."""
    return distances(samples, radius).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.lit(1.0).alias("w"))


def _top(sim: DataFrame, k: int, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys, "i").orderBy(F.desc("s"), "j")
    return sim.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)


def knn_graph(sim: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """Each sample's k most similar others (ties: the smaller id); one edge for a pair, whichever way it was found."""
    keys = keys or []
    t = _top(sim, k, keys).select(*keys, F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst"), F.col("s").alias("w"))
    return t.groupBy(*keys, "src", "dst").agg(F.max("w").alias("w"))


def knn_lists(sim: DataFrame, k: int) -> DataFrame:
    return _top(sim, k, []).groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "j"))), lambda x: x["j"]).alias("neighbours"))


def mutual_knn_graph(sim: DataFrame, k: int) -> DataFrame:
    """Edges i < j where each is among the other's k most similar."""
    t = _top(sim, k, [])
    back = t.select(F.col("i").alias("j"), F.col("j").alias("i"))
    return t.join(back, ["i", "j"], "left_semi").where("i < j").select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("s").alias("w"))


def complete_graph(samples: DataFrame, score: Callable[[np.ndarray], np.ndarray], digits: int | None = None) -> DataFrame:
    """An edge for each pair i < j, weighted by a function of arrays of squared distances, rounded to digits if given."""
    return pair_values(samples, lambda d2, u, v: score(d2), "w", digits=digits).withColumnsRenamed({"i": "src", "j": "dst"})


def pixel_knn_graph(pixels: DataFrame, k: int, sigma2: float = 1.0) -> DataFrame:
    """k nearest neighbours of each pixel of an image by pixel_features, within the image."""
    s = pixel_features(pixels).withColumnRenamed("pix", "id")
    return knn_graph(similarity(s, lambda a, b: gaussian(squared_distance(a, b), sigma2), ["image_id"]), k, ["image_id"])


def feature_graph(segments: DataFrame, feature: str, sigma2: float, most: int = 20) -> DataFrame:
    """Graph of an image's segments but its background: Gaussian weights, min(most, segments - 1) neighbours."""
    s = segments.where("NOT is_background").select("image_id", F.col("seg_idx").alias("id"), F.col(feature).alias("x"))
    sim = similarity(s, lambda a, b: gaussian(squared_distance(a, b), sigma2), ["image_id"])
    return knn_graph(sim, most, ["image_id"])


def region_edges(edges: DataFrame, segments: DataFrame) -> DataFrame:
    """(image_id, src, dst) of grid edges by their ends' segments: edges join components(image_id, pix, seg_idx) twice."""
    s = segments.select("image_id", F.col("pix").alias("src"), F.col("seg_idx").alias("a"))
    d = segments.select("image_id", F.col("pix").alias("dst"), F.col("seg_idx").alias("b"))
    return edges.join(s, ["image_id", "src"]).join(d, ["image_id", "dst"]).where("a <> b").select("image_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def region_adjacency(edges: DataFrame, segments: DataFrame) -> DataFrame:
    return region_edges(edges, segments).distinct().withColumn("w", F.lit(1.0))


def border_lengths(edges: DataFrame, segments: DataFrame) -> DataFrame:
    """Grid edges across each pair of segments, both ways."""
    return mirrored(region_edges(edges, segments).groupBy("image_id", "src", "dst").agg(F.count("*").alias("n")))


def ground(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges of weight 1 from every vertex of (image_id, v) to a new one, numbered after the last."""
    top = vertices.groupBy("image_id").agg((F.max("v") + 1).alias("dst"))
    new = vertices.join(top, "image_id").select("image_id", F.col("v").alias("src"), "dst", F.lit(1.0).alias("w"))
    return edges.select("image_id", "src", "dst", "w").unionByName(new)


def degrees(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, v, degree): weights of all edges that touch a vertex, stored once."""
    keys = keys or []
    return mirrored(edges).groupBy(*keys, F.col("src").alias("v")).agg(F.sum("w").alias("degree"))


def adjacency(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    return mirrored(edges).groupBy(*keys, "src").agg(F.array_sort(F.collect_list(F.struct("dst", "w"))).alias("neighbours"))


def laplacian(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """COO (keys, i, j, v): degrees on the diagonal, -w elsewhere."""
    keys = keys or []
    off = mirrored(edges).select(*keys, F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("w")).alias("v"))
    return off.unionByName(degrees(edges, keys).select(*keys, F.col("v").alias("i"), F.col("v").alias("j"), F.col("degree").alias("v")))


def normalized_laplacian(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """COO: 1 on the diagonal, -w / sqrt(di dj) elsewhere."""
    keys = keys or []
    d = degrees(edges, keys)
    i, j = d.select(*keys, F.col("v").alias("src"), F.col("degree").alias("di")), d.select(*keys, F.col("v").alias("dst"), F.col("degree").alias("dj"))
    off = mirrored(edges).join(i, [*keys, "src"]).join(j, [*keys, "dst"]).select(*keys, F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("w") / F.sqrt(F.col("di") * F.col("dj"))).alias("v"))
    return off.unionByName(d.select(*keys, F.col("v").alias("i"), F.col("v").alias("j"), F.lit(1.0).alias("v")))


def connected_components(vertices: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v, root) of every vertex: root is the least vertex of its component; a vertex without edges is its own.

    For graphs of any size, by rounds of joins.
    """
    return vertices.select(*keys, "v").join(components(edges, keys), [*keys, "v"], "left").withColumn("root", F.coalesce("root", "v"))


def image_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The same for graphs(image_id) of at most an image's pixels: each is one task's work, and there are no rounds."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.concatenate([d["src"], d["dst"]]), return_inverse=True)
        src, dst = at[: len(d)], at[len(d) :]
        root = np.arange(len(names))
        while True:  # the least root of each edge's ends, and of what their roots point to
            low = np.minimum(root[src], root[dst])
            new = root.copy()
            np.minimum.at(new, root[src], low)
            np.minimum.at(new, root[dst], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        return pd.DataFrame({"image_id": d["image_id"].iloc[0], "v": names, "root": names[root]})

    found = edges.select("image_id", "src", "dst").groupBy("image_id").applyInPandas(run, "image_id long, v long, root long")
    return vertices.select("image_id", "v").join(found, ["image_id", "v"], "left").withColumn("root", F.coalesce("root", "v"))


def induced_subgraphs(edges: DataFrame, comps: DataFrame, keys: list[str]) -> DataFrame:
    """Edges within a component, with ends counted anew from 0 in each."""
    w = Window.partitionBy(*keys, "root").orderBy("v")
    local = comps.withColumn("n", F.row_number().over(w) - 1)
    s = local.select(*keys, F.col("v").alias("src"), "root", F.col("n").alias("s"))
    d = local.select(*keys, F.col("v").alias("dst"), F.col("root").alias("other"), F.col("n").alias("d"))
    return edges.join(s, [*keys, "src"]).join(d, [*keys, "dst"]).where("root = other").select(*keys, "root", F.col("s").alias("src"), F.col("d").alias("dst"), "w")


def remove_isolated(vertices: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v, new): vertices with an edge are counted anew from 0, the others have null."""
    ends = edges.select(*keys, F.explode(F.array("src", "dst")).alias("v")).distinct()
    w = Window.partitionBy(*keys).orderBy("v")
    return vertices.join(ends.withColumn("new", F.row_number().over(w) - 1), [*keys, "v"], "left").select(*keys, "v", "new")


def add_isolated(mapping: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v, root): parts(keys, new, root) for mapped vertices; all isolated ones are one part, of their least vertex."""
    lone = mapping.where("new IS NULL").groupBy(*keys).agg(F.min("v").alias("ground"))
    return mapping.join(parts.select(*keys, "new", "root"), [*keys, "new"], "left").join(lone, keys, "left").select(*keys, "v", F.coalesce("root", "ground").alias("root"))


def fuse_partitions(edges: DataFrame, sub: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """One partition from those of disjoint subgraphs: ends of an edge are together if subgraph and part are the same."""
    p = sub.join(parts, [*keys, "v"])
    s, d = (p.select(*keys, F.col("v").alias(e), F.struct("sub", "part").alias(f"p_{e}")) for e in ("src", "dst"))
    same = edges.join(s, [*keys, "src"]).join(d, [*keys, "dst"]).where("p_src = p_dst").select(*keys, "src", "dst")
    return connected_components(p.select(*keys, "v"), same, keys)


def combine_segmentations(edges: DataFrame, segmentations: list[DataFrame]) -> DataFrame:
    """(image_id, v, root): neighbours are together only where all segmentations (image_id, v, root) have them together."""
    e = edges.select("image_id", "src", "dst")
    for s in segmentations:
        a, b = s.select("image_id", F.col("v").alias("src"), F.col("root").alias("ra")), s.select("image_id", F.col("v").alias("dst"), F.col("root").alias("rb"))
        e = e.join(a, ["image_id", "src"]).join(b, ["image_id", "dst"]).where("ra = rb").select("image_id", "src", "dst")
    return image_components(segmentations[0].select("image_id", "v"), e)


def permute_vertices(edges: DataFrame, order: DataFrame) -> DataFrame:
    """Edges with both ends renamed by (old, new)."""
    s, d = order.select(F.col("old").alias("src"), F.col("new").alias("s")), order.select(F.col("old").alias("dst"), F.col("new").alias("d"))
    return edges.join(s, "src").join(d, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "w")


def relabel(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """A labelled graph as edges with both ends' labels, from (v, label)."""
    s, d = labels.select(F.col("v").alias("src"), F.col("label").alias("src_label")), labels.select(F.col("v").alias("dst"), F.col("label").alias("dst_label"))
    return edges.join(s, "src", "left").join(d, "dst", "left")


def breadth_first(edges: DataFrame, start: int, max_depth: int = 10_000) -> DataFrame:
    """(v, depth, position) in order of visit: by depth, the parent's position, and the order edge_no of edges.

    edges(src, dst, edge_no) are given both ways, so that a round's neighbours lie in the round before it, in itself or in
    the next: the frontier joins the edges, and the two last frontiers are taken out. Positions within a frontier are ranks
    in parts of its order and the parts' sizes. A graph deeper than max_depth raises ValueError.
    """
    spark = edges.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    frontier = cut(spark.createDataFrame([(start, 0, 0)], "v long, depth int, position long"))
    done, before, found = [frontier], None, 1
    for depth in range(1, max_depth + 1):
        near = frontier.join(edges, F.col("v") == F.col("src")).groupBy("dst").agg(F.min(F.struct("position", "edge_no")).alias("o"))
        for f in (frontier, before):
            near = near.join(f.select(F.col("v").alias("dst")), "dst", "left_anti") if f is not None else near
        dealt = cut(near.repartitionByRange(parts, "o").withColumn("part", F.spark_partition_id()))
        sizes = {r[0]: r[1] for r in dealt.groupBy("part").agg(F.count("*")).collect()}  # one row for each part
        if not sizes:
            break
        firsts, total = [], found
        for p in range(parts):
            firsts.append(total)
            total += sizes.get(p, 0)
        own = F.row_number().over(Window.partitionBy("part").orderBy("o")) - 1
        position = (own + F.array(*map(F.lit, firsts))[F.col("part")]).cast("long")
        before, frontier = frontier, cut(dealt.select(F.col("dst").cast("long").alias("v"), F.lit(depth).alias("depth"), position.alias("position")))
        found = total
        done.append(frontier)
        if len(done) == 32:
            done = [cut(reduce(DataFrame.unionByName, done))]
    else:
        raise ValueError(f"the graph is deeper than {max_depth}")
    return reduce(DataFrame.unionByName, done)


def is_maybe_planar(vertices: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """A necessary test only: edges <= 3 vertices - 6, for graphs of three vertices or more."""
    n, m = vertices.groupBy(*keys).agg(F.count("*").alias("n")), edges.groupBy(*keys).agg(F.count("*").alias("m"))
    return n.join(m, keys, "left").select(*keys, ((F.col("n") < 3) | (F.coalesce("m", F.lit(0)) <= 3 * F.col("n") - 6)).alias("maybe_planar"))


def is_symmetric(matrix: DataFrame, keys: list[str], tolerance: float = 1e-7) -> DataFrame:
    """(keys, symmetric) of matrices (keys, i, j, v): each entry is about that across the diagonal, 0 where there is none."""
    at = matrix.groupBy(*keys, F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.sum(F.when(F.col("i") < F.col("j"), F.col("v")).when(F.col("i") > F.col("j"), -F.col("v")).otherwise(0.0)).alias("gap"))
    return at.groupBy(*keys).agg((F.max(F.abs("gap")) <= tolerance).alias("symmetric"))


def without_line(matrix: DataFrame, line: Column) -> DataFrame:
    """A matrix (..., i, j, v) without a row and the column of the same number; those after it move up."""
    return matrix.where((F.col("i") != line) & (F.col("j") != line)).withColumns({c: F.when(F.col(c) > line, F.col(c) - 1).otherwise(F.col(c)) for c in ("i", "j")})
