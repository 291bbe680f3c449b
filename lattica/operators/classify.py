"""Similarities between samples and images, classifiers and their evaluation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import fuzzy
from lattica.functions.vectors import euclidean
from lattica.operators import segments
from lattica.operators.kernels import palette_projection
from lattica.operators.neighbours import gaussian, moments, nearest, squared
from lattica.plans.stored import table


def gaussian_similarity(samples: DataFrame, sigma2: float, digits: int | None = None) -> DataFrame:
    """sim(i, j, s) for i < j: exp(-d^2 / sigma^2), rounded to digits if given."""
    return gaussian(samples, sigma2, digits)


def modulated(sim: DataFrame, labels: DataFrame, same: float = 10.0, other: float = 0.1) -> DataFrame:
    """Similarities of labelled pairs times `same` or `other`; a negative or missing label leaves a pair as it is."""
    a, b = labels.select(F.col("id").alias("i"), F.col("label").alias("li")), labels.select(F.col("id").alias("j"), F.col("label").alias("lj"))
    s = sim.join(a, "i", "left").join(b, "j", "left")
    known = (F.col("li") >= 0) & (F.col("lj") >= 0)
    return s.select("i", "j", F.when(known & (F.col("li") == F.col("lj")), F.col("s") * same).when(known, F.col("s") * other).otherwise(F.col("s")).alias("s"))


def distance_variance(samples: DataFrame) -> DataFrame:
    """One row: variance of all pairs' distances, E[d^2] - E[d]^2."""
    mean = F.col("d") / F.col("n")
    return moments(samples).select((F.col("d2") / F.col("n") - mean * mean).alias("variance"), "n")


def row_normalized(sim: DataFrame) -> DataFrame:
    """s over its row's sum, 0 where that is below 1e-4."""
    d = F.sum("s").over(Window.partitionBy("i"))
    return sim.withColumn("d", d).select("i", "j", F.when(F.col("d") < 1e-4, 0.0).otherwise(F.col("s") / F.col("d")).alias("s"))


def knn_predict(train: DataFrame, test: DataFrame, k: int = 1, *, leave_one_out: bool = False) -> DataFrame:
    """(id, label, predicted, neighbour): the commonest label of the k nearest (ties: the smaller label), and the nearest."""
    n = nearest(train, test, k, leave_one_out=leave_one_out)
    votes = n.groupBy("id", "label", "other_label").agg(F.count("*").alias("c"))
    win = votes.groupBy("id", "label").agg(F.min_by("other_label", F.struct(-F.col("c"), "other_label")).alias("predicted"))
    return win.join(n.where("rank = 1").select("id", F.col("other").alias("neighbour")), "id")


def leave_one_out(samples: DataFrame, k: int = 1) -> DataFrame:
    return knn_predict(samples, samples, k, leave_one_out=True)


def recognition_rate(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("rate"))


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    """(expected, actual, n) with zeros, for all labels that occur."""
    got = predictions.groupBy(F.col("label").alias("expected"), F.col("predicted").alias("actual")).agg(F.count("*").alias("n"))
    names = got.select(F.explode(F.array("expected", "actual")).alias("x")).distinct()
    # Labels are classes: a few, whose pairs are the matrix asked for.
    full = names.select(F.col("x").alias("expected")).crossJoin(names.select(F.col("x").alias("actual")))
    return full.join(got, ["expected", "actual"], "left").fillna(0, ["n"])


def misclassified(predictions: DataFrame) -> DataFrame:
    return predictions.where("predicted <> label").select("id", "label", "predicted", "neighbour")


# --- matching of segments: bodies are ours, as the surveyed ones are absent ---------------------------------------------


def match_engine() -> fuzzy.Engine:
    """Our rules: segments are alike where colour, place and area are all near, and unlike where one is far."""
    near, far = fuzzy.z_shape(0.0, 0.6), fuzzy.s_shape(0.3, 1.0)
    terms = {"near": near, "far": far}
    rules = ["if color is near and place is near and area is near then match is high", "if color is far or place is far then match is low", "if area is very far then match is low with 0.5"]
    return fuzzy.Engine({"color": terms, "place": terms, "area": terms}, ("match", {"low": fuzzy.ramp(0.6, 0.0), "high": fuzzy.ramp(0.4, 1.0)}, 0.0, 1.0), rules, default=0.0)


def segment_similarity(colour: Column, place: Column, area: Column) -> Column:
    """From distances in 0 to 1."""
    return match_engine().process({"color": colour, "place": place, "area": area}, n=20)


def segment_pairs(segments: DataFrame, image_pairs: DataFrame) -> DataFrame:
    """(i, j, a, b, s, size): similarity of segment a of image i and b of image j, background left out.

    segments(image_id, seg_idx, area, color, center, is_background), areas and colours in fractions of the image and of 1.
    """
    total = F.sum("area").over(Window.partitionBy("image_id"))
    s = segments.withColumn("part", F.col("area") / total).where("NOT is_background")
    a = s.select(F.col("image_id").alias("i"), F.col("seg_idx").alias("a"), F.struct("part", "color", "center", "area").alias("x"))
    b = s.select(F.col("image_id").alias("j"), F.col("seg_idx").alias("b"), F.struct("part", "color", "center", "area").alias("y"))
    p = image_pairs.join(a, "i").join(b, "j")
    unit = lambda d: F.least(F.lit(1.0), d)
    values = {"color": unit(euclidean(F.col("x.color"), F.col("y.color"))), "place": unit(euclidean(F.col("x.center"), F.col("y.center"))), "area": unit(F.abs(F.col("x.part") - F.col("y.part")))}
    p = p.select("i", "j", "a", "b", F.col("x.area").alias("size"), *(v.alias(n) for n, v in values.items()))
    engine = match_engine()
    levels = engine.levels({n: F.col(n) for n in values})
    p = p.select("i", "j", "a", "b", "size", *(v.alias(f"l{k}") for k, v in enumerate(levels)))
    s_ = engine.conclude([F.col(f"l{k}") for k in range(len(levels))], n=20)
    return p.select("i", "j", "a", "b", F.round(s_, 9).alias("s"), "size")


def one_to_one(similar: DataFrame) -> DataFrame:
    """(i, j, a, b, s, size): greedy matching of each image pair by falling similarity; every segment is used once."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        left, right, keep = set(), set(), []
        for r in d.sort_values(["s", "a", "b"], ascending=[False, True, True]).itertuples():
            if r.a not in left and r.b not in right:
                left.add(r.a)
                right.add(r.b)
                keep.append(r.Index)
        return d.loc[keep]

    return similar.groupBy("i", "j").applyInPandas(run, similar.schema)


def image_similarity(matches: DataFrame) -> DataFrame:
    """sim(i, j, s): mean similarity of matched segments, weighted by their sizes."""
    return matches.groupBy("i", "j").agg((F.sum(F.col("s") * F.col("size")) / F.sum("size")).alias("s"))


def predict_by_similarity(sim: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label, predicted, neighbour): the class of the most similar other image (ties: the smaller id)."""
    best = sim.where("i <> j").groupBy("i").agg(F.min_by("j", F.struct(-F.col("s"), "j")).alias("neighbour"))
    own, other = labels.select(F.col("id").alias("i"), "label"), labels.select(F.col("id").alias("neighbour"), F.col("label").alias("predicted"))
    return best.join(own, "i").join(other, "neighbour").select(F.col("i").alias("id"), "label", "predicted", "neighbour")


def _s_shape(x: np.ndarray, a: float, b: float) -> np.ndarray:
    return np.select([x <= a, x <= (a + b) / 2, x < b], [0.0, 2 * ((x - a) / (b - a)) ** 2, 1 - 2 * ((x - b) / (b - a)) ** 2], 1.0)


def match_values(colour: np.ndarray, place: np.ndarray, area: np.ndarray, n: int = 20) -> np.ndarray:
    """segment_similarity on arrays, to nine digits: the rules of match_engine, written out."""
    near, far = (lambda x: 1 - _s_shape(x, 0.0, 0.6)), (lambda x: _s_shape(x, 0.3, 1.0))
    high = np.minimum(np.minimum(near(colour), near(place)), near(area))
    low = np.maximum(np.maximum(far(colour), far(place)), far(area) ** 2 * 0.5)
    return _concluded(high, low, n)


def _concluded(high: np.ndarray, low: np.ndarray, n: int = 20) -> np.ndarray:
    weight, moment = np.zeros_like(high), np.zeros_like(high)
    for i in range(n):
        v = (i + 0.5) / n
        t = np.maximum(np.minimum(min(1.0, max(0.0, (v - 0.4) / (1.0 - 0.4))), high), np.minimum(min(1.0, max(0.0, (v - 0.6) / (0.0 - 0.6))), low))
        weight += t
        moment += v * t
    return np.round(np.divide(moment, weight, out=np.zeros_like(weight), where=weight > 0), 9)


#: Steps of squared distance up to FAR_OFF, where nothing is near, and the share that a bound allows for in single precision.
BOUND_STEPS, FAR_OFF, MARGIN = 4096, 0.36, 1e-5


def match_bounds() -> np.ndarray:
    """The most that match_values gives from each step of the greatest of the three squared distances on.

    "High" is as near as the farthest of the three; "low" only adds weight below 0.6, and without it the value is above
    that and grows with "high". The last entry is for all that is farther off.
    """
    high = 1 - _s_shape(np.sqrt(np.arange(BOUND_STEPS + 1) * (FAR_OFF / BOUND_STEPS)), 0.0, 0.6)
    high = np.maximum(high, 1e-6)  # at 0 there is nothing but "low": less than what is hardly "high"
    return np.maximum.accumulate(_concluded(high, np.zeros_like(high))[::-1])[::-1] + 1e-8


def matched_similarity(s: np.ndarray, size: np.ndarray) -> np.ndarray:
    """one_to_one and image_similarity of s[i, j, a, b] (below 0 where a or b is no segment) with size[i, a]."""
    n, m, a, b = s.shape
    s, i = s.reshape(n * m, a, b).copy(), np.arange(n * m)
    total, weight = np.zeros(n * m), np.zeros(n * m)
    for _ in range(min(a, b)):
        at = s.reshape(n * m, a * b).argmax(axis=1)  # the first of equal ones: the least a, then b
        x, y = at // b, at % b
        best = s[i, x, y]
        part = np.where(best >= 0, size[i // m, x], 0)
        total += np.maximum(best, 0) * part
        weight += part
        s[i, x, :] = -1
        s[i, :, y] = -1
    return np.divide(total, weight, out=np.full(n * m, -1.0), where=weight > 0).reshape(n, m)


def most_similar(segments: DataFrame, block: int = 256, step: int = 16, others: DataFrame | None = None, first_lot: int = 4) -> DataFrame:
    """sim(i, j, s): for each image the most similar of all others (ties: the smaller id), by matched segments.

    others: segments of the images to be compared with, if not these; an image of the same id is left out there too.

    Images are dealt into blocks of about `block`; each pair of blocks is one task's work, `step` images at a time, of
    which only the best for each image leaves. Images are matched, the `first_lot` likeliest of a block first, unless a bound
    is below the best of those. An image of background alone has no segments to match, and no row.
    """
    def parted(segments: DataFrame) -> DataFrame:
        total = F.sum("area").over(Window.partitionBy("image_id"))
        s = segments.withColumn("part", F.col("area") / total).where("NOT is_background")
        return s.select(F.col("image_id").alias("id"), "seg_idx", "area", "part", "color", "center")

    # Stored, as they are counted and dealt out twice: else images would be segmented three times.
    s = table(parted(segments), "parted-segments")
    t = s if others is None else table(parted(others), "parted-segments")
    n = max(1, -(-s.select("id").distinct().count() // block))
    m = n if others is None else max(1, -(-t.select("id").distinct().count() // block))
    deal, every = (lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")), (lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    one, two = s.withColumn("p", deal(n)).withColumn("q", every(m)), t.toDF(*t.columns).withColumn("q", deal(m)).withColumn("p", every(n))

    def images(d: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        d = d.sort_values(["id", "seg_idx"])
        ids, first, count = np.unique(d["id"].to_numpy(), return_index=True, return_counts=True)
        place = np.arange(count.max())
        rows = np.where(place < count[:, None], first[:, None] + place, -1)  # -1: no segment
        return ids, [np.stack(d["color"].to_numpy()), np.stack(d["center"].to_numpy()), d["part"].to_numpy()[:, None], d["area"].to_numpy(float)], rows

    bounds = match_bounds().astype(np.float32) + np.float32(1e-6)

    def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.minimum(1.0, np.sqrt(sum((x[:, :, None, k] - y[:, None, :, k]) ** 2 for k in range(x.shape[2]))))

    def bound(x: list[np.ndarray], y: list[np.ndarray], first: np.ndarray, columns: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For some images and all of a block, no less than their similarity: each segment with the most alike, used or not."""
        far = np.zeros((len(x[0]), len(y[0])), np.float32)
        for u, v in zip(x, y, strict=True):
            d, p, q = u @ v.T, (u * u).sum(axis=1), (v * v).sum(axis=1)
            d *= -2
            d += p[:, None]
            d += q - np.float32(MARGIN) * (1 + p.max() + q.max())  # what is lost grows with what is subtracted
            np.maximum(far, d, out=far)
        far *= np.float32(BOUND_STEPS / FAR_OFF)
        best = np.maximum.reduceat(bounds[np.clip(far, 0, BOUND_STEPS, out=far).astype(np.int32)], columns[:, 0], axis=1)
        whole = np.add.reduceat(size[:, None] * best, first, axis=0) / np.add.reduceat(size, first)[:, None]
        # With fewer segments than the image has, some of its own are left out, and any may be.
        enough = (columns >= 0).sum(axis=1) >= np.diff(np.append(first, len(size)))[:, None]
        return np.where(enough, whole, np.maximum.reduceat(best, first, axis=0))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"i": np.zeros(0, np.int64), "j": np.zeros(0, np.int64), "s": np.zeros(0)})
        (ids, x, rows), (others, y, columns), out = images(a), images(b), []
        x32, y32 = ([v.astype(np.float32) for v in z[:3]] for z in (x, y))
        for k in range(0, len(ids), step):
            r = rows[k : k + step]
            low, high = r[0, 0], r.max() + 1
            most = bound([u[low:high] for u in x32], y32, r[:, 0] - low, columns, x[3][low:high])
            most[ids[k : k + step, None] == others[None]] = -1
            sim = np.full(most.shape, -1.0)

            def score(i: np.ndarray, j: np.ndarray, r=r, sim=sim) -> None:
                for c in range(0, len(i), 4096):
                    p, q = r[i[c : c + 4096]], columns[j[c : c + 4096]]
                    values = match_values(*(distance(u[p], v[q]) for u, v in zip(x[:3], y[:3], strict=True)))
                    values[(p[:, :, None] < 0) | (q[:, None, :] < 0)] = -1.0
                    sim[i[c : c + 4096], j[c : c + 4096]] = matched_similarity(values[:, None], x[3][p])[:, 0]

            # The likeliest first; then all those whose bound is not below the best of them, or ties would be lost.
            top = np.argpartition(-most, min(first_lot, most.shape[1]) - 1, axis=1)[:, :first_lot]
            i, j = np.repeat(np.arange(len(r)), top.shape[1]), top.ravel()
            score(i[most[i, j] >= 0], j[most[i, j] >= 0])
            score(*np.nonzero((most >= np.maximum(sim.max(axis=1), 0)[:, None]) & (sim < 0)))
            best = sim.argmax(axis=1)
            out += [(i, others[j], z[j]) for i, j, z in zip(ids[k : k + step], best, sim, strict=True) if z[j] >= 0]
        return pd.DataFrame(out, columns=["i", "j", "s"])

    found = one.groupBy("p", "q").cogroup(two.groupBy("p", "q")).applyInPandas(search, "i long, j long, s double")
    return found.groupBy("i").agg(F.min_by(F.struct("j", "s"), F.struct(-F.col("s"), "j")).alias("m")).select("i", "m.j", "m.s")


def matching_classifier(segments: DataFrame, labels: DataFrame) -> DataFrame:
    """Segment-matching nearest neighbour, leaving one out: each image against all others."""
    return predict_by_similarity(most_similar(segments), labels)


# --- other classifiers --------------------------------------------------------------------------------------------------


def modulated_similarity_predict(s: np.ndarray, labels: np.ndarray, test: np.ndarray, dim: int, same: float = 10.0, other: float = 0.1) -> int:
    """The label of the sample nearest to a test sample in the embedding of the modulated similarities with its row added.

    s: similarities of the labelled samples (label < 0: none); test: similarities of the new sample to them.
    """
    known = (labels[:, None] >= 0) & (labels[None, :] >= 0)
    m = np.where(known, np.where(labels[:, None] == labels[None, :], s * same, s * other), s)
    np.fill_diagonal(m, np.diag(s))
    full = np.block([[m, test[:, None]], [test[None, :], np.ones((1, 1))]])
    d = full.sum(axis=1, keepdims=True)
    values, vectors = np.linalg.eig(np.where(d < 1e-4, 0, full / np.where(d < 1e-4, 1, d)))
    e = vectors[:, np.argsort(-values.real, kind="stable")[1 : dim + 1]].real
    return int(labels[np.argmin(((e[:-1] - e[-1]) ** 2).sum(axis=1))])


def pattern_classifier(patterns: list[DataFrame], labels: DataFrame) -> DataFrame:
    """Nearest neighbour over each image's patterns (graph, pattern), joined feature after feature."""
    first, *rest = patterns
    x = first.select(F.col("graph").alias("id"), F.col("pattern").alias("x"))
    for p in rest:
        x = x.join(p.select(F.col("graph").alias("id"), F.col("pattern").alias("more")), "id").select("id", F.concat("x", "more").alias("x"))
    return leave_one_out(table(x.join(labels, "id"), "patterns"))  # made once, however often it is read


class ModulatedSimilarityClassifier:
    """Nearest neighbour in an embedding of Gaussian similarities, raised within classes and lowered between them.

    The training samples (id, x, label; label < 0 or null: not known) are kept whole, as each prediction solves a dense
    eigenproblem of their number: ValueError beyond `most`.
    """

    def __init__(self, dim: int = 2, sigma2: float = 1.0, same: float = 10.0, other: float = 0.1, most: int = 2000) -> None:
        self.dim, self.sigma2, self.same, self.other, self.most = dim, sigma2, same, other, most
        self.x = self.labels = None

    def train(self, samples: DataFrame) -> ModulatedSimilarityClassifier:
        rows = samples.select("id", "x", F.coalesce("label", F.lit(-1)).alias("label")).orderBy("id").limit(self.most + 1).collect()
        if len(rows) > self.most:
            raise ValueError(f"more than {self.most} training samples")
        self.x, self.labels = np.array([r.x for r in rows], float), np.array([r.label for r in rows])
        return self

    def predict(self, samples: DataFrame) -> DataFrame:
        """(id, label, predicted)."""
        x, labels, sigma2, dim, same, other = self.x, self.labels, self.sigma2, self.dim, self.same, self.other

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s = np.exp(-squared(x, x) / sigma2)
            for d in it:
                near = np.exp(-squared(np.stack(d["x"].to_numpy()).astype(float), x) / sigma2) if len(d) else []
                yield pd.DataFrame({"id": d["id"], "label": d["label"], "predicted": [modulated_similarity_predict(s, labels, t, dim, same, other) for t in near]}).astype({"predicted": "int32"})

        return samples.select("id", "x", "label").mapInPandas(run, "id long, label int, predicted int")


class PaletteProjectionClassifier:
    """Images by their palettes, projected so that palettes of a class are near: then each image's kept pixels take their
    bin's projected colour, and the new images are matched by segments.

    train() and predict() take pixels with channels, segments(image_id, pix, seg_idx) and labels(id, label; null: not known).
    A palette holds the colours of an image's histogram bins, in rising order of count; its length is three times the number
    of bins, and the projection has as many rows and columns.
    """

    def __init__(self, channels: list[str], bins: int = 5, ranges=None, same: float = 10.0, other: float = 0.1, most: int = 2000) -> None:
        self.channels, self.bins, self.same, self.other, self.most = channels, bins, same, other, most
        self.ranges = ranges or segments.LAB_RANGES
        self.projection = self.images = None

    def _palettes(self, pixels: DataFrame) -> DataFrame:
        """(image_id, x, bins): the palette, and the bin that each of its colours is of."""
        hist = segments.full_histogram(segments.color_histogram(pixels, self.channels, self.bins, self.ranges), self.bins)
        edge = [r[0] + F.col(f"b{i}") * (r[1] - r[0]) / self.bins for i, r in enumerate(self.ranges)]
        rows = hist.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("n", "b0", "b1", "b2", F.array(*edge).alias("p")))).alias("all"))  # all bins
        return rows.select("image_id", F.flatten(F.transform("all", lambda a: a["p"])).alias("x"), F.transform("all", lambda a: F.struct(a["b0"].alias("b0"), a["b1"].alias("b1"), a["b2"].alias("b2"))).alias("bins"))

    def _rewritten(self, pixels: DataFrame) -> DataFrame:
        m = self.projection
        project = F.pandas_udf(lambda x: pd.Series([(m @ np.asarray(v, float)).tolist() for v in x]), "array<double>")
        p = self._palettes(pixels).select("image_id", "bins", project("x").alias("y"))
        each = p.select("image_id", "y", F.posexplode("bins").alias("k", "bin"))
        colours = each.select("image_id", *(F.col(f"bin.b{i}").alias(f"_b{i}") for i in range(3)), *(F.element_at("y", 3 * F.col("k") + i + 1).alias(f"_c{i}") for i in range(3)))
        own = {f"_b{i}": segments.bin_of(F.col(c), *r, self.bins) for i, (c, r) in enumerate(zip(self.channels, self.ranges, strict=True))}
        out = pixels.withColumns(own).join(colours, ["image_id", *own], "left")
        return out.withColumns({c: F.when(F.col("mask") > 0, F.coalesce(f"_c{i}", F.lit(0.0))).otherwise(0.0) for i, c in enumerate(self.channels)}).drop(*own, "_c0", "_c1", "_c2")

    def _attributes(self, pixels: DataFrame, segs: DataFrame) -> DataFrame:
        return segments.segment_attributes(self._rewritten(pixels).drop("pix", "label"), segs.select("image_id", "pix", "seg_idx"), self.channels)

    def train(self, pixels: DataFrame, segs: DataFrame, labels: DataFrame) -> PaletteProjectionClassifier:
        rows = self._palettes(pixels).join(labels.select(F.col("id").alias("image_id"), "label"), "image_id", "left").select("image_id", "x", F.coalesce("label", F.lit(-1)).alias("label")).orderBy("image_id").limit(self.most + 1).collect()
        if len(rows) > self.most:
            raise ValueError(f"more than {self.most} training images")
        x, y = np.array([r.x for r in rows], float), np.array([r.label for r in rows])
        d2 = squared(x, x)
        i, j = np.triu_indices(len(x), 1)
        d = np.sqrt(d2[i, j])
        pairs = len(x) * (len(x) + 1) / 2
        sigma2 = max((d * d).sum() / pairs - (d.sum() / pairs) ** 2, 1e-12)
        known = (y[:, None] >= 0) & (y[None, :] >= 0)
        s = np.exp(-d2 / sigma2) * np.where(known, np.where(y[:, None] == y[None, :], self.same, self.other), 1.0)
        np.fill_diagonal(s, 0.0)
        self.projection = palette_projection(x.T, s, x.shape[1]).T
        self.images, self.labels = self._attributes(pixels, segs), labels
        return self

    def predict(self, pixels: DataFrame, segs: DataFrame) -> DataFrame:
        """(id, predicted, neighbour): the class of the most similar training image, by segment matching; an image is not
        matched with the training image of its own id."""
        best = most_similar(self._attributes(pixels, segs), others=self.images)
        other = self.labels.select(F.col("id").alias("neighbour"), F.col("label").alias("predicted"))
        return best.select(F.col("i").alias("id"), F.col("j").alias("neighbour")).join(other, "neighbour").select("id", "predicted", "neighbour")


class NormalBayes:
    """Gaussian classes with full covariances (a ridge keeps them regular): sums of rows and of their products, by partial
    sums of a partition; what is kept grows with classes and the square of the features only."""

    def __init__(self, ridge: float = 1e-6) -> None:
        self.ridge = ridge

    def fit(self, samples: DataFrame) -> NormalBayes:
        def sums(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[int, list] = {}
            for d in it:
                for label, g in d.groupby("label"):
                    x = np.stack(g["x"].to_numpy()).astype(float)
                    t = total.setdefault(int(label), [0, 0.0, 0.0])
                    t[0], t[1], t[2] = t[0] + len(x), t[1] + x.sum(axis=0), t[2] + x.T @ x
            yield pd.DataFrame([(k, n, s.tolist(), m.ravel().tolist()) for k, (n, s, m) in total.items()], columns=["label", "n", "s", "m"])

        parts = samples.where("label IS NOT NULL").select("x", "label").mapInPandas(sums, "label int, n long, s array<double>, m array<double>")
        add = lambda c: F.array_agg(c)
        rows = parts.groupBy("label").agg(F.sum("n").alias("n"), add("s").alias("s"), add("m").alias("m")).orderBy("label").collect()  # a row for each class and partition
        total = sum(r.n for r in rows)
        self.classes = []
        for r in rows:
            mean = np.sum(r.s, axis=0) / r.n
            cov = np.sum(r.m, axis=0).reshape(len(mean), -1) / r.n - np.outer(mean, mean)
            cov += np.eye(len(mean)) * (self.ridge * max(float(np.trace(cov)) / len(mean), 1e-12) + 1e-12)
            self.classes.append((r.label, mean, np.linalg.inv(cov), float(np.log(r.n / total) - np.linalg.slogdet(cov)[1] / 2)))
        return self

    def predict(self, samples: DataFrame) -> DataFrame:
        classes = self.classes

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for d in it:
                x = np.stack(d["x"].to_numpy()).astype(float) if len(d) else np.zeros((0, 1))
                scores = [c - np.einsum("ni,ij,nj->n", x - m, p, x - m) / 2 if len(d) else np.zeros(0) for _, m, p, c in classes]
                yield pd.DataFrame({"id": d["id"], "label": d["label"], "predicted": np.array([k for k, *_ in classes], np.int32)[np.argmax(scores, axis=0)] if len(d) else np.zeros(0, np.int32)})

        return samples.select("id", "x", "label").mapInPandas(run, "id long, label int, predicted int")


class Model:
    """Train, predict and clear, over samples(id, x, label), for classifiers of several kinds.

    kind: 'normal_bayes' (full covariances), 'bayes' (Gaussian with a diagonal covariance), 'knn', 'mlp' (layers between
    input and output) or 'svm' (one class against the rest; with gamma a Gaussian kernel exp(-gamma d^2), by `waves` random
    Fourier features, else linear).
    """

    def __init__(self, kind: str, *, k: int = 1, layers: tuple[int, ...] = (16,), gamma: float | None = None, waves: int = 256, seed: int = 1) -> None:
        if kind not in ("normal_bayes", "bayes", "knn", "mlp", "svm"):
            raise ValueError(kind)
        self.kind, self.k, self.layers, self.gamma, self.waves, self.seed = kind, k, layers, gamma, waves, seed
        self.clear()

    def clear(self) -> None:
        self.model = self.samples = None

    def _features(self, samples: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        x = F.col("x")
        if self.kind == "svm" and self.gamma:
            gamma, waves, seed = self.gamma, self.waves, self.seed

            @F.pandas_udf("array<double>")
            def lifted(v: pd.Series) -> pd.Series:
                if not len(v):
                    return pd.Series([], dtype=object)
                m = np.stack(v.to_numpy()).astype(float)
                rng = np.random.default_rng(seed)
                w, b = rng.standard_normal((m.shape[1], waves)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, waves)
                return pd.Series(list(np.sqrt(2 / waves) * np.cos(m @ w + b)))

            x = lifted("x")
        return samples.select("id", array_to_vector(x).alias("features"), F.col("label").cast("double").alias("label"))

    def train(self, samples: DataFrame) -> Model:
        from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest

        if self.kind == "knn":
            self.samples = samples
            return self
        if self.kind == "normal_bayes":
            self.model = NormalBayes().fit(samples)
            return self
        if self.kind == "mlp":
            inputs, classes = samples.agg(F.max(F.size("x")), F.max("label") + 1).first()
            learner = MultilayerPerceptronClassifier(layers=[int(inputs), *self.layers, int(classes)], seed=self.seed)
        else:
            learner = NaiveBayes(modelType="gaussian") if self.kind == "bayes" else OneVsRest(classifier=LinearSVC(maxIter=20))
        self.model = learner.fit(self._features(samples))
        return self

    def predict(self, samples: DataFrame) -> DataFrame:
        if self.kind == "knn":
            return knn_predict(self.samples, samples, self.k).select("id", "label", "predicted")
        if self.kind == "normal_bayes":
            return self.model.predict(samples)
        return self.model.transform(self._features(samples)).select("id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"))


def fold_of(folds: int) -> Column:
    return F.pmod(F.col("id"), F.lit(folds)).cast("int")


def cross_validated(model: Model, samples: DataFrame, folds: int = 5) -> DataFrame:
    """(id, label, predicted) of every sample, by the model trained on the other folds; as many folds as samples, with ids
    from 0 on, leave one out."""
    parts = []
    for k in range(folds):
        model.clear()
        parts.append(model.train(samples.where(fold_of(folds) != k)).predict(samples.where(fold_of(folds) == k)))
    return reduce(DataFrame.unionByName, parts)


def max_label(samples: DataFrame) -> DataFrame:
    return samples.agg(F.max("label").alias("max_label"))
