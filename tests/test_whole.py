"""Queries without SQL take in every row: held against brute force on a small table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import classify as C
from lattica.plans import registry as R
from lattica.sources import tables as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def some(spark, tmp_path_factory):
    """30 vectors with gaps between their ids, of which half are above 1000."""
    d = str(tmp_path_factory.mktemp("some"))
    v = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 30").coalesce(1)
    v.withColumn("vec_id", F.when(F.col("vec_id") < 15, F.col("vec_id") * 20).otherwise(F.col("vec_id") * 100)).write.parquet(f"{d}/embeddings.parquet")
    return d


def test_matching_classifier_compares_all(spark, some):
    px = T.vector_images(spark, some)
    seg = R.S.segment_attributes(px.drop("pix", "label"), R._segments(px), R.BGR)
    ids = T.vectors(spark, some).select("id", "label")
    every = ids.select(F.col("id").alias("i")).crossJoin(ids.select(F.col("id").alias("j"))).where("i <> j")
    want = {(r.i, r.j): r.s for r in C.image_similarity(C.one_to_one(C.segment_pairs(seg, every))).collect()}
    got = R.QUERIES["matching_classifier"](spark, some).collect()
    label = {r.id: r.label for r in ids.collect()}
    assert sorted(r.id for r in got) == sorted(label) and len(want) == 30 * 29
    for r in got:
        best = max(s for (i, _), s in want.items() if i == r.id)
        assert np.isclose(want[r.id, r.neighbour], best, atol=1e-9) and (r.label, r.predicted) == (label[r.id], label[r.neighbour])
    for block, step in ((7, 2), (256, 16)):
        assert {(r.i, r.j) for r in C.most_similar(seg, block, step).collect()} == {(r.id, r.neighbour) for r in got}


def test_match_values_are_the_engine(spark):
    x = np.random.default_rng(1).random((300, 3))
    x[:3] = [[0, 0, 0], [1, 1, 1], [0.3, 0.6, 0.3]]
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "k int, a double, b double, c double")
    want = [r.s for r in df.select("k", C.segment_similarity(F.col("a"), F.col("b"), F.col("c")).alias("s")).orderBy("k").collect()]
    assert np.allclose(C.match_values(*x.T), want, atol=2e-9)


@pytest.mark.parametrize("name", ["spectral_embedding", "spectral_clusters", "normalized_cuts", "isoperimetric_partition"])
def test_label_graphs_hold_every_sample(spark, some, name):
    want = {(r.label, r.id) for r in T.vectors(spark, some).collect()}
    several = {k for k, _ in want if sum(x == k for x, _ in want) > 1}
    got = R.QUERIES[name](spark, some).collect()
    if name == "spectral_clusters":
        assert "graph" in got[0].asDict()
    assert len(got) == len({(r.graph, r.v) for r in got}) and {(r.graph, r.v) for r in got} == {x for x in want if x[0] in several}


def test_pattern_vectors_of_whole_labels(spark, tmp_path):
    """A label of 70 vertices, 60 of them past id 999: more than the 64 asked for, so the pattern grows."""
    v = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 70").coalesce(1)
    v.withColumn("vec_id", F.col("vec_id") + 990).withColumn("label", F.lit(3)).write.parquet(f"{tmp_path}/embeddings.parquet")
    (r,) = R.QUERIES["pattern_vectors"](spark, str(tmp_path)).collect()
    m = np.zeros((70, 70))
    for x in R._label_graphs(spark, str(tmp_path)).collect():
        m[x.src - 990, x.dst - 990] = m[x.dst - 990, x.src - 990] = x.w
    values, vectors = np.linalg.eigh(np.diag(m.sum(axis=1)) - m)
    phi = [np.sqrt(values[j]) * R.K.signed(vectors[:, [j]])[:, 0] for j in range(1, 4)]
    s = np.stack([np.poly(-x)[1:] for x in phi], axis=1)
    assert np.allclose(r.pattern, (np.sign(s) * np.log1p(np.abs(s))).ravel(), atol=1e-6)


def test_k_means():
    x = np.concatenate([np.random.default_rng(k).normal(4 * k, 0.1, (20, 2)) for k in range(3)])
    c = R.K.k_means(x, 3)
    assert [len({*c[20 * k : 20 * k + 20]}) for k in range(3)] == [1, 1, 1] and len({*c}) == 3
    assert {*R.K.k_means(np.zeros((5, 2)), 3)} == {0}


def test_order_components_take_all_orders(spark, tmp_path):
    spark.createDataFrame([(1, 10), (701, 11), (50, 12), (750, 10), (699, 13)], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.v: r.root for r in R.QUERIES["order_components"](spark, str(tmp_path)).collect()}
    assert got == {10: 10, 11: 10, 12: 10, 1_000_001: 10, 1_000_050: 10, 13: 13, 1_000_699: 13}


# --- queries of kernels, against numpy on the whole of a small table ---------------------------------------------------------


@pytest.fixture(scope="module")
def samples(spark, some):
    rows = T.vectors(spark, some).orderBy("id").collect()
    return np.array([r.id for r in rows]), np.array([r.x for r in rows]), np.array([r.label for r in rows])


def matrices(x):
    a = x.reshape(len(x), 16, 4)
    return a, np.roll(a, -1, axis=0)


@pytest.mark.parametrize("name", ["canonical_angles", "procrustes_rotation", "subspace_distance"])
def test_matrix_queries(spark, some, samples, name):
    ids, x, _ = samples
    got = {int(r["name"]): np.array(r.value) for r in R.QUERIES[name](spark, some).collect()}
    assert sorted(got) == sorted(ids)
    for i, a, b in zip(ids, *matrices(x), strict=True):
        cosines = np.linalg.svd(np.linalg.qr(a)[0].T @ np.linalg.qr(b)[0], compute_uv=False)
        u, _, vt = np.linalg.svd(b.T @ a)
        want = {"canonical_angles": cosines, "procrustes_rotation": (u @ vt).ravel(), "subspace_distance": [np.sqrt(1 - cosines.min() ** 2)]}[name]
        assert np.allclose(got[i], want, atol=1e-8)


def test_lle_query(spark, some, samples):
    """The embedding's columns are eigenvectors of what the weights leave over, of unit variance."""
    ids, x, labels = samples
    got = {r.id: r.e for r in R.K.lle_embedding(T.vectors(spark, some).select(F.lit(0).cast("long").alias("grp"), "id", "x"), 8, 2).collect()}
    e = np.array([got[i] for i in ids])
    assert np.allclose(e.T @ e / len(e), np.eye(2), atol=1e-6) and np.allclose(e, R.K.lle(x, 8, 2), atol=1e-9)


def folds(ids, k):
    return [(ids % k != f, ids % k == f) for f in range(k)]


def test_normal_bayes_query(spark, some, samples):
    ids, x, labels = samples
    x = x[:, :3]
    v = T.vectors(spark, some).withColumn("x", F.slice("x", 1, 3)).withColumn("label", F.col("label") % 2)
    got = {r.id: r.predicted for r in C.cross_validated(C.Model("normal_bayes"), v, 3).collect()}
    for train, test in folds(ids, 3):
        score = []
        for c in (0, 1):
            z = x[train & (labels % 2 == c)]
            cov = np.cov(z.T, bias=True)
            cov = cov + np.eye(3) * (1e-6 * np.trace(cov) / 3 + 1e-12)
            g = x[test] - z.mean(axis=0)
            score.append(np.log(len(z) / train.sum()) - np.linalg.slogdet(cov)[1] / 2 - np.einsum("ni,ij,nj->n", g, np.linalg.inv(cov), g) / 2)
        assert [got[i] for i in ids[test]] == np.argmax(score, axis=0).tolist()


@pytest.mark.parametrize("kind", ["svm", "mlp", "knn"])
def test_models_learn(spark, kind):
    """A ring about a disc: no line parts them, a Gaussian kernel, a network or neighbours do."""
    rng = np.random.default_rng(5)
    a, r = rng.uniform(0, 2 * np.pi, 300), np.where(np.arange(300) % 2, rng.uniform(0, 0.6, 300), rng.uniform(1.0, 1.4, 300))
    rows = [(i, [float(r[i] * np.cos(a[i])), float(r[i] * np.sin(a[i]))], i % 2) for i in range(300)]
    s = spark.createDataFrame(rows, "id long, x array<double>, label int").cache()
    model = {"svm": lambda: C.Model("svm", gamma=2.0), "mlp": lambda: C.Model("mlp", layers=(8,)), "knn": lambda: C.Model("knn", k=3)}[kind]()
    held = s.where("id % 10 < 2")
    got = model.train(s.where("id % 10 >= 2")).predict(held)
    assert got.where("label = predicted").count() >= 0.95 * held.count()


def test_modulated_similarity_classifier(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(3 * (i % 2), 0.4, 2)).tolist(), i % 2) for i in range(24)]
    s = spark.createDataFrame(rows, "id long, x array<double>, label int")
    m = C.ModulatedSimilarityClassifier(dim=2).train(s.where("id < 18"))
    got = m.predict(s.where("id >= 18")).collect()
    assert len(got) == 6 and all(r.label == r.predicted for r in got)
    with pytest.raises(ValueError):
        C.ModulatedSimilarityClassifier(most=3).train(s)


def test_palette_projection_classifier(spark, some):
    """Every image has an answer, from another image of the training set, by the matching of images with projected palettes."""
    px = T.vector_images(spark, some)
    seg, labels = R._segments(px), T.vectors(spark, some).select("id", "label")
    m = C.PaletteProjectionClassifier(R.BGR, bins=2, ranges=R.UNIT).train(px, seg, labels)
    x = m._palettes(px)
    assert m.projection.shape == (24, 24) and x.count() == 30 and all(len(r.x) == 24 for r in x.collect())
    new = m._rewritten(px).where("mask > 0").select("image_id", *R.BGR).distinct().groupBy("image_id").count()
    assert max(r["count"] for r in new.collect()) <= 8
    got = m.predict(px, seg).collect()
    label = {r.id: r.label for r in labels.collect()}
    assert len(got) == 30 and all(r.neighbour != r.id and r.predicted == label[r.neighbour] for r in got)


def test_segment_is_its_parts(spark, some):
    """The whole pipeline on one image, step by step: Felzenszwalb's sets, then the tenth of pairs with the least hue gap."""
    px = T.vector_images(spark, some)
    got = {(r.image_id, r.pix): r.root for r in R.S.segment(px, R.BGR, 0.5, 16).collect()}
    assert len(got) == 30 * 64
    p = px.where("image_id = 20").toPandas().sort_values("pix")
    e = R.G.grid_graph(px.where("image_id = 20"), 4, R.V.euclidean, R.BGR).toPandas().sort_values("edge_no")
    f = R.K.felzenszwalb_sets(64, list(zip(e.src, e.dst, e.w, strict=True)), 0.5, int((p["mask"] != 0).sum()) // 16, p["mask"].to_numpy())
    root = np.array([min(j for j in range(64) if f.find(j) == f.find(i)) for i in range(64)])
    names = sorted(set(root))
    hue = []
    for n in names:
        own = p[(root == n)]
        kept = own[own["mask"] > 0]
        c = kept[["red", "g", "b"]].to_numpy()
        top, gap = c.max(axis=1, initial=0), c.max(axis=1, initial=0) - c.min(axis=1, initial=9)
        h = [(60 * (y - z) / d) % 360 if m == x else 120 + 60 * (z - x) / d if m == y else 240 + 60 * (x - y) / d for (x, y, z), m, d in zip(c, top, gap, strict=True)]
        hue.append(sum(h) / len(own))
    pairs = sorted((round(abs(hue[i] - hue[j]), 9), i, j) for i in range(1, len(names)) for j in range(i + 1, len(names)))
    into = list(range(len(names)))
    for _, i, j in pairs[: len(pairs) // 10]:
        a, b = into[i], into[j]
        into = [min(a, b) if k in (a, b) else k for k in into]
    first = {n: names[into[k]] for k, n in enumerate(names)}
    assert [got[20, i] for i in range(64)] == [first[r] for r in root]


def test_manual_segmentation(spark):
    """Two colours, one of them in two places; a part of one pixel joins a neighbour; what the mask leaves out is one part."""
    rows = ["aab", "aac", "xxa"]
    px = spark.createDataFrame([(1, r, c, 3, 3, ord(v), 0.0 if v == "x" else 1.0) for r, line in enumerate(rows) for c, v in enumerate(line)], "image_id long, r int, c int, height int, width int, k int, mask double")
    got = {r.pix: r.root for r in R.S.manual_segmentation(px, ["k"], 2).collect()}
    # a (with the far one) is 0, 1, 3, 4, 8; b (2) and c (5) are too small: in edge order 1-2 joins b to a, then 2-5 joins c.
    assert got == {0: 0, 1: 0, 3: 0, 4: 0, 8: 0, 2: 0, 5: 0, 6: 9, 7: 9}


def test_preprocess_is_its_parts(spark, some):
    px = T.vector_images(spark, some).drop("pix", "v", "label")
    want = px.transform(R.P.resize, 20).transform(R.P.largest_component).transform(R.P.kuwahara, 2).transform(R.P.to_lab, 1.0)
    key = lambda r: (r.image_id, r.r, r.c)
    a, b = (sorted(df.collect(), key=key) for df in (R.QUERIES["preprocess"](spark, some), want))
    assert len(a) == len(b) > 0 and all(key(x) == key(y) and np.isclose([x.l, x.a, x.bb], [y.l, y.a, y.bb]).all() for x, y in zip(a, b, strict=True))


def test_blocks_of_pairs(spark):
    """Pairs, moments and nearest rows are the same whatever the blocks, with ties and equal vectors."""
    from lattica.operators import neighbours as N

    rng = np.random.default_rng(8)
    x = rng.integers(0, 3, (60, 4)).astype(float)
    s = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, x array<double>, label int").cache()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    near = {(i, j) for i in range(60) for j in range(i + 1, 60) if d[i, j] <= 1.5}
    want = [(i, int(j)) for i in range(60) for j in sorted((j for j in range(60) if j != i), key=lambda j: (d[i, j], j))[:4]]
    for block in (7, 1000):
        assert {(r.i, r.j) for r in N.distances(s, 1.5, block).collect()} == near and N.distances(s, None, block).count() == 60 * 59 // 2
        m = N.moments(s, block).first()
        assert m.n == 1770 and np.isclose(m.d, d.sum() / 2) and np.isclose(m.d2, (d * d).sum() / 2)
        assert sorted((r.id, r.other) for r in N.nearest(s, s, 4, leave_one_out=True, block=block).collect()) == sorted(want)
    empty = s.where("false")
    assert N.distances(empty).count() == 0 and N.nearest(s, empty, 2).count() == 0
