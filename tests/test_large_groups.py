"""Kernels on groups too large for dense matrices, held against the dense ones, and on odd groups."""

import numpy as np
import pandas as pd
import pytest

from lattica.operators import kernels as K


@pytest.fixture
def sparse(monkeypatch):
    """Groups of over 20 rows count as large."""
    monkeypatch.setattr(K, "DENSE", 20)


def test_lle_of_a_large_group(sparse):
    x = np.random.default_rng(4).normal(size=(90, 10))
    got = K.lle(x, 6, 2)
    K.DENSE = 1000
    want = K.lle(x, 6, 2)
    assert np.allclose(got.T @ got / 90, np.eye(2), atol=1e-6) and np.allclose(np.abs(got), np.abs(want), atol=1e-4)


def test_lle_makes_no_matrix_of_all_pairs():
    """1,500 rows of 64 numbers: the differences of all pairs would be 1.15 GB."""
    import tracemalloc

    x = np.random.default_rng(7).normal(size=(1500, 64))
    tracemalloc.start()
    e = K.lle(x, 8, 2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200e6 and e.shape == (1500, 2) and np.allclose(e.T @ e / 1500, np.eye(2), atol=1e-6)


@pytest.mark.parametrize("rows", [np.repeat(np.random.default_rng(2).normal(size=(12, 9)), 2, axis=0), np.repeat(np.random.default_rng(2).normal(size=(3, 9)), 10, axis=0), np.random.default_rng(2).normal(size=(5, 9))])
def test_lle_of_equal_rows_and_of_few(rows):
    e = K.lle(rows, 8, 2)
    assert e.shape == (len(rows), 2) and np.isfinite(e).all()


def test_nearest_rows():
    x = np.random.default_rng(1).integers(0, 3, (70, 3)).astype(float)
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d2, np.inf)
    assert (K.nearest_rows(x, 5, 16) == np.argsort(d2, axis=1, kind="stable")[:, :5]).all()


def test_many_equal_eigenvalues_are_found():
    """Four parts without an edge between them: 0 is there four times, though two vectors are taken at a time."""
    m = np.kron(np.diag([1.0, 1.0, 1.0, 1.0]), 10 * np.eye(10) - 1)
    values, v = K.matrix_free_eigen(lambda x: m @ x, 40, 2)
    assert np.allclose(values, 0, atol=1e-8) and np.allclose(m @ v, 0, atol=1e-7) and np.allclose(v.T @ v, np.eye(2), atol=1e-9)


def ring(parts=3, each=30):
    """Dense parts, joined in a ring by one light edge each: edges one way."""
    rng = np.random.default_rng(6)
    e = [(each * p + i, each * p + j, rng.uniform(0.5, 1)) for p in range(parts) for i in range(each) for j in range(i + 1, each) if rng.random() < 0.5]
    e += [(each * p, each * ((p + 1) % parts) + 1, 0.01) for p in range(parts)]
    src, dst, w = (np.array(x) for x in zip(*e, strict=True))
    return parts * each, src, dst, w


def no_dense(*_, **__):
    raise AssertionError("a dense matrix of a large graph")


def test_pattern_vector_of_a_large_graph(sparse, monkeypatch):
    n, src, dst, w = ring()
    want = K.pattern_vector(K.dense_laplacian(n, src, dst, w), 3, n)
    monkeypatch.setattr(K, "dense_laplacian", no_dense)
    got = K.patterns_of(pd.DataFrame({"graph": 5, "src": src, "dst": dst, "w": w}), 3, 16, "graph")["pattern"][0]
    got, want = np.reshape(got, (n, 3)), np.reshape(want, (n, 3))
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-5)


@pytest.mark.parametrize("method", ["ncut_parts", "isoperimetric_parts"])
def test_partition_of_a_large_graph(sparse, method):
    n, src, dst, w = ring()
    both = n, np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([w, w])
    got = getattr(K, method)(*both, 0.2)
    assert len(set(got)) == 3 and all(len(set(got[30 * p : 30 * p + 30])) == 1 for p in range(3))


def test_partitions_take_less_than_a_matrix():
    """4,000 vertices: a matrix of weights would be 128 MB, and trying each cut by it 4,000 times that."""
    import tracemalloc

    n = 4000
    at = np.arange(n)
    src, dst = np.concatenate([at, at, at]), np.concatenate([(at + 1) % n, (at + 2) % n, (at + 7) % n])
    both = n, np.concatenate([src, dst]), np.concatenate([dst, src]), np.ones(6 * n)
    tracemalloc.start()
    got = K.isoperimetric_parts(*both, 0.1, 2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6 and len(got) == n


def test_cuts_are_those_of_every_cut_tried():
    rng = np.random.default_rng(9)
    m = np.triu(rng.random((25, 25)) * (rng.random((25, 25)) < 0.2), 1)
    m = m + m.T
    n, a, b, v = K._edges_of(m)
    order = rng.permutation(25)
    want = [m[np.ix_(order[:c], order[c:])].sum() for c in range(1, 25)]
    assert np.allclose(K._sweep(order, n, a, b, v), want)
    assert K.connected_parts(6, np.array([0, 4, 4, 5, 2]), np.array([4, 0, 5, 4, 2])).tolist() == [0, 1, 2, 3, 0, 0]


@pytest.mark.parametrize("name", ["isoperimetric_partition", "normalized_cuts", "pattern_vectors", "spectral_clusters", "spectral_embedding"])
def test_label_graphs_make_no_pairs(spark, name):
    """No row for a pair of samples: the graph is of nearest rows, found in blocks, and the same as from all pairs."""
    from lattica.plans import registry as R

    sf = "/root/testdata/sf0.001"
    df = R.QUERIES[name](spark, sf)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    if name == "pattern_vectors":
        v = R.vectors(spark, sf).select(R.F.col("label").cast("long").alias("graph"), "id", "x")
        want = R.G.knn_graph(R.G.similarity(v, lambda a, b: R.F.exp(-R.V.squared_distance(a, b)), ["graph"]), 6, ["graph"])
        key = lambda r: (r.graph, r.src, r.dst)
        a, b = sorted(R._label_graphs(spark, sf).collect(), key=key), sorted(want.collect(), key=key)
        assert list(map(key, a)) == list(map(key, b)) and np.allclose([r.w for r in a], [r.w for r in b], rtol=1e-12)


def test_patterns_of_many_graphs(spark):
    """Graphs of several sizes, cut anywhere into batches, have the patterns that each has alone; small ones go together."""
    rng = np.random.default_rng(12)
    rows, want = [], {}
    for g in range(60):
        n = int(rng.integers(4, 9))
        e = [(i, j, float(rng.random())) for i in range(n) for j in range(i + 1, n) if j == i + 1 or rng.random() < 0.4]
        rows += [(g, 7 * i + g, 7 * j + g, x) for i, j, x in e]
        src, dst, w = (np.array(x) for x in zip(*e, strict=True))
        values, vectors = K.symmetric_eigen(np.pad(K.dense_laplacian(n, src, dst, w), (0, 8 - n)), 8)
        phi = np.sqrt(np.maximum(values[8 - n + 1 : 8 - n + 3], 0)) * vectors[:, 8 - n + 1 : 8 - n + 3]
        s = np.stack([K.elementary(phi[:, j]) for j in range(2)], axis=1)
        want[g] = (np.sign(s) * np.log1p(np.abs(s))).ravel()
    df = spark.createDataFrame(rows, "graph long, src long, dst long, w double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = {r.graph: r.pattern for r in K.pattern_vectors(df, 2, 8).collect()}
        assert set(got) == set(want) and all(np.allclose(got[g], want[g], atol=1e-9) for g in want)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_pattern_classifier_moves_no_pairs_and_makes_patterns_once(spark, tmp_path):
    """However many blocks there are, patterns are not shuffled for a pair of them, and their table is made once."""
    from lattica.plans import registry as R

    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 60").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = R.QUERIES["pattern_classifier"](spark, str(tmp_path))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" not in text and "Window" not in text and "BatchScan" not in text and "embeddings.parquet" not in text
    assert sorted(r.id for r in df.collect()) == list(range(60))
