"""Queries on all pairs of samples store and move what grows with the samples, not with the pairs, and keep every pair."""

import os
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import neighbours as N
from lattica.plans import registry as R

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    """300 vectors in several blocks, of which three are equal."""
    d = str(tmp_path_factory.mktemp("few"))
    v = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 300").coalesce(1)
    same = v.where("vec_id = 7").select(F.explode(F.expr("array(1000L, 2000L)")).alias("vec_id"), "embedding", "label")
    v.unionByName(same).coalesce(1).write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="module")
def samples(spark, few):
    rows = spark.read.parquet(f"{few}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    return np.array([r.vec_id for r in rows]), d, np.array([r.label for r in rows])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pairs_equal(got, ids, want, name):
    """Every pair i < j once, with what want[i, j] has."""
    at = {v: k for k, v in enumerate(ids.tolist())}
    rows = {(r[0], r[1]): r[name] for r in got.collect()}
    every = {(a, b) for a in at for b in at if a < b}
    assert set(rows) == every and got.count() == len(every)
    assert np.allclose([rows[a, b] for a, b in sorted(every)], [want[at[a], at[b]] for a, b in sorted(every)], atol=1.1e-6)


def moves_no_pairs(df):
    assert not any(x in plan(df) for x in ("Exchange", "Join", "Window", "Sort"))


def test_rounding_is_sparks(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=2000), [0.0, -0.0, 0.0000005, 0.1234565, -0.1234565, 2.5e-7, 1e12 + 0.3, 3.0000015, 123456.7890125, 0.0000015], np.round(rng.normal(size=500), 7)])
    want = [float(Decimal(repr(float(x))).quantize(Decimal("1e-6"), ROUND_HALF_UP)) for x in v]
    df = spark.createDataFrame([(k, float(x)) for k, x in enumerate(v)], "k int, v double")
    assert [r[0] for r in df.orderBy("k").select(F.round("v", 6) + F.lit(0.0)).collect()] == want == N.half_up(v, 6).tolist()


def test_self_tuning_similarity_moves_no_pairs(spark, few, samples):
    ids, d, _ = samples
    df = R.QUERIES["self_tuning_similarity"](spark, few)
    moves_no_pairs(df)
    scale = np.sort(d, axis=1)[:, 7]  # the first is the sample itself
    pairs_equal(df, ids, np.exp(-d * d / np.outer(scale, scale)), "s")


def test_gaussian_similarity_moves_no_pairs(spark, few, samples):
    ids, d, _ = samples
    df = R.QUERIES["gaussian_similarity"](spark, few)
    moves_no_pairs(df)
    pairs_equal(df, ids, np.exp(-d * d), "s")


def test_complete_graph_moves_no_pairs(spark, few, samples):
    ids, d, _ = samples
    df = R.QUERIES["complete_graph"](spark, few)
    moves_no_pairs(df)
    pairs_equal(df, ids, d, "w")
    assert df.where("w = 0").count() == 3  # of three equal vectors


def test_modulated_similarity_moves_no_pairs(spark, few, samples):
    ids, d, label = samples
    df = R.QUERIES["modulated_similarity"](spark, few)
    moves_no_pairs(df)
    pairs_equal(df, ids, np.exp(-d * d) * np.where(label[:, None] == label[None], 10, 0.1), "s")


def test_modulated_leaves_unknown_labels(spark):
    s = spark.createDataFrame([(1, [0.0], 0), (2, [1.0], None), (3, [2.0], -1), (4, [3.0], 0)], "id long, x array<double>, label int")
    want = R.C.modulated(R.C.gaussian_similarity(s, 1.0), s).collect()
    got = {(r.i, r.j): r.s for r in N.modulated_gaussian(s, 1.0).collect()}
    assert len(got) == 6 and all(np.isclose(got[r.i, r.j], r.s, rtol=1e-12) for r in want)


def test_row_normalized_similarity_moves_no_pairs(spark, few, samples):
    ids, d, _ = samples
    df = R.QUERIES["row_normalized_similarity"](spark, few)
    moves_no_pairs(df)
    s = np.exp(-d * d)
    np.fill_diagonal(s, 0)
    want, at = s / s.sum(axis=1, keepdims=True), {v: k for k, v in enumerate(ids.tolist())}
    rows = {(r.i, r.j): r.s for r in df.collect()}
    assert len(rows) == df.count() == len(ids) * (len(ids) - 1)
    assert all(abs(v - want[at[i], at[j]]) <= 1.1e-6 for (i, j), v in rows.items())


def test_row_normalized_far_samples(spark):
    s = spark.createDataFrame([(1, [0.0]), (2, [0.5]), (3, [9.0])], "id long, x array<double>")
    want = {(r.i, r.j): r.s for r in R.C.row_normalized(R.G.all_similarities(s)).collect()}
    assert {(r.i, r.j): r.s for r in N.row_normalized_gaussian(s, 1.0).collect()} == want


def test_what_is_stored_grows_with_samples(spark, few):
    """Each vector is stored once, whatever the number of blocks, and blocks have a bounded number of rows."""
    s = R.vectors(spark, few).select("id", "x")
    for block, parts in ((20, 16), (10_000, 2)):
        files = [f for _, f in N.stored_blocks(s, block)]
        assert len(files) == parts and sum(len(N.load(f).ids) for f in files) == 302
        assert sum(os.path.getsize(f.removeprefix("file://")) for f in files) < 302 * (64 * 4 + 8) + len(files) * 2000


def test_nearest_in_groups(spark, few, samples):
    ids, d, label = samples
    s = R.vectors(spark, few).select(F.col("label").cast("long").alias("graph"), "id", "x", "label")
    for block in (7, 1000):
        got = N.nearest(s, s, 3, leave_one_out=True, block=block, group="graph").collect()
        own = {i: sorted((d[a, b], ids[b]) for b in range(len(ids)) if a != b and label[a] == label[b])[:3] for a, i in enumerate(ids.tolist())}
        assert {(r.id, r["rank"]): r.other for r in got} == {(i, k + 1): o for i, near in own.items() for k, (_, o) in enumerate(near)}
        assert all(r.graph == r.label == r.other_label for r in got)
