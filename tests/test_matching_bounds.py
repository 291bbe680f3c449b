"""Images are matched only where a bound allows a better match, and are segmented once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import classify as C
from lattica.plans import registry as R

SF = "/root/testdata/sf0.001"


def test_bounds_are_above_every_value():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.random((200_000, 3)) * scale for scale in (1, 0.4, 0.05)] + [np.eye(3), 1 - np.eye(3), np.zeros((1, 3)), np.ones((1, 3))])
    far = (x.max(axis=1) ** 2) * (C.BOUND_STEPS / C.FAR_OFF)
    bounds = C.match_bounds()
    assert (bounds[np.minimum(far, C.BOUND_STEPS).astype(int)] >= C.match_values(*x.T)).all() and (np.diff(bounds) <= 0).all()


@pytest.mark.parametrize(("places", "start"), [(3, 0), (40, 0), (40, 900)])
def test_most_similar_of_images_with_ties_and_few_segments(spark, places, start):
    """Against all pairs matched: images of 0 to 5 segments, many of them equal, and others of one segment."""
    rng = np.random.default_rng(places)
    rows = [(int(i), k, float(rng.integers(1, 9)), bool(rng.random() < 0.2), (start + rng.integers(0, places, 3) / places).tolist(), (rng.integers(0, places, 2) / places).tolist()) for i in rng.permutation(70) * 3 for k in range(rng.integers(1, 6))]
    rows += [(900 + i, k, a, g, c, p) for i, k, a, g, c, p in rows if i < 60]  # copies
    seg = spark.createDataFrame(rows, "image_id long, seg_idx int, area double, is_background boolean, color array<double>, center array<double>").cache()
    ids = seg.select("image_id").distinct()
    every = ids.select(F.col("image_id").alias("i")).crossJoin(ids.select(F.col("image_id").alias("j"))).where("i <> j")
    want = {}
    for r in C.image_similarity(C.one_to_one(C.segment_pairs(seg, every))).collect():
        want.setdefault(r.i, {})[r.j] = r.s
    everything = {r.i: (r.j, r.s) for r in C.most_similar(seg, first_lot=1000).collect()}  # no bound leaves anything out
    assert everything.keys() == want.keys()
    for i, (j, s) in everything.items():
        assert np.isclose(s, max(want[i].values()), atol=1e-9) and np.isclose(want[i][j], s, atol=1e-9)
    for kw in ({}, {"block": 20, "step": 3}, {"first_lot": 1}):
        assert {r.i: (r.j, r.s) for r in C.most_similar(seg, **kw).collect()} == everything


@pytest.mark.parametrize("name", ["matching_classifier", "segment_recognition"])
def test_images_are_segmented_once(spark, name):
    plan = R.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "parted-segments" in str(R.QUERIES[name](spark, SF).inputFiles()) and "felzenszwalb" not in plan.lower() and plan.count("embedding") <= 4
