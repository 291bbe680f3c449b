"""Passages of texts that are longer than the places of one segment."""

import numpy as np

from lattica.llm import repeats


def test_segments_change_nothing():
    h = np.random.default_rng(3).integers(0, 1 << 63, 5000).astype(np.uint64)
    h[100:400] = h[100]  # equal values: the leftmost counts
    whole = repeats.least_places(h, 101)
    low = h >> np.uint64(repeats.PLACE_BITS)
    assert whole.tolist() == [i + int(low[i : i + 101].argmin()) for i in range(len(h) - 100)]
    for segment in (101, 102, 500, 4999, 5000):
        assert (repeats.least_places(h, 101, segment) == whole).all()


def test_triggers_beyond_the_limit():
    """A passage on both sides of the limit, and in a short text, has the same triggers at the same distance."""
    limit = 1 << repeats.PLACE_BITS
    rng = np.random.default_rng(5)
    data = rng.integers(32, 127, limit + 5000).astype(np.uint8)
    passage = rng.integers(32, 127, 400).astype(np.uint8)
    spots = (1000, limit - 200, limit + 4000)
    for s in spots:
        data[s : s + 400] = passage
    _, start, end, trigger, h, _ = repeats.triggers(data, np.array([0, len(data)]), repeats.LENGTH)
    assert start[0] == 0 and end[-1] == len(data) - repeats.LENGTH and (start[1:] == end[:-1] + 1).all()
    assert (trigger >= start).all() and (trigger <= end + repeats.LENGTH).all() and len(np.unique(trigger)) == len(trigger)
    _, _, _, want, names, _ = repeats.triggers(passage, np.array([0, 400]), repeats.LENGTH)
    for s in spots:
        here = np.isin(trigger, want + s)
        assert here.sum() == len(want) and (h[here] == names).all()
