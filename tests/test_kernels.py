"""Published goldens and invariants of the numpy kernels."""

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from lattica.operators import kernels as K
from lattica.operators.classify import modulated_similarity_predict

TRIANGLES = [(0, 1), (0, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 3)]


def weights(edges, n):
    w = np.zeros((n, n))
    for a, b in edges:
        w[a, b] = w[b, a] = 1
    return w


def test_procrustes():
    a, b = np.array([[1, 2], [3, 4], [5, 6], [7, 8.0]]), np.array([[1.2, 2.1], [2.9, 4.3], [5.2, 6.1], [6.8, 8.1]])
    assert np.allclose(np.abs(K.procrustes(a, b)), [[0.9999, 0.0126], [0.0126, 0.9999]], atol=1e-3)


def test_null_space():
    y = K.null_space_intersection(np.array([[1, -1, 1.0]] * 3), np.array([[4, 2, 0], [2, 1, 0], [6, 3, 0.0]]))
    assert y.shape == (3, 1) and np.isclose(abs(y[:, 0] @ [1, -2, -3]), np.sqrt(14))
    assert K.null_space_intersection(np.eye(3), np.eye(3)).shape[1] == 0


def test_canonical_angles():
    a, b = np.array([[1, 2], [3, 4], [5, 6.0]]), np.array([[1, 5], [3, 7], [5, -1.0]])
    assert np.allclose(K.canonical_angles(a, b)[2], [1.0, 0.856], atol=1e-3)
    assert K.subspace_intersection(a, b).shape[1] == 1 and K.subspace_distance(a, a) < 1e-6


@given(st.lists(st.floats(-2, 2), min_size=1, max_size=6))
def test_elementary_polynomials(x):
    assert np.allclose(np.poly(x)[1:] * (-1) ** np.arange(1, len(x) + 1), K.elementary(np.array(x)), atol=1e-6)


def test_elementary_values():
    assert np.allclose(K.elementary(np.array([1, 2, 3, 4.0])), [10, 35, 50, 24])


@pytest.mark.parametrize("seed", range(5))
def test_laplacian(seed):
    rng = np.random.default_rng(seed)
    src, dst = rng.integers(0, 50, (2, 200))
    keep = src != dst
    m = K.dense_laplacian(50, src[keep], dst[keep], rng.random(keep.sum()))
    assert K.is_symmetric(m) and np.allclose(m.sum(axis=1), 0) and np.linalg.eigvalsh(m).min() > -1e-9
    v, e = K.matrix_free_eigen(lambda x: m @ x, 50, 3)
    assert np.allclose(m @ e, e * v)


@pytest.mark.parametrize("sets", [lambda w: K.ncut_sets(w, 0.5), lambda w: K.isoperimetric_sets(w, 0.5)])
def test_two_triangles(sets):
    part = sets(weights(TRIANGLES, 6))
    assert len({*part[:3]}) == 1 and len({*part[3:]}) == 1 and part[0] != part[3]


def test_conjugate_gradient():
    a, b = np.array([[4, 1], [1, 3.0]]), np.array([1, 2.0])
    assert np.allclose(K.conjugate_gradient(a, b), np.linalg.solve(a, b))


def test_felzenszwalb_and_fusing():
    edges = [(0, 1, 0.1), (1, 2, 5.0), (2, 3, 0.1), (3, 4, 9.0)]
    f = K.felzenszwalb_sets(5, edges, 0.2, 0, np.ones(5), "cardinality")
    assert f.find(0) == f.find(1) != f.find(2) == f.find(3) != f.find(4)
    K.fuse_small_sets(f, [(a, b) for a, b, _ in edges], 2, np.ones(5))
    assert f.find(3) == f.find(4)


def test_lle_spreads_a_line():
    t = np.linspace(0, 1, 60)
    e = K.lle(np.stack([t, 2 * t, np.sin(t)], axis=1), 6, 1)[:, 0]
    assert abs(np.corrcoef(e, t)[0, 1]) > 0.98


def test_pattern_vectors_ignore_order():
    w, p = weights(TRIANGLES, 6), np.random.default_rng(0).permutation(6)
    lap = np.diag(w.sum(axis=1)) - w
    assert K.pattern_vector(lap, 2, 8).shape == (16,) and K.pattern_vector(lap[np.ix_(p, p)], 2, 8).shape == (16,)
    with pytest.raises(ValueError):
        K.pattern_vector(lap, 6, 8)


def test_modulated_similarity():
    x = np.concatenate([np.random.default_rng(1).normal(0, 0.3, (10, 2)), np.random.default_rng(2).normal(3, 0.3, (10, 2))])
    s = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert modulated_similarity_predict(s, np.repeat([0, 1], 10), np.exp(-((x - [3, 3]) ** 2).sum(axis=1)), 2) == 1


@pytest.mark.parametrize("normalized", [False, True])
def test_lanczos_on_a_sparse_graph(normalized):
    """Also with an eigenvalue that occurs twice: the graph has two equal parts."""
    rng = np.random.default_rng(3)
    src, dst, w = rng.integers(0, 60, 200), rng.integers(0, 60, 200), rng.random(200)
    src, dst, w = (np.concatenate([a[src != dst], b[src != dst]]) for a, b in ((src, src + 60), (dst, dst + 60), (w, w)))
    m = K.dense_laplacian(120, src, dst, w, normalized=normalized)
    v, e = K.matrix_free_eigen(K.sparse_laplacian(120, src, dst, w, normalized=normalized), 120, 6)
    assert np.allclose(v, np.linalg.eigvalsh(m)[:6], atol=1e-6) and np.allclose(m @ e, e * v, atol=1e-5)


def test_conjugate_gradient_says_when_it_fails():
    with pytest.raises(ValueError):
        K.conjugate_gradient(np.array([[0.0, 1.0], [-1.0, 0.0]]), np.array([1.0, 0.0]))


def test_fuse_down_to():
    edges = [(0, 1, 5.0), (1, 2, 1.0), (2, 3, 2.0), (3, 0, 9.0), (0, 2, 4.0)]
    f = K.Forest(5)
    K.fuse_down_to(3, f, edges)  # 1-2 first, then 12-3 at 2; 0-12 would be at 4.5
    assert f.find(1) == f.find(2) == f.find(3) != f.find(0) and f.sets == 3
    K.fuse_down_to(1, f, edges)
    assert f.sets == 2  # vertex 4 has no edge


def test_tree_walk_kernel():
    a, x = weights([(0, 1), (1, 2)], 3), np.array([[1], [2], [1]])
    # Depth 1 counts pairs of equal labels; depth 2 adds the sets of neighbours that match: 1-2-1 against itself.
    assert K.tree_walk_kernel(a, x, a, x, 1, 2) == 5
    ends, middle = 4 * (1 + 1), 1 + 4 + 2  # none, one of 2 x 2 pairs, both in two orders
    assert K.tree_walk_kernel(a, x, a, x, 2, 2) == ends + middle
    assert K.tree_walk_kernel(a, x, a, x, 2, 1) == ends + 5
    assert K.chi_squared_kernel(np.array([[1.0, 0.0]]), np.array([[1.0, 0.0], [0.0, 1.0]])).tolist() == [[1.0, np.exp(-2.0)]]
