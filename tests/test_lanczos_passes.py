"""lle and the spectra of large graphs: a step of Lanczos goes once through what it has, and the pairs are as a dense solver's."""

import numpy as np
import pytest

from lattica.operators import kernels as K


@pytest.mark.parametrize("twin", [False, True])
def test_one_pass_a_step(monkeypatch, twin):
    rng = np.random.default_rng(8)
    n, k = 400, 3
    q = np.linalg.qr(rng.standard_normal((n, n)))[0]
    values = np.sort(np.r_[0, 1e-4, 2e-4, rng.random(n - 5) * 2 + 0.01, 40, 170])
    if twin:  # values that occur twice and three times
        values[4:8] = values[4]
        values[1] = values[2]
    m = q * values @ q.T
    steps, passes, qr = [0], [0], np.linalg.qr

    def times(v):
        steps[0] += 1
        return m @ v

    def counted(a):
        passes[0] += 1
        return qr(a)

    monkeypatch.setattr(np.linalg, "qr", counted)
    got, vectors = K.matrix_free_eigen(times, n, k)
    assert np.allclose(got, values[:k], atol=1e-7) and np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-9)
    assert np.allclose(m @ vectors, vectors * got, atol=1e-6)
    assert passes[0] < 1.5 * steps[0] / k  # two before


def test_few_values_end_the_space_early():
    """What the basis holds already gives way to something new."""
    m = np.diag(np.r_[np.zeros(2), np.ones(3), np.full(195, 2.0)])
    got, vectors = K.matrix_free_eigen(lambda v: m @ v, 200, 5)
    assert np.allclose(got, [0, 0, 1, 1, 1], atol=1e-8) and np.allclose(m @ vectors, vectors * got, atol=1e-7)
