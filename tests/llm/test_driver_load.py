"""What the driver holds while others do the work."""

import tracemalloc

import numpy as np
from metrolith.llm import decontamination as D


def test_the_latent_space_is_fitted_beside_few_copies_of_its_matrix(monkeypatch):
    width = D.Settings().rank + 8
    z = np.random.default_rng(1).standard_normal(D.DIMENSIONS * width, dtype=np.float32)
    told = iter([z, np.diag(np.arange(1.0, width + 1)).ravel()])
    monkeypatch.setattr(D, "_gathered", lambda sample, make: next(told))
    tracemalloc.start()
    out = D.fit(None, np.ones(D.DIMENSIONS), D.Settings())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.shape == (D.DIMENSIONS, D.Settings().rank)
    assert peak < 5 * z.nbytes, peak / z.nbytes


def test_a_basis_by_blocks_spans_what_a_whole_one_does():
    rng = np.random.default_rng(2)
    for n, k in ((1000, 7), (4097, 72), (9000, 72)):
        z = rng.standard_normal((n, k)) * np.logspace(0, -5, k)
        ours, whole = D.orthonormal(z), np.linalg.qr(z)[0]
        assert np.allclose(ours.T @ ours, np.eye(k), atol=1e-10)
        assert np.allclose(np.abs(np.sum(ours * whole, axis=0)), 1, atol=1e-6)
