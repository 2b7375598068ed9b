"""Cox sums by column: any cut into batches gives the likelihood written out, and Breslow's rule adds up no event moments."""

import numpy as np
import pytest

from cohortry.operators import newton


def written_out(z, w, eta, died, late, efron):
    """Value, gradient and curvature, time by time; z has a row per subject."""
    value, grad, curve = 0.0, np.zeros(z.shape[1]), np.zeros((z.shape[1],) * 2)
    for t in np.unique(late[died]):
        at, risk = died & (late == t), late <= t
        value, grad, d = value + eta[at].sum(), grad + z[at].sum(axis=0), at.sum()
        for i in range(d):
            v = np.where(risk, w, 0.0) - (i / d if efron else 0.0) * np.where(at, w, 0.0)
            s0, s1, s2 = v.sum(), v @ z, (z * v[:, None]).T @ z
            value, grad, curve = value - np.log(s0), grad - s1 / s0, curve + s2 / s0 - np.outer(s1, s1) / s0 ** 2
    return value, grad, curve


@pytest.mark.parametrize("efron", [False, True])
@pytest.mark.parametrize("times", [2, 25, 10_000])
@pytest.mark.parametrize("batch", [7, 60, 400])
def test_sweeps_by_column(monkeypatch, efron, times, batch):
    rng = np.random.default_rng(times)
    n, q = 200, 3
    x, event, late = rng.normal(size=(n, q)), rng.integers(0, 2, n), np.sort(rng.integers(0, times, n).astype(float))
    folds = rng.integers(0, 3, (n, 1))
    model = newton.Model(0, 1, list(range(q)), np.full(q, -1.5), np.full(q, 1.5), np.full(q, .1), np.full(q, 1.2))
    beta = rng.normal(size=q)
    wide = []
    whole = newton._moments
    monkeypatch.setattr(newton, "_moments", lambda z, w, q: wide.append(z) or whole(z, w, q))
    sweep = newton._Sweep(q, q, np.zeros(1 + q + q * q), {}, efron)
    for a in range(0, n, batch):
        rows = slice(a, a + batch)
        z, eta, w, train = newton._weights(model, beta, np.asfortranarray(x[rows]), folds[rows])
        assert z.shape[0] == q and all(row.flags.c_contiguous for row in z)
        sweep.add(z, eta, w, train & (event[rows] > 0), late[rows],
                  np.flatnonzero(np.append(True, late[rows][1:] != late[rows][:-1])))
    got = sweep.total()
    z, eta, w, train = newton._weights(model, beta, x, folds)
    value, grad, curve = written_out(z.T, w, eta, train & (event > 0), late, efron)
    assert got == pytest.approx(np.concatenate([[value], grad, curve.ravel()]), rel=1e-10, abs=1e-9)
    assert all(len(m) == q for m in wide)
    if not efron:
        assert sum(m.shape[1] for m in wide) <= n       # no row is added up twice
