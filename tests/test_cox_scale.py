"""Cox cross-validation: fits from sums by time, scores counted where they are made, quantiles from the tails."""

import numpy as np
import pytest

from cohortry.operators import design, newton, pairs, scoring
from cohortry.plans import crossval


def subjects(spark, n, seed=3, folds=2):
    rng = np.random.default_rng(seed)
    rows = [(i, float(a), float(np.round(b, 1)), [int(f) for f in rng.integers(0, 3, folds)], int(rng.random() < .6),
             float(rng.integers(1, 40))) for i, (a, b) in enumerate(rng.normal(size=(n, 2)))]
    return spark.createDataFrame(rows, "id int, a double, b double, folds array<int>, e int, t double").repartition(4)


def test_sums_by_time_are_the_trees(spark, monkeypatch):
    """One scan without a shuffle gives what the two passes over the tree of partitions give, with and without clipping."""
    monkeypatch.setattr(newton, "COX_BLOCK_ROWS", 90)
    monkeypatch.setattr(newton, "COX_STEP_ROWS", 32)
    d = design.design_table(subjects(spark, 700), "id", ["a", "b"], ["e", "t"], [1, 2], 3)
    order = newton.time_ordered(d, "e", "t", partition_rows=100)
    models = newton.fold_models(d, design.learn_folds(d))
    models += [models[0].take([1]), newton.Model(None, None, [0, 1], *[np.full(2, v) for v in (-np.inf, np.inf, 0.1, 2.0)])]
    jobs = [(m, np.array([.4, -.3])[:len(m.cols)]) for m in models]
    for (_, beta), (value, grad, curve), s in zip(jobs, newton._cox_by_time(order, jobs), newton._cox_evaluate(order, jobs, 2, False)):
        q = len(beta)
        assert value == pytest.approx(s[0], rel=1e-12) and grad == pytest.approx(s[1:1 + q], rel=1e-9, abs=1e-9)
        assert curve == pytest.approx(s[3:].reshape(2, 2)[:q, :q], rel=1e-9)
    monkeypatch.setattr(newton, "COX_TIME_ROWS", 0)
    monkeypatch.setattr(newton, "_cox_evaluate", None)
    assert len(newton.cox_fitter(order)(models)) == len(models)


@pytest.mark.parametrize("kind", ["continuous", "few", "shared", "close", "chains", "infinite"])
@pytest.mark.parametrize("few_turns,size", [(400, 9), (400, 301), (2, 301)])
def test_pairs_of_a_bucket(monkeypatch, kind, few_turns, size):
    monkeypatch.setattr(pairs, "FEW_TURNS", few_turns)
    rng = np.random.default_rng(7)
    n, tie = 700, 1e-8
    s = rng.normal(size=n)
    s = {"few": np.round(s), "shared": np.round(s, 2), "close": np.round(s, 2) + rng.integers(0, 3, n) * 6e-9,
         "chains": rng.integers(0, 600, n) * 1e-9, "infinite": np.where(rng.random(n) < .1, np.inf, s * 1e9)}.get(kind, s)
    s, turn, died = np.sort(s), rng.integers(0, size, n), np.flatnonzero(rng.random(n) < .5)
    earlier = turn < turn[died][:, None]
    want = [int((earlier & (s < (s[died] - tie)[:, None])).sum()), int((earlier & (s <= (s[died] + tie)[:, None])).sum())]
    assert list(pairs._own_counts(s, turn, died, tie, size)) == want


def test_cox_scores_are_dealt_out_where_they_are_made(spark, monkeypatch):
    """No scored row passes through a frame of rows; the same metrics as from rows, for any buckets."""
    df = subjects(spark, 900).drop("folds")
    train, hold = df.where("id < 600"), df.where("id >= 600")

    def run():
        return sorted(map(tuple, crossval.cross_validate_rfe_cox(train, hold, "id", ["a", "b"], "e", "t", 2, [1], 2).collect()))

    monkeypatch.setattr(crossval, "score_rows", None)
    monkeypatch.setattr(scoring, "comparable_pairs", None)
    whole = run()
    assert len(whole) == 4 and all(0 < r[3] < 1 and 0 < r[4] < 1 for r in whole)
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 40)
    monkeypatch.setattr(pairs, "TIMES", 5)
    monkeypatch.setattr(crossval, "PACKED_ROWS", 300)
    assert run() == whole


def test_quantiles_count_the_tails_only(spark, monkeypatch):
    """Rows beyond the tails are not counted, few values are fetched, and a limit that is too tight goes."""
    d = design.design_table(subjects(spark, 600), "id", ["a", "b"], ["e", "t"], [1, 2], 3)
    prep = design.fold_variances(d)
    rows = d.rows.collect()
    x, folds = np.array([r.x for r in rows]), np.array([r.folds for r in rows])
    probs = (0.01, 0.3, 0.99)
    want = np.array([np.quantile(x[folds[:, s] != f], probs, axis=0).T for s, f in d.models])
    counted, scans = [], []
    plain, limits = design._digit_counts, design._tail_limits
    monkeypatch.setattr(design, "_digit_counts", lambda *a: counted.append(plain(*a)) or counted[-1])
    for fetch, tight in ((400_000, 0.0), (0, 0.0), (20, 9.0)):
        monkeypatch.setattr(design, "TAIL_ROWS", fetch)
        monkeypatch.setattr(design, "_tail_limits", lambda d, probs: limits(d, probs) - tight)
        counted.clear()
        assert design.fold_quantiles(d, probs, prep.n) == pytest.approx(want, abs=1e-12)
        scans.append(len(counted))
        if not tight:
            assert counted[0].sum(axis=(1, 2)).min() < 60      # of 600 rows
    assert scans[0] == 1 < scans[1]
