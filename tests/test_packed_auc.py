"""AUC of many models from scores packed by bucket: the area over all rows, and no row of a model is shuffled by itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import scoring
from cohortry.plans import crossval

BLOCKS = "k int, bucket int, pos binary, neg binary, n_pos bigint, n_neg bigint, right bigint"


@pytest.mark.parametrize("kind", ["continuous", "shared", "one class", "outside"])
def test_packed_scores_give_the_area_of_the_rows(spark, monkeypatch, kind):
    monkeypatch.setattr(scoring, "AUC_ROWS", 60)
    rng = np.random.default_rng(3)
    n = 1200
    s, y = rng.normal(size=n), rng.integers(0, 2, n).astype(float)
    if kind == "shared":
        s = np.where(rng.random(n) < .4, 0.0, np.round(s, 1))
        s[:6] = [-0.0, 0.0, np.inf, -np.inf, np.nan, np.nan]
    if kind == "one class":
        y[:] = 1
    bounds = scoring.score_bounds(s[:300] + (9 if kind == "outside" else 0), n)
    assert len(bounds) > 5
    cells = [(k, *row) for k, part in enumerate(np.array_split(np.arange(n), 4)) for row in
             scoring.pack_scores(s[part], y[part], bounds)]
    packed = spark.createDataFrame([(0, *map(lambda v: v if isinstance(v, bytes) else int(v), c[1:])) for c in cells], BLOCKS)
    rows = spark.createDataFrame([(0, a, int(b)) for a, b in zip(s.tolist(), y)], "k int, s double, y int")
    assert scoring.packed_auc(packed, ["k"]).collect() == [pytest.approx(r) for r in scoring.roc_auc(rows, ["k"], "s", "y").collect()]
    assert all(not c[2] and not c[3] for c in cells if c[1] % 2)


def test_cross_validation_packs_scores_where_they_are_made(spark, monkeypatch):
    monkeypatch.setattr(scoring, "AUC_ROWS", 50)
    monkeypatch.setattr(crossval, "PACKED_ROWS", 400)
    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(b), int(a + rng.normal() > 0)) for i, (a, b) in enumerate(rng.normal(size=(900, 2)))]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int")
    train, hold = df.where(F.col("id") < 600), df.where(F.col("id") >= 600)
    seen = []
    whole = crossval.durable

    def written(frame):
        seen.append(frame)
        return whole(frame)

    monkeypatch.setattr(crossval, "durable", written)
    monkeypatch.setattr(scoring, "running_totals", None)       # no order of all scored rows
    got = {(r.fold, r.NumFeatures): r for r in crossval.cross_validate_rfe_logistic(
        train, hold, "id", ["a", "b"], "y", 2, [1], 2).collect()}
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket" in plan and len(got) == 4
    y = np.array([r[3] for r in rows[600:]])
    for (_, k), r in got.items():
        if k == 1:          # one feature: the area of the feature itself
            name = (r["OR > 1 Features"] + r["OR < 1 Features"])[0]
            x = np.array([row[1 if name == "a" else 2] for row in rows[600:]]) * (1 if r["OR > 1 Features"] else -1)
            x = np.clip(x, *np.sort(x)[[0, -1]])
            pos, neg = x[y == 1], x[y == 0]
            want = ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / len(pos) / len(neg)
            assert r.Holdout_AUC == pytest.approx(want, abs=2e-3)       # clipped tails tie
