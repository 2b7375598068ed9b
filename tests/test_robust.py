"""Odd inputs: NULL keys and scores, mixed magnitudes, huge counts, repeated ids, fits that fail."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.functions.pvalues import t_tail
from cohortry.operators import design, newton, profile, running, scoring, split, survival
from cohortry.plans.survival_report import survival_report
from cohortry.sources.tables import parse_run

ROUTES = [{}, {"window_rows": 0, "partition_rows": 5}]


@pytest.mark.parametrize("limits", ROUTES)
def test_running_totals_with_null_keys_and_mixed_magnitudes(spark, limits):
    rows = [(None, i, 1, 1e-9) for i in range(30)] + [(1, i, 2, 1e6) for i in range(40)] + [(2, i, 1, 1e-9) for i in range(25)]
    df = spark.createDataFrame(rows, "k int, o int, n long, v double").repartition(4)
    got = {(r.k, r.o): (r.n_before, r.v_before) for r in running.running_totals(df, ["k"], ["o"], ["n", "v"], **limits).collect()}
    assert len(got) == 95
    for k, o, n, v in rows:
        assert got[k, o][0] == n * o and got[k, o][1] == pytest.approx(v * o, rel=1e-12, abs=0)


@pytest.mark.parametrize("limits", ROUTES)
def test_kaplan_meier_of_a_null_key(spark, limits):
    df = spark.createDataFrame([(None, float(t), 1) for t in range(6)] + [(3, 1.0, 1)], "k int, t double, e int")
    got = sorted((r.time, r.n_risk) for r in survival.kaplan_meier(df, ["k"], "t", "e", **limits).where("k IS NULL").collect())
    assert [n for _, n in got] == [6, 5, 4, 3, 2, 1]


def test_pairs_of_a_null_key_beside_a_large_key(spark):
    rows = [(k, float(i % 7), float(i), i % 2) for k in (None, 1, 2) for i in range(60 if k == 2 else 12)]
    df = spark.createDataFrame(rows, "k int, s double, t double, e int")
    whole = {r.k: tuple(r)[1:] for r in scoring.comparable_pairs(df, ["k"], "s", "t", "e").collect()}
    for local in (0, 20):
        mixed = scoring.comparable_pairs(df, ["k"], "s", "t", "e", local_rows=local, window_rows=0, partition_rows=7)
        assert {r.k: tuple(r)[1:] for r in mixed.collect()} == whole and len(whole) == 3


def test_counts_beyond_64_bits(spark, monkeypatch):
    cells = spark.createDataFrame([(1.0, 5_000_000_000, 5_000_000_000), (2.0, 4_000_000_000, 0)], "time double, n_event long, n_censor long")
    monkeypatch.setattr(survival, "time_cells", lambda *_: cells)
    curve = survival.kaplan_meier(cells, [], "time", "n_event").orderBy("time").collect()
    assert curve[0].n_risk == 14_000_000_000 and curve[0].surv == pytest.approx(9 / 14) and curve[0].se > 0
    # Five billion subjects at each of two times, as counted cells of the large route.
    wide = spark.createDataFrame([(5_000_000_000, 5_000_000_000)], "a long, b long")
    product = wide.agg(F.sum(F.col("a").cast(scoring.WIDE) * F.col("b"))).first()[0]
    assert int(product) == 25 * 10 ** 18


def test_null_scores_and_labels_are_left_out(spark):
    df = spark.createDataFrame([(None, 1), (1.0, 1), (-1.0, 0), (float("nan"), 0), (2.0, None)], "s double, y int")
    r = scoring.roc_auc(df, [], "s", "y").first()
    assert (r.auc, r.n_pos, r.n_neg, r.accuracy) == (1.0, 1, 1, 1.0)


def test_quantile_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "id int, v double")
    assert survival.split_at_quantile(df, [], "v").first().grp is None
    assert survival.split_at_quantile(df, ["id"], "v").first().threshold is None


def test_repeated_and_missing_ids_are_refused(spark):
    for ids in ([1, 1, 2, 3], [1, None, 2, 3]):
        df = spark.createDataFrame([(i, float(k), float(-k * k), k % 2) for k, i in enumerate(ids)], "id int, a double, b double, y int")
        with pytest.raises(ValueError, match="once per row"):
            profile.spearman_matrix(df, "id", ["a", "b"])
        with pytest.raises(ValueError, match="once per row"):
            split.stratified_kfold(df, "id", "y", 2, [1])


def test_t_tail_at_large_degrees_of_freedom():
    normal = math.erfc(2 / math.sqrt(2))
    for dof in (1e5, 1e8, 1e10, 1e11, 1e12, 1e14):
        assert t_tail(2.0, dof) == pytest.approx(normal * (1 + 0), rel=6 / dof + 1e-9)
    assert t_tail(2.0, 399.0) == pytest.approx(t_tail(2.0, 401.0), rel=1e-3)


def test_a_separating_marker_does_not_stop_the_report(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.normal()), float(rng.normal()), float(-i), float(i + 1), 1) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, b double, sep double, time double, event int")
    got = survival_report(df.where("id % 3 > 0"), df.where("id % 3 = 0"), "id", "a", ["b", "sep"], "event", "time", [0.0])
    coefs = {(r.biomarker, r.model_no): r.beta for r in got.coefficients.collect()}
    assert coefs["sep", 2] is None and coefs["b", 2] is not None
    status = {(r.biomarker, r.model_no, r.eval_set): (r.status, r.c_index) for r in got.summary.collect()}
    assert len(status) == 18 and status["sep", 2, "test"] == ("no fit", None) and status["b", 3, "union"][0] == "ok"


def test_added_in_levels_and_counted_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=3)], [i % 3], i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, x array<double>, folds array<int>, y int").repartition(9)
    d = design.Design(df, ["a", "b", "c"], [1], 3, 9, 200)
    sizes = np.array([sum(i % 3 != f for i in range(200)) for f in range(3)])
    plain = design.fold_quantiles(d, (0.25, 0.5), sizes)
    monkeypatch.setattr(design, "DRIVER_BYTES", 0)
    monkeypatch.setattr(design, "ADD_PARTS", 2)
    monkeypatch.setattr(design, "COUNT_BYTES", 3 * 2048 * 8)
    assert np.array_equal(design.fold_quantiles(d, (0.25, 0.5), sizes), plain)
    x = np.array([r[1] for r in rows])
    for f in range(3):
        at = np.array([i % 3 != f for i in range(200)])
        assert np.allclose(plain[f], np.quantile(x[at], [0.25, 0.5], axis=0).T)


def test_newton_reports_models_that_fail():
    def evaluate(asked):
        return [(-np.exp(-b[0]), np.array([np.exp(-b[0])]), np.array([[np.exp(-b[0])]])) if m == 0 else
                (float("nan"), b, np.eye(1)) if m == 1 else (-(b[0] - 2) ** 2, np.array([4 - 2 * b[0]]), np.array([[2.0]])) for m, b in asked]

    out, _ = newton.maximise([np.zeros(1)] * 3, evaluate, steps=12)
    assert np.isnan(out[0]).all() and np.isnan(out[1]).all() and out[2][0] == pytest.approx(2)


def test_run_rows_hold_literals():
    assert parse_run({"cols_to_balance": "['a, b', 'c']"})["cols_to_balance"] == ["a, b", "c"]
    assert parse_run({"cols_to_balance": "('x',)"})["cols_to_balance"] == ["x"]
    assert parse_run({"cols_to_balance": "'x'"})["cols_to_balance"] == ["x"] and parse_run({"cols_to_balance": ""})["cols_to_balance"] == []


def test_scoring_in_groups_of_models_gives_the_same(spark, monkeypatch):
    from cohortry.plans import crossval
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.normal()), float(rng.normal()), int(rng.random() < .5), float(rng.integers(1, 20))) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int, t double").cache()
    train, hold = df.where("id % 4 > 0"), df.where("id % 4 = 0")
    whole = sorted(map(str, crossval.cross_validate_rfe_cox(train, hold, "id", ["a", "b"], "y", "t", 2, [1, 2], 2).collect()))
    monkeypatch.setattr(crossval, "SCORED_ROWS", 120)
    assert sorted(map(str, crossval.cross_validate_rfe_cox(train, hold, "id", ["a", "b"], "y", "t", 2, [1, 2], 2).collect())) == whole


def test_caches_belong_to_their_analysis(spark):
    outer = running.hold(spark.range(3))
    with running.analysis():
        inner = running.hold(spark.range(4))
        assert inner.is_cached
    assert not inner.is_cached and outer.is_cached
    running.release()
    assert not outer.is_cached
