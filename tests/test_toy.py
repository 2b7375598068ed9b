"""Hand-checked values on a ten-row table, by the plain and by the partitioned route."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import (clean, design, newton, profile, quantiles, running, scoring, split, survival)

ROWS = [(0, 5., 1, 2.1, .5, "U", 1), (1, 8., 1, 1.7, -.3, "U", 1), (2, 8., 0, 1.7, .2, "U", 0),
        (3, 12., 1, .9, 1.1, "L", 1), (4, 12., 1, .4, -1.2, "L", 1), (5, 15., 0, .6, .7, "U", 0),
        (6, 20., 1, 1.0, -.4, "U", 1), (7, 20., 1, -.2, .9, "L", 0), (8, 25., 0, -.8, -.6, "L", 0),
        (9, 30., 0, -1.5, .1, "L", 0)]
X = np.array([r[3:5] for r in ROWS])
PLAIN, SPREAD = {}, {"window_rows": 0, "partition_rows": 3}


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame(
        ROWS, "id bigint, time double, event int, x1 double, x2 double, grp string, y int").repartition(3).cache()


@pytest.fixture(params=[PLAIN, SPREAD], ids=["window", "partitioned"])
def limits(request):
    return request.param


def test_kaplan_meier(toy, limits):
    curve = survival.kaplan_meier(toy, [], "time", "event", **limits).orderBy("time").collect()
    assert [(r.time, r.n_risk, r.n_event) for r in curve] == [
        (5, 10, 1), (8, 9, 1), (12, 7, 2), (15, 5, 0), (20, 4, 2), (25, 2, 0), (30, 1, 0)]
    assert [r.surv for r in curve] == pytest.approx(
        [.9, .8, .571429, .571429, .285714, .285714, .285714], abs=1e-6)
    assert (curve[2].se, curve[2].lower, curve[2].upper) == pytest.approx((.163775, .325839, 1), abs=1e-6)
    assert (curve[4].se, curve[4].lower, curve[4].upper) == pytest.approx((.164662, .092336, .884087), abs=1e-6)


def test_kaplan_meier_to_zero_and_medians(toy, limits):
    curve = survival.kaplan_meier(toy, ["grp"], "time", "event", **limits)
    at = {(r.grp, r.time): r.surv for r in curve.collect()}
    assert [at["U", t] for t in (5, 8, 15, 20)] == pytest.approx([.8, .6, .6, 0])
    assert [at["L", t] for t in (12, 20, 25, 30)] == pytest.approx([.6, .4, .4, .4])
    labels = survival.median_label(survival.median_survival(curve, ["grp"]), "grp").collect()
    assert sorted(r.label for r in labels) == ["L: Median = 20 days", "U: Median = 20 days"]


def test_median_on_a_flat_half_and_never_reached(spark):
    rows = [("a", 1., 1), ("a", 2., 1), ("a", 4., 1), ("a", 5., 1), ("b", 3., 0), ("b", 7., 0)]
    df = spark.createDataFrame(rows, "g string, t double, e int")
    got = survival.median_label(survival.median_survival(
        survival.kaplan_meier(df, ["g"], "t", "e"), ["g"]), "g").orderBy("g").collect()
    assert got[0].median == 3.0 and got[1].median is None
    assert got[1].label == "b: Median = not reached at 7 days"


def test_logrank(toy, limits):
    r = survival.logrank(toy, [], "grp", "time", "event", **limits).first()
    assert (r.group1, r.group2, r.observed) == ("L", "U", 3)
    assert (r.variance, r.chi2, r.p_value) == pytest.approx((1.0870496347, .8909491250, .3452202336), abs=1e-9)
    assert 6 - r.expected == pytest.approx(2.0158730159, abs=1e-9)


def test_logrank_single_group_and_three(toy):
    one = survival.logrank(toy.where("grp = 'U'"), [], "grp", "time", "event").first()
    assert one.chi2 is None and one.p_value is None
    with pytest.raises(ValueError):
        survival.logrank(toy, [], "id", "time", "event")


def test_risk_table_keeps_zeros(toy):
    got = {(r.grp, r.brk): r.n_risk for r in survival.risk_table(toy, ["grp"], "time", [0, 12, 100]).collect()}
    assert got == {("U", 0): 5, ("U", 12): 2, ("U", 100): 0, ("L", 0): 5, ("L", 12): 5, ("L", 100): 0}


def test_split_at_quantile(toy):
    rows = survival.split_at_quantile(toy, [], "x1").collect()
    assert {r.threshold for r in rows} == {0.75}
    assert sum(r.grp == "Upper" for r in rows) == 5


def test_quantiles(toy, limits):
    probs = {"a": .005, "b": .25, "c": .5, "d": .75, "e": .995}
    r = quantiles.exact_quantiles(toy, [], "x1", probs, **limits).first()
    assert tuple(r) == pytest.approx((-1.4685, -.05, .75, 1.525, 2.082))


def test_skew_and_labels(toy, spark):
    r = profile.skew_profile(toy, ["x1"]).first()
    assert r.skew == pytest.approx(-.4611057671) and r.comment == profile.NEAR_NORMAL
    # A constant column has no skewness and is labelled left.
    df = spark.createDataFrame([(1., 0.), (1., 0.), (1., 9.)], "c double, r double")
    got = {x.feature: x.comment for x in profile.skew_profile(df.repartition(1), ["c"]).collect()}
    assert got == {"c": profile.LEFT_SKEWED}


def test_histogram(toy):
    bins = [r.n for r in profile.histogram(toy, ["x1"]).orderBy("bin").collect()]
    assert bins == [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 1, 0, 1, 1, 0, 0, 0, 0, 0, 2, 0, 0, 1]
    flat = profile.histogram(toy.withColumn("c", F.lit(4.0)), ["c"]).where("n > 0").collect()
    assert [(r.bin, r.n) for r in flat] == [(15, 10)]


def test_spearman(toy, limits):
    with_const = toy.withColumn("c", F.lit(2.0))
    matrix = profile.spearman_matrix(with_const, "id", ["x1", "x2", "c"], **limits)
    got = {(r.feat1, r.feat2): r.rho for r in matrix.collect()}
    assert got["x1", "x2"] == pytest.approx(.1641344968) and got["x1", "x1"] == pytest.approx(1)
    assert got["x1", "c"] is None and got["c", "c"] is None
    t = profile.spearman_test(matrix, profile.feature_pairs(toy, ["x1", "x2"])).first()
    assert (t.t, t.p_value) == pytest.approx((.4706250949, .650473140), abs=1e-9)


def test_spearman_without_broadcast(toy, monkeypatch):
    monkeypatch.setattr(running, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(running, "HOT_SHARE", 5)
    got = profile.spearman_matrix(toy, "id", ["x1", "x2"]).where("i < j").first()
    assert got.rho == pytest.approx(.1641344968)


def test_log_transform(toy):
    got = [r.x1_log for r in clean.log_transform(toy, ["x1"]).orderBy("id").collect()]
    assert (got[0], got[9]) == pytest.approx((1.28093412, -13.81551056), abs=1e-7)
    with pytest.raises(ValueError):
        clean.log_transform(toy, ["nope"])


def test_auc_and_accuracy(toy, limits):
    r = scoring.roc_auc(toy, [], "x1", "y", **limits).first()
    assert r.auc == pytest.approx(.82)
    one = scoring.roc_auc(toy.where("y = 1"), [], "x1", "y").first()
    assert one.auc is None and one.status == "one class"


@pytest.mark.parametrize("how", [{}, {"local_rows": 0}, {"local_rows": 0, "window_rows": 0, "partition_rows": 9}])
def test_concordance(toy, how):
    pairs = scoring.comparable_pairs(toy, [], "x1", "time", "event", **how)
    half, drop = scoring.concordance(pairs).first(), scoring.concordance(pairs, "drop").first()
    assert (half.concordant, half.discordant, half.tied) == (27, 3, 1)
    assert (half.c_index, drop.c_index) == pytest.approx((.8870967742, .9))
    none = scoring.concordance(scoring.comparable_pairs(toy.where("event = 0"), [], "x1", "time", "event", **how)).first()
    assert none.c_index is None and none.status == "no comparable pair"


def _model(mean, scale):
    inf = np.full(2, np.inf)
    return newton.Model(None, None, [0, 1], -inf, inf, np.asarray(mean), np.asarray(scale))


def test_concordance_mixed_keys_and_hot_scores(spark, monkeypatch):
    """One key and one score hold a third of the rows; scores closer than the tie width."""
    monkeypatch.setattr(running, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(running, "HOT_SHARE", 4)
    rng = np.random.default_rng(3)
    n = 600
    key = np.where(rng.random(n) < .5, 0, rng.integers(1, 6, n))
    s = np.where(rng.random(n) < .35, 2.0, rng.integers(0, 20, n) / 4 + rng.integers(0, 3, n) * 4e-9)
    t, e = rng.integers(0, 30, n).astype(float), rng.integers(0, 2, n)
    df = spark.createDataFrame([(int(a), float(b), float(c), int(d)) for a, b, c, d in zip(key, s, t, e)],
                               "k int, s double, t double, e int")
    want = {}
    for k in set(key.tolist()):
        a, b, c = s[key == k], t[key == k], e[key == k]
        comp = (c[:, None] == 1) & ((b[:, None] < b) | ((b[:, None] == b) & (c == 0)))
        gap = a[:, None] - a
        tie = np.abs(gap) <= 1e-8
        want[k] = ((comp & ~tie & (gap > 0)).sum(), (comp & ~tie & (gap < 0)).sum(), (comp & tie).sum())
    for how in ({}, {"local_rows": 100}, {"local_rows": 0, "window_rows": 0, "partition_rows": 500}):
        got = scoring.comparable_pairs(df, ["k"], "s", "t", "e", **how).collect()
        assert {r.k: (r.concordant, r.discordant, r.tied) for r in got} == want


def test_cox_fits(toy):
    d = design.design_table(toy, "id", ["x1", "x2"], ["event", "time", "y"])
    scaled, raw = _model(X.mean(0), X.std(0)), _model([0, 0], [1, 1])
    for partition_rows in (100, 3, 1):
        order = newton.time_ordered(d, "event", "time", partition_rows)
        assert newton.cox_fitter(order, .05)([scaled])[0] == pytest.approx([1.70335445, .14407448], abs=1e-7)
        both, one = newton.cox_fitter(order, 0.0, "efron")([raw, raw.take([0])])
        assert both == pytest.approx([1.69693909, .28042667], abs=1e-7) and one == pytest.approx([1.63882949], abs=1e-7)


def test_logistic_fit(toy):
    d = design.design_table(toy, "id", ["x1", "x2"], ["y"])
    beta = newton.logistic_fitter(d, "y")([_model(X.mean(0), X.std(0))])[0]
    assert beta == pytest.approx([.94520511, -.43147190, -.01789153], abs=1e-7)


def test_fold_allocation(toy):
    got = split.fold_rows(toy, "id", "event", 3, [1, 2]).groupBy("seed", "fold", "event").count().collect()
    sizes = {(r.seed, r.fold, r.event): r["count"] for r in got}
    for seed in (1, 2):
        assert [(sizes[seed, f, 0], sizes[seed, f, 1]) for f in range(3)] == [(2, 2), (1, 2), (1, 2)]
    with pytest.raises(ValueError):
        split.fold_rows(toy, "id", "event", 7, [1])


def test_running_totals_agree(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 700).alias("k"), F.col("id").alias("o"),
        (F.col("id") % 11).alias("v"), (F.col("id") * 0.25).alias("w"))
    plain = {(r.k, r.o): (r.v_before, r.w_before) for r in running.running_totals(df, ["k"], ["o"], ["v", "w"]).collect()}
    for rows in (50, 400, 2999):
        spread = running.running_totals(df, ["k"], ["o"], ["v", "w"], window_rows=0, partition_rows=rows)
        assert {(r.k, r.o): (r.v_before, r.w_before) for r in spread.collect()} == plain
    one = running.running_totals(df, [], ["o"], ["v"], window_rows=0, partition_rows=100).where("o = 2999").first()
    assert one.v_before == sum(i % 11 for i in range(2999))
