"""Fits, cross-validation and survival tables (F1-F5, F12, F13, G, B14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.operators import design, newton, report, survival
from cohortry.operators.running import hold, release
from cohortry.plans import runs
from cohortry.plans.crossval import cross_validate_rfe_cox, cross_validate_rfe_logistic
from cohortry.plans.preparation import prepare_logistic, prepare_survival
from cohortry.plans.survival_report import fit_biomarkers, survival_report
from cohortry.queries.registry import query, r6, rounded, scratch
from cohortry.queries.statistics import LARGE, SCORE_SQL, fixed_score
from cohortry.queries.subjects import (F_SQL, FEATURES, fold_sql, held_features, order_features, split_sql,
                                       unpivot_sql)
from cohortry.operators.split import stratified_kfold
from cohortry.sources.tables import read_metrics, read_run_matrix

W = f"WITH {F_SQL}"
SEEDS, K = [1, 2, 3], 3                            # of the single-column fits, whose SQL writes every Newton step out
ALL_SEEDS, ALL_FOLDS = list(range(1, 11)), 5       # of elimination and cross-validation
BASE = ["id", "prio", "seg", "response", "event", "time", *FEATURES]
BREAKS = [0.0, 500.0, 1000.0, 1500.0, 2000.0, 2500.0]


# --- survival tables ----------------------------------------------------------------------------

def km_sql(source, key):
    return f"""tc AS (SELECT {key} AS k, time, CAST(sum(event) AS BIGINT) AS d, CAST(count(*) - sum(event) AS BIGINT) AS c
  FROM {source} GROUP BY ALL),
rs AS (SELECT *, CAST(sum(d + c) OVER (PARTITION BY k ORDER BY time DESC) AS BIGINT) AS n FROM tc),
km AS (SELECT *, product(1 - d / n) OVER (PARTITION BY k ORDER BY time) AS s,
  sum(CASE WHEN d < n THEN d / (CAST(n AS DOUBLE) * (n - d)) ELSE 0 END) OVER (PARTITION BY k ORDER BY time) AS v FROM rs)"""


KM_OUT = """time, n AS n_risk, d AS n_event, c AS n_censor, round(s, 6) + 0.0 AS surv,
  CASE WHEN s > 0 THEN round(s * sqrt(v), 6) + 0.0 END AS se,
  CASE WHEN s > 0 THEN round(exp(ln(s) - 1.959963984540054 * sqrt(v)), 6) + 0.0 END AS lower,
  CASE WHEN s > 0 THEN round(least(exp(ln(s) + 1.959963984540054 * sqrt(v)), 1), 6) + 0.0 END AS upper"""


G1_SQL = f"{W}, {km_sql('f', 'response')} SELECT k AS response, {KM_OUT} FROM km"


@query("G1_kaplan_meier", G1_SQL)
def g1(spark, sf):
    return rounded(survival.kaplan_meier(order_features(spark, sf), ["response"], "time", "event"),
                   "surv", "se", "lower", "upper")


@query("G1_kaplan_meier_ranged", G1_SQL)
def g1_ranged(spark, sf):
    return rounded(survival.kaplan_meier(order_features(spark, sf), ["response"], "time", "event", **LARGE),
                   "surv", "se", "lower", "upper")


MEDIAN_SQL = """md AS (SELECT k, min(time) FILTER (WHERE s <= 0.5 + 1e-12) AS first, max(time) AS max_time,
  min(time) FILTER (WHERE abs(s - 0.5) <= 1e-12) AS half, min(time) FILTER (WHERE s < 0.5 - 1e-12) AS next FROM km GROUP BY k),
mm AS (SELECT k, CASE WHEN half IS NOT NULL AND next IS NOT NULL THEN (half + next) / 2 ELSE first END AS median, max_time FROM md)"""


@query("G2_median_survival", f"{W}, {km_sql('f', 'prio')}, {MEDIAN_SQL} SELECT k AS prio, median, max_time FROM mm")
def g2(spark, sf):
    return survival.median_survival(
        survival.kaplan_meier(order_features(spark, sf), ["prio"], "time", "event"), ["prio"])


# One group's events are thinned so that its curve never reaches one half.
@query("B14_median_label", f"""{W}, g AS (SELECT time, prio AS grp, CASE WHEN prio LIKE '1%' AND time < 2000 THEN 0 ELSE event END AS event FROM f),
{km_sql('g', 'grp')}, {MEDIAN_SQL}
SELECT k AS grp, CASE WHEN median IS NULL THEN k || ': Median = not reached at ' || CAST(CAST(max_time AS BIGINT) AS VARCHAR) || ' days'
  ELSE k || ': Median = ' || CASE WHEN median = floor(median) THEN CAST(CAST(median AS BIGINT) AS VARCHAR) ELSE CAST(median AS VARCHAR) END
  || ' days' END AS label FROM mm""")
def b14(spark, sf):
    f = order_features(spark, sf).withColumnRenamed("prio", "grp").withColumn(
        "event", F.when(F.col("grp").startswith("1") & (F.col("time") < 2000), 0).otherwise(F.col("event")))
    curve = survival.kaplan_meier(f, ["grp"], "time", "event")
    return survival.median_label(survival.median_survival(curve, ["grp"]), "grp").select("grp", "label")


# The normal tail beyond sqrt(chi2) is integrated numerically over 12 deviations.
@query("G3_logrank", f"""{W}, tc AS (SELECT seg, time, sum(event) AS d, count(*) AS m, sum(CASE WHEN response = 0 THEN event ELSE 0 END) AS d1,
  count(*) FILTER (WHERE response = 0) AS m1 FROM f GROUP BY seg, time),
rs AS (SELECT *, CAST(sum(m) OVER w AS DOUBLE) AS n, CAST(sum(m1) OVER w AS DOUBLE) AS n1 FROM tc WINDOW w AS (PARTITION BY seg ORDER BY time DESC)),
lr AS (SELECT seg, CAST(sum(d1) AS BIGINT) AS observed, sum(d * n1 / n) AS expected,
  sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS variance FROM rs WHERE d > 0 GROUP BY seg),
ch AS (SELECT *, (observed - expected) * (observed - expected) / variance AS chi2 FROM lr),
p AS (SELECT seg, max(12.0 / 6000 / 3) * 2 / sqrt(2 * pi()) * sum(CASE WHEN k IN (0, 6000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
  * exp(-pow(sqrt(chi2) + 12.0 * k / 6000, 2) / 2)) AS p FROM ch CROSS JOIN range(0, 6001) AS r(k) GROUP BY seg)
SELECT seg, 0 AS group1, 1 AS group2, observed, round(expected, 6) AS expected, round(variance, 6) AS variance, round(chi2, 6) AS chi2,
  round(p, 6) + 0.0 AS p_value FROM ch JOIN p USING (seg)""")
def g3(spark, sf):
    return rounded(survival.logrank(order_features(spark, sf), ["seg"], "response", "time", "event"),
                   "expected", "variance", "chi2", "p_value")


@query("G4_risk_table", f"""{W} SELECT response, CAST(brk AS DOUBLE) AS brk, count(*) FILTER (WHERE time >= brk) AS n_risk
FROM f CROSS JOIN (VALUES {', '.join(f'({b})' for b in BREAKS)}) AS v(brk) GROUP BY response, brk""")
def g4(spark, sf):
    return survival.risk_table(order_features(spark, sf), ["response"], "time", BREAKS)


# --- fits ---------------------------------------------------------------------------------------

def folded(spark, sf, label, k=K, seeds=SEEDS):
    f = held_features(spark, sf, "id", *FEATURES, "response", "event", "time")
    kept = stratified_kfold(f, "id", label, k, seeds)
    return design.design_table(kept, "id", FEATURES, ["response", "event", "time"], seeds, k)


def coef_rows(spark, d, fits):
    """One row per fit and coefficient."""
    rows = [(*key, d.features[c], float(b)) for key, cols, beta in fits for c, b in zip(cols, beta)]
    return spark.createDataFrame(rows, "seed int, fold int, k int, feature string, beta double") \
        .withColumn("ratio", F.exp("beta"))


def _named(d, model):
    return d.seeds[model.seed], model.fold


def fold_rows_sql(label):
    """Clipped and scaled training rows of every (seed, fold, feature), ending in ``zt``."""
    return f"""{F_SQL}, {fold_sql('f', label, K, SEEDS)}, {unpivot_sql('f', FEATURES)},
tr AS (SELECT fo.id, fo.seed, g.fold, feature, v FROM fo JOIN u USING (id)
  JOIN (VALUES {', '.join(f'({i})' for i in range(K))}) AS g(fold) ON fo.fold <> g.fold),
q AS (SELECT seed, fold, feature, quantile_cont(v, 0.005) AS low, quantile_cont(v, 0.995) AS high FROM tr GROUP BY ALL),
sc AS (SELECT seed, fold, feature, avg(least(greatest(v, low), high)) AS mean,
  stddev_pop(least(greatest(v, low), high)) AS dev FROM tr JOIN q USING (seed, fold, feature) GROUP BY ALL),
zt AS MATERIALIZED (SELECT seed, fold, feature, (least(greatest(v, low), high) - mean) / dev AS z, response, event, time
  FROM tr JOIN q USING (seed, fold, feature) JOIN sc USING (seed, fold, feature) JOIN f USING (id))"""


def chained(start, step, times):
    """Newton steps written out: ``n0`` is the start, ``n<times>`` the result."""
    return ", ".join([f"n0 AS MATERIALIZED ({start})"] + [
        f"n{i + 1} AS MATERIALIZED ({step.replace('PREVIOUS', f'n{i}')})" for i in range(times)])


LOGIT_STEP = """SELECT seed, fold, feature, b + (h00 * g1 - h10 * g0) / (h11 * h00 - h10 * h10) AS b,
  c + (h11 * g0 - h10 * g1) / (h11 * h00 - h10 * h10) AS c FROM (
  SELECT seed, fold, feature, b, c, sum(z * (response - mu)) - b AS g1, sum(response - mu) - c AS g0,
    sum(z * z * mu * (1 - mu)) + 1 AS h11, sum(z * mu * (1 - mu)) AS h10, sum(mu * (1 - mu)) + 1 AS h00
  FROM (SELECT *, 1 / (1 + exp(-(b * z + c))) AS mu FROM zt JOIN PREVIOUS USING (seed, fold, feature))
  GROUP BY seed, fold, feature, b, c)"""


def single_feature_fits(spark, d, fit, models):
    """Every model on each of its columns alone: (seed, fold, feature, coefficients)."""
    alone = [m.take([c]) for m in models for c in m.cols]
    rows = [(*_named(d, m), d.features[m.cols[0]], b.tolist()) for m, b in zip(alone, fit(alone))]
    return spark.createDataFrame(rows, "seed int, fold int, feature string, b array<double>")


@query("F1_fit_logistic", f"""WITH {fold_rows_sql('response')}, {chained(
    'SELECT DISTINCT seed, fold, feature, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM zt', LOGIT_STEP, 8)}
SELECT seed, fold, feature, round(b, 6) + 0.0 AS beta, round(c, 6) + 0.0 AS intercept FROM n8""")
def f1(spark, sf):
    d = folded(spark, sf, "response")
    fits = single_feature_fits(spark, d, newton.logistic_fitter(d, "response"),
                               newton.fold_models(d, design.learn_folds(d)))
    return rounded(fits.select("seed", "fold", "feature", F.col("b")[0].alias("beta"), F.col("b")[1].alias("intercept")),
                   "beta", "intercept")


COX_STEP = """SELECT seed, fold, feature, b + (sum(e1 - d * s1 / s0) - 0.05 * b) / (sum(d * (s2 / s0 - pow(s1 / s0, 2))) + 0.05) AS b
FROM (SELECT seed, fold, feature, b, d, e1, sum(w0) OVER w AS s0, sum(w1) OVER w AS s1, sum(w2) OVER w AS s2 FROM (
    SELECT seed, fold, feature, b, time, sum(exp(b * z)) AS w0, sum(z * exp(b * z)) AS w1, sum(z * z * exp(b * z)) AS w2,
      sum(event) AS d, sum(z * event) AS e1 FROM zt JOIN PREVIOUS USING (seed, fold, feature) GROUP BY ALL)
  WINDOW w AS (PARTITION BY seed, fold, feature ORDER BY time DESC)) GROUP BY seed, fold, feature, b"""


@query("F2_fit_cox_ridge", f"""WITH {fold_rows_sql('event')}, {chained(
    'SELECT DISTINCT seed, fold, feature, 0.0::DOUBLE AS b FROM zt', COX_STEP, 8)}
SELECT seed, fold, feature, round(b, 6) + 0.0 AS beta, round(exp(b), 6) AS ratio FROM n8""")
def f2(spark, sf):
    d = folded(spark, sf, "event")
    fit = newton.cox_fitter(newton.time_ordered(d, "event", "time"), 0.05)
    fits = single_feature_fits(spark, d, fit, newton.fold_models(d, design.learn_folds(d)))
    beta = fits.select("seed", "fold", "feature", F.col("b")[0].alias("beta"))
    return rounded(beta.withColumn("ratio", F.exp("beta")), "beta", "ratio")


MARKERS = [c for c in FEATURES if c != "qty_sum"]
EFRON_STEP = """SELECT biomarker, model_no, a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a,
  b + (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM (
  SELECT biomarker, model_no, a, b, sum(CASE WHEN l = 0 THEN ea ELSE 0 END - ma) AS ga,
    sum(CASE WHEN l = 0 THEN eb ELSE 0 END - mb) AS gb, sum(saa - ma * ma) AS haa, sum(sab - ma * mb) AS hab,
    sum(sbb - mb * mb) + CAST(model_no < 3 AS INT) AS hbb
  FROM (SELECT biomarker, model_no, a, b, l, ea, eb, (sa - l / d * da) / (s0 - l / d * d0) AS ma, (sb - l / d * db) / (s0 - l / d * d0) AS mb,
      (saa - l / d * daa) / (s0 - l / d * d0) AS saa, (sab - l / d * dab) / (s0 - l / d * d0) AS sab, (sbb - l / d * dbb) / (s0 - l / d * d0) AS sbb
    FROM (SELECT *, sum(w0) OVER w AS s0, sum(wa) OVER w AS sa, sum(wb) OVER w AS sb, sum(waa) OVER w AS saa, sum(wab) OVER w AS sab,
        sum(wbb) OVER w AS sbb FROM (
      SELECT biomarker, model_no, a, b, time, sum(w) AS w0, sum(w * x) AS wa, sum(w * y) AS wb, sum(w * x * x) AS waa, sum(w * x * y) AS wab,
        sum(w * y * y) AS wbb, sum(event) AS d, sum(event * w) AS d0, sum(event * w * x) AS da, sum(event * w * y) AS db,
        sum(event * w * x * x) AS daa, sum(event * w * x * y) AS dab, sum(event * w * y * y) AS dbb, sum(event * x) AS ea, sum(event * y) AS eb
      FROM (SELECT *, exp(a * x + b * y) AS w FROM zz JOIN PREVIOUS USING (biomarker, model_no)) GROUP BY biomarker, model_no, a, b, time)
      WINDOW w AS (PARTITION BY biomarker, model_no ORDER BY time DESC))
    JOIN range(0, 100000) AS r(l) ON l < d)
  GROUP BY biomarker, model_no, a, b)"""


@query("F3_fit_cox_efron", f"""{W}, {split_sql()}, tn AS (SELECT * FROM sp WHERE split = 'train'), {unpivot_sql('tn', FEATURES)},
sc AS (SELECT feature, avg(v) AS mean, stddev_pop(v) AS dev FROM u GROUP BY feature),
z AS (SELECT id, feature, (v - mean) / dev AS z FROM u JOIN sc USING (feature)),
p AS (SELECT m.feature AS biomarker, id, p.z AS p, m.z AS m FROM z m JOIN z p USING (id) WHERE p.feature = 'qty_sum' AND m.feature <> 'qty_sum'),
zz AS MATERIALIZED (SELECT biomarker, model_no, CASE WHEN model_no = 2 THEN m ELSE p END AS x, CASE WHEN model_no = 3 THEN m ELSE 0 END AS y,
  event, time FROM p JOIN f USING (id) CROSS JOIN (VALUES (1), (2), (3)) AS v(model_no)),
{chained('SELECT DISTINCT biomarker, model_no, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM zz', EFRON_STEP, 8)}
SELECT biomarker, model_no, CASE model_no WHEN 1 THEN 'qty_sum' WHEN 2 THEN biomarker ELSE 'qty_sum + ' || biomarker END AS formula,
  round(a / CASE WHEN model_no = 2 THEN sm.dev ELSE sq.dev END, 10) + 0.0 AS beta_1,
  CASE WHEN model_no = 3 THEN round(b / sm.dev, 10) + 0.0 END AS beta_2
FROM n8 JOIN sc sm ON sm.feature = biomarker JOIN sc sq ON sq.feature = 'qty_sum'""")
def f3(spark, sf):
    ready = survival_sides(spark, sf)
    fits = fit_biomarkers(ready.train, "id", "qty_sum", MARKERS, "event", "time").coefficients()
    return rounded(fits.select("biomarker", "model_no", "formula", F.col("beta")[0].alias("beta_1"),
                               F.get("beta", F.lit(1)).alias("beta_2")), "beta_1", "beta_2", digits=10)


def elimination_paths(spark, d, fit, models, mandatory=None, intercept=False):
    at = None if mandatory is None else d.features.index(mandatory)
    paths = newton.eliminate(fit, models, 3, at, intercept)
    return coef_rows(spark, d, [((*_named(d, m), k), cols, beta) for m, path in zip(models, paths)
                                for k, (cols, beta) in sorted(path.items())])


@query("F4_rfe")
def f4(spark, sf):
    d = folded(spark, sf, "response", ALL_FOLDS, ALL_SEEDS)
    return elimination_paths(spark, d, newton.logistic_fitter(d, "response"), newton.fold_models(d, design.learn_folds(d)),
                  intercept=True)


@query("F5_rfe_mandatory")
def f5(spark, sf):
    d = folded(spark, sf, "event", ALL_FOLDS, ALL_SEEDS)
    fit = newton.cox_fitter(newton.time_ordered(d, "event", "time"), 0.05)
    return elimination_paths(spark, d, fit, newton.fold_models(d, design.learn_folds(d)), "qty_sum")


@query("F12_cross_validate_rfe_logistic")
def f12(spark, sf):
    ready = prepare_logistic(held_features(spark, sf, *BASE), "id", FEATURES, "response", ["prio", "seg"], seed=7,
                             drop=("total", "qty_sum"), protect="qty_sum", log_cols=("acctbal",))
    return cross_validate_rfe_logistic(ready.train, ready.test, "id", ready.features, "response", ALL_FOLDS, ALL_SEEDS)


@query("F13_cross_validate_rfe_cox")
def f13(spark, sf):
    ready = prepare_survival(held_features(spark, sf, *BASE), "id", FEATURES, "event", "time", ["prio", "seg"], seed=7,
                             drop=("total", "qty_sum"), protect="qty_sum", log_cols=("acctbal",))
    return cross_validate_rfe_cox(ready.train, ready.test, "id", ready.features, "event", "time", ALL_FOLDS,
                                  ALL_SEEDS, mandatory="qty_sum")


def survival_sides(spark, sf):
    ready = prepare_survival(held_features(spark, sf, *BASE), "id", FEATURES, "event", "time", ["prio", "seg"], seed=7)
    release()       # the sides are read from the written split
    return ready


def report_of(spark, sf):
    ready = survival_sides(spark, sf)
    return survival_report(ready.train, ready.test, "id", "qty_sum", MARKERS, "event", "time", BREAKS)


@query("G5_survival_report")
def g5(spark, sf):
    return report_of(spark, sf).summary


@query("G5_survival_curves")
def g5_curves(spark, sf):
    return report_of(spark, sf).curves


@query("G5_survival_risk")
def g5_risk(spark, sf):
    return report_of(spark, sf).risk


@query("R1_survival_runs")
def r1(spark, sf):
    """Two runs of a run matrix, with and without the protected feature, from files to the box-plot numbers."""
    path = scratch(spark)
    order_features(spark, sf).select(*BASE).write.parquet(f"{path}/orders.parquet")
    for name, cols in (("with", FEATURES), ("without", [c for c in FEATURES if c != "qty_sum"])):
        spark.createDataFrame([(c,) for c in cols], "name string").coalesce(1).write.text(f"{path}/{name}.txt")
    spark.createDataFrame([("orders", s, "event", "time", "['prio', 'seg']", 7, ALL_FOLDS) for s in ("with", "without")],
                          "dataset string, featureset string, event string, time string, cols_to_balance string, "
                          "random_state int, folds int").coalesce(1).write.option("header", True).csv(f"{path}/matrix")
    setup = runs.Setup({"orders": f"{path}/orders.parquet"}, path, f"{path}/out", "id", log_cols=("acctbal",), k_max=2)
    files = {r["featureset"]: runs.survival_run(spark, r, setup, "qty_sum" if r["featureset"] == "with" else None)
             for r in read_run_matrix(spark, f"{path}/matrix")}
    found = {name: hold(read_metrics(spark, f.metrics)) for name, f in files.items()}
    rows = report.union_rows(*[report.select_model_rows(found["with"], found["without"], "qty_sum", marker, d)
                               for marker in ("n_lines", "price_avg") for d in (">1", "<1")]).distinct()
    return report.boxplot_stats(report.model_label(rows), ["Features"],
                                ["Validation_Set_Concordance", "Test_Set_Concordance"])
