"""Splits, fold preparation, profiles and metrics (C2, C4, C5, D, E, F6-F11, H2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.operators import clean, design, profile, report, scoring, split
from cohortry.plans.preparation import prepare_logistic
from cohortry.queries.registry import query, r6, rounded
from cohortry.queries.subjects import (F_SQL, FEATURES, fold_sql, held_features, order_features, spearman_sql, split_sql,
                                       unpivot_sql)

W = f"WITH {F_SQL}"
SEEDS, K = [1, 2], 3
PREP = ["qty_sum", "price_avg", "acctbal", "const_col"]
WITH_CONST = FEATURES + ["const_col"]


def strata(spark, sf):
    return clean.strat_key(held_features(spark, sf, "id", "prio", "seg"), ["prio", "seg"])


@query("D1_stratified_split", f"{W}, {split_sql()} SELECT id, strat_col, split FROM sp")
def d1(spark, sf):
    return split.stratified_split(strata(spark, sf).select("id", "strat_col"), "id", "strat_col", seed=7)


@query("D2_stratified_kfold", f"""{W}, {fold_sql('f', 'event', 5, [1, 2, 3])}
SELECT id, event, seed, fold FROM fo""")
def d2(spark, sf):
    folded = split.stratified_kfold(held_features(spark, sf, "id", "event"), "id", "event", 5, [1, 2, 3])
    return folded.select("id", "event", F.posexplode("folds").alias("seed", "fold")) \
                 .withColumn("seed", F.col("seed") + 1)


@query("E10_value_counts", f"""{W}, {split_sql()}, n AS (SELECT split, strat_col, count(*) AS n,
  row_number() OVER (PARTITION BY split ORDER BY count(*) DESC, strat_col) AS place FROM sp GROUP BY split, strat_col)
SELECT split, strat_col, n FROM n WHERE place <= 5""")
def e10(spark, sf):
    placed = split.stratified_split(strata(spark, sf).select("id", "strat_col"), "id", "strat_col", seed=7)
    return split.value_counts(placed, "strat_col", by="split")


# --- learnt on training folds -------------------------------------------------------------------

TRAIN_SQL = f"""{F_SQL}, {fold_sql('f', 'response', K, SEEDS)}, {unpivot_sql('f', PREP)},
tr AS (SELECT fo.seed, g.fold, feature, v FROM fo JOIN u USING (id)
  JOIN (VALUES (0), (1), (2)) AS g(fold) ON fo.fold <> g.fold)"""
CLIP_SQL = """q AS (SELECT seed, fold, feature, quantile_cont(v, 0.005) AS low, quantile_cont(v, 0.995) AS high,
  count(*) AS n FROM tr GROUP BY ALL),
sc AS (SELECT seed, fold, feature, avg(least(greatest(v, low), high)) AS mean,
  stddev_pop(least(greatest(v, low), high)) AS dev FROM tr JOIN q USING (seed, fold, feature) GROUP BY ALL)"""


def folds(spark, sf, features=PREP):
    f = held_features(spark, sf, "id", "response", *features)
    folded = split.stratified_kfold(f, "id", "response", K, SEEDS)
    return design.design_table(folded, "id", features, ["response"], SEEDS, K)


@query("E1_variance_filter", f"""WITH {TRAIN_SQL} SELECT seed, fold, feature, count(*) AS n, round(var_pop(v), 4) + 0.0 AS var,
  var_pop(v) > 1e-8 AS keep FROM tr GROUP BY seed, fold, feature""")
def e1(spark, sf):
    d = folds(spark, sf)
    return rounded(design.prep_long(d, design.fold_variances(d)).select("seed", "fold", "feature", "n", "var", "keep"),
                   "var", digits=4)


@query("E2_winsorize", f"""WITH {TRAIN_SQL}, {CLIP_SQL} SELECT seed, fold, feature, n, {r6('low', 'high')} FROM q""")
def e2(spark, sf):
    d = folds(spark, sf)
    bounds = design.winsor_bounds(d, design.fold_variances(d))
    return rounded(design.prep_long(d, bounds).select("seed", "fold", "feature", "n", "low", "high"), "low", "high")


@query("E3_standardize", f"""WITH {TRAIN_SQL}, {CLIP_SQL} SELECT seed, fold, feature, round(mean, 5) + 0.0 AS mean,
  round(CASE WHEN dev > 1e-12 THEN dev ELSE 1 END, 5) + 0.0 AS scale FROM sc""")
def e3(spark, sf):
    d = folds(spark, sf)
    return rounded(design.prep_long(d, design.learn_folds(d)).select("seed", "fold", "feature", "mean", "scale"),
                   "mean", "scale", digits=5)


@query("C2_apply_fold_params", f"""WITH {TRAIN_SQL}, {CLIP_SQL}, z AS (SELECT id, m.seed, m.fold, feature,
  CASE WHEN fo.fold = m.fold THEN 'validation' ELSE 'train' END AS part,
  round((least(greatest(v, low), high) - mean) / CASE WHEN dev > 1e-12 THEN dev ELSE 1 END, 6) + 0.0 AS z
  FROM u JOIN (SELECT * FROM q JOIN sc USING (seed, fold, feature)) m USING (feature)
  JOIN fo USING (id, seed))
SELECT id, seed, fold, part, max(CASE WHEN feature = 'qty_sum' THEN z END) AS z_qty_sum,
  max(CASE WHEN feature = 'price_avg' THEN z END) AS z_price_avg, max(CASE WHEN feature = 'acctbal' THEN z END) AS z_acctbal
FROM z GROUP BY id, seed, fold, part""")
def c2(spark, sf):
    d = folds(spark, sf)
    applied = design.apply_fold_params(d.rows, design.prep_frame(d, design.learn_folds(d)), SEEDS, K, len(PREP))
    return rounded(applied.select("id", "seed", "fold", "part", *[
        F.col("z")[i].alias(f"z_{c}") for i, c in enumerate(PREP[:3])]), *[f"z_{c}" for c in PREP[:3]])


# --- profiles -----------------------------------------------------------------------------------

@query("E4_spearman_matrix", f"""{W}, {spearman_sql('f', WITH_CONST)}
SELECT feat1, feat2, n, {r6('rho')} FROM rho""")
def e4(spark, sf):
    matrix = profile.spearman_matrix(held_features(spark, sf, "id", *WITH_CONST), "id", WITH_CONST)
    return rounded(matrix.select("feat1", "feat2", "n", "rho"), "rho")


@query("E5_top_correlations", f"""{W}, {spearman_sql('f', WITH_CONST)} SELECT feat1, feat2, round(abs(rho), 6) AS abs_rho
FROM rho WHERE i < j AND rho IS NOT NULL ORDER BY abs(rho) DESC, feat1, feat2 LIMIT 10""")
def e5(spark, sf):
    return rounded(profile.top_correlations(profile.spearman_matrix(held_features(spark, sf, "id", *WITH_CONST), "id", WITH_CONST)),
                   "abs_rho")


# The tail is integrated numerically: with t = sqrt(dof) tan(a) the density is cos(a)^(dof-1).
@query("E6_spearman_test", f"""{W}, {spearman_sql('f', FEATURES)},
t AS (SELECT feat1, feat2, rho, n, n - 2 AS dof, rho * sqrt((n - 2) / (1 - rho * rho)) AS t FROM rho WHERE i < j),
b AS (SELECT *, atan(abs(t) / sqrt(dof)) AS a FROM t),
g AS (SELECT *, least(pi() / 2, acos(greatest(cos(a) * exp(-60.0 / (dof - 1)), 0))) AS z FROM b),
s AS (SELECT feat1, feat2, rho, n, t, sum(CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
  * exp(lgamma((dof + 1) / 2.0) - lgamma(dof / 2.0) - 0.5 * ln(pi())
    + (dof - 1) * ln(greatest(cos(a + (z - a) * k / 4000.0), 1e-300)))) * max(z - a) / 4000.0 / 3 * 2 AS p
  FROM g CROSS JOIN range(0, 4001) AS r(k) GROUP BY ALL)
SELECT feat1, feat2, n, round(rho, 6) + 0.0 AS rho, round(t, 5) + 0.0 AS t, round(least(p, 1), 6) + 0.0 AS p_value FROM s""")
def e6(spark, sf):
    f = held_features(spark, sf, "id", *FEATURES)
    tests = profile.spearman_test(profile.spearman_matrix(f, "id", FEATURES), profile.feature_pairs(f, FEATURES))
    return rounded(rounded(tests, "rho", "p_value"), "t", digits=5)


NEAR = FEATURES + ["total_copy"]


@query("E7_drop_correlated", f"""{W}, f2 AS (SELECT *, total * 2 + 1 AS total_copy FROM f), {spearman_sql('f2', NEAR)},
near AS (SELECT i, list(j) AS js FROM rho WHERE i < j AND abs(rho) > 0.8 AND feat2 <> 'qty_sum' GROUP BY i),
each AS (SELECT i, feat1, coalesce(js, []) AS js FROM (SELECT DISTINCT i, feat1 FROM rho) LEFT JOIN near USING (i)),
walk AS (SELECT list_reduce(list_prepend({{'i': -1, 'js': []::BIGINT[]}}, list({{'i': i, 'js': js::BIGINT[]}} ORDER BY i)),
  lambda acc, x: {{'i': -1, 'js': CASE WHEN list_contains(acc.js, x.i) OR x.i = 1 THEN acc.js
    ELSE list_concat(acc.js, x.js) END}}).js AS gone FROM each)
SELECT feat1 AS feature, NOT list_contains(gone, i) AS kept FROM each CROSS JOIN walk""")
def e7(spark, sf):
    f = held_features(spark, sf, "id", *FEATURES).withColumn("total_copy", F.col("total") * 2 + 1)
    kept = profile.drop_correlated(profile.spearman_matrix(f, "id", NEAR), NEAR, 0.8, ("qty_sum",))
    return spark.createDataFrame([(c, c in kept) for c in NEAR], "feature string, kept boolean")


@query("E8_skew_profile", f"""{W}, {unpivot_sql('f', WITH_CONST)}, m AS (SELECT feature, v - avg(v) OVER (PARTITION BY feature) AS c FROM u),
s AS (SELECT feature, CASE WHEN avg(c * c) > 0 THEN avg(c * c * c) / pow(avg(c * c), 1.5) END AS skew FROM m GROUP BY feature)
SELECT feature, {r6('skew')}, CASE WHEN abs(skew) < {profile.SKEW_BOUND} THEN '{profile.NEAR_NORMAL}' WHEN skew > {profile.SKEW_BOUND}
  THEN '{profile.RIGHT_SKEWED}' ELSE '{profile.LEFT_SKEWED}' END AS comment FROM s""")
def e8(spark, sf):
    return rounded(profile.skew_profile(order_features(spark, sf), WITH_CONST), "skew")


@query("E9_histogram", f"""{W}, {unpivot_sql('f', WITH_CONST)},
e AS (SELECT feature, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
  CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM u GROUP BY feature),
p AS (SELECT feature, lo, (hi - lo) / 30 AS step, v, least(CAST(floor((v - lo) / ((hi - lo) / 30)) AS INT), 29) AS pos
  FROM u JOIN e USING (feature)),
b AS (SELECT feature, pos - CAST(v < lo + pos * step AS INT) + CAST(pos < 29 AND v >= lo + (pos + 1) * step AS INT) AS bin, count(*) AS n
  FROM p GROUP BY ALL)
SELECT feature, bin, round(lo + bin * ((hi - lo) / 30), 6) + 0.0 AS lower, round(lo + (bin + 1) * ((hi - lo) / 30), 6) + 0.0 AS upper,
  coalesce(n, 0) AS n FROM (SELECT feature, lo, hi, CAST(k AS INT) AS bin FROM e CROSS JOIN range(0, 30) AS r(k))
LEFT JOIN b USING (feature, bin)""")
def e9(spark, sf):
    return rounded(profile.histogram(held_features(spark, sf, *WITH_CONST), WITH_CONST), "lower", "upper")


@query("H2_top_k", f"""{W}, {split_sql()}, tr AS (SELECT * FROM sp WHERE split = 'train'), {spearman_sql('tr', FEATURES)}
SELECT feat1, feat2, round(abs(rho), 6) AS abs_rho FROM rho WHERE i < j ORDER BY abs(rho) DESC, feat1, feat2 LIMIT 20""")
def h2(spark, sf):
    ready = prepare_logistic(held_features(spark, sf, "id", "prio", "seg", "response", *FEATURES), "id", FEATURES, "response", ["prio", "seg"], seed=7,
                             drop=("total",), protect="qty_sum", report=True)
    return rounded(ready.top_pairs, "abs_rho")


# --- scores -------------------------------------------------------------------------------------

SMALL = ["n_lines", "disc_avg", "tax_avg"]
# One coefficient per segment and feature: the difference of the class means; the centre is the mean.
COEF_SQL = """co AS (SELECT seg, {0} FROM f GROUP BY seg)""".format(", ".join(
    f"round(avg(CASE WHEN response = 1 THEN {c} END) - avg(CASE WHEN response = 0 THEN {c} END), 8) AS b{i}, "
    f"round(avg({c}), 8) AS m{i}" for i, c in enumerate(SMALL)))


def mean_gap(c, label):
    return F.round(F.avg(F.when(F.col(label) == 1, F.col(c))) - F.avg(F.when(F.col(label) == 0, F.col(c))), 8)


def segment_coefs(f, label="response"):
    return f.groupBy("seg").agg(
        F.array(*[mean_gap(c, label) for c in SMALL]).alias("beta"),
        F.array(*[F.round(F.avg(c), 8) for c in SMALL]).alias("center"),
        F.array(*[F.lit(c) for c in SMALL]).alias("features"))


@query("F6_effect_direction", f"""{W}, {COEF_SQL}, l AS ({' UNION ALL '.join(
    f"SELECT seg, {i} AS i, '{c}' AS name, exp(b{i}) AS ratio FROM co" for i, c in enumerate(SMALL))})
SELECT seg, round(max(CASE WHEN i = 0 THEN ratio END), 6) AS ratio_n_lines,
  coalesce(string_agg(name, ', ' ORDER BY i) FILTER (WHERE ratio > 1), '') AS above,
  coalesce(string_agg(name, ', ' ORDER BY i) FILTER (WHERE ratio <= 1), '') AS below FROM l GROUP BY seg""")
def f6(spark, sf):
    out = scoring.effect_direction(segment_coefs(order_features(spark, sf)))
    return out.select("seg", F.round(F.col("ratio")[0], 6).alias("ratio_n_lines"),
                      F.array_join("above", ", ").alias("above"), F.array_join("below", ", ").alias("below"))


DOT = " + ".join(f"b{i} * {c}" for i, c in enumerate(SMALL))
DOT_MEAN = " + ".join(f"b{i} * m{i}" for i in range(len(SMALL)))


@query("F7_score", f"""{W}, {COEF_SQL} SELECT id, seg, round({DOT} - ({DOT_MEAN}), 8) + 0.0 AS score,
  CAST({DOT} - ({DOT_MEAN}) > 0 AS INT) AS predicted, round(exp({DOT} - ({DOT_MEAN})), 8) AS relative_risk
FROM f JOIN co USING (seg)""")
def f7(spark, sf):
    f = order_features(spark, sf)
    coefs = segment_coefs(f).withColumn("b0", -scoring.dot([F.col("center")[i] for i in range(len(SMALL))], F.col("beta")))
    scored = scoring.linear_score(f, SMALL, coefs, ["seg"], intercept="b0", center="center")
    # With the intercept in the score the risk relative to the centre is exp(score) itself.
    out = scored.select("id", "seg", "score", "predicted", F.exp("score").alias("relative_risk"))
    return rounded(out, "score", "relative_risk", digits=8)


def centred_sql(table):
    return " + ".join(f"{table}.b{i} * ({c} - {table}.m{i})" for i, c in enumerate(SMALL))


@query("C5_attach_scores", f"""{W}, {COEF_SQL}, {COEF_SQL.replace('co AS', 'ce AS').replace('response', 'event')}
SELECT id, time AS followup, event AS dead, round(exp({centred_sql('co')}), 3) AS RelativeRisk_1,
  round(exp({centred_sql('ce')}), 3) AS RelativeRisk_2 FROM f JOIN co USING (seg) JOIN ce USING (seg)""")
def c5(spark, sf):
    f = held_features(spark, sf, "id", "seg", "response", "event", "time", *SMALL)
    scores = report.union_rows(*[
        scoring.linear_score(f, SMALL, segment_coefs(f, label), ["seg"], center="center")
        .select("id", F.lit(name).alias("model"), "relative_risk")
        for name, label in (("m1", "response"), ("m2", "event"))])
    base = f.select("id", F.col("time").alias("followup"), F.col("event").alias("dead"))
    return rounded(scoring.attach_scores(base, scores, "id", ["m1", "m2"]), "RelativeRisk_1", "RelativeRisk_2", digits=3)


# --- metrics of a fixed score -------------------------------------------------------------------

def fixed_score(spark, sf):
    return order_features(spark, sf).select(
        "id", "seg", "prio", "response", "event", "time",
        (F.col("qty_sum") * 2 - F.col("n_lines") * 30).alias("score"))


SCORE_SQL = f"{F_SQL}, s AS (SELECT *, 2 * qty_sum - 30 * n_lines AS score FROM f)"


F8_SQL = f"""WITH {SCORE_SQL}, r AS (SELECT seg, response, rank() OVER (PARTITION BY seg ORDER BY score)
  + (count(*) OVER (PARTITION BY seg, score) - 1) / 2.0 AS r FROM s),
n AS (SELECT seg, sum(response) AS p, count(*) - sum(response) AS q, sum(r) FILTER (WHERE response = 1) AS w FROM r GROUP BY seg)
SELECT seg, CAST(p AS BIGINT) AS n_pos, CAST(q AS BIGINT) AS n_neg, round((w - p * (p + 1) / 2.0) / (CAST(p AS DOUBLE) * q), 6) AS auc FROM n"""


@query("F8_roc_auc", F8_SQL)
def f8(spark, sf):
    return rounded(scoring.roc_auc(fixed_score(spark, sf), ["seg"], "score", "response")
                   .select("seg", "n_pos", "n_neg", "auc"), "auc")


@query("F8_roc_auc_ranged", F8_SQL)
def f8_ranged(spark, sf):
    return rounded(scoring.roc_auc(fixed_score(spark, sf), ["seg"], "score", "response", window_rows=0, partition_rows=500)
                   .select("seg", "n_pos", "n_neg", "auc"), "auc")


@query("F9_accuracy", f"""WITH {SCORE_SQL} SELECT seg, round(avg(CAST(CAST(score > 0 AS INT) = response AS INT)), 6) AS accuracy
FROM s GROUP BY seg""")
def f9(spark, sf):
    s = fixed_score(spark, sf).withColumn("predicted", (F.col("score") > 0).cast("int"))
    return rounded(scoring.accuracy(s, ["seg"], "predicted", "response"), "accuracy")


def pairs_sql(key):
    return f"""c AS (SELECT {key} AS k, score, time, event, count(*) AS n FROM s GROUP BY ALL),
pr AS (SELECT a.k, coalesce(sum(a.n * b.n) FILTER (WHERE a.score - b.score > 1e-8), 0) AS concordant,
  coalesce(sum(a.n * b.n) FILTER (WHERE b.score - a.score > 1e-8), 0) AS discordant,
  coalesce(sum(a.n * b.n) FILTER (WHERE abs(a.score - b.score) <= 1e-8), 0) AS tied
  FROM c a JOIN c b ON a.k = b.k AND a.time <= b.time AND a.event = 1
    AND (a.time < b.time OR b.event = 0) GROUP BY a.k)"""


PAIR_COUNTS = ("CAST(concordant AS BIGINT) AS concordant, CAST(discordant AS BIGINT) AS discordant, "
               "CAST(tied AS BIGINT) AS tied")


# The routes for tables beyond one window, at the size of the test tables.
LARGE = {"window_rows": 0, "partition_rows": 500}


def whole(pairs):
    """Pair counts as 64-bit numbers, which these tables fit."""
    return pairs.withColumns({c: F.col(c).cast("bigint") for c in ("concordant", "discordant", "tied")})


@query("C4_comparable_pairs", f"WITH {SCORE_SQL}, {pairs_sql('prio')} SELECT k AS prio, {PAIR_COUNTS} FROM pr")
def c4(spark, sf):
    # Every key by the route for large keys.
    return whole(scoring.comparable_pairs(fixed_score(spark, sf), ["prio"], "score", "time", "event", local_rows=0, **LARGE))


@query("F10_concordance_half", f"""WITH {SCORE_SQL}, {pairs_sql('seg')} SELECT k AS seg, {PAIR_COUNTS},
  round((concordant + tied / 2.0) / (concordant + discordant + tied), 6) AS c_index FROM pr""")
def f10(spark, sf):
    pairs = scoring.comparable_pairs(fixed_score(spark, sf), ["seg"], "score", "time", "event")
    return rounded(whole(scoring.concordance(pairs, "half")).drop("status"), "c_index")


@query("F11_concordance_drop", f"""WITH {SCORE_SQL}, {pairs_sql('1')} SELECT {PAIR_COUNTS},
  round(concordant / CAST(concordant + discordant AS DOUBLE), 6) AS c_index FROM pr""")
def f11(spark, sf):
    pairs = scoring.comparable_pairs(fixed_score(spark, sf), [], "score", "time", "event")
    return rounded(whole(scoring.concordance(pairs, "drop")).drop("status"), "c_index")
