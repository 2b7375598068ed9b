"""Sources, sinks, cleaning and joins (A, B, C, H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.operators import clean, profile, report, scoring, split, survival
from cohortry.operators.running import hold
from cohortry.queries.registry import query, r6, rounded, scratch
from cohortry.queries.subjects import (CLEAN_SQL, F_SQL, FEATURES, held_features, order_features, spearman_sql,
                                       split_sql)
from cohortry.sources import tables

W = f"WITH {F_SQL}"
NAMES = ["total", "absent one", "qty_sum", "n_lines", "absent two", "acctbal"]


@query("A1_read_table", f"""{W}, t AS (SELECT prio, count(*) AS n, round(sum(qty_sum), 2) AS qty,
  round(sum(total), 2) AS total FROM f GROUP BY prio)
SELECT 'parquet' AS format, * FROM t UNION ALL SELECT 'csv', * FROM t UNION ALL SELECT 'tab', * FROM t""")
def a1(spark, sf):
    f = order_features(spark, sf).select("id", "prio", "qty_sum", "total")
    path = scratch(spark)
    f.write.parquet(f"{path}/f.PARQUET")
    f.write.option("header", True).csv(f"{path}/f.csv")
    f.write.option("header", True).option("sep", "\t").csv(f"{path}/f.tsv")
    out = [tables.read_table(spark, f"{path}/f.{ext}").groupBy("prio").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("qty_sum"), 2).alias("qty"),
        F.round(F.sum("total"), 2).alias("total")).select(F.lit(name).alias("format"), "*")
        for name, ext in (("parquet", "PARQUET"), ("csv", "csv"), ("tab", "tsv"))]
    return report.union_rows(*out)


def _top_sql(cols, featureset):
    names = ", ".join(f"'{c}'" for c in cols)
    return f"""SELECT 'orders' AS dataset, '{featureset}' AS featureset, feat1, feat2,
      round(abs(rho), 6) AS abs_rho FROM rho WHERE i < j AND rho IS NOT NULL
      AND feat1 IN ({names}) AND feat2 IN ({names})"""


@query("A2_run_matrix", f"""{W}, {spearman_sql('f', FEATURES)}
(SELECT * FROM ({_top_sql(FEATURES[:4], 'small')}) ORDER BY abs_rho DESC, feat1, feat2 LIMIT 3) UNION ALL
(SELECT * FROM ({_top_sql(FEATURES, 'all')}) ORDER BY abs_rho DESC, feat1, feat2 LIMIT 3)""")
def a2(spark, sf):
    path = scratch(spark)
    spark.createDataFrame([("orders", "small", "['prio', 'seg']", 3), ("orders", "all", "['prio']", 3)],
                          "dataset string, featureset string, cols_to_balance string, folds int") \
        .coalesce(1).write.option("header", True).csv(path)
    sets = {"small": FEATURES[:4], "all": FEATURES}
    f = held_features(spark, sf, "id", *FEATURES)

    def analysis(run):
        matrix = profile.spearman_matrix(f, "id", tables.resolve_features(f, sets[run["featureset"]], True))
        return rounded(profile.top_correlations(matrix, 3), "abs_rho")

    runs = sorted(tables.read_run_matrix(spark, path), key=lambda r: r["featureset"], reverse=True)
    return tables.run_matrix(runs, analysis, ("dataset", "featureset"))


@query("A3_resolve_features", f"{W} SELECT id, total, qty_sum, n_lines, acctbal FROM f")
def a3(spark, sf):
    path = scratch(spark)
    spark.createDataFrame([(n,) for n in ["", *NAMES, "  "]], "value string").coalesce(1).write.text(path)
    f = order_features(spark, sf)
    return f.select("id", *tables.resolve_features(f, tables.read_feature_list(spark, path), True))


# Fold-metric rows derived from the orders: the direction of an effect comes from the order's
# priority and segment, the two measures from its average discount and tax.
METRICS_SQL = f"""{F_SQL}, m AS (SELECT id, event, CASE WHEN n_lines <= 3 THEN 1 ELSE 2 END AS NumFeatures,
  disc_avg AS Validation_Set_Concordance, tax_avg AS Test_Set_Concordance,
  CASE substr(prio, 1, 1) WHEN '1' THEN 'qty_sum, price_avg' WHEN '2' THEN 'qty_sum'
    WHEN '3' THEN 'price_avg' WHEN '4' THEN '' ELSE 'qty_sum, acctbal' END AS gt,
  CASE seg WHEN 'BUILDING' THEN 'price_avg' WHEN 'MACHINERY' THEN '' ELSE 'acctbal' END AS lt FROM f)"""


def metric_rows(spark, sf):
    prio = F.substring("prio", 1, 1)
    gt = (F.when(prio == "1", F.array(F.lit("qty_sum"), F.lit("price_avg")))
          .when(prio == "2", F.array(F.lit("qty_sum"))).when(prio == "3", F.array(F.lit("price_avg")))
          .when(prio == "4", F.array().cast("array<string>"))
          .otherwise(F.array(F.lit("qty_sum"), F.lit("acctbal"))))
    lt = (F.when(F.col("seg") == "BUILDING", F.array(F.lit("price_avg")))
          .when(F.col("seg") == "MACHINERY", F.array().cast("array<string>"))
          .otherwise(F.array(F.lit("acctbal"))))
    return order_features(spark, sf).select(
        "id", "event", F.when(F.col("n_lines") <= 3, 1).otherwise(2).alias("NumFeatures"),
        F.col("disc_avg").alias("Validation_Set_Concordance"), F.col("tax_avg").alias("Test_Set_Concordance"),
        gt.alias(report.ABOVE), lt.alias(report.BELOW))


def joined_metrics(spark, sf):
    m = metric_rows(spark, sf)
    return m.withColumns({c: F.array_join(f"`{c}`", ", ") for c in (report.ABOVE, report.BELOW)})


@query("A4_write_metrics", f"""WITH {METRICS_SQL} SELECT id, NumFeatures, Validation_Set_Concordance,
  Test_Set_Concordance, gt AS "HR > 1 Features", lt AS "HR < 1 Features" FROM m""")
def a4(spark, sf):
    path = scratch(spark)
    tables.write_metrics(metric_rows(spark, sf).select("id", *tables.SURVIVAL_METRICS), path)
    back = tables.read_metrics(spark, path)
    return back.withColumn("id", F.col("id").cast("bigint"))


@query("A5_write_split", f"{W}, {split_sql()} SELECT id, split, qty_sum, acctbal, response FROM sp")
def a5(spark, sf):
    path = scratch(spark)
    f = held_features(spark, sf, "id", "prio", "seg", "qty_sum", "acctbal", "response")
    placed = split.stratified_split(clean.strat_key(f, ["prio", "seg"]), "id", "strat_col", seed=7)
    sides = {s: placed.where(F.col("split") == s).drop("split") for s in ("train", "test")}
    tables.write_split(sides["train"], sides["test"], path, "id", ["qty_sum", "acctbal"], ["response"])
    return report.union_rows(*[scoring.attach_outcome(
        tables.read_split(spark, path, "X", s), tables.read_split(spark, path, "y", s), "id")
        .withColumn("split", F.lit(s)) for s in ("train", "test")])


A6_COLS = ["qty_sum", "price_avg", "acctbal", "const_col"]


@query("A6_write_corr_matrix", f"{W}, {spearman_sql('f', A6_COLS)} SELECT feat1 AS feature, " + ", ".join(
    f"max(CASE WHEN feat2 = '{c}' THEN round(rho, 5) + 0.0 END) AS {c}" for c in A6_COLS)
    + " FROM rho GROUP BY feat1")
def a6(spark, sf):
    path = scratch(spark)
    tables.write_corr_matrix(profile.spearman_matrix(held_features(spark, sf, "id", *A6_COLS), "id", A6_COLS), A6_COLS, path)
    back = tables.read_table(spark, path, None) if path.endswith(".csv") else \
        spark.read.option("header", True).csv(path)
    return back.select("feature", *[(F.col(c).cast("double") + 0.0).alias(c) for c in A6_COLS])


# --- B ------------------------------------------------------------------------------------------

@query("B1_replace_sentinels", f"""{W} SELECT id, CASE WHEN total_txt NOT IN ('No Data', '#VALUE!')
  THEN total_txt END AS total_txt FROM f""")
def b1(spark, sf):
    return clean.replace_sentinels(order_features(spark, sf).select("id", "total_txt"), ["total_txt"])


@query("B2_coerce_numeric", f"{W} SELECT id, try_cast(total_txt AS DOUBLE) AS total_txt, n_lines FROM f")
def b2(spark, sf):
    return clean.coerce_numeric(order_features(spark, sf).select("id", "total_txt", "n_lines"),
                                ["total_txt", "n_lines"])


@query("B3_drop_incomplete", f"{W}, {CLEAN_SQL} SELECT id, total_num, acctbal FROM c WHERE total_num IS NOT NULL")
def b3(spark, sf):
    f = clean.coerce_numeric(order_features(spark, sf).select("id", F.col("total_txt").alias("total_num"), "acctbal"),
                             ["total_num", "acctbal"])
    return clean.drop_incomplete(f, ["total_num", "acctbal"])


@query("B4_na_profile", f"""{W}, {CLEAN_SQL}, n AS (SELECT count(*) AS rows_before,
  count(*) FILTER (WHERE total_num IS NULL) AS missing FROM c)
SELECT feature, CASE WHEN feature = 'total_num' THEN missing ELSE 0 END AS n_missing, rows_before, 4 AS n_cols,
  missing AS rows_with_missing, rows_before - missing AS rows_after
FROM n CROSS JOIN (VALUES ('total_num'), ('acctbal'), ('n_lines'), ('qty_sum')) AS v(feature)""")
def b4(spark, sf):
    cols = ["total_num", "acctbal", "n_lines", "qty_sum"]
    f = order_features(spark, sf).withColumn("total_num", F.col("total_txt"))
    return clean.na_profile(clean.coerce_numeric(clean.replace_sentinels(f, cols), cols), cols)


@query("B5_drop_columns", f"{W} SELECT qty_sum, id, prio, response, price_avg, acctbal, "
       "'disc_avg,event,n_lines,seg,tax_avg,time,total,total_txt' AS dropped FROM f")
def b5(spark, sf):
    f = order_features(spark, sf).drop("const_col")
    slim, gone = clean.drop_columns(f, ["seg", "event", "time", "n_lines", "qty_sum", "disc_avg", "tax_avg",
                                        "total", "total_txt", "not there"], "qty_sum")
    return slim.withColumn("dropped", F.lit(",".join(sorted(gone))))


@query("B6_align_columns", f"{W}, {split_sql()} SELECT acctbal, qty_sum, id FROM sp WHERE split = 'test'")
def b6(spark, sf):
    f = held_features(spark, sf, "id", "prio", "seg", "qty_sum", "acctbal")
    placed = split.stratified_split(clean.strat_key(f, ["prio", "seg"]), "id", "strat_col", seed=7)
    like = placed.where("split = 'train'").select("acctbal", "qty_sum", "id")
    return clean.align_columns(placed.where("split = 'test'"), like)


@query("B7_strat_key", f"""{W}, {CLEAN_SQL} SELECT id, prio || '_' || coalesce(CAST(response AS VARCHAR), 'nan')
  || '_' || CASE WHEN total_txt IS NULL THEN 'nan' ELSE seg END AS strat_col FROM c""")
def b7(spark, sf):
    f = order_features(spark, sf).withColumn("seg", F.when(F.col("total_txt").isNotNull(), F.col("seg")))
    return clean.strat_key(f, ["prio", "response", "seg"]).select("id", "strat_col")


@query("B8_log_transform", f"""{W}, lo AS (SELECT min(acctbal) AS a, min(time) AS t, min(total) AS p FROM f)
SELECT id, acctbal, round(ln(acctbal + CASE WHEN a <= 0 THEN abs(a) + 1e-6 ELSE 0 END), 6) + 0.0 AS acctbal_log,
  round(ln(time + CASE WHEN t <= 0 THEN abs(t) + 1e-6 ELSE 0 END), 6) + 0.0 AS time_log,
  round(ln(total + CASE WHEN p <= 0 THEN abs(p) + 1e-6 ELSE 0 END), 6) + 0.0 AS total_log FROM f CROSS JOIN lo""")
def b8(spark, sf):
    f = clean.log_transform(held_features(spark, sf, "id", "acctbal", "time", "total"), ["acctbal", "time", "total"])
    return rounded(f.select("id", "acctbal", "acctbal_log", "time_log", "total_log"),
                   "acctbal_log", "time_log", "total_log")


@query("B9_cast_outcome", f"""{W} SELECT id, CAST(trunc(disc_avg * 20) AS INT) AS response, event = 1 AS event, time FROM f""")
def b9(spark, sf):
    f = order_features(spark, sf).select("id", (F.col("disc_avg") * 20).alias("response"), "event",
                                         F.col("time").cast("int").alias("time"))
    return clean.cast_outcome(f, "response", "event", "time")


@query("B10_map_values", f"""{W} SELECT id, CASE WHEN prio LIKE '1%' THEN NULL ELSE event END AS event_num FROM f""")
def b10(spark, sf):
    text = F.when(F.col("prio").startswith("1"), "unknown").when(F.col("event") == 1, "True").otherwise("False")
    return clean.map_values(order_features(spark, sf).withColumn("event_txt", text), "event_txt",
                            {"False": 0, "True": 1}, "event_num").select("id", "event_num")


SELECTED_SQL = f"""WITH {METRICS_SQL}, sel AS (
SELECT '>1' AS direction, 'alone' AS kind, * FROM m WHERE event = 1 AND NumFeatures = 1 AND gt = 'qty_sum'
UNION ALL SELECT '<1', 'alone', * FROM m WHERE event = 1 AND NumFeatures = 1 AND gt = 'qty_sum'
UNION ALL SELECT '>1', 'marker', * FROM m WHERE event = 0 AND NumFeatures = 1 AND gt = 'price_avg'
UNION ALL SELECT '<1', 'marker', * FROM m WHERE event = 0 AND NumFeatures = 1 AND lt = 'price_avg'
UNION ALL SELECT '>1', 'both', * FROM m WHERE event = 1 AND NumFeatures = 2 AND gt = 'qty_sum, price_avg'
UNION ALL SELECT '<1', 'both', * FROM m WHERE event = 1 AND NumFeatures = 2 AND lt = 'price_avg')"""


def selected(spark, sf, shown_as=None):
    m = hold(joined_metrics(spark, sf))
    with_p, without = m.where("event = 1"), m.where("event = 0")
    return report.union_rows(*[report.select_model_rows(with_p, without, "qty_sum", "price_avg", d, shown_as)
                               .withColumn("direction", F.lit(d)) for d in (">1", "<1")])


@query("B11_select_model_rows", f"""{SELECTED_SQL} SELECT direction, id, NumFeatures, Validation_Set_Concordance,
  Test_Set_Concordance, gt AS "HR > 1 Features", lt AS "HR < 1 Features" FROM sel""")
def b11(spark, sf):
    return selected(spark, sf).drop("event")


LABEL_SQL = f"""{SELECTED_SQL}, shown AS (SELECT *, CASE WHEN kind = 'marker' THEN gt
    WHEN kind = 'both' AND direction = '>1' THEN 'kept,  price_avg' WHEN gt = 'qty_sum' THEN 'kept' ELSE gt END AS g
  FROM sel), lab AS (SELECT *, concat_ws('+', nullif(g, ''), nullif(lt, '')) AS Features FROM shown)"""


@query("B12_model_label", f"{LABEL_SQL} SELECT direction, id, Features FROM lab")
def b12(spark, sf):
    return report.model_label(selected(spark, sf, "kept")).select("direction", "id", "Features")


B13_SQL = f"""{W}, q AS (SELECT seg, quantile_cont(total, 0.5) AS threshold FROM f GROUP BY seg)
SELECT id, seg, round(threshold, 6) + 0.0 AS threshold, CASE WHEN total > threshold THEN 'Upper' ELSE 'Lower' END AS grp
FROM f JOIN q USING (seg)"""


@query("B13_split_at_quantile", B13_SQL)
def b13(spark, sf):
    f = held_features(spark, sf, "id", "seg", "total")
    return rounded(survival.split_at_quantile(f, ["seg"], "total").drop("total"), "threshold")


@query("B13_split_at_quantile_ranged", B13_SQL)
def b13_ranged(spark, sf):
    f = held_features(spark, sf, "id", "seg", "total")
    cut = survival.split_at_quantile(f, ["seg"], "total", window_rows=0, partition_rows=500)
    return rounded(cut.drop("total"), "threshold")


# --- C, H ---------------------------------------------------------------------------------------

@query("C1_attach_outcome", f"{W} SELECT id, qty_sum, acctbal, event, time FROM f")
def c1(spark, sf):
    f = order_features(spark, sf)
    return scoring.attach_outcome(f.select("id", "qty_sum", "acctbal"), f.select("id", "event", "time"), "id")


@query("C3_feature_pairs", f"""{W}, {spearman_sql('f', FEATURES)} SELECT feat1, feat2, n FROM rho WHERE i < j""")
def c3(spark, sf):
    # The pairs as they are used: beside what the subjects say about them.
    f = held_features(spark, sf, "id", *FEATURES)
    matrix = profile.spearman_matrix(f, "id", FEATURES)
    return profile.feature_pairs(f, FEATURES).join(matrix.drop("i", "j"), ["feat1", "feat2"]).select("feat1", "feat2", "n")


@query("E11_max_metric", f"""{SELECTED_SQL} SELECT direction, max(Test_Set_Concordance) AS max_test,
  max(Validation_Set_Concordance) AS max_validation FROM sel WHERE kind = 'both' GROUP BY direction""")
def e11(spark, sf):
    m = joined_metrics(spark, sf).where("event = 1")
    return report.union_rows(*[report.max_metric(report.two_feature_rows(m, "qty_sum", "price_avg", d))
                               .withColumn("direction", F.lit(d)) for d in (">1", "<1")])


@query("E12_boxplot_stats", f"""{LABEL_SQL}, v AS (
  SELECT Features, 'Validation_Set_Concordance' AS metric, Validation_Set_Concordance AS value FROM lab
  UNION ALL SELECT Features, 'Test_Set_Concordance', Test_Set_Concordance FROM lab),
q AS (SELECT Features, metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.75) AS q3 FROM v GROUP BY ALL),
w AS (SELECT *, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM v JOIN q USING (Features, metric))
SELECT Features, metric, {r6('q1', 'median', 'q3', digits=9)}, min(value) FILTER (WHERE inside) AS whisker_low,
  max(value) FILTER (WHERE inside) AS whisker_high, count(*) AS n, count(*) FILTER (WHERE NOT inside) AS n_outliers
FROM w GROUP BY Features, metric, q1, median, q3""")
def e12(spark, sf):
    rows = report.model_label(selected(spark, sf, "kept"))
    return rounded(report.boxplot_stats(rows, ["Features"], ["Validation_Set_Concordance", "Test_Set_Concordance"]),
                   "q1", "median", "q3", digits=9)


@query("H1_union_rows", f"""{W}, {split_sql()} SELECT id, split FROM sp UNION ALL
SELECT id, 'again' FROM sp WHERE split = 'test'""")
def h1(spark, sf):
    f = held_features(spark, sf, "id", "prio", "seg")
    placed = split.stratified_split(clean.strat_key(f, ["prio", "seg"]), "id", "strat_col", seed=7).select("id", "split")
    train, test = placed.where("split = 'train'"), placed.where("split = 'test'")
    return report.union_rows(train, test, test.withColumn("split", F.lit("again")))
