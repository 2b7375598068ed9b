"""The survival report of one marker, with SQL from the fits to the tests (G5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.plans.survival_report import survival_report
from cohortry.queries.modelling import BREAKS, EFRON_STEP, KM_OUT, MEDIAN_SQL, W, chained, km_sql, survival_sides
from cohortry.queries.registry import query, rounded
from cohortry.queries.subjects import FEATURES, split_sql, unpivot_sql

MARKER = "price_avg"
NUMBER = ("CASE WHEN {v} = floor({v}) THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) ELSE CAST({v} AS VARCHAR) END")

SCORED = f"""{W}, {split_sql()}, tn AS (SELECT * FROM sp WHERE split = 'train'), {unpivot_sql('tn', FEATURES)},
sc AS (SELECT feature, avg(v) AS mean, stddev_pop(v) AS dev FROM u WHERE feature IN ('qty_sum', '{MARKER}') GROUP BY feature),
one AS (SELECT max(mean) FILTER (WHERE feature = 'qty_sum') AS pm, max(dev) FILTER (WHERE feature = 'qty_sum') AS pd,
  max(mean) FILTER (WHERE feature = '{MARKER}') AS mm_, max(dev) FILTER (WHERE feature = '{MARKER}') AS md_ FROM sc),
al AS (SELECT id, split, event, time, (qty_sum - pm) / pd AS p, ({MARKER} - mm_) / md_ AS m FROM sp CROSS JOIN one),
zz AS MATERIALIZED (SELECT '{MARKER}' AS biomarker, model_no, CASE WHEN model_no = 2 THEN m ELSE p END AS x,
  CASE WHEN model_no = 3 THEN m ELSE 0 END AS y, event, time FROM al CROSS JOIN (VALUES (1), (2), (3)) AS v(model_no) WHERE split = 'train'),
{chained('SELECT DISTINCT biomarker, model_no, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM zz', EFRON_STEP, 8)},
ev AS (SELECT *, split AS eval_set FROM al UNION ALL SELECT *, 'union' FROM al),
s AS MATERIALIZED (SELECT model_no, eval_set, event, time, a * CASE WHEN model_no = 2 THEN m ELSE p END
  + CASE WHEN model_no = 3 THEN b * m ELSE 0 END AS score FROM ev CROSS JOIN n8),
th AS (SELECT model_no, eval_set, quantile_cont(exp(score), 0.5) AS threshold, count(*) AS n, max(time) AS follow_up FROM s GROUP BY ALL),
g AS MATERIALIZED (SELECT s.*, CASE WHEN exp(score) > threshold THEN 'Upper' ELSE 'Lower' END AS grp FROM s JOIN th USING (model_no, eval_set))"""

G5_SQL = f"""{SCORED},
pr AS (SELECT a.model_no, a.eval_set, count(*) FILTER (WHERE a.score - b.score > 1e-8) AS c, count(*) FILTER (WHERE b.score - a.score > 1e-8) AS d
  FROM s a JOIN s b ON a.model_no = b.model_no AND a.eval_set = b.eval_set AND a.event = 1 AND a.time <= b.time
    AND (a.time < b.time OR b.event = 0) GROUP BY ALL),
{km_sql('g', "model_no || '|' || eval_set || '|' || grp")}, {MEDIAN_SQL},
lb AS (SELECT CAST(split_part(k, '|', 1) AS INT) AS model_no, split_part(k, '|', 2) AS eval_set, split_part(k, '|', 3) AS grp, median FROM mm),
tx AS (SELECT lb.*, grp || CASE WHEN median IS NULL THEN ': Median = not reached at ' || {NUMBER.format(v='follow_up')} || ' days'
  ELSE ': Median = ' || {NUMBER.format(v='median')} || ' days' END AS label FROM lb JOIN th USING (model_no, eval_set)),
wd AS (SELECT model_no, eval_set, max(median) FILTER (WHERE grp = 'Upper') AS median_upper, max(median) FILTER (WHERE grp = 'Lower') AS median_lower,
  max(label) FILTER (WHERE grp = 'Upper') AS label_upper, max(label) FILTER (WHERE grp = 'Lower') AS label_lower FROM tx GROUP BY ALL),
lt AS (SELECT model_no, eval_set, time, sum(event) AS d, count(*) AS m, sum(CASE WHEN grp = 'Lower' THEN event ELSE 0 END) AS d1,
  count(*) FILTER (WHERE grp = 'Lower') AS m1 FROM g GROUP BY model_no, eval_set, time),
lr AS (SELECT *, CAST(sum(m) OVER w AS DOUBLE) AS n, CAST(sum(m1) OVER w AS DOUBLE) AS n1 FROM lt
  WINDOW w AS (PARTITION BY model_no, eval_set ORDER BY time DESC)),
ls AS (SELECT model_no, eval_set, sum(d1) AS o, sum(d * n1 / n) AS e,
  sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS v FROM lr WHERE d > 0 GROUP BY ALL),
ch AS (SELECT model_no, eval_set, (o - e) * (o - e) / v AS chi2 FROM ls),
pv AS (SELECT model_no, eval_set, max(12.0 / 6000 / 3) * 2 / sqrt(2 * pi()) * sum(CASE WHEN i IN (0, 6000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
  * exp(-pow(sqrt(chi2) + 12.0 * i / 6000, 2) / 2)) AS p_value FROM ch CROSS JOIN range(0, 6001) AS r(i) GROUP BY ALL)
SELECT '{MARKER}' AS biomarker, model_no, CASE model_no WHEN 1 THEN 'qty_sum' WHEN 2 THEN '{MARKER}' ELSE 'qty_sum + {MARKER}' END AS formula,
  eval_set, round(c / CAST(c + d AS DOUBLE), 6) AS c_index, 'ok' AS status, round(threshold, 6) + 0.0 AS threshold, n, median_upper, median_lower,
  label_upper, label_lower, round(chi2, 4) + 0.0 AS chi2, round(p_value, 6) + 0.0 AS p_value
FROM pr JOIN th USING (model_no, eval_set) JOIN wd USING (model_no, eval_set) JOIN ch USING (model_no, eval_set) JOIN pv USING (model_no, eval_set)"""

RISK_SQL = f"""{SCORED} SELECT '{MARKER}' AS biomarker, model_no, eval_set, grp, CAST(brk AS DOUBLE) AS brk, count(*) FILTER (WHERE time >= brk) AS n_risk
FROM g CROSS JOIN (VALUES {', '.join(f'({b})' for b in BREAKS)}) AS v(brk) GROUP BY ALL"""

CURVES_SQL = f"""{SCORED}, {km_sql('g', "model_no || '|' || eval_set || '|' || grp")}
SELECT '{MARKER}' AS biomarker, CAST(split_part(k, '|', 1) AS INT) AS model_no, split_part(k, '|', 2) AS eval_set, split_part(k, '|', 3) AS grp,
  {KM_OUT} FROM km"""


def report_of_one(spark, sf):
    ready = survival_sides(spark, sf)
    return survival_report(ready.train, ready.test, "id", "qty_sum", [MARKER], "event", "time", BREAKS)


@query("G5_report_one_marker", G5_SQL)
def g5_one(spark, sf):
    out = report_of_one(spark, sf).summary
    return rounded(rounded(out, "c_index", "threshold", "p_value"), "chi2", digits=4)


@query("G5_risk_one_marker", RISK_SQL)
def g5_risk_one(spark, sf):
    return report_of_one(spark, sf).risk.select("biomarker", "model_no", "eval_set", F.col("grp"), "brk", "n_risk")


@query("G5_curves_one_marker", CURVES_SQL)
def g5_curves_one(spark, sf):
    return rounded(report_of_one(spark, sf).curves.select(
        "biomarker", "model_no", "eval_set", "grp", "time", "n_risk", "n_event", "n_censor", "surv", "se", "lower", "upper"),
        "surv", "se", "lower", "upper")
