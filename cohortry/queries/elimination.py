"""Feature elimination on three columns, with SQL that writes the Newton steps of the whole path out (F4, F5, F12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.operators import design, newton
from cohortry.operators.split import stratified_kfold
from cohortry.plans.crossval import cross_validate_rfe_cox, cross_validate_rfe_logistic
from cohortry.plans.preparation import prepare_logistic, prepare_survival
from cohortry.queries.modelling import ALL_FOLDS, ALL_SEEDS, elimination_paths
from cohortry.queries.registry import query, rounded
from cohortry.queries.subjects import F_SQL, fold_sql, held_features, split_sql

COLUMNS = ["n_lines", "price_avg", "acctbal"]
N = len(COLUMNS)
KEYS = "seed, fold"


CLIPPED = "least(greatest({c}, low{i}), high{i})"


def each(text: str) -> str:
    return ", ".join(text.format(i=i, c=c) for i, c in enumerate(COLUMNS))


def scaled_sql(label: str, subjects: str = "f", before: str = "", seeds: list[int] = ALL_SEEDS) -> str:
    """Clipped and scaled training rows per (seed, fold), one column z<i> per feature; ends in ``zt``."""
    clipped = CLIPPED
    return f"""{F_SQL}, {before}{fold_sql(subjects, label, ALL_FOLDS, seeds)},
tr AS MATERIALIZED (SELECT fo.id, fo.seed, g.fold, {', '.join(COLUMNS)}, f.response, f.event, f.time FROM fo JOIN {subjects} AS f USING (id)
  JOIN range(0, {ALL_FOLDS}) AS g(fold) ON fo.fold <> g.fold),
q AS (SELECT seed, fold, {each('quantile_cont({c}, 0.005) AS low{i}, quantile_cont({c}, 0.995) AS high{i}')} FROM tr GROUP BY ALL),
sc AS (SELECT seed, fold, {each(f'avg({clipped}) AS mean{{i}}, stddev_pop({clipped}) AS dev{{i}}')} FROM tr JOIN q USING ({KEYS}) GROUP BY ALL),
zt AS MATERIALIZED (SELECT seed, fold, {each(f'({clipped} - mean{{i}}) / dev{{i}} AS z{{i}}')}, response, event, time
  FROM tr JOIN q USING ({KEYS}) JOIN sc USING ({KEYS}))"""


def solved(source: str, q: int, carry: str) -> str:
    """b<i> + x<i>, where x solves the symmetric positive system h x = g, by elimination written out."""
    for k in range(q):
        cells = [f"h{i}_{j} - h{i}_{k} * h{k}_{j} / h{k}_{k} AS h{i}_{j}" if i > k else f"h{i}_{j}"
                 for i in range(q) for j in range(q)]
        right = [f"g{i} - h{i}_{k} * g{k} / h{k}_{k} AS g{i}" if i > k else f"g{i}" for i in range(q)]
        source = f"SELECT {carry}, {', '.join(f'b{i}' for i in range(q))}, {', '.join(cells)}, {', '.join(right)} FROM ({source})"
    for k in reversed(range(q)):
        known = "".join(f" - h{k}_{j} * x{j}" for j in range(k + 1, q))
        source = f"SELECT *, (g{k}{known}) / h{k}_{k} AS x{k} FROM ({source})"
    return f"SELECT {carry}, {', '.join(f'b{i} + x{i} AS b{i}' for i in range(q))} FROM ({source})"


MASK = ", ".join(f"m{i}" for i in range(N))
CARRY = f"{KEYS}, {MASK}"
ETA = " + ".join(f"b{i} * z{i}" for i in range(N))


def logistic_step(before: str) -> str:
    q = N + 1
    z = [f"z{i}" for i in range(N)] + ["1"]
    m = [f"m{i}" for i in range(N)] + ["1"]
    b = ", ".join(f"b{i}" for i in range(q))
    sums = [f"{m[i]} * sum((response - mu) * {z[i]}) - b{i} AS g{i}" for i in range(q)]
    sums += [f"{m[i]} * {m[j]} * sum(mu * (1 - mu) * {z[i]} * {z[j]}) + {int(i == j)} AS h{i}_{j}" for i in range(q) for j in range(q)]
    rows = f"SELECT *, 1 / (1 + exp(-({ETA} + b{N}))) AS mu FROM zt JOIN {before} USING ({KEYS})"
    return solved(f"SELECT {CARRY}, {b}, {', '.join(sums)} FROM ({rows}) GROUP BY {CARRY}, {b}", q, CARRY)


def cox_step(before: str, alpha: float = 0.05) -> str:
    b = ", ".join(f"b{i}" for i in range(N))
    upper = [(i, j) for i in range(N) for j in range(i, N)]
    moments = ["sum(w) AS w"] + [f"sum(w * z{i}) AS w{i}" for i in range(N)] + [f"sum(w * z{i} * z{j}) AS w{i}{j}" for i, j in upper]
    names = ["w"] + [f"w{i}" for i in range(N)] + [f"w{i}{j}" for i, j in upper]
    events = ["sum(event) AS d"] + [f"sum(event * z{i}) AS e{i}" for i in range(N)]
    cells = f"""SELECT {CARRY}, {b}, time, {', '.join(moments + events)}
      FROM (SELECT *, exp({ETA}) AS w FROM zt JOIN {before} USING ({KEYS})) GROUP BY {CARRY}, {b}, time"""
    risk = f"""SELECT {CARRY}, {b}, d, {', '.join(f'e{i}' for i in range(N))}, {', '.join(f'sum({n}) OVER o AS s{n[1:]}' for n in names)}
      FROM ({cells}) WINDOW o AS (PARTITION BY {KEYS} ORDER BY time DESC)"""
    sums = [f"m{i} * sum(e{i} - d * s{i} / s) - {alpha} * b{i} AS g{i}" for i in range(N)]
    sums += [f"m{i} * m{j} * sum(d * (s{min(i, j)}{max(i, j)} / s - s{i} * s{j} / (s * s))) + {alpha if i == j else 0} AS h{i}_{j}"
             for i in range(N) for j in range(N)]
    return solved(f"SELECT {CARRY}, {b}, {', '.join(sums)} FROM ({risk}) GROUP BY {CARRY}, {b}", N, CARRY)


def path_tables(step, unknowns: int, mandatory: int | None = None, steps: int = 8) -> tuple[list[str], list[str]]:
    """All features, then without the weakest, down to one; a column that is out has mask 0 and coefficient 0.

    The tables, of which ``p<size>_<steps>`` hold the fits, and a statement per coefficient."""
    zero = ", ".join(f"0.0::DOUBLE AS b{i}" for i in range(unknowns))
    start = f"SELECT DISTINCT {KEYS}, {', '.join(f'1 AS m{i}' for i in range(N))}, {zero} FROM zt"
    tables, results = [], []
    for size in range(N, 0, -1):
        tables.append(f"p{size}_0 AS MATERIALIZED ({start})")
        for k in range(steps):
            tables.append(f"p{size}_{k + 1} AS MATERIALIZED ({step(f'p{size}_{k}')})")
        done = f"p{size}_{steps}"
        results += [f"SELECT {KEYS}, {size} AS k, '{c}' AS feature, round(b{i}, 6) + 0.0 AS beta, round(exp(b{i}), 6) AS ratio "
                    f"FROM {done} WHERE m{i} = 1" for i, c in enumerate(COLUMNS)]
        weight = [f"CASE WHEN m{i} = 1 THEN abs(b{i}) ELSE 1e300 END" if i != mandatory else "1e300" for i in range(N)]
        weakest = f"SELECT *, least({', '.join(weight)}) AS least_weight FROM {done}"
        gone = [f"({weight[i]}) = least_weight" for i in range(N)]
        start = f"""SELECT {KEYS}, {', '.join(f'CASE WHEN {gone[i]} THEN 0 ELSE m{i} END AS m{i}' for i in range(N))},
          {', '.join(f'CASE WHEN {gone[i]} THEN 0.0 ELSE b{i} END AS b{i}' if i < N else f'b{i}' for i in range(unknowns))} FROM ({weakest})"""
    return tables, results


def path_sql(label: str, step, unknowns: int, mandatory: int | None = None) -> str:
    tables, results = path_tables(step, unknowns, mandatory)
    return f"WITH {scaled_sql(label)}, {', '.join(tables)} {' UNION ALL '.join(results)}"


SIDES = f"{split_sql('f')}, tn AS (SELECT * FROM sp WHERE split = 'train'), te AS (SELECT * FROM sp WHERE split = 'test'), "


def judged_tables(step, unknowns: int, outcome: str, mandatory: int | None = None) -> str:
    """Every fit of the path and, in ``judged``, the scaled rows of its own fold and of the hold-out side."""
    tables, _ = path_tables(step, unknowns, mandatory)
    fits = " UNION ALL ".join(f"SELECT {KEYS}, {k} AS k, {MASK}, {', '.join(f'b{i}' for i in range(unknowns))} FROM p{k}_8"
                              for k in range(1, N + 1))
    z = each(f"({CLIPPED} - mean{{i}}) / dev{{i}} AS z{{i}}")
    return f"""{', '.join(tables)}, fits AS ({fits}),
judged AS (SELECT seed, fold, 'validation' AS part, {z}, {', '.join('f.' + c for c in outcome.split())} FROM fo JOIN tn AS f USING (id)
    JOIN q USING ({KEYS}) JOIN sc USING ({KEYS})
  UNION ALL SELECT seed, fold, 'holdout', {z}, {', '.join('te.' + c for c in outcome.split())} FROM te CROSS JOIN q JOIN sc USING ({KEYS}))"""


LISTED = {side: "concat_ws(', ', " + ", ".join(
    f"CASE WHEN m{i} = 1 AND b{i} {test} 0 THEN '{c}' END" for i, c in enumerate(COLUMNS)) + ")"
    for side, test in (("above", ">"), ("below", "<="))}
DIRECTIONS = f"any_value({LISTED['above']}) AS above, any_value({LISTED['below']}) AS below"


def concordance_sql(seeds: list[int]) -> str:
    """Concordance of every Cox fit on its own fold and on the hold-out side, over all pairs."""
    return f"""WITH {scaled_sql('event', 'tn', SIDES, seeds)}, {judged_tables(cox_step, N, 'event time', 0)},
scored AS MATERIALIZED (SELECT seed, fold, k, part, event, time, {ETA} AS score FROM judged JOIN fits USING ({KEYS})),
pairs AS (SELECT a.seed, a.fold, a.k, a.part, count(*) AS n, count(*) FILTER (WHERE a.score - b.score > 1e-8) AS c,
    count(*) FILTER (WHERE abs(a.score - b.score) <= 1e-8) AS t
  FROM scored a JOIN scored b ON a.seed = b.seed AND a.fold = b.fold AND a.k = b.k AND a.part = b.part AND a.event = 1
    AND a.time <= b.time AND (a.time < b.time OR b.event = 0) GROUP BY ALL)
SELECT seed, fold, k AS NumFeatures, round(max((c + t / 2.0) / n) FILTER (WHERE part = 'validation'), 6) AS Validation_Set_Concordance,
  round(max((c + t / 2.0) / n) FILTER (WHERE part = 'holdout'), 6) AS Test_Set_Concordance, {DIRECTIONS}
FROM pairs JOIN fits USING (seed, fold, k) GROUP BY seed, fold, k"""


def judged_sql() -> str:
    """AUC, accuracy and directions of every logistic fit on its own fold and on the hold-out side."""
    return f"""WITH {scaled_sql('response', 'tn', SIDES)}, {judged_tables(logistic_step, N + 1, 'response')},
scored AS (SELECT seed, fold, k, part, response, round({ETA} + b{N}, 9) AS score FROM judged JOIN fits USING ({KEYS})),
ranked AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY seed, fold, k, part, score) - 1) / 2.0 AS r FROM scored
  WINDOW w AS (PARTITION BY seed, fold, k, part ORDER BY score)),
auc AS (SELECT seed, fold, k, part, (sum(r) FILTER (WHERE response = 1) - sum(response) * (sum(response) + 1) / 2.0)
  / (CAST(sum(response) AS DOUBLE) * (count(*) - sum(response))) AS auc, avg(CAST(CAST(score > 0 AS INT) = response AS INT)) AS accuracy
  FROM ranked GROUP BY seed, fold, k, part)
SELECT seed, fold, k AS NumFeatures, {', '.join(f"round(max({m}) FILTER (WHERE part = '{p}'), 5) + 0.0 AS {n}_{a}"
       for p, n in (('validation', 'Validation'), ('holdout', 'Holdout')) for m, a in (('auc', 'AUC'), ('accuracy', 'Accuracy')))},
  {DIRECTIONS}
FROM auc JOIN fits USING (seed, fold, k) GROUP BY seed, fold, k"""


def folded(spark, sf, label):
    f = held_features(spark, sf, "id", *COLUMNS, "response", "event", "time")
    kept = stratified_kfold(f, "id", label, ALL_FOLDS, ALL_SEEDS)
    return design.design_table(kept, "id", COLUMNS, ["response", "event", "time"], ALL_SEEDS, ALL_FOLDS)


def of_three(paths):
    return rounded(paths.where(F.col("k") <= N), "beta", "ratio")


@query("F4_rfe_three", path_sql("response", logistic_step, N + 1))
def f4(spark, sf):
    d = folded(spark, sf, "response")
    return of_three(elimination_paths(spark, d, newton.logistic_fitter(d, "response"),
                                      newton.fold_models(d, design.learn_folds(d)), intercept=True))


@query("F5_rfe_three_mandatory", path_sql("event", cox_step, N, 0))
def f5(spark, sf):
    d = folded(spark, sf, "event")
    fit = newton.cox_fitter(newton.time_ordered(d, "event", "time"), 0.05)
    return of_three(elimination_paths(spark, d, fit, newton.fold_models(d, design.learn_folds(d)), COLUMNS[0]))


@query("F5_rfe_three_partitioned", path_sql("event", cox_step, N, 0))
def f5_partitioned(spark, sf):
    """The same over time partitions of a few thousand subjects, their sums carried by a tree of two children a node."""
    d = folded(spark, sf, "event")
    fit = newton.cox_fitter(newton.time_ordered(d, "event", "time", partition_rows=2_000, group=2), 0.05)
    return of_three(elimination_paths(spark, d, fit, newton.fold_models(d, design.learn_folds(d)), COLUMNS[0]))


@query("F12_cross_validate_three", judged_sql())
def f12(spark, sf):
    f = held_features(spark, sf, "id", "prio", "seg", "response", *COLUMNS)
    ready = prepare_logistic(f, "id", COLUMNS, "response", ["prio", "seg"], seed=7)
    found = cross_validate_rfe_logistic(ready.train, ready.test, "id", COLUMNS, "response", ALL_FOLDS, ALL_SEEDS)
    metrics = ["Validation_AUC", "Validation_Accuracy", "Holdout_AUC", "Holdout_Accuracy"]
    return rounded(found.select("seed", "fold", "NumFeatures", *metrics, F.array_join("OR > 1 Features", ", ").alias("above"),
                                F.array_join("OR < 1 Features", ", ").alias("below")), *metrics, digits=5)


# Two seeds: the SQL forms every pair of every model.
@query("F13_cross_validate_three", concordance_sql([1, 2]))
def f13(spark, sf):
    f = held_features(spark, sf, "id", "prio", "seg", "event", "time", *COLUMNS)
    ready = prepare_survival(f, "id", COLUMNS, "event", "time", ["prio", "seg"], seed=7)
    found = cross_validate_rfe_cox(ready.train, ready.test, "id", COLUMNS, "event", "time", ALL_FOLDS, [1, 2], mandatory=COLUMNS[0])
    metrics = ["Validation_Set_Concordance", "Test_Set_Concordance"]
    return rounded(found.select("seed", "fold", "NumFeatures", *metrics, F.array_join("HR > 1 Features", ", ").alias("above"),
                                F.array_join("HR < 1 Features", ", ").alias("below")), *metrics)
