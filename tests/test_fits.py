"""Selection, cross-validation and the survival report against plain NumPy on small random tables."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import design, newton, scoring, split
from cohortry.plans.crossval import cross_validate_rfe_cox, cross_validate_rfe_logistic
from cohortry.plans.survival_report import survival_report

NAMES = ["a", "b", "c", "d"]


def table(spark, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[:, 3] = np.round(x[:, 3])
    risk = 0.9 * x[:, 0] - 0.5 * x[:, 1]
    time = np.ceil(np.exp(1.5 - risk + 0.5 * rng.normal(size=n)) * 3)
    time = np.where(rng.random(n) < 0.33, 7.0, time)     # a third of all rows share one time
    event = (rng.random(n) < 0.6).astype(int)
    y = (risk + rng.normal(size=n) > 0).astype(int)
    rows = [(i, *map(float, x[i]), int(y[i]), int(event[i]), float(time[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, a double, b double, c double, d double, y int, event int, time double")


@pytest.fixture(scope="module")
def data(spark):
    train, hold = table(spark, 240, 1).cache(), table(spark, 90, 2).cache()
    return train, hold


def logit(z, y):
    z = np.column_stack([z, np.ones(len(z))])
    b = np.zeros(z.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve((z * (mu * (1 - mu))[:, None]).T @ z + np.eye(len(b)), z.T @ (y - mu) - b)
    return b


def cox(z, event, time, alpha, efron=False):
    b = np.zeros(z.shape[1])
    for _ in range(50):
        w = np.exp(z @ b)
        g, h = -alpha * b, alpha * np.eye(len(b))
        for t in np.unique(time[event == 1]):
            risk, dead = time >= t, (time == t) & (event == 1)
            g = g + z[dead].sum(axis=0)
            for i in range(dead.sum()):
                u = i / dead.sum() if efron else 0.0
                v = np.where(risk, w, 0) - u * np.where(dead, w, 0)
                s0, s1 = v.sum(), v @ z
                g = g - s1 / s0
                h = h + (z * v[:, None]).T @ z / s0 - np.outer(s1, s1) / s0 ** 2
        b = b + np.linalg.solve(h, g)
    return b


def c_counts(s, t, e):
    comp = (e[:, None] == 1) & ((t[:, None] < t) | ((t[:, None] == t) & (e == 0)))
    gap = s[:, None] - s
    tie = np.abs(gap) <= 1e-8
    return (comp & ~tie & (gap > 0)).sum(), (comp & ~tie & (gap < 0)).sum(), (comp & tie).sum()


def auc(s, y):
    gap = s[y == 1][:, None] - s[y == 0]
    return ((gap > 0) + 0.5 * (gap == 0)).mean()


def brute_path(x, fit, mandatory):
    cols = list(range(x.shape[1]))
    if mandatory is not None:
        cols = [mandatory] + [c for c in cols if c != mandatory]
    out = {}
    while True:
        b = fit(x[:, cols])
        out[len(cols)] = (list(cols), b)
        if len(cols) == 1:
            return out
        w = np.abs(b[:len(cols)]).copy()
        if mandatory is not None:
            w[0] = np.inf
        del cols[int(np.argmin(w))]


def folded_arrays(train, label, k, seeds):
    pdf = split.stratified_kfold(train, "id", label, k, seeds).toPandas()
    return pdf, pdf[NAMES].to_numpy(), np.array(pdf["folds"].tolist())


@pytest.mark.parametrize("mandatory", [None, "d"])
def test_logistic_cross_validation(data, mandatory):
    train, hold = data
    seeds, k = [1, 2], 3
    got = {(r.seed, r.fold, r.NumFeatures): r for r in cross_validate_rfe_logistic(
        train, hold, "id", NAMES, "y", k, seeds, 3, mandatory).collect()}
    assert len(got) == 18
    pdf, x, folds = folded_arrays(train, "y", k, seeds)
    held = hold.toPandas()
    for s, seed in enumerate(seeds):
        for f in range(k):
            at = folds[:, s] != f
            lo, hi = np.quantile(x[at], [.005, .995], axis=0)
            mean, dev = np.clip(x[at], lo, hi).mean(0), np.clip(x[at], lo, hi).std(0)
            def z(v):
                return (np.clip(v, lo, hi) - mean) / dev
            y = pdf["y"].to_numpy()
            path = brute_path(z(x[at]), lambda m: logit(m, y[at]), None if mandatory is None else 3)
            for n in (1, 2, 3):
                cols, b = path[n]
                r = got[seed, f, n]
                for rows, truth, name in ((x[~at], y[~at], "Validation"), (held[NAMES].to_numpy(), held["y"].to_numpy(), "Holdout")):
                    score = z(rows)[:, cols] @ b[:-1] + b[-1]
                    assert r[f"{name}_AUC"] == pytest.approx(auc(score, truth))
                    assert r[f"{name}_Accuracy"] == pytest.approx(((score > 0) == truth).mean())
                assert r["OR > 1 Features"] == [NAMES[c] for c, v in zip(cols, b) if v > 0]
                assert r["OR < 1 Features"] == [NAMES[c] for c, v in zip(cols, b) if v <= 0]


@pytest.mark.parametrize("mandatory,partition_rows", [(None, 50), ("d", 1000)])
def test_cox_cross_validation(data, monkeypatch, mandatory, partition_rows):
    monkeypatch.setattr(newton, "COX_PARTITION_ROWS", partition_rows)
    train, hold = data
    seeds, k = [3], 3
    got = {(r.fold, r.NumFeatures): r for r in cross_validate_rfe_cox(
        train, hold, "id", NAMES, "event", "time", k, seeds, 3, mandatory).collect()}
    assert len(got) == 9
    pdf, x, folds = folded_arrays(train, "event", k, seeds)
    e, t = pdf["event"].to_numpy(), pdf["time"].to_numpy()
    held = hold.toPandas()
    for f in range(k):
        at = folds[:, 0] != f
        lo, hi = np.quantile(x[at], [.005, .995], axis=0)
        mean, dev = np.clip(x[at], lo, hi).mean(0), np.clip(x[at], lo, hi).std(0)
        def z(v):
            return (np.clip(v, lo, hi) - mean) / dev
        path = brute_path(z(x[at]), lambda m: cox(m, e[at], t[at], .05), None if mandatory is None else 3)
        for n in (1, 2, 3):
            cols, b = path[n]
            r = got[f, n]
            for rows, ev, ti, name in ((x[~at], e[~at], t[~at], "Validation_Set"),
                                       (held[NAMES].to_numpy(), held["event"].to_numpy(), held["time"].to_numpy(), "Test_Set")):
                c, d, tie = c_counts(z(rows)[:, cols] @ b, ti, ev)
                assert r[f"{name}_Concordance"] == pytest.approx((c + tie / 2) / (c + d + tie))
            assert r["HR > 1 Features"] == [NAMES[i] for i, v in zip(cols, b) if v > 0]


def test_survival_report(data):
    train, hold = data
    got = survival_report(train, hold, "id", "a", ["b", "d"], "event", "time", [0.0, 5.0, 20.0])
    rows = {(r.biomarker, r.model_no, r.eval_set): r for r in got.summary.collect()}
    assert len(rows) == 2 * 3 * 3
    tr, te = train.toPandas(), hold.toPandas()
    x, e, t = tr[["a", "d"]].to_numpy(), tr["event"].to_numpy(), tr["time"].to_numpy()
    b = cox(x, e, t, 0.0, efron=True)
    coefs = {(r.biomarker, r.model_no): r.beta for r in got.coefficients.collect()}
    assert coefs["d", 3] == pytest.approx(b, abs=1e-6)
    risk = np.exp((te[["a", "d"]].to_numpy() - x.mean(0)) @ b)
    r = rows["d", 3, "test"]
    c, d, _ = c_counts(np.log(risk), te["time"].to_numpy(), te["event"].to_numpy())
    assert r.c_index == pytest.approx(c / (c + d)) and r.threshold == pytest.approx(np.median(risk))
    assert r.n == 90 and rows["b", 1, "union"].n == 330
    assert r.label_upper.startswith("Upper: Median = ")
    table = got.risk.where("biomarker = 'd' AND model_no = 3 AND eval_set = 'union' AND brk = 5").collect()
    both = np.concatenate([t, te["time"].to_numpy()])
    assert sum(x.n_risk for x in table) == (both >= 5).sum()


def test_fold_preparation(data):
    train, _ = data
    folded = split.stratified_kfold(train.withColumn("one", F.lit(1.0)), "id", "y", 4, [5, 6]).repartition(7)
    d = design.design_table(folded, "id", NAMES + ["one"], ["y"], [5, 6], 4)
    prep = design.learn_folds(d)
    pdf = d.rows.toPandas()
    x, folds = np.array(pdf["x"].tolist()), np.array(pdf["folds"].tolist())
    for m, (s, f) in enumerate(d.models):
        at = x[folds[:, s] != f]
        lo, hi = np.quantile(at, [.005, .995], axis=0)
        clip = np.clip(at, lo, hi)
        assert np.allclose(prep.low[m], lo) and np.allclose(prep.high[m], hi)
        assert np.allclose(prep.mean[m], clip.mean(0)) and np.allclose(prep.scale[m][:4], clip.std(0)[:4])
        assert prep.scale[m][4] == 1 and prep.keep[m].tolist() == [True] * 4 + [False]
        assert np.allclose(prep.var[m], at.var(0))


def test_mandatory_without_variance_and_more_features_than_columns(data):
    train, _ = data
    folded = split.stratified_kfold(train.withColumn("one", F.lit(1.0)), "id", "y", 3, [1])
    d = design.design_table(folded, "id", ["a", "b", "one"], ["y"], [1], 3)
    models = newton.fold_models(d, design.learn_folds(d))
    with pytest.raises(ValueError):
        newton.eliminate(newton.logistic_fitter(d, "y"), models, 2, 2, True)
    path = newton.eliminate(newton.logistic_fitter(d, "y"), models, 4, None, True)[0]
    assert sorted(path) == [1, 2, 3, 4] and path[4][0] == path[2][0] == [0, 1]
    with pytest.raises(ValueError):
        design.fold_variances(design.design_table(folded, "id", ["one"], ["y"], [1], 3))


def test_score_symmetries(data):
    train, _ = data
    def index(column):
        return scoring.concordance(scoring.comparable_pairs(
            train.withColumn("s", column), [], "s", "time", "event")).first().c_index
    assert index(F.col("a")) == pytest.approx(1 - index(-F.col("a")))
    plain = scoring.roc_auc(train, [], "a", "y").first().auc
    assert scoring.roc_auc(train.withColumn("s", F.exp("a")), [], "s", "y").first().auc == pytest.approx(plain)
    hot = train.withColumn("s", F.lit(1.0))
    assert index(F.lit(2.0)) == pytest.approx(0.5)
    assert scoring.roc_auc(hot, [], "s", "y").first().auc == pytest.approx(0.5)


def test_carries_of_a_tree_are_those_of_a_scan():
    """Random partitions, ties that span several of them, any number of children: each partition gets the sums of
    all later times and whole sums of the times it shares."""
    rng = np.random.default_rng(4)
    q = 2
    for _ in range(60):
        n = int(rng.integers(2, 40))
        late = np.sort(rng.integers(0, rng.integers(1, 12), n)).astype(float)
        cuts = np.unique(rng.integers(1, n, rng.integers(1, 10))) if n > 1 else []
        pieces = np.split(np.arange(n), cuts)
        rows = rng.normal(size=(n, 1 + q + q * q))
        died = rng.random(n) < 0.5

        def edge(at):
            return np.concatenate([rows[at].sum(0), rows[at][died[at]].sum(0), [died[at].sum()]])[None, :]

        segments = [newton._Segment(late[p[0]], late[p[-1]], rows[p].sum(0)[None, :], edge(p[late[p] == late[p[0]]]),
                                    edge(p[late[p] == late[p[-1]]])) for p in pieces]

        def descend(level, around, fan):
            if len(level) <= fan:
                return newton._neighbours(level, *around)
            groups = [level[k:k + fan] for k in range(0, len(level), fan)]
            whole = []
            for g in groups:
                total = g[0]
                for s in g[1:]:
                    total = total.then(s)
                whole.append(newton._load(newton._dump(total))[0])
            return [f for g, a in zip(groups, descend(whole, around, fan)) for f in newton._neighbours(g, *a)]

        for p, s, found in zip(pieces, segments, descend(segments, (None, None), int(rng.integers(2, 5)))):
            start, ties = newton._carry(s, *found)
            assert np.allclose(start[0], rows[:p[0]].sum(0))
            assert set(ties) == {late[p[0]], late[p[-1]]}
            for t, (risk, dead, count, earlier) in ties.items():
                same = late == t
                assert np.allclose(risk[0], rows[late <= t].sum(0)) and np.allclose(dead[0], rows[same & died].sum(0))
                assert count[0] == (same & died).sum()
                assert earlier[0] == ((same & died)[:p[0]].sum() if t == late[p[0]] else 0)


def test_cox_over_many_partitions_equals_one(spark):
    """400 time partitions, hot times across many of them, four levels of the tree: the fit of one partition."""
    rng = np.random.default_rng(9)
    n = 2_400
    x = rng.normal(size=(n, 3))
    time = np.where(rng.random(n) < 0.4, rng.integers(1, 4, n) * 5.0, np.round(rng.exponential(10, n), 1))
    df = spark.createDataFrame([(k, *map(float, x[k]), int(rng.random() < 0.6), float(time[k])) for k in range(n)],
                               "id long, a double, b double, c double, event int, time double")
    d = design.design_table(df, "id", ["a", "b", "c"], ["event", "time"])
    one = np.ones(3)
    model = newton.Model(None, None, [0, 1, 2], -9 * one, 9 * one, 0 * one, one)
    whole = newton.time_ordered(d, "event", "time")
    cut = newton.time_ordered(d, "event", "time", partition_rows=6, group=5)
    assert (whole.parts, cut.parts) == (1, 400) and len(cut.shared) > 100
    for alpha, ties in ((.05, "breslow"), (0.0, "efron")):
        fits = [newton._cox_evaluate(o, [(model, np.array([.3, -.2, .1]))], 3, ties == "efron") for o in (whole, cut)]
        assert np.allclose(*fits, rtol=1e-10, atol=1e-10)
    fits = [newton.cox_fitter(o, .05)([model])[0] for o in (whole, replace(cut, group=64))]
    assert fits[0] == pytest.approx(fits[1], abs=1e-10)


def test_carries_stay_off_the_driver_and_rows_in_place(spark):
    """The plan of a step shuffles carries only; the rows are read from their cached layout."""
    df = spark.createDataFrame([(k, k % 7 / 7, int(k % 3 == 0), float(k % 40)) for k in range(500)], "id long, a double, event int, time double")
    d = design.design_table(df, "id", ["a"], ["event", "time"])
    order = newton.time_ordered(d, "event", "time", partition_rows=50, group=4)
    model = newton.Model(None, None, [0], np.array([-9.]), np.array([9.]), np.zeros(1), np.ones(1))
    carries = newton._cox_carries(order, [(model, np.zeros(1))], 1)
    step = order.rows.groupBy("part").cogroup(carries.groupBy("part")).applyInArrow(lambda a, b: a, order.rows.schema)
    plan = step._jdf.queryExecution().executedPlan().toString()
    for block in plan.split("Exchange hashpartitioning(")[1:]:
        assert "late" not in block.split("\n")[0]
    below = [line for line in plan.split("\n") if "FlatMapCoGroupsInArrow" in line or "InMemoryTableScan" in line]
    assert below[0].strip().startswith(("+- FlatMapCoGroupsInArrow", "FlatMapCoGroupsInArrow"))
    first = plan[plan.index("FlatMapCoGroupsInArrow"):].split("\n")[1]
    assert "InMemoryTableScan" in first      # neither a shuffle nor a sort stands between
    assert newton._cox_carries.__code__.co_names.count("collect") == 0


@pytest.mark.parametrize("outcome", ["y", "event"])
def test_elimination_needs_few_scans(data, outcome):
    """After the first fit a refit starts at the block-inverse update; the path is that of cold starts."""
    train, _ = data
    folded = split.stratified_kfold(train, "id", outcome, 3, [1, 2])
    d = design.design_table(folded, "id", NAMES, [outcome] + (["time"] if outcome == "event" else []), [1, 2], 3)
    models = newton.fold_models(d, design.learn_folds(d))
    logistic = outcome == "y"
    make = (lambda: newton.logistic_fitter(d, "y")) if logistic else (lambda: newton.cox_fitter(newton.time_ordered(d, "event", "time")))
    fit, first, cold = make(), make(), make()
    paths = newton.eliminate(fit, models, 4, None, logistic)
    first(models)
    assert fit.evaluations - first.evaluations <= 3 * (len(NAMES) - 1)
    for model, path in zip(models, paths):
        for cols, beta in path.values():
            assert beta == pytest.approx(cold([model.take(cols)])[0], abs=1e-8)
