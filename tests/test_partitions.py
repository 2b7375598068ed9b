"""The number of partitions, and with it what tasks report to the driver, does not grow with the rows of small ones."""

import numpy as np

from cohortry.operators import design, newton, running


def test_small_range_partitions_stay_few(spark, monkeypatch):
    monkeypatch.setattr(running, "RANGE_PARTS", 5)
    seen = []
    whole = running.durable
    monkeypatch.setattr(running, "durable", lambda df: seen.append(df.rdd.getNumPartitions()) or whole(df))
    df = spark.range(300).selectExpr("id % 3 k", "id o", "1L n")
    got = running.running_totals(df, ["k"], ["o"], ["n"], window_rows=0, partition_rows=1).collect()
    assert sorted((r.k, r.n_before) for r in got) == [(k, i) for k in range(3) for i in range(100)]
    assert max(seen) <= 5


def test_small_time_partitions_stay_few(spark, monkeypatch):
    monkeypatch.setattr(newton, "COX_PARTITIONS", 3)
    rng = np.random.default_rng(1)
    rows = [(i, float(a), int(e), float(t)) for i, (a, e, t) in enumerate(
        zip(rng.normal(size=200), rng.integers(0, 2, 200), rng.integers(1, 40, 200)))]
    df = spark.createDataFrame(rows, "id int, a double, e int, t double")
    d = design.design_table(df, "id", ["a"], ["e", "t"])
    cut = newton.time_ordered(d, "e", "t", partition_rows=1, group=2)
    assert cut.parts == max(3, spark.sparkContext.defaultParallelism)
    inf = np.full(1, np.inf)
    model = newton.Model(None, None, [0], -inf, inf, np.zeros(1), np.ones(1))
    fits = [newton.cox_fitter(o)([model])[0][0] for o in (cut, newton.time_ordered(d, "e", "t"))]
    assert abs(fits[0] - fits[1]) < 1e-9
