"""A run matrix row from files to files."""

import random

import pytest
from pyspark.sql import functions as F

from cohortry.operators import report
from cohortry.plans import runs
from cohortry.plans.crossval import cross_validate_rfe_cox, cross_validate_rfe_logistic
from cohortry.plans.preparation import prepare_logistic, prepare_survival
from cohortry.sources import tables

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("runs"))
    rng = random.Random(2)
    rows = []
    for i in range(160):
        a, b, c = rng.gauss(0, 1), rng.gauss(1, 2), rng.random()
        rows.append((i, rng.choice("xy"), a, b, c, int(a + rng.gauss(0, 1) > 0), rng.random() < .7, float(rng.randint(1, 40)) + max(0., 3 - a)))
    spark.createDataFrame(rows, "id int, site string, a double, b double, c double, y int, event boolean, time double") \
        .withColumn("event", F.col("event").cast("int")).write.parquet(f"{path}/t.parquet")
    with open(f"{path}/set1.txt", "w") as out:
        out.write("a\n\nb\nabsent\n c \n")
    with open(f"{path}/matrix.csv", "w") as out:
        out.write("dataset,featureset,response,event,time,cols_to_balance,random_state,folds\nt,set1,y,event,time,\"['site']\",4,3\n")
    return path


def setup(path, out):
    return runs.Setup({"t": f"{path}/t.parquet"}, path, f"{path}/{out}", "id", drop=("c",), log_cols=("b",), seeds=[1], k_max=2)


def plain(rows):
    return sorted([tuple(", ".join(x) if isinstance(x, list) else round(x, 9) if isinstance(x, float) else x for x in r) for r in rows], key=str)


def test_logistic_run(spark, files):
    run = tables.read_run_matrix(spark, f"{files}/matrix.csv")[0]
    got = runs.logistic_run(spark, run, setup(files, "lr"))
    assert got.metrics.endswith("/lr/RFE_LogReg_t__set1/3fold_CV_RS4.csv")
    back = tables.read_metrics(spark, got.metrics)
    assert back.columns == tables.LOGISTIC_METRICS
    ready = prepare_logistic(spark.read.parquet(f"{files}/t.parquet"), "id", NAMES, "y", ["site"], 4, ("c",), None, ("b",))
    want = cross_validate_rfe_logistic(ready.train, ready.test, "id", ready.features, "y", 3, [1], 2)
    assert plain(back.collect()) == plain(want.select(*[f"`{c}`" for c in tables.LOGISTIC_METRICS]).collect())
    x = tables.read_split(spark, got.split, "X", "train", "csv")
    assert sorted(x.columns) == sorted(["id", *ready.features]) and x.count() == ready.train.count() == 120
    assert tables.read_split(spark, got.split, "y", "test", "csv").agg(F.sum("y")).first()[0] == ready.test.agg(F.sum("y")).first()[0]


def test_survival_runs_to_report(spark, files):
    run = tables.read_run_matrix(spark, f"{files}/matrix.csv")[0]
    with_a = tables.read_metrics(spark, runs.survival_run(spark, run, setup(files, "with"), "a").metrics)
    without = tables.read_metrics(spark, runs.survival_run(spark, run, setup(files, "without")).metrics)
    assert with_a.columns == without.columns == tables.SURVIVAL_METRICS
    ready = prepare_survival(spark.read.parquet(f"{files}/t.parquet"), "id", NAMES, "event", "time", ["site"], 4, ("c",), None, ("b",))
    want = cross_validate_rfe_cox(ready.train, ready.test, "id", ready.features, "event", "time", 3, [1], 2, "a")
    assert plain(with_a.collect()) == plain(want.select(*[f"`{c}`" for c in tables.SURVIVAL_METRICS]).collect())
    chosen = report.union_rows(*[report.select_model_rows(with_a, without, "a", "b", d) for d in (">1", "<1")])
    stats = report.boxplot_stats(report.model_label(chosen), ["Features"], ["Test_Set_Concordance"])
    assert stats.agg(F.sum("n")).first()[0] == chosen.where("Test_Set_Concordance IS NOT NULL").count()


def test_unknown_split_form(spark, files):
    df = spark.read.parquet(f"{files}/t.parquet")
    with pytest.raises(ValueError):
        tables.write_split(df, df, f"{files}/none", "id", NAMES, ["y"], "xlsx")
