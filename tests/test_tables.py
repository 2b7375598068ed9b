"""Sources, cleaning edge cases and splitting properties."""

import pytest
from pyspark.sql import functions as F

from cohortry.operators import clean, profile, report, split
from cohortry.plans.preparation import prepare_logistic, prepare_survival
from cohortry.plans.profiling import correlations, distributions
from cohortry.sources import tables


@pytest.fixture(scope="module")
def people(spark):
    return spark.range(1200).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("g"),
        (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 17).cast("double").alias("v.1"),
        F.when(F.col("id") % 40 != 0, (F.col("id") * 7 % 101).cast("double")).alias("w"),
        (F.col("id") % 5 != 0).alias("event"), (F.col("id") % 97).cast("double").alias("time")).cache()


def test_coerce_numeric_texts(spark):
    texts = [" 1.5 ", "1d", "1f", "1e3", "NaN", "1,000", "", "abc", None, "-2", "No Data", "0x1A", "inf"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.t for r in clean.coerce_numeric(clean.replace_sentinels(df, ["t"]), ["t"]).orderBy("i").collect()]
    assert got[:12] == [1.5, None, None, 1000.0, None, None, None, None, None, -2.0, None, None]
    assert got[12] == float("inf")


def test_strat_key_keeps_missing(spark):
    df = spark.createDataFrame([("a", None), ("a", 1)], "p string, q int")
    assert [r.strat_col for r in clean.strat_key(df, ["p", "q"]).collect()] == ["a_nan", "a_1"]


def test_drop_columns(people):
    slim, gone = clean.drop_columns(people, ["w", "v.1", "absent"], "w")
    assert slim.columns == ["w", "id", "g", "y", "event", "time"] and gone == ["v.1"]
    with pytest.raises(ValueError):
        clean.drop_columns(people, ["w"], "absent")
    assert clean.align_columns(people, slim).columns == slim.columns


def test_map_and_cast(spark):
    df = spark.createDataFrame([("True", "1.9"), ("False", "x"), ("?", "2")], "e string, r string")
    got = clean.map_values(df, "e", {"False": 0, "True": 1}).collect()
    assert [r.e for r in got] == [1, 0, None]
    numbers = clean.cast_outcome(clean.coerce_numeric(df, ["r"]), response="r").collect()
    assert [r.r for r in numbers] == [1, None, 2]


def test_na_profile_and_drop(people):
    prof = clean.na_profile(people, ["v.1", "w"]).collect()
    assert [(r.feature, r.n_missing) for r in prof] == [("w", 30), ("v.1", 0)]
    assert prof[0].rows_with_missing == 30 and prof[0].rows_after == 1170
    assert clean.drop_incomplete(people, ["w"]).count() == 1170


def test_split_sizes_and_determinism(people):
    whole = split.stratified_split(people, "id", "g", seed=3)
    sides = {(r.g, r.split): r["count"] for r in whole.groupBy("g", "split").count().collect()}
    assert sum(v for (g, s), v in sides.items() if s == "test") == 300
    assert sides["hot", "train"] == 300 and sides["hot", "test"] == 100
    want = {(r.id, r.split) for r in whole.collect()}
    for parts, slice_rows in ((1, None), (7, 40), (32, 9)):
        again = split.stratified_split(people.repartition(parts), "id", "g", seed=3, slice_rows=slice_rows)
        assert {(r.id, r.split) for r in again.collect()} == want
    assert {(r.id, r.split) for r in split.stratified_split(people, "id", "g", seed=4).collect()} != want


def test_split_refuses_small_strata(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id bigint, g string")
    with pytest.raises(ValueError):
        split.stratified_split(df, "id", "g")
    with pytest.raises(ValueError):
        split.stratified_split(spark.range(8).withColumn("g", F.col("id") % 4), "id", "g")


def test_folds_are_balanced_and_repeatable(people):
    want = {r.id: r.folds for r in split.stratified_kfold(people, "id", "y", 5, [1, 2, 3]).collect()}
    assert len(want) == 1200
    for s in range(3):
        assert [sum(f[s] == i for f in want.values()) for i in range(5)] == [240] * 5
    for parts, slice_rows in ((1, 30), (32, 500)):
        got = split.stratified_kfold(people.repartition(parts), "id", "y", 5, [1, 2, 3], slice_rows)
        assert {r.id: r.folds for r in got.collect()} == want


def test_reading_by_extension(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "n int, t string").coalesce(1)
    df.write.parquet(str(tmp_path / "a.PQ"))
    df.write.option("header", True).csv(str(tmp_path / "a.CSV"))
    df.write.option("header", True).option("sep", "\t").csv(str(tmp_path / "a.txt"))
    for name in ("a.PQ", "a.CSV", "a.txt"):
        assert sorted(map(tuple, tables.read_table(spark, str(tmp_path / name)).collect())) == [(1, "x"), (2, "y")]
    (tmp_path / "list.txt").write_text("w\n\n  v.1 \nnone such\n")
    names = tables.read_feature_list(spark, str(tmp_path / "list.txt"))
    assert names == ["w", "v.1", "none such"] and tables.resolve_features(df, names) == []
    with pytest.raises(ValueError):
        tables.resolve_features(df, names, strict=True)


def test_run_matrix(spark, people, tmp_path):
    (tmp_path / "runs.csv").write_text(
        'dataset,featureset,response,cols_to_balance,random_state,folds\n'
        'd1,f1,y,"[\'g\', \'y\']",3,5\nd2,f1,y,"[\'g\']",4,5\n')
    runs = tables.read_run_matrix(spark, str(tmp_path / "runs.csv"))
    assert [r["cols_to_balance"] for r in runs] == [["g", "y"], ["g"]]
    out = tables.run_matrix(runs, lambda r: people.agg(F.count(F.lit(1)).alias("n")))
    assert {tuple(r) for r in out.collect()} == {("d1", "f1", 3, 1200), ("d2", "f1", 4, 1200)}


def test_metrics_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, .5, .25, ["a b"], []), (2, .75, 1.0, [], ["c", "d"])],
        "NumFeatures int, Validation_Set_Concordance double, Test_Set_Concordance double,"
        " `HR > 1 Features` array<string>, `HR < 1 Features` array<string>").coalesce(1)
    tables.write_metrics(df, str(tmp_path / "m"))
    back = tables.read_metrics(spark, str(tmp_path / "m"))
    assert back.columns == tables.SURVIVAL_METRICS
    assert [tuple(r) for r in back.orderBy("NumFeatures").collect()] == [
        (1, .5, .25, "a b", ""), (2, .75, 1.0, "", "c, d")]
    labelled = report.model_label(back).orderBy("NumFeatures").collect()
    assert [r.Features for r in labelled] == ["a b", "c, d"]


def test_preparation_orders(people):
    base = people.withColumnRenamed("v.1", "v")
    log = prepare_logistic(base, "id", ["v", "w"], "y", ["g"], seed=1, drop=("v",), protect="v",
                           log_cols=("w",), report=True)
    assert log.features == ["v", "w", "w_log"] and log.train.count() + log.test.count() == 1170
    assert log.top_pairs.count() == 1 and log.strata_train.count() == 5
    surv = prepare_survival(base, "id", ["v", "w"], "event", "time", ["g"], seed=1, log_cols=("w",), shift_from="train")
    assert surv.train.count() + surv.test.count() == 1170
    assert surv.train.columns == surv.test.columns == ["id", "v", "w", "event", "time", "w_log"]


def test_profiling(people):
    c = correlations(people, "id", ["v.1", "absent", "w"])
    assert c.top.count() == 1 and c.tests.first().n == 1170
    d = distributions(people, "id", ["v.1", "w"])
    assert d.bins.agg(F.sum("n")).first()[0] == 2340 and d.skewness.count() == 2
    matrix = profile.spearman_matrix(people.withColumn("v2", F.col("`v.1`") * 2), "id", ["v.1", "v2", "time"])
    assert profile.drop_correlated(matrix, ["v.1", "v2", "time"]) == ["v.1", "time"]
    assert profile.drop_correlated(matrix, ["v.1", "v2", "time"], protect=("v2",)) == ["v.1", "v2", "time"]
