"""Medians of large keys without shuffling or writing rows; pair counting in groups of keys; scratch checkpoints go."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import pairs, quantiles, running, scoring


@pytest.mark.parametrize("fetch", [0, 30, 1_000_000])
def test_quantiles_of_large_keys_by_counting(spark, monkeypatch, fetch):
    monkeypatch.setattr(quantiles, "FETCH_ROWS", fetch)
    monkeypatch.setattr(quantiles, "SELECT_BITS", 6)
    monkeypatch.setattr(quantiles, "running_totals", None)      # no order of all rows
    rng = np.random.default_rng(2)
    groups = {"wide": rng.normal(size=301) * 10.0 ** rng.integers(-200, 200, 301), "ties": rng.integers(0, 3, 200) * 1.0,
              None: rng.normal(size=50), "one": np.array([4.0]), "zeros": np.array([-0.0, 0.0, 0.0]), "inf": np.array([-np.inf, 1.0, 2.0, np.inf, np.inf])}
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("wide", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: (r.q, r.m) for r in quantiles.exact_quantiles(df, ["k"], "v", {"q": 0.1, "m": 0.5}, window_rows=0).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        if k != "inf":
            assert got[k] == pytest.approx(tuple(np.quantile(values, [.1, .5])), rel=1e-12)
    assert got["inf"][1] == 2.0


def test_pairs_of_many_keys_are_dealt_out_in_groups(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(k), float(s), float(t), int(e)) for k, s, t, e in zip(
        rng.integers(0, 5, 600), rng.normal(size=600), rng.integers(1, 30, 600), rng.integers(0, 2, 600))]
    df = spark.createDataFrame(rows, "k int, s double, t double, e int")

    def found():
        return sorted(map(tuple, scoring.comparable_pairs(df, ["k"], "s", "t", "e", local_rows=0, partition_rows=50).collect()))

    whole = found()
    written, real = [], pairs.durable
    monkeypatch.setattr(pairs, "durable", lambda df: written.append(df) or real(df))
    monkeypatch.setattr(pairs, "DEALT_ROWS", 250)
    assert found() == whole and len(written) == 3


def test_checkpoints_of_a_scratch_analysis_go(spark):
    def file(df):
        return df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")

    with running.analysis(scratch=True) as made:
        with running.analysis():
            gone, kept = (running.durable(spark.range(20).withColumn("v", F.lit(n))) for n in (1, 2))
        files = file(gone), file(kept)
        assert all(map(os.path.isdir, files))
        made[:] = [df for df in made if df is not kept]
    later = running.durable(spark.range(3))
    assert not os.path.isdir(files[0]) and os.path.isdir(files[1]) and os.path.isdir(file(later)) and kept.count() == 20


def test_a_run_leaves_its_files_only(spark, monkeypatch, tmp_path):
    """Caches and checkpoints of one run of a run matrix are gone before the next begins."""
    from cohortry.plans import runs
    made = []

    def body(*args):
        made.extend([running.hold(spark.range(5)), running.durable(spark.range(7))])
        return "files"

    monkeypatch.setattr(runs, "_survival_run", body)
    assert runs.survival_run(spark, {}, None) == "files"
    cached, checkpoint = made
    file = checkpoint._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    assert not cached.is_cached and not os.path.isdir(file)
