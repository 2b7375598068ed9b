"""Language and quality models: held-out accuracy on the tables, and hand cases."""

import zlib

import numpy as np
import pytest

from cohortry.llm.language import LanguageModel, identify_language, train_language_model
from cohortry.llm.quality import QualityModel, fit_rows, hinge_fit, ngrams, score_quality, train_quality
from cohortry.llm.registry import QUERIES

PATH = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_language_held_out(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{PATH}/documents.parquet").collect()}
    got = QUERIES["op3_language"](spark, PATH).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in test]) > 0.97


def test_language_backoff():
    grams = [(2, {"ab": 0, "_x": 1}, np.array([[-1.0, -5.0], [-6.0, -2.0]])), (1, {"c": 0}, np.array([[-1.0, -3.0]]))]
    model = LanguageModel(["aa", "bb"], {"word": 0}, np.array([[-4.0, -1.0]]), grams)
    assert model.backoff("ab").tolist() == [-1.0, -5.0] and model.backoff("c").tolist() == [-1.0, -3.0] and model.backoff("q") is None
    assert model.predict("WORD")[0] == "bb" and model.predict("abab")[0] == "aa" and model.predict("zzz")[0] == "aa"
    for text in (None, "", " 12 ?!", "²", "_"):
        assert model.predict(text) == ("und", 0.0)


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string, score string, lang_pred int"
    rows = [(1, "uno dos tres", "es", "s", 1), (2, "one two three", "en", "s", 1), (2, "one two three", "en", "s", 1), (3, None, "en", "s", 1),
            (4, "dos", None, "s", 1), (None, "two " * 30_000, "en", "s", 1)]
    df = spark.createDataFrame(rows, schema)
    model = train_language_model(df)
    got = identify_language(df, model)
    assert set(got.columns) == set(df.columns)
    said = {(r.doc_id, r.lang_pred) for r in got.collect()}
    assert said == {(1, "es"), (2, "en"), (3, "und"), (4, "es"), (None, "en")} and got.count() == 6
    none = train_language_model(df.limit(0))
    assert identify_language(df, none).where("lang_pred <> 'und'").count() == 0 and identify_language(df.limit(0), model).count() == 0


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{PATH}/labels.parquet").collect()}
    got = QUERIES["op1_quality"](spark, PATH).collect()
    assert len(got) == spark.read.parquet(f"{PATH}/documents.parquet").count()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    test = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in test if y == 1], [s for s, y in test if y == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([(s >= 0.3) == (y == 1) for s, y in test]) > 0.93


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x, costs = rng.normal(size=(60, 4)), np.full(60, 0.7)
    signs = np.where(x[:, 0] + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    w, alpha = hinge_fit([(np.arange(4), row) for row in x], signs, 4, costs, rounds=300)
    full = np.hstack([x, np.ones((60, 1))])
    primal = 0.5 * w @ w + costs @ np.maximum(0, 1 - signs * (full @ w))
    dual = alpha.sum() - 0.5 * np.sum((full.T @ (alpha * signs)) ** 2)
    assert (alpha >= 0).all() and (alpha <= costs + 1e-12).all() and abs(primal - dual) < 1e-3 * primal


def test_quality_edges(spark):
    assert ngrams(None) == ngrams(" ") == {"empty"}
    assert "a b" in ngrams("A b") and "s:=" in ngrams("x x")
    docs = spark.createDataFrame([(i, "good words here and there" if i % 2 else "JUNK!! JUNK!!", "s", i) for i in range(60)] + [
        (60, None, "s", 1), (61, "", "s", 1), (None, "good words", "s", 1), (1, "good words here and there", "s", 1), (62, "JUNK!! " * 50_000, "s", 1)],
        "doc_id long, text string, score string, predicted int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, 1), (70, None), (999, 0)], "doc_id long, quality int")
    model = train_quality(docs, labels)
    got = {(r.doc_id, r.predicted) for r in score_quality(docs, model).collect() if r.doc_id not in (60, 61)}
    assert {(i, i % 2) for i in range(60)} <= got and (None, 1) in got and (62, 0) in got
    assert score_quality(docs, model).count() == 65 and score_quality(docs.limit(0), model).count() == 0
    for y in ([], [1.0, 1.0]):
        flat = fit_rows({}, [np.zeros(0, np.int64)] * len(y), np.array(y), np.ones(len(y)))
        assert flat.score("any") == flat.score(None) == pytest.approx(0.75 if y else 0.5)
    assert isinstance(train_quality(docs, labels.limit(0)), QualityModel)
