import re

import corpus_pipeline
from cohortry.llm.decontaminate import allowed, best_occurrence, words_of
from cohortry.llm.language import UNKNOWN
from test_packing import check
from test_simhash import plain_components


def plain_kept(docs, items):
    """What the first four stages keep, by brute force."""
    docs = [(i, t) for i, t in docs if t is not None and any(c.isalpha() for c in t)]
    first = {}
    for i, t in docs:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        first[key] = min(i, first.get(key, i))
    docs = [(i, t) for i, t in docs if first[re.sub(r"[\x20\x09-\x0D]+", " ", t)] == i]
    named = {i: c for i, _, c in plain_components(docs)}
    docs = [(i, t) for i, t in docs if named[i] == i]
    coded = [words_of(t) for _, t in items]
    out = []
    for i, t in docs:
        w = words_of(t)
        grams = {tuple(w[k:k + 3]) for k in range(len(w) - 2)}
        if not any(any(tuple(x[k:k + 3]) in grams for k in range(len(x) - 2)) and best_occurrence(x, w)[0] <= allowed(len(x)) for x in coded):
            out.append((i, t))
    return out


def test_run_against_brute_force(spark):
    path = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    want = plain_kept(docs, items)
    got = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in got} == {i for i, _ in want} and 0 < len(want) < len(docs)
    check(want, got)


def test_stages_keep_columns_and_survive_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, fingerprint int, kept int"
    text = "these are some ordinary words of a clean document number {}"
    rows = [(i, text.format(f"w{i} x{i * 7} y{i * 3}"), "en", "s", 1, "x", 1, 1) for i in range(30)]
    rows += [(40, None, None, None, None, None, None, None), (41, "", "en", "s", 1, "x", 1, 1), (42, "123 !!", "en", "s", 1, "x", 1, 1),
             (3, rows[3][1], "en", "s", 1, "x", 1, 1), (50, rows[3][1], "en", "s", 1, "x", 1, 1), (51, "benchmark passage one two three four five six", None, "s", 1, "x", 1, 1)]
    spark.createDataFrame([(1, "passage one two three four five six")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
        docs = spark.createDataFrame(kept.collect(), schema)
    left = [r.doc_id for r in docs.collect()]
    assert len(left) == len(set(left)) and not {40, 41, 42, 50, 51} & set(left) and 3 in left
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()} == set(left)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert UNKNOWN == "und" and len(corpus_pipeline.STAGES) == 5
