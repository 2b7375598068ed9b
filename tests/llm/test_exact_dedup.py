import hashlib
import re

import pytest

from cohortry.llm.exact_dedup import KEY, drop_copies, exact_dedup, merge_round, merge_runs, sorted_runs
from cohortry.llm.registry import ORACLES, QUERIES


def plain(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    out = []
    for k, (i, t) in enumerate(norm):
        same = [(x is None, x, j) for j, (x, u) in enumerate(norm) if u == t]
        out.append((str(i), str(min(same)[1]), len(same), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


ROWS = [(5, "a b"), (3, "a\t\n b"), (9, "a  b"), (4, " a b"), (7, None), (8, ""), (2, " "), (1, "\n"), (10, "a\xa0b"), (11, "a\x1cb"), (12, "A b"),
        (3, "a b"), (3, "a\t\n b"), (None, "only"), (None, "only"), (None, "a b"), (20, "x" * 300_000), (19, "x" * 300_000)] + [
            (100 + i, "hot  text") for i in range(200)]


@pytest.mark.parametrize("parts, fan_in", [(1, 16), (7, 2), (40, 4)])
def test_against_brute_force(spark, parts, fan_in):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in ROWS], "doc_id long, text string, keep_id int, kept string").repartition(parts)
    got = exact_dedup(df, fan_in=fan_in).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == plain(ROWS)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_dropping(spark):
    df = spark.createDataFrame([(i, t, k, "x") for k, (i, t) in enumerate(ROWS)], "doc_id long, text string, n int, _sha string").repartition(5)
    kept = drop_copies(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in rows]
    assert sorted(texts) == sorted({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in ROWS})
    want = {t: i for i, i2, _, t in ((a, b, c, d) for a, b, c, d in plain(ROWS)) if i == i2}
    assert {hashlib.sha256(t.encode()).hexdigest(): str(r.doc_id) for t, r in zip(texts, rows)} == want


def test_equal_digests_of_different_texts_stay_apart(spark):
    # Three texts forged to one digest; hash and length tell them apart at every level.
    rows = [(r, (False, i, i), bytearray(b"d" * 32), check, size) for r, i, check, size in
            [(0, 5, 1, 10), (1, 4, 1, 10), (2, 3, 2, 10), (3, 2, 1, 11), (37, 1, 2, 10)]]
    df = spark.createDataFrame(rows, "_run int, _who struct<none:boolean,id:long,row:long>, __dedup_sha binary, __dedup_check long, __dedup_bytes int")
    got = {(r["_who"]["id"], r["_n"]) for r in merge_runs(df, 4).collect()}
    assert got == {(4, 2), (1, 2), (2, 1)}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup(df).count() == 0 and drop_copies(df).count() == 0


def test_registered_query(spark):
    from check_oracle import compare, connect
    path = "/root/testdata/sf0.01"
    assert not compare(connect(path), QUERIES["op10_exact_dedup"](spark, path), ORACLES["op10_exact_dedup"])
    plan = exact_dedup(spark.read.parquet(f"{path}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_stage_functions_keep_columns_of_any_name(spark):
    from cohortry.llm.language import identify_language, train_language_model
    from cohortry.llm.simhash import drop_near_copies
    names = ["__dedup_sha", "__dedup_check", "__dedup_bytes", "__dedup_norm", "__simhash_id", "__language"]
    rows = [(k, t, *[f"{c}{k}" for c in names]) for k, t in ((1, "one text of words"), (2, "one  text of words"), (3, None), (4, "another text"), (4, "another text"))]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    kept = drop_copies(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, *[r[c] for c in names]) for r in kept.collect()) == sorted({(r[0], *r[2:]) for r in rows if r[0] != 2})
    near = drop_near_copies(df)
    assert near.columns == df.columns and {tuple(r) for r in near.collect()} <= set(rows)
    model = train_language_model(spark.createDataFrame([("one text", "en"), ("ein wort", "de")], "text string, lang string").selectExpr("monotonically_increasing_id() doc_id", "*"))
    said = identify_language(df, model)
    assert set(said.columns) == {*df.columns, "lang_pred", "score"} and {r["__language"] for r in said.collect()} == {r[-1] for r in rows}


def test_every_round_comes_out_sorted(spark):
    """A round's partitions are sorted by slice, run and digest, hold whole runs of a slice, and have every digest once."""
    rows = spark.range(3000).selectExpr(
        "cast(id % 40 as int) AS _run", "named_struct('none', false, 'id', id, 'row', id) AS _who", "unhex(sha2(cast(id % 700 as string), 256)) AS __dedup_sha",
        "xxhash64(id % 700) AS __dedup_check", "cast(3 as int) AS __dedup_bytes")
    level = sorted_runs(rows)
    for runs in (10, 3, 1):
        level = merge_round(level, 2)
        got = level.selectExpr("spark_partition_id() AS part", "monotonically_increasing_id() AS at", "_slice", "_run", *KEY, "_who", "_n").orderBy("at").collect()
        parts, where = {}, {}
        for r in got:
            parts.setdefault(r.part, []).append((r["_slice"], r["_run"], bytes(r[KEY[0]])))
            where.setdefault((r["_slice"], r["_run"]), set()).add(r.part)
        assert all(p == sorted(set(p)) for p in parts.values()) and all(len(x) == 1 for x in where.values())
        assert {r["_run"] for r in got} == set(range(runs)) and sum(r["_n"] for r in got) == 3000
    assert level.count() == 700
