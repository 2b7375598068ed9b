import hashlib
import math
import re
import zlib

import pytest

from cohortry.llm.registry import QUERIES
from cohortry.llm.resample import BUCKETS, bucket_gains, features, importance_resample


def runs(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(docs, target, percent=5, least=20):
    """The contract, row by row."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for texts, into in (([d[1] for d in docs], s), (target, t)):
        for text in texts:
            for f in runs(text)[1]:
                into[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)]
    out, able = [], []
    for k, (i, text) in enumerate(docs):
        words, found = runs(text)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(words) >= least:
            able.append(k)
    able.sort(key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0))
    for rank, k in enumerate(able[:percent * len(able) // 100], 1):
        out[k][4] = rank
    return sorted(map(tuple, out), key=str)


WORDS = "Alpha beta, gamma-DELTA été Ünder 東京 x1y2 _under_ a\x00b tail line \x85 dot.com".split(" ")


@pytest.mark.parametrize("percent", [5, 50, 100])
def test_against_brute_force(spark, percent):
    docs = [(k, " ".join(WORDS[(k * j) % len(WORDS)] for j in range(k % 45))) for k in range(120)]
    docs += [(None, "one two " * 15), (500, None), (501, ""), (502, "..."), (7, docs[7][1]), (44, docs[44][1])]
    target = ["Alpha beta gamma", None, "", "alpha beta x1y2 tail"]
    df = spark.createDataFrame([(*d, 1, "z", 0.5) for d in docs], "doc_id long, text string, rank int, score string, id double").repartition(7)
    got = importance_resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, target, percent)


def test_blocks_of_a_long_text_change_nothing(monkeypatch):
    import cohortry.llm.resample as module
    from cohortry.llm.common import blocks
    text = (" ".join(WORDS) * 50).encode()
    whole = [(n, dict(c)) for n, c in features(text)]
    assert len(whole) == 1
    for size in (1, 7, 40, 500):
        monkeypatch.setattr(module, "blocks", lambda data, size=size: blocks(data, size))
        parts = list(features(text))
        total = sum((c for _, c in parts), start=type(parts[0][1])())
        assert len(parts) > 1 and (sum(n for n, _ in parts), dict(total)) == whole[0]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "w " * 20)], "doc_id long, text string")
    assert importance_resample(none, one).count() == 0
    assert [r["rank"] for r in importance_resample(one, none, percent=100).collect()] == [1]
    assert set(bucket_gains(*[importance_resample.__globals__["bucket_totals"](none)] * 2)) == {0}


def test_registered_query(spark):
    path = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    got = QUERIES["op13_resample"](spark, path).collect()
    assert BUCKETS == 10000 and sorted(map(tuple, got), key=str) == plain(docs, target)
