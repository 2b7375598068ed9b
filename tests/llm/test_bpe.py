import hashlib
import os
import random
from urllib.parse import urlparse

import pyarrow as pa
import pytest
import tiktoken

from cohortry.llm import bpe
from cohortry.llm.bpe import bpe_decode, bpe_digests, bpe_encode, read_ranks
from cohortry.llm.common import shared_dir
from cohortry.llm.registry import QUERIES


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=read_ranks(), special_tokens={})


def texts():
    rng = random.Random(1)
    words = ["the", "Théâtre", "naïve", "東京", "ｆｕｌｌ", "🙂", "ab", "aaa", "x1", "12345", "don't", "we'll", "--", "...", "\t", "\n\n", " ", "　", "\x85"]
    out = [None, "", " ", "  \n ", "<|endoftext|>", "a", "é", "\x00", "a b", "trailing   ", "\r\n x", "'s's'S"]
    out += ["".join(rng.choice(words) + rng.choice(["", " ", "  "]) for _ in range(rng.randrange(60))) for _ in range(60)]
    out += ["".join(rng.choice("abcdeth") for _ in range(n)) for n in (2, 5, 40, 63, 64, 65, 300, 900)]
    out += ["a" * 3000, "ab" * 700, "=" * 500, "aab" * 130 + "é" * 90, "ACGT" * 90, " " * 400, "\n" * 90, "7" * 200]
    return out


@pytest.mark.parametrize("words", [0, 1 << 20])
def test_against_the_library(spark, plain, words):
    rows = [(k, t, "x", 1) for k, t in enumerate(texts())] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, __often int").repartition(5)
    out = bpe_encode(df, words=words)
    assert sorted(out.columns) == sorted(df.columns)
    got = out.withColumn("back", bpe_decode(out["ids"])).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == plain.encode_ordinary(r.text or ""), r.text
        assert bytes(r.back) == (r.text or "").encode() and r["__often"] == 1


def test_ties_of_one_rank_go_to_the_leftmost(spark):
    """A made vocabulary in which one token is cut in two ways and longer tokens rank below their parts."""
    alphabet = b"abc"
    tokens = [b"a", b"b", b"c", b"ab", b"bc", b"abcab", b"abc", b"ca", b"aa", b"aaa", b"cab", b"abab", b"aba", b"bcb"]
    ranks = {bytes([b]): 100 + b for b in range(256) if b not in alphabet} | {t: k for k, t in enumerate(tokens)}
    plain = tiktoken.Encoding("made", pat_str=r"\w+|\W", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(n)) for n in [*range(1, 40), *range(60, 130, 3)] for _ in range(4)]
    import base64
    import os
    import tempfile
    path = os.path.join(tempfile.mkdtemp(), "made.tiktoken")
    with open(path, "wb") as f:
        f.writelines(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items())
    df = spark.createDataFrame([(w,) for w in words], "text string")
    for r in bpe_encode(df, ranks=path, pattern=r"\w+|\W", words=0).collect():
        assert r.ids == plain.encode_ordinary(r.text), r.text


def test_neither_plan_nor_driver_holds_words(spark, plain):
    """Words of the corpus are not counted, written or put in the plan beforehand: one scan without a subquery."""
    df = spark.range(4000).selectExpr("concat_ws(' ', hex(id * 7919), hex(id * 7919), 'zq', hex(id)) AS text").repartition(3)
    folder = urlparse(shared_dir(spark)).path
    before = set(os.listdir(folder))
    out = bpe_encode(df)
    assert all(r.ids == plain.encode_ordinary(r.text) for r in out.collect())
    assert set(os.listdir(folder)) == before
    assert "ubquery" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("words", [0, 1, 4, 1 << 19])
def test_few_remembered_words_change_nothing(plain, monkeypatch, words):
    monkeypatch.setattr(bpe, "ROWS", 7)
    cut = [[w for w in (t or "").split("b") if w] for t in texts()]
    batch = pa.array([[]] * 2 + cut * 2, pa.list_(pa.string()))
    got = [ids for part in bpe.encoder(read_ranks(), words)(iter([batch.slice(1), batch.slice(0, 0), batch.slice(0, 2)]))
           for ids in part.to_pylist()]
    want = [[i for w in c for i in plain._core_bpe.encode_single_piece(w.encode())] for c in cut]
    assert got == [[], *want, *want, [], []]


def test_a_long_word_without_repeats(spark, plain):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäß東") for _ in range(n)) for n in (127, 128, 129, 60_000)]
    for r in bpe_encode(spark.createDataFrame([(w,) for w in words], "text string")).collect():
        assert r.ids == plain.encode_ordinary(r.text)


def test_only_empty_texts(spark):
    df = spark.createDataFrame([("",), (None,)], "text string").coalesce(1)
    assert [r.ids for r in bpe_encode(df).collect()] == [[], []]


def test_empty(spark):
    assert bpe_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_registered_query(spark, plain):
    path = "/root/testdata/sf0.001"
    want = set()
    for r in spark.read.parquet(f"{path}/documents.parquet").collect():
        ids, text = plain.encode_ordinary(r.text or ""), (r.text or "").encode()
        want.add((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
    got = QUERIES["op11_bpe"](spark, path).collect()
    assert {tuple(r) for r in got} == want and got[0].__fields__ == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
