import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cohortry.llm.packing import cut, pack, packed_ids, sum_of_squares
from cohortry.llm.registry import QUERIES

FILE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return [*FILE.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, got, length=2048):
    """Every piece has the ids of its place in its document, and sequences are gapless and within the length."""
    docs = {}
    for i, t in rows:
        docs.setdefault(i, []).append(ids_of(t))
    pieces = {}
    for r in got:
        pieces.setdefault((r.doc_id, r.piece), []).append(r)
    for i, lists in docs.items():
        want = sorted((s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes()), k)
                      for ids in lists for k, (s, n) in enumerate(cut(len(ids), length)))
        assert sorted((r.start, r.length, r.ids_crc32, r.piece) for r in got if r.doc_id == i) == want
    spans = {}
    for r in got:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for span in spans.values():
        at = 0
        for offset, n in sorted(span):
            assert offset == at
            at += n
        assert at <= length
    return len(spans)


def corpus():
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["the", "of", "année", "x!!", "12", "\n", "  ", "日本", "don't"], k=rng.randint(0, 900)))) for i in range(120)]
    return rows + [(200, None), (201, ""), (202, "word " * 9000), (203, "a <|endoftext|> b"), (204, "tab\t\tspace  \n\n end  "), (5, rows[5][1]), (None, "nobody"),
                   (205, "a\x1c\x1cb\x85\xa0 c  d"), (206, " " * 5000)]


def test_against_the_tokenizer_file(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, piece int, offset string")
    for group in (50, 100_000):
        got = pack(df, group=group).collect()
        used = check(rows, got)
        least = -(-sum(len(ids_of(t)) for _, t in rows) // 2048)
        assert used <= least + (2 if group > 1000 else 5)      # 120 short documents leave few choices


def test_sequences_hold_the_ids(spark):
    rows = [x for x in corpus() if x[0] is not None and x[0] != 5]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = [r.ids for r in packed_ids(df, length=512).collect()]
    assert max(map(len, whole)) <= 512
    assert sum(map(len, whole)) == sum(len(ids_of(t)) for _, t in rows)
    text = [x for w in whole for x in w]
    assert text.count(0) >= len(rows)


def plain_rule(sizes, length):
    """The rule, by trying every open sequence."""
    gaps, out = [], []
    for s in sizes:
        fit = sorted({g for g in gaps if g >= s})

        def after(g):
            rest = list(gaps)
            rest.remove(g)
            rest.append(g - s)
            return sum(rest.count(x) ** 2 for x in set(rest) if x > 0)
        if fit:
            g = min(fit, key=lambda g: (after(g), g))
            gaps.remove(g)
        else:
            g = length
        gaps.append(g - s)
        out.append(length - g)
    return out, len(gaps)


def test_rule():
    rng = random.Random(3)
    for _ in range(40):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(0, 40))]
        seq, offset, made = sum_of_squares(np.array(sizes, np.int64), 20)
        want, n = plain_rule(sizes, 20)
        assert offset.tolist() == want and made == n


def test_cut():
    assert cut(1) == [(0, 1)] and cut(2048) == [(0, 2048)] and cut(2049) == [(0, 1), (1, 2048)]
    assert cut(5000) == [(0, 904), (904, 2048), (2952, 2048)]


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_registered_query(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, QUERIES["op7_packing"](spark, path).collect())
