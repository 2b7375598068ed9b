import random
import re
from collections import Counter

import numpy as np
import pytest

from cohortry.llm import collocations as module
from cohortry.llm.collocations import Packing, collocations, from_filter, ordered, to_filter
from cohortry.llm.registry import ORACLES, QUERIES


def plain(rows, least=30, longest=4, top=2000):
    """The contract, phrase by phrase."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f.update((lang, *w[i:i + m]) for i in range(len(w) - m + 1))
    cands = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    dropped = {p[:1] + p[i:i + m] for p, a in cands.items() for m in range(2, len(p) - 1) for i in range(1, len(p) - m + 1)
               if 100 * a >= 80 * cands[p[:1] + p[i:i + m]]}
    out = {}
    for p, a in cands.items():
        if p in dropped:
            continue
        cuts = []
        for k in range(1, len(p) - 1):
            l_, r = f[p[:k + 1]], f[p[:1] + p[k + 1:]]
            cuts.append((2000000 * a // (l_ + r), k, l_, r))
        score, _, l_, r = min(cuts)
        out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), l_, r))
    return sorted((lang, k, ph.decode(), -a, l_, r, n[lang], -s) for lang, rows in out.items()
                  for k, (s, a, ph, l_, r) in enumerate(sorted(rows)[:top], 1))


def corpus(seed=3, rows=300):
    rng = random.Random(seed)
    words = ["New", "york", "CITY", "de", "la", "été", "東京", "x\x1cy", "a\x85b", "\xa0", "of"] + [f"w{k}" for k in range(15)]
    out = []
    for _ in range(rows):
        text = ""
        for _ in range(rng.randrange(40)):
            text += rng.choice(["New York city of", "de la\tété", rng.choice(words), rng.choice(words)]) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0c"])
        out.append((rng.choice(["en", "en", "fr", None]), text))
    return out + [("en", None), (None, None), ("empty", ""), ("dots", "..."), ("en", "copy of a line " * 40), ("fr", "la " * 200)]


@pytest.mark.parametrize("size, entries, least, top", [(2_000_000, 1_000_000, 30, 2000), (500, 100, 5, 25)])
def test_against_brute_force(spark, size, entries, least, top):
    rows = corpus()
    df = spark.createDataFrame([(k, t, lang, 1, "z") for k, (lang, t) in enumerate(rows)],
                               "doc_id long, text string, lang string, rank int, phrase string").repartition(6)
    got = collocations(df, least=least, top=top, size=size, entries=entries)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, least=least, top=top)


def test_long_texts_are_taken_in_blocks(spark, monkeypatch):
    from cohortry.llm.common import blocks
    text = corpus()[7][1] * 3
    whole, parts = module._Chunk(), module._Chunk()
    whole.add(text.encode())
    monkeypatch.setattr(module, "blocks", lambda data: blocks(data, 9))
    parts.add(text.encode())
    assert np.concatenate(whole.parts).tolist() == np.concatenate(parts.parts).tolist()


@pytest.mark.parametrize("n, bits", [(2, 1), (2, 7), (3, 17), (4, 16), (4, 17), (2, 32), (3, 32), (4, 31)])
def test_packing_and_filters_lose_nothing(n, bits):
    rng = np.random.default_rng(n * 100 + bits)
    words = [rng.integers(0, 1 << bits, 3000).astype("<u4") for _ in range(n)]
    packing = Packing(n, bits)
    lanes = packing.pack(words)
    assert all((a == b).all() for a, b in zip(packing.unpack(lanes), words))
    keys, counts = ordered(lanes)
    assert dict(zip(zip(*map(np.ndarray.tolist, packing.unpack(keys))), counts.tolist())) == Counter(zip(*map(np.ndarray.tolist, words)))
    for lead in (0, 3):
        back, same = from_filter(*to_filter(keys, counts, packing.width, lead), packing.width)
        assert all((a == b).all() for a, b in zip(back, keys)) and (same == counts).all()
    assert all(len(x) == 0 for x in ordered([x[:0] for x in lanes])[0])


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F
    big = 9_000_000_000_000_000_000
    row = spark.createDataFrame([(big, big, 7)], "a long, l long, r long")
    assert row.select(module._exact_score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 2_000_000 * big // (big + 7)


def test_empty(spark):
    assert collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).count() == 0


def test_registered_query(spark):
    from check_oracle import compare, connect
    path = "/root/testdata/sf0.001"
    assert not compare(connect(path), QUERIES["op12_collocations"](spark, path), ORACLES["op12_collocations"])
