import random

import numpy as np
import pytest
import xxhash

from cohortry.llm.components import connected_components
from cohortry.llm.registry import QUERIES
from cohortry.llm.simhash import drop_near_copies, fingerprint, simhash_components, tile_links


def plain_fingerprint(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in low).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=4):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(fps)):
        for y in range(x):
            if (fps[x][1] ^ fps[y][1]).bit_count() <= radius:
                parent[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(fps):
        if i is not None:
            least[root(x)] = min(i, least.get(root(x), i))
    return sorted((i, f"{f:016x}", least.get(root(x))) for x, (i, f) in enumerate(fps) if i is not None)


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 90)))) for i in range(150)]
    for i in range(150, 230):      # near copies: one word of a long text differs
        base = rows[rng.randrange(0, 150)][1].split(" ")
        base[rng.randrange(len(base))] = rng.choice(words)
        rows.append((i, " ".join(base)))
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "ONE Word"), (304, "one\tword"), (305, "a b c d e " * 4000),
             (3, rows[3][1]), (306, "x\x1cy z"), (307, "x y z")]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "c", "f") for i, t in rows], "doc_id long, text string, component_id string, fp string")
    got = sorted(tuple(r) for r in simhash_components(df, tile_rows=20).collect())
    assert got == plain_components(rows)
    kept = drop_near_copies(df)
    assert kept.columns == df.columns
    firsts = {c for _, _, c in got}
    assert {r.doc_id for r in kept.collect()} == firsts


def test_fingerprint_matches_plain():
    for _, text in corpus():
        assert fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 3, 4])
def test_tiles_find_every_link(radius):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 120, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 120).astype(np.uint64)) ^ np.uint64(5)
    fps = np.unique(np.concatenate([base, near]))
    for a, b in ((fps, None), (fps[:100], fps[100:])):
        links = tile_links(a, b, radius)
        parent = {int(x): int(x) for x in fps.view(np.int64)}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x
        for u, v in links:
            parent[root(u)] = root(v)
        left, right = (a, a) if b is None else (a, b)
        for x in left:
            for y in right:
                if int(x ^ y).bit_count() <= radius:
                    assert root(int(x.view(np.int64))) == root(int(y.view(np.int64)))
        for u, v in links:
            assert u != v


def test_nulls_and_empty(spark):
    schema = "doc_id long, text string"
    empty = spark.createDataFrame([], schema)
    assert simhash_components(empty).columns == ["doc_id", "fingerprint", "component_id"]
    assert simhash_components(empty).count() == 0 and drop_near_copies(empty).count() == 0
    rows = [(None, "a b c"), (None, None), (7, None), (8, "A b\tc")]
    got = {(r[0], r[2]) for r in simhash_components(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(None, 8), (None, 7), (7, 7), (8, 8)}


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100), (200, 200)]
    got = connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    by = {}
    for r in got:
        by.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, by.values())) == [list(range(61)), [100, 101, 102]]


def test_registered_query(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in QUERIES["op6_simhash"](spark, path).collect())
    assert got == plain_components([(r.doc_id, r.text) for r in docs])
