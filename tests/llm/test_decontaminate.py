import gc
import random
import weakref

import numpy as np

from cohortry.llm import decontaminate
from cohortry.llm.decontaminate import (allowed, best_occurrence, build_index, contaminated, drop_contaminated, walks, words_of)
from cohortry.llm.registry import QUERIES


def plain_best(item, text):
    """Smallest edit distance between the item and any stretch of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        above, row = row, [i]
        for j, x in enumerate(text, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (w != x)))
    return min(row)


def plain_hits(items, docs):
    """(doc, item, distance) of every pair within the allowed distance."""
    out = set()
    for d, text in docs:
        for i, item in items:
            a, b = words_of(item), words_of(text)
            if a and b and (n := plain_best(a, b)) <= allowed(len(a)):
                out.add((d, i, n))
    return out


def edited(rng, words, vocab, edits):
    w = list(words)
    for _ in range(edits):
        k, how = rng.randrange(len(w)), rng.choice("sid")
        if how == "d" and len(w) > 1:
            del w[k]
        elif how == "i":
            w.insert(k, rng.choice(vocab))
        else:
            w[k] = rng.choice(vocab)
    return w


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(300):
        item = [rng.randrange(4) for _ in range(rng.randint(1, 70))]
        text = [rng.randrange(4) for _ in range(rng.randint(1, 30))]
        assert best_occurrence(item, text)[0] == plain_best(item, text)


def test_walk_emits_words_in_order():
    codes = np.append(np.arange(1, 30, dtype=np.uint64), np.uint64(0))
    places = walks(codes, np.array([0, 5, 28]), 40)
    steps = np.diff(places, axis=1)
    assert set(np.unique(steps)) <= {0, 1} and places[:, 0].tolist() == [0, 5, 28] and places.max() <= 29


def test_recall_at_the_allowed_distance():
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randint(8, 60)))) for k in range(120)]
    index = build_index(items)
    lost = n = 0
    for k, text in items:
        words = text.split()
        for _ in range(3):
            inside = edited(rng, words, vocab, allowed(len(words)))
            doc = " ".join(rng.choices(vocab, k=40) + inside + rng.choices(vocab, k=40))
            lost += k not in [h[0] for h in index.find(doc)]
            n += 1
    assert lost <= 0.01 * n


def test_against_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(vocab, k=n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 9, 10, 14, 20, 31, 33, 50])]
    items += [(50, None), (51, ""), (52, "?!"), (None, "w1 w2 w3"), (53, items[9][1])]
    docs = [(k, " ".join(rng.choices(vocab, k=rng.randint(0, 150)))) for k in range(60)]
    for k in range(60, 120):
        words = rng.choice(items[5:13])[1].split()
        text = rng.choices(vocab, k=30) + edited(rng, words, vocab, rng.randint(0, allowed(len(words)) + 2)) + rng.choices(vocab, k=30)
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(text).upper()))
    docs += [(200, None), (201, ""), (202, items[12][1]), (203, "x " * 50_000 + items[11][1]), (None, items[10][1]), (202, items[12][1])]
    df = spark.createDataFrame([(d, t, 1, "s") for d, t in docs], "doc_id long, text string, item_id int, distance string")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = contaminated(df, table).collect()
    want = plain_hits([x for x in items if x[0] is not None and x[1]], [x for x in docs if x[1]])
    found = {(r.doc_id, r.item_id, r.distance) for r in got}
    assert found <= want
    assert len(want - found) <= 0.01 * len(want) and {x for x in want if x[2] == 0} <= found
    assert sum(r.doc_id == 202 and r.item_id == 12 for r in got) == 2
    bad = {d for d, _, _ in found}
    kept = drop_contaminated(df, table)
    assert kept.columns == df.columns
    assert sorted(map(str, {r.doc_id for r in kept.collect()})) == sorted(map(str, {d for d, _ in docs} - bad))


def test_empty(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert contaminated(docs.limit(0), items).count() == 0
    assert contaminated(docs, items.limit(0)).count() == 0 and drop_contaminated(docs, items.limit(0)).count() == 1
    assert [(r.doc_id, r.item_id, r.start_word, r.end_word, r.n_words, r.similarity) for r in contaminated(docs, items).collect()] == [(1, 1, 0, 3, 3, 1.0)]


def test_registered_query(spark):
    path = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{path}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id, r.distance) for r in QUERIES["op9_decontaminate"](spark, path).collect()}
    # Every pair in which the document has a few of the item's words in a row is compared in full.
    grams = {}
    for i, t in items:
        w = words_of(t)
        for k in range(len(w) - 2):
            grams.setdefault(tuple(w[k:k + 3]), set()).add(i)
    want = set()
    for d, t in docs:
        w = words_of(t)
        for i in {i for k in range(len(w) - 2) for i in grams.get(tuple(w[k:k + 3]), ())}:
            item = words_of(dict(items)[i])
            if (n := best_occurrence(item, w)[0]) <= allowed(len(item)):
                want.add((d, i, n))
    assert got == want and got


def test_items_without_or_with_other_identifiers(spark):
    docs = spark.createDataFrame([(1, "x one two three four five y"), (2, "six seven eight nine ten"), (3, "nothing of it here"), (4, "red green blue")],
                                 "doc_id long, text string")
    texts = ["one two three four five", "six seven eight nine ten", "red green blue", None]
    for ids, kind in (([None, None, 7, None], "long"), ([None, "a-2", "b-3", "c"], "string"), ([None, None, None, None], "int")):
        items = spark.createDataFrame(list(zip(ids, texts)), f"item_id {kind}, text string")
        assert [r.doc_id for r in drop_contaminated(docs, items).collect()] == [3]
        got = [(r.doc_id, r.item_id) for r in contaminated(docs, items).orderBy("doc_id").collect()]
        assert got == [(1, ids[0]), (2, ids[1]), (4, ids[2])]
        assert [r.doc_id for r in drop_contaminated(docs, items.unionByName(items), recall=0.9).collect()] == [3]
    both = spark.createDataFrame([("one two three four five, six seven eight nine ten",)], "text string").selectExpr("1 AS doc_id", "text")
    items = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (5, texts[1])], "item_id long, text string")
    assert [(r.item_id, r.start_word) for r in contaminated(both, items).collect()] == [(5, 5), (None, 0), (None, 5)]


def test_one_block_of_items_at_a_time(spark, monkeypatch):
    """An index is gone before the next one is built, whatever the number of blocks, and the blocks together find the same."""
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(vocab, k=12))) for k in range(64)]
    docs = [(k, " ".join(rng.choices(vocab, k=20)) + " " + (items[k][1] if k < 64 else "") + " " + " ".join(rng.choices(vocab, k=9))) for k in range(80)]
    df, table = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    alive, most = [], []

    def counted(*args):
        gc.collect()
        index = build_index(*args)
        alive.append(weakref.ref(index))
        most.append(sum(x() is not None for x in alive))
        return index

    monkeypatch.setattr(decontaminate, "build_index", counted)
    for block in (100, 8):
        most.clear()
        assert sorted((r.doc_id, r.item_id) for r in contaminated(df, table, block=block).collect()) == [(k, k) for k in range(64)]
        assert sorted(r.doc_id for r in drop_contaminated(df, table, block=block).collect()) == list(range(64, 80))
        assert len(most) == (2 if block == 100 else 16) and max(most) == 1
