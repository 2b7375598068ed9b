"""Benchmark decontamination by CGK embedding, bit sampling and exact edit verification.

Texts are compared as words.  The CGK random walk maps a window of words to a string of symbols: at step j it emits the
word it stands on and moves on by a random bit that depends on j and the word.  Two windows walk with the same bits,
so windows within a small edit distance fall into step again after each edit, and their embeddings are close in Hamming
distance.  A walk that was thrown off rarely recovers early, so several embeddings with bits of their own are made.
Each of several tables samples positions of one embedding; an item and a window that agree on all sampled positions of
a table are a candidate pair.  Windows of the size of the items start at every word, so whole texts are covered.
Candidates are verified by exact edit distance.

Windows are embedded only where they can matter: n words with at most d edits hold an unedited run of at least
(n - d) / (d + 1) of them (the pigeonhole principle), so a window without such a run of some item cannot match.  This
gate loses nothing.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

from cohortry.llm.common import col, durable

SIMILARITY = 0.8          # 1 - edits / words of the item
RECALL = 0.99             # of pairs at the allowed distance, for the number of tables
SAMPLE = 2                # embedding positions per table
AGREE = 0.25              # share of positions at which embeddings agree at the allowed distance, low estimate
WALKS = 6                 # independent embeddings; the tables are dealt to them in turn
WALK = 2                  # steps of the walk per word of the smallest item of a size class
BLOCK = 20_000            # items handled in one pass over the documents
WORD = re.compile(r"[^\W_]+")
HIT = "array<struct<item_id:{0},start_word:int,end_word:int,n_words:int,distance:int>>"


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return WORD.findall((text or "").lower())


def allowed(n: int, similarity: float = SIMILARITY) -> int:
    """Edits that an occurrence of an item of ``n`` words may have."""
    return int((1.0 - similarity) * n + 1e-9)


def _bits(word: str, seed: int) -> int:
    """64 random bits of a word."""
    data = word.encode()
    return zlib.crc32(data, seed) | zlib.crc32(data[::-1] + b"#", seed ^ 0x5BD1E995) << 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def walks(codes: np.ndarray, starts: np.ndarray, steps: int, which: int = 0) -> np.ndarray:
    """Embedding ``which`` of the windows that begin at ``starts``: the place in ``codes`` of the word at every step.

    A window that runs past the end stands on the last code, which the caller makes a blank.
    """
    at = starts.astype(np.int64)
    out = np.empty((len(starts), steps), np.int32)
    last = len(codes) - 1
    for j in range(steps):
        out[:, j] = at
        if j % 48 == 0:
            random = _mix(_mix(codes + np.uint64(1_000 * which + j + 1)))
        at = np.minimum(at + ((random[at] >> np.uint64(j % 48)) & np.uint64(1)).astype(np.int64), last)
    return out


def best_occurrence(item: list[int], text: list[int]) -> tuple[int, int]:
    """Smallest edit distance between ``item`` and a stretch of ``text``, and the end of such a stretch."""
    masks: dict[int, int] = {}
    for k, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << k
    n = len(item)
    top, up, down, score = 1 << (n - 1), (1 << n) - 1, 0, n
    best, end = n, 0
    for j, w in enumerate(text):
        match = masks.get(w, 0)
        x = match | down
        zero = (((match & up) + up) ^ up) | x
        plus, minus = down | ~(zero | up), up & zero
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1, minus << 1
        up = (minus | ~(zero | plus)) & ((1 << n) - 1)
        down = plus & zero & ((1 << n) - 1)
        if score < best:
            best, end = score, j + 1
    return best, end


@dataclass
class ItemIndex:
    """The items of one block, ready to be looked for in texts."""

    vocabulary: dict[str, int]
    randoms: np.ndarray
    items: list[tuple[object, list[int]]]
    classes: list[dict]
    similarity: float

    def find(self, text: str | None) -> list[tuple[object, int, int, int, int]]:
        """(item_id, start_word, end_word, words of the item, distance) of the best occurrence of each item found.

        Items of one identifier count as one; each different one without identifier is an item of its own.
        """
        words = words_of(text)
        total = len(words)
        if not total or not self.items:
            return []
        ids = np.fromiter(map(self.vocabulary.get, words, itertools.repeat(0)), np.int64, total)
        codes = None
        tried: dict[int, list[int]] = {}
        runs = {run: _runs(ids, run) for run in {part["run"] for part in self.classes}}
        for part in self.classes:
            begins = _members(runs[part["run"]], part["runs"])
            if not len(begins):
                continue
            # The windows that could hold such a run begin up to an item's length before it.
            cover = np.zeros(total + 1, np.int64)
            np.add.at(cover, np.maximum(begins - part["longest"], 0), 1)
            np.add.at(cover, begins + 1, -1)
            starts = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
            if codes is None:      # words that no item has walk by bits of their own, too
                codes = np.append(self.randoms[ids], np.uint64(0))
                unknown = np.flatnonzero(ids == 0)
                codes[unknown] = np.fromiter((_bits(words[k], 7) for k in unknown.tolist()), np.uint64, len(unknown))
            for at in range(0, len(starts), 1 << 14):
                some = starts[at:at + (1 << 14)]
                places = [walks(codes, some, part["steps"], r) for r in range(WALKS)]
                for t, (sampled, keys, owners) in enumerate(part["tables"]):
                    mixed = _keys(codes, places[t % WALKS], sampled)
                    low = np.searchsorted(keys, mixed)
                    for h in np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == mixed).tolist():
                        k = int(low[h])
                        while k < len(keys) and keys[k] == mixed[h]:
                            tried.setdefault(int(owners[k]), []).append(int(some[h]))
                            k += 1
        found: dict[object, tuple[object, int, int, int, int]] = {}
        listed = ids.tolist()
        for k, starts in sorted(tried.items()):
            item_id, item = self.items[k]
            room = allowed(len(item), self.similarity)
            which = (None, tuple(item)) if item_id is None else item_id
            for left, right in _joined(sorted(set(starts)), room, len(item), total):
                distance, end = best_occurrence(item, listed[left:right])
                if distance <= room and (which not in found or distance < found[which][4]):
                    _, length = best_occurrence(item[::-1], listed[left:left + end][::-1])
                    found[which] = (item_id, left + end - length, left + end, len(item), distance)
        return sorted(found.values(), key=lambda h: (h[0] is None, h if h[0] is not None else h[1:]))


def _runs(ids: np.ndarray, run: int) -> np.ndarray:
    """A hash of the ``run`` words that begin at each place; zero where one of them is in no item."""
    n = len(ids) - run + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    codes, known = ids.astype(np.uint64), ids > 0
    out, whole = codes[:n].copy(), known[:n].copy()
    for k in range(1, run):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += codes[k:k + n]
        whole &= known[k:k + n]
    out[~whole] = 0
    return out


def _members(hashes: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """Places of the hashes that are among the keys."""
    where = np.flatnonzero(hashes)
    some = hashes[where]
    at = np.minimum(np.searchsorted(sorted_keys, some), len(sorted_keys) - 1)
    return where[sorted_keys[at] == some]


def _joined(starts: list[int], room: int, size: int, total: int) -> list[tuple[int, int]]:
    """The stretches around windows that begin at ``starts``; those that overlap become one."""
    out: list[tuple[int, int]] = []
    for s in starts:
        left, right = max(0, s - room), min(total, s + size + room)
        if out and left <= out[-1][1]:
            out[-1] = (out[-1][0], max(right, out[-1][1]))
        else:
            out.append((left, right))
    return out


def _keys(symbols: np.ndarray, places: np.ndarray, sampled: list[int]) -> np.ndarray:
    """One key per window: the words that its walk emits at the sampled steps."""
    out = np.zeros(len(places), np.uint64)
    for j in sampled:
        out = _mix(out + symbols[places[:, j]] + np.uint64(j * 2 + 1))
    return out


def build_index(items: list[tuple[object, str]], similarity: float = SIMILARITY, recall: float = RECALL, sample: int = SAMPLE,
                seed: int = 11) -> ItemIndex:
    """Index of items held in memory; the caller bounds their number.  Items without a word match nothing."""
    vocabulary: dict[str, int] = {}
    coded = []
    for item_id, text in items:
        words = words_of(text)
        if words:
            coded.append((item_id, [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]))
    randoms = np.array([0, *(_bits(w, 7) for w in vocabulary)], np.uint64)
    rng = np.random.default_rng(seed)
    classes = []
    top = max((len(x) for _, x in coded), default=0)
    low = 1
    while low <= top:
        mine = [k for k, (_, x) in enumerate(coded) if low <= len(x) < 2 * low]
        if mine:
            # At most d of n words have an edit, so n - d unedited ones lie in at most d + 1 runs.
            sizes = {len(coded[k][1]) for k in mine}
            run = min(-(-(n - allowed(n, similarity)) // (allowed(n, similarity) + 1)) for n in sizes)
            steps = max(2, WALK * low)
            per = min(sample, steps)
            tables = int(np.ceil(np.log(1 - recall) / np.log(1 - AGREE ** per)))
            runs = np.unique(np.concatenate([_runs(np.array(coded[k][1]), run) for k in mine]))
            part = {"run": run, "runs": runs, "longest": max(sizes), "steps": steps, "tables": []}
            placed = []
            for k in mine:
                codes = np.append(randoms[coded[k][1]], np.uint64(0))
                placed.append((codes, [walks(codes, np.zeros(1, np.int64), steps, r) for r in range(WALKS)]))
            for t in range(tables):
                sampled = sorted(rng.choice(steps, per, replace=False).tolist())
                keys = np.concatenate([_keys(c, p[t % WALKS], sampled) for c, p in placed])
                order = np.argsort(keys, kind="stable")
                part["tables"].append((sampled, keys[order], np.array(mine)[order]))
            classes.append(part)
        low *= 2
    return ItemIndex(vocabulary, randoms, coded, classes, similarity)


def hit_columns(items: DataFrame, id_col: str = "item_id", text_col: str = "text", similarity: float = SIMILARITY,
                recall: float = RECALL, block: int = BLOCK) -> Iterator[tuple[Callable[[Column], Column], bool]]:
    """Column functions, one per block of at most about ``block`` items, text to its hits, and whether more follow.

    The item table is cut into blocks by a hash of the identifier.  A block is read, indexed and pickled only when it is
    asked for; a caller that writes what one function found before it asks for the next holds one block at a time.
    Whole numbers come out as long, other identifiers as they are; items without identifier are looked for, too.
    """
    plain = items.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    if isinstance(plain.schema["id"].dataType, (IntegralType, NullType)):
        plain = plain.withColumn("id", F.col("id").cast("long"))
    hit_type = HIT.format(plain.schema["id"].dataType.simpleString())
    blocks = max(1, -(-plain.count() // block))
    for b in range(blocks):
        part = plain.where(F.pmod(F.xxhash64("id", F.lit("block"), F.when(F.col("id").isNull(), F.col("text"))), F.lit(blocks)) == b) if blocks > 1 else plain
        index = build_index([(r["id"], r["text"]) for r in part.orderBy("id", "text").collect()], similarity, recall)

        def make(index: ItemIndex):
            @F.pandas_udf(hit_type)
            def hits(texts: pd.Series) -> pd.Series:
                return pd.Series([[dict(zip(("item_id", "start_word", "end_word", "n_words", "distance"), h)) for h in index.find(t)]
                                  for t in texts], dtype="object")

            return hits

        hits = make(index)
        del index
        yield hits, b + 1 < blocks
        del hits


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per document and item that occurs in it: ``id_col``, item_id, start_word, end_word, n_words (of the item), distance,
    similarity.

    An item occurs where a stretch of the document differs from it by at most ``(1 - similarity) * n_words`` word
    edits; the best stretch is reported, ties to the first.  Null and empty documents, items with null or empty text match
    nothing; items with text but no identifier are reported with a null item_id; repeated document rows give repeated hits, repeated items one hit.  Other columns are not touched; empty
    tables give an empty result.  A block of items is one pass over the documents; with several blocks its hits are
    written before the next block is indexed.
    """
    found = None
    for hits, more in hit_columns(items, item_col, item_text, similarity, recall, block):
        part = docs.select(col(id_col).alias("id"), F.explode(hits(col(text_col).cast("string"))).alias("hit")).select(
            F.col("id").alias(id_col), "hit.*")
        if more or found is not None:
            part = durable(part, "hits")
        found = part if found is None else found.unionByName(part)
        del hits, part
    return found.withColumn("similarity", 1 - F.col("distance") / F.col("n_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                      similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` in which no item occurs, with their columns and nothing else; no row is shuffled.

    A block of items is one pass; between passes the rows still clean are written, so one block's index is held at a
    time.  Identifiers of items do not matter, those without one count, too.
    """
    out = docs
    for hits, more in hit_columns(items, item_col, item_text, similarity, recall, block):
        out = out.where(F.size(hits(col(text_col).cast("string"))) == 0)
        if more:
            out = durable(out, "clean")
        del hits
    return out
