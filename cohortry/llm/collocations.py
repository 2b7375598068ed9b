"""Phrase collocations counted with quotient filters over packed word-id n-grams.

A task numbers the words of its texts and keeps each text as numbers, chunk by chunk.  Words that occur often enough
get a dense id per language, so a phrase of n words packs into n * b bits.  An invertible permutation spreads the
packed phrases evenly; the leading bits of the result are the quotient, all other bits the remainder, so a filter
holds every phrase exactly: run lengths per quotient, sorted remainders, counts.  Filters of all chunks meet by
leading quotient bits and are merged in order.  Phrases of three and four words are counted only where every two
neighbouring words form a frequent pair: no other can be frequent.  Nothing is broadcast; a chunk learns its words'
ids and its frequent pairs by joins on the chunk.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import blocks, col, durable, numbered

LEAST = 30                # occurrences of a candidate
LONGEST = 4               # words of a candidate
COVER = 80                # percent of a candidate's count that a longer one may cover
SCALE = 2_000_000
TOP = 2_000
CHUNK_WORDS = 2_000_000   # words of one language that a task keeps together
FILTER_ENTRIES = 1_000_000   # entries that one merge takes in, on average

#: A-Z become a-z, a tab is a blank, separators become a byte that UTF-8 does not have.
TABLE = bytes(0xFE if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b for b in range(256)).lower()
BREAK = b"\xff"


class _Chunk:
    """Texts of one language as numbers of words: 0 is a break, words count from 1 in order of appearance."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {BREAK: 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes):
        number = self.numbers
        for part in blocks(text.translate(TABLE)):
            words = part.replace(b"\xfe", b" \xff ").split()
            self.parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint32, len(words)))
            self.size += len(words)
        self.parts.append(np.zeros(1, np.uint32))

    def row(self, lang: str) -> dict:
        numbers = np.concatenate(self.parts)
        counts = np.bincount(numbers, minlength=len(self.numbers))
        return {"chunk": uuid.uuid4().hex, "lang": lang, "numbers": numbers.tobytes(),
                "words": [w.decode() for w in self.numbers if w != BREAK], "counts": counts[1:].tolist()}


def chunks(df: DataFrame, text_col: str = "text", lang_col: str = "lang", unknown: str = "und", size: int = CHUNK_WORDS) -> DataFrame:
    """One row per chunk: its language, its texts as numbers, its words and how often each occurs in it."""
    kept = df.select(F.coalesce(col(lang_col).cast("string"), F.lit(unknown)).alias("lang"),
                     col(text_col).cast("string").cast("binary").alias("text"))
    schema = "chunk string, lang string, numbers binary, words array<string>, counts array<bigint>"

    def number(batches):
        open_: dict[str, _Chunk] = {}

        def out(lang):
            row = open_.pop(lang).row(lang)
            return pa.RecordBatch.from_arrays(
                [pa.array([row["chunk"]]), pa.array([lang]), pa.array([row["numbers"]], pa.binary()),
                 pa.array([row["words"]], pa.list_(pa.string())), pa.array([row["counts"]], pa.list_(pa.int64()))],
                names=["chunk", "lang", "numbers", "words", "counts"])

        for b in batches:
            for lang, text in zip(b.column(0), b.column(1)):
                lang = lang.as_py()
                chunk = open_.setdefault(lang, _Chunk())
                chunk.add(text.as_py() or b"")
                if chunk.size >= size:
                    yield out(lang)
                elif sum(c.size for c in open_.values()) >= 2 * size:
                    yield out(max(open_, key=lambda x: open_[x].size))
        for lang in list(open_):
            yield out(lang)

    # Written once: a chunk's name is drawn by the task that made it.
    return durable(kept.mapInArrow(number, schema), "chunks")


# --- packed phrases and their filters ------------------------------------------------------------

class Packing:
    """Phrases of ``n`` words of ``bits`` bits as lanes of at most 64 bits; the first lane is permuted."""

    def __init__(self, n: int, bits: int):
        per = max(1, min(n, 64 // bits))
        self.bits = bits
        self.lanes = [range(k, min(k + per, n)) for k in range(0, n, per)]
        self.width = bits * len(self.lanes[0])
        self.mask = np.uint64((1 << self.width) - 1)
        # Odd factors and a shift by half the width are invertible on numbers of ``width`` bits.
        self.factor = 0x9E3779B97F4A7C15 & int(self.mask) | 1
        self.shift = np.uint64(max(1, (self.width + 1) // 2))

    def _salt(self, rest: list[np.ndarray]) -> np.ndarray | int:
        salt = np.uint64(0)
        for lane in rest:
            x = (lane + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            salt = (salt ^ (x ^ (x >> np.uint64(32)))) * np.uint64(0xD6E8FEB86659FD93)
        return salt & self.mask

    def pack(self, words: list[np.ndarray]) -> list[np.ndarray]:
        lanes = []
        for lane in self.lanes:
            x = np.zeros(len(words[0]), np.uint64)
            for k in lane:
                x = x << np.uint64(self.bits) | words[k].astype(np.uint64)
            lanes.append(x)
        x = lanes[0] + self._salt(lanes[1:]) & self.mask
        for _ in range(2):
            x = x * np.uint64(self.factor) & self.mask
            x ^= x >> self.shift
        return [x, *lanes[1:]]

    def unpack(self, lanes: list[np.ndarray]) -> list[np.ndarray]:
        x, back = lanes[0].copy(), np.uint64(pow(self.factor, -1, 1 << self.width))
        for _ in range(2):
            x ^= x >> self.shift
            x = x * back & self.mask
        whole = [x - self._salt(lanes[1:]) & self.mask, *lanes[1:]]
        word = np.uint64((1 << self.bits) - 1)
        return [whole[k] >> np.uint64(self.bits * (len(lane) - 1 - i)) & word
                for k, lane in enumerate(self.lanes) for i in range(len(lane))]


def ordered(lanes: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct lanes in order, with the sum of their counts (one each where none are given)."""
    order = np.argsort(lanes[0], kind="stable") if len(lanes) == 1 else np.lexsort(lanes[::-1])
    lanes = [x[order] for x in lanes]
    first = np.ones(len(order), bool)
    first[1:] = np.any([x[1:] != x[:-1] for x in lanes], axis=0)
    at = np.flatnonzero(first)
    total = np.diff(np.append(at, len(order))) if counts is None else np.add.reduceat(counts[order], at) if len(at) else counts[:0]
    return [x[at] for x in lanes], total


def _small(values: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs, the number of bytes first."""
    size = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    wide = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return bytes([size]) + wide[:, :size].tobytes()


def _wide(data: bytes) -> np.ndarray:
    part = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    out = np.zeros((len(part), 8), np.uint8)
    out[:, :data[0]] = part
    return out.view("<u8").ravel()


def to_filter(lanes: list[np.ndarray], counts: np.ndarray, width: int, lead: int = 0) -> tuple:
    """A counting quotient filter of distinct lanes in order: quotient bits, entries per quotient, remainders, counts.

    The first ``lead`` bits are the same for all entries.
    """
    quotient_bits = min(width, lead + max(0, len(counts).bit_length() - 1))
    rest = np.uint64(width - quotient_bits)
    quotient = (lanes[0] >> rest) if width > quotient_bits else lanes[0]
    quotient = quotient.astype(np.int64)
    base = int(quotient[0]) if len(quotient) else 0
    runs = np.bincount(quotient - base)
    remainder = lanes[0] & np.uint64((1 << int(rest)) - 1)
    return quotient_bits, base, _small(runs), [_small(x) for x in (remainder, *lanes[1:])], _small(counts)


def from_filter(quotient_bits: int, base: int, runs: bytes, rest: list[bytes], counts: bytes, width: int):
    """The lanes and counts of a filter; nothing is lost."""
    per = _wide(runs).astype(np.int64)
    quotient = np.repeat(np.arange(len(per)) + base, per).astype(np.uint64)
    shift = width - quotient_bits
    first = (quotient << np.uint64(shift) if shift < 64 else np.zeros(len(quotient), np.uint64)) | _wide(rest[0])
    return [first, *map(_wide, rest[1:])], _wide(counts).astype(np.int64)


FILTER = "qbits int, base bigint, runs binary, rest array<binary>, counts binary"


def _phrases(ids: np.ndarray, n: int, good: np.ndarray | None) -> list[np.ndarray]:
    """Words of every run of n words without a break; ``good`` marks positions whose pair is frequent."""
    size = len(ids) - n + 1
    if size <= 0:
        return [ids[:0]] * n
    keep = np.ones(size, bool)
    for k in range(n):
        keep &= ids[k:k + size] > 0
    if good is not None:
        for k in range(n - 1):
            keep &= good[k:k + size]
    at = np.flatnonzero(keep)
    return [ids[at + k] for k in range(n)]


def _filters(ids: np.ndarray, sizes: range, bits: int, parts_bits: int, pairs: list[np.ndarray] | None):
    """Rows (n, part, filter) of one chunk."""
    good = None
    if pairs is not None:
        have = Packing(2, bits).pack([ids[:-1], ids[1:]])
        good = np.append(_within(have, pairs) & (ids[:-1] > 0) & (ids[1:] > 0), False)
    for n in sizes:
        packing = Packing(n, bits)
        lanes, counts = ordered(packing.pack(_phrases(ids, n, good)))
        shift = np.uint64(max(0, packing.width - parts_bits))
        part = (lanes[0] >> shift).astype(np.int64)
        edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else []
        for a, b in zip(edges[:-1], edges[1:]):
            yield (n, int(part[a]), *to_filter([x[a:b] for x in lanes], counts[a:b], packing.width, parts_bits))


def _within(have: list[np.ndarray], wanted: list[np.ndarray]) -> np.ndarray:
    """Which rows of ``have`` are among ``wanted``, which is in order."""
    if not len(wanted[0]):
        return np.zeros(len(have[0]), bool)
    if len(have) == 1:
        at = np.minimum(np.searchsorted(wanted[0], have[0]), len(wanted[0]) - 1)
        return wanted[0][at] == have[0]
    both = [np.concatenate([h, w]) for h, w in zip(have, wanted)]
    order = np.lexsort(both[::-1])
    new = np.append(True, np.any([x[order][1:] != x[order][:-1] for x in both], axis=0))
    group = np.cumsum(new) - 1
    found = np.zeros(group[-1] + 1, bool)
    found[group[order >= len(have[0])]] = True
    out = np.zeros(len(order), bool)
    out[order] = found[group]
    return out[:len(have[0])]


def count_phrases(encoded: DataFrame, sizes: range, bits: int, parts_bits: int, least: int, feedback: bool) -> DataFrame:
    """Phrases that occur ``least`` times or more, from chunks (chunk, lang, ids, and pairs where they are known).

    Rows (lang, n, lanes, f) without chunk are the totals; where ``feedback`` is asked for, rows with a chunk hold
    the lanes of those that occur in it.  Ids of languages differ, so one filter serves all.
    """
    def build(batches):
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                pairs = None
                if "pairs" in r:
                    found = [[np.frombuffer(x, "<u8") for x in p["lanes"]] for p in r["pairs"] or []]
                    width = len(Packing(2, bits).lanes)
                    pairs, _ = ordered([np.concatenate([f[k] for f in found] or [np.zeros(0, "<u8")]) for k in range(width)])
                got = list(_filters(np.frombuffer(r["ids"], "<u4"), sizes, bits, parts_bits, pairs))
                if got:
                    yield pa.RecordBatch.from_pandas(pd.DataFrame([(r["chunk"], *g) for g in got], columns=names), schema=arrow)

    names = ["chunk", "n", "part", "qbits", "base", "runs", "rest", "counts"]
    arrow = pa.schema([("chunk", pa.string()), ("n", pa.int32()), ("part", pa.int64()), ("qbits", pa.int32()), ("base", pa.int64()),
                       ("runs", pa.binary()), ("rest", pa.list_(pa.binary())), ("counts", pa.binary())])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].iloc[0])
        width = Packing(n, bits).width
        parts = [from_filter(r.qbits, r.base, r.runs, list(r.rest), r.counts, width) for r in rows.itertuples()]
        lanes = [np.concatenate(x) for x in zip(*[p[0] for p in parts])]
        counts = np.concatenate([p[1] for p in parts])
        all_, total = ordered(lanes, counts)
        often = total >= least
        kept = [x[often] for x in all_]
        out = [(None, n, [x.astype("<u8").tobytes() for x in kept], total[often].astype("<i8").tobytes())]
        if feedback:
            for chunk, (own, _) in zip(rows["chunk"], parts):
                mine = _within(own, kept)
                if mine.any():
                    out.append((chunk, n, [x[mine].astype("<u8").tobytes() for x in own], None))
        return pd.DataFrame(out, columns=["chunk", "n", "lanes", "f"])

    return durable(encoded.mapInArrow(build, f"chunk string, n int, part bigint, {FILTER}").groupBy("n", "part").applyInPandas(
        merge, "chunk string, n int, lanes array<binary>, f binary"), "phrases")


def _unpacked(totals: DataFrame, bits: int) -> DataFrame:
    """One row (ids, f) per phrase."""
    def rows(batches):
        for b in batches:
            for r in b.to_pylist():
                words = Packing(r["n"], bits).unpack([np.frombuffer(x, "<u8") for x in r["lanes"]])
                ids = np.stack(words, axis=1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * r["n"], pa.int32()), pa.array(ids.ravel())),
                    pa.array(np.frombuffer(r["f"], "<i8"))], names=["ids", "f"])

    return totals.where("chunk IS NULL").select("n", "lanes", "f").mapInArrow(rows, "ids array<bigint>, f bigint")


def _renumbered(found: DataFrame, words: DataFrame, frequent: DataFrame) -> DataFrame:
    """Chunks as word ids; rare words become breaks, since no candidate holds one."""
    mine = (words.join(frequent, ["lang", "word"]).groupBy("chunk")
            .agg(F.collect_list(F.struct("number", "id")).alias("map")))

    def ids(batches):
        for b in batches:
            for r in b.to_pylist():
                numbers = np.frombuffer(r["numbers"], "<u4")
                table = np.zeros(int(numbers.max(initial=0)) + 1, "<u4")
                for entry in r["map"] or []:
                    table[entry["number"]] = entry["id"]
                yield pa.RecordBatch.from_arrays([pa.array([r["chunk"]]), pa.array([table[numbers].tobytes()], pa.binary())],
                                                 names=["chunk", "ids"])

    return durable(found.select("chunk", "numbers").join(mine, "chunk", "left").mapInArrow(ids, "chunk string, ids binary"), "encoded")


def phrase_table(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST,
                 size: int = CHUNK_WORDS, entries: int = FILTER_ENTRIES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words: lang, word, id, f), (phrases: ids, f) of 2 to ``longest`` words, both from ``least`` on, and (lang, n)."""
    found = chunks(df, text_col, lang_col, size=size)
    words = found.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts"))).select(
        "chunk", "lang", (F.col("pos") + 1).alias("number"), F.col("col.words").alias("word"), F.col("col.counts").alias("f"))
    all_words = durable(words.groupBy("lang", "word").agg(F.sum("f").alias("f")), "words")
    n = all_words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = all_words.where(F.col("f") >= least)
    frequent = durable(numbered(often, [F.col("lang"), F.col("word")], "id", max(4, often.rdd.getNumPartitions())), "frequent")
    bits = max(1, frequent.count().bit_length())
    if bits > 32:
        raise ValueError("more than 2^32 frequent words")
    total = n.agg(F.sum("n")).first()[0] or 0
    lead = max(0, (total // entries).bit_length())
    encoded = _renumbered(found, words.drop("f"), frequent.select("lang", "word", "id"))
    pairs = count_phrases(encoded, range(2, 3), bits, lead, least, feedback=longest > 2)
    tables = _unpacked(pairs, bits)
    if longest > 2:
        known = pairs.where("chunk IS NOT NULL").groupBy("chunk").agg(F.collect_list(F.struct("lanes")).alias("pairs"))
        longer = count_phrases(encoded.join(known, "chunk"), range(3, longest + 1), bits, lead, least, feedback=False)
        tables = tables.unionByName(_unpacked(longer, bits))
    return frequent, durable(tables, "counts"), n


def _exact_score(a: Column, l_: Column, r: Column) -> Column:
    """floor(SCALE * a / (l + r)) in decimals, beyond 64 bits."""
    top = F.lit(SCALE).cast("decimal(7,0)") * a.cast("decimal(19,0)")
    return F.call_function("div", top, l_.cast("decimal(19,0)") + r.cast("decimal(19,0)"))


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST,
                 top: int = TOP, size: int = CHUNK_WORDS, entries: int = FILTER_ENTRIES) -> DataFrame:
    """The ``top`` collocations of every language: lang, rank, phrase, a, l, r, n, score.

    A candidate is a phrase of 2 to ``longest`` words with a >= ``least`` occurrences within pieces of its
    language.  Cut after its first k words it has l and r occurrences of the parts and the score
    floor(2000000 a / (l + r)); the lowest cut counts, ties to the smallest k.  A candidate is left out when a longer
    one holds it and has at least 80 % of its occurrences.  Null texts are empty, a null language is ``und``,
    repeated rows count again; no text or an empty table gives no rows.  Other columns are not touched.
    """
    words, phrases, n = phrase_table(df, text_col, lang_col, least, longest, size, entries)
    counts = phrases.unionByName(words.select(F.array(F.col("id").cast("bigint")).alias("ids"), "f"))
    length = F.size("ids")
    cuts = phrases.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), length - 1)).alias("k"))
    left = counts.select(F.col("ids").alias("left"), F.col("f").alias("l"))
    right = counts.select(F.col("ids").alias("right"), F.col("f").alias("r"))
    best = (cuts.withColumns({"left": F.slice("ids", F.lit(1), F.col("k")), "right": F.slice("ids", F.col("k") + 1, length)})
            .join(left, "left").join(right, "right").withColumn("score", _exact_score(F.col("a"), F.col("l"), F.col("r")))
            .groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("ids", "a", "cut.*"))
    parts = F.flatten(F.transform(F.sequence(F.lit(2), length - 1), lambda m: F.transform(
        F.sequence(F.lit(1), length - m + 1), lambda at: F.slice("ids", at, m))))
    covers = (phrases.where(length > 2).select(F.explode(F.array_distinct(parts)).alias("ids"), F.col("f").alias("longer"))
              .groupBy("ids").agg(F.max("longer").alias("longer")))
    kept = (best.join(covers, "ids", "left").where(F.col("longer").isNull() | (
        F.lit(100).cast("decimal(3,0)") * F.col("longer").cast("decimal(19,0)") < F.lit(COVER).cast("decimal(3,0)") * F.col("a").cast("decimal(19,0)")))
        .drop("longer"))
    spelled = (kept.select("ids", F.posexplode("ids").alias("pos", "id")).join(words.select("id", "word", "lang"), "id")
               .groupBy("ids", "lang").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
               .select("ids", "lang", F.array_join(F.col("w.word"), " ").alias("phrase")))
    rows = kept.join(spelled, "ids").join(n, "lang")
    # First the best of each slice of a language, then of the few that are left.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    slice_ = F.pmod(F.xxhash64("phrase"), F.lit(64))
    rows = rows.withColumn("slice", slice_)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
