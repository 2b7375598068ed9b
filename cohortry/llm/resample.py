"""Importance resampling of documents towards a target distribution over hashed word n-grams.

A text's bytes go through one 256-byte table that lower-cases A-Z and blanks every separator, and are split at
blanks.  The crc32 of a word is the seed of the crc32 of the two-word run that starts with it, and that one the
seed of the three-word run, so no run is ever spelled out.  Counters add up a document's buckets; tasks report one
total per bucket.  With the totals of the corpus and of the target every bucket has a gain, a document's weight is
the sum of its gains, and the documents drawn are those with the highest weight plus Gumbel noise, which is drawing
without replacement in proportion to the importance weight.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import blocks, col, durable, numbered

BUCKETS = 10_000
LONGEST = 3              # words of the longest run
MIN_WORDS = 20           # shorter documents are not drawn
PERCENT = 5
SEED = 42
RANK_ROWS = 50_000       # rows of a partition while documents are ranked

#: Digits, a-z and every byte of a character beyond ASCII stay, A-Z become a-z, the rest is blank.
TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def features(text: bytes | None) -> Iterator[tuple[int, Counter]]:
    """Number of new words and count of each run's crc32, block by block of a text of any length."""
    carry: list[bytes] = []
    for part in blocks((text or b"").translate(TABLE)):
        words = carry + part.split()
        hashes = list(map(crc32, words))
        found = Counter(islice(hashes, len(carry), None))
        blank = [b" " + w for w in words]
        for k in range(1, LONGEST):
            hashes = list(map(crc32, islice(blank, k, None), hashes))
            found.update(islice(hashes, max(0, len(carry) - k), None))
        yield len(words) - len(carry), found
        carry = words[1 - LONGEST:]


def by_bucket(found: Counter, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and count of every distinct run."""
    at = np.fromiter(found.keys(), np.int64, len(found)) % buckets
    return at, np.fromiter(found.values(), np.int64, len(found))


def bucket_totals(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of all texts fall into each bucket.  ``buckets`` numbers a task, added up by Spark."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for text in b.column(0):
                for _, found in features(text.as_py()):
                    np.add.at(total, *by_bucket(found, buckets))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    got = (df.select(col(text_col).cast("string").cast("binary")).mapInArrow(count, "bucket long, n long")
           .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(buckets, np.int64)
    for r in got:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of every bucket, B the number of buckets."""
    s_all, t_all, b = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weigh(df: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, n_words, n_features and weight, the sum of the gains of its runs."""
    kept = df.select(col(id_col).alias("id"), col(text_col).cast("string").cast("binary").alias("text"))
    numbers = ("n_words", "n_features", "weight")
    schema = f"id {kept.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in numbers)

    def add(batches):
        for b in batches:
            out = np.zeros((len(numbers), b.num_rows), np.int64)
            for k, text in enumerate(b.column(1)):
                for words, found in features(text.as_py()):
                    at, n = by_bucket(found, len(gains))
                    out[:, k] += words, n.sum(), gains[at] @ n
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out)], names=["id", *numbers])

    return kept.mapInArrow(add, schema)


def importance_resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        target_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS,
                        buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row per row of ``df``: ``id_col``, n_features, weight, score and rank.

    Of the N rows with at least ``min_words`` words the floor(percent * N / 100) with the highest score are drawn;
    rank counts them from 1, ties to the smaller identifier, null identifiers last; other rows have a null rank.
    Null and empty texts have no runs and weight 0.  A null identifier draws its noise as the empty text.  Repeated
    rows are rows of their own.  An empty target makes every rare bucket gain; an empty table gives an empty
    result.  Other columns, whatever their names, are not touched.
    """
    gains = bucket_gains(bucket_totals(df, text_col, buckets), bucket_totals(target, target_col, buckets))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    noise = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long").cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((noise + 0.5) / 4294967296.0))).cast("long")
    scored = durable(weigh(df, gains, id_col, text_col).withColumn("score", F.col("weight") + gumbel), "weights")
    able = scored.where(F.col("n_words") >= min_words)
    n = able.count()
    ranked = numbered(able, [F.col("score").desc(), F.col("id").asc_nulls_last()], "rank", max(4, -(-n // RANK_ROWS)))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
