"""Scores, effect directions, AUC, accuracy and concordance per key."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.functions.columns import col
from cohortry.operators.pairs import block_pairs, settled
from cohortry.operators.running import hold, join_small, running_totals

WIDE = "decimal(20,0)"  # counts before they are multiplied; products and sums then have 38 digits
RISK_TIE = 1e-8        # Fixed value: scores at most this far apart count as tied.
RISK_COLUMN = "RelativeRisk_"   # Fixed value: what the columns of attached scores begin with.
AUC_ROWS = 500_000     # rows of one bucket of scores
LOCAL_ROWS = 200_000   # a key with at most this many subjects may be counted inside one task


def dot(x: list[Column], beta: Column) -> Column:
    """Sum of products with the entries of an array, written out so that it compiles."""
    return reduce(lambda a, b: a + b, [v * F.get(beta, F.lit(i)) for i, v in enumerate(x)])


def effect_direction(coefs: DataFrame, names: str = "features", beta: str = "beta") -> DataFrame:
    """Add the ratios exp(beta) and the names with ratio above 1 and at most 1, in order."""
    pair = F.arrays_zip(col(names).alias("name"), F.transform(col(beta), F.exp).alias("ratio"))

    def picked(test):
        return F.transform(F.filter(F.col("_pair"), test), lambda e: e["name"])

    return (coefs.withColumn("_pair", pair)
            .withColumn("ratio", F.col("_pair.ratio"))
            .withColumn("above", picked(lambda e: e["ratio"] > 1))
            .withColumn("below", picked(lambda e: e["ratio"] <= 1)).drop("_pair"))


def linear_score(df: DataFrame, features: list[str], coefs: DataFrame, by: list[str],
                 beta: str = "beta", intercept: str | None = None, center: str | None = None) -> DataFrame:
    """Linear predictor per row from its key's coefficients (one array per key, few keys).

    Adds ``score``; ``predicted`` = score > 0 with an intercept; ``relative_risk`` = exp(score minus
    the score at ``center``, the training means) where those are given.
    """
    extra = [c for c in (intercept, center) if c]
    small = coefs.select(*[col(k) for k in by], beta, *extra)
    joined = join_small(df, small, by)
    score = dot([col(c) for c in features], col(beta))
    if intercept:
        score = score + col(intercept)
    out = joined.withColumn("score", score)
    if intercept:
        out = out.withColumn("predicted", (F.col("score") > 0).cast("int"))
    if center:
        out = out.withColumn("relative_risk", F.exp(
            F.col("score") - dot([F.get(col(center), F.lit(i)) for i in range(len(features))], col(beta))))
    return out.drop(beta, *extra)


def attach_scores(df: DataFrame, scores: DataFrame, id_col: str, models: list[str]) -> DataFrame:
    """One ``RelativeRisk_<i>`` column per model beside the subject's outcome."""
    wide = scores.groupBy(col(id_col)).pivot("model", models).agg(F.first("relative_risk"))
    named = wide.select(col(id_col), *[col(m).alias(f"{RISK_COLUMN}{i + 1}") for i, m in enumerate(models)])
    return df.join(named, id_col)


def attach_outcome(x: DataFrame, y: DataFrame, id_col: str) -> DataFrame:
    """Put features and outcome side by side; the subject key replaces row positions."""
    return x.join(y, id_col)


def roc_auc(df: DataFrame, keys: list[str], score: str, label: str, **limits) -> DataFrame:
    """Area under the ROC curve per key with ties counting one half, plus accuracy at score > 0.

    ``auc`` is NULL and ``status`` says ``one class`` where a key lacks a class.  Rows without score
    or label are left out, as in :func:`comparable_pairs`.
    """
    y = col(label).cast("int")
    cells = (df.where(col(score).isNotNull() & ~F.isnan(col(score).cast("double")) & y.isNotNull()).groupBy(*[col(k) for k in keys], (col(score) + F.lit(0.0)).alias("_s"))
             .agg(F.sum(y).cast("bigint").alias("_pos"), F.sum(1 - y).cast("bigint").alias("_neg")))
    run = running_totals(cells, keys, ["_s"], ["_neg"], **limits)
    pos, neg = F.col("_pos").cast("double"), F.col("_neg").cast("double")
    right = F.when(F.col("_s") > 0, F.col("_pos")).otherwise(F.col("_neg"))
    sums = run.groupBy(*[col(k) for k in keys]).agg(
        F.sum(pos * (F.col("_neg_before") + neg / 2)).alias("_wins"), F.sum("_pos").alias("n_pos"),
        F.sum("_neg").alias("n_neg"), F.sum(right).alias("_right"))
    return _rates(sums, keys)


def _rates(sums: DataFrame, keys: list[str]) -> DataFrame:
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return sums.select(
        *[col(k) for k in keys], "n_pos", "n_neg",
        F.when(both, F.col("_wins") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auc"),
        (F.col("_right") / (F.col("n_pos") + F.col("n_neg"))).alias("accuracy"),
        F.when(both, "ok").otherwise("one class").alias("status"))


def score_bounds(scores: np.ndarray, rows: int) -> np.ndarray:
    """Scores that cut ``rows`` rows into even buckets, as told by some of them; any bounds give the same area."""
    blocks = math.ceil(rows / AUC_ROWS)
    known = np.sort(scores[~np.isnan(scores)])
    if blocks < 2 or not len(known):
        return np.empty(0)
    return np.unique(known[np.arange(1, blocks) * len(known) // blocks] + 0.0)


def pack_scores(score: np.ndarray, label: np.ndarray, bounds: np.ndarray):
    """(bucket, scores of label 1, scores of label 0, their numbers, rows right at score > 0) per bucket of the scores.

    Even buckets lie between two bounds.  A bound is a bucket of its own and has numbers only, so a score that many
    rows share is never gathered.  Rows without score or label are left out.
    """
    known = ~(np.isnan(score) | np.isnan(label))
    sides, cuts = [], []
    for side in (1, 0):
        s = np.sort(score[known & (label == side)])
        edges = np.column_stack([np.searchsorted(s, bounds, "left"), np.searchsorted(s, bounds, "right")]).ravel()
        sides.append(s)
        cuts.append(np.concatenate([[0], edges, [len(s)]]))
    pos, neg = sides
    above, upto = np.searchsorted(pos, 0.0, "right"), np.searchsorted(neg, 0.0, "right")
    for bucket in range(2 * len(bounds) + 1):
        (a, b), (c, d) = (cut[bucket:bucket + 2].tolist() for cut in cuts)
        if a < b or c < d:
            right = max(0, b - max(a, above)) + max(0, min(d, upto) - c)
            own = bucket % 2 == 0
            yield (bucket, pos[a:b].tobytes() if own else b"", neg[c:d].tobytes() if own else b"", b - a, d - c, int(right))


def packed_auc(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """What :func:`roc_auc` gives, of scores packed by :func:`pack_scores` (keys, bucket, pos, neg, n_pos, n_neg, right).

    A bucket of a key is one group, of about AUC_ROWS rows; its scores are sorted there, and pairs of scores in
    different buckets follow from their numbers.
    """
    fields = [blocks.schema[k] for k in keys + ["bucket"]] + [T.StructField("_wins", T.DoubleType())] + [
        T.StructField(c, T.LongType()) for c in ("n_pos", "n_neg", "_right")]

    def settle(pdf):
        n_pos, n_neg, right = (int(pdf[c].sum()) for c in ("n_pos", "n_neg", "right"))
        wins = n_pos * n_neg / 2
        if pdf["bucket"].iat[0] % 2 == 0:
            pos, neg = (np.sort(np.frombuffer(b"".join(pdf[c]))) for c in ("pos", "neg"))
            wins = int(np.searchsorted(neg, pos, "left").sum() + np.searchsorted(neg, pos, "right").sum()) / 2
        return pd.DataFrame([[pdf[k].iat[0] for k in keys + ["bucket"]] + [wins, n_pos, n_neg, right]],
                            columns=[f.name for f in fields])

    by = [col(k) for k in keys]
    found = blocks.groupBy(*by, "bucket").applyInPandas(settle, T.StructType(fields))
    # A few buckets a key.
    ahead = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_neg").over(ahead), F.lit(0)).cast("double")
    run = found.withColumn("_wins", F.col("_wins") + F.col("n_pos").cast("double") * before)
    return _rates(run.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("_wins", "n_pos", "n_neg", "_right")]), keys)


def accuracy(df: DataFrame, keys: list[str], predicted: str, label: str) -> DataFrame:
    return df.groupBy(*[col(k) for k in keys]).agg(
        F.avg((col(predicted) == col(label)).cast("int")).alias("accuracy"))


# --- concordance --------------------------------------------------------------------------------

def comparable_pairs(df: DataFrame, keys: list[str], score: str, time: str, event: str,
                     local_rows: int | None = None, **limits) -> DataFrame:
    """Concordant, discordant and risk-tied comparable pairs per key, counted without forming them.

    A pair is comparable when the earlier subject had the event; at equal times only an event
    against a censored subject counts.  Keys of a checked size are counted in one task each by
    sorting; larger keys go through :func:`pairs.block_pairs`, which spreads one key over the cluster.
    Large tables are read three times, and only what a group needs is shuffled; nothing is cached.
    """
    local_rows = LOCAL_ROWS if local_rows is None else local_rows
    base = df.select(*[col(k) for k in keys], col(score).cast("double").alias("_s"),
                     col(time).cast("double").alias("_t"), col(event).cast("int").alias("_e")) \
             .na.drop(subset=["_s", "_t", "_e"])
    if not keys:
        base, keys = base.withColumn("_all", F.lit(0)), ["_all"]
    sizes = hold(base.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n")))
    largest, smallest = sizes.agg(F.max("_n"), F.min("_n")).first()
    parts = []
    if smallest is None or smallest <= local_rows:
        small = base if largest is None or largest <= local_rows else \
            join_small(base, sizes.where(F.col("_n") <= local_rows).drop("_n"), keys, "left_semi")
        parts.append(_local_pairs(small, keys))
    if largest is not None and largest > local_rows:
        parts.append(block_pairs(base, keys, sizes.where(F.col("_n") > local_rows), RISK_TIE, _count_pairs,
                                 limits.get("partition_rows")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # Doubles: exact up to 2**53 pairs, and never out of range.
    return out.drop("_all").withColumns({c: F.col(c).cast("double") for c in ("concordant", "discordant", "tied")})


def packed_pairs(packed: DataFrame, bounds: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """What :func:`comparable_pairs` gives, per key number ``kid``, of rows dealt out by :func:`pairs.pack` where they were scored."""
    found = settled(packed, bounds, RISK_TIE, _count_pairs)
    return found.select(F.col("_kid").alias("kid"), *[F.col(c).cast("double").alias(c) for c in ("concordant", "discordant", "tied")])


def _count_pairs(s: np.ndarray, t: np.ndarray, e: np.ndarray) -> tuple[int, int, int]:
    """The three counts of one bounded key, by counting bit by bit of the score's rank."""
    levels = np.unique(s)
    rank = np.searchsorted(levels, s)
    below = np.searchsorted(levels, s - RISK_TIE, side="left")
    upto = np.searchsorted(levels, s + RISK_TIE, side="right")
    late = np.lexsort((e, -t))               # falling time; at equal times censored first
    t, e, rank, below, upto = t[late], e[late], rank[late], below[late], upto[late]
    n = len(t)
    first = np.searchsorted(-t, -t, side="left")
    censored = np.concatenate([[0], np.cumsum(1 - e)])
    ahead = np.where(e == 1, first + censored[np.arange(n)] - censored[first], 0)
    died = np.flatnonzero(e == 1)
    # Rows in front of an event that are comparable with it form a prefix of this order.
    stop = ahead[died]
    low, not_high = _prefix_counts(rank, stop, (below[died], upto[died]), len(levels))
    total = int(stop.sum())
    return int(low.sum()), total - int(not_high.sum()), int((not_high - low).sum())


def _prefix_counts(rank: np.ndarray, stop: np.ndarray, bounds: tuple[np.ndarray, ...], size: int):
    """Per bound and query: how many of ``rank[:stop]`` are below the bound; one sort per bit."""
    out = np.zeros((len(bounds), len(stop)), dtype="int64")
    span = len(rank) + 1
    place = np.arange(len(rank), dtype="int64")
    for b in range(max(1, int(size).bit_length())):
        key = np.sort((rank >> b).astype("int64") * span + place)
        for total, bound in zip(out, bounds):
            asks = np.flatnonzero((bound >> b) & 1)
            want = ((bound[asks] >> b) - 1).astype("int64") * span
            total[asks] += np.searchsorted(key, want + stop[asks]) - np.searchsorted(key, want)
    return out


def _local_pairs(base: DataFrame, keys: list[str]) -> DataFrame:
    fields = [base.schema[k] for k in keys] + [
        T.StructField(c, T.LongType()) for c in ("concordant", "discordant", "tied")]

    def count(pdf):
        found = _count_pairs(pdf["_s"].to_numpy(), pdf["_t"].to_numpy(), pdf["_e"].to_numpy())
        return pd.DataFrame([[pdf[k].iat[0] for k in keys] + list(found)], columns=[f.name for f in fields])

    return base.groupBy(*[col(k) for k in keys]).applyInPandas(count, T.StructType(fields))


def concordance(pairs: DataFrame, ties: str = "half") -> DataFrame:
    """C-index from pair counts: risk ties count one half (``half``) or are left out (``drop``).

    NULL with a status where nothing is comparable.
    """
    c, d, t = F.col("concordant"), F.col("discordant"), F.col("tied")
    if ties == "half":
        top, bottom = c + t / 2, c + d + t
    elif ties == "drop":
        top, bottom = c, c + d
    else:
        raise ValueError(f"unknown tie rule {ties!r}")
    return pairs.withColumn("c_index", F.when(bottom > 0, top / bottom)).withColumn(
        "status", F.when(bottom > 0, "ok").otherwise("no comparable pair"))
