"""The table that model fitting scans, and what is learnt on each training fold.

A subject is one row ``(id, x array<double>, folds array<int>, outcome...)``.  All models of a
run (one per seed and fold) are evaluated in the same scan: a task adds up one small array per
model over its own rows, so rows never move and are never copied per model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.columns import col
from cohortry.operators.running import durable, hold

DRIVER_BYTES = 64 << 20   # partial arrays up to this size are added on the driver
ADD_PARTS = 64            # partial arrays that one group adds up
PARTIAL = "slot int, part int, v binary"
TAIL_ROWS = 400_000       # values that the quantile search fetches when no more are in question
COUNT_BYTES = 64 << 20    # digit counts that one scan of the quantile search may hold


@dataclass
class Design:
    rows: DataFrame
    features: list[str]
    seeds: list[int]
    k: int
    parts: int
    n: int

    @property
    def models(self) -> list[tuple[int, int]]:
        """(position of the seed, fold) of every model, seeds first."""
        return [(s, f) for s in range(len(self.seeds)) for f in range(self.k)]


@dataclass
class Prep:
    """Per model and feature: kept or not, clip bounds, centre and divisor."""
    keep: np.ndarray
    low: np.ndarray
    high: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    var: np.ndarray = field(default=None)
    n: np.ndarray = field(default=None)


def design_table(df: DataFrame, id_col: str, features: list[str], outcome: list[str],
                 seeds: list[int] | None = None, k: int = 0) -> Design:
    """Cache the fitting table; complete rows only, ``folds`` present when seeds are given."""
    rows = df.select(col(id_col).alias("id"), F.array(*[col(c).cast("double") for c in features]).alias("x"),
                     F.col("folds") if seeds else F.array().cast("array<int>").alias("folds"),
                     *[col(c) for c in outcome])
    rows = durable(rows)
    n, parts = rows.count(), rows.rdd.getNumPartitions()
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if parts < wanted and n > 10_000:
        rows, parts = rows.repartition(wanted), wanted
    rows = hold(rows)
    return Design(rows, list(features), list(seeds or []), k, parts, n)


def batch_matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def scan(rows: DataFrame, columns: list[str], kernel: Callable[[Iterator], Iterator[tuple[int, np.ndarray]]],
         shape: tuple[int, int], parts: int) -> np.ndarray:
    """Sum ``kernel``'s (slot, array) output over all tasks into an array of ``shape``.

    Small totals are added on the driver in partition order; larger ones are added per slot by
    Spark first, so the driver only ever receives ``shape``.
    """
    slots, length = shape

    def task(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        out = list(kernel(batches))
        yield pa.RecordBatch.from_arrays(
            [pa.array([s for s, _ in out], pa.int32()), pa.array([part] * len(out), pa.int32()),
             pa.array([v.astype("float64").tobytes() for _, v in out], pa.binary())],
            names=["slot", "part", "v"])

    return add_partials(rows.select(*columns).mapInArrow(task, PARTIAL), shape, parts)


def add_partials(partial: DataFrame, shape: tuple[int, int], parts: int) -> np.ndarray:
    """Sum of the arrays (slot, part, v) of ``parts`` tasks per slot, always in the order of the parts."""
    slots, length = shape
    while parts * slots * length * 8 > DRIVER_BYTES and parts > 1:
        # ADD_PARTS arrays of a slot meet in one group, in partition order, level by level.
        def add(pdf):
            pdf = pdf.sort_values("part")
            total = np.zeros(length)
            for v in pdf["v"]:
                total += np.frombuffer(v)
            return pdf.head(1).assign(part=pdf["grp"].iloc[0], v=[total.tobytes()]).drop(columns="grp")

        partial = (partial.withColumn("grp", F.floor(F.col("part") / ADD_PARTS).cast("int"))
                   .groupBy("slot", "grp").applyInPandas(add, PARTIAL))
        parts = -(-parts // ADD_PARTS)
    total = np.zeros(shape)
    for r in sorted(partial.collect(), key=lambda r: (r.part, r.slot)):
        total[r.slot] += np.frombuffer(r.v)
    return total


def fold_variances(d: Design, threshold: float = 1e-8) -> Prep:
    """Training-fold population variance of every feature, from per-fold sums (training = all - fold)."""
    p, models = len(d.features), d.models
    centre = np.array(d.rows.agg(*[F.avg(F.col("x")[j]) for j in range(p)]).first(), dtype=float)
    off = [F.col("x")[j] - F.lit(float(centre[j])) for j in range(p)]
    sums = (d.rows.select(F.posexplode("folds").alias("s", "f"), "x").groupBy("s", "f")
            .agg(F.count(F.lit(1)), *[F.sum(o) for o in off], *[F.sum(o * o) for o in off]).collect())
    own = np.zeros((len(models), 1 + 2 * p))
    for r in sums:
        own[r[0] * d.k + r[1]] = r[2:]
    by_seed = own.reshape(len(d.seeds), d.k, -1).sum(axis=1)
    train = np.repeat(by_seed, d.k, axis=0) - own
    n = train[:, :1]
    var = np.maximum(train[:, 1 + p:] / n - (train[:, 1:1 + p] / n) ** 2, 0.0)
    keep = var > threshold
    if not keep.any(axis=1).all():
        raise ValueError("no feature meets the variance threshold")
    inf = np.full_like(var, np.inf)
    return Prep(keep, -inf, inf, np.zeros_like(var), np.ones_like(var), var, n[:, 0].astype("int64"))


def _ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the same order as the doubles."""
    u = (x + 0.0).view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(u & top, ~u, u | top)


def _from_bits(u: np.ndarray) -> np.ndarray:
    top = np.uint64(1 << 63)
    return np.where(u & top, u ^ top, ~u).astype(np.uint64).view(np.float64)


def _tail_limits(d: Design, probs: tuple[float, ...]) -> np.ndarray:
    """Array (prob, feature): values, from the nearer end, beyond about the wanted share of the rows.

    They only spare rows the counting: whether enough rows are within is counted, and told by :func:`fold_quantiles`.
    """
    p = len(d.features)
    shares = [min(q, 1 - q) for q in probs]

    def kernel(batches):
        for b in batches:
            x = batch_matrix(b.column(0), p)
            at = [min(len(x) - 1, int(len(x) * (1.25 * share + 0.005)) + 1) for share in shares]
            ends = [np.partition(x if q <= 0.5 else -x, k, axis=0)[k] for q, k in zip(probs, at)]
            yield 0, np.concatenate([[len(x)], (np.array(ends) * len(x)).ravel()])

    sums = scan(d.rows, ["x"], lambda batches: iter([(0, sum(v for _, v in found))] if (found := list(kernel(batches))) else []),
                (1, 1 + len(probs) * p), d.parts)[0]
    return (sums[1:] / max(1.0, sums[0])).reshape(len(probs), p)


def _digit_counts(d: Design, wanted: list[tuple[int, int, int, int]], limits: np.ndarray, probs: tuple[float, ...],
                  before: int, bits: int) -> np.ndarray:
    """Array (wanted, fold, digit): rows per next digit among the values of feature j that begin with v, by the fold of seed s.

    A wanted (prob, j, s, v) counts from the nearer end: values of the upper half are taken with their sign changed, and
    values beyond the limit of (prob, j) are left out.
    """
    p, k, digits, after = len(d.features), d.k, 1 << bits, before - bits
    width = len(d.seeds)
    groups: dict[tuple[int, int], dict[int, dict[int, int]]] = {}
    for i, (q, j, s, v) in enumerate(wanted):
        groups.setdefault((q, j), {}).setdefault(s, {})[v] = i
    known = {at: np.array(sorted({v for found in by.values() for v in found}), dtype=np.uint64) for at, by in groups.items()}

    def kernel(batches):
        seen = np.zeros((len(wanted), k * digits))
        held: dict[tuple[int, int], list] = {at: [] for at in groups}
        rows = 0

        def count():
            for at, parts in held.items():
                if not parts:
                    continue
                place, folds = (np.concatenate(c) for c in zip(*parts))
                for s, values in groups[at].items():
                    size = len(known[at]) * k * digits
                    counts = np.bincount((place // digits * k + folds[:, s]) * digits + place % digits, minlength=size)
                    counts = counts.reshape(len(known[at]), -1)
                    for v, i in values.items():
                        seen[i] += counts[np.searchsorted(known[at], np.uint64(v))]

        for b in batches:
            x, folds = batch_matrix(b.column(0), p), batch_matrix(b.column(1), width)
            for (q, j), values in known.items():
                y = x[:, j] if probs[q] <= 0.5 else -x[:, j]
                some = np.flatnonzero(y <= limits[q, j])
                keys = _ordered_bits(y[some])
                place = np.zeros(len(some), dtype="int64")
                if before < 64:
                    start = keys >> np.uint64(before)
                    place = np.minimum(np.searchsorted(values, start), len(values) - 1)
                    hit = np.flatnonzero(values[place] == start)
                    some, keys, place = some[hit], keys[hit], place[hit]
                if len(some):
                    digit = ((keys >> np.uint64(after)) & np.uint64(digits - 1)).astype("int64")
                    held[q, j].append((place * digits + digit, folds[some]))
                    rows += len(some)
            if rows >= 1_000_000:
                count()
                held, rows = {at: [] for at in groups}, 0
        count()
        yield from ((i, counts) for i, counts in enumerate(seen) if counts.any())

    counts = scan(d.rows, ["x", "folds"], kernel, (len(wanted), k * digits), d.parts)
    return counts.reshape(len(wanted), k, digits)


def _keys_of(d: Design, known: dict[tuple[int, int], set[int]], limits: np.ndarray, probs: tuple[float, ...], before: int):
    """Per (prob, feature) the ordered keys that begin with one of its known values, and the folds of their rows."""
    p, width = len(d.features), len(d.seeds)
    begin = {at: np.array(sorted(values), dtype=np.uint64) for at, values in known.items()}

    def task(batches):
        for b in batches:
            x, folds = batch_matrix(b.column(0), p), batch_matrix(b.column(1), width)
            for (q, j), values in begin.items():
                y = x[:, j] if probs[q] <= 0.5 else -x[:, j]
                some = np.flatnonzero(y <= limits[q, j])
                keys = _ordered_bits(y[some])
                start = keys >> np.uint64(before)
                hit = values[np.minimum(np.searchsorted(values, start), len(values) - 1)] == start
                if hit.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([q], pa.int32()), pa.array([j], pa.int32()), pa.array([keys[hit].tobytes()], pa.binary()),
                         pa.array([folds[some[hit]].astype("int32").tobytes()], pa.binary())], names=["q", "j", "keys", "folds"])

    found: dict[tuple[int, int], list] = {at: [] for at in known}
    for r in d.rows.select("x", "folds").mapInArrow(task, "q int, j int, keys binary, folds binary").collect():
        found[r.q, r.j].append((np.frombuffer(r.keys, np.uint64), np.frombuffer(r.folds, "int32").reshape(-1, width)))
    for at, parts in found.items():
        keys, folds = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(keys)
        yield at, keys[order], folds[order]


def fold_quantiles(d: Design, probs: tuple[float, ...], sizes: np.ndarray) -> np.ndarray:
    """Exact linear-interpolated quantiles of every training fold: array (model, feature, prob).

    Digit by digit selection on the ordered bits: each scan counts, for the values that share
    the digits found so far, the next digit per fold.  Frequent values
    are just counts, and a few scans settle all models, features and probabilities together.
    Ranks are counted from the nearer end, among the rows up to a limit that holds them all.  As soon as
    the values still in question are counted to be few (TAIL_ROWS), one scan fetches them instead.
    """
    p, k, models = len(d.features), d.k, d.models
    at = np.array(probs)[None, :] * (sizes[:, None] - 1)
    below = np.stack([np.floor(at), np.ceil(at)], axis=2).astype("int64")                 # model, prob, floor and ceiling
    upper = np.array(probs) > 0.5
    below = np.where(upper[None, :, None], sizes[:, None, None].astype("int64") - 1 - below, below)
    rank = np.repeat(below[:, None], p, axis=1)                                           # model, feature, prob, 2
    prefix = np.zeros(rank.shape, dtype=np.uint64)
    limits = _tail_limits(d, probs)
    left, open_ = 64, {(q, j) for q in range(len(probs)) for j in range(p)}
    while left and open_:
        asked: dict[tuple[int, int, int, int], list[tuple[int, int, int, int, int]]] = {}
        for m, (s, f) in enumerate(models):
            for q, j in open_:
                for r in range(2):
                    asked.setdefault((q, j, s, int(prefix[m, j, q, r])), []).append((m, f, j, q, r))
        wanted = sorted(asked)
        bits = min(left, 11 if len(wanted) * k * 2048 * 8 <= COUNT_BYTES else 8)
        # Counts of one scan stay within a fixed size; more features take more scans.
        room = max(1, COUNT_BYTES // (k * (8 << bits)))
        found = []
        for at_once in range(0, len(wanted), room):
            some = wanted[at_once:at_once + room]
            found += zip(some, _digit_counts(d, some, limits, probs, left, bits))
        if left == 64:
            short = {(q, j) for (q, j, s, v), c in found for m, f, *_, r in asked[q, j, s, v]
                     if c.sum() - c[f].sum() <= rank[m, j, q, r] and np.isfinite(limits[q, j])}
            if short:       # too few rows within a limit: it goes
                for q, j in short:
                    limits[q, j] = np.inf
                continue
        held: dict[tuple[int, int], dict[int, int]] = {}     # rows per value that is still in question
        for w, c in found:
            total = c.sum(axis=0)
            for m, f, j, q, r in asked[w]:
                cum = np.cumsum(total - c[f])
                digit = int(np.searchsorted(cum, rank[m, j, q, r], side="right"))
                rank[m, j, q, r] -= int(cum[digit - 1]) if digit else 0
                prefix[m, j, q, r] = np.uint64((int(prefix[m, j, q, r]) << bits) | digit)
                held.setdefault((q, j), {})[int(prefix[m, j, q, r])] = int(total[digit])
        left -= bits
        few, rows = {}, 0
        for at_, values in sorted(held.items(), key=lambda v: sum(v[1].values())):
            rows += sum(values.values())
            if left and rows <= TAIL_ROWS:
                few[at_] = set(values)
        if few:
            for (q, j), keys, folds in _keys_of(d, few, limits, probs, left):
                start = keys >> np.uint64(left)
                for m, (s, f) in enumerate(models):
                    for r in range(2):
                        mine = np.flatnonzero((start == prefix[m, j, q, r]) & (folds[:, s] != f))
                        prefix[m, j, q, r] = keys[mine[rank[m, j, q, r]]]
            open_ -= set(few)
    value = _from_bits(prefix.reshape(-1)).reshape(prefix.shape)
    value = np.where(upper[:, None], -value, value)
    lo, hi = value[..., 0], value[..., 1]
    return lo + (hi - lo) * (at - np.floor(at))[:, None, :]


def winsor_bounds(d: Design, prep: Prep, probs: tuple[float, float] = (0.005, 0.995)) -> Prep:
    bounds = fold_quantiles(d, probs, prep.n)
    prep.low, prep.high = bounds[:, :, 0], bounds[:, :, 1]
    return prep


def scaling(d: Design, prep: Prep) -> Prep:
    """Mean and population deviation of every clipped training fold; a zero deviation divides by 1."""
    p, models = len(d.features), d.models
    low, high = prep.low, prep.high
    centre = np.where(np.isfinite(low + high), (low + high) / 2, 0.0)
    width = len(d.seeds)

    def kernel(batches):
        total = np.zeros((len(models), 2 * p))
        for b in batches:
            x, folds = batch_matrix(b.column(0), p), batch_matrix(b.column(1), width)
            for m, (s, f) in enumerate(models):
                z = np.clip(x[folds[:, s] != f], low[m], high[m]) - centre[m]
                total[m] += np.concatenate([z.sum(axis=0), (z * z).sum(axis=0)])
        yield from enumerate(total)

    sums = scan(d.rows, ["x", "folds"], kernel, (len(models), 2 * p), d.parts) / prep.n[:, None]
    prep.mean = centre + sums[:, :p]
    dev = np.sqrt(np.maximum(sums[:, p:] - sums[:, :p] ** 2, 0.0))
    prep.scale = np.where(dev > 1e-12 * np.maximum(1.0, np.abs(prep.mean)), dev, 1.0)
    return prep


def learn_folds(d: Design) -> Prep:
    """Variance filter, clip bounds and scaling of every training fold."""
    return scaling(d, winsor_bounds(d, fold_variances(d)))


def prep_frame(d: Design, prep: Prep) -> DataFrame:
    """One row per (seed, fold) with the learnt arrays in feature order."""
    rows = [(d.seeds[s], f, int(prep.n[m]), prep.keep[m].tolist(), prep.var[m].tolist(),
             prep.low[m].tolist(), prep.high[m].tolist(), prep.mean[m].tolist(), prep.scale[m].tolist())
            for m, (s, f) in enumerate(d.models)]
    return d.rows.sparkSession.createDataFrame(
        rows, "seed int, fold int, n bigint, keep array<boolean>, var array<double>, low array<double>,"
              " high array<double>, mean array<double>, scale array<double>")


def prep_long(d: Design, prep: Prep) -> DataFrame:
    """The same by feature: (seed, fold, feature, n, keep, var, low, high, mean, scale)."""
    names = F.array(*[F.lit(c) for c in d.features])
    wide = prep_frame(d, prep).withColumn("feature", names)
    parts = ["feature", "keep", "var", "low", "high", "mean", "scale"]
    return wide.select("seed", "fold", "n", F.inline(F.arrays_zip(*parts)))


def apply_fold_params(rows: DataFrame, params: DataFrame, seeds: list[int], k: int,
                      width: int) -> DataFrame:
    """Clip and scale rows by every model's training values: adds ``seed``, ``fold``, ``z``.

    ``rows`` needs ``x`` of ``width`` features; where ``folds`` is present a row's part (``train`` or ``validation``) is
    named too.  The parameter table has one row per model, so it is broadcast.
    """
    keys = F.array(*[F.struct(F.lit(s).alias("seed"), F.lit(f).alias("fold"), F.lit(i).alias("_s"))
                     for i, s in enumerate(seeds) for f in range(k)])
    each = rows.select("*", F.inline(keys)).join(
        F.broadcast(params.select("seed", "fold", "low", "high", "mean", "scale")), ["seed", "fold"])
    def scaled(j):
        x, low, high, mean, scale = (F.get(c, F.lit(j)) for c in ("x", "low", "high", "mean", "scale"))
        # least and greatest skip NULL, which must stay NULL here.
        return (F.when(x.isNotNull(), F.least(F.greatest(x, low), high)) - mean) / scale

    z = F.array(*[scaled(j) for j in range(width)])
    part = F.lit("holdout")
    if "folds" in rows.columns:
        part = F.when(F.get("folds", F.col("_s")) == F.col("fold"), "validation").otherwise("train")
    return each.withColumn("z", z).withColumn("part", part).drop("low", "high", "mean", "scale", "_s")
