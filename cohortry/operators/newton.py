"""Ridge logistic and Cox regression as batched Newton iterations over one Spark table.

Every Spark job evaluates all unfinished models at once; only p x p sums per model reach the
driver, which solves the small systems.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators.design import PARTIAL, Design, Prep, add_partials, batch_matrix, scan
from cohortry.operators.running import durable, hold

COX_PARTITION_ROWS = 200_000   # most rows of a time partition
COX_PARTITIONS = 400           # smaller ones than COX_PARTITION_ROWS are made only up to this many (or one a core)
COX_TASK_ROWS = 10_000         # rows worth a task of their own while cores are free
COX_BLOCK_ROWS = 40_000        # subjects whose values are kept as one array
COX_STEP_ROWS = 4_096          # subjects whose products are in memory at once
COX_TIME_ROWS = 100            # rows a time from which sums by time are quicker than the tree
COX_TIME_BYTES = 128 << 20     # sums per model and time of this size are added up on the driver
COX_GROUP = 64                 # neighbouring partitions, or groups of them, that one task of the tree takes
COX_GROUP_BYTES = 128 << 20    # models are taken in chunks whose sums of one such group fit in this


@dataclass
class Model:
    """One fit: training rows (all but ``fold`` of seed number ``seed``; all rows when None),
    columns in coefficient order and the scaling of those columns."""
    seed: int | None
    fold: int | None
    cols: list[int]
    low: np.ndarray
    high: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def take(self, cols: list[int]) -> "Model":
        at = [self.cols.index(c) for c in cols]
        return Model(self.seed, self.fold, list(cols), self.low[at], self.high[at], self.mean[at],
                     self.scale[at])

    def matrix(self, x: np.ndarray) -> np.ndarray:
        """Clipped and scaled columns, each contiguous in memory: loops along rows are several times as fast."""
        return self.columns([x]).T

    def columns(self, pieces: list[np.ndarray], ones: int = 0) -> np.ndarray:
        """The same by column, of rows that lie in several pieces one after the other, and ``ones`` rows of 1."""
        q, n = len(self.cols), sum(map(len, pieces))
        z = np.empty((q + ones, n))
        for row, c, low, high in zip(z, self.cols, self.low, self.high):
            at = 0
            for x in pieces:
                np.maximum(x[:, c], low, out=row[at:at + len(x)])
                at += len(x)
            np.minimum(row, high, out=row)
        z[:q] -= np.reshape(self.mean, (-1, 1))
        z[:q] /= np.reshape(self.scale, (-1, 1))
        z[q:] = 1.0
        return z

    def training(self, folds: np.ndarray) -> np.ndarray:
        if self.seed is None:
            return np.ones(len(folds), dtype=bool)
        return folds[:, self.seed] != self.fold


def fold_models(d: Design, prep: Prep) -> list[Model]:
    out = []
    for m, (s, f) in enumerate(d.models):
        cols = np.flatnonzero(prep.keep[m]).tolist()
        out.append(Model(s, f, cols, prep.low[m][cols], prep.high[m][cols], prep.mean[m][cols],
                         prep.scale[m][cols]))
    return out


def maximise(start: list[np.ndarray], evaluate: Callable, steps: int = 100,
             tol: float = 1e-5) -> tuple[list[np.ndarray], list[np.ndarray | None]]:
    """Newton ascent for many concave objectives; a step that worsens its objective is halved.

    ``evaluate([(model, beta)])`` returns value, gradient and curvature (minus Hessian) for each.  Returns
    the maxima, and the curvature that each one's last step was taken with.
    A model is finished when its step is below ``tol``; that last step is still taken, which
    leaves an error of the order of its square.  A model that does not get there (a feature that
    separates the outcome, an objective that is not finite) gives NaN for every entry; the others go on.
    """
    trial = [np.array(b, dtype=float) for b in start]
    best = [None] * len(start)
    step = [np.zeros_like(b) for b in trial]
    done = [len(b) == 0 for b in trial]
    curves: list[np.ndarray | None] = [None] * len(start)
    for _ in range(steps):
        todo = [m for m, d in enumerate(done) if not d]
        if not todo:
            return trial, curves
        for m, (value, grad, curve) in zip(todo, evaluate([(m, trial[m]) for m in todo])):
            worse = not np.isfinite(value) or (
                best[m] is not None and value < best[m][0] - 1e-10 * (1 + abs(best[m][0])))
            if worse and best[m] is None:
                trial[m], done[m] = np.full_like(trial[m], np.nan), True
                continue
            if worse:
                step[m] = step[m] / 2
                trial[m] = best[m][1] + step[m]
                done[m] = bool(np.max(np.abs(step[m])) < 1e-12)
                continue
            best[m], curves[m] = (value, trial[m]), curve
            try:
                step[m] = np.linalg.solve(curve, grad)
            except np.linalg.LinAlgError:
                step[m] = np.linalg.lstsq(curve, grad, rcond=None)[0]
            trial[m] = trial[m] + step[m]
            done[m] = bool(np.max(np.abs(step[m])) < tol)
    return [b if d else np.full_like(b, np.nan) for b, d in zip(trial, done)], curves


class Fitter:
    """Fits models by Newton steps; ``evaluations`` counts the scans of the table.

    ``objective(models, asked)`` gives value, gradient and curvature for each (number of a model, beta).
    """

    def __init__(self, objective: Callable, tail: int = 0):
        self.objective, self.tail, self.evaluations = objective, tail, 0

    def solve(self, models: list[Model], start: list[np.ndarray] | None = None):
        """Coefficients and curvatures."""
        def evaluate(asked):
            self.evaluations += 1
            return self.objective(models, asked)

        return maximise(start or [np.zeros(len(m.cols) + self.tail) for m in models], evaluate)

    def __call__(self, models: list[Model], start: list[np.ndarray] | None = None) -> list[np.ndarray]:
        return self.solve(models, start)[0]


# --- logistic -----------------------------------------------------------------------------------

def logistic_fitter(d: Design, response: str, c: float = 1.0):
    """fit(models, start) for ridge logistic regression; the intercept (last entry) is penalised too."""
    p, width = len(d.features), max(1, len(d.seeds))

    def evaluate(models, asked):
        most = max(len(b) for _, b in asked)
        length = 1 + most + most * most
        jobs = [(models[m], b) for m, b in asked]

        seeds = {model.seed for model, _ in jobs}

        def kernel(batches):
            total = np.zeros((len(jobs), length))
            for b in batches:
                x, y = batch_matrix(b.column(0), p), b.column(2).to_numpy(zero_copy_only=False)
                folds = batch_matrix(b.column(1), width) if width and len(b.column(1).flatten()) \
                    else np.zeros((len(y), 0), dtype=int)
                # Rows in the order of a seed's folds: the training rows of a model are what is before and after its fold.
                sorted_by = {}
                for seed in seeds:
                    fold = np.zeros(len(y), dtype=int) if seed is None else folds[:, seed]
                    order = np.argsort(fold, kind="stable")
                    sorted_by[seed] = fold[order], np.asfortranarray(x.take(order, axis=0)), y[order]
                for i, (model, beta) in enumerate(jobs):
                    fold, xs, ys = sorted_by[model.seed]
                    lo, hi = (0, 0) if model.seed is None else np.searchsorted(fold, [model.fold, model.fold + 1])
                    z = model.columns([xs[:lo], xs[hi:]], 1)
                    t, eta, q = np.concatenate([ys[:lo], ys[hi:]]), beta @ z, len(beta)
                    small = np.exp(-np.abs(eta))
                    mu = np.where(eta >= 0, 1.0, small) / (1 + small)
                    total[i, 0] += t @ eta - np.maximum(eta, 0).sum() - np.log1p(small).sum()
                    total[i, 1:1 + q] += z @ (t - mu)
                    total[i, 1 + most:1 + most + q * q] += ((z * (mu * (1 - mu))) @ z.T).ravel()
            yield from enumerate(total)

        sums = scan(d.rows, ["x", "folds", response], kernel, (len(jobs), length), d.parts)
        out = []
        for (_, beta), s in zip(asked, sums):
            q = len(beta)
            out.append((s[0] - beta @ beta / (2 * c), s[1:1 + q] - beta / c,
                        s[1 + most:1 + most + q * q].reshape(q, q) + np.eye(q) / c))
        return out

    return Fitter(evaluate, tail=1)


# --- Cox ----------------------------------------------------------------------------------------

@dataclass
class TimeOrder:
    """Subjects range-partitioned by falling time; equal times may span partitions.

    ``shared`` names the partitions whose first or last time a neighbour also holds, and which of the two.
    ``group`` is the number of children of a node in the tree that carries sums from partition to partition.
    ``times`` is about the number of different times, added up over the partitions.
    """
    placed: DataFrame
    blocks: DataFrame
    parts: int
    p: int
    width: int
    shared: dict[int, tuple[bool, bool]]
    group: int
    times: int
    n: int

    @property
    def rows(self) -> DataFrame:
        """A row per subject, cached when first used.  Filled at once: only then do plans know how it is placed and sorted."""
        if not self.placed.is_cached:
            hold(self.placed).count()
        return self.placed

    @property
    def packed(self) -> DataFrame:
        """The same rows as arrays of a few thousand subjects, cached when first used."""
        return self.blocks if self.blocks.is_cached else hold(self.blocks)


def time_ordered(d: Design, event: str, time: str, partition_rows: int | None = None, group: int | None = None) -> TimeOrder:
    """Sort once for all models: the order depends on time only.

    The id hash is part of the range key, so a time that many subjects share is cut into several
    partitions like any other.  The rows of a range stay together in a cached layout by partition
    number, which every step of a fit reads without a shuffle.
    """
    cores = d.rows.sparkSession.sparkContext.defaultParallelism
    # Each partition costs tasks at every level of the tree in every step, so small ones stay few.
    small = math.ceil(d.n / partition_rows) if partition_rows else 1
    parts = max(1, math.ceil(d.n / COX_PARTITION_ROWS), min(small, max(COX_PARTITIONS, cores)), min(cores, d.n // COX_TASK_ROWS))
    rows = d.rows.select("id", "x", "folds", F.col(event).cast("int").alias("event"),
                         (-F.col(time).cast("double")).alias("late"))
    if parts == 1:
        placed = durable(rows.repartition(1).withColumn("part", F.lit(0)).sortWithinPartitions("late"))
        ranged = placed
    else:
        ranged = durable(rows.repartitionByRange(parts, "late", F.xxhash64("id")).withColumn("part", F.spark_partition_id()))
        placed = ranged.repartition(parts, "part").sortWithinPartitions("part", "late")
    edges = sorted(tuple(r) for r in ranged.groupBy("part").agg(
        F.min("late"), F.max("late"), F.approx_count_distinct("late")).collect())
    ties = {a[2] for a, b in zip(edges, edges[1:]) if a[2] == b[1]}
    shared = {part: (first in ties, last in ties) for part, first, last, _ in edges if first in ties or last in ties}
    return TimeOrder(placed, _packed_rows(placed, len(d.features), len(d.seeds)), parts, len(d.features), len(d.seeds),
                     shared, group or COX_GROUP, sum(e[3] for e in edges), d.n)


def _packed_rows(placed: DataFrame, p: int, width: int) -> DataFrame:
    """Rows (n, x, folds, event, late) of arrays over COX_BLOCK_ROWS subjects at most, in falling time; a column after the other."""
    most = COX_BLOCK_ROWS

    def task(batches):
        held, count = [], 0

        def flush():
            x, folds, event, late = (np.concatenate(c) for c in zip(*held))
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(late)], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (
                    x.T, folds.T.astype("int32"), (event > 0).astype("uint8"), late)]], names=["n", "x", "folds", "event", "late"])

        for x, folds, event, late in ((x, folds, event, late) for x, folds, event, late, _ in _arrays(batches, p, width)):
            held.append((x, folds, event, late))
            count += len(late)
            if count >= most:
                yield from flush()
                held, count = [], 0
        if held:
            yield from flush()

    return placed.select("x", "folds", "event", "late", "part").mapInArrow(
        task, "n int, x binary, folds binary, event binary, late binary")


def _arrays(batches, p: int, width: int):
    """Arrow batches of one time partition as arrays, in falling time."""
    for b in batches:
        n = b.num_rows
        if n:
            folds = batch_matrix(b.column(1), width) if width else np.zeros((n, 0), dtype=int)
            yield (np.asfortranarray(batch_matrix(b.column(0), p)), folds,
                   b.column(2).to_numpy(zero_copy_only=False).astype(float),
                   b.column(3).to_numpy(zero_copy_only=False), b.column(4)[0].as_py())


def _moments(z: np.ndarray, w: np.ndarray, q: int) -> np.ndarray:
    """Sum of w, w z and w z z' of the columns of z, padded to q entries, flat."""
    out = np.zeros(1 + q + q * q)
    have = len(z)
    zw = z * w
    out[0] = w.sum()
    out[1:1 + have] = zw.sum(axis=1)
    out[1 + q:].reshape(q, q)[:have, :have] = zw @ z.T
    return out


def _weights(model: Model, beta: np.ndarray, x: np.ndarray, folds: np.ndarray):
    """Scaled values (a row per feature, so that loops run along memory), scores, risk weights and training rows."""
    z = model.columns([x])
    eta = beta @ z
    train = model.training(folds)
    return z, eta, np.where(train, np.exp(eta), 0.0), train


class _Segment(NamedTuple):
    """Sums over neighbouring partitions, for each model.

    ``total`` is the risk-set sums of all rows.  ``head`` and ``tail`` are (risk sums, event sums, events) of the
    first and the last time, None where no neighbour holds that time.
    """
    first: float
    last: float
    total: np.ndarray
    head: np.ndarray | None
    tail: np.ndarray | None

    def then(self, other: "_Segment") -> "_Segment":
        """This segment and the one that follows it."""
        head, tail = self.head, other.tail
        if self.last == other.first:
            both = self.tail + other.head
            head = both if self.first == self.last else head
            tail = both if other.first == other.last else tail
        return _Segment(self.first, other.last, self.total + other.total, head, tail)


def _dump(*segments: _Segment | None) -> bytes:
    """As plain tuples: executors need not be able to import the class."""
    return pickle.dumps([s if s is None else tuple(s) for s in segments])


def _load(data: bytes) -> list[_Segment | None]:
    return [s if s is None else _Segment(*s) for s in pickle.loads(data)]


def _neighbours(segments: list[_Segment], before: _Segment | None, after: _Segment | None):
    """What comes before and after each of the segments, given that of all together."""
    ahead = []
    for s in segments:
        ahead.append(before)
        before = s if before is None else before.then(s)
    behind = []
    for s in reversed(segments):
        behind.append(after)
        after = s if after is None else s.then(after)
    return list(zip(ahead, behind[::-1]))


def _carry(own: _Segment, before: _Segment | None, after: _Segment | None):
    """What one partition needs: the sums over all later times, and for times that it shares with others the
    complete risk-set sums, event sums, events, and how many of those events the partitions before hold."""
    size = own.total.shape[1]
    start = np.zeros_like(own.total) if before is None else before.total
    ties = {}

    def tie(time, risk, held, earlier, later):
        count = np.zeros(len(risk)) if earlier is None else earlier[:, 2 * size]
        for part in (earlier, later):
            held = held if part is None else held + part
        ties[time] = (risk if later is None else risk + later[:, :size], held[:, size:2 * size], held[:, 2 * size], count)

    later = after.head if after is not None and after.first == own.last else None
    if own.head is not None:
        earlier = before.tail if before is not None and before.last == own.first else None
        tie(own.first, start + own.head[:, :size], own.head, earlier, later if own.first == own.last else None)
    if own.tail is not None and own.first != own.last:
        tie(own.last, start + own.total, own.tail, None, later)
    return start, ties


def _cox_carries(order: TimeOrder, jobs, q: int, efron: bool = True) -> DataFrame:
    """One row (part, v) per time partition: its carry; sums over the events of a time are there for Efron's rule only.

    Partition sums climb a tree of ``order.group`` children a node; on the way down every node learns what comes
    before and after it.  No task holds more than one node's children, and nothing reaches the driver.
    """
    size = 1 + q + q * q
    p, width, shared, group = order.p, order.width, order.shared, order.group
    schema = "part int, v binary"

    def add_up(table):
        part = table.column("part")[0].as_py()
        want_head, want_tail = shared.get(part, (False, False))
        late = table.column("late").to_numpy()
        total = np.zeros((len(jobs), size))
        edges = [np.zeros((len(jobs), 2 * size + 1)) if want else None for want in (want_head, want_tail)]
        for x, folds, event, times, _ in _arrays(table.to_batches(), p, width):
            # Rows stand in falling time, so those of one time stand together.
            spans = [(edge, slice(*(int(np.searchsorted(times, t, side)) for side in ("left", "right"))))
                     for edge, t in zip(edges, (late[0], late[-1])) if edge is not None]
            spans = [(edge, rows) for edge, rows in spans if rows.start < rows.stop]
            for i, (model, beta) in enumerate(jobs):
                z, _, w, train = _weights(model, beta, x, folds)
                whole = _moments(z, w, q)
                total[i] += whole
                for edge, rows in spans:
                    died = train[rows] & (event[rows] > 0)
                    edge[i, :size] += whole if rows.stop - rows.start == len(w) else _moments(z[:, rows], w[rows], q)
                    if efron:
                        edge[i, size:2 * size] += _moments(z[:, rows][:, died], w[rows][died], q)
                    edge[i, 2 * size] += np.count_nonzero(died)
        whole = _dump(_Segment(float(late[0]), float(late[-1]), total, *edges))
        return pa.table({"part": pa.array([part], pa.int32()), "v": pa.array([whole], pa.binary())})

    def node(column="part"):
        return F.floor(F.col(column) / group).cast("int")

    def join_up(rows):
        whole = None
        for v in rows.sort_values("part")["v"]:
            one, = _load(v)
            whole = one if whole is None else whole.then(one)
        return pd.DataFrame({"part": [int(rows["grp"].iloc[0])], "v": [_dump(whole)]})

    def hand_down(leaf):
        def down(children, parent=None):
            children = children.sort_values("part")
            segments = [s for v in children["v"] for s in _load(v)]
            around = (None, None) if parent is None else _load(parent["v"].iloc[0])
            found = _neighbours(segments, *around)
            out = [pickle.dumps(_carry(s, *f)) for s, f in zip(segments, found)] if leaf else [_dump(*f) for f in found]
            return pd.DataFrame({"part": children["part"].to_numpy(), "v": out})

        return down

    def top(leaf):
        return lambda rows: hand_down(leaf)(rows)

    def below(leaf):
        return lambda rows, parent: hand_down(leaf)(rows, parent)

    levels = [order.rows.select("x", "folds", "event", "late", "part").groupBy("part").applyInArrow(add_up, schema)]
    nodes = order.parts
    while nodes > group:
        levels.append(levels[-1].withColumn("grp", node()).groupBy("grp").applyInPandas(join_up, schema))
        nodes = -(-nodes // group)
    known = None
    for k in range(len(levels) - 1, -1, -1):
        children = levels[k].withColumn("grp", node())
        if known is None:
            known = children.groupBy("grp").applyInPandas(top(k == 0), schema)
        else:
            known = children.groupBy("grp").cogroup(known.withColumnRenamed("part", "grp").groupBy("grp")).applyInPandas(
                below(k == 0), schema)
    return known


def _tie_sums(s0: float, d0: float, total: float, first: float, own: float, efron: bool):
    """Sums over the ``own`` events of one time, numbered from ``first`` out of ``total``."""
    if not efron:
        return own / s0, 0.0, own / s0 ** 2, 0.0, 0.0, own * math.log(s0)
    out = np.zeros(6)
    for at in range(0, int(own), 1_000_000):
        u = (first + np.arange(at, min(at + 1_000_000, int(own)))) / total
        v = 1 / (s0 - u * d0)
        out += [v.sum(), (u * v).sum(), (v * v).sum(), (u * v * v).sum(), (u * u * v * v).sum(), -np.log(v).sum()]
    return tuple(out)


class _Sweep:
    """One model's likelihood over one partition, batch by batch in falling time.

    Times that lie whole within a batch are handled together.  The time a batch ends in stays open
    as sums only, so neither a long tie nor a large partition is ever held in memory.
    """

    def __init__(self, q: int, have: int, before: np.ndarray, ties: dict[float, tuple], efron: bool):
        self.q, self.have, self.efron, self.ties = q, have, efron, ties
        self.before = before.copy()
        self.time = None
        self.value, self.grad, self.curve = 0.0, np.zeros(have), np.zeros((have, have))

    def _parts(self, sums):
        q, have = self.q, self.have
        return sums[0], sums[1:1 + have], sums[1 + q:].reshape(q, q)[:have, :have]

    def add(self, z, eta, w, died, late, starts):
        ends = np.append(starts[1:], len(late))
        at = 0
        if self.time is None or self.time == late[0]:
            self._extend(late[0], z[:, :ends[0]], eta[:ends[0]], w[:ends[0]], died[:ends[0]])
            at = 1
        if at < len(starts):
            self._close()
            if at < len(starts) - 1:
                rows = slice(starts[at], starts[-1])
                self._whole(z[:, rows], eta[rows], w[rows], died[rows], starts[at:-1] - starts[at], (ends - starts)[at:-1])
            rows = slice(starts[-1], None)
            self._extend(late[-1], z[:, rows], eta[rows], w[rows], died[rows])

    def _extend(self, time, z, eta, w, died):
        if self.time is None:
            self.time, self.risk = time, np.zeros(1 + self.q + self.q ** 2)
            self.dead, self.count = np.zeros_like(self.risk), 0
            self.eta, self.z = 0.0, np.zeros(self.have)
        self.risk += _moments(z, w, self.q)
        count = int(np.count_nonzero(died))
        if count:
            if self.efron:
                self.dead += _moments(z[:, died], w[died], self.q)
            self.count += count
            d = died.astype(float)
            self.eta += eta @ d
            self.z += z @ d

    def _close(self):
        if self.time is None:
            return
        if self.count:
            risk, dead, total, first = self.before + self.risk, self.dead, self.count, 0
            if self.time in self.ties:
                risk, dead, total, first = self.ties[self.time]
            s0, s1, s2 = self._parts(risk)
            d0, d1, d2 = self._parts(dead)
            r0, r1, c0, c1, c2, logs = _tie_sums(s0, d0, total, first, self.count, self.efron)
            self.value += self.eta - logs
            self.grad += self.z - r0 * s1 + r1 * d1
            cross = c1 * np.outer(s1, d1)
            self.curve += (r0 * s2 - r1 * d2 - c0 * np.outer(s1, s1) + cross + cross.T - c2 * np.outer(d1, d1))
        self.before += self.risk
        self.time = None

    def _whole(self, z, eta, w, died, starts, sizes):
        """Complete times, in groups of ``sizes`` rows from ``starts`` on.  Risk-set second moments are not accumulated
        time by time: swapping the two sums turns them into one product weighted by the hazard gathered up to each row."""
        have, groups = self.have, len(starts)
        b0, b1, b2 = self._parts(self.before)
        zw, d = z * w, died.astype(float)
        s0 = b0 + np.cumsum(np.add.reduceat(w, starts))
        s1 = b1[:, None] + np.cumsum(np.add.reduceat(zw, starts, axis=1), axis=1)
        self.grad += z @ d
        if self.efron:
            rows = np.flatnonzero(died)
            g = np.repeat(np.arange(groups), sizes)[rows]
            n = np.bincount(g, minlength=groups)
            u = (np.arange(len(rows)) - (np.cumsum(n) - n)[g]) / np.maximum(n, 1)[g]
            v = 1 / (s0[g] - u * np.bincount(g, w[rows], groups)[g])
            r0, c0 = np.bincount(g, v, groups), np.bincount(g, v * v, groups)
            self.value += eta @ d + np.log(v).sum()
        else:
            n = np.add.reduceat(d, starts)
            v = np.divide(1.0, s0, out=np.zeros(groups), where=n > 0)
            r0, c0 = n * v, n * v * v
            self.value += eta @ d - n[n > 0] @ np.log(s0[n > 0])
        self.grad -= s1 @ r0
        ahead = np.repeat(np.cumsum(r0[::-1])[::-1], sizes)
        # The rows' second moments with and without that weight, in one product.
        both = np.concatenate([zw * ahead, zw]) @ z.T
        self.curve += both[:have] + b2 * r0.sum() - (s1 * c0) @ s1.T
        if self.efron:
            zd, wd = z[:, rows], w[rows]
            d1 = np.array([np.bincount(g, wd * c, groups) for c in zd]).reshape(have, groups)
            r1, c1, c2 = (np.bincount(g, f, groups) for f in (u * v, u * v * v, u * u * v * v))
            self.grad += d1 @ r1
            cross = (s1 * c1) @ d1.T
            self.curve += cross + cross.T - (d1 * c2) @ d1.T - (zd * (wd * r1[g])) @ zd.T
        self.before[0] += w.sum()
        b1 += zw.sum(axis=1)        # views of the sums before
        b2 += both[have:]

    def total(self) -> np.ndarray:
        self._close()
        out = np.zeros(1 + self.q + self.q ** 2)
        out[0], out[1:1 + self.have] = self.value, self.grad
        out[1 + self.q:].reshape(self.q, self.q)[:self.have, :self.have] = self.curve
        return out


def _cox_evaluate(order: TimeOrder, jobs, q: int, efron: bool) -> np.ndarray:
    """Log likelihood, gradient and curvature per model, summed over partitions."""
    size, p, width = 1 + q + q * q, order.p, order.width
    columns = ["x", "folds", "event", "late", "part"]

    def sweep(batches, before, ties):
        sweeps = [_Sweep(q, len(beta), before[i], {t: tuple(v[i] for v in tie) for t, tie in ties.items()}, efron)
                  for i, (_, beta) in enumerate(jobs)]
        for x, folds, event, late, _ in _arrays(batches, p, width):
            starts = np.flatnonzero(np.append(True, late[1:] != late[:-1]))
            for s, (model, beta) in zip(sweeps, jobs):
                z, eta, w, train = _weights(model, beta, x, folds)
                s.add(z, eta, w, train & (event > 0), late, starts)
        return [s.total() for s in sweeps]

    if order.parts == 1:
        def whole(batches):
            yield from enumerate(sweep(batches, np.zeros((len(jobs), size)), {}))
        return scan(order.rows, columns, whole, (len(jobs), size), 1)

    def one(table, carry):
        found = sweep(table.to_batches(), *pickle.loads(carry.column("v")[0].as_py()))
        part = table.column("part")[0].as_py()
        return pa.table({"slot": pa.array(range(len(found)), pa.int32()), "part": pa.array([part] * len(found), pa.int32()),
                         "v": pa.array([v.tobytes() for v in found], pa.binary())})

    # The cached layout is hashed and sorted by ``part``: only the carries are shuffled.
    partial = order.rows.select(*columns).groupBy("part").cogroup(
        _cox_carries(order, jobs, q, efron).groupBy("part")).applyInArrow(one, PARTIAL)
    return add_partials(partial, (len(jobs), size), order.parts)


def _cox_by_time(order: TimeOrder, jobs) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Log likelihood by Breslow's rule, gradient and curvature per model, from sums per model and time in one scan.

    A row that no model clips has one set of values u, the same for all models up to each one's centre and scale, so
    scores of all models are one product, and so are the sums of w, w u and w u u' of a time.  Rows that some model
    clips are taken model by model.  The driver gets one array per time (and task) and adds up over falling time.
    """
    p, width, step_rows, m = order.p, order.width, COX_STEP_ROWS, len(jobs)
    cols = sorted({c for model, _ in jobs for c in model.cols})
    q = len(cols)
    place = {c: i for i, c in enumerate(cols)}
    low, high = np.full((m, q), -np.inf), np.full((m, q), np.inf)
    mean, scale, used = np.zeros((m, q)), np.ones((m, q)), np.zeros((m, q), dtype=bool)
    slope = np.zeros((m, q))
    for i, (model, beta) in enumerate(jobs):
        at = [place[c] for c in model.cols]
        low[i, at], high[i, at], mean[i, at], scale[i, at], used[i, at] = model.low, model.high, model.mean, model.scale, True
        slope[i, at] = beta
    centre = (mean * used).sum(axis=0) / used.sum(axis=0)
    unit = (scale * used).sum(axis=0) / used.sum(axis=0)
    shift = (slope * (centre - mean) / scale).sum(axis=1)
    slope = slope * unit / scale
    inner_low, inner_high = low.max(axis=0), high.min(axis=0)
    first, second = np.triu_indices(q)
    length = 1 + q + len(first)
    training = [(model.seed, model.fold) for model, _ in jobs]

    def products(u):
        """1, u and the products of every two of its rows."""
        out = np.empty((length, u.shape[1]))
        out[0], out[1:1 + q] = 1.0, u
        np.multiply(u[first], u[second], out=out[1 + q:])
        return out

    def trained(folds, rows):
        out = np.empty((m, len(folds[0]) if rows is None and width else len(rows)))
        for line, (seed, fold) in zip(out, training):
            line[:] = 1.0 if seed is None else folds[seed] != fold if rows is None else folds[seed][rows] != fold
        return out

    def kernel(batches):
        time, sums = None, None      # of the time that is open: m x (moments, events, sums of u over events)

        def settle():
            return pa.RecordBatch.from_arrays([pa.array([time]), pa.array([sums.tobytes()], pa.binary())], names=["late", "v"])

        for b in batches:
            for n, x, folds, event, late in zip(*[c.to_pylist() for c in b.columns]):
                x = np.frombuffer(x).reshape(p, n)[cols]
                folds = np.frombuffer(folds, "int32").reshape(width, n)
                event, late = np.frombuffer(event, "uint8") > 0, np.frombuffer(late)
                inside = ((x >= inner_low[:, None]) & (x <= inner_high[:, None])).all(axis=0)
                starts = np.flatnonzero(np.append(True, late[1:] != late[:-1]))
                found = np.zeros((len(starts), m, length + 1 + q))
                for lo in range(0, n, step_rows):
                    part = slice(lo, min(n, lo + step_rows))
                    u = (x[:, part] - centre[:, None]) / unit[:, None]
                    keep = inside[part]
                    if not keep.all():
                        u[:, ~keep] = 0.0
                    train = trained([f[part] for f in folds], None) if width else np.ones((m, u.shape[1]))
                    if not keep.all():
                        train *= keep
                    w = slope @ u
                    w += shift[:, None]
                    np.exp(w, out=w)
                    w *= train
                    moments = products(u)
                    died = event[part] & keep
                    edges = np.clip(np.append(starts, n), part.start, part.stop) - lo
                    for k in range(np.searchsorted(starts, lo, "right") - 1, np.searchsorted(starts, part.stop, "left")):
                        rows = slice(edges[k], edges[k + 1])
                        found[k, :, :length] += w[:, rows] @ moments[:, rows].T
                        gone = rows.start + np.flatnonzero(died[rows])
                        if len(gone):
                            found[k, :, length:] += train[:, gone] @ moments[:1 + q, gone].T
                outer = np.flatnonzero(~inside)
                if len(outer):
                    own = np.searchsorted(starts, outer, "right") - 1
                    turn = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    train, xo, died = trained(folds, outer), x[:, outer], event[outer]
                    for i in range(m):
                        u = np.maximum(xo, low[i][:, None])
                        np.minimum(u, high[i][:, None], out=u)
                        u -= centre[:, None]
                        u /= unit[:, None]
                        moments = products(u)
                        weight = np.exp(slope[i] @ u + shift[i]) * train[i]
                        found[own[turn], i, :length] += np.add.reduceat(moments * weight, turn, axis=1).T
                        found[own[turn], i, length:] += np.add.reduceat(moments[:1 + q] * (train[i] * died), turn, axis=1).T
                for k, at in enumerate(late[starts].tolist()):
                    if time is not None and at != time:
                        yield settle()
                    sums = found[k].copy() if time is None or at != time else sums + found[k]
                    time = at
        if time is not None:
            yield settle()

    rows = order.packed.select("n", "x", "folds", "event", "late").mapInArrow(kernel, "late double, v binary").collect()
    times = sorted({r.late for r in rows})
    number = {t: i for i, t in enumerate(times)}
    sums = np.zeros((len(times), m, length + 1 + q))
    for r in sorted(rows, key=lambda r: (r.late, bytes(r.v))):
        sums[number[r.late]] += np.frombuffer(r.v).reshape(m, -1)
    np.cumsum(sums[:, :, :length], axis=0, out=sums[:, :, :length])
    out = []
    for i, (model, beta) in enumerate(jobs):
        mine = sums[sums[:, i, length] > 0, i]
        d, risk = mine[:, length], mine[:, 0]
        u = mine[:, 1:1 + q] / risk[:, None]
        total = mine[:, length + 1:].sum(axis=0)
        value = slope[i] @ total + shift[i] * d.sum() - d @ np.log(risk)
        grad = total - d @ u
        curve = np.zeros((q, q))
        curve[first, second] = (d / risk) @ mine[:, 1 + q:length]
        curve[second, first] = curve[first, second]
        curve -= (u * d[:, None]).T @ u
        at = [place[c] for c in model.cols]
        back = (unit / scale[i])[at]
        out.append((value, grad[at] * back, curve[np.ix_(at, at)] * np.outer(back, back)))
    return out


def cox_fitter(order: TimeOrder, alpha: float = 0.05, ties: str = "breslow"):
    """fit(models, start) for Cox regression with penalty alpha/2 * |beta|^2."""
    if ties not in ("breslow", "efron"):
        raise ValueError(f"unknown tie rule {ties!r}")

    def by_time(jobs):
        """Whether many rows share a time, and the sums of all models and times fit on the driver."""
        q = len({c for model, _ in jobs for c in model.cols})
        return ties == "breslow" and order.n >= COX_TIME_ROWS * order.times and 8 * order.times * len(jobs) * (1 + q) * (2 + q / 2) <= COX_TIME_BYTES

    def evaluate(models, asked):
        jobs = [(models[m], b) for m, b in asked]
        if by_time(jobs):
            return [(value - alpha / 2 * beta @ beta, grad - alpha * beta, curve + alpha * np.eye(len(beta)))
                    for (_, beta), (value, grad, curve) in zip(asked, _cox_by_time(order, jobs))]
        q = max(len(b) for _, b in asked)
        per_model = 8 * (1 + 4 * bool(order.shared)) * (1 + q + q * q)
        # Few children a node where one model alone is large; then as many models as fit beside each other.
        fan = max(2, min(order.group, COX_GROUP_BYTES // per_model))
        tree = replace(order, group=fan)
        chunk = max(1, COX_GROUP_BYTES // (fan * per_model))
        out = []
        for at in range(0, len(asked), chunk):
            jobs = [(models[m], b) for m, b in asked[at:at + chunk]]
            sums = _cox_evaluate(tree, jobs, q, ties == "efron")
            for (_, beta), s in zip(jobs, sums):
                have = len(beta)
                curve = s[1 + q:].reshape(q, q)[:have, :have]
                out.append((s[0] - alpha / 2 * beta @ beta, s[1:1 + have] - alpha * beta,
                            curve + alpha * np.eye(have)))
        return out

    return Fitter(evaluate)


# --- recursive elimination ----------------------------------------------------------------------

def _without(beta: np.ndarray, curve: np.ndarray, drop: int) -> np.ndarray:
    """The maximum of the last quadratic model with coefficient ``drop`` held at zero, without that entry.

    Solving the curvature once for the dropped column gives the block inverse's update of all others.
    """
    column = np.linalg.lstsq(curve, np.eye(len(beta))[drop], rcond=None)[0]
    moved = beta - column / column[drop] * beta[drop] if column[drop] > 0 else beta
    return np.delete(moved, drop)


def eliminate(fit: Fitter, models: list[Model], k_max: int, mandatory: int | None = None,
              intercept: bool = False) -> list[dict[int, tuple[list[int], np.ndarray]]]:
    """Drop the weakest column of every model, refit, and go on down to one column.

    Per model: number of features -> (columns, coefficients), for 1..k_max.  One path serves all
    sizes, since a drop does not depend on where the path stops.  ``mandatory`` comes first in the
    column order and is never dropped; equal coefficients drop the first of them.  A refit starts where
    the last curvature puts the maximum without the dropped column, usually so near that two or three
    scans settle it; how far a model goes on is decided by its own step, as in any fit.
    """
    tail = 1 if intercept else 0
    state = []
    for m in models:
        if mandatory is not None:
            if mandatory not in m.cols:
                raise ValueError("the mandatory feature did not pass the variance filter")
            m = m.take([mandatory] + [c for c in m.cols if c != mandatory])
        state.append(m)
    found: list[dict] = [{} for _ in models]
    start = [np.zeros(len(m.cols) + tail) for m in state]
    live = list(range(len(models)))
    while live:
        betas, curves = fit.solve([state[i] for i in live], [start[i] for i in live])
        following = []
        for i, beta, curve in zip(live, betas, curves):
            cols = state[i].cols
            if np.isnan(beta).any():      # no fit, so nothing to choose by: the path ends here
                for k in range(1, min(len(cols), k_max) + 1):
                    found[i][k] = (list(cols[:k]), np.full(k + tail, np.nan))
                continue
            if not found[i] or len(cols) <= k_max:
                for k in range(len(cols), k_max + 1) if not found[i] else [len(cols)]:
                    found[i][k] = (list(cols), beta)
            if len(cols) == 1:
                continue
            weight = beta[:len(cols)] ** 2
            if mandatory is not None:
                weight[0] = np.inf
            drop = int(np.argmin(weight))
            kept = [a for a in range(len(cols)) if a != drop]
            state[i] = state[i].take([cols[a] for a in kept])
            start[i] = _without(beta, curve, drop)
            following.append(i)
        live = following
    return found
