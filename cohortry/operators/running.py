"""Exact running totals along a global order, with no window that holds a whole key in one task.

Where the largest key is small (counted), an ordinary window does.  Otherwise rows are range-partitioned on
(keys, order); each partition reports only its edge key, the handful of edge rows is turned into
one carry-in per partition, and a second pass adds local sums.  A key holding most of the rows
is therefore spread over as many partitions as its rows need.
"""

from __future__ import annotations

import gc
import math
import tempfile
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.functions.columns import col

WINDOW_ROWS = 1_000_000       # a key with at most this many rows may go through a plain window
BROADCAST_ROWS = 100_000      # tables of keys up to this many rows are broadcast
BROADCAST_CELLS = 500_000     # tables of values up to this many rows are broadcast
HOT_SHARE = 1000              # a value is hot when it fills more than 1/HOT_SHARE of the rows
PARTITION_ROWS = 1_000_000    # rows per range partition above that
RANGE_PARTS = 200             # partitions of fewer rows are made only up to this many: each sends its metrics to the driver

# What the running analysis has cached; threads and nested analyses have lists of their own.
_held: ContextVar[list[DataFrame] | None] = ContextVar("held", default=None)
# Checkpoints that go at the end of the running analysis, where it is one with scratch files.
_scratch: ContextVar[list[DataFrame] | None] = ContextVar("scratch", default=None)


def hold(df: DataFrame) -> DataFrame:
    """Persist an intermediate result until :func:`release` or the end of its :func:`analysis`."""
    if _held.get() is None:
        _held.set([])
    df = df.persist()
    _held.get().append(df)
    return df


def release() -> None:
    """Drop the cached intermediates of this analysis; frames returned earlier stay valid and recompute."""
    held = _held.get() or []
    while held:
        held.pop().unpersist()


@contextmanager
def analysis(scratch: bool = False):
    """Everything cached inside is dropped at the end, and nothing that others cached.

    With ``scratch`` the checkpoints made inside are deleted too, but for frames taken off the list that is given.
    """
    before, marked = _held.set([]), _scratch.set([] if scratch else _scratch.get())
    try:
        yield _scratch.get()
    finally:
        release()
        _held.reset(before)
        made = _scratch.get()
        _scratch.reset(marked)
        if scratch:
            for df in made:
                _delete_checkpoint(df)
            if made:
                drop_shuffles(made[0].sparkSession)


def _delete_checkpoint(df: DataFrame) -> None:
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files of plans that nothing refers to are deleted when the driver collects its garbage; so it does now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def join_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join to a table of one row per key: broadcast once its counted size is known to be small.

    Beyond that an ordinary shuffled join, where adaptive execution splits skewed keys.
    """
    small = hold(small)
    return join_keys(df, small, on, how, small.count() <= BROADCAST_ROWS)


def join_values(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """Join ``left`` to one row per value, where a few values may fill most of ``left``.

    ``weight`` counts the left rows of a value.  Few values in all: broadcast.  Otherwise the values
    with more than ``total / HOT_SHARE`` rows, of which there can only be few, are broadcast and leave
    the shuffle; the rest is joined by shuffling.
    """
    right = hold(right)
    if right.count() <= BROADCAST_CELLS:
        return join_keys(left, right.drop(weight), on, small=True)
    line = max(1, total // HOT_SHARE)
    hot = right.where(col(weight) > line).drop(weight)
    cold = right.where(col(weight) <= line).drop(weight)
    return join_keys(left, hot, on, small=True).unionByName(
        join_keys(join_keys(left, hot, on, "left_anti", True), cold, on))


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint to the folder the cluster names: the partition layout survives lost executors, and
    long chains of steps stay short plans."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    done = df.checkpoint(eager=True)
    if _scratch.get() is not None:
        _scratch.get().append(done)
    return done


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder on a cluster")
        named = tempfile.mkdtemp(prefix="cohortry-checkpoint-")
    sc.setCheckpointDir(named)


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Join in which NULL keys meet NULL keys, as they do in grouping; the left side's keys stay."""
    names = [f"_key_{i}" for i in range(len(keys))]
    right = right.select(*[col(k).alias(n) for k, n in zip(keys, names)], *[col(c) for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    return left.join(F.broadcast(right) if small else right, same, how).drop(*names)


def running_totals(df: DataFrame, keys: list[str], order: list[str], sums: list[str],
                   window_rows: int | None = None, partition_rows: int | None = None) -> DataFrame:
    """Add ``<c>_before``: the sum of ``c`` over earlier rows of the same key (own row excluded).

    ``(keys, order)`` must identify a row and ``order`` hold no NULL; NULL keys are keys of their own.
    ``sums`` are bigint or double.  Both routes add up a key's rows in order from its own start, so
    they differ by the rounding of one addition at most.
    """
    window_rows = WINDOW_ROWS if window_rows is None else window_rows
    partition_rows = PARTITION_ROWS if partition_rows is None else partition_rows
    df = hold(df)
    n = df.count()
    by = [col(k) for k in keys]
    largest = n
    if keys and n > window_rows:
        largest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]

    def before(*parts: Column) -> dict[str, Column]:
        w = Window.partitionBy(*parts).orderBy(*[col(o) for o in order]).rowsBetween(Window.unboundedPreceding, -1)
        return {f"{c}_before": F.coalesce(F.sum(col(c)).over(w), F.lit(0).cast(df.schema[c].dataType))
                for c in sums}

    if largest <= window_rows:
        return df.withColumns(before(*by))
    # A key is cut where range partitions end; no piece of it is larger than a partition.
    parts = max(2, min(math.ceil(n / partition_rows), max(RANGE_PARTS, math.ceil(n / PARTITION_ROWS))))
    ranged = durable(df.repartitionByRange(parts, *by, *[col(o) for o in order])
                     .withColumn("_part", F.spark_partition_id()))
    local = ranged.withColumns(before(F.col("_part"), *by))
    pieces = ranged.groupBy("_part", *by).agg(*[F.sum(col(c)).alias(c) for c in sums])
    # One row per key and partition; only keys that go on in a later partition carry anything, and
    # there are fewer of those rows than twice the partitions.
    ahead = Window.partitionBy(*by).orderBy("_part")
    carry = pieces.select("_part", *by, F.row_number().over(ahead).alias("_piece"), *[
        F.sum(col(c)).over(ahead.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_carry_{i}")
        for i, c in enumerate(sums)]).where("_piece > 1").drop("_piece")
    return join_keys(local, carry, ["_part"] + keys, "left", True).withColumns({
        f"{c}_before": col(f"{c}_before") + F.coalesce(F.col(f"_carry_{i}"), F.lit(0).cast(df.schema[c].dataType))
        for i, c in enumerate(sums)}).drop("_part", *[f"_carry_{i}" for i in range(len(sums))])
