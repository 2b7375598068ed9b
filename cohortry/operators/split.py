"""Stratified hold-out split and repeated stratified folds.

Subjects are shuffled by ``md5(id:seed)``.  The leading hex digits of that text cut every stratum
into even slices in hash order, so ranking needs only small windows plus one offset per slice,
however large a stratum is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.columns import col, seeded_hash, unique_ids
from cohortry.operators.running import join_small, running_totals

SLICE_ROWS = 500_000


def hashed_positions(df: DataFrame, keys: list[str], hash_col: str, id_col: str, n: int,
                     slice_rows: int | None = None) -> DataFrame:
    """Add ``_pos``: 0-based place of the row within its key, in hash order (id breaks ties)."""
    slice_rows = slice_rows or SLICE_ROWS
    digits = math.ceil(math.log(n / slice_rows, 16)) if n > slice_rows else 0
    order = [col(hash_col), col(id_col)]
    if digits == 0:
        w = Window.partitionBy(*[col(k) for k in keys]).orderBy(*order)
        return df.withColumn("_pos", (F.row_number().over(w) - 1).cast("bigint"))
    sliced = df.withColumn("_slice", F.substring(col(hash_col), 1, digits))
    sizes = sliced.groupBy(*[col(k) for k in keys], "_slice").agg(F.count(F.lit(1)).alias("_n"))
    offsets = running_totals(sizes, keys, ["_slice"], ["_n"]).drop("_n")
    w = Window.partitionBy(*[col(k) for k in keys], "_slice").orderBy(*order)
    return (sliced.withColumn("_rn", F.row_number().over(w))
            .join(offsets, on=keys + ["_slice"])
            .withColumn("_pos", F.col("_n_before") + F.col("_rn") - 1)
            .drop("_slice", "_rn", "_n_before"))


def train_quotas(sizes: DataFrame, strat_col: str, n: int, n_train: int) -> DataFrame:
    """Seats per stratum: floor of the proportional share, the rest by largest remainder.

    ``sizes`` has one row per stratum with its count ``n_rows``; equal remainders go by name.
    """
    share = F.col("n_rows").cast("decimal(19,0)") * F.lit(n_train).cast("decimal(19,0)")
    rest = share % F.lit(n).cast("decimal(19,0)")
    seats = sizes.select(
        col(strat_col), "n_rows", ((share - rest) / F.lit(n)).cast("bigint").alias("_floor"),
        (-rest).cast("bigint").alias("_order"), F.lit(1).cast("bigint").alias("_one"))
    open_seats = n_train - seats.agg(F.sum("_floor")).first()[0]
    ranked = running_totals(seats, [], ["_order", strat_col], ["_one"])
    return ranked.select(col(strat_col), "n_rows",
                         (F.col("_floor") + (F.col("_one_before") < open_seats).cast("bigint"))
                         .alias("n_train"))


def stratified_split(df: DataFrame, id_col: str, strat_col: str, test_size: float = 0.25,
                     seed: int = 0, slice_rows: int | None = None) -> DataFrame:
    """Add ``split`` (``train``/``test``): ceil(test_size * n) test rows, balanced by stratum."""
    sizes = df.groupBy(col(strat_col)).agg(F.count(F.lit(1)).alias("n_rows"))
    n, strata, least = sizes.agg(F.sum("n_rows"), F.count(F.lit(1)), F.min("n_rows")).first()
    if n is None:
        raise ValueError("nothing to split")
    n_test = math.ceil(test_size * n)
    if least < 2:
        raise ValueError("a stratum has a single row")
    if min(n_test, n - n_test) < strata:
        raise ValueError(f"{strata} strata do not fit into {n_test} test and {n - n_test} train rows")
    quotas = train_quotas(sizes, strat_col, n, n - n_test).drop("n_rows")
    placed = hashed_positions(df.withColumn("_hash", seeded_hash(id_col, seed)), [strat_col],
                              "_hash", id_col, n, slice_rows)
    return (join_small(placed, quotas, [strat_col])
            .withColumn("split", F.when(F.col("_pos") < F.col("n_train"), "train").otherwise("test"))
            .select(*[col(c) for c in df.columns], "split"))


def fold_rows(df: DataFrame, id_col: str, label: str, k: int, seeds: list[int],
              slice_rows: int | None = None) -> DataFrame:
    """Long ``(id, label, seed, fold)``: every id once per seed, classes spread evenly.

    Sorted by class, row i goes to fold i mod k; within a class the order is the seeded hash.
    """
    unique_ids(df, id_col)
    base = df.select(col(id_col), col(label))
    sizes = base.groupBy(col(label)).agg(F.count(F.lit(1)).alias("_n"))
    n, most = sizes.agg(F.sum("_n"), F.max("_n")).first()
    if n is None or most < k:
        raise ValueError(f"every class has fewer than {k} rows")
    starts = running_totals(sizes, [], [label], ["_n"]).select(col(label), F.col("_n_before").alias("_start"))
    spread = base.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    spread = spread.withColumn("_hash", seeded_hash(id_col, F.col("seed")))
    placed = hashed_positions(spread, ["seed", label], "_hash", id_col, n * len(seeds), slice_rows)
    fold = ((F.col("_start") + F.col("_pos")) % F.lit(k)).cast("int")
    return join_small(placed, starts, [label]).select(col(id_col), col(label), "seed", fold.alias("fold"))


def stratified_kfold(df: DataFrame, id_col: str, label: str, k: int, seeds: list[int],
                     slice_rows: int | None = None) -> DataFrame:
    """Add ``folds``: one fold number per seed, in the order of ``seeds``; rows are not copied."""
    rows = fold_rows(df, id_col, label, k, seeds, slice_rows)
    by_seed: list[Column] = [F.max(F.when(F.col("seed") == s, F.col("fold"))) for s in seeds]
    folds = rows.groupBy(col(id_col)).agg(F.array(*by_seed).alias("folds"))
    return df.join(folds, on=id_col)


def value_counts(df: DataFrame, column: str, k: int = 5, by: str | None = None) -> DataFrame:
    """Most frequent values, largest first (value breaks ties); within each value of ``by``, if given."""
    if by is None:
        return (df.groupBy(col(column)).agg(F.count(F.lit(1)).alias("n"))
                .orderBy(F.desc("n"), col(column)).limit(k))
    place = F.row_number().over(Window.partitionBy(col(by)).orderBy(F.desc("n"), col(column)))
    return (df.groupBy(col(by), col(column)).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("_place", place).where(F.col("_place") <= k).drop("_place"))
