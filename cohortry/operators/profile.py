"""Feature profiles: skewness, histograms, Spearman correlation and its tests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.columns import col, unique_ids
from cohortry.functions.pvalues import t_two_sided
from cohortry.operators.running import durable, join_values, running_totals

# Skewness bounds and the advice texts that go with them.
SKEW_BOUND = 0.75
NEAR_NORMAL = "≈ Normal"
RIGHT_SKEWED = "Right-skewed → try log(x) or sqrt(x)"
LEFT_SKEWED = "Left-skewed → try x² or exp(x)"



def skew_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Population skewness per feature and the label that follows from it.

    A constant column has no skewness and, like a skewness of exactly the bound, falls to the
    last label.
    """
    moments = df.agg(*[F.skewness(col(c)).alias(c) for c in cols])
    long = moments.withColumn("_one", F.lit(1)).unpivot("_one", [col(c) for c in cols], "feature", "skew")
    label = (F.when(F.abs("skew") < SKEW_BOUND, NEAR_NORMAL)
             .when(F.col("skew") > SKEW_BOUND, RIGHT_SKEWED).otherwise(LEFT_SKEWED))
    return long.select("feature", "skew", label.alias("comment"))


def feature_ranges(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[f(col(c)).alias(f"{tag}{i}") for i, c in enumerate(cols)
                   for f, tag in ((F.min, "lo"), (F.max, "hi"))]).first()
    return {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(cols)}


def histogram(df: DataFrame, cols: list[str], bins: int = 30) -> DataFrame:
    """Equal-width counts from minimum to maximum, last bin closed, empty bins present."""
    edges = {}
    for c, (lo, hi) in feature_ranges(df, cols).items():
        if lo is not None:
            edges[c] = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    if not edges:
        raise ValueError("no feature has a value")
    placed = []
    for c, (lo, hi) in edges.items():
        step = (hi - lo) / bins
        at = F.least(F.floor((col(c) - F.lit(lo)) / F.lit(step)).cast("int"), F.lit(bins - 1))
        # Rounding may put a value next to an edge one bin off: the edges decide.
        placed.append(at - (col(c) < F.lit(lo) + at * step).cast("int")
                      + ((at < bins - 1) & (col(c) >= F.lit(lo) + (at + 1) * step)).cast("int"))
    names = F.array(*[F.lit(c) for c in edges])
    counts = (df.select(F.posexplode(F.array(*placed)).alias("_j", "bin")).where(F.col("bin").isNotNull())
              .groupBy("_j", "bin").agg(F.count(F.lit(1)).alias("n"))
              .select(F.get(names, F.col("_j")).alias("feature"), "bin", "n"))
    frame = df.sparkSession.createDataFrame(
        [(c, b, float(lo + b * ((hi - lo) / bins)), float(lo + (b + 1) * ((hi - lo) / bins)))
         for c, (lo, hi) in edges.items() for b in range(bins)],
        "feature string, bin int, lower double, upper double")
    return (frame.join(counts, ["feature", "bin"], "left")
            .select("feature", "bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n")))


# --- Spearman -----------------------------------------------------------------------------------

def feature_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """Unordered pairs of distinct feature names in list order, one row each."""
    names = F.array(*[F.lit(c) for c in cols])
    place = (df.sparkSession.range(len(cols) - 1).select(F.col("id").cast("int").alias("i"))
             .withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.lit(len(cols) - 1)))))
    return place.select("i", "j", F.get(names, F.col("i")).alias("feat1"),
                        F.get(names, F.col("j")).alias("feat2"))


def average_ranks(df: DataFrame, id_col: str, cols: list[str], **limits) -> tuple[DataFrame, int]:
    """Wide table of average ranks (ties share theirs), one row per id, and the row count.

    Values are counted before they are ordered, so a frequent value is one row of the ordering.
    The way back to the ids shuffles rare values only.
    """
    long = df.select(col(id_col).alias("_id"), F.posexplode(
        F.array(*[col(c).cast("double") + F.lit(0.0) for c in cols])).alias("_j", "_v"))
    cells = long.groupBy("_j", "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranks = durable(running_totals(cells, ["_j"], ["_v"], ["_n"], **limits).select(
        "_j", "_v", "_n", (F.col("_n_before") + (F.col("_n") + 1) / 2).alias("_rank")))
    n = ranks.agg(F.sum(F.when(F.col("_j") == 0, F.col("_n")))).first()[0] or 0
    ranked = join_values(long, ranks, ["_j", "_v"], "_n", n)
    wide = ranked.groupBy("_id").agg(*[F.max(F.when(F.col("_j") == j, F.col("_rank"))).alias(f"_r{j}")
                                       for j in range(len(cols))])
    return wide, n


def centred_products(df: DataFrame, cols: list[str], centre: float) -> DataFrame:
    """Sums of products of centred columns, (i, j, s) for i <= j: one partial matrix per task."""
    p = len(cols)
    upper = np.triu_indices(p)

    def partial(batches):
        total = np.zeros((p, p))
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(p)]) - centre
            total += x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper[0].astype("int32")), pa.array(upper[1].astype("int32")),
             pa.array(total[upper])], names=["i", "j", "s"])

    return (df.select(*[col(c) for c in cols]).mapInArrow(partial, "i int, j int, s double")
            .groupBy("i", "j").agg(F.sum("s").alias("s")))


def spearman_matrix(df: DataFrame, id_col: str, cols: list[str], **limits) -> DataFrame:
    """Long (feat1, feat2, rho, n), both triangles and the diagonal; NULL for constant columns.

    Rows with a missing feature must be gone (``drop_incomplete``).
    """
    unique_ids(df, id_col)
    wide, n = average_ranks(df, id_col, cols, **limits)
    sums = centred_products(wide, [f"_r{j}" for j in range(len(cols))], (n + 1) / 2).collect()
    s = np.zeros((len(cols), len(cols)))
    for r in sums:
        s[r.i, r.j] = s[r.j, r.i] = r.s
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            spread = float(np.sqrt(s[i, i] * s[j, j]))
            rho = float(np.clip(s[i, j] / spread, -1, 1)) if spread > 0 else None
            rows.append((a, b, i, j, rho, n))
    return df.sparkSession.createDataFrame(
        rows, "feat1 string, feat2 string, i int, j int, rho double, n bigint")


def top_correlations(matrix: DataFrame, k: int = 10) -> DataFrame:
    """Largest absolute values of the strict upper triangle."""
    return (matrix.where((F.col("i") < F.col("j")) & F.col("rho").isNotNull())
            .select("feat1", "feat2", F.abs("rho").alias("abs_rho"))
            .orderBy(F.desc("abs_rho"), "feat1", "feat2").limit(k))


def spearman_test(matrix: DataFrame, pairs: DataFrame) -> DataFrame:
    """rho, t and two-sided p per pair, Student t with n - 2 degrees of freedom."""
    joined = pairs.select("feat1", "feat2").join(matrix.select("feat1", "feat2", "rho", "n"),
                                                 ["feat1", "feat2"])
    dof = (F.col("n") - 2).cast("double")
    t = F.when(F.abs("rho") < 1, F.col("rho") * F.sqrt(dof / (1 - F.col("rho") * F.col("rho"))))
    p = F.when(F.col("rho").isNull(), None).when(F.abs("rho") >= 1, F.lit(0.0)) \
         .otherwise(t_two_sided(F.coalesce(t, F.lit(0.0)), dof))
    return joined.select("feat1", "feat2", "rho", "n", t.alias("t"), p.alias("p_value"))


def drop_correlated(matrix: DataFrame, cols: list[str], threshold: float = 0.9,
                    protect: tuple[str, ...] = ()) -> list[str]:
    """Columns to keep: of each pair above the threshold the later one goes, unless protected.

    Works on the pair table (features squared, not rows); a dropped column drops no others.
    """
    near = {(r.feat1, r.feat2) for r in
            matrix.where((F.col("i") < F.col("j")) & (F.abs("rho") > threshold))
            .select("feat1", "feat2").collect()}
    dropped: set[str] = set()
    for i, a in enumerate(cols):
        if a in dropped or a in protect:
            continue
        dropped |= {b for b in cols[i + 1:] if b not in protect and (a, b) in near}
    return [c for c in cols if c not in dropped]
