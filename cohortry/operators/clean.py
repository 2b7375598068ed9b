"""Projections and row filters on subject tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.columns import col, missing

# Texts that stand for a missing cell.
SENTINELS = ["No Data", "#VALUE!"]

# Number texts Spark would read but a table reader would not: a trailing type letter.
_TYPE_LETTER = r"^\s*[+-]?[0-9.].*[dDfF]\s*$"


def replace_sentinels(df: DataFrame, cols: list[str], sentinels: list[str] = SENTINELS) -> DataFrame:
    """Whole-cell sentinel texts become NULL; only text columns can hold them."""
    text = [c for c in cols if df.schema[c].dataType.typeName() in ("string", "varchar", "char")]
    return df.withColumns({c: F.when(~col(c).isin(sentinels), col(c)) for c in text}) if text else df


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns as double; unparsable text and NaN become NULL, nothing raises."""
    out = {}
    for c in cols:
        value = col(c)
        if df.schema[c].dataType.typeName() == "string":
            value = F.when(~value.rlike(_TYPE_LETTER), value)
        number = value.try_cast("double")
        out[c] = F.nanvl(number, F.lit(None).cast("double"))
    return df.withColumns(out)


def drop_incomplete(df: DataFrame, subset: list[str]) -> DataFrame:
    """Rows in which every listed column is present (neither NULL nor NaN).

    One condition per column, so the NULL checks reach the Parquet scan.
    """
    for c in subset:
        df = df.where(~missing(df, c))
    return df


def any_missing(df: DataFrame, cols: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [missing(df, c) for c in cols])


def na_profile(df: DataFrame, cols: list[str], top: int = 10) -> DataFrame:
    """Missing cells per column, most first, beside the shape before and after dropping."""
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), F.count_if(any_missing(df, cols)).alias("_any"),
                     *[F.count_if(missing(df, c)).alias(c) for c in cols])
    return (counted.unpivot(["_rows", "_any"], [col(c) for c in cols], "feature", "n_missing")
            .select("feature", "n_missing", F.col("_rows").alias("rows_before"),
                    F.lit(len(cols)).alias("n_cols"), F.col("_any").alias("rows_with_missing"),
                    (F.col("_rows") - F.col("_any")).alias("rows_after"))
            .orderBy(F.desc("n_missing"), "feature").limit(top))


def drop_columns(df: DataFrame, cols: list[str], protect: str | None = None) -> tuple[DataFrame, list[str]]:
    """Drop listed columns (absent names are ignored), the protected one back in first place.

    Also returns the names that really went, in table order.
    """
    if protect is not None and protect not in df.columns:
        raise ValueError(f"protected column {protect!r} is not in the data")
    rest = [c for c in df.columns if c not in set(cols) and c != protect]
    kept = ([protect] if protect is not None else []) + rest
    return df.select(*[col(c) for c in kept]), [c for c in df.columns if c not in set(kept)]


def align_columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[col(c) for c in like.columns])


# The default names of the stratum column and of log columns.
STRATUM, LOG_SUFFIX = "strat_col", "_log"


def strat_key(df: DataFrame, cols: list[str], name: str = STRATUM) -> DataFrame:
    """Values joined by ``_``; a missing value is a stratum of its own."""
    return df.withColumn(name, F.concat_ws(
        "_", *[F.coalesce(col(c).cast("string"), F.lit("nan")) for c in cols]))


def log_shifts(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """Per column the amount that makes the minimum positive; 0 when it already is."""
    absent = [c for c in cols if c not in df.columns]
    if absent:
        raise ValueError(f"columns to transform are not in the data: {absent}")
    low = df.agg(*[F.min(col(c)).alias(c) for c in cols]).first()
    return {c: abs(low[c]) + 1e-6 if low[c] is not None and low[c] <= 0 else 0.0 for c in cols}


def log_transform(df: DataFrame, cols: list[str], suffix: str = LOG_SUFFIX,
                  shifts: dict[str, float] | None = None) -> DataFrame:
    """Add natural-log columns.  By default a table is shifted by its own minimum; pass the
    training table's :func:`log_shifts` to shift both sides alike."""
    if not cols:
        return df
    shifts = log_shifts(df, cols) if shifts is None else shifts
    return df.withColumns({c + suffix: F.ln(col(c) + F.lit(shifts[c])) for c in cols})


def cast_outcome(df: DataFrame, response: str | None = None, event: str | None = None,
                 time: str | None = None) -> DataFrame:
    """Response to int (truncating); event to boolean and time to double."""
    out = {}
    if response is not None:
        out[response] = col(response).try_cast("int")
    if event is not None:
        out[event] = col(event).try_cast("boolean")
    if time is not None:
        out[time] = col(time).try_cast("double")
    return df.withColumns(out)


def map_values(df: DataFrame, column: str, mapping: dict, name: str | None = None) -> DataFrame:
    """Recode by lookup; unmatched values become missing."""
    table = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
    return df.withColumn(name or column, F.try_element_at(table, col(column).cast("string")))
