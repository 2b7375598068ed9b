"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A column name safe for Spark even when it holds dots or backticks."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def seeded_hash(id_col: str, seed) -> Column:
    """Text order used for every shuffle of subjects; the same in any SQL engine."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws(":", col(id_col).cast("string"), seed.cast("string")))


def missing(df: DataFrame, name: str) -> Column:
    """True for NULL and, on floating columns, for NaN."""
    if df.schema[name].dataType.typeName() in ("double", "float"):
        return col(name).isNull() | F.isnan(col(name))
    return col(name).isNull()


def unique_ids(df: DataFrame, id_col: str) -> None:
    """Refuse a table in which an id is missing or stands twice: what is joined back by id needs it."""
    again = df.groupBy(col(id_col)).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) | col(id_col).isNull())
    bad = again.first()
    if bad is not None:
        raise ValueError(f"{id_col} must be there once per row; {bad[0]!r} has {bad[1]} rows")
