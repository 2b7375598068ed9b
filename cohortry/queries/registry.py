"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators.running import ensure_checkpoint_dir, release

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; caches of the query before it are let go when it starts."""
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            release()
            return fn(spark, sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def scratch(spark: SparkSession) -> str:
    """A fresh path in the shared folder the session names for checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/scratch-{uuid.uuid4().hex}"


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    # Adding zero turns a rounded -0.0 into 0.0.
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) + F.lit(0.0) for c in cols})


def r6(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n.split('.')[-1]}" for n in names)
