"""Files in and out.  Formats follow the file extension; names keep their list order."""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions.columns import col

# Column headers of the two metric files.
LOGISTIC_METRICS = ["NumFeatures", "Validation_AUC", "Validation_Accuracy", "Holdout_AUC",
                    "Holdout_Accuracy", "OR > 1 Features", "OR < 1 Features"]
SURVIVAL_METRICS = ["NumFeatures", "Validation_Set_Concordance", "Test_Set_Concordance",
                    "HR > 1 Features", "HR < 1 Features"]


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Parquet by extension, ``.csv`` with commas, anything else tab-separated.

    Give ``schema`` for large text inputs: inferring it costs one more scan.
    """
    lower = path.lower().rstrip("/")
    if lower.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True).option("sep", "," if lower.endswith(".csv") else "\t")
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).csv(path)


def read_feature_list(spark: SparkSession, path: str) -> list[str]:
    """One name per line, trimmed, blank lines dropped, in file order."""
    return [name for name in (r[0].strip() for r in spark.read.text(path, wholetext=False).collect())
            if name]


def resolve_features(df: DataFrame, names: list[str], strict: bool = False) -> list[str]:
    """Names that exist in ``df``, in list order; ``strict`` refuses an empty result."""
    present = set(df.columns)
    kept = [n for n in (name.strip() for name in names) if n and n in present]
    if strict and not kept:
        raise ValueError("none of the requested features are in the data")
    return kept


def read_run_matrix(spark: SparkSession, path: str) -> list[dict]:
    """One analysis per CSV row, as plain dictionaries; ``cols_to_balance`` becomes a list."""
    rows = spark.read.option("header", True).option("inferSchema", True) \
                .option("quote", '"').option("escape", '"').csv(path).collect()
    return [parse_run(r.asDict()) for r in rows]


def parse_run(run: dict) -> dict:
    """``cols_to_balance`` read as a Python literal: a list, a tuple or one name."""
    listed = run.get("cols_to_balance")
    if isinstance(listed, str):
        value = ast.literal_eval(listed.strip()) if listed.strip() else []
        run = {**run, "cols_to_balance": [value] if isinstance(value, str) else list(value)}
    return run


def run_matrix(runs: list[dict], analysis: Callable[[dict], DataFrame],
               keys: tuple[str, ...] = ("dataset", "featureset", "random_state")) -> DataFrame:
    """Run one analysis per matrix row and stack the results under the run's key columns."""
    stacked = None
    for run in runs:
        result = analysis(run)
        result = result.select(*[F.lit(run[k]).alias(k) for k in keys if k in run], "*")
        stacked = result if stacked is None else stacked.unionByName(result)
    if stacked is None:
        raise ValueError("the run matrix has no rows")
    return stacked


def write_metrics(df: DataFrame, path: str) -> None:
    """Fold metrics as CSV with a header; name lists are joined with a comma and a space."""
    out = [F.array_join(col(f.name), ", ").alias(f.name) if f.dataType.typeName() == "array"
           else col(f.name) for f in df.schema.fields]
    df.select(*out).write.mode("errorifexists").option("header", True) \
      .option("emptyValue", "").csv(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Read the metric files back by name; an empty name list is an empty string."""
    df = spark.read.option("header", True).csv(path)
    typed = []
    for c in df.columns:
        if c.endswith("Features") and c != "NumFeatures":
            typed.append(F.coalesce(col(c), F.lit("")).alias(c))
        elif c == "NumFeatures":
            typed.append(col(c).cast("int").alias(c))
        elif c.split("_")[-1] in ("AUC", "Accuracy", "Concordance"):
            typed.append(col(c).cast("double").alias(c))
        else:
            typed.append(col(c))
    return df.select(*typed)


def write_split(train: DataFrame, test: DataFrame, path: str, id_col: str, features: list[str],
                outcome: list[str], form: str = "parquet") -> None:
    """X and y of both sides, partitioned by side and keyed by ``id_col`` so they rejoin.

    ``form`` is ``parquet`` or ``csv`` (with a header).
    """
    if form not in ("parquet", "csv"):
        raise ValueError(f"unknown form {form!r}")
    both = train.withColumn("split", F.lit("train")).unionByName(
        test.withColumn("split", F.lit("test")))
    for name, columns in (("X", features), ("y", outcome)):
        both.select("split", col(id_col), *[col(c) for c in columns]) \
            .write.mode("errorifexists").option("header", True).partitionBy("split").format(form).save(f"{path}/{name}")


def read_split(spark: SparkSession, path: str, part: str, side: str, form: str = "parquet") -> DataFrame:
    both = spark.read.option("header", True).option("inferSchema", True).format(form).load(f"{path}/{part}")
    return both.where(F.col("split") == side).drop("split")


def corr_square(pairs: DataFrame, features: list[str]) -> DataFrame:
    """Long (feat1, feat2, rho) to the square frame, five decimals, one row per feature."""
    return (pairs.groupBy(F.col("feat1").alias("feature"))
            .pivot("feat2", features).agg(F.round(F.first("rho"), 5)))


def write_corr_matrix(pairs: DataFrame, features: list[str], path: str) -> None:
    place = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature"))
    square = corr_square(pairs, features)
    square.orderBy(place).coalesce(1).write.mode("errorifexists").option("header", True).csv(path)
