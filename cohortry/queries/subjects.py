"""The subject table all registered queries run over: one subject per order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators.running import hold
from cohortry.sources.tables import read_table

FEATURES = ["n_lines", "qty_sum", "price_avg", "disc_avg", "tax_avg", "acctbal", "total"]


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are aggregated before the joins, so the join to orders reuses their partitioning."""
    lines = read_table(spark, f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("int").alias("event"),
        F.datediff(F.max("l_shipdate"), F.min("l_shipdate")).cast("double").alias("time"),
        F.count(F.lit(1)).cast("double").alias("n_lines"),
        F.sum("l_quantity").alias("qty_sum"),
        F.round(F.avg("l_extendedprice"), 8).alias("price_avg"),
        F.round(F.avg("l_discount"), 10).alias("disc_avg"),
        F.round(F.avg("l_tax"), 10).alias("tax_avg"))
    orders = read_table(spark, f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    customers = read_table(spark, f"{sf_dir}/customer.parquet").select(
        "c_custkey", "c_acctbal", "c_mktsegment")
    key = F.col("o_orderkey")
    dirty = (F.when(key % 50 == 0, "No Data").when(key % 53 == 0, "#VALUE!").when(key % 59 == 0, None)
             .otherwise(F.col("o_totalprice").cast("string")))
    return (lines.join(orders, F.col("l_orderkey") == key)
            .join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .select(key.alias("id"), F.col("o_orderpriority").alias("prio"),
                    F.col("c_mktsegment").alias("seg"),
                    (F.col("o_orderstatus") == "F").cast("int").alias("response"), "event", "time",
                    "n_lines", "qty_sum", "price_avg", "disc_avg", "tax_avg",
                    F.col("c_acctbal").alias("acctbal"), F.col("o_totalprice").alias("total"),
                    F.lit(1.0).alias("const_col"), dirty.alias("total_txt")))


def held_features(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Chosen columns, cached: for queries that read the subjects more than once."""
    return hold(order_features(spark, sf_dir).select(*cols))


# The same table for the oracle, as the first common table expression of every statement.
F_SQL = """f AS (
SELECT o_orderkey AS id, o_orderpriority AS prio, c_mktsegment AS seg,
  CAST(o_orderstatus = 'F' AS INT) AS response,
  CAST(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INT) AS event,
  CAST(date_diff('day', min(l_shipdate), max(l_shipdate)) AS DOUBLE) AS time,
  CAST(count(*) AS DOUBLE) AS n_lines, sum(l_quantity) AS qty_sum,
  round(avg(l_extendedprice), 8) AS price_avg, round(avg(l_discount), 10) AS disc_avg,
  round(avg(l_tax), 10) AS tax_avg, c_acctbal AS acctbal, o_totalprice AS total,
  CAST(1 AS DOUBLE) AS const_col,
  CASE WHEN o_orderkey % 50 = 0 THEN 'No Data' WHEN o_orderkey % 53 = 0 THEN '#VALUE!'
       WHEN o_orderkey % 59 = 0 THEN NULL ELSE CAST(o_totalprice AS VARCHAR) END AS total_txt
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
GROUP BY o_orderkey, o_orderpriority, c_mktsegment, o_orderstatus, c_acctbal, o_totalprice)"""

# Cleaned text column: sentinels and unparsable texts missing.
CLEAN_SQL = """c AS (SELECT *, try_cast(CASE WHEN total_txt NOT IN ('No Data', '#VALUE!')
  THEN total_txt END AS DOUBLE) AS total_num FROM f)"""


def split_sql(source: str = "f", seed: int = 7, name: str = "sp") -> str:
    """Stratified 75/25 split by prio and seg, as common table expressions ending in ``name``."""
    return f"""st AS (SELECT *, prio || '_' || seg AS strat_col FROM {source}),
sz AS (SELECT strat_col, count(*) AS n_rows FROM st GROUP BY strat_col),
tot AS (SELECT CAST(sum(n_rows) AS BIGINT) AS n,
  CAST(sum(n_rows) - ceil(0.25 * sum(n_rows)) AS BIGINT) AS n_train FROM sz),
fl AS (SELECT strat_col, (n_rows * n_train) // n AS whole, (n_rows * n_train) % n AS rest, n_train
  FROM sz CROSS JOIN tot),
qt AS (SELECT strat_col, whole + CAST(row_number() OVER (ORDER BY rest DESC, strat_col)
  <= n_train - sum(whole) OVER () AS INT) AS quota FROM fl),
{name} AS (SELECT st.*, CASE WHEN row_number() OVER (PARTITION BY st.strat_col
  ORDER BY md5(concat_ws(':', id, {seed})), id) <= quota THEN 'train' ELSE 'test' END AS split
  FROM st JOIN qt USING (strat_col))"""


def fold_sql(source: str, label: str, k: int, seeds: list[int], name: str = "fo") -> str:
    """(id, label, seed, fold) as a common table expression."""
    values = ", ".join(f"({s})" for s in seeds)
    return f"""{name} AS (SELECT id, {label}, seed, CAST((start + row_number() OVER (
  PARTITION BY seed, {label} ORDER BY md5(concat_ws(':', id, seed)), id) - 1) % {k} AS INT) AS fold
  FROM {source} JOIN (SELECT {label}, sum(n) OVER (ORDER BY {label}) - n AS start FROM
    (SELECT {label}, count(*) AS n FROM {source} GROUP BY {label})) USING ({label})
  CROSS JOIN (VALUES {values}) AS s(seed))"""


def unpivot_sql(source: str, cols: list[str], keep: str = "id", name: str = "u") -> str:
    rows = " UNION ALL ".join(
        f"SELECT {keep}, {i} AS j, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM {source}"
        for i, c in enumerate(cols))
    return f"{name} AS ({rows})"


def spearman_sql(source: str, cols: list[str]) -> str:
    """rho per ordered pair of features, NULL for a constant one; ends in ``rho``."""
    return f"""{unpivot_sql(source, cols)},
rk AS (SELECT id, j, feature, rank() OVER (PARTITION BY j ORDER BY v)
  + (count(*) OVER (PARTITION BY j, v) - 1) / 2.0 AS r FROM u),
rho AS (SELECT a.feature AS feat1, b.feature AS feat2, a.j AS i, b.j AS j, count(*) AS n,
  CASE WHEN stddev_pop(a.r) > 0 AND stddev_pop(b.r) > 0 THEN corr(a.r, b.r) END AS rho
  FROM rk a JOIN rk b ON a.id = b.id GROUP BY a.feature, b.feature, a.j, b.j)"""
