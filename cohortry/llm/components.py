"""Connected components of a graph given as a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import durable


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """One row (node, root) per node of ``links``; nodes share ``root`` exactly when links connect them.

    In every round each node moves to the first of its neighbours in an order drawn anew for the round, and
    the links between what is left are kept once; the expected number of rounds is logarithmic, whatever the
    shape.  Neighbour lists are never gathered: a node's best neighbour is a minimum, combined before the
    shuffle.  Every round is written to the shared folder.  No links give no rows.
    """
    edges = durable(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "links")
    whole = None
    step = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(step), F.col(c)).alias("order"), F.col(c).alias("node"))
        moves = durable(both.groupBy("u").agg(F.min(rank("v")).alias("best")).select(
            F.col("u").alias("node"), F.least(rank("u"), F.col("best"))["node"].alias("to")), "moves")
        whole = moves if whole is None else durable(
            whole.join(moves.withColumnRenamed("node", "at").withColumnRenamed("to", "next"),
                       F.col("to") == F.col("at"), "left")
            .select("node", F.coalesce("next", "to").alias("to")), "roots")
        # The nodes of later rounds are among those of the first, so ``whole`` names every node.
        to_u = moves.select(F.col("node").alias("u"), F.col("to").alias("x"))
        to_v = moves.select(F.col("node").alias("v"), F.col("to").alias("y"))
        edges = durable(edges.join(to_u, "u").join(to_v, "v").where("x <> y")
                        .select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "links")
        step += 1
    if whole is None:
        return links.select(F.col(a).alias("node"), F.col(a).alias("root")).limit(0)
    return whole.select("node", F.col("to").alias("root"))
