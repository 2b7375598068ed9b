"""Exact dedup by a tree-merge of sorted digest runs.

Every input partition sorts its digests into one run: each distinct digest once, with its smallest identifier and its
number of rows.  In each round ``fan_in`` runs of neighbouring partitions meet (partition r and round k meet in
r >> k*log2(fan_in)).  Runs are exchanged in slices, ranges of the digest, so that a task gets one range of the runs
that meet; it sorts what it got and merges adjacent equal digests in a streamed, sorted aggregation, keeping the
smallest identifier.  In the end one run is left, cut into its slices; their number grows with the rows.  A digest that
a third of all rows share is one row per run from the first level on, and is never a group.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import col, durable, one_space, spare_name, text_of

FAN_IN = 16
SLICE_BITS = 6          # the range of digests is cut into 2^SLICE_BITS slices at least,
SLICE_ROWS = 500_000    # and into so many that one has about this many rows
HOT_GROUPS = 10_000     # at most so many groups of copies are broadcast: a group is hot above rows / HOT_GROUPS rows
KEY = ["__dedup_sha", "__dedup_check", "__dedup_bytes"]


def _digests(df: DataFrame, text_col: str, names: list[str] = KEY) -> DataFrame:
    """Adds the digest of the normalised text, and an independent hash and the length that verify it, as ``names``."""
    text = one_space(text_of(text_col))
    norm = spare_name(df, "__dedup_norm")
    return (df.withColumn(norm, text)
            .withColumns({names[0]: F.unhex(F.sha2(F.col(norm).cast("binary"), 256)), names[1]: F.xxhash64(norm),
                          names[2]: F.octet_length(norm)}).drop(norm))


def merge_round(level: DataFrame, bits: int) -> DataFrame:
    """One round: 2^bits neighbouring runs become one.  Its partitions come out sorted by slice, run and digest.

    The smallest of a struct is kept by Spark's sorted aggregation, which needs this very order: the plan sorts once.
    """
    met = (level.withColumn("_run", F.shiftright("_run", bits)).repartition("_slice", "_run")
           .sortWithinPartitions("_slice", "_run", *KEY))
    return met.groupBy("_slice", "_run", *KEY).agg(F.min("_who").alias("_who"), F.sum("_n").alias("_n"))


def sorted_runs(rows: DataFrame) -> DataFrame:
    """The first level: the distinct digests of every run, sorted and combined before they leave their task."""
    slice_bits = max(SLICE_BITS, math.ceil(math.log2(max(1, rows.count()) / SLICE_ROWS)))
    lead = F.conv(F.hex(F.substring(KEY[0], 1, 4)), 16, 10).cast("long")
    return (rows.withColumn("_slice", F.shiftright(lead, 32 - min(32, slice_bits)))
            .groupBy("_slice", "_run", *KEY).agg(F.min("_who").alias("_who"), F.count(F.lit(1)).alias("_n")))


def merge_runs(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """The tree: ``rows`` has _run, _who (orderable) and KEY; one row per distinct text comes out.

    A digest counts as the same text only where hash and length agree too, at every level.
    """
    level = sorted_runs(rows)
    runs = (rows.agg(F.max("_run")).first()[0] or 0) + 1
    for _ in range(max(1, math.ceil(math.log(max(runs, 2), fan_in)))):
        level = merge_round(level, int(math.log2(fan_in)))
    return level.drop("_slice", "_run")


def _numbered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Identifier, run and digest of every row, written once: row numbers stay as they are."""
    rows = _digests(df.select(col(id_col).alias("_id"), col(text_col).alias("_text")), "_text").select(
        F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"),
                 F.monotonically_increasing_id().alias("row")).alias("_who"),
        F.spark_partition_id().alias("_run"), *KEY)
    return durable(rows, "digests")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became one space; null is the
    empty text.  The row with the smallest identifier stays; null identifiers come last; of rows that
    share identifier and text exactly one stays.  Other columns, whatever their names, are not touched.
    An empty table gives an empty result.
    """
    rows = _numbered(df, id_col, text_col)
    tree = durable(merge_runs(rows, fan_in).withColumnRenamed("_who", "_keep"), "digest-tree")
    line = max(1, rows.count() // HOT_GROUPS)
    hot, cold = tree.where(F.col("_n") > line), tree.where(F.col("_n") <= line)
    # Fewer than HOT_GROUPS groups can be above the line, so this broadcast is bounded at any size.
    first = rows.join(F.broadcast(hot), KEY, "left")
    rest = first.where(F.col("_keep").isNull()).select(*rows.columns).join(cold, KEY)
    both = first.where(F.col("_keep").isNotNull()).unionByName(rest)
    return both.select(
        F.col("_who.id").alias(id_col), F.col("_keep.id").alias("keep_id"), F.col("_n").alias("group_size"),
        (F.col("_who.row") == F.col("_keep.row")).alias("kept"), F.lower(F.hex(KEY[0])).alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """The rows of ``df`` that :func:`exact_dedup` keeps, with all their columns and nothing else."""
    rows = _numbered(df, id_col, text_col)
    tree = merge_runs(rows, fan_in)
    kept = durable(tree.select(F.col("_who.id").alias("_id"), *KEY), "kept")
    names = [spare_name(df, k) for k in KEY]
    whole = _digests(df, text_col, names)

    def same_as(left: DataFrame, right: DataFrame, id_name: str):
        same = col(id_col).eqNullSafe(right[id_name])
        for name, k in zip(names, KEY):
            same = same & (left[name] == right[k])
        return same

    out = whole.join(kept, same_as(whole, kept, "_id"), "left_semi")
    repeated = rows.groupBy("_who.id", *KEY).count().where("count > 1").drop("count")
    if not repeated.isEmpty():     # the same identifier and text twice: only these rows need one of them picked
        repeated = durable(repeated.join(kept, KEY, "left_semi"), "repeated")
        again = same_as(out, repeated, "id")
        out = out.join(repeated, again, "left_anti").unionByName(
            out.join(repeated, again, "left_semi").dropDuplicates([id_col, *names]))
    return out.drop(*names)
