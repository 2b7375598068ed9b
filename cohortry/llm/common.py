"""Helpers the operators share: the shared folder, written tables, plain text expressions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what the session names in spark.checkpoint.dir.

    A local session that names none gets a temporary folder; a cluster session must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/llm-{kind}-{uuid.uuid4().hex}"


def durable(df: DataFrame, kind: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage; the files outlive any executor.  Cleaning the folder is the cluster's policy.
    """
    spark = df.sparkSession
    path = fresh_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(name: str) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` or a function in it uses it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def one_space(text: Column) -> Column:
    """Each run of ASCII white space as one space.  Lone spaces, most runs by far, are not matched."""
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def held_out(name: str) -> Column:
    """crc32 of the id as text, modulo 5, is 0: rows that no model learns from.  A null id counts as empty text."""
    return F.crc32(F.coalesce(col(name).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def blocks(data: bytes, size: int = 1 << 22, blank: bytes = b" ") -> Iterator[bytes]:
    """``data`` in slices of about ``size`` bytes that end at a blank, so that no word is cut."""
    at = 0
    while len(data) - at > size:
        end = data.find(blank, at + size)
        if end < 0:
            break
        yield data[at:end]
        at = end + 1
    yield data[at:] if at else data


def spare_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, order: list[Column], name: str, parts: int) -> DataFrame:
    """``df`` with ``name``: 1, 2, 3... along ``order``, with no task that holds all rows.

    Rows are range-partitioned and sorted within partitions; a row's number is its place in its partition plus the
    rows of the partitions before.  Only one count per partition reaches the driver.
    """
    placed = durable(df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                     .withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}),
                     "numbered")
    before, at = [], 0
    for part, n in sorted(tuple(r) for r in placed.groupBy("__part").count().collect()):
        before.append((part, at))
        at += n
    offsets = df.sparkSession.createDataFrame(before, "__part int, __before long")
    return placed.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__at") + 1).drop(
        "__part", "__at", "__before")
