"""Stages of a long plan as tables in the cluster's shared folder, and global numbers from them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Ranges for each partition where their bounds are known beforehand.
RANGES = 8
#: Rows of an Arrow batch unless the session sets a number of its own.
ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds: a batch of the default 10,000 rows is tens of MB in several forms."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines see.

    Only a local master may do without it; on a cluster a folder of one machine
    would lose every stage to the others, so that is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    root = "file://" + tempfile.mkdtemp(prefix="packetloom-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def table(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: what several branches need is computed once and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/packetloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, into: str, by: str, then: list, last=None, top: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Adds ``into``: 1, 2, ... by ``by`` and then ``then``, without a global sort.

    Rows are dealt by ranges of ``by``, sorted and written once with their place
    in their partition.  Counts and numbers are both read from those files, so
    they cannot disagree, however a partitioning is sampled or coalesced.  Only one
    count for each range goes to the driver.  The ranges come from a sample, or, if the
    greatest value ``top`` of a ``by`` from 0 on is given, are RANGES equal ones for each partition.
    Rows for which ``last`` holds come after the others of their partition and get no
    number.  Returns the numbered rows and all rows as written.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tail = F.lit(False) if last is None else F.coalesce(last, F.lit(True))
    df = df.withColumn("_last", tail)
    if top is None:
        dealt, part = df.repartitionByRange(parts, by), F.shiftright("_place", 33)
    else:
        width = max(1, -(-(top + 1) // (parts * RANGES)))
        part = F.floor(F.col(by) / width)
        dealt = df.repartition(parts, part)
    # A range is whole in one partition and its rows stand together there.
    placed = table(dealt.sortWithinPartitions("_last", by, *then).withColumn("_place", F.monotonically_increasing_id()), name)
    sizes = placed.where("not _last").groupBy(part.alias("_part")).agg(F.count("*").alias("n"), F.min("_place").alias("first")).orderBy("_part").collect()
    before, rows = 0, []
    for r in sizes:
        rows.append((r["_part"], before - r["first"]))
        before += r["n"]
    offsets = spark.createDataFrame(rows, "_part long, _before long")
    found = placed.where("not _last").withColumn("_part", part).join(F.broadcast(offsets), "_part", "left")
    missing = F.raise_error(F.lit("a range without a count"))
    number = F.coalesce("_before", missing.cast("long")) + F.col("_place") + 1
    return found.withColumn(into, number).drop("_part", "_before", "_place", "_last"), placed.drop("_place", "_last")
