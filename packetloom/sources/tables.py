"""Reference tables: ports, fingerprints, blocklists, providers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import Window


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their number; the files are small, single lists."""
    return spark.read.text(path).withColumn("line_no", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))


def ports(spark: SparkSession, path: str) -> DataFrame:
    """service, port, line_no of a comma-separated list whose second column is the port."""
    c = F.split("value", ",")
    return _lines(spark, path).select(F.trim(c[0]).alias("service"), F.trim(F.get(c, F.lit(1))).try_cast("int").alias("port"), "line_no").where("port between 0 and 65535")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """key, label, line_no; header lines, repeated or not, are left out."""
    c = F.split("value", ",", 3)
    rows = _lines(spark, path).select(F.trim(c[0]).alias("key"), F.trim(F.get(c, F.lit(1))).alias("label"), "line_no")
    return rows.where("label is not null and key <> '' and lower(label) <> 'application'")


def blocklist(spark: SparkSession, path: str) -> DataFrame:
    """ip, label, confidence, threat_actor; whatever precedes the header is skipped."""
    c = F.split("value", ",")
    rows = _lines(spark, path).where(c[0].rlike(r"^\s*[0-9a-fA-F:.]+\s*$") & (F.size(c) >= 2))
    return rows.select(F.trim(c[0]).alias("ip"), F.trim(c[1]).alias("label"), F.trim(F.get(c, F.lit(2))).alias("confidence"), F.trim(F.get(c, F.lit(3))).alias("threat_actor"))


def learned_domains(spark: SparkSession, path: str) -> DataFrame:
    """domain, class, first_seen; lines of one column are domains, others must have three."""
    c = F.split("value", ",")
    return _lines(spark, path).where(F.size(c).isin(1, 3) & (F.trim("value") != "")).select(F.lower(F.trim(c[0])).alias("domain"), F.trim(F.get(c, F.lit(1))).alias("class"), F.trim(F.get(c, F.lit(2))).alias("first_seen"))
