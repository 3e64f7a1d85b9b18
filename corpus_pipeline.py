"""The corpus pipeline: every stage works on all that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from packetloom.llm.bpe import decode, digest, encode
from packetloom.llm.decontamination import contained
from packetloom.llm.near_dedup import near_dedup
from packetloom.llm.quality_model import quality
from packetloom.llm.queries import _vocabulary
from packetloom.llm.shared import table, unused
from packetloom.llm.substring_dedup import substring_dedup
from packetloom.plans.stage import numbered


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality(docs, labels).where("accepted").select(*docs.columns)


def with_key(docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """docs, its (doc_id, text) for an operator, and the column of docs that is this doc_id.

    Where rows share a doc_id they are numbered by it and by their text and go on under that number, so
    each is a document of its own and what one loses does not befall the other.
    """
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs, docs.select("doc_id", "text"), "doc_id"
    name = unused(docs, "_row")
    rows = numbered(docs, "rows", name, "doc_id", ["text"])[0]
    return rows, rows.select(F.col(name).alias("doc_id"), "text"), name


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): the one of least doc_id.

    Of rows that share both doc_id and text one stays.
    """
    rows, texts, key = with_key(docs)
    if key != "doc_id":
        rows, texts, key = with_key(docs.dropDuplicates(["doc_id", "text"]))
    name = unused(rows, "_gone")
    gone = table(near_dedup(texts, words=5, share=80).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct(), "gone")
    return rows.join(gone, rows[key].cast("long").eqNullSafe(F.col(name)), "left_anti").select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without the words of repeated windows."""
    rows, texts, key = with_key(docs)
    name, left = unused(rows, "_id"), unused(rows, "_text")
    cut = substring_dedup(texts).where("n_removed > 0").select(F.col("doc_id").alias(name), F.col("kept").cast("string").alias(left))
    joined = rows.join(cut, rows[key].cast("long").eqNullSafe(F.col(name)), "left")
    new = {"text": F.coalesce(left, "text")} | ({"n_chars": F.when(F.col(left).isNull(), F.col("n_chars")).otherwise(F.length(left))} if "n_chars" in docs.columns else {})
    return joined.withColumns(new).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    rows, texts, key = with_key(docs)
    name = unused(rows, "_bad")
    found = contained(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = table(found.select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    return rows.join(bad, rows[key].cast("long").eqNullSafe(F.col(name)), "left_anti").select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    path = _vocabulary("word_bpe_49k.json")
    return digest(decode(encode(docs, path), path), path)


STAGES = [
    ("quality_classifier", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
