"""The registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark, sf_dir):
    from .suffix_dedup import digest, suffix_dedup

    return digest(suffix_dedup(_documents(spark, sf_dir)))


def op2_bpe(spark, sf_dir):
    from .bpe import decode, digest, encode

    path = _vocabulary("word_bpe_49k.json")
    return digest(decode(encode(_documents(spark, sf_dir), path), path), path)


def op3_substring_dedup(spark, sf_dir):
    from .substring_dedup import digest, substring_dedup

    return digest(substring_dedup(_documents(spark, sf_dir)))


def op4_near_dedup(spark, sf_dir):
    from .near_dedup import near_dedup

    return near_dedup(_documents(spark, sf_dir))


def op5_token_output(spark, sf_dir):
    from .token_output import digest, token_output

    return digest(token_output(_documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json")))


def op6_url_filter(spark, sf_dir):
    from .url_filter import url_filter

    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_quality_rules(spark, sf_dir):
    from .quality_rules import quality_rules

    return quality_rules(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_token_counts(spark, sf_dir):
    from .token_count import token_counts

    return token_counts(_documents(spark, sf_dir), _vocabulary("piece_bpe_32k.model"))


def op9_quality_classifier(spark, sf_dir):
    from .quality_model import quality

    out = quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "lang", "perplexity", "accepted")


def op10_decontamination(spark, sf_dir):
    from .decontamination import contained

    return contained(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    each = (op1_suffix_dedup, op2_bpe, op3_substring_dedup, op4_near_dedup, op5_token_output, op6_url_filter, op7_quality_rules, op8_token_counts, op9_quality_classifier, op10_decontamination, pipeline)
    return {f.__name__: f for f in each}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return dict(SQL)
