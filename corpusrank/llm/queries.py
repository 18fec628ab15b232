"""One query per operator of this subpackage, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sql
from .storage import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .preference import format_preferences, mismatched

    turns = table(spark, sf_dir, "conversations")
    return format_preferences(turns, mismatched(turns))


TOKENIZER = "word_bpe_49k.json"


def op2_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_store import read_store, write_store

    store = write_store(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return read_store(spark, store)


def op3_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .isolation import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_links

    return jaccard_links(table(spark, sf_dir, "documents"))


def op6_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import importance_resample

    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_runs import dedup_line_runs

    return dedup_line_runs(table(spark, sf_dir, "documents"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op9_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pfair import mix_schedule

    return mix_schedule(table(spark, sf_dir, "documents"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
