"""A training-data pipeline over ``documents``: each stage works on all that its predecessor kept.

Counted as part of the subpackage ``corpusrank.llm``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrank.llm import decontaminate, jaccard, pfair, resample, storage, token_store
from corpusrank.llm.queries import TOKENIZER, table

ORACLE_SQL = None
"""The resampling, the schedule and the tokenizer are beyond SQL; tests/llm/test_pipeline.py holds run() against a brute-force version."""


def _keep(docs: DataFrame, verdict: DataFrame, key: str) -> DataFrame:
    """The documents whose key is listed in ``verdict(key)``; a broadcast where the list is short, else a shuffle."""
    verdict = storage.materialise(verdict.select(key).distinct(), "kept")
    return docs.join(storage.broadcast_if_small(verdict), key, "left_semi").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps.

    Null and empty texts have no n-grams and go; rows that repeat are weighed each; a null id has no label.
    """
    return resample.keep_resampled(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the least id; documents without links stay.

    Where ids repeat or are null, rows are told apart by a generated key.  Null and empty texts are
    linked with nothing, so they stay.
    """
    storage.small_batches(spark)
    key = storage.fresh_name(docs, "near_key")
    keyed = storage.with_unique_key(docs, "doc_id", key)
    links = jaccard.jaccard_links(keyed, id_col=key)
    return _keep(keyed, links.where(F.col(key) == F.col("component_id")), key).drop(key)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark window; null and empty texts have none, and rows that repeat go or stay together."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order of the Pfair mix of their sources; a null source is a source, and repeated or null ids are placed each."""
    storage.small_batches(spark)
    return pfair.mix_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written in the order of the mix and read back.

    The order is that of the files and rows the mix was written to; documents that come from no
    files follow their ids.  Null and empty texts are their end id alone; rows that repeat are written each.
    """
    storage.small_batches(spark)
    try:
        order = [storage.fresh_name(docs, c) for c in ("file_number", "file_name", "row_number")]
        name = F.col("_metadata.file_name")
        docs = docs.select("*", *(c.alias(o) for c, o in zip((F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long"), name, F.col("_metadata.row_index")), order)))
    except AnalysisException:  # not read from files as they are
        order = ["doc_id"]
    store = token_store.write_store(docs, public_tokenizers.path(TOKENIZER), order_by=order)
    return token_store.read_store(spark, store)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each but the last written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = storage.new_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
