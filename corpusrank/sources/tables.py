"""SQL dumps, entity JSON, submissions and tagged text."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.data import PENN_TAGS
from ..functions.udfs import sql_insert_rows


def insert_rows(lines: DataFrame, table: str | None = None, column: str = "value") -> DataFrame:
    """(table, row) of all INSERT statements in a column of dump lines; other lines give none."""
    rows = lines.select(F.inline(sql_insert_rows(column)))
    return rows if table is None else rows.where(F.col("table") == table)


def read_sql_dump(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """Rows of a dump file; a gz file is one task to read, so its lines are spread before they are parsed."""
    return insert_rows(spark.read.text(path).repartition(spark.sparkContext.defaultParallelism), table)


def page_titles(rows: DataFrame) -> DataFrame:
    """(page_id, title) of namespace 0 from rows (12 fields) of the ``page`` table."""
    return rows.where("row[1] = '0'").select(F.col("row")[0].cast("long").alias("page_id"), F.col("row")[2].alias("title"))


def entities_from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Entities from lines of a JSON array: (id, title, props, json, ord).  Lines that are no object are passed over; ``[]`` in place of an object is an empty one."""
    text = F.regexp_replace(F.trim(column), r",$", "")
    kept = lines.select(text.alias("json")).where(F.col("json").startswith("{")).withColumn("ord", F.monotonically_increasing_id())
    parsed = kept.select("json", "ord", F.get_json_object("json", "$.id").alias("id"), F.get_json_object("json", "$.sitelinks.enwiki.title").alias("title"), F.from_json(F.get_json_object("json", "$.claims"), "map<string,string>").alias("claims"))
    return parsed.where("id is not null").select("id", "title", F.coalesce(F.map_keys("claims"), F.array().cast("array<string>")).alias("props"), "json", "ord")


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    return entities_from_json(spark.read.text(path))


_SUBMISSION = "url STRING, title STRING"


def submissions_from_json(lines: DataFrame, strict: bool = False, column: str = "value") -> DataFrame:
    """(url, title, file) of JSON lines with both.  With ``strict`` a bad line fails the job; else it is passed over."""
    parsed = lines.withColumn("s", F.from_json(F.col(column), _SUBMISSION, {"mode": "FAILFAST" if strict else "PERMISSIVE"}))
    return parsed.select("s.url", "s.title", "file").where("url is not null and title is not null")


def read_submissions(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Submissions from .zst files (any window) or whatever Spark reads as text."""
    if not path.endswith(".zst"):
        return submissions_from_json(spark.read.text(path).withColumn("file", F.input_file_name()), strict)

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        for files in batches:
            for name, content in zip(files["path"], files["content"]):
                reader = zstandard.ZstdDecompressor(max_window_size=2**31).stream_reader(content, read_across_frames=True)
                held: list[str] = []
                for line in io.TextIOWrapper(reader, "utf-8"):
                    held.append(line.rstrip("\n"))
                    if len(held) == 4096:
                        yield pd.DataFrame({"value": held, "file": name})
                        held = []
                yield pd.DataFrame({"value": held, "file": name}, dtype=object)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return submissions_from_json(files.mapInPandas(lines, "value string, file string"), strict)


_DROPPED = frozenset(["``", "''", "EOS"])
_COMMA = frozenset(["-LRB-", "-RRB-", ":"])
_TAG_IDS = {t: i for i, t in enumerate(PENN_TAGS)}


def tagged_sentences(paragraph: str) -> list[tuple[list[str], list[int]]]:
    """Sentences of a paragraph of ``word_TAG`` tokens: words in lower case, and tag numbers.

    A full stop ends a sentence; quotes are dropped, brackets and dashes count as commas; a token
    without a tag drops itself and the next one.
    """
    out: list[tuple[list[str], list[int]]] = []
    words: list[str] = []
    tags: list[int] = []
    skip = False
    for token in paragraph.split():
        word, found, tag = token.rpartition("_")
        if skip or not found:
            skip = not skip
        elif tag == ".":
            out.append((words, tags))
            words, tags = [], []
        elif tag not in _DROPPED:
            words.append(word.lower())
            tags.append(_TAG_IDS["," if tag in _COMMA else tag])
    return [*out, (words, tags)] if words else out


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """(words, tags) of a tagged corpus, paragraphs split at blank lines."""

    @F.pandas_udf("array<struct<words:array<string>,tags:array<int>>>")
    def cut(paragraphs: pd.Series) -> pd.Series:
        return pd.Series([[{"words": w, "tags": t} for w, t in tagged_sentences(p)] for p in paragraphs], dtype=object)

    return spark.read.option("lineSep", "\n\n").text(path).select(F.inline(cut("value")))


def unfinished(inputs: DataFrame, finished: DataFrame, month: str = "month") -> DataFrame:
    """Inputs whose month has no result yet."""
    return inputs.join(finished.select(month).distinct(), month, "left_anti")


def write_monthly(scores: DataFrame, path: str) -> None:
    scores.write.mode("append").partitionBy("month").parquet(path)
