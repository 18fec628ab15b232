"""The entity store: tables sorted for point and range lookups, and the queries on them."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs
from ..storage import materialise

_ID = re.compile(r"[A-Za-z][0-9]+")
PAGE_BYTES = 32 << 20


def lookup_tables(entities: DataFrame) -> dict[str, DataFrame]:
    """``entities(id, title, props, json, ord)`` as entity, entity_prop and entity_title tables, in any order: for queries that read them once, without a written store."""
    keyed = entities.withColumn("key", exprs.entity_key(F.col("id")))
    return {
        "entity": keyed.select("key", "id", "ord", "json"),
        "entity_prop": keyed.select(F.explode("props").alias("prop"), "key", "id").withColumn("prop_num", F.substr("prop", F.lit(2)).try_cast("bigint")),
        "entity_title": keyed.where("title is not null").groupBy("title").agg(F.max_by("key", "ord").alias("key")),
    }


def store_tables(entities: DataFrame) -> dict[str, DataFrame]:
    """:func:`lookup_tables` laid out for a written store: entity by key, entity_prop by property and entity_title by title."""
    order = {"entity": ["key"], "entity_prop": ["prop_num", "key"], "entity_title": ["title"]}
    return {name: table.repartitionByRange(*order[name]).sortWithinPartitions(*order[name]) for name, table in lookup_tables(entities).items()}


def write_store(entities: DataFrame, path: str) -> None:
    for name, table in store_tables(entities).items():
        table.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")


def read_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("entity", "entity_prop", "entity_title")}


def packed_key(entity_id: str) -> int:
    if not _ID.fullmatch(entity_id):
        raise ValueError("malformed IDs in args")
    return ord(entity_id[0]) << 56 | int(entity_id[1:])


def by_id(store: dict[str, DataFrame], ids: list[str]) -> DataFrame:
    """Entities of these ids, each once."""
    return store["entity"].where(F.col("key").isin([packed_key(i) for i in ids])).orderBy("ord")


def id_range(store: dict[str, DataFrame], first: str, last: str, inclusive: bool = False) -> DataFrame:
    """Entities from ``first`` to ``last``.  The largest key up to ``last`` is left out, as established, unless ``inclusive``."""
    low, high = packed_key(first), packed_key(last)
    if high < low:
        raise ValueError("malformed IDs in args")
    inside = store["entity"].where(F.col("key").between(low, high))
    if inclusive:
        return inside.orderBy("key")
    inside = materialise(inside, "range")  # the largest key up to ``last`` is one of these, if there are any
    largest = inside.agg(F.max("key").alias("largest"))
    return inside.crossJoin(F.broadcast(largest)).where("key < largest").drop("largest").orderBy("key")


def by_title(store: dict[str, DataFrame], titles: list[str]) -> DataFrame:
    """Entities of these titles; the last of several with one title; unknown titles are ignored."""
    keys = store["entity_title"].where(F.col("title").isin(titles)).select("key").distinct()
    return store["entity"].join(keys, "key", "left_semi").orderBy("ord")


def has_prop(store: dict[str, DataFrame], props: list[str]) -> DataFrame:
    """Entities with any of these properties; the letter of a property doesn't matter."""
    numbers = [packed_key(p) & ((1 << 56) - 1) for p in props]
    keys = store["entity_prop"].where(F.col("prop_num").isin(numbers)).select("key").distinct()
    return store["entity"].join(keys, "key", "left_semi").orderBy("ord")


def prop_cardinality(store: dict[str, DataFrame]) -> DataFrame:
    """(prop_num, n) for every number from 0 to the largest, those without entities too."""
    counts = store["entity_prop"].groupBy("prop_num").agg(F.count(F.lit(1)).alias("n"))
    every = counts.agg(F.max("prop_num").alias("m")).where("m is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("prop_num"))
    return every.join(counts, "prop_num", "left").select("prop_num", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def query(store: dict[str, DataFrame], request: str | bytes) -> DataFrame:
    """A JSON request ``{"type": Id | IdRange | Title | HasProp, "args": [...]}``."""
    if not isinstance(request, str):
        raise ValueError("expected text message")
    try:
        asked = json.loads(request)
        kind, args = asked["type"], asked["args"]
    except (ValueError, KeyError, TypeError):
        raise ValueError("could not parse query") from None
    if not isinstance(args, list) or not all(isinstance(a, str) for a in args):
        raise ValueError("could not parse query")
    if kind == "IdRange" and len(args) == 2:
        return id_range(store, *args)
    known = {"Id": by_id, "Title": by_title, "HasProp": has_prop}
    if kind not in known:
        raise ValueError("could not parse query")
    return known[kind](store, args)


def response_pages(found: DataFrame, page_bytes: int = PAGE_BYTES) -> Iterator[str]:
    """The answer's JSON lines in pages; all but the last end with ``{"has_next": 1}``; an empty answer is one empty page."""
    held: list[str] = []
    size = 0
    for row in found.select("json").toLocalIterator():
        if size >= page_bytes:
            yield "\n".join([*held, '{"has_next": 1}'])
            held, size = [], 0
        held.append(row["json"])
        size += len(row["json"]) + 1
    yield "\n".join(held)
