"""Mixing sources to target weights by Pfair scheduling.

A source's documents are cut into blocks.  In the fluid mix every source that has blocks left runs at
its weight's part of the whole, so by virtual time v a source of n blocks and weight w has got
min(n, v w), and the sum over all sources is the slot reached.  Block j may run from (the slot of)
virtual time j / w, rounded down, and must run before (j + 1) / w, rounded up; earliest-deadline-first
over these windows keeps every source less than one block from the fluid mix at every slot.  Windows
are closed forms of whole numbers; slots follow one another, so one task lays them, a stretch of slots
at a time, and writes them as a table with a row a block.  What sources are there, with their sizes, is
known to the driver.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import broadcast_if_small, fresh_name, materialise, with_unique_key

BLOCK_DOCS = 16
PERIOD = 4096
FINEST = 1 << 40
MAX_BLOCKS: int | None = None
"""Only where it is set: the most blocks there may be besides one for each source; a larger corpus then has larger blocks."""
STRETCH = 1 << 18
"""Blocks that are laid together (or as many as there are sources, if those are more)."""
TASK_ROWS = 20_000


def apportion(weights: list[float], period: int) -> list[int]:
    """Whole shares of the period, one at least, in proportion to the weights (largest remainders)."""
    total = sum(weights)
    exact = [w / total * period for w in weights]
    shares = [max(1, int(x)) for x in exact]
    spare = period - sum(shares)
    for i in sorted(range(len(weights)), key=lambda i: (int(exact[i]) - exact[i], i))[: max(0, spare)]:
        shares[i] += 1
    if spare < 0:
        largest = shares.index(max(shares))
        shares[largest] = max(1, shares[largest] + spare)
    return shares


def earliest_deadline(release: np.ndarray, order: np.ndarray, first: int, end: int) -> np.ndarray:
    """Slots of blocks among ``first`` .. ``end`` - 1, in the given order by deadline among released ones; ``end`` for those that find none.

    A block doesn't move those of earlier deadlines, so each takes the first slot they leave from its release on.
    """
    last = end - first
    free = array("q", range(last + 1))  # a slot, or one nearer to the first free slot after it
    found = array("q")
    for t in np.clip(release[order] - first, 0, last).tolist():
        while free[t] != t:
            free[t] = t = free[free[t]]
        if t < last:
            free[t] = t + 1
        found.append(t)
    slots = np.empty(len(release), np.int64)
    slots[order] = np.frombuffer(found, np.int64) + first if len(found) else 0
    return slots


@dataclass
class Stretch:
    """A source's first block and its share of the plan's period."""

    first: int
    share: int


class Plan:
    """Slots of all blocks of all sources.

    ``period`` is the least sum of the whole shares that weights are rounded to; the sum is so large
    that over all blocks the rounding moves a source by far less than a block.
    """

    def __init__(self, docs: list[int], weights: list[float], block_docs: int, period: int = PERIOD):
        self.block_docs = block_docs
        self.docs = np.array(docs, np.int64)
        self.blocks = -(-self.docs // block_docs)
        self.shares = np.array(apportion(weights, max(period, 4 * len(docs), FINEST)) if docs else [], np.int64)
        self.period = int(self.shares.sum())
        self.stretches = [[Stretch(0, int(a))] for a in self.shares]
        # Products of blocks and shares that need more than 64 bits are made of Python's whole numbers.
        self.kind = np.int64 if self.period * (int(self.blocks.max(initial=0)) + 1) < 1 << 62 else object
        # Sources by the virtual time at which they end; before each end, the blocks of ended sources and the shares of the others.
        self.ends = np.argsort(self.blocks / self.shares, kind="stable")
        self.end_times = (self.blocks / self.shares)[self.ends]
        self.ended = np.concatenate([[0], np.cumsum(self.blocks[self.ends])]).astype(np.int64)
        self.running = self.period - np.concatenate([[0], np.cumsum(self.shares[self.ends])]).astype(np.int64)

    def _reached(self, source: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of virtual time block / share: whole part, and whether there is a rest."""
        at = np.searchsorted(self.end_times, block / self.shares[source])
        block, share = block.astype(self.kind), self.shares[source].astype(self.kind)
        while True:  # exact, where division isn't
            here = self.ends[np.minimum(at, len(self.ends) - 1)]
            late = (at < len(self.ends)) & (block * self.shares[here] > self.blocks[here] * share)
            before = self.ends[np.maximum(at - 1, 0)]
            early = (at > 0) & (block * self.shares[before] < self.blocks[before] * share)
            if not (late | early).any():
                break
            at = at + late - early
        reached = block * self.running[at]
        return self.ended[at] + (reached // share).astype(np.int64), reached % share > 0

    def windows(self, source: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Release and deadline of blocks: slots of the fluid mix between which it runs them."""
        release, _ = self._reached(source, block)
        whole, rest = self._reached(source, block + 1)
        return release, whole + rest

    def laid(self, stretch: int = STRETCH) -> Iterator[dict[str, np.ndarray]]:
        """All blocks in the order of their slots, about ``stretch`` at a time: source, block, release, deadline, slot, and position of the first document.

        Blocks of a virtual time are met first, and laid as far as none that isn't met may run.
        """
        slots, stretch, sources = int(self.blocks.sum()), max(stretch, len(self.blocks)), np.arange(len(self.blocks))
        at_ends = self.ended[:-1] + self.end_times * self.running[:-1]  # the slots at which sources end, about
        met = np.zeros(len(self.blocks), np.int64)
        source, block, release, deadline = (np.zeros(0, np.int64) for _ in range(4))
        first = target = position = 0
        while first < slots:
            target += stretch
            if target < slots:
                at = min(int(np.searchsorted(at_ends, target)), len(self.ends) - 1)
                time = (target - self.ended[at]) / max(1, self.running[at])
                upto = np.maximum(met, np.minimum(self.blocks, np.ceil(time * self.shares).astype(np.int64)))
            else:
                upto = self.blocks
            more = upto - met
            new = np.repeat(sources, more)
            number = np.arange(len(new)) - np.repeat(np.cumsum(more) - more - met, more)
            windows = self.windows(new, number)
            source, block, release, deadline = (np.concatenate(x) for x in zip((source, block, release, deadline), (new, number, *windows)))
            met, left = upto, np.flatnonzero(upto < self.blocks)
            end = int(self.windows(left, met[left])[0].min()) if len(left) else slots
            if end <= first:
                continue
            slot = earliest_deadline(release, np.lexsort((block, source, deadline)), first, end)
            order = np.argsort(slot, kind="stable")[: end - first]
            assert (slot[order] == np.arange(first, end)).all() and (slot[order] < deadline[order]).all()
            out = {c: x[order] for c, x in (("source", source), ("block", block), ("release", release), ("deadline", deadline), ("slot", slot))}
            rows = np.minimum(self.block_docs, self.docs[out["source"]] - out["block"] * self.block_docs)
            after = position + np.cumsum(rows)
            yield out | {"position": after - rows}
            first, position = end, int(after[-1])
            wait = slot >= end
            source, block, release, deadline = (x[wait] for x in (source, block, release, deadline))

    @cached_property
    def _whole(self) -> dict[str, np.ndarray]:
        """All blocks, by source and number."""
        parts = list(self.laid())
        whole = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
        order = np.lexsort((whole["block"], whole["source"]))
        return {c: x[order] for c, x in whole.items()}

    def place(self, source: int | np.ndarray, rank: np.ndarray) -> dict[str, np.ndarray]:
        """Block, release, deadline, slot and position of documents, by their sources and their ranks in those; for plans that fit the memory."""
        at = (np.cumsum(self.blocks) - self.blocks)[source] + rank // self.block_docs
        out = {c: self._whole[c][at] for c in ("block", "release", "deadline", "slot", "position")}
        return out | {"position": out["position"] + rank % self.block_docs}


_BLOCKS = {"code": "source", "block": "block", "release": "release", "deadline": "deadline", "slot": "slot", "first": "position"}


def _blocks(spark: SparkSession, plan: Plan) -> DataFrame:
    """The plan's blocks as a table."""

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        for part in plan.laid():
            yield pa.RecordBatch.from_pydict({c: part[name] for c, name in _BLOCKS.items()})

    return materialise(spark.range(1, numPartitions=1).mapInArrow(lay, ", ".join(f"{c} long" for c in _BLOCKS)), "blocks")


def _ranked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows(k, source)`` with each row's place within its source, by ``k``: a range sort, a count per task, and offsets.

    A source of any size spreads over as many tasks as its share of the rows.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, last, seen = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            codes = batch.column("source").dictionary_encode("encode")
            code = codes.indices.to_numpy(zero_copy_only=False)
            names = codes.dictionary.to_pylist()
            edges = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, int)
            local = np.arange(len(code))
            for a, b in zip(edges, [*edges[1:], len(code)]):
                name = names[code[a]]
                if name != last:
                    last, seen = name, 0
                local[a:b] += seen - a
                seen += int(b - a)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("source"), pa.array(np.full(len(code), task)), pa.array(local)], names=["k", "source", "task", "local"])

    kind = rows.schema["source"].dataType.simpleString()
    tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // (50 * TASK_ROWS))
    laid = rows.repartitionByRange(tasks, "source", "k").sortWithinPartitions("source", "k")
    numbered = materialise(laid.mapInArrow(number, f"k long, source {kind}, task long, local long"), "ranked")
    counts = numbered.groupBy("task", "source").agg(F.count(F.lit(1)).alias("n"))
    return numbered, counts


def mix_positions(rows: DataFrame, weights: Mapping[str | None, float] | None, alpha: float, block_docs: int, period: int, max_sources: int | None) -> DataFrame:
    """``rows(k, source)`` -> k, source, block, release, deadline, slot, position."""
    numbered, counts = _ranked(rows)
    found = counts.collect()  # one row a task, and one more for each source
    totals: dict[str | None, int] = {}
    offsets = []
    for r in sorted(found, key=lambda r: r["task"]):
        offsets.append((r["task"], r["source"], totals.get(r["source"], 0)))
        totals[r["source"]] = totals.get(r["source"], 0) + r["n"]
    if max_sources is not None and len(totals) > max_sources:
        raise ValueError(f"{len(totals)} sources; max_sources is {max_sources}")
    names = sorted(totals, key=lambda s: (s is None, str(s)))
    given = {s: float(weights[s]) for s in names if s in weights} if weights else {s: totals[s] ** alpha for s in names}
    if any(w <= 0 for w in given.values()):
        raise ValueError("weights must be positive")
    rest = min(given.values(), default=1.0)
    if MAX_BLOCKS:
        block_docs = max(block_docs, -(-sum(totals.values()) // MAX_BLOCKS))
    plan = Plan([totals[s] for s in names], [given.get(s, rest) for s in names], block_docs, period)
    at = {s: i for i, s in enumerate(names)}
    start = {(task, at[s]): n for task, s, n in offsets}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            task, local = batch.column("task").to_numpy(), batch.column("local").to_numpy()
            codes = batch.column("source").dictionary_encode("encode")
            code = np.array([at[s] for s in codes.dictionary.to_pylist()], np.int64)[codes.indices.to_numpy(zero_copy_only=False)] if len(task) else np.zeros(0, np.int64)
            pairs, which = np.unique(task * len(names) + code, return_inverse=True)
            first = np.array([start[divmod(p, len(names))] for p in pairs.tolist()], np.int64)
            block, rest = np.divmod(local + first[which], block_docs)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("source"), pa.array(code), pa.array(block), pa.array(rest)], names=["k", "source", "code", "block", "rest"])

    kind = rows.schema["source"].dataType.simpleString()
    ranked = numbered.mapInArrow(place, f"k long, source {kind}, code long, block long, rest long")
    joined = ranked.join(broadcast_if_small(_blocks(rows.sparkSession, plan)), ["code", "block"])
    return joined.select("k", "source", "block", "release", "deadline", "slot", (F.col("first") + F.col("rest")).alias("position"))


def mix_schedule(
    docs: DataFrame, *, weights: Mapping[str | None, float] | None = None, alpha: float = 0.5, id_col: str = "doc_id", source_col: str = "source",
    block_docs: int = BLOCK_DOCS, period: int = PERIOD, max_sources: int | None = None,
) -> DataFrame:
    """Where every document stands in the mix: id, source, block, release, deadline, slot, position.

    ``weights`` are the targets by source (a source without one gets the least of them); if not
    given they are the sources' sizes to the power ``alpha``.  Every row is placed, none twice:
    positions are 0..n-1.  Within a source rows follow their ids; rows that repeat an id stand next
    to each other, in any order; null ids go by a generated key.  A null source is a source.
    Texts aren't read.  There may be any number of sources; with ``max_sources``, more raise
    ValueError.  Blocks have ``block_docs`` documents, whatever the size of the table.  Ids
    may be of any atomic type; other columns are ignored; an empty table has no rows.
    """
    keyed = with_unique_key(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source")), "id", "k")
    placed = mix_positions(keyed.select("k", "source"), weights, alpha, block_docs, period, max_sources)
    kind = keyed.schema["id"].dataType
    if kind.typeName() not in ("byte", "short", "integer", "long") or keyed.where("id is null or id <> k").limit(1).count():
        placed = placed.join(keyed.select("k", "id"), "k")
    else:
        placed = placed.withColumn("id", F.col("k").cast(kind))
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "block", "release", "deadline", "slot", "position")


def mix_documents(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", weights: Mapping[str | None, float] | None = None, alpha: float = 0.5, block_docs: int = BLOCK_DOCS, period: int = PERIOD, max_sources: int | None = None) -> DataFrame:
    """All rows and columns of ``docs``, laid out in the order of the mix.

    Partitions follow each other and are sorted within, so files written from them hold the mix in
    the order of their numbers and rows.
    """
    key, place = fresh_name(docs, "mix_key"), fresh_name(docs, "mix_position")
    keyed = with_unique_key(docs, id_col, key)
    rows = keyed.select(F.col(key).alias("k"), F.col(source_col).cast("string").alias("source"))
    placed = mix_positions(rows, weights, alpha, block_docs, period, max_sources).select(F.col("k").alias(key), F.col("position").alias(place))
    placed = materialise(placed, "positions")
    joined = keyed.join(broadcast_if_small(placed), key)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), placed.count() // TASK_ROWS)
    return joined.repartitionByRange(tasks, F.col(place)).sortWithinPartitions(place).drop(key, place)
