"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling.

Each text is the sequence of its lines that hold a word.  Round 0 ranks all suffixes by their first
line, round r by their first 2**r lines: a pair of ranks, half a window apart, is sorted globally.
Suffixes with equal ranks form an LCP interval of that depth.  A suffix that is alone leaves; so does
one that runs into such a line.

A maximal repeated run counts by all of its words.  It is the union of its shortest parts that have
enough words: those that begin at each of its lines, and those that end there.  A part of m lines is
named by two ranks of the depth D <= m < 2 D, of its first and of its last D lines, so parts of any
length are told apart; every occurrence but the first in (document, line) order is a later copy.
Rounds go on while parts are longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext as bt
from .storage import broadcast_if_small, materialise, text_volume, with_unique_key

MIN_LINES, MIN_WORDS = 1, 30
TASK_BYTES = 16 << 20
"""Text whose lines make a task of the global sorts."""


def _filled_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines with a word: start, end, row, and words."""
    start, end, row = bt.line_spans(data, offsets)
    word_start, _, _ = bt.spans(data, offsets, bt.WORD)
    words = np.searchsorted(word_start, end) - np.searchsorted(word_start, start)
    filled = words > 0
    return start[filled], end[filled], row[filled], words[filled]


def _parts(words: np.ndarray, count: np.ndarray, min_lines: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shortest runs of lines with enough lines and words, for texts of ``count`` lines each: (first line, lines), distinct."""
    sums = np.concatenate([[0], np.cumsum(words)])
    line = np.arange(len(words))
    low = np.repeat(np.cumsum(count) - count, count)
    high = low + np.repeat(count, count)
    ahead = np.maximum(np.searchsorted(sums, sums[:-1] + min_words), line + min_lines)  # end of the part that begins here
    back = np.minimum(np.searchsorted(sums, sums[1:] - min_words, "right") - 1, line + 1 - min_lines)  # start of the part that ends here
    begins, ends = ahead <= high, back >= low
    start, end = np.concatenate([line[begins], back[ends]]), np.concatenate([ahead[begins], line[ends] + 1])
    both = np.unique(np.stack([start, end - start], axis=1), axis=0)
    return both[:, 0], both[:, 1]


def _lines(min_lines: int, min_words: int):
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, offsets in bt.pieces(batch, "text"):
                start, end, row, words = _filled_lines(data, offsets)
                count = np.bincount(row, minlength=piece.num_rows)
                index = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                first, size = _parts(words, count, min_lines, min_words)
                parts = pa.ListArray.from_arrays(pa.array(np.searchsorted(first, np.arange(len(row) + 1)), pa.int32()), pa.array(size, pa.int32()))
                columns = [pa.array(piece.column("k").to_numpy()[row]), pa.array(index), pa.array(count[row]), parts, pa.array(bt.span_hashes(data, start, end).view(np.int64)), pa.array(np.zeros(len(row), np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "i", "n", "parts", "r", "r2"])

    return lines


_ROW = "k long, i long, n long, parts array<int>"


def _number(rows: DataFrame, tasks: int) -> DataFrame:
    """``rows(k, i, n, parts, r, r2)`` ranked by (r, r2): r is now the global place of the group's first row.

    Rows alone in their group are left out.  A range sort on (r, r2, k, i) spreads equal pairs over
    tasks; each task numbers its rows as they stream by, and the driver, from one row per task,
    places tasks and the groups that cross their borders.
    """
    spark = rows.sparkSession

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen, group, at = TaskContext.get().partitionId(), 0, None, 0
        held: pa.RecordBatch | None = None
        names = ["k", "i", "n", "parts", "r", "r2"]

        def numbered(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal seen, group, at
            r, r2 = batch.column("r").to_numpy(), batch.column("r2").to_numpy()
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (r2[1:] != r2[:-1])
            new[0] = group != (r[0], r2[0])
            place = seen + np.arange(len(r))
            start = np.maximum.accumulate(np.where(new, place, -1))
            start[start < 0] = at
            many = ~new
            many[:-1] |= ~new[1:]
            seen, group, at = seen + len(r), (r[-1], r2[-1]), int(start[-1])
            columns = [batch.column(c) for c in names]
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(r), task)), pa.array(start), pa.array(many)], names=[*names, "task", "start", "many"])

        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.select(names)
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if batch.num_rows > 1:
                yield numbered(batch.slice(0, batch.num_rows - 1)) if not _splits(batch) else numbered_pair(batch, numbered)
            held = batch.slice(batch.num_rows - 1)
        if held is not None:
            yield numbered(held)

    def numbered_pair(batch: pa.RecordBatch, numbered) -> pa.RecordBatch:
        """All but the last row, where the last row's group begins before it: the row before is not alone."""
        out = numbered(batch.slice(0, batch.num_rows - 1))
        many = out.column("many").to_numpy(zero_copy_only=False).copy()
        many[-1] = True
        return out.set_column(out.num_columns - 1, "many", pa.array(many))

    order = ["r", "r2", "k", "i"]
    schema = f"{_ROW}, r long, r2 long, task long, start long, many boolean"
    ranked = materialise(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(local, schema), "ranks")
    ends = ranked.groupBy("task").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("r", "r2")).alias("low"), F.max(F.struct("r", "r2", "start")).alias("high")).orderBy("task").collect()
    meta, base, last, last_start = [], 0, None, 0
    for e, following in zip(ends, [*ends[1:], None]):
        low, high = tuple(e["low"]), tuple(e["high"])[:2]
        head = last_start if low == last else base
        tail = head if high == low else base + e["high"]["start"]
        meta.append((e["task"], base, head, low == last, following is not None and tuple(following["low"]) == high, *low, *high))
        base, last, last_start = base + e["rows"], high, tail
    kind = "task long, base long, head long, goes_on boolean, more boolean, low long, low2 long, high long, high2 long"
    joined = ranked.join(F.broadcast(spark.createDataFrame(meta, kind)), "task")
    in_head = (F.col("r") == F.col("low")) & (F.col("r2") == F.col("low2"))
    in_tail = (F.col("r") == F.col("high")) & (F.col("r2") == F.col("high2"))
    many = F.col("many") | in_head & F.col("goes_on") | in_tail & F.col("more")
    rank = F.when(in_head, F.col("head")).otherwise(F.col("base") + F.col("start"))
    return joined.where(many).select("k", "i", "n", "parts", (rank + 1).alias("r"))


def _splits(batch: pa.RecordBatch) -> bool:
    """Whether the last two rows of a batch belong to one group."""
    r, r2 = batch.column("r").to_numpy()[-2:], batch.column("r2").to_numpy()[-2:]
    return bool(r[0] == r[1] and r2[0] == r2[1])


def _pairs(ranks: DataFrame, shift: int) -> DataFrame:
    """Each suffix with the rank ``shift`` lines on: 0 past the end of the text; left out where that suffix is alone."""
    ahead = ranks.select("k", (F.col("i") - shift).alias("i"), F.col("r").alias("ahead"))
    joined = ranks.join(ahead, ["k", "i"], "left")
    r2 = F.when(F.col("i") + shift >= F.col("n"), F.lit(0)).otherwise(F.col("ahead"))
    return joined.withColumn("r2", r2).where("r2 is not null").select("k", "i", "n", "parts", "r", "r2")


def interval_levels(keyed: DataFrame, min_lines: int, min_words: int, tasks: int) -> Iterator[tuple[int, DataFrame]]:
    """``keyed(k, text)`` -> (depth, members of the LCP intervals of that depth), depth by depth while a part is longer.

    An interval's members are rows (k, i, n, parts, r); members too close to the end of their text to
    hold ``depth`` lines are equal suffixes that end there.
    """
    depth = 1
    ranks = materialise(_number(keyed.mapInArrow(_lines(min_lines, min_words), f"{_ROW}, r long, r2 long"), tasks), "level")
    while True:
        yield depth, ranks
        if not ranks.where(F.array_max("parts") >= 2 * depth).limit(1).count():
            return
        ranks = materialise(_number(_pairs(ranks, depth), tasks), "level")
        depth *= 2


def later_copies(keyed: DataFrame, min_lines: int, min_words: int, tasks: int) -> DataFrame:
    """Parts (k, i, lines) that have occurred before."""
    found: list[DataFrame] = []
    for depth, members in interval_levels(keyed, min_lines, min_words, tasks):
        mine = F.filter("parts", lambda m: (m >= depth) & (m < 2 * depth))
        parts = members.select("k", "i", "r", F.explode(mine).alias("lines"))
        tail = members.select("k", (F.col("i") + depth).alias("end"), F.col("r").alias("tail"))
        parts = parts.withColumn("end", F.col("i") + F.col("lines")).join(tail, ["k", "end"]).select("k", "i", "lines", "r", "tail")
        # The first of equal parts is a partial aggregate, so a part that a third of all texts share needs no task of its own.
        first = parts.groupBy("lines", "r", "tail").agg(F.min(F.struct("k", "i")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
        found.append(materialise(parts.join(first, ["lines", "r", "tail"]).where(F.struct("k", "i") > F.col("first")).select("k", "i", "lines"), "copies"))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every


def dedup_line_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """Texts without the later copies of repeated line runs: id, n_lines, n_deleted, n_runs, longest_run, text.

    Lines are split at newlines; those without a word take no part and stay.  A run repeats where
    the same lines follow each other elsewhere, in the same text or another; it counts from
    ``min_lines`` lines and ``min_words`` words in all.  The first in order of id (a generated key
    where ids repeat, are null or no whole numbers) and line stays.  n_lines counts lines with a
    word, n_runs the stretches of deleted ones, and longest_run the lines of the longest stretch.
    Null texts come back empty.  Further columns are ignored; an empty table has no rows.
    """
    keyed = with_unique_key(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "k")
    tasks = max(keyed.sparkSession.sparkContext.defaultParallelism, text_volume(keyed, "text") // TASK_BYTES)
    copies = later_copies(keyed.select("k", "text"), max(1, min_lines), max(1, min_words), tasks)
    gone = materialise(copies.groupBy("k").agg(F.sort_array(F.collect_list((F.col("i") * (1 << 32) + F.col("lines")))).alias("gone")), "gone")
    joined = keyed.join(broadcast_if_small(gone), "k", "left")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in bt.pieces(batch, "text"):
                start, end, row, _ = _filled_lines(data, offsets)
                count = np.bincount(row, minlength=part.num_rows)
                base = np.cumsum(count) - count
                texts, totals = [], np.zeros((3, part.num_rows), np.int64)
                for i, runs in enumerate(part.column("gone")):
                    text = data[offsets[i] : offsets[i + 1]].tobytes()
                    if runs.is_valid:
                        steps = np.zeros(count[i] + 1, np.int64)
                        first, lines = np.divmod(runs.values.to_numpy(), 1 << 32)
                        np.add.at(steps, first, 1)
                        np.add.at(steps, first + lines, -1)
                        drop = np.cumsum(steps[:-1]) > 0
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], drop, [0]]))).reshape(-1, 2)
                        totals[:, i] = drop.sum(), len(edges), (edges[:, 1] - edges[:, 0]).max()
                        text = _without(text, set((start[base[i] : base[i] + count[i]][drop] - offsets[i]).tolist()))
                    texts.append(text.decode())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(count, pa.int64()), *map(pa.array, totals), pa.array(texts, pa.string())], names=["id", "n_lines", "n_deleted", "n_runs", "longest_run", "text"])

    schema = T.StructType([keyed.schema["id"], *T.StructType.fromDDL("n_lines long, n_deleted long, n_runs long, longest_run long, text string").fields])
    return joined.select("id", "text", "gone").mapInArrow(rewrite, schema).withColumnRenamed("id", id_col)


def _without(text: bytes, starts: set[int]) -> bytes:
    """The text without the whole lines that begin at ``starts``."""
    out, at = [], 0
    for line in text.split(b"\n"):
        if at not in starts:
            out.append(line)
        at += len(line) + 1
    return b"\n".join(out)
