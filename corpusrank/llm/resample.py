"""Importance resampling as a quality classifier: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext as bt
from .storage import broadcast_if_small, fresh_name, materialise

BITS = 18
"""log2 of the number of n-gram buckets; both models have this size whatever the corpus."""
BLOCK = 4096
TEMPERATURE = 0.01
"""In nats of the mean ratio.  Good and bad labelled texts of prose are some 0.1 apart, so the noise settles the order near the cut and leaves clean text alone."""
BINS_PER_NAT = 500
LIMIT = 20


def _buckets(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs, and the row of each."""
    starts, ends, rows = bt.spans(data, offsets, bt.WORD)
    words = bt.span_hashes(data, starts, ends, fold_case=True)
    pairs, first = bt.windows(words, rows, 2)
    return (np.concatenate([words, pairs]) >> bt.U64(64 - bits)).astype(np.int64), np.concatenate([rows, rows[first]])


def _counts(docs: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts of all rows of ``docs(text, target)``, and of those with target true.

    Each task sends its counts in blocks; they are summed in two levels, so that no task receives
    more than a bounded number of them.
    """
    size = 1 << bits

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both = np.zeros((2, size), np.int64)
        for batch in batches:
            for part, data, offsets in bt.pieces(batch, "text"):
                bucket, rows = _buckets(data, offsets, bits)
                target = part.column("target").fill_null(False).to_numpy(zero_copy_only=False)
                both[0] += np.bincount(bucket, minlength=size)
                both[1] += np.bincount(bucket[target[rows]], minlength=size)
        blocks = both.reshape(2, -1, min(BLOCK, size)).transpose(1, 0, 2)
        salt = TaskContext.get().partitionId() % 1024
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(blocks)), pa.int32()), "salt": pa.array([salt] * len(blocks), pa.int32()), "c": [b.tobytes() for b in blocks]})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_py(), np.int64) for v in table.column("c"))
        return pa.table({"block": table.column("block")[:1], "salt": pa.array([0], pa.int32()), "c": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, salt int, c binary"
    sent = docs.mapInArrow(tally, schema).groupBy("block", "salt").applyInArrow(add, schema)
    rows = sent.groupBy("block").applyInArrow(add, schema).collect()
    counts = np.zeros((2, size), np.int64)
    for r in rows:
        counts[:, r["block"] * min(BLOCK, size) :][:, : min(BLOCK, size)] = np.frombuffer(r["c"], np.int64).reshape(2, -1)
    return counts[0], counts[1]


@dataclass
class Resampler:
    """Both models' bucket counts, and what the selection needs."""

    raw: np.ndarray
    target: np.ndarray
    threshold: float
    temperature: float
    seed: int
    cut: float = -math.inf

    def mean_ratios(self, data: np.ndarray, offsets: np.ndarray, in_target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean log ratio per n-gram (nan without any) and number of n-grams of each row.

        A text of the target is rated by the target model without that text, so that labelled and
        other texts are rated alike.
        """
        rows, size = len(offsets) - 1, len(self.raw)
        bucket, of_row = _buckets(data, offsets, size.bit_length() - 1)
        n = np.bincount(of_row, minlength=rows)
        total = np.zeros(rows)
        if self.target.any():
            raw = np.log((self.raw + 1.0) / (self.raw.sum() + size))
            ratio = np.log((self.target + 1.0) / (self.target.sum() + size)) - raw
            own = in_target[of_row]
            total = np.bincount(of_row[~own], weights=ratio[bucket[~own]], minlength=rows)
            key, count = np.unique(of_row[own] * size + bucket[own], return_counts=True)
            r, b = key // size, key % size
            rest = np.log(np.maximum(self.target[b] - count, 0) + 1.0) - np.log(np.maximum(self.target.sum() - n[r], 0) + size) - raw[b]
            total += np.bincount(r, weights=count * rest, minlength=rows)
        return np.where(n > 0, total / np.maximum(n, 1), np.nan), n


def score(docs: DataFrame, model: Resampler, text_col: str, target: str, mean: str, n_grams: str) -> DataFrame:
    """``docs`` with the columns ``mean`` (null without n-grams) and ``n_grams``; nothing is shuffled. ``target`` marks texts of the target."""
    kind = T.StructType(docs.schema.fields + [T.StructField(mean, T.DoubleType()), T.StructField(n_grams, T.LongType())])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in bt.pieces(batch, text_col):
                value, n = model.mean_ratios(data, offsets, part.column(target).fill_null(False).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value, mask=n == 0), pa.array(n, pa.int64())], names=[*part.schema.names, mean, n_grams])

    return docs.mapInArrow(rate, kind)


def gumbel_key(model: Resampler, id_col: str, mean: str, n_grams: str) -> F.Column:
    """The mean ratio over the temperature with Gumbel noise drawn from the id and the number of n-grams: the k largest are a sample without replacement, weighted by exp(mean / temperature)."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(n_grams), F.lit(model.seed)), 11).cast("double") + 0.5) / 2.0**53
    return F.col(mean) / model.temperature - F.log(-F.log(uniform))


def inclusion(model: Resampler, mean: str) -> F.Column:
    """How probable it is that a row's noise lifts it over the cut; its inverse is the row's weight in estimates from the sample."""
    if math.isinf(model.cut):
        return F.lit(1.0 if model.cut < 0 else 0.0)
    return 1.0 - F.exp(-F.exp(F.col(mean) / model.temperature - model.cut))


def effective_size(sample: DataFrame, column: str = "inclusion") -> float:
    """Kish's effective size of a sample whose rows weigh 1 / inclusion."""
    w = 1 / F.col(column)
    one, two = sample.where(F.col(column) > 0).agg(F.sum(w), F.sum(w * w)).first()
    return one * one / two if two else 0.0


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest value of the column ``key``: radix selection, 16 bits of the value a pass.

    A pass brings at most 65,536 counts to the driver.  Nulls don't count; k beyond the number of
    values gives minus infinity.
    """
    if k <= 0:
        return math.inf

    @F.pandas_udf("long")
    def ordered(values: pd.Series) -> pd.Series:
        raw = values.to_numpy(np.float64).view(np.int64)
        return pd.Series(np.where(raw < 0, raw ^ np.int64(0x7FFFFFFFFFFFFFFF), raw))

    # Written: a filter on what the function gives would run it again in the same task, on a second Python worker that stays.
    left = materialise(keys.where("key is not null").select(ordered("key").alias("o")), "ordered")
    found = None
    for shift in (48, 32, 16, 0):
        rows = left if found is None else left.where(F.shiftright("o", shift + 16) == found)
        counts = rows.groupBy(F.shiftright("o", shift).alias("top")).count().orderBy(F.desc("top")).collect()
        for r in counts:
            if r["count"] >= k:
                break
            k -= r["count"]
        else:
            return -math.inf
        found = r["top"]
    return struct.unpack("<d", struct.pack("<q", found if found >= 0 else found ^ 0x7FFFFFFFFFFFFFFF))[0]


def _threshold(labelled: DataFrame) -> float:
    """Where accuracy, balanced over both labels, is best among all labelled rows; the middle of the best range.

    The rows reach the driver as counts by bin.
    """
    place = F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("mean"))) * BINS_PER_NAT)
    rows = labelled.where("mean is not null").groupBy(place.alias("bin"), "good").count().collect()
    size = 2 * LIMIT * BINS_PER_NAT + 1
    counts = np.zeros((2, size))
    for r in rows:
        counts[int(r["good"]), int(r["bin"]) + LIMIT * BINS_PER_NAT] += r["count"]
    if not counts.sum(axis=1).all():
        return -math.inf
    bad, good = (np.concatenate([[0], np.cumsum(c)]) / c.sum() for c in counts)
    right = bad - good
    best = np.flatnonzero(right >= right.max() - 1e-12)
    run = best[: np.argmax(np.diff(np.concatenate([best, [size * 2]])) > 1) + 1]
    return (run[0] + run[-1]) / 2 / BINS_PER_NAT - LIMIT


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", quality: str = "quality",
    bits: int = BITS, share: float | None = None, temperature: float = TEMPERATURE, seed: int = 17,
) -> tuple[Resampler, DataFrame, DataFrame]:
    """Fit both models on all rows, calibrate the threshold on all labels, and find the cut of the top k.

    The target is the text of documents labelled 1 (a document with several labels counts as the
    worst), raw text is all.  k is ``share`` of all documents; if that isn't given, the number of
    those whose mean log ratio reaches the threshold.  Which k are drawn is up to the noise: a
    document well over the cut is nearly sure to be among them, one near it may or may not.  Returns the model, the written scores ``(id, mean, n_grams, key)`` of all rows, and
    the ids of the target ``(id, target)``, with a broadcast hint where they are few.
    Without labels of both kinds every document with n-grams stays.
    """
    worst = labels.where(F.col(label_id).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(label_id).alias("id")).agg((F.min(quality) >= 1).alias("good"))
    worst = materialise(worst, "labels")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    good = worst.where("good").select("id", F.lit(True).alias("target"))
    good = broadcast_if_small(good)
    marked = rows.join(good, "id", "left")
    model = Resampler(*_counts(marked.select("text", "target"), bits), -math.inf, temperature, seed)
    scored = score(marked, model, "text", "target", "mean", "n_grams").drop("text", "target")
    scores = materialise(scored.withColumn("key", gumbel_key(model, "id", "mean", "n_grams")), "scores")
    model.threshold = _threshold(scores.join(worst, "id"))
    k = scores.where(F.col("mean") >= F.lit(model.threshold)).count() if share is None else round(share * scores.count())
    model.cut = kth_largest(scores, k)
    return model, scores, good


def importance_resample(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Every row of ``docs`` with its weight and verdict: id, n_grams, log_weight, inclusion, kept.

    log_weight is the mean log ratio per n-gram, inclusion the probability of being kept at this cut
    (both null where a text has no n-grams: such rows are not kept).  Rows that repeat have equal
    keys, so they are kept or not together; keys equal to the k-th are all kept.  The noise of null
    ids follows their numbers of n-grams alone.  Further columns are ignored; an empty table has no rows.
    """
    model, scores, _ = fit(docs, labels, **options)
    kept = F.coalesce(F.col("key") >= F.lit(model.cut), F.lit(False))
    return scores.select(F.col("id").alias(options.get("id_col", "doc_id")), "n_grams", F.round("mean", 9).alias("log_weight"), F.when(F.col("mean").isNotNull(), F.round(inclusion(model, "mean"), 9)).alias("inclusion"), kept.alias("kept"))


def keep_resampled(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that the resampling keeps, with all their columns: scored again where they are read, not joined."""
    model, _, good = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    own, target, mean, grams = (fresh_name(docs, c) for c in ("label_id", "is_target", "mean_ratio", "ratio_grams"))
    marked = docs.join(good.select(F.col("id").alias(own), F.col("target").alias(target)), F.col(id_col) == F.col(own), "left").drop(own)
    scored = score(marked, model, text_col, target, mean, grams)
    return scored.where(gumbel_key(model, id_col, mean, grams) >= F.lit(model.cut)).drop(target, mean, grams)
