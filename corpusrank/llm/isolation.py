"""Quality rules: rule statistics of whole texts, and an isolation forest over them calibrated on labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext as bt
from .storage import materialise

WINDOW = 8
MAX_FIT_ROWS = 25_600
"""Most labelled rows that the trees are drawn from; the threshold uses all."""
TREES, SAMPLE = 256, 256
BINS = 4000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[list(b"!?")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_digits", "n_upper", "n_same", "n_distinct")


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The rule statistics of each text.

    Beside the base counts: lines with a word, signs ``!?``, digits, capitals A-Z, words equal to
    the one before, and distinct words.
    """
    rows = len(offsets) - 1
    starts, ends, owner = bt.spans(data, offsets, bt.WORD)
    words = bt.span_hashes(data, starts, ends)
    points = np.concatenate([[0], np.cumsum(bt.code_points(data))])
    count = lambda of, weights=None: np.bincount(of, weights, minlength=rows).astype(np.int64)

    def signs(table: np.ndarray) -> np.ndarray:
        seen = np.concatenate([[0], np.cumsum(table[data])])
        return seen[offsets[1:]] - seen[offsets[:-1]]

    line_start, line_end, line_row = bt.line_spans(data, offsets)
    filled = np.concatenate([[0], np.cumsum(bt.WORD[data])])
    filled = filled[line_end] > filled[line_start]
    line_start, line_end, line_row = line_start[filled], line_end[filled], line_row[filled]
    _, first = np.unique(bt.in_row(line_row, bt.span_hashes(data, line_start, line_end)), return_index=True)
    lines = count(line_row)

    grams, at = bt.windows(words, owner, WINDOW)
    _, inverse, times = np.unique(bt.in_row(owner[at], grams), return_inverse=True, return_counts=True)
    again = at[times[inverse] > 1]
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, again, 1)
    np.add.at(steps, again + WINDOW, -1)

    _, new = np.unique(bt.in_row(owner, words), return_index=True)
    same = np.flatnonzero((words[1:] == words[:-1]) & (owner[1:] == owner[:-1])) + 1
    return {
        "n_words": count(owner), "word_chars": count(owner, points[ends] - points[starts]), "n_symbols": signs(_SYMBOL), "n_dup_lines": lines - count(line_row[first]),
        "n_repeat_words": count(owner[np.cumsum(steps[:-1]) > 0]), "n_lines": lines, "n_shouts": signs(_SHOUT), "n_digits": signs(_DIGIT), "n_upper": signs(_UPPER), "n_same": count(owner[same]), "n_distinct": count(owner[new]),
    }


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Rates of the rules per word (or line, or character), damped so that a short text isn't odd by chance.

    Every counted rule has a rate, without floors; what is too much is left to the threshold.  Rates that ordinary
    texts show too are raised to a power, so that those texts lie close together.
    """
    s = {k: v.astype(float) for k, v in stats.items()}
    words, chars = s["n_words"] + 25, s["word_chars"] + 150
    return np.stack([
        np.sqrt(s["n_symbols"] / words), np.sqrt(s["n_shouts"] / words), np.sqrt(s["n_upper"] / chars), s["n_same"] / words,
        (s["n_dup_lines"] / (s["n_lines"] + 5)) ** 4, (s["n_digits"] / chars) ** 2, (s["n_repeat_words"] / words / 0.3) ** 4, (1 - (1 + np.log1p(s["n_distinct"])) / (1 + np.log1p(s["n_words"]))) ** 4, np.log((s["word_chars"] + 130) / words / 5.2) ** 2,
    ], axis=1)


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Trees as arrays: feature (-1 at a leaf), split, left child, and path length at leaves."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    path: np.ndarray
    sample: int

    @classmethod
    def fit(cls, points: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 5) -> IsolationForest:
        rng = np.random.default_rng(seed)
        sample = min(sample, len(points))
        depth_limit = int(np.ceil(np.log2(max(2, sample))))
        made = []
        for _ in range(trees):
            nodes: list[list] = [[-1, 0.0, 0, 0.0]]
            todo = [(0, points[rng.choice(len(points), sample, replace=False)], 0)]
            while todo:
                at, rows, depth = todo.pop()
                low, high = rows.min(axis=0), rows.max(axis=0)
                able = np.flatnonzero(high > low)
                if depth >= depth_limit or len(rows) < 2 or not len(able):
                    nodes[at][3] = depth + float(_mean_path(len(rows)))
                    continue
                f = int(rng.choice(able))
                split = rng.uniform(low[f], high[f])
                goes = rows[:, f] < split
                if not goes.any():
                    split, goes = high[f], rows[:, f] < high[f]
                nodes[at][:3] = [f, split, len(nodes)]
                nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
                todo += [(nodes[at][2], rows[goes], depth + 1), (nodes[at][2] + 1, rows[~goes], depth + 1)]
            made.append(nodes)
        width = max(map(len, made))
        table = np.zeros((trees, width, 4))
        table[:, :, 0] = -1
        for t, nodes in enumerate(made):
            table[t, : len(nodes)] = nodes
        return cls(table[:, :, 0].astype(np.int32), table[:, :, 1], table[:, :, 2].astype(np.int32), table[:, :, 3], sample)

    def score(self, points: np.ndarray) -> np.ndarray:
        """2 to the power of minus the mean path length over its mean for the sample: near 1 for anomalies."""
        total = np.zeros(len(points))
        row = np.arange(len(points))
        for feature, split, left, path in zip(self.feature, self.split, self.left, self.path):
            at = np.zeros(len(points), np.int64)
            while (inner := feature[at] >= 0).any():
                r = row[inner]
                here = at[r]
                at[r] = left[here] + (points[r, feature[here]] >= split[here])
            total += path[at]
        return 2.0 ** (-total / len(self.path) / max(float(_mean_path(self.sample)), 1e-9))


def _best_threshold(counts: np.ndarray) -> float:
    """Bins by label (bad, good) -> score from which a row is rejected: best balanced accuracy, middle of the best range."""
    if not counts.sum(axis=1).all():
        return np.inf
    bad, good = (np.concatenate([[0], np.cumsum(c)]) / c.sum() for c in counts)
    right = good - bad
    best = np.flatnonzero(right >= right.max() - 1e-12)
    run = best[: np.argmax(np.diff(np.concatenate([best, [len(right) * 2]])) > 1) + 1]
    return (run[0] + run[-1]) / 2 / BINS


def quality_rules(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", quality: str = "quality", max_fit_rows: int = MAX_FIT_ROWS,
) -> DataFrame:
    """Rule statistics, the base verdict and the forest's verdict for every row of ``docs``.

    base_failed: under 20 words, or over 30 % of words in repeated 8-word windows.  kept: not
    base_failed, and the anomaly score is under the threshold that best tells labels 0 and 1 apart
    among all labelled rows which pass the base rules.  Trees are drawn from at most
    ``max_fit_rows`` labelled rows.  Null and empty texts have no words, so they fail; rows that
    repeat get a row each; a null id matches no label.  A document with several labels counts as the
    worst.  Without labels of both kinds the forest rejects nothing.  Further columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in bt.pieces(batch, "text"):
                stats = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(stats[c], pa.int64()) for c in STATS)], names=["id", *STATS])

    measured = materialise(rows.mapInArrow(measure, f"id {kind}, " + ", ".join(f"{c} long" for c in STATS)), "rules")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    measured = measured.withColumn("base_failed", failed)
    worst = labels.where(F.col(label_id).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(label_id).alias("id")).agg((F.min(quality) >= 1).alias("good"))
    labelled = materialise(measured.where("not base_failed").join(worst, "id"), "labelled")
    share = min(1.0, max_fit_rows / max(1, labelled.count()))
    chance = F.shiftrightunsigned(F.xxhash64("id", *STATS), 11) / 2.0**53
    # Tasks send only the rows drawn, so what reaches the driver doesn't grow with their number.
    drawn = labelled.where(chance < share).select(*STATS).toPandas().sort_values(list(STATS)).head(max_fit_rows)
    forest, threshold = None, np.inf
    if len(drawn) > 1:
        forest = IsolationForest.fit(features({c: drawn[c].to_numpy() for c in STATS}))
        counts = np.zeros((2, BINS + 1))
        place = F.least(F.lit(BINS), F.floor(F.col("score") * BINS))
        for r in _scored(labelled, forest).groupBy(place.alias("bin"), "good").count().collect():
            counts[int(r["good"]), int(r["bin"])] += r["count"]
        threshold = float(_best_threshold(counts))
    scored = _scored(measured, forest)
    return scored.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("score") < F.lit(threshold))).alias("kept"), F.round("score", 9).alias("score"),
    )


def _scored(measured: DataFrame, forest: IsolationForest | None) -> DataFrame:
    if forest is None:
        return measured.withColumn("score", F.lit(0.0))
    kind = T.StructType([*measured.schema.fields, T.StructField("score", T.DoubleType())])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = forest.score(features({c: batch.column(c).to_numpy() for c in STATS}))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    return measured.mapInArrow(rate, kind)
