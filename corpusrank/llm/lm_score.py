"""LM scoring: corpus-wide counts, a GRU trained by parameter averaging, and log-likelihoods of whole documents.

Words go by 64-bit hashes of their lower-cased bytes.  The recurrent model knows the end, the most
frequent words, and bins of all other words; a word's probability within its bin comes from its
count, so the model is proper over all words.  How many words it knows grows with the corpus.
Counts of rare words are never gathered: a chunk of documents sends them to the part of the
vocabulary that holds them, and gets sums back.

Texts are read twice, to count and to encode; training and scoring work on the packed tokens.
Documents are dealt to training shards by a hash of their id and words, and stand in its order, so
the model doesn't depend on how the table is laid out in files or tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext as bt
from .gru import Model, Shape, Trainer, initial, score
from .jaccard import _arrays, _each, _packed, _split
from .storage import materialise, text_volume

U64 = np.uint64
HEAD = 65_536
"""Most frequent words whose counts every task knows (as many as the recurrent model has entries, if those are more)."""
ROUNDS = 4
CHUNK_WORDS = 400_000
PIECE_TOKENS = 2_000_000
"""Tokens that are trained on or scored together: many documents a lane, so that lanes end at about the same step."""
SHARD_TOKENS = 500_000
"""Tokens of a training shard in a corpus of one shard; shards grow with the fourth root of the corpus."""
PARAMETER_BLOCK = 16_384


def model_shape(tokens: int, hidden: int) -> Shape:
    """Entries by the fifth root of the training tokens: 800 for a hundred thousand, 3,200 for a hundred million, 40,000 for thirty trillion; classes of 64 words or about as many as there are classes."""
    entries = 80 * max(4, math.ceil(tokens**0.2))
    size = 1 << max(6, round(math.log2(entries) / 2))
    return Shape(-(-entries // size) * size, hidden, size)


def _look_table() -> np.ndarray:
    """Looks by last byte, the byte before it, and whether the word has one byte, two to eight, or more."""
    low = bt._VALUES[True] >> U64(40)
    last, before = low[None, :], low[:, None]
    of = lambda before, longer: bt.mix(last * U64(31) + before + U64(7) * U64(longer)) >> U64(48)
    return np.concatenate([np.broadcast_to(of(U64(0), 0), (256, 256)), of(before, 0), of(before, 1)]).astype(np.uint16).ravel()


_LOOKS = _look_table()


def _looks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number by how a word looks: its last two bytes, and whether it is longer than eight bytes; bins are cut from it."""
    size = ends - starts
    at = (size > 1).astype(np.int32)
    at += size > 8
    at <<= 8
    at += data[np.maximum(ends - 2, 0)]
    at <<= 8
    at += data[ends - 1]
    return _LOOKS[at]


class Words:
    """Words of a piece of texts: hash, look, and how many each text has."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, self.row = bt.spans(data, offsets, bt.WORD)
        self.hash = bt.span_hashes(data, starts, ends, fold_case=True)
        self.look = _looks(data, starts, ends)
        self.count = np.bincount(self.row, minlength=len(offsets) - 1)


def _tally(h: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in ascending order, the place of one of each, and how often (or with what sum of weights) they occur."""
    order = np.argsort(h)
    ordered = h[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(h) else np.zeros(0, np.int64)
    if weights is None:
        return ordered[first], order[first], np.diff(np.concatenate([first, [len(h)]]))
    return ordered[first], order[first], np.add.reduceat(weights[order], first) if len(h) else weights


_COUNT_SCHEMA = pa.schema([("bucket", pa.int32()), ("h", pa.binary()), ("c", pa.binary()), ("look", pa.binary()), ("docs", pa.int64())])
_COUNT = "bucket int, h binary, c binary, look binary, docs long"


def _send_counts(buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        words = docs = 0

        def rows() -> pa.RecordBatch:
            h, looks = (np.concatenate(x) for x in zip(*held))
            unique, first, count = _tally(h)
            bounds, looks = _split(unique, buckets), looks[first]
            out = [
                {"bucket": int(b), "h": unique[s].tobytes(), "c": count[s].tobytes(), "look": looks[s].tobytes(), "docs": 0}
                for b in np.flatnonzero(np.diff(bounds)) for s in [slice(bounds[b], bounds[b + 1])]
            ]
            out.append({"bucket": 0, "h": b"", "c": b"", "look": b"", "docs": docs})
            return _packed(out, _COUNT_SCHEMA)

        for batch in batches:
            for part, data, offsets in bt.pieces(batch, "text"):
                w = Words(data, offsets)
                held.append((w.hash, w.look))
                words += len(w.hash)
                docs += part.num_rows
                if words >= 2 * CHUNK_WORDS:
                    yield rows()
                    held, words, docs = [], 0, 0
        if docs:
            yield rows()

    return send


def _add_counts(table: pa.Table) -> pa.Table:
    h, c, looks = (np.concatenate([np.zeros(0, k), *_arrays(table.column(x), k)]) for x, k in (("h", "u8"), ("c", "i8"), ("look", "u2")))
    unique, first, count = _tally(h, c)
    docs = int(np.sum(table.column("docs").to_numpy()))
    return pa.Table.from_batches([_packed([{"bucket": table.column("bucket")[0].as_py(), "h": unique.tobytes(), "c": count.tobytes(), "look": looks[first].tobytes(), "docs": docs}], _COUNT_SCHEMA)])


def _octaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words have about the same count: steps of a 16th octave."""
    for batch in batches:
        for row in batch.to_pylist():
            step, n = np.unique(np.floor(np.log2(np.frombuffer(row["c"], np.int64)) * 16).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_pydict({"step": step, "n": n})


def _most_frequent(counts: DataFrame, most: int) -> list:
    """The ``most`` most frequent words.  Tasks send only words of the steps that hold them, so what reaches the driver doesn't grow with their number."""
    steps = counts.mapInArrow(_octaves, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).orderBy(F.desc("step")).collect()
    seen, cut = 0, 0
    for r in steps:
        seen, cut = seen + r["n"], r["step"]
        if seen >= most:
            break

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, c, look = np.frombuffer(row["h"], np.int64), np.frombuffer(row["c"], np.int64), np.frombuffer(row["look"], np.uint16)
                able = np.flatnonzero(np.floor(np.log2(c) * 16) >= cut)
                able = able[np.lexsort((h[able], -c[able]))][:most]
                yield pa.RecordBatch.from_pydict({"h": h[able], "c": c[able], "look": look[able].astype(np.int32)})

    return counts.mapInArrow(top, "h long, c long, look int").orderBy(F.desc("c"), "h").limit(most).collect()


def _totals(bins: int):
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c, b = np.frombuffer(row["c"], np.int64), np.frombuffer(row["look"], np.uint16) % bins
                yield pa.RecordBatch.from_pydict({"bin": np.arange(bins, dtype=np.int32), "n": np.bincount(b, weights=c, minlength=bins).astype(np.int64), "v": np.bincount(b, minlength=bins)})

    return total


class Vocabulary:
    """What every task knows: counts of the head, totals, and the recurrent model's entries.

    Entry 0 is the end, the rest of its class are bins of words without an entry, then come the most frequent words.
    """

    def __init__(self, head: list, totals: list, docs: int, shape: Shape):
        order = np.argsort(np.array([r["h"] for r in head], np.int64).view(U64)) if head else np.zeros(0, np.int64)
        self.h = np.array([r["h"] for r in head], np.int64).view(U64)[order]
        self.c = np.array([r["c"] for r in head], np.int64)[order]
        self.first, self.bins = shape.class_size, shape.class_size - 1
        entry = np.full(len(head), -1, np.int64)
        known = min(len(head), shape.words - self.first)
        entry[:known] = self.first + np.arange(known)
        self.entry = entry[order]
        # A table of eight times as many places, in which a hash stands at its share of the way or in the next free place after it.
        self.shift = 64 - max(8, (8 * len(head)).bit_length())
        place = (self.h >> U64(self.shift)).astype(np.int64)
        stands = np.arange(len(place)) + np.maximum.accumulate(place - np.arange(len(place))) if head else place
        self.reach = int((stands - place).max()) + 1 if head else 0
        self.table = np.full((1 << (64 - self.shift)) + self.reach + 1, -1, np.int32)
        self.table[stands] = np.arange(len(place))
        # Of each hash of the head, and at last of any other word: entry, and log10(count + 1).
        self.entry_of, self.log_of = np.append(self.entry, -1), np.append(np.log10(self.c + 1.0), 0.0)
        self.docs = docs
        n, v = np.zeros(self.bins, np.int64), np.zeros(self.bins, np.int64)
        for r in totals:
            n[r["bin"]], v[r["bin"]] = r["n"], r["v"]
        self.tokens = int(n.sum()) + docs
        self.types = int(v.sum()) + (docs > 0)
        for r in head[:known]:
            n[r["look"] % self.bins] -= r["c"]
            v[r["look"] % self.bins] -= 1
        self.in_bin = np.log10(n + v + 1.0)
        self.counts = np.zeros(shape.words)
        self.counts[0] = docs
        self.counts[1 : 1 + self.bins] = n
        self.counts[self.first : self.first + known] = [r["c"] for r in head[:known]]

    def look_up(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Model entry of each word, log10(count + 1) where the head has it, and whether it has."""
        found = np.full(len(w.hash), -1, np.int32)
        place, left = (w.hash >> U64(self.shift)).astype(np.int64), np.arange(len(w.hash))
        for step in range(self.reach):
            at = self.table[place + step]
            left, place, at = (x[at >= 0] for x in (left, place, at))
            same = self.h[at] == w.hash[left]
            found[left[same]] = at[same]
            left, place = left[~same], place[~same]
        there = found >= 0
        entry = self.entry_of[found]
        binned = np.flatnonzero(entry < 0)
        entry[binned] = 1 + w.look[binned] % np.uint16(self.bins)
        return entry, self.log_of[found], there

    def sequence(self, entry: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts with their ends, and lengths."""
        lengths = w.count + 1
        tokens = np.zeros(int(lengths.sum()), np.int64)
        tokens[np.arange(len(entry)) + w.row] = entry
        return tokens, lengths


_NUMBERS = {"n": np.int64, "held": np.uint8, "key": U64, "known": np.int64, "base": np.float64, "inside": np.float64, "tokens": np.uint16, "rare": U64, "rare_row": np.int32}
"""Packed arrays of a chunk: by document its tokens, fold, hash, known tokens, base score and its words' logs within their bins; all tokens (32 bits where entries need them); words outside the head, ascending, and their documents."""


def _encode(vocabulary: Vocabulary, schema: pa.Schema):
    """``(id, held, text)`` -> chunks of about ``PIECE_TOKENS`` tokens."""

    kind = np.uint16 if len(vocabulary.counts) <= 1 << 16 else np.uint32

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cid, words = TaskContext.get().partitionId() << 32, 0
        held: dict[str, list] = {c: [] for c in ("ids", *_NUMBERS)}
        docs = 0

        def chunk() -> pa.RecordBatch:
            ids = pa.concat_arrays(held["ids"])
            numbers = {c: np.concatenate(held[c]) for c in _NUMBERS}
            order = np.argsort(numbers["rare"])
            for c in ("rare", "rare_row"):
                numbers[c] = numbers[c][order]
            columns = {"cid": pa.array([cid]), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)} | {c: pa.array([v.astype(kind if c == "tokens" else _NUMBERS[c]).tobytes()], pa.binary()) for c, v in numbers.items()}
            return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)

        for batch in batches:
            for part, data, offsets in bt.pieces(batch, "text"):
                w = Words(data, offsets)
                entry, logs, there = vocabulary.look_up(w)
                rows = part.num_rows
                tokens, lengths = vocabulary.sequence(entry, w)
                binned = np.flatnonzero(entry < vocabulary.first)
                sums = np.concatenate([np.zeros(1, U64), np.cumsum(w.hash)])
                ends = np.cumsum(w.count)
                named, id_offsets = bt.column_bytes(part.column("id").cast(pa.string()))
                of_id = bt.span_hashes(named, id_offsets[:-1], id_offsets[1:])
                made = {
                    "ids": part.column("id"), "n": lengths, "held": part.column("held").to_numpy(zero_copy_only=False), "key": bt.mix(of_id + bt.mix(sums[ends] - sums[ends - w.count])), "known": np.bincount(w.row[there], minlength=rows) + (vocabulary.docs > 0),
                    "base": np.bincount(w.row, weights=logs, minlength=rows) + np.log10(vocabulary.docs + 1.0),
                    "inside": np.bincount(w.row[binned], weights=logs[binned] - vocabulary.in_bin[entry[binned] - 1], minlength=rows),
                    "tokens": tokens.astype(kind), "rare": w.hash[~there], "rare_row": w.row[~there] + docs,
                }
                for c, v in made.items():
                    held[c].append(v)
                docs += rows
                words += len(tokens)
                if words >= PIECE_TOKENS:
                    yield chunk()
                    held, cid, words, docs = {c: [] for c in held}, cid + 1, 0, 0
        if docs:
            yield chunk()

    return encode


def _numbers(row: dict, *names: str) -> list[np.ndarray]:
    out = [np.frombuffer(row[c], _NUMBERS[c]) for c in names]
    if "tokens" in names and len(out[names.index("tokens")]) > out[names.index("n")].sum():
        out[names.index("tokens")] = np.frombuffer(row["tokens"], np.uint32)
    return out


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of runs that begin at ``starts``."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


_DEALT = "shard int, key binary, n binary, tokens binary"


def _deal(round_: int, rounds: int, shards: int):
    """Training documents of a round, by shard."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                n, held, key, tokens = _numbers(row, "n", "held", "key", "tokens")
                begin = np.cumsum(n) - n
                mine = np.flatnonzero((held == 0) & (key % U64(rounds) == U64(round_)))
                shard = (key[mine] // U64(rounds) % U64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                mine, shard = mine[order], shard[order]
                bounds = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(mine) else [0]
                out: dict[str, list] = {"shard": [], "key": [], "n": [], "tokens": []}
                for a, b in zip(bounds[:-1], bounds[1:]):
                    d = mine[a:b]
                    for c, v in zip(out, (int(shard[a]), key[d].tobytes(), n[d].tobytes(), tokens[_gather(begin[d], n[d])].tobytes())):
                        out[c].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=list(out))

    return deal


_SENT = "block int, shard long, seen long, p binary"


def _train(flat: np.ndarray, shape: Shape, rate: float):
    """One pass of training over the documents of a shard, which is all that a task gets, in the order of their hashes."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in _each(batch)]
        if not rows:
            return
        key, n, tokens = (np.concatenate(x) for x in zip(*(_numbers(r, "key", "n", "tokens") for r in rows)))
        shard = rows[0]["shard"]
        rows.clear()
        order, begin = np.lexsort((n, key)), np.cumsum(n) - n
        trainer = Trainer(Model(shape, flat.copy()), rate)
        with bt.kept_memory():
            piece = np.cumsum(n[order]) // PIECE_TOKENS
            for docs in np.split(order, np.flatnonzero(np.diff(piece)) + 1):
                trainer.learn(tokens[_gather(begin[docs], n[docs])].astype(np.int64), n[docs])
        weighted = trainer.model.flat.astype(np.float64) * trainer.seen
        for b, low in enumerate(range(0, len(weighted), PARAMETER_BLOCK)):
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "shard": [shard], "seen": [trainer.seen], "p": [weighted[low : low + PARAMETER_BLOCK].tobytes()]})

    return train


def _add_parameters(table: pa.Table) -> pa.Table:
    """Sum of a block over shards, always in the order of their numbers."""
    table = table.sort_by("shard")
    total = np.sum([np.frombuffer(v.as_py(), np.float64) for v in table.column("p")], axis=0)
    return pa.table({"block": table.column("block")[:1], "shard": table.column("shard")[:1], "seen": [int(np.sum(table.column("seen").to_numpy()))], "p": pa.array([total.tobytes()], pa.binary())})


def train_model(chunks: DataFrame, vocabulary: Vocabulary, shape: Shape, rounds: int, rate: float) -> np.ndarray:
    """Parameters after ``rounds`` rounds: in each, every shard trains on its documents of another slice of all texts, and the shards' parameters are averaged.

    A shard's parameters travel in blocks; 256 shards are summed first, then those sums.
    """
    flat = initial(shape, vocabulary.counts)
    each = vocabulary.tokens / rounds
    shards = max(1, round((each / SHARD_TOKENS) ** 0.75))
    packed = chunks.select("n", "held", "key", "tokens")
    for r in range(rounds):
        dealt = packed.mapInArrow(_deal(r, rounds, shards), _DEALT).repartitionById(shards, F.col("shard"))
        sent = dealt.mapInArrow(_train(flat, shape, rate * 0.8**r), _SENT)
        some = sent.groupBy("block", F.floor(F.col("shard") / 256).alias("some")).applyInArrow(_add_parameters, _SENT)
        got = some.groupBy("block").applyInArrow(_add_parameters, _SENT).orderBy("block").collect()
        if got:
            flat = (np.concatenate([np.frombuffer(g["p"], np.float64) for g in got]) / got[0]["seen"]).astype(np.float32)
    return flat


_ASKED_SCHEMA = pa.schema([("bucket", pa.int32()), ("cid", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
_ASKED = "bucket int, cid long, a binary, b binary"


def _ask(buckets: int):
    """Words outside the head, with the place of their document, sent to their part of the vocabulary."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                h, of = _numbers(row, "rare", "rare_row")
                bounds = _split(h, buckets)
                parts = [(int(b), slice(bounds[b], bounds[b + 1])) for b in np.flatnonzero(np.diff(bounds))]
                yield _packed([{"bucket": b, "cid": row["cid"], "a": h[s].tobytes(), "b": of[s].tobytes()} for b, s in parts], _ASKED_SCHEMA)

    return ask


def _answer(table: pa.Table) -> pa.Table:
    """Per chunk and document: the sum of log10(count + 1) of its rare words, and how many are known."""
    vocabulary = table.filter(table.column("cid").is_null())
    h, c = np.concatenate([np.zeros(0, U64), *_arrays(vocabulary.column("a"), "u8")]), np.concatenate([np.zeros(0, np.int64), *_arrays(vocabulary.column("b"), "i8")])
    asked = table.filter(table.column("cid").is_valid())
    out = []
    for cid, words, rows in zip(asked.column("cid").to_pylist(), _arrays(asked.column("a"), "u8"), _arrays(asked.column("b"), "i4")):
        if not len(h):
            continue
        at = np.minimum(np.searchsorted(h, words), len(h) - 1)
        count = np.where(h[at] == words, c[at], 0)
        row, where = np.unique(rows, return_inverse=True)
        sums = np.stack([np.bincount(where, weights=np.log10(count + 1.0)), np.bincount(where, weights=count > 0)])
        out.append({"bucket": 0, "cid": cid, "a": row.astype(np.int64).tobytes(), "b": sums.tobytes()})
    return pa.Table.from_batches([_packed(out, _ASKED_SCHEMA)], _ASKED_SCHEMA)


def _score(flat: np.ndarray, shape: Shape, schema: pa.Schema):
    """Chunks with the recurrent model's log10 probability of each document, words within their bins left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shape, flat)
        for batch in batches:
            for i, row in enumerate(_each(batch.drop_columns(["ids"]))):
                n, tokens = _numbers(row, "n", "tokens")
                ends = np.cumsum(n)
                with bt.kept_memory():
                    logs = np.concatenate([[0], np.cumsum(score(model, tokens.astype(np.int64), n))])
                own = pa.array([((logs[ends] - logs[ends - n]) / np.log(10)).tobytes()], pa.binary())
                part = batch.slice(i, 1)
                columns = {c: part.column(c) for c in ("cid", "ids", "n", "known", "base", "inside")} | {"model": own, "a": pa.nulls(1, pa.binary()), "b": pa.nulls(1, pa.binary())}
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)

    return run


def _finish(tokens: int, types: int):
    def finish(table: pa.Table) -> pa.Table:
        own = table.filter(table.column("n").is_valid())
        ids = own.column("ids").combine_chunks().flatten()
        n, known, base, inside, model = (np.frombuffer(own.column(c)[0].as_py(), k).copy() for c, k in (("n", "i8"), ("known", "i8"), ("base", "f8"), ("inside", "f8"), ("model", "f8")))
        model += inside
        told = table.filter(table.column("a").is_valid())
        # Buckets' answers are summed in one order, whatever order they come in.
        for at, sums in sorted(zip(_arrays(told.column("a"), "i8"), _arrays(told.column("b"), "f8")), key=lambda x: (x[0].tobytes(), x[1].tobytes())):
            logs, more = sums.reshape(2, -1)
            base[at] += logs
            model[at] += logs
            known[at] += more.astype(np.int64)
        base -= n * np.log10(tokens + types + 1.0)
        return pa.table({"id": ids, "n_tokens": n, "n_known": known, "base_score": base, "score": model})

    return finish


@dataclass
class LanguageModel:
    """A trained model: its vocabulary and parameters, the counts of all words by part of the vocabulary, and the encoded texts."""

    vocabulary: Vocabulary
    shape: Shape
    flat: np.ndarray
    counts: DataFrame
    chunks: DataFrame
    buckets: int


def _held_out(folds: int, held: int) -> F.Column:
    return F.coalesce(F.crc32(F.col("id").cast("string")) % folds == held, F.lit(False))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, rounds: int = ROUNDS, hidden: int = 24, rate: float = 0.018) -> LanguageModel:
    """Count and encode all texts, and train on those that aren't held out."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("held", _held_out(folds, held))
    buckets = 1 << max(4, (text_volume(texts, "text") // (16 << 20)).bit_length())
    counts = materialise(texts.where("not held").select("text").mapInArrow(_send_counts(buckets), _COUNT).groupBy("bucket").applyInArrow(_add_counts, _COUNT), "words")
    size = counts.mapInArrow(_totals(1), "bin int, n long, v long").agg(F.sum("n")).first()[0] or 0
    learnt = counts.agg(F.sum("docs")).first()[0] or 0
    shape = model_shape(size + learnt, hidden)
    head = _most_frequent(counts, max(HEAD, shape.words))
    totals = counts.mapInArrow(_totals(shape.class_size - 1), "bin int, n long, v long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    vocabulary = Vocabulary(head, totals, learnt, shape)
    kind = T.StructType([T.StructField("cid", T.LongType()), T.StructField("ids", T.ArrayType(texts.schema["id"].dataType)), *(T.StructField(c, T.BinaryType()) for c in _NUMBERS)])
    chunks = materialise(texts.select("id", "held", "text").mapInArrow(_encode(vocabulary, _arrow(kind)), kind), "tokens")
    return LanguageModel(vocabulary, shape, train_model(chunks, vocabulary, shape, rounds, rate), counts, chunks, buckets)


def _arrow(kind: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", folds: int = 7, held: int = 2, **options) -> DataFrame:
    """log10 probability of every whole text, by counts alone and by the recurrent model.

    Returns one row per input row: ``id_col``, held_out (crc32 of the id as text modulo ``folds`` is
    ``held``; never for a null id), n_tokens, n_known, train_tokens, base_score, score.  Both models
    learn from all texts that aren't held out.  Ids may be of any atomic type.  Null and empty texts
    are their end alone; rows that repeat are scored each, and learnt from each.  Without training
    texts every count is 0.  Further columns are ignored.  Scores don't depend on how the table is
    laid out, but for the rounding of 32-bit sums.
    """
    m = fit(docs, id_col=id_col, folds=folds, held=held, **options)
    asked = m.chunks.select("cid", "rare", "rare_row").mapInArrow(_ask(m.buckets), _ASKED)
    told = m.counts.select("bucket", F.lit(None).cast("long").alias("cid"), F.col("h").alias("a"), F.col("c").alias("b"))
    answered = asked.union(told).groupBy("bucket").applyInArrow(_answer, _ASKED)
    kept = [m.chunks.schema[c] for c in ("cid", "ids", "n", "known", "base", "inside")]
    kind = T.StructType([*kept, *(T.StructField(c, T.BinaryType()) for c in ("model", "a", "b"))])
    scored = m.chunks.select("cid", "ids", "n", "known", "base", "inside", "tokens").mapInArrow(_score(m.flat, m.shape, _arrow(kind)), kind)
    replies = answered.select("cid", *(F.lit(None).cast(kind[c].dataType).alias(c) for c in ("ids", "n", "known", "base", "inside", "model")), "a", "b")
    result = T.StructType([T.StructField("id", kept[1].dataType.elementType), *T.StructType.fromDDL("n_tokens long, n_known long, base_score double, score double").fields])
    finished = scored.union(replies).groupBy("cid").applyInArrow(_finish(m.vocabulary.tokens, m.vocabulary.types), result)
    return finished.select(F.col("id").alias(id_col), _held_out(folds, held).alias("held_out"), "n_tokens", "n_known", F.lit(m.vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score")
