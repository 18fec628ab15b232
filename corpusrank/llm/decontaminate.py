"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, one scan of each text."""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .storage import new_path

_TO_SPACE = bytes(b if bt.ALNUM[b] and not 0x41 <= b <= 0x5A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

WINDOW = 10
BLOCK_BYTES = 8 << 20
"""Most bytes of item text in one automaton; more items make more automata, scanned in turn."""


def normalise(text: bytes) -> list[bytes]:
    """Words of a text: A-Z lower-cased, every other ASCII sign than letters and digits separates."""
    return text.translate(_TO_SPACE).split()


def build_automaton(items: Iterable[tuple[object, str | None]], window: int = WINDOW) -> ahocorasick.Automaton | None:
    """One automaton over the windows of all items; a window's value is (words, item ids).

    An item of fewer words than ``window`` is one window; one without words (or null) has none.
    Items that repeat, or share a window, share its state.
    """
    owners: dict[bytes, tuple[int, set[object]]] = {}
    for item, text in items:
        words = normalise((text or "").encode())
        for k in range(max(1, len(words) - window + 1) if words else 0):
            part = words[k : k + window]
            owners.setdefault(b" " + b" ".join(part) + b" ", (len(part), set()))[1].add(item)
    automaton = ahocorasick.Automaton()
    for key, (length, ids) in owners.items():
        automaton.add_word(key.decode("latin-1"), (length, tuple(ids)))
    if not owners:
        return None
    automaton.make_automaton()
    return automaton


class TextHits:
    """What the automata find in one text."""

    def __init__(self, text: bytes, automata: list[ahocorasick.Automaton]):
        words = normalise(text)
        self.n_words = len(words)
        self.items: set[object] = set()
        self.runs: list[tuple[int, int, tuple[object, ...]]] = []
        if not words:
            return
        line = f" {b' '.join(words).decode('latin-1')} "
        ends: np.ndarray | None = None
        for automaton in automata:
            for end, (length, ids) in automaton.iter(line):
                if ends is None:
                    ends = np.cumsum([len(w) + 1 for w in words])
                last = int(np.searchsorted(ends, end))
                self.runs.append((last - length + 1, last + 1, ids))
                self.items.update(ids)

    def hit(self) -> np.ndarray:
        """Which words lie in an occurrence."""
        steps = np.zeros(self.n_words + 1, np.int64)
        for first, end, _ in self.runs:
            steps[first] += 1
            steps[end] -= 1
        return np.cumsum(steps[:-1]) > 0

    def spans(self, text: bytes) -> list[tuple[int, int]]:
        """Hit word runs as [start, end) code points of the original text."""
        if not self.runs:
            return []
        data = np.frombuffer(text, np.uint8)
        starts, ends, _ = bt.spans(data, np.array([0, len(data)]), bt.ALNUM)
        points = np.concatenate([[0], np.cumsum(bt.code_points(data))])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], self.hit().astype(np.int8), [0]])))
        return [(int(points[starts[a]]), int(points[ends[b - 1]])) for a, b in edges.reshape(-1, 2)]


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks of bounded size, so that the driver holds one block at a time."""
    items = benchmark.where(F.col(id_col).isNotNull()).select(id_col, text_col)
    total = items.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES) or 1
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == b)
        yield [(r[0], r[1]) for r in part.toLocalIterator()]


_loaded: dict[str, ahocorasick.Automaton] = {}


def _load(path: str) -> ahocorasick.Automaton:
    if path not in _loaded:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path)
        with system.open_input_stream(at) as file:
            automaton = pickle.loads(file.read())
        _loaded.clear()
        _loaded[path] = automaton
    return _loaded[path]


SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>"
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _write_automata(benchmark: DataFrame, item_col: str, item_text_col: str, window: int) -> list[str]:
    """Files with the automata of the items' blocks, in the shared folder."""
    from pyarrow import fs

    paths = []
    for items in _item_blocks(benchmark, item_col, item_text_col):
        automaton = build_automaton(items, window)
        if automaton is None:
            continue
        paths.append(new_path(benchmark.sparkSession, "automaton"))
        system, at = fs.FileSystem.from_uri(paths[-1])
        with system.open_output_stream(at) as file:
            file.write(pickle.dumps(automaton))
    return paths


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
) -> DataFrame:
    """Occurrences of benchmark windows in every text.

    Returns one row per input row: ``id_col``, n_words, n_hit (words in an occurrence), n_items,
    items_sha256 (of the sorted, comma-joined item ids), contaminated, and spans of the original
    text (code points).  Null and empty texts have no words; rows that repeat are scored each; a
    null id is kept as null.  Items without an id, or without words, match nothing; an empty
    benchmark leaves all clean.  Further columns of either table are ignored.
    """
    paths = _write_automata(benchmark, item_col, item_text_col, window)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in bt.pieces(batch, "text", 16 << 20):
                yield _scan_piece(part, data, offsets, paths)

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(scan, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all their columns, in whose text no benchmark window occurs; one scan, no shuffle."""
    paths = _write_automata(benchmark, item_col, item_text_col, window)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in bt.pieces(batch, text_col, 16 << 20):
                yield part.filter(pa.array([not f.runs for f in _hits(data, offsets, paths)], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def _hits(data: np.ndarray, offsets: np.ndarray, paths: list[str]) -> list[TextHits]:
    texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
    found = [TextHits(t, [_load(paths[0])] if paths else []) for t in texts]
    for path in paths[1:]:
        automaton = _load(path)
        for t, hits in zip(texts, found):
            more = TextHits(t, [automaton])
            hits.runs += more.runs
            hits.items |= more.items
    return found


def _scan_piece(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, paths: list[str]) -> pa.RecordBatch:
    out: dict[str, list] = defaultdict(list)
    texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
    found = _hits(data, offsets, paths)
    for t, hits in zip(texts, found):
        out["n_words"].append(hits.n_words)
        out["n_hit"].append(int(hits.hit().sum()) if hits.runs else 0)
        out["n_items"].append(len(hits.items))
        out["items_sha256"].append(hashlib.sha256(",".join(sorted(map(str, hits.items))).encode()).hexdigest() if hits.items else _EMPTY_SHA)
        out["contaminated"].append(bool(hits.runs))
        out["spans"].append([{"start": a, "end": b} for a, b in hits.spans(t)])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), span]
    return pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(v, k) for v, k in zip(out.values(), kinds))], names=["id", *out])
