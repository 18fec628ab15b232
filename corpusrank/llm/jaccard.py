"""Exact n-gram Jaccard join by vertical partitioning.

1. Each text's set of hashed shingles is sorted.  Sets that link share grams at the low end of that
   order; documents that share too few there with all others leave (a counting form of the prefix
   filter), so only a quarter of the grams is shuffled.
2. The rest are collapsed to classes of equal sets, and their grams counted.  The global order is
   now (document frequency, hash): rare grams first, so passages that many documents share come last.
3. Documents that share a gram of their prefix in that order are candidates.  Where candidates hang
   together in a small component, that is one block of pairs.  A large component, which may be a
   long chain of documents that mostly have nothing in common, is cut into clusters around common
   grams; blocks are then pairs of clusters (or of their tiles) that share a gram.
4. The order is cut into fragments.  For each block and fragment, partial overlaps of pairs are
   counted on bit sets, and summed per pair over the fragments.  A block tells how many links each
   of its documents has, and a spanning forest of them; pairs are never written out.

Grams travel as packed arrays, never as a row each.  A gram that is common within a chunk of
documents leaves the chunk once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .components import components, forest
from .storage import broadcast_if_small, materialise, text_volume, with_unique_key

U64 = np.uint64
CHUNK = 400_000
"""Grams that a task gathers before it sends them on."""
FRAGMENTS = 4
TILE = 256
"""Documents of one side of a block of pairs."""


def least_overlap(sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Grams of a set that any linked set must hold: ceil(threshold * size)."""
    return -(-num * sizes // den)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending within the row, and how many each row has."""
    rows = len(offsets) - 1
    starts, ends, of_row = bt.spans(data, offsets, bt.WORD)
    words = bt.span_hashes(data, starts, ends, fold_case=True)
    n_words = np.bincount(of_row, minlength=rows)
    grams, first = bt.windows(words, of_row, size)
    owner = of_row[first]
    for short in range(1, size):
        at = np.isin(of_row, np.flatnonzero(n_words == short))
        if at.any():
            more, where = bt.windows(words[at], of_row[at], short)
            grams, owner = np.concatenate([grams, more]), np.concatenate([owner, of_row[at][where]])
    if (n_words[n_words > 0] < size).any():
        order = np.argsort(owner, kind="stable")
        grams, owner = grams[order], owner[order]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))]).tolist()
    for a, b in zip(bounds[:-1], bounds[1:]):
        grams[a:b].sort()
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.bincount(owner[new], minlength=rows)


def _split(keys: np.ndarray, buckets: int) -> np.ndarray:
    """For hashes in ascending order: the bounds of each bucket of equal hash range."""
    edges = np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)
    return np.concatenate([[0], np.searchsorted(keys, edges.astype(U64)), [len(keys)]])


def _packed(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _arrays(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), kind) for chunk in column.chunks for v in chunk]


_PREFIX = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _send_prefixes(size: int, num: int, den: int, buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, owners, docs, held = [], [], [], 0
        for batch in batches:
            for part, data, offsets in bt.pieces(batch, "text"):
                keys = part.column("k").to_numpy()
                hashed, n = shingles(data, offsets, size)
                must = least_overlap(n, num, den)
                begin = np.cumsum(n) - n
                take = np.minimum(n, n - must + -(-n // 20))
                at = np.repeat(begin - (np.cumsum(take) - take), take) + np.arange(take.sum())
                grams.append(hashed[at])
                owners.append(np.repeat(keys, take))
                docs.append((keys, n, np.maximum(1, -(-must // 20))))
                held += len(at)
                if held >= CHUNK:
                    yield _prefix_rows(grams, owners, docs, buckets)
                    grams, owners, docs, held = [], [], [], 0
        if docs:
            yield _prefix_rows(grams, owners, docs, buckets)
        grams, owners, docs = [], [], []
        bt.give_back()

    return send


def _prefix_rows(grams: list, owners: list, docs: list, buckets: int) -> pa.RecordBatch:
    """Rows of kind 0: grams met once in the chunk, with their document.  Kind 1: grams met more often, without.
    Kind 2: the chunk's documents (key, set size, matches that it needs, matches within the chunk)."""
    hashed, owner = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(hashed)
    hashed, owner = hashed[order], owner[order]
    first = np.ones(len(hashed), bool)
    first[1:] = hashed[1:] != hashed[:-1]
    alone = first.copy()
    alone[:-1] &= first[1:]
    keys, n, need = (np.concatenate(x) for x in zip(*docs))
    by_key = np.argsort(keys)
    keys, n, need = keys[by_key], n[by_key], need[by_key]
    local = np.bincount(np.searchsorted(keys, owner[~alone]), minlength=len(keys))
    rows = []
    once, owner, more = hashed[alone], owner[alone], hashed[first & ~alone]
    for kind, h in ((0, once), (1, more)):
        bounds = _split(h, buckets)
        for b in np.flatnonzero(np.diff(bounds)):
            s = slice(bounds[b], bounds[b + 1])
            rows.append({"bucket": int(b), "kind": kind, "a": h[s].tobytes(), "b": owner[s].tobytes() if kind == 0 else b"", "c": b""})
    home = int(keys[0] % buckets) if len(keys) else 0
    rows.append({"bucket": home, "kind": 2, "a": keys.tobytes(), "b": n.astype(np.int64).tobytes(), "c": np.stack([need, local]).astype(np.int64).tobytes()})
    return _packed(rows, _PREFIX)


def _match_prefixes(table: pa.Table) -> pa.Table:
    kind = table.column("kind").to_numpy()
    none = [np.zeros(0, U64)]
    once = np.concatenate(none + _arrays(table.filter(pa.array(kind == 0)).column("a"), "u8"))
    owner = np.concatenate([np.zeros(0, np.int64)] + _arrays(table.filter(pa.array(kind == 0)).column("b"), "i8"))
    more = np.concatenate(none + _arrays(table.filter(pa.array(kind == 1)).column("a"), "u8"))
    order = np.argsort(once)
    once, owner = once[order], owner[order]
    same = np.zeros(len(once), bool)
    same[1:] = once[1:] == once[:-1]
    same[:-1] |= same[1:]
    more = np.unique(more)
    if len(more):
        same |= more[np.minimum(np.searchsorted(more, once), len(more) - 1)] == once
    keys, counts = np.unique(owner[same], return_counts=True)
    zero = np.zeros(len(keys), np.int64)
    columns = [keys], [zero], [zero], [counts]
    docs = table.filter(pa.array(kind == 2))
    for k, n, x in zip(*(_arrays(docs.column(c), "i8") for c in "abc")):
        for target, values in zip(columns, (k, n, *x.reshape(2, -1))):
            target.append(values)
    bt.give_back()
    return pa.table({name: np.concatenate(c).astype(np.int64) for name, c in zip(("k", "n", "need", "met"), columns)})


_CHUNK_SCHEMA = pa.schema([("cid", pa.int64()), ("keys", pa.binary()), ("sizes", pa.binary()), ("grams", pa.binary())])


def _chunk_sets(size: int):
    """Sets of documents, packed by chunk: keys, sizes, and all grams one after the other."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, count = TaskContext.get().partitionId() << 32, 0
        keys, sizes, grams, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            values = (np.concatenate(keys).astype(np.int64), np.concatenate(sizes).astype(np.int64), np.concatenate(grams))
            return _packed([{"cid": base + count, **{c: v.tobytes() for c, v in zip(("keys", "sizes", "grams"), values)}}], _CHUNK_SCHEMA)

        for batch in batches:
            for part, data, offsets in bt.pieces(batch, "text"):
                hashed, n = shingles(data, offsets, size)
                keys.append(part.column("k").to_numpy())
                sizes.append(n)
                grams.append(hashed)
                held += len(hashed)
                if held >= CHUNK:
                    yield row()
                    keys, sizes, grams, held, count = [], [], [], 0, count + 1
        if keys:
            yield row()
        keys, sizes, grams = [], [], []
        bt.give_back()

    return pack


def _each(batch: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    """Rows one by one; binary values are views of the batch, not copies."""
    for part in batch.to_batches() if isinstance(batch, pa.Table) else [batch]:
        binary = [pa.types.is_binary(f.type) or pa.types.is_large_binary(f.type) for f in part.schema]
        for i in range(part.num_rows):
            values = (c[i] for c in part.columns)
            yield {n: (v.as_buffer() if v.is_valid else None) if b else v.as_py() for n, b, v in zip(part.schema.names, binary, values)}


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["keys"], np.int64), np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["grams"], U64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in _each(batch):
            keys, n, grams = _unpack(row)
            begin = np.cumsum(n) - n
            sums = [np.concatenate([np.zeros(1, U64), np.cumsum(bt.mix(grams ^ U64(salt)))]) for salt in (0x1234567, 0x89ABCDEF01)]
            one, two = ((s[begin + n] - s[begin]).view(np.int64) for s in sums)
            yield pa.RecordBatch.from_pydict({"k": keys, "s1": one, "s2": two, "n": n})


def _send_counts(buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("cid", pa.int64()), ("h", pa.binary()), ("c", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                h, c = np.unique(np.frombuffer(row["grams"], U64), return_counts=True)
                bounds, c = _split(h, buckets), c.astype(np.int32)
                rows = [
                    {"bucket": int(b), "cid": row["cid"], "h": h[bounds[b] : bounds[b + 1]].tobytes(), "c": c[bounds[b] : bounds[b + 1]].tobytes()}
                    for b in np.flatnonzero(np.diff(bounds))
                ]
                if rows:
                    yield _packed(rows, schema)

    return send


_REPLY = "cid long, h binary, df binary"


def _reply_counts(table: pa.Table) -> pa.Table:
    """Document frequencies, told to every chunk that asked; those of 1 are left out."""
    h, c = _arrays(table.column("h"), "u8"), _arrays(table.column("c"), "i4")
    unique, at = np.unique(np.concatenate(h), return_inverse=True)
    df = np.bincount(at, weights=np.concatenate(c), minlength=len(unique)).astype(np.int64)
    bounds = np.cumsum([0, *map(len, h)])
    rows: dict[str, list] = {"cid": table.column("cid").to_pylist(), "h": [], "df": []}
    bt.give_back()
    for one, a, b in zip(h, bounds[:-1], bounds[1:]):
        counts = df[at[a:b]]
        rows["h"].append(one[counts > 1].tobytes())
        rows["df"].append(counts[counts > 1].tobytes())
    return pa.table({"cid": pa.array(rows["cid"], pa.int64()), "h": pa.array(rows["h"], pa.binary()), "df": pa.array(rows["df"], pa.binary())})


def _order_sets(num: int, den: int):
    """For documents of a chunk that can still link: their shared grams in the global order."""

    def order(table: pa.Table) -> pa.Table:
        rows = list(_each(table))
        out: dict[str, list] = {"k": [], "n": [], "prefix": [], "grams": [], "df": []}
        asked = [r for r in rows if r["h"] is not None]
        h = np.concatenate([np.zeros(0, U64), *(np.frombuffer(r["h"], U64) for r in asked)])
        df = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["df"], np.int64) for r in asked)])
        by = np.argsort(h)
        h, df = h[by], df[by]
        for row in rows:
            if row["keys"] is None or not len(h):
                continue
            keys, n, grams = _unpack(row)
            at = np.minimum(np.searchsorted(h, grams), len(h) - 1)
            counts = np.where(h[at] == grams, df[at], 1)
            begin = np.cumsum(n) - n
            shared = np.concatenate([[0], np.cumsum(counts > 1)])
            lone = n - (shared[begin + n] - shared[begin])
            spare = n - least_overlap(n, num, den)
            for i in np.flatnonzero((lone <= spare) & (n > 0)):
                s = slice(begin[i], begin[i] + n[i])
                g, c = grams[s], counts[s]
                g, c = g[c > 1], c[c > 1]
                o = np.lexsort((g, c))
                out["k"].append(int(keys[i]))
                out["n"].append(int(n[i]))
                out["prefix"].append(int(spare[i] + 1 - lone[i]))
                out["grams"].append(g[o].tobytes())
                out["df"].append(c[o].astype(np.int64).tobytes())
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        bt.give_back()
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds)})

    return order


def _send_candidates(buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("h", pa.binary()), ("k", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_each(batch))
            h = np.concatenate([np.frombuffer(r["grams"], U64)[: r["prefix"]] for r in rows] or [np.zeros(0, U64)])
            k = np.concatenate([np.full(min(r["prefix"], r["grams"].size // 8), r["k"], np.int64) for r in rows] or [np.zeros(0, np.int64)])
            order = np.lexsort((k, h))
            h, k = h[order], k[order]
            # Within a batch a gram joins its documents at once; only the least of them stands for it outside.
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            a, b = forest(k[~first], k[np.flatnonzero(first)[np.cumsum(first) - 1]][~first])
            out = [{"bucket": -1, "h": a.tobytes(), "k": b.tobytes()}] if len(a) else []
            h, k = h[first], k[first]
            bounds = _split(h, buckets)
            out += [{"bucket": int(x), "h": h[bounds[x] : bounds[x + 1]].tobytes(), "k": k[bounds[x] : bounds[x + 1]].tobytes()} for x in np.flatnonzero(np.diff(bounds))]
            if out:
                yield _packed(out, schema)

    return send


def _join_candidates(table: pa.Table) -> pa.Table:
    if table.column("bucket")[0].as_py() == -1:
        a, b = (np.concatenate(_arrays(table.column(c), "i8")) for c in "hk")
    else:
        h, k = np.concatenate(_arrays(table.column("h"), "u8")), np.concatenate(_arrays(table.column("k"), "i8"))
        order = np.lexsort((k, h))
        h, k = h[order], k[order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        a, b = forest(k[~first], k[np.flatnonzero(first)[np.cumsum(first) - 1]][~first])
    return pa.table({"a": a.astype(np.int64), "b": b.astype(np.int64)})


def _partial_overlaps(num: int, den: int):
    """Partial overlaps of the pairs of some blocks in one fragment."""

    def count(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_numpy()
        order = np.argsort(blocks, kind="stable")
        table = table.take(pa.array(order))
        blocks = blocks[order]
        keys, sizes, sides, lone, copies = (table.column(c).to_numpy() for c in ("k", "n", "side", "lone", "copies"))
        two = table.column("two").to_numpy()
        segments = _arrays(table.column("grams"), "u8")
        xs, ys, cs = [], [], []
        bounds = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1], [True]]))
        for a, b in zip(bounds[:-1], bounds[1:]):
            for x, y, c in _group_overlaps(segments[a:b], sizes[a:b], lone[a:b], sides[a:b] if two[a] else None, num, den):
                xs.append(keys[a + x])
                ys.append(keys[a + y])
                cs.append(c)
        joined = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys, cs)]
        bt.give_back()
        unique, first = np.unique(keys, return_index=True)
        docs = np.stack([unique, sizes[first], copies[first]]).astype(np.int64)
        row = {"task": [table.column("task")[0].as_py()], "x": [joined[0].tobytes()], "y": [joined[1].tobytes()], "c": [joined[2].astype(np.int32).tobytes()], "docs": [docs.tobytes()]}
        return pa.table({k: pa.array(v, pa.int64() if k == "task" else pa.binary()) for k, v in row.items()})

    return count


def _group_overlaps(segments: list[np.ndarray], sizes: np.ndarray, lone: np.ndarray, sides: np.ndarray | None, num: int, den: int):
    """Pairs (x < y by position) of a block with common grams in this fragment, and how many; with ``sides``, only pairs of different sides.

    Pairs that no overlap elsewhere could still link are left out: by set sizes, and by what both
    hold here without the other (with the grams that no other document holds).
    """
    count = len(segments)
    if count < 2:
        return
    lengths = np.array([len(s) for s in segments])
    grams, at = np.unique(np.concatenate(segments), return_inverse=True)
    used = np.bincount(at) > 1
    column = np.cumsum(used) - 1
    width = max(1, -(-int(used.sum()) // 64))
    bits = np.zeros((count, width * 8), np.uint8)
    rows = np.repeat(np.arange(count), lengths)
    keep = used[at]
    rows, cols = rows[keep], column[at[keep]]
    np.bitwise_or.at(bits, (rows, cols // 8), np.left_shift(np.uint8(1), (cols % 8).astype(np.uint8)))
    words = bits.view(U64)
    step = max(1, (1 << 20) // count)
    for low in range(0, count, step):
        high = min(count, low + step)
        common = np.zeros((high - low, count), np.int64)
        for w in range(width):
            common += np.bitwise_count(words[low:high, w, None] & words[None, :, w])
        x, y = np.nonzero(common)
        c = common[x, y]
        x = x + low
        ok = x < y
        if sides is not None:
            ok &= sides[x] != sides[y]
        total = sizes[x] + sizes[y]
        least = -(-num * total // (num + den))
        apart = lengths[x] + lengths[y] - 2 * c + lone[x] + lone[y]
        ok &= (apart <= total - 2 * least) & (np.minimum(sizes[x], sizes[y]) >= least)
        yield x[ok], y[ok], c[ok]


def _sum_overlaps(num: int, den: int):
    """Links of some blocks, from partial overlaps summed per pair over the fragments: rows (a, null, documents linked with a), and a spanning forest (a, b)."""

    def add(table: pa.Table) -> pa.Table:
        x, y = (np.concatenate(_arrays(table.column(c), "i8")) for c in "xy")
        c = np.concatenate(_arrays(table.column("c"), "i4")).astype(np.int64)
        docs = np.concatenate([s.reshape(3, -1) for s in _arrays(table.column("docs"), "i8")], axis=1)
        keys, first = np.unique(docs[0], return_index=True)
        _, sizes, copies = docs[:, first]
        i, j = np.searchsorted(keys, x), np.searchsorted(keys, y)
        low, high = np.minimum(i, j), np.maximum(i, j)
        unique, at = np.unique(low * len(keys) + high, return_inverse=True)
        total = np.bincount(at, weights=c, minlength=len(unique)).astype(np.int64)
        low, high = unique // max(1, len(keys)), unique % max(1, len(keys))
        linked = den * total >= num * (sizes[low] + sizes[high] - total)
        low, high = low[linked], high[linked]
        others = np.zeros(len(keys), np.int64)
        np.add.at(others, low, copies[high])
        np.add.at(others, high, copies[low])
        some = np.flatnonzero(others)
        a, b = forest(low, high)
        zero = np.zeros(len(a), np.int64)
        return pa.table({"a": np.concatenate([keys[some], keys[a]]), "b": pa.array(np.concatenate([zero[:0], np.zeros(len(some), np.int64), keys[b]]), mask=np.arange(len(some) + len(a)) < len(some)), "others": np.concatenate([others[some], zero])})

    return add


def jaccard_links(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: tuple[int, int] = (80, 100), fragments: int = FRAGMENTS,
) -> DataFrame:
    """Link documents whose shingle sets have a Jaccard similarity of at least ``threshold`` (a whole fraction, over 0).

    Returns one row per input row: ``id_col``, n_shingles, n_similar (other documents linked
    directly) and component_id (least id reachable by links).  Exact but for equal 64-bit hashes of
    different shingles.  Null and empty texts have no shingles and no links.  Rows that repeat, or
    share an id, are documents of their own; a null id is kept, and counts as no id when the least
    is sought.  Ids may be of any atomic type.  Further columns are ignored; an empty table has no rows.

    Nothing is capped: equal sets are one class, and candidates of any number are cut into blocks of
    pairs.
    """
    num, den = threshold
    keyed = with_unique_key(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "k")
    texts = keyed.select("k", "text")
    buckets = 1 << max(4, (text_volume(texts, "text") // (8 << 20)).bit_length())

    sent = texts.mapInArrow(_send_prefixes(size, num, den, buckets), "bucket int, kind int, a binary, b binary, c binary")
    met = sent.groupBy("bucket").applyInArrow(_match_prefixes, "k long, n long, need long, met long")
    sizes = materialise(met.groupBy("k").agg(F.sum("n").alias("n"), (F.sum("met") >= F.sum("need")).alias("open")), "sizes")
    left = broadcast_if_small(sizes.where("open and n > 0").select("k"))
    chunks = materialise(texts.join(left, "k", "left_semi").mapInArrow(_chunk_sets(size), "cid long, keys binary, sizes binary, grams binary"), "sets")
    ids = keyed.select("k", "id")
    marks = chunks.mapInArrow(_signatures, "k long, s1 long, s2 long, n long")
    classes = marks.groupBy("s1", "s2", "n").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("copies"))
    member = materialise(marks.join(classes, ["s1", "s2", "n"]).select("k", "rep", "copies"), "classes")

    reps = member.where("k = rep").select("rep")
    sets = _keep_reps(chunks, reps)
    asked = sets.mapInArrow(_send_counts(buckets), "bucket int, cid long, h binary, c binary")
    replies = asked.groupBy("bucket").applyInArrow(_reply_counts, _REPLY)
    none = F.lit(None).cast("binary")
    both = sets.select("cid", "keys", "sizes", "grams", none.alias("h"), none.alias("df")).union(replies.select("cid", none, none, none, "h", "df"))
    ordered = materialise(both.groupBy("cid").applyInArrow(_order_sets(num, den), "k long, n long, prefix long, grams binary, df binary"), "ordered")

    near = ordered.mapInArrow(_send_candidates(buckets), "bucket int, h binary, k binary")
    near = near.withColumn("salt", F.when(F.col("bucket") < 0, F.pmod(F.hash("h"), F.lit(64))).otherwise(0))
    edges = materialise(near.groupBy("bucket", "salt").applyInArrow(_join_candidates, "a long, b long"), "candidates")
    copies = member.where("k = rep").select("k", "copies")
    groups = materialise(components(edges).select(F.col("node").alias("k"), "root").join(copies, "k"), "groups")
    links = materialise(_verify(ordered, groups, num, den, fragments, buckets), "links")

    similar = links.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("others").alias("others"))
    roots = components(links.where("b is not null").select("a", "b")).select(F.col("node").alias("rep"), "root")
    placed = member.join(similar, "rep", "left").join(roots, "rep", "left").select("k", F.coalesce("root", "rep").alias("root"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_similar"))
    placed = placed.join(ids, "k")
    least = placed.groupBy("root").agg(F.min("id").alias("least"))
    placed = placed.join(least, "root").select("k", "n_similar", "least")
    every = ids.join(sizes.select("k", "n"), "k").join(placed, "k", "left")
    return every.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"), F.coalesce("least", "id").alias("component_id")
    )


def _keep_reps(chunks: DataFrame, reps: DataFrame) -> DataFrame:
    """The packed sets, with only one document of each class."""
    def owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, keys in zip(batch.column("cid").to_pylist(), batch.column("keys").to_pylist()):
                k = np.frombuffer(keys, np.int64)
                yield pa.RecordBatch.from_pydict({"cid": np.full(len(k), cid), "rep": k})

    kept = chunks.select("cid", "keys").mapInArrow(owners, "cid long, rep long").join(reps, "rep", "left_semi")
    named = kept.groupBy("cid").agg(F.collect_list("rep").alias("reps"))

    def filter_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                keys, n, grams = _unpack(row)
                keep = np.isin(keys, np.array(row["reps"], np.int64))
                values = keys[keep], n[keep], grams[np.repeat(keep, n)]
                yield _packed([{"cid": row["cid"], **{c: v.tobytes() for c, v in zip(("keys", "sizes", "grams"), values)}}], _CHUNK_SCHEMA)

    return materialise(chunks.join(named, "cid").mapInArrow(filter_sets, "cid long, keys binary, sizes binary, grams binary"), "reps")


def _prefix_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (g, k) for each gram of a document's prefix."""
    for batch in batches:
        for r in _each(batch):
            g = np.frombuffer(r["grams"], np.int64)[: r["prefix"]]
            yield pa.RecordBatch.from_pydict({"g": g, "k": np.full(len(g), r["k"])})


def _clusters(ordered: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of candidates ``docs(k)``: (k, cluster), and all pairs of clusters (one, two) with a prefix gram in common, each with itself too.

    A document joins the cluster of the least document that it shares a prefix gram with.  Near
    copies share grams with all of their kind, so they are few clusters; along a chain clusters stay small.
    """
    grams = materialise(ordered.join(docs, "k", "left_semi").select("k", "prefix", "grams").mapInArrow(_prefix_grams, "g long, k long"), "prefixes")
    least = grams.groupBy("g").agg(F.min("k").alias("least"))
    clusters = materialise(grams.join(least, "g").groupBy("k").agg(F.min("least").alias("cluster")), "clusters")
    seen = materialise(grams.join(clusters, "k").select("g", "cluster").distinct(), "met")
    met = seen.withColumnRenamed("cluster", "one").join(seen.withColumnRenamed("cluster", "two"), "g").where("one < two").select("one", "two").distinct()
    return clusters, met.union(clusters.select(F.col("cluster").alias("one"), F.col("cluster").alias("two")).distinct())


def _blocks(ordered: DataFrame, groups: DataFrame, num: int, den: int) -> DataFrame:
    """The blocks of pairs that each candidate takes part in: (k, copies, block, side, two); with ``two``, only pairs of different sides count."""
    large = groups.groupBy("root").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 4 * TILE).select("root")
    whole = groups.select("k", "copies", F.xxhash64("root").alias("block"), F.lit(0).alias("side"), F.lit(False).alias("two"), "root")
    if not large.limit(1).count():
        return whole.drop("root")
    docs = groups.join(large, "root", "left_semi").select("k", "copies")
    clusters, pairs = _clusters(ordered, docs.select("k"))
    # A large cluster is dealt into tiles by its documents' set sizes, so that most pairs of tiles differ too much in size.
    members = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    size_class = F.when(F.col("members") > TILE, F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)))).otherwise(0)
    tile = size_class * (1 << 40) + F.pmod(F.xxhash64("k"), F.ceil(F.col("members") / TILE))
    placed = materialise(clusters.join(members, "cluster").join(ordered.select("k", "n"), "k").join(docs, "k").select("k", "copies", "n", "cluster", tile.alias("tile")), "tiles")
    sides = placed.groupBy("cluster", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    one, two = (sides.select(F.col("cluster").alias(c), F.col("tile").alias(f"tile_{c}"), F.col("low").alias(f"low_{c}"), F.col("high").alias(f"high_{c}")) for c in ("one", "two"))
    near = (F.col("high_one") * den >= F.col("low_two") * num) & (F.col("high_two") * den >= F.col("low_one") * num)
    able = pairs.join(one, "one").join(two, "two").where(near & ((F.col("one") < F.col("two")) | (F.col("tile_one") <= F.col("tile_two"))))
    able = able.select("one", "tile_one", "two", "tile_two", F.xxhash64("one", "tile_one", "two", "tile_two").alias("block"), ((F.col("one") < F.col("two")) | (F.col("tile_one") < F.col("tile_two"))).alias("apart"))
    ends = able.select(F.col("one").alias("cluster"), F.col("tile_one").alias("tile"), "block", F.lit(0).alias("side"), F.col("apart").alias("two"))
    ends = ends.union(able.where("apart").select("two", "tile_two", "block", F.lit(1), "apart"))
    tiled = placed.join(ends, ["cluster", "tile"]).select("k", "copies", "block", "side", "two")
    return whole.join(large, "root", "left_anti").select(*tiled.columns).union(tiled)


def _verify(ordered: DataFrame, groups: DataFrame, num: int, den: int, fragments: int, bins: int) -> DataFrame:
    """Links of candidates, block by block: partial overlaps by fragment of the global order, summed per pair."""
    pivots = _pivots(ordered, fragments)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"task": pa.int64(), "fragment": pa.int32(), "block": pa.int64(), "side": pa.int32(), "two": pa.bool_(), "k": pa.int64(), "n": pa.int64(), "copies": pa.int64(), "lone": pa.int64(), "grams": pa.binary()}
        for batch in batches:
            out: dict[str, list] = {c: [] for c in kinds}
            for r in _each(batch):
                grams, df = np.frombuffer(r["grams"], U64), np.frombuffer(r["df"], np.int64)
                place = np.searchsorted(pivots, _order_value(df, grams), "right")
                bounds = np.searchsorted(place, np.arange(fragments + 1))
                for f in range(fragments):
                    values = (r["block"] % bins, f, r["block"], r["side"], r["two"], r["k"], r["n"], r["copies"], r["n"] - len(grams), grams[bounds[f] : bounds[f + 1]].tobytes())
                    for c, v in zip(kinds, values):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds[c]) for c, v in out.items()], names=list(out))

    placed = ordered.select("k", "n", "grams", "df").join(_blocks(ordered, groups, num, den), "k")
    pieces = placed.mapInArrow(cut, "task long, fragment int, block long, side int, two boolean, k long, n long, copies long, lone long, grams binary")
    partial = pieces.groupBy("task", "fragment").applyInArrow(_partial_overlaps(num, den), "task long, x binary, y binary, c binary, docs binary")
    return partial.groupBy("task").applyInArrow(_sum_overlaps(num, den), "a long, b long, others long")


def _order_value(df: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Place of a gram in the global order, as a float: its frequency, then its hash."""
    return df + (grams >> U64(12)).astype(np.float64) / 2.0**52


def _pivots(ordered: DataFrame, fragments: int) -> np.ndarray:
    """Cuts of the global order into fragments of about equal mass, from the count of grams by frequency (in steps of a 16th octave)."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            df = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["df"], np.int64) for r in _each(batch))])
            step, count = np.unique(np.floor(np.log2(df) * 16).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_pydict({"step": step, "count": count})

    rows = ordered.select("df").mapInArrow(tally, "step long, count long").groupBy("step").agg(F.sum("count").alias("c")).orderBy("step").collect()
    total, seen, pivots = sum(r["c"] for r in rows), 0, []
    for r in rows:
        low, high = 2.0 ** (r["step"] / 16), 2.0 ** ((r["step"] + 1) / 16)
        while len(pivots) < fragments - 1 and seen + r["c"] >= total * (len(pivots) + 1) / fragments:
            pivots.append(low + (high - low) * (total * (len(pivots) + 1) / fragments - seen) / r["c"])
        seen += r["c"]
    return np.array(pivots)
