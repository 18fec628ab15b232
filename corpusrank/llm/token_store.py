"""Token-id shards with a minimal perfect hash index from document keys to places in the shards.

Layout of a store folder: ``shard-*.ids`` is the raw little-endian ids of consecutive documents;
``shard-*.keys`` holds their keys and lengths; ``index-*.npz`` is one part of the index (keys are
dealt to parts by hash).  A task writes under a name of its own and hands the name on, so an attempt
that is lost or repeated leaves only a file that nothing names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as bt
from .perfect_hash import IndexPart
from .storage import materialise, new_path, text_volume
from .wordids import encoder

END_ID = 1
SHARD_BYTES = 32 << 20
PIECE_BYTES = 1 << 20
"""Text that is encoded at a time; numpy's temporaries are some 40 times as large, in every running task."""
KEYS_PER_PART = 65_536
_MANIFEST = "shard long, name string, n_docs long, n_ids long"


def _open_out(uri: str):
    system, at = fs.FileSystem.from_uri(uri)
    return system.open_output_stream(at)


def _read(uri: str) -> bytes:
    system, at = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(at) as file:
        return file.read()


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (bt.mix(keys.astype(bt.U64) ^ bt.U64(0x2545F4914F6CDD1D)) % bt.U64(parts)).astype(np.int64)


def _own(column: pa.Array) -> pa.Array:
    """A copy: a column as it arrives shares one buffer with its batch, so keeping it would keep the batch's texts too."""
    return column.take(pa.array(np.arange(len(column))))


def _write_keys(uri: str, keys: pa.Array, lengths: np.ndarray) -> None:
    table = pa.record_batch([keys.cast(pa.int64()), pa.array(lengths, pa.int64())], names=["key", "n_tokens"])
    with _open_out(uri) as out, pa.ipc.new_file(out, table.schema) as writer:
        writer.write_batch(table)


def _read_keys(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = pa.ipc.open_file(pa.BufferReader(_read(uri))).read_all()
    key = table.column("key")
    return key.fill_null(0).to_numpy(), ~key.is_null().to_numpy(), table.column("n_tokens").to_numpy()


class TokenStore:
    """A store folder as written by :func:`write_store`."""

    def __init__(self, path: str, shards: list[tuple[str, int, int]], parts: list[str], dtype: str):
        self.path, self.shards, self.parts, self.dtype = path, shards, parts, dtype
        self.base = np.concatenate([[0], np.cumsum([n for _, _, n in shards])]).astype(np.int64)

    def get(self, key: int) -> np.ndarray | None:
        """Ids of the document with this key (the first, where several have it), by one seek; None if there is none."""
        if not self.parts:
            return None
        keys = np.array([key], np.int64)
        part = _index_part(f"{self.path}/{self.parts[int(_part_of(keys, len(self.parts))[0])]}")
        entries, there = part.find(keys)
        if not there[0]:
            return None
        name, width = self.shards[int(entries["shard"][0])][0], np.dtype(self.dtype).itemsize
        system, at = fs.FileSystem.from_uri(f"{self.path}/{name}.ids")
        with system.open_input_file(at) as file:
            file.seek(int(entries["offset"][0]) * width)
            return np.frombuffer(file.read(int(entries["n_tokens"][0]) * width), self.dtype)


@lru_cache(maxsize=4)
def _index_part(uri: str) -> IndexPart:
    return IndexPart.load(_read(uri))


def write_store(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", order_by: list[str] | None = None,
    shard_bytes: int = SHARD_BYTES, keys_per_part: int = KEYS_PER_PART,
) -> TokenStore:
    """Encode every text, append the end id, and write shards and index.

    Documents are laid out ascending by ``order_by`` (``id_col`` if not given; null first).  A null
    text is empty: its only id is the end id.  Rows that repeat a key are all written, the index
    names the first; rows without a key are written but not indexed.  Keys are whole numbers (or
    texts of such); any other counts as none.  Rows that are equal in the order follow a hash of
    their texts, so a table always gives the same layout.  An empty table gives a store
    without shards.  Only the names and totals of shards and parts reach the driver.
    """
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    system, at = fs.FileSystem.from_uri(path)
    system.create_dir(at, recursive=True)
    order = order_by or [id_col]
    n_shards = max(text_volume(docs, text_col) // shard_bytes, 2 * spark.sparkContext.defaultParallelism)
    rows = docs.select(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(id_col).try_cast("long").alias("key"), F.col(text_col).alias("text"))
    # Rows of one key (or of none) are told apart by their texts, so they spread over shards and always come in one order.
    rows = rows.withColumn("tie", F.xxhash64("key", "text"))
    keys = [*(f"o{i}" for i in range(len(order))), "tie"]
    laid = rows.repartitionByRange(int(n_shards), *keys).sortWithinPartitions(*keys)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"shard-{context.partitionId():06d}-{context.taskAttemptId()}"
        enc = encoder(tokenizer)
        all_keys, lengths, n_ids, out = [], [], 0, None
        for batch in batches:
            for part, data, offsets in bt.pieces(batch, "text", PIECE_BYTES):
                ids, counts = enc.encode(data, offsets)
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, END_ID)
                if out is None:
                    out = _open_out(f"{path}/{name}.ids")
                out.write(ids.tobytes())
                n_ids += len(ids)
                all_keys.append(_own(part.column("key")))
                lengths.append(counts + 1)
        if out is not None:
            out.close()
            lengths = np.concatenate(lengths)
            _write_keys(f"{path}/{name}.keys", pa.concat_arrays(all_keys), lengths)
            yield pa.RecordBatch.from_pylist([{"shard": context.partitionId(), "name": name, "n_docs": len(lengths), "n_ids": n_ids}])

    manifest = materialise(laid.select("key", "text").mapInArrow(encode, _MANIFEST), "shards").orderBy("shard").collect()
    shards = [(r["name"], r["n_docs"], r["n_ids"]) for r in manifest]
    dtype = encoder(tokenizer).dtype.str
    total = sum(n for _, n, _ in shards)
    n_parts = -(-total // keys_per_part)
    if not total:
        return TokenStore(path, shards, [], dtype)
    places = _shard_frame(spark, shards).mapInArrow(_places(path, [name for name, _, _ in shards], n_parts), "part long, key long, shard long, offset long, n_tokens long")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = pa.Table.from_batches(list(batches))
        part, key, shard, offset, size, copies = (c.to_numpy() for c in table.columns)
        made = IndexPart.build(key, shard, offset, size, np.minimum(copies, 2**32 - 1))
        name = f"index-{part[0]:06d}-{TaskContext.get().taskAttemptId()}.npz"
        with _open_out(f"{path}/{name}") as out:
            out.write(made.dump())
        yield pa.RecordBatch.from_pylist([{"part": int(part[0]), "name": name}])

    # One row a key reaches the index, however many copies it has.
    place = F.struct("shard", "offset", "n_tokens")
    keyed = places.where("part >= 0").groupBy("part", "key").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("copies")).select("part", "key", "at.*", "copies")
    built = keyed.groupBy("part").applyInArrow(lambda t: pa.Table.from_batches(build(t.to_batches())), "part long, name string")
    names = {r["part"]: r["name"] for r in materialise(built, "parts").collect()}
    return TokenStore(path, shards, _fill_parts(path, names, n_parts), dtype)


def _fill_parts(path: str, names: dict[int, str], n_parts: int) -> list[str]:
    """A part that no key fell into still needs a file."""
    for p in set(range(n_parts)) - set(names):
        names[p] = f"index-{p:06d}-empty.npz"
        nothing = np.zeros(0, np.int64)
        with _open_out(f"{path}/{names[p]}") as out:
            out.write(IndexPart.build(nothing, nothing, nothing, nothing, nothing).dump())
    return [names[p] for p in range(n_parts)]


def _shard_frame(spark: SparkSession, shards: list[tuple[str, int, int]]) -> DataFrame:
    """The shards' numbers, one a task.  Rows made from Python objects would start Python workers of another kind beside those that run."""
    return spark.range(0, len(shards), 1, len(shards)).withColumnRenamed("id", "shard")


def _places(path: str, names: list[str], n_parts: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                key, known, size = _read_keys(f"{path}/{names[shard]}.keys")
                part = np.where(known, _part_of(key, n_parts), -1)
                yield pa.RecordBatch.from_pydict({"part": part, "key": key, "shard": np.full(len(key), shard), "offset": np.cumsum(size) - size, "n_tokens": size})

    return read


def read_store(spark: SparkSession, store: TokenStore, id_col: str = "doc_id") -> DataFrame:
    """Every document as it stands in the files, looked up in the index.

    One row per document: ``id_col``, start (ids before it in the store), n_tokens, ids_crc32 (of the
    ids as little-endian 32-bit integers) and indexed (the index leads to this place, or to an earlier
    document with the same key).
    """
    schema = f"{id_col} long, start long, n_tokens long, ids_crc32 long, indexed boolean"
    if not store.shards:
        return spark.createDataFrame([], schema)
    path, dtype, base, parts, n_parts = store.path, store.dtype, store.base, store.parts, len(store.parts)
    names = [name for name, _, _ in store.shards]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                key, known, size = _read_keys(f"{path}/{names[shard]}.keys")
                system, at = fs.FileSystem.from_uri(f"{path}/{names[shard]}.ids")
                crcs = np.empty(len(key), np.int64)
                with system.open_input_stream(at, buffer_size=1 << 20) as file:
                    for i, n in enumerate(size.tolist()):
                        ids = np.frombuffer(file.read(n * np.dtype(dtype).itemsize), dtype)
                        crcs[i] = zlib.crc32(ids.astype("<u4"))
                part = np.where(known, _part_of(key, n_parts), -1)
                yield pa.RecordBatch.from_pydict({
                    "part": part, "key": pa.array(key, mask=~known), "shard": np.full(len(key), shard), "offset": np.cumsum(size) - size, "n_tokens": size, "ids_crc32": crcs,
                })

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, known = batch.column("key").fill_null(0).to_numpy(), ~batch.column("key").is_null().to_numpy(zero_copy_only=False)
            part, shard, offset = (batch.column(c).to_numpy() for c in ("part", "shard", "offset"))
            start, indexed = base[shard] + offset, np.zeros(len(key), bool)
            for p in np.unique(part[known]):
                at = np.flatnonzero(known & (part == p))
                entries, there = _index_part(f"{path}/{parts[p]}").find(key[at])
                found = base[entries["shard"].astype(np.int64)] + entries["offset"].astype(np.int64)
                here = there & (found == start[at])
                indexed[at] = here | there & (entries["copies"] > 1) & (found < start[at])
                start[at[here]] = found[here]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(start), batch.column("n_tokens"), batch.column("ids_crc32"), pa.array(indexed)], names=[id_col, "start", "n_tokens", "ids_crc32", "indexed"])

    rows = _shard_frame(spark, store.shards).mapInArrow(read, "part long, key long, shard long, offset long, n_tokens long, ids_crc32 long")
    # A part with very many rows (copies of one key, or rows without) is split.
    return rows.hint("rebalance", "part").mapInArrow(look_up, schema)
