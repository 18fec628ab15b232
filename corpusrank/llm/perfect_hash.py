"""Minimal perfect hashing of 64-bit keys: levels of bit arrays, ranked by popcount."""

from __future__ import annotations

import io

import numpy as np

from .bytetext import U64, mix

_GAMMA = 1.6


def _place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix(keys + U64((level * 0x9E3779B97F4A7C15 + 0x51ED270B) & (2**64 - 1))) % U64(bits)).astype(np.int64)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ U64(0xA0761D6478BD642F)) >> U64(32)).astype(np.uint32)


class PerfectHash:
    """Maps n distinct keys to 0..n-1; keys of another set map anywhere or to -1."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
        self.at = np.concatenate([[0], np.cumsum([-(-s // 64) for s in sizes])]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, parts, level = keys.astype(U64), [], [], 0
        while len(left):
            bits = max(64, -(-int(len(left) * _GAMMA) // 64) * 64)
            place = _place(left, level, bits)
            alone = np.bincount(place, minlength=bits) == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(bits)
            left = left[~alone[place]]
            level += 1
            if level > 500:
                raise ValueError("keys must be distinct")
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, "<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(U64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, bits in enumerate(self.sizes):
            place = _place(keys[open_], level, bits)
            word = self.at[level] + place // 64
            bit = (place % 64).astype(U64)
            is_set = (self.words[word] >> bit) & U64(1) == 1
            below = self.words[word] & ((U64(1) << bit) - U64(1))
            rank = self.before[word] + np.bitwise_count(below)
            out[open_[is_set]] = rank[is_set]
            open_ = open_[~is_set]
        return out


class IndexPart:
    """One part of the index: perfect hash, and per slot the fingerprint, shard, offset, ids and copies."""

    FIELDS = (("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n_tokens", "<u8"), ("copies", "<u4"))

    def __init__(self, perfect: PerfectHash, entries: np.ndarray):
        self.perfect, self.entries = perfect, entries

    @classmethod
    def build(cls, keys: np.ndarray, shard: np.ndarray, offset: np.ndarray, n_tokens: np.ndarray, copies: np.ndarray) -> IndexPart:
        perfect = PerfectHash.build(keys)
        entries = np.zeros(len(keys), list(cls.FIELDS))
        slots = perfect.slots(keys)
        for name, values in (("print", fingerprint(keys.astype(U64))), ("shard", shard), ("offset", offset), ("n_tokens", n_tokens), ("copies", copies)):
            entries[name][slots] = values
        return cls(perfect, entries)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of keys, and whether each is there by its fingerprint."""
        slots = self.perfect.slots(keys)
        if not len(self.entries):
            return np.zeros(len(keys), list(self.FIELDS)), np.zeros(len(keys), bool)
        entries = self.entries[np.maximum(slots, 0)]
        return entries, (slots >= 0) & (entries["print"] == fingerprint(keys.astype(U64)))

    def dump(self) -> bytes:
        file = io.BytesIO()
        np.savez(file, sizes=np.array(self.perfect.sizes, np.int64), words=self.perfect.words, entries=self.entries)
        return file.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> IndexPart:
        with np.load(io.BytesIO(raw)) as z:
            return cls(PerfectHash(z["sizes"].tolist(), z["words"]), z["entries"])
