"""Token ids of whole texts with the ``tokenizers`` library, each distinct word encoded once.

The tokenizer cuts a normalised text into pieces and encodes each on its own, so equal pieces have
equal ids.  For texts of ASCII and the letters U+00C0-U+00FF the pieces are found with numpy; only
pieces not met before go through the library.  Every other text (and any with ``<|``, where special
tokens may stand) goes through the library whole.
"""

from __future__ import annotations

import json
import os
from functools import cached_property

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

from . import bytetext as bt

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CLASS = np.zeros(256, np.uint8)  # 0 space, 1 letter, 2 digit, 3 other
_CLASS[0x21:0x7F] = 3
_CLASS[0x30:0x3A] = 2
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = 1
_CLASS[0x80:] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LOWER[0x80:0x9F] += 32
_FAST = np.zeros(256, bool)
_FAST[0x20:0x7F] = _FAST[[9, 10, 13]] = True
_FAST[0x80:0xC0] = _FAST[0xC3] = True
MAX_CACHED = 3_000_000
"""Most words a worker remembers (about 100 MB); beyond it starts anew."""


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: for each letter U+00C0-U+00FF the signs that stand for its bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in signs:
            signs[b] = chr(256 + len(signs) - len(plain))
    return {c: "".join(signs[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class _Segment:
    def __init__(self, keys: np.ndarray, at: np.ndarray, size: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.at, self.size = keys[order], at[order].astype(np.int32), size[order].astype(np.int32)


class WordIds:
    """Encodes texts; remembers the ids of words."""

    def __init__(self, path: str):
        self.path = path
        self.words = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.words.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path) as file:
            spec = json.load(file)
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        cutters = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.fast = (
            kinds == ["NFC", "Replace", "Lowercase"] and len(cutters) == 2 and cutters[0].get("pattern", {}).get("Regex") == _PATTERN
            and cutters[1]["type"] == "ByteLevel" and spec["model"].get("end_of_word_suffix") == "</w>" and all(a["content"].startswith("<|") for a in spec["added_tokens"])
        )
        if self.fast:
            vocab = self.words.get_vocab()
            self.words.normalizer = None
            self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.letters = _byte_letters()
            self.is_last = np.zeros(max(vocab.values()) + 1, bool)
            self.is_last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self._forget()

    @cached_property
    def whole(self) -> Tokenizer:
        """The tokenizer as it is, loaded when a text needs it."""
        return Tokenizer.from_file(self.path)

    def _forget(self) -> None:
        self.segments: list[_Segment] = []
        self.pool = np.zeros(1 << 16, self.dtype)
        self.used = 0

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, size = np.zeros(len(keys), np.int32), np.zeros(len(keys), np.int32)
        for s in self.segments:
            k = np.minimum(np.searchsorted(s.keys, keys), len(s.keys) - 1)
            hit = s.keys[k] == keys
            at[hit], size[hit] = s.at[k[hit]], s.size[k[hit]]
        return at, size

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        joined = b" ".join(words).decode().translate(self.letters)
        ids = np.array(self.words.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(self.is_last[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("the tokenizer's words don't end as its suffix says")
        sizes = np.diff(np.concatenate([[0], ends]))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.segments.append(_Segment(keys, self.used + ends - sizes, sizes))
        self.used += len(ids)
        while len(self.segments) > 1 and len(self.segments[-1].keys) * 2 >= len(self.segments[-2].keys):
            b, a = self.segments.pop(), self.segments.pop()
            self.segments.append(_Segment(*(np.concatenate([x, y]) for x, y in ((a.keys, b.keys), (a.at, b.at), (a.size, b.size)))))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and the number of ids of each row."""
        rows = len(offsets) - 1
        if self.fast:
            slow = self._slow_rows(data, offsets)
        else:
            slow = np.ones(rows, bool)
        texts = [data[offsets[r] : offsets[r + 1]].tobytes().decode() for r in np.flatnonzero(slow)]
        ids, counts = self._encode_fast(data, offsets, slow) if not slow.all() else (np.zeros(0, self.dtype), np.zeros(rows, np.int64))
        if texts:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for r, e in zip(np.flatnonzero(slow), self.whole.encode_batch_fast(texts, add_special_tokens=False)):
                parts[r] = np.array(e.ids, self.dtype)
                counts[r] = len(parts[r])
            ids = np.concatenate(parts)
        return ids, counts

    @staticmethod
    def _slow_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        odd = ~_FAST[data]
        if len(data) > 1:
            odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
            odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        slow = np.zeros(len(offsets) - 1, bool)
        slow[np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1] = True
        return slow

    def _encode_fast(self, data: np.ndarray, offsets: np.ndarray, slow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(offsets) - 1
        kind = _CLASS[data]
        low = _LOWER[data]
        for r in np.flatnonzero(slow):
            kind[offsets[r] : offsets[r + 1]] = 0
        n = len(data)
        head, tail = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            single = kind == 2
            differs = kind[1:] != kind[:-1]
            head[1:] = differs
            tail[:-1] = differs
            heads, tails = offsets[:-1], offsets[1:]
            head[heads[heads < n]] = True
            tail[tails[tails > 0] - 1] = True
            head |= single
            tail |= single
            head &= kind > 0
            tail &= kind > 0
        starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
        starts, ends = self._contractions(low, kind, starts, ends, offsets)
        of_row = np.searchsorted(offsets, starts, "right") - 1
        unique, first, inverse = np.unique(bt.span_hashes(low, starts, ends), return_index=True, return_inverse=True)
        at, size = self._find(unique)
        new = np.flatnonzero(size == 0)
        if len(new):
            if sum(len(s.keys) for s in self.segments) + len(new) > MAX_CACHED:
                self._forget()
                new = np.arange(len(unique))
            raw = low.tobytes()
            self._learn(unique[new], [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            at, size = self._find(unique)
        at, size = at[inverse], size[inverse]
        total = np.cumsum(size)
        place = np.repeat((at - (total - size)).astype(np.int32), size)
        place += np.arange(len(place), dtype=np.int32)
        ids = self.pool[place]
        return ids, np.bincount(of_row, weights=size, minlength=rows).astype(np.int64)

    @staticmethod
    def _contractions(low: np.ndarray, kind: np.ndarray, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A lone apostrophe takes a following s, t, m, d, re, ve or ll from the word after it."""
        lone = np.flatnonzero((low[starts] == 0x27) & (ends - starts == 1))
        lone = lone[lone + 1 < len(starts)]
        lone = lone[(starts[lone + 1] == ends[lone]) & (kind[starts[lone + 1]] == 1)]
        lone = lone[~np.isin(ends[lone], offsets)]
        if not len(lone):
            return starts, ends
        begin, stop = starts[lone + 1], ends[lone + 1]
        one = low[begin]
        two = np.where(stop - begin > 1, low[np.minimum(begin + 1, len(low) - 1)], 0)
        is_pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        take = np.where(np.isin(one, list(b"stmd")), 1, np.where(is_pair, 2, 0))
        lone, take = lone[take > 0], take[take > 0]
        starts, ends = starts.copy(), ends.copy()
        ends[lone] += take
        starts[lone + 1] += take
        left = starts < ends
        return starts[left], ends[left]


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """This process's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]
