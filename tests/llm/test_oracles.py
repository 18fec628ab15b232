"""Queries against their oracle SQL, or against brute force where SQL can't express them."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusrank.llm import queries as q

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def documents(spark, data):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_against_oracle(name, same):
    same(q.queries()[name], q.oracle_sql()[name])


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in q.queries()) == list(range(1, 11))


def test_token_ids(spark, data, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(q.TOKENIZER))
    want, start = [], 0
    for doc_id, text in sorted(documents):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), True))
        start += len(ids)
    got = q.op2_token_index(spark, data).select("doc_id", "start", "n_tokens", "ids_crc32", "indexed").collect()
    assert sorted(map(tuple, got)) == want


def rule_counts(text):
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


def test_rules(spark, data, documents):
    got = {r["doc_id"]: tuple(r[1:7]) for r in q.op3_isolation_rules(spark, data).collect()}
    assert got == {d: rule_counts(t or "") for d, t in documents}


@pytest.mark.parametrize("name", ["op3_isolation_rules", "op6_importance_resample"])
def test_verdicts_follow_labels(name, spark):
    """At the larger size clean documents stay and junk goes."""
    d = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in q.queries()[name](spark, d).collect() if r["doc_id"] in labels and not ("base_failed" in r and r["base_failed"])]
    kept = {y: np.mean([r["kept"] for r in rows if labels[r["doc_id"]] == y]) for y in (0, 1)}
    assert kept[1] > 0.97 and kept[0] < 0.1


def test_resampling(spark, data, documents):
    """The query against plain loops: own n-grams, models, threshold, noise and top k."""
    import struct

    import xxhash

    from corpusrank.llm import bytetext as bt

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    mask = 2**64 - 1

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    hashes = {}

    def word_hash(word):
        if word not in hashes:
            raw = np.frombuffer(word.encode(), np.uint8)
            hashes[word] = int(bt.span_hashes(raw, np.array([0]), np.array([len(raw)]))[0])
        return hashes[word]

    size, grams = 1 << 18, {}
    for d, text in documents:
        words = [word_hash(w) for w in WORD.findall(lower(text or ""))]
        pairs = [mixed(mixed(2 * 0x9FB21C651E98DF25 + a & mask) * 0x9FB21C651E98DF25 + b & mask) for a, b in zip(words, words[1:])]
        grams[d] = Counter(h >> 46 for h in words + pairs)
    raw, target = Counter(), Counter()
    for d, own in grams.items():
        raw.update(own)
        target.update(own if labels.get(d) == 1 else ())
    all_raw, all_target, means = sum(raw.values()), sum(target.values()), {}
    for d, own in grams.items():
        seen = {g: target[g] - (own[g] if labels.get(d) == 1 else 0) for g in own}
        total = all_target - (sum(own.values()) if labels.get(d) == 1 else 0)
        if own:
            means[d] = sum(c * (math.log((seen[g] + 1) / (total + size)) - math.log((raw[g] + 1) / (all_raw + size))) for g, c in own.items()) / sum(own.values())
    bins = {d: math.floor(max(-20, min(20, means[d])) * 500) for d in means}
    rated = [(bins[d], labels[d]) for d in means if d in labels]
    share = lambda y, ok: sum(ok(b) for b, v in rated if v == y) / sum(v == y for _, v in rated)
    gains = {c: share(0, lambda b: b < c) - share(1, lambda b: b < c) for c in range(-10_000, 10_002)}
    top = [c for c, g in gains.items() if g >= max(gains.values()) - 1e-12]
    run = next(i for i in range(1, len(top) + 1) if i == len(top) or top[i] != top[i - 1] + 1)
    threshold = (top[0] + top[run - 1]) / 2 / 500
    keys = {}
    for d, m in means.items():
        h = 42
        for part in (struct.pack("<q", d), struct.pack("<q", sum(grams[d].values())), struct.pack("<i", 17)):
            h = xxhash.xxh64_intdigest(part, seed=h)
        keys[d] = m / 0.01 - math.log(-math.log(((h >> 11) + 0.5) / 2.0**53))
    k = sum(m >= threshold for m in means.values())
    kept = set(sorted(keys, key=lambda d: -keys[d])[:k])
    got = {r["doc_id"]: r for r in q.op6_importance_resample(spark, data).collect()}
    assert {d for d, r in got.items() if r["kept"]} == kept
    assert all(got[d]["n_grams"] == sum(grams[d].values()) and (got[d]["log_weight"] == pytest.approx(means[d], abs=1e-8) if d in means else got[d]["log_weight"] is None) for d in grams)


def test_language_model(spark, data, documents):
    counts, held = Counter(), {}
    for doc_id, text in documents:
        held[doc_id] = zlib.crc32(str(doc_id).encode()) % 7 == 2
        if not held[doc_id]:
            counts.update([*WORD.findall(lower(text or "")), None])
    total, types = sum(counts.values()), len(counts)
    texts = dict(documents)
    rows = q.op10_lm_scores(spark, data).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    base = model = 0.0
    for r in rows:
        words = [*WORD.findall(lower(texts[r["doc_id"]] or "")), None]
        want = sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in words)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(words), sum(counts[w] > 0 for w in words), total)
        assert r["base_score"] == pytest.approx(want)
        if r["held_out"]:
            base += r["base_score"]
            model += r["score"]
    assert model > base


def test_mix(spark, data, documents):
    rows = sorted(q.op9_pfair_mix(spark, data).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(len(documents)))
    assert sorted(r["doc_id"] for r in rows) == sorted(d for d, _ in documents)
    # The fluid mix and earliest-deadline-first, slot by slot.
    sizes = Counter(r["source"] for r in rows)
    names = sorted(sizes)
    blocks, weight = {s: -(-sizes[s] // 16) for s in names}, {s: sizes[s] ** 0.5 for s in names}
    fluid = lambda v: round(sum(min(blocks[s], v * weight[s]) for s in names), 7)
    windows = [(math.ceil(fluid((j + 1) / weight[s])), at, s, j, math.floor(fluid(j / weight[s]))) for at, (s, j) in enumerate((s, j) for s in names for j in range(blocks[s]))]
    slots = {}
    for slot in range(len(windows)):
        deadline, _, s, j, _ = best = min(w for w in windows if w[4] <= slot)
        assert slot < deadline
        slots[s, j] = slot
        windows.remove(best)
    assert all(slots[r["source"], r["block"]] == r["slot"] for r in rows)
