"""The pipeline against a brute-force version, stage by stage and as a whole."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from corpusrank.llm import bytetext as bt
from corpusrank.llm import decontaminate, pfair, resample
from tests.llm.test_edges import brute_links

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """Ids (and texts) by stage, by brute force."""
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    size = 1 << resample.BITS
    grams = {}
    for d, r in docs.items():
        data = np.frombuffer((r["text"] or "").encode(), np.uint8)
        grams[d] = resample._buckets(data, np.array([0, len(data)]), resample.BITS)[0]
    raw = sum(np.bincount(g, minlength=size) for g in grams.values())
    target = sum(np.bincount(grams[d], minlength=size) for d in docs if labels.get(d) == 1)
    means = {}
    for d, g in grams.items():
        own = target - np.bincount(g, minlength=size) if labels.get(d) == 1 else target
        ratio = np.log((own[g] + 1) / (own.sum() + size)) - np.log((raw[g] + 1) / (raw.sum() + size))
        means[d] = ratio.mean() if len(g) else None
    rated = [(means[d], y) for d, y in labels.items() if d in docs and means[d] is not None]
    cuts = np.arange(-resample.LIMIT * resample.BINS_PER_NAT, resample.LIMIT * resample.BINS_PER_NAT + 1)
    bins = np.floor(np.array([m for m, _ in rated]) * resample.BINS_PER_NAT)
    y = np.array([y for _, y in rated])
    right = np.array([(bins[y == 0] < c).mean() - (bins[y == 1] < c).mean() for c in cuts])
    best = np.flatnonzero(right >= right.max() - 1e-12)
    run = best[: np.argmax(np.diff(np.concatenate([best, [10**9]])) > 1) + 1]
    threshold = (cuts[run[0]] + cuts[run[-1]]) / 2 / resample.BINS_PER_NAT
    model = resample.Resampler(raw, target, threshold, resample.TEMPERATURE, 17)
    noisy = spark.createDataFrame([(d, float(m), len(grams[d])) for d, m in means.items() if m is not None], "id long, mean double, n long").withColumn("key", resample.gumbel_key(model, "id", "mean", "n"))
    keys = {r["id"]: r["key"] for r in noisy.collect()}
    k = sum(m is not None and m >= threshold for m in means.values())
    stages = [sorted(sorted(keys, key=lambda d: -keys[d])[:k])]
    _, _, root = brute_links([docs[d]["text"] for d in stages[-1]])
    stages.append([d for i, d in enumerate(stages[-1]) if root[i] == i])
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (w := words(r["text"])) for i in range(max(1, len(w) - 9))}
    lengths = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[i : i + n]) in windows for n in lengths for i in range(len(w) - n + 1))
    stages.append([d for d in stages[-1] if not hit(words(docs[d]["text"]))])
    names = sorted({docs[d]["source"] for d in stages[-1]})
    by = {s: [d for d in stages[-1] if docs[d]["source"] == s] for s in names}
    plan = pfair.Plan([len(by[s]) for s in names], [len(by[s]) ** 0.5 for s in names], pfair.BLOCK_DOCS)
    order = sorted((int(p), d) for i, s in enumerate(names) for p, d in zip(plan.place(i, np.arange(len(by[s])))["position"], by[s]))
    stages.append([d for _, d in order])
    return docs, stages


def test_stages(spark, kept, tmp_path):
    docs, want = kept
    at = spark.read.parquet(f"{SF}/documents.parquet")
    columns = at.columns
    for i, (name, stage) in enumerate(cp.STAGES[:-1]):
        made = stage(spark, at, SF)
        assert made.columns == columns, name
        made.write.parquet(str(tmp_path / str(i)))
        at = spark.read.parquet(str(tmp_path / str(i)))
        assert sorted(r["doc_id"] for r in at.select("doc_id").collect()) == sorted(want[i]), name


def test_run(spark, kept):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, stages = kept
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    for d in stages[-1]:
        ids = np.array([*tokenizer.encode(docs[d]["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = cp.run(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()
    assert [tuple(r) for r in got] == want


def test_empty_and_odd_documents(spark, tmp_path):
    rows = [(1, None, "en", None, None), (None, "a b c", "en", "s", 5), (2, "", None, "s", 0), (2, "", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        at = some
        for _, stage in cp.STAGES:
            at = stage(spark, at, SF)
        assert at.count() <= len(rows)


def test_entry_has_the_pipeline():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is cp.run and bt and decontaminate and F
