"""Nulls, empty and long texts, ties, repeated rows, empty tables, and extra columns with clashing names."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusrank.llm import decontaminate, html_extract, isolation, jaccard, line_runs, lm_score, pfair, preference, resample, token_store

EXTRA = ("id", "k", "key", "n", "row", "bucket", "mean", "target", "position", "r", "gone", "kept", "score", "value", "part", "text_")
BASE = " ".join(f"word{i}" for i in range(60))
NEAR = BASE.replace("word30 ", "changed ")
TEXTS = [
    (1, BASE, "a"), (2, BASE, "a"), (3, NEAR, "b"), (4, BASE.upper(), "b"), (5, None, None), (6, "", "a"), (7, " \n\t ", "a"), (None, BASE + " tail", "c"), (9, "one", "a"), (9, "one", "a"),
    (10, "one two", "a"), (11, "The quick\nbrown fox\nThe quick\nbrown fox\njumps", "a"), (12, "lazy " * 30_000, "a"), (13, "Ünï¢ödé 日本語 <|endoftext|> it's", "d"), (14, "x" * 200_000, "d"),
]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, SCHEMA).repartition(3).withColumns({n: F.lit("x") for n in EXTRA}).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 1), (3, 1), (12, 0), (12, 1), (None, 1), (9, None)], "doc_id long, quality int")


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def ids(rows):
    return Counter(r["doc_id"] for r in rows)


EVERY = Counter(t[0] for t in TEXTS)


def test_tokens(spark, docs, none, tokenizer):
    store = token_store.write_store(docs, tokenizer)
    rows = token_store.read_store(spark, store).collect()
    assert ids(rows) == EVERY and all(r["indexed"] for r in rows if r["doc_id"] is not None) and not any(r["indexed"] for r in rows if r["doc_id"] is None)
    by_start = sorted(rows, key=lambda r: r["start"])
    assert [r["start"] for r in by_start] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in by_start])[:-1]]).tolist()
    known = [r["doc_id"] for r in by_start if r["doc_id"] is not None]
    assert known == sorted(known)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer)
    for doc_id, text, _ in TEXTS:
        if doc_id is not None:
            assert store.get(doc_id).tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 1]
    assert store.get(12345) is None
    empty = token_store.write_store(none, tokenizer)
    assert token_store.read_store(spark, empty).count() == 0 and empty.get(1) is None
    ordered = token_store.read_store(spark, token_store.write_store(docs, tokenizer, order_by=["source", "doc_id"]))
    assert ordered.where("start = 0").first()["doc_id"] == 5


def test_rules(docs, none, labels):
    rows = isolation.quality_rules(docs, labels).collect()
    assert ids(rows) == EVERY
    got = {r["doc_id"]: r for r in rows}
    assert got[5]["n_words"] == 0 and got[5]["base_failed"] and not got[5]["kept"] and got[12]["base_failed"] and got[14]["n_words"] == 1
    assert got[11]["n_dup_lines"] == 2
    assert isolation.quality_rules(none, labels).count() == 0
    assert {r["kept"] for r in isolation.quality_rules(docs, labels.limit(0)).where("not base_failed").collect()} == {True}


def test_contamination(spark, docs, none):
    items = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(20, 32)), "z"), (1, "x", "z"), (2, "One", "z"), (3, None, "z"), (4, "", "z"), (None, "lazy", "z"), (5, "ONE", "z")], "item_id long, text string, n_words string")
    rows = decontaminate.contamination(docs, items).collect()
    assert ids(rows) == EVERY
    got = {r["doc_id"]: r for r in rows}
    assert got[1]["n_hit"] == 12 and got[1]["n_items"] == 1 and got[3]["n_hit"] == 10 and got[9]["n_items"] == 2 and not got[12]["contaminated"] and got[5]["n_words"] == 0
    assert got[4]["contaminated"] and [tuple(s) for s in got[9]["spans"]] == [(0, 3)]
    assert decontaminate.keep_clean(docs, items).where("doc_id in (1, 2, 3, 4, 9, 10)").count() == 0
    assert decontaminate.keep_clean(docs, items).columns == docs.columns
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0


def test_contamination_in_blocks(docs, spark, monkeypatch):
    items = spark.createDataFrame([(i, f"word{i} word{i + 1}") for i in range(40)], "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.contamination(docs, items).drop("spans").fillna(-1).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    assert sorted(map(tuple, decontaminate.contamination(docs, items).drop("spans").fillna(-1).collect())) == whole


def brute_links(texts, size=5, num=80, den=100):
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    n = len(sets)
    linked = [[i != j and bool(sets[i]) and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if linked[i][j]:
                    root[i] = root[j] = min(root[i], root[j])
    return [len(s) for s in sets], [sum(r) for r in linked], root


def test_jaccard(docs, none):
    rows = jaccard.jaccard_links(docs).collect()
    assert ids(rows) == EVERY
    sizes, similar, root = brute_links([t[1] for t in TEXTS])
    least = [min((TEXTS[j][0] for j in range(len(TEXTS)) if root[j] == root[i] and TEXTS[j][0] is not None), default=None) for i in range(len(TEXTS))]
    want = Counter((TEXTS[i][0], sizes[i], similar[i], least[i]) for i in range(len(TEXTS)))
    assert Counter(map(tuple, rows)) == want
    assert jaccard.jaccard_links(none).count() == 0


@pytest.mark.parametrize("tile", [256, 4])
def test_jaccard_against_brute_force(spark, tile, monkeypatch):
    """Groups of near copies around a passage that all share, small tiles as well as large."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    rng = np.random.default_rng(tile)
    shared = [f"s{i}" for i in range(40)]
    texts = []
    for group in range(6):
        base = [f"g{group}w{i}" for i in range(rng.integers(30, 90))]
        for _ in range(int(rng.integers(3, 30))):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[rng.integers(len(w))] = f"u{rng.integers(10**6)}"
            texts.append(" ".join(w + shared[: int(rng.integers(0, 40))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sizes, similar, root = brute_links(texts)
    got = sorted(tuple(r) for r in jaccard.jaccard_links(docs).collect())
    assert got == [(i, sizes[i], similar[i], root[i]) for i in range(len(texts))]
    assert sum(similar) > 50


def test_resampling(docs, none, labels):
    rows = resample.importance_resample(docs, labels).collect()
    assert ids(rows) == EVERY
    got = {r["doc_id"]: r for r in rows}
    assert got[1]["kept"] and got[2]["kept"] and not got[12]["kept"] and not got[5]["kept"] and got[5]["log_weight"] is None
    kept = resample.keep_resampled(docs, labels)
    assert kept.columns == docs.columns and ids(kept.collect()) == ids([r for r in rows if r["kept"]])
    assert resample.importance_resample(none, labels).count() == 0
    assert {r["kept"] for r in resample.importance_resample(docs, labels.limit(0)).where("n_grams > 0").collect()} == {True}


def test_resampling_share(spark):
    """k is a share of all rows; the noise, not the threshold, says which."""
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(f"{'good' if rng.random() < 0.5 + 0.01 * (i % 7) else 'bad'}{rng.integers(20)}" for _ in range(40))) for i in range(400)]
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 7 > 3)) for i in range(0, 400, 2)], "doc_id long, quality int")
    rows = resample.importance_resample(docs, labels, share=0.25)
    got = rows.collect()
    assert sum(r["kept"] for r in got) == 100
    by_weight = {r["doc_id"] for r in sorted(got, key=lambda r: -r["log_weight"])[:100]}
    assert {r["doc_id"] for r in got if r["kept"]} != by_weight
    assert sum(r["inclusion"] for r in got) == pytest.approx(100, abs=25)
    assert 1 < resample.effective_size(rows.where("kept")) <= 100


def test_kth_largest(spark):
    values = [3.0, -1.5, 3.0, 0.0, -0.0, 1e300, -1e300, 2.5, float("-inf")]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "key double").repartition(3)
    for k in range(1, 10):
        assert resample.kth_largest(df, k) == sorted(values, reverse=True)[k - 1]
    assert resample.kth_largest(df, 11) == -np.inf and resample.kth_largest(df, 0) == np.inf


def test_kth_largest_keeps_python_out_of_its_passes(spark, monkeypatch):
    """No pass runs Python: with the filter on what the function gives, each task held two workers."""
    df = spark.range(1000).selectExpr("cast(id as double) as key")
    plans, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or collect(d))
    assert resample.kth_largest(df, 10) == 990.0
    assert len(plans) == 4 and not any("Python" in p or "ArrowEval" in p for p in plans)


def brute_runs(docs, min_lines, min_words):
    """Deleted lines: those in any run that has occurred before, of any length, with enough lines and words."""
    lines = {k: [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)] for k, t in docs}
    gone, seen = set(), set()
    for k in sorted(lines):
        for i in range(len(lines[k])):
            for j in range(i + 1, len(lines[k]) + 1):
                run = tuple(lines[k][i:j])
                if run in seen and len(run) >= min_lines and len(" ".join(run).split()) >= min_words:
                    gone.update((k, at) for at in range(i, j))
            seen.update(tuple(lines[k][i:j]) for j in range(i + 1, len(lines[k]) + 1))
    return Counter(k for k, _ in gone)


@pytest.mark.parametrize("min_lines, min_words", [(1, 1), (1, 4), (2, 1), (3, 9), (5, 1), (1, 13)])
def test_line_runs(spark, min_lines, min_words):
    rng = np.random.default_rng(min_lines + min_words)
    texts = [(i, "\n".join(rng.choice(["a b", "c", "d e f", "", "g", "long line of words"], rng.integers(0, 14)))) for i in range(40)] + [(40, None), (41, "\n".join(["same"] * 30))]
    texts += [(42, "\n".join(["head", "c", "d e f", "a b", "g"] * 4)), (43, "\n".join(["other", "c", "d e f", "a b", "g"] * 3))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    rows = line_runs.dedup_line_runs(docs, min_lines=min_lines, min_words=min_words).collect()
    want = brute_runs(texts, min_lines, min_words)
    assert {r["doc_id"]: r["n_deleted"] for r in rows} == {k: want[k] for k, _ in texts}
    assert all(r["longest_run"] <= r["n_deleted"] and (r["n_runs"] > 0) == (r["n_deleted"] > 0) for r in rows)


def test_line_runs_count_all_words_of_a_run(spark):
    """Three lines of ten words repeat, which no two of them would; names as ids."""
    line = [" ".join(f"{c}{i}" for i in range(10)) for c in "xyz"]
    docs = spark.createDataFrame([("a", "\n".join(["one", *line, "two"])), ("b", "\n".join(["three", *line, "four", *line[:2]]))], "doc_id string, text string").coalesce(1)
    got = {r["doc_id"]: (r["n_deleted"], r["longest_run"], r["text"]) for r in line_runs.dedup_line_runs(docs).collect()}
    assert got == {"a": (0, 0, "\n".join(["one", *line, "two"])), "b": (3, 3, "\n".join(["three", "four", *line[:2]]))}


def test_line_runs_edges(docs, none):
    rows = line_runs.dedup_line_runs(docs).collect()
    assert ids(rows) == EVERY
    got = {r["doc_id"]: r for r in rows}
    assert got[11]["text"].count("fox") == 2 and got[11]["n_deleted"] == 0 and got[5]["text"] == "" and got[12]["n_lines"] == 1
    assert sum(r["n_deleted"] for r in rows if r["doc_id"] in (1, 2)) == 1
    assert line_runs.dedup_line_runs(none).count() == 0


def test_pages(spark):
    page = "<body><nav><a>x</a></nav><article><h1>T</h1><p>one two three</p></article><footer>f</footer></body>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "<p>" + "long " * 50_000 + "</p>"), (4, "w", "<" * 1000), (5, "w", "<div" * 1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"id": F.lit(1), "text": F.lit(2), "n_chars": F.lit(3)})
    got = html_extract.extract_pages(pages).collect()
    assert Counter(r["page_id"] for r in got) == Counter(r[0] for r in rows)
    assert {r["text"] for r in got if r["page_id"] == 1} == {"T\none two three"} and all(r["n_chars"] == len(r["text"]) for r in got)
    assert next(r for r in got if r["page_id"] == 3)["n_chars"] == 5 * 50_000 - 1
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_mix(spark, docs, none):
    rows = pfair.mix_schedule(docs, block_docs=2).collect()
    assert ids(rows) == EVERY and sorted(r["position"] for r in rows) == list(range(len(TEXTS)))
    mixed = pfair.mix_documents(docs, block_docs=2)
    assert mixed.columns == docs.columns and ids(mixed.collect()) == EVERY
    assert pfair.mix_schedule(none).count() == 0 and pfair.mix_documents(none).count() == 0
    with pytest.raises(ValueError):
        pfair.mix_schedule(docs, weights={"a": 0.0}).collect()
    many = spark.range(2000).selectExpr("id as doc_id", "cast(id as string) as source")
    with pytest.raises(ValueError, match="sources"):
        pfair.mix_schedule(many, max_sources=512).collect()


def test_mix_blocks_grow(spark, monkeypatch):
    """The plan's size is bounded by larger blocks, also with names as ids and columns of the same names."""
    monkeypatch.setattr(pfair, "MAX_BLOCKS", 10)
    docs = spark.range(1000).selectExpr("concat('d', id) as doc_id", "if(id % 4 = 0, 'a', 'b') as source", "1 as mix_key", "2 as mix_position")
    rows = pfair.mix_schedule(docs, block_docs=2).collect()
    assert sorted(r["position"] for r in rows) == list(range(1000)) and max(r["block"] for r in rows) < 10 and len({r["doc_id"] for r in rows}) == 1000
    mixed = pfair.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.agg(F.sum("mix_key"), F.sum("mix_position")).first() == (1000, 2000)


def test_mix_blocks_keep_their_size(spark):
    """Blocks are as large as asked for, in a table of more than two million blocks too."""
    rows = pfair.mix_schedule(spark.range(2_200_000).selectExpr("id as doc_id", "if(id % 4 = 0, 'a', 'b') as source"), block_docs=1)
    got = rows.agg(F.count("*"), F.sum((F.col("slot") != F.col("position")).cast("int")), F.max("position"), F.sum("position"), F.max(F.when(F.col("source") == "a", F.col("block"))), F.min(F.col("deadline") - F.col("slot"))).first()
    assert got[:5] == (2_200_000, 0, 2_199_999, 2_200_000 * 2_199_999 // 2, 549_999) and got[5] > 0


def test_tokens_of_one_key(spark, tokenizer):
    """Very many rows of one id, and without one, spread over shards and always come in the same order."""
    docs = spark.range(6000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 7, id)) as doc_id", "concat('text ', id % 1500) as text")
    layouts = []
    for n in (3, 8):
        store = token_store.write_store(docs.repartition(n), tokenizer, shard_bytes=1 << 13)
        assert len(store.shards) > 4 and max(k for _, k, _ in store.shards) < 3000
        layouts.append(sorted(token_store.read_store(spark, store).collect(), key=lambda r: r["start"]))
    assert layouts[0] == layouts[1] and len(layouts[0]) == 6000 and all(r["indexed"] == (r["doc_id"] is not None) for r in layouts[0])
    named = token_store.read_store(spark, token_store.write_store(spark.createDataFrame([("12", "a"), ("x", "b")], "doc_id string, text string"), tokenizer))
    assert sorted((r["doc_id"] or 0, r["indexed"]) for r in named.collect()) == [(0, False), (12, True)]


def test_tokens_start_no_other_workers(spark, tokenizer):
    """The shards' rows come from the JVM; made from Python objects they start a second kind of worker, which stays beside the first."""
    store = token_store.write_store(spark.range(50).selectExpr("id as doc_id", "concat('text ', id) as text"), tokenizer)
    assert len(store.shards) > 1
    rows = token_store.read_store(spark, store)
    assert "ExistingRDD" not in rows._jdf.queryExecution().executedPlan().toString() and rows.where("indexed").count() == 50


def test_tokens_keep_no_texts(spark, tmp_path, tokenizer):
    """A task that writes a shard keeps the keys of its batches, not their texts."""
    import tracemalloc

    import pyarrow as pa
    from pyspark import TaskContext

    held, seen = [], []

    class Frame:
        """Stands for the sorted rows: takes the task's function, and stops there."""

        def __getattr__(self, name):
            return lambda *a, **k: self

        def mapInArrow(self, function, schema):
            held.append(function)
            raise InterruptedError

    docs = spark.range(4).selectExpr("id as doc_id", "'x' as text")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(docs), "repartitionByRange", lambda *a: Frame())
        with pytest.raises(InterruptedError):
            token_store.write_store(docs, tokenizer)
    sink = pa.BufferOutputStream()
    batch = pa.record_batch({"key": pa.array([1, None, 3], pa.int64()), "text": ["word " * 50_000] * 3})
    with pa.ipc.new_stream(sink, batch.schema) as out:
        for _ in range(20):
            out.write_batch(batch)
    (tmp_path / "batches").write_bytes(sink.getvalue().to_pybytes())
    del sink

    def batches():
        with open(tmp_path / "batches", "rb") as file:
            for b in pa.ipc.open_stream(file):
                yield b
                seen.append(tracemalloc.get_traced_memory()[0])

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(TaskContext, "get", lambda: type("Context", (), {"partitionId": lambda s: 0, "taskAttemptId": lambda s: 0})())
        tracemalloc.start()
        assert [b.column("n_docs").to_pylist() for b in held[0](batches())] == [[60]]
        tracemalloc.stop()
    assert len(seen) == 20 and seen[-1] - seen[1] < 4 * batch.nbytes


def test_mix_many_sources(spark, tmp_path):
    from corpusrank.llm import queries as q

    spark.range(4000).selectExpr("id as doc_id", "concat(id % 1300, '.org') as source", "'t' as text").write.parquet(str(tmp_path / "documents.parquet"))
    rows = q.op9_pfair_mix(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(4000)) and sorted(r["position"] for r in rows) == list(range(4000))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)


def test_mix_weights(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' when id % 3 = 1 then 'b' else 'c' end as source").repartition(6)
    rows = sorted(pfair.mix_schedule(docs, weights={"hot": 0.5, "b": 0.3, "c": 0.2}, block_docs=10).collect(), key=lambda r: r["position"])
    for n in (100, 500, 1500):
        share = Counter(r["source"] for r in rows[:n])
        assert abs(share["hot"] - 0.5 * n) <= 12 and abs(share["c"] - 0.2 * n) <= 12


def test_preferences(spark):
    turns = "conv_id long, turn long, role string, text string"
    chosen = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "good"), (2, 0, "user", "same"), (3, 0, None, None), (3, None, "assistant", "end"), (4, 0, "assistant", "alone"), (None, 0, "user", "x"), (5, 0, "user", "d"), (5, 0, "user", "d")], turns)
    rejected = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "bad"), (2, 0, "user", "same"), (3, 0, None, ""), (3, None, "assistant", "other"), (5, 0, "user", "d")], turns)
    got = sorted((tuple(r) for r in preference.format_preferences(chosen.withColumn("part", F.lit(1)), rejected).collect()), key=repr)
    turn = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    want = [
        (1, "prompt", 0, turn("user", "q"), False), (1, "prompt", 1, turn("assistant", "a"), False), (1, "prompt", 2, turn("user", "r"), False), (1, "chosen", 3, turn("assistant", "good"), True), (1, "rejected", 3, turn("assistant", "bad"), True),
        (2, "prompt", 0, turn("user", "same"), False), (3, "prompt", 0, turn("unknown", ""), False), (3, "chosen", None, turn("assistant", "end"), True), (3, "rejected", None, turn("assistant", "other"), True),
        (4, "chosen", 0, turn("assistant", "alone"), False), (5, "chosen", 0, turn("user", "d"), False), (5, "chosen", 0, turn("user", "d"), False), (5, "rejected", 0, turn("user", "d"), False),
    ]
    assert got == sorted(want, key=repr)
    assert preference.format_preferences(chosen.limit(0), rejected.limit(0)).count() == 0


def test_language_model(docs, none):
    rows = lm_score.lm_scores(docs, rounds=1).collect()
    assert ids(rows) == EVERY
    got = {r["doc_id"]: r for r in rows}
    assert got[5]["n_tokens"] == 1 and got[12]["n_tokens"] == 30_001 and all(r["score"] < 0 and r["base_score"] < 0 for r in rows) and not got[None]["held_out"]
    assert got[1]["score"] == pytest.approx(got[2]["score"])
    assert lm_score.lm_scores(none).count() == 0


def test_language_model_whatever_the_layout(spark, docs):
    """Files and tasks don't change the model; ids may be strings."""
    named = docs.where("doc_id is not null and doc_id <> 9").select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    scores = [{r["doc_id"]: (r["score"], r["base_score"]) for r in lm_score.lm_scores(named.repartition(n), rounds=2).collect()} for n in (2, 7)]
    assert scores[0].keys() == scores[1].keys() and all(scores[0][d] == pytest.approx(scores[1][d], rel=1e-6) for d in scores[0])


def test_language_model_scores_by_hand(spark):
    """Scores of a tiny corpus from the trained parameters: one plain recurrence a token, and a softmax over all entries."""
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}{c}" for i in range(400) for c in "ab"]
    texts = [(i, " ".join(vocabulary[int(800 * rng.random() ** 3)] for _ in range(rng.integers(0, 60)))) for i in range(60)]
    m = lm_score.fit(spark.createDataFrame(texts, "doc_id long, text string"), rounds=1)
    v, p = m.vocabulary, m.shape.views(m.flat.astype(np.float64))
    entry = {int(h): (int(e), int(c)) for h, e, c in zip(v.h, v.entry, v.c)}
    sigmoid = lambda a: 1 / (1 + np.exp(a))
    want = {}
    for doc_id, text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        words = lm_score.Words(data, np.array([0, len(data)]))
        h, before, total = np.zeros(m.shape.hidden), 0, 0.0
        for word, look in [*zip(words.hash.tolist(), words.look.tolist()), (None, None)]:
            e, count = entry.get(word, (-1, 0)) if word is not None else (0, v.docs)
            if e < 0:
                e = 1 + look % v.bins
                total += np.log10(count + 1) - v.in_bin[look % v.bins]
            z, r = (sigmoid(p["Eg"][g, before] + h @ p["Ug"][g]) for g in (0, 1))
            n = np.tanh(p["En"][before] + r * (h @ p["Un"]))
            h = z * h + (1 - z) * n
            of_class = np.exp(h @ p["Wc"] + p["bc"])
            every = np.concatenate([c / of_class.sum() * np.exp(h @ wo + bo) / np.exp(h @ wo + bo).sum() for c, wo, bo in zip(of_class, p["Wo"], p["bo"])])
            assert every.sum() == pytest.approx(1)
            total += np.log10(every[e])
            before = e
        want[doc_id] = total
    got = {r["doc_id"]: r["score"] for r in lm_score.lm_scores(spark.createDataFrame(texts, "doc_id long, text string"), rounds=1).collect()}
    assert got == pytest.approx(want, rel=1e-5)


def test_jaccard_chain(spark):
    """A chain in which each document shares grams with the next: one component, blocks of neighbours only."""
    n = 20_000
    part = lambda i: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda j: F.concat(i.cast("string"), F.lit("w"), j.cast("string"))), " ")
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", part(F.col("id")), part(F.col("id") + 1)).alias("text")).repartition(8)
    made = []
    blocks = jaccard._blocks
    patch = pytest.MonkeyPatch()
    patch.setattr(jaccard, "_blocks", lambda *a: made.append(blocks(*a)) or made[-1])
    try:
        rows = jaccard.jaccard_links(docs)
        assert rows.agg(F.count("doc_id"), F.sum("n_similar"), F.sum((F.col("component_id") != F.col("doc_id")).cast("int")), F.sum("n_shingles")).first() == (n, 0, 0, 56 * n)
        assert n / 2 < made[0].count() < 10 * n
    finally:
        patch.undo()
