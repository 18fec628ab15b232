from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corpusrank.functions import exprs, sql_insert, tagger, udfs
from corpusrank.operators import entities, mentions
from corpusrank.sources import tables


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_spans(spark):
    sentence = spark.createDataFrame([(1, ["new", "york", "city"])], "id long, words array<string>")
    found = mentions.spans(sentence, spark.createDataFrame([("new", 3)], "word string, width int"))
    assert sorted(r["term"] for r in found.collect()) == sorted(["new york city", "new york", "new", "york city", "york", "city"])


def test_relevance_of_a_common_term_is_not_a_product(spark):
    """3,000 finds of a term with 3,000 nodes reach their join as one row a month."""
    n = 3000
    sentences = spark.range(n).selectExpr("concat('m', id % 2) as month", "id", "'red x' as title")
    nodes = spark.range(n).selectExpr("'red' as term", "id as node_id", "cast(0.5 as float) as weight")
    got = mentions.relevance(sentences, spark.createDataFrame([("red", 1)], "word string, width int"), nodes, tagger.Perceptron())
    assert got.count() == 2 * n and {round(r["relevance"], 6) for r in got.collect()} == {round(0.5 * n / 2 * 20 / (0.025 + 20), 6)}
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    last_join = next(i for i, line in enumerate(plan) if "Join Inner" in line)
    assert any("Aggregate [month" in line for line in plan[last_join + 1 : last_join + 4])


def test_spans_of_a_small_map_move_nothing(spark, monkeypatch):
    """Every sentence is cut in its own task; a large map gives the same spans, by a shuffle that splits a frequent word."""
    sentences = spark.range(60).selectExpr("id", "case id when 7 then null when 8 then array() else array('new', concat('w', id % 3), 'new', 'york', 'x') end as words", "id * 2 as other")
    widths = spark.createDataFrame([("new", 2), ("w1", 4), ("york", 1)], "word string, width int")
    small = mentions.spans(sentences, widths)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert not any(word in plan(small) for word in ("Join", "Aggregate"))
    monkeypatch.setattr(mentions, "BROADCAST_BYTES", 0)
    large = mentions.spans(sentences, widths)
    assert "salt" in plan(large) and rows(small) == rows(large) and len(rows(small)) > 300
    assert {r["other"] - 2 * r["id"] for r in small.collect()} == {0}


def test_quarters_count_from_the_end(spark):
    months = spark.createDataFrame([(f"2020-0{i}",) for i in range(1, 8)], "month string")
    sizes = mentions.quarters(months).groupBy("quarter").count().orderBy("quarter").collect()
    assert [r["count"] for r in sizes] == [1, 3, 3]


def test_tagger():
    assert tagger.best_class([0.0] * 40) == 39
    trainer = tagger.Trainer()
    for _ in range(6):
        trainer.learn(["the", "Rome"], [6, 16])
    model, accuracy = trainer.finish()
    assert [tagger.best_class(s) for s, _ in tagger.predict(model, ["the", "Rome"])] == [6, 16]
    assert 0.5 < accuracy < 1 and model.seen["Rome_0"] == 6 and tagger.predict(model, ["x"])[0][1] == 0
    short = tagger.Trainer()
    short.learn(["a"], [3])
    assert short.finish()[0].weights == {}


def test_tagger_counts_settled_sentences_without_scoring_them(monkeypatch):
    """The same model as when every sentence is scored, with fewer looks at features, and whatever is held."""
    import random

    draw = random.Random(3)
    pool = [([draw.choice("abcdef") for _ in range(n)], [draw.choice([6, 10, 16]) for _ in range(n)]) for n in (0, 1, 1, 2, 2, 3, 5)]
    lines = [draw.choice(pool) for _ in range(300)] + [pool[i % 3] for i in range(300)]
    calls, features = [], tagger.context_features
    monkeypatch.setattr(tagger, "context_features", lambda *a: calls.append(1) or features(*a))
    plain = tagger.Trainer()
    for words, tags in lines:
        plain._learn(words, tags)
    every = len(calls)
    for kept in (2, 50_000):
        calls.clear()
        monkeypatch.setattr(tagger.Trainer, "KEPT", kept)
        quick = tagger.Trainer()
        for words, tags in lines:
            quick.learn(words, tags)
        assert quick.finish() == plain.finish() and len(calls) < every
    model, _ = quick.finish()
    scorer = tagger.Scorer(model, lambda scores, seen: (scores, seen))
    assert all(scorer(words) == tagger.predict(model, words) for words, _ in lines) and len(scorer.known) <= 6 * 14


def test_tagger_in_packed_runs(spark, monkeypatch):
    """Sentences keep their order over runs and tasks; nouns are those of the full scores."""
    monkeypatch.setattr(mentions, "PACKED", 3)
    lines = [(i, [f"w{i * 7 % 5}", "x", "\u00e9t\u00e9"][: 1 + i % 3], [i % 4 + 14, 3, 17][: 1 + i % 3]) for i in range(40)]
    df = spark.createDataFrame(lines, "id long, words array<string>, tags array<int>").repartition(5)
    plain = tagger.Trainer()
    for _, words, tags in lines:
        plain._learn(words, tags)
    model, accuracy = mentions.train_tagger(df, "id")
    assert (model, accuracy) == plain.finish()
    words = F.col("words")
    got = df.select(mentions.word_nouns(model)(words).alias("a"), mentions.noun_scores(mentions.tag_words(model)(words), words).alias("b")).collect()
    assert len(got) == 40 and all(r["a"] == pytest.approx(r["b"], rel=1e-12) for r in got)


def test_noun_score_formula(spark):
    df = spark.createDataFrame([([0.0] * 16 + [2.0, 1.0] + [0.0] * 22, 5.0, "rome"), ([0.0] * 40, 0.0, "x1")], "s array<double>, o double, w string")
    got = [r[0] for r in df.select(exprs.noun_score(exprs.softmax(F.col("s")), F.col("o"), F.col("w"))).collect()]
    from math import exp

    p = exp(0) / (1 + exp(-0.5) + 38 * exp(-1))
    assert got[0] == pytest.approx((p * 5 + 20) / (p + 20)) and got[1] == 0.0


def test_domains(spark):
    df = spark.createDataFrame([("www.bbc.co.uk/news",), ("co.uk/x",), ("a.b.com:80/",), ("localhost",)], "u string")
    assert [r[0] for r in df.select(exprs.cite_domain(F.col("u"))).collect()] == ["bbc.co.uk", None, "b.com", None]
    urls = spark.createDataFrame([("https://co.uk/x",), ("http://a.example.com:8080/p?q#f",), ("a.b",)], "u string")
    got = urls.select(exprs.host_domain(exprs.url_host(F.col("u"))), exprs.url_path(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [("co.uk", "x"), ("example.com:8080", "p"), ("a.b", "")]


def store(spark, ids):
    lines = [json.dumps({"id": f"Q{i}", "sitelinks": {"enwiki": {"title": f"T{i // 2}"}}, "claims": {f"P{i % 3}": []}}) + "," for i in ids]
    return entities.store_tables(tables.entities_from_json(spark.createDataFrame([(x,) for x in ["[", *lines, "]"]], "value string")))


def test_entity_store(spark):
    runs = [range(1, 201), range(201, 401), range(401, 602)]
    made = store(spark, [i for r in runs for i in r])
    assert [r["id"] for r in made["entity"].orderBy("key").collect()] == [f"Q{i}" for i in range(1, 602)]
    small = store(spark, [1, 2, 3])
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(entities.id_range(small, "Q1", "Q3")) == ["Q1", "Q2"] and ids(entities.id_range(small, "Q1", "Q3", inclusive=True)) == ["Q1", "Q2", "Q3"]
    assert ids(entities.by_title(small, ["T1", "x"])) == ["Q3"] and ids(entities.has_prop(small, ["X1", "P9"])) == ["Q1"]
    assert rows(entities.prop_cardinality(small)) == [(0, 1), (1, 1), (2, 1)]
    assert ids(entities.query(small, '{"type": "Id", "args": ["Q2", "Q2"]}')) == ["Q2"]
    for bad, message in ((b"x", "expected text message"), ("x", "could not parse query"), ('{"type": "Id", "args": ["42"]}', "malformed IDs in args"), ('{"type": "IdRange", "args": ["Q1"]}', "could not parse query"), ('{"type": "IdRange", "args": ["Q3", "Q1"]}', "malformed IDs in args")):
        with pytest.raises(ValueError, match=message):
            entities.query(small, bad)
    pages = list(entities.response_pages(entities.id_range(small, "Q1", "Q3", inclusive=True), page_bytes=10))
    assert len(pages) == 3 and pages[0].endswith('{"has_next": 1}') and list(entities.response_pages(entities.by_id(small, ["Q9"]))) == [""]


def test_id_range_reads_its_entities_once(spark):
    """One pass over the lines for any range, an empty one too."""
    for first, last, want in (("Q3", "Q6", ["Q3", "Q4"]), ("Q6", "Q8", []), ("Q0", "Q9", ["Q1", "Q2", "Q3", "Q4"])):
        passes = spark.sparkContext.accumulator(0)
        tick = F.udf(lambda line: passes.add(1) or line, "string")
        lines = spark.createDataFrame([(f'{{"id":"Q{i}"}},',) for i in range(1, 6)], "value string").select(tick("value").alias("value"))
        tables.entities_from_json(lines).select("id").collect()
        once = passes.value
        found = entities.id_range(entities.lookup_tables(tables.entities_from_json(lines)), first, last)
        assert [r["id"] for r in found.collect()] == want and passes.value == 2 * once


def test_entity_oddities(spark):
    lines = spark.createDataFrame([('{"id":"Q1","claims":[],"sitelinks":[]},',), ("broken",), ('{"x":1}',), (None,)], "value string")
    assert [tuple(r) for r in tables.entities_from_json(lines).select("id", "title", "props").collect()] == [("Q1", None, [])]


def test_sql_insert(spark):
    line = r"INSERT INTO `t` VALUES (1,'a\'b,(x)\n',NULL,-2.5,0x41),(2,'it''s',CURRENT_TIMESTAMP,1e3,'');"
    assert sql_insert.parse_insert_statement(line.encode()) == ("t", [[1, "a'b,(x)\n", None, -2.5, b"A"], [2, "it's", None, 1000.0, ""]])
    for bad in ("DROP TABLE t;", "INSERT INTO t VALUES (1", "INSERT INTO t VALUES (1) x", "INSERT INTO t VALUES (,)"):
        with pytest.raises(ValueError):
            sql_insert.parse_insert_statement(bad)
    df = spark.createDataFrame([(line,), ("-- comment",), (None,)], "value string")
    assert tables.insert_rows(df, "t").count() == 2
    page = "INSERT INTO `page` VALUES (7,0,'A_b',0,0,0.5,'x','y',1,2,'wikitext',NULL),(8,1,'T',0,0,0.5,'x','y',1,2,'wikitext',NULL);"
    assert rows(tables.page_titles(tables.insert_rows(spark.createDataFrame([(page,)], "value string"), "page"))) == [(7, "A_b")]


def test_submissions(spark, tmp_path):
    import zstandard

    lines = b'{"url":"http://a.com/x","title":"One"}\n{"url":null,"title":"b"}\n{"url":"u"}\nbad\n{"url":"http://a.com/x?q","title":"Two"}\n'
    (tmp_path / "RS_2020-01.zst").write_bytes(zstandard.compress(lines[:50]) + zstandard.compress(lines[50:]))
    got = tables.read_submissions(spark, str(tmp_path / "RS_2020-01.zst"))
    assert sorted(r["title"] for r in got.collect()) == ["One", "Two"]
    assert mentions.dedup_submissions(got).count() == 1
    assert mentions.dedup_submissions(got, spark.createDataFrame([("b.com",)], "domain string")).count() == 0
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        tables.read_submissions(spark, str(tmp_path / "RS_2020-01.zst"), strict=True).collect()


def test_tagged_text(spark, tmp_path):
    (tmp_path / "t.possf2").write_text("The_DT Cat_NN -_: ._. ``_`` A_DT\n\nnotag B_NN C_NN")
    got = [(r["words"], r["tags"]) for r in tables.read_tagged(spark, str(tmp_path / "t.possf2")).collect()]
    assert sorted(got) == sorted([(["the", "cat", "-"], [6, 15, 2]), (["a"], [6]), (["c"], [15])])


def test_registered_functions(spark):
    udfs.register(spark)
    got = spark.sql("SELECT wt_links('[[a]] [[b|c]]') AS l, wt_short_desc('{{short description|x}}') AS s, wt_parse('{{a ]] }}') AS p, wt_links(NULL) AS n, size(wt_tokenize('')) AS t").first()
    assert tuple(got) == (["a", "b|c"], "x", None, None, 0)
    every = spark.createDataFrame([("[[x]]{{disambiguation}}",), (None,)], "t string").select(udfs.wt_extract_all("t").alias("e")).select("e.*").collect()
    assert every[0]["links"] == ["x"] and every[0]["is_disambig"] is True and every[1]["links"] is None


def test_postings_edge_cases(spark):
    titles = spark.createDataFrame([("A b", 1), ("a B", 1), ("(a) b", 2), ("", 3)], "title string, node_id long")
    ranks = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 1.0)], "node_id long, value double")
    weights = mentions.term_weights(mentions.terms(titles), ranks)
    assert rows(weights) == [("", 3, 1.0), ("a b", 1, 0.0), ("a b", 1, 0.75), ("a b", 2, 0.25)]
    none = spark.createDataFrame([], "src long, dst long, link_idx int")
    nobody = spark.createDataFrame([], "node_id long")
    assigned = mentions.assigned_weights(weights, ranks, none, none.select("src", "dst"), nobody)
    assert rows(mentions.postings(assigned)) == [("a b", 1, 1.5), ("a b", 2, 0.5)]


def test_streaming_dedup(spark, tmp_path):
    from corpusrank import streaming

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"url": f"http://a.com/{i % 3}", "title": "t", "created_utc": 1_700_000_000 + i}) for i in range(9)))
    stream = streaming.dedup_within(streaming.submission_stream(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("deduped").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("deduped").count() == 3


def test_load_or_compute(spark, tmp_path):
    from corpusrank.storage import load_or_compute

    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert load_or_compute(spark, str(tmp_path / "t"), make).count() == 3
    assert calls == [1]
