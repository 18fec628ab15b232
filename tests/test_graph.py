from __future__ import annotations

import numpy as np
import pytest

from corpusrank.operators import graph, numbering
from corpusrank.sources import dump_xml


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_redirects(spark):
    redirects = spark.createDataFrame([("A", "B"), ("B", "C"), ("X", "Y"), ("P", "Q"), ("Q", "P"), ("S", "S"), *((f"c{i}", f"c{i + 1}") for i in range(20)), ("c20", "C")], "title string, target string")
    found = graph.resolve_redirects(redirects, spark.createDataFrame([("C", 7)], "title string, node_id long"))
    assert rows(found) == sorted([("A", 7), ("B", 7), *((f"c{i}", 7) for i in range(21))])


@pytest.mark.parametrize("cycle", [1, 2, 3, 5, 6])
def test_redirect_cycles_end(spark, cycle):
    """A cycle and a tail into it lead nowhere; a chain beside them does."""
    pairs = [(f"x{i}", f"x{(i + 1) % cycle}") for i in range(cycle)] + [("t2", "t1"), ("t1", "x0"), ("a", "b"), ("b", "C")]
    found = graph.resolve_redirects(spark.createDataFrame(pairs, "title string, target string"), spark.createDataFrame([("C", 7)], "title string, node_id long"))
    assert rows(found) == [("a", 7), ("b", 7)]


def test_redirect_rounds_follow_the_longest_chain(spark, monkeypatch):
    """Cycles, tails into them and chains to nowhere take no rounds of their own, and what is settled isn't written again."""
    pairs = [(f"x{i}", f"x{i - i % 3 + (i + 1) % 3}") for i in range(300)] + [(f"t{i}", f"x{i}") for i in range(300)] + [(f"n{i}", f"n{i + 1}") for i in range(40)]
    pairs += [(f"c{i}", f"c{i + 1}") for i in range(4)] + [("c4", "C")] + [(f"d{i}", "D") for i in range(50)] + [("e", "d3")]
    written, write = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: written.append(write(df, name)) or written[-1])
    found = graph.resolve_redirects(spark.createDataFrame(pairs, "title string, target string"), spark.createDataFrame([("C", 7), ("D", 8)], "title string, node_id long"))
    assert rows(found) == sorted([(f"c{i}", 7) for i in range(5)] + [(f"d{i}", 8) for i in range(50)] + [("e", 8)])
    assert len(written) <= 5 and sum(w.where("target = 'D'").count() for w in written[1:]) == 0
    assert rows(graph.resolve_redirects(spark.createDataFrame([("a", "b"), ("b", "a")], "title string, target string"), spark.createDataFrame([("C", 7)], "title string, node_id long"))) == []
    assert rows(graph.resolve_redirects(spark.createDataFrame([("a", "b"), ("b", "C")], "title string, target string"), spark.createDataFrame([("C", None)], "title string, node_id long"))) == [("a", None), ("b", None)]


def test_collisions(spark):
    pages = spark.createDataFrame([(5, "t", "2020"), (3, "t", "2021"), (8, "u", "2020"), (9, "u", "2020")], "id long, title string, timestamp string")
    assert rows(graph.overwritten(pages)) == [(5,), (8,)]


def test_numbering_over_many_tasks(spark):
    df = spark.range(1000).selectExpr("999 - id as v", "id % 3 as extra").repartition(7)
    got = rows(numbering.dense_ids(df, ["v"]).select("v", "node_id"))
    assert got == [(i, i) for i in range(1000)]
    assert numbering.dense_ids(df.where("v < 0"), ["v"]).count() == 0


def test_pagerank_against_numpy(spark):
    rng = np.random.default_rng(3)
    n = 40
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, n, (150, 2)) if a % 7]
    m = np.zeros((n, n))
    for a, b in pairs:
        m[b, a] += 1
    out = m.sum(axis=0)
    preference = rng.random(n)
    preference /= preference.sum()
    a = m / np.where(out, out, 1)
    r = np.ones(n) / n
    for _ in range(12):
        r = 0.15 * preference + 0.85 * a @ r + 0.85 * r[out == 0].sum() / n
    nodes = spark.createDataFrame([(i, float(p)) for i, p in enumerate(preference)], "node_id long, preference double")
    edges = spark.createDataFrame(pairs, "src long, dst long")
    got = dict(rows(graph.personalised_pagerank(nodes, graph.adjacency(edges), min_iter=12, max_iter=12)))
    assert np.allclose([got[i] for i in range(n)], r)


def page(i, title, text, redirect=None, ns=0):
    moved = f'<redirect title="{redirect}" />' if redirect else ""
    return f"<page><title>{title}</title><ns>{ns}</ns><id>{i}</id>{moved}<revision><timestamp>2020-01-0{i}T00:00:00Z</timestamp><text>{text}</text></revision></page>"


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    import bz2

    text = "<mediawiki>" + "".join([
        page(1, "Apple", "{{about|x|y|Pear}} a [[pear]] [[Old pear|p]] [[Apple]] &lt;ref&gt;[[Zip]]&lt;/ref&gt; [[nowhere]]"), page(2, "Pear", " [[Apple#top|a]] "), page(3, "Old pear", "#R {{R from move}}", "Pear"),
        page(4, "Category:Fruit", "x", ns=14), page(5, "Zip", ""), page(6, "Loop", "x", "Loop"),
    ]) + "<page><title>broken</title><ns>0</ns></page></mediawiki>"
    path = tmp_path_factory.mktemp("dump") / "pages.xml.bz2"
    path.write_bytes(bz2.compress(text[:300].encode()) + bz2.compress(text[300:].encode()))
    return dump_xml.read_dump(spark, str(path)).cache()


def test_dump(pages):
    got = {r["id"]: r for r in pages.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert got[5]["text"] == "" and got[2]["text"] == " [[Apple#top|a]] " and got[3]["redirect"] == "Pear" and "<ref>" in got[1]["text"]


def test_link_graph(pages):
    numbered = graph.number_articles(pages).cache()
    assert rows(numbered.select("title", "node_id")) == [("Apple", 0), ("Pear", 1), ("Zip", 2)]
    redirects = pages.where("ns = 0 and redirect is not null").selectExpr("title", "redirect as target")
    titles = graph.title_map(numbered, redirects)
    assert ("Old pear", 1, True) in rows(titles) and len(rows(titles)) == 4
    edges = graph.ordered_edges(graph.page_links(numbered), titles).cache()
    assert rows(edges) == [(0, 0, 2), (0, 1, 0), (0, 1, 1), (1, 0, 0)]
    assert rows(graph.degrees(numbered, edges)) == [(0, 2, 3), (1, 2, 1), (2, 0, 0)]
    assert rows(graph.hat_edges(numbered, titles)) == [(0, 1, 1)]
    assert rows(graph.moved_articles(pages).select("id")) == [(3,)]
    values = graph.personalised_pagerank(graph.log_degree_preference(graph.degrees(numbered, edges)), graph.adjacency(edges), min_iter=3)
    assert abs(sum(r["value"] for r in values.collect()) - 1) < 1e-9
    assert len(rows(graph.ranked_table(values, graph.degrees(numbered, edges), numbered))) == 3


def test_index(spark, tmp_path):
    (tmp_path / "i.txt").write_text("10:1:Apple\n10:2:Pear: a\n90:7:Gone\n")
    index = dump_xml.read_index(spark, str(tmp_path / "i.txt"))
    assert rows(dump_xml.stream_counts(index)) == [(10, 2), (90, 1)]
    assert rows(dump_xml.missing_pages(index, spark.createDataFrame([(1,), (2,)], "id long")).select("title")) == [("Gone",)]
