from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusrank.functions import wikitext as w


@pytest.mark.parametrize(("text", "strict", "links"), [
    ("A [[fruit|fruits]] of [[Malus]].", True, ["fruit|fruits", "Malus"]), ("[[File:a.png|see [[B]]]]", True, ["B", "File:a.png|see [[B]]"]), ("a<ref>[[X]]</ref>[[Y]]", True, ["Y"]),
    ('<ref name="n" />[[Y]]', True, ["Y"]), ("a<ref>x</div>y</ref>[[Y]]", True, []), ("a<ref>x</div>y</ref>[[Y]]", False, ["Y"]), ("<nowiki>[[A]]</nowiki>[[B]]", True, ["B"]),
    ("", True, []), ("[[a", True, []), ("]]", True, []),
])
def test_links(text, strict, links):
    assert w.get_links(text, strict) == links


@pytest.mark.parametrize(("text", "tokens"), [
    ("== See also ==\n", [("element_start", "h2"), ("content", "See also"), ("element_end", "h2")]), ("== See also ==", [("content", "== See also ==")]),
    ("a < b", [("content", "a "), ("content", "< b")]), ("<foo>x", [("content", "<foo>x")]), ("<br/>", [("element_start_end", "br")]), ("<B>", [("element_start", "b")]),
    ("<!-- [[x]] -->", [("comment", None)]), ("</ ref >", [("element_end", "ref")]), ('<ref name="a>b">', [("element_start", "ref")]), ('<ref name="a', [("content", '<ref name="a')]),
    ("{{{a}}}", [("template_start", None), ("content", "{a"), ("template_end", None), ("content", "}")]),
    ("<pre></pre>", [("element_start", "pre"), ("content", ""), ("element_end", "pre")]), ("<pre>{{x", [("element_start", "pre"), ("content", "{{x"), ("element_end", "pre")]),
    ("</pre>", [("element_start", "pre"), ("content", ""), ("element_end", "pre")]), ("<?x?>", [("comment", None), ("content", "?>")]), ("=====\n", [("content", "=====\n")]),
])
def test_tokens(text, tokens):
    assert w.tokenize(text) == tokens


def shape(node):
    return node.data if node.kind == "Content" else (node.kind, [shape(c) for c in node.children])


@pytest.mark.parametrize(("text", "tree"), [
    ("{{a|b|c}}", [("Template", [("Argument", ["a"]), ("Argument", ["|b"]), ("Argument", ["|c"])])]), ("[[F:x|{{y}}]]", [("Link", [("Argument", ["F:x"]), ("Argument", ["|", ("Template", [("Argument", ["y"])])])])]),
    ("a }} b", ["a ", " b"]), ("x</br>", ["x", ("Element", [])]), ("{{a</br>}}", [("Template", [("Argument", ["a", "\n"])])]), ("{{a|[[b}}", [("Template", [("Argument", ["a"]), ("Argument", ["|", ("Link", [("Argument", ["b"])])])])]),
    ("&amp;lt;", ["&lt;"]),
])
def test_tree(text, tree):
    assert shape(w.parse(text)) == ("Document", tree)


def test_tree_error():
    with pytest.raises(w.WikitextError):
        w.parse("{{a ]] }}")


def test_extractors():
    assert w.get_cite_urls("{{cite web|url=https://a.org/p |title=T}}") == ["a.org/p"]
    assert w.get_cite_urls("{{Cite web|url=https://a.org}}") == []
    assert w.is_disambiguation_page("{{disambiguation|geo}}") and not w.is_disambiguation_page("{{disambiguation\n|geo}}")
    assert w.get_first_infobox_title("{{Infobox person\n| name = A}}") == "person" and w.get_first_infobox_title("{{infobox}}") is None
    assert w.get_short_description("{{short description|Red fruit}}") == "Red fruit" and w.get_short_description("{{Short description|None}}") is None
    assert w.get_h2_headings("== A ==\n=== B ===\n== [[C]] ==\n") == ["A"] and w.get_h2_headings("x") is None
    assert list(w.templates_of(w.tokenize("{{a|{{a|x}}}}"), lambda c: c.startswith("a"))) == ["a|x", "a|{{a|x"]
    assert w.get_templates_by_name("{{a|{{a|x}}}}", ["A"]) == ["a|{{a|x"]


def test_hatnotes():
    assert w.parse_hatnote("about|the fruit|other uses|Apple (disambiguation)") == [(w.ABOUT, "Apple (disambiguation)")]
    edges = lambda text, strict: w.hat_edges_of(w.tokenize(text), strict)
    assert edges("{{distinguish|[[Pear]]}}", True) == [] and edges("{{distinguish|[[Pear]]}}", False) == [(w.DISTINGUISH, "Pear")]
    assert edges("{{For|the horse|Ambiorix (horse)}}", True) == [] and edges("{{For|the horse|Ambiorix (horse)}}", False) == [(w.FOR, "Ambiorix (horse)")]
    assert edges("{{Redirect-distinguish|a|b{{!}}x|c#d}}", True) == [(w.DISTINGUISH, "B")]
    assert w.parse_hatnote("") == [] and w.parse_hatnote("Hatnote|x") == []


def test_wiki_link():
    assert w.parse_wiki_link(" apple#Uses|x ") == "Apple" and w.parse_wiki_link("") is None and w.parse_wiki_link(None) is None


def test_xml():
    text = "{{Foo|a=b|''c''}} [[x|y]]<ref>z</ref> a&amp;b"
    assert w.to_xml(w.parse(text), frozenset(["ref"])) == '<document><wmt title="foo"><arg name="a">b</arg><arg>c</arg></wmt> <wml><arg>x</arg><arg>y</arg></wml> a&amp;b</document>'


MARKUP = st.lists(st.sampled_from(["[[", "]]", "{{", "}}", "|", "<ref>", "</ref>", "<nowiki>", "</nowiki>", "<!--", "-->", "== a ==\n", "x", "é", " ", "<", "\n", "'", '"']), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(MARKUP)
def test_content_is_a_subsequence(text):
    rest = iter(text)
    assert all(c in rest for kind, data in w.tokenize(text) if kind == "content" for c in data)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_characters="<{}[]=&", exclude_categories=["Cs"]), min_size=1))
def test_plain_text_is_one_content(text):
    assert w.tokenize(text) == [("content", text)]


def test_results_become_arrow_by_slices(spark, monkeypatch):
    """No more than a slice of texts is held as Python objects; the rows are those of one slice."""
    import pyarrow as pa
    from pyspark.sql import types as T

    from corpusrank.functions import udfs

    texts = [f"<b>{i}</b> [[x{i}|y]] <!-- c -->" * 20 for i in range(50)] + [None, ""]
    sizes, make = [], pa.array
    monkeypatch.setattr(udfs, "SLICE_CHARS", 2000)
    monkeypatch.setattr(udfs.F, "arrow_udf", lambda f, kind: f)
    sliced, column = udfs.wt_tokenize.udf(), make(texts, pa.string())
    monkeypatch.setattr(udfs.pa, "array", lambda held, kind: sizes.append(len(held)) or make(held, kind))
    got = sliced(column).to_pylist()
    assert got == [None if t is None else [{"kind": k, "data": d} for k, d in w.tokenize(t)] for t in texts]
    assert sum(sizes) == len(texts) and max(sizes) <= 5
    assert T.DataType.fromDDL(udfs.wt_extract_all.kind).fieldNames()[0] == "links"
