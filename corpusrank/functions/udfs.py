"""The wikitext functions as Arrow-batched UDFs, and their registration for SQL.

Each returns null for a null text.  ``wt_parse`` gives null where a text can't be made into a tree;
``wt_parse_error`` then says why.  ``wt_extract_all`` tokenizes a page once for all extractions.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import sql_insert
from . import wikitext as w


class TextFunction:
    """A function of texts (and further columns) that becomes a UDF when it is used, in the session of that time."""

    def __init__(self, kind: str, run: Callable[..., pd.Series | pd.DataFrame]):
        self.kind, self.run = kind, run

    def udf(self):
        return F.pandas_udf(self.run, self.kind)

    def __call__(self, *columns):
        return self.udf()(*columns)


SLICE_CHARS = 1 << 20
"""Characters of texts whose results are Python objects at a time."""


class SlicedFunction(TextFunction):
    """A function of one text: results become Arrow slice by slice, as tokens take many times a text's bytes as Python objects."""

    def udf(self):
        run, kind = self.run, to_arrow_type(T.DataType.fromDDL(self.kind))

        def sliced(texts: pa.Array) -> pa.Array:
            done, held, chars = [], [], 0
            for text in texts:
                text = text.as_py()
                held.append(run(text))
                chars += len(text or "")
                if chars >= SLICE_CHARS:
                    done.append(pa.array(held, kind))
                    held, chars = [], 0
            return pa.concat_arrays([*done, pa.array(held, kind)])

        return F.arrow_udf(sliced, self.kind)


def _of_text(kind: str, f: Callable[[str], Any]) -> TextFunction:
    return SlicedFunction(kind, lambda t: None if t is None else f(t))


def _tree(text: str) -> list[dict] | None:
    try:
        return [n._asdict() for n in w.flatten(w.parse(text))]
    except w.WikitextError:
        return None


def _tree_error(text: str) -> str | None:
    try:
        w.parse(text)
    except w.WikitextError as e:
        return str(e)
    return None


def _xml(text: str) -> str | None:
    try:
        return w.to_xml(w.parse(text))
    except w.WikitextError:
        return None


_EDGES = "array<struct<kind:int,dest:string>>"
_edges = lambda tokens, strict: [{"kind": k, "dest": d} for k, d in w.hat_edges_of(tokens, strict)]

wt_tokenize = _of_text("array<struct<kind:string,data:string>>", lambda t: [{"kind": k, "data": d} for k, d in w.tokenize(t)])
wt_token_count = _of_text("int", lambda t: len(w.tokenize(t)))
wt_parse = _of_text("array<struct<node_id:int,parent_id:int,depth:int,kind:string,data:string>>", _tree)
wt_parse_error = _of_text("string", _tree_error)
wt_xml = _of_text("string", _xml)
wt_links = _of_text("array<string>", w.get_links)
wt_links_mended = _of_text("array<string>", lambda t: w.get_links(t, strict=False))
wt_cite_urls = _of_text("array<string>", w.get_cite_urls)
wt_is_disambig = _of_text("boolean", w.is_disambiguation_page)
wt_hatnotes = _of_text("array<string>", w.get_distinguish_hatnotes)
wt_hat_edges = _of_text(_EDGES, lambda t: _edges(w.tokenize(t), True))
wt_hat_edges_mended = _of_text(_EDGES, lambda t: _edges(w.tokenize(t), False))
wt_parse_hatnote = _of_text(_EDGES, lambda t: [{"kind": k, "dest": d} for k, d in w.parse_hatnote(t)])
wt_infobox = _of_text("string", w.get_first_infobox_title)
wt_short_desc = _of_text("string", w.get_short_description)
wt_h2 = _of_text("array<string>", w.get_h2_headings)
sql_insert_rows = _of_text("array<struct<table:string,row:array<string>>>", lambda t: [{"table": a, "row": r} for a, r in sql_insert.rows_as_text(t)])


def _templates(texts: pd.Series, wanted: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else w.get_templates_by_name(t, [] if n is None else list(n)) for t, n in zip(texts, wanted)], dtype=object)


wt_templates = TextFunction("array<string>", _templates)
"""Templates of the given titles."""

EXTRACT = (
    "links array<string>, cite_urls array<string>, is_disambig boolean, hat_edges array<struct<kind:int,dest:string>>, infobox string, short_desc string, h2 array<string>"
)


def _extract(text: str | None) -> dict:
    names = ("links", "cite_urls", "is_disambig", "hat_edges", "infobox", "short_desc", "h2")
    if text is None:
        return dict.fromkeys(names)
    t = w.tokenize(text)
    return dict(zip(names, (w.links_of(t), w.cite_urls_of(t), w.is_disambiguation_of(t), _edges(t, True), w.infobox_of(t), w.short_desc_of(t), w.h2_of(t))))


wt_extract_all = SlicedFunction(f"struct<{EXTRACT.replace(' ', ':').replace(',:', ',')}>", _extract)
"""All extractions of a page from one tokenization."""

FUNCTIONS = {name: f for name, f in list(globals().items()) if isinstance(f, TextFunction)}


def register(spark: SparkSession) -> None:
    """Make every function available to ``spark.sql`` under its name."""
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f.udf())
