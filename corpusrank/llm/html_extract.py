"""Main text of web pages: the maximum-scoring run of tags and words, with weights learned from labelled pages.

A page is read as a sequence of tags and texts.  Words score by where they stand, tags by how rarely
they stand inside content; a linear scan finds the contiguous run with the highest sum.  Labelled
pages are those that mark their content with ``article`` or ``main``.  Class names that usually stand
for side matter count as such unless the labelled pages or the page's own text say otherwise.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in "script style noscript template svg iframe object textarea select button".split()}
_HEAD = re.compile(
    r"(?>\s+|<!--.*?-->|<(?P<name>title|script|style|noscript|template)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?</(?P=name)\s*>|<(?:meta|link|base)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>)*+(?:</head\s*>)?",
    re.S | re.I,
)
"""What a head may hold; anything else ends it."""
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend "
    "li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_HOLDERS = _BLOCKS - {"br", "hr", "body", "html"}
_SIDE = frozenset("nav footer aside form menu dialog fieldset".split())
_SIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside widget "
    "footer foot masthead topbar toolbar cookie cookies consent notice notices alert gdpr popup modal overlay newsletter subscribe signup login search form comment comments commentlist "
    "disqus replies reply respond discussion share sharing social related recommended pagination pager skip copyright legal contentinfo complementary banner- search-form".split()
)
_CLOSED_BY = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
_ENDS_P = _BLOCKS - {"br", "option", "legend", "summary", "caption"}


def _side_names(rest: str) -> frozenset[str]:
    """Words of class, id and role that usually name side matter."""
    if not rest:
        return frozenset()
    found = (re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", "".join(f)).lower()) for f in _NAMES.findall(rest))
    return frozenset(w for words in found for w in words) & _SIDE_NAMES


class Items:
    """A page as items: kind (feature name), words, text (None for a tag), whether it breaks a block, side, and whether it stands in marked content.

    Elements are side matter by their kind, or by class, id or role; the latter are listed in
    ``named`` (first item, end, words) until ``settle`` decides about them.
    """

    def __init__(self, page: str):
        self.kinds: list[str] = []
        self.words: list[int] = []
        self.texts: list[str | None] = []
        self.breaks: list[bool] = []
        self.side: list[bool] = []
        self.marked: list[bool] = []
        self.named: list[list] = []
        open_: list[tuple[str, bool, bool, int]] = []  # name, side, marked content, place in named or -1
        side = marked = False
        at, unclosed = 0, set()
        while at < len(page):
            m = _TOKEN.match(page, at)
            at = m.end()
            text = m["text"]
            if text is not None:
                if not text.isspace():
                    where = "side" if side else open_[-1][0] if open_ else "body"
                    self._add("in " + where, len(text.split()), text, False, side, marked)
                elif self.texts:
                    self._add("space", 0, text, False, side, marked)
                continue
            if m["name"] is None:
                continue
            name = m["name"].lower()
            if not m["close"] and (name in _RAW or name == "head") and (not m["rest"] or m["rest"][0] in " \t\n\r\f/"):
                end = self._raw_end(page, name, m["rest"], at, unclosed)
                if end is not None:
                    self._add("<raw>", 0, None, name not in ("script", "style"), side, marked)
                    at = end
                    continue
            feature = f"<{name if name in _BLOCKS else 'inline'}>"
            if m["close"]:
                if name in _HOLDERS and any(o[0] == name for o in open_):
                    while self._close(open_) != name:
                        pass
                    side, marked = open_[-1][1:3] if open_ else (False, False)
                self._add(feature, 0, None, name in _BLOCKS, side, marked and name not in ("article", "main"))
                continue
            if name in _ENDS_P and open_ and open_[-1][0] == "p" or open_ and open_[-1][0] in _CLOSED_BY.get(name, ()):
                self._close(open_)
                side, marked = open_[-1][1:3] if open_ else (False, False)
            was = marked
            if name in _HOLDERS and not m["rest"].rstrip().endswith("/"):
                side = side or name in _SIDE or name == "header" and not marked or bool(_HIDDEN.search(m["rest"]))
                names = frozenset() if side else _side_names(m["rest"])
                marked = marked or name in ("article", "main") and not side
                open_.append((name, side, marked, len(self.named) if names else -1))
                if names:
                    self.named.append([len(self.kinds), None, names])
            self._add(feature, 0, None, name in _BLOCKS, side, was)
        while open_:
            self._close(open_)

    def _close(self, open_: list) -> str:
        name, _, _, at = open_.pop()
        if at >= 0:
            self.named[at][1] = len(self.kinds)
        return name

    def settle(self, weights: dict[str, float] | None = None) -> Counter:
        """Decide which named elements are side matter, and count the words of content and of other matter in them by their names.

        Not side is an element with most of the words of marked content; with ``weights`` (at
        extraction) also one whose names have stood for content or, on a page without marked content,
        one with most of the words of the run that is best without regard to names.
        """
        counts: Counter = Counter()
        if not self.named:
            return counts
        words, marked = np.array(self.words), np.array(self.marked)
        in_run = np.zeros(len(words), bool)
        if weights is not None and not words[marked].any():
            start, end = best_run(np.array([_weight(weights, k) * max(1, w) for k, w in zip(self.kinds, self.words)]))
            in_run[start:end] = True
            in_run &= ~np.array(self.side)
        of_content, of_run, of_all = (np.concatenate([[0], np.cumsum(words * where)]) for where in (marked, in_run, 1))
        for first, end, names in self.named:
            most = any(2 * (sums[end] - sums[first]) > sums[-1] for sums in (of_content, of_run))
            inside = int(of_content[end] - of_content[first]) if most else 0
            for n in names:
                counts["." + n, True] += inside
                counts["." + n, False] += int(of_all[end] - of_all[first]) - inside
            if most or weights is not None and sum(weights.get("." + n, -1.0) for n in names) > 0:
                continue
            for i in range(first, end):
                self.side[i], self.marked[i] = True, False
                if self.kinds[i].startswith("in "):
                    self.kinds[i] = "in side"
        return counts

    @staticmethod
    def _raw_end(page: str, name: str, rest: str, at: int, unclosed: set[str]) -> int | None:
        """Where an element without text of its own ends; None if its tag stands alone.  ``unclosed`` collects names without a further closing tag."""
        if name == "head":
            return _HEAD.match(page, at).end()
        if name == "svg" and rest.endswith("/"):
            return None
        found = None if name in unclosed else _RAW[name].search(page, at)
        if found:
            return found.end()
        unclosed.add(name)
        return len(page) if name in ("script", "style") else None

    def _add(self, kind: str, words: int, text: str | None, breaks: bool, side: bool, marked: bool) -> None:
        self.kinds.append(kind)
        self.words.append(words)
        self.texts.append(text)
        self.breaks.append(breaks)
        self.side.append(side)
        self.marked.append(marked and not side)


def count_features(pages: list[str]) -> Counter:
    """(feature, inside) counts over pages with marked content: words for places, occurrences for tags."""
    counts: Counter = Counter()
    for page in pages:
        if "<article" not in page and "<main" not in page:
            low = page.lower()
            if "<article" not in low and "<main" not in low:
                continue
        items = Items(page)
        named = items.settle()
        if any(items.marked):
            counts.update(named)
            for kind, words, marked in zip(items.kinds, items.words, items.marked):
                counts[kind, marked] += max(1, words)
    return counts


def learn(counts: Counter) -> dict[str, float]:
    """Weights from the counts: log odds of standing in content, above zero for words of the text proper, below zero for tags, either for names of elements."""
    weights: dict[str, float] = {}
    for kind in {k for k, _ in counts}:
        odds = float(np.log((counts[kind, True] + 1) / (counts[kind, False] + 1)))
        if kind == "space":
            weights[kind] = 0.0
        elif kind.startswith("."):
            weights[kind] = float(np.clip(odds, -4, 4))
        elif kind.startswith("in "):
            weights[kind] = float(np.clip(odds, -4, -0.5) if kind == "in side" else np.clip(odds, 0.2, 4))
        else:
            weights[kind] = float(np.clip(odds, -6, -0.05))
    return weights


def _weight(weights: dict[str, float], kind: str) -> float:
    if kind in weights:
        return weights[kind]
    return -2.0 if kind == "in side" else 1.0 if kind.startswith("in ") else 0.0 if kind == "space" else -0.5


def best_run(scores: np.ndarray) -> tuple[int, int]:
    """The contiguous run with the highest sum (the first, then the longest, of equals); empty if none is above zero."""
    if not len(scores):
        return 0, 0
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    lowest = np.minimum.accumulate(sums[:-1])
    gains = sums[1:] - lowest
    best = gains.max()
    if best <= 0:
        return 0, 0
    end = int(np.flatnonzero(gains >= best - 1e-9)[0])
    start = int(np.flatnonzero(sums[: end + 1] <= lowest[end] + 1e-9)[0])
    return start, end + 1


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text of one page: blocks of the best run, without side matter in it."""
    if not page:
        return ""
    items = Items(page)
    items.settle(weights)
    scores = np.array([_weight(weights, k) * max(1, w) for k, w in zip(items.kinds, items.words)])
    start, end = best_run(scores)
    blocks, held = [], []
    for i in range(start, end):
        if items.breaks[i]:
            blocks.append("".join(held))
            held = []
        if items.texts[i] is not None and not items.side[i]:
            held.append(items.texts[i])
    blocks.append("".join(held))
    lines = (" ".join(unescape(b).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def fit_weights(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weights from all labelled pages; there are as many as kinds of places and tags, whatever the number of pages."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for i in range(batch.num_rows):
                total.update(count_features([batch.column(0)[i].as_py() or ""]))
        yield pa.RecordBatch.from_pylist([{"kind": k, "inside": m, "n": n} for (k, m), n in total.items()], pa.schema([("kind", pa.string()), ("inside", pa.bool_()), ("n", pa.int64())]))

    rows = pages.select(html_col).mapInArrow(tally, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()
    return learn(Counter({(r["kind"], r["inside"]): r["n"] for r in rows}))


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, text, n_chars of every page, from its whole html.

    Null and empty pages have an empty text, as have pages in which no run scores above zero.  Rows
    that repeat are extracted each; null ids and urls stay null.  Without labelled pages the weights
    are fixed priors.  Further columns are ignored.
    """
    weights = fit_weights(pages, html_col)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                texts = [extract(h.as_py(), weights) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "url")]
    return rows.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long").toDF(id_col, url_col, "text", "n_chars")
