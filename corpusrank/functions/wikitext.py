"""Wikitext in pure Python: tokens, a syntax tree, and extractors. No Spark here.

A token is a pair (kind, data).  Kinds: comment, template_start, template_end, link_start, link_end,
element_start, element_start_end (self-closing), element_end, content.  ``data`` is the element's
name or the content's text, else None.

``strict=True`` keeps the behaviour of the established tools exactly, oddities included;
``strict=False`` mends three of them (see :class:`Scope`, :func:`split_template`, :func:`parse_hatnote`).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

from .data import names

Token = tuple[str, "str | None"]
OVERRIDES = frozenset(["nowiki", "pre", "code", "math", "chem"])
"""Elements whose content is taken as it stands."""
VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
TAGS = names("html_tags")

_SPACES = " \t\r\n"
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_NAME = r"[^&<>?\"'/;# \t\r\n]++"
_ANGLE = re.compile(
    rf"(?P<comment><!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?(?=\?>))|</[{_SPACES}]*+(?P<end>{_NAME})[{_SPACES}]*+>|<(?P<begin>{_NAME})(?P<rest>(?:[^<>\"]++|\"[^\"]*+\")*+)(?:>|(?=<))",
    re.S,
)
_CONTENT = re.compile(r".(?:[^<{}\[\]]++|\{(?!\{)|\}(?!\})|\[(?!\[)|\](?!\]))*+", re.S)
_TO_ANGLE = re.compile(r".[^<]*+", re.S)
_BRACKETS = {"{{": "template_start", "}}": "template_end", "[[": "link_start", "]]": "link_end"}
_MARKERS = {kind: text for text, kind in _BRACKETS.items()}


class WikitextError(ValueError):
    """Text that can't be made into a tree."""


def _angle(text: str, at: int) -> tuple[Token, int] | None:
    """The comment or tag that begins at ``text[at] == '<'``, and where it ends; None if it is none."""
    m = _ANGLE.match(text, at)
    if m is None:
        return None
    if m["comment"] is not None:
        return ("comment", None), m.end()
    name = (m["end"] or m["begin"]).translate(_ASCII_LOWER)
    if name not in TAGS:
        return None
    if m["end"] is not None:
        return ("element_end", name), m.end()
    kind = "element_start_end" if m["rest"].rstrip(_SPACES).endswith("/") else "element_start"
    return (kind, name), m.end()


def _inline_tokens(text: str) -> Iterator[Token]:
    at, n = 0, len(text)
    while at < n:
        two = text[at : at + 2]
        if two in _BRACKETS:
            yield _BRACKETS[two], None
            at += 2
            continue
        if two[0] == "<" and (found := _angle(text, at)):
            token, at = found
            yield token
            continue
        m = _CONTENT.match(text, at)
        yield "content", m.group()
        at = m.end()


def _blocks(text: str) -> Iterator[tuple[str, str, str]]:
    """("verbatim", element, text) and ("body", "", text) blocks in order."""
    at = taken = 0
    open_: str | None = None
    while at < len(text):
        found = _angle(text, at) if text[at] == "<" else None
        if found is None:
            at = _TO_ANGLE.match(text, at).end()
            continue
        (kind, name), end = found
        if name in OVERRIDES:
            if kind == "element_start" and open_ is None:
                yield "body", "", text[taken:at]
                open_, taken = name, end
            elif kind == "element_end" and open_ is None:
                yield "body", "", text[taken:at]
                yield "verbatim", name, ""
                taken = end
            elif kind == "element_end" and open_ == name:
                yield "verbatim", name, text[taken:at]
                open_, taken = None, end
        at = end
    yield ("verbatim", open_, text[taken:]) if open_ else ("body", "", text[taken:])


_HEADING = re.compile(r"^=([= \t]*+)([^\n]*[^= \t\n])([= \t]*)\n", re.M)


def _body_tokens(body: str) -> Iterator[Token]:
    """Tokens of a body block, its heading lines as elements h1, h2, ..."""
    taken = 0
    for m in _HEADING.finditer(body):
        level = 1 + m[1].count("=")
        if level != m[3].count("="):
            continue
        yield from _inline_tokens(body[taken : m.start()])
        yield "element_start", f"h{level}"
        yield from _inline_tokens(m[2])
        yield "element_end", f"h{level}"
        taken = m.end()
    yield from _inline_tokens(body[taken:])


def tokenize(text: str) -> list[Token]:
    """All tokens of a text."""
    out: list[Token] = []
    for kind, name, part in _blocks(text):
        if kind == "verbatim":
            out += [("element_start", name), ("content", part), ("element_end", name)]
        else:
            out += _body_tokens(part)
    return out


# --- syntax tree -----------------------------------------------------------------------------------

_ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'", "nbsp": " "}
_ENTITY = re.compile("&(" + "|".join(_ENTITIES) + ");")


def decode_entities(text: str) -> str:
    """The six known entities, each decoded once."""
    return _ENTITY.sub(lambda m: _ENTITIES[m[1]], text)


class Node:
    """kind: Document, Element, Template, Link, Argument or Content; data: an element's name, a content's text."""

    __slots__ = ("kind", "data", "children")

    def __init__(self, kind: str, data: str | None = None, children: list[Node] | None = None):
        self.kind, self.data, self.children = kind, data, children or []


def _arguments(nodes: list[Node]) -> list[Node]:
    """Children grouped into arguments; one begins at each content that begins with ``|``."""
    groups: list[list[Node]] = []
    for node in nodes:
        if not groups or node.kind == "Content" and node.data.startswith("|"):
            groups.append([])
        groups[-1].append(node)
    return [Node("Argument", None, g) for g in groups]


class _Open(NamedTuple):
    closer: Token
    node: Node
    held: list[Node]


def _content_run(tokens: list[Token], at: int, overridden: bool) -> tuple[str, int]:
    parts = []
    while at < len(tokens):
        kind, data = tokens[at]
        if kind == "content":
            parts.append(decode_entities(data))
        elif kind in _MARKERS and overridden:
            parts.append(_MARKERS[kind])
        elif kind != "comment":
            break
        at += 1
    return "".join(parts), at


def _opens(token: Token) -> _Open | None:
    """The structure that a token opens, if it has content of its own."""
    kind, name = token
    if kind == "template_start":
        return _Open(("template_end", None), Node("Template"), [])
    if kind == "link_start":
        return _Open(("link_end", None), Node("Link"), [])
    if kind == "element_start" and name not in VOID:
        return _Open(("element_end", name), Node("Element", name), [])
    return None


def parse_tokens(tokens: list[Token]) -> Node:
    """The tree of a token list.  A stray closing token inside an open structure raises :class:`WikitextError`; at top level it is passed over."""
    root = Node("Document")
    stack: list[_Open] = []
    at = 0

    def put(node: Node) -> None:
        (stack[-1].held if stack else root.children).append(node)

    def close() -> None:
        done = stack.pop()
        done.node.children = _arguments(done.held)
        put(done.node)

    while at < len(tokens):
        token = kind, name = tokens[at]
        overridden = any(o.closer[0] == "element_end" and o.closer[1] in OVERRIDES for o in stack)
        bracket = kind in _MARKERS
        if stack and not (bracket and overridden) and any(o.closer == token for o in stack):
            if stack[-1].closer == token:
                at += 1
            close()
            continue
        if kind in ("content", "comment") or bracket and overridden:
            text, at = _content_run(tokens, at, overridden)
            if not stack:
                put(Node("Content", text))
                continue
            cuts = [0, *(i for i, c in enumerate(text) if c == "|"), len(text)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                put(Node("Content", text[a:b]))
            continue
        if kind in ("element_start_end", "element_start", "template_start", "link_start"):
            opened = _opens(token)
            if opened:
                stack.append(opened)
            else:
                put(Node("Element", name))
        elif kind == "element_end" and name in VOID:
            put(Node("Content", "\n") if stack and name == "br" else Node("Element", name))
        elif stack:
            raise WikitextError(f"unexpected {kind} at token {at}")
        at += 1
    while stack:
        close()
    return root


def parse(text: str) -> Node:
    return parse_tokens(tokenize(text))


class FlatNode(NamedTuple):
    node_id: int
    parent_id: int | None
    depth: int
    kind: str
    data: str | None


def flatten(root: Node) -> list[FlatNode]:
    """A tree as rows in pre-order."""
    out: list[FlatNode] = []
    todo: list[tuple[Node, int | None, int]] = [(root, None, 0)]
    while todo:
        node, parent, depth = todo.pop()
        me = len(out)
        out.append(FlatNode(me, parent, depth, node.kind, node.data))
        todo += [(c, me, depth + 1) for c in reversed(node.children)]
    return out


_QUOTES = re.compile("'{2,3}")
_NAMED = re.compile(r"\|\s*([a-zA-Z][a-zA-Z0-9_]*)\s*=\s*")
_XML_BAD = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")


def _xml_text(text: str) -> str:
    return _XML_BAD.sub("", text).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _xml_attribute(text: str) -> str:
    return _xml_text(text).replace('"', "&quot;")


def to_xml(root: Node, drop: frozenset[str] = frozenset()) -> str:
    """The tree as XML: templates as ``wmt`` (with title), links as ``wml``, arguments as ``arg`` (with name); elements in ``drop`` are left out."""
    out: list[str] = []
    todo: list[Node | str] = [root]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        children, head = node.children, ""
        if node.kind == "Content":
            out.append(_xml_text(_QUOTES.sub("", node.data)))
            continue
        if node.kind == "Element" and node.data in drop:
            continue
        name = {"Document": "document", "Element": node.data, "Template": "wmt", "Link": "wml", "Argument": "arg"}[node.kind]
        if node.kind == "Template" and children and len(children[0].children) == 1 and children[0].children[0].kind == "Content":
            title = children[0].children[0].data.strip()
            head, children = f' title="{_xml_attribute(title[:1].lower() + title[1:])}"', children[1:]
        elif node.kind == "Argument" and children and children[0].kind == "Content" and children[0].data.startswith("|"):
            first, children = children[0].data, children[1:]
            m = _NAMED.match(first)
            head = f' name="{m[1]}"' if m else ""
            children = [Node("Content", first[m.end() if m else 1 :]), *children]
        out.append(f"<{name}{head}>")
        todo.append(f"</{name}>")
        todo += reversed(children)
    return "".join(out)


# --- extractors ------------------------------------------------------------------------------------


class Scope:
    """Open elements and templates, and how many of them are overrides and refs.

    In strict mode a closing token without an opener empties the stack, but not the counts: a ``ref``
    lost that way hides all later links.  Otherwise such a token is ignored, and what a closing token
    passes over is counted out.
    """

    def __init__(self, strict: bool = True):
        self.strict, self.stack, self.overrides, self.refs = strict, [], 0, 0

    def _count(self, token: Token, by: int) -> None:
        if token[0] == "element_start":
            self.overrides += by * (token[1] in OVERRIDES)
            self.refs += by * (token[1] == "ref")

    def _close(self, opener: Token) -> None:
        if not self.strict and opener not in self.stack:
            return
        while self.stack:
            top = self.stack.pop()
            if top == opener or not self.strict:
                self._count(top, -1)
            if top == opener:
                return

    def update(self, token: Token) -> None:
        kind, name = token
        if kind == "element_start" and name not in VOID:
            self._count(token, 1)
            self.stack.append(token)
        elif kind == "element_end":
            self._close(("element_start", name))
        elif kind == "template_start" and not self.overrides:
            self.stack.append(token)
        elif kind == "template_end" and not self.overrides:
            self._close(("template_start", None))


def links_of(tokens: list[Token], strict: bool = True) -> list[str]:
    """Inner texts of ``[[...]]`` outside references and verbatim text, in the order they close."""
    out: list[str] = []
    held: list[list[str]] = []
    scope = Scope(strict)

    def add(text: str) -> None:
        for h in held:
            h.append(text)

    for token in tokens:
        kind, data = token
        if kind == "content":
            add(data)
        elif kind in ("template_start", "template_end"):
            scope.update(token)
            add(_MARKERS[kind])
        elif kind in ("link_start", "link_end"):
            able = not scope.overrides and not scope.refs
            if kind == "link_start":
                add("[[")
                if able:
                    held.append([])
            else:
                if able and held:
                    out.append("".join(held.pop()))
                add("]]")
        elif kind != "comment":
            scope.update(token)
    return out


def templates_of(tokens: list[Token], accept: Callable[[str], bool], outermost: bool = False, strict: bool = True) -> Iterator[str]:
    """Inner texts of templates whose first content is accepted, in the order they close; with ``outermost`` not those inside another accepted one.

    When an accepted template closes, templates around it get its text and ``{{``, but no ``}}``.
    """
    held: list[list[str] | None] = []
    scope = Scope(strict)

    def add(text: str) -> None:
        for h in held:
            if h is not None:
                h.append(text)

    for i, token in enumerate(tokens):
        kind, data = token
        if kind == "content":
            add(data)
        elif kind == "template_start":
            add("{{")
            if not scope.overrides:
                following = tokens[i + 1] if i + 1 < len(tokens) else ("", None)
                held.append([] if following[0] == "content" and accept(following[1]) else None)
        elif kind == "template_end":
            done = held.pop() if held and not scope.overrides else None
            if done is None:
                add("}}")
            elif not outermost or all(h is None for h in held):
                yield "".join(done)
        elif kind in _MARKERS:
            add(_MARKERS[kind])
        elif kind != "comment":
            scope.update(token)


_TITLE = re.compile(r"[^|#<>\[\]{}_]*")


def template_title(text: str) -> str:
    """The text up to a sign no title has, its first letter upper-cased if ASCII; not trimmed."""
    title = _TITLE.match(text).group()
    return title[:1].upper() + title[1:] if title[:1].isascii() else title


def get_links(text: str, strict: bool = True) -> list[str]:
    return links_of(tokenize(text), strict)


_CITED = re.compile(r"\|\s*url\s*=\s*https?://([^|]+)")


def cite_urls_of(tokens: list[Token], strict: bool = True) -> list[str]:
    found = (_CITED.search(t) for t in templates_of(tokens, lambda c: c.startswith("cite web"), strict=strict))
    return [m[1].rstrip() for m in found if m]


def get_cite_urls(text: str, strict: bool = True) -> list[str]:
    """URLs of ``cite web`` templates, without their scheme."""
    return cite_urls_of(tokenize(text), strict)


def is_disambiguation_of(tokens: list[Token]) -> bool:
    return next(templates_of(tokens, lambda c: template_title(c) in names("disambiguation_titles")), None) is not None


def is_disambiguation_page(text: str) -> bool:
    return is_disambiguation_of(tokenize(text))


def hatnotes_of(tokens: list[Token]) -> list[str]:
    return list(templates_of(tokens, lambda c: template_title(c) in names("hatnote_titles"), outermost=True))


def get_distinguish_hatnotes(text: str) -> list[str]:
    """Inner texts of hatnote templates."""
    return hatnotes_of(tokenize(text))


def templates_by_name_of(tokens: list[Token], wanted: list[str]) -> list[str]:
    return list(templates_of(tokens, lambda c: template_title(c) in wanted, outermost=True))


def get_templates_by_name(text: str, wanted: list[str]) -> list[str]:
    """Inner texts of templates with these titles (first letter upper-case)."""
    return templates_by_name_of(tokenize(text), wanted)


def infobox_of(tokens: list[Token]) -> str | None:
    first = next(templates_of(tokens, lambda c: c.startswith(("Infobox ", "infobox ")), outermost=True), None)
    return None if first is None else first.split("|", 1)[0][8:].strip()


def get_first_infobox_title(text: str) -> str | None:
    return infobox_of(tokenize(text))


# --- template arguments ----------------------------------------------------------------------------


def split_template(line: str, strict: bool = True) -> list[list[Token]]:
    """A template's inner text as lists of tokens, cut at each ``|`` outside links and templates.

    In strict mode a content that ends with ``|`` leaves what follows it (a link, a template) with the
    argument before, and an empty argument in its place.
    """
    done: list[list[Token]] = []
    now: list[Token] = []
    links = templates = 0
    for token in tokenize(line):
        kind, data = token
        if kind in _MARKERS:
            links += (kind == "link_start") - (kind == "link_end")
            templates += (kind == "template_start") - (kind == "template_end")
            now.append(token)
        elif kind == "content" and (links > 0 or templates > 0):
            now.append(token)
        elif kind == "content" and data:
            first, *more = data.split("|")
            if first:
                now.append(("content", first))
            if not more:
                continue
            done.append(now)
            if more[-1]:
                now = [("content", more.pop())]
            elif not strict:
                more.pop()
                now = []
            done += [[("content", m)] for m in more]
    return [*done, now] if now else done


def plain(tokens: list[Token]) -> str | None:
    """The text of a single content, else None."""
    return tokens[0][1] if len(tokens) == 1 and tokens[0][0] == "content" else None


def rendered(tokens: list[Token]) -> str:
    return "".join(_MARKERS.get(kind, data) or "" for kind, data in tokens)


def begins_with(tokens: list[Token], prefix: str) -> bool:
    return bool(tokens) and tokens[0][0] == "content" and tokens[0][1].startswith(prefix)


def inner_links(tokens: list[Token]) -> Iterator[str]:
    """Texts of links, each without the text of links inside it."""
    held: list[list[str]] = []
    for kind, data in tokens:
        if kind == "link_start":
            held.append([])
        elif kind == "link_end" and held:
            yield "".join(held.pop())
        elif kind == "content" and held:
            held[-1].append(data)


def parse_short_desc(line: str, strict: bool = True) -> str | None:
    parts = split_template(line, strict)
    text = plain(parts[1]) if len(parts) > 1 else None
    return None if text is None or text.lower() == "none" else text.replace("{{!}}", "|")


def short_desc_of(tokens: list[Token], strict: bool = True) -> str | None:
    first = next(iter(templates_by_name_of(tokens, ["Short description"])), None)
    return None if first is None else parse_short_desc(first, strict)


def get_short_description(text: str, strict: bool = True) -> str | None:
    return short_desc_of(tokenize(text), strict)


def h2_of(tokens: list[Token]) -> list[str] | None:
    """Texts of second-level headings that are plain content; None if there are none."""
    out, at = [], 0
    while at < len(tokens):
        if tokens[at] != ("element_start", "h2"):
            at += 1
            continue
        end = next((j for j in range(at + 1, len(tokens)) if tokens[j][0] == "element_end"), len(tokens))
        if end < len(tokens) and tokens[end][1] == "h2" and (text := plain(tokens[at + 1 : end])):
            out.append(text)
        at = end + 1
    return out or None


def get_h2_headings(text: str) -> list[str] | None:
    return h2_of(tokenize(text))


ABOUT, REDIRECT, FOR, DISTINGUISH = 1, 2, 3, 4


def parse_hatnote(line: str, strict: bool = True) -> list[tuple[int, str]]:
    """(kind, destination title) pairs that a hatnote template names.

    In strict mode ``For`` and ``Redirect2`` look for destinations one argument further than their
    templates put them, and ``Redirect-multi`` ignores its count; ``For-text`` counts as DISTINGUISH.
    """
    parts = split_template(line, strict)
    title = plain(parts[0]) if parts else None
    if not title:
        return []
    title, args = title[0].upper() + title[1:], parts[1:]

    def every_second(kind: int, start: int) -> list[tuple[int, str]]:
        return [(kind, rendered(a)) for a in args[start::2]]

    def linked(lists: list[list[Token]], kind: int = DISTINGUISH) -> list[tuple[int, str]]:
        return [(kind, link.split("|", 1)[0]) for tokens in lists for link in inner_links(tokens)]

    second = [(DISTINGUISH, rendered(args[1]))] if len(args) > 1 else []
    match title:
        case "About":
            return every_second(ABOUT, 2)
        case "Redirect" | "Redirect-synonym":
            return every_second(REDIRECT, 2 if strict or title == "Redirect" else 1)
        case "For":
            return every_second(FOR, 2 if strict else 1)
        case "Redirect2":
            return every_second(REDIRECT, 2 if strict else 3)
        case "Redirect-multi":
            try:
                count = int(plain(args[1 if strict else 0]) or "")
            except (IndexError, ValueError):
                return []
            return every_second(REDIRECT, 2 if strict else count + 2)
        case "About-distinguish":
            return second
        case "Redirect-distinguish":
            return [(DISTINGUISH, rendered(a)) for a in args[1:]]
        case "Redirect-distinguish-for":
            return second + every_second(FOR, 3) if second else []
        case "Distinguish":
            out = []
            for a in args:
                out += linked([a]) if begins_with(a, "text=") or begins_with(a, "Text=") else [(DISTINGUISH, rendered(a) if strict else rendered(a).strip().removeprefix("[[").removesuffix("]]").split("|", 1)[0])]
            return out
        case "Redirect-distinguish-text":
            return linked(args)
        case "About-distinguish-text":
            return linked(args[1:])
        case "For-text":
            return linked(args[1:], DISTINGUISH if strict else FOR)
    return []


def hat_edges_of(tokens: list[Token], strict: bool = True) -> list[tuple[int, str]]:
    """Cleaned (kind, title) pairs of all hatnotes of a page."""
    out = []
    for line in hatnotes_of(tokens):
        for kind, title in parse_hatnote(line, strict):
            title = title.split("{{!", 1)[0]
            if title and "#" not in title:
                out.append((kind, title[0].upper() + title[1:]))
    return out


def parse_wiki_link(line: str | None) -> str | None:
    """A link's destination title: trimmed, first letter upper-cased, cut at ``|`` and ``#``; None if empty."""
    line = (line or "").strip()
    return (line[:1].upper() + line[1:]).split("|", 1)[0].split("#", 1)[0] or None
