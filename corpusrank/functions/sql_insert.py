"""MySQL dump lines: ``INSERT INTO t VALUES (...),(...);`` as a table name and rows of literals."""

from __future__ import annotations

import re

Literal = None | int | float | str | bytes

_HEAD = re.compile(r"\s*INSERT\s+(?:IGNORE\s+)?INTO\s+`?([A-Za-z0-9_$]+)`?\s*(?:\([^)]*\)\s*)?VALUES\s*", re.I)
_VALUE = re.compile(
    r"\s*(?:(?P<string>'(?:[^'\\]++|\\.|'')*+')|(?P<hex>0x[0-9A-Fa-f]+|[xX]'[0-9A-Fa-f]*')|(?P<fixed>[+-]?\d*\.\d+(?:[eE][+-]?\d+)?|[+-]?\d+[eE][+-]?\d+)|(?P<int>[+-]?\d+)"
    r"|(?P<none>NULL|CURRENT_(?:TIMESTAMP|DATE|TIME)(?:\(\))?|\?)|(?P<truth>TRUE|FALSE)|_binary\s+(?P<blob>'(?:[^'\\]++|\\.|'')*+'))\s*",
    re.I | re.S,
)
_ESCAPE = re.compile(r"\\(.)|''", re.S)
_ESCAPES = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a"}


def _unquote(text: str) -> str:
    return _ESCAPE.sub(lambda m: "'" if m[1] is None else _ESCAPES.get(m[1], m[1]), text[1:-1])


def _literal(m: re.Match) -> Literal:
    kind, text = m.lastgroup, m[m.lastgroup]
    if kind == "string":
        return _unquote(text)
    if kind == "int":
        return int(text)
    if kind == "fixed":
        return float(text)
    if kind == "hex":
        digits = text[2:].strip("'")
        return bytes.fromhex("0" * (len(digits) % 2) + digits)
    if kind == "blob":
        return _unquote(text).encode("utf-8", "surrogateescape")
    return int(text.upper() == "TRUE") if kind == "truth" else None


def parse_insert_statement(line: str | bytes) -> tuple[str, list[list[Literal]]]:
    """Table and rows of one INSERT statement; anything else raises ValueError."""
    text = line.decode("utf-8", "surrogateescape") if isinstance(line, bytes) else line
    head = _HEAD.match(text)
    if head is None:
        raise ValueError("not an INSERT statement")
    rows: list[list[Literal]] = []
    at = head.end()
    while True:
        if text[at : at + 1] != "(":
            raise ValueError(f"expected ( at {at}")
        at += 1
        row: list[Literal] = []
        while True:
            m = _VALUE.match(text, at)
            if m is None:
                raise ValueError(f"unknown literal at {at}")
            row.append(_literal(m))
            at = m.end()
            sign = text[at : at + 1]
            at += 1
            if sign == ")":
                break
            if sign != ",":
                raise ValueError(f"expected , or ) at {at - 1}")
        rows.append(row)
        rest = re.compile(r"\s*([,;]?)\s*").match(text, at)
        at = rest.end()
        if rest[1] != ",":
            if text[at:].strip():
                raise ValueError(f"unexpected text at {at}")
            return head[1], rows


def rows_as_text(line: str | None) -> list[tuple[str, list[str | None]]]:
    """(table, values as text) of each row; lines that are no INSERT statement give none."""
    try:
        table, rows = parse_insert_statement(line or "")
    except ValueError:
        return []
    as_text = lambda v: None if v is None else v.hex() if isinstance(v, bytes) else str(v)
    return [(table, [as_text(v) for v in row]) for row in rows]
