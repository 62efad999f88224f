"""Prose that scripts of pages carry as data."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

SCRIPT = re.compile(r"<script(?=[\s/>])", re.I)
ATTRIBUTES = re.compile(r"""((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)>""")
END = re.compile(r"</script(?=[\s/>])", re.I)
ISLAND = re.compile(r"application/(?:[\w.+-]*\+)?json|__NEXT_DATA__|__NUXT__", re.I)
ASSIGNED = re.compile(r"^\s*(?:window\.)?\w+\s*=\s*")
LITERAL = re.compile(r'"(?:[^"\\]++|\\.)*+"', re.S)
#: A line of a streamed payload: a number, a colon and a value.
STREAMED = re.compile(r"^[0-9a-f]+:(?=[\[{\"])", re.M)


def _parsed(source: str):
    try:
        return json.loads(source, strict=False)
    except (ValueError, RecursionError):
        return None


def _values(value, least: int) -> Iterator[str]:
    """Strings of at least ``least`` characters with a blank below a value, in order; those that hold JSON themselves are
    looked into. Keys are not strings of the value."""
    waiting = [value]
    while waiting:
        v = waiting.pop()
        if isinstance(v, dict):
            waiting += reversed(v.values())
        elif isinstance(v, list):
            waiting += reversed(v)
        elif isinstance(v, str) and len(v) >= least:
            if v.lstrip()[:1] in ("{", "[", '"') and isinstance(inner := _parsed(v), (dict, list, str)):
                waiting.append(inner)
            elif len(rows := STREAMED.split(v)) > 1 and any(map(_parsed, rows)):
                waiting += reversed([inner if (inner := _parsed(row)) is not None else row for row in rows])
            elif any(map(str.isspace, v)):
                yield v


def _scripts(html: str) -> Iterator[tuple[str, str]]:
    """(attributes, body) of each script that ends."""
    pos = 0
    while (start := SCRIPT.search(html, pos)) and (head := ATTRIBUTES.match(html, start.end())) and (end := END.search(html, head.end())):
        yield head[1], html[head.end() : end.start()]
        pos = end.end()


def payload_strings(html: str, least: int) -> list[str]:
    """Of each script the strings of its JSON, or, where it is none, of its quoted literals."""
    out: list[str] = []
    for attributes, body in _scripts(html):
        if ISLAND.search(attributes) or ISLAND.search(body):
            value = _parsed(ASSIGNED.sub("", body).rstrip().rstrip(";"))
            if value is not None:
                out += _values(value, least)
                continue
        for literal in LITERAL.findall(body):
            if len(literal) >= least and (value := _parsed(literal)):
                out += _values(value, least)
    return out


def payloads(html: Column, least: int) -> Column:
    """``payload_strings`` of a column; pages without a script are not parsed. As in ``markup.body_text``, rows come a hundred
    at a time and once only."""
    strings = F.udf(lambda page: payload_strings(page, least) if page else [], "array<string>", useArrow=False).asNondeterministic()
    return strings(F.when(html.rlike("(?i)<script"), html))
