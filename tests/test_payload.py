"""Prose of scripts: islands, nested and encoded values, literals, streamed rows."""

import json
import time

from lexatlas.functions.payload import payload_strings
from lexatlas.operators import pages

A, B = "First text with blanks. " * 10, "Second text, the longer one. " * 12


def test_values_at_any_depth_and_never_keys():
    key = "k " * 200
    value = {key: {"list": [1, None, {"body": A}, ["x", [B]]]}, "short": "a b"}
    html = f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(value)}</script>'
    assert payload_strings(html, 200) == [A, B]
    twice = f'<script type="application/ld+json">{json.dumps({"p": json.dumps({key: json.dumps([A])})})}</script>'
    assert payload_strings(twice, 200) == [A]
    assert payload_strings(f"<script>window.__NUXT__ = {json.dumps(value)};</script>", 200) == [A, B]


def test_literals_and_streamed_rows():
    push = lambda s: f"<script>self.__next_f.push([1,{json.dumps(s)}])</script>"
    assert payload_strings(push(A) + push("x" * 500) + push("short one"), 200) == [A]
    assert payload_strings(push(f'1:["$","p",{{"children":{json.dumps(A)}}}]\n2:{{"html":{json.dumps(B)}}}'), 200) == [A, B]
    assert payload_strings("<script type='application/json'>{broken \"" + A + '"</script>', 200) == [A]


def test_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "<p>none</p>"), (4, "<script></script>"), (5, '<script type="application/json">null</script>'), (6, "<script>\"" + A + "</script>"), (7, f'<SCRIPT TYPE="application/json">["{A}"]</SCRIPT >')]
    got = {r["page_id"]: r["text"] for r in pages.payload_prose(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got == {7: A.strip()}


def test_deep_and_long_payloads_end():
    start = time.time()
    payload_strings('<script type="application/json">' + "[" * 100_000 + "</script>", 200)
    payload_strings('<script>x("' + "\\\\" * 100_000 + "</script>" + "<script " * 20_000, 200)
    value = A
    for _ in range(6):
        value = json.dumps([value])
    assert payload_strings(f'<script type="application/json">{value}</script>', 200) == [A]
    assert time.time() - start < 20
