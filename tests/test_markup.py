"""Main text by the document tree: cases, random trees against removal in the tree, and long pages in linear time."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lexatlas.functions.markup import DROPPED, visible_text
from lexatlas.operators import consent, pages

CASES = {
    "<p>one</p><svg-icon></svg-icon><p>two</p><svg></svg><p>three</p>": "one two three",
    "<nav><nav>a</nav>b</nav>c": "c",
    "<nav-bar>kept</nav-bar><navigation>kept</navigation><headers>kept</headers>": "kept kept kept",
    "<p title='a>b'>x</p><!-- <nav> -->y<nav title=\"</nav>\">no</nav>z": "x y z",
    "<div><nav>menu</div>text": "text",
    "<nav><div>a</nav>b</div>c": "b c",
    "<b><nav>x</b>y</nav>z": "z",
    "<table><tr><td><nav>x</td></tr></table>y": "y",
    "<div><table><tr><td>a</div>b</td></tr></table></div>c": "a b c",
    "<svg><path/><g><text>no</text></g><p>shown</p>": "shown",
    "<svg><foreignObject><p>no</p></foreignObject></svg>shown": "shown",
    "<svg/>a<path/>b": "a b",
    "<nav/>menu": "",
    "<SCRIPT>if (a < b) '</nav>'</SCRIPT >q<noscript>n</noscript>": "q",
    "<script>never ended <p>x": "",
    "<textarea><nav>a</nav></textarea>": "<nav>a</nav>",
    "a < b <3 & c": "a < b <3 & c",
    "<title>t</title><p>x": "x",
    "<head><title>t</title></head>lost<body class=a><title>u</title>v": "u v",
    "<!doctype html><?xml?></>x<!-->y<!-- <body> open": "x y",
    "<p>x<div class='": "x",
    "<p a=\"never ended>x</p>y": "x y",
    "": "",
}


@pytest.mark.parametrize("html", CASES)
def test_cases(html):
    assert " ".join(visible_text(html).split()) == CASES[html]


def test_random_trees():
    rng = random.Random(7)
    names = ["div", "section", "span", "b", "nav", "header", "footer", "noscript", "nav-item", "article"]
    words = iter(range(10**9))

    def tree(depth):
        """HTML, and the words that stay."""
        html, kept = "", []
        for _ in range(rng.randrange(1, 5)):
            kind = rng.random()
            if kind < 0.4 or depth > 6:
                w = f"w{next(words)}"
                html, kept = html + f"{w} ", [*kept, w]
            elif kind < 0.5:
                html += rng.choice(["<!-- <nav> </div> -->", "<br>", "<script>var a = '<nav>';</script>", "<style>nav > b {}</style>", "<svg><g>x</g></svg>", '<img alt="</nav>">'])
            else:
                name, (inner, words_in) = rng.choice(names), tree(depth + 1)
                html += f"<{name}{rng.choice(['', ' class=x', ' title="a > b"', " data-x='<nav>'"])}>{inner}</{name}>"
                kept += [] if name in DROPPED else words_in
        return html, kept

    for _ in range(300):
        html, kept = tree(0)
        assert visible_text(html).split() == kept
        assert visible_text(f"<head><title>t</title></head>x<body>{html}").split() == kept


def test_long_pages_are_linear():
    start = time.time()
    for html in ("<b>" * 200_000 + "</div>" * 200_000, "<div><table>" + "<i>" * 100_000 + "</div>" * 100_000, '<p class="a' * 50_000, "<" * 300_000, "<!--" * 100_000, "<nav>" * 100_000 + "x"):
        visible_text(html)
    assert time.time() - start < 20


def test_columns(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<body>a &amp; b<nav>x</nav></body>")]
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: None, 2: "", 3: "a & b"}


def test_prefixes_are_compared_with_kept_text_only(spark):
    a, b, c = "A" * 60, "A" * 55 + "Z" * 60, "Z" * 55
    rows = [(1, 0, a), (1, 1, b), (1, 2, c), (2, 0, b), (2, 1, c), (2, 2, a), (3, 5, None), (3, 6, "x"), (3, 7, ""), (4, 1, "same"), (4, 2, "same")]
    got = consent.dedupe_prefix(spark.createDataFrame(rows, "page_id long, pos int, text string")).select("page_id", "pos").collect()
    assert sorted(map(tuple, got)) == [(1, 0), (1, 2), (2, 0), (3, 5), (3, 6), (4, 1)]


def test_prefixes_of_random_segments(spark):
    rng = random.Random(2)
    rows = [(p, i, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 9)))) for p in range(40) for i in range(12)]
    want, kept = [], {}
    for p, i, text in rows:
        if not any(text[:3] in t for t in kept.setdefault(p, [])):
            kept[p].append(text)
            want.append((p, i))
    df = spark.createDataFrame(rows, "page_id long, pos int, text string").orderBy(F.rand(1))
    assert sorted(map(tuple, consent.dedupe_prefix(df, 3).select("page_id", "pos").collect())) == want
