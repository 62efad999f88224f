"""Pages of random trees against a plain walk; linear time; the cascade; row spans."""

import random
import re
import time
from html.parser import HTMLParser

import pytest

from lexatlas.llm import html_text

CASES = [
    ("<style>.a{display:none}.a{display:block}</style><p class=a>shown", "shown"),
    ("<style>.a{display:block}p{display:none}</style><p class=a>shown<p>not", "shown"),
    ("<style>#i{display:none}.a{display:block}</style><p class=a id=i>not", ""),
    ("<STYLE>.a{display:none}</Style><p class=a>not<p>shown", "shown"),
    ("<style>.a{display:none}</style><p class=a style='display:block'>shown", "shown"),
    ("<div style='visibility:hidden'>no<p>no<b style='visibility:visible'>yes</b> no</div>", "yes"),
    ("<ul style='visibility:hidden'><li>a<li style='visibility:visible'>b</ul>", "- b"),
    ("<div style='display:none'>no<b style='visibility:visible;display:block'>no</b></div>yes", "yes"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
    ("<table><tr><td>x<td rowspan=3 colspan=2>y<td>z<tr><td>1<td>2</table>", "x | y |  | z\n1 |   |  | 2"),
    ("a < b <3 <a", "a < b <3 <a"),
    ("1 <a '>x</a> <b \">\">y</b>", "1 x y"),
]


@pytest.mark.parametrize(("source", "text"), CASES)
def test_cases(source, text):
    assert html_text.render(source) == text


@pytest.mark.parametrize("unit", ["<a ", "<a '", '<a ">" ', "<a", "<", "</a ", "<div>", "<p>", "<td>", "<!", "<!-", "<a x='\">\"' ", "&", "<b><p></b>", "<table>", "<li>", "'>\"<a "])
def test_a_megabyte_of_unclosed_tags(unit):
    start = time.process_time()
    html_text.parse(unit * (1_000_000 // len(unit)))
    html_text.parse(unit * (1_000_000 // len(unit)) + ">")
    assert time.process_time() - start < 16  # either in proportion to the page: a second or two on an idle core


class Walk(HTMLParser):
    """Words of a well-formed page: each element's own display and visibility."""

    def __init__(self):
        super().__init__()
        self.stack, self.words = [(True, True)], []

    def handle_starttag(self, tag, attrs):
        a, (display, shown) = dict(attrs), self.stack[-1]
        style, kind = a.get("style", ""), a.get("class", "")
        gone = {"x": True, "y": False}.get(kind, False)
        if "display" in style:
            gone = "none" in style
        if "visibility" in style:
            shown = "visible" in style
        self.stack.append((display and not gone and "hidden" not in a, shown))

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        if all(self.stack[-1]):
            self.words += re.findall(r"w\d+", data)


def tree(rng, depth, count):
    out = []
    for _ in range(rng.randrange(1, 4)):
        count[0] += 1
        out.append(f" w{count[0]} ")
        if depth and rng.random() < 0.8:
            tag = rng.choice(["div", "span", "b", "section", "blockquote", "em"])
            attr = rng.choice(["", "", "", "class=x", "class=y", "hidden", "style='display:none'", "style='visibility:hidden'", "style='visibility: visible'", "class=x style='display: block'"])
            out.append(f"<{tag} {attr}>{tree(rng, depth - 1, count)}</{tag}>")
    return "".join(out)


def test_random_trees():
    rng = random.Random(31)
    for _ in range(300):
        body = tree(rng, 6, [0])
        walk = Walk()
        walk.feed(body)
        text = html_text.render(f"<style>.x{{display:none}} .y{{display:none}} .y{{display:block}}</style>{body}")
        assert re.findall(r"w\d+", text) == walk.words
