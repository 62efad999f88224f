"""The cascade: importance, compound selectors, hidden attributes that styles overrule, spans to a group's end."""

import random
import time

import pytest

from lexatlas.llm import html_text

CASES = [
    ("<p hidden style='display:block'>A", "A"),
    ("<style>[hidden]{display:block}</style><p hidden>A", "A"),
    ("<style>p{color:red}</style><p hidden>A", ""),
    ("<style>.x{display:none!important}.x{display:block}</style><p class=x>no<p>yes", "yes"),
    ("<style>.x{display:none ! important}</style><p class=x style='display:block'>no<p>yes", "yes"),
    ("<style>.x{display:none!important}</style><p class=x style='display:block!important'>yes", "yes"),
    ("<style>div p{display:none}</style><div><section><p>no</section></div><p>yes", "yes"),
    ("<style>div > p{display:none}</style><div><section><p>yes</section><p>no</div>", "yes"),
    ("<style>.a.b{display:none}</style><p class='a'>yes<p class='b a'>no", "yes"),
    ("<style>p.a{display:none}.a{display:block}</style><p class=a>no<div class=a>yes</div>", "yes"),
    ("<style>main *{display:none}</style><main>text<b>no</b></main>", "text"),
    ("<style>a > b c{visibility:hidden} i{display:none}</style><a><b><d><c>no</c><i>no</i></d></b></a><b><c>yes</c></b>", "yes"),
    ("<style>div > p b{display:none}</style><div><p><i><p><b>no</b></div>", ""),
    ("<style>input[type=text], [data-x='1 2'] {display:none}</style><i data-x='1 2'>no</i><i data-x=1>yes</i>", "yes"),
    ("<style>p:hover{display:none} p + p{display:none} p ~ p{display:none}</style><p>a<p>b", "a\n\nb"),
    ("<style>, .a >{display:none} > p{display:none}</style><p class=a>a", "a"),
    ("<dialog>no</dialog><dialog open>yes</dialog><dialog style='display:block'>too</dialog>", "yes\ntoo"),
    ("<svg><defs style='display:block'><text>no</text></defs><text>yes</text></svg>", "yes"),
    ("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
    ("<table><tbody><tr><td rowspan=9>a<td>b<tbody><tr><td>c</table>", "a | b\nc"),
]


@pytest.mark.parametrize(("source", "text"), CASES)
def test_cascade(source, text):
    assert [x for x in html_text.render(source).split("\n") if x] == [x for x in text.split("\n") if x]


def _holds(steps, chain):
    """Brute force over all ways to lay the steps of (child, wanted classes) on the chain of class sets, root first."""
    if not steps[-1][1] <= chain[-1]:
        return False
    if len(steps) == 1:
        return True
    ends = range(len(chain) - 1, len(chain)) if steps[-1][0] else range(1, len(chain))
    return any(_holds(steps[:-1], chain[:e]) for e in ends if e)


def test_chains_of_selectors_equal_brute_force():
    rng = random.Random(3)
    for _ in range(3000):
        chain = [set(rng.sample("abc", rng.randrange(4))) for _ in range(rng.randrange(1, 6))]
        steps = [(i > 0 and rng.random() < 0.5, set(rng.sample("abc", rng.randrange(1, 3)))) for i in range(rng.randrange(1, 5))]
        css = "".join((" > " if child else " " if i else "") + "".join(f".{c}" for c in sorted(names)) for i, (child, names) in enumerate(steps))
        page = "".join(f"<div class='{' '.join(c)}'>" for c in chain)
        shown = html_text.render(f"<style>{css}{{color:red;visibility:hidden}}</style><section>{page}word")
        assert (shown == "") == any(_holds(steps, chain[: k + 1]) for k in range(len(chain))), (css, page)


def test_many_rules_and_deep_pages_take_time_in_proportion():
    css = "".join(f"div div .q{i} div div{{display:none}}.x{{display:none}}p{{color:red}}.x{{display:block}}" for i in range(2000))
    began = time.process_time()
    assert html_text.render(f"<style>{css} div div div > div > b div{{display:none}}</style>" + "<div>" * 400 + "deep" + "<p class=x>x" * 2000).startswith("deep\n\nx")
    assert time.process_time() - began < 20
