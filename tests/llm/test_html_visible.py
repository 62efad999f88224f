"""Text that is visible although rules for other media, rows or drawings hold it."""

import pytest

from lexatlas.llm import html_text

SHEETS = [
    ("@media print { header, .side { display: none } }", set()),
    ("@media (max-width: 600px) { .side { display: none } } .a { display: none }", {".a"}),
    ("@media only screen and (max-width:9px){.x{display:none}.y{color:red}}.b,#c{visibility:hidden}", {".b", "#c"}),
    ("@media print { @supports (display: grid) { .x { display: none } } } .d{display:none}", {".d"}),
    ("@media screen { .e { display: none } } @media print, SCREEN {.f{display:none}} @media all{.g{display:none}}", {".e", ".f", ".g"}),
    ("@layer base { .h { color: red; display: none; } } @supports not (display:grid) { .i { display:none } }", {".h"}),
    ("@charset \"x\"; .j{content:'}{';display:none} /* .k { display:none } } */ .l{display:none}", {".j", ".l"}),
    (".m { color: red; .n { display: none } } .o { @media print { display: none } } .p{display:none}", {".p"}),
    ("<!-- .q{display:none} -->", {".q"}),
    ("@keyframes z { from { visibility: hidden } } .r{display:none}} .s{display:none}", {".r", ".s"}),
]


@pytest.mark.parametrize(("css", "hidden"), SHEETS)
def test_rules_that_hold_on_every_screen(css, hidden):
    assert html_text.hidden_selectors(html_text.parse(f"<style>{css}</style>"), set()) == hidden


VISIBLE = [
    ("<style>@media print { header, .side { display: none } }</style><header>top</header><div class=side>side</div>", "top\nside"),
    ("<style media=print>p{display:none}</style><p>shown", "shown"),
    ("<style>.a{display:none}</style><p class=a>x<p>y", "y"),
    ("<table><tr>loose<td>a<td>b</tr><tr><td>c</td>more</tr></table>", "loose\nmore\na | b\nc"),
    ("<p>see <svg viewBox='0 0 1 1'><title>icon</title><defs><text>no</text></defs><path d='M0 0'/><desc>no</desc><text>Sales</text><text>Costs</text></svg>here", "see Sales Costs here"),
    ("<svg><defs/><style/><title/><g><text><![CDATA[a > b]]></text></g></svg><p>after", "a > b\n\nafter"),
    ("<p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation>x=1</annotation></semantics></math>.", "so x=1."),
    ("<div/>in<svg hidden><text>no</text></svg>", "in"),
]


@pytest.mark.parametrize(("source", "text"), VISIBLE)
def test_visible_text_is_emitted(source, text):
    assert html_text.render(source) == text
