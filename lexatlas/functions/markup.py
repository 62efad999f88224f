"""Text of pages without elements that are no content, removed as the document tree has them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DROPPED = ("script", "style", "nav", "header", "footer", "svg", "noscript")

# Element names by their part in building the tree, as the HTML standard lists them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is characters up to their own end tag.
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
#: Start tags that end a drawing they stand in.
LEAVES_SVG = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span "
    "strong strike sub sup table tt u ul var".split()
)
#: Parts of a drawing that hold HTML.
HOLDS_HTML = frozenset("foreignobject desc title".split())
#: No end tag reaches beyond these.
SCOPE = frozenset("applet caption html table td th marquee object template foreignobject".split())
#: End tags of other elements do not reach beyond these.
SPECIAL = SCOPE | frozenset(
    "address article aside blockquote body button center dd details dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head "
    "header hgroup iframe li listing main menu nav noembed noframes noscript ol p plaintext pre script search section select style summary tbody "
    "textarea tfoot thead title tr ul xmp".split()
)

#: A comment, a tag (end mark, name, attributes), or what a browser reads as a comment.
TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z].*\Z""", re.S
)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class _Open:
    """The open elements, with the places of each name and of those that end tags do not pass."""

    def __init__(self, dropped: frozenset[str]):
        self.dropped, self.names, self.at, self.scope, self.special, self.hidden = dropped, [], {}, [], [], 0

    def push(self, name: str) -> None:
        for places in (self.at.setdefault(name, []), *([self.scope] if name in SCOPE else []), *([self.special] if name in SPECIAL else [])):
            places.append(len(self.names))
        self.names.append(name)
        self.hidden += name in self.dropped

    def last(self, name: str) -> int:
        places = self.at.get(name)
        return places[-1] if places else -1

    def pop_to(self, place: int) -> None:
        while len(self.names) > place:
            name = self.names.pop()
            for places in (self.at[name], self.scope, self.special):
                if places and places[-1] == len(self.names):
                    places.pop()
            self.hidden -= name in self.dropped

    def end(self, name: str) -> None:
        place = self.last(name)
        walls = self.scope if name in SPECIAL else self.special
        if place >= 0 and (name in SCOPE or not walls or walls[-1] <= place):
            self.pop_to(place)

    def in_svg(self) -> bool:
        return self.last("svg") > max(map(self.last, HOLDS_HTML))


def visible_text(html: str | None, dropped: frozenset[str] = frozenset(DROPPED)) -> str | None:
    """The text of a page's body, a blank for each tag and comment, without ``dropped`` elements. Elements nest by end
    tags as in a browser: an end tag closes what is open inside its element, but reaches across no table cell, and that
    of an inline element across no block; a drawing ends at the first block in it. Text before the body's tag does not count;
    without one, titles do not. One pass; character references stay."""
    if html is None:
        return None
    out: list[str] = []
    open_, pos, body = _Open(dropped), 0, False
    while m := TOKEN.search(html, pos):
        if not open_.hidden:
            out += (html[pos : m.start()], " ")
        pos = m.end()
        closing, name, rest = m.groups()
        if name is None:
            continue
        name = name.lower()
        if closing:
            open_.end(name)
            continue
        if name == "body":
            if not body:
                body = True
                out.clear()
                open_.pop_to(0)
            continue
        if open_.in_svg():
            if name in LEAVES_SVG:
                open_.pop_to(open_.last("svg"))
            elif not rest.endswith("/"):
                open_.push(name)
                continue
            else:
                continue
        if name in VOID or (name == "svg" and rest.endswith("/")):
            continue
        if name in RAW:
            end = _ENDS[name].search(html, pos)
            stop = end.start() if end else len(html)
            if not open_.hidden and name not in dropped and (body or name != "title"):
                out.append(html[pos:stop])
            pos = stop
        open_.push(name)
        if name in RAW and pos == len(html):
            break
    if not open_.hidden:
        out.append(html[pos:])
    return "".join(out)


def body_text(html: Column, dropped: tuple[str, ...] = DROPPED) -> Column:
    """``visible_text`` of a column. A plain function, whose rows reach Python a hundred at a time: batches of Arrow hold ten
    thousand pages at once. Marked nondeterministic, so that Spark repeats it in no filter behind it."""
    names = frozenset(dropped)
    return F.udf(lambda page: visible_text(page, names), "string", useArrow=False).asNondeterministic()(html)
