"""Layout-aware text of HTML pages."""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
MARK = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
BLANKS = re.compile(r"[ \t\n\r\f]+")
CSS_NOISE = re.compile(r"/\*(?s:.*?)(?:\*/|\Z)|<!--|-->")
CSS_MARK = re.compile(r"\"(?:[^\"\\\n]|\\(?s:.))*+\"|'(?:[^'\\\n]|\\(?s:.))*+'|[{};]")
DRAWING = re.compile(r"<(?:svg|math)(?=[\s/>])", re.I)
SIMPLE = re.compile(r"[.#]?[A-Za-z_][\w-]*\Z")
#: Parts of a selector: a tag or *, .class, #id, [attribute] or [attribute=value], blanks or >.
PART = re.compile(r"\s*(>)\s*|(\s+)|([.#]?)((?:[A-Za-z_]|-(?=[\w-]))[\w-]*)|(\*)|\[\s*([\w-]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[\w-]+)\s*)?\]")
#: Attribute of elements that are not drawn at all; no page can spell it.
UNDRAWN_MARK = " undrawn"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes object audio video canvas datalist param meta link base map".split())
#: Parts of drawings and formulas that are not shown where they stand.
UNDRAWN = {
    "svg": frozenset("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient filter".split()),
    "math": frozenset("annotation annotation-xml".split()),
}
#: Media queries that hold on every screen.
SCREENS = frozenset(["", "all", "screen", "only all", "only screen", "not print", "not speech"])
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset menu dir".split())
CLOSES_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot caption option optgroup".split())
#: Start tags that end open elements, and the elements that those do not look beyond.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir", "table")),
    "dt": (("dt", "dd"), ("dl", "table")), "dd": (("dt", "dd"), ("dl", "table")),
    "option": (("option",), ("select", "datalist", "optgroup")), "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr", "td", "th", "caption"), ("table", "tbody", "thead", "tfoot")),
    "tbody": (("tbody", "thead", "tfoot", "caption", "tr"), ("table",)), "thead": (("tbody", "thead", "tfoot", "caption"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "caption", "tr"), ("table",)), "body": (("head",), ()),
}
PARENTS = {"td": ("tr",), "th": ("tr",), "tr": ("tbody", "thead", "tfoot", "table")}
#: Elements nested deeper become siblings, as in browsers.
DEPTH = 512
#: A table column is padded up to this width; longer cells are kept whole.
COLUMN = 60


class Tags:
    """Where tags end, found in time in proportion to the page however many of them never do."""

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self.ends = {'"': source.rfind('"'), "'": source.rfind("'")}
        self.lost: set[int] = set()  # ends of quoted values behind which no tag ends outside quotes

    def end(self, at: int) -> int:
        """Index of the '>' that ends the tag whose name ends at ``at``: outside quotes, else the next; -1 if none."""
        if at > self.last:
            return -1
        seen, place = [], at
        while place <= self.last and place not in self.lost:
            m = MARK.search(self.source, place)
            if m[0] == ">":
                return m.start()
            if m.start() == self.ends[m[0]]:
                break  # the value never ends
            place = self.source.index(m[0], m.end()) + 1
            seen.append(place)
        self.lost.update(seen)
        return self.source.find(">", at)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(value[1:-1] if value[:1] in "\"'" and len(value) > 1 else value))
    return out


def parse(source: str) -> Node:
    """Element tree of a page: void elements, raw text, implied end tags and table parts, misnested and missing tags.
    Elements nested deeper than DEPTH become siblings; a '<' that starts no tag, or one that never ends, is text."""
    root = Node("html", {})
    stack = [root]
    opened: dict[str, int] = {}  # how many elements of each tag are open
    drawn, tags = DRAWING.search(source) is not None, Tags(source)

    def push(node: Node) -> None:
        stack.append(node)
        opened[node.tag] = opened.get(node.tag, 0) + 1

    def cut(i: int, j: int | None = None) -> None:
        for x in stack[i:j]:
            opened[x.tag] -= 1
        del stack[i:j]

    def close_to(names: tuple[str, ...], stops: tuple[str, ...]) -> None:
        """Close the outermost of the tags that are open within the stops."""
        if not any(opened.get(t) for t in names):
            return
        found = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in stops:
                break
            found = i if stack[i].tag in names else found
        if found:
            cut(found)

    at, n = 0, len(source)
    while at < n:
        begin, name, close = source.find("<", at), None, -1
        while begin >= 0:  # the next tag, comment or declaration
            if source.startswith("<!--", begin):
                close = source.find("-->", begin + 4)
                close = n - 1 if close < 0 else close + 2
                break
            if begin > tags.last:
                begin = -1
                break
            if source.startswith(("<!", "<?"), begin):
                close = source.index(">", begin)
                break
            if name := NAME.match(source, begin):
                close = tags.end(name.end())
                break
            begin = source.find("<", begin + 1)
        if begin < 0 or begin > at:
            text = source[at : begin if begin >= 0 else n]
            stack[-1].children.append(html.unescape(text) if "&" in text else text)
            if begin < 0:
                break
        at = close + 1
        if name is None:
            if drawn and source.startswith("<![CDATA[", begin) and any(x.tag in UNDRAWN for x in stack):
                close = source.find("]]>", begin)
                stack[-1].children.append(source[begin + 9 : close if close >= 0 else n])
                at = close + 3 if close >= 0 else n
            continue
        end, tag, attrs = name[1], name[2], source[name.end() : close]
        tag = tag.lower()
        if end:
            if not opened.get(tag):
                if tag == "p":
                    stack[-1].children.append(Node("p", {}))
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag not in BLOCKS and any(x.tag in BLOCKS for x in stack[i + 1 :]):
                        cut(i, i + 1)  # a block outlives the end of inline markup that holds it
                    else:
                        cut(i)
                    break
                if stack[i].tag in ("td", "th", "table") and tag not in ("tr", "table", "tbody", "thead", "tfoot"):
                    break
            continue
        if tag in ("html", "body") and (tag == "html" or opened.get("body")):
            continue
        if stack[-1].tag == "head" and tag not in UNSEEN:
            close_to(("head",), ())
        if tag in CLOSES_P:
            close_to(("p",), ("button", "td", "th", "table", "caption", "object"))
        if tag in IMPLIED:
            close_to(*IMPLIED[tag])
        if tag in PARENTS and stack[-1].tag not in PARENTS[tag]:
            if opened.get("table"):
                made = Node(PARENTS[tag][0] if tag != "tr" else "tbody", {})
                stack[-1].children.append(made)
                push(made)
        node = Node(tag, _attributes(attrs) if attrs and not attrs.isspace() else {})
        if drawn and any(tag in UNDRAWN[x.tag] for x in stack if x.tag in UNDRAWN):
            node.attrs[UNDRAWN_MARK] = ""
        stack[-1].children.append(node)
        if drawn and attrs and attrs.endswith("/") and (tag in UNDRAWN or any(x.tag in UNDRAWN for x in stack)):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            text = source[at : close.start() if close else n]
            node.children.append(html.unescape(text) if tag in ("textarea", "title") else text)
            at = close.end() if close else n
        elif tag not in VOID and len(stack) < DEPTH:
            push(node)  # a slash does not close an element of HTML, but one of svg or math
    return root


def _on_screens(query: str) -> bool:
    """Does a media query hold on every screen?"""
    return any(" ".join(x.lower().split()) in SCREENS for x in query.split(","))


def style_rules(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules that hold on every screen: those outside other blocks, and in blocks of
    @media with a query that says so, of @layer and of @supports without "not"."""
    css, at = CSS_NOISE.sub(" ", css), 0
    blocks: list[tuple[str | None, list[str], bool]] = []  # selectors (None: an at-rule), declarations, do rules in it hold
    for m in CSS_MARK.finditer(css):
        if len(m[0]) > 1:
            continue  # a string
        text, at = css[at : m.start()].strip(), m.end()
        if m[0] == "{":
            holds = not blocks or blocks[-1][0] is None and blocks[-1][2]
            if text.startswith("@"):
                rule = re.match(r"@([\w-]*)((?s:.*))", text)
                name, query = rule[1].lower(), rule[2]
                blocks.append((None, [], holds and (name == "media" and _on_screens(query) or name == "layer" or name == "supports" and not re.search(r"\bnot\b", query, re.I))))
            else:
                blocks.append((text, [], holds))
        elif blocks:
            blocks[-1][1].append(text)
            if m[0] == "}":
                names, body, holds = blocks.pop()
                if names is not None and holds:
                    yield names, ";".join(body)


def declared(body: str) -> dict[str, tuple[bool, bool]]:
    """By display and visibility: whether the declaration that counts is important, and whether it shows the element. The
    last one counts, and important ones before all others."""
    out: dict[str, tuple[bool, bool]] = {}
    for part in body.split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if important := re.search(r"!\s*important\Z", value):
            value = value[: important.start()].strip()
        if name == "display" and value:
            shown = value != "none"
        elif name == "visibility" and value in ("visible", "hidden", "collapse"):
            shown = value == "visible"
        else:
            continue
        if important or not out.get(name, (False, True))[0]:
            out[name] = (bool(important), shown)
    return out


class Compound:
    """What one element of a selector has to be: its tag (None: any), id, classes and attributes."""

    __slots__ = ("tag", "ids", "classes", "attrs", "child")

    def __init__(self):
        self.tag, self.ids, self.classes, self.attrs = None, [], [], []
        self.child = False  # must the element before be its parent (else: any ancestor)

    def fits(self, node: Node) -> bool:
        a = node.attrs
        if self.tag is not None and self.tag != node.tag or any(a.get("id") != i for i in self.ids):
            return False
        if self.classes:
            own = a.get("class", "").split()
            if any(c not in own for c in self.classes):
                return False
        return all(name in a and (value is None or a[name] == value) for name, value in self.attrs)

    def key(self) -> str:
        """One thing that every element that fits has."""
        return f"#{self.ids[0]}" if self.ids else f".{self.classes[0]}" if self.classes else self.tag or "*"


def selector(text: str) -> list[Compound] | None:
    """The compounds of a selector of tags, ids, classes, attributes, descendants and children, left to right; None for
    any other (those with siblings or pseudo-classes hold in some states or places only and hide nothing)."""
    steps, empty, at = [Compound()], True, 0
    while at < len(text):
        m = PART.match(text, at)
        if m is None:
            return None
        at = m.end()
        if m[1] or m[2]:
            if empty:
                return None
            steps.append(Compound())
            steps[-1].child, empty = bool(m[1]), True
            continue
        last = steps[-1]
        if m[4] and not m[3] or m[5]:
            if not empty:
                return None
            last.tag = m[4].lower() if m[4] else None
        elif m[4]:
            (last.classes if m[3] == "." else last.ids).append(m[4])
        else:
            value = m[7]
            last.attrs.append((m[6].lower(), value[1:-1] if value and value[0] in "\"'" else value))
        empty = False
    return None if empty else steps


def leads(steps: list[Compound], node: Node, above: dict[int, Node | None]) -> bool:
    """Does an element that fits the last step stand where the steps before it say? The elements that may stand for a
    step are kept as a set, so that the time is in proportion to steps and depth."""
    ends = [node]
    for i in range(len(steps) - 1, 0, -1):
        before, found, seen = steps[i - 1], [], set()
        for x in ends:
            up = above[id(x)]
            while up is not None and id(up) not in seen:
                if not steps[i].child:
                    seen.add(id(up))
                if before.fits(up):
                    found.append(up)
                if steps[i].child:
                    break
                up = above[id(up)]
        ends = found
        if not ends:
            return False
    return True


def names_of(node: Node) -> list[str]:
    """What selectors can call an element by: its tag, .classes and #id."""
    a = node.attrs
    out = [node.tag, *(f".{c}" for c in a["class"].split())] if "class" in a else [node.tag]
    return [*out, f"#{a['id']}"] if "id" in a else out


Rules = dict[str, tuple[list[Compound], dict[str, tuple[bool, int, bool]]]]


def sheet(root: Node) -> Rules:
    """By selector: its compounds, and what the page's style sheets say of visibility on every screen, by display and
    visibility: importance, place and whether it shows, of the declaration that counts."""
    todo, rules = [root], 0
    found: Rules = {}
    while todo:
        x = todo.pop()
        if x.tag != "style":
            todo += reversed([c for c in x.children if isinstance(c, Node)])
        elif _on_screens(x.attrs.get("media", "")):
            for names, body in style_rules("".join(c for c in x.children if isinstance(c, str))):
                rules += 1
                if said := declared(body):
                    for name in map(str.strip, names.split(",")):
                        if name in found or (steps := selector(name)):
                            own = found.setdefault(name, (found[name][0] if name in found else steps, {}))[1]
                            for k, (important, shown) in said.items():
                                own[k] = max(own.get(k, (False, 0, True)), (important, rules, shown))
    return found


def hidden_selectors(node: Node, out: set[str]) -> set[str]:
    """Simple selectors whose rules hide on every screen."""
    out |= {name for name, (_, said) in sheet(node).items() if SIMPLE.match(name) and not all(v[2] for v in said.values())}
    return out


class Styles:
    """The page's rules by something that the elements they are about have. Rules about elements within others are
    looked at only where all the names they ask for are around, so a page takes time in proportion to its
    elements and the rules that name them."""

    def __init__(self, root: Node):
        self.rules: dict[str, list[tuple]] = {}
        self.nested = False
        for steps, said in sheet(root).values():
            weight = (sum(len(s.ids) for s in steps), sum(len(s.classes) + len(s.attrs) for s in steps), sum(s.tag is not None for s in steps))
            needs = frozenset(n for s in steps[:-1] for n in ([s.tag] if s.tag else []) + [f".{c}" for c in s.classes] + [f"#{i}" for i in s.ids])
            self.nested |= len(steps) > 1
            self.rules.setdefault(steps[-1].key(), []).append((steps, needs, weight, said))
        self.above: dict[int, Node | None] = {id(root): None}

    def within(self, node: Node, around: frozenset[str]) -> frozenset[str]:
        """The names around the children of an element."""
        own = names_of(node) if self.nested else ()
        return around if all(n in around for n in own) else around.union(own)

    def of(self, node: Node, parent: Node, around: frozenset[str]) -> dict[str, bool]:
        """What styles say of an element: by importance, then those of its own attribute before rules, then by what the
        selector names (ids, classes and attributes, tags), then the last."""
        best: dict[str, tuple] = {}
        if self.rules:
            if self.nested:
                self.above[id(node)] = parent
            for key in {"*", *names_of(node)}:
                for steps, needs, weight, said in self.rules.get(key, ()):
                    if needs <= around and steps[-1].fits(node) and (len(steps) == 1 or leads(steps, node, self.above)):
                        for k, (important, place, shown) in said.items():
                            best[k] = max(best.get(k, ()), (important, False, weight, place, shown))
        if "style" in node.attrs:
            for k, (important, shown) in declared(node.attrs["style"]).items():
                best[k] = max(best.get(k, ()), (important, True, (), 0, shown))
        return {k: v[-1] for k, v in best.items()}


def prune(root: Node) -> None:
    """Take out what is not shown. An element without visibility loses its text but keeps elements that are made visible.
    A hidden attribute, and a dialog that is not open, give way to a style that says how to display the element."""
    styles = Styles(root)
    order: list[tuple[Node, Node | None, bool]] = []
    todo: list[tuple[Node, Node | None, bool, frozenset[str]]] = [(root, None, True, frozenset())]
    while todo:
        node, parent, shown, around = todo.pop()
        around = styles.within(node, around)
        order.append((node, parent, shown))
        kept = []
        for c in node.children:
            if isinstance(c, str):
                if shown:
                    kept.append(c)
                continue
            a, said = c.attrs, styles.of(c, node, around) if styles.rules or "style" in c.attrs else {}
            if c.tag in UNSEEN or UNDRAWN_MARK in a or (c.tag == "input" and a.get("type", "").lower() == "hidden"):
                continue
            if not said.get("display", "hidden" not in a and (c.tag != "dialog" or "open" in a)):
                continue
            kept.append(c)
            todo.append((c, node, said.get("visibility", shown), around))
        node.children = kept
    for node, parent, shown in reversed(order):
        if parent is not None and not shown:
            node.attrs["unshown"] = ""
            node.children = [c for c in node.children if isinstance(c, str) or "unshown" not in c.attrs or c.children]


def visible(node: Node) -> bool:
    return "unshown" not in node.attrs or bool(node.children)


class Layout:
    """Lines of a block: text is collapsed into the open line; blocks break it and ask for blank lines around."""

    def __init__(self):
        self.lines: list[str] = []
        self.open: list[str] = []
        self.gap = False
        self.ended = True  # no text yet on the line, or text that ends in a blank

    def text(self, s: str) -> None:
        s = BLANKS.sub(" ", s)
        if self.ended and s.startswith(" "):
            s = s[1:]
        if s:
            self.open.append(s)
            self.ended = s.endswith(" ")

    def put(self, lines: list[str]) -> None:
        """Finished lines."""
        if lines:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines += lines

    def end_line(self, forced: bool = False) -> None:
        line = "".join(self.open).rstrip(" ")
        self.open, self.ended = [], True
        if line or forced:
            self.put([line])

    def space(self) -> None:
        self.end_line()
        self.gap = True


def _lines(node: Node) -> list[str]:
    out = Layout()
    _flow(node, out)
    out.end_line()
    return out.lines


def _flow(node: Node, out: Layout) -> None:
    for child in node.children:
        if isinstance(child, str):
            out.text(child)
            continue
        tag = child.tag
        if not visible(child):
            continue
        if tag == "br":
            out.end_line(True)
        elif tag == "hr":
            out.end_line()
            out.put(["---"])
        elif tag == "input":
            if child.attrs.get("type", "").lower() in ("submit", "button", "reset"):
                out.text(child.attrs.get("value", ""))
        elif tag == "text":  # a label of a drawing, placed by itself
            out.text(" ")
            _flow(child, out)
            out.text(" ")
        elif tag not in BLOCKS:
            _flow(child, out)
        else:
            edge = out.space if tag in SPACED else out.end_line
            edge()
            if tag in ("ul", "ol", "menu", "dir"):
                out.put(_list(child))
            elif tag == "table":
                out.put(_table(child))
            elif tag == "pre":
                out.put(_raw(child).strip("\n").split("\n"))
            elif tag in ("blockquote", "dd"):
                out.put([f"  {x}" if x else x for x in _lines(child)])
            elif tag == "details" and "open" not in child.attrs:
                for x in child.children:
                    if isinstance(x, Node) and x.tag == "summary":
                        out.put(_lines(x))
            else:
                _flow(child, out)
            edge()


def _raw(node: Node) -> str:
    return "".join(c if isinstance(c, str) else "\n" if c.tag == "br" else _raw(c) if visible(c) else "" for c in node.children)


def _list(node: Node) -> list[str]:
    lines, start = [], node.attrs.get("start", "")
    number = int(start) if start.lstrip("-").isdigit() and len(start) < 10 else 1
    loose = Node("li", {})
    for child in [*node.children, None]:
        if isinstance(child, Node) and child.tag == "li" or child is None:
            if own := _lines(loose):
                lines += [f"  {x}" if x else x for x in own]
            loose = Node("li", {})
            if child is not None and visible(child):
                mark = f"{number}. " if node.tag == "ol" else "- "
                own = [x for x in _lines(child) if x] or [""]
                lines += [mark + own[0], *(" " * len(mark) + x for x in own[1:])]
                number += 1
        else:
            loose.children.append(child)
    return lines


#: Stands where a group of rows begins or ends; no cell spans beyond it.
GROUP_END = Node("", {})


def _table(node: Node) -> list[str]:
    """Caption, then a line per row (or more, if a cell has several), cells padded to their column's width. A rowspan of 0
    reaches to the end of its group of rows."""
    lines: list[str] = []
    rows: list[list[list[str]]] = []
    taken: dict[int, int] = {}  # columns that cells from above still cover, and for how many rows
    count = lambda v, most: min(int(v), most) if v.isdigit() and len(v) < 9 else 1
    todo = list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                lines.append(BLANKS.sub(" ", x).strip())
        elif x is GROUP_END:
            taken = {}
        elif not visible(x):
            continue
        elif x.tag in ("tbody", "thead", "tfoot"):
            todo += [GROUP_END, *reversed(x.children), GROUP_END]
        elif x.tag == "tr":
            row: list[list[str]] = []
            begun: dict[int, int] = {}
            for cell in x.children:
                if isinstance(cell, str):
                    if cell.strip():
                        lines.append(BLANKS.sub(" ", cell).strip())
                elif visible(cell):
                    while taken.get(len(row), 0) > 0:
                        row.append([])
                    wide, high = count(cell.attrs.get("colspan", ""), 100), count(cell.attrs.get("rowspan", ""), 65534)
                    high = high or 65534
                    begun |= {len(row) + i: high - 1 for i in range(max(1, wide))}
                    row += [[y for y in _lines(cell) if y], *([[]] * (wide - 1))]
            taken = {k: v for k, v in ({k: v - 1 for k, v in taken.items()} | begun).items() if v > 0}
            if any(row):
                rows.append(row)
        else:
            lines += _lines(x)
    widths: list[int] = []
    for row in rows:
        for i, cell in enumerate(row):
            if i == len(widths):
                widths.append(0)
            widths[i] = max([widths[i], *(min(COLUMN, len(y)) for y in cell)])
    for row in rows:
        for k in range(max(1, *(len(c) for c in row))):
            lines.append(" | ".join((c[k] if k < len(c) else "").ljust(widths[i]) for i, c in enumerate(row)).rstrip())
    return lines


def render(source: str | None) -> str:
    """All visible text of a page, block by block."""
    if not source:
        return ""
    root = parse(source)
    prune(root)
    lines = _lines(root)
    return "\n".join(lines).replace("\xa0", " ").strip("\n")


def extract_text(pages: DataFrame) -> DataFrame:
    """Visible text of ``pages`` (page_id, html, ...) laid out as a reader sees it.

    A tree builder supplies implied tags; scripts, styles, heads and elements that attributes or style rules
    hide on every screen, by the cascade of those, are left out (rules for print, or for screens of some sizes only, hide
    nothing, nor do selectors of siblings and pseudo-classes); text in
    drawings and formulas is read; blocks stand on lines of their own, paragraphs apart by blank lines, list items behind marks,
    and table cells in aligned columns. Pages are independent rows: one pass, no shuffle.

    Returns one row per input row: page_id, text, n_chars, n_lines. Null and empty html give an empty text; tags that
    never end are text, very long pages and deep nesting (over 512 levels become siblings) are read whole; repeated rows are
    rendered each; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 10 * DEPTH))
        for pdf in batches:
            texts = [render(h) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "text": texts, "n_chars": [len(t) for t in texts], "n_lines": [t.count("\n") + 1 if t else 0 for t in texts]})

    return pages.select("page_id", F.col("html")).mapInPandas(run, "page_id long, text string, n_chars long, n_lines long")
