"""Text expressions that several jobs share. All are built-in Spark functions on columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blank characters: Java's \s and those that only browsers count.
BLANK = r"[\s\x{00a0}\x{feff}\x{2028}\x{2029}\x{3000}]"


def collapse(text: Column) -> Column:
    """Runs of blanks become one blank; none at either end."""
    return F.trim(F.regexp_replace(text, BLANK + "+", " "))


def decode_entities(text: Column) -> Column:
    """The common character references of HTML as characters; the ampersand last, so nothing is decoded twice."""
    for mark, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    return text


def hits(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def chars(text: Column, kind: str) -> Column:
    """How many characters are of a class of the kind ``[...]``: what a text loses without its runs of them, which takes a
    search per run and not per character."""
    return F.coalesce(F.length(text) - F.length(F.regexp_replace(text, kind + "++", "")), F.lit(0))


def once(value: Column) -> Column:
    """The value by an outer generator, for ``select``: Spark copies no expression through one into the filters behind it, where
    it would be computed again for each mention."""
    return F.explode_outer(F.array(value))


def present(text: Column, words: Iterable[str]) -> Column:
    """How many of the words occur in a lower-cased text (presence, not count)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((low.contains(w).cast("int") for w in words), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences: cut at blanks behind . ! ? and at line ends; trimmed, none empty."""
    marked = F.regexp_replace(text, r"([.!?])\s+", "$1\n")
    # A lambda, since transform would call trim itself with the index as the characters to trim.
    return F.filter(F.transform(F.split(marked, r"\n+"), lambda s: F.trim(s)), lambda s: s != "")


def encoded_length(text: Column) -> Column:
    """Length of the percent-encoded text: three characters for each byte that is not unreserved."""
    return 3 * F.octet_length(text) - 2 * F.regexp_count(text, F.lit(r"[A-Za-z0-9\-_.!~*'()]"))
