"""URL expressions. Regular expressions instead of a parser, so that malformed addresses give empty parts, not errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def host(url: Column) -> Column:
    """Host with port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def hostname(url: Column) -> Column:
    return F.regexp_replace(host(url), r":[0-9]*$", "")


def domain(url: Column) -> Column:
    """Host with port, or the whole string if there is none."""
    return F.when(host(url) == "", url).otherwise(host(url))


def path(url: Column) -> Column:
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when((found == "") & (origin(url) != ""), "/").otherwise(found)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def param_pattern(params: list[tuple[str, str]]) -> str:
    """One pattern for a rule table of (name, match); match is exact, prefix, or digits (name and digits)."""
    escaped = [(p.replace(".", r"\."), m) for p, m in params]
    return "(?i)^(" + "|".join(p + {"prefix": ".*", "digits": "[0-9]+"}.get(m, "") for p, m in escaped) + ")$"


def without_params(url: Column, params: list[tuple[str, str]]) -> Column:
    """'?' and the query parameters that no rule names, or nothing."""
    keep = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.split_part(p, F.lit("="), F.lit(1)).rlike(param_pattern(params)))
    return F.when(F.size(keep) > 0, F.concat(F.lit("?"), F.array_join(keep, "&"))).otherwise("")


def canonical(url: Column, params: list[tuple[str, str]]) -> Column:
    """Origin, path without one trailing slash, and the parameters that matter; other strings lose fragment and slash."""
    p = path(url)
    cut = F.when((F.length(p) > 1) & p.endswith("/"), F.regexp_replace(p, "/$", "")).otherwise(p)
    plain = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/$", "")
    return F.when(origin(url) == "", plain).otherwise(F.concat(origin(url), cut, without_params(url, params)))


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")
