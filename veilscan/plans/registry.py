"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import PY_WHITESPACE

REGISTRY: dict[str, tuple[Callable, str | Callable | None]] = {}


def query(name: str, sql=None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def L(c) -> Column:
    """Integer outputs are bigint on both sides of the comparison."""
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def J(c, sep: str = "|") -> Column:
    """Arrays compare as sorted joined strings."""
    return F.array_join(F.array_sort(F.col(c) if isinstance(c, str) else c), sep)


def sql_j(x: str, sep: str = "|") -> str:
    return f"array_to_string(list_sort({x}), '{sep}')"


SQL_WS = "'" + PY_WHITESPACE.replace("'", "''") + "'"
SEP_SQL = "chr(1)"
_ATTRS_SQL = """(?:"[^"]*"|''[^'']*''|[^''">])*"""


def sql_unescape(x: str) -> str:
    """The references present in the fixture pages (full table: unit tests)."""
    cases = [("middot;", "·"), ("middot", "·"), ("copy;", "©"), ("copy", "©"), ("quot;", '"'),
             ("quot", '"'), ("nbsp;", "\u00a0"), ("nbsp", "\u00a0"), ("amp;", "&"), ("amp", "&"),
             ("lt;", "<"), ("lt", "<"), ("gt;", ">"), ("gt", ">")]
    whens = " ".join(f"WHEN starts_with(p, '{k}') THEN '{v}' || substr(p, {len(k) + 1})" for k, v in cases)
    return (f"CASE WHEN contains({x}, '&') THEN array_to_string(list_transform(string_split({x}, '&'), "
            f"lambda p, i: CASE WHEN i = 1 THEN p {whens} ELSE '&' || p END), '') ELSE {x} END")


def sql_clean(h: str) -> str:
    drop = (f"(?is)<!--.*?(?:-->|$)|<script\\b{_ATTRS_SQL}>.*?(?:</script\\s*>|$)"
            f"|<style\\b{_ATTRS_SQL}>.*?(?:</style\\s*>|$)|<![^>]*>|<\\?[^>]*>")
    head = f"(?is)<head\\b{_ATTRS_SQL}>.*?(?:</head\\s*>|$)"
    return (f"regexp_replace(regexp_replace({h}, '{drop}', {SEP_SQL}, 'g'), '{head}', {SEP_SQL}, 'g')")


SQL_TAG = f"<[a-zA-Z]{_ATTRS_SQL}>|</[a-zA-Z][^>]*>"


def sql_text_nodes(fragment: str) -> str:
    return (f"list_filter(string_split({sql_unescape(f'regexp_replace({fragment}, {chr(39)}{SQL_TAG}{chr(39)}, {SEP_SQL}, {chr(39)}g{chr(39)})')}, "
            f"{SEP_SQL}), lambda p: p <> '')")


def sql_visible(h: str, limit: int | None = None) -> str:
    nodes = sql_text_nodes(sql_clean(h))
    text = (f"array_to_string(list_filter(list_transform({nodes}, lambda s: trim(s, {SQL_WS})), "
            f"lambda s: s <> ''), ' ')")
    return f"left({text}, {limit})" if limit else text
