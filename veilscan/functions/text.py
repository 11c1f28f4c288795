"""Scalar string helpers as Spark column expressions (JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's ``str.strip()`` removes (``str.isspace``), derived from the
# Unicode database at import so trimming equals Python's on every code point.
PY_WHITESPACE = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()``: trims every Unicode whitespace character.

    ``F.trim`` only removes ASCII spaces; ``btrim`` with the full set stays
    a plain JVM string function (no regex).
    """
    return F.btrim(col(c), F.lit(PY_WHITESPACE))


def left(c, n: int) -> Column:
    """First ``n`` characters (code points), like Python slicing ``s[:n]``."""
    return F.substring(col(c), 1, n)


def lower_text(c) -> Column:
    """Locale-free lower case (Java ``toLowerCase(Locale.ROOT)`` = Python ``str.lower``)."""
    return F.lower(col(c))


def bind(expr: Column, fn) -> Column:
    """Evaluate ``expr`` once and hand it to ``fn`` as a lambda variable.

    Catalyst inlines projected columns into higher-order-function lambdas
    (CollapseProject), which would re-evaluate e.g. ``lower(text)`` once per
    array element. Wrapping the value in a one-element array and transforming
    it pins a single evaluation per row.
    """
    return F.transform(F.array(expr), fn)[0]


def join_nonempty(parts, default: str, sep: str = ", ") -> Column:
    """``sep.join(non-null parts) or default``."""
    if isinstance(parts, (list, tuple)):
        joined = F.concat_ws(sep, *[col(p) for p in parts])
    else:
        joined = F.array_join(col(parts), sep)
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(default))


def regex_all(c, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))


def regex_first(c, pattern: str, group: int = 1) -> Column:
    """First match of ``group``; null when the pattern does not match."""
    c = col(c)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def cap(c, n: int) -> Column:
    """First ``n`` elements of an array column (list caps of the audit tool)."""
    return F.slice(col(c), 1, n)


def distinct_list(c) -> Column:
    """Distinct elements, first-seen order (deterministic replacement of ``list(set(x))``)."""
    return F.array_distinct(col(c))


def union_signals(a, b) -> Column:
    """Set union of two string lists: elements of ``a`` first, then new ones of ``b``."""
    return F.array_union(col(a), col(b))


def py_list_repr(arr) -> Column:
    """Python ``repr`` of a list of strings, e.g. ``['a', 'b']`` (for log lines).

    Strings without quotes or backslashes render as ``'x'``, like Python.
    """
    quoted = F.transform(col(arr), lambda s: F.concat(F.lit("'"), s, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
