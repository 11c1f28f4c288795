"""HTML character-reference decoding as a JVM column expression.

Semantics follow the HTML5 rules used by Python's ``html.unescape`` (which the
audited tool's HTML parser applies to text and attribute values): named
references with ``;``, the legacy names that may omit it (longest prefix wins),
decimal/hex references with the cp1252 replacements for 0x80-0x9F, U+FFFD for
NUL, surrogates and out-of-range values, and removal of other invalid code
points. The entity tables are generated from Python's standard library, so no
table is written out here.
"""

from __future__ import annotations

import html
import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

_HTML5 = html.entities.html5
_LEGACY = sorted((k for k in _HTML5 if not k.endswith(";")), key=lambda k: (-len(k), k))

# Numeric references the HTML5 spec maps to other characters (0x00, 0x0D, 0x80-0x9F).
_CHARREF_FIX = {0: "\ufffd", 13: "\r"}
for _n in range(0x80, 0xA0):
    try:
        _CHARREF_FIX[_n] = bytes([_n]).decode("cp1252")
    except UnicodeDecodeError:
        _CHARREF_FIX[_n] = chr(_n)
# Code points a numeric reference drops entirely.
_DROPPED = (set(range(1, 9)) | set(range(0xE, 0x20)) | set(range(0x7F, 0xA0)) | set(range(0xFDD0, 0xFDF0))
            | {0xB} | {p * 0x10000 + 0xFFFE for p in range(17)} | {p * 0x10000 + 0xFFFF for p in range(17)})

CHARREF_RE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
LEGACY_RE = "^(" + "|".join(_LEGACY) + ")"


_PAIR, _KV = "\u0002", "\u0003"


def _map_lit(d: dict) -> Column:
    """A string->string map as ONE literal (``str_to_map`` over a constant).

    Catalyst folds it once; a ``create_map`` with thousands of literal
    children would cost seconds of analysis per use.
    """
    text = _PAIR.join(f"{k}{_KV}{v}" for k, v in d.items())
    return F.str_to_map(F.lit(text), F.lit(_PAIR), F.lit(_KV))


# Named references grouped by first character: each lookup scans ~45 keys
# instead of all 2,231 (map lookups on literals are linear in Spark).
_BY_FIRST: dict[str, dict[str, str]] = {}
for _k, _v in _HTML5.items():
    _BY_FIRST.setdefault(_k[0], {})[_k] = _v



_CACHE: dict[str, Column] = {}


def _lit_map(key: str, build) -> Column:
    """Literal map columns are built once per process and reused in every plan."""
    if key not in _CACHE:
        _CACHE[key] = build()
    return _CACHE[key]


def _named_lookup(name: Column) -> Column:
    outer = _lit_map("named", lambda: F.create_map(
        *[x for ch, d in sorted(_BY_FIRST.items()) for x in (F.lit(ch), _map_lit(d))]))
    return F.element_at(F.element_at(outer, F.substring(name, 1, 1)), name)


def _legacy_lookup(name: Column) -> Column:
    return F.element_at(_lit_map("legacy", lambda: _map_lit({k: _HTML5[k] for k in _LEGACY})), name)


def _code_point_char(cp: Column) -> Column:
    key = cp.cast("string")
    dropped = F.element_at(_lit_map("dropped", lambda: _map_lit({str(k): "" for k in _DROPPED})), key)
    fix = F.element_at(_lit_map("fix", lambda: _map_lit({str(k): v for k, v in _CHARREF_FIX.items()})), key)
    as_char = F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")
    return (F.when(fix.isNotNull(), fix)
            .when(cp.between(0xD800, 0xDFFF) | (cp > 0x10FFFF), F.lit("\ufffd"))
            .when(dropped.isNotNull(), F.lit(""))
            .otherwise(as_char))


def _decode_piece(p: Column) -> Column:
    """``p`` is the text after one '&'; return its decoded form."""
    cand = F.regexp_extract(p, CHARREF_RE, 1)
    rest = F.substr(p, F.length(cand) + 1)
    is_num = cand.startswith("#")
    is_hex = F.lower(F.substring(cand, 2, 1)) == "x"
    digits = F.regexp_extract(cand, r"^#[xX]?0*([0-9a-fA-F]*)", 1)
    cp = (F.when(digits == "", F.lit(0))
          .when(is_hex, F.when(F.length(digits) > 6, F.lit(0x110000))
                .otherwise(F.conv(digits, 16, 10).cast("int")))
          .when(F.length(digits) > 7, F.lit(0x110000))
          .otherwise(digits.cast("int")))
    exact = _named_lookup(cand)
    legacy = F.regexp_extract(cand, LEGACY_RE, 1)
    named = (F.when(exact.isNotNull(), F.concat(exact, rest))
             .when(legacy != "", F.concat(_legacy_lookup(legacy), F.substr(p, F.length(legacy) + 1)))
             .otherwise(F.concat(F.lit("&"), p)))
    return (F.when(cand == "", F.concat(F.lit("&"), p))
            .when(is_num, F.concat(_code_point_char(cp), rest))
            .otherwise(named))


def unescape(c) -> Column:
    """Decode HTML character references (no-op, no split, for strings without '&')."""
    c = col(c)
    pieces = F.split(c, "&", -1)
    decoded = F.array_join(
        F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(_decode_piece(p))), "")
    return F.when(F.instr(c, "&") == 0, c).otherwise(decoded)


# ---------------------------------------------------------------------------
# SQL-text form (used by the HTML feature expressions)
# ---------------------------------------------------------------------------
from . import sqlgen as S  # noqa: E402


def _map_sql(d: dict) -> str:
    text = _PAIR.join(f"{k}{_KV}{v}" for k, v in d.items())
    return f"str_to_map({S.q(text)}, {S.q(_PAIR)}, {S.q(_KV)})"


def entity_maps_sql() -> str:
    """One struct literal with all decoding tables; bind it once per row."""
    outer = "map(" + ", ".join(f"{S.q(ch)}, {_map_sql(d)}" for ch, d in sorted(_BY_FIRST.items())) + ")"
    legacy = _map_sql({k: _HTML5[k] for k in _LEGACY})
    fix = _map_sql({str(k): v for k, v in _CHARREF_FIX.items()})
    drop = _map_sql({str(k): "" for k in _DROPPED})
    return f"named_struct('named', {outer}, 'legacy', {legacy}, 'fix', {fix}, 'drop', {drop})"


def with_entity_maps(fn) -> str:
    """``fn(m)`` gets the name of a variable holding the decoding tables."""
    return S.bind(entity_maps_sql(), fn)


def _cp_char_sql(n: str, m: str) -> str:
    key = f"cast({n} as string)"
    return (f"CASE WHEN element_at({m}.fix, {key}) IS NOT NULL THEN element_at({m}.fix, {key}) "
            f"WHEN {n} BETWEEN 55296 AND 57343 OR {n} > 1114111 THEN {S.q(chr(0xFFFD))} "
            f"WHEN element_at({m}.drop, {key}) IS NOT NULL THEN '' "
            f"ELSE decode(unhex(lpad(hex({n}), 8, '0')), 'UTF-32') END")


def _piece_sql(p: str, m: str) -> str:
    def on_cand(c):
        def cp_of(d):
            return (f"CASE WHEN {d} = '' THEN 0 WHEN lower(substr({c}, 2, 1)) = 'x' THEN "
                    f"(CASE WHEN length({d}) > 6 THEN 1114112 ELSE cast(conv({d}, 16, 10) as int) END) "
                    f"WHEN length({d}) > 7 THEN 1114112 ELSE cast({d} as int) END")
        digits = f"regexp_extract({c}, {S.q('^#[xX]?0*([0-9a-fA-F]*)')}, 1)"
        numeric = S.bind(S.bind(digits, cp_of), lambda n: _cp_char_sql(n, m))

        def on_exact(e):
            def on_legacy(lg):
                return (f"CASE WHEN {lg} <> '' THEN concat(element_at({m}.legacy, {lg}), "
                        f"substr({p}, length({lg}) + 1)) ELSE concat('&', {p}) END")
            legacy = S.bind(f"regexp_extract({c}, {S.q(LEGACY_RE)}, 1)", on_legacy)
            return f"CASE WHEN {e} IS NOT NULL THEN concat({e}, substr({p}, length({c}) + 1)) ELSE {legacy} END"

        named = S.bind(f"element_at(element_at({m}.named, substr({c}, 1, 1)), {c})", on_exact)
        return (f"CASE WHEN {c} = '' THEN concat('&', {p}) "
                f"WHEN startswith({c}, '#') THEN concat({numeric}, substr({p}, length({c}) + 1)) "
                f"ELSE {named} END")

    return S.bind(f"regexp_extract({p}, {S.q(CHARREF_RE)}, 1)", on_cand)


def unescape_sql(x: str, m: str) -> str:
    """SQL text decoding character references in ``x`` (a cheap expression/variable)."""
    body = S.lam(lambda p, i: f"CASE WHEN {i} = 0 THEN {p} ELSE {_piece_sql(p, m)} END", 2, "p")
    return (f"CASE WHEN instr({x}, '&') = 0 THEN {x} "
            f"ELSE array_join(transform(split({x}, '&', -1), {body}), '') END")
