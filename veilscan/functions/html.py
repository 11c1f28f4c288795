"""Page-feature expressions over raw HTML.

Every feature is a row-local JVM expression (regular expressions plus
higher-order functions): no Python worker, no shuffle. The semantics follow
the tolerant HTML tokenizer the audited tool parses with:

* comments, ``<!...>`` declarations, ``<?...>`` and the raw-text elements
  ``script``/``style`` are one token each (their content is never markup);
* ``head`` (and all it holds) and ``meta`` are dropped before text features,
  while title, description meta and pop-up detection read the full page;
* a start tag may hold ``>`` inside quoted attribute values;
* text is every run between tags, with character references decoded.

The ``*_sql`` functions return Spark SQL text over SQL operands (column names
or lambda variables) plus ``m``, the variable holding the entity tables
(see ``entities.with_entity_maps``). The Column wrappers at the end build one
``F.expr`` per call.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sqlgen as S
from .entities import unescape_sql, with_entity_maps
from .text import PY_WHITESPACE

SEP = "\u0001"  # stands in for every removed tag; splits text nodes
# quote-aware rest of a start tag; possessive, so that a long run takes no regex stack
_ATTRS = r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+"""
_NAME_END = r"(?=[\s/>])"  # a tag name ends here: <head-line> is no <head>
START_TAG_RE = r"<[a-zA-Z]" + _ATTRS + ">"
END_TAG_RE = r"</[a-zA-Z][^>]*>"
TAG_RE = START_TAG_RE + "|" + END_TAG_RE
# comments, raw-text elements, declarations and processing instructions
DROP_RE = (r"(?is)<!--.*?(?:-->|$)|<(script|style)" + _NAME_END + _ATTRS + r">.*?(?:</\1\s*>|$)"
           r"|<![^>]*>|<\?[^>]*>")
HEAD_RE = r"(?is)<head" + _NAME_END + _ATTRS + r">.*?(?:</head\s*>|$)"
# text runs never contain the separator left by removed blocks (it splits nodes)
TOKEN_RE = r"(?s)" + START_TAG_RE + "|" + END_TAG_RE + "|(?:[^<\u0001]++|<(?![a-zA-Z/]))++|<"
ATTR_RE = r"""([^\s/>"'=][^\s/>"'=]*)(?:\s*=+\s*("[^"]*"|'[^']*'|[^\s>"'][^\s>]*))?"""
UNQUOTE_RE = r"""(?s)^"(.*)"$|^'(.*)'$"""
TAG_NAME_RE = r"^</?([a-zA-Z][^\s/>]*)"
TITLE_RE = r"(?is)<title" + _NAME_END + _ATTRS + r">(.*?)(?:</title\s*>|$)"
# an unclosed button ends with its form or the page
BUTTON_RE = r"(?is)<button" + _NAME_END + _ATTRS + r">(.*?)(?:</button\s*>|</form\s*>|</body\s*>|$)"
FORM_RE = r"(?is)<form" + _NAME_END + _ATTRS + r">.*?(?:</form\s*>|$)"
FORM_HEAD_RE = r"(?is)^<form" + _NAME_END + _ATTRS + ">"
# fixed value: what counts as a price
PRICE_RE = r"(?U)[$€£₺]\s?\d+[.,]?\d*|\d+[.,]\d+\s?(?:USD|EUR|GBP|TRY)"
# optional: whole amounts with thousands separators ("$1,299.99" instead of "$1,299")
PRICE_FULL_RE = r"(?U)[$€£₺]\s?\d+(?:[.,]\d+)*|\d+(?:[.,]\d+)+\s?(?:USD|EUR|GBP|TRY)"
FONT_SIZE_RE = r"font-size:\s*(\d+)px"
STYLE_HINT_RE = r"(?i)style\s*="
SMALL_HINT_RE = r"(?i)<(small|sup|sub)(?=[\s/>])|style\s*="
POPUP_WORDS_RE = "modal|overlay|popup"
# Elements that never have content (tree builder's empty-element list).
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link",
             "menuitem", "meta", "param", "source", "track", "wbr", "basefont", "bgsound",
             "command", "frame", "image", "isindex", "nextid", "spacer"]
EMPTY_STR_ARRAY = "cast(array() as array<string>)"
FIELD_TYPE = "struct<name:string,field_type:string,preselected:boolean>"
FORMS_TYPE = ("array<struct<action:string,method:string,fields:array<" + FIELD_TYPE
              + ">,has_preselected:boolean>>")


def _nonempty(s: str) -> str:
    return f"{s} <> ''"


# ---------------------------------------------------------------------------
# SQL builders
# ---------------------------------------------------------------------------
def strip_sql(x: str) -> str:
    """Python ``str.strip()`` (all Unicode whitespace) as a plain trim."""
    return f"btrim({x}, {S.q(PY_WHITESPACE)})"


def clean_sql(h: str) -> str:
    dropped = f"regexp_replace({h}, {S.q(DROP_RE)}, {S.q(SEP)})"
    return f"regexp_replace({dropped}, {S.q(HEAD_RE)}, {S.q(SEP)})"


def text_nodes_sql(fragment: str, m: str) -> str:
    """Decoded text nodes in order (blank ones kept, empty ones dropped).

    Decoding the separator-joined text once equals decoding each node: no
    reference name contains the separator.
    """
    joined = f"regexp_replace({fragment}, {S.q(TAG_RE)}, {S.q(SEP)})"
    decoded = S.bind(joined, lambda j: unescape_sql(j, m))
    return f"filter(split({decoded}, {S.q(SEP)}, -1), {S.lam(_nonempty)})"


def stripped_sql(nodes: str) -> str:
    return f"filter(transform({nodes}, {S.lam(strip_sql)}), {S.lam(_nonempty)})"


def inner_text_sql(fragment: str, m: str) -> str:
    """``get_text(strip=True)``: stripped text nodes concatenated."""
    return f"array_join({stripped_sql(text_nodes_sql(fragment, m))}, '')"


def visible_text_sql(h: str, m: str, limit: int | None) -> str:
    text = f"array_join({stripped_sql(text_nodes_sql(clean_sql(h), m))}, ' ')"
    return f"substr({text}, 1, {limit})" if limit else text


def title_sql(h: str, m: str) -> str:
    inner = f"regexp_extract({h}, {S.q(TITLE_RE)}, 1)"
    return strip_sql(f"array_join({text_nodes_sql(inner, m)}, '')")


def start_tags_sql(h: str, name: str | None = None) -> str:
    pat = START_TAG_RE if name is None else r"(?i)<" + name + _NAME_END + _ATTRS + ">"
    return f"regexp_extract_all({h}, {S.q(pat)}, 0)"


def tag_name_sql(t: str) -> str:
    return f"lower(regexp_extract({t}, {S.q(TAG_NAME_RE)}, 1))"


def with_attrs_sql(tag: str, m: str, fn) -> str:
    """Parse a start tag's attributes once; ``fn(get, has)`` builds the result.

    ``get(name)`` is the decoded value (``''`` for a bare attribute, NULL when
    absent); ``has(name)`` its presence. Attribute names are case-insensitive.
    """
    body = f"regexp_replace({tag}, {S.q(r'^<[a-zA-Z][^\s/>]*')}, '')"
    names = f"transform(regexp_extract_all({body}, {S.q(ATTR_RE)}, 1), {S.lam(lambda n: f'lower({n})')})"
    vals = f"regexp_extract_all({body}, {S.q(ATTR_RE)}, 2)"

    def inner(a):
        def pos(name):
            return f"array_position({a}.n, {S.q(name.lower())})"

        def get(name):
            raw = f"element_at({a}.v, cast({pos(name)} as int))"
            unq = f"regexp_replace({raw}, {S.q(UNQUOTE_RE)}, '$1$2')"
            return f"(CASE WHEN {pos(name)} > 0 THEN {S.bind(unq, lambda u: unescape_sql(u, m))} END)"

        def has(name):
            return f"({pos(name)} > 0)"

        return fn(get, has)

    return S.bind(f"named_struct('n', {names}, 'v', {vals})", inner)


def meta_description_sql(h: str, m: str, limit: int | None = None) -> str:
    is_desc = S.lam(lambda t: with_attrs_sql(t, m, lambda g, has: f"({g('name')} <=> 'description')"))
    metas = f"filter({start_tags_sql(h, 'meta')}, {is_desc})"

    def on_metas(ms):
        content = with_attrs_sql(f"element_at({ms}, 1)", m, lambda g, has: f"coalesce({g('content')}, '')")
        cut = f"substr({content}, 1, {limit})" if limit else content
        return f"CASE WHEN size({ms}) > 0 THEN {cut} ELSE '' END"

    return S.bind(metas, on_metas)


def links_sql(cleaned: str, m: str, limit: int | None = None) -> str:
    has_href = S.lam(lambda t: f"({t} rlike '(?i)href' AND " + with_attrs_sql(t, m, lambda g, has: has("href")) + ")")
    href = S.lam(lambda t: with_attrs_sql(t, m, lambda g, has: g("href")))
    hrefs = f"transform(filter({start_tags_sql(cleaned, 'a')}, {has_href}), {href})"
    return f"slice({hrefs}, 1, {limit})" if limit else hrefs


def buttons_sql(cleaned: str, m: str, limit: int | None = None) -> str:
    texts = (f"filter(transform(regexp_extract_all({cleaned}, {S.q(BUTTON_RE)}, 1), "
             f"{S.lam(lambda x: inner_text_sql(x, m))}), {S.lam(_nonempty)})")
    return f"slice({texts}, 1, {limit})" if limit else texts


def forms_sql(cleaned: str, m: str) -> str:
    def one(block):
        head = f"regexp_extract({block}, {S.q(FORM_HEAD_RE)}, 0)"
        field = S.lam(lambda t: with_attrs_sql(t, m, lambda g, has: (
            f"named_struct('name', coalesce({g('name')}, ''), 'field_type', coalesce({g('type')}, 'text'), "
            f"'preselected', {has('checked')})")))
        fields = f"transform({start_tags_sql(block, 'input')}, {field})"

        def build(fs):
            return with_attrs_sql(head, m, lambda g, has: (
                f"named_struct('action', coalesce({g('action')}, ''), 'method', coalesce({g('method')}, 'get'), "
                f"'fields', {fs}, 'has_preselected', exists({fs}, {S.lam(lambda f: f'{f}.preselected')}))"))

        return S.bind(fields, build)

    return f"transform(regexp_extract_all({cleaned}, {S.q(FORM_RE)}, 0), {S.lam(one)})"


def preselected_sql(forms: str) -> str:
    def per_form(f):
        keep = S.lam(lambda x: f"{x}.preselected")
        shape = S.lam(lambda x: f"named_struct('name', {x}.name, 'type', {x}.field_type)")
        return f"transform(filter({f}.fields, {keep}), {shape})"
    return f"flatten(transform({forms}, {S.lam(per_form)}))"


def hidden_inputs_sql(forms: str) -> str:
    def per_form(f):
        keep = S.lam(lambda x: f"{x}.field_type = 'hidden'")
        shape = S.lam(lambda x: f"named_struct('name', {x}.name)")
        return f"transform(filter({f}.fields, {keep}), {shape})"
    return f"flatten(transform({forms}, {S.lam(per_form)}))"


def prices_sql(text: str, limit: int | None = None, full_amount: bool = False) -> str:
    pat = PRICE_FULL_RE if full_amount else PRICE_RE
    found = f"array_distinct(regexp_extract_all({text}, {S.q(pat)}, 0))"
    return f"slice({found}, 1, {limit})" if limit else found


def popup_sql(h: str, m: str) -> str:
    def hit(t):
        return with_attrs_sql(t, m, lambda g, has: (
            f"(coalesce({g('class')} rlike {S.q(POPUP_WORDS_RE)}, false) "
            f"OR coalesce(instr({g('id')}, 'modal') > 0, false))"))

    cands = f"filter({start_tags_sql(h)}, {S.lam(lambda t: f'{t} rlike {S.q(POPUP_WORDS_RE)}')})"
    return f"CASE WHEN {h} rlike {S.q(POPUP_WORDS_RE)} THEN exists({cands}, {S.lam(hit)}) ELSE false END"


def tokens_sql(cleaned: str) -> str:
    return f"regexp_extract_all({cleaned}, {S.q(TOKEN_RE)}, 0)"


def _element_ends_sql(toks: str, predicate) -> str:
    """(i, j) of each start tag satisfying ``predicate(tag, name)``, in order: its token and the one that ends it.

    One pass over the page's tags keeps the stack of open elements. An end tag
    closes the nearest open element of its name together with whatever is open
    inside; without a partner it changes nothing; what is never closed ends with
    the page (j is one more than the number of tokens). Void and self-closed
    elements are never open (j = i).
    """
    void_list = ", ".join(S.q(v) for v in VOID_TAGS)

    def tag_of(t, i):
        def with_name(name):
            end = f"startswith({t}, '</')"
            return (f"named_struct('i', {i} + 1, 'n', {name}, 'e', {end}, 'v', {name} IN ({void_list}) OR endswith({t}, '/>'), "
                    f"'c', NOT {end} AND coalesce({predicate(t, name)}, false))")
        return f"CASE WHEN {t} rlike {S.q('^</?[a-zA-Z]')} THEN {S.bind(tag_name_sql(t), with_name)} END"

    tags = f"filter(transform({toks}, {S.lam(tag_of, 2)}), {S.lam(lambda x: f'{x} IS NOT NULL')})"
    ends_type = "array<struct<i:int,j:int>>"
    nothing = f"named_struct('s', cast(array() as array<struct<i:int,n:string,c:boolean>>), 'o', cast(array() as {ends_type}))"

    def ended(closed, at):
        shape = S.lam(lambda x: f"named_struct('i', {x}.i, 'j', {at})")
        return f"transform(filter({closed}, {S.lam(lambda x: f'{x}.c')}), {shape})"

    def step(acc, x):
        pushed = f"concat({acc}.s, array(named_struct('i', {x}.i, 'n', {x}.n, 'c', {x}.c)))"
        names = f"reverse(transform({acc}.s, {S.lam(lambda e: f'{e}.n')}))"

        def close(k):  # k: how many elements the end tag closes
            left = f"size({acc}.s) - {k}"
            return (f"CASE WHEN {k} = 0 THEN {acc} ELSE named_struct('s', slice({acc}.s, 1, cast({left} AS int)), "
                    f"'o', concat({acc}.o, {ended(f'slice({acc}.s, cast({left} + 1 AS int), cast({k} AS int))', f'{x}.i')})) END")

        return (f"CASE WHEN {x}.e THEN {S.bind(f'array_position({names}, {x}.n)', close)} "
                f"WHEN {x}.v THEN CASE WHEN {x}.c THEN named_struct('s', {acc}.s, 'o', concat({acc}.o, "
                f"array(named_struct('i', {x}.i, 'j', {x}.i)))) ELSE {acc} END "
                f"ELSE named_struct('s', {pushed}, 'o', {acc}.o) END")

    def finish(acc):
        return f"array_sort(concat({acc}.o, {ended(f'{acc}.s', f'size({toks}) + 1')}))"

    return f"aggregate({tags}, {nothing}, {S.lam(step, 2, 'a')}, {S.lam(finish)})"


def element_texts_sql(toks: str, m: str, predicate) -> str:
    """Subtree text of each start tag satisfying ``predicate(tag, name)``, in order.

    Text is ``get_text(strip=True)``; void and self-closed elements give ``''``.
    """
    is_text = S.lam(lambda t: f"NOT ({t} rlike " + S.q(r"^</?[a-zA-Z]") + ")")
    piece = S.lam(lambda t: strip_sql(S.bind(t, lambda u: unescape_sql(u, m))))

    def text_of(x):
        inner = f"slice({toks}, {x}.i + 1, greatest({x}.j - {x}.i - 1, 0))"
        return f"array_join(transform(filter({inner}, {is_text}), {piece}), '')"

    return f"transform({_element_ends_sql(toks, predicate)}, {S.lam(text_of)})"


def _style_sql(g) -> str:
    return f"lower(coalesce({g('style')}, ''))"


def _cut_texts(texts: str, chars: int | None) -> str:
    return f"transform({texts}, {S.lam(lambda s: f'substr({s}, 1, {chars})')})" if chars else texts


def sticky_sql(cleaned: str, m: str, limit: int | None = None, chars: int | None = None) -> str:
    def pred(tag, name):
        exact = with_attrs_sql(tag, m, lambda g, has: (
            f"({has('style')} AND replace({_style_sql(g)}, ' ', '') rlike 'position:fixed|position:sticky')"))
        return f"({tag} rlike {S.q(STYLE_HINT_RE)} AND {exact})"

    def run(toks):
        texts = _cut_texts(element_texts_sql(toks, m, pred), chars)
        texts = f"filter({texts}, {S.lam(_nonempty)})"
        out = f"array_distinct({texts})"
        return f"slice({out}, 1, {limit})" if limit else out

    return (f"CASE WHEN {cleaned} rlike {S.q(STYLE_HINT_RE)} THEN {S.bind(tokens_sql(cleaned), run)} "
            f"ELSE {EMPTY_STR_ARRAY} END")


def small_print_sql(cleaned: str, m: str, limit: int | None = None, chars: int | None = None) -> str:
    def tagged(tag, name):
        return f"{name} IN ('small', 'sup', 'sub')"

    def styled(tag, name):
        exact = with_attrs_sql(tag, m, lambda g, has: (
            f"({has('style')} AND coalesce(try_cast(regexp_extract({_style_sql(g)}, "
            f"{S.q(FONT_SIZE_RE)}, 1) AS bigint) <= 11, false))"))
        # cheap guard first: only tags that mention a style attribute are parsed
        return f"({tag} rlike {S.q(STYLE_HINT_RE)} AND {exact})"

    def run(toks):
        both = f"concat({element_texts_sql(toks, m, tagged)}, {element_texts_sql(toks, m, styled)})"
        kept = f"filter({both}, {S.lam(lambda s: f'length({s}) > 10')})"
        out = f"array_distinct({_cut_texts(kept, chars)})"
        return f"slice({out}, 1, {limit})" if limit else out

    return (f"CASE WHEN {cleaned} rlike {S.q(SMALL_HINT_RE)} THEN {S.bind(tokens_sql(cleaned), run)} "
            f"ELSE {EMPTY_STR_ARRAY} END")


# ---------------------------------------------------------------------------
# Column wrappers (operand = column name or SQL expression text)
# ---------------------------------------------------------------------------
def _expr(build) -> Column:
    return F.expr(with_entity_maps(build))


def clean_html(html: str = "html") -> Column:
    return F.expr(clean_sql(html))


def visible_text(html: str = "html", limit: int | None = None) -> Column:
    return _expr(lambda m: visible_text_sql(html, m, limit))


def title(html: str = "html") -> Column:
    return _expr(lambda m: title_sql(html, m))


def meta_description(html: str = "html", limit: int | None = None) -> Column:
    return _expr(lambda m: meta_description_sql(html, m, limit))


def links(html: str = "html", limit: int | None = None) -> Column:
    return _expr(lambda m: S.bind(clean_sql(html), lambda c: links_sql(c, m, limit)))


def buttons(html: str = "html", limit: int | None = None) -> Column:
    return _expr(lambda m: S.bind(clean_sql(html), lambda c: buttons_sql(c, m, limit)))


def forms(html: str = "html") -> Column:
    return _expr(lambda m: S.bind(clean_sql(html), lambda c: forms_sql(c, m)))


def prices(html: str = "html", limit: int | None = None, full_amount: bool = False) -> Column:
    return _expr(lambda m: prices_sql(f"array_join({text_nodes_sql(clean_sql(html), m)}, ' ')", limit, full_amount))


def popup_detected(html: str = "html") -> Column:
    return _expr(lambda m: popup_sql(html, m))


def sticky_elements(html: str = "html", limit: int | None = None) -> Column:
    return _expr(lambda m: S.bind(clean_sql(html), lambda c: sticky_sql(c, m, limit)))


def small_print(html: str = "html", limit: int | None = None) -> Column:
    return _expr(lambda m: S.bind(clean_sql(html), lambda c: small_print_sql(c, m, limit)))


def tokens(html: str = "html") -> Column:
    return F.expr(tokens_sql(clean_sql(html)))


def tag_name(tag: str) -> Column:
    return F.expr(tag_name_sql(tag))


def unescape_text(x: str) -> Column:
    return _expr(lambda m: unescape_sql(x, m))


def strip_text(x: str) -> Column:
    return F.expr(strip_sql(x))
