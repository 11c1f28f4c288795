"""Text-signal operators: lexicon scans, model replies, merged extraction.

The lexicon is a dimension of fixed, small size. ``lexicon_scan`` inlines it
as literal arrays, so the scan is one row-local projection (lower-case text
bound once per row, one ``contains`` per phrase). ``lexicon_hits`` is the same
match as long rows; a lexicon table of any size is joined over a gram index that
holds each phrase under its rarest gram.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PY_WHITESPACE, bind, col
from ..sources import dims

#: Bytes of the grams that texts and lexicon tables are joined on (a long holds one and its size).
GRAM = 6
#: Bits of the filter of entered grams, as a power of two: 8 MB.
FILTER_BITS = 26
#: Bytes of texts whose grams are looked up at a time.
SLICE = 1 << 22
SIGNALS_TYPE = ("struct<urgency_texts:array<string>,subscription_keywords:array<string>,"
                "consent_accept:array<string>,consent_reject:array<string>,"
                "dark_pattern_hints:array<string>,language_detected:string>")


def _lexicon_rows(lexicon) -> list[tuple]:
    """Rows (category, lang, ord, pattern) of the defaults or a list."""
    if lexicon is None:
        return dims.lexicon_rows()
    if isinstance(lexicon, (list, tuple)):
        return list(lexicon)
    raise TypeError("a lexicon table is joined: use lexicon_hits or lexicon_scan")


def categories_of(rows) -> dict:
    """Category -> output column: the built-in ones, then any other under its own name."""
    return dims.CATEGORY_COLUMNS | {c: c for c in dict.fromkeys(r[0] for r in rows) if c not in dims.CATEGORY_COLUMNS}


def _phrases(rows, category: str) -> list[str]:
    return [p.lower() for c, _, _, p in sorted(rows, key=lambda r: (r[0], r[2])) if c == category]


def scan_column(text, category: str, lexicon=None) -> Column:
    """Phrases of one category contained in lower(text), in lexicon order."""
    rows = _lexicon_rows(lexicon)
    lex = F.array(*[F.lit(p) for p in _phrases(rows, category)]) if _phrases(rows, category) \
        else F.array().cast("array<string>")
    return bind(F.lower(col(text)), lambda t: F.filter(lex, lambda p: t.contains(p)))


def _match(t: Column, p, whole_word: bool) -> Column:
    """Substring match (the default, like the audited tool: "only" hits
    "commonly"), or whole words only (Unicode word boundaries)."""
    if not whole_word:
        return t.contains(p)
    return F.regexp_like(t, F.concat(F.lit("(?U)(?<!\\w)\\Q"), p, F.lit("\\E(?!\\w)")))


def rule_signals(text, lexicon=None, categories: dict | None = None, whole_word: bool = False) -> Column:
    """The rule-based extraction record for one text column (one struct).

    Every category is scanned against the same lower-cased text, bound once
    (``contains`` is a byte search; ``instr`` would count characters too).
    Hints are empty and the language ``unknown``, as for the audited tool's
    fallback.
    """
    rows = _lexicon_rows(lexicon)
    cats = categories or categories_of(rows)

    def scan(t):
        fields = []
        for cat, out in cats.items():
            ph = _phrases(rows, cat)
            lex = F.array(*[F.lit(p) for p in ph]) if ph else F.array().cast("array<string>")
            fields.append(F.filter(lex, lambda p: _match(t, p, whole_word)).alias(out))
        fields.append(F.array().cast("array<string>").alias("dark_pattern_hints"))
        fields.append(F.lit("unknown").alias("language_detected"))
        return F.struct(*fields)

    return bind(F.lower(F.coalesce(col(text), F.lit(""))), scan)


def lexicon_scan(df: DataFrame, text_col: str = "text", lexicon=None,
                 prefix: str = "", whole_word: bool = False) -> DataFrame:
    """Add a signal array per category (whole text scanned) to ``df``.

    Categories beyond the built-in ones become columns of their own name.
    """
    out = df.withColumn("_sig", rule_signals(text_col, lexicon, whole_word=whole_word))
    # one projection reads the struct four times, so Catalyst keeps the scan in
    # its own projection instead of inlining it into every field
    return out.select(*df.columns, *[F.col("_sig." + c).alias(prefix + c)
                                     for c in categories_of(_lexicon_rows(lexicon)).values()])


def gram_index(patterns: DataFrame) -> DataFrame:
    """(pattern, gram): each phrase under the one of its ``GRAM``-byte strings that fewest phrases hold.

    A shorter phrase is its own gram. A gram is a long: its bytes, above them their number.
    """
    n = F.octet_length("pattern")
    size = F.least(n, F.lit(GRAM))
    utf8 = F.encode("pattern", "utf-8")
    code = F.conv(F.hex(F.substr(utf8, F.col("at"), size)), 16, 10).cast("long").bitwiseOR(size.cast("long") * (1 << 8 * GRAM))
    held = (patterns.select("pattern", F.explode(F.sequence(F.lit(1), n - size + 1)).alias("at"))
            .select("pattern", code.alias("gram")).distinct())
    common = held.groupBy("gram").agg(F.count("*").alias("n"))
    return (held.join(common, "gram").groupBy("pattern")
            .agg(F.min(F.struct("n", "gram")).alias("best")).select("pattern", F.col("best.gram").alias("gram")))


def _places(codes: np.ndarray) -> np.ndarray:
    """Places of grams in the filter."""
    return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _entered_grams(index: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bitmap of fixed size with the entered grams' places, and their sizes. Each task sends its own bitmap's pieces."""
    piece = 1 << 12

    def pieces(batches):
        bits, sizes = np.zeros(1 << (FILTER_BITS - 3), np.uint8), 0
        for batch in batches:
            codes = batch.column(0).to_numpy()
            at = _places(codes)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
            sizes |= int(np.bitwise_or.reduce(1 << (codes >> 8 * GRAM), initial=0))
        for k in np.unique(np.flatnonzero(bits) // piece).tolist():
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int64()), "bits": [bits[k * piece:(k + 1) * piece].tobytes()], "sizes": pa.array([sizes], pa.int64())})

    bits, sizes = np.zeros(1 << (FILTER_BITS - 3), np.uint8), 0
    for r in index.select("gram").mapInArrow(pieces, "k long, bits binary, sizes long").toLocalIterator():
        bits[r.k * piece:(r.k + 1) * piece] |= np.frombuffer(r.bits, np.uint8)
        sizes |= r.sizes
    return bits, [n for n in range(1, GRAM + 1) if sizes >> n & 1]


def _slices(batch: pa.RecordBatch):
    """Runs of rows of about ``SLICE`` bytes of text: first row, UTF-8 bytes, bounds of the texts."""
    text = pa.concat_arrays([batch.column(batch.num_columns - 1)]).cast(pa.large_string())
    data, bounds = np.frombuffer(text.buffers()[2] or b"", np.uint8), np.frombuffer(text.buffers()[1], np.int64)[text.offset:][:len(text) + 1]
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + SLICE, "right")) - 1)
        yield lo, data[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo]
        lo = hi


def _grams_of(bits: np.ndarray, sizes: list[int]):
    """Rows of keys and a text to rows of keys and the distinct grams of the text that the filter lets through."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            for first, data, bounds in _slices(batch):
                for n in sizes:
                    if len(data) < n:
                        continue
                    code = np.zeros(len(data) - n + 1, np.int64)
                    for j in range(n):
                        code = code << 8 | data[j:len(code) + j]
                    code |= n << 8 * GRAM
                    place = _places(code)
                    at = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                    row = np.searchsorted(bounds, at, "right") - 1
                    inside = at + n <= bounds[row + 1]
                    found = np.unique(np.stack((row[inside], code[at[inside]]), axis=1), axis=0)
                    if len(found):
                        keys = batch.select(range(batch.num_columns - 1)).take(pa.array(found[:, 0] + first))
                        yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(found[:, 1])], names=[*keys.schema.names, "gram"])
    return run


def lexicon_hits(df: DataFrame, key: str | list, text_col: str = "text", lexicon=None) -> DataFrame:
    """Long rows (key, category, lang, ord, pattern): one per phrase found in a text.

    Default lexicon: literal array of structs filtered per row, then exploded
    (no join, no shuffle). A lexicon DataFrame of any size: the distinct grams of
    each text meet the phrases entered under them (``gram_index``); a bitmap of
    fixed size drops nearly all grams that no phrase is entered under. Only (key,
    gram) and (key, phrase) rows are exchanged until the candidates are known.
    Texts are then joined back once and searched, so the work grows with the
    text and its candidates.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if lexicon is None or isinstance(lexicon, (list, tuple)):
        rows = _lexicon_rows(lexicon)
        lex = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(lg).alias("lang"),
                                 F.lit(o).alias("ord"), F.lit(p.lower()).alias("pattern"))
                        for c, lg, o, p in rows])
        hits = bind(F.lower(F.coalesce(F.col(text_col), F.lit(""))),
                    lambda t: F.filter(lex, lambda s: t.contains(s["pattern"])))
        return df.select(*keys, F.explode(hits).alias("h")).select(*keys, "h.*")
    lex = lexicon.select("category", "lang", "ord", F.lower("pattern").alias("pattern")).filter("pattern <> ''")
    patterns = lex.select("pattern").distinct()
    index = gram_index(patterns)
    bits, sizes = _entered_grams(index)
    texts = df.select(*keys, F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_lt"))
    kinds = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys)
    grams = texts.mapInArrow(_grams_of(bits, sizes), f"{kinds}, gram long")
    names = [f"_k{i}" for i in range(len(keys))]
    met = (grams.join(index, "gram").select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "pattern").distinct())
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    for c in same[1:]:
        same[0] = same[0] & c
    found = texts.join(met, same[0]).filter(F.col("_lt").contains(F.col("pattern"))).select(*keys, "pattern")
    return found.join(lex, "pattern").select(*keys, "category", "lang", "ord", "pattern")


def lexicon_hit_counts(df: DataFrame, key: str, text_col: str = "text", lexicon=None) -> DataFrame:
    """(key, category, n_hits). Hits of one text stay in its own row, so the
    count is per-row work followed by a small aggregate of hit rows."""
    return (lexicon_hits(df, key, text_col, lexicon)
            .groupBy(key, "category").agg(F.count(F.lit(1)).alias("n_hits")))


def cap_signals(sig, n: int | None) -> Column:
    """Each list of a signals struct cut to ``n`` entries (None: whole)."""
    s = col(sig)
    if n is None:
        return s
    return F.struct(*[F.slice(s[c], 1, n).alias(c) for c in dims.SIGNAL_COLUMNS],
                    s["language_detected"].alias("language_detected"))


# ---------------------------------------------------------------------------
# model replies
# ---------------------------------------------------------------------------
def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(PY_WHITESPACE))


def response_json(raw, mode: str = "fenced") -> Column:
    """Model reply text -> VARIANT (null when it does not parse).

    ``fenced``: strip; inside the first ```json fence, else the first ```
    fence; from the first '{' (when it is not the first character) to the last
    '}'; parse. ``prefix`` (planner replies): only when the text starts with a
    fence, take the first fenced part and drop a leading ``json`` word.
    """
    r = _strip(col(raw))
    if mode == "prefix":
        part = F.split_part(r, F.lit("```"), F.lit(2))
        part = F.when(part.startswith("json"), F.substr(part, F.lit(5))).otherwise(part)
        body = F.when(r.startswith("```"), part).otherwise(r)
        return F.try_parse_json(_strip(body))
    fenced = (F.when(F.instr(r, "```json") > 0,
                     F.split_part(F.split_part(r, F.lit("```json"), F.lit(2)), F.lit("```"), F.lit(1)))
              .when(F.instr(r, "```") > 0,
                    F.split_part(F.split_part(r, F.lit("```"), F.lit(2)), F.lit("```"), F.lit(1)))
              .otherwise(r))

    def trim_braces(s):
        s1 = F.when(F.instr(s, "{") > 1, F.substr(s, F.instr(s, "{"))).otherwise(s)
        return bind(s1, lambda t: F.when(F.instr(t, "}") > 0, F.regexp_extract(t, r"(?s)^(.*\})", 1))
                    .otherwise(t))

    return F.try_parse_json(_strip(bind(fenced, trim_braces)))


def _vtype(v: Column, key: str) -> Column:
    """Type name of a scalar at ``$.key`` (only used on scalars: cheap)."""
    return F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))


def is_object(v: Column, path: str = "$") -> Column:
    """The value at ``path`` is a JSON object (cast test; no schema string built)."""
    return F.try_variant_get(v, path, "map<string,variant>").isNotNull()


def is_array(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>").isNotNull()


def valid_signals(v) -> Column:
    """Reply is an object with five list fields and a string language."""
    v = col(v)
    ok = is_object(v)
    for k in dims.SIGNAL_COLUMNS:
        ok = ok & is_array(v, f"$.{k}")
    return ok & F.coalesce(_vtype(v, "language_detected") == "STRING", F.lit(False))


def model_signals(v) -> Column:
    v = col(v)
    return F.struct(*[F.coalesce(F.try_variant_get(v, f"$.{k}", "array<string>"),
                                 F.array().cast("array<string>")).alias(k)
                      for k in dims.SIGNAL_COLUMNS],
                    F.try_variant_get(v, "$.language_detected", "string").alias("language_detected"))


def merge_signals(model, rule) -> Column:
    """Union of model and rule phrases (model first); hints and language from the model."""
    m, r = col(model), col(rule)
    fields = [F.array_union(m[c], r[c]).alias(c) for c in dims.CATEGORY_COLUMNS.values()]
    fields.append(m["dark_pattern_hints"].alias("dark_pattern_hints"))
    fields.append(F.coalesce(m["language_detected"], F.lit("unknown")).alias("language_detected"))
    return F.struct(*fields)


def extract_signals(df: DataFrame, text_col: str, key: str, responses: DataFrame | None = None,
                    raw_col: str = "raw", lexicon=None, fallback_on_error: bool = True,
                    cap: int | None = None) -> DataFrame:
    """Whole extraction per text: rules always; a valid model reply is merged.

    ``responses`` holds (key, raw) model replies; it is left-joined on ``key``
    (a text without reply counts as a failed model call). Output: key columns,
    the five lists (cut to ``cap`` if given), ``extraction_method`` (hybrid|fallback) and
    ``language_detected``. With ``fallback_on_error=False`` an invalid reply
    fails the job, like the audited tool raising.
    """
    base = df.withColumn("_rule", rule_signals(text_col, lexicon))
    if responses is None:
        out = base.withColumn("_valid", F.lit(False)).withColumn("_merged", F.col("_rule"))
    else:
        r = responses.select(F.col(key), F.col(raw_col).alias("_raw"))
        joined = base.join(r, key, "left")
        v = response_json("_raw")
        joined = joined.withColumn("_v", v).withColumn("_valid", F.coalesce(valid_signals("_v"), F.lit(False)))
        out = joined.withColumn("_merged", F.when(F.col("_valid"), merge_signals(model_signals("_v"), "_rule"))
                                .otherwise(F.col("_rule")))
    method = F.when(F.col("_valid"), F.lit("hybrid")).otherwise(F.lit("fallback"))
    if not fallback_on_error:
        method = F.when(F.col("_valid"), method).otherwise(
            F.raise_error(F.lit("LLM extraction failed and fallback is disabled")))
    capped = cap_signals("_merged", cap)
    keep = [c for c in df.columns]
    return out.select(*keep, *[capped[c].alias(c) for c in dims.SIGNAL_COLUMNS],
                      method.alias("extraction_method"),
                      capped["language_detected"].alias("language_detected"))


def reject_missing_flag(accept="consent_accept", reject="consent_reject") -> Column:
    """Accept wording present and no reject wording, in one extraction."""
    return (F.size(col(accept)) > 0) & (F.size(col(reject)) == 0)
