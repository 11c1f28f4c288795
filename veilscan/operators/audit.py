"""Host audit: crawl pages -> features -> signals -> per-host findings -> risk.

One narrow stage (scan, feature projection, lexicon scan; the HTML never
leaves it), one exchange on the host for its evidence (partial aggregation
map-side; the state is flags, a count and bitmasks of the lexicon's phrases),
and classification inside each host row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dom
from .findings import classify_inline, risk_of
from .signals import _lexicon_rows, _phrases, categories_of, rule_signals

#: Phrases of one bitmask.
BITS = 63

HOST_RE = r"^https?://([^/?#:]+)"


def host_col(url="url"):
    return F.regexp_extract(F.col(url), HOST_RE, 1)


def page_evidence(pages: DataFrame, lexicon=None) -> DataFrame:
    """Per page: host, phrases found in the whole visible text, feature flags."""
    feats = dom.page_features(pages, fields=[
        "visible_text", "preselected_checkboxes", "popup_detected", "small_print", "sticky_elements"])
    sig = rule_signals("visible_text", lexicon)
    return feats.select(
        "page_id", host_col().alias("host"), sig.alias("s"),
        (F.size("preselected_checkboxes") > 0).alias("has_preselected"),
        F.col("popup_detected"), (F.size("small_print") > 0).alias("has_small_print"),
        (F.size("sticky_elements") > 0).alias("has_sticky"),
    ).select("page_id", "host", "s.*", "has_preselected", "popup_detected", "has_small_print", "has_sticky")


def host_evidence(pe: DataFrame, lexicon=None) -> DataFrame:
    """Per-host evidence with aggregation state of a size fixed by the lexicon.

    Each page's phrase hits become bitmasks per lexicon category (phrase i of a
    block of 63 -> bit i); a host's state is the ``bit_or`` of those masks plus
    flags and a count, so a host holding a third of all pages costs the same
    small state per task as any other. Masks are decoded to phrases in lexicon order.
    """
    rows = _lexicon_rows(lexicon)
    cats = {out: cat for cat, out in categories_of(rows).items()}
    blocks = []  # (mask name, signal column, category, phrases)
    for c, cat in cats.items():
        phrases = _phrases(rows, cat)
        blocks += [(f"m{i // BITS}_{c}", c, cat, phrases[i:i + BITS]) for i in range(0, len(phrases), BITS)]

    def literal(phrases):
        return F.array(*[F.lit(p) for p in phrases])

    def mask(c, phrases):
        bit = F.transform(F.col(c), lambda p: F.array_position(literal(phrases), p) - 1)
        return F.aggregate(F.filter(bit, lambda i: i >= 0), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(
            F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))))

    per_page = pe.select("host", *[mask(c, phrases).alias(m) for m, c, _, phrases in blocks],
                         ((F.size("consent_accept") > 0) & (F.size("consent_reject") == 0)).alias("rm"),
                         "has_preselected", "popup_detected", "has_small_print", "has_sticky")
    agg = per_page.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_pages"), *[F.bit_or(m).alias(m) for m, *_ in blocks],
        F.bool_or("rm").alias("reject_button_missing"), F.bool_or("has_preselected").alias("has_preselected"),
        F.bool_or("popup_detected").alias("popup_detected"), F.bool_or("has_small_print").alias("has_small_print"),
        F.bool_or("has_sticky").alias("has_sticky"))

    def decode(m, phrases):
        return F.filter(literal(phrases), lambda p, i: F.call_function("shiftright", F.col(m), i).bitwiseAND(F.lit(1).cast("long")) == 1)

    phrases = F.array_sort(F.array_distinct(F.concat(*[decode(m, ps) for m, _, _, ps in blocks])))
    categories = F.array_distinct(F.array_compact(F.array(*[F.when(F.col(m) != 0, F.lit(cat)) for m, _, cat, _ in blocks])))
    return agg.select("host", "n_pages", phrases.alias("phrases"), categories.alias("categories"),
                      "reject_button_missing", "has_preselected", "popup_detected", "has_small_print", "has_sticky")


def audit_hosts(pages: DataFrame, lexicon=None) -> DataFrame:
    """One exchange: per-host evidence; classification and risk stay inside each host row."""
    ev = classify_inline(host_evidence(page_evidence(pages, lexicon), lexicon))
    f = F.col("findings")
    return ev.select("host", F.col("n_pages").cast("long").alias("n_pages"),
                     F.size(f).cast("long").alias("pattern_count"), risk_of("findings").alias("overall_risk"),
                     F.exists(f, lambda x: x["gdpr_risk"]).alias("gdpr_concerns"),
                     F.array_join(F.array_sort(F.transform(f, lambda x: x["pattern"])), "|").alias("patterns"))
