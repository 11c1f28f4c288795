"""Findings: analyst replies, rule classification, taxonomy/legal enrichment, risk.

Dimensions (taxonomy 58 rows + aliases, legal map 16 pairs, rules 32 rows)
are of fixed size and always broadcast. Per-site rollups are aggregates with
map-side partial aggregation; "one finding per instance" is a min-by
aggregate rather than a window, so a hot site never sits in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, col
from ..sources import dims
from .signals import is_object, response_json

# fixed values: fields of a finding, keys of a report and the error texts of the contract
FINDING_FIELDS = ["pattern", "level", "high_level_strategy", "severity", "evidence", "location",
                  "gdpr_risk", "legal_reference", "recommendation"]
FINDING_TYPE = ("struct<pattern:string,level:string,high_level_strategy:string,severity:string,"
                "evidence:string,location:string,gdpr_risk:boolean,legal_reference:string,"
                "recommendation:string>")
REPORT_KEYS = ["dark_patterns_found", "overall_risk", "overall_summary", "gdpr_concerns",
               "pattern_count", "language_detected"]
ERR_NO_REPLY = "All backends failed"
ERR_STRUCTURE = "Invalid response structure from LLM"
ERR_CONSTRUCT = "Report construction failed"
# fixed values: the domains of a finding's level and severity
LEVELS = ["low", "meso", "high"]
SEVERITIES = ["LOW", "MEDIUM", "HIGH"]

_TRUE = ["true", "1", "yes", "on", "t", "y"]
_FALSE = ["false", "0", "no", "off", "f", "n"]


def _scalar(v: Column, path: str = "$") -> Column:
    """A value with the name of its type, for the readers below (bind it once)."""
    e = F.try_variant_get(v, path, "variant")
    return F.struct(F.schema_of_variant(e).alias("t"), e.alias("e"))


def _as_string(x: Column) -> Column:
    return F.when(x["t"] == "STRING", F.try_variant_get(x["e"], "$", "string"))


def _as_bool(x: Column) -> Column:
    """Boolean the way a lax typed model reads it: true/false, 0/1, or the
    usual words ("yes", "off", "t", ...); null when it is none of these."""
    t, n = x["t"], F.try_variant_get(x["e"], "$", "double")
    s = F.lower(F.try_variant_get(x["e"], "$", "string"))
    return (F.when(t == "BOOLEAN", F.try_variant_get(x["e"], "$", "boolean"))
            .when((t == "STRING") & s.isin(_TRUE), F.lit(True))
            .when((t == "STRING") & s.isin(_FALSE), F.lit(False))
            .when(t.startswith("BIGINT") | t.startswith("DECIMAL") | t.startswith("DOUBLE"),
                  F.when(n == 1, F.lit(True)).when(n == 0, F.lit(False))))


def _as_int(x: Column) -> Column:
    """Integer the way a lax typed model reads it: an integer, an integral
    decimal (2.0), or a string of digits; null otherwise."""
    t, d = x["t"], F.try_variant_get(x["e"], "$", "double")
    s = F.try_variant_get(x["e"], "$", "string")
    return (F.when(t == "BIGINT", F.try_variant_get(x["e"], "$", "bigint"))
            .when((t.startswith("DECIMAL") | t.startswith("DOUBLE")) & (d == F.floor(d)), d.cast("bigint"))
            .when((t == "STRING") & s.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(s).try_cast("bigint")))


def _checked_finding(m: Column) -> Column:
    """Struct(f, bad) of one finding given as map<string,variant>: typed values, first unusable field.

    Every field is looked up and its type named once; all later steps read the bound struct.
    """
    def read(raw):
        values = [(_as_bool if k == "gdpr_risk" else _as_string)(raw[k]).alias(k) for k in FINDING_FIELDS]

        def judge(f):
            bad = F.coalesce(*[
                # the legal reference must be there, but may be null
                F.when((~raw[k]["t"].isin("STRING", "VOID") | raw[k]["t"].isNull()) if k == "legal_reference" else f[k].isNull(), F.lit(k))
                for k in FINDING_FIELDS])
            return F.struct(f.alias("f"), F.when(m.isNull(), "object").otherwise(bad).alias("bad"))

        return bind(F.struct(*values), judge)

    return bind(F.struct(*[_scalar(F.try_element_at(m, F.lit(k))).alias(k) for k in FINDING_FIELDS]), read)


def _finding_ok(f: Column) -> Column:
    """A finding (variant) has all nine keys with values a typed model accepts."""
    return _checked_finding(F.try_variant_get(f, "$", "map<string,variant>"))["bad"].isNull()


def report_status(raw) -> Column:
    """Struct(v, r, error, detail, checked): a reply parsed once, and which of the three failures it is.

    ``detail`` names the first field that a typed report cannot take.
    """
    def on_parsed(v):
        obj = is_object(v)
        scalars = F.struct(*[_scalar(v, f"$.{k}").alias(k) for k in [*REPORT_KEYS, "ontology_reference"]])
        checked = F.transform(F.try_variant_get(v, "$.dark_patterns_found", "array<map<string,variant>>"), _checked_finding)

        def on_scalars(x):
            typed = F.struct(_as_bool(x["gdpr_concerns"]).alias("gdpr_concerns"), _as_int(x["pattern_count"]).alias("pattern_count"),
                             *[_as_string(x[k]).alias(k) for k in ("overall_risk", "overall_summary", "language_detected", "ontology_reference")])

            def on_both(c):
                keys_ok = obj
                for k in REPORT_KEYS:
                    keys_ok = keys_ok & x[k]["t"].isNotNull()
                r, cs = c["r"], c["checked"]
                at = F.array_position(F.transform(cs, lambda y: y["bad"].isNotNull()), True)
                detail = F.coalesce(
                    F.when(cs.isNull(), F.lit("dark_patterns_found")),
                    F.when(at > 0, F.concat(F.lit("dark_patterns_found["), (at - 1).cast("string"), F.lit("]."),
                                            F.try_element_at(cs, at.cast("int"))["bad"])),
                    *[F.when(r[k].isNull(), F.lit(k)) for k in ("gdpr_concerns", "pattern_count", "overall_risk", "overall_summary", "language_detected")],
                    F.when(x["ontology_reference"]["t"].isNotNull() & r["ontology_reference"].isNull(), F.lit("ontology_reference")))
                error = (F.when(v.isNull() | ~obj, F.lit(ERR_NO_REPLY)).when(~keys_ok, F.lit(ERR_STRUCTURE))
                         .when(detail.isNotNull(), F.lit(ERR_CONSTRUCT)))
                return F.struct(v.alias("v"), r.alias("r"), error.alias("error"), detail.alias("detail"), cs.alias("checked"))

            return bind(F.struct(typed.alias("r"), checked.alias("checked")), on_both)

        return bind(scalars, on_scalars)

    return bind(response_json(raw), on_parsed)


def parse_reports(responses: DataFrame, key: str = "site", raw_col: str = "raw",
                  salvage: bool = False) -> DataFrame:
    """Analyst replies -> one typed report row per key (failed ones UNKNOWN).

    ``salvage=True`` keeps the valid findings of a report whose other findings
    fail validation (the default, like the audited tool, voids the report).
    """
    st = responses.select(key, report_status(raw_col).alias("_s"))
    r = F.col("_s.r")
    ok = F.col("_s.error").isNull()
    typed = F.transform(F.filter(F.col("_s.checked"), lambda x: x["bad"].isNull()), lambda x: x["f"])
    if salvage:
        ok_findings = F.coalesce(typed, F.array().cast(f"array<{FINDING_TYPE}>"))
        success = ok | (F.col("_s.error") == ERR_CONSTRUCT)
    else:
        ok_findings = F.when(ok, typed).otherwise(F.array().cast(f"array<{FINDING_TYPE}>"))
        success = ok
    return st.select(
        key,
        ok_findings.alias("dark_patterns_found"),
        F.when(success, F.coalesce(r["overall_risk"], F.lit("UNKNOWN")))
        .otherwise(F.lit("UNKNOWN")).alias("overall_risk"),
        F.when(success, F.coalesce(r["overall_summary"], F.lit("")))
        .otherwise(F.lit("Analysis failed.")).alias("overall_summary"),
        F.when(success, F.coalesce(r["gdpr_concerns"], F.lit(False)))
        .otherwise(F.lit(False)).alias("gdpr_concerns"),
        F.when(success, F.coalesce(r["pattern_count"].cast("int"), F.size(ok_findings)))
        .otherwise(F.lit(0)).alias("pattern_count"),
        F.when(success, F.coalesce(r["language_detected"], F.lit("unknown")))
        .otherwise(F.lit("unknown")).alias("language_detected"),
        F.when(success, F.coalesce(r["ontology_reference"],
                                   F.lit(dims.ONTOLOGY_REFERENCE_SHORT)))
        .otherwise(F.lit(dims.ONTOLOGY_REFERENCE_SHORT)).alias("ontology_reference"),
        success.alias("analysis_success"),
        F.when(~success, F.col("_s.error")).alias("analysis_error"),
        F.when(F.col("_s.error") == ERR_CONSTRUCT, F.col("_s.detail")).alias("error_detail"),
    ).transform(_with_checks)


def _with_checks(rep: DataFrame) -> DataFrame:
    """The model's own count, risk and GDPR flag are kept; computed values and
    mismatch flags sit beside them, with the count of findings whose level or
    severity is outside its domain."""
    f = F.col("dark_patterns_found")
    sev = F.array_max(F.transform(f, lambda x: severity_rank(x["severity"])))
    computed = (F.when(~F.col("analysis_success"), F.lit("UNKNOWN")).when(sev == 3, "HIGH")
                .when(sev == 2, "MEDIUM").when(sev == 1, "LOW").otherwise("CLEAN"))
    gdpr = F.coalesce(F.exists(f, lambda x: F.coalesce(x["gdpr_risk"], F.lit(False))), F.lit(False))
    return (rep.withColumn("computed_pattern_count", F.size(f))
            .withColumn("computed_risk", computed)
            .withColumn("computed_gdpr", gdpr)
            .withColumn("n_out_of_domain", F.size(F.filter(f, lambda x: ~x["level"].isin(LEVELS) | ~x["severity"].isin(SEVERITIES))))
            .withColumn("count_mismatch", F.col("pattern_count") != F.col("computed_pattern_count"))
            .withColumn("risk_mismatch", F.col("overall_risk") != F.col("computed_risk"))
            .withColumn("gdpr_mismatch", F.col("gdpr_concerns") != F.col("computed_gdpr")))


def explode_findings(reports: DataFrame, key: str = "site") -> DataFrame:
    """One row per finding, keeping the position (reports without findings give none)."""
    return reports.select(key, F.posexplode("dark_patterns_found").alias("finding_no", "f")) \
        .select(key, (F.col("finding_no") + 1).alias("finding_no"), "f.*")


# ---------------------------------------------------------------------------
# enrichment
# ---------------------------------------------------------------------------
def enrich_taxonomy(findings: DataFrame, pattern_col: str = "pattern") -> DataFrame:
    """Canonical pattern, level, strategy and definition for a name or alias."""
    dim = dims.name_dim(findings.sparkSession)
    return findings.join(F.broadcast(dim), F.col(pattern_col) == F.col("name"), "left").drop("name")


def enrich_legal(findings: DataFrame, pattern_col: str = "canonical_pattern") -> DataFrame:
    """Laws per canonical pattern (many-to-many), gdpr flag; the dimension is
    pre-aggregated per pattern (at most 16 rows) so each finding joins one row."""
    laws = dims.laws_dim(findings.sparkSession)
    out = findings.join(F.broadcast(laws), F.col(pattern_col) == F.col("_lp"), "left").drop("_lp")
    return (out.withColumn("laws", F.coalesce("laws", F.array().cast("array<string>")))
            .withColumn("law_names", F.coalesce("law_names", F.array().cast("array<string>")))
            .withColumn("gdpr_by_law", F.array_contains("laws", "GDPR")))


def with_display(findings: DataFrame) -> DataFrame:
    """Severity colour and strategy icon, with the report's defaults."""
    return (findings
            .withColumn("severity_color", F.coalesce(F.element_at(dims.literal_map(dims.SEVERITY_COLORS),
                                                                   F.col("severity")), F.lit(dims.DEFAULT_COLOR)))
            .withColumn("strategy_icon", F.coalesce(F.element_at(dims.literal_map(dims.STRATEGY_ICONS),
                                                                  F.col("high_level_strategy")),
                                                    F.lit(dims.DEFAULT_ICON))))


def level_rank(level) -> Column:
    return F.when(col(level) == "low", 1).when(col(level) == "meso", 2).otherwise(3)


def severity_rank(sev) -> Column:
    return F.coalesce(F.element_at(dims.literal_map(dims.SEVERITY_RANK), col(sev)), F.lit(0))


def most_specific(findings: DataFrame, keys=("site", "evidence", "high_level_strategy")) -> DataFrame:
    """One finding per instance: within ``keys`` keep only the most specific
    level present (low over meso; high-level alone is never a finding).

    The minimum level per instance is an aggregate (partial aggregation keeps
    a hot site spread), joined back on the instance keys.
    """
    keys = list(keys)
    ranked = findings.withColumn("_lr", level_rank("level"))
    best = ranked.groupBy(*keys).agg(F.min("_lr").alias("_best"))
    return ranked.join(best, keys).filter(F.col("_lr") == F.col("_best")).drop("_lr", "_best")


def dedupe(findings: DataFrame, keys=("site", "pattern", "evidence")) -> DataFrame:
    return findings.dropDuplicates(list(keys))


def overall_risk(findings: DataFrame, sites: DataFrame | None = None, key: str = "site") -> DataFrame:
    """Per site: pattern_count, gdpr_concerns, overall_risk = max severity; no findings: CLEAN."""
    agg = findings.groupBy(key).agg(
        F.count(F.lit(1)).alias("pattern_count"),
        F.coalesce(F.bool_or("gdpr_risk"), F.lit(False)).alias("gdpr_concerns"),
        F.max(severity_rank("severity")).alias("_r"))
    risk = F.when(F.col("_r") == 3, "HIGH").when(F.col("_r") == 2, "MEDIUM").when(F.col("_r") == 1, "LOW") \
        .otherwise("CLEAN")
    out = agg.withColumn("overall_risk", risk).drop("_r")
    if sites is not None:
        out = sites.select(key).distinct().join(out, key, "left").select(
            key, F.coalesce("pattern_count", F.lit(0)).alias("pattern_count"),
            F.coalesce("gdpr_concerns", F.lit(False)).alias("gdpr_concerns"),
            F.coalesce("overall_risk", F.lit("CLEAN")).alias("overall_risk"))
    return out


def risk_code(risk) -> Column:
    """Process exit code of the audit: HIGH 2, MEDIUM/LOW 1, else 0."""
    return F.coalesce(F.element_at(dims.literal_map(dims.RISK_EXIT_CODES), col(risk)), F.lit(0))


# ---------------------------------------------------------------------------
# rule classification (re-aimed analyst)
# ---------------------------------------------------------------------------
def _rule_rank() -> Column:
    return F.struct(-severity_rank("severity"), F.col("recommendation"), F.col("kind"), F.col("signal"))


def classify(evidence: DataFrame, key: str = "site", rules: DataFrame | None = None) -> DataFrame:
    """Evidence -> findings with the rules table.

    ``evidence`` has per-key columns: ``phrases`` (array of lexicon phrases
    found), ``categories`` (lexicon categories with a hit) and boolean flags
    named like the rules' ``flag`` signals. Signals are unpivoted to rows and
    joined with the broadcast rules table (one finding per key and pattern,
    evidence = its signals), enriched with taxonomy and legal map, and reduced
    to the most specific level per instance: phrase rules share the
    ``urgency`` instance (a low-level message pattern replaces the meso
    Urgency), every other rule is its own instance.
    """
    spark = evidence.sparkSession
    rules = rules if rules is not None else dims.rules(spark)
    flag_names = sorted({s for k, s, *_ in dims.RULES if k == "flag"})
    present = [f for f in flag_names if f in evidence.columns]
    st = "array<struct<kind:string,signal:string>>"
    phrases = F.transform(F.coalesce(F.col("phrases"), F.array().cast("array<string>")),
                          lambda p: F.struct(F.lit("phrase").alias("kind"), p.alias("signal")))
    cats = F.transform(F.coalesce(F.col("categories"), F.array().cast("array<string>")),
                       lambda c: F.struct(F.lit("category").alias("kind"), c.alias("signal")))
    flags = F.array_compact(F.array(*[F.when(F.col(f), F.struct(F.lit("flag").alias("kind"),
                                                                 F.lit(f).alias("signal")))
                                      for f in present])) if present else F.array().cast(st)
    sig = F.concat(phrases.cast(st), cats.cast(st), flags.cast(st))
    signals = evidence.select(key, F.explode(sig).alias("s")).select(key, "s.kind", "s.signal")
    hits = signals.join(rules, ["kind", "signal"])  # the built-in rules are an inline table, broadcast by its size
    found = (hits.groupBy(key, "pattern").agg(
        # of several rules of one pattern the most severe speaks, then the first of the alphabet
        F.min_by("severity", _rule_rank()).alias("severity"), F.min_by("recommendation", _rule_rank()).alias("recommendation"),
        F.min_by(F.when(F.col("kind") == "phrase", F.lit("urgency")).otherwise(F.col("signal")), _rule_rank()).alias("instance"),
        F.array_join(F.array_sort(F.collect_set("signal")), ", ").alias("evidence")))
    enriched = enrich_legal(enrich_taxonomy(found))
    findings = enriched.select(
        key, F.col("canonical_pattern").alias("pattern"), F.col("tax_level").alias("level"),
        F.col("tax_strategy").alias("high_level_strategy"), "severity", "evidence",
        F.lit("page").alias("location"), F.col("gdpr_by_law").alias("gdpr_risk"),
        F.try_element_at(F.col("laws"), F.lit(1)).alias("legal_reference"), "recommendation", "instance")
    return most_specific(findings, keys=(key, "instance")).drop("instance")


def classify_inline_sql(flags: list[str]) -> str:
    """SQL text of the inline classification over columns phrases, categories, flags."""
    from ..functions.sqlgen import q
    def lit_struct(k, sg, p, sev, rec):
        inst = "urgency" if k == "phrase" else sg
        return (f"named_struct('kind', {q(k)}, 'signal', {q(sg)}, 'pattern', {q(p)}, 'severity', {q(sev)}, "
                f"'recommendation', {q(rec)}, 'instance', {q(inst)})")
    rules = "array(" + ", ".join(lit_struct(*r) for r in dims.RULES) + ")"
    tax = {n: (lv, stg) for n, _, lv, stg, _ in dims.name_dim_rows()}
    levels = "map(" + ", ".join(f"{q(p)}, {q(v[0])}" for p, v in tax.items()) + ")"
    strategies = "map(" + ", ".join(f"{q(p)}, {q(v[1])}" for p, v in tax.items()) + ")"
    laws = "map(" + ", ".join(f"{q(p)}, array({', '.join(q(x) for x in ls)})" for p, ls, _ in dims.laws_rows()) + ")"
    st = "array<struct<kind:string,signal:string>>"
    sig = (f"concat(cast(transform(coalesce(phrases, cast(array() as array<string>)), p -> named_struct('kind', 'phrase', 'signal', p)) as {st}), "
           f"cast(transform(coalesce(categories, cast(array() as array<string>)), c -> named_struct('kind', 'category', 'signal', c)) as {st}), "
           f"cast(array_compact(array({', '.join(f'CASE WHEN {f} THEN named_struct({chr(39)}kind{chr(39)}, {chr(39)}flag{chr(39)}, {chr(39)}signal{chr(39)}, {q(f)}) END' for f in flags) or 'NULL'})) as {st}))")
    one = ("named_struct('pattern', p, 'level', element_at(LV, p), 'high_level_strategy', element_at(SG, p), "
           "'severity', rs[0].severity, 'evidence', array_join(array_sort(array_distinct(transform(rs, r -> r.signal))), ', '), "
           "'location', 'page', 'gdpr_risk', array_contains(coalesce(element_at(LW, p), cast(array() as array<string>)), 'GDPR'), "
           "'legal_reference', try_element_at(coalesce(element_at(LW, p), cast(array() as array<string>)), 1), "
           "'recommendation', rs[0].recommendation, 'instance', rs[0].instance, "
           "'lr', CASE element_at(LV, p) WHEN 'low' THEN 1 WHEN 'meso' THEN 2 ELSE 3 END)")
    one = one.replace("LV", levels).replace("SG", strategies).replace("LW", laws)
    per_pattern = f"transform(array_distinct(transform(m, r -> r.pattern)), p -> transform(array(filter(m, r -> r.pattern = p)), rs -> {one})[0])"
    matched = f"filter({rules}, r -> exists(sg, s -> s.kind = r.kind AND s.signal = r.signal))"
    keep = ("transform(filter(fs, x -> x.lr = array_min(transform(filter(fs, y -> y.instance = x.instance), y -> y.lr))), "
            "x -> named_struct('pattern', x.pattern, 'level', x.level, 'high_level_strategy', x.high_level_strategy, "
            "'severity', x.severity, 'evidence', x.evidence, 'location', x.location, 'gdpr_risk', x.gdpr_risk, "
            "'legal_reference', x.legal_reference, 'recommendation', x.recommendation))")
    return (f"transform(array({sig}), sg -> transform(array(transform(array({matched}), m -> {per_pattern})[0]), "
            f"fs -> {keep})[0])[0]")


def classify_inline(evidence: DataFrame, out: str = "findings") -> DataFrame:
    """Row-local classification for per-key evidence rows (default rules).

    Same result as ``classify`` for the built-in rules, but rules, taxonomy and
    legal map are inlined as literals and every step is an array expression
    inside the evidence row: no join and no shuffle. Arrays are bounded by the
    rules (at most one finding per rule pattern). Written as one SQL
    expression: a single parse instead of hundreds of JVM calls.
    """
    flag_names = sorted({s for k, s, *_ in dims.RULES if k == "flag"})
    present = [f for f in flag_names if f in evidence.columns]
    return evidence.withColumn(out, F.expr(classify_inline_sql(present)))


def risk_of(findings_col: str = "findings") -> Column:
    """overall_risk of a findings array: max severity; none -> CLEAN."""
    r = F.array_max(F.transform(F.col(findings_col), lambda f: severity_rank(f["severity"])))
    return F.when(r == 3, "HIGH").when(r == 2, "MEDIUM").when(r == 1, "LOW").otherwise("CLEAN")
