"""Dimension tables: phrase lexicon, pattern taxonomy, legal map, display maps, rules.

All of them are tiny and of fixed size (62, 58, 16, 11 rows), so every join
against them is a broadcast join with a proven bound. Users may pass their own
DataFrames with the same columns instead (new lexicon categories become new
signal columns, new rules new findings).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the audited tool's configuration for equal results)
# Phrase lexicon: category -> language -> phrases, in file order.
# ---------------------------------------------------------------------------
LEXICON: dict[str, dict[str, list[str]]] = {
    "urgency": {
        "en": ["only", "left", "limited", "hurry", "expires", "ends in", "last chance",
               "selling fast", "almost gone", "today only", "flash sale", "deal ends",
               "offer ends", "while stocks last"],
        "tr": ["sadece", "kaldı", "sınırlı", "acele et", "bugün biter", "son şans",
               "hızlı satıyor", "neredeyse bitti", "fırsatı kaçırma", "kampanya bitiyor",
               "stoklar tükeniyor", "sınırlı stok"],
    },
    "subscription": {
        "en": ["auto-renew", "auto renew", "cancel anytime", "free trial", "recurring",
               "billing cycle", "renews automatically", "subscription"],
        "tr": ["otomatik yenileme", "istediğinde iptal et", "ücretsiz deneme", "abonelik",
               "aylık plan", "yıllık plan", "otomatik uzatma", "fatura dönemi"],
    },
    "consent_accept": {
        "en": ["accept all", "accept cookies", "agree", "allow all", "i accept"],
        "tr": ["tümünü kabul et", "kabul ediyorum", "çerezleri kabul et", "izin ver", "tamam"],
    },
    "consent_reject": {
        "en": ["reject all", "decline", "refuse", "only necessary", "manage preferences"],
        "tr": ["tümünü reddet", "reddet", "yalnızca gerekli", "tercihleri yönet", "vazgeç"],
    },
}

# Default languages and the output column each lexicon category feeds.
DEFAULT_LANGUAGES = ["en", "tr"]
CATEGORY_COLUMNS = {
    "urgency": "urgency_texts",
    "subscription": "subscription_keywords",
    "consent_accept": "consent_accept",
    "consent_reject": "consent_reject",
}
SIGNAL_COLUMNS = ["urgency_texts", "subscription_keywords", "consent_accept",
                  "consent_reject", "dark_pattern_hints"]

# ---------------------------------------------------------------------------
# FIXED VALUES: deceptive-design taxonomy (Gray, Santos, Bielova & Mildner,
# CHI 2024, "An Ontology of Dark Patterns Knowledge"), in catalogue order:
# strategy -> (meso patterns, low patterns), each (name, definition).
# ---------------------------------------------------------------------------
ONTOLOGY_REFERENCE = ("Gray, Santos, Bielova & Mildner (2024). An Ontology of Dark Patterns "
                      "Knowledge. CHI 2024.")
ONTOLOGY_REFERENCE_SHORT = "Gray, Santos, Bielova & Mildner (2024). CHI 2024."

STRATEGIES = ["Sneaking", "Obstruction", "Interface Interference", "Forced Action",
              "Social Engineering"]

TAXONOMY: dict[str, dict[str, list[tuple[str, str]]]] = {
    "Sneaking": {
        "meso": [
            ("Bait and Switch", "user's choice leads to unexpected, undesirable outcome"),
            ("Hiding Information", "relevant info hidden or delayed until later in user journey"),
            ("(De)contextualizing Cues", "info presented in confusing context"),
        ],
        "low": [
            ("Disguised Ads", "ads styled to look like organic content"),
            ("Sneak into Basket", "items added to cart without user consent"),
            ("Drip Pricing", "full price revealed only at end"),
            ("Reference Pricing", "misleading original price to make discount look attractive"),
            ("Conflicting Information", "two or more sources that conflict with each other"),
            ("Information without Context", "controls or info hidden, limiting discoverability"),
        ],
    },
    "Obstruction": {
        "meso": [
            ("Roach Motel", "easy to get in, difficult to get out"),
            ("Creating Barriers", "relevant tasks complicated or prevented"),
            ("Adding Steps", "unnecessary extra steps added to a task"),
        ],
        "low": [
            ("Immortal Accounts", "difficult or impossible to delete account"),
            ("Dead Ends", "inactive links or redirections that prevent user reaching their goal"),
            ("Price Comparison Prevention", "information or copy-paste restricted"),
            ("Intermediate Currencies", "real cost hidden behind virtual currency"),
            ("Privacy Maze", "many pages required to reach privacy controls"),
        ],
    },
    "Interface Interference": {
        "meso": [
            ("Manipulating Choice Architecture",
             "options structured to make undesired outcome more likely"),
            ("Bad Defaults", "default settings not in user's best interest"),
            ("Emotional or Sensory Manipulation", "design evokes emotion to persuade"),
            ("Trick Questions", "confusing wording, double negatives, leading language"),
            ("Choice Overload", "too many options to meaningfully compare"),
            ("Hidden Information", "relevant info disguised or framed as irrelevant"),
            ("Language Inaccessibility", "unnecessarily complex or foreign language used"),
            ("Feedforward Ambiguity", "discrepancy between what user expects and what happens"),
        ],
        "low": [
            ("False Hierarchy", "visual prominence given to some options over equally valid others"),
            ("Visual Prominence", "distracting element competes with user's actual goal"),
            ("Bundling", "products grouped so unbundled price is unclear"),
            ("Pressured Selling", "more expensive options pre-selected or visually prominent"),
            ("Cuteness", "attractive design cues used to create undue trust (e.g. robots)"),
            ("Positive or Negative Framing", "aesthetic cues distract from important info"),
            ("Wrong Language", "important info in language user does not speak"),
            ("Complex Language", "obscure word choices or sentence structure"),
            ("Confirmshaming", "opt-out framed with guilt or shame"),
        ],
    },
    "Forced Action": {
        "meso": [
            ("Nagging", "repeated interruptions to induce undesired action"),
            ("Forced Continuity", "subscription auto-renews without clear notice"),
            ("Forced Registration", "registration falsely presented as required"),
            ("Forced Communication or Disclosure", "more info requested than needed"),
            ("Gamification", "access to functionality tied to repeated undesired use"),
            ("Attention Capture", "tricks user into spending more time than intended"),
        ],
        "low": [
            ("Privacy Zuckering", "user tricked into sharing more personal data than intended"),
            ("Friend Spam", "user's contacts used to spam others"),
            ("Address Book Leeching", "contact info collected under false pretenses"),
            ("Social Pyramid", "existing users manipulated into recruiting new users"),
            ("Pay-to-Play", "functionality claimed free but then charged"),
            ("Grinding", "repeated labor-intensive actions required to unlock functionality"),
            ("Auto-Play", "next video or content plays automatically"),
        ],
    },
    "Social Engineering": {
        "meso": [
            ("Scarcity or Popularity Claims", "false claims about product availability or demand"),
            ("Social Proof", "false or misleading claims about others' behavior"),
            ("Urgency", "false time pressure to accelerate decision-making"),
            ("Personalization", "personal data used to manipulate user goals"),
        ],
        "low": [
            ("High Demand Message", "false claim that product is in high demand"),
            ("Low Stock Message", "false claim that product is low in stock"),
            ("Endorsements and Testimonials", "biased, misleading, or false endorsements"),
            ("Parasocial Pressure", "celebrity/influencer endorsement used deceptively"),
            ("Activity Messages", "false or misleading claims about other users' activity"),
            ("Countdown Timer", "fake countdown clock that resets or disappears"),
            ("Limited Time Message", "vague urgency claim without specific deadline"),
        ],
    },
}

# Other names a pattern is known by (the catalogue lists one low row under three
# names; the legal context uses shorter names for two patterns).
ALIASES: dict[str, list[str]] = {
    "Drip Pricing": ["Hidden Costs", "Partitioned Pricing"],
    "Emotional or Sensory Manipulation": ["Emotional Manipulation"],
}

# FIXED VALUES: legal context, law -> patterns, in catalogue order.
LEGAL: list[tuple[str, list[str]]] = [
    ("GDPR", ["Bad Defaults", "Privacy Zuckering", "Forced Registration", "Immortal Accounts"]),
    ("EU Digital Services Act", ["Nagging", "False Hierarchy", "Confirmshaming"]),
    ("EU Digital Markets Act", ["Hidden Costs", "Bundling", "Forced Registration"]),
    ("EU AI Act", ["Emotional Manipulation", "Personalization", "Attention Capture"]),
    ("Consumer Protection Law", ["Drip Pricing", "Reference Pricing", "Sneak into Basket"]),
]
# Short legal labels used in findings (output enum of the analyst contract).
LEGAL_SHORT = {
    "GDPR": "GDPR",
    "EU Digital Services Act": "DSA",
    "EU Digital Markets Act": "DMA",
    "EU AI Act": "EU AI Act",
    "Consumer Protection Law": "Consumer Protection",
}

# FIXED VALUES: report display maps and defaults.
SEVERITY_COLORS = {"HIGH": "red", "MEDIUM": "yellow", "LOW": "cyan"}
RISK_COLORS = {"HIGH": "red", "MEDIUM": "yellow", "LOW": "cyan", "CLEAN": "green",
               "UNKNOWN": "white"}
STRATEGY_ICONS = {"Sneaking": "🎭", "Obstruction": "🚧", "Interface Interference": "🎨",
                  "Forced Action": "⛓️", "Social Engineering": "🧠"}
DEFAULT_COLOR = "white"
DEFAULT_ICON = "•"
SEVERITY_RANK = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}
RISK_EXIT_CODES = {"HIGH": 2, "MEDIUM": 1, "LOW": 1}

# ---------------------------------------------------------------------------
# Classification rules (ours): signal -> pattern, severity, recommendation.
# `signal` names a boolean evidence column or a lexicon phrase (kind='phrase').
# ---------------------------------------------------------------------------
RULES: list[tuple[str, str, str, str, str]] = [
    # (kind, signal, pattern, severity, recommendation)
    *[("phrase", p, "Low Stock Message", "MEDIUM", "Show real stock levels or remove the claim")
      for p in ["left", "almost gone", "while stocks last", "kaldı", "neredeyse bitti",
                "stoklar tükeniyor", "sınırlı stok"]],
    *[("phrase", p, "Limited Time Message", "MEDIUM", "State a real deadline or remove the claim")
      for p in ["expires", "ends in", "last chance", "today only", "flash sale", "deal ends",
                "offer ends", "bugün biter", "son şans", "fırsatı kaçırma", "kampanya bitiyor"]],
    *[("phrase", p, "High Demand Message", "MEDIUM", "Back demand claims with real data")
      for p in ["selling fast", "hızlı satıyor"]],
    *[("phrase", p, "Urgency", "LOW", "Remove artificial time pressure")
      for p in ["only", "limited", "hurry", "sadece", "sınırlı", "acele et"]],
    ("category", "subscription", "Forced Continuity", "MEDIUM",
     "Disclose renewal terms clearly and allow easy cancellation"),
    ("flag", "has_preselected", "Bad Defaults", "HIGH",
     "Require explicit opt-in instead of pre-selected options"),
    ("flag", "reject_button_missing", "Creating Barriers", "HIGH",
     "Offer a reject option as prominent as accept"),
    ("flag", "popup_detected", "Nagging", "LOW", "Avoid repeated interruptions"),
    ("flag", "has_small_print", "Hiding Information", "LOW",
     "Present important terms in readable text"),
    ("flag", "has_sticky", "Visual Prominence", "LOW",
     "Do not let sticky elements compete with the user's task"),
    ("flag", "price_changed", "Drip Pricing", "HIGH", "Show the full price from the first step"),
]


# ---------------------------------------------------------------------------
# DataFrame builders
# ---------------------------------------------------------------------------
LEXICON_SCHEMA = "category string, lang string, ord int, pattern string"


def lexicon_rows(languages: list[str] | None = None, categories: list[str] | None = None):
    """Rows (category, lang, ord, pattern); ord = language order, then file order."""
    langs = list(languages or DEFAULT_LANGUAGES)
    rows = []
    for cat, by_lang in LEXICON.items():
        if categories is not None and cat not in categories:
            continue
        ord_ = 0
        for lang in langs:
            for p in by_lang.get(lang, []):
                rows.append((cat, lang, ord_, p))
                ord_ += 1
    return rows


def lexicon(spark: SparkSession, languages: list[str] | None = None,
            categories: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Lexicon dimension. ``path`` reads a user table (json/parquet) with the same columns."""
    if path is not None:
        reader = spark.read.schema(LEXICON_SCHEMA)
        df = reader.json(path) if path.endswith(".json") else reader.parquet(path)
        if languages is not None:
            df = df.filter(F.col("lang").isin(list(languages)))
        if categories is not None:
            df = df.filter(F.col("category").isin(list(categories)))
        return df
    return local_table(spark, lexicon_rows(languages, categories), LEXICON_SCHEMA)


TAXONOMY_SCHEMA = ("ord int, strategy string, level string, pattern string, definition string, "
                   "aliases array<string>")


def taxonomy_rows():
    rows, i = [], 0
    for strategy in STRATEGIES:
        for level in ("meso", "low"):
            for name, definition in TAXONOMY[strategy][level]:
                rows.append((i, strategy, level, name, definition, ALIASES.get(name, [])))
                i += 1
    return rows


def taxonomy(spark: SparkSession) -> DataFrame:
    return local_table(spark, taxonomy_rows(), TAXONOMY_SCHEMA)


def taxonomy_names_rows():
    """(name, pattern): every name and alias mapped to its canonical pattern."""
    out = []
    for _, _, _, name, _, aliases in taxonomy_rows():
        out.append((name, name))
        for a in aliases:
            out.append((a, name))
    return out


def taxonomy_names(spark: SparkSession) -> DataFrame:
    return local_table(spark, taxonomy_names_rows(), "name string, pattern string")


LEGAL_SCHEMA = "legal_reference string, legal_short string, legal_name string, pattern string"


def legal_rows():
    names = dict(taxonomy_names_rows())
    rows = []
    for law, pats in LEGAL:
        for p in pats:
            rows.append((law, LEGAL_SHORT[law], p, names.get(p, p)))
    return rows


def legal_map(spark: SparkSession) -> DataFrame:
    """(legal_reference, legal_short, legal_name as written, canonical pattern)."""
    return local_table(spark, legal_rows(), LEGAL_SCHEMA)


RULES_SCHEMA = "kind string, signal string, pattern string, severity string, recommendation string"


def rules(spark: SparkSession) -> DataFrame:
    return local_table(spark, RULES, RULES_SCHEMA)


def _sql_lit(v, typ: str) -> str:
    from ..functions.sqlgen import q
    if v is None:
        return f"CAST(NULL AS {typ})"
    if typ.startswith("array<"):
        inner = typ[6:-1]
        if not v:
            return f"CAST(array() AS {typ})"
        return "array(" + ", ".join(_sql_lit(x, inner) for x in v) + ")"
    if typ in ("int", "bigint"):
        return f"CAST({int(v)} AS {typ})"
    if typ == "boolean":
        return "true" if v else "false"
    return q(str(v))


def local_table(spark: SparkSession, rows, ddl: str) -> DataFrame:
    """A small constant table as a JVM inline table (LocalRelation).

    Unlike ``createDataFrame`` of Python rows (an RDD scanned by Python
    workers, of unknown size), an inline table has exact statistics, so every
    join against it is planned as a broadcast join without an exchange.
    """
    fields = [f.strip().split(" ", 1) for f in _split_ddl(ddl)]
    names = [n for n, _ in fields]
    body = ", ".join("(" + ", ".join(_sql_lit(v, t.strip()) for v, (_, t) in zip(r, fields)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")


def _split_ddl(ddl: str):
    out, depth, cur = [], 0, ""
    for ch in ddl:
        if ch == "<":
            depth += 1
        elif ch == ">":
            depth -= 1
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    if cur.strip():
        out.append(cur)
    return out


def literal_map(d: dict):
    """A map literal column from a small Python dict."""
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def name_dim_rows():
    """(name, canonical pattern, level, strategy, definition) for every name and alias."""
    tax = {p: (lv, st, d) for _, st, lv, p, d, _ in taxonomy_rows()}
    return [(n, p, *tax[p]) for n, p in taxonomy_names_rows()]


def name_dim(spark: SparkSession) -> DataFrame:
    return local_table(spark, name_dim_rows(),
                       "name string, canonical_pattern string, tax_level string, tax_strategy string, definition string")


def laws_rows():
    """(pattern, sorted short law labels, sorted law names) per canonical pattern."""
    by = {}
    for law, short, _, p in legal_rows():
        by.setdefault(p, (set(), set()))
        by[p][0].add(short)
        by[p][1].add(law)
    return [(p, sorted(a), sorted(b)) for p, (a, b) in by.items()]


def laws_dim(spark: SparkSession) -> DataFrame:
    return local_table(spark, laws_rows(), "_lp string, laws array<string>, law_names array<string>")
