"""Text signals: phrases of both languages, lower-casing, reply parsing."""
import random

from pyspark.sql import functions as F

from veilscan.operators import signals as S

ENGLISH = ("Hurry: selling fast, and our special offer ends in one hour, so order while stock is left for you only. "
           "Start a free trial that will auto-renew; cancel anytime. Click accept all, or manage preferences first.")
TURKISH = ("Stokta sadece bir adet kaldı, çünkü kampanya bitiyor. Ücretsiz deneme ile başlayın, otomatik yenileme açıktır. "
           "Tümünü kabul et düğmesi var, tercihleri yönet bağlantısı da.")
PLAIN = "A quiet page about garden birds."


def _scan(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    return {r.id: r for r in S.lexicon_scan(df, "text").collect()}


def test_phrases_of_both_languages(spark):
    r = _scan(spark, [ENGLISH, TURKISH, PLAIN])
    assert r[0].urgency_texts == ["only", "left", "hurry", "ends in", "selling fast", "offer ends"]
    assert r[0].subscription_keywords == ["auto-renew", "cancel anytime", "free trial"]
    assert r[0].consent_accept == ["accept all"]
    assert r[0].consent_reject == ["manage preferences"]
    assert r[1].urgency_texts == ["sadece", "kaldı", "kampanya bitiyor"]
    assert r[1].subscription_keywords == ["otomatik yenileme", "ücretsiz deneme"]
    assert r[1].consent_accept == ["tümünü kabul et"]
    assert r[1].consent_reject == ["tercihleri yönet"]
    assert r[2].urgency_texts == [] and r[2].consent_accept == []


def test_lower_case_like_python(spark):
    texts = ["KALDI", "İZİN VER", "ONLY NECESSARY", "commonly"]
    r = _scan(spark, texts)
    assert r[0].urgency_texts == []            # "KALDI".lower() == "kaldi" != "kaldı"
    assert r[1].consent_accept == [p for p in ["izin ver"] if p in "İZİN VER".lower()]
    assert r[2].consent_reject == ["only necessary"] and r[2].urgency_texts == ["only"]
    assert r[3].urgency_texts == ["only"]      # substring, not word match


def test_hits_join_equals_scan(spark):
    from veilscan.sources import dims
    df = spark.createDataFrame([(1, ENGLISH), (2, TURKISH)], "id long, text string")
    a = sorted(tuple(r) for r in S.lexicon_hits(df, "id", "text").collect())
    b = sorted(tuple(r) for r in S.lexicon_hits(df, "id", "text", dims.lexicon(spark)).collect())
    assert a == b and len(a) > 10


def test_hits_join_without_broadcast(spark):
    """Short and long phrases, null and repeated keys; every phrase found in every text, by brute force."""
    rnd = random.Random(4)
    letters = "abcde é"
    phrases = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 9))).lower() for _ in range(300)} | {"only now left"})
    texts = ["".join(rnd.choice(letters.upper()) for _ in range(rnd.randrange(0, 60))) for _ in range(40)] + [None, "", "Only NOW left!"]
    lex = spark.createDataFrame([("c", "en", i, p) for i, p in enumerate(phrases)] + [("d", "en", 0, "only now left")],
                                "category string, lang string, ord int, pattern string")
    df = spark.createDataFrame([(i // 2 if i % 5 else None, t) for i, t in enumerate(texts)], "id long, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted((str(r.id), r.category, r.pattern) for r in S.lexicon_hits(df, "id", "text", lex).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = [(str(i // 2 if i % 5 else None), "c", p) for i, t in enumerate(texts) for p in phrases if p in (t or "").lower()]
    assert got == sorted(want + [(str(len(texts) // 2), "d", "only now left")]) and len(want) > 300


def test_no_text_is_exchanged_before_the_candidates(spark):
    lex = spark.createDataFrame([("c", "en", 0, "limited offer")], "category string, lang string, ord int, pattern string")
    df = spark.range(50).selectExpr("id", "concat('A limited offer ', id) AS text")
    plan = S.lexicon_hits(df, "id", "text", lex)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_lt") and "gram" in plan
    for line in plan.splitlines():
        if "Generate explode" in line:
            assert "_lt" not in line.split("]")[-1]


def test_long_text_against_many_phrases(spark):
    """Linear in the text: 100,000 characters against 20,000 phrases."""
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(40_000)]
    text = " ".join(words[:15_000])
    lex = spark.createDataFrame([("c", "en", i, w) for i, w in enumerate(words[10_000:30_000])], "category string, lang string, ord int, pattern string")
    hits = S.lexicon_hits(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text", lex)
    assert {r.pattern for r in hits.collect()} >= set(words[10_000:15_000])


def test_grams_without_phrases_are_dropped_at_once(spark):
    """Of texts without a phrase's letters no gram leaves its task; short, long and multi-byte phrases keep theirs."""
    lex = spark.createDataFrame([("only",), ("limited offer",), ("çünkü",)], "pattern string")
    bits, sizes = S._entered_grams(S.gram_index(lex))
    texts = spark.createDataFrame([(1, "zzz " * 5000), (2, "a limited offer"), (None, "only çünkü only"), (4, "")], "id long, text string")
    rows = texts.mapInArrow(S._grams_of(bits, sizes), "id long, gram long").collect()
    assert sizes == [4, 6] and sorted(str(r.id) for r in rows) == ["2", "None", "None"]


REPLIES = {
    "fenced": ('x\n```json\n{"urgency_texts": ["a"], "subscription_keywords": [], "consent_accept": [], '
               '"consent_reject": [], "dark_pattern_hints": [], "language_detected": "en"}\n```', True),
    "preamble": ('Sure! {"urgency_texts": [], "subscription_keywords": [], "consent_accept": [], '
                 '"consent_reject": [], "dark_pattern_hints": ["h"], "language_detected": "tr"} bye', True),
    "empty": ("", False),
    "list": ("[1, 2]", False),
    "brace_order": ("} {", False),
    "string_list": ('{"urgency_texts": "a", "subscription_keywords": [], "consent_accept": [], '
                    '"consent_reject": [], "dark_pattern_hints": [], "language_detected": "en"}', False),
    "missing": ('{"urgency_texts": [], "subscription_keywords": [], "consent_accept": [], '
                '"consent_reject": [], "dark_pattern_hints": []}', False),
    "two_fences": ('```\n{"urgency_texts": [], "subscription_keywords": [], "consent_accept": [], '
                   '"consent_reject": [], "dark_pattern_hints": [], "language_detected": "en"}\n```\n```\n{}\n```', True),
}


def test_reply_validation(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in REPLIES.items()], "k string, raw string")
    got = {r.k: r.ok for r in df.select("k", F.coalesce(S.valid_signals(S.response_json("raw")),
                                                         F.lit(False)).alias("ok")).collect()}
    assert got == {k: v[1] for k, v in REPLIES.items()}


def test_extract_merges_and_falls_back(spark):
    texts = spark.createDataFrame([(1, ENGLISH), (2, PLAIN)], "id long, text string")
    replies = spark.createDataFrame([(1, REPLIES["fenced"][0])], "id long, raw string")
    out = {r.id: r for r in S.extract_signals(texts, "text", "id", responses=replies).collect()}
    assert out[1].extraction_method == "hybrid" and out[1].urgency_texts[0] == "a"
    assert out[1].language_detected == "en"
    assert out[2].extraction_method == "fallback" and out[2].language_detected == "unknown"
    assert all(len(out[1][c]) <= 10 for c in ["urgency_texts", "subscription_keywords"])


def test_whole_word_option(spark):
    df = spark.createDataFrame([(1, "commonly only"), (2, "commonly")], "id long, text string")
    sub = {r.id: r.urgency_texts for r in S.lexicon_scan(df, "text").collect()}
    word = {r.id: r.urgency_texts for r in S.lexicon_scan(df, "text", whole_word=True).collect()}
    assert sub == {1: ["only"], 2: ["only"]}
    assert word == {1: ["only"], 2: []}


def test_full_amount_prices(spark):
    from veilscan.functions import html as H
    df = spark.createDataFrame([(1, "<p>$1,299.99 and 2.500,00 EUR</p>")], "id long, html string")
    r = df.select(H.prices("html").alias("a"), H.prices("html", full_amount=True).alias("b")).collect()[0]
    assert r.a == ["$1,299", "500,00 EUR"] or r.a[0] == "$1,299"
    assert r.b[0] == "$1,299.99"
