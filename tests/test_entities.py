"""Character-reference decoding equals the HTML5 rules of Python's html.unescape."""
import html
import random

from pyspark.sql import functions as F

from veilscan.functions.entities import unescape, unescape_sql, with_entity_maps
from veilscan.functions.text import strip

CASES = ["a &amp; b", "&amp", "&ampfoo;", "&copy ththre", "x&#65;y", "&#x1F600;", "&#0;", "&#128;", "&#x80",
         "&#xD800;", "&#99999999999;", "&#1;", "&notit;", "&notin;", "&#;", "&#x;", "& b", "a&", "&&&",
         "&amp;&amp;&amp;", "&AMP;", "&Aacute;x", "&aacutex", "no entity", "&#65", "&#0000065;", "&#xfffe;",
         "&lt;b&gt;", "&nbsp;", "&zwnj;", "&#x10FFFF;", "&#x110000;", "", "&;", "&unknown;", "&middot;&middot",
         "it's \\ 'q'", "&#13;", "&#x9F;", "&#150;"]


def _random_cases(n=300, seed=7):
    rnd = random.Random(seed)
    names = ["amp", "lt", "copy", "middot", "notin", "not", "frac12", "#38", "#x26", "#", "Aacute", "zz"]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randint(1, 5)):
            parts.append(rnd.choice(["a", " ", "é", "&" + rnd.choice(names) + rnd.choice(["", ";", "x;", " "])]))
        out.append("".join(parts))
    return out


def test_unescape_matches_python(spark):
    cases = CASES + _random_cases()
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    rows = df.select("s", unescape("s").alias("u"),
                     F.expr(with_entity_maps(lambda m: unescape_sql("s", m))).alias("v")).collect()
    for r in rows:
        assert r.u == html.unescape(r.s), r.s
        assert r.v == html.unescape(r.s), r.s


def test_strip_is_python_strip(spark):
    vals = ["  a ", " x ", "\x1cy\x1f", "\tz\n", "　w ", "plain"]
    rows = spark.createDataFrame([(v,) for v in vals], "s string").select("s", strip("s").alias("t")).collect()
    for r in rows:
        assert r.t == r.s.strip()
