"""Language vectors and quality posteriors against plain computations that share no code with the operators."""
import math
import random
from collections import Counter, defaultdict

import numpy as np
from texts import SCHEMA, words

from veilscan.llm import langid, quality


def plain_bins(text):
    """Bins of the 1- to 3-byte strings of a lower-cased text with all but letters as one blank, counted."""
    folded = [b if 97 <= b <= 122 or b >= 128 else 32 for b in text.lower().encode()]
    squeezed = [b for i, b in enumerate(folded) if not (i and b == 32 and folded[i - 1] == 32)]
    out = Counter()
    for n, seed in ((1, 0x9E3779B1), (2, 0x85EBCA6B), (3, 0xC2B2AE35)):
        for i in range(len(squeezed) - n + 1):
            code = n
            for b in squeezed[i:i + n]:
                code = (code * 256 + b) % 2**32
            out[(code * seed % 2**32) >> 20] += 1
    return out


def test_language_by_plain_cosines(spark):
    """Document frequencies of all training rows, TF-IDF, and the cosine of every centroid, text by text."""
    rnd = random.Random(3)
    sounds = {"aa": "abcde", "bb": "fghij", "cc": "klméö"}
    rows = []
    for i in range(120):
        lang = rnd.choice(list(sounds))
        text = " ".join("".join(rnd.choice(sounds[lang] + "st") for _ in range(rnd.randrange(1, 8))) for _ in range(rnd.randrange(1, 40)))
        rows.append((i, text + rnd.choice(["", "!", " 12"]), lang if i % 9 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    known = [plain_bins(t) for _, t, lang in rows if lang]
    df = Counter(b for bins in known for b in bins)
    idf = [math.log((1 + len(known)) / (1 + df[b])) + 1 for b in range(4096)]
    assert np.allclose(model.idf, idf, rtol=1e-5)
    assert sorted(set(model.langs)) == sorted(sounds) and np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)
    got = {r.doc_id: r for r in langid.predict(docs, model, ["doc_id"]).collect()}
    for i, text, _ in rows:
        bins = plain_bins(text)
        norm = math.sqrt(sum((n * idf[b]) ** 2 for b, n in bins.items()))
        cosines = [sum(n * idf[b] * float(c[b]) for b, n in bins.items()) / norm for c in model.centroids]
        best = max(range(len(cosines)), key=lambda k: cosines[k])
        assert abs(got[i].score - min(max(cosines[best], 0), 1)) < 1e-4
        close = [k for k, c in enumerate(cosines) if c > cosines[best] - 1e-4]
        assert got[i].lang_pred in {model.langs[k] for k in close}


def test_clashing_names_are_carried(spark):
    """Columns that bear names used inside come back as they were."""
    rows = [(i, " ".join(words(random.Random(i), 20)) + ".", "en", f"s{i % 2}", 7, 7, 7, 7, "w") for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'h' AS host", "'p' AS path", "5 AS letters", "6 AS carried", "'t' AS th", "8 AS good")
    model = langid.fit(docs)
    out = langid.predict(docs, model, ["doc_id", "text", "letters", "carried", "lang"]).collect()
    assert {(r.letters, r.carried, r.lang) for r in out} == {(5, 6, "en")} and {r.text for r in out} == {r[1] for r in rows}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels, carry=["doc_id", "host", "path", "text", "carried", "good"]).collect()
    assert len(out) == 30 and {(r.host, r.path, r.carried, r.good) for r in out} == {("h", "p", 6, 8)}


def test_quality_by_plain_posteriors(spark):
    """Host and path posteriors, shrinkage strengths and final odds, from the documents' own probabilities."""
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(160):
        good = rnd.random() < 0.6
        text = ". ".join(" ".join(words(rnd, rnd.randrange(5, 12))).capitalize() for _ in range(5)) if good else "!!! " + "x1 " * rnd.randrange(3, 30)
        rows.append((i, text, rnd.choice(["en", "de", None]), f"s{0 if good else rnd.randrange(4)}"))
        if i % 3 == 0:
            labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int"), carry=["doc_id"]).collect()}
    known = dict(labels)
    sums = defaultdict(lambda: [0, 0.0])
    for i, _, lang, source in rows:
        p = float(known[i]) if i in known else got[i].p_text
        for site in ((), (source,), (source, lang)):
            sums[site][0] += 1
            sums[site][1] += p
    n, s = sums[()]
    mean = s / n
    noise = max(mean * (1 - mean), 1e-6)

    def strength(level, centre):
        sites = [k for k in sums if len(k) == level]
        spread = sum(sums[k][0] * (sums[k][1] / sums[k][0] - centre(k)) ** 2 for k in sites)
        between = (spread - noise * len(sites)) / n
        return min(max(noise / between - 1, 1.0), 1e6) if between > 0 else 1e6

    by_host = strength(1, lambda k: mean)
    by_path = strength(2, lambda k: sums[k[:1]][1] / sums[k[:1]][0])
    for i, _, lang, source in rows:
        host = (sums[source,][1] + by_host * mean) / (sums[source,][0] + by_host)
        path = (sums[source, lang][1] + by_path * host) / (sums[source, lang][0] + by_path)
        odds = [math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6))) for p in (got[i].p_text, path, mean)]
        p = 1 / (1 + math.exp(-(odds[0] + odds[1] - odds[2])))
        r = got[i]
        assert abs(r.host_posterior - host) < 1e-9 and abs(r.path_posterior - path) < 1e-9 and abs(r.p_good - p) < 1e-9
        assert r.kept == (p >= 0.5 - 1e-9)
    assert 0.2 < sum(r.kept for r in got.values()) / len(got) < 0.9
