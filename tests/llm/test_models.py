"""Language, quality, licenses, benchmark passages, URL rules and packing."""
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import ODD, empty, frame, words

from veilscan.llm import decontaminate, langid, license_scan, packing, quality, url_filter
from veilscan.llm.queries import QUERIES
from veilscan.llm.store import Store

SF = "/root/testdata/sf0.01"


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


# language

def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op1_language_id"](spark, SF).join(docs, "doc_id").filter("held_out AND lang IS NOT NULL")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right >= 0.97 * n


def test_language_odd_rows(spark):
    train = spark.createDataFrame([("the cat sat on the mat and then", "en"), ("le chat est sur la table rouge", "fr"), (None, "de"), ("x", None)],
                                  "text string, lang string")
    model = langid.fit(train)
    got = langid.predict(frame(spark, [*ODD, "the mat and the cat", "123 ..."]), model, ["doc_id", "key"]).collect()
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (0, 1, 2, 3, 8)] == ["und"] * 5 and by[7].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got) and by[0].rejected and len(got) == 9
    none = langid.fit(train.filter("lang = 'xx'"))
    assert {r.lang_pred for r in langid.predict(frame(spark, ["abc"]), none, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(empty(spark), model, ["doc_id"]).count() == 0


def test_far_text_is_rejected(spark):
    rnd = random.Random(1)
    train = [(" ".join(rnd.choice(["tha", "then", "inga", "shor", "wer"]) for _ in range(40)), "en") for _ in range(60)]
    model = langid.fit(spark.createDataFrame(train, "text string, lang string"))
    rows = langid.predict(frame(spark, [train[0][0], "ы щ ю ж ф ъ э " * 20]), model, ["doc_id"]).collect()
    assert {r.doc_id: r.rejected for r in rows} == {0: False, 1: True}


# quality

def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    train, rest = labels.filter("doc_id % 4 <> 0"), labels.filter("doc_id % 4 = 0")
    got = quality.classify(docs, train, ["doc_id"]).join(rest, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert n.get((1, True), 0) >= 0.98 * sum(v for (q, _), v in n.items() if q == 1)
    assert n.get((0, False), 0) >= 0.9 * sum(v for (q, _), v in n.items() if q == 0)


def test_site_posteriors_shrink(spark):
    rows = [("a", "x", 1.0)] * 200 + [("b", "x", 0.0)] * 200 + [("c", "x", 0.0)] + [("a", "y", 0.0)]
    sites, mean = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    by = {(r.host, r.path): r for r in sites.collect()}
    assert abs(mean - 200 / 402) < 1e-9
    assert by["a", "x"].host_posterior > 0.9 and by["b", "x"].host_posterior < 0.1
    assert by["b", "x"].host_posterior < by["c", "x"].host_posterior < mean  # one document says little
    assert by["a", "y"].path_posterior > by["c", "x"].path_posterior  # a sparse path leans on its host


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (99, 1)], "doc_id long, quality int")
    docs = frame(spark, ["a good text " * 9, "$$$ ### " * 9, *ODD]).withColumn("source", F.when(F.col("doc_id") > 3, "s"))
    got = quality.classify(docs, labels, ["doc_id", "text", "key"]).collect()
    assert len(got) == 9 and all(0 <= r.p_good <= 1 for r in got)
    assert all(r.kept for r in quality.classify(docs, labels.filter("quality = 1"), ["doc_id"]).collect())
    assert quality.classify(empty(spark), labels, ["doc_id"]).count() == 0


# licenses

def test_license_base_places(spark):
    rnd = random.Random(2)
    pool = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "x", "CC-BY", "éa", "General, Public"]
    texts = [" ".join(rnd.choice(pool) + rnd.choice(["", ".", "\n"]) for _ in range(rnd.randrange(25))) for _ in range(60)] + ODD
    got = {r.doc_id: r for r in license_scan.summary(license_scan.scan(frame(spark, texts))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w, places, labels = words_of(t), [], set()
        for phrase, label in license_scan.BASE:
            p = phrase.split()
            here = [k for k in range(len(w)) if w[k:k + len(p)] == p]
            places += here
            labels |= {label} if here else set()
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_license_edits(spark):
    texts = ["Permision is hereby granted, free of charge", "Licenced under the Apache Licence", "all rihgts reserved",
             "GNU Lesser General Public License", "all wrongs reversed", "unrelated words here"]
    spans = {r.doc_id: r.spans for r in license_scan.scan(frame(spark, texts)).collect()}
    labels = {i: {s.label for s in v} for i, v in spans.items()}
    assert [labels[i] for i in range(6)] == [{"mit"}, {"apache"}, {"reserved"}, {"gpl", "lgpl"}, set(), set()]
    s = spans[0][0]
    assert (s.first_word, s.words, s.edits, s.found) == (0, 7, 1, "permision is hereby granted free of charge")


# benchmark passages

def brute_windows(items):
    out = {}
    for i, t in items:
        w = words_of(t)
        k = min(10, len(w))
        for p in range(len(w) - k + 1 if k else 0):
            out.setdefault(tuple(w[p:p + k]), set()).add(i)
    return out


def test_contamination(spark):
    rnd = random.Random(3)
    items = [(i, " ".join(words(rnd, n, 30))) for i, n in enumerate([10, 25, 3, 14, 12, 1])] + [(20, None), (21, "!!"), (3, None)]
    texts = []
    for _ in range(40):
        own = words(rnd, rnd.randrange(30), 3000)
        for _ in range(rnd.randrange(3)):
            src = rnd.choice(items[:6])[1].split()
            lo = rnd.randrange(len(src))
            own[rnd.randrange(len(own) + 1):0] = src[lo:lo + rnd.randrange(1, 20)]
        texts.append(", ".join(own).title())
    texts += ODD
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, window long")
    got = {r.doc_id: r for r in decontaminate.contamination(frame(spark, texts), bench).collect()}
    windows = brute_windows(items)
    assert len(got) == len(texts) and sum(r.contaminated for r in got.values()) > 5
    for i, t in enumerate(texts):
        w, hit, names = words_of(t), set(), set()
        for p in range(len(w)):
            for k in (1, 3, 10):
                if tuple(w[p:p + k]) in windows and len(w[p:p + k]) == k:
                    hit |= set(range(p, p + k))
                    names |= windows[tuple(w[p:p + k])]
        joined = ",".join(sorted(map(str, names)))
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(names), bool(hit))
        assert r.items_sha256 == hashlib.sha256(joined.encode()).hexdigest()


def test_contamination_of_nothing(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.contamination(empty(spark), bench).count() == 0
    clean = decontaminate.contamination(frame(spark, ["a b c"]), bench.limit(0)).collect()
    assert [(r.n_words, r.contaminated) for r in clean] == [(3, False)]


def test_proximity(spark):
    store = Store(spark, "t")
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    texts = ["x delta y beta alpha z gamma", "alpha beta gamma delta", "alpha " + "x " * 9 + "beta gamma delta", "alpha beta gamma", "gamma beta delta alpha"]
    index = decontaminate.build_index(frame(spark, texts), store)
    found, _ = decontaminate.search(index, decontaminate.test_windows(bench), store, slack=2)
    assert {(r.doc_id, r.kind) for r in found.collect()} == {(0, "near"), (1, "near"), (1, "phrase"), (4, "near")}


# urls

def test_url_rules(spark):
    urls = [None, "no scheme", "http://A.Org/x", "https://m.Example.org/es/1?q#f", "http://example.org/en/17", "http://example.org/en/27",
            "x://badexample.org/es/", "http://shop.com/fr/1", "http://com/de/", "http://shop.com?/de/", "http://h.net/de/9#a", "a://b://c/d", "http://notcom/fr/1"]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, bad int")
    labels = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: r for r in url_filter.judge(pages, labels).collect()}
    rules = [got[i].rule for i in range(len(urls))]
    assert rules == [None, None, "org/", "example.org/es/", "example.org/en/1", "org/", "org/", "com/fr/", "com/de/", None, None, None, None]
    assert (got[3].host, got[3].path, got[3].verdict) == ("m.example.org", "/es/1", "block")
    assert (got[9].host, got[9].path) == ("shop.com", "") and (got[11].host, got[11].path) == ("b:", "//c/d")
    assert (got[0].host, got[0].path, got[0].verdict) == ("", "", "allow")
    assert url_filter.judge(pages.limit(0), labels).count() == 0


def test_templates_by_purity(spark):
    rows, marks, n = [], [], 0
    for i in range(120):
        for section, bad in (("shop", 1), ("news", 0), ("blog", 0)):
            for host in ("big.net", "other.net"):
                rows.append((n, f"http://{host}/{section}/item{i}/{i}.html"))
                marks.append((n, bad if host == "big.net" else None))
                n += 1
    pages, labels = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(marks, "page_id long, bad int")
    got = {(r.host, r.path.split("/")[1]): r for r in url_filter.judge(pages, labels).collect()}
    assert got["big.net", "shop"].template == "/shop/*/*" and got["big.net", "shop"].verdict == "block"
    assert got["big.net", "news"].template != got["big.net", "shop"].template and got["big.net", "news"].verdict == "allow"
    assert got["other.net", "shop"].verdict == "allow"  # no labels of its own


# packing

def test_plan_places_every_rank():
    for seed in range(6):
        rnd = random.Random(seed)
        size = rnd.choice([16, 64, 2048])
        lengths = {}
        for _ in range(rnd.choice([1, 30, 3000])):
            n = min(size, max(1, int(rnd.lognormvariate(np.log(size) * 0.7, 1))))
            lengths[n] = lengths.get(n, 0) + 1
        steps = packing.plan(dict(lengths), size, crumb=2)
        filled = {}
        for length, count in lengths.items():
            for rank in range(count):
                n, r = length, rank
                while n:
                    lo, _, first, offset, piece, tail = next(s for s in steps[n] if s[0] <= r < s[1])
                    filled.setdefault(first + r - lo, []).append((offset, piece))
                    n, r = n - piece, tail + r - lo
        assert sorted(filled) == list(range(len(filled)))
        for parts in filled.values():
            at = 0
            for offset, piece in sorted(parts):
                assert offset == at
                at += piece
            assert at <= size
        assert len(filled) <= -(-sum(k * v for k, v in lengths.items()) // size) * 1.1 + 1


def test_packed_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    rnd = random.Random(5)
    texts = [" ".join(words(rnd, rnd.randrange(1, 1500))) for _ in range(25)]
    texts += ["It's we'll DON'T 12ab <|endoftext|>x<|startoftext|>", "ΣΑΣ İstanbul e\u0301 é 日本語 🎉\x1cz \u00a0\u2003y", "naïve ×÷ ½", *ODD]
    docs = frame(spark, texts).unionAll(frame(spark, ["again"])).unionAll(spark.createDataFrame([(None, "no id")], "doc_id long, text string")
                                                                        .selectExpr("doc_id", "text", *["NULL"] * 7))
    size, whole = 256, Tokenizer.from_file(str(path))
    out = packing.pack(docs, str(path), size).collect()
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts) if i}
    filled = {}
    for r in out:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
    assert sorted(filled) == list(range(len(filled)))
    for i, own in ids.items():
        at = 0
        for r in sorted((r for r in out if r.doc_id == i), key=lambda r: r.start):
            piece = np.array(own[r.start:r.start + r.length], "<u4").tobytes()
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(piece), len(own))
            at += r.length
        assert at == len(own)
    assert sum(r.length for r in out) >= 0.97 * size * (len(filled) - 1)
    assert packing.pack(empty(spark), str(path)).count() == 0


def test_inexact_notices_close_together_are_all_found():
    s = license_scan.Scanner([], [("general public license", "gpl")])
    norm = " the genral public license general public license or general publc licens "
    found = [(norm[a:b], e) for _, a, b, e in s.spans(norm)]
    assert [e for t, e in found if t == "genral public license"] == [1]
    assert [e for t, e in found if t == "general public license"] == [0]
    assert [e for t, e in found if t == "general publc licens"] == [2]


def test_deep_paths_are_judged_to_their_last_segment(spark):
    kinds = ["ads", "news"] * 40
    pages = spark.createDataFrame([(i, f"http://h.net/2021/05/17/9/8/{k}/{i}") for i, k in enumerate(kinds)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(k == "ads")) for i, k in enumerate(kinds)], "page_id long, bad int")
    got = {(r.path.split("/")[6], r.template, r.verdict) for r in url_filter.judge(pages, labels, rules=[]).collect()}
    assert got == {("ads", "/*/*/*/*/*/ads/*", "block"), ("news", "/*/*/*/*/*/news/*", "allow")}


def test_one_deep_url_costs_a_few_tables(spark, monkeypatch):
    """A path of 40 segments among shallow ones: finished in a handful of rounds."""
    saved = []
    save = Store.save
    monkeypatch.setattr(Store, "save", lambda self, df, name, *a: saved.append(name) or save(self, df, name, *a))
    deep = "/".join(f"s{i}" for i in range(40))
    pages = spark.createDataFrame([(0, f"http://h.net/{deep}")] + [(i, f"http://h.net/a/{i}") for i in range(1, 20)], "page_id long, url string")
    got = {r.page_id: r.template for r in url_filter.judge(pages, spark.createDataFrame([], "page_id long, bad int"), rules=[]).collect()}
    assert got[0] == "/*" * 40 and got[3] == "/*/*" and len(saved) < 15


def test_a_long_text_of_inexact_notices_is_quick():
    s = license_scan.Scanner(*map(list, (license_scan.BASE, license_scan.NOTICES)))
    norm = " " + "all rihgts reserved and so on " * 3300
    began = time.time()
    spans = s.spans(norm)
    assert time.time() - began < 5
    places = {a for i, a, b, e in spans if norm[a:b] == "all rihgts reserved"}
    assert len(places) == 3300
