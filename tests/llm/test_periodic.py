"""Runs of words against brute force over all periods."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import ODD, empty, frame

from veilscan.llm import periodic
from veilscan.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def brute_runs(w, least=24, times=3):
    """Every maximal stretch of every period, the smallest period of each."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def some_words(rnd, kind):
    n = rnd.randrange(0, 260)
    if kind == 0:
        return [f"w{rnd.randrange(2)}" for _ in range(n)]
    if kind == 1:  # stretches of all periods, cut anywhere
        out = []
        while len(out) < n:
            unit = [f"u{rnd.randrange(rnd.choice([2, 3, 50]))}" for _ in range(rnd.randrange(1, 30))]
            out += (unit * rnd.randrange(1, 9))[:rnd.randrange(1, 120)]
        return out
    if kind == 2:  # Fibonacci and Thue-Morse words
        a, b = ["a"], ["a", "b"]
        while len(b) < n:
            a, b = b, b + a
        return b if rnd.random() < 0.5 else [str(bin(i).count("1") % 2) for i in range(n)]
    if kind == 3:  # runs of runs
        unit = (["x"] * rnd.randrange(20, 30) + ["y"]) * rnd.randrange(1, 5)
        return unit * rnd.randrange(1, 4) + unit[:rnd.randrange(len(unit))]
    return [f"w{rnd.randrange(5000)}" for _ in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_many_texts_at_once(seed):
    rnd = random.Random(seed)
    texts = [some_words(rnd, rnd.randrange(5)) for _ in range(60)]
    ids = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    rng = np.random.default_rng(seed)
    hashes = rng.integers(1, 2**63, len(ids), dtype=np.uint64)
    words = np.array([hashes[ids[w]] for t in texts for w in t], np.uint64)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = periodic.find_runs(words, bounds)
    want = [(d, *r) for d, t in enumerate(texts) for r in brute_runs(t)]
    assert [tuple(r) for r in got.tolist()] == want
    assert len(want) > 30


def test_grammar_gives_the_text_back_and_no_pair_twice():
    rnd = random.Random(5)
    texts = [[f"{k}:{x}" for x in some_words(rnd, 1)] for k in range(20)]
    flat = [x for t in texts for x in t]
    names, symbols = np.unique(flat, return_inverse=True)
    stretch = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    rule, of, left, right = periodic.re_pair(symbols.astype(np.int64), stretch, len(names))

    def spell(s):
        return [s] if s < len(names) else spell(left[s - len(names)]) + spell(right[s - len(names)])
    assert [names[x] for s in rule for x in spell(s)] == flat
    for k in range(len(texts)):
        own = rule[of == k]
        pairs = [(a, b) for a, b in zip(own, own[1:]) if a != b]
        assert len(set(pairs)) == len(pairs)


def test_long_and_plain_repeats():
    for w in (["x"] * 200_000, ["a", "b", "c"] * 40_000, [f"v{i}" for i in range(9_000)] * 4):
        ids = np.array([zlib.crc32(x.encode()) * 0x9E3779B97F4A7C15 % 2**64 for x in w], np.uint64)
        q = len(dict.fromkeys(w))
        assert periodic.find_runs(ids, np.array([0, len(w)])).tolist() == [[0, 0, len(w), q]]


def test_odd_rows(spark):
    texts = [*ODD, "A a " * 12, "A a " * 12, "\n".join(["one two\tthree"] * 9) + " four", None]
    docs = frame(spark, texts).unionAll(spark.createDataFrame([(None, "q " * 24, "", "", 0, 0, 0, 0, "")], frame(spark, []).schema))
    rows = periodic.periodic_runs(docs).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) + 1 and got[None].n_words == 24
    for i, t in enumerate(texts):
        w = words_of(t)
        runs = brute_runs(w) if len(w) < 1000 else [(0, len(w), 1)]
        assert [tuple(r) for r in got[i].runs] == runs and got[i].n_words == len(w)
        assert got[i].collapsed == collapse(w, runs)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
        assert (tuple(got[i].best) if got[i].best else None) == best
    assert got[1].collapsed == "" and got[len(ODD)].collapsed == "A a"
    none = periodic.periodic_runs(empty(spark))
    assert none.count() == 0 and [f.name for f in none.schema] == ["doc_id", "n_words", "best", "runs", "collapsed"]


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op13_periodic_runs"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    hits = 0
    for r in rows:
        w = words_of(docs[r.doc_id])
        h = zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 3000:
            continue
        runs = brute_runs(w)
        hits += bool(runs)
        listed = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None, None, None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapse(w, runs).encode()).hexdigest()
    assert hits > 5


def test_planted_period_of_nulls(spark):
    df = spark.createDataFrame([(k, t) for k in range(60) for t in (None, "", " \n", "one")], "doc_id long, text string")
    for r in df.select("text", periodic.with_planted_period(F.col("doc_id"), F.col("text")).alias("new")).collect():
        assert (r.new or "").split() == (r.text or "").split() and (r.new is None) == (r.text is None)
