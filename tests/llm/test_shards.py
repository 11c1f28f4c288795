"""K-d tree shards against a tree built by sorting."""
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from texts import ODD, empty, frame

from veilscan.llm import kd_shards
from veilscan.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute_tree(points, shards, slack):
    """Shard of each point (dims, hash, size), by sorting every node; rows of a group are in order."""
    spread = [max(max(p[0][i] for p in points) - min(p[0][i] for p in points), 1) for i in range(len(points[0][0]))]
    out = {}

    def split(own, first, k):
        if k == 1 or not own:
            out.update((i, first) for i in own)
            return
        values = [[points[i][0][d] for i in own] for d in range(len(spread))]
        width = [(max(v) - min(v)) / s for v, s in zip(values, spread)]
        dim = max(range(len(width)), key=lambda d: (width[d], -d))
        own = sorted(own, key=lambda i: (points[i][0][dim], points[i][1], i))
        total = sum(points[i][2] for i in own)
        goal, at = total * (k // 2) / k, 0
        groups = []
        for j, i in enumerate(own):
            if not groups or points[own[groups[-1][-1]]][1] != points[i][1] or points[own[groups[-1][-1]]][0][dim] != points[i][0][dim]:
                groups.append([])
            groups[-1].append(j)
        below = 0
        for g in groups:
            w = sum(points[own[j]][2] for j in g)
            if below + w >= goal or g is groups[-1]:
                break
            below += w
        units = [g] if w <= slack * total / k else [[j] for j in g]
        for u in units:
            w = sum(points[own[j]][2] for j in u)
            if below + w >= goal or u is units[-1]:
                break
            below += w
        at = u[0] if not below + w - goal < goal - below else u[-1] + 1
        split(own[:at], first, k // 2)
        split(own[at:], first + k // 2, k - k // 2)
    split(list(range(len(points))), 0, shards)
    return out


def check_basics(rows, texts, shards):
    assert len(rows) == len(texts)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        assert 0 <= r.shard < shards
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("shards,hot", [(8, 0), (8, 150), (5, 40), (1, 0)])
def test_tree(spark, shards, hot):
    rnd = random.Random(shards + hot)
    texts = ["".join(rnd.choice("abc é") for _ in range(rnd.randrange(0, 300))) for _ in range(200)]
    texts += ["the same text " * 9] * hot + rnd.sample(texts, 30)
    lang = [rnd.choice(["en", "de", None]) for _ in texts]
    rows = [(i, t, a, f"s{rnd.randrange(4)}") for i, (t, a) in enumerate(zip(texts, lang))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    got = {r.doc_id: r for r in kd_shards.kd_shards(docs, shards, slack=0.01).collect()}
    check_basics(got.values(), texts, shards)
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2).alias("h")).collect()}
    number = lambda s: -1 if s is None else zlib.crc32(s.encode())
    least = defaultdict(lambda: [1 << 40, 1 << 40])
    for i, t, a, s in rows:
        least[t] = [min(least[t][0], number(a)), min(least[t][1], number(s))]
    want = brute_tree([((got[i].size, *least[t]), hashes[i], got[i].size) for i, t, _, _ in rows], shards, 0.01)
    assert {i: r.shard for i, r in got.items()} == want


def test_copies_stay_together_unless_heavy(spark):
    rnd = random.Random(3)
    texts = [f"text {i} " * rnd.randrange(1, 40) for i in range(400)]
    docs = spark.createDataFrame([(i, texts[i % 400], "en" if i % 7 else "fr", "s") for i in range(2000)],
                                 "doc_id long, text string, lang string, source string")
    rows = kd_shards.kd_shards(docs, slack=0.05).collect()
    where = defaultdict(set)
    for r in rows:
        where[texts[r.doc_id % 400]].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_odd_rows(spark):
    docs = frame(spark, [*ODD, *ODD]).withColumn("size", F.lit(3)).withColumn("shard", F.lit(9)).withColumn("node", F.lit("x")).withColumn("h", F.lit(1))
    check_basics(kd_shards.kd_shards(docs).collect(), [*ODD, *ODD], 8)
    same = spark.createDataFrame([(None, None, None, None)] * 20 + [(1, "x", "en", "s")] * 20, docs.select("doc_id", "text", "lang", "source").schema)
    rows = kd_shards.kd_shards(same).collect()
    weight = Counter()
    for r in rows:
        weight[r.shard] += r.size
    assert len(rows) == 40 and max(weight.values()) - min(weight.values()) <= 2 and len(weight) == 8
    none = kd_shards.kd_shards(empty(spark))
    assert none.count() == 0 and [f.name for f in none.schema] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op12_kd_shards"](spark, SF).collect()
    check_basics(rows, texts, 8)
    weight = Counter()
    for r in rows:
        weight[r.shard] += r.size
    total, largest = sum(weight.values()), max(r.size for r in rows)
    assert all(abs(w - total / 8) <= math.log2(8) * (0.002 * total / 8 + largest) for w in weight.values())
