"""Exact and near duplicates, repeated lines and repeated byte strings against brute force."""
import hashlib
import itertools
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from texts import ODD, empty, frame, groups_of, near_copies, words

from veilscan.llm import exact_dedup, induced_sort, line_dedup, minhash_dedup, suffix_dedup
from veilscan.llm.linkage import components
from veilscan.llm.store import Store
from veilscan.llm.textbytes import slice_words


def rows_by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# exact

def test_exact_groups(spark):
    long = "ab " * 40000
    texts = ["a b", "ab", None, "", " \n", long, long + "\t", long + "c", "A b", "a\x0bb ", "\u00a0ab"]
    got = rows_by_id(exact_dedup.exact_groups(frame(spark, texts), first_width=2, growth=3))
    norm = [re.sub("[\x20\x09-\x0d]", "", t or "") for t in texts]
    for i, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        keep = min(same, key=lambda j: (-len(texts[j] or ""), j))
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(same), keep == i)
        assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_exact_odd_rows(spark):
    assert exact_dedup.exact_groups(empty(spark)).count() == 0
    twice = frame(spark, ["x", "y"]).unionAll(frame(spark, ["x"]))
    got = exact_dedup.exact_groups(twice).collect()
    assert sorted((r.doc_id, r.group_size, r.kept) for r in got) == [(0, 2, True), (0, 2, True), (1, 1, True)]
    nulls = spark.createDataFrame([(None, "q"), (5, "q")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_groups(nulls).collect()} == {(None, 5, False), (5, 5, True)}


# near

def shingle_set(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", lowered)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent):
    texts = near_copies(percent) + ODD + ODD
    sets = [shingle_set(t) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2)
             if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = groups_of(links, range(len(texts)))
    got = rows_by_id(minhash_dedup.near_duplicates(frame(spark, texts), percent))
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())


def test_near_duplicates_of_nothing(spark):
    assert minhash_dedup.near_duplicates(empty(spark)).count() == 0


def test_sketch_never_excludes_a_similar_pair(spark):
    rnd = np.random.default_rng(3)
    for n in (5, 40, 300, 1000):
        a = np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64))
        other = rnd.integers(0, 2**63, n // 12, dtype=np.uint64)
        b = np.unique(np.concatenate((a[: len(a) - len(other)], other)))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = minhash_dedup.odd_sketch([a, b])
        flips = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
        expected = len(a) + len(b) - 2 * (len(a) + len(b)) * j / (1 + j)
        assert flips <= expected + 1e-6


def test_components(spark):
    rnd = random.Random(4)
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    ids = sorted({i for ab in links for i in ab if ab[0] != ab[1]})
    got = {r.id: r.component for r in components(Store(spark, "t"), spark.createDataFrame(links, "a long, b long")).collect()}
    want = groups_of(links, range(131))
    assert got == {i: want[i] for i in ids}


# lines

def forms_of(text):
    """(line, normal form) of the lines of a text that have a word."""
    for k, line in enumerate((text or "").split("\n")):
        form = " ".join(re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)))
        if form:
            yield k, form


def similar_lines(a, b):
    """The stated rule, by plain distances (behind a bound by the letters and words in common)."""
    x, y = a.split(), b.split()
    if abs(len(a) - len(b)) > 0.5 * max(len(a), len(b)) or (min(len(x), len(y)) > 8 and len(set(x) ^ set(y)) > 0.3 * max(len(x), len(y))):
        return False
    if plain_distance(x, y) <= 0.1 * max(len(x), len(y)) + 1e-9:
        return True
    return max(len(x), len(y)) <= 8 and plain_distance(a, b) <= 0.1 * max(len(a), len(b)) + 1e-9


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def line_links(names, sig, width):
    """Pairs of forms that meet in a block and are similar, over all pairs, from their SimHashes as whole numbers."""
    total = len(sig[names[0]]) * 64
    bits = {f: sum(int(w) << 64 * k for k, w in enumerate(sig[f])) for f in names}
    bits = {f: v | v << total for f, v in bits.items()}
    for a, b in itertools.combinations(names, 2):
        x = bits[a] ^ bits[b]
        if (x & (1 << total) - 1).bit_count() > int(line_dedup.FLIPS * total):
            continue
        for k in range(line_dedup.BLOCKS):
            if not x >> k * width & (1 << width) - 1 and (x >> (k + 1) * width & (1 << line_dedup.CHECK) - 1).bit_count() <= line_dedup.CHECK_FLIPS:
                if similar_lines(a, b):
                    yield a, b
                break


def signatures(names, width):
    """SimHash of each form, by the operator's own features."""
    out = {}
    for f in names:
        data = np.frombuffer(f.encode(), np.uint8)
        _, words, bounds, _, _, starts, ends = line_dedup._lines_of(data, np.array([0, len(data)]))
        features, kind, cuts = line_dedup.line_features(data, starts, ends, words, bounds)
        out[f] = line_dedup.simhash(features, cuts, kind, -(-line_dedup.BLOCKS * width // 64))[0]
    return out


def lines_to_drop(texts, links):
    places = {}
    for d, t in enumerate(texts):
        for k, form in forms_of(t):
            places.setdefault(form, []).append((d, k))
    names = sorted(places)
    group = groups_of([(names.index(a), names.index(b)) for a, b in links], range(len(names)))
    first = {}
    for i, f in enumerate(names):
        first.setdefault(group[i], []).extend(places[f])
    return {p for own in first.values() for p in own if p != min(own)}


def line_corpus(seed):
    """Documents with lines of their own, common lines, and variants of both."""
    rnd = random.Random(seed)
    common = [" ".join(words(rnd, n)) for n in (4, 6, 12, 40, 80)] * 2
    texts = []
    for i in range(40):
        own = [" ".join(words(rnd, rnd.randrange(1, 60))) for _ in range(3)]
        for line in rnd.sample(common, 2):
            w = line.split()
            for _ in range(rnd.randrange(0, max(1, len(w) // 10) + 1)):
                at = rnd.randrange(len(w))
                w[at:at + 1] = rnd.choice([[w[at] + "s"], ["other"], [], [w[at], "more"]])
            own.insert(rnd.randrange(len(own)), " ".join(w) if i % 2 else " ".join(w).title() + "!")
        texts.append("\n".join(own + (["", "Go on.", "***"] if i % 2 else [])))
    return texts


@pytest.mark.parametrize("seed", [5, 6])
def test_repeated_lines(spark, seed):
    """Every pair that meets and is similar is linked, and no pair that is not similar."""
    texts = line_corpus(seed) + ODD[:-1]
    docs = frame(spark, texts)
    names = sorted({f for t in texts for _, f in forms_of(t)})
    width = line_dedup.block_bits(sum(len((t or "").encode()) for t in texts))
    links = list(line_links(names, signatures(names, width), width))
    want = lines_to_drop(texts, links)
    assert len(links) > 40 and len(want) > 40
    got = {(r.doc_id, r.line) for r in line_dedup.repeated_lines(docs, Store(spark, "t")).collect()}
    most = lines_to_drop(texts, [(a, b) for a, b in itertools.combinations(names, 2) if similar_lines(a, b)])
    assert want <= got <= most and len(got) >= 0.9 * len(most)
    want = got
    out = rows_by_id(line_dedup.dedup_lines(docs, carry=["lang", "key", "id", "n", "window"]))
    for d, t in enumerate(texts):
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in want)
        assert (out[d].text, out[d].key, out[d].id, out[d].window) == (kept, 7, 7, "w")
        assert out[d].n_removed == sum((d, k) in want for k in range(len((t or "").split("\n"))))


def line_variants(rnd, n):
    """A line of ``n`` words and copies with up to a tenth of its words replaced, inserted, lost and mixed."""
    line = words(rnd, n, 20_000)
    out = [line]
    for kinds in ("r", "i", "d", "rid"):
        copy = list(line)
        for at in sorted(rnd.sample(range(n), rnd.randrange(1, max(1, n // 10) + 1)), reverse=True):
            kind = rnd.choice(kinds)
            copy[at:at + 1] = {"r": [f"x{rnd.random()}"[:9].replace(".", "")], "i": [f"y{at}", copy[at]], "d": []}[kind]
        out.append(copy)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("width,least", [(14, 0.9), (17, 0.8)])
def test_most_similar_lines_meet(width, least):
    """Recall against all pairs, without blocks, at the block widths of some 500,000 and 4 million lines."""
    rnd = random.Random(8)
    lines = [x for n in range(10, 100) for x in line_variants(rnd, n)]
    names = sorted({f for t in lines for _, f in forms_of(t)})
    sig = signatures(names, width)
    near = [(a, b) for a, b in itertools.combinations(names, 2) if abs(a.count(" ") - b.count(" ")) < 12 and similar_lines(a, b)]
    met = set(line_links(names, sig, width))
    assert len(near) > 300 and sum(p in met for p in near) >= least * len(near)


def test_links_do_not_depend_on_other_lines(spark, monkeypatch):
    """The links of some lines are those of the rule, alone as well as among a hundred times as many bytes."""
    monkeypatch.setattr(line_dedup, "LINE", 1)
    rnd = random.Random(9)
    own = [x for n in range(10, 60) for x in line_variants(rnd, n)]
    other = "\n".join(" ".join(f"w{rnd.randrange(10**9)}" for _ in range(40)) for _ in range(8000))
    names = sorted({f for t in own for _, f in forms_of(t)})
    want = lines_to_drop(own, list(line_links(names, signatures(names, line_dedup.WIDTH), line_dedup.WIDTH)))
    for texts in (own, own + [other]):
        got = {(r.doc_id, r.line) for r in line_dedup.repeated_lines(frame(spark, texts), Store(spark, "t")).collect()}
        assert got == want and len(want) > 100


def test_length_classes_keep_similar_lines():
    n = np.arange(1, 3000)
    kind = line_dedup.length_class(n).astype(int)
    for m in n:
        least = int(-(-9 * m // 10)) if m > line_dedup.SHORT else 1
        assert kind[m - 1] - kind[least - 1] <= 1


def test_short_lines_and_typos(spark):
    texts = ["Subscribe to our newsletter today", "Subscribe to our newsleter today", "subscribe to our newsletter, today!!", "Go", "Ga", "something else here"]
    out = rows_by_id(line_dedup.dedup_lines(frame(spark, texts)))
    assert [out[i].text for i in range(6)] == [texts[0], "", "", "Go", "Ga", texts[5]]


def test_repeated_ids_keep_their_own_lines(spark):
    one, two = "alpha beta gamma delta epsilon zeta", "some other line that stands alone here"
    rows = [(1, one + "\n" + two), (2, one), (2, "not " + two + " at all, it is new"), (None, one), (3, one), (3, one)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0, r.text, r.n_removed) for r in out)) == sorted(
        [(0, one, 0), (1, rows[0][1], 0), (2, "", 1), (2, rows[2][1], 0), (3, "", 1), (3, "", 1)])


def test_crowded_buckets(spark, monkeypatch):
    """Buckets of hundreds of like lines that pivots do not join at once lose no link."""
    monkeypatch.setattr(line_dedup, "CROWD", 8)
    monkeypatch.setattr(line_dedup, "CHUNK", 50)
    rnd = random.Random(2)
    base, texts = words(rnd, 40), []
    for i in range(160):
        own = list(base)
        for _ in range(rnd.randrange(0, 4)):
            own[rnd.randrange(40)] = f"n{rnd.randrange(10**6)}"
        texts.append(" ".join(own))
    docs = frame(spark, texts)
    names = sorted({f for t in texts for _, f in forms_of(t)})
    width = line_dedup.block_bits(sum(len(t) for t in texts))
    want = lines_to_drop(texts, list(line_links(names, signatures(names, width), width)))
    got = {(r.doc_id, r.line) for r in line_dedup.repeated_lines(docs, Store(spark, "t")).collect()}
    assert got >= want and len(want) > 80
    links = [(a, b) for a, b in itertools.combinations(names, 2) if similar_lines(a, b)]
    assert got <= lines_to_drop(texts, links)


def test_large_buckets_are_paired_in_cells(spark):
    """One bucket of 300 ids in which only every 50th differs from the rest: pivots find nothing more, cells do."""
    from veilscan.llm.linkage import linked
    members = spark.range(300).selectExpr("1L AS key", "id").repartition(4)
    payload = spark.range(300).selectExpr("id", "id % 50 AS g")
    got = linked(Store(spark, "t"), members, payload, lambda a, b: a("g") == b("g"), lambda pairs: pairs.select("a", "b"), pivot_rounds=0)
    assert {r.id: r.component for r in got.collect()} == {i: i % 50 for i in range(300)}


def test_rows_of_large_buckets_grow_with_their_members(spark):
    """Cells of fixed size repeated each member of a bucket n / 64 times; all pairs of a bucket still meet."""
    from veilscan.llm.linkage import CELL, PARTS, cells
    full = spark.range(20 * CELL).selectExpr("1L AS key", "id", "id AS component")
    x, y = cells(full, [])
    assert x.count() + y.count() <= 20 * CELL * (PARTS + 1)
    few = spark.range(CELL + 50).selectExpr("1L AS key", "id", "id AS component")
    x, y = cells(few, [])
    met = x.join(y, ["key", "lo", "hi"]).filter("lo < hi OR a < b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b")
    assert met.distinct().count() == met.count() == (CELL + 50) * (CELL + 49) // 2


def test_components_after_further_links(spark):
    from veilscan.llm.linkage import merged
    rng = random.Random(8)
    store, labels, links = Store(spark, "t"), None, []
    for _ in range(3):
        new = [(rng.randrange(60), rng.randrange(60)) for _ in range(12)]
        links += new
        labels = merged(store, labels, spark.createDataFrame(new, "a long, b long"))
        want = {r.id: r.component for r in components(Store(spark, "t"), spark.createDataFrame(links, "a long, b long")).collect()}
        got = labels.collect()
        assert len(got) == len(want) and {r.id: r.component for r in got} == want


def test_odd_sketches_part_no_similar_lines():
    """Sketches differ in two bits an edit and one at most; lines of one repeated word in other numbers differ in many."""
    from veilscan.llm.textbytes import ALNUM, word_bounds, word_hashes

    def sketch(words):
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        starts, ends = word_bounds(data, np.array([0, len(data)]), ALNUM)
        return line_dedup.odd_sketches(word_hashes(data, starts, ends), np.array([len(starts)]))[0].view(np.uint64)

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)]
    for _ in range(600):
        x = [rng.choice(vocabulary) for _ in range(rng.randint(9, 80))]
        y = list(x)
        for _ in range(rng.randint(1, 8)):
            at, kind = rng.randrange(len(y)), rng.randrange(4)
            if kind == 3:  # one end loses what the other gets
                y = y[1:] + [rng.choice(vocabulary)] if at % 2 else [rng.choice(vocabulary)] + y[:-1]
            elif kind != 1 or len(y) > 1:
                y[at:at + (kind != 0)] = [] if kind == 1 else [rng.choice(vocabulary)]
        assert int(np.bitwise_count(sketch(x) ^ sketch(y)).sum()) <= 2 * line_dedup.edit_distance(x, y) + 1
    a, b = ["onhe", "is"] * 300, ["onhe", "is"] * 200 + ["at"] * 200
    assert int(np.bitwise_count(sketch(a) ^ sketch(b)).sum()) > 2 * 60 + 1


def test_candidate_lines_that_edits_cannot_explain(spark, monkeypatch):
    """Lines of one word pair and ever other ends meet, and were all compared word by word."""
    rng = random.Random(3)
    texts = [(i, " ".join(["onhe", "is"] * 150 + [f"v{rng.randrange(10**6)}" for _ in range(50)])) for i in range(30)]
    seen = []
    linked = line_dedup.linked

    def watched(store, members, payload, near, confirm, *more):
        def counted(pairs):
            seen.append(pairs.count())
            return confirm(pairs)
        return linked(store, members, payload, near, counted, *more)

    monkeypatch.setattr(line_dedup, "linked", watched)
    out = line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in out.collect()} == dict(texts)
    assert sum(seen) == 0


def test_lines_of_nothing(spark):
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]
    rnd = random.Random(6)
    for _ in range(500):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(12))) for _ in range(2))
        assert line_dedup.edit_distance(a, b) == plain(a, b)


# byte strings

def joined(strings, rnd):
    n = len(strings)
    seps = rnd.sample(range(1, n), n - 1) + [0]
    return np.concatenate([np.append(np.frombuffer(s, np.uint8).astype(np.int32) + n, seps[j]) for j, s in enumerate(strings)]).astype(np.int32), n


@pytest.mark.parametrize("seed", range(60))
def test_induced_sort(seed):
    rnd, cap = random.Random(seed), 12
    letters = rnd.choice(["a", "ab", "abc", "abcdefgh"])
    base = "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 40)))
    strings = []
    for _ in range(rnd.randrange(1, 7)):
        i = rnd.randrange(len(base))
        tail = "".join(rnd.choice(letters) for _ in range(rnd.randrange(10)))
        strings.append((base[i:i + rnd.randrange(30)] + tail + rnd.choice(["", "zzzzzzzzz", "ab" * 12])).encode())
    x, n = joined(strings, rnd)
    plain = x.tolist()

    def shared(p, q):
        k = 0
        while p + k < len(plain) and q + k < len(plain) and plain[p + k] == plain[q + k] and k < cap:
            k += 1
        return k
    scratch = induced_sort.Scratch(in_memory=rnd.choice([0, 1 << 20]))
    order, values = induced_sort.suffixes_with_prefixes(
        x, cap, lambda a, b: np.array([shared(p, q) for p, q in zip(a, b)], np.uint8), n, scratch,
        buffer=rnd.choice([3, 1000]), batch=rnd.choice([2, 5, 1000]))
    scratch.close()
    want = sorted(range(len(plain)), key=lambda i: plain[i:])
    assert order.tolist() == want
    assert values.tolist() == [0, *[shared(a, b) for a, b in zip(want, want[1:])]]


def assert_regions_cover(monkeypatch):
    """Every start is in one region, also where a long text is cut."""
    text = " ".join(words(random.Random(9), 700))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([5]), "th": pa.array([9]), "text": pa.array([text])})
    for starts in (1000, 1 << 22):
        with monkeypatch.context() as m:
            m.setattr(suffix_dedup, "STARTS", starts)
            rows = pa.Table.from_batches(list(suffix_dedup._region_rows([batch]))).to_pylist()
        covered = [p for r in rows for p in range(r["first"], r["first"] + r["n"])]
        assert covered == list(range(len(text) - 199))


def brute_removed(texts):
    seen = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - 199):
            seen.setdefault(t[p:p + 200], []).append((i, p))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 199):
            if len(seen[t[p:p + 200]]) > 1:
                gone[p:p + 200] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("split", [512, 1])
def test_repeats_removed(spark, split, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    assert_regions_cover(monkeypatch)
    rnd = random.Random(7)
    bases = [" ".join(words(rnd, n, 50)) for n in (30, 80, 150, 400)]
    texts = []
    for i in range(24):
        b = rnd.choice(bases)
        lo = rnd.randrange(len(b) // 2)
        texts.append(" ".join(words(rnd, rnd.randrange(40))) + b[lo:lo + rnd.randrange(80, 900)]
                     + "be " * rnd.choice([0, 0, 60, 150]) + "é" * rnd.choice([0, 150]) + " ".join(words(rnd, rnd.randrange(40))))
    texts += ["a" * 300, "b" * 199, "c" * 200, "d" * 201, *ODD]
    raw = [(t or "").encode() for t in texts]
    got = rows_by_id(suffix_dedup.remove_repeats(frame(spark, texts)))
    assert len(got) == len(texts)
    for i, gone in enumerate(brute_removed(raw)):
        left = np.frombuffer(raw[i], np.uint8)[~gone].tobytes()
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(gone) else 0
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw[i]), int(gone.sum()), runs)
        assert bytes(r.kept) == left and r.kept_sha256 == hashlib.sha256(left).hexdigest()


def test_repeated_ids_keep_their_own_bytes(spark):
    long = " ".join(words(random.Random(1), 90))
    rows = [(1, long), (1, "short"), (2, long[50:] + "end"), (3, "x" + long[:150]), (4, long[:250]), (4, long[:250]), (None, long)]
    got = sorted((r.doc_id, bytes(r.kept).decode(), r.n_bytes) for r in
                 suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    gone = brute_removed([t.encode() for i, t in rows if i])
    want = sorted((i, np.frombuffer(t.encode(), np.uint8)[~g].tobytes().decode(), len(t)) for (i, t), g in zip(rows, gone))
    assert got == want and (1, "short", 5) in got


def test_equal_pieces_are_sorted_once(spark, monkeypatch):
    """Texts of one word pair are cut every few bytes, into pieces of 200 bytes and more that are nearly all equal."""
    rnd = random.Random(11)
    texts = ["onhe is " * rnd.randrange(150, 250) + " ".join(words(rnd, 40)) for _ in range(40)]
    sizes = []
    save = suffix_dedup.Store.save

    def watched(self, df, name, *more):
        out = save(self, df, name, *more)
        if name == "pieces":
            sizes.append(sum(len(r[0] or b"") for r in out.select("bytes").collect()))
        return out
    monkeypatch.setattr(suffix_dedup, "SPLIT", 1)
    monkeypatch.setattr(suffix_dedup.Store, "save", watched)
    got = rows_by_id(suffix_dedup.remove_repeats(frame(spark, texts)))
    for i, gone in enumerate(brute_removed([t.encode() for t in texts])):
        assert bytes(got[i].kept) == np.frombuffer(texts[i].encode(), np.uint8)[~gone].tobytes()
    assert len(sizes) == 1 and sizes[0] < 2 * sum(map(len, texts))


def test_scratch_disk_goes_with_its_array():
    scratch = induced_sort.Scratch(in_memory=0)
    a, f = scratch.array(1000, np.int64), scratch.file()
    a[:] = 7
    f.write(b"x" * 1000)
    assert os.listdir(scratch._dir.name) == [] and (a == 7).all()
    f.close()
    scratch.close()


def test_repeats_of_nothing(spark):
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0
