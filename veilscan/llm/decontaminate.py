"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` stores the postings of every token of the training texts: a row
per (block, term) with the places of the term among the block's words. A block
holds whole documents of about ``BLOCK_BYTES`` of text, so a posting list is
bounded by a block however frequent its term. ``search`` takes the windows of
the test texts: the rarest term of a window (by corpus frequency) finds the
blocks where it may stand, and in each block the posting lists are intersected
after their offsets are taken off, rarest first, all windows of a block at once.
Windows travel only to blocks that hold their rarest term; nothing is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import Store
from .textbytes import ALNUM, slice_words, text_slices

BLOCK_BYTES = 4 << 20
WINDOW_WORDS = 10
#: Candidate places looked at together in one task.
CANDIDATES = 1 << 20

INDEX = "block long, term long, n long, places binary, doc_ids array<long>, doc_starts array<long>"


def _block_rows(block: int, ids: list, words: np.ndarray, starts: np.ndarray):
    """The rows of one block: its header (term null, the documents), then a row per term."""
    order = np.argsort(words, kind="stable").astype(np.uint32)
    ranked = words[order]
    at = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate((at, [len(ranked)])))
    n = len(at)
    bounds = (np.concatenate((at, [len(ranked)])) * 4).astype(np.int32)
    places = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(order)])
    header = pa.RecordBatch.from_pydict({
        "block": pa.array([block], pa.int64()), "term": pa.array([None], pa.int64()), "n": pa.array([len(words)], pa.int64()),
        "places": pa.array([b""], pa.binary()), "doc_ids": pa.array([ids], pa.list_(pa.int64())),
        "doc_starts": pa.array([starts.tolist()], pa.list_(pa.int64()))})
    yield header
    step = 1 << 15
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(np.full(hi - lo, block, np.int64)), "term": pa.array(ranked[at[lo:hi]].view(np.int64)),
            "n": pa.array(size[lo:hi].astype(np.int64)), "places": places.slice(lo, hi - lo),
            "doc_ids": pa.nulls(hi - lo, pa.list_(pa.int64())), "doc_starts": pa.nulls(hi - lo, pa.list_(pa.int64()))})


def _index_rows(batches):
    block = TaskContext.get().partitionId() << 32
    ids, words, starts, n_words, n_bytes = [], [], [], 0, 0
    for rows, data, offsets in text_slices(batches):
        w, bounds = slice_words(data, offsets, ALNUM)
        ids += rows.column("doc_id").to_pylist()
        starts.append(bounds[:-1] + n_words)
        words.append(w)
        n_words += len(w)
        n_bytes += len(data)
        if n_bytes >= BLOCK_BYTES or len(ids) >= 1 << 16:
            yield from _block_rows(block, ids, np.concatenate(words), np.concatenate(starts))
            block += 1
            ids, words, starts, n_words, n_bytes = [], [], [], 0, 0
    if ids:
        yield from _block_rows(block, ids, np.concatenate(words), np.concatenate(starts))


def build_index(docs: DataFrame, store: Store, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written index of all tokens of all texts (A-Z lower-cased; null text: no tokens)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return store.save(texts.mapInArrow(_index_rows, INDEX), "index")


def _window_rows(batches):
    for rows, data, offsets in text_slices(batches):
        words, bounds = slice_words(data, offsets, ALNUM)
        words = words.view(np.int64)
        ids, terms = [], []
        for i, item in enumerate(rows.column("item_id").to_pylist()):
            own = words[bounds[i]:bounds[i + 1]]
            k = min(WINDOW_WORDS, len(own))
            for lo in range(len(own) - k + 1 if k else 0):
                ids.append(item)
                terms.append(own[lo:lo + k])
        yield pa.RecordBatch.from_pydict({"item_id": pa.array(ids, pa.int64()), "terms": pa.array(terms, pa.list_(pa.int64()))})


def test_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, terms): the windows of ten words of each test text; a shorter text is one window."""
    texts = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_window_rows, "item_id long, terms array<long>").distinct()


def _intersect(slack: int | None):
    found = pa.schema([("doc_id", pa.int64()), ("window", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("kind", pa.string())])

    def run(index: pa.Table, windows: pa.Table) -> pa.Table:
        head = index.filter(pa.compute.is_null(index.column("term")))
        rows = index.filter(pa.compute.is_valid(index.column("term")))
        if not windows.num_rows or not rows.num_rows:
            return found.empty_table()
        doc_ids = np.array(head.column("doc_ids")[0].as_py(), dtype=object)
        doc_at = np.array(head.column("doc_starts")[0].as_py(), np.int64)
        n_words = head.column("n")[0].as_py()
        terms = np.asarray(rows.column("term"))
        order = np.argsort(terms)
        terms = terms[order]
        lists = rows.column("places").to_pylist()
        # all postings of the block in one sorted array, the term's rank above the place
        sizes = np.array([len(lists[i]) // 4 for i in order])
        begin = np.concatenate(([0], np.cumsum(sizes)))
        places = np.concatenate([np.frombuffer(lists[i], np.uint32) for i in order]).astype(np.int64)
        posted = places + (np.repeat(np.arange(len(terms), dtype=np.int64), sizes) << 32)

        def there(rank: np.ndarray, place: np.ndarray) -> np.ndarray:
            key = (rank << 32) + place
            at = np.minimum(np.searchsorted(posted, key), len(posted) - 1)
            return (posted[at] == key) & (place >= 0)

        def near(rank: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            at = np.searchsorted(posted, (rank << 32) + np.maximum(lo, 0))
            return (at < len(posted)) & (posted[np.minimum(at, len(posted) - 1)] <= (rank << 32) + hi)

        names = np.asarray(windows.column("window"))
        flat = windows.column("terms").combine_chunks().flatten()
        lengths = np.asarray(pa.compute.list_value_length(windows.column("terms")).cast(pa.int64()))
        w_at = np.concatenate(([0], np.cumsum(lengths)))
        w_term, w_off = np.asarray(flat.field("term")), np.asarray(flat.field("offset")).astype(np.int64)
        w_rank = np.minimum(np.searchsorted(terms, w_term), len(terms) - 1)
        all_here = np.logical_and.reduceat(terms[w_rank] == w_term, w_at[:-1])
        live = np.flatnonzero(all_here)
        first = w_rank[w_at[:-1]]
        out: list[tuple] = []
        lo = 0
        cost = np.cumsum(sizes[first[live]])
        while lo < len(live):
            done = cost[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(cost, done + CANDIDATES, "right")))
            some = live[lo:hi]
            lo = hi
            each = sizes[first[some]]
            win = np.repeat(some, each)
            pick = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(begin[first[some]], each)
            anchor = places[pick]
            start = anchor - w_off[w_at[win]]
            keep = np.ones(len(win), bool)
            doc_first = np.searchsorted(doc_at, anchor, "right") - 1
            end_of = np.concatenate((doc_at[1:], [n_words]))[doc_first]
            keep &= (start >= doc_at[doc_first]) & (start + lengths[win] <= end_of)
            phrase, k = np.flatnonzero(keep), 1
            while len(phrase) and k < lengths.max():
                more = lengths[win[phrase]] > k
                at = w_at[win[phrase]] + np.where(more, k, 0)
                phrase = phrase[~more | there(w_rank[at], start[phrase] + w_off[at])]
                k += 1
            out.append((win[phrase], start[phrase], doc_first[phrase], "phrase"))
            if slack is not None:
                close, k = np.arange(len(win)), 1
                while len(close) and k < lengths.max():
                    more = lengths[win[close]] > k
                    at = w_at[win[close]] + np.where(more, k, 0)
                    reach = lengths[win[close]] - 1 + slack
                    d = doc_first[close]
                    ok = near(w_rank[at], np.maximum(anchor[close] - reach, doc_at[d]), np.minimum(anchor[close] + reach, end_of[close] - 1))
                    close = close[~more | ok]
                    k += 1
                out.append((win[close], anchor[close], doc_first[close], "near"))
        tables = [pa.table({"doc_id": pa.array(doc_ids[d].tolist(), pa.int64()), "window": pa.array(names[w]),
                            "start": pa.array(s - doc_at[d]), "length": pa.array(lengths[w]),
                            "kind": pa.array([kind] * len(w), pa.string())}, schema=found) for w, s, d, kind in out]
        return pa.concat_tables(tables) if tables else found.empty_table()
    return run


def search(index: DataFrame, windows: DataFrame, store: Store, slack: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All places of the windows: (doc_id, window, start, length, kind), and the windows with their items.

    kind ``phrase``: the window's words stand at start, start + 1, ... kind
    ``near`` (only with ``slack``): start is a place of the window's rarest
    term, and every other term stands within ``length - 1 + slack`` words of it
    in the same document, in any order.
    """
    named = store.save(windows.groupBy("terms").agg(F.collect_set("item_id").alias("items"))
                       .withColumn("window", F.monotonically_increasing_id()), "windows")
    parts = named.select("window", F.size("terms").alias("k"), F.posexplode("terms").alias("offset", "term"))
    vocabulary = parts.select("term").distinct()
    wanted = store.save(index.join(vocabulary, "term", "left_semi"), "wanted")
    frequency = wanted.groupBy("term").agg(F.sum("n").alias("freq"))
    ranked = (parts.join(frequency, "term").groupBy("window", "k")
              .agg(F.sort_array(F.collect_list(F.struct("freq", "term", "offset"))).alias("terms"))
              .filter("size(terms) = k").select("window", "terms", F.col("terms")[0]["term"].alias("term")))
    tasks = (wanted.select("block", "term").join(ranked, "term").select(F.col("block").alias("at"), "window", "terms"))
    heads = index.filter("term IS NULL")
    here = wanted.unionByName(heads.join(wanted.select("block").distinct(), "block", "left_semi").select(wanted.columns))
    found = (here.select("block", "term", "n", "places", "doc_ids", "doc_starts").groupBy("block")
             .cogroup(tasks.groupBy("at"))
             .applyInArrow(_intersect(slack), "doc_id long, window long, start long, length long, kind string"))
    return store.save(found, "found"), named


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: words, words inside a test window, the test items with windows in it.

    Documents need unique doc_id (null ids are left out) and text; items need
    item_id and text. Null and wordless texts have no words: such an item
    matches nothing, such a document has zero counts. Repeated items count as
    one per item_id; an empty item table leaves all documents clean, an empty
    document table gives no rows. Other columns are not read.
    """
    store = Store(docs.sparkSession, "decontaminate")
    index = build_index(docs.filter("doc_id IS NOT NULL"), store)
    found, named = search(index, test_windows(items.filter("item_id IS NOT NULL")), store)
    by_start = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    places = found.select("doc_id", "start", (F.col("start") + F.col("length")).alias("end")).groupBy("doc_id", "start").agg(F.max("end").alias("end"))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(by_start), F.lit(0))))
    hit = places.select("doc_id", fresh.alias("fresh")).groupBy("doc_id").agg(F.sum("fresh").alias("n_hit"))
    which = (found.select("doc_id", "window").distinct().join(named.select("window", F.explode("items").alias("item")), "window")
             .select("doc_id", F.col("item").cast("string").alias("item")).distinct()
             .groupBy("doc_id").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list("item")).alias("items")))
    heads = index.filter("term IS NULL").select(
        "n", F.explode(F.arrays_zip("doc_ids", "doc_starts", F.expr("slice(doc_starts, 2, size(doc_starts))").alias("next"))).alias("d"))
    size = heads.select(F.col("d.doc_ids").alias("doc_id"), (F.coalesce("d.next", "n") - F.col("d.doc_starts")).alias("n_words"))
    out = size.join(hit, "doc_id", "left").join(which, "doc_id", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                      F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
                      (n_hit > 0).alias("contaminated"))
