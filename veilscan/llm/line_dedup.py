"""Fuzzy line dedup: SimHash of normalised lines, joined on pigeonhole blocks, edit check, one line per group stays.

A line's normal form is its words (ASCII letters lower-cased, digits, all
multi-byte characters) joined by blanks; equal normal forms are one node, so a
boilerplate line in a third of the documents enters the search once.

1. One pass over all texts gives every line a SimHash of its words; short words
   weigh less, or all lines of one language would look alike. Lines of up to
   ``SHORT`` words have one of their letter triples instead, so that a typo
   changes little.
2. The SimHash is cut into ``BLOCKS`` blocks of ``WIDTH`` bits. Two lines meet
   where a block is equal, few of the ``CHECK`` bits next to it and of all bits
   differ, and their numbers of words allow the similarity. Whether two lines
   meet depends on them alone, never on the other lines or on how many there
   are. Entries are dealt by block value as packed arrays, sorted and compared
   there; lines that meet none are left out, the rest goes on as (bucket, line) rows.
3. `linkage` holds them against pivots; pairs whose words differ in more than so
   many edits can explain, by their odd sketches, are no candidates (this excludes
   no similar pair). The edit similarity decides: at most
   10 % of the words (of a line's letters, up to ``SHORT`` words) inserted, lost
   or replaced. Every node is then in one connected group, whose occurrence with
   the smallest (doc_id, line) stays.

Texts are never shuffled but for documents that lose a line: normal forms of the
lines that met come from a second pass, behind a bitmap of fixed size.
"""

from __future__ import annotations

import math
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import Bitmap, is_set
from .linkage import linked
from .store import Store
from .textbytes import _PLACE, ALNUM, LOWER, mix, text_slices, word_bounds, word_hashes

MIN_SIMILARITY = 0.9
#: Up to so many words the letters are compared, beyond it the words.
SHORT = 8
BLOCKS = 14
#: Bits of a block, for any number of lines: 7 in a hundred similar pairs or fewer share none (README).
WIDTH = 16
#: 64-bit words of a SimHash.
SIZE = -(-BLOCKS * WIDTH // 64)
#: Lines of a part of the block values on average, about a million entries.
LINE = 70_000
#: Bits beside a block that are compared at once, and in how many of them a pair may differ.
CHECK, CHECK_FLIPS = 48, 11
#: Part of all bits in which a pair may differ.
FLIPS = 0.2
#: 64-bit words of the odd sketch of a line's words.
ODD = 16
#: Weight of a word by its bytes, the last for all longer ones: the words that all lines of a language share are short.
WEIGHTS = np.array([1, 1, 1, 2, 5, 8], np.int16)
#: Lines of a task that are cut into blocks at a time, and entries of one bucket among them that go on as packed arrays.
CHUNK, CROWD = 100_000, 64
#: Entries of a bucket that are compared in one task; a larger bucket goes on whole, and the join compares its members.
COMPARED = 8192


def block_bits(n_bytes: int) -> int:
    """Bits of a block in texts of so many bytes: ``WIDTH``, or two lines would be alike in one table and not in another."""
    return WIDTH


def length_class(n):
    """What the numbers of words of similar lines have in common, rising by one at most between them; 0 up to ``SHORT`` words.

    ``n`` words and ``m`` more of at most a tenth of ``n + m`` are within a factor of 10 / 9.
    """
    return np.where(n <= SHORT, 0, 1 + np.floor(np.log(np.maximum(n, SHORT + 1) / (SHORT + 1)) / math.log(10 / 9) + 1e-9)).astype(np.uint8)


def _line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all lines of a slice, and the index of each document's first line."""
    breaks = np.flatnonzero(data == 10) + 1
    starts = np.sort(np.concatenate((offsets[:-1], breaks)), kind="stable")
    # a break that ends a text and the next text's start are two lines at one place
    first = np.arange(len(offsets) - 1) + np.searchsorted(breaks, offsets[:-1], "right")
    return starts, first


def _lines_of(data: np.ndarray, offsets: np.ndarray):
    """Of the lines with a word: number in the slice, word hashes, bounds, key of the normal form; first line per text; word starts and ends."""
    starts, ends = word_bounds(data, offsets, ALNUM)
    line_at, first = _line_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    at = np.searchsorted(starts, line_at)
    lines = np.flatnonzero(np.diff(at, append=len(starts)))
    at = at[lines]
    if not len(lines):
        return None
    bounds = np.concatenate((at, [len(words)]))
    n = np.diff(bounds)
    place = np.arange(len(words)) - np.repeat(at, n)
    key = mix(np.add.reduceat(mix(words + place.astype(np.uint64) * _PLACE[0]), at) + n.astype(np.uint64))
    return lines, words, bounds, key, first, starts, ends


def _normal(data: np.ndarray, start: int, end: int) -> bytes:
    part = data[start:end]
    clean = LOWER[part]
    clean[~ALNUM[part]] = 32
    return b" ".join(clean.tobytes().split())


def triples(form: bytes) -> np.ndarray:
    """Hashes of the three-byte strings of a normal form with a blank at either end."""
    b = np.frombuffer(b" " + form + b" ", np.uint8).astype(np.uint64)
    return mix((b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]) * _PLACE[5] + _PLACE[6])


def simhash(features: np.ndarray, bounds: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each line (none may be empty) in ``size`` 64-bit words; bit j is bit j % 64 of word j // 64.

    A bit is set where the features that have it weigh more than half of all.
    """
    n = np.diff(bounds)
    totals = np.zeros((len(n), 64 * size), np.int32)
    # pieces of a line of so few features that their weights add up in a byte
    most = 255 // int(weights.max(initial=1))
    k = -(-n // most)
    line = np.repeat(np.arange(len(n)), k)
    at = bounds[:-1][line] + most * (np.arange(len(line)) - np.repeat(np.cumsum(k) - k, k))
    for lo in range(0, len(at), 128):
        cut, own = at[lo:lo + 128], line[lo:lo + 128]
        a, b = cut[0], at[lo + 128] if lo + 128 < len(at) else bounds[-1]
        signs = np.empty((b - a, size), np.uint64)
        for j in range(size):
            signs[:, j] = mix(features[a:b] + np.uint64((j + 1) * int(_PLACE[7]) % 2**64))
        # a byte a bit, eight of them added as one word
        bits = np.unpackbits(signs.view(np.uint8), axis=1, bitorder="little").view(np.uint64)
        bits *= weights[a:b, None].astype(np.uint64)
        sums = np.add.reduceat(bits, cut - a, axis=0).view(np.uint8).astype(np.uint16)
        new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        totals[own[new]] += np.add.reduceat(sums.view(np.uint64), new, axis=0).view(np.uint16)
    half = np.add.reduceat(weights.astype(np.int64), bounds[:-1]) / 2 if len(totals) else np.zeros(0)
    return np.packbits(totals > half[:, None], axis=1, bitorder="little").view(np.uint64)


def bit_range(sig: np.ndarray, start: int, n: int) -> np.ndarray:
    """Bits ``start`` to ``start + n`` (n < 64) of each SimHash, around its end."""
    words = sig.shape[1]
    i, off = divmod(start % (64 * words), 64)
    out = sig[:, i] >> np.uint64(off)
    if off + n > 64:
        out = out | sig[:, (i + 1) % words] << np.uint64(64 - off)
    return out & np.uint64((1 << n) - 1)


def line_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray,
                  bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, weights and bounds per line: its words, or the letter triples of up to SHORT words."""
    n = np.diff(bounds)
    parts, part_weights, sizes = [], [], n.copy()
    kind = WEIGHTS[np.minimum(ends - starts, len(WEIGHTS) - 1)]
    last = 0
    for i in np.flatnonzero(n <= SHORT):
        own = triples(_normal(data, starts[bounds[i]], ends[bounds[i + 1] - 1]))
        parts += [words[last:bounds[i]], own]
        part_weights += [kind[last:bounds[i]], np.full(len(own), WEIGHTS[-1])]
        last, sizes[i] = bounds[i + 1], len(own)
    parts.append(words[last:])
    part_weights.append(kind[last:])
    return np.concatenate(parts), np.concatenate(part_weights), np.concatenate(([0], np.cumsum(sizes)))


def _simhashes(data, words, bounds, starts, ends, once):
    """SimHashes of the lines ``once``, and the places and numbers of their words."""
    n = np.diff(bounds)[once]
    at = np.repeat(bounds[once] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    features, kind, cuts = line_features(data, starts[at], ends[at], words[at], np.concatenate(([0], np.cumsum(n))))
    return simhash(features, cuts, kind, SIZE), at, n


def _line_table():
    def run(batches):
        for rows, data, offsets in text_slices(batches):
            found = _lines_of(data, offsets)
            if not found:
                continue
            lines, words, bounds, key, first, starts, ends = found
            doc = np.searchsorted(first, lines, "right") - 1
            # a line that stands twice in the slice needs one SimHash
            _, once = np.unique(key, return_index=True)
            once.sort()
            sig = _simhashes(data, words, bounds, starts, ends, once)[0]
            at = np.full(len(lines) + 1, 0)
            at[once + 1] = 8 * SIZE
            yield pa.RecordBatch.from_pydict({
                "doc_id": rows.column("doc_id").take(pa.array(doc)), "th": rows.column("th").take(pa.array(doc)),
                "line": pa.array((lines - first[doc]).astype(np.int64)), "key": pa.array(key.view(np.int64)), "n": pa.array(np.diff(bounds).astype(np.int32)),
                "sig": pa.Array.from_buffers(pa.binary(), len(lines), [
                    pa.py_buffer(np.packbits(at[1:] > 0, bitorder="little")), pa.py_buffer(np.cumsum(at).astype(np.int32)), pa.py_buffer(sig)])})
    return run


def _entries(batches):
    """Per chunk of lines: bucket codes, SimHash check bits (above them the length class) and keys of all blocks, by bucket and key."""
    def cut(table):
        width, key = WIDTH, table.column("key").to_numpy().view(np.uint64)
        kind = length_class(table.column("n").to_numpy()).astype(np.uint64) << np.uint64(CHECK)
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint64).reshape(len(key), -1)
        code = np.concatenate([bit_range(sig, k * width, width) | np.uint64(k << width) for k in range(BLOCKS)])
        check = np.concatenate([bit_range(sig, (k + 1) * width, CHECK) | kind for k in range(BLOCKS)])
        code = scatter(code, width)
        key = np.tile(key, BLOCKS)
        # by code and most bits of the key: one left twice costs time only
        order = np.argsort(code << np.uint64(64 - code_bits(width)) | key >> np.uint64(code_bits(width)))
        code, check, key = code[order], check[order], key[order]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (key[1:] != key[:-1])
        return code[new], check[new], key[new]

    waiting, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            rows += batch.num_rows
        if rows >= CHUNK:
            yield cut(pa.Table.from_batches(waiting))
            waiting, rows = [], 0
    if rows:
        yield cut(pa.Table.from_batches(waiting))


def code_bits(width: int) -> int:
    return width + (BLOCKS - 1).bit_length()


def scatter(code: np.ndarray, width: int) -> np.ndarray:
    """A permutation of all block values that spreads them evenly."""
    bits = code_bits(width)
    mask = np.uint64((1 << bits) - 1)
    code = (code * np.uint64(0x9E3779B97F4A7C15)) & mask
    return ((code ^ code >> np.uint64(bits // 2)) * np.uint64(0xBF58476D1CE4E5B9)) & mask


def _runs(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate((np.ones(min(len(code), 1), bool), code[1:] != code[:-1])))
    return first, np.diff(np.append(first, len(code)))


def _crowded(code: np.ndarray) -> np.ndarray:
    """Entries of a bucket beyond the first CROWD + 1."""
    first, n = _runs(code)
    return np.arange(len(code)) - np.repeat(first, n) > CROWD


def _packed(parts_bits: int):
    """Packed entries per part of the codes, at most CROWD + 1 of a bucket and chunk.

    The rest of a crowded bucket goes on whatever it meets: dealt out by line,
    with its code, so that no part holds a hot bucket.
    """
    low = np.uint64(code_bits(WIDTH) - parts_bits)

    def run(batches):
        for code, check, key in _entries(batches):
            many = _crowded(code)
            parts, blobs = [], []
            if many.any():
                place = mix(key[many]) & np.uint64((1 << parts_bits) - 1)
                order = np.argsort(place, kind="stable")
                place, pair = place[order], np.stack((code[many], key[many]), axis=1)[order]
                cut = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
                for lo, hi in zip(cut, np.append(cut[1:], len(place))):
                    parts.append(int(place[lo]))
                    blobs.append(b"\2" + pair[lo:hi].tobytes())
            code, check, key = code[~many], check[~many], key[~many]
            part, n = np.unique(code >> low, return_counts=True)
            parts += part.tolist()
            ends = np.cumsum(n)
            for lo, hi in zip(ends - n, ends):
                checks = check[lo:hi].view(np.uint8).reshape(-1, 8)[:, :CHECK // 8 + 1]
                rest = (code[lo:hi] & np.uint64((1 << int(low)) - 1)).astype(np.uint32)
                step = np.diff(rest, prepend=np.uint32(0))
                short = bool(step.max() < 1 << 16)
                blobs.append(bytes([short]) + np.int64(hi - lo).tobytes() + (step.astype(np.uint16) if short else step).tobytes()
                             + key[lo:hi].tobytes() + checks.tobytes())
            yield pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.int64()), "packed": pa.array(blobs, pa.binary())})
    return run


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1, 1)[0])
    kind = np.uint16 if blob[0] else np.uint32
    at = 9 + n * np.dtype(kind).itemsize
    rest = np.cumsum(np.frombuffer(blob, kind, n, 9), dtype=np.uint64)
    check = np.zeros((n, 8), np.uint8)
    check[:, :CHECK // 8 + 1] = np.frombuffer(blob, np.uint8, n * (CHECK // 8 + 1), at + 8 * n).reshape(n, -1)
    return rest, np.frombuffer(blob, np.uint64, n, at), check.view(np.uint64).ravel()


def _met(parts_bits: int):
    """(bucket, line) of the entries that meet another one in their bucket, and of all in a crowded one.

    What goes on without need costs time only: ``_meets`` decides on each pair.
    """
    low, bits = np.uint64(code_bits(WIDTH) - parts_bits), np.uint64((1 << CHECK) - 1)

    def run(table: pa.Table) -> pa.Table:
        part = np.uint64(table.column("part")[0].as_py())
        blobs = table.column("packed").to_pylist()
        crowd = np.frombuffer(b"".join(b[1:] for b in blobs if b[0] == 2), np.uint64).reshape(-1, 2)
        blobs = [b for b in blobs if b[0] != 2]
        if not blobs:
            return pa.table({"key": pa.array(crowd[:, 0].view(np.int64)), "id": pa.array(crowd[:, 1].view(np.int64))})
        parts = [_unpacked(b) for b in blobs]
        # the rest of such a bucket went another way
        cut_off = np.unique(np.concatenate([c[_crowded(c)] for c, _, _ in parts]))
        code, key, check = (np.concatenate(x) for x in zip(*parts))
        # by code, length class (8 bits) and most bits of the key
        top = code_bits(WIDTH)
        order = np.argsort(code << np.uint64(64 - top) | check >> np.uint64(CHECK) << np.uint64(56 - top) | key >> np.uint64(8 + top))
        code, key, check = code[order], key[order], check[order]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (key[1:] != key[:-1])
        code, key, check = code[new], key[new], check[new]
        first, n = _runs(code)
        size = np.repeat(n, n)
        meets = (size > COMPARED) | np.isin(code, cut_off)
        at = np.flatnonzero((size > 1) & ~meets)
        kind, check = (check >> np.uint64(CHECK)).astype(np.int16), check & bits
        for step in range(1, COMPARED):
            at = at[at + step < len(code)]
            at = at[(code[at] == code[at + step]) & (kind[at + step] - kind[at] <= 1)]
            if not len(at):
                break
            near = at[np.bitwise_count(check[at] ^ check[at + step]) <= CHECK_FLIPS]
            meets[near] = True
            meets[near + step] = True
        bucket = np.concatenate((code[meets] | part << low, crowd[:, 0]))
        return pa.table({"key": pa.array(bucket.view(np.int64)), "id": pa.array(np.concatenate((key[meets], crowd[:, 1])).view(np.int64))})
    return run


def odd_sketches(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bitmap of each line in which every word toggles one bit, as int64 words; ``n`` are the numbers of words.

    A word counts with its half of the line and how often it stood there before,
    so that repeated words do not cancel. What two lines share does, so their
    sketches differ in no more bits than these.
    """
    width, line = 64 * ODD, np.repeat(np.arange(len(n)), n)
    place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
    word = mix(words + (place >= np.repeat(n // 2, n)).astype(np.uint64) * _PLACE[9])
    order = np.lexsort((word, line))
    word, line = word[order], line[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(word), 1), bool), (word[1:] != word[:-1]) | (line[1:] != line[:-1]))))
    before = np.arange(len(word)) - np.repeat(first, np.diff(np.append(first, len(word))))
    at = line * width + (mix(word + before.astype(np.uint64) * _PLACE[10]) % np.uint64(width)).astype(np.int64)
    bits = (np.bincount(at, minlength=len(n) * width) & 1).astype(np.uint8).reshape(len(n), width)
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64).reshape(len(n), ODD)


def _normal_lines(bits: np.ndarray):
    def run(batches):
        for _, data, offsets in text_slices(batches):
            found = _lines_of(data, offsets)
            if not found:
                continue
            _, words, bounds, key, _, starts, ends = found
            wanted, once = np.unique(key, return_index=True)
            once = once[is_set(bits, wanted)]
            sig, at, n = _simhashes(data, words, bounds, starts, ends, once)
            odd = odd_sketches(words[at], n)
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(key[once].view(np.int64)), "n_words": pa.array(n.astype(np.int32)),
                **{f"s{k}": pa.array(np.ascontiguousarray(sig[:, k]).view(np.int64)) for k in range(SIZE)},
                "odd": pa.ListArray.from_arrays(pa.array(np.arange(0, odd.size + 1, ODD, dtype=np.int32)), pa.array(odd.ravel())),
                "normal": pa.array([_normal(data, starts[bounds[i]], ends[bounds[i + 1] - 1]) for i in once], pa.binary()).cast(pa.string())})
    return run


def edit_distance(a: list[str] | str, b: list[str] | str) -> int:
    """Levenshtein distance of two sequences, bit-parallel between their common prefix and suffix."""
    low = min(len(a), len(b))
    i = 0
    while i < low and a[i] == b[i]:
        i += 1
    j = 0
    while j < low - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i:len(a) - j], b[i:len(b) - j]
    if not a or not b:
        return len(a) + len(b)
    place: dict[str, int] = {}
    for k, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for c in b:
        eq = place.get(c, 0)
        diag = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(diag | plus)), plus & diag
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(diag | up)), up & diag
    return score


def similar(a: str, b: str) -> bool:
    """Whether at most 10 % of the words of the longer normal form are inserted, lost or replaced, or of its letters up to SHORT words."""
    x, y = a.split(" "), b.split(" ")
    most = max(len(x), len(y))
    allowed = (1 - MIN_SIMILARITY) * most + 1e-9
    # words replaced at their places are as many edits at most
    if len(x) == len(y) and sum(map(ne, x, y)) <= allowed:
        return True
    # each word of one that the other lacks is an edit
    if (len(set(x).difference(y)) <= allowed and len(set(y).difference(x)) <= allowed and edit_distance(x, y) <= allowed):
        return True
    return most <= SHORT and edit_distance(a, b) <= (1 - MIN_SIMILARITY) * max(len(a), len(b)) + 1e-9


def _edit_similar(batches):
    for batch in batches:
        keep = [similar(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _possible(a, b):
    """False only for two lines that cannot be similar, by the odd sketches ``odd`` of their words.

    An edit leaves one word without partner on either side at most. Words change
    from one half to the other only one way, and a word that does needs two
    inserted or lost ones, but the first: two bits an edit and one at most.
    """
    more = F.greatest(a("n_words"), b("n_words"))
    differ = F.aggregate(F.zip_with(a("odd"), b("odd"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)
    return (more <= SHORT) | (differ <= 2 * F.floor(more / 10) + 1)


def _meets(a, b):
    """Whether two lines meet, from the words ``s0``, ``s1``... of their SimHashes and their numbers of words."""
    x = [a(f"s{i}").bitwiseXOR(b(f"s{i}")) for i in range(SIZE)]

    def part(start: int, n: int):
        i, off = divmod(start % (64 * SIZE), 64)
        out = F.shiftrightunsigned(x[i], off)
        if off + n > 64:
            out = out.bitwiseOR(F.shiftleft(x[(i + 1) % SIZE], 64 - off))
        return out.bitwiseAND((1 << n) - 1)

    few = sum(F.bit_count(w) for w in x) <= int(FLIPS * 64 * SIZE)
    less, more = F.least(a("n_words"), b("n_words")), F.greatest(a("n_words"), b("n_words"))
    length = (more <= SHORT) | ((more - less) * 10 <= more)
    block = F.lit(False)
    for k in range(BLOCKS):
        block = block | ((part(k * WIDTH, WIDTH) == 0) & (F.bit_count(part((k + 1) * WIDTH, CHECK)) <= CHECK_FLIPS))
    return length & few & block


def repeated_lines(docs: DataFrame, store: Store, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, line) of the lines to remove: all but the first occurrence of each connected group.

    ``th`` is the text's xxhash64, which tells texts of one repeated id apart.
    Lines are the pieces between line feeds, numbered from 0. Lines without a
    word are never removed. Rows with a null id are not looked at; a row that
    repeats an id and text has no lines of its own.
    """
    texts = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL")
             .withColumn("th", F.xxhash64("text")))
    lines = store.save(texts.mapInArrow(_line_table(), "doc_id long, th long, line long, key long, n int, sig binary"), "lines")
    # parts of about a million entries
    parts_bits = max(0, min(code_bits(WIDTH) - 1, math.ceil(math.log2(max(lines.count() / LINE, 1)))))
    cut = lines.filter("sig IS NOT NULL").select("key", "n", "sig")
    packed = cut.mapInArrow(_packed(parts_bits), "part long, packed binary")
    met = packed.groupBy("part").applyInArrow(_met(parts_bits), "key long, id long")
    members = store.save(met.distinct(), "met")
    met_ids = Bitmap(store, members, "id")
    forms = texts.select("text").mapInArrow(_normal_lines(met_ids.as_array()), f"key long, n_words int, {', '.join(f's{k} long' for k in range(SIZE))}, odd array<long>, normal string")
    forms = store.save(forms.join(members.select(F.col("id").alias("key")), "key", "left_semi").dropDuplicates(["key"]), "normal")
    payload = forms.drop("normal").withColumnRenamed("key", "id")
    store.drop(met_ids.pieces)

    def near(a, b):
        return _meets(a, b) & _possible(a, b)

    def confirm(pairs):
        marked = Bitmap(store, pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")), "id")
        normal = marked.mark(forms.select("key", "normal"), F.col("key"), "asked").filter("asked")
        both = (pairs.join(normal.select(F.col("key").alias("a"), F.col("normal").alias("x")), "a")
                .join(normal.select(F.col("key").alias("b"), F.col("normal").alias("y")), "b"))
        return both.select("a", "b", "x", "y").mapInArrow(_edit_similar, "a long, b long")

    labels = linked(store, members, payload, near, confirm)
    store.drop(members, forms)
    # lines that stand once and are linked to none stay: only the others are sorted and joined
    again = lines.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    found = Bitmap(store, again if labels is None else again.unionAll(labels.select("id")), "key")
    lines = store.save(found.mark(lines.select("doc_id", "th", "line", "key"), F.col("key"), "hit").filter("hit").drop("hit"), "found")
    nodes = lines.groupBy("key").agg(F.min(F.struct("doc_id", "line", "th")).alias("first"), F.count("*").alias("n"))
    if labels is None:
        groups = nodes.filter("n > 1").select("key", "first")
    else:
        named = nodes.join(labels.withColumnRenamed("id", "key"), "key", "left").filter("n > 1 OR component IS NOT NULL")
        named = store.save(named.select("key", "first", "n", F.coalesce("component", "key").alias("component")), "nodes")
        best = (named.groupBy("component").agg(F.min("first").alias("stays"), F.sum("n").alias("total")).filter("total > 1"))
        groups = named.join(best, "component").select("key", F.col("stays").alias("first"))
    groups = store.save(groups, "groups")
    return (lines.join(groups, "key").filter("struct(doc_id, line, th) <> first").select("doc_id", "th", "line"))


def _without_lines(batches):
    for batch in batches:
        drops, texts = batch.column("drop").to_pylist(), batch.column("text")
        kept, removed = [], []
        for i, drop in enumerate(drops):
            gone, text = set(drop or ()), texts[i].as_py()
            kept.append("\n".join(p for k, p in enumerate(text.split("\n")) if k not in gone) if gone else text)
            removed.append(len(gone))
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "text": pa.array(kept, pa.string()),
                                          "n_removed": pa.array(removed, pa.int64()), "rest": batch.column("rest")})


def dedup_lines(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The documents with repeated lines removed: doc_id, the columns of ``carry``, text, n_removed.

    Lines are alike where a tenth of the longer one's words at most differs, or
    of its letters in lines of up to ``SHORT`` words. Rows of one doc_id are told
    apart by their texts; rows equal in both lose the same lines. Null and empty
    texts, texts whose lines hold no words and rows with a null id come back as
    they are; an empty table gives no rows; a text may become empty. Texts of any
    length are whole. Other columns are dropped unless named in ``carry``; any
    name but doc_id, text and n_removed can be carried.
    """
    carry = carry or []
    store = Store(docs.sparkSession, "lines")
    gone = repeated_lines(docs, store)
    drop = store.save(gone.groupBy(F.col("doc_id").alias("drop_id"), F.col("th").alias("drop_th")).agg(F.collect_set("line").alias("drop")), "drop")
    rest = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("int")
    base = docs.select(F.col("doc_id").alias("id"), F.col("text"), rest.alias("rest"))
    marked = Bitmap(store, drop, "drop_id").mark(base, F.col("id").cast("long"), "hit")
    hits = marked.filter("hit").drop("hit").withColumn("th", F.xxhash64("text"))
    joined = hits.join(drop, (F.col("id") == F.col("drop_id")) & (F.col("th") == F.col("drop_th")), "left")
    kinds = {f.name: f.dataType.simpleString() for f in base.schema}
    cut = joined.select("id", "text", "rest", "drop").mapInArrow(_without_lines, f"id {kinds['id']}, text string, n_removed long, rest {kinds['rest']}")
    out = marked.filter("NOT hit").select("id", "text", F.lit(0).cast("long").alias("n_removed"), "rest").unionAll(cut)
    return out.select(F.col("id").alias("doc_id"), *[F.col("rest")[c].alias(c) for c in carry], "text", "n_removed")
