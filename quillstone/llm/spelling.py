"""Spelling variants: words one edit apart, found by two-dimensional range reporting on wavelet trees.

Words one edit apart share what stands before the edit and what stands after it. In a
set of words sorted forwards a common prefix is an interval, and sorted from the end a
common suffix is one too; the words with both are the points of a rectangle in the
permutation from one order to the other. A wavelet tree over that permutation reports
them, for every edit position: a replacement among words of the same length, an
insertion among words one longer (a deletion is the same pair seen from there).

Sets stay small wherever the vocabulary is large: with words of c letters cut after
p = c // 2 of them, two words whose first edit position is p or later share their
first p letters, and others their last c - p. So each word goes by these keys to buckets,
and a bucket looks at the positions of its side alone: every pair is found once. A
bucket gets keys by hash; a key's words are distinct and share half their letters.

Cases: a null text has no words; a null id counts as an empty one before the colon. Repeated
rows count again. Of several near words with the largest count the first in code-point
order is the form. Words of any length are kept whole. An empty table gives no rows.
Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Chunk, chunks, discard, small_batches, written

LEAST_LETTERS, LEAST_COUNT, RATIO, SLIP = 6, 5, 5, 199
#: Records (four a word) of a bucket on average; a bucket is one task's group.
BUCKET_ROWS = 1 << 16
#: Runs of more bytes have their crc32 taken one by one.
SHORT = 64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


CRC = _crc_table()
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def crc32_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of data[start:end] of each run, continued from `before`."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    state = (before ^ np.uint32(0xFFFFFFFF))[order]
    at, left = start[order], size[order]
    long = int(np.searchsorted(-left, -SHORT, "left"))
    for j in range(int(left[long]) if long < len(left) else 0):
        n = int(np.searchsorted(-left, -j, "left"))  # those with more than j bytes
        s = state[long:n]
        state[long:n] = CRC[(s ^ data[at[long:n] + j]) & np.uint32(255)] ^ (s >> np.uint32(8))
    out = np.empty(len(state), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for k in order[:long]:
        out[k] = zlib.crc32(data[start[k] : end[k]].tobytes(), int(before[k]))
    return out


def _counted(chunk: Chunk, prefix: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Distinct words of a chunk, slips of the pen included, and how often each is there. prefix: crc32 of "<doc_id>:" of each row."""
    data, off = LOWER[chunk.data], chunk.off
    lead = data == 0xC3  # U+00C0 to U+00FF are C3 and one byte more
    second = np.zeros(len(data), bool)
    second[1:] = lead[:-1]
    inside = LETTER[data] | lead | second
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    seconds = np.concatenate([[0], np.cumsum(second)])
    letters = end - start - (seconds[end] - seconds[start])
    keep = letters >= LEAST_LETTERS
    start, end, letters = start[keep], end[keep], letters[keep]
    row = np.searchsorted(off, start, "right") - 1
    h = crc32_of(data, start, end, prefix[row])
    slip = h % np.uint32(SLIP) == 0
    changed = []
    for s, e, n, x in zip(start[slip], end[slip], letters[slip], h[slip]):
        if n > LEAST_LETTERS:
            run, k = data[s:e].tobytes().decode(), int(x) % int(n)
            changed.append(run[:k] + run[k + 1 :])
    start, end = start[~slip], end[~slip]
    size = end - start
    border = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.repeat(start - border[:-1], size) + np.arange(border[-1])]
    runs = pa.Array.from_buffers(pa.large_utf8(), len(start), [None, pa.py_buffer(border.astype(np.int64)), pa.py_buffer(flat)])
    both = pa.concat_arrays([runs, pa.array(changed, pa.large_utf8())]).value_counts()
    return both.field(0).cast(pa.utf8()), both.field(1)


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of doc_id and text with LEAST_LETTERS letters or more that occur `least` times."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for chunk in chunks(batch.column(1)):
                prefix = np.array([zlib.crc32(b"%s:" % str("" if i is None else i).encode()) for i in ids[chunk.first : chunk.first + len(chunk)]], np.uint32)
                words, n = _counted(chunk, prefix)
                yield pa.RecordBatch.from_arrays([words, n], names=["word", "n"])

    parts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class WaveletTree:
    """Ranks of the bits of a permutation, level by level; zeros of a level go left, ones right."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, (max(len(values), 1) - 1).bit_length())
        self.levels = []
        for b in range(self.bits - 1, -1, -1):
            bit = (values >> b) & 1
            ones = np.concatenate([[0], np.cumsum(bit)])
            self.levels.append((ones, len(values) - int(ones[-1])))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) for every value in [low, high) at a place in [left, right), of many queries at once."""
        query = np.flatnonzero((left < right) & (low < high))
        left, right, base = left[query], right[query], np.zeros(len(query), np.int64)
        for b, (ones, zeros) in zip(range(self.bits - 1, -1, -1), self.levels):
            a, z = ones[left], ones[right]
            query = np.concatenate([query, query])
            left, right = np.concatenate([left - a, zeros + a]), np.concatenate([right - z, zeros + z])
            base = np.concatenate([base, base + (1 << b)])
            keep = np.flatnonzero((left < right) & (base < high[query]) & (base + (1 << b) > low[query]))
            query, left, right, base = query[keep], left[keep], right[keep], base[keep]
        return query, base


class Order:
    """Rows of letters (padded with 0) in sorted order, and the intervals of their common beginnings."""

    def __init__(self, letters: np.ndarray, is_long: np.ndarray):
        n, width = letters.shape
        self.order = np.argsort(np.ascontiguousarray(letters).view(f"S{width}").ravel(), kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        same = letters[self.order[1:]] == letters[self.order[:-1]]
        self.common = np.where(same.all(axis=1), width, same.argmin(axis=1)) if n > 1 else np.zeros(0, np.int64)
        self.rows = {long: self.order[is_long[self.order] == long] for long in (False, True)}
        self.before = {long: np.concatenate([[0], np.cumsum(is_long[self.order] == long)]) for long in (False, True)}

    def interval(self, rows: np.ndarray, size: int, long: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of each row, the range of those long (or short) rows that begin with its first `size` letters."""
        first = np.concatenate([[True], self.common < size])
        starts = np.flatnonzero(first)
        group = np.cumsum(first)[self.place[rows]] - 1
        return self.before[long][starts[group]], self.before[long][np.append(starts[1:], len(self.place))[group]]


def near_pairs(short: np.ndarray, long: np.ndarray, positions: range) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs one edit apart whose edit position is in `positions`.

    short: distinct words of c letters, a row of codes each; long: words of c + 1.
    Returns (word, other) of replacements, both rows of short, in both directions; and
    (word, longer) of insertions. Where equal letters make several positions of an
    insertion possible, the last counts, which is the length of the common prefix.
    """
    none = np.zeros(0, np.int64)
    n, c = short.shape
    if not n or n + len(long) < 2:
        return none, none, none, none
    is_long = np.arange(n + len(long)) >= n
    forward = np.zeros((n + len(long), c + 1), np.uint8)
    forward[:n, :c], forward[n:] = short, long
    backward = np.zeros_like(forward)
    backward[:n, :c], backward[n:] = short[:, ::-1], long[:, ::-1]
    fore, back = Order(forward, is_long), Order(backward, is_long)
    words, out = np.arange(n), []
    for longer in (False, True):
        found_word, found_row = [none], [none]
        if (len(long) if longer else n - 1) > 0:
            # where the words of this length, in forward order, are in the order from the end
            number = np.empty(n + len(long), np.int64)
            number[back.rows[longer]] = np.arange(len(back.rows[longer]))
            tree = WaveletTree(number[fore.rows[longer]])
            for i in positions:
                if i == c and not longer:
                    continue
                left, right = fore.interval(words, i, longer)
                low, high = back.interval(words, c - i - (not longer), longer)
                most = np.minimum(right - left, high - low)
                asked = np.flatnonzero(most > (not longer))  # a word itself is in its own intervals
                query, value = tree.report(left[asked], right[asked], low[asked], high[asked])
                word, row = asked[query], back.rows[longer][value]
                good = (forward[row, i] != forward[word, i]) if i < c else np.ones(len(row), bool)
                found_word.append(word[good])
                found_row.append(row[good])
        out += [np.concatenate(found_word), np.concatenate(found_row) - (n if longer else 0)]
    return tuple(out)


def _bucket(table: pa.Table) -> pa.Table:
    """Of each word of a bucket: near words in it, and the best (largest n, first in order)."""
    kind = table.column("c").to_numpy() * 2 + table.column("side").to_numpy()
    text, counts = table.column("word").to_pylist(), table.column("n").to_numpy()
    order = np.argsort(kind, kind="stable")
    out_word, out_k, out_n, out_best = [], [], [], []
    for part in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1) if len(order) else []:
        c, side = divmod(int(kind[part[0]]), 2)
        words = [text[i].encode("latin-1") for i in part]
        size = np.array([len(w) for w in words])
        rows = [part[size == m] for m in (c, c + 1)]
        letters = [np.frombuffer(b"".join(w for w, s in zip(words, size) if s == m), np.uint8).reshape(-1, m) for m in (c, c + 1)]
        a, b, u, v = near_pairs(*letters, range(c // 2, c + 1) if side == 0 else range(c // 2))
        word = np.concatenate([rows[0][a], rows[0][u], rows[1][v]])
        near = np.concatenate([rows[0][b], rows[1][v], rows[0][u]])
        if not len(word):
            continue
        name = np.array([text[i] for i in near])
        by = np.lexsort((name, -counts[near], word))
        word, near = word[by], near[by]
        start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out_word += [text[i] for i in word[start]]
        out_k += np.diff(np.append(start, len(word))).tolist()
        out_n += counts[near[start]].tolist()
        out_best += [text[i] for i in near[start]]
    return pa.table({"word": pa.array(out_word, pa.string()), "k": pa.array(out_k, pa.int64()), "best_n": pa.array(out_n, pa.int64()), "best": pa.array(out_best, pa.string())})


def near_words(words: DataFrame, rows: int | None = None) -> DataFrame:
    """word, n_near, best_n, best: of each word (word, n; distinct) that has near words, how many, and the best of them."""
    buckets = max(1, 4 * (words.count() if rows is None else rows) // BUCKET_ROWS)
    m = F.length("word")

    def record(c, side):
        p = (c / 2).cast("int")
        key = F.substring("word", F.lit(1), p) if side == 0 else F.substring("word", m - (c - p) + 1, c - p)
        return F.struct(c.cast("int").alias("c"), F.lit(side).alias("side"), F.pmod(F.xxhash64(c, F.lit(side), key), F.lit(buckets)).alias("bucket"))

    records = words.select("word", "n", F.inline(F.array(*[record(c, side) for c in (m, m - 1) for side in (0, 1)]))).where(F.col("c") >= LEAST_LETTERS)
    found = records.groupBy("bucket").applyInArrow(_bucket, "word string, k long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("k").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame, largest: int, ratio: int = RATIO, least: int = LEAST_COUNT) -> DataFrame:
    """word, root of words with a form (word, form; written): each round looks twice as far.

    A form's n is `ratio` times its word's or more, so a chain has a bounded number of steps.
    """
    depth, n = 1, least * ratio
    while n * ratio <= largest:
        depth, n = depth + 1, n * ratio
    now, seen = forms.select("word", F.col("form").alias("root")), 1
    while seen < depth:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_r"))
        before, now = now, written(now.join(ahead, "root", "left").select("word", F.coalesce("_r", "root").alias("root")), "roots")
        if seen > 1:
            discard(before)
        seen *= 2
    return now


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs (doc_id, text)."""
    words = written(vocabulary(docs), "vocabulary")
    size, largest = words.agg(F.count("*"), F.max("n")).first()
    joined = words.join(near_words(words, size), "word", "left")
    is_form = F.col("best_n") >= RATIO * F.col("n")
    found = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "variants")
    discard(words)
    ends = roots(found.where("form is not null"), largest or 0)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
