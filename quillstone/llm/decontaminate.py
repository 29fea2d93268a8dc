"""Benchmark decontamination with an FM-index for each training shard.

Words are those of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z became a-z.
A phrase is a run of `n` words of a benchmark item; an item of fewer words, but
not none, is one phrase. Each shard (the rows of a chunk of text) gets an
FM-index over its word sequence: suffix array, Burrows-Wheeler transform, a
wavelet matrix for ranks and sampled suffix positions. All phrases are found by
backward search at once, located through the samples, and merged into spans.

Words that no phrase has can't be part of an occurrence, so the index keeps one
separator for a run of them, and no run of known words shorter than the shortest
phrase. There is no shuffle. The benchmark is read in blocks of at most
`block_words` words (and an item), each the size of one broadcast, one at a time; a
larger benchmark takes one pass for each block, written before the next begins.

Null or empty texts have no words and no hits; a very long text is a shard of its
own; repeated rows are answered each; null items are ignored; an empty benchmark hits
nothing; an empty table of documents gives no rows. Columns of docs named n_words,
hit_spans or hit_items give way to the results.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCT, U64, Powers, Words, annotated, byte_table, chunks, discard, groups, written

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHARD_BYTES = 1 << 20
SAMPLE_EVERY = 8


class WaveletMatrix:
    """Ranks of symbols in a sequence, in one step for each bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.zeros, self.ends = bits, [], []
        x = symbols
        for level in range(bits - 1, -1, -1):
            one = (x >> level) & 1 == 1
            below = np.zeros(len(x) + 1, np.int32)
            np.cumsum(~one, out=below[1:])
            self.zeros.append(below)
            self.ends.append(int(below[-1]))
            x = np.concatenate([x[~one], x[one]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        lo, hi = np.zeros_like(upto), upto
        for level in range(self.bits):
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            zeros, end = self.zeros[level], self.ends[level]
            a, b = zeros[lo], zeros[hi]
            lo = np.where(one, end + lo - a, a)
            hi = np.where(one, end + hi - b, b)
        return hi - lo


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Order of all suffixes; 0 is a separator, each unlike any other and ordered by position; the last token must be one.

    Prefix doubling that sorts only suffixes still tied.
    """
    n = len(tokens)
    seps = tokens == 0
    key = np.where(seps, np.cumsum(seps) - 1, tokens.astype(np.int64) + int(seps.sum()))
    order = np.argsort(key, kind="stable")
    start, size = groups(key[order])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(start, size)
    tied = np.flatnonzero(np.repeat(size, size) > 1)
    step = 1
    while len(tied):
        at = order[tied]
        pair = rank[at] * n + rank[np.minimum(at + step, n - 1)]
        by = np.argsort(pair, kind="stable")
        at, pair = at[by], pair[by]
        order[tied] = at
        start, size = groups(pair)
        rank[at] = np.repeat(tied[start], size)
        tied = tied[np.repeat(size, size) > 1]
        step *= 2
    return order


class FmIndex:
    """An index of a token sequence (symbols below 2**bits, 0 separates); the last token must be 0."""

    def __init__(self, tokens: np.ndarray, bits: int):
        sa = suffix_array(tokens)
        self.bwt = tokens[sa - 1]
        seps = int((tokens == 0).sum())
        self.before = np.zeros((1 << bits) + 1, np.int64)
        self.before[1:] = np.cumsum(np.bincount(tokens, minlength=1 << bits))
        assert self.before[1] == seps
        self.waves = WaveletMatrix(self.bwt, bits)
        # a walk back can't cross a separator, so what follows one is sampled too
        self.sampled = (sa % SAMPLE_EVERY == 0) | (self.bwt == 0)
        self.samples = sa[self.sampled]
        self.sample_at = np.cumsum(self.sampled) - 1

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """phrases: one row each, all of one length. Those that occur, and their ranges of suffixes."""
        which = np.arange(len(phrases))
        last = phrases[:, -1]
        lo, hi = self.before[last], self.before[last + 1]
        for j in range(phrases.shape[1] - 1, -1, -1):
            if j < phrases.shape[1] - 1:
                c = phrases[which, j]
                lo = self.before[c] + self.waves.rank(c, lo)
                hi = self.before[c] + self.waves.rank(c, hi)
            live = hi > lo
            which, lo, hi = which[live], lo[live], hi[live]
        return which, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes by their rows: steps back to a sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.sampled[at])
        while len(open_):
            x = at[open_]
            c = self.bwt[x]
            at[open_] = self.before[c] + self.waves.rank(c, x)
            steps[open_] += 1
            open_ = open_[~self.sampled[at[open_]]]
        return self.samples[self.sample_at[at]] + steps


class Phrases:
    """Phrases of a block of items: vocabulary hashes, phrases by length as symbols, and the items of each."""

    def __init__(self, items: list[tuple[str, list[str]]], n: int):
        self.items = sorted({i for i, _ in items})
        index = {x: k for k, x in enumerate(self.items)}
        words = sorted({w for _, ws in items for w in ws})
        flat = "\n".join(words).encode()
        data = np.frombuffer(flat, np.uint8)
        off = np.array([0, len(flat)])

        class One:
            pass

        one = One()
        one.data, one.off = data, off
        hashes = Words(one, PUNCT, byte_table(), Powers()(len(flat) + 1)).hash if words else np.zeros(0, U64)
        order = np.argsort(hashes)
        self.vocabulary = hashes[order]
        symbol = {words[k]: s + 1 for s, k in enumerate(order)}
        self.bits = max(1, int(len(words)).bit_length())
        flat = np.array([symbol[w] for _, ws in items for w in ws], np.int32)
        size = np.array([len(ws) for _, ws in items], np.int64)
        owner = np.array([index[i] for i, _ in items], np.int64)
        start = np.cumsum(size) - size
        self.by_length: dict[int, np.ndarray] = {}
        #: Of each phrase of a length, where its items begin, and these.
        self.owners: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in np.unique(np.minimum(size, n)).tolist():
            own = np.flatnonzero((size >= n) if length == n else size == length)
            many = size[own] - length + 1
            if not length or not len(own):
                continue
            at = np.repeat(start[own] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, length)[at])
            distinct, phrase = np.unique(rows.view(f"V{4 * length}").ravel(), return_inverse=True)
            pairs = np.unique(phrase * len(self.items) + np.repeat(owner[own], many))
            self.by_length[length] = np.frombuffer(distinct.tobytes(), np.int32).reshape(-1, length)
            self.owners[length] = np.searchsorted(pairs // len(self.items), np.arange(len(distinct) + 1)), pairs % len(self.items)
        self.shortest = min(self.by_length, default=0)


def shard_hits(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences in a shard's words: the first word, the phrase's length, and pairs (row, item) as one number each."""
    none = (np.zeros(0, np.int64),) * 3
    if not phrases.by_length or not len(words.hash):
        return none
    slot = np.minimum(np.searchsorted(phrases.vocabulary, words.hash), len(phrases.vocabulary) - 1)
    known = np.flatnonzero(phrases.vocabulary[slot] == words.hash)
    if not len(known):
        return none
    row = words.row()
    breaks = np.concatenate(([True], (np.diff(known) > 1) | (np.diff(row[known]) > 0)))
    start, size = groups(np.cumsum(breaks))
    long = np.repeat(size >= phrases.shortest, size)
    known, breaks = known[long], breaks[long]
    if not len(known):
        return none
    place = np.arange(len(known)) + np.cumsum(breaks) - 1
    tokens = np.zeros(int(place[-1]) + 2, np.int32)
    tokens[place] = slot[known] + 1
    source = np.zeros(len(tokens), np.int64)
    source[place] = known
    index = FmIndex(tokens, phrases.bits)
    firsts, lengths, pairs = [], [], []
    for length, table in phrases.by_length.items():
        which, lo, hi = index.search(table)
        if not len(which):
            continue
        count = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
        word = source[index.locate(at)]
        phrase = np.repeat(which, count)
        firsts.append(word)
        lengths.append(np.full(len(word), length))
        seen = np.unique(row[word] * len(table) + phrase)
        r, p = seen // len(table), seen % len(table)
        first, items = phrases.owners[length]
        many = first[p + 1] - first[p]
        own = items[np.repeat(first[p] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        pairs.append(np.repeat(r, many) * len(phrases.items) + own)
    if not firsts:
        return none
    return np.concatenate(firsts), np.concatenate(lengths), np.unique(np.concatenate(pairs))


def _blocks(benchmark: DataFrame, item_id: str, text: str, n: int, block_words: int):
    block, size = [], 0
    for item, value in benchmark.select(F.col(item_id).cast("string"), F.col(text).cast("string")).where(f"`{item_id}` is not null and `{text}` is not null").toLocalIterator():
        ws = WORD.findall(value.translate(LOWER))
        block.append((item, ws))
        size += len(ws)
        if size >= block_words:
            yield Phrases(block, n)
            block, size = [], 0
    if block:
        yield Phrases(block, n)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _pass(df: DataFrame, text: str, shared, first: bool) -> DataFrame:
    def make():
        power, table, phrases = Powers(), byte_table(), Phrases.__new__(Phrases)
        phrases.__dict__ = shared.value

        def work(batch):
            n_words, starts, items, spans = [], [], [], []
            column = batch.column(batch.schema.get_field_index(text))
            old = None if first else (batch.column(batch.schema.get_field_index("hit_spans")).to_pylist(), batch.column(batch.schema.get_field_index("hit_items")).to_pylist())
            for chunk in chunks(column, SHARD_BYTES):
                words = Words(chunk, PUNCT, table, power(len(chunk.data) + 1))
                n_words += np.diff(words.range).tolist()
                word, length, pairs = shard_hits(words, phrases)
                mine = [[] for _ in range(len(chunk))]
                for p in pairs:
                    mine[p // len(phrases.items)].append(phrases.items[p % len(phrases.items)])
                edge = np.zeros(len(words.hash) + 1, np.int64)
                np.add.at(edge, word, 1)
                np.add.at(edge, word + length, -1)
                hit = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
                row = words.row()[hit]
                cut = np.concatenate(([True], (np.diff(hit) > 1) | (np.diff(row) > 0))) if len(hit) else np.zeros(0, bool)
                run = [[] for _ in range(len(chunk))]
                s = np.flatnonzero(cut)
                for a, b in zip(s, np.append(s[1:], len(hit))):
                    r = row[a]
                    run[r].append((int(hit[a] - words.range[r]), int(hit[b - 1] + 1 - words.range[r])))
                items += mine
                spans += run
            if old:
                spans = [merged((x or []) + [(y["start"], y["end"]) for y in o or []]) for x, o in zip(spans, old[0])]
                items = [sorted({*x, *(o or [])}) for x, o in zip(items, old[1])]
            return n_words, [[{"start": a, "end": b} for a, b in x] for x in spans], items

        return work

    fields = [("n_words", pa.int64(), "long"), ("hit_spans", SPANS, "array<struct<start:long,end:long>>"), ("hit_items", pa.list_(pa.string()), "array<string>")]
    return annotated(df, make, fields)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10, block_words: int = 500_000) -> DataFrame:
    """docs and n_words, hit_spans (in words, end exclusive), hit_items (sorted ids of items with occurring phrases)."""
    context = docs.sparkSession.sparkContext
    out, shared, kept = docs, None, None
    for phrases in _blocks(benchmark, item_id, item_text, n, block_words):
        if shared:
            # one block's phrases are held at a time: what they found is written before the next are sent
            done = written(out, "leaks")
            shared.unpersist()
            if kept:
                discard(kept)
            out = kept = done
        first, shared = shared is None, context.broadcast(vars(phrases))
        out = _pass(out, text, shared, first)
    return out if shared else _pass(out, text, context.broadcast(vars(Phrases([], n))), True)


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """A row of numbers for each document, from contaminated()."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        F.col(doc_id).alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def without_hits(found: DataFrame, text: str = "text") -> DataFrame:
    """The rows of contaminated() with the hit words, and what is between words of one span, cut from the text; joins are one space."""

    def make():
        def work(batch):
            column = batch.column(batch.schema.get_field_index(text)).to_pylist()
            spans = batch.column(batch.schema.get_field_index("hit_spans")).to_pylist()
            out = []
            for value, runs in zip(column, spans):
                if value is None or not runs:
                    out.append(value)
                    continue
                places = [m.span() for m in WORD.finditer(value.translate(LOWER))]
                parts, at = [], 0
                for r in runs:
                    parts.append(value[at : places[r["start"]][0]])
                    at = places[r["end"] - 1][1]
                parts.append(value[at:])
                out.append(" ".join(p.strip(" ") for p in parts if p.strip(" ")))
            return [pa.array(out, pa.string())]

        return work

    return annotated(found, make, [(text, pa.string(), "string")]).select(*found.columns)


def digest_of_items(items: list[str]) -> str:
    """items_sha256 of a list of ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
