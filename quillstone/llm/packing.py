"""Packing documents into training sequences: first-fit decreasing with a tournament tree, in random groups.

A document is its tokens and one id that ends it. Whole sequences are cut off its
front; what is left (fewer ids than a sequence) goes to one of many groups of a
bounded number of documents, dealt by a hash of its place in the input, so copies,
a hot source or one id with many rows spread alike. Each group is packed alone by
first-fit decreasing: a tournament tree holds the free room of all bins, its root
the largest, and the leftmost bin with room enough is found in log(bins) steps. Then
bins left with room for LEAST_CUT ids or more are filled with parts of the emptiest
ones, and the one bin that stays open is cut at powers of two, which need no padding.

Texts are tokenized in segments: a text may be cut before a single space between two
characters that are no white space, and between a letter and a sign, as no token of the
vocabulary spans such a place. Distinct segments are encoded once and kept by the worker
for later batches and tasks.

Cases: a null text is an empty one and has the ending id alone. A null id, repeated
rows and ids, and ties are rows like others; each row's ids are packed. Very long
texts give whole sequences as they are. An empty table gives no rows. Other columns
of the input are ignored. The input should be a table that is read in a fixed order
(files, or a written table), as a row's group depends on its place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Chunk, chunks, mix, small_batches

LENGTH, END_ID, GROUP_DOCS = 1024, 0, 1024
#: A bin's free room is filled by cutting another piece only where it takes so many ids.
LEAST_CUT = 8
#: Segments whose ids a worker keeps, and bytes that are encoded at once.
KEPT_SEGMENTS, ENCODED_AT_ONCE = 800_000, 1 << 18
LETTERS, SIGNS = np.zeros(256, bool), np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = True
#: Not the apostrophe, which begins endings of words, nor |, which stands within names of special tokens.
SIGNS[[ord(c) for c in '!"#$%&()*+,-./:;<=>?@[\\]^_`{}~']] = True
SCHEMA = "doc_id {0}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class BinTree:
    """A tournament tree over the free room of bins: each inner node holds the larger of its two."""

    def __init__(self, bins: int, room: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.node = [room] * (2 * self.size)

    def first_fit(self, need: int) -> int:
        """The leftmost bin with room for `need`; the room is taken. There must be one."""
        node, at = self.node, 1
        while at < self.size:
            at *= 2
            if node[at] < need:
                at += 1
        found = at - self.size
        node[at] -= need
        while at > 1:
            at //= 2
            a, b = node[2 * at], node[2 * at + 1]
            node[at] = a if a > b else b
        return found

    def room(self, i: int) -> int:
        return self.node[self.size + i]


def first_fit_decreasing(lengths: np.ndarray, room: int) -> list[list[int]]:
    """Bins of indexes: items by decreasing length (ties by index), each in the first bin that has room."""
    tree, bins = BinTree(len(lengths), room), []
    for i in np.argsort(-lengths, kind="stable"):
        b = tree.first_fit(int(lengths[i]))
        if b == len(bins):
            bins.append([])
        bins[b].append(int(i))
    return bins


def filled(bins: list[list[int]], lengths: np.ndarray, room: int, least: int = LEAST_CUT) -> list[list[tuple[int, int, int]]]:
    """Bins of parts (item, from, length): free room of `least` or more is filled from the emptiest bins; the last is cut at powers of two."""
    parts = [[(i, 0, int(lengths[i])) for i in b] for b in bins]
    used = [sum(p[2] for p in b) for b in parts]
    order = sorted(range(len(parts)), key=lambda b: (-used[b], b))
    low, high = 0, len(order) - 1
    while low < high:
        to, of = order[low], order[high]
        free = room - used[to]
        if free < least:
            low += 1
            continue
        item, at, n = parts[of].pop()
        take = min(n, free)
        parts[to].append((item, at, take))
        if take < n:
            parts[of].append((item, at + take, n - take))
        used[to] += take
        used[of] -= take
        if not used[of]:
            high -= 1
    out = [parts[b] for b in order[: high + 1]]
    if out and room - used[order[high]] >= least:
        last, n = out.pop(), used[order[high]]
        while n:
            want, sequence = 1 << (n.bit_length() - 1), []
            n -= want
            while want:
                item, at, k = last.pop()
                take = min(k, want)
                sequence.append((item, at, take))
                if take < k:
                    last.append((item, at + take, k - take))
                want -= take
            out.append(sequence)
    return out


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer, bytes of each id, and ids of the segments met so far."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel unit
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    kept: dict[bytes, bytes] = {}
    # in a byte-level vocabulary a token's text has one character for each of its bytes
    return t, np.array([len(t.id_to_token(i) or "") for i in range(t.get_vocab_size())], np.int64), kept


def _inside(b: np.ndarray) -> np.ndarray:
    """Bytes that can't be a part of white space: those of ASCII signs, and of letters up to U+07FF."""
    return (b > 32) & (b < 127) | (b >= 0xC3) & (b < 0xE0)


class Encoder:
    """Ids of the texts of a chunk, equal to those of each whole text; distinct segments are encoded once."""

    def __init__(self, path: str):
        self.tokenizer, self.bytes_of, self.kept = _tokenizer(path)
        self.kind = np.uint16 if len(self.bytes_of) <= 1 << 16 else np.uint32

    def _cuts(self, chunk: Chunk) -> np.ndarray:
        data, n = chunk.data, len(chunk.data)
        cut = np.zeros(n + 1, bool)
        space = np.flatnonzero(data[1:-1] == 32) + 1 if n > 2 else np.zeros(0, np.int64)
        before, lead = data[space - 1], data[space - 2]  # a space at 1 looks at the last byte: a cut there is no harm
        # the second byte of a letter up to U+07FF; 85 and A0 after C2 are white space
        good = (_inside(before) & (before < 127) | (before >= 0x80) & (before < 0xC0) & (lead >= 0xC3) & (lead < 0xE0)) & _inside(data[space + 1])
        cut[space[good]] = True
        sign = np.flatnonzero(SIGNS[data[2:]]) + 2 if n > 2 else np.zeros(0, np.int64)
        before, lead = data[sign - 1], data[sign - 2]
        cut[sign[LETTERS[before] | (lead == 0xC3) & (before != 0x97) & (before != 0xB7)]] = True  # U+00C0 to U+00FF but for the two signs
        cut[chunk.off] = True
        return np.flatnonzero(cut)

    def _encode(self, new: list[bytes]) -> None:
        """Joins segments to one text, whose ids are cut where segments end."""
        at = 0
        while at < len(new):
            end, size = at, 0
            while end < len(new) and (end == at or size + len(new[end]) <= ENCODED_AT_ONCE):
                size += len(new[end])
                end += 1
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join(new[at:end]).decode()], add_special_tokens=False)[0].ids, np.int64)
            ends = np.cumsum(self.bytes_of[ids])
            want = np.cumsum([len(x) for x in new[at:end]])
            to = np.searchsorted(ends, want)
            if len(ids) and not (ends[np.minimum(to, len(ends) - 1)] == want).all():
                raise ValueError("the vocabulary is not byte-level: a token spans a space between words")
            ids = ids.astype(self.kind)
            start = 0
            for x, e in zip(new[at:end], (to + 1).tolist()):
                self.kept[x] = ids[start:e].tobytes()
                start = e
            at = end

    def __call__(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the border of each text in them."""
        cut = self._cuts(chunk)
        if len(cut) < 2:
            return np.zeros(0, self.kind), np.zeros(len(chunk.off), np.int64)
        segments = pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(chunk.data))]).dictionary_encode()
        distinct = segments.dictionary.to_pylist()
        if len(self.kept) + len(distinct) > KEPT_SEGMENTS:
            self.kept.clear()
        # others than words with their spaces may melt into what stands beside them: they are encoded alone
        new = [x for x in distinct if x not in self.kept]
        self._encode([x for x in new if self._apart(x)])
        alone = [x for x in new if x not in self.kept]
        for x, ids in zip(alone, self.tokenizer.encode_batch_fast([x.decode() for x in alone], add_special_tokens=False)):
            self.kept[x] = np.array(ids.ids, np.int64).astype(self.kind).tobytes()
        found = [self.kept[x] for x in distinct]
        flat = np.frombuffer(b"".join(found), self.kind)
        n = np.array([len(x) for x in found], np.int64) // np.dtype(self.kind).itemsize
        first = np.cumsum(n) - n
        code = segments.indices.to_numpy()
        count = n[code]
        border = np.concatenate([[0], np.cumsum(count)])
        ids = flat[np.repeat(first[code] - border[:-1], count) + np.arange(border[-1])]
        return ids, border[np.searchsorted(cut, chunk.off)]

    @staticmethod
    def _apart(x: bytes) -> bool:
        """Whether a text may be cut before and after the segment, whatever stands there."""
        return len(x) > 1 and x[0] == 32 and (32 < x[1] < 127 or 0xC3 <= x[1] < 0xE0) and (32 < x[-1] < 127 or len(x) > 2 and 0x80 <= x[-1] < 0xC0 and 0xC3 <= x[-2] < 0xE0)


def tokenized(texts: pa.Array, encoder: Encoder, end_id: int = END_ID) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, ids of each row with the ending one) for runs of rows."""
    for chunk in chunks(texts):
        ids, off = encoder(chunk)
        yield chunk.first, [np.append(ids[a:b], encoder.kind(end_id)) for a, b in zip(off[:-1], off[1:])]


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, group_docs: int = GROUP_DOCS, least_cut: int = LEAST_CUT, keep_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (unsigned, little-endian, 4 bytes each).

    docs has doc_id and text. Groups hold group_docs documents on average. Without
    keep_ids, ids holds their crc32 (4 bytes, largest first), and whole sequences don't carry their ids
    to the groups.
    """
    kind = dict(docs.dtypes)["doc_id"]
    many = max(1, -(-docs.count() // group_docs))
    small_batches(docs.sparkSession)

    def final(ids: np.ndarray) -> bytes:
        raw = ids.astype("<u4").tobytes()
        return raw if keep_ids else zlib.crc32(raw).to_bytes(4, "big")

    def pieces(batches):
        encoder = Encoder(tokenizer)
        place, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids_of = batch.column(batch.schema.get_field_index("doc_id"))
            for first, rows in tokenized(batch.column(batch.schema.get_field_index("text")), encoder, end_id):
                doc, start, total, apart, ids = [], [], [], [], []
                for i, x in enumerate(rows):
                    whole = len(x) // length
                    for k in range(whole + (len(x) % length > 0)):
                        part = x[k * length : (k + 1) * length]
                        doc.append(first + i)
                        start.append(k * length)
                        total.append(len(x))
                        apart.append(k < whole)
                        ids.append(final(part) if k < whole else part.tobytes())
                if doc:
                    # a whole sequence has a negative number of its own, what is left a random group
                    number = (place << 36) + row + np.arange(len(doc), dtype=np.int64)
                    group = np.where(apart, -1 - number, (mix(number.astype(np.uint64)) % np.uint64(many)).astype(np.int64))
                    row += len(doc)
                    yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), ids_of.take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())], names=["group", "doc_id", "start", "doc_tokens", "ids"])

    width = 2 if len(_tokenizer(tokenizer)[1]) <= 1 << 16 else 4

    def sequences(batches):
        """Rows come group by group; a group is packed when it is whole."""
        now, held = None, []
        for batch in batches:
            group = batch.column(0).to_numpy(zero_copy_only=False)
            whole = np.flatnonzero(group < 0)
            if len(whole):
                rows = batch.take(pa.array(whole))
                yield _rows(rows.column(1), rows.column(2).to_numpy(), np.full(len(whole), length), rows.column(3).to_numpy(), -2 * (group[whole] + 1), np.zeros(len(whole), np.int64), rows.column(4))
            rest = np.flatnonzero(group >= 0)
            border = np.flatnonzero(np.diff(group[rest])) + 1
            for part in np.split(rest, border) if len(rest) else []:
                if now is not None and group[part[0]] != now:
                    yield pack(now, held)
                    held = []
                now = int(group[part[0]])
                held.append(batch.take(pa.array(part)))
        if held:
            yield pack(now, held)

    def pack(group, held):
        table = pa.Table.from_batches(held).combine_chunks()
        raw = table.column("ids").to_pylist()
        start, total = table.column("start").to_numpy(), table.column("doc_tokens").to_numpy()
        lengths = np.array([len(x) // width for x in raw], np.int64)
        item, begin, size, number, offset = [], [], [], [], []
        for k, bin_ in enumerate(filled(first_fit_decreasing(lengths, length), lengths, length, least_cut)):
            at = 0
            for i, a, n in bin_:
                item.append(i)
                begin.append(a)
                size.append(n)
                number.append((group << 24 | k) * 2 + 1)
                offset.append(at)
                at += n
        ids = [final(np.frombuffer(raw[i], f"<u{width}")[a : a + n]) for i, a, n in zip(item, begin, size)]
        return _rows(table.column("doc_id").combine_chunks().take(pa.array(item)), start[item] + begin, size, total[item], number, offset, pa.array(ids, pa.binary()))

    rows = docs.select("doc_id", "text").mapInArrow(pieces, f"group long, doc_id {kind}, start long, doc_tokens long, ids binary")
    return rows.repartition("group").sortWithinPartitions("group", "doc_id", "start").mapInArrow(sequences, SCHEMA.format(kind))


def _rows(doc, start, length, total, number, offset, ids) -> pa.RecordBatch:
    long = [pa.array(x, pa.int64()) for x in (start, length, total, number, offset)]
    doc = doc.combine_chunks() if isinstance(doc, pa.ChunkedArray) else doc
    return pa.RecordBatch.from_arrays([doc, *long, ids], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def digest(found: DataFrame) -> DataFrame:
    """The columns of op12 from packed(keep_ids=False)."""
    crc = F.conv(F.hex("ids"), 16, 10).cast("long")
    return found.select("doc_id", "start", "length", crc.alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
