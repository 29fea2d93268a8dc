"""Exact substring dedup: every byte covered by a string of LENGTH bytes that also starts elsewhere.

Strings are judged on the input, the first occurrence too. Each window (string of
LENGTH bytes) has a minimizer, the leftmost of its SEED-byte seeds whose hash is
least; equal windows have equal minimizers at the same place. Runs of windows with
one minimizer make a *piece* (its windows' bytes, at most 2 LENGTH). Pieces whose
minimizer occurs once are done with. The others meet in groups by minimizer.

A bucket of groups is a collection of short documents. Its Burrows-Wheeler
transform and common prefixes are built column by column, from the last symbol of
the documents to the first: each round inserts one symbol for every document,
reorders the suffixes by a stable sort on it, and derives their common prefixes
from those of the round before. As the documents of a group are aligned at the
minimizer, suffixes of different columns never share LENGTH bytes within a group,
so a round's suffixes are ordered among themselves and each round is one block of
the transform. Symbols are read from, and orders with prefixes written to, files
that are passed through in sequence (private to the task, unlinked from the
start), so memory is a few numbers a document. A last pass over that file takes
the suffixes whose common prefix with a neighbour reaches LENGTH.

Equal pieces are one document of the collection, entered twice if several texts hold
it, so every repeat is found by the rounds. Only a minimizer with more than HOT
pieces (a passage that a large part of all documents hold, too much for one task) is
not gathered: its windows are counted by 128-bit hashes, in a join that Spark may
split; the result is the same either way. The files take 7 bytes for each byte of a
bucket's pieces, in the executor's own temporary folder, and go with the task.

Null and empty texts have no bytes; a repeated row is another document, so its
windows occur twice; rows with equal id are told apart by their text. Rows
without an id take part like any other (on the way they share id 0, which their texts
tell apart); other columns are not returned; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Powers, annotated, byte_table, chunks, discard, groups, mix, written

LENGTH = 400
SEED = 128
HOT = 100_000
BUCKET = 12_288
SEGMENT = (1 << 20) - 2 * LENGTH
POSITION = U64((1 << 20) - 1)


def seeds(data: np.ndarray, table: np.ndarray, size: int = SEED) -> np.ndarray:
    """A hash of the `size` bytes (a power of two) from each place on."""
    h, done, base = table[data], 1, 0x5851F42D4C957F2D
    while done < size:
        h = h[:-done] * U64(pow(base, done, 2**64)) + h[done:]
        done *= 2
    return mix(h)


def least_in(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of `width` values."""
    done = 1
    while 2 * done <= width:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    return np.minimum(h[: len(h) - (width - done)], h[width - done :]) if width > done else h


def segment_pieces(data: np.ndarray, off: np.ndarray, table: np.ndarray, length: int = LENGTH, size: int = SEED):
    """Pieces of texts of less than 2**20 bytes together: row, first byte, windows, minimizer's place, its hash."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    if len(data) < length:
        return none
    h = seeds(data, table, size)
    place = np.arange(len(h), dtype=np.uint64)
    at = (least_in((h & ~POSITION) | place, length - size + 1) & POSITION).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(at)]
    good = np.arange(len(at)) + length <= off[1:][row]
    start = np.flatnonzero(good)
    if not len(start):
        return none
    new = np.ones(len(start), bool)
    new[1:] = (at[start[1:]] != at[start[:-1]]) | (np.diff(start) > 1) | (row[start[1:]] != row[start[:-1]])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(start)))
    begin = start[first]
    return row[begin], begin, runs, at[begin], h[at[begin]]


def pieces(data: np.ndarray, off: np.ndarray, table: np.ndarray):
    """segment_pieces() of a chunk; a long text goes by segments that overlap by a window less a byte."""
    if len(data) <= SEGMENT:
        yield from zip(*(x.tolist() if x.dtype != np.uint64 else x.view(np.int64).tolist() for x in segment_pieces(data, off, table)))
        return
    for r in range(len(off) - 1):
        for s in range(int(off[r]), int(off[r + 1]), SEGMENT):
            part = data[s : min(int(off[r + 1]), s + SEGMENT + LENGTH - 1)]
            for _, b, n, p, h in zip(*(x.tolist() if x.dtype != np.uint64 else x.view(np.int64).tolist() for x in segment_pieces(part, np.array([0, len(part)]), table))):
                yield r, s + b, n, s + p, h


class Rounds:
    """A file of blocks, written once in sequence and then read once in sequence."""

    def __init__(self) -> None:
        self.file, self.sizes = tempfile.TemporaryFile(), []

    def put(self, *arrays: np.ndarray) -> None:
        for a in arrays:
            self.file.write(np.ascontiguousarray(a).data)
        self.sizes.append(len(arrays[0]))

    def rewind(self) -> None:
        self.file.seek(0)

    def take(self, count: int, kind) -> np.ndarray:
        return np.frombuffer(self.file.read(count * np.dtype(kind).itemsize), kind)


def repeated(texts: list[bytes], left: np.ndarray, group: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each text, the places whose `length` bytes also stand in another text of its group at the same distance from the aligned place."""
    m = len(texts)
    out: list[list[int]] = [[] for _ in range(m)]
    if not m:
        return []
    sizes = np.array([len(t) for t in texts])
    first, last = -left, sizes - left  # columns
    top, low = int(last.max()), int(first.min())
    flat = np.frombuffer(b"".join(texts), np.uint8)
    base = np.cumsum(sizes) - sizes
    symbols, blocks = Rounds(), Rounds()
    for c in range(top - 1, low - 1, -1):
        live = np.flatnonzero((first <= c) & (c < last))
        symbols.put(flat[base[live] + left[live] + c])
    symbols.rewind()
    order, prefix = np.zeros(0, np.int64), np.zeros(0, np.int64)
    symbol = np.zeros(m, np.int64)
    by_first, by_last = _index(first), _index(last)
    for c, size in zip(range(top - 1, low - 1, -1), symbols.sizes):
        live = np.flatnonzero((first <= c) & (c < last))
        symbol[live] = symbols.take(size, np.uint8)
        if c + 1 in by_first and len(order):
            # those that began at the column before are done: their neighbours' prefixes close over them
            kept = np.flatnonzero(first[order] <= c)
            if len(kept):
                prefix = np.minimum.reduceat(prefix[: kept[-1] + 1], np.concatenate(([0], kept[:-1] + 1)))
                order = order[kept]
            else:
                order, prefix = order[:0], prefix[:0]
        if c + 1 in by_last:
            fresh = by_last[c + 1]
            order, prefix = np.concatenate([fresh, order]), np.concatenate([np.zeros(len(fresh), np.int64), prefix])
            by = np.argsort(group[order], kind="stable")
            order, prefix = order[by], prefix[by]
            prefix[np.concatenate(([True], group[order[1:]] != group[order[:-1]]))] = 0
            # an empty suffix shares nothing with what follows it
            after = np.flatnonzero(last[order[:-1]] == c + 1) + 1
            prefix[after] = 0
        key = group[order] * 256 + symbol[order]
        by = np.argsort(key, kind="stable")
        key = key[by]
        same = np.zeros(len(by), bool)
        same[1:] = key[1:] == key[:-1]
        new = np.zeros(len(by), np.int64)
        at = np.flatnonzero(same)
        near = by[at] == by[at - 1] + 1
        new[at[near]] = prefix[by[at[near]]] + 1
        far = at[~near]
        if len(far):
            ends = np.empty(2 * len(far), np.int64)
            ends[0::2], ends[1::2] = by[far - 1] + 1, by[far] + 1
            new[far] = np.minimum.reduceat(np.append(prefix, 0), ends)[0::2] + 1
        order, prefix = order[by], np.minimum(new, length)
        blocks.put(order.astype(np.uint32), prefix.astype(np.uint16))
    blocks.rewind()
    for c, size in zip(range(top - 1, low - 1, -1), blocks.sizes):
        order, prefix = blocks.take(size, np.uint32), blocks.take(size, np.uint16)
        hit = prefix >= length
        hit[:-1] |= hit[1:]
        for t in order[hit]:
            out[t].append(c)
    return [np.array(x[::-1], np.int64) + left[t] for t, x in enumerate(out)]


def _index(column: np.ndarray) -> dict[int, np.ndarray]:
    order = np.argsort(column, kind="stable")
    start, size = groups(column[order])
    return {int(column[order[s]]): order[s : s + n] for s, n in zip(start, size)}


SPAN = "doc_id long, th long, start long, end long"


def _spans(table: pa.Table) -> pa.Table:
    """A bucket of pieces: spans of repeated windows in each document."""
    mins, lefts = table.column("minimizer").to_pylist(), table.column("left").to_pylist()
    docs, hashes, starts = (table.column(c).to_pylist() for c in ("doc_id", "th", "start"))
    one: dict[tuple, int] = {}
    owners: list[list[int]] = []
    names = table.column("name").to_pylist()
    texts = {n: p for n, p in zip(names, table.column("piece").to_pylist()) if p is not None}
    for k, key in enumerate(zip(mins, lefts, names)):
        t = one.setdefault(key, len(one))
        if t == len(owners):
            owners.append([])
        owners[t].append(k)
    keys = list(one)
    shared: dict[int, int] = {}
    for k, mine in zip(keys, owners):
        shared[k[0]] = shared.get(k[0], 0) + len(mine)
    # a piece alone in its group shares nothing; of equal pieces two enter the rounds, as more would add equal rows beside them
    several = [t for t, k in enumerate(keys) if shared[k[0]] > 1]
    entered = several + [t for t in several if len(owners[t]) > 1]
    number = {g: n for n, g in enumerate(sorted({keys[t][0] for t in several}))}
    places = repeated([texts[keys[t][2]] for t in entered], np.array([keys[t][1] for t in entered], np.int64), np.array([number[keys[t][0]] for t in entered], np.int64))
    found = dict(zip(several, places))
    out: list[tuple] = []
    for t, k in enumerate(keys):
        w = found.get(t, ())
        if not len(w):
            continue
        cut = np.flatnonzero(np.concatenate(([True], np.diff(w) > 1)))
        runs = [(int(w[a]), int(w[b - 1]) + 1) for a, b in zip(cut, np.append(cut[1:], len(w)))]
        for o in owners[t]:
            out += [(docs[o], hashes[o], starts[o] + a, starts[o] + b - 1 + LENGTH) for a, b in runs]
    cols = list(zip(*out)) if out else [[], [], [], []]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "th", "start", "end"), cols)})


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs (doc_id, text and th, a hash of the text) and removed: array of (start, end) in bytes, in order and apart."""
    given = F.col(doc_id).cast("long")
    # a join finds no null, so rows without an id go by 0: equal texts have equal spans, whosever they are
    named = docs.select(given.alias("given"), F.coalesce(given, F.lit(0)).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("th"))
    docs = named.drop("given")

    def places(batches):
        table = byte_table(lower=False)
        for batch in batches:
            ids, ths = batch.column(0), batch.column(2)
            for chunk in chunks(batch.column(1), SEGMENT):
                found = list(pieces(chunk.data, chunk.off, table))
                if found:
                    row, start, _, _, h = zip(*found)
                    at = pa.array([chunk.first + r for r in row])
                    yield pa.RecordBatch.from_arrays([ids.take(at), ths.take(at), pa.array(h, pa.int64()), pa.array([s - int(chunk.off[r]) for s, r in zip(start, row)], pa.int64())], names=["doc_id", "th", "minimizer", "start"])

    listed = written(docs.mapInArrow(places, "doc_id long, th long, minimizer long, start long"), "suffix-places")
    counts = listed.groupBy("minimizer").agg(F.count("*").alias("_n")).where("_n > 1")
    marked = listed.join(counts, "minimizer").groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", (F.col("_n") > HOT).alias("hot"))).alias("marks"))
    marked = written(marked, "suffix-marked")
    discard(listed)
    sums = marked.agg(F.sum(F.size("marks")), F.max(F.exists("marks", lambda x: x["hot"]).cast("int"))).first()
    buckets = max(64, -(-(sums[0] or 0) // BUCKET))
    wanted = docs.where(F.octet_length("text") >= LENGTH).join(marked, ["doc_id", "th"])

    def gathered(batches):
        table = byte_table(lower=False)
        for batch in batches:
            ids, ths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            marks = batch.column(3).to_pylist()
            for chunk in chunks(batch.column(2), SEGMENT):
                mine = [{x["start"] for x in marks[chunk.first + r] if not x["hot"]} for r in range(len(chunk))]
                rows, sent = [], set()
                for r, s, n, p, h in pieces(chunk.data, chunk.off, table):
                    at = s - int(chunk.off[r])
                    if at in mine[r]:
                        piece = chunk.data[s : s + n + LENGTH - 1].tobytes()
                        name = hashlib.blake2b(piece, digest_size=16).digest()
                        # equal pieces of a chunk travel once
                        rows.append((h % buckets, h, p - s, name, None if (h, name) in sent else piece, ids[chunk.first + r], ths[chunk.first + r], at))
                        sent.add((h, name))
                for k in range(0, len(rows), 4096):
                    cols = zip(*rows[k : k + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names=["bucket", "minimizer", "left", "name", "piece", "doc_id", "th", "start"])

    def windows(batches):
        tables, power = (byte_table(lower=False), byte_table(lower=False, seed=8)), Powers()
        for batch in batches:
            ids, ths, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
            for chunk in chunks(batch.column(2), SEGMENT):
                pw = power(len(chunk.data) + 1)
                sums = [np.concatenate(([U64(0)], np.cumsum(t[chunk.data] * pw[0][: len(chunk.data)]))) for t in tables]
                mine = [{x["start"] for x in marks[chunk.first + r] if x["hot"]} for r in range(len(chunk))]
                for r, s, n, _, _ in pieces(chunk.data, chunk.off, tables[0]):
                    at = s - int(chunk.off[r])
                    if at in mine[r]:
                        k = np.arange(s, s + n)
                        a, b = (mix((x[k + LENGTH] - x[k]) * pw[1][k]).view(np.int64) for x in sums)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, ids[chunk.first + r]), pa.int64()), pa.array(np.full(n, ths[chunk.first + r]), pa.int64()), pa.array(k - int(chunk.off[r]), pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "th", "start", "a", "b"])

    wanted = wanted.select("doc_id", "th", "text", "marks")
    rows = wanted.mapInArrow(gathered, "bucket int, minimizer long, left int, name binary, piece binary, doc_id long, th long, start long")
    spans, each = rows.groupBy("bucket").applyInArrow(_spans, SPAN), None
    if sums[1]:
        each = written(wanted.where(F.exists("marks", lambda x: x["hot"])).mapInArrow(windows, "doc_id long, th long, start long, a long, b long"), "suffix-windows")
        twice = each.groupBy("a", "b").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
        spans = spans.unionByName(each.join(twice, ["a", "b"]).select("doc_id", "th", "start", (F.col("start") + LENGTH).alias("end")))
    spans = written(spans, "suffix-spans")
    discard(marked)
    if each is not None:
        discard(each)
    removed = spans.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("removed"))
    return named.join(removed, ["doc_id", "th"], "left").select(F.col("given").alias("doc_id"), "text", "th", "removed")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 from repeats(); then the removed bytes' share of the text, and whether there are any."""

    def make():
        def work(batch):
            out = []
            spans = batch.column(batch.schema.get_field_index("removed")).to_pylist()
            for chunk in chunks(batch.column(batch.schema.get_field_index("text"))):
                for r in range(len(chunk)):
                    text = chunk.data[chunk.off[r] : chunk.off[r + 1]].tobytes()
                    runs: list[list[int]] = []
                    for s in spans[chunk.first + r] or []:
                        if runs and s["start"] <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], s["end"])
                        else:
                            runs.append([s["start"], s["end"]])
                    sha, at = hashlib.sha256(), 0
                    for a, b in runs:
                        sha.update(text[at:a])
                        at = b
                    sha.update(text[at:])
                    gone = sum(b - a for a, b in runs)
                    out.append((len(text), gone, len(runs), sha.hexdigest(), gone / max(1, len(text)), bool(runs)))
            return list(zip(*out)) if out else [[] for _ in fields]

        return work

    fields = [(n, pa.int64(), "long") for n in ("n_bytes", "n_removed", "n_spans")] + [("kept_sha256", pa.string(), "string")]
    fields += [("removed_share", pa.float64(), "double"), ("has_repeats", pa.bool_(), "boolean")]
    return annotated(found, make, fields).select("doc_id", *[f[0] for f in fields])
