"""Phrase collocations of each language: counts of all phrases of up to four words, and scores from their parts.

1. Texts are split into pieces; equal pieces of a language become one with a multiplicity.
2. Every place of a piece gives its window, the words from there on (four at most). A
   window counts for all its beginnings, so phrases need one record a place, not one a
   length. Windows are dealt by a hash of their first two words, so all counts of such a
   phrase meet in one part. Pairs (and triples) that hold more than a THOUSANDTH share
   of all places are few; windows that begin with one are dealt by one word more, and the
   pair's own count goes apart, once a chunk. A sketch of a fixed size tells which phrases
   can't be frequent; windows end before those.
3. Each part counts weighted phrases out of core in duckdb: first by 64-bit hashes, which
   loses no frequent phrase, then the texts of those that could be frequent, exactly.
4. Each candidate asks for the counts of its parts; requests are shuffled to where the
   counts are (a join), and answers back by phrase. Scores are whole numbers, in decimals.

Cases: a null text is empty, a null language `und`. Repeated rows count again. Words and
pieces of any length are kept whole. Ties in score go to the larger count, then to the
smaller phrase. An empty table gives no rows. Other columns of the input are ignored.
Windows of a chunk are one if their 64-bit hashes are equal.
"""

from __future__ import annotations

import os
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_1, U64, Chunk, Powers, Words, byte_table, chunks, discard, groups, mix, small_batches, written

LEAST, LONGEST, TOP, COVER = 30, 4, 2000, 80
#: Bytes of different pieces for each part that duckdb counts, the most parts (they grow beyond), and its memory before it uses files.
PART_BYTES, PARTS, MEMORY = 8 << 20, 20_000, "150MB"
#: A beginning with more than this share of all places is dealt by one word more: at most so many are broadcast.
THOUSANDTH = 1000
CHUNK = 2 << 20
#: Counters of the sketch that ends windows early: 2 MB of bits for the tasks, whatever the input.
SKETCH_BITS = 24
BREAKS = np.zeros(256, bool)
BREAKS[[ord(c) for c in ".,;:!?"] + list(range(10, 14))] = True
BLANK = np.zeros(256, bool)
BLANK[[9, 32]] = True
ONLY_SPACE = np.zeros(256, bool)
ONLY_SPACE[32] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
TABLE = byte_table(lower=False, seed=13)
NO_LANG = "und"


def _strings(data: np.ndarray, border: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_utf8(), len(border) - 1, [None, pa.py_buffer(border.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of runs one after another, and their borders."""
    border = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(start - border[:-1], size) + np.arange(border[-1])], border


def chunk_pieces(chunk: Chunk) -> tuple[pa.Array, np.ndarray]:
    """The pieces of a chunk's texts that have words, as these joined by single spaces, and the row of each."""
    data, off = LOWER[chunk.data], chunk.off
    n = len(data)
    stop = BREAKS[data]
    word = ~(stop | BLANK[data])
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    ends[:-1] &= ~word[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        return pa.array([], pa.large_utf8()), np.zeros(0, np.int64)
    # places where a new piece begins, counted up to each word
    number = np.cumsum(stop + edge[:n].astype(np.int64))[start]
    last = np.append(number[1:] != number[:-1], True)
    data = np.append(np.where(word, data, 32), np.uint8(32)).astype(np.uint8)
    flat, border = _gathered(data, start, end - start + ~last)
    joint = np.flatnonzero(~last)
    flat[border[joint + 1] - 1] = 32  # a word may end where another text begins
    first = np.flatnonzero(np.append(True, last[:-1]))
    return _strings(flat, np.append(border[first], border[-1])), np.searchsorted(off, start[first], "right") - 1


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece, m: different pieces of each language and how often each is there."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            lang = batch.column(0).fill_null(NO_LANG).dictionary_encode()
            code = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            for chunk in chunks(batch.column(1), CHUNK):
                found, row = chunk_pieces(chunk)
                found = found.dictionary_encode()
                both, count = np.unique(found.indices.to_numpy().astype(np.int64) * len(lang.dictionary) + code[chunk.first + row], return_counts=True)
                for at in range(0, len(both), 20_000):
                    part = both[at : at + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [lang.dictionary.take(pa.array(part % len(lang.dictionary))), found.dictionary.take(pa.array(part // len(lang.dictionary))).cast(pa.string()), pa.array(count[at : at + 20_000])], names=["lang", "piece", "m"]
                    )

    return docs.select("lang", "text").mapInArrow(run, "lang string, piece string, m long").groupBy("lang", "piece").agg(F.sum("m").alias("m"))


def _lang_hash(names: list[str]) -> np.ndarray:
    """A 64-bit hash of each name, the same in every task."""
    import hashlib

    return np.array([int.from_bytes(hashlib.blake2b((x or "").encode(), digest_size=8).digest(), "little") for x in names], U64)


class Windows:
    """Places of a chunk of pieces: hashes of the 1 to 4 words from there (of as many as there are), and their number."""

    def __init__(self, chunk: Chunk, lang: np.ndarray, powers: Powers):
        w = self.words = Words(chunk, ONLY_SPACE, TABLE, powers(len(chunk.data)))
        self.row = w.row()
        n = len(self.row)
        self.left = np.minimum(w.range[1:][self.row] - np.arange(n), LONGEST)
        self.h = [mix(w.hash ^ lang[self.row])]
        for j in range(1, LONGEST):
            h = self.h[-1].copy()
            at = np.flatnonzero(self.left > j)
            h[at] = mix(h[at] * MIX_1 + w.hash[at + j])
            self.h.append(h)

    def end(self, at: np.ndarray, j) -> np.ndarray:
        return self.words.end[at + j - 1]


def _joined(batches, size: int = CHUNK):
    """Small batches made one, of about `size` bytes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _read(batches, powers: Powers):
    """(chunk, windows, languages of its rows, weights) of batches of lang, piece, m."""
    for batch in _joined(batches):
        lang = batch.column(0).dictionary_encode()
        h, code = _lang_hash(lang.dictionary.to_pylist()), lang.indices.to_numpy()
        m = batch.column(2).to_numpy()
        for chunk in chunks(batch.column(1), CHUNK):
            rows = slice(chunk.first, chunk.first + len(chunk))
            yield chunk, Windows(chunk, h[code[rows]], powers), lang.dictionary, code[rows], m[rows]


def _summed(h: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different hash, and the sum of its weights."""
    order = np.argsort(h, kind="stable")
    start, _ = groups(h[order])
    return order[start], np.add.reduceat(m[order], start) if len(start) else m[:0]


def survey(found: DataFrame, places: int, least: int, bits: int = SKETCH_BITS) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """What one pass over the pieces tells the next: beginnings with more than a thousandth of all places, and a sketch.

    Hashes of those pairs and triples, sorted, by their number of words. The sketch has 2**bits
    counters, to each of which all phrases of two words or more that share a hash's first
    bits add their counts; where a counter stays below `least`, none of them is
    frequent, and windows end before them. It loses no frequent phrase. Its size is fixed:
    with far more phrases than counters it only saves nothing.
    """
    block = 1 << min(16, bits)
    kind = np.uint8 if least < 256 else np.uint32
    names = ["part", "j", "h", "m", "counts"]

    def run(batches):
        powers, counters = Powers(), np.zeros(1 << bits, np.uint16 if least < 256 and bits >= 20 else np.uint64)
        for _, w, _, _, m in _read(batches, powers):
            m = m[w.row]
            for j in range(2, LONGEST + 1):
                at = np.flatnonzero(w.left >= j)
                h = w.h[j - 1][at]
                first, weight = _summed(h, m[at])
                h = h[first]
                np.add.at(counters, (h >> U64(64 - bits)).astype(np.int64), np.minimum(weight, least).astype(counters.dtype))
                np.minimum(counters, least, out=counters)
                if j < LONGEST:
                    much = weight * 2 * THOUSANDTH >= m.sum()
                    k = int(much.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(-1 - (h[much] % U64(64)).astype(np.int64)), pa.array(np.full(k, j), pa.int32()), pa.array(h[much].view(np.int64)), pa.array(weight[much], pa.int64()), pa.nulls(k, pa.binary())], names=names)
        for k in range(0, 1 << bits, block):
            some = counters[k : k + block]
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // block]), pa.array([0], pa.int32()), pa.array([0]), pa.array([0]), pa.array([some.astype(kind).tobytes()], pa.binary())], names=names)

    out_names = ["part", "j", "h", "counts"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # batch by batch: a part has a row of each task that read pieces
        counters, sums, part = np.zeros(block, np.uint64), Counter(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            if part >= 0:
                for x in batch.column("counts").to_pylist():
                    counters += np.frombuffer(x, kind)
            else:
                for j, h, m in zip(*[batch.column(c).to_pylist() for c in ("j", "h", "m")]):
                    sums[j, h] += m
        if part >= 0:
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([0], pa.int32()), pa.array([0]), pa.array([np.packbits(counters >= least).tobytes()], pa.binary())], names=out_names)
        else:
            rows = [x for x, m in sums.items() if m * THOUSANDTH > places]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int64()), pa.array([j for j, _ in rows], pa.int32()), pa.array([h for _, h in rows], pa.int64()), pa.nulls(len(rows), pa.binary())], names=out_names)

    # to the driver: 2**bits bits, and fewer than a thousand hashes of each length
    rows = found.mapInArrow(run, "part long, j int, h long, m long, counts binary").groupBy("part").applyInArrow(summed, "part long, j int, h long, counts binary").collect()
    could = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        if r.part >= 0:
            could[r.part * (block // 8) : (r.part + 1) * (block // 8)] = np.frombuffer(r.counts, np.uint8)
    return {j: np.sort(np.array([r.h for r in rows if r.j == j], np.int64).view(U64)) for j in (2, 3)}, could


def _is_in(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


RECORDS = "bucket long, lang string, size binary, m binary, least binary, text binary"


def records(found: DataFrame, heavy: dict[int, np.ndarray], could: np.ndarray, buckets: int) -> DataFrame:
    """Windows of pieces as blobs by bucket and language: lengths, weights, fewest words a window counts for, texts."""
    shift = U64(64 - (len(could) * 8).bit_length() + 1)

    def may(h: np.ndarray) -> np.ndarray:
        at = (h >> shift).astype(np.int64)
        return could[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 > 0

    def run(batches):
        for chunk, w, names, code, m in _read(batches, Powers()):
            m = m[w.row]
            parts = []  # (bucket's hash, place, words, fewest words, weight)
            first, weight = _summed(w.h[0], m)
            parts.append((w.h[0][first], first, np.ones(len(first), np.int64), 1, weight))
            # a window ends before the first beginning that can't be frequent
            words, whole = np.ones(len(m), np.int64), w.h[0].copy()
            for j in range(2, LONGEST + 1):
                at = np.flatnonzero((words == j - 1) & (w.left >= j))
                at = at[may(w.h[j - 1][at])]
                words[at], whole[at] = j, w.h[j - 1][at]
            at = np.flatnonzero(words >= 2)
            first, weight = _summed(whole[at], m[at])
            first = at[first]
            size = words[first]
            deep2 = _is_in(w.h[1][first], heavy[2])
            depth = np.where(deep2, np.where(_is_in(w.h[2][first], heavy[3]), 4, 3), 2)
            depth = np.minimum(depth, size)
            for j in range(2, LONGEST + 1):
                own = depth == j
                parts.append((w.h[j - 1][first[own]], first[own], size[own], j, weight[own]))
                # beginnings that are counted apart, as their windows are dealt by more words
                over = np.flatnonzero(depth > j)
                k, more = _summed(w.h[j - 1][first[over]], weight[over])
                parts.append((w.h[j - 1][first[over[k]]], first[over[k]], np.full(len(k), j), j, more))
            h, place, size, weight = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2, 4))
            least = np.concatenate([np.full(len(p[0]), p[3], np.uint8) for p in parts])
            key = (h % U64(buckets)).astype(np.int64) * len(names) + code[w.row[place]]
            order = np.lexsort((h, key))
            place, size, weight, least, key = place[order], size[order], weight[order], least[order], key[order]
            start = w.words.start[place]
            flat, border = _gathered(chunk.data, start, w.end(place, size) - start)
            length = np.diff(border).astype(np.uint32)
            run_at, run_n = groups(key)
            ends = run_at + run_n
            blob = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(run_at, ends)], pa.binary())
            texts = pa.array([flat[border[a] : border[b]].tobytes() for a, b in zip(run_at, ends)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(key[run_at] // len(names), pa.int64()), names.take(pa.array(key[run_at] % len(names))), blob(length), blob(weight.astype(np.int64)), blob(least), texts], names=["bucket", "lang", "size", "m", "least", "text"])

    return found.mapInArrow(run, RECORDS)


def _counted(batches, least: int, memory: str):
    """Phrases of one part with their counts: by hash out of core, then the texts of those that could be frequent."""
    import duckdb

    with tempfile.TemporaryDirectory() as folder:
        held, powers, langs, total = os.path.join(folder, "held.arrow"), Powers(), {}, Counter()
        db = duckdb.connect(os.path.join(folder, "counts.duckdb"), config={"threads": 1, "memory_limit": memory, "temp_directory": folder, "preserve_insertion_order": False})
        try:
            db.execute("create table hashes (h ubigint, m bigint)")
            db.execute("create table phrases (lang integer, words utinyint, phrase varchar, m bigint)")
            writer = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                if writer is None:
                    writer = pa.ipc.new_stream(held, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                writer.write_batch(batch)
                for lang, w, m, low, _ in _parts(batch, langs, powers):
                    for j in range(1, LONGEST + 1):
                        at = _counting(w, low, j)
                        if j == 1:
                            for x, n in zip(*_summed(lang[at], m[at])):
                                total[int(lang[at[x]])] += int(n)
                        if len(at):
                            rows = pa.table({"h": pa.array(w.h[j - 1][w.words.range[:-1][at]]), "m": pa.array(m[at])})  # noqa: F841 - read by duckdb
                            db.execute("insert into hashes select h, m from rows")
            if writer is None:
                return
            writer.close()
            known = np.sort(db.execute("select h from hashes group by h having sum(m) >= ?", [least]).fetchnumpy()["h"].astype(U64))
            db.execute("drop table hashes")
            with pa.ipc.open_stream(held) as reader:
                for batch in reader:
                    for lang, w, m, low, data in _parts(batch, langs, powers):
                        for j in range(1, LONGEST + 1):
                            at = _counting(w, low, j)
                            place = w.words.range[:-1][at]
                            good = _is_in(w.h[j - 1][place], known)
                            at, place = at[good], place[good]
                            if len(at):
                                start = w.words.start[place]
                                text = _strings(*_gathered(data, start, w.end(place, j) - start))
                                rows = pa.table({"lang": pa.array(lang[at], pa.int32()), "words": pa.array(np.full(len(at), j, np.uint8)), "phrase": text, "m": pa.array(m[at])})  # noqa: F841
                                db.execute("insert into phrases select lang, words, phrase, m from rows")
            names = pa.array(list(langs), pa.string())
            frequent = db.sql("select lang, words::integer as words, phrase, sum(m)::bigint as f from phrases group by lang, words, phrase having sum(m) >= ?", params=[least]).to_arrow_reader(50_000)
            for b in frequent:
                yield pa.RecordBatch.from_arrays([names.take(b.column(0)), b.column(1), b.column(2).cast(pa.string()), b.column(3)], names=["lang", "words", "phrase", "f"])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(list(total), pa.int32())), pa.array([0] * len(total), pa.int32()), pa.array([""] * len(total)), pa.array(list(total.values()), pa.int64())], names=["lang", "words", "phrase", "f"])
        finally:
            db.close()


def _parts(batch, langs: dict, powers: Powers):
    """The records of a batch of blobs: language numbers, hashes, weights, fewest words, bytes; rows in runs of a bounded size."""
    names = batch.column(1).to_pylist()
    sizes = np.array([len(x) for x in batch.column(5).to_pylist()], np.int64)
    number = np.array([langs.setdefault(x, len(langs)) for x in names], np.int64)
    hashes = _lang_hash(names)
    at = 0
    while at < len(names):
        end = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK, "right")) + at)
        one = lambda c, kind: np.frombuffer(b"".join(batch.column(c).slice(at, end - at).to_pylist()), kind)  # noqa: E731, B023
        length, data = one(2, np.uint32).astype(np.int64), one(5, np.uint8)
        many = [len(x) // 4 for x in batch.column(2).slice(at, end - at).to_pylist()]
        chunk = Chunk(0, data, np.concatenate([[0], np.cumsum(length)]))
        w = Windows(chunk, np.repeat(hashes[at:end], many), powers)
        yield np.repeat(number[at:end], many), w, one(3, np.int64), one(4, np.uint8), data
        at = end


def _counting(w: Windows, low: np.ndarray, j: int) -> np.ndarray:
    """Records that count for phrases of j words."""
    return np.flatnonzero((low <= j) & (np.diff(w.words.range) >= j))


def frequent_phrases(docs: DataFrame, least: int = LEAST, memory: str = MEMORY) -> DataFrame:
    """lang, words, phrase, f of all phrases of 1 to 4 words that occur `least` times; rows of 0 words add up to a language's words."""
    found = written(pieces(docs), "pieces")
    words = F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1
    size, places = found.agg(F.coalesce(F.sum(F.octet_length("piece")), F.lit(0)), F.coalesce(F.sum(F.col("m") * words), F.lit(0))).first()
    parts = max(1, min(PARTS, size // PART_BYTES))
    # several buckets a part even out small numbers of parts
    out = records(found, *survey(found, places, least), max(parts, min(4 * parts, 4000))).repartition(parts, "bucket")
    out = written(out.mapInArrow(lambda batches: _counted(batches, least, memory), "lang string, words int, phrase string, f long"), "phrases")
    discard(found)
    return out


def _decimal(c: str) -> str:
    return f"cast({c} as decimal(20,0))"


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score of every candidate: its lowest-scoring cut."""
    c = phrases.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    w = F.split("phrase", " ")
    cut = lambda k, first: F.struct(F.lit(k).alias("k"), F.lit(first).alias("first"), F.array_join(F.slice(w, 1, k) if first else F.slice(w, F.lit(k + 1), F.col("words") - k), " ").alias("part"))
    asked = F.filter(F.array(*[F.when(F.col("words") > k, cut(k, first)) for k in range(1, LONGEST) for first in (True, False)]), lambda x: x.isNotNull())
    requests = c.select("lang", "phrase", "words", "a", F.inline(asked))
    counts = phrases.where("words between 1 and 3").select("lang", F.col("phrase").alias("part"), "f")
    answers = requests.join(counts, ["lang", "part"])
    of = lambda k, first: F.max(F.when((F.col("k") == k) & (F.col("first") == first), F.col("f"))).alias(f"{'l' if first else 'r'}{k}")
    both = answers.groupBy("lang", "phrase", "words", "a").agg(*[of(k, first) for k in range(1, LONGEST) for first in (True, False)])
    # exact: a * 2,000,000 may pass 64 bits
    score = lambda k: F.expr(f"(cast(2000000 as decimal(7,0)) * {_decimal('a')}) div ({_decimal(f'l{k}')} + {_decimal(f'r{k}')})")
    best = F.array_min(F.filter(F.array(*[F.when(F.col("words") > k, F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, LONGEST)]), lambda x: x.isNotNull()))
    return both.withColumn("_b", best).select("lang", "phrase", "words", "a", F.col("_b.l").alias("l"), F.col("_b.r").alias("r"), F.col("_b.score").alias("score"))


def covered(phrases: DataFrame) -> DataFrame:
    """lang, phrase, most: the largest count of a longer candidate that holds the phrase."""
    w = F.split("phrase", " ")
    parts = [F.when(F.col("words") >= i + n, F.array_join(F.slice(w, i + 1, n), " ")) for n in range(2, LONGEST) for i in range(LONGEST - n + 1)]
    inner = F.array_distinct(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != F.col("phrase"))))
    return phrases.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, cover: int = COVER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` candidates of each language of docs (lang, text)."""
    from pyspark.sql import Window

    phrases = frequent_phrases(docs, least)
    total = phrases.where("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    c = scored(phrases).join(covered(phrases), ["lang", "phrase"], "left")
    c = c.where(F.col("most").isNull() | F.expr(f"100 * {_decimal('most')} < {cover} * {_decimal('a')}"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    c = c.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return c.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
