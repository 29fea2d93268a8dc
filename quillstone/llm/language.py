"""Language identification by a byte convolutional network, trained in numpy.

Texts are cut into windows of WINDOW bytes, one beside the other over the whole text
(the last is padded). Filters of several widths slide over a window's bytes; each
filter's largest response goes to a softmax over the learned languages. A text's
probabilities are the mean of its windows', weighted by their letters' bytes.

Training uses a bounded sample: at most `sample` documents' ids (by their hash) and
`windows` windows of each, evenly spread over the whole text. A row of the first
layer is a table of responses to one byte at one place of a filter, so a
convolution over one-hot bytes is a sum of table rows; pairs of places share one
table of 65,536 rows when the model is applied.

A null text, or one without letters, is `und` with score 0. A very long text is
windows of one row, none left out. Repeated rows are answered each; ids with equal
hashes are taken in order of the id; of equally likely languages the first by name is
said. With no labelled row everything is `und`; an empty table gives no rows. Columns
of docs named lang_pred or lang_score give way to the results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import annotated, chunks, release

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 8
SAMPLE, WINDOWS = 3000, 6
LEAST_STEPS = 300
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


def place_windows(off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and first bytes of all windows of the texts."""
    count = -(-np.diff(off) // WINDOW)
    row = np.repeat(np.arange(len(count)), count)
    k = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count)
    return row, off[:-1][row] + k * WINDOW


def bytes_of(data: np.ndarray, off: np.ndarray, row: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The windows' bytes, those past a text's end 0."""
    at = start[:, None] + np.arange(WINDOW)
    past = at >= off[1:][row][:, None]
    at[past] = 0
    x = data[at] if len(data) else np.zeros(at.shape, np.uint8)
    x[past] = 0
    return x


class ByteNet:
    """Filters, max pooling and softmax. Every array is small: the model is a few hundred kB."""

    def __init__(self, labels: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.filters = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.dense = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.offset = np.zeros(len(labels), np.float32)
        self.pairs = None

    def features(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Pooled responses of each window, and where each was largest."""
        pooled, where = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias):
            n = WINDOW - w + 1
            y = f[0][x[:, :n]]
            for j in range(1, w):
                y += f[j][x[:, j : j + n]]
            at = y.argmax(1)
            pooled.append(np.maximum(np.take_along_axis(y, at[:, None], 1)[:, 0] + b, 0))
            where.append(at)
        return np.concatenate(pooled, 1), where

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.004, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        params = [*self.filters, *self.bias, self.dense, self.offset]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        # a window in three is cut short, as short texts and texts' ends are
        short = rng.random(len(x)) < 1 / 3
        x = np.where(short[:, None] & (np.arange(WINDOW) >= rng.integers(8, WINDOW, len(x))[:, None]), 0, x).astype(np.uint8)
        for _ in range(max(epochs, -(-LEAST_STEPS * batch // len(x)))):
            order = rng.permutation(len(x))
            for s in range(0, len(x), batch):
                i = order[s : s + batch]
                pooled, where = self.features(x[i])
                p = softmax(pooled @ self.dense + self.offset)
                p[np.arange(len(i)), y[i]] -= 1
                p /= len(i)
                back = (p @ self.dense.T) * (pooled > 0)
                grads: list[np.ndarray] = []
                biases = []
                for k, w in enumerate(WIDTHS):
                    g = np.zeros_like(self.filters[k])
                    d = back[:, k * FILTERS : (k + 1) * FILTERS]
                    cols = np.broadcast_to(np.arange(FILTERS), d.shape)
                    for j in range(w):
                        np.add.at(g[j], (np.take_along_axis(x[i], where[k] + j, 1), cols), d)
                    grads.append(g)
                    biases.append(d.sum(0))
                grads += [*biases, pooled.T @ p, p.sum(0)]
                step += 1
                for q, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def ready(self) -> ByteNet:
        """Builds the tables of byte pairs."""
        both = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        self.pairs = [(both(f[0], f[1]), both(f[2], f[3]) if w == 4 else f[2] if w == 3 else None) for w, f in zip(WIDTHS, self.filters)]
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        two = x[:, :-1].astype(np.uint16) * np.uint16(256) + x[:, 1:]
        pooled = []
        for w, (a, b), bias in zip(WIDTHS, self.pairs, self.bias):
            n = WINDOW - w + 1
            y = np.take(a, two[:, :n], 0)
            if b is not None:
                y += np.take(b, two[:, 2 : 2 + n] if w == 4 else x[:, 2 : 2 + n], 0)
            pooled.append(np.maximum(y.max(1) + bias, 0))
        return softmax(np.concatenate(pooled, 1) @ self.dense + self.offset)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def spread(off: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and first bytes of at most `windows` windows of each text, evenly over the whole of it."""
    row, start = place_windows(off)
    count = -(-np.diff(off) // WINDOW)
    nth = (start - off[:-1][row]) // WINDOW
    pick = (count[row] <= windows) | ((nth * windows) // count[row] != ((nth - 1) * windows) // count[row])
    return row[pick], start[pick]


def train(rows: list[tuple[str | bytes, str]], windows: int = WINDOWS) -> ByteNet | None:
    """A network from (text or UTF-8 bytes, language); None if none has a letter."""
    raw = [(t if isinstance(t, bytes) else (t or "").encode(), lang) for t, lang in rows]
    raw = [(t, lang) for t, lang in raw if any(c.isalpha() for c in t.decode("utf-8", "ignore"))]
    if not raw:
        return None
    labels = sorted({lang for _, lang in raw})
    off = np.concatenate(([0], np.cumsum([len(t) for t, _ in raw])))
    data = np.frombuffer(b"".join(t for t, _ in raw), np.uint8)
    row, start = spread(off, windows)
    net = ByteNet(labels)
    net.fit(bytes_of(data, off, row, start), np.array([labels.index(lang) for _, lang in raw])[row])
    del raw, data
    release()  # the driver keeps the network only
    return net


def labelled_sample(docs: DataFrame, sample: int = SAMPLE, windows: int = WINDOWS) -> list[tuple[bytes, str]]:
    """(window, lang) of at most `sample` documents that training may see, by the hash of their id. Only windows go to the driver, however long the texts."""
    good = docs.where("doc_id is not null and text is not null and lang is not null").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    ids = good.select("doc_id").distinct().orderBy(F.xxhash64(F.lit(41), "doc_id"), "doc_id").limit(sample)
    rows = good.select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id")  # bounded by sample

    def cut(batches):
        for batch in batches:
            lang = batch.column(batch.schema.get_field_index("lang"))
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for chunk in chunks(batch.column(batch.schema.get_field_index("text"))):
                row, start = spread(chunk.off, windows)
                at = pa.array(chunk.first + row)
                ends = np.minimum(start + WINDOW, chunk.off[1:][row])
                yield pa.RecordBatch.from_arrays([ids.take(at), pa.array([chunk.data[a:b].tobytes() for a, b in zip(start, ends)], pa.binary()), lang.take(at)], names=["doc_id", "w", "lang"])

    # however many rows an id has, it gives no more windows than one text
    own = Window.partitionBy("doc_id").orderBy("w", "lang")
    found = rows.mapInArrow(cut, "doc_id long, w binary, lang string").withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= windows).drop("_n").collect()
    return sorted((bytes(r[1]), r[2]) for r in found)


def identified(docs: DataFrame, net: ByteNet | None, text: str = "text") -> DataFrame:
    """docs and lang_pred, lang_score (the mean probability of that language)."""

    def make():
        ready = net.ready() if net else None

        def work(batch):
            names, scores = [], []
            for chunk in chunks(batch.column(batch.schema.get_field_index(text)), 1 << 20):
                data, off = chunk.data, chunk.off
                n = len(chunk)
                letters = np.concatenate(([0], np.cumsum(LETTER[data])))
                has = letters[off[1:]] > letters[off[:-1]]
                for r in np.flatnonzero(~has):
                    has[r] = any(c.isalpha() for c in bytes(data[off[r] : off[r + 1]]).decode("utf-8", "replace"))
                if ready is None:
                    names += ["und"] * n
                    scores += [0.0] * n
                    continue
                row, start = place_windows(off)
                sums = np.zeros((n, len(ready.labels)))
                for s in range(0, len(row), 512):
                    r, a = row[s : s + 512], start[s : s + 512]
                    p = ready.probabilities(bytes_of(data, off, r, a))
                    weight = letters[np.minimum(a + WINDOW, off[1:][r])] - letters[a] + 1.0
                    np.add.at(sums, r, p * weight[:, None])
                best = sums.argmax(1)
                total = sums.sum(1)
                top = np.where(total > 0, sums[np.arange(n), best] / np.where(total > 0, total, 1), 0)
                names += [ready.labels[b] if h else "und" for b, h in zip(best, has)]
                scores += np.where(has, np.minimum(top, 1.0), 0.0).tolist()
            return names, scores

        return work

    return annotated(docs, make, [("lang_pred", pa.string(), "string"), ("lang_score", pa.float64(), "double")])


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
