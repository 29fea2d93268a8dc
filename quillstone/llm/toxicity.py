"""Toxicity by a linear classifier with a counterfactual penalty.

Features are the distinct words of the whole text and the first 4 to 7 bytes of
each word (a stem under any ending), by 32-bit hashes; those that fewer than LEAST_ROWS rows of the sample have are left out. Besides the log loss, training makes for each labelled text
that holds an identity term a copy whose terms are swapped for others of the same
group, and penalises the squared difference of the two scores. Terms then carry
little weight of their own, so neutral mentions of groups aren't taken for abuse.

Training uses at most `sample` labelled rows (by the hash of their id). The
features of that sample, not its texts, go to the driver, packed in arrays that
both fits share. A constant is added to the scores, so 0.3 is the cut that gives
the best F1 on rows kept from training. Null and empty texts are scored by the
bias alone; repeated rows each get the same score, and an id with several labels
counts as toxic if one says so; rows with equal hashes of ids go by the id. A very
long text is one row of a chunk of its own. Without labelled rows, or with an
empty table of them, every score is the prior 0.05; an empty table of documents
gives no rows. A column of docs named toxicity gives way to the score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCT, U64, Chunk, Powers, Words, annotated, byte_table, chunks, text_buffer

LEAST_ROWS = 3
PREFIXES = (4, 5, 6, 7)
SAMPLE = 12_000
CUT = 0.3
#: Identity terms, by group; a swap stays in its group.
IDENTITY = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "african", "european"],
    ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["immigrants", "refugees", "foreigners", "citizens"],
    ["frauen", "männer", "mujeres", "hombres", "femmes", "hommes"],
]


def word_hashes(terms: list[str]) -> np.ndarray:
    """Hashes of words as Words makes them."""
    flat = "\n".join(terms).encode()
    return Words(Chunk(0, np.frombuffer(flat, np.uint8), np.array([0, len(flat)])), PUNCT, byte_table(), Powers()(len(flat) + 1)).hash


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (row, feature)."""
    row, parts = words.row().astype(np.uint64) << U64(32), []
    parts.append(row | (words.hash >> U64(32)))
    for k in PREFIXES:
        at, h = words.prefixes(k)
        parts.append(row[at] | (h >> U64(32)))
    key = np.unique(np.concatenate(parts))
    return (key >> U64(32)).astype(np.int64), (key & U64(0xFFFFFFFF)).astype(np.uint32)


def swapped(words: Words, seed: int) -> np.ndarray:
    """The words' hashes with identity terms swapped."""
    out = words.hash.copy()
    rng = np.random.default_rng(seed)
    for group in IDENTITY:
        terms = word_hashes(group)
        for k, t in enumerate(terms):
            at = np.flatnonzero(words.hash == t)
            if len(at):
                out[at] = terms[(k + rng.integers(1, len(terms), len(at))) % len(terms)]
    return out


BLOCK_ROWS = 1_024


def _summed(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of each run of values between borders; 0 for empty runs."""
    out = np.zeros(len(off) - 1)
    full = np.flatnonzero(np.diff(off))
    if len(full):
        out[full] = np.add.reduceat(values, off[:-1][full])
    return out


class Sparse:
    """Rows of column numbers, as one array and the rows' borders, and the same by column; 32 bits each."""

    def __init__(self, flat: np.ndarray, off: np.ndarray, columns: int):
        self.flat, self.off, self.columns = flat, off, columns
        row = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
        self.row = row[np.argsort(flat, kind="stable")]
        self.border = np.concatenate(([0], np.cumsum(np.bincount(flat, minlength=columns))))

    @staticmethod
    def named(flat: np.ndarray, off: np.ndarray, names: np.ndarray) -> Sparse:
        """From sorted feature names, those given alone; by blocks of rows, so little is needed besides."""
        parts, size = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for s in range(0, len(off) - 1, BLOCK_ROWS):
            border = off[s : s + BLOCK_ROWS + 1]
            part = flat[border[0] : border[-1]]
            at = np.minimum(np.searchsorted(names, part), len(names) - 1).astype(np.int32)
            good = names[at] == part
            parts.append(at[good])
            size.append(np.diff(np.concatenate(([0], np.cumsum(good)))[border - border[0]]))
        return Sparse(np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(size)))), len(names))

    def part(self, rows: np.ndarray) -> Sparse:
        """Those rows (in order) alone."""
        wanted = np.zeros(len(self.off) - 1, bool)
        wanted[rows] = True
        size = np.diff(self.off)
        return Sparse(self.flat[np.repeat(wanted, size)], np.concatenate(([0], np.cumsum(size[wanted]))), self.columns)

    def scores(self, weight: np.ndarray) -> np.ndarray:
        return _summed(weight.astype(np.float32)[self.flat], self.off)

    def back(self, d: np.ndarray) -> np.ndarray:
        return _summed(d.astype(np.float32)[self.row], self.border)


class Sample:
    """Labelled rows: features (flat, off), those of the swapped texts of the rows `changed` alone (flat, off), labels."""

    def __init__(self, own: tuple[np.ndarray, np.ndarray], swapped: tuple[np.ndarray, np.ndarray], changed: np.ndarray, y: np.ndarray):
        self.y, self.changed = y, changed
        # names counted as if each row came with its copy, which is the row itself where nothing is swapped
        names, count = np.unique(own[0], return_counts=True)
        count *= 2
        for flat, sign in ((own[0][np.repeat(np.isin(np.arange(len(y)), changed), np.diff(own[1]))], -1), (swapped[0], 1)):
            more, n = np.unique(flat, return_counts=True)
            at = np.minimum(np.searchsorted(names, more), max(0, len(names) - 1))
            known = names[at] == more if len(names) else np.zeros(0, bool)
            count[at[known]] += sign * n[known]
        names = names[count >= 2 * LEAST_ROWS]
        self.names = names if len(names) else np.zeros(1, np.uint32)
        self.x, self.other = Sparse.named(*own, self.names), Sparse.named(*swapped, self.names)

    @staticmethod
    def of(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Sample:
        """From (features, features of the swapped text, label)."""
        packed = lambda parts: (np.concatenate([np.zeros(0, np.uint32), *parts]).astype(np.uint32), np.cumsum([0, *map(len, parts)]))
        changed = [k for k, r in enumerate(rows) if not np.array_equal(r[0], r[1])]
        return Sample(packed([r[0] for r in rows]), packed([rows[k][1] for k in changed]), np.array(changed, np.int64), np.array([r[2] for r in rows], float))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Classifier:
    """Feature names (sorted) and weights, bias, and the constant that puts the best cut at CUT."""

    def __init__(self, names: np.ndarray, weight: np.ndarray, bias: float, shift: float):
        self.names, self.weight, self.bias, self.shift = names, weight, float(bias), float(shift)

    def sums(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        if not len(self.names) or not len(row):
            return np.zeros(rows)
        at = np.minimum(np.searchsorted(self.names, feature), len(self.names) - 1)
        return np.bincount(row, np.where(self.names[at] == feature, self.weight[at], 0), rows)

    def logit(self, sums: np.ndarray) -> np.ndarray:
        return sums + self.bias + self.shift


def fit(sample: Sample, rows: np.ndarray, fairness: float, decay: float, steps: int) -> Classifier:
    """Full-batch Adam on log loss, counterfactual penalty and an L2 term, on these rows of the sample; no constant yet."""
    y = sample.y[rows]
    copies = np.flatnonzero(np.isin(sample.changed, rows))
    whole = len(rows) == len(sample.y)
    x = sample.x if whole else sample.x.part(rows)
    other = sample.other if whole else sample.other.part(copies)
    mine = np.searchsorted(rows, sample.changed[copies])  # both in order
    pos = y.mean()
    bias = np.log(pos / (1 - pos))
    cost = np.where(y > 0, 0.5 / pos, 0.5 / (1 - pos))
    weight, m, v = (np.zeros(len(sample.names)) for _ in range(3))
    n = len(y)
    for step in range(1, steps + 1):
        s = x.scores(weight)
        d = cost * (sigmoid(s + bias) - y) / n
        bias -= 0.05 * d.sum()
        g = decay * weight
        if len(copies):
            gap = 2 * fairness * (s[mine] - other.scores(weight)) / n
            d[mine] += gap
            g -= other.back(gap)
        g += x.back(d)
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        weight -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return Classifier(sample.names, weight, bias, 0)


def train(sample: Sample | list[tuple[np.ndarray, np.ndarray, int]], fairness: float = 1.0, decay: float = 2e-4, steps: int = 150, folds: int = 3) -> Classifier:
    """A labelled sample (or its rows: features, features of the swapped text, label). The cut is the one of best F1 on rows that a model of the other folds hasn't seen."""
    if isinstance(sample, list):
        sample = Sample.of(sample)
    y = sample.y
    if not len(y) or y.min() == y.max():
        p = 0.05 if not len(y) else 0.95 if y[0] else 0.05
        return Classifier(np.zeros(0, np.uint32), np.zeros(0), np.log(p / (1 - p)), 0)
    every = np.arange(len(y))
    model = fit(sample, every, fairness, decay, steps)
    learn, kept = every[every % folds > 0], every[every % folds == 0]
    if len(set(y[learn])) < 2 or not y[kept].any():
        learn = kept = every
    half = fit(sample, learn, fairness, decay, steps)
    t, z = y[kept], sample.x.part(kept).scores(half.weight) + half.bias
    order = np.argsort(-z, kind="stable")
    f1 = 2 * np.cumsum(t[order]) / (np.arange(1, len(t) + 1) + t.sum())
    # of cuts about as good as the best the lowest: more is caught at the same price
    k = int(np.flatnonzero(f1 >= f1.max() - 0.0005)[-1])
    model.shift = np.log(CUT / (1 - CUT)) - (z[order[k]] + z[order[min(k + 1, len(t) - 1)]]) / 2
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Sample:
    """Features of at most `sample` labelled rows that training may see."""
    # text stays out of the join of ids, so only the sample's texts are read for features
    ids = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("_toxic")).orderBy(F.xxhash64(F.lit(43), "doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # bounded by sample

    def make():
        power, table = Powers(), byte_table()

        def work(batch):
            a, b = [], []
            for chunk in chunks(batch.column(batch.schema.get_field_index("text"))):
                words = Words(chunk, PUNCT, table, power(len(chunk.data) + 1))
                for out in (a, b):
                    r, f = features(words)
                    at = np.searchsorted(r, np.arange(len(chunk) + 1))
                    out += [f[at[i] : at[i + 1]].tobytes() for i in range(len(chunk))]
                    words.hash = swapped(words, 3)
            return a, [y if x != y else None for x, y in zip(a, b)]  # null: nothing was swapped

        return work

    found = annotated(rows, make, [("_a", pa.binary(), "binary"), ("_b", pa.binary(), "binary")]).select("doc_id", "_a", "_b", "_toxic").toArrow().combine_chunks()
    found = found.take(pc.sort_indices(found, [("doc_id", "ascending"), ("_a", "ascending")]))
    has = found.column("_b").is_valid()
    changed = np.flatnonzero(has.to_numpy())
    y = (found.column("_toxic").to_numpy() > 0).astype(float)
    own, other = _packed(found.column("_a")), _packed(found.column("_b").filter(has))
    return Sample(own, other, changed, y)


def _packed(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """One array of a binary column's 32-bit names, and the rows' borders."""
    data, off = text_buffer(column)
    return np.frombuffer(data[off[0] : off[-1]].tobytes(), np.uint32), (off - off[0]) // 4


def scored(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """docs and toxicity, from 0 to 1."""

    def make():
        power, table = Powers(), byte_table()

        def work(batch):
            out = []
            for chunk in chunks(batch.column(batch.schema.get_field_index(text))):
                r, f = features(Words(chunk, PUNCT, table, power(len(chunk.data) + 1)))
                out += sigmoid(model.logit(model.sums(r, f, len(chunk)))).tolist()
            return (out,)

        return work

    return annotated(docs, make, [("toxicity", pa.float64(), "double")])


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= CUT).cast("int").alias("predicted"),
    )
