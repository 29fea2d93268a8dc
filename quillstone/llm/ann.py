"""Approximate nearest neighbours by score-aware quantisation.

Vectors are coded by a product quantiser of 4 bits a subspace. Codes and codebooks
are fitted so that the part of the residual parallel to the vector costs `weight`
times the part across it: it is the parallel part that moves a large inner
product. A query makes a table of 16 inner products for each subspace; two
subspaces share a table of 256, so a scan of coded vectors is one look-up and
addition for each byte. The best `rerank` of a group by that sum are scored again
on the original vectors in double precision; the kth of these scores is one that the
group's k nearest reach.

An exact check follows, as codes tell little of vectors that the sample did not show
(outliers) or that lie closer than codewords (tight clusters): a vector's residual r is
known, so its inner product differs from the sum by at most |q| |r|. All vectors that
may reach the kth score by this bound are scored too, so no near one is missed,
whatever the data; on data that suit the codes these are few. The residual along the
mean vector is held exactly and taken out of the bound, or a common offset of all
vectors would widen it.

The quantiser is fitted on a bounded sample (by the hash of the id); every row is coded
once. Codes (four bits a component), vectors, ids and hashes of vectors, dealt to groups
of bounded size, meet blocks of queries; nothing is broadcast but the codebooks and the
mean, whose size is fixed. Every query scans all codes, and a group returns its k nearest.
Equal vectors of a group share a place in its ranking, so ties go to the smaller ids.

Vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part; rows with a null id neither. A query's own id is no candidate of
it. Rows of one id with equal vectors count once, with different ones each; a query with
several has its least. With fewer than k candidates all come back; an empty table gives
no rows; other columns, whatever their names, take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import groups

K, EVERY = 20, 20
#: Vectors of a group (at least GROUPS of them, so a small table is no single task) and queries of a block, if no wider than WIDTH.
SHARD, GROUPS, QUERIES, WIDTH = 65_536, 8, 131_072, 64
SAMPLE, ROUNDS = 8_192, 8
PER_SUBSPACE, CENTRES = 1, 16
WEIGHT = 4.0
#: Candidates of a query in a group that are scored on vectors before the bound is known.
RERANK = 40
#: Of a group's vectors within the bound of a query, the share from which all are scored at once, and vectors scored at once.
DENSE, SCORED = 0.25, 8_192


def directions(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component is taken out first, as squares may be beyond a float's range."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Quantiser:
    """books: (subspaces, 16, width) codewords."""

    def __init__(self, dim: int, books: np.ndarray | None = None):
        self.dim, self.books = dim, books
        self.subspaces = -(-dim // PER_SUBSPACE)

    def parts(self, x: np.ndarray) -> np.ndarray:
        """x as (rows, subspaces, width), padded by zeros."""
        y = np.zeros((len(x), self.subspaces * PER_SUBSPACE))
        y[:, : self.dim] = x
        return y.reshape(len(x), self.subspaces, PER_SUBSPACE)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes that minimise |r|^2 + (WEIGHT - 1) (r . x/|x|)^2, a subspace at a time."""
        p = self.parts(x)
        u = self.parts(directions(x))
        codes = np.empty((len(x), self.subspaces), np.uint8)
        parallel = np.zeros((len(x), self.subspaces))
        for sweep in range(sweeps + 1):
            whole = parallel.sum(1)
            for m in range(self.subspaces):
                r = p[:, m, None, :] - self.books[m][None]
                along = np.einsum("ncd,nd->nc", r, u[:, m])
                cost = (r * r).sum(2)
                if sweep:
                    rest = whole - parallel[:, m]
                    cost += (WEIGHT - 1) * (rest[:, None] + along) ** 2
                best = cost.argmin(1)
                codes[:, m] = best
                new = along[np.arange(len(x)), best]
                whole += new - parallel[:, m]
                parallel[:, m] = new
        return codes

    def fit(self, x: np.ndarray, seed: int = 9) -> Quantiser:
        rng = np.random.default_rng(seed)
        p = self.parts(x)
        u = self.parts(directions(x))
        self.books = np.stack([p[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES), m] for m in range(self.subspaces)])
        for _ in range(ROUNDS):
            codes = self.encode(x, 1)
            along = np.einsum("nmd,nmd->nm", p - self.books[np.arange(self.subspaces)[None], codes], u)
            whole = along.sum(1)
            for m in range(self.subspaces):
                rest = whole - along[:, m]
                for c in range(CENTRES):
                    i = codes[:, m] == c
                    if not i.any():
                        self.books[m, c] = p[rng.integers(len(x)), m]
                        continue
                    v, w = p[i, m], u[i, m]
                    left = i.sum() * np.eye(PER_SUBSPACE) + (WEIGHT - 1) * w.T @ w
                    right = v.sum(0) + (WEIGHT - 1) * (w * (rest[i] + (v * w).sum(1))[:, None]).sum(0)
                    self.books[m, c] = np.linalg.solve(left, right)
        return self

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, bytes, 256): inner products with both codewords of a byte."""
        t = np.einsum("qmd,mcd->qmc", self.parts(q), self.books)
        if self.subspaces % 2:
            t = np.concatenate([t, np.zeros_like(t[:, :1])], 1)
        return (t[:, 0::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), -1, 256).astype(np.float32)

    def bytes_of(self, codes: np.ndarray) -> np.ndarray:
        if codes.shape[1] % 2:
            codes = np.concatenate([codes, np.zeros_like(codes[:, :1])], 1)
        return (codes[:, 0::2] << 4 | codes[:, 1::2]).astype(np.uint8)


def scan(tables: np.ndarray, coded: np.ndarray) -> np.ndarray:
    """(queries, vectors) approximate inner products; coded by byte first."""
    out = np.zeros((len(tables), coded.shape[1]), np.float32)
    for b in range(len(coded)):
        out += np.take(tables[:, b], coded[b], 1)
    return out


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row by row inner products in double precision, added component by component."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * v[:, d]
    return out


def decoded(model: Quantiser, code: np.ndarray) -> np.ndarray:
    """The vectors that packed codes stand for."""
    half = np.stack([code >> 4, code & 15], 2).reshape(len(code), -1)[:, : model.subspaces]
    return model.books[np.arange(model.subspaces)[None], half].reshape(len(code), -1)[:, : model.dim]


def rounding(dim: int, kind: type) -> float:
    """The share of |q| |v| by which an inner product in that arithmetic may be off, with room to spare."""
    return 4 * (dim + 8) * float(np.finfo(kind).eps)


def search(model: Quantiser, mean: np.ndarray, q_id: np.ndarray, q: np.ndarray, v_id: np.ndarray, v: np.ndarray, code: np.ndarray, name: np.ndarray, k: int, most: int):
    """The k nearest of one group for each query: query ids, vector ids, scores. mean: a direction of length 1."""
    order = np.lexsort((v_id, name))
    v_id, name = v_id[order], name[order]
    first = np.ones(len(name), bool)  # a row that repeats counts once
    first[1:] = (name[1:] != name[:-1]) | (v_id[1:] != v_id[:-1])
    order, v_id, name = order[first], v_id[first], name[first]
    start, size = groups(name)
    v, code = v[order[start]], code[order[start]]
    # ids of each distinct vector, smallest first; more than k + 1 can't be among the k nearest
    size = np.minimum(size, k + 1)
    # all in one scale, so that no square is beyond a float's range
    pieces = [slice(a, a + SCORED) for a in range(0, len(v), SCORED)]
    scale = max(max(np.abs(v[p]).max(), np.abs(decoded(model, code[p])).max()) for p in pieces)
    scaled = lambda rows: v[rows].astype(float) / scale
    along, across, long = (np.empty(len(v)) for _ in range(3))
    for p in pieces:
        x, y = scaled(p), decoded(model, code[p]) / scale
        r = x - y
        along[p] = r @ mean
        across[p] = np.linalg.norm(r - np.outer(along[p], mean), axis=1)
        long[p] = np.linalg.norm(x, axis=1) + np.linalg.norm(y, axis=1)
    slack, fine = long * rounding(model.dim, np.float32) + 1e-36, long * rounding(model.dim, np.float64) + 1e-300
    coded = np.ascontiguousarray(code.T)
    small = Quantiser(model.dim, model.books / scale)
    top = min(max(most, k + 1), len(start))

    def kth(score: np.ndarray, rows: np.ndarray, own: int) -> float:
        """A score that k other rows reach."""
        score = (score - fine[rows])[(size[rows] > 1) | (v_id[start[rows]] != own)]
        return np.partition(score, len(score) - k)[-k] if len(score) >= k else -np.inf

    out = []
    step = max(1, min(128, (8 << 20) // len(start)))
    for s in range(0, len(q), step):
        ids, x = q_id[s : s + step], q[s : s + step]
        unit, most_of = directions(x), np.abs(x).max(1)
        part = unit @ mean
        rest = np.linalg.norm(unit - np.outer(part, mean), axis=1)
        near = scan(small.tables(unit), coded) + np.outer(part, along).astype(np.float32)
        pick = np.argpartition(-near, top - 1, 1)[:, :top] if top < len(start) else np.broadcast_to(np.arange(len(start)), near.shape)
        found = []
        for i in range(len(ids)):
            # products near a double's limits tie where scaled ones don't
            plain = 1e-280 < scale * most_of[i] < 1e280
            least = kth(scaled(pick[i]) @ unit[i], pick[i], ids[i]) if plain else -np.inf
            # what may reach that score by the bound
            cand = np.flatnonzero(~(near[i] + rest[i] * across + slack < least))
            if len(cand) > DENSE * len(start):
                score = np.concatenate([scaled(p) @ unit[i] for p in pieces])[cand]
            else:
                score = scaled(cand) @ unit[i]
            least = kth(score, cand, ids[i]) if plain else -np.inf
            found.append(cand[score + fine[cand] >= least])
        row, vec = np.repeat(np.arange(len(ids)), [len(c) for c in found]), np.concatenate(found)
        score = np.concatenate([exact(x[row[a : a + SCORED]], v[vec[a : a + SCORED]].astype(float)) for a in range(0, len(row), SCORED)])
        many = size[vec]
        place = np.repeat(start[vec], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        row, score = np.repeat(row, many), np.repeat(score, many)
        other = v_id[place] != ids[row]
        row, place, score = row[other], place[other], score[other]
        rank = np.lexsort((v_id[place], -score, row))
        row, place, score = row[rank], place[rank], score[rank]
        good = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((ids[row[good]], v_id[place[good]], score[good]))
    return [np.concatenate(c) for c in zip(*out)]


def usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id, vec of the rows that take part, floats as they are and other numbers as doubles."""
    e = F.col(embedding)
    e = e if dict(df.dtypes)[embedding] == "array<float>" else e.cast("array<double>")
    df = df.select(F.col(vec_id).cast("long").alias("id"), e.alias("vec")).where("id is not null and vec is not null and size(vec) > 0")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(~bad).where(F.exists("vec", lambda x: x != 0))


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id `every` divides."""
    spark = vectors.sparkSession
    good = usable(vectors, vec_id, embedding)
    sizes = {r[0]: r[1] for r in good.groupBy(F.size("vec")).count().collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = max(sizes, key=lambda d: (sizes[d], d))
    kind = dict(good.dtypes)["vec"]
    good = good.where(F.size("vec") == dim).withColumn("name", F.xxhash64("vec"))
    rows = np.array([r[0] for r in good.orderBy(F.xxhash64(F.lit(3), "id"), "id", "name").limit(sample).select("vec").collect()], float)
    books = Quantiser(dim).fit(rows).books
    mean = (rows / np.abs(rows).max()).mean(0)
    mean = mean / np.linalg.norm(mean) if mean.any() else np.eye(1, dim)[0]

    def plain(column: pa.Array) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def matrix(column: pa.Array) -> np.ndarray:
        return plain(column).astype(float)

    def coded(batches):
        model = Quantiser(dim, books)
        for batch in batches:
            if len(batch):
                code = model.bytes_of(model.encode(matrix(batch.column(1))))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in code], pa.binary()), batch.column(2)], names=["id", "vec", "code", "name"])

    queries = good.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vec").alias("vec"))
    wide = max(1, -(-dim // WIDTH))
    blocks = -(-max(1, sizes[dim] // every) * wide // QUERIES)
    parts = max(GROUPS, -(-sizes[dim] * wide // SHARD))
    place = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    codes = good.select("id", "vec", "name").mapInArrow(coded, f"id long, vec {kind}, code binary, name long")
    # by the vector too: rows of one id are dealt apart
    v = codes.withColumn("part", place(parts, F.lit(1), "id", "name")).withColumn("block", every_one(blocks))
    q = queries.withColumn("block", place(blocks, F.lit(2), "id")).withColumn("part", every_one(parts))

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        if len(left) and len(right):
            code = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(len(right), -1)
            out = search(Quantiser(dim, books), mean, left.column("id").to_numpy(), matrix(left.column("vec")), right.column("id").to_numpy(), plain(right.column("vec")), code, right.column("name").to_numpy(), k, rerank)
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("query_id", "vec_id", "score"), out, (pa.int64(), pa.int64(), pa.float64()))})

    on = ["block", "part"]
    found = q.select("id", "vec", *on).groupBy(*on).cogroup(v.select("id", "vec", "code", "name", *on).groupBy(*on)).applyInArrow(join, "query_id long, vec_id long, score double")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
