"""Points in boxes by an adaptive partitioning: a quadtree over a sample, and a local join in each part.

The tree splits where the sample is dense, so clusters get small cells and empty space
large ones; runs of cells in Z order become parts of about equal weight. A cell that
can't be split (many points at one place) is dealt to several parts by a hash. Points go
to one part, boxes to each part they meet, so a pair is found once; within a part
points are sorted by x and a box looks at those of its own width. A task holds the points
of one part; boxes pass by in batches, and pairs leave in batches, however many they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels of the tree, rows of a part, and the most parts (a part's share of the sample must tell it from others).
DEPTH, PART_ROWS, PARTS, SAMPLE = 15, 10_000, 4_096, 131_072
#: Candidate pairs that a part looks at in one step, and pairs of a batch that leaves it.
STEP, BATCH = 1 << 18, 1 << 16


@dataclass
class Parts:
    """Cells in Z order (first code, part), the parts' extents, and how many places a part is dealt to."""

    low: tuple[float, float]
    side: float
    first: np.ndarray
    part: np.ndarray
    extent: np.ndarray
    deals: np.ndarray

    def code(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The Z-order code of places; those outside of the sample's square go to its border."""
        out = np.zeros(len(x), np.int64)
        for k, c in enumerate((x, y)):
            v = np.clip(np.floor((c - self.low[k]) / self.side * (1 << DEPTH)), 0, (1 << DEPTH) - 1).astype(np.int64)
            for b in range(DEPTH):
                out |= (v >> b & 1) << (2 * b + k)
        return out

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.part[np.searchsorted(self.first, self.code(x, y), "right") - 1]

    def meeting(self, x: np.ndarray, y: np.ndarray, r: np.ndarray) -> list[np.ndarray]:
        """The parts that each box may meet."""
        low = [np.clip(c - r, self.low[k], self.low[k] + self.side) for k, c in enumerate((x, y))]
        high = [np.clip(c + r, self.low[k], self.low[k] + self.side) for k, c in enumerate((x, y))]
        e = self.extent
        hit = (low[0][:, None] <= e[None, :, 2]) & (high[0][:, None] >= e[None, :, 0]) & (low[1][:, None] <= e[None, :, 3]) & (high[1][:, None] >= e[None, :, 1])
        return [np.unique(self.part[np.flatnonzero(h)]) for h in hit]


def build_parts(x: np.ndarray, y: np.ndarray, parts: int) -> Parts:
    """Cells of at most a quarter of a part's share, but where depth ends; runs of them as parts."""
    low = (float(x.min()), float(y.min())) if len(x) else (0.0, 0.0)
    side = max(float(x.max()) - low[0], float(y.max()) - low[1], 1e-300) * (1 + 1e-9) if len(x) else 1.0
    tree = Parts(low, side, *[np.zeros(0)] * 4)
    code = np.sort(tree.code(x, y))
    most = max(1, len(x) / parts / 4)
    first, count, stack = [], [], [(0, 0)]
    while stack:
        depth, at = stack.pop()
        size = 4 ** (DEPTH - depth)
        n = int(np.searchsorted(code, at + size) - np.searchsorted(code, at))
        if n > most and depth < DEPTH:
            stack += [(depth + 1, at + k * size // 4) for k in (3, 2, 1, 0)]
        else:
            first.append(at)
            count.append(n)
    first, count = np.array(first, np.int64), np.array(count, np.int64)
    # cells to parts: a part ends where it has its share
    share = max(1.0, len(x) / parts)
    part, held, k = np.zeros(len(first), np.int64), 0, 0
    for i, n in enumerate(count):
        if held and held + n > share * 1.25:
            k, held = k + 1, 0
        part[i] = k
        held += n
    weight = np.bincount(part, count, minlength=k + 1)
    # extents of cells: a code's bits are x and y in turn
    corner = np.zeros((len(first), 2), np.int64)
    for axis in (0, 1):
        for b in range(DEPTH):
            corner[:, axis] |= (first >> (2 * b + axis) & 1) << b
    width = np.sqrt(np.append(first[1:], 4**DEPTH) - first)
    unit = side / (1 << DEPTH)
    extent = np.column_stack([low[0] + corner[:, 0] * unit, low[1] + corner[:, 1] * unit, low[0] + (corner[:, 0] + width) * unit, low[1] + (corner[:, 1] + width) * unit])
    # rounding must not keep a box from a cell it touches
    extent += np.array([-1, -1, 1, 1]) * unit * 1e-3
    return Parts(low, side, first, part, extent, np.maximum(1, np.ceil(weight / (share * 1.25))).astype(np.int64))


def in_boxes(boxes: DataFrame, points: DataFrame, radius: str, parts: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """Pairs of boxes (x, y, radius) and points (px, py) not farther than the radius.

    Rows with a null or non-finite coordinate are in no pair; equal rows are pairs each.
    Other columns of both sides come along; those of points win where names clash.
    """
    finite = lambda *c: F.reduce(F.array(*[F.col(n).cast("double") for n in c]), F.lit(True), lambda a, v: a & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    points, boxes = points.where(finite("px", "py")), boxes.where(finite("x", "y", radius))
    n = points.count() if parts is None or parts > 1 else 0
    parts = parts or int(min(PARTS, max(1, -(-n // PART_ROWS))))
    sampled = np.zeros((0, 2))
    if parts > 1 and n:
        # rows, not places: what many points share must be in the sample by its weight
        taken = points.select(F.col("px").cast("double"), F.col("py").cast("double")).sample(fraction=min(1.0, sample / n), seed=1).toArrow()
        sampled = np.column_stack([taken.column(c).to_numpy() for c in ("px", "py")])
    tree = build_parts(sampled[:, 0], sampled[:, 1], parts)

    @F.pandas_udf("long")
    def part_of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(tree.of(x.to_numpy(float), y.to_numpy(float)))

    @F.pandas_udf("array<long>")
    def parts_of(x: pd.Series, y: pd.Series, r: pd.Series) -> pd.Series:
        out = []
        for a in range(0, len(x), 1000):
            s = slice(a, a + 1000)
            out += tree.meeting(x.to_numpy(float)[s], y.to_numpy(float)[s], r.to_numpy(float)[s])
        return pd.Series(out)

    deals = F.element_at(F.array(*[F.lit(int(n)) for n in tree.deals]), (F.col("_part") + 1).cast("int"))
    p = points.withColumn("_part", part_of(F.col("px").cast("double"), F.col("py").cast("double")))
    # by place, not by value: points of one place are dealt apart
    p = p.withColumn("_deal", F.pmod(F.xxhash64(F.monotonically_increasing_id()), deals))
    b = boxes.withColumn("_part", F.explode(parts_of(F.col("x").cast("double"), F.col("y").cast("double"), F.col(radius).cast("double"))))
    b = b.withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), deals.cast("long") - 1)))
    names = [c for c in boxes.columns if c not in points.columns]
    schema = ", ".join([f"`{c}` {dict(boxes.dtypes)[c]}" for c in names] + [f"`{c}` {k}" for c, k in points.dtypes])
    point_names = points.columns
    # one stream of both sides, a part's points before its boxes
    place = lambda *c: [F.col(k).cast("double").alias(f"_{n}") for k, n in zip(c, "xyr")]
    p = p.select("_part", "_deal", F.lit(0).alias("_side"), *place("px", "py"), F.struct(*point_names).alias("_p"))
    b = b.select("_part", "_deal", F.lit(1).alias("_side"), *place("x", "y", radius), F.struct(*[F.col(c) for c in names], F.lit(0).alias("_none")).alias("_b"))
    both = p.unionByName(b, allowMissingColumns=True).repartition("_part", "_deal").sortWithinPartitions("_part", "_deal", "_side", "_x")

    def join(batches):
        part, held, points = None, [], None
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("_part", "_deal", "_side")])
            cuts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))) if len(keys) else []
            for start, end in zip(cuts, [*cuts[1:], len(keys)]):
                rows, now = batch.slice(start, end - start), tuple(keys[start, :2])
                if now != part:
                    part, held, points = now, [], None
                if keys[start, 2] == 0:
                    held.append(pa.table({c: rows.column(c) for c in ("_x", "_y", "_p")}))
                elif held:
                    points = pa.concat_tables(held).combine_chunks() if points is None else points
                    yield from pairs(rows, points)

    def pairs(boxes, points):
        number = lambda t, c: t.column(c).to_numpy()
        column = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        (px, py), (x, y, r) = (number(points, c) for c in ("_x", "_y")), (boxes.column(c).to_numpy() for c in ("_x", "_y", "_r"))
        left, right = column(boxes.column("_b")), column(points.column("_p"))
        start, end = np.searchsorted(px, x - r * (1 + 1e-12)), np.searchsorted(px, x + r * (1 + 1e-12), "right")
        size = np.maximum(end - start, 0)
        done, a = np.cumsum(size), 0
        while a < len(x):
            z = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + STEP, "right")))
            n = size[a:z]
            box = np.repeat(np.arange(a, z), n)
            point = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + start[box]
            good = np.sqrt((x[box] - px[point]) ** 2 + (y[box] - py[point]) ** 2) <= r[box]
            box, point = box[good], point[good]
            for k in range(0, len(box), BATCH):
                l, q = left.take(pa.array(box[k : k + BATCH])), right.take(pa.array(point[k : k + BATCH]))
                yield pa.RecordBatch.from_arrays([l.field(c) for c in names] + [q.field(c) for c in point_names], names=names + point_names)
            a = z

    return both.mapInArrow(join, schema)
