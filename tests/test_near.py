"""Nearest joins and spatial candidates against plain Python, and how evenly parts are filled."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import joins, spatial


@pytest.mark.parametrize("chunk", [None, 10, 1000])
@pytest.mark.parametrize("tolerance", [None, 7])
def test_nearest_asof(spark, chunk, tolerance):
    rng = random.Random(f"{chunk}{tolerance}")
    events = [(rng.choice(["a", "b", "c", None]), k, rng.choice([rng.randint(-50, 300), None])) for k in range(200)] + [("a", 900, 5), ("a", 901, 5)]
    logs = [(rng.choice(["a", "b", None]), k, rng.choice([rng.randint(-60, 320), 40, 41, None])) for k in range(80)]
    want = []
    for by, e, at in events:
        near = [(abs(at - t), i, t) for b, i, t in logs if by is not None and b == by and at is not None and t is not None]
        if near and (tolerance is None or min(near)[0] <= tolerance):
            d, i, _ = min(near)
            want.append((by, e, i))
    ev = spark.createDataFrame(events, "u string, e long, at long")
    lg = spark.createDataFrame(logs, "u string, i long, t long")
    got = joins.nearest_asof(ev, lg, ["u"], "at", "t", "i", tolerance, chunk)
    assert sorted((r["u"], r["e"], r["i"]) for r in got.collect()) == sorted(want)
    if not chunk:
        assert joins.nearest_asof(ev, lg, ["u"], "at", "t", "i", tolerance)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert joins.nearest_asof(ev, lg.where("false"), ["u"], "at", "t", "i", tolerance, chunk).count() == 0


def clustered(seed, n):
    """Dense spots, one of them a single place, and a thin rest."""
    rng = np.random.default_rng(seed)
    spots = rng.random((5, 2))
    x = np.concatenate([spots[k] + rng.normal(0, 10.0 ** -(k + 1), (n // 8, 2)) for k in range(5)] + [np.tile(spots[:1], (n // 8, 1)), rng.random((n // 4, 2))])
    return rng.permutation(x)


@pytest.mark.parametrize("parts", [None, 1, 13])
def test_boxes_and_points(spark, parts):
    p = clustered(3, 800)
    points = [(k, float(x), float(y), "p") for k, (x, y) in enumerate(p)] + [(9000, None, 0.1, "p"), (9001, float("nan"), 0.1, "p"), (9002, float("inf"), 0.0, "p")]
    rng = np.random.default_rng(4)
    boxes = [(k, float(x), float(y), float(r), "b") for k, (x, y), r in zip(range(150), np.concatenate([p[:100], rng.random((50, 2)) * 3 - 1]), rng.choice([0.0, 1e-5, 0.01, 0.4, 5.0], 150))] + [(700, None, 0.0, 1.0, "b")]
    want = sorted((b, k) for b, x, y, r, _ in boxes if x is not None for k, px, py, _ in points if px is not None and np.isfinite(px) and np.hypot(x - px, y - py) <= r)
    df = spark.createDataFrame(boxes, "b int, x double, y double, radius double, note string")
    pf = spark.createDataFrame(points, "p int, px double, py double, note string")
    got = spatial.in_boxes(df, pf, "radius", parts).collect()
    assert sorted((r["b"], r["p"]) for r in got) == want and all(r["note"] == "p" for r in got)
    assert spatial.in_boxes(df, pf.where("false"), "radius", parts).count() == 0 == spatial.in_boxes(df.where("false"), pf, "radius", parts).count()


def test_parts_of_clustered_points_are_even():
    p = clustered(5, 80_000)
    sample = p[np.random.default_rng(6).choice(len(p), 8_000, replace=False)]
    tree = spatial.build_parts(sample[:, 0], sample[:, 1], 64)
    n = np.bincount(tree.of(p[:, 0], p[:, 1]), minlength=len(tree.deals))
    tasks = np.concatenate([np.full(d, c / d) for c, d in zip(n, tree.deals)])
    assert tasks.max() <= 4 * np.median(tasks)
    fixed = np.bincount((np.clip(p, 0, 0.9999) * 40).astype(int) @ [40, 1], minlength=1600)
    assert fixed.max() > 40 * np.median(fixed[fixed > 0])  # cells of one size are not


def test_points_of_one_place(spark):
    pf = spark.range(3000).select("id", F.lit(0.5).alias("px"), F.lit(0.5).alias("py"))
    df = spark.createDataFrame([(1, 0.5, 0.5, 0.0)], "b int, x double, y double, radius double")
    assert spatial.in_boxes(df, pf, "radius", 8).select("id").distinct().count() == 3000
