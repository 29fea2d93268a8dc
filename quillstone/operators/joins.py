"""Join operators. Hash lookups are plain equi-joins: Spark broadcasts the small side when its size allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spatial


def lookup(facts: DataFrame, dimension: DataFrame, key: str, drop_misses: bool = False, defaults: dict | None = None) -> DataFrame:
    """facts with the dimension's columns; misses go, or get defaults."""
    out = facts.join(dimension, key, "inner" if drop_misses else "left")
    return out.fillna(defaults) if defaults else out


def overlay(defaults: DataFrame, extra: DataFrame, key: str, pos: str) -> DataFrame:
    """Rows of defaults in their order, columns that extra has taken from it; unknown keys of extra go."""
    names = [c for c in defaults.columns if c not in (key, pos) and c in extra.columns]
    e = extra.select(key, *[F.col(c).alias(f"_e_{c}") for c in names])
    joined = defaults.join(e, key, "left")
    picked = [F.coalesce(f"_e_{c}", c).alias(c) if c in names else F.col(c) for c in defaults.columns]
    return joined.select(*picked)


def numbered(run: DataFrame, n: Column, name: str = "no") -> DataFrame:
    """A row for each number 1..n."""
    return run.withColumn(name, F.explode(F.sequence(F.lit(1), n)))


def key_item_review(keys: DataFrame, items: DataFrame, reviews: DataFrame, on: list[str]) -> DataFrame:
    """Every number of the key with its graded item and review state, where they are."""
    return keys.join(items, on, "left").join(reviews, on, "left")


def with_any(parents: DataFrame, children: DataFrame, key: str, condition: Column) -> DataFrame:
    return parents.join(children.where(condition), key, "left_semi")


def without(rows: DataFrame, others: DataFrame, key: str | list[str]) -> DataFrame:
    return rows.join(others, key, "left_anti")


def full_union(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys of both sides; columns of each as structs `a` and `b`."""
    pack = lambda d, n: d.select(*key, F.struct(*[c for c in d.columns if c not in key]).alias(n))
    return pack(a, "a").join(pack(b, "b"), key, "full_outer")


def step_lookup(facts: DataFrame, steps: DataFrame, value: str, least: str, by: list[str]) -> DataFrame:
    """The step with the largest `least` not above the value. Steps are a bounded dimension; facts aren't exploded."""
    bounds = steps.agg(F.sort_array(F.collect_list(F.struct(least, *[c for c in steps.columns if c != least])), asc=False).alias("_steps"))
    joined = facts.crossJoin(F.broadcast(bounds))  # one row
    hit = F.get(F.filter("_steps", lambda s: s[least] <= F.col(value)), F.lit(0))
    return joined.select(*facts.columns, *[hit[c].alias(c) for c in steps.columns])


def nearest_asof(events: DataFrame, logs: DataFrame, by: list[str], at: str, log_at: str, tie: str, tolerance=None, chunk: int | None = None) -> DataFrame:
    """Each event with its nearest log of the same `by` (ties: the smaller tie column); events without one go.

    Both sides are united and sorted by time in one shuffle, and each event takes the
    last log before it and the first one after it. With `chunk`, time is cut in pieces of
    that width, so that a user with much of all rows is many tasks' work: what crosses a
    border comes from a table with a row for each piece. Null times and keys match nothing.
    """
    keys = [*by, "_c"] if chunk else by
    piece = lambda c: F.floor(F.col(c) / chunk) if chunk else F.lit(0)
    log = F.struct(F.col(log_at).alias("t"), F.col(tie).alias("k"), F.struct(*[c for c in logs.columns if c not in by]).alias("r"))
    l = logs.where(F.col(log_at).isNotNull()).select(*by, piece(log_at).alias("_c"), F.col(log_at).alias("_t"), F.lit(0).alias("_e"), log.alias("_l"))
    event = F.struct(*[c for c in events.columns if c not in by])
    e = events.where(F.col(at).isNotNull()).select(*by, piece(at).alias("_c"), F.col(at).alias("_t"), F.lit(1).alias("_e"), event.alias("_v"))
    u = l.unionByName(e, allowMissingColumns=True)
    for c in by:
        u = u.where(F.col(c).isNotNull())
    so_far = lambda *order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("_before", F.last("_l", True).over(so_far("_t", "_e", F.desc("_l.k")))).withColumn("_after", F.last("_l", True).over(so_far(F.desc("_t"), "_e", F.desc("_l.k"))))
    found, near = u.where("_e = 1"), [F.col("_before"), F.col("_after")]
    if chunk:
        first = u.where("_e = 0").groupBy(*keys).agg(F.min(F.struct("_l.t", "_l.k", "_l"))["_l"].alias("_first"), F.min(F.struct((-F.col("_l.t")).alias("t"), "_l.k", "_l"))["_l"].alias("_last"))
        pieces = u.select(*keys).distinct().join(first, keys, "left")
        earlier = lambda o: Window.partitionBy(*by).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
        pieces = pieces.select(*keys, F.last("_last", True).over(earlier(F.asc("_c"))).alias("_prev"), F.last("_first", True).over(earlier(F.desc("_c"))).alias("_next"))
        found, near = found.join(pieces, keys, "left"), [*near, F.col("_prev"), F.col("_next")]
    ranked = F.filter(F.array(*[F.when(c.isNotNull(), F.struct(F.abs(c["t"] - F.col("_t")).alias("d"), c["k"].alias("k"), c.alias("l"))) for c in near]), lambda x: x.isNotNull())
    found = found.withColumn("_n", F.array_min(ranked)).where("_n is not null")
    if tolerance is not None:
        found = found.where(F.col("_n.d") <= tolerance)
    names = [c for c in logs.columns if c not in by and c not in events.columns]
    return found.select(*by, *[F.col("_v")[c].alias(c) for c in events.columns if c not in by], *[F.col("_n.l.r")[c].alias(c) for c in names])


def nearest_within(events: DataFrame, logs: DataFrame, by: list[str], at: str, log_at: str, tolerance: int, tie: str) -> DataFrame:
    """For each event the nearest log within the tolerance (ties: the earlier tie column)."""
    return nearest_asof(events, logs, by, at, log_at, tie, tolerance)


def grid_candidates(boxes: DataFrame, points: DataFrame, radius: str) -> DataFrame:
    """Pairs of boxes (x, y, radius) and points (px, py) nearer than the radius; cells adapt to where points are."""
    return spatial.in_boxes(boxes, points, radius)


def audit_changed(items: DataFrame, audits: DataFrame) -> DataFrame:
    """run_id, no, changed: whether a manual-review audit at or before adjustedAt shows another status or points; null without one."""
    a = audits.where(F.col("reason").contains("人工覆核")).select("run_id", "no", F.col("at"), F.col("status").alias("_s"), F.col("points").alias("_p"))
    differs = (F.coalesce("_s", F.lit("uncertain")) != F.coalesce("status", F.lit("uncertain"))) | (F.coalesce("_p", F.lit(0.0)) != F.coalesce("points", F.lit(0.0)))
    j = items.join(a, ["run_id", "no"], "left").withColumn("_d", F.when(F.col("at") <= F.coalesce(F.nullif("adjustedAt", F.lit(0)), F.lit(2**62)), differs))
    return j.groupBy("run_id", "no").agg(F.bool_or("_d").alias("changed"))
