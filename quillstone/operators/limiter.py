"""Request limits and refunds: ordered folds of each user's local day."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates

#: Spacing, requests and weight of a day, and bounds of a request's weight.
SPACING_MS, DAY_REQUESTS, DAY_WEIGHT, LEAST, MOST = 4000, 60, 120, 1, 20


def decide(rows: list[tuple[int, int]], state: tuple[int, int, int] = (0, 0, -1)) -> tuple[list[tuple[bool, str, int, int]], tuple[int, int, int]]:
    """(ms, weight) in order: allowed, reason, requests, weight after; and the day's state (requests, weight, last ms)."""
    requests, total, last = state
    out = []
    for ms, weight in rows:
        weight = max(LEAST, min(weight if weight is not None and weight == weight else 1, MOST))
        if last >= 0 and ms - last < SPACING_MS:
            out.append((False, "rate_limited", requests, total))
        elif requests >= DAY_REQUESTS or total + weight > DAY_WEIGHT:
            out.append((False, "daily_limit", requests, total))
        else:
            requests, total, last = requests + 1, total + int(weight), ms
            out.append((True, "", requests, total))
    return out, (requests, total, last)


def limited(events: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """events (user_id, ts, seq, weight) and usage_date, allowed, reason, requests, weight_used.

    A rejection leaves the state as it was, so each user's day is folded in order: rows
    are dealt by user and day and sorted, and a task passes over its days batch by batch.
    """
    e = events.withColumn("usage_date", dates.local_day(F.col("ts"))).withColumn("_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    if members is not None:
        e = e.join(members.where("enabled").select("user_id", F.lit(True).alias("_member")), "user_id", "left")
    else:
        e = e.withColumn("_member", F.lit(True))

    kinds = dict(e.dtypes)
    e = e.select("user_id", "usage_date", "_ms", "seq", "weight", F.coalesce("_member", F.lit(False)).alias("_member"))
    e = e.repartition("user_id", "usage_date").sortWithinPartitions("user_id", "usage_date", "_ms", "seq")

    def fold(batches):
        # a partition's rows come day by day in order; what a day has used goes on from batch to batch
        day, state = None, (0, 0, -1)
        for p in batches:
            out = []
            for key, rows in p.groupby(["user_id", "usage_date"], sort=False, dropna=False):
                if key != day:
                    day, state = key, (0, 0, -1)
                if rows["_member"].iloc[0]:
                    done, state = decide(list(zip(rows["_ms"], rows["weight"])), state)
                    out += done
                else:
                    out += [(False, "not_allowed", 0, 0)] * len(rows)
            allowed, reason, requests, used = zip(*out) if out else ([], [], [], [])
            yield pd.DataFrame({"user_id": p["user_id"], "seq": p["seq"], "usage_date": p["usage_date"], "allowed": allowed, "reason": reason, "requests": requests, "weight_used": used})

    return e.mapInPandas(fold, f"user_id {kinds['user_id']}, seq {kinds['seq']}, usage_date date, allowed boolean, reason string, requests int, weight_used int")


def with_refunds(entries: DataFrame) -> DataFrame:
    """user_id, usage_date, requests, weight after claims and refunds (delta 1 or -1, weight) in order, never below 0.

    A running sum with a floor: the sum less the least running sum, where that is
    below 0. So two windows do what a fold would.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "usage_date").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    last = Window.partitionBy("user_id", "usage_date").orderBy(F.desc("seq"))
    d = entries.withColumns({"_r": F.sum("delta").over(w), "_w": F.sum(F.col("delta") * F.col("weight")).over(w)})
    d = d.withColumns({"requests": F.col("_r") - F.least(F.lit(0), F.min("_r").over(w)), "weight": F.col("_w") - F.least(F.lit(0), F.min("_w").over(w))})
    return d.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("user_id", "usage_date", "requests", "weight")
