"""Due lists with items never done, without a row for each user and item.

Items get dense numbers in the order of their keys. What a user need not do (done, and
not due yet) are some of these numbers; what lies between them is due, as ranges. A user
with m such items has m + 1 ranges at most, however many items there are, so the whole
result is as long as the log, and a page of a list is taken from the ranges it covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates

#: Keys that part the dimension for numbering; a part is one task's window.
BOUNDS = 256


def dense_index(dimension: DataFrame, key: str) -> DataFrame:
    """key, idx: distinct keys numbered from 0 in their order.

    Parts lie between the keys with the smallest hashes (a bounded sample, the same in
    every run), so no window covers the whole table; their sizes are a row each.
    """
    keys = dimension.select(key).where(F.col(key).isNotNull()).distinct()
    bounds = sorted(r[0] for r in keys.orderBy(F.xxhash64(key), key).limit(BOUNDS).collect())
    at = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    parted = keys.withColumn("_part", at)
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")  # BOUNDS + 1 rows
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return parted.withColumn("_in", inside).join(F.broadcast(before), "_part").select(key, (F.col("_before") + F.col("_in")).alias("idx"))


def last_rows(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """user_id, key, due of each user's latest row of each item: a map-side aggregate."""
    return log.groupBy("user_id", key).agg(F.max_by("due", F.struct(*order)).alias("due"))


def due_ranges(items: DataFrame, log: DataFrame, users: DataFrame, key: str, today: Column, order: list[str]) -> DataFrame:
    """user_id, low, high: ranges of numbers (both included) of all items that are due for each user.

    items: key, idx of dense_index(). An item is due if the user never did it, or if its
    latest row has no due day or one that has come. Log rows of unknown items count for
    nothing; a user without rows has one range of all items; null users have no list.
    """
    later = last_rows(log, key, order).where(~dates.is_due(F.col("due"), today)).join(items, key).select("user_id", "idx")
    end = users.select("user_id").where("user_id is not null").distinct().crossJoin(F.broadcast(items.agg(F.count("*").alias("idx"))))  # one row
    later = later.join(end.select("user_id"), "user_id", "left_semi").unionByName(end)
    before = F.coalesce(F.lag("idx").over(Window.partitionBy("user_id").orderBy("idx")), F.lit(-1))
    return later.select("user_id", (before + 1).alias("low"), (F.col("idx") - 1).alias("high")).where("low <= high")


def due_totals(ranges: DataFrame) -> DataFrame:
    """user_id, due: how many items are due, the number on a badge."""
    return ranges.groupBy("user_id").agg(F.sum(F.col("high") - F.col("low") + 1).alias("due"))


def due_page(ranges: DataFrame, items: DataFrame, key: str, page: int, size: int) -> DataFrame:
    """user_id, pos, key: the page's items of each user's due list in the order of keys; only ranges on the page are unfolded."""
    n = F.col("high") - F.col("low") + 1
    end = F.sum(n).over(Window.partitionBy("user_id").orderBy("low"))
    r = ranges.withColumn("_end", end).withColumn("_start", F.col("_end") - n)
    first, after = page * size, (page + 1) * size
    r = r.where((F.col("_start") < after) & (F.col("_end") > first))
    low = F.col("low") + F.greatest(F.lit(first) - F.col("_start"), F.lit(0))
    high = F.col("high") - F.greatest(F.col("_end") - after, F.lit(0))
    unfolded = r.select("user_id", (F.col("_start") - F.col("low")).alias("_shift"), F.explode(F.sequence(low, high)).alias("idx"))
    return unfolded.join(items, "idx").select("user_id", (F.col("idx") + F.col("_shift")).alias("pos"), key)


def done_bitmaps(items: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """user_id, bucket, bits: compressed sets of the numbers a user has done, for unions and counts over many logs."""
    done = log.select("user_id", key).distinct().join(items, key)
    bit = F.expr("bitmap_construct_agg(bitmap_bit_position(idx + 1))")
    return done.groupBy("user_id", F.expr("bitmap_bucket_number(idx + 1)").alias("bucket")).agg(bit.alias("bits"))


def done_counts(bitmaps: DataFrame) -> DataFrame:
    """user_id, done: items done, from bitmaps (those of several logs may overlap)."""
    merged = bitmaps.groupBy("user_id", "bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
    return merged.groupBy("user_id").agg(F.sum(F.expr("bitmap_count(bits)")).alias("done"))
