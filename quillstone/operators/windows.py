"""Ranked and ordered operators: every order ends in a full tie-break, so results don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_n(df: DataFrame, n: int, by: list[str], order: list[str]) -> DataFrame:
    """The last n rows of each group in ascending order."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last in order: a map-side aggregate, no sort of whole groups."""
    rest = [c for c in df.columns if c not in by]
    ranked = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    picked = df.groupBy(*by).agg(F.max_by(F.struct(*rest), ranked if _orderable(df, rest) else F.struct(*order)).alias("_r"))
    return picked.select(*by, *[F.col("_r")[c].alias(c) for c in rest]).select(*df.columns)


def _orderable(df: DataFrame, names: list[str]) -> bool:
    kinds = dict(df.dtypes)
    return not any("map<" in kinds[c] or "variant" in kinds[c] for c in names)


def first_per_key(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in input order (order must be total)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def all_of_last(df: DataFrame, n: int, by: list[str], order: list[str], flag: Column) -> DataFrame:
    """Keys and whether the last n rows exist and all meet the flag."""
    return last_n(df, n, by, order).groupBy(*by).agg(((F.count("*") == n) & F.bool_and(flag)).alias("all_last"))


def gaps(df: DataFrame, by: list[str], start: str, end: str, tie: str) -> DataFrame:
    """df and gap: start less the end of the row before, null for the first."""
    w = Window.partitionBy(*by).orderBy(start, tie)
    return df.withColumn("prev_end", F.lag(end).over(w)).withColumn("gap", F.col(start) - F.col("prev_end"))


def long_gaps(df: DataFrame, by: list[str], start: str, end: str, tie: str, least: int, most: int) -> DataFrame:
    """The first `most` gaps of at least `least`, in time."""
    w = Window.partitionBy(*by).orderBy("prev_end", tie)
    found = gaps(df, by, start, end, tie).where(F.col("gap") >= least)
    return found.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)


def longest_gaps(df: DataFrame, by: list[str], start: str, end: str, tie: str, least: int, most: int) -> DataFrame:
    """The `most` longest gaps of at least `least`; nth counts them in time."""
    w = Window.partitionBy(*by).orderBy(F.desc("gap"), "prev_end", tie)
    found = gaps(df, by, start, end, tie).where(F.col("gap") >= least)
    found = found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")
    return found.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("prev_end", tie)))


def around(df: DataFrame, by: list[str], order: list[str], value: Column, after: int = 2) -> DataFrame:
    """df and frame: the values of this row and the `after` next."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(0, after)
    return df.withColumn("frame", F.collect_list(value).over(w))


def segments(df: DataFrame, by: list[str], order: list[str], cut: Column, strength: Column, most: int) -> DataFrame:
    """df and segment: cuts are the `most` strongest rows where cut holds; a segment's number is the count of cuts so far."""
    w = Window.partitionBy(*by).orderBy(*order)
    ranked = Window.partitionBy(*by).orderBy(F.desc("_strength"), *order)
    d = df.withColumn("_cut", F.coalesce(cut, F.lit(False))).withColumn("_strength", F.when(F.col("_cut"), strength))
    d = d.withColumn("_r", F.when(F.col("_cut"), F.row_number().over(ranked)))
    is_cut = F.coalesce((F.col("_r") <= most).cast("int"), F.lit(0))
    d = d.withColumn("segment", F.sum(is_cut).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.drop("_cut", "_strength", "_r")


def previous(df: DataFrame, by: list[str], order: list[str], column: str, name: str = "previous") -> DataFrame:
    return df.withColumn(name, F.lag(column).over(Window.partitionBy(*by).orderBy(*order)))


def last_value(logs: Column, field: str) -> Column:
    """The last non-empty field of an array of structs; null if there is none."""
    return F.try_element_at(F.filter(F.transform(logs, lambda x: x[field]), lambda v: v.isNotNull() & (v != "")), F.lit(-1))


def running_number(df: DataFrame, by: list[str], order: list[str], name: str = "no") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
