"""Secondary indexes of a log as a layout of its files: sorted runs for the main key, bloom filters for the others.

A lookup reads only row groups whose smallest and largest values and bloom filters allow
its keys; rows_scanned() tells how many rows a lookup has read, so skipping is measured, not
assumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group: smaller ones skip more and cost more metadata.
GROUP_BYTES = 8 << 20


def write_indexed(log: DataFrame, path: str, sorted_by: list[str], filtered: list[str], ndv: int = 100_000, group_bytes: int = GROUP_BYTES, files: int | None = None) -> None:
    """Writes the log by ranges of the first sort key, with bloom filters of the other lookup columns; `files` fixes their number."""
    ranged = log.repartitionByRange(files, *sorted_by) if files else log.repartitionByRange(*sorted_by)
    w = ranged.sortWithinPartitions(*sorted_by).write.mode("overwrite").option("parquet.block.size", group_bytes)
    for c in filtered:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", ndv)
    w.parquet(path)


def lookup(spark: SparkSession, path: str, **keys: list) -> DataFrame:
    """Rows whose columns hold one of the keys given for them; filters reach the row groups."""
    df = spark.read.parquet(path)
    for c, values in keys.items():
        df = df.where(F.col(c).isin(list(values)))
    return df


def rows_scanned(df: DataFrame) -> int:
    """Runs df and returns how many rows its scans gave after skipping."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))
