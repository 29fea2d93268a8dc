"""Lookups that skip row groups, shown by the rows their scans gave; digests that don't depend on order."""

import random

from pyspark.sql import functions as F

from quillstone.sources import indexed, stores


def test_lookups_skip(spark, tmp_path):
    path = str(tmp_path / "log")
    log = spark.range(40_000).select(F.col("id").alias("seq"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("user_id"), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(10_000)) * 2).alias("qid"), F.when(F.col("id") % 50 == 0, "pending").otherwise("uploaded").alias("state"))
    log = log.withColumn("state", F.when(F.col("user_id") < 500, F.col("state")).otherwise("uploaded"))
    indexed.write_indexed(log.repartition(8), path, ["user_id", "seq"], ["qid", "state"], group_bytes=64 << 10)
    plain = log.collect()
    for keys in ({"user_id": [3, 700]}, {"qid": [44, 4_000]}, {"user_id": [3], "state": ["pending"]}, {"qid": [41]}):
        got = indexed.lookup(spark, path, **keys)
        assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in plain if all(r[c] in v for c, v in keys.items()))
    assert indexed.rows_scanned(indexed.lookup(spark, path, user_id=[3])) < 40_000 / 2
    # absent odd keys lie between the smallest and the largest: only bloom filters skip them
    assert indexed.rows_scanned(indexed.lookup(spark, path, qid=[10_001])) == 0
    assert indexed.rows_scanned(spark.read.parquet(path)) == 40_000


def test_digest_of_a_source(spark):
    rng = random.Random(1)
    rows = [("a", str(k), rng.choice(["x", "", None, "é"])) for k in range(300)] + [("b", "1", "x"), ("b", "1", "x")]
    digest = lambda rs: {r["src"]: (r["n"], r["sha256"]) for r in stores.content_digest(spark.createDataFrame(rs, "src string, id string, q string").repartition(3), ["src"], "id", "q").collect()}
    want = digest(rows)
    rng.shuffle(rows)
    assert digest(rows) == want and want["a"][0] == 300
    assert digest(rows[:-1] + [rows[-1]] * 2) != want
    one = lambda *r: digest([("s", *r)])["s"]
    assert len({one("1", None), one("1", ""), one("1", "n"), one("11", ""), one(None, "1")}) == 5
