"""Queries over whole tables, where an older query of the same kind reads a part."""

from collections import defaultdict

from pyspark.sql import functions as F

from quillstone.operators import limiter
from quillstone.plans import learning, practice

from test_queries import SF


def test_rate_limiter_all(spark):
    a = practice.attempts(spark, SF).selectExpr("user_id", "d", "unix_millis(cast(ts as timestamp)) as ms", "seq", "qid % 25 as w").collect()
    days = defaultdict(list)
    for r in a:
        days[r["user_id"], r["d"]].append((r["ms"], r["seq"], r["w"]))
    want = {}
    for (user, _), rows in days.items():
        requests = used = 0
        last = None
        for ms, seq, w in sorted(rows):
            w = max(1, min(20, w))
            ok = (last is None or ms - last >= limiter.SPACING_MS) and requests < limiter.DAY_REQUESTS and used + w <= limiter.DAY_WEIGHT
            if ok:
                requests, used, last = requests + 1, used + w, ms
            want[seq] = (user, ok, requests, used)
    got = {r["seq"]: (r["user_id"], r["allowed"], r["requests"], r["weight_used"]) for r in practice.QUERIES["rate_limiter_all"](spark, SF).collect()}
    assert got == want and len(got) == len(a)


def test_due_queue(spark):
    """Brute force: every learner and item, done or not."""
    bank = sorted(r["qid"] for r in practice.bank(spark, SF).collect())
    users = [r["c_custkey"] for r in practice.read(spark, SF, "customer").collect()]
    last = {}
    for r in sorted(practice._due_log(spark, SF).collect(), key=lambda r: (r["ts"], r["seq"])):
        last[r["user_id"], r["qid"]] = r["due"]
    due = {(u, q) for u in users for q in bank if (u, q) not in last or last[u, q] is None or str(last[u, q]) <= practice.TODAY}
    got = {(r["user_id"], bank[k]) for r in learning.QUERIES["due_queue"](spark, SF).collect() for k in range(r["low"], r["high"] + 1)}
    assert got == due and any(u not in {x for x, _ in last} for u, _ in due)
    for r in practice.QUERIES["due_badges"](spark, SF).collect():
        u = r["user_id"]
        assert r["never"] == sum((u, q) not in last for q in bank) and (u not in users or r["due"] + r["never"] == sum(x == u for x, _ in due))


def test_build_paper_uses_every_id(spark, tmp_path):
    spark.read.parquet(f"{SF}/part.parquet").withColumn("p_partkey", F.col("p_partkey") + 5000).write.parquet(f"{tmp_path}/part.parquet")
    spark.read.parquet(f"{SF}/events.parquet").where("user_id < 3").write.parquet(f"{tmp_path}/events.parquet")
    got = practice.QUERIES["build_paper"](spark, str(tmp_path)).collect()
    assert got and all(int(r["qid"]) >= 5000 for r in got)


def test_whole_replicas_and_boxes(spark):
    a = practice.attempts(spark, SF)
    assert {r["box_id"] for r in practice.QUERIES["grid_candidates_all"](spark, SF).collect()} == {r["vec_id"] for r in practice.read(spark, SF, "embeddings").select("vec_id").collect()}
    n = sum(r["n"] for r in practice.QUERIES["union_distinct_all"](spark, SF).collect())
    assert n == a.select("user_id", "qid", "mode").distinct().count()
    assert any(r["seq"] % 2 and r["seq"] % 3 for r in practice.QUERIES["merge_tombstone_all"](spark, SF).collect())
