"""What only larger tables or odd inputs show: queries against their SQL or brute force on made tables."""

import datetime

import pytest

from quillstone.plans import registry


def rows_of_sql(name, path):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in path.iterdir():
        c.execute(f"create view {p.name.split('.')[0]} as select * from '{p}/*.parquet'")
    r = c.execute(registry.oracle_sql()[name])
    return [x[0] for x in r.description], r.fetchall()


def test_day_rules_between_59500_and_60000(spark, tmp_path):
    day = datetime.datetime(1999, 5, 4)
    spark.createDataFrame([(k, day) for k in (*range(59_490, 59_510), 59_999, 60_000, 60_499, 60_500, 119_499, 119_500)], "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    names, want = rows_of_sql("day_rules", tmp_path)
    got = registry.queries()["day_rules"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(want) == 26


def test_strokes_need_no_python_for_each_key(spark, tmp_path):
    from quillstone.streaming import journal

    rows = [("p", "a", 5, 1, False), ("p", "b", -7, 2, None), ("p", "c", 1, 3, True), ("q", None, 9, 4, False), ("q", None, 9, 5, False)]
    schema = "qid string, id string, t1 long, seq long, deleted boolean"
    for part in (rows[:3], rows[3:], [("p", "a", 2, 9, True)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = journal.latest_strokes(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    assert "Python" not in s._jdf.queryExecution().toString() and "Pandas" not in s._jdf.queryExecution().toString()
    got = journal.run_available(s, f"{tmp_path}/out", "update", f"{tmp_path}/checkpoint", ["qid", "id"]).collect()
    assert sorted(map(tuple, got), key=str) == [("p", "a", 5, 1, True), ("p", "b", -7, 2, False), ("p", "c", -1, -1, True), ("q", None, 9, 5, False)]


def test_limits_keep_a_state_for_many_users(spark, tmp_path):
    """More users than buckets, ids that floats can't hold, and none: the rows of the whole log, by fewer states than user days."""
    from quillstone.operators import limiter
    from quillstone.streaming import journal, ordered

    schema, start = "user_id long, ts timestamp, seq long, weight int", datetime.datetime(2026, 1, 1, 15, 50)
    users = [None, 0, 7, *range(2**60, 2**60 + 9)]
    rows = [(users[k % 12], start + datetime.timedelta(seconds=97 * k // 12), k, (k * 7) % 25) for k in range(1200)]
    late = sorted(rows, key=lambda r: r[1] + datetime.timedelta(seconds=r[2] * 7919 % 3600))
    for part in (late[:400], late[400:800], late[800:], [(-1, start + datetime.timedelta(days=9), 9999, 1)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with ordered.rocksdb_state(spark):
        got = journal.run_available(ordered.limited(stream, "2 hours", buckets=3), f"{tmp_path}/out", "append", f"{tmp_path}/checkpoint").where("seq < 9999")
    want = {}
    for user in users:
        for day in (1, 2):
            mine = [r for r in rows if r[0] == user and (r[1] + datetime.timedelta(hours=8)).day == day]
            done, _ = limiter.decide([(int(r[1].replace(tzinfo=datetime.timezone.utc).timestamp() * 1000), r[3]) for r in mine])
            want |= {r[2]: (user, datetime.date(2026, 1, day), *d) for r, d in zip(mine, done)}
    assert {r["seq"]: (r["user_id"], r["usage_date"], r["allowed"], r["reason"], r["requests"], r["weight_used"]) for r in got.collect()} == want and len(want) == 1200 and len({w[1] for w in want.values()}) == 2
    keys = spark.read.format("statestore").option("stateVarName", "state").load(f"{tmp_path}/checkpoint")
    assert keys.count() <= 3


def test_exams_send_no_table_to_the_driver(spark):
    """Small files can hold many rows, so only what a class bounds is broadcast; learners who tried nothing get an exam, one without an id too."""
    import re

    from quillstone.operators import select

    kinds, diffs = ["single", "multi", "fill"], [1, 2, 3]
    bank = spark.createDataFrame([(f"q{k}", kinds[k % 3], diffs[k // 3 % 3], "abcd"[k % 4], f"g{k // 2}") for k in range(300)], "id string, type string, diff int, topic string, grp string")
    users = spark.createDataFrame([(k,) for k in (*range(40), None)], "user_id long")
    counts = spark.createDataFrame([(u, f"q{k}", 1) for u in range(3) for k in range(u, 300, 7)], "user_id long, qid string, n long")
    got = select.build_papers(bank, users, counts)
    joins = re.findall(r"BroadcastHashJoin \[([^\]]*)\]", got._jdf.queryExecution().executedPlan().toString())
    assert joins and all(re.fullmatch(r"_class#\d+", j) for j in joins), joins
    papers = {}
    for r in got.collect():
        papers.setdefault(r["user_id"], []).append((r["exam_no"], r["qid"]))
    assert len(papers) == 41 and None in papers and all(len(p) == 17 for p in papers.values())
    classes = {r["user_id"]: r["c"] for r in users.selectExpr("user_id", f"pmod(xxhash64(1, user_id), {select.CLASSES}) as c").collect()}
    exams = {}
    for u, p in papers.items():
        if u is None or u >= 3:
            exams.setdefault(classes[u], set()).add(tuple(sorted(p)))
    assert all(len(p) == 1 for p in exams.values()) and len({q for _, q in papers[0]} & {f"q{k}" for k in range(0, 300, 7)}) < 17


def test_pairs_of_a_part_are_never_held_together(spark, monkeypatch):
    """Pairs leave a part in batches, so no group of it may be gathered; the sample weighs rows, so that one place is dealt apart."""
    from quillstone.operators import spatial

    monkeypatch.setattr(spatial, "STEP", 100)
    monkeypatch.setattr(spatial, "BATCH", 7)
    points = [(k, 0.5, 0.5) if k % 2 else (k, k / 400, 1 - k / 400) for k in range(400)]
    boxes = [(k, k / 60, 0.5, [0.0, 0.05, 2.0][k % 3], f"n{k}") for k in range(60)] + [(60, 0.5, 0.5, 0.0, None)]
    want = sorted((b, k, n) for b, x, y, r, n in boxes for k, px, py in points if ((x - px) ** 2 + (y - py) ** 2) ** 0.5 <= r)
    df, pf = spark.createDataFrame(boxes, "b int, x double, y double, radius double, name string"), spark.createDataFrame(points, "id int, px double, py double")
    for parts in (1, 6):
        got = spatial.in_boxes(df, pf, "radius", parts)
        assert "CoGroups" not in got._jdf.queryExecution().toString()
        assert sorted(((r["b"], r["id"], r["name"]) for r in got.collect()), key=str) == sorted(want, key=str) and len(want) > 8000


def test_the_mix_is_no_single_plan(spark):
    """The driver plans and tracks all shuffles of a query at once, so each part of the mix is written before the next."""
    from quillstone.llm import mixing

    docs = spark.createDataFrame([(k, "a b c " * (k % 50), "s" + str(k % 4)) for k in range(400)], "doc_id long, text string, source string")
    got = mixing.taken(docs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 5 and "Window" not in plan
    rows = got.collect()
    assert len(rows) == 400 and all(r["taken"] <= 2 * r["size"] for r in rows) and sum(r["taken"] for r in rows) > 1.2 * sum(r["size"] for r in rows)
