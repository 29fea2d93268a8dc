"""Due lists, similar questions and exams against plain Python over every user and item."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import due, select

DAY = "2024-01-20"


def due_case(seed):
    rng = random.Random(seed)
    items = [f"u{k:03d}" for k in range(rng.choice([1, 11, 40, 700]))]
    rows = [(rng.randrange(6), rng.choice(items + ["gone"]), rng.choice(["2024-01-19", DAY, "2024-01-21", "2024-02-01", "2024-02-01", None]), k) for k in range(rng.choice([0, 30, 400]))]
    return items, rows


@pytest.mark.parametrize("seed", range(6))
def test_due_ranges(spark, seed):
    items, rows = due_case(seed)
    last = {(u, i): d for u, i, d, _ in rows}
    want = {u: [i for i in items if (u, i) not in last or last[u, i] is None or last[u, i] <= DAY] for u in range(8)}
    log = spark.createDataFrame(rows, "user_id long, unit string, due string, seq long").withColumn("due", F.col("due").cast("date"))
    dense = due.dense_index(spark.createDataFrame([(i,) for i in items + items[:1]] + [(None,)], "unit string"), "unit")
    number = {r["unit"]: r["idx"] for r in dense.collect()}
    assert number == {i: k for k, i in enumerate(items)}
    users = spark.createDataFrame([(u,) for u in [*range(8), 3, None]], "user_id long")
    ranges = due.due_ranges(dense, log, users, "unit", F.lit(DAY).cast("date"), ["seq"])
    got = {u: [] for u in range(8)}
    found = ranges.orderBy("user_id", "low").collect()
    for r in found:
        got[r["user_id"]] += items[r["low"] : r["high"] + 1]
    assert got == want and len(found) <= len(last) + 8
    assert {r["user_id"]: r["due"] for r in due.due_totals(ranges).collect()} == {u: len(x) for u, x in want.items() if x}
    for page in (0, 1, 4):
        rows_ = due.due_page(ranges, dense, "unit", page, 7).collect()
        assert sorted((r["user_id"], r["pos"], r["unit"]) for r in rows_) == sorted((u, k, x[k]) for u, x in want.items() for k in range(page * 7, min(len(x), page * 7 + 7)))
    bits = due.done_bitmaps(dense, log, "unit")
    done = {r["user_id"]: r["done"] for r in due.done_counts(bits.unionByName(bits)).collect()}
    assert done == {u: n for u in range(8) if (n := len({i for v, i in last if v == u and i in number}))}


def test_eleven_outlines_are_due_then_ten(spark):
    dense = due.dense_index(spark.createDataFrame([(f"outline-{k}",) for k in range(1, 12)], "unit string"), "unit")
    users = spark.createDataFrame([(1,)], "user_id long")
    for rows, n in (([], 11), ([(1, "outline-1", "2024-01-22", 1)], 10)):
        log = spark.createDataFrame(rows, "user_id long, unit string, due string, ts long").withColumn("due", F.col("due").cast("date"))
        assert due.due_totals(due.due_ranges(dense, log, users, "unit", F.lit(DAY).cast("date"), ["ts"])).first()["due"] == n


def bank_of(rng, n, topics):
    out = []
    for k in range(n):
        out.append((f"q{k}", rng.choice(["single", "multi", "fill"]), rng.choice([1, 2, 3]), rng.choice(topics), rng.choice([None, "", f"g{rng.randrange(max(1, n // 3))}"]), rng.choice([None, "src", "x類題"])))
    return out + [(f"v-q{k}-{j}", rng.choice(["single", "fill"]), 2, rng.choice(topics), None, None) for k in range(0, n, 5) for j in range(2)]


BANK = "id string, type string, diff int, topic string, grp string, src string"


@pytest.mark.parametrize("seed", range(5))
def test_similar_questions(spark, seed):
    rng = random.Random(seed)
    bank = bank_of(rng, rng.choice([6, 60, 300]), ["a", "b", "c"][: rng.choice([1, 3])])
    ids = [b[0] for b in bank]
    counts = {(u, i): rng.randint(1, 3) for u in range(4) for i in rng.sample(ids, rng.choice([0, 3, len(ids) // 2]))}
    done = {(u, i) for u in range(4) for i in rng.sample(ids, rng.choice([0, 2, len(ids) // 2, len(ids)]))}
    wanted = {(u, rng.choice(ids)) for u in range(5) for _ in range(4)}
    by_id = {b[0]: b for b in bank}
    want = []
    for u, q in wanted:
        _, kind, diff, topic, _, _ = by_id[q]
        c = [b for b in bank if b[3] == topic and b[0] != q and (u, b[0]) not in done]
        c = [b for b in c if b[1] == kind] or c
        rank = lambda b: (not (b[0].startswith("v-" + q) or "類題" in (b[5] or "")), b[2] != diff, counts.get((u, b[0]), 0), b[0])  # noqa: B023, E731
        want += [(u, q, b[0], k) for k, b in enumerate(sorted(c, key=rank)[:5], 1)]
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    got = select.similar(frame(bank, BANK), frame(wanted, "user_id long, qid string"), frame([(*k, n) for k, n in counts.items()], "user_id long, qid string, n long"), frame(done, "user_id long, qid string")).collect()
    assert sorted((r["user_id"], r["qid"], r["id"], r["rank"]) for r in got) == sorted(want)
    picked = [(r["user_id"], r["qid"]) for r in got if r["picked"]]
    assert sorted(picked) == sorted({(u, q) for u, q, _, _ in want})


@pytest.mark.parametrize("seed", range(5))
def test_papers(spark, monkeypatch, seed):
    monkeypatch.setattr(select, "CLASSES", 2)
    monkeypatch.setattr(select, "LEVELS", [18, 60, 1000])
    rng = random.Random(seed)
    bank = bank_of(rng, rng.choice([10, 80, 500]), ["a", "b", "c", "d"])
    ids = [b[0] for b in bank]
    counts = {(u, i): rng.randint(1, 3) for u in range(6) for i in rng.sample(ids, rng.choice([0, 5, len(ids) // 3, len(ids)]))}
    users = spark.createDataFrame([(u,) for u in range(6)], "user_id long")
    df = spark.createDataFrame(bank, BANK)
    tie = {(r["_c"], r["id"]): r["t"] for r in df.select("id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("_c")).withColumn("t", F.xxhash64(F.lit(1), "_c", "id")).collect()}
    classes = {r["user_id"]: r["c"] for r in users.withColumn("c", F.pmod(F.xxhash64(F.lit(1), "user_id"), F.lit(2)).cast("int")).collect()}
    want = []
    for u in range(6):
        taken, groups, use, no = set(), set(), {}, 0
        for kind, n, pattern in select.SECTIONS:
            for k in range(n):
                free = [b for b in bank if b[1] == kind and b[0] not in taken and (b[4] or b[0]) not in groups]
                free = [b for b in free if b[2] == pattern[k % len(pattern)]] or free
                if not free:
                    break
                b = min(free, key=lambda b: (use.get(b[3], 0), counts.get((u, b[0]), 0), tie[classes[u], b[0]], b[0]))
                taken.add(b[0])
                groups.add(b[4] or b[0])
                use[b[3]] = use.get(b[3], 0) + 1
                no += 1
                want.append((u, no, b[0], b[1], b[2], b[3]))
    got = select.build_papers(df, users, spark.createDataFrame([(*k, n) for k, n in counts.items()], "user_id long, qid string, n long"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().toString()


def test_rotated_group(spark):
    groups = spark.createDataFrame([(g,) for g in "abcab"], "group_id string")
    last = spark.createDataFrame([(k, x) for k, x in enumerate(["a", "b", "c", None] * 5)], "user_id long, last_group string")
    got = {r["user_id"]: r["group_id"] for r in select.rotated_group(groups, last).collect()}
    assert len(got) == 20 and all(got[k] in "abc" and got[k] != x for k, x in enumerate(["a", "b", "c", None] * 5)) and len(set(got.values())) == 3
    one = spark.createDataFrame([("a",)], "group_id string")
    assert {r["group_id"] for r in select.rotated_group(one, last).collect()} == {"a"} and select.rotated_group(one.where("false"), last).count() == 0
