import datetime

import re

from pyspark.sql import functions as F

from quillstone.operators import analytics, exams, joins, limiter, merge, quality, select, windows
from quillstone.sources import generated, schemas, stores

D = datetime.date


def make(spark, name, *rows):
    """Rows of a known schema; fields that aren't given are null."""
    s = schemas.schema(name)
    return spark.createDataFrame([tuple(r.get(f.name) for f in s.fields) for r in rows], s)


def test_grouped_bank_judgement(spark):
    q = dict(topic="num", type="fill", diff=1, ans_txt=["1"])
    rows = [dict(q, id="a", q="⚡ 1+1"), dict(q, id="b", q="1+1"), dict(q, id="c", q="圖", needsFigure=True), dict(q, id="d", q=r"\cot x"), dict(q, id="e", q="x<script>"), dict(q, id="a", q="other"), dict(q, id="bad id", q="x"), dict(q, id="f", q="known")]
    items = make(spark, "question", *rows).withColumn("pos", F.monotonically_increasing_id())
    j = quality.judged(items, spark.createDataFrame([("known",)], "q string"))
    got = {(r["id"], r["q"]): r["reason"] for r in j.collect()}
    assert got == {("a", "1+1"): None, ("b", "1+1"): "duplicateLegacy", ("c", "圖"): "missingFigure", ("d", r"\cot x"): "outOfRange", ("e", "x<script>"): "suspiciousHtml", ("a", "other"): "duplicateId", ("bad id", "x"): "schema", ("f", "known"): "duplicateBuiltin"}
    r = quality.report(j).first()
    assert (r["sourceTotal"], r["accepted"], r["emojiCleaned"]) == (8, 1, 1)


def test_templates_and_violations(spark):
    q = dict(topic="num", type="fill", diff=1, ans_txt=["1"])
    t = quality.with_templates(make(spark, "question", dict(q, id="a", q="計算 12+3"), dict(q, id="b", q="計算 18+7"), dict(q, id="c", q="別的")))
    grp = {r["id"]: r["grp"] for r in t.collect()}
    assert grp["a"] == grp["b"] and grp["a"].startswith("legacy-") and grp["c"] is None
    bad = make(spark, "question", dict(q, id="constructor", q="x"), dict(q, id="x", q=""), dict(q, id="y", q="q", type="single", opts=["a"], ans_idx=[0]), dict(q, id="z", q="q", type="single", opts=["a", "b"], ans_idx=[2]), dict(q, id="ok-1", q="q"))
    assert {r["id"]: r["v"] for r in bad.select("id", quality.violation().alias("v")).collect()} == {"constructor": "id-reserved", "x": "question-missing", "y": "options-invalid", "z": "answer-invalid", "ok-1": None}


def test_weak_topics_and_calibration(spark):
    bank = spark.createDataFrame([(1, "num"), (2, "vec")], "qid int, topic string")
    rows = [("u", 1, k, False, k) for k in range(4)] + [("u", 2, 10 + k, True, 10 + k) for k in range(6)]
    a = spark.createDataFrame(rows, "user_id string, qid int, ts long, ok boolean, seq int")
    assert [(r["topic"], r["n"], r["ok"]) for r in analytics.weak_topics(a, bank).collect()] == [("num", 4, 0)]
    system = spark.createDataFrame([("u", D(2026, 7, k), float(ok), 12, ok / 12, k) for k, ok in ((1, 9), (2, 10), (3, 9))], "user_id string, d date, ok double, n int, acc double, seq int")
    none = make(spark, "ext_mock")
    c = analytics.calibration(none, system, F.lit("2026-07-10").cast("date")).first()
    assert (c["count"], c["passes"], c["stable"], c["grade"], c["stale_days"]) == (3, 3, True, "13 級分", 7)
    ext = make(spark, "ext_mock", dict(user_id="u", id="1", d=D(2026, 7, 4), ts=1, score=68.0, total=100, questions=20), dict(user_id="u", id="2", d=D(2026, 7, 5), ts=2, score=74.0, total=100, questions=20), dict(user_id="u", id="3", d=D(2026, 7, 6), ts=3, score=99.0, total=100, questions=19))
    ok = analytics.eligible_external(ext, make(spark, "paper_run"), spark.createDataFrame([], "id string, questions int, calibrationEligible boolean"))
    c = analytics.calibration(ok, system, F.lit("2026-07-10").cast("date")).first()
    assert (c["source"], round(c["acc"], 2), c["count"]) == ("external", 0.71, 2)


def test_metrics_and_gaps(spark):
    s = spark.createDataFrame([("q", "a", 1000, 2000, 0), ("q", "b", 20000, 21000, 0), ("q", "c", 22000, 23000, 0)], "qid string, id string, t0 long, t1 long, since long")
    e = spark.createDataFrame([("q",), ("r",)], "qid string")
    got = {r["qid"]: r for r in analytics.process_metrics(s, e, ["qid"], "since", F.lit(30000)).collect()}
    assert (got["q"]["fi"], got["q"]["hes"], got["q"]["era"], got["q"]["tail"], got["q"]["n"]) == (1, [[2, 18]], 1, 7, 3)
    assert got["r"]["n"] == 0 and got["r"]["fi"] is None
    g = windows.segments(windows.gaps(s, ["qid"], "t0", "t1", "id"), ["qid"], ["t0"], F.col("gap") >= 5000, F.col("gap"), 9)
    assert [r["segment"] for r in g.orderBy("t0").collect()] == [0, 1, 1]


def test_merges(spark):
    pack = "id string, rev int, pos int"
    u = merge.union_by_id(spark.createDataFrame([("same", 2, 0), ("new", 1, 1), ("old", 1, 2)], pack), spark.createDataFrame([("same", 1, 0), ("old", 1, 1)], pack), ["id"])
    assert {r["id"]: r["rev"] for r in u.collect()} == {"same": 2, "old": 1, "new": 1}
    w = lambda **k: make(spark, "wrong", dict(user_id="u", qid="q", **k))
    assert merge.merge_wrong(w(mt=10, itv=1), w(mt=20, itv=7)).first()["itv"] == 7
    assert merge.merge_wrong(w(itv=3, fails=1), w(itv=3, fails=1, wins=1)).first()["wins"] == 1
    assert merge.merge_wrong(w(itv=3, fails=1, err="a"), w(itv=3, fails=1, err="b")).first()["err"] == "a"
    at = lambda *ks: make(spark, "attempt", *[dict(user_id="u", qid=f"q{k}", ts=k, ms=1, ok=True) for k in ks]).withColumn("pos", F.col("ts"))
    assert [r["qid"] for r in merge.merge_attempts(at(1, 2), at(2, 3)).orderBy("ts").collect()] == ["q1", "q2", "q3"]
    log = lambda ts, kind="", note="": (ts, kind, note, 0, False, None, None)
    entry = lambda no, **k: dict(user_id="u", batch_id="b", qid=f"q{no}", examNo=no, mt=1, **k)
    a = make(spark, "correction_entry", entry(1, done=True, completedAt=5, outcome="independent", logs=[log(1, note="x")]), entry(2, done=False))
    b = make(spark, "correction_entry", entry(1, done=False, logs=[log(2, note="y")]), entry(2, done=True, completedAt=6))
    m = {r["examNo"]: r for r in merge.merge_corrections(a, b).collect()}
    assert m[1]["done"] and m[2]["done"] and [x["note"] for x in m[1]["logs"]] == ["x", "y"] and m[1]["outcome"] == "independent"


def test_review_and_grade_merge(spark):
    log = lambda ts, kind="", note="": (ts, kind, note, 0, False, None, None)
    r = lambda **k: make(spark, "review", dict(user_id="u", run_id="r", no=1, **k))
    m = merge.merge_reviews(r(attempts=2, mt=1, detailFirstOpenedAt=100, detailViewCount=1, completedAt=5000, logs=[log(1, note="a"), log(2, note="b")]), r(attempts=1, mt=2, detailFirstOpenedAt=220, detailViewCount=2, logs=[log(5500, note="done")])).first()
    assert (m["attempts"], m["detailFirstOpenedAt"], m["detailViewCount"], len(m["logs"])) == (2, 100, 2, 3)
    g = lambda *rows: make(spark, "grade_item", *[dict(user_id="u", run_id="r", gradedAt=1, **x) for x in rows])
    none = spark.createDataFrame([], "run_id string, no int, changed boolean")
    m = merge.merge_grades(g(dict(no=1, status="correct", points=5.0, mt=10), dict(no=2, status="correct", points=5.0)), g(dict(no=1, status="incorrect", points=0.0), dict(no=2, status="incorrect", points=0.0, mt=9)), none, none)
    assert {r["no"]: r["status"] for r in m.collect()} == {1: "correct", 2: "incorrect"}


def test_strokes_and_tombstones(spark):
    rows = [("p", "shared", 1, 2, None, False, 1), ("p", "shared", 1, 3, None, False, 2), ("p", "only-a", 1, 2, None, False, 1), ("p", "only-b", 4, 5, None, False, 1), ("p", "only-a", None, None, None, True, 9)]
    live, gone = merge.merge_strokes(spark.createDataFrame(rows, "qid string, id string, t0 long, t1 long, dead long, deleted boolean, seq int"), ["qid"])
    assert sorted(r["id"] for r in live.collect()) == ["only-b", "shared"] and [r["id"] for r in gone.collect()] == ["only-a"]


def test_retry_count(spark):
    rows = [([(100, ""), (5000, ""), (5900, "")], 5000, 0, 2), ([(1, "retry"), (2, "complete"), (3, "")], 0, 0, 2)]
    df = spark.createDataFrame(rows, "logs array<struct<ts:long,kind:string>>, a long, b long, want int")
    assert all(r[0] == r[1] for r in df.select(merge.retry_count(F.col("logs"), F.col("a"), F.col("b")), "want").collect())


def test_dedup_and_papers(spark):
    q = [(0, "k1", "abcdefghijkl 1"), (1, "k1", "abcdefghijkl other"), (2, "k2", "abcdefghijkl other 2")]
    lists = spark.createDataFrame([("l", p, str(p), g, t, None) for p, g, t in q], "list string, pos int, id string, grp string, q string, src string")
    assert [r["pos"] for r in select.deduped(lists, ["list"], 2).orderBy("rank").collect()] == [0, 2]
    bank = spark.createDataFrame([(f"q{k}", ["single", "multi", "fill"][k % 3], k // 3 % 3 + 1, f"t{k % 7}", f"g{k // 2}") for k in range(180)], "id string, type string, diff int, topic string, grp string")
    none = spark.createDataFrame([], "user_id string, qid string, n long")
    p = select.build_papers(bank, spark.createDataFrame([("u",), ("v",)], "user_id string"), none).toPandas()
    for _, one in p.groupby("user_id"):
        assert len(one) == 17 == one["qid"].nunique() and one["type"].value_counts().to_dict() == {"single": 6, "multi": 6, "fill": 5}


def test_limits_and_refunds(spark):
    t = datetime.datetime(2026, 1, 1, 1)
    rows = [("u", t + datetime.timedelta(seconds=s), k, w) for k, (s, w) in enumerate([(0, 12), (2, 1), (4, 30), (100, 20), (200, 20), (300, 20), (400, 20), (500, 20), (600, 8)])]
    got = limiter.limited(spark.createDataFrame(rows, "user_id string, ts timestamp, seq int, weight int")).orderBy("seq").collect()
    assert [r["reason"] for r in got] == ["", "rate_limited", "", "", "", "", "", "daily_limit", "" if 112 + 8 <= 120 else "x"]
    e = spark.createDataFrame([("u", D(2026, 1, 1), 1, -1, 5), ("u", D(2026, 1, 1), 2, 1, 3), ("u", D(2026, 1, 1), 3, 1, 4), ("u", D(2026, 1, 1), 4, -1, 3)], "user_id string, usage_date date, seq int, delta int, weight int")
    r = limiter.with_refunds(e).first()
    assert (r["requests"], r["weight"]) == (1, 4)


def test_regrade(spark):
    key = spark.createDataFrame([(1, "single", 5.0, [0], None), (2, "multi", 5.0, [0, 2], None), (3, "fill", 5.0, None, ["1/2"])], "no int, type string, points double, ans_idx array<int>, ans_txt array<string>")
    schema = "run_id string, no int, status string, points double, finalAnswer string, selectedOptions array<int>, hasFinalAnswer boolean, pos int"
    items = [("r", 1, "correct", 5.0, None, [2], True, 0), ("r", 1, "correct", 5.0, None, [1], True, 1), ("r", 2, "unanswered", 0.0, None, [1], True, 0), ("r", 3, "incorrect", 0.0, "0.5", None, True, 0), ("s", 2, "incorrect", 2.9, None, None, True, 0)]
    g = {(r["run_id"], r["no"]): r for r in exams.regraded(spark.createDataFrame(items, schema), key).collect()}
    assert [(g["r", k]["status"], g["r", k]["points"]) for k in (1, 2, 3)] == [("incorrect", 0.0), ("incorrect", 3.0), ("correct", 5.0)]
    assert g["s", 2]["points"] == 3.0 and g["r", 1]["run_ok"] and not g["s", 2]["run_ok"]
    marks = exams.option_marks(exams.regraded(spark.createDataFrame(items, schema), key).where("run_id = 'r'")).collect()
    assert sorted((r["option"], r["mark"]) for r in marks) == [(1, "check"), (3, "add")]


def test_generated(spark):
    q = generated.questions(spark)
    a = {r["id"]: r["ans_txt"][0] for r in q.collect()}
    assert len(a) == 280 and generated.duplicate_ids(q).count() == 0
    want = {"core-num-symmetric-1": "18", "core-prob-without-replace-1": "3/10", "core-trig1-area-1": "6", "core-mat-product-1": "0", "core-prob-at-least-one-1": "3/4", "core-trig1-right-sin-6": "3/5", "core-line-slope-3": "3", "core-seq-geometric-sum-1": "7", "core-vec-perpendicular-1": "-1"}
    assert {k: a[k] for k in want} == want


def test_stores(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"user_id":"u","revision":3}\nnot json\n')
    good, bad = stores.read_state(spark, str(tmp_path / "s.json"), schemas.schema("app_state"), {"data": "{}"})
    assert good.first()["data"] == "{}" and bad.count() == 1
    log = spark.createDataFrame([("a", "u", 101, False, "pending"), ("b", "u", 50, False, "pending")], "client_id string, user_id string, updatedAt long, uploaded boolean, upload_state string")
    sent = spark.createDataFrame([("a", 100), ("b", 50)], "client_id string, updatedAt long")
    assert {r["client_id"]: r["upload_state"] for r in stores.acknowledged(log, sent).collect()} == {"a": "pending", "b": "uploaded"}
    files = spark.createDataFrame([("p.json", bytearray(b"[]")), ("q.json", bytearray(b"{}"))], "name string, content binary")
    import hashlib

    m = spark.createDataFrame([("p", "p.json", hashlib.sha256(b"[]").hexdigest()), ("q", "q.json", "0" * 64)], "id string, file string, sha256 string")
    assert [r["id"] for r in stores.verified_packs(files, m).collect()] == ["p"]
    rows = spark.createDataFrame([("a", "x"), (None, "y"), ("b", "z")], "user_id string, v string")
    assert sorted(r["v"] for r in quality.visible_rows(rows, "a", True).collect()) == ["x", "y"] and quality.visible_rows(rows, None, True).count() == 0
    n = merge.commit_state(spark, str(tmp_path / "versions"), "u", lambda old: (old or "") + "x")
    assert (n, merge.commit_state(spark, str(tmp_path / "versions"), "u", lambda old: old + "y")) == (1, 2)


def test_joins(spark):
    boxes = spark.createDataFrame([(1, 0.5, 0.5, 0.05)], "b int, x double, y double, radius double")
    points = spark.createDataFrame([(1, 0.52, 0.5), (2, 0.6, 0.5)], "p int, px double, py double")
    assert [r["p"] for r in joins.grid_candidates(boxes, points, "radius").collect()] == [1]
    ev = spark.createDataFrame([("k", 10_000)], "k string, at long")
    logs = spark.createDataFrame([("k", 8_500, 1), ("k", 11_500, 2), ("k", 20_000, 3)], "k string, t long, i int")
    assert [r["i"] for r in joins.nearest_within(ev, logs, ["k"], "at", "t", 2000, "i").collect()] == [1]


def test_deduped_matches_a_plain_fold(spark):
    import random

    rng = random.Random(8)
    rows = [(l, p, f"i{p}", f"question about {'abcdefgh'[rng.randrange(8)]} number x{rng.randrange(3)}" if rng.random() < 0.8 else "short", None, f"g{rng.randrange(6)}" if rng.random() < 0.7 else "") for l in range(8) for p in rng.sample(range(500), 90)]
    got = {}
    for r in select.deduped(spark.createDataFrame(rows, "list int, pos long, id string, q string, src string, grp string"), ["list"], 7).orderBy("list", "rank").collect():
        got.setdefault(r["list"], []).append(r["pos"])
    for l in range(8):
        mine = sorted(r for r in rows if r[0] == l)
        taken, keys, forms = [], set(), set()
        for _, p, i, q, _, g in mine:
            k, s = g or i, re.sub(r"\s+", "", re.sub("[0-9]+", "#", q)).lower()
            if len(taken) < 7 and k not in keys and not (len(s) >= 12 and s in forms):
                taken.append(p)
                keys.add(k)
                forms.add(s)
        assert got[l] == (taken + [p for _, p, *_ in mine if p not in taken])[:7]
