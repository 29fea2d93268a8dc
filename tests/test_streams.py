import uuid

from quillstone.streaming import journal


def stream(spark, tmp_path, df):
    path = str(tmp_path / uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def run(spark, tmp_path, s, mode, key=None):
    return journal.run_available(s, str(tmp_path / uuid.uuid4().hex), mode, str(tmp_path / uuid.uuid4().hex), key)


def test_strokes(spark, tmp_path):
    rows = [("p", "a", 5, 1, False), ("p", "a", 3, 2, False), ("p", "b", 1, 3, False), ("p", "b", -1, 4, True), ("p", "b", 9, 5, False)]
    s = stream(spark, tmp_path, spark.createDataFrame(rows, "qid string, id string, t1 long, seq long, deleted boolean"))
    got = {r["id"]: (r["t1"], r["seq"], r["deleted"]) for r in run(spark, tmp_path, journal.latest_strokes(s), "update", ["qid", "id"]).collect()}
    assert got == {"a": (5, 1, False), "b": (9, 5, True)}


def test_limits(spark, tmp_path):
    rows = [("u", "2026-01-01", t, k, 12) for k, t in enumerate([0, 2000, 5000])]
    s = stream(spark, tmp_path, spark.createDataFrame(rows, "user_id string, usage_date string, ms long, seq long, weight long"))
    got = {r["seq"]: r["reason"] for r in run(spark, tmp_path, journal.limited(s), "append").collect()}
    assert got == {0: "", 1: "rate_limited", 2: ""}


def test_segments(spark, tmp_path):
    rows = [("u", k, t, t + 10) for k, t in enumerate([0, 20, 500, 520])]
    s = stream(spark, tmp_path, spark.createDataFrame(rows, "user_id string, seq long, t0 long, t1 long"))
    got = [r["segment"] for r in run(spark, tmp_path, journal.segments_stateful(s, 100), "append").orderBy("seq").collect()]
    assert got == [0, 0, 1, 1]


def test_sink_is_safe_to_repeat(spark, tmp_path):
    path = str(tmp_path / "sink")
    write = journal.upsert_sink(path, ["k"], "t")
    a, b = (spark.createDataFrame(r, "k string, t long, v string") for r in ([("x", 1, "old"), ("y", 1, "y")], [("x", 2, "new")]))
    for batch, n in ((a, 0), (b, 1), (a, 0)):
        write(batch, n)
    assert {r["k"]: r["v"] for r in journal.latest_of(spark, path, ["k"], "t").collect()} == {"x": "new", "y": "y"}


def test_compaction_keeps_the_last_rows_only(spark, tmp_path):
    path = str(tmp_path / "sink")
    write = journal.upsert_sink(path, ["k"], "t")
    frame = lambda r: spark.createDataFrame(r, "k string, t long, v string")
    last = lambda: {r["k"]: r["v"] for r in journal.latest_of(spark, path, ["k"], "t").collect()}
    write(frame([("x", 1, "a"), ("y", 1, "y")]), 0)
    write(frame([("x", 9, "b")]), 1)
    for number in range(2, 5):
        journal.compact(spark, path, ["k"], "t")
        assert [p.name.startswith("batch=-") for p in (tmp_path / "sink").iterdir() if p.name.startswith("batch=")] == [True]
        assert spark.read.parquet(path).count() == len(last()) and last()["y"] == "y"
        write(frame([("x", 2, f"c{number}")]), number)  # a later batch wins whatever its time
        assert last()["x"] == f"c{number}"
    write(frame([("x", 9, "b")]), 1)  # an old batch that is repeated changes nothing
    assert last() == {"x": "c4", "y": "y"}
