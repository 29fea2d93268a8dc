"""Registered queries over the star schema that stands for practice records, with DuckDB SQL for each.

events are attempts, part is the question bank, orders are exams, lineitem graded
items, customer learners, conversations logs, pages untrusted markup.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, scoring, text
from ..operators import analytics, exams, joins, limiter, merge, quality, select, windows
from ..sources import generated, stores

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
TODAY = "2024-01-20"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; a session without one is taken for a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(base or f'/tmp/quillstone-scratch-{os.getpid()}').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def query_in(queries: dict, sqls: dict):
    """A decorator that registers a query in these two, with its SQL if there is one."""

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = sql
            return f

        return add

    return query


query = query_in(QUERIES, ORACLE_SQL)


def micro(c):
    """Six decimals, half up: the same text in both engines."""
    return F.floor(c * 1e6 + 0.5) / 1e6


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts_of(read(spark, sf_dir, "events"))


def attempts_of(e: DataFrame) -> DataFrame:
    return e.select("user_id", F.col("event_id").alias("seq"), "ts", (F.col("event_type") != "error").alias("ok"), F.floor(F.col("value") * 1000).alias("ms"), F.get_json_object("props", "$.k").cast("long").alias("qid"), dates.local_day(F.col("ts")).alias("d"), F.col("event_type").alias("mode"))


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("qid"), F.col("p_brand").alias("topic"), F.col("p_type").alias("type"), (F.col("p_size") % 3 + 1).alias("diff"), F.lit(None).cast("int").alias("target"))


A = """with a as (select user_id, event_id as seq, ts, event_type <> 'error' as ok, cast(floor(value * 1000) as bigint) as ms,
 cast(json_extract_string(props, '$.k') as bigint) as qid, cast(ts + interval 8 hour as date) as d, event_type as mode from events),
b as (select p_partkey as qid, p_brand as topic, p_type as type, p_size % 3 + 1 as diff from part)"""
GRADE = "case when {0} >= 0.84 then '15 級分' when {0} >= 0.78 then '14 級分' when {0} >= 0.72 then '13 級分' when {0} >= 0.66 then '12 級分' when {0} >= 0.6 then '11 級分' when {0} >= 0.54 then '10 級分' when {0} >= 0.48 then '9 級分' when {0} >= 0 then '8 級分以下' end"
WILSON = "(1.96 * sqrt((p * (1 - p) + 1.96 * 1.96 / (4 * n)) / n) / (1 + 1.96 * 1.96 / n))"
MID = "((p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n))"
ITEMS = """i as (select * from (select l_orderkey as run_id, l_linenumber as no, l_returnflag as flag, l_partkey, l_quantity, l_extendedprice,
 row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) as n from lineitem) where n = 1)"""


def graded_items(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    first = windows.first_per_key(l, ["l_orderkey", "l_linenumber"], order)
    return first.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("no"), F.col("l_returnflag").alias("flag"), "l_partkey", "l_quantity", "l_extendedprice")


@query(A + f", g as (select user_id, topic, count(*) as n, count(*) filter (where ok) as ok from a join b using (qid) group by all), p as (select *, ok::double / n as p from g) select user_id, topic, n, ok, floor(greatest(0, {MID} - {WILSON}) * 1e6 + 0.5) / 1e6 as low, floor(least(1, {MID} + {WILSON}) * 1e6 + 0.5) / 1e6 as high, {GRADE.format('p')} as grade from p")
def mastery_wilson(spark, sf_dir):
    m = analytics.mastery(attempts(spark, sf_dir), bank(spark, sf_dir))
    return m.select("user_id", "topic", "n", "ok", micro(F.col("low")).alias("low"), micro(F.col("high")).alias("high"), "grade")


@query(A + ", u as (select user_id, d, 1 as n, ok::int as ok, ms, case diff when 1 then 1 when 2 then 2 when 3 then 4 else 2 end as pts from a left join b using (qid) union all select o_custkey, cast(o_orderdate as date), 12, cast(floor(12 * (o_orderkey % 101) / 100.0 + 0.5) as int), 12 * (o_orderkey % 50), 3 from orders) select user_id, cast(d as varchar) as d, count(*) as rows_n, sum(n)::bigint as n, sum(ok)::bigint as ok, sum(ms)::double as ms, sum(pts)::double as pts from u group by all")
def day_rollup(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("d"), F.lit(None).cast("int").alias("n"), (F.col("o_orderkey") % 101).alias("acc"), (F.col("o_orderkey") % 50).alias("med"))
    a = attempts(spark, sf_dir)
    r = analytics.day_rollup(a, bank(spark, sf_dir), o)
    rows = a.select("user_id", "d").unionByName(o.select("user_id", "d")).groupBy("user_id", "d").agg(F.count("*").alias("rows_n"))
    return r.join(rows, ["user_id", "d"]).select("user_id", F.col("d").cast("string").alias("d"), "rows_n", "n", "ok", "ms", "pts")


@query(A + ", r as (select user_id, d, diff, 0 as drill from a join b using (qid) union all select user_id, d, diff, 0 from a join b using (qid) where seq % 5 = 0 union all select o_custkey, cast(o_orderdate as date), null, 12 from orders) select user_id, cast(d as varchar) as d, sum(drill)::bigint as drill, count(*) filter (where diff = 1) as easy, count(*) filter (where diff = 2) as mid, count(*) filter (where diff = 3) as hard from r group by all")
def day_buckets(spark, sf_dir):
    a = attempts(spark, sf_dir)
    drills = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("d"), F.lit(None).cast("int").alias("n"))
    return analytics.day_buckets(a, a.where("seq % 5 = 0"), drills, bank(spark, sf_dir)).withColumn("d", F.col("d").cast("string"))


@query(A + ", u as (select user_id, d, case diff when 1 then 1 when 2 then 2 when 3 then 4 else 2 end as pts from a left join b using (qid)) select user_id, cast(d as varchar) as d, sum(pts)::double as pts from u group by all having sum(pts) >= 30")
def goal_days(spark, sf_dir):
    return analytics.goal_days(analytics.day_rollup(attempts(spark, sf_dir), bank(spark, sf_dir))).withColumn("d", F.col("d").cast("string"))


@query(A + " select user_id, qid, count(*) as n from a group by all")
def attempt_counts(spark, sf_dir):
    return analytics.attempt_counts(attempts(spark, sf_dir))


@query(A + " select user_id, qid, min(case when ok then ms end) as best_ms, bool_or(not ok) as ever_wrong from a group by all")
def personal_best(spark, sf_dir):
    return analytics.personal_best(attempts(spark, sf_dir))


@query(A + ", l as (select * from (select *, row_number() over (partition by user_id order by ts desc, seq desc) as n60 from a) where n60 <= 60), j as (select l.*, topic, row_number() over (partition by user_id, topic order by ts desc, seq desc) as n4 from l join b using (qid)), g as (select user_id, topic, count(*) as n, count(*) filter (where ok) as ok, count(*) filter (where n4 <= 4) = 4 and not bool_or(ok and n4 <= 4) as tail from j group by all) select user_id, topic, n, ok, floor(ok::double / n * 1e6 + 0.5) / 1e6 as acc from g where (n >= 6 and ok::double / n <= 0.35) or tail")
def weak_topics(spark, sf_dir):
    w = analytics.weak_topics(attempts(spark, sf_dir), bank(spark, sf_dir))
    return w.withColumn("acc", micro(F.col("acc")))


EXAMS = "x as (select o_custkey as user_id, o_orderkey as seq, cast(o_orderdate as date) as d, cast(floor(o_totalprice) as bigint) % 101 as score, o_orderpriority from orders)"


@query(f"with {EXAMS}, e as (select * from (select *, row_number() over (partition by user_id order by d desc, seq desc) as n3 from x where o_orderpriority = '1-URGENT' and seq % 3 <> 0) where n3 <= 3), s as (select * from (select *, row_number() over (partition by user_id order by seq desc) as n3 from x where o_orderpriority <> '1-URGENT') where n3 <= 3 and user_id not in (select user_id from e)), r as (select user_id, 'external' as source, d, score, score / 100.0::double as acc from e union all select user_id, 'system', d, score, score / 100.0::double from s), g as (select user_id, source, count(*) as count, sum(score)::double as ok, 100.0 * count(*) as n, min(acc) as mn, max(acc) as mx, count(*) filter (where acc >= 0.72) as passes, max(d) as last_day from r group by all), p as (select *, ok / n as p from g) select user_id, source, count, ok, n::double as n, floor(p * 1e6 + 0.5) / 1e6 as acc, floor((case when source = 'external' then mn else greatest(0, {MID} - {WILSON}) end) * 1e6 + 0.5) / 1e6 as low, floor((case when source = 'external' then mx else least(1, {MID} + {WILSON}) end) * 1e6 + 0.5) / 1e6 as high, {GRADE.format('p')} as grade, passes, count = 3 and passes = 3 as stable, greatest(0, date '2024-01-20' - last_day) as stale_days from p")
def calibration_last3(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("seq"), F.to_date("o_orderdate").alias("d"), (F.floor("o_totalprice") % 101).cast("double").alias("score"), "o_orderpriority")
    runs = spark.createDataFrame([], "user_id long, id string, sourceId string")
    sources = spark.createDataFrame([("full", 20, True), ("short", 19, False)], "id string, questions int, calibrationEligible boolean")
    external = o.where("o_orderpriority = '1-URGENT'").select("user_id", F.col("seq").alias("id"), F.lit(None).cast("string").alias("paperRunId"), F.when(F.col("seq") % 3 == 0, "short").otherwise("full").alias("sourceId"), "d", F.col("seq").alias("ts"), "score", F.lit(100).alias("total"), F.lit(20).alias("questions"), F.lit(True).alias("calibrationEligible"))
    system = o.where("o_orderpriority <> '1-URGENT'").select("user_id", "seq", "d", F.col("score").alias("ok"), F.lit(100).alias("n"), (F.col("score") / 100).alias("acc"))
    c = analytics.calibration(analytics.eligible_external(external, runs, sources), system, F.lit(TODAY).cast("date"))
    return c.withColumns({k: micro(F.col(k)) for k in ("acc", "low", "high")})


@query(A + ", f as (select user_id, count(*) filter (where not ok and seq % 97 = 0) as dc, count(*) filter (where seq % 211 = 0) as dou, count(*) filter (where seq % 331 = 0) as dv, count(*) filter (where mode = 'purchase') as ex, date '2024-01-31' - max(case when mode = 'purchase' then d end) as stale, count(distinct case when not ok then qid % 3 end) - 2 as wt, count(*) filter (where qid = 7) as cn from a group by user_id), k as (select *, case when dc > 0 then 'correction' when dou > 0 then 'outline' when dv > 0 then 'vision' when ex = 0 then 'mock' when stale >= 7 then 'mock' when wt > 0 then 'topic' when cn > 0 then 'concept' else 'vision' end as kind from f) select user_id, kind, (case when kind = 'correction' then greatest(10, dc * 5) when kind = 'vision' and dv > 0 then greatest(5, dv * 4) when kind = 'mock' then 100 when kind = 'outline' then 15 when kind = 'topic' then 20 when kind = 'concept' then 5 else 40 end)::int as minutes from k")
def next_action(spark, sf_dir):
    a = attempts(spark, sf_dir)
    c = lambda cond: F.count_if(cond)
    f = a.groupBy("user_id").agg(c(~F.col("ok") & (F.col("seq") % 97 == 0)).alias("due_corrections"), c(F.col("seq") % 211 == 0).alias("due_outlines"), c(F.col("seq") % 331 == 0).alias("due_vision"), c(F.col("mode") == "purchase").alias("exams"), F.datediff(F.lit("2024-01-31").cast("date"), F.max(F.when(F.col("mode") == "purchase", F.col("d")))).alias("stale_days"), (F.count_distinct(F.when(~F.col("ok"), F.col("qid") % 3)) - 2).alias("weak_topics"), c(F.col("qid") == 7).alias("due_concepts"))
    return analytics.next_action(f)


DUE = "l as (select * from (select user_id, qid, case when seq % 4 = 0 then null else d + 2 end as due, row_number() over (partition by user_id, qid order by ts desc, seq desc) as n from a) where n = 1)"


def _due_log(spark, sf_dir):
    return attempts(spark, sf_dir).select("user_id", "qid", "ts", "seq", F.when(F.col("seq") % 4 != 0, F.date_add("d", 2)).alias("due"))


@query(A + f", {DUE}, k as (select * from l where qid in (select qid from b)) select user_id, count(*) filter (where due is null or due <= date '{TODAY}') as due, (select count(*) from b) - count(*) as never from k group by user_id")
def due_badges(spark, sf_dir):
    return analytics.due_counts(bank(spark, sf_dir), _due_log(spark, sf_dir), "qid", F.lit(TODAY).cast("date"), ["ts", "seq"])


STATUS = "case flag when 'A' then 'correct' when 'N' then 'incorrect' else 'unanswered' end"


@query(f"with {ITEMS}, s as (select run_id, no, {STATUS} as status, case when flag = 'A' then l_quantity / 3 else 0 end as points from i) select run_id, count(*) filter (where status = 'correct') as ok_n, floor(list_sum(list(points order by no)) * 100 + 0.5) / 100 as score, coalesce(list_aggregate(list(no order by no) filter (where status <> 'correct'), 'string_agg', ','), '') as wrong_nos, coalesce(list_aggregate(list(no order by no) filter (where status = 'unanswered'), 'string_agg', ','), '') as unanswered_nos from s group by run_id")
def exam_result(spark, sf_dir):
    i = graded_items(spark, sf_dir)
    s = i.select("run_id", "no", F.when(F.col("flag") == "A", "correct").when(F.col("flag") == "N", "incorrect").otherwise("unanswered").alias("status"), F.when(F.col("flag") == "A", F.col("l_quantity") / 3).otherwise(0.0).alias("points"))
    r = analytics.exam_result(s, ["run_id"])
    return r.select("run_id", "ok_n", "score", *[F.array_join(c, ",").alias(c) for c in ("wrong_nos", "unanswered_nos")])


@query(f"with {ITEMS}, k as (select o_orderkey as run_id, unnest(range(1, 8)) as no from orders), j as (select k.run_id, case when l_quantity > 25 then cast(l_quantity as int) % 3 + 1 when flag = 'A' then 1 end as level from k left join i on i.run_id = k.run_id and i.no = k.no) select run_id, count(*) filter (where level is null) as open, count(*) filter (where level = 1) as l1, count(*) filter (where level = 2) as l2, count(*) filter (where level = 3) as l3 from j group by run_id")
def level_histogram(spark, sf_dir):
    i = graded_items(spark, sf_dir)
    keys = joins.numbered(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id")), F.lit(7))
    items = i.select("run_id", "no", F.when(F.col("flag") == "A", "correct").otherwise("incorrect").alias("status"))
    reviews = i.select("run_id", "no", (F.col("l_quantity") > 25).alias("done"), (F.col("l_quantity").cast("int") % 3 + 1).alias("level"))
    return analytics.run_level_counts(keys, items, reviews)


@query(f"with {ITEMS}, t as (select run_id % 50 as grp, p_brand as tag, run_id * 10 + no as pos from i join part on p_partkey = l_partkey where flag <> 'A'), c as (select grp, tag, count(*) as cnt, min(pos) as f from t group by all) select grp, tag, cnt, rank from (select *, row_number() over (partition by grp order by cnt desc, f, tag) as rank from c) where rank <= 4")
def learning_summary_top4(spark, sf_dir):
    i = graded_items(spark, sf_dir).where("flag <> 'A'").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    t = i.select((F.col("run_id") % 50).alias("grp"), F.col("p_brand").alias("tag"), (F.col("run_id") * 10 + F.col("no")).alias("pos"))
    return analytics.top_tags(t, ["grp"], "tag", "pos")


@query("select source as src, count(*) as n, count(distinct lang) as topics, count(*) filter (where n_chars % 3 = 0) as d1, count(*) filter (where n_chars % 3 = 1) as d2, count(*) filter (where n_chars % 3 = 2) as d3 from documents group by source")
def content_stats(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("src"), F.col("lang").alias("topic"), (F.col("n_chars") % 3 + 1).alias("diff"))
    return analytics.content_stats(d)


@query(A + f", now as (select user_id, topic, count(*) as now_n, avg(ok::int) as now from a join b using (qid) where d >= date '{TODAY}' group by all), past as (select user_id, topic, count(*) as past_n, avg(ok::int) as past from a join b using (qid) where d < date '{TODAY}' group by all) select user_id, topic, now_n, floor(now * 1e6 + 0.5) / 1e6 as now, past_n, floor(past * 1e6 + 0.5) / 1e6 as past, past < 0.6 and now = 1 as strong from now join past using (user_id, topic) where past_n >= 5 and now > past")
def round_vs_history(spark, sf_dir):
    a = attempts(spark, sf_dir)
    day = F.lit(TODAY).cast("date")
    r = analytics.round_vs_history(a.where(F.col("d") >= day), a.where(F.col("d") < day), bank(spark, sf_dir))
    return r.withColumns({c: micro(F.col(c)) for c in ("now", "past")})


@query(f"with {ITEMS}, v as (select run_id, no, 5.0 as full, list_distinct([cast(l_quantity as int) % 5 + 1, l_partkey % 5 + 1]) as chosen, list_distinct([1 + no % 5, 1 + (no + 2) % 5]) as key from i), e as (select *, len(list_filter(range(1, 6), lambda x: list_contains(chosen, x) <> list_contains(key, x))) as errors from v) select run_id, no, errors, floor((case errors when 0 then 5.0 when 1 then 3.0 when 2 then 1.0 else 0.0 end) * 100 + 0.5) / 100 as points from e")
def multi_partial(spark, sf_dir):
    i = graded_items(spark, sf_dir)
    ints = lambda *c: F.array_distinct(F.array(*[x.cast("int") for x in c]))
    v = i.select("run_id", "no", ints(F.col("l_quantity").cast("int") % 5 + 1, F.col("l_partkey") % 5 + 1).alias("chosen"), ints(1 + F.col("no") % 5, 1 + (F.col("no") + 2) % 5).alias("key"))
    options = F.array(*[F.lit(k) for k in range(1, 6)])
    return v.select("run_id", "no", scoring.option_errors(F.col("chosen"), F.col("key"), options).cast("long").alias("errors"), scoring.round2(scoring.multi_points(F.lit(5.0), F.col("chosen"), F.col("key"), options)).alias("points"))


@query(f"with {ITEMS}, v as (select *, case no % 3 when 0 then 'single' when 1 then 'multi' else 'fill' end as type, cast(l_quantity as int) % 5 + 1 as o1, cast(l_partkey % 5 as int) + 1 as o2 from i), s as (select run_id, no, type, 5.0 as full, case when type = 'single' and flag = 'R' then [] when type = 'single' then [o1] when type = 'multi' then list_sort(list_distinct([o1, o2])) else [] end as picked, cast(o1 as varchar) as answer, case when flag = 'N' and no = 4 then 'uncertain' else 'correct' end as said from v), g as (select *, len(list_filter(range(1, 6), lambda x: list_contains(picked, x) <> list_contains([2, 4], x))) as errors from s), t as (select run_id, no, case when said = 'uncertain' then 'uncertain' when type = 'single' and len(picked) = 0 then 'uncertain' when type = 'single' then case when picked[1] = 3 then 'correct' else 'incorrect' end when type = 'multi' then case when errors = 0 then 'correct' else 'incorrect' end else case when answer = '3' then 'correct' else 'incorrect' end end as status, type, errors from g) select run_id, no, status, (case when status = 'correct' then 5.0 when status = 'uncertain' then 0.0 when type = 'multi' then case errors when 1 then 3.0 when 2 then 1.0 else 0.0 end else 0.0 end)::double as points from t")
def regrade(spark, sf_dir):
    i = graded_items(spark, sf_dir)
    o1, o2 = F.col("l_quantity").cast("int") % 5 + 1, (F.col("l_partkey") % 5).cast("int") + 1
    kind = F.when(F.col("no") % 3 == 0, "single").when(F.col("no") % 3 == 1, "multi").otherwise("fill")
    items = i.select("run_id", "no", F.when((F.col("flag") == "N") & (F.col("no") == 4), "uncertain").otherwise("correct").alias("status"), F.lit(5.0).alias("points"), F.when(kind == "fill", o1.cast("string")).alias("finalAnswer"), F.when((kind == "single") & (F.col("flag") == "R"), F.array().cast("array<int>")).when(kind == "single", F.array(o1)).when(kind == "multi", F.array(o1, o2)).alias("selectedOptions"), F.lit(True).alias("hasFinalAnswer"), F.lit(0).alias("pos"))
    key = spark.range(1, 8).select(F.col("id").cast("int").alias("no"), F.when(F.col("id") % 3 == 0, "single").when(F.col("id") % 3 == 1, "multi").otherwise("fill").alias("type"), F.lit(5.0).alias("points"), F.when(F.col("id") % 3 == 0, F.array(F.lit(2))).when(F.col("id") % 3 == 1, F.array(F.lit(1), F.lit(3))).alias("ans_idx"), F.when(F.col("id") % 3 == 2, F.array(F.lit("3"), F.lit("6/2"))).alias("ans_txt"))
    return exams.regraded(items, key).select("run_id", "no", "status", "points")


@query("select * from (values (1, true), (2, true), (3, false), (4, true), (5, true), (6, false), (7, true), (8, false)) t(id, ok)")
def check_fill_cases(spark, sf_dir):
    rows = [(1, "0.5", ["1/2"]), (2, "5,-1", ["-1,5"]), (3, "0,7", ["(7,0)", "7,0"]), (4, " X = ３".replace("３", "3"), ["3"]), (5, "（1，2）", ["(1,2)"]), (6, "abc", ["1"]), (7, "-.5", ["−1/2"]), (8, "1/0", ["1"])]
    return spark.createDataFrame(rows, "id int, answer string, accepted array<string>").select("id", scoring.fill_correct(F.col("answer"), F.col("accepted")).alias("ok"))


@query("select * from (values (1, 0.5::double), (2, 5.0), (3, -0.5), (4, null), (5, null), (6, null), (7, 5.0), (8, 2.5)) t(id, v)")
def frac_parse(spark, sf_dir):
    rows = [(1, "1/2"), (2, "+5"), (3, "-.5"), (4, "5d"), (5, "1/0"), (6, "Infinity"), (7, "5."), (8, "x=5/2")]
    return spark.createDataFrame(rows, "id int, s string").select("id", scoring.parse_number(F.col("s")).alias("v"))


@query(f"select c_custkey, {GRADE.format('(abs(c_acctbal) % 1000 / 1000)')} as grade from customer")
def grade_band(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", (F.abs("c_acctbal") % 1000 / 1000).alias("acc"))
    steps = spark.createDataFrame([(float(a), b) for a, b in scoring.GRADES], "least double, grade string")
    return joins.step_lookup(c, steps, "acc", "least", ["c_custkey"]).select("c_custkey", "grade")


@query("select o_custkey, o_orderkey, o_totalprice, lag(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey) as previous from orders")
def trend_prev(spark, sf_dir):
    return windows.previous(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_custkey", "o_orderkey", "o_totalprice", "previous")


NORM = "lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({0}, ' \t\n\r'), '[ \t]{{2,}}', ' ', 'g'), '(?i)<br\\s*/?>', ' ', 'g'), '\\\\[()\\[\\]]', '', 'g'), '\\s+', ' ', 'g'))"


def _bank_items(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    return d.select(
        F.concat(F.lit("d-"), F.col("doc_id") - F.when(F.col("doc_id") % 17 == 0, F.least(F.lit(1), "doc_id")).otherwise(0)).alias("id"), F.when(F.col("lang") == "es", "zz").otherwise("num").alias("topic"), F.lit("fill").alias("type"), (F.col("n_chars") % 4).cast("int").alias("diff"), F.col("text").alias("q"),
        F.lit(None).cast("array<string>").alias("opts"), F.lit(None).cast("array<int>").alias("ans_idx"), F.array(F.lit("1")).alias("ans_txt"), none.alias("sol"), none.alias("tip"), F.col("source").alias("src"), none.alias("stem"), none.alias("fig"), none.alias("solFig"), (F.col("doc_id") % 10 == 3).alias("needsFigure"), none.alias("grp"), F.col("doc_id").alias("pos"),
    )


@query(
    f"with j as (select doc_id as pos, 'd-' || (doc_id - case when doc_id % 17 = 0 then least(1, doc_id) else 0 end) as id, text, source, lang <> 'es' and n_chars % 4 <> 0 and text is not null and {NORM.format('text')} <> '' as good, doc_id % 10 = 3 as fig, regexp_matches(text || chr(10) || source, '(?i)<\\s*(?:script|iframe|object|embed|style)\\b|\\bon\\w+\\s*=|javascript\\s*:') as risky, {NORM.format('text')} as t from documents),"
    f" k as (select *, row_number() over (partition by id, good order by pos) as nth from j), bt as (select distinct {NORM.format('text')} as t from benchmark), r as (select k.*, case when not good then 'schema' when nth > 1 then 'duplicateId' when fig then 'missingFigure' when risky then 'suspiciousHtml' when bt.t is not null then 'duplicateBuiltin' end as r0 from k left join bt on bt.t = k.t), s as (select *, case when r0 is null and row_number() over (partition by t, r0 is null order by pos) > 1 then 'duplicateLegacy' else r0 end as reason from r)"
    " select coalesce(reason, 'accepted') as reason, count(*) as n from s group by all"
)
def etl_report(spark, sf_dir):
    j = quality.judged(_bank_items(spark, sf_dir), read(spark, sf_dir, "benchmark").select(F.col("text").alias("q")))
    return j.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"select doc_id, md5({NORM.format('text')}) as t from documents where text is not null")
def etl_clean(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.md5(text.normalize_question(F.col("text")).cast("binary")).alias("t"))


@query("with s as (select page_id, lower(regexp_replace(regexp_replace(regexp_replace(url, '<[^>]+>', '', 'g'), '[0-9]+', '#', 'g'), '\\s+', '', 'g')) as sk from pages) select sk, count(*) as n, min(page_id) as first_id from s group by sk having count(*) > 1")
def template_groups(spark, sf_dir):
    s = read(spark, sf_dir, "pages").select("page_id", text.skeleton(F.col("url")).alias("sk"))
    return s.groupBy("sk").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id")).where("n > 1")


@query("select 'tag' as pattern, count(*) filter (where regexp_matches(html, '(?i)<\\s*(?:script|iframe|object|embed|style)\\b')) as n from pages union all select 'handler', count(*) filter (where regexp_matches(html, '(?i)\\bon\\w+\\s*=')) from pages union all select 'protocol', count(*) filter (where regexp_matches(html, '(?i)javascript\\s*:')) from pages")
def html_risk_by_pattern(spark, sf_dir):
    counts = read(spark, sf_dir, "pages").agg(*[F.count_if(F.col("html").rlike(p)).alias(n) for n, p in text.RISKY_PATTERNS.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("pattern"), F.col(n).alias("n")) for n in text.RISKY_PATTERNS])).alias("r")).select("r.*")


@query("select page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) as t from pages")
def strip_tags(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_tags(F.col("html")).cast("binary")).alias("t"))


@query("""with i as (select coalesce(nullif(source, ''), 'unknown') as src, sha256('s' || length(cast(doc_id as varchar)) || ':' || doc_id || case when text is null then 'n' else 's' || length(text) || ':' || text end) as h from documents),
l as (select src, h[1:4] as k, sha256(string_agg(h, '' order by h)) as d, count(*) as n from i group by all), b as (select src, k[1:2] as k, sha256(string_agg(k || d, '' order by k || d)) as d, sum(n) as n from l group by src, l.k[1:2]),
t as (select src, sha256(string_agg(k || d, '' order by k || d)) as sha256, sum(n)::bigint as n from b group by src), r as (select *, row_number() over (order by src) as nth from t)
select src, n, lpad(cast(nth as varchar), 2, '0') || '-' || substr(lower(src), 1, 28) || '-' || substr(sha256(src), 1, 8) || '.json' as file, sha256 from r""")
def pack_split_hash(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("q"), F.col("source").alias("src"))
    return stores.source_packs(d)


STROKES = "s as (select user_id, event_id as id, (epoch_us(ts) // 1000) as t0, (epoch_us(ts) // 1000) + cast(floor(value * 1000) as bigint) as t1 from events)"


def _strokes(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    t0 = _epoch_ms(F.col("ts"))
    return e.select("user_id", F.col("event_id").alias("id"), t0.alias("t0"), (t0 + F.floor(F.col("value") * 1000)).alias("t1"))


def _epoch_ms(c):
    """Milliseconds of a time without zone, as if UTC, whatever the session's zone."""
    return F.unix_millis(F.to_utc_timestamp(c.cast("timestamp"), F.current_timezone()))


@query(f"with {STROKES}, g as (select *, t0 - lag(t1) over (partition by user_id order by t0, id) as gap, lag(t1) over (partition by user_id order by t0, id) as prev_end from s), r as (select *, row_number() over (partition by user_id order by prev_end, id) as nth from g where gap >= 7200000) select user_id, id, gap, nth from r where nth <= 12")
def hesitations(spark, sf_dir):
    return windows.long_gaps(_strokes(spark, sf_dir), ["user_id"], "t0", "t1", "id", 7_200_000, 12).select("user_id", "id", "gap", "nth")


@query(f"with {STROKES}, g as (select *, t0 - lag(t1) over (partition by user_id order by t0, id) as gap, lag(t1) over (partition by user_id order by t0, id) as prev_end from s), r as (select *, row_number() over (partition by user_id order by gap desc, prev_end, id) as r from g where gap >= 7200000) select user_id, id, gap, row_number() over (partition by user_id order by prev_end, id) as nth from r where r <= 3")
def stuck_top3(spark, sf_dir):
    return windows.longest_gaps(_strokes(spark, sf_dir), ["user_id"], "t0", "t1", "id", 7_200_000, 3).select("user_id", "id", "gap", "nth")


@query(f"with {STROKES}, g as (select *, t0 - lag(t1) over (partition by user_id order by t0, id) as gap from s), c as (select *, coalesce(gap >= 3600000, false) as cut, case when gap >= 3600000 then gap end as strength from g), r as (select *, case when cut then row_number() over (partition by user_id order by strength desc nulls last, t0, id) end as r from c) select user_id, id, sum(case when r <= 9 then 1 else 0 end) over (partition by user_id order by t0, id rows unbounded preceding)::bigint as segment from r")
def segments(spark, sf_dir):
    g = windows.gaps(_strokes(spark, sf_dir), ["user_id"], "t0", "t1", "id")
    return windows.segments(g, ["user_id"], ["t0", "id"], F.col("gap") >= 3_600_000, F.col("gap"), 9).select("user_id", "id", "segment")


@query("select label, floor(min(embedding[1]) * 1e6 + 0.5) / 1e6 as x0, floor(min(embedding[2]) * 1e6 + 0.5) / 1e6 as y0, floor(max(embedding[1]) * 1e6 + 0.5) / 1e6 as x1, floor(max(embedding[2]) * 1e6 + 0.5) / 1e6 as y1 from (select label, embedding::double[] as embedding from embeddings) group by label")
def bbox(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("e")).select("label", F.get("e", F.lit(0)).alias("x"), F.get("e", F.lit(1)).alias("y"))
    b = analytics.bounding_box(e, ["label"])
    return b.select("label", *[micro(F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query('with p as (select vec_id, (embedding[1]::double + 1) / 2 as x, (embedding[2]::double + 1) / 2 as y from embeddings) select a.vec_id as box_id, b.vec_id as point_id from p a join p b on sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.01')
def grid_candidates(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    p = e.select("vec_id", ((F.get("e", F.lit(0)) + 1) / 2).alias("x"), ((F.get("e", F.lit(1)) + 1) / 2).alias("y"))
    points = p.select(F.col("vec_id").alias("point_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    return joins.grid_candidates(p.select(F.col("vec_id").alias("box_id"), "x", "y", F.lit(0.01).alias("radius")), points, "radius").select("box_id", "point_id")


def _halves(spark, sf_dir):
    e = attempts(spark, sf_dir).withColumn("mt", _epoch_ms(F.col("ts")))
    return e.where("seq % 2 = 0"), e.where("seq % 2 = 1")


@query(A + ", w as (select *, (epoch_us(ts) // 1000) as mt, seq % 2 as side from a), g as (select *, row_number() over (partition by user_id, qid, side order by mt desc, seq desc) as n from w) , o as (select *, row_number() over (partition by user_id, qid order by mt desc, side, seq desc) as k from g where n = 1) select user_id, qid, seq, mt from o where k = 1")
def merge_lww(spark, sf_dir):
    a, b = (windows.latest(h.select("user_id", "qid", "mt", "seq"), ["user_id", "qid"], ["mt", "seq"]) for h in _halves(spark, sf_dir))
    return merge.last_writer(a, b, ["user_id", "qid"], F.col("mt")).select("user_id", "qid", "seq", "mt")


@query(A + ", w as (select * from a where seq % 2 = 0 or seq % 3 = 0 union all select * from a where seq % 2 = 1 or seq % 3 = 0), r as (select user_id, seq, qid, row_number() over (partition by user_id, ts, qid, d, ms, ok order by seq) as n from w) select user_id, qid, min(seq) as seq from r where n = 1 group by user_id, qid, seq")
def merge_union(spark, sf_dir):
    e = attempts(spark, sf_dir)
    return merge.merge_attempts(e.where("seq % 2 = 0 or seq % 3 = 0"), e.where("seq % 2 = 1 or seq % 3 = 0"), "seq").select("user_id", "qid", "seq")


@query(A + ", s as (select user_id, qid as id, (epoch_us(ts) // 1000) as t1, seq, ok from a), gone as (select distinct user_id, id from s where not ok and seq % 5 = 0), l as (select *, row_number() over (partition by user_id, id order by t1 desc, seq desc) as n from s where ok or seq % 5 <> 0) select l.user_id, l.id, l.seq from l anti join gone on gone.user_id = l.user_id and gone.id = l.id where n = 1")
def merge_tombstone(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    e, t = a.unionByName(b), F.col("mt")
    rows = e.select("user_id", F.col("qid").alias("id"), t.alias("t0"), t.alias("t1"), F.lit(None).cast("long").alias("dead"), (~F.col("ok") & (F.col("seq") % 5 == 0)).alias("deleted"), "seq")
    return merge.merge_strokes(rows, ["user_id"])[0].select("user_id", "id", "seq")


@query(A + ", c as (select qid as id, max(seq) as rev from a where seq % 2 = 0 group by qid), i as (select qid + 3 as id, max(seq) as rev from a where seq % 2 = 1 group by qid) select count(*) filter (where c.id is null) as added, count(*) filter (where c.id is not null and i.rev > c.rev) as updated, count(*) filter (where c.id is not null and i.rev <= c.rev) as skipped from i left join c using (id)")
def union_by_id_stats(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    cur = a.groupBy(F.col("qid").alias("id")).agg(F.max("seq").alias("rev"))
    inc = b.groupBy((F.col("qid") + 3).alias("id")).agg(F.max("seq").alias("rev"))
    return merge.union_stats(inc, cur, ["id"])


@query(A + ", r as (select qid as id, seq as rev, case when seq % 2 = 0 then 0 else 1 end as side from a), t as (select id, side, max(rev) as rev from r group by all), o as (select *, row_number() over (partition by id order by rev desc, side) as n from t) select id, rev, side from o where n = 1")
def union_by_id(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    top = lambda d, s: d.groupBy(F.col("qid").alias("id")).agg(F.max("seq").alias("rev")).withColumn("side", F.lit(s)).withColumn("pos", F.col("id"))
    return merge.union_by_id(top(b, 1), top(a, 0), ["id"]).select("id", "rev", "side")


@query("with s as (select conv_id, turn, role, text, unnest([0, 1]) as side from conversations), h as (select * from s where (side = 0 and turn % 2 = 0) or (side = 1 and (turn % 2 = 1 or turn % 4 = 0))) select conv_id, turn, count(*) as copies, min(length(text)) as len from h group by all")
def merge_logs_keys(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    a, b = c.where("turn % 2 = 0"), c.where("turn % 2 = 1 or turn % 4 = 0")
    t = merge.tagged(a, b)
    return t.groupBy("conv_id", "turn").agg(F.count("*").alias("copies"), F.min(F.length("text")).cast("long").alias("len"))


@query("with t as (select distinct conv_id, turn, text, role from conversations) select conv_id, count(*) as n_logs, string_agg(cast(turn as varchar), ',' order by turn) as turns, bool_or(role = 'assistant') as done from t group by conv_id")
def merge_nested_logs(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    log = F.struct(F.col("turn").alias("ts"), F.lit("").alias("kind"), F.col("text").alias("note"), F.lit(0).alias("strokes"), F.lit(False).alias("resolved"), F.lit("").alias("topic"), F.lit("").alias("errorKind"))

    def side(d):
        none = lambda k: F.lit(None).cast(k)
        g = d.groupBy("conv_id").agg(F.array_sort(F.collect_list(log)).alias("logs"), F.bool_or(F.col("role") == "assistant").alias("done"))
        return g.select(F.lit("u").alias("user_id"), F.col("conv_id").alias("run_id"), F.lit(1).alias("no"), F.lit(0).alias("attempts"), "done", none("int").alias("level"), none("string").alias("topic"), none("string").alias("errorKind"), none("long").alias("completedAt"), none("long").alias("solutionUnlockedAt"), none("long").alias("detailFirstOpenedAt"), none("long").alias("detailLastOpenedAt"), F.lit(0).alias("detailViewCount"), F.lit(1).cast("long").alias("mt"), "logs")

    m = merge.merge_reviews(side(c.where("turn % 2 = 0")), side(c.where("turn % 2 = 1 or turn % 4 = 0")))
    return m.select(F.col("run_id").alias("conv_id"), F.size("logs").cast("long").alias("n_logs"), F.array_join(F.transform("logs", lambda x: x["ts"].cast("string")), ",").alias("turns"), "done")


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n <= 20")
def ring_buffer_20(spark, sf_dir):
    return windows.last_n(read(spark, sf_dir, "events"), 20, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("select event_id, e.user_id from events e where e.user_id = 3 and exists (select 1 from customer c where c.c_custkey = e.user_id and c.c_acctbal > -10000)")
def rls_view(spark, sf_dir):
    members = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > -10000).alias("enabled"))
    return quality.row_security(read(spark, sf_dir, "events"), members, 3).select("event_id", "user_id")


@query("select user_id, cast(cast(ts + interval 8 hour as date) as varchar) as usage_date, sum(greatest(cast(floor(value) as bigint) - 2, 0))::bigint as input_tokens, sum(greatest(event_id % 7 - 3, 0))::bigint as output_tokens from events group by all")
def usage_day(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "ts", (F.floor("value") - 2).alias("input_tokens"), (F.col("event_id") % 7 - 3).alias("output_tokens"))
    return analytics.usage_by_day(e).withColumn("usage_date", F.col("usage_date").cast("string"))


@query(A + ", e as (select user_id, d, seq, case when ok then 1 else -1 end as dl, qid % 20 + 1 as w from a), r as (select *, sum(dl) over x as rr, sum(dl * w) over x as rw from e window x as (partition by user_id, d order by seq rows unbounded preceding)), f as (select *, rr - least(0, min(rr) over x) as requests, rw - least(0, min(rw) over x) as weight, row_number() over (partition by user_id, d order by seq desc) as n from r window x as (partition by user_id, d order by seq rows unbounded preceding)) select user_id, cast(d as varchar) as usage_date, requests::bigint as requests, weight::bigint as weight from f where n = 1")
def refund_floor(spark, sf_dir):
    e = attempts(spark, sf_dir).select("user_id", F.col("d").alias("usage_date"), "seq", F.when(F.col("ok"), 1).otherwise(-1).alias("delta"), (F.col("qid") % 20 + 1).alias("weight"))
    return limiter.with_refunds(e).withColumn("usage_date", F.col("usage_date").cast("string"))


@query(
    A + ", e as (select user_id, d, (epoch_us(ts) // 1000) as ms, seq, greatest(1, least(qid % 25, 20)) as w, row_number() over (partition by user_id, d order by (epoch_us(ts) // 1000), seq) as k from a),"
    " f as (with recursive r as (select user_id, d, k, seq, ms, true as allowed, 1::bigint as requests, w::bigint as used, ms as last from e where k = 1 union all select e.user_id, e.d, e.k, e.seq, e.ms, e.ms - r.last >= 4000 and r.requests < 60 and r.used + e.w <= 120, r.requests + (e.ms - r.last >= 4000 and r.requests < 60 and r.used + e.w <= 120)::int, r.used + case when e.ms - r.last >= 4000 and r.requests < 60 and r.used + e.w <= 120 then e.w else 0 end, case when e.ms - r.last >= 4000 and r.requests < 60 and r.used + e.w <= 120 then e.ms else r.last end from r join e on e.user_id = r.user_id and e.d = r.d and e.k = r.k + 1) select * from r) select user_id, seq, allowed, requests, used as weight_used from f"
)
def rate_limiter(spark, sf_dir):
    a = attempts(spark, sf_dir)
    r = limiter.limited(a.select("user_id", "ts", "seq", (F.col("qid") % 25).alias("weight")))
    return r.select("user_id", "seq", "allowed", F.col("requests").cast("long").alias("requests"), F.col("weight_used").cast("long").alias("weight_used"))


@query("""with recursive p as (select page_id % 5 as list, page_id as pos, array_to_string(string_split(url, '/')[1:3], '/') as k, lower(regexp_replace(regexp_replace(regexp_replace(url, '<[^>]+>', '', 'g'), '[0-9]+', '#', 'g'), '\\s+', '', 'g')) as s, row_number() over (partition by page_id % 5 order by page_id) as i from pages),
r as (select distinct list, 0::bigint as i, []::varchar[] as ks, []::varchar[] as ss, []::bigint[] as taken from p
 union all select list, i, case when ok then list_append(ks, k) else ks end, case when ok then list_append(ss, s) else ss end, case when ok then list_append(taken, pos) else taken end
 from (select r.list, p.i, r.ks, r.ss, r.taken, p.k, p.s, p.pos, len(r.taken) < 12 and not list_contains(r.ks, p.k) and not (length(p.s) >= 12 and list_contains(r.ss, p.s)) as ok from r join p on p.list = r.list and p.i = r.i + 1)),
l as (select list, arg_max(taken, i) as taken from r group by list), f as (select l.list, taken, list(pos order by pos) filter (where not list_contains(taken, pos)) as rest from l join p using (list) group by all),
o as (select list, (taken || coalesce(rest, []))[1:12] as picked from f)
select list, unnest(range(0, len(picked)))::int as rank, unnest(picked) as pos from o""")
def greedy_dedupe(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select((F.col("page_id") % 5).alias("list"), F.col("page_id").alias("pos"), F.col("page_id").cast("string").alias("id"), F.col("url").alias("q"), F.lit(None).cast("string").alias("src"), F.substring_index("url", "/", 3).alias("grp"))
    return select.deduped(p, ["list"], 12)


@query()
def build_paper(spark, sf_dir):
    b = bank(spark, sf_dir)
    kind = F.element_at(F.array(F.lit("single"), F.lit("multi"), F.lit("fill")), (F.col("qid") % 3 + 1).cast("int"))
    b = b.select(F.col("qid").alias("id"), kind.alias("type"), F.col("diff").cast("int").alias("diff"), "topic", F.lit(None).cast("string").cast("long").alias("grp0")).withColumn("grp", F.concat(F.lit("g"), (F.col("id") / 2).cast("int"))).drop("grp0")
    users = read(spark, sf_dir, "events").select("user_id").distinct()
    return select.build_papers(b.withColumn("id", F.col("id").cast("string")), users, analytics.attempt_counts(attempts(spark, sf_dir)).withColumn("qid", F.col("qid").cast("string")))


@query(A + ", w as (select user_id, min(qid) as want from a group by user_id), c as (select w.user_id, w.want as qid, x.qid as id, x.diff = y.diff as same, x.type = y.type as st, coalesce(n.n, 0) as n from w join b y on y.qid = w.want join b x on x.topic = y.topic and x.qid <> w.want left join (select user_id, qid, count(*) as n from a group by all) n on n.user_id = w.user_id and n.qid = x.qid), f as (select *, max(st::int) over (partition by user_id, qid) as any_same from c), r as (select *, row_number() over (partition by user_id, qid order by same desc, n, id) as rank from f where st or any_same = 0) select user_id, qid, id, rank from r where rank <= 5")
def similar_questions(spark, sf_dir):
    a, b = attempts(spark, sf_dir), bank(spark, sf_dir)
    items = b.select(F.col("qid").alias("id"), "topic", "type", "diff", F.lit(None).cast("string").alias("src"))
    wanted = a.groupBy("user_id").agg(F.min("qid").alias("qid"))
    none = spark.createDataFrame([], "user_id long, qid long")
    return select.similar(items, wanted, analytics.attempt_counts(a), none).select("user_id", "qid", "id", "rank")


@query(A + ", r as (select *, row_number() over (partition by user_id order by n, qid) as rank from (select user_id, qid, count(*) as n from a group by all)) select user_id, min(n) as least_n, count(*) as picked from r where rank <= 8 group by user_id")
def least_practised(spark, sf_dir):
    c = analytics.attempt_counts(attempts(spark, sf_dir))
    p = select.least_practised(c.select("user_id", "qid"), c, 8)
    return p.groupBy("user_id").agg(F.min("n").alias("least_n"), F.count("*").alias("picked"))


@query(A + ", l as (select *, row_number() over (partition by user_id, mode order by ts desc, seq desc) as n from a) select user_id, mode, seq, ok from l where n = 1")
def latest_per_key(spark, sf_dir):
    return windows.latest(attempts(spark, sf_dir).select("user_id", "mode", "ts", "seq", "ok"), ["user_id", "mode"], ["ts", "seq"]).select("user_id", "mode", "seq", "ok")


@query(A + ", h as (select * from a where not ok or seq % 11 = 0), l as (select user_id, qid, count(*) filter (where not ok) as fails, cast(cast(max_by(d, struct_pack(ts := ts, seq := seq)) + 1 as date) as varchar) as due, max((epoch_us(ts) // 1000)) as mt from h group by all) select * from l")
def wrong_book(spark, sf_dir):
    e = attempts(spark, sf_dir)
    rows = e.withColumn("err", F.when(F.col("ok") & (F.col("seq") % 11 == 0), "用猜的")).withColumn("ts", _epoch_ms(F.col("ts")))
    return merge.wrong_book(rows).select("user_id", "qid", F.col("fails").cast("long").alias("fails"), F.col("due").cast("string").alias("due"), "mt")


@query("select event_id, user_id from events where event_type = 'click' order by ts, event_id limit 80")
def pending_oldest(spark, sf_dir):
    log = read(spark, sf_dir, "events").select(F.col("event_id").alias("client_id"), "user_id", F.col("ts").alias("updatedAt"), F.when(F.col("event_type") == "click", "pending").otherwise("uploaded").alias("upload_state"))
    return stores.pending(log, None).select(F.col("client_id").alias("event_id"), "user_id")


@query("select count(*) as total, count(*) filter (where event_type = 'click') as pending from events")
def log_stats(spark, sf_dir):
    return stores.log_stats(read(spark, sf_dir, "events").select(F.when(F.col("event_type") == "click", "pending").otherwise("uploaded").alias("upload_state")))


@query("select o_orderkey from orders order by o_orderkey limit 1000 offset 1000")
def paged_scan(spark, sf_dir):
    return stores.page(read(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 1)


@query("select r_name as unit, count(*) as n, string_agg(n_name, ',' order by n_nationkey) as methods from nation join region on r_regionkey = n_regionkey group by r_name")
def method_library(spark, sf_dir):
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    m = n.select(F.col("n_nationkey").alias("id"), F.col("r_name").alias("unit"), F.lit(1).alias("lec"), F.col("n_name").alias("concept"), F.col("n_name").alias("method"))
    return stores.method_library(m).select("unit", "n", F.array_join(F.transform("methods", lambda x: x["concept"]), ",").alias("methods"))


@query("with l as (select p_partkey as id, p_size as rev from part where p_partkey % 3 <> 0), r as (select p_partkey as id, p_size + p_partkey % 2 - (p_partkey % 5 = 0)::int as rev from part where p_partkey % 4 <> 0) select coalesce(l.id, r.id) as pack_id, case when l.id is null then 'fetch' when r.id is null then 'push' when r.rev > l.rev then 'fetch' when l.rev > r.rev then 'push' else 'none' end as action from l full join r using (id)")
def pack_diff(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    local = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("pack_id"), F.col("p_size").alias("rev"))
    remote = p.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("pack_id"), (F.col("p_size") + F.col("p_partkey") % 2 - (F.col("p_partkey") % 5 == 0).cast("int")).alias("rev"))
    return stores.pack_diff(local, remote)


@query("select 'core-' || topic || '-' || family || '-' || i as id, topic, diff from (values " + ", ".join(f"('{t}', '{f}', {d})" for t, f, d in [("num", "abs", 1), ("num", "symmetric", 2), ("line", "slope", 1), ("line", "distance", 2), ("poly", "remainder", 1), ("poly", "vertex", 2), ("seq", "arithmetic", 1), ("seq", "geometric-sum", 2), ("comb", "choose-two", 1), ("comb", "perm-three", 2), ("prob", "at-least-one", 1), ("prob", "without-replace", 2), ("data", "mean", 1), ("data", "z-score", 2), ("trig1", "right-sin", 1), ("trig1", "area", 2), ("trig2", "special", 1), ("trig2", "maximum", 1), ("exp", "log-power", 1), ("exp", "growth", 2), ("vec", "dot", 1), ("vec", "perpendicular", 2), ("svec", "dot", 1), ("svec", "norm-square", 1), ("splane", "distance", 2), ("splane", "line-plane", 2), ("mat", "det", 1), ("mat", "product", 2)]) + ") t(topic, family, diff) cross join range(1, 11) r(i)")
def generators(spark, sf_dir):
    return generated.questions(spark).select("id", "topic", "diff")


@query("select distinct user_id from events where event_type = 'error'")
def users_with_errors(spark, sf_dir):
    users = read(spark, sf_dir, "events").select("user_id").distinct()
    return joins.with_any(users, read(spark, sf_dir, "events"), "user_id", F.col("event_type") == "error")


@query("select p_partkey from part where p_partkey not in (select cast(json_extract_string(props, '$.k') as bigint) from events)")
def never_asked(spark, sf_dir):
    return joins.without(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("qid")), attempts(spark, sf_dir).select("qid"), "qid").select(F.col("qid").alias("p_partkey"))


@query(A + ", u as (select user_id, qid, mode from a where seq % 2 = 0 union select user_id, qid, mode from a where seq % 2 = 1) select mode, count(*) as n from u group by mode")
def union_distinct(spark, sf_dir):
    a, b = (h.select("user_id", "qid", "mode") for h in _halves(spark, sf_dir))
    return a.unionByName(b).distinct().groupBy("mode").agg(F.count("*").alias("n"))


@query("select c_custkey, case when abs(c_acctbal) < 3000 then 'start' when abs(c_acctbal) > 7000 then 'end' else 'middle' end as part, (60000 * pow(0, 0) + 0)::bigint as one, least(30000, 1200 * pow(2, least(5, greatest(0, c_custkey % 9 - 1))))::bigint as backoff from customer")
def backoff(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", F.when(F.abs("c_acctbal") < 3000, "start").when(F.abs("c_acctbal") > 7000, "end").otherwise("middle").alias("part"), F.lit(60000).cast("long").alias("one"), scoring.backoff_ms(F.col("c_custkey") % 9).alias("backoff"))


@query(A + " select distinct cast(d as varchar) as d, cast(d + 1 as varchar) as next, greatest(0, date '2024-01-20' - d) as left_days from a")
def local_days(spark, sf_dir):
    d = attempts(spark, sf_dir).select("d").distinct()
    return d.select(F.col("d").cast("string").alias("d"), dates.add_days(F.col("d"), 1).cast("string").alias("next"), dates.days_until(F.lit(TODAY), F.col("d").cast("string")).cast("long").alias("left_days"))


@query(A + ", e as (select run_id, no, flag from (select l_orderkey as run_id, l_linenumber as no, l_returnflag as flag, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) as n from lineitem) where n = 1) select run_id, count(*) filter (where flag <> 'A') as open, count(*) filter (where flag = 'A' and no % 3 + 1 = 1) as l1, count(*) filter (where flag = 'A' and no % 3 + 1 = 2) as l2, count(*) filter (where flag = 'A' and no % 3 + 1 = 3) as l3 from e group by run_id")
def batch_levels(spark, sf_dir):
    i = graded_items(spark, sf_dir).select("run_id", (F.col("flag") == "A").alias("done"), (F.col("no") % 3 + 1).alias("level"))
    return analytics.level_counts(i, ["run_id"])


#: Names by which the same queries were known while the plain names read a part.
for _name in ("rate_limiter", "merge_tombstone", "union_distinct", "grid_candidates"):
    QUERIES[f"{_name}_all"], ORACLE_SQL[f"{_name}_all"] = QUERIES[_name], ORACLE_SQL[_name]
