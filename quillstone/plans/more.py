"""Further registered queries: merges, exams, stores and text, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import analytics, exams, joins, merge, quality, windows
from ..sources import stores
from .practice import A, ITEMS, _epoch_ms, attempts, bank, graded_items, read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


P = "p as (select p_partkey % 40 as pack_id, p_partkey // 40 % 30 as id, p_size as rev, p_partkey as pos, p_partkey % 2 as side from part)"


def _packs(spark, sf_dir, side):
    p = read(spark, sf_dir, "part").where(F.col("p_partkey") % 2 == side)
    rows = p.select((F.col("p_partkey") % 40).alias("pack_id"), (F.floor(F.col("p_partkey") / 40) % 30).alias("id"), F.col("p_size").alias("rev"), F.col("p_partkey").alias("pos"))
    one = windows.first_per_key(rows.withColumn("_r", -F.col("rev")), ["pack_id", "id"], ["_r", "pos"]).drop("_r")
    return one.select("pack_id", F.lit(10 - side).alias("pack_rev"), F.lit("qpack").alias("kind"), F.lit(f"side{side}").alias("name"), "id", "rev", F.col("pos").cast("string").alias("value"), "pos")


@query(f"with {P}, o as (select *, row_number() over (partition by pack_id, id, side order by rev desc, pos) as n from p), r as (select *, row_number() over (partition by pack_id, id order by rev desc, side) as k from o where n = 1) select pack_id, id, rev, cast(pos as varchar) as value, case when min(side) over (partition by pack_id) = 0 then 'side0' else 'side1' end as name from r where k = 1")
def merge_packs(spark, sf_dir):
    return merge.merge_packs(_packs(spark, sf_dir, 0), _packs(spark, sf_dir, 1)).select("pack_id", "id", "rev", "value", "name")


@query(A + ", w as (select user_id, qid, seq % 2 as side, count(*) filter (where not ok) as fails, count(*) filter (where ok) as wins, max(case when seq % 3 = 0 then seq else 0 end) as mt, min(seq % 7) as itv from a group by all), r as (select *, row_number() over (partition by user_id, qid order by mt desc, itv desc, fails + wins desc, side) as n from w) select user_id, qid, fails, wins, itv, mt from r where n = 1")
def merge_wrong(spark, sf_dir):
    def side(k):
        w = attempts(spark, sf_dir).where(F.col("seq") % 2 == k).groupBy("user_id", "qid").agg(F.count_if(~F.col("ok")).alias("fails"), F.count_if("ok").alias("wins"), F.min(F.col("seq") % 7).alias("itv"), F.max(F.when(F.col("seq") % 3 == 0, F.col("seq")).otherwise(0)).alias("mt"))
        return w.withColumn("grad", F.lit(None).cast("string"))

    return merge.merge_wrong(side(0), side(1)).select("user_id", "qid", "fails", "wins", "itv", "mt")


@query("with o as (select o_custkey as user_id, o_orderkey % 50 as id, o_orderkey as mt, o_orderkey % 2 as side, o_orderpriority as tag from orders), l as (select *, row_number() over (partition by user_id, id, side order by mt desc) as n from o), k as (select * from l where n = 1) select user_id, id, max(mt) as mt, string_agg(distinct tag, ',' order by tag) as topics from k group by all")
def merge_ext_mocks(spark, sf_dir):
    def side(k):
        o = read(spark, sf_dir, "orders").where(F.col("o_orderkey") % 2 == k)
        rows = o.select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 50).cast("string").alias("id"), F.col("o_orderkey").alias("mt"), F.array("o_orderpriority").alias("topics"))
        rows = windows.latest(rows, ["user_id", "id"], ["mt"])
        none = lambda t: F.lit(None).cast(t)
        return rows.select("user_id", "id", none("string").alias("paperRunId"), none("date").alias("d"), F.col("mt").alias("ts"), "mt", none("string").alias("name"), "topics", F.array().cast("array<string>").alias("errors"))

    m = merge.merge_ext_mocks(side(0), side(1))
    return m.select("user_id", F.col("id").cast("long").alias("id"), "mt", F.array_join("topics", ",").alias("topics"))


@query(A + ", f as (select user_id, cast(d as varchar) as d, max(case when seq % 2 = 0 then mode end) as a, max(case when seq % 2 = 1 then mode end) as b from a group by all) select user_id, d, coalesce(a, b) as goal, a is not null as in_a, b is not null as in_b from f")
def merge_daily(spark, sf_dir):
    e = attempts(spark, sf_dir)
    side = lambda k, flag: e.where(F.col("seq") % 2 == k).groupBy("user_id", F.col("d").cast("string").alias("d")).agg(F.create_map(F.lit("goal"), F.max("mode"), F.lit(flag), F.lit("1")).alias("flags"))
    m = merge.merge_daily(side(0, "in_a"), side(1, "in_b"))
    key = lambda k: F.array_contains(F.map_keys("flags"), k)
    return m.select("user_id", "d", F.col("flags")["goal"].alias("goal"), key("in_a").alias("in_a"), key("in_b").alias("in_b"))


@query(A + ", s as (select user_id, qid as src, seq as ts, ok as off, seq % 2 as side from a), l as (select *, row_number() over (partition by user_id, src, side order by ts desc) as n from s), r as (select *, row_number() over (partition by user_id, src order by ts desc, side) as k from l where n = 1) select user_id, src, off, ts from r where k = 1")
def merge_pack_off(spark, sf_dir):
    side = lambda k: windows.latest(attempts(spark, sf_dir).where(F.col("seq") % 2 == k).select("user_id", F.col("qid").alias("src"), F.col("ok").alias("off"), F.col("seq").alias("ts")), ["user_id", "src"], ["ts"])
    return merge.merge_pack_off(side(0), side(1))


@query("with e as (select conv_id, turn, role, length(text) as n, turn % 3 = 0 as manual from conversations), a as (select *, 'x' || (turn % 5) as id from e), u as (select conv_id, id, min(turn) as first_at from a group by all), r as (select *, row_number() over (partition by conv_id order by first_at desc, id desc) as k from u) select conv_id, id, first_at from r where k <= 3")
def audit_ring(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.concat(F.lit("x"), F.col("turn") % 5).alias("id"), F.col("turn").alias("at"), F.lit("r").alias("reason"), F.lit(0.0).alias("score"))
    one = c.groupBy("run_id", "id", "reason", "score").agg(F.min("at").alias("at")).select("run_id", "id", "at", "reason", "score")
    return merge.merge_audits(one, one.where("false"), 3).select(F.col("run_id").alias("conv_id"), "id", F.col("at").alias("first_at"))


@query(f"with {ITEMS}, k as (select o_orderkey as run_id, unnest(range(1, 8)) as no from orders), j as (select k.run_id, k.no, flag, l_quantity from k left join i on i.run_id = k.run_id and i.no = k.no) select run_id, no, case when l_quantity > 25 then cast(l_quantity as int) % 3 + 1 when coalesce(flag, 'A') = 'A' then 1 end as level, coalesce(flag, 'A') <> 'A' and not coalesce(l_quantity > 25, false) as pending from j")
def review_start(spark, sf_dir):
    i = graded_items(spark, sf_dir)
    keys = joins.numbered(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id")), F.lit(7))
    reviews = i.where("l_quantity > 25").select("run_id", "no", F.lit(True).alias("done"), (F.col("l_quantity").cast("int") % 3 + 1).alias("level"))
    return exams.review_start(keys, i.where("flag <> 'A'"), reviews)


@query(f"with {ITEMS}, q as (select l_orderkey as run_id, unnest([0, 1, 3, 21]) as no from (select distinct l_orderkey from lineitem) union all select -1, 1) select q.run_id, q.no, coalesce(cast(o_orderdate as date) <= date '1997-06-01', false) and q.no between 1 and 20 and exists (select 1 from i where i.run_id = q.run_id and i.no = q.no) as allowed from q left join orders on o_orderkey = q.run_id")
def detail_gate(spark, sf_dir):
    i = graded_items(spark, sf_dir)
    runs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("due"))
    asked = i.select("run_id").distinct().select("run_id", F.explode(F.array(*[F.lit(k) for k in (0, 1, 3, 21)])).alias("no"))
    asked = asked.unionByName(spark.createDataFrame([(-1, 1)], "run_id long, no int"))
    return exams_gate(runs, i, asked)


def exams_gate(runs, items, asked):
    return quality.detail_allowed(runs, items.select("run_id", "no"), asked, F.lit("1997-06-01").cast("date"))


@query(f"with {ITEMS}, s as (select run_id, no, flag, case when flag = 'A' then 5.0 else 0.0 end as points from i) select run_id, no, case when no % 4 = 0 then 'correct' when flag = 'A' then 'correct' else 'incorrect' end as status, (case when no % 4 = 0 then 4.0 else points end)::double as points, no % 4 = 0 as manual from s")
def grade_override(spark, sf_dir):
    i = graded_items(spark, sf_dir)
    none = F.lit(None)
    items = i.select("run_id", "no", F.when(F.col("flag") == "A", "correct").otherwise("incorrect").alias("status"), F.when(F.col("flag") == "A", 5.0).otherwise(0.0).alias("points"), none.cast("boolean").alias("manual"), none.cast("long").alias("mt"))
    edits = i.where("no % 4 = 0").select("run_id", "no", F.lit("correct").alias("status"), F.lit(9.0).alias("points"))
    key = spark.range(1, 8).select(F.col("id").cast("int").alias("no"), F.lit(4.0).alias("points"))
    return exams.overridden(items, edits, key, F.lit(1)).select("run_id", "no", "status", "points", F.coalesce("manual", F.lit(False)).alias("manual"))


@query("with v as (select user_id, event_id // 20 as paper, event_type, value from events) select user_id, paper, count(*) as n, count(*) filter (where value > 2) as seen, count(*) filter (where event_type = 'click') as first, count(*) filter (where event_type = 'view') as second, count(*) = 20 and bool_and(value > 2) as complete from v group by all")
def vision_papers(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.floor(F.col("event_id") / 20).alias("paperId"), F.lit(0).alias("paperTs"), (F.col("value") > 2).alias("paperSeen"), F.when(F.col("event_type") == "click", "first").when(F.col("event_type") == "view", "second").otherwise("other").alias("outcome"))
    return analytics.vision_summary(e).select("user_id", F.col("paperId").alias("paper"), "n", "seen", "first", "second", "complete")


@query("with s as (select user_id as qid, epoch_us(ts) // 1000 as t0, epoch_us(ts) // 1000 + cast(floor(value * 1000) as bigint) as t1, event_id as id from events where epoch_us(ts) // 1000 >= 1704067200000), g as (select *, lag(t1) over (partition by qid order by t0, t1, id) as p from s) select qid, floor((min(t0) - 1704067200000) / 1000.0 + 0.5)::int as fi, least(12, count(*) filter (where t0 - p >= 15000))::int as pauses, floor((1706745600000 - max_by(t1, struct_pack(a := t0, b := t1, c := id))) / 1000.0 + 0.5)::int as tail, count(*)::int as n from g group by qid")
def process_metrics(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    t = _epoch_ms(F.col("ts"))
    s = e.select(F.col("user_id").alias("qid"), F.col("event_id").alias("id"), t.alias("t0"), (t + F.floor(F.col("value") * 1000)).alias("t1"), F.lit(1704067200000).alias("since"))
    none = spark.createDataFrame([], "qid long")
    m = analytics.process_metrics(s, none, ["qid"], "since", F.lit(1706745600000))
    return m.select("qid", "fi", F.size("hes").alias("pauses"), "tail", "n")


@query(A + ", o as (select o_custkey as user_id, epoch_us(o_orderdate::timestamp) // 1000 as at from orders), e as (select user_id, seq, (epoch_us(ts) // 1000) as at from a where mode = 'purchase'), l as (select user_id, seq as log, (epoch_us(ts) // 1000) as lt from a where mode = 'view'), j as (select e.user_id, e.seq, log, row_number() over (partition by e.user_id, e.at order by abs(e.at - lt), log) as n from e join l on e.user_id = l.user_id and abs(e.at - lt) <= 3600000) select user_id, seq, log from j where n = 1")
def nearest_log(spark, sf_dir):
    a = attempts(spark, sf_dir).withColumn("at", _epoch_ms(F.col("ts")))
    events = a.where("mode = 'purchase'").select("user_id", "seq", "at")
    logs = a.where("mode = 'view'").select("user_id", F.col("seq").alias("log"), F.col("at").alias("lt"))
    return joins.nearest_within(events, logs, ["user_id"], "at", "lt", 3_600_000, "log").select("user_id", "seq", "log")


@query(f"with {ITEMS}, b as (select run_id, no, case when l_quantity > 25 then 'correct' else 'incorrect' end as st from i where no % 2 = 1), c as (select i.run_id, i.no, flag, b.st from i left join b using (run_id, no)) select run_id, no, case when st is not null then st <> case when flag = 'A' then 'correct' else 'incorrect' end end as changed from c")
def audit_changed(spark, sf_dir):
    i = graded_items(spark, sf_dir)
    items = i.select("run_id", "no", F.when(F.col("flag") == "A", "correct").otherwise("incorrect").alias("status"), F.lit(0.0).alias("points"), F.lit(None).cast("long").alias("adjustedAt"))
    audits = i.where("no % 2 = 1").select("run_id", "no", F.lit("人工覆核前").alias("reason"), F.lit(1).alias("at"), F.when(F.col("l_quantity") > 25, "correct").otherwise("incorrect").alias("status"), F.lit(0.0).alias("points"))
    return joins.audit_changed(items, audits)


@query("with s as (select o_custkey as id, o_orderkey as ts, o_orderstatus as status, lag(o_orderstatus) over (partition by o_custkey order by o_orderkey) as before from orders) select id, ts, before, status from s where before is not null and before <> status and before || '>' || status not in ('O>F', 'O>P', 'P>F')")
def bad_transitions(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ts"), F.lit(0).alias("seq"), F.col("o_orderstatus").alias("status"))
    return exams.transitions(o, [("O", "F"), ("O", "P"), ("P", "F")]).select("id", "ts", "before", "status")


@query("with t as (select c_custkey as id, c_name as v from customer where c_custkey % 3 <> 0), r as (select c_custkey as id, 'new' as v from customer where c_custkey % 2 = 0) select coalesce(r.id, t.id) as id, coalesce(r.v, t.v) as updated, coalesce(t.v, r.v) as inserted from t full join r using (id)")
def upserts(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    t = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("v"))
    r = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit("new").alias("v"))
    return stores.upsert(t, r, ["id"]).withColumnRenamed("v", "updated").join(stores.insert_missing(t, r, ["id"]).withColumnRenamed("v", "inserted"), "id")


@query("select c_custkey, regexp_replace(lower(regexp_replace(translate(c_mktsegment || ' = （' || c_custkey || '，1．5）', '（），．−–—', '(),.---'), '\\s+', '', 'g')), '^[a-z]=', '') as n, replace(replace(replace(replace(c_name || '<a b=\"1\">&', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as h from customer")
def text_forms(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", text.norm(F.concat("c_mktsegment", F.lit(" = （"), "c_custkey", F.lit("，1．5）"))).alias("n"), text.escape_html(F.concat("c_name", F.lit('<a b="1">&'))).alias("h"))


@query("with e as (select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey where n_nationkey % 2 = 0) select n.n_nationkey, n.n_name, coalesce(e.r_name, 'default') as title from nation n left join e using (n_nationkey)")
def overlay_defaults(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    extra = n.where("n_nationkey % 2 = 0").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("title"))
    extra = extra.unionByName(spark.createDataFrame([(999, "unknown")], "n_nationkey int, title string"))
    return joins.overlay(n.select("n_nationkey", "n_name", F.lit("default").alias("title")), extra, "n_nationkey", "n_name").select("n_nationkey", "n_name", "title")


@query(A + ", j as (select a.*, diff, case diff when 1 then 75 when 2 then 150 when 3 then 240 end as target from a left join b using (qid)) select user_id, count(*) as n, count(*) filter (where ok) as ok_n, count(*) filter (where ok and ms > 1.5 * target * 1000) as slow_ok, count(*) filter (where ok and diff = 3) as hard_wins from j group by user_id")
def round_summary(spark, sf_dir):
    return analytics.round_summary(attempts(spark, sf_dir), bank(spark, sf_dir))


@query("select conv_id as session, turn % 4 as qid, sum(length(text))::bigint as ms, count(*) as visits, bool_or(length(text) >= 400) as idle from conversations group by all")
def time_spent(spark, sf_dir):
    v = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), (F.col("turn") % 4).alias("qid"), F.length("text").cast("long").alias("ms"))
    return exams.time_spent(v, 400)
