"""Queries of due lists, question choice, nearest joins and spatial candidates, with SQL over every user and item."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics, due, joins, select
from ..sources import indexed, requests
from .practice import A, DUE, TODAY, _due_log, _epoch_ms, attempts, bank, query_in, read, scratch

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = query_in(QUERIES, ORACLE_SQL)

#: Every learner with every item that is due: the plain meaning, for SQL.
ALL_DUE = A + f""", {DUE}, u as (select distinct c_custkey as user_id from customer), i as (select p_partkey as qid, row_number() over (order by p_partkey) - 1 as idx from part),
x as (select u.user_id, i.idx, i.qid from u cross join i left join l on l.user_id = u.user_id and l.qid = i.qid where l.qid is null or l.due is null or l.due <= date '{TODAY}')"""


def _due(spark, sf_dir):
    items = due.dense_index(bank(spark, sf_dir), "qid")
    users = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return items, due.due_ranges(items, _due_log(spark, sf_dir), users, "qid", F.lit(TODAY).cast("date"), ["ts", "seq"])


@query(ALL_DUE + " select user_id, min(idx) as low, max(idx) as high from (select user_id, idx, idx - row_number() over (partition by user_id order by idx) as run from x) group by user_id, run")
def due_queue(spark, sf_dir):
    """All due items of every learner, those never done too, as ranges of item numbers."""
    return _due(spark, sf_dir)[1]


@query(ALL_DUE + " select user_id, pos, qid from (select user_id, qid, row_number() over (partition by user_id order by idx) - 1 as pos from x) where pos between 11 and 21")
def due_second_page(spark, sf_dir):
    items, ranges = _due(spark, sf_dir)
    return due.due_page(ranges, items, "qid", 1, 11)


@query(ALL_DUE + ", n as (select user_id, count(*) as due from x group by user_id), d as (select user_id, count(distinct qid) as done from a where qid in (select qid from b) group by user_id) select n.user_id, due, coalesce(done, 0) as done from n left join d on d.user_id = n.user_id")
def due_and_done(spark, sf_dir):
    """Badges: due items from ranges, done ones from bitmaps of the log's two halves."""
    items, ranges = _due(spark, sf_dir)
    log = attempts(spark, sf_dir)
    bits = due.done_bitmaps(items, log.where("seq % 2 = 0"), "qid").unionByName(due.done_bitmaps(items, log.where("seq % 2 = 1"), "qid"))
    return due.due_totals(ranges).join(due.done_counts(bits), "user_id", "left").fillna({"done": 0})


def _exam_bank(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("single"), F.lit("multi"), F.lit("fill")), (F.col("qid") % 3 + 1).cast("int"))
    return bank(spark, sf_dir).select(F.col("qid").alias("id"), kind.alias("type"), F.col("diff").cast("int").alias("diff"), "topic", F.concat(F.lit("g"), F.floor(F.col("qid") / 2)).alias("grp"))


@query("select c_custkey as user_id, 17 as picks, 17 as questions, 17 as groups, 6 as single, 6 as multi, 5 as fill, 17 as by_pattern from customer")
def paper_rules(spark, sf_dir):
    """What holds for every learner's exam: quotas, no question or group twice, difficulties by the pattern."""
    users = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    p = select.build_papers(_exam_bank(spark, sf_dir), users, analytics.attempt_counts(attempts(spark, sf_dir)))
    pattern = F.array(*[F.lit(d) for _, n, diffs in select.SECTIONS for d in diffs[:n]])
    kind = lambda k: F.count_if(F.col("type") == k).alias(k)
    group = F.floor(F.col("qid") / 2)
    different = lambda c: F.size(F.collect_set(c)).cast("long")  # noqa: E731  an exam is short
    return p.groupBy("user_id").agg(F.count("*").alias("picks"), different("qid").alias("questions"), different(group).alias("groups"), kind("single"), kind("multi"), kind("fill"), F.count_if(F.col("diff") == F.element_at(pattern, F.col("exam_no"))).alias("by_pattern"))


WANTED = ", w as (select distinct user_id, qid as want from a where not ok), k as (select user_id, qid, count(*) as n from a group by all), s as (select distinct user_id, qid from a where ok and seq % 3 = 0)"


@query(A + WANTED + """, c as (select w.user_id, w.want as qid, x.qid as id, x.diff = y.diff as same, x.type = y.type as st, coalesce(k.n, 0) as n from w join b y on y.qid = w.want join b x on x.topic = y.topic and x.qid <> w.want left join k on k.user_id = w.user_id and k.qid = x.qid anti join s on s.user_id = w.user_id and s.qid = x.qid),
f as (select *, bool_or(st) over (partition by user_id, qid) as any_same from c), r as (select *, row_number() over (partition by user_id, qid order by same desc, n, id) as rank from f where st or not any_same) select user_id, qid, id, rank from r where rank <= 5""")
def similar_to_missed(spark, sf_dir):
    """For every question a learner missed, five alike that were not solved: from ranked lists, not from whole topics."""
    a = attempts(spark, sf_dir)
    items = bank(spark, sf_dir).select(F.col("qid").alias("id"), "topic", "type", "diff", F.lit(None).cast("string").alias("src"))
    solved = a.where("ok and seq % 3 = 0").select("user_id", "qid").distinct()
    return select.similar(items, a.where("not ok").select("user_id", "qid").distinct(), analytics.attempt_counts(a), solved).select("user_id", "qid", "id", "rank")


@query(A + ", e as (select user_id, seq, (epoch_us(ts) // 1000) as at from a where mode = 'purchase'), l as (select user_id, seq as log, (epoch_us(ts) // 1000) as lt from a where mode = 'view'), j as (select e.user_id, e.seq, log, lt - e.at as off, row_number() over (partition by e.user_id, e.seq order by abs(e.at - lt), log) as n from e join l on e.user_id = l.user_id) select user_id, seq, log, off from j where n = 1")
def nearest_log_any(spark, sf_dir):
    """Each purchase with the nearest view of its user, however far: pieces of a day keep busy users apart."""
    a = attempts(spark, sf_dir).withColumn("at", _epoch_ms(F.col("ts")))
    logs = a.where("mode = 'view'").select("user_id", F.col("seq").alias("log"), F.col("at").alias("lt"))
    found = joins.nearest_asof(a.where("mode = 'purchase'").select("user_id", "seq", "at"), logs, ["user_id"], "at", "lt", "log", chunk=86_400_000)
    return found.select("user_id", "seq", "log", (F.col("lt") - F.col("at")).alias("off"))


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey > 100")
def paged_all(spark, sf_dir):
    """All pages of a table together, by ranges of the key, with the filter in the requests."""
    requests.register(spark)
    pages = spark.read.format("key_pages").option("path", f"{sf_dir}/orders.parquet").option("key", "o_orderkey").load()
    return pages.where("o_orderkey > 100").select("o_orderkey", "o_custkey", "o_totalprice")


@query("select event_id, user_id, event_type from events")
def batched_upload(spark, sf_dir):
    """Every event sent in requests of 80 rows, and read again from those that count."""
    requests.register(spark)
    path = scratch(spark, "requests")
    log = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    log.write.format("request_batches").mode("append").option("path", path).save()
    most = requests.requests_sent(spark, path).agg(F.max("n")).first()[0]
    if most is not None and most > requests.SIZE:
        raise ValueError(f"a request of {most} rows")
    return requests.rows_sent(spark, path, "event_id long, user_id long, event_type string").drop("manifest")


@query("select event_id, user_id, event_type, true as skipped from events where user_id in (3, 57, 107) and event_type = 'error'")
def indexed_lookup(spark, sf_dir):
    """Errors of three users from an indexed log; whether the lookup read less than half of it."""
    path = scratch(spark, "indexed")
    log = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    indexed.write_indexed(log, path, ["user_id", "event_id"], ["event_type"], ndv=16, files=16)
    found = indexed.lookup(spark, path, user_id=[3, 57, 107], event_type=["error"])
    return found.withColumn("skipped", F.lit(indexed.rows_scanned(found) * 2 < spark.read.parquet(path).count()))
