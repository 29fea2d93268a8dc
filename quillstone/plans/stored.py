"""Queries of stores, imports, merges of corrections and the reports of an import, each through its operator, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import analytics, joins, merge, quality, windows
from ..sources import stores
from ..streaming import journal
from .practice import ITEMS, _bank_items, graded_items, query_in, read, scratch
from .practice import ORACLE_SQL as PRACTICE_SQL

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = query_in(QUERIES, ORACLE_SQL)


@query("select case when c_custkey % 7 = 0 then 'aside' else 'good' end as kind, case when c_custkey % 7 <> 0 then cast(c_custkey as varchar) end as user_id, case when c_custkey % 7 <> 0 then c_nationkey::bigint end as revision, case when c_custkey % 7 <> 0 then case when c_custkey % 2 = 0 then 'x' else '{}' end end as data, case when c_custkey % 7 = 0 then '{\"user_id\":' || c_custkey end as text from customer")
def state_loaded(spark, sf_dir):
    """States with defaults, and texts that are no JSON set aside."""
    c, path = read(spark, sf_dir, "customer"), scratch(spark, "states")
    data = F.when(F.col("c_custkey") % 2 == 0, F.lit(',"data":"x"')).otherwise(F.lit(""))
    whole = F.concat(F.lit('{"user_id":"'), F.col("c_custkey").cast("string"), F.lit('","revision":'), F.col("c_nationkey").cast("string"), data, F.lit("}"))
    c.select(F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit('{"user_id":'), F.col("c_custkey").cast("string"))).otherwise(whole)).write.text(path)
    good, bad = stores.read_state(spark, path, StructType.fromDDL("user_id string, revision long, data string"), {"data": "{}"})
    return good.withColumn("kind", F.lit("good")).unionByName(bad.withColumn("kind", F.lit("aside")), allowMissingColumns=True).select("kind", "user_id", "revision", "data", "text")


@query("select c_custkey::bigint as c_custkey, c_name, 1 as places from customer")
def state_exported(spark, sf_dir):
    """An export without secret fields, saved to two places of which one is gone."""
    path = scratch(spark, "export")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit("secret").alias("aikey"), F.lit(1).alias("aikeyTs"))
    stores.export_state(c, f"{path}/json")
    again = spark.read.json(f"{path}/json")
    done = stores.save_both(again, "nowhere://gone/place", f"{path}/second")
    return spark.read.parquet(done[0]).withColumn("places", F.lit(len(done)))


@query("""with p as (select p_partkey as pack, case p_partkey % 4 when 0 then 'qpack' when 1 then 'flash' when 2 then 'notes' else 'outline' end as kind, unnest([0, 1, 2]) as pos, p_brand, p_type from part),
i as (select *, case when (pack + pos) % 5 = 0 then null else pack || '-' || pos end as id, case when (pack + pos) % 3 = 0 then '' else p_brand end as front, case when (pack + pos) % 7 = 0 then null else p_type end as title from p)
select kind, pos, id from i where id is not null and (kind = 'qpack' or kind = 'flash' and front <> '' or kind in ('notes', 'outline') and title is not null)""")
def routed_imports(spark, sf_dir):
    """Imported documents by kind, each kind's rows by its own condition."""
    key, n = F.col("p_partkey"), [0, 1, 2]
    made = [F.struct(F.when((key + k) % 5 != 0, F.concat_ws("-", key.cast("string"), F.lit(k).cast("string"))).alias("id"), F.when((key + k) % 3 == 0, "").otherwise(F.col("p_brand")).alias("front"), F.when((key + k) % 7 != 0, F.col("p_type")).alias("title")) for k in n]
    kind = F.element_at(F.array(*[F.lit(k) for k in ("qpack", "flash", "notes", "outline")]), (key % 4 + 1).cast("int"))
    found = stores.route_import(read(spark, sf_dir, "part").select(kind.alias("kind"), F.array(*made).alias("items")))
    out = None
    for k, rows in found.items():
        rows = rows.select(F.lit(k).alias("kind"), "pos", "id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("select event_id, event_type from events where event_type like 'c%' and event_id % 2 = 0 or event_type not like 'c%'")
def replaced_scopes(spark, sf_dir):
    """A partitioned store of which one tenant's scope is replaced, found by its prefix; the others stay."""
    path = scratch(spark, "scopes")
    e = read(spark, sf_dir, "events").select("event_id", "event_type")
    stores.replace_scope(e, path, "event_type")
    kept = stores.by_prefix(spark.read.parquet(path), "event_type", "c").where("event_id % 2 = 0")
    stores.replace_scope(kept.select("event_id", "event_type"), f"{path}-new", "event_type")
    stores.replace_scope(spark.read.parquet(f"{path}-new").select("event_id", "event_type"), path, "event_type")
    return spark.read.parquet(path).select("event_id", F.col("event_type").cast("string").alias("event_type"))


@query("select event_id as client_id, case when event_id % 3 = 0 then 7 else 1 end as stamp, case when event_id % 3 = 0 then case when event_id % 2 = 0 then 'uploaded' else 'pending' end else 'old' end as upload_state from events where event_id % 3 = 0 or event_id % 4 <> 1")
def log_puts(spark, sf_dir):
    """A log with rows put in: by client id, stamped, pending unless uploaded."""
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("client_id"), (F.col("event_id") % 2 == 0).alias("uploaded"))
    log = e.where("client_id % 4 <> 1").withColumns({"updatedAt": F.lit(1), "upload_state": F.lit("old")})
    return stores.log_upsert(log, e.where("client_id % 3 = 0"), F.lit(7)).select("client_id", F.col("updatedAt").alias("stamp"), "upload_state")


@query("select 'run1-' || (user_id % 10) as qid, count(*) as total, count(*) filter (where event_type = 'click') as pending from events where event_id % 2 = 1 group by user_id % 10")
def run_counts(spark, sf_dir):
    log = read(spark, sf_dir, "events").select(F.concat(F.lit("run"), (F.col("event_id") % 2).cast("string"), F.lit("-"), (F.col("user_id") % 10).cast("string")).alias("qid"), F.when(F.col("event_type") == "click", "pending").otherwise("uploaded").alias("upload_state"))
    return stores.run_stats(log, "run1-")


@query("select n_name as name, true as valid from nation where n_nationkey % 3 <> 0 and n_regionkey <> 2")
def packs_verified(spark, sf_dir):
    """Files whose hash is the manifest's, of manifests that are well formed: one region's file names are not, every third hash is wrong."""
    n = read(spark, sf_dir, "nation").withColumn("content", F.encode("n_name", "utf-8"))
    good = F.sha2("content", 256)
    entry = F.struct(F.concat(F.lit("p-"), F.col("n_nationkey").cast("string")).alias("id"), F.when(F.col("n_regionkey") == 2, F.col("n_name")).otherwise(F.concat(F.lit("f"), F.col("n_nationkey").cast("string"), F.lit(".json"))).alias("file"), F.when(F.col("n_nationkey") % 3 == 0, F.sha2(F.lit("other"), 256)).otherwise(good).alias("sha256"))
    manifest = stores.manifest_valid(n.groupBy("n_regionkey").agg(F.collect_list(entry).alias("packs")).withColumn("schema", F.lit(1)))
    listed = manifest.where("valid").select("valid", F.inline("packs"))
    files = n.select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string"), F.lit(".json")).alias("name"), "content", "n_name")
    return stores.verified_packs(files, listed).select(F.col("n_name").alias("name"), "valid")


C_SIDE = """select run_id, no, {0} as side, {1} as mt, {2} as due, {3} as done, {4} as level, {5} as outcome, {6} as attempts, {7} as completed, {8} as log from i where {9}"""


@query(f"""with {ITEMS}, a as ({C_SIDE.format(0, 'l_quantity::int * 10', "'2024-01-' || lpad((no + 10)::varchar, 2, '0')", "flag = 'A'", 'case when no % 2 = 0 then 2 end', "'first'", 'no', 'case when no = 3 then 50 else 0 end', '1', 'true')}),
b as ({C_SIDE.format(1, '250', 'null', "flag = 'R'", '3', "case when no = 5 then null else 'second' end", '3', 'case when no = 1 then 90 else 0 end', '2', 'no % 2 = 1')}),
u as (select * from a union all select * from b)
select run_id as batch_id, no as qid, max(mt)::bigint as mt, arg_max(due, (mt, side)) filter (where due is not null) as due, bool_or(done) as done, (arg_max(level, (mt, side)) filter (where level is not null))::int as level,
arg_max(outcome, (completed, mt, side)) filter (where outcome is not null) as outcome, max(attempts)::int as attempts, nullif(max(completed), 0)::bigint as completed, string_agg(log::varchar, ',' order by log) as logs from u group by all""")
def corrections_merged(spark, sf_dir):
    """Correction entries of two devices: newer fields, larger counts, done in either, logs united, the outcome of the later completion."""
    i = graded_items(spark, sf_dir)
    none = lambda k: F.lit(None).cast(k)

    def side(d, mt, due, done, level, outcome, attempts, completed, log):
        logs = F.array(F.struct(F.lit(log).cast("long").alias("ts"), F.lit("").alias("kind"), F.lit("n").alias("note"), F.lit(0).alias("strokes"), F.lit(False).alias("resolved")))
        return d.select(F.lit("u").alias("user_id"), F.col("run_id").alias("batch_id"), F.col("no").alias("qid"), F.lit(1).alias("examNo"), none("long").alias("mockTs"), mt.cast("long").alias("mt"), due.cast("string").alias("due"), none("double").alias("points"), done.alias("done"), level.cast("int").alias("level"), outcome.cast("string").alias("outcome"), attempts.cast("int").alias("attempts"), completed.cast("long").alias("completedAt"), none("long").alias("solutionUnlockedAt"), logs.alias("logs"))

    no, flag = F.col("no"), F.col("flag")
    a = side(i, F.col("l_quantity").cast("int") * 10, F.concat(F.lit("2024-01-"), F.lpad((no + 10).cast("string"), 2, "0")), flag == "A", F.when(no % 2 == 0, 2), F.lit("first"), no, F.when(no == 3, 50).otherwise(0), 1)
    b = side(i.where("no % 2 = 1"), F.lit(250), F.lit(None), flag == "R", F.lit(3), F.when(no != 5, "second"), F.lit(3), F.when(no == 1, 90).otherwise(0), 2)
    m = merge.merge_corrections(a, b)
    return m.select("batch_id", "qid", "mt", "due", "done", "level", "outcome", F.col("attempts").cast("int").alias("attempts"), F.col("completedAt").alias("completed"), F.array_join(F.transform("logs", lambda x: x["ts"].cast("string")), ",").alias("logs"))


REASON = "coalesce(sum(n) filter (where reason = '{0}'), 0)::bigint as {0}"


@query(f"with r as ({PRACTICE_SQL['etl_report']}) select sum(n)::bigint as sourceTotal, {', '.join(REASON.format(r) for r in ['accepted', *quality.REASONS])} from r")
def import_report(spark, sf_dir):
    """The report of an import in one row."""
    j = quality.judged(_bank_items(spark, sf_dir), read(spark, sf_dir, "benchmark").select(F.col("text").alias("q")))
    return quality.report(j).drop("emojiCleaned")


@query("""with m as (select p_partkey as id, case when p_partkey % 3 = 0 then 'no x' || translate(p_partkey::varchar, '0123456789', 'abcdefghij') else 'no # of ' || split_part(p_type, ' ', 1) end as mask from part), n as (select mask, count(*) as n from m group by mask)
select id, case when n > 1 then dense_rank() over (order by case when n > 1 then mask end nulls last) end as family, n > 1 as shared from m join n using (mask)""")
def shared_templates(spark, sf_dir):
    """Questions that differ in numbers only share a group; families are numbered by their text."""
    key = F.col("p_partkey")
    q = F.when(key % 3 == 0, F.concat(F.lit("no x"), F.translate(key.cast("string"), "0123456789", "abcdefghij"))).otherwise(F.concat(F.lit("No "), key.cast("string"), F.lit("  of "), F.split("p_type", " ")[0]))
    t = quality.with_templates(read(spark, sf_dir, "part").select(key.alias("id"), q.alias("q"), F.lit(None).cast("string").alias("grp"), key.alias("pos"), F.split("p_type", " ")[0].alias("kind")))
    kinds = t.where("grp is not null").select("grp", "kind").distinct()
    family = kinds.withColumn("family", F.row_number().over(windows.Window.orderBy("kind")).cast("long"))  # a row for each kind of part
    return t.join(family.select("grp", "family"), "grp", "left").select("id", "family", F.col("grp").isNotNull().alias("shared"))


@query("select event_id from events where case when event_id % 10 = 0 then null else user_id end = 3 or event_id % 10 = 0")
def visible_events(spark, sf_dir):
    """What a signed-in user sees who owns the old rows: their own and ownerless ones."""
    e = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, F.col("user_id")).alias("user_id"))
    return quality.visible_rows(e, 3, True).select("event_id")


@query("with t as (select conv_id, turn, case when turn % 3 = 1 then '' when turn % 3 = 2 then role end as tag from conversations) select conv_id, case when conv_id % 2 = 0 then 'own' else arg_max(tag, turn) filter (where tag <> '') end as topic, arg_max(tag, turn) filter (where tag <> '') as kind from t group by conv_id")
def tags_of_reviews(spark, sf_dir):
    """A review's tag, its own or the last that one of its logs has."""
    c = read(spark, sf_dir, "conversations")
    tag = F.when(F.col("turn") % 3 == 1, "").when(F.col("turn") % 3 == 2, F.col("role"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", tag.alias("topic"), tag.alias("errorKind")))).alias("logs"))
    r = analytics.review_tags(g.withColumns({"topic": F.when(F.col("conv_id") % 2 == 0, "own").otherwise(""), "errorKind": F.lit(None).cast("string")}))
    return r.select("conv_id", "topic", F.col("errorKind").alias("kind"))


@query("select p_partkey from part where p_partkey not in (select cast(json_extract_string(props, '$.k') as bigint) from events where user_id = 3)")
def never_done_by_one(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("user_id = 3").select(F.get_json_object("props", "$.k").cast("long").alias("p_partkey"))
    return analytics.never_done(read(spark, sf_dir, "part").select("p_partkey"), e, "p_partkey")


@query("select c_custkey, coalesce(n_name, 'unknown') as source from customer left join nation on n_nationkey = c_nationkey and n_nationkey < 20")
def sources_looked_up(spark, sf_dir):
    n = read(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("source"))
    return joins.lookup(read(spark, sf_dir, "customer"), n, "c_nationkey", defaults={"source": "unknown"}).select("c_custkey", "source")


@query(f"with {ITEMS}, k as (select o_orderkey as run_id, unnest(range(1, 8)) as no from orders) select k.run_id, k.no::int as no, flag, case when l_quantity > 25 then true end as reviewed from k left join i on i.run_id = k.run_id and i.no = k.no")
def keys_with_items(spark, sf_dir):
    """Every number of a paper's key with its graded item and review."""
    i = graded_items(spark, sf_dir)
    keys = joins.numbered(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id")), F.lit(7))
    reviews = i.where("l_quantity > 25").select("run_id", "no", F.lit(True).alias("reviewed"))
    return joins.key_item_review(keys, i.select("run_id", "no", "flag"), reviews, ["run_id", "no"])


@query("select event_id, case when event_id % 10 = 0 then '3' else cast(user_id as varchar) end as user_id from events where event_id < 500")
def adopted_rows(spark, sf_dir):
    """Ownerless rows become the user's; the log as it was after 500 rows."""
    e = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, F.col("user_id").cast("string")).alias("user_id"))
    return stores.adopted(stores.snapshot_rows(e, 500, "event_id"), "3")


@query("select o_orderkey, row_number() over (partition by o_custkey order by strftime(o_orderdate, '%Y-%m-%d'), o_orderkey)::int as pos from orders")
def dated_positions(spark, sf_dir):
    """Exams in order of their day as text, then of their stamp, with the position as a column."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return windows.running_number(o, ["o_custkey"], ["d", "o_orderkey"], "pos").select("o_orderkey", "pos")


@query("select user_id, event_type, arg_max(event_id, (event_id % 2, ts, event_id)) as event_id from events group by all")
def last_upserts(spark, sf_dir):
    """Two batches through a sink that is safe to repeat, the first of them twice; the last row of each key."""
    path = scratch(spark, "upserts")
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.struct("ts", "event_id").alias("at"))
    sink = journal.upsert_sink(path, ["user_id", "event_type"], "at")
    for number in (0, 0, 1):
        sink(e.where(F.col("event_id") % 2 == number), number)
    return journal.latest_of(spark, path, ["user_id", "event_type"], "at").select("user_id", "event_type", "event_id")


@query("select event_id from events")
def sent_to_both(spark, sf_dir):
    """A batch to two places of which one is gone."""
    path = scratch(spark, "both")
    journal.both_sinks("nowhere://gone/place", path)(read(spark, sf_dir, "events").select("event_id"), 0)
    return spark.read.parquet(path).select("event_id")
