"""Reconciling replicas of one state: unions by key, last writer wins, tombstones, nested logs.

A merge takes two tables of the same columns; `a` and `b` are its sides. Rows are
tagged with side and position, united and reduced by key, so there is one shuffle
however many replicas' rows meet. MERGE INTO isn't needed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import last_n

z = lambda c: F.coalesce(c, F.lit(0))


def tagged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both sides' rows; _side is 0 for a."""
    return a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)), allowMissingColumns=True)


def pick(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_side")


def union_by_id(incoming: DataFrame, current: DataFrame, key: list[str], rev: str = "rev", pos: str = "pos") -> DataFrame:
    """current, its rows replaced by incoming ones of a strictly larger rev, and new ids. Rows without an id go."""
    good = incoming.where(F.col(key[-1]).isNotNull())
    return pick(tagged(current, good), key, [F.desc(z(F.col(rev))), F.col("_side"), F.col(pos)])


def union_stats(incoming: DataFrame, current: DataFrame, key: list[str], rev: str = "rev") -> DataFrame:
    """One row: added, updated, skipped (ids unique on each side)."""
    c = current.select(*key, z(F.col(rev)).alias("_have"), F.lit(True).alias("_in"))
    j = incoming.where(F.col(key[-1]).isNotNull()).join(c, key, "left")
    has = F.coalesce("_in", F.lit(False))
    newer = z(F.col(rev)) > F.col("_have")
    return j.agg(F.count_if(~has).alias("added"), F.count_if(has & newer).alias("updated"), F.count_if(has & ~newer).alias("skipped"))


def merge_packs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Items of packs on both sides: the newer rev gives the pack's metadata (tie: a), items are united by their own rev."""
    rows = tagged(a, b)
    meta = pick(rows.select("pack_id", "pack_rev", "kind", "name", "_side").distinct(), ["pack_id"], [F.desc(z(F.col("pack_rev"))), F.col("_side")])
    newer = rows.join(meta.select("pack_id", F.col("pack_rev").alias("_rev")), "pack_id")
    # of equal item revs the newer pack's stays
    w = Window.partitionBy("pack_id", "id").orderBy(F.desc(z(F.col("rev"))), F.desc(z(F.col("pack_rev"))), "_side", "pos")
    items = newer.where("id is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("pack_id", "id", "rev", "value", "pos")
    return items.join(meta, "pack_id").select("pack_id", "pack_rev", "kind", "name", "id", "rev", "value", "pos")


def upsert_pack(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """Items of one or more packs united; a pack's rev rises by one only if something was added or updated."""
    cur = current.select("pack_id", "id", z(F.col("rev")).alias("_have"))
    changed = incoming.join(cur, ["pack_id", "id"], "left").where(F.col("_have").isNull() | (z(F.col("rev")) > F.col("_have"))).select("pack_id").distinct().withColumn("_changed", F.lit(1))
    revs = current.groupBy("pack_id").agg(F.max("pack_rev").alias("_rev"))
    out = union_by_id(incoming, current, ["pack_id", "id"]).join(changed, "pack_id", "left").join(revs, "pack_id", "left")
    return out.withColumn("pack_rev", z(F.col("_rev")) + z(F.col("_changed"))).drop("_changed", "_rev")


def union_records(a: DataFrame, b: DataFrame, key: list[str], pos: str = "pos") -> DataFrame:
    """Union distinct by a composite key, a before b, first wins; null parts of a key are equal."""
    return pick(tagged(a, b), key, [F.col("_side"), F.col(pos)])


def merge_attempts(a: DataFrame, b: DataFrame, pos: str = "pos") -> DataFrame:
    return union_records(a, b, ["user_id", "ts", "qid", "d", "ms", "ok"], pos)


def union_whole_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, and those rows of b that equal none of a by their JSON; neither side is deduplicated in itself."""
    text = lambda d: d.withColumn("_json", F.to_json(F.struct(*sorted(a.columns)), {"ignoreNullFields": "false"}))
    return a.unionByName(text(b).join(text(a).select("_json").distinct(), "_json", "left_anti").drop("_json"))


def merge_wrong(a: DataFrame, b: DataFrame) -> DataFrame:
    """Larger mt; at equal mt larger interval (graduated: 99); then b only with strictly more tries."""
    interval = F.when(F.col("grad").isNotNull(), 99).otherwise(z(F.col("itv")))
    tries = z(F.col("fails")) + z(F.col("wins"))
    return pick(tagged(a, b), ["user_id", "qid"], [F.desc(z(F.col("mt"))), F.desc(interval), F.desc(tries), F.col("_side")])


def last_writer(a: DataFrame, b: DataFrame, key: list[str], stamp: Column, tie_a: bool = True) -> DataFrame:
    """The row with the larger stamp; ties to a or b."""
    return pick(tagged(a, b), key, [F.desc(stamp), F.col("_side") if tie_a else F.desc("_side")])


def merge_vision_queue(a: DataFrame, b: DataFrame) -> DataFrame:
    return last_writer(a, b, ["user_id", "id"], z(F.coalesce(F.nullif("mt", F.lit(0)), "ts")))


def merge_ext_mocks(a: DataFrame, b: DataFrame) -> DataFrame:
    """By run, id, or day, name and time: the newer row's fields over the older's, topics and errors united."""
    key = F.coalesce(F.nullif("paperRunId", F.lit("")), F.nullif("id", F.lit("")), F.concat_ws("|", F.coalesce(F.col("d").cast("string"), F.lit("")), F.coalesce("name", F.lit("")), F.coalesce(F.col("ts").cast("string"), F.lit(""))))
    stamp = F.coalesce(F.nullif("mt", F.lit(0)), "ts", F.lit(0))
    rows = tagged(a, b).withColumn("_key", key).withColumn("_stamp", stamp)
    w = Window.partitionBy("user_id", "_key").orderBy(F.desc("_stamp"), "_side").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = {c: F.first(c, ignorenulls=True).over(w) for c in a.columns if c not in ("user_id", "topics", "errors")}
    both = {c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))).over(w)))) for c in ("topics", "errors")}
    out = rows.withColumns(whole | both).withColumn("_n", F.row_number().over(Window.partitionBy("user_id", "_key").orderBy(F.desc("_stamp"), "_side")))
    return out.where("_n = 1").select(*a.columns)


def merge_daily(a: DataFrame, b: DataFrame) -> DataFrame:
    """Flags (map) of each day: both sides', a's over b's."""
    j = a.select("user_id", "d", F.col("flags").alias("_a")).join(b.select("user_id", "d", F.col("flags").alias("_b")), ["user_id", "d"], "full_outer")
    none = F.create_map().cast("map<string,string>")
    mine, other = F.coalesce("_a", none), F.coalesce("_b", none)
    kept = F.map_filter(other, lambda k, v: ~F.array_contains(F.map_keys(mine), k))
    return j.select("user_id", "d", F.map_concat(kept, mine).alias("flags"))


def merge_logs(arrays: Column, key) -> Column:
    """Logs of an array of arrays, one for each key (the last wins), by time."""
    flat = F.transform(F.flatten(arrays), lambda x, i: F.struct(x.alias("x"), i.alias("i"), key(x).alias("k")))
    last = F.filter(flat, lambda x: ~F.exists(flat, lambda y: (y["k"] == x["k"]) & (y["i"] > x["i"])))
    return F.transform(F.array_sort(F.transform(last, lambda x: F.struct(z(x["x"]["ts"]).alias("ts"), x["i"].alias("i"), x["x"].alias("x")))), lambda x: x["x"])


def log_key(x: Column) -> Column:
    return F.concat_ws("|", F.coalesce(x["ts"].cast("string"), F.lit("")), F.coalesce(x["note"], F.lit("")), z(x["strokes"]).cast("string"), F.coalesce(x["resolved"], F.lit(False)).cast("string"))


def merge_corrections(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entries by batch, question and number: fields of the newer batch, attempts and times the larger, done either, logs united, the outcome of the later completion."""
    rows = tagged(a, b).withColumn("_stamp", F.coalesce(F.nullif("mt", F.lit(0)), "mockTs", F.lit(0)))
    key = ["user_id", "batch_id", "qid", "examNo"]
    # equal stamps: b's batch counts as the newer; the newer comes last
    order = F.struct("_stamp", "_side")
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    entries = rows.groupBy(*key).agg(
        newest("mockTs"), F.max(z(F.col("mt"))).alias("mt"), newest("due"), newest("points"), F.bool_or(F.coalesce("done", F.lit(False))).alias("done"), newest("level"),
        F.max_by("outcome", F.when(F.col("outcome").isNotNull(), F.struct(z(F.col("completedAt")), "_stamp", "_side"))).alias("outcome"), F.max(z(F.col("attempts"))).alias("attempts"),
        F.nullif(F.max(z(F.col("completedAt"))), F.lit(0)).alias("completedAt"), F.nullif(F.max(z(F.col("solutionUnlockedAt"))), F.lit(0)).alias("solutionUnlockedAt"),
        F.array_sort(F.collect_list(F.struct("_stamp", "_side", F.coalesce("logs", F.array().cast(dict(a.dtypes)["logs"])).alias("l")))).alias("_l"),
    )
    return entries.withColumn("logs", merge_logs(F.transform("_l", lambda x: x["l"]), log_key)).select(*a.columns)


def retry_count(logs: Column, *completions: Column) -> Column:
    """Retries among logs: named ones, and unnamed ones but for the nearest to each completion (within 2 s, each log once)."""
    unnamed = F.filter(F.transform(logs, lambda x, i: F.struct(i.alias("i"), x["ts"].alias("ts"), F.coalesce(x["kind"], F.lit("")).alias("k"))), lambda x: x["k"] == "")
    done = F.filter(F.array(*completions), lambda c: z(c) > 0)

    def step(used, at):
        near = F.filter(unnamed, lambda x: ~F.array_contains(used, x["i"]) & (F.abs(z(x["ts"]) - at) <= 2000))
        best = F.get(F.array_sort(F.transform(near, lambda x: F.struct(F.abs(z(x["ts"]) - at).alias("d"), x["i"].alias("i")))), F.lit(0))["i"]
        return F.when(best.isNull(), used).otherwise(F.array_append(used, best))

    used = F.aggregate(done, F.array().cast("array<int>"), step)
    named = F.size(F.filter(logs, lambda x: ~F.coalesce(x["kind"], F.lit("")).isin("", "complete", "detail-gate") | (x["kind"] == "retry")))
    return named + F.size(unnamed) - F.size(used)


def merge_reviews(a: DataFrame, b: DataFrame) -> DataFrame:
    """Review states by run and number: the newer's fields over the older's (ties: b), logs united, done either, times and counts the larger, first opening the smaller, attempts at least the retries logged."""
    rows = tagged(a, b).withColumn("_stamp", F.coalesce(F.nullif("mt", F.lit(0)), "completedAt", F.lit(0)))
    order = F.struct("_stamp", "_side")
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    most = lambda c: F.nullif(F.max(z(F.col(c))), F.lit(0)).alias(c)
    g = rows.groupBy("user_id", "run_id", "no").agg(
        F.max(z(F.col("attempts"))).alias("_attempts"), F.bool_or(F.coalesce("done", F.lit(False))).alias("done"), newest("level"), newest("topic"), newest("errorKind"), most("completedAt"), most("solutionUnlockedAt"),
        F.min(F.nullif("detailFirstOpenedAt", F.lit(0))).alias("detailFirstOpenedAt"), most("detailLastOpenedAt"), F.max(z(F.col("detailViewCount"))).alias("detailViewCount"), F.max(z(F.col("mt"))).alias("mt"),
        F.max(F.when(F.col("_side") == 0, F.col("completedAt"))).alias("_ca"), F.max(F.when(F.col("_side") == 1, F.col("completedAt"))).alias("_cb"),
        F.array_sort(F.collect_list(F.struct("_stamp", "_side", F.coalesce("logs", F.array().cast(dict(a.dtypes)["logs"])).alias("l")))).alias("_l"),
    )
    key = lambda x: F.concat_ws("|", F.coalesce(x["ts"].cast("string"), F.lit("")), F.coalesce(x["note"], F.lit("")), F.coalesce(x["resolved"], F.lit(False)).cast("string"))
    g = g.withColumn("logs", merge_logs(F.transform("_l", lambda x: x["l"]), key))
    return g.withColumn("attempts", F.greatest("_attempts", retry_count(F.col("logs"), F.col("_ca"), F.col("_cb")))).select(*a.columns)


def item_stamp(items: DataFrame, changed: DataFrame) -> DataFrame:
    """items and _stamp: their own time, else the grade's; a manual item that an audit shows unchanged keeps the first grading's."""
    j = items.join(changed, ["run_id", "no"], "left")
    own = F.coalesce(F.nullif("mt", F.lit(0)), F.nullif("manualAt", F.lit(0)))
    graded, adjusted = z(F.col("gradedAt")), F.coalesce(F.nullif("adjustedAt", F.lit(0)), z(F.col("gradedAt")))
    legacy = F.when(~F.coalesce("manual", F.lit(False)), graded).when(F.coalesce(F.col("changed"), F.lit(True)), adjusted).otherwise(graded)
    return j.withColumn("_stamp", F.coalesce(own, legacy)).drop("changed")


def merge_grades(a: DataFrame, b: DataFrame, changed_a: DataFrame, changed_b: DataFrame) -> DataFrame:
    """Items by run and number, the later stamp (ties: the later graded side, then b)."""
    rows = tagged(item_stamp(a, changed_a), item_stamp(b, changed_b)).withColumn("_grade", F.coalesce(F.nullif("adjustedAt", F.lit(0)), "gradedAt", F.lit(0)))
    return pick(rows, ["user_id", "run_id", "no"], [F.desc("_stamp"), F.desc("_grade"), F.desc("_side")]).drop("_stamp", "_grade")


def merge_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Runs by id: the newer's fields (ties: a) over the older's, mt the larger, tags united."""
    rows = tagged(a, b).withColumn("_stamp", F.coalesce(F.nullif("mt", F.lit(0)), F.nullif("submittedAt", F.lit(0)), "createdAt", F.lit(0)))
    order = F.struct("_stamp", -F.col("_side"))
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    tags = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>")))))).alias(c)
    plain = [c for c in a.columns if c not in ("user_id", "id", "mt", "topics", "errors")]
    return rows.groupBy("user_id", "id").agg(*[newest(c) for c in plain], F.max(z(F.col("mt"))).alias("mt"), tags("topics"), tags("errors")).select(*a.columns)


def merge_audits(a: DataFrame, b: DataFrame, keep: int = 20) -> DataFrame:
    """Audits by id (else time, reason, score), the last 20 of each run."""
    key = F.coalesce(F.nullif("id", F.lit("")), F.concat_ws("|", F.col("at").cast("string"), "reason", F.col("score").cast("string")))
    rows = tagged(a, b).withColumn("_key", key)
    return last_n(pick(rows, ["run_id", "_key"], [F.col("_side")]), keep, ["run_id"], ["at", "_key"]).drop("_key")


def merge_pack_off(a: DataFrame, b: DataFrame) -> DataFrame:
    return last_writer(a, b, ["user_id", "src"], z(F.col("ts")))


def merge_phone_days(a: DataFrame, b: DataFrame) -> DataFrame:
    return last_writer(a, b, ["user_id", "d"], z(F.col("n")))


def merge_cards(a: DataFrame, b: DataFrame) -> DataFrame:
    return last_writer(a, b, ["user_id", "card"], z(F.col("s")))


def merge_facts(a: DataFrame, b: DataFrame) -> DataFrame:
    return last_writer(a, b, ["user_id", "fact"], z(F.col("last")), tie_a=False)


def merge_history(a: DataFrame, b: DataFrame, keep: int = 200, order: list[str] | None = None) -> DataFrame:
    return last_n(union_whole_rows(a, b), keep, ["user_id"], order or ["ts"])


def merge_strokes(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows: by, id, t0, t1, dead, deleted (a tombstone row), seq. Live strokes, the last written of each id, and deleted ids. A tombstone always wins."""
    gone = rows.where(F.col("deleted") | F.coalesce(F.col("dead") > 0, F.lit(False))).select(*by, "id").distinct()
    live = rows.where(~F.col("deleted"))
    w = Window.partitionBy(*by, "id").orderBy(F.desc(z(F.coalesce(F.nullif("t1", F.lit(0)), "t0"))), F.desc("seq"))
    live = live.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return live.join(gone, [*by, "id"], "left_anti"), gone


def load_strokes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ink records of both stores (client_id, qid, updatedAt, strokes, deleted): the last row of each client id, then merge_strokes by page."""
    from .windows import latest

    last = latest(records, ["client_id"], ["updatedAt"])
    s = last.select("qid", "updatedAt", F.explode("strokes").alias("s")).select("qid", F.col("s.id").alias("id"), "s.t0", "s.t1", "s.dead", F.lit(False).alias("deleted"), F.col("updatedAt").alias("seq"))
    t = last.select("qid", F.explode("deleted").alias("id"), F.lit(None).cast("long").alias("t0"), F.lit(None).cast("long").alias("t1"), F.lit(None).cast("long").alias("dead"), F.lit(True).alias("deleted"), F.col("updatedAt").alias("seq"))
    return merge_strokes(s.unionByName(t), ["qid"])


def compacted(records: DataFrame) -> DataFrame:
    """A page's snapshot: strokes alive with more than a point, dead ones among the deleted."""
    dead = F.transform(F.filter("strokes", lambda s: z(s["dead"]) > 0), lambda s: s["id"])
    live = F.filter("strokes", lambda s: (z(s["dead"]) == 0) & (F.size(s["pts"]) > 1))
    return records.withColumn("deleted", F.array_sort(F.array_union(F.coalesce("deleted", F.array().cast("array<string>")), dead))).withColumn("strokes", live)


def wrong_book(attempts: DataFrame, seq: str = "seq") -> DataFrame:
    """The wrong book that attempts leave: a failed, timed-out or guessed one enters with interval 1, due the next day."""
    hit = attempts.where(~F.col("ok") | F.coalesce(F.col("err").isin("超時", "用猜的"), F.lit(False)))
    last = F.struct("ts", seq)
    return hit.groupBy("user_id", "qid").agg(F.count_if(~F.col("ok")).cast("int").alias("fails"), F.lit(0).alias("wins"), F.lit(1).alias("itv"), F.coalesce(F.max_by("err", F.when(F.col("err").isNotNull(), last)), F.lit("概念不熟")).alias("err"), F.date_add(F.max_by("d", last), 1).alias("due"), F.max("ts").alias("mt"))


def upsert_ext_mock(current: DataFrame, incoming: DataFrame, discarded: DataFrame) -> DataFrame:
    """External exams keyed by run: incoming replaces, discarded runs go."""
    kept = current.join(incoming, ["user_id", "paperRunId"], "left_anti").unionByName(incoming)
    return kept.join(discarded.select("user_id", "paperRunId"), ["user_id", "paperRunId"], "left_anti")


def migrate_packs(rows: DataFrame) -> DataFrame:
    """Old flat items (src, kind, id, rev, value, pos) as packs of their source."""
    pack = F.concat_ws(":", F.lit("legacy"), "kind", F.coalesce(F.nullif("src", F.lit("")), F.lit("unknown")))
    rev = F.max(z(F.col("rev"))).over(Window.partitionBy(pack))
    return rows.select(pack.alias("pack_id"), rev.alias("pack_rev"), "kind", F.coalesce(F.nullif("src", F.lit("")), F.lit("unknown")).alias("name"), "id", "rev", "value", "pos")


def commit_state(spark, path: str, user: str, change, tries: int = 5) -> int:
    """Optimistic commit of a user's state in a folder of versions: reads the last revision, applies change(text), writes a file of its own and renames it to the next one's name, which must not exist; on a clash reads and merges again. A writer lost in between leaves no revision."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{user}")
    fs = folder.getFileSystem(conf)
    fs.mkdirs(folder)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    for _ in range(tries):
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        revision = max([int(n) for n in names if n.isdigit()], default=0)
        old = spark.read.text(f"{path}/{user}/{revision}", wholetext=True).first()[0] if revision else None
        new = change(old)
        own = jvm.org.apache.hadoop.fs.Path(folder, f"_writing-{uuid.uuid4().hex}")
        out = fs.create(own, False)
        out.write(bytearray(new.encode()))
        out.close()
        try:
            files.rename(fs.makeQualified(own), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(folder, str(revision + 1))), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception:  # another writer has taken this revision
            fs.delete(own, False)
            continue
        return revision + 1
    raise RuntimeError("the state changed at every try")


#: How each table of a state is merged; other tables take a's rows, then b's of new keys.
RULES = {
    "attempts": merge_attempts, "wrong": merge_wrong, "corrections": merge_corrections, "ext_mocks": merge_ext_mocks, "daily": merge_daily, "vision_queue": merge_vision_queue, "reviews": merge_reviews, "paper_runs": merge_runs,
    "pack_off": merge_pack_off, "phone_days": merge_phone_days, "cards": merge_cards, "facts": merge_facts, "mocks": union_whole_rows, "drills": union_whole_rows, "packs": merge_packs,
}
#: Tables united by a composite key.
RECORDS = {"side_practice": ["user_id", "ts", "qid"], "outline_attempts": ["user_id", "id", "ts", "unitId"], "concept_attempts": ["user_id", "id", "ts", "conceptId"], "vision_history": ["user_id", "id", "ts", "qid"]}


def merge_state(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Two replicas' tables as one state, each table by its rule; a table of one side only is taken as it is."""
    out = {}
    for name in sorted({*a, *b}):
        if name not in a or name not in b:
            out[name] = a.get(name, b.get(name))
        elif name in RULES:
            out[name] = RULES[name](a[name], b[name])
        elif name in RECORDS:
            out[name] = union_records(a[name], b[name], RECORDS[name], "ts")
        else:
            out[name] = pick(tagged(a[name], b[name]), ["user_id"], [F.col("_side")])
    return out
