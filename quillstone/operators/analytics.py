"""Roll-ups of practice records: days, topics, exams, levels, mastery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, scoring
from .windows import all_of_last, last_n, last_value

DRILL_SIZE, DRILL_POINTS = 12, 3


def mastery(attempts: DataFrame, bank: DataFrame) -> DataFrame:
    """user_id, topic, n, ok, acc, low, high, grade of attempts whose question is known."""
    g = attempts.join(bank.select("qid", "topic"), "qid").groupBy("user_id", "topic").agg(F.count("*").alias("n"), F.count_if("ok").alias("ok"))
    low, high = scoring.wilson(F.col("ok"), F.col("n"))
    acc = F.col("ok") / F.col("n")
    return g.select("user_id", "topic", "n", "ok", acc.alias("acc"), low.alias("low"), high.alias("high"), scoring.grade(acc).alias("grade"))


def day_rollup(attempts: DataFrame, bank: DataFrame, drills: DataFrame | None = None, phone: DataFrame | None = None) -> DataFrame:
    """user_id, d, n, ok, ms, pts of three logs; points by difficulty (unknown: 2), 3 a drill round, 1 a phone question."""
    a = attempts.join(bank.select("qid", "diff"), "qid", "left")
    parts = [a.select("user_id", "d", F.lit(1).cast("long").alias("n"), F.col("ok").cast("long").alias("ok"), F.coalesce("ms", F.lit(0)).cast("double").alias("ms"), F.coalesce(scoring.by_difficulty(F.col("diff"), scoring.POINTS), F.lit(2)).cast("double").alias("pts"))]
    if drills is not None:
        n = F.coalesce(F.nullif("n", F.lit(0)), F.lit(DRILL_SIZE))
        parts.append(drills.select("user_id", "d", n.cast("long").alias("n"), F.floor(n * F.coalesce("acc", F.lit(0)) / 100 + 0.5).cast("long").alias("ok"), (F.coalesce("med", F.lit(0)) * n).cast("double").alias("ms"), F.lit(float(DRILL_POINTS)).alias("pts")))
    if phone is not None:
        z = lambda c: F.coalesce(c, F.lit(0))
        parts.append(phone.select("user_id", "d", z("n").cast("long").alias("n"), z("ok").cast("long").alias("ok"), z("ms").cast("double").alias("ms"), z("n").cast("double").alias("pts")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.where("d is not null").groupBy("user_id", "d").agg(*[F.sum(c).alias(c) for c in ("n", "ok", "ms", "pts")])


def day_buckets(attempts: DataFrame, side: DataFrame, drills: DataFrame, bank: DataFrame) -> DataFrame:
    """user_id, d, drill, easy, mid, hard: counts of a day's questions."""
    by = bank.select("qid", "diff")
    rows = attempts.select("user_id", "d", "qid").unionByName(side.select("user_id", "d", "qid")).join(by, "qid").select("user_id", "d", F.lit(0).alias("drill"), "diff")
    rows = rows.unionByName(drills.select("user_id", "d", F.coalesce(F.nullif("n", F.lit(0)), F.lit(DRILL_SIZE)).cast("int").alias("drill"), F.lit(None).cast("int").alias("diff")))
    return rows.groupBy("user_id", "d").agg(F.sum("drill").alias("drill"), *[F.count_if(F.col("diff") == k).alias(n) for k, n in ((1, "easy"), (2, "mid"), (3, "hard"))])


def goal_days(days: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """Days whose rounded points reach the goal, but for those already told."""
    hit = days.where(F.floor(F.col("pts") + 0.5) >= scoring.DAY_GOAL).select("user_id", "d", "pts")
    return hit.join(told, ["user_id", "d"], "left_anti") if told is not None else hit


def attempt_counts(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("user_id", "qid").agg(F.count("*").alias("n"))


def personal_best(attempts: DataFrame) -> DataFrame:
    """user_id, qid, best_ms of right answers, ever_wrong."""
    return attempts.groupBy("user_id", "qid").agg(F.min(F.when(F.col("ok"), F.col("ms"))).alias("best_ms"), F.bool_or(~F.col("ok")).alias("ever_wrong"))


def weak_topics(attempts: DataFrame, bank: DataFrame, seq: str = "seq", recent: int = 60) -> DataFrame:
    """Topics of the last 60 mixed attempts with n >= 6 and a rate of at most 0.35, or whose last 4 are wrong. Unknown questions use up the 60."""
    last = last_n(attempts, recent, ["user_id"], ["ts", seq]).join(bank.select("qid", "topic"), "qid")
    g = last.groupBy("user_id", "topic").agg(F.count("*").alias("n"), F.count_if("ok").alias("ok"))
    tail = all_of_last(last, 4, ["user_id", "topic"], ["ts", seq], ~F.col("ok"))
    weak = ((F.col("n") >= 6) & (F.col("ok") / F.col("n") <= 0.35)) | F.col("all_last")
    return g.join(tail, ["user_id", "topic"]).where(weak).select("user_id", "topic", "n", "ok", (F.col("ok") / F.col("n")).alias("acc"))


def eligible_external(external: DataFrame, runs: DataFrame, sources: DataFrame) -> DataFrame:
    """External exams that may calibrate: not ruled out, and 20 questions by their own and their source's account."""
    r = runs.select("user_id", F.col("id").alias("paperRunId"), F.col("sourceId").alias("_run_source"))
    s = sources.select(F.col("id").alias("_source"), F.col("questions").alias("_questions"), F.col("calibrationEligible").alias("_eligible"))
    j = external.join(r, ["user_id", "paperRunId"], "left").withColumn("_source", F.coalesce(F.when(F.col("sourceId") != "", F.col("sourceId")), "_run_source"))
    j = j.join(s, "_source", "left")
    good = F.coalesce("calibrationEligible", F.lit(True)) & (F.col("_questions").isNull() | (F.col("_questions") == 20) & F.coalesce("_eligible", F.lit(True))) & (F.col("questions").isNull() | (F.col("questions") == 20))
    return j.where(good & (F.col("total") > 0) & F.col("score").isNotNull()).select(external.columns)


def calibration(external: DataFrame, system: DataFrame, today: Column) -> DataFrame:
    """The last three exams of each user, external ones if there are any: count, source, ok, n, acc, low, high, grade, passes, stable, stale_days."""
    e = last_n(external, 3, ["user_id"], ["d", "ts", "id"]).select("user_id", "d", F.col("score").alias("ok"), F.col("total").cast("double").alias("n"), (F.col("score") / F.col("total")).alias("acc"), F.lit("external").alias("source"))
    s = last_n(system.where("n > 0 and acc is not null"), 3, ["user_id"], ["seq"])
    s = s.select("user_id", "d", F.coalesce(F.nullif("ok", F.lit(0.0)), F.floor(F.col("acc") * F.col("n") + 0.5)).alias("ok"), F.col("n").cast("double").alias("n"), "acc", F.lit("system").alias("source"))
    rows = e.unionByName(s.join(e.select("user_id").distinct(), "user_id", "left_anti"))
    g = rows.groupBy("user_id", "source").agg(F.count("*").alias("count"), F.sum("ok").alias("ok"), F.sum("n").alias("n"), F.min("acc").alias("_min"), F.max("acc").alias("_max"), F.count_if(F.col("acc") >= scoring.GOAL_ACCURACY).alias("passes"), F.max("d").alias("last_day"))
    low, high = scoring.wilson(F.col("ok"), F.col("n"))
    acc = F.try_divide("ok", "n")
    external_ = F.col("source") == "external"
    return g.select("user_id", "source", "count", "ok", "n", acc.alias("acc"), F.when(external_, F.col("_min")).otherwise(low).alias("low"), F.when(external_, F.col("_max")).otherwise(high).alias("high"), scoring.grade(acc).alias("grade"), "passes", ((F.col("count") == 3) & (F.col("passes") == 3)).alias("stable"), F.greatest(F.lit(0), F.datediff(today, "last_day")).alias("stale_days"))


def level_of(level: Column, outcome: Column) -> Column:
    """The level, else one by the outcome's name."""
    return F.coalesce(level, F.when(outcome == "independent", 1).when(outcome == "hint", 2).when(outcome == "solution", 3))


def level_counts(entries: DataFrame, by: list[str]) -> DataFrame:
    """open, l1, l2, l3; done entries without a level count nowhere."""
    done = F.coalesce("done", F.lit(False))
    return entries.groupBy(*by).agg(F.count_if(~done).alias("open"), *[F.count_if(done & (F.col("level") == k)).alias(f"l{k}") for k in (1, 2, 3)])


def run_level_counts(keys: DataFrame, items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Levels of a run's questions: right without review is level 1, done reviews by their level, the rest open."""
    j = keys.join(items.select("run_id", "no", "status"), ["run_id", "no"], "left").join(reviews.select("run_id", "no", "done", "level"), ["run_id", "no"], "left")
    level = F.when(F.coalesce("done", F.lit(False)), F.coalesce("level", F.lit(1))).when(F.col("status") == "correct", 1)
    return j.withColumn("_l", level).groupBy("run_id").agg(F.count_if(F.col("_l").isNull()).alias("open"), *[F.count_if(F.col("_l") == k).alias(f"l{k}") for k in (1, 2, 3)])


def top_tags(rows: DataFrame, by: list[str], value: str, order: str, n: int = 4) -> DataFrame:
    """The n commonest values of each group; ties to the one seen first."""
    c = rows.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*by, value).agg(F.count("*").alias("cnt"), F.min(order).alias("_first"))
    w = Window.partitionBy(*by).orderBy(F.desc("cnt"), "_first", value)
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("_first")


def review_tags(reviews: DataFrame) -> DataFrame:
    """Reviews with topic and errorKind, their own or the last that a log has."""
    own = lambda c: F.coalesce(F.when(F.col(c) != "", F.col(c)), last_value(F.col("logs"), c))
    return reviews.withColumns({"topic": own("topic"), "errorKind": own("errorKind")})


def run_tags(runs: DataFrame, reviews: DataFrame, topics: list[str]) -> DataFrame:
    """id, topics, errors: distinct tags of a run, its reviews and their logs; topics of the dimension only."""
    logs = lambda c: F.transform(F.coalesce("logs", F.array()), lambda x: x[c])
    r = reviews.select("run_id", F.array_append(logs("topic"), F.col("topic")).alias("_t"), F.array_append(logs("errorKind"), F.col("errorKind")).alias("_e"))
    g = r.groupBy("run_id").agg(F.flatten(F.collect_list("_t")).alias("_t"), F.flatten(F.collect_list("_e")).alias("_e"))
    j = runs.join(g.withColumnRenamed("run_id", "id"), "id", "left")
    both = lambda a, b: F.array_sort(F.array_distinct(F.filter(F.concat(F.coalesce(a, F.array()), F.coalesce(b, F.array())), lambda x: x.isNotNull() & (x != ""))))
    return j.select("id", F.filter(both(F.col("topics"), F.col("_t")), lambda x: x.isin(topics)).alias("topics"), both(F.col("errors"), F.col("_e")).alias("errors"))


def content_stats(items: DataFrame, source: str = "src") -> DataFrame:
    """n, topics and counts by difficulty of each source."""
    return items.groupBy(source).agg(F.count("*").alias("n"), F.count_distinct("topic").alias("topics"), *[F.count_if(F.col("diff") == k).alias(f"d{k}") for k in (1, 2, 3)])


def exam_result(items: DataFrame, by: list[str]) -> DataFrame:
    """right answers, points to 2 decimals, numbers wrong and unanswered."""
    nos = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("no"))))
    return items.groupBy(*by).agg(F.count_if(F.col("status") == "correct").alias("ok_n"), scoring.round2(F.sum("points")).alias("score"), nos(F.col("status") != "correct").alias("wrong_nos"), nos(F.col("status") == "unanswered").alias("unanswered_nos"))


def round_summary(round_: DataFrame, bank: DataFrame) -> DataFrame:
    """Right, slow though right, and hard questions won of each user's round."""
    j = round_.join(bank.select("qid", "diff", "target"), "qid", "left")
    slow = F.col("ok") & (F.col("ms") > 1.5 * scoring.target_ms(F.col("target"), F.col("diff")))
    return j.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("ok").alias("ok_n"), F.count_if(slow).alias("slow_ok"), F.count_if(F.col("ok") & (F.col("diff") == 3)).alias("hard_wins"))


def round_vs_history(round_: DataFrame, history: DataFrame, bank: DataFrame, least: int = 5) -> DataFrame:
    """Topics improved on at least 5 earlier attempts: now, past, strong (past below 0.6, all right now)."""
    b = bank.select("qid", "topic")
    rate = lambda d, n: d.join(b, "qid").groupBy("user_id", "topic").agg(F.count("*").alias(f"{n}_n"), F.avg(F.col("ok").cast("double")).alias(n))
    j = rate(round_, "now").join(rate(history, "past"), ["user_id", "topic"])
    return j.where((F.col("past_n") >= least) & (F.col("now") > F.col("past"))).withColumn("strong", (F.col("past") < 0.6) & (F.col("now") == 1))


def vision_summary(entries: DataFrame) -> DataFrame:
    """Counts of a queue's outcomes by paper: seen, first-day, two-day and solution outcomes, complete (20 and all seen)."""
    return entries.groupBy("user_id", "paperId").agg(
        F.count("*").alias("n"), F.count_if("paperSeen").alias("seen"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("known", "first", "second", "solution")], ((F.count("*") == 20) & F.bool_and("paperSeen")).alias("complete"), F.max("paperTs").alias("paperTs")
    )


def active_paper(entries: DataFrame) -> DataFrame:
    """Each user's latest paper that isn't wholly seen."""
    s = vision_summary(entries).where("seen < n")
    w = Window.partitionBy("user_id").orderBy(F.desc("paperTs"), "paperId")
    return s.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def next_unseen(entries: DataFrame) -> DataFrame:
    """The first entry of each paper that isn't seen."""
    w = Window.partitionBy("user_id", "paperId").orderBy("paperIndex", "id")
    return entries.where(~F.coalesce("paperSeen", F.lit(False))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def process_metrics(strokes: DataFrame, erasures: DataFrame, by: list[str], since: str, until: Column) -> DataFrame:
    """fi, hes, era, tail, n of each answer: seconds to the first stroke, pauses of 15 s or more (12 at most), erasures, seconds after the last stroke, strokes."""
    sec = lambda c: F.floor(c / 1000 + 0.5).cast("int")
    w = Window.partitionBy(*by).orderBy("t0", "t1", "id")
    s = strokes.where(F.col("t0") >= F.col(since)).withColumn("_prev", F.lag("t1").over(w)).withColumn("_gap", F.col("t0") - F.col("_prev"))
    pause = F.when(F.col("_gap") >= 15_000, F.struct(F.col("_prev"), F.array(sec(F.col("_prev") - F.col(since)), sec(F.col("_gap"))).alias("h")))
    g = s.groupBy(*by).agg(sec(F.min(F.col("t0") - F.col(since))).alias("fi"), F.slice(F.transform(F.array_sort(F.collect_list(pause)), lambda x: x["h"]), 1, 12).alias("hes"), F.max_by("t1", F.struct("t0", "t1", "id")).alias("_last"), F.count("*").cast("int").alias("n"))
    e = erasures.groupBy(*by).agg(F.count("*").cast("int").alias("era"))
    j = g.join(e, by, "full_outer")
    return j.select(*by, "fi", F.coalesce("hes", F.array().cast("array<array<int>>")).alias("hes"), F.coalesce("era", F.lit(0)).alias("era"), sec(until - F.col("_last")).alias("tail"), F.coalesce("n", F.lit(0)).alias("n"))


def merged_metrics(a: Column, b: Column) -> Column:
    """Two visits' metrics as one."""
    both = F.struct(
        F.coalesce(a["fi"], b["fi"]).alias("fi"), F.slice(F.concat(a["hes"], b["hes"]), 1, 12).alias("hes"), (a["era"] + b["era"]).alias("era"), F.coalesce(b["tail"], a["tail"]).alias("tail"), (a["n"] + b["n"]).alias("n")
    )
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def bounding_box(points: DataFrame, by: list[str]) -> DataFrame:
    return points.groupBy(*by).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def mean_pressure(points: Column) -> Column:
    """The third coordinate's mean, 0.5 where there is none."""
    p = F.transform(points, lambda x: F.coalesce(F.nullif(F.get(x, F.lit(2)), F.lit(0.0)), F.lit(0.5)))
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / F.size(points)


def usage_by_day(events: DataFrame) -> DataFrame:
    """Tokens of each user and local day; negative and null ones count 0."""
    z = lambda c: F.sum(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)))
    return events.groupBy("user_id", dates.local_day(F.col("ts")).alias("usage_date")).agg(z("input_tokens").alias("input_tokens"), z("output_tokens").alias("output_tokens"))


def dashboard(entries: DataFrame, run_levels: DataFrame, vision: DataFrame, concepts: DataFrame, outlines: DataFrame) -> DataFrame:
    """One row a user: open and level counts of both kinds, vision outcomes, concepts understood, outlines ready."""
    a = level_counts(entries, ["user_id"])
    b = run_levels.groupBy("user_id").agg(*[F.sum(c).alias(f"run_{c}") for c in ("open", "l1", "l2", "l3")])
    v = vision.groupBy("user_id").agg(F.count_if(F.col("outcome") == "first").alias("first_day"), F.count_if(F.col("outcome") == "second").alias("two_day"))
    c = concepts.groupBy("user_id").agg(F.count_if("understood").alias("concepts_understood"))
    o = outlines.groupBy("user_id").agg(F.count_if("ready").alias("outlines_ready"))
    out = a
    for t in (b, v, c, o):
        out = out.join(t, "user_id", "full_outer")
    return out.fillna(0)


def next_action(facts: DataFrame) -> DataFrame:
    """The first that applies of: due corrections, outlines, vision entries, no exam, an exam 7 days old, a weak topic, a concept; else a vision round. facts has a row a user with the counts."""
    kind = F.when(F.col("due_corrections") > 0, "correction").when(F.col("due_outlines") > 0, "outline").when(F.col("due_vision") > 0, "vision").when(F.coalesce("exams", F.lit(0)) == 0, "mock").when(F.col("stale_days") >= 7, "mock")
    kind = kind.when(F.col("weak_topics") > 0, "topic").when(F.col("due_concepts") > 0, "concept").otherwise("vision")
    minutes = F.when(kind == "correction", F.greatest(F.lit(10), F.col("due_corrections") * 5)).when((kind == "vision") & (F.col("due_vision") > 0), F.greatest(F.lit(5), F.col("due_vision") * 4)).when(kind == "mock", 100).when(kind == "outline", 15).when(kind == "topic", 20).when(kind == "concept", 5).otherwise(40)
    return facts.select("user_id", kind.alias("kind"), minutes.cast("int").alias("minutes"))


def pending_batches(entries: DataFrame, today: Column | None = None) -> DataFrame:
    """Batches with an open entry (and due): the number of open entries."""
    open_ = entries.where(~F.coalesce("done", F.lit(False)))
    if today is not None:
        open_ = open_.where(dates.is_due(F.col("due"), today))
    return open_.groupBy("user_id", "batch_id").agg(F.count("*").alias("open"))


def _last_due(dimension: DataFrame, log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """user_id, key, due of each user's latest row of each item that the dimension has."""
    w = Window.partitionBy("user_id", key).orderBy(*[F.desc(c) for c in order])
    last = log.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("user_id", key, "due")
    return last.join(dimension.select(key).distinct(), key, "left_semi").select("user_id", key, "due")


def due_counts(dimension: DataFrame, log: DataFrame, key: str, today: Column, order: list[str]) -> DataFrame:
    """user_id, due (items done before that are due), never (items of the dimension never done): a badge is their sum."""
    done = _last_due(dimension, log, key, order).groupBy("user_id").agg(F.count_if(dates.is_due(F.col("due"), today)).alias("due"), F.count("*").alias("_done"))
    whole = dimension.agg(F.count_distinct(key).alias("_all"))  # one row
    return done.crossJoin(F.broadcast(whole)).select("user_id", "due", (F.col("_all") - F.col("_done")).alias("never"))


def never_done(dimension: DataFrame, own_log: DataFrame, key: str) -> DataFrame:
    """Items of the dimension that one user's log lacks."""
    return dimension.join(own_log.select(key), key, "left_anti")
