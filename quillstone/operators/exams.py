"""Graded exams: deterministic scores from read answers, overrides, reviews and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from .windows import first_per_key

#: Statuses of an item, and option numbers of a scanned question.
STATUSES = ["correct", "incorrect", "unanswered", "uncertain"]
OPTIONS = [1, 2, 3, 4, 5]


def regraded(items: DataFrame, key: DataFrame, pos: str = "pos") -> DataFrame:
    """Items as read (run_id, no, status, points, finalAnswer, selectedOptions, hasFinalAnswer, pos) scored by the key (no, type, points, ans_idx from 0, ans_txt).

    The first item of a number counts. Structured answers decide over the stated
    status. run_ok tells whether every number of the key was read.
    """
    first = first_per_key(items, ["run_id", "no"], [pos])
    k = key.select("no", "type", F.col("points").alias("full"), F.array_sort(F.transform(F.coalesce("ans_idx", F.array().cast("array<int>")), lambda a: a + 1)).alias("right"), F.coalesce("ans_txt", F.array().cast("array<string>")).alias("accepted"))
    j = first.join(k, "no")
    options = F.array(*[F.lit(o) for o in OPTIONS])
    given = F.col("selectedOptions").isNotNull()
    picked = F.array_sort(F.array_distinct(F.filter(F.coalesce("selectedOptions", F.array().cast("array<int>")), lambda o: o.between(1, 5))))
    text = F.trim(F.coalesce("finalAnswer", F.lit("")))
    status = F.when(F.col("status").isin(STATUSES), F.col("status")).otherwise("uncertain")
    concrete = F.when(F.col("type") == "fill", text != "").otherwise(F.size(picked) > 0)
    blank = (~F.coalesce("hasFinalAnswer", F.lit(True))) | ((status == "unanswered") & ~concrete)
    single, multi, fill = (F.col("type") == t for t in ("single", "multi", "fill"))
    written = F.col("finalAnswer").isNotNull()
    right = F.get(picked, F.lit(0)) == F.get("right", F.lit(0))
    parts = scoring.multi_points(F.col("full"), picked, F.col("right"), options)
    said = (
        F.when(status == "uncertain", "uncertain")
        .when((single & given | fill & written | multi & given) & blank, "unanswered")
        .when(single & given & (F.size(picked) == 1), F.when(right, "correct").otherwise("incorrect"))
        .when(single & given, F.when(F.size(picked) > 1, "incorrect").otherwise("uncertain"))
        .when(fill & written & (text == ""), "uncertain")
        .when(fill & written, F.when(scoring.fill_correct(text, F.col("accepted")), "correct").otherwise("incorrect"))
        .when(multi & given & (F.size(picked) == 0), "unanswered")
        .when(multi & given, F.when(parts == F.col("full"), "correct").otherwise("incorrect"))
        .when(blank, "unanswered")
        .otherwise(status)
    )
    # nearest of 0, 1/5 and 3/5; of equally near ones the first
    steps = F.array(F.lit(0.0), F.col("full") * 0.2, F.col("full") * 0.6)
    near = F.get(F.array_sort(F.transform(steps, lambda v, i: F.struct(F.abs(v - F.coalesce("points", F.lit(0.0))).alias("d"), i.alias("i"), v.alias("v")))), F.lit(0))["v"]
    j = j.withColumn("_said", said)
    points = F.when(F.col("_said") == "correct", F.col("full") * 1.0).when(F.col("_said").isin("unanswered", "uncertain"), 0.0).when(multi & given, parts).when(multi, near).otherwise(0.0)
    count = F.count("*").over(Window.partitionBy("run_id"))
    j = j.withColumn("points", scoring.clamp(scoring.round2(points), 0.0, F.col("full"))).withColumn("run_ok", count == F.lit(key.count()))
    return j.select("run_id", "no", "type", F.col("_said").alias("status"), "points", "full", picked.alias("selectedOptions"), text.alias("finalAnswer"), "right", "run_ok")


def option_marks(graded: DataFrame) -> DataFrame:
    """run_id, no, option, mark: check and strike for chosen options, add for missed ones, of answered multiple choices."""
    m = graded.where("type = 'multi' and status in ('correct', 'incorrect')")
    chosen = F.transform("selectedOptions", lambda o: F.struct(o.alias("option"), F.when(F.array_contains("right", o), "check").otherwise("strike").alias("mark")))
    missed = F.transform(F.array_except("right", "selectedOptions"), lambda o: F.struct(o.alias("option"), F.lit("add").alias("mark")))
    return m.select("run_id", "no", F.explode(F.concat(chosen, missed)).alias("_m")).select("run_id", "no", "_m.option", "_m.mark")


def totals(items: DataFrame) -> DataFrame:
    """run_id, score, wrong_nos, uncertain_nos."""
    nos = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("no"))))
    return items.groupBy("run_id").agg(scoring.round2(F.sum("points")).alias("score"), nos(F.col("status") != "correct").alias("wrong_nos"), nos(F.col("status") == "uncertain").alias("uncertain_nos"))


def snapshot(items: DataFrame, reason: str, at: Column) -> DataFrame:
    """An audit row a run with its items' numbers, statuses and points."""
    return items.groupBy("run_id").agg(F.lit(reason).alias("reason"), at.alias("at"), scoring.round2(F.sum("points")).alias("score"), F.array_sort(F.collect_list(F.struct("no", "status", "points"))).alias("questions"))


def overridden(items: DataFrame, edits: DataFrame, key: DataFrame, at: Column) -> DataFrame:
    """items with human edits (run_id, no, status, points): points clamped to the key's, changed rows stamped and manual."""
    e = edits.select("run_id", "no", F.col("status").alias("_s"), F.col("points").alias("_p"))
    j = items.join(e, ["run_id", "no"], "left").join(key.select("no", F.col("points").alias("_full")), "no", "left")
    s, p = F.coalesce("_s", "status"), F.when(F.col("_p").isNull(), F.col("points")).otherwise(scoring.clamp(F.col("_p"), 0.0, F.col("_full")))
    changed = (s != F.col("status")) | (p != F.col("points"))
    return j.withColumns({"_c": changed, "_ns": s, "_np": p}).withColumns({"status": F.col("_ns"), "points": F.col("_np"), "manual": F.coalesce("manual", F.lit(False)) | F.col("_c"), "mt": F.when(F.col("_c"), at).otherwise(F.col("mt"))}).select(*items.columns)


def review_start(keys: DataFrame, wrong: DataFrame, reviews: DataFrame) -> DataFrame:
    """run_id, no, level, pending: numbers not wrong get level 1, wrong ones in range are pending until done."""
    w = wrong.select("run_id", "no").distinct().withColumn("_wrong", F.lit(True))
    j = keys.join(w, ["run_id", "no"], "left").join(reviews.select("run_id", "no", "done", "level"), ["run_id", "no"], "left")
    bad = F.coalesce("_wrong", F.lit(False))
    return j.select("run_id", "no", F.coalesce("level", F.when(~bad, 1)).alias("level"), (bad & ~F.coalesce("done", F.lit(False))).alias("pending"))


def graded_set(paper: DataFrame, answers: DataFrame, excluded: DataFrame, partial: bool) -> DataFrame:
    """Questions that count: all, or the answered ones of a partial paper, less the excluded."""
    out = paper.join(answers.select("session", "qid"), ["session", "qid"], "left_semi") if partial else paper
    return out.join(excluded.select("session", "qid"), ["session", "qid"], "left_anti")


def unjudged(paper: DataFrame, verdicts: DataFrame) -> DataFrame:
    return paper.join(verdicts.select("session", "qid"), ["session", "qid"], "left_anti")


def time_spent(visits: DataFrame, idle: int = 360_000) -> DataFrame:
    """session, qid, ms over all visits, rounds, and whether a visit was idle for 6 minutes."""
    return visits.groupBy("session", "qid").agg(F.sum("ms").alias("ms"), F.count("*").alias("visits"), F.bool_or(F.col("ms") >= idle).alias("idle"))


def last_verdicts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("session", "qid").agg(F.max_by("ok", F.struct("ts", "seq")).alias("ok"))


def answer_text(kind: Column, right: Column, accepted: Column, display: Column) -> Column:
    """What is shown as the answer."""
    options = F.array_join(F.transform(right, lambda o: F.concat(F.lit("("), o.cast("string"), F.lit(")"))), "")
    return F.coalesce(display, F.when(kind == "fill", F.get(accepted, F.lit(0))).otherwise(options))


def detail_opens(opens: DataFrame) -> DataFrame:
    return opens.groupBy("run_id", "no").agg(F.min("ts").alias("detailFirstOpenedAt"), F.max("ts").alias("detailLastOpenedAt"), F.count("*").cast("int").alias("detailViewCount"))


def history(runs: DataFrame) -> DataFrame:
    """Runs, newest first within a user, with a stage name."""
    at = F.coalesce(F.nullif("submittedAt", F.lit(0)), F.nullif("createdAt", F.lit(0)), "mt")
    stage = F.when(F.col("status").isin("active", "paused"), "open").when(F.col("status") == "grading", "grading").when(F.col("status").startswith("awaiting"), "waiting").when(F.col("status") == "discarded", "discarded").otherwise("done")
    w = Window.partitionBy("user_id").orderBy(F.desc(at), "id")
    return runs.select("user_id", "id", "sourceId", at.alias("at"), stage.alias("stage"), F.row_number().over(w).alias("nth"))


def latest_run(runs: DataFrame, active: bool) -> DataFrame:
    """Each user's latest active run, or latest run of each source that isn't discarded."""
    at = F.coalesce(F.nullif("submittedAt", F.lit(0)), F.nullif("createdAt", F.lit(0)), "mt")
    rows = runs.where(F.col("status").isin("active", "paused", "grading")) if active else runs.where("status <> 'discarded'")
    w = Window.partitionBy(*(["user_id"] if active else ["user_id", "sourceId"])).orderBy(F.desc(at), "id")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def scan_page(no: Column, starts: list[int]) -> Column:
    """The page (from 1) of a question by the first numbers of pages."""
    return F.greatest(F.lit(1), sum((F.when(no >= s, 1).otherwise(0) for s in starts), F.lit(0)))


def fallback_marks(items: DataFrame) -> DataFrame:
    """y of a mark without a box: even places down the page, 0.08 to 0.92."""
    w = Window.partitionBy("run_id", "page")
    nth, n = F.row_number().over(w.orderBy("no")), F.count("*").over(w)
    return items.withColumn("y", 0.08 + 0.84 * (nth - 0.5) / n)


def clean_marks(marks: Column) -> Column:
    """The first 7 marks with a box of four numbers, clamped to the page."""
    ok = F.filter(F.slice(marks, 1, 7), lambda m: (F.size(m["box"]) == 4) & F.forall(m["box"], lambda v: v.isNotNull() & ~F.isnan(v)))
    return F.transform(ok, lambda m: F.struct(F.transform(m["box"], lambda v: scoring.clamp(v, 0.0, 1.0)).alias("box"), F.coalesce(m["kind"], F.lit("")).alias("kind"), F.coalesce(m["option"], F.lit(0)).alias("option")))


def transitions(states: DataFrame, allowed: list[tuple[str, str]]) -> DataFrame:
    """Changes of status that aren't allowed."""
    w = Window.partitionBy("id").orderBy("ts", "seq")
    j = states.withColumn("before", F.lag("status").over(w)).where("before is not null and before <> status")
    return j.where(~F.concat_ws(">", "before", "status").isin([f"{a}>{b}" for a, b in allowed]))


def key_rows(sources: DataFrame) -> DataFrame:
    """A row for each question of a source's answer key (id, key array): no from 1, options counted from 1."""
    rows = sources.select(F.col("id").alias("source_id"), F.posexplode("key").alias("_p", "k"))
    return rows.select("source_id", (F.col("_p") + 1).alias("no"), F.col("k.type").alias("type"), F.col("k.points").alias("points"), F.transform("k.ans", lambda a: a + 1).alias("options"))


def pending_entries(entries: DataFrame, bank: DataFrame) -> DataFrame:
    """Open entries whose question the bank still has, in order of their number."""
    w = Window.partitionBy("user_id", "batch_id").orderBy("examNo", "qid")
    open_ = entries.where(~F.coalesce("done", F.lit(False))).join(bank.select("qid"), "qid", "left_semi")
    return open_.withColumn("nth", F.row_number().over(w))


def visible_logs(logs: Column) -> Column:
    """Logs but for those of the detail gate."""
    return F.filter(logs, lambda x: F.coalesce(x["kind"], F.lit("")) != "detail-gate")
