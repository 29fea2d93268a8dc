"""Validation and cleaning of question banks: rules in order, reports, dedup and template groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.schemas import RESERVED_IDS, TOPICS, TYPES


def violation(topics: list[str] | None = None, options_code: bool = True) -> Column:
    """The first rule that a question breaks, null if none. options_code: whether bad options have a code of their own."""
    c = F.col
    blank = lambda x: x.isNull() | (x == "")
    options = c("opts").isNull() | (F.size("opts") < 2) | F.exists("opts", lambda o: o.isNull())
    picks = c("ans_idx").isNull() | (F.size("ans_idx") == 0) | F.exists("ans_idx", lambda a: a.isNull() | (a < 0) | (a >= F.size("opts")))
    fills = c("ans_txt").isNull() | (F.size("ans_txt") == 0) | F.exists("ans_txt", lambda a: a.isNull())
    fill = c("type") == "fill"
    return (
        F.when(blank(c("id")), "id-missing")
        .when(~c("id").rlike(r"^[A-Za-z0-9_.:-]+$"), "id-invalid")
        .when(c("id").isin(RESERVED_IDS), "id-reserved")
        .when(F.coalesce(~c("topic").isin(list(topics or TOPICS)), F.lit(True)), "topic-invalid")
        .when(F.coalesce(~c("type").isin(TYPES), F.lit(True)), "type-invalid")
        .when(F.coalesce(~c("diff").isin(1, 2, 3), F.lit(True)), "difficulty-invalid")
        .when(blank(c("q")), "question-missing")
        .when(fill & fills, "answer-invalid")
        .when(~fill & options, "options-invalid" if options_code else "answer-invalid")
        .when(~fill & picks, "answer-invalid")
    )


def shown_text() -> Column:
    """Every field that is shown, a line each."""
    none = F.array().cast("array<string>")
    return F.array_join(F.concat(F.filter(F.array("q", "stem", "sol", "tip", "src", "fig", "solFig"), lambda x: x.isNotNull()), F.coalesce("opts", none), F.coalesce("ans_txt", none)), "\n")


def cleaned(items: DataFrame) -> DataFrame:
    """Text fields without pictographs and spare blanks."""
    out = items.withColumns({c: text.clean_text(F.col(c)) for c in ("q", "stem", "sol", "tip", "src")})
    return out.withColumns({c: F.transform(c, text.clean_text) for c in ("opts", "ans_txt")})


REASONS = ["schema", "duplicateId", "missingFigure", "outOfRange", "suspiciousHtml", "duplicateBuiltin", "duplicateLegacy"]


def judged(items: DataFrame, builtin: DataFrame, pos: str = "pos", topics: list[str] | None = None) -> DataFrame:
    """items cleaned, with reason (the first check failed, null for accepted) and had_pictograph.

    Two window stages, since a row later refused still blocks its id, and a text
    counts as taken only by rows that passed every earlier check. What each check
    needs is taken from the texts before the windows, texts by a 128-bit hash: a
    report, which wants no texts, shuffles none.
    """
    c = F.col
    d = items.withColumn("had_pictograph", text.has_pictograph(shown_text())).withColumn("_risky", text.risky_markup(shown_text()))
    hashed = F.md5(text.normalize_question(c("q")))
    figure = F.coalesce("needsFigure", F.lit(False)) & F.coalesce(c("fig") == "", F.lit(True))
    d = cleaned(d).withColumns({"_bad": violation(topics).isNotNull(), "_hash": hashed, "_scope": text.out_of_scope(c("q")), "_figure": figure})
    d = d.withColumn("_nth", F.row_number().over(Window.partitionBy("id", "_bad").orderBy(pos)))
    d = d.join(builtin.select(hashed.alias("_hash")).distinct().withColumn("_known", F.lit(True)), "_hash", "left")
    reason = F.when(c("_bad"), "schema").when(c("_nth") > 1, "duplicateId").when(c("_figure"), "missingFigure")
    reason = reason.when(c("_scope"), "outOfRange").when(c("_risky"), "suspiciousHtml").when(c("_known"), "duplicateBuiltin")
    d = d.withColumn("reason", reason)
    seen = F.row_number().over(Window.partitionBy("_hash", c("reason").isNull()).orderBy(pos))
    d = d.withColumn("_seen", seen).withColumn("reason", F.when(c("reason").isNull() & (c("_seen") > 1), "duplicateLegacy").otherwise(c("reason")))
    return d.drop("_risky", "_bad", "_nth", "_hash", "_known", "_seen", "_scope", "_figure")


def report(judged_items: DataFrame) -> DataFrame:
    """One row: total, accepted, cleaned, and refusals by reason."""
    return judged_items.agg(F.count("*").alias("sourceTotal"), F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if("had_pictograph").alias("emojiCleaned"), *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])


def with_templates(accepted: DataFrame, pos: str = "pos") -> DataFrame:
    """accepted with a shared grp for questions that differ in numbers only."""
    mask = text.normalize_question(F.col("q"), True)
    w = Window.partitionBy("_mask")
    d = accepted.withColumn("_mask", mask)
    grp = F.concat(F.lit("legacy-"), F.substring(F.sha2("_mask", 256), 1, 14))
    return d.withColumn("grp", F.when(F.count("*").over(w) > 1, grp).otherwise(F.col("grp"))).drop("_mask")


def active_bank(builtin: DataFrame, external: DataFrame, disabled: DataFrame, pos: str = "pos") -> DataFrame:
    """builtin and the external questions that may be asked: in order the first valid one of each id that no builtin has."""
    e = external.where(F.col("id").isNotNull() & (F.col("id") != "")).join(builtin.select("id"), "id", "left_anti")
    e = e.where(~(F.coalesce("needsFigure", F.lit(False)) & F.coalesce(F.col("fig") == "", F.lit(True)))).where(~F.coalesce("dup", F.lit(False)))
    e = e.join(disabled.select("src"), "src", "left_anti").where(~text.out_of_scope(F.col("q"))).where(violation(options_code=False).isNull())
    first = Window.partitionBy("id").orderBy(pos)
    e = e.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return builtin.unionByName(e, allowMissingColumns=True)


def disabled_sources(states: DataFrame) -> DataFrame:
    """Sources switched off: struct<off,ts>, or the plain true of old states."""
    return states.where(F.coalesce(F.col("state.off"), F.col("legacy"), F.lit(False))).select("src")


def visible_rows(rows: DataFrame, user: str | None, owns_legacy: bool) -> DataFrame:
    """Rows of the user, and ownerless ones if the user owns the old data; nothing when signed out."""
    if user is None:
        return rows.where(F.lit(False))
    mine = F.col("user_id") == user
    return rows.where(mine | F.col("user_id").isNull() if owns_legacy else mine)


def row_security(rows: DataFrame, members: DataFrame, user: str) -> DataFrame:
    """Rows that the user owns, if the allow-list has it."""
    return rows.where(F.col("user_id") == user).join(members.where("enabled").select("user_id"), "user_id", "left_semi")


def import_split(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and bad ones with their code."""
    d = items.withColumn("code", violation(options_code=False))
    return d.where("code is null").drop("code"), d.where("code is not null")


def request_ok(messages: Column, images: Column) -> Column:
    """Shape limits of a request: 24 messages, 8 images, 80 000 characters."""
    chars = F.aggregate(messages, F.lit(0), lambda a, m: a + F.length(m["text"]))
    return (F.size(messages) >= 1) & (F.size(messages) <= 24) & (images <= 8) & (chars <= 80_000)


def outline_ok(items: DataFrame, by: list[str]) -> DataFrame:
    """Imports with exactly 11 valid outline rows."""
    good = F.col("id").isNotNull() & F.col("title").isNotNull() & (F.col("title") != "")
    return items.groupBy(*by).agg((F.count_if(good) == 11).alias("ok"))


def detail_allowed(runs: DataFrame, reviews: DataFrame, requests: DataFrame, today: Column) -> DataFrame:
    """requests (run_id, no) and allowed: the run exists and is due, the number is in 1..20 and has a review state."""
    r = runs.select(F.col("id").alias("run_id"), F.coalesce(F.col("due") <= today, F.lit(True)).alias("_due"))
    s = reviews.select("run_id", "no").distinct().withColumn("_state", F.lit(True))
    j = requests.join(r, "run_id", "left").join(s, ["run_id", "no"], "left")
    return j.select(*requests.columns, (F.coalesce("_due", F.lit(False)) & F.col("no").between(1, 20) & F.coalesce("_state", F.lit(False))).alias("allowed"))


def effort_ok(direction: Column, topic: Column, concept: Column) -> Column:
    """A direction of 8 characters, or a topic and a concept of 2."""
    n = lambda c: F.length(F.trim(F.coalesce(c, F.lit(""))))
    return (n(direction) >= 8) | ((n(topic) > 0) & (n(concept) >= 2))


def unique_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once: a primary key's check."""
    return df.groupBy(*key).count().where("count > 1")


def foreign_violations(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")
