"""Choosing questions: ranked candidates, greedy dedup and the exam builder. Random ties are seeded hashes."""

from __future__ import annotations

from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Type, number and difficulty pattern of each section that the builder fills.
SECTIONS = [("single", 6, [1, 2, 2, 3, 2, 1]), ("multi", 6, [1, 2, 2, 3, 2, 1]), ("fill", 5, [1, 2, 2, 3, 2])]
PICKS = sum(n for _, n, _ in SECTIONS) + 1


#: Lists are cut at these lengths; a row goes to the first that is long enough for what its user has used.
LEVELS = [8 * 4**k for k in range(14)]


def _level(need: Column) -> Column:
    """The first level that is `need` or more."""
    return F.coalesce(*[F.when(need <= n, F.lit(n)) for n in LEVELS], F.lit(LEVELS[-1]))


def similar(bank: DataFrame, wanted: DataFrame, counts: DataFrame, done: DataFrame, top: int = 5, seed: int = 1) -> DataFrame:
    """For each wanted question (user_id, qid) the top candidates of its topic, and one picked of them.

    Candidates of its type; of any type only where there are none. Variants come
    first, then equal difficulty, then fewest attempts, then the id.

    A question's candidates are not its whole topic: of those a user never tried, the
    order is the same for all users, so one ranked list of each topic, type and
    difficulty serves them. With c questions of the topic done or tried, the first
    top + c + 1 of a list hold all untried ones that can be among the top (what stands
    before them is done, tried or the question itself). Tried ones come from the user's
    own counts, variants by a join on their ids' beginnings.
    """
    b = bank.select("id", "topic", "type", "diff", "src")
    tried = counts.where("n > 0").select("user_id", F.col("qid").alias("id"), "n").join(b, "id")
    gone = done.select("user_id", F.col("qid").alias("id")).distinct()
    of_topic = tried.select("user_id", "topic", "id").unionByName(gone.join(b, "id").select("user_id", "topic", "id")).distinct().groupBy("user_id", "topic").agg(F.count("*").alias("_used"))
    of_type = gone.join(b, "id").groupBy("user_id", "topic", "type").agg(F.count("*").alias("_gone"))
    sizes = b.groupBy("topic", "type").agg(F.count("*").alias("_size"))

    w = wanted.select("user_id", "qid").distinct().join(b.select(F.col("id").alias("qid"), "topic", "type", "diff"), "qid").join(sizes, ["topic", "type"])
    w = w.join(of_topic, ["user_id", "topic"], "left").join(of_type, ["user_id", "topic", "type"], "left").join(gone.select("user_id", F.col("id").alias("qid"), F.lit(1).alias("_self")), ["user_id", "qid"], "left")
    others = F.col("_size") - F.coalesce("_gone", F.lit(0)) - 1 + F.coalesce("_self", F.lit(0))
    w = w.select("user_id", "qid", "topic", F.col("type").alias("_type"), F.col("diff").alias("_diff"), (others > 0).alias("_same"), _level(top + 1 + F.coalesce("_used", F.lit(0))).alias("_level"))

    # the lists: by type, and of any type (null); variants by source first, then those of the difficulty
    of_source = F.coalesce(F.col("src").contains("類題"), F.lit(False))
    wanted_diffs = b.select("topic", F.col("diff").alias("_diff")).distinct()
    lists = b.withColumn("_v", of_source).withColumn("_type", F.explode(F.array(F.col("type"), F.lit(None).cast("string")))).join(wanted_diffs, "topic")
    order = Window.partitionBy("topic", "_type", "_diff").orderBy(F.desc("_v"), F.desc(F.col("diff").eqNullSafe(F.col("_diff"))), "id")
    lists = lists.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= LEVELS[-1]).withColumn("_level", F.explode(F.filter(F.array(*[F.lit(n) for n in LEVELS]), lambda n: n >= F.col("_r"))))
    asked = w.select("_level", "topic", "_diff", F.when(F.col("_same"), F.col("_type")).alias("_list")).distinct()
    lists = lists.join(asked, (lists["topic"] == asked["topic"]) & lists["_type"].eqNullSafe(asked["_list"]) & lists["_diff"].eqNullSafe(asked["_diff"]) & (lists["_level"] == asked["_level"]), "left_semi")
    lists = lists.select(F.col("topic").alias("_topic"), F.col("_type").alias("_list"), F.col("_diff").alias("_d"), F.col("_level").alias("_l"), "id", "type", "diff", "_v")
    key = [(F.col("topic") == F.col("_topic")), F.when(F.col("_same"), F.col("_type")).eqNullSafe(F.col("_list")), F.col("_diff").eqNullSafe(F.col("_d")), F.col("_level") == F.col("_l")]
    names = ["user_id", "qid", "_type", "_diff", "_same", "id", "type", "diff", "_v"]
    untried = w.join(lists, key[0] & key[1] & key[2] & key[3]).select(*names)
    own = w.join(tried.select("user_id", "topic", "id", "type", "diff", of_source.alias("_v")), ["user_id", "topic"]).select(*names)
    # variants are named after their question: v-<qid>...
    base = F.substring(F.col("id").cast("string"), 3, 1 << 20)
    made = b.where(F.col("id").cast("string").startswith("v-")).select("topic", "id", "type", "diff", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(base), F.lit(1))), lambda k: F.substring(base, F.lit(1), k))).alias("_of"))
    named = w.join(made.select(F.col("topic").alias("_topic"), "id", "type", "diff", "_of"), (F.col("topic") == F.col("_topic")) & (F.col("qid").cast("string") == F.col("_of"))).withColumn("_v", F.lit(True)).select(*names)

    c = untried.unionByName(own).unionByName(named).where("id <> qid").where((F.col("type").eqNullSafe(F.col("_type"))) | ~F.col("_same"))
    c = c.groupBy("user_id", "qid", "_diff", "id", "diff").agg(F.bool_or("_v").alias("_v"))
    c = c.join(gone, ["user_id", "id"], "left_anti").join(tried.select("user_id", "id", "n"), ["user_id", "id"], "left").fillna({"n": 0})
    each = Window.partitionBy("user_id", "qid")
    c = c.withColumn("rank", F.row_number().over(each.orderBy(F.desc("_v"), F.desc(F.col("diff") == F.col("_diff")), "n", "id"))).where(F.col("rank") <= top)
    pick = F.pmod(F.xxhash64(F.lit(seed), "user_id", "qid"), F.count("*").over(each)) + 1
    return c.withColumn("picked", F.col("rank") == pick).select("user_id", "qid", "id", "rank", "picked")


def least_practised(pool: DataFrame, counts: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """The n questions of each user with fewest attempts, ties in a seeded order."""
    j = pool.join(counts, ["user_id", "qid"], "left").fillna({"n": 0})
    w = Window.partitionBy("user_id").orderBy("n", F.xxhash64(F.lit(seed), "qid"), "qid")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def shuffled(df: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """A seeded order that doesn't depend on partitions."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)


def group_key() -> Column:
    """The group of a question: grp, else source and start of a shared stem, else its id."""
    stem = F.substring(F.regexp_replace("q", r"<[^>]+>", ""), 1, 24)
    return F.coalesce(F.nullif("grp", F.lit("")), F.when(F.col("q").contains("題為題組"), F.concat_ws("|", F.coalesce("src", F.lit("")), stem)), F.col("id"))


def deduped(lists: DataFrame, by: list[str], n: int, pos: str = "pos") -> DataFrame:
    """The first n of each list, at most one for a group and one for a skeleton of 12 characters or more; then filled up in order.

    Which of a row's keys count depends on whether the row was taken, so a list's
    candidates are folded in order. Before that all rows that can't be taken are left
    out: repeats of a (group, skeleton), as what bars the first bars them too; rows
    after the first n of a group or of a skeleton, as fewer than n others are barred by
    the other key; and of what is left those after the first n (2 n - 1), as each row
    taken bars at most 2 n - 2. So no list, however long, is one array.
    """
    d = lists.withColumns({"_k": group_key(), "_s": text.skeleton(F.col("q"))}).select(*by, F.col(pos).cast("long").alias("_pos"), "_k", "_s")
    long = F.when(F.length("_s") >= 12, F.col("_s"))
    nth = lambda d, *key: d.withColumn("_n", F.row_number().over(Window.partitionBy(*by, *key).orderBy("_pos")))
    could = nth(d, "_k", F.coalesce(long, F.col("_pos").cast("string"))).where("_n = 1")
    could = nth(could, "_k").where(F.col("_n") <= n)
    could = nth(could, F.coalesce(long, F.concat(F.lit("#"), F.col("_pos").cast("string")))).where(F.col("_n") <= n)
    could = nth(could).where(F.col("_n") <= n * (2 * n - 1)).withColumn("_fill", F.lit(False))
    # what fills up a list is among its first 2 n rows
    first = nth(d).where(F.col("_n") <= 2 * n).withColumn("_fill", F.lit(True))
    item = F.struct(F.col("_pos").alias("pos"), F.col("_k").alias("k"), F.col("_s").alias("s"))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("k"), none.alias("s"), F.array().cast("array<long>").alias("taken"))

    def step(a, x):
        seen = F.array_contains(a["k"], x["k"]) | (F.length(x["s"]) >= 12) & F.array_contains(a["s"], x["s"]) | (F.size(a["taken"]) >= n)
        more = F.struct(F.array_append(a["k"], x["k"]).alias("k"), F.array_append(a["s"], x["s"]).alias("s"), F.array_append(a["taken"], x["pos"].cast("long")).alias("taken"))
        return F.when(seen, a).otherwise(more)

    g = could.unionByName(first).groupBy(*by).agg(F.array_sort(F.collect_list(F.when(~F.col("_fill"), item))).alias("_items"), F.array_sort(F.collect_list(F.when(F.col("_fill"), F.col("_pos")))).alias("_first"))
    g = g.withColumn("_taken", F.aggregate("_items", start, step)["taken"])
    rest = F.array_except("_first", "_taken")
    return g.select(*by, F.posexplode(F.slice(F.concat("_taken", rest), 1, n)).alias("rank", pos))


#: Orders of the bank that users share by hash, and users that one group builds for.
CLASSES, GROUP_USERS = 16, 2_000


def build_papers(bank: DataFrame, users: DataFrame, counts: DataFrame, seed: int = 1) -> DataFrame:
    """user_id, exam_no, qid, type, diff, topic: an exam for each user by quotas and difficulty patterns.

    Each pick uses up its id and group and raises its topic's use, which the next pick
    minimises, then attempts, then a seeded order; so picks are made in order, a user at a time.

    Users don't meet the whole bank. The seeded order is one of CLASSES that users share,
    and of each type, difficulty and topic only the first groups are sent: before a pick
    come no more groups than were used by earlier picks or tried by the user, so with t
    questions tried the first t + PICKS groups are enough, and as many questions of each.
    Lists are cut at LEVELS, a user's own counts say at which; tried questions come from them.
    Users of a class who tried nothing have one exam, made once.

    Joins by user, question or group are sort-merge joins whatever the files' sizes say, as
    a compressed table of a few MB is more than the driver should build a hash table of.
    """
    kinds = dict(users.dtypes) | {"qid": dict(bank.dtypes)["id"]}
    b = bank.select(F.col("id").alias("qid"), "type", "diff", "topic", F.coalesce(F.nullif("grp", F.lit("")), F.col("id").cast("string")).alias("grp"))
    u = users.select("user_id").distinct().withColumn("_class", F.pmod(F.xxhash64(F.lit(seed), "user_id"), F.lit(CLASSES)).cast("int"))
    tie = lambda d: d.withColumn("tie", F.xxhash64(F.lit(seed), "_class", "qid"))
    tried = tie(counts.where("n > 0").hint("merge").join(b.hint("merge"), "qid").hint("merge").join(u.hint("merge"), "user_id")).select("user_id", "_class", "qid", "n", "type", "diff", "topic", "grp", "tie")
    busy = tried.groupBy("user_id", "_class").agg(_level(F.count("*") + PICKS).alias("_level"))
    found = busy.agg(F.count("*"), F.max("_level")).first()
    blocks, most = max(1, -(-found[0] // (CLASSES * GROUP_USERS))), found[1] or 0
    plain = next((n for n in LEVELS if n >= PICKS), LEVELS[-1])
    most = max(most, plain)
    busy = busy.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed + 1), "user_id"), F.lit(blocks)).cast("int"))

    # the first groups of a class and cell by the least tie of each; equal ties are all taken, as an order by id comes later
    cell = ["type", "diff", "topic"]
    least = b.groupBy(*cell, "grp").agg(*[F.min(F.xxhash64(F.lit(seed), F.lit(k), "qid")).alias(f"_{k}") for k in range(CLASSES)])
    least = least.select(*cell, "grp", F.posexplode(F.array(*[f"_{k}" for k in range(CLASSES)])).alias("_class", "_tie"))
    first = least.withColumn("_g", F.rank().over(Window.partitionBy("_class", *cell).orderBy("_tie"))).where(F.col("_g") <= most)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*cell, "grp")]
    l = tie(b.alias("a").hint("merge").join(first.alias("b").hint("merge"), same[0] & same[1] & same[2] & same[3]).select("a.*", "b._class", "b._g"))
    l = l.withColumn("_nth", F.row_number().over(Window.partitionBy("_class", *cell, "grp").orderBy("tie", "qid"))).where(F.col("_nth") <= most)
    asked = busy.select("_class", "_level", "_block").distinct()  # a row for each group
    none = users.sparkSession.range(CLASSES).select(F.col("id").cast("int").alias("_class"), F.lit(plain).alias("_level"), F.lit(-1).alias("_block"))
    l = l.join(F.broadcast(asked.unionByName(none)), "_class").where(F.greatest("_nth", "_g") <= F.col("_level"))

    def build(listed: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        cells, by_kind = {}, {}
        listed = listed.sort_values(["tie", "qid"])
        for kind, diff, topic, *item in zip(*[listed[c].tolist() for c in (*cell, "tie", "qid", "grp")]):
            cells.setdefault((kind, diff, topic), []).append(item)
        for k in cells:
            by_kind.setdefault(k[0], []).append(k)
        out = []
        own = own.sort_values(["user_id", "n", "tie", "qid"])
        for user, rows in groupby(zip(*[own[c].tolist() for c in ("user_id", *cell, "n", "tie", "qid", "grp")]), lambda r: r[0]):
            used, mine = set(), {}
            for _, kind, diff, topic, *item in rows:
                if not pd.isna(item[2]):  # a class's exam has a row without a question
                    used.add(item[2])
                    mine.setdefault((kind, diff, topic), []).append(item)
            kinds_of = {k: list(dict.fromkeys(by_kind.get(k, []) + [x for x in mine if x[0] == k])) for k, _, _ in SECTIONS}
            ids, groups, use, at, no = set(), set(), {}, {}, 0
            for kind, count, pattern in SECTIONS:
                for k in range(count):
                    best = None
                    for same in (True, False):
                        for c in kinds_of[kind]:
                            if same and c[1] != pattern[k % len(pattern)]:
                                continue
                            pos, items = at.get(c, 0), cells.get(c, [])
                            # what is used or tried stays so, so a place never moves back
                            while pos < len(items) and (items[pos][1] in used or items[pos][1] in ids or items[pos][2] in groups):
                                pos += 1
                            at[c] = pos
                            if pos < len(items):
                                found = (0, *items[pos])
                            else:
                                found = next((x for x in mine.get(c, []) if x[2] not in ids and x[3] not in groups), None)
                            if found:
                                rank = (use.get(c[2], 0), *found[:3])
                                if best is None or rank < best[0]:
                                    best = (rank, c, found)
                        if best:
                            break
                    if not best:
                        break
                    _, c, found = best
                    no += 1
                    ids.add(found[2])
                    groups.add(found[3])
                    use[c[2]] = use.get(c[2], 0) + 1
                    out.append((user, no, found[2], *c))
        return pd.DataFrame(out, columns=["user_id", "exam_no", "qid", "type", "diff", "topic"])

    on, schema = ["_class", "_level", "_block"], f"exam_no int, qid {kinds['qid']}, type string, diff int, topic string"
    own = tried.hint("merge").join(busy.drop("_class").hint("merge"), "user_id")
    listed = l.select(*[F.col(c).alias(c) for c in (*on, "qid", *cell, "grp", "tie")])
    exams = listed.where("_block >= 0").groupBy(*on).cogroup(own.groupBy(*on)).applyInPandas(build, f"user_id {kinds['user_id']}, {schema}")
    # who tried nothing: a class stands for its users
    empty = none.withColumn("user_id", F.col("_class")).withColumns({c: F.lit(None).cast(k) for c, k in tried.select("qid", "n", *cell, "grp", "tie").dtypes})
    of_class = listed.where("_block < 0").groupBy(*on).cogroup(empty.groupBy(*on)).applyInPandas(build, f"user_id int, {schema}").withColumnRenamed("user_id", "_class")
    rest = u.hint("merge").join(busy.select("user_id").hint("merge"), "user_id", "left_anti")
    # PICKS rows of each class at most
    return exams.unionByName(rest.join(F.broadcast(of_class), "_class").drop("_class").select(*exams.columns))


def rotated_group(groups: DataFrame, last: DataFrame, seed: int = 1) -> DataFrame:
    """A shared-stem group for each user, another than the last one's if there is another.

    Two neighbours in a seeded ring of groups are enough: a user takes the first, or the
    second if the first was the last one's.
    """
    n = groups.select("group_id").distinct().count()
    if not n:
        return last.select("user_id", F.lit(None).cast(dict(groups.dtypes)["group_id"]).alias("group_id")).where("false")
    ring = groups.select("group_id").distinct().withColumn("_at", F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), "group_id"), "group_id")) - 1)  # a dimension of stems
    want = last.select("user_id", "last_group", F.explode(F.array(F.lit(0), F.lit(1))).alias("_try")).withColumn("_at", F.pmod(F.xxhash64(F.lit(seed), "user_id") + F.col("_try"), F.lit(n)))
    j = want.join(ring, "_at").withColumn("_same", F.coalesce(F.col("group_id") == F.col("last_group"), F.lit(False)))
    return j.groupBy("user_id").agg(F.min_by("group_id", F.struct("_same", "_try")).alias("group_id"))
