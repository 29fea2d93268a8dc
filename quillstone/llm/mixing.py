"""Mixing sources to target weights, with DataFrame functions only.

Every source's words form one stream (documents by md5 of their id, then id and
size), packed into blocks of BLOCK words; a document may span blocks and a block
documents. Weights 5, 2, 1, repeating over the sources by code point (null last),
share `factor` times all words; a target stops at `most` times its source's size,
and the excess goes to the others by weight (a water level, found in closed form).

The output is dealt to shards of SLOTS slots. Each shard draws its sources'
counts: a multinomial draw by one hashed uniform a slot. Draws beyond a source's
quota of slots go to sources that fell short, so the totals meet the targets to
within a block. A source's j-th slot takes block P(j mod blocks) of epoch
j div blocks, P a pseudorandom permutation of the source and epoch; slots and
blocks are joined by that index. No block is taken more than `most` times.

Prefix sums run within (source, md5 prefix), or within ranges of shards, and then over
their totals, so neither a source with a third of all rows nor the shards of the whole
output are a single task. Null texts have 0 words and
nothing taken; repeated rows are streamed each (ties of md5 by id and size); other
columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, written

BLOCK = 128
SLOTS = 4096
WEIGHTS = (5, 2, 1)
FACTOR, MOST = 1.5, 2
SEED = 17
CELLS = 4096
ROWS_PER_PREFIX = 2_000
#: Slots drawn by a task at most, and at least where there are tasks enough; shards of a range of prefix sums; numbers that are spread at once.
DRAWS, LEAST_DRAWS, RANGE, RUN = 1_000_000, 50_000, 4_096, 65_536
WORD = r"[^\x20\x09-\x0D]+"
#: Primes above 2**20: below 2**40 blocks, no number has both as factors.
PRIMES = (1_048_583, 2_097_169)


def shares(sized: DataFrame, source: str = "source") -> DataFrame:
    """source, source_size, rank, target, blocks, quota (slots): a row for each source."""
    by_code_point = Window.orderBy(F.col(source).asc_nulls_last())
    by_ratio = Window.orderBy("_ratio", "rank")
    t = sized.groupBy(source).agg(F.sum("size").alias("source_size"))
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    t = t.withColumn("rank", F.row_number().over(by_code_point).cast("long") - 1)
    t = t.withColumn("_weight", F.element_at(weights, (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    t = t.withColumn("_ratio", MOST * F.col("source_size") / F.col("_weight"))
    before = F.coalesce(F.sum(MOST * F.col("source_size")).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("_weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    whole = F.sum("source_size").over(Window.partitionBy())
    t = t.withColumn("_level", (F.lit(FACTOR) * whole - before) / onward).withColumn("_nth", F.row_number().over(by_ratio))
    level = F.min_by("_level", F.when(F.col("_level") <= F.col("_ratio"), F.col("_nth"))).over(Window.partitionBy())
    t = t.withColumn("target", F.least((MOST * F.col("source_size")).cast("double"), F.col("_weight") * level))
    t = t.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK))
    quota = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5), MOST * F.col("blocks"))).otherwise(0)
    return t.withColumn("quota", quota.cast("long")).select(source, "source_size", "rank", "target", "blocks", "quota")


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"))


def streamed(docs: DataFrame, table: DataFrame, doc_id: str = "doc_id", source: str = "source", prefix: int = 1) -> DataFrame:
    """docs (with size) and their source's shares and `start`, the words before it in its source's stream."""
    t = table.withColumnRenamed(source, "_source")
    d = docs.join(t, docs[source].eqNullSafe(t["_source"])).drop("_source")
    d = d.withColumn("_key", F.coalesce(F.md5(F.col(doc_id).cast("string").cast("binary")), F.lit("")))
    d = d.withColumn("_prefix", F.substring("_key", 1, prefix))
    inside = Window.partitionBy("rank", "_prefix").orderBy("_key", doc_id, "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    totals = d.groupBy("rank", "_prefix").agg(F.sum("size").alias("_sum"))
    over = Window.partitionBy("rank").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_sum").over(over), F.lit(0))).drop("_sum")
    return d.join(totals, ["rank", "_prefix"]).withColumn("start", F.col("_base") + F.col("_inside")).drop("_key", "_prefix", "_inside", "_base")


def _coprime(n: Column) -> Column:
    return F.when(n % PRIMES[0] != 0, PRIMES[0]).otherwise(PRIMES[1])


def permuted(df: DataFrame, x: Column, n: Column, key: Column) -> DataFrame:
    """df and `block`, a pseudorandom permutation of 0..n-1 at x for each key: affine maps of the whole, affine maps of a part and reversals in turn, each a bijection."""
    m = F.greatest(F.lit(1), F.floor(n * 5 / 8).cast("long"))
    df = df.withColumns({"block": x, "_size": n, "_key": key * 7919, "_part": m, "_by": _coprime(n), "_by_part": _coprime(m)})
    b, size, part, by, by_part = (F.col(c) for c in ("block", "_size", "_part", "_by", "_by_part"))
    for salt in (SEED * 1009, SEED * 2003):
        # a projection for each step: nested, the expression would double at each
        df = df.withColumn("block", (b * by + F.col("_key") + salt) % size)
        df = df.withColumn("block", F.when(b < part, (b * by_part + F.col("_key") + salt) % part).otherwise(b))
        df = df.withColumn("block", size - 1 - b)
    return df.drop("_size", "_key", "_part", "_by", "_by_part")


def _before(counts: DataFrame, by: list[str], at: str, n: str, name: str) -> DataFrame:
    """counts and `name`, the sum of n in rows of the same `by` (none: all) with a smaller `at`: within ranges of RANGE values, and then over the ranges' totals."""
    d = counts.withColumn("_range", F.floor(F.col(at) / RANGE))
    inside = Window.partitionBy(*by, "_range").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_inside", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    totals = counts.groupBy(*by, F.floor(F.col(at) / RANGE).alias("_range")).agg(F.sum(n).alias("_sum"))
    # a row for every RANGE shards of SLOTS slots of BLOCK words: 2**31 words
    over = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_under", F.coalesce(F.sum("_sum").over(over), F.lit(0))).drop("_sum")
    return d.join(totals, [*by, "_range"]).withColumn(name, F.col("_under") + F.col("_inside")).drop("_range", "_inside", "_under")


def _tasks(df: DataFrame, total: int) -> int:
    """Tasks for rows that are spread to `total`: DRAWS each, but as many as run at once where that leaves each enough."""
    return max(1, -(-total // DRAWS), min(df.sparkSession.sparkContext.defaultParallelism, -(-total // LEAST_DRAWS)))


def _numbered(df: DataFrame, first: str, n: str, name: str, tasks: int) -> DataFrame:
    """A row for each number from `first` on, n of them: in runs of RUN numbers that are dealt to so many tasks before they are spread."""
    runs = df.where(F.col(n) > 0).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / RUN))))
    runs = runs.withColumn("_from", F.col(first) + F.col("_run") * RUN).withColumn("_to", F.least(F.col("_from") + RUN, F.col(first) + F.col(n)) - 1)
    return runs.repartition(tasks, F.col("_from"), F.col("_run")).withColumn(name, F.explode(F.sequence("_from", "_to"))).drop("_run", "_from", "_to")


def slots(table: DataFrame) -> DataFrame:
    """out_shard, rank, block, epoch: a row for each slot of the output."""
    spark = table.sparkSession
    total = table.agg(F.sum("quota")).first()[0] or 0
    mine = table.where("quota > 0").select("rank", "quota", "blocks")
    upto = F.sum("quota").over(Window.orderBy("rank"))  # a row for each source
    bounds = mine.withColumn("_hi", upto / F.lit(float(max(total, 1)))).withColumn("_lo", (upto - F.col("quota")) / F.lit(float(max(total, 1))))
    bounds = bounds.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") * CELLS), F.least(F.floor(F.col("_hi") * CELLS), F.lit(CELLS - 1)))))
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "id"), 11) / F.lit(float(2**53))
    tasks = _tasks(table, total)
    drawn = spark.range(0, total, 1, tasks).select(F.floor(F.col("id") / SLOTS).alias("out_shard"), hashed.alias("_u"))
    drawn = drawn.withColumn("_cell", F.floor(F.col("_u") * CELLS)).join(bounds, "_cell").where("_u >= _lo and _u < _hi")
    counts = cut(drawn.groupBy("out_shard", "rank").agg(F.count("*").alias("_n")))
    counts = _before(counts, ["rank"], "out_shard", "_n", "_base").join(mine, "rank")
    kept = counts.withColumn("_n_kept", F.greatest(F.lit(0), F.least(F.col("_n"), F.col("quota") - F.col("_base"))))
    taken = _numbered(kept, "_base", "_n_kept", "_j", tasks).select("out_shard", "rank", "blocks", "_j")
    # draws beyond a quota, numbered over the shards, meet the missing slots of the other sources, numbered over the sources
    over_quota = kept.groupBy("out_shard").agg(F.sum(F.col("_n") - F.col("_n_kept")).alias("_e")).where("_e > 0")
    over_quota = _numbered(_before(over_quota, [], "out_shard", "_e", "_first"), "_first", "_e", "_k", tasks).select("out_shard", "_k")
    short = mine.join(counts.groupBy("rank").agg(F.sum("_n").alias("_drawn")), "rank", "left").withColumn("_drawn", F.coalesce("_drawn", F.lit(0)))
    short = short.withColumn("_e", F.col("quota") - F.col("_drawn")).where("_e > 0")
    short = short.withColumn("_first", F.sum("_e").over(Window.orderBy("rank")) - F.col("_e"))  # a row for each source
    short = _numbered(short, "_first", "_e", "_k", tasks).select("rank", "blocks", (F.col("_drawn") + F.col("_k") - F.col("_first")).alias("_j"), "_k")
    filled = short.join(over_quota, "_k", "left").select(F.coalesce("out_shard", F.lit(0)).alias("out_shard"), "rank", "blocks", "_j")
    out = taken.unionByName(filled).withColumn("epoch", F.floor(F.col("_j") / F.col("blocks")))
    out = permuted(out, F.col("_j") % F.col("blocks"), F.col("blocks"), F.col("rank") * MOST + F.col("epoch"))
    return out.select("out_shard", "rank", "block", "epoch")


def pieces(stream: DataFrame) -> DataFrame:
    """rank, block, start, n_words: the part of each document in each block it touches; (rank, start) names the document."""
    t = stream.where("size > 0").select("rank", "start", "size")
    first, last = F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
    t = t.withColumn("block", F.explode(F.sequence(first, last)))
    inside = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK) - F.greatest(F.col("start"), F.col("block") * BLOCK)
    return t.select("rank", "block", "start", inside.alias("n_words"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, slots, pieces): doc_id, source, size, its source's shares and start; the output's slots; the documents' pieces by block.

    Words are counted first and kept in the shared folder (three numbers a document), so texts are read once and never shuffled.
    The streams are kept too: as one query with what reads them, their shuffles would all be the driver's to plan and track at once.
    """
    d = written(sized(docs.select(doc_id, source, text), text).select(doc_id, source, "size"), "sizes")
    prefix, rows = 1, d.count()
    while 16**prefix * ROWS_PER_PREFIX < rows:
        prefix += 1
    table = cut(shares(d, source))
    stream = written(streamed(d, table, doc_id, source, prefix), "streams")
    discard(d)
    return stream, slots(table), pieces(stream)


def blocks_of(chosen: DataFrame, parts: DataFrame) -> DataFrame:
    """out_shard, rank, block, epoch, start, n_words: the mix itself, each chosen block with the documents' pieces in it."""
    return chosen.join(parts, ["rank", "block"])


def taken(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words that the mix takes of it, repeats counted): a row for each document."""
    stream, chosen, parts = mixed(docs, doc_id, source, text)
    copies = written(chosen.groupBy("rank", "block").agg(F.count("*").alias("_copies")), "copies")
    sums = parts.join(copies, ["rank", "block"]).groupBy("rank", "start").agg(F.sum(F.col("n_words") * F.col("_copies")).alias("_taken"))
    sums = sums.select(F.col("rank").alias("_rank"), F.col("start").alias("_start"), "_taken")
    out = stream.join(sums, (stream["rank"] == sums["_rank"]) & (stream["start"] == sums["_start"]) & (stream["size"] > 0), "left")
    return out.select(doc_id, source, "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))
