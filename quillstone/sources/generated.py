"""Generated questions: 28 closed-form families, 10 rows each, from a range and column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import fraction

ROWS = 10


def _pick(values: list, k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))


def families() -> list[tuple[str, str, int, int, Column]]:
    """(topic, family, difficulty, target seconds, answer as text) by the row number i."""
    i = F.col("i")
    n = lambda c: c.cast("long").cast("string")
    power = lambda b, e: F.floor(F.pow(b, e) + 0.5).cast("long")
    m = F.when((i % 5) == 2, 3).otherwise(i % 5 - 2)
    a, b, c, t = i % 3 + 1, i - 5, 2 * i - 3, i % 5 - 2
    red, total = i + 3, i + 3 + i % 4 + 2
    g, ratio, gn = i % 3 + 1, i % 2 + 2, i % 4 + 3
    triples, scale = [(3, 5), (5, 13), (8, 17), (7, 25), (9, 15)], F.floor(i / 5) + 1
    special = ["1/2", "√2/2", "√3/2", "1/2", "-1/2"]
    return [
        ("num", "abs", 1, 55, n(2 * (i + 3) - 1)),
        ("num", "symmetric", 2, 100, n(power(i + 3, F.lit(3)) - 3 * (i + 3))),
        ("line", "slope", 1, 55, n(m)),
        ("line", "distance", 2, 90, n(i + 1)),
        ("poly", "remainder", 1, 70, n(a * t * t + b * t + c)),
        ("poly", "vertex", 2, 85, n(i - 4)),
        ("seq", "arithmetic", 1, 60, n((i + 1) + (i + 4) * (i % 4 + 1))),
        ("seq", "geometric-sum", 2, 100, n(g * (power(ratio, gn) - 1) / (ratio - 1))),
        ("comb", "choose-two", 1, 55, n((i + 5) * (i + 4) / 2)),
        ("comb", "perm-three", 2, 70, n((i + 5) * (i + 4) * (i + 3))),
        ("prob", "at-least-one", 1, 65, fraction(power(F.lit(2), i + 2) - 1, power(F.lit(2), i + 2))),
        ("prob", "without-replace", 2, 95, fraction(red * (red - 1), total * (total - 1))),
        ("data", "mean", 1, 50, n(3 * i + 10)),
        ("data", "z-score", 2, 70, n(i % 5 - 2)),
        ("trig1", "right-sin", 1, 55, fraction(_pick([x[0] for x in triples], i % 5) * scale, _pick([x[1] for x in triples], i % 5) * scale)),
        ("trig1", "area", 2, 75, n((i + 2) * (i + 3))),
        ("trig2", "special", 1, 45, _pick(special, i % 5)),
        ("trig2", "maximum", 1, 55, n((i + 2) + (i - 3))),
        ("exp", "log-power", 1, 45, n(i + 2)),
        ("exp", "growth", 2, 70, n((i + 2) * power(i % 3 + 2, i % 4 + 2))),
        ("vec", "dot", 1, 55, n((i + 1) * (i % 4 - 1) + (i - 3) * (i % 5 + 1))),
        ("vec", "perpendicular", 2, 80, n(-(i % 4 + 1) * (i + 1))),
        ("svec", "dot", 1, 65, n((i + 1) * (i % 3 - 1) + (i - 2) * 2 + (i % 4 + 1) * (3 - i))),
        ("svec", "norm-square", 1, 60, n((i + 1) * (i + 1) + (i % 5 + 2) * (i % 5 + 2) + (i % 3 + 3) * (i % 3 + 3))),
        ("splane", "distance", 2, 115, n(i + 1)),
        ("splane", "line-plane", 2, 120, n(i + 1)),
        ("mat", "det", 1, 55, n((i + 1) * (i + 3) - (i % 4 + 1) * (i % 3 + 1))),
        ("mat", "product", 2, 85, n((i + 1) * (i % 5 + 1) + (i % 4 + 1) * (i % 4 - 1))),
    ]


def questions(spark: SparkSession) -> DataFrame:
    """id, grp, topic, type, diff, target, ans_txt, rev of the 280 generated questions."""
    every, i = families(), F.col("i")
    arms = F.array(*[F.struct(F.lit(t).alias("topic"), F.lit(f).alias("family"), F.lit(d).alias("diff"), F.lit(s).alias("target"), ans.alias("ans")) for t, f, d, s, ans in every])
    rows = spark.range(ROWS).select(F.col("id").cast("int").alias("i")).select("i", F.explode(arms).alias("f")).select("i", "f.*")
    name = F.concat_ws("-", F.lit("core"), "topic", "family")
    return rows.select(F.concat_ws("-", name, (i + 1).cast("string")).alias("id"), name.alias("grp"), "topic", F.lit("fill").alias("type"), "diff", "target", F.array("ans").alias("ans_txt"), F.lit(1).cast("long").alias("rev"))


def duplicate_ids(questions_: DataFrame) -> DataFrame:
    return questions_.groupBy("id").count().where("count > 1")
