"""Numbers and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm

NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)"
#: Seconds by difficulty, points by difficulty, grade bands, request weights and limits.
TARGET_SECONDS = {1: 75, 2: 150, 3: 240}
POINTS = {1: 1, 2: 2, 3: 4}
GRADES = [(0.84, "15 級分"), (0.78, "14 級分"), (0.72, "13 級分"), (0.66, "12 級分"), (0.60, "11 級分"), (0.54, "10 級分"), (0.48, "9 級分"), (0.0, "8 級分以下")]
REQUEST_WEIGHTS = {"paper_grade": 12, "paper_detail": 5, "outline": 3, "grade": 2, "process": 2, "concept": 2, "text": 1, "test": 1}
GOAL_ACCURACY, DAY_GOAL = 0.72, 30


def parse_number(c: Column) -> Column:
    """`a/b` or a decimal as double; null for anything else and for a zero denominator."""
    s = norm(c)
    part = lambda k: F.regexp_extract(s, rf"^({NUMBER})/({NUMBER})$", k).try_cast("double")
    whole = F.when(s.rlike(rf"^{NUMBER}$"), s.try_cast("double"))
    return F.when(s.rlike(rf"^{NUMBER}/{NUMBER}$"), F.try_divide(part(1), part(2))).otherwise(whole)


def fill_correct(answer: Column, accepted: Column) -> Column:
    """Whether a filled-in answer equals an accepted one: as text, as an unordered list if no form has brackets, or as a number."""
    said = norm(answer)
    exact = F.exists(accepted, lambda a: norm(a) == said)
    bare = lambda c: ~norm(c).rlike(r"[()]")
    key = lambda c: F.array_sort(F.transform(F.filter(F.split(norm(c), ","), lambda t: t != ""), lambda t: F.coalesce(parse_number(t).cast("string"), t)))
    lists = said.contains(",") & bare(answer) & F.forall(accepted, bare) & F.exists(accepted, lambda a: norm(a).contains(",") & (key(a) == key(answer)))
    value = parse_number(answer)
    number = value.isNotNull() & F.exists(accepted, lambda a: F.coalesce(F.abs(parse_number(a) - value) < 1e-9, F.lit(False)))
    return F.coalesce(exact | lists | number, F.lit(False))


def option_errors(chosen: Column, correct: Column, options: Column) -> Column:
    """Options ticked wrongly or missed, of those that exist."""
    off = F.array_union(F.array_except(chosen, correct), F.array_except(correct, chosen))
    return F.size(F.array_intersect(off, options))


def multi_points(points: Column, chosen: Column, correct: Column, options: Column) -> Column:
    """Full, 3/5 and 1/5 of the points for 0, 1 and 2 errors, else 0; nothing for a blank."""
    chosen = F.coalesce(chosen, F.array().cast("array<int>"))
    errors = option_errors(chosen, F.coalesce(correct, F.array().cast("array<int>")), options)
    return F.when(F.size(chosen) == 0, 0.0).when(errors == 0, points * 1.0).when(errors == 1, points * 0.6).when(errors == 2, points * 0.2).otherwise(0.0)


def round2(c: Column) -> Column:
    """Half up at the second decimal."""
    return F.floor(c * 100 + 0.5) / 100


def wilson(ok: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a rate; 0 and 1 for n = 0."""
    p, z2 = F.try_divide(ok.cast("double"), n.cast("double")), z * z
    den = 1 + F.try_divide(F.lit(z2), n.cast("double"))
    mid = (p + F.try_divide(F.lit(z2), 2 * n.cast("double"))) / den
    half = z * F.sqrt(F.try_divide(p * (1 - p) + F.try_divide(F.lit(z2), 4 * n.cast("double")), n.cast("double"))) / den
    return F.coalesce(F.greatest(F.lit(0.0), mid - half), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), mid + half), F.lit(1.0))


def grade(accuracy: Column) -> Column:
    """The first band whose least accuracy is reached; null for null and negative."""
    said = F.when(F.isnan(accuracy.cast("double")), None)
    for least, name in GRADES:
        said = said.when(accuracy >= least, name)
    return said


def by_difficulty(diff: Column, table: dict[int, int], default: int | None = None) -> Column:
    found = F.when(F.lit(False), None)
    for k, v in table.items():
        found = found.when(diff == k, v)
    return found.otherwise(default)


def target_ms(target: Column, diff: Column) -> Column:
    return F.coalesce(F.nullif(target, F.lit(0)), by_difficulty(diff, TARGET_SECONDS)) * 1000


def answer_result(kind: Column, chosen: Column, text: Column, verdict: Column, correct: Column, accepted: Column, points: Column, options: Column) -> Column:
    """struct(ok, points): by type; a written answer by its verdict."""
    single = (F.size(chosen) == 1) & (F.get(chosen, F.lit(0)) == F.get(correct, F.lit(0)))
    multi = multi_points(points, chosen, correct, options)
    fill = fill_correct(text, accepted)
    ok = F.when(kind == "single", single).when(kind == "multi", multi == points).when(kind == "fill", fill).otherwise(F.coalesce(verdict, F.lit(False)))
    got = F.when(kind == "multi", multi).otherwise(F.when(ok, points * 1.0).otherwise(0.0))
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), round2(got).alias("points"))


def stuck_labels(hesitations: Column, ms: Column) -> Column:
    """The first three pauses of 20 s or more, as start, middle or end of the work (array of [second, length] in)."""
    total = F.greatest(F.lit(1), F.floor(ms / 1000 + 0.5))
    kind = lambda h: F.when(h[0] / total < 0.25, "start").when(h[0] / total > 0.75, "end").otherwise("middle")
    return F.transform(F.slice(F.filter(hesitations, lambda h: h[1] >= 20), 1, 3), lambda h: F.struct(h[0].alias("at"), h[1].alias("dur"), kind(h).alias("kind")))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy))), F.lit(0.0))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def grid_cell(c: Column, cells: int = 40) -> Column:
    """The cell of a coordinate in 0..1."""
    return F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor(c * cells))).cast("int")


def time_left(base_ms: Column, resumed: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), base_ms - F.coalesce(now - resumed, F.lit(0)))


def strict_true(c: Column) -> Column:
    """true, 1 or the text `true`; anything else isn't."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1"), F.lit(False))


def backoff_ms(fails: Column) -> Column:
    return F.least(F.lit(30_000), 1200 * F.pow(F.lit(2), F.least(F.lit(5), F.greatest(F.lit(0), fails - 1)))).cast("long")


def request_weight(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in REQUEST_WEIGHTS.items() for x in kv]), kind), F.lit(1))


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor, by a bounded Euclid (enough for 64 bits)."""
    pair = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.coalesce(F.try_mod(s["a"], s["b"]), F.lit(0).cast("long")).alias("b")))
    return F.greatest(F.lit(1), F.aggregate(F.sequence(F.lit(1), F.lit(92)), pair, step)["a"])


def fraction(n: Column, d: Column) -> Column:
    """A reduced fraction as text."""
    g = gcd(n, d)
    top, low = F.floor(n / g).cast("long"), F.floor(d / g).cast("long")
    return F.when(low == 1, top.cast("string")).otherwise(F.concat_ws("/", top, low))


def stars(diff: Column) -> Column:
    n = clamp(F.coalesce(diff, F.lit(0)), 0, 3).cast("int")
    return F.concat(F.repeat(F.lit("★"), n), F.repeat(F.lit("☆"), 3 - n))
