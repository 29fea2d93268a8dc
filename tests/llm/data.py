"""Small seeded corpora for the corpus operators."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def corpus(seed=1, n=60):
    """Texts with exact and near copies, shared passages, nulls, empty and one-word texts, repeated rows and one long text."""
    rng = random.Random(seed)
    base = [words(rng, rng.randint(1, 200)) for _ in range(n)]
    passage = words(rng, 90)
    out = list(base)
    for k in range(10):
        t = base[k].split()
        for _ in range(max(1, len(t) // 40)):
            t[rng.randrange(len(t))] = "zz" + str(k)
        out.append(" ".join(t))
    out += [base[3], base[3], base[4].upper(), passage, base[5] + " " + passage, base[6] + "\n" + passage + " end", "", None, "solo", "solo", "a" * 1500, words(rng, 4000), "é" * 900 + " ü", "\x00 x \x00"]
    return [(k, t, "en" if k % 3 else "de", None if k % 7 == 0 else f"s{k % 4}", len(t or "")) for k, t in enumerate(out)] + [(3, base[3], "en", "s3", 1)]


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        names = ["n_words", "hit_spans", "lang_pred", "toxicity", "secret_spans", "size", "target", "rank", "start", "key", "label", "main_text", "th", "removed", "bucket"]
        df = df.withColumns({c: F.lit("x") for c in names})
    return df
