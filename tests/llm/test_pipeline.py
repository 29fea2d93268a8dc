import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from .data import corpus, frame
from .test_dedup import brute_classes


def test_stages(spark, tmp_path):
    rows = corpus(seed=9)
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    w = rows[12][1].split()
    spark.createDataFrame([(1, " ".join(w[:20]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == corpus_pipeline.COLUMNS, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
    assert sizes[0] == sum(any(c.isalpha() for c in t or "") for _, t, *_ in rows) and sizes[1] < sizes[0] and sizes[1] == sizes[2] == sizes[3]
    assert docs.where(F.lower("text").contains(" ".join(w[:20]).lower())).count() == 0
    done = corpus_pipeline.run(spark, d)
    assert done.count() == sizes[-1] and done.where("taken > 2 * size").count() == 0


def test_empty(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_stages_against_brute_force(spark, tmp_path):
    """Rows with clashing columns, an id with two texts and rows without an id beside the usual odd ones."""
    rows = corpus(seed=21)
    rows += [(900, "tell password: hunter22x now", "en", "s1", 1), (901, rows[20][1], "en", "s1", 1), (7, "another text of one id " + rows[30][1], "en", "s1", 1), (None, "a text without an id " + rows[31][1], "en", "s2", 1)]
    d = str(tmp_path)
    w = WORD.findall(rows[12][1])
    spark.createDataFrame([(1, " ".join(w[:20])), (2, "short item")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, df: stages[name](spark, df, d)
    docs = frame(spark, rows, extra=True)

    kept = run("language_id", docs)
    assert kept.columns == corpus_pipeline.COLUMNS
    said = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert Counter(said) == Counter((i, t) for i, t, *_ in rows if any(c.isalpha() for c in t or ""))
    assert all(r["lang"] for r in kept.collect())

    near = run("near_duplicates", kept)
    # an id with several texts counts as each of them
    known = [(i, t, None, None, None) for i, t in said if i is not None]
    least = {}
    for i, n, c in brute_classes(known):
        least.setdefault(i, set()).add(c)
    want = {(i, t) for i, t in said if i is None or i in least[i]}
    assert Counter((r["doc_id"], r["text"]) for r in near.collect()) == Counter(want)

    windows = {tuple(lowered(x) for x in w[k : k + 10]) for k in range(11)} | {("short", "item")}
    clean = run("benchmark_decontamination", near)
    got = {(r["doc_id"], tuple(WORD.findall(lowered(r["text"])))) for r in clean.collect()}
    want = set()
    for r in near.collect():
        said, gone = WORD.findall(lowered(r["text"])), set()
        for k in range(len(said)):
            for n in (10, 2):
                if tuple(said[k : k + n]) in windows:
                    gone |= set(range(k, k + n))
        want.add((r["doc_id"], tuple(x for k, x in enumerate(said) if k not in gone)))
    assert got == want

    safe = {(r["doc_id"], r["text"]) for r in run("secret_scan", clean).collect()}
    base = [r"(?i:password|passwd|secret|token|api_?key)[\"\']?\x20*[:=]\x20*[\"\']?[A-Za-z0-9+/_.=-]{6,}", r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"]
    assert safe == {(r["doc_id"], re.sub("|".join(base), "[secret]", r["text"])) for r in clean.collect()}

    mix = run("mixing_sources", clean).collect()
    size = Counter()
    for r in mix:
        size[r["source"]] += r["size"]
    assert len(mix) == clean.count()
    for s in size:
        mine = [r for r in mix if r["source"] == s]
        assert all(r["source_size"] == size[s] and r["taken"] <= 2 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 2 * 128
