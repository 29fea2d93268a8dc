"""The corpus pipeline: language ID, near duplicates, decontamination, secret scan, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet
in the shared folder and read again as the next stage's docs. All but the last
return the columns of documents. An empty table passes through as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import decontaminate, jaccard, language, mixing, secrets
from quillstone.llm.common import read, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose best language is less likely than this is rejected.
LEAST_SCORE = 0.3


def _as_documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars that of the text as it is now."""
    return df.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known, and writes it where none is given; null texts and texts without letters go."""
    net = language.train(language.labelled_sample(docs))
    found = language.identified(docs.select(*COLUMNS), net)
    return found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SCORE)).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least id of each class of near duplicates, one row of it; rows without an id stay."""
    docs = docs.select(*COLUMNS)
    kept = jaccard.classes(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id").select(*COLUMNS).dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages from texts."""
    found = decontaminate.contaminated(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))
    return _as_documents(decontaminate.without_hits(found))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets with a mark."""
    return _as_documents(secrets.redacted(secrets.scanned(docs.select(*COLUMNS))))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken."""
    return mixing.taken(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("mixing_sources", mixing_sources),
]

#: Learned stages have no SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
