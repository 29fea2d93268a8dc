"""The registered queries of the corpus operators, with production parameters on whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import ann, chaining, collocations, decontaminate, html, jaccard, language, mixing, packing, secrets, spelling, suffixes, toxicity
from .common import read

#: The vocabulary that op12 packs with; packing.packed() takes any byte-level one.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_suffix_dedup(spark, sf_dir):
    return suffixes.digest(suffixes.repeats(read(spark, sf_dir, "documents")))


def op2_decontaminate(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark")))


def op3_nearest(spark, sf_dir):
    return ann.nearest(read(spark, sf_dir, "embeddings"))


def op4_html(spark, sf_dir):
    found = html.extracted(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op5_secrets(spark, sf_dir):
    return secrets.digest(secrets.scanned(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_language(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    net = language.train(language.labelled_sample(docs))
    return language.digest(language.identified(docs.select("doc_id", "text"), net))


def op7_mixing(spark, sf_dir):
    return mixing.taken(read(spark, sf_dir, "documents")).drop("source")


def op8_jaccard(spark, sf_dir):
    return jaccard.classes(read(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(toxicity.labelled_sample(docs, read(spark, sf_dir, "labels")))
    return toxicity.digest(toxicity.scored(docs, model))


def op10_chaining(spark, sf_dir):
    return chaining.passages(read(spark, sf_dir, "documents"))


def op11_spelling(spark, sf_dir):
    return spelling.variants(read(spark, sf_dir, "documents"))


def op12_packing(spark, sf_dir):
    return packing.digest(packing.packed(read(spark, sf_dir, "documents"), TOKENIZER, keep_ids=False))


def op13_collocations(spark, sf_dir):
    return collocations.collocations(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_decontaminate, op3_nearest, op4_html, op5_secrets, op6_language, op7_mixing, op8_jaccard, op9_toxicity, op10_chaining, op11_spelling, op12_packing, op13_collocations)}
