"""Corpus pipeline: quality classifier, exact dedup, near duplicates, mixing, packing.

Each stage is (name, function of (spark, docs, sf_dir)); docs is what the stage before returned,
written and read again. All stages but the last return the columns of documents:

1. quality: documents that the line-labelling classifier rejects go. It learns from the labelled
   documents of sf_dir's tables that are in docs and not held out.
2. exact dedup: of equal texts (A-Z as a-z) the largest doc_id stays.
3. near duplicates: of documents linked by five-word shingles at a Jaccard similarity of 0.8, the
   smallest doc_id of each group stays.
4. mixing: 0.9 of the remaining tokens, by the target weights, at most one epoch of a source.
5. packing: windows of 4096 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from markgrid.llm import exact_dedup, mixing, ngram_join, packing, quality_crf
from markgrid.llm.shared import table, written

MIX_SHARE = 0.9


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = quality_crf.training_part(table(spark, sf_dir, "labels"))
    return quality_crf.keep_good(docs, quality_crf.learn(quality_crf.training_part(docs), labels))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.select_docs(docs, MIX_SHARE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", dedup),
    ("near duplicates", near_dedup),
    ("mixing", mix),
    ("packing", pack),
]
#: The classifier and the tokenizer have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
