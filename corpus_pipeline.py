"""From documents to a mixed training corpus: five stages, each written as Parquet and read again by the next one.

Stage functions take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of ``documents``. Tables beside ``docs`` are read from
``sf_dir``. ``run`` applies all of them to the table documents.

Defined cases, in every stage: a null text counts as empty; rows are told apart by doc_id and text, so null and repeated ids do no harm, and rows that are equal in both are treated
alike; long texts are read whole; of ties the smaller doc_id (null last) stays; an empty table gives an empty table; columns beyond those of documents pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.llm import decontamination, jaccard_join, language_id, line_dedup, mixing
from timeloom.llm.common import stage, table

#: A language is trusted from this score on. The score of a text in a language like no other known is 1 / (number of languages).
LEAST_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no language that the filter knows, go. lang becomes the language found."""
    model = language_id.learn(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.identify(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return found.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go but for the first; a document that had none but such goes."""
    done = line_dedup.dedup_lines(docs).where(~F.col("emptied"))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents one stays."""
    return jaccard_join.keep_one(docs).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is kept at least once; small sources are repeated, up to four times."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: Language models and alignments have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
