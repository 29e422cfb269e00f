"""The corpus pipeline: five operators in a row, each on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillwork.llm import decontaminate, jaccard_join, line_templates, mixing, toxicity
from rillwork.llm.common import stow

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), by_row=True).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring template lines go; a document that has lost all its words to them goes with them.

    ``n_chars`` is that of the text that is left.
    """
    left = line_templates.dedupe_lines(docs)
    kept = left.where("n_dropped = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return kept.selectExpr("doc_id", "text", "lang", "source", "if(n_dropped > 0, cast(char_length(text) as bigint), n_chars) as n_chars")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return jaccard_join.keep_first(docs, by_row=True).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), by_row=True).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at the target weights: documents once per epoch, with the words to take of each."""
    return mixing.mixture(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard", drop_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]

#: The nearest-example vote and the SimHash search are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stow(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
