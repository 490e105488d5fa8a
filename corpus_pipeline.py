"""Corpus pipeline: reject poor documents, drop repeated lines, keep one of each group of near copies, pack into windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celstack.llm import line_dedup, ngram_join, packing, quality
from celstack.llm.common import table
from celstack.session import cut


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, does not reject."""
    return quality.keep_accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least ten of them share; ``n_chars`` follows the text."""
    done = line_dedup.dedupe_lines(docs, min_docs=10, min_points=1)
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by five-word shingles at a similarity of 0.8."""
    return ngram_join.one_of_each(docs, size=5, num=80, den=100)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in windows of 1024 tokens."""
    return packing.pack(docs, capacity=1024)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("packing", packing_stage),
]

#: The classifier is a trained model and the windows depend on a tokenizer: SQL can express neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written as Parquet and reread as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
