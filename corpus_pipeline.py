"""The corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, sampled SentencePiece segmentations.

Each stage takes the rows that its predecessor kept and returns a DataFrame; all but the last return the columns of ``documents``.
An empty table stays empty in every stage, and columns beyond those of ``documents`` are kept whatever their names, but by the
last stage.  ``run`` applies the stages to ``documents``; callers that write each stage's rows as Parquet and reread them get the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webloom.llm import decontam, gumbel, linedup, neardup, rules


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy keeps; null and empty texts go, repeated rows are judged each."""
    return rules.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier one has; those left with less than a fifth of their words go.

    Repeated rows are one document and none loses anything to the other; null and empty texts stay.
    """
    return linedup.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity 0.8 or more): that with the least doc_id.

    Of repeated rows one stays; texts without words, null ones too, all stay.
    """
    return neardup.drop_duplicates(docs, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that occur in benchmark items; those that are mostly benchmark text go.

    Null and empty texts stay; repeated rows are treated alike.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations with the decoded text, of repeated rows the same ones each; null and empty texts have one without pieces."""
    return gumbel.encode(docs, gumbel.VOCABULARY)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("sentencepiece", sentencepiece)]
#: Patience alignment and seeded sampling cannot be said in SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
