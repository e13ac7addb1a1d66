"""A training corpus from ``documents``: quality, near-duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last return the columns of ``documents``.

Defined cases, by stage. Quality: null, empty and featureless texts get the share of good labels as their score and stay if
that reaches the threshold; without labels everything stays. Near-dedup: null and wordless texts are one group; of equal ids
the first row stays. Decontamination: null and wordless texts stay; an empty benchmark drops nothing. PII: null texts stay
null. SentencePiece: null and empty texts have no ids. Repeated rows and ties count as copies in near-dedup and are rows of
their own elsewhere; empty tables pass through; other columns stay as they are, whatever their names; long texts are
taken whole by every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orewright.llm import decontaminate, nearcopies, pieces, pii, quality
from orewright.llm.common import Scratch, drop_since, tables_made


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects; learns from this stage's documents that have a label."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard >= 0.8) stays: that with the smallest id."""
    return nearcopies.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by the name of its kind."""
    return pii.redact(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids of every text."""
    return pieces.encode_table(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("SentencePiece", sentencepiece_stage),
]

#: No stage but the third can be expressed in SQL; tests/llm/test_pipeline.py holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        first = tables_made()
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        before, docs = docs, scratch.save(out)
        scratch.drop(before)
        drop_since(spark, first, docs)
    return docs
