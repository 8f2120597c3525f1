"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents. All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, near_dedup, packing, quality_classifier, quality_rules
from tessera.session import materialize


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    A null, empty or short text is rejected by the base rule; repeated rows, null ids and
    very long texts are judged each by its own text; no rows give no rows."""
    return quality_rules.keep(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps.

    It learns from this stage's documents and the labels. Null texts, sources and languages
    are values of their own; repeated rows get one verdict; without labels of both kinds
    among the documents all stay; no rows give no rows."""
    return quality_classifier.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id.

    Of repeated rows, and of several texts of a group under the smallest id, one stays; a
    group without any id keeps one row; rows without words stay; no rows give no rows."""
    return near_dedup.deduplicate(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is the last source; rows without words are never taken; repeated rows get
    as many copies each; no rows give no rows."""
    return mixing.resample(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and offsets, one set for each copy of a document.

    A null or empty text is the end id alone; null ids stay; no rows give no rows."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

# The classifier, the signatures and the tokenizer are beyond SQL; every stage is tested on
# its own input, and the whole run, against plain versions (tests/llm/test_whole_pipeline.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
