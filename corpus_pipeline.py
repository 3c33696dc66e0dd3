"""Training-data preparation: documents are filtered, deduplicated, cleaned of secrets and packed, stage by stage.

Each stage takes all that its predecessor kept, is written as Parquet and read again as the next one's input.

Null texts are empty: the classifiers score them like any text, they are near copies of each other, and packing gives them
their end id.  Texts of any length are taken whole.  Rows that repeat id and text are one from the near-duplicate stage on;
those that repeat only one of the two are judged by their texts.  Rows without an id pass the near-duplicate stage.  Ties are
those of the operators.  Columns besides the documents' own stay as they are up to the last stage, whatever their names.  An
empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seaward.llm import packing, quality, secrets, simhash, toxicity
from seaward.llm.common import materialize, read_table, small_batches


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose Bradley-Terry score reaches the cut."""
    small_batches(spark)
    return quality.keep_good(docs, quality.fit(docs, quality.training_labels(spark, sf_dir)))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without significant toxic passages."""
    small_batches(spark)
    return toxicity.reject_toxic(docs, toxicity.fit(docs, toxicity.training_labels(spark, sf_dir)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies (five-word shingles, similarity 0.8)."""
    small_batches(spark)
    return simhash.keep_one_of_each(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by their kinds."""
    small_batches(spark)
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training sequences."""
    small_batches(spark)
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]
#: Classifiers, min-hash groups and retrieval packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
