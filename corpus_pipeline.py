"""From raw documents to ids: toxicity, near copies, secrets, mix, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
documents. ``run`` writes each stage's rows as Parquet in the shared folder and reads them again.

Edge cases: null, empty and blank texts pass every stage and are encoded as the end id alone (the mix takes such rows
once); rows without an id are never near copies; rows that repeat an id stay or go together among near copies; null
sources are a source of their own; further columns, whatever their names, come through all stages but the last; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import jaccard, mixing, pieces, queries, secrets, toxicity
from tessera.llm.common import documents, labels, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score is below one half."""
    return toxicity.clean_documents(docs, labels(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents."""
    return jaccard.without_copies(docs)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets blanked out."""
    return secrets.without_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_copies(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the text that they decode to."""
    return pieces.encode_documents(docs, queries.piece_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("secret_scan", blank_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: No stage but the mix can be said in SQL: learned weights, a forest of hashes and a tokenizer stand before it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
