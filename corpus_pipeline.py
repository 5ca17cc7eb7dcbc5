"""A training corpus from raw documents: language, quality, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. Between stages tables are written, so a lost executor costs one stage at
most. All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import language, minhash, packing, pii, quality
from lexmill.llm.rows import remainder, table
from lexmill.storage import materialize

# A text is rejected if its words agree on a language less than this many times as well as by chance.
LEAST_LANGUAGE = 1.4
LEAST_QUALITY = 0.3
# Ids of dropped copies are broadcast if there are at most so many; beyond that they are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; texts without a letter and null texts go.

    Where no language could be learned, every text with a letter stays.
    """
    model = language.fit(docs, remainder("doc_id", 4) != 2)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    # a single language is always agreed on
    least = min(LEAST_LANGUAGE / len(model.languages), 1.0)
    return docs.filter(model.prediction_column(F.col("text"))["score"] >= least)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is high enough."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return docs.filter(model.score_column(F.col("text")) >= LEAST_QUALITY)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    Rows with a null id are in no group and stay; rows that repeat an id stay or go together.
    """
    copies = minhash.near_duplicates(docs, width=5, percent=80).filter("not kept and doc_id is not null")
    copies = materialize(copies.select(F.col("doc_id").alias("copy_id")).distinct(), "copies")
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies.hint("merge")
    return docs.join(copies, docs["doc_id"] == copies["copy_id"], "left_anti")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text."""
    redacted = pii.redacted(docs, pii.PiiModel().fit(docs))
    return redacted.withColumn("n_chars", F.length("text").cast(redacted.schema["n_chars"].dataType)) if "n_chars" in docs.columns else redacted


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 ids."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("quality", filter_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

# The models are not SQL; tests/llm compares the operators of the stages with plain versions of theirs, and checks what each stage drops and keeps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
