"""Accuracy of predicted labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(predicted: DataFrame, truth: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row ``correct, total, accuracy`` over the documents that got a prediction."""
    pairs = predicted.select(*keys, "label").join(
        truth.select(*keys, F.col("label").alias("_true")), list(keys)
    )
    hit = (F.col("label") == F.col("_true")).cast("int")
    return pairs.agg(
        F.coalesce(F.sum(hit), F.lit(0)).alias("correct"),
        F.count(F.lit(1)).alias("total"),
        F.avg(hit).alias("accuracy"),
    )


def hit_rate(predicted: DataFrame, truth: DataFrame, doc: str, keys: Sequence[str]) -> DataFrame:
    """One row ``matched, total, accuracy``: the percentage of documents given any of their labels.

    ``keys`` identify a labelled copy and ``doc`` the document it was copied
    from. A copy without a prediction counts as a miss.
    """
    pairs = truth.select(*keys, F.col("label").alias("_true")).join(
        predicted.select(*keys, "label"), list(keys), "left"
    )
    hit = F.coalesce((F.col("label") == F.col("_true")).cast("int"), F.lit(0))
    per_doc = pairs.groupBy(doc).agg(F.max(hit).alias("_hit"))
    return per_doc.agg(
        F.coalesce(F.sum("_hit"), F.lit(0)).alias("matched"),
        F.count(F.lit(1)).alias("total"),
        (F.avg("_hit") * 100).alias("accuracy"),
    )
