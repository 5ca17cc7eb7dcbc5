"""The table of classes every model starts from."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.storage import materialize

# Up to this many classes a model keeps one array slot per class.
WIDE_LABELS = 64


def class_counts(y: DataFrame) -> DataFrame:
    """``label, n``: the number of labelled documents per class."""
    return y.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def log_priors(y: DataFrame) -> DataFrame:
    """``label, n, log_prior``: the log of each class's share of the documents."""
    return priors_of(class_counts(y))


def priors_of(counts: DataFrame) -> DataFrame:
    """``label, n`` with ``log_prior``."""
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("log_prior", F.ln(F.col("n") / total))


def with_label(x: DataFrame, y: DataFrame, keys: Sequence[str], label_col: str | None) -> DataFrame:
    """Features with a ``label`` column, joined only if they do not carry it already."""
    if label_col is not None:
        return x if label_col == "label" else x.withColumn("label", F.col(label_col))
    return x.join(y.select(*keys, "label"), list(keys))


def best_slot(scored: DataFrame, scores: str, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``keys, label, score`` of the first array entry with the largest score."""
    if not names:
        return scored.select(*keys, F.lit("").alias("label"), F.lit(0.0).alias("score")).limit(0)
    top = scored.withColumn("score", F.array_max(scores))
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(scores, F.col("score")).cast("int"))
    return top.select(*keys, label.alias("label"), "score")


class Classes:
    """``label, n, log_prior`` of all classes.

    Up to ``wide`` of them are held as ``rows`` in label order, which fixes the
    slots of array-valued models. More are kept as a stored table only.
    """

    def __init__(self, table: DataFrame, wide: int = WIDE_LABELS):
        rows = table.orderBy("label").limit(wide + 1).collect()
        self.rows = rows if len(rows) <= wide else None
        self._table = table

    @classmethod
    def fit(cls, y: DataFrame, wide: int = WIDE_LABELS) -> "Classes":
        return cls.of(class_counts(y), wide)

    @classmethod
    def of(cls, counts: DataFrame, wide: int = WIDE_LABELS) -> "Classes":
        """From ``label, n``."""
        self = cls(counts, wide)
        if self.rows is None:
            self._table = materialize(priors_of(counts), "classes")
            return self
        total = sum(r["n"] for r in self.rows)
        rows = [(r["label"], r["n"], math.log(r["n"] / total)) for r in self.rows]
        schema = T.StructType(list(self._table.schema) + [T.StructField("log_prior", T.DoubleType())])
        # at most `wide` rows
        self._table = F.broadcast(counts.sparkSession.createDataFrame(rows, schema))
        self.rows = [T.Row(**dict(zip(schema.names, r))) for r in rows]
        return self

    @property
    def table(self) -> DataFrame:
        return self._table

    @property
    def names(self) -> list[str] | None:
        return None if self.rows is None else [r["label"] for r in self.rows]

    def count(self) -> int:
        return self._table.count() if self.rows is None else len(self.rows)

    def name_array(self) -> Column:
        return F.array(*[F.lit(n) for n in self.names])

    def slot_of(self, label: str = "label") -> Column:
        """The number of a label's slot, from 0; -1 for an unknown label."""
        return F.array_position(self.name_array(), F.col(label)) - 1
