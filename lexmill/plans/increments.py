"""Models of a growing corpus: counts are stored per batch of documents and added up when a model is read.

A batch costs what its own documents cost; nothing counted before is read again.
Reading adds up as many rows per word and label as there are batches, so batches
are compacted into one from time to time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lexmill.operators.features import TfIdf
from lexmill.operators.joins import Lookup
from lexmill.plans.bayes import GaussianNaiveBayes, NaiveBayes, gaussian_states, merged_states
from lexmill.plans.classes import class_counts, with_label
from lexmill.storage import materialize

# Cells of a word model and of a Gaussian one; a log has either.
CELLS = {
    "words": "feature string, label string, count double, rows bigint",
    "values": "label string, feature string, cnt bigint, mean double, m2 double",
}


class ModelLog:
    """A folder of counted batches: ``cells`` by batch, then ``batches``, whose row makes the batch valid.

    ``kind`` is ``words`` (naive Bayes, TF-IDF) or ``values`` (Gaussian naive
    Bayes). The class counts of a batch are its row in ``batches``, together with
    the names of batches it replaces, so a batch and a compaction become visible
    at once, and what a job that failed has left behind is never read. Batches must
    not share documents. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, kind: str = "words", keys: Sequence[str] = ("doc_id",)):
        self.spark, self.path, self.kind, self.keys = spark, path, kind, list(keys)
        if kind not in CELLS:
            raise ValueError(f"kind must be one of {sorted(CELLS)}")

    # -- writing ----------------------------------------------------------

    def partial_fit(self, x: DataFrame, y: DataFrame, label_col: str | None = None) -> str:
        """Count a batch of features ``keys, feature, value`` and labels ``keys, label``; returns its name."""
        x = with_label(x, y, self.keys, label_col)
        return self._add(self._counted(x), class_counts(y), [])

    def compact(self) -> str:
        """Add up all batches into one that replaces them."""
        old = [r["batch"] for r in self._valid().select("batch").collect()]
        return self._add(self._summed(self.cells()), self.class_counts(), old)

    def _add(self, cells: DataFrame, classes: DataFrame, replaces: list[str]) -> str:
        name = uuid.uuid4().hex
        cells.write.parquet(f"{self.path}/cells/batch={name}")
        entry = classes.agg(F.collect_list(F.struct("label", "n")).alias("classes"))
        entry = entry.select(F.lit(name).alias("batch"), "classes", F.lit(replaces).cast("array<string>").alias("replaces"))
        entry.coalesce(1).write.mode("append").parquet(f"{self.path}/batches")
        return name

    def _counted(self, x: DataFrame) -> DataFrame:
        if self.kind == "values":
            return gaussian_states(x)
        return x.groupBy("feature", "label").agg(F.sum("value").alias("count"), F.count(F.lit(1)).alias("rows"))

    def _summed(self, cells: DataFrame) -> DataFrame:
        if self.kind == "values":
            return merged_states(cells)
        return cells.groupBy("feature", "label").agg(F.sum("count").alias("count"), F.sum("rows").alias("rows"))

    # -- reading ----------------------------------------------------------

    def _valid(self) -> DataFrame:
        """One row per batch that is complete and not replaced; a batch is thousands of documents, so they are few."""
        schema = "batch string, classes array<struct<label: string, n: bigint>>, replaces array<string>"
        try:
            batches = self.spark.read.schema(schema).parquet(f"{self.path}/batches")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        replaced = batches.select(F.explode("replaces").alias("batch"))
        return batches.join(replaced, "batch", "left_anti")

    def cells(self) -> DataFrame:
        """The cells of all valid batches; folders of others are not read."""
        names = [r["batch"] for r in self._valid().select("batch").collect()]
        if not names:
            return self.spark.createDataFrame([], CELLS[self.kind])
        return self.spark.read.schema(CELLS[self.kind]).parquet(*[f"{self.path}/cells/batch={n}" for n in names])

    def class_counts(self) -> DataFrame:
        """``label, n``."""
        counts = self._valid().select(F.explode("classes").alias("c")).groupBy("c.label").agg(F.sum("c.n").alias("n"))
        return materialize(counts, "class_counts")

    def naive_bayes(self, **options) -> NaiveBayes:
        """The model that one fit on all batches would give."""
        return NaiveBayes(keys=self.keys, **options).fit_counts(self.cells(), self.class_counts())

    def gaussian(self, **options) -> GaussianNaiveBayes:
        return GaussianNaiveBayes(keys=self.keys, **options).fit_states(self.cells(), self.class_counts())

    def tfidf(self) -> TfIdf:
        """Document frequencies over all batches."""
        model = TfIdf(self.keys)
        model.lookup = Lookup.build(self.cells().groupBy("feature").agg(F.sum("rows").alias("df")), ["feature"], "df", 1, "idf")
        return model
