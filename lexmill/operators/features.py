"""Document frequencies, TF-IDF and sampling of labelled feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.operators.joins import Lookup, beside_each
from lexmill.operators.ranking import lowest_by_hash
from lexmill.storage import materialize


def document_frequency(x: DataFrame) -> DataFrame:
    """``feature, df``: the number of documents each feature occurs in."""
    return x.groupBy("feature").agg(F.count(F.lit(1)).alias("df"))


def doc_length(x: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keys, length``: the sum of all counts of a document."""
    return x.groupBy(*keys).agg(F.sum("value").alias("length"))


def class_feature_counts(x: DataFrame, y: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``label, feature, value``: values added up over the documents of a class."""
    return x.join(y, list(keys)).groupBy("label", "feature").agg(F.sum("value").alias("value"))


def label_feature_grid(features: DataFrame, labels: DataFrame) -> DataFrame:
    """``feature, label``: every distinct feature beside every distinct label."""
    return beside_each(features.select("feature").distinct(), labels.select("label").distinct())


class TfIdf:
    """Term frequency times inverse document frequency.

    ``value / length(document) * ln(N / (df + 1))``. ``df`` comes from the
    fitted data and is 0 for unseen words; ``N`` counts the documents of the
    data being transformed.
    """

    def __init__(self, keys: Sequence[str] = ("doc_id",)):
        self.keys = list(keys)
        self.lookup: Lookup | None = None

    def fit(self, x: DataFrame) -> "TfIdf":
        self.lookup = Lookup.build(document_frequency(x), ["feature"], "df", 1, "idf")
        return self

    def fit_transform(self, x: DataFrame) -> DataFrame:
        """Fit on ``x`` and score it; ``x`` is evaluated once."""
        measured = materialize(self._with_length(x), "measured")
        return self.fit(measured)._scored(measured, self._n_docs(measured))

    def transform(self, x: DataFrame, n_docs: int | None = None) -> DataFrame:
        """``x`` with ``value`` replaced by its score and the old value as ``tf_count``.

        Unless the number of documents is given, ``x`` is stored once, to count
        them and to score them.
        """
        measured = self._with_length(x)
        if n_docs is not None:
            return self._scored(measured, F.lit(n_docs))
        measured = materialize(measured, "measured")
        return self._scored(measured, self._n_docs(measured))

    def _with_length(self, x: DataFrame) -> DataFrame:
        # before it is stored, while the rows of a document are in place
        return x.withColumn("_length", F.sum("value").over(Window.partitionBy(*self.keys)))

    def _n_docs(self, x: DataFrame) -> Column:
        return x.select(*self.keys).distinct().agg(F.count(F.lit(1))).scalar()

    def _scored(self, measured: DataFrame, total: Column) -> DataFrame:
        known = self.lookup.join(measured, "left")
        idf = F.ln(total / (F.coalesce("df", F.lit(0)) + 1))
        return known.withColumnRenamed("value", "tf_count").select(
            *[c for c in measured.columns if c not in ("value", "_length")],
            (F.col("tf_count") / F.col("_length") * idf).alias("value"),
            "tf_count",
        )

    def save(self, path: str) -> None:
        self.lookup.df.write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, keys: Sequence[str] = ("doc_id",)) -> "TfIdf":
        model = cls(keys)
        model.lookup = Lookup.of(spark.read.parquet(path), ["feature"], "df")
        return model


def balanced_labels(y: DataFrame, keys: Sequence[str] = ("doc_id",), seed: str = "0") -> DataFrame:
    """Labels with every class cut to the size of the smallest, without replacement."""
    sizes = y.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    smallest = sizes.agg(F.min("_n")).scalar()
    quota = sizes.select("label", smallest.alias("quota"))
    return lowest_by_hash(y, keys, ["label"], seed, quota)


def sample_balanced(
    x: DataFrame, y: DataFrame, keys: Sequence[str] = ("doc_id",), seed: str = "0"
) -> tuple[DataFrame, DataFrame]:
    """Features and labels of a class-balanced sample of the documents."""
    kept = balanced_labels(y, keys, seed)
    return x.join(kept.select(*keys), list(keys), "left_semi"), kept


def minibatch_ids(y: DataFrame, size: int, seed: str, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``size`` document keys drawn without replacement."""
    ids = y.select(*keys).distinct()
    quota = y.sparkSession.range(1).select(F.lit(size).cast("bigint").alias("quota"))
    return lowest_by_hash(ids, keys, [], seed, quota)


def minibatch(
    x: DataFrame, y: DataFrame, size: int, seed: str, keys: Sequence[str] = ("doc_id",)
) -> tuple[DataFrame, DataFrame]:
    """Features and labels of a random batch of ``size`` documents."""
    ids = minibatch_ids(y, size, seed, keys)
    return x.join(ids, list(keys), "left_semi"), y.join(ids, list(keys), "left_semi")
