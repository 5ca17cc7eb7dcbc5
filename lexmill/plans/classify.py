"""End-to-end jobs: features in, accuracy or predictions out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.features import TfIdf, sample_balanced
from lexmill.plans.bayes import GaussianNaiveBayes, NaiveBayes
from lexmill.plans.softmax import SoftmaxRegression
from lexmill.sources.corpus import Loader
from lexmill.storage import materialize

MODELS = {"nb": NaiveBayes, "gnb": GaussianNaiveBayes, "softmax": SoftmaxRegression}


def classify(
    model: str,
    train_x: DataFrame,
    train_y: DataFrame,
    test_x: DataFrame,
    test_y: DataFrame | None = None,
    balance: bool = False,
    tfidf: bool = False,
    lr: float = 0.01,
    batch_size: int = -1,
    iters: int = 10,
    keys: Sequence[str] = ("doc_id",),
    seed: str = "0",
    label_col: str | None = None,
    placed: bool = False,
    **options,
) -> DataFrame:
    """Train ``nb``, ``gnb`` or ``softmax`` and apply it.

    If the training features carry their label, ``label_col`` names its column
    and saves a join; if they are partitioned by document, as a bag of words
    is, ``placed`` saves a shuffle of softmax regression.

    Returns one row ``correct, total, accuracy`` if test labels are given, else
    ``keys, label, score``. The result is stored. Text is cut once: what is read
    more than once is stored on the way.
    """
    estimator = MODELS[model](keys=keys, **options)
    if balance:
        train_x, train_y = sample_balanced(train_x, train_y, keys, seed)
    if tfidf:
        idf = TfIdf(keys)
        train_x = idf.fit_transform(train_x).drop("tf_count")
        test_x = idf.transform(test_x).drop("tf_count")
    if model == "softmax":
        # what was stored on the way has lost its places
        placed = placed and not tfidf
        estimator.fit(train_x, train_y, lr=lr, batch_size=batch_size, max_iter=iters, placed=placed)
    else:
        estimator.fit(train_x, train_y, label_col=label_col)
    result = estimator.predict(test_x) if test_y is None else estimator.score(test_x, test_y)
    return materialize(result, "classified")


def classify_files(
    spark: SparkSession,
    model: str,
    train_data: str,
    train_labels: str,
    test_data: str,
    test_labels: str | None = None,
    reading: dict | None = None,
    **options,
) -> DataFrame:
    """:func:`classify` on corpus and label files; ``reading`` are options of :meth:`Loader.read`.

    Copies of a document under several labels are documents of their own, so
    predictions are ``doc_id, true_label, label, score``; ``true_label`` is
    empty if the test set has no labels.
    """
    loader = Loader(spark)
    how = reading or {}
    train_x, train_y = loader.read(train_data, train_labels, **how)
    test_x, test_y = loader.read(test_data, test_labels, **how)
    if test_y is None:
        test_x = test_x.withColumn("true_label", F.lit(""))
    return classify(
        model, train_x, train_y, test_x, test_y, keys=("doc_id", "true_label"), label_col="true_label", placed=not how.get("stem", True), **options
    )


def inspect_features(counts: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keys, feature, count, tfidf`` of a word-count table, side by side."""
    scored = TfIdf(keys).fit_transform(counts)
    return scored.select(*keys, "feature", F.col("tf_count").alias("count"), F.col("value").alias("tfidf"))


def first_row(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The first row in the order of the given columns."""
    return df.orderBy(*by).limit(1)
