import math

import pytest
from pyspark.sql import functions as F

from lexmill.operators.features import TfIdf, minibatch, sample_balanced
from lexmill.plans import inspect_features
from lexmill.storage import scratch_path

SCHEMA = "doc_id bigint, feature string, value double"


@pytest.fixture()
def bags(spark):
    train = spark.createDataFrame([(0, "red", 2.0), (0, "blue", 1.0), (1, "blue", 1.0)], SCHEMA)
    test = spark.createDataFrame([(5, "red", 1.0), (5, "violet", 1.0), (6, "blue", 3.0), (7, "blue", 1.0)], SCHEMA)
    return train, test


def test_tfidf_counts_documents_of_the_transformed_set(spark, bags):
    train, test = bags
    model = TfIdf().fit(train)
    path = scratch_path(spark, "idf")
    model.save(path)
    for m in (model, TfIdf.load(spark, path)):
        got = {(r.doc_id, r.feature): r.value for r in m.transform(test).collect()}
        assert got[(5, "red")] == pytest.approx(1 / 2 * math.log(3 / 2))
        assert got[(5, "violet")] == pytest.approx(1 / 2 * math.log(3 / 1))
        # df + 1 equals the number of documents, so the score is 0 and is kept
        assert got[(6, "blue")] == pytest.approx(0.0)
        assert len(got) == 4


def test_negative_scores_are_kept(bags):
    train, _ = bags
    got = {(r.doc_id, r.feature): r.value for r in TfIdf().fit(train).transform(train).collect()}
    assert got[(1, "blue")] == pytest.approx(math.log(2 / 3))


def test_tfidf_split_lookup(bags, rows):
    model = TfIdf().fit(bags[0])
    whole = rows(model.transform(bags[1]))
    model.lookup.broadcast_bytes = 0
    assert rows(model.transform(bags[1])) == whole


def test_inspect(bags, rows):
    shown = inspect_features(bags[0])
    assert shown.columns == ["doc_id", "feature", "count", "tfidf"]
    assert rows(shown, "doc_id", "feature", "count") == rows(bags[0])


def test_balanced_sample_cuts_to_the_smallest_class(spark, rows):
    labels = ["a"] * 4 + ["b"] * 2 + ["c"] * 3
    y = spark.createDataFrame(list(enumerate(labels)), "doc_id bigint, label string")
    x = spark.createDataFrame([(i, w, 1.0) for i in range(9) for w in ("u", "v")], SCHEMA)
    xs, ys = sample_balanced(x, y)
    assert rows(ys.groupBy("label").count()) == [("a", 2), ("b", 2), ("c", 2)]
    assert rows(xs.select("doc_id").distinct()) == rows(ys, "doc_id")
    assert xs.count() == 12
    other = sample_balanced(x, y, seed="another")[1]
    again = sample_balanced(x.repartition(3), y.repartition(3))[1]
    assert rows(again) == rows(ys)
    assert rows(other.groupBy("label").count()) == [("a", 2), ("b", 2), ("c", 2)]


def test_minibatch(spark, rows):
    y = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a").alias("label"))
    x = y.select("doc_id", F.lit("w").alias("feature"), F.lit(1.0).alias("value"))
    xs, ys = minibatch(x, y, 7, "s")
    assert xs.count() == ys.count() == 7
    assert rows(xs, "doc_id") == rows(ys, "doc_id")
    assert rows(minibatch(x, y, 7, "t")[1]) != rows(ys)
