import os

import pytest
from pyspark.sql import functions as F

from lexmill.operators.features import TfIdf
from lexmill.operators.sketches import SketchStore, merged_sketches, vocabulary_estimates, vocabulary_sketches
from lexmill.plans import GaussianNaiveBayes, NaiveBayes
from lexmill.plans.bayes import gaussian_states, gaussian_stats, merged_states, stats_of
from lexmill.plans.increments import ModelLog
from lexmill.storage import scratch_path


@pytest.fixture(scope="module")
def data(spark):
    words = spark.range(600).select(
        (F.col("id") % 60).alias("doc_id"),
        F.concat(F.lit("w"), (F.col("id") * F.col("id") % 37).cast("string")).alias("feature"),
        (F.col("id") % 4 + 1).cast("double").alias("value"),
    )
    x = words.groupBy("doc_id", "feature").agg(F.sum("value").alias("value"))
    y = spark.range(60).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, "ABC")), (F.col("id") % 3 + 1).cast("int")).alias("label"))
    return x.cache(), y.cache()


def batch(df, n):
    # the first batch knows no document of class C
    return df.filter(F.when((F.col("doc_id") % 3 != 2) & (F.col("doc_id") < 30), 0).otherwise(1 + F.col("doc_id") % 2) == n)


def filled(spark, data, kind, compact=()):
    log = ModelLog(spark, scratch_path(spark, "log"), kind)
    for n in range(3):
        log.partial_fit(*(batch(df, n) for df in data))
        if n in compact:
            log.compact()
    return log


@pytest.mark.parametrize("wide", [64, 0])
@pytest.mark.parametrize("compact", [(), (1,), (0, 2)])
def test_batches_of_words_equal_one_fit(spark, rows, data, wide, compact):
    x, y = data
    log = filled(spark, data, "words", compact)
    whole, added = NaiveBayes(wide=wide).fit(x, y), log.naive_bayes(wide=wide)
    assert rows(added.likelihoods(), "label", "feature", "df", "log_likelihood") == rows(whole.likelihoods(), "label", "feature", "df", "log_likelihood")
    assert rows(added.predict(x), "doc_id", "label") == rows(whole.predict(x), "doc_id", "label")
    assert rows(added.priors(), "label", "n") == rows(whole.priors(), "label", "n")
    if wide:
        want = rows(TfIdf().fit(x).lookup.df, "feature", "df")
        assert rows(log.tfidf().lookup.df, "feature", "df") == want


def test_batches_of_values_equal_one_fit(spark, data):
    x, y = data
    whole = {(r.label, r.feature): r for r in GaussianNaiveBayes().fit(x, y).stats.collect()}
    halves = [GaussianNaiveBayes().fit(*(df.filter(F.col("doc_id") % 2 == k) for df in data)) for k in range(2)]
    for model in (filled(spark, data, "values", (1,)).gaussian(), halves[0].merged(halves[1])):
        got = {(r.label, r.feature): r for r in model.stats.collect()}
        assert got.keys() == whole.keys()
        for key, r in got.items():
            w = whole[key]
            assert r.cnt == w.cnt and r.mean == pytest.approx(w.mean, rel=1e-12)
            assert r.stddev == (w.stddev if w.stddev is None else pytest.approx(w.stddev, rel=1e-9, abs=1e-9))
        assert {r.label: r.n for r in model.classes.table.collect()} == {"A": 20, "B": 20, "C": 20}
        assert sorted(r.label for r in model.predict(x).collect()) == sorted(r.label for r in GaussianNaiveBayes().fit(x, y).predict(x).collect())


def test_states_keep_small_deviations_of_large_values(spark):
    # a sum of squares would lose them
    x = spark.range(1000).select(F.lit("A").alias("label"), F.lit("f").alias("feature"), (F.lit(1e9) + F.col("id") % 2).alias("value"), (F.col("id") % 7).alias("part"))
    states = [gaussian_states(x.filter(F.col("part") == k)) for k in range(7)]
    union = states[0]
    for s in states[1:]:
        union = union.unionByName(s)
    got, want = stats_of(merged_states(union)).first(), gaussian_stats(x).first()
    assert got.cnt == 1000 and got.mean == pytest.approx(want.mean, rel=1e-15) and got.stddev == pytest.approx(0.5002501, rel=1e-6)
    one = spark.createDataFrame([("A", "f", None), ("A", "g", 2.0)], "label string, feature string, value double")
    assert [(r.feature, r.cnt, r.stddev) for r in stats_of(merged_states(gaussian_states(one))).collect()] == [("g", 1, None)]


def test_failed_batches_are_not_read(spark, rows, data):
    log = filled(spark, data, "words")
    before = rows(log.class_counts()), log.cells().count()
    # cells without their entry, as a job leaves them that fails in between
    data[0].limit(3).selectExpr("feature", "'A' as label", "value as count", "1L as rows").write.parquet(f"{log.path}/cells/batch=broken")
    assert (rows(log.class_counts()), log.cells().count()) == before
    log.compact()
    assert log._valid().count() == 1 and len(os.listdir(f"{log.path}/cells".removeprefix("file://"))) == 5
    assert rows(log.class_counts()) == before[0]


def test_log_without_batches(spark, data):
    log = ModelLog(spark, scratch_path(spark, "log"))
    assert log.naive_bayes().predict(data[0]).count() == 0
    with pytest.raises(ValueError):
        ModelLog(spark, "x", "counts")


def test_union_of_sketches_is_the_sketch_of_all(spark, rows):
    words = spark.range(40_000).select((F.col("id") % 3).alias("day"), F.concat(F.lit("w"), F.col("id") % 17_000).alias("feature"))
    words = words.unionByName(spark.createDataFrame([(0, None)], words.schema))
    store = SketchStore(spark, scratch_path(spark, "sketches"))
    for day in range(3):
        store.add(f"day{day}", words.filter(F.col("day") == day))
    whole = vocabulary_estimates(vocabulary_sketches(words, [])).first()
    assert tuple(store.estimate().select("rows", "vocabulary").first()) == (whole.rows, whole.vocabulary) == (40_000, pytest.approx(17_000, rel=0.03))
    # adding a part again replaces it
    store.add("day1", words.filter("day = 2"))
    want = vocabulary_estimates(vocabulary_sketches(words.filter("day <> 1"), [])).first().vocabulary
    assert store.estimate().first().vocabulary == want and store.read().count() == 3
    by_day = vocabulary_sketches(words, ["day"])
    assert vocabulary_estimates(merged_sketches(by_day)).first().vocabulary == whole.vocabulary
    assert vocabulary_estimates(vocabulary_sketches(words.limit(0), [])).first().vocabulary == 0
