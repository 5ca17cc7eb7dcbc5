import numpy as np
import math
import statistics
from collections import Counter, defaultdict

import pytest

from lexmill import storage
from lexmill.operators.metrics import accuracy, hit_rate
from lexmill.operators.tensor import best
from lexmill.plans import GaussianNaiveBayes, NaiveBayes, SmoothedNaiveBayes, bayes, blocks
from lexmill.storage import scratch_path

SCHEMA = "doc_id bigint, feature string, value double"
TRAIN = {
    0: ("A", {"red": 2, "blue": 1}),
    1: ("A", {"red": 1}),
    2: ("B", {"blue": 3, "green": 1}),
    3: ("C", {"green": 2, "grey": 1}),
    4: ("B", {}),
}
TEST = {
    10: {"red": 2, "violet": 1},
    11: {"blue": 1, "green": 2, "pink": 4},
    12: {"violet": 1},
    13: {"grey": 1, "blue": 5},
}


def table(spark, docs):
    cells = [(d, f, float(v)) for d, words in docs.items() for f, v in words.items()]
    return spark.createDataFrame(cells, SCHEMA)


@pytest.fixture(scope="module")
def data(spark):
    x = table(spark, {d: words for d, (_, words) in TRAIN.items()})
    y = spark.createDataFrame([(d, l) for d, (l, _) in TRAIN.items()], "doc_id bigint, label string")
    return x, y, table(spark, TEST)


def brute(denominator, weight, unseen, fallback):
    """Scores ``{(doc, label): score}`` by the definition, word by word."""
    docs, words, counts, df = Counter(), Counter(), Counter(), Counter()
    for label, bag in TRAIN.values():
        docs[label] += 1
        for f, v in bag.items():
            counts[label, f] += v
            words[label] += v
            df[f] += 1
    scores = {}
    for doc, bag in TEST.items():
        if not fallback and unseen == "drop" and not any(f in df for f in bag):
            continue
        for label in docs:
            den = len(df) + (docs if denominator == "docs" else words)[label]
            score = math.log(docs[label] / len(TRAIN))
            for f, v in bag.items():
                if f in df:
                    w = {"df": df[f], "once": 1, "count": v}[weight]
                    score += w * math.log((counts[label, f] + 1) / den)
                elif unseen == "smooth":
                    score -= (v if weight == "count" else 1) * math.log(1 + den)
            scores[doc, label] = score
    return scores


def as_dict(df):
    return {(r.doc_id, r.label): r.score for r in df.collect()}


def best_of(scores):
    docs = defaultdict(list)
    for (doc, label), s in scores.items():
        docs[doc].append((-s, label))
    return {d: min(c)[1] for d, c in docs.items()}


OPTIONS = [
    ("docs", "df", "drop", False),
    ("words", "once", "smooth", False),
    ("words", "count", "drop", False),
    ("docs", "once", "drop", True),
]


@pytest.mark.parametrize("wide", [64, 0])
@pytest.mark.parametrize("options", OPTIONS)
def test_scores_follow_the_definition(data, options, wide):
    x, y, test = data
    model = NaiveBayes(*options, wide=wide).fit(x, y)
    want = brute(*options)
    assert as_dict(model.scores(test)) == pytest.approx(want)
    model.model.broadcast_bytes = 0
    assert as_dict(model.scores(test)) == pytest.approx(want)
    predicted = {r.doc_id: r.label for r in model.predict(test).collect()}
    assert predicted == best_of(want)


def test_unknown_words_only(data, rows):
    x, y, test = data
    only = test.filter("doc_id = 12")
    assert rows(NaiveBayes().fit(x, y).predict(only)) == []
    # two classes have the larger prior; the smaller label wins
    assert rows(NaiveBayes(fallback=True).fit(x, y).predict(only), "label") == [("A",)]
    assert rows(NaiveBayes().fit(x, y).coverage(test)) == [(10, 0.5), (11, 2 / 3), (12, 0.0), (13, 1.0)]


def test_equal_scores_go_to_the_smallest_label(spark, rows):
    x = table(spark, {0: {"w": 1}, 1: {"w": 1}})
    y = spark.createDataFrame([(0, "Q"), (1, "B")], "doc_id bigint, label string")
    for wide in (64, 0):
        assert rows(NaiveBayes(wide=wide).fit(x, y).predict(x), "doc_id", "label") == [(0, "B"), (1, "B")]


@pytest.mark.parametrize("wide", [64, 0])
def test_likelihoods_and_priors(data, wide):
    x, y, _ = data
    model = NaiveBayes(wide=wide).fit(x, y)
    assert model.vocabulary_size == 4
    ll = {(r.label, r.feature): r.log_likelihood for r in model.likelihoods().collect()}
    assert len(ll) == 12
    assert ll["A", "red"] == pytest.approx(math.log(4 / 6))
    assert ll["C", "red"] == pytest.approx(math.log(1 / 5))
    priors = {r.label: (r.n, r.log_prior) for r in model.priors().collect()}
    assert priors["B"] == (2, pytest.approx(math.log(2 / 5)))


def test_labels_carried_by_the_features(data, rows):
    x, y, test = data
    carried = x.join(y, "doc_id").withColumnRenamed("label", "topic")
    a = NaiveBayes().fit(x, y).scores(test)
    b = NaiveBayes().fit(carried, y, label_col="topic").scores(test)
    assert as_dict(a) == pytest.approx(as_dict(b))


@pytest.mark.parametrize("wide", [64, 0])
def test_models_can_be_stored(spark, data, wide):
    x, y, test = data
    model = NaiveBayes("words", wide=wide).fit(x, y)
    path = scratch_path(spark, "nb")
    model.save(path)
    again = NaiveBayes("words").load(spark, path)
    assert as_dict(again.scores(test)) == pytest.approx(as_dict(model.scores(test)))


def test_smoothed_variant_leaves_out_classes_without_words(spark, data):
    x, y, test = data
    y = y.union(spark.createDataFrame([(5, "D")], y.schema))
    for wide in (64, 0):
        labels = {l for _, l in as_dict(SmoothedNaiveBayes(wide=wide).fit(x, y).scores(test))}
        assert labels == {"A", "B", "C"}


def test_word_probabilities_agree_with_multinomial_estimator(spark, data):
    from pyspark.ml.classification import NaiveBayes as Multinomial
    from pyspark.ml.linalg import Vectors

    names, classes = ["blue", "green", "grey", "red"], ["A", "B", "C"]
    dense = [
        (float(classes.index(l)), Vectors.dense([float(bag.get(f, 0)) for f in names])) for l, bag in TRAIN.values()
    ]
    theta = Multinomial(smoothing=1.0).fit(spark.createDataFrame(dense, ["label", "features"])).theta.toArray()
    x, y, _ = data
    for r in NaiveBayes("words").fit(x, y).likelihoods().collect():
        assert r.log_likelihood == pytest.approx(theta[classes.index(r.label)][names.index(r.feature)])


def test_accuracy_counts_predicted_documents_only(spark, rows):
    predicted = spark.createDataFrame([(0, "A", 1.0), (1, "B", 1.0)], "doc_id bigint, label string, score double")
    truth = spark.createDataFrame([(0, "A"), (1, "A"), (2, "A")], "doc_id bigint, label string")
    assert rows(accuracy(predicted, truth)) == [(1, 2, 0.5)]


def test_hit_rate_takes_any_label(spark, rows):
    keys = ["doc_id", "true_label"]
    truth = spark.createDataFrame([(0, "A", "A"), (0, "B", "B"), (1, "A", "A"), (2, "B", "B")], "doc_id bigint, true_label string, label string")
    predicted = spark.createDataFrame([(0, "A", "B"), (0, "B", "B"), (1, "A", "B")], "doc_id bigint, true_label string, label string")
    assert rows(hit_rate(predicted, truth, "doc_id", keys)) == [(1, 3, pytest.approx(100 / 3))]


# ------------------------------------------------------------------ Gaussian

POINTS = [
    (0, "A", {"f": 1.0, "g": 4.0}),
    (1, "A", {"f": 3.0, "g": 4.0}),
    (2, "A", {"f": 2.5}),
    (3, "B", {"f": 9.0, "g": 1.0}),
    (4, "B", {"g": 2.0}),
    (5, "B", {"f": 7.0, "h": 1.0}),
]
PROBES = {20: {"f": 2.0, "g": 3.0}, 21: {"f": 60.0}, 22: {"h": 3.0}, 23: {"g": 1.5, "h": 2.0}}


def log_tail(z):
    return math.log(0.5 * math.erfc(abs(z) / math.sqrt(2)))


def log_pdf(z, sd):
    return -z * z / 2 - math.log(sd * math.sqrt(2 * math.pi))


def brute_gaussian(likelihood, missing):
    groups, sizes = defaultdict(list), Counter(l for _, l, _ in POINTS)
    for _, l, cells in POINTS:
        for f, v in cells.items():
            groups[l, f].append(v)
    if missing == "zero":
        groups = {(l, f): v + [0.0] * (sizes[l] - len(v)) for (l, f), v in groups.items()}
    stats = {k: (statistics.mean(v), statistics.stdev(v)) for k, v in groups.items() if len(v) > 1}
    stats = {k: s for k, s in stats.items() if s[1] > 0}
    scores = {}
    for doc, cells in PROBES.items():
        for label in sizes:
            terms = []
            for (l, f), (mean, sd) in stats.items():
                if l != label or (missing == "ignore" and f not in cells):
                    continue
                z = (cells.get(f, 0.0) - mean) / sd
                terms.append(log_tail(z) if likelihood == "tail" else log_pdf(z, sd))
            if terms:
                scores[doc, label] = sum(terms) + math.log(sizes[label] / len(POINTS))
    return scores


@pytest.fixture(scope="module")
def points(spark):
    x = table(spark, {d: c for d, _, c in POINTS})
    y = spark.createDataFrame([(d, l) for d, l, _ in POINTS], "doc_id bigint, label string")
    return x, y, table(spark, PROBES)


@pytest.mark.parametrize("missing", ["ignore", "zero"])
@pytest.mark.parametrize("likelihood", ["tail", "pdf"])
def test_gaussian_scores_follow_the_definition(points, likelihood, missing):
    x, y, probes = points
    if likelihood == "tail":
        probes = probes.filter("doc_id <> 21")  # beyond the reach of erfc; see the next test
    want = brute_gaussian("pdf", missing) if likelihood == "pdf" else None
    model = GaussianNaiveBayes(likelihood, missing).fit(x, y)
    if want is None:
        PROBES_21 = PROBES.pop(21)
        want = brute_gaussian("tail", missing)
        PROBES[21] = PROBES_21
    assert as_dict(model.scores(probes)) == pytest.approx(want)
    model.model.broadcast_bytes = 0
    assert as_dict(model.scores(probes)) == pytest.approx(want)
    assert {r.doc_id: r.label for r in model.predict(probes).collect()} == best_of(want)


def test_far_values_stay_finite(points):
    x, y, probes = points
    scores = as_dict(GaussianNaiveBayes().fit(x, y).scores(probes))
    assert -math.inf < scores[21, "A"] < -1000
    assert best_of(scores)[21] == "B"


def test_single_and_constant_values_take_no_part(points, rows):
    x, y, probes = points
    model = GaussianNaiveBayes().fit(x, y)
    stats = {(r.label, r.feature): (r.cnt, r.mean, r.stddev) for r in model.stats.collect()}
    assert stats["B", "h"] == (1, 1.0, None)
    assert stats["A", "g"] == (2, 4.0, 0.0)
    assert rows(model.predict(probes.filter("doc_id = 22"))) == []


def test_gaussian_storage_and_score(spark, points, rows):
    x, y, probes = points
    model = GaussianNaiveBayes("pdf").fit(x, y)
    path = scratch_path(spark, "gnb")
    model.save(path)
    again = GaussianNaiveBayes("pdf").load(spark, path)
    assert as_dict(again.scores(probes)) == pytest.approx(as_dict(model.scores(probes)))
    assert rows(model.score(x, y), "total") == [(6,)]


def test_log_tail_against_erfc(spark):
    from pyspark.sql import functions as F

    from lexmill.functions.gaussian import log_tail as column

    zs = [i / 10 for i in range(-370, 371, 7)] + [7.07106781186546, 7.0710678118655]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for r in df.select("z", column(F.col("z")).alias("t")).collect():
        assert r.t == pytest.approx(log_tail(r.z), rel=1e-8)


def test_zero_mass_of_large_values_and_of_a_single_document(spark):
    big = [1e9 + i for i in range(5)]
    x = spark.createDataFrame([(i, "A", "f", v) for i, v in enumerate(big)] + [(9, "B", "f", 1.0)], "doc_id bigint, label string, feature string, value double")
    y = x.select("doc_id", "label").unionByName(spark.createDataFrame([(7, "A")], "doc_id bigint, label string"))
    for more in (y, y.filter("doc_id <> 7")):
        model = GaussianNaiveBayes("pdf", "zero").fit(x, more, label_col="label")
        found = {r.label: r for r in model._with_zeros(model.stats).collect()}
        values = big + [0.0] * (more.filter("label = 'A'").count() - 5)
        assert found["A"].stddev == pytest.approx(np.std(values, ddof=1), rel=1e-9)
        assert found["B"].stddev is None
        assert model.predict(x).filter("label = 'B'").count() == 0


@pytest.mark.parametrize("options", [{}, {"weight": "once", "unseen": "smooth"}, {"denominator": "words", "fallback": True}])
def test_best_of_many_labels_without_a_grid(spark, monkeypatch, options):
    words = ["a", "b", "c", "d", "e"]
    cells = [(i, w, float(1 + (i * k) % 3)) for i in range(60) for k, w in enumerate(words) if (i * (k + 3)) % 4]
    x = spark.createDataFrame(cells, "doc_id bigint, feature string, value double")
    y = spark.createDataFrame([(i, f"l{i % 7}") for i in range(60)], "doc_id bigint, label string")
    new = spark.createDataFrame([(100, "a", 1.0), (100, "zzz", 2.0), (101, "zzz", 1.0)], "doc_id bigint, feature string, value double")
    model = NaiveBayes(wide=0, **options).fit(x, y)
    test = x.unionByName(new)
    got = model.predict(test).collect()
    monkeypatch.setattr("lexmill.plans.bayes.CLASS_BYTES", 0)
    want = {r.doc_id: r.score for r in model.predict(test).collect()}
    scores = {(r.doc_id, r.label): r.score for r in model.scores(test).collect()}
    assert len(want) > 40 and {r.doc_id for r in got} == want.keys()
    for r in got:
        # nearly equal scores may be added up in another order
        assert r.score == pytest.approx(want[r.doc_id]) == pytest.approx(scores[r.doc_id, r.label])


@pytest.mark.parametrize(("slots", "most"), [(0, 1 << 26), (256, 1 << 26), (256, 3000)])
def test_sums_of_many_labels_stay_where_their_document_is(spark, rows, monkeypatch, slots, most):
    x = spark.range(3000).selectExpr("id % 60 as doc_id", "concat('w', pmod(xxhash64(id), 40)) as feature", "1D as value").distinct()
    y = spark.range(60).selectExpr("id as doc_id", "concat('c', id % 9) as label")
    new = x.unionByName(spark.range(2).selectExpr("100 + id as doc_id", "'unknown' as feature", "1D as value"))
    plans = []
    monkeypatch.setattr(bayes, "SLOT_LABELS", slots)
    monkeypatch.setattr(bayes, "BROADCAST_BYTES", most)
    monkeypatch.setattr(storage, "materialize", lambda df, name, f=storage.materialize: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df, name))
    for how in ({}, {"unseen": "smooth", "weight": "once"}, {"fallback": True}):
        model = bayes.NaiveBayes(wide=0, **how).fit(x, y)
        found, want = (rows(df.selectExpr("doc_id", "label", "round(score, 6)")) for df in (model.predict(new), best(model.scores(new), ["doc_id"], "score", "label")))
        assert len(found) == 60 + 2 * bool(how)
        assert found == want
    assert len(plans) == 3 and all("Exchange" not in p[: p.index("Generate explode")] for p in plans)


def test_cells_of_many_labels_are_packed_and_added_up_in_one_task(spark, rows, monkeypatch):
    # two keys, one of them null at times, rows that come twice, null words, odd counts, and words of few and of many classes
    cells = [(i, "x" if i % 5 else None, f"w{k}", v) for i in range(60) for k, v in ((i % 20, 1.0), (i % 3, 70000.0), (i % 7, 0.5), (i % 4, 300.0), (i % 6, -3.0))]
    schema = "doc_id bigint, part string, feature string, value double"
    x = spark.createDataFrame([*cells, *cells[::9], (3, "x", None, 1.0), (4, "x", "w1", None)], schema)
    y = spark.createDataFrame([(i, "x" if i % 5 else None, i % 30 if i % 11 else None) for i in range(60)], "doc_id bigint, part string, label int")
    new = x.unionByName(spark.createDataFrame([(100, "x", "unknown", 1.0), (101, "x", None, 1.0), (102, None, "w1", 1.0)], schema))
    stored, plans = [], []
    monkeypatch.setattr(bayes, "materialize", lambda df, name, f=storage.materialize: stored.append(name) or f(df, name))
    monkeypatch.setattr(bayes, "materialize_placed", lambda df, name, f=storage.materialize: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df, name))
    for how in ({}, {"unseen": "smooth", "weight": "once"}, {"fallback": True}):
        model = bayes.NaiveBayes(wide=0, keys=["doc_id", "part"], **how).fit(x, y)
        stored.clear()
        found = model.predict(new)
        assert stored == ["class_places", "to_predict", "packed_cells"]
        assert dict(found.dtypes) == {"doc_id": "bigint", "part": "string", "label": "int", "score": "double"}
        scores = model.scores(new).filter("part is not null")
        want = best(scores, ["doc_id", "part"], "score", "label")
        got = rows(found.filter("part is not null").selectExpr("doc_id", "part", "round(score, 6)"))
        assert got == rows(want.selectExpr("doc_id", "part", "round(score, 6)")) and len(got) > 40
    # of what cells unfold into nothing is a row of Spark's
    assert len(plans) == 3 and all("Aggregate" not in p[: p.index("MapInArrow")] for p in plans)


def test_packed_cells_come_back(spark):
    cells = [("a", 3, [("x", 1.0), ("y", 255.0)]), ("b", 1, [("z", 256.0), (None, 1.0), ("other", 2.0)]), ("c", 9, [("y", 0.25), ("x", 1e9)]), (None, 2, [("x", None), ("y", -1.0)]), ("d", 2, [])]
    model = spark.createDataFrame(cells, "feature string, df long, cells array<struct<label:string,count:double>>")
    got = {r.feature: (r.df, list(zip(*(a.tolist() for a in blocks.unpacked(bytes(r.packed))))), len(r.packed)) for r in blocks.packed_cells(model, ["x", "y", "z"]).collect()}
    assert got == {"a": (3, [(0, 1.0), (1, 255.0)], 5), "b": (1, [(2, 256.0)], 4), "c": (9, [(1, 0.25), (0, 1e9)], 19), None: (2, [], 1), "d": (2, [], 1)}
