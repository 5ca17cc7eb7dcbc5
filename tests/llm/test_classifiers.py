import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import language, quality, rows, toxicity, workers
from lexmill.llm.rows import fitting, remainder, sample_texts


def prose(rng, n, words="the of and to in that was his with for had not are but from have they which one you".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "", "ly", "ing", "ed"]) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def judged(spark):
    """Clean and broken texts with their labels."""
    rng = random.Random(1)
    rows = []
    for i in range(300):
        good = i % 4 > 0
        text = prose(rng, rng.randint(5, 300))
        broken = text.upper().replace(" ", "!! ") if i % 8 else "spam " * rng.randint(10, 200)
        rows.append((i, text if good else prose(rng, 10) + "\n" + broken, int(good)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")


def test_quality_on_held_out_rows(judged):
    docs, labels = judged
    model = quality.fit(docs, labels, remainder("doc_id", 5) != 0, epochs=12)
    scored = quality.score(docs, model).filter(remainder("doc_id", 5) == 0).join(labels, "doc_id")
    assert scored.filter((F.col("score") >= 0.3).cast("int") == F.col("quality")).count() >= 0.9 * scored.count()


def test_quality_reads_whole_texts_alone():
    rng = np.random.default_rng(0)
    model = quality.QualityModel(rng.normal(size=(quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), np.zeros(quality.FILTERS, np.float32), rng.normal(size=2 * quality.FILTERS).astype(np.float32), 0.1)
    texts = ["", None, "é", "a" * 63, "ab" * 5000 + "🙂", "word " * 100, "tail" * 64]

    def plain(text):
        raw = (text or "").encode()
        blocks = -(-(len(raw) + quality.WIDTH - 1) // quality.BLOCK)
        raw = np.frombuffer((bytes(quality.WIDTH - 1) + raw).ljust(blocks * quality.BLOCK + quality.WIDTH - 1, b"\0"), np.uint8)
        response = np.array([sum(model.tables[j][raw[p + j]] for j in range(quality.WIDTH)) for p in range(blocks * quality.BLOCK)])
        step, size = quality.STRIDE * quality.BLOCK, quality.CHUNK * quality.BLOCK
        chunks = max(1, -(-(blocks - 1) // quality.STRIDE))
        tops = np.maximum([response[c * step : c * step + size].max(axis=0) for c in range(chunks)], 0)
        z = np.concatenate([tops.mean(axis=0), tops.max(axis=0)]) @ model.head + model.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    assert np.allclose(model.scores(texts), [plain(t) for t in texts], atol=1e-5)


def test_quality_learns_as_it_scores():
    """Pooling over all chunks of a batch, as in fitting, equals pooling text by text."""
    rng = np.random.default_rng(3)
    model = quality.QualityModel(rng.normal(size=(quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), rng.normal(size=quality.FILTERS).astype(np.float32), rng.normal(size=2 * quality.FILTERS).astype(np.float32), 0.1)
    texts = ["", "é", "a" * 60, "a" * 61, "ab" * 5000 + "🙂", "word " * 100, "tail" * 64, "x" * (quality.PIECE + 3)]
    raw, first = quality.laid_out(texts)
    maxima, places = quality.block_maxima(model.tables, raw, places=True)
    blocks, chunks = quality.chunk_blocks(first)
    tops = np.maximum(maxima[blocks].max(axis=1) + model.bias, 0)
    pooled = np.array([np.concatenate([t.mean(axis=0), t.max(axis=0)]) for t in np.split(tops, np.cumsum(chunks)[:-1])])
    assert np.allclose(1 / (1 + np.exp(-np.clip(pooled @ model.head + model.shift, -30, 30))), model.scores(texts), atol=1e-5)
    there = sum(model.tables[j][raw[places + j], np.arange(quality.FILTERS)] for j in range(quality.WIDTH))
    assert np.allclose(there, maxima, atol=1e-5)


def test_quality_learns_what_lies_anywhere_in_a_text(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        words = prose(rng, 700).split()
        if i % 2:  # 40 characters of some 3,500
            words.insert(rng.randint(0, 700), "#!" * 20)
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels, remainder("doc_id", 5) != 0, epochs=8)
    scored = quality.score(docs, model).filter(remainder("doc_id", 5) == 0).collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 2 == 0) for r in scored]) > 0.95


def test_samples_are_whole_texts_within_their_bounds(spark):
    assert fitting([5, 3, 9, 2], 10) == [0, 1, 3] and fitting([7, 6, 8], 5) == [1] and fitting([], 5) == []
    rows = [(i, i % 2, "ab" * (i + 1)) for i in range(50)] + [(3, 1, "ab" * 4)] * 5 + [(3, 1, "another text of id 3"), (99, 2, "z" * 10**5)]
    df = spark.createDataFrame(rows, "doc_id long, label int, text string")
    got = sample_texts(df, F.col("label"), 12, 300, 1)
    assert got == sample_texts(df.repartition(7), F.col("label"), 12, 300, 1)
    assert {(r.doc_id, r.label, r.text) for r in got} <= set(rows) and len({tuple(r) for r in got}) == len(got)
    for label in (0, 1):
        own = [r for r in got if r.label == label]
        assert 1 < len(own) <= 12 and sum(len(r.text) for r in own) <= 300
    assert [len(r.text) for r in got if r.label == 2] == [10**5]
    assert sample_texts(df.limit(0), F.lit(0), 5, 5, 1) == []


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_of_awkward_rows(spark, documents, awkward, module):
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(awkward)
    model = module.fit(docs, nothing, remainder("doc_id", 5) != 0)
    rows = module.score(docs, model).collect()
    assert sorted((r.doc_id or 0 for r in rows)) == sorted(i or 0 for i, _ in awkward)
    assert all(0 <= r.score <= 1 for r in rows)
    assert module.score(documents([]), model).count() == 0
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1), (6, 1, 1), (6, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    model = module.fit(docs, odd, F.lit(True))
    assert all(0 <= r.score <= 1 for r in module.score(docs, model).collect())


def test_toxicity_from_positives_and_unlabelled(spark):
    rng = random.Random(2)
    bad = ["idiotic", "scummer", "moronly"]
    rows = []
    for i in range(1500):
        words, toxic = prose(rng, rng.randint(10, 120)).split(), i % 9 == 0
        for _ in range(rng.randint(1, 3) if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, remainder("doc_id", 5) != 0)
    scored = {r.doc_id: r.score >= 0.5 for r in toxicity.score(docs, model).filter(remainder("doc_id", 5) == 0).collect()}
    assert np.mean([scored[i] == bool(y) for i, _, y in rows if i in scored]) > 0.97


def test_negative_risk_is_kept_from_falling_below_zero():
    rng = np.random.default_rng(0)
    # more positives claimed than the unlabelled sample has: the plain estimate would fall below zero
    p = np.hstack([np.ones((50, 1)), rng.integers(0, 2, (50, 20))]).astype(np.float32)
    u = np.hstack([np.zeros((500, 1)), rng.integers(0, 2, (500, 20))]).astype(np.float32)
    w, b = toxicity.non_negative(p, u, 0.4)
    s = 1 / (1 + np.exp(-(u @ w + b)))
    assert s.mean() - 0.4 * (1 / (1 + np.exp(-(p @ w + b)))).mean() > -0.05


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    k, lengths = 3, np.array([1, 4, 2, 3])
    scores, step, begin = rng.normal(size=(lengths.sum(), k)), rng.normal(size=(k, k)), rng.normal(size=k)
    marginals, moves, first = language.forward_backward(scores, lengths, step, begin)
    want, want_moves, want_first, at = np.zeros_like(scores), np.zeros((k, k)), np.zeros(k), 0
    for n in lengths:
        paths = list(itertools.product(range(k), repeat=int(n)))
        z = np.exp([begin[p[0]] + sum(scores[at + i, c] for i, c in enumerate(p)) + sum(step[a, b] for a, b in zip(p, p[1:])) for p in paths])
        for p, share in zip(paths, z / z.sum()):
            want_first[p[0]] += share
            for i, c in enumerate(p):
                want[at + i, c] += share
            for a, b in zip(p, p[1:]):
                want_moves[a, b] += share
        at += n
    assert np.allclose(marginals, want) and np.allclose(moves, want_moves) and np.allclose(first, want_first)


def test_language_on_held_out_and_mixed_texts(spark, documents, awkward):
    rng = random.Random(3)
    de = "der die und das ist nicht ein eine auf mit sich für über schön heit keit ung".split()
    rows = [(i, prose(rng, 40) if i % 2 else prose(rng, 40, de), "en" if i % 2 else "de") for i in range(300)]
    docs = spark.createDataFrame(rows + [(999, None, "en"), (998, "x", None), (None, "y", "en")], "doc_id long, text string, lang string")
    model = language.fit(docs, remainder("doc_id", 4) != 2)
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if i]) > 0.98
    assert got[999].lang_pred == "und" and got[999].score == 0
    mixed = prose(rng, 30) + " " + prose(rng, 90, de)
    share = model.shares([mixed])[0]
    assert 0.6 < share[0] < 0.9  # three words in four are German
    out = {r.doc_id: r for r in language.identify(documents(awkward), model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3, 8)] == ["und"] * 4 and out[6].lang_pred in model.languages
    assert language.identify(documents([]), model).count() == 0
    nobody = language.fit(docs, F.lit(False))
    assert {r.lang_pred for r in language.identify(docs, nobody).collect()} == {"und"}


def test_rare_languages_are_learned(spark):
    """Of 4,000 documents three are in a language of its own, and the sample holds 60."""
    rng = random.Random(8)
    fi = "ja on ei se että hän oli mutta kun niin joka sitten vain myös nyt kuin".split()
    rows = [(i, prose(rng, 20), "en") for i in range(4000)] + [(5000 + i, prose(rng, 60, fi), "fi") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, F.lit(True), rows=60)
    assert model.languages == ["en", "fi"]
    assert model.predictions([prose(rng, 30, fi), prose(rng, 30)])[0] == ["fi", "en"]


def test_language_scores_of_documents_recomputed_plainly():
    """A text's score, by enumerating the paths of each of its lines."""
    rng = random.Random(9)
    de = "der die und das ist nicht ein eine".split()
    model = language.train([(prose(rng, 20), "en") for _ in range(20)] + [(prose(rng, 20, de), "de") for _ in range(20)], 5)
    text = "the 12 und of\n... \ndas is\n\nthey"
    share = np.zeros(2)
    for line in text.split("\n"):
        own = [language.letters(w) for w in line.lower().split() if language.letters(w)]
        if not own:
            continue
        scores = language.emissions(language.word_features(own, model.lexicons), model.weights)
        paths = list(itertools.product(range(2), repeat=len(own)))
        z = np.exp([model.begin[p[0]] + sum(scores[i, c] for i, c in enumerate(p)) + sum(model.step[a, b] for a, b in zip(p, p[1:])) for p in paths])
        for p, q in zip(paths, z / z.sum()):
            share += np.bincount(p, minlength=2) * q
    names, score = model.predictions([text])
    assert names == [model.languages[share.argmax()]] and np.isclose(score[0], share.max() / share.sum())


@pytest.mark.parametrize("which", ["language", "quality"])
def test_columns_of_the_pipeline_drop_what_others_held_and_work_in_slices(which, monkeypatch):
    texts = ["the quick brown fox", None, "", "ein schneller brauner fuchs " * 9, "the dog"]
    if which == "language":
        model = language.train([("the quick brown fox", "en"), ("ein schneller brauner fuchs", "de")], 5)
        column, work, want = model.prediction_column, "predictions", list(zip(*model.predictions(texts)))
    else:
        model = quality.train(["the quick brown fox", "x0 x1 x2"], np.array([1, 0], np.float32), 1, 7)
        column, work, want = model.score_column, "scores", list(model.scores(texts))
    made = []
    monkeypatch.setattr(f"lexmill.llm.{which}.text_column", lambda text, make, ddl: made.append(make))
    column(None)
    monkeypatch.setattr(rows, "COLUMN_BYTES", 30)
    seen, plain = [], getattr(type(model), work)
    monkeypatch.setattr(type(model), work, lambda self, part: seen.append(len(part)) or plain(self, part))
    workers.held("another operator", dict)

    def batches():
        assert "another operator" not in workers._held
        yield pa.array(texts, pa.string())
        yield pa.array([], pa.string())

    found, empty = list(rows.sliced(made[0])(batches()))
    assert len(empty) == 0 and seen == [4, 1, 0]
    got = found.to_pylist()
    assert got == (pytest.approx(want) if which == "quality" else [{"lang_pred": n, "score": pytest.approx(s)} for n, s in want])
