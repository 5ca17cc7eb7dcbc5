import random
import re

import numpy as np
import pandas as pd
import pytest

from lexmill.llm import embedding_dups, minhash, neighbours
from lexmill.llm.components import components
from lexmill.llm.shingles import shingle_sets
from lexmill.storage import materialize, measured_joins


def smallest(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("links", [[], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 200)], None, [(5, 5), (None, 1), (7, 3), (3, 7)]])
def test_components(spark, links):
    rng = random.Random(4)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] if links is None else links
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert got == smallest({n for pair in real for n in pair}, real)


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def test_shingle_sets_equal_sets_of_words():
    rng = random.Random(5)
    texts = ["", None, " \n", "a", "A", "a b", "a b", "É é", "a b c a b c", "ab c", "a bc"]
    texts += [" ".join(rng.choice("abcdeF") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for width in (1, 2, 5):
        own = [frozenset(s.tolist()) for s in shingle_sets(texts, width)]
        plain = [shingles(t, width) for t in texts]
        assert [len(s) for s in own] == [len(s) for s in plain]
        # equal sets, and equal sizes of intersections, whatever the hashes are
        for i in range(0, len(texts), 7):
            for j in range(len(texts)):
                assert len(own[i] & own[j]) == len(plain[i] & plain[j])


def family(rng, size, edits, words=120):
    start = [f"w{rng.randint(0, 5000)}" for _ in range(words)]
    out = []
    for _ in range(size):
        text = list(start)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(words)] = f"v{rng.randint(0, 10**6)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("hub_chars", [minhash.HUB_CHARS, 2000])
def test_near_duplicates_equal_brute_force(documents, awkward, monkeypatch, hub_chars):
    monkeypatch.setattr(minhash, "HUB_CHARS", hub_chars)
    rng = random.Random(6)
    texts = family(rng, 60, 8) + family(rng, 30, 25) + family(rng, 5, 2, 6) + family(rng, 40, 0) + [f"only {i} here" for i in range(20)]
    rng.shuffle(texts)
    rows = awkward + [(100 + i, t) for i, t in enumerate(texts)] + [(100, texts[0])]
    got = minhash.near_duplicates(documents(rows), width=2).collect()
    own = {i: shingles(t, 2) for i, t in rows if i is not None}
    ids = sorted(own)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if own[a] and own[b] and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b])]
    want = smallest(ids, links)
    assert len(links) > 1000 and len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(own[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_lists_are_searched_again_for_pairs_without_the_hub(documents):
    """A chain: its ends are no pair, so the smallest document of a list confirms only some of it."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(200)]
    chain, texts = list(base), []
    for k in range(8):
        texts.append(" ".join(chain))
        for i in range(k * 12, k * 12 + 12):
            chain[i] = f"n{k}x{i}"
    order = list(range(8))
    rng.shuffle(order)
    rows = [(order[k], t) for k, t in enumerate(texts)]
    got = minhash.near_duplicates(documents(rows), width=1).collect()
    assert {r.component_id for r in got} == {0}


def test_rows_that_share_an_id_link_through_either_text(documents):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, a), (2, a), (2, b), (3, b), (4, "none of these words at all")]
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(documents(rows), width=2).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_rows_that_share_an_id_link_with_near_copies_of_each_text(documents):
    rng = random.Random(11)
    texts = [[f"{c}{rng.randint(0, 10**6)}" for _ in range(80)] for c in "abcdef"]
    near = [" ".join(t[:40] + ["changed"] + t[41:]) for t in texts]
    # one id has four of the texts; whichever has the smallest set id, near copies of all are found
    rows = [(7, " ".join(t)) for t in texts[:4]] + [(10 + k, n) for k, n in enumerate(near)] + [(20, " ".join(texts[5]))]
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(documents(rows), width=2).collect()}
    assert got == {(7, 7), (10, 7), (11, 7), (12, 7), (13, 7), (14, 14), (15, 15), (20, 15)}


def broadcasts(df):
    return str(df._jdf.queryExecution().executedPlan()).count("BroadcastExchange")


def test_near_duplicates_broadcast_nothing_by_its_expected_size(spark, documents, monkeypatch):
    # tables so small that the optimiser would broadcast each of them, as it would exploded signatures of any number
    rng = random.Random(5)
    docs = documents(list(enumerate(family(rng, 30, 2) + [" ".join(rng.choices("abcdefgh", k=40)) for _ in range(30)])))
    planned = {}
    monkeypatch.setattr(minhash, "materialize", lambda df, name: planned.update({name: broadcasts(df)}) or materialize(df, name))
    result = minhash.near_duplicates(docs, width=2)
    assert {"prefix_postings", "hub_pairs", "hub_links", "families"} <= planned.keys()
    marked = planned.pop("wanted_texts")  # ids whose number was counted
    assert set(planned.values()) == {0} and marked <= 1 and broadcasts(result) == 0
    seen = []
    monkeypatch.setattr("lexmill.llm.components.materialize", lambda df, name: seen.append(broadcasts(df)) or materialize(df, name))
    components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"))
    assert len(seen) > 1 and not any(seen)


@pytest.mark.parametrize("own", [None, "5m"])
def test_settings_of_joins_come_back(spark, own):
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    if own:
        spark.conf.set(names[1], own)
    try:
        before = [spark.conf.get(n, None) for n in names]
        with pytest.raises(ValueError), measured_joins(spark):
            with measured_joins(spark):
                assert spark.conf.get(names[0]) == "-1"
            assert (spark.conf.get(names[0]), spark.conf.get(names[1])) == ("-1", own or spark.conf.get(names[1]))
            raise ValueError
        assert [spark.conf.get(n, None) for n in names] == before
    finally:
        spark.conf.unset(names[1])


def test_near_duplicates_of_nothing(documents):
    assert minhash.near_duplicates(documents([])).count() == 0
    assert [r.kept for r in minhash.near_duplicates(documents([(1, None)])).collect()] == [True]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, score string")


def odd_vectors(d):
    return [(9001, None), (9002, [0.0] * d), (9003, [float("nan")] + [1.0] * (d - 1)), (9004, [float("inf")] * d), (9005, [None] + [1.0] * (d - 1)), (9006, [1.0, 2.0]), (9007, []), (None, [1.0] * d)]


def clustered(seed, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(400, d))
    x = np.vstack([x, x[:60] + rng.normal(size=(60, d)) * 0.1, x[[5] * 150] + rng.normal(size=(150, d)) * 0.05, x[[7] * 40]]).astype(np.float32)
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("block", [embedding_dups.BLOCK, 60])
def test_embedding_duplicates_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dups, "BLOCK", block)
    x = clustered(8)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = embedding_dups.near_duplicates(vectors(spark, rows + odd_vectors(16) + rows[:3])).collect()
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    n = {r.vec_id: r.n_links for r in got}
    assert all(n[i] <= link[i].sum() for i in range(len(x)))
    assert sum(n[i] for i in range(len(x))) >= 0.99 * link.sum()
    want = smallest(range(len(x)), zip(*np.nonzero(link)))
    wrong = [r for r in got if r.vec_id is not None and r.vec_id < 9000 and r.component_id != want[r.vec_id]]
    assert len(wrong) <= 5 and len(got) == len(rows) + 8 + 3
    for r in got:
        if r.vec_id is None or r.vec_id > 9000:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, r.vec_id is not None)


def test_embedding_duplicates_of_little(spark):
    assert embedding_dups.near_duplicates(vectors(spark, [])).count() == 0
    assert [tuple(r) for r in embedding_dups.near_duplicates(vectors(spark, [(3, [1.0, 2.0])])).collect()] == [(3, 0, 3, True)]
    assert embedding_dups.near_duplicates(vectors(spark, [(9001, None)])).first().kept
    same = embedding_dups.near_duplicates(vectors(spark, [(i, [1.0, 2.0, 3.0]) for i in range(5)])).collect()
    assert {(r.n_links, r.component_id) for r in same} == {(4, 0)}


def test_codes_are_balanced():
    x = np.random.default_rng(9).normal(size=(2000, 16)) * np.linspace(1, 4, 16) + 3
    codes = embedding_dups.fit_codes(x, 10**6, 0.95)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    share = ((unit - codes.mean) @ codes.axes > 0).mean(axis=0)
    assert codes.width == 12 and (np.abs(share - 0.5) < 0.1).all()


def one_direction(rng, n, d):
    """Vectors with an average cosine of 0.8."""
    noise = rng.normal(size=(n, d))
    return np.sqrt(0.8) * np.eye(d)[0] + np.sqrt(0.2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)


def hot_group(rng, n, d):
    """A third are near copies of one vector, at cosines of about 0.95 with each other."""
    noise = rng.normal(size=(n, d))
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    noise[: n // 3] = np.sqrt(0.95) * np.eye(d)[0] + np.sqrt(0.05) * noise[: n // 3]
    return noise


def close_to_the_mean(rng, n, d):
    """All but a few vectors in two opposite groups, so that the few are at no angle that codes show."""
    noise = rng.normal(size=(n, d))
    x = 3 * np.eye(d)[0] + np.where(np.arange(n) % 2, 1, -1)[:, None] * 3 * np.eye(d)[1] + 0.1 * noise
    x[:60] = 3 * np.eye(d)[0] + 0.1 * noise[:60]
    return x


@pytest.mark.parametrize("shape", [one_direction, hot_group, close_to_the_mean])
@pytest.mark.parametrize("n", [50_000, 10_000_000])
def test_codes_meet_at_the_threshold_wherever_the_mean_is(shape, n):
    rng = np.random.default_rng(2)
    x = shape(rng, 3000, 64)
    codes = embedding_dups.fit_codes(x, n, 0.95)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = rng.normal(size=x.shape)
    turn -= (turn * x).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * turn / np.linalg.norm(turn, axis=1, keepdims=True)
    met = (codes.keys(x) == codes.keys(y)).any(axis=1)
    a, b = codes.nearness(x), codes.nearness(y)
    met |= (np.maximum(a, b) == 2) & (np.minimum(a, b) > 0)
    assert (np.maximum(a, b) < 2).all() or (np.minimum(a, b)[np.maximum(a, b) == 2] > 0).all()
    assert 1 - met.mean() <= 1.5 * embedding_dups.MISS and 1 - met[: len(x) // 3].mean() <= 2 * embedding_dups.MISS
    assert codes.tables <= embedding_dups.MOST_TABLES


@pytest.mark.parametrize("shape", [one_direction, hot_group, close_to_the_mean])
def test_embedding_duplicates_away_from_a_mean_of_zero(spark, monkeypatch, shape):
    monkeypatch.setattr(embedding_dups, "BUCKET_ROWS", 8)  # so that codes are less work than all pairs
    monkeypatch.setattr(embedding_dups, "BLOCK", 100)
    rng = np.random.default_rng(4)
    x = shape(rng, 900, 24)
    turn = rng.normal(size=(300, 24))
    turn -= (turn * x[:300]).sum(axis=1, keepdims=True) * x[:300] / (x[:300] ** 2).sum(axis=1, keepdims=True)
    size = np.linalg.norm(x[:300], axis=1, keepdims=True)
    x = np.vstack([x, 0.955 * x[:300] + np.sqrt(1 - 0.955**2) * size * turn / np.linalg.norm(turn, axis=1, keepdims=True)]).astype(np.float32)
    got = embedding_dups.near_duplicates(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect()
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    n = {r.vec_id: r.n_links for r in got}
    assert all(n[i] <= link[i].sum() for i in range(len(x)))
    assert sum(n.values()) >= 0.985 * link.sum()


@pytest.mark.parametrize("part_rows, query_block", [(neighbours.PART_ROWS, 4096), (100, 30)])
def test_neighbours_against_brute_force(spark, monkeypatch, part_rows, query_block):
    monkeypatch.setattr(neighbours, "PART_ROWS", part_rows)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", query_block)
    x = clustered(10) * np.random.default_rng(1).uniform(0.5, 1.5, (650, 1)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = neighbours.search(vectors(spark, rows + odd_vectors(16) + rows[:3]), "vec_id % 5 = 0").collect()
    x = x.astype(np.float64)
    hits = 0
    for q in range(0, len(x), 5):
        score = (x * x[q]).sum(axis=1)
        top = [i for i in np.lexsort((np.arange(len(x)), -score)) if i != q][:20]
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert all(abs(s - score[i]) < 1e-12 for _, i, s in own)
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        hits += len(set(top) & {i for _, i, _ in own})
    assert hits >= 0.95 * 20 * len(range(0, len(x), 5)) and len(got) == 20 * len(range(0, len(x), 5))


def test_equal_scores_of_long_vectors_are_kept():
    rng = np.random.default_rng(12)
    for _ in range(20):
        x, q = rng.normal(size=(2, 64)) * 1e5
        frame = pd.DataFrame({"vec_id": np.arange(100), "v": [x.tolist()] * 100})
        asked = pd.DataFrame({"vec_id": [1000], "v": [q.tolist()], "floor": [(x * q).sum()]})
        index = neighbours.build(np.array([x, q]), float(max(np.linalg.norm(x), np.linalg.norm(q))), 100, 8, 13)
        got = neighbours.verify(asked, frame, index, 20, 1e9)
        assert sorted(got["vec_id"]) == list(range(20))


def test_neighbours_of_little(spark):
    assert neighbours.search(vectors(spark, []), "vec_id % 5 = 0").count() == 0
    got = neighbours.search(vectors(spark, [(i, [1.0, 1.0]) for i in range(30)]), "vec_id = 3").collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == [i for i in range(21) if i != 3]
    few = neighbours.search(vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])]), "vec_id = 0").collect()
    assert [(r.rank, r.vec_id, r.score) for r in few] == [(1, 1, 0.0)]


def test_chi_square():
    assert abs(neighbours.chi_square(15.507, 8) - 0.95) < 1e-4
    assert abs(neighbours.chi_square_quantile(0.95, 8) - 15.507) < 1e-3
