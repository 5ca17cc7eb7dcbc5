"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positive sample, plain documents the unlabelled
one. With class prior q, the risk of a classifier g is estimated as

    q E_P[l(g)] + max(0, E_U[l(-g)] - q E_P[l(-g)])

where the second part, the risk on the unknown negatives, is kept from falling
below zero: where it would, the step goes against its gradient. Features are
whether a document has a word, or a word with a certain beginning, hashed to
BUCKETS numbers; those frequent among positives and clearly more so than in the
unlabelled text are used, scaled to length one so that one toxic word weighs as
much in a long document as several do. Several classifiers, each fitted on a different half of
the sample, are averaged.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.rows import map_text, only, sample_rows
from lexmill.llm.workers import Cache, held

BUCKETS = 1 << 18
POSITIVE_ROWS = 3000
UNLABELLED_ROWS = 6000
BEGINNINGS = (4, 5, 6)
CLASSIFIERS = 3


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of a word in lower case without the signs around it."""
    word = word.strip(".,;:!?\"'()[]{}*#%$&|-_")
    if not word:
        return ()
    names = ["w " + word] + [f"{n} {word[:n]}" for n in BEGINNINGS if len(word) >= n]
    return tuple(zlib.crc32(n.encode()) % BUCKETS for n in names)


def document_features(text: str | None, of: Cache) -> set[int]:
    return set(chain.from_iterable(map(of.__getitem__, set((text or "").lower().split()))))


@dataclass
class ToxicityModel:
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -4.0

    def _words(self) -> Cache:
        """Features of words among the weighted ones, kept per worker and model."""
        key = ("selected", self.bias, tuple(sorted(self.weights.items())))
        return held(key, lambda: Cache(lambda word: tuple(f for f in word_features(word) if f in self.weights)))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        words = self._words()
        found = [sorted(document_features(t, words)) for t in texts]
        total = [self.bias + sum(map(self.weights.__getitem__, f)) / len(f) ** 0.5 if f else self.bias for f in found]
        return 1 / (1 + np.exp(-np.clip(np.array(total, np.float64), -30, 30)))


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS, prior: float | None = None, lift: float = 4.0, seed: int = 11,
) -> ToxicityModel:
    """Fit from the ids that ``labels`` confirms as toxic (1) and unlabelled documents.

    ``learn`` is a condition on doc_id for both samples, which have at most
    ``positive_rows`` and ``unlabelled_rows`` rows. ``prior`` is the share of toxic
    documents; unless given, it is their share of the labelled rows that may be
    learned from. Without a confirmed row every score is that of a document
    without features, close to 0.
    """
    known = only(labels, doc_id=id_col, label=label_col).filter("doc_id is not null and label is not null").filter(learn)
    n, n_toxic = known.agg(F.count(F.lit(1)), F.count_if(F.col("label") == 1)).first()
    if not n_toxic:
        return ToxicityModel()
    prior = n_toxic / n if prior is None else prior
    prior = min(max(prior, 1e-4), 0.9)
    texts = only(docs, doc_id=id_col, text=text_col)
    chosen = sample_rows(known.filter("label = 1").select("doc_id"), "doc_id", positive_rows, seed).withColumn("positive", F.lit(1))
    free = sample_rows(texts.select("doc_id").filter("doc_id is not null").filter(learn), "doc_id", unlabelled_rows, seed)
    chosen = chosen.unionByName(free.withColumn("positive", F.lit(0))).distinct()
    # at most positive_rows + unlabelled_rows ids are broadcast
    sample = texts.join(F.broadcast(chosen), "doc_id")

    def make():
        of = held("word features", lambda: Cache(word_features))
        return lambda ts: ([sorted(document_features(t, of)) for t in ts],)

    sample = map_text(sample, "text", make, {"features": pa.list_(pa.int64())}, "features array<long>")
    sample = sample.cache()
    try:
        size = dict(sample.groupBy("positive").count().collect())
        counts = sample.select("positive", F.explode("features").alias("f")).groupBy("f").agg(F.sum("positive").alias("p"), F.count_if(F.col("positive") == 0).alias("u"))
        rate = F.col("p") / size.get(1, 1)
        counts = counts.filter((F.col("p") >= 5) & (rate >= lift * F.col("u") / max(size.get(0, 0), 1)))
        names = sorted(r.f for r in counts.collect())  # at most BUCKETS
        if not names or not size.get(0):
            return ToxicityModel()
        wanted = F.array(*[F.lit(f) for f in names])
        rows = sample.select("doc_id", "positive", F.array_intersect("features", wanted).alias("f")).toPandas()
    finally:
        sample.unpersist()
    rows = rows.sort_values(["positive", "doc_id"]).reset_index(drop=True)
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)), np.float32)
    for i, own in enumerate(rows["f"]):
        x[i, [at[f] for f in own]] = 1 / max(1, len(own)) ** 0.5
    positive, free = x[rows["positive"] == 1], x[rows["positive"] == 0]
    rng = np.random.default_rng(seed)
    half = lambda a: a[np.sort(rng.permutation(len(a))[: max(1, (len(a) + 1) // 2)])]
    fitted = [non_negative(half(positive), half(free), prior) for _ in range(CLASSIFIERS)]
    weights, bias = (np.mean(part, axis=0) for part in zip(*fitted))
    return ToxicityModel({f: float(w) for f, w in zip(names, weights)}, float(bias))


def non_negative(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 800, rate: float = 0.05, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Linear classifier minimising the non-negative risk with the sigmoid loss, by Adam.

    The sigmoid loss is bounded: a few positives far on their side cannot outweigh
    the whole unlabelled sample in the estimated risk on the negatives.
    """
    w, m, v = np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1)
    p, u = (np.hstack([a, np.ones((len(a), 1), np.float32)]).astype(np.float64) for a in (p, u))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        sp, su = sigmoid(p @ w), sigmoid(u @ w)
        negative = su.mean() - prior * sp.mean()
        d_positive = p.T @ (sp * (1 - sp)) / len(p)
        d_negative = u.T @ (su * (1 - su)) / len(u) - prior * d_positive
        d = d_negative - prior * d_positive if negative >= 0 else -d_negative
        d[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], w[-1]


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: toxic likelier). Null and empty texts get the score of a text without features.

    Repeated rows and null ids each get their own row; other columns are left
    out; an empty table gives an empty result.
    """
    df = only(docs, doc_id=id_col, text=text_col)
    return map_text(df, "text", lambda: lambda texts: (model.scores(texts),), {"score": pa.float64()}, "score double")
