"""Language identification by a linear-chain conditional random field over words.

Each line of a text is a chain of words, a very long one several chains of at
most CHAIN words. A word's features are its letters'
beginnings, endings and trigrams, the word itself and the lexicons it is in,
hashed to BUCKETS numbers; their weights per language are learned, and so are the
transitions between the languages of neighbouring words. Forward-backward gives
each word's probabilities, also in text that switches language; a document's
language has the largest sum, and its score is its share.

The field is fitted on the driver from a bounded sample of whole texts: at most
``SAMPLE_ROWS`` of together at most SAMPLE_CHARS characters, of which each
language gets the same share, so that rare languages are learned too. Only document languages are known, so words
start with their document's language; a field fitted on these relabels the words
of passages in another language, and the final field is fitted on the result.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.rows import map_text, only, sample_texts, slices, text_column
from lexmill.llm.workers import CACHE_LENGTH, held, trim

SAMPLE_ROWS = 1500
SAMPLE_CHARS = 2_250_000
BUCKETS = 1 << 16
LEXICON = 300  # words per language
AFFIXES = (1, 2, 3, 4)
UNDETERMINED = "und"
# Characters worked on at once, and words whose emissions a worker keeps.
SLICE = 1 << 19
CACHED_WORDS = 100_000
# New words whose features are worked out at once.
NEW_WORDS = 1 << 13
CHAIN = 200


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def _bucket(code: np.ndarray, kind: int) -> np.ndarray:
    """Numbers from 0 to BUCKETS - 1 for the codes of one kind of feature."""
    mixed = (code.astype(np.uint64) * np.uint64(64) + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(48)).astype(np.int64) % BUCKETS


def word_features(words: list[str], lexicons: dict[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words made of letters, word after word, and each word's number of them.

    Beginnings, endings and trigrams are those of the UTF-8 bytes, trigrams with a mark at either end.
    """
    raw = [w.encode() for w in words]
    size = np.array([len(r) for r in raw], np.int64)
    start = np.cumsum(size + 2) - size - 1  # of the first byte, behind a mark
    flat = np.frombuffer(b"".join(b"^" + r + b"$" for r in raw), np.uint8).astype(np.int64)
    owner = np.arange(len(words))
    owners, ids = [owner], [_bucket(np.array([zlib.crc32(r) for r in raw], np.int64), 0)]
    middle = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    owners.append(np.repeat(owner, size))
    ids.append(_bucket((flat[middle - 1] << 16) | (flat[middle] << 8) | flat[middle + 1], 1))
    head = tail = np.zeros(len(words), np.int64)
    for n in range(1, max(AFFIXES) + 1):
        own = np.flatnonzero(size >= n)
        head, tail = head.copy(), tail.copy()
        head[own] = (head[own] << 8) | flat[start[own] + n - 1]
        tail[own] = (tail[own] << 8) | flat[start[own] + size[own] - n]
        if n in AFFIXES:
            owners += [own, own]
            ids += [_bucket(head[own], 2 * n), _bucket(tail[own], 2 * n + 1)]
    known = np.array([i for i, w in enumerate(words) if w in lexicons], np.int64)
    owners.append(known)
    ids.append(_bucket(np.array([zlib.crc32(lexicons[words[i]].encode()) for i in known], np.int64), 20))
    owners, ids = np.concatenate(owners), np.concatenate(ids)
    return ids[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(words))


def emissions(features: tuple[np.ndarray, np.ndarray], weights: np.ndarray) -> np.ndarray:
    """Sum of the features' weights for each word; every word has some."""
    ids, counts = features
    if not len(counts):
        return np.zeros((0, weights.shape[1]), np.float32)
    return np.add.reduceat(weights[ids], np.cumsum(counts) - counts, axis=0)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, step: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of each word, and expected numbers of transitions and of first languages.

    ``scores`` has the words of all chains in a row, ``lengths`` the chains'
    lengths (at least 1). All chains advance together, longest first.
    """
    n, k = scores.shape
    if not n:
        return np.zeros((0, k)), np.zeros((k, k)), np.zeros(k)
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    longest = int(lengths.max())
    active = np.searchsorted(-lengths[order], -np.arange(longest), "left")  # chains longer than t
    p = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    a = np.exp(step)
    alpha, beta = np.empty((n, k)), np.empty((n, k))
    now = p[starts] * np.exp(begin)
    now /= now.sum(axis=1, keepdims=True)
    alpha[starts] = now
    for t in range(1, longest):
        rows = starts[: active[t]] + t
        now = p[rows] * (now[: active[t]] @ a)
        now /= now.sum(axis=1, keepdims=True)
        alpha[rows] = now
    moves = np.zeros((k, k))
    back = np.ones((active[longest - 1], k))
    beta[starts[: active[longest - 1]] + longest - 1] = back
    for t in range(longest - 2, -1, -1):
        m = active[t + 1]
        rows = starts[:m] + t
        onward = p[rows + 1] * back
        pairs = alpha[rows][:, :, None] * a * onward[:, None, :]
        moves += (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back = onward @ a.T
        back /= back.sum(axis=1, keepdims=True)
        if active[t] > m:
            back = np.concatenate([back, np.ones((active[t] - m, k))])
        beta[starts[: active[t]] + t] = back
    marginals = alpha * beta
    marginals /= marginals.sum(axis=1, keepdims=True)
    return marginals, moves, marginals[starts].sum(axis=0)


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages
    step: np.ndarray
    begin: np.ndarray
    lexicons: dict[str, str]

    def _memo(self) -> dict:
        """What the worker knows of this model's words."""
        return held(("emissions", zlib.crc32(self.weights.tobytes()), zlib.crc32(self.step.tobytes()), tuple(self.languages)), dict)

    def _emissions(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The worker's table of emissions, and its rows of the words; row 0 is for words without letters."""
        memo = self._memo()
        if not memo or len(memo["rows"]) > CACHED_WORDS:
            memo.update(rows={}, table=np.zeros((1, len(self.languages)), np.float32))
        rows = memo["rows"]
        new = list(set(words) - rows.keys())
        if new:
            # words that differ in other signs than letters only share a row
            plain = [letters(w) for w in new]
            unseen = [w for w in dict.fromkeys(plain) if w and w not in rows]
            at = len(memo["table"])
            parts = [unseen[i : i + NEW_WORDS] for i in range(0, len(unseen), NEW_WORDS)]
            memo["table"] = np.concatenate([memo["table"], *[emissions(word_features(p, self.lexicons), self.weights) for p in parts]])
            rows.update(zip(unseen, range(at, at + len(unseen))))
            rows[""] = 0
            rows.update((w, rows[p]) for w, p in zip(new, plain))
        found = np.fromiter(map(rows.__getitem__, words), np.int64, len(words))
        for word in new:
            if len(word) > CACHE_LENGTH:
                rows.pop(word, None)
                rows.pop(letters(word), None)
        return memo["table"], found

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """Share of each language among the words of each text; zeros without a letter."""
        out = np.zeros((len(texts), len(self.languages)))
        if not self.languages:
            return out
        for part in slices(texts, SLICE):
            words, lengths, owners = [], [], []
            for i, text in enumerate(texts[part], part.start):
                for line in (text or "").lower().split("\n"):
                    own = line.split()
                    words += own
                    for at in range(0, len(own), CHAIN):
                        lengths.append(min(CHAIN, len(own) - at))
                        owners.append(i)
            if not words:
                continue
            table, rows = self._emissions(words)
            spoken = rows > 0
            chain = np.repeat(np.arange(len(lengths)), lengths)[spoken]
            sizes = np.bincount(chain, minlength=len(lengths))
            marginals, _, _ = forward_backward(table[rows[spoken]], sizes[sizes > 0], self.step, self.begin)
            np.add.at(out, np.array(owners)[chain], marginals)
        total = out.sum(axis=1, keepdims=True)
        return np.divide(out, total, out=np.zeros_like(out), where=total > 0)

    def predictions(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score; equal shares go to the language that comes first."""
        shares = self.shares(texts)
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        best = shares.argmax(axis=1)
        score = shares[np.arange(len(best)), best]
        return [self.languages[b] if s > 0 else UNDETERMINED for b, s in zip(best, score)], score.tolist()

    def prediction_column(self, text: Column) -> Column:
        """Struct of lang_pred and score."""
        model = self

        def make():
            model._memo()

            def predict(texts: list[str | None]) -> pa.Array:
                names, score = model.predictions(texts)
                return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])

            return predict

        return text_column(text, make, "lang_pred string, score double")


def fit(
    docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, seed: int = 5,
) -> LanguageModel:
    """Fit on whole texts of documents with text and language for which ``learn``, a condition on doc_id, holds.

    Each language has the same share of at most ``rows`` documents and ``chars`` characters,
    at least one document. A text beyond its language's share of characters is learned from
    only where the language has no shorter one. Equal rows count once. Without any such document every text is undetermined.
    """
    known = only(docs, doc_id=id_col, text=text_col, label=lang_col).filter("doc_id is not null and text is not null and label is not null").filter(learn)
    # a row per language, as the model has columns
    totals = only(docs, doc_id=id_col, label=lang_col).filter("doc_id is not null and label is not null").filter(learn)
    totals = totals.groupBy("label").agg(F.approx_count_distinct("doc_id").alias("ids")).collect()
    if not totals:
        return train([], seed)
    rows, chars = max(1, rows // len(totals)), chars // len(totals)
    # of a language with many documents only those below a bound of the hash, about four times its share, are looked at
    bounds = [(r["label"], min((4 * rows + 40) * 2**64 // max(r["ids"], 1), 2**64 - 1) - 2**63) for r in totals]
    bounds = F.broadcast(docs.sparkSession.createDataFrame(bounds, known.select("label", F.lit(0).cast("bigint").alias("bound")).schema))
    near = known.join(bounds, "label").filter(F.xxhash64(F.lit(seed), "doc_id") <= F.col("bound")).drop("bound")
    model = train([(r["text"], r["label"]) for r in sample_texts(near, F.col("label"), rows, chars, seed)], seed)
    trim()  # the driver has its JVM beside it
    return model


def train(sample: list[tuple[str, str]], seed: int, epochs: int = 4) -> LanguageModel:
    languages = sorted({lang for _, lang in sample})
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)), np.zeros(0), {})
    chains, y = [], []
    for text, lang in sample:
        for line in text.lower().split("\n"):
            own = [w for w in line.split() if letters(w)]
            if own:
                chains.append(own)
                y.append(languages.index(lang))
    lexicons = _lexicons(chains, y, languages)
    index: dict[str, int] = {}
    words = [np.array([index.setdefault(w, len(index)) for w in own]) for own in chains]
    ids, counts = word_features(list(map(letters, index)), lexicons)
    features = np.split(ids, np.cumsum(counts)[:-1])
    labels = [np.full(len(own), lang) for own, lang in zip(words, y)]
    model = _field(words, labels, features, languages, lexicons, seed, epochs)
    # words of passages in another language: the field's own opinion, with the document's language as a weak hint
    hinted = []
    for own, lang in zip(words, y):
        scores = emissions(_together(features, own), model.weights)
        scores[:, lang] += 0.5
        stay = np.where(np.eye(len(languages), dtype=bool), 0.0, -4.0)
        hinted.append(forward_backward(scores, np.array([len(own)]), stay, np.zeros(len(languages)))[0].argmax(axis=1))
    return _field(words, hinted, features, languages, lexicons, seed, epochs)


def _lexicons(chains: list[list[str]], y: list[int], languages: list[str]) -> dict[str, str]:
    """The LEXICON most frequent words of each language that are mostly its own."""
    counts: dict[str, Counter] = defaultdict(Counter)
    for own, lang in zip(chains, y):
        counts[languages[lang]].update(map(letters, own))
    total = sum(counts.values(), Counter())
    out = {}
    for lang, own in counts.items():
        mine = [(n, w) for w, n in own.items() if n > 0.6 * total[w] and n > 2]
        out.update((w, lang) for _, w in sorted(mine, reverse=True)[:LEXICON])
    return out


def _together(features: list[np.ndarray], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = [features[i] for i in words]
    return np.concatenate(own), np.array([len(f) for f in own])


def _field(words, labels, features, languages, lexicons, seed: int, epochs: int, batch: int = 64, rate: float = 0.3) -> LanguageModel:
    """Maximum likelihood by Adagrad; a small weight decay keeps the transitions finite."""
    rng, k = np.random.default_rng(seed), len(languages)
    w, sq = np.zeros((BUCKETS, k), np.float32), np.full((BUCKETS, k), 1e-2, np.float32)
    step, begin, sq_step, sq_begin = np.zeros((k, k)), np.zeros(k), np.ones((k, k)), np.ones(k)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(words)), max(1, len(words) // batch)):
            ids, gold = np.concatenate([words[i] for i in rows]), np.concatenate([labels[i] for i in rows])
            lengths = np.array([len(words[i]) for i in rows])
            distinct, back = np.unique(ids, return_inverse=True)
            flat, counts = _together(features, distinct)
            marginals, moves, first = forward_backward(emissions((flat, counts), w)[back], lengths, step, begin)
            wrong = -marginals
            wrong[np.arange(len(gold)), gold] += 1
            per_word = np.zeros((len(distinct), k))
            np.add.at(per_word, back, wrong)
            g = np.repeat(per_word, counts, axis=0)
            used, at = np.unique(flat, return_inverse=True)
            grad = np.stack([np.bincount(at, g[:, c], len(used)) for c in range(k)], axis=1) / len(rows)
            sq[used] += grad**2
            w[used] += rate * grad / np.sqrt(sq[used])
            ends = np.cumsum(lengths)
            inner = np.ones(len(gold), bool)
            inner[ends - 1] = False
            seen = np.zeros((k, k))
            np.add.at(seen, (gold[:-1][inner[:-1]], gold[1:][inner[:-1]]), 1)
            d_step = (seen - moves) / len(rows) - 1e-2 * step
            d_begin = (np.bincount(gold[ends - lengths], minlength=k) - first) / len(rows) - 1e-2 * begin
            sq_step += d_step**2
            sq_begin += d_begin**2
            step, begin = step + rate * d_step / np.sqrt(sq_step), begin + rate * d_begin / np.sqrt(sq_begin)
    return LanguageModel(languages, w, step, begin, lexicons)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score. A null text, or one without a letter, is ``und`` with score 0.

    Repeated rows and null ids each get their own row; other columns are left
    out; an empty table gives an empty result.
    """
    df = only(docs, doc_id=id_col, text=text_col)
    fields = {"lang_pred": pa.string(), "score": pa.float64()}
    return map_text(df, "text", lambda: model.predictions, fields, "lang_pred string, score double")
