"""Quality classifier: a byte-level convolutional network in numpy.

A filter is a learned weight for each byte at each of WIDTH neighbouring
positions; its response anywhere is a sum of table look-ups. Responses are
computed at every byte of the document and max-pooled over overlapping chunks.
The mean and the maximum of the pooled responses over all chunks give one
probability, so both what is missing from a chunk (as in repeated text) and what
stands out in one counts.

The network is fitted on the driver from a bounded sample of whole texts: at
most ``SAMPLE_ROWS`` labelled rows of together at most ``SAMPLE_CHARS``
characters. Fitting pools over all their chunks, just as scoring does.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.rows import map_text, only, sample_rows, sample_texts, slices, text_column, utf8
from lexmill.llm.workers import held, trim

SAMPLE_ROWS = 4000
SAMPLE_CHARS = 8 << 20
WIDTH = 5
FILTERS = 16
CODE = 8  # numbers per byte that the filters see
BLOCK = 64
# a chunk is four blocks and begins three blocks after the one before
CHUNK, STRIDE = 4, 3
PIECE = 128 * BLOCK
# Characters worked on at once.
SLICE = 1 << 20


def laid_out(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as whole blocks of bytes, and each one's first block (one entry more than texts).

    WIDTH - 1 zero bytes come before each text, so that no response sees two texts.
    """
    raw, ends = utf8(texts)
    sizes = np.diff(ends)
    first = np.concatenate([[0], np.cumsum((sizes + WIDTH - 1 + BLOCK - 1) // BLOCK)])
    padded = np.zeros(first[-1] * BLOCK + WIDTH - 1, np.uint8)
    for i, size in enumerate(sizes):
        at = first[i] * BLOCK + WIDTH - 1
        padded[at : at + size] = raw[ends[i] : ends[i + 1]]
    return padded, first


def block_maxima(tables: np.ndarray, raw: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Largest responses in each block and, if asked for, where in ``raw`` they begin.

    ``raw`` has a multiple of BLOCK bytes and WIDTH - 1 more.
    """
    n = len(raw) - WIDTH + 1
    out, at_ = np.empty((n // BLOCK, FILTERS), np.float32), np.empty((n // BLOCK, FILTERS), np.int64) if places else None
    total, part = np.empty((PIECE, FILTERS), np.float32), np.empty((PIECE, FILTERS), np.float32)
    for at in range(0, n, PIECE):
        m = min(PIECE, n - at)
        np.take(tables[0], raw[at : at + m], axis=0, out=total[:m])
        for j in range(1, WIDTH):
            np.take(tables[j], raw[at + j : at + j + m], axis=0, out=part[:m])
            total[:m] += part[:m]
        blocks, rows = total[:m].reshape(-1, BLOCK, FILTERS), slice(at // BLOCK, (at + m) // BLOCK)
        blocks.max(axis=1, out=out[rows])
        if places:
            at_[rows] = blocks.argmax(axis=1) + np.arange(at, at + m, BLOCK)[:, None]
    return out, at_


@dataclass
class QualityModel:
    tables: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    head: np.ndarray  # for the mean and the maximum over chunks
    shift: float

    @staticmethod
    def unfitted() -> "QualityModel":
        """Without labels every score is one half."""
        zeros = np.zeros
        return QualityModel(zeros((WIDTH, 256, FILTERS), np.float32), zeros(FILTERS, np.float32), zeros(2 * FILTERS, np.float32), 0.0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """One probability per text, from all its bytes; an empty or null text is one block of zero bytes."""
        held("quality")
        out = np.empty(len(texts))
        for part in slices(texts, SLICE):
            raw, first = laid_out(texts[part])
            maxima, _ = block_maxima(self.tables, raw)
            pooled = np.array([self._pool(maxima[a:b]) for a, b in zip(first, first[1:])])
            out[part] = 1 / (1 + np.exp(-np.clip(pooled @ self.head + self.shift, -30, 30)))
        return out

    def _pool(self, maxima: np.ndarray) -> np.ndarray:
        chunks = max(1, -(-(len(maxima) - 1) // STRIDE))
        rows = np.full((chunks * STRIDE + CHUNK - STRIDE, FILTERS), -np.inf, np.float32)
        rows[: len(maxima)] = maxima
        tops = np.maximum(rows[: chunks * STRIDE].reshape(chunks, STRIDE, FILTERS).max(axis=1), rows[STRIDE::STRIDE])
        tops = np.maximum(tops + self.bias, 0)
        return np.concatenate([tops.mean(axis=0), tops.max(axis=0)])

    def score_column(self, text: Column) -> Column:
        model = self

        def make():
            held("quality")  # of what other operators held nothing is needed
            return lambda texts: pa.array(model.scores(texts), pa.float64())

        return text_column(text, make, "double")


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, epochs: int = 5, seed: int = 7,
) -> QualityModel:
    """Fit on whole texts of at most ``rows`` rows of ``labels`` (id, 0/1) for which ``learn``, a condition on doc_id, holds.

    Their texts have together at most ``chars`` characters; one longer than that is not learned from.
    Rows with a null id, label or text are left out; repeated rows count once.
    """
    wanted = only(labels, doc_id=id_col, label=label_col).filter("doc_id is not null and label is not null").filter(learn)
    wanted = sample_rows(wanted, "doc_id", rows, seed)
    texts = only(docs, doc_id=id_col, text=text_col).filter("text is not null")
    # at most ``rows`` rows of two numbers are broadcast
    found = sample_texts(texts.join(F.broadcast(wanted), "doc_id"), F.lit(0), rows, chars, seed)
    y = np.array([r["label"] for r in found], np.float32)
    if len(np.unique(y)) < 2:
        return QualityModel.unfitted()
    texts = [r["text"] for r in found]
    del found
    model = train(texts, y, epochs, seed)
    del texts
    trim()  # the driver has its JVM beside it
    return model


def chunk_blocks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The CHUNK blocks of each chunk of all texts, and the texts' numbers of chunks.

    A last chunk that is shorter names its text's last block several times.
    """
    blocks = np.diff(first)
    chunks = np.maximum(1, -(-(blocks - 1) // STRIDE))
    nth = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    own = np.minimum(nth[:, None] * STRIDE + np.arange(CHUNK), np.repeat(blocks - 1, chunks)[:, None])
    return own + np.repeat(first[:-1], chunks)[:, None], chunks


def train(texts: list[str], y: np.ndarray, epochs: int, seed: int, batch: int = 8, rate: float = 0.01) -> QualityModel:
    """Adam on the logistic loss; of each filter and chunk the strongest position carries the gradient."""
    rng = np.random.default_rng(seed)
    p = {
        "code": rng.normal(0, 0.5, (256, CODE)), "filters": rng.normal(0, 0.3, (WIDTH, CODE, FILTERS)), "bias": np.zeros(FILTERS),
        "head": rng.normal(0, 0.1, 2 * FILTERS), "shift": np.zeros(1),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    fs = np.arange(FILTERS)[None, :]
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            raw, first = laid_out([texts[i] for i in rows])
            tables = np.einsum("bc,wcf->wbf", p["code"], p["filters"])
            maxima, places = block_maxima(tables, raw, places=True)
            blocks, chunks = chunk_blocks(first)
            top = np.take_along_axis(blocks, maxima[blocks].argmax(axis=1), 1)
            peak = maxima[top, fs] + p["bias"]
            chunk, begins = np.maximum(peak, 0), np.cumsum(chunks) - chunks
            best = np.array([a + chunk[a : a + n].argmax(axis=0) for a, n in zip(begins, chunks)])
            pooled = np.concatenate([np.add.reduceat(chunk, begins, axis=0) / chunks[:, None], chunk[best, fs]], axis=1)
            error = (1 / (1 + np.exp(-np.clip(pooled @ p["head"] + p["shift"], -30, 30))) - y[rows]) / len(rows)
            d_pooled = error[:, None] * p["head"]
            d_chunk = np.repeat(d_pooled[:, :FILTERS] / chunks[:, None], chunks, axis=0)
            d_chunk[best, fs] += d_pooled[:, FILTERS:]
            d_peak = d_chunk * (peak > 0)
            d_tables = np.zeros_like(tables)
            for j in range(WIDTH):
                np.add.at(d_tables[j], (raw[places[top, fs] + j], fs), d_peak)
            grads = {
                "code": np.einsum("wbf,wcf->bc", d_tables, p["filters"]), "filters": np.einsum("bc,wbf->wcf", p["code"], d_tables),
                "bias": d_peak.sum(axis=0), "head": pooled.T @ error, "shift": error.sum(keepdims=True),
            }
            t += 1
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    tables = np.einsum("bc,wcf->wbf", p["code"], p["filters"]).astype(np.float32)
    return QualityModel(tables, p["bias"], p["head"], float(p["shift"][0]))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: better). Null and empty texts get the score of an empty text.

    Repeated rows and null ids each get their own row; other columns are left
    out; an empty table gives an empty result.
    """
    df = only(docs, doc_id=id_col, text=text_col)
    return map_text(df, "text", lambda: lambda texts: (model.scores(texts),), {"score": pa.float64()}, "score double")
