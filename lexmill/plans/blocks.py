"""The best of up to 256 classes for blocks of documents, from the packed cells of their words.

A block's words come in order, each with its packed cells first and the documents
that have it behind, so a task holds the sums of a block's documents and the cells
of one Arrow batch. What a row unfolds into is added up at once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row

# Additions of cells to documents that are made at once.
TERMS = 1 << 20
# Whole numbers below these bounds are packed in so many bytes, others as doubles.
KINDS = [(1 << 8, b"1", "<u1"), (1 << 16, b"2", "<u2"), (np.inf, b"8", "<f8")]


def packed_cells(model: DataFrame, labels: Sequence) -> DataFrame:
    """``feature, df, packed`` of a model's ``feature, df, cells``: the places of the classes and their counts.

    Cells of other classes, and those whose count has no logarithm, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("cells")
            label, count = cells.flatten().flatten()
            place = pc.fill_null(pc.index_in(label, value_set=pa.array(labels, label.type), skip_nulls=True), -1).to_numpy(zero_copy_only=False)
            missing = count.is_null().to_numpy(zero_copy_only=False)
            count = pc.fill_null(count, 0.0).to_numpy(zero_copy_only=False)
            kept = (place >= 0) & ~missing & ~(count + 1 <= 0)
            owner = np.repeat(np.arange(len(batch)), pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False))[kept]
            ends = np.searchsorted(owner, np.arange(len(batch) + 1))
            place, count = place[kept].astype(np.uint8), count[kept]
            plain = np.where((count >= 0) & (count == np.floor(count)), count, np.inf)
            packed = []
            for a, b in zip(ends, ends[1:]):
                most = plain[a:b].max() if b > a else 0
                mark, kind = next((m, k) for bound, m, k in KINDS if most < bound or k == "<f8")
                packed.append(mark + place[a:b].tobytes() + count[a:b].astype(kind).tobytes())
            columns = [batch.column("feature"), batch.column("df"), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["feature", "df", "packed"])

    return model.select("feature", "df", "cells").mapInArrow(run, f"feature {model.schema['feature'].dataType.simpleString()}, df long, packed binary")


def unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places, from 0, and counts."""
    kind = next(k for _, m, k in KINDS if packed[:1] == m)
    n = (len(packed) - 1) // (1 + np.dtype(kind).itemsize)
    return np.frombuffer(packed, np.uint8, n, 1).astype(np.int64), np.frombuffer(packed, kind, n, 1 + n).astype(np.float64)


class Block:
    """Sums of a block's documents by class, and their weights of known and unknown words."""

    def __init__(self, classes: Sequence[Row], by_df: bool, unseen: float, left: bool):
        self.prior, self.size = (np.array([r[c] for r in classes], float) for c in ("log_prior", "denominator"))
        self.n, self.by_df, self.unseen, self.left = len(classes), by_df, unseen, left
        self.slots: dict = {}
        self.sums = np.zeros((0, self.n))
        self.known, self.unknown = np.zeros(0), np.zeros(0)
        self.word = None  # the last one: weight, places and terms, or None if the model does not know it

    def _slots_of(self, keys: list[pa.Array]) -> np.ndarray:
        """The documents' places in the sums; new ones are added."""
        if len(keys) == 1:
            coded = keys[0].dictionary_encode(null_encoding="encode")
            names, at = [(v,) for v in coded.dictionary.to_pylist()], coded.indices.to_numpy(zero_copy_only=False)
        else:
            names, at = list(zip(*(k.to_pylist() for k in keys))), np.arange(len(keys[0]))
        own = np.array([self.slots.setdefault(name, len(self.slots)) for name in names], np.int64)
        if len(self.slots) > len(self.known):
            more = max(len(self.slots), 2 * len(self.known)) - len(self.known)
            self.sums = np.concatenate([self.sums, np.zeros((more, self.n))])
            self.known, self.unknown = (np.concatenate([a, np.zeros(more)]) for a in (self.known, self.unknown))
        return own[at]

    def add(self, keys: list[pa.Array], side: np.ndarray, df: list, packed: pa.Array) -> None:
        """Rows in order: a word (``side`` 0), then its documents."""
        words = [self.word]
        for at in np.flatnonzero(side == 0):
            if df[at] is None:
                words.append(None)
                continue
            places, counts = unpacked(packed[int(at)].as_py())
            weight = float(df[at]) if self.by_df else 1.0
            words.append((weight, places, weight * np.log(counts + 1)))
        word = np.cumsum(side == 0)
        self.word = words[-1]
        is_known = np.array([w is not None for w in words])
        rows = side == 1 if self.left else (side == 1) & is_known[word]
        if not rows.any():
            return
        slots, word = self._slots_of([k.filter(pa.array(rows)) for k in keys]), word[rows]
        weights = np.array([0.0 if w is None else w[0] for w in words])
        np.add.at(self.known, slots, weights[word])
        np.add.at(self.unknown, slots, np.where(is_known[word], 0.0, self.unseen))
        # words of many classes: the classes' terms in one row, added to each of the word's documents
        many = np.array([w is not None and 4 * len(w[1]) >= self.n for w in words])
        begins = np.searchsorted(word, np.arange(len(words) + 1))
        for k in np.flatnonzero(many & (np.diff(begins) > 0)):
            terms = np.zeros(self.n)
            terms[words[k][1]] = words[k][2]
            own, times = np.unique(slots[begins[k] : begins[k + 1]], return_counts=True)
            self.sums[own] += terms * times[:, None]
        few = is_known[word] & ~many[word]
        self._add_few(slots[few], word[few], words)

    def _add_few(self, slots: np.ndarray, word: np.ndarray, words: list) -> None:
        none = np.zeros(0, np.int64), np.zeros(0)
        used = set(word.tolist())
        cells = [words[k][1:] if k in used else none for k in range(len(words))]
        sizes = np.array([len(p) for p, _ in cells])
        starts = np.cumsum(sizes) - sizes
        places, terms = (np.concatenate(x) for x in zip(*cells))
        ends, flat, done = np.cumsum(sizes[word]), self.sums.reshape(-1), 0
        while done < len(word):
            before = ends[done - 1] if done else 0
            stop = max(done + 1, int(np.searchsorted(ends, before + TERMS, "right")))
            own = sizes[word[done:stop]]
            at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(starts[word[done:stop]], own)
            np.add.at(flat, np.repeat(slots[done:stop], own) * self.n + places[at], terms[at])
            done = stop

    def best(self, kinds: list[pa.DataType], names: list[str]) -> pa.StructArray:
        """The keys, the place of the best class, from 1, and its score; equal scores go to the first."""
        n = len(self.slots)
        scores = self.prior + self.sums[:n] - self.known[:n, None] * np.log(self.size) - self.unknown[:n, None] * np.log(self.size + 1)
        top = scores.argmax(axis=1) if n else np.zeros(0, np.int64)
        keys = [pa.array([key[c] for key in self.slots], kind) for c, kind in enumerate(kinds)]
        columns = [*keys, pa.array(top + 1, pa.int32()), pa.array(scores[np.arange(n), top], pa.float64())]
        return pa.StructArray.from_arrays(columns, names=[*names, "_place", "score"])


def best_of_blocks(rows: DataFrame, keys: Sequence[str], classes: Sequence[Row], by_df: bool, unseen: float, left: bool) -> DataFrame:
    """``found``, a row per block: the keys, ``_place`` and ``score`` of its documents.

    ``rows`` are placed by ``_block``, and in order of ``_block``, word and ``_side``; those of ``_side`` 0
    have ``df`` and ``packed``. Words without ``df`` are unknown; with ``left`` they count as ``unseen`` each.
    """
    fields = ", ".join(f"`{k}`: {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, kinds = None, None, []

        def done() -> Iterator[pa.RecordBatch]:
            if block is not None:
                found = block.best(kinds, list(keys))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found)], names=["found"])

        for batch in batches:
            own = batch.column("_block").to_numpy(zero_copy_only=False)
            kinds = [batch.column(k).type for k in keys]
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if own[a] != now:
                    yield from done()
                    now, block = own[a], Block(classes, by_df, unseen, left)
                part = batch.slice(a, b - a)
                side = part.column("_side").to_numpy(zero_copy_only=False)
                block.add([part.column(k) for k in keys], side, part.column("df").to_pylist(), part.column("packed"))
        yield from done()

    return rows.mapInArrow(run, f"found array<struct<{fields}, `_place`: int, score: double>>")
