"""Best-fit packing planned on the histogram of lengths.

1. Each document becomes pieces of at most ``size`` ids; pieces are written with
   their task's number and their place among that task's pieces of equal length.
2. Only the number of pieces per length, at most ``size`` numbers, reaches the
   driver. Best-fit decreasing over these counts gives runs of slots: "ranks
   ``lo`` to ``hi`` of length L go to sequences from ``first`` on, ``per`` to
   each, behind ``fill`` ids". Whole groups of equal sequences are planned at once.
3. A piece's rank within its length is the number of equal pieces in earlier
   tasks plus its place in its own task, so no length is ever sorted in one task.
   Its run is found by binary search in the plan.
"""

from __future__ import annotations

import re
import string
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.rows import only, small_batches
from lexmill.llm.vocabulary import byte_characters, tokenizer_file
from lexmill.llm.workers import CACHE_LENGTH, Cache, held, trim
from lexmill.storage import materialize

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SIZE = 2048
END_ID = 0
MARKS = string.punctuation.encode()
# Letters of ASCII and Latin-1: one piece, of which no step before the merges changes more than the case.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
# The numbers of earlier pieces are broadcast if there are at most so many; a task has up to one per length.
BROADCAST_RANKS = 500_000
# Words of a generation. A worker holds two, beside a JVM that takes most of an executor's memory.
GENERATION = 100_000


class Words(Cache):
    """Ids of words; a word with marks behind it is put together, not kept.

    When a generation of words is full it becomes the old one, and what was old is
    forgotten, but for the words that have been asked for again.
    """

    def __init__(self, compute):
        super().__init__(compute)
        self.old = {}

    def __missing__(self, word: bytes) -> bytes:
        plain = word.rstrip(MARKS)
        if len(plain) < len(word) and (plain[-1:].isalnum() or LETTERS.fullmatch(plain)):
            return self[plain] + self[word[len(plain) :]]
        ids = self.old.get(word)
        if ids is None:
            ids = self.compute(word)
        if len(word) <= CACHE_LENGTH:
            if len(self) >= GENERATION:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


def _word_ids(path: str) -> Words:
    """Little-endian 32-bit ids of a word without ASCII white space, in lower case.

    The vocabulary drops white space and lower-cases, and no step before it looks
    across white space, so the ids of a text are those of its words in a row.
    Punctuation marks after a letter or digit are a token sequence of their own.
    """

    def make() -> Words:
        whole = tokenizer_file(path)
        encode, merge, byte = whole.encode, whole.model.tokenize, byte_characters()

        def ids(word: bytes) -> bytes:
            if LETTERS.fullmatch(word):
                lower = word.decode().lower().encode().decode("latin-1")
                found = [t.id for t in merge(lower.translate(byte))]
            else:
                found = encode(word.decode(), add_special_tokens=False).ids
            return np.array(found, "<u4").tobytes()

        return Words(ids)

    return held(("words", path), make)


def plan(counts: dict[int, int], size: int = SIZE) -> np.ndarray:
    """Best-fit decreasing over length counts: rows (length, lo, first, per, fill).

    Of a length's pieces, the one of rank r >= lo (in the last row whose lo is
    not above r) goes to sequence ``first + (r - lo) // per`` at offset
    ``fill + (r - lo) % per * length``.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free ids -> groups (first sequence, how many)
    sizes: list[int] = []  # the keys of room, sorted
    runs, sequences = [], 0

    def give_back(free: int, first: int, many: int) -> None:
        if free and many:
            if free not in room:
                room[free] = []
                insort(sizes, free)
            room[free].append((first, many))

    for length in sorted(counts, reverse=True):
        lo, left = 0, counts[length]
        while left:
            k = bisect_left(sizes, length)
            if k < len(sizes):
                free = sizes[k]
                first, many = room[free].pop()
                if not room[free]:
                    del room[free], sizes[k]
            else:
                free, first, many = size, sequences, -(-left // (size // length))
                sequences += many
            per = free // length
            taken = min(left, many * per)
            full, rest = divmod(taken, per)
            runs.append((length, lo, first, per, size - free))
            give_back(free - per * length, first, full)
            if rest:
                give_back(free - rest * length, first + full, 1)
            give_back(free, first + full + bool(rest), many - full - bool(rest))
            lo, left = lo + taken, left - taken
    return np.array(runs, np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, vocabulary: str = VOCABULARY) -> DataFrame:
    """Cut documents into pieces of at most ``size`` ids: doc_id, piece, start, length, ids_crc32, part, nth.

    ``part`` is the task and ``nth`` the piece's place among the task's pieces of
    its length; both hold only for the rows as they were written, so write the
    result once before using them.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_ids, seen, part = _word_ids(vocabulary), Counter(), TaskContext.get().partitionId()
        end, step = np.array([END_ID], "<u4").tobytes(), 4 * size
        for batch in batches:
            rows, take = [], []
            # one text at a time is a Python string
            for i, text in enumerate(batch.column("text")):
                ids = b"".join(map(word_ids.__getitem__, (text.as_py() or "").encode().lower().split())) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    piece = ids[at : at + step]
                    length = len(piece) // 4
                    rows.append((k, at // 4, length, zlib.crc32(piece), part, seen[length]))
                    seen[length] += 1
                    take.append(i)
            columns = np.array(rows, np.int64).reshape(-1, 6).T
            ids_column = batch.column("doc_id").take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids_column, *[pa.array(c) for c in columns]], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            )
        trim()

    return only(docs, doc_id=id_col, text=text_col).mapInArrow(
        run, f"doc_id {id_type}, piece long, start long, length long, ids_crc32 long, part long, nth long"
    )


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pack documents into sequences of at most ``size`` ids, one row per piece.

    Columns: doc_id, piece (from 0, int), start, length, ids_crc32, sequence_id,
    offset. A null or empty text is the single id 0. Repeated rows are packed
    one by one, null ids stay null, other columns are left out, and an empty
    table gives an empty result.
    """
    with small_batches(docs.sparkSession):
        written = materialize(pieces(docs, id_col, text_col, size, vocabulary), "pieces")
    per_task = materialize(written.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    # one row per length that occurs: at most ``size`` rows
    runs = plan({r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = per_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranks = F.broadcast(ranks) if per_task.count() <= BROADCAST_RANKS else ranks.hint("merge")
    ranked = written.join(ranks, ["length", "part"]).withColumn("rank", F.col("earlier") + F.col("nth")).drop("part", "nth", "earlier")

    order = np.lexsort((runs[:, 1], runs[:, 0]))
    runs = runs[order]
    starts = runs[:, 0] * (1 << 50) + runs[:, 1]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            run = runs[np.searchsorted(starts, f["length"].to_numpy() * (1 << 50) + f["rank"].to_numpy(), "right") - 1]
            past = f["rank"].to_numpy() - run[:, 1]
            f["sequence_id"] = run[:, 2] + past // run[:, 3]
            f["offset"] = run[:, 4] + past % run[:, 3] * f["length"].to_numpy()
            f["piece"] = f["piece"].astype("int32")
            yield f[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    id_type = docs.schema[id_col].dataType.simpleString()
    return ranked.mapInPandas(place, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
