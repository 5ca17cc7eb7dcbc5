"""Nearest neighbours by inner product through low-dimensional stable projections.

Vectors get one more component that gives all of them the largest norm M, queries
get a zero there; then the largest inner product is the smallest distance. A
projection on DIMENSIONS Gaussian directions turns a squared distance d2 into d2
times a chi-square variable. A kd-tree indexes the projected points: its upper
part, cut from a bounded sample, deals them to parts, its lower part is built
within each part. A part that turns out larger than PART_ROWS is dealt on into
pieces of that size by a hash, so a task is bounded however many rows there are. A query takes the tree's cells in the order of
their projected distance and verifies their vectors; it stops when the next cell
is so far that a vector as near as the current k-th one would be projected closer
with probability CONFIDENCE, by the chi-square distribution. No number of
verified vectors is fixed: where projections do not tell vectors apart, all are
verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.vectors import sample_matrix, stack, usable_rows, vector_id
from lexmill.storage import materialize

DIMENSIONS = 8  # even
CONFIDENCE = 0.98
SAMPLE_ROWS = 4096
PART_ROWS = 8192
CELL_ROWS = 128
QUERY_BLOCK = 4096


def chi_square(x: float, k: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, k // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, k: int) -> float:
    low, high = 0.0, 10.0 * k + 100
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, k) < p else (low, middle)
    return high


def cut(points: np.ndarray, rows: int) -> list[np.ndarray]:
    """Places of the points in each leaf of a kd-tree with at most ``rows`` points per leaf.

    Cells are halved at the median of their widest axis; equal points may stay on either side.
    """
    leaves, work = [], [np.arange(len(points))]
    while work:
        at = work.pop()
        if len(at) <= rows:
            leaves.append(at)
            continue
        own = points[at]
        axis = int((own.max(axis=0) - own.min(axis=0)).argmax())
        order = np.argpartition(own[:, axis], len(at) // 2)
        work += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return leaves


def gap(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each query from each box."""
    out = np.maximum(low[None] - queries[:, None], queries[:, None] - high[None])
    return (np.maximum(out, 0) ** 2).sum(axis=2)


@dataclass
class Index:
    """The projection and the upper part of the tree: boxes that cover all space."""

    directions: np.ndarray
    norm: float
    axis: list[int]
    at: list[float]
    children: list[tuple[int, int]]  # node -> nodes; a negative number -1 - p is part p
    low: np.ndarray
    high: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))
        return np.hstack([x, rest[:, None]]) @ self.directions

    def project_queries(self, q: np.ndarray) -> np.ndarray:
        return q @ self.directions[:-1]

    def part(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64) if self.axis else np.full(len(points), -1)
        while (inner := np.flatnonzero(node >= 0)).size:
            for n in np.unique(node[inner]):
                own = inner[node[inner] == n]
                left, right = self.children[n]
                node[own] = np.where(points[own, self.axis[n]] <= self.at[n], left, right)
        return -1 - node

    def reach(self, q: np.ndarray, score: np.ndarray, quantile: float) -> np.ndarray:
        """Squared projected distance beyond which nothing better than ``score`` is expected."""
        return quantile * np.maximum((q * q).sum(axis=1) + self.norm**2 - 2 * score, 0)


def build(sample: np.ndarray, norm: float, n: int, dimensions: int, seed: int) -> Index:
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(sample.shape[1] + 1, dimensions))
    index = Index(directions, norm, [], [], [], np.zeros((0, dimensions)), np.zeros((0, dimensions)))
    points = index.project(sample)
    lows, highs = [], []

    def grow(at: np.ndarray, rows: float, low: np.ndarray, high: np.ndarray) -> int:
        own = points[at]
        spread = own.max(axis=0) - own.min(axis=0) if len(at) else np.zeros(dimensions)
        if rows <= PART_ROWS or len(at) < 8 or spread.max() == 0:
            lows.append(low)
            highs.append(high)
            return -len(lows)
        axis = int(spread.argmax())
        middle = float(np.median(own[:, axis]))
        node = len(index.axis)
        index.axis.append(axis)
        index.at.append(middle)
        index.children.append((0, 0))
        left_high, right_low = high.copy(), low.copy()
        left_high[axis] = right_low[axis] = middle
        left = own[:, axis] <= middle
        index.children[node] = (grow(at[left], rows / 2, low, left_high), grow(at[~left], rows / 2, right_low, high))
        return node

    grow(np.arange(len(points)), n, np.full(dimensions, -np.inf), np.full(dimensions, np.inf))
    index.low, index.high = np.array(lows), np.array(highs)
    return index


def verify(queries: pd.DataFrame, vectors: pd.DataFrame, index: Index, k: int, quantile: float) -> pd.DataFrame:
    """Best ``k`` vectors of one part for each query, none known to be worse than the query's ``floor``."""
    q, x, ids = stack(queries["v"]), stack(vectors["v"]), vectors["vec_id"].to_numpy()
    points = index.project(x)
    leaves = cut(points, CELL_ROWS)
    low, high = (np.array([f(points[leaf], axis=0) for leaf in leaves]) for f in (np.min, np.max))
    cells = [(x[leaf], ids[leaf]) for leaf in leaves]
    norms = (q * q).sum(axis=1)
    out = []
    gaps = gap(index.project_queries(q), low, high)
    for r, (query, floor) in enumerate(zip(queries["vec_id"].to_numpy(), queries["floor"].to_numpy())):
        best_score, best_id, kth = np.zeros(0), np.zeros(0, np.int64), floor
        for cell in np.argsort(gaps[r], kind="stable"):
            if gaps[r, cell] > quantile * max(norms[r] + index.norm**2 - 2 * kth, 0):
                break
            own, own_ids = cells[cell]
            # products in an order of additions that is the same for equal vectors anywhere
            score = own @ q[r]
            # rounding grows with the lengths of both vectors
            some = np.flatnonzero((score >= kth - 1e-9 * np.sqrt(norms[r]) * index.norm) & (own_ids != query))
            if not len(some):
                continue
            score = (own[some] * q[r]).sum(axis=1)
            best_score, best_id = np.concatenate([best_score, score]), np.concatenate([best_id, own_ids[some]])
            if len(best_score) > k:
                order = np.lexsort((best_id, -best_score))[:k]
                best_score, best_id = best_score[order], best_id[order]
            if len(best_score) >= k:
                kth = max(kth, best_score.min())
        out.append(pd.DataFrame({"query_id": query, "vec_id": best_id, "score": best_score}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def search(
    df: DataFrame, query_ids: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS,
    confidence: float = CONFIDENCE, seed: int = 13,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows found with the largest inner product for each query.

    Queries are the rows for which the SQL condition ``query_ids`` on vec_id
    holds; a query's own id is no answer to it. Equal scores are ranked by
    vec_id. Vectors that are null, zero, of another length than most, or have
    null or non-finite components take no part, nor do rows with a null id.
    Repeated rows count once; of rows that share an id but not the vector, each
    is a candidate and each asks, and the best scores count. Other columns are
    left out; an empty table gives an empty result.
    """
    rows = usable_rows(df, id_col, vector_col)
    # of equal vectors only the first k + 1 ids can be answers
    first = Window.partitionBy("key").orderBy("vec_id")
    held = rows.withColumn("key", vector_id(F.col("v"))).groupBy("key", "vec_id").agg(F.first("v").alias("v"))
    held = materialize(held, "vectors")
    asked = held.filter(query_ids).select("vec_id", "v")
    held = held.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1).select("vec_id", "v")
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, norm = rows.agg(F.count(F.lit(1)), F.max(F.sqrt(squares))).first()
    if not n:
        return held.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    index = build(sample_matrix(held, SAMPLE_ROWS, seed), norm, n, dimensions, seed)
    quantile = chi_square_quantile(confidence, dimensions)

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f.assign(part=index.part(index.project(stack(f["v"]))))

    def at_home(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f.assign(floor=-np.inf, part=index.part(index.project_queries(stack(f["v"]))))

    def elsewhere(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                q = stack(f["v"])
                points = index.project_queries(q)
                near = gap(points, index.low, index.high) <= index.reach(q, f["floor"].to_numpy(), quantile)[:, None]
                near[np.arange(len(f)), index.part(points)] = False
                at, part = np.nonzero(near)
                yield f.iloc[at].assign(part=part)

    parts = materialize(held.mapInPandas(dealt, "vec_id long, v array<double>, part long"), "vector_parts")
    shape = "vec_id long, v array<double>, floor double, part long"
    # a stated query set in blocks: parts are repeated for each block of queries
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    # both sides of the co-group need the same types of keys, or equal keys are dealt to different tasks
    block = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(blocks)).cast("long").alias("block")

    # a row per part, of which there are fewer than sampled rows
    sizes = parts.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("pieces"))
    sizes = F.broadcast(materialize(sizes, "part_sizes"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1).cast("array<long>"))

    def answers(queries: DataFrame) -> DataFrame:
        asking = queries.join(sizes, "part").select("vec_id", "v", "floor", "part", block, every(F.col("pieces")).alias("piece"))
        piece = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.col("pieces")).cast("long").alias("piece")
        copies = parts.join(sizes, "part").select("vec_id", "v", "part", piece, every(F.lit(blocks)).alias("block"))
        return asking.groupBy("part", "piece", "block").cogroup(copies.groupBy("part", "piece", "block")).applyInPandas(
            lambda a, b: verify(a, b, index, k, quantile) if len(a) and len(b) else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}),
            "query_id long, vec_id long, score double",
        )

    home = materialize(answers(asked.mapInPandas(at_home, shape)), "answers_at_home")
    floors = home.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    # without k answers nothing is excluded
    floor = F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(float("-inf"))).alias("floor")
    asked = asked.join(floors, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", floor)
    found = home.unionByName(answers(asked.mapInPandas(elsewhere, shape)))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
