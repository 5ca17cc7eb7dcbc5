"""Sparse tensors as DataFrames: one column per axis and a ``value`` column.

Cells that are not stored are 0, axes have no fixed size, and an index may be
of any type. Every operation is a lazy relational plan unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.hashing import standard_normal, uniform
from lexmill.operators.joins import Lookup, product_join
from lexmill.operators.ranking import running_total


class CoordTensor:
    """A tensor in coordinate form; ``axes`` names the index columns in order."""

    def __init__(self, df: DataFrame, axes: Sequence[str]):
        self.df = df
        self.axes = list(axes)

    @property
    def ndim(self) -> int:
        return len(self.axes)

    # -- construction -----------------------------------------------------

    @classmethod
    def indicator(cls, pairs: DataFrame, axes: Sequence[str]) -> "CoordTensor":
        """The matrix with a 1 wherever the table has the pair."""
        return cls(pairs.select(*axes, F.lit(1.0).alias("value")), axes)

    @classmethod
    def from_arrays(cls, df: DataFrame, keys: Sequence[str], array: str, axis: str) -> "CoordTensor":
        """Dense array rows to coordinates; positions count from 0."""
        cells = df.select(*keys, F.posexplode(array).alias(axis, "value"))
        return cls(cells.withColumn("value", F.col("value").cast("double")), [*keys, axis])

    @classmethod
    def rand_int_like(cls, rows: DataFrame, axes: Sequence[str], low: int, high: int, seed: str = "0") -> "CoordTensor":
        """Random whole numbers in ``[low, high)``, one for each row of a table, by its columns ``axes``."""
        draw = F.floor(uniform(seed, *axes) * (high - low)) + low
        return cls(rows.select(*axes, draw.cast("double").alias("value")), axes)

    @classmethod
    def normal_like(cls, rows: DataFrame, axes: Sequence[str], loc: float = 0.0, scale: float = 1.0, seed: str = "0") -> "CoordTensor":
        """Draws from a normal distribution, one for each row of a table, by its columns ``axes``."""
        draw = standard_normal(seed, *axes) * float(scale) + float(loc)
        return cls(rows.select(*axes, draw.alias("value")), axes)

    @classmethod
    def _filled(cls, spark: SparkSession, shape: Sequence[int], axes: Sequence[str] | None) -> DataFrame:
        axes = list(axes or [f"axis{i}" for i in range(len(shape))])
        size = 1
        for n in shape:
            size *= n
        cols, step = [], size
        for axis, n in zip(axes, shape):
            step //= n
            cols.append((F.floor(F.col("id") / F.lit(step)) % n).cast("bigint").alias(axis))
        return spark.range(size).select(*cols)

    @classmethod
    def rand_int(
        cls,
        spark: SparkSession,
        low: int,
        high: int | None = None,
        shape: Sequence[int] = (1,),
        seed: str = "0",
        axes: Sequence[str] | None = None,
    ) -> "CoordTensor":
        """Random whole numbers in ``[low, high)``, or ``[0, low)`` without ``high``."""
        low, high = (0, low) if high is None else (low, high)
        grid = cls._filled(spark, shape, axes)
        return cls.rand_int_like(grid, grid.columns, low, high, seed)

    @classmethod
    def normal(
        cls,
        spark: SparkSession,
        loc: float = 0.0,
        scale: float = 1.0,
        shape: Sequence[int] = (1,),
        seed: str = "0",
        axes: Sequence[str] | None = None,
    ) -> "CoordTensor":
        """Draws from a normal distribution."""
        grid = cls._filled(spark, shape, axes)
        return cls.normal_like(grid, grid.columns, loc, scale, seed)

    # -- dense form -------------------------------------------------------

    def to_dense(self, width: int | None = None, block: int = 1024) -> DataFrame:
        """Dense form: one row per index of all axes but the last, and block: ``axes, block, values``.

        The last axis must be whole numbers from 0 to ``width - 1``; others are
        an error. Without ``width`` its distinct coordinates, of whatever type,
        are numbered in order. A row is cut into blocks of at most ``block``
        cells, so no group grows with it, and has all its blocks, also those
        without a stored cell.
        """
        *rows, col = self.axes
        cells = self.df
        if width is None:
            index = self.axis_index(col)
            width = index.count()
            cells = cells.join(index, col).drop(col).withColumnRenamed("position", col)
        else:
            outside = F.raise_error(F.format_string(f"coordinate %s of axis {col} is outside 0 to {width - 1}", F.col(col).cast("string")))
            cells = cells.withColumn(col, F.when(F.col(col).between(0, width - 1), F.col(col)).otherwise(outside))
        if not width:
            return cells.select(*rows, F.lit(0).cast("bigint").alias("block"), F.array(F.lit(0.0)).alias("values")).limit(0)
        size = min(block, width)
        cells = cells.withColumn("block", F.floor(F.col(col) / size).cast("bigint"))
        filled = cells.groupBy(*rows, "block").agg(
            F.map_from_entries(
                F.collect_list(F.struct((F.col(col) % size).cast("int"), F.col("value")))
            ).alias("_m")
        )
        blocks = F.sequence(F.lit(0).cast("bigint"), F.lit((width - 1) // size).cast("bigint"))
        grid = cells.select(*rows).distinct().withColumn("block", F.explode(blocks))
        # the last block may be shorter
        last = F.least(F.lit(size), F.lit(width) - F.col("block") * size).cast("int") - 1
        return grid.join(filled, [*rows, "block"], "left").select(
            *rows,
            "block",
            F.transform(
                F.sequence(F.lit(0), last), lambda j: F.coalesce(F.col("_m")[j], F.lit(0.0))
            ).alias("values"),
        )

    def axis_index(self, axis: str) -> DataFrame:
        """``axis, position``: the distinct coordinates of an axis in order, from 0."""
        distinct = self.df.select(axis).distinct()
        return running_total(distinct, [axis], F.lit(1)).select(axis, F.col("before").alias("position"))

    # -- shape ------------------------------------------------------------

    def transpose(self, order: Sequence[int] | None = None) -> "CoordTensor":
        """Reorder the axes; by default swap the first two."""
        order = list(order) if order else [1, 0, *range(2, self.ndim)]
        axes = [self.axes[i] for i in order]
        return CoordTensor(self.df.select(*axes, "value"), axes)

    @property
    def t(self) -> "CoordTensor":
        return self.transpose()

    def rename(self, *axes: str) -> "CoordTensor":
        old = [F.col(a).alias(b) for a, b in zip(self.axes, axes)]
        return CoordTensor(self.df.select(*old, "value"), axes)

    # -- cell-wise --------------------------------------------------------

    def _map(self, value: Column, keep_zero: bool = False) -> "CoordTensor":
        df = self.df.select(*self.axes, value.alias("value"))
        return CoordTensor(df if keep_zero else df.filter("value != 0"), self.axes)

    def scale(self, factor: float) -> "CoordTensor":
        return self._map(F.col("value") * F.lit(factor))

    def _cellwise(self, other: "CoordTensor", combine, how: str) -> "CoordTensor":
        if self.ndim != other.ndim:
            raise ValueError("tensors differ in their number of axes")
        b = other.rename(*self.axes).df.withColumnRenamed("value", "_other")
        both = self.df.withColumnRenamed("value", "_own").join(b, self.axes, how)
        own, oth = (F.coalesce(c, F.lit(0.0)) for c in ("_own", "_other"))
        df = both.select(*self.axes, combine(own, oth).alias("value")).filter("value != 0")
        return CoordTensor(df, self.axes)

    def add(self, other: "CoordTensor", strict: bool = False) -> "CoordTensor":
        """Sum; ``strict`` keeps only cells stored on both sides."""
        return self._cellwise(other, lambda a, b: a + b, "inner" if strict else "full_outer")

    def sub(self, other: "CoordTensor", strict: bool = False) -> "CoordTensor":
        """Difference; ``strict`` keeps only cells stored on both sides."""
        return self._cellwise(other, lambda a, b: a - b, "inner" if strict else "full_outer")

    def hadamard(self, other: "CoordTensor") -> "CoordTensor":
        """Cell-wise product; only cells stored on both sides can differ from 0."""
        return self._cellwise(other, lambda a, b: a * b, "inner")

    def matmul(self, other: "CoordTensor") -> "CoordTensor":
        """Matrix product over the last axis of this and the first of ``other``."""
        if self.ndim != 2 or other.ndim != 2:
            raise ValueError("only matrices can be multiplied")
        i, j = self.axes
        k = other.axes[1] if other.axes[1] != i else other.axes[1] + "_2"
        a = self.df.select(F.col(i), F.col(j).alias("_on"), F.col("value").alias("_a"))
        b = other.df.select(
            F.col(other.axes[0]).alias("_on"), F.col(other.axes[1]).alias(k), F.col("value").alias("_b")
        )
        cells = product_join(a, b, "_on").groupBy(i, k).agg(F.sum(F.col("_a") * F.col("_b")).alias("value"))
        return CoordTensor(cells.filter("value != 0"), [i, k])

    def __add__(self, other):
        return self.add(other)

    def __sub__(self, other):
        return self.sub(other)

    def __mul__(self, other):
        return self.hadamard(other) if isinstance(other, CoordTensor) else self.scale(other)

    def __matmul__(self, other):
        return self.matmul(other)

    def __neg__(self):
        return self.scale(-1.0)

    def __abs__(self):
        return self._map(F.abs("value"), keep_zero=True)

    # -- cells ------------------------------------------------------------

    def get_cells(self, cells: DataFrame) -> DataFrame:
        """The wanted cells (a table of coordinates) with their values, 0 if not stored."""
        found = cells.select(*self.axes).join(self.df, self.axes, "left")
        return found.select(*self.axes, F.coalesce("value", F.lit(0.0)).alias("value"))

    def set_cells(self, cells: DataFrame) -> "CoordTensor":
        """Replace the given cells; a value of 0 deletes the cell."""
        kept = self.df.join(cells.select(*self.axes), self.axes, "left_anti")
        new = cells.select(*self.axes, F.col("value").cast("double")).filter("value != 0")
        return CoordTensor(kept.select(*self.axes, "value").unionByName(new), self.axes)

    def _cell(self, key: Sequence, **value) -> DataFrame:
        if len(key) != self.ndim:
            raise ValueError("a full key is needed")
        types = dict(self.df.dtypes)
        cols = [F.lit(k).cast(types[a]).alias(a) for a, k in zip(self.axes, key)]
        cols += [F.lit(float(v)).alias(n) for n, v in value.items()]
        return self.df.sparkSession.range(1).select(*cols)

    def __getitem__(self, key: Sequence) -> float:
        return self.get_cells(self._cell(key)).first()["value"]

    def __setitem__(self, key: Sequence, value: float) -> None:
        self.df = self.set_cells(self._cell(key, value=value)).df

    # -- along an axis ----------------------------------------------------

    def _others(self, axis: int) -> list[str]:
        return [a for i, a in enumerate(self.axes) if i != axis]

    def max(self, axis: int = 1) -> "CoordTensor":
        """Largest stored value along an axis."""
        rest = self._others(axis)
        return CoordTensor(self.df.groupBy(*rest).agg(F.max("value").alias("value")), rest)

    def argmax(self, axis: int = 1) -> "CoordTensor":
        """Index of the largest stored value; the smallest index among equals."""
        rest = self._others(axis)
        index = self.axes[axis]
        top = best(self.df, rest, "value", index)
        return CoordTensor(top.select(*rest, F.col(index).alias("value")), rest)

    def _shifted(self, axis: int) -> DataFrame:
        """The cells with ``_d``, the value below its group's largest, and ``_s``, the group's sum of exp(_d).

        A group may hold most of the cells, so its largest value and its sum
        are partial aggregates joined back by a skew-safe lookup rather than
        a window that would gather the group in one task.
        """
        rest = self._others(axis)
        cells = self.df
        if not rest:
            # a vector is a single group
            cells, rest = cells.withColumn("_all", F.lit(0)), ["_all"]
        peaks = cells.groupBy(*rest).agg(F.max("value").alias("_max"), F.count(F.lit(1)).alias("_rows"))
        near = (F.col("value") - F.col("_max")).alias("_d")
        peaks = Lookup.build(peaks, rest, "_rows", 2, "peaks")
        sums = peaks.join(cells).select(*rest, near).groupBy(*rest)
        sums = sums.agg(F.sum(F.exp("_d")).alias("_s"), F.count(F.lit(1)).alias("_rows"))
        totals = Lookup.build(peaks.df.drop("_rows").join(sums, rest), rest, "_rows", 3, "sums")
        return totals.join(cells).select(*self.axes, near, "_s")

    def softmax(self, axis: int = 1) -> "CoordTensor":
        """Softmax over the stored cells along an axis. Runs two aggregations at once."""
        df = self._shifted(axis)
        return CoordTensor(df.select(*self.axes, (F.exp("_d") / F.col("_s")).alias("value")), self.axes)

    def log_softmax(self, axis: int = 1) -> "CoordTensor":
        """Logarithm of the softmax, without leaving the log scale."""
        df = self._shifted(axis)
        return CoordTensor(df.select(*self.axes, (F.col("_d") - F.ln("_s")).alias("value")), self.axes)


def best(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """``keys, label, score`` of the highest score per key; equal scores go to the smallest label."""
    top = df.groupBy(*keys).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(label).alias("l"))).alias("_b"))
    return top.select(*keys, F.col("_b.l").alias(label), (-F.col("_b.s")).alias(score))
