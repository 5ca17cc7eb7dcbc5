"""Matrix products by tiles, for products with many more pairs of cells than cells.

A tile holds the cells of ``size`` neighbouring rows and columns as arrays.
Multiplying coordinates joins a row per pair of cells and shuffles partial sums
from every task; here the neighbouring tiles of a group are one strip, strips are
copied in compressed form to the groups of output tiles that need them, and a
group's sums stay in one array until all its strips have come by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.operators.joins import BROADCAST_BYTES, Lookup
from lexmill.operators.ranking import running_total
from lexmill.operators.tensor import CoordTensor
from lexmill.storage import materialize, remove

# Rows and columns of a tile: one with all its cells has a megabyte.
TILE = 256
# Output tiles of a group in each direction, at most, and its rows and columns: sums take up to SIDE * SIDE doubles.
# A strip is copied once for each group of the other matrix, so larger groups mean fewer bytes.
GROUP = 16
SIDE = 4096
# Inner places that one task goes through for a group; one that meets in more is cut, and the cuts' sums added up.
# A place may have few cells, and the sums of cuts may be as many as the pairs: what is cut for its work is cut by PAIRS.
INNER = 1 << 16
# Pairs of cells that one task should multiply.
PAIRS = 1 << 27
# Rows of tiles, in Spark and in Arrow.
TILES = "i long, k long, cells array<int>, values array<double>"
SCHEMA = pa.schema([("i", pa.int64()), ("k", pa.int64()), ("cells", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
STRIPS = "on long, at long, n long, packed binary"
# Of fewer pairs than this share of all products of dense tiles, the pairs are multiplied one by one, so many at a time.
SPARSE = 0.02
PAIRS_AT_ONCE = 1 << 20


def _numbers(df: DataFrame, *axes: str) -> DataFrame:
    """``coordinate, position``: the distinct coordinates of some axes of a table, in order."""
    coordinates = df.select(F.col(axes[0]).alias("coordinate"))
    return running_total(coordinates.distinct(), ["coordinate"], F.lit(1)).select("coordinate", F.col("before").alias("position"))


class TileMatrix:
    """A matrix as rows ``i, k, cells, values``: place of the tile, places of its cells in it (row by row, ascending), and their values.

    Rows and columns are whole numbers of any size and sign.
    """

    def __init__(self, df: DataFrame, size: int = TILE):
        self.df = df
        self.size = size

    @classmethod
    def of(cls, cells: DataFrame, row: str, col: str, size: int = TILE) -> "TileMatrix":
        """Tiles of coordinate cells ``row, col, value``, each of them once. A tile has at most size * size cells."""
        inside = F.expr(f"cast(pmod(`{row}`, {size}) * {size} + pmod(`{col}`, {size}) as int)")
        block = lambda c: F.expr(f"(`{c}` - pmod(`{c}`, {size})) div {size}")
        tiles = cells.groupBy(block(row).alias("i"), block(col).alias("k"))
        tiles = tiles.agg(F.array_sort(F.collect_list(F.struct(inside.alias("c"), F.col("value").alias("v")))).alias("t"))
        return cls(tiles.select("i", "k", F.col("t.c").alias("cells"), F.col("t.v").alias("values")), size)

    def cells(self) -> DataFrame:
        """``row, col, value`` in coordinate form."""
        cells = self.df.select("i", "k", F.explode(F.arrays_zip("cells", "values")).alias("c"))
        row, col = F.expr(f"i * {self.size} + c.cells div {self.size}"), F.expr(f"k * {self.size} + c.cells % {self.size}")
        return cells.select(row.alias("row"), col.alias("col"), F.col("c.values").alias("value"))

    def matmul(self, other: "TileMatrix", group: int = GROUP, inner: int = INNER, pairs: int = PAIRS) -> DataFrame:
        """Cells ``row, col, value`` of the product, zeros left out.

        Each tile is stored once, packed. The tiles of a group that have one inner place
        are put together as a strip, which is copied to the groups of output tiles for
        which the other matrix has a strip to multiply it with. Copies of one group
        and one cut of the inner axis meet in a task, in order of the inner axis,
        so the task holds the group's sums and the strips of one inner place. Groups
        are smaller where tasks would have more than ``pairs`` pairs. Only a group
        that itself has more pairs or more than ``inner`` places is cut, and what
        its cuts have summed up is added tile by tile.
        """
        if self.size != other.size:
            raise ValueError("tiles differ in size")
        size = self.size
        a = materialize(_packed_tiles(self.df.select(F.col("k").alias("on"), F.col("i").alias("at"), "cells", "values")), "left_tiles")
        b = materialize(_packed_tiles(other.df.select(F.col("i").alias("on"), F.col("k").alias("at"), "cells", "values")), "right_tiles")
        met = [t.groupBy("on").agg(F.sum("n").alias(n)) for t, n in ((a, "a"), (b, "b"))]
        work = met[0].join(met[1], "on").agg(F.coalesce(F.sum(F.col("a") * F.col("b") / size), F.lit(0.0))).first()[0]
        height, width = (t.select("at").distinct().count() for t in (a, b))
        wanted = int(-(-work // pairs))
        groups = lambda g: -(-height // g) * -(-width // g)
        group = max(1, min(group, SIDE // size))
        group = next((g for g in range(group, 1, -1) if groups(g) >= wanted), 1)
        if group > 1:
            tiles, a, b = (a, b), *(materialize(_strips(t, group, size, n), f"{name}_strips") for n, (t, name) in enumerate(((a, "left"), (b, "right"))))
            for t in tiles:
                remove(t)

        # on, gi, gj: where the strips of two groups meet, and into how many cuts the pair of groups goes
        sides = [t.select("on", F.col("at").alias(g), F.col("n").alias(n)) for t, g, n in ((a, "gi", "a"), (b, "gj", "b"))]
        meets = materialize(sides[0].join(sides[1], "on"), "tile_meets")
        cuts = F.ceil(F.greatest(F.count(F.lit(1)) / inner, F.sum(F.col("a") * F.col("b") / size) / pairs, F.lit(1.0))).cast("int")
        cuts = materialize(meets.groupBy("gi", "gj").agg(cuts.alias("cuts")), "tile_cuts")

        def few(df: DataFrame, row: Column) -> DataFrame:
            bytes_ = df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]
            return F.broadcast(df) if bytes_ <= BROADCAST_BYTES else df

        grid = meets.join(few(cuts, F.lit(48)), ["gi", "gj"])
        cut = F.pmod(F.xxhash64("on"), F.col("cuts")).cast("int")

        def copied(strips: DataFrame, side: int) -> DataFrame:
            """A row for each group of the other matrix that the strip meets."""
            own, other = ("gi", "gj") if side == 0 else ("gj", "gi")
            to = F.collect_list(F.struct(F.col(other).alias("h"), cut.alias("cut"), "cuts")).alias("groups")
            to = materialize(grid.groupBy("on", own).agg(to), "tile_grid")
            met = strips.withColumnRenamed("at", own).join(few(to, F.size("groups") * 24 + 56), ["on", own]).withColumn("h", F.explode("groups"))
            return met.select(own, F.col("h.h").alias(other), "h.cut", "h.cuts", "on", F.lit(side).alias("side"), "n", "packed")

        rows = copied(a, 0).unionByName(copied(b, 1))
        side = group * size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, on, left, sums = None, None, None, None
            for batch in batches:
                gi, gj, cut, place, kind, n = (batch.column(c).to_pylist() for c in ("gi", "gj", "cut", "on", "side", "n"))
                packed = batch.column("packed")
                for at, key in enumerate(zip(gi, gj, cut)):
                    if key != now:
                        yield from _tiles_of(sums, now, group, size)
                        # untouched parts of it take no memory
                        now, on, sums = key, None, np.zeros((side, side))
                    if place[at] != on:
                        on, left = place[at], None
                    cells, values = _unpacked(packed[at].as_py(), n[at])
                    if kind[at] == 0:
                        left = cells // size, cells % size, values
                    elif left is not None:
                        _add_product(sums, left, (cells // side, cells % side, values), size)
            yield from _tiles_of(sums, now, group, size)

        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

        def multiplied(rows: DataFrame) -> DataFrame:
            # a number of its own: the bytes say little about the work
            rows = rows.repartition(parts, "gi", "gj", "cut").sortWithinPartitions("gi", "gj", "cut", "on", "side")
            return rows.mapInArrow(run, TILES)

        whole = multiplied(rows.filter("cuts = 1"))
        if not cuts.filter("cuts > 1").isEmpty():
            whole = whole.unionByName(_added(multiplied(rows.filter("cuts > 1")), size))
        return TileMatrix(whole, size).cells().filter("value <> 0")


def _added(parts: DataFrame, size: int) -> DataFrame:
    """A row per output tile, the sum of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, None
        for batch in batches:
            columns = [batch.column(c) for c in ("i", "k", "cells", "values")]
            for n in range(len(batch)):
                key = columns[0][n].as_py(), columns[1][n].as_py()
                if key != now:
                    if now is not None:
                        yield from _batches({now: out}, SCHEMA)
                    now, out = key, np.zeros((size, size))
                cells, values = (columns[c][n].values.to_numpy(zero_copy_only=False) for c in (2, 3))
                out.ravel()[cells] += values
        if now is not None:
            yield from _batches({now: out}, SCHEMA)

    return parts.repartition("i", "k").sortWithinPartitions("i", "k").mapInArrow(run, TILES)


def _packed(cells: np.ndarray, values: np.ndarray) -> bytes:
    """Ascending places as steps, and values, byte by byte of equal weight, compressed without loss."""
    planes = [x.view(np.uint8).reshape(len(x), -1).T.tobytes() for x in (np.diff(cells, prepend=0).astype("<u4"), values.astype("<f8"))]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(packed, 12 * n, codec="zstd", asbytes=True), np.uint8)
    steps, values = (np.ascontiguousarray(raw[a:b].reshape(-1, n).T).view(kind).ravel() for a, b, kind in ((0, 4 * n, "<u4"), (4 * n, 12 * n, "<f8")))
    return np.cumsum(steps, dtype=np.int64), values


def _strip_batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = ("on", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("packed", pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _packed_tiles(tiles: DataFrame) -> DataFrame:
    """``on, at, n, packed`` of tiles ``on, at, cells, values``: the cells' number, and the cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on, at = (batch.column(c).to_pylist() for c in ("on", "at"))
            cells, values = batch.column("cells"), batch.column("values")
            arrays = ([x[k].values.to_numpy(zero_copy_only=False) for x in (cells, values)] for k in range(len(batch)))
            yield _strip_batch([(*key, len(c), _packed(c, v)) for key, (c, v) in zip(zip(on, at), arrays)])

    return tiles.mapInArrow(run, STRIPS)


def _strips(tiles: DataFrame, group: int, size: int, side: int) -> DataFrame:
    """The packed tiles of one inner place and ``group`` neighbours as one: ``on, at, n, packed``, ``at`` being the group.

    Left strips (``side`` 0) have ``size`` columns, right ones ``group * size``; places go row by row.
    """

    def joined(own: list[tuple]) -> tuple[int, bytes]:
        cells, values = zip(*(_unpacked(packed, n) for _, n, packed in own))
        shift = [at % group for at, _, _ in own]
        if side == 0:
            cells = [c + k * size * size for c, k in zip(cells, shift)]
        else:
            cells = [c // size * (group * size) + k * size + c % size for c, k in zip(cells, shift)]
        cells, values = np.concatenate(cells), np.concatenate(values)
        order = np.argsort(cells, kind="stable")
        return len(cells), _packed(cells[order], values[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in batches:
            ended = []
            for on, at, n, packed in zip(*(batch.column(c).to_pylist() for c in ("on", "at", "n", "packed"))):
                if (on, at // group) != now:
                    if own:
                        ended.append((*now, *joined(own)))
                    now, own = (on, at // group), []
                own.append((at, n, packed))
            yield _strip_batch(ended)
        yield _strip_batch([(*now, *joined(own))] if own else [])

    group_of = F.expr(f"(at - pmod(at, {group})) div {group}")
    return tiles.repartition("on", group_of).sortWithinPartitions("on", "at").mapInArrow(run, STRIPS)


def _add_product(out: np.ndarray, a: tuple, b: tuple, size: int) -> None:
    """Add the product of two strips (rows, columns, values), in order of rows: of dense ones tile by tile as arrays, else pair by pair."""
    starts = np.searchsorted(b[0], np.arange(size + 1))
    # the cells of b in the row that is a cell's column
    n = (starts[1:] - starts[:-1])[a[1]]
    ends = np.cumsum(n)
    rows, cols = np.unique(a[0] // size), np.unique(b[1] // size)
    if ends[-1] > SPARSE * len(rows) * len(cols) * size**3:
        right = [_dense(b, b[1] // size == k, (0, k * size), size) for k in cols]
        for i in rows:
            left = _dense(a, a[0] // size == i, (i * size, 0), size)
            for k, dense in zip(cols, right):
                out[i * size : (i + 1) * size, k * size : (k + 1) * size] += left @ dense
        return
    flat, width, done = out.reshape(-1), out.shape[1], 0
    while done < len(n):
        before = ends[done - 1] if done else 0
        stop = max(done + 1, int(np.searchsorted(ends, before + PAIRS_AT_ONCE, "right")))
        own = n[done:stop]
        left = np.repeat(np.arange(done, stop), own)
        right = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(starts[a[1][done:stop]], own)
        np.add.at(flat, a[0][left] * width + b[1][right], a[2][left] * b[2][right])
        done = stop


def _dense(strip: tuple, own: np.ndarray, corner: tuple[int, int], size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[strip[0][own] - corner[0], strip[1][own] - corner[1]] = strip[2][own]
    return out


def _tiles_of(sums: np.ndarray | None, key: tuple | None, group: int, size: int) -> Iterator[pa.RecordBatch]:
    """A row per output tile of a group that is not zero."""
    if sums is None:
        return
    for i, k in np.ndindex(group, group):
        tile = np.ascontiguousarray(sums[i * size : (i + 1) * size, k * size : (k + 1) * size])
        yield from _batches({(key[0] * group + i, key[1] * group + k): tile}, SCHEMA)


def _batches(sums: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row per output tile that is not zero."""
    for (i, k), out in sums.items():
        cells = np.flatnonzero(out)
        if len(cells):
            values = out.ravel()[cells]
            columns = [[i], [k], [cells.astype(np.int32)], [values]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _whole(type_: T.DataType) -> bool:
    return isinstance(type_, T.IntegralType)


def matmul_tiles(a: CoordTensor, b: CoordTensor, size: int = TILE, **how) -> CoordTensor:
    """The matrix product of :meth:`CoordTensor.matmul`, by tiles.

    Cells must not be stored twice. Axes that are not whole numbers are numbered in order first and named again
    in the result. Null coordinates match nothing and are left out.
    """
    if a.ndim != 2 or b.ndim != 2:
        raise ValueError("only matrices can be multiplied")
    (i, j), (on, k) = a.axes, b.axes
    out_k = k if k != i else k + "_2"
    left = a.df.select(F.col(i).alias("row"), F.col(j).alias("on"), F.col("value").cast("double").alias("value")).dropna(subset=["row", "on"])
    right = b.df.select(F.col(on).alias("on"), F.col(k).alias("col"), F.col("value").cast("double").alias("value")).dropna(subset=["on", "col"])

    def numbered(df: DataFrame, axis: str, numbers: DataFrame | None) -> DataFrame:
        if numbers is None:
            return df.withColumn(axis, F.col(axis).cast("bigint"))
        rows = df.groupBy(F.col(axis).alias("coordinate")).agg(F.count(F.lit(1)).alias("_rows"))
        # a coordinate may hold most of the cells
        lookup = Lookup.build(numbers.join(rows, "coordinate").withColumnRenamed("coordinate", axis), [axis], "_rows", 1, "positions")
        return lookup.join(df).drop(axis).withColumnRenamed("position", axis)

    inner = None
    if not (_whole(left.schema["on"].dataType) and _whole(right.schema["on"].dataType)):
        both = left.select("on").unionByName(right.select("on"))
        inner = materialize(_numbers(both, "on"), "numbers")
    outer = {"row": None, "col": None}
    for df, axis in ((left, "row"), (right, "col")):
        if not _whole(df.schema[axis].dataType):
            outer[axis] = materialize(_numbers(df, axis), "numbers")
    left = numbered(numbered(left, "on", inner), "row", outer["row"])
    right = numbered(numbered(right, "on", inner), "col", outer["col"])
    cells = TileMatrix.of(left, "row", "on", size).matmul(TileMatrix.of(right, "on", "col", size), **how)
    for axis, numbers in outer.items():
        if numbers is not None:
            names = numbers.select(F.col("position").alias(axis), F.col("coordinate").alias(f"_{axis}"))
            cells = cells.join(names, axis).drop(axis).withColumnRenamed(f"_{axis}", axis)
    types = dict(a.df.dtypes)[i], dict(b.df.dtypes)[k]
    return CoordTensor(cells.select(F.col("row").cast(types[0]).alias(i), F.col("col").cast(types[1]).alias(out_k), "value"), [i, out_k])
