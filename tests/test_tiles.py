import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators.tensor import CoordTensor
from lexmill.operators import tiles as tiles_
from lexmill.operators.tiles import TileMatrix, matmul_tiles
from lexmill.storage import materialize


def matrix(spark, dense, names=("i", "j"), shift=0):
    cells = [(int(i) + shift, int(j) + shift, float(v)) for (i, j), v in np.ndenumerate(dense) if v]
    return CoordTensor(spark.createDataFrame(cells, f"{names[0]} bigint, {names[1]} bigint, value double"), names)


def shuffled_bytes(df):
    """Bytes that the exchanges of a DataFrame wrote when it was computed."""
    df.collect()

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            yield from walk(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            yield from walk(node.plan())
        elif name == "ReusedExchangeExec":
            return
        else:
            metric = node.metrics().get("shuffleBytesWritten")
            if name == "ShuffleExchangeExec" and metric.isDefined():
                yield metric.get().value()
            children = node.children()
            for i in range(children.length()):
                yield from walk(children.apply(i))

    return sum(walk(df._jdf.queryExecution().executedPlan()))


@pytest.mark.parametrize("shift", [0, -37])
@pytest.mark.parametrize("how", [{}, {"group": 1, "inner": 2}, {"group": 4, "pairs": 500}])
def test_product(spark, shift, how):
    rng = np.random.default_rng(1)
    a = rng.integers(-3, 4, (30, 50)) * (rng.random((30, 50)) < 0.3)
    b = rng.integers(-3, 4, (50, 20)) * (rng.random((50, 20)) < 0.6)
    b[7] = 0
    out = matmul_tiles(matrix(spark, a, shift=shift), matrix(spark, b, ("j", "k"), shift), 8, **how)
    assert out.axes == ["i", "k"]
    want = {(i + shift, k + shift): v for (i, k), v in np.ndenumerate(a @ b) if v}
    assert {(r.i, r.k): r.value for r in out.df.collect()} == want


def test_named_axes_and_equal_names(spark, rows):
    cells = [("b", "x", 2.0), ("a", "y", 3.0), ("a", "x", 1.0), (None, "x", 9.0), ("c", None, 9.0)]
    a = CoordTensor(spark.createDataFrame(cells, "i string, j string, value double"), ["i", "j"])
    out = matmul_tiles(a, a.t, 2)
    assert out.axes == ["i", "i_2"]
    assert rows(out.df) == [("a", "a", 10.0), ("a", "b", 2.0), ("b", "a", 2.0), ("b", "b", 4.0)]
    empty = CoordTensor(a.df.limit(0), ["i", "j"])
    assert matmul_tiles(a, empty.t).df.count() == 0
    with pytest.raises(ValueError):
        matmul_tiles(CoordTensor(a.df, ["i"]), a)


def test_cells_of_tiles(spark, rows):
    dense = np.arange(35.0).reshape(5, 7)
    a = matrix(spark, dense)
    tiles = TileMatrix.of(a.df, "i", "j", 3)
    assert tiles.df.count() == 6
    assert rows(tiles.cells()) == rows(a.df)
    with pytest.raises(ValueError):
        tiles.matmul(TileMatrix.of(a.df, "j", "i", 4))


def test_dense_products_shuffle_a_tenth_of_the_coordinate_form(spark, monkeypatch):
    # 120 pairs and more for each of 90,000 cells, over as many tasks as a small cluster has
    m, n = 300, 360
    cells = spark.range(m * n).select(F.expr(f"id div {n}").alias("i"), (F.col("id") % n).alias("j"), (F.pmod(F.xxhash64("id"), F.lit(11)) + 1).cast("double").alias("value"))
    a = CoordTensor(materialize(cells.filter("pmod(xxhash64(j, i), 5) < 3"), "cells"), ["i", "j"])
    stored = []
    monkeypatch.setattr("lexmill.operators.tiles.materialize", lambda df, name: stored.append(shuffled_bytes(df)) or materialize(df, name))
    # as where neither side is small enough to be broadcast
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        tiled = matmul_tiles(a, a.t, 128)
        by_tiles = shuffled_bytes(tiled.df) + sum(stored)
        plain = a @ a.t
        by_cells = shuffled_bytes(plain.df)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, tiled.df.collect())) == sorted(map(tuple, plain.df.collect()))
    assert 0 < by_tiles <= by_cells / 10, (by_tiles, by_cells)


def test_groups_that_share_no_places_are_not_cut(spark):
    # eight blocks of 16 by 40 along the diagonal: ten inner places for each group, eighty for all of them
    cells = spark.range(8 * 16 * 40).select(F.expr("id div 40").alias("i"), F.expr("id div 640 * 40 + id % 40").alias("j"), F.expr("cast(id % 7 + 1 as double)").alias("value"))
    a = CoordTensor(materialize(cells, "cells"), ["i", "j"])
    once, cut = (matmul_tiles(a, a.t, 4, group=4, inner=inner) for inner in (1000, 10))
    assert sorted(map(tuple, cut.df.collect())) == sorted(map(tuple, once.df.collect()))
    assert shuffled_bytes(cut.df) <= 1.1 * shuffled_bytes(once.df)


def test_sparse_products_shuffle_few_bytes_a_cell(spark):
    # some 100 cells in each of 600 inner places: about three pairs a cell of the product, which are not summed up in parts
    cells = spark.range(512 * 9600).filter("pmod(xxhash64(id), 80) = 0").select(F.expr("id div 9600").alias("i"), F.expr("id % 9600").alias("j"), F.expr("cast(id % 50 + 1 as double)").alias("value"))
    a = CoordTensor(materialize(cells, "cells"), ["i", "j"])
    n = a.df.count()
    tiled = matmul_tiles(a, a.t, 16)
    by_tiles = shuffled_bytes(tiled.df)
    assert sorted(map(tuple, tiled.df.collect())) == sorted(map(tuple, (a @ a.t).df.collect()))
    assert by_tiles <= 20 * n, (by_tiles, n)


def test_packed_cells_come_back(monkeypatch):
    rng = np.random.default_rng(2)
    for n in (1, 2, 999):
        cells = np.sort(rng.choice(1 << 30, n, replace=False)).astype(np.int32)
        values = rng.choice([0.0, -0.0, 1.0, 1e-310, np.inf, -np.inf, np.nan, np.pi], n)
        at, back = tiles_._unpacked(tiles_._packed(cells, values), n)
        assert at.tolist() == cells.tolist() and back.tobytes() == values.tobytes()
    # pair by pair, a few at a time, is as good as by dense tiles
    a, b = ((np.sort(rng.choice(64 * 8, 300, replace=False)), rng.integers(1, 9, 300).astype(float)) for _ in range(2))
    left, right = (a[0] // 8, a[0] % 8, a[1]), (b[0] // 64, b[0] % 64, b[1])
    sums = []
    for sparse, at_once in ((0, 1), (1e9, 1), (1e9, 7), (1e9, 1 << 20)):
        monkeypatch.setattr(tiles_, "SPARSE", sparse)
        monkeypatch.setattr(tiles_, "PAIRS_AT_ONCE", at_once)
        sums.append(np.zeros((64, 64)))
        tiles_._add_product(sums[-1], left, right, 8)
    assert sums[0].any() and all((s == sums[0]).all() for s in sums)
