import math

import numpy as np
import pytest

from lexmill.operators.tensor import CoordTensor


@pytest.fixture()
def tensor(spark):
    def make(cells, axes=("i", "j"), types="bigint"):
        schema = ", ".join(f"{a} {types}" for a in axes) + ", value double"
        return CoordTensor(spark.createDataFrame([(*k, float(v)) for k, v in cells.items()], schema), axes)

    return make


def cells(t):
    return {tuple(r)[:-1]: r[-1] for r in t.df.select(*t.axes, "value").collect()}


def dense(array):
    return {k: v for k, v in np.ndenumerate(array) if v != 0}


A = {(0, 0): 1, (0, 1): 2}
B = {(0, 1): -2, (1, 1): 5}


def test_sum_treats_missing_cells_as_zero_and_drops_zeros(tensor):
    a, b = tensor(A), tensor(B)
    assert cells(a + b) == {(0, 0): 1, (1, 1): 5}
    assert cells(a.add(b, strict=True)) == {}
    assert cells(a - b) == {(0, 0): 1, (0, 1): 4, (1, 1): -5}
    assert cells(a - a) == {}
    with pytest.raises(ValueError):
        a + tensor({(0,): 1}, ("i",))


def test_products_and_signs(tensor):
    a, b = tensor(A), tensor(B)
    assert cells(a * b) == {(0, 1): -4}
    assert cells(a * 3) == {(0, 0): 3, (0, 1): 6}
    assert cells(a * 0) == {}
    assert cells(-b) == {(0, 1): 2, (1, 1): -5}
    assert cells(abs(b)) == {(0, 1): 2, (1, 1): 5}


def test_matmul_agrees_with_dense_product(tensor):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-3, 4, (7, 5)), rng.integers(-3, 4, (5, 6))
    ta, tb = tensor(dense(a)), tensor(dense(b))
    assert cells(ta @ tb) == dense(a @ b)
    assert cells((ta @ tb).t) == cells(tb.t @ ta.t)
    with pytest.raises(ValueError):
        ta @ tensor({(0,): 1}, ("i",))


def test_square_product_keeps_axes_apart(tensor):
    a = np.arange(9).reshape(3, 3)
    t = tensor(dense(a))
    assert cells(t.t @ t) == dense(a.T @ a)


def test_transpose_of_three_axes(tensor):
    t = tensor({(0, 1, 2): 5}, ("i", "j", "k"))
    assert cells(t.t) == {(1, 0, 2): 5}
    assert cells(t.transpose([2, 0, 1])) == {(2, 0, 1): 5}


def test_cells(tensor):
    t = tensor(A)
    assert t[0, 1] == 2 and t[5, 5] == 0
    t[5, 5] = 7
    assert t[5, 5] == 7
    t[0, 1] = 0
    assert cells(t) == {(0, 0): 1, (5, 5): 7}
    with pytest.raises(ValueError):
        t[(0,)]


def test_max_and_argmax(tensor):
    t = tensor({(0, 0): 1, (0, 1): 3, (0, 2): 3, (1, 0): -2})
    assert cells(t.max(axis=1)) == {(0,): 3, (1,): -2}
    assert cells(t.argmax(axis=1)) == {(0,): 1, (1,): 0}
    assert cells(t.argmax(axis=0)) == {(0,): 0, (1,): 0, (2,): 0}


def test_softmax_does_not_overflow(tensor):
    t = tensor({("d", "A"): 1000, ("d", "B"): 999}, types="string")
    got = cells(t.softmax())
    assert got[("d", "A")] == pytest.approx(1 / (1 + math.exp(-1)))
    logs = cells(t.log_softmax())
    assert all(logs[k] == pytest.approx(math.log(v)) for k, v in got.items())


@pytest.mark.parametrize("axis", [0, 1, 2])
def test_softmax_adds_up_to_one(tensor, axis):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(3, 4, 2)) * 50
    got = np.zeros_like(a)
    for k, v in cells(tensor(dense(a), ("i", "j", "k")).softmax(axis)).items():
        got[k] = v
    e = np.exp(a - a.max(axis=axis, keepdims=True))
    np.testing.assert_allclose(got, e / e.sum(axis=axis, keepdims=True), rtol=1e-12)


def test_softmax_of_a_vector(tensor):
    got = cells(tensor({(0,): 0.0001, (1,): 0.0001}, ("i",)).softmax(axis=0))
    assert got == {(0,): pytest.approx(0.5), (1,): pytest.approx(0.5)}


def test_random_tensors(spark):
    whole = CoordTensor.rand_int(spark, 3, shape=(40, 30), seed="a")
    values = list(cells(whole).values())
    assert len(values) == 1200 and set(values) == {0.0, 1.0, 2.0}
    assert cells(whole) == cells(CoordTensor.rand_int(spark, 0, 3, (40, 30), "a"))
    draws = np.array(list(cells(CoordTensor.normal(spark, 5.0, 2.0, (100, 100), "b")).values()))
    assert abs(draws.mean() - 5) < 0.1 and abs(draws.std() - 2) < 0.1
    assert set(cells(CoordTensor.rand_int(spark, 9))) == {(0,)}


def test_dense_round_trip(spark, rows):
    df = spark.createDataFrame([(0, [1.0, 0.0, 3.0, 4.0, 5.0]), (1, [0.0] * 4 + [9.0])], "i bigint, a array<double>")
    t = CoordTensor.from_arrays(df, ["i"], "a", "j")
    kept = CoordTensor(t.df.filter("value <> 0"), t.axes)
    assert rows(kept.to_dense(5)) == [(0, 0, [1.0, 0.0, 3.0, 4.0, 5.0]), (1, 0, [0.0] * 4 + [9.0])]
    assert rows(kept.to_dense(5, block=3)) == [
        (0, 0, [1.0, 0.0, 3.0]),
        (0, 1, [4.0, 5.0]),
        (1, 0, [0.0, 0.0, 0.0]),
        (1, 1, [0.0, 9.0]),
    ]


def test_dense_form_of_any_index(tensor, rows):
    t = tensor({("d", "x"): 1, ("c", "x"): 2, ("d", "a"): 3}, types="string")
    assert rows(t.to_dense(block=1)) == [("c", 0, [0.0]), ("c", 1, [2.0]), ("d", 0, [3.0]), ("d", 1, [1.0])]
    assert rows(CoordTensor(t.df.limit(0), t.axes).to_dense()) == []


def test_dense_form_of_more_axes_and_of_coordinates_outside(spark, rows):
    df = spark.createDataFrame([(0, "u", 2, 1.0), (0, "v", 0, 2.0)], "i bigint, k string, j bigint, value double")
    t = CoordTensor(df, ["i", "k", "j"])
    assert rows(t.to_dense(3)) == [(0, "u", 0, [0.0, 0.0, 1.0]), (0, "v", 0, [2.0, 0.0, 0.0])]
    with pytest.raises(Exception, match="outside 0 to 1"):
        t.to_dense(2).collect()


def test_axis_index(tensor, rows):
    t = tensor({("d", "x"): 1, ("c", "x"): 1, ("d", "a"): 1}, types="string")
    assert rows(t.axis_index("i")) == [("c", 0), ("d", 1)]
