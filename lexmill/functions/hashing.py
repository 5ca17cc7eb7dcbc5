"""Reproducible random numbers as column expressions.

A value depends on the seed and the cell's own index only, so it is the same on
every retry, for every partitioning, and in any engine that has md5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.operators.ranking import hash_hex, hash_int

_DIGITS = 12
_SPAN = float(16**_DIGITS)


def uniform(seed: str, *cols: str | Column) -> Column:
    """A number in (0, 1)."""
    return (hash_int(hash_hex(seed, *cols), 1, _DIGITS).cast("double") + 0.5) / _SPAN


def standard_normal(seed: str, *cols: str | Column) -> Column:
    """A standard normal draw (Box and Muller's transform of two hash halves)."""
    hexed = hash_hex(seed, *cols)
    u = (hash_int(hexed, 1, _DIGITS).cast("double") + 0.5) / _SPAN
    v = (hash_int(hexed, 1 + _DIGITS, _DIGITS).cast("double") + 0.5) / _SPAN
    return F.sqrt(-2.0 * F.ln(u)) * F.cos(F.lit(2.0) * F.pi() * v)


def table_normal(seed: str, size: int, *cols: str | Column) -> Column:
    """The entry of a fixed table of ``size`` normals that the columns hash to."""
    entry = hash_int(hash_hex("cell", *cols)) % F.lit(size)
    return standard_normal(seed, entry)
