"""What the vector operators share: usable vectors, one row per distinct vector, bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """The vector has finite components only and is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def usable_rows(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (vec_id, v) that can be compared: an id, and a usable vector of the length that most of them have.

    Of equally frequent lengths the smaller one counts.
    """
    rows = df.select(df[id_col].cast("bigint").alias("vec_id"), df[vector_col].cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    top = lengths.orderBy(F.desc("n"), "size").first()
    return rows.filter(F.size("v") == top["size"]) if top else rows


def vector_id(v: Column) -> Column:
    """128 bits that tell vectors apart."""
    return F.struct(F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v, F.lit(2)).alias("h2"))


def stack(series) -> np.ndarray:
    """A column of arrays as a matrix."""
    return np.array(series.tolist(), np.float64).reshape(len(series), -1)


def sample_matrix(rows: DataFrame, n: int, seed: int) -> np.ndarray:
    """At most ``n`` vectors, chosen by a hash, on the driver."""
    sample = rows.select("v", F.xxhash64(F.lit(seed), "vec_id", "v").alias("h")).orderBy("h").limit(n).select("v").toPandas()
    return stack(sample["v"]) if len(sample) else np.zeros((0, 0))
