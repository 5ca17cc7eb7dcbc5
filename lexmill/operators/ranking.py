"""Exact global ranks, running totals and top-n cuts without a one-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.joins import Lookup
from lexmill.storage import materialize

# Width of the hash histogram used to find a cut: four hex digits.
HASH_BUCKETS = 65536


def running_total(df: DataFrame, order: Sequence[str], value: Column) -> DataFrame:
    """Add ``before``: the sum of ``value`` over all rows that sort earlier.

    ``order`` must identify a row. Rows are range-partitioned and written with
    their partition number, so only one total per partition is summed in a
    single task; the running sums inside the partitions stay parallel.
    """
    ranged = df.withColumn("_v", value.cast("bigint")).repartitionByRange(
        *[F.col(c) for c in order]
    )
    ranged = materialize(ranged.withColumn("_range", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy("_range").agg(F.sum("_v").alias("_sum"))
    parts = parts.select(
        "_range",
        (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_base"),
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    return (
        ranged.withColumn("_run", F.sum("_v").over(inside) - F.col("_v"))
        # one row per range partition, never more than spark.sql.shuffle.partitions
        .join(F.broadcast(parts), "_range")
        .withColumn("before", F.col("_base") + F.col("_run"))
        .drop("_range", "_run", "_base", "_v")
    )


def hash_hex(seed: str, *cols: str | Column) -> Column:
    """A reproducible 128-bit hash of the columns, as hex text."""
    parts = [F.lit(str(seed))]
    parts += [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def hash_int(hexed: Column, start: int = 1, digits: int = 7) -> Column:
    """``digits`` hex digits of a hash as a bigint."""
    return F.conv(F.substring(hexed, start, digits), 16, 10).cast("bigint")


def lowest_by_hash(
    df: DataFrame, keys: Sequence[str], groups: Sequence[str], seed: str, quota: DataFrame
) -> DataFrame:
    """Per group keep the ``quota`` rows with the lowest ``md5(seed|keys)``.

    ``quota`` has one row per group (or one row in all when ``groups`` is
    empty) with the column ``quota``. A histogram over hash prefixes finds the
    prefix at which each group's quota is met; rows below it are kept as they
    are and only rows sharing that prefix, 1 in 65,536, are ranked. So a class
    holding most of the rows is never sorted in one task.
    """
    groups, keys = list(groups), list(keys)
    hashed = df.withColumn("_h", hash_hex(seed, *keys)).withColumn(
        "_b", hash_int(F.col("_h"), digits=4).cast("int")
    )
    counts = hashed.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_n"))
    # at most HASH_BUCKETS rows per group
    by_group = Window.partitionBy(*groups)
    cut = counts.withColumn("_upto", F.sum("_n").over(by_group.orderBy("_b")))
    cut = cut.withColumn("_rows", F.sum("_n").over(by_group))
    if groups:
        cut = cut.join(quota, groups)
    else:
        cut = cut.withColumn("quota", quota.select("quota").scalar())
    # groups no larger than their quota have no cut and are kept whole
    cut = cut.filter("_rows > quota and _upto >= quota and _upto - _n < quota").select(
        *groups, "_rows", F.col("_b").alias("_cut"), F.expr("quota - _upto + _n as _need")
    )
    if groups:
        placed = Lookup.build(cut, groups, "_rows", 3, "cuts").join(hashed, "left")
    else:
        found = cut.first()
        if found is None:
            return df
        placed = hashed.withColumn("_cut", F.lit(found["_cut"])).withColumn("_need", F.lit(found["_need"]))
    below = placed.filter("_cut is null or _b < _cut").select(*df.columns)
    within = Window.partitionBy(*groups, "_b").orderBy("_h", *keys)
    edge = placed.filter("_b = _cut").withColumn("_rank", F.row_number().over(within))
    return below.unionByName(edge.filter("_rank <= _need").select(*df.columns))
