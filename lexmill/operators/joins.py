"""Equi-joins that hold up when a few keys carry most of the rows.

Word tables follow Zipf's law: a few thousand words make up most of the rows.
Both joins below single out keys holding more than 1/HOT_KEYS of all rows. By
counting there are fewer than HOT_KEYS of them, whatever the size of the data,
which is the bound that makes broadcasting them safe.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.storage import is_stored, materialize

HOT_KEYS = 4096
# A table of at most this size is broadcast whole.
BROADCAST_BYTES = 64 << 20


@dataclass
class Lookup:
    """A written table with one row per key, and its measured size.

    ``rows`` names the column saying how many rows of the joined-to table are
    expected per key; it decides which keys count as hot. ``width`` is the
    largest number of 8-byte values in a row besides the key.
    """

    df: DataFrame
    on: tuple[str, ...]
    rows: str
    n_keys: int
    n_rows: int
    key_bytes: int
    width: int
    broadcast_bytes: int = BROADCAST_BYTES

    @classmethod
    def build(cls, df: DataFrame, on: Sequence[str], rows: str, width: int = 1, name: str = "lookup") -> "Lookup":
        return cls.of(materialize(df, name), on, rows, width)

    @classmethod
    def of(cls, df: DataFrame, on: Sequence[str], rows: str, width: int = 1) -> "Lookup":
        """Wrap a table that is already stored."""
        return cls(df, tuple(on), rows, *df.agg(*cls.measures(on, rows)).first(), width)

    @staticmethod
    def measures(on: Sequence[str], rows: str) -> list[Column]:
        """Aggregates giving the number of keys, of expected rows, and the bytes of all keys."""
        key_bytes = sum((F.octet_length(F.col(c).cast("string")) for c in on), F.lit(0))
        return [F.count(F.lit(1)), F.coalesce(F.sum(rows), F.lit(0)).cast("bigint"), F.coalesce(F.sum(key_bytes), F.lit(0))]

    @property
    def size(self) -> int:
        return self.key_bytes + self.n_keys * self._row_bytes

    @property
    def _row_bytes(self) -> int:
        return 32 + 8 * self.width

    @property
    def is_broadcast(self) -> bool:
        """Whether the whole table is small enough to be in each task."""
        return self.size <= self.broadcast_bytes

    @property
    def hot_is_broadcast(self) -> bool:
        """Whether the rows of hot keys, of which there are fewer than HOT_KEYS, are."""
        return HOT_KEYS * self._row_bytes <= BROADCAST_BYTES

    @property
    def is_hot(self) -> Column:
        return F.col(self.rows) > F.lit(self.n_rows / HOT_KEYS)

    def near(self) -> Column:
        """Whether a key is hot or one of the most frequent, as many as half of ``broadcast_bytes`` holds."""
        most = self.broadcast_bytes // 2 // (self._row_bytes + -(-self.key_bytes // max(self.n_keys, 1)))
        size, cut = F.floor(F.ln(F.greatest(F.col(self.rows), F.lit(1))) * 8), None
        # a few hundred rows at most
        for r in self.df.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():
            most -= r["count"]
            if most < 0:
                break
            cut = r["size"]
        return F.coalesce(self.is_hot if cut is None else self.is_hot | (size >= cut), F.lit(False))

    def join(self, left: DataFrame, how: str = "inner") -> DataFrame:
        """``left`` (many rows per key) joined with this table.

        A table of bounded size is broadcast. A larger one is cut in two: rows
        with a hot key, or one of the most frequent, meet the broadcast part of these
        and are not shuffled at all, the others are shuffled on a key of which no value has more than its
        small share of the rows. Both halves read ``left``, so it is stored once
        first, unless it is the scan of a stored table. If even the hot part is too wide to broadcast, hot keys are dealt
        out instead: the table repeats them, each row of ``left`` takes one copy.
        """
        on = list(self.on)
        table = self.df.drop(self.rows) if self.rows in left.columns else self.df
        if self.is_broadcast:
            return left.join(F.broadcast(table), on, how)
        share = self.n_rows / HOT_KEYS
        is_hot = self.is_hot
        if not self.hot_is_broadcast:
            parts = F.ceil(F.col(self.rows) / F.lit(max(share, 1.0))).cast("int")
            # fewer than HOT_KEYS keys and numbers
            dealt = left.join(F.broadcast(self.df.filter(is_hot).select(*on, parts.alias("_parts"))), on, "left")
            rest = [c for c in left.columns if c not in on]
            part = F.pmod(F.xxhash64(*rest), F.coalesce("_parts", F.lit(1))).cast("int") if rest else F.lit(0)
            copies = F.sequence(F.lit(0), F.when(is_hot, parts).otherwise(1) - 1)
            repeated = self.df.withColumn("_part", F.explode(copies)).select(*table.columns, "_part")
            return dealt.withColumn("_part", part).drop("_parts").join(repeated, [*on, "_part"], how).drop("_part")
        left = left if is_stored(left) else materialize(left, "lookup_rows")
        near = self.near()
        hot = self.df.filter(near).select(*table.columns)
        cold = self.df.filter(~near).select(*table.columns)
        with_hot = left.join(F.broadcast(hot), on, "inner")
        others = left.join(F.broadcast(hot.select(*on)), on, "left_anti")
        return with_hot.unionByName(others.join(cold, on, how))


# Classes of at most this size are one array in each task.
CLASS_BYTES = 4 << 20


def class_array_bytes(classes: DataFrame) -> int:
    """About the size of all rows of a table with one row per class."""
    row = F.octet_length(F.to_json(F.struct(*classes.columns))) + 16
    return classes.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]


def beside_each(df: DataFrame, classes: DataFrame) -> DataFrame:
    """Every row of ``df`` beside every row of a table with one row per class.

    Classes of bounded size are made one array, which each row then unfolds by
    itself. More are cut into arrays of bounded size, with which copies of the
    rows are joined, dealt out over all tasks.
    """
    entry = F.struct(*classes.columns)
    size = class_array_bytes(classes)
    if size <= CLASS_BYTES:
        nested = classes.agg(F.collect_list(entry)).scalar()
        return df.withColumn("_c", F.explode(nested)).select(*df.columns, "_c.*")
    chunks = -(-size // CLASS_BYTES)
    deals = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunk = F.pmod(F.xxhash64(*classes.columns), F.lit(chunks)).cast("int").alias("_chunk")
    arrays = classes.groupBy(chunk).agg(F.collect_list(entry).alias("_classes"))
    arrays = arrays.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    copies = df.withColumn("_deal", F.pmod(F.xxhash64(*df.columns), F.lit(deals)).cast("int"))
    copies = copies.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    joined = copies.join(arrays, ["_chunk", "_deal"]).withColumn("_c", F.explode("_classes"))
    return joined.select(*df.columns, "_c.*")


# A key is dealt out only if its parts get at least this many rows.
PART_ROWS = 10_000


def product_join(a: DataFrame, b: DataFrame, on: str, part_rows: int = PART_ROWS) -> DataFrame:
    """All matching pairs of two tables that both may repeat a key.

    Rows of a hot key are dealt out over several cells of a grid: each side is
    cut into as many parts as its share asks for and repeated for the parts of
    the other side, so every pair still meets exactly once.
    """

    def hot_parts(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(on).agg(F.count(F.lit(1)).alias("_n"))
        share = F.greatest(counts.agg(F.sum("_n") / F.lit(HOT_KEYS)).scalar(), F.lit(float(part_rows)))
        return counts.filter(F.col("_n") > share).select(
            on, F.ceil(F.col("_n") / share).cast("int").alias(name)
        )

    hot = hot_parts(a, "_pa").join(hot_parts(b, "_pb"), on, "full_outer")

    def dealt(df: DataFrame, own: str, other: str, own_cell: str, other_cell: str) -> DataFrame:
        rest = [c for c in df.columns if c != on]
        return (
            df.join(F.broadcast(hot), on, "left")
            .withColumn(own_cell, F.pmod(F.xxhash64(*rest), F.coalesce(F.col(own), F.lit(1))).cast("int"))
            .withColumn(other_cell, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)))
            .drop("_pa", "_pb")
        )

    left = dealt(a, "_pa", "_pb", "_ca", "_cb")
    right = dealt(b, "_pb", "_pa", "_cb", "_ca")
    return left.join(right, [on, "_ca", "_cb"]).drop("_ca", "_cb")
