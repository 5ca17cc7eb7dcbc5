"""Mergeable sketches of vocabularies: distinct words counted once per split, then added up without the text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A sketch has 2**LG_K registers: 16 kB at most, standard error about 0.8 %.
LG_K = 14


def vocabulary_sketches(x: DataFrame, by: Sequence[str], word: str = "feature") -> DataFrame:
    """``by, sketch, rows``: one sketch of the distinct words per split, from features or words. Null words do not count."""
    return x.groupBy(*by).agg(F.hll_sketch_agg(word, F.lit(LG_K)).alias("sketch"), F.count(word).alias("rows"))


def merged_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sketches of coarser splits: each equals the sketch of all words of its parts."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("rows").alias("rows"))


def vocabulary_estimates(sketches: DataFrame) -> DataFrame:
    """``vocabulary`` in place of the sketch: about how many distinct words it has seen."""
    kept = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*kept, F.hll_sketch_estimate("sketch").alias("vocabulary"))


class SketchStore:
    """Sketches of a growing corpus in a folder: each part's are added once and never change.

    A part is a day or any other name; adding one again replaces its sketches.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def add(self, part: str, x: DataFrame, by: Sequence[str] = (), word: str = "feature") -> None:
        sketches = vocabulary_sketches(x, by, word).withColumn("part", F.lit(part))
        sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)

    def read(self) -> DataFrame:
        """``by, sketch, rows, part``: small beside the corpus; parts not wanted are not read."""
        return self.spark.read.option("basePath", self.path).parquet(self.path)

    def estimate(self, by: Sequence[str] = ()) -> DataFrame:
        """``by, rows, vocabulary`` over all parts."""
        return vocabulary_estimates(merged_sketches(self.read(), by))
