"""Line-oriented corpora and their label files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.stem import stem_features
from lexmill.functions.text import bag_of_words, default_stop_words, drop_stop_words, python_tokenizer
from lexmill.operators.ranking import running_total
from lexmill.storage import materialize, place

# A block is a file split, 128 MB by default; a million of them are 100 TB and
# make a broadcast of well under 200 MB.
BROADCAST_BLOCKS = 1_000_000
# So few block counts, 12 TB worth of splits, are summed in one task.
ONE_TASK_BLOCKS = 100_000


def line_index(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as ``line_no, value``, numbered from 0 in file order.

    Part files of a folder follow each other by their number, others by name.
    The lines are stored once with the file split they were read in, so that the
    numbers cannot depend on how a later scan happens to be split. The number of
    a line is the count of all lines in earlier splits plus its position in its
    own. The lines themselves are never shuffled.
    """
    file = F.col("_metadata.file_path")
    lines = spark.read.text(path).select(
        "value",
        file.alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
    )
    lines = materialize(lines, "lines")
    blocks = lines.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    part = F.regexp_extract("_file", r"/part-(\d+)[^/]*$", 1)
    blocks = blocks.withColumn("_folder", F.regexp_replace("_file", "[^/]*$", ""))
    blocks = materialize(blocks.withColumn("_part", F.when(part != "", part.cast("bigint"))), "blocks")
    order = ["_folder", "_part", "_file", "_start"]
    n_blocks = blocks.count()
    if n_blocks <= ONE_TASK_BLOCKS:
        upto = F.sum("_n").over(Window.orderBy(*order))
        starts = blocks.withColumn("before", upto - F.col("_n"))
    else:
        starts = running_total(blocks, order, F.col("_n"))
    starts = starts.select("_file", "_start", "_first", "before")
    if n_blocks <= BROADCAST_BLOCKS:
        starts = F.broadcast(starts)
    return lines.join(starts, ["_file", "_start"]).select(
        (F.col("before") + F.col("_row") - F.col("_first")).alias("line_no"), "value"
    )


def label_lines(lines: DataFrame, suffix: str = "CAT") -> DataFrame:
    """``line_no, label`` for every label with the suffix on a comma-separated line."""
    return lines.select("line_no", F.explode(F.split("value", ",")).alias("label")).filter(
        F.col("label").endswith(suffix)
    )


# Reading without stop words and stems.
PLAIN = {"stop_words": (), "stem": False}


class Loader:
    """Reads a corpus file, one document per line, and optionally its label file.

    Without labels the features are ``doc_id, feature, value``. With labels a
    document is dropped if it has none and counted once under each one it has;
    the copies are told apart by ``true_label``, so features are ``doc_id,
    true_label, feature, value`` and labels ``doc_id, true_label, label``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def read(
        self,
        data_path: str,
        label_path: str | None = None,
        tokenizer: Callable[[Column], Column] | object | None = None,
        preprocess: Callable[[Column], Column] | None = None,
        decode: bool = True,
        stop_words: str | Sequence[str] | DataFrame = "english",
        stem: bool = True,
    ) -> tuple[DataFrame, DataFrame | None]:
        """Read word counts and labels.

        ``tokenizer`` maps a text column to an array of words, or is an object
        with ``tokenize(text)``; ``preprocess`` maps a word column to a word,
        empty to drop it. With ``decode`` character references are decoded before
        a text is cut. Stop words may be the name of a language, a list or a
        one-column table, and none if the list is empty. With ``stem`` words are
        replaced by their English stems. PLAIN has the options that switch the
        last two off.
        """
        docs = line_index(self.spark, data_path).select(F.col("line_no").alias("doc_id"), "value")
        docs = place(docs, ["doc_id"])
        labels = None
        if label_path is not None:
            pairs = label_lines(line_index(self.spark, label_path)).select(
                F.col("line_no").alias("doc_id"), F.col("label").alias("true_label")
            )
            pairs = place(pairs, ["doc_id"])
            docs = docs.join(pairs, "doc_id", "left_semi")
            labels = pairs.withColumn("label", F.col("true_label"))
        if hasattr(tokenizer, "tokenize"):
            tokenizer = python_tokenizer(tokenizer)
        features = bag_of_words(
            docs,
            ["doc_id"],
            placed=True,
            text="value",
            tokenizer=tokenizer,
            preprocess=preprocess,
            decode=decode,
        )
        if labels is not None:
            # a text is cut once, whatever the number of its labels
            features = features.join(pairs, "doc_id").select("doc_id", "true_label", "feature", "value")
        # a word is dropped with all its occurrences, so counted words will do
        if isinstance(stop_words, str):
            stop_words = default_stop_words(stop_words)
        if isinstance(stop_words, DataFrame):
            features = drop_stop_words(features, stop_words)
        elif stop_words:
            features = features.filter(~F.col("feature").isin(list(stop_words)))
        if stem:
            features = stem_features(features, ["doc_id"])
        return features, labels
