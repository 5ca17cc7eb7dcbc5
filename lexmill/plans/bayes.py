"""Naive Bayes over present words, and Gaussian naive Bayes over their values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.gaussian import log_density, log_tail
from lexmill.operators.joins import BROADCAST_BYTES, CLASS_BYTES, Lookup, beside_each, class_array_bytes  # noqa: F401
from lexmill.operators.metrics import accuracy
from lexmill.operators.tensor import best
from lexmill.plans.blocks import best_of_blocks, packed_cells
from lexmill.plans.classes import WIDE_LABELS, Classes, best_slot, with_label
from lexmill.storage import is_stored, materialize, materialize_placed

# Up to this many classes each have a slot in a document's row of sums, and a place of one byte.
SLOT_LABELS = 256
# Sums of documents and classes that one task should hold.
BLOCK_SUMS = 4_000_000


class NaiveBayes:
    """Naive Bayes with add-one smoothing.

    ``denominator``  what the smoothed word counts of a class are divided by,
        besides the vocabulary size: its number of ``docs`` or of ``words``.
    ``weight``  how often a word of a document counts: ``df``, as often as it
        occurs in training documents; ``once``; or ``count``, as often as in the
        document.
    ``unseen``  words outside the vocabulary are dropped, or with ``smooth``
        add ``-ln(1 + denominator)``.
    ``fallback``  predict documents without a known word from the priors
        instead of leaving them out.

    Scores are computed without a table of all labels by all words. With
    ``W = sum(weight)`` over the known words of a document,

        score = log prior - W * ln(denominator) + sum(weight * ln(count + 1))

    where only words seen with a class add to the last sum.
    """

    def __init__(
        self,
        denominator: str = "docs",
        weight: str = "df",
        unseen: str = "drop",
        fallback: bool = False,
        keys: Sequence[str] = ("doc_id",),
        wide: int = WIDE_LABELS,
    ):
        if denominator not in ("docs", "words"):
            raise ValueError("denominator must be 'docs' or 'words'")
        if weight not in ("df", "once", "count"):
            raise ValueError("weight must be 'df', 'once' or 'count'")
        if unseen not in ("drop", "smooth"):
            raise ValueError("unseen must be 'drop' or 'smooth'")
        self.denominator = denominator
        self.weight = weight
        self.unseen = unseen
        self.fallback = fallback
        self.keys = list(keys)
        self.wide = wide

    # -- training ---------------------------------------------------------

    def fit(self, x: DataFrame, y: DataFrame, label_col: str | None = None) -> "NaiveBayes":
        """Train on features ``keys, feature, value`` and labels ``keys, label``.

        If ``x`` carries the labels already, name their column in ``label_col``
        to save the join.
        """
        classes = Classes.fit(y, self.wide)
        x = with_label(x, y, self.keys, label_col)
        # the number of classes decides on the layout of the counts
        if classes.names is not None:
            slots = range(len(classes.names))
            model = x.withColumn("_k", classes.slot_of()).groupBy("feature").agg(
                F.count(F.lit(1)).alias("df"),
                F.array(*[F.expr(f"sum(if(_k = {k}, value, 0D))") for k in slots]).alias("counts"),
            )
        else:
            cells = x.groupBy("feature", "label").agg(
                F.sum("value").alias("count"), F.count(F.lit(1)).alias("rows")
            )
            # one entry per class
            model = cells.groupBy("feature").agg(
                F.sum("rows").alias("df"), F.collect_list(F.struct("label", "count")).alias("cells")
            )
        self._use(materialize(model, "likelihoods"), classes)
        return self

    def fit_counts(self, cells: DataFrame, class_counts: DataFrame) -> "NaiveBayes":
        """Train on counts: cells ``feature, label, count, rows`` (sum of values, number of rows) and ``label, n``.

        Cells of one feature and label may be spread over several rows, which are
        added up. The model is that of :meth:`fit` on what was counted.
        """
        classes = Classes.of(class_counts, self.wide)
        if classes.names is not None:
            slots = range(len(classes.names))
            model = cells.withColumn("_k", classes.slot_of()).groupBy("feature").agg(
                F.sum("rows").alias("df"),
                F.array(*[F.expr(f"sum(if(_k = {k}, count, 0D))") for k in slots]).alias("counts"),
            )
        else:
            whole = cells.groupBy("feature", "label").agg(F.sum("count").alias("count"), F.sum("rows").alias("rows"))
            model = whole.groupBy("feature").agg(
                F.sum("rows").alias("df"), F.collect_list(F.struct("label", "count")).alias("cells")
            )
        self._use(materialize(model, "likelihoods"), classes)
        return self

    def _use(self, model: DataFrame, classes: Classes) -> None:
        self.classes = classes
        self.wide_layout = classes.names is not None
        sizes = Lookup.measures(["feature"], "df")
        if self.wide_layout:
            sizes += [F.expr(f"coalesce(sum(counts[{k}]), 0D)") for k in range(len(classes.names))]
        n_keys, n_rows, key_bytes, *words = model.agg(*sizes).first()
        # a slot is a double; a cell also holds its label
        width = len(classes.names) if self.wide_layout else 6 * classes.count()
        self.model = Lookup(model, ("feature",), "df", n_keys, n_rows, key_bytes, 1 + width)
        if self.wide_layout:
            # slot, name, log prior and denominator of the classes taking part
            self.slots = [
                (k, r["label"], r["log_prior"], float((r["n"] if self.denominator == "docs" else words[k]) + n_keys))
                for k, r in enumerate(classes.rows)
                if words[k] > 0 or self.unseen != "smooth"
            ]
            return
        words = model.select(F.explode("cells").alias("c")).filter("c.count != 0")
        words = words.groupBy("c.label").agg(F.sum("c.count").alias("words"))
        table = classes.table.join(words, "label", "inner" if self.unseen == "smooth" else "left")
        size = F.col("n") if self.denominator == "docs" else F.coalesce("words", F.lit(0.0))
        table = table.select("label", "log_prior", (size + n_keys).cast("double").alias("denominator"))
        self.sizes = materialize(table, "class_sizes")

    @property
    def vocabulary_size(self) -> int:
        return self.model.n_keys

    def priors(self) -> DataFrame:
        """``label, n, log_prior``."""
        return self.classes.table

    def likelihoods(self) -> DataFrame:
        """``label, feature, df, log_likelihood`` for every label and known word."""
        if self.wide_layout:
            cells = F.explode(
                F.array(
                    *[
                        F.struct(F.lit(name).alias("label"), F.expr(f"ln((counts[{k}] + 1D) / {den!r}D) as ll"))
                        for k, name, _, den in self.slots
                    ]
                )
            )
            cells = self.model.df.select("feature", "df", cells.alias("c"))
            return cells.select("c.label", "feature", "df", F.col("c.ll").alias("log_likelihood"))
        seen = self.model.df.select("feature", F.explode("cells").alias("c")).select("feature", "c.*")
        grid = beside_each(self.model.df.select("feature", "df"), self.sizes.select("label", "denominator"))
        seen = grid.join(seen, ["feature", "label"], "left")
        smoothed = F.coalesce("count", F.lit(0.0)) + 1.0
        return seen.select("label", "feature", "df", F.ln(smoothed / F.col("denominator")).alias("log_likelihood"))

    # -- prediction -------------------------------------------------------

    def _matched(self, x: DataFrame) -> DataFrame:
        """Features with the log counts of their words, ``_w`` and ``_u`` (weight if unseen)."""
        if self.wide_layout:
            logs = F.expr("transform(counts, c -> ln(c + 1D)) as logs")
        else:
            logs = F.expr("transform(cells, c -> struct(c.label as label, ln(c.count + 1D) as log)) as logs")
        lookup = replace(self.model, df=self.model.df.select("feature", "df", logs))
        left = self.unseen == "smooth" or self.fallback
        rows = lookup.join(x.select(*self.keys, "feature", "value"), "left" if left else "inner")
        weight = {"df": "cast(df as double)", "once": "1D", "count": "value"}[self.weight]
        unseen = "0D" if self.unseen == "drop" else "value" if self.weight == "count" else "1D"
        return rows.select(
            *self.keys,
            "logs",
            F.expr(f"if(df is null, 0D, {weight}) as _w"),
            F.expr(f"if(df is null, {unseen}, 0D) as _u"),
        )

    def _wide_scores(self, x: DataFrame) -> DataFrame:
        """``keys, scores``: one entry per class taking part, in label order."""
        docs = self._matched(x).groupBy(*self.keys).agg(
            F.expr("sum(_w) as _W"),
            F.expr("sum(_u) as _U"),
            *[F.expr(f"coalesce(sum(_w * logs[{k}]), 0D) as s{k}") for k, *_ in self.slots],
        )
        scores = ", ".join(
            f"{prior!r}D + s{k} - _W * ln({den!r}D) - _U * ln({den!r}D + 1D)" for k, _, prior, den in self.slots
        )
        return docs.select(*self.keys, F.expr(f"array({scores}) as scores"))

    def scores(self, x: DataFrame) -> DataFrame:
        """``keys, label, score`` for every label of every predicted document."""
        if self.wide_layout:
            names = F.array(*[F.lit(name) for _, name, _, _ in self.slots])
            pair = F.explode(F.arrays_zip(names.alias("label"), F.col("scores").alias("score")))
            return self._wide_scores(x).select(*self.keys, pair.alias("_l")).select(*self.keys, "_l.*")
        rows = self._matched(x)
        docs = rows.groupBy(*self.keys).agg(F.expr("sum(_w) as _W"), F.expr("sum(_u) as _U"))
        seen = rows.select(*self.keys, "_w", F.explode("logs").alias("c"))
        seen = seen.groupBy(*self.keys, "c.label").agg(F.expr("sum(_w * c.log) as _s"))
        grid = beside_each(docs, self.sizes).join(seen, [*self.keys, "label"], "left")
        return grid.select(
            *self.keys,
            "label",
            F.expr("log_prior + coalesce(_s, 0D) - _W * ln(denominator) - _U * ln(denominator + 1D) as score"),
        )

    def predict(self, x: DataFrame) -> DataFrame:
        """``keys, label, score`` of the best label; equal scores go to the smallest."""
        if self.wide_layout:
            return best_slot(self._wide_scores(x), "scores", [name for _, name, _, _ in self.slots], self.keys)
        if self.weight == "count" or class_array_bytes(self.sizes) > CLASS_BYTES:
            return best(self.scores(x), self.keys, "score", "label")
        return self._long_best(x)

    def _long_best(self, x: DataFrame) -> DataFrame:
        """The best label of each document from one array of all classes, without a row per label.

        Words seen with a class only add to its score, so the largest of the
        scores without them and of those with them is the largest of all.
        Up to SLOT_LABELS classes the packed cells of words are sent once to each
        block of documents that has the word, and its task adds them up. Of more
        classes the cells are sent there as rows.
        """
        order = F.row_number().over(Window.orderBy("label"))  # as many rows as labels
        sizes = materialize(self.sizes.withColumn("place", order), "class_places")
        n = sizes.count()
        x = x.select(*self.keys, "feature")
        rows = x if is_stored(x) else materialize(x, "to_predict")
        if 0 < n <= SLOT_LABELS:
            return self._block_best(rows, sizes.orderBy("place").collect())
        classes = F.array_sort(F.collect_list(F.struct("place", "label", "log_prior", "denominator")))
        classes = sizes.agg(classes).scalar()
        model = self._log_cells(F.broadcast(sizes.select("label", "place")))  # of bounded size, as the array
        weight = F.col("df").cast("double") if self.weight == "df" else F.lit(1.0)
        seen = F.collect_list(F.when(F.col("place") > 0, F.struct("place", "_s"))).alias("_seen")
        docs = materialize_placed(self._block_sums(rows, model, weight, n).agg(*self._totals, seen), "block_sums")
        docs = docs.withColumn("_classes", classes)

        def scored(c: Column, more: Column) -> Column:
            score = c["log_prior"] + more - F.col("_W") * F.ln(c["denominator"]) - F.col("_U") * F.ln(c["denominator"] + 1)
            # of equal scores the first place is the largest
            return F.struct(score.alias("score"), (-c["place"]).alias("before"), c["label"].alias("label"))

        plain = F.array_max(F.transform("_classes", lambda c: scored(c, F.lit(0.0))))
        with_words = F.transform("_seen", lambda s: scored(F.element_at("_classes", s["place"]), s["_s"]))
        top = F.array_max(F.array_compact(F.array(plain, F.array_max(with_words))))
        return docs.withColumn("_top", top).select(*self.keys, "_top.label", "_top.score")

    def _blocks(self, rows: DataFrame, n: int) -> int:
        """Into how many blocks documents are dealt, whose sums for ``n`` classes are one task's."""
        n_docs = rows.agg(F.approx_count_distinct(F.struct(*self.keys))).first()[0]
        return max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-n_docs * n // BLOCK_SUMS))

    def _block_best(self, rows: DataFrame, classes: Sequence[Row]) -> DataFrame:
        """The best of up to SLOT_LABELS ``classes``, rows in order of their labels."""
        model = materialize(packed_cells(self.model.df, [r["label"] for r in classes]), "packed_cells")
        blocks = self._blocks(rows, len(classes))
        rows = rows.withColumn("_block", F.pmod(F.xxhash64(*self.keys), F.lit(blocks)).cast("int"))
        left = self.unseen == "smooth" or self.fallback
        words = rows.select("_block", "feature").distinct().join(model, "feature", "left")
        words = words.select("_block", "feature", F.lit(0).alias("_side"), *[F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in self.keys], "df", "packed")
        docs = rows.select("_block", "feature", F.lit(1).alias("_side"), *self.keys, F.lit(None).cast("bigint").alias("df"), F.lit(None).cast("binary").alias("packed"))
        # a block's number is its task's: by a hash some tasks would have several
        both = words.unionByName(docs).repartitionById(blocks, F.col("_block")).sortWithinPartitions("_block", "feature", "_side")
        unseen = 1.0 if self.unseen == "smooth" else 0.0
        found = best_of_blocks(both, self.keys, classes, self.weight == "df", unseen, left)
        found = materialize_placed(found.select(F.explode("found").alias("f")).select("f.*"), "block_sums")
        labels = F.array(*[F.lit(r["label"]) for r in classes]).cast(T.ArrayType(self.sizes.schema["label"].dataType))
        return found.select(*self.keys, F.element_at(labels, F.col("_place")).alias("label"), "score")

    def _log_cells(self, places: DataFrame) -> DataFrame:
        """``feature, df, logs``: place and log count of the classes a word was seen with, stored."""
        cells = self.model.df.select("feature", "df", F.explode("cells").alias("c"))
        cells = cells.select("feature", "df", "c.label", F.expr("ln(c.count + 1D) as log")).join(places, "label", "left")
        # one entry per class
        logs = F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "log"))).alias("logs")
        return materialize(cells.groupBy("feature").agg(F.max("df").alias("df"), logs), "log_cells")

    @property
    def _totals(self) -> list[Column]:
        """Of a document's places in block sums 0 has the weights of known words, -1 those of unknown ones."""
        return [F.expr(f"sum(if(place = {place}, _s, 0D)) as {name}") for place, name in ((0, "_W"), (-1, "_U"))]

    def _block_sums(self, rows: DataFrame, model: DataFrame, weight: Column, n: int):
        """Sums ``_s`` by ``place``, grouped by document.

        Documents are dealt out in blocks. A block's words are looked up once, and
        its sums stay where it is: of what a row unfolds into nothing is shuffled.
        """
        blocks = self._blocks(rows, n)
        rows = rows.withColumn("_block", F.pmod(F.xxhash64(*self.keys), F.lit(blocks)).cast("int"))
        left = self.unseen == "smooth" or self.fallback
        pair = lambda place, value: F.struct(place.alias("place"), value.alias("term"))
        known = F.concat(
            F.array(pair(F.lit(0), F.lit(1.0) * weight)), F.transform("logs", lambda c: pair(c["place"], weight * c["log"]))
        )
        unseen = F.array(pair(F.lit(-1), F.lit(0.0 if self.unseen == "drop" else 1.0)))
        terms = F.when(F.col("df").isNull(), unseen).otherwise(known) if left else known
        found = rows.select("_block", "feature").distinct().join(model, "feature", "left" if left else "inner")
        found = found.select("_block", "feature", terms.alias("terms")).repartition(blocks, "_block")
        cells = rows.repartition(blocks, "_block").join(found, ["_block", "feature"])
        cells = cells.select("_block", *self.keys, F.explode("terms").alias("c")).select("_block", *self.keys, "c.*")
        return cells.groupBy("_block", *self.keys, "place").agg(F.sum("term").alias("_s")).groupBy("_block", *self.keys)

    def coverage(self, x: DataFrame) -> DataFrame:
        """``keys, coverage``: the share of a document's distinct words that the model knows."""
        rows = self.model.join(x.select(*self.keys, "feature"), "left")
        return rows.groupBy(*self.keys).agg(F.avg(F.col("df").isNotNull().cast("int")).alias("coverage"))

    def score(self, x: DataFrame, y: DataFrame) -> DataFrame:
        """``correct, total, accuracy`` of the predictions for ``x``."""
        return accuracy(self.predict(x), y, self.keys)

    # -- storage ----------------------------------------------------------

    def save(self, path: str) -> None:
        self.model.df.write.parquet(f"{path}/likelihoods")
        self.classes.table.write.parquet(f"{path}/classes")

    def load(self, spark: SparkSession, path: str) -> "NaiveBayes":
        """Take over a saved model with its layout; the other options are those of this instance."""
        model = spark.read.parquet(f"{path}/likelihoods")
        table = spark.read.parquet(f"{path}/classes")
        self.wide = table.count() if "counts" in model.columns else 0
        self._use(model, Classes(table, self.wide))
        return self


class SmoothedNaiveBayes(NaiveBayes):
    """Textbook variant: word totals below the line, distinct words counted once, unseen words smoothed."""

    def __init__(self, keys: Sequence[str] = ("doc_id",), wide: int = WIDE_LABELS):
        super().__init__("words", "once", "smooth", keys=keys, wide=wide)


def gaussian_stats(x: DataFrame) -> DataFrame:
    """``label, feature, cnt, mean, stddev`` of the present values of a labelled feature table."""
    return x.groupBy("label", "feature").agg(
        F.count("value").alias("cnt"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("stddev"),
    )


def gaussian_states(x: DataFrame) -> DataFrame:
    """``label, feature, cnt, mean, m2``: moments of the present values that can be merged; ``m2`` sums the squared deviations."""
    return x.groupBy("label", "feature").agg(
        F.count("value").alias("cnt"),
        F.avg("value").alias("mean"),
        # of a group's variance and size, which Spark computes in one pass and without a difference of large sums
        (F.var_pop("value") * F.count("value")).alias("m2"),
    )


def merged_states(states: DataFrame) -> DataFrame:
    """States of the same label and feature as one: the state of all their values together.

    Two at a time, in order of size: a state's squared deviations grow by those of
    the means, which are weighed by both sizes. There is a state per part merged.
    """

    def merge(a: Column, b: Column) -> Column:
        n = a["cnt"] + b["cnt"]
        step = b["mean"] - a["mean"]
        share = b["cnt"] / n
        return F.struct(
            n.alias("cnt"),
            (a["mean"] + step * share).alias("mean"),
            (a["m2"] + b["m2"] + step * step * a["cnt"] * share).alias("m2"),
        )

    whole = states.filter("cnt > 0").groupBy("label", "feature").agg(
        F.array_sort(F.collect_list(F.struct("cnt", "mean", "m2"))).alias("_s")
    )
    rest = F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(0)))
    return whole.select("label", "feature", F.aggregate(rest, F.col("_s")[0], merge).alias("_m")).select("label", "feature", "_m.*")


def stats_of(states: DataFrame) -> DataFrame:
    """:func:`gaussian_stats` from states: the deviation of a sample, unknown for a single value."""
    deviation = F.when(F.col("cnt") > 1, F.sqrt(F.col("m2") / (F.col("cnt") - 1)))
    return states.select("label", "feature", "cnt", "mean", deviation.alias("stddev"))


class GaussianNaiveBayes:
    """Naive Bayes with a normal distribution per label and feature.

    ``likelihood``  ``tail`` scores a value by the probability of one at least
        as far from the mean on its side, ``pdf`` by the density.
    ``missing``  ``ignore`` uses present values only; ``zero`` counts absent
        ones as 0 in both training and prediction.

    Groups whose deviation is unknown or 0 take no part.
    """

    def __init__(
        self,
        likelihood: str = "tail",
        missing: str = "ignore",
        keys: Sequence[str] = ("doc_id",),
        wide: int = WIDE_LABELS,
    ):
        if likelihood not in ("tail", "pdf"):
            raise ValueError("likelihood must be 'tail' or 'pdf'")
        if missing not in ("ignore", "zero"):
            raise ValueError("missing must be 'ignore' or 'zero'")
        self.likelihood = likelihood
        self.missing = missing
        self.keys = list(keys)
        self.wide = wide

    def fit(self, x: DataFrame, y: DataFrame, label_col: str | None = None) -> "GaussianNaiveBayes":
        """Train on features ``keys, feature, value`` and labels ``keys, label``."""
        classes = Classes.fit(y, self.wide)
        self._use(materialize(gaussian_stats(with_label(x, y, self.keys, label_col)), "stats"), classes)
        return self

    def fit_states(self, states: DataFrame, class_counts: DataFrame) -> "GaussianNaiveBayes":
        """Train on states ``label, feature, cnt, mean, m2`` and ``label, n``; states of the same cell are merged."""
        self._use(materialize(stats_of(merged_states(states)), "stats"), Classes.of(class_counts, self.wide))
        return self

    def states(self) -> DataFrame:
        """The states of this model, which may be merged with those of others."""
        m2 = F.coalesce(F.col("stddev") * F.col("stddev") * (F.col("cnt") - 1), F.lit(0.0))
        return self.stats.select("label", "feature", "cnt", "mean", m2.alias("m2"))

    def merged(self, other: "GaussianNaiveBayes") -> "GaussianNaiveBayes":
        """A model of both models' documents, which must not overlap, with this one's options."""
        both = self.classes.table.select("label", "n").unionByName(other.classes.table.select("label", "n"))
        counts = materialize(both.groupBy("label").agg(F.sum("n").alias("n")), "class_counts")
        model = GaussianNaiveBayes(self.likelihood, self.missing, self.keys, self.wide)
        return model.fit_states(self.states().unionByName(other.states()), counts)

    def _use(self, stats: DataFrame, classes: Classes) -> None:
        self.stats = stats
        self.classes = classes
        usable = stats
        if self.missing == "zero":
            usable = self._with_zeros(stats)
        usable = usable.filter("stddev > 0")
        nested = usable.groupBy("feature").agg(
            F.sum("cnt").alias("rows"),
            # one entry per class
            F.collect_list(F.struct("label", "mean", "stddev")).alias("cells"),
        )
        # a cell is a label and two doubles
        self.model = Lookup.build(nested, ["feature"], "rows", 8 * self.classes.count(), "gaussians")

    def _with_zeros(self, stats: DataFrame) -> DataFrame:
        """Moments over all documents of the class, absent values being 0.

        Squared deviations are those within the present values and those between
        their mean and 0, so nothing large is subtracted. A class of one document
        has no deviation.
        """
        cnt, n = F.col("cnt").cast("double"), F.col("n").cast("double")
        within = F.coalesce("stddev", F.lit(0.0)) ** 2 * (cnt - 1)
        between = cnt * (n - cnt) / n * F.col("mean") ** 2
        return stats.join(self.classes.table.select("label", "n"), "label").select(
            "label",
            "feature",
            "cnt",
            (cnt * F.col("mean") / n).alias("mean"),
            F.when(n > 1, F.sqrt((within + between) / F.greatest(n - 1, F.lit(1.0)))).alias("stddev"),
        )

    def _term(self, value: Column, cell: str) -> Column:
        z = (value - F.col(f"{cell}.mean")) / F.col(f"{cell}.stddev")
        return log_tail(z) if self.likelihood == "tail" else log_density(z, F.col(f"{cell}.stddev"))

    def scores(self, x: DataFrame) -> DataFrame:
        """``keys, label, score`` for the labels that have a usable group among the features present."""
        rows = self.model.join(x.select(*self.keys, "feature", "value"))
        rows = rows.select(*self.keys, "value", F.explode("cells").alias("c"))
        term = self._term(F.col("value"), "c")
        if self.missing == "zero":
            term = term - self._term(F.lit(0.0), "c")
        sums = rows.groupBy(*self.keys, F.col("c.label").alias("label")).agg(F.sum(term).alias("_s"))
        priors = self.classes.table.select("label", "log_prior")
        if self.missing == "ignore":
            return sums.join(priors, "label").select(
                *self.keys, "label", (F.col("_s") + F.col("log_prior")).alias("score")
            )
        # every feature takes part; the present ones correct the sum over zeros
        zeros = self.model.df.select(F.explode("cells").alias("c"))
        zeros = zeros.groupBy(F.col("c.label").alias("label")).agg(F.sum(self._term(F.lit(0.0), "c")).alias("_zero"))
        base = priors.join(zeros, "label").select("label", (F.col("log_prior") + F.col("_zero")).alias("_base"))
        grid = beside_each(x.select(*self.keys).distinct(), base)
        grid = grid.join(sums, [*self.keys, "label"], "left")
        return grid.select(*self.keys, "label", (F.col("_base") + F.coalesce("_s", F.lit(0.0))).alias("score"))

    def predict(self, x: DataFrame) -> DataFrame:
        """``keys, label, score`` of the best label; equal scores go to the smallest."""
        return best(self.scores(x), self.keys, "score", "label")

    def score(self, x: DataFrame, y: DataFrame) -> DataFrame:
        """``correct, total, accuracy`` of the predictions for ``x``."""
        return accuracy(self.predict(x), y, self.keys)

    def save(self, path: str) -> None:
        self.stats.write.parquet(f"{path}/stats")
        self.classes.table.write.parquet(f"{path}/classes")

    def load(self, spark: SparkSession, path: str) -> "GaussianNaiveBayes":
        """Take over a saved model; the options are those of this instance."""
        self._use(spark.read.parquet(f"{path}/stats"), Classes(spark.read.parquet(f"{path}/classes"), self.wide))
        return self
