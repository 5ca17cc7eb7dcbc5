"""Softmax (multinomial logistic) regression by gradient descent."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.hashing import table_normal
from lexmill.operators.features import minibatch_ids
from lexmill.operators.joins import BROADCAST_BYTES, Lookup, beside_each
from lexmill.operators.metrics import accuracy
from lexmill.operators.tensor import best
from lexmill.plans.classes import WIDE_LABELS, Classes, best_slot
from lexmill.storage import bucketed, materialize, parts_for, remove, stored_bytes


class SoftmaxRegression:
    """Weights per feature and label, summed (not averaged) gradient.

    With up to ``wide`` labels a feature's weights are one array, so a step
    adds up all labels of a document or feature in a single aggregate. With
    more a feature holds (label, weight) cells, summed by document and label.

    ``init``  start from a fixed ``normal`` table of ``table`` draws that
        feature and label hash into, or from ``zeros``.
    ``strict``  treat cells that are not stored as absent rather than 0: only
        the true label of a document gives a gradient, and weights without a
        gradient cell disappear.
    ``fit_intercept``  add a bias per label, from 0, moved by the errors of all
        documents. It is no feature: it takes no part in the join by word, and
        documents without a known feature are predicted from it alone.
    """

    def __init__(
        self,
        init: str = "normal",
        table: int = 1024,
        seed: str = "0",
        strict: bool = False,
        keys: Sequence[str] = ("doc_id",),
        wide: int = WIDE_LABELS,
        fit_intercept: bool = False,
        broadcast_bytes: int = BROADCAST_BYTES,
    ):
        if init not in ("normal", "zeros"):
            raise ValueError("init must be 'normal' or 'zeros'")
        if strict and fit_intercept:
            raise ValueError("an intercept is a cell of every document, which strict leaves out")
        self.init = init
        self.table = table
        self.seed = seed
        self.strict = strict
        self.keys = list(keys)
        self.wide = 0 if strict else wide
        self.names: list[str] | None = None
        # feature, rows, w; w has a weight per label, or (label, weight) cells
        self.weights: Lookup | None = None
        self.fit_intercept = fit_intercept
        self.broadcast_bytes = broadcast_bytes
        # the biases: a number per slot, or a stored table (label, bias)
        self._bias: list[float] | DataFrame | None = None
        # while fitting with weights too large to broadcast: features that are not hot, in buckets by feature
        self._far: DataFrame | None = None
        self._buckets = 0
        # the weights before the present ones, which a DataFrame made earlier may still read
        self._older: DataFrame | None = None

    # -- start weights ----------------------------------------------------

    def _start(self, feature: Column, label: Column) -> Column:
        if self.init == "zeros":
            return F.lit(0.0)
        return table_normal(self.seed, self.table, feature, label)

    def init_weights(self, x: DataFrame, y: DataFrame) -> None:
        """Set the weights of every feature of ``x`` for every label of ``y``."""
        self.classes = Classes.fit(y, self.wide)
        self.names = self.classes.names
        if self.fit_intercept:
            no_bias = self.classes.table.select("label", F.lit(0.0).alias("bias"))
            self._bias = [0.0] * len(self.names) if self.names is not None else materialize(no_bias, "bias")
        rows = x.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"))
        if self.names is not None:
            w = F.array(*[self._start(F.col("feature"), F.lit(n)) for n in self.names])
            self._use(rows.withColumn("w", w))
            return
        grid = beside_each(rows, self.classes.table.select("label"))
        self._use(self._nested(grid.withColumn("value", self._start(F.col("feature"), F.col("label")))))

    def _use(self, weights: DataFrame) -> None:
        width = 1 + (len(self.names) if self.names is not None else 6 * self.classes.count())
        self.weights = Lookup.build(weights, ["feature"], "rows", width, "weights")
        self.weights.broadcast_bytes = self.broadcast_bytes

    @staticmethod
    def _nested(cells: DataFrame) -> DataFrame:
        """``feature, rows, label, value`` cells as one row per feature; one entry per label."""
        return cells.groupBy("feature").agg(
            F.max("rows").alias("rows"), F.collect_list(F.struct("label", "value")).alias("w")
        )

    def weight_table(self) -> DataFrame:
        """``feature, label, w``."""
        if self.names is None:
            cells = self.weights.df.select("feature", F.explode("w").alias("c"))
            return cells.select("feature", "c.label", F.col("c.value").alias("w"))
        return self._unnest(self.weights.df, "w", "w")

    def intercepts(self) -> DataFrame:
        """``label, bias``."""
        if isinstance(self._bias, list):
            pair = F.explode(F.arrays_zip(self.classes.name_array().alias("label"), F.array(*map(F.lit, self._bias)).alias("bias")))
            return self.classes.table.sparkSession.range(1).select(pair.alias("_p")).select("_p.*")
        return self._bias

    def _unnest(self, df: DataFrame, array: str, out: str) -> DataFrame:
        pair = F.explode(F.arrays_zip(self.classes.name_array().alias("label"), F.col(array).alias(out)))
        return df.select("feature", pair.alias("_p")).select("feature", "_p.*")

    def _weighted(self, x: DataFrame, how: str) -> DataFrame:
        """The cells of documents with the weights ``w`` of their features.

        While fitting with a table of weights too large to broadcast, cells of hot
        features meet their broadcast weights where the document is, the others
        are read once more in buckets by feature, as the weights are.
        """
        x = x.select(*self.keys, "feature", "value")
        if self._far is None:
            return self.weights.join(x, how)
        w = self.weights.df.select("feature", "w", self.weights.is_hot.alias("_hot"))
        near = x.join(F.broadcast(w.filter("_hot")), "feature")
        far = self._far.join(w.filter("not _hot"), "feature", how)
        return near.unionByName(far).select(*self.keys, "value", "w")

    # -- one step, a slot per label ---------------------------------------

    def _logits(self, x: DataFrame, how: str) -> DataFrame:
        """``keys, z``: an array with one logit per label."""
        rows = self._weighted(x, how)
        bias = self._bias or [0.0] * len(self.names)
        sums = ", ".join(f"coalesce(sum(value * w[{k}]), 0D) + {b!r}D" for k, b in enumerate(bias))
        return rows.groupBy(*self.keys).agg(F.expr(f"array({sums}) as z"))

    def _slot_errors(self, x: DataFrame, y: DataFrame) -> DataFrame:
        """``keys, d``: truth minus probability, one entry per label."""
        truth = y.select(*self.keys, self.classes.slot_of().alias("_k")).groupBy(*self.keys)
        truth = truth.agg(F.expr("array_sort(collect_set(_k)) as _true"))
        return (
            self._logits(x, "left")
            .join(truth, self.keys, "left")
            .withColumn("_max", F.array_max("z"))
            .withColumn("e", F.expr("transform(z, v -> exp(v - _max))"))
            .withColumn("_t", F.expr("aggregate(e, 0D, (a, v) -> a + v)"))
            .select(
                *self.keys,
                F.expr("transform(e, (v, k) -> if(coalesce(array_contains(_true, bigint(k)), false), 1D, 0D) - v / _t) as d"),
            )
        )

    def _slot_gradient(self, x: DataFrame, errors: DataFrame) -> DataFrame:
        """``feature, _rows, g``: minus the gradient, one entry per label."""
        sums = ", ".join(f"sum(value * d[{k}])" for k in range(len(self.names)))
        return self._beside(x, errors).groupBy("feature").agg(F.expr("count(1) as _rows"), F.expr(f"array({sums}) as g"))

    def _beside(self, x: DataFrame, errors: DataFrame) -> DataFrame:
        """Cells with the errors of their document, which are hashed bucket by bucket, so cells need not be sorted."""
        return x.join(errors.hint("shuffle_hash"), self.keys)

    # -- one step, a row per cell -----------------------------------------

    def _cell_logits(self, x: DataFrame, how: str) -> DataFrame:
        """``keys, label, z``; every label of a document unless ``strict``."""
        rows = self._weighted(x, how)
        z = rows.select(*self.keys, "value", F.explode("w").alias("c"))
        z = z.groupBy(*self.keys, "c.label").agg(F.expr("sum(value * c.value) as z"))
        if self.strict:
            return z.filter("z != 0")
        docs = rows.select(*self.keys).distinct()
        bias = self._bias if self.fit_intercept else self.classes.table.select("label", F.lit(0.0).alias("bias"))
        grid = beside_each(docs, bias).join(z, [*self.keys, "label"], "left")
        return grid.select(*self.keys, "label", F.expr("coalesce(z, 0D) + bias as z"))

    def _cell_errors(self, x: DataFrame, y: DataFrame) -> DataFrame:
        """``keys, label, d``: truth minus probability."""
        # one row per label in a window
        by_doc = Window.partitionBy(*self.keys)
        e = F.exp(F.col("z") - F.max("z").over(by_doc))
        p = self._cell_logits(x, "inner" if self.strict else "left").withColumn("e", e)
        p = p.select(*self.keys, "label", (F.col("e") / F.sum("e").over(by_doc)).alias("p"))
        truth = y.select(*self.keys, "label", F.lit(1.0).alias("t")).distinct()
        # labels the model does not know have no weights
        delta = p.join(truth, [*self.keys, "label"], "inner" if self.strict else "left")
        delta = delta.select(*self.keys, "label", F.expr("coalesce(t, 0D) - p as d"))
        return delta.filter("d != 0") if self.strict else delta

    def _cell_gradient(self, x: DataFrame, errors: DataFrame) -> DataFrame:
        """``feature, label, _rows, g``: minus the gradient."""
        # one entry per label
        delta = errors.groupBy(*self.keys).agg(F.collect_list(F.struct("label", "d")).alias("d"))
        cells = self._beside(x, delta).select("feature", "value", F.explode("d").alias("c"))
        sums = cells.groupBy("feature", "c.label").agg(F.expr("sum(value * c.d) as g"), F.expr("count(1) as _rows"))
        return sums.filter("g != 0") if self.strict else sums

    # -- training ---------------------------------------------------------

    def gradient(self, x: DataFrame, y: DataFrame) -> DataFrame:
        """``feature, label, gradient`` of the loss at the present weights, zeros left out."""
        if self.names is None:
            g = self._cell_gradient(x, self._cell_errors(x, y)).filter("g != 0")
            return g.select("feature", "label", (-F.col("g")).alias("gradient"))
        g = self._unnest(self._slot_gradient(x, self._slot_errors(x, y)), "g", "gradient")
        return g.withColumn("gradient", -F.col("gradient")).filter("gradient != 0")

    def partial_fit(self, x: DataFrame, y: DataFrame, lr: float = 0.01) -> "SoftmaxRegression":
        """One step of gradient descent; the new weights are written at once."""
        errors = self._slot_errors(x, y) if self.names is not None else self._cell_errors(x, y)
        if self.fit_intercept:
            # read by the weights and by the biases
            errors = bucketed(errors, self.keys, "errors", self._buckets or parts_for(x.sparkSession, 0), placed=True)
        moved = self._moved_slots(x, errors, lr) if self.names is not None else self._moved_cells(x, errors, lr)
        bias = self._moved_bias(errors, lr) if self.fit_intercept else None
        self._move(moved)
        self._bias = bias
        return self

    def _moved_cells(self, x: DataFrame, errors: DataFrame, lr: float) -> DataFrame:
        old = self.weights.df.select("feature", "rows", F.explode("w").alias("c")).select("feature", "rows", "c.*")
        g = self._cell_gradient(x, errors)
        moved = old.join(g, ["feature", "label"], "inner" if self.strict else "full_outer").select(
            "feature",
            F.coalesce("rows", "_rows").alias("rows"),
            "label",
            F.expr(f"coalesce(value, 0D) + {float(lr)!r}D * coalesce(g, 0D) as value"),
        )
        # a weight that happens to be zero still makes its document known
        return self._nested(moved.filter("value != 0") if self.strict else moved)

    def _moved_slots(self, x: DataFrame, errors: DataFrame, lr: float) -> DataFrame:
        g = self._slot_gradient(x, errors)
        return self.weights.df.join(g, "feature", "full_outer").select(
            "feature",
            F.coalesce("rows", "_rows").alias("rows"),
            F.expr(
                "case when g is null then w "
                f"when w is null then transform(g, v -> v * {float(lr)!r}D) "
                f"else zip_with(w, g, (a, b) -> a + {float(lr)!r}D * b) end as w"
            ),
        )

    def _moved_bias(self, errors: DataFrame, lr: float) -> list[float] | DataFrame:
        if self.names is not None:
            sums = errors.agg(*[F.expr(f"coalesce(sum(d[{k}]), 0D)") for k in range(len(self.names))]).first()
            return [b + lr * s for b, s in zip(self._bias, sums)]
        sums = errors.groupBy("label").agg(F.sum("d").alias("_s"))
        moved = self._bias.join(sums, "label", "left")
        return materialize(moved.select("label", F.expr(f"bias + {float(lr)!r}D * coalesce(_s, 0D) as bias")), "bias")

    def _move(self, weights: DataFrame) -> None:
        # a step hardly changes the sizes that steer the join
        older, self._older = self._older, self.weights.df
        if self._far is not None:
            weights = bucketed(weights, ["feature"], "weights", self._buckets, placed=True)
        else:
            weights = materialize(weights, "weights")
        self.weights = replace(self.weights, df=weights)
        if older is not None:
            remove(older)

    def fit(
        self,
        x: DataFrame,
        y: DataFrame,
        lr: float = 0.01,
        batch_size: int = -1,
        max_iter: int = 1,
        warm_start: bool = False,
        placed: bool = False,
    ) -> "SoftmaxRegression":
        """Train on features ``keys, feature, value`` and labels ``keys, label``.

        A positive ``batch_size`` draws that many documents for each step.
        Features and labels are stored once in buckets by document, so the joins of
        a step by document need no exchange; gradients are added up by word before
        they are shuffled. If the weights are too large to broadcast, the features
        are also stored in buckets by word, hot words aside. ``placed`` says that
        the rows of a document are in one partition already, as those of a bag of
        words; they are written from there.

        The buckets may be removed with the rest of the scratch folder once the
        model is no longer trained.
        """
        spark = x.sparkSession
        x, y = x.select(*self.keys, "feature", "value"), y.select(*self.keys, "label")
        size = stored_bytes(x)
        if size is None:
            x = materialize(x, "features")
            size = stored_bytes(x)
        self._buckets = parts_for(spark, size)
        x = bucketed(x, self.keys, "features", self._buckets, placed)
        y = bucketed(y, self.keys, "labels", self._buckets)
        if not warm_start or self.weights is None:
            self.init_weights(x, y)
        if batch_size > 0:
            known = y.select(*self.keys).distinct().count()
            if batch_size > known:
                raise ValueError(f"batch_size {batch_size} exceeds the {known} training documents")
        far = None
        if not self.weights.is_broadcast and self.weights.hot_is_broadcast:
            hot = self.weights.df.filter(self.weights.is_hot).select("feature")
            far = bucketed(x.join(F.broadcast(hot), "feature", "left_anti"), ["feature"], "features_by_word", self._buckets)
            self.weights = replace(self.weights, df=bucketed(self.weights.df, ["feature"], "weights", self._buckets))
        try:
            for step in range(max_iter):
                xs, ys, self._far = x, y, far
                if batch_size > 0:
                    ids = materialize(minibatch_ids(y, batch_size, f"{self.seed}|{step}", self.keys), "batch")
                    xs, ys = (df.join(ids, self.keys, "left_semi") for df in (x, y))
                    self._far = far and far.join(ids, self.keys, "left_semi")
                self.partial_fit(xs, ys, lr)
        finally:
            self._far, self._buckets = None, 0
        return self

    # -- prediction -------------------------------------------------------

    def predict(self, x: DataFrame) -> DataFrame:
        """``keys, label, score`` of the largest logit; equal ones go to the smallest label."""
        if self.names is None:
            scores = self._cell_logits(x, "left" if self.fit_intercept else "inner").withColumnRenamed("z", "score")
            return best(scores, self.keys, "score", "label")
        return best_slot(self._logits(x, "left" if self.fit_intercept else "inner"), "z", self.names, self.keys)

    def score(self, x: DataFrame, y: DataFrame) -> DataFrame:
        """``correct, total, accuracy`` of the predictions for ``x``."""
        return accuracy(self.predict(x), y, self.keys)

    # -- storage ----------------------------------------------------------

    def save(self, path: str) -> None:
        # the expected rows steer the join of a loaded model
        rows = self.weights.df.select("feature", "rows")
        self.weight_table().join(rows, "feature").write.parquet(f"{path}/weights")
        self.classes.table.write.parquet(f"{path}/classes")
        if self.fit_intercept:
            self.intercepts().write.parquet(f"{path}/intercept")

    def load(self, spark: SparkSession, path: str) -> "SoftmaxRegression":
        """Take over saved weights; the options are those of this instance."""
        self.classes = Classes(spark.read.parquet(f"{path}/classes"), self.wide)
        self.names = self.classes.names
        table = spark.read.parquet(f"{path}/weights")
        if self.fit_intercept:
            bias = spark.read.parquet(f"{path}/intercept")
            # at most as many rows as slots
            self._bias = [r["bias"] for r in bias.orderBy("label").collect()] if self.names is not None else bias
        if self.names is None:
            cells = table.select("feature", "rows", "label", F.col("w").alias("value"))
            self._use(self._nested(cells))
            return self
        slots = [F.max(F.when(F.col("label") == n, F.col("w"))) for n in self.names]
        self._use(table.groupBy("feature").agg(F.max("rows").alias("rows"), F.array(*slots).alias("w")))
        return self
