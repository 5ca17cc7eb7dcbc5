"""Merkle manifest of a dataset: one tree per source over its rows, one tree over the sources.

Leaves are appended in order. Runs of ARITY neighbouring nodes become their
parent, so a list of n nodes shrinks to one level by level. While leaves stream
in, each has a partial witness, the siblings met so far; when a run is complete
(or the list ends), the witnesses of all leaves below it are extended by the
run's other nodes. Tasks append aligned blocks of ARITY**levels neighbours, each
a whole subtree. The roots of the blocks are leaves of the next round, so rounds
get smaller by that factor, and a witness of a block's root extends those of all
leaves in the block. No task holds more than one block, however large a source.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.joins import Lookup
from lexmill.operators.ranking import running_total
from lexmill.storage import materialize

ARITY = 3
# Levels that one round adds: blocks of 729 nodes.
LEVELS = 6
# Upper witnesses are broadcast if all of them have at most so many bytes; beyond that they are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def combined(digests: bytes) -> bytes:
    """The parent of nodes whose digests follow each other: hashed as hex text."""
    return sha256(digests.hex().encode()).digest()


class OpenTree:
    """Nodes appended one by one: the runs still open at each level and all witnesses so far.

    ``witness[i]`` holds the digests of the i-th leaf's siblings from left to
    right, level by level; ``shape[i]`` has a byte per level, ARITY + 1 times the
    size of the run plus the place of the leaf's side in it.
    """

    def __init__(self):
        self.open: list[list[tuple[bytes, int, int]]] = [[]]
        self.witness: list[bytearray] = []
        self.shape: list[bytearray] = []

    def append(self, digest: bytes) -> None:
        at = len(self.witness)
        self.witness.append(bytearray())
        self.shape.append(bytearray())
        self._put(0, (digest, at, at + 1))

    def _put(self, level: int, node: tuple[bytes, int, int]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(node)
        if len(self.open[level]) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        """Make the open run of a level a node of the next one and extend the witnesses below it."""
        run, self.open[level] = self.open[level], []
        for i, (_, start, stop) in enumerate(run):
            siblings = b"".join(node[0] for j, node in enumerate(run) if j != i)
            for leaf in range(start, stop):
                self.witness[leaf] += siblings
                self.shape[leaf].append((ARITY + 1) * len(run) + i)
        self._put(level + 1, (combined(b"".join(node[0] for node in run)), run[0][1], run[-1][2]))

    def finish(self, levels: int | None = None) -> bytes:
        """Close what is open, over ``levels`` levels or until one node is left, and return that node."""
        level = 0
        while True:
            alone = len(self.open[level]) == 1 and not any(self.open[level + 1 :])
            if level == levels or (levels is None and alone):
                return self.open[level][0][0]
            if self.open[level]:
                self._close(level)
            level += 1


def folded(digest: bytes, witness: bytes, shape: bytes) -> bytes:
    """The root that follows from a leaf and its witness."""
    at = 0
    for byte in shape:
        size, place = divmod(byte, ARITY + 1)
        siblings = witness[at : at + 32 * (size - 1)]
        at += len(siblings)
        digest = combined(siblings[: 32 * place] + digest + siblings[32 * place :])
    return digest


def _append_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """One round: nodes (tree, position, n, digest, ...) with ``block, witness, shape`` and the block's root ``top``."""
    nodes = nodes.withColumn("block", F.expr(f"position div {ARITY**levels}"))
    nodes = nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "position")
    added = pa.schema([("witness", pa.binary()), ("shape", pa.binary()), ("top", pa.binary())])

    def grown(rows: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        digests, sizes = rows.column("digest").to_pylist(), rows.column("n").to_pylist()
        witness, shape, top = [], [], []
        for start, stop in zip(bounds[:-1], bounds[1:]):
            tree = OpenTree()
            for digest in digests[start:stop]:
                tree.append(digest)
            root = tree.finish(None if sizes[start] <= ARITY**levels else levels)
            witness += map(bytes, tree.witness)
            shape += map(bytes, tree.shape)
            top += [root] * (stop - start)
        for name, values in zip(added.names, (witness, shape, top)):
            rows = rows.append_column(name, pa.array(values, pa.binary()))
        yield from rows.combine_chunks().to_batches(max_chunksize=16384)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # of the last block, which may go on in the next batch
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
            tree, block = (rows.column(c).to_numpy() for c in ("tree", "block"))
            bounds = np.flatnonzero((np.diff(tree) != 0) | (np.diff(block) != 0)) + 1
            bounds = np.concatenate([[0], bounds])
            if len(bounds) > 1:
                yield from grown(rows.slice(0, bounds[-1]), bounds)
            rest = rows.slice(bounds[-1])
        if rest is not None and len(rest):
            yield from grown(rest, np.array([0, len(rest)]))

    fields = [f"`{c}` {t}" for c, t in nodes.dtypes] + ["witness binary", "shape binary", "top binary"]
    return nodes.mapInArrow(run, ", ".join(fields))


def append(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Append the nodes of each tree (tree, position from 0, n nodes of the tree, digest): one stored table per round.

    A round's nodes are the block roots of the round before; in the last one
    each tree is one block, whose ``top`` is the tree's root.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    rounds, size = [materialize(_append_blocks(nodes, levels), "witnesses")], ARITY**levels
    while most > size:
        most = -(-most // size)
        tops = rounds[-1].filter(F.col("position") % size == 0)
        n = F.expr(f"(n + {size - 1}) div {size} as n")
        tops = tops.select("tree", F.col("block").alias("position"), n, F.col("top").alias("digest"))
        rounds.append(materialize(_append_blocks(tops, levels), "witnesses"))
    return rounds


def _extended(lower: DataFrame, upper: DataFrame) -> DataFrame:
    """Witnesses of a round's nodes, extended by those (tree, at, upper_witness, upper_shape, ...) of their blocks."""
    upper = materialize(upper, "upper_witnesses")
    size = upper.agg(F.coalesce(F.sum(F.octet_length("upper_witness") + F.octet_length("upper_shape") + 200), F.lit(0))).first()[0]
    upper = F.broadcast(upper) if size <= BROADCAST_BYTES else upper
    met = lower.join(upper, (lower["tree"] == upper["tree"]) & (lower["block"] == upper["at"])).drop(upper["tree"], upper["at"])
    return _concatenated(met)


def _concatenated(met: DataFrame) -> DataFrame:
    longer = {c: F.concat(c, f"upper_{c}") for c in ("witness", "shape")}
    return met.withColumns(longer).drop("upper_witness", "upper_shape")


def proven(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of the first round with whole witnesses; ``above`` (tree, n, subroot, upper_witness, upper_shape, root) continues each tree's."""
    # a tree may hold most of the rows, so this join must not gather its rows
    now = _concatenated(Lookup.build(above, ["tree"], "n", 128, "tree_witnesses").join(rounds[-1]))
    for lower in reversed(rounds[:-1]):
        upper = now.select("tree", F.col("position").alias("at"), F.col("witness").alias("upper_witness"), F.col("shape").alias("upper_shape"), "subroot", "root")
        now = _extended(lower, upper)
    return now


def entry(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The digest of a row's values."""
    return F.unhex(F.sha2(F.concat(*[entry(v) for v in values]), 256))


def _numbered(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with ``tree`` (the source's place), ``position`` in it and ``n``; and the trees (tree, n).

    Rows are range-partitioned by source and id, so a large source is spread
    over many tasks; only counts per task and source are added up.
    """
    order = ["source", "doc_id", "digest"]
    rows = leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("_part", F.spark_partition_id()), "ordered_leaves")
    runs = materialize(rows.groupBy("source", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first")), "leaf_runs")
    # at most one row per source and task
    runs = runs.withColumn("_before", F.sum("_n").over(Window.partitionBy("source").orderBy("_part")) - F.col("_n"))
    trees = running_total(runs.groupBy("source").agg(F.sum("_n").alias("n")), ["source"], F.lit(1)).select("source", F.col("before").alias("tree"), "n")
    trees = materialize(trees, "trees")
    runs = runs.join(trees, runs["source"].eqNullSafe(trees["source"])).select("_part", runs["source"].alias("_source"), "tree", "n", "_first", "_before")
    rows = rows.withColumnRenamed("_part", "_of").join(runs, (F.col("_of") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
    position = F.col("_before") + F.col("_row") - F.col("_first")
    return rows.select("doc_id", "digest", "found", "tree", position.alias("position"), "n"), trees.select("tree", "n")


def manifest(docs: DataFrame, audited: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, lang, n_chars, text): its proof, and whether a later state still has the root.

    doc_id, ``leaf, subroot, root`` (hex), ``witness`` (digests of the siblings
    from left to right, level by level, through the source's tree and the tree of
    sources), ``shape``, ``found_root``: the root that follows from the row with
    the text ``audited`` (default: unchanged) and the original witness.

    Sources are in order of their UTF-8 bytes, null first; rows in order of
    doc_id, null first, repeated ids by digest, so the order of equal rows does
    not matter. Nulls count as ``-``, an empty text as ``0:``. Other columns are
    left out and an empty table gives an empty result.
    """
    names = ("doc_id", "source", "lang", "n_chars", "text")
    audited = docs["text"] if audited is None else audited
    docs = docs.select(*[docs[c].alias(c) for c in names], audited.alias("audited"))
    digests = [leaf(*[F.col(c) for c in names[:-1]], F.col(text)) for text in ("text", "audited")]
    # text is read once, for both digests
    leaves = materialize(docs.select("doc_id", "source", digests[0].alias("digest"), digests[1].alias("found")), "leaves")
    nodes, trees = _numbered(leaves)
    rounds = append(nodes, levels)
    subroots = trees.join(rounds[-1].filter("position = 0").select("tree", F.col("top").alias("subroot")), "tree")
    subroots = materialize(subroots, "subroots")
    n = subroots.count()
    above = append(subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("position"), F.lit(n).cast("bigint").alias("n"), F.col("subroot").alias("digest")), levels)
    root = above[-1].filter("position = 0").select(F.lit(0).cast("bigint").alias("tree"), F.lit(n).cast("bigint").alias("n"), F.col("top").alias("root"))
    root = root.select("tree", "n", F.lit(b"").alias("upper_witness"), F.lit(b"").alias("upper_shape"), F.lit(b"").alias("subroot"), "root")
    above = proven(above, root).select(F.col("position").alias("tree"), F.col("digest").alias("subroot"), F.col("witness").alias("upper_witness"), F.col("shape").alias("upper_shape"), "root")
    rows = proven(rounds, above.join(trees, "tree"))
    return _audit(rows.select("doc_id", F.col("digest").alias("leaf"), "found", "subroot", "root", "witness", "shape"))


def _audit(rows: DataFrame) -> DataFrame:
    """Fold the digest found with the original witness to a root."""
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.drop("found").dtypes) + ", found_root binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, witness, shape = (batch.column(c).to_pylist() for c in ("found", "witness", "shape"))
            roots = [folded(*of) for of in zip(found, witness, shape)]
            kept = [c for c in batch.schema.names if c != "found"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(roots, pa.binary())], names=[*kept, "found_root"])

    rows = rows.mapInArrow(run, schema)
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return rows.select("doc_id", text("leaf"), text("subroot"), text("root"), "witness", "shape", text("found_root"))
