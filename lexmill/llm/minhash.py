"""Near-duplicate documents by an inverted join on signature coordinates.

1. Each document's set of word shingles gives COORDINATES min-hashes. Documents
   with equal sets form a class at once; what follows is about classes.
2. Classes are posted under each (coordinate, value). Two classes whose sets have
   a Jaccard similarity s agree in a share s of the coordinates, give or take;
   pairs with at least MATCHES agreements are retained.
3. Prefix: with each class's postings in order of list length, such a pair meets
   in one of the first COORDINATES - MATCHES + 1 of both. So the long lists of
   frequent shingles are skipped, and classes that share fewer than MATCHES
   values with any others drop out before any pair is made.
4. Skip: in each list every class is first paired with one hub only, the class
   whose values are the most common ones. Confirmed pairs are merged to
   components, so a list of mutual copies makes as many pairs as it has classes.
   Where a list still has several components, its classes outside the largest
   one are the family's rest, and are merged with the family block by block.
   Signatures are compared first; texts follow only for classes with a partner
   of enough agreements and similar size. Counting the postings of their shingles
   gives all intersections at once, and only links that join two components
   leave a block.
5. Pairs are confirmed on the full sets, whatever their signatures say.

A pair at similarity 0.8 exactly has fewer than MATCHES agreements with
probability 2e-4; above, it falls quickly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.components import components
from lexmill.llm.rows import map_text, only
from lexmill.llm.shingles import shingle_sets
from lexmill.llm.workers import trim
from lexmill.storage import materialize, measured_joins

COORDINATES = 32
MATCHES = 17
# Hubs are paired with at most about this many characters of other texts in one task.
HUB_CHARS = 16 << 20
# Families are merged in blocks of about this many shingles on either side.
BLOCK_SHINGLES = 1 << 18
# Ids are broadcast if their measured size is at most this; beyond it both sides are shuffled.
BROADCAST_BYTES = 32 << 20


def _hashers(seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 64, COORDINATES, np.uint64) | np.uint64(1)
    return a[:, None], rng.integers(0, 1 << 64, COORDINATES, np.uint64)[:, None]


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """Upper halves of the smallest ``a * x + b`` over the set, as signed 32-bit numbers."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), step):
        np.minimum(least, (shingles[at : at + step] * a + b).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def described(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_id (128 bits of the set, null if empty) and signature."""

    def make():
        a, b = _hashers()

        def work(texts):
            sizes, ids, signatures = [], [], []
            for own in shingle_sets(texts, width):
                sizes.append(len(own))
                ids.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                signatures.append(signature(own, a, b) if len(own) else None)
            return sizes, ids, signatures

        return work

    fields = {"n_shingles": pa.int64(), "set_id": pa.binary(), "signature": pa.list_(pa.int32())}
    return map_text(docs, "text", make, fields, "n_shingles long, set_id binary, signature array<int>")


def _matching(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def prefix_postings(classes: DataFrame) -> DataFrame:
    """(class, doc, common, key) for the postings of each class that a pair with MATCHES agreements can first meet in.

    ``common`` is the length of all lists the class is in. A value that only one
    class has comes first in its order and needs no posting, so a class with m
    shared values has m - MATCHES + 1 of them left.
    """
    at, value = F.col("p.pos").cast("bigint"), F.col("p.col").cast("bigint").bitwiseAND(0xFFFFFFFF)
    postings = classes.select("class", "doc", F.posexplode("signature").alias("pos", "col")).select("class", "doc", F.struct("pos", "col").alias("p"))
    postings = postings.select("class", "doc", F.shiftleft(at, 32).bitwiseOR(value).alias("key"))
    lists = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # at most COORDINATES entries per class
    own = postings.join(lists, "key").groupBy("class", "doc").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("own"))
    first = F.expr(f"transform(slice(own, 1, size(own) - {MATCHES - 1}), x -> x.key)")
    common = F.aggregate("own", F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    return own.filter(F.size("own") >= MATCHES).select("class", "doc", common.alias("common"), F.explode(first).alias("key"))


def only_texts(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts with the ids of a one-column table, written: a second look at few texts, not a shuffle of all."""
    ids = materialize(ids.toDF("wanted").distinct(), "wanted")
    ids = F.broadcast(ids) if 16 * ids.count() <= BROADCAST_BYTES else ids
    return materialize(texts.join(ids, texts["doc_id"] == ids["wanted"], "left_semi"), "wanted_texts")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full sets have a Jaccard similarity of ``percent`` / 100 or more.

    ``texts`` has doc_id, text. Texts b are read beside their a, of which one set
    at a time is in memory; an a with very many partners is repeated over
    several tasks.
    """
    texts = only_texts(texts, pairs.select(F.explode(F.array("a", "b"))))
    length = texts.select("doc_id", F.length("text").cast("bigint").alias("size"))
    sizes = pairs.join(length.groupBy("doc_id").agg(F.max("size").alias("size")), pairs.b == F.col("doc_id"))
    shares = sizes.groupBy("a").agg((F.sum("size") / HUB_CHARS).cast("int").alias("last"))
    right = pairs.join(shares, "a").select("a", F.pmod(F.xxhash64("b"), F.col("last") + 1).cast("int").alias("share"), F.col("b").alias("other"))
    right = right.join(texts, right.other == texts.doc_id).select("a", "share", "other", "text")
    left = shares.select("a", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("share"))
    left = left.join(texts, left.a == texts.doc_id).select("a", "share", F.lit(None).cast("bigint").alias("other"), "text")
    beside = left.unionByName(right).repartition("a", "share").sortWithinPartitions("a", "share", F.col("other").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sets = None, []
        for batch in batches:
            found = []
            a, share, other = (batch.column(c).to_pylist() for c in ("a", "share", "other"))
            for i, own in enumerate(shingle_sets(batch.column("text").to_pylist(), width)):
                if other[i] is None:
                    if current != (a[i], share[i]):
                        current, sets = (a[i], share[i]), []
                    sets.append(own)  # more than one only if rows share this id
                    continue
                for first in sets:
                    both = len(np.intersect1d(first, own, assume_unique=True))
                    if 100 * both >= percent * (len(first) + len(own) - both):
                        found.append((a[i], other[i]))
                        break
            yield _pairs(found)
        trim()

    return beside.mapInArrow(run, "a long, b long")


def families(postings: DataFrame, merged: DataFrame) -> DataFrame:
    """(family, class, component) of the lists in which several components meet, by each list's largest component."""
    own = postings.join(merged, postings["doc"] == merged["node"], "left")
    own = materialize(own.select("key", "class", F.coalesce("component", "doc").alias("component")), "list_components")
    parts = own.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("family"), F.count(F.lit(1)).alias("parts"))
    return own.join(largest.filter("parts > 1"), "key").select("family", "class", "component").distinct()


def merge_families(found: DataFrame, signed: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that join different components of a family: its rest is compared with all of it.

    Both sides are dealt into blocks by a hash, so a unit of work is bounded
    whatever the size of a family. ``signed`` has class, doc, signature, size.
    """
    sized = materialize(found.join(signed.select("class", "size"), "class"), "families")
    blocks = lambda size: (F.coalesce(F.sum(size), F.lit(0)) / BLOCK_SHINGLES).cast("int") + 1
    rest = F.col("component") != F.col("family")
    deal = sized.groupBy("family").agg(blocks(F.when(rest, F.col("size"))).alias("n_rest"), blocks("size").alias("n_all"))
    dealt = sized.join(deal, "family").withColumn("h", F.xxhash64("class"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = ["family", "class", "component"]
    one = dealt.filter(rest).select(*own, F.lit(True).alias("asks"), F.pmod("h", F.col("n_rest")).cast("int").alias("i"), spread("n_all").alias("j"))
    other = dealt.select(*own, F.lit(False).alias("asks"), spread("n_rest").alias("i"), F.pmod("h", F.col("n_all")).cast("int").alias("j"))
    unit, member = ["family", "i", "j"], ["asks", "class", "component"]
    units = one.unionByName(other).join(signed.drop("doc"), "class").select(*unit, *member, "signature", "size")
    units = units.repartition(*unit).sortWithinPartitions(*unit)
    types = "family long, i int, j int, asks boolean, class long, component long"
    names = [*unit, *member]

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
        for parts in _units(batches, [*unit, *member, "signature", "size"]):
            kept = [(*key, *row[:3]) for key, rows in parts for row in similar_rows(rows, percent)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in kept], kind) for k, kind in enumerate(kinds)], names=names)
        trim()

    # from here on a class is known by its document
    similar_classes = units.mapInArrow(similar, types).join(signed.select("class", "doc"), "class").drop("class")
    chosen = materialize(similar_classes.withColumnRenamed("doc", "class").select(*unit, *member).distinct(), "similar")
    texts = only_texts(texts, chosen.select("class"))
    chosen = chosen.join(texts, F.col("class") == texts["doc_id"]).select(*unit, *member, "text")
    chosen = chosen.repartition(*unit).sortWithinPartitions(*unit)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _units(batches, [*unit, *member, "text"]):
            yield _pairs([pair for _, rows in parts for pair in unit_links(rows, width, percent)])
        trim()

    return chosen.mapInArrow(links, "a long, b long")


def _units(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[tuple[tuple, list[tuple]]]]:
    """Whole units of rows sorted by their first three columns, as lists of those that end in a batch."""
    unit, rows = None, []
    for batch in batches:
        ended = []
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if row[:3] != unit:
                if rows:
                    ended.append((unit, rows))
                unit, rows = row[:3], []
            rows.append(row[3:])
        yield ended
    yield [(unit, rows)] if rows else []


def similar_rows(rows: list[tuple], percent: int) -> list[tuple]:
    """Rows (asks, class, component, signature, size) that have a partner worth reading on the other side.

    A partner is of another component, agrees in MATCHES coordinates and is not
    too different in size to reach the similarity.
    """
    asking, asked = ([r for r in rows if r[0] == side] for side in (True, False))
    if not asking or not asked:
        return []
    signatures = np.array([r[3] for r in asked], np.int32)
    components_, sizes = np.array([r[2] for r in asked]), np.array([r[4] for r in asked])
    useful, out = np.zeros(len(asked), bool), []
    for r in asking:
        near = (signatures == np.array(r[3], np.int32)).sum(axis=1) >= MATCHES
        near &= (components_ != r[2]) & (100 * np.minimum(sizes, r[4]) >= percent * np.maximum(sizes, r[4]))
        if near.any():
            useful |= near
            out.append(r)
    return out + [r for r, u in zip(asked, useful) if u]


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def unit_links(rows: list[tuple], width: int, percent: int) -> list[tuple[int, int]]:
    """Links that join different components, of rows (asks, class, component, text), between those that ask and those that don't."""
    asking, asked = ([r for r in rows if r[0] == side] for side in (True, False))
    if not asking or not asked:
        return []
    sets = list(shingle_sets([r[3] for r in asked], width))
    sizes = np.array([len(s) for s in sets])
    names, at = np.unique(np.concatenate(sets), return_inverse=True)
    postings = np.repeat(np.arange(len(sets)), sizes)[np.argsort(at, kind="stable")]
    ends = np.cumsum(np.bincount(at, minlength=len(names)))
    starts = np.concatenate([[0], ends[:-1]])
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    out = []
    for (_, own, component, _), shingles in zip(asking, shingle_sets([r[3] for r in asking], width)):
        place = np.minimum(np.searchsorted(names, shingles), len(names) - 1)
        place = place[names[place] == shingles]
        counts = ends[place] - starts[place]
        lines = np.repeat(starts[place] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        both = np.bincount(postings[lines], minlength=len(sets))
        for k in np.flatnonzero(100 * both >= percent * (len(shingles) + sizes - both)):
            a, b = find(component), find(asked[k][2])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((own, asked[k][1]))
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``; ids are whole numbers.

    Links join documents with 100 * intersection >= percent * union of their
    sets of ``width``-word shingles; component_id is the smallest id reachable
    and kept marks the document that has it. Documents without words (null,
    empty or blank texts) have an empty set and link with nothing. Repeated rows
    get the same result each; rows that share an id but not the text count as
    one document, which is linked with copies and near copies of each of them. Rows with a null id link
    with nothing, have a null component_id and are not kept. Other columns are
    left out; an empty table gives an empty result.
    """
    texts = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    with measured_joins(docs.sparkSession):
        rows = materialize(described(texts, width), "shingle_sets")
        with_id = rows.filter("doc_id is not null and set_id is not null")
        # a class is a set; it is numbered, as ids need not be: two sets may have the same smallest id
        per_set = [F.min("doc_id").alias("doc"), F.min("signature").alias("signature"), F.min("n_shingles").alias("size")]
        classes = with_id.groupBy("set_id").agg(*per_set).withColumn("class", F.monotonically_increasing_id())
        classes = materialize(classes, "shingle_classes")
        # rows that share an id are one document, by these links
        same_id = with_id.groupBy("doc_id").agg(F.min("set_id").alias("x"), F.max("set_id").alias("y")).filter("x <> y").select("doc_id")
        same_id = with_id.join(same_id, "doc_id").join(classes, "set_id").select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))

        postings = materialize(prefix_postings(classes), "prefix_postings")
        hubs = postings.groupBy("key").agg(F.max_by("class", F.struct("common", -F.col("doc"), -F.col("class"))).alias("hub"))
        pairs = postings.join(hubs, "key").filter("class <> hub").select(F.col("hub").alias("a"), F.col("class").alias("b")).distinct()
        signed = classes.select("class", "doc", "signature", "size")
        for side in ("a", "b"):
            own = signed.select(F.col("class").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("doc", "signature", "size")])
            pairs = pairs.join(own, side)
        pairs = pairs.filter(_matching(F.col("signature_a"), F.col("signature_b")) >= MATCHES)
        pairs = pairs.filter(100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")).filter("doc_a <> doc_b")
        pairs = materialize(pairs.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).distinct(), "hub_pairs")
        links = materialize(confirmed(pairs, texts, width, percent), "hub_links")
        more = merge_families(families(postings, components(links)), signed, texts, width, percent)
        merged = components(links.unionByName(more).unionByName(same_id))

    # a row per set and per linked document, which the caller's plan must not broadcast
    result = rows.join(classes.select("set_id", "doc").hint("merge"), "set_id", "left").join(merged.hint("merge"), F.col("doc") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc", "doc_id"))
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))
