"""How far the sources of each language differ in their words, in whole numbers.

A task counts the documents of each term, and puts the terms of its documents
together by language and source. Per language a CountVectorizer takes the terms
with a least number of documents as its vocabulary (no limit of its size) and
gives exact sparse counts of what each task put together. They are added up by
source as sparse vectors: a row per source and term that occurs. A group's share
of a term is ``p = 1 + floor(1e9 * (count + 2) / (N + 2 V))`` and the divergence
of two shares ``floor((p - q)^2 / (p + q))``.

Divergences of two sources are summed over blocks of terms. All pairs of shares
of absent terms are equal, so they are counted, not evaluated; a source's pairs
are evaluated where it has a term, and else only where the other one has it. No
pair of sources is emitted per term: tasks hold sums for tiles of TILE sources.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.rows import only
from lexmill.storage import materialize, scratch_path

# What each byte of UTF-8 becomes: ASCII other than letters parts terms, A-Z are lower-cased, all else stays.
BYTES = bytes(b | 0x20 if chr(b).isalpha() else 0x20 for b in range(128)) + bytes(range(128, 256))
ANY_SIZE = 2**31 - 1
# A vocabulary passes through the driver; one that has more terms than this is built in parts by the terms' hash.
VOCABULARY_TERMS = 4_000_000
# Bytes of terms that a task holds, and those of a group in one row.
HELD_BYTES = 32 << 20
BAG_BYTES = 1 << 20
# Distinct terms that a task counts documents of before it hands the counts over.
HELD_TERMS = 1 << 18
# Sums of TILE * TILE pairs of sources are held by a task.
TILE = 1024
# Cells of one task's share of the terms, and entries of a block of terms beside all sources of a tile.
PART_CELLS = 200_000
BLOCK_ENTRIES = 1 << 20


def _rows(batch: pa.RecordBatch, *keys: str) -> Iterator[tuple]:
    """The keys of each row and the terms of its text in order."""
    for *key, text in zip(*[batch.column(k).to_pylist() for k in keys], batch.column("raw")):
        yield *key, text.as_py().translate(BYTES).split()


def _raw(docs: DataFrame, *keys: str) -> DataFrame:
    """The keys, and the text's bytes; null counts as empty."""
    return docs.select(*keys, F.coalesce("text", F.lit("")).cast("binary").alias("raw"))


def document_counts(docs: DataFrame) -> DataFrame:
    """(lang_no, term, n): documents of each language that a term occurs in. ``docs`` has (lang_no, text)."""
    parts = _raw(docs, "lang_no").mapInArrow(counted, "lang_no long, term string, n long")
    return parts.groupBy("lang_no", "term").agg(F.sum("n").alias("n"))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang_no, term, n) of a task's documents; a term may be given more than once."""
    counts: dict[int, Counter] = {}

    def given() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            columns = [pa.array(np.full(len(own), lang)), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang_no", "term", "n"])
        counts.clear()

    terms = 0
    for batch in batches:
        for lang, found in _rows(batch, "lang_no"):
            own = counts.setdefault(lang, Counter())
            terms -= len(own)
            own.update(set(found))
            terms += len(own)
            if terms >= HELD_TERMS:
                yield from given()
                terms = 0
    yield from given()


def bags(docs: DataFrame) -> DataFrame:
    """(lang_no, source_no, text): a task's terms put together by group, parted by single blanks. ``docs`` has the same columns.

    A group of much text has several rows, one without terms has none.
    """
    return _raw(docs, "lang_no", "source_no").mapInArrow(bagged, "lang_no long, source_no long, text string")


def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang_no, source_no, text) of a task's documents."""
    held: dict[tuple[int, int], list[bytes]] = {}
    sizes: Counter = Counter()

    def bag(key: tuple[int, int]) -> pa.RecordBatch:
        del sizes[key]
        columns = [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([b" ".join(held.pop(key))], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["lang_no", "source_no", "text"])

    total = 0
    for batch in batches:
        for lang, source, found in _rows(batch, "lang_no", "source_no"):
            if not found:
                continue
            key, text = (lang, source), b" ".join(found)
            held.setdefault(key, []).append(text)
            sizes[key] += len(text) + 1
            total += len(text) + 1
            if sizes[key] >= BAG_BYTES:
                total -= sizes[key]
                yield bag(key)
            if total >= HELD_BYTES:
                yield from map(bag, list(held))
                total = 0
    yield from map(bag, list(held))


def _by_language(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored by language, so that a fit reads its own language only."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy("lang_no").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def vocabulary_counts(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """(lang_no, term_no, term) of all kept terms, and (lang_no, source_no, term_no, count) of those that occur.

    ``docs`` has (lang_no, source_no, text). Each language has a CountVectorizer of its
    own, one after the other, fitted on the terms it keeps; a language that keeps none needs none.
    """
    kept = _by_language(document_counts(docs).filter(F.col("n") >= min_docs).select("lang_no", "term"), "divergence_kept")
    sizes = {r["lang_no"]: r["v"] for r in kept.groupBy("lang_no").agg(F.count(F.lit(1)).alias("v")).collect()}
    rows = _by_language(bags(docs), "divergence_bags")
    terms = counts = None
    for lang, size in sorted(sizes.items()):
        parts = -(-size // VOCABULARY_TERMS)
        for part in range(parts):
            own = kept.filter((F.col("lang_no") == lang) & (F.pmod(F.xxhash64("term"), F.lit(parts)) == part))
            found = _fit(own, rows.filter(F.col("lang_no") == lang), lang, part)
            if found is not None:
                terms, counts = found if terms is None else (terms.unionByName(found[0]), counts.unionByName(found[1]))
    if terms is None:
        empty = docs.limit(0)
        no = F.lit(0).cast("bigint")
        return empty.select("lang_no", no.alias("term_no"), F.lit("").alias("term")), empty.select("lang_no", "source_no", no.alias("term_no"), no.alias("count"))
    return terms, counts


def _fit(kept: DataFrame, rows: DataFrame, lang: int, part: int) -> tuple[DataFrame, DataFrame] | None:
    """The vocabulary of one language (or a part of it) and its counts by source in the bags ``rows``; None if it has no terms."""
    spark = rows.sparkSession
    try:
        model = CountVectorizer(inputCol="words", outputCol="counts", vocabSize=ANY_SIZE).fit(kept.select(F.array("term").alias("words")))
    except IllegalArgumentException as e:
        if "vocabulary size" in str(e):
            return None
        raise
    # stored with the model, so it goes neither through Python nor again through the driver
    path = scratch_path(spark, "count_vectorizer")
    model.write().save(path)
    number = lambda i: (F.col(i).cast("bigint") + F.lit(part << 32)).alias("term_no")
    lang_no = F.lit(lang).cast("bigint").alias("lang_no")
    terms = spark.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("i", "term")).select(lang_no, number("i"), "term")
    vectors = model.transform(rows.select("source_no", F.split("text", " ").alias("words"))).select("source_no", F.unwrap_udt("counts").alias("v"))
    cells = vectors.select("source_no", F.explode(F.arrays_zip("v.indices", "v.values")).alias("c"))
    # whole numbers, whose sums are exact in any order
    sums = cells.groupBy("source_no", F.col("c.indices").alias("i")).agg(F.sum(F.col("c.values").cast("bigint")).alias("count"))
    return terms, materialize(sums.select(lang_no, "source_no", number("i"), "count"), "group_counts")


def share(count: Column, total: Column, size: Column) -> Column:
    """``1 + floor(1e9 * (count + 2) / (total + 2 size))`` in decimals, which do not overflow."""
    above = (count + 2).cast("decimal(27,0)") * F.lit(10**9).cast("decimal(10,0)")
    return F.call_function("div", above, (total + 2 * size).cast("decimal(27,0)")) + 1


def divergence(p, q):
    """``floor((p - q)^2 / (p + q))`` of arrays of whole numbers up to 1e9 + 1, whose square is below 2^63."""
    return (p - q) ** 2 // (p + q)


class Tile:
    """Sums of divergences between sources ``a`` (rows) and ``b`` (columns), to which blocks of terms are added.

    Both are maps from a source to its share of a term that it does not have.
    """

    def __init__(self, a: dict[int, int], b: dict[int, int]):
        self.a, self.b = sorted(a), sorted(b)
        self.absent_a, self.absent_b = (np.array([x[s] for s in sorted(x)], np.int64) for x in (a, b))
        # what a pair adds for a term that neither has
        self.neither = divergence(self.absent_a[:, None], self.absent_b[None, :])
        self.sums = np.zeros(self.neither.shape, np.int64)
        # terms of a block, whose shares are held for all of b
        self.most = max(1, BLOCK_ENTRIES // max(1, len(b)))
        self.rest = [np.zeros(0, np.int64)] * 3

    def add(self, *cells: np.ndarray) -> None:
        """Add cells (term, source, p) in order of terms; the last terms wait, since they may go on in the next cells."""
        cells = [np.concatenate(c) for c in zip(self.rest, cells)]
        starts = np.flatnonzero(np.diff(cells[0])) + 1
        cuts = [0, *starts[self.most - 1 :: self.most].tolist()]
        for start, stop in zip(cuts[:-1], cuts[1:]):
            self._block(*[c[start:stop] for c in cells])
        self.rest = [c[cuts[-1] :] for c in cells]

    def end(self, terms: int) -> np.ndarray:
        """The sums over all cells and over ``terms`` terms as if no source had them."""
        self._block(*self.rest)
        return self.sums + terms * self.neither

    def _block(self, term: np.ndarray, source: np.ndarray, p: np.ndarray) -> None:
        """Add what a block's pairs have beyond ``neither``."""
        if not len(term):
            return
        term = np.unique(term, return_inverse=True)[1]
        n = term.max() + 1
        row, col = (_places(x, source) for x in (self.a, self.b))
        inside = col >= 0
        shares = np.tile(self.absent_b, (n, 1))
        shares[term[inside], col[inside]] = p[inside]
        order = np.argsort(row, kind="stable")
        bounds = np.searchsorted(row[order], np.arange(len(self.a) + 1))
        for i, (start, stop) in enumerate(zip(bounds[:-1], bounds[1:])):
            # terms that this source has, against all of b
            own = order[start:stop]
            self.sums[i] += (divergence(p[own][:, None], shares[term[own]]) - self.neither[i]).sum(0)
            # terms that only the other one has
            has = np.zeros(n, bool)
            has[term[own]] = True
            other = inside & ~has[term]
            np.add.at(self.sums[i], col[other], divergence(self.absent_a[i], p[other]) - self.neither[i][col[other]])


def _places(sources: list[int], wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted source among the sorted ones, -1 if it is none of them."""
    known = np.array(sources, np.int64)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[at] == wanted, at, -1)


def _pair_sums(cells: DataFrame, groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang_no, a, b, value): summed divergences of all pairs of sources of a language, both ways.

    ``cells`` (lang_no, source_no, term_no, p), ``groups`` (lang_no, source_no,
    p0: the share of a term it does not have), ``sizes`` (lang_no, v terms, cells, sources).
    """
    sizes = sizes.withColumn("parts", F.ceil((F.col("cells") + 1) / PART_CELLS).cast("bigint"))
    tiles = F.sequence(F.lit(0).cast("bigint"), F.expr(f"(sources - 1) div {TILE}"))

    def dealt(df: DataFrame) -> DataFrame:
        """A copy for each pair of tiles that the row's source is in."""
        df = df.withColumn("_own", F.expr(f"source_no div {TILE}")).withColumn("_other", F.explode(tiles))
        return df.withColumns({"i": F.least("_own", "_other"), "j": F.greatest("_own", "_other")}).drop("_own", "_other")

    key, no = ["lang_no", "i", "j", "part"], F.lit(0).cast("bigint")
    # each task first gets the shares of absent terms, and the first part the number of terms
    heads = dealt(groups.join(sizes, "lang_no")).withColumn("part", F.explode(F.sequence(no, F.col("parts") - 1)))
    heads = heads.select(*key, F.lit(-1).cast("bigint").alias("term_no"), "source_no", F.coalesce("p0", no + 1).alias("p"), F.when(F.col("part") == 0, F.col("v")).otherwise(no).alias("v"))
    rows = dealt(cells.join(sizes, "lang_no").withColumn("part", F.pmod(F.xxhash64("term_no"), F.col("parts"))))
    rows = heads.unionByName(rows.select(*key, "term_no", "source_no", "p", no.alias("v")))
    rows = rows.repartition(*key).sortWithinPartitions(*key, "term_no")
    schema = pa.schema([("lang_no", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64())])

    def emitted(lang: int, i: int, j: int, tile: Tile, terms: int) -> Iterator[pa.RecordBatch]:
        a, b = np.array(tile.a), np.array(tile.b)
        for s, values in zip(a, tile.end(terms)):
            other = b != s
            ones, s_values = np.full(other.sum(), s), values[other]
            for x, y in ((ones, b[other]),) if i == j else ((ones, b[other]), (b[other], ones)):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(len(x), lang), x, y, s_values)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tile, heads, terms = None, None, {}, 0

        def begun() -> Tile:
            return tile or Tile(*[{s: p for s, p in heads.items() if s // TILE == x} for x in now[1:3]])

        for batch in filter(len, batches):
            columns = [batch.column(c).to_numpy() for c in (*key, "term_no", "source_no", "p", "v")]
            change = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns[:4]], axis=0)) + 1
            for start, stop in zip([0, *change], [*change, len(batch)]):
                these = tuple(int(c[start]) for c in columns[:4])
                if these != now:
                    if now is not None:
                        yield from emitted(*now[:3], begun(), terms)
                    now, tile, heads, terms = these, None, {}, 0
                term, source, p, v = (c[start:stop] for c in columns[4:])
                cells = int(np.searchsorted(term, 0))
                heads.update(zip(source[:cells].tolist(), p[:cells].tolist()))
                terms = max([terms, *v[:cells].tolist()])
                if cells < len(term):
                    tile = begun()
                    tile.add(term[cells:], source[cells:], p[cells:])
        if now is not None:
            yield from emitted(*now[:3], begun(), terms)

    parts = rows.mapInArrow(run, "lang_no long, a long, b long, value long")
    return parts.groupBy("lang_no", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs from the others and from the language.

    Part ``pair`` has each other source of the language as item and the
    divergences summed over all kept terms, part ``term`` the ``top`` terms that
    occur in the source and have a larger share there than in the language.
    Ranks are by value, largest first, then by the item's UTF-8 bytes.

    Null language, source and text count as empty ones. Sources without terms
    take part with counts of 0; a language without kept terms has pairs of value
    0; a source alone in its language has no pairs. Repeated rows count each;
    other columns are left out, and an empty table gives an empty result.
    """
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    docs = only(docs, lang=lang_col, source=source_col, text=text_col).select(empty("lang"), empty("source"), "text")
    groups = materialize(docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")), "divergence_groups")
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).withColumn("lang_no", F.row_number().over(Window.orderBy("lang")).cast("bigint"))
    langs = materialize(langs, "divergence_langs")  # one row per language
    by_source = Window.partitionBy("lang").orderBy("source")
    groups = groups.join(langs.select("lang", "lang_no"), "lang").withColumn("source_no", F.row_number().over(by_source).cast("bigint") - 1)
    groups = materialize(groups, "divergence_numbers")
    numbers = groups.select("lang", "source", "lang_no", "source_no")
    terms, counts = vocabulary_counts(_with_numbers(docs, numbers), min_docs)

    per_term = counts.groupBy("lang_no", "term_no").agg(F.sum("count").alias("in_lang"))
    per_group = counts.groupBy("lang_no", "source_no").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("cells"))
    groups = groups.join(per_group, ["lang_no", "source_no"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    v = terms.groupBy("lang_no").agg(F.count(F.lit(1)).alias("v"))
    sizes = groups.groupBy("lang_no").agg(F.sum("total").alias("lang_total"), F.coalesce(F.sum("cells"), F.lit(0)).alias("cells"), F.count(F.lit(1)).alias("sources"))
    sizes = sizes.join(v, "lang_no", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    sizes = materialize(sizes, "divergence_sizes")
    groups = groups.join(sizes.select("lang_no", "v", "lang_total"), "lang_no")
    p0 = F.when(F.col("v") > 0, share(F.lit(0).cast("bigint"), F.col("total"), F.col("v")))
    groups = materialize(groups.withColumn("p0", p0), "divergence_shares")
    totals = groups.select("lang_no", "source_no", "total", "v", "lang_total")
    cells = counts.join(totals, ["lang_no", "source_no"]).withColumn("p", share(F.col("count"), F.col("total"), F.col("v")))
    cells = materialize(cells, "divergence_cells")

    pairs = _pair_sums(cells.select("lang_no", "source_no", "term_no", "p"), groups.select("lang_no", "source_no", "p0"), sizes.select("lang_no", "v", "cells", "sources"))
    other = numbers.select("lang_no", F.col("source_no").alias("b"), F.col("source").alias("item"))
    pairs = pairs.join(other, ["lang_no", "b"]).select("lang_no", F.col("a").alias("source_no"), F.lit("pair").alias("part"), "item", "value")
    in_lang = cells.join(per_term, ["lang_no", "term_no"]).withColumn("q", share(F.col("in_lang"), F.col("lang_total"), F.col("v"))).filter("p > q")
    # squares of whole numbers up to 1e9 + 1 fit a long
    value = F.expr("((p - q) * (p - q)) div (p + q)")
    marked = in_lang.join(terms, ["lang_no", "term_no"]).select("lang_no", "source_no", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))
    order = Window.partitionBy("lang_no", "source_no", "part").orderBy(F.desc("value"), "item")
    # Spark cuts to the first ranks before rows of a group meet
    marked = marked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(marked)
    return ranked.join(numbers, ["lang_no", "source_no"]).select("lang", "source", "part", "item", "value", "rank")


def _with_numbers(docs: DataFrame, numbers: DataFrame) -> DataFrame:
    """(lang_no, source_no, text): groups are few beside documents and joined to them without a shuffle while they are of bounded size."""
    size = numbers.agg(F.coalesce(F.sum(F.octet_length("lang") + F.octet_length("source") + 48), F.lit(0))).first()[0]
    numbers = F.broadcast(numbers) if size <= 32 << 20 else numbers
    return docs.join(numbers, ["lang", "source"]).select("lang_no", "source_no", "text")
