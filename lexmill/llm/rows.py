"""What the operators share: reading tables, held-out rows, and Python work on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.workers import trim

# Texts are worked on in slices of about this many characters, so that the
# memory of a task does not depend on how many rows an Arrow batch has.
SLICE_CHARS = 4 << 20
# Bytes of texts that are Python strings at once where a column is computed from them.
COLUMN_BYTES = 1 << 20
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under fixed names; all others, whatever they are called, are left out."""
    return df.select(*[df[column].alias(name) for name, column in columns.items()])


def remainder(id_col: str | Column, modulus: int) -> Column:
    """``crc32(id as text) % modulus``; null for a null id."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(col.cast("string").cast("binary")) % modulus


def sample_rows(df: DataFrame, key: str, n: int, seed: int, total: int | None = None) -> DataFrame:
    """At most ``n`` rows, chosen by a hash of the key: the same ones on every run.

    Only rows below a bound of the hash are sorted and sent, about four times
    ``n`` of the ``total`` rows, however many tasks there are.
    """
    total = df.count() if total is None else total
    hashed = F.xxhash64(F.lit(seed), F.col(key))
    if total > 4 * n:
        df = df.filter(hashed < int(4 * n / total * 2**64) - 2**63)
    return df.orderBy(hashed, key).limit(n)


def fitting(sizes: Sequence[int], bound: int) -> list[int]:
    """Places of rows of together at most ``bound``, taken in order; a row that does not fit is passed over.

    Where none fits, it is the smallest row.
    """
    taken, left = [], bound
    for i, size in enumerate(sizes):
        if size <= left:
            taken.append(i)
            left -= size
    return taken or [int(np.argmin(sizes))] if len(sizes) else []


def sample_texts(df: DataFrame, group: Column, rows: int, chars: int, seed: int) -> list[Row]:
    """Whole texts to fit a model on: rows (doc_id, label, text) on the driver, the same ones on every run.

    ``df`` has doc_id, label, text, none of them null; equal rows count once. Of each ``group``
    the first ``rows`` by a hash of the id are listed, and of these as many taken as have
    together at most ``chars`` characters. A longer text is taken only where its group has no shorter one.
    """
    mark = F.xxhash64("text")
    short = df.select("doc_id", "label", group.alias("group"), F.xxhash64(F.lit(seed), "doc_id").alias("h"), F.length("text").alias("size"), mark.alias("mark"))
    order = ["h", "doc_id", "label", "mark"]
    rank = F.row_number().over(Window.partitionBy("group").orderBy(*order))
    listed = short.distinct().withColumn("rank", rank).filter(F.col("rank") <= rows).orderBy(*order).collect()
    groups: dict = {}
    for row in listed:
        groups.setdefault(row["group"], []).append(row)
    taken = [own[i] for own in groups.values() for i in fitting([r["size"] for r in own], chars)]
    place = {(r["doc_id"], r["label"], r["mark"]): (r["h"], i) for i, r in enumerate(taken)}
    schema = df.select("doc_id", "label", mark.alias("mark")).schema
    wanted = F.broadcast(df.sparkSession.createDataFrame(list(place), schema))
    found = df.withColumn("mark", mark).join(wanted, ["doc_id", "label", "mark"]).groupBy("doc_id", "label", "mark").agg(F.first("text").alias("text"))
    return sorted(found.collect(), key=lambda r: place[r["doc_id"], r["label"], r["mark"]])


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile hands whole texts to Python BATCH_ROWS at a time: a batch is held by the JVM and by the worker."""
    option = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(option)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(option, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(option, before)


def slices(texts: list[str | None], chars: int = SLICE_CHARS) -> Iterator[slice]:
    """Runs of neighbouring texts of about ``chars`` characters, at least one text each."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text or "")
        if total >= chars:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def map_text(
    df: DataFrame, text: str, make: Callable[[], Callable[[list[str | None]], list]], fields: dict[str, pa.DataType], ddl: str
) -> DataFrame:
    """Replace the column ``text`` by columns computed from it in Arrow batches.

    ``make`` is called once per task and returns the function from a list of
    texts to one sequence per new column. All other columns are passed on as
    they are.
    """
    kept = [c for c in df.columns if c != text]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + [ddl])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = batch.column(text).to_pylist()
            parts = [work(texts[s]) for s in slices(texts)]
            columns = [pa.concat_arrays([pa.array(p[k], kind) for p in parts]) if parts else pa.array([], kind) for k, kind in enumerate(fields.values())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + columns, names=kept + list(fields))
        trim()

    return df.select(*kept, text).mapInArrow(run, schema)


def text_column(text: Column, make: Callable[[], Callable[[list[str | None]], pa.Array]], ddl: str) -> Column:
    """A column computed from texts in Arrow batches, as :func:`map_text` computes several."""
    return F.arrow_udf(sliced(make), ddl)(text)


def sliced(make: Callable[[], Callable[[list[str | None]], pa.Array]]) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """Work through batches of texts, of which about COLUMN_BYTES are Python strings at a time.

    ``make`` is called once per task and before the first batch is taken, so what another
    operator held is gone by then; what the task used goes back to the system.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False))
            done, parts = 0, []
            while done < len(batch) or not parts:
                # the text that reaches the bound is in
                before = ends[done - 1] if done else 0
                stop = min(int(np.searchsorted(ends, before + COLUMN_BYTES)) + 1, len(batch))
                parts.append(work(batch.slice(done, stop - done).to_pylist()))
                done = stop
            yield pa.concat_arrays(parts)
        trim()

    return run


def utf8(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of bytes, and where each begins (one entry more than texts)."""
    raw = [(t or "").encode() for t in texts]
    ends = np.cumsum([0] + [len(r) for r in raw])
    return np.frombuffer(b"".join(raw), np.uint8), ends
