"""Where intermediate tables live.

Everything that must outlive a single plan (fitted models, the weights of one
training step, row counts of file blocks) is written as parquet below the
shared folder the cluster names in ``spark.checkpoint.dir``. A written table
cuts the lineage, survives lost executors, and gives Catalyst an exact size to
choose join strategies by.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder: ``spark.checkpoint.dir``, or else the context's checkpoint folder.

    Where neither is set there is no folder that all executors are known to
    share, so only a session that is one process (master ``local``) gets a
    temporary one; any other is told to name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexmill-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lexmill/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame that scans the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_stored(df: DataFrame) -> bool:
    """Whether ``df`` does no more than scan a written table, maybe some columns of it."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project":
        named = plan.projectList()
        if any(named.apply(i).getClass().getSimpleName() != "AttributeReference" for i in range(named.length())):
            return False
        plan = plan.child()
    return plan.getClass().getSimpleName() == "LogicalRelation"


def remove(df: DataFrame) -> None:
    """Delete the folders of a written table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def materialize_placed(df: DataFrame, name: str) -> DataFrame:
    """:func:`materialize`, where joins leave rows in place that are partitioned by some of their keys.

    By default Spark shuffles such rows again, by all keys of the join.
    """
    conf, option = df.sparkSession.conf, "spark.sql.requireAllClusterKeysForCoPartition"
    before = conf.get(option)
    conf.set(option, "false")
    try:
        return materialize(df, name)
    finally:
        conf.set(option, before)


@contextmanager
def measured_joins(spark: SparkSession) -> Iterator[None]:
    """In what is written meanwhile a join's side is broadcast only if it is marked, or if its rows were shuffled and measured.

    What the optimiser expects is no bound: an exploded array counts as one entry, a stored table
    as its compressed file, and a broadcast once planned is kept, however many rows there are.
    """
    conf, expected, measured = spark.conf, "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {option: conf.get(option, None) for option in (expected, measured)}
    conf.set(measured, before[measured] or conf.get(expected))
    conf.set(expected, "-1")
    try:
        yield
    finally:
        for option, value in before.items():
            conf.unset(option) if value is None else conf.set(option, value)


# Bytes of stored input that one task should work on.
PLACED_BYTES = 256 << 20
# Sizes from here on are Spark's way to say that it does not know.
UNKNOWN_BYTES = 1 << 60


def stored_bytes(df: DataFrame) -> int | None:
    """Bytes of the stored tables that ``df`` reads, None if one of them has no known size.

    The leaves of the plan are added up. What the optimiser expects of the plan
    itself is of no use here: to it a join is as large as the product of its sides.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length())]
    return sum(sizes) if all(size < UNKNOWN_BYTES for size in sizes) else None


def parts_for(spark: SparkSession, size: int) -> int:
    """``spark.sql.shuffle.partitions``, or more if a part would have more than PLACED_BYTES."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PLACED_BYTES))


def place(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partition rows by key, for work that is many times larger than the rows themselves.

    The number of parts follows the stored input and is given, so that parts are
    not merged by their size on disk. Rows that come from no table are stored first.
    """
    size = stored_bytes(df)
    if size is None:
        df = materialize(df, "placed")
        size = stored_bytes(df)
    return df.repartition(parts_for(df.sparkSession, size), *keys)


def bucketed(df: DataFrame, keys: Sequence[str], name: str, parts: int, placed: bool = False) -> DataFrame:
    """Write ``df`` in ``parts`` buckets by key and return a scan of them.

    The scan is partitioned by the keys, so joining and grouping by them needs no
    exchange, and a lost task reads its bucket again. ``placed`` says that rows are
    partitioned so already. The name in the catalog, which Spark asks of a bucketed
    table, is given up at once; the files stay.
    """
    spark = df.sparkSession
    table = f"lexmill_{name}_{uuid.uuid4().hex}"
    parts = min(parts, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
    df = df if placed else df.repartition(parts, *keys)
    df.write.bucketBy(parts, *keys).option("path", scratch_path(spark, name)).saveAsTable(table)
    stored = spark.table(table)
    spark.sql(f"drop table {table}")
    return stored
