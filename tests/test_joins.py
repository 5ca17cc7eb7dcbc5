import pytest
from pyspark.sql import functions as F

from lexmill.functions.text import bag_of_words
from lexmill import storage
from lexmill.operators.joins import Lookup, beside_each, product_join
from lexmill.operators.ranking import hash_hex, lowest_by_hash, running_total


@pytest.fixture()
def skewed(spark):
    """10,000 rows over 7,000 keys; key 'hot' holds a third of them, 'none' is in no table."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, "none").otherwise(F.concat(F.lit("k"), F.col("id")))
    return spark.range(10_000).select(F.col("id"), key.alias("key"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_lookup_equals_plain_join(spark, rows, skewed, how):
    table = skewed.filter("key <> 'none'").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    lookup = Lookup.build(table, ["key"], "n")
    plain = rows(lookup.join(skewed, how), "id", "key", "n", "m")
    lookup.broadcast_bytes = 0
    split = lookup.join(skewed, how)
    assert rows(split, "id", "key", "n", "m") == plain
    assert len(plain) == (10_000 if how == "left" else skewed.filter("key <> 'none'").count())


def test_product_join_meets_every_pair_once(spark, rows):
    a = spark.range(600).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("x"))
    b = spark.range(300).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 60).alias("k"), F.col("id").alias("y"))
    want = rows(a.join(b, "k"), "k", "x", "y")
    assert rows(product_join(a, b, "k", part_rows=20), "k", "x", "y") == want
    assert rows(product_join(a, b, "k"), "k", "x", "y") == want


def test_running_total(spark, rows):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), (F.col("id") % 5).alias("v"))
    got = dict(map(tuple, running_total(df, ["k"], F.col("v")).select("k", "before").collect()))
    total = 0
    for k, v in sorted(map(tuple, df.collect())):
        assert got[k] == total
        total += v


def test_lowest_by_hash_equals_a_full_sort(spark, rows):
    df = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 1000 == 1, "c").otherwise("b").alias("g"))
    quota = spark.createDataFrame([("a", 700), ("b", 3), ("c", 5000)], "g string, quota bigint")
    got = rows(lowest_by_hash(df, ["id"], ["g"], "seed", quota), "g", "id")
    hashed = sorted((tuple(r) for r in df.select("g", hash_hex("seed", "id"), "id").collect()))
    want = []
    for g, q in (("a", 700), ("b", 3), ("c", 5000)):
        want += [(g, i) for gg, _, i in hashed if gg == g][:q]
    assert got == sorted(want, key=repr)
    one = spark.range(1).select(F.lit(250).cast("bigint").alias("quota"))
    got = rows(lowest_by_hash(df.select("id"), ["id"], [], "seed", one))
    want = sorted((h, i) for _, h, i in hashed)[:250]
    assert got == sorted(((i,) for _, i in want), key=repr)
    more = spark.range(1).select(F.lit(10**6).cast("bigint").alias("quota"))
    assert lowest_by_hash(df.select("id"), ["id"], [], "seed", more).count() == 20_000


def test_a_split_lookup_evaluates_its_rows_once(spark):
    docs = spark.createDataFrame([(i, "the cat and the dog " * 3) for i in range(20)], "doc_id bigint, text string")
    x = bag_of_words(docs)
    table = x.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"))
    lookup = Lookup.build(table, ["feature"], "rows")
    lookup.broadcast_bytes = 0
    joined = lookup.join(x)
    assert "Generate" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == x.count()


def test_hot_keys_of_a_wide_lookup_are_dealt_out(spark, rows, monkeypatch):
    monkeypatch.setattr("lexmill.operators.joins.BROADCAST_BYTES", 1000)
    left = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"), F.col("id").alias("v"))
    table = left.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).withColumn("w", F.length("key")).filter("key <> 'k0'")
    lookup = Lookup.build(table, ["key"], "rows", width=50)
    lookup.broadcast_bytes = 0
    want = sorted((r.key, r.v, len(r.key)) for r in left.collect() if r.key != "k0")
    assert sorted((r.key, r.v, r.w) for r in lookup.join(left).collect()) == want
    assert [(r.key, r.v) for r in lookup.join(left, "left").filter("w is null").collect()] == [("k0", 0)]


def test_many_classes_beside_each_row(spark, rows, monkeypatch):
    df = spark.range(40).withColumn("x", F.col("id") * 2)
    classes = spark.range(30).select(F.concat(F.lit("c"), F.col("id")).alias("label"), F.col("id").alias("n"))
    want = rows(beside_each(df, classes))
    assert len(want) == 1200
    monkeypatch.setattr("lexmill.operators.joins.CLASS_BYTES", 100)
    assert rows(beside_each(df, classes)) == want
    assert beside_each(df, classes.limit(0)).count() == 0


def test_lookup_does_not_write_stored_rows_again(spark, rows, monkeypatch):
    left = storage.materialize(spark.range(100).selectExpr("id % 7 as k", "id as v"), "left")
    table = spark.range(5).selectExpr("id as k", "id * 2 as w", "10L as rows")
    lookup = Lookup.build(table, ["k"], "rows")
    lookup.broadcast_bytes = 0
    written = []
    monkeypatch.setattr("lexmill.operators.joins.materialize", lambda df, name: written.append(name) or storage.materialize(df, name))
    found = lookup.join(left, "left")
    assert written == []
    assert rows(found, "k", "v", "w") == sorted(((n % 7, n, n % 7 * 2 if n % 7 < 5 else None) for n in range(100)), key=repr)
    # what is computed still is stored
    lookup.join(left.withColumn("v", left.v + 1))
    lookup.join(left.filter("v > 1"))
    assert written == ["lookup_rows"] * 2


def test_a_split_lookup_shuffles_only_what_may_not_be_broadcast(spark, rows, monkeypatch):
    monkeypatch.setattr("lexmill.operators.joins.HOT_KEYS", 2)
    left = spark.range(100).selectExpr("concat('k', id) as key", "100 - id as n").selectExpr("key", "explode(sequence(1, n)) as v").unionByName(
        spark.createDataFrame([(None, 1), ("other", 2)], "key string, v long")
    )
    table = left.filter("key <> 'other'").groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max("v").alias("m"))
    more = spark.createDataFrame([("no rows", 0, 1), ("unknown rows", None, 1)], "key string, rows long, m long")
    lookup = Lookup.build(table.union(more), ["key"], "rows", 2)
    kept = []
    plain = {how: rows(left.join(table, "key", how), "key", "v", "m") for how in ("inner", "left")}
    # 32 + 16 bytes a row, and 3 of a key
    for bound in (0, 40 * 52, 200 * 60):
        lookup.broadcast_bytes = bound
        kept.append(lookup.df.filter(lookup.near()).count())
        assert lookup.df.filter(~lookup.near()).count() == lookup.df.count() - kept[-1]
        if not lookup.is_broadcast:
            for how in ("inner", "left"):
                assert rows(lookup.join(left, how), "key", "v", "m") == plain[how]
    assert kept[0] == 0 and 10 <= kept[1] <= 20 and kept[2] > 60
