import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm import queries
from lexmill.storage import materialize

COLUMNS = {
    "op1": ["doc_id", "held_out", "score", "predicted"],
    "op2": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op3": ["query_id", "rank", "vec_id", "score"],
    "op4": ["vec_id", "n_links", "component_id", "kept"],
    "op5": ["doc_id", "held_out", "lang_pred", "score"],
    "op6": ["doc_id", "n_shingles", "component_id", "kept"],
    "op7": ["doc_id", "held_out", "score", "predicted"],
    "op8": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op9": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op10": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op11": ["lang", "source", "part", "item", "value", "rank"],
    "op12": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op13": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
}


def test_one_query_per_operator():
    assert sorted(q.split("_")[0] for q in queries.QUERIES) == sorted(COLUMNS)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_rows(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    assert df.columns == COLUMNS[name.split("_")[0]]
    table = "embeddings" if "vec_id" in df.columns else "pages" if "page_id" in df.columns else "documents"
    n = spark.read.parquet(f"{sf}/{table}.parquet").count()
    got = df.count()
    assert got >= n if name.startswith("op8") else got > 0 if name.startswith(("op3", "op11")) else got == n


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_agrees(spark, sf, name):
    import glob
    import os

    import duckdb

    db = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        db.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want = db.execute(queries.ORACLE[name])
    columns = [c[0] for c in want.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(columns) == sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr)


def test_stages_follow_each_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), name)
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "personal_data", "packing"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == n


def test_stages_decide(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    real = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    text = real.filter("n_chars > 300 and n_chars < 3000").orderBy("doc_id").first().text
    extra = spark.createDataFrame([(5000, None, None, None, None), (5001, "123 !!", "en", "s", 6), (5002, text, "en", "s", 1), (5003, "mail x@y.example", "en", "s", 16)], schema)
    docs = materialize(real.unionByName(extra), "docs")
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, sf).collect()}
    assert not kept & {5000, 5001} and {5002, 5003} <= kept
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()}
    assert 5002 not in kept and {5000, 5001, 5003} <= kept
    out = {r.doc_id: r for r in corpus_pipeline.redact_personal_data(spark, docs, sf).collect()}
    assert out[5003].text == "mail [EMAIL]" and out[5003].n_chars == 12 and out[5000].text is None


def test_language_stage_without_languages_and_with_one(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, None, "s", 1) for i, t in enumerate(["some words", "123 !!", None, "été"])]
    docs = spark.createDataFrame(rows, schema)
    assert sorted(r.doc_id for r in corpus_pipeline.identify_language(spark, docs, sf).collect()) == [0, 3]
    one = docs.withColumn("lang", F.lit("xx"))
    assert sorted(r.doc_id for r in corpus_pipeline.identify_language(spark, one, sf).collect()) == [0, 3]


def test_pipeline_of_nothing(spark, sf, tmp_path):
    for table in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
