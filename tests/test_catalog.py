import glob
import os
import sys

import duckdb
import pytest

from lexmill import catalog

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check import differences  # noqa: E402

SF = "/root/testdata/sf0.001"
# one of each kind; tools/check.py runs them all
CHOSEN = ["bag_of_words", "label_docs", "tfidf_holdout", "coords_to_dense", "matmul", "nb_predict", "gnb_scores_zero", "softmax_step"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def test_every_query_has_its_sql():
    assert set(catalog.ORACLE) == set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_sql_can_be_planned(db, name):
    db.execute(f"explain {catalog.ORACLE[name]}")


@pytest.mark.parametrize("name", CHOSEN)
def test_query_agrees_with_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0
    assert differences(got, db.execute(catalog.ORACLE[name]).fetchdf()) == ""


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.queries().keys() >= catalog.QUERIES.keys()
    assert entry.oracle_sql().keys() >= catalog.ORACLE.keys()
    assert entry.entry(spark).columns == ["doc_id", "label", "score"]
