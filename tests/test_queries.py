"""Every query against its oracle on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from tallyframe.plans import registry

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: TYPES[k] for c, k in df.dtypes} == kinds
    cols = sorted(df.columns)
    assert Counter(map(tuple, df.select(*cols).collect())) == Counter(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - {"tfidf_lr", "ngram_predictions_word", "ngram_predictions_char_wb"}))
def test_rows_only(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_queries_without_sql_read_whole_first_lines(spark):
    from tallyframe.plans import fixtures

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert registry.QUERIES["unicode_audit"](spark, SF).count() == docs.count()
    want = sorted((r["text"] or "").split("\n")[0].strip(" ") for r in docs.collect())
    assert sorted(r["alt_name"] for r in fixtures.name_pairs(spark, SF).collect()) == want
