"""Each query against its SQL."""

import duckdb
import pytest

from tidewell.plans.catalogue import QUERIES, SQL
from tidewell.session import TABLES

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r)) for r in df.select(columns).collect())
    if name not in SQL:
        assert rows
        return
    relation = duck.sql(SQL[name])
    assert sorted(relation.columns) == columns
    wanted = duck.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({SQL[name]})").fetchall()
    assert rows == sorted(map(repr, wanted))
    types = dict(zip(relation.columns, map(str, relation.types), strict=True))
    assert {c: KINDS.get(t, t.upper()) for c, t in df.dtypes} == {c: t.replace(" ", "") for c, t in types.items()}


def test_entry_registers_everything():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_every_event_and_document_is_read(spark, data):
    rows = QUERIES["cdc_decoded_every_line"](spark, data)
    assert rows.count() == rows.select("seq").distinct().count() == spark.read.parquet(f"{data}/events.parquet").count()
    docs = spark.read.parquet(f"{data}/documents.parquet").where("text is not null")
    assert QUERIES["flat_map_documents"](spark, data).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
