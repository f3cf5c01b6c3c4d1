"""Every registered query against its SQL on the smallest tables; the others at least run and give rows."""

import os

import pytest

import __spark_entry__ as entry
from folioforge.plans import analytics_queries, corpus_queries, detail_queries, index_queries, parser_queries, retrieval_queries, service_queries, stream_queries

from .oracle import connection, difference

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
FAMILIES = (retrieval_queries, corpus_queries, analytics_queries, parser_queries, detail_queries, index_queries, service_queries, stream_queries)
NAMES = [n for f in FAMILIES for n in f.QUERIES]


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
    else:
        assert difference(got, duck.sql(sql).df()) == ""


def test_names_are_registered_once():
    assert len(NAMES) == len(set(NAMES))
    assert entry.entry is not None and set(entry.oracle_sql()) <= set(entry.queries())
