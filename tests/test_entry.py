import re

import duckdb
import pytest

import __spark_entry__ as E
from shopgroups.sources.tables import TABLE_NAMES, table_path

SF = "/root/testdata/sf0.001"
ALL_CHECKED = sorted(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "lift" in df.columns and "rule_rank" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_queries_set_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    E.queries()["cluster_contract"](spark, SF)
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF, t)}')")
    return con


@pytest.mark.parametrize("name", ALL_CHECKED)
def test_query_matches_duckdb(spark, duck, name):
    from oracle_check import compare
    ok, msg, _ = compare(spark, duck, SF, name, E.oracle_sql()[name])
    assert ok, msg


#: Retail queries without a statement; DBSCAN's studies have tests of their own.
OTHERS = sorted(n for n in set(E.queries()) - set(E.oracle_sql()) if not re.match(r"op\d+_|pipeline|dbscan_(diagnostics|cluster_balance)", n))


@pytest.mark.parametrize("name", OTHERS)
def test_query_without_statement_runs(spark, name):
    df = E.queries()[name](spark, SF)
    assert df.columns and df.count() > 0
