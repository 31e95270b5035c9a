"""Every query of the catalogue against its SQL, and those without SQL for their rows."""

import pytest
from compare import connect, rows_of_duckdb, rows_of_spark

from plumbline.plans import catalogue, oracles


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_matches_sql(spark, sf_dir, name):
    got, want = rows_of_spark(catalogue.QUERIES[name](spark, sf_dir)), rows_of_duckdb(connect(sf_dir), oracles.SQL[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(oracles.SQL)))
def test_has_rows(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert set(e.entry(spark).columns) == {"change_id", "total", "covered", "verdict", "reason_code"}
    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship_reaches_both_verdicts(spark, sf_dir):
    got = {r["verdict"] for r in catalogue.change_verdict(spark, sf_dir).select("verdict").distinct().collect()}
    assert got == {"SAFE", "UNPROVEN"}
