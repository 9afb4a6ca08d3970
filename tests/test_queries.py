"""Registered queries against their SQL checks on the smallest data set."""

import os

import pytest

import __spark_entry__ as E
from checks import compare

SF = "/root/testdata/sf0.001"
NAMES = [
    "full_validation", "w2_validate", "k1_validate", "universal_rules", "propose_fixes", "apply_fixes", "ledger_current", "ledger_audit", "sync_client_ids",
    "status_transitions", "dup_upload", "missing_recurring", "name_tin_mismatch", "identity_match", "filing_grouped", "client_summary", "exception_rollup",
    "autofill_income", "gate_score", "gate_pages", "form_segments", "row_fold_digital", "flatten_payload", "conform_schema", "snapshots", "stream_dedup", "stream_attempts",
]


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got = E.queries()[name](spark, SF).toPandas()
    assert compare(got, con.sql(E.oracle_sql()[name]).df()) == ""


def test_every_query_has_a_check():
    ours = {k for k in E.queries() if k not in E._corpus("QUERIES")}
    assert ours == {k for k in E.oracle_sql() if k not in E._corpus("ORACLE")}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entry(spark):
    assert E.entry(spark).count() > 0
