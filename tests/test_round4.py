"""Cases of the findings of round 4."""

import datetime as dt
import json
import random

import duckdb
import pytest
from checks import compare
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from formweave.operators import ledger as L
from formweave.operators.flatten import flatten_payload
from formweave.operators.shapes import flatten_rows

T0 = dt.datetime(2024, 1, 10)
# two W-2 documents with one number, and a 1099-INT and a K-1 with another
SHARED = [(58003, "signup"), (79719, "signup"), (33420, "view"), (34720, "purchase"), (7, "click")]


@pytest.fixture(scope="module")
def shared_numbers(spark, tmp_path_factory):
    """Events of clients whose documents share their number."""
    r, folder = random.Random(4), str(tmp_path_factory.mktemp("events"))
    rows = []
    for i in range(400):
        user, kind = r.choice(SHARED)
        rows.append((i, T0 + dt.timedelta(minutes=r.randint(0, 14000), seconds=i), user, kind, round(r.random() * 60, 2), "{}"))
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    df.coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["audit_escalations", "ledger_as_of", "ledger_audit", "ledger_current", "ledger_versions", "document_log", "stream_ledger", "escalations"])
def test_documents_that_share_a_number(spark, shared_numbers, name):
    """F2 to F8: two documents may have the same short number."""
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    con.execute(f"create view events as select * from read_parquet('{shared_numbers}/events.parquet/*.parquet')")
    assert compare(queries()[name](spark, shared_numbers).toPandas(), con.sql(oracle_sql()[name]).df()) == ""


def test_status_update_of_a_shared_number(spark):
    """An update goes to the document that had the number first, and to it alone."""
    rows = [("client 58003", "W-2", T0, 1), ("client 79719", "W-2", T0 + dt.timedelta(hours=1), 2)]
    p = L.prepare(spark.createDataFrame(rows, "client_name string, document_type string, ts timestamp, seq bigint"))
    assert p.select("document_id").distinct().count() == 1
    u = p.limit(1).select("document_id", F.lit("APPROVED").alias("status"), F.lit(T0 + dt.timedelta(hours=2)).alias("ts"), F.lit(3).cast("bigint").alias("seq"))
    state = L.current(L.history(p.unionByName(L.status_updates(u, p)))).collect()
    assert {(s.client_key, s.status, s.upload_count) for s in state} == {("client 58003", "APPROVED", 1), ("client 79719", "RECEIVED", 1)}


ODD = [
    '{"a":1.50,"b":"x","c":1e5,"d":-0.0,"e":true,"f":null,"g":"","h":"$1,250.00","i":" 7 ","j":12345678901234567890}', '{ "a" : 2 , "b" : "y:z" , "n":[1, 2.50,"q"], "s":"s0", "l":[] }',
    r'{"q\"uote":"say \"hi\"","b\\":"back\\","u":"é\n","k":"a,b:{}[]"}', '{"a":1,"b":2,"a":"last"}', '{"employee_first_name":" Ann ","employee_last_name":"Lee ","employee_name":"Old"}',
    '{"employee_first_name":"","x":{"employee_last_name":"Only "}}', '{"employee_first_name":5,"payer_ein":"12-3456789","payer_tin":"9"}', '{"box_12":[{"code":"D","v":1},{"code":"E","v":"2"},7,[1]],"m":[1,{"a":2}],"o":[[1],[2]]}',
    '{"a":{"b":{"c":{"d":{"e":{"f":{"g":"deep"}}}}}}}', '[{"x":1},{"x":"2"}]', '[1,2]', '"text"', 'null', '', 'not json', '{"a":1', '{"a":01}', '{"a":"\\q"}', "{'a':'b'}", '{"a":NaN,"b":-Infinity}',
    '{"k":5,": ":"v"}', '{"k":5,":x":"v","s":1,"n":"n1"}', '{"a":"s0","b":"s0 s1","c":"l3"}', '{}', '{"a":{}}', '{"a":"\x01"}', '{"extraction_metadata":{"a":1},"a":2}', None, '{"a":-}', '{"a":tru}', '{"a":12x}', '{"box_1":{"box_a_amount":3},"box_2_amount":"4"}',
    '{"a":' * 80 + '1' + '}' * 80,
]


@pytest.mark.parametrize("keep_metadata", [False, True])
def test_flattening_by_shape_equals_flattening(spark, keep_metadata):
    """payloads of any kind, many of one shape with other values."""
    more = [json.dumps({"employee_first_name": f"A{i}", "employee_last_name": None if i % 2 else f"Z {i}", "list": [{"v": i}] * (i % 3), "t": [i], "amount": f"{i},000"}) for i in range(20)]
    df = spark.createDataFrame(list(enumerate(ODD + more)), "doc_id int, payload string").repartition(3)
    want = flatten_payload(df, keep_metadata=keep_metadata).select("doc_id", F.explode("fields").alias("x")).select("doc_id", "x.*")
    got = flatten_rows(df, "doc_id", keep_metadata=keep_metadata)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_documents_of_a_shape_are_opened_once(spark):
    """the payloads are not opened again where all of them have a template."""
    df = spark.range(100).selectExpr("id as doc_id", "concat('{\"a\":', id, ',\"b\":{\"c\":\"x', id, '\"}}') as payload")
    rows = flatten_rows(df, "doc_id")
    assert "map<string,variant>" not in rows._jdf.queryExecution().optimizedPlan().toString().lower() and rows.count() == 200
