"""Cases of the findings of round 3."""

import datetime

from formweave.functions import scalar as S
from formweave.operators.clients import contained_names
from formweave.operators.records import settle
from formweave.plans import inputs as I
from formweave.plans.q_facts import ORACLE, w2_payloads
from pyspark.sql import functions as F


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_substrings_are_never_broadcast(spark):
    """Spark takes exploded substrings for as small as the names they come from."""
    names = spark.createDataFrame([("stone1",), ("a name of more than thirty-two characters",)], "name_key string")
    at = datetime.datetime(2024, 1, 1)
    clients = spark.createDataFrame(
        [("C1", at, "Pat", "Stone12", None, None), ("C2", at, None, None, "A Name of More than Thirty-two Characters Ltd", None)],
        "id string, created_at timestamp, first_name string, last_name string, business_name string, trust_name string")
    found = contained_names(names, clients)
    assert "BroadcastHashJoin" not in _plan(found)
    assert sorted((r.name_key, r.client_id, r.tier) for r in found.collect()) == [
        ("a name of more than thirty-two characters", "C2", 1), ("stone1", "C1", 0)]


def test_revalidation_takes_all_documents(spark):
    """texts that look like numbers are among the patched payloads, and in the SQL."""
    docs = w2_payloads(spark, "/root/testdata/sf0.001", I.W2_SQL)
    n = docs.where("doc_id % 17 = 0 and doc_id % 41 <> 0").where(F.col("payload").contains('"wages_tips_compensation":"0"')).count()
    assert n > 0
    assert "then '0'" in ORACLE["revalidate_fixed"] and "'12345678'" in ORACLE["revalidate_fixed"]


def test_settled_values_are_projected(spark):
    """F8 and others: what a generator holds may be interpreted, so it only hands on a projected row."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    d = settle(spark.range(3), twice=F.col("id") * 2)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
    generate = next(x for x in _plan(d).splitlines() if "Generate" in x)
    assert "* 2" not in generate
    assert [(r.id, r.twice) for r in d.orderBy("id").collect()] == [(0, 0), (1, 2), (2, 4)]


def test_lenient_number_tests_before_it_casts(spark):
    """F8 and others: no exception is made for identifiers; the values stay."""
    cases = {"12-3456789": None, "123-45-6789": None, "-5": -5.0, "5.": 5.0, ".5": 0.5, "-.5": -0.5, ".": None, "-": 0.0, "1-2": None, "1.2.3": None,
             "--5": None, "$1,250.75": 1250.75, "(1,250.75)": -1250.75, "abc": None, "": None, " n/a ": None, "None": None, "—": 0.0, "7-": None, "n.a.": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", S.lenient_number(F.col("t")).alias("d"))
    assert {r.t: r.d for r in rows.collect()} == cases
    assert "RLIKE" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_fields_of_a_payload_are_worked_out_once(spark):
    """a filter that Spark infers from an explode does not hold the fields' expressions again."""
    from formweave.operators.flatten import flatten_payload

    docs = spark.createDataFrame([(1, '{"a":{"b":"$1,5","a":null,"b":"{x"},"c":[1,"n"],"d":"true","e":"-x"}')], "doc_id int, payload string")
    rows = flatten_payload(docs).select("doc_id", F.explode("fields").alias("x")).select("x.field", "x.kind", "x.s")
    filters = [x for x in _plan(rows).splitlines() if "Filter" in x]
    assert not any("lambda" in x for x in filters)
    assert [tuple(r) for r in rows.collect()] == [("b", "str", "{x"), ("a", "null", None), ("c", "list", '[1,"n"]'), ("d", "str", "true"), ("e", "str", "-x")]


def test_documents_of_one_file_are_many_tasks(spark):
    """a table of one row group is read by one task, which would open every payload alone."""
    from formweave.plans.q_text import payloads

    for docs in (payloads(spark, "/root/testdata/sf0.001"), w2_payloads(spark, "/root/testdata/sf0.001"), I.w2_docs(spark, "/root/testdata/sf0.001")):
        tasks = docs.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert sum(r["count"] for r in tasks) == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()


def test_rules_in_order_and_no_scores_for_the_split(spark):
    """Rules run on the few fields that may raise something, in rule, list and field order; the split takes no scores."""
    from formweave.operators.records import from_columns
    from formweave.plans.validation import with_classified

    text = {"note": " n.A. ", "employer_name": "Acme Holdings", "employee_name": "Jo Doe", "x_amount": "5O", "y_amount": "0.0", "z_amount": "--"}
    spec = [(k, "str", F.lit(v)) for k, v in text.items()] + [("a_wages", "num", F.lit(2e6)), ("b_wages", "num", F.lit(2e7)), ("c_wages", "num", F.lit(1.05)), ("tax_year", "num", F.lit(2001)), ("is_corrected", "bool", F.lit(None).cast("boolean"))]
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.lit("W-2").alias("form_type"), from_columns(spec).alias("fields"))
    d = with_classified(docs, forms=["W-2"])
    assert "field_scores" not in d.columns and "field_scores" not in _plan(d)
    row = d.first()
    assert [(e.code, e.field) for e in row.exceptions][:11] == [
        ("FLD_ZERO_VS_BLANK", "y_amount"), ("FLD_SPECIAL_CHARS", "x_amount"), ("NUM_DECIMAL_MISPLACE", "b_wages"), ("NUM_LARGE_OUTLIER", "a_wages"),
        ("LLM_OVER_NORMALIZATION", "employee_name"), ("LLM_OVER_NORMALIZATION", "employer_name"), ("CY_WRONG_YEAR_UPLOAD", "tax_year"), ("NUM_ROUNDING_VARIANCE", "c_wages"),
        ("FLD_CHECKBOX_BLANK", "is_corrected"), ("FLD_NA_TEXT", "note"), ("FLD_DASH_SYMBOL", "z_amount")]
    assert {(c.code, c.field): c.proposal.number for c in row.classified if c.proposal and c.proposal.number is not None} == {
        ("FLD_ZERO_VS_BLANK", "y_amount"): 0.0, ("FLD_SPECIAL_CHARS", "x_amount"): 5.0, ("FLD_DASH_SYMBOL", "z_amount"): 0.0}


def _both_ways(spark):
    """One set of documents with hits of every kind, validated by lambdas and written out over the layout."""
    from formweave.operators.records import from_columns
    from formweave.plans.validation import validate

    texts = ["0", " 0.00 ", "—", "n/a", "54,23I.00", "(1,250.75)", "unreadable", "", "--", "NONE", "5-", "-", "1-2", "(5", "2e7", None]
    numbers = [1.05, 2e6, 2e7, 1e7, -3.0, 54231.0, 63.15, None]
    rows = []
    for i, text in enumerate(texts * 2):
        n = numbers[i % len(numbers)]
        rows.append((i, text if i % 3 else None, n, text, ["Acme Holdings", "ACME", "O'Brien", None][i % 4], ["12 Elm Ave", "123 Oak St, Springfield, IL 62701 United States", None][i % 3], ["2020", "abcd", "2026.0", None][i % 4],
                     ["123-45-6789", "***-**-6789", " 666-45-6789", None][i % 4], None if i % 2 else True, ["employer_name", "x_amount"] if i % 5 == 0 else None))
    df = spark.createDataFrame(rows, "doc_id int, m string, n double, t string, name string, address string, year string, ssn string, flag boolean, hv array<string>")
    spec = [("wages_tips_compensation", "mixed", F.col("n"), F.col("m")), ("social_security_wages", "num", F.col("n")), ("social_security_tax_withheld", "num", F.col("n")), ("x_amount", "str", F.col("t")), ("note", "str", F.col("t")),
            ("employee_name", "str", F.col("name")), ("employer_name", "str", F.col("name")), ("employee_address", "str", F.col("address")), ("tax_year", "str", F.col("year")), ("employee_ssn", "str", F.col("ssn")),
            ("is_corrected", "bool", F.col("flag")), ("is_tax", "bool", F.col("flag")), ("b_income", "num", F.col("n"))]
    layout = {s[0]: s[1] for s in spec}
    pdf = F.when(F.col("doc_id") % 2 == 0, "digital").otherwise("scanned").alias("pdf_type")
    docs = df.select("doc_id", F.when(F.col("doc_id") % 7 == 0, "1098").otherwise("W-2").alias("form_type"), pdf, "hv", from_columns(spec).alias("fields"))
    return validate(docs, forms=["W-2"]), validate(docs, forms=["W-2"], layout=layout)


def test_rules_over_a_layout_raise_the_same(spark):
    """Rules, split and scores written out over a layout equal those that walk the fields by lambdas, order included."""
    by_lambdas, laid_out = _both_ways(spark)
    want = {r.doc_id: r for r in by_lambdas.collect()}
    got = {r.doc_id: r.asDict(recursive=True) for r in laid_out.collect()}
    assert got == {k: r.asDict(recursive=True) for k, r in want.items()}
    codes = {e.code for r in want.values() for e in r.exceptions}
    assert {"FLD_ZERO_VS_BLANK", "FLD_SPECIAL_CHARS", "NUM_DECIMAL_MISPLACE", "NUM_LARGE_OUTLIER", "LLM_OVER_NORMALIZATION", "CY_WRONG_YEAR_UPLOAD", "NUM_ROUNDING_VARIANCE",
            "FLD_CHECKBOX_BLANK", "FLD_ADDRESS_COLLAPSED", "FLD_NA_TEXT", "FLD_DASH_SYMBOL", "DB_TYPE_CONFLICT", "NUM_SUBTOTAL_MISMATCH"} <= codes


def test_rules_over_a_layout_hold_no_lambdas(spark):
    """What Spark interprets is not in the rules of the W-2 queries; verified fields meet the orders, not the field arrays."""
    from formweave.plans import q_validation as QV
    from formweave.plans.validation import with_exceptions

    docs = I.w2_docs(spark, "/root/testdata/sf0.001")
    assert "lambda" not in _plan(with_exceptions(docs, forms=["W-2"], layout=I.W2_LAYOUT))
    plan = QV.hv_suppress(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, x in enumerate(plan) if "Join" in x]
    assert len(joins) == 2 and not any("employer_tin" in x for x in plan[min(joins):])


def test_scores_leave_out_the_split(spark):
    """Readers of scores do not work out proposals."""
    from formweave.plans import q_text, q_validation, q_views

    for run in (q_validation.QUERIES["doc_scores"], q_text.QUERIES["export_records"], q_views.QUERIES["field_quality"], q_views.QUERIES["exception_board"], q_views.QUERIES["batch_summary"]):
        assert "proposal" not in run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_numbers_behind_junk(spark):
    """The cheap test in front of the lenient number lets every number through."""
    cases = {"$ -5": -5.0, "USD-1,250.75 net": -1250.75, "a-b5": -5.0, "-": 0.0, "x-": None, "5\n": 5.0, "12\n34": 1234.0, "5-\n": None, "--5": None, "-x-5": None, "(-5)": 5.0, ".5 %": 0.5, "5..": None, "123-45-6789": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", S.lenient_number(F.col("t")).alias("d"))
    assert {r.t: r.d for r in rows.collect()} == cases


def _typed(spark):
    """The cases of ``_both_ways`` as typed columns, and as documents of an array."""
    from formweave.operators.records import from_columns

    texts = ["0", " 0.00 ", "—", "n/a", "54,23I.00", "(1,250.75)", "unreadable", "", "--", "NONE", "5-", "-", "1-2", "(5", "2e7", None]
    numbers = [1.05, 2e6, 2e7, 1e7, -3.0, 54231.0, 63.15, None]
    rows = []
    for i, text in enumerate(texts * 3):
        n = numbers[i % len(numbers)]
        rows.append((i, text if i % 3 else None, n, n if i % 4 else 170000.0, text, ["Acme Holdings", "ACME", "O'Brien", "  ", None][i % 5], ["12 Elm Ave", "123 Oak St, Springfield, IL 62701 United States", None][i % 3], ["2020", "abcd", "2026.0", None][i % 4],
                     ["123-45-6789", "***-**-6789", " 666-45-6789", None][i % 4], None if i % 2 else True, ["employer_name", "x_amount", "employee_ssn", "employer_tin"] if i % 5 == 0 else [] if i % 5 == 1 else None,
                     [None, "digital", "scanned"][i % 3], ["W-2", "W-2", "1098", None][i % 4]))
    rows += [(100, *[None] * 10, "scanned", form) for form in ("W-2", "1098")]
    df = spark.createDataFrame(rows, "doc_id int, m string, n double, w double, t string, name string, address string, year string, ssn string, flag boolean, hv array<string>, pdf_type string, form_type string")
    spec = [("wages_tips_compensation", "mixed", F.col("n"), F.col("m")), ("social_security_wages", "num", F.col("w")), ("social_security_tax_withheld", "num", F.col("n")), ("medicare_tax_withheld", "num", F.col("n")), ("x_amount", "str", F.col("t")),
            ("note", "str", F.col("t")), ("employee_name", "str", F.col("name")), ("employer_name", "str", F.col("name")), ("employee_address", "str", F.col("address")), ("tax_year", "str", F.col("year")), ("employee_ssn", "str", F.col("ssn")),
            ("is_corrected", "bool", F.col("flag")), ("is_tax", "bool", F.col("flag")), ("b_income", "num", F.col("n"))]
    return df, spec, df.select("doc_id", "form_type", "pdf_type", "hv", from_columns(spec).alias("fields"))


def test_verdicts_from_flags(spark):
    """flags of rules give the counts, the sizes of the split and the scores of the arrays, also for verified fields and other forms; no lambdas."""
    from formweave.plans import q_validation as QV
    from formweave.plans.validation import validate, verdicts

    df, spec, docs = _typed(spark)
    for d, full in ((df, docs), (df.drop("hv"), docs.drop("hv"))):
        got = verdicts(d, spec, ["W-2"])
        want = validate(full, forms=["W-2"])
        assert dict(got.dtypes).items() <= dict(want.dtypes).items()
        rows = sorted(tuple(r) for r in want.select(got.columns).collect() if r.form_type is not None)
        assert sorted(tuple(r) for r in got.collect() if r.form_type is not None) == rows
        assert sorted(map(str, got.where("form_type is null").collect())) == sorted(map(str, want.where("form_type is null").select(got.columns).collect()))
        assert len({r[10] for r in rows}) > 1 and any(r[8] for r in rows) and any(r[9] for r in rows)
    plan = QV.full_validation(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "lenient" not in plan


def test_verdicts_of_rules_that_are_no_flags(spark):
    """rules of users and fields that may be left out go by the arrays."""
    from formweave.operators.rules_forms import clear_rules, register_rule
    from formweave.plans.validation import validate, verdicts

    df, spec, docs = _typed(spark)
    register_rule("W-2", "NUM_NEGATIVE_VALUE", "b_income", lambda r: r.num("b_income") > 5)
    try:
        got = verdicts(df, spec, ["W-2"])
        assert sorted(map(str, got.collect())) == sorted(map(str, validate(docs, forms=["W-2"]).select(got.columns).collect()))
    finally:
        clear_rules()
    left_out = [*spec[:-1], ("b_income", "optional", F.col("n") > 5, "num", F.col("n"))]
    assert verdicts(df, left_out, ["W-2"]).count() == df.count()


def test_hints_from_flags(spark):
    """review items per hint are sums over flags, the same as over the classified arrays, and nothing is exploded per document."""
    from formweave.operators import classify as C
    from formweave.plans import q_validation as QV
    from formweave.plans.validation import review_hints, with_classified

    df, spec, docs = _typed(spark)
    c = with_classified(docs, forms=["W-2"]).select(F.explode(C.in_bucket(F.col("classified"), "review")).alias("c")).select("c.code", "c.edit_hint")
    want = sorted(tuple(r) for r in c.groupBy("code", "edit_hint").agg(F.count("*").alias("n")).collect())
    got = review_hints(df, spec, ["W-2"])
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 5
    assert review_hints(df.where("doc_id < 0"), spec, ["W-2"]).count() == 0
    assert "lambda" not in QV.edit_hints(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
