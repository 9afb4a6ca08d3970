"""Payload flattening, conforming, names and exports."""

import json

from pyspark.sql import functions as F

from formweave.operators import conform as CF
from formweave.operators import flatten as FL
from formweave.plans.validation import validate_payloads
from formweave.sources import readers, sinks, templates

W2 = {
    "form": "W-2", "year": 2025, "confidence": 0.96,
    "employee_information": {"employee_ssn": "123-45-6789", "employee_first_name": "John", "employee_last_name": "Smith", "suffix": None, "employee_address": "123 Oak Street", "employee_city": "New York", "employee_state": "NY", "employee_zip": "10001"},
    "employer_information": {"employer_tin": "12-3456789", "employer_name": "ABC Corporation", "employer_address": "100 Business Blvd", "employer_city": "New York", "employer_state": "NY", "employer_zip": "10005", "control_number": "001"},
    "wage_information": {"box_1_wages_tips_other_compensation": 75000.0, "box_2_federal_income_tax_withheld": 12500.0, "box_3_social_security_wages": 75000.0, "box_4_social_security_tax_withheld": 4650.0, "box_5_medicare_wages_and_tips": 75000.0, "box_6_medicare_tax_withheld": 1087.5, "box_7_social_security_tips": 0.0, "box_8_allocated_tips": None, "box_9": None, "box_10_dependent_care_benefits": None, "box_11_nonqualified_plans": None},
    "box_12": {"12a": None, "12b": None, "12c": None, "12d": None},
    "box_13_checkboxes": {"statutory_employee": False, "retirement_plan": True, "third_party_sick_pay": False},
    "box_14": {"other": None, "occupation_code": None},
    "state_income_tax_info": {"state_income_tax_withheld": 2500.0, "state_wages": 75000.0, "state_code": "NY"},
    "extraction_metadata": {"extracted_at": "2025-12-15T10:30:00Z", "source": "ocr_engine", "field_confidence_scores": {"ssn": 0.99, "ein": 0.98, "box_1": 0.95, "box_2": 0.96, "box_5": 0.97, "employee_name": 0.93}, "missing_fields": [], "ambiguous_fields": [], "page_quality": 0.96},
}


def payloads(spark, *objs, form="W-2"):
    return spark.createDataFrame([(i, form, "digital", json.dumps(o)) for i, o in enumerate(objs)], "doc_id int, form_type string, pdf_type string, payload string")


def flat(df):
    return {r["doc_id"]: [(f["field"], f["kind"], f["s"], f["d"], f["b"]) for f in r["fields"]] for r in df.select("doc_id", "fields").collect()}


def test_sample_w2(spark):
    v = validate_payloads(payloads(spark, W2), keep_metadata=True).first()
    names = [f["field"] for f in v["fields"]]
    assert len(names) == len(set(names)) == 52
    assert sum(f["kind"] == "null" for f in v["fields"]) == 11
    codes = [(e["code"], e["field"]) for e in v["exceptions"]]
    # the company name keeps its capitals inside, so only the person's names count as title-cased
    assert sorted(codes) == [("LLM_OVER_NORMALIZATION", f) for f in ("employee_first_name", "employee_last_name", "employee_name")]
    assert [(c["bucket"], c["proposal"]["text"]) for c in v["classified"]] == [("fixable", "JOHN SMITH"), ("fixable", "JOHN"), ("fixable", "SMITH")]
    assert v["confidence"] == "MEDIUM" and v["document_confidence"] == 0.907 and v["needs_review"] and len(v["review_fields"]) == 11


def test_order_coercion_and_lists(spark):
    obj = {"a": {"box_1_x": "1,234.50", "zip": "01234", "s": "abc"}, "rows": [{"box_2_v": 1}, {"v": "2", "in": {"w": True}}], "list": [1, "b"], "empty": [], "payer_ein": "12-3456789", "x": 5, "n": None, "obj": {}, "box_9": "q"}
    got = flat(FL.flatten_payload(payloads(spark, obj)))[0]
    assert got == [
        ("x", "num", "5", 5.0, None), ("zip", "num", "1234.0", 1234.0, None), ("s", "str", "abc", None, None),
        ("rows_0_v", "num", "1", 1.0, None), ("rows_1_v", "num", "2.0", 2.0, None), ("rows_1_w", "bool", "True", None, True),
        ("list", "list", '[1,"b"]', None, None), ("empty", "list", "[]", None, None), ("n", "null", None, None, None),
        ("box_9", "str", "q", None, None), ("payer_tin", "str", "12-3456789", None, None)]
    strict = dict((f[0], f[1:3]) for f in flat(FL.flatten_payload(payloads(spark, obj), strict_ids=True))[0])
    assert strict["zip"] == ("str", "01234")


def test_flat_input_is_unchanged(spark):
    obj = {"a": 1.5, "b": "x y", "c": None, "d": False}
    again = {k: (v if v is not None else None) for k, v in obj.items()}
    assert flat(FL.flatten_payload(payloads(spark, obj))) == flat(FL.flatten_payload(payloads(spark, again)))
    assert [f[0] for f in flat(FL.flatten_payload(payloads(spark, obj)))[0]] == list(obj)


def test_bad_payloads(spark):
    d = spark.createDataFrame([(0, "W-2", "not json"), (1, "W-2", None), (2, "W-2", "[]"), (3, "W-2", "{}")], "doc_id int, form_type string, payload string")
    v = {r["doc_id"]: r for r in validate_payloads(d).collect()}
    assert all(v[i]["confidence"] == "LOW" and v[i]["n_total"] == 1 for i in range(4))


def test_names(spark):
    objs = [{"a": {"employer_name": "Firm", "x": {"taxpayer_first_name": "Al", "taxpayer_last_name": "Bo"}}, "b": {"client_name": "Later"}}, {"x": {"note": ""}}, {"employee_first_name": "A", "employee_last_name": "B", "z": {"name": "C"}}]
    n = FL.with_nodes(payloads(spark, *objs))
    got = {r[0]: r[1] for r in n.select("doc_id", FL.find_name(F.col("nodes"))).collect()}
    assert got == {0: "Firm", 1: None, 2: "A B"}


def test_templates_and_conform(spark, tmp_path):
    t = {"form": "W-2", "year": 2026, "info": {"employee_ssn": None, "payer_tin": None, "flag": False, "amount": 0.0}, "rows": [{"n": 1, "when": "date"}]}
    (tmp_path / "W-2.json").write_text(json.dumps(t))
    (tmp_path / "K-1 (1065).json").write_text("{}")
    ts = templates.read_templates(spark, str(tmp_path))
    assert [r[0] for r in templates.available_forms(ts).collect()] == ["K-1 (1065)", "W-2"]
    assert templates.load_template(ts, "w-2") == t
    assert CF.typed_template(t) == {"form": "verbatim-string", "year": "integer", "info": {"employee_ssn": "verbatim-string", "payer_tin": "verbatim-string", "flag": "boolean", "amount": "number"}, "rows": [{"n": "integer", "when": "date"}]}
    dim = {(r["path"], r["leaf_type"], r["is_list"]) for r in templates.template_dim(spark, {"W-2": t}).collect()}
    assert ("info.amount", "number", False) in dim and ("rows.n", "integer", True) in dim
    p = payloads(spark, {"info": {"employee_ssn": "123456789", "payer_tin": "123456789", "amount": "oops", "flag": True}, "rows": [{"n": 2, "when": "2026-01-05"}], "extra": 1})
    r = CF.conform(p, t).first()
    assert r["data"]["info"]["employee_ssn"] == "123-45-6789" and r["data"]["info"]["payer_tin"] == "12-3456789"
    assert r["data"]["info"]["amount"] is None and r["data"]["info"]["flag"] and r["data"]["rows"][0]["n"] == 2 and r["extra_keys"] == ["extra"]


def test_uploads_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.PDF").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "in" / "b.pdf").write_bytes(b"junk")
    (tmp_path / "in" / "c.exe").write_bytes(b"MZ")
    up = {r["filename"]: r["is_corrupted"] for r in readers.read_uploads(spark, str(tmp_path / "in")).collect()}
    assert up == {"a.PDF": False, "b.pdf": True}
    fl = FL.flatten_payload(payloads(spark, {"a": 1, "b": "x"}))
    sinks.write_csv(fl, ["a", "b"], str(tmp_path / "csv"), "doc_id")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()[0].asDict() == {"doc_id": "0", "a": "1", "b": "x"}


def test_patch_paths(spark):
    from formweave.operators.fixes import patch_paths

    leaves = FL.dotted_leaves(payloads(spark, {"w": {"box_1_wages": 5}, "list": [{"wages": 6}], "z": 1}), "payload", "doc_id")
    fixes = spark.createDataFrame([(0, 1, "wages", "7"), (0, 2, "wages", "8")], "doc_id int, seq int, field string, new_value string")
    got = {r["path"]: (r["new_raw"], r["patched"]) for r in patch_paths(leaves, fixes).collect()}
    assert got == {"w.box_1_wages": ("8", True), "list.0.wages": ("8", True), "z": ("1", False)}


def test_apply_to_records(spark):
    from formweave.operators.fixes import apply_to_records

    d = FL.flatten_payload(payloads(spark, {"a_amount": "x", "b": 1, "c": "keep"}, {"b": 2}))
    fixes = spark.createDataFrame([(0, 1, "a_amount", "$1,000"), (0, 2, "b", "5"), (0, 3, "b", " (7.5) "), (0, 4, "new", "yes"), (0, 5, "c", "n/a"), (0, 6, "", "z")], "doc_id int, seq int, field string, new_value string")
    got = flat(apply_to_records(d, fixes))
    assert got[0] == [("a_amount", "num", "1000.0", 1000.0, None), ("b", "num", "7.5", 7.5, None), ("c", "null", None, None, None), ("new", "bool", "True", None, True)]
    assert got[1] == [("b", "num", "2", 2.0, None)]
    assert list(flat(apply_to_records(d, fixes, only_touched=True))) == [0]


def test_writers(spark, tmp_path):
    from formweave.operators import ledger as L
    from formweave.operators.export import safe_projection

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text(json.dumps({"a": 1}))
    got = readers.read_extractions(spark, str(tmp_path / "in")).first()
    assert got["source"] == "x.json" and json.loads(got["payload"]) == {"a": 1}
    rows = [("DOC-1", "f.pdf", "W-2", "s", "ui", "2026-01-01 00:00:00", 1, "old"), ("DOC-1", "f.pdf", "W-2", "s", "ui", "2026-01-02 00:00:00", 2, "new"), (None, "My File.pdf", "1040", "s", "ui", "2026-01-01 00:00:00", 3, "p")]
    d = spark.createDataFrame(rows, "document_id string, filename string, form_type string, session_id string, source string, t string, seq int, payload string").withColumn("ts", F.col("t").cast("timestamp"))
    sinks.write_snapshots(d, str(tmp_path / "snap"))
    snap = {r["storage_key"]: r["payload"] for r in spark.read.json(str(tmp_path / "snap")).collect()}
    assert snap == {"doc-1": "new", "my_file": "p"}
    sub = d.select(F.lit("Ann").alias("client_name"), F.col("form_type").alias("document_type"), F.lit(2025).alias("tax_year"), "ts", F.col("seq").cast("bigint").alias("seq"))
    log = L.document_log(L.history(L.prepare(sub))).drop("at", "sig")
    for _ in range(2):
        sinks.append_log(log, str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.count() == 2 * log.count() and back.where("form_type = '1040'").count() == 2
    assert "raw_text" not in safe_projection(d.withColumn("raw_text", F.lit("x"))).columns


def test_seed_is_idempotent(spark):
    seed = spark.createDataFrame([("state", "NY"), ("state", "CA"), ("state", "CA")], "enum_type string, code string")
    have = spark.createDataFrame([("state", "NY")], "enum_type string, code string")
    new = readers.seed_dimension(have, seed)
    assert [r["code"] for r in new.collect()] == ["CA"]
    assert readers.seed_dimension(have.unionByName(new), seed).count() == 0


def _leaves(data, prefix=""):
    """The flattening rule written out: (field, value) pairs in order, later values overwrite."""
    import re

    out = {}

    def walk(x, prefix):
        for i, v in enumerate(x) if isinstance(x, list) else ():
            walk(v, f"item_{i}_")
        for k, v in x.items() if isinstance(x, dict) else ():
            bare = re.sub(r"^box_[0-9A-Za-z]+$", "", re.sub(r"^box_[0-9A-Za-z]+_", "", k)) if k.startswith("box_") else k
            name = prefix + (bare or k)
            if isinstance(v, dict):
                walk(v, prefix)
            elif isinstance(v, list) and v and isinstance(v[0], dict):
                for i, y in enumerate(v):
                    walk(y, f"{name}_{i}_")
            else:
                out[name] = v

    walk(data, prefix)
    return list(out)


def test_odd_payloads(spark):
    import json

    deep = '"v"'
    for i in range(12):
        deep = f'{{"k{i}":{deep}}}'
    texts = [
        '{"a":"1x","b":{"c":1,"c":2},"d":true}', '{"m":[{"a":2},3],"z":"q"}', '[{"a":1,"b":{"c":"x"}},5,{"a":"y"}]', deep,
        json.dumps({"rows": [{"v": i} for i in range(10050)]}), '{"a":{"x":1},"a":{"y":"{[\\"{"},"b":[1,{"c":2}]}', '{"k":"a","b":1,"k":"c"}', "{}", "[]", None, "not json",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, payload string")
    got = {r.doc_id: r.fields for r in FL.flatten_payload(df).collect()}
    for i, t in enumerate(texts):
        try:
            want = _leaves(json.loads(t)) if t else []
        except ValueError:
            want = []
        assert [f.field for f in got[i]] == want, t
    assert {f.field: f.s for f in got[0]} == {"a": "1x", "c": "2", "d": "True"}
    assert {f.field: f.s for f in got[6]} == {"k": "c", "b": "1"}
    nodes = {r.doc_id: r.nodes for r in FL.with_nodes(df, lists_of_scalars=True).collect()}
    assert len({n.group for n in nodes[4]}) == 10050 and [n.group for n in nodes[4]] == sorted(n.group for n in nodes[4])


def _random_payloads(rng, n):
    keys = ["a", "wages", "box_1_wages", "box_2", 'q"\\x', "é", "c.d"]

    def value(depth):
        r = rng.random()
        if depth and r < 0.35:
            return {rng.choice(keys) + str(rng.randint(0, 1)) * rng.randint(0, 1): value(depth - 1) for _ in range(rng.randint(0, 4))}
        if depth and r < 0.6:
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        return rng.choice([1, 2.5, True, None, "x", 'a"b\\', "1,200", "", "ü{[", "\n\t/"])

    return [json.dumps({f"k{i}": value(5) for i in range(3)} | {"wages": value(2)}, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for _ in range(n)]


def test_stack_and_levels_agree(spark):
    """Opening levels one by one and walking the tokens give the same leaves; both of repeated keys too."""
    import random

    texts = _random_payloads(random.Random(3), 25) + [
        '{"a":{"x":{"y":1}},"b":2,"a":{"x":{"z":[1, {"c":2}]},"w":{"u":1,"u":{"s":3},"t":0}},"b":{"l":[{"p":1,"p":2},{"p":3}]}}', '[{"a":[[1],{"b":2}]},5]']
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, payload string")
    for scalars in (False, True):
        shown = lambda levels, scalars=scalars: {r.doc_id: [(n.path, n.prefix, n.key, n.field, n.raw, n.kind) for n in r.nodes] for r in FL.with_nodes(df, lists_of_scalars=scalars, levels=levels).collect()}
        assert shown(7) == shown(1)


def test_deep_and_broken_payloads(spark):
    """Texts of a thousand brackets, JSON or not, neither end the engine nor change the plan; what is no JSON fails its own document."""
    deep = '{"a":' * 900 + '{"b":"7","box_1_c":[1]}' + "}" * 900
    texts = [deep, "[" * 1000, '{"a":' * 1000, deep[:-1], deep + "x", '{"a":1}', "[" * 900 + "]" * 900, deep.replace("7", '"'), None, " ", "5"]
    df = spark.createDataFrame([(i, "W-2", t) for i, t in enumerate(texts)], "doc_id int, form_type string, payload string").repartition(3)
    got = {r.doc_id: [(f.field, f.s) for f in r.fields] for r in FL.flatten_payload(df).select("doc_id", "fields").collect()}
    assert got[0] == [("b", "7.0"), ("c", "[1]")] and got[5] == [("a", "1")] and not any(got[i] for i in range(11) if i not in (0, 5))
    codes = {r.doc_id: [e.code for e in r.exceptions] for r in validate_payloads(df).collect()}
    assert {i for i, c in codes.items() if "DB_JSON_FLATTEN_FAIL" in c} == {1, 2, 3, 4, 7}
    assert all(codes[i] == ["FLD_ZERO_VS_BLANK"] for i in (6, 8, 9, 10))
    nodes = lambda d: str(FL.flatten_payload(d)._jdf.queryExecution().optimizedPlan().toString()).count("\n")
    assert nodes(df) == nodes(df.where("doc_id = 5")) - nodes(df.where("doc_id = 5").where("true")) + nodes(df.where("doc_id = 0"))


def test_patch_payload(spark):
    import copy
    import random
    import re

    from formweave.operators.fixes import patch_payload

    def bare(k):
        return (re.sub("^box_[0-9A-Za-z]+$", "", re.sub("^box_[0-9A-Za-z]+_", "", k)) or k) if k.startswith("box_") else k

    def put(x, fixes):
        if isinstance(x, dict):
            for k in x:
                mine = [v for f, v in fixes if f in (k, bare(k))]
                x[k] = mine[-1] if mine else put(x[k], fixes)
        return [put(y, fixes) for y in x] if isinstance(x, list) else x

    rng = random.Random(8)
    texts = [*_random_payloads(rng, 60), '{"wages":{"wages":1,"b":{"c":2}},"box_9_wages":[1,{"a":2}],"z":3}', "{}", "[1]", '[{"a":1}]', "not json", None,
             '{"a":' * 500 + '{"wages":1}' + "}" * 500]
    rows, fixes = [], {}
    for i, t in enumerate(texts):
        fixes[i] = [(rng.choice(["a", "wages", "box_1_wages", "box_2", "c.d", "nowhere", "é"]), rng.choice(['x"\\y', "", None, "12", "ü"])) for _ in range(rng.randint(0, 4))]
        rows += [(i, s, f, v) for s, (f, v) in enumerate(fixes[i])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, payload string")
    fx = spark.createDataFrame([*rows, (0, 99, "", "none")], "doc_id int, seq int, field string, new_value string")
    got = {r.doc_id: r.payload for r in patch_payload(df, fx).collect()}
    for i, t in enumerate(texts):
        try:
            data = json.loads(t) if t else {}
        except ValueError:
            assert got[i] == t
            continue
        want = put(copy.deepcopy(data), fixes[i]) if isinstance(data, dict) else data
        assert json.dumps(json.loads(got[i])) == json.dumps(want), (t, fixes[i])
    touched = {i for i in fixes if fixes[i]}
    assert {r.doc_id for r in patch_payload(df, fx, only_touched=True).collect()} == touched | {0}
