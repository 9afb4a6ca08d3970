"""Registered queries: text gate, segmentation, layout, flatten, conform, export."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import scalar as S
from ..operators import conform as CF
from ..operators import export as EX
from ..operators import flatten as FL
from ..operators import layout as LY
from ..operators import shapes as SH
from ..operators import text as T
from . import inputs as I
from . import q_validation as QV
from .validation import validate

QUERIES: dict = {}
ORACLE: dict = {}


def _add(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        ORACLE[name] = sql


def _d(s, d, sql, *t):
    return I.derive(s, d, sql, *t)


# --- gate ------------------------------------------------------------------------------------------------------
GATE_SQL = """select doc_id, concat(case when doc_id % 7 = 0 then 'OMB No. 1545-0008 ' when doc_id % 7 = 1 then 'ref 1545-00089 ' else '' end,
 case doc_id % 11 when 0 then 'Form W-2 Wage and Tax Statement ' when 1 then 'FORM 1099 - NEC ' when 2 then 'schedule se ' when 3 then 'x1040y ' when 4 then 'w 2g ' else '' end,
 case when doc_id % 5 = 0 then 'Department of the  Treasury ' when doc_id % 5 = 1 then 'U.S. Treasury ' else '' end, case when doc_id % 4 = 0 then '2024 ' when doc_id % 4 = 1 then '1989 ' else '' end,
 case when doc_id % 6 = 0 then 'Wages, employer EIN, box 12a, taxable ' else '' end, text) as text from {documents}"""


def _gate_sql(base, key="doc_id", text="text"):
    esc = lambda p: p.replace("'", "''")
    raw = text
    # word boundaries are ASCII-only in this engine: accented letters become another word character first
    text = f"regexp_replace({raw}, '[À-ÖØ-öø-ɏ]', '_', 'g')"
    return f"""g0 as (select {key}, length(trim({text}, E' \\t\\n\\r')) as len, nullif(regexp_extract({text}, '{esc(V.OMB_PATTERN)}', 1), '') as omb, upper(nullif(regexp_extract({text}, '{esc(V.FORM_PATTERN)}', 1), '')) as form,
 regexp_matches({text}, '{esc(V.AGENCY_PATTERN)}') as agency, try_cast(nullif(regexp_extract({text}, '{esc(V.YEAR_PATTERN)}', 1), '') as int) as yr, len(regexp_extract_all({text}, '{esc(V.KEYWORD_PATTERN)}')) as kw from {base}),
 g1 as (select *, case when len < 10 then 0 else case when omb is not null then 40 else 0 end + case when form is not null then 25 else 0 end + case when agency then 20 else 0 end + case when yr is not null then 10 else 0 end + case when kw >= 3 then 5 else 0 end end as score from g0)"""


_add("gate_score", lambda s, d: T.gate(I.derive_documents(s, d, GATE_SQL, "documents")).select("doc_id", "score", "is_tax_form", "form_type", "tax_year", "omb_number", F.array_join("signals_found", "; ").alias("signals"), "rejection_reason"),
     f"""with b as ({I.plain(GATE_SQL, 'documents')}), {_gate_sql('b')} select doc_id, score, score >= 30 as is_tax_form, case when len >= 10 then form end as form_type, case when len >= 10 then yr end as tax_year, case when len >= 10 then omb end as omb_number,
 case when len < 10 then '' else concat_ws('; ', 'OMB: ' || omb, 'Form: ' || form, case when agency then 'IRS Agency identified' end, 'Year: ' || yr, case when kw >= 3 then 'IRS Keywords (' || kw || ')' end) end as signals,
 case when len < 10 then 'Insufficient text extracted to identify document.' when score < 30 then 'Document recognition confidence too low.' end as rejection_reason from g1""")
_add("gate_envelope", lambda s, d: T.gate_envelope(T.gate(I.derive_documents(s, d, GATE_SQL, "documents"))).groupBy("accepted", "note").agg(F.count("*").alias("n")),
     f"with b as ({I.plain(GATE_SQL, 'documents')}), {_gate_sql('b')} select score >= 30 as accepted, case when score < 30 then 'score ' || score || ' below 30' end as note, count(*) as n from g1 group by 1, 2")
_add("gate_plain_documents", lambda s, d: T.gate(I.table(s, d, "documents").select("doc_id", "text")).groupBy("score").agg(F.count("*").alias("n")),
     f"with {_gate_sql('documents')} select score, count(*) as n from g1 group by 1")

# whole turns as pages, and between them blank and short pages that a match may run across; some documents are short as a whole
PAGE_SQL = """select conv_id as doc_id, cast(turn * 3 as int) as page, concat(case when (conv_id + turn) % 3 = 0 then 'OMB No. 1545-0074 ' else '' end, case when (conv_id + turn) % 5 = 1 then 'Form 1040 2025 ' else '' end,
 text, case when (conv_id + turn) % 8 = 1 then ' internal ' when (conv_id + turn) % 8 = 5 then ' Form W-' else '' end) as text from {conversations}
 union all select conv_id, cast(turn * 3 + 1 as int), case (conv_id + turn) % 8 when 0 then '  ' when 1 then ' ' when 2 then 'Department of the' when 3 then 'U.S.' when 4 then 'social' when 5 then ' ' when 6 then 'box' else 'W' end from {conversations} where turn % 2 = 0
 union all select conv_id, cast(turn * 3 + 2 as int), case (conv_id + turn) % 8 when 1 then 'revenue service' when 2 then 'Treasury 2024' when 3 then 'treasury' when 4 then 'security' when 5 then '2 wage' when 6 then '12a' when 7 then '-' else 'employee' end from {conversations} where turn % 2 = 0
 union all select conv_id + 1000000000, 0, case when conv_id % 2 = 0 then 'short page' else 'Form W-2 employer' end from {conversations} where turn = 0"""
_PG = f"pg as ({I.plain(PAGE_SQL, 'conversations')})"
pages = lambda s, d: _d(s, d, PAGE_SQL, "conversations")
_add("gate_pages", lambda s, d: T.gate_pages(pages(s, d)).select("doc_id", "score", "is_tax_form", "form_type", "tax_year", "omb_number", "gate_pdf_type", "route", "page_count"),
     f"""with {_PG}, dt as (select doc_id, string_agg(text, chr(10) order by page) as text, sum(length(trim(text, E' \\t\\n\\r'))) as tl, arg_min(length(trim(text, E' \\t\\n\\r')), page) as fl, count(*) as page_count from pg group by 1), {_gate_sql('dt')}
 select g1.doc_id, case when tl < 50 then -1 else score end as score, tl < 50 or score >= 30 as is_tax_form, case when tl >= 50 then form end as form_type, case when tl >= 50 then yr end as tax_year, case when tl >= 50 then omb end as omb_number, case when tl < 50 then 'scanned' else 'digital' end as gate_pdf_type,
 case when fl > 50 then 'digital' else 'scanned' end as route, page_count from g1 join dt on dt.doc_id = g1.doc_id""")
_add("form_segments", lambda s, d: T.form_segments(pages(s, d)),
     f"""with {_PG}, st as (select doc_id, page from pg where page = 0 or regexp_matches(text, '(?i)OMB\\s*No\\.?\\s*[0-9-]+')), lp as (select doc_id, max(page) as mx from pg group by 1)
 select st.doc_id, page as start_page, coalesce(lead(page) over (partition by st.doc_id order by page) - 1, mx) as end_page from st join lp on lp.doc_id = st.doc_id""")
_add("page_counts", lambda s, d: T.page_counts(_d(s, d, "select doc_id from {documents}", "documents"), pages(s, d)),
     f"with {_PG} select d.doc_id, coalesce(n, 1) as page_count from documents d left join (select doc_id, count(*) as n from pg group by 1) p on p.doc_id = d.doc_id")

# --- word boxes ------------------------------------------------------------------------------------------------------
BOX_SQL = "select l_orderkey as doc_id, cast(l_linenumber % 2 + 1 as int) as page, concat('w', cast(l_partkey as varchar(12))) as text, cast(l_quantity * 10 as double) + l_suppkey % 10 * 0.5 as x0, cast(l_linenumber * 7 + l_partkey % 5 + l_suppkey % 3 * 0.5 as double) as y0, cast(0.6 + (l_partkey % 40) * 0.01 as double) as confidence from {lineitem}"
boxes = lambda s, d: _d(s, d, BOX_SQL, "lineitem")


def _fold_sql(tol, keys, cell):
    k = ", ".join(keys)
    return f"""bx as ({I.plain(BOX_SQL, 'lineitem')}), ty as (select {k}, list(y0 order by y0) as ys from (select distinct {k}, y0 from bx) z group by {k}),
 an as (select {k}, list_reduce(ys, lambda acc, y: case when y - acc[-1] > {tol} then list_append(acc, y) else acc end, list_value(ys[1])) as anchors from (select {k}, list_transform(ys, lambda v: v) as ys from ty) q),
 ln as (select bx.*, list_max(list_filter(anchors, lambda a: a <= y0)) as anchor, anchors from bx join an using ({k})),
 tx as (select {k}, list_position(anchors, anchor) as line, string_agg({cell}, '  ' order by x0, y0, {cell}) as line_text from ln group by {k}, anchors, anchor)"""


def _rec_fold_sql(tol, cell):
    return f"""bx as ({I.plain(BOX_SQL, 'lineitem')}), ty as (select doc_id, page, y0, row_number() over (partition by doc_id, page order by y0) as rn from (select distinct doc_id, page, y0 from bx) z),
 fo(doc_id, page, rn, y0, anchor, line) as (select doc_id, page, rn, y0, y0, 1 from ty where rn = 1 union all select t.doc_id, t.page, t.rn, t.y0, case when t.y0 - f.anchor > {tol} then t.y0 else f.anchor end, case when t.y0 - f.anchor > {tol} then f.line + 1 else f.line end from fo f join ty t on t.doc_id = f.doc_id and t.page = f.page and t.rn = f.rn + 1),
 tx as (select bx.doc_id, bx.page, fo.line, string_agg({cell}, '  ' order by bx.x0, bx.y0, {cell}) as line_text from bx join fo on fo.doc_id = bx.doc_id and fo.page = bx.page and fo.y0 = bx.y0 group by 1, 2, 3)"""


_add("row_fold_ocr", lambda s, d: LY.ocr_lines(boxes(s, d)), f"with recursive {_rec_fold_sql(8, 'text')} select * from tx")
_add("row_fold_digital", lambda s, d: LY.digital_lines(boxes(s, d)), f"with recursive {_rec_fold_sql(5, chr(39) + '[' + chr(39) + ' || cast(round_even(x0, 0) as bigint) || ' + chr(39) + '] ' + chr(39) + ' || text')} select * from tx")
_PGS = "select o_orderkey as doc_id, p as page from {orders}"
_add("ocr_page_text", lambda s, d: LY.ocr_page_text(boxes(s, d), _d(s, d, "select o_orderkey as doc_id, explode(sequence(1, 3)) as page from {orders}", "orders")),
     f"""with recursive {_rec_fold_sql(8, 'text')}, pt as (select doc_id, page, string_agg(line_text, chr(10) order by line) as t from tx group by 1, 2), pl as (select o_orderkey as doc_id, cast(p as int) as page from orders cross join range(1, 4) r(p))
 select pl.doc_id, pl.page, '[Page ' || pl.page || ' of 3' || case when t is null then ' — no text detected]' else ']' || chr(10) || t end as page_text from pl left join pt using (doc_id, page)""")
_add("page_confidence", lambda s, d: T.ocr_confidence(boxes(s, d), _d(s, d, "select o_orderkey as doc_id, explode(sequence(1, 2)) as page from {orders}", "orders")),
     f"""with bx as ({I.plain(BOX_SQL, 'lineitem')}), pl as (select o_orderkey as doc_id, cast(p as int) as page from orders cross join range(1, 3) r(p)), pc as (select doc_id, page, cast(sum(cast(confidence as decimal(18,6))) as double) / count(*) as c, count(*) as n from bx group by 1, 2),
 pp as (select pl.doc_id, pl.page, cast(round(cast(coalesce(c, 0.0) as decimal(18,6)), 3) as double) as c, coalesce(n, 0) as n from pl left join pc using (doc_id, page)), g as (select doc_id, min(c) as min_confidence, cast(sum(cast(c as decimal(18,3))) as double) / count(*) as a, count(*) as page_count, cast(sum(n) as bigint) as word_count from pp group by 1)
 select doc_id, min_confidence, cast(round(cast(a as decimal(18,6)), 3) as double) as avg_confidence, page_count, word_count, a < 0.80 as low_confidence from g""")

# --- payloads -----------------------------------------------------------------------------------------------------------
PAY_SQL = """select o_orderkey as doc_id, concat('{{"form":"W-2","year":', cast(2024 + o_orderkey % 3 as varchar(12)), ',"wage_information":{{"box_1_wages_tips_other_compensation":', cast(cast(o_totalprice as decimal(12,2)) as varchar(20)),
 ',"box_2_federal_income_tax_withheld":"$1,', lpad(cast(o_orderkey % 1000 as varchar(12)), 3, '0'), '.50","box_9":null}},"employee_information":{{"employee_ssn":"', case when o_orderkey % 4 = 0 then '123456789' else '123-45-6789' end, '","employee_first_name":',
 case when o_orderkey % 5 = 0 then 'null' else '"Ann"' end, ',"employee_last_name":', case when o_orderkey % 7 = 0 then '""' else concat('"Lee ', o_orderstatus, '"') end, ',"employee_name":"Old Name"}},"box_12":[{{"code":"D","box_a_amount":', cast(o_orderkey % 90 as varchar(12)), '}},{{"code":"E","amount":"7"}}],"amounts":[1,2],"box_13":{{"retirement_plan":',
 case when o_orderkey % 2 = 0 then 'true' else 'false' end, ',"deep":{{"deeper":{{"note":"', o_orderpriority, '"}}}}}},"payer_ein":"12-3456789","payer_tin":"99-0000000","employer_information":{{"employer_name":"ABC CORP","code":"', cast(o_custkey as varchar(12)), '"}},"extraction_metadata":{{"employer_name":0.9}}}}') as payload from {orders}"""
payloads = lambda s, d: I.dealt_documents(s, d, PAY_SQL, "orders")
_BARE = lambda k: f"case when regexp_replace(regexp_replace({k}, '^box_[0-9A-Za-z]+_', ''), '^box_[0-9A-Za-z]+$', '') = '' then {k} else regexp_replace(regexp_replace({k}, '^box_[0-9A-Za-z]+_', ''), '^box_[0-9A-Za-z]+$', '') end"
_TREE = f"""b as ({I.plain(PAY_SQL, 'orders')}), tr as (select doc_id, j.key, j.type, j.fullkey, j.path, j.id, j.value from b, json_tree(b.payload) j),
 lf as (select *, case when regexp_matches(fullkey, '^\\$\\.box_12\\[') then 'box_12_' || regexp_extract(fullkey, '\\[([0-9]+)\\]', 1) || '_' || ({_BARE('key')}) else {_BARE('key')} end as field from tr
  where fullkey not like '$.extraction_metadata%' and ((type not in ('OBJECT','ARRAY') and path <> '$.amounts') or fullkey = '$.amounts')),
 nm as (select doc_id, nullif(trim(concat_ws(' ', nullif(max(case when key = 'employee_first_name' then value->>'$' end), ''), nullif(max(case when key = 'employee_last_name' then value->>'$' end), ''))), '') as full_name from lf group by 1),
 al as (select lf.doc_id, id + case when field in ('wages_tips_other_compensation', 'payer_ein') then 100000 else 0 end as id, case field when 'wages_tips_other_compensation' then 'wages_tips_compensation' when 'payer_ein' then 'payer_tin' else field end as field,
   case when field = 'employee_name' and full_name is not null then 'VARCHAR' else type end as type, case when field = 'employee_name' and full_name is not null then full_name when type = 'NULL' then null when type = 'ARRAY' then cast(value as varchar) else value->>'$' end as raw from lf join nm using (doc_id)),
 lw as (select *, row_number() over (partition by doc_id, field order by id desc) as rn from al),
 ty as (select doc_id, field, raw, type, type = 'VARCHAR' and regexp_matches(trim(raw), '^\\$?-?[0-9,]+\\.?[0-9]*$') and try_cast(regexp_replace(trim(raw), '[$,]', '', 'g') as double) is not null as co from lw where rn = 1)"""
_add("flatten_payload", lambda s, d: SH.flatten_rows(payloads(s, d), "doc_id").select("doc_id", "field", "kind", F.when(F.col("kind") == "num", F.col("d")).alias("num"), F.when(F.col("kind").isin("str", "list"), F.col("s")).alias("txt"), "b"),
     f"""with {_TREE} select doc_id, field, case when co then 'num' when type = 'NULL' then 'null' when type = 'BOOLEAN' then 'bool' when type = 'VARCHAR' then 'str' when type = 'ARRAY' then 'list' else 'num' end as kind,
 case when co then cast(regexp_replace(trim(raw), '[$,]', '', 'g') as double) when type in ('UBIGINT','BIGINT','DOUBLE') then cast(raw as double) end as num, case when (type = 'VARCHAR' and not co) or type = 'ARRAY' then raw end as txt, case when type = 'BOOLEAN' then raw = 'true' end as b from ty""")
_add("dotted_flatten", lambda s, d: FL.dotted_leaves(payloads(s, d), "payload", "doc_id").select("doc_id", "path", F.when(F.col("kind") != "null", F.col("raw")).alias("raw")),
     f"with {_TREE} select doc_id, regexp_replace(regexp_replace(substr(fullkey, 3), '\\[([0-9]+)\\]', '.\\1', 'g'), '\"', '', 'g') as path, case when type <> 'NULL' then value->>'$' end as raw from tr where type not in ('OBJECT','ARRAY')")
TEMPLATE = {"form": "W-2", "year": 2026, "employee_information": {"employee_ssn": None, "employee_first_name": None}, "wage_information": {"box_1_wages_tips_other_compensation": 0.0, "box_2_federal_income_tax_withheld": 0.0, "box_3_social_security_wages": None},
            "box_12": [{"code": None, "amount": None}], "box_13": {"retirement_plan": False}}
_add("conform_schema", lambda s, d: CF.conform(payloads(s, d), TEMPLATE).select("doc_id", F.col("data.year").alias("year"), F.col("data.employee_information.employee_ssn").alias("ssn"), F.col("data.wage_information.box_1_wages_tips_other_compensation").alias("wages"), F.col("data.wage_information.box_2_federal_income_tax_withheld").alias("withheld"),
                                                                           F.col("data.wage_information.box_3_social_security_wages").alias("missing"), F.col("data.box_13.retirement_plan").alias("plan"), F.array_join(F.transform("data.box_12", lambda x: x["code"]), ",").alias("codes"), F.array_join("extra_keys", ",").alias("extra")),
     f"""with b as ({I.plain(PAY_SQL, 'orders')}) select doc_id, cast(payload->>'$.year' as bigint) as year, regexp_replace(payload->>'$.employee_information.employee_ssn', '^([0-9]{{3}})([0-9]{{2}})([0-9]{{4}})$', '\\1-\\2-\\3') as ssn, cast(payload->>'$.wage_information.box_1_wages_tips_other_compensation' as double) as wages, cast(null as double) as withheld,
 cast(null as varchar) as missing, cast(payload->>'$.box_13.retirement_plan' as boolean) as plan, 'D,E' as codes, 'amounts,payer_ein,payer_tin,employer_information,extraction_metadata' as extra from b""")
_FT = "select p_partkey as id, case p_partkey % 12 when 0 then 'w-2' when 1 then 'W2 wage statement' when 2 then 'k-1' when 3 then 'schedule 1065 k' when 4 then 'form 1099-INT copy b' when 5 then '1098-t' when 6 then 'Form 1098-E 2024' when 7 then '' when 8 then null when 9 then 'ssa-1099 form' when 10 then '1040-SR' else p_name end as raw from {part}"
_FTC = "case " + " ".join(f"when contains(upper(raw), '{f.upper()}') then '{f}'" for f in sorted(V.FORM_TYPES)) + " else upper(raw) end"
_FTE = "case upper(raw) " + " ".join(f"when '{f.upper()}' then '{f}'" for f in V.FORM_TYPES) + " end"
_add("form_type_normalise", lambda s, d: _d(s, d, _FT, "part").select("id", FL.normalise_form_type(F.col("raw")).alias("form_type")),
     f"select id, case when coalesce(raw, '') = '' then null when {_FTE} is not null then {_FTE} when contains(upper(raw), 'K-1') or contains(upper(raw), '1065') then 'K-1 (1065)' when contains(upper(raw), 'W2') or contains(upper(raw), 'W-2') then 'W-2' else {_FTC} end as form_type from ({I.plain(_FT, 'part')}) z")
NAME_SQL = """select c_custkey as doc_id, case c_custkey % 6 when 0 then concat('{{"payer":{{"payer_name":"Bank ', c_mktsegment, '"}},"recipient":{{"recipient_name":" ', c_name, ' "}}}}')
 when 1 then concat('{{"employer_name":"Firm","employee_first_name":"Ann ","employee_last_name":"', c_name, '"}}') when 2 then concat('{{"employer_name":"Firm ', c_mktsegment, '","x":{{"name":"', c_name, '"}}}}')
 when 3 then concat('{{"a":{{"b":{{"taxpayer_name":"', c_name, '","tax_id":"12"}}}},"c":{{"client_name":"Late"}}}}') when 4 then '{{"a":{{"note":"none"}},"list":[{{"name":"In List"}}]}}' else concat('{{"x":{{"payer_tin":"T', cast(c_custkey as varchar(12)), '"}},"name":""}}') end as payload from {customer}"""
_add("find_name", lambda s, d: FL.with_nodes(_d(s, d, NAME_SQL, "customer")).select("doc_id", FL.find_name(F.col("nodes")).alias("name")),
     "select c_custkey as doc_id, case c_custkey % 6 when 0 then 'Bank ' || c_mktsegment when 1 then 'Ann ' || c_name when 2 then 'Firm ' || c_mktsegment when 3 then c_name end as name from customer")
_add("client_identity", lambda s, d: FL.with_nodes(_d(s, d, NAME_SQL, "customer")).select("doc_id", FL.client_identity(F.col("nodes")).alias("i")).select("doc_id", "i.name", "i.tin"),
     "select c_custkey as doc_id, case c_custkey % 6 when 0 then 'Bank ' || c_mktsegment when 1 then 'Firm' when 2 then 'Firm ' || c_mktsegment when 3 then c_name when 4 then 'In List' end as name, case c_custkey % 6 when 3 then '12' when 5 then 'T' || c_custkey end as tin from customer")

# --- names, labels, masks, export ---------------------------------------------------------------------------------------------
_MK = "select o_orderkey as id, case o_orderkey % 5 when 0 then 'employee_ssn' when 1 then 'payer_tin' when 2 then 'claim_number' when 3 then 'box_12a_code_value' else 'other_name' end as k, case o_orderkey % 4 when 0 then '123-45-6789' when 1 then '12-3456789' when 2 then concat('AB', cast(o_custkey as varchar(12))) else '' end as v from {orders}"
_add("mask_values", lambda s, d: _d(s, d, _MK, "orders").select("id", S.mask_value(F.col("v"), F.col("k")).alias("shown"), S.field_label(F.col("k")).alias("label"), S.box_badge(F.col("k")).alias("badge")),
     f"""select id, case when v = '' or k in ('box_12a_code_value', 'other_name') then v when contains(k, 'tin') or (contains(v, '-') and length(v) = 10) then '••-' || right(v, 7) when length(v) >= 9 and length(regexp_replace(v, '[^0-9]', '', 'g')) = 9 then '•••-••-' || right(regexp_replace(v, '[^0-9]', '', 'g'), 4) else '••••' || right(v, 4) end as shown,
 case k when 'employee_ssn' then 'Employee Ssn' when 'payer_tin' then 'Payer Tin' when 'claim_number' then 'Claim Number' when 'box_12a_code_value' then 'Code Value' else 'Other Name' end as label, case when k = 'box_12a_code_value' then 'Box 12a' end as badge from ({I.plain(_MK, 'orders')}) z""")
_SN = "select s_suppkey as id, case s_suppkey % 4 when 0 then concat(' ', s_name, '.PDF ') when 1 then '..__' when 2 then null else concat('W-2 (', s_name, ')/x') end as raw from {supplier}"
_add("safe_name", lambda s, d: _d(s, d, _SN, "supplier").select("id", S.storage_key(F.col("raw")).alias("safe")),
     f"select id, coalesce(nullif(trim(regexp_replace(lower(trim(coalesce(raw, 'unknown'))), '[^\\p{{L}}\\p{{N}}\\-_.]', '_', 'g'), '._'), ''), 'unknown') as safe from ({I.plain(_SN, 'supplier')}) z")
_UPL = "select o_orderkey as id, concat('/in/', cast(o_custkey as varchar(12)), case o_orderkey % 6 when 0 then '.PDF' when 1 then '.png' when 2 then '.exe' when 3 then '.jpeg' when 4 then '' else '.tar.webp' end) as path from {orders}"


def upload_filter(s, d):
    from ..sources.readers import extension

    u = _d(s, d, _UPL, "orders").withColumn("ext", extension(F.col("path")))
    return u.where(F.col("ext").isin(V.UPLOAD_EXTENSIONS)).select("id", "ext")


_add("upload_filter", upload_filter, f"select id, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) as ext from ({I.plain(_UPL, 'orders')}) z where lower(regexp_extract(path, '(\\.[^./]+)$', 1)) in ('.pdf', '.png', '.jpg', '.jpeg', '.webp')")
_SNAP = "select event_id as seq, ts, case when event_id % 5 = 0 then '' when event_id % 5 = 1 then null else concat('DOC-', cast(user_id as varchar(12))) end as document_id, case when event_id % 7 = 0 then null else concat('File ', cast(user_id % 30 as varchar(12)), '.pdf') end as filename, 'W-2' as form_type, case when event_id % 2 = 0 then concat('S', cast(user_id % 9 as varchar(12))) end as session_id, 'ui' as source, props as payload from {events}"
_add("snapshots", lambda s, d: EX.snapshots(_d(s, d, _SNAP, "events")).select("storage_key", "payload", F.col("meta.updated_at").alias("updated_at"), F.col("meta.storage_form_key").alias("form_key")),
     f"""with k as (select *, case when coalesce(document_id, '') <> '' then lower(document_id) when filename is not null then replace(regexp_replace(lower(filename), '\\.[^.]*$', ''), ' ', '_') else coalesce(lower(session_id), 'unknown') end as storage_key from ({I.plain(_SNAP, 'events')}) z),
 r as (select *, row_number() over (partition by storage_key order by ts desc, seq desc) as rn from k) select storage_key, payload, ts as updated_at, 'w-2' as form_key from r where rn = 1""")
_add("csv_row", lambda s, d: EX.csv_columns(I.w2_docs(s, d), ["employee_ssn", "employer_name", "employee_name", "absent"], "doc_id"),
     f"with {QV._W2_BASE} select doc_id, ssn_s as employee_ssn, employer_s as employer_name, employee_s as employee_name, cast(null as varchar) as absent from base")
_add("export_records", lambda s, d: EX.export_records(validate(I.w2_docs(s, d), forms=["W-2"], layout=I.W2_LAYOUT, split=False)).select("doc_id", "record_id", "fields_count", "exceptions_count", "document_confidence", F.size("first_exceptions").cast("bigint").alias("n_first"), F.col("sample_fields")[7]["value"].alias("ssn")),
     QV._DOC_SCORE.replace(QV._ALL_EXC_HV, QV._ALL_EXC).replace("when hv.doc_id is not null then 1.0 ", "").replace(" left join hv on hv.doc_id = fl.doc_id and hv.field = fl.field", "")
     + " select b.doc_id, sha256(cast(b.doc_id as varchar)) as record_id, 14 as fields_count, count(ex.code) as exceptions_count, max(document_confidence) as document_confidence, least(count(ex.code), 10) as n_first, max(ssn_s) as ssn from base b join ds on ds.doc_id = b.doc_id left join ex on ex.doc_id = b.doc_id group by b.doc_id")
