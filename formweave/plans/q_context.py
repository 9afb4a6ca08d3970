"""Registered queries: context rules derived from tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clients as CL
from ..operators import rules_tables as R
from . import inputs as I

QUERIES: dict = {}
ORACLE: dict = {}


def _d(spark, sf_dir, sql, *tables):
    return I.derive(spark, sf_dir, sql, *tables)


def _add(name, run, sql):
    QUERIES[name] = run
    ORACLE[name] = sql


_UP = "select o_orderkey as doc_id, case when o_orderkey % 3 = 0 then 'same-hash' else sha2(concat(o_orderstatus, cast(o_custkey as varchar(12)), '/', cast(o_orderkey % 4 as varchar(12))), 256) end as doc_hash, o_orderdate as ts from {orders}"
_add("dup_upload", lambda s, d: R.duplicate_uploads(_d(s, d, _UP, "orders")).select("doc_id", "code"),
     f"with u as ({I.plain(_UP, 'orders').replace('sha2(', 'concat_ws(')}), r as (select *, row_number() over (partition by doc_hash order by ts, doc_id) as rn from u) select doc_id, 'XDOC_DUPLICATE_UPLOAD' as code from r where rn > 1".replace("concat_ws(concat(o_orderstatus, cast(o_custkey as varchar(12)), '/', cast(o_orderkey % 4 as varchar(12))), 256)", "concat(o_orderstatus, cast(o_custkey as varchar(12)), '/', cast(o_orderkey % 4 as varchar(12)))"))

_PG = "select l_orderkey as doc_id, l_linenumber as page, concat('h', cast(l_partkey % 5 as varchar(12))) as page_hash, l_suppkey from {lineitem}"
_add("dup_page", lambda s, d: R.duplicate_pages(_d(s, d, _PG, "lineitem")),
     f"with p as ({I.plain(_PG, 'lineitem')}), h as (select doc_id, page_hash, min(page) as fp from p group by 1, 2 having count(*) > 1), r as (select *, row_number() over (partition by doc_id order by fp, page_hash) as rn, count(*) over (partition by doc_id, fp) as ties from h) select doc_id, 'OCR_DUPLICATE_PAGE' as code, page_hash as value from r where rn = 1 and ties >= 1")

_add("missing_pages",
     lambda s, d: R.missing_pages(_d(s, d, "select o_orderkey as doc_id, explode(sequence(1, 4)) as page from {orders}", "orders"), _d(s, d, "select l_orderkey as doc_id, l_linenumber as page from {lineitem}", "lineitem")),
     "select o_orderkey as doc_id, 'OCR_CROPPED' as code, cast(p as varchar) as value from orders cross join range(1, 5) r(p) where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linenumber = p)")

_T1 = "select o_orderkey as doc_id, concat('h', cast(o_custkey as varchar(12))) as doc_hash from {orders}"
_T2 = "select o_orderkey as doc_id, case when o_orderkey % 11 = 0 then '' when o_orderkey % 7 = 0 then concat('h', cast(o_custkey + 1 as varchar(12))) else concat('h', cast(o_custkey as varchar(12))) end as expected_hash from {orders}"
_add("tampered_docs", lambda s, d: R.tampered(_d(s, d, _T1, "orders"), _d(s, d, _T2, "orders")),
     f"select a.doc_id, 'SEC_TAMPERED_DOC' as code, doc_hash as value from ({I.plain(_T1, 'orders')}) a join ({I.plain(_T2, 'orders')}) b on a.doc_id = b.doc_id where expected_hash <> '' and expected_hash <> doc_hash")

_add("duplicate_keys", lambda s, d: R.duplicate_keys(_d(s, d, "select l_orderkey * 8 + l_linenumber as pk from {lineitem}", "lineitem"), "pk"),
     "select pk, 'DB_DUPLICATE_PK' as code, cast(pk as varchar) as value from (select l_orderkey * 8 + l_linenumber as pk from lineitem) z group by pk having count(*) > 1")

_SF = "select event_id as doc_id, case when event_type = 'error' then 'W-2' else '1040' end as form_type, concat('field_', cast(event_id % 30 as varchar(12))) as field, case when event_id % 4 = 0 then 'null' else 'str' end as kind from {events}"
_TPL = "select distinct case when p_size % 2 = 0 then 'W-2' else '1040' end as form_type, concat(case when p_size < 25 then 'field_' else 'other_' end, cast(p_size as varchar(12))) as key from {part}"
_add("schema_drift", lambda s, d: R.schema_drift(_d(s, d, _SF, "events"), _d(s, d, _TPL, "part")),
     f"select doc_id, 'DB_SCHEMA_DRIFT' as code, field as value from ({I.plain(_SF, 'events')}) f where not exists (select 1 from ({I.plain(_TPL, 'part')}) t where t.form_type = f.form_type and t.key = f.field)")
_add("not_null_fields", lambda s, d: R.not_null_violations(_d(s, d, _SF, "events"), _d(s, d, _TPL, "part").withColumnRenamed("key", "field")),
     f"select doc_id, 'DB_NULL_NON_NULLABLE' as code, field as value from ({I.plain(_SF, 'events')}) f where kind = 'null' and exists (select 1 from ({I.plain(_TPL, 'part')}) t where t.form_type = f.form_type and t.key = f.field)")

_BOX = "select l_orderkey * 8 + l_linenumber as doc_id, 'wages' as field, l_quantity as ex, l_linenumber * 7.0 as ey, l_quantity + (l_partkey % 40) as ax, l_linenumber * 7.0 + (l_suppkey % 20) as ay from {lineitem}"
_add("bbox_drift", lambda s, d: R.bbox_drift(_d(s, d, _BOX, "lineitem").select("doc_id", "field", F.array("ex", F.col("ey").cast("double")).alias("expected"), F.array("ax", F.col("ay").cast("double")).alias("actual"))).drop("value"),
     f"select doc_id, field, 'LLM_CONTEXT_DRIFT' as code from ({I.plain(_BOX, 'lineitem')}) b where abs(ex - ax) > 15 or abs(ey - ay) > 15")

_HF = "select o_orderkey as doc_id, 'priority' as field, o_orderpriority as s from {orders} union all select o_orderkey, 'status', case when o_orderkey % 9 = 0 then 'ZZ' else o_orderstatus end from {orders}"
_HW = "select o_orderkey as doc_id, case when o_orderkey % 8 = 1 then 'blank' else lower(o_orderpriority) end as word from {orders} union all select o_orderkey, o_orderstatus from {orders}"
_add("ungrounded_values", lambda s, d: R.ungrounded_values(_d(s, d, _HF, "orders"), _d(s, d, _HW, "orders")),
     f"select doc_id, field, 'LLM_HALLUCINATED' as code, s as value from ({I.plain(_HF, 'orders')}) f where not exists (select 1 from ({I.plain(_HW, 'orders')}) w where w.doc_id = f.doc_id and lower(w.word) = lower(f.s))")

# --- engagement ----------------------------------------------------------------------------------------------------
_DC = "select o_orderkey as doc_id, o_custkey + (case when o_orderkey % 20 = 0 then 10000000 else 0 end) as client_id, case o_orderkey % 4 when 0 then '1065' when 1 then 'W-2' when 2 then '1099-INT' else 'K-1-1120S' end as form_type, cast(year(o_orderdate) as int) as form_tax_year, o_orderdate as ts from {orders}"
_CC = "select c_custkey as client_id, case c_custkey % 3 when 0 then 'individual' when 1 then 'business' else 'trust' end as client_entity_type, cast(1995 + c_custkey % 5 as int) as engagement_year, concat(lpad(cast(c_custkey % 700 as varchar(12)), 3, '0'), '-', lpad(cast(c_nationkey as varchar(12)), 2, '0'), '-1111') as tax_id from {customer}"
_add("unknown_client", lambda s, d: R.unknown_clients(_d(s, d, _DC, "orders"), _d(s, d, _CC, "customer")).drop("value"),
     f"select doc_id, 'ENG_UNKNOWN_CLIENT' as code from ({I.plain(_DC, 'orders')}) a where client_id not in (select c_custkey from customer)")
_MG = """select c_custkey as client_id, case when c_custkey % 10 = 9 then case when c_custkey % 20 = 9 then c_custkey + 10 else c_custkey - 10 end
  when c_custkey % 3 = 0 then cast(c_custkey / 3 as bigint) when c_custkey % 7 = 0 then c_custkey + 1 end as merged_into, c_custkey as merged_at from {customer}"""
_SV = f"""m as (select * from ({I.plain(_MG, 'customer')}) z where merged_into is not null and merged_into <> client_id),
 r(client_id, cur, n) as (select client_id, merged_into, 1 from m union all select r.client_id, m.merged_into, n + 1 from r join m on m.client_id = r.cur where n < 40),
 sv as (select client_id, max(case when cur not in (select client_id from m) then cur end) as survivor from r group by 1)"""
_survivors = lambda s, d: CL.surviving_clients(_d(s, d, _MG, "customer"))
_add("client_survivors", lambda s, d: _survivors(s, d), f"with recursive {_SV} select client_id, survivor, survivor is null as cyclic from sv")
_add("client_merged", lambda s, d: R.merged_clients(_d(s, d, _DC, "orders"), _survivors(s, d)),
     f"with recursive {_SV} select doc_id, 'ENG_CLIENT_MERGED' as code, cast(survivor as varchar) as value from ({I.plain(_DC, 'orders')}) a join sv using (client_id)")
_DL = "select c_custkey as client_id from {customer} where c_custkey % 4 = 1"
_add("client_deleted", lambda s, d: R.deleted_clients(_d(s, d, _DC, "orders"), _survivors(s, d), _d(s, d, _DL, "customer")).drop("value"),
     f"with recursive {_SV} select doc_id, 'ENG_CLIENT_DELETED' as code from ({I.plain(_DC, 'orders')}) a left join sv using (client_id) where coalesce(survivor, client_id) in (select client_id from ({I.plain(_DL, 'customer')}) z)")
_add("wrong_year_engagement", lambda s, d: R.wrong_years(_d(s, d, _DC, "orders"), _d(s, d, _CC, "customer").select("client_id", "engagement_year")),
     f"select doc_id, 'ENG_WRONG_YEAR' as code, cast(form_tax_year as varchar) as value from ({I.plain(_DC, 'orders')}) a join ({I.plain(_CC, 'customer')}) c using (client_id) where form_tax_year <> engagement_year")
_add("wrong_entity", lambda s, d: R.wrong_entities(_d(s, d, _DC, "orders"), _d(s, d, _CC, "customer")),
     f"select doc_id, 'ENG_WRONG_ENTITY' as code, form_type as value from ({I.plain(_DC, 'orders')}) a join ({I.plain(_CC, 'customer')}) c using (client_id) where (client_entity_type = 'individual' and form_type in ('1065','K-1-1120S')) or (client_entity_type = 'business' and form_type in ('W-2','1099-INT'))")
_add("dup_profile", lambda s, d: R.duplicate_profiles(_d(s, d, _CC, "customer")),
     f"select replace(tax_id, '-', '') as tin, 'ENG_DUPLICATE_PROFILE' as code, cast(count(distinct client_id) as varchar) as value from ({I.plain(_CC, 'customer')}) c group by 1 having count(distinct client_id) > 1")
_ML = "select event_id as doc_id, user_id % 7 as mail_id, case when event_id % 3 = 0 then concat('a@Firm', cast(user_id % 25 as varchar(12)), '.com') else concat('b@out', cast(user_id as varchar(12)), '.net') end as sender, concat('ssn', cast(user_id as varchar(12))) as ssn from {events}"
_DM = "select case when n_regionkey = 4 then concat('org', cast(n_nationkey as varchar(12)), '.net') else concat('firm', cast(n_nationkey as varchar(12)), '.com') end as domain from {nation}"
_add("unknown_sender", lambda s, d: R.unknown_senders(_d(s, d, _ML, "events"), _d(s, d, _DM, "nation")),
     f"select doc_id, 'EMAIL_UNKNOWN_SENDER' as code, lower(split_part(sender, '@', 2)) as value from ({I.plain(_ML, 'events')}) m where lower(split_part(sender, '@', 2)) not in (select domain from ({I.plain(_DM, 'nation')}) d)")
_add("multi_client_mail", lambda s, d: R.multi_client_mails(_d(s, d, _ML, "events")),
     f"select mail_id, 'EMAIL_MULTI_CLIENT' as code, cast(count(distinct ssn) as varchar) as value from ({I.plain(_ML, 'events')}) m group by mail_id having count(distinct ssn) > 1")
_EN = "select l_orderkey * 8 + l_linenumber as doc_id, l_suppkey as tin, case l_linenumber % 4 when 0 then concat('supplier ', cast(l_suppkey as varchar(12))) when 1 then 'Other Corp.' when 2 then 'SUPPLIER' else concat('Supplier#', lpad(cast(l_suppkey as varchar(12)), 9, '0'), ', Inc') end as employer_name from {lineitem}"
_TN = "select s_suppkey as tin, s_name as known_name from {supplier}"
_norm = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9 ]', '', 'g'))"
_add("name_tin_mismatch", lambda s, d: R.name_tin_mismatches(_d(s, d, _EN, "lineitem"), _d(s, d, _TN, "supplier")).select("doc_id", "code", F.col("value").cast("long").alias("value")),
     f"select doc_id, 'ID_NAME_TIN_MISMATCH' as code, tin as value from ({I.plain(_EN, 'lineitem')}) a join ({I.plain(_TN, 'supplier')}) t using (tin) where not contains({_norm('employer_name')}, {_norm('known_name')}) and not contains({_norm('known_name')}, {_norm('employer_name')})")
_TD = "select o_orderkey as doc_id, o_custkey as ssn, concat('firm_', cast(o_custkey % 4 + (case when o_orderkey % 6 = 0 then 1 else 0 end) as varchar(12))) as tenant_id from {orders}"
_TO = "select c_custkey as ssn, concat('firm_', cast(c_custkey % 4 as varchar(12))) as tenant_id from {customer}"
_add("cross_tenant", lambda s, d: R.cross_tenant(_d(s, d, _TD, "orders"), _d(s, d, _TO, "customer")),
     f"select doc_id, 'MT_CROSS_TENANT_CLIENT' as code, min(o.tenant_id) as value from ({I.plain(_TD, 'orders')}) a join ({I.plain(_TO, 'customer')}) o using (ssn) where o.tenant_id <> a.tenant_id group by 1")
_add("shared_family", lambda s, d: R.shared_households(_d(s, d, "select c_nationkey as household, c_mktsegment as login from {customer}", "customer")),
     "select c_nationkey as household, 'MT_SHARED_FAMILY' as code, cast(count(distinct c_mktsegment) as varchar) as value from customer group by 1 having count(distinct c_mktsegment) > 1")
_ND = "select l_orderkey * 8 + l_linenumber as doc_id, l_orderkey % 200 as client_id, cast(l_suppkey as varchar(12)) as tin from {lineitem}"
_NK = "select o_orderkey % 300 as client_id, cast(o_custkey % 90 as varchar(12)) as tin from {orders} where o_orderstatus = 'F'"
_add("new_tin", lambda s, d: R.new_tins(_d(s, d, _ND, "lineitem"), _d(s, d, _NK, "orders")),
     f"with k as ({I.plain(_NK, 'orders')}) select doc_id, 'ID_NEW_EMPLOYER_TIN' as code, tin as value from ({I.plain(_ND, 'lineitem')}) a where client_id in (select client_id from k) and not exists (select 1 from k where k.client_id = a.client_id and k.tin = a.tin)")
_DEPD = "select o_orderkey as doc_id, o_custkey as client_id, cast(o_orderkey % 50 as varchar(12)) as ssn, case o_orderkey % 2 when 0 then '1099-INT' else 'W-2' end as form_type from {orders}"
_DEPS = "select c_custkey as client_id, cast(c_custkey % 50 as varchar(12)) as ssn from {customer} union all select c_custkey, cast(c_nationkey as varchar(12)) from {customer}"
_add("dependent_forms", lambda s, d: R.dependents(_d(s, d, _DEPD, "orders"), _d(s, d, _DEPS, "customer")),
     f"with x as (select distinct a.* from ({I.plain(_DEPD, 'orders')}) a join ({I.plain(_DEPS, 'customer')}) b using (client_id, ssn)) select doc_id, 'ID_DUPLICATE_DEP_SSN' as code, ssn as value from x union all select doc_id, 'CTX_DEP_FORM', ssn from x where form_type = '1099-INT'")

# --- form sets --------------------------------------------------------------------------------------------------------
_FM = "select o_custkey as client_id, cast(year(o_orderdate) as int) as tax_year, o_orderpriority as form_type from {orders}"
_add("missing_recurring", lambda s, d: R.missing_recurring(_d(s, d, _FM, "orders")),
     f"with f as (select distinct * from ({I.plain(_FM, 'orders')}) z) select client_id, tax_year + 1 as tax_year, 'XDOC_MISSING_RECURRING' as code, form_type as value from f p where exists (select 1 from f c where c.client_id = p.client_id and c.tax_year = p.tax_year + 1) and not exists (select 1 from f c where c.client_id = p.client_id and c.tax_year = p.tax_year + 1 and c.form_type = p.form_type)")
_EX = "select o_custkey as client_id, o_orderpriority as form_type from {orders} where o_orderstatus = 'F'"
_RC = "select o_custkey as client_id, o_orderpriority as form_type from {orders} where o_orderstatus = 'O'"
_WV = "select c_custkey as client_id, '5-LOW' as form_type from {customer} where c_acctbal > 0"
_add("partial_form_set", lambda s, d: R.partial_form_sets(_d(s, d, _EX, "orders"), _d(s, d, _RC, "orders"), _d(s, d, _WV, "customer")),
     f"select client_id, 'LED_PARTIAL_FORM_SET' as code, form_type as value from (({I.plain(_EX, 'orders')}) except ({I.plain(_RC, 'orders')}) except ({I.plain(_WV, 'customer')})) z")
_DF = "select o_orderkey as doc_id, o_custkey as client_id, o_orderpriority as form_type from {orders}"
_add("waived_forms", lambda s, d: R.waived_forms(_d(s, d, _DF, "orders"), _d(s, d, _WV, "customer")),
     f"select doc_id, 'LED_CLIENT_WAIVED' as code, form_type as value from ({I.plain(_DF, 'orders')}) a join ({I.plain(_WV, 'customer')}) w using (client_id, form_type)")
_add("forms_outside_ledger", lambda s, d: R.forms_outside_ledger(_d(s, d, _DF, "orders"), _d(s, d, _EX, "orders")),
     f"with e as ({I.plain(_EX, 'orders')}) select doc_id, 'LED_FORM_NOT_IN_LEDGER' as code, form_type as value from ({I.plain(_DF, 'orders')}) a where client_id in (select client_id from e) and not exists (select 1 from e where e.client_id = a.client_id and e.form_type = a.form_type)")
_add("repeated_forms", lambda s, d: R.repeated_forms(_d(s, d, _DF, "orders")),
     f"select client_id, form_type, 'LED_MULTIPLE_SAME_FORM' as code, cast(count(*) as varchar) as value from ({I.plain(_DF, 'orders')}) a group by 1, 2 having count(*) > 1")

# --- amounts ------------------------------------------------------------------------------------------------------------
_AM = "select o_custkey as client_id, case o_orderkey % 3 when 0 then 'state' when 1 then 'federal' else 'other' end as level, o_totalprice as amount from {orders}"
_add("conflict_income", lambda s, d: R.income_conflicts(_d(s, d, _AM, "orders")).drop("value"),
     f"with s as (select client_id, coalesce(sum(case when level = 'state' then cast(amount as decimal(20,2)) end), 0) as st, coalesce(sum(case when level = 'federal' then cast(amount as decimal(20,2)) end), 0) as fd from ({I.plain(_AM, 'orders')}) a group by 1) select client_id, 'XDOC_CONFLICT_INCOME' as code from s where st <> 0 and fd <> 0 and abs(st - fd) > 1000 union all select client_id, 'XDOC_STATE_MISMATCH' from s where st <> 0 and fd = 0")
_CU = "select o_orderkey as doc_id, o_custkey as client_id, case when o_orderkey % 3 = 0 then o_totalprice end as capital_loss_carryover, case when o_orderkey % 2 = 0 then o_totalprice end as estimated_tax_payments from {orders}"
_PR = "select c_custkey as client_id, case when c_custkey % 2 = 0 then c_acctbal else null end as prior_cap_loss, c_acctbal - 3000 as prior_estimated from {customer}"
_add("capital_carryover", lambda s, d: R.carryovers(_d(s, d, _CU, "orders"), _d(s, d, _PR, "customer")).drop("value"),
     f"with j as (select * from ({I.plain(_CU, 'orders')}) a join ({I.plain(_PR, 'customer')}) p using (client_id)) select doc_id, 'CTX_CAP_LOSS_MISSING' as code from j where prior_cap_loss > 0 and capital_loss_carryover is null union all select doc_id, 'CY_CARRYOVER_MISSING' from j where prior_estimated > 0 and estimated_tax_payments is null")
_add("estimates_not_filed", lambda s, d: R.estimates_not_filed(_d(s, d, _CU, "orders"), _d(s, d, "select c_custkey as client_id, case when c_acctbal > 0 then '1040' else 'W-2' end as form_type from {customer}", "customer")).drop("value"),
     f"select doc_id, 'CY_EST_NOT_FILED' as code from ({I.plain(_CU, 'orders')}) a where estimated_tax_payments > 0 and not exists (select 1 from customer where c_custkey = client_id and c_acctbal > 0)")

# --- workflow, security ------------------------------------------------------------------------------------------------------
_add("ledger_gaps", lambda s, d: R.ledger_gaps(_d(s, d, "select o_orderkey as doc_id from {orders}", "orders"), _d(s, d, "select l_orderkey as doc_id from {lineitem} where l_returnflag = 'A'", "lineitem")).drop("value"),
     "select o_orderkey as doc_id, 'WF_LEDGER_NOT_UPDATED' as code from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'A')")
_add("unlogged_overrides", lambda s, d: R.unlogged_overrides(_d(s, d, "select o_orderkey as doc_id from {orders} where o_orderstatus = 'O'", "orders"), _d(s, d, "select l_orderkey as doc_id from {lineitem} where l_linestatus = 'O'", "lineitem")).drop("value"),
     "select o_orderkey as doc_id, 'WF_MANUAL_NO_AUDIT' as code from orders where o_orderstatus = 'O' and o_orderkey not in (select l_orderkey from lineitem where l_linestatus = 'O')")
_add("after_closed", lambda s, d: R.after_closed(_d(s, d, _DC, "orders"), _d(s, d, "select o_custkey as client_id, o_orderdate as closed_at from {orders} where o_orderstatus = 'F' and o_orderpriority = '1-URGENT'", "orders")).drop("value"),
     f"with c as (select o_custkey as client_id, min(o_orderdate) as closed_at from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT' group by 1) select doc_id, 'WF_AFTER_CLOSED' as code from ({I.plain(_DC, 'orders')}) a join c using (client_id) where ts > closed_at")
_AT = "select user_id as doc_id, ts from {events}"
_add("excess_attempts", lambda s, d: R.attempt_windows(_d(s, d, _AT, "events"), "3 days"),
     "select user_id as doc_id, time_bucket(interval '3 days', ts, timestamp '1970-01-01') as window_start, 'SEC_EXCESS_ATTEMPTS' as code, count(*) as attempts from events group by 1, 2 having count(*) > 10")
_add("excess_attempts_sliding", lambda s, d: R.attempt_windows(_d(s, d, _AT, "events"), "2 days", "12 hours"),
     "select user_id as doc_id, time_bucket(interval '12 hours', ts, timestamp '1970-01-01') - interval '12 hours' * k as window_start, 'SEC_EXCESS_ATTEMPTS' as code, count(*) as attempts from events cross join range(0, 4) r(k) group by 1, 2 having count(*) > 10")
_LG = "select event_id as log_id, concat('user ', cast(user_id as varchar(12)), ' ', case event_id % 4 when 0 then concat('ssn 123-45-', lpad(cast(event_id % 10000 as varchar(12)), 4, '0')) when 1 then 'ein 12-3456789 and 321-54-9876' when 2 then '1123-45-67890' else event_type end) as detail from {events}"
_add("pii_in_logs", lambda s, d: R.pii_in_logs(_d(s, d, _LG, "events")),
     f"select log_id, 'SEC_PII_IN_LOGS' as code, n_hits from (select log_id, cast(len(regexp_extract_all(detail, '\\b[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}\\b|\\b[0-9]{{2}}-[0-9]{{7}}\\b')) as bigint) as n_hits from ({I.plain(_LG, 'events')}) l) z where n_hits > 0")
_add("pii_masked_logs", lambda s, d: _d(s, d, _LG, "events").select("log_id", R.mask_pii(F.col("detail")).alias("detail")),
     f"select log_id, regexp_replace(regexp_replace(detail, '\\b[0-9]{{3}}-[0-9]{{2}}-([0-9]{{4}})\\b', '•••-••-\\1', 'g'), '\\b[0-9]{{2}}-([0-9]{{7}})\\b', '••-\\1', 'g') as detail from ({I.plain(_LG, 'events')}) l")
_add("pii_masked_documents", lambda s, d: _d(s, d, "select doc_id, text from {documents}", "documents").select("doc_id", F.md5(R.mask_pii(F.col("text"))).alias("masked_md5"), F.regexp_count("text", F.lit(R.PII_RE)).cast("long").alias("n_hits")),
     "select doc_id, md5(regexp_replace(regexp_replace(text, '\\b[0-9]{3}-[0-9]{2}-([0-9]{4})\\b', '•••-••-\\1', 'g'), '\\b[0-9]{2}-([0-9]{7})\\b', '••-\\1', 'g')) as masked_md5, cast(len(regexp_extract_all(text, '\\b[0-9]{3}-[0-9]{2}-[0-9]{4}\\b|\\b[0-9]{2}-[0-9]{7}\\b')) as bigint) as n_hits from documents")
