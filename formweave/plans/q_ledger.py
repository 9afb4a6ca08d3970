"""Registered queries: ledger, document log, audit trail, client sync."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clients as CL
from ..operators import ledger as L
from . import inputs as I

QUERIES: dict = {}
ORACLE: dict = {}

# submissions from the event table: client = user, document type = event type
SUB_SQL = """
select case when event_id % 3 = 0 then concat(' Client ', cast(user_id as varchar(12)), ' ') when event_id % 3 = 1 then concat('CLIENT ', cast(user_id as varchar(12))) else concat('client ', cast(user_id as varchar(12))) end as client_name,
  case event_type when 'signup' then 'W-2' when 'click' then '1040' when 'view' then '1099-INT' when 'purchase' then 'K-1 (1065)' else null end as document_type,
  case when event_id % 4 = 0 then 'mail' else 'portal' end as source, cast(2024 + cast(event_id % 2 as int) as int) as tax_year,
  case when value > 30 then 'Validation' when value > 10 then 'AI Processing' else null end as stage,
  case when value > 30 then 'VALIDATED' when value > 10 then 'EXTRACTED' else null end as status,
  case when event_id % 5 = 0 then concat('cpa', cast(event_id % 7 as varchar(12))) else null end as cpa,
  case when event_id % 6 = 0 then '2026-04-15' else null end as due_date, case when event_id % 2 = 0 then value else null end as confidence_score,
  case when event_id % 8 = 0 then '' when event_id % 9 = 0 then concat('/data/', cast(event_id as varchar(12)), '.json') else null end as local_json_path,
  'Taxwork' as provider, concat('doc ', cast(event_id % 10 as varchar(12))) as description, ts, event_id as seq
from {events}
"""
STATUS_SQL = """
select user_id, event_type, case when event_id % 2 = 0 then 'APPROVED' else 'REJECTED' end as status, ts + interval '1' second as ts, event_id as seq
from {events} where value > 20
"""


def prepared(spark, sf_dir):
    return L.prepare(I.derive(spark, sf_dir, SUB_SQL, "events"))


def hist(spark, sf_dir):
    return L.history(prepared(spark, sf_dir))


_PREP = f"""raw as ({I.plain(SUB_SQL, 'events')}), sub as (select trim(client_name) as client_name, lower(trim(client_name)) as client_key, coalesce(document_type, 'Unknown') as document_type,
  source, tax_year, coalesce(stage, 'Document Submission') as stage, coalesce(status, 'RECEIVED') as status, cpa, due_date, confidence_score, nullif(local_json_path, '') as local_json_path, provider, description, ts, seq,
  'DOC-' || upper(left(sha256(lower(trim(client_name)) || '|' || coalesce(document_type, 'Unknown')), 8)) as document_id from raw)"""
_HIST = f"""{_PREP}, h0 as (select *, lag(source || '~' || tax_year || '~' || stage || '~' || status) over w as prev, source || '~' || tax_year || '~' || stage || '~' || status as sig, row_number() over w as upload_count,
   last_value(cpa ignore nulls) over w as k_cpa, last_value(due_date ignore nulls) over w as k_due, last_value(confidence_score ignore nulls) over w as k_conf, last_value(local_json_path ignore nulls) over w as k_path
  from sub window w as (partition by client_key, document_type order by ts, seq)),
 h as (select *, (prev is null or prev <> sig) as content_changed, sum(case when prev is null or prev <> sig then 1 else 0 end) over (partition by client_key, document_type order by ts, seq rows between unbounded preceding and current row) as version from h0)"""


def ledger_versions(spark, sf_dir):
    return hist(spark, sf_dir).select("document_id", "ts", "seq", "upload_count", "version", "content_changed")


QUERIES["ledger_versions"] = ledger_versions
ORACLE["ledger_versions"] = f"with {_HIST} select document_id, ts, seq, upload_count, cast(version as bigint) as version, content_changed from h"


def ledger_current(spark, sf_dir):
    p = prepared(spark, sf_dir)
    d = L.with_canonical(L.current(L.history(p)), L.canonical_names(p))
    return d.select("document_id", "client_name", "document_type", "source", "stage", "status", "provider", "description", "tax_year", "cpa",
                    "due_date", "confidence_score", "local_json_path", "upload_count", "version", "content_hash")


QUERIES["ledger_current"] = ledger_current
ORACLE["ledger_current"] = f"""with {_HIST}, nm as (select client_key, arg_min(client_name, ts) as canon from sub group by 1),
 last as (select *, row_number() over (partition by client_key, document_type order by ts desc, seq desc) as rn, first_value(source) over (partition by client_key, document_type order by ts, seq) as src from h)
select document_id, canon as client_name, document_type, src as source, stage, status, provider, description, tax_year, k_cpa as cpa, k_due as due_date, k_conf as confidence_score, k_path as local_json_path,
 upload_count, cast(version as bigint) as version,
 sha256('{{"client_name": "' || canon || '", "document_type": "' || document_type || '", "source": "' || src || '", "stage": "' || stage || '", "status": "' || status || '", "tax_year": ' || tax_year || '}}') as content_hash
from last join nm using (client_key) where rn = 1"""


def document_log(spark, sf_dir):
    return L.document_log(hist(spark, sf_dir)).select("document_id", "version", "upload_count", "stage", "status", "cpa", "local_json_path", "ts")


QUERIES["document_log"] = document_log
ORACLE["document_log"] = f"with {_HIST} select document_id, cast(version as bigint) as version, upload_count, stage, status, k_cpa as cpa, k_path as local_json_path, ts from h where content_changed"


def ledger_audit(spark, sf_dir):
    """Audit entries including status updates on the same documents."""
    p = prepared(spark, sf_dir)
    u = I.derive(spark, sf_dir, STATUS_SQL, "events")
    dtype = F.when(F.col("event_type") == "signup", "W-2").when(F.col("event_type") == "click", "1040").when(
        F.col("event_type") == "view", "1099-INT").when(F.col("event_type") == "purchase", "K-1 (1065)").otherwise("Unknown")
    u = u.select(L.document_id(F.concat(F.lit("client "), F.col("user_id").cast("string")), dtype).alias("document_id"), "status", "ts", "seq")
    both = p.unionByName(L.status_updates(u, p))
    return L.audit_trail(L.history(both)).select("document_id", "ts", "seq", "entry", "status", "upload_count", "version", "content_changed")


QUERIES["ledger_audit"] = ledger_audit
ORACLE["ledger_audit"] = f"""with {_HIST}, st as (select 'DOC-' || upper(left(sha256('client ' || user_id || '|' || case event_type when 'signup' then 'W-2' when 'click' then '1040' when 'view' then '1099-INT' when 'purchase' then 'K-1 (1065)' else 'Unknown' end), 8)) as document_id, status, ts, seq from ({I.plain(STATUS_SQL, 'events')}) z)
select document_id, ts, seq, 'submit' as entry, status, upload_count, cast(version as bigint) as version, content_changed from h
union all select st.document_id, st.ts, st.seq, 'status', st.status, null, null, null from st where exists (select 1 from sub where sub.document_id = st.document_id and (sub.ts < st.ts or (sub.ts = st.ts and sub.seq < st.seq)))"""


def ledger_as_of(spark, sf_dir):
    """State in the middle of January 2024."""
    p = prepared(spark, sf_dir)
    d = L.numbers_as_of(L.history(p), F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return d.select("document_id", "status", "upload_count", "version")


QUERIES["ledger_as_of"] = ledger_as_of
ORACLE["ledger_as_of"] = f"with {_HIST} select document_id, arg_max(status, (ts, seq)) as status, max(upload_count) as upload_count, cast(max(version) as bigint) as version from h where ts <= timestamp '2024-01-15' group by 1"

_ESC_SQL = """
select event_id, case when event_id % 4 = 0 then 'DOC-MISSING' else null end as document_id, concat('CLIENT ', cast(user_id as varchar(12))) as client_name,
  case event_type when 'signup' then 'W-2' when 'click' then '1040' else 'None' end as document_type, 'NUM_LARGE_OUTLIER' as exception_code
from {events} where event_type <> 'error'
"""


def escalations(spark, sf_dir):
    p = prepared(spark, sf_dir)
    led = L.with_canonical(L.current(L.history(p)), L.canonical_names(p))
    return L.escalate(led, I.derive(spark, sf_dir, _ESC_SQL, "events")).select("event_id", "linked_document_id", "ledger_linked")


QUERIES["escalations"] = escalations
ORACLE["escalations"] = f"""with {_PREP}, nm as (select client_key, arg_min(client_name, ts) as canon from sub group by 1), led as (select distinct document_id, canon as client_name, document_type from sub join nm using (client_key)),
 es as ({I.plain(_ESC_SQL, 'events')}) select event_id, led.document_id as linked_document_id, led.document_id is not null as ledger_linked from es left join led on led.client_name = es.client_name and led.document_type = es.document_type"""

CLIENT_SQL = """
select concat('C', lpad(cast(c_custkey as varchar(12)), 9, '0')) as id,
  case c_custkey % 3 when 0 then 'INDIVIDUAL' when 1 then 'BUSINESS' else 'TRUST' end as entity_type,
  case when c_custkey % 3 = 0 then concat('Pat', cast(c_custkey % 40 as varchar(12))) when c_custkey % 10 = 1 then 'Lee' else null end as first_name,
  case when c_custkey % 3 = 0 then concat('Stone', cast(c_custkey as varchar(12))) else null end as last_name,
  case when c_custkey % 3 = 1 then concat(c_name, ' Holdings  LLC') else null end as business_name,
  case when c_custkey % 3 = 2 and c_custkey % 7 <> 0 then concat('Trust of ', c_name) when c_custkey % 3 = 2 then '  ' else null end as trust_name,
  concat(lpad(cast(c_custkey % 1000 as varchar(12)), 3, '0'), '-', lpad(cast(c_nationkey as varchar(12)), 2, '0'), '-', lpad(cast(c_custkey % 800 as varchar(12)), 4, '0')) as tax_id,
  case c_nationkey % 4 when 0 then 'bad@mail' when 1 then 'ok@mail.org' when 2 then '' else null end as email,
  case c_nationkey % 3 when 0 then '+1 (555) 010-2000' when 1 then '12' else null end as phone,
  c_mktsegment as lifecycle_stage, cast(c_nationkey as varchar(12)) as country, case when c_acctbal < 0 then 'HIGH' else 'LOW' end as risk_profile,
  timestamp '2024-01-01 00:00:00' + interval '1' day * cast(c_custkey % 300 as int) as created_at
from {customer}
"""
_LED_NAMES_SQL = """
select concat('D', cast(o_orderkey as varchar(12))) as document_id,
  case o_custkey % 4 when 0 then concat('STONE', cast(o_custkey as varchar(12))) when 1 then concat('customer#', lpad(cast(o_custkey as varchar(12)), 9, '0')) when 2 then concat('pat', cast(o_custkey % 40 as varchar(12)), ' ') else 'nobody here' end as client_name,
  case when o_orderkey % 5 = 0 then concat('C', lpad(cast(o_custkey as varchar(12)), 9, '0')) else null end as client_id
from {orders}
"""


def containment_match(spark, sf_dir):
    names = I.derive(spark, sf_dir, _LED_NAMES_SQL, "orders").select(F.col("client_name").alias("name_key"))
    return CL.contained_names(names, I.derive(spark, sf_dir, CLIENT_SQL, "customer")).select("name_key", "client_id", F.col("tier").cast("long").alias("tier"))


_CLI = f"cli as ({I.plain(CLIENT_SQL, 'customer')})"
_MATCH = f"""{_CLI}, led as ({I.plain(_LED_NAMES_SQL, 'orders')}), nmk as (select distinct lower(trim(client_name)) as name_key from led),
 tiers as (select id, created_at, 0 as tier, lower(coalesce(first_name,'') || ' ' || coalesce(last_name,'')) as fullname from cli union all select id, created_at, 1, lower(business_name) from cli union all select id, created_at, 2, lower(trust_name) from cli),
 mt as (select name_key, id as client_id, tier, row_number() over (partition by name_key order by tier, created_at, id) as rn from nmk join tiers on contains(fullname, name_key))"""
QUERIES["containment_match"] = containment_match
ORACLE["containment_match"] = f"with {_MATCH} select name_key, client_id, cast(tier as bigint) as tier from mt where rn = 1"


def sync_client_ids(spark, sf_dir):
    led = I.derive(spark, sf_dir, _LED_NAMES_SQL, "orders")
    logs = led.unionByName(led.withColumn("client_id", F.lit(None).cast("string")))
    return CL.sync_client_ids(led, logs, I.derive(spark, sf_dir, CLIENT_SQL, "customer"))[2]


QUERIES["sync_client_ids"] = sync_client_ids
_LOGS = "logs as (select document_id, client_id from led union all select document_id, null from led)"
ORACLE["sync_client_ids"] = f"""with {_MATCH}, {_LOGS}, lm as (select led.document_id, led.client_id, mt.client_id as found from led left join mt on mt.name_key = lower(trim(led.client_name)) and mt.rn = 1)
select (select count(*) from lm) as total_ledger_rows, (select count(found) from lm) as matched_clients, (select count(*) from lm where found is not null and client_id is distinct from found) as updated_ledger_rows,
 (select count(*) from logs join lm using (document_id) where found is not null and logs.client_id is distinct from found) as updated_document_log_rows"""


def backfill_client_ids(spark, sf_dir):
    """Only rows without a client id are filled."""
    led = I.derive(spark, sf_dir, _LED_NAMES_SQL, "orders")
    return CL.sync_client_ids(led, led, I.derive(spark, sf_dir, CLIENT_SQL, "customer"), only_missing=True)[0].select("document_id", "client_id")


QUERIES["backfill_client_ids"] = backfill_client_ids
ORACLE["backfill_client_ids"] = f"with {_MATCH} select led.document_id, coalesce(led.client_id, mt.client_id) as client_id from led left join mt on mt.name_key = lower(trim(led.client_name)) and mt.rn = 1"

_STAGE_SQL = "select user_id, ts, event_id as seq, case event_type when 'signup' then 'uploaded' when 'view' then 'extracted' when 'click' then 'corrected' when 'purchase' then 'exported' else 'created' end as stage from {events}"
ALLOWED = {"extracted": ["uploaded", "extracted"], "corrected": ["extracted", "corrected"]}


def status_transitions(spark, sf_dir):
    """Session steps taken from a stage they are not allowed from."""
    return L.transitions(I.derive(spark, sf_dir, _STAGE_SQL, "events"), "user_id", ALLOWED)


QUERIES["status_transitions"] = status_transitions
ORACLE["status_transitions"] = f"""with s as (select *, lag(stage) over (partition by user_id order by ts, seq) as prev_stage from ({I.plain(_STAGE_SQL, 'events')}) b)
select user_id, ts, seq, prev_stage, stage from s where (stage = 'extracted' and coalesce(prev_stage, '') not in ('uploaded','extracted')) or (stage = 'corrected' and coalesce(prev_stage, '') not in ('extracted','corrected'))"""


def strict_submissions(spark, sf_dir):
    """Submissions accepted and rejected by the known-client rule, per document type."""
    p = prepared(spark, sf_dir)
    known = I.derive(spark, sf_dir, "select distinct concat('client ', cast(c_custkey as varchar(12))) as client_key from {customer} where c_acctbal > 0", "customer")
    ok, bad = L.split_by_client(p, known)
    a = ok.groupBy("document_type").agg(F.count("*").alias("n")).withColumn("outcome", F.lit("accepted"))
    b = bad.groupBy("document_type").agg(F.count("*").alias("n")).withColumn("outcome", F.lit("rejected"))
    return a.unionByName(b)


QUERIES["strict_submissions"] = strict_submissions
ORACLE["strict_submissions"] = f"with {_PREP}, k as (select 'client ' || c_custkey as client_key from customer where c_acctbal > 0) select document_type, count(*) as n, case when k.client_key is not null then 'accepted' else 'rejected' end as outcome from sub left join k using (client_key) group by 1, 3"

_PATH_SQL = "select concat('D', cast(o_orderkey as varchar(12))) as document_id, case when o_orderkey % 3 = 0 then '' else concat('/x/', o_orderstatus, '.json') end as local_json_path, o_orderdate as ts from {orders}"


def json_path_update(spark, sf_dir):
    """Stored path replaced where a new one is given."""
    led = I.derive(spark, sf_dir, _LED_NAMES_SQL, "orders").select("document_id", F.lit("/old.json").alias("local_json_path"))
    return L.set_json_path(led, I.derive(spark, sf_dir, _PATH_SQL, "orders"))


QUERIES["json_path_update"] = json_path_update
ORACLE["json_path_update"] = f"select document_id, case when local_json_path = '' then '/old.json' else local_json_path end as local_json_path from ({I.plain(_PATH_SQL, 'orders')}) p"

_SUBM_SQL = """select event_id as seq, ts, case when event_id % 7 = 0 then concat('Override ', cast(user_id as varchar(12))) end as name_override, case when event_id % 3 = 0 then concat('Found ', cast(user_id as varchar(12))) when event_id % 3 = 1 then '' end as extracted_name,
 case when event_id % 5 = 0 then 'From Context' end as ctx_client_name, concat('file', cast(event_id as varchar(12)), '.pdf') as filename, case when event_type = 'error' then '' when event_type = 'view' then 'W-2' end as form_type,
 case when event_id % 2 = 0 then '2025' else '2024' end as ctx_tax_year from {events}"""


def ledger_submissions(spark, sf_dir):
    """Submissions assembled from extraction rows."""
    from ..operators.export import submission

    return submission(I.derive(spark, sf_dir, _SUBM_SQL, "events")).select("seq", "client_name", "document_type", "description", "source", "tax_year")


QUERIES["ledger_submissions"] = ledger_submissions
ORACLE["ledger_submissions"] = f"select seq, coalesce(name_override, nullif(extracted_name, ''), ctx_client_name, filename) as client_name, coalesce(nullif(form_type, ''), 'Unknown') as document_type, 'Auto-extracted: ' || filename as description, filename as source, cast(ctx_tax_year as int) as tax_year from ({I.plain(_SUBM_SQL, 'events')}) z"


def audit_escalations(spark, sf_dir):
    """Audit trail with escalations as entries."""
    p = prepared(spark, sf_dir)
    hist_ = L.history(p)
    led = L.with_canonical(L.current(hist_), L.canonical_names(p))
    # every event escalates; those of a type without a document find none
    raised = I.derive(spark, sf_dir, _ESC_SQL.replace("where event_type <> 'error'", "").replace("select event_id,", "select ts, event_id as seq, event_id,"), "events")
    trail = L.with_escalations(L.audit_trail(hist_), L.escalate(led, raised))
    return trail.select("document_id", "ts", "seq", "entry", "upload_count")


QUERIES["audit_escalations"] = audit_escalations
ORACLE["audit_escalations"] = f"""with {_HIST}, nm as (select client_key, arg_min(client_name, ts) as canon from sub group by 1), led as (select distinct document_id, canon as client_name, document_type from sub join nm using (client_key)),
 es as ({I.plain(_ESC_SQL, 'events').replace("where event_type <> 'error'", "").replace("select event_id,", "select ts, event_id as seq, event_id,")})
select document_id, ts, seq, 'submit' as entry, upload_count from h union all select led.document_id, es.ts, es.seq, 'exception_escalated', null from es join led on led.client_name = es.client_name and led.document_type = es.document_type"""


def correction_history(spark, sf_dir):
    """Accepted corrections of each session, in order."""
    return L.correction_history(I.derive(spark, sf_dir, _STAGE_SQL, "events"), "user_id", ALLOWED).select("user_id", F.col("n").cast("long").alias("n"), "ts", "seq")


QUERIES["correction_history"] = correction_history
ORACLE["correction_history"] = f"""with s as (select *, lag(stage) over (partition by user_id order by ts, seq) as prev_stage from ({I.plain(_STAGE_SQL, 'events')}) b)
select user_id, row_number() over (partition by user_id order by ts, seq) as n, ts, seq from s where stage = 'corrected' and prev_stage in ('extracted','corrected')"""


NAME_SQL = """select concat('D', cast(user_id % 40 as varchar(12)), event_type) as document_id, ts, event_id as seq, case when event_id % 5 < 2 then concat('DOC-', cast(event_id as varchar(12))) when event_id % 5 = 2 then 'Unknown'
 when event_id % 10 = 3 then '' when value > 40 then concat(' Client ', cast(user_id as varchar(12))) else 'Unknown' end as client_name from {events}"""
QUERIES["name_repair"] = lambda s, d: L.repaired_names(I.derive(s, d, NAME_SQL, "events"))
ORACLE["name_repair"] = f"""select document_id, list_reduce(list(trim(client_name) order by ts, seq), lambda acc, x: case when x <> '' and (acc like 'DOC-%' or acc = 'Unknown') then x else acc end) as client_name
 from ({I.plain(NAME_SQL, 'events')}) e group by 1"""
