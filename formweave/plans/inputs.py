"""Domain-shaped inputs derived from the general tables.

The driver tables hold no tax forms, so document rows are derived from them with plain expressions that
read the whole table. The same text feeds Spark and the SQL check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import Layout, from_columns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """Run a derivation text over parquet tables without registering session-wide views."""
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables})


def derive_documents(spark: SparkSession, sf_dir: str, sql: str, main: str, *others: str) -> DataFrame:
    """Derivation of documents from a main table and others."""
    return derive(spark, sf_dir, sql, main, *others)


def dealt_documents(spark: SparkSession, sf_dir: str, sql: str, main: str, *others: str) -> DataFrame:
    """Derivation of documents that cost far more work than their rows are long: the main table is dealt evenly over the shuffle partitions.

    A file of one row group is read by one task whatever its size, and that task would do all the work.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.sql(sql, **{main: table(spark, sf_dir, main).repartition(parts)}, **{t: table(spark, sf_dir, t) for t in others})


def plain(sql: str, *tables: str) -> str:
    """The same text with bare table names, for the SQL check."""
    return sql.format(**{t: t for t in tables})


def money(expr: str) -> str:
    return f"cast(round(cast({expr} as decimal(18,6)),2) as double)"


# --- W-2 documents: one per order ---------------------------------------------------------------------------
def _w2_sql(*known: str) -> str:
    return f"""
select o_orderkey as doc_id,{"".join(f" {c}," for c in known)} 'W-2' as form_type,
  case when o_orderkey % 2 = 0 then 'digital' else 'scanned' end as pdf_type,
  case when o_orderkey % 41 = 0 then null when o_orderkey % 37 = 0 then -o_totalprice
       when o_orderkey % 43 = 0 then o_totalprice * 10 when o_orderkey % 47 = 0 then o_totalprice * 100
       else o_totalprice end as wages_n,
  case when o_orderkey % 17 = 0 then '0' when o_orderkey % 19 = 0 then '—' when o_orderkey % 23 = 0 then 'N/A'
       when o_orderkey % 29 = 0 then '54,23I.00' when o_orderkey % 31 = 0 then '(1,250.75)' when o_orderkey % 73 = 0 then 'unreadable' when o_orderkey % 79 = 0 then 'NONE' else null end as wages_s,
  {money('o_totalprice * 0.15')} as fed_n,
  case when o_orderkey % 13 = 0 then 170000.0 else least(o_totalprice, 168600.0) end as ssw_n,
  {money('least(o_totalprice, 168600.0) * 0.062')} + case when o_orderkey % 7 = 0 then 5.0 else 0.0 end as sst_n,
  case when o_orderkey % 53 = 0 then o_totalprice - 500.0 else o_totalprice end as mw_n,
  {money('o_totalprice * 0.0145')} + case when o_orderkey % 11 = 0 then 5.0 else 0.0 end as mt_n,
  case when o_orderkey % 10 = 0 then 6000.0 when o_orderkey % 3 = 0 then 1500.0 else null end as dep_n,
  case when o_orderkey % 59 = 0 then null when o_orderkey % 61 = 0 then '***-**-6789'
       when o_orderkey % 67 = 0 then '12345678'
       else concat(lpad(cast(o_custkey % 1000 as varchar(12)), 3, '0'), '-', lpad(cast(o_orderkey % 100 as varchar(12)), 2, '0'),
                   '-', lpad(cast(o_orderkey % 10000 as varchar(12)), 4, '0')) end as ssn_s,
  concat(lpad(cast(o_custkey % 100 as varchar(12)), 2, '0'), '-', lpad(cast(o_custkey % 10000000 as varchar(12)), 7, '0')) as ein_s,
  case when o_custkey % 5 = 0 then 'Globex Corporation' when o_custkey % 5 = 1 then 'ACME HOLDINGS LLC'
       when o_custkey % 5 = 2 then 'O''Brien & Mc-Donald' when o_custkey % 5 = 3 then 'umbrella group' else 'ABC Corp' end as employer_s,
  case when o_orderkey % 71 = 0 then '  ' when o_custkey % 2 = 0 then upper(c_name) else c_name end as employee_s,
  case when o_orderkey % 3 = 0 then concat(cast(o_custkey as varchar(12)), ' Oak St, Springfield, IL ', lpad(cast(o_custkey % 100000 as varchar(12)), 5, '0'), ' United States')
       when o_orderkey % 3 = 1 then '12 Elm Ave' else null end as address_s,
  2020 + cast(o_orderkey % 9 as int) as year_n
from {{orders}} join {{customer}} on o_custkey = c_custkey
"""


W2_SQL = _w2_sql()
# (field, number column, text column) in field order
W2_FIELDS = [
    ("wages_tips_compensation", "wages_n", "wages_s"), ("federal_income_tax_withheld", "fed_n", None),
    ("social_security_wages", "ssw_n", None), ("social_security_tax_withheld", "sst_n", None),
    ("medicare_wages_and_tips", "mw_n", None), ("medicare_tax_withheld", "mt_n", None),
    ("dependent_care_benefits", "dep_n", None), ("employee_ssn", None, "ssn_s"), ("employer_tin", None, "ein_s"),
    ("employer_name", None, "employer_s"), ("employee_name", None, "employee_s"), ("employee_address", None, "address_s"),
    ("tax_year", "year_n", None), ("is_corrected", None, None),
]


def layout_of(fields: list[tuple]) -> Layout:
    return {name: "mixed" if n and s else "num" if n else "str" if s else "bool" for name, n, s in fields}


W2_LAYOUT = layout_of(W2_FIELDS)


def typed_columns(fields: list[tuple]) -> list[tuple]:
    spec = []
    for name, n, s in fields:
        if n and s:
            spec.append((name, "mixed", F.col(n), F.col(s)))
        elif n:
            spec.append((name, "num", F.col(n)))
        elif s:
            spec.append((name, "str", F.col(s)))
        else:
            spec.append((name, "bool", F.lit(None).cast("boolean")))
    return spec


def documents(df: DataFrame, fields: list[tuple], *keep: str) -> DataFrame:
    """Document rows with a field array from a wide derived table."""
    return df.select(*keep, from_columns(typed_columns(fields)).alias("fields"))




def w2_rows(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """W-2 documents of all orders as typed columns. Columns ``known`` per doc_id are joined to the few columns of the orders."""
    if known is None:
        return dealt_documents(spark, sf_dir, W2_SQL, "orders", "customer")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [c for c in known.columns if c != "doc_id"]
    orders = table(spark, sf_dir, "orders").repartition(parts, "o_orderkey")
    orders = orders.join(known.withColumnRenamed("doc_id", "o_orderkey"), "o_orderkey", "left")
    return spark.sql(_w2_sql(*cols), orders=orders, customer=table(spark, sf_dir, "customer"))


def w2_docs(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """The same documents with their fields in an array."""
    cols = [] if known is None else [c for c in known.columns if c != "doc_id"]
    return documents(w2_rows(spark, sf_dir, known), W2_FIELDS, "doc_id", "form_type", "pdf_type", *cols)


def fields_sql(cte: str, fields: list[tuple]) -> str:
    """Long field table of a wide CTE for the SQL check: doc_id, pos, field, n, s, kind."""
    rows = []
    for i, (name, n, s) in enumerate(fields):
        nn = f"cast({n} as double)" if n else "cast(null as double)"
        ss = f"{s}" if s else "cast(null as varchar)"
        rows.append(
            f"select doc_id, {i} as pos, '{name}' as field, {nn} as n, {ss} as s, "
            f"case when {ss} is not null then 'str' when {nn} is not null then 'num' else 'null' end as kind from {cte}")
    return " union all ".join(rows)


def lenient_sql(s: str) -> str:
    """Lenient number of a text column, for the SQL check."""
    t = f"trim({s}, E' \\t\\n\\r')"
    num = f"try_cast(nullif(nullif(regexp_replace({t}, '[^0-9.\\-]', '', 'g'), ''), '.') as double)"
    return (f"(case when upper({t}) in ('N/A','NA','N.A.','NONE') or {t} = '' then null when {t} in ('—','–','-','--') then 0.0 "
            f"when {t} like '(%' and {t} like '%)' then -{num} else {num} end)")


# --- 1040 documents: one per order -----------------------------------------------------------------------------
F1040_SQL = f"""
select o_orderkey as doc_id, '1040' as form_type,
  case when o_orderkey % 31 = 0 then null else o_totalprice end as total_n,
  case when o_orderkey % 4 = 0 then 1000.0 else null end as adj_n,
  case when o_orderkey % 37 = 0 then null
       else {money("o_totalprice - case when o_orderkey % 4 = 0 then 1000.0 else 0.0 end")} + case when o_orderkey % 9 = 0 then 25.5 else 0.0 end end as agi_n,
  case when o_orderkey % 5 = 0 then 14600.0 else null end as ded_n,
  case when o_orderkey % 6 = 0 then o_totalprice * 1.5 else {money("o_totalprice - 14600.0")} end as taxable_n,
  case when o_orderkey % 8 = 0 then {money("o_totalprice * 0.10")} else null end as whw2_n,
  case when o_orderkey % 16 = 0 then 120.25 else null end as wh99_n,
  case when o_orderkey % 10 = 0 then {money("o_totalprice * 1.2")} when o_orderkey % 8 = 0 then {money("o_totalprice * 0.10")} else null end as wh_n,
  {money("o_totalprice * 0.22")} as tax_n,
  case when o_orderkey % 3 = 0 then {money("o_totalprice * 0.25")} else {money("o_totalprice * 0.20")} end as pay_n,
  case when o_orderkey % 3 <> 0 then {money("o_totalprice * 0.22")} - {money("o_totalprice * 0.20")} + case when o_orderkey % 7 = 0 then 9.0 else 0.0 end else null end as owed_n,
  case when o_orderkey % 3 = 0 then {money("o_totalprice * 0.25")} - {money("o_totalprice * 0.22")} + case when o_orderkey % 7 = 1 then 9.0 else 0.0 end else null end as over_n,
  case when o_orderkey % 20 = 0 then -5.0 when o_orderkey % 11 = 0 then 2400.0 else null end as est_n,
  case o_custkey % 6 when 0 then 'Single' when 1 then 'married filing jointly' when 2 then 'HOH ' when 3 then 'mfs' when 4 then 'unknown' else null end as status_s,
  case when o_orderkey % 4 = 1 then 14600.0 when o_orderkey % 4 = 2 then 29200.0 else null end as std_n,
  case when o_orderkey % 12 = 0 then -1500.0 when o_orderkey % 12 = 5 then 0.0 when o_orderkey % 12 = 7 then 8000.0 else null end as biz_n,
  case when o_orderkey % 24 = 7 then 'No' when o_orderkey % 24 = 19 then 'yes' else null end as sched_s,
  case when o_orderkey % 43 = 0 then null else concat(lpad(cast(o_custkey % 1000 as varchar(12)), 3, '0'), '-', lpad(cast(o_orderkey % 100 as varchar(12)), 2, '0'), '-', lpad(cast(o_orderkey % 10000 as varchar(12)), 4, '0')) end as ssn_s,
  case when o_orderkey % 5 = 2 then concat('9', lpad(cast(o_custkey % 100 as varchar(12)), 2, '0'), '-12-3456') when o_orderkey % 5 = 3 then '123-45-6789' else null end as spouse_s
from {{orders}}
"""
F1040_FIELDS = [
    ("total_income", "total_n", None), ("adjustments_to_income", "adj_n", None), ("adjusted_gross_income", "agi_n", None),
    ("total_deductions", "ded_n", None), ("taxable_income", "taxable_n", None), ("withholding_w2", "whw2_n", None),
    ("withholding_1099", "wh99_n", None), ("total_withholding", "wh_n", None), ("total_tax", "tax_n", None),
    ("total_payments", "pay_n", None), ("amount_owed", "owed_n", None), ("overpayment", "over_n", None),
    ("estimated_tax_payments", "est_n", None), ("filing_status", None, "status_s"), ("standard_or_itemized_ded", "std_n", None),
    ("business_income", "biz_n", None), ("schedule_c_attached", None, "sched_s"), ("taxpayer_ssn", None, "ssn_s"),
    ("spouse_ssn", None, "spouse_s"),
]

# --- 1099 documents: one per line item, four form families over the whole table -------------------------------
_LI = """(l_orderkey * 8 + l_linenumber)"""
_TINS = f"""
  case when l_suppkey % 17 = 0 then null when l_suppkey % 19 = 0 then '123-45-6789'
       else concat(lpad(cast(l_suppkey % 100 as varchar(12)), 2, '0'), '-', lpad(cast(l_suppkey as varchar(12)), 7, '0')) end as payer_s,
  case when l_partkey % 23 = 0 then null when l_partkey % 29 = 0 then 'XXX-XX-1234' when l_partkey % 31 = 0 then '123456789'
       else concat(lpad(cast(l_partkey % 1000 as varchar(12)), 3, '0'), '-45-', lpad(cast(l_orderkey % 10000 as varchar(12)), 4, '0')) end as recipient_s
"""
_TIN_FIELDS = [("payer_tin", None, "payer_s"), ("recipient_tin", None, "recipient_s")]
INCOME_SQL = f"""
select {_LI} as doc_id,
  case l_linenumber % 3 when 0 then '1099-NEC' when 1 then '1099-INT' else '1099-DIV' end as form_type,
  case when l_quantity < 3 then l_quantity * 2 when l_quantity = 50 then -l_extendedprice when l_quantity = 49 then null else l_extendedprice end as income_n,
  case when l_returnflag = 'R' then {money("l_extendedprice * 0.24")} else {money("l_extendedprice * l_tax")} end as held_n,
  case when l_returnflag <> 'N' then 'true' else null end as notice_s,
  case when l_linestatus = 'F' then {money("l_extendedprice * (0.9 + l_discount * 3)")} else null end as extra_n,
  case when l_linestatus = 'O' then {money("l_extendedprice * l_discount")} else null end as cap_n,
  {money("l_extendedprice * l_tax")} as sec1250_n, case when l_quantity > 40 then 10.5 else null end as sec1202_n,
  {_TINS}
from {{lineitem}}
"""
INCOME_FIELDS = {
    "1099-NEC": [("nonemployee_compensation", "income_n", None), ("federal_income_tax_withheld", "held_n", None), ("second_tin_notice", None, "notice_s"), *_TIN_FIELDS],
    "1099-INT": [("interest_income", "income_n", None), ("federal_income_tax_withheld", "held_n", None), ("second_tin_notice", None, "notice_s"), ("bond_premium", "extra_n", None), *_TIN_FIELDS],
    "1099-DIV": [("total_ordinary_dividends", "income_n", None), ("federal_income_tax_withheld", "held_n", None), ("second_tin_notice", None, "notice_s"), ("qualified_dividends", "extra_n", None), ("total_capital_gain_distr", "cap_n", None), ("unrecaptured_sec1250_gain", "sec1250_n", None), ("section_1202_gain", "sec1202_n", None), *_TIN_FIELDS],
}
R_SQL = f"""
select {_LI} as doc_id, '1099-R' as form_type,
  case when l_quantity = 49 then null else l_extendedprice end as gross_n,
  {money("l_extendedprice * (0.97 + l_discount)")} as taxable_n, {money("l_extendedprice * (0.95 + l_tax)")} as gain_n,
  case when l_quantity = 7 then l_extendedprice * 2 else {money("l_extendedprice * 0.2")} end as held_n,
  case when l_quantity = 11 then null when l_quantity = 12 then '7, x9' when l_quantity = 13 then '1/G' when l_quantity = 14 then ' 1 ' when l_quantity = 15 then '0' else '7' end as code_s,
  {_TINS}
from {{lineitem}}
"""
R_FIELDS = [("gross_distribution", "gross_n", None), ("taxable_amount", "taxable_n", None), ("capital_gain", "gain_n", None), ("federal_income_tax_withheld", "held_n", None), ("distribution_code", None, "code_s"), *_TIN_FIELDS]
MISC_SQL = f"""
select {_LI} as doc_id, '1099-MISC' as form_type,
  case when l_quantity < 20 then l_quantity * 40 else null end as rents_n,
  case when l_quantity > 45 then l_discount * 200 else null end as royalties_n,
  case when l_returnflag = 'A' then l_extendedprice - 20000 else null end as medical_n,
  case when l_returnflag = 'R' then l_extendedprice else null end as other_n, {_TINS}
from {{lineitem}}
"""
MISC_FIELDS = [("rents", "rents_n", None), ("royalties", "royalties_n", None), ("medical_health_care_payments", "medical_n", None), ("other_income", "other_n", None), *_TIN_FIELDS]
BROKER_SQL = f"""
select {_LI} as doc_id,
  case l_linenumber % 3 when 0 then '1099-B' when 1 then '1099-G' else '1099-S' end as form_type,
  case when l_quantity = 1 then null when l_quantity = 2 then 0.0 when l_quantity = 3 then -l_extendedprice else l_extendedprice end as main_n,
  case when l_returnflag = 'A' then l_extendedprice * 0.5 when l_returnflag = 'R' then -l_extendedprice * 2 else l_extendedprice * 1.1 end as cost_n,
  case when l_linestatus = 'O' then 100.25 else null end as wash_n,
  case when l_quantity < 10 then null else l_extendedprice end as refund_n,
  case when l_discount > 0.05 then {money("l_extendedprice * 0.1")} else {money("l_extendedprice * l_tax")} end as held_n,
  case when l_quantity = 30 then null else cast(l_shipdate as varchar(40)) end as closing_s, {_TINS}
from {{lineitem}}
"""
BROKER_FIELDS = {
    "1099-B": [("proceeds", "main_n", None), ("cost_or_basis", "cost_n", None), ("wash_sale_loss_disallowed", "wash_n", None), *_TIN_FIELDS],
    "1099-G": [("unemployment_compensation", "main_n", None), ("state_local_tax_refund", "refund_n", None), ("federal_income_tax_withheld", "held_n", None), *_TIN_FIELDS],
    "1099-S": [("gross_proceeds", "main_n", None), ("date_of_closing", None, "closing_s"), *_TIN_FIELDS],
}
_MONTH_COLS = ", ".join(
    f"case when {i} < l_quantity % 14 then {money('l_extendedprice / 12')} else null end as m{i}_n" for i in range(12))
K_SQL = f"""
select {_LI} as doc_id, '1099-K' as form_type,
  case when l_quantity = 49 then null when l_discount = 0.05 then {money("l_extendedprice / 12")} * 12 when l_discount > 0.07 then 4000.0 else l_extendedprice end as gross_n,
  {money("l_extendedprice * (0.95 + l_discount)")} as cnp_n, {_MONTH_COLS}, {_TINS}
from {{lineitem}}
"""
K_FIELDS = [("gross_amount_payment_card", "gross_n", None), ("card_not_present_transactions", "cnp_n", None)] + [
    (m, f"m{i}_n", None) for i, m in enumerate(
        ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"])
] + _TIN_FIELDS
K1_SQL = f"""
select {_LI} as doc_id,
  case l_linenumber % 3 when 0 then 'K-1 (1065)' when 1 then 'K-1 (1120S)' else 'K-1 (1041)' end as form_type,
  case when l_quantity = 49 then null when l_quantity = 50 then -2500.5 else {money("l_extendedprice + l_quantity * 100 - l_extendedprice * l_tax")} + case when l_returnflag = 'A' then 4.5 when l_returnflag = 'R' then 250.0 else 0.0 end end as end_n,
  l_extendedprice as beg_n, l_quantity * 100 as contrib_n, -{money("l_extendedprice * l_tax")} as wdrl_n,
  l_quantity * 10 as gps_n, case when l_discount > 0.03 then 50.0 else null end as gpc_n,
  case when l_linestatus = 'F' then l_quantity * 10 + 50.0 else null end as gpt_n,
  l_extendedprice * 0.1 as ordd_n, l_extendedprice * (0.05 + l_discount) as quald_n,
  case when l_quantity = 33 then 120.0 when l_quantity = 34 then -1.0 else l_quantity end as share_n,
  20000 - l_extendedprice as ordinary_n, l_extendedprice - 5000 as final_n, {_TINS}
from {{lineitem}}
"""
K1_FIELDS = {
    "K-1 (1065)": [("ending_capital_account", "end_n", None), ("beginning_capital_account", "beg_n", None), ("contributions", "contrib_n", None), ("withdrawals_distributions", "wdrl_n", None), ("guaranteed_payments_services", "gps_n", None), ("guaranteed_payments_capital", "gpc_n", None), ("total_guaranteed_payments", "gpt_n", None), ("ordinary_dividends", "ordd_n", None), ("qualified_dividends", "quald_n", None), ("partner_share_percentage", "share_n", None), ("partnership_tin", None, "payer_s"), ("partner_tin", None, "recipient_s")],
    "K-1 (1120S)": [("ordinary_dividends", "ordd_n", None), ("qualified_dividends", "quald_n", None), ("shareholder_share_percentage", "share_n", None), ("ordinary_business_income", "ordinary_n", None), ("corporation_tin", None, "payer_s"), ("shareholder_tin", None, "recipient_s")],
    "K-1 (1041)": [("ordinary_dividends", "ordd_n", None), ("qualified_dividends", "quald_n", None), ("final_year_deductions", "final_n", None), ("estate_tin", None, "payer_s"), ("beneficiary_tin", None, "recipient_s")],
}
GENERIC_SQL = f"""
select {_LI} as doc_id,
  case l_linenumber % 6 when 0 then '1099-Q' when 1 then '1099-SA' when 2 then '1099-OID' when 3 then '1099-PATR' when 4 then '1099-LS' else '1099-LTC' end as form_type,
  case when l_quantity < 5 then 0.0 when l_quantity > 47 then null else l_extendedprice end as a_n,
  case when l_quantity > 45 then l_extendedprice * 0.5 else null end as b_n,
  case when l_discount < 0.02 then null when l_returnflag = 'R' then {money("l_extendedprice * 0.24")} else {money("l_extendedprice * 0.1")} end as held_n,
  case when l_linestatus = 'F' then 'true' else null end as notice_s, {_TINS}
from {{lineitem}}
"""
GENERIC_FIELDS = [("gross_distribution", "a_n", None), ("original_issue_income", "b_n", None), ("federal_tax_withheld", "held_n", None), ("backup_withholding_applies", None, "notice_s"), *_TIN_FIELDS]


def mixed_documents(df: DataFrame, by_form: dict[str, list[tuple]]) -> DataFrame:
    """Documents whose field list depends on the form type, as one CASE over the row (no union of scans)."""
    out = None
    for form, fields in by_form.items():
        arr = from_columns(typed_columns(fields))
        out = F.when(F.col("form_type") == form, arr) if out is None else out.when(F.col("form_type") == form, arr)
    return df.select("doc_id", "form_type", out.alias("fields"))
