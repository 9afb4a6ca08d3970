"""Text of the SQL checks for rules. Written against plain columns, apart from the Spark rule code."""

from __future__ import annotations

from .. import fixed_values as V
from .inputs import lenient_sql

BAD_EIN = "(" + ",".join(f"'{p}'" for p in V.BAD_EIN_PREFIXES) + ")"


def wide_cte(name: str, base: str, fields: list[tuple], where: str = "true") -> str:
    """CTE with d_<field> (number) and t_<field> (text, 'x' where a number is stored) columns."""
    cols = ["doc_id"]
    for f, n, s in fields:
        if n and s:
            cols.append(f"case when {s} is not null then {lenient_sql(s)} else cast({n} as double) end as d_{f}")
            cols.append(f"coalesce({s}, case when {n} is not null then 'x' end) as t_{f}")
        elif n:
            cols.append(f"cast({n} as double) as d_{f}")
            cols.append(f"case when {n} is not null then 'x' end as t_{f}")
        elif s:
            cols.append(f"{lenient_sql(s)} as d_{f}")
            cols.append(f"{s} as t_{f}")
        else:
            cols.append(f"cast(null as double) as d_{f}")
            cols.append(f"cast(null as varchar) as t_{f}")
    return f"{name} as (select {', '.join(cols)} from {base} where {where})"


def row(cte: str, cond: str, code: str, field: str | None, value: str = "null", num: str = "null") -> str:
    f = "cast(null as varchar)" if field is None else f"'{field}'"
    return (f"select doc_id, '{code}' as code, {f} as field, cast({value} as varchar) as value, "
            f"cast({num} as double) as value_num from {cte} where {cond}")


def required(cte, *names):
    return [row(cte, f"coalesce(trim(t_{n}), '') = ''", "FLD_ZERO_VS_BLANK", n) for n in names]


def negative(cte, *names):
    return [row(cte, f"d_{n} < 0", "NUM_NEGATIVE_VALUE", n, num=f"d_{n}") for n in names]


def ein(cte, n):
    s = f"trim(t_{n})"
    return [row(cte, f"t_{n} is not null and (not regexp_matches({s}, '^[0-9]{{2}}-[0-9]{{7}}$') or left({s}, 2) in {BAD_EIN})",
                "ID_INVALID_TIN", n, s)]


def tin_state(s):
    return f"""(case when {s} is null then null
      when regexp_matches({s}, '^[*Xx]{{3}}-[*Xx]{{2}}-[0-9]{{4}}$') or regexp_matches({s}, '^[0-9]{{3}}-[0-9]{{2}}-[*Xx]{{4}}$')
        or regexp_matches({s}, '^[*Xx]{{3}}-[*Xx]{{2}}-[*Xx]{{4}}$') then 'masked'
      when regexp_matches({s}, '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$') then
        case when substr({s},1,3) in ('000','666') or substr({s},1,1) = '9' or substr({s},5,2) = '00' or substr({s},8,4) = '0000' then 'bad' else 'ok' end
      when regexp_matches({s}, '^[0-9]{{2}}-[0-9]{{7}}$') then case when substr({s},1,2) in {BAD_EIN} then 'bad' else 'ok' end
      else 'bad' end)"""


def any_tin(cte, n):
    s = f"trim(t_{n})"
    nine = f"length(regexp_replace({s}, '[^0-9]', '', 'g')) = 9"
    st = tin_state(s)
    return [
        row(cte, f"{st} = 'masked'", "ID_MASKED_SSN", n, s),
        row(cte, f"{st} = 'bad' and {nine}", "ID_INVALID_SSN", n, s),
        row(cte, f"{st} = 'bad' and not {nine}", "ID_INVALID_TIN", n, s),
    ]


def r2(e):
    return f"cast(round(cast({e} as decimal(18,6)),2) as double)"


def backup(cte, inc, tax, flag):
    return [row(cte, f"t_{flag} is not null and t_{flag} <> '' and d_{inc} <> 0 and d_{tax} > 0 and "
                     f"abs({r2(f'd_{inc} * 0.24')} - d_{tax}) > greatest(1.0, d_{inc} * 0.01)",
                "NUM_SUBTOTAL_MISMATCH", tax, num=f"d_{tax}")]


def exceeds(cte, part, whole, code="NUM_SUBTOTAL_MISMATCH"):
    return [row(cte, f"d_{part} > d_{whole} + 1.0", code, part, num=f"d_{part}")]


def below(cte, n, limit):
    return [row(cte, f"d_{n} > 0 and d_{n} < {limit}", "STR_SCHEDULE_MISSING", n, num=f"d_{n}")]


def share(cte, n):
    return [row(cte, f"d_{n} < 0 or d_{n} > 100", "NUM_NEGATIVE_VALUE", n, num=f"d_{n}")]


def num(cte, cond, code, field):
    return [row(cte, cond, code, field, num=f"d_{field}")]


MIS = "NUM_SUBTOTAL_MISMATCH"


def w2(c):
    s = "t_employee_ssn"
    return [
        *required(c, "wages_tips_compensation", "employee_ssn", "employer_tin", "employer_name", "employee_name"),
        *negative(c, "wages_tips_compensation", "federal_income_tax_withheld", "social_security_wages",
                  "social_security_tax_withheld", "medicare_wages_and_tips", "medicare_tax_withheld"),
        *num(c, f"abs({r2('d_social_security_wages * 0.062')} - d_social_security_tax_withheld) > 1.0", MIS, "social_security_tax_withheld"),
        *num(c, f"abs({r2('d_medicare_wages_and_tips * 0.0145')} - d_medicare_tax_withheld) > 1.0", MIS, "medicare_tax_withheld"),
        *num(c, "d_wages_tips_compensation > 0 and d_medicare_wages_and_tips < d_wages_tips_compensation - 1.0", MIS, "medicare_wages_and_tips"),
        *num(c, "d_social_security_wages > 168601.0", "NUM_LARGE_OUTLIER", "social_security_wages"),
        *num(c, "d_social_security_tax_withheld > 10454.2", "NUM_LARGE_OUTLIER", "social_security_tax_withheld"),
        *num(c, "d_dependent_care_benefits > 5001.0", "CTX_FILING_STATUS_DEP", "dependent_care_benefits"),
        row(c, f"{tin_state(f'trim({s})')} = 'masked'", "ID_MASKED_SSN", "employee_ssn", s),
        row(c, f"{tin_state(f'trim({s})')} = 'bad'", "ID_INVALID_SSN", "employee_ssn", s),
        *ein(c, "employer_tin"),
    ]


def f1040(c):
    z = lambda n: f"coalesce(d_{n}, 0.0)"
    status = "lower(trim(coalesce(t_filing_status, '')))"
    wh = f"({z('withholding_w2')} + {z('withholding_1099')})"
    bal = r2("d_total_tax - d_total_payments")
    std = "case " + " ".join(f"when {status} = '{k}' then {v}" for k, v in V.STANDARD_DEDUCTIONS.items()) + " end"
    return [
        *required(c, "taxpayer_ssn", "total_income", "adjusted_gross_income"),
        *negative(c, "total_income", "adjusted_gross_income", "taxable_income", "total_withholding", "estimated_tax_payments"),
        *num(c, f"abs({r2('d_total_income - ' + z('adjustments_to_income'))} - d_adjusted_gross_income) > 1.0", MIS, "adjusted_gross_income"),
        *num(c, f"d_adjusted_gross_income is not null and abs(greatest(0.0, {r2('d_adjusted_gross_income - ' + z('total_deductions'))}) - d_taxable_income) > 1.0", MIS, "taxable_income"),
        *num(c, f"{wh} > 0 and abs({r2(wh)} - d_total_withholding) > 1.0", MIS, "total_withholding"),
        *num(c, f"{bal} > 1.0 and abs(d_amount_owed - {bal}) > 1.0", MIS, "amount_owed"),
        *num(c, f"{bal} < -1.0 and abs(d_overpayment - abs({bal})) > 1.0", MIS, "overpayment"),
        *num(c, "d_adjusted_gross_income > d_total_income + 1.0", "NUM_NEGATIVE_VALUE", "adjusted_gross_income"),
        *num(c, "d_taxable_income > d_adjusted_gross_income + 1.0", "NUM_NEGATIVE_VALUE", "taxable_income"),
        *num(c, "d_total_withholding > d_total_income + 1.0", "NUM_WITHHOLDING_GT_INC", "total_withholding"),
        *num(c, f"d_standard_or_itemized_ded < ({std}) - 1.0", "CTX_FILING_STATUS_DEP", "standard_or_itemized_ded"),
        *num(c, "d_business_income <> 0 and coalesce(lower(t_schedule_c_attached), '') in ('false','no','0','')", "CTX_BIZ_NO_SCHED_C", "business_income"),
        *any_tin(c, "taxpayer_ssn"), *any_tin(c, "spouse_ssn"),
        row(c, f"t_spouse_ssn is not null and {status} in ('single','head of household','hoh')", "CTX_SPOUSE_SINGLE", "spouse_ssn", "t_spouse_ssn"),
    ]


def tins(c):
    return [*ein(c, "payer_tin"), *any_tin(c, "recipient_tin")]


def nec(c):
    f, w = "nonemployee_compensation", "federal_income_tax_withheld"
    return [*required(c, f, "payer_tin", "recipient_tin"), *negative(c, f, w), *backup(c, f, w, "second_tin_notice"), *below(c, f, 600), *tins(c)]


def interest(c):
    f, w = "interest_income", "federal_income_tax_withheld"
    return [*required(c, f, "payer_tin"), *negative(c, f, "bond_premium"), *backup(c, f, w, "second_tin_notice"), *below(c, f, 10),
            *exceeds(c, "bond_premium", f), *tins(c)]


def dividends(c):
    f, w = "total_ordinary_dividends", "federal_income_tax_withheld"
    parts = r2("coalesce(d_unrecaptured_sec1250_gain,0.0) + coalesce(d_section_1202_gain,0.0)")
    return [*required(c, f, "payer_tin"), *negative(c, f, "qualified_dividends", "total_capital_gain_distr"),
            *backup(c, f, w, "second_tin_notice"), *below(c, f, 10), *exceeds(c, "qualified_dividends", f),
            *num(c, f"{parts} > 0 and {parts} > d_total_capital_gain_distr + 1.0", MIS, "total_capital_gain_distr"), *tins(c)]


def retirement(c):
    codes = "list_transform(list_filter(regexp_split_to_array(t_distribution_code, '[,/\\s]+'), lambda x: trim(x) <> ''), lambda x: upper(trim(x)))"
    valid = ",".join(f"'{x}'" for x in V.DISTRIBUTION_CODES)
    return [*required(c, "gross_distribution", "payer_tin", "distribution_code"), *negative(c, "gross_distribution", "federal_income_tax_withheld"),
            *exceeds(c, "taxable_amount", "gross_distribution"), *exceeds(c, "capital_gain", "taxable_amount"),
            *exceeds(c, "federal_income_tax_withheld", "gross_distribution", "NUM_WITHHOLDING_GT_INC"),
            f"select doc_id, 'DB_TYPE_CONFLICT' as code, 'distribution_code' as field, code_item as value, cast(null as double) as value_num "
            f"from (select doc_id, unnest({codes}) as code_item from {c}) u where code_item not in ({valid})",
            row(c, f"list_contains({codes}, '1')", "CTX_FILING_STATUS_DEP", "distribution_code", "'1'"), *tins(c)]


def misc(c):
    f = ["rents", "royalties", "medical_health_care_payments", "other_income"]
    none = " and ".join(f"coalesce(d_{x}, 0) <= 0" for x in f)
    return [*required(c, "payer_tin"), row(c, none, "FLD_ZERO_VS_BLANK", None), *below(c, "rents", 600), *below(c, "royalties", 10),
            *below(c, "medical_health_care_payments", 600), *negative(c, *f), *tins(c)]


def broker(c):
    return [*required(c, "proceeds", "payer_tin"), *negative(c, "proceeds"),
            *num(c, "d_wash_sale_loss_disallowed > 0 and d_proceeds >= d_cost_or_basis", "NUM_DUPLICATE_ENTRY", "wash_sale_loss_disallowed"),
            *num(c, "d_proceeds > 0 and d_proceeds - d_cost_or_basis + coalesce(d_wash_sale_loss_disallowed, 0.0) > d_proceeds * 2", "NUM_DECIMAL_MISPLACE", "cost_or_basis"),
            *tins(c)]


def government(c):
    uc, w = "d_unemployment_compensation", "d_federal_income_tax_withheld"
    return [*required(c, "payer_tin"), row(c, f"{uc} is null and d_state_local_tax_refund is null", "FLD_ZERO_VS_BLANK", None),
            *num(c, f"{uc} <= 0", "NUM_NEGATIVE_VALUE", "unemployment_compensation"),
            *num(c, f"{w} > 0 and abs({r2(uc + ' * 0.1')} - {w}) > greatest(1.0, {uc} * 0.05) and {uc} is not null", MIS, "federal_income_tax_withheld"),
            *tins(c)]


def real_estate(c):
    return [*required(c, "gross_proceeds", "payer_tin", "date_of_closing"), *num(c, "d_gross_proceeds <= 0", "NUM_NEGATIVE_VALUE", "gross_proceeds"),
            *any_tin(c, "payer_tin"), *any_tin(c, "recipient_tin")]


def card(c):
    g = "gross_amount_payment_card"
    filled = "(" + " + ".join(f"case when d_{m} is null then 0 else 1 end" for m in V.MONTHS) + ")"
    total = r2(" + ".join(f"coalesce(d_{m}, 0.0)" for m in V.MONTHS))
    return [*required(c, g, "payer_tin"), *negative(c, g), *exceeds(c, "card_not_present_transactions", g),
            *num(c, f"{filled} >= 6 and ({total} > d_{g} + 1.0 or ({filled} = 12 and abs({total} - d_{g}) > 1.0))", MIS, g),
            *below(c, g, 5000), *tins(c)]


def k1_partner(c):
    z = lambda n: f"coalesce(d_{n}, 0.0)"
    end = "d_ending_capital_account"
    rolled = r2(f"{z('beginning_capital_account')} + {z('contributions')} - abs({z('withdrawals_distributions')})")
    gp = f"({z('guaranteed_payments_services')} + {z('guaranteed_payments_capital')})"
    return [*required(c, "partnership_tin", "partner_tin", "ending_capital_account"),
            *num(c, f"{end} is not null and abs({rolled} - {end}) > greatest(5.0, abs({end}) * 0.0001)", MIS, "ending_capital_account"),
            *num(c, f"{gp} > 0 and abs({r2(gp)} - d_total_guaranteed_payments) > 1.0", MIS, "total_guaranteed_payments"),
            *exceeds(c, "qualified_dividends", "ordinary_dividends"), *share(c, "partner_share_percentage"),
            *num(c, f"{end} < -1.0", "NUM_LARGE_OUTLIER", "ending_capital_account"), *ein(c, "partnership_tin"), *any_tin(c, "partner_tin")]


def k1_scorp(c):
    return [*required(c, "corporation_tin", "shareholder_tin"), *exceeds(c, "qualified_dividends", "ordinary_dividends"),
            *share(c, "shareholder_share_percentage"), *num(c, "d_ordinary_business_income < -50000", "CTX_BIZ_NO_SCHED_C", "ordinary_business_income"),
            *ein(c, "corporation_tin"), *any_tin(c, "shareholder_tin")]


def k1_estate(c):
    return [*required(c, "estate_tin", "beneficiary_tin"), *exceeds(c, "qualified_dividends", "ordinary_dividends"),
            *num(c, "d_final_year_deductions < 0", "NUM_NEGATIVE_VALUE", "final_year_deductions"), *ein(c, "estate_tin"), *any_tin(c, "beneficiary_tin")]


def generic(c):
    numeric = ["gross_distribution", "original_issue_income", "federal_tax_withheld"]
    first = "case " + " ".join(f"when d_{n} > 0 then d_{n}" for n in numeric) + " end"
    t = "d_federal_tax_withheld"
    return [row(c, "t_payer_tin is null", "FLD_ZERO_VS_BLANK", "payer_tin"), *tins(c),
            row(c, " and ".join(f"coalesce(d_{n}, 0) <= 0" for n in numeric), "FLD_ZERO_VS_BLANK", None),
            *num(c, f"t_backup_withholding_applies <> '' and {t} > 0 and abs({r2(f'({first}) * 0.24')} - {t}) > greatest(1.0, ({first}) * 0.01)", MIS, "federal_tax_withheld")]


def union(rows: list[str]) -> str:
    return " union all ".join(rows)


def universal_rows(cte: str = "fl") -> list[str]:
    """Universal rules over a long field CTE with doc_id, pos, field, n, s, kind."""
    q = lambda xs: ",".join("'" + x + "'" for x in xs)
    nf = "regexp_matches(field, '(" + "|".join(V.NUMERIC_SUFFIXES) + ")$')"
    d = f"case when kind = 'str' then {lenient_sql('s')} else n end"
    t = "trim(s)"
    year = "try_cast(left(trim(coalesce(s, cast(n as varchar))), 4) as int)"
    out = [
        ("FLD_ZERO_VS_BLANK", f"{t} in ('0','0.0','0.00')", "s", "null"),
        ("FLD_SPECIAL_CHARS", f"{nf} and s is not null and regexp_replace(s, '[0-9\\s$,.\\-()+/]', '', 'g') <> ''", "s", "null"),
        ("NUM_DECIMAL_MISPLACE", f"{nf} and ({d}) > 10000000", "null", d),
        ("NUM_LARGE_OUTLIER", f"{nf} and ({d}) > 1000000 and ({d}) <= 10000000", "null", d),
        ("LLM_OVER_NORMALIZATION", f"field in ({q(V.NAME_FIELDS)}) and {t} <> '' and not regexp_matches(s, '(^|[^\\p{{L}}])\\p{{Ll}}') "
         "and not regexp_matches(s, '\\p{L}\\p{Lu}') and not (regexp_matches(s, '\\p{Lu}') and not regexp_matches(s, '\\p{Ll}'))", "s", "null"),
        ("CY_WRONG_YEAR_UPLOAD", f"field in ({q(V.YEAR_FIELDS)}) and ({year} < 2025 or {year} > 2026)", "null", year),
        ("FLD_CHECKBOX_BLANK", f"field in ({q(V.CHECKBOX_FIELDS)}) and kind = 'null'", "null", "null"),
        ("FLD_ADDRESS_COLLAPSED", f"field in ({q(V.ADDRESS_FIELDS)}) and regexp_matches(s, '[0-9]{{5}}') and regexp_matches(s, '\\b({'|'.join(V.STATE_CODES)})\\b') "
         f"and regexp_matches(s, '(?i)\\b[0-9]+\\s+\\w+\\s+({'|'.join(V.STREET_WORDS)})\\b') and s not like '%' || chr(10) || '%' and length(s) > 40", "s", "null"),
        ("FLD_NA_TEXT", f"upper({t}) in ({q(V.NA_TEXTS)})", "s", "null"),
        ("FLD_DASH_SYMBOL", f"{t} in ({q(V.DASH_TEXTS)})", "s", "null"),
        ("DB_TYPE_CONFLICT", f"{nf} and kind = 'str' and ({d}) is null and {t} not in ('', 'N/A')", "s", "null"),
    ]
    rows = [
        f"select doc_id, '{code}' as code, field, cast({v} as varchar) as value, cast({n} as double) as value_num from {cte} where {cond}"
        for code, cond, v, n in out
    ]
    rows.append(
        "select doc_id, 'NUM_ROUNDING_VARIANCE' as code, field, cast(null as varchar) as value, cast(null as double) as value_num from ("
        f"select doc_id, field, row_number() over (partition by doc_id order by pos) as rn from {cte} where {nf} and "
        f"cast(round_even(abs({d}) * 100, 0) as bigint) % 10 = 5) z where rn = 1")
    return rows


REG_CTE = "reg(code, severity) as (values " + ",".join(f"('{r[0]}','{r[4]}')" for r in V.REGISTRY) + ")"
