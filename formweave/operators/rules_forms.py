"""Per-form validators written as Column rules over the flat record.

A validator is a function ``(Record, Thresholds) -> list``; each element is a rule of one code (``raised``) or an array
of exceptions, empty where the rule does not fire. ``register_rule`` adds a user rule to any form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..fixed_values import DEFAULTS, Thresholds
from ..functions import scalar as S
from .exceptions import Raised, concat, empty, exc, raised, raised_each, raised_one_of
from .records import Record

Rules = list[Column | Raised]
_TIN_CODES = ["ID_MASKED_SSN", "ID_INVALID_SSN", "ID_INVALID_TIN"]


# --- shared building blocks ------------------------------------------------------------------------------
def required(r: Record, *names: str) -> Rules:
    return [raised(r.blank(n), "FLD_ZERO_VS_BLANK", n) for n in names]


def non_negative(r: Record, *names: str) -> Rules:
    return [raised(r.num(n) < 0, "NUM_NEGATIVE_VALUE", n, num=r.num(n)) for n in names]


def ein(r: Record, name: str) -> Rules:
    s = r.fact(f"text:{name}", S.strip(r.text(name)))
    return [raised(r.fact(f"ein:{name}", S.bad_ein(S.strip(r.text(name)))), "ID_INVALID_TIN", name, s)]


def any_tin(r: Record, name: str) -> Rules:
    s = r.fact(f"text:{name}", S.strip(r.text(name)))
    return [raised_one_of(r.fact(f"tin:{name}", S.tin_code(S.strip(r.text(name)))), _TIN_CODES, name, s)]


def backup_withholding(r: Record, income: Column, tax_field: str | Column, t: Thresholds) -> Rules:
    """24 % check, only where the record says that backup withholding applies."""
    tax = r.num(tax_field)
    off = F.abs(S.round2(income * t.backup_withholding_rate) - tax) > F.greatest(
        F.lit(t.math_tolerance), income * t.backup_relative_tolerance)
    applies = r.truthy("second_tin_notice") | r.truthy("backup_withholding_applies")
    return [raised(applies & (income != 0) & (tax > 0) & off, "NUM_SUBTOTAL_MISMATCH", tax_field, num=tax)]


def exceeds(r: Record, part: str, whole: str, t: Thresholds, code: str = "NUM_SUBTOTAL_MISMATCH") -> Rules:
    return [raised(r.num(part) > r.num(whole) + t.math_tolerance, code, part, num=r.num(part))]


def below_threshold(r: Record, name: str, limit: float) -> Rules:
    v = r.num(name)
    return [raised((v > 0) & (v < limit), "STR_SCHEDULE_MISSING", name, num=v)]


def share(r: Record, name: str) -> Rules:
    v = r.num(name)
    return [raised((v < 0) | (v > 100), "NUM_NEGATIVE_VALUE", name, num=v)]


# --- validators ----------------------------------------------------------------------------------------------
def w2(r: Record, t: Thresholds) -> Rules:
    tol = t.math_tolerance
    ssw, sst = r.num("social_security_wages"), r.num("social_security_tax_withheld")
    mw, mt = r.num("medicare_wages_and_tips"), r.num("medicare_tax_withheld")
    wages, dep = r.num("wages_tips_compensation"), r.num("dependent_care_benefits")
    ssn = r.text("employee_ssn")
    status = r.fact("w2 ssn", S.tin_status(ssn))
    return [
        *required(r, "wages_tips_compensation", "employee_ssn", "employer_tin", "employer_name", "employee_name"),
        *non_negative(r, "wages_tips_compensation", "federal_income_tax_withheld", "social_security_wages",
                      "social_security_tax_withheld", "medicare_wages_and_tips", "medicare_tax_withheld"),
        raised(F.abs(S.round2(ssw * t.ss_rate) - sst) > tol, "NUM_SUBTOTAL_MISMATCH", "social_security_tax_withheld", num=sst),
        raised(F.abs(S.round2(mw * t.medicare_rate) - mt) > tol, "NUM_SUBTOTAL_MISMATCH", "medicare_tax_withheld", num=mt),
        raised((wages > 0) & (mw < wages - tol), "NUM_SUBTOTAL_MISMATCH", "medicare_wages_and_tips", num=mw),
        raised(ssw > t.ss_wage_base + tol, "NUM_LARGE_OUTLIER", "social_security_wages", num=ssw),
        raised(sst > t.max_ss_tax + tol, "NUM_LARGE_OUTLIER", "social_security_tax_withheld", num=sst),
        raised(dep > t.dependent_care_limit + tol, "CTX_FILING_STATUS_DEP", "dependent_care_benefits", num=dep),
        raised(status == "masked", "ID_MASKED_SSN", "employee_ssn", ssn),
        raised(status == "bad", "ID_INVALID_SSN", "employee_ssn", ssn),
        *ein(r, "employer_tin"),
    ]


def f1040(r: Record, t: Thresholds) -> Rules:
    tol = t.math_tolerance
    total, agi, taxable = r.num("total_income"), r.num("adjusted_gross_income"), r.num("taxable_income")
    wh_parts = r.num0("withholding_w2") + r.num0("withholding_1099") + r.num0("withholding_other")
    wh = r.num("total_withholding")
    owed, over = r.num("amount_owed"), r.num("overpayment")
    balance = r.fact("1040 balance", S.round2(r.num("total_tax") - r.num("total_payments")))
    filing = r.fact("filing status", F.lower(S.strip(F.coalesce(r.text("filing_status"), F.lit("")))))
    std, minimum = r.num("standard_or_itemized_ded"), S.lookup(V.STANDARD_DEDUCTIONS, filing)
    biz, sched = r.num("business_income"), r.text("schedule_c_attached")
    no_schedule = ~r.truthy("schedule_c_attached") | F.lower(sched).isin("false", "no", "0", "")
    spouse_single = filing.isin("single", "head of household", "hoh")
    return [
        *required(r, "taxpayer_ssn", "total_income", "adjusted_gross_income"),
        *non_negative(r, "total_income", "adjusted_gross_income", "taxable_income", "total_withholding",
                      "estimated_tax_payments"),
        raised(F.abs(S.round2(total - r.num0("adjustments_to_income")) - agi) > tol, "NUM_SUBTOTAL_MISMATCH",
               "adjusted_gross_income", num=agi),
        raised(F.abs(S.floor_zero(S.round2(agi - r.num0("total_deductions"))) - taxable) > tol,
               "NUM_SUBTOTAL_MISMATCH", "taxable_income", num=taxable),
        raised((wh_parts > 0) & (F.abs(S.round2(wh_parts) - wh) > tol), "NUM_SUBTOTAL_MISMATCH", "total_withholding", num=wh),
        raised((balance > tol) & (F.abs(owed - balance) > tol), "NUM_SUBTOTAL_MISMATCH", "amount_owed", num=owed),
        raised((balance < -tol) & (F.abs(over - F.abs(balance)) > tol),
               "NUM_SUBTOTAL_MISMATCH", "overpayment", num=over),
        raised(agi > total + tol, "NUM_NEGATIVE_VALUE", "adjusted_gross_income", num=agi),
        raised(taxable > agi + tol, "NUM_NEGATIVE_VALUE", "taxable_income", num=taxable),
        raised(wh > total + tol, "NUM_WITHHOLDING_GT_INC", "total_withholding", num=wh),
        raised(std < minimum - tol, "CTX_FILING_STATUS_DEP", "standard_or_itemized_ded", num=std),
        raised((biz != 0) & no_schedule, "CTX_BIZ_NO_SCHED_C", "business_income", num=biz),
        *any_tin(r, "taxpayer_ssn"),
        *any_tin(r, "spouse_ssn"),
        raised(r.text("spouse_ssn").isNotNull() & spouse_single, "CTX_SPOUSE_SINGLE", "spouse_ssn", r.text("spouse_ssn")),
    ]


def f1099_nec(r: Record, t: Thresholds) -> Rules:
    return [
        *required(r, "nonemployee_compensation", "payer_tin", "recipient_tin"),
        *non_negative(r, "nonemployee_compensation", "federal_income_tax_withheld"),
        *backup_withholding(r, r.num("nonemployee_compensation"), "federal_income_tax_withheld", t),
        *below_threshold(r, "nonemployee_compensation", t.nec_threshold),
        *ein(r, "payer_tin"), *any_tin(r, "recipient_tin"),
    ]


def f1099_int(r: Record, t: Thresholds) -> Rules:
    return [
        *required(r, "interest_income", "payer_tin"),
        *non_negative(r, "interest_income", "bond_premium"),
        *backup_withholding(r, r.num("interest_income"), "federal_income_tax_withheld", t),
        *below_threshold(r, "interest_income", t.interest_threshold),
        *exceeds(r, "bond_premium", "interest_income", t),
        *ein(r, "payer_tin"), *any_tin(r, "recipient_tin"),
    ]


def f1099_div(r: Record, t: Thresholds) -> Rules:
    cap = r.num("total_capital_gain_distr")
    parts = r.fact("div parts", S.round2(r.num0("unrecaptured_sec1250_gain") + r.num0("section_1202_gain") + r.num0("collectibles_28pct_gain")))
    return [
        *required(r, "total_ordinary_dividends", "payer_tin"),
        *non_negative(r, "total_ordinary_dividends", "qualified_dividends", "total_capital_gain_distr"),
        *backup_withholding(r, r.num("total_ordinary_dividends"), "federal_income_tax_withheld", t),
        *below_threshold(r, "total_ordinary_dividends", t.interest_threshold),
        *exceeds(r, "qualified_dividends", "total_ordinary_dividends", t),
        raised((parts > 0) & (parts > cap + t.math_tolerance), "NUM_SUBTOTAL_MISMATCH", "total_capital_gain_distr", num=cap),
        *ein(r, "payer_tin"), *any_tin(r, "recipient_tin"),
    ]


def f1099_r(r: Record, t: Thresholds) -> Rules:
    code = r.text("distribution_code")
    codes = r.fact("distribution codes", F.transform(
        F.filter(F.split(code, r"[,/\s]+"), lambda c: S.strip(c) != ""), lambda c: F.upper(S.strip(c))))
    valid = F.array(*[F.lit(c) for c in V.DISTRIBUTION_CODES])
    bad = raised_each(F.filter(codes, lambda c: ~F.array_contains(valid, c)),
                      lambda c: exc("DB_TYPE_CONFLICT", "distribution_code", c))
    return [
        *required(r, "gross_distribution", "payer_tin", "distribution_code"),
        *non_negative(r, "gross_distribution", "federal_income_tax_withheld"),
        *exceeds(r, "taxable_amount", "gross_distribution", t),
        *exceeds(r, "capital_gain", "taxable_amount", t),
        *exceeds(r, "federal_income_tax_withheld", "gross_distribution", t, "NUM_WITHHOLDING_GT_INC"),
        bad,
        raised(F.array_contains(codes, "1"), "CTX_FILING_STATUS_DEP", "distribution_code", F.lit("1")),
        *ein(r, "payer_tin"), *any_tin(r, "recipient_tin"),
    ]


def f1099_misc(r: Record, t: Thresholds) -> Rules:
    positive = [F.coalesce(r.num(f) > 0, F.lit(False)) for f in V.MISC_INCOME_FIELDS]
    has_income = positive[0]
    for p in positive[1:]:
        has_income = has_income | p
    return [
        *required(r, "payer_tin"),
        raised(~has_income, "FLD_ZERO_VS_BLANK"),
        *below_threshold(r, "rents", 600.0), *below_threshold(r, "royalties", 10.0),
        *below_threshold(r, "medical_health_care_payments", 600.0),
        *non_negative(r, *V.MISC_INCOME_FIELDS),
        *ein(r, "payer_tin"), *any_tin(r, "recipient_tin"),
    ]


def f1099_b(r: Record, t: Thresholds) -> Rules:
    proceeds, cost, wash = r.num("proceeds"), r.num("cost_or_basis"), r.num0("wash_sale_loss_disallowed")
    return [
        *required(r, "proceeds", "payer_tin"), *non_negative(r, "proceeds"),
        raised((wash > 0) & (proceeds >= cost), "NUM_DUPLICATE_ENTRY", "wash_sale_loss_disallowed", num=wash),
        raised((proceeds > 0) & (proceeds - cost + wash > proceeds * 2), "NUM_DECIMAL_MISPLACE", "cost_or_basis", num=cost),
        *ein(r, "payer_tin"), *any_tin(r, "recipient_tin"),
    ]


def f1099_g(r: Record, t: Thresholds) -> Rules:
    uc, refund, held = r.num("unemployment_compensation"), r.num("state_local_tax_refund"), r.num("federal_income_tax_withheld")
    off = F.abs(S.round2(uc * t.uc_withholding_rate) - held) > F.greatest(
        F.lit(t.math_tolerance), uc * t.uc_withholding_tolerance)
    return [
        *required(r, "payer_tin"),
        raised(uc.isNull() & refund.isNull(), "FLD_ZERO_VS_BLANK"),
        raised(uc <= 0, "NUM_NEGATIVE_VALUE", "unemployment_compensation", num=uc),
        raised((held > 0) & off, "NUM_SUBTOTAL_MISMATCH", "federal_income_tax_withheld", num=held),
        *ein(r, "payer_tin"), *any_tin(r, "recipient_tin"),
    ]


def f1099_k(r: Record, t: Thresholds) -> Rules:
    gross, tol = r.num("gross_amount_payment_card"), t.math_tolerance
    months = [r.num(m) for m in V.MONTHS]
    filled = r.fact("months filled", sum((F.when(m.isNotNull(), 1).otherwise(0) for m in months[1:]), F.when(months[0].isNotNull(), 1).otherwise(0)))
    total = F.coalesce(months[0], F.lit(0.0))
    for m in months[1:]:
        total = total + F.coalesce(m, F.lit(0.0))
    total = r.fact("months total", S.round2(total))
    mismatch = (filled >= 6) & ((total > gross + tol) | ((filled == 12) & (F.abs(total - gross) > tol)))
    return [
        *required(r, "gross_amount_payment_card", "payer_tin"), *non_negative(r, "gross_amount_payment_card"),
        *exceeds(r, "card_not_present_transactions", "gross_amount_payment_card", t),
        raised(mismatch, "NUM_SUBTOTAL_MISMATCH", "gross_amount_payment_card", num=gross),
        *below_threshold(r, "gross_amount_payment_card", t.card_threshold),
        *ein(r, "payer_tin"), *any_tin(r, "recipient_tin"),
    ]


def f1099_s(r: Record, t: Thresholds) -> Rules:
    gross = r.num("gross_proceeds")
    return [
        *required(r, "gross_proceeds", "payer_tin", "date_of_closing"),
        raised(gross <= 0, "NUM_NEGATIVE_VALUE", "gross_proceeds", num=gross),
        *any_tin(r, "payer_tin"), *any_tin(r, "recipient_tin"),
    ]


def k1_1065(r: Record, t: Thresholds) -> Rules:
    end = r.num("ending_capital_account")
    rolled = r.fact("capital rolled", S.round2(r.num0("beginning_capital_account") + r.num0("contributions") + r.num0("current_year_net_income")
                      - F.abs(r.num0("withdrawals_distributions"))))
    tol = F.greatest(F.lit(t.k1_tolerance), F.abs(end) * t.k1_relative_tolerance)
    gp = r.num0("guaranteed_payments_services") + r.num0("guaranteed_payments_capital")
    gp_total = r.num("total_guaranteed_payments")
    return [
        *required(r, "partnership_tin", "partner_tin", "ending_capital_account"),
        raised(F.abs(rolled - end) > tol, "NUM_SUBTOTAL_MISMATCH", "ending_capital_account", num=end),
        raised((gp > 0) & (F.abs(S.round2(gp) - gp_total) > t.math_tolerance), "NUM_SUBTOTAL_MISMATCH",
               "total_guaranteed_payments", num=gp_total),
        *exceeds(r, "qualified_dividends", "ordinary_dividends", t),
        *share(r, "partner_share_percentage"),
        raised(end < -t.math_tolerance, "NUM_LARGE_OUTLIER", "ending_capital_account", num=end),
        *ein(r, "partnership_tin"), *any_tin(r, "partner_tin"),
    ]


def k1_1120s(r: Record, t: Thresholds) -> Rules:
    income = r.num("ordinary_business_income")
    return [
        *required(r, "corporation_tin", "shareholder_tin"),
        *exceeds(r, "qualified_dividends", "ordinary_dividends", t),
        *share(r, "shareholder_share_percentage"),
        raised(income < t.s_corp_loss, "CTX_BIZ_NO_SCHED_C", "ordinary_business_income", num=income),
        *ein(r, "corporation_tin"), *any_tin(r, "shareholder_tin"),
    ]


def k1_1041(r: Record, t: Thresholds) -> Rules:
    final = r.num("final_year_deductions")
    return [
        *required(r, "estate_tin", "beneficiary_tin"),
        *exceeds(r, "qualified_dividends", "ordinary_dividends", t),
        raised(final < 0, "NUM_NEGATIVE_VALUE", "final_year_deductions", num=final),
        *ein(r, "estate_tin"), *any_tin(r, "beneficiary_tin"),
    ]


def generic_1099(r: Record, t: Thresholds, fields: Column) -> Rules:
    """Forms without a validator of their own: payer EIN, any positive amount, backup withholding."""
    positive = r.fact("positive amounts", F.filter(fields, lambda x: x["nf"] & (x["d"] > 0)))
    income = F.try_element_at(positive, F.lit(1))["d"]
    fed, other = r.num("federal_income_tax_withheld"), r.num("federal_tax_withheld")
    tax_field = F.when(fed > 0, F.lit("federal_income_tax_withheld")).when(other > 0, F.lit("federal_tax_withheld"))
    return [
        raised(r.text("payer_tin").isNull(), "FLD_ZERO_VS_BLANK", "payer_tin"),
        *ein(r, "payer_tin"), *any_tin(r, "recipient_tin"),
        raised(F.size(positive) == 0, "FLD_ZERO_VS_BLANK"),
        *backup_withholding(r, income, tax_field, t),
    ]


def unknown_form(fields: Column | None, r: Record, t: Thresholds) -> Rules:
    if r.layout:
        nulls, total = sum((F.when(r.absent(n), 1).otherwise(0) for n in r.layout), F.lit(0)), F.lit(len(r.layout))
    else:
        nulls, total = F.size(F.filter(fields, lambda x: x["kind"] == "null")), F.size(fields)
    return [
        raised(nulls == total, "FLD_ZERO_VS_BLANK"),
        raised((nulls < total) & (nulls / total > t.null_ratio), "STR_OPTIONAL_BLANK", num=nulls),
    ]


def scan_profile_1040(r: Record, image_only: Column) -> Column:
    """Extra rules for a 1040 without a text layer; (code, field) pairs are distinct by construction."""
    items = [F.array(exc("OCR_LOW_CONFIDENCE", None, None, F.lit(0.0)))]
    for f in ("taxpayer_ssn", "total_income", "adjusted_gross_income"):
        v, n = r.value(f), r.number(f)
        items += [
            raised(r.blank(f), "FLD_ZERO_VS_BLANK", f, v), raised(r.blank(f), "LLM_BLANK_AS_MISSING", f, v),
            F.array(exc("FLD_ILLEGIBLE", f, v, n)),
        ]
    items.append(F.array(exc("LLM_OVER_INFERENCE")))
    return F.when(image_only, concat(items)).otherwise(empty())


# --- dispatch ----------------------------------------------------------------------------------------------------
VALIDATORS: dict[str, Callable[[Record, Thresholds], Rules]] = {
    "W_2": w2, "1040": f1040, "1099_NEC": f1099_nec, "1099_INT": f1099_int, "1099_DIV": f1099_div,
    "1099_R": f1099_r, "1099_MISC": f1099_misc, "1099_B": f1099_b, "1099_G": f1099_g, "1099_K": f1099_k,
    "1099_S": f1099_s, "K_1_1065": k1_1065, "K_1_1120S": k1_1120s, "K_1_1041": k1_1041,
}
GENERIC_FORMS = ["1099_Q", "1099_SA", "1099_OID", "1099_PATR", "1099_LS", "1099_LTC"]
_USER_RULES: dict[str, list[Callable[[Record], Raised]]] = {}


def register_rule(form_type: str, code: str, field: str | None, predicate: Callable[[Record], Column],
                  value: Callable[[Record], Column] | None = None) -> None:
    """Add a rule to a form. The code must be in the registry."""
    if code not in V.SEVERITY:
        raise KeyError(f"unknown exception code {code!r}")
    _USER_RULES.setdefault(form_key(form_type), []).append(
        lambda r: raised(predicate(r), code, field, value(r) if value else None))


def clear_rules() -> None:
    _USER_RULES.clear()


def form_key(form_type: str) -> str:
    return form_type.replace("-", "_").replace(" ", "_").replace("(", "").replace(")", "")


def form_key_column(form_type: Column) -> Column:
    return F.translate(form_type, "- ()", "__")


def form_exceptions(form_type: Column, fields: Column, r: Record, t: Thresholds = DEFAULTS,
                    image_only: Column | None = None, forms: list[str] | None = None) -> Column:
    """Exceptions of the validator chosen by form type, in one CASE; a row runs one branch only.

    ``forms`` limits the branches that are planned when the input is known to hold few form types.
    """
    key = form_key_column(form_type)
    wanted = None if forms is None else {form_key(f) for f in forms}
    out = None
    for k, fn in VALIDATORS.items():
        if wanted is not None and k not in wanted:
            continue
        arr = concat(fn(r, t) + [u(r) for u in _USER_RULES.get(k, [])])
        if k == "1040" and image_only is not None:
            arr = F.concat(scan_profile_1040(r, image_only), arr)
        out = F.when(key == k, arr) if out is None else out.when(key == k, arr)
    if wanted is None or wanted & set(GENERIC_FORMS):
        arr = concat(generic_1099(r, t, fields))
        cond = key.isin(GENERIC_FORMS)
        out = F.when(cond, arr) if out is None else out.when(cond, arr)
    for k, extra in _USER_RULES.items():
        if k not in VALIDATORS and k not in GENERIC_FORMS:
            cond, arr = key == k, concat([u(r) for u in extra])
            out = F.when(cond, arr) if out is None else out.when(cond, arr)
    rest = concat(unknown_form(fields, r, t))
    return rest if out is None else out.otherwise(rest)


def single_form_rules(form_type: Column, r: Record, t: Thresholds, forms: list[str]) -> list[Raised] | None:
    """The rules of a few forms one by one, each bound to its form; None where users added rules or some rule is no rule of one code."""
    keys = [form_key(f) for f in forms]
    if _USER_RULES or not set(keys) <= set(VALIDATORS):
        return None
    on = {k: r.fact(f"form:{k}", F.coalesce(form_key_column(form_type) == k, F.lit(False))) for k in keys}
    other = F.lit(True)
    for c in on.values():
        other = other & ~c
    rules = [(c, x) for k, c in on.items() for x in VALIDATORS[k](r, t)] + [(other, x) for x in unknown_form(None, r, t)]
    return [x.where(c) for c, x in rules] if all(isinstance(x, Raised) for _, x in rules) else None
