"""Rule catalog, context and the finding layout shared by all controls.

A control is a function ``Context -> DataFrame`` registered under its code; it covers every
company and every review month at once. New controls are added the same way from user code.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import dealt

SEP = "\u001f"


@dataclass(frozen=True)
class Rule:
    code: str
    category: str
    severity: str
    visibility: str
    params: dict[str, Any] = field(default_factory=dict)
    applies_to: tuple[str, ...] = ()
    valid_from: str = "2000-01-01"
    valid_to: str | None = None


# The rule catalog, in its order. Amount parameters are öre.
CATALOG: dict[str, Rule] = {
    r.code: r
    for r in (
        Rule("UNBALANCED_VOUCHER", "integrity", "HIGH", "INTERNAL", {"tolerance": 0}),
        Rule("IB_NE_PREV_UB", "integrity", "HIGH", "INTERNAL", {"tolerance": 100}),
        Rule("VOUCHER_NUMBER_GAP", "integrity", "MEDIUM", "INTERNAL"),
        Rule("LATE_BOOKING", "timing", "LOW", "INTERNAL", {"cash_max_days": 3, "other_max_days": 45}),
        Rule("CHANGED_AFTER_APPROVAL", "integrity", "HIGH", "INTERNAL"),
        Rule("ACCOUNT_NOT_IN_CHART", "integrity", "MEDIUM", "INTERNAL"),
        Rule("ABNORMAL_SIGN", "balance", "MEDIUM", "INTERNAL"),
        Rule("INPUT_VAT_RATIO", "vat", "MEDIUM", "CLIENT_SAFE", {"exempt_accounts": ["6300-6399", "6570", "7000-7699", "8400-8499"], "tolerance_bp": 60}),
        Rule("VAT_ACCOUNTS_NOT_CLEARED", "vat", "MEDIUM", "CLIENT_SAFE", {"tolerance": 10_000, "grace_days": 20}),
        Rule("OUTPUT_VAT_RATIO", "vat", "MEDIUM", "CLIENT_SAFE", {"tolerance_bp": 60}),
        Rule("PAYROLL_TAX_NOT_CLEARED", "payroll", "MEDIUM", "CLIENT_SAFE", {"tolerance_pct": 5, "tolerance_min": 100_000}),
        Rule("EMPLOYER_CONTRIBUTION_RATIO", "payroll", "MEDIUM", "CLIENT_SAFE", {"max_deviation_pp": 3.0}),
        Rule("TAX_ACCOUNT_BALANCE", "balance", "LOW", "CLIENT_SAFE", {"tolerance": 1_000_000}),
        Rule(
            "SUSPENSE_ACCOUNT_BALANCE",
            "balance",
            "MEDIUM",
            "INTERNAL",
            {"accounts": [], "name_pattern": r"(\bobs\b|hängkonto|oklar|okänd|felkonto|ofördelad|oidentifierad)", "tolerance": 100},
        ),
        Rule("ASSETS_WITHOUT_DEPRECIATION", "balance", "MEDIUM", "CLIENT_SAFE", {"months_missing": 2}),
        Rule("VACATION_LIABILITY_STATIC", "balance", "LOW", "CLIENT_SAFE", {"months": 3}),
        Rule("TAX_ALLOCATION_RESERVE_DUE", "balance", "MEDIUM", "CLIENT_SAFE"),
        Rule("NEGATIVE_BANK", "balance", "MEDIUM", "CLIENT_SAFE"),
        Rule("RELATED_PARTY_RECEIVABLE", "company_law", "HIGH", "CLIENT_SAFE", {"min_amount": 100_000}, ("AB",), "2006-01-01"),
        Rule("EQUITY_BELOW_HALF_SHARE_CAPITAL", "company_law", "HIGH", "CLIENT_SAFE", {}, ("AB",), "2006-01-01"),
        Rule("DUPLICATE_CANDIDATE", "pattern", "HIGH", "CLIENT_SAFE", {"min_amount": 100_000, "max_days": 14, "min_text_similarity": 0.8}),
        Rule("LARGE_MANUAL_POSTING", "pattern", "MEDIUM", "INTERNAL", {"manual_series": ["A"], "days_before_end": 3, "min_amount": 10_000_000}),
        Rule("RAPID_REVERSAL", "pattern", "MEDIUM", "INTERNAL", {"max_days": 7, "min_amount": 500_000}),
        Rule("UNUSUAL_ACCOUNT_COMBINATION", "pattern", "LOW", "INTERNAL", {"min_history_months": 6, "min_amount": 1_000_000}),
        Rule("COST_DEVIATION", "trend", "LOW", "CLIENT_SAFE", {"min_history_months": 6, "min_amount": 500_000}),
        Rule("REVENUE_COST_TREND", "trend", "LOW", "CLIENT_SAFE", {"threshold_pct": 30}),
        Rule("AML_LARGE_CASH", "aml", "MEDIUM", "RESTRICTED_AML", {"threshold": 5_000_000}, (), "2017-08-01"),
        Rule("AML_ROUND_AMOUNTS_RELATED", "aml", "LOW", "RESTRICTED_AML", {"min_amount": 5_000_000, "round_to": 1_000_000}, (), "2017-08-01"),
        Rule("AML_RAPID_IN_OUT", "aml", "MEDIUM", "RESTRICTED_AML", {"min_amount": 10_000_000, "max_days": 5, "tolerance_pct": 5}, (), "2017-08-01"),
    )
}
ORDER = {code: i for i, code in enumerate(CATALOG)}

#: What a finding of a rule says, in the words that users of the rule see and mute.
TITLES: dict[str, str] = {
    "UNBALANCED_VOUCHER": "Verifikationen balanserar inte",
    "IB_NE_PREV_UB": "Ingående balans avviker från förra årets utgående",
    "VOUCHER_NUMBER_GAP": "Lucka eller dubblett i nummerserien",
    "LATE_BOOKING": "Sent bokförd",
    "CHANGED_AFTER_APPROVAL": "Ändrad efter godkännande",
    "ACCOUNT_NOT_IN_CHART": "Kontot saknas i kontoplanen",
    "ABNORMAL_SIGN": "Saldo med fel tecken",
    "INPUT_VAT_RATIO": "Ingående moms stämmer inte med kostnaden",
    "VAT_ACCOUNTS_NOT_CLEARED": "Momskonton är inte omförda",
    "OUTPUT_VAT_RATIO": "Utgående moms stämmer inte med försäljningen",
    "PAYROLL_TAX_NOT_CLEARED": "Personalskatt eller avgifter är inte betalda",
    "EMPLOYER_CONTRIBUTION_RATIO": "Arbetsgivaravgifter avviker från lönerna",
    "TAX_ACCOUNT_BALANCE": "Skattekontot har ett saldo",
    "SUSPENSE_ACCOUNT_BALANCE": "Observationskonto har ett saldo",
    "ASSETS_WITHOUT_DEPRECIATION": "Tillgångar utan avskrivning",
    "VACATION_LIABILITY_STATIC": "Semesterlöneskulden är oförändrad",
    "TAX_ALLOCATION_RESERVE_DUE": "Periodiseringsfond ska återföras",
    "NEGATIVE_BANK": "Bankkonto med negativt saldo",
    "RELATED_PARTY_RECEIVABLE": "Fordran på närstående",
    "EQUITY_BELOW_HALF_SHARE_CAPITAL": "Eget kapital under halva aktiekapitalet",
    "DUPLICATE_CANDIDATE": "Kan vara bokförd två gånger",
    "LARGE_MANUAL_POSTING": "Stor manuell bokning nära periodens slut",
    "RAPID_REVERSAL": "Bokning som snart vändes",
    "UNUSUAL_ACCOUNT_COMBINATION": "Ovanlig kombination av konton",
    "COST_DEVIATION": "Kostnaden avviker från tidigare månader",
    "REVENUE_COST_TREND": "Tydlig förändring över tolv månader",
    "AML_LARGE_CASH": "Stor kontantrörelse",
    "AML_ROUND_AMOUNTS_RELATED": "Jämnt belopp med närstående",
    "AML_RAPID_IN_OUT": "Insättning som snart betalades ut",
}


def description(rule: str = "rule_code", vouchers: str = "vouchers", accounts: str = "accounts", variant: str = "variant") -> Column:
    """The text of a finding: what its rule says, its vouchers and accounts, and the variant."""
    title = F.element_at(F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair]), F.col(rule))
    return F.concat_ws(" ", title, F.array_join(vouchers, " "), F.array_join(F.transform(accounts, lambda a: a.cast("string")), " "), variant)


@dataclass
class Context:
    """Tables the controls read. ``params`` overrides catalog parameters per rule."""

    facts: DataFrame
    movements: DataFrame
    coverage: DataFrame
    balances: DataFrame
    balance_wide: DataFrame
    companies: DataFrame
    accounts: DataFrame
    maturity: DataFrame
    year_balances: DataFrame
    fiscal_years: DataFrame
    params: dict[str, dict[str, Any]] = field(default_factory=dict)
    changed: DataFrame | None = None

    def param(self, code: str, name: str) -> Any:
        return {**CATALOG[code].params, **self.params.get(code, {})}[name]


class LazyContext:
    """A ``Context`` over an object with its tables as attributes: a table is built when a control first reads it."""

    param = Context.param

    def __init__(self, tables: Any, changed: DataFrame | None = None) -> None:
        self.tables, self.changed, self.params = tables, changed, {}

    def __getattr__(self, name: str) -> DataFrame:
        return getattr(self.tables, name)


Control = Callable[[Context], DataFrame]
REGISTRY: dict[str, Control] = {}


def control(code: str) -> Callable[[Control], Control]:
    def register(fn: Control) -> Control:
        REGISTRY[code] = fn
        return fn

    return register


def fingerprint(code: str, *key: Column) -> Column:
    """Stable identity of a finding from its rule and key."""
    return F.substring(F.sha2(F.concat_ws(SEP, F.lit(code), *[k.cast("string") for k in key]), 256), 1, 32)


def finding(
    df: DataFrame,
    code: str,
    *,
    review: Column,
    key: list[Column],
    period: Column | None = None,
    severity: Column | None = None,
    vouchers: Column | None = None,
    accounts: Column | None = None,
    amount: Column | None = None,
    variant: Column | None = None,
) -> DataFrame:
    """Project a control's hits to the common finding columns. ``review``: review month (date)."""
    rule = CATALOG[code]
    month = F.date_format(review, "yyyy-MM")
    return df.select(
        "company_id",
        month.alias("review"),
        F.lit(code).alias("rule_code"),
        F.lit(rule.category).alias("category"),
        F.coalesce(severity, F.lit(rule.severity)).alias("severity") if severity is not None else F.lit(rule.severity).alias("severity"),
        F.lit(rule.visibility).alias("visibility"),
        (period if period is not None else month).alias("period"),
        F.concat_ws("|", *[k.cast("string") for k in key]).alias("key"),
        fingerprint(code, *key).alias("fingerprint"),
        (vouchers if vouchers is not None else F.array().cast("array<string>")).alias("vouchers"),
        (accounts if accounts is not None else F.array().cast("array<int>")).alias("accounts"),
        (amount if amount is not None else F.lit(None)).cast("bigint").alias("amount"),
        (variant if variant is not None else F.lit("")).alias("variant"),
    )


def gate(df: DataFrame, ctx: Context) -> DataFrame:
    """Keep findings of rules that are valid on the review month's last day and apply to the company."""
    end = F.last_day(F.to_date(F.concat("review", F.lit("-01"))))
    keep = F.lit(False)
    for rule in CATALOG.values():
        cond = (F.col("rule_code") == rule.code) & (end >= F.lit(rule.valid_from).cast("date"))
        if rule.valid_to is not None:
            cond = cond & (end <= F.lit(rule.valid_to).cast("date"))
        if rule.applies_to:
            cond = cond & F.col("legal_form").isin(*rule.applies_to)
        keep = keep | cond
    return df.join(ctx.companies.select("company_id", "legal_form"), "company_id").where(keep).drop("legal_form")


def run(ctx: Context, codes: list[str] | None = None, include_aml: bool = True) -> DataFrame:
    """All findings of all companies and months, deduplicated per review by fingerprint.

    The first in catalog order wins; within a rule the smaller voucher list, then amount. The findings are dealt
    out by company and fingerprint, the layout of all that follows them over time.
    """
    from ledgerloom.operators.controls import aml, balance, integrity, pattern, vat_payroll  # noqa: F401

    wanted = [c for c in CATALOG if c in REGISTRY and (codes is None or c in codes)]
    if not include_aml:
        wanted = [c for c in wanted if CATALOG[c].category != "aml"]
    parts = [REGISTRY[c](ctx) for c in wanted]
    everything = gate(reduce(DataFrame.unionByName, parts), ctx)
    rank = F.lit(len(CATALOG))
    for code, i in ORDER.items():
        rank = F.when(F.col("rule_code") == code, i).otherwise(rank)
    w = Window.partitionBy("company_id", "review", "fingerprint").orderBy("rank", F.array_join("vouchers", ","), "amount", "variant")
    return dealt(everything, "company_id", "fingerprint").withColumn("rank", rank).withColumn("rk", F.row_number().over(w)).where("rk = 1").drop("rk", "rank")
