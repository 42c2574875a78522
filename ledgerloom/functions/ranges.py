"""Account sets and the account → statement line / cost category maps."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Accounts:
    """A union of closed account ranges with exceptions, rendered as a predicate."""

    ranges: tuple[tuple[int, int], ...]
    exclude: tuple[tuple[int, int], ...] = field(default=())

    def on(self, col: Column) -> Column:
        hit = reduce(lambda a, b: a | b, [col.between(lo, hi) for lo, hi in self.ranges])
        for lo, hi in self.exclude:
            hit = hit & ~col.between(lo, hi)
        return hit

    def sql(self, col: str) -> str:
        parts = " OR ".join(f"{col} BETWEEN {lo} AND {hi}" for lo, hi in self.ranges)
        out = f"({parts})"
        for lo, hi in self.exclude:
            out += f" AND NOT {col} BETWEEN {lo} AND {hi}"
        return f"({out})"


def accounts(*spec: tuple[int, int] | int, exclude: tuple[tuple[int, int] | int, ...] = ()) -> Accounts:
    def pair(x: tuple[int, int] | int) -> tuple[int, int]:
        return (x, x) if isinstance(x, int) else x

    return Accounts(tuple(map(pair, spec)), tuple(map(pair, exclude)))


def account_spec(items: list[str]) -> Accounts:
    """``["6300-6399", "6570"]`` → account set (the form used in rule parameters)."""
    bounds = [str(i).split("-", 1) for i in items]
    return accounts(*[(int(b[0]), int(b[-1])) for b in bounds])


# ---------------------------------------------------------------------------------------------
# The statement layout. Leaf lines with their account ranges, then the subtotals.
INCOME_LEAVES: dict[str, tuple[int, int]] = {
    "net_sales": (3000, 3799),
    "inventory_change": (4940, 4999),
    "capitalized_work": (3800, 3899),
    "other_operating_income": (3900, 3999),
    "materials": (4000, 4939),
    "other_external": (5000, 6999),
    "personnel": (7000, 7699),
    "depreciation": (7700, 7899),
    "other_operating_expenses": (7900, 7999),
    "financial_assets_result": (8000, 8299),
    "interest_income": (8300, 8399),
    "interest_expense": (8400, 8499),
    "appropriations": (8800, 8899),
    "tax": (8900, 8989),
}
INCOME_SUBTOTALS: dict[str, tuple[str, ...]] = {
    "operating_income": ("net_sales", "inventory_change", "capitalized_work", "other_operating_income"),
    "operating_result": (
        "operating_income",
        "materials",
        "other_external",
        "personnel",
        "depreciation",
        "other_operating_expenses",
    ),
    "result_after_financial": (
        "operating_result",
        "financial_assets_result",
        "interest_income",
        "interest_expense",
    ),
    "result_before_tax": ("result_after_financial", "appropriations"),
    "net_result": ("result_before_tax", "tax"),
}
BALANCE_LEAVES: dict[str, tuple[int, int]] = {
    "intangible": (1000, 1099),
    "tangible": (1100, 1299),
    "financial_fixed": (1300, 1399),
    "inventory": (1400, 1499),
    "receivables": (1500, 1799),
    "short_investments": (1800, 1899),
    "cash": (1900, 1999),
    "equity": (2000, 2099),
    "untaxed_reserves": (2100, 2199),
    "provisions": (2200, 2299),
    "long_term_liabilities": (2300, 2399),
    "current_liabilities": (2400, 2999),
}
BALANCE_SUBTOTALS: dict[str, tuple[str, ...]] = {
    "fixed_assets": ("intangible", "tangible", "financial_fixed"),
    "current_assets": ("inventory", "receivables", "short_investments", "cash"),
    "total_assets": ("fixed_assets", "current_assets"),
    "total_equity": ("equity", "current_result"),
    "total_equity_liabilities": (
        "total_equity",
        "untaxed_reserves",
        "provisions",
        "long_term_liabilities",
        "current_liabilities",
    ),
}
ASSET_LINES = (
    "intangible",
    "tangible",
    "financial_fixed",
    "inventory",
    "receivables",
    "short_investments",
    "cash",
)
#: Result accounts outside every line (8500–8799) are kept under this line so nothing is lost.
LEFTOVER_LINE = "interest_expense"
# Lines in the order of the report.
INCOME_ORDER = (
    "net_sales",
    "inventory_change",
    "capitalized_work",
    "other_operating_income",
    "operating_income",
    "materials",
    "other_external",
    "personnel",
    "depreciation",
    "other_operating_expenses",
    "operating_result",
    "financial_assets_result",
    "interest_income",
    "interest_expense",
    "result_after_financial",
    "appropriations",
    "result_before_tax",
    "tax",
    "net_result",
)
# Lines in the order of the report.
BALANCE_ORDER = (
    "intangible",
    "tangible",
    "financial_fixed",
    "fixed_assets",
    "inventory",
    "receivables",
    "short_investments",
    "cash",
    "current_assets",
    "total_assets",
    "equity",
    "current_result",
    "total_equity",
    "untaxed_reserves",
    "provisions",
    "long_term_liabilities",
    "current_liabilities",
    "total_equity_liabilities",
)

# Cost categories in matching order (first match wins), with parent category.
CATEGORIES: tuple[tuple[str, str | None, Accounts], ...] = (
    ("software", "technology", accounts(5420, 6540)),
    ("telecom", "technology", accounts((6200, 6299))),
    ("consulting", "external_services", accounts(6550)),
    ("accounting_audit", "external_services", accounts(6530, (6420, 6429))),
    ("legal", "external_services", accounts(6580)),
    ("other_services", "external_services", accounts((6500, 6599), exclude=(6530, 6540, 6550, 6570, 6580))),
    ("finance", None, accounts(6570, (8400, 8499))),
    ("materials", None, accounts((4000, 4999))),
    ("personnel", None, accounts((7000, 7699))),
    ("premises", None, accounts((5000, 5199))),
    ("vehicles", None, accounts((5600, 5799))),
    ("travel", None, accounts((5800, 5899))),
    ("marketing", None, accounts((5900, 6099))),
    ("office", None, accounts((5200, 5599), (6100, 6199), exclude=(5420,))),
    ("insurance", None, accounts((6300, 6399))),
    ("administration", None, accounts((6400, 6499), exclude=((6420, 6429),))),
    ("depreciation", None, accounts((7700, 7899))),
    ("other", None, accounts((6600, 6999), (7900, 7999))),
)
# Account sets shared by the controls and the spend analytics.
CASH = accounts((1910, 1919))
BANK = accounts((1920, 1949))
INPUT_VAT = accounts((2640, 2649))
OUTPUT_VAT = accounts((2610, 2639))
OUTPUT_VAT_12 = accounts((2620, 2629))
VAT_ACCOUNTS = accounts((2610, 2649))
SALES = accounts((3000, 3799))
COSTS = accounts((4000, 7999))
SALARY_BASE = accounts((7010, 7289), (7380, 7389))
EMPLOYER_CONTRIB = accounts((7510, 7518))
PAYABLES = accounts((2440, 2449))
RECEIVABLES = accounts((1510, 1519))
DEPRECIATION = accounts((7700, 7899))
FIXED_ASSETS = accounts((1100, 1299))
DEPRECIABLE = accounts((1110, 1299), exclude=((1130, 1139), (1180, 1189), (1280, 1289)))
VACATION = accounts((2920, 2929))
SALARIES = accounts((7000, 7399), exclude=((7290, 7299),))
RELATED_AML = accounts((1360, 1369), (1680, 1689), (2390, 2399), (2890, 2899))
REVENUE_OR_CUSTOMER = accounts((1510, 1519), (3000, 3999))
SUPPLIER_OR_COST = accounts((2440, 2449), (4000, 7999), (2710, 2739), (1630, 1639))
EXTERNAL_SPEND = accounts((4000, 6999))
TAX_ACCOUNT = accounts((1630, 1639))
PAYROLL_MASKED = accounts((7000, 7699), (2710, 2719))
TREE_COSTS = accounts((4000, 8499), exclude=((8000, 8399),))


def _ladder(col: Column, steps: list[tuple[Column, str]]) -> Column:
    out = F.when(steps[0][0], steps[0][1])
    for cond, value in steps[1:]:
        out = out.when(cond, value)
    return out


def statement_line(account: Column, override: Column | None = None) -> Column:
    """Statement line of an account; an override wins, unmapped accounts give NULL."""
    steps = [(account.between(lo, hi), code) for code, (lo, hi) in {**INCOME_LEAVES, **BALANCE_LEAVES}.items()]
    steps.append((account.between(3000, 8989), LEFTOVER_LINE))
    line = _ladder(account, steps)
    return line if override is None else F.coalesce(override, line)


def line_lookup(account: Column) -> Column:
    """As ``statement_line``, by one look-up in an array: for filters over many rows, where the ladder's code is too long to be compiled."""
    leaves = {**INCOME_LEAVES, **BALANCE_LEAVES}
    first = lambda a: next((code for code, (lo, hi) in leaves.items() if lo <= a <= hi), LEFTOVER_LINE if 3000 <= a <= 8989 else "")
    table = F.expr(f"split('{','.join(first(a) for a in range(10_000))}', ',')")
    return F.nullif(F.get(table, account), F.lit(""))


def cost_category(account: Column, override: Column | None = None) -> Column:
    line = _ladder(account, [(accs.on(account), code) for code, _p, accs in CATEGORIES])
    return line if override is None else F.coalesce(override, line)


def category_parent(code: Column) -> Column:
    """Top level category of a category."""
    steps = [(code == c, p) for c, p, _a in CATEGORIES if p is not None]
    return F.coalesce(_ladder(code, steps), code)


def leaves_of(code: str) -> tuple[str, ...]:
    """Leaf lines below a statement line, the hierarchy flattened."""
    subtotals = {**INCOME_SUBTOTALS, **BALANCE_SUBTOTALS}
    if code not in subtotals:
        return (code,)
    return tuple(leaf for child in subtotals[code] for leaf in leaves_of(child))
