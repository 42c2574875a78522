"""Income statement, balance sheet, cost tree, trend and budget, for all companies and periods.

Movements are folded once into one wide row per company and month (a column per statement line);
period figures are sums of those rows, subtotals are column arithmetic, and the long layout is
an unpivot at the very end. Nothing is grouped per line or per account after the first fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.functions.ranges import (
    ASSET_LINES,
    BALANCE_LEAVES,
    BALANCE_ORDER,
    BALANCE_SUBTOTALS,
    INCOME_LEAVES,
    INCOME_ORDER,
    INCOME_SUBTOTALS,
    TREE_COSTS,
    category_parent,
    cost_category,
    statement_line,
)
from ledgerloom.operators import periods as P


def with_target(df: DataFrame, overrides: DataFrame | None, kind: str) -> DataFrame:
    """Adds ``target``: the account's override, the company's own before the firm-wide one."""
    if overrides is None:
        return df.withColumn("target", F.lit(None).cast("string"))
    rows = overrides.where(F.col("kind") == kind)
    own = rows.where("company_id IS NOT NULL").select("company_id", "account", F.col("target").alias("own_target"))
    firm = rows.where("company_id IS NULL").select("account", F.col("target").alias("firm_target"))
    joined = df.join(own, ["company_id", "account"], "left").join(firm, ["account"], "left")
    return joined.withColumn("target", F.coalesce("own_target", "firm_target")).drop("own_target", "firm_target")


def _lined(movements: DataFrame, overrides: DataFrame | None) -> DataFrame:
    return with_target(movements, overrides, "statement").withColumn(
        "line", statement_line(F.col("account"), F.col("target"))
    )


def _leaf_sums(income: bool, balance: bool) -> list[Column]:
    line, amount, account = F.col("line"), F.col("amount"), F.col("account")
    out: list[Column] = []
    zero = F.lit(0)
    if income:
        in_result = account.between(3000, 8989)
        out += [F.sum(F.when(in_result & (line == c), -amount).otherwise(zero)).alias(c) for c in INCOME_LEAVES]
    if balance:
        out += [F.sum(F.when((account < 3000) & (line == c), amount).otherwise(zero)).alias(f"b_{c}") for c in BALANCE_LEAVES]
        out.append(F.sum(F.when(account.between(3000, 8999), amount).otherwise(zero)).alias("pl_all"))
    return out


def monthly_lines(movements: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Wide row per (company, month): income leaves (income +, cost −), raw balance leaves, result."""
    return _lined(movements, overrides).groupBy("company_id", "month").agg(*_leaf_sums(True, True))


def add_subtotals(df: DataFrame, subtotals: dict[str, tuple[str, ...]], prefix: str = "") -> DataFrame:
    for code, parts in subtotals.items():
        total = F.col(prefix + parts[0])
        for part in parts[1:]:
            total = total + F.col(prefix + part)
        df = df.withColumn(prefix + code, total)
    return df


def income_wide(
    periods: DataFrame,
    monthly: DataFrame,
    coverage: DataFrame,
    annual: DataFrame | None = None,
    fiscal_years: DataFrame | None = None,
    overrides: DataFrame | None = None,
) -> DataFrame:
    """One row per period with all income lines and ``has_data``.

    ``annual`` (movements of years known only as year balances) serves a period that is exactly
    such a year while its months are missing.
    """
    months = (
        P.period_months(periods)
        .join(coverage.select("company_id", "month", "covered"), ["company_id", "month"], "left")
        .join(monthly.select("company_id", "month", *INCOME_LEAVES), ["company_id", "month"], "left")
    )
    sums = months.groupBy("company_id", "period").agg(
        F.min(F.coalesce("covered", F.lit(False))).alias("has_data"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in INCOME_LEAVES],
    )
    out = periods.join(sums, ["company_id", "period"])
    if annual is not None and fiscal_years is not None:
        whole = (
            _lined(annual, overrides)
            .groupBy("company_id", "fy_start")
            .agg(*_leaf_sums(True, False))
            .join(fiscal_years.select("company_id", "fy_start", "fy_end"), ["company_id", "fy_start"])
            .select("company_id", F.col("fy_start").alias("start"), F.col("fy_end").alias("end"), F.lit(True).alias("an"), *[F.col(c).alias("a_" + c) for c in INCOME_LEAVES])
        )
        out = out.join(whole, ["company_id", "start", "end"], "left")
        use = F.coalesce("an", F.lit(False)) & ~F.col("has_data")
        out = out.select(
            *periods.columns,
            (F.col("has_data") | use).alias("has_data"),
            *[F.when(use, F.col("a_" + c)).otherwise(F.col(c)).alias(c) for c in INCOME_LEAVES],
        )
    return add_subtotals(out, INCOME_SUBTOTALS)


def balance_wide(
    monthly: DataFrame,
    coverage: DataFrame,
    openings: DataFrame,
    complete: DataFrame,
    overrides: DataFrame | None = None,
    closing: DataFrame | None = None,
) -> DataFrame:
    """Month-end balance sheet per (company, month): assets +, equity and liabilities positive.

    ``closing`` (year balances of summary years) replaces the year-end row of those years.
    """
    leaves = list(BALANCE_LEAVES)
    start = (
        _lined(openings.where("account < 3000"), overrides)
        .groupBy("company_id", "fy_start")
        .agg(*[F.sum(F.when(F.col("line") == c, F.col("amount")).otherwise(0)).alias("o_" + c) for c in leaves])
    )
    w = Window.partitionBy("company_id", "fy_start").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    grid = (
        coverage.select("company_id", "fy_start", "month")
        .join(monthly.select("company_id", "month", "pl_all", *["b_" + c for c in leaves]), ["company_id", "month"], "left")
        .join(start, ["company_id", "fy_start"], "left")
    )
    sums = []
    for c in leaves:
        raw = F.sum(F.coalesce(F.col("b_" + c), F.lit(0))).over(w) + F.coalesce(F.col("o_" + c), F.lit(0))
        sums.append((raw if c in ASSET_LINES else -raw).alias(c))
    out = grid.select(
        "company_id", "fy_start", "month", *sums, (-F.sum(F.coalesce("pl_all", F.lit(0))).over(w)).alias("current_result")
    ).join(complete, ["company_id", "month"])
    if closing is not None:
        out = _with_closing(out, coverage, closing, overrides)
    return add_subtotals(out, BALANCE_SUBTOTALS)


def _with_closing(out: DataFrame, coverage: DataFrame, closing: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """Year-end rows of summary years come straight from UB; the imbalance of UB is the result."""
    leaves = list(BALANCE_LEAVES)
    ub = _lined(closing.where("kind = 'UB' AND account < 3000"), overrides).groupBy("company_id", "fy_start").agg(
        *[F.sum(F.when(F.col("line") == c, F.col("amount")).otherwise(0)).alias("u_" + c) for c in leaves],
        F.sum("amount").alias("u_all"),
    )
    ends = coverage.where("source = 'annual' AND month = trunc(fy_end, 'MM')").select("company_id", "fy_start", "month")
    j = out.join(ub.join(ends, ["company_id", "fy_start"]), ["company_id", "fy_start", "month"], "left")
    known = F.col("u_all").isNotNull()
    cols = [
        F.when(known, F.col("u_" + c) * (1 if c in ASSET_LINES else -1)).otherwise(F.col(c)).alias(c) for c in leaves
    ]
    return j.select(
        "company_id",
        "fy_start",
        "month",
        *cols,
        F.when(known, F.col("u_all")).otherwise(F.col("current_result")).alias("current_result"),
        (known | F.col("balance_complete")).alias("balance_complete"),
    )


def _unpivot(df: DataFrame, ids: list[str], lines: list[str], value: str) -> DataFrame:
    return df.unpivot(ids, lines, "line", value)


def income_statement(wide: DataFrame) -> DataFrame:
    """Long income statement: one row per period and line."""
    return _unpivot(wide, ["company_id", "kind", "period", "has_data"], INCOME_ORDER, "amount")


def balance_sheet(wide: DataFrame) -> DataFrame:
    return _unpivot(wide, ["company_id", "month", "balance_complete"], BALANCE_ORDER, "amount")


def compared_income(pairs: DataFrame, wide: DataFrame) -> DataFrame:
    """Income statement with the comparison side: amount, compare, diff and change in 0.1 %.

    ``wide`` holds both sides of the pairs.
    """
    cur = income_statement(wide)
    cmp_ = cur.select("company_id", F.col("period").alias("compare"), "line", F.col("amount").alias("compare_amount"), F.col("has_data").alias("compare_has_data"))
    return (
        pairs.select("company_id", "period", "compare")
        .join(cur.drop("kind"), ["company_id", "period"])
        .join(cmp_, ["company_id", "compare", "line"])
        .withColumn("diff", F.col("amount") - F.col("compare_amount"))
        .withColumn("diff_pct", F.expr(money.pct_change("amount", "compare_amount")))
    )


# ---------------------------------------------------------------------------- cost tree, trend
def category_costs(
    periods: DataFrame, movements: DataFrame, overrides: DataFrame | None = None, coverage: DataFrame | None = None
) -> DataFrame:
    """Cost per period and category (4000–8499 except 8000–8399), unmapped under ``unmapped``."""
    costs = (
        with_target(movements.where(TREE_COSTS.on(F.col("account"))), overrides, "category")
        .withColumn("category", F.coalesce(cost_category(F.col("account"), F.col("target")), F.lit("unmapped")))
        .groupBy("company_id", "month", "category")
        .agg(F.sum("amount").alias("amount"))
    )
    return (
        P.period_months(periods)
        .join(costs, ["company_id", "month"])
        .groupBy("company_id", "period", "category")
        .agg(F.sum("amount").alias("amount"))
    )


def cost_tree(pairs: DataFrame, movements: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Two-level cost tree per pair: category and parent totals, share of total, comparison.

    Levels come from one ``rollup``; empty nodes are dropped; the share is half-even as it is for
    every tree.
    """
    ids = ["company_id", "kind", "period", "start", "end", "n_months"]
    both = pairs.select(*ids).unionByName(P.compare_side(pairs)).distinct()
    costs = category_costs(both, movements, overrides)
    cur = pairs.join(costs, ["company_id", "period"]).select("company_id", "period", "compare", "category", "amount", F.lit(0).cast("bigint").alias("c"))
    prev = pairs.join(
        costs.select("company_id", F.col("period").alias("compare"), "category", F.col("amount").alias("c")), ["company_id", "compare"]
    ).select("company_id", "period", "compare", "category", F.lit(0).cast("bigint").alias("amount"), "c")
    nodes = cur.unionByName(prev).withColumn("parent", category_parent(F.col("category")))
    rolled = (
        nodes.rollup("company_id", "period", "compare", "parent", "category")
        .agg(F.sum("amount").alias("amount"), F.sum("c").alias("compare_amount"), F.grouping_id().alias("g"))
        .where("g IN (0, 1, 3)")
        .where("amount <> 0 OR (compare_amount <> 0 AND coalesce(category, parent, '') <> 'unmapped')")
    )
    leaf_is_root = (F.col("g") == 0) & (F.col("category") == F.col("parent"))
    node = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, F.col("parent")).otherwise(F.col("category"))
    level = F.when(F.col("g") == 3, 0).when(F.col("g") == 1, 1).otherwise(2)
    w = Window.partitionBy("company_id", "period", "compare")
    return (
        rolled.where(~leaf_is_root)
        .withColumn("code", node)
        .withColumn("level", level)
        .withColumn("total", F.max(F.when(F.col("level") == 0, F.col("amount"))).over(w))
        .withColumn("total", F.coalesce("total", F.lit(0)))
        .withColumn("share", F.when(F.col("code") != "unmapped", F.expr(money.ratio_half_even("amount", "total"))))
        .withColumn("diff", F.when(F.col("code") != "unmapped", F.col("amount") - F.col("compare_amount")))
        .select(
            "company_id",
            "period",
            "compare",
            "level",
            "code",
            F.when(F.col("level") == 2, F.col("parent")).alias("parent"),
            "amount",
            F.when(F.col("code") != "unmapped", F.col("compare_amount")).alias("compare_amount"),
            "diff",
            "share",
        )
    )


def trend(monthly: DataFrame, movements: DataFrame, coverage: DataFrame, n: int) -> DataFrame:
    """Sales, costs and operating result of the last ``n`` (3–60) months with data per company.

    Costs are all of the accounts 4000-7999, those outside the statement's lines included.
    """
    if not 3 <= n <= 60:
        raise ValueError("between 3 and 60 months")
    w = Window.partitionBy("company_id").orderBy(F.desc("month"))
    last = coverage.where("covered").withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= n)
    wide = last.join(monthly, ["company_id", "month"], "left").na.fill(0, list(INCOME_LEAVES))
    costs = movements.where("account BETWEEN 4000 AND 7999").groupBy("company_id", "month").agg(F.sum("amount").alias("costs"))
    wide = add_subtotals(wide, INCOME_SUBTOTALS).join(costs, ["company_id", "month"], "left")
    return wide.select(
        "company_id",
        "month",
        F.col("net_sales").alias("sales"),
        F.coalesce("costs", F.lit(0)).alias("costs"),
        "operating_result",
    )


def budget_vs_actual(periods: DataFrame, budget: DataFrame, monthly: DataFrame, coverage: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Budget and outcome per income line with subtotals; periods without a budget give no rows."""
    planned = _lined(budget.where("kind = 'PBUDGET' AND account BETWEEN 3000 AND 8989"), overrides).groupBy("company_id", "month").agg(*_leaf_sums(True, False))
    months = P.period_months(periods)
    b = (
        months.join(planned, ["company_id", "month"])
        .groupBy("company_id", "period")
        .agg(*[F.sum(c).alias(c) for c in INCOME_LEAVES])
    )
    b = add_subtotals(b, INCOME_SUBTOTALS).unpivot(["company_id", "period"], INCOME_ORDER, "line", "budget")
    a = income_wide(periods, monthly, coverage).unpivot(["company_id", "period"], INCOME_ORDER, "line", "actual")
    return (
        b.join(a, ["company_id", "period", "line"])
        .where("budget <> 0 OR actual <> 0")
        .withColumn("diff", F.col("actual") - F.col("budget"))
        .withColumn("diff_pct", F.expr(money.pct_change("actual", "budget")))
    )
