"""Explaining changes: result and category bridges, exact metric explanations, drilldown, evidence,
and the structure of a figure over time.

Ratio effects are whole billionths of a percentage point; the last component takes the residual,
so the effects of a figure always add up to its change exactly.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.functions.ranges import PAYROLL_MASKED, category_parent, line_lookup, statement_line
from ledgerloom.operators import periods as P
from ledgerloom.operators import statements as S
from ledgerloom.operators.metrics import METRICS

OPERATING = (
    "net_sales",
    "inventory_change",
    "capitalized_work",
    "other_operating_income",
    "materials",
    "other_external",
    "personnel",
    "depreciation",
    "other_operating_expenses",
)
FINANCIAL = ("financial_assets_result", "interest_income", "interest_expense")
BRIDGE_TARGETS = {"operating_result": OPERATING, "net_result": (*OPERATING, *FINANCIAL, "appropriations", "tax")}


def _worsening_share(effect: str, keys: list[str]) -> Column:
    """Share of the total worsening in 0.1 %, for components that worsen the result."""
    w = Window.partitionBy(*keys)
    total = F.sum(F.when(F.col(effect) < 0, F.col(effect))).over(w)
    return F.when(F.col(effect) < 0, total)


def result_bridge(compared: DataFrame, target: str = "operating_result") -> DataFrame:
    """Components of a result between two periods; positive effects improve it.

    ``compared``: rows of ``statements.compared_income``.
    """
    keys = ["company_id", "period", "compare"]
    return (
        compared.where(F.col("line").isin(*BRIDGE_TARGETS[target]))
        .where("amount <> 0 OR compare_amount <> 0")
        .withColumn("effect", F.col("amount") - F.col("compare_amount"))
        .withColumn("worse", _worsening_share("effect", keys))
        .withColumn("share_of_worsening", F.expr(f"CASE WHEN worse IS NOT NULL THEN {money.ratio_half_up('effect', 'worse')} END"))
        .select(*keys, F.lit(target).alias("target"), "line", "amount", "compare_amount", "effect", "share_of_worsening")
    )


def category_bridge(pairs: DataFrame, movements: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Cost change per top-level category; positive effect = lower cost."""
    ids = ["company_id", "kind", "period", "start", "end", "n_months"]
    both = pairs.select(*ids).unionByName(P.compare_side(pairs)).distinct()
    top = (
        S.category_costs(both, movements, overrides)
        .where("category <> 'unmapped'")
        .groupBy("company_id", "period", category_parent(F.col("category")).alias("category"))
        .agg(F.sum("amount").alias("amount"))
    )
    cur = pairs.select("company_id", "period", "compare").join(top, ["company_id", "period"])
    prev = pairs.select("company_id", "period", "compare").join(
        top.select("company_id", F.col("period").alias("compare"), "category", F.col("amount").alias("compare_amount")), ["company_id", "compare"]
    )
    keys = ["company_id", "period", "compare"]
    return (
        cur.join(prev, [*keys, "category"], "full_outer")
        .na.fill(0, ["amount", "compare_amount"])
        .where("amount <> 0 OR compare_amount <> 0")
        .withColumn("effect", F.col("compare_amount") - F.col("amount"))
        .withColumn("worse", _worsening_share("effect", keys))
        .withColumn("share_of_worsening", F.expr(f"CASE WHEN worse IS NOT NULL THEN {money.ratio_half_up('effect', 'worse')} END"))
        .select(*keys, "category", "amount", "compare_amount", "effect", "share_of_worsening")
    )


# ------------------------------------------------------------------------ metric explanations
#: figure → (numerator parts, denominator part); a part is (code, expression over the wide row).
AMOUNT_PARTS: dict[str, tuple[tuple[str, str], ...]] = {
    "net_sales": (("net_sales", "net_sales"),),
    "operating_result": tuple((c, c) for c in OPERATING),
    "result_after_financial": tuple((c, c) for c in (*OPERATING, *FINANCIAL)),
    "gross_profit": (("net_sales", "net_sales"), ("materials", "materials")),
    "ebitda": tuple((c, c) for c in OPERATING if c != "depreciation"),
    "working_capital": (
        ("inventory", "bs_inventory"),
        ("receivables", "bs_receivables"),
        ("short_investments", "bs_short_investments"),
        ("cash", "bs_cash"),
        ("current_liabilities", "-bs_current_liabilities"),
    ),
    "cash": (("cash", "bs_cash_accounts"),),
    "receivables": (("receivables", "bs_customer_receivables"),),
    "payables": (("payables", "bs_payables"),),
}
RATIO_PARTS: dict[str, tuple[tuple[tuple[str, str], ...], tuple[str, str]]] = {
    "operating_margin": (tuple((c, c) for c in OPERATING), ("net_sales", "net_sales")),
    "profit_margin": (tuple((c, c) for c in (*OPERATING, *FINANCIAL)), ("net_sales", "net_sales")),
    "gross_margin": ((("net_sales", "net_sales"), ("materials", "materials")), ("net_sales", "net_sales")),
    "personnel_share": ((("personnel", "-personnel"),), ("net_sales", "net_sales")),
    "external_cost_share": ((("other_external", "-other_external"),), ("net_sales", "net_sales")),
    "quick_ratio": (
        (("current_assets_ex_inventory", "bs_current_assets - bs_inventory"),),
        ("current_liabilities", "bs_current_liabilities"),
    ),
    "current_ratio": ((("current_assets", "bs_current_assets"),), ("current_liabilities", "bs_current_liabilities")),
}
_WIDE = sorted(
    {c for c in (*OPERATING, *FINANCIAL)}
    | {
        "bs_" + c
        for c in (
            "inventory",
            "receivables",
            "short_investments",
            "cash",
            "current_assets",
            "current_liabilities",
            "total_equity",
            "untaxed_reserves",
            "total_assets",
            "cash_accounts",
            "customer_receivables",
            "payables",
        )
    }
)
_SCALE = "1000000000000"


def _side(expr: str, prefix: str) -> str:
    return re.sub(r"\b([a-z_]+)\b", lambda m: f"{prefix}{m.group(1)}" if m.group(1) in _WIDE_SET else m.group(1), expr)


_WIDE_SET = set(_WIDE)


def _trunc(x: str, d: str) -> str:
    n, m = f"CAST({x} AS DECIMAL(38,0))", f"CAST({d} AS DECIMAL(38,0))"
    return f"(CAST(sign({n}) * sign({m}) AS BIGINT) * ((abs({n}) * {_SCALE}) div abs({m})))"


def paired_base(pairs: DataFrame, base: DataFrame) -> DataFrame:
    """One row per pair with the current (``c_``) and previous (``p_``) wide figures."""
    extra = ["has_data", "balance_complete", "tax"]
    cols = [*_WIDE, *extra]
    cur = base.select("company_id", "period", *[F.col(c).alias("c_" + c) for c in cols])
    prev = base.select("company_id", F.col("period").alias("compare"), *[F.col(c).alias("p_" + c) for c in cols])
    return pairs.select("company_id", "kind", "period", "compare").join(cur, ["company_id", "period"]).join(prev, ["company_id", "compare"])


def _component(metric: str, code: str, role: str, ord_: int, now: str, before: str, effect: str) -> str:
    return (
        f"named_struct('metric', '{metric}', 'component', '{code}', 'role', '{role}', 'ord', {ord_}, "
        f"'current', CAST({now} AS BIGINT), 'previous', CAST({before} AS BIGINT), 'effect', CAST({effect} AS BIGINT))"
    )


def explain_metrics(paired: DataFrame, metrics: tuple[str, ...] = tuple(METRICS)) -> DataFrame:
    """Components of the change of every figure, for pairs where both sides are usable.

    Amounts: effect = current − previous in öre. Ratios: numerator parts by
    50·Δ·(1/d₀ + 1/d₁), the denominator by what remains, in 1e-9 percentage points. The equity
    ratio splits the reserves at the old tax rate from the change of the rate.
    """
    entries: list[str] = []
    for metric in metrics:
        ok = "c_has_data AND p_has_data"
        if not METRICS[metric][1]:
            ok += " AND c_balance_complete AND p_balance_complete"
        parts: list[str] = []
        if metric in AMOUNT_PARTS:
            for i, (code, expr) in enumerate(AMOUNT_PARTS[metric]):
                now, before = _side(expr, "c_"), _side(expr, "p_")
                parts.append(_component(metric, code, "component", i, now, before, f"({now}) - ({before})"))
        else:
            if metric == "equity_ratio":
                dec = lambda c: f"CAST({c} AS DECIMAL(38,0))"
                keep = "(10000 - p_tax)"
                numer = [
                    ("total_equity", f"{dec('c_bs_total_equity')} * 10000", f"{dec('p_bs_total_equity')} * 10000", "c_bs_total_equity", "p_bs_total_equity"),
                    (
                        "untaxed_reserves",
                        f"{dec('c_bs_untaxed_reserves')} * {keep}",
                        f"{dec('p_bs_untaxed_reserves')} * {keep}",
                        money.ratio_half_up(f"{dec('c_bs_untaxed_reserves')} * {keep}", "10000", 1),
                        money.ratio_half_up(f"{dec('p_bs_untaxed_reserves')} * {keep}", "10000", 1),
                    ),
                    (
                        "corporate_tax",
                        f"{dec('c_bs_untaxed_reserves')} * (p_tax - c_tax)",
                        "0",
                        money.ratio_half_up(f"{dec('c_bs_untaxed_reserves')} * (p_tax - c_tax)", "10000", 1),
                        "0",
                    ),
                ]
                den = ("total_assets", f"{dec('c_bs_total_assets')} * 10000", f"{dec('p_bs_total_assets')} * 10000", "c_bs_total_assets", "p_bs_total_assets")
            else:
                numerators, (dcode, dexpr) = RATIO_PARTS[metric]
                numer = [(c, _side(e, "c_"), _side(e, "p_"), _side(e, "c_"), _side(e, "p_")) for c, e in numerators]
                den = (dcode, _side(dexpr, "c_"), _side(dexpr, "p_"), _side(dexpr, "c_"), _side(dexpr, "p_"))
            _dc, d1, d0, _s1, _s0 = den
            n1 = " + ".join(f"({n[1]})" for n in numer)
            n0 = " + ".join(f"({n[2]})" for n in numer)
            change = f"(({_trunc(f'({n1})', f'({d1})')} - {_trunc(f'({n0})', f'({d0})')}) div 10)"
            spent = []
            for i, (code, now, before, show_now, show_before) in enumerate(numer):
                delta = f"(({now}) - ({before}))"
                effect = f"(({_trunc(delta, f'({d0})')} + {_trunc(delta, f'({d1})')}) div 20)"
                spent.append(effect)
                parts.append(_component(metric, code, "numerator", i, show_now, show_before, effect))
            parts.append(_component(metric, den[0], "denominator", len(numer), den[3], den[4], f"{change} - ({' + '.join(spent)})"))
            ok += f" AND ({d1}) <> 0 AND ({d0}) <> 0"
        entries.append(f"CASE WHEN {ok} THEN array({', '.join(parts)}) END")
    every = ", ".join(entries)
    exploded = paired.select(
        "company_id", "kind", "period", "compare", F.expr(f"inline(flatten(array_compact(array({every}))))")
    )
    return exploded.where("current <> 0 OR previous <> 0 OR effect <> 0")


def metric_parts(base: DataFrame, metrics: tuple[str, ...] = tuple(METRICS)) -> DataFrame:
    """Parts of every figure for one period with their share (0.1 %) of the figure's base."""
    entries: list[str] = []
    for metric in metrics:
        ok = "has_data" if METRICS[metric][1] else "has_data AND balance_complete"
        if metric in AMOUNT_PARTS:
            parts = [(c, e, "component") for c, e in AMOUNT_PARTS[metric]]
            total = "net_sales" if METRICS[metric][1] else "bs_total_assets"
        elif metric == "equity_ratio":
            after = money.ratio_half_up("CAST(bs_untaxed_reserves AS DECIMAL(38,0)) * (10000 - tax)", "10000", 1)
            parts = [("total_equity", "bs_total_equity", "numerator"), ("untaxed_reserves", after, "numerator"), ("total_assets", "bs_total_assets", "denominator")]
            total = "bs_total_assets"
        else:
            numerators, den = RATIO_PARTS[metric]
            parts = [(c, e, "numerator") for c, e in numerators] + [(*den, "denominator")]
            total = den[1]
        structs = ", ".join(
            f"named_struct('metric', '{metric}', 'part', '{c}', 'role', '{role}', 'value', CAST({e} AS BIGINT), 'base', CAST({total} AS BIGINT))"
            for c, e, role in parts
        )
        entries.append(f"CASE WHEN {ok} THEN array({structs}) END")
    every = ", ".join(entries)
    out = base.select("company_id", "kind", "period", F.expr(f"inline(flatten(array_compact(array({every}))))"))
    return out.withColumn("share", F.expr(money.ratio_half_up("value", "base"))).where("value <> 0")


# ------------------------------------------------------------------------------ drilldown
def account_changes(pairs: DataFrame, movements: DataFrame, limit: int = 8) -> DataFrame:
    """Largest account changes per pair and statement line."""
    result = movements.where("account BETWEEN 3000 AND 8989").withColumn("line", statement_line(F.col("account")))
    ids = ["company_id", "kind", "period", "start", "end", "n_months"]
    both = pairs.select(*ids).unionByName(P.compare_side(pairs)).distinct()
    by_period = (
        P.period_months(both).join(result, ["company_id", "month"]).groupBy("company_id", "period", "line", "account").agg(F.sum("amount").alias("amount"))
    )
    keys = ["company_id", "period", "compare", "line", "account"]
    link = pairs.select("company_id", "period", "compare")
    cur = link.join(by_period, ["company_id", "period"]).select(*keys, F.col("amount").alias("current"))
    prev = link.join(by_period.withColumnRenamed("period", "compare"), ["company_id", "compare"]).select(*keys, F.col("amount").alias("previous"))
    w = Window.partitionBy("company_id", "period", "compare", "line").orderBy(F.desc(F.abs("diff")), "account")
    return (
        cur.join(prev, keys, "full_outer")
        .na.fill(0, ["current", "previous"])
        .withColumn("diff", F.col("current") - F.col("previous"))
        .where("diff <> 0")
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= limit)
    )


def counterparty_changes(pairs: DataFrame, spend: DataFrame, limit: int = 8) -> DataFrame:
    """Largest counterparty changes per pair; ``is_new`` = nothing in the comparison period."""
    ids = ["company_id", "kind", "period", "start", "end", "n_months"]
    both = pairs.select(*ids).unionByName(P.compare_side(pairs)).distinct()
    by_period = (
        P.period_months(both).join(spend.select("company_id", "month", "cp_key", "amount"), ["company_id", "month"]).groupBy("company_id", "period", "cp_key").agg(F.sum("amount").alias("amount"))
    )
    keys = ["company_id", "period", "compare", "cp_key"]
    link = pairs.select("company_id", "period", "compare")
    cur = link.join(by_period, ["company_id", "period"]).select(*keys, F.col("amount").alias("current"))
    prev = link.join(by_period.withColumnRenamed("period", "compare"), ["company_id", "compare"]).select(*keys, F.col("amount").alias("previous"))
    w = Window.partitionBy("company_id", "period", "compare").orderBy(F.desc(F.abs("diff")), "cp_key")
    return (
        cur.join(prev, keys, "full_outer")
        .na.fill(0, ["current", "previous"])
        .withColumn("diff", F.col("current") - F.col("previous"))
        .withColumn("is_new", ((F.col("previous") == 0) & (F.col("current") != 0)).cast("int"))
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= limit)
    )


# ------------------------------------------------------------------------------- evidence
def income_evidence(pairs: DataFrame, facts: DataFrame, movements: DataFrame, lines: tuple[str, ...], limit: int = 8) -> DataFrame:
    """Largest voucher rows behind each income line on both sides of monthly pairs, plus the rest.

    The largest rows per company, month and line are found once (the limit is applied before the
    shuffle) and both sides read them. Accounts whose month nets to zero contribute nothing.
    """
    rows = (
        facts.select("company_id", "month", "voucher", "voucher_date", F.posexplode("eff").alias("row_no", "r"))
        .select("company_id", "month", "voucher", "voucher_date", "row_no", F.col("r.account").alias("account"), (-F.col("r.amount")).alias("amount"))
        .where("account BETWEEN 3000 AND 8989")
        .withColumn("line", line_lookup(F.col("account")))
        .where(F.col("line").isin(*lines))
    )
    live = movements.select("company_id", "month", "account")
    rows = rows.join(live, ["company_id", "month", "account"], "left_semi")
    w = Window.partitionBy("company_id", "month", "line").orderBy(F.desc(F.abs("amount")), "voucher", "voucher_date", "account", "row_no")
    top = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    totals = (
        movements.where("account BETWEEN 3000 AND 8989")
        .withColumn("line", statement_line(F.col("account")))
        .where(F.col("line").isin(*lines))
        .groupBy("company_id", "month", "line")
        .agg((-F.sum("amount")).alias("total"))
    )
    kept = top.groupBy("company_id", "month", "line").agg(F.sum("amount").alias("kept"))
    rest = totals.join(kept, ["company_id", "month", "line"], "left").select(
        "company_id",
        "month",
        "line",
        F.lit("remainder").alias("voucher"),
        F.lit(None).cast("date").alias("voucher_date"),
        F.lit(None).cast("int").alias("account"),
        (F.col("total") - F.coalesce("kept", F.lit(0))).alias("amount"),
        F.lit(0).alias("rank"),
    )
    listed = top.select("company_id", "month", "line", "voucher", "voucher_date", "account", "amount", "rank").unionByName(rest)
    sides = pairs.where("kind = 'month'").select(
        "company_id",
        "period",
        "compare",
        F.expr("inline(array(named_struct('side', 'current', 'month', trunc(end, 'MM')), named_struct('side', 'previous', 'month', trunc(c_end, 'MM'))))"),
    )
    return sides.join(listed, ["company_id", "month"])


def balance_evidence(facts: DataFrame, coverage: DataFrame, openings: DataFrame, balances: DataFrame, lines: tuple[str, ...], limit: int = 8) -> DataFrame:
    """Largest rows behind a balance line at each month end: the opening and the year's rows so far.

    Each month keeps its own ``limit`` largest rows; the largest up to a month are among those of
    the months so far, at most twelve lists of ``limit``.
    """
    line = line_lookup(F.col("account"))
    sign = F.when(F.col("account") < 2000, 1).otherwise(-1)
    rows = (
        facts.select("company_id", "fy_start", "month", "voucher", "voucher_date", F.posexplode("eff").alias("row_no", "r"))
        .select("company_id", "fy_start", "month", "voucher", "voucher_date", "row_no", F.col("r.account").alias("account"), F.col("r.amount").alias("raw"))
        .where("account < 3000")
        .withColumn("line", line)
        .where(F.col("line").isin(*lines))
        .withColumn("amount", F.col("raw") * sign)
    )
    order = [F.desc(F.abs("amount")), "voucher", "voucher_date", "account", "row_no"]
    w = Window.partitionBy("company_id", "month", "line").orderBy(*order)
    cols = ["company_id", "fy_start", "month", "line", "voucher", "voucher_date", "row_no", "account", "amount"]
    monthly = rows.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= limit).select(*cols)
    opening = (
        openings.where("account < 3000")
        .withColumn("line", line)
        .where(F.col("line").isin(*lines))
        .select(
            "company_id",
            "fy_start",
            F.trunc("fy_start", "MM").alias("month"),
            "line",
            F.lit("opening").alias("voucher"),
            F.col("fy_start").alias("voucher_date"),
            F.lit(-1).alias("row_no"),
            "account",
            (F.col("amount") * sign).alias("amount"),
        )
    )
    ends = coverage.select("company_id", "fy_start", F.col("month").alias("at"))
    so_far = monthly.unionByName(opening).join(ends, ["company_id", "fy_start"]).where("month <= at")
    at = Window.partitionBy("company_id", "at", "line").orderBy(*order)
    top = so_far.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= limit)
    total = (
        balances.withColumn("line", line).where(F.col("line").isin(*lines)).groupBy("company_id", F.col("month").alias("at"), "line").agg(F.sum(F.col("balance") * sign).alias("total"))
    )
    kept = top.groupBy("company_id", "at", "line").agg(F.sum("amount").alias("kept"))
    rest = total.join(kept, ["company_id", "at", "line"], "left").select(
        "company_id", "at", "line", F.lit("remainder").alias("voucher"), F.lit(None).cast("int").alias("account"), (F.col("total") - F.coalesce("kept", F.lit(0))).alias("amount"), F.lit(0).alias("rank")
    )
    return top.select("company_id", "at", "line", "voucher", "account", "amount", "rank").unionByName(rest)


# ------------------------------------------------------------------------ structure over time
def structure_accounts(series: DataFrame, movements: DataFrame, lines: tuple[str, ...], limit: int = 8, hide_payroll: bool = True) -> DataFrame:
    """Account rows of a line over a period series: the largest accounts, the rest, masked payroll.

    ``series``: rows of ``periods.period_series``. Every period's rows add up to its line.
    """
    amounts = (
        P.period_months(series)
        .join(movements.where("account BETWEEN 3000 AND 8989").withColumn("line", statement_line(F.col("account"))), ["company_id", "month"])
        .where(F.col("line").isin(*lines))
        .groupBy("company_id", "period", "line", "account")
        .agg((-F.sum("amount")).alias("amount"))
    )
    hidden = PAYROLL_MASKED.on(F.col("account")) if hide_payroll else F.lit(False)
    weight = amounts.where(~hidden).groupBy("company_id", "line", "account").agg(F.sum(F.abs("amount")).alias("weight"))
    w = Window.partitionBy("company_id", "line").orderBy(F.desc("weight"), "account")
    ranked = weight.withColumn("rk", F.row_number().over(w)).select("company_id", "line", "account", "rk")
    label = F.when(hidden, "masked").when(F.col("rk") <= limit, F.col("account").cast("string")).otherwise("other")
    return (
        amounts.join(ranked, ["company_id", "line", "account"], "left")
        .groupBy("company_id", "period", "line", label.alias("row"))
        .agg(F.sum("amount").alias("amount"))
    )
