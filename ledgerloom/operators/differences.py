"""Ranked differences between two periods, candidate priorities and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.functions.ranges import BALANCE_LEAVES, INCOME_LEAVES, TREE_COSTS, category_parent, cost_category, statement_line
from ledgerloom.operators.metrics import CORE_METRICS, METRICS

# Sides of the income statement, families of items that describe the same change.
INCOME_SIDE = (
    "net_sales",
    "inventory_change",
    "capitalized_work",
    "other_operating_income",
    "financial_assets_result",
    "interest_income",
)
FAMILIES = {
    "metric:net_sales": "sales",
    "metric:operating_result": "result",
    "metric:result_after_financial": "result",
    "metric:ebitda": "result",
    "metric:operating_margin": "margin",
    "metric:profit_margin": "margin",
    "metric:gross_profit": "gross",
    "metric:gross_margin": "gross",
    "line:income:materials": "gross",
    "metric:personnel_share": "personnel",
    "line:income:personnel": "personnel",
    "metric:external_cost_share": "external",
    "line:income:other_external": "external",
    "metric:equity_ratio": "solvency",
    "line:balance:equity": "solvency",
    "metric:quick_ratio": "liquidity",
    "metric:current_ratio": "liquidity",
    "metric:working_capital": "liquidity",
    "metric:cash": "liquidity",
    "metric:receivables": "receivables",
    "line:balance:receivables": "receivables",
    "metric:payables": "payables",
    "line:balance:current_liabilities": "payables",
    "line:income:depreciation": "depreciation",
}
KIND_ORDER = {"metric": 0, "line": 1, "category": 2, "finding": 3}
KEYS = ["company_id", "period", "compare"]


def sek_points(change: str = "change", previous: str = "previous", base: str = "base") -> str:
    """Points for an amount: share of the base, size and relative change (SQL over öre columns)."""
    size, b = f"CAST(abs({change}) AS DECIMAL(38,0))", f"CAST({base} AS DECIMAL(38,0))"
    return (
        f"CASE WHEN {size} * 10 >= {b} THEN 40 WHEN {size} * 20 >= {b} THEN 30 WHEN {size} * 50 >= {b} THEN 20 "
        f"WHEN {size} * 100 >= {b} THEN 10 WHEN {size} > 0 THEN 3 ELSE 0 END"
        f" + CASE WHEN {size} >= 10000000 THEN 15 WHEN {size} >= 2500000 THEN 10 WHEN {size} >= 500000 THEN 5 ELSE 0 END"
        f" + CASE WHEN {previous} = 0 THEN CASE WHEN {size} > 0 THEN 15 ELSE 0 END WHEN {size} * 2 >= abs({previous}) THEN 15 "
        f"WHEN {size} * 5 >= abs({previous}) THEN 10 WHEN {size} * 10 >= abs({previous}) THEN 5 ELSE 0 END"
    )


#: points for a change in 1e-9 percentage points
PP_POINTS = (
    "CASE WHEN abs(change) >= 5000000000 THEN 60 WHEN abs(change) >= 2000000000 THEN 45 WHEN abs(change) >= 1000000000 THEN 30 "
    "WHEN abs(change) >= 500000000 THEN 15 WHEN abs(change) > 0 THEN 3 ELSE 0 END"
)


def bases(paired: DataFrame, compared: DataFrame) -> DataFrame:
    """Materiality base per pair: turnover (else costs) for results, total assets for balances."""
    lines = compared.groupBy(*KEYS).agg(
        F.max(F.when(F.col("line") == "net_sales", F.greatest(F.abs("amount"), F.abs("compare_amount")))).alias("turnover"),
        F.sum(
            F.when(F.col("line").isin(*[c for c in INCOME_LEAVES if c not in INCOME_SIDE]), F.abs("amount")).otherwise(0)
        ).alias("costs"),
    )
    assets = paired.select(*KEYS, F.greatest(F.abs("c_bs_total_assets"), F.abs("p_bs_total_assets")).alias("assets"))
    income = F.when(F.col("turnover") > 0, F.col("turnover")).when(F.col("costs") > 0, F.col("costs")).otherwise(F.lit(100))
    return (
        lines.join(assets, KEYS, "left")
        .withColumn("income_base", income)
        .withColumn("balance_base", F.when(F.coalesce("assets", F.lit(0)) > 0, F.col("assets")).otherwise(F.col("income_base")))
        .select(*KEYS, "income_base", "balance_base")
    )


def _item(df: DataFrame, kind: str, ident: Column, code: Column, unit: Column, score: Column) -> DataFrame:
    return df.select(
        *KEYS,
        ident.alias("id"),
        F.lit(kind).alias("kind"),
        code.alias("code"),
        unit.alias("unit"),
        F.col("current").cast("bigint").alias("current"),
        F.col("previous").cast("bigint").alias("previous"),
        F.col("change").cast("bigint").alias("change"),
        score.cast("int").alias("score"),
    )


def metric_items(changes: DataFrame, components: DataFrame, base: DataFrame) -> DataFrame:
    """One item per figure. ``changes``: ``metrics.figure_changes``; ``components``: explanations.

    Ratios are scored on their exact change (the sum of the effects), amounts on their öre.
    """
    exact = components.groupBy(*KEYS, "metric").agg(F.sum("effect").alias("exact"))
    balance = F.col("metric").isin(*[m for m, d in METRICS.items() if not d[1]])
    usable = F.col("status").isin("CALCULATED", "PARTIAL") & F.col("previous_status").isin("CALCULATED", "PARTIAL")
    ratio = F.col("unit") == "percent"
    j = (
        changes.select(*KEYS, "metric", "unit", F.col("value").alias("current"), "previous", "status", "previous_status")
        .join(base, KEYS)
        .join(exact, [*KEYS, "metric"], "left")
        .withColumn("base", F.when(balance, F.col("balance_base")).otherwise(F.col("income_base")))
        .withColumn(
            "change",
            F.when(usable, F.when(ratio, F.coalesce("exact", F.lit(0))).otherwise(F.col("current") - F.col("previous"))),
        )
    )
    points = F.when(ratio, F.expr(PP_POINTS)).otherwise(F.expr(sek_points()))
    headline = F.when(F.col("metric").isin(*CORE_METRICS), 5).otherwise(0)
    score = F.when(F.col("change").isNull(), 0).otherwise(points + headline)
    return _item(j, "metric", F.concat(F.lit("metric:"), "metric"), F.col("metric"), F.col("unit"), score)


def income_line_items(compared: DataFrame, base: DataFrame, comparable: DataFrame) -> DataFrame:
    rows = (
        compared.where(F.col("line").isin(*[c for c in INCOME_LEAVES if c != "net_sales"]))
        .where("amount <> 0 OR compare_amount <> 0")
        .join(comparable, KEYS, "left_semi")
        .join(base, KEYS)
        .select(*KEYS, "line", F.col("amount").alias("current"), F.col("compare_amount").alias("previous"), F.col("income_base").alias("base"))
        .withColumn("change", F.col("current") - F.col("previous"))
    )
    return _item(rows, "line", F.concat(F.lit("line:income:"), "line"), F.col("line"), F.lit("SEK"), F.expr(sek_points()) - 5)


def balance_line_items(balance_pairs: DataFrame, base: DataFrame, comparable: DataFrame) -> DataFrame:
    """``balance_pairs``: KEYS, line, amount, compare_amount for pairs with complete balances."""
    rows = (
        balance_pairs.where(F.col("line").isin(*[c for c in BALANCE_LEAVES if c != "cash"]))
        .where("amount <> 0 OR compare_amount <> 0")
        .join(comparable, KEYS, "left_semi")
        .join(base, KEYS)
        .select(*KEYS, "line", F.col("amount").alias("current"), F.col("compare_amount").alias("previous"), F.col("balance_base").alias("base"))
        .withColumn("change", F.col("current") - F.col("previous"))
    )
    return _item(rows, "line", F.concat(F.lit("line:balance:"), "line"), F.col("line"), F.lit("SEK"), F.expr(sek_points()) - 5)


def category_items(category_changes: DataFrame, movements: DataFrame, base: DataFrame, comparable: DataFrame) -> DataFrame:
    """Cost categories, except those made of exactly the accounts of an income line.

    ``category_changes``: rows of ``bridges.category_bridge``.
    """
    used = movements.where("account BETWEEN 3000 AND 8989").select("company_id", "account").distinct()
    lines = used.groupBy("company_id", statement_line(F.col("account")).alias("line")).agg(F.array_sort(F.collect_set("account")).alias("accs"))
    cats = (
        used.where(TREE_COSTS.on(F.col("account")))
        .withColumn("category", category_parent(cost_category(F.col("account"))))
        .where("category IS NOT NULL")
        .groupBy("company_id", "category")
        .agg(F.array_sort(F.collect_set("account")).alias("accs"))
    )
    own = cats.join(lines.select("company_id", "accs").distinct(), ["company_id", "accs"], "left_anti").select("company_id", "category")
    rows = (
        category_changes.join(own, ["company_id", "category"], "left_semi")
        .join(comparable, KEYS, "left_semi")
        .join(base, KEYS)
        .select(*KEYS, "category", F.col("amount").alias("current"), F.col("compare_amount").alias("previous"), F.col("income_base").alias("base"))
        .withColumn("change", F.col("current") - F.col("previous"))
    )
    return _item(rows, "category", F.concat(F.lit("category:"), "category"), F.col("category"), F.lit("SEK"), F.expr(sek_points()))


def rank_candidates(candidates: DataFrame, limit: int = 5) -> DataFrame:
    """Priority score per candidate; the first ``limit`` are shown, the rest keep a reason.

    ``candidates``: KEYS, code, group_key, effect, unit, source_level, n_facts, has_warnings,
    has_sources. Score = materiality + evidence + traceability + coverage + actionability.
    """
    size = F.abs("effect")
    sek = F.when(size >= 10_000_000, 30).when(size >= 2_500_000, 20).when(size >= 500_000, 10).when(size >= 100_000, 5).otherwise(1)
    other = F.when(size >= 10, 20).when(size >= 5, 15).when(size >= 1, 10).otherwise(3)
    evidence = F.when(F.col("source_level") == "account_voucher", 20).when(F.col("source_level") == "account", 10).otherwise(0)
    score = (
        F.when(F.col("unit") == "SEK", sek).otherwise(other)
        + evidence
        + F.least(F.lit(15), F.col("n_facts") * 5)
        + F.when(F.col("has_warnings"), -10).otherwise(0)
        + F.when(F.col("has_sources"), 5).otherwise(0)
    )
    w = Window.partitionBy(*KEYS).orderBy(F.desc("score"), "group_key", "code")
    return (
        candidates.withColumn("score", score.cast("int"))
        .withColumn("position", F.row_number().over(w))
        .withColumn("shown", F.col("position") <= limit)
    )


def finding_items(ranked: DataFrame) -> DataFrame:
    rows = ranked.select(*KEYS, "group_key", "code", "unit", F.col("effect").alias("change"), "score").withColumn("current", F.lit(None)).withColumn("previous", F.lit(None))
    return _item(rows, "finding", F.concat(F.lit("finding:"), "group_key"), F.col("code"), F.when(F.col("unit") == "SEK", "SEK").otherwise("count"), F.col("score"))


def structural_candidates(components: DataFrame, component_accounts: DataFrame) -> DataFrame:
    """Candidates from metric explanations grouped by their account set.

    The component with the largest effect represents the group; facts are the metrics it occurs
    in. ``component_accounts``: KEYS, component, accounts (comma list).
    """
    j = components.where("effect <> 0").join(component_accounts, [*KEYS, "component"])
    unit = F.when(F.col("role") == "component", "SEK").otherwise("pp")
    best = F.max_by(F.struct("metric", "component", "effect", unit.alias("unit")), F.struct(F.abs("effect").alias("size"), "metric", "component"))
    return (
        j.groupBy(*KEYS, "accounts")
        .agg(best.alias("b"), F.array_sort(F.collect_set("metric")).alias("metrics"))
        .select(
            *KEYS,
            F.col("b.metric").alias("code"),
            F.concat(F.lit("accounts:"), "accounts").alias("group_key"),
            F.col("b.effect").alias("effect"),
            F.col("b.unit").alias("unit"),
            F.lit("account").alias("source_level"),
            F.size("metrics").alias("n_facts"),
            F.lit(False).alias("has_warnings"),
            F.lit(True).alias("has_sources"),
            "metrics",
        )
    )


def recommend(items: DataFrame, limit: int = 6) -> DataFrame:
    """Marks the ``limit`` strongest items, one per family, and says which leader covers the others."""
    known = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])
    family = F.coalesce(F.try_element_at(known, F.col("id")), F.col("id"))
    order = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in KIND_ORDER.items() for x in pair]), F.col("kind")), F.lit(9))
    scored = items.withColumn("family", family).withColumn("kind_order", order).withColumn("live", F.col("change").isNotNull() & (F.col("score") > 0))
    inside = Window.partitionBy(*KEYS, "family", "live").orderBy(F.desc("score"), "kind_order", "id")
    ranked = scored.withColumn("in_family", F.row_number().over(inside)).withColumn("leader", F.first("id").over(inside))
    over = Window.partitionBy(*KEYS, "is_leader").orderBy(F.desc("score"), "kind_order", "id")
    ranked = ranked.withColumn("is_leader", F.col("live") & (F.col("in_family") == 1)).withColumn("place", F.row_number().over(over))
    chosen = F.col("is_leader") & (F.col("place") <= limit)
    whole = Window.partitionBy(*KEYS, "family")
    out = ranked.withColumn("recommended", chosen.cast("int")).withColumn("family_chosen", F.max(chosen.cast("int")).over(whole) == 1)
    return out.select(
        *items.columns,
        "family",
        "recommended",
        F.when(F.col("live") & F.col("family_chosen") & ~chosen, F.col("leader")).alias("covered_by"),
    )


def change_pct() -> str:
    return money.pct_change("current", "previous")
