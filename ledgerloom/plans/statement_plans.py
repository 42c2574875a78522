"""Registered queries: ledger core, periods, statements and key figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import ledger as L
from ledgerloom.operators import metrics as M
from ledgerloom.operators import periods as P
from ledgerloom.operators import statements as S
from ledgerloom.plans import oracle as O
from ledgerloom.plans.book import Book
from ledgerloom.plans.control_plans import MAT, VF
from ledgerloom.sources import demo

YM = "yyyy-MM"


def _ym(col: str, name: str | None = None):
    return F.date_format(col, YM).alias(name or col)


def monthly_movements(book: Book) -> DataFrame:
    return L.monthly_movements(demo.vouchers(book.spark, book.sf_dir, text=False)).select(
        "company_id", _ym("month"), "account", "amount"
    )


def voucher_rollup(book: Book) -> DataFrame:
    r = L.voucher_rollup(book.vouchers)
    return r.groupBy("company_id", "series", F.date_format("voucher_date", YM).alias("month"), "debit_account", "credit_account").agg(
        F.count("*").alias("n_vouchers"),
        F.sum("balance").alias("balance"),
        F.sum("debit_total").alias("debit_total"),
        F.sum("row_count").alias("n_rows"),
        F.max(F.array_join("accounts", ",")).alias("accounts"),
    )


def period_coverage(book: Book) -> DataFrame:
    pairs = book.year_pairs("month", "quarter", "ytd", "fy", "rolling")
    return P.validate_pairs(pairs, book.coverage).select(
        "company_id", "kind", "period", "compare", "pair_status", "missing", "compare_missing"
    )


def period_series(book: Book) -> DataFrame:
    anchors = L.latest_data(book.coverage, book.movements).select("company_id", F.col("latest_month").alias("month"))
    out = None
    for kind, n in (("months", 12), ("quarters", 8), ("fiscal_years", 3), ("same_month", 3), ("ytd", 3), ("r12", 12)):
        s = P.period_series(anchors, kind, n, book.fiscal_years).withColumn("series", F.lit(kind))
        out = s if out is None else out.unionByName(s)
    label = P.short_label(F.col("kind"), F.col("start"), F.col("end"), F.col("n_months"))
    return out.select(
        "company_id", "series", "pos", "period", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), label.alias("label")
    )


def history_months(book: Book) -> DataFrame:
    return L.history_months(book.coverage, 6).select("company_id", _ym("anchor"), _ym("month"))


def data_horizon(book: Book) -> DataFrame:
    return L.latest_data(book.coverage, book.movements).select(
        "company_id", _ym("latest_month"), F.col("horizon").cast("string").alias("horizon")
    )


def open_periods(book: Book) -> DataFrame:
    """Notices on periods that are not over yet."""
    found = P.open_notices(book.periods("quarter", "ytd", "fy", "rolling"), L.latest_data(book.coverage, book.movements))
    return found.select("company_id", "kind", "period", F.col("end").cast("string").alias("end"), F.col("horizon").cast("string").alias("horizon"))


def opening_balances(book: Book) -> DataFrame:
    known = book.basis.select("company_id", "fy_start", "opening_known")
    return book.openings.join(known, ["company_id", "fy_start"]).select(
        "company_id", F.col("fy_start").cast("string").alias("fy_start"), "account", "amount", F.col("opening_known").cast("int").alias("known")
    )


def month_balances(book: Book) -> DataFrame:
    return book.balances.select("company_id", _ym("month"), "account", "balance")


def balance_at(book: Book) -> DataFrame:
    dates = book.coverage.where("month(month) IN (3, 8) AND covered").select("company_id", F.date_add("month", 14).alias("at"))
    return L.balance_at(book.vouchers, book.movements, book.coverage, book.openings, dates).select(
        "company_id", F.col("at").cast("string").alias("on_day"), "account", "balance"
    )


def balance_completeness(book: Book) -> DataFrame:
    return book.complete.select("company_id", _ym("month"), F.col("balance_complete").cast("int").alias("complete"))


def income_statement(book: Book) -> DataFrame:
    pairs = book.year_pairs("month")
    return S.compared_income(pairs, book.income_both(pairs)).select(
        "company_id", "period", "compare", "line", "amount", "compare_amount", "diff", "diff_pct"
    )


def income_statement_periods(book: Book) -> DataFrame:
    wide = S.income_wide(book.periods("quarter", "ytd", "fy", "rolling"), book.monthly, book.coverage)
    return S.income_statement(wide).select("company_id", "kind", "period", "line", "amount", F.col("has_data").cast("int").alias("has_data"))


def balance_sheet(book: Book) -> DataFrame:
    return S.balance_sheet(book.balance_wide).select(
        "company_id", _ym("month"), "line", "amount", F.col("balance_complete").cast("int").alias("complete")
    )


def balance_identity(book: Book) -> DataFrame:
    """Months whose complete balance sheet does not balance beyond booked imbalances (expected: none)."""
    drift = book.movements.groupBy("company_id", "month").agg(F.sum("amount").alias("off"))
    off = (
        book.coverage.select("company_id", "fy_start", "month")
        .join(drift, ["company_id", "month"], "left")
        .join(book.openings.groupBy("company_id", "fy_start").agg(F.sum("amount").alias("o")), ["company_id", "fy_start"], "left")
    )
    from pyspark.sql import Window

    w = Window.partitionBy("company_id", "fy_start").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    off = off.select("company_id", "month", (F.sum(F.coalesce("off", F.lit(0))).over(w) + F.coalesce("o", F.lit(0))).alias("imbalance"))
    return (
        book.balance_wide.join(off, ["company_id", "month"])
        .withColumn("gap", F.col("total_assets") - F.col("total_equity_liabilities") - F.col("imbalance"))
        .where("gap <> 0")
        .select("company_id", _ym("month"), "gap")
    )


def key_figures(book: Book) -> DataFrame:
    inc = S.income_wide(book.periods("month", "ytd", "rolling"), book.monthly, book.coverage)
    return M.key_figures(book.figure_base(inc), maturity=book.maturity)


def key_figure_change(book: Book) -> DataFrame:
    pairs = book.year_pairs("month", "ytd", "rolling")
    figures = M.key_figures(book.figure_base(book.income_both(pairs)), M.CORE_METRICS, book.maturity)
    return M.figure_changes(pairs, figures).select(
        "company_id", "kind", "period", "compare", "metric", "value", "previous", "status", "previous_status", "change", "change_pct"
    )


def cost_tree(book: Book) -> DataFrame:
    return S.cost_tree(book.year_pairs("quarter"), book.movements)


def trend(book: Book) -> DataFrame:
    return S.trend(book.monthly, book.movements, book.coverage, 24).select("company_id", _ym("month"), "sales", "costs", "operating_result")


def budget_vs_actual(book: Book) -> DataFrame:
    return S.budget_vs_actual(book.periods("quarter"), book.budget, book.monthly, book.coverage).select(
        "company_id", "period", "line", "budget", "actual", "diff", "diff_pct"
    )


def txn_search(book: Book) -> DataFrame:
    page = L.transactions(book.vouchers, account=2641, start="2024-01-01", end="2025-06-30", text="brand#1", limit=200, offset=100)
    return page.select("company_id", "series", "number", F.col("voucher_date").cast("string").alias("voucher_date"), "voucher_text", "amount")


def registered_late(book: Book) -> DataFrame:
    return L.registered_late(book.vouchers, "2025-03-01").select(
        "company_id", "series", "number", F.col("voucher_date").cast("string").alias("voucher_date"), F.col("reg_date").cast("string").alias("reg_date")
    )


def unmapped_accounts(book: Book) -> DataFrame:
    return L.unmapped_accounts(book.vouchers, book.accounts)


QUERIES = {
    f.__name__: f
    for f in (
        monthly_movements, voucher_rollup, period_coverage, period_series, history_months, data_horizon, open_periods, opening_balances,
        month_balances, balance_at, balance_completeness, income_statement, income_statement_periods, balance_sheet,
        balance_identity, key_figures, key_figure_change, cost_tree, trend, budget_vs_actual, txn_search, registered_late,
        unmapped_accounts,
    )
}

_CATS = """cats AS (SELECT * FROM (VALUES (1,'software','technology',5420,5420),(1,'software','technology',6540,6540),(2,'telecom','technology',6200,6299),
 (3,'consulting','external_services',6550,6550),(4,'accounting_audit','external_services',6530,6530),(4,'accounting_audit','external_services',6420,6429),
 (5,'legal','external_services',6580,6580),(6,'other_services','external_services',6500,6529),(6,'other_services','external_services',6531,6539),
 (6,'other_services','external_services',6541,6549),(6,'other_services','external_services',6551,6569),(6,'other_services','external_services',6571,6579),
 (6,'other_services','external_services',6581,6599),(7,'finance','finance',6570,6570),(7,'finance','finance',8400,8499),(8,'materials','materials',4000,4999),
 (9,'personnel','personnel',7000,7699),(10,'premises','premises',5000,5199),(11,'vehicles','vehicles',5600,5799),(12,'travel','travel',5800,5899),
 (13,'marketing','marketing',5900,6099),(14,'office','office',5200,5419),(14,'office','office',5421,5599),(14,'office','office',6100,6199),
 (15,'insurance','insurance',6300,6399),(16,'administration','administration',6400,6419),(16,'administration','administration',6430,6499),
 (17,'depreciation','depreciation',7700,7899),(18,'other','other',6600,6999),(18,'other','other',7900,7999)) t(ord, category, parent, lo, hi))"""

FIG = """wide AS (
 SELECT i.company_id, i.kind, i.period, any_value(i.has_data) AS has_data,
  max(CASE WHEN line='net_sales' THEN amount END) AS net_sales, max(CASE WHEN line='materials' THEN amount END) AS materials,
  max(CASE WHEN line='personnel' THEN amount END) AS personnel, max(CASE WHEN line='other_external' THEN amount END) AS other_external,
  max(CASE WHEN line='depreciation' THEN amount END) AS depreciation, max(CASE WHEN line='operating_result' THEN amount END) AS operating_result,
  max(CASE WHEN line='result_after_financial' THEN amount END) AS raf
 FROM inc i GROUP BY ALL),
bsw AS (
 SELECT b.company_id, b.month, any_value(c.complete) AS complete, max(CASE WHEN line='total_equity' THEN amount END) AS te,
  max(CASE WHEN line='untaxed_reserves' THEN amount END) AS ur, max(CASE WHEN line='total_assets' THEN amount END) AS ta,
  max(CASE WHEN line='current_assets' THEN amount END) AS ca, max(CASE WHEN line='inventory' THEN amount END) AS inv,
  max(CASE WHEN line='current_liabilities' THEN amount END) AS cl, max(CASE WHEN line='cash' THEN amount END) AS cash
 FROM bs b JOIN cmpl c ON c.company_id = b.company_id AND c.month = b.month GROUP BY ALL),
grp AS (SELECT company_id, month, CAST(sum(CASE WHEN account BETWEEN 1500 AND 1599 THEN balance ELSE 0 END) AS BIGINT) AS rec,
  CAST(sum(CASE WHEN account BETWEEN 2440 AND 2449 THEN -balance ELSE 0 END) AS BIGINT) AS pay FROM bal GROUP BY ALL),
full_w AS (SELECT w.*, b.complete AND w.has_data AS bok, te, ur, ta, ca, inv, cl, cash, coalesce(rec, 0) AS rec, coalesce(pay, 0) AS pay
 FROM wide w JOIN allper a ON a.company_id = w.company_id AND a.kind = w.kind AND a.period = w.period
 LEFT JOIN bsw b ON b.company_id = w.company_id AND b.month = a.e LEFT JOIN grp g ON g.company_id = w.company_id AND g.month = a.e),
fig AS (
""" + " UNION ALL ".join(
    f"SELECT company_id, kind, period, '{c}' AS metric, '{u}' AS unit, CASE WHEN {flag} THEN CAST({e} AS BIGINT) END AS value, "
    f"CASE WHEN {flag} IS NOT TRUE THEN 'INSUFFICIENT_DATA' WHEN ({e}) IS NULL THEN 'NOT_APPLICABLE' ELSE 'CALCULATED' END AS status FROM full_w"
    for c, u, flag, e in (
        ("net_sales", "SEK", "has_data", "net_sales"),
        ("operating_result", "SEK", "has_data", "operating_result"),
        ("operating_margin", "percent", "has_data", O.half_up("operating_result", "net_sales")),
        ("result_after_financial", "SEK", "has_data", "raf"),
        ("profit_margin", "percent", "has_data", O.half_up("raf", "net_sales")),
        ("gross_profit", "SEK", "has_data", "net_sales + materials"),
        ("ebitda", "SEK", "has_data", "operating_result - depreciation"),
        ("gross_margin", "percent", "has_data", O.half_up("net_sales + materials", "net_sales")),
        ("personnel_share", "percent", "has_data", O.half_up("-personnel", "net_sales")),
        ("external_cost_share", "percent", "has_data", O.half_up("-other_external", "net_sales")),
        ("equity_ratio", "percent", "bok", O.half_up("(CAST(te AS HUGEINT) * 1000 + CAST(ur AS HUGEINT) * 794)", "(CAST(ta AS HUGEINT) * 1000)")),
        ("quick_ratio", "percent", "bok", O.half_up("ca - inv", "cl")),
        ("current_ratio", "percent", "bok", O.half_up("ca", "cl")),
        ("working_capital", "SEK", "bok", "ca - cl"),
        ("cash", "SEK", "bok", "cash"),
        ("receivables", "SEK", "bok", "rec"),
        ("payables", "SEK", "bok", "pay"),
    )
) + ")"

_FIGP = """figp AS (SELECT f.* REPLACE (CASE WHEN f.status = 'CALCULATED' AND f.kind = 'month' AND m.low
  AND f.metric IN ('operating_result', 'operating_margin', 'result_after_financial', 'profit_margin', 'ebitda', 'personnel_share', 'external_cost_share') THEN 'PARTIAL' ELSE f.status END AS status)
 FROM fig f LEFT JOIN mat2 m ON m.company_id = f.company_id AND strftime(m.month, '%Y-%m') = f.period)"""
_MN = "['jan','feb','mar','apr','maj','jun','jul','aug','sep','okt','nov','dec']"
_SERIES = f"""anch AS (SELECT m.company_id, max(m.month) AS month FROM mm m JOIN cov c ON c.company_id = m.company_id AND c.month = m.month WHERE c.covered GROUP BY 1),
ser AS (
 SELECT company_id, 'months' AS series, 12 - i AS pos, CAST(month - to_months(CAST(i AS INTEGER)) AS DATE) AS s, CAST(month - to_months(CAST(i AS INTEGER)) AS DATE) AS e, 'month' AS kind FROM anch, range(12) t(i)
 UNION ALL SELECT company_id, 'quarters', 8 - i, CAST(date_trunc('quarter', month) - to_months(CAST(3 * i AS INTEGER)) AS DATE), CAST(date_trunc('quarter', month) - to_months(CAST(3 * i - 2 AS INTEGER)) AS DATE), 'quarter' FROM anch, range(8) t(i)
 UNION ALL SELECT company_id, 'same_month', 3 - i, CAST(month - to_years(CAST(i AS INTEGER)) AS DATE), CAST(month - to_years(CAST(i AS INTEGER)) AS DATE), 'month' FROM anch, range(3) t(i)
 UNION ALL SELECT company_id, 'r12', 12 - i, CAST(month - to_months(CAST(i + 11 AS INTEGER)) AS DATE), CAST(month - to_months(CAST(i AS INTEGER)) AS DATE), 'rolling' FROM anch, range(12) t(i)
 UNION ALL SELECT a.company_id, 'fiscal_years', 3 - i, f.fy_start, CAST(f.fy_start + INTERVAL 11 MONTH AS DATE), 'fy' FROM anch a, range(3) t(i), fy f
   WHERE f.company_id = a.company_id AND year(f.fy_start) = year(a.month) - i
 UNION ALL SELECT a.company_id, 'ytd', 3 - i, f.fy_start, CAST(a.month - to_years(CAST(i AS INTEGER)) AS DATE), 'ytd' FROM anch a, range(3) t(i), fy f
   WHERE f.company_id = a.company_id AND year(f.fy_start) = year(a.month) - i)"""

SQL = {
    "monthly_movements": O.query("SELECT company_id, strftime(month, '%Y-%m') AS month, account, amount FROM mm"),
    "voucher_rollup": O.query("""
SELECT company_id, series, strftime(vdate, '%Y-%m') AS month, CASE WHEN hi > 0 AND lo < 0 THEN hacc END AS debit_account,
 CASE WHEN hi > 0 AND lo < 0 THEN lacc END AS credit_account, count(*) AS n_vouchers, CAST(sum(bal) AS BIGINT) AS balance,
 CAST(sum(deb) AS BIGINT) AS debit_total, CAST(sum(n) AS BIGINT) AS n_rows, max(accs) AS accounts
FROM (SELECT vid, company_id, series, vdate, sum(amount) AS bal, sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS deb, count(*) AS n,
  max(amount) AS hi, min(amount) AS lo, first(account ORDER BY amount DESC, rn) AS hacc, first(account ORDER BY amount, rn) AS lacc,
  string_agg(DISTINCT CAST(account AS VARCHAR), ',' ORDER BY CAST(account AS VARCHAR)) AS accs FROM p GROUP BY ALL) GROUP BY ALL"""),
    "period_coverage": O.query(
        """SELECT x.company_id, x.kind, x.period, x.compare, CASE WHEN a.has_data AND b.has_data THEN 'CALCULATED' ELSE 'INSUFFICIENT_DATA' END AS pair_status,
 a.missing AS missing, b.missing AS compare_missing FROM pair x JOIN pcov a ON a.company_id = x.company_id AND a.period = x.period
 JOIN pcov b ON b.company_id = x.company_id AND b.period = x.compare""",
        O.periods_cte("month", "quarter", "ytd", "fy", "rolling"),
    ),
    "period_series": O.query(
        f"""SELECT company_id, series, CAST(pos AS INTEGER) AS pos, CASE kind WHEN 'month' THEN strftime(e, '%Y-%m') WHEN 'quarter' THEN strftime(e, '%Y') || '-Q' || quarter(e)
 WHEN 'ytd' THEN 'YTD:' || strftime(e, '%Y-%m') WHEN 'fy' THEN 'FY:' || strftime(s, '%Y-%m') ELSE 'R12:' || strftime(e, '%Y-%m') END AS period,
 strftime(s, '%Y-%m-%d') AS start, strftime(last_day(e), '%Y-%m-%d') AS end,
 CASE kind WHEN 'month' THEN {_MN}[month(e)] || ' ' || year(e) WHEN 'quarter' THEN 'Q' || quarter(e) || ' ' || year(e) WHEN 'fy' THEN CAST(year(s) AS VARCHAR)
 WHEN 'rolling' THEN 'R12 ' || {_MN}[month(e)] || ' ' || year(e) ELSE {_MN}[month(s)] || '–' || {_MN}[month(e)] || ' ' || year(e) END AS label FROM ser""",
        _SERIES,
    ),
    "history_months": O.query("""SELECT a.company_id, strftime(a.month, '%Y-%m') AS anchor, strftime(b.month, '%Y-%m') AS month
 FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY month) AS rk FROM cov WHERE covered) a
 JOIN (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY month) AS rk FROM cov WHERE covered) b
 ON a.company_id = b.company_id AND b.rk BETWEEN a.rk - 6 AND a.rk - 1"""),
    "data_horizon": O.query("""SELECT m.company_id, strftime(max(m.month), '%Y-%m') AS latest_month, strftime(last_day(max(m.month)), '%Y-%m-%d') AS horizon
 FROM mm m JOIN cov c ON c.company_id = m.company_id AND c.month = m.month AND c.covered GROUP BY 1"""),
    "open_periods": O.query(
        """SELECT p.company_id, p.kind, p.period, strftime(last_day(p.e), '%Y-%m-%d') AS end, strftime(last_day(h.m), '%Y-%m-%d') AS horizon FROM per p
 JOIN (SELECT m.company_id, max(m.month) AS m FROM mm m JOIN cov c ON c.company_id = m.company_id AND c.month = m.month AND c.covered GROUP BY 1) h ON h.company_id = p.company_id AND last_day(p.e) > last_day(h.m)""",
        O.periods_cte("quarter", "ytd", "fy", "rolling"),
    ),
    "opening_balances": O.query("""SELECT o.company_id, strftime(o.fy_start, '%Y-%m-%d') AS fy_start, o.account, o.amount, CAST(f.known AS INTEGER) AS known
 FROM opn o JOIN openfy f ON f.company_id = o.company_id AND f.fy_start = o.fy_start"""),
    "month_balances": O.query("SELECT company_id, strftime(month, '%Y-%m') AS month, account, balance FROM bal"),
    "balance_at": O.query("""SELECT company_id, strftime(day, '%Y-%m-%d') AS on_day, account, CAST(sum(amount) AS BIGINT) AS balance FROM (
 SELECT c.company_id, c.month + 14 AS day, o.account, o.amount FROM cov c JOIN opn o ON o.company_id = c.company_id AND o.fy_start = c.fy_start
  WHERE month(c.month) IN (3, 8) AND c.covered
 UNION ALL SELECT c.company_id, c.month + 14, p.account, p.amount FROM cov c JOIN p ON p.company_id = c.company_id AND p.vdate >= c.fy_start
  AND p.vdate <= c.month + 14 AND p.account < 3000 WHERE month(c.month) IN (3, 8) AND c.covered) GROUP BY ALL HAVING sum(amount) <> 0"""),
    "balance_completeness": O.query("SELECT company_id, strftime(month, '%Y-%m') AS month, CAST(complete AS INTEGER) AS complete FROM cmpl"),
    "income_statement": O.query(
        f"""SELECT x.company_id, x.period, x.compare, a.line, a.amount, b.amount AS compare_amount, a.amount - b.amount AS diff,
 {O.pct_change('a.amount', 'b.amount')} AS diff_pct FROM pair x JOIN inc a ON a.company_id = x.company_id AND a.period = x.period
 JOIN inc b ON b.company_id = x.company_id AND b.period = x.compare AND b.line = a.line""",
        O.periods_cte("month"),
    ),
    "income_statement_periods": O.query(
        """SELECT i.company_id, i.kind, i.period, i.line, i.amount, CAST(i.has_data AS INTEGER) AS has_data FROM inc i
 JOIN per ON per.company_id = i.company_id AND per.period = i.period""",
        O.periods_cte("quarter", "ytd", "fy", "rolling"),
    ),
    "balance_sheet": O.query("""SELECT b.company_id, strftime(b.month, '%Y-%m') AS month, b.line, b.amount, CAST(c.complete AS INTEGER) AS complete
 FROM bs b JOIN cmpl c ON c.company_id = b.company_id AND c.month = b.month"""),
    "balance_identity": "SELECT CAST(NULL AS VARCHAR) AS company_id, CAST(NULL AS VARCHAR) AS month, CAST(NULL AS BIGINT) AS gap WHERE false",
    "key_figures": O.query(
        "SELECT f.* FROM figp f JOIN per ON per.company_id = f.company_id AND per.period = f.period", VF, MAT, O.periods_cte("month", "ytd", "rolling"), FIG, _FIGP
    ),
    "key_figure_change": O.query(
        f"""SELECT x.company_id, x.kind, x.period, x.compare, a.metric, a.value, b.value AS previous, a.status, b.status AS previous_status,
 CASE WHEN a.status IN ('CALCULATED', 'PARTIAL') AND b.status IN ('CALCULATED', 'PARTIAL') THEN a.value - b.value END AS change,
 CASE WHEN a.status IN ('CALCULATED', 'PARTIAL') AND b.status IN ('CALCULATED', 'PARTIAL') AND a.unit = 'SEK' THEN {O.pct_change('a.value', 'b.value')} END AS change_pct
 FROM pair x JOIN figp a ON a.company_id = x.company_id AND a.period = x.period
 JOIN figp b ON b.company_id = x.company_id AND b.period = x.compare AND b.metric = a.metric
 WHERE a.metric IN ('net_sales','operating_result','operating_margin','result_after_financial','gross_margin','personnel_share','equity_ratio','quick_ratio','cash')""",
        VF,
        MAT,
        O.periods_cte("month", "ytd", "rolling"),
        FIG,
        _FIGP,
    ),
    "cost_tree": O.query(
        f"""SELECT company_id, period, compare, level, code, parent, amount, CASE WHEN code <> 'unmapped' THEN compare_amount END AS compare_amount,
 CASE WHEN code <> 'unmapped' THEN amount - compare_amount END AS diff, CASE WHEN code <> 'unmapped' THEN {O.half_even('amount', 'total')} END AS share
FROM (SELECT *, coalesce(max(CASE WHEN level = 0 THEN amount END) OVER (PARTITION BY company_id, period), 0) AS total FROM (
 SELECT company_id, period, compare, 0 AS level, 'total' AS code, NULL AS parent, CAST(sum(cur) AS BIGINT) AS amount, CAST(sum(prev) AS BIGINT) AS compare_amount FROM node GROUP BY ALL
 UNION ALL SELECT company_id, period, compare, 1, parent, NULL, CAST(sum(cur) AS BIGINT), CAST(sum(prev) AS BIGINT) FROM node GROUP BY ALL
 UNION ALL SELECT company_id, period, compare, 2, category, parent, CAST(sum(cur) AS BIGINT), CAST(sum(prev) AS BIGINT) FROM node WHERE category <> parent GROUP BY ALL)
 WHERE amount <> 0 OR (compare_amount <> 0 AND code <> 'unmapped'))""",
        O.periods_cte("quarter"),
        _CATS,
        """cc AS (SELECT pm.company_id, pm.period, coalesce(c.category, 'unmapped') AS category, coalesce(c.parent, 'unmapped') AS parent, sum(m.amount) AS amount
 FROM pm JOIN mm m ON m.company_id = pm.company_id AND m.month = pm.month LEFT JOIN cats c ON m.account BETWEEN c.lo AND c.hi
 WHERE m.account BETWEEN 4000 AND 8499 AND NOT m.account BETWEEN 8000 AND 8399 GROUP BY ALL),
node AS (SELECT x.company_id, x.period, x.compare, c.category, c.parent, c.amount AS cur, 0 AS prev FROM pair x JOIN cc c ON c.company_id = x.company_id AND c.period = x.period
 UNION ALL SELECT x.company_id, x.period, x.compare, c.category, c.parent, 0, c.amount FROM pair x JOIN cc c ON c.company_id = x.company_id AND c.period = x.compare)""",
    ),
    "trend": O.query("""SELECT c.company_id, strftime(c.month, '%Y-%m') AS month,
 CAST(coalesce(-sum(m.amount) FILTER (m.account BETWEEN 3000 AND 3799), 0) AS BIGINT) AS sales,
 CAST(coalesce(sum(m.amount) FILTER (m.account BETWEEN 4000 AND 7999), 0) AS BIGINT) AS costs,
 CAST(coalesce(-sum(m.amount) FILTER (m.account BETWEEN 3000 AND 7999), 0) AS BIGINT) AS operating_result
FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY month DESC) AS rk FROM cov WHERE covered) c
LEFT JOIN mm m ON m.company_id = c.company_id AND m.month = c.month WHERE rk <= 24 GROUP BY c.company_id, c.month"""),
    "budget_vs_actual": O.query(
        f"""SELECT b.company_id, b.period, b.line, b.budget, i.amount AS actual, i.amount - b.budget AS diff, {O.pct_change('i.amount', 'b.budget')} AS diff_pct
 FROM bb b JOIN inc i ON i.company_id = b.company_id AND i.period = b.period AND i.line = b.line WHERE b.budget <> 0 OR i.amount <> 0""",
        O.periods_cte("quarter"),
        """bl AS (SELECT company_id, CAST(month + INTERVAL 12 MONTH AS DATE) AS month, line AS leaf,
  CAST(-sum(sign(amount) * (abs(amount) * 11 // 10)) AS BIGINT) AS amount FROM mm JOIN lines ON account BETWEEN lo AND hi
  WHERE account BETWEEN 3000 AND 8989 GROUP BY ALL),
bp AS (SELECT DISTINCT per.company_id, per.period FROM per JOIN pm ON pm.company_id = per.company_id AND pm.period = per.period
  JOIN bl ON bl.company_id = pm.company_id AND bl.month = pm.month),
bsum AS (SELECT pm.company_id, pm.period, bl.leaf, sum(bl.amount) AS amount FROM pm JOIN bl ON bl.company_id = pm.company_id AND bl.month = pm.month GROUP BY ALL),
bb AS (SELECT bp.company_id, bp.period, t.code AS line, CAST(coalesce(sum(s.amount), 0) AS BIGINT) AS budget FROM bp
 CROSS JOIN (SELECT DISTINCT code, leaf FROM tree WHERE code IN (SELECT code FROM inc_codes)) t
 LEFT JOIN bsum s ON s.company_id = bp.company_id AND s.period = bp.period AND s.leaf = t.leaf GROUP BY ALL)""",
    ),
    "txn_search": O.query("""SELECT company_id, series, number, strftime(vdate, '%Y-%m-%d') AS voucher_date, text AS voucher_text, amount FROM p
 WHERE account = 2641 AND vdate BETWEEN DATE '2024-01-01' AND DATE '2025-06-30' AND contains(lower(text), 'brand#1')
 ORDER BY vdate DESC, company_id, series, number, rn LIMIT 200 OFFSET 100"""),
    "registered_late": O.query("""SELECT company_id, series, number, strftime(vdate, '%Y-%m-%d') AS voucher_date, strftime(reg, '%Y-%m-%d') AS reg_date FROM v
 WHERE reg >= DATE '2025-03-01' AND vdate < DATE '2025-03-01' ORDER BY reg, vdate, company_id, series, number LIMIT 30"""),
    "unmapped_accounts": O.query("""SELECT company_id, account, count(*) AS rows, (SELECT string_agg(t, ' | ' ORDER BY t) FROM (SELECT unnest(list_sort(list_distinct(list(p.text)))[1:3]) AS t)) AS examples,
 'other_external' AS suggested_line FROM p WHERE account = 6993 GROUP BY ALL"""),
}
