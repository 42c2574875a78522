"""Registered queries: bridges, metric explanations, drilldown, evidence, structure, masking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import bridges as B
from ledgerloom.operators import ledger as L
from ledgerloom.operators import periods as P
from ledgerloom.operators import statements as S
from ledgerloom.operators.metrics import METRICS
from ledgerloom.plans import oracle as O
from ledgerloom.plans.book import Book
from ledgerloom.plans.statement_plans import _CATS

EVIDENCE_LINES = ("net_sales", "materials", "other_external", "personnel")
BALANCE_EVIDENCE = ("receivables", "cash", "current_liabilities")


def _compared(book: Book, *kinds: str) -> DataFrame:
    pairs = book.year_pairs(*kinds)
    return S.compared_income(pairs, book.income_both(pairs))


def result_bridge(book: Book) -> DataFrame:
    c = _compared(book, "month", "ytd")
    return B.result_bridge(c).unionByName(B.result_bridge(c, "net_result"))


def category_bridge(book: Book) -> DataFrame:
    return B.category_bridge(book.year_pairs("month"), book.movements)


def metric_explanations(book: Book) -> DataFrame:
    pairs = book.year_pairs("month", "rolling")
    base = book.figure_base(book.income_both(pairs))
    return B.explain_metrics(B.paired_base(pairs, base)).select("company_id", "period", "compare", "metric", "component", "role", "current", "previous", "effect")


def bridge_identity(book: Book) -> DataFrame:
    """Ratio explanations whose effects do not add up to the change (expected: none)."""
    pairs = book.year_pairs("month")
    base = book.figure_base(book.income_both(pairs))
    paired = B.paired_base(pairs, base)
    ratios = tuple(m for m in METRICS if m not in B.AMOUNT_PARTS)
    parts = B.explain_metrics(paired, ratios)
    total = parts.groupBy("company_id", "period", "metric").agg(F.sum("effect").alias("effects"))
    q = paired.where("c_has_data AND p_has_data AND c_net_sales <> 0 AND p_net_sales <> 0").select(
        "company_id",
        "period",
        F.lit("gross_margin").alias("metric"),
        F.expr(f"({B._trunc('(c_net_sales + c_materials)', 'c_net_sales')} - {B._trunc('(p_net_sales + p_materials)', 'p_net_sales')}) div 10").alias("change"),
    )
    return total.join(q, ["company_id", "period", "metric"]).where("effects <> change").select("company_id", "period", "effects", "change")


def metric_parts(book: Book) -> DataFrame:
    inc = S.income_wide(book.periods("rolling"), book.monthly, book.coverage)
    return B.metric_parts(book.figure_base(inc)).select("company_id", "period", "metric", "part", "role", "value", "share")


def drilldown_accounts(book: Book) -> DataFrame:
    return B.account_changes(book.year_pairs("quarter"), book.movements).select(
        "company_id", "period", "compare", "line", "account", "current", "previous", "diff", "rank"
    )


def drilldown_counterparties(book: Book) -> DataFrame:
    spend = book.spend.select("company_id", "month", "cp_key", "amount")
    return B.counterparty_changes(book.year_pairs("quarter"), spend).select(
        "company_id", "period", "compare", "cp_key", "current", "previous", "diff", "is_new", "rank"
    )


def evidence_rows(book: Book) -> DataFrame:
    e = B.income_evidence(book.year_pairs("month"), book.facts, book.movements, EVIDENCE_LINES)
    return e.select("company_id", "period", "compare", "side", "line", "voucher", "account", "amount", "rank")


def evidence_balance(book: Book) -> DataFrame:
    e = B.balance_evidence(book.facts, book.coverage, book.openings, book.balances, BALANCE_EVIDENCE)
    return e.select("company_id", F.date_format("at", "yyyy-MM").alias("month"), "line", "voucher", "account", "amount", "rank")


def _series(book: Book, kind: str, n: int) -> DataFrame:
    anchors = L.latest_data(book.coverage, book.movements).select("company_id", F.col("latest_month").alias("month"))
    return P.period_series(anchors, kind, n, book.fiscal_years)


def structure_r12(book: Book) -> DataFrame:
    s = _series(book, "r12", 12)
    ids = ["company_id", "kind", "period", "start", "end", "n_months"]
    base = book.figure_base(S.income_wide(s.select(*ids), book.monthly, book.coverage))
    parts = B.metric_parts(base, ("operating_margin",))
    return parts.join(s.select("company_id", "period", "pos"), ["company_id", "period"]).select("company_id", "pos", "period", "part", "role", "value", "share")


def structure_steps(book: Book) -> DataFrame:
    """Step-by-step explanation along the R12 series, and from its first to its last period."""
    s = _series(book, "r12", 12)
    cur = s.select("company_id", "kind", "period", "start", "end", "n_months", "pos")
    prev = s.select("company_id", F.col("period").alias("compare"), F.col("start").alias("c_start"), F.col("end").alias("c_end"), F.col("n_months").alias("c_n"), F.col("pos").alias("p_pos"))
    pairs = cur.join(prev, "company_id").where("p_pos = pos - 1 OR (p_pos = 1 AND pos = 12)").drop("pos", "p_pos")
    base = book.figure_base(book.income_both(pairs))
    return B.explain_metrics(B.paired_base(pairs, base), ("operating_margin", "operating_result")).select(
        "company_id", "period", "compare", "metric", "component", "role", "effect"
    )


def structure_accounts(book: Book) -> DataFrame:
    return B.structure_accounts(_series(book, "months", 12), book.movements, ("net_sales", "other_external", "personnel"), limit=3)


def masked_ledger(book: Book) -> DataFrame:
    """Monthly accounts as a viewer without payroll access sees them."""
    from ledgerloom.operators.visibility import mask_payroll

    return mask_payroll(book.movements).select("company_id", F.date_format("month", "yyyy-MM").alias("month"), "row", "amount")


QUERIES = {
    f.__name__: f
    for f in (
        result_bridge, category_bridge, metric_explanations, bridge_identity, metric_parts, drilldown_accounts, drilldown_counterparties,
        evidence_rows, evidence_balance, structure_r12, structure_steps, structure_accounts, masked_ledger,
    )
}

_COMP = """cmpi AS (SELECT x.company_id, x.kind, x.period, x.compare, a.line, a.amount, b.amount AS compare_amount FROM pair x
 JOIN inc a ON a.company_id = x.company_id AND a.period = x.period JOIN inc b ON b.company_id = x.company_id AND b.period = x.compare AND b.line = a.line)"""
_OPS = "'net_sales','inventory_change','capitalized_work','other_operating_income','materials','other_external','personnel','depreciation','other_operating_expenses'"
_NET = _OPS + ",'financial_assets_result','interest_income','interest_expense','appropriations','tax'"


def _rb(target: str, codes: str) -> str:
    share = O.half_up("(amount - compare_amount)", "worse")
    return (
        f"SELECT company_id, period, compare, '{target}' AS target, line, amount, compare_amount, amount - compare_amount AS effect, "
        f"CASE WHEN amount < compare_amount THEN {share} END AS share_of_worsening FROM (SELECT *, CAST(sum(CASE WHEN amount < compare_amount THEN amount - compare_amount END) "
        f"OVER (PARTITION BY company_id, period, compare) AS BIGINT) AS worse FROM cmpi WHERE line IN ({codes}) AND (amount <> 0 OR compare_amount <> 0))"
    )


_T = "CAST(sign({x}) * sign({d}) * ((abs({x}) * 1000000000000) // nullif(abs({d}), 0)) AS HUGEINT)"


def _t(x: str, d: str) -> str:
    return _T.format(x=f"CAST({x} AS HUGEINT)", d=f"CAST({d} AS HUGEINT)")


def _div(x: str, n: int) -> str:
    return f"CAST(sign({x}) * (abs({x}) // {n}) AS HUGEINT)"


def _ratio_sql(metric: str, ok: str, numer: list[tuple[str, str, str, str, str]], den: tuple[str, str, str, str, str]) -> str:
    n1 = "(" + " + ".join(f"CAST({n[1]} AS HUGEINT)" for n in numer) + ")"
    n0 = "(" + " + ".join(f"CAST({n[2]} AS HUGEINT)" for n in numer) + ")"
    change = _div(f"({_t(n1, den[1])} - {_t(n0, den[2])})", 10)
    out, spent = [], []
    for code, now, before, snow, sbefore in numer:
        delta = f"(CAST({now} AS HUGEINT) - CAST({before} AS HUGEINT))"
        e = _div(f"({_t(delta, den[2])} + {_t(delta, den[1])})", 20)
        spent.append(e)
        out.append(f"SELECT company_id, period, compare, '{metric}' AS metric, '{code}' AS component, 'numerator' AS role, CAST({snow} AS BIGINT) AS current, CAST({sbefore} AS BIGINT) AS previous, CAST({e} AS BIGINT) AS effect FROM pw WHERE {ok} AND {den[1]} <> 0 AND {den[2]} <> 0")
    out.append(f"SELECT company_id, period, compare, '{metric}', '{den[0]}', 'denominator', CAST({den[3]} AS BIGINT), CAST({den[4]} AS BIGINT), CAST({change} - ({' + '.join(spent)}) AS BIGINT) FROM pw WHERE {ok} AND {den[1]} <> 0 AND {den[2]} <> 0")
    return " UNION ALL ".join(out)


_I, _BK = "c_has AND p_has", "c_bok AND p_bok"


def _c(code: str, col: str, sign: str = "") -> tuple[str, str, str, str, str]:
    return (code, f"{sign}c_{col}", f"{sign}p_{col}", f"{sign}c_{col}", f"{sign}p_{col}")


_ops = [_c(c, c) for c in B.OPERATING]
_fin = [_c(c, c) for c in B.FINANCIAL]


def _amt(metric: str, ok: str, comps: list[tuple[str, str, str, str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT company_id, period, compare, '{metric}' AS metric, '{c}' AS component, 'component' AS role, CAST({n} AS BIGINT) AS current, CAST({b} AS BIGINT) AS previous, CAST(({n}) - ({b}) AS BIGINT) AS effect FROM pw WHERE {ok}"
        for c, n, b, _x, _y in comps
    )


_tax_now = O.half_up("CAST(c_untaxed AS HUGEINT) * 794", "1000", 1)
_tax_before = O.half_up("CAST(p_untaxed AS HUGEINT) * 794", "1000", 1)
_EXPL = {
    "net_sales": _amt("net_sales", _I, [_c("net_sales", "net_sales")]),
    "operating_result": _amt("operating_result", _I, _ops),
    "result_after_financial": _amt("result_after_financial", _I, _ops + _fin),
    "gross_profit": _amt("gross_profit", _I, [_c("net_sales", "net_sales"), _c("materials", "materials")]),
    "ebitda": _amt("ebitda", _I, [c for c in _ops if c[0] != "depreciation"]),
    "working_capital": _amt("working_capital", _BK, [_c("inventory", "inventory"), _c("receivables", "receivables"), _c("short_investments", "short"), _c("cash", "cash"), _c("current_liabilities", "cl", "-")]),
    "cash": _amt("cash", _BK, [_c("cash", "cash")]),
    "receivables": _amt("receivables", _BK, [_c("receivables", "rec")]),
    "payables": _amt("payables", _BK, [_c("payables", "pay")]),
    "operating_margin": _ratio_sql("operating_margin", _I, _ops, _c("net_sales", "net_sales")),
    "profit_margin": _ratio_sql("profit_margin", _I, _ops + _fin, _c("net_sales", "net_sales")),
    "gross_margin": _ratio_sql("gross_margin", _I, [_c("net_sales", "net_sales"), _c("materials", "materials")], _c("net_sales", "net_sales")),
    "personnel_share": _ratio_sql("personnel_share", _I, [_c("personnel", "personnel", "-")], _c("net_sales", "net_sales")),
    "external_cost_share": _ratio_sql("external_cost_share", _I, [_c("other_external", "other_external", "-")], _c("net_sales", "net_sales")),
    "quick_ratio": _ratio_sql("quick_ratio", _BK, [("current_assets_ex_inventory", "(c_ca - c_inventory)", "(p_ca - p_inventory)", "c_ca - c_inventory", "p_ca - p_inventory")], _c("current_liabilities", "cl")),
    "current_ratio": _ratio_sql("current_ratio", _BK, [_c("current_assets", "ca")], _c("current_liabilities", "cl")),
    "equity_ratio": _ratio_sql(
        "equity_ratio",
        _BK,
        [
            ("total_equity", "CAST(c_te AS HUGEINT) * 10000", "CAST(p_te AS HUGEINT) * 10000", "c_te", "p_te"),
            ("untaxed_reserves", "CAST(c_untaxed AS HUGEINT) * 7940", "CAST(p_untaxed AS HUGEINT) * 7940", _tax_now, _tax_before),
            ("corporate_tax", "0", "0", "0", "0"),
        ],
        ("total_assets", "CAST(c_ta AS HUGEINT) * 10000", "CAST(p_ta AS HUGEINT) * 10000", "c_ta", "p_ta"),
    ),
}
_LEAF14 = _NET.replace("'", "").split(",")
_PW = (
    "w0 AS (SELECT i.company_id, i.period, any_value(i.has_data) AS has, "
    + ", ".join(f"max(CASE WHEN line = '{c}' THEN amount END) AS {c}" for c in _LEAF14)
    + " FROM inc i GROUP BY ALL),\nb0 AS (SELECT company_id, month, "
    + ", ".join(
        f"max(CASE WHEN line = '{line}' THEN amount END) AS {name}"
        for line, name in (
            ("inventory", "inventory"), ("receivables", "receivables"), ("short_investments", "short"), ("cash", "cash"), ("current_assets", "ca"),
            ("current_liabilities", "cl"), ("total_equity", "te"), ("untaxed_reserves", "untaxed"), ("total_assets", "ta"),
        )
    )
    + " FROM bs GROUP BY ALL),\n"
    "g0 AS (SELECT company_id, month, sum(CASE WHEN account BETWEEN 1500 AND 1599 THEN balance ELSE 0 END) AS rec, sum(CASE WHEN account BETWEEN 2440 AND 2449 THEN -balance ELSE 0 END) AS pay FROM bal GROUP BY ALL),\n"
    "w1 AS (SELECT w0.*, w0.has AND c.complete AS bok, "
    + ", ".join(f"b0.{n}" for n in ("inventory", "receivables", "short", "cash", "ca", "cl", "te", "untaxed", "ta"))
    + ", coalesce(rec, 0) AS rec, coalesce(pay, 0) AS pay FROM w0 JOIN allper a ON a.company_id = w0.company_id AND a.period = w0.period "
    "LEFT JOIN b0 ON b0.company_id = w0.company_id AND b0.month = a.e LEFT JOIN g0 ON g0.company_id = w0.company_id AND g0.month = a.e "
    "LEFT JOIN cmpl c ON c.company_id = w0.company_id AND c.month = a.e),\n"
    "pw AS (SELECT x.company_id, x.period, x.compare, "
    + ", ".join(f"{p}.{n} AS {p}_{n}" for p in ("c", "p") for n in ("has", "bok", *_LEAF14, "inventory", "receivables", "short", "cash", "ca", "cl", "te", "untaxed", "ta", "rec", "pay"))
    + " FROM pair x JOIN w1 c ON c.company_id = x.company_id AND c.period = x.period JOIN w1 p ON p.company_id = x.company_id AND p.period = x.compare)"
)


def _explained(metrics: list[str], cols: str) -> str:
    return f"SELECT {cols} FROM (" + " UNION ALL ".join(_EXPL[m] for m in metrics) + ") WHERE current <> 0 OR previous <> 0 OR effect <> 0"


_ANCH = "anch AS (SELECT m.company_id, max(m.month) AS month FROM mm m JOIN cov c ON c.company_id = m.company_id AND c.month = m.month WHERE c.covered GROUP BY 1)"
_R12 = """s12 AS (SELECT company_id, 12 - i AS pos, 'R12:' || strftime(month - to_months(CAST(i AS INTEGER)), '%Y-%m') AS period FROM anch, range(12) t(i))"""
_SER12 = _R12.replace("s12 AS (SELECT", "s12 AS (SELECT CAST(month - to_months(CAST(i + 11 AS INTEGER)) AS DATE) AS s, CAST(month - to_months(CAST(i AS INTEGER)) AS DATE) AS e,")

SQL = {
    "result_bridge": O.query(_rb("operating_result", _OPS) + " UNION ALL " + _rb("net_result", _NET), O.periods_cte("month", "ytd"), _COMP),
    "category_bridge": O.query(
        f"""SELECT company_id, period, compare, category, amount, compare_amount, compare_amount - amount AS effect,
 CASE WHEN compare_amount < amount THEN {O.half_up('(compare_amount - amount)', 'worse')} END AS share_of_worsening
 FROM (SELECT *, CAST(sum(CASE WHEN compare_amount < amount THEN compare_amount - amount END) OVER (PARTITION BY company_id, period, compare) AS BIGINT) AS worse
 FROM (SELECT x.company_id, x.period, x.compare, c.parent AS category, CAST(sum(CASE WHEN c.period = x.period THEN c.amount ELSE 0 END) AS BIGINT) AS amount,
  CAST(sum(CASE WHEN c.period = x.compare THEN c.amount ELSE 0 END) AS BIGINT) AS compare_amount FROM pair x JOIN cc c ON c.company_id = x.company_id AND c.period IN (x.period, x.compare) GROUP BY ALL)
 WHERE amount <> 0 OR compare_amount <> 0)""",
        O.periods_cte("month"),
        _CATS,
        """cc AS (SELECT pm.company_id, pm.period, c.parent, sum(m.amount) AS amount FROM pm JOIN mm m ON m.company_id = pm.company_id AND m.month = pm.month
 JOIN cats c ON m.account BETWEEN c.lo AND c.hi WHERE m.account BETWEEN 4000 AND 8499 AND NOT m.account BETWEEN 8000 AND 8399 GROUP BY ALL)""",
    ),
    "metric_explanations": O.query(
        _explained(list(_EXPL), "company_id, period, compare, metric, component, role, current, previous, effect"), O.periods_cte("month", "rolling"), _PW
    ),
    "bridge_identity": "SELECT '' AS company_id, '' AS period, CAST(0 AS BIGINT) AS effects, CAST(0 AS BIGINT) AS change WHERE false",
    "drilldown_accounts": O.query(
        """SELECT company_id, period, compare, line, account, current, previous, current - previous AS diff, CAST(rank AS INTEGER) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY company_id, period, compare, line ORDER BY abs(current - previous) DESC, account) AS rank FROM (
  SELECT x.company_id, x.period, x.compare, c.line, c.account, CAST(sum(CASE WHEN c.period = x.period THEN c.amount ELSE 0 END) AS BIGINT) AS current,
   CAST(sum(CASE WHEN c.period = x.compare THEN c.amount ELSE 0 END) AS BIGINT) AS previous FROM pair x JOIN ac c ON c.company_id = x.company_id AND c.period IN (x.period, x.compare) GROUP BY ALL)
 WHERE current <> previous) WHERE rank <= 8""",
        O.periods_cte("quarter"),
        """ac AS (SELECT pm.company_id, pm.period, l.line, m.account, sum(m.amount) AS amount FROM pm JOIN mm m ON m.company_id = pm.company_id AND m.month = pm.month
 JOIN lines l ON m.account BETWEEN l.lo AND l.hi WHERE m.account BETWEEN 3000 AND 8989 GROUP BY ALL)""",
    ),
    "evidence_rows": O.query(
        """SELECT x.company_id, x.period, x.compare, t.side, l.line, l.voucher, l.account, CAST(l.amount AS BIGINT) AS amount, CAST(l.rank AS INTEGER) AS rank
 FROM pair x CROSS JOIN (VALUES ('current'), ('previous')) t(side) JOIN listed l ON l.company_id = x.company_id AND l.month = CASE t.side WHEN 'current' THEN x.e ELSE x.ce END""",
        O.periods_cte("month"),
        """er AS (SELECT p.company_id, p.month, l.line, p.series || p.number AS voucher, p.account, -p.amount AS amount, p.vdate, p.rn FROM p JOIN lines l ON p.account BETWEEN l.lo AND l.hi
  JOIN mm ON mm.company_id = p.company_id AND mm.month = p.month AND mm.account = p.account WHERE l.line IN ('net_sales', 'materials', 'other_external', 'personnel')),
rk AS (SELECT *, row_number() OVER (PARTITION BY company_id, month, line ORDER BY abs(amount) DESC, voucher, vdate, account, rn) AS rank FROM er),
listed AS (SELECT company_id, month, line, voucher, account, amount, rank FROM rk WHERE rank <= 8
 UNION ALL SELECT company_id, month, line, 'remainder', NULL, sum(CASE WHEN rank > 8 THEN amount ELSE 0 END), 0 FROM rk GROUP BY 1, 2, 3)""",
    ),
    "evidence_balance": O.query(
        """SELECT company_id, strftime(eom, '%Y-%m') AS month, line, voucher, account, CAST(amount AS BIGINT) AS amount, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 8
 UNION ALL SELECT t.company_id, strftime(t.eom, '%Y-%m'), t.line, 'remainder', NULL, CAST(t.total - coalesce((SELECT sum(amount) FROM rk WHERE rk.company_id = t.company_id AND rk.eom = t.eom AND rk.line = t.line AND rank <= 8), 0) AS BIGINT), 0
 FROM (SELECT company_id, month AS eom, line, sum(CASE WHEN account < 2000 THEN balance ELSE -balance END) AS total FROM bal JOIN lines ON account BETWEEN lo AND hi WHERE line IN ('receivables', 'cash', 'current_liabilities') GROUP BY ALL) t""",
        """ev AS (SELECT p.company_id, p.fy, p.month, l.line, p.series || p.number AS voucher, p.vdate, p.rn, p.account, CASE WHEN p.account < 2000 THEN p.amount ELSE -p.amount END AS amount
  FROM p JOIN lines l ON p.account BETWEEN l.lo AND l.hi WHERE l.line IN ('receivables', 'cash', 'current_liabilities')
 UNION ALL SELECT o.company_id, o.fy_start, o.fy_start, l.line, 'opening', o.fy_start, -1, o.account, CASE WHEN o.account < 2000 THEN o.amount ELSE -o.amount END FROM opn o JOIN lines l ON o.account BETWEEN l.lo AND l.hi
  WHERE l.line IN ('receivables', 'cash', 'current_liabilities')),
rk AS (SELECT c.company_id, c.month AS eom, e.line, e.voucher, e.account, e.amount, row_number() OVER (PARTITION BY c.company_id, c.month, e.line ORDER BY abs(e.amount) DESC, e.voucher, e.vdate, e.account, e.rn) AS rank
 FROM cov c JOIN ev e ON e.company_id = c.company_id AND e.fy = c.fy_start AND e.month <= c.month)""",
    ),
    "structure_r12": O.query(
        f"""SELECT i.company_id, CAST(s.pos AS INTEGER) AS pos, i.period, i.line AS part, r.role, i.amount AS value, {O.half_up('i.amount', 'n.amount')} AS share
 FROM inc i JOIN s12 s ON s.company_id = i.company_id AND s.period = i.period JOIN inc n ON n.company_id = i.company_id AND n.period = i.period AND n.line = 'net_sales'
 JOIN (VALUES ('numerator'), ('denominator')) r(role) ON r.role = 'numerator' OR i.line = 'net_sales' WHERE i.has_data AND i.line IN ({_OPS}) AND i.amount <> 0""",
        O.periods_cte("rolling"),
        _ANCH,
        _R12,
    ),
    "structure_steps": O.query(
        _explained(["operating_margin", "operating_result"], "company_id, period, compare, metric, component, role, effect"),
        O.periods_cte("rolling"),
        _ANCH,
        _SER12,
        """stp AS (SELECT c.company_id, c.period, p.period AS compare FROM s12 c JOIN s12 p ON p.company_id = c.company_id AND (p.pos = c.pos - 1 OR (p.pos = 1 AND c.pos = 12)))""",
        _PW.replace("FROM pair x", "FROM stp x"),
    ),
    "structure_accounts": O.query(
        """SELECT company_id, period, line, row, CAST(sum(amount) AS BIGINT) AS amount FROM (SELECT a.company_id, a.period, a.line, a.amount,
  CASE WHEN a.account BETWEEN 7000 AND 7699 OR a.account BETWEEN 2710 AND 2719 THEN 'masked' WHEN r.rk <= 3 THEN CAST(a.account AS VARCHAR) ELSE 'other' END AS row
 FROM am a LEFT JOIN (SELECT company_id, line, account, row_number() OVER (PARTITION BY company_id, line ORDER BY sum(abs(amount)) DESC, account) AS rk FROM am
  WHERE NOT account BETWEEN 7000 AND 7699 GROUP BY 1, 2, 3) r ON r.company_id = a.company_id AND r.line = a.line AND r.account = a.account) GROUP BY ALL""",
        _ANCH,
        """am AS (SELECT m.company_id, strftime(m.month, '%Y-%m') AS period, l.line, m.account, CAST(-m.amount AS BIGINT) AS amount FROM mm m JOIN anch a ON a.company_id = m.company_id AND m.month > a.month - INTERVAL 12 MONTH AND m.month <= a.month
 JOIN lines l ON m.account BETWEEN l.lo AND l.hi WHERE l.line IN ('net_sales', 'other_external', 'personnel'))""",
    ),
    "masked_ledger": O.query("""SELECT company_id, strftime(month, '%Y-%m') AS month, CASE WHEN account BETWEEN 7000 AND 7699 OR account BETWEEN 2710 AND 2719 THEN 'masked' ELSE CAST(account AS VARCHAR) END AS row,
 CAST(sum(amount) AS BIGINT) AS amount FROM mm GROUP BY ALL"""),
}
_PARTS = {
    **{m: [(c, n[2:] if n.startswith("c_") else n.replace("c_", ""), "component") for c, n, _b, _x, _y in comps] for m, comps in (
        ("net_sales", [_c("net_sales", "net_sales")]), ("operating_result", _ops), ("result_after_financial", _ops + _fin),
        ("gross_profit", [_c("net_sales", "net_sales"), _c("materials", "materials")]), ("ebitda", [c for c in _ops if c[0] != "depreciation"]),
        ("working_capital", [_c("inventory", "inventory"), _c("receivables", "receivables"), _c("short_investments", "short"), _c("cash", "cash"), _c("current_liabilities", "cl", "-")]),
        ("cash", [_c("cash", "cash")]), ("receivables", [_c("receivables", "rec")]), ("payables", [_c("payables", "pay")]),
    )},
    "operating_margin": [(c[0], c[0], "numerator") for c in _ops] + [("net_sales", "net_sales", "denominator")],
    "profit_margin": [(c[0], c[0], "numerator") for c in _ops + _fin] + [("net_sales", "net_sales", "denominator")],
    "gross_margin": [("net_sales", "net_sales", "numerator"), ("materials", "materials", "numerator"), ("net_sales", "net_sales", "denominator")],
    "personnel_share": [("personnel", "-personnel", "numerator"), ("net_sales", "net_sales", "denominator")],
    "external_cost_share": [("other_external", "-other_external", "numerator"), ("net_sales", "net_sales", "denominator")],
    "quick_ratio": [("current_assets_ex_inventory", "ca - inventory", "numerator"), ("current_liabilities", "cl", "denominator")],
    "current_ratio": [("current_assets", "ca", "numerator"), ("current_liabilities", "cl", "denominator")],
    "equity_ratio": [("total_equity", "te", "numerator"), ("untaxed_reserves", O.half_up("CAST(untaxed AS HUGEINT) * 794", "1000", 1), "numerator"), ("total_assets", "ta", "denominator")],
}
_BASES = {m: ("ta" if m in ("working_capital", "cash", "receivables", "payables", "equity_ratio") else "cl" if m in ("quick_ratio", "current_ratio") else "net_sales") for m in _PARTS}
SQL["metric_parts"] = O.query(
    f"SELECT company_id, period, metric, part, role, value, {O.half_up('value', 'base')} AS share FROM ("
    + " UNION ALL ".join(
        f"SELECT w1.company_id, w1.period, '{m}' AS metric, '{c}' AS part, '{role}' AS role, CAST({e} AS BIGINT) AS value, CAST({_BASES[m]} AS BIGINT) AS base FROM w1 JOIN per ON per.company_id = w1.company_id AND per.period = w1.period WHERE {'has' if _BASES[m] == 'net_sales' else 'bok'}"
        for m, parts in _PARTS.items()
        for c, e, role in parts
    )
    + ") WHERE value <> 0",
    O.periods_cte("rolling"),
    _PW,
)
