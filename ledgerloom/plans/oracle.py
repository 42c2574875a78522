"""Plain SQL of the same derived ledger, for checking the plans with another engine."""

from __future__ import annotations

import re

LEDGER = """
ord AS (
  SELECT CAST(c.c_nationkey AS VARCHAR) AS company_id, o.o_orderkey AS k, o.o_orderstatus AS st, c.c_name AS cname,
         CAST(round(o.o_totalprice * 100) AS BIGINT) AS net,
         CAST(CAST(o.o_orderdate AS DATE) + INTERVAL 27 YEAR AS DATE) AS d,
         (c.c_nationkey % 5 = 0 AND o.o_orderkey % 7 = 0) AS low
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
sal AS (
  SELECT *, (CASE WHEN k % 89 = 0 THEN net * 30 WHEN low THEN net * 12 ELSE net * 25 END) // 100 AS vat FROM ord),
sal2 AS (SELECT *, net + vat + CASE WHEN k % 211 = 0 THEN 100 ELSE 0 END AS gross FROM sal),
lin AS (
  SELECT row_number() OVER () AS lid, CAST(c.c_nationkey AS VARCHAR) AS company_id, l.l_orderkey AS ok, l.l_linenumber AS ln,
         l.l_partkey AS pk, l.l_suppkey AS sk, l.l_returnflag AS rf, p.p_type AS pt, p.p_brand AS brand, p.p_name AS pname,
         CAST(round(l.l_extendedprice * 100) AS BIGINT) AS net,
         CAST(CAST(l.l_shipdate AS DATE) + INTERVAL 27 YEAR AS DATE) AS d
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN part p ON l.l_partkey = p.p_partkey),
lin2 AS (
  SELECT *,
    CASE WHEN pt = 'STANDARD' AND pk % 100 = 3 THEN 'reserve' WHEN pt = 'STANDARD' THEN 'payroll'
         WHEN pt = 'ECONOMY' AND pk % 60 = 0 THEN 'inflow' WHEN pt = 'PROMO' AND pk % 40 = 0 THEN 'loan' ELSE 'invoice' END AS kind,
    CASE pt WHEN 'ECONOMY' THEN 4010 WHEN 'LARGE' THEN CASE WHEN sk % 10 = 0 THEN 6310 ELSE 5010 END
         WHEN 'MEDIUM' THEN CASE WHEN pk % 90 = 1 THEN 6993 ELSE 6110 END WHEN 'PROMO' THEN 6540
         WHEN 'SMALL' THEN CASE WHEN pk % 50 = 0 THEN 1220 ELSE 6550 END END AS acc,
    CASE WHEN pt = 'MEDIUM' AND pk % 70 = 0 THEN 2999 ELSE 2440 END AS credit,
    (CASE WHEN sk % 23 = 0 THEN net * 30 WHEN sk % 29 = 0 THEN net * 3 ELSE net * 25 END) // 100 AS vat,
    net * 30 // 100 AS tax,
    (CASE WHEN sk % 20 = 0 THEN net * 4000 ELSE net * 3142 END) // 10000 AS contr,
    (net // 1000000) * 1000000 + 1000000 AS round_amt,
    net * 3 - net * 3 // 50 AS out_amt,
    concat_ws('-', ok, ln, pk, sk, strftime(d, '%Y%m%d')) AS num,
    CASE WHEN pk % 11 = 0 THEN 'Diverse inköp' WHEN sk % 5 = 0 THEN 'Autogiro ' || pname
         ELSE 'Leverantörsfaktura ' || brand || ' AB nr ' || ok END AS party,
    CAST(d + CAST(pk % 50 AS INTEGER) AS DATE) AS reg
  FROM lin),
v AS (
  SELECT 's' || k AS vid, company_id, 'B' AS series, CAST(k AS VARCHAR) AS number, d AS vdate,
         CAST(d + CAST(k % 60 AS INTEGER) AS DATE) AS reg, 'Kundfaktura ' || cname AS text FROM sal2
  UNION ALL SELECT 'c' || k, company_id, 'C', CAST(k AS VARCHAR), CAST(d + 30 AS DATE), CAST(d + CAST(30 + k % 9 AS INTEGER) AS DATE),
         'Inbetalning ' || cname FROM sal2 WHERE st = 'F'
  UNION ALL SELECT 'l' || lid, company_id, CASE kind WHEN 'invoice' THEN 'D' WHEN 'payroll' THEN 'L' ELSE 'A' END, num, d, reg,
         CASE kind WHEN 'payroll' THEN 'Lön' WHEN 'reserve' THEN 'Avsättning periodiseringsfond' WHEN 'loan' THEN 'Lån delägare'
         WHEN 'inflow' THEN 'Insättning ägare' ELSE party END FROM lin2
  UNION ALL SELECT 'o' || lid, company_id, 'A', num, CAST(d + 2 AS DATE), CAST(reg + 2 AS DATE), 'Utbetalning ägare' FROM lin2 WHERE kind = 'inflow'
  UNION ALL SELECT 't' || lid, company_id, 'A', num || '-S', CAST(d + 5 AS DATE), CAST(reg + 5 AS DATE), 'Skattekonto inbetalning' FROM lin2 WHERE kind = 'payroll' AND sk % 4 = 0
  UNION ALL SELECT 'u' || lid, company_id, 'A', num || '-T', CAST(d + 12 AS DATE), CAST(reg + 12 AS DATE), 'Skattekonto dragning' FROM lin2 WHERE kind = 'payroll' AND sk % 4 = 1
  UNION ALL SELECT 'w' || lid, company_id, 'A', num || '-V', d, reg, 'Semesterlöneskuld' FROM lin2 WHERE kind = 'payroll' AND CAST(company_id AS INTEGER) % 4 = 1 AND month(d) NOT BETWEEN 6 AND 8
  UNION ALL SELECT 'r' || lid, company_id, 'A', num, CAST(d + 3 AS DATE), CAST(reg + 3 AS DATE), 'Rättelse ' || party
         FROM lin2 WHERE kind = 'invoice' AND rf = 'R' AND pk % 37 = 0
  UNION ALL SELECT 'k' || lid, company_id, 'D', num || '-K', CAST(d + CASE WHEN sk % 3 = 0 THEN 0 ELSE 5 END AS DATE), CAST(reg + CASE WHEN sk % 3 = 0 THEN 0 ELSE 5 END AS DATE),
         CASE WHEN sk % 2 = 0 THEN party ELSE party || ' (2)' END FROM lin2 WHERE kind = 'invoice' AND pk % 83 = 0 AND NOT (rf = 'R' AND pk % 37 = 0)),
r AS (
  SELECT 's' || k AS vid, 0 AS rn, 1510 AS account, gross AS amount, 'normal' AS status FROM sal2
  UNION ALL SELECT 's' || k, 1, 3001, -net, 'normal' FROM sal2
  UNION ALL SELECT 's' || k, 2, CASE WHEN low THEN 2621 ELSE 2611 END, -vat, 'normal' FROM sal2
  UNION ALL SELECT 's' || k, 3, 3001, 100, 'removed' FROM sal2 WHERE k % 13 = 0
  UNION ALL SELECT 'c' || k, 0, CASE WHEN k % 53 = 0 THEN 1910 ELSE 1930 END, gross, 'normal' FROM sal2 WHERE st = 'F'
  UNION ALL SELECT 'c' || k, 1, 1510, -gross, 'normal' FROM sal2 WHERE st = 'F'
  UNION ALL SELECT 'l' || lid, 0, acc, net, 'normal' FROM lin2 WHERE kind = 'invoice'
  UNION ALL SELECT 'l' || lid, 1, 2641, vat, 'normal' FROM lin2 WHERE kind = 'invoice'
  UNION ALL SELECT 'l' || lid, 2, credit, -(net + vat), 'normal' FROM lin2 WHERE kind = 'invoice'
  UNION ALL SELECT 'r' || lid, 0, acc, -net, 'normal' FROM lin2 WHERE kind = 'invoice' AND rf = 'R' AND pk % 37 = 0
  UNION ALL SELECT 'r' || lid, 1, 2641, -vat, 'normal' FROM lin2 WHERE kind = 'invoice' AND rf = 'R' AND pk % 37 = 0
  UNION ALL SELECT 'r' || lid, 2, credit, net + vat, 'normal' FROM lin2 WHERE kind = 'invoice' AND rf = 'R' AND pk % 37 = 0
  UNION ALL SELECT 'k' || lid, 0, acc, net, 'normal' FROM lin2 WHERE kind = 'invoice' AND pk % 83 = 0 AND NOT (rf = 'R' AND pk % 37 = 0)
  UNION ALL SELECT 'k' || lid, 1, 2641, vat, 'normal' FROM lin2 WHERE kind = 'invoice' AND pk % 83 = 0 AND NOT (rf = 'R' AND pk % 37 = 0)
  UNION ALL SELECT 'k' || lid, 2, credit, -(net + vat), 'normal' FROM lin2 WHERE kind = 'invoice' AND pk % 83 = 0 AND NOT (rf = 'R' AND pk % 37 = 0)
  UNION ALL SELECT 'l' || lid, 0, 7210, net, 'normal' FROM lin2 WHERE kind = 'payroll'
  UNION ALL SELECT 'l' || lid, 1, 2710, -tax, 'normal' FROM lin2 WHERE kind = 'payroll'
  UNION ALL SELECT 'l' || lid, 2, 1930, -(net - tax), 'normal' FROM lin2 WHERE kind = 'payroll'
  UNION ALL SELECT 'l' || lid, 3, 7510, contr, 'normal' FROM lin2 WHERE kind = 'payroll'
  UNION ALL SELECT 'l' || lid, 4, 2731, -contr, 'normal' FROM lin2 WHERE kind = 'payroll'
  UNION ALL SELECT 't' || lid, 0, 1630, round_amt, 'normal' FROM lin2 WHERE kind = 'payroll' AND sk % 4 = 0
  UNION ALL SELECT 't' || lid, 1, 1930, -round_amt, 'normal' FROM lin2 WHERE kind = 'payroll' AND sk % 4 = 0
  UNION ALL SELECT 'u' || lid, 0, 2710, round_amt, 'normal' FROM lin2 WHERE kind = 'payroll' AND sk % 4 = 1
  UNION ALL SELECT 'u' || lid, 1, 1630, -round_amt, 'normal' FROM lin2 WHERE kind = 'payroll' AND sk % 4 = 1
  UNION ALL SELECT 'w' || lid, 0, 7290, net * 12 // 100, 'normal' FROM lin2 WHERE kind = 'payroll' AND CAST(company_id AS INTEGER) % 4 = 1 AND month(d) NOT BETWEEN 6 AND 8
  UNION ALL SELECT 'w' || lid, 1, 2920, -(net * 12 // 100), 'normal' FROM lin2 WHERE kind = 'payroll' AND CAST(company_id AS INTEGER) % 4 = 1 AND month(d) NOT BETWEEN 6 AND 8
  UNION ALL SELECT 'l' || lid, 0, 8811, net, 'normal' FROM lin2 WHERE kind = 'reserve'
  UNION ALL SELECT 'l' || lid, 1, 2120, -net, 'normal' FROM lin2 WHERE kind = 'reserve'
  UNION ALL SELECT 'l' || lid, 0, 1685, round_amt, 'normal' FROM lin2 WHERE kind = 'loan'
  UNION ALL SELECT 'l' || lid, 1, 1930, -round_amt, 'normal' FROM lin2 WHERE kind = 'loan'
  UNION ALL SELECT 'l' || lid, 0, 1930, net * 3, 'normal' FROM lin2 WHERE kind = 'inflow'
  UNION ALL SELECT 'l' || lid, 1, 2893, -net * 3, 'normal' FROM lin2 WHERE kind = 'inflow'
  UNION ALL SELECT 'o' || lid, 0, 2393, out_amt, 'normal' FROM lin2 WHERE kind = 'inflow'
  UNION ALL SELECT 'o' || lid, 1, 1930, -out_amt, 'normal' FROM lin2 WHERE kind = 'inflow'),
p AS (SELECT v.*, r.rn, r.account, CAST(r.amount AS BIGINT) AS amount, CAST(date_trunc('month', v.vdate) AS DATE) AS month,
        CAST(date_trunc('year', v.vdate) AS DATE) AS fy
      FROM v JOIN r USING (vid) WHERE r.status <> 'removed'),
mm AS (SELECT company_id, month, account, CAST(sum(amount) AS BIGINT) AS amount FROM p GROUP BY ALL HAVING sum(amount) <> 0),
span AS (SELECT company_id, min(month) AS lo, max(month) AS hi FROM mm GROUP BY 1),
fy AS (
  SELECT company_id, lo, hi, CAST(y AS DATE) AS fy_start, CAST(CAST(y AS DATE) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) AS fy_end
  FROM (SELECT *, unnest(generate_series(date_trunc('year', lo), date_trunc('year', hi), INTERVAL 1 YEAR)) AS y FROM span)),
cov AS (
  SELECT company_id, fy_start, fy_end, CAST(m AS DATE) AS month,
         (CAST(m AS DATE) <= hi AND NOT (CAST(company_id AS INTEGER) % 7 = 3 AND CAST(m AS DATE) = DATE '2024-05-01')) AS covered
  FROM (SELECT *, unnest(generate_series(CAST(fy_start AS TIMESTAMP), CAST(fy_end AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM fy)),
openfy AS (
  SELECT company_id, fy_start, fy_end,
         CASE WHEN CAST(company_id AS INTEGER) % 6 = 1 AND fy_start >= DATE '2025-01-01' THEN greatest(DATE '2025-01-01', date_trunc('year', lo))
              ELSE date_trunc('year', lo) END AS anchor,
         date_trunc('year', lo) AS first_fy,
         NOT (CAST(company_id AS INTEGER) % 7 = 3 AND fy_start >= DATE '2025-01-01' AND date_trunc('year', lo) < DATE '2025-01-01') AS known
  FROM fy),
ib0(account, amount) AS (VALUES (1930, 10000000), (2081, -5000000), (2091, -5000000)),
opn AS (
  SELECT company_id, fy_start, account, CAST(sum(amount) AS BIGINT) AS amount FROM (
    SELECT f.company_id, f.fy_start, i.account, i.amount FROM openfy f, ib0 i WHERE f.known
    UNION ALL SELECT f.company_id, f.fy_start, 1510, 50000 FROM openfy f WHERE f.known AND f.anchor = DATE '2025-01-01' AND f.first_fy < f.anchor
    UNION ALL SELECT f.company_id, f.fy_start, CASE WHEN m.account < 3000 THEN m.account ELSE 2099 END, m.amount
      FROM openfy f JOIN mm m ON m.company_id = f.company_id AND m.month < f.fy_start WHERE f.known)
  GROUP BY ALL HAVING sum(amount) <> 0),
bal AS (
  SELECT company_id, fy_start, month, account, CAST(sum(amount) AS BIGINT) AS balance FROM (
    SELECT c.company_id, c.fy_start, c.month, o.account, o.amount FROM cov c JOIN opn o USING (company_id, fy_start)
    UNION ALL SELECT c.company_id, c.fy_start, c.month, m.account, m.amount FROM cov c JOIN mm m
      ON m.company_id = c.company_id AND m.month >= c.fy_start AND m.month <= c.month AND m.account < 3000)
  GROUP BY ALL HAVING sum(amount) <> 0),
cmpl AS (
  SELECT c.company_id, c.month, bool_and(d.covered) AND any_value(f.known) AS complete
  FROM cov c JOIN cov d ON d.company_id = c.company_id AND d.fy_start = c.fy_start AND d.month <= c.month
  JOIN openfy f ON f.company_id = c.company_id AND f.fy_start = c.fy_start GROUP BY ALL),
lines AS (
  SELECT * FROM (VALUES ('net_sales',3000,3799),('inventory_change',4940,4999),('capitalized_work',3800,3899),('other_operating_income',3900,3999),
   ('materials',4000,4939),('other_external',5000,6999),('personnel',7000,7699),('depreciation',7700,7899),('other_operating_expenses',7900,7999),
   ('financial_assets_result',8000,8299),('interest_income',8300,8399),('interest_expense',8400,8799),('appropriations',8800,8899),('tax',8900,8989),
   ('intangible',1000,1099),('tangible',1100,1299),('financial_fixed',1300,1399),('inventory',1400,1499),('receivables',1500,1799),
   ('short_investments',1800,1899),('cash',1900,1999),('equity',2000,2099),('untaxed_reserves',2100,2199),('provisions',2200,2299),
   ('long_term_liabilities',2300,2399),('current_liabilities',2400,2999)) t(line, lo, hi)),
tree AS (
  SELECT line AS code, line AS leaf FROM lines
  UNION ALL SELECT 'operating_income', unnest(['net_sales','inventory_change','capitalized_work','other_operating_income'])
  UNION ALL SELECT 'operating_result', line FROM lines WHERE lo BETWEEN 3000 AND 7999
  UNION ALL SELECT 'result_after_financial', line FROM lines WHERE lo BETWEEN 3000 AND 8499
  UNION ALL SELECT 'result_before_tax', line FROM lines WHERE lo BETWEEN 3000 AND 8899
  UNION ALL SELECT 'net_result', line FROM lines WHERE lo >= 3000
  UNION ALL SELECT 'fixed_assets', line FROM lines WHERE lo < 1400
  UNION ALL SELECT 'current_assets', line FROM lines WHERE lo BETWEEN 1400 AND 1999
  UNION ALL SELECT 'total_assets', line FROM lines WHERE lo < 2000
  UNION ALL SELECT 'total_equity', unnest(['equity', 'current_result'])
  UNION ALL SELECT 'total_equity_liabilities', line FROM lines WHERE lo BETWEEN 2000 AND 2999
  UNION ALL SELECT 'total_equity_liabilities', 'current_result'
  UNION ALL SELECT 'current_result', 'current_result'),
mline AS (SELECT company_id, month, line, CAST(-sum(amount) AS BIGINT) AS amount FROM mm JOIN lines ON account BETWEEN lo AND hi
          WHERE account BETWEEN 3000 AND 8989 GROUP BY ALL),
inc_codes AS (SELECT DISTINCT code FROM tree WHERE leaf IN (SELECT line FROM lines WHERE lo >= 3000)),
bal_leaf AS (
  SELECT company_id, month, line AS leaf, CAST(sum(CASE WHEN account < 2000 THEN balance ELSE -balance END) AS BIGINT) AS amount
  FROM bal JOIN lines ON account BETWEEN lo AND hi GROUP BY ALL
  UNION ALL SELECT c.company_id, c.month, 'current_result', CAST(-sum(m.amount) AS BIGINT) FROM cov c JOIN mm m
    ON m.company_id = c.company_id AND m.month >= c.fy_start AND m.month <= c.month AND m.account BETWEEN 3000 AND 8999 GROUP BY ALL),
bs AS (SELECT c.company_id, c.month, t.code AS line, CAST(coalesce(sum(b.amount), 0) AS BIGINT) AS amount
       FROM cov c CROSS JOIN (SELECT DISTINCT code, leaf FROM tree WHERE leaf IN (SELECT line FROM lines WHERE lo < 3000) OR leaf = 'current_result') t
       LEFT JOIN bal_leaf b ON b.company_id = c.company_id AND b.month = c.month AND b.leaf = t.leaf GROUP BY ALL)
"""

_KINDS = {
    "month": "SELECT company_id, 'month' AS kind, strftime(month, '%Y-%m') AS period, month AS s, month AS e FROM cov",
    "quarter": "SELECT company_id, 'quarter', strftime(month, '%Y') || '-Q' || quarter(month), CAST(month - INTERVAL 2 MONTH AS DATE), month "
    "FROM cov WHERE month(month) % 3 = 0",
    "ytd": "SELECT company_id, 'ytd', 'YTD:' || strftime(month, '%Y-%m'), fy_start, month FROM cov",
    "fy": "SELECT company_id, 'fy', 'FY:' || strftime(fy_start, '%Y-%m'), fy_start, month FROM cov WHERE month(month) = 12",
    "rolling": "SELECT company_id, 'rolling', 'R12:' || strftime(month, '%Y-%m'), CAST(month - INTERVAL 11 MONTH AS DATE), month FROM cov",
}


def periods_cte(*kinds: str, back: int = 12) -> str:
    """Periods with first and last month, and the same one ``back`` months earlier (``cper``)."""
    union = " UNION ALL ".join(_KINDS[k] for k in kinds)
    spec = (
        "CASE kind WHEN 'month' THEN strftime(ce, '%Y-%m') WHEN 'quarter' THEN strftime(ce, '%Y') || '-Q' || quarter(ce) "
        "WHEN 'ytd' THEN 'YTD:' || strftime(ce, '%Y-%m') WHEN 'fy' THEN 'FY:' || strftime(cs, '%Y-%m') "
        "ELSE 'R12:' || strftime(ce, '%Y-%m') END"
    )
    return f"""per AS (SELECT * FROM (SELECT '' AS company_id, '' AS kind, '' AS period, DATE '2000-01-01' AS s, DATE '2000-01-01' AS e WHERE false) UNION ALL {union}),
pair AS (SELECT *, {spec} AS compare FROM (SELECT *, CAST(s - INTERVAL {back} MONTH AS DATE) AS cs, CAST(e - INTERVAL {back} MONTH AS DATE) AS ce FROM per)),
allper AS (SELECT company_id, kind, period, s, e FROM per UNION SELECT company_id, kind, compare, cs, ce FROM pair),
pm AS (SELECT company_id, kind, period, s, e, CAST(m AS DATE) AS month
       FROM (SELECT *, unnest(generate_series(CAST(s AS TIMESTAMP), CAST(e AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM allper)),
pcov AS (SELECT pm.company_id, pm.kind, pm.period, bool_and(coalesce(c.covered, false)) AS has_data,
         coalesce(string_agg(CASE WHEN NOT coalesce(c.covered, false) THEN strftime(pm.month, '%Y-%m') END, ',' ORDER BY pm.month), '') AS missing
         FROM pm LEFT JOIN cov c ON c.company_id = pm.company_id AND c.month = pm.month GROUP BY ALL),
pleaf AS (SELECT pm.company_id, pm.kind, pm.period, l.line AS leaf, CAST(sum(l.amount) AS BIGINT) AS amount
          FROM pm JOIN mline l ON l.company_id = pm.company_id AND l.month = pm.month GROUP BY ALL),
inc AS (SELECT c.company_id, c.kind, c.period, c.has_data, t.code AS line, CAST(coalesce(sum(l.amount), 0) AS BIGINT) AS amount
        FROM pcov c CROSS JOIN (SELECT DISTINCT code, leaf FROM tree WHERE code IN (SELECT code FROM inc_codes)) t
        LEFT JOIN pleaf l ON l.company_id = c.company_id AND l.period = c.period AND l.leaf = t.leaf GROUP BY ALL)"""


def half_up(num: str, den: str, scale: int = 1000) -> str:
    n, d = f"CAST({num} AS HUGEINT)", f"CAST({den} AS HUGEINT)"
    return (
        f"CASE WHEN ({den}) = 0 THEN NULL ELSE CAST(sign({n}) * sign({d}) * (({2 * scale} * abs({n}) + abs({d})) // (2 * abs({d}))) AS BIGINT) END"
    )


def half_even(num: str, den: str, scale: int = 1000) -> str:
    t, d = f"({scale} * abs(CAST({num} AS HUGEINT)))", f"abs(CAST({den} AS HUGEINT))"
    return (
        f"CASE WHEN ({den}) = 0 THEN NULL ELSE CAST(sign({num}) * sign({den}) * ({t} // {d} + CASE WHEN 2 * ({t} % {d}) > {d} "
        f"OR (2 * ({t} % {d}) = {d} AND ({t} // {d}) % 2 = 1) THEN 1 ELSE 0 END) AS BIGINT) END"
    )


def pct_change(cur: str, prev: str) -> str:
    return half_up(f"(({cur}) - ({prev}))", f"abs({prev})")


_CTE = re.compile(r"(\b\w+(?:\([\w, ]+\))?) AS \(\s*(?=SELECT|VALUES)")


def query(body: str, *ctes: str) -> str:
    """A complete statement: the derived ledger, further CTEs, and the final select.

    Every CTE is materialised, so that the cost does not depend on how often one is used.
    """
    return _CTE.sub(r"\1 AS MATERIALIZED (", "WITH RECURSIVE " + ",\n".join([LEDGER.strip(), *ctes])) + "\n" + body


def inner(statement: str, *given: str) -> str:
    """A statement of ``query`` as a subquery of another one that has the ledger and the CTEs ``given``."""
    for shared in (query("", *given), query("")):
        if statement.startswith(shared[:-1]):
            rest = statement[len(shared) - 1 :]
            return "WITH RECURSIVE " + rest[2:] if rest.startswith(",") else rest.lstrip()
    return statement
