"""Registered queries: counterparties, spend report, level shifts, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.counterparty import _ACCENTED, _PLAIN, GENERIC, SUFFIXES, counterparty, prefix_pattern
from ledgerloom.operators import spend as E
from ledgerloom.plans import oracle as O
from ledgerloom.plans.book import Book


def _pairs(book: Book) -> DataFrame:
    return book.year_pairs("quarter")


def _join(col: str) -> object:
    return F.array_join(F.transform(col, lambda a: a.cast("string")), ",").alias(col)


def counterparty_texts(book: Book) -> DataFrame:
    """Counterparty guess per distinct text key, with confidence in hundredths and source."""
    texts = book.text_spend.groupBy("company_id", "r_full", "v_full").agg(
        F.sum("amount").alias("amount"), F.sum("n_rows").alias("n_rows"), F.min("r_label").alias("r_label"), F.min("v_label").alias("v_label")
    )
    return counterparty(texts, book.aliases).select("company_id", F.col("v_full").alias("text_key"), "cp_key", "cp_confidence", "cp_source", "amount", "n_rows")


def counterparty_spend(book: Book) -> DataFrame:
    return book.spend.select("company_id", "cp_key", F.date_format("month", "yyyy-MM").alias("month"), "amount", _join("accounts"))


def spend_report(book: Book) -> DataFrame:
    rows = book.quarter_spend
    return E.spend_listing(rows, "largest").select(
        "company_id", "period", "cp_key", "name", "confidence", "amount", "compare_amount", "diff", "share", "recurrence", "annualized", _join("accounts"),
        F.array_join("categories", ",").alias("categories"), "rank",
    )


def spend_new(book: Book) -> DataFrame:
    rows = book.quarter_spend
    return E.spend_listing(rows, "new").select("company_id", "period", "cp_key", "amount", F.date_format("first_month", "yyyy-MM").alias("first_month"), "rank")


def spend_disappeared(book: Book) -> DataFrame:
    rows = book.quarter_spend
    return E.spend_listing(rows, "disappeared").select("company_id", "period", "cp_key", "compare_amount", "rank")


def concentration(book: Book) -> DataFrame:
    return E.concentration(book.quarter_spend).drop("compare")


def recurrence(book: Book) -> DataFrame:
    rows = book.quarter_spend
    return rows.groupBy("company_id", "period", "recurrence").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


def level_shift(book: Book) -> DataFrame:
    return E.report_shifts(E.level_shifts(_pairs(book), book.spend, book.coverage)).select(
        "company_id", "period", "cp_key", F.date_format("shift_month", "yyyy-MM").alias("shift_month"), "before", "after", "change_pct"
    )


def _full_history(book: Book, pairs: DataFrame, n: int) -> DataFrame:
    months = pairs.select("company_id", "period", F.explode(F.expr(f"sequence(add_months(trunc(end, 'MM'), -{n - 1}), trunc(end, 'MM'), interval 1 month)")).alias("month"))
    have = book.coverage.where("source = 'vouchers'").select("company_id", "month")
    return months.join(have, ["company_id", "month"]).groupBy("company_id", "period").agg(F.count("*").alias("n")).where(F.col("n") == n).select("company_id", "period")


def recurring_changes(book: Book) -> DataFrame:
    pairs = book.month_pairs()
    rows = book.month_spend
    return E.recurring_changes(rows, _full_history(book, pairs, 12)).select("company_id", "period", "compare", "cp_key", "kind", "effect", "recurrence", _join("accounts"))


def frequency_changes(book: Book) -> DataFrame:
    pairs = book.month_pairs()
    rows = book.month_spend
    changes = E.recurring_changes(rows, _full_history(book, pairs, 12))
    return E.frequency_changes(changes, pairs, E.counterparty_vouchers(book.vouchers, book.aliases))


def _recent_shifts(book: Book) -> DataFrame:
    pairs = book.month_pairs()
    full = _full_history(book, pairs, 24)
    confirmed = book.spend.where("seen.cp_confidence >= 98")
    s = E.level_shifts(pairs.join(full, ["company_id", "period"], "left_semi"), confirmed, book.coverage, min_active=1)
    return s.where("shift_month >= add_months(trunc(end, 'MM'), -5) AND abs(after - before) >= 100000")


def recent_level_shifts(book: Book) -> DataFrame:
    """Confirmed counterparties with a break in the last six of 24 full months, at least 1 000 kr."""
    return _recent_shifts(book).select("company_id", "period", "cp_key", F.date_format("shift_month", "yyyy-MM").alias("shift_month"), "before", "after")


def level_shift_references(book: Book) -> DataFrame:
    """The vouchers that a recent level shift refers to."""
    shifts = book.stage(_recent_shifts(book).select("company_id", "period", "cp_key", "shift_month"), "recent_shifts")
    return E.shift_references(shifts, book.vouchers, book.aliases).withColumn("voucher_date", F.col("voucher_date").cast("string"))


def exact_duplicates(book: Book) -> DataFrame:
    return E.exact_copies(book.vouchers).select(
        "company_id", F.col("voucher_date").cast("string").alias("voucher_date"), "accounts", "cost", "n", "first_voucher", "last_voucher"
    )


QUERIES = {
    f.__name__: f
    for f in (
        counterparty_texts, counterparty_spend, spend_report, spend_new, spend_disappeared, concentration, recurrence, level_shift,
        recurring_changes, frequency_changes, recent_level_shifts, level_shift_references, exact_duplicates,
    )
}

_PFX = "(?i)" + prefix_pattern()
_NOISE = r"\b(\d{3,}|\d{4}-\d{2}(-\d{2})?|nr|no|fakt|inv|ocr|ref|avg|period|\d{1,2}/\d{1,2})\b"
_SUF = ", ".join(f"'{x}'" for x in SUFFIXES)
_GEN = ", ".join(f"'{x}'" for x in GENERIC)


def _words(x: str) -> str:
    folded = f"translate(lower({x}), '{_ACCENTED}', '{_PLAIN}')"
    return f"[w for w in string_split_regex(trim(regexp_replace({folded}, '[^a-z0-9 ]+', ' ', 'g')), ' +') if w <> '' AND w NOT IN ({_SUF})]"


SP = f"""tx0 AS (SELECT DISTINCT text FROM p WHERE account BETWEEN 4000 AND 6999),
tx1 AS (SELECT text, CASE WHEN regexp_matches(trim(text), '{_PFX}') THEN regexp_replace(regexp_replace(trim(text), '{_PFX}', ''), '^[ :\\-]+|[ :\\-]+$', '', 'g') ELSE trim(text) END AS t FROM tx0),
tx2 AS (SELECT text, regexp_replace(regexp_replace(regexp_replace(t, '{_NOISE}', ' ', 'g'), '\\s+', ' ', 'g'), '^[ \\-:,.]+|[ \\-:,.]+$', '', 'g') AS c FROM tx1),
tx3 AS (SELECT text, c, {_words('c')} AS ws FROM tx2),
tx4 AS (SELECT text, c, ws, array_to_string(ws, ' ') AS fullkey, array_to_string(ws[1:2], ' ') AS two,
  array_to_string(([x for x in string_split(c, ' ') if len({_words('x')}) > 0])[1:3], ' ') AS label FROM tx3),
al AS (SELECT DISTINCT 'brand ' || regexp_extract(p_brand, '(\\d+)', 1) AS key, 'Märke ' || regexp_extract(p_brand, '(\\d+)', 1) AS canon FROM part WHERE CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) % 4 = 0),
tx AS (SELECT t.*, coalesce(a.canon, b.canon) AS canon,
  CASE WHEN coalesce(a.canon, b.canon) IS NOT NULL THEN array_to_string({_words('coalesce(a.canon, b.canon)')}, ' ') WHEN fullkey = '' OR ws[1] IN ({_GEN}) THEN 'okänd motpart' ELSE two END AS cp_key,
  CASE WHEN coalesce(a.canon, b.canon) IS NOT NULL THEN coalesce(a.canon, b.canon) WHEN fullkey = '' OR ws[1] IN ({_GEN}) THEN 'Okänd motpart' ELSE label END AS cp_name,
  CASE WHEN coalesce(a.canon, b.canon) IS NOT NULL THEN 98 WHEN fullkey = '' THEN 0 WHEN ws[1] IN ({_GEN}) THEN 10 WHEN len(ws) <= 3 THEN 75 ELSE 55 END AS conf
 FROM tx4 t LEFT JOIN al a ON a.key = t.fullkey LEFT JOIN al b ON b.key = t.two),
sp AS (SELECT p.*, tx.fullkey, tx.cp_key, tx.cp_name, tx.conf FROM p JOIN tx USING (text) WHERE account BETWEEN 4000 AND 6999),
sm AS (SELECT company_id, cp_key, month, CAST(sum(amount) AS BIGINT) AS amount, list_distinct(list(account)) AS accs,
  first(cp_name ORDER BY vdate, series, number, rn) AS cp_name, first(conf ORDER BY vdate, series, number, rn) AS conf, min(vdate) AS fd FROM sp GROUP BY 1, 2, 3)"""

ROWS = f"""win AS (SELECT x.company_id, x.period, x.compare, x.s, x.e, x.cs, x.ce, m.cp_key, m.month, m.amount, m.accs, m.cp_name, m.conf,
  12 - (date_diff('month', m.month, x.e)) AS pos FROM pair x JOIN cov c ON c.company_id = x.company_id AND c.month BETWEEN x.e - INTERVAL 23 MONTH AND x.e
  JOIN sm m ON m.company_id = x.company_id AND m.month = c.month),
n12 AS (SELECT x.company_id, x.period, count(*) AS n12 FROM pair x JOIN cov c ON c.company_id = x.company_id AND c.month BETWEEN x.e - INTERVAL 11 MONTH AND x.e GROUP BY ALL),
rw0 AS (SELECT company_id, period, compare, cp_key, CAST(sum(CASE WHEN month BETWEEN s AND e THEN amount ELSE 0 END) AS BIGINT) AS amount,
  CAST(sum(CASE WHEN month BETWEEN cs AND ce THEN amount ELSE 0 END) AS BIGINT) AS compare_amount,
  coalesce(list_sort(list(pos) FILTER (pos >= 1 AND amount > 0)), []) AS act, coalesce(sum(amount) FILTER (pos >= 10 AND amount > 0), 0) AS rs, count(*) FILTER (pos >= 10 AND amount > 0) AS rn,
  min(month) FILTER (amount > 0) AS first_month, list_sort(list_distinct(flatten(list(accs)))) AS accs, first(cp_name ORDER BY month) AS name, first(conf ORDER BY month) AS conf
 FROM win GROUP BY 1, 2, 3, 4),
rw1 AS (SELECT r.*, n12, [act[i + 1] - act[i] for i in range(1, len(act))] AS gaps, coalesce(sum(CASE WHEN r.amount > 0 THEN r.amount END) OVER (PARTITION BY r.company_id, r.period), 0) AS gross
 FROM rw0 r JOIN n12 n ON n.company_id = r.company_id AND n.period = r.period),
rw AS (SELECT *, CASE WHEN len(act) = 0 THEN 'unknown' WHEN len(act) = 1 THEN CASE WHEN n12 >= 6 THEN 'one_off' ELSE 'unknown' END
  WHEN len(act) >= greatest(3, n12 * 3 // 4) AND len([g for g in gaps[-6:] if g <> 1]) = 0 THEN 'monthly'
  WHEN len(gaps) >= 2 AND len([g for g in gaps if g <> 3]) = 0 THEN 'quarterly' WHEN len([g for g in gaps if g <> 12]) = 0 THEN 'annual' ELSE 'irregular' END AS rec FROM rw1)"""

_SHARE = f"CASE WHEN amount > 0 AND gross <> 0 THEN {O.half_even('amount', 'gross')} END"
_CATSQL = """(SELECT coalesce(string_agg(DISTINCT category, ',' ORDER BY category), '') FROM cats WHERE EXISTS (SELECT 1 FROM (SELECT unnest(accs) AS a) q WHERE q.a BETWEEN cats.lo AND cats.hi))"""


def shifts_sql(min_active: int, confirmed: bool = False) -> str:
    src = "sm m ON m.company_id = x.company_id AND m.month = c.month" + (" AND m.conf >= 98" if confirmed else "")
    return f"""kk AS (SELECT x.company_id, x.period, x.compare, x.s, x.e, m.cp_key FROM {{pairs}} x JOIN cov c ON c.company_id = x.company_id AND c.month BETWEEN x.e - INTERVAL 23 MONTH AND x.e JOIN {src}
 GROUP BY ALL HAVING count(*) FILTER (m.amount > 0) >= {min_active}),
sr AS (SELECT k.*, c.month, CAST(coalesce(m.amount, 0) AS HUGEINT) AS x FROM kk k JOIN cov c ON c.company_id = k.company_id AND c.month BETWEEN k.e - INTERVAL 23 MONTH AND k.e
 LEFT JOIN sm m ON m.company_id = k.company_id AND m.cp_key = k.cp_key AND m.month = c.month {'AND m.conf >= 98' if confirmed else ''}),
pf AS (SELECT *, count(*) OVER b AS k, count(*) OVER a AS n, CAST(coalesce(sum(x) OVER b, 0) AS HUGEINT) AS sa, CAST(coalesce(sum(x * x) OVER b, 0) AS HUGEINT) AS qa, CAST(sum(x) OVER a AS HUGEINT) AS st, CAST(sum(x * x) OVER a AS HUGEINT) AS qt
 FROM sr WINDOW a AS (PARTITION BY company_id, period, cp_key), b AS (PARTITION BY company_id, period, cp_key ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p2 AS (SELECT *, st - sa AS sb, qt - qa AS qb, n - k AS m FROM pf WHERE k >= 3 AND n - k >= 3 AND sa > 0),
p3 AS (SELECT *, abs(CAST(sb AS DOUBLE) / CAST(m AS DOUBLE) - CAST(sa AS DOUBLE) / CAST(k AS DOUBLE)) AS delta,
  (sqrt(CAST(k * qa - sa * sa AS DOUBLE)) / CAST(k AS DOUBLE) + sqrt(CAST(m * qb - sb * sb AS DOUBLE)) / CAST(m AS DOUBLE)) / 2 AS noise FROM p2 WHERE abs(sb * k - sa * m) * 5 >= sa * m),
p4 AS (SELECT *, delta / CASE WHEN noise = 0 THEN CAST(1e-7 AS DOUBLE) ELSE noise END AS stat FROM p3),
ls0 AS (SELECT *, row_number() OVER (PARTITION BY company_id, period, cp_key ORDER BY stat DESC, k) AS rk FROM p4 WHERE stat >= 3),
ls AS (SELECT *, {O.half_up('sa', 'k', 1)} AS before, {O.half_up('sb', 'm', 1)} AS after FROM ls0 WHERE rk = 1)"""


from ledgerloom.plans.statement_plans import _CATS  # noqa: E402

_FULL = "fp AS (SELECT x.* FROM pair x WHERE (SELECT count(*) FROM cov c WHERE c.company_id = x.company_id AND c.covered AND c.month BETWEEN x.e - INTERVAL 23 MONTH AND x.e) = 24)"
_Q = O.periods_cte("quarter")
_M = O.periods_cte("month", back=1)
_RC = f"""fh AS (SELECT x.company_id, x.period FROM pair x JOIN cov c ON c.company_id = x.company_id AND c.covered AND c.month BETWEEN x.e - INTERVAL 11 MONTH AND x.e GROUP BY 1, 2 HAVING count(*) = 12),
rc AS (SELECT r.company_id, r.period, r.compare, cp_key, CASE WHEN gone THEN 'gone' WHEN compare_amount = 0 THEN 'new' ELSE 'changed' END AS kind,
  CASE WHEN gone THEN -compare_amount WHEN compare_amount <> 0 THEN amount - compare_amount ELSE amount END AS effect, rec, accs
 FROM (SELECT *, amount < 100000 AND compare_amount >= 100000 AS gone FROM rw) r JOIN fh USING (company_id, period)
 WHERE conf >= 98 AND rec IN ('monthly', 'quarterly', 'annual') AND (gone OR (amount >= 100000 AND NOT (compare_amount <> 0 AND (abs(amount - compare_amount) < 100000 OR abs(amount - compare_amount) * 5 < abs(compare_amount))))))"""

SQL = {
    "counterparty_texts": O.query(
        "SELECT company_id, fullkey AS text_key, cp_key, conf AS cp_confidence, CASE WHEN conf = 98 THEN 'alias' WHEN conf <= 10 THEN 'none' ELSE 'heuristic' END AS cp_source, "
        "CAST(sum(amount) AS BIGINT) AS amount, count(*) AS n_rows FROM sp GROUP BY ALL",
        SP,
    ),
    "counterparty_spend": O.query("SELECT company_id, cp_key, strftime(month, '%Y-%m') AS month, amount, array_to_string(list_sort(accs), ',') AS accounts FROM sm", SP),
    "spend_report": O.query(
        f"""SELECT company_id, period, cp_key, name, conf AS confidence, amount, compare_amount, amount - compare_amount AS diff, {_SHARE} AS share, rec AS recurrence,
 CASE WHEN rec = 'monthly' AND rn > 0 THEN {O.half_up('rs * 12', 'rn', 1)} END AS annualized, array_to_string(accs, ',') AS accounts, {_CATSQL} AS categories, CAST(rank AS INTEGER) AS rank
 FROM (SELECT *, row_number() OVER (PARTITION BY company_id, period ORDER BY amount DESC, cp_key) AS rank FROM rw WHERE amount <> 0 OR compare_amount <> 0) WHERE rank <= 25""",
        _Q, SP, ROWS, _CATS,
    ),
    "spend_new": O.query(
        """SELECT company_id, period, cp_key, amount, strftime(first_month, '%Y-%m') AS first_month, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY company_id, period ORDER BY amount DESC, cp_key) AS rank
 FROM rw WHERE amount >= 100000 AND compare_amount = 0 AND cp_key <> 'okänd motpart') WHERE rank <= 25""",
        _Q, SP, ROWS,
    ),
    "spend_disappeared": O.query(
        """SELECT company_id, period, cp_key, compare_amount, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY company_id, period ORDER BY compare_amount DESC, cp_key) AS rank
 FROM rw WHERE compare_amount >= 100000 AND amount = 0 AND cp_key <> 'okänd motpart') WHERE rank <= 25""",
        _Q, SP, ROWS,
    ),
    "concentration": O.query(
        f"""SELECT company_id, period, CAST(total AS BIGINT) AS total, CAST(ct AS BIGINT) AS compare_total, coalesce({O.half_even('s1', 'gross')}, 0) AS top1, coalesce({O.half_even('s5', 'gross')}, 0) AS top5,
 coalesce({O.half_even('s10', 'gross')}, 0) AS top10, {O.half_even('reg', 'gross')} AS recurring_share FROM (SELECT company_id, period, sum(amount) AS total, sum(compare_amount) AS ct, max(gross) AS gross,
  coalesce(sum(amount) FILTER (rk <= 1 AND amount > 0), 0) AS s1, coalesce(sum(amount) FILTER (rk <= 5 AND amount > 0), 0) AS s5, coalesce(sum(amount) FILTER (rk <= 10 AND amount > 0), 0) AS s10,
  coalesce(sum(amount) FILTER (rec IN ('monthly', 'quarterly', 'annual')), 0) AS reg FROM (SELECT *, row_number() OVER (PARTITION BY company_id, period ORDER BY amount DESC, cp_key) AS rk FROM rw) GROUP BY 1, 2)""",
        _Q, SP, ROWS,
    ),
    "recurrence": O.query("SELECT company_id, period, rec AS recurrence, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM rw GROUP BY 1, 2, 3", _Q, SP, ROWS),
    "level_shift": O.query(
        f"""SELECT company_id, period, cp_key, strftime(month, '%Y-%m') AS shift_month, before, after, CASE WHEN before <> 0 THEN {O.half_even('(after - before)', 'before')} ELSE 0 END AS change_pct
 FROM ls WHERE month >= s AND month <= last_day(e) + CAST(last_day(e) - s AS INTEGER)""",
        _Q, SP, shifts_sql(6).format(pairs="pair"),
    ),
    "recurring_changes": O.query("SELECT company_id, period, compare, cp_key, kind, effect, rec AS recurrence, array_to_string(accs, ',') AS accounts FROM rc", _M, SP, ROWS, _RC),
    "frequency_changes": O.query(
        """SELECT * FROM (SELECT r.company_id, r.period, r.compare, r.cp_key, coalesce(a.n, 0) AS n_now, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) - coalesce(b.n, 0) AS change FROM rc r
 LEFT JOIN nv a ON a.company_id = r.company_id AND a.cp_key = r.cp_key AND a.period = r.period LEFT JOIN nv b ON b.company_id = r.company_id AND b.cp_key = r.cp_key AND b.period = r.compare)
 WHERE abs(change) >= 2 AND (n_before = 0 OR abs(change) * 2 >= n_before)""",
        _M, SP, ROWS, _RC,
        "nv AS (SELECT company_id, cp_key, strftime(month, '%Y-%m') AS period, count(DISTINCT vid) AS n FROM sp GROUP BY 1, 2, 3)",
    ),
    "recent_level_shifts": O.query(
        """SELECT company_id, period, cp_key, strftime(month, '%Y-%m') AS shift_month, before, after FROM ls WHERE month >= e - INTERVAL 5 MONTH AND abs(after - before) >= 100000""",
        _M, SP,
        _FULL,
        shifts_sql(1, True).format(pairs="fp"),
    ),
    "level_shift_references": O.query(
        """SELECT company_id, period, cp_key, CAST(place AS INTEGER) AS place, voucher, strftime(vdate, '%Y-%m-%d') AS voucher_date FROM (
 SELECT l.company_id, l.period, l.cp_key, s.series || s.number AS voucher, s.vdate, row_number() OVER (PARTITION BY l.company_id, l.period, l.cp_key ORDER BY s.vdate, s.series, s.number) AS place
 FROM ls l JOIN (SELECT DISTINCT company_id, month, cp_key, vdate, series, number FROM sp WHERE conf = 98) s
  ON s.company_id = l.company_id AND s.cp_key = l.cp_key AND s.month BETWEEN l.month - INTERVAL 3 MONTH AND l.month + INTERVAL 2 MONTH
 WHERE l.month >= l.e - INTERVAL 5 MONTH AND abs(l.after - l.before) >= 100000) WHERE place <= 6""",
        _M, SP,
        _FULL,
        shifts_sql(1, True).format(pairs="fp"),
    ),
    "exact_duplicates": O.query(
        """SELECT company_id, strftime(vdate, '%Y-%m-%d') AS voucher_date, accs AS accounts, cost, count(*) AS n, min(voucher) AS first_voucher, max(voucher) AS last_voucher FROM (
 SELECT vid, company_id, vdate, series || number AS voucher, string_agg(account || ':' || amount || ':' || status, ';' ORDER BY account || ':' || amount || ':' || status) AS sig,
  (SELECT string_agg(CAST(a AS VARCHAR), ',' ORDER BY a) FROM (SELECT DISTINCT unnest(list(account)) AS a)) AS accs,
  CAST(abs(sum(CASE WHEN account BETWEEN 4000 AND 7999 THEN amount ELSE 0 END)) AS BIGINT) AS cost FROM (SELECT v.*, r.rn, r.account, r.amount, r.status FROM v JOIN r USING (vid) WHERE r.status <> 'removed') GROUP BY 1, 2, 3, 4)
 WHERE cost >= 10000 GROUP BY company_id, vdate, sig, accs, cost HAVING count(*) >= 2"""
    ),
}

SQL["drilldown_counterparties"] = O.query(
    """SELECT company_id, period, compare, cp_key, current, previous, current - previous AS diff, CAST(previous = 0 AND current <> 0 AS INTEGER) AS is_new, CAST(rank AS INTEGER) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY company_id, period, compare ORDER BY abs(current - previous) DESC, cp_key) AS rank FROM (
  SELECT x.company_id, x.period, x.compare, c.cp_key, CAST(sum(CASE WHEN c.period = x.period THEN c.amount ELSE 0 END) AS BIGINT) AS current,
   CAST(sum(CASE WHEN c.period = x.compare THEN c.amount ELSE 0 END) AS BIGINT) AS previous FROM pair x JOIN cpp c ON c.company_id = x.company_id AND c.period IN (x.period, x.compare) GROUP BY ALL)) WHERE rank <= 8""",
    _Q,
    SP,
    "cpp AS (SELECT pm.company_id, pm.period, m.cp_key, sum(m.amount) AS amount FROM pm JOIN sm m ON m.company_id = pm.company_id AND m.month = pm.month GROUP BY ALL)",
)
