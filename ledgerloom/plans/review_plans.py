"""Registered queries: versions, change capture, findings lifecycle, cases, differences, portfolio."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import ranges as R
from ledgerloom.functions.rates import RATES
from ledgerloom.operators import bridges as B
from ledgerloom.operators import cases as C
from ledgerloom.operators import differences as D
from ledgerloom.operators import findings as FI
from ledgerloom.operators import ledger as L
from ledgerloom.operators import metrics as M
from ledgerloom.operators import periods as P
from ledgerloom.operators import portfolio as PF
from ledgerloom.operators import spend as E
from ledgerloom.operators import statements as S
from ledgerloom.operators import versions as V
from ledgerloom.operators.controls import base, integrity
from ledgerloom.operators.voucher_facts import content_hash
from ledgerloom.plans import oracle as O
from ledgerloom.plans.book import Book
from ledgerloom.plans.control_plans import CONTROLS, MAT, VF, _flat
from ledgerloom.plans.control_plans import SQL as CONTROL_SQL
from ledgerloom.plans.explain_plans import _EXPL, _PW
from ledgerloom.plans.spend_plans import SP
from ledgerloom.plans.statement_plans import _CATS, FIG
from ledgerloom.session import stage

TODAY = "2028-12-20"


def voucher_hashes(book: Book) -> DataFrame:
    h = book.vouchers.select("company_id", F.date_format("voucher_date", "yyyy-MM").alias("month"), content_hash().alias("h"))
    return h.groupBy("company_id", "month").agg(F.count("*").alias("n"), F.min("h").alias("min_hash"), F.max("h").alias("max_hash"))


def voucher_versions(book: Book) -> DataFrame:
    return book.versions[3].select("company_id", "number", "content_hash", "valid_from", "valid_to")


def import_stats(book: Book) -> DataFrame:
    _ = book.versions
    parts = [V.import_stats(a).withColumn("seq", F.lit(i)) for i, a in enumerate(book.actions, 1)]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("company_id", F.col("fy_start").cast("string").alias("fy_start"), "seq", "action", "n")


def voucher_snapshot(book: Book) -> DataFrame:
    return V.snapshot(book.versions[3], 2).select("company_id", "number", "content_hash")


def voucher_diff(book: Book) -> DataFrame:
    return V.changes(book.versions[3], 1, 3).select("company_id", "number", "kind")


def affected_months(book: Book) -> DataFrame:
    _ = book.versions
    parts = [V.affected_months(a).withColumn("seq", F.lit(i)) for i, a in enumerate(book.actions[1:], 2)]
    return parts[0].unionByName(parts[1]).select("company_id", "seq", F.date_format("month", "yyyy-MM").alias("month"))


def ctl_changed_after_approval(book: Book) -> DataFrame:
    ctx = base.LazyContext(book, book.changed)
    return _flat(base.gate(integrity.changed_after_approval(ctx), ctx))


def periods_to_review(book: Book) -> DataFrame:
    _ = book.versions
    latest = L.latest_data(book.coverage, book.movements)
    return V.periods_to_review(book.coverage, latest, book.approved, V.affected_months(book.actions[2])).select(
        "company_id", F.date_format("month", "yyyy-MM").alias("month")
    )


def _settings() -> list[str]:
    """Everything that decides how figures are read: line and category ranges, dated rates and rules."""
    line = [f"line|{name}|{lo}|{hi}" for name, (lo, hi) in (R.INCOME_LEAVES | R.BALANCE_LEAVES).items()]
    category = [f"category|{code}|{parent}|{accounts.sql('account')}" for code, parent, accounts in R.CATEGORIES]
    rule = [f"rule|{r.code}|{r.severity}|{r.valid_from}|{r.valid_to}|{sorted(r.params.items())}" for r in base.CATALOG.values()]
    return [*line, *category, *["|".join(["rate", *map(str, r)]) for r in RATES], *rule]


def source_fingerprint(book: Book) -> DataFrame:
    hashes = book.vouchers.select("company_id", F.trunc("voucher_date", "MM").alias("month"), content_hash().alias("content_hash"))
    return V.source_fingerprint(book.year_pairs("month", "quarter", "rolling"), V.voucher_parts(hashes), book.year_balances, _settings())


def reconcile_findings(book: Book) -> DataFrame:
    return book.records.select(
        "company_id", "fingerprint", "rule_code", "status", "outcome", "period", "amount", F.array_join("seen_in_reviews", ",").alias("seen"), "resolution_note"
    )


def rule_precision(book: Book) -> DataFrame:
    return FI.rule_precision(book.records)


def approval_snapshot(book: Book) -> DataFrame:
    """Findings seen in each approved period, with the imports that the approval rests on."""
    wanted = book.coverage.where("covered").select("company_id", F.date_format("month", "yyyy-MM").alias("period"))
    blocked = FI.approval_gate(FI.period_status(book.records, book.maturity), wanted.withColumn("override_note", F.lit("")))
    approved = blocked.where("result = 'approved'").select("company_id", "period")
    seq = F.max(F.coalesce("valid_to", "valid_from"))
    latest = book.versions[3].groupBy("company_id", "fy_start").agg(seq.alias("seq"))
    found = FI.approval_snapshot(approved, book.records, latest)
    seqs = F.array_join(F.array_sort(F.transform(F.map_entries("fy_seqs"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",")
    return found.select("company_id", "period", "fingerprint", "rule_code", "status", seqs.alias("fy_seqs"))


def findings_listing(book: Book) -> DataFrame:
    """Open findings of one period, most severe first."""
    page = FI.listing(book.records, status=list(FI.OPEN), period="2025-06")
    return page.select("company_id", "fingerprint", "rule_code", "severity", "period", "status")


def _decided(book: Book) -> DataFrame:
    """Records with author, reason and time of the decision."""
    done = F.col("status").isin(*FI.REMEMBERED)
    days = F.conv(F.substring("fingerprint", 4, 2), 16, 10).cast("int")
    return book.records.select(
        *[c for c in book.records.columns if c != "resolution_note"],
        F.when(done, "anna").alias("resolved_by"),
        F.when(done, F.concat(F.lit("bedömt "), F.substring("fingerprint", 3, 1))).alias("resolution_note"),
        F.when(done, F.date_add(F.lit("2027-01-01").cast("date"), days)).alias("resolved_at"),
    )


def memory_suggestions(book: Book) -> DataFrame:
    signed = FI.pattern_signatures(_decided(book), book.facts)
    return FI.suggest(signed, FI.remember(signed), TODAY).select(
        "company_id", "fingerprint", "rule_code", "confidence", "decision", "rationale", F.col("decided_at").cast("string").alias("decided_at")
    )


def cases(book: Book) -> DataFrame:
    found, members = C.build_cases(book.records)
    return found.join(C.case_status(members), ["company_id", "component"]).select(
        "company_id", "component", "n_findings", "lead", "lead_rule", "period", "severity", "visibility", "status"
    )


def period_status(book: Book) -> DataFrame:
    return FI.period_status(book.records, book.maturity).select("company_id", "period", "status", "n_open", "n_high")


def approval_gate(book: Book) -> DataFrame:
    requests = book.coverage.select(
        "company_id",
        F.date_format("month", "yyyy-MM").alias("period"),
        F.when(F.month("month") % 4 == 0, "granskat manuellt").alias("override_note"),
    )
    return FI.approval_gate(FI.period_status(book.records, book.maturity), requests).select("company_id", "period", "result")


def decisions(book: Book) -> DataFrame:
    """Decision log applied to the records; invalid decisions are rejected."""
    digit = F.substring("fingerprint", 5, 1)
    log = book.records.where(digit.isin(*"01234567")).select(
        "company_id",
        "fingerprint",
        F.when(digit.isin(*"01"), "RESOLVED").when(digit.isin(*"23"), "ACCEPTED_OK").when(digit == "4", "AUTO_CLOSED").otherwise("ASK_CLIENT").alias("status"),
        F.when(digit != "3", "motivering").alias("note"),
        F.lit("anna").alias("decided_by"),
        F.lit("2028-01-01").cast("date").alias("decided_at"),
    )
    out = FI.apply_decisions(book.records.withColumn("resolved_by", F.lit(None).cast("string")), log)
    return out.groupBy("company_id", "rule_code", "status").agg(F.count("*").alias("n"), F.count("resolved_by").alias("n_decided"))


# ------------------------------------------------------------------------------- differences
def _difference_inputs(book: Book):
    pairs = book.year_pairs("quarter")
    # Each of these feeds several item kinds: written once, read by all.
    income = stage(book.income_both(pairs), "difference_income")
    compared = stage(S.compared_income(pairs, income), "difference_lines")
    fig_base = stage(book.figure_base(income), "difference_figures")
    paired = stage(B.paired_base(pairs, fig_base), "difference_pairs")
    comparable = P.validate_pairs(pairs, book.coverage).where("pair_status = 'CALCULATED'").select(*D.KEYS)
    return pairs, compared, fig_base, paired, comparable


def _items(book: Book) -> DataFrame:
    """The ranked items, written once per run: the list and the recommendations both read it."""
    if "items" not in book.__dict__:
        book.__dict__["items"] = stage(_collect_items(book), "difference_items")
    return book.__dict__["items"]


def _collect_items(book: Book) -> DataFrame:
    pairs, compared, fig_base, paired, comparable = _difference_inputs(book)
    base_ = D.bases(paired, compared)
    changes = M.figure_changes(pairs, M.key_figures(fig_base))
    metric = D.metric_items(changes, B.explain_metrics(paired), base_)
    lines = D.income_line_items(compared, base_, comparable)
    bs = S.balance_sheet(book.balance_wide)
    ends = pairs.select(*D.KEYS, F.trunc("end", "MM").alias("m1"), F.trunc("c_end", "MM").alias("m0"))
    now = bs.select("company_id", F.col("month").alias("m1"), "line", "amount", F.col("balance_complete").alias("ok1"))
    before = bs.select("company_id", F.col("month").alias("m0"), "line", F.col("amount").alias("compare_amount"), F.col("balance_complete").alias("ok0"))
    both = ends.join(now, ["company_id", "m1"]).join(before, ["company_id", "m0", "line"]).where("ok1 AND ok0")
    balance = D.balance_line_items(both, base_, comparable)
    cats = D.category_items(B.category_bridge(pairs, book.movements), book.movements, base_, comparable)
    return metric.unionByName(lines).unionByName(balance).unionByName(cats)


def differences(book: Book) -> DataFrame:
    return _items(book)


def recommended(book: Book) -> DataFrame:
    return D.recommend(_items(book)).where("recommended = 1 OR covered_by IS NOT NULL").select(*D.KEYS, "id", "score", "family", "recommended", "covered_by")


def finding_priorities(book: Book) -> DataFrame:
    """Pattern candidates of monthly pairs (recurring costs, same-day copies), ranked."""
    pairs = book.month_pairs()
    rows = book.month_spend
    months = pairs.select("company_id", "period", F.explode(F.expr("sequence(add_months(trunc(end, 'MM'), -11), trunc(end, 'MM'), interval 1 month)")).alias("month"))
    full = months.join(book.coverage.where("covered"), ["company_id", "month"]).groupBy("company_id", "period").agg(F.count("*").alias("n")).where("n = 12")
    recurring = E.recurring_changes(rows, full).select(*D.KEYS, F.lit("recurring_cost_change").alias("code"), F.concat(F.lit("confirmed-counterparty:"), "cp_key").alias("group_key"), "effect")
    copies = E.exact_copies(book.vouchers).withColumn("period", F.date_format("voucher_date", "yyyy-MM"))
    dup = copies.join(pairs.select(*D.KEYS), ["company_id", "period"]).select(*D.KEYS, F.lit("possible_duplicate").alias("code"), F.concat(F.lit("possible_duplicate:"), "first_voucher").alias("group_key"), F.col("cost").alias("effect"))
    cands = recurring.unionByName(dup).select(
        "*", F.lit("SEK").alias("unit"), F.lit("account_voucher").alias("source_level"), F.lit(0).alias("n_facts"), F.lit(True).alias("has_warnings"), F.lit(True).alias("has_sources")
    )
    return D.rank_candidates(cands).select(*D.KEYS, "code", "group_key", "effect", "score", "position", F.col("shown").cast("int").alias("shown"))


def _portfolio(book: Book) -> DataFrame:
    inc = S.income_wide(book.periods("rolling"), book.monthly, book.coverage)
    figures = M.key_figures(book.figure_base(inc), ("operating_margin",))
    latest = L.latest_data(book.coverage, book.movements)
    last_status = book.maturity.where("status <> 'NO_DATA'").groupBy("company_id").agg(F.max_by("status", "month").alias("last_status"))
    cid = F.col("company_id").cast("int")
    inputs = (
        book.companies.select("company_id", "name")
        .join(PF.open_counts(book.records), "company_id", "left")
        .join(PF.margin_changes(figures, latest), "company_id", "left")
        .join(latest, "company_id", "left")
        .join(last_status, "company_id", "left")
        .na.fill(0, ["open_high", "open_medium", "open_low"])
        .na.fill(False, ["changed"])
        .withColumn("last_review", F.when(cid % 3 != 0, F.date_sub(F.lit(TODAY).cast("date"), cid * 3)))
        .withColumn("expected_month", F.lit("2028-10-01").cast("date"))
        .withColumn("connection_ok", cid % 11 != 5)
        .withColumn("unanswered", cid % 4)
        .withColumn("preliminary", F.coalesce(F.col("last_status") == "PRELIMINARY", F.lit(False)))
    )
    return PF.priorities(inputs, TODAY)


def portfolio_counters(book: Book) -> DataFrame:
    return PF.todo_counters(_portfolio(book))


def portfolio(book: Book) -> DataFrame:
    return _portfolio(book).select("company_id", "name", "open_high", "open_medium", "open_low", "margin_change", "score", F.array_join(F.transform("reasons", lambda r: r["code"]), ",").alias("reasons"))


QUERIES = {
    f.__name__: f
    for f in (
        voucher_hashes, voucher_versions, import_stats, voucher_snapshot, voucher_diff, affected_months, ctl_changed_after_approval,
        periods_to_review, source_fingerprint, reconcile_findings, rule_precision, memory_suggestions, cases, period_status, approval_gate,
        decisions, differences, recommended, finding_priorities, portfolio, portfolio_counters, approval_snapshot, findings_listing,
    )
}

# ------------------------------------------------------------------------------------- oracle
_H = "sha256('B|' || number || '|' || strftime(vdate, '%Y-%m-%d') || '|' || trim(text{x}) || chr(10) || body)"
VER = f"""bd AS (SELECT vid, string_agg(account || '|' || amount || '||' || status, chr(10) ORDER BY rn) AS body FROM r GROUP BY vid),
vv AS (SELECT company_id, number, CAST(number AS BIGINT) AS k, vdate, CAST(date_trunc('year', vdate) AS DATE) AS fy, {_H.format(x='')} AS h0, {_H.format(x=" || ' (prel)'")} AS h1, {_H.format(x=" || ' (rättad)'")} AS h3
 FROM v JOIN bd USING (vid) WHERE series = 'B'),
vi AS (SELECT *, k % 20 <> 0 AS i1, CASE WHEN k % 15 = 1 THEN h1 ELSE h0 END AS x1, k % 17 <> 3 AS i2, h0 AS x2, rng AND k % 19 <> 4 AS i3, CASE WHEN k % 23 = 5 THEN h3 ELSE h0 END AS x3
 FROM (SELECT *, vdate BETWEEN DATE '2025-03-10' AND DATE '2025-06-20' AS rng FROM vv)),
ver AS (SELECT company_id, number, vdate, x1 AS content_hash, 1 AS valid_from, CASE WHEN NOT i2 OR x2 <> x1 THEN 2 WHEN rng AND (NOT i3 OR x3 <> x1) THEN 3 END AS valid_to FROM vi WHERE i1
 UNION ALL SELECT company_id, number, vdate, x2, 2, CASE WHEN rng AND (NOT i3 OR x3 <> x2) THEN 3 END FROM vi WHERE i2 AND (NOT i1 OR x1 <> x2)
 UNION ALL SELECT company_id, number, vdate, x3, 3, NULL FROM vi WHERE i3 AND (NOT i2 OR x2 <> x3))"""
_CHANGED = """SELECT company_id, strftime(month, '%Y-%m') AS review, strftime(month, '%Y-%m') AS period, 'HIGH' AS severity, strftime(month, '%Y-%m') || '|' || CAST(sum(CAST(('0x' || substr(md5('B|' || number || '|' || kind), 1, 14)) AS BIGINT)) AS VARCHAR) AS key, '' AS vouchers,
 '' AS accounts, CAST(NULL AS BIGINT) AS amount, CAST(count(*) AS VARCHAR) AS variant FROM (SELECT company_id, number, CASE WHEN NOT i2 THEN 'ADDED' WHEN NOT i3 THEN 'REMOVED' ELSE 'CHANGED' END AS kind, CAST(date_trunc('month', vdate) AS DATE) AS month FROM vi WHERE rng AND ((i2 <> i3) OR (i2 AND i3 AND x2 <> x3)) AND CAST(company_id AS INTEGER) % 2 = 0)
 WHERE (company_id, month) IN (SELECT company_id, month FROM cov WHERE covered) GROUP BY company_id, month"""
_DUPLICATE = f"""SELECT company_id, voucher_date[:7] AS review, voucher_date[:7] AS period, 'HIGH' AS severity, least(original, voucher) || '|' || greatest(original, voucher) AS key, original || ',' || voucher AS vouchers,
 CAST(account AS VARCHAR) AS accounts, amount, 'exact' AS variant FROM ({O.inner(CONTROL_SQL['ctl_duplicate_exact'], VF)})
 UNION ALL SELECT company_id, voucher_date[:7], voucher_date[:7], 'MEDIUM', least(original, voucher) || '|' || greatest(original, voucher), original || ',' || voucher,
 CAST(account AS VARCHAR), amount, 'similar' FROM ({O.inner(CONTROL_SQL['ctl_duplicate_similar'], VF)})"""
_PARTS = {code: O.inner(CONTROL_SQL[name], VF) for name, code in CONTROLS.items()}
_PARTS |= {"DUPLICATE_CANDIDATE": _DUPLICATE, "CHANGED_AFTER_APPROVAL": O.inner(O.query(_CHANGED, VER), VF)}
_FIN = (
    f"{VF},\nfin0 AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS rule_code, '{r.visibility}' AS visibility, {i} AS rank, q.* FROM ({_PARTS[c]}) q" for i, (c, r) in enumerate(base.CATALOG.items()))
    + """),
fin1 AS (SELECT *, substr(sha256(rule_code || chr(31) || replace(key, '|', chr(31))), 1, 32) AS fp FROM fin0),
fin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id, review, fp ORDER BY rank, vouchers, amount, variant) AS rk FROM fin1) WHERE rk = 1),
ex AS (SELECT company_id, fp, rule_code, visibility, list_sort(list(DISTINCT review)) AS seen, last(severity ORDER BY review) AS severity, last(period ORDER BY review) AS period, last(vouchers ORDER BY review) AS vouchers,
  last(accounts ORDER BY review) AS accounts, last(amount ORDER BY review) AS amount,
  CASE WHEN substr(fp, 2, 1) IN ('0','1','2','3','4','5') THEN 'NEW' WHEN substr(fp, 2, 1) IN ('6','7') THEN 'IN_PROGRESS' WHEN substr(fp, 2, 1) IN ('8','9') THEN 'ASK_CLIENT'
   WHEN substr(fp, 2, 1) = 'a' THEN 'AUTO_CLOSED' WHEN substr(fp, 2, 1) IN ('b','c') THEN 'RESOLVED' ELSE 'ACCEPTED_OK' END AS status FROM fin WHERE substr(fp, 1, 1) NOT IN ('0', '1') GROUP BY 1, 2, 3, 4),
cn AS (SELECT company_id, fp, rule_code, visibility, list(DISTINCT review) AS prod, last(severity ORDER BY review) AS severity, last(period ORDER BY review) AS period, last(vouchers ORDER BY review) AS vouchers,
  last(accounts ORDER BY review) AS accounts, last(amount ORDER BY review) AS amount, last(variant ORDER BY review) AS variant FROM fin WHERE review >= '2024-01' AND substr(fp, 1, 1) NOT IN ('e', 'f') GROUP BY 1, 2, 3, 4),
rv AS (SELECT company_id, list(strftime(month, '%Y-%m')) AS runs FROM cov WHERE covered AND month >= DATE '2024-01-01' GROUP BY 1),
sp0 AS (SELECT *, CASE WHEN rule_code = 'INPUT_VAT_RATIO' AND list_contains(string_split(accounts, ','), '6310') THEN 'försäkring'
   WHEN rule_code = 'OUTPUT_VAT_RATIO' AND abs(amount) <= 3000000 THEN 'småbelopp' WHEN rule_code = 'UNBALANCED_VOUCHER' AND company_id = '3' AND contains(lower('""" + base.TITLES["UNBALANCED_VOUCHER"] + """' || ' ' || replace(vouchers, ',', ' ') || ' ' || replace(accounts, ',', ' ') || ' ' || variant), 'balanserar inte b') THEN 'öresavrundning' END AS mute FROM cn),
rc0 AS (SELECT coalesce(e.company_id, c.company_id) AS company_id, coalesce(e.fp, c.fp) AS fp, e.fp AS efp, c.fp AS cfp, coalesce(e.rule_code, c.rule_code) AS rule_code, coalesce(c.visibility, e.visibility) AS visibility, e.status AS est, c.mute,
  coalesce(e.seen, CAST([] AS VARCHAR[])) AS eseen, coalesce(c.prod, CAST([] AS VARCHAR[])) AS prod, CASE WHEN c.fp IS NOT NULL THEN c.severity ELSE e.severity END AS severity, CASE WHEN c.fp IS NOT NULL THEN c.period ELSE e.period END AS period,
  CASE WHEN c.fp IS NOT NULL THEN c.vouchers ELSE e.vouchers END AS vouchers, CASE WHEN c.fp IS NOT NULL THEN c.accounts ELSE e.accounts END AS accounts, CASE WHEN c.fp IS NOT NULL THEN c.amount ELSE e.amount END AS amount
 FROM ex e FULL OUTER JOIN sp0 c ON c.company_id = e.company_id AND c.fp = e.fp),
rc1 AS (SELECT r.*, coalesce(runs, CAST([] AS VARCHAR[])) AS runs FROM rc0 r LEFT JOIN rv USING (company_id)),
rc2 AS (SELECT *, list_sort(list_distinct(list_concat([x for x in eseen if NOT list_contains(runs, x)], prod))) AS seen, len([x for x in eseen if list_contains(runs, x)]) > 0 AS touched FROM rc1),
rec AS (SELECT *, CASE WHEN efp IS NULL THEN CASE WHEN mute IS NOT NULL THEN 'SUPPRESSED' ELSE 'NEW' END WHEN cfp IS NULL AND touched AND len(seen) = 0 AND est IN ('NEW', 'IN_PROGRESS', 'ASK_CLIENT') THEN 'AUTO_CLOSED'
   WHEN cfp IS NOT NULL AND est = 'AUTO_CLOSED' THEN 'NEW' ELSE est END AS status,
  CASE WHEN efp IS NULL THEN 'created' WHEN cfp IS NOT NULL AND est = 'AUTO_CLOSED' THEN 'reopened' WHEN cfp IS NOT NULL THEN 'updated'
   WHEN touched AND len(seen) = 0 AND est IN ('NEW', 'IN_PROGRESS', 'ASK_CLIENT') THEN 'auto_closed' ELSE 'untouched' END AS outcome FROM rc2)"""
)
_OPENS = "('NEW', 'IN_PROGRESS', 'ASK_CLIENT')"
_FAM = "(VALUES " + ", ".join(f"('{f}', '{r}')" for f, rules in C.FAMILIES.items() for r in rules) + ") fm(family, rule)"
_ACT = "CASE rule_code " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(C.ACTION_ORDER)) + f" ELSE {len(C.ACTION_ORDER)} END"
_HUBS = f"""op AS (SELECT * FROM rec WHERE status IN {_OPENS}),
hb0 AS (SELECT company_id, fp, rule_code, 'v|' || (visibility = 'RESTRICTED_AML') || '|' || u AS hub, false AS mixed FROM (SELECT *, unnest(string_split(vouchers, ',')) AS u FROM op WHERE vouchers <> '')
 UNION ALL SELECT company_id, fp, rule_code, 'r|' || rule_code || '|' || period, false FROM op WHERE rule_code IN {C.SAME_RULE} AND visibility <> 'RESTRICTED_AML'
 UNION ALL SELECT company_id, fp, rule_code, 'f|' || family || '|' || period || '|' || a, true FROM (SELECT op.*, fm.family, unnest(CASE WHEN fm.family IN ('vat', 'payroll') THEN ['-1'] WHEN accounts = '' THEN [] ELSE string_split(accounts, ',') END) AS a
  FROM op JOIN {_FAM} ON fm.rule = op.rule_code WHERE visibility <> 'RESTRICTED_AML')),
hb AS (SELECT DISTINCT h.company_id, h.company_id || ':' || fp AS id, h.company_id || ':' || h.hub AS hub FROM hb0 h JOIN (SELECT company_id, hub FROM hb0 GROUP BY 1, 2 HAVING count(*) > 1 AND (NOT bool_or(mixed) OR min(rule_code) <> max(rule_code))) k USING (company_id, hub)),
cc(node, lab) USING KEY (node) AS (SELECT id AS node, id AS lab FROM hb
 UNION SELECT e.dst, min(c.lab) FROM cc c JOIN (SELECT id AS src, hub AS dst FROM hb UNION ALL SELECT hub, id FROM hb) e ON e.src = c.node LEFT JOIN recurring.cc r ON r.node = e.dst WHERE r.lab IS NULL OR c.lab < r.lab GROUP BY e.dst)"""

_SEKPTS = (
    "(CASE WHEN abs(ch) * 10 >= b THEN 40 WHEN abs(ch) * 20 >= b THEN 30 WHEN abs(ch) * 50 >= b THEN 20 WHEN abs(ch) * 100 >= b THEN 10 WHEN abs(ch) > 0 THEN 3 ELSE 0 END"
    " + CASE WHEN abs(ch) >= 10000000 THEN 15 WHEN abs(ch) >= 2500000 THEN 10 WHEN abs(ch) >= 500000 THEN 5 ELSE 0 END"
    " + CASE WHEN previous = 0 THEN CASE WHEN abs(ch) > 0 THEN 15 ELSE 0 END WHEN abs(ch) * 2 >= abs(previous) THEN 15 WHEN abs(ch) * 5 >= abs(previous) THEN 10 WHEN abs(ch) * 10 >= abs(previous) THEN 5 ELSE 0 END)"
)
_COSTL = "'materials','other_external','personnel','depreciation','other_operating_expenses','interest_expense','appropriations','tax'"
_NOCASH = "'intangible','tangible','financial_fixed','inventory','receivables','short_investments','equity','untaxed_reserves','provisions','long_term_liabilities','current_liabilities'"
_ITEMS = (
    O.periods_cte("quarter"),
    FIG,
    _PW,
    _CATS,
    f"""cmpi AS (SELECT x.company_id, x.kind, x.period, x.compare, a.line, a.amount, b.amount AS compare_amount, a.has_data AND b.has_data AS ok FROM pair x
 JOIN inc a ON a.company_id = x.company_id AND a.period = x.period JOIN inc b ON b.company_id = x.company_id AND b.period = x.compare AND b.line = a.line),
bas0 AS (SELECT company_id, period, compare, max(CASE WHEN line = 'net_sales' THEN greatest(abs(amount), abs(compare_amount)) END) AS t, sum(CASE WHEN line IN ({_COSTL}) THEN abs(amount) ELSE 0 END) AS c FROM cmpi GROUP BY ALL),
bas AS (SELECT b.*, CAST(CASE WHEN t > 0 THEN t WHEN c > 0 THEN c ELSE 100 END AS HUGEINT) AS ib, CAST(CASE WHEN coalesce(greatest(abs(p.c_ta), abs(p.p_ta)), 0) > 0 THEN greatest(abs(p.c_ta), abs(p.p_ta)) WHEN t > 0 THEN t WHEN c > 0 THEN c ELSE 100 END AS HUGEINT) AS bb
 FROM bas0 b LEFT JOIN pw p ON p.company_id = b.company_id AND p.period = b.period AND p.compare = b.compare),
expl AS (SELECT company_id, period, compare, metric, CAST(sum(effect) AS BIGINT) AS exact FROM ({' UNION ALL '.join(_EXPL.values())}) GROUP BY ALL),
mi AS (SELECT x.company_id, x.period, x.compare, a.metric, a.unit, a.value AS current, b.value AS previous, CASE WHEN a.metric IN ('equity_ratio','quick_ratio','current_ratio','working_capital','cash','receivables','payables') THEN bb ELSE ib END AS b,
  CASE WHEN a.status = 'CALCULATED' AND b.status = 'CALCULATED' THEN CASE WHEN a.unit = 'percent' THEN coalesce(e.exact, 0) ELSE a.value - b.value END END AS ch
 FROM pair x JOIN fig a ON a.company_id = x.company_id AND a.period = x.period JOIN fig b ON b.company_id = x.company_id AND b.period = x.compare AND b.metric = a.metric
 JOIN bas s ON s.company_id = x.company_id AND s.period = x.period LEFT JOIN expl e ON e.company_id = x.company_id AND e.period = x.period AND e.compare = x.compare AND e.metric = a.metric),
cacc AS (SELECT DISTINCT m.company_id, m.account, c.parent FROM mm m JOIN cats c ON m.account BETWEEN c.lo AND c.hi WHERE NOT m.account BETWEEN 8000 AND 8399),
cset AS (SELECT company_id, parent, list_sort(list(account)) AS s FROM cacc GROUP BY 1, 2),
lset AS (SELECT company_id, line, list_sort(list(DISTINCT account)) AS s FROM mm JOIN lines ON account BETWEEN lo AND hi WHERE account BETWEEN 3000 AND 8989 GROUP BY 1, 2),
catp AS (SELECT pm.company_id, pm.period, c.parent, sum(m.amount) AS amount FROM pm JOIN mm m ON m.company_id = pm.company_id AND m.month = pm.month JOIN cats c ON m.account BETWEEN c.lo AND c.hi WHERE NOT m.account BETWEEN 8000 AND 8399 GROUP BY ALL),
itm AS (
 SELECT company_id, period, compare, 'metric:' || metric AS id, 'metric' AS kind, metric AS code, unit, current, previous, ch, CASE WHEN ch IS NULL THEN 0 ELSE CASE WHEN metric IN ('net_sales','operating_result','operating_margin','result_after_financial','gross_margin','personnel_share','equity_ratio','quick_ratio','cash') THEN 5 ELSE 0 END
  + CASE WHEN unit = 'percent' THEN CASE WHEN abs(ch) >= 5000000000 THEN 60 WHEN abs(ch) >= 2000000000 THEN 45 WHEN abs(ch) >= 1000000000 THEN 30 WHEN abs(ch) >= 500000000 THEN 15 WHEN abs(ch) > 0 THEN 3 ELSE 0 END ELSE {_SEKPTS} END END AS score FROM mi
 UNION ALL SELECT company_id, period, compare, 'line:income:' || line, 'line', line, 'SEK', current, previous, ch, {_SEKPTS} - 5 FROM (SELECT c.company_id, c.period, c.compare, line, amount AS current, compare_amount AS previous, amount - compare_amount AS ch, ib AS b
   FROM cmpi c JOIN bas s ON s.company_id = c.company_id AND s.period = c.period WHERE ok AND line IN (SELECT line FROM lines WHERE lo >= 3000) AND line <> 'net_sales' AND (amount <> 0 OR compare_amount <> 0))
 UNION ALL SELECT company_id, period, compare, 'line:balance:' || line, 'line', line, 'SEK', current, previous, ch, {_SEKPTS} - 5 FROM (SELECT x.company_id, x.period, x.compare, a.line, a.amount AS current, p.amount AS previous, a.amount - p.amount AS ch, bb AS b
   FROM pair x JOIN bs a ON a.company_id = x.company_id AND a.month = x.e JOIN bs p ON p.company_id = x.company_id AND p.month = x.ce AND p.line = a.line JOIN bas s ON s.company_id = x.company_id AND s.period = x.period
   JOIN cmpl c1 ON c1.company_id = x.company_id AND c1.month = x.e AND c1.complete JOIN cmpl c0 ON c0.company_id = x.company_id AND c0.month = x.ce AND c0.complete
   WHERE a.line IN ({_NOCASH}) AND (a.amount <> 0 OR p.amount <> 0) AND EXISTS (SELECT 1 FROM cmpi c WHERE c.company_id = x.company_id AND c.period = x.period AND c.ok))
 UNION ALL SELECT company_id, period, compare, 'category:' || parent, 'category', parent, 'SEK', current, previous, ch, {_SEKPTS} FROM (SELECT x.company_id, x.period, x.compare, c.parent, CAST(sum(CASE WHEN c.period = x.period THEN amount ELSE 0 END) AS BIGINT) AS current,
   CAST(sum(CASE WHEN c.period = x.compare THEN amount ELSE 0 END) AS BIGINT) AS previous, CAST(sum(CASE WHEN c.period = x.period THEN amount ELSE -amount END) AS BIGINT) AS ch, any_value(ib) AS b
   FROM pair x JOIN catp c ON c.company_id = x.company_id AND c.period IN (x.period, x.compare) JOIN bas s ON s.company_id = x.company_id AND s.period = x.period
   WHERE EXISTS (SELECT 1 FROM cmpi q WHERE q.company_id = x.company_id AND q.period = x.period AND q.ok)
   AND NOT EXISTS (SELECT 1 FROM cset a JOIN lset l ON l.company_id = a.company_id AND l.s = a.s WHERE a.company_id = x.company_id AND a.parent = c.parent) GROUP BY 1, 2, 3, 4) WHERE current <> 0 OR previous <> 0)""",
)
_FAMCASE = "CASE id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.FAMILIES.items()) + " ELSE id END"

SQL = {
    "voucher_hashes": O.query(
        """SELECT company_id, strftime(vdate, '%Y-%m') AS month, count(*) AS n, min(h) AS min_hash, max(h) AS max_hash FROM (SELECT company_id, vdate,
 sha256(series || '|' || number || '|' || strftime(vdate, '%Y-%m-%d') || '|' || trim(text) || chr(10) || body) AS h FROM v JOIN (SELECT vid, string_agg(account || '|' || amount || '||' || status, chr(10) ORDER BY rn) AS body FROM r GROUP BY vid) b USING (vid)) GROUP BY 1, 2"""
    ),
    "voucher_versions": O.query("SELECT company_id, number, content_hash, valid_from, valid_to FROM ver", VER),
    "import_stats": O.query(
        """SELECT company_id, strftime(fy, '%Y-%m-%d') AS fy_start, seq, action, count(*) AS n FROM (
 SELECT company_id, fy, 1 AS seq, 'added' AS action FROM vi WHERE i1
 UNION ALL SELECT company_id, fy, 2, CASE WHEN i1 AND i2 THEN CASE WHEN x1 = x2 THEN 'unchanged' ELSE 'changed' END WHEN i2 THEN 'added' ELSE 'removed' END FROM vi WHERE i1 OR i2
 UNION ALL SELECT company_id, fy, 3, CASE WHEN NOT rng THEN 'kept' WHEN i2 AND i3 THEN CASE WHEN x3 = x2 THEN 'unchanged' ELSE 'changed' END WHEN i3 THEN 'added' ELSE 'removed' END FROM vi WHERE fy = DATE '2025-01-01' AND (i2 OR i3)) GROUP BY ALL""",
        VER,
    ),
    "voucher_snapshot": O.query("SELECT company_id, number, content_hash FROM ver WHERE valid_from <= 2 AND (valid_to IS NULL OR valid_to > 2)", VER),
    "voucher_diff": O.query(
        """SELECT company_id, number, CASE WHEN NOT i1 THEN 'ADDED' WHEN y IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS kind FROM (SELECT *, CASE WHEN rng THEN CASE WHEN i3 THEN x3 END WHEN i2 THEN x2 END AS y FROM vi)
 WHERE CASE WHEN i1 THEN x1 END IS DISTINCT FROM y""",
        VER,
    ),
    "affected_months": O.query(
        """SELECT DISTINCT company_id, seq, strftime(vdate, '%Y-%m') AS month FROM (SELECT company_id, vdate, 2 AS seq FROM vi WHERE (i1 <> i2) OR (i1 AND i2 AND x1 <> x2)
 UNION ALL SELECT company_id, vdate, 3 FROM vi WHERE rng AND ((i2 <> i3) OR (i2 AND i3 AND x2 <> x3)))""",
        VER,
    ),
    "ctl_changed_after_approval": O.query(_CHANGED, VER),
    "periods_to_review": O.query(
        """SELECT DISTINCT w.company_id, strftime(w.month, '%Y-%m') AS month FROM (SELECT company_id, CAST(m - to_months(CAST(i AS INTEGER)) AS DATE) AS month FROM (SELECT x.company_id, max(x.month) AS m FROM mm x JOIN cov c ON c.company_id = x.company_id AND c.month = x.month AND c.covered GROUP BY 1), range(3) t(i)
 UNION SELECT company_id, CAST(date_trunc('month', vdate) AS DATE) FROM vi WHERE rng AND ((i2 <> i3) OR (i2 AND i3 AND x2 <> x3))) w JOIN cov c ON c.company_id = w.company_id AND c.month = w.month AND c.covered
 WHERE NOT (w.month <= DATE '2025-12-01' AND CAST(w.company_id AS INTEGER) % 2 = 0)""",
        VER,
    ),
    "reconcile_findings": O.query(
        """SELECT company_id, fp AS fingerprint, rule_code, status, outcome, period, amount, array_to_string(seen, ',') AS seen,
 CASE WHEN efp IS NULL AND mute IS NOT NULL THEN 'Undertryckt: ' || mute WHEN outcome = 'auto_closed' THEN 'Försvann ur bokföringen (troligen rättat).' END AS resolution_note FROM rec""",
        _FIN,
    ),
    "findings_all": O.query("SELECT company_id, review, rule_code, severity, visibility, period, fp AS fingerprint, vouchers, amount, variant FROM fin", _FIN),
    "rule_precision": O.query(
        """SELECT *, CASE WHEN actioned + not_actioned > 0 THEN actioned * 10000 // (actioned + not_actioned) END AS precision FROM (SELECT rule_code, count(*) AS total, count(*) FILTER (status IN ('RESOLVED', 'ASK_CLIENT')) AS actioned,
 count(*) FILTER (status IN ('ACCEPTED_OK', 'SUPPRESSED')) AS not_actioned, count(*) FILTER (status IN ('NEW', 'IN_PROGRESS')) AS open FROM rec GROUP BY 1)""",
        _FIN,
    ),
    "memory_suggestions": O.query(
        f"""SELECT s.company_id, s.fp AS fingerprint, s.rule_code, CASE WHEN e.decision IS NOT NULL THEN 'exact' ELSE 'similar' END AS confidence, coalesce(e.decision, l.decision) AS decision,
 coalesce(e.rationale, l.rationale) AS rationale, strftime(coalesce(e.decided_at, l.decided_at), '%Y-%m-%d') AS decided_at FROM sg s
 LEFT JOIN (SELECT company_id, rule_code, exact, last(decision ORDER BY decided_at, rationale, decision) AS decision, last(rationale ORDER BY decided_at, rationale, decision) AS rationale, max(decided_at) AS decided_at FROM rs GROUP BY 1, 2, 3) e
  ON e.company_id = s.company_id AND e.rule_code = s.rule_code AND e.exact = s.exact
 LEFT JOIN (SELECT company_id, rule_code, loose, last(decision ORDER BY decided_at, rationale, decision) AS decision, last(rationale ORDER BY decided_at, rationale, decision) AS rationale, max(decided_at) AS decided_at FROM rs GROUP BY 1, 2, 3) l
  ON l.company_id = s.company_id AND l.rule_code = s.rule_code AND l.loose = s.loose WHERE s.status IN {_OPENS} AND coalesce(e.decision, l.decision) IS NOT NULL""",
        _FIN,
        SP.split("sp AS (SELECT p.*")[0].rstrip().rstrip(",").replace("SELECT DISTINCT text FROM p WHERE account BETWEEN 4000 AND 6999", "SELECT DISTINCT text FROM v").replace("tx AS (SELECT t.*", "txu AS (SELECT t.*"),
        f"""vx AS (SELECT company_id, series || number AS voucher, min(text) AS text FROM v GROUP BY 1, 2),
vk AS (SELECT vx.company_id, vx.voucher, CASE WHEN fullkey = '' OR ws[1] IN ('diverse','omforing','justering','korrigering','lon','bankavgifter','ranta','momsredovisning') THEN '' ELSE two END AS k FROM vx JOIN tx4 USING (text)),
cpf AS (SELECT r.company_id, r.fp, first(vk.k ORDER BY pos) AS cp FROM (SELECT company_id, fp, unnest(string_split(vouchers, ',')) AS vo, generate_subscripts(string_split(vouchers, ','), 1) AS pos FROM rec WHERE vouchers <> '') r
 JOIN vk ON vk.company_id = r.company_id AND vk.voucher = r.vo WHERE vk.k <> '' GROUP BY 1, 2),
sg AS (SELECT r.*, r.rule_code || '|' || coalesce(array_to_string(list_sort(list_distinct(CASE WHEN accounts = '' THEN [] ELSE string_split(accounts, ',') END))[1:4], ','), '') || '|' || coalesce(cp, '') AS loose,
  coalesce(CAST(CASE WHEN amount <> 0 THEN floor(ln(abs(amount) / 100.0::DOUBLE) / ln(1.5::DOUBLE)) END AS INTEGER)::VARCHAR, 'None') AS bk FROM rec r LEFT JOIN cpf c ON c.company_id = r.company_id AND c.fp = r.fp),
sg2 AS (SELECT *, loose || '|' || bk AS exact FROM sg),
rs AS (SELECT company_id, rule_code, loose, exact, status AS decision, 'bedömt ' || substr(fp, 3, 1) AS rationale, DATE '2027-01-01' + CAST(('0x' || substr(fp, 4, 2)) AS INTEGER) AS decided_at FROM sg2 WHERE status IN ('ACCEPTED_OK', 'RESOLVED', 'ASK_CLIENT'))""",
    ).replace("FROM sg s\n", "FROM sg2 s\n"),
    "cases": O.query(
        f"""SELECT company_id, min(fp) AS component, count(*) AS n_findings, first(fp ORDER BY sev DESC, act, fp) AS lead, first(rule_code ORDER BY sev DESC, act, fp) AS lead_rule, first(period ORDER BY sev DESC, act, fp) AS period,
 ['LOW', 'MEDIUM', 'HIGH'][max(sev)] AS severity, CASE WHEN bool_or(visibility = 'RESTRICTED_AML') THEN 'RESTRICTED_AML' WHEN bool_or(visibility = 'INTERNAL') THEN 'INTERNAL' ELSE 'CLIENT_SAFE' END AS visibility,
 CASE WHEN bool_or(status = 'NEW') THEN 'OPEN' WHEN bool_or(status = 'IN_PROGRESS') THEN 'IN_PROGRESS' WHEN bool_or(status = 'ASK_CLIENT') THEN 'WAITING_CLIENT' ELSE 'CLOSED' END AS status
 FROM (SELECT op.*, coalesce(cc.lab, op.company_id || ':' || fp) AS lab, CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS sev, {_ACT} AS act FROM op LEFT JOIN cc ON cc.node = op.company_id || ':' || fp) GROUP BY company_id, lab""",
        _FIN,
        _HUBS,
    ),
    "decisions": O.query(
        """SELECT company_id, rule_code, CASE WHEN d IS NOT NULL THEN d ELSE status END AS status, count(*) AS n, count(d) AS n_decided FROM (SELECT *, CASE WHEN substr(fp, 5, 1) IN ('0', '1') THEN 'RESOLVED' WHEN substr(fp, 5, 1) = '2' THEN 'ACCEPTED_OK'
 WHEN substr(fp, 5, 1) IN ('5', '6', '7') THEN 'ASK_CLIENT' END AS d FROM rec) GROUP BY 1, 2, 3""",
        _FIN,
    ),
    "differences": O.query("SELECT company_id, period, compare, id, kind, code, unit, current, previous, CAST(ch AS BIGINT) AS change, CAST(score AS INTEGER) AS score FROM itm", *_ITEMS),
    "recommended": O.query(
        """SELECT company_id, period, compare, id, CAST(score AS INTEGER) AS score, family, CAST(rec AS INTEGER) AS recommended, CASE WHEN rec = 0 THEN leader END AS covered_by FROM (
 SELECT *, CASE WHEN live AND inf = 1 AND place <= 6 THEN 1 ELSE 0 END AS rec, max(CASE WHEN live AND inf = 1 AND place <= 6 THEN 1 ELSE 0 END) OVER (PARTITION BY company_id, period, family) AS fc FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id, period, live AND inf = 1 ORDER BY score DESC, ko, id) AS place FROM (
   SELECT *, row_number() OVER (PARTITION BY company_id, period, family, live ORDER BY score DESC, ko, id) AS inf, first_value(id) OVER (PARTITION BY company_id, period, family, live ORDER BY score DESC, ko, id) AS leader FROM (
    SELECT *, """ + _FAMCASE + """ AS family, ch IS NOT NULL AND score > 0 AS live, CASE kind WHEN 'metric' THEN 0 WHEN 'line' THEN 1 ELSE 2 END AS ko FROM itm)))) WHERE rec = 1 OR (live AND fc = 1)""",
        *_ITEMS,
    ),
}

_PS = f"""oi AS (SELECT company_id, period, count(*) AS n_open, count(*) FILTER (severity = 'HIGH') AS n_high FROM (SELECT company_id, unnest(seen) AS period, severity FROM rec WHERE status IN {_OPENS}) GROUP BY 1, 2),
pst AS (SELECT m.company_id, strftime(m.month, '%Y-%m') AS period, m.pbook IS NOT DISTINCT FROM false OR coalesce(m.compl < 60, false) AS prel, coalesce(n_open, 0) AS n_open, coalesce(n_high, 0) AS n_high
 FROM mat2 m LEFT JOIN oi ON oi.company_id = m.company_id AND oi.period = strftime(m.month, '%Y-%m'))"""
SQL |= {
    "period_status": O.query(
        "SELECT company_id, period, CASE WHEN prel THEN 'PRELIMINARY' WHEN n_open > 0 THEN 'NEEDS_REVIEW' ELSE 'REVIEWED' END AS status, n_open, n_high FROM pst", _FIN, MAT, _PS
    ),
    "approval_gate": O.query(
        """SELECT c.company_id, strftime(c.month, '%Y-%m') AS period, CASE WHEN p.company_id IS NULL THEN 'not_reviewed' WHEN (p.n_high > 0 OR p.prel) AND month(c.month) % 4 <> 0 THEN 'blocked' ELSE 'approved' END AS result
 FROM cov c LEFT JOIN pst p ON p.company_id = c.company_id AND p.period = strftime(c.month, '%Y-%m')""",
        _FIN, MAT, _PS,
    ),
    "portfolio": O.query(
        f"""SELECT company_id, name, open_high, open_medium, open_low, margin_change, CAST(h + m + l + ca + mg + st + md + ce + uq + pr AS BIGINT) AS score,
 concat_ws(',', CASE WHEN h > 0 THEN 'high' END, CASE WHEN m > 0 THEN 'medium' END, CASE WHEN l > 0 THEN 'low' END, CASE WHEN ca > 0 THEN 'changed_after_approval' END, CASE WHEN mg > 0 THEN 'margin_drop' END, CASE WHEN st > 0 THEN 'stale_review' END, CASE WHEN md > 0 THEN 'missing_data' END,
  CASE WHEN ce > 0 THEN 'connection_error' END, CASE WHEN uq > 0 THEN 'unanswered_question' END, CASE WHEN pr > 0 THEN 'preliminary' END) AS reasons FROM (
 SELECT *, open_high * 10 AS h, open_medium * 3 AS m, least(open_low, 10) AS l, CASE WHEN changed THEN 15 ELSE 0 END AS ca, CASE WHEN margin_change <= -50 THEN 8 ELSE 0 END AS mg, CASE WHEN n % 3 = 0 OR n * 3 > 35 THEN 5 ELSE 0 END AS st, CASE WHEN latest IS NULL OR latest < DATE '2028-10-01' THEN 10 ELSE 0 END AS md,
  CASE WHEN n % 11 = 5 THEN 10 ELSE 0 END AS ce, n % 4 * 3 AS uq, CASE WHEN prel THEN 2 ELSE 0 END AS pr FROM (
 SELECT CAST(n_nationkey AS VARCHAR) AS company_id, n_nationkey AS n, n_name AS name, coalesce(oh, 0) AS open_high, coalesce(om, 0) AS open_medium, coalesce(ol, 0) AS open_low, coalesce(o.changed, false) AS changed, lt.latest, coalesce(lp.prel, false) AS prel, a.value - b.value AS margin_change FROM nation
 LEFT JOIN (SELECT company_id, count(*) FILTER (severity = 'HIGH') AS oh, count(*) FILTER (severity = 'MEDIUM') AS om, count(*) FILTER (severity = 'LOW') AS ol, bool_or(rule_code = 'CHANGED_AFTER_APPROVAL') AS changed FROM rec WHERE status IN {_OPENS} AND visibility <> 'RESTRICTED_AML' GROUP BY 1) o ON o.company_id = CAST(n_nationkey AS VARCHAR)
 LEFT JOIN (SELECT x.company_id, max(x.month) AS latest FROM mm x JOIN cov c ON c.company_id = x.company_id AND c.month = x.month AND c.covered GROUP BY 1) lt ON lt.company_id = CAST(n_nationkey AS VARCHAR)
 LEFT JOIN (SELECT company_id, last(prel ORDER BY period) AS prel FROM pst GROUP BY 1) lp ON lp.company_id = CAST(n_nationkey AS VARCHAR)
 LEFT JOIN (SELECT * FROM fig WHERE metric = 'operating_margin' AND status = 'CALCULATED') a ON a.company_id = CAST(n_nationkey AS VARCHAR) AND a.period = 'R12:' || strftime(lt.latest, '%Y-%m')
 LEFT JOIN (SELECT * FROM fig WHERE metric = 'operating_margin' AND status = 'CALCULATED') b ON b.company_id = CAST(n_nationkey AS VARCHAR) AND b.period = 'R12:' || strftime(lt.latest - INTERVAL 12 MONTH, '%Y-%m')))""",
        _FIN, MAT, _PS, O.periods_cte("rolling"), FIG,
    ),
}
_PARTS_OF = "CAST(count(*) AS VARCHAR) || '|' || CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR) || '|' || CAST(sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS VARCHAR)"
_QUOTED = ", ".join("('" + s.replace("'", "''") + "')" for s in _settings())
SQL |= {
    "source_fingerprint": O.query(
        """SELECT company_id, period, compare, sha256(n1 || '|' || a1 || '|' || b1 || '|' || n0 || '|' || a0 || '|' || b0 || '|' || coalesce(balances, '') || '|' || (SELECT told FROM se)) AS fingerprint FROM (
 SELECT x.company_id, x.period, x.compare, any_value(y.balances) AS balances,
  CAST(coalesce(sum(n) FILTER (h.month BETWEEN x.s AND x.e), 0) AS VARCHAR) AS n1, CAST(coalesce(sum(a) FILTER (h.month BETWEEN x.s AND x.e), 0) AS VARCHAR) AS a1, CAST(coalesce(sum(b) FILTER (h.month BETWEEN x.s AND x.e), 0) AS VARCHAR) AS b1,
  CAST(coalesce(sum(n) FILTER (h.month BETWEEN x.cs AND x.ce), 0) AS VARCHAR) AS n0, CAST(coalesce(sum(a) FILTER (h.month BETWEEN x.cs AND x.ce), 0) AS VARCHAR) AS a0, CAST(coalesce(sum(b) FILTER (h.month BETWEEN x.cs AND x.ce), 0) AS VARCHAR) AS b0
 FROM pair x LEFT JOIN vh h ON h.company_id = x.company_id AND h.month BETWEEN x.cs AND x.e LEFT JOIN yh y ON y.company_id = x.company_id GROUP BY x.company_id, x.period, x.compare)""",
        O.periods_cte("month", "quarter", "rolling"),
        """bq AS (SELECT vid, string_agg(account || '|' || amount || '||' || status, chr(10) ORDER BY rn) AS body FROM r GROUP BY vid),
vh AS (SELECT company_id, month, count(*) AS n, sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS a, sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS b FROM (
 SELECT company_id, CAST(date_trunc('month', vdate) AS DATE) AS month, sha256(series || '|' || number || '|' || strftime(vdate, '%Y-%m-%d') || '|' || trim(text) || chr(10) || body) AS h FROM v JOIN bq USING (vid)) GROUP BY 1, 2),
f1 AS (SELECT DISTINCT company_id, CAST(date_trunc('year', lo) AS DATE) AS fy_start FROM fy),
yb AS (SELECT company_id, fy_start, account, CAST(amount AS BIGINT) AS amount FROM f1, ib0
 UNION ALL SELECT company_id, DATE '2025-01-01', account, CAST(sum(amount) AS BIGINT) FROM (SELECT f.company_id, i.account, CAST(i.amount AS BIGINT) AS amount FROM f1 f, ib0 i UNION ALL SELECT company_id, 1510, CAST(50000 AS BIGINT) FROM f1
  UNION ALL SELECT company_id, CASE WHEN account < 3000 THEN account ELSE 2099 END, amount FROM mm WHERE month < DATE '2025-01-01') WHERE CAST(company_id AS INTEGER) % 6 = 1 GROUP BY company_id, account),
yh AS (SELECT company_id, """ + _PARTS_OF + """ AS balances FROM (SELECT company_id, sha256(strftime(fy_start, '%Y-%m-%d') || '|IB|' || account || '|' || amount) AS h FROM yb) GROUP BY company_id),
se AS (SELECT """ + _PARTS_OF + f""" AS told FROM (SELECT sha256(s) AS h FROM (VALUES {_QUOTED}) t(s)))""",
    ),
    "portfolio_counters": f"""SELECT count(*) FILTER (list_contains(r, 'missing_data')) AS missing_data, count(*) FILTER (open_high > 0) AS high_findings, count(*) FILTER (list_contains(r, 'changed_after_approval')) AS changed_after_approval,
 count(*) FILTER (list_contains(r, 'connection_error')) AS connection_errors, CAST(sum(CAST(company_id AS INTEGER) % 4) AS BIGINT) AS unanswered_questions, count(*) FILTER (list_contains(r, 'margin_drop')) AS margin_drops
 FROM (SELECT *, string_split(reasons, ',') AS r FROM ({SQL['portfolio']}))""",
    "approval_snapshot": O.query(
        """SELECT c.company_id, strftime(c.month, '%Y-%m') AS period, s.fp AS fingerprint, s.rule_code, s.status, q.fy_seqs
 FROM cov c JOIN pst p ON p.company_id = c.company_id AND p.period = strftime(c.month, '%Y-%m') AND NOT (p.n_high > 0 OR p.prel)
 LEFT JOIN (SELECT *, unnest(seen) AS per FROM rec) s ON s.company_id = c.company_id AND s.per = strftime(c.month, '%Y-%m')
 LEFT JOIN (SELECT company_id, string_agg(strftime(fy, '%Y-%m-%d') || '=' || seq, ',' ORDER BY fy) AS fy_seqs FROM (SELECT company_id, CAST(date_trunc('year', vdate) AS DATE) AS fy, max(coalesce(valid_to, valid_from)) AS seq FROM ver GROUP BY 1, 2) GROUP BY 1) q ON q.company_id = c.company_id
 WHERE c.covered""",
        _FIN, MAT, _PS, VER,
    ),
    "findings_listing": O.query(f"SELECT company_id, fp AS fingerprint, rule_code, severity, period, status FROM rec WHERE status IN {_OPENS} AND (period = '2025-06' OR list_contains(seen, '2025-06'))", _FIN),
}
