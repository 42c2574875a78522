"""Findings over time: reconciliation, suppression, decisions, precision, memory, approval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.counterparty import decide as decide_key
from ledgerloom.functions.counterparty import read_text
from ledgerloom.functions.scalars import amount_bucket
from ledgerloom.operators.controls.base import description

# Status groups.
OPEN = ("NEW", "IN_PROGRESS", "ASK_CLIENT")
ACTIONED = ("RESOLVED", "ASK_CLIENT")
NOT_ACTIONED = ("ACCEPTED_OK", "SUPPRESSED")
SYSTEM = ("AUTO_CLOSED", "SUPPRESSED")
REMEMBERED = ("ACCEPTED_OK", "RESOLVED", "ASK_CLIENT")
GONE_NOTE = "Försvann ur bokföringen (troligen rättat)."


def match_suppressions(candidates: DataFrame, suppressions: DataFrame, today: str) -> DataFrame:
    """First matching mute rule per candidate; restricted signals are never muted.

    ``suppressions``: id, rule_code, reason, expires_at, company_id, accounts, text_contains,
    max_amount. The text is looked for in what the finding says (``description``). The join is on the rule; the
    remaining tests filter its few rules.
    """
    s = suppressions.where(F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(today).cast("date"))).select(
        "rule_code",
        F.col("id").alias("suppression_id"),
        "reason",
        F.col("company_id").alias("s_company"),
        F.col("accounts").alias("s_accounts"),
        F.lower("text_contains").alias("s_text"),
        "max_amount",
    )
    text = F.lower(description())
    hit = (
        (F.col("s_company").isNull() | (F.col("s_company") == F.col("company_id")))
        & (F.col("s_accounts").isNull() | (F.size("s_accounts") == 0) | F.arrays_overlap("s_accounts", "accounts"))
        & (F.col("s_text").isNull() | F.contains(text, F.col("s_text")))
        & (F.col("max_amount").isNull() | F.col("amount").isNull() | (F.abs("amount") <= F.col("max_amount")))
    )
    w = Window.partitionBy("company_id", "fingerprint").orderBy("suppression_id")
    return (
        candidates.where("visibility <> 'RESTRICTED_AML'")
        .join(s, "rule_code")
        .where(hit)
        .withColumn("rk", F.row_number().over(w))
        .where("rk = 1")
        .select("company_id", "fingerprint", "suppression_id", "reason")
    )


def reconcile(existing: DataFrame, candidates: DataFrame, reviewed: DataFrame, suppressions: DataFrame | None = None, today: str = "2030-01-01") -> DataFrame:
    """Finding records after a run over all reviewed company-months.

    ``existing``: company_id, fingerprint, rule_code, severity, visibility, status, period,
    vouchers, accounts, amount, seen_in_reviews. ``reviewed``: company_id, review. ``outcome`` says
    what happened: created, updated, reopened, auto_closed or untouched.
    """
    runs = reviewed.groupBy("company_id").agg(F.collect_set("review").alias("runs"))
    latest = F.struct("review", "severity", "period", "vouchers", "accounts", "amount", "variant")
    cand = (
        candidates.groupBy("company_id", "fingerprint", "rule_code", "visibility")
        .agg(F.collect_set("review").alias("produced"), F.max_by(latest, "review").alias("c"))
        .select("company_id", "fingerprint", F.col("rule_code").alias("c_rule"), F.col("visibility").alias("c_vis"), "produced", "c")
    )
    empty = F.array().cast("array<string>")
    # Mute rules meet the candidates before these meet the records: all three are laid out by company and fingerprint then.
    if suppressions is not None:
        flat = cand.select("company_id", "fingerprint", F.col("c_rule").alias("rule_code"), F.col("c_vis").alias("visibility"), "c.vouchers", "c.accounts", "c.amount", "c.variant")
        cand = cand.join(match_suppressions(flat, suppressions, today), ["company_id", "fingerprint"], "left")
    else:
        cand = cand.withColumn("suppression_id", F.lit(None).cast("string")).withColumn("reason", F.lit(None).cast("string"))
    j = existing.join(cand, ["company_id", "fingerprint"], "full_outer").join(runs, "company_id", "left")
    is_new, hit = F.col("rule_code").isNull(), F.col("produced").isNotNull()
    left_over = F.array_except(F.coalesce("seen_in_reviews", empty), F.coalesce("runs", empty))
    seen = F.array_sort(F.array_union(left_over, F.coalesce("produced", empty)))
    dropped = ~hit & F.arrays_overlap(F.coalesce("seen_in_reviews", empty), F.coalesce("runs", empty))
    gone = dropped & (F.size(seen) == 0) & F.col("status").isin(*OPEN)
    reopened = hit & ~is_new & (F.col("status") == "AUTO_CLOSED")
    status = (
        F.when(is_new, F.when(F.col("suppression_id").isNotNull(), "SUPPRESSED").otherwise("NEW"))
        .when(gone, "AUTO_CLOSED")
        .when(reopened, "NEW")
        .otherwise(F.col("status"))
    )
    note = (
        F.when(is_new & F.col("suppression_id").isNotNull(), F.concat(F.lit("Undertryckt: "), "reason"))
        .when(gone, GONE_NOTE)
        .when(~reopened & ~is_new, F.col("resolution_note") if "resolution_note" in existing.columns else F.lit(None))
    )
    outcome = (
        F.when(is_new, "created").when(reopened, "reopened").when(hit, "updated").when(gone, "auto_closed").otherwise("untouched")
    )
    pick = lambda c: F.when(hit, F.col("c." + c)).otherwise(F.col(c))
    return j.select(
        "company_id",
        "fingerprint",
        F.coalesce("rule_code", "c_rule").alias("rule_code"),
        pick("severity").alias("severity"),
        F.coalesce("c_vis", "visibility").alias("visibility"),
        status.alias("status"),
        pick("period").alias("period"),
        pick("vouchers").alias("vouchers"),
        pick("accounts").alias("accounts"),
        pick("amount").alias("amount"),
        seen.alias("seen_in_reviews"),
        note.alias("resolution_note"),
        outcome.alias("outcome"),
    )


def split_decisions(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid decisions and rejects: system statuses are not for users, OK needs a reason."""
    bad = F.col("status").isin(*SYSTEM) | ((F.col("status") == "ACCEPTED_OK") & (F.trim(F.coalesce("note", F.lit(""))) == ""))
    return decisions.where(~bad), decisions.where(bad)


def apply_decisions(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Records with the latest valid decision per finding."""
    valid, _ = split_decisions(decisions)
    last = valid.groupBy("company_id", "fingerprint").agg(F.max_by(F.struct("status", "note", "decided_by"), "decided_at").alias("d"))
    j = records.drop("resolved_by").join(last, ["company_id", "fingerprint"], "left")
    return j.select(
        *[c for c in records.columns if c not in ("status", "resolution_note", "resolved_by")],
        F.coalesce("d.status", "status").alias("status"),
        F.when(F.col("d").isNotNull(), F.col("d.note")).otherwise(F.col("resolution_note")).alias("resolution_note"),
        F.col("d.decided_by").alias("resolved_by"),
    )


def rule_precision(records: DataFrame) -> DataFrame:
    """Findings per rule: total, actioned, not actioned, open, and actioned share in 0.01 %."""
    n = lambda group: F.sum(F.when(F.col("status").isin(*group), 1).otherwise(0))
    agg = records.groupBy("rule_code").agg(
        F.count("*").alias("total"),
        F.sum(F.when(F.col("status").isin(*ACTIONED), 1).otherwise(0)).alias("actioned"),
        n(NOT_ACTIONED).alias("not_actioned"),
        F.sum(F.when(F.col("status").isin("NEW", "IN_PROGRESS"), 1).otherwise(0)).alias("open"),
    )
    return agg.withColumn("precision", F.expr("CASE WHEN actioned + not_actioned > 0 THEN actioned * 10000 div (actioned + not_actioned) END"))


def pattern_signatures(records: DataFrame, facts: DataFrame) -> DataFrame:
    """Exact and loose pattern signature per finding.

    The counterparty is read from the first of the finding's vouchers whose text names one.
    """
    listed = records.select("company_id", "fingerprint", F.posexplode("vouchers").alias("pos", "voucher"))
    wanted = listed.select("company_id", "voucher").distinct()
    texts = facts.select("company_id", "voucher", "text").join(wanted, ["company_id", "voucher"], "left_semi").groupBy("company_id", "voucher").agg(F.min("text").alias("text"))
    named = decide_key(read_text(listed.join(texts, ["company_id", "voucher"]), "text", "t_"), None, "t_").where("t_key <> ''")
    first = named.groupBy("company_id", "fingerprint").agg(F.min_by("t_key", "pos").alias("counterparty"))
    accs = F.array_join(F.transform(F.slice(F.array_sort(F.array_distinct("accounts")), 1, 4), lambda a: a.cast("string")), ",")
    loose = F.concat_ws("|", "rule_code", accs, F.coalesce("counterparty", F.lit("")))
    exact = F.concat_ws("|", loose, F.coalesce(amount_bucket(F.col("amount")).cast("string"), F.lit("None")))
    digest = lambda c: F.substring(F.sha2(c, 256), 1, 24)
    return records.join(first, ["company_id", "fingerprint"], "left").withColumn("signature_exact", digest(exact)).withColumn("signature_loose", digest(loose))


def remember(signed: DataFrame) -> DataFrame:
    """Resolutions worth remembering from decided findings (with author and reason)."""
    return signed.where(
        F.col("status").isin(*REMEMBERED) & F.col("resolved_by").isNotNull() & (F.coalesce("resolution_note", F.lit("")) != "")
    ).select(
        "company_id",
        "signature_exact",
        "signature_loose",
        "rule_code",
        F.col("status").alias("decision"),
        F.col("resolution_note").alias("rationale"),
        F.col("resolved_by").alias("decided_by"),
        F.col("resolved_at").alias("decided_at"),
        F.lit(None).cast("date").alias("valid_until"),
    )


def suggest(signed: DataFrame, resolutions: DataFrame, today: str) -> DataFrame:
    """Suggestion for open findings: the newest valid decision on the same pattern, exact before loose.

    Resolutions are reduced to one per signature before the joins.
    """
    day = F.lit(today).cast("date")
    valid = resolutions.where(F.col("valid_until").isNull() | (F.col("valid_until") >= day))
    best = lambda key, name: valid.groupBy("company_id", "rule_code", key).agg(
        F.max_by(F.struct("decision", "rationale", "decided_by", "decided_at"), F.struct("decided_at", "rationale", "decision")).alias(name)
    )
    j = (
        signed.where(F.col("status").isin(*OPEN))
        .join(best("signature_exact", "e"), ["company_id", "rule_code", "signature_exact"], "left")
        .join(best("signature_loose", "l"), ["company_id", "rule_code", "signature_loose"], "left")
        .withColumn("b", F.coalesce("e", "l"))
        .where("b IS NOT NULL")
    )
    return j.select("company_id", "fingerprint", "rule_code", F.when(F.col("e").isNotNull(), "exact").otherwise("similar").alias("confidence"), "b.decision", "b.rationale", "b.decided_by", "b.decided_at")


def period_status(records: DataFrame, maturity: DataFrame, approved: DataFrame | None = None) -> DataFrame:
    """PRELIMINARY, NEEDS_REVIEW or REVIEWED per company-month with data; approved months stay approved."""
    open_in = (
        records.where(F.col("status").isin(*OPEN))
        .select("company_id", F.explode("seen_in_reviews").alias("period"), "severity")
        .groupBy("company_id", "period")
        .agg(F.count("*").alias("n_open"), F.sum(F.when(F.col("severity") == "HIGH", 1).otherwise(0)).alias("n_high"))
    )
    m = maturity.where("status <> 'NO_DATA'").select("company_id", F.date_format("month", "yyyy-MM").alias("period"), F.col("status").alias("maturity"))
    j = m.join(open_in, ["company_id", "period"], "left").na.fill(0, ["n_open", "n_high"])
    status: Column = (
        F.when(F.col("maturity") == "PRELIMINARY", "PRELIMINARY").when(F.col("n_open") > 0, "NEEDS_REVIEW").otherwise("REVIEWED")
    )
    if approved is not None:
        a = approved.select("company_id", "period", F.lit(True).alias("ok"))
        j = j.join(a, ["company_id", "period"], "left")
        status = F.when(F.col("ok"), "APPROVED").otherwise(status)
    return j.select("company_id", "period", status.alias("status"), "n_open", "n_high", "maturity")


def approval_gate(status: DataFrame, requests: DataFrame) -> DataFrame:
    """Approval requests: blocked by open HIGH findings or a preliminary period unless overridden."""
    blocked = (F.col("n_high") > 0) | (F.col("maturity") == "PRELIMINARY")
    override = F.trim(F.coalesce("override_note", F.lit(""))) != ""
    return requests.join(status, ["company_id", "period"], "left").select(
        "company_id",
        "period",
        F.when(F.col("status").isNull(), "not_reviewed").when(blocked & ~override, "blocked").otherwise("approved").alias("result"),
        "n_high",
        "maturity",
    )


def approval_snapshot(approved: DataFrame, records: DataFrame, latest: DataFrame) -> DataFrame:
    """One row per approved period and finding, plus the import sequences the approval rests on."""
    seen = records.select("company_id", F.explode("seen_in_reviews").alias("period"), "fingerprint", "rule_code", "status")
    seqs = latest.groupBy("company_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("fy_start").cast("string"), "seq"))).alias("fy_seqs"))
    return approved.select("company_id", "period").join(seen, ["company_id", "period"], "left").join(seqs, "company_id", "left")


SEVERITY_RANK = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}


def severity_rank(col: str = "severity") -> Column:
    return F.when(F.col(col) == "HIGH", 3).when(F.col(col) == "MEDIUM", 2).otherwise(1)


def listing(records: DataFrame, *, status: list[str] | None = None, period: str | None = None) -> DataFrame:
    out = records
    if status:
        out = out.where(F.col("status").isin(*status))
    if period:
        out = out.where(F.array_contains("seen_in_reviews", period) | (F.col("period") == period))
    return out.orderBy(F.desc(severity_rank()), "company_id", "period", "fingerprint")
