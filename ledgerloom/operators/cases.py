"""Grouping related findings into cases: connected components over shared hubs.

Pairs of findings are never listed. What relates findings — a voucher, a rule group in a period, an
account within a cause family — becomes a hub, and a hub connects its findings exactly when every
two of them would be connected through related pairs:

* same voucher: always (restricted signals only among themselves);
* same rule, company and period, for rules that describe one underlying error;
* same family, period and account (VAT and payroll: without account), when at least two different
  rules meet there — all pairs of different rules are related, which connects everyone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.findings import OPEN, severity_rank
from ledgerloom.session import stage

# Cause families, rules that group with themselves, and the order of action.
FAMILIES: dict[str, tuple[str, ...]] = {
    "duplicate": ("DUPLICATE_CANDIDATE", "COST_DEVIATION", "INPUT_VAT_RATIO", "UNUSUAL_ACCOUNT_COMBINATION"),
    "vat": ("VAT_ACCOUNTS_NOT_CLEARED", "INPUT_VAT_RATIO", "OUTPUT_VAT_RATIO", "TAX_ACCOUNT_BALANCE"),
    "payroll": ("PAYROLL_TAX_NOT_CLEARED", "EMPLOYER_CONTRIBUTION_RATIO", "TAX_ACCOUNT_BALANCE", "VACATION_LIABILITY_STATIC"),
    "related": ("RELATED_PARTY_RECEIVABLE", "LARGE_MANUAL_POSTING", "UNUSUAL_ACCOUNT_COMBINATION"),
    "cash": ("ABNORMAL_SIGN", "LATE_BOOKING", "NEGATIVE_BANK"),
    "integrity": ("UNBALANCED_VOUCHER", "VOUCHER_NUMBER_GAP", "IB_NE_PREV_UB", "ACCOUNT_NOT_IN_CHART"),
    "reversal": ("RAPID_REVERSAL", "UNUSUAL_ACCOUNT_COMBINATION", "LARGE_MANUAL_POSTING"),
    "closing": ("ASSETS_WITHOUT_DEPRECIATION", "VACATION_LIABILITY_STATIC", "TAX_ALLOCATION_RESERVE_DUE"),
}
PERIOD_FAMILIES = ("vat", "payroll")
SAME_RULE = ("IB_NE_PREV_UB", "VOUCHER_NUMBER_GAP", "PAYROLL_TAX_NOT_CLEARED")
ACTION_ORDER = (
    "DUPLICATE_CANDIDATE",
    "CHANGED_AFTER_APPROVAL",
    "UNBALANCED_VOUCHER",
    "RELATED_PARTY_RECEIVABLE",
    "OUTPUT_VAT_RATIO",
    "VAT_ACCOUNTS_NOT_CLEARED",
    "EMPLOYER_CONTRIBUTION_RATIO",
    "PAYROLL_TAX_NOT_CLEARED",
    "INPUT_VAT_RATIO",
    "LARGE_MANUAL_POSTING",
    "RAPID_REVERSAL",
    "ASSETS_WITHOUT_DEPRECIATION",
    "ABNORMAL_SIGN",
    "LATE_BOOKING",
)


def action_rank(rule: Column) -> Column:
    out = F.lit(len(ACTION_ORDER))
    for i, code in enumerate(ACTION_ORDER):
        out = F.when(rule == code, i).otherwise(out)
    return out


def hubs(findings: DataFrame) -> DataFrame:
    """(company_id, fingerprint, hub) for every hub that really connects findings."""
    aml = F.col("visibility") == "RESTRICTED_AML"
    f = findings.select("company_id", "fingerprint", "rule_code", "period", "vouchers", "accounts", aml.alias("aml"))
    by_voucher = f.select(
        "company_id", "fingerprint", "rule_code", F.explode("vouchers").alias("v"), "aml"
    ).select("company_id", "fingerprint", "rule_code", F.concat_ws("|", F.lit("v"), F.col("aml").cast("string"), "v").alias("hub"), F.lit(False).alias("mixed"))
    plain = f.where(~F.col("aml"))
    by_rule = plain.where(F.col("rule_code").isin(*SAME_RULE)).select(
        "company_id", "fingerprint", "rule_code", F.concat_ws("|", F.lit("r"), "rule_code", "period").alias("hub"), F.lit(False).alias("mixed")
    )
    member = F.array_compact(F.array(*[F.when(F.col("rule_code").isin(*rules), name) for name, rules in FAMILIES.items()]))
    fam = plain.withColumn("family", F.explode(member))
    with_account = fam.select(
        "company_id",
        "fingerprint",
        "rule_code",
        F.concat_ws("|", F.lit("f"), "family", "period").alias("base"),
        F.when(F.col("family").isin(*PERIOD_FAMILIES), F.array(F.lit(-1))).otherwise(F.col("accounts")).alias("accs"),
    )
    by_family = with_account.select(
        "company_id", "fingerprint", "rule_code", "base", F.explode("accs").alias("acc")
    ).select("company_id", "fingerprint", "rule_code", F.concat_ws("|", "base", F.col("acc").cast("string")).alias("hub"), F.lit(True).alias("mixed"))
    edges = by_voucher.unionByName(by_rule).unionByName(by_family)
    useful = (
        edges.groupBy("company_id", "hub")
        .agg(F.count("*").alias("n"), F.min("rule_code").alias("r1"), F.max("rule_code").alias("r2"), F.max("mixed").alias("mixed"))
        .where("n > 1 AND (NOT mixed OR r1 <> r2)")
        .select("company_id", "hub")
    )
    return edges.join(useful, ["company_id", "hub"], "left_semi").select("company_id", "fingerprint", "hub").distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Smallest fingerprint of each connected group, by min-label propagation with shortcuts.

    Each round spreads the smallest label over a hub and then jumps to the label's own label, so
    the rounds grow with the logarithm of the longest chain. Every round is a written table.
    """
    edges = stage(edges, "case_edges")
    key = ["company_id", "fingerprint"]
    labels = stage(edges.select(*key).distinct().withColumn("label", F.col("fingerprint")), "case_labels")
    for _ in range(max_rounds):
        hub_min = edges.join(labels, key).groupBy("company_id", "hub").agg(F.min("label").alias("label"))
        spread = edges.join(hub_min, ["company_id", "hub"]).groupBy(*key).agg(F.min("label").alias("near"))
        nxt = labels.join(spread, key).select(*key, "label", F.least("label", "near").alias("near"))
        jump = nxt.select("company_id", F.col("fingerprint").alias("near"), F.col("near").alias("far"))
        new = stage(
            nxt.join(jump, ["company_id", "near"], "left").select(*key, F.col("label").alias("old"), F.least("near", "far").alias("label")), "case_labels"
        )
        moved = new.where("old <> label").limit(1).count()
        labels = new.select(*key, "label")
        if not moved:
            return labels
    raise RuntimeError("components did not settle")


def build_cases(findings: DataFrame, include_closed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cases, members). A finding without relatives is a case of its own.

    Lead = highest severity, then action order, then fingerprint. The key depends on all members
    through a count and an order-independent checksum, so members are never gathered.
    """
    pool = findings if include_closed or "status" not in findings.columns else findings.where(F.col("status").isin(*OPEN))
    pool = stage(pool, "case_pool")
    labels = components(hubs(pool))
    members = pool.join(labels, ["company_id", "fingerprint"], "left").withColumn("component", F.coalesce("label", "fingerprint")).drop("label")
    rank = severity_rank()
    checksum = F.bit_xor(F.conv(F.substring("fingerprint", 1, 15), 16, 10).cast("bigint"))
    vis = F.max(F.when(F.col("visibility") == "RESTRICTED_AML", 2).when(F.col("visibility") == "INTERNAL", 1).otherwise(0))
    lead = F.min_by(
        F.struct("fingerprint", "rule_code", "period"), F.struct((-rank).alias("s"), action_rank(F.col("rule_code")).alias("a"), "fingerprint")
    )
    cases = (
        members.groupBy("company_id", "component")
        .agg(F.count("*").alias("n_findings"), checksum.alias("checksum"), F.max(rank).alias("sev"), vis.alias("vis"), lead.alias("lead"))
        .select(
            "company_id",
            "component",
            F.substring(F.sha2(F.concat_ws("|", "component", "n_findings", "checksum"), 256), 1, 24).alias("case_key"),
            "n_findings",
            F.col("lead.fingerprint").alias("lead"),
            F.col("lead.rule_code").alias("lead_rule"),
            F.col("lead.period").alias("period"),
            F.expr("element_at(array('LOW', 'MEDIUM', 'HIGH'), sev)").alias("severity"),
            F.expr("element_at(array('CLIENT_SAFE', 'INTERNAL', 'RESTRICTED_AML'), vis + 1)").alias("visibility"),
        )
    )
    return cases, members


def case_status(members: DataFrame) -> DataFrame:
    """OPEN, IN_PROGRESS, WAITING_CLIENT or CLOSED from the statuses of a case's findings."""
    has = lambda s: F.max(F.col("status") == s)
    return members.groupBy("company_id", "component").agg(
        F.when(has("NEW"), "OPEN").when(has("IN_PROGRESS"), "IN_PROGRESS").when(has("ASK_CLIENT"), "WAITING_CLIENT").otherwise("CLOSED").alias("status")
    )


def ordered(cases: DataFrame) -> DataFrame:
    return cases.orderBy(F.desc(severity_rank()), "period", "case_key")


def within_company(cases: DataFrame) -> DataFrame:
    w = Window.partitionBy("company_id").orderBy(F.desc(severity_rank()), "period", "case_key")
    return cases.withColumn("position", F.row_number().over(w))
