"""What a viewer may see: payroll masking, restricted findings, assignments, client-safe audience."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.ranges import PAYROLL_MASKED


def mask_payroll(movements: DataFrame) -> DataFrame:
    """Payroll accounts folded into one row per month, so totals stay right."""
    row = F.when(PAYROLL_MASKED.on(F.col("account")), "masked").otherwise(F.col("account").cast("string"))
    return movements.groupBy("company_id", "month", row.alias("row")).agg(F.sum("amount").alias("amount"))


def mask_rows(postings: DataFrame) -> DataFrame:
    """Ledger rows without the payroll rows."""
    return postings.where(~PAYROLL_MASKED.on(F.col("account")))


def visible_findings(findings: DataFrame, *, aml: bool, assignments: DataFrame | None = None) -> DataFrame:
    """Findings a role may see: restricted signals only with the AML role, only assigned companies."""
    out = findings if aml else findings.where("visibility <> 'RESTRICTED_AML'")
    return out if assignments is None else out.join(assignments.select("company_id").distinct(), "company_id", "left_semi")


def client_safe(items: DataFrame, hidden_accounts: list[int] | None = None) -> DataFrame:
    """Items that may go to the client: no findings, nothing on hidden accounts."""
    out = items.where("audience = 'client'")
    if hidden_accounts:
        out = out.where(~F.arrays_overlap("accounts", F.array(*[F.lit(a) for a in hidden_accounts])))
    return out
