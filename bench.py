"""Wall-clock of the headline queries; prints one JSON line.

The shared tables are built first: those of the ledger are timed as ``build_ledger``, others by name,
``build_candidates`` being the run of all controls. Every query then runs over them as it would over
stored tables. ``monthly_movements`` reads the raw tables directly.
"""

from __future__ import annotations

import json
import os
import sys
import time

from ledgerloom.plans import registry
from ledgerloom.plans.book import open_book
from ledgerloom.session import local_session

#: Stored tables in the order they are built. Those of the ledger are timed together as ``build_ledger``.
LEDGER = ("vouchers", "facts", "movements", "coverage", "basis", "openings", "balances", "monthly", "balance_wide", "spend")
STORED = (*LEDGER, "maturity", "quarter_spend", "versions", "candidates", "records")
HEADLINE = (
    "monthly_movements",
    "income_statement",
    "balance_sheet",
    "key_figures",
    "key_figure_change",
    "cost_tree",
    "budget_vs_actual",
    "result_bridge",
    "metric_explanations",
    "evidence_rows",
    "balance_at",
    "txn_search",
    "counterparty_spend",
    "spend_report",
    "level_shift",
    "exact_duplicates",
    "ctl_unbalanced",
    "ctl_input_vat",
    "ctl_number_gap",
    "ctl_duplicate_exact",
    "ctl_rapid_reversal",
    "ctl_cost_deviation",
    "ctl_aml_in_out",
    "maturity",
    "voucher_versions",
    "voucher_diff",
    "reconcile_findings",
    "cases",
    "differences",
    "portfolio",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cores, partitions=int(cores) if cores.isdigit() else 8, memory="16g")
    fns, times = registry.queries(), {}
    book = open_book(spark, sf_dir)
    for name in STORED:
        start = time.time()
        getattr(book, name)
        times[f"build_{name}"] = round(time.time() - start, 3)
        print(f"build_{name}: {times[f'build_{name}']}", file=sys.stderr, flush=True)
    times["build_ledger"] = round(sum(times.pop(f"build_{name}") for name in LEDGER), 3)
    for name in HEADLINE:
        t = time.time()
        fns[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_wall_clock", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
