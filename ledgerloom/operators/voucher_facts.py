"""Everything the controls need to know about a single voucher, in one shuffle-free projection.

The account of every row is mapped to a bit per account class; OR-ing the rows tells which classes
occur, AND-ing them which classes hold for all rows. The 13 voucher patterns are then bit tests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import ranges as R
from ledgerloom.functions.ranges import Accounts, accounts
from ledgerloom.operators.ledger import effective, signature

# The account classes the patterns are made of.
CLASSES: dict[str, Accounts] = {
    "vat": accounts((2610, 2659)),
    "wages": accounts((7000, 7399)),
    "payroll_debt": accounts((2710, 2739)),
    "money": accounts((1900, 1999)),
    "payroll_tax_only": accounts((7500, 7599), (2730, 2739), (2940, 2949)),
    "depreciation": accounts((7700, 7899)),
    "depreciation_only": accounts((7700, 7899), (1000, 1399)),
    "accrual": accounts((1700, 1799), (2900, 2999)),
    "result": accounts((3000, 8999)),
    "tax_account": accounts((1630, 1639)),
    "tax_account_only": accounts(
        (1630, 1639), (2500, 2799), (1900, 1999), (2650, 2659), (8400, 8499), (8300, 8399)
    ),
    "bank_fee_only": accounts(6570, 1930, 1920, 1940),
    "bank_fee": accounts(6570),
    "appropriation": accounts((8800, 8899)),
    "closing": accounts((8990, 8999)),
    "customers": accounts((1510, 1519)),
    "suppliers": accounts((2440, 2449)),
    "cost_or_asset": accounts((4000, 7999), (1100, 1499)),
    "revenue": accounts((3000, 3999)),
    "cash": R.CASH,
    "vat_12": R.OUTPUT_VAT_12,
    "aml_customer": R.REVENUE_OR_CUSTOMER,
    "aml_supplier": R.SUPPLIER_OR_COST,
    "input_vat": R.INPUT_VAT,
    "output_vat": R.OUTPUT_VAT,
    "sales": R.SALES,
    "bank": R.BANK,
}
_BIT = {name: 1 << i for i, name in enumerate(CLASSES)}
# The patterns that count as routine.
ROUTINE = (
    "vat_settlement",
    "payroll",
    "payroll_tax",
    "depreciation",
    "accrual",
    "tax_account",
    "bank_fee",
    "appropriation",
    "closing",
    "customer_payment",
    "supplier_payment",
)
NOT_DUPLICATE = ("vat_settlement", "payroll", "payroll_tax", "tax_account", "depreciation", "accrual")
NOT_AML_FLOW = ("customer_payment", "payroll", "tax_account")


def _holds(accs: Accounts, account: int) -> bool:
    inside = any(lo <= account <= hi for lo, hi in accs.ranges)
    return inside and not any(lo <= account <= hi for lo, hi in accs.exclude)


def class_mask(account: Column, classes: dict[str, Accounts]) -> Column:
    """Bit mask of the classes an account belongs to: one array lookup instead of many range tests."""
    bits = {name: 1 << i for i, name in enumerate(classes)}
    masks = [sum(bit for name, bit in bits.items() if _holds(classes[name], acc)) for acc in range(10_000)]
    table = F.expr(f"CAST(split('{','.join(map(str, masks))}', ',') AS ARRAY<INT>)")
    return F.when(account.between(0, 9999), table[account]).otherwise(0)


def patterns(any_mask: Column, all_mask: Column, n_accounts: Column) -> dict[str, Column]:
    """Pattern name → test, from the OR and AND masks of a voucher's rows."""

    def has(name: str) -> Column:
        return any_mask.bitwiseAND(_BIT[name]) != 0

    def only(name: str) -> Column:
        return all_mask.bitwiseAND(_BIT[name]) != 0

    return {
        "vat_settlement": only("vat"),
        "payroll": has("wages") & (has("payroll_debt") | has("money")),
        "payroll_tax": only("payroll_tax_only"),
        "depreciation": has("depreciation") & only("depreciation_only"),
        "accrual": has("accrual") & has("result") & ~has("money"),
        "tax_account": has("tax_account") & only("tax_account_only"),
        "bank_fee": has("bank_fee") & only("bank_fee_only"),
        "appropriation": has("appropriation"),
        "closing": has("closing"),
        "customer_payment": has("customers") & has("money") & (n_accounts <= 3),
        "supplier_payment": has("suppliers") & has("money") & (n_accounts <= 3),
        "supplier_invoice": has("suppliers") & has("cost_or_asset"),
        "customer_invoice": has("customers") & has("revenue"),
    }


def business_days(a: Column, b: Column) -> Column:
    """Weekdays in (a, b], by counting whole weeks from a Monday; 0 when b is not after a."""

    def upto(d: Column) -> Column:
        n = F.datediff(d, F.lit("1970-01-05").cast("date")) + 1
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))

    return F.greatest(upto(b) - upto(a), F.lit(0)).cast("int")


def content_hash(rows: Column | str = "rows") -> Column:
    """SHA-256 over the voucher header and one canonical line per row (removed rows included)."""
    r = F.col(rows) if isinstance(rows, str) else rows

    def line(x: Column) -> Column:
        return F.concat_ws("|", x["account"].cast("string"), x["amount"].cast("string"), F.coalesce(F.trim(x["text"]), F.lit("")), x["status"])

    head = F.concat_ws("|", "series", "number", F.col("voucher_date").cast("string"), F.trim(F.coalesce("text", F.lit(""))))
    return F.sha2(F.concat_ws("\n", head, F.array_join(F.transform(r, line), "\n")), 256)


def full_content_hash(rows: Column | str = "rows") -> Column:
    """As ``content_hash`` but over every row field of the complete row type (ingested ledgers)."""
    r = F.col(rows) if isinstance(rows, str) else rows

    def line(x: Column) -> Column:
        objects = F.array_join(F.transform(x["objects"], lambda o: F.concat_ws(":", o["dim"], o["obj"])), ",")
        return F.concat_ws(
            "|",
            x["account"].cast("string"),
            x["amount"].cast("string"),
            F.coalesce(x["trans_date"].cast("string"), F.lit("")),
            F.coalesce(F.trim(x["text"]), F.lit("")),
            F.coalesce(x["quantity"].cast("string"), F.lit("")),
            F.coalesce(objects, F.lit("")),
            x["status"],
        )

    head = F.concat_ws("|", "series", "number", F.col("voucher_date").cast("string"), F.trim(F.coalesce("text", F.lit(""))))
    return F.sha2(F.concat_ws("\n", head, F.array_join(F.transform(r, line), "\n")), 256)


def voucher_facts(vouchers: DataFrame, exempt: Accounts | None = None) -> DataFrame:
    """Derived columns per voucher; still one record per voucher, no shuffle."""
    return spelled_out(stored_facts(vouchers, exempt))


def stored_facts(vouchers: DataFrame, exempt: Accounts | None = None) -> DataFrame:
    """The facts worth storing: all but those that ``spelled_out`` derives from them.

    All sums, masks and the largest debit and credit row come from a single pass over the rows.
    """
    classes = {**CLASSES, "exempt": exempt or R.account_spec(["6300-6399", "6570", "7000-7699", "8400-8499"])}
    bit = {name: 1 << i for i, name in enumerate(classes)}
    rows = F.transform(
        effective(),
        lambda r: F.struct(
            r["account"].alias("account"), r["amount"].alias("amount"), class_mask(r["account"], classes).alias("mask")
        ),
    )
    long0 = F.lit(0).cast("bigint")
    start = F.struct(
        long0.alias("balance"),
        long0.alias("debit_total"),
        long0.alias("input_vat"),
        long0.alias("cost_base"),
        F.lit(True).alias("exempt_only"),
        long0.alias("output_vat"),
        long0.alias("sales_base"),
        long0.alias("vat_12"),
        long0.alias("bank"),
        F.lit(0).alias("any_mask"),
        F.lit(-1).alias("all_mask"),
        F.lit(None).cast("bigint").alias("hi"),
        F.lit(None).cast("int").alias("hi_account"),
        F.lit(None).cast("bigint").alias("lo"),
        F.lit(None).cast("int").alias("lo_account"),
    )

    def step(acc: Column, r: Column) -> Column:
        amount, mask = r["amount"], r["mask"]
        is_a = lambda name: mask.bitwiseAND(bit[name]) != 0
        add = lambda field, cond, x: (acc[field] + F.when(cond, x).otherwise(0)).alias(field)
        cost = is_a("cost_or_asset") & (amount > 0)
        higher = acc["hi"].isNull() | (amount > acc["hi"])
        lower = acc["lo"].isNull() | (amount < acc["lo"])
        return F.struct(
            (acc["balance"] + amount).alias("balance"),
            add("debit_total", amount > 0, amount),
            add("input_vat", is_a("input_vat"), amount),
            add("cost_base", cost, amount),
            (acc["exempt_only"] & (~cost | is_a("exempt"))).alias("exempt_only"),
            add("output_vat", is_a("output_vat"), -amount),
            add("sales_base", is_a("sales"), -amount),
            add("vat_12", is_a("vat_12"), -amount),
            add("bank", is_a("bank"), amount),
            acc["any_mask"].bitwiseOR(mask).alias("any_mask"),
            acc["all_mask"].bitwiseAND(mask).alias("all_mask"),
            F.when(higher, amount).otherwise(acc["hi"]).alias("hi"),
            F.when(higher, r["account"]).otherwise(acc["hi_account"]).alias("hi_account"),
            F.when(lower, amount).otherwise(acc["lo"]).alias("lo"),
            F.when(lower, r["account"]).otherwise(acc["lo_account"]).alias("lo_account"),
        )

    df = (
        vouchers.withColumn("eff", rows)
        .withColumn("accounts", F.array_sort(F.array_distinct(F.col("eff.account"))))
        .withColumn("a", F.aggregate("eff", start, step))
    )
    any_mask, all_mask = F.col("a.any_mask"), F.when(F.size("eff") > 0, F.col("a.all_mask")).otherwise(0)
    tags = patterns(any_mask, all_mask, F.size("accounts"))
    tag_array = F.array_compact(F.array(*[F.when(cond, name) for name, cond in tags.items()]))
    any_of = lambda names: reduce(lambda x, y: x | y, [tags[n] for n in names])
    paired = (F.col("a.hi") > 0) & (F.col("a.lo") < 0)
    bare = F.transform("eff", lambda r: F.struct(r["account"].alias("account"), r["amount"].alias("amount")))
    return df.select(
        "company_id",
        "fy_start",
        "series",
        "number",
        "voucher_date",
        "reg_date",
        "text",
        "a.balance",
        "a.debit_total",
        F.size("eff").alias("row_count"),
        "accounts",
        F.when(paired, F.col("a.hi_account")).alias("debit_account"),
        F.when(paired, F.col("a.lo_account")).alias("credit_account"),
        tag_array.alias("tags"),
        any_of(ROUTINE).alias("routine"),
        any_of(NOT_DUPLICATE).alias("not_duplicate"),
        any_of(NOT_AML_FLOW).alias("not_aml_flow"),
        *[
            (any_mask.bitwiseAND(bit[c]) != 0).alias("has_" + c)
            for c in ("cash", "customers", "suppliers", "vat_12", "aml_customer", "aml_supplier")
        ],
        "a.input_vat",
        "a.cost_base",
        "a.exempt_only",
        "a.output_vat",
        "a.sales_base",
        "a.vat_12",
        "a.bank",
        bare.alias("eff"),
    )


def spelled_out(facts: DataFrame) -> DataFrame:
    """Stored facts with names, months and hashes, which take much room and are computed only where they are read."""
    # With every account once the rows are the net amounts; otherwise they are netted per account.
    single = F.filter(F.array_sort("eff"), lambda s: s["amount"] != 0)
    net = F.when(F.size("accounts") == F.size("eff"), single).otherwise(signature(F.col("eff")))
    spelled = lambda sign: F.md5(
        F.array_join(F.transform(net, lambda x: F.concat_ws(":", x["account"].cast("string"), (x["amount"] * sign).cast("string"))), ";")
    )
    derived = {
        "voucher": (F.concat("series", "number"), "number"),
        "month": (F.trunc("voucher_date", "MM"), "reg_date"),
        "sig_hash": (spelled(1), "bank"),
        "neg_hash": (spelled(-1), "sig_hash"),
    }
    names = list(facts.columns)
    for name, (_, after) in derived.items():
        names.insert(names.index(after) + 1, name)
    return facts.select(*[derived[n][0].alias(n) if n in derived else n for n in names])
