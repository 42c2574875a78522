"""Pattern and trend controls: duplicates, manual postings, reversals, unusual pairs, deviations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import ranges as R
from ledgerloom.functions.scalars import let
from ledgerloom.functions.similarity import histogram, normalize_text, ratio_bound, text_ratio
from ledgerloom.operators import ledger as L
from ledgerloom.operators import periods as P
from ledgerloom.operators.controls.base import Context, control, finding
from ledgerloom.session import dealt, stage

_EPOCH = "1970-01-01"


def _day(col: str):
    return F.datediff(F.col(col), F.lit(_EPOCH).cast("date"))


def duplicate_rows(facts: DataFrame, min_amount: int) -> DataFrame:
    """Rows that can be booked twice: payables credited, or costs paid without a payable.

    One row per voucher, account and amount.
    """
    base = facts.where("NOT not_duplicate").select(
        "company_id", "voucher_date", "voucher", "text", "has_suppliers", F.explode("eff").alias("r")
    )
    a, x = F.col("r.account"), F.col("r.amount")
    payable = R.PAYABLES.on(a) & (x < 0) & (-x >= min_amount)
    cost = ~payable & R.COSTS.on(a) & (x >= min_amount) & ~F.col("has_suppliers")
    return base.where(payable | cost).select(
        "company_id", a.alias("account"), F.abs(x).alias("amount"), normalize_text(F.col("text")).alias("norm"), "voucher_date", "voucher"
    )


def exact_duplicates(facts: DataFrame, min_amount: int, max_days: int) -> DataFrame:
    """Vouchers with an earlier copy: same account, amount and text within ``max_days``.

    Copies are counted per day before anything else, so a group of any size is a handful of day
    rows. Every copy is then linked to one original: the first of its day, or, for that first one,
    the latest earlier day. ``n_pairs`` says how many pairs a copy's day closes, so no pair is lost
    although pairs are never listed. Rows are dealt out by account, amount and text once, for all of it.
    """
    keys = ["company_id", "account", "amount", "norm"]
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (*keys, "voucher_date")])  # as the join below asks for
    rows = stage(dealt(duplicate_rows(facts, min_amount).where(known), *keys).distinct(), "duplicate_rows", buckets=tuple(keys))
    days = rows.groupBy(*keys, "voucher_date").agg(F.count("*").alias("n"), F.min("voucher").alias("first"))
    w = Window.partitionBy(*keys).orderBy(_day("voucher_date"))
    prior = w.rangeBetween(-max_days, -1)
    days = (
        days.withColumn("n_prior", F.coalesce(F.sum("n").over(prior), F.lit(0)))
        .withColumn("prev_first", F.last("first").over(prior))
        .withColumn("prev_date", F.last("voucher_date").over(prior))
        .withColumn("n_pairs", F.expr("n * (n - 1) div 2 + n * n_prior"))
        .where("n_pairs > 0")
    )
    # A text's days, which the calendar bounds, go into one row: joined by the keys alone, no row is shuffled again.
    day = F.struct("voucher_date", F.struct("first", "prev_first", "prev_date", "n_pairs").alias("d"))
    calendar = days.groupBy(*keys).agg(F.map_from_entries(F.collect_list(day)).alias("days"))
    linked = rows.join(calendar, keys).withColumn("d", F.try_element_at("days", "voucher_date")).where("d IS NOT NULL")
    linked = linked.select(*keys, "voucher_date", "voucher", "d.*")
    is_first = F.col("voucher") == F.col("first")
    return (
        linked.withColumn("original", F.when(~is_first, F.col("first")).otherwise(F.col("prev_first")))
        .withColumn("days_apart", F.when(~is_first, 0).otherwise(F.datediff("voucher_date", "prev_date")))
        .where("original IS NOT NULL")
        .select(*keys, "voucher_date", "voucher", "original", "days_apart", "n_pairs", is_first.alias("is_first"))
    )


#: Windows of days in a date bucket of the similar texts.
_WINDOWS = 2
#: Texts of this length or more, whose frequent characters the similarity ratio leaves out, are always compared.
_JUNK_FROM = 200


def _with_length(rows: DataFrame) -> DataFrame:
    """Rows that have a text, with its length."""
    return rows.where(F.length("norm") > 0).withColumn("len", F.length("norm"))


def _text_groups(rows: DataFrame, *more: str) -> DataFrame:
    """One row per account, amount, day and text (``_with_length``), with its first voucher and the number of vouchers.

    ``more``: further columns, which follow from the text.
    """
    return rows.groupBy("company_id", "account", "amount", "len", *more, "norm", "voucher_date").agg(F.min("voucher").alias("voucher"), F.countDistinct("voucher").alias("n"))


def _similar_pairs(groups: DataFrame, max_days: int, min_ratio: float, counted: bool = False, measured: bool = True) -> DataFrame:
    """Pairs of (day, text) groups a before b of the same account and amount, with similar, not identical, texts.

    Groups are matched on equal keys only: account, amount and a date bucket. A group is in the bucket of its day and,
    near its end, in the next one too; a pair counts in the bucket of its later day, so both sides are one table,
    written in the layout of the join. With ``counted`` pairs of one ``family`` are left out. Unless ``measured``, texts whose
    common beginning or end alone makes them similar are not compared.
    """
    keys = ["company_id", "account", "amount"]
    width = _WINDOWS * (max_days + 1)
    bucket = lambda day: F.floor(day / width)
    rows = groups.withColumn("hist", histogram(F.col("norm"))).withColumn("day", _day("voucher_date"))
    rows = rows.withColumn("day_bucket", F.explode(F.array_distinct(F.array(bucket(F.col("day")), bucket(F.col("day") + max_days)))))
    rows = stage(dealt(rows, *keys, "day_bucket"), "similar_rows", buckets=(*keys, "day_bucket"))
    ids = ["norm", "voucher_date", "voucher", "n", "len", "hist", "day", *(["family"] if counted else [])]
    left, right = (rows.select(*keys, "day_bucket", *[F.col(c).alias(side + c) for c in ids]) for side in ("a_", "b_"))
    ordered = (F.col("b_voucher_date") > F.col("a_voucher_date")) | (
        (F.col("b_voucher_date") == F.col("a_voucher_date")) & (F.col("b_voucher") > F.col("a_voucher"))
    )
    ordered = ordered & (bucket(F.greatest("a_day", "b_day")) == F.col("day_bucket"))
    chars = F.col("a_len") + F.col("b_len")
    sure = F.lit(False)
    if counted:
        ordered = ordered & ~F.coalesce((F.col("a_len") == F.col("b_len")) & (F.col("a_family") == F.col("b_family")), F.lit(False))
    if not measured:
        part = F.ceil(F.lit(min_ratio) * chars / 2).cast("int")
        part = part + F.when(2.0 * part / chars < min_ratio, 1).otherwise(0)
        ends = (F.left("a_norm", part) == F.left("b_norm", part)) | (F.right("a_norm", part) == F.right("b_norm", part))
        sure = (part <= F.least("a_len", "b_len")) & (F.col("b_len") < _JUNK_FROM) & ends
    bound = ratio_bound(F.col("a_hist"), F.col("b_hist"), F.col("a_len"), F.col("b_len"))
    pairs = (
        left.join(right, [*keys, "day_bucket"])
        .where(ordered & (F.datediff("b_voucher_date", "a_voucher_date") <= max_days) & (F.col("a_norm") != F.col("b_norm")))
        .where(2 * F.least("a_len", "b_len") >= min_ratio * chars)
        .where(sure | (bound >= min_ratio - 1e-9))
    )
    compared = text_ratio("a_norm", "b_norm") if measured else text_ratio(F.when(~sure, F.col("a_norm")), F.when(~sure, F.col("b_norm")))
    return pairs.withColumn("ratio", compared).where(F.col("ratio") >= min_ratio)


def _family_groups(rows: DataFrame, min_ratio: float) -> DataFrame:
    """``_text_groups`` with ``family``: a beginning that makes all texts of one length with it similar, since a common
    beginning of p characters makes a ratio of 2p by all characters or more.

    Null where vouchers of a day share a number, so that their order is open, and for texts too long for this.
    ``begin`` is that beginning in any case; the rows are dealt out by it once, for groups and windows alike.
    """
    rows, chars = _with_length(rows), F.col("len")
    size = F.ceil(F.lit(min_ratio) * chars).cast("int")
    size = size + F.when(size / chars < min_ratio, 1).otherwise(0)
    begin = F.when((size <= chars) & (chars < _JUNK_FROM), F.left("norm", size))
    of = ["company_id", "account", "amount", "len", "begin"]
    begun = _text_groups(dealt(rows.withColumn("begin", begin), *of), "begin")
    again = F.lag("voucher").over(Window.partitionBy(*of).orderBy("voucher_date", "voucher")) == F.col("voucher")
    same_day = F.lag("voucher_date").over(Window.partitionBy(*of).orderBy("voucher_date", "voucher")) == F.col("voucher_date")
    begun = begun.withColumn("again", F.coalesce(again & same_day, F.lit(False)))
    unclear = F.max("again").over(Window.partitionBy(*of))
    return begun.withColumn("family", F.when(~unclear, F.col("begin"))).drop("again")


def _family_links(groups: DataFrame, max_days: int) -> DataFrame:
    """Links inside families, counted without listing them: the groups of the days before, less those of the same text."""
    keys = ["company_id", "account", "amount"]
    of = [*keys, "len", "begin"]  # with a family, that is its beginning
    this = F.struct("voucher_date", "voucher", "norm")
    days = Window.partitionBy(*of).orderBy(_day("voucher_date")).rangeBetween(-max_days, -1)
    in_order = Window.partitionBy(*of).orderBy("voucher_date", "voucher")
    today = Window.partitionBy(*of, "voucher_date").orderBy("voucher").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(*of, "norm").orderBy(_day("voucher_date")).rangeBetween(-max_days, -1)
    none = F.lit(0)
    before = F.lag(this).over(in_order)
    out = groups.where("family IS NOT NULL").withColumn("before", before)
    # behind a run of one text lies the latest group of another text
    out = out.withColumn("before", F.last(F.when(F.col("before.norm") != F.col("norm"), F.col("before")), ignorenulls=True).over(in_order))
    out = out.withColumn("n_links", F.count("*").over(days) + F.count("*").over(today) - F.count("*").over(same))
    total = lambda w: F.coalesce(F.sum("n").over(w), none)
    out = out.withColumn("n_earlier", total(days) + total(today) - total(same)).where("n_links > 0")
    return out.select(*keys, "voucher", "voucher_date", "n_links", (F.col("n_earlier") * F.col("n")).alias("n_pairs"), _latest("before.voucher_date", "before.voucher", "before.norm", "norm"))


def _latest(date: str, voucher: str, norm: str, own: str):
    return F.struct(F.col(date).alias("date"), F.col(voucher).alias("voucher"), F.col(norm).alias("norm"), F.col(own).alias("own")).alias("latest")


def similar_classes(facts: DataFrame, min_amount: int, max_days: int, min_ratio: float) -> DataFrame:
    """Vouchers with similar, not identical, texts of the same account and amount in the window before them.

    One row per (day, text) group, named by its first voucher: ``n_links`` counts its links to earlier groups,
    ``n_pairs`` the pairs of vouchers behind them, and the latest of these groups is named with its similarity.
    The links are counted, not listed, so what is written and shuffled grows with the groups; ``similar_links``
    lists them. The other vouchers of a group are exact copies of its first, which ``exact_duplicates`` links to it.
    """
    keys = ["company_id", "account", "amount"]
    groups = stage(_family_groups(duplicate_rows(facts, min_amount), min_ratio), "text_groups", buckets=(*keys, "len", "begin"))
    across = (
        _similar_pairs(groups, max_days, min_ratio, counted=True, measured=False)
        .groupBy(*keys, "day_bucket", "b_voucher", "b_voucher_date", "b_norm", "b_n")
        .agg(F.count("*").alias("n_links"), F.sum("a_n").alias("n_earlier"), F.max(_latest("a_voucher_date", "a_voucher", "a_norm", "b_norm")).alias("latest"))
        .select(*keys, F.col("b_voucher").alias("voucher"), F.col("b_voucher_date").alias("voucher_date"), "n_links", (F.col("n_earlier") * F.col("b_n")).alias("n_pairs"), "latest")
    )
    linked = (
        across.unionByName(_family_links(groups, max_days))
        .groupBy(*keys, "voucher", "voucher_date")
        .agg(F.sum("n_links").alias("n_links"), F.sum("n_pairs").alias("n_pairs"), F.max("latest").alias("latest"))
    )
    return linked.select(
        *keys,
        F.col("latest.voucher").alias("original"),
        "voucher",
        "voucher_date",
        F.datediff("voucher_date", "latest.date").alias("days_apart"),
        "n_links",
        "n_pairs",
        _hundredths(text_ratio("latest.norm", "latest.own"), F.length("latest.norm") + F.length("latest.own")).alias("similarity"),
    )


def _hundredths(ratio, chars):
    common = F.round(ratio * chars / 2).cast("long")  # the ratio is twice these by all characters
    return F.floor((400 * common + chars) / (2 * chars)) / 100  # half up


def similar_links(facts: DataFrame, min_amount: int, max_days: int, min_ratio: float, measured: bool = True) -> DataFrame:
    """Every link between vouchers of the same account and amount with similar, not identical, texts within the window.

    One row per pair of (day, text) groups, between the first vouchers of the two; ``n_pairs`` is the
    number of pairs of vouchers that the link stands for. The other vouchers of a group are exact copies
    of its first, which ``exact_duplicates`` links to it. The similarity is that of the texts if ``measured``, else left out.
    """
    similarity = [_hundredths(F.col("ratio"), F.col("a_len") + F.col("b_len")).alias("similarity")] if measured else []
    return _similar_pairs(_text_groups(_with_length(duplicate_rows(facts, min_amount))), max_days, min_ratio, measured=measured).select(
        "company_id",
        "account",
        "amount",
        F.col("a_voucher").alias("original"),
        F.col("b_voucher").alias("voucher"),
        F.col("b_voucher_date").alias("voucher_date"),
        F.datediff("b_voucher_date", "a_voucher_date").alias("days_apart"),
        (F.col("a_n") * F.col("b_n")).alias("n_pairs"),
        *similarity,
    )


@control("DUPLICATE_CANDIDATE")
def duplicate_candidate(ctx: Context) -> DataFrame:
    p = lambda n: ctx.param("DUPLICATE_CANDIDATE", n)
    pair = [F.least("original", "voucher"), F.greatest("original", "voucher")]
    common = {"review": F.col("voucher_date"), "key": pair, "vouchers": F.array("original", "voucher"), "accounts": F.array("account"), "amount": F.col("amount")}
    exact = finding(
        exact_duplicates(ctx.facts, p("min_amount"), p("max_days")), "DUPLICATE_CANDIDATE", severity=F.lit("HIGH"), variant=F.lit("exact"), **common
    )
    similar = finding(
        similar_links(ctx.facts, p("min_amount"), p("max_days"), p("min_text_similarity"), measured=False),
        "DUPLICATE_CANDIDATE",
        severity=F.lit("MEDIUM"),
        variant=F.lit("similar"),
        **common,
    )
    return exact.unionByName(similar)


@control("LARGE_MANUAL_POSTING")
def large_manual(ctx: Context) -> DataFrame:
    p = lambda n: ctx.param("LARGE_MANUAL_POSTING", n)
    settings = ctx.companies.select(
        "company_id",
        F.coalesce("manual_series", F.array(*[F.lit(s) for s in p("manual_series")])).alias("manual"),
        F.greatest(F.lit(p("min_amount")), F.col("materiality") * 5).alias("threshold"),
    )
    v = ctx.facts.where((F.datediff(F.last_day("voucher_date"), "voucher_date") <= p("days_before_end")) & ~F.col("routine"))
    hits = v.join(settings, "company_id").where(F.array_contains("manual", F.col("series")) & (F.col("debit_total") >= F.col("threshold")))
    return finding(
        hits,
        "LARGE_MANUAL_POSTING",
        review=F.col("month"),
        key=[F.col("voucher"), F.col("voucher_date")],
        vouchers=F.array("voucher"),
        accounts=F.col("accounts"),
        amount=F.col("debit_total"),
    )


@control("RAPID_REVERSAL")
def rapid_reversal(ctx: Context) -> DataFrame:
    """Vouchers that exactly negate one booked 1–7 days before (accruals excepted).

    A signature and its negation share one canonical hash. Signatures seen in one direction only
    are dropped first, by a short key of their hashes; what is left is written once, and matched day
    against day, never row by row.
    """
    p = lambda n: ctx.param("RAPID_REVERSAL", n)
    v = ctx.facts.where("row_count > 0").select(
        "company_id",
        "voucher_date",
        "voucher",
        F.unhex(F.least("sig_hash", "neg_hash")).alias("canon"),
        (F.col("sig_hash") < F.col("neg_hash")).alias("side"),
        "debit_total",
        "accounts",
        F.array_contains("tags", "accrual").alias("accrual"),
    )
    # Keys of two signatures may coincide: they keep more rows than needed, and the matching is by the whole hash.
    short = F.xxhash64("company_id", "canon").alias("short")
    both = stage(v.groupBy(short).agg(F.bit_or(F.when(F.col("side"), 1).otherwise(2)).alias("sides")).where("sides = 3").select("short"), "two_sided")
    v = stage(v.withColumn("short", short).join(both, "short", "left_semi").drop("short"), "reversal_rows")
    days = v.groupBy("company_id", "canon", "side", "voucher_date").agg(F.count("*").alias("n"), F.min("voucher").alias("first"))
    earlier = days.select("company_id", "canon", (~F.col("side")).alias("side"), F.col("voucher_date").alias("w_date"), F.col("n").alias("w_n"), "first")
    target = days.select("company_id", "canon", "side", "voucher_date", F.explode(F.sequence(F.lit(1), F.lit(p("max_days")))).alias("back")).withColumn(
        "w_date", F.expr("date_sub(voucher_date, back)")
    )
    matched = (
        target.join(earlier, ["company_id", "canon", "side", "w_date"])
        .groupBy("company_id", "canon", "side", "voucher_date")
        .agg(F.max_by("first", "w_date").alias("original"), F.sum("w_n").alias("n_originals"), F.max("w_date").alias("w_date"))
    )
    hits = (
        v.where((F.col("debit_total") >= p("min_amount")) & ~F.col("accrual"))
        .join(matched, ["company_id", "canon", "side", "voucher_date"])
        .where("voucher <> original")
    )
    return finding(
        hits,
        "RAPID_REVERSAL",
        review=F.col("voucher_date"),
        key=[F.least("original", "voucher"), F.greatest("original", "voucher")],
        vouchers=F.array("original", "voucher"),
        accounts=F.col("accounts"),
        amount=F.col("debit_total"),
        variant=F.concat(F.datediff("voucher_date", "w_date").cast("string"), F.lit("d/"), F.col("n_originals").cast("string")),
    )


@control("UNUSUAL_ACCOUNT_COMBINATION")
def unusual_pair(ctx: Context) -> DataFrame:
    """Debit/credit pairs whose first month is the review month, between accounts known before."""
    p = lambda n: ctx.param("UNUSUAL_ACCOUNT_COMBINATION", n)
    pair = ["company_id", "debit_account", "credit_account"]
    first_pair = ctx.facts.where("debit_account IS NOT NULL").groupBy(*pair).agg(F.min("month").alias("pair_month"))
    # An account's first booking month; zero-net months count too, so it comes from the vouchers.
    first_acc = (
        ctx.facts.select("company_id", "month", F.explode("accounts").alias("account")).groupBy("company_id", "account").agg(F.min("month").alias("acc_month"))
    )
    debit = first_acc.select("company_id", F.col("account").alias("debit_account"), F.col("acc_month").alias("d_month"))
    credit = first_acc.select("company_id", F.col("account").alias("credit_account"), F.col("acc_month").alias("c_month"))
    w = Window.partitionBy("company_id").orderBy("month")
    aged = ctx.coverage.where("covered").select("company_id", "month", (F.row_number().over(w) - 1).alias("n_before"))
    # Written, so that its size is known: a row per company and pair of accounts, against which no voucher needs to be shuffled.
    known = first_pair.join(debit, ["company_id", "debit_account"]).join(credit, ["company_id", "credit_account"]).where(
        "d_month < pair_month AND c_month < pair_month"
    )
    hits = (
        ctx.facts.where("debit_account IS NOT NULL AND NOT routine")
        .join(stage(known, "known_pairs"), pair)
        .where("month = pair_month")
        .join(aged, ["company_id", "month"])
        .where(F.col("n_before") >= p("min_history_months"))
        .join(ctx.companies.select("company_id", "materiality"), "company_id")
        .where(F.col("debit_total") >= F.greatest(F.lit(p("min_amount")), F.col("materiality")))
    )
    return finding(
        hits,
        "UNUSUAL_ACCOUNT_COMBINATION",
        review=F.col("month"),
        key=[F.col("voucher"), F.col("debit_account"), F.col("credit_account")],
        vouchers=F.array("voucher"),
        accounts=F.array("debit_account", "credit_account"),
        amount=F.col("debit_total"),
    )


def _middle2(values):
    """Twice the median of a sorted integer array."""
    n = F.size(values)
    return F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))


def _judge_cost(series, x, n_seen, n_hist, least):
    """Kind of deviation (or NULL), doubled median and doubled distance of a month's cost.

    Every intermediate value is bound once; the result is one struct per account and month.
    """

    def verdict(med2, mad4, dx2):
        far = F.when(mad4 > 0, dx2 * 20000 >= mad4 * 51891).otherwise((dx2 * 100 >= F.abs(med2) * 35) & (dx2 >= 700))
        kind = (
            F.when(n_seen == 0, F.when(x >= least, "new"))
            .when((x == 0) & (n_seen >= n_hist - 1) & (med2 >= 2 * least), "missing")
            .when((dx2 >= 2 * least) & far & ((med2 == 0) | (dx2 * 10 >= F.abs(med2) * 3)), "deviation")
        )
        return F.struct(kind.alias("kind"), med2.alias("med2"), dx2.alias("dx2"))

    def with_median(s, med2):
        spread = F.array_sort(F.transform(s, lambda v: F.abs(2 * v - med2)))
        return let(spread, lambda dev: let(_middle2(dev), lambda mad4: let(F.abs(2 * x - med2), lambda dx2: verdict(med2, mad4, dx2))))

    return let(series, lambda s: let(_middle2(s), lambda med2: with_median(s, med2)))


@control("COST_DEVIATION")
def cost_deviation(ctx: Context) -> DataFrame:
    """Month cost per account against up to twelve months with data: new, missing or far off.

    All statistics are integers: the doubled median, and deviations from it, so no rounding.
    """
    p = lambda n: ctx.param("COST_DEVIATION", n)
    cost = ctx.movements.where("account BETWEEN 4000 AND 7999")
    hist = L.history_months(ctx.coverage, 12)
    n_hist = hist.groupBy("company_id", "anchor").agg(F.count("*").alias("n_hist")).where(F.col("n_hist") >= p("min_history_months"))
    past = hist.join(cost, ["company_id", "month"]).groupBy("company_id", "anchor", "account").agg(F.collect_list("amount").alias("seen"))
    now = cost.select("company_id", F.col("month").alias("anchor"), "account", F.col("amount").alias("x"))
    skip = R.accounts((7290, 7299), (7700, 7899), (7510, 7599)).on(F.col("account"))
    low = ctx.maturity.select("company_id", F.col("month").alias("anchor"), "low_periodization")
    padded = F.array_sort(F.concat("seen", F.array_repeat(F.lit(0).cast("bigint"), (F.col("n_hist") - F.size("seen")).cast("int"))))
    j = (
        past.join(now, ["company_id", "anchor", "account"], "full_outer")
        .join(n_hist, ["company_id", "anchor"])
        .join(low, ["company_id", "anchor"])
        .where(~(skip & F.col("low_periodization")))
        .join(ctx.companies.select("company_id", "materiality"), "company_id")
        .withColumn("least", F.greatest(F.lit(p("min_amount")), F.col("materiality")))
        .withColumn("x", F.coalesce("x", F.lit(0)))
        .withColumn("seen", F.coalesce("seen", F.array().cast("array<bigint>")))
    )
    judged = _judge_cost(padded, F.col("x"), F.size("seen"), F.col("n_hist"), F.col("least"))
    hits = j.select(
        "company_id", "anchor", "account", "materiality", "x", F.explode(F.filter(F.array(judged), lambda c: c["kind"].isNotNull())).alias("c")
    ).select("company_id", "anchor", "account", "materiality", "x", "c.*")
    half = "CAST(sign({0}) AS BIGINT) * (abs({0}) div 2)"
    amount = (
        F.when(F.col("kind") == "new", F.col("x"))
        .when(F.col("kind") == "missing", F.expr(half.format("med2")))
        .otherwise(F.expr(half.format("(2 * x - med2)")))
    )
    return finding(
        hits,
        "COST_DEVIATION",
        review=F.col("anchor"),
        key=[F.col("account"), F.date_format("anchor", "yyyy-MM"), F.col("kind")],
        severity=F.when((F.col("kind") == "deviation") & (F.col("dx2") >= F.col("materiality") * 20), "MEDIUM").otherwise("LOW"),
        accounts=F.array("account"),
        amount=amount,
        variant=F.col("kind"),
    )


@control("REVENUE_COST_TREND")
def revenue_cost_trend(ctx: Context) -> DataFrame:
    """Rolling twelve months of sales and costs against the twelve before, both fully covered."""
    pct = ctx.param("REVENUE_COST_TREND", "threshold_pct")
    pairs = P.previous_period(P.standard_periods(ctx.coverage.where("covered"), ("rolling",)))
    a = F.col("account")
    flow = ctx.movements.groupBy("company_id", "month").agg(
        (-F.sum(F.when(R.SALES.on(a), F.col("amount")).otherwise(0))).alias("sales"),
        F.sum(F.when(R.COSTS.on(a), F.col("amount")).otherwise(0)).alias("costs"),
    )
    covered = ctx.coverage.where("covered").select("company_id", "month", F.lit(1).alias("has"))
    base = covered.join(flow, ["company_id", "month"], "left")

    def total(side: DataFrame, tag: str) -> DataFrame:
        return (
            P.period_months(side)
            .join(base, ["company_id", "month"])
            .groupBy("company_id", "period")
            .agg(F.sum("has").alias(tag + "n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(tag + c) for c in ("sales", "costs")])
            .where(F.col(tag + "n") == 12)
        )

    cur = total(pairs.select("company_id", "period", "start", "end"), "c_")
    prev = total(P.compare_side(pairs), "p_").withColumnRenamed("period", "compare")
    j = pairs.join(cur, ["company_id", "period"]).join(prev, ["company_id", "compare"])
    both = j.select(
        "company_id",
        F.trunc("end", "MM").alias("month"),
        F.expr(
            "inline(array(named_struct('label', 'Omsättning', 'cur', c_sales, 'prev', p_sales), "
            "named_struct('label', 'Kostnader', 'cur', c_costs, 'prev', p_costs)))"
        ),
    ).where((F.col("prev") > 0) & (F.abs(F.col("cur") - F.col("prev")).cast("decimal(38,0)") * 100 >= F.col("prev").cast("decimal(38,0)") * pct))
    return finding(
        both,
        "REVENUE_COST_TREND",
        review=F.col("month"),
        key=[F.col("label"), F.date_format("month", "yyyy-MM")],
        amount=F.col("cur"),
        variant=F.col("label"),
    )
