"""Voucher versions (SCD-2), snapshots, diffs, affected months and review selection.

``versions``: company_id, fy_start, series, number, voucher_date, content_hash, valid_from, valid_to,
where an open version has no ``valid_to``. An import states which fiscal years it covers and, for a
partial file, which date range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["company_id", "fy_start", "series", "number"]
COLUMNS = [*KEY, "voucher_date", "content_hash", "valid_from", "valid_to"]


def voucher_key() -> Column:
    """The number of a voucher; an empty one is replaced by a key made of the content hash."""
    return F.when(F.coalesce("number", F.lit("")) == "", F.concat(F.lit("h:"), F.substring("content_hash", 1, 16))).otherwise(F.col("number"))


def keyed(incoming: DataFrame) -> DataFrame:
    """Vouchers with their key (``voucher_key``).

    The last voucher of a file wins when a key repeats (``ord``: position in the file).
    """
    rows = incoming.withColumn("number", voucher_key())
    order = "ord" if "ord" in incoming.columns else "content_hash"
    return rows.groupBy(*KEY).agg(F.max_by(F.struct("voucher_date", "content_hash"), order).alias("v")).select(*KEY, "v.voucher_date", "v.content_hash")


def classify(versions: DataFrame, incoming: DataFrame, scope: DataFrame) -> DataFrame:
    """Action per voucher key: unchanged, changed, added, removed or kept.

    ``scope``: company_id, fy_start, lo, hi of the import; vouchers outside [lo, hi] that a file
    does not contain are kept, inside they count as removed.
    """
    span = scope.select("company_id", "fy_start", "lo", "hi")
    current = (
        versions.where("valid_to IS NULL")
        .join(span, ["company_id", "fy_start"])
        .select(*KEY, F.col("voucher_date").alias("old_date"), F.col("content_hash").alias("old_hash"), "valid_from", "lo", "hi")
    )
    new = keyed(incoming).select(*KEY, F.col("voucher_date").alias("new_date"), F.col("content_hash").alias("new_hash"))
    j = current.join(new, KEY, "full_outer")
    action = (
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("new_hash").isNull(), F.when(F.col("old_date").between(F.col("lo"), F.col("hi")), "removed").otherwise("kept"))
        .when(F.col("old_hash") == F.col("new_hash"), "unchanged")
        .otherwise("changed")
    )
    return j.withColumn("action", action).select(*KEY, "old_date", "old_hash", "new_date", "new_hash", "valid_from", "action")


def merge(versions: DataFrame, actions: DataFrame, scope: DataFrame, seq: int | Column) -> DataFrame:
    """The version table after an import: closed and new versions, everything else as it was.

    ``seq``: the import's sequence, or a column of ``actions`` that holds that of each company.
    """
    at = seq if isinstance(seq, Column) else F.lit(seq)
    untouched = versions.where("valid_to IS NOT NULL").unionByName(
        versions.where("valid_to IS NULL").join(scope.select("company_id", "fy_start"), ["company_id", "fy_start"], "left_anti")
    )
    none = F.lit(None).cast("int")
    still = actions.where("action IN ('unchanged', 'kept')").select(
        *KEY, F.col("old_date").alias("voucher_date"), F.col("old_hash").alias("content_hash"), "valid_from", none.alias("valid_to")
    )
    closed = actions.where("action IN ('changed', 'removed')").select(
        *KEY, F.col("old_date").alias("voucher_date"), F.col("old_hash").alias("content_hash"), "valid_from", at.alias("valid_to")
    )
    opened = actions.where("action IN ('changed', 'added')").select(
        *KEY, F.col("new_date").alias("voucher_date"), F.col("new_hash").alias("content_hash"), at.alias("valid_from"), none.alias("valid_to")
    )
    return untouched.select(*COLUMNS).unionByName(still).unionByName(closed).unionByName(opened)


def import_stats(actions: DataFrame) -> DataFrame:
    return actions.groupBy("company_id", "fy_start", "action").agg(F.count("*").alias("n"))


def affected_months(actions: DataFrame) -> DataFrame:
    """Months an import touches: the old and the new month of every real change."""
    real = actions.where("action IN ('added', 'changed', 'removed')")
    months = real.select(
        "company_id",
        F.explode(
            F.array_distinct(
                F.array_compact(
                    F.array(
                        F.when(F.col("action") != "added", F.trunc("old_date", "MM")),
                        F.when(F.col("action") != "removed", F.trunc("new_date", "MM")),
                    )
                )
            )
        ).alias("month"),
    )
    return months.distinct()


def snapshot(versions: DataFrame, seq: int) -> DataFrame:
    """Vouchers valid at an import sequence."""
    return versions.where((F.col("valid_from") <= seq) & (F.col("valid_to").isNull() | (F.col("valid_to") > seq)))


def changes(versions: DataFrame, from_seq: int, to_seq: int, windows: DataFrame | None = None) -> DataFrame:
    """ADDED / REMOVED / CHANGED vouchers between two sequences.

    Only versions opened or closed in between can differ, so both snapshots are cut down to those
    before the join. ``windows``: company_id, month — keep vouchers whose old or new date is there.
    """
    moved = (F.col("valid_from") > from_seq) | (F.col("valid_to") <= to_seq)
    side = lambda seq, d, h: snapshot(versions, seq).where(moved).select(*KEY, F.col("voucher_date").alias(d), F.col("content_hash").alias(h))
    j = side(from_seq, "old_date", "old_hash").join(side(to_seq, "new_date", "new_hash"), KEY, "full_outer")
    kind = (
        F.when(F.col("old_hash").isNull(), "ADDED").when(F.col("new_hash").isNull(), "REMOVED").when(F.col("old_hash") != F.col("new_hash"), "CHANGED")
    )
    out = j.withColumn("kind", kind).where("kind IS NOT NULL")
    if windows is None:
        return out
    months = F.array_distinct(F.array_compact(F.array(F.trunc("old_date", "MM"), F.trunc("new_date", "MM"))))
    return out.withColumn("month", F.explode(months)).join(windows.select("company_id", "month"), ["company_id", "month"], "left_semi")


def changed_months(changed: DataFrame) -> DataFrame:
    """Input of the changed-after-approval control: number of changes per month, and a checksum of them all.

    The checksum does not depend on order; it differs as soon as any voucher or kind of change does.
    The vouchers themselves stay rows, in ``changed``.
    """
    digest = F.md5(F.concat_ws("|", "series", "number", "kind").cast("binary"))
    part = F.conv(F.substring(digest, 1, 14), 16, 10).cast("decimal(38,0)")
    return changed.groupBy("company_id", "month").agg(F.count("*").alias("n"), F.sum(part).cast("string").alias("change_key"))


def carry_forward(incoming: DataFrame, previous: DataFrame, scope: DataFrame) -> DataFrame:
    """Year amounts of a partial import: IB and budget of the previous import where it has none.

    ``incoming``/``previous``: company_id, fy_start, kind, month, account, amount. UB, RES and
    period balances are dropped, since they are recomputed from the vouchers.
    """
    keep = incoming.where("kind IN ('IB', 'PBUDGET')").join(scope.select("company_id", "fy_start"), ["company_id", "fy_start"], "left_semi")
    has = keep.select("company_id", "fy_start", "kind").distinct()
    old = (
        previous.where("kind IN ('IB', 'PBUDGET')")
        .join(scope.select("company_id", "fy_start"), ["company_id", "fy_start"], "left_semi")
        .join(has, ["company_id", "fy_start", "kind"], "left_anti")
    )
    return keep.unionByName(old)


def merge_coverage(previous: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union of covered months per fiscal year; NULL (a whole year) stays whole."""
    p = previous.select("company_id", "fy_start", F.col("covered_months").alias("old"), F.lit(True).alias("has_old"))
    n = incoming.select("company_id", "fy_start", F.col("covered_months").alias("new"))
    j = n.join(p, ["company_id", "fy_start"], "left")
    union = F.array_sort(F.array_union(F.coalesce("old", F.array().cast("array<date>")), F.coalesce("new", F.array().cast("array<date>"))))
    return j.select(
        "company_id", "fy_start", F.when(F.col("has_old") & F.col("old").isNull(), F.lit(None)).otherwise(union).alias("covered_months")
    )


def file_precedence(files: DataFrame) -> DataFrame:
    """Which file counts for each day of a fiscal year: (company_id, fy_start, lo, hi, file), joined to whole stretches.

    ``files``: company_id, fy_start, file, ord (rises with age rank: the newest is the largest), kind (``full``,
    ``partial`` or ``summary``), lo, hi. The newest file with vouchers that covers a day counts, so a full export
    replaces the year and a partial one only its own days; a summary counts only where the year has no vouchers.
    A sweep over the starts and ends of a year's files gives the stretches in which the covering files do not change.
    """
    key = ["company_id", "fy_start"]
    booked = files.groupBy(*key).agg(F.max(F.col("kind") != "summary").alias("booked"))
    counted = files.join(booked, key).where("kind <> 'summary' OR NOT booked").where("lo <= hi")
    cuts = counted.select(*key, F.explode(F.array("lo", F.date_add("hi", 1))).alias("cut")).distinct()
    order = Window.partitionBy(*key).orderBy("cut")
    spans = cuts.withColumn("next", F.lead("cut").over(order)).where("next IS NOT NULL")
    live = spans.join(counted.select(*key, "file", "ord", "lo", "hi"), key).where("lo <= cut AND hi >= cut")
    best = live.groupBy(*key, "cut", "next").agg(F.max_by("file", F.struct("ord", "file")).alias("file"))
    starts = (F.lag("next").over(order).eqNullSafe(F.col("cut")) & F.lag("file").over(order).eqNullSafe(F.col("file"))).cast("int")
    runs = best.withColumn("starts", 1 - starts).withColumn("run", F.sum("starts").over(order))
    return runs.groupBy(*key, "run").agg(F.min("cut").alias("lo"), F.date_sub(F.max("next"), 1).alias("hi"), F.first("file").alias("file")).drop("run")


def latest_imports(runs: DataFrame) -> DataFrame:
    """The import that counts per fiscal year: voucher imports before summaries, then the newest."""
    w = Window.partitionBy("company_id", "fy_start").orderBy(F.desc("has_vouchers"), F.desc("seq"))
    return runs.where("status = 'COMPLETE'").withColumn("rk", F.row_number().over(w)).where("rk = 1").drop("rk")


def import_history(runs: DataFrame, files: DataFrame) -> DataFrame:
    return runs.join(files, ["company_id", "source_file_id"], "left").orderBy("company_id", F.desc("seq"))


def next_sequences(runs: DataFrame, new_files: DataFrame) -> DataFrame:
    """Running import sequence per company for a batch of new files, in arrival order."""
    last = runs.groupBy("company_id").agg(F.max("seq").alias("last"))
    w = Window.partitionBy("company_id").orderBy("arrived_at", "source_file_id")
    return (
        new_files.withColumn("n", F.row_number().over(w))
        .join(last, "company_id", "left")
        .withColumn("seq", F.coalesce("last", F.lit(0)) + F.col("n"))
        .drop("last", "n")
    )


def periods_to_review(coverage: DataFrame, latest: DataFrame, approved: DataFrame, changed: DataFrame) -> DataFrame:
    """The three latest months plus changed ones, if booked by vouchers and not approved."""
    recent = latest.where("latest_month IS NOT NULL").select(
        "company_id", F.explode(F.expr("sequence(add_months(latest_month, -2), latest_month, interval 1 month)")).alias("month")
    )
    wanted = recent.union(changed.select("company_id", "month")).distinct()
    booked = coverage.where("source = 'vouchers'").select("company_id", "month")
    return wanted.join(booked, ["company_id", "month"], "left_semi").join(approved.select("company_id", "month"), ["company_id", "month"], "left_anti")


#: Hexadecimal digits of the two numbers that a row's digest gives.
_DIGITS = 15


def _multiset(rows: DataFrame, digest: str, *keys: str) -> DataFrame:
    """Count and two sums of the rows' digests by ``keys``.

    Sums do not depend on order, and rows are taken out of a sum by subtracting them.
    """
    part = lambda at: F.sum(F.conv(F.substring(digest, at, _DIGITS), 16, 10).cast("decimal(38,0)"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), part(1).alias("a"), part(1 + _DIGITS).alias("b"))


def voucher_parts(hashes: DataFrame) -> DataFrame:
    """(company_id, month, n, a, b): fingerprints of the vouchers (company_id, month, content_hash) of a month."""
    return _multiset(hashes, "content_hash", "company_id", "month")


def updated_parts(parts: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The fingerprints after an import, from those before it and the vouchers that it added and removed."""
    gone = voucher_parts(removed).select("company_id", "month", *[(-F.col(c)).alias(c) for c in ("n", "a", "b")])
    summed = parts.unionByName(voucher_parts(added)).unionByName(gone).groupBy("company_id", "month")
    return summed.agg(*[F.sum(c).cast(t).alias(c) for c, t in (("n", "bigint"), ("a", "decimal(38,0)"), ("b", "decimal(38,0)"))]).where("n <> 0")


def source_fingerprint(pairs: DataFrame, parts: DataFrame, year_balances: DataFrame, settings: list[str]) -> DataFrame:
    """Fingerprint of all that the comparison of two periods rests on.

    That is the vouchers of both periods' months (``voucher_parts``), the company's year balances and
    ``settings``: mapping, rates and rules, one text each. ``pairs``: company_id, period, compare, start, end, c_start, c_end.
    """
    spark = pairs.sparkSession
    span = lambda side, a, b: pairs.select("company_id", "period", "compare", F.lit(side).alias("side"), F.explode(F.expr(f"sequence(trunc({a}, 'MM'), trunc({b}, 'MM'), interval 1 month)")).alias("month"))
    months = span("now", "start", "end").unionByName(span("then", "c_start", "c_end")).join(parts, ["company_id", "month"], "left").na.fill(0, ["n"])
    total = lambda side, c: F.coalesce(F.sum(F.when(F.col("side") == side, F.col(c))), F.lit(0)).cast("decimal(38,0)").cast("string")
    sides = months.groupBy("company_id", "period", "compare").agg(*[total(side, c).alias(f"{side}_{c}") for side in ("now", "then") for c in ("n", "a", "b")])
    spelled = year_balances.select("company_id", F.sha2(F.concat_ws("|", "fy_start", "kind", "account", "amount"), 256).alias("digest"))
    balances = _multiset(spelled, "digest", "company_id").select("company_id", F.concat_ws("|", "n", F.col("a").cast("string"), F.col("b").cast("string")).alias("balances"))
    told = _multiset(spark.createDataFrame([(s,) for s in settings], "s string").select(F.sha2("s", 256).alias("digest")), "digest")
    told = told.select(F.concat_ws("|", "n", F.col("a").cast("string"), F.col("b").cast("string")).alias("told")).first()[0]  # one row
    text = F.concat_ws("|", *[f"{side}_{c}" for side in ("now", "then") for c in ("n", "a", "b")], F.coalesce("balances", F.lit("")), F.lit(told))
    return sides.join(balances, "company_id", "left").select("company_id", "period", "compare", F.sha2(text, 256).alias("fingerprint"))
