"""Bulk ingest of SIE files as one job over a folder.

Lines are tokenised with one regular expression, vouchers are found by carrying the last opened
voucher forward over the chunks of a file (``scans``), and every record type is a filtered projection. Every
line ends as data or as an issue. ``read_folder`` reads files in splits of lines, whatever their size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import let, parse_amount, parse_day
from ledgerloom.session import stage
from ledgerloom.sources import scans
from ledgerloom.sources.files import read_lines, to_lines

TOKEN = r'\{(?:"(?:\\"|[^"])*"|[^}"])*\}|"(?:\\"|[^"])*"|[^\s{}"]+'
ITEM = r'"(?:\\"|[^"])*"|[^\s{}"]+'
ROW_LABELS = ("#TRANS", "#RTRANS", "#BTRANS")
# The labels of the format besides those of vouchers.
KNOWN_LABELS = (
    "#FLAGGA", "#PROGRAM", "#FORMAT", "#GEN", "#SIETYP", "#PROSA", "#FNR", "#ORGNR", "#FNAMN", "#FTYP", "#ADRESS", "#RAR", "#TAXAR", "#OMFATTN",
    "#KPTYP", "#VALUTA", "#KONTO", "#KTYP", "#SRU", "#ENHET", "#DIM", "#UNDERDIM", "#OBJEKT", "#IB", "#UB", "#OIB", "#OUB", "#RES", "#PSALDO",
    "#PBUDGET", "#KSUMMA", "#BKOD", "#TAXAR_", "#KONTAKT",
)


@dataclass
class SieTables:
    companies: DataFrame
    accounts: DataFrame
    fiscal_years: DataFrame
    year_balances: DataFrame
    period_amounts: DataFrame
    vouchers: DataFrame
    issues: DataFrame


def _unquote(token: Column) -> Column:
    inner = F.regexp_replace(token, r'^"|"$', "")
    return F.when(token.startswith('"'), F.replace(inner, F.lit('\\"'), F.lit('"'))).otherwise(token)


def _field(i: Column | int) -> Column:
    """Plain field of a record; NULL when missing or an object list."""
    token = F.get("tokens", F.lit(i) if isinstance(i, int) else i)
    return F.when(~token.startswith("{"), _unquote(token))


def records(lines: DataFrame) -> DataFrame:
    """Tokenised records of lines (file, line_no, line), with their label and the line of the voucher they belong to."""
    lines = lines.withColumn("line", F.trim("line")).where("line <> ''")
    tokens = F.regexp_extract_all("line", F.lit(TOKEN), F.lit(0))
    rec = lines.select(
        "file", "line_no", "line",
        F.when(F.col("line").startswith("#"), F.upper(F.get(tokens, F.lit(0)))).otherwise(F.when(F.col("line").isin("{", "}"), F.col("line"))).alias("label"),
    )
    # A voucher is open from #VER until its closing brace, or until any other record starts.
    event = F.when(F.col("label").isin(*ROW_LABELS, "{") | F.col("label").isNull(), F.lit(None)).otherwise(F.struct("label", "line_no"))
    out = scans.last_known(rec, event, "before", before=True)
    opened = lambda e: F.when(e["label"] == "#VER", e["line_no"])
    # Lines are cut into tokens only now, so that the scan writes and shuffles them once.
    return out.select(
        "file", "line_no", tokens.alias("tokens"), "label", opened(F.coalesce(event, "before")).alias("voucher_line"), opened(F.col("before")).alias("closes_line")
    )


def _objects(token: Column) -> Column:
    """``{1 "10" 6 "P1"}`` as (dim, obj) pairs."""
    items = F.transform(F.regexp_extract_all(token.substr(F.lit(2), F.length(token)), F.lit(ITEM), F.lit(0)), _unquote)
    none = F.expr("CAST(array() AS array<struct<dim:string,obj:string>>)")

    def pairs(x: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor(F.size(x) / 2).cast("int") - 1)
        return F.when(
            F.size(x) >= 2, F.transform(at, lambda i: F.struct(F.get(x, i * 2).alias("dim"), F.get(x, i * 2 + 1).alias("obj")))
        ).otherwise(none)

    return F.coalesce(let(items, pairs), none)


def _rows(rec: DataFrame) -> DataFrame:
    """Ledger rows; an added row followed by its equal plain row counts once."""
    has_list = F.coalesce(F.get("tokens", F.lit(2)).startswith("{"), F.lit(False))
    at = F.when(has_list, 3).otherwise(2)
    empty = F.expr("CAST(array() AS array<struct<dim:string,obj:string>>)")
    rows = rec.where(F.col("label").isin(*ROW_LABELS)).select(
        "file",
        "voucher_line",
        "line_no",
        "label",
        _field(1).try_cast("int").alias("account"),
        F.when(has_list, _objects(F.get("tokens", F.lit(2)))).otherwise(empty).alias("objects"),
        parse_amount(_field(at)).alias("amount"),
        parse_day(_field(at + 1)).alias("trans_date"),
        F.when(_field(at + 2) != "", _field(at + 2)).alias("text"),
        _field(at + 3).try_cast("decimal(18,4)").alias("quantity"),
    )
    w = Window.partitionBy("file", "voucher_line").orderBy("line_no")
    before = lambda c: F.lag(c).over(w)
    same_objects = (before("objects") == F.col("objects")) | (F.size(before("objects")) == 0) | (F.size("objects") == 0)
    repeat = (
        (F.col("label") == "#TRANS")
        & (before("label") == "#RTRANS")
        & (before("account") == F.col("account"))
        & (before("amount") == F.col("amount"))
        & same_objects
    )
    return rows.withColumn("repeat", F.coalesce(repeat, F.lit(False)))


def read_sie(files: DataFrame) -> SieTables:
    """``files``: file, content (see ``sources.files``)."""
    return parse_lines(to_lines(files))


def read_folder(spark: SparkSession, path: str) -> SieTables:
    """All files of a folder, read line by line in splits."""
    return parse_lines(stage(read_lines(spark, path), "sie_text"))


def parse_lines(lines: DataFrame) -> SieTables:
    """``lines``: file, line_no, line."""
    rec = stage(records(lines), "sie_records")
    first = lambda label, i=1: F.max_by(F.when(F.col("label") == label, _field(i)), F.when(F.col("label") == label, F.col("line_no")))
    head = rec.groupBy("file").agg(
        first("#FNAMN").alias("name"), first("#ORGNR").alias("org_number"), first("#VALUTA").alias("currency"), first("#SIETYP").alias("sie_type")
    )
    org = F.regexp_replace(F.coalesce("org_number", F.lit("")), r"\D", "")
    head = head.withColumn("company_id", F.when(org != "", org).otherwise(F.col("file"))).withColumn("sie_type", F.coalesce(F.col("sie_type").try_cast("int"), F.lit(4)))
    head = stage(head, "sie_heads")  # a row per file, whose size is known when vouchers are joined to it
    ident = head.select("file", "company_id", "sie_type")

    declared = rec.where("label = '#RAR'").select(
        "file", _field(1).try_cast("int").alias("year_no"), parse_day(_field(2)).alias("fy_start"), parse_day(_field(3)).alias("fy_end")
    ).where("fy_start IS NOT NULL AND fy_end IS NOT NULL")
    declared = stage(declared, "sie_declared")  # a row per year of a file
    rows = _rows(rec)
    good = rows.where("voucher_line IS NOT NULL AND account IS NOT NULL AND amount IS NOT NULL AND NOT repeat")
    status = F.when(F.col("label") == "#RTRANS", "added").when(F.col("label") == "#BTRANS", "removed").otherwise("normal")
    packed = good.groupBy("file", "voucher_line").agg(
        F.array_sort(
            F.collect_list(
                F.struct("line_no", "account", "amount", "trans_date", "text", "quantity", "objects", status.alias("status"))
            )
        ).alias("packed")
    )
    ver = rec.where("label = '#VER'").select(
        "file",
        F.col("line_no").alias("voucher_line"),
        F.coalesce(_field(1), F.lit("")).alias("series"),
        F.coalesce(_field(2), F.lit("")).alias("number"),
        parse_day(_field(3)).alias("voucher_date"),
        F.coalesce(_field(4), F.lit("")).alias("text"),
        parse_day(_field(5)).alias("reg_date"),
        _field(6).alias("signature"),
    )
    no_rows = F.expr("CAST(array() AS array<struct<line_no:int,account:int,amount:bigint,trans_date:date,text:string,quantity:decimal(18,4),objects:array<struct<dim:string,obj:string>>,status:string>>)")
    dated = ver.where("voucher_date IS NOT NULL").join(packed, ["file", "voucher_line"], "left")
    body = F.transform(
        F.coalesce("packed", no_rows),
        lambda r: F.struct(
            r["account"].alias("account"),
            r["amount"].alias("amount"),
            r["trans_date"].alias("trans_date"),
            r["text"].alias("text"),
            r["quantity"].alias("quantity"),
            r["objects"].alias("objects"),
            r["status"].alias("status"),
            r["line_no"].alias("source_line"),
        ),
    )
    # A file without #RAR 0 gets a year assumed from its voucher dates; only the vouchers of such files are looked at.
    undeclared = stage(head.select("file").join(declared.where("year_no = 0"), "file", "left_anti"), "sie_undeclared")
    assumed = (
        ver.join(undeclared, "file", "left_semi")
        .where("voucher_date IS NOT NULL")
        .groupBy("file")
        .agg(F.trunc(F.min("voucher_date"), "year").alias("fy_start"), F.expr("date_sub(add_months(trunc(max(voucher_date), 'year'), 12), 1)").alias("fy_end"))
        .select("file", F.lit(0).alias("year_no"), "fy_start", "fy_end")
    )
    years = stage(declared.unionByName(assumed), "sie_years")
    zero = years.where("year_no = 0").select("file", "fy_start", "fy_end")
    vouchers = (
        dated.join(ident, "file")
        .join(zero, "file")
        .select(
            "company_id", "file", "fy_start", "fy_end", "series", "number", "voucher_date", "reg_date", "text", "signature",
            F.col("voucher_line").alias("source_line"), body.alias("rows"),
        )
    )
    fiscal_years = (
        years.join(ident, "file")
        .select(
            "company_id", "file", "year_no", "fy_start", "fy_end",
            ((F.col("year_no") == 0) & (F.col("sie_type") >= 4)).alias("has_vouchers"),
            F.lit("missing").alias("opening_status"),
            F.lit(None).cast("array<date>").alias("covered_months"),
        )
    )
    keyed = years.select("file", "year_no", "fy_start").join(ident, "file")
    balances = (
        rec.where("label IN ('#IB', '#UB', '#RES')")
        .select("file", F.substring("label", 2, 3).alias("kind"), F.coalesce(_field(1).try_cast("int"), F.lit(0)).alias("year_no"), _field(2).try_cast("int").alias("account"), parse_amount(_field(3)).alias("amount"), "line_no")
        .where("account IS NOT NULL AND amount IS NOT NULL")
        .groupBy("file", "kind", "year_no", "account")
        .agg(F.max_by("amount", "line_no").alias("amount"))
        .join(keyed, ["file", "year_no"])
        .select("company_id", "file", "fy_start", "kind", "account", "amount")
    )
    listed = F.coalesce(F.get("tokens", F.lit(4)).startswith("{"), F.lit(False))
    no_objects = ~listed | (F.size(_objects(F.get("tokens", F.lit(4)))) == 0)
    periods = (
        rec.where("label IN ('#PSALDO', '#PBUDGET')")
        .where(no_objects)
        .select(
            "file",
            F.regexp_replace("label", "#", "").alias("kind"),
            F.coalesce(_field(1).try_cast("int"), F.lit(0)).alias("year_no"),
            F.try_to_date(F.concat(_field(2), F.lit("01")), "yyyyMMdd").alias("month"),
            _field(3).try_cast("int").alias("account"),
            parse_amount(_field(F.when(listed, 5).otherwise(4))).alias("amount"),
            "line_no",
        )
        .where("month IS NOT NULL AND account IS NOT NULL AND amount IS NOT NULL")
        .groupBy("file", "kind", "year_no", "month", "account")
        .agg(F.max_by("amount", "line_no").alias("amount"))
        .join(keyed, ["file", "year_no"])
        .select("company_id", "file", "fy_start", "kind", "month", "account", "amount")
    )
    chart = rec.where("label IN ('#KONTO', '#KTYP', '#SRU')").select("file", "label", _field(1).try_cast("int").alias("account"), _field(2).alias("value"), "line_no").where("account IS NOT NULL")
    latest = lambda label: F.max_by(F.when(F.col("label") == label, F.col("value")), F.when(F.col("label") == label, F.col("line_no")))
    accounts = (
        chart.groupBy("file", "account")
        .agg(latest("#KONTO").alias("name"), F.upper(latest("#KTYP")).alias("type"), latest("#SRU").alias("sru"))
        .join(ident, "file")
        .select("company_id", "file", "account", F.coalesce("name", F.concat(F.lit("Konto "), F.col("account").cast("string"))).alias("name"), F.when(F.col("type").isin("T", "S", "K", "I"), F.col("type")).alias("type"), "sru")
    )
    return SieTables(
        head.select("company_id", "file", "name", "org_number", F.coalesce("currency", F.lit("SEK")).alias("currency"), "sie_type"),
        accounts,
        fiscal_years,
        balances,
        periods,
        vouchers,
        _issues(rec, rows, dated, vouchers, chart, declared),
    )


def _brace_issues(rec: DataFrame) -> DataFrame:
    """Braces outside vouchers, and vouchers that another record or the end of the file cuts off."""
    braces = rec.where("label = '{'").select("file", "voucher_line", "line_no")
    inside = braces.where("voucher_line IS NOT NULL")
    firsts = inside.groupBy("file", "voucher_line").agg(F.min("line_no").alias("first"))
    stray = braces.where("voucher_line IS NULL").select("file", "line_no")
    stray = stray.unionByName(inside.join(firsts, ["file", "voucher_line"]).where("line_no > first").select("file", "line_no"))
    stray = stray.unionByName(rec.where("label = '}' AND closes_line IS NULL").select("file", "line_no"))
    started = firsts.select("file", "voucher_line")
    cut = rec.where("closes_line IS NOT NULL AND label IS NOT NULL AND label <> '{' AND label <> '}'").where(~F.col("label").isin(*ROW_LABELS))
    cut = cut.select("file", F.col("closes_line").alias("voucher_line"), "line_no").join(started, ["file", "voucher_line"], "left_semi")
    ended = rec.where("closes_line IS NOT NULL AND label IS NOT NULL AND label <> '{'").where(~F.col("label").isin(*ROW_LABELS))
    ended = ended.select("file", F.col("closes_line").alias("line_no"))
    never = rec.where("label = '#VER'").select("file", "line_no").join(ended, ["file", "line_no"], "left_anti")
    named = lambda df, code: df.select("file", "line_no", F.lit(code).alias("code"))
    return named(stray, "UNEXPECTED_BRACE").unionByName(named(cut, "UNCLOSED_VOUCHER")).unionByName(named(never, "UNCLOSED_VOUCHER"))


def _issues(rec: DataFrame, rows: DataFrame, dated: DataFrame, vouchers: DataFrame, chart: DataFrame, declared: DataFrame) -> DataFrame:
    def issue(df: DataFrame, code: str, line: str = "line_no") -> DataFrame:
        return df.select("file", F.col(line).alias("line_no"), F.lit(code).alias("code"))

    number = lambda i: _field(i).try_cast("int")
    balance_bad = F.col("label").isin("#IB", "#UB", "#RES") & (number(2).isNull() | parse_amount(_field(3)).isNull())
    listed = F.coalesce(F.get("tokens", F.lit(4)).startswith("{"), F.lit(False))
    month = F.try_to_date(F.concat(_field(2), F.lit("01")), "yyyyMMdd")
    period_bad = F.col("label").isin("#PSALDO", "#PBUDGET") & (month.isNull() | number(3).isNull() | parse_amount(_field(F.when(listed, 5).otherwise(4))).isNull())
    chart_bad = F.col("label").isin("#KONTO", "#KTYP", "#SRU") & number(1).isNull()
    year_bad = (F.col("label") == "#RAR") & (number(1).isNull() | parse_day(_field(2)).isNull() | parse_day(_field(3)).isNull())
    voucher_bad = (F.col("label") == "#VER") & parse_day(_field(3)).isNull()
    unread = rec.where(balance_bad | period_bad | chart_bad | year_bad | voucher_bad)
    placed = rows.join(dated.select("file", "voucher_line"), ["file", "voucher_line"], "left_semi")
    orphans = rows.join(dated.select("file", "voucher_line"), ["file", "voucher_line"], "left_anti")
    balance = F.aggregate(F.filter("rows", lambda r: r["status"] != "removed"), F.lit(0).cast("bigint"), lambda a, r: a + r["amount"])
    named = chart.where("label = '#KONTO'").select("file", "account")
    unknown = rows.join(named, ["file", "account"], "left_anti").where("account IS NOT NULL").groupBy("file", "account").agg(F.min("line_no").alias("line_no"))
    odd = rec.where(F.col("label").startswith("#") & ~F.col("label").isin(*KNOWN_LABELS, *ROW_LABELS, "#VER"))
    files = rec.select("file").distinct()
    no_year = files.join(declared.where("year_no = 0"), "file", "left_anti").withColumn("line_no", F.lit(None).cast("int"))
    return (
        issue(rec.where("label IS NULL"), "NOT_A_RECORD")
        .unionByName(issue(orphans, "ORPHAN_TRANS"))
        .unionByName(issue(placed.where("account IS NULL OR amount IS NULL"), "INVALID_RECORD"))
        .unionByName(issue(unread, "INVALID_RECORD"))
        .unionByName(issue(odd.groupBy("file", "label").agg(F.min("line_no").alias("line_no")), "UNKNOWN_LABEL"))
        .unionByName(issue(no_year, "MISSING_RAR"))
        .unionByName(_brace_issues(rec))
        .unionByName(issue(unknown, "UNKNOWN_ACCOUNT"))
        .unionByName(issue(vouchers.where(balance != 0), "UNBALANCED_VOUCHER", "source_line"))
        .unionByName(issue(vouchers.where("NOT voucher_date BETWEEN fy_start AND fy_end"), "VOUCHER_OUTSIDE_YEAR", "source_line"))
    )


def merge_years(fiscal_years: DataFrame) -> DataFrame:
    """The file that counts per company and year: voucher years before summaries, then the newest file.

    ``file_order``: rises with the file's age rank; the newest file has the largest.
    """
    w = Window.partitionBy("company_id", "fy_start").orderBy(F.desc("has_vouchers"), F.desc("file_order"), F.desc("file"))
    return fiscal_years.withColumn("rk", F.row_number().over(w)).where("rk = 1").drop("rk")


def replace_range(vouchers: DataFrame, partial: DataFrame, scope: DataFrame) -> DataFrame:
    """A partial export replaces the vouchers inside its date range and keeps the others."""
    span = scope.select("company_id", "fy_start", "lo", "hi")
    j = vouchers.join(span, ["company_id", "fy_start"], "left")
    kept = j.where(F.col("lo").isNull() | ~F.col("voucher_date").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")
    return kept.unionByName(partial, allowMissingColumns=True)
