"""Counterparty of a ledger row from its free text, as column expressions plus one alias lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Leading words that are not part of a name, legal and regional suffixes, words that
# name no counterparty, and text fragments that are noise.
PREFIXES = (
    "leverantörsfaktura",
    "leverantorsfaktura",
    "lev.faktura",
    "levfakt",
    "lev faktura",
    "faktura",
    "kundfaktura",
    "betalning",
    "inbetalning",
    "utbetalning",
    "kreditfaktura",
    "autogiro",
    "ag",
    "kortköp",
    "kortkop",
    "swish",
    "bg",
    "pg",
)
# Legal forms and places that say nothing about who a party is.
SUFFIXES = (
    "ab",
    "publ",
    "hb",
    "kb",
    "ek",
    "ltd",
    "limited",
    "inc",
    "gmbh",
    "as",
    "oy",
    "bv",
    "llc",
    "sverige",
    "sweden",
    "ireland",
    "nordic",
    "norden",
    "europe",
    "emea",
    "international",
)
# First words of texts that name no party.
GENERIC = (
    "diverse",
    "omforing",
    "justering",
    "korrigering",
    "lon",
    "bankavgifter",
    "ranta",
    "momsredovisning",
)
NOISE = r"\b(\d{3,}|\d{4}-\d{2}(-\d{2})?|nr|no|fakt|inv|ocr|ref|avg|period|\d{1,2}/\d{1,2})\b"
UNKNOWN = "okänd motpart"
# Latin letters with marks and the plain letters that they are read as.
_PLAIN_OF = {
    "a": "àáâãäåāăą", "c": "çćĉċč", "d": "ďđ", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥħ", "i": "ìíîïĩīĭįı", "j": "ĵ", "k": "ķ", "l": "ĺļľŀł",
    "n": "ñńņňŉ", "o": "òóôõöøōŏő", "r": "ŕŗř", "s": "śŝşšș", "t": "ţťŧț", "u": "ùúûüũūŭůűų", "w": "ŵ", "y": "ýÿŷ", "z": "źżž",
}
_ACCENTED = "".join(_PLAIN_OF.values())
_PLAIN = "".join(plain * len(marked) for plain, marked in _PLAIN_OF.items())


def prefix_pattern() -> str:
    longest_first = sorted(PREFIXES, key=len, reverse=True)
    return "^(?:" + "|".join(p.replace(".", r"\.") for p in longest_first) + ")[ :]"


def normalize_words(name: Column) -> Column:
    """Lower case words without accents, punctuation and legal suffixes."""
    folded = F.translate(F.lower(name), _ACCENTED, _PLAIN)
    words = F.split(F.trim(F.regexp_replace(folded, "[^a-z0-9 ]+", " ")), " +")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*SUFFIXES))


def normalize_key(name: Column) -> Column:
    return F.array_join(normalize_words(name), " ")


def cleaned(text: Column) -> Column:
    """Text without its leading kind word and without numbers, dates and reference words."""
    t = F.trim(text)
    pattern = "(?iu)" + prefix_pattern()
    stripped = F.regexp_replace(F.regexp_replace(t, pattern, ""), r"^[ :\-]+|[ :\-]+$", "")
    t = F.when(t.rlike(pattern), stripped).otherwise(t)
    t = F.regexp_replace(t, "(?U)" + NOISE, " ")
    return F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^[ \-:,.]+|[ \-:,.]+$", "")


def read_text(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Adds ``<prefix>full`` (normalised text) and ``<prefix>label`` (first three name words)."""
    c = cleaned(F.coalesce(F.col(text), F.lit("")))
    kept = F.filter(F.split(c, " "), lambda w: F.size(normalize_words(w)) > 0)
    label = F.when(F.size(kept) > 0, F.array_join(F.slice(kept, 1, 3), " ")).otherwise(c)
    return df.withColumn(prefix + "full", normalize_key(c)).withColumn(prefix + "label", label)


def decide(df: DataFrame, aliases: DataFrame | None, prefix: str) -> DataFrame:
    """Adds key, name, confidence and source from a normalised text.

    A confirmed alias of the whole text, its first two words or its first word wins (0.98; the
    company's own alias before the shared one). Generic words name nobody (0.1). Otherwise the
    first two words are the key (0.75 for up to three words, else 0.55).
    """
    full = F.col(prefix + "full")
    words = F.split(full, " ")
    two, one = F.array_join(F.slice(words, 1, 2), " "), words[0]
    canonical: Column = F.lit(None).cast("string")
    if aliases is not None:
        # One name per key, so that a look-up never repeats rows; of several the first in order counts.
        aliases = aliases.groupBy("company_id", "key").agg(F.min("canonical_name").alias("canonical_name"))
        hits = []
        for i, candidate in enumerate((full, two, one)):
            own = aliases.where("company_id IS NOT NULL").select(
                "company_id", F.col("key").alias(f"_k{i}"), F.col("canonical_name").alias(f"_own{i}")
            )
            shared = aliases.where("company_id IS NULL").select(
                F.col("key").alias(f"_k{i}"), F.col("canonical_name").alias(f"_all{i}")
            )
            df = (
                df.withColumn(f"_k{i}", candidate)
                .join(own, ["company_id", f"_k{i}"], "left")
                .join(shared, [f"_k{i}"], "left")
            )
            hits += [F.when(F.col(f"_k{i}") != "", F.coalesce(f"_own{i}", f"_all{i}"))]
        canonical = F.coalesce(*hits)
    df = df.withColumn("_alias", canonical)
    alias = F.col("_alias")
    empty, generic = full == "", one.isin(*GENERIC)
    named = alias.isNotNull()
    nobody = empty | generic
    out = (
        df.withColumn(prefix + "key", F.when(named, normalize_key(alias)).when(nobody, "").otherwise(two))
        .withColumn(prefix + "name", F.when(named, alias).when(nobody, "").otherwise(F.col(prefix + "label")))
        .withColumn(
            prefix + "confidence",
            F.when(named, 98).when(empty, 0).when(generic, 10).when(F.size(words) <= 3, 75).otherwise(55),
        )
        .withColumn(prefix + "source", F.when(named, "alias").when(nobody, "none").otherwise("heuristic"))
    )
    return out.drop("_alias", *[c for c in out.columns if c.startswith(("_k", "_own", "_all"))])


def counterparty(df: DataFrame, aliases: DataFrame | None, row: str = "r_", voucher: str = "v_") -> DataFrame:
    """Row text first, voucher text when the row names nobody; confidence is in hundredths."""
    df = decide(decide(df, aliases, row), aliases, voucher)
    use_row = F.col(row + "key") != ""
    pick = lambda c: F.when(use_row, F.col(row + c)).otherwise(F.col(voucher + c))
    return df.select(
        "*",
        F.when(pick("key") == "", UNKNOWN).otherwise(pick("key")).alias("cp_key"),
        F.when(pick("name") == "", "Okänd motpart").otherwise(pick("name")).alias("cp_name"),
        pick("confidence").alias("cp_confidence"),
        pick("source").alias("cp_source"),
    )
