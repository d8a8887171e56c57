"""Descriptors to merchant keys and display names. Column expressions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .amounts import let, trimmed
from .reference import BRAND_ALIASES, CITIES, STATES

# Who moved the money, before an asterisk; up to three in a row.
PROCESSORS = "SQ|SQC|TST|TOAST|PAYPAL|PP|PY|SP|IC|EB|WPY|CLOVER|LEVELUP|GOOGLE|GOOGLE PAY|APPLE PAY|VENMO|CASH APP|ZELLE"
# What kind of transaction it is; the first that fits goes.
TYPE_PREFIXES = [
    r"PURCHASE AUTHORIZED ON \d{1,2}/\d{1,2}\s*",
    r"RECURRING (?:PAYMENT|DEBIT CARD|TRANSFER)\s*",
    r"(?:PRE)?AUTHORIZED (?:PAYMENT|DEBIT|CREDIT)\s*",
    r"DEBIT CARD (?:PURCHASE|PAYMENT)\s*",
    r"CREDIT CARD (?:PURCHASE|PAYMENT)\s*",
    r"(?:POS|PIN) (?:DEBIT|PURCHASE|CREDIT)\s*",
    r"CHECK\s?CARD (?:PURCHASE|PAYMENT)?\s*",
    r"(?:ACH|EFT) (?:DEBIT|CREDIT|PAYMENT|WITHDRAWAL)\s*",
    r"ELECTRONIC (?:PAYMENT|WITHDRAWAL|DEPOSIT)\s*",
    r"ONLINE (?:PAYMENT|TRANSFER|PURCHASE)\s*",
    r"BILL\s?PAY(?:MENT)?\s*",
    r"(?:VISA|MASTERCARD|MC|AMEX|DISCOVER)\s+(?:PURCHASE|PAYMENT|DEBIT)\s*",
    r"MERCHANT PURCHASE\s*",
    r"POINT OF SALE (?:DEBIT|PURCHASE)\s*",
]
# Noise anywhere, each replaced by a space, in this order.
NOISE = [
    r"#\s*\d+",
    r"\bSTORE\s+\d+\b",
    r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b",
    r"\b(?:800|833|844|855|866|877|888)[-.\s]?\d{7}\b",
    r"\b\d{1,2}/\d{1,2}(?:/\d{2,4})?\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b[X*]{2,}\d+\b",
    r"\bWWW\.",
    r"\.(?:COM|NET|ORG|CO|IO|APP)\b",
    r"\b\d{4,}\b",
    r"\b(?=[A-Z0-9]*\d)(?=[A-Z0-9]*[A-Z])[A-Z0-9]{6,}\b",
]
# Words that end a descriptor and name no merchant.
FILLER = "USA?|US|INC|LLC|LTD|CO|CORP|COM|RECURRING|PAYMENT|PMT|PURCHASE|DEBIT|CREDIT|CARD|ONLINE|BILL"
# Words in lower case inside a display name.
MINOR_WORDS = ["OF", "THE", "AND", "AT", "IN", "ON", "FOR", "TO"]


#: Words of the longest city name that is looked up.
CITY_WORDS = 3


def without_location(text: Column, cities: Sequence[str] = CITIES) -> Column:
    """A state code at the end goes, and with it the longest known city of up to three words before it; the first word never goes.
    Words are looked up in sets, so the number of cities does not count."""
    named = {k: [c for c in cities if c.count(" ") == k - 1] for k in range(CITY_WORDS, 0, -1)}

    def kept(words: Column) -> Column:
        n = F.size(words)
        out = n - 1
        for k in range(1, CITY_WORDS + 1):  # the longest is asked for first
            city = F.array_join(F.slice(words, F.greatest(n - k, F.lit(1)), k), " ").isin(named[k]) if named[k] else F.lit(False)
            out = F.when((n > k + 1) & city, n - k - 1).otherwise(out)
        return F.array_join(F.slice(words, 1, F.when((n > 1) & F.element_at(words, -1).isin(STATES), out).otherwise(n)), " ")

    return let(F.split(text, " "), kept)


def clean_descriptor(raw: Column, cities: Sequence[str] = CITIES) -> Column:
    text = trimmed(F.upper(raw))
    text = trimmed(F.regexp_replace(text, rf"^(?:(?:{PROCESSORS})\s*\*+\s*){{1,3}}", ""))
    text = trimmed(F.regexp_replace(text, f"^(?:{'|'.join(TYPE_PREFIXES)})", ""))
    for pattern in NOISE:
        text = F.regexp_replace(text, pattern, " ")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    text = without_location(text, cities)
    text = F.trim(F.regexp_replace(text, "[^A-Z0-9]+", " "))
    return F.trim(F.regexp_replace(text, rf"(?:\s+(?:{FILLER}))+$", ""))


def normalise_merchant(raw: Column, aliases: Mapping[str, str] = BRAND_ALIASES, cities: Sequence[str] = CITIES) -> Column:
    """The stable key: upper case, letters and digits, never blank. Null for null."""
    cleaned = clean_descriptor(raw, cities)
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(aliases.items())])
    plain = F.trim(F.regexp_replace(F.upper(raw), "[^A-Z0-9]+", " "))
    key = F.coalesce(F.try_element_at(known, cleaned), F.nullif(cleaned, F.lit("")), F.nullif(plain, F.lit("")), F.lit("UNKNOWN"))
    return F.when(raw.isNotNull(), key)


def display_name_of_key(key: Column) -> Column:
    def word(w: Column, i: Column) -> Column:
        minor = w.isin(MINOR_WORDS)
        short = (F.length(w) <= 3) & w.rlike("^[A-Z0-9]*$") & ~minor
        return F.when(short, w).when((i > 0) & minor, F.lower(w)).otherwise(F.concat(F.substring(w, 1, 1), F.lower(F.substring(w, 2, 1 << 20))))

    return F.array_join(F.transform(F.filter(F.split(key, " "), lambda w: w != ""), word), " ")


def merchant_display_name(raw: Column, **options) -> Column:
    return display_name_of_key(normalise_merchant(raw, **options))


def with_merchant_key(df: DataFrame, raw: str = "raw_description", into: str = "merchant_key", **options) -> DataFrame:
    """df with the key, computed once for each distinct descriptor: the normaliser is some twenty regular expressions, and a
    ledger holds far fewer descriptors than rows. The join is AQE's to plan."""
    name = "_raw"
    while name in map(str.lower, df.columns):
        name += "_"
    keys = df.select(F.col(raw).alias(name)).distinct().withColumn(into, normalise_merchant(F.col(name), **options))
    return df.join(keys, F.col(raw).eqNullSafe(F.col(name)), "left").drop(name)
