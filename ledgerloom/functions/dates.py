"""Dates as banks write them. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .amounts import let, trimmed

NUMERIC = r"^(\d{1,4})[/\-.](\d{1,2})[/\-.](\d{2,4})$"
# NUMERIC with up to three digits first, a number above 12 before one up to 12, and the other way round.
DAY_LEADS = r"^(?:0?(?:1[3-9]|[2-9]\d)|[1-9]\d{2})[/\-.](?:0?\d|1[0-2])[/\-.]\d{2,4}$"
MONTH_LEADS = r"^(?:0{0,2}\d|0?1[0-2])[/\-.](?:1[3-9]|[2-9]\d)[/\-.]\d{2,4}$"
# Formats of which the field order is sure, with the texts that they take.
PATTERNS = [
    ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"),
    ("yyyy/MM/dd", r"^\d{4}/\d{2}/\d{2}$"),
    ("yyyyMMdd", r"^\d{8}$"),
    ("dd-MMM-yyyy", r"^\d{2}-[A-Z][a-z]{2}-\d{4}$"),
    ("dd MMM yyyy", r"^\d{2} [A-Z][a-z]{2} \d{4}$"),
    ("MMM dd, yyyy", r"^[A-Z][a-z]{2} \d{2}, \d{4}$"),
    ("MMM d, yyyy", r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$"),
    ("d MMM yyyy", r"^\d{1,2} [A-Z][a-z]{2} \d{4}$"),
    ("MMMM d, yyyy", r"^[A-Z][a-z]{2,} \d{1,2}, \d{4}$"),
    ("dd-MMM-yy", r"^\d{2}-[A-Z][a-z]{2}-\d{2}$"),
]


#: Any of them: a text that is no date is told by one expression, not by one for each format.
_NAMED = "|".join(f"(?:{shape})" for _, shape in PATTERNS)


def expand_year(year: Column, digits: Column, pivot: int = 70) -> Column:
    """Two-digit years below the pivot are of the 2000s, others of the 1900s."""
    return F.when(digits >= 4, year).when(year < pivot, year + 2000).otherwise(year + 1900)


def valid_date(year: Column, month: Column, day: Column) -> Column:
    """Null where there is no such day."""
    return F.format_string("%04d-%02d-%02d", year, month, day).try_cast("date")


def parse_date(raw: Column, day_first: Column | bool = False, pivot: int = 70) -> Column:
    """The date of a text or null. A number above 12 overrides the stated order of day and month. Impossible days, such as
    20260231, are null in every format; a two-digit year after a month name is of the 2000s."""
    day_first = F.lit(day_first) if isinstance(day_first, bool) else day_first

    def from_parts(parts: Column) -> Column:
        a, b, c = (parts[i].try_cast("int") for i in range(3))
        year = expand_year(c, F.length(parts[2]), pivot)
        day_leads = F.when((a > 12) & (b <= 12), True).when((b > 12) & (a <= 12), False).otherwise(day_first)
        return F.when(F.length(parts[0]) == 4, valid_date(a, b, c)).when(day_leads, valid_date(year, b, a)).otherwise(valid_date(year, a, b))

    def whole(text: Column) -> Column:
        lead = F.substring_index(text, " ", 1)
        token = F.when(lead.contains("/") | lead.contains("-"), lead).otherwise(text)
        named = F.when(text.rlike(_NAMED), F.coalesce(*[F.when(text.rlike(shape), F.try_to_date(text, p)) for p, shape in PATTERNS]))
        numeric = lambda t: F.when(t.rlike(NUMERIC), let(F.array(*[F.regexp_extract(t, NUMERIC, i) for i in (1, 2, 3)]), from_parts))
        return F.when(text == "", None).when(token.rlike(NUMERIC), let(token, numeric)).otherwise(named)

    # All formats have digits: most texts that are no dates have none.
    return let(raw, lambda r: F.when(r.rlike("[0-9]"), let(trimmed(F.regexp_replace(trimmed(r), '(?s)^"(.*)"$', "$1")), whole)))


def date_order_evidence(raw: Column) -> tuple[Column, Column]:
    """(day comes first, month comes first): 1 where the text proves it."""
    text = trimmed(raw)
    return text.rlike(DAY_LEADS).cast("int"), text.rlike(MONTH_LEADS).cast("int")


def infer_date_order(df: DataFrame, raw: Column, by: list[str], default_day_first: bool = False) -> DataFrame:
    """by..., day_first: what the column's texts prove more often, the default on a tie."""
    day, month = date_order_evidence(raw)
    days, months = F.coalesce(F.sum(day), F.lit(0)), F.coalesce(F.sum(month), F.lit(0))
    return df.groupBy(*by).agg(F.when(days > months, True).when(months > days, False).otherwise(default_day_first).alias("day_first"))
