"""Amounts as banks write them, to decimals and minor units. Column expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL = "decimal(38,10)"
#: Digits, a point, and one or two digits: nothing there can group thousands.
PLAIN = r"^-?[0-9]{1,18}\.[0-9]{1,2}\z"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it: without this, expressions that name their
    steps twice grow beyond what generated code can hold."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(c: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(c, r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def _grouped(text: Column, mark: str) -> Column:
    """Every group after the first has three digits."""
    m = "\\" + mark
    return text.rlike(f"^[^{m}]*(?:{m}[^{m}]{{3}})+$")


def separators(text: Column) -> Column:
    """Digits with marks to plain decimal notation: the later of two kinds of marks is the decimal one; a mark that repeats or
    is followed by groups of three groups thousands."""
    dot, comma = text.contains("."), text.contains(",")
    no_dots, no_commas = F.replace(text, F.lit("."), F.lit("")), F.replace(text, F.lit(","), F.lit(""))
    only_dots = F.when(text.rlike(r"\..*\.") | _grouped(text, "."), no_dots).otherwise(text)
    only_commas = F.when(text.rlike(",.*,") | _grouped(text, ","), no_commas).otherwise(F.replace(text, F.lit(","), F.lit(".")))
    comma_later = F.instr(F.reverse(text), ",") < F.instr(F.reverse(text), ".")
    return (
        F.when(~dot & ~comma, text)
        .when(~comma, only_dots)
        .when(~dot, only_commas)
        .when(comma_later, F.replace(no_dots, F.lit(","), F.lit(".")))
        .otherwise(no_commas)
    )


def parse_decimal(raw: Column) -> Column:
    """The amount as decimal(38,10), null if it is none: parentheses, a minus on either side, currency signs and codes, both
    separator customs. Letters are ignored, so a text with digits in it is an amount."""
    def unsigned(v: Column) -> Column:
        digits = trimmed(F.regexp_replace(trimmed(F.regexp_replace(trimmed(F.regexp_replace(v, "-$", "")), "^-", "")), r"^\+", ""))
        return let(F.regexp_replace(digits, r"[^0-9.,\-]", ""), lambda d: F.when(d != "", separators(d)).try_cast(DECIMAL))

    def signed(v: Column) -> Column:
        return let(unsigned(v), lambda n: F.when(v.startswith("-") | v.endswith("-"), -n).otherwise(n))

    def bracketed(t: Column) -> Column:
        core = trimmed(F.regexp_replace(t, r"(?s)^\((.*)\)$", "$1"))
        core = trimmed(F.regexp_replace(F.regexp_replace(core, r"^[A-Z]{3}\s+", ""), "[$£€¥₹]", ""))
        # Brackets make a negative amount of either sign.
        return let(let(core, signed), lambda n: F.when(t.rlike(r"(?s)^\(.*\)$"), -F.abs(n)).otherwise(n))

    # Texts without digits are none, and plain ones need no steps.
    return let(raw, lambda r: F.when(r.rlike(PLAIN), r.try_cast(DECIMAL)).when(r.rlike("[0-9]"), let(trimmed(r), bracketed)))


def power_of_ten(scale: Column | int) -> Column:
    scale = F.lit(scale) if isinstance(scale, int) else scale
    return F.when(scale == 0, F.lit(1)).when(scale == 1, F.lit(10)).when(scale == 2, F.lit(100)).when(scale == 3, F.lit(1000)).when(scale == 4, F.lit(10000)).cast("decimal(10,0)")


def decimal_to_minor(value: Column, scale: Column | int = 2) -> Column:
    """Half up to the currency's digits; null if out of the range of a long."""
    return F.round(value.cast("decimal(27,10)") * power_of_ten(scale), 0).try_cast("bigint")


def parse_amount_minor(raw: Column, scale: Column | int = 2, invert: Column | bool = False) -> Column:
    """Minor units of an amount text, null if it is none."""
    invert = F.lit(invert) if isinstance(invert, bool) else invert
    return let(parse_decimal(raw).try_cast("decimal(27,10)"), lambda v: decimal_to_minor(F.when(invert, -v).otherwise(v), scale))
