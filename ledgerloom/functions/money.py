"""Exact money: minor units in longs, factors in decimals. Overflow raises, as Spark's ANSI mode does."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .amounts import power_of_ten
from .reference import currencies


def is_debit(minor: Column) -> Column:
    return minor < 0


def is_credit(minor: Column) -> Column:
    return minor > 0


def is_zero(minor: Column) -> Column:
    return minor == 0


def is_liability(account_type: Column) -> Column:
    return account_type.isin("CREDIT_CARD", "LOAN")


def is_positive(minor: Column) -> Column:
    return minor > 0


def is_negative(minor: Column) -> Column:
    return minor < 0


def _guarded(value: Column, currency: Column, other: Column) -> Column:
    """The value if both amounts are of one currency; another one raises in the row's task. Null where a currency is null."""
    both = F.concat(F.lit("mixed currencies "), currency, F.lit(" and "), other)
    return F.when(currency == other, value).when(currency != other, F.raise_error(both).cast("bigint"))


def add_minor(a: Column, b: Column, currency: Column, other: Column) -> Column:
    """a + b of one currency. Sums beyond a long raise, as all arithmetic here does."""
    return _guarded(a + b, currency, other)


def subtract_minor(a: Column, b: Column, currency: Column, other: Column) -> Column:
    return _guarded(a - b, currency, other)


def compare_minor(a: Column, b: Column, currency: Column, other: Column) -> Column:
    """-1, 0 or 1 as a is less than, equal to or greater than b."""
    return _guarded(F.when(a < b, -1).when(a > b, 1).when(a == b, 0).cast("bigint"), currency, other).cast("int")


def times(minor: Column, n: Column | int) -> Column:
    """A whole multiple."""
    return minor * (F.lit(n) if isinstance(n, int) else n)


def negated(minor: Column) -> Column:
    """The least long has no opposite and raises."""
    return -minor


def magnitude(minor: Column) -> Column:
    return F.when(minor < 0, -minor).otherwise(minor)


def scale_by(minor: Column, factor: Column | Decimal | str) -> Column:
    """minor * factor, half up to whole units."""
    factor = factor if isinstance(factor, Column) else F.lit(Decimal(factor))
    return F.round(minor.cast("decimal(19,0)") * factor, 0).cast("bigint")


def percent_of(minor: Column, percent: Decimal | str | int) -> Column:
    return scale_by(minor, Decimal(percent) / 100)


def to_minor(major: Column, scale: Column | int = 2) -> Column:
    """Minor units of a decimal amount; raises if it has more digits than the currency."""
    shifted = major.cast("decimal(27,10)") * power_of_ten(scale)
    return F.when(shifted != F.round(shifted, 0), F.raise_error(F.lit("more digits than the currency has"))).otherwise(shifted.cast("bigint"))


def to_major(minor: Column, scale: Column | int = 2) -> Column:
    return (minor.cast("decimal(19,0)") / power_of_ten(scale)).cast("decimal(23,4)")


def plain_text(minor: Column, currency: Column, scale: Column | int = 2) -> Column:
    """Such as -1234.56 USD."""
    scale = F.lit(scale) if isinstance(scale, int) else scale
    size = F.abs(minor).cast("string")
    digits = F.lpad(size, F.greatest(F.length(size), scale + 1), F.lit("0"))
    whole = F.substring(digits, F.lit(1), F.length(digits) - scale)
    amount = F.when(scale == 0, whole).otherwise(F.concat(whole, F.lit("."), F.right(digits, scale)))
    return F.concat(F.when(minor < 0, "-").otherwise(""), amount, F.lit(" "), currency)


def with_scale(df: DataFrame, currency: str = "currency") -> DataFrame:
    """df with minor_unit_scale; raises on an unknown currency. The table of currencies has a row per ISO code."""
    known = F.broadcast(currencies(df.sparkSession).withColumnRenamed("currency", "_code"))
    joined = df.join(known, F.col(currency) == F.col("_code"), "left").drop("_code")
    checked = F.when(F.col("minor_unit_scale").isNull(), F.raise_error(F.concat(F.lit("unknown currency "), F.coalesce(F.col(currency), F.lit("null"))))).otherwise(F.col("minor_unit_scale"))
    return joined.withColumn("minor_unit_scale", checked)


def sum_minor(minor: Column) -> Column:
    """0 for no rows."""
    return F.coalesce(F.sum(minor), F.lit(0).cast("bigint"))


def one_currency(currency: Column) -> Column:
    """Of a group: its currency, USD if it has no rows; raises if it has several. A least and a greatest, so nothing is gathered."""
    return F.when(F.min(currency) != F.max(currency), F.raise_error(F.lit("mixed currencies"))).otherwise(F.coalesce(F.min(currency), F.lit("USD")))


def allocate(df: DataFrame, amount: str, weights: str, id_cols: list[str]) -> DataFrame:
    """df exploded to a row per weight: part (from 0), weight, share_minor. Shares follow the weights and sum to the amount: each
    gets the floor, and the units left over go to the largest remainders, the first of equal ones. id_cols name a row.
    Weights must be at least 0 and not all 0; otherwise it raises."""
    size = F.abs(F.col(amount)).cast("decimal(20,0)")
    total = F.aggregate(F.col(weights), F.lit(0).cast("decimal(20,0)"), lambda a, w: (a + w).cast("decimal(20,0)"))
    bad = F.exists(F.col(weights), lambda w: w < 0) | (total <= 0)
    rows = df.withColumn("_total", F.when(bad, F.raise_error(F.lit("weights must not be negative or all 0"))).otherwise(total)).select("*", F.posexplode(weights).alias("part", "weight"))
    product = (size * F.col("weight").cast("decimal(18,0)")).cast("decimal(38,0)")
    rows = rows.withColumn("_floor", F.floor(product / F.col("_total")).cast("decimal(20,0)")).withColumn("_floor", F.expr("_floor"))
    # The quotient is exact by multiplying back: a division of decimals may round.
    rows = rows.withColumn("_floor", F.col("_floor") - F.when(F.col("_floor") * F.col("_total") > product, 1).otherwise(0))
    rows = rows.withColumn("_rest", product - F.col("_floor") * F.col("_total"))
    of_row = Window.partitionBy(*id_cols)
    left = size - F.sum("_floor").over(of_row)
    rank = F.row_number().over(of_row.orderBy(F.desc("_rest"), "part"))
    share = (F.col("_floor") + (rank <= left).cast("int")) * F.signum(F.col(amount)).cast("int")
    return rows.withColumn("share_minor", share.cast("bigint")).drop("_total", "_floor", "_rest")


def split_even(df: DataFrame, amount: str, parts: int | Column, id_cols: list[str]) -> DataFrame:
    """A row per part; parts differ by one unit at most."""
    parts = F.lit(parts) if isinstance(parts, int) else parts
    return allocate(df.withColumn("_ones", F.array_repeat(F.lit(1).cast("bigint"), parts)), amount, "_ones", id_cols).drop("_ones", "weight")
