"""Recurring charges: cadence, confidence and costs from the days between a merchant's charges."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import let
from ..functions.money import scale_by
from ..functions.reference import CADENCES, annual_factor, cadence_ranges

#: A gap is explained by up to so many periods.
MAX_PERIODS = 3
#: Of ten gaps, so many must fit.
MIN_FIT_TENTHS = 6
MONTHLY_SHARE = "0.083333"


def cadence_number_of_gap(gap: Column) -> Column:
    """The place among CADENCES of the nearest one whose window holds the gap, or null."""
    number = {name: i for i, (name, *_) in enumerate(CADENCES)}
    out = F.lit(None).cast("int")
    for name, low, high in cadence_ranges():
        out = F.when(gap.between(low, high), number[name]).otherwise(out)
    return out


def _of_number(number: Column, values: list) -> Column:
    return F.get(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), number)


def _number(cadence: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(n) for n, *_ in CADENCES]), cadence) - 1).cast("int")


def cadence_days(cadence: Column) -> Column:
    return _of_number(_number(cadence), [days for _, days, _, _ in CADENCES])


def cadence_factor(cadence: Column) -> Column:
    """Occurrences a year, decimal(9,4)."""
    return _of_number(_number(cadence), [F.lit(annual_factor(days)).cast("decimal(9,4)") for _, days, _, _ in CADENCES])


def periods_of_gap(gap: Column, days: Column, tolerance: Column) -> Column:
    """The least number of periods, up to three, that the gap fits; null if none. The tolerance grows with the periods."""
    out = F.lit(None).cast("int")
    for p in range(MAX_PERIODS, 0, -1):
        out = F.when(F.abs(gap - days * p) <= tolerance * p, p).otherwise(out)
    return out


def same_calendar_position(a: Column, b: Column) -> Column:
    """On about the same day of the month, or both at its end."""
    from_end = lambda d: F.dayofmonth(F.last_day(d)) - F.dayofmonth(d)
    return (F.abs(F.dayofmonth(a) - F.dayofmonth(b)) <= 1) | ((from_end(a) <= 3) & (from_end(b) <= 3))


def upper_median(sorted_values: Column) -> Column:
    return F.element_at(sorted_values, F.floor(F.size(sorted_values) / 2).cast("int") + 1)


def daily_charges(tx: DataFrame) -> DataFrame:
    """Debits that are no transfers, the first by id of each merchant and day. The first ones are found before rows are dealt out, so
    a merchant of very many rows leaves one for each task and day, and one a day in the end."""
    charges = tx.filter((F.col("amount_minor") < 0) & ~F.col("is_transfer"))
    return (
        charges.groupBy("ledger_id", "merchant_key", "posted_date")
        .agg(F.min_by(F.struct("amount_minor", "currency", "id"), "id").alias("c"))
        .select("ledger_id", "merchant_key", "posted_date", "c.amount_minor", "c.currency", F.col("c.id").alias("transaction_id"))
    )


def detect_recurring(tx: DataFrame, *, min_occurrences: int = 3, min_confidence: float = 0.4) -> DataFrame:
    """A row per recurring merchant: ledger_id, merchant_key, cadence, charges, missed, matched, gaps, confidence, typical_minor,
    currency, first_seen, last_seen, next_expected, annual_minor, monthly_minor, history (posted_date, amount_minor, ...).

    A merchant's group has a row for each day that it charges on, so it is bounded by the calendar (some 3,650 rows in ten years), whatever the number
    of its transactions. Days are dealt by merchant once; gaps, sums and the group use that dealing."""
    by_day = Window.partitionBy("ledger_id", "merchant_key").orderBy("posted_date")
    days = daily_charges(tx).withColumns({"gap": F.datediff("posted_date", F.lag("posted_date").over(by_day)), "first_day": F.first("posted_date").over(by_day)})
    # How many gaps each cadence explains and how many charges that takes as missed: plain sums, for all cadences at once.
    periods = {f"p{i}": periods_of_gap(F.col("gap"), F.lit(d), F.lit(t)) for i, (_, d, t, _) in enumerate(CADENCES)}
    merchants = (
        days.withColumns(periods)
        .groupBy("ledger_id", "merchant_key")
        .agg(
            F.count(F.lit(1)).cast("int").alias("charges"),
            F.bool_and(same_calendar_position(F.col("first_day"), F.col("posted_date"))).alias("steady"),
            F.sort_array(F.collect_list(F.struct("posted_date", "amount_minor", "currency", "transaction_id"))).alias("history"),
            F.array(*[F.count(p) for p in periods]).alias("fits"),
            F.array(*[F.coalesce(F.sum(F.col(p) - 1), F.lit(0)) for p in periods]).alias("skips"),
        )
        .filter(F.col("charges") >= max(min_occurrences, 2))
    )
    between = F.zip_with(F.slice("history", 1, F.col("charges") - 1), F.slice("history", 2, F.col("charges")), lambda a, b: F.datediff(b["posted_date"], a["posted_date"]))
    merchants = merchants.withColumns({"gaps": F.array_sort(between), "amounts": F.array_sort(F.transform("history", lambda x: x["amount_minor"]))})
    majority = F.filter(F.transform("fits", lambda n, i: F.struct(n.alias("n"), (-i).alias("i"))), lambda x: x["n"] > F.floor(F.size("gaps") / 2))
    guess = F.coalesce(let(upper_median(F.col("gaps")), cadence_number_of_gap), (-F.array_max(majority)["i"]).cast("int"))
    four_weekly, monthly = 2, 3
    number = let(guess, lambda g: F.when(g.isin(four_weekly, monthly), F.when(F.col("steady"), monthly).otherwise(four_weekly)).otherwise(g))
    day = lambda i: F.col("history")[i]["posted_date"]
    placed = (
        merchants.withColumn("number", number)
        .withColumns(
            {
                "n_gaps": F.size("gaps"),
                "matched": F.get("fits", F.col("number")).cast("int"),
                "missed": F.get("skips", F.col("number")).cast("int"),
                "cadence": _of_number(F.col("number"), [n for n, *_ in CADENCES]),
                "_days": _of_number(F.col("number"), [d for _, d, _, _ in CADENCES]),
            }
        )
        .filter(F.col("matched") * 10 >= F.col("n_gaps") * MIN_FIT_TENTHS)
    )

    absolute = F.transform("history", lambda x: F.abs(x["amount_minor"]).cast("double"))

    def stability(values: Column) -> Column:
        def around(median: Column) -> Column:
            spread = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.abs(x - median))
            return F.when((F.col("charges") < 2) | (median == 0), 0.5).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - spread / F.col("charges") / median))

        return let(upper_median(F.array_sort(values)), around)

    volume = F.when(F.col("charges") >= 12, 1.0).when(F.col("charges") >= 6, 0.9).when(F.col("charges") >= 4, 0.8).otherwise(0.7)
    skip = F.lit(1.0) - F.least(F.col("missed") / (F.col("n_gaps") + 1), F.lit(0.5))
    thin = F.when((F.col("cadence") == "ANNUAL") & (F.col("charges") < 3), 0.7).otherwise(1.0)
    blend = (F.col("matched") / F.col("n_gaps")) * 0.5 + volume * 0.2 + let(absolute, stability) * 0.2 + skip * 0.1
    scored = (
        placed.withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), blend * thin)))
        .filter(F.col("confidence") >= min_confidence)
        .withColumn("typical_minor", upper_median(F.col("amounts")))
        .withColumn("annual_minor", scale_by(F.abs("typical_minor"), cadence_factor(F.col("cadence"))))
    )
    return scored.select(
        "ledger_id",
        "merchant_key",
        "cadence",
        "charges",
        "matched",
        "n_gaps",
        "missed",
        "confidence",
        "typical_minor",
        day(0).alias("first_seen"),
        F.element_at("history", -1)["posted_date"].alias("last_seen"),
        F.date_add(F.element_at("history", -1)["posted_date"], F.col("_days")).alias("next_expected"),
        "annual_minor",
        scale_by(F.col("annual_minor"), Decimal(MONTHLY_SHARE)).alias("monthly_minor"),
        F.col("history")[0]["currency"].alias("currency"),
        F.col("history")[0]["transaction_id"].alias("first_transaction_id"),
        "history",
    )


def is_active(last_seen: Column, cadence: Column, as_of: Column) -> Column:
    """Within one and a half periods of the last charge."""
    return F.datediff(as_of, last_seen) * 2 <= cadence_days(cadence) * 3


def active_series(series: DataFrame, as_of) -> DataFrame:
    return series.filter(is_active(F.col("last_seen"), F.col("cadence"), F.lit(as_of).cast("date")))


def dearest_first() -> list[Column]:
    """The order of series and findings: by annual cost; equal ones in the order in which they first appear."""
    return [F.desc("annual_minor"), F.col("first_seen"), F.col("first_transaction_id")]


def ordered_series(series: DataFrame) -> DataFrame:
    return series.orderBy(*dearest_first())


def confidence_tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "CERTAIN").when(confidence >= 0.70, "LIKELY").otherwise("UNCERTAIN")
