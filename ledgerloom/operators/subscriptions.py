"""Findings over recurring series: subscriptions, duplicates, price rises, totals, and the classification of merchants."""

from __future__ import annotations

from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import one_currency, scale_by
from ..functions.reference import catalogue, service_classes
from ..sources.shared import settled
from .ledger import upsert
from .recurring import cadence_factor, dearest_first, detect_recurring, is_active


class Report(NamedTuple):
    subscriptions: DataFrame
    duplicates: DataFrame
    price_increases: DataFrame
    totals: DataFrame


# -- classification ----------------------------------------------------------------------------


def classify_merchants(df: DataFrame, built_in: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """df with service_class, is_overridden, is_known. An override (ledger_id, merchant_key, service_class) beats the catalogue also where its class is null or unknown: then the merchant is no service. Keys match exactly."""
    spark = df.sparkSession
    built_in = built_in if built_in is not None else F.broadcast(catalogue(spark))
    table = built_in.select(F.col("merchant_key").alias("_ck"), F.col("service_class").alias("_cc"))
    out = df.join(table, F.col("merchant_key") == F.col("_ck"), "left")
    if overrides is None:
        out = out.withColumns({"_ok": F.lit(None).cast("string"), "_oc": F.lit(None).cast("string")})
    else:
        valid = F.broadcast(service_classes(spark)).select(F.col("service_class").alias("_valid"))
        own = overrides.join(valid, F.col("service_class") == F.col("_valid"), "left").select(F.col("ledger_id").alias("_ol"), F.col("merchant_key").alias("_ok"), F.col("_valid").alias("_oc"))
        out = out.join(own, (F.col("ledger_id") == F.col("_ol")) & (F.col("merchant_key") == F.col("_ok")), "left").drop("_ol")
    overridden = F.col("_ok").isNotNull()
    return out.withColumns({"service_class": F.when(overridden, F.col("_oc")).otherwise(F.col("_cc")), "is_overridden": overridden, "is_known": F.col("_ck").isNotNull()}).drop("_ck", "_cc", "_ok", "_oc")


def merchants_in(built_in: DataFrame, service_class: str) -> DataFrame:
    return built_in.filter(F.col("service_class") == service_class).select("merchant_key")


def classifications(overrides: DataFrame, merchant_key: str | None = None) -> DataFrame:
    """The overrides of all merchants, or of one; a merchant without any has no row."""
    return overrides if merchant_key is None else overrides.filter(F.col("merchant_key") == merchant_key)


def set_classification(overrides: DataFrame, updates: DataFrame) -> DataFrame:
    return upsert(overrides, updates, ["ledger_id", "merchant_key"])


def clear_classification(overrides: DataFrame, merchants: DataFrame) -> DataFrame:
    return overrides.join(merchants, ["ledger_id", "merchant_key"], "left_anti")


# -- findings ----------------------------------------------------------------------------------


def subscriptions(series: DataFrame, as_of, *, min_confidence: float = 0.55, built_in: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """Series of enough confidence as subscriptions: amounts are magnitudes, with class and is_active."""
    rows = series.filter(F.col("confidence") >= min_confidence)
    rows = rows.withColumns(
        {
            "current_minor": F.abs("typical_minor"),
            "is_active": is_active(F.col("last_seen"), F.col("cadence"), F.lit(as_of).cast("date")),
            "amount_history": F.transform("history", lambda x: F.abs(x["amount_minor"])),
            "charge_dates": F.transform("history", lambda x: x["posted_date"]),
        }
    )
    return classify_merchants(rows.drop("history"), built_in, overrides)


def active(subs: DataFrame) -> DataFrame:
    return subs.filter("is_active")


def cancelled(subs: DataFrame) -> DataFrame:
    return subs.filter("not is_active")


def duplicate_subscriptions(subs: DataFrame) -> DataFrame:
    """A row per ledger and redundant class with several active members: all but the cheapest could be saved. Members dearest first."""
    redundant = F.broadcast(service_classes(subs.sparkSession).filter("usually_redundant").select("service_class"))
    member = F.struct((-F.col("annual_minor")).alias("order"), "first_seen", "first_transaction_id", "merchant_key", "annual_minor")
    return (
        active(subs)
        .join(redundant, "service_class")
        .groupBy("ledger_id", "service_class")
        .agg(
            F.count(F.lit(1)).alias("members"),
            (F.sum("annual_minor") - F.min("annual_minor")).alias("saving_minor"),
            one_currency(F.col("currency")).alias("currency"),
            F.transform(F.array_sort(F.collect_list(member)), lambda x: x["merchant_key"]).alias("merchants"),
        )
        .filter("members > 1")
    )


def amount_runs(amounts: Column, threshold: Decimal = Decimal("0.02")) -> Column:
    """Runs of amounts within the threshold of the run's first: array of (rep, n). The ratio is rounded to four digits, half up, which in
    whole numbers is diff * 20000 < (2 * threshold + 1) * base with the threshold in ten-thousandths."""
    limit = int(threshold * 10_000) * 2 + 1
    kind = "array<struct<rep:bigint,n:int>>"

    def take(runs: Column, a: Column) -> Column:
        last = F.element_at(runs, -1)
        near = F.abs(a - last["rep"]) * 20_000 < F.greatest(last["rep"], F.lit(1)) * limit
        one = lambda rep, n: F.array(F.struct(rep.alias("rep"), n.cast("int").alias("n")))
        grown = F.concat(F.slice(runs, 1, F.size(runs) - 1), one(last["rep"], last["n"] + 1))
        return F.when(F.size(runs) == 0, one(a, F.lit(1))).when(near, grown).otherwise(F.concat(runs, one(a, F.lit(1)))).cast(kind)

    return F.aggregate(amounts, F.array().cast(kind), take)


def price_changes(subs: DataFrame, *, threshold: Decimal = Decimal("0.02")) -> DataFrame:
    """The last lasting step of each subscription's price, if there is one: rises and cuts."""
    limit = int(threshold * 10_000) * 2 - 1
    rows = subs.filter(F.size("amount_history") >= 3).withColumn("_runs", amount_runs(F.col("amount_history"), threshold)).filter(F.size("_runs") >= 2)
    rows = rows.withColumns({"_now": F.try_element_at("_runs", F.lit(-1)), "_then": F.try_element_at("_runs", F.lit(-2)), "_n": F.size("_runs")})
    delta = F.col("_now.rep") - F.col("_then.rep")
    base = F.greatest(F.col("_then.rep"), F.lit(1))
    lasting = (F.col("_now.n") >= 2) | (F.col("_n") == 2)
    relative = F.round(F.abs(delta).cast("decimal(18,0)") / base.cast("decimal(18,0)"), 4)
    changed = F.when(F.size("charge_dates") >= F.size("amount_history"), F.try_element_at("charge_dates", F.size("amount_history") - F.col("_now.n") + 1))
    return rows.filter(lasting & (delta != 0) & (F.abs(delta) * 20_000 >= base * limit)).select(
        "ledger_id",
        "merchant_key",
        "cadence",
        F.col("_then.rep").alias("previous_minor"),
        F.col("_now.rep").alias("current_minor"),
        changed.alias("changed_on"),
        scale_by(delta, cadence_factor(F.col("cadence"))).alias("impact_minor"),
        (relative * 100).cast("decimal(18,4)").alias("percent_change"),
        (delta > 0).alias("is_increase"),
    )


def price_increases(subs: DataFrame, **options) -> DataFrame:
    """Of active and cancelled subscriptions."""
    return price_changes(subs, **options).filter("is_increase")


def report_totals(subs: DataFrame, *, strict: bool = False) -> DataFrame:
    """ledger_id, currency, active, annual_minor, monthly_minor, saving_minor. strict: one row per ledger, mixed currencies raise."""
    keys = ["ledger_id"] if strict else ["ledger_id", "currency"]
    currency = [one_currency(F.col("currency")).alias("currency")] if strict else []
    totals = active(subs).groupBy(*keys).agg(F.count(F.lit(1)).alias("active"), F.sum("annual_minor").alias("annual_minor"), F.sum("monthly_minor").alias("monthly_minor"), *currency)
    savings = duplicate_subscriptions(subs).groupBy(*keys).agg(F.sum("saving_minor").alias("saving_minor"))
    return totals.join(savings, keys, "left").withColumn("saving_minor", F.coalesce("saving_minor", F.lit(0).cast("bigint")))


def untagged_merchants(subs: DataFrame) -> DataFrame:
    """Active subscriptions of no class, dearest first; equal ones in the order in which they first appear."""
    return active(subs).filter(F.col("service_class").isNull()).orderBy(*dearest_first())


def analyse_ledger(tx: DataFrame, as_of, *, overrides: DataFrame | None = None, built_in: DataFrame | None = None) -> Report:
    """The whole analysis of a ledger; its subscriptions are found once, for all reports."""
    subs = settled(subscriptions(detect_recurring(tx), as_of, built_in=built_in, overrides=overrides))
    return Report(subs, duplicate_subscriptions(subs), price_increases(subs), report_totals(subs))
