"""Reports of all ledgers as tables partitioned by ledger, of which a refresh replaces the changed ledgers' partitions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.recurring import detect_recurring
from ..operators.subscriptions import duplicate_subscriptions, price_increases, report_totals, subscriptions
from ..sources.shared import settled

REPORTS = {
    "subscriptions": "ledger_id string, merchant_key string, cadence string, service_class string, current_minor bigint, annual_minor bigint, monthly_minor bigint, currency string, "
    "confidence double, is_active boolean, is_overridden boolean, is_known boolean, first_seen date, last_seen date, next_expected date",
    "duplicates": "ledger_id string, service_class string, members bigint, saving_minor bigint, currency string, merchants array<string>",
    "price_increases": "ledger_id string, merchant_key string, cadence string, previous_minor bigint, current_minor bigint, changed_on date, impact_minor bigint, percent_change decimal(18,4)",
    "totals": "ledger_id string, currency string, active bigint, annual_minor bigint, monthly_minor bigint, saving_minor bigint",
}


def refresh_reports(tx: DataFrame, as_of, folder: str, *, overrides: DataFrame | None = None, changed: DataFrame | None = None) -> None:
    """Write the reports of all ledgers, or of the changed ones (ledger_id) alone: their partitions are replaced, or go if nothing is
    left to report; no other file is touched, and no other ledger's transactions are analysed. `changed` are the ledgers with
    new transactions, edits or classifications since the last time."""
    spark = tx.sparkSession
    if changed is not None:
        changed = settled(changed.select("ledger_id").distinct())
        tx = tx.join(changed, "ledger_id", "left_semi")
        overrides = overrides if overrides is None else overrides.join(changed, "ledger_id", "left_semi")
    subs = settled(subscriptions(detect_recurring(tx), as_of, overrides=overrides))
    made = {"subscriptions": subs, "duplicates": duplicate_subscriptions(subs), "price_increases": price_increases(subs), "totals": report_totals(subs)}
    for name, rows in made.items():
        columns = spark.createDataFrame([], REPORTS[name]).columns
        where = f"{folder.rstrip('/')}/{name}"
        # One file for a ledger: a ledger's report is small, whatever its transactions are.
        out = rows.select(*columns).repartition("ledger_id").write.mode("overwrite").partitionBy("ledger_id")
        (out if changed is None else out.option("partitionOverwriteMode", "dynamic")).parquet(where)
        if changed is not None:
            _drop(where, changed.join(rows.select("ledger_id"), "ledger_id", "left_anti"))


def _drop(where: str, ledgers: DataFrame) -> None:
    """The partitions of these ledgers go. They are walked one by one: ledgers of one refresh that have nothing left to report."""
    spark = ledgers.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in ledgers.toLocalIterator():
        part = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("ledger_id", r["ledger_id"])
        path = jvm.org.apache.hadoop.fs.Path(f"{where}/{part}")
        path.getFileSystem(conf).delete(path, True)


def read_report(spark: SparkSession, folder: str, name: str) -> DataFrame:
    columns = spark.createDataFrame([], REPORTS[name]).columns
    return spark.read.schema(REPORTS[name]).parquet(f"{folder.rstrip('/')}/{name}").select(*columns)


def changed_classifications(before: DataFrame, after: DataFrame) -> DataFrame:
    """The ledgers whose merchants are classified otherwise than before."""
    key = ["ledger_id", "merchant_key", "service_class"]
    gone, new = before.select(*key).exceptAll(after.select(*key)), after.select(*key).exceptAll(before.select(*key))
    return gone.unionByName(new).select(F.col("ledger_id")).distinct()
