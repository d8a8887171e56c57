"""Refresh of changed ledgers, and live queries."""

from pathlib import Path

from pyspark.sql import functions as F

from ledgerloom.operators import ledger, subscriptions
from ledgerloom.plans.driver_ledger import AS_OF, rhythm_ledger
from ledgerloom.sources import schemas, snapshots
from ledgerloom.streaming import live, reports

from .conftest import rows

DATA = "/root/testdata/sf0.001"


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def test_only_the_changed_ledgers_files_change(spark, tmp_path):
    tx = rhythm_ledger(spark, DATA).cache()
    folder, whole = str(tmp_path / "some"), str(tmp_path / "whole")
    reports.refresh_reports(tx, AS_OF, folder)
    before = files(folder)
    names = {p.split("/")[1] for p in before}
    assert len(names) > 10 and all(n.startswith("ledger_id=L") for n in names)
    # L3 gets a merchant of its own, L4 loses all it had, and so do its files; a ledger that never had a report stays without.
    day = F.explode(F.sequence(F.to_date(F.lit("2022-07-05")), F.to_date(F.lit("2023-06-05")), F.expr("interval 1 month")))
    new = tx.filter("ledger_id = 'L3'").limit(1).select(
        "ledger_id", F.lit("x").alias("id"), "account_id", day.alias("posted_date"), F.lit(-999).cast("long").alias("amount_minor"), "currency", F.lit("NEW SERVICE").alias("merchant_key"), F.lit(False).alias("is_transfer")
    ).withColumn("id", F.concat("id", F.col("posted_date").cast("string")))
    now = tx.filter("ledger_id <> 'L4'").unionByName(new)
    reports.refresh_reports(now, AS_OF, folder, changed=spark.createDataFrame([("L3",), ("L4",), ("nobody",)], "ledger_id string"))
    after = files(folder)
    changed = {p.split("/")[1] for p in before.keys() ^ after.keys()} | {p.split("/")[1] for p in before.keys() & after.keys() if before[p] != after[p]}
    assert changed == {"ledger_id=L3", "ledger_id=L4"} and not any("ledger_id=L4/" in p for p in after)
    reports.refresh_reports(now, AS_OF, whole)
    for name in reports.REPORTS:
        assert rows(reports.read_report(spark, folder, name)) == rows(reports.read_report(spark, whole, name))
    assert rows(reports.read_report(spark, folder, "subscriptions").filter("merchant_key = 'NEW SERVICE'"), "ledger_id", "current_minor", "is_active") == [("L3", 999, True)]
    tx.unpersist()


def test_ledgers_that_are_classified_anew(spark):
    kind = "ledger_id string, merchant_key string, service_class string"
    before = spark.createDataFrame([("a", "x", "NEWS"), ("b", "x", None), ("c", "x", "VPN"), ("d", "x", None)], kind)
    after = spark.createDataFrame([("a", "x", "NEWS"), ("b", "x", "NEWS"), ("d", "x", None), ("e", "y", None)], kind)
    assert rows(reports.changed_classifications(before, after)) == [("b",), ("c",), ("e",)]


EDITS = f"{schemas.ACCOUNTS}, version bigint, is_deleted boolean"


def test_live_accounts(spark, tmp_path):
    folder, root, told = tmp_path / "edits", str(tmp_path / "view"), []

    def edit(n, *items):
        made = [("L", i, name, "Bank", "CASH", "USD", None, archived, version, gone) for i, name, archived, version, gone in items]
        spark.createDataFrame(made, EDITS).coalesce(1).write.mode("append").parquet(str(folder))

    def go():
        return live.run_live_query(spark.readStream.schema(EDITS).parquet(str(folder)), root, str(tmp_path / "checkpoint"), schema=f"{schemas.ACCOUNTS}, version bigint", key=["ledger_id", "id"], on_change=lambda c: told.append(rows(c, "id", "display_name", "is_archived", "is_deleted")))

    edit(1, ("a", "Anna", False, 1, False), ("b", "Bert", False, 1, False), ("a", "Ann", False, 2, False))
    q = go()
    q.processAllAvailable()
    edit(2, ("b", "Bert", True, 2, False), ("c", "Carl", False, 1, False))
    q.processAllAvailable()
    q.stop()
    edit(3, ("a", "old", False, 1, False), ("c", "Carl", False, 2, True), ("d", "never", False, 1, True))
    q = go()
    q.processAllAvailable()
    q.stop()
    assert told == [
        [("a", "Ann", False, False), ("b", "Bert", False, False)],
        [("b", "Bert", True, False), ("c", "Carl", False, False)],
        [("c", "Carl", False, True)],
    ]
    view = snapshots.Store(spark, root, {"rows": f"{schemas.ACCOUNTS}, version bigint"}).read("rows")
    assert [r["id"] for r in ledger.accounts_by_name(view).collect()] == ["a"] and rows(ledger.accounts_by_name(view, archived=True), "id", "display_name") == [("a", "Ann"), ("b", "Bert")]
    every = spark.read.schema(EDITS).parquet(str(folder))
    assert rows(view) == rows(live.latest(every, ["ledger_id", "id"]).filter("not is_deleted").select(*view.columns))


def test_live_classifications(spark, tmp_path):
    kind = "ledger_id string, merchant_key string, service_class string, version bigint, is_deleted boolean"
    folder, told = str(tmp_path / "edits"), []
    for n, items in enumerate([[("L", "X", "VPN", 1, False), ("L", "Y", None, 1, False)], [("L", "X", "NEWS", 2, False), ("L", "Y", None, 2, True)]]):
        spark.createDataFrame(items, kind).coalesce(1).write.mode("append").parquet(folder)
        q = live.run_live_query(spark.readStream.schema(kind).parquet(folder), str(tmp_path / "view"), str(tmp_path / "checkpoint"), schema="ledger_id string, merchant_key string, service_class string, version bigint", key=["ledger_id", "merchant_key"], on_change=lambda c: told.append(rows(c, "merchant_key", "service_class", "is_deleted")))
        q.processAllAvailable()
        q.stop()
    assert told == [[("X", "VPN", False), ("Y", None, False)], [("X", "NEWS", False), ("Y", None, True)]]
    view = snapshots.Store(spark, str(tmp_path / "view"), {"rows": "ledger_id string, merchant_key string, service_class string, version bigint"}).read("rows")
    assert rows(subscriptions.classifications(view), "merchant_key", "service_class") == [("X", "NEWS")]
