import datetime as dt
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.merchants import with_merchant_key
from ledgerloom.operators import imports, ledger
from ledgerloom.plans import registry
from ledgerloom.sources import schemas, shared, snapshots, statements
from ledgerloom.streaming.imports import run_import_stream, statement_stream

from .conftest import rows

PARSED = (
    "ledger_id string, account_id string, batch_id string, batch_seq long, source_pos long, posted_date date, amount_minor long, currency string, raw_description string, "
    "institution_transaction_id string, is_pending boolean"
)
PROBLEM = "ledger_id string, batch_id string, severity string"
D = dt.date(2026, 3, 14)


def parsed(spark, items, batch="b1", seq=1):
    return spark.createDataFrame([("L", "A", batch, seq, i, D, amount, "USD", name, fitid, False) for i, (name, amount, fitid) in enumerate(items)], PARSED)


def held(spark, items=()):
    if not items:
        return spark.createDataFrame([], schemas.TRANSACTIONS)
    return imports.enrich(parsed(spark, items, "b0", 0)).select(*imports.LEDGER_COLUMNS)


def run(spark, before, items):
    return imports.import_batch(held(spark, before), parsed(spark, items), spark.createDataFrame([("L", "b1", "ERROR"), ("L", "b1", "WARNING")], PROBLEM))


def new(outcome):
    return [r[0] for r in rows(outcome.new_rows, "source_pos")]


def test_reimport_overlap_and_rewording(spark):
    three = [("NETFLIX.COM", -1599, None), ("SHELL OIL 05/12", -4500, None), ("PAYROLL", 250000, None)]
    again = run(spark, three, three)
    assert new(again) == []
    (s,) = again.summary.collect()
    assert (s["rows_parsed"], s["rows_imported"], s["rows_duplicate"], s["rows_failed"], s["likely_reimport"]) == (3, 0, 3, 1, True)
    assert new(run(spark, three, [*three, ("NEW SHOP", -1, None)])) == [3]
    assert new(run(spark, three, [("NETFLIX.COM 866-579-7172 CA", -1599, None)])) == []


def test_institution_ids(spark):
    assert new(run(spark, [("A", -1, "F1")], [("B", -2, "F1")])) == []
    assert new(run(spark, [("A", -1, None)], [("B", -2, None), ("C", -3, None)])) == [0, 1]
    assert new(run(spark, [], [("B", -2, "F1"), ("C", -3, "F1")])) == [0]
    # A row that the hash rejects must not stand in the way of a later one with its institution id.
    assert new(run(spark, [("A", -1, None)], [("A", -1, "F1"), ("B", -2, "F1")])) == [1]


def test_same_day_repeats(spark):
    twice = [("COFFEE", -475, None)] * 2
    assert new(run(spark, [], twice)) == [0, 1]
    assert new(run(spark, twice, twice)) == []
    assert new(run(spark, twice, [*twice, twice[0]])) == [2]


def test_many_batches_equal_one_after_another(spark):
    rng = random.Random(4)
    frames, order = [], []
    for b in range(1, 5):
        items = [(rng.choice("ABC"), -rng.randint(1, 3), rng.choice([None, "F1", "F2", "F3"])) for _ in range(6)]
        frames.append(parsed(spark, items, f"b{b}", b))
    everything = frames[0]
    for f in frames[1:]:
        everything = everything.unionByName(f)
    hashes, fitids = set(), set()
    for r in imports.enrich(everything).orderBy("batch_seq", "source_pos").collect():
        if r["dedup_hash"] not in hashes and (r["institution_transaction_id"] is None or r["institution_transaction_id"] not in fitids):
            order.append((r["batch_id"], r["source_pos"]))
            hashes.add(r["dedup_hash"])
            fitids.add(r["institution_transaction_id"])
    assert rows(imports.import_many(held(spark), everything), "batch_id", "source_pos") == sorted(order, key=repr)


def test_registered_import_of_all_batches(spark):
    data = "/root/testdata/sf0.001"
    parsed = imports.assign_hashes(with_merchant_key(registry._parsed(spark, data))).collect()
    seen, want = set(), []
    for r in sorted(parsed, key=lambda r: (r["batch_id"], r["source_pos"])):
        keys = {(r["ledger_id"], r["dedup_hash"])} | ({(r["ledger_id"], r["account_id"], r["institution_transaction_id"])} if r["institution_transaction_id"] else set())
        if not keys & seen:
            seen |= keys
            want.append((r["id"], r["batch_id"]))
    assert {b for _, b in want} == {"B0", "B1", "B2", "B3"} and len(want) < len(parsed)
    assert rows(registry.QUERIES["import_all_batches"](spark, data), "order_id", "batch_id") == sorted(want, key=repr)


def in_ledgers(df, *names):
    out = [df.withColumn("ledger_id", F.lit(n)) for n in names]
    return out[0].unionByName(out[1])


def test_undo_and_edits_touch_one_ledger(spark):
    """Two ledgers with the same names of batches, accounts and categories."""
    one = held(spark, [("A", -1, None), ("B", -2, None)]).unionByName(imports.enrich(parsed(spark, [("C", -3, None)])).select(*imports.LEDGER_COLUMNS))
    tx = in_ledgers(one.withColumn("id", F.concat("merchant_key", "import_batch_id")), "L1", "L2")
    batches = in_ledgers(spark.createDataFrame([("b0", "A"), ("b1", "A")], "id string, account_id string"), "L1", "L2")
    left, records, removed = imports.undo_batch(tx, batches, "L1", "b1")
    assert rows(left.groupBy("ledger_id").count()) == [("L1", 2), ("L2", 3)]
    assert (rows(records, "ledger_id", "id"), rows(removed)) == ([("L1", "b0"), ("L2", "b0"), ("L2", "b1")], [(1,)])
    book = ledger.Ledger(tx, batches, in_ledgers(spark.createDataFrame([("A",)], "id string"), "L1", "L2"))
    assert [rows(x.groupBy("ledger_id").count()) for x in ledger.delete_account(book, "L1", "A")] == [[("L2", 3)], [("L2", 2)], [("L2", 1)]]
    assert rows(ledger.delete_batch(book, "L1", "b1").transactions.filter("import_batch_id is null"), "ledger_id", "merchant_key") == [("L1", "C")]
    assert rows(ledger.delete_batch(book, "L1", "b1").import_batches, "ledger_id", "id") == [("L1", "b0"), ("L2", "b0"), ("L2", "b1")]
    ids = tx.filter("merchant_key = 'A'").select("id")
    named = ledger.assign_category(tx, ids, "food")
    assert rows(named.filter("ledger_id = 'L1'"), "merchant_key", "category_id") == [("A", "food"), ("B", None), ("C", None)]
    categories = in_ledgers(spark.createDataFrame([("food", None), ("pizza", "food")], "id string, parent_id string"), "L1", "L2")
    named, categories = ledger.delete_category(named, categories, "L2", "food")
    assert rows(named.filter("category_id is not null"), "ledger_id", "merchant_key") == [("L1", "A")]
    assert rows(categories, "ledger_id", "id", "parent_id") == [("L1", "food", None), ("L1", "pizza", "food"), ("L2", "pizza", None)]
    assert ledger.mark_transfer(tx, ids).filter("is_transfer").count() == 2
    assert rows(ledger.uncategorised_merchants(tx)) == [("A",), ("B",), ("C",)]
    assert ledger.account_page(tx, "L1", "A", 2, 2).count() == 1
    assert rows(ledger.existing_hashes(tx.filter("ledger_id = 'L1'"), tx), "ledger_id") == [("L1",)] * 3
    assert rows(schemas.from_storage(schemas.to_storage(tx)), "id", "posted_date") == rows(tx, "id", "posted_date")


def test_summary_by_ledger_with_review_flag_and_time(spark):
    both = in_ledgers(parsed(spark, [("A", -1, None), ("B", -2, None)]), "L1", "L2")
    problems = spark.createDataFrame([("L2", "b1", "ERROR"), ("L3", "b1", "ERROR")], PROBLEM)
    when = dt.datetime(2026, 1, 2, 3, 4, tzinfo=dt.UTC)
    first = imports.import_batch(held(spark), both.filter("ledger_id = 'L1'"), problems.limit(0)).new_rows.select(*imports.LEDGER_COLUMNS)
    got = imports.import_batch(first, both, problems, source="OCR", imported_at=when).summary
    assert rows(got, "ledger_id", "rows_parsed", "rows_imported", "rows_duplicate", "rows_failed", "likely_reimport", "needs_review") == [
        ("L1", 2, 0, 2, 0, True, True), ("L2", 2, 2, 0, 1, False, True), ("L3", 0, 0, 0, 1, False, False)
    ]
    assert got.filter(F.col("imported_at") == F.lit(when)).count() == 3
    assert not any(r["needs_review"] for r in imports.import_batch(first, both, problems, source="CSV").summary.collect())


def test_one_large_account_and_long_chains(spark):
    """An account with a third of all rows, repeats of one charge in every batch, and rows that wait for rows that wait."""
    rng = random.Random(9)
    items = []
    for b in range(6):
        for i in range(40):
            big = rng.random() < 0.4
            items.append(("L", "A" if big else rng.choice("BCDE"), f"b{b}", b, i, D, -rng.randint(1, 4), "USD", rng.choice(["X", "Y"]), rng.choice([None, *(f"F{k}" for k in range(12))]), False))
    # r0 - r1 share a hash, r1 - r2 an id, r2 - r3 a hash, and so on: each waits for the one before.
    items += [("C", "A", f"b{k}", k, 0, D, -100 - k // 2, "USD", "CHAIN", f"G{(k + 1) // 2}", False) for k in range(9)]
    everything = spark.createDataFrame(items, PARSED)
    seen, want = set(), []
    for r in imports.enrich(everything).orderBy("batch_seq", "source_pos").collect():
        keys = {(r["ledger_id"], r["dedup_hash"])} | ({(r["ledger_id"], r["account_id"], r["institution_transaction_id"])} if r["institution_transaction_id"] else set())
        if not keys & seen:
            seen |= keys
            want.append((r["ledger_id"], r["batch_id"], r["source_pos"]))
    got = imports.import_many(held(spark), everything)
    assert rows(got, "ledger_id", "batch_id", "source_pos") == sorted(want, key=repr)
    assert imports.import_many(got.select(*imports.LEDGER_COLUMNS), everything).count() == 0


def test_many_batches_into_ledgers_that_hold_some(spark):
    """Two ledgers with the same names, repeats within and across batches, keys that the ledger has, accounts and ids that run into each other when joined."""
    rng = random.Random(21)
    accounts, fitids = ["A", "A\u001f1", "", None], [None, None, "", *(f"F{k}" for k in range(9)), "1\u001fF0", "F0"]
    items = [
        (rng.choice(["L1", "L2"]), rng.choice(accounts), f"b{b}", b, i, D, -rng.randint(1, 6), "USD", rng.choice(["X", "Y"]), rng.choice(fitids), False) for b in range(4) for i in range(60)
    ]
    everything = spark.createDataFrame(items, PARSED).withColumn("remark", F.lit(None))  # without a type: no table keeps it

    def in_order(enriched, seen):
        out = []
        for r in sorted(enriched.collect(), key=lambda r: (r["batch_seq"], r["source_pos"])):
            keys = {(r["ledger_id"], r["dedup_hash"])} | ({(r["ledger_id"], r["account_id"], r["institution_transaction_id"])} if r["institution_transaction_id"] is not None else set())
            if not keys & seen:
                seen |= keys
                out.append((r["ledger_id"], r["batch_id"], r["source_pos"], r["id"], r["dedup_hash"]))
        return sorted(out, key=repr)

    named = everything.filter("account_id is not null")
    seen, columns = set(), ("ledger_id", "batch_id", "source_pos", "id", "dedup_hash")
    first = imports.import_many(held(spark), named.filter("batch_seq < 2"))
    assert rows(first, *columns) == in_order(imports.enrich(named.filter("batch_seq < 2")), seen)
    then = imports.import_many(first.select(*imports.LEDGER_COLUMNS), named.filter("batch_seq >= 2"))
    want = in_order(imports.enrich(named.filter("batch_seq >= 2")), seen)
    assert rows(then, *columns) == want and 0 < len(want) < named.filter("batch_seq >= 2").count()
    assert then.filter("remark is null").count() == len(want)
    assert rows(imports.import_many(held(spark), everything), *columns) == in_order(imports.enrich(everything), set())


@pytest.mark.parametrize(("name", "most"), [("import_all_batches", 600), ("published_import", 1000)])
def test_disk_of_an_import(spark, name, most):
    """Bytes of shuffles and of tables on the way, for each of 15,000 rows: 1,600 and more when whole keys were dealt several times in each round and rows were made twice."""
    folders = [os.environ.get("SPARK_LOCAL_DIRS") or spark.sparkContext.getConf().get("spark.local.dir"), shared.shared_folder(spark).removeprefix("file:")]
    files = lambda: {p: p.stat().st_size for f in folders for p in Path(f).rglob("*") if p.name.endswith((".data", ".parquet")) or p.name.startswith("part-")}
    before = files()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with tables that are too large for it
    try:
        n = registry.QUERIES[name](spark, "/root/testdata/sf0.01").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    used = sum(size for p, size in files().items() if p not in before)
    print("USED", name, used)
    assert n in (14_930, 200) and 0 < used < most * 15_000


# -- published snapshots -----------------------------------------------------------------------

BATCH = "ledger_id string, id string, account_id string, source string, file_name string"
PROBLEMS = "ledger_id string, batch_id string, location string, message string, severity string, raw_content string"
WHEN = dt.datetime(2026, 1, 2, 3, 4, 5)


def importing(spark, *names):
    batches = spark.createDataFrame([("L", n, "A", "OCR", f"{n}.csv") for n in names], BATCH)
    everything = parsed(spark, [("A", -1, None), ("B", -2, "F1")], "b1", 1).unionByName(parsed(spark, [("B", -2, "F1"), ("C", -3, None)], "b2", 2))
    return batches, everything, spark.createDataFrame([("L", "b1", "line 3", "no", "ERROR", "x"), ("L", "b1", "line 4", "hm", "WARNING", None), ("L", "b9", "file", "no", "ERROR", None)], PROBLEMS)


def test_import_is_all_or_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    store = snapshots.Store(spark, root)
    assert store.read("transactions").count() == 0 and store.snapshot().number == 0
    imports.publish_import(store, *importing(spark, "b1"), imported_at=WHEN)
    before = [rows(store.read(t)) for t in snapshots.TABLES]
    assert [len(x) for x in before] == [2, 1, 2]
    # Killed after each of the writes, and before the new number is published.
    write, calls = snapshots.Store.write, []
    for stop in ("transactions", "import_batches", "problems", "_point"):
        with monkeypatch.context() as m:
            def dies(self, table, df, stop=stop):
                out = write(self, table, df)
                if table == stop:
                    raise RuntimeError("killed")
                return out

            m.setattr(snapshots.Store, "write", dies)
            if stop == "_point":
                m.setattr(snapshots.Store, "_point", lambda self, s: (_ for _ in ()).throw(RuntimeError("killed")))
            with pytest.raises(RuntimeError, match="killed"):
                imports.publish_import(store, *importing(spark, "b1", "b2"), imported_at=WHEN)
        calls.append([rows(store.read(t)) for t in snapshots.TABLES])
    assert calls == [before] * 4
    assert imports.publish_import(store, *importing(spark, "b1", "b2"), imported_at=WHEN).number == 2
    assert imports.publish_import(store, *importing(spark, "b1", "b2"), imported_at=WHEN).number == 2
    assert rows(store.read("import_batches"), "id", "source", "file_name", "rows_parsed", "rows_imported", "rows_duplicate", "rows_failed") == [
        ("b1", "OCR", "b1.csv", 2, 2, 0, 1), ("b2", "OCR", "b2.csv", 2, 1, 1, 0)
    ]
    assert rows(store.read("transactions"), "merchant_key", "import_batch_id") == [("A", "b1"), ("B", "b1"), ("C", "b2")]
    assert rows(store.read("transactions", 1), "merchant_key") == [("A",), ("B",)]  # as it was
    assert {r["imported_at"] for r in store.read("import_batches").collect()} == {WHEN}


def test_an_import_leaves_only_its_store_behind(spark, tmp_path):
    left = lambda: {p.name for p in Path(shared.shared_folder(spark).removeprefix("file:")).glob("import-*")}
    before, store = left(), snapshots.Store(spark, str(tmp_path / "store"))
    imports.publish_import(store, *importing(spark, "b1", "b2"), imported_at=WHEN)
    assert left() == before and store.read("transactions").count() == 3


def test_two_jobs_at_once(spark, tmp_path, monkeypatch):
    """The second finds the number taken, and starts again from what the first published."""
    store = snapshots.Store(spark, str(tmp_path / "store"))
    point, raced = snapshots.Store._point, []

    def late(self, snapshot):
        if not raced:
            raced.append(1)
            imports.publish_import(snapshots.Store(spark, self.root), *importing(spark, "b1"), imported_at=WHEN)
        point(self, snapshot)

    monkeypatch.setattr(snapshots.Store, "_point", late)
    assert imports.publish_import(store, *importing(spark, "b1", "b2"), imported_at=WHEN).number == 2
    assert rows(store.read("transactions"), "merchant_key") == [("A",), ("B",), ("C",)]
    assert rows(store.read("import_batches"), "id") == [("b1",), ("b2",)]
    with pytest.raises(snapshots.Conflict):
        store.publish(snapshots.Snapshot(1, store.snapshot(1).folders, {}))


def test_undo_and_compaction_are_published(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path / "store"))
    imports.publish_import(store, *importing(spark, "b1"), imported_at=WHEN)
    imports.publish_import(store, *importing(spark, "b2"), imported_at=WHEN, mark=("s", 4))
    assert imports.publish_import(store, *importing(spark, "b7"), imported_at=WHEN, mark=("s", 4)).number == 2
    held = [rows(store.read(t)) for t in snapshots.TABLES]
    assert [len(f) for f in store.compacted().folders.values()] == [1, 1, 1] and [rows(store.read(t)) for t in snapshots.TABLES] == held
    assert imports.publish_undo(store, "other", "b1") == 0 and imports.publish_undo(store, "L", "b1") == 2
    assert [rows(store.read(t)) for t in snapshots.TABLES][:2] == [[r for r in held[0] if "b1" not in r], [r for r in held[1] if "b1" not in r]]
    assert store.read("problems").count() == 0 and store.snapshot().marks == {"s": 4} and store.versions() == [1, 2, 3, 4, 5]


OFX = "<OFX><CURDEF>USD<ACCTID>000987654321<STMTTRN><TRNTYPE>DEBIT<DTPOSTED>20260314120000[-8:PST]<TRNAMT>-4.75<FITID>1<NAME>SQ *BLUE BOTTLE COFFEE<MEMO>OAKLAND CA</STMTTRN>"
OFX2 = "<?xml version='1.0'?><OFX><CURDEF>USD</CURDEF><STMTTRN><DTPOSTED>20260314</DTPOSTED><TRNAMT>-4.75</TRNAMT><NAME>A</NAME></STMTTRN><STMTTRN><DTPOSTED>x</DTPOSTED></STMTTRN></OFX>"
QIF = "!Type:Bank\nD03/14'26\nT-4.75\nPSQ *BLUE BOTTLE COFFEE\nMOAKLAND CA\n^\nD3/13/2026\nU2,500.00\nN1042"
FILES = {
    "chase.csv": 'Details,Posting Date,Description,Amount,Type,Balance,Check or Slip #\nDEBIT,03/14/2026,"SMITH, JOHN ""JJ""",-4.75,X,1,\nDEBIT,bad,SHOP,-1,X,1,\nDEBIT,03/14/2026,Ending Balance,5,X,1,\nDEBIT,x\n',
    "amex.csv": "﻿Date,Description,Amount\r\n03/14/2026,SHOP,42.99\r\n",
    "split.csv": "Value Date;Narrative;Withdrawal;Deposit\n13/02/2026;A, B, C;5,75;\n14/02/2026;D;;120,00\n",
    "guess.csv": "Col1,Col2,Col3\n03/14/2026,COFFEE SHOP,-4.75\n03/15/2026,BOOK STORE,-14.75\n",
    "none.csv": "hello\nworld\n",
    "blank.csv": " \n\n \n",
    "bom.csv": "\ufeff",
    "one.ofx": OFX,
    "two.qfx": OFX2,
    "empty.ofx": "<OFX></OFX>",
    "bank.qif": QIF,
}


def write(folder):
    for name, text in FILES.items():
        (folder / name).write_text(text, encoding="utf-8")


def test_statements(spark, tmp_path):
    write(tmp_path)
    got = statements.read_statements(spark, str(tmp_path))
    name = "regexp_extract(file, '[^/]*$', 0) as f"
    parsed_rows = rows(got.parsed.selectExpr(name, "posted_date", "amount_minor", "raw_description", "institution_transaction_id"))
    assert parsed_rows == sorted(
        [
            ("chase.csv", D, -475, 'SMITH, JOHN "JJ"', None),
            ("amex.csv", D, -4299, "SHOP", None),
            ("split.csv", dt.date(2026, 2, 13), -575, "A, B, C", None),
            ("split.csv", dt.date(2026, 2, 14), 12000, "D", None),
            ("guess.csv", D, -475, "COFFEE SHOP", None),
            ("guess.csv", dt.date(2026, 3, 15), -1475, "BOOK STORE", None),
            ("one.ofx", D, -475, "SQ *BLUE BOTTLE COFFEE OAKLAND CA", "1"),
            ("two.qfx", D, -475, "A", None),
            ("bank.qif", D, -475, "SQ *BLUE BOTTLE COFFEE OAKLAND CA", None),
            ("bank.qif", dt.date(2026, 3, 13), 250000, "CHECK 1042", None),
        ],
        key=repr,
    )
    problems = rows(got.problems.selectExpr(name, "location", "severity"))
    assert problems == sorted(
        [
            ("chase.csv", "line 3", "ERROR"),
            ("chase.csv", "line 4", "WARNING"),
            ("chase.csv", "line 5", "ERROR"),
            ("guess.csv", "line 1", "ERROR"),  # Col1 reads as an amount, so the row is no header
            ("none.csv", "file", "ERROR"),
            ("blank.csv", "file", "ERROR"),
            ("bom.csv", "file", "ERROR"),
            ("two.qfx", "transaction 2", "ERROR"),
            ("empty.ofx", "file", "ERROR"),
        ],
        key=repr,
    )
    counts, first = statements.preview(got, 1)
    assert counts.filter("rows = 2 and more = 1").count() == 3 and first.count() == 7
    assert rows(statements.with_format(spark.createDataFrame([("x.QFX", OFX), ("y", QIF), ("z", "!Account\n")], "file string, content string")), "format") == [("CSV",), ("QFX",), ("QIF",)]
    assert rows(statements.ofx_accounts(spark.createDataFrame([("x", OFX)], "file string, content string")), "account_mask") == [("4321",)]


def test_blank_empty_and_null_files(spark):
    files = statements.with_format(spark.createDataFrame([("a.csv", ""), ("b.csv", None), ("c.csv", "\n \n"), ("d.csv", "\ufeff"), ("e.csv", "\ufeff\n")], "file string, content string"))
    assert statements.csv_rows(files).count() == 0
    got = statements.parse_statements(files)
    assert got.parsed.count() == 0 and rows(got.problems, "file", "message") == [(f"{c}.csv", "No rows found") for c in "abcde"]
    assert rows(statements.preview(got)[0]) == [(f"{c}.csv", 0, 1, 0) for c in "abcde"]


HEAD = "Date,Description,Amount,Running Bal.\n"


def test_stream_adds_what_is_missing(spark, tmp_path):
    drop, root = tmp_path / "drop", str(tmp_path / "ledger")
    drop.mkdir()
    seen = []
    told = lambda change: seen.append((change.transactions.count(), change.new_rows.count(), rows(change.ledgers)))
    go = lambda: run_import_stream(statement_stream(spark, str(drop)), root, str(tmp_path / "checkpoint"), ledger_id="L", account_id="A", on_change=told, clock=lambda: WHEN)
    (drop / "a.csv").write_text(HEAD + "03/14/2026,SHOP,-1.00,5\n03/15/2026,SHOP,-2.00,3\n")
    q = go()
    q.processAllAvailable()
    (drop / "b.csv").write_text(HEAD + "03/15/2026,SHOP,-2.00,3\n03/16/2026,SHOP,-3.00,0\nsoon,SHOP,-3.00,0\n")
    (drop / "c.csv").write_text("")  # Spark's file sources have no row for a file of no bytes
    (drop / "d.csv").write_text("\n \n")
    q.processAllAvailable()
    q.stop()
    store = snapshots.Store(spark, root)
    assert [s[:2] for s in seen] == [(2, 2), (3, 1)] and seen[1][2] == [("L",)] and store.read("transactions").count() == 3
    records = [("a.csv", "A", "CSV", 2, 2, 0, 0), ("b.csv", "A", "CSV", 2, 1, 1, 1), ("d.csv", "A", "CSV", 0, 0, 0, 1)]
    assert rows(store.read("import_batches"), "file_name", "account_id", "source", "rows_parsed", "rows_imported", "rows_duplicate", "rows_failed") == records
    assert rows(store.read("problems"), "location", "severity") == [("file", "ERROR"), ("line 4", "ERROR")]
    # The last epoch runs once more, as after a failure between its publication and its commit.
    for f in (tmp_path / "checkpoint" / "commits").glob("*1*"):
        f.unlink()
    q = go()
    q.processAllAvailable()
    q.stop()
    assert store.snapshot().number == 2 and rows(store.read("import_batches"), "file_name", "account_id", "source", "rows_parsed", "rows_imported", "rows_duplicate", "rows_failed") == records
    assert store.read("transactions").count() == 3 and store.read("problems").count() == 2 and len(seen) == 2


def test_ledgers_of_equal_names_do_not_count_together(spark):
    """Two ledgers with one batch and account name, and the same charge: each numbers its own, and importing again adds nothing."""
    one = parsed(spark, [("COFFEE", -500, None), ("COFFEE", -500, None)], "b1", 1)
    both = one.withColumn("ledger_id", F.lit("L1")).unionByName(one.withColumn("ledger_id", F.lit("L2")))
    empty = imports.enrich(both.filter(F.lit(False))).select(*imports.LEDGER_COLUMNS)
    enriched = imports.enrich(both)
    assert rows(enriched, "ledger_id", "occurrence") == [("L1", 0), ("L1", 1), ("L2", 0), ("L2", 1)]
    ledger = imports.insert_new(enriched, empty).select(*imports.LEDGER_COLUMNS)
    assert ledger.count() == 4
    for name in ("L1", "L2"):
        assert imports.insert_new(imports.enrich(both.filter(F.col("ledger_id") == name)), ledger).count() == 0
