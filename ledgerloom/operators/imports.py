"""Import of parsed rows into a ledger: fingerprints, insert-if-new, batch accounting, undo."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.merchants import with_merchant_key
from ..sources.shared import discard, fresh_path, settled, stored
from ..sources.snapshots import Conflict, Snapshot, Store, Unfinished

UNIT = "\u001f"
#: Sources whose rows a person has to look at.
REVIEWED_SOURCES = ("OCR", "PDF_TEXT")


#: So many accounts or fewer are named to the scan of the ledger, which skips files by their statistics.
NAMED_ACCOUNTS = 1000
#: So many batches or fewer are sent to every task that picks their rows, which then are not dealt for it.
NAMED_BATCHES = 100_000


class ImportOutcome(NamedTuple):
    """summary: ledger_id, batch_id, rows_parsed, rows_imported, rows_duplicate, rows_failed, likely_reimport, needs_review, imported_at."""

    new_rows: DataFrame
    summary: DataFrame
    problems: DataFrame


def dedup_hash(account_id: Column, posted_date: Column, amount_minor: Column, merchant_key: Column, occurrence: Column) -> Column:
    """SHA-256 of what makes a transaction itself. The currency and the wording are no part of it."""
    return F.sha2(F.concat_ws(UNIT, account_id, posted_date.cast("string"), amount_minor.cast("string"), merchant_key, occurrence.cast("string")), 256)


def number_repeats(parsed: DataFrame, batch: str = "batch_id") -> DataFrame:
    """parsed with occurrence. Equal rows of one ledger's batch are numbered in source order, so a day's repeats are
    kept apart and yet meet themselves on re-import. Ledgers may use the same names for batches and accounts."""
    same = Window.partitionBy("ledger_id", batch, "account_id", "posted_date", "amount_minor", "merchant_key").orderBy("source_pos")
    return parsed.withColumn("occurrence", F.row_number().over(same) - 1)


def with_hash(numbered: DataFrame) -> DataFrame:
    return numbered.withColumn("dedup_hash", dedup_hash(*[F.col(c) for c in ("account_id", "posted_date", "amount_minor", "merchant_key", "occurrence")]))


def assign_hashes(parsed: DataFrame, batch: str = "batch_id") -> DataFrame:
    """parsed with occurrence and dedup_hash."""
    return with_hash(number_repeats(parsed, batch))


def with_ledger_columns(numbered: DataFrame, batch: str = "batch_id") -> DataFrame:
    """What rows of the transactions table have besides, all of it told from the row: hash, and an id that a rerun makes again."""
    fresh = {
        "id": _row_id(batch),
        "import_batch_id": F.col(batch),
        "category_id": F.lit(None).cast("string"),
        "is_transfer": F.lit(False),
        "notes": F.lit(None).cast("string"),
        "tags": F.array().cast("array<string>"),
    }
    return with_hash(numbered).withColumns(fresh)


#: Columns that `with_ledger_columns` sets, whatever the parsed rows had there.
LATE_COLUMNS = ["id", "dedup_hash", "import_batch_id", "category_id", "is_transfer", "notes", "tags"]


def _row_id(batch: str = "batch_id") -> Column:
    return F.sha2(F.concat_ws(UNIT, F.col("ledger_id"), F.col(batch), F.col("source_pos").cast("string")), 256)


def enrich(parsed: DataFrame, account_id: str | None = None, batch: str = "batch_id") -> DataFrame:
    """Rows of the transactions table from parsed rows: key, hash, and an id that a rerun makes again."""
    rows = parsed if account_id is None else parsed.withColumn("account_id", F.lit(account_id))
    return with_ledger_columns(number_repeats(with_merchant_key(rows), batch), batch)


LEDGER_COLUMNS = (
    "ledger_id id account_id posted_date amount_minor currency raw_description merchant_key category_id dedup_hash import_batch_id "
    "institution_transaction_id is_pending is_transfer notes tags"
).split()


KEYS = ["ledger_id", "account_id"]


def of_accounts(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """The ledger's rows of the accounts that `rows` has: what an import can meet. Few accounts are pushed into the scan."""
    few = rows.select(*KEYS).distinct().limit(NAMED_ACCOUNTS + 1).collect()
    if len(few) > NAMED_ACCOUNTS:
        return ledger.join(rows.select(*KEYS).distinct(), KEYS, "left_semi")
    ledgers, accounts = ({r[c] for r in few} - {None} for c in KEYS)
    return ledger.filter(F.col("ledger_id").isin(*ledgers) & F.col("account_id").isin(*accounts)) if few else ledger.limit(0)


def _unknown(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """The rows of which the ledger has neither key: first what it has by hash goes, of the rest what it has by institution id."""
    held = of_accounts(ledger, rows)
    rows = rows.join(held.select(*BY_HASH), BY_HASH, "left_anti")
    return rows.join(held.filter(F.col("institution_transaction_id").isNotNull()).select(*BY_FITID), BY_FITID, "left_anti")


BY_HASH = ["ledger_id", "dedup_hash"]
BY_FITID = ["ledger_id", "account_id", "institution_transaction_id"]


def insert_new(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Of one batch's enriched rows, those that neither unique key rejects: the hash, and (account, institution id) where there is
    one. A row that the hash rejects does not count for the second key."""
    rows = _unknown(rows, ledger)
    first = F.row_number().over(Window.partitionBy(*BY_FITID).orderBy("source_pos"))
    # Rows without an institution id are spread by their own hash, not gathered under the null.
    with_id = rows.filter(F.col("institution_transaction_id").isNotNull()).withColumn("_n", first).filter("_n = 1").drop("_n")
    return rows.filter(F.col("institution_transaction_id").isNull()).unionByName(with_id)


def batch_summary(enriched: DataFrame, new_rows: DataFrame, problems: DataFrame, batch: str = "batch_id", *, source: Column | None = None, imported_at: dt.datetime | None = None) -> DataFrame:
    """A row per ledger and batch, batches of problems only among them: ledger_id, batch_id, rows_parsed, rows_imported,
    rows_duplicate, rows_failed, likely_reimport, needs_review, imported_at. source: of the parsed rows, one per batch; without it
    nothing needs review. Ledgers may use the same names for batches."""
    zero, one = F.lit(0).cast("bigint"), F.count(F.lit(1))
    none = F.lit(None).cast("string")
    by = F.col("ledger_id"), F.col(batch).alias("batch_id")
    counts = [
        enriched.groupBy(*by).agg(one.alias("p"), zero.alias("i"), zero.alias("f"), (none if source is None else F.max(source)).alias("s")),
        new_rows.groupBy(*by).agg(zero.alias("p"), one.alias("i"), zero.alias("f"), none.alias("s")),
        problems.groupBy(*by).agg(zero.alias("p"), zero.alias("i"), F.count_if(F.col("severity") == "ERROR").alias("f"), none.alias("s")),
    ]
    total = counts[0].unionByName(counts[1]).unionByName(counts[2]).groupBy("ledger_id", "batch_id")
    total = total.agg(F.sum("p").alias("rows_parsed"), F.sum("i").alias("rows_imported"), F.sum("f").alias("rows_failed"), F.max("s").alias("source"))
    duplicate = F.col("rows_parsed") - F.col("rows_imported")
    return total.select(
        "ledger_id",
        "batch_id",
        "rows_parsed",
        "rows_imported",
        duplicate.alias("rows_duplicate"),
        "rows_failed",
        likely_reimport(F.col("rows_parsed"), duplicate).alias("likely_reimport"),
        F.coalesce(needs_review(F.col("source")), F.lit(False)).alias("needs_review"),
        F.lit(imported_at).cast("timestamp").alias("imported_at"),
    )


def batch_records(batches: DataFrame, enriched: DataFrame, new_rows: DataFrame, problems: DataFrame, imported_at: dt.datetime) -> DataFrame:
    """The record of each batch (ledger_id, id, account_id, source, file_name), whether or not anything was read from it, with
    likely_reimport and needs_review."""
    counts = batch_summary(enriched, new_rows, problems).drop("imported_at", "needs_review").withColumnRenamed("batch_id", "id")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    joined = batches.select("ledger_id", "id", "account_id", "source", "file_name").join(counts, ["ledger_id", "id"], "left")
    return joined.select(
        "ledger_id",
        "id",
        "account_id",
        "source",
        F.lit(imported_at).cast("timestamp").alias("imported_at"),
        "file_name",
        *[zero(c) for c in ("rows_parsed", "rows_imported", "rows_duplicate", "rows_failed")],
        F.coalesce("likely_reimport", F.lit(False)).alias("likely_reimport"),
        F.coalesce(needs_review(F.col("source")), F.lit(False)).alias("needs_review"),
    )


def likely_reimport(parsed: Column, duplicate: Column) -> Column:
    """More than nine tenths of the rows were there already."""
    return (parsed > 0) & (duplicate * 10 > parsed * 9)


def needs_review(source: Column) -> Column:
    return source.isin(*REVIEWED_SOURCES)


def import_batch(ledger: DataFrame, parsed: DataFrame, problems: DataFrame, account_id: str | None = None, *, source: str | None = None, imported_at: dt.datetime | None = None) -> ImportOutcome:
    """One batch's parsed rows against the ledger. `publish_import` also writes what comes of it."""
    enriched = enrich(parsed, account_id)
    new_rows = insert_new(enriched, ledger)
    return ImportOutcome(new_rows, batch_summary(enriched, new_rows, problems, source=F.lit(source) if source else None, imported_at=imported_at), problems)


def import_many(ledger: DataFrame, parsed: DataFrame, batch_order: str = "batch_seq") -> DataFrame:
    """The new rows of many batches at once, as if imported one after another by batch_order. What they are read from stays in the shared folder."""
    folder = fresh_path(parsed.sparkSession, "import")
    return with_ledger_columns(new_of_many(numbered_table(parsed, folder), ledger, folder, batch_order))


def numbered_table(parsed: DataFrame, folder: str) -> DataFrame:
    """The parsed rows with merchant key and occurrence, as a table in the folder. Ids and hashes, which hardly compress, are told from them when asked for."""
    return stored(number_repeats(with_merchant_key(parsed.drop(*LATE_COLUMNS))), f"{folder}/rows")


def _digest(name: str, columns: list[str]) -> Column:
    """128 bits that stand for a key: the lengths tell where its parts end, and a null from an empty part."""
    lengths = [F.coalesce(F.length(c), F.lit(-1)).cast("string") for c in columns]
    return _half(F.sha2(F.concat_ws(UNIT, F.lit(name), *lengths, *columns), 256))


def _half(sha: Column) -> Column:
    return F.unhex(F.substring(sha, 1, 32))


def _keys(rows: DataFrame, place: Column, known: bool) -> DataFrame:
    """place, key: a row's hash and, where it has one, its institution id. known: of rows that are in the ledger; a null in their key meets nothing."""
    whole = lambda columns: F.forall(F.array(*columns), lambda c: c.isNotNull())
    by_hash, by_id = _digest("hash", BY_HASH), F.when(F.col("institution_transaction_id").isNotNull(), _digest("id", BY_FITID))
    if known:
        by_hash, by_id = F.when(whole(BY_HASH), by_hash), F.when(whole(BY_FITID), by_id)
    return rows.select(place.alias("place"), F.explode(F.array_compact(F.array(by_hash, by_id))).alias("key"))


def new_of_many(rows: DataFrame, ledger: DataFrame, folder: str, batch_order: str = "batch_seq") -> DataFrame:
    """Of the numbered rows of many batches, those that are new when taken in order. rows: a table, as they are read more than once.

    A row's keys are its hash and, where it has one, its institution id. A row is new if neither the ledger nor a new row before it has one of
    its keys. Most keys are those of one row only, and so most rows are new without a look at their place. Of the others, in each round the rows
    that come first under all of their keys are new, and those that share a key with one of them or with the ledger are not; both go, and the rest is looked at
    again, until nothing is left. A round more is needed only where a row waits for one that itself waits. Rows are dealt by key, never by account,
    and first ones are found by partial aggregation, so neither a large account nor a frequent key makes a large task.
    """
    spark = rows.sparkSession
    # A digest stands for each key and id. The hash is computed from the row where it is needed.
    own = _keys(with_hash(rows), F.struct(F.col(batch_order).alias("batch"), F.col("source_pos").alias("pos"), _half(_row_id()).alias("id")), known=False)
    held = _keys(of_accounts(ledger, rows), F.lit(None).cast(own.schema["place"].dataType), known=True)
    keys = own.unionByName(held)
    # Eight bytes tell the keys that may be of several rows: what is dealt for all rows is short, and only keys that may be shared go on.
    short = keys.select(F.xxhash64("key").alias("short"), F.col("place").isNotNull().alias("own"))
    shared = short.groupBy("short").agg(F.count(F.lit(1)).alias("n"), F.bool_or("own").alias("own")).filter("n > 1 and own").select("short")
    left = stored(keys.join(shared, F.xxhash64("key") == F.col("short"), "left_semi"), f"{folder}/keys-0")
    lost = []
    while not left.filter("place is not null").isEmpty():
        n = len(lost)
        first = left.groupBy("key").agg(F.min("place").alias("first"), F.bool_or(F.col("place").isNull()).alias("held"))
        wins = (F.col("place") == F.col("first")) & ~F.col("held")
        placed = left.filter("place is not null").join(first, "key").select("key", "place", F.col("place.id").alias("id"), F.col("first.id").alias("behind"), "held", wins.alias("wins"))
        placed = stored(placed, f"{folder}/placed-{n}")
        won = placed.groupBy(F.col("id").alias("winner")).agg(F.bool_and("wins").alias("new")).filter("new").select("winner")
        taken = F.col("held") | F.col("winner").isNotNull()
        fate = placed.filter("not wins").select("id", "behind", "held").join(won, F.col("behind") == F.col("winner"), "left").groupBy("id").agg(F.bool_or(taken).alias("lost"))
        fate = stored(fate, f"{folder}/lost-{n}")
        lost.append(fate.filter("lost").select(F.col("id").alias("lost_id")))
        waiting = fate.filter("not lost").select(F.col("id").alias("waits"))
        left = stored(placed.join(waiting, F.col("id") == F.col("waits"), "left_semi").select("place", "key"), f"{folder}/keys-{n + 1}")
        for done in (f"keys-{n}", f"placed-{n}"):
            discard(spark, f"{folder}/{done}")
    return rows.join(reduce(DataFrame.unionByName, lost), _half(_row_id()) == F.col("lost_id"), "left_anti") if lost else rows


def publish_import(store: Store, batches: DataFrame, parsed: DataFrame, problems: DataFrame, *, imported_at: dt.datetime, mark: tuple[str, int] | None = None, attempts: int = 3) -> Snapshot:
    """Import batches into a store, all of it or nothing: new transactions, a record per batch, and the batches' problems become
    readable together, when the next snapshot is published.

    batches: ledger_id, id, account_id, source, file_name, batch_seq. parsed: parsed rows with ledger_id, batch_id, account_id,
    batch_seq, source_pos. problems: ledger_id, batch_id and what a problem has. Batches that the store has a record of are
    left out, so that importing once more adds nothing; so is an epoch (mark: a stream's name and its number) that is in.
    If another job publishes meanwhile, the import starts again from there.
    """
    for left in reversed(range(attempts)):
        base = store.snapshot()
        if mark and base.marks.get(mark[0], -1) >= mark[1]:
            return base
        known = store.read_folders("import_batches", base.folders["import_batches"]).select("ledger_id", "id")
        fresh = settled(batches.join(known, ["ledger_id", "id"], "left_anti"))
        if fresh.isEmpty() and not mark:
            return base
        of_fresh = fresh.select("ledger_id", F.col("id").alias("batch_id"))
        if fresh.count() <= NAMED_BATCHES:
            of_fresh = F.broadcast(of_fresh)
        own, wrong = (x.join(of_fresh, ["ledger_id", "batch_id"], "left_semi") for x in (parsed, problems))
        folder = fresh_path(store.spark, "import")
        try:
            rows = numbered_table(own, folder)
            held = store.read_folders("transactions", base.folders["transactions"])
            added = {"transactions": store.write("transactions", Unfinished(new_of_many(rows, held, folder), with_ledger_columns))}
            imported = store.read_folders("transactions", [added["transactions"]]).withColumnRenamed("import_batch_id", "batch_id")
            added["import_batches"] = store.write("import_batches", batch_records(fresh, rows, imported, wrong, imported_at))
            added["problems"] = store.write("problems", wrong)
            return store.publish(base, added=added, mark=mark)
        except Conflict:
            if not left:
                raise
        finally:
            discard(store.spark, folder)
    raise AssertionError("no attempt")


def undo_batch(transactions: DataFrame, batches: DataFrame, ledger_id: str, batch_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(transactions, batches, removed count) without the ledger's batch; other ledgers' batches of that name stay."""
    own = F.col("ledger_id") == ledger_id
    gone = F.coalesce(own & (F.col("import_batch_id") == batch_id), F.lit(False))
    return transactions.filter(~gone), batches.filter(~(own & (F.col("id") == batch_id))), transactions.filter(gone).agg(F.count(F.lit(1)).alias("removed"))


def publish_undo(store: Store, ledger_id: str, batch_id: str) -> int:
    """Take a batch back: its transactions, record and problems go in one snapshot. How many transactions went."""
    base = store.snapshot()
    tx, batches, removed = undo_batch(*(store.read_folders(t, base.folders[t]) for t in ("transactions", "import_batches")), ledger_id, batch_id)
    problems = store.read_folders("problems", base.folders["problems"]).filter(~((F.col("ledger_id") == ledger_id) & (F.col("batch_id") == batch_id)))
    n = removed.first()["removed"]
    store.publish(base, replaced={t: store.write(t, x) for t, x in (("transactions", tx), ("import_batches", batches), ("problems", problems))})
    return n


def default_account(accounts: DataFrame, ledger_id: str, account_id: str = "default") -> DataFrame:
    """The accounts, or one made up where there is none."""
    made = accounts.sparkSession.createDataFrame([(ledger_id, account_id, "My account", "", "CHECKING", "USD", None, False)], "ledger_id string, id string, display_name string, institution string, type string, currency string, mask string, is_archived boolean")
    return accounts.unionByName(made.join(accounts.select("ledger_id"), "ledger_id", "left_anti").select(*accounts.columns))
