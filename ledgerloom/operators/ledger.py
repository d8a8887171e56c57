"""Queries over the ledger tables and row edits as rewrites from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Ledger(NamedTuple):
    transactions: DataFrame
    import_batches: DataFrame
    accounts: DataFrame


# -- queries -----------------------------------------------------------------------------------


def accounts_by_name(accounts: DataFrame, *, archived: bool = False) -> DataFrame:
    """Active accounts by name; all of them with archived=True."""
    return (accounts if archived else accounts.filter(~F.col("is_archived"))).orderBy("display_name")


def categories_by_name(categories: DataFrame, *, archived: bool = False) -> DataFrame:
    return (categories if archived else categories.filter(~F.col("is_archived"))).orderBy("name")


def of_ledger(df: DataFrame, ledger_id: str) -> DataFrame:
    return df.filter(F.col("ledger_id") == ledger_id)


def by_id(df: DataFrame, ledger_id: str, value: str) -> DataFrame:
    """The ledger's account, category, batch or transaction of this id. Ledgers may use the same ids."""
    return of_ledger(df, ledger_id).filter(F.col("id") == value)


def batches_of_account(batches: DataFrame, ledger_id: str, account_id: str) -> DataFrame:
    return of_ledger(batches, ledger_id).filter(F.col("account_id") == account_id).orderBy(F.desc("imported_at"))


def recent_batches(batches: DataFrame, limit: int = 20) -> DataFrame:
    """Newest first."""
    return batches.orderBy(F.desc("imported_at")).limit(limit)


def account_page(tx: DataFrame, ledger_id: str, account_id: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of a ledger's account, newest first."""
    return of_ledger(tx, ledger_id).filter(F.col("account_id") == account_id).orderBy(F.desc("posted_date"), F.desc("id")).offset(offset).limit(limit)


def between(tx: DataFrame, start, end) -> DataFrame:
    """Transactions of these days, both included, newest first."""
    return tx.filter(F.col("posted_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).orderBy(F.desc("posted_date"), F.desc("id"))


def merchant_history(tx: DataFrame, merchant_key: str) -> DataFrame:
    return tx.filter(F.col("merchant_key") == merchant_key).orderBy("posted_date")


def full_history(tx: DataFrame) -> DataFrame:
    return tx.orderBy("posted_date", "id")


def transaction_count(tx: DataFrame) -> DataFrame:
    return tx.agg(F.count(F.lit(1)).alias("transactions"))


def existing_hashes(tx: DataFrame, hashes: DataFrame) -> DataFrame:
    """Those of the hashes (ledger_id, dedup_hash) that their ledger holds: a hash has nothing of the ledger in it."""
    key = ["ledger_id", "dedup_hash"]
    return hashes.select(*key).distinct().join(tx.select(*key), key, "left_semi")


def uncategorised_merchants(tx: DataFrame) -> DataFrame:
    return tx.filter(F.col("category_id").isNull()).select("merchant_key").distinct().orderBy("merchant_key")


# -- edits -------------------------------------------------------------------------------------


def upsert(base: DataFrame, updates: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of the base that no update replaces, and the updates. Updates must have one row per key."""
    return base.join(updates.select(*key), list(key), "left_anti").select(*base.columns).unionByName(updates.select(*base.columns))


def _where_listed(df: DataFrame, ids: DataFrame, column: str, value: Column) -> DataFrame:
    listed = ids.select(F.col("id").alias("_listed")).distinct()
    edited = F.when(F.col("_listed").isNotNull(), value).otherwise(F.col(column))
    return df.join(listed, F.col("id") == F.col("_listed"), "left").withColumn(column, edited).drop("_listed")


def assign_category(tx: DataFrame, ids: DataFrame, category_id: str | None) -> DataFrame:
    """Null clears it."""
    return _where_listed(tx, ids, "category_id", F.lit(category_id).cast("string"))


def mark_transfer(tx: DataFrame, ids: DataFrame, flag: bool = True) -> DataFrame:
    return _where_listed(tx, ids, "is_transfer", F.lit(flag))


def _is(ledger_id: str, column: str, value: str) -> Column:
    """Of this ledger, with this value; never null."""
    return F.coalesce((F.col("ledger_id") == ledger_id) & (F.col(column) == value), F.lit(False))


def delete_account(ledger: Ledger, ledger_id: str, account_id: str) -> Ledger:
    """The ledger's account goes with its transactions and batches."""
    stays = ~_is(ledger_id, "account_id", account_id)
    return Ledger(ledger.transactions.filter(stays), ledger.import_batches.filter(stays), ledger.accounts.filter(~_is(ledger_id, "id", account_id)))


def delete_batch(ledger: Ledger, ledger_id: str, batch_id: str) -> Ledger:
    """The batch's record goes; its transactions stay without it."""
    cleared = F.when(~_is(ledger_id, "import_batch_id", batch_id), F.col("import_batch_id"))
    return Ledger(ledger.transactions.withColumn("import_batch_id", cleared), ledger.import_batches.filter(~_is(ledger_id, "id", batch_id)), ledger.accounts)


def delete_category(tx: DataFrame, categories: DataFrame, ledger_id: str, category_id: str) -> tuple[DataFrame, DataFrame]:
    """The ledger's category goes; transactions and child categories stay without it."""
    without = lambda c: F.when(~_is(ledger_id, c, category_id), F.col(c))
    return tx.withColumn("category_id", without("category_id")), categories.filter(~_is(ledger_id, "id", category_id)).withColumn("parent_id", without("parent_id"))
