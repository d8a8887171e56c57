"""Declared schemas of the ledger tables, and reading and writing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARSED = (
    "file string, format string, source_pos bigint, posted_date date, amount_minor bigint, currency string, raw_description string, "
    "institution_transaction_id string, is_pending boolean, source_location string, confidence double"
)
PROBLEMS = "file string, location string, message string, severity string, raw_content string"
TRANSACTIONS = (
    "ledger_id string, id string, account_id string, posted_date date, amount_minor bigint, currency string, raw_description string, merchant_key string, "
    "category_id string, dedup_hash string, import_batch_id string, institution_transaction_id string, is_pending boolean, is_transfer boolean, notes string, tags array<string>"
)
ACCOUNTS = "ledger_id string, id string, display_name string, institution string, type string, currency string, mask string, is_archived boolean"
CATEGORIES = "ledger_id string, id string, name string, kind string, parent_id string, is_essential boolean, is_archived boolean"
IMPORT_BATCHES = (
    "ledger_id string, id string, account_id string, source string, imported_at timestamp, file_name string, rows_parsed bigint, rows_imported bigint, rows_duplicate bigint, rows_failed bigint"
)
BATCH_PROBLEMS = "ledger_id string, batch_id string, location string, message string, severity string, raw_content string"
MERCHANT_CLASSIFICATIONS = "ledger_id string, merchant_key string, service_class string, updated_at timestamp, display_name_override string"

# Allowed names.
ACCOUNT_TYPES = ["CHECKING", "SAVINGS", "CREDIT_CARD", "CASH", "INVESTMENT", "LOAN"]
CATEGORY_KINDS = ["INCOME", "EXPENSE", "TRANSFER"]
TAG_SEPARATOR = "\u001f"


def valid_account() -> Column:
    return (F.trim("display_name") != "") & (F.length(F.coalesce("mask", F.lit(""))) <= 4) & F.col("type").isin(ACCOUNT_TYPES)


def valid_category() -> Column:
    return (F.trim("name") != "") & (F.coalesce("parent_id", F.lit("")) != F.col("id")) & F.col("kind").isin(CATEGORY_KINDS)


def valid_batch() -> Column:
    return F.least("rows_parsed", "rows_imported", "rows_duplicate", "rows_failed") >= 0


def from_storage(rows: DataFrame) -> DataFrame:
    """Transactions as a row store keeps them (days since 1970, joined tags) to the declared types."""
    tags = F.when(F.coalesce("tags", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("tags", TAG_SEPARATOR))
    return rows.withColumns({"posted_date": F.date_from_unix_date(F.col("posted_date").cast("int")), "tags": tags})


def to_storage(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"posted_date": F.unix_date("posted_date"), "tags": F.nullif(F.array_join("tags", TAG_SEPARATOR), F.lit(""))})


def imported_at_from_millis(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def import_batches_from_storage(rows: DataFrame) -> DataFrame:
    """Batch records as a row store keeps them (milliseconds since 1970) to the declared types."""
    return rows.withColumn("imported_at", imported_at_from_millis(F.col("imported_at")))


def import_batches_to_storage(rows: DataFrame) -> DataFrame:
    return rows.withColumn("imported_at", F.unix_millis("imported_at"))


def of_names(column: Column, allowed: list[str]) -> Column:
    """An enumeration's value, kept by name; an unknown name raises in the row's task."""
    return F.when(column.isNull() | column.isin(allowed), column).otherwise(F.raise_error(F.concat(F.lit("not one of the allowed names: "), column)))


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
