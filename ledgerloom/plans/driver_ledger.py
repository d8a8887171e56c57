"""Ledgers derived from the star-schema tables, so that ledger queries have data that grows with them.

The rhythm ledger has a merchant per customer, charged in one of the seven cadences, with skipped, varying,
extra and repeated charges, price steps, transfers and credits. The noise ledger has a row per order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.reference import CATALOGUE, CITIES, STATES

AS_OF = "2023-06-30"
#: A customer makes some eight transactions, so that a task has 40,000 or so.
CUSTOMERS_A_TASK = 5_000
NAMES = [m for names in CATALOGUE.values() for m in names.split(", ")]


def rhythm_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in NAMES])
    k = F.col("k")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("k")).withColumns(
        {
            "ledger_id": F.expr("concat('L', (k div 10) % 50)"),
            "merchant_key": F.when(k.between(1, len(NAMES)), F.try_element_at(names, k.cast("int"))).otherwise(F.concat(F.lit("MERCHANT "), k.cast("string"))),
        }
    )
    # Keys alone are a few MB: they would be one task's, and with them all the rows that they make, to be sorted for partial sums. Dealt by what charges
    # are grouped by, rows need not be dealt again into as many partitions as the session has, however many they are.
    customers = customers.repartition(customers.count() // CUSTOMERS_A_TASK + 1, "ledger_id", "merchant_key")
    charges = (
        customers.withColumns(
            {
                "start": F.expr("case when k % 13 = 0 then date'2022-01-31' else date_add(date'2022-01-01', cast(k * 37 % 300 as int)) end"),
                "n": F.expr("cast(3 + k % 10 as int)"),
                "base": F.expr("500 + (k * 7919) % 5000"),
            }
        )
        .withColumn(
            "i",
            F.explode(
                F.expr("concat(filter(sequence(0, n - 1), i -> not (k % 11 = 0 and i = 2)), if(k % 4 = 1, array(100), array()), if(k % 6 = 2, array(200), array()))")
            ),
        )
        .withColumn("j", F.expr("case when i = 200 then 1 else i end"))
        .withColumn(
            "posted_date",
            F.expr(
                """case when i = 100 then date_add(start, cast(11 + k % 40 as int))
                        when k % 7 < 3 then date_add(start, cast(case k % 7 when 0 then 7 when 1 then 14 else 28 end * j as int))
                        else add_months(start, cast(case k % 7 when 3 then 1 when 4 then 3 when 5 then 6 else 12 end * j as int)) end"""
            ),
        )
        .withColumn("priced", F.expr("case when i < 100 and k % 5 = 0 and i >= n - (2 + k % 2) then base * (103 + k % 28) div 100 when i = 100 then base + 7 when i = 200 then base + 3 else base end"))
        .withColumn("size", F.expr("case when i < 100 and k % 3 = 0 then priced + (i * 977 + k * 31) % greatest(1, priced * 6 div 10) else priced end"))
    )
    return charges.select(
        "ledger_id",
        F.expr("concat(lpad(k, 10, '0'), '-', lpad(i, 4, '0'))").alias("id"),
        F.expr("concat('A', k % 3)").alias("account_id"),
        "posted_date",
        F.expr("case when k % 19 = 0 then size else -size end").alias("amount_minor"),
        F.lit("USD").alias("currency"),
        "merchant_key",
        F.expr("k % 17 = 0").alias("is_transfer"),
    )


RHYTHM_SQL = (
    """
    c AS (SELECT c_custkey::BIGINT AS k FROM customer),
    c2 AS (SELECT k, CASE WHEN k % 13 = 0 THEN DATE '2022-01-31' ELSE DATE '2022-01-01' + (k * 37 % 300)::INTEGER END AS start, (3 + k % 10)::INTEGER AS n,
        500 + (k * 7919) % 5000 AS base FROM c),
    c3 AS (SELECT *, unnest(list_concat(list_concat(list_filter(range(0, n), lambda i: NOT (k % 11 = 0 AND i = 2)), CASE WHEN k % 4 = 1 THEN [100] ELSE [] END),
        CASE WHEN k % 6 = 2 THEN [200] ELSE [] END)) AS i FROM c2),
    c4 AS (SELECT *, CASE WHEN i = 200 THEN 1 ELSE i END AS j FROM c3),
    c5 AS (SELECT *, (CASE WHEN i = 100 THEN start + (11 + k % 40)::INTEGER
            WHEN k % 7 < 3 THEN start + ((CASE k % 7 WHEN 0 THEN 7 WHEN 1 THEN 14 ELSE 28 END) * j)::INTEGER
            ELSE start + to_months(((CASE k % 7 WHEN 3 THEN 1 WHEN 4 THEN 3 WHEN 5 THEN 6 ELSE 12 END) * j)::INTEGER) END)::DATE AS posted_date,
        CASE WHEN i < 100 AND k % 5 = 0 AND i >= n - (2 + k % 2) THEN base * (103 + k % 28) // 100 WHEN i = 100 THEN base + 7 WHEN i = 200 THEN base + 3 ELSE base END AS priced
        FROM c4),
    c6 AS (SELECT *, CASE WHEN i < 100 AND k % 3 = 0 THEN priced + (i * 977 + k * 31) % greatest(1, priced * 6 // 10) ELSE priced END AS size FROM c5),
    tx AS (SELECT 'L' || ((k // 10) % 50) AS ledger_id, lpad(k::VARCHAR, 10, '0') || '-' || lpad(i::VARCHAR, 4, '0') AS id, 'A' || (k % 3) AS account_id, posted_date,
        CASE WHEN k % 19 = 0 THEN size ELSE -size END AS amount_minor, 'USD' AS currency,
        CASE WHEN k BETWEEN 1 AND """
    + str(len(NAMES))
    + " THEN ["
    + ", ".join(f"'{n}'" for n in NAMES)
    + """][k::INTEGER] ELSE 'MERCHANT ' || k END AS merchant_key,
        k % 17 = 0 AS is_transfer FROM c6)"""
)


def noise_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per order: ledger and account by customer, descriptor in one of many dresses by the order's number. Ledgers use the same names for accounts and batches."""
    key = F.col("o_orderkey")
    descriptor = F.expr(
        """case cast(o_orderkey % 12 as int)
             when 0 then concat('SQ *BLUE BOTTLE COFFEE #', o_custkey % 90, ' OAKLAND CA')
             when 1 then concat('NETFLIX.COM 866-579-', lpad(o_custkey % 10000, 4, '0'), ' CA')
             when 2 then concat('AMZN Mktp US*2A3B4C', o_custkey % 100, 'D')
             when 3 then concat('POS DEBIT STARBUCKS STORE ', lpad(o_custkey % 1000, 5, '0'), ' SEATTLE WA')
             when 4 then concat('RECURRING PAYMENT HULU ', o_orderkey % 1000 + 10000)
             when 5 then concat('PAYPAL *SQ *CORNER SHOP ', o_custkey % 50, ' of ', o_orderpriority)
             when 6 then concat('PURCHASE AUTHORIZED ON 05/', lpad(1 + o_custkey % 28, 2, '0'), ' SAFEWAY #', o_custkey, ' SAN FRANCISCO CA')
             when 7 then concat('  Trader  Joe''s  #', o_custkey % 300, '  ')
             when 8 then concat('ACH DEBIT UTILITY ', o_custkey % 40, ' INC ONLINE PAYMENT')
             when 9 then cast(1000000 + o_orderkey as string)
             when 10 then concat('CUSTOMER ', o_custkey, ' LLC ', city, ' ', state)
             else '#### ####' end"""
    )
    places = {"city": F.get(F.array(*map(F.lit, CITIES)), F.expr(f"cast(o_orderkey div 12 % {len(CITIES)} as int)")), "state": F.get(F.array(*map(F.lit, STATES)), F.expr(f"cast(o_orderkey div 12 % {len(STATES)} as int)"))}
    return spark.read.parquet(f"{sf_dir}/orders.parquet").withColumns(places).select(
        F.concat(F.lit("L"), F.col("o_custkey") % 50).alias("ledger_id"),
        F.lpad(key.cast("string"), 12, "0").alias("id"),
        F.expr("cast(o_custkey div 50 as string)").alias("account_id"),
        F.to_date("o_orderdate").alias("posted_date"),
        (-F.round(F.col("o_totalprice").cast("decimal(15,2)") * 100, 0)).cast("bigint").alias("amount_minor"),
        F.lit("USD").alias("currency"),
        descriptor.alias("raw_description"),
        F.when(key % 3 == 0, F.concat(F.lit("C"), key % 7)).alias("category_id"),
        F.concat(F.lit("B"), (key / 12).cast("long") % 4).alias("batch_id"),
        key.cast("long").alias("source_pos"),
        F.when(key % 5 != 0, F.concat(F.lit("F"), (key / 2).cast("long"))).alias("institution_transaction_id"),
        F.lit(False).alias("is_pending"),
    )


NOISE_SQL = f"""
    noise AS (SELECT 'L' || (o_custkey % 50) AS ledger_id, lpad(o_orderkey::VARCHAR, 12, '0') AS id, (o_custkey // 50)::VARCHAR AS account_id, o_orderdate::DATE AS posted_date,
        -round(o_totalprice::DECIMAL(15,2) * 100)::BIGINT AS amount_minor, 'USD' AS currency,
        CASE o_orderkey % 12
             WHEN 0 THEN 'SQ *BLUE BOTTLE COFFEE #' || (o_custkey % 90) || ' OAKLAND CA'
             WHEN 1 THEN 'NETFLIX.COM 866-579-' || lpad((o_custkey % 10000)::VARCHAR, 4, '0') || ' CA'
             WHEN 2 THEN 'AMZN Mktp US*2A3B4C' || (o_custkey % 100) || 'D'
             WHEN 3 THEN 'POS DEBIT STARBUCKS STORE ' || lpad((o_custkey % 1000)::VARCHAR, 5, '0') || ' SEATTLE WA'
             WHEN 4 THEN 'RECURRING PAYMENT HULU ' || (o_orderkey % 1000 + 10000)
             WHEN 5 THEN 'PAYPAL *SQ *CORNER SHOP ' || (o_custkey % 50) || ' of ' || o_orderpriority
             WHEN 6 THEN 'PURCHASE AUTHORIZED ON 05/' || lpad((1 + o_custkey % 28)::VARCHAR, 2, '0') || ' SAFEWAY #' || o_custkey || ' SAN FRANCISCO CA'
             WHEN 7 THEN '  Trader  Joe''s  #' || (o_custkey % 300) || '  '
             WHEN 8 THEN 'ACH DEBIT UTILITY ' || (o_custkey % 40) || ' INC ONLINE PAYMENT'
             WHEN 9 THEN (1000000 + o_orderkey)::VARCHAR
             WHEN 10 THEN 'CUSTOMER ' || o_custkey || ' LLC ' || {CITIES}[(o_orderkey // 12 % {len(CITIES)} + 1)::INTEGER] || ' ' || {STATES}[(o_orderkey // 12 % {len(STATES)} + 1)::INTEGER]
             ELSE '#### ####' END AS raw_description,
        CASE WHEN o_orderkey % 3 = 0 THEN 'C' || (o_orderkey % 7) END AS category_id, 'B' || (o_orderkey // 12 % 4) AS batch_id, o_orderkey::BIGINT AS source_pos,
        CASE WHEN o_orderkey % 5 <> 0 THEN 'F' || (o_orderkey // 2) END AS institution_transaction_id FROM orders)"""
