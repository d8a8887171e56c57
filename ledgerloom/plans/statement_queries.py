"""Queries over statement files: every customer's orders written as a CSV, OFX or QIF file, and read again.

The SQL never sees the files: it says what should be read from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.reference import MAPPING, bank_profiles
from ..sources import statements
from ..sources.shared import settled
from .registry import query

#: A customer's layout is the key modulo these: four kinds of CSV, OFX, QIF.
COMMA, SEMICOLON, TAB, PIPE, OFX, QIF = range(6)
HEADS = {COMMA: "Trans Date,Payee,Amt", SEMICOLON: "Posting Date;Details;Debit;Credit", PIPE: "Value Date|Narrative|Amount|Balance"}

_NAME = "concat(substring(o_orderpriority, 3), ' item ', o_orderstatus)"
_LINES = {
    COMMA: """concat(case when o % 11 = 5 then 'someday' else date_format(d, 'yyyy-MM-dd') end, ',"',
        case when o % 13 = 6 then 'Total of the day' else concat(name, ', paid') end, '",', case when o % 7 = 3 then 'n/a' else concat('-', amount) end)""",
    SEMICOLON: "concat(date_format(d, 'dd/MM/yyyy'), ';', name, ';', case when o % 2 = 0 then concat(amount, ';') else concat(';', amount) end)",
    TAB: r"concat(date_format(d, 'dd MMM yyyy'), '\t', name, '\t(', amount, ')')",
    PIPE: """concat(date_format(d, 'MMM d, yyyy'), '|"say ""', name, '"" | or not"|', amount, '|0.00')""",
    OFX: """concat('<STMTTRN><TRNTYPE>DEBIT<DTPOSTED>', date_format(d, 'yyyyMMdd'), '120000<TRNAMT>-', amount, '<FITID>F', o,
        case when o % 5 = 0 then '' when o % 5 = 1 then concat('<NAME>', name, '<MEMO>', name) else concat('<NAME>', name, '<MEMO>note') end, '</STMTTRN>')""",
    QIF: r"""concat('D', date_format(d, case when o % 2 = 0 then 'MM/dd/yyyy' else "MM/dd''yy" end), '\nT-', amount, case when o % 3 = 0 then '\nN12' else concat('\nP', name) end, '\n^')""",
}


def statement_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, content: a file per customer, rows in the order of their orders' keys."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_custkey").alias("k"),
        F.col("o_orderkey").alias("o"),
        F.to_date("o_orderdate").alias("d"),
        F.expr(_NAME).alias("name"),
        F.col("o_totalprice").cast("decimal(15,2)").cast("string").alias("amount"),
    )
    line = F.expr("case k % 6 " + " ".join(f"when {i} then {x}" for i, x in _LINES.items()) + " end")
    lines = rows.select("k", F.struct("o", line.alias("x")).alias("row")).groupBy("k").agg(F.array_join(F.sort_array(F.collect_list("row"))["x"], "\n").alias("body"))
    kind = F.col("k") % 6
    content = F.col("body")
    for i, head in HEADS.items():
        content = F.when(kind == i, F.concat(F.lit(head + "\n"), "body")).otherwise(content)
    account = F.concat(F.lit("<CURDEF>USD<ACCTID>"), F.lpad(F.col("k").cast("string"), 10, "0"), F.lit("\n"))
    content = F.when(kind == OFX, F.concat(F.lit("OFXHEADER:100\n\n<OFX>"), account, "body", F.lit("</OFX>"))).when(kind == QIF, F.concat(F.lit("!Type:Bank\n"), "body")).otherwise(content)
    ending = F.when(kind == OFX, F.when(F.col("k") % 4 == 0, ".QFX").otherwise(".ofx")).when(kind == QIF, ".qif").otherwise(".csv")
    return statements.with_format(lines.select(F.concat(F.lit("c"), "k", ending).alias("file"), content.alias("content")))


_ORDERS = """o AS (
        SELECT o_custkey AS k, o_orderkey AS o, o_orderdate::DATE AS d, substr(o_orderpriority, 3) || ' item ' || o_orderstatus AS name, o_totalprice::DECIMAL(15,2)::VARCHAR AS amount,
            round(o_totalprice::DECIMAL(15,2) * 100)::BIGINT AS cents, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i,
            'c' || o_custkey || CASE o_custkey % 6 WHEN 4 THEN CASE WHEN o_custkey % 4 = 0 THEN '.QFX' ELSE '.ofx' END WHEN 5 THEN '.qif' ELSE '.csv' END AS file,
            bool_or(day(o_orderdate) > 12) OVER (PARTITION BY o_custkey) AS late FROM orders),
    bad AS (SELECT *, k % 6 = 0 AND (o % 13 = 6 OR o % 11 = 5 OR o % 7 = 3) AS wrong FROM o)"""
_CSV = f"""{_ORDERS},
    csv AS (SELECT file, k, i + (k % 6 <> 2)::INTEGER AS source_pos,
            CASE WHEN k % 6 = 1 AND NOT late THEN make_date(year(d), day(d), month(d)) ELSE d END AS posted_date,
            CASE WHEN k % 6 = 3 OR (k % 6 = 1 AND o % 2 = 1) THEN cents ELSE -cents END AS amount_minor,
            CASE k % 6 WHEN 0 THEN name || ', paid' WHEN 3 THEN 'say "' || name || '" | or not' ELSE name END AS raw_description
        FROM bad WHERE k % 6 < 4 AND NOT wrong)"""
_READ = "file", "source_pos", "posted_date", "amount_minor", "currency", "raw_description"


def _read(parsed: DataFrame, *more: str) -> DataFrame:
    return parsed.select(*[F.col(c).cast("string").alias(c) if c == "posted_date" else c for c in (*_READ, *more)])


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statement_files(spark, sf_dir).filter("format = 'CSV'")


@query("SELECT DISTINCT 'c' || o_custkey || CASE o_custkey % 6 WHEN 4 THEN CASE WHEN o_custkey % 4 = 0 THEN '.QFX' ELSE '.ofx' END WHEN 5 THEN '.qif' ELSE '.csv' END AS file, CASE o_custkey % 6 WHEN 4 THEN CASE WHEN o_custkey % 4 = 0 THEN 'QFX' ELSE 'OFX' END WHEN 5 THEN 'QIF' ELSE 'CSV' END AS format FROM orders")
def statement_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statement_files(spark, sf_dir).select("file", "format")


@query(f"WITH {_CSV} SELECT file, source_pos::BIGINT AS source_pos, posted_date::VARCHAR AS posted_date, amount_minor, 'USD' AS currency, raw_description, 'line ' || (source_pos + 1) AS source_location FROM csv")
def csv_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four delimiters; quotes, doubled quotes, and delimiters inside them; debit and credit columns; no header; day or month first."""
    return _read(statements.csv_transactions(_csv(spark, sf_dir))[0], "source_location")


@query(
    f"""WITH {_ORDERS}, p AS (SELECT *, CASE WHEN o % 11 = 5 THEN 'someday' ELSE d::VARCHAR END AS date, CASE WHEN o % 13 = 6 THEN 'Total of the day' ELSE name || ', paid' END AS said,
        CASE WHEN o % 7 = 3 THEN 'n/a' ELSE '-' || amount END AS sum FROM bad WHERE wrong)
    SELECT file, 'line ' || (i + 2) AS location, CASE WHEN o % 13 = 6 THEN 'Statement summary row, not a transaction' WHEN o % 11 = 5 THEN 'Could not read ''someday'' as a date' ELSE 'Could not read an amount' END AS message,
        CASE WHEN o % 13 = 6 THEN 'WARNING' ELSE 'ERROR' END AS severity, date || ',' || said || ',' || sum AS raw_content FROM p"""
)
def csv_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.csv_transactions(_csv(spark, sf_dir))[1].select("file", "location", "message", "severity", "raw_content")


@query(
    f"""WITH {_ORDERS} SELECT DISTINCT file, 0 AS date_column, 1 AS description_column, CASE WHEN k % 6 <> 1 THEN 2 END::INTEGER AS amount_column, CASE WHEN k % 6 = 1 THEN 2 END::INTEGER AS debit_column,
        CASE WHEN k % 6 = 1 THEN 3 END::INTEGER AS credit_column, CASE WHEN k % 6 = 3 THEN 3 END::INTEGER AS balance_column, k % 6 <> 2 AS has_header_row, k % 6 = 1 AND late AS day_first,
        CASE WHEN k % 6 = 2 THEN 'CONTENT_GUESS' ELSE 'HEADER_MATCH' END AS confidence FROM bad WHERE k % 6 < 4"""
)
def detected_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settled(statements.csv_rows(_csv(spark, sf_dir)))
    found = statements.detect_mapping(rows, settled(statements.headers(rows))).select("file", "mapping.*", "confidence")
    return found.select(
        "file", "date_column", F.col("description_columns")[0].alias("description_column"), "amount_column", "debit_column", "credit_column", "balance_column", "has_header_row", "day_first", "confidence"
    )


@query(
    f"""WITH {_ORDERS}, n AS (SELECT file, least(count(*), 50)::BIGINT AS n, sum(length(regexp_replace(name, '[^a-zA-Z]', '', 'g')))::BIGINT AS letters FROM o WHERE k % 6 = 2 GROUP BY file)
    SELECT file, 0 AS col, n AS dates, n AS sampled FROM n UNION ALL SELECT file, 2, 0, n FROM n UNION ALL SELECT file, 1, 0, n FROM n"""
)
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the columns of files without a header read as dates."""
    return statements.profile_headerless(_csv(spark, sf_dir)).select("file", "col", "dates", "sampled")


@query(
    f"""WITH {_ORDERS}, n AS (SELECT file, least(count(*), 50)::BIGINT AS n, sum(length(regexp_replace(name, '[^a-zA-Z]', '', 'g')))::BIGINT AS letters FROM o WHERE k % 6 = 2 GROUP BY file)
    SELECT file, 1 AS col, 0::BIGINT AS amounts, letters FROM n UNION ALL SELECT file, 2, n, 0 FROM n"""
)
def column_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the text and the amount column of the same files read as amounts, and their letters."""
    return statements.profile_headerless(_csv(spark, sf_dir)).filter("col > 0").select("file", "col", "amounts", "letters")


@query(
    f"""WITH {_ORDERS} SELECT file, i::BIGINT AS source_pos, d::VARCHAR AS posted_date, -cents AS amount_minor, 'USD' AS currency,
        CASE o % 5 WHEN 0 THEN 'DEBIT' WHEN 1 THEN name ELSE name || ' note' END AS raw_description, 'F' || o AS institution_transaction_id, right(lpad(k::VARCHAR, 10, '0'), 4) AS account_mask
    FROM o WHERE k % 6 = 4"""
)
def ofx_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = statement_files(spark, sf_dir).filter("format in ('OFX', 'QFX')")
    parsed = _read(statements.ofx_transactions(files)[0], "institution_transaction_id")
    return parsed.join(statements.ofx_accounts(files), "file")


@query(
    f"""WITH {_ORDERS} SELECT file, i::BIGINT AS source_pos, d::VARCHAR AS posted_date, -cents AS amount_minor, 'USD' AS currency, CASE WHEN o % 3 = 0 THEN 'CHECK 12' ELSE name END AS raw_description,
        'line ' || (i * 4 + 2) AS source_location FROM o WHERE k % 6 = 5"""
)
def qif_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of four digits and of two."""
    return _read(statements.qif_transactions(statement_files(spark, sf_dir).filter("format = 'QIF'"))[0], "source_location")


@query(f"WITH {_ORDERS} SELECT file, count(*) FILTER (NOT wrong) AS rows, count(*) FILTER (wrong AND o % 13 <> 6) AS errors, greatest(count(*) FILTER (NOT wrong) - 3, 0)::BIGINT AS more FROM bad GROUP BY file")
def import_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All formats at once: rows, errors, and how many rows a preview of three leaves out."""
    return statements.preview(statements.parse_statements(statement_files(spark, sf_dir)), 3)[0]


# Files of known banks, headerless ones and ones with stated columns: a customer's layout is the key modulo these.
_BANKS = {
    "chase-checking": ("Details,Posting Date,Description,Amount,Type,Balance,Check or Slip #", "concat('DEBIT,', us, ',', name, ',-', amount, ',ACH,0.00,')"),
    "chase-credit": ("Transaction Date,Post Date,Description,Category,Type,Amount,Memo", "concat('01/01/1990,', us, ',', name, ',Food,Sale,-', amount, ',')"),
    "bofa": ("Date,Description,Amount,Running Bal.", "concat(us, ',', name, ',-', amount, ',0.00')"),
    "capital-one": ("Transaction Date,Posted Date,Card No.,Description,Category,Debit,Credit", "concat('1990-01-01,', d, ',1234,', name, ',Food,', case when o % 2 = 0 then concat(amount, ',') else concat(',', amount) end)"),
    "discover": ("Trans. Date,Post Date,Description,Amount,Category", "concat('01/01/1990,', us, ',', name, ',', amount, ',Food')"),
    "amex": ("Date,Description,Amount", "concat(us, ',', name, ',', amount)"),
    "wells-fargo": (None, """concat('"', us, '","-', amount, '","*","","', name, '"')"""),
    "stated": ("a|b|c|d", "concat(amount, '|', name, '|', o_orderstatus, '|', d)"),
    "refused": ("a|b|c|d", "concat(amount, '|', name, '|', o_orderstatus, '|', d)"),
}
_KINDS = list(_BANKS)


def bank_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(file, content; file, mapping: what is stated of the last three kinds): a file per customer in the layout of a bank."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"), F.to_date("o_orderdate").alias("d"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("us"), F.expr(_NAME).alias("name"), "o_orderstatus",
        F.col("o_totalprice").cast("decimal(15,2)").cast("string").alias("amount"),
    )
    line = F.expr(f"case k % {len(_KINDS)} " + " ".join(f"when {i} then {_BANKS[b][1]}" for i, b in enumerate(_KINDS)) + " end")
    lines = rows.select("k", F.struct("o", line.alias("x")).alias("row")).groupBy("k").agg(F.array_join(F.sort_array(F.collect_list("row"))["x"], "\r\n").alias("body"))
    kind, content, of = F.col("k") % len(_KINDS), F.col("body"), F.lit(None).cast("string")
    for i, b in enumerate(_KINDS):
        content = F.when(kind == i, F.concat(F.lit(_BANKS[b][0] + "\r\n"), "body")).otherwise(content) if _BANKS[b][0] else content
        of = F.when(kind == i, b).otherwise(of)
    files = lines.select(F.concat(F.lit("c"), "k", F.lit(".csv")).alias("file"), content.alias("content"), of.alias("profile_id"))
    own = F.struct(F.lit(3).alias("date_column"), F.array(F.lit(1), F.lit(2)).alias("description_columns"), F.lit(0).alias("amount_column"), F.lit(None).cast("int").alias("debit_column"), F.lit(None).cast("int").alias("credit_column"), F.lit(None).cast("int").alias("balance_column"), F.lit(True).alias("invert_sign"), F.lit(True).alias("has_header_row"), F.lit(False).alias("day_first"))
    stated = files.filter("profile_id in ('stated', 'refused')").select("file", F.when(F.col("profile_id") == "stated", own).otherwise(own.withField("amount_column", F.lit(None).cast("int"))).alias("mapping"))
    by_id = statements.stated_profiles(files.filter("profile_id = 'wells-fargo'").select("file", "profile_id"), bank_profiles(spark))
    return statements.with_format(files.select("file", "content")), by_id.select("file", F.col("mapping").cast(MAPPING).alias("mapping")).unionByName(stated.select("file", F.col("mapping").cast(MAPPING).alias("mapping")))


_BANK_ORDERS = f"""o AS (
        SELECT o_custkey % {len(_KINDS)} AS kind, o_orderkey AS o, o_orderdate::DATE AS d, substr(o_orderpriority, 3) || ' item ' || o_orderstatus AS name, o_orderstatus AS status, round(o_totalprice::DECIMAL(15,2) * 100)::BIGINT AS cents,
            row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, 'c' || o_custkey || '.csv' AS file FROM orders)"""


@query(
    f"""WITH {_BANK_ORDERS} SELECT file, (i + (kind <> 6)::INTEGER)::BIGINT AS source_pos, d::VARCHAR AS posted_date, CASE WHEN kind = 3 AND o % 2 = 1 THEN cents ELSE -cents END AS amount_minor, 'USD' AS currency,
        CASE WHEN kind = 7 THEN name || ' ' || status ELSE name END AS raw_description FROM o WHERE kind < 8"""
)
def bank_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven banks' layouts, of which two turn the sign around and one has no header and is stated, and columns that a user states."""
    files, stated = bank_files(spark, sf_dir)
    return _read(statements.csv_transactions(files, stated=stated)[0])


@query(f"WITH {_BANK_ORDERS} SELECT DISTINCT file, 'file' AS location, 'ERROR' AS severity FROM o WHERE kind = 8")
def refused_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose stated columns lack an amount: a problem each, and no rows."""
    files, stated = bank_files(spark, sf_dir)
    return statements.csv_transactions(files, stated=stated)[1].select("file", "location", "severity")
