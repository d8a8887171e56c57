"""The registered queries over the ledgers derived from the driver's tables, and their SQL for DuckDB."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import merchants as fm
from ..functions.amounts import parse_amount_minor
from ..functions.dates import infer_date_order, parse_date
from ..functions.merchants import display_name_of_key, with_merchant_key
from ..functions.money import add_minor, allocate, compare_minor, is_credit, is_debit, is_liability, magnitude, negated, percent_of, plain_text, scale_by, split_even, subtract_minor, sum_minor, times, to_major, to_minor
from ..functions.reference import BRAND_ALIASES, CATALOGUE, CITIES, SERVICE_CLASSES, STATES, catalogue
from ..operators import imports, ledger, subscriptions
from ..operators.recurring import active_series, confidence_tier, dearest_first, detect_recurring, ordered_series
from ..sources.schemas import ACCOUNTS, valid_account, valid_batch, valid_category
from ..sources.shared import fresh_path, settled
from ..sources.snapshots import Store
from ..streaming import live, reports
from .driver_ledger import AS_OF, NOISE_SQL, RHYTHM_SQL, noise_ledger, rhythm_ledger

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
IMPORTED_AT = dt.datetime(2024, 1, 2, 3, 4, 5, tzinfo=dt.UTC)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- recurring charges and subscriptions -------------------------------------------------------

# The oracle's own statement of the detector, step by step over lists.
_CADENCES = [("WEEKLY", 7, 2), ("FORTNIGHTLY", 14, 3), ("FOUR_WEEKLY", 28, 2), ("MONTHLY", 30, 4), ("QUARTERLY", 91, 10), ("SEMIANNUAL", 182, 15), ("ANNUAL", 365, 21)]


def _periods(gap: str, days: str, tolerance: str) -> str:
    return "CASE " + " ".join(f"WHEN abs({gap} - {days} * {p}) <= {tolerance} * {p} THEN {p}" for p in (1, 2, 3)) + " END"


def _near(x: str, y: str) -> str:
    end = lambda d: f"(day(last_day({d})) - day({d}))"
    return f"(abs(day({x}) - day({y})) <= 1 OR ({end(x)} <= 3 AND {end(y)} <= 3))"


_SERIES = f"""
    {RHYTHM_SQL},
    cad(cadence, ord, days, tol, factor) AS (VALUES {", ".join(f"('{n}', {i}, {d}, {t}, round(365.25 / {d}, 4)::DECIMAL(9,4))" for i, (n, d, t) in enumerate(_CADENCES))}),
    d AS (SELECT ledger_id, merchant_key, posted_date, arg_min(amount_minor, id) AS a, arg_min(currency, id) AS currency FROM tx WHERE amount_minor < 0 AND NOT is_transfer GROUP BY ALL),
    m AS (SELECT ledger_id, merchant_key, list(posted_date ORDER BY posted_date) AS dates, list(a ORDER BY posted_date) AS amts, count(*)::INTEGER AS charges, min(currency) AS currency FROM d GROUP BY ALL HAVING count(*) >= 3),
    g AS (SELECT *, list_transform(range(1, charges), lambda i: date_diff('day', dates[i], dates[i + 1])) AS gaps FROM m),
    g1 AS (SELECT *, list_sort(gaps)[len(gaps) // 2 + 1] AS mid FROM g),
    g2 AS (SELECT *, CASE WHEN mid BETWEEN 5 AND 9 THEN 'WEEKLY' WHEN mid BETWEEN 11 AND 17 THEN 'FORTNIGHTLY' WHEN mid BETWEEN 26 AND 28 THEN 'FOUR_WEEKLY'
        WHEN mid BETWEEN 29 AND 34 THEN 'MONTHLY' WHEN mid BETWEEN 81 AND 101 THEN 'QUARTERLY' WHEN mid BETWEEN 167 AND 197 THEN 'SEMIANNUAL' WHEN mid BETWEEN 344 AND 386 THEN 'ANNUAL' END AS by_mid,
        [{", ".join(f"{{'n': len(list_filter(gaps, lambda g: ({_periods('g', str(d), str(t))}) IS NOT NULL)), 'k': {-i}, 'c': '{n}'}}" for i, (n, d, t) in enumerate(_CADENCES))}] AS votes FROM g1),
    g3 AS (SELECT *, coalesce(by_mid, list_sort(list_filter(votes, lambda v: v.n > len(gaps) // 2), 'DESC')[1].c) AS guess FROM g2),
    g4 AS (SELECT *, CASE WHEN guess IN ('FOUR_WEEKLY', 'MONTHLY') THEN CASE WHEN len(list_filter(dates, lambda x: NOT {_near("dates[1]", "x")})) = 0 THEN 'MONTHLY' ELSE 'FOUR_WEEKLY' END ELSE guess END AS cadence
        FROM g3 WHERE guess IS NOT NULL),
    g5 AS (SELECT g4.*, days, factor, list_filter(list_transform(gaps, lambda g: {_periods("g", "days", "tol")}), lambda p: p IS NOT NULL) AS per FROM g4 JOIN cad USING (cadence)),
    g6 AS (SELECT *, len(gaps)::INTEGER AS n_gaps, len(per)::INTEGER AS matched, (coalesce(list_sum(per), 0) - len(per))::INTEGER AS missed,
        list_sort(list_transform(amts, lambda x: abs(x)::DOUBLE))[charges // 2 + 1] AS med FROM g5 WHERE len(per) * 10 >= len(gaps) * 6),
    g7 AS (SELECT *, CASE WHEN med = 0 THEN 0.5 ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - list_sum(list_transform(amts, lambda x: abs(abs(x)::DOUBLE - med))) / charges / med) END AS stab FROM g6),
    g8 AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (matched / n_gaps) * 0.5::DOUBLE + (CASE WHEN charges >= 12 THEN 1.0::DOUBLE WHEN charges >= 6 THEN 0.9::DOUBLE WHEN charges >= 4 THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END) * 0.2::DOUBLE
        + stab * 0.2::DOUBLE + (1.0::DOUBLE - least(missed / (n_gaps + 1), 0.5::DOUBLE)) * 0.1::DOUBLE)) AS confidence, list_sort(amts)[charges // 2 + 1] AS typical FROM g7),
    series AS (SELECT *, round(abs(typical)::DECIMAL(19,0) * factor)::BIGINT AS annual_minor, dates[1] AS first_seen, dates[charges] AS last_seen, dates[charges] + days AS next_expected FROM g8 WHERE confidence >= 0.4),
    priced AS (SELECT *, round(annual_minor::DECIMAL(19,0) * 0.083333::DECIMAL(7,6))::BIGINT AS monthly_minor, date_diff('day', last_seen, DATE '{AS_OF}') * 2 <= days * 3 AS is_active FROM series),
    cat(merchant_key, service_class) AS (VALUES {", ".join(f"('{m}', '{c}')" for c, names in CATALOGUE.items() for m in names.split(", "))}),
    red(service_class) AS (VALUES {", ".join(f"('{c}')" for c, _, r in SERVICE_CLASSES if r)}),
    over AS (SELECT ledger_id, merchant_key, CASE WHEN hash % 3 = 0 THEN 'FITNESS' WHEN hash % 3 = 1 THEN NULL ELSE 'NO SUCH CLASS' END AS service_class
        FROM (SELECT DISTINCT ledger_id, merchant_key, length(merchant_key) AS hash FROM tx WHERE length(merchant_key) IN (6, 7, 8))),
    subs AS (SELECT p.*, CASE WHEN o.merchant_key IS NOT NULL THEN CASE WHEN o.service_class = 'FITNESS' THEN 'FITNESS' END ELSE cat.service_class END AS service_class,
        o.merchant_key IS NOT NULL AS is_overridden, cat.merchant_key IS NOT NULL AS is_known
        FROM priced p LEFT JOIN cat USING (merchant_key) LEFT JOIN over o ON o.ledger_id = p.ledger_id AND o.merchant_key = p.merchant_key WHERE confidence >= 0.55)"""


def _overrides(tx: DataFrame) -> DataFrame:
    n = F.length("merchant_key")
    some = tx.filter(n.isin(6, 7, 8)).select("ledger_id", "merchant_key").distinct()
    return some.withColumn("service_class", F.when(n % 3 == 0, "FITNESS").when(n % 3 == 2, "NO SUCH CLASS"))


def _subs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = rhythm_ledger(spark, sf_dir)
    return subscriptions.subscriptions(detect_recurring(tx), AS_OF, overrides=_overrides(tx))


def _settled_subs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without their histories, for what reads them more than once, as sorting does."""
    return settled(_subs(spark, sf_dir).drop("amount_history", "charge_dates"))


@query(f"WITH {_SERIES} SELECT ledger_id, merchant_key, cadence, charges, missed, typical AS typical_minor, first_seen::VARCHAR AS first_seen, last_seen::VARCHAR AS last_seen, next_expected::VARCHAR AS next_expected, annual_minor, monthly_minor FROM priced")
def recurring_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_recurring(rhythm_ledger(spark, sf_dir)).select(
        "ledger_id", "merchant_key", "cadence", "charges", "missed", "typical_minor", *[F.col(c).cast("string").alias(c) for c in ("first_seen", "last_seen", "next_expected")], "annual_minor", "monthly_minor"
    )


@query(
    f"WITH {_SERIES} SELECT ledger_id, merchant_key, matched, n_gaps, round(confidence, 6) AS confidence, "
    "CASE WHEN confidence >= 0.85 THEN 'CERTAIN' WHEN confidence >= 0.7 THEN 'LIKELY' ELSE 'UNCERTAIN' END AS tier FROM priced"
)
def recurring_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = detect_recurring(rhythm_ledger(spark, sf_dir))
    return series.select("ledger_id", "merchant_key", "matched", "n_gaps", F.round("confidence", 6).alias("confidence"), confidence_tier(F.col("confidence")).alias("tier"))


@query(f"WITH {_SERIES} SELECT ledger_id, count(*) AS series, sum(annual_minor)::BIGINT AS annual_minor FROM priced WHERE is_active GROUP BY ledger_id")
def active_series_by_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = active_series(detect_recurring(rhythm_ledger(spark, sf_dir)), AS_OF)
    return series.groupBy("ledger_id").agg(F.count(F.lit(1)).alias("series"), sum_minor(F.col("annual_minor")).alias("annual_minor"))


_SUB_COLUMNS = ["ledger_id", "merchant_key", "cadence", "service_class", "annual_minor", "monthly_minor"]


@query(f"WITH {_SERIES} SELECT {', '.join(_SUB_COLUMNS)} FROM subs WHERE is_active")
def subscriptions_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subscriptions.active(_subs(spark, sf_dir)).select(*_SUB_COLUMNS)


@query(f"WITH {_SERIES} SELECT {', '.join(_SUB_COLUMNS)} FROM subs WHERE NOT is_active")
def subscriptions_cancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subscriptions.cancelled(_subs(spark, sf_dir)).select(*_SUB_COLUMNS)


@query(f"WITH {_SERIES} SELECT ledger_id, merchant_key, annual_minor FROM subs WHERE is_active AND service_class IS NULL")
def untagged_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subscriptions.untagged_merchants(_settled_subs(spark, sf_dir)).select("ledger_id", "merchant_key", "annual_minor")


_DUPLICATES = """dup AS (SELECT ledger_id, service_class, count(*) AS members, (sum(annual_minor) - min(annual_minor))::BIGINT AS saving_minor, min(currency) AS currency,
        array_to_string(list(merchant_key ORDER BY annual_minor DESC, first_seen, merchant_key), '|') AS merchants
        FROM subs JOIN red USING (service_class) WHERE is_active GROUP BY ledger_id, service_class HAVING count(*) > 1)"""


@query(f"WITH {_SERIES}, {_DUPLICATES} SELECT ledger_id, service_class, members, saving_minor, currency FROM dup")
def duplicate_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subscriptions.duplicate_subscriptions(_subs(spark, sf_dir)).select("ledger_id", "service_class", "members", "saving_minor", "currency")


@query(
    f"""WITH {_SERIES}, {_DUPLICATES} SELECT s.*, coalesce(saving, 0)::BIGINT AS saving_minor FROM
    (SELECT ledger_id, currency, count(*) AS active, sum(annual_minor)::BIGINT AS annual_minor, sum(monthly_minor)::BIGINT AS monthly_minor FROM subs WHERE is_active GROUP BY ALL) s
    LEFT JOIN (SELECT ledger_id, sum(saving_minor) AS saving FROM dup GROUP BY ledger_id) u USING (ledger_id)"""
)
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subscriptions.report_totals(_settled_subs(spark, sf_dir)).select("ledger_id", "currency", "active", "annual_minor", "monthly_minor", "saving_minor")


@query(
    f"""WITH {_SERIES},
    runs AS (SELECT *, list_reduce(list_transform(amts, lambda x: [{{'rep': abs(x), 'n': 1}}]), lambda a, b: CASE
        WHEN round(abs(b[1].rep - a[len(a)].rep)::DECIMAL(18,0)::DOUBLE / greatest(a[len(a)].rep, 1), 4) <= 0.02
        THEN list_concat(a[1:len(a) - 1], [{{'rep': a[len(a)].rep, 'n': a[len(a)].n + 1}}]) ELSE list_concat(a, b) END) AS r FROM subs),
    steps AS (SELECT *, r[len(r)] AS now, r[len(r) - 1] AS was FROM runs WHERE len(amts) >= 3 AND len(r) >= 2)
    SELECT ledger_id, merchant_key, was.rep AS previous_minor, now.rep AS current_minor, dates[charges - now.n + 1]::VARCHAR AS changed_on,
        round((now.rep - was.rep)::DECIMAL(19,0) * factor)::BIGINT AS impact_minor
    FROM steps WHERE (now.n >= 2 OR len(r) = 2) AND now.rep > was.rep AND round((now.rep - was.rep)::DOUBLE / greatest(was.rep, 1), 4) >= 0.02"""
)
def price_increases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subscriptions.price_increases(_subs(spark, sf_dir)).select("ledger_id", "merchant_key", "previous_minor", "current_minor", F.col("changed_on").cast("string").alias("changed_on"), "impact_minor")


@query(f"WITH {_SERIES} SELECT ledger_id, merchant_key, service_class, is_overridden, is_known FROM subs")
def classified_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subs(spark, sf_dir).select("ledger_id", "merchant_key", "service_class", "is_overridden", "is_known")


_FIRST = "f AS (SELECT ledger_id, merchant_key, min({'d': posted_date, 'i': id}).i AS first_id FROM tx WHERE amount_minor < 0 AND NOT is_transfer GROUP BY ALL)"
_DEAREST = "annual_minor DESC, first_seen, first_id"


@query(f"WITH {_SERIES}, {_FIRST} SELECT ledger_id, merchant_key, annual_minor, row_number() OVER (PARTITION BY ledger_id ORDER BY {_DEAREST}) AS place FROM priced JOIN f USING (ledger_id, merchant_key)")
def series_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ledger's series, dearest first."""
    series = ordered_series(settled(detect_recurring(rhythm_ledger(spark, sf_dir)).drop("history")))  # sorting reads its rows twice
    place = F.row_number().over(Window.partitionBy("ledger_id").orderBy(*dearest_first()))
    return series.select("ledger_id", "merchant_key", "annual_minor", place.alias("place"))


@query(
    f"""WITH {_SERIES}, {_FIRST} SELECT ledger_id, service_class, array_to_string(list(merchant_key ORDER BY {_DEAREST}), '|') AS merchants, (sum(annual_minor) - min(annual_minor))::BIGINT AS saving_minor
    FROM subs JOIN red USING (service_class) JOIN f USING (ledger_id, merchant_key) WHERE is_active GROUP BY ledger_id, service_class HAVING count(*) > 1"""
)
def duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of each duplicate, dearest first."""
    found = subscriptions.duplicate_subscriptions(_subs(spark, sf_dir))
    return found.select("ledger_id", "service_class", F.array_join("merchants", "|").alias("merchants"), "saving_minor")


@query(f"WITH {_SERIES}, {_FIRST} SELECT ledger_id, merchant_key, annual_minor, row_number() OVER (PARTITION BY ledger_id ORDER BY {_DEAREST}) AS place FROM subs JOIN f USING (ledger_id, merchant_key) WHERE is_active AND service_class IS NULL")
def untagged_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = subscriptions.untagged_merchants(_settled_subs(spark, sf_dir))
    place = F.row_number().over(Window.partitionBy("ledger_id").orderBy(*dearest_first()))
    return found.select("ledger_id", "merchant_key", "annual_minor", place.alias("place"))


@query(f"WITH {_SERIES} SELECT ledger_id, merchant_key, cadence FROM priced WHERE merchant_key IN (SELECT merchant_key FROM cat WHERE cat.service_class = 'VIDEO_STREAMING')")
def series_of_a_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series whose merchants the built-in catalogue has in one class, whatever a user says of them."""
    series, names = detect_recurring(rhythm_ledger(spark, sf_dir)), subscriptions.merchants_in(catalogue(spark), "VIDEO_STREAMING")
    return series.join(F.broadcast(names), "merchant_key", "left_semi").select("ledger_id", "merchant_key", "cadence")


@query(
    f"""WITH {_SERIES}, {_DUPLICATES} SELECT 'subscriptions' AS report, ledger_id, count(*) AS n, sum(annual_minor)::BIGINT AS amount_minor FROM subs GROUP BY ledger_id
    UNION ALL SELECT 'duplicates', ledger_id, count(*), sum(saving_minor)::BIGINT FROM dup GROUP BY ledger_id
    UNION ALL SELECT 'totals', ledger_id, count(*), sum(annual_minor)::BIGINT FROM subs WHERE is_active GROUP BY ledger_id"""
)
def analysed_ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole analysis in one call: rows and amounts of its reports by ledger."""
    tx = rhythm_ledger(spark, sf_dir)
    report = subscriptions.analyse_ledger(tx, AS_OF, overrides=_overrides(tx))
    sums = lambda name, df, amount: df.groupBy("ledger_id").agg(F.count(F.lit(1)).alias("n"), sum_minor(F.col(amount)).alias("amount_minor")).select(F.lit(name).alias("report"), "ledger_id", "n", "amount_minor")
    totals = report.totals.groupBy("ledger_id").agg(F.sum("active").alias("n"), F.sum("annual_minor").alias("amount_minor")).select(F.lit("totals").alias("report"), "ledger_id", "n", "amount_minor")
    return sums("subscriptions", report.subscriptions, "annual_minor").unionByName(sums("duplicates", report.duplicates, "saving_minor")).unionByName(totals)


# -- refresh and live queries ------------------------------------------------------------------

_REFRESHED = _SERIES.replace("FROM tx WHERE amount_minor < 0", "FROM tx WHERE (account_id <> 'A2' OR length(ledger_id) = 2) AND amount_minor < 0")


@query(
    f"""WITH {_REFRESHED}, {_DUPLICATES} SELECT s.*, coalesce(saving, 0)::BIGINT AS saving_minor FROM
    (SELECT ledger_id, currency, count(*) AS active, sum(annual_minor)::BIGINT AS annual_minor, sum(monthly_minor)::BIGINT AS monthly_minor FROM subs WHERE is_active GROUP BY ALL) s
    LEFT JOIN (SELECT ledger_id, sum(saving_minor) AS saving FROM dup GROUP BY ledger_id) u USING (ledger_id)"""
)
def refreshed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all ledgers without one of the accounts; then ledgers L0 to L9 get its transactions, and their reports alone are made anew."""
    tx, folder = rhythm_ledger(spark, sf_dir), fresh_path(spark, "reports")
    overrides, ten = _overrides(tx), F.length("ledger_id") == 2
    reports.refresh_reports(tx.filter("account_id <> 'A2'"), AS_OF, folder, overrides=overrides)
    reports.refresh_reports(tx.filter(ten | (F.col("account_id") != "A2")), AS_OF, folder, overrides=overrides, changed=tx.filter(ten).select("ledger_id"))
    return reports.read_report(spark, folder, "totals")


@query(
    """SELECT 'L' || (c_custkey % 50) AS ledger_id, c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 4 = 1 THEN 'Renamed ' || c_custkey ELSE c_name END AS display_name,
        CASE WHEN c_custkey % 4 = 1 THEN 3 ELSE 1 END::BIGINT AS version FROM customer WHERE c_custkey % 5 <> 2 AND c_custkey % 3 <> 0"""
)
def live_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of edits as a stream: all accounts; every third archived and every fifth deleted; every fourth renamed, after an older
    version of it. The active ones of the table that the stream keeps."""
    k = F.col("c_custkey")
    held = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.concat(F.lit("L"), k % 50).alias("ledger_id"), k.cast("string").alias("id"), F.col("c_name").alias("display_name"), F.lit("Bank").alias("institution"), F.lit("CASH").alias("type"), F.lit("USD").alias("currency"),
        F.lit(None).cast("string").alias("mask"), F.lit(False).alias("is_archived"), F.lit(1).cast("bigint").alias("version"), F.lit(False).alias("is_deleted"),
    )
    key = F.col("id").cast("long")
    gone = held.filter((key % 5 == 2) | (key % 3 == 0)).withColumns({"version": F.lit(2).cast("bigint"), "is_archived": key % 3 == 0, "is_deleted": key % 5 == 2})
    renamed = held.filter((key % 4 == 1) & (key % 5 != 2)).withColumns({"version": F.lit(3).cast("bigint"), "is_archived": key % 3 == 0, "display_name": F.concat(F.lit("Renamed "), "id")})
    older = renamed.withColumns({"version": F.lit(0).cast("bigint"), "display_name": F.lit("too late")})
    edits, root, checkpoint = (fresh_path(spark, n) for n in ("edits", "live", "live-state"))
    schema = f"{ACCOUNTS}, version bigint"
    for part in (held, gone, renamed.unionByName(older)):
        part.write.mode("append").parquet(edits)
        q = live.run_live_query(spark.readStream.schema(held.schema).parquet(edits), root, checkpoint, schema=schema, key=["ledger_id", "id"])
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    return ledger.accounts_by_name(Store(spark, root, {"rows": schema}).read("rows")).select("ledger_id", "id", "display_name", "version")


# -- descriptors -------------------------------------------------------------------------------


def _quoted(s: str) -> str:
    return s.replace("'", "''")


def _clean_sql() -> str:
    """The normaliser in SQL. RE2 has no look-around: mixed ids are found word by word, and the location takes a character along."""
    t = "trim(upper(raw_description))"
    t = f"trim(regexp_replace({t}, '^(?:(?:{fm.PROCESSORS})\\s*\\*+\\s*){{1,3}}', ''))"
    t = f"trim(regexp_replace({t}, '^(?:{'|'.join(fm.TYPE_PREFIXES)})', ''))"
    for p in fm.NOISE[:-1]:
        t = f"regexp_replace({t}, '{p}', ' ', 'g')"
    mixed = "regexp_full_match(x, '[A-Z0-9]{6,}') AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Z]')"
    t = f"array_to_string(list_transform(regexp_extract_all({t}, '\\w+|\\W+'), lambda x: CASE WHEN {mixed} THEN ' ' ELSE x END), '')"
    t = f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"
    t = f"regexp_replace({t}, '(\\S)(?: (?:{'|'.join(CITIES)}))? (?:{'|'.join(STATES)})$', '\\1')"
    t = f"trim(regexp_replace({t}, '[^A-Z0-9]+', ' ', 'g'))"
    return f"trim(regexp_replace({t}, '(?:\\s+(?:{fm.FILLER}))+$', ''))"


_KEYS = f"""{NOISE_SQL},
    alias(a, b) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in BRAND_ALIASES.items())}),
    cleaned AS (SELECT raw_description, {_clean_sql()} AS c FROM (SELECT DISTINCT raw_description FROM noise)),
    keys AS (SELECT raw_description, coalesce(b, nullif(c, ''), nullif(trim(regexp_replace(upper(raw_description), '[^A-Z0-9]+', ' ', 'g')), ''), 'UNKNOWN') AS merchant_key
        FROM cleaned LEFT JOIN alias ON a = c)"""


@query(f"WITH {_KEYS} SELECT id, merchant_key FROM noise JOIN keys USING (raw_description)")
def normalised_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_merchant_key(noise_ledger(spark, sf_dir)).select("id", "merchant_key")


_MINOR = ", ".join(f"'{w}'" for w in fm.MINOR_WORDS)


@query(
    f"""WITH {_KEYS} SELECT merchant_key, array_to_string(list_transform(list_filter(string_split(merchant_key, ' '), lambda w: w <> ''), lambda w, i: CASE
        WHEN length(w) <= 3 AND w NOT IN ({_MINOR}) THEN w WHEN i > 1 AND w IN ({_MINOR}) THEN lower(w) ELSE w[1] || lower(w[2:]) END), ' ') AS display_name, count(*) AS n
    FROM noise JOIN keys USING (raw_description) GROUP BY merchant_key"""
)
def merchant_display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = with_merchant_key(noise_ledger(spark, sf_dir)).groupBy("merchant_key").agg(F.count(F.lit(1)).alias("n"))
    return keyed.select("merchant_key", display_name_of_key(F.col("merchant_key")).alias("display_name"), "n")


def _edited_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class for every third merchant, then another for every sixth one, then none for every ninth one."""
    keyed = spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_custkey") % 200).alias("k"), F.concat(F.lit("L"), F.col("c_custkey") % 50).alias("ledger_id"), F.concat(F.lit("M"), F.col("c_custkey") % 200).alias("m"))
    row = lambda c, of: keyed.filter(F.col("k") % of == 0).groupBy("ledger_id", F.col("m").alias("merchant_key")).agg(F.lit(c).alias("service_class"))
    held = subscriptions.set_classification(row("MUSIC_STREAMING", 3), row("FITNESS", 6))
    return subscriptions.clear_classification(held, row("", 9).select("ledger_id", "merchant_key"))


_OVERRIDES = """k AS (SELECT c_custkey % 200 AS k, 'L' || (c_custkey % 50) AS ledger_id, 'M' || (c_custkey % 200) AS merchant_key FROM customer),
    o AS (SELECT ledger_id, merchant_key, CASE WHEN bool_or(k % 6 = 0) THEN 'FITNESS' ELSE 'MUSIC_STREAMING' END AS service_class FROM k WHERE k % 3 = 0
        GROUP BY ALL HAVING NOT bool_or(k % 9 = 0))"""


@query(f"WITH {_OVERRIDES} SELECT * FROM o")
def classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All overrides, after some were set anew and some cleared."""
    return subscriptions.classifications(_edited_classes(spark, sf_dir))


@query(f"WITH {_OVERRIDES} SELECT * FROM o WHERE merchant_key = 'M12'")
def classification_of_merchant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subscriptions.classifications(_edited_classes(spark, sf_dir), "M12")


# -- import ------------------------------------------------------------------------------------


def _hashed_sql(batch: str = "batch_id") -> str:
    return f"""{_KEYS},
    hashed AS (SELECT n.*, merchant_key, row_number() OVER (PARTITION BY ledger_id, batch_id, account_id, posted_date, amount_minor, merchant_key ORDER BY source_pos) - 1 AS occurrence
        FROM (SELECT * EXCLUDE (batch_id, account_id, posted_date, amount_minor), {batch} AS batch_id, 'A' || (account_id::BIGINT % 5) AS account_id, make_date(year(posted_date), month(posted_date), 1) AS posted_date,
            amount_minor // 10000000 AS amount_minor FROM noise) n JOIN keys USING (raw_description)),
    h2 AS (SELECT *, sha256(concat_ws(chr(31), account_id, posted_date::VARCHAR, amount_minor::VARCHAR, merchant_key, occurrence::VARCHAR)) AS dedup_hash FROM hashed)"""


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse dates and amounts and few accounts, so that fingerprints and institution ids meet."""
    coarse = {
        "account_id": F.concat(F.lit("A"), F.col("account_id").cast("long") % 5),
        "posted_date": F.trunc("posted_date", "month"),
        "amount_minor": F.expr("amount_minor div 10000000"),
    }
    return noise_ledger(spark, sf_dir).withColumns(coarse)


@query(f"WITH {_hashed_sql()} SELECT id, dedup_hash, occurrence::INTEGER AS occurrence FROM h2")
def dedup_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.assign_hashes(with_merchant_key(_parsed(spark, sf_dir))).select("id", "dedup_hash", "occurrence")


# Two batches that hold all rows: the second into ledgers that hold the first.
_HALF = "concat('B', cast(substring(batch_id, 2) as int) % 2)"
_HALVES = _hashed_sql("'B' || (substring(batch_id, 2)::INTEGER % 2)")
#: First what the hash leaves, of that what the institution id leaves.
_NEW = f"""{_HALVES},
    led AS (SELECT * FROM h2 WHERE batch_id = 'B0'), inc AS (SELECT * FROM h2 WHERE batch_id = 'B1'),
    i1 AS (SELECT * FROM inc WHERE NOT EXISTS (SELECT 1 FROM led WHERE led.ledger_id = inc.ledger_id AND led.dedup_hash = inc.dedup_hash)),
    i2 AS (SELECT * FROM i1 WHERE NOT EXISTS (SELECT 1 FROM led WHERE led.ledger_id = i1.ledger_id AND led.account_id = i1.account_id AND led.institution_transaction_id = i1.institution_transaction_id)),
    fresh AS (SELECT * FROM i2 QUALIFY institution_transaction_id IS NULL OR row_number() OVER (PARTITION BY ledger_id, account_id, institution_transaction_id ORDER BY source_pos) = 1)"""


def _import(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, imports.ImportOutcome]:
    parsed = _parsed(spark, sf_dir).withColumns({"order_id": F.col("id"), "batch_id": F.expr(_HALF)})
    held = imports.enrich(parsed.filter("batch_id = 'B0'"))
    incoming = parsed.filter("batch_id = 'B1'")
    problems = incoming.filter("source_pos % 50 = 1").select("ledger_id", "batch_id", F.when(F.col("source_pos") % 100 == 1, "ERROR").otherwise("WARNING").alias("severity"))
    return held, imports.import_batch(held, incoming, problems, source="OCR", imported_at=IMPORTED_AT)


@query(f"WITH {_NEW} SELECT id AS order_id, ledger_id, merchant_key, dedup_hash FROM fresh")
def import_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _import(spark, sf_dir)[1].new_rows.select("order_id", "ledger_id", "merchant_key", "dedup_hash")


@query(
    f"""WITH {_NEW} SELECT ledger_id, 'B1' AS batch_id, p AS rows_parsed, coalesce(i, 0) AS rows_imported, p - coalesce(i, 0) AS rows_duplicate, f AS rows_failed,
        p > 0 AND (p - coalesce(i, 0)) * 10 > p * 9 AS likely_reimport, true AS needs_review, 1704164645::BIGINT AS imported_at
    FROM (SELECT ledger_id, count(*) AS p, count(*) FILTER (source_pos % 100 = 1) AS f FROM inc GROUP BY ledger_id)
    LEFT JOIN (SELECT ledger_id, count(*) AS i FROM fresh GROUP BY ledger_id) USING (ledger_id)"""
)
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second batch of each ledger; all ledgers use the same names for batches."""
    return _import(spark, sf_dir)[1].summary.withColumn("imported_at", F.unix_seconds("imported_at"))


def _in_order_sql(select: str, batches: int = 4) -> str:
    """Each batch into what the batches before it left."""
    steps = ["led0 AS MATERIALIZED (SELECT * FROM h2 WHERE false)"]
    for n in range(batches):
        steps.append(
            f"""new{n} AS MATERIALIZED (SELECT * FROM h2 b WHERE batch_id = 'B{n}' AND NOT EXISTS (SELECT 1 FROM led{n} l WHERE l.ledger_id = b.ledger_id AND l.dedup_hash = b.dedup_hash)
            AND NOT EXISTS (SELECT 1 FROM led{n} l WHERE l.ledger_id = b.ledger_id AND l.account_id = b.account_id AND l.institution_transaction_id = b.institution_transaction_id)
            QUALIFY institution_transaction_id IS NULL OR row_number() OVER (PARTITION BY ledger_id, account_id, institution_transaction_id ORDER BY source_pos) = 1)"""
        )
        steps.append(f"led{n + 1} AS MATERIALIZED (SELECT * FROM led{n} UNION ALL SELECT * FROM new{n})")
    return f"WITH {_hashed_sql()}, {', '.join(steps)} {select.replace('LEDGER', f'led{batches}')}"


def _in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).withColumns({"order_id": F.col("id"), "batch_seq": F.substring("batch_id", 2, 9).cast("int")})


@query(_in_order_sql("SELECT id AS order_id, ledger_id, batch_id, merchant_key, dedup_hash FROM LEDGER"))
def import_all_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four batches, one after another, into an empty ledger."""
    parsed = _in_batches(spark, sf_dir)
    empty = imports.enrich(parsed.filter(F.lit(False)))
    return imports.import_many(empty, parsed).select("order_id", "ledger_id", "batch_id", "merchant_key", "dedup_hash")


@query(
    _in_order_sql(
        """SELECT ledger_id, batch_id AS id, p AS rows_parsed, coalesce(i, 0) AS rows_imported, p - coalesce(i, 0) AS rows_duplicate, f AS rows_failed, coalesce(i, 0) AS transactions, coalesce(a, 0)::BIGINT AS amount_minor
        FROM (SELECT ledger_id, batch_id, count(*) AS p, count(*) FILTER (source_pos % 50 = 1) AS f FROM h2 GROUP BY ALL)
        LEFT JOIN (SELECT ledger_id, batch_id, count(*) AS i, sum(amount_minor) AS a FROM LEDGER GROUP BY ALL) USING (ledger_id, batch_id)"""
    )
)
def published_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches B0 and B1 published together, then all four: what readers of the last snapshot find by batch, and that importing again adds nothing."""
    store = Store(spark, fresh_path(spark, "published"))
    parsed = _in_batches(spark, sf_dir)
    problems = parsed.filter("source_pos % 50 = 1").select("ledger_id", "batch_id", F.lit("line").alias("location"), F.lit("unreadable").alias("message"), F.lit("ERROR").alias("severity"), F.lit(None).cast("string").alias("raw_content"))
    batches = parsed.groupBy("ledger_id", F.col("batch_id").alias("id")).agg(F.min("account_id").alias("account_id")).withColumns({"source": F.lit("CSV"), "file_name": F.col("id")})
    imports.publish_import(store, batches.filter("id < 'B2'"), parsed, problems, imported_at=IMPORTED_AT)
    imports.publish_import(store, batches, parsed, problems, imported_at=IMPORTED_AT)
    if imports.publish_import(store, batches, parsed, problems, imported_at=IMPORTED_AT).number != 2:
        raise RuntimeError("importing the same batches again published something")
    found = store.read("transactions").groupBy("ledger_id", F.col("import_batch_id").alias("id")).agg(F.count(F.lit(1)).alias("transactions"), sum_minor(F.col("amount_minor")).alias("amount_minor"))
    records = store.read("import_batches").select("ledger_id", "id", "rows_parsed", "rows_imported", "rows_duplicate", "rows_failed")
    none = F.lit(0).cast("bigint")
    return records.join(found, ["ledger_id", "id"], "left").withColumns({c: F.coalesce(c, none) for c in ("transactions", "amount_minor")})


@query(f"WITH {NOISE_SQL} SELECT ledger_id, batch_id AS import_batch_id, count(*) AS transactions, sum(amount_minor)::BIGINT AS amount_minor FROM noise WHERE NOT (batch_id = 'B2' AND ledger_id = 'L7') GROUP BY ALL")
def undo_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch B2 of one ledger; the others have batches of that name, too."""
    tx = noise_ledger(spark, sf_dir).withColumnRenamed("batch_id", "import_batch_id")
    left, records, _ = imports.undo_batch(tx, tx.select("ledger_id", F.col("import_batch_id").alias("id")).distinct(), "L7", "B2")
    sums = left.groupBy("ledger_id", "import_batch_id").agg(F.count(F.lit(1)).alias("transactions"), sum_minor(F.col("amount_minor")).alias("amount_minor"))
    return sums.join(records.withColumnRenamed("id", "import_batch_id"), ["ledger_id", "import_batch_id"], "left_semi")


@query(f"WITH {_HALVES} SELECT DISTINCT ledger_id, dedup_hash FROM h2 n WHERE batch_id = 'B1' AND EXISTS (SELECT 1 FROM h2 o WHERE o.batch_id = 'B0' AND o.ledger_id = n.ledger_id AND o.dedup_hash = n.dedup_hash)")
def existing_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = imports.assign_hashes(with_merchant_key(_parsed(spark, sf_dir).withColumn("batch_id", F.expr(_HALF))))
    return ledger.existing_hashes(hashed.filter("batch_id = 'B0'"), hashed.filter("batch_id = 'B1'"))


# -- money -------------------------------------------------------------------------------------


@query(
    """WITH p AS (SELECT o_orderkey AS id, round(o_totalprice::DECIMAL(15,2) * 100)::BIGINT * (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END) AS amount, [o_orderkey % 7 + 1, o_custkey % 5, 3, o_orderkey % 11] AS w FROM orders),
    x AS (SELECT id, amount, list_sum(w)::HUGEINT AS total, unnest(w) AS weight, unnest([0, 1, 2, 3]) AS part FROM p),
    y AS (SELECT *, abs(amount)::HUGEINT * weight // total AS fl, abs(amount)::HUGEINT * weight % total AS rest FROM x)
    SELECT id, part::INTEGER AS part, (sign(amount) * (fl + CASE WHEN row_number() OVER (PARTITION BY id ORDER BY rest DESC, part) <= abs(amount) - sum(fl) OVER (PARTITION BY id) THEN 1 ELSE 0 END))::BIGINT AS share_minor FROM y"""
)
def allocate_by_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    cents = F.round(F.col("o_totalprice").cast("decimal(15,2)") * 100, 0).cast("bigint") * F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)
    weights = F.expr("array(o_orderkey % 7 + 1, cast(o_custkey % 5 as bigint), 3L, o_orderkey % 11)")
    rows = orders.select(F.col("o_orderkey").alias("id"), cents.alias("amount"), weights.alias("weights"))
    return allocate(rows, "amount", "weights", ["id"]).select("id", "part", "share_minor")


@query(
    """WITH p AS (SELECT o_orderkey AS id, round(o_totalprice::DECIMAL(15,2) * 100)::BIGINT AS a, 2 + o_orderkey % 5 AS n FROM orders)
    SELECT id, i::INTEGER AS part, (a // n + CASE WHEN i < a % n THEN 1 ELSE 0 END)::BIGINT AS share_minor FROM (SELECT *, unnest(range(0, n)) AS i FROM p)"""
)
def split_evenly(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice").cast("decimal(15,2)") * 100, 0).cast("bigint").alias("amount"), (2 + F.col("o_orderkey") % 5).cast("int").alias("n"))
    return split_even(rows, "amount", F.col("n"), ["id"]).select("id", "part", "share_minor")


@query(
    """SELECT c_custkey, m AS minor, round(m::DECIMAL(19,0) * 0.075::DECIMAL(5,4))::BIGINT AS percent_minor, round(m::DECIMAL(19,0) * 52.1786::DECIMAL(9,4))::BIGINT AS scaled_minor,
        CASE WHEN m < 0 THEN '-' ELSE '' END || (abs(m) // 100) || '.' || lpad((abs(m) % 100)::VARCHAR, 2, '0') || ' USD' AS plain
    FROM (SELECT c_custkey, round(c_acctbal::DECIMAL(15,2) * 100)::BIGINT AS m FROM customer)"""
)
def percent_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", to_minor(F.col("c_acctbal").cast("decimal(15,2)")).alias("minor"))
    return rows.select(
        "c_custkey", "minor", percent_of(F.col("minor"), "7.5").alias("percent_minor"), scale_by(F.col("minor"), "52.1786").alias("scaled_minor"), plain_text(F.col("minor"), F.lit("USD")).alias("plain")
    )


@query(
    """WITH p AS (SELECT o_orderkey AS id, round(o_totalprice::DECIMAL(15,2) * 100)::BIGINT * (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END) AS a, (o_custkey % 7 - 3) * 100000::BIGINT AS b FROM orders)
    SELECT id, a + b AS added, a - b AS subtracted, sign(a - b)::INTEGER AS compared, a * 3 AS tripled, -a AS negated, abs(a) AS magnitude FROM p"""
)
def money_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, differences and comparisons of pairs of amounts, of one currency each."""
    cents = F.round(F.col("o_totalprice").cast("decimal(15,2)") * 100, 0).cast("bigint") * F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), cents.alias("a"), ((F.col("o_custkey") % 7 - 3) * 100_000).cast("bigint").alias("b"), F.when(F.col("o_custkey") % 2 == 0, "USD").otherwise("EUR").alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return rows.select(
        "id", add_minor(a, b, c, c).alias("added"), subtract_minor(a, b, c, c).alias("subtracted"), compare_minor(a, b, c, c).alias("compared"), times(a, 3).alias("tripled"), negated(a).alias("negated"), magnitude(a).alias("magnitude")
    )


# -- texts to amounts and dates ----------------------------------------------------------------

_AMOUNT_TEXTS = """texts AS (SELECT o_orderkey AS id, o_orderkey % 8 AS k, round(o_totalprice::DECIMAL(15,2) * 100)::BIGINT AS c FROM orders)"""


@query(
    f"""WITH {_AMOUNT_TEXTS} SELECT id, (CASE WHEN k IN (1, 2, 4) THEN -c WHEN k = 7 THEN 0 WHEN k = 6 THEN c // 100 * 100 ELSE c END)::BIGINT AS amount_minor, k <> 7 AS is_amount FROM texts"""
)
def parse_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same amounts written in eight ways."""
    cents = F.round(F.col("o_totalprice").cast("decimal(15,2)") * 100, 0).cast("bigint")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), cents.alias("c"))
    plain, grouped = to_major(F.col("c")).cast("decimal(15,2)").cast("string"), F.format_number(to_major(F.col("c")), 2)
    swapped = F.translate(grouped, ",.", ".,")
    whole = F.format_number(F.floor(F.col("c") / 100), 0)
    text = F.expr("cast(id % 8 as int)")
    dressed = (
        F.when(text == 0, plain)
        .when(text == 1, F.concat(F.lit("-$"), grouped))
        .when(text == 2, F.concat(F.lit("("), grouped, F.lit(")")))
        .when(text == 3, F.concat(F.lit("EUR "), swapped))
        .when(text == 4, F.concat(plain, F.lit("-")))
        .when(text == 5, F.concat(F.lit("  +"), plain, F.lit(" ")))
        .when(text == 6, F.concat(F.lit("£"), whole))
        .otherwise("n/a")
    )
    parsed = rows.select("id", parse_amount_minor(dressed).alias("m"))
    return parsed.select("id", F.coalesce("m", F.lit(0).cast("bigint")).alias("amount_minor"), F.col("m").isNotNull().alias("is_amount"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 = 7 THEN NULL ELSE o_orderdate::DATE::VARCHAR END AS posted_date FROM orders""")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same dates written in eight ways."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"))
    forms = ["yyyy-MM-dd", "MM/dd/yyyy", "yyyyMMdd", "dd-MMM-yyyy", "MMM d, yyyy", "M/d/yyyy", "yyyy/MM/dd"]
    text = F.lit("32/13/2020")
    for i, form in enumerate(forms):
        text = F.when(F.col("id") % 8 == i, F.date_format("d", form)).otherwise(text)
    return rows.select("id", parse_date(F.concat(F.lit(' "'), text, F.lit('"'))).cast("string").alias("posted_date"))


@query(
    """WITH t AS (SELECT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN day(o_orderdate) ELSE month(o_orderdate) END AS a, CASE WHEN o_custkey % 2 = 0 THEN month(o_orderdate) ELSE day(o_orderdate) END AS b FROM orders)
    SELECT o_custkey, count(*) FILTER (a > 12 AND b <= 12) > count(*) FILTER (b > 12 AND a <= 12) AS day_first FROM t GROUP BY o_custkey"""
)
def date_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = F.when(F.col("o_custkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    return infer_date_order(rows, text, ["o_custkey"])


# -- ledger queries and edits ------------------------------------------------------------------



def _basic(tx: DataFrame) -> DataFrame:
    return tx.select("id", F.col("posted_date").cast("string").alias("posted_date"), "amount_minor")



@query(f"WITH {NOISE_SQL} SELECT id, posted_date::VARCHAR AS posted_date, amount_minor FROM noise WHERE ledger_id = 'L7' AND account_id = '1' ORDER BY noise.posted_date DESC, id DESC LIMIT 5 OFFSET 2")
def account_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _basic(ledger.account_page(noise_ledger(spark, sf_dir), "L7", "1", 5, 2))


@query(f"WITH {NOISE_SQL} SELECT id, posted_date::VARCHAR AS posted_date, amount_minor FROM noise WHERE posted_date BETWEEN DATE '1996-03-01' AND DATE '1996-03-31'")
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _basic(ledger.between(noise_ledger(spark, sf_dir), "1996-03-01", "1996-03-31"))


@query(f"WITH {_KEYS} SELECT id, posted_date::VARCHAR AS posted_date, amount_minor FROM noise JOIN keys USING (raw_description) WHERE merchant_key = 'NETFLIX'")
def merchant_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _basic(ledger.merchant_history(with_merchant_key(noise_ledger(spark, sf_dir)), "NETFLIX"))


@query(f"WITH {_KEYS} SELECT DISTINCT merchant_key FROM noise JOIN keys USING (raw_description) WHERE category_id IS NULL")
def uncategorised_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.uncategorised_merchants(with_merchant_key(noise_ledger(spark, sf_dir)))


def _edited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tx = noise_ledger(spark, sf_dir)
    return tx, tx.filter(F.col("amount_minor") < -20_000_000).select("id")


@query(f"WITH {NOISE_SQL} SELECT coalesce(CASE WHEN amount_minor < -20000000 THEN 'BIG' ELSE category_id END, '-') AS category, count(*) AS n FROM noise GROUP BY ALL")
def assign_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = ledger.assign_category(*_edited(spark, sf_dir), "BIG")
    return tx.groupBy(F.coalesce("category_id", F.lit("-")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {NOISE_SQL} SELECT amount_minor < -20000000 AS is_transfer, count(*) AS n, sum(amount_minor)::BIGINT AS amount_minor FROM noise GROUP BY ALL")
def mark_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx, ids = _edited(spark, sf_dir)
    marked = ledger.mark_transfer(tx.withColumn("is_transfer", F.lit(False)), ids)
    return marked.groupBy("is_transfer").agg(F.count(F.lit(1)).alias("n"), sum_minor(F.col("amount_minor")).alias("amount_minor"))


@query(
    f"""WITH {NOISE_SQL}, n AS (SELECT *, ledger_id = 'L7' AND account_id = '1' AS gone FROM noise)
    SELECT ledger_id, account_id, count(*) AS n, count(DISTINCT batch_id) AS batches FROM n WHERE NOT gone GROUP BY ALL"""
)
def delete_account_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account 1 of one ledger, with its transactions and batches; the others have accounts of that name, too."""
    tx = noise_ledger(spark, sf_dir)
    accounts = tx.select("ledger_id", F.col("account_id").alias("id")).distinct()
    batches = tx.select("ledger_id", F.col("batch_id").alias("id"), "account_id").distinct()
    left = ledger.delete_account(ledger.Ledger(tx, batches, accounts), "L7", "1")
    key = ["ledger_id", "account_id"]
    counts = left.transactions.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).join(left.import_batches.groupBy(*key).agg(F.count(F.lit(1)).alias("batches")), key)
    return counts.join(left.accounts.withColumnRenamed("id", "account_id"), key, "left_semi")


@query(
    f"""WITH {NOISE_SQL} SELECT ledger_id, CASE WHEN NOT (ledger_id = 'L7' AND batch_id = 'B2') THEN batch_id END AS import_batch_id, CASE WHEN NOT (ledger_id = 'L7' AND coalesce(category_id, '') = 'C3') THEN category_id END AS category_id, count(*) AS n
    FROM noise GROUP BY ALL"""
)
def delete_batch_and_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch's record and a category of one ledger go: its transactions stay without them, those of other ledgers as they are."""
    tx = noise_ledger(spark, sf_dir).withColumnRenamed("batch_id", "import_batch_id")
    batches = tx.select("ledger_id", F.col("import_batch_id").alias("id"), "account_id").distinct()
    kept = ledger.delete_batch(ledger.Ledger(tx, batches, tx.select("ledger_id", F.col("account_id").alias("id")).distinct()), "L7", "B2").transactions
    categories = tx.select("ledger_id", F.col("category_id").alias("id")).distinct().withColumn("parent_id", F.lit(None).cast("string"))
    kept, _ = ledger.delete_category(kept, categories, "L7", "C3")
    return kept.groupBy("ledger_id", "import_batch_id", "category_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {NOISE_SQL}, b AS (SELECT ledger_id, account_id, max(posted_date)::VARCHAR AS last_date, count(*) AS n FROM noise GROUP BY ALL)
    SELECT ledger_id, account_id, CASE WHEN account_id::BIGINT % 2 = 1 THEN last_date ELSE '2030-01-01' END AS last_date, CASE WHEN account_id::BIGINT % 2 = 1 THEN n ELSE 0 END AS n FROM b"""
)
def upsert_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every account's last day; even accounts replaced by an update."""
    key = ["ledger_id", "account_id"]
    base = noise_ledger(spark, sf_dir).groupBy(*key).agg(F.max("posted_date").cast("string").alias("last_date"), F.count(F.lit(1)).alias("n"))
    updates = base.filter(F.col("account_id").cast("long") % 2 == 0).select(*key, F.lit("2030-01-01").alias("last_date"), F.lit(0).cast("bigint").alias("n"))
    return ledger.upsert(base, updates, key)


# -- accounts, batches, history ----------------------------------------------------------------


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An account per customer: every seventh is archived, every third owes money by its kind."""
    k = F.col("c_custkey")
    kinds = F.array(*[F.lit(t) for t in ("CHECKING", "CREDIT_CARD", "SAVINGS", "LOAN", "CASH", "INVESTMENT")])
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.concat(F.lit("L"), k % 50).alias("ledger_id"),
        F.expr("cast(c_custkey div 50 as string)").alias("id"),
        F.col("c_name").alias("display_name"),
        F.lit("Bank").alias("institution"),
        F.get(kinds, (k % 6).cast("int")).alias("type"),
        F.lit("USD").alias("currency"),
        F.lpad((k % 10_000).cast("string"), 4, "0").alias("mask"),
        (k % 7 == 0).alias("is_archived"),
    )


_ACCOUNTS = """a AS (SELECT 'L' || (c_custkey % 50) AS ledger_id, (c_custkey // 50)::VARCHAR AS id, c_name AS display_name,
        ['CHECKING', 'CREDIT_CARD', 'SAVINGS', 'LOAN', 'CASH', 'INVESTMENT'][(c_custkey % 6 + 1)::INTEGER] AS type, c_custkey % 7 = 0 AS is_archived FROM customer)"""


@query(f"WITH {_ACCOUNTS} SELECT ledger_id, id, display_name, type IN ('CREDIT_CARD', 'LOAN') AS is_liability, row_number() OVER (PARTITION BY ledger_id ORDER BY display_name) AS place FROM a WHERE NOT is_archived")
def active_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active accounts by name, with their place in their ledger; those that do not fit an account's rules would be left out."""
    rows = ledger.accounts_by_name(_accounts(spark, sf_dir).filter(valid_account()))
    place = F.row_number().over(Window.partitionBy("ledger_id").orderBy("display_name"))
    return rows.select("ledger_id", "id", "display_name", is_liability(F.col("type")).alias("is_liability"), place.alias("place"))


@query(f"WITH {NOISE_SQL}, c AS (SELECT DISTINCT ledger_id, category_id AS id FROM noise WHERE category_id IS NOT NULL) SELECT ledger_id, id, 'Category ' || id AS name, CASE WHEN id = 'C1' THEN 'INCOME' ELSE 'EXPENSE' END AS kind FROM c WHERE id <> 'C5'")
def active_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = noise_ledger(spark, sf_dir).filter("category_id is not null").select("ledger_id", F.col("category_id").alias("id")).distinct()
    kind = F.when(F.col("id") == "C1", "INCOME").otherwise("EXPENSE")
    rows = found.withColumns({"name": F.concat(F.lit("Category "), "id"), "kind": kind, "parent_id": F.lit(None).cast("string"), "is_essential": F.lit(False), "is_archived": F.col("id") == "C5"})
    return ledger.categories_by_name(rows.filter(valid_category())).select("ledger_id", "id", "name", "kind")


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch record for each account's day of orders."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey", F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(
        F.concat(F.lit("L"), F.col("o_custkey") % 50).alias("ledger_id"), F.expr("concat('B', o_custkey div 50, '-', d)").alias("id"), F.expr("cast(o_custkey div 50 as string)").alias("account_id"),
        (F.col("d").cast("timestamp") + F.expr("make_interval(0, 0, 0, 0, 0, 0, o_custkey)")).alias("imported_at"), F.col("n").alias("rows_parsed"), F.col("n").alias("rows_imported"), F.lit(0).cast("bigint").alias("rows_duplicate"), F.lit(0).cast("bigint").alias("rows_failed"),
    )


_BATCHES = """b AS (SELECT 'L' || (o_custkey % 50) AS ledger_id, 'B' || (o_custkey // 50) || '-' || o_orderdate::DATE AS id, (o_custkey // 50)::VARCHAR AS account_id, o_orderdate::DATE::TIMESTAMP + to_seconds(o_custkey) AS imported_at,
        count(*) AS rows_parsed FROM orders GROUP BY o_custkey, o_orderdate::DATE)"""


@query(f"WITH {_BATCHES} SELECT ledger_id, id, strftime(imported_at, '%Y-%m-%d %H:%M:%S') AS imported_at, rows_parsed FROM b ORDER BY b.imported_at DESC LIMIT 20")
def recent_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 newest."""
    rows = ledger.recent_batches(_batches(spark, sf_dir).filter(valid_batch()))
    return rows.select("ledger_id", "id", F.date_format("imported_at", "yyyy-MM-dd HH:mm:ss").alias("imported_at"), "rows_parsed")


@query(f"WITH {_BATCHES} SELECT id, strftime(imported_at, '%Y-%m-%d %H:%M:%S') AS imported_at FROM b WHERE ledger_id = 'L7' AND account_id = '1'")
def batches_of_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.batches_of_account(_batches(spark, sf_dir), "L7", "1").select("id", F.date_format("imported_at", "yyyy-MM-dd HH:mm:ss").alias("imported_at"))


@query(f"WITH {NOISE_SQL} SELECT ledger_id, id, posted_date::VARCHAR AS posted_date, amount_minor < 0 AS is_debit, amount_minor > 0 AS is_credit, row_number() OVER (PARTITION BY ledger_id ORDER BY noise.posted_date, id) AS place FROM noise")
def full_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transactions, the oldest first, with their place in their ledger."""
    tx = ledger.full_history(noise_ledger(spark, sf_dir))
    place = F.row_number().over(Window.partitionBy("ledger_id").orderBy("posted_date", "id"))
    return tx.select("ledger_id", "id", F.col("posted_date").cast("string").alias("posted_date"), is_debit(F.col("amount_minor")).alias("is_debit"), is_credit(F.col("amount_minor")).alias("is_credit"), place.alias("place"))


@query(f"WITH {NOISE_SQL} SELECT 'all' AS what, count(*) AS transactions FROM noise UNION ALL SELECT 'one', count(*) FILTER (ledger_id = 'L7' AND id = '000000000007') FROM noise")
def transaction_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many there are, and how many of one id in one ledger."""
    tx = noise_ledger(spark, sf_dir)
    counts = [ledger.transaction_count(t).select(F.lit(n).alias("what"), "transactions") for n, t in (("all", tx), ("one", ledger.by_id(tx, "L7", "000000000007")))]
    return counts[0].unionByName(counts[1])


@query(f"WITH {_ACCOUNTS} SELECT ledger_id, id, display_name FROM a WHERE ledger_id <> 'L7' UNION ALL SELECT 'L7', 'default', 'My account' FROM customer WHERE c_custkey = (SELECT min(c_custkey) FROM customer)")
def default_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ledger has no account yet and gets one; another has some and keeps them."""
    accounts = _accounts(spark, sf_dir).filter("ledger_id <> 'L7'")
    return imports.default_account(imports.default_account(accounts, "L7"), "L8").select("ledger_id", "id", "display_name")


from . import statement_queries  # noqa: E402, F401 - its queries register themselves
