import datetime as dt
import hashlib
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, dates, merchants, money, reference

from .conftest import rows

AMOUNTS = {
    "-1234.56": "-1234.56",
    "1,234.56": "1234.56",
    "$1,234.56": "1234.56",
    "(1,234.56)": "-1234.56",
    "1234.56-": "-1234.56",
    "1.234,56": "1234.56",
    "1 234,56": "1234.56",
    "1 234,56": "1234.56",
    "USD 1,234.56": "1234.56",
    "-$1,234.56": "-1234.56",
    "10.005": "10005",
    "10.0050": "10.005",
    "12,34": "12.34",
    "1,234": "1234",
    "1.234.567": "1234567",
    "STORE 12": "12",
    "+5": "5",
    ".5": "0.5",
    "": None,
    "abc": None,
    "1-2": None,
    None: None,
}

DATES = {
    "2026-03-14": dt.date(2026, 3, 14),
    "03/14/2026": dt.date(2026, 3, 14),
    "14/03/2026": dt.date(2026, 3, 14),
    "01/02/2026": dt.date(2026, 1, 2),
    "3/4/26": dt.date(2026, 3, 4),
    "3/4/99": dt.date(1999, 3, 4),
    "20260314": dt.date(2026, 3, 14),
    "14-Mar-2026": dt.date(2026, 3, 14),
    "Mar 4, 2026": dt.date(2026, 3, 4),
    "March 4, 2026": dt.date(2026, 3, 4),
    "14-Mar-26": dt.date(2026, 3, 14),
    '"03/14/2026"': dt.date(2026, 3, 14),
    "03/14/2026 10:00": dt.date(2026, 3, 14),
    "14-Mar-2026 10:00": None,
    "02/30/2026": None,
    "13/13/2026": None,
    "20260231": None,
    "": None,
    None: None,
}

KEYS = {
    "SQ *BLUE BOTTLE COFFEE #47 OAKLAND CA": "BLUE BOTTLE COFFEE",
    "TST* CHIPOTLE": "CHIPOTLE",
    "PAYPAL *SQ *THE COFFEE SHOP": "THE COFFEE SHOP",
    "POS DEBIT STARBUCKS": "STARBUCKS",
    "PURCHASE AUTHORIZED ON 05/12 SAFEWAY": "SAFEWAY",
    "NETFLIX.COM 866-579-7172 CA": "NETFLIX",
    "AMZN Mktp US*2A3B4C5D6": "AMAZON",
    "WHOLEFDS MKT #123 SAN FRANCISCO CA": "WHOLE FOODS",
    "  TRADER  JOE'S   #123  ": "TRADER JOES",
    "1PASSWORD": "1PASSWORD",
    "NEW YORK LIFE": "NEW YORK LIFE",
    "FORT WORTH TX": "FORT WORTH",
    "#### ####": "UNKNOWN",
    "000000123456789": "000000123456789",
}


def test_amounts(spark):
    df = spark.createDataFrame(list(AMOUNTS.items()), "raw string, want string")
    wrong = df.withColumn("got", amounts.parse_decimal(F.col("raw"))).filter("not (got <=> cast(want as decimal(38,10)))")
    assert rows(wrong) == []


def test_minor_units_round_half_up_and_overflow_is_null(spark):
    df = spark.createDataFrame([("1.005", 2), ("10.0005", 3), ("1,2345", 0), ("99999999999999999999", 2)], "raw string, scale int")
    got = df.select(amounts.parse_amount_minor(F.col("raw"), F.col("scale"))).collect()
    assert [r[0] for r in got] == [100500, 10001, 1, None]


def test_dates(spark):
    df = spark.createDataFrame(list(DATES.items()), "raw string, want date")
    assert rows(df.withColumn("got", dates.parse_date(F.col("raw"))).filter("not (got <=> want)")) == []
    day_first = spark.createDataFrame([("01/02/2026",)], "raw string").select(dates.parse_date(F.col("raw"), True))
    assert rows(day_first) == [(dt.date(2026, 2, 1),)]


def test_date_order(spark):
    df = spark.createDataFrame([("a", "13/01/2026"), ("a", "01/02/2026"), ("b", "01/02/2026"), ("c", "01/20/2026"), ("c", "2026-20-01")], "f string, d string")
    assert rows(dates.infer_date_order(df, F.col("d"), ["f"])) == [("a", True), ("b", False), ("c", False)]


def test_merchant_keys_and_names(spark):
    df = spark.createDataFrame(list(KEYS.items()), "raw string, want string")
    assert rows(df.withColumn("got", merchants.normalise_merchant(F.col("raw"))).filter("not (got <=> want)")) == []
    again = df.withColumn("got", merchants.normalise_merchant(F.col("want"))).filter("got <> want and want not like '0%'")
    assert rows(again) == []
    names = spark.createDataFrame([("SQ *BLUE BOTTLE COFFEE #47 OAKLAND CA",), ("BP FUEL",), ("BANK OF THE WEST",)], "raw string")
    assert [r[0] for r in names.select(merchants.merchant_display_name(F.col("raw"))).collect()] == ["Blue Bottle Coffee", "BP Fuel", "Bank of the West"]


def test_every_city_of_the_list_goes_before_a_state(spark):
    assert len(reference.CITIES) == 412
    assert hashlib.sha256("\n".join(sorted(reference.CITIES)).encode()).hexdigest() == "0c7d76d800b0c893174ab559cfef7718395a6b6c31e528d03532635ccd70e032"
    named = {"AKRON": "", "ANN ARBOR": "", "ATLANTIC CITY": "", "NORTH LAS VEGAS": "", "WEST VALLEY CITY": "", "PORT ST LUCIE": "", "WINSTON": "", "CLEVELAND": " CLEVELAND"}
    items = [(f"SAFEWAY #12 {city} OH", "SAFEWAY" + rest) for city, rest in (dict.fromkeys(reference.CITIES, "") | named).items()]
    items += [("AKRON OH", "AKRON"), ("SAFEWAY AKRON", "SAFEWAY AKRON"), ("LAS VEGAS NV", "LAS VEGAS"), ("NORTH LAS VEGAS NV", "NORTH"), ("OH", "OH"), ("X OH OH", "X OH"), ("FORGET ME", "FORGET"), ("A NORTH LAS VEGAS NV", "A")]
    df = spark.createDataFrame(items, "raw string, want string")
    assert rows(df.withColumn("got", merchants.normalise_merchant(F.col("raw"))).filter("not (got <=> want)")) == []


def test_cadence_ranges():
    assert reference.cadence_ranges() == [
        ("WEEKLY", 5, 9),
        ("FORTNIGHTLY", 11, 17),
        ("FOUR_WEEKLY", 26, 28),
        ("MONTHLY", 29, 34),
        ("QUARTERLY", 81, 101),
        ("SEMIANNUAL", 167, 197),
        ("ANNUAL", 344, 386),
    ]
    assert [str(reference.annual_factor(d)) for _, d, _, _ in reference.CADENCES] == ["52.1786", "26.0893", "13.0446", "12.1750", "4.0137", "2.0069", "1.0007"]


def test_allocation_conserves_totals(spark):
    rng = random.Random(5)
    cases = [(i, rng.randint(-(10**9), 10**9), [rng.randint(0, 1000) for _ in range(rng.randint(1, 12))] + [1]) for i in range(300)]
    shares = money.allocate(spark.createDataFrame(cases, "id int, amount long, weights array<long>"), "amount", "weights", ["id"])
    got = {}
    for r in sorted(shares.collect(), key=lambda r: r["part"]):
        got.setdefault(r["id"], []).append(r["share_minor"])
    for i, amount, weights in cases:
        total, size = sum(weights), abs(amount)
        want = [size * w // total for w in weights]
        for k in sorted(range(len(weights)), key=lambda k: (-(size * weights[k] % total), k))[: size - sum(want)]:
            want[k] += 1
        assert got[i] == [w if amount >= 0 else -w for w in want] and sum(got[i]) == amount


def test_even_split_and_bad_weights(spark):
    df = spark.createDataFrame([(1, 100)], "id int, amount long")
    assert [r["share_minor"] for r in money.split_even(df, "amount", 3, ["id"]).orderBy("part").collect()] == [34, 33, 33]
    with pytest.raises(Exception, match="weights"):
        money.allocate(spark.createDataFrame([(1, 5, [0, 0])], "id int, amount long, w array<long>"), "amount", "w", ["id"]).collect()


def test_scaling_and_text(spark):
    df = spark.createDataFrame([(1599, "12.1750"), (-1599, "12.1750"), (5, "0.5"), (-5, "0.5")], "m long, f string")
    assert [r[0] for r in df.select(money.scale_by(F.col("m"), F.col("f").cast("decimal(9,4)"))).collect()] == [19468, -19468, 3, -3]
    text = spark.createDataFrame([(-123456, "USD", 2), (5, "USD", 2), (7, "JPY", 0)], "m long, c string, s int")
    assert [r[0] for r in text.select(money.plain_text(F.col("m"), F.col("c"), F.col("s"))).collect()] == ["-1234.56 USD", "0.05 USD", "7 JPY"]
    with pytest.raises(Exception, match="digits"):
        spark.createDataFrame([(Decimal("1.005"),)], "d decimal(10,3)").select(money.to_minor(F.col("d"))).collect()
    with pytest.raises(Exception, match="unknown currency"):
        money.with_scale(spark.createDataFrame([("ZZZ",)], "currency string")).collect()
    with pytest.raises(Exception, match="mixed"):
        spark.createDataFrame([("USD",), ("EUR",)], "c string").agg(money.one_currency(F.col("c"))).collect()


def test_merchant_keys_beside_a_column_of_that_name(spark):
    df = spark.createDataFrame([("SHELL OIL", 1, 2)], "raw_description string, _raw int, _raw_ int")
    assert rows(merchants.with_merchant_key(df)) == [("SHELL OIL", 1, 2, "SHELL OIL")]


def test_guarded_arithmetic(spark):
    top = 2**63 - 1
    df = spark.createDataFrame([(5, -7, "USD", "USD"), (None, 1, "USD", "USD"), (1, 1, None, "USD"), (3, 3, "EUR", "EUR")], "a long, b long, c string, d string")
    a, b, c, d = (F.col(x) for x in "abcd")
    got = df.select(money.add_minor(a, b, c, d), money.subtract_minor(a, b, c, d), money.compare_minor(a, b, c, d), money.times(a, -2), money.negated(a), money.magnitude(b))
    assert [tuple(r) for r in got.collect()] == [(-2, 12, 1, -10, -5, 7), (None, None, None, None, None, 1), (None, None, None, -2, -1, 1), (6, 0, 0, -6, -3, 3)]
    bad = spark.createDataFrame([(1, 2, "USD", "EUR")], "a long, b long, c string, d string")
    for f in (money.add_minor, money.subtract_minor, money.compare_minor):
        with pytest.raises(Exception, match="mixed currencies USD and EUR"):
            bad.select(f(a, b, c, d)).collect()
    wide = spark.createDataFrame([(top, 1, -top - 1)], "a long, b long, c long")
    usd = F.lit("USD")
    for x in (money.add_minor(a, b, usd, usd), money.subtract_minor(F.col("c"), b, usd, usd), money.times(a, 2), money.negated(F.col("c")), money.magnitude(F.col("c"))):
        with pytest.raises(Exception, match="OVERFLOW"):
            wide.select(x).collect()
    assert [tuple(r) for r in wide.select(money.is_positive(a), money.is_negative(F.col("c")), money.is_zero(b)).collect()] == [(True, True, False)]
