import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import reference
from ledgerloom.operators import recurring, subscriptions
from ledgerloom.plans import driver_ledger, registry

AS_OF = "2026-07-01"
TX = "ledger_id string, id string, merchant_key string, posted_date date, amount_minor long, currency string, is_transfer boolean"


def months(start, n, step=1):
    out = []
    for i in range(n):
        y, m = divmod(start.month - 1 + i * step, 12)
        last = [31, 29 if (start.year + y) % 4 == 0 else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m]
        out.append(dt.date(start.year + y, m + 1, min(start.day, last)))
    return out


def every(start, n, days):
    return [start + dt.timedelta(days=days * i) for i in range(n)]


J15 = dt.date(2026, 1, 15)


def ledger(spark, charges, transfer=False):
    return spark.createDataFrame(
        [(lid, f"{m}-{i:04d}", m, d, a, "USD", transfer) for lid, m, pairs in charges for i, (d, a) in enumerate(pairs)], TX
    )


def same(dates, amount):
    return [(d, amount) for d in dates]


@pytest.mark.parametrize(
    "dates, cadence, missed",
    [
        (months(J15, 6), "MONTHLY", 0),
        (every(J15, 8, 7), "WEEKLY", 0),
        (every(J15, 8, 14), "FORTNIGHTLY", 0),
        (every(J15, 8, 28), "FOUR_WEEKLY", 0),
        (months(J15, 5, 3), "QUARTERLY", 0),
        (months(J15, 4, 12), "ANNUAL", 0),
        ([months(J15, 7)[i] for i in (0, 1, 2, 4, 5, 6)], "MONTHLY", 1),
        ([dt.date(2026, 1, 31), dt.date(2026, 2, 28), dt.date(2026, 3, 31), dt.date(2026, 4, 30), dt.date(2026, 5, 31)], "MONTHLY", 0),
    ],
)
def test_cadences(spark, dates, cadence, missed):
    (r,) = recurring.detect_recurring(ledger(spark, [("L", "X", same(dates, -1599))])).collect()
    assert (r["cadence"], r["missed"], r["charges"]) == (cadence, missed, len(dates))
    assert r["confidence"] > 0.8


def test_nothing_recurring(spark):
    days = [dt.date(2026, 3, d) for d in (3, 9, 10, 21, 22, 23, 28)]
    tx = ledger(
        spark,
        [
            ("L", "GROCER", same(days, -500)),
            ("L", "TWICE", same(months(J15, 2), -500)),
            ("L", "SALARY", same(months(J15, 6), 500)),
            ("L", "CAFE", same([J15] * 5 + [J15 + dt.timedelta(days=i) for i in (1, 2, 3)], -500)),
        ],
    )
    assert recurring.detect_recurring(tx).count() == 0
    assert recurring.detect_recurring(ledger(spark, [("L", "X", same(months(J15, 6), -500))], transfer=True)).count() == 0


def test_costs(spark):
    tx = ledger(spark, [("L", "NETFLIX", same(months(J15, 6), -1599)), ("L", "GYM", same(every(J15, 8, 28), -3500)), ("L", "ODD", [(d, -1000) for d in months(J15, 4)] + [(dt.date(2026, 5, 15), -50000)])])
    got = {r["merchant_key"]: r for r in recurring.detect_recurring(tx).collect()}
    assert (got["NETFLIX"]["annual_minor"], got["NETFLIX"]["monthly_minor"], got["NETFLIX"]["next_expected"]) == (19468, 1622, dt.date(2026, 7, 15))
    assert got["GYM"]["annual_minor"] == 45656 and got["ODD"]["typical_minor"] == -1000


def by_hand(dates, amounts):
    """The detector restated for one merchant: (cadence, matched, missed, confidence) or None."""
    gaps = [(b - a).days for a, b in zip(dates, dates[1:])]

    def explains(days, tol, g):
        return next((p for p in (1, 2, 3) if abs(g - p * days) <= p * tol), None)

    table = {n: (d, t) for n, d, t, _ in reference.CADENCES}
    cadence = reference.nearest_cadence(sorted(gaps)[len(gaps) // 2])
    if cadence is None:
        votes = [(sum(explains(d, t, g) is not None for g in gaps), n) for n, (d, t) in table.items()]
        votes = [v for v in votes if v[0] > len(gaps) // 2]
        cadence = max(votes, key=lambda v: v[0])[1] if votes else None
    if cadence is None:
        return None
    if cadence in ("MONTHLY", "FOUR_WEEKLY"):
        last = lambda d: (d.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)
        near = lambda d: abs(d.day - dates[0].day) <= 1 or max((last(x) - x).days for x in (d, dates[0])) <= 3
        cadence = "MONTHLY" if all(map(near, dates)) else "FOUR_WEEKLY"
    ps = [p for g in gaps if (p := explains(*table[cadence], g))]
    if len(ps) / len(gaps) < 0.6:
        return None
    values = [float(abs(a)) for a in amounts]
    mid = sorted(values)[len(values) // 2]
    stability = min(1, max(0, 1 - sum(abs(v - mid) for v in values) / len(values) / mid))
    n = len(dates)
    volume = 1.0 if n >= 12 else 0.9 if n >= 6 else 0.8 if n >= 4 else 0.7
    missed = sum(p - 1 for p in ps)
    c = len(ps) / len(gaps) * 0.5 + volume * 0.2 + stability * 0.2 + (1 - min(missed / (len(gaps) + 1), 0.5)) * 0.1
    return (cadence, len(ps), missed, round(c, 9)) if c >= 0.4 else None


def test_random_ledgers_against_restatement(spark):
    rng, cases = random.Random(3), {}
    for k in range(300):
        step = rng.choice([7, 14, 28, 30, 91, 182, 365, 20, 45])
        day, dates = dt.date(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 300)), []
        for _ in range(rng.randint(3, 14)):
            dates.append(day)
            day += dt.timedelta(days=max(1, step * rng.choice([1, 1, 1, 1, 2, 3]) + rng.randint(-3, 3) * rng.randint(0, 1)))
        cases[f"M{k}"] = [(d, -rng.choice([1000, 1000, 1100, 5000])) for d in dates]
    got = {r["merchant_key"]: (r["cadence"], r["matched"], r["missed"], round(r["confidence"], 9)) for r in recurring.detect_recurring(ledger(spark, [("L", m, p) for m, p in cases.items()])).collect()}
    want = {m: v for m, p in cases.items() if (v := by_hand([d for d, _ in p], [a for _, a in p]))}
    assert got == want and len(want) > 50


def report(spark, charges, overrides=None):
    over = spark.createDataFrame(overrides, "ledger_id string, merchant_key string, service_class string") if overrides else None
    return subscriptions.analyse_ledger(ledger(spark, charges), AS_OF, overrides=over)


def test_duplicates_and_totals(spark):
    got = report(spark, [("L", "DROPBOX", same(months(J15, 6), -1199)), ("L", "GOOGLE STORAGE", same(months(J15, 6), -199)), ("L", "NETFLIX", same(months(J15, 6), -1599)), ("L", "HULU", same(months(J15, 6), -1599))])
    (d,) = got.duplicates.collect()
    assert (d["service_class"], d["saving_minor"], d["merchants"]) == ("CLOUD_STORAGE", 14598, ["DROPBOX", "GOOGLE STORAGE"])
    (t,) = got.totals.collect()
    assert (t["active"], t["saving_minor"]) == (4, 14598)
    assert subscriptions.report_totals(got.subscriptions, strict=True).count() == 1


def test_overrides(spark):
    clubs = [("L", "CLUB A", same(months(J15, 6), -8500)), ("L", "CLUB B", same(months(J15, 6), -4500))]
    assert report(spark, clubs).duplicates.count() == 0
    (d,) = report(spark, clubs, [("L", "CLUB A", "FITNESS"), ("L", "CLUB B", "FITNESS")]).duplicates.collect()
    assert d["saving_minor"] == 103488
    music = [("L", "APPLE MUSIC", same(months(J15, 6), -999)), ("L", "SPOTIFY", same(months(J15, 6), -999))]
    assert report(spark, music).duplicates.count() == 1
    for cls in (None, "NO SUCH CLASS"):
        got = report(spark, music, [("L", "APPLE MUSIC", cls), ("L", "X", "VPN")])
        assert got.duplicates.count() == 0 and subscriptions.active(got.subscriptions).count() == 2
    assert subscriptions.untagged_merchants(report(spark, clubs).subscriptions).count() == 2


@pytest.mark.parametrize(
    "amounts, rise",
    [
        ([1599] * 4 + [1799] * 3, (1599, 1799, 2435, dt.date(2026, 5, 15))),
        ([999, 999, 4999, 999, 999], None),
        ([1000, 1001, 1002, 1001, 1002], None),
        ([1799] * 3 + [1599] * 3, None),
        ([1000, 1000, 1000, 1500], (1000, 1500, None, None)),
        ([1000, 1200, 1400], None),
    ],
)
def test_price_rises(spark, amounts, rise):
    got = report(spark, [("L", "NETFLIX", [(d, -a) for d, a in zip(months(J15, len(amounts)), amounts, strict=True)])]).price_increases.collect()
    if rise is None:
        assert got == []
    else:
        (r,) = got
        assert (r["previous_minor"], r["current_minor"]) == rise[:2]
        if rise[2]:
            assert (r["impact_minor"], r["changed_on"]) == rise[2:]


def test_runs_round_as_decimals_do(spark):
    rng = random.Random(2)
    lists = [[rng.randint(0, 300) for _ in range(rng.randint(1, 8))] for _ in range(200)]

    def by_hand(values):
        out = [[values[0], 0]]
        for v in values:
            ratio = (Decimal(abs(v - out[-1][0])) / max(out[-1][0], 1)).quantize(Decimal("0.0001"), ROUND_HALF_UP)
            if ratio <= Decimal("0.02"):
                out[-1][1] += 1
            else:
                out.append([v, 1])
        return out

    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, a array<long>").withColumn("r", subscriptions.amount_runs(F.col("a")))
    assert all([[x["rep"], x["n"]] for x in r["r"]] == by_hand(lists[r["i"]]) for r in df.collect())


def test_many_customers_are_dealt_over_tasks_before_their_rows_are_made(spark, tmp_path, monkeypatch):
    spark.range(1, 101).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    whole = driver_ledger.rhythm_ledger(spark, str(tmp_path))
    monkeypatch.setattr(driver_ledger, "CUSTOMERS_A_TASK", 10)
    dealt = driver_ledger.rhythm_ledger(spark, str(tmp_path))
    assert dealt.rdd.getNumPartitions() == 11
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, whole.collect()))


def test_dealt_customers_are_not_dealt_again(spark, monkeypatch):
    """Partitions grow with the customers up to the series: else those after a shuffle are as many as the session has, and grow with all rows."""
    monkeypatch.setattr(driver_ledger, "CUSTOMERS_A_TASK", 10)
    series = recurring.detect_recurring(driver_ledger.rhythm_ledger(spark, "/root/testdata/sf0.001"))
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()
    assert series.rdd.getNumPartitions() == customers // 10 + 1 > int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("name", ["subscriptions_active", "subscriptions_cancelled", "classified_merchants"])
def test_classes_are_joined_where_the_series_are(spark, monkeypatch, name):
    """Neither the series nor the overrides are dealt again for their join: its tasks, too, grow in number with the customers."""
    monkeypatch.setattr(driver_ledger, "CUSTOMERS_A_TASK", 10)
    subs = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()
    assert subs.rdd.getNumPartitions() == customers // 10 + 1 > int(spark.conf.get("spark.sql.shuffle.partitions"))
