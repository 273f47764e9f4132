"""Crowd figures and valuation on literal cases."""

import pytest
from pyspark.sql import functions as F

from titletide.operators import crowd as cr
from titletide.operators import valuation as va

GROUP = ("g", "US", "loose", "USD")


def reports(spark, *prices):
    rows = [(a, *GROUP, float(p)) for a, p in prices]
    return spark.createDataFrame(rows, "account STRING, game STRING, region STRING, condition STRING, currency STRING, price DOUBLE")


def crowd(spark, *prices):
    return cr.crowd_prices(reports(spark, *prices), published=False).collect()


def test_outlier_is_held(spark):
    r = crowd(spark, *[(f"a{i}", p) for i, p in enumerate((20, 22, 24, 25, 26, 1000))])[0]
    assert (r.published, r.held, r.reporters, r.median, r.low, r.high) == (True, 1, 5, 24.0, 20.0, 26.0)


def test_majority_high(spark):
    r = crowd(spark, *[(f"a{i}", p) for i, p in enumerate((900, 950, 1000, 1000, 1100, 20))])[0]
    assert (r.published, r.held, r.median) == (True, 1, 1000.0)


def test_split_crowd_and_spam(spark):
    r = crowd(spark, *[(f"a{i}", p) for i, p in enumerate((1, 1, 1, 100, 100, 100))])[0]
    assert not r.published and r.median is None
    assert crowd(spark, *[("spam", 5)] * 50, ("a", 1), ("b", 2), ("c", 3)) == []


def test_report_checks(spark):
    rows = [("ok game", "US", "loose", "USD", 5.0, m) for m in ("2026-10", "2024-10", "2026-11", "2024-09", "2026-13")]
    rows += [("Bad Game", "US", "loose", "USD", 5.0, "2026-10"), ("ok game", "EU", "loose", "USD", 5.0, "2026-10"),
             ("ok game", "US", "mint", "USD", 5.0, "2026-10"), ("ok game", "US", "loose", "CHF", 5.0, "2026-10"),
             ("ok game", "US", "loose", "USD", 20001.0, "2026-10"), ("ok game", "US", "loose", "USD", 0.001, "2026-10")]
    frame = spark.createDataFrame(rows, "game STRING, region STRING, condition STRING, currency STRING, price DOUBLE, month STRING")
    got = [r.problem for r in cr.validate_reports(frame, F.lit(2026 * 12 + 9)).collect()]
    assert got == [None, None, "month", "month", "month", "game", "region", "condition", "currency", "price", "price"]


def test_owners_and_wanted(spark):
    rows = [(f"a{i}", "g1", 0, 1, 0) for i in range(5)] + [("a9", "g1", 0, 0, 0)] + [(f"a{i}", "g2", 1, 0, 0) for i in range(4)]
    frame = spark.createDataFrame(rows, "account STRING, game STRING, sealed INT, complete INT, loose INT")
    assert [(r.game, r.owners, r.complete) for r in cr.crowd_owners(frame).collect()] == [("g1", 5, 5)]
    assert [r.game for r in cr.wanted(frame).collect()] == ["g1", "g2"]
    assert [r.game for r in cr.wanted(frame, sealed=True).collect()] == ["g2"]


def test_conversion(spark):
    fx = spark.createDataFrame([("USD", 1.25), ("GBP", 0.8)], "currency STRING, per_eur DOUBLE")
    rows = spark.createDataFrame([("USD", 5.0), ("GBP", 80.0), ("EUR", 10.0), ("CHF", 5.0)], "currency STRING, amount DOUBLE")
    got = {r.currency: (r.eur, r.converted) for r in va.to_eur(rows, fx).collect()}
    assert got == {"USD": (4.0, True), "GBP": (100.0, True), "EUR": (10.0, False), "CHF": (5.0, False)}


def test_collection(spark):
    held = spark.createDataFrame([("God Hand", "US", "complete", 3, 90.0), ("God Hand", "PAL", "loose", 1, None), ("Kuon", "US", "loose", 1, None),
                                  ("Rule of Rose", "US", "sealed", 1, None)], "title STRING, region STRING, condition STRING, qty INT, paid DOUBLE")
    latest = spark.createDataFrame([("God Hand", "US", 100.0, 130.0, False), ("God Hand", "UK", 60.0, None, False), ("Kuon", "US", 1000.0, None, True)],
                                   "title STRING, site STRING, median DOUBLE, complete_median DOUBLE, unmatched BOOLEAN")
    refs = spark.createDataFrame([("Rule of Rose", "US", "sealed", 1160.0, "USD"), ("Rule of Rose", "US", "complete", 1000.0, "USD")],
                                 "title STRING, region STRING, condition STRING, price DOUBLE, currency STRING")
    valued = va.value_collection(held, latest, refs)
    got = {(r.title, r.region): (r.value, r.currency, r.priced_by) for r in valued.collect()}
    assert got == {("God Hand", "US"): (130.0, "USD", "market"), ("God Hand", "PAL"): (60.0, "GBP", "market"),
                   ("Kuon", "US"): (None, "USD", "none"), ("Rule of Rose", "US"): (1160.0, "USD", "article")}
    totals = {r.currency: (r.worth, r.paid, r.copies, r.unpriced) for r in va.collection_totals(valued).collect()}
    assert totals == {"USD": (130 * 3 + 1160.0, 270.0, 5, 1), "GBP": (60.0, 0.0, 1, 0)}


def test_portfolio(spark):
    held = spark.createDataFrame([("God Hand", "UK", "GBP", 1), ("God Hand", "US", "USD", 1), ("Okami", "UK", "GBP", 2), ("Nothing", "UK", "GBP", 1)],
                                 "title STRING, site STRING, currency STRING, qty INT")
    series = spark.createDataFrame(
        [("God Hand", "UK", d, m) for d, m in ((0, 100.0), (1, 110.0), (2, 120.0))] + [("God Hand", "US", d, 200.0) for d in range(3)]
        + [("Okami", "UK", 1, 30.0), ("Okami", "UK", 2, 30.0)], "title STRING, site STRING, period INT, median DOUBLE")
    fx = spark.createDataFrame([("USD", 1.25), ("GBP", 0.8)], "currency STRING, per_eur DOUBLE")
    line = va.portfolio(held, series, fx, "GBP").orderBy("period").collect()
    assert [round(r.value, 2) for r in line] == [288.0, 298.0, 308.0]
    none = va.portfolio(held, series, fx.where("currency <> 'USD'"), "GBP").collect()
    assert {r.value for r in none} == {None}


def test_orders(spark):
    latest = spark.createDataFrame([
        ("Cheap UK", "UK", 9, 5.0, None), ("Cheap UK", "US", 9, 500.0, None), ("Dear UK", "UK", 9, 80.0, None), ("Also Dear", "UK", 9, 80.0, None),
        ("Dollars", "US", 9, 200.0, None), ("Few Dollars", "US", 9, 10.0, None)], "title STRING, site STRING, copies INT, median DOUBLE, unmatched BOOLEAN")
    titles = spark.createDataFrame([("Unpriced", 0), ("Cheap UK", 1), ("Few Dollars", 2), ("Dear UK", 3), ("Dollars", 4), ("Also Dear", 5)], "title STRING, position INT")
    assert [r.title for r in va.by_price(titles, latest).collect()] == ["Dear UK", "Also Dear", "Cheap UK", "Dollars", "Few Dollars", "Unpriced"]


def test_rarity(spark):
    rows = [("Punisher", "US", 18, None), ("Punisher", "UK", 21, None), ("GTA", "US", 400, None), ("GTA", "UK", 300, None), ("Black", "US", 150, 150),
            ("Kuon", "UK", 4, None), ("Persia", "UK", 27, 170), ("Spyro", "UK", 1, 34)]
    latest = spark.createDataFrame([(t, s, c, n, False) for t, s, c, n in rows], "title STRING, site STRING, copies INT, listed INT, unmatched BOOLEAN")
    titles = spark.createDataFrame([(t,) for t in ("GTA", "Black", "Not Priced", "Punisher", "Persia", "Kuon", "Spyro")], "title STRING")
    plain = va.by_rarity(titles, latest, titles.where("false"))
    assert [r.title for r in plain.collect()] == ["Kuon", "Punisher", "Spyro", "Black", "Persia", "GTA", "Not Priced"]
    told = va.by_rarity(titles, latest, titles.where("title IN ('Punisher', 'Not Priced')"))
    assert [r.title for r in told.collect()] == ["Kuon", "Not Priced", "Punisher", "Spyro", "Black", "Persia", "GTA"]


def test_shared_prices(spark):
    latest = spark.createDataFrame([("Yakuza", "UK", 23, 39.99)], "title STRING, site STRING, copies INT, median DOUBLE")
    groups = spark.createDataFrame([("Yazuka", "Yakuza"), ("Yazuka 2", "Yakuza 2")], "title STRING, shown STRING")
    got = {r.title: (r.median, r.shared) for r in va.share_prices(latest, groups).collect()}
    assert got == {"Yakuza": (39.99, False), "Yazuka": (39.99, True)}


@pytest.mark.parametrize("rates, n", [({"USD": "1.1", "GBP": "0.9", "PLN": "4.2", "CHF": "0.95"}, 4), ({"USD": "x", "GBP": "0.9", "PLN": "4.2", "CHF": "0.95"}, 0),
                                      ({"USD": "1.1", "GBP": "0.9", "PLN": "4.2"}, 0), ({"USD": "1.1", "GBP": "0.001", "PLN": "4.2", "CHF": "1"}, 0)])
def test_rates_file(spark, rates, n):
    frame = spark.createDataFrame([("2026-10-16", c, r) for c, r in rates.items()], "date STRING, currency STRING, per_eur STRING")
    assert va.good_rates(frame).count() == n
