"""Money views: conversion, collection value, portfolio over time, price and rarity orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titletide import vocab
from titletide.config import MAIN_SITES

# A title is scarce at ten copies or fewer.
SCARCE = 10


def to_eur(rows: DataFrame, fx: DataFrame) -> DataFrame:
    """Rows with ``eur`` and ``converted``: amount / rate; euros as they are; no rate means unconverted."""
    rates = fx.select("currency", "per_eur")
    euro = F.col("currency") == "EUR"
    return rows.join(rates, "currency", "left").withColumn(
        "eur", F.when(euro, F.col("amount")).when(F.col("per_eur").isNotNull(), F.col("amount") / F.col("per_eur"))
        .otherwise(F.col("amount"))
    ).withColumn("converted", ~euro & F.col("per_eur").isNotNull()).drop("per_eur")


def good_rates(fx: DataFrame) -> DataFrame:
    """Rates of the currencies in use, within believable bounds; a file with a bad or missing one is refused."""
    low, high = vocab.FX_SANE
    wanted = fx.where(F.col("currency").isin(*vocab.FX_CURRENCIES)).withColumn(
        "rate", F.col("per_eur").try_cast("double"))
    days = wanted.groupBy("date").agg(
        F.count_distinct("currency").alias("n"),
        F.bool_and(F.coalesce(F.col("rate").between(low, high), F.lit(False))).alias("sane"))
    ok = days.where((F.col("n") == len(vocab.FX_CURRENCIES)) & F.col("sane") & F.col("date").isNotNull())
    return wanted.join(ok.select("date"), "date", "left_semi").select("date", "currency", F.col("rate").alias("per_eur"))


# The site and currency each region's copies are priced on.
REGION_SITE = {"US": ("US", "USD"), "PAL": ("UK", "GBP")}


def value_collection(collection: DataFrame, latest: DataFrame, references: DataFrame) -> DataFrame:
    """Each entry with value, currency and the source of the value: market, article or none.

    Complete copies take the complete median (else the plain one), loose ones the plain median, sealed ones
    the best reference price of their region.
    """
    site = F.when(F.col("region") == "US", "US").otherwise("UK")
    money = F.when(F.col("region") == "US", "USD").otherwise("GBP")
    prices = latest.where(~F.coalesce("unmatched", F.lit(False))).select(
        "title", "site", F.col("median").alias("plain"), "complete_median")
    best = references.groupBy("title", "region", "condition").agg(
        F.max_by(F.struct("price", "currency"), F.col("price")).alias("best"))
    rows = (
        collection.withColumn("site", site)
        .join(prices, ["title", "site"], "left")
        .join(best, ["title", "region", "condition"], "left")
    )
    market = F.when(F.col("condition") == "complete", F.coalesce("complete_median", "plain")).when(
        F.col("condition") == "loose", F.col("plain"))
    article = F.when(F.col("condition") == "sealed", F.col("best.price"))
    return rows.select(
        *collection.columns,
        F.coalesce(market, article).alias("value"),
        F.when(article.isNotNull(), F.col("best.currency")).otherwise(money).alias("currency"),
        F.when(market.isNotNull(), "market").when(article.isNotNull(), "article").otherwise("none").alias("priced_by"),
    )


def collection_totals(valued: DataFrame) -> DataFrame:
    """Per currency: worth, paid, copies and copies without a price. Money is added up in exact decimals."""
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(18,4)") * F.col("qty")), F.lit(0)).cast("double")
    return valued.groupBy("currency").agg(
        total("value").alias("worth"),
        total("paid").alias("paid"),
        F.sum("qty").alias("copies"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("qty"))), F.lit(0)).alias("unpriced"),
    )


def portfolio(holdings: DataFrame, series: DataFrame, rates: DataFrame, currency: str = "EUR") -> DataFrame:
    """period, value, holdings: what the holdings were worth each observed period, in one currency.

    A holding takes its title's last price on its site, and before its first price that first price. Prices are
    intervals [period, next) summed by difference: no holdings x periods table is ever built. When a currency has
    no rate the whole line is NULL.

    ``holdings``: title, site, currency, qty. ``series``: title, site, period, median.
    """
    held = holdings.groupBy("title", "site", "currency").agg(F.sum("qty").alias("qty"))
    known = rates.select("currency", "per_eur").unionByName(
        rates.sparkSession.range(1).select(F.lit("EUR").alias("currency"), F.lit(1.0).alias("per_eur"))
    ).dropDuplicates(["currency"])
    goal = known.where(F.col("currency") == currency).agg(F.max("per_eur")).scalar()
    priced = held.join(known, "currency", "left").join(series, ["title", "site"])
    w = Window.partitionBy("title", "site", "currency").orderBy("period")
    worth = F.col("median") * F.col("qty") / F.col("per_eur") * goal
    steps = priced.withColumn("worth", worth).select(
        F.when(F.row_number().over(w) == 1, F.lit(None)).otherwise(F.col("period")).alias("from"),
        "period",
        (F.col("worth") - F.coalesce(F.lag("worth").over(w), F.lit(0.0))).alias("step"),
        F.when(F.row_number().over(w) == 1, 1).otherwise(0).alias("entered"),
        F.col("per_eur").isNull().alias("missing"),
    )
    # A first price reaches back to the start of the line.
    days = steps.groupBy("period").agg(
        F.coalesce(F.sum(F.when(F.col("from").isNotNull(), F.col("step"))), F.lit(0.0)).alias("moved"),
        F.coalesce(F.sum(F.when(F.col("from").isNull(), F.col("step"))), F.lit(0.0)).alias("base"),
        F.sum("entered").alias("entered"),
        F.bool_or("missing").alias("missing"),
    )
    line = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(F.lit(1))
    value = F.sum("base").over(whole) + F.sum("moved").over(line)
    return days.select(
        "period",
        F.when(~F.max("missing").over(whole), value).alias("value"),
        F.sum("entered").over(whole).alias("holdings"),
    )


def share_prices(latest: DataFrame, groups: DataFrame) -> DataFrame:
    """title, site, median, shared: a spelling without a figure takes the one of its group's priced spelling.

    ``groups``: title, shown (the spelling its group is shown under)."""
    grouped = groups.select("title", "shown").unionByName(
        groups.select(F.col("shown").alias("title"), "shown")).distinct()
    own = latest.where("median IS NOT NULL")
    by_group = own.join(grouped, "title").groupBy("shown", "site").agg(
        F.max_by("median", F.struct(F.col("title") == F.col("shown"), "copies", "title")).alias("lent"))
    wanted = grouped.join(by_group, "shown").groupBy("title", "site").agg(F.max("lent").alias("lent"))
    both = wanted.join(own.select("title", "site", "median"), ["title", "site"], "full_outer")
    return both.select("title", "site", F.coalesce("median", "lent").alias("median"),
                       (F.col("median").isNull()).alias("shared"))


def compare_reference(references: DataFrame, values: DataFrame) -> DataFrame:
    """title, condition, price, value, gap (reference / own value - 1), widest gap first."""
    return (
        references.join(values.where("value > 0"), ["title", "condition"])
        .select("title", "condition", "price", "value", (F.col("price") / F.col("value") - 1).alias("gap"))
        .orderBy(F.desc(F.abs("gap")))
    )


def by_price(titles: DataFrame, latest: DataFrame) -> DataFrame:
    """title, class, price, position: dearest first by the UK median, then by the US one, then the unpriced.
    ``titles``: title, position (the order that ties keep)."""
    prices = latest.where(F.col("site").isin(*MAIN_SITES) & ~F.coalesce("unmatched", F.lit(False))).groupBy("title").agg(
        F.max(F.when(F.col("site") == "UK", F.col("median"))).alias("uk"),
        F.max(F.when(F.col("site") == "US", F.col("median"))).alias("us"))
    group = F.when(F.col("uk").isNotNull(), 1).when(F.col("us").isNotNull(), 2).otherwise(3)
    return (
        titles.join(prices, "title", "left")
        .select("title", group.alias("price_class"), F.coalesce("uk", "us").alias("price"), "position")
        .orderBy("price_class", F.desc_nulls_last("price"), "position")
    )


def supply(latest: DataFrame) -> DataFrame:
    """title, supply, scarce: copies for sale on the main site with fewest, by the site's own count when it is
    higher; scarce only when that count agrees."""
    rows = latest.where(F.col("site").isin(*MAIN_SITES) & ~F.coalesce("unmatched", F.lit(False)) & F.col("copies").isNotNull())
    own = F.greatest("copies", F.coalesce("listed", F.col("copies")))
    backed = (F.col("copies") <= SCARCE) & (F.col("listed") <= SCARCE)
    return rows.groupBy("title").agg(
        F.min(own).alias("supply"), F.bool_or(F.coalesce(backed, F.lit(False))).alias("scarce"))


def by_rarity(titles: DataFrame, latest: DataFrame, evidence: DataFrame) -> DataFrame:
    """title, rarity_class, supply, scarce: fewest copies first; a title whose article calls it collectible leads its
    class, and one with no figure sits in the second class. ``evidence``: title."""
    rows = titles.join(supply(latest), "title", "left").join(
        evidence.select("title", F.lit(True).alias("collectible")), "title", "left")
    told = F.coalesce("collectible", F.lit(False))
    group = (
        F.when(F.col("supply") <= SCARCE, 1)
        .when(F.col("supply") <= 50, 2)
        .when(F.col("supply").isNull() & told, 2)
        .when(F.col("supply").isNotNull(), 3)
        .otherwise(4)
    )
    return (
        rows.select("title", group.alias("rarity_class"), told.alias("collectible"), "supply",
                    F.coalesce("scarce", F.lit(False)).alias("scarce"))
        .orderBy("rarity_class", F.desc("collectible"), F.asc_nulls_first("supply"), "title")
    )
