"""Crowd figures: medians of reported prices and counts of owned copies, published only for enough accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titletide import vocab
from titletide.config import DEFAULTS, Settings
from titletide.functions.numbers import month_index, pennies
from titletide.operators.medians import middle_of_counts, penny_counts
from titletide.session import cut_lineage

GROUP = ["game", "region", "condition", "currency"]


def good_game(c: Column) -> Column:
    return c.rlike("^[a-z0-9]+(?: [a-z0-9]+)*$") & F.length(c).between(2, 100)


def validate_reports(reports: DataFrame, now_month: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """Reports with ``price`` rounded to the penny and ``problem`` (NULL when the report is accepted)."""
    month = month_index(F.col("month"))
    price = pennies(F.col("price")) / 100.0
    problem = (
        F.when(~F.coalesce(good_game(F.col("game")), F.lit(False)), "game")
        .when(month.isNull() | (month > now_month) | (month < now_month - settings.months_back), "month")
        .when(price.isNull() | (price <= 0) | (price > settings.max_price), "price")
        .when(~F.coalesce(F.col("region").isin(*vocab.REGIONS), F.lit(False)), "region")
        .when(~F.coalesce(F.col("condition").isin(*vocab.CONDITIONS), F.lit(False)), "condition")
        .when(~F.coalesce(F.col("currency").isin(*vocab.CURRENCIES), F.lit(False)), "currency")
    )
    return reports.withColumn("price", price).withColumn("problem", problem)


def validate_copies(copies: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Owned counts with ``problem`` (NULL when accepted)."""
    whole = lambda c: F.coalesce(F.col(c).between(0, settings.max_copies), F.lit(False))
    problem = F.when(~F.coalesce(good_game(F.col("game")), F.lit(False)), "game").when(
        ~(whole("sealed") & whole("complete") & whole("loose")), "count")
    return copies.withColumn("problem", problem)


def account_medians(reports: DataFrame) -> DataFrame:
    """The group, account and ``half``, the account's exact median report in half pennies. Equal reports are counted
    together first, so an account is as many rows as it named different prices."""
    keys = [*GROUP, "account"]
    counted = penny_counts(reports, keys, F.col("price"))
    return middle_of_counts(counted, keys).select(*keys, F.col("twice").alias("half"))


def crowd_prices(reports: DataFrame, settings: Settings = DEFAULTS, published: bool = True) -> DataFrame:
    """game, region, condition, currency, published, reporters, held, median, low, high.

    An account counts once, with the median of its reports. The medians over accounts are exact and
    found from counts, so a title that everybody reports is never gathered in one task.
    """
    values = account_medians(reports)
    # Read three times below and far smaller than the reports, so it is written once.
    counts = cut_lineage(values.groupBy(*GROUP, F.col("half").alias("penny")).agg(F.count(F.lit(1)).alias("n")))
    middles = middle_of_counts(counts, GROUP).where(F.col("copies") >= settings.min_reporters)
    inside = (F.col("penny") * 2 * settings.crowd_band >= F.col("twice")) & (
        F.col("penny") * 2 <= F.col("twice") * settings.crowd_band)
    judged = counts.join(middles, GROUP).withColumn("kept", inside)
    held = judged.groupBy(*GROUP).agg(
        F.first("copies").alias("accounts"), F.sum(F.when(F.col("kept"), F.col("n")).otherwise(0)).alias("reporters"))
    final = middle_of_counts(judged.where("kept").select(*GROUP, "penny", "n"), GROUP)
    rows = held.join(final.drop("copies"), GROUP, "left").withColumn(
        "published", F.col("reporters") >= settings.min_reporters)
    show = lambda c: F.when(F.col("published"), c)
    out = rows.select(
        *GROUP, "published", "reporters", (F.col("accounts") - F.col("reporters")).alias("held"),
        # Four units a penny: half a penny up.
        show(F.floor((F.col("twice") + 2) / 4) / 100.0).alias("median"),
        show(F.col("low") / 200.0).alias("low"),
        show(F.col("high") / 200.0).alias("high"),
    )
    return out.where("published") if published else out


def crowd_owners(copies: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """game, owners, sealed, complete, loose where enough accounts own a copy. One row an account and game."""
    return (
        copies.where("sealed + complete + loose > 0")
        .groupBy("game")
        .agg(F.count(F.lit(1)).alias("owners"), F.sum("sealed").alias("sealed"),
             F.sum("complete").alias("complete"), F.sum("loose").alias("loose"))
        .where(F.col("owners") >= settings.min_reporters)
    )


def wanted(copies: DataFrame, sealed: bool = False, at_least: int = 1, settings: Settings = DEFAULTS) -> DataFrame:
    """game, accounts: what people own (or own sealed), most owned first; all of it unless settings limit the list."""
    held = copies.where("sealed > 0" if sealed else "sealed + complete + loose > 0")
    counts = (
        held.groupBy("game")
        .agg(F.count_distinct("account").alias("accounts"))
        .where(F.col("accounts") >= at_least)
        .orderBy(F.desc("accounts"), "game")
    )
    return counts if settings.wanted_limit is None else counts.limit(settings.wanted_limit)
