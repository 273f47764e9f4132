"""Named price queries over the warehouse tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titletide.config import DEFAULTS, Settings
from titletide.operators import price_index as ix
from titletide.operators import prices as pr
from titletide.session import cut_lineage, shared_folder
from titletide.sources import adapters as ad
from titletide.sources import sinks

# Months stand in for days here: sales are spread over years, so a pair has a few copies a month.
MONTHLY_STEADY = Settings(steady_look_days=6, steady_span_days=4, steady_min_rows=3, steady_min_copies=4,
                          steady_price_range=0.6, steady_copies_range=0.9)


def last_period(spark: SparkSession, sf_dir: str, unit: str = "month"):
    """The newest period, still under way. Read from one column of the fact table, not from the figures."""
    stamp = F.max("l_shipdate")
    period = ad.month_number(stamp) if unit == "month" else F.unix_date(stamp.cast("date"))
    return ad.table(spark, sf_dir, "lineitem").agg(period).scalar()


def stored_history(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """The history as the table it would be: for queries that read it more than once."""
    return cut_lineage(ad.history(spark, sf_dir, unit))


def listing_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.history(spark, sf_dir).select("title", "site", "period", F.col("copies").cast("bigint").alias("copies"),
                                            "lowest", "median")


def daily_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = ad.history(spark, sf_dir)
    return ix.daily_medians(h, DEFAULTS.index_min_copies, last_period(spark, sf_dir))


def price_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometric mean of the moves of each site and month, before the chain."""
    h = ad.history(spark, sf_dir)
    days = ix.index_days(ix.with_moves(ix.daily_medians(h, DEFAULTS.index_min_copies)))
    mean = F.round(F.exp(F.try_divide(F.col("log_sum"), F.col("compared"))), 6)
    return days.select("site", "period", "priced", "compared", mean.alias("geo_mean"))


def price_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of every site and of the pooled sites; brand "Brand#13" stands for the never-list."""
    h = ad.history(spark, sf_dir)
    never = ad.table(spark, sf_dir, "part").where("p_brand = 'Brand#13'").select(F.col("p_brand").alias("title"))
    return ix.price_index(h, last_period(spark, sf_dir), never.distinct())


def index_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = ad.history(spark, sf_dir)
    return ix.index_change(ix.price_index(h, last_period(spark, sf_dir)))


def index_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last year of every index line, measured back from its own last point."""
    h = ad.history(spark, sf_dir)
    return ix.in_range(ix.price_index(h, last_period(spark, sf_dir)), ["site"], 12)


def rare_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = stored_history(spark, sf_dir)
    return ix.rare_index(h, ad.rare_members(spark, sf_dir), last_period(spark, sf_dir))


def market_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.market_cap(ad.history(spark, sf_dir), ad.rare_members(spark, sf_dir))


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = ad.history(spark, sf_dir, "day")
    series = ix.daily_series(h, last_period(spark, sf_dir, "day"), DEFAULTS.series_days)
    return series.select("title", "site", "period", "median", F.col("copies").cast("bigint").alias("copies"))


def week_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = stored_history(spark, sf_dir)
    return pr.week_before(pr.latest_of(h), h)


def week_before_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = stored_history(spark, sf_dir, "day")
    return pr.week_before(pr.latest_of(h), h)


def steady_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = ad.history(spark, sf_dir)
    return pr.steady_pairs(h, last_period(spark, sf_dir), MONTHLY_STEADY)


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily figures of every pair, without the repeats of a day."""
    h = ad.history(spark, sf_dir, "day")
    return pr.change_rows(h).select("title", "site", "period", F.col("copies").cast("bigint").alias("copies"), "median")


def latest_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = ad.history(spark, sf_dir)
    return pr.latest_of(h).select("title", "site", "period", F.col("copies").cast("bigint").alias("copies"),
                                  "lowest", "median")


def _checks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Figures of two months ago and of last month as checks: those below three copies count as unmatched, sites with a
    single copy as errors."""
    h = stored_history(spark, sf_dir)
    last = last_period(spark, sf_dir)
    empty = [F.lit(None).cast("bigint").alias("new_copies"), F.lit(None).cast("double").alias("new_median")]
    state = F.when(F.col("copies") == 1, "error").when(F.col("copies") == 2, "unmatched").otherwise("ok")
    columns = ["title", "site", state.alias("status"), F.col("stamp").alias("checked"), "copies", "lowest", "median",
               *empty, F.lit(None).cast("timestamp_ntz").alias("new_checked")]
    old, new = (h.where(F.col("period") == last - back).select(*columns) for back in (2, 1))
    return old.where("status <> 'error'"), new


def _shown(latest: DataFrame) -> DataFrame:
    return latest.select("title", "site", "status", ad.month_number(F.col("checked")).alias("period"),
                         F.col("copies").cast("bigint").alias("copies"), "lowest", "median")


def latest_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of two months ago brought up to date with last month's checks."""
    return _shown(pr.update_latest(*_checks(spark, sf_dir)))


def latest_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the stored table: it is switched to the old state, then to what the checks make of what it holds."""
    old, new = _checks(spark, sf_dir)
    path = f"{shared_folder(spark)}/latest-{uuid.uuid4().hex}"
    sinks.write_latest(old, path)
    sinks.write_latest(pr.update_latest(sinks.read_latest(spark, path, old), new), path)
    return _shown(sinks.read_latest(spark, path, old))


def market_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = stored_history(spark, sf_dir)
    latest = pr.latest_of(h)
    week = pr.week_before(latest, h).select("title", "site", "week_median")
    return pr.market_change(latest.join(week, ["title", "site"]))


QUERIES = {
    "listing_history": listing_history,
    "daily_medians": daily_medians,
    "price_moves": price_moves,
    "price_index": price_index,
    "index_change": index_change,
    "index_range": index_range,
    "rare_index": rare_index,
    "market_cap": market_cap,
    "daily_series": daily_series,
    "week_before": week_before,
    "week_before_daily": week_before_daily,
    "steady_pairs": steady_pairs,
    "change_log": change_log,
    "latest_prices": latest_prices,
    "latest_update": latest_update,
    "latest_table": latest_table,
    "market_change": market_change,
}
