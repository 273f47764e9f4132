"""Named listing queries over the warehouse tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titletide.operators import listings as ls
from titletide.operators import levels as lv
from titletide.session import stored
from titletide.sources import adapters as ad


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.with_reasons(ad.listings(spark, sf_dir))


def listing_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing with why it is left out, its price, postage and whether it says it is complete."""
    return _classified(spark, sf_dir).select("item_id", "title", "site", "reason", "price", "postage", "confirmed", "link")


def listing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q7: the figures of every title and site."""
    return ls.summarise(_classified(spark, sf_dir))


def kept_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.numbers_of(ls.summarise(_classified(spark, sf_dir)))


def listing_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.skipped(_classified(spark, sf_dir))


def listing_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.skipped_examples(_classified(spark, sf_dir)).select(
        "title", "site", "reason", F.col("rank").cast("bigint").alias("rank"), "item_id", "example")


def cheapest_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.cheapest_kept(_classified(spark, sf_dir)).select(
        "title", "site", F.col("rank").cast("bigint").alias("rank"), "price", "link")


def two_pass_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of newer stock as the first search, all other ones as the keyword search."""
    rows = stored(_classified(spark, sf_dir).select("title", "site", "reason", "listed"), "classified")
    fresh = F.col("listed") >= F.lit("2001-06-01").cast("timestamp_ntz")
    chosen = ls.two_pass(rows.where(fresh), rows.where(~fresh))
    return chosen.groupBy("title", "site").agg(F.count(F.lit(1)).alias("listings"),
                                               F.count_if(F.col("reason").isNull()).alias("counted"))


def console_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same listings read as hardware: a widget must be large or small, rings are never wanted."""
    rows = ad.listings(spark, sf_dir).withColumn("require", F.array(F.split_part("search", F.lit(" "), F.lit(2))))
    rows = rows.withColumn("require_any", F.when(F.col("title").endswith("widget"), F.array(
        F.lit("large"), F.lit("small"))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("exclude", F.array(F.lit("ring")))
    return ls.console_reasons(rows).groupBy("title", "site", "reason").agg(F.count(F.lit(1)).alias("n"))


def near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often listings nearly named a title that counted nothing on a site, by kind and title, as a day's log."""
    rows = stored(_classified(spark, sf_dir).select("title", "site", "reason", "near"), "classified")
    near = ls.near_misses(rows, rows.groupBy("title", "site").agg(F.count_if(F.col("reason").isNull()).alias("counted")))
    return lv.search_near(near.withColumn("day", F.lit("today")))


QUERIES = {
    "near_misses": near_misses,
    "listing_reasons": listing_reasons,
    "listing_summary": listing_summary,
    "kept_figures": kept_figures,
    "listing_skips": listing_skips,
    "listing_examples": listing_examples,
    "cheapest_listings": cheapest_listings,
    "two_pass_search": two_pass_search,
    "console_listings": console_listings,
}
