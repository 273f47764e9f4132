"""Named crowd and valuation queries over the warehouse tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titletide.operators import crowd as cr
from titletide.operators import listings as ls
from titletide.operators import price_index as ix
from titletide.operators import prices as pr
from titletide.operators import valuation as va
from titletide.plans.price_queries import last_period
from titletide.session import stored
from titletide.sources import adapters as ad

# Rates the conversion examples use, in units per euro.
RATES = {"USD": 1.25, "GBP": 0.8}


def rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RATES.items()), "currency STRING, per_eur DOUBLE")


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cr.validate_reports(ad.reports(spark, sf_dir), last_period(spark, sf_dir))


def report_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _checked(spark, sf_dir)
    return rows.groupBy("region", "condition", "currency", "problem").agg(F.count(F.lit(1)).alias("n"))


def crowd_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q13 over every report."""
    return cr.crowd_prices(ad.reports(spark, sf_dir), published=False)


def recent_crowd_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q13 over the accepted reports only."""
    return cr.crowd_prices(_checked(spark, sf_dir).where("problem IS NULL"))


def crowd_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = cr.validate_copies(ad.owned(spark, sf_dir)).where("problem IS NULL")
    return cr.crowd_owners(checked)


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cr.wanted(ad.owned(spark, sf_dir))


def wanted_sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cr.wanted(ad.owned(spark, sf_dir), sealed=True, at_least=2)


def euro_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every monthly median in euros."""
    h = ad.history(spark, sf_dir)
    rows = h.select("title", "site", "period", ad.lookup(ad.CURRENCY_OF_SITE, F.col("site")).alias("currency"),
                    F.col("median").alias("amount"))
    return va.to_eur(rows, rates(spark)).withColumn("eur", F.round("eur", 6))


def _collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's owned copies as entries of a collection, with what was paid on average."""
    rows = ad.reports(spark, sf_dir)
    return rows.groupBy("account", F.col("game").alias("title"), "region", "condition").agg(
        F.count(F.lit(1)).alias("qty"), (F.min(F.floor(F.col("price") * 100 + 0.5)) / 100.0).alias("paid"))


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest monthly figures under the collection's names; a lone copy counts as unmatched."""
    latest = pr.latest_of(ad.history(spark, sf_dir))
    return latest.select(
        F.lower(F.replace("title", F.lit("#"), F.lit(" "))).alias("title"), "site", "copies", "median",
        (F.col("median") * 1.5).alias("complete_median"), (F.col("copies") == 1).alias("unmatched"),
        (F.col("copies") + 3).alias("listed"))


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest sold line of each brand, region and month as an article's price for a sealed copy."""
    rows = ad.reports(spark, sf_dir).where("condition = 'sealed' AND currency IN ('USD', 'GBP')")
    return rows.groupBy(F.col("game").alias("title"), "region", "condition", "currency", "month").agg(
        (F.max(F.floor(F.col("price") * 100 + 0.5)) / 100.0).alias("price"))


def collection_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    valued = va.value_collection(_collection(spark, sf_dir), _figures(spark, sf_dir), _references(spark, sf_dir))
    return valued.withColumn("value", F.round("value", 4))


def collection_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    valued = va.value_collection(_collection(spark, sf_dir), _figures(spark, sf_dir), _references(spark, sf_dir))
    return va.collection_totals(valued)


def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worth of everything customers own, month by month, in pounds."""
    held = _collection(spark, sf_dir).select(
        "title", F.when(F.col("region") == "US", "US").otherwise("UK").alias("site"),
        F.when(F.col("region") == "US", "USD").otherwise("GBP").alias("currency"), "qty")
    h = ad.history(spark, sf_dir).select(
        F.lower(F.replace("title", F.lit("#"), F.lit(" "))).alias("title"), "site", "period", "median")
    line = va.portfolio(held, h, rates(spark), "GBP")
    return line.select("period", F.round("value", 2).alias("value"), "holdings")


def reference_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _figures(spark, sf_dir).where("site = 'UK'").select(
        "title", F.lit("sealed").alias("condition"), F.col("median").alias("value"))
    references = _references(spark, sf_dir).where("region = 'PAL'")
    gaps = va.compare_reference(references, values)
    return gaps.select("title", "condition", "price", "value", F.round("gap", 6).alias("gap"))


def price_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands by their latest prices; prices of lone copies do not count."""
    titles = ad.table(spark, sf_dir, "part").groupBy(
        F.lower(F.replace("p_brand", F.lit("#"), F.lit(" "))).alias("title")).agg(F.min("p_partkey").alias("position"))
    return va.by_price(titles, _figures(spark, sf_dir)).withColumn("price_class", F.col("price_class").cast("bigint"))


def rarity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands by copies for sale; those with an economy part of size one count as collectible."""
    parts = ad.table(spark, sf_dir, "part").withColumn("title", F.lower(F.replace("p_brand", F.lit("#"), F.lit(" "))))
    evidence = parts.where("p_type = 'ECONOMY' AND p_size = 1").select("title").distinct()
    order = va.by_rarity(parts.select("title").distinct(), _figures(spark, sf_dir), evidence)
    return order.select("title", F.col("rarity_class").cast("bigint").alias("rarity_class"), "collectible",
                        F.col("supply").cast("bigint").alias("supply"), "scarce")


def shared_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands of one type and size as spellings of one title, shown under the first of them."""
    parts = ad.table(spark, sf_dir, "part")
    shown = parts.groupBy("p_type", "p_size").agg(F.min("p_brand").alias("shown"))
    groups = parts.join(shown, ["p_type", "p_size"]).where("p_size = 1").select(
        F.col("p_brand").alias("title"), "shown").groupBy("title").agg(F.min("shown").alias("shown"))
    latest = stored(pr.latest_of(ad.history(spark, sf_dir)).withColumn(
        "median", F.when(F.col("copies") > 3, F.col("median"))), "latest")
    return va.share_prices(latest, groups.where("title <> shown"))


QUERIES = {
    "report_problems": report_problems,
    "crowd_prices": crowd_prices,
    "recent_crowd_prices": recent_crowd_prices,
    "crowd_owners": crowd_owners,
    "wanted": wanted,
    "wanted_sealed": wanted_sealed,
    "euro_history": euro_history,
    "collection_value": collection_value,
    "collection_totals": collection_totals,
    "portfolio": portfolio,
    "reference_gaps": reference_gaps,
    "price_order": price_order,
    "rarity_order": rarity_order,
    "shared_prices": shared_prices,
}
