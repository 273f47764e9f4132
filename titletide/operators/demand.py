"""The demand index: five scores per title, blended over the ones it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titletide.config import DEFAULTS, Settings
from titletide.functions.numbers import clamp, momentum, round_even
from titletide.operators.medians import top_k
from titletide.operators.mentions import ranked_titles


def trend(views: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """article, trend_pct: the last seven days' readers against the seven before; NULL without two full weeks."""
    n = settings.trend_days
    newest = top_k(views, ["article"], [F.desc("day")], 2 * n)
    sums = newest.groupBy("article").agg(
        F.count(F.lit(1)).alias("days"),
        F.sum(F.when(F.col("rank") <= n, F.col("views"))).alias("recent"),
        F.sum(F.when(F.col("rank") > n, F.col("views"))).alias("previous"),
    )
    pct = (F.col("recent") - F.col("previous")) / F.col("previous") * 100
    ok = (F.col("days") == 2 * n) & (F.col("previous") > 0)
    return sums.select("article", "recent", "previous", F.when(ok, round_even(pct, 1)).alias("trend_pct"))


def usable_articles(titles: DataFrame, checks: DataFrame, resolved: DataFrame, overrides: DataFrame) -> DataFrame:
    """title, article: the override, else a checked article about the game, else the unread resolved one; an
    article serves the first title that uses it. ``titles``: title, mentions."""
    rows = (
        titles.join(overrides.select("title", F.col("article").alias("forced"), F.lit(True).alias("has_forced")),
                    "title", "left")
        .join(checks.select("title", F.col("article").alias("read"), "is_game", "names_platform",
                            F.lit(True).alias("has_read")), "title", "left")
        .join(resolved.select("title", F.col("article").alias("found")), "title", "left")
    )
    good = F.when(F.col("is_game") & F.col("names_platform"), F.col("read"))
    article = (
        F.when(F.col("has_forced"), F.nullif(F.col("forced"), F.lit("")))
        .when(F.col("has_read"), good)
        .otherwise(F.col("found"))
    )
    picked = rows.select("title", "mentions", article.alias("article"))
    owner = picked.where("article IS NOT NULL").groupBy("article").agg(
        F.min(F.struct(-F.col("mentions"), F.col("title"))).alias("o")).select("article", F.col("o.title").alias("title"))
    return picked.select("title").join(owner, "title", "left")


def signal_scores(rows: DataFrame, have_views: Column) -> DataFrame:
    """The five 0-100 scores of each title; NULL where there is nothing to score. The best title is one row of two
    figures, read once for all."""
    best = rows.agg(F.struct(F.max("sources").alias("sources"), F.max("views").alias("views"))).scalar()
    most_sources, most_views = best.getField("sources"), best.getField("views")
    seen = F.when(F.col("most_views") > 0, F.log1p("views") / F.log1p("most_views") * 100).otherwise(0.0)
    return (
        rows.withColumn("most_sources", most_sources)
        .withColumn("most_views", most_views)
        .withColumn("have_views", have_views)
        .withColumn("momentum", round_even(momentum(F.col("recent"), F.col("prior")), 1))
        .withColumn("breadth", F.when(F.col("most_sources") > 0,
                                      round_even(F.col("sources") / F.col("most_sources") * 100, 1)))
        .withColumn("youtube", F.when(F.col("have_views"), round_even(seen, 1)))
        .withColumn("ebay", round_even(clamp(50 + 2.5 * F.col("change_pct")), 1))
        .withColumn("ebay", F.when(F.col("change_pct").isNotNull(), F.col("ebay")))
        .withColumn("wikipedia", F.when(F.col("trend_pct").isNotNull(),
                                        round_even(clamp((F.col("trend_pct") + 50) / 1.5), 1)))
        .drop("most_sources", "most_views", "have_views")
    )


def blend(weights: dict[str, float]) -> Column:
    """The weighted mean of the scores present, to one place; 0 when there is none."""
    total = weight = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.coalesce(F.col(name) * w, F.lit(0.0))
        weight = weight + F.when(F.col(name).isNotNull(), w).otherwise(0.0)
    return F.coalesce(round_even(F.try_divide(total, weight), 1), F.lit(0.0))


def demand_index(stats: DataFrame, change: DataFrame, trends: DataFrame, have_views: Column,
                 settings: Settings = DEFAULTS) -> DataFrame:
    """Titles (the most-mentioned ones where settings limit them) with their scores and demand, best first. ``change``: title, change_pct;
    ``trends``: title, trend_pct."""
    rows = ranked_titles(stats, settings).join(change, "title", "left").join(trends.select("title", "trend_pct"), "title", "left")
    scored = signal_scores(rows, have_views).withColumn("demand", blend(settings.weights))
    return scored.orderBy(F.desc("demand"), F.desc("mentions"), "title")
