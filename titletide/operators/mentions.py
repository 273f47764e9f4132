"""Mentions: which titles items name, counted, ranked and filtered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titletide import vocab
from titletide.config import DEFAULTS, Settings
from titletide.functions import text as X
from titletide.operators.medians import top_k


def within(c: Column, now: Column, past: str, grace: str = "1 HOUR") -> Column:
    """From ``past`` before now to a little after it, for sources whose clocks run ahead."""
    return c.between(now - F.expr(f"INTERVAL {past}"), now + F.expr(f"INTERVAL {grace}"))


def named_titles(items: DataFrame) -> Column:
    single = F.col("matched_game") if "matched_game" in items.columns else F.lit(None).cast("string")
    return X.titles_of(F.col("matched_games"), single)


def mentions(items: DataFrame) -> DataFrame:
    """One row per item and title it names."""
    return items.withColumn("title", F.explode(named_titles(items)))


def ever_named(snapshot: DataFrame, archive: DataFrame) -> DataFrame:
    """key, title of everything ever named: snapshot mentions, and archived ones that are only a name."""
    both = mentions(snapshot).select("title").unionByName(archive.select(F.col("g").alias("title")))
    return (
        both.withColumn("key", X.key_of(F.col("title")))
        .where("key <> ''")
        .groupBy("key")
        .agg(F.min("title").alias("title"))
    )


def mention_stats(items: DataFrame, now: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """Per title over the demand window: mentions, recent, prior, last_day, sources, views and videos."""
    days = settings.recent_days + settings.baseline_days
    recent = F.col("ts") >= now - F.expr(f"INTERVAL {settings.recent_days} DAYS")
    counted = (F.col("source_type") == "youtube") & (F.col("views") >= 0)
    rows = mentions(items.where(within(F.col("ts"), now, f"{days} DAYS")))
    return rows.groupBy("title").agg(
        F.count(F.lit(1)).alias("mentions"),
        F.count_if(recent).alias("recent"),
        F.count_if(~recent).alias("prior"),
        F.count_if(F.col("ts") >= now - F.expr("INTERVAL 1 DAY")).alias("last_day"),
        F.count_distinct(F.coalesce("feed", "source", F.lit("?"))).alias("sources"),
        F.coalesce(F.sum(F.when(counted, F.col("views"))), F.lit(0)).alias("views"),
        F.count_if(F.coalesce(counted, F.lit(False))).alias("videos"),
    )


def top_titles(items: DataFrame) -> DataFrame:
    """title, mentions, rank over the whole snapshot; equal counts share a rank. The rank comes from a
    histogram of counts, so no task sees every title."""
    counts = mentions(items).groupBy("title").agg(F.count(F.lit(1)).alias("mentions"))
    return competition_rank(counts, F.col("mentions"))


def competition_rank(df: DataFrame, score: Column) -> DataFrame:
    """``rank`` = 1 + the number of rows with a higher score."""
    from pyspark.sql import Window

    scored = df.withColumn("_score", score)
    histogram = scored.groupBy("_score").agg(F.count(F.lit(1)).alias("_n"))
    above = Window.orderBy(F.desc("_score")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = histogram.select("_score", (F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).alias("rank"))
    return scored.join(ranks, "_score").drop("_score")


def leaderboard(items: DataFrame, now: Column) -> DataFrame:
    """Titles named in the last 24 hours, with an hour's grace: headline and text mentions, sources, remasters,
    newest mention. Headlines lead, then all mentions, then the newest, then the name."""
    rows = mentions(items.where(within(F.col("ts"), now, "24 HOURS")))
    in_text = F.col("matched_in") == "body"
    board = rows.groupBy("title").agg(
        F.count_if(~F.coalesce(in_text, F.lit(False))).alias("headlines"),
        F.count_if(in_text).alias("texts"),
        F.count_distinct("source").alias("sources"),
        F.count_if(F.col("is_remaster_rumor")).alias("remasters"),
        F.max("ts").alias("latest"),
    )
    return board.orderBy(F.desc("headlines"), F.desc(F.col("headlines") + F.col("texts")), F.desc("latest"), "title")


def leaderboard_sources(items: DataFrame, now: Column) -> DataFrame:
    """title, position, source: the sources behind each leaderboard title, newest first."""
    from pyspark.sql import Window

    rows = mentions(items.where(within(F.col("ts"), now, "24 HOURS")))
    newest = rows.groupBy("title", "source").agg(F.max("ts").alias("latest"))
    w = Window.partitionBy("title").orderBy(F.desc("latest"), "source")
    return newest.select("title", F.row_number().over(w).alias("position"), "source")


def filter_items(items: DataFrame, view: str = "all", source_types: list[str] | None = None,
                 search: str | None = None, enabled: DataFrame | None = None, title: str | None = None) -> DataFrame:
    """The feed table's filters: all / matched / remaster / digital, by type, text, enabled source, exact title."""
    named = named_titles(items)
    rules = {
        "all": F.lit(True),
        "matched": F.size(named) > 0,
        "remaster": F.col("is_remaster_rumor"),
        "digital": F.col("is_digital_only"),
    }
    rows = items.where(rules[view])
    if source_types:
        rows = rows.where(F.col("source_type").isin(*source_types))
    if search:
        needle = F.lower(F.lit(search))
        hit = F.contains(F.lower("headline"), needle) | F.contains(F.lower("source"), needle)
        rows = rows.where(hit | F.exists(named, lambda t: F.contains(F.lower(t), needle)))
    if title:
        rows = rows.where(F.array_contains(named, title))
    if enabled is not None:
        rows = rows.join(enabled.select("feed").distinct(), "feed", "left_semi")
    return rows


def newest_per_feed(entries: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Entries with a title; with limits, the first ones of core feeds in their own order and the newest ones of the
    others, with their rank."""
    entries = entries.where(F.trim("title") != "")
    limits = (settings.entries_per_feed, settings.entries_per_reddit_feed)
    if None in limits:
        return entries
    core = F.col("source_type").isin(*vocab.CORE_TYPES)
    newest = F.when(~core, F.coalesce("published", "updated"))
    limit = F.when(F.col("source_type") == "reddit", limits[1]).otherwise(limits[0])
    kept = top_k(entries, ["feed"], [F.desc_nulls_last(newest), F.col("position")], max(limits))
    return kept.where(F.col("rank") <= limit)


def newest_by_source(items: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """feed, latest: the newest dated entry of each source; it only ever moves forward."""
    newest = items.where("ts IS NOT NULL AND feed IS NOT NULL").groupBy("feed").agg(F.max("ts").alias("latest"))
    if previous is None:
        return newest
    both = newest.unionByName(previous.select("feed", "latest"))
    return both.groupBy("feed").agg(F.max("latest").alias("latest"))


def status_badge(ok: Column, latest: Column, now: Column) -> Column:
    """The state of a source from its last fetch and its newest item."""
    age = F.datediff(now.cast("date"), latest.cast("date"))
    return (
        F.when(ok.isNull(), "Not checked yet")
        .when(~ok, "Failing")
        .when(latest.isNull(), "OK · no dated items")
        .when(age <= 14, "Active")
        .when(age <= 120, "Quiet")
        .otherwise("Stale")
    )


def arrival_rate(items: DataFrame) -> DataFrame:
    """Per feed: entries, the hours they reach back, entries an hour (over at least a minute)."""
    seconds = F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp"))
    return (
        items.groupBy("feed")
        .agg(F.count(F.lit(1)).alias("entries"), (seconds / 3600.0).alias("hours"))
        .withColumn("per_hour", F.col("entries") / F.greatest("hours", F.lit(1 / 60)))
    )


def shared_links(entries: DataFrame) -> DataFrame:
    """feed, link of every link that several entries of one feed have in common."""
    return (
        entries.where("link IS NOT NULL AND link <> ''")
        .groupBy("feed", "link")
        .agg(F.count(F.lit(1)).alias("entries"))
        .where("entries > 1")
    )


def first_seen(items: DataFrame, state: DataFrame) -> DataFrame:
    """Undated items get the time they were first seen, so that they do not look new in every run."""
    known = state.groupBy("key").agg(F.min("seen").alias("seen"))
    keyed = items.withColumn("key", X.item_key(F.col("link"), F.col("source"), F.col("headline")))
    return keyed.join(known, "key", "left").withColumn("ts", F.coalesce("ts", "seen", "fetched")).drop("seen", "key")


def feed_verdict(fetches: DataFrame, items: Column) -> DataFrame:
    """One row: whether the run must be thrown away. ``fetches``: source_type, ok."""
    core = F.col("source_type").isin(*vocab.CORE_TYPES)
    one = fetches.agg(F.count_if(core).alias("core_feeds"), F.count_if(core & ~F.col("ok")).alias("core_failures"))
    failed = (F.col("core_feeds") > 0) & ((F.col("items") == 0)
                                          | (F.col("core_failures") > F.expr("core_feeds div 2")))
    return one.withColumn("items", items).withColumn("abort", failed)


def ranked_titles(stats: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The most-mentioned titles, or all of them without a limit."""
    if settings.demand_titles is None:
        return stats
    return stats.orderBy(F.desc("mentions"), "title").limit(settings.demand_titles)


def check_order(stats: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """title, step, of the order articles are read in: named in the last day, then the ranked ones, then the rest."""
    ranked = ranked_titles(stats, settings).select("title", F.lit(True).alias("ranked"))
    step = F.when(F.col("last_day") > 0, 1).when(F.col("ranked"), 2).otherwise(3)
    return stats.join(ranked, "title", "left").select(
        "title", step.alias("step"), F.when(F.col("last_day") > 0, F.col("last_day")).otherwise(
            F.col("mentions")).alias("weight"))


def near_miss_counts(rejected: DataFrame) -> DataFrame:
    """reason, title, n of the mentions the strict rules turned away."""
    return rejected.groupBy("reason", "title").agg(F.count(F.lit(1)).alias("n"))
