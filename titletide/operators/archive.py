"""The permanent archive of mentions and of digital-only stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titletide.functions import text as X
from titletide.operators.medians import top_k
from titletide.operators.mentions import mentions
from titletide import vocab

MENTION_KEY = ["g", "w", "k"]


def story_key() -> Column:
    """A digest of the whole source and headline: what tells stories apart. ``s`` and ``h`` are short forms for show."""
    return F.md5(F.concat_ws("\x1f", F.coalesce("source", F.lit("")), X.squash(F.col("headline"))))


def archive_rows(items: DataFrame) -> DataFrame:
    """One archive row per item and title: d, g, h, s, t, n, r, m, month. Board rows carry no tone."""
    dated = mentions(items.where("ts IS NOT NULL"))
    kind = F.coalesce("source_type", F.lit("news"))
    tone = F.when(kind != vocab.BOARD_TYPE, F.coalesce(F.col("sentiment"), F.lit(50)))
    return dated.select(
        F.col("ts").alias("d"),
        F.col("title").alias("g"),
        X.shorten(F.col("headline")).alias("h"),
        F.substring(F.coalesce("source", F.lit("")), 1, 60).alias("s"),
        kind.alias("t"),
        tone.cast("int").alias("n"),
        F.coalesce("is_remaster_rumor", F.lit(False)).alias("r"),
        F.col("match_method").alias("m"),
        story_key().alias("w"),
        F.date_format("ts", "yyyy-MM").alias("month"),
    )


def keyed(rows: DataFrame) -> DataFrame:
    """Board rows read alike, so their start time is part of what tells them apart."""
    return rows.withColumn("k", F.when(F.col("t") == vocab.BOARD_TYPE, F.col("d").cast("string")).otherwise(""))


def new_mentions(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows the archive does not hold yet, each once (the earliest of equals)."""
    fresh = keyed(rows)
    known = keyed(stored).select("month", *MENTION_KEY).distinct()
    unseen = fresh.join(known, ["month", *MENTION_KEY], "left_anti")
    columns = [c for c in rows.columns if c not in ("g", "w", "month")]
    first = F.min_by(F.struct(*columns), F.struct("d", "t")).alias("row")
    return unseen.groupBy("month", *MENTION_KEY).agg(first).select("month", "g", "w", "row.*")


def archive_index(stored: DataFrame, k: int = 5) -> DataFrame:
    """month, mentions, titles, total_mentions and the month's top titles, one row per rank."""
    counts = stored.groupBy("month", "g").agg(F.count(F.lit(1)).alias("n"))
    months = counts.groupBy("month").agg(F.sum("n").alias("mentions"), F.count(F.lit(1)).alias("titles"))
    total = counts.agg(F.sum("n")).scalar()
    top = top_k(counts, ["month"], [F.desc("n"), F.col("g")], k)
    return top.join(months, "month").select(
        "month", "mentions", "titles", total.alias("total_mentions"), "rank", F.col("g").alias("title"), "n")


def digital_rows(items: DataFrame) -> DataFrame:
    """One row per flagged item: d, h, s, t, l, month."""
    link = F.col("link")
    return items.where("is_digital_only AND ts IS NOT NULL").select(
        F.col("ts").alias("d"),
        X.shorten(F.col("headline")).alias("h"),
        F.substring(F.coalesce("source", F.lit("")), 1, 60).alias("s"),
        F.coalesce("source_type", F.lit("news")).alias("t"),
        F.when(link.rlike("^https?://"), link).alias("l"),
        story_key().alias("w"),
        F.date_format("ts", "yyyy-MM").alias("month"),
    )


def merge_digital(snapshot: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored stories without those still in the snapshot but no longer flagged, plus the new ones."""
    cleared = snapshot.where("is_digital_only = false").select(story_key().alias("w"))
    kept = stored.join(cleared.distinct(), "w", "left_anti")
    fresh = digital_rows(snapshot).join(kept.select("month", "w").distinct(), ["month", "w"], "left_anti")
    once = first_stories(fresh)
    return kept.unionByName(once)


def first_stories(rows: DataFrame) -> DataFrame:
    """Digital rows with the earliest of each story."""
    first = F.min_by(F.struct("s", "h", "d", "t", "l"), F.struct("d", "t", "l")).alias("row")
    return rows.groupBy("month", "w").agg(first).select("month", "w", "row.*")


def digital_index(stored: DataFrame) -> DataFrame:
    """grouping (total, month or day), its key, and the stories in it, in one pass."""
    rows = stored.select("month", F.date_format("d", "yyyy-MM-dd").alias("day"))
    grouped = rows.groupingSets([["month"], ["day"], []], "month", "day").agg(
        F.count(F.lit(1)).alias("stories"), F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 1, "month").when(F.col("g") == 2, "day").otherwise("total")
    return grouped.select(name.alias("grouping"), F.coalesce("month", "day", F.lit("all")).alias("key"), "stories")
