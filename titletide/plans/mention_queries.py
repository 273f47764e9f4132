"""Named mention, demand, level, archive and snapshot queries over the warehouse tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titletide.config import DEFAULTS, Settings
from titletide.functions import text as X
from titletide.operators import archive as ar
from titletide.operators import demand as dm
from titletide.operators import levels as lv
from titletide.operators import mentions as mn
from titletide.operators import price_index as ix
from titletide.operators import prices as pr
from titletide.operators import snapshot as sn
from titletide.plans.price_queries import last_period, stored_history
from titletide.session import cut_lineage, shared_folder
from titletide.sources import adapters as ad
from titletide.sources import sinks


def full_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with the fields the snapshot keeps."""
    rows = ad.items(spark, sf_dir)
    named = F.size("matched_games") > 0
    return (
        rows.withColumn("matched_game", F.try_element_at("matched_games", F.lit(1)))
        .withColumn("match_score", F.when(named, 100).otherwise(0))
        .withColumn("sentiment", X.tone(F.col("headline")))
        .withColumn("hype", X.hype(F.col("headline")))
    )


def mention_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mn.mention_stats(ad.items(spark, sf_dir), ad.now(spark, sf_dir))


def top_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mn.top_titles(ad.items(spark, sf_dir))


def last_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mn.leaderboard(ad.items(spark, sf_dir), ad.now(spark, sf_dir))


def last_24h_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mn.leaderboard_sources(ad.items(spark, sf_dir), ad.now(spark, sf_dir)).withColumn(
        "position", F.col("position").cast("bigint"))


def ever_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = ad.now(spark, sf_dir)
    items = ad.items(spark, sf_dir)
    return mn.ever_named(sn.retain(items, clock), ar.archive_rows(full_items(spark, sf_dir)))


def filtered_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that name a title, from news and podcast feeds whose source wrote within the last day, with "7" in them."""
    items, clock = ad.items(spark, sf_dir), ad.now(spark, sf_dir)
    enabled = items.where(F.col("ts") >= clock - F.expr("INTERVAL 1 DAY")).select("feed")
    return mn.filter_items(items, "matched", ["news", "podcast"], "7", enabled).select("event_id", "feed", "headline")


def newest_per_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry with a title."""
    return mn.newest_per_feed(_entries(spark, sf_dir)).select("event_id", "feed")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.items(spark, sf_dir).select(
        "event_id", "feed", "source_type", F.col("headline").alias("title"), F.col("ts").alias("published"),
        F.lit(None).cast("timestamp_ntz").alias("updated"), F.col("event_id").alias("position"))


def newest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: ten entries a feed, twenty of a reddit feed."""
    kept = mn.newest_per_feed(_entries(spark, sf_dir), Settings(entries_per_feed=10, entries_per_reddit_feed=20))
    return kept.select("event_id", "feed", F.col("rank").cast("bigint").alias("rank"))


def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's newest item, whether its last fetch went well, and its badge."""
    items, clock = ad.items(spark, sf_dir), ad.now(spark, sf_dir)
    ok = ad.table(spark, sf_dir, "events").groupBy(
        F.concat(ad.lookup(ad.TYPE_OF_EVENT, F.col("event_type")), F.lit(":"),
                 F.col("user_id").cast("string")).alias("feed")
    ).agg((F.max_by("value", "ts") >= 3).alias("ok"))
    rows = mn.newest_by_source(items).join(ok, "feed").withColumn("clock", clock)
    return rows.select("feed", "latest", "ok", mn.status_badge(F.col("ok"), F.col("latest"), F.col("clock")).alias("badge"))


def arrival_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = mn.arrival_rate(ad.items(spark, sf_dir))
    return rate.select("feed", "entries", F.round("hours", 6).alias("hours"), F.round("per_hour", 6).alias("per_hour"))


def shared_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mn.shared_links(ad.items(spark, sf_dir))


def feed_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetches = source_health(spark, sf_dir).select(F.split_part("feed", F.lit(":"), F.lit(1)).alias("source_type"), "ok")
    return mn.feed_verdict(fetches, ad.table(spark, sf_dir, "events").agg(F.count(F.lit(1))).scalar())


def check_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = mn.check_order(mn.mention_stats(ad.items(spark, sf_dir), ad.now(spark, sf_dir)))
    return order.withColumn("step", F.col("step").cast("bigint"))


def title_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels at the newest event; titles are held surging when their last mention three days ago was fresh."""
    rows, clock = mn.mentions(ad.items(spark, sf_dir)), ad.now(spark, sf_dir)
    return lv.levels(rows, clock)


def quick_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rules where a staple needs fourteen days and four earlier mentions are still quiet, with a held state."""
    rows, clock = mn.mentions(ad.items(spark, sf_dir)), ad.now(spark, sf_dir)
    state = rows.where("source_type = 'podcast'").groupBy("title").agg(
        (F.max("ts") + F.expr("INTERVAL 12 HOURS")).alias("held_until"), F.lit(False).alias("pinned"))
    return lv.levels(rows, clock, state, Settings(staple_days=14, surge_quiet_mentions=30))


def demand_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6: mentions, market change, readers' trend, blended and ranked."""
    items, clock = ad.items(spark, sf_dir), ad.now(spark, sf_dir)
    stats = mn.mention_stats(items, clock)
    h = stored_history(spark, sf_dir)
    latest = pr.latest_of(h)
    week = pr.week_before(latest, h).select("title", "site", "week_median")
    change = pr.market_change(latest.join(week, ["title", "site"])).withColumn(
        "title", F.replace("title", F.lit("Brand#"), F.lit("title ")))
    trends = dm.trend(ad.pageviews(spark, sf_dir)).withColumnRenamed("article", "title")
    have = items.agg(F.bool_or((F.col("source_type") == "youtube") & (F.col("views") >= 0))).scalar()
    return dm.demand_index(stats, change, trends, have).select(
        "title", "mentions", "sources", "views", "change_pct", "trend_pct", "momentum", "breadth", "youtube", "ebay",
        "wikipedia", "demand")


def reader_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dm.trend(ad.pageviews(spark, sf_dir))


def archive_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ar.archive_index(ar.archive_rows(full_items(spark, sf_dir)))
    return index.withColumn("rank", F.col("rank").cast("bigint"))


def archive_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last ten days add to an archive that holds everything before."""
    items, clock = full_items(spark, sf_dir), ad.now(spark, sf_dir)
    recent = F.col("ts") >= clock - F.expr("INTERVAL 10 DAYS")
    added = ar.new_mentions(ar.archive_rows(items), ar.archive_rows(items.where(~recent)))
    return added.select("month", "g", "s", "h", "d", "t")


def digital_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digital archive after a run: stories of the first twenty days stored, the last ten in the snapshot."""
    items, clock = full_items(spark, sf_dir), ad.now(spark, sf_dir)
    recent = F.col("ts") >= clock - F.expr("INTERVAL 10 DAYS")
    stored = ar.first_stories(ar.digital_rows(items.where(~recent)))
    return ar.merge_digital(items.where(recent), stored).select("month", "s", "h", "d", "t", "l")


def digital_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sink holds after two runs: one with all flags, one in which only the last ten days are still flagged, so
    that whole months lose their stories."""
    items, clock = full_items(spark, sf_dir), ad.now(spark, sf_dir)
    path = f"{shared_folder(spark)}/digital-{uuid.uuid4().hex}"
    recent = F.col("ts") >= clock - F.expr("INTERVAL 10 DAYS")
    sinks.write_digital(items, path)
    sinks.write_digital(items.withColumn("is_digital_only", F.col("is_digital_only") & recent), path)
    return sinks.stored(spark, path, ar.digital_rows(items)).select("month", "s", "h", "d", "t", "l")


def digital_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ar.digital_index(ar.digital_rows(full_items(spark, sf_dir)))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, clock = sn.with_key(full_items(spark, sf_dir)), ad.now(spark, sf_dir)
    recent = F.col("ts") >= clock - F.expr("INTERVAL 3 DAYS")
    old, new = rows.where(~recent), rows.where(recent)
    return sn.retain(sn.upsert(old, sn.respect_owner(old, new)), clock)


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3: owner rule, upsert, retention and clean-up, with every row."""
    return sn.reclean(sn.priority_trim(_merged(spark, sf_dir))).select(
        "key", "event_id", "feed", "ts", "matched_game", F.col("match_method"))


def trimmed_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1, where a caller asks for a ceiling: 500 rows, raised in steps of 100 to 900, rows that name a title first."""
    trimmed = sn.priority_trim(cut_lineage(_merged(spark, sf_dir)), Settings(row_ceiling=500, ceiling_step=100, ceiling_max=900))
    return sn.reclean(trimmed).select("key", "event_id", "feed", "ts", "matched_game", F.col("match_method"))


def thin_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sn.thin_snapshot(_merged(spark, sf_dir))[1]


def thin_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sn.thin_snapshot(_merged(spark, sf_dir))[0].select("key", "event_id")


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last three days changed in the snapshot, by key and first field."""
    rows, clock = sn.with_key(full_items(spark, sf_dir)), ad.now(spark, sf_dir)
    recent = F.col("ts") >= clock - F.expr("INTERVAL 3 DAYS")
    fields = ["key", "headline", "source", "views"]
    before = sn.upsert(rows.where(~recent), rows.where(~recent)).select(*fields)
    return sn.diff_snapshots(before, _merged(spark, sf_dir).select(*fields), ["key"], ["views"])


def snapshot_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, clock = sn.with_key(full_items(spark, sf_dir)), ad.now(spark, sf_dir)
    columns = ["key", "headline", "source"]
    before = sn.upsert(rows, rows).select(*columns)
    return sn.changed(before, sn.retain(sn.upsert(rows, rows), clock).select(*columns))


def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lv.search_log(ad.searches_spent(spark, sf_dir))


def run_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, last = stored_history(spark, sf_dir), last_period(spark, sf_dir)
    results = h.where(F.col("period") == last - 1).select(
        "title", "site", F.when(F.col("copies") == 1, "error").otherwise("ok").alias("status"),
        F.col("copies").alias("fetched"))
    return lv.run_verdict(results, h.where(F.col("period") == last - 2))


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forum items taken as undated: the first sight of the same link on an earlier day dates them."""
    rows = ad.items(spark, sf_dir)
    state = rows.select(X.item_key(F.col("link"), F.col("source"), F.col("headline")).alias("key"),
                        F.col("ts").alias("seen"))
    undated = rows.where("source_type = 'forum'").withColumn("fetched", F.col("ts")).withColumn(
        "ts", F.lit(None).cast("timestamp_ntz"))
    return mn.first_seen(undated, state).select("event_id", "ts")


def _lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by level, their last monthly figures, and the pairs due at the end of the history."""
    h, last = stored_history(spark, sf_dir), last_period(spark, sf_dir)
    clock = ad.table(spark, sf_dir, "lineitem").agg(F.max("l_shipdate")).scalar()
    size = F.sum("p_size")
    level = (F.when(size % 5 == 0, "surging").when(size % 5 == 1, "staple").when(size % 5 == 2, "normal")
             .when(size % 5 == 3, "dormant").otherwise("rare"))
    titles = ad.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("title")).agg(
        level.alias("level"), (F.min("p_size") == 2).alias("pinned"), (F.max("p_size") >= 50).alias("watch"))
    titles = titles.select(
        "title", "level", F.lit(None).cast("string").alias("kind"), "pinned", "watch",
        clock.alias("latest_mention"), F.lit(None).cast("array<string>").alias("sites"),
        F.when(F.col("level") == "normal", F.array(F.lit("US"))).alias("sealed_sites"))
    newest = ad.priced_lines(spark, sf_dir).groupBy("title", "site").agg(F.max("stamp").alias("checked"))
    latest = pr.latest_of(h).join(newest, ["title", "site"]).withColumn("unmatched", F.col("copies") == 1)
    return lv.due_lookups(titles, latest, pr.steady_pairs(h, last, STEADY), clock.cast("timestamp_ntz"))


STEADY = Settings(steady_look_days=6, steady_span_days=4, steady_min_rows=3, steady_min_copies=2,
                  steady_price_range=3.0, steady_copies_range=3.0)


def sealed_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands whose new copies are due, when their newest line is the last time they were asked for."""
    clock = ad.table(spark, sf_dir, "lineitem").agg(F.max("l_shipdate")).scalar().cast("timestamp_ntz")
    size = F.sum("p_size")
    held = ad.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("title")).agg(
        F.when(size % 7 == 0, "console").alias("kind"), F.when(size % 5 == 4, "rare").otherwise("normal").alias("level"))
    asked = ad.priced_lines(spark, sf_dir).groupBy("title", "site").agg(F.max("stamp").cast("timestamp_ntz").alias("new_checked"))
    return lv.sealed_due(held, asked, clock).select("title", F.array_join("sealed_sites", ",").alias("sites"))


def due_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lookups(spark, sf_dir).select("title", "site", "level", F.col("wait").cast("bigint").alias("wait"), "waited")


def lookup_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The due pairs one run may ask for, at two searches on the sites with sealed copies due."""
    due = _lookups(spark, sf_dir).withColumn("cost", F.when(F.col("sealed"), 2).otherwise(1))
    return lv.within_budget(due, lv.allowance(4900), lv.due_order()).select("title", "site", "spent")


QUERIES = {
    "mention_stats": mention_stats,
    "top_titles": top_titles,
    "last_24h": last_24h,
    "last_24h_sources": last_24h_sources,
    "ever_named": ever_named,
    "filtered_feed": filtered_feed,
    "newest_per_feed": newest_per_feed,
    "newest_entries": newest_entries,
    "source_health": source_health,
    "arrival_rate": arrival_rate,
    "shared_links": shared_links,
    "feed_verdict": feed_verdict,
    "check_order": check_order,
    "title_levels": title_levels,
    "quick_levels": quick_levels,
    "demand_index": demand_index,
    "reader_trend": reader_trend,
    "archive_months": archive_months,
    "archive_new": archive_new,
    "digital_stories": digital_stories,
    "digital_archive": digital_archive,
    "digital_days": digital_days,
    "snapshot": snapshot,
    "trimmed_snapshot": trimmed_snapshot,
    "thin_snapshot": thin_snapshot,
    "thin_rows": thin_rows,
    "snapshot_diff": snapshot_diff,
    "snapshot_changed": snapshot_changed,
    "search_log": search_log,
    "run_verdict": run_verdict,
    "first_seen": first_seen,
    "sealed_due": sealed_due,
    "due_lookups": due_lookups,
    "lookup_budget": lookup_budget,
}
