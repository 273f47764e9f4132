"""How closely a title is watched: its level, the recheck queue and the budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titletide.operators.medians import top_k
from titletide.config import CHEAP_MEDIAN, CHECK_EVERY_HOURS, DEFAULTS, MAIN_SITES, SITES, Settings
from titletide.functions import text as X
from titletide.sources.adapters import lookup


def levels(mentions: DataFrame, now: Column, state: DataFrame | None = None,
           settings: Settings = DEFAULTS) -> DataFrame:
    """title, level, mentions, held_until. ``mentions``: title, ts, source, headline, matched_in, match_method;
    ``state``: title, held_until, pinned of the titles tracked so far."""
    hours = lambda n: F.expr(f"INTERVAL {n} HOURS")
    window = mentions.where((F.col("ts") > now - F.expr(f"INTERVAL {settings.window_days} DAYS")) & (F.col("ts") <= now))
    named = F.coalesce(F.col("matched_in") != "body", F.lit(True))
    base = window.groupBy("title").agg(
        F.count_if(named).alias("mentions"),
        F.size(F.collect_set(F.when(named, F.col("ts").cast("date")))).alias("days"),
    )
    last_day = window.where(named & (F.col("ts") > now - hours(settings.surge_hours)))
    recent = last_day.groupBy("title").agg(
        F.count(F.lit(1)).alias("recent"),
        F.count_distinct("source").alias("sources"),
        F.count_distinct(F.array_join(X.story_key(F.col("headline")), " ")).alias("stories"),
        F.bool_or(F.coalesce(F.col("match_method") != "fuzzy", F.lit(True))).alias("sure"),
        F.max("ts").alias("newest"),
    )
    rows = base.join(recent, "title", "left")
    if state is None:
        rows = rows.withColumn("old_hold", F.lit(None).cast("timestamp_ntz")).withColumn("pinned", F.lit(False))
    else:
        rows = rows.join(state.select("title", F.col("held_until").alias("old_hold"), "pinned"), "title", "full_outer")
    surge = (
        (F.coalesce("mentions", F.lit(0)) - F.col("recent") <= settings.surge_quiet_mentions)
        & (F.col("sources") >= settings.surge_sources)
        & (F.col("stories") >= settings.surge_sources)
        & F.col("sure")
    )
    hold = F.greatest("old_hold", F.when(surge, F.col("newest") + hours(settings.surge_hold_hours)))
    level = (
        F.when(F.col("days") >= settings.staple_days, "staple")
        .when(hold > now, "surging")
        .when(F.col("days").isNotNull() | F.coalesce("pinned", F.lit(False)), "normal")
        .otherwise("dormant")
    )
    return rows.select("title", level.alias("level"), F.coalesce("mentions", F.lit(0)).alias("mentions"),
                       F.when(level == "surging", hold).alias("held_until"))


def due_lookups(titles: DataFrame, latest: DataFrame, steady: DataFrame, now: Column,
                settings: Settings = DEFAULTS) -> DataFrame:
    """The (title, site) pairs whose turn has come, most urgent first.

    ``titles``: title, level, kind, pinned, watch, latest_mention, sites, sealed_sites. ``latest``: title,
    site, checked, copies, median, unmatched. ``steady``: title, site, steady.
    """
    market = F.explode(F.array(*[
        F.struct(F.lit(s).alias("site"), F.lit(extra).alias("extra"), F.lit(floor * 60).alias("floor"))
        for s, _, _, extra, floor, _ in SITES
    ]))
    pairs = titles.withColumn("m", market).select("*", "m.site", "m.extra", "m.floor").drop("m").where(
        F.col("sites").isNull() | F.array_contains("sites", F.col("site")))
    seen = latest.select("title", "site", "checked", "copies", "median", "unmatched")
    rows = pairs.join(seen, ["title", "site"], "left").join(
        steady.select("title", "site", "steady"), ["title", "site"], "left")

    minutes = lambda h: F.lit(h * 60)
    slow_kind = (F.col("level") == "rare") & F.col("kind").isin("console", "edition")
    every = F.when(slow_kind, minutes(CHECK_EVERY_HOURS["dormant"]))
    for level, h in CHECK_EVERY_HOURS.items():
        every = every.when(F.col("level") == level, minutes(h))
    known, free = F.col("checked").isNotNull(), ~F.col("pinned")
    common = F.col("level").isin("normal", "staple") & free
    is_steady = common & known & F.coalesce("steady", F.lit(False))
    limit = lookup({s: F.lit(v) for s, v in CHEAP_MEDIAN.items()}, F.col("site"))
    cheap = common & (F.col("copies") >= settings.cheap_min_copies) & (F.col("median") > 0) & (F.col("median") < limit)
    slow = F.col("extra") & (F.col("level") == "dormant") & free & known
    quiet = (F.col("extra") & ~F.col("level").isin("surging", "rare") & free & known
             & (F.coalesce("unmatched", F.lit(False)) | (F.col("copies") == 0)))
    # A steady pair waits its own time, never less than the plain interval of its level.
    wait = F.when(F.coalesce(is_steady, F.lit(False)), minutes(settings.steady_every_hours)).otherwise(every)
    wait = F.greatest(wait, F.when(cheap, minutes(settings.steady_every_hours)))
    wait = F.greatest(wait, F.when(slow, minutes(settings.dormant_extra_every_hours)))
    wait = F.greatest(wait, F.when(quiet, minutes(settings.quiet_every_hours)))
    wait = F.greatest(wait, F.col("floor"))
    watched = F.col("watch") & ~F.col("extra") & (F.col("latest_mention") > F.col("checked"))
    wait = F.when(F.coalesce(watched, F.lit(False)), F.least(wait, F.lit(settings.watch_recheck_minutes))).otherwise(wait)
    waited = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("checked").cast("timestamp"))) / 60.0
    sealed = F.coalesce(F.array_contains("sealed_sites", F.col("site")), F.lit(False))

    due = (
        rows.withColumn("every", every)
        .withColumn("wait", wait)
        .withColumn("waited", waited)
        .withColumn("sealed", sealed)
        .where(F.col("sealed") | F.col("waited").isNull() | (F.col("waited") >= F.col("wait") - settings.early_minutes))
        .withColumn("overdue", F.col("waited") / F.greatest("every", F.lit(60)))
        .withColumn("later", lookup({"underrated": F.lit(1), "collection": F.lit(1), "rare": F.lit(2)}, F.col("level"))
                    .otherwise(0))
    )
    return due.orderBy(*due_order()).select("title", "site", "level", "wait", "waited", "overdue", "extra", "sealed",
                                            "pinned", "later")


def sealed_due(held: DataFrame, latest: DataFrame, now: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """title, sealed_sites of the titles that people hold sealed and whose new copies are due on a main site: never asked
    for, or asked a day ago. ``held``: title, kind, level; ``latest``: title, site, new_checked.

    Consoles and editions have no such search, and rare titles always get one and are left alone."""
    fits = ~F.coalesce(F.col("kind").isin("console", "edition"), F.lit(False)) & (F.col("level") != "rare")
    pairs = held.where(fits).select("title").distinct().withColumn("site", F.explode(F.array(*[F.lit(s) for s in MAIN_SITES])))
    minutes = settings.sealed_every_hours * 60 - settings.early_minutes
    asked = F.col("new_checked") > now - F.expr(f"INTERVAL {minutes} MINUTES")
    due = pairs.join(latest.select("title", "site", "new_checked"), ["title", "site"], "left").where(
        ~F.coalesce(asked, F.lit(False)))
    return due.groupBy("title").agg(F.sort_array(F.collect_set("site")).alias("sealed_sites"))


def search_near(near: DataFrame) -> DataFrame:
    """The near misses of each day's searches: grouping ``near`` by kind, ``near_title`` by title and kind, in one pass.
    ``near``: day, title, near, n."""
    grouped = near.groupingSets([["day", "near"], ["day", "title", "near"]], "day", "title", "near").agg(
        F.sum("n").alias("n"), F.grouping_id().alias("g"))
    return grouped.select("day", F.when(F.col("g") == 2, "near").otherwise("near_title").alias("grouping"), "title", "near", "n")


def due_order() -> list[Column]:
    """Main sites first, then sealed copies, surging and pinned titles, then by how long a pair has waited."""
    return [F.col("extra"), ~F.col("sealed"), F.col("level") != "surging", ~F.col("pinned"), F.col("later"),
            F.desc_nulls_first("overdue"), F.lower("title"), F.col("site")]


def within_budget(due: DataFrame, budget: int, order: list[Column], cost: str = "cost") -> DataFrame:
    """The first rows in order whose costs add up to at most the budget. A row costs at least one, so no more
    than ``budget`` rows can qualify and only those are ranked."""
    head = due.orderBy(*order).limit(budget)
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return head.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)


def allowance(used: int, settings: Settings = DEFAULTS) -> int:
    """What one run may spend."""
    return max(0, min(settings.searches_per_run, settings.daily_searches - used))


def search_log(spent: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Long log of searches: grouping ``total``, ``level_site``, ``title`` and ``level_title``, in one pass.
    ``spent``: day, level, site, title, searches. Settings may keep the newest days only, and of titles the costliest
    of each day and level."""
    rows = spent
    if settings.search_log_days is not None:
        days = spent.select("day").distinct().orderBy(F.desc("day")).limit(settings.search_log_days)
        rows = spent.join(days, "day", "left_semi")
    grouped = (
        rows.groupingSets([["day"], ["day", "level", "site"], ["day", "title"], ["day", "level", "title"]],
                          "day", "level", "site", "title")
        .agg(F.sum("searches").alias("searches"), F.grouping_id().alias("g"))
        .withColumn("grouping", F.when(F.col("g") == 7, "total").when(F.col("g") == 1, "level_site")
                    .when(F.col("g") == 6, "title").otherwise("level_title"))
        .select("day", "grouping", "level", "site", "title", "searches")
    )
    for name, keys, k in (("title", ["day"], settings.search_log_titles),
                          ("level_title", ["day", "level"], settings.search_log_level_titles)):
        if k is not None:
            own = F.col("grouping") == name
            best = top_k(grouped.where(own), keys, [F.desc("searches"), F.col("title")], k).select(*grouped.columns)
            grouped = grouped.where(~own).unionByName(best)
    return grouped


def run_verdict(results: DataFrame, latest: DataFrame) -> DataFrame:
    """One row with the reason a price run must be thrown away, or NULL. ``results``: title, site, status, fetched."""
    before = latest.select("title", "site", (F.coalesce("copies", F.lit(0)) > 0).alias("had"))
    rows = results.join(before, ["title", "site"], "left")
    main, failed = F.col("site").isin(*MAIN_SITES), F.col("status") == "error"
    known = ~failed & F.coalesce("had", F.lit(False))
    one = rows.agg(
        F.count(F.lit(1)).alias("lookups"),
        F.count_if(main).alias("main"),
        F.count_if(main & failed).alias("main_failed"),
        F.count_if(failed).alias("failed"),
        F.count_if(known).alias("known"),
        F.count_if(known & (F.col("fetched") > 0)).alias("known_found"),
        F.count_if(~failed).alias("answered"),
        F.count_if(~failed & (F.col("fetched") > 0)).alias("found"),
    ).withColumn("anything_known", F.coalesce(latest.agg(F.bool_or(F.col("copies") > 0)).scalar(), F.lit(False)))
    judged = F.when(F.col("main") > 0, F.col("main")).otherwise(F.col("lookups"))
    errors = F.when(F.col("main") > 0, F.col("main_failed")).otherwise(F.col("failed"))
    reason = (
        F.when(F.col("lookups") == 0, F.lit(None).cast("string"))
        .when(errors == judged, "every lookup failed")
        .when(errors * 2 > judged, "most lookups failed")
        .when((F.col("known") >= 5) & (F.col("known_found") == 0), "known titles return nothing")
        .when(~F.col("anything_known") & (F.col("answered") >= 10) & (F.col("found") == 0), "nothing found at all")
    )
    return one.select("lookups", "main", "main_failed", "known", "answered", reason.alias("reason"))
