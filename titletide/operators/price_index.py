"""Chained price indices, the rare-list index and market cap, and daily series.

``period`` is a whole number of days (or of any other unit the caller chooses); every gap and carry
is counted in that unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titletide.config import DEFAULTS, POOLED_NAME, POOLED_SITES, Settings
from titletide.functions.numbers import move, pennies, round_even

RUNNING = (Window.unboundedPreceding, Window.currentRow)


def good_figure(copies: Column, median: Column, min_copies: int) -> Column:
    """Enough copies and a finite positive median."""
    return (copies >= min_copies) & (median > 0) & ~F.isnan(median) & (median != float("inf"))


def daily_medians(history: DataFrame, min_copies: int, before: Column | None = None,
                  leave_out: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """site, title, period, median: the last good figure of each finished period."""
    rows = history.where(good_figure(F.col("copies"), F.col("median"), min_copies))
    if before is not None:
        rows = rows.where(F.col("period") < before)
    if leave_out is not None:
        rows = rows.join(leave_out, "title", "left_anti")
    if only is not None:
        rows = rows.join(only, "title", "left_semi")
    return rows.groupBy("site", "title", "period").agg(F.max_by("median", "stamp").alias("median"))


def with_moves(daily: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Each figure with the log of its move since the title's previous priced period, when that is near enough."""
    w = Window.partitionBy("site", "title").orderBy("period")
    near = F.col("period") - F.lag("period").over(w) <= settings.index_max_gap
    return daily.withColumn(
        "log_move", F.when(near, move(F.col("median"), F.lag("median").over(w), settings.index_max_move)))


def index_days(moves: DataFrame, pooled: tuple[str, ...] = POOLED_SITES, name: str = POOLED_NAME) -> DataFrame:
    """site, period, priced, compared, log_sum. The pooled site treats every (title, site) as an item of
    its own, so its days are sums of its sites' days and the history is read once."""
    days = moves.groupBy("site", "period").agg(
        F.count(F.lit(1)).alias("priced"),
        F.count("log_move").alias("compared"),
        F.sum("log_move").alias("log_sum"),
    )
    labels = F.when(F.col("site").isin(*pooled), F.array("site", F.lit(name))).otherwise(F.array("site"))
    spread = days.withColumn("label", F.explode(labels)).groupBy("label", "period").agg(
        F.sum("priced").alias("priced"),
        F.sum("compared").alias("compared"),
        F.sum("log_sum").alias("log_sum"),
        F.min("site").alias("a"),
        F.max("site").alias("z"),
    )
    everywhere = Window.partitionBy("label")
    several = F.min("a").over(everywhere) != F.max("z").over(everywhere)
    return (
        spread.withColumn("several", several)
        .where((F.col("label") != name) | F.col("several"))
        .select(F.col("label").alias("site"), "period", "priced", "compared", "log_sum")
    )


def chain(days: DataFrame, min_titles: int) -> DataFrame:
    """site, period, index_value, compared: 100 on the first period with enough titles, then moved by the
    geometric mean of the period's moves whenever enough titles could be compared."""
    site = Window.partitionBy("site")
    enough = F.when(F.col("priced") >= min_titles, F.col("period"))
    started = days.withColumn("start", F.min(enough).over(site)).where(F.col("period") >= F.col("start"))
    first = F.col("period") == F.col("start")
    factor = F.when(~first & (F.col("compared") >= min_titles), F.col("log_sum") / F.col("compared")).otherwise(0.0)
    value = 100.0 * F.exp(F.sum(factor).over(site.orderBy("period").rowsBetween(*RUNNING)))
    return started.select(
        "site",
        "period",
        round_even(value, 2).alias("index_value"),
        F.when(first, F.col("priced")).otherwise(F.col("compared")).alias("compared"),
    )


def price_index(history: DataFrame, before: Column | None = None, leave_out: DataFrame | None = None,
                settings: Settings = DEFAULTS) -> DataFrame:
    """The price index of every site, and of the pooled sites together."""
    daily = daily_medians(history, settings.index_min_copies, before, leave_out)
    return chain(index_days(with_moves(daily, settings)), settings.index_min_titles)


def index_change(index: DataFrame, week: int = 7, settings: Settings = DEFAULTS) -> DataFrame:
    """The last point of each site against the point before it and the last one at least a week older.
    A last period with too few titles kept its value, so it has no change."""
    site = Window.partitionBy("site")
    rows = index.withColumn("last", F.max("period").over(site)).withColumn("first", F.min("period").over(site))
    point = F.struct("period", "index_value")
    older = rows.groupBy("site").agg(
        F.max("last").alias("period"),
        F.max_by("index_value", "period").alias("index_value"),
        F.max_by("compared", "period").alias("compared"),
        F.max(F.when(F.col("period") < F.col("last"), point)).alias("before"),
        F.max(F.when(F.col("period") <= F.col("last") - week, point)).alias("week"),
    )
    moved = F.col("compared") >= settings.index_min_titles
    pct = lambda old: F.when(moved, round_even((F.col("index_value") / old - 1) * 100, 4))
    return older.select(
        "site", "period", "index_value", "compared",
        F.col("before.period").alias("before_period"),
        pct(F.col("before.index_value")).alias("day_change"),
        F.col("week.period").alias("week_period"),
        pct(F.col("week.index_value")).alias("week_change"),
    )


def in_range(series: DataFrame, keys: list[str], length: int | None) -> DataFrame:
    """The points of each series within ``length`` periods of its last point; all when no length is given."""
    if length is None:
        return series
    last = F.max("period").over(Window.partitionBy(*keys))
    return series.withColumn("last", last).where(F.col("period") >= F.col("last") - length).drop("last")


def rare_index(history: DataFrame, members: DataFrame, before: Column | None = None,
               survival: float | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """list, period, index_value, compared, cap, core_cap, live.

    ``members``: list, site, title, copies. The cap starts at the first period's sum of median x copies
    x survival and then moves by the titles live in two observed periods in a row.
    """
    share = settings.cap_survival if survival is None else survival
    listed = members.groupBy("list", "site", "title").agg(F.max("copies").alias("members_copies"))
    size = listed.groupBy("list").agg(F.count(F.lit(1)).alias("members"))
    figures = (
        history.where(good_figure(F.col("copies"), F.col("median"), 1))
        .join(listed, ["site", "title"])
    )
    if before is not None:
        figures = figures.where(F.col("period") < before)
    good = F.col("copies") >= settings.rare_min_copies
    prices = figures.groupBy("list", "title", "period").agg(
        F.max_by("median", "stamp").alias("median"),
        F.max_by(F.when(good, F.col("median")), F.when(good, F.col("stamp"))).alias("thick"),
        F.first("members_copies").alias("held"),
    )

    item = Window.partitionBy("list", "title").orderBy("period")
    thick = Window.partitionBy("list", "title").orderBy("period")
    moved = (
        prices.where(F.col("thick").isNotNull())
        .withColumn("near", F.col("period") - F.lag("period").over(thick) <= settings.index_max_gap)
        .withColumn("log_move", F.when(
            F.col("near"), move(F.col("thick"), F.lag("thick").over(thick), settings.index_max_move)))
        .groupBy("list", "period")
        .agg(F.count(F.lit(1)).alias("priced"), F.count("log_move").alias("compared"),
             F.sum("log_move").alias("log_sum"))
    )
    observed = prices.select("list", "period").distinct()
    timeline = Window.partitionBy("list").orderBy("period")
    ranked = observed.withColumn("rank", F.row_number().over(timeline))

    until = F.least(F.lead("period").over(item) - 1, F.col("period") + settings.cap_carry)
    live = (
        prices.withColumn("until", F.coalesce(until, F.col("period") + settings.cap_carry))
        .withColumn("period", F.explode(F.sequence("period", "until")))
        .join(ranked, ["list", "period"])
    )
    follows = F.lag("rank").over(Window.partitionBy("list", "title").orderBy("rank")) == F.col("rank") - 1
    earlier = F.lag("median").over(Window.partitionBy("list", "title").orderBy("rank"))
    core = F.col("held") < settings.cap_core_below
    both = F.when(F.col("follows") & move(F.col("median"), F.col("earlier"), settings.index_max_move).isNotNull(),
                  F.col("held"))
    now, then = pennies(F.col("median")), pennies(F.col("earlier"))
    sums = (
        live.withColumn("follows", follows)
        .withColumn("earlier", earlier)
        .withColumn("both", both)
        .groupBy("list", "period")
        .agg(
            F.count(F.lit(1)).alias("live"),
            (F.sum(now * F.col("held")) * share / 100).alias("total"),
            (F.sum(F.when(core, now * F.col("held"))) * share / 100).alias("core_total"),
            F.try_divide(F.sum(now * F.col("both")), F.sum(then * F.col("both"))).alias("r"),
            F.try_divide(F.sum(F.when(core, now * F.col("both"))),
                         F.sum(F.when(core, then * F.col("both")))).alias("core_r"),
        )
    )
    whole = Window.partitionBy("list")
    index_start = F.min(F.when(F.col("priced") >= settings.rare_min_titles, F.col("period"))).over(whole)
    days = (
        sums.join(moved, ["list", "period"], "left")
        .join(size, "list")
        .na.fill(0, ["priced", "compared"])
        .withColumn("index_start", index_start)
        .withColumn("indexed", F.col("period") >= F.col("index_start"))
        .withColumn("factor", F.when(
            (F.col("period") > F.col("index_start")) & (F.col("compared") >= settings.rare_min_titles),
            F.col("log_sum") / F.col("compared")).otherwise(0.0))
        .withColumn("raw", round_even(
            100.0 * F.exp(F.sum("factor").over(timeline.rowsBetween(*RUNNING))), 2))
        .withColumn("start", F.min(F.when(
            F.col("indexed") & (F.col("live") >= settings.cap_start_share * F.col("members")),
            F.col("period"))).over(whole))
        .where(F.col("period") >= F.col("start"))
    )
    later = F.col("period") > F.col("start")
    running = timeline.rowsBetween(*RUNNING)
    at_start = lambda c: F.max(F.when(~later, c)).over(whole)
    grown = lambda r: F.exp(F.sum(F.when(later, F.ln(F.coalesce(r, F.lit(1.0)))).otherwise(0.0)).over(running))
    return days.select(
        "list",
        "period",
        round_even(F.col("raw") / at_start(F.col("raw")) * 100, 2).alias("index_value"),
        F.when(F.col("period") == F.col("index_start"), F.col("priced")).otherwise(F.col("compared")).alias("compared"),
        F.rint(at_start(F.coalesce("total", F.lit(0.0))) * grown(F.col("r"))).alias("cap"),
        F.rint(at_start(F.coalesce("core_total", F.lit(0.0))) * grown(F.col("core_r"))).alias("core_cap"),
        "live",
    )


def market_cap(history: DataFrame, members: DataFrame, survival: float = DEFAULTS.cap_survival,
               settings: Settings = DEFAULTS) -> DataFrame:
    """list, period, cap, core_cap: the plain sum of median x copies x survival of the titles priced that period."""
    listed = members.groupBy("list", "site", "title").agg(F.max("copies").alias("held"))
    priced = (
        history.where(good_figure(F.col("copies"), F.col("median"), 1))
        .join(listed, ["site", "title"])
        .groupBy("list", "title", "period")
        .agg(F.max_by("median", "stamp").alias("median"), F.first("held").alias("held"))
    )
    worth = pennies(F.col("median")) * F.col("held")
    core = F.sum(F.when(F.col("held") < settings.cap_core_below, worth))
    return priced.groupBy("list", "period").agg(
        F.rint(F.sum(worth) * survival / 100).alias("cap"),
        F.rint(F.coalesce(core * survival / 100, F.lit(0.0))).alias("core_cap"),
        F.count(F.lit(1)).alias("titles"),
    )


def daily_series(history: DataFrame, now: Column, length: int, epoch: Column | None = None) -> DataFrame:
    """title, site, period, median, copies: the last figure of each of the last ``length`` finished periods."""
    first = now - length if epoch is None else F.greatest(now - length, epoch)
    rows = history.where(
        good_figure(F.col("copies"), F.col("median"), 1) & (F.col("period") >= first) & (F.col("period") < now))
    return rows.groupBy("title", "site", "period").agg(
        F.max_by("median", "stamp").alias("median"), F.max_by("copies", "stamp").alias("copies"))


def nested_series(series: DataFrame, epoch: Column) -> DataFrame:
    """One row per title and site with its points as [periods since the epoch, median, copies]."""
    points = F.array_sort(F.collect_list(F.struct((F.col("period") - epoch).alias("at"), "median", "copies")))
    return series.groupBy("title", "site").agg(points.alias("points"))
