"""Price history: change log, latest state, week-before comparison, steady pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titletide.config import DEFAULTS, MAIN_SITES, Settings
from titletide.functions.numbers import round_even

FIGURES = ("copies", "lowest", "median")


def change_rows(checks: DataFrame) -> DataFrame:
    """The checks worth a history row: figures changed, or the first check of a day. ``checks``: title,
    site, stamp and figures, in any order; a pair's checks are bounded by how often it can be looked up."""
    w = Window.partitionBy("title", "site").orderBy("stamp")
    before = F.lag(F.struct(*FIGURES)).over(w)
    first = F.lag("stamp").over(w).isNull() | (F.lag("stamp").over(w).cast("date") < F.col("stamp").cast("date"))
    same = F.struct(*FIGURES).eqNullSafe(before)
    return checks.withColumn("_same", same).withColumn("_first", first).where(
        F.col("_first") | ~F.col("_same")).drop("_same", "_first")


def change_rows_against(new: DataFrame, latest: DataFrame) -> DataFrame:
    """The same rule for one run: ``new`` checks against the stored ``latest`` with its day of ``recorded``."""
    old = latest.select("title", "site", *[F.col(c).alias(f"old_{c}") for c in FIGURES],
                        F.col("recorded").alias("old_recorded"))
    same = F.lit(True)
    for c in FIGURES:
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    today = F.col("checked").cast("date")
    quiet = same & (F.col("old_recorded") == today)
    return (
        new.where(F.col("copies").isNotNull())
        .join(old, ["title", "site"], "left")
        .where(~F.coalesce(quiet, F.lit(False)))
        .select(F.col("checked").alias("stamp"), "title", "site", *FIGURES)
    )


def update_latest(old: DataFrame, new: DataFrame, keep_new_days: int = 3) -> DataFrame:
    """The latest table after a run: an answer wins, an error or no check keeps the old row. Rows: title,
    site, status, checked, copies, lowest, median, new_copies, new_median, new_checked."""
    answered = new.where(F.col("status") != "error")
    a, b = old.alias("a"), answered.alias("b")
    hit = F.col("b.status").isNotNull()
    unmatched = F.col("b.status") == "unmatched"
    recent = (F.col("b.new_checked").isNull() & F.col("a.new_checked").isNotNull()
              & (F.col("b.checked") - F.col("a.new_checked") < F.expr(f"INTERVAL {keep_new_days} DAYS")))
    pick = lambda c: F.when(hit, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    figure = lambda c: (F.when(hit & unmatched, F.lit(None)).when(hit, F.col(f"b.{c}"))
                        .otherwise(F.col(f"a.{c}")).alias(c))
    carried = lambda c: (F.when(hit & ~recent, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
    joined = a.join(b, (F.col("a.title") == F.col("b.title")) & (F.col("a.site") == F.col("b.site")), "full_outer")
    return joined.select(
        F.coalesce("a.title", "b.title").alias("title"),
        F.coalesce("a.site", "b.site").alias("site"),
        pick("status"), pick("checked"),
        *[figure(c) for c in FIGURES],
        *[carried(c) for c in ("new_copies", "new_median", "new_checked")],
    )


def week_before(latest: DataFrame, history: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Beside each latest figure, the one a week before: the newest row 7 to 9 periods back, else the oldest
    row 3 to 7 back. The row is chosen first; when its figure is no good there is no comparison."""
    near, slack, least = settings.change_days, settings.change_slack_days, settings.change_min_days
    rows = history.select("title", "site", F.col("period").alias("then"), F.col("stamp").alias("then_stamp"),
                          F.col("median").alias("then_median"))
    age = F.col("period") - F.col("then")
    point = F.struct("then", "then_stamp", "then_median")
    order = F.struct("then", "then_stamp")
    joined = latest.select("title", "site", "period", "median").join(rows, ["title", "site"], "left").where(
        F.col("then").isNull() | (age <= near + slack))
    found = joined.groupBy("title", "site").agg(
        F.first("period").alias("period"),
        F.first("median").alias("median"),
        F.max_by(point, F.when(age.between(near, near + slack), order)).alias("week"),
        F.min_by(point, F.when((age >= least) & (age < near), order)).alias("young"),
    )
    chosen = F.coalesce("week", "young")
    good = (F.col("chosen.then_median") > 0) & ~F.isnan("chosen.then_median") & F.col("median").isNotNull()
    return found.withColumn("chosen", chosen).select(
        "title", "site", "period", "median",
        F.when(good, F.col("chosen.then")).alias("week_period"),
        F.when(good, F.col("chosen.then_median")).alias("week_median"),
    )


def latest_of(history: DataFrame) -> DataFrame:
    """The newest history row of each title and site."""
    newest = F.max_by(F.struct("period", "stamp", *FIGURES), F.struct("period", "stamp")).alias("row")
    return history.groupBy("title", "site").agg(newest).select("title", "site", "row.*")


def steady_pairs(history: DataFrame, now: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """title, site, steady: whether a pair has priced the same for days. Only pairs with recent rows are listed."""
    recent = history.where(F.col("period").between(now - settings.steady_look_days, now))
    sound = F.bool_and(F.col("copies").isNotNull() & F.col("median").isNotNull())
    figures = recent.groupBy("title", "site").agg(
        F.count(F.lit(1)).alias("rows"),
        (F.max("period") - F.min("period")).alias("span"),
        sound.alias("sound"),
        F.min("copies").alias("c0"), F.max("copies").alias("c1"), F.median("copies").alias("cm"),
        F.min("median").alias("m0"), F.max("median").alias("m1"), F.median("median").alias("mm"),
    )
    steady = (
        (F.col("rows") >= settings.steady_min_rows)
        & (F.col("span") >= settings.steady_span_days)
        & F.col("sound")
        & (F.col("c0") >= settings.steady_min_copies)
        & (F.col("m0") > 0)
        & (F.try_divide(F.col("c1") - F.col("c0"), F.col("cm")) <= settings.steady_copies_range)
        & (F.try_divide(F.col("m1") - F.col("m0"), F.col("mm")) <= settings.steady_price_range)
    )
    return figures.select("title", "site", "rows", F.coalesce(steady, F.lit(False)).alias("steady"))


def market_change(latest: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """title, change_pct: the week's change averaged over the main sites that have one."""
    usable = (F.col("site").isin(*MAIN_SITES) & (F.col("copies") >= settings.market_min_copies)
              & (F.col("week_median") > 0) & F.col("median").isNotNull())
    pct = (F.col("median") - F.col("week_median")) / F.col("week_median") * 100
    return latest.where(usable).groupBy("title").agg(round_even(F.avg(pct), 1).alias("change_pct"))
