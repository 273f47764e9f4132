"""The rolling snapshot: merge, retention, trim, clean-up and change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titletide import vocab
from titletide.config import DEFAULTS, Settings
from titletide.functions import text as X
from titletide.operators.medians import keep_first
from titletide.operators.mentions import named_titles


def with_key(items: DataFrame) -> DataFrame:
    return items.withColumn("key", X.item_key(F.col("link"), F.col("source"), F.col("headline")))


def respect_owner(old: DataFrame, new: DataFrame) -> DataFrame:
    """New items without the forum threads whose key belongs to another source's row. Both keyed."""
    forum = F.coalesce(F.col("source_type") == "forum", F.lit(False))
    owners = (
        old.select("key", "feed", F.lit(0).alias("turn"))
        .unionByName(new.where(~forum).select("key", "feed", F.lit(1).alias("turn")))
        .groupBy("key")
        .agg(F.max(F.struct("turn", "feed")).alias("o"))
        .select("key", F.col("o.feed").alias("owner"), F.lit(True).alias("owned"))
    )
    rows = new.join(owners, "key", "left")
    free = ~forum | F.col("owned").isNull() | F.col("owner").eqNullSafe(F.col("feed"))
    return rows.where(free).drop("owner", "owned")


def upsert(old: DataFrame, new: DataFrame, order: str = "ts") -> DataFrame:
    """One row per key: the new item when there is one, of several the last."""
    columns = [c for c in new.columns if c != "key"]
    both = old.select("key", *columns).withColumn("turn", F.lit(0)).unionByName(
        new.select("key", *columns).withColumn("turn", F.lit(1)))
    pick = F.max_by(F.struct(*columns), F.struct("turn", order)).alias("row")
    return both.groupBy("key").agg(pick).select("key", "row.*")


def retain(items: DataFrame, now: Column, settings: Settings = DEFAULTS) -> DataFrame:
    return items.where(F.col("ts") >= now - F.expr(f"INTERVAL {settings.retention_days} DAYS"))


def ceiling_for(count: Column, settings: Settings = DEFAULTS) -> Column:
    """The row ceiling of a snapshot of ``count`` rows: raised in steps so that a tenth stays free, up to a maximum."""
    step = settings.ceiling_step
    wanted = F.ceil(F.floor(count / 0.9) / step) * step
    raised = F.greatest(F.lit(settings.row_ceiling),
                        F.least(wanted, F.lit(max(settings.ceiling_max, settings.row_ceiling))))
    return F.when(count <= settings.row_ceiling * 0.9, settings.row_ceiling).otherwise(raised)


def priority_trim(items: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The snapshot, cut to its ceiling where settings have one: rows naming a title first, the newest others into the room left.

    The cut is found from counts per minute, never by sorting the table: minutes of a 14-day window are few,
    and the one minute on the boundary is split by a hash of the key.
    """
    if settings.row_ceiling is None:
        return items
    named = F.size(named_titles(items)) > 0
    sizes = items.agg(F.count(F.lit(1)).alias("n"), F.count_if(named).alias("named"))
    ceiling = ceiling_for(F.col("n"), settings).cast("bigint")
    room = sizes.select(F.struct(ceiling.alias("named"),
                                 F.greatest(F.lit(0), ceiling - F.col("named")).alias("other"))).scalar()
    minute = -F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60)
    cell = F.pmod(F.xxhash64("key"), F.lit(1024))
    limit = F.when(named, room.getField("named")).otherwise(room.getField("other"))
    return keep_first(items, named, limit, [minute, cell], [F.desc("ts"), F.col("key")])


def thin_snapshot(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that name a title or carry a flag, feed / omitted counts of the others)."""
    flagged = (F.size(named_titles(items)) > 0) | F.col("is_remaster_rumor") | F.col("is_digital_only")
    flagged = F.coalesce(flagged, F.lit(False))
    omitted = items.where(~flagged).groupBy("feed").agg(
        F.count(F.lit(1)).alias("omitted"), F.min("ts").alias("oldest"))
    return items.where(flagged), omitted


def _keep_titles(items: DataFrame, keep) -> DataFrame:
    """Titles that fail a test leave their row; the lead title and the match fields follow."""
    before = named_titles(items)
    rows = items.withColumn("_before", before).withColumn("_kept", F.filter(F.col("_before"), keep))
    none, changed = F.size("_kept") == 0, F.size("_kept") < F.size("_before")
    emptied = none & changed
    return (
        rows.withColumn("matched_games", F.when(changed, F.col("_kept")).otherwise(F.col("matched_games")))
        .withColumn("matched_game", F.when(changed, F.try_element_at("_kept", F.lit(1))).otherwise(F.col("matched_game")))
        .withColumn("match_score", F.when(emptied, 0).otherwise(F.col("match_score")))
        .withColumn("match_method", F.when(~emptied, F.col("match_method")))
        .withColumn("matched_in", F.when(~emptied, F.col("matched_in")))
        .drop("_before", "_kept")
    )


def reclean(items: DataFrame) -> DataFrame:
    """Stored rows cleaned again by today's rules: non-titles, number-only hits, ordinary words, lookalikes, and
    names that belong to a newer title."""
    board = F.col("source_type") == vocab.BOARD_TYPE
    headline = X.normalise(F.col("headline"))
    by_title = F.coalesce(F.col("matched_in") == "title", F.lit(False))
    says_platform = X.has_context(F.col("headline"))

    def keep(title: Column) -> Column:
        name = X.normalise(title)
        number = name.rlike("^[0-9]+$") & ~board & by_title & ~X.written_as_title(title, F.col("headline"))
        capital = name.isin(*vocab.CAPITALISED_TITLES) & F.regexp_like(
            F.col("headline"), F.concat(F.lit(r"(?U)\b"), title, F.lit(r"\b")))
        ordinary = name.isin(*vocab.ORDINARY_TITLES) & ~board & ~says_platform & ~capital
        whole = (name == "hardware online arena") & ~board & ~F.contains(headline, name)
        lookalike = F.lit(False)
        for known, others in vocab.LOOKALIKES.items():
            lookalike = lookalike | ((name == known) & X.has_any(headline, others))
        stray = lookalike & ~board & by_title & (F.col("match_method") == "fuzzy") & ~F.contains(headline, name)
        newer = F.lit(False)
        for known, followers in vocab.FOLLOWERS.items():
            open_name = f" {known}(?= )(?! (?:{'|'.join(followers)}) )"
            newer = newer | ((name == known) & F.contains(X.padded(headline), F.lit(f" {known} "))
                             & ~X.padded(headline).rlike(open_name))
        return ~(name.isin(*vocab.NOT_TITLES) | number | ordinary | whole
                 | F.coalesce(stray, F.lit(False)) | (newer & ~board))

    return _keep_titles(items, keep)


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: rows added, rows gone, and whether the table must be written. Rows that only aged out are no change."""
    columns = new.columns
    added = new.exceptAll(old.select(columns)).agg(F.count(F.lit(1)).alias("added"))
    gone = old.select(columns).exceptAll(new).agg(F.count(F.lit(1))).scalar()
    return added.withColumn("gone", gone).withColumn("write", F.col("added") > 0)


def diff_snapshots(a: DataFrame, b: DataFrame, keys: list[str], ignore: list[str] = []) -> DataFrame:
    """Rows that differ between two snapshots, with the first field that does. Columns only one side has are ignored."""
    fields = [c for c in a.columns if c in b.columns and c not in keys and c not in ignore]
    left = a.select(*keys, F.struct(*fields).alias("old"))
    right = b.select(*keys, F.struct(*fields).alias("new"))
    joined = left.join(right, keys, "full_outer")
    first = F.coalesce(*[
        F.when(~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")), F.lit(c)) for c in fields])
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise(first)
    return joined.withColumn("change", change).where("change IS NOT NULL").select(*keys, "change")
