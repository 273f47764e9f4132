"""Structured Streaming twins of the stateful rules.

Counting jobs use windows and watermarks; keyed rules keep a small state per key; tables are written per micro-batch
in a way that a repeated batch does not change.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from titletide.config import DEFAULTS, Settings
from titletide.functions import text as X
from titletide.operators import snapshot as sn
from titletide.operators.mentions import mentions


def with_event_time(stream: DataFrame, settings: Settings = DEFAULTS, ahead: str = "1 HOUR") -> DataFrame:
    """Items with an event time: undated ones take the time they were fetched, dates too far ahead are dropped, and
    what is older than the retention is late."""
    ts = F.coalesce("ts", "fetched").cast("timestamp")
    fit = ts <= F.col("fetched").cast("timestamp") + F.expr(f"INTERVAL {ahead}")
    return stream.where(fit).withColumn("ts", ts).withWatermark("ts", f"{settings.retention_days} days")


def mention_counts(stream: DataFrame, width: str = "1 day") -> DataFrame:
    """window start, title, mentions: tumbling counts. ``stream`` has an event time ``ts`` with a watermark."""
    rows = mentions(stream)
    return rows.groupBy(F.window("ts", width), "title").agg(F.count(F.lit(1)).alias("mentions")).select(
        F.col("window.start").alias("start"), "title", "mentions")


def surge_members(stream: DataFrame) -> DataFrame:
    """until, title, kind, value, n: in each hour, named by its end, how often each source, each story and each way of
    being sure comes among a title's headline mentions. A state is one number for each, and goes with its hour;
    ``surge_windows`` puts the hours together, so that no mention is kept once for every window that it lies in."""
    named = F.coalesce(F.col("matched_in") != "body", F.lit(True))
    story = F.array_join(X.story_key(F.col("headline")), " ")
    member = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    kinds = F.array(member("mention", F.lit("")), member("source", F.col("source")), member("story", story),
                    member("sure", F.col("match_method") != "fuzzy"))
    rows = mentions(stream).where(named).select("ts", "title", F.inline(kinds))
    return rows.groupBy(F.window("ts", "1 hour"), "title", "kind", "value").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.end").alias("until"), "title", "kind", "value", "n")


def surge_windows(members: DataFrame, hours: int = 24) -> DataFrame:
    """until, title, mentions, sources, stories, sure of every sliding window of ``hours`` hours, hour by hour, that has a
    mention. ``members``: the newest members of every hour.

    A member comes into the windows with its hour and leaves them ``hours`` later, or when the same member comes again:
    the windows' numbers are sums over comings and goings, one row an hour and title."""
    hour = F.expr("INTERVAL 1 HOUR")
    leaves = F.col("until") + F.expr(f"INTERVAL {hours} HOURS")
    again = F.lead("until").over(Window.partitionBy("title", "kind", "value").orderBy("until"))
    spans = members.withColumn("left", F.least(leaves, again)).withColumn("gone", leaves)
    known = F.col("value").isNotNull()
    weight = lambda kind, more, n: F.when((F.col("kind") == kind) & more, n).otherwise(F.lit(0)).cast("bigint")
    number = {"mentions": weight("mention", F.lit(True), F.col("n")), "sources": weight("source", known, F.lit(1)),
              "stories": weight("story", known, F.lit(1)), "sures": weight("sure", F.col("value") == "true", F.lit(1))}
    end = F.when(F.col("kind") == "mention", F.col("gone")).otherwise(F.col("left"))
    moves = F.inline(F.array(
        F.struct(F.col("until").alias("at"), *[c.alias(name) for name, c in number.items()]),
        F.struct(end.alias("at"), *[(-c).alias(name) for name, c in number.items()])))
    steps = spans.select("title", moves).groupBy("title", "at").agg(*[F.sum(name).alias(name) for name in number])
    order = Window.partitionBy("title").orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    standing = steps.select("title", "at", F.lead("at").over(order).alias("next"),
                            *[F.sum(name).over(upto).alias(name) for name in number])
    return standing.where("mentions > 0").select(
        F.explode(F.sequence("at", F.col("next") - hour, hour)).alias("until"), "title", "mentions", "sources", "stories",
        (F.col("sures") > 0).alias("sure"))


def surge_holds(stream: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """title, held_until: emitted whenever a surging moment moves a title's hold. ``stream``: title, ts of such moments."""
    hold = pd.Timedelta(hours=settings.surge_hold_hours)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = pd.Timestamp(state.get[0]) if state.exists else None
        newest = max((batch["ts"].max() for batch in batches), default=None)
        until = newest + hold
        if before is None or until > before:
            state.update((until.to_pydatetime(),))
            yield pd.DataFrame({"title": [key[0]], "held_until": [until]})
        held = max(until, before) if before is not None else until
        state.setTimeoutTimestamp(max(int(held.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))

    return stream.groupBy("title").applyInPandasWithState(
        step, "title STRING, held_until TIMESTAMP", "held_until TIMESTAMP", "append", GroupStateTimeout.EventTimeTimeout)


def _keyed_batches(state: str, out: str, step, keep=None):
    """A ``foreachBatch`` writer of a rule that keeps a row for each key. ``step(batch, old)`` gives what the batch emits
    and the new rows of the state; the state is a keyed table. What is emitted is written first, to a folder of the batch
    under ``out``, and the state moves on after it, so a batch that is cut short is done again whole and a repeated one
    changes nothing. Nothing but joins, windows and sums is held, and these spill, however many rows a key has."""
    def write(batch: DataFrame, batch_id: int) -> None:
        from titletide.sources import tables

        emitted, rows, like = step(batch, None)

        def new(old: DataFrame) -> DataFrame:
            emitted, rows, _ = step(batch, old)
            emitted.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            return rows

        tables.merge_batch(new, rows, state, batch_id, batch.select(like.alias("key")), keep(batch) if keep else None)

    return write


def price_change_batches(state: str, out: str):
    """R6: a ``foreachBatch`` writer of the checks worth a history row: a pair's figures changed, or its first check of a
    day. Batches have title, site, stamp, copies, lowest, median; the state is the last check of each pair, which goes
    once it is two days old, as the first check of a new day counts in any case."""
    figures = ["copies", "lowest", "median"]
    key = F.to_json(F.array(F.col("title"), F.col("site")))
    day = F.date_format("stamp", "yyyy-MM-dd")

    def step(batch: DataFrame, old: DataFrame | None):
        rows = batch.select(key.alias("key"), "title", "site", "stamp", *(F.col(c).cast("double").alias(c) for c in figures)).withColumn("day", day)
        last = F.struct("stamp", *figures, "day")
        order = Window.partitionBy("key").orderBy("stamp", "copies", "median")
        changed = rows.groupBy("key").agg(F.max_by(last, F.struct("stamp", "copies", "median")).alias("last")).select("key", "last.*")
        if old is None:
            return None, changed, key
        held = old.select("key", F.struct(*(F.col(c) for c in (*figures, "day"))).alias("held"))
        before = rows.withColumn("before", F.lag(F.struct(*figures, "day")).over(order)).join(held, "key", "left").withColumn(
            "before", F.coalesce("before", "held"))
        same = F.struct(*figures, "day").eqNullSafe(F.col("before"))
        return before.where(~same).select("title", "site", "stamp", *figures), changed, key

    def keep(batch: DataFrame):
        newest = batch.agg(F.max("stamp")).first()[0]
        return F.lit(True) if newest is None else F.col("stamp") >= F.lit(newest) - F.expr("INTERVAL 2 DAYS")

    return _keyed_batches(state, out, step, keep)


def source_state_batches(state: str, out: str):
    """R7: a ``foreachBatch`` writer of feed, ok, failing_since, latest of every source that a batch touches: repeated
    failures keep the time of the first, and the newest item only moves forward. Batches have feed, at, ok, latest. There
    are as many states, of two stamps each, as there are sources."""
    key = F.coalesce(F.col("feed"), F.lit(""))

    def step(batch: DataFrame, old: DataFrame | None):
        rows = batch.select(key.alias("key"), "feed", "at", F.col("ok").cast("boolean").alias("ok"), "latest")
        won = rows.groupBy("key").agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("won"))
        after = ~F.col("ok") & (F.col("won").isNull() | (F.col("at") > F.col("won")))
        sums = rows.join(won, "key").groupBy("key").agg(
            F.first("feed").alias("feed"), F.max_by("ok", F.struct("at", "ok")).alias("ok"), F.first("won").alias("won"),
            F.min(F.when(after, F.col("at"))).alias("failed"), F.max(F.when(F.col("ok"), F.col("latest"))).alias("newest"))
        if old is None:
            return None, sums.select("key", F.col("failed").alias("failing_since"), F.col("newest").alias("latest")), key
        held = old.select("key", F.col("failing_since").alias("since"), F.col("latest").alias("before"))
        since = F.when(F.col("won").isNull(), F.coalesce("since", "failed")).otherwise(F.col("failed"))
        now = sums.join(held, "key", "left").select("key", "feed", "ok", since.alias("failing_since"),
                                                    F.greatest("newest", "before").alias("latest"))
        return now.drop("key"), now.select("key", "failing_since", "latest"), key

    return _keyed_batches(state, out, step)


def archive_batches(path: str):
    """A ``foreachBatch`` writer that appends to the archive exactly once: rows the archive holds are left out, so a
    repeated batch adds nothing."""
    from titletide.sources.sinks import append_archive

    def write(batch: DataFrame, batch_id: int) -> None:
        append_archive(batch.withColumn("ts", F.col("ts").cast("timestamp_ntz")), path)

    return write


def snapshot_batches(path: str, now, settings: Settings = DEFAULTS):
    """A ``foreachBatch`` writer of the rolling snapshot, a keyed table: a batch reads and writes only the buckets of its
    keys, and a repeated batch changes nothing. ``now``: a Column, or a function of the batch that gives one."""
    def write(batch: DataFrame, batch_id: int) -> None:
        from titletide.sources import tables

        new = sn.with_key(batch)
        clock = now(batch) if callable(now) else now
        alive = F.col("ts") >= clock - F.expr(f"INTERVAL {settings.retention_days} DAYS")
        none = new.limit(0)
        tables.merge_batch(lambda old: sn.upsert(none, sn.respect_owner(old, new)), new, path, batch_id, new, alive)

    return write


def rolling_snapshot(spark, path: str, like: DataFrame, now, settings: Settings = DEFAULTS) -> DataFrame:
    """The rows of the rolling snapshot that have not expired at ``now``. ``like``: items with their key."""
    from titletide.sources import tables

    return sn.retain(tables.merged(spark, path, like), now, settings)


def batch_folders(path: str):
    """A ``foreachBatch`` writer that keeps every micro-batch in a folder of its own: a repeated batch replaces what it
    wrote before. Reading the path gives the rows with their ``batch``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
