"""Streaming queries run to the end of the event table, so that they can be compared with their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titletide.operators import snapshot as sn
from titletide.sources import adapters as ad
from titletide.session import shared_folder
from titletide.streaming import jobs


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"


def _source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = ad.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.items_of(_source(spark, sf_dir, "events"))
    return jobs.with_event_time(rows.withColumn("fetched", F.col("ts")))


def _finished(stream: DataFrame, name: str, mode: str, keys: list[str] | None = None, writer=None, schema: str | None = None) -> DataFrame:
    """The rows a stream wrote once it has read everything there is; with keys the last ones of each key. ``writer(out)``
    writes batches of rows of a ``schema`` of its own."""
    spark = stream.sparkSession
    out = _folder(spark, name)
    query = (stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", _folder(spark, name + "-state"))
             .foreachBatch(writer(out) if writer else jobs.batch_folders(out)).start())
    query.awaitTermination()
    shape = T._parse_datatype_string(schema) if schema else stream.schema
    if not query.recentProgress:
        return spark.createDataFrame([], shape)
    rows = spark.read.schema(T.StructType([*shape.fields, T.StructField("batch", T.LongType())])).parquet(out)
    if keys is None:
        return rows.drop("batch")
    others = [c for c in shape.names if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("row")).select(*keys, "row.*")


def stream_mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of each title and day."""
    rows = _finished(jobs.mention_counts(_items(spark, sf_dir)), "counts", "update", ["start", "title"])
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "title", "mentions")


def stream_surge_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline mentions of each title in every 24-hour window, hour by hour, and how many sources and stories have them."""
    members = _finished(jobs.surge_members(_items(spark, sf_dir)), "surges", "update", ["until", "title", "kind", "value"])
    return jobs.surge_windows(members).select(
        F.date_format("until", "yyyy-MM-dd HH").alias("until"), "title", "mentions", "sources", "stories")


def rolling_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot after two batches of every event: those before noon of any day, then the others. The batches go into
    a keyed table, and the second is repeated."""
    rows, clock = ad.items(spark, sf_dir), ad.now(spark, sf_dir)
    path = _folder(spark, "snapshot")
    write = jobs.snapshot_batches(path, clock)
    morning = F.hour("ts") < 12
    for batch_id, batch in enumerate((rows.where(morning), rows.where(~morning))):
        write(batch, batch_id)
    write(rows.where(~morning), 1)
    return jobs.rolling_snapshot(spark, path, sn.with_key(rows), clock).select("key", "event_id")


def stream_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions archived from the stream, each once."""
    path = _folder(spark, "archive")
    rows = _items(spark, sf_dir).withColumn("sentiment", F.lit(50))
    query = (rows.writeStream.trigger(availableNow=True).option("checkpointLocation", _folder(spark, "archive-state"))
             .foreachBatch(jobs.archive_batches(path)).start())
    query.awaitTermination()
    return spark.read.parquet(path).select("month", "g", "s", "h", F.date_format("d", "yyyy-MM-dd HH:mm:ss").alias("d"))


def stream_price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change log of line items as checks: a brand-less pair of part and supplier, its quantity as copies."""
    checks = _source(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("title"), F.col("l_suppkey").cast("string").alias("site"),
        F.col("l_shipdate").cast("timestamp").alias("stamp"), F.col("l_quantity").alias("copies"),
        F.lit(None).cast("double").alias("lowest"), F.col("l_discount").alias("median"))
    rows = _finished(checks, "changes", "append", writer=lambda out: jobs.price_change_batches(_folder(spark, "last-checks"), out),
                     schema="title STRING, site STRING, stamp TIMESTAMP, copies DOUBLE, lowest DOUBLE, median DOUBLE")
    return rows.groupBy("title").agg(F.count(F.lit(1)).alias("changes"))


def stream_surge_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Until when each title is held surging: 48 hours after its last mention in the news."""
    rows = _items(spark, sf_dir).where("source_type = 'news'").select(
        F.explode("matched_games").alias("title"), "ts")
    held = _finished(jobs.surge_holds(rows), "holds", "append")
    return held.groupBy("title").agg(F.date_format(F.max("held_until"), "yyyy-MM-dd HH:mm:ss").alias("held_until"))


def stream_source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every source after all its fetches; a fetch of value under 3 failed."""
    events = _source(spark, sf_dir, "events")
    fetches = events.select(F.col("user_id").cast("string").alias("feed"), F.col("ts").cast("timestamp").alias("at"),
                            (F.col("value") >= 3).alias("ok"), F.col("ts").cast("timestamp").alias("latest"))
    rows = _finished(fetches, "health", "append", ["feed"], lambda out: jobs.source_state_batches(_folder(spark, "sources"), out),
                     "feed STRING, ok BOOLEAN, failing_since TIMESTAMP, latest TIMESTAMP")
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rows.select("feed", "ok", show("failing_since"), show("latest"))


QUERIES = {f.__name__: f for f in (stream_mention_counts, stream_surge_windows, rolling_snapshot, stream_archive, stream_price_changes,
                                   stream_surge_holds, stream_source_health)}
