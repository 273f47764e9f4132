"""Tables switched by manifests, keyed tables, and exact numbers on streams."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from titletide.sources import tables
from titletide.streaming import jobs

SHAPE = "key STRING, value INT, ts INT"


def frame(spark, rows):
    return spark.createDataFrame(rows, SHAPE)


def test_a_writer_that_stops_midway_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    old, new = frame(spark, [("a", 1, 1)]), frame(spark, [("b", 2, 2)])
    assert tables.published(spark, path, old).count() == 0
    tables.publish(old, path)

    def stop(*_):
        raise KeyboardInterrupt

    for broken in ("commit", "publish"):
        with monkeypatch.context() as patch:
            if broken == "commit":  # the data is there, the manifest is not
                patch.setattr(tables, "commit", stop)
                with pytest.raises(KeyboardInterrupt):
                    tables.publish(new, path)
            else:  # the rows fail while they are written
                with pytest.raises(Exception, match="DIVIDE_BY_ZERO|Division by zero"):
                    tables.publish(new.withColumn("value", (F.col("ts") / F.lit(0)).cast("int")), path)
        assert tables.published(spark, path, old).collect() == old.collect()
    tables.publish(new, path)
    assert tables.published(spark, path, old).collect() == new.collect()
    assert len(os.listdir(path + "/data")) == 2  # the table and the one before; what failed is gone


def test_a_table_may_be_made_of_itself(spark, tmp_path):
    path, rows = str(tmp_path / "t"), frame(spark, [("a", 1, 1)])
    tables.publish(rows, path)
    for _ in range(4):
        held = tables.published(spark, path, rows)
        tables.publish(held.withColumn("value", F.col("value") * 2), path)
    assert tables.published(spark, path, rows).first().value == 16
    assert len(os.listdir(path + "/manifests")) <= 4  # two, and their checksums


def newest(old, new):
    return new


def test_keyed_table_against_a_dictionary(spark, tmp_path):
    """Random batches, several of them repeated, with so few deltas that buckets are rewritten again and again."""
    draw, path, held = random.Random(5), str(tmp_path / "k"), {}
    for batch_id in range(9):
        rows = {f"k{draw.randrange(25)}": draw.randrange(100) for _ in range(draw.randrange(1, 9))}
        batch = frame(spark, [(k, v, batch_id if v % 7 else 0) for k, v in rows.items()])
        alive = F.col("ts") >= batch_id - 4
        for _ in range(draw.choice((1, 1, 2))):
            tables.merge_batch(lambda old, b=batch: b, batch, path, batch_id, batch, alive, buckets=4, deltas=2)
        held.update({k: (v, batch_id if v % 7 else 0) for k, v in rows.items()})
        got = {r.key: (r.value, r.ts) for r in tables.merged(spark, path, batch, alive).collect()}
        assert got == {k: v for k, v in held.items() if v[1] >= batch_id - 4}
    assert max(len(f) for f in tables.manifest(spark, path)["buckets"].values()) <= 2


def test_a_batch_touches_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "k")
    first = frame(spark, [(f"k{i}", i, 1) for i in range(200)])
    assert len(tables.merge_batch(lambda old: first, first, path, 0, first, buckets=16)) == 16
    before = tables.manifest(spark, path)["buckets"]
    second, seen = frame(spark, [("k3", 999, 2)]), []

    def rows(old):
        seen.append(old.count())
        return second

    written = tables.merge_batch(rows, second, path, 1, second, buckets=99)
    assert len(written) == 1 and 0 < seen[0] < 40  # what was read is one bucket of sixteen
    after = tables.manifest(spark, path)["buckets"]
    assert {b for b in after if after[b] != before.get(b)} == {str(written[0])}
    assert tables.merge_batch(rows, second, path, 1, second) == [] and tables.merge_batch(rows, second, path, 0, second) == []
    assert tables.merged(spark, path, first).where("key = 'k3'").first().value == 999
    assert tables.merged(spark, path, first).count() == 200


def test_a_batch_without_rows(spark, tmp_path):
    path, none = str(tmp_path / "k"), frame(spark, [])
    assert tables.merge_batch(lambda old: none, none, path, 0, none) == []
    assert tables.merged(spark, path, none).count() == 0


def test_windows_count_sources_and_stories_exactly(spark, tmp_path):
    """Several batches; the newest numbers of every window are those of all rows at once."""
    draw, start = random.Random(3), dt.datetime(2026, 10, 14)
    shape = ("headline STRING, source STRING, matched_games ARRAY<STRING>, matched_game STRING, matched_in STRING, match_method STRING, "
             "ts TIMESTAMP")
    rows = [(f"{draw.choice('abc')} {draw.choice('abc')}", draw.choice(["s1", "s2", "s3", None]), ["Ico"], "Ico", draw.choice(["title", "body", None]),
             draw.choice(["exact", "fuzzy"]), start + dt.timedelta(hours=draw.randrange(60))) for _ in range(60)]
    for at in range(0, 60, 20):
        spark.createDataFrame(rows[at:at + 20], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "14 days")
    out = str(tmp_path / "out")
    query = (jobs.surge_members(stream).writeStream.outputMode("update").trigger(availableNow=True)
             .option("checkpointLocation", str(tmp_path / "state")).foreachBatch(jobs.batch_folders(out)).start())
    query.awaitTermination()
    found = spark.read.parquet(out)
    last = found.groupBy("until", "title", "kind", "value").agg(F.max_by("n", "batch").alias("n"))
    got = {r.until: (r.mentions, r.sources, r.stories, r.sure) for r in jobs.surge_windows(last).collect()}
    want = {}
    for hour in range(1, 84):
        until = start + dt.timedelta(hours=hour)
        inside = [r for r in rows if until - dt.timedelta(hours=24) <= r[6] < until and r[4] != "body"]
        if inside:
            want[until] = (len(inside), len({r[1] for r in inside} - {None}), len({" ".join(sorted(set(r[0].split()))) for r in inside}),
                           any(r[5] != "fuzzy" for r in inside))
    assert got == want
