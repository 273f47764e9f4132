"""The membership index of the archive: nothing it holds is missed, and little of it is read."""

import pytest
from pyspark.sql import functions as F

from titletide.sources import membership

KEY = ["g", "w"]


def rows(spark, low, high, months=2):
    return spark.range(low, high).select(
        F.concat(F.lit("title "), (F.col("id") % 97).cast("string")).alias("g"), F.col("id").cast("string").alias("w"),
        (F.col("id") * 2).alias("value"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("h"), F.concat(F.lit("2026-0"), (F.col("id") % months + 1).cast("string")).alias("month"))


def test_a_small_batch_reads_little_of_a_large_month(spark, tmp_path):
    path = str(tmp_path / "a")
    membership.append(rows(spark, 0, 60_000, 1), path, KEY, part_rows=1_000)
    assert spark.read.parquet(path).count() == 60_000  # the index is no part of the table
    assert spark.read.parquet(path).select("g", "w", "value", "h", F.col("month").cast("string")).exceptAll(rows(spark, 0, 60_000, 1)).isEmpty()
    unseen, seen = rows(spark, 100_000, 100_060, 1), rows(spark, 500, 502, 1)
    read = membership.known(unseen.union(seen), path, KEY, unseen)
    assert read.count() < 6_000 and read.join(seen, ["g", "w"], "left_semi").count() == 2
    assert membership.known(rows(spark, 0, 10, 1).withColumn("month", F.lit("2020-01")), path, KEY, unseen).count() == 0


def test_nothing_known_is_missed_over_many_runs(spark, tmp_path):
    path = str(tmp_path / "a")
    for low in (0, 700, 1_400):
        membership.append(rows(spark, low, low + 700), path, KEY, part_rows=100)
    asked = rows(spark, 300, 1_000).union(rows(spark, 2_000, 2_500))
    read = membership.known(asked, path, KEY, asked)
    got = {r.w for r in asked.join(read.select("month", "g", "w"), ["month", "g", "w"], "left_semi").collect()}
    assert got == {str(i) for i in [*range(300, 1_000), *range(2_000, 2_100)]}
    assert read.columns == asked.columns


def test_a_run_that_stopped_after_its_index(spark, tmp_path):
    path, batch = str(tmp_path / "a"), rows(spark, 0, 50)
    membership.append(rows(spark, 0, 0), path, KEY)
    failing = batch.withColumn("value", F.when(F.col("w") == "49", F.raise_error(F.lit("stopped"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="stopped"):
        membership.append(failing, path, KEY)
    assert membership.known(batch, path, KEY, batch).count() == 0
    membership.append(batch, path, KEY)
    assert membership.known(batch, path, KEY, batch).count() == 50
