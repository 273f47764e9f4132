"""An append-only table by month with a membership index, so that a batch reads only parts that may hold its keys.

Every run adds a folder for each of its months, in parts dealt by the hash of the key and sized by rows. Beside them, in a
folder that readers of the table pass over, the run leaves bitmaps of three bits a key, a few thousand keys to a bitmap:
some eight bits a key, a hundredth of a row. A batch asks the bitmaps of its months and opens only parts that may hold one
of its keys. The index is written before the rows it speaks of, so a run that stops midway leaves no row unknown.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART_ROWS = 1_000_000  # of a part of a run
BITMAP_KEYS = 4_000
BITS = 32_768  # of Spark's bitmaps
INDEX = "month STRING, run STRING, parts INT, part INT, subs INT, sub INT, bitmap BINARY"


def _files(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _exists(spark: SparkSession, path: str) -> bool:
    files, folder = _files(spark, path)
    return files.exists(folder)


def _part(parts: Column) -> Column:
    return F.pmod(F.col("_hash"), parts).cast("int")


def _sub(subs: Column) -> Column:
    return F.pmod(F.xxhash64("_hash", F.lit(1)), subs).cast("int")


def _places() -> Column:
    """The bits of a key in its bitmap."""
    return F.array(*(F.pmod(F.xxhash64("_hash", F.lit(i)), F.lit(BITS)).cast("int") for i in (2, 3, 4)))


def _is_set(place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, (place % 8).cast("int")) == 1


def _sized(rows: DataFrame, part_rows: int) -> DataFrame:
    """Rows with the parts and bitmaps that their month's number of rows asks for."""
    sizes = rows.groupBy("month").agg(F.count(F.lit(1)).alias("n")).select(
        "month", F.ceil(F.col("n") / part_rows).cast("int").alias("parts"),
        F.ceil(F.least(F.col("n"), F.lit(part_rows)) / BITMAP_KEYS).cast("int").alias("subs"))
    return rows.join(F.broadcast(sizes), "month").withColumn("part", _part(F.col("parts")))  # a row for each month


def append(rows: DataFrame, path: str, key: list[str], part_rows: int = PART_ROWS) -> None:
    """Adds rows, with their ``month``, under a run of its own: its index first."""
    run = uuid.uuid4().hex
    dealt = _sized(rows.withColumn("_hash", F.xxhash64(*key)), part_rows)
    bits = dealt.withColumn("sub", _sub(F.col("subs"))).withColumn("place", F.explode(_places()))
    index = bits.groupBy("month", "parts", "part", "subs", "sub").agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + 1)).alias("bitmap")).withColumn("run", F.lit(run))
    index.select(*(c.split()[0] for c in INDEX.split(", "))).write.partitionBy("month", "run").parquet(f"{path}/_index", mode="append")
    dealt.drop("_hash", "parts", "subs").withColumn("run", F.lit(run)).repartition("month", "part").write.mode("append").partitionBy(
        "month", "run", "part").parquet(path)


def possible(keys: DataFrame, path: str, key: list[str]) -> DataFrame:
    """month, run, part of every part that may hold one of the keys. ``keys`` have their ``month``."""
    spark = keys.sparkSession
    if not _exists(spark, f"{path}/_index"):
        return spark.createDataFrame([], "month STRING, run STRING, part INT")
    asked = keys.select("month", F.xxhash64(*key).alias("_hash")).distinct()
    months = [r.month for r in asked.select("month").distinct().collect()]  # a row for each month
    index = spark.read.schema(INDEX).parquet(f"{path}/_index").where(F.col("month").isin(months))
    runs = index.select("month", "run", "parts", "subs").distinct()
    wanted = asked.join(runs, "month").withColumn("part", _part(F.col("parts"))).withColumn("sub", _sub(F.col("subs")))
    met = wanted.join(index.select("month", "run", "part", "sub", "bitmap"), ["month", "run", "part", "sub"])
    return met.where(F.forall(_places(), _is_set)).select("month", "run", "part").distinct()


def known(keys: DataFrame, path: str, key: list[str], like: DataFrame) -> DataFrame:
    """The rows of the parts that may hold one of the keys, and of no others."""
    spark = keys.sparkSession
    parts = [f"{path}/month={r.month}/run={r.run}/part={r.part}" for r in possible(keys, path, key).collect()]  # names of files to open
    there = [p for p in parts if _exists(spark, p)]
    if not there:
        return spark.createDataFrame([], like.schema)
    month = F.regexp_extract(F.input_file_name(), r"/month=([^/]*)/", 1)
    return spark.read.schema(like.drop("month").schema).parquet(*there).withColumn("month", month).select(*like.columns)
