"""Tables that are replaced in one step, and keyed tables that take batches bucket by bucket.

A table is a folder of data folders and numbered manifests. Data is written first, under a name of its own; the manifest
that names it is moved into place last. Readers follow the highest manifest, so a writer that stops midway leaves the
table as it was. One writer at a time is assumed.

A keyed table has a fixed number of buckets. A batch adds a delta of its rows to the buckets it touches; a bucket with
many deltas is rewritten, without what has expired. The manifest remembers the last batch, so a repeated one changes
nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titletide.session import forget

BUCKETS = 64
DELTAS = 8  # of a bucket before it is rewritten


def _store(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _numbers(spark: SparkSession, path: str) -> list[int]:
    files, folder = _store(spark, f"{path}/manifests")
    if not files.exists(folder):
        return []
    names = [f.getPath().getName() for f in files.listStatus(folder)]
    return sorted(int(n) for n in names if n.isdigit())


def manifest(spark: SparkSession, path: str) -> dict | None:
    """What the newest manifest says, with its ``number``; None where no table has been published."""
    numbers = _numbers(spark, path)
    if not numbers:
        return None
    files, file = _store(spark, f"{path}/manifests/{numbers[-1]:020d}")
    stream = files.open(file)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return {**json.loads(text), "number": numbers[-1]}


def commit(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """Moves a manifest into place; then what neither it nor the one before names goes."""
    before = manifest(spark, path)
    if before and before["number"] >= number:
        raise RuntimeError(f"{path} has been written meanwhile")
    files, draft = _store(spark, f"{path}/drafts/{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    try:
        stream.write(bytearray(json.dumps(content).encode()))
    finally:
        stream.close()
    _, place = _store(spark, f"{path}/manifests/{number:020d}")
    files.mkdirs(place.getParent())
    if not files.rename(draft, place):
        raise RuntimeError(f"manifest {number} of {path} could not be moved into place")
    named = set(content["folders"]) | set(before["folders"] if before else ())
    _, data = _store(spark, f"{path}/data")
    for entry in files.listStatus(data) if files.exists(data) else ():
        if entry.getPath().getName() not in named:
            forget(spark, f"{path}/data/{entry.getPath().getName()}")
    for old in _numbers(spark, path)[:-2]:
        forget(spark, f"{path}/manifests/{old:020d}")


def publish(df: DataFrame, path: str) -> None:
    """The rows become the table. They may come from this very table: nothing that they read is touched before the
    switch, and what the last manifest names stays until the next."""
    spark = df.sparkSession
    now = manifest(spark, path)
    folder = f"t-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/data/{folder}")
    commit(spark, path, (now["number"] if now else 0) + 1, {"folders": [folder]})


def published(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table as its newest manifest has it, or an empty one of the same shape."""
    now = manifest(spark, path)
    if now is None:
        return spark.createDataFrame([], like.schema)
    return spark.read.schema(like.schema).parquet(*(f"{path}/data/{f}" for f in now["folders"]))


# --- keyed tables -----------------------------------------------------------------------------------------------------

def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")


def _rows(spark: SparkSession, path: str, now: dict | None, like: DataFrame, only: list[int] | None = None) -> DataFrame:
    """Every version of the rows of some buckets, with their ``turn`` and ``bucket``."""
    shape = T.StructType([*like.schema.fields, T.StructField("turn", T.LongType()), T.StructField("bucket", T.IntegerType())])
    parts = [f"{path}/data/{f}/bucket={b}" for b, folders in (now["buckets"] if now else {}).items()
             if only is None or int(b) in only for f in folders]
    if not parts:
        return spark.createDataFrame([], shape)
    turn = F.regexp_extract(F.input_file_name(), r"/data/d-(\d+)-", 1).cast("long")
    bucket = F.regexp_extract(F.input_file_name(), r"/bucket=(\d+)/", 1).cast("int")
    return spark.read.schema(like.schema).parquet(*parts).withColumn("turn", turn).withColumn("bucket", bucket)


def _newest(rows: DataFrame, columns: list[str]) -> DataFrame:
    others = [c for c in columns if c != "key"]
    return rows.groupBy("bucket", "key").agg(F.max_by(F.struct(*others), "turn").alias("row")).select("bucket", "key", "row.*")


def merged(spark: SparkSession, path: str, like: DataFrame, alive: Column | None = None, only: list[int] | None = None) -> DataFrame:
    """The newest row of each key, of the buckets asked for; ``alive`` says which have not expired."""
    rows = _newest(_rows(spark, path, manifest(spark, path), like, only), like.columns).select(*like.columns)
    return rows if alive is None else rows.where(alive)


def merge_batch(new: Callable[[DataFrame], DataFrame], like: DataFrame, path: str, batch_id: int, keys: DataFrame, alive: Column | None = None,
                buckets: int = BUCKETS, deltas: int = DELTAS) -> list[int]:
    """Adds a batch to a keyed table, and returns the buckets that were written.

    ``keys`` holds the batch's keys; ``new(old)`` gives its rows, one for each key that changes, from what the touched
    buckets hold. A batch whose id the table has passed changes nothing. Only touched buckets are read or written; one
    that has ``deltas`` folders is rewritten as one, without expired rows. A new table has ``buckets`` buckets for good."""
    spark = like.sparkSession
    now = manifest(spark, path)
    if now and now["batch"] >= batch_id:
        return []
    count = now["count"] if now else buckets
    touched = sorted(r[0] for r in keys.select(_bucket(count).alias("b")).distinct().collect())  # a row for each bucket at most
    number = (now["number"] if now else 0) + 1
    folder = f"d-{number:012d}-{uuid.uuid4().hex}"
    have = {int(b): list(f) for b, f in (now["buckets"] if now else {}).items()}
    full = [b for b in touched if len(have.get(b, [])) + 1 > deltas]
    old = _newest(_rows(spark, path, now, like, touched), like.columns)
    changed = new(old.select(*like.columns) if alive is None else old.select(*like.columns).where(alive)).select(
        *like.columns).withColumn("bucket", _bucket(count))
    rows = changed
    if full:  # rewritten: the newest of old and new
        kept = old.where(F.col("bucket").isin(full)).select(*like.columns, "bucket").join(changed.select("key"), "key", "left_anti")
        both = kept.unionByName(changed)
        rows = both if alive is None else both.where(alive | ~F.col("bucket").isin(full))
    if touched:
        rows.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(4))).write.partitionBy("bucket").parquet(f"{path}/data/{folder}")
    files, _ = _store(spark, path)
    written = [b for b in touched if files.exists(_store(spark, f"{path}/data/{folder}/bucket={b}")[1])]
    for b in touched:
        have[b] = ([] if b in full else have.get(b, [])) + ([folder] if b in written else [])
    names = sorted({f for folders in have.values() for f in folders})
    commit(spark, path, number, {"folders": names, "buckets": {str(b): f for b, f in have.items() if f}, "batch": batch_id, "count": count})
    return written
