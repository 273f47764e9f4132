"""Writers. Archives are Parquet partitioned by month; a table that is replaced whole is switched by its manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titletide.operators import archive as ar
from titletide.operators import price_index as ix
from titletide.session import cut_lineage, forget
from titletide.sources import membership, tables


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at a path, or an empty one of the same shape when there is none yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(like.schema).parquet(path) if exists else spark.createDataFrame([], like.schema)


def replace_months(df: DataFrame, path: str) -> None:
    """Overwrites only the months that the rows belong to."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def append_archive(items: DataFrame, path: str) -> int:
    """Adds the mentions the archive does not hold; running it again adds nothing. Returns how many were added.

    Of the archive only the parts that may hold one of the batch's mentions are read."""
    rows = ar.archive_rows(items)
    known = membership.known(ar.keyed(rows), path, ar.MENTION_KEY, rows)
    fresh = cut_lineage(ar.new_mentions(rows, known).select(*rows.columns))
    added = fresh.count()
    if added:
        membership.append(ar.keyed(fresh), path, ar.MENTION_KEY)
    return added


def write_digital(snapshot: DataFrame, path: str) -> None:
    """The digital archive after a snapshot: unflagged stories leave, new ones come; months are replaced whole, and a
    month without a story left is removed."""
    spark, shape = snapshot.sparkSession, ar.digital_rows(snapshot)
    kept = stored(spark, path, shape)
    merged = cut_lineage(ar.merge_digital(snapshot, kept).select(*shape.columns))
    figures = lambda df, name: df.groupBy("month").agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("w")).alias("x")).alias(name))
    both = figures(kept, "before").join(figures(merged, "after"), "month", "full_outer")
    changed = both.where(~F.col("before").eqNullSafe(F.col("after"))).select("month", F.col("after").isNull().alias("empty")).collect()
    written = [r.month for r in changed if not r.empty]
    if written:
        replace_months(merged.where(F.col("month").isin(written)), path)
    for r in changed:
        if r.empty:
            forget(spark, f"{path}/month={r.month}")


def write_latest(latest: DataFrame, path: str) -> None:
    """The latest table, whole, in one switch. Its rows may come from this very table."""
    tables.publish(latest, path)


def read_latest(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The latest table as it was last switched, empty before the first time."""
    return tables.published(spark, path, like)


def append_history(rows: DataFrame, path: str) -> None:
    """Change-log rows of a run."""
    rows.withColumn("month", F.date_format("stamp", "yyyy-MM")).write.mode("append").partitionBy("month").parquet(path)


def write_series(series: DataFrame, path: str, epoch) -> None:
    """Daily series as nested JSON, one title and site a row, for charts."""
    ix.nested_series(series, epoch).write.mode("overwrite").json(path)


def write_index(index: DataFrame, left_out: DataFrame, path: str) -> None:
    """The index lines, and beside them the titles left out of them: once left out, always left out. The titles are
    switched first, so that a run that stops between the two has left out no less than its lines show."""
    spark = index.sparkSession
    once = tables.published(spark, path + "/left_out", left_out.select("title"))
    tables.publish(once.unionByName(left_out.select("title")).distinct(), path + "/left_out")
    tables.publish(index, path + "/lines")


def left_out(spark: SparkSession, path: str) -> DataFrame:
    """title of everything ever left out of the index."""
    return tables.published(spark, path + "/left_out", spark.createDataFrame([], "title STRING"))


def index_lines(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The index lines of the last run."""
    return tables.published(spark, path + "/lines", like)
