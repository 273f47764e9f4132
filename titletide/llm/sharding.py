"""Contiguous shards of nearly equal bytes, by prefix sums over the whole table. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from titletide.llm.common import ids_and_texts, utf8_size
from titletide.session import stored

OVERHEAD = 8  # bytes a row takes besides its text


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; law is ``bytes``.

    Rows are put in order of id, range by range. The totals of the ranges, one short row each, give every range its
    first byte; inside a range a running sum does the rest. A row goes to the shard in whose share of all bytes its
    middle byte lies, so shards are contiguous and off by less than a row at either end. ``slot`` counts a shard's rows
    from 0. The order is id, checksum, size and place in the input, so rows that repeat an id, or lack one (they come
    first), still spread over several ranges. Null texts count as empty. An empty table gives an empty result.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = stored(
        ids_and_texts(docs, id_col, text_col).select(
            "doc_id",
            (utf8_size(F.col("text")) + OVERHEAD).alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("place"),
        ), "shard-sizes")
    order = ("doc_id", "text_crc32", "size", "place")
    ranged = stored(sized.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "shard-ranges")
    before, everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    starts = ranged.groupBy("part").agg(F.sum("size").alias("part_size"), F.count(F.lit(1)).alias("part_rows")).select(
        "part",
        F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_size").over(everything).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    placed = ranged.join(starts, "part").select(
        "doc_id", "size", "text_crc32",
        (F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias("end"),
        (F.col("rows_before") + F.row_number().over(inside)).alias("rank"), "all_bytes",
    )
    shard = F.expr(f"cast((2 * end - size) * {int(shards)} div (2 * all_bytes) as int)")
    cut = stored(placed.withColumn("shard", shard).drop("end", "all_bytes"), "shard-places")
    firsts = cut.groupBy("shard").agg(F.min("rank").alias("first_rank"))  # one row for each shard
    return cut.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("rank") - F.col("first_rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
