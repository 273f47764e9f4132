"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case and every other character as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def utf8_size(text: Column) -> Column:
    """Bytes of the text in UTF-8; null counts as empty."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def crc_of(column: str) -> Column:
    """The unsigned CRC-32 of a column written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def partitions_for(spark: SparkSession, size: int, each: int) -> int:
    """Partitions so that one holds about ``each`` of ``size``, and no fewer than the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // each))


def ids_and_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only what an operator reads, under its own names, so that other columns of the table never clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def give_back() -> None:
    """Memory that this worker has freed goes back to the system, so that idle workers hold little of it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function of ``mapInArrow`` that gives back its memory at the end of a task."""
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()
    return tidied


def in_slices(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows``, so that few texts at a time are Python's."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def tied(*arrays: np.ndarray, level: int = 3) -> bytes:
    """Arrays as one compressed message."""
    head = json.dumps([(a.dtype.str, len(a)) for a in arrays]).encode()
    return zstandard.ZstdCompressor(level=level).compress(
        struct.pack("<I", len(head)) + head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def untied(body: bytes) -> list[np.ndarray]:
    """The arrays of a message."""
    whole = zstandard.ZstdDecompressor().decompress(body)
    (size,) = struct.unpack_from("<I", whole)
    at, out = 4 + size, []
    for kind, n in json.loads(whole[4:at]):
        out.append(np.frombuffer(whole, dtype=kind, count=n, offset=at))
        at += out[-1].nbytes
    return out
