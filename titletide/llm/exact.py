"""Exact duplicates through an extendible-hash index on shared files.

Keys are 64-bit hashes of the lower-cased text. The key space is cut into equal ranges, one owner task for each. Before
the shuffle every map task folds equal texts of a stretch into one row, so a text that fills a third of the table
arrives once per stretch and not once per row. The owner meets its keys in order, chains texts that share a key and
tells them apart by comparing bytes, then grows its part of the directory: it doubles while a bucket holds more than
``capacity`` entries, and splits only the overfull buckets. Bucket entries go to Parquet files in the shared folder,
from which rows look up their group by key and digest; that join is one that adaptive execution can split at hot keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titletide.llm.common import ids_and_texts, partitions_for, tidy
from titletide.session import stored

STRETCH = 8 << 20  # bytes of different texts that a map task folds at once
SPARK_SEED = 42  # of Spark's xxhash64
OWNED = 16 << 20  # bytes of text that an owner should get
ENTRY = "doc_id long, key long, text_sha256 string, n_bytes long, text_key long"
FOLDED = "owner int, key long, text_sha256 string, body binary, keep_id long, copies long"
BUCKETS = ("owner int, bucket long, depth int, directory_depth int, key long, chain int, text_sha256 string, "
           "keep_id long, group_size long, n_bytes long")


def _lower(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.binary())


def _key(body: bytes) -> int:
    return xxhash.xxh64_intdigest(body)


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = pc.fill_null(batch.column("text"), "").cast(pa.binary())
        bodies = _lower(batch.column("text"))
        rows = [(_signed(_key(b := x.as_py())), hashlib.sha256(b).hexdigest(), len(b)) for x in bodies]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
             pa.array([r[2] for r in rows], pa.int64()), pa.array([_signed(xxhash.xxh64_intdigest(x.as_py(), SPARK_SEED)) for x in raw], pa.int64())],
            names=["doc_id", "key", "text_sha256", "n_bytes", "text_key"])


def _fold(owners: int):
    """Equal texts of a stretch become one row with their largest id and their number."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list] = {}
        held = 0

        def out() -> pa.RecordBatch:
            keys = [_key(b) for b in found]
            return pa.RecordBatch.from_arrays(
                [pa.array([k * owners >> 64 for k in keys], pa.int32()), pa.array(map(_signed, keys), pa.int64()),
                 pa.array([hashlib.sha256(b).hexdigest() for b in found], pa.string()), pa.array(found, pa.binary()),
                 pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64())],
                names=["owner", "key", "text_sha256", "body", "keep_id", "copies"])

        for batch in batches:
            for doc, body in zip(batch.column("doc_id").to_pylist(), _lower(batch.column("text"))):
                body = body.as_py()
                known = found.get(body)
                if known is None:
                    found[body] = [doc, 1]
                    held += len(body) + 200
                else:
                    known[1] += 1
                    if doc is not None and (known[0] is None or doc > known[0]):
                        known[0] = doc
                if held > STRETCH:
                    yield out()
                    found, held = {}, 0
        if found:
            yield out()
    return fold


def grow_directory(keys: np.ndarray, capacity: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(directory depth, bucket of every key, depth of that bucket) for ascending 64-bit keys.

    A bucket is the keys that share their first ``depth`` bits. While one holds more than ``capacity`` different keys it
    splits on its next bit; when its depth passes the directory's, the directory doubles. Equal keys stay together.
    """
    starts, ends, depths, prefixes = [0], [len(keys)], [0], [0]
    directory, at = 0, 0
    while at < len(starts):
        low, high, depth = starts[at], ends[at], depths[at]
        if high - low > capacity and depth < 64 and keys[low] != keys[high - 1]:
            bit = np.uint64(1) << np.uint64(63 - depth)
            first = np.uint64(prefixes[at]) << np.uint64(64 - depth) if depth else np.uint64(0)
            middle = int(np.searchsorted(keys, first | bit))
            starts[at:at + 1], ends[at:at + 1] = [low, middle], [middle, high]
            depths[at:at + 1], prefixes[at:at + 1] = [depth + 1] * 2, [prefixes[at] * 2, prefixes[at] * 2 + 1]
            directory = max(directory, depth + 1)
        else:
            at += 1
    sizes = np.subtract(ends, starts)
    return directory, np.repeat(np.array(prefixes, dtype=np.uint64), sizes), np.repeat(np.array(depths), sizes)


def _own(capacity: int):
    """Rows of one owner's key range, in order of key, become the entries of its buckets."""
    def flush(owner: int, entries: list[list]) -> pa.RecordBatch:
        keys = np.array([e[0] for e in entries], dtype=np.int64).view(np.uint64)
        directory, buckets, depths = grow_directory(keys, capacity)
        return pa.RecordBatch.from_arrays(
            [pa.array([owner] * len(entries), pa.int32()), pa.array(buckets.view(np.int64)), pa.array(depths.astype(np.int32)),
             pa.array([directory] * len(entries), pa.int32()), pa.array(keys.view(np.int64)),
             *(pa.array([e[i] for e in entries], t) for i, t in
               ((1, pa.int32()), (2, pa.string()), (3, pa.int64()), (4, pa.int64()), (5, pa.int64())))],
            names=[x.split()[0] for x in BUCKETS.split(", ")])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, entries, chain, chained = None, [], {}, None
        for batch in batches:
            names = ("owner", "key", "text_sha256", "keep_id", "copies")
            bodies = batch.column("body")
            for i, (new, key, sha, keep, copies) in enumerate(zip(*(batch.column(n).to_pylist() for n in names))):
                if new != owner:
                    if entries:
                        yield flush(owner, entries)
                    owner, entries, chain, chained = new, [], {}, None
                if key != chained:
                    chain, chained = {}, key  # only the texts of the key at hand are held
                body = bodies[i].as_py()
                entry = chain.get(body)
                if entry is None:
                    entry = chain[body] = [key, len(chain), sha, keep, copies, len(body)]
                    entries.append(entry)
                else:
                    entry[3] = max((x for x in (entry[3], keep) if x is not None), default=None)
                    entry[4] += copies
        if entries:
            yield flush(owner, entries)
    return own


def build_index(docs: DataFrame, owners: int, capacity: int = 512) -> DataFrame:
    """The bucket entries: one row for each different text, written under the shared folder."""
    folded = docs.mapInArrow(tidy(_fold(owners)), FOLDED)
    order = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    ranged = folded.repartition(owners, "owner").sortWithinPartitions("owner", order)
    return stored(ranged.mapInArrow(tidy(_own(capacity)), BUCKETS), "exact-index")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 512) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_bytes, text_key of every row.

    Texts are equal when they are the same after lower-casing A-Z; null counts as empty. Of a group the row with the
    largest id stays. Rows without an id count in ``group_size`` and stay only if their group has no id at all. Rows
    that repeat id and text are marked alike, as nothing tells them apart. ``text_key`` is Spark's
    xxhash64 of the text as written, for joining the answer back to rows whose ids repeat. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = ids_and_texts(docs, id_col, text_col)
    entries = stored(docs.mapInArrow(tidy(_entries), ENTRY), "exact-entries")
    size = entries.agg(F.sum("n_bytes")).first()[0] or 0
    index = build_index(docs, max(64, partitions_for(spark, size, OWNED)), capacity)
    groups = index.where("group_size > 1").select("key", "text_sha256", "keep_id", "group_size")
    return entries.join(groups, ["key", "text_sha256"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256", "n_bytes", "text_key",
    )
