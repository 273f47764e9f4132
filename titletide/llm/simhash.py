"""Near duplicates by SimHash, found with covering locality-sensitive hashing.

A fingerprint has 64 bits; two link when they differ in at most ``radius`` bits. Every bit position gets a code of
radius + 1 bits, and each non-zero vector of radius + 1 bits makes one mask: the positions whose code has an odd overlap
with it. The codes of ``radius`` differing positions always have a vector orthogonal to all of them, and that vector's
mask leaves every differing position out. So each pair within the radius meets, with equal masked bits, in at least one
of the 2^(radius+1) - 1 tables. Only different fingerprints enter the tables, each bucket gives a spanning forest of its
links and never all pairs, and components are joined from those forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titletide.llm.common import ids_and_texts, partitions_for, tidy
from titletide.operators.titles import components
from titletide.session import stored

SEED = 42
PIECE = 4 << 20  # bytes of text that are cut into words at once
BUCKET = 8192  # fingerprints of a bucket that are met in one go; larger ones are split on more bits
WHITE = b" \t\n\x0b\x0c\r"


def covering_masks(radius: int) -> list[int]:
    """One 64-bit mask for each non-zero vector of radius + 1 bits."""
    width = radius + 1
    codes = [1 + position % ((1 << width) - 1) for position in range(64)]
    return [sum(1 << p for p, code in enumerate(codes) if (code & v).bit_count() & 1) for v in range(1, 1 << width)]


def _word_runs(body: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in runs from pieces of bounded size that end at white space."""
    at = 0
    while at < len(body):
        end = min(at + PIECE, len(body))
        while end < len(body) and body[end] not in WHITE:
            end += 1
        yield body[at:end].split()
        at = end


def _votes(words: list[bytes], size: int, totals: np.ndarray) -> int:
    """Adds the bits of every shingle of the words to ``totals`` and returns the number of shingles."""
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1:].tolist())])
    table = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8)
    for low in range(0, len(table), 1 << 16):
        totals += np.unpackbits(table[low:low + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return len(table)


def fingerprint(text: str | None, size: int = 4) -> int:
    """The SimHash of a whole text over shingles of ``size`` words, repeats counted; zero for a text without words."""
    body = (text or "").encode("utf-8", "surrogatepass")
    totals, shingles, carried = np.zeros(64, dtype=np.int64), 0, []
    for words in _word_runs(body.translate(_LOWER)):
        words = carried + words
        if len(words) >= size:
            shingles += _votes(words, size, totals)
            words = words[len(words) - size + 1:] if size > 1 else []
        carried = words
    if not shingles and carried:
        shingles = _votes(carried, len(carried), totals)
    return int.from_bytes(np.packbits(totals * 2 > shingles).tobytes(), "big")


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), size) for x in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64)), batch.column("text_key")],
                                             names=["doc_id", "fp", "text_key"])
    return run


def forest(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of different fingerprints that join whatever is linked, one fewer than members for each component."""
    left, right, rest = [], [], prints
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            near = np.bitwise_count(rest ^ one) <= radius
            if near.any():
                met, rest = rest[near], rest[~near]
                left.append(np.full(len(met), one))
                right.append(met)
                queue.extend(met)
    if not left:
        return prints[:0], prints[:0]
    return np.concatenate(left), np.concatenate(right)


LINKS = "table_no int, value long, a long, b long"  # b is null in a row that goes to a finer bucket


def _meet(radius: int, masks: list[int], finer: int):
    """Buckets, in order, give forests. A bucket above the limit is dealt out again by blocks of the bits its mask leaves
    out, one block more than the radius: a pair within the radius agrees on a whole block, so none is lost."""
    def split(table: int, value: int, prints: np.ndarray) -> pa.RecordBatch:
        open_bits = [p for p in range(64) if not masks[table] >> p & 1]
        rows = []
        for block in range(radius + 1):
            kept = sum(1 << p for p in open_bits[block::radius + 1])
            parts = prints & np.uint64(kept)
            salt = np.uint64(xxhash.xxh64_intdigest(f"{table}/{value}/{block}"))
            rows.append(((parts ^ salt) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
        n = len(prints)
        return pa.RecordBatch.from_arrays(
            [pa.array([table] * n * (radius + 1), pa.int32()), pa.array(np.concatenate(rows)),
             pa.array(np.tile(prints, radius + 1).view(np.int64)), pa.nulls(n * (radius + 1), pa.int64())],
            names=["table_no", "value", "a", "b"])

    def give(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), dtype=np.int32)), pa.array(np.zeros(len(a), dtype=np.int64)),
                                           pa.array(a), pa.array(b)], names=["table_no", "value", "a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, dealt = np.zeros(0, dtype=np.uint64), None, False  # the bucket that the next batch may continue
        for batch in batches:
            tables = batch.column("table_no").to_numpy()
            values = batch.column("value").to_numpy()
            prints = batch.column("fp").to_numpy().view(np.uint64)
            if not len(prints):
                continue
            cuts = np.flatnonzero((np.diff(tables) != 0) | (np.diff(values) != 0)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(prints)]))
            left, right = [], []
            wide = np.flatnonzero((ends - starts > 1) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1))
            for i in wide:
                low, high = starts[i], ends[i]
                new, part = (int(tables[low]), int(values[low])), prints[low:high]
                if i == 0 and new == key:
                    part = np.concatenate((held, part))
                elif key is not None and i == 0:
                    yield from self_flush(key, held, dealt, left, right)
                    dealt = False
                if i == len(starts) - 1:
                    held, key = part, new
                    dealt = dealt and i == 0
                    if len(held) > BUCKET and not finer:
                        yield split(*key, held)
                        held, dealt = held[:0], True
                else:
                    yield from self_flush(new, part, dealt and i == 0, left, right)
                    dealt = False
            if left:
                yield give(left, right)
        if key is not None:
            left, right = [], []
            yield from self_flush(key, held, dealt, left, right)
            if left:
                yield give(left, right)

    def self_flush(key, prints, dealt, left, right) -> Iterator[pa.RecordBatch]:
        if dealt or (len(prints) > BUCKET and not finer):
            if len(prints):
                yield split(*key, prints)
        elif len(prints) > 1:
            a, b = forest(np.unique(prints), radius)
            if len(a):
                left.append(a)
                right.append(b)
    return meet


def fingerprint_links(prints: DataFrame, radius: int, partitions: int) -> DataFrame:
    """a, b: links that join every component of ``prints`` (fp, all different)."""
    masks = covering_masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("table_no", "value"))

    def level(rows: DataFrame, finer: int) -> DataFrame:
        met = rows.repartition(partitions, "table_no", "value").sortWithinPartitions("table_no", "value")
        return met.mapInArrow(tidy(_meet(radius, masks, finer)), LINKS)

    first = stored(level(keyed, 0), "simhash-links")
    again = first.where("b IS NULL").select("table_no", "value", F.col("a").alias("fp"))
    links = first.where("b IS NOT NULL").select("a", "b")
    if not again.isEmpty():
        links = links.unionByName(level(again, 1).where("b IS NOT NULL").select("a", "b"))
    return links.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4,
                    radius: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id, text_key of every row.

    A-Z are lower-cased; words are runs without ASCII white space; a text shorter than a shingle is one shingle; a text
    without words (null and empty ones too) has fingerprint zero and links like any other. ``component_id`` is the
    smallest id reachable by links; rows without an id never name a component, and get null where no row has an id.
    ``text_key`` is a hash of the text as written. Rows that repeat an id are each given. An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    read = ids_and_texts(docs, id_col, text_col).withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    prints = stored(read.mapInArrow(tidy(_fingerprints(size)), "doc_id long, fp long, text_key long"), "simhash-prints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-classes")
    partitions = max(64, partitions_for(spark, classes.count() * len(covering_masks(radius)), 1 << 19))
    links = stored(fingerprint_links(classes.select("fp"), radius, partitions), "simhash-forest")
    nodes = links.select(F.explode(F.array("a", "b")).alias("key"))
    found = stored(components(nodes, links), "simhash-components").select(F.col("key").alias("fp"), "root")
    rooted = classes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = stored(rooted.join(lows, "root").select("fp", "component_id"), "simhash-named")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_key")
