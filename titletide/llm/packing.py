"""Packs token sequences of at most ``capacity`` by best-fit decreasing, with certified numbers of bins.

Texts become ids once; only lengths and checksums go on. The pieces are dealt to groups, each group is packed by
best-fit decreasing, and dual feasible functions give a lower bound on its bins: a group that meets its bound cannot be
packed better by itself. Groups that miss theirs give up all bins that are not full, the others only the bin they opened
last; these pieces are exchanged, dealt to fewer groups, and packed again. That ends when the bound of all pieces that
were exchanged certifies their bins, when one group holds them, or when two draws of groups in a row save no bin.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titletide.llm.common import ids_and_texts, in_slices, tidy
from titletide.llm.pieces import encoder
from titletide.llm.tokens import VOCABULARY
from titletide.session import stored

CAPACITY = 2048
END = 0  # the id that follows every document
GROUP = 8192  # pieces of a group
STALLED = 2  # draws in a row that save nothing, after which the bins stay
PIECE = "doc_id long, text_crc32 long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECE + ", place long, group int, sequence_id long, offset long, free long, given_up boolean"


def _pieces(vocabulary: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, last = encoder(vocabulary), np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            texts = (t or "" for part in in_slices(batch) for t in part.column("text").to_pylist())
            out: list[tuple] = []
            keys = zip(batch.column("doc_id").to_pylist(), batch.column("text_crc32").to_pylist())
            for (doc, crc), ids in zip(keys, pieces.of_each(texts, b"".join)):
                ids = memoryview(ids + last)
                n = len(ids) // 4
                start = 0
                for number in range(-(-n // capacity)):
                    stop = start + ((n - 1) % capacity + 1 if number == 0 else capacity)
                    out.append((doc, crc, number, start, stop - start, zlib.crc32(ids[4 * start:4 * stop])))
                    start = stop
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)],
                                             names=[x.split()[0] for x in PIECE.split(", ")])
        pieces.rest()
    return run


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest of the bounds by dual feasible functions: the plain volume; for every threshold up to half a bin,
    pieces over its complement alone, the others over half a bin apart and the rest by volume; and the step functions
    that round x (k + 1) / capacity down unless it is whole."""
    return bound_of(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of(counts: np.ndarray, capacity: int) -> int:
    """The same from the number of pieces of each length from 0 to ``capacity``."""
    sizes = np.arange(capacity + 1)
    number, volume = np.cumsum(counts), np.cumsum(counts * sizes)
    best = -(-int(volume[-1]) // capacity)
    half = capacity // 2
    low = np.arange(half + 1)  # the threshold
    over = number[-1] - number[capacity - low]
    middle = number[capacity - low] - number[half]
    room = middle * capacity - (volume[capacity - low] - volume[half])
    small = volume[half] - np.where(low > 0, volume[np.maximum(low - 1, 0)], 0)
    best = max(best, int((over + middle + np.maximum(0, -(-(small - room) // capacity))).max()))
    for k in range(1, 21):
        scaled = sizes * (k + 1)
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, its offset, free room of each bin) for lengths in falling order."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    bins, offsets, free = [], [], []
    for length in lengths:
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            place = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, place = capacity, len(free)
            free.append(capacity)
        bins.append(place)
        offsets.append(capacity - room)
        free[place] = left = room - length
        if left:
            open_bins[left].append(place)
            rooms |= 1 << left
    return bins, offsets, free


def _pack(capacity: int, round_no: int):
    """Rows of a group, longest first, get their bins; ``given_up`` says whether a bin's pieces may be exchanged."""
    def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        lengths = rows.column("length").to_numpy()
        bins, offsets, free = best_fit(lengths.tolist(), capacity)
        gap = len(free) - lower_bound(lengths, capacity)
        group = rows.column("group")[0].as_py()
        base = (round_no << 56) + (group << 28)
        places = np.array(bins, dtype=np.int64)
        columns = {name: rows.column(name) for name in rows.schema.names}
        room = np.array(free, dtype=np.int64)[places]
        given_up = (room > 0) & ((gap > 0) | (places == len(free) - 1))
        columns |= {"sequence_id": pa.array(places + base), "offset": pa.array(offsets, pa.int64()), "free": pa.array(room),
                    "given_up": pa.array(given_up)}
        names = [x.split()[0] for x in PLACED.split(", ")]
        return pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            groups = batch.column("group").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
            for low, high in zip(cuts, cuts[1:]):
                if high > low:
                    if groups[low] != now and held:
                        yield done(held)
                        held = []
                    now = groups[low]
                    held.append(batch.slice(low, high - low))
        if held:
            yield done(held)
    return run


def _bound(pieces: DataFrame, capacity: int) -> tuple[int, int]:
    """(number of pieces, lower bound on their bins); no more than ``capacity`` rows of counts come to the driver."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    return int(counts.sum()), bound_of(counts, capacity)


def pack(pieces: DataFrame, capacity: int = CAPACITY, stalled: int = STALLED) -> DataFrame:
    """The pieces, each with a number ``place`` of its own, and their group, sequence_id, offset and free, the room left
    in the sequence. Without a saving the bins of before hold, and the next round draws other groups."""
    columns = [*(x.split()[0] for x in PIECE.split(", ")), "place"]
    settled: list[DataFrame] = []
    pool, used, idle, round_no = pieces, None, 0, 0
    waiting, bound = _bound(pieces, capacity)
    while used is None or (used > bound and idle < stalled):
        groups = max(1, -(-waiting // GROUP))
        draw = F.pmod(F.xxhash64("place", F.lit(round_no)), F.lit(groups)).cast("int")
        met = pool.select(*columns).withColumn("group", draw).repartition(groups, "group").sortWithinPartitions(
            "group", F.desc("length"), "place")
        packed = stored(met.mapInArrow(tidy(_pack(capacity, round_no)), PLACED), "packing-round")
        bins, given_up = packed.agg(F.count_if(F.col("offset") == 0), F.count_if((F.col("offset") == 0) & F.col("given_up"))).first()
        round_no += 1
        if used is None or bins < used:
            if groups == 1:
                return _all([*settled, packed])
            settled.append(packed.where("NOT given_up"))
            pool, used, idle = packed.where("given_up"), given_up, 0
            waiting, bound = _bound(pool, capacity)
        elif groups == 1:
            break
        else:
            idle += 1
    return _all([*settled, pool])


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def packed_sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
                     capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and text_crc32 of every piece.

    A document is its ids and then ``end``, so an empty or null text is one piece of one id. Only documents longer than
    ``capacity`` are cut; their first piece is the short one. Rows that repeat or lack an id are packed each on their
    own. An empty table gives an empty result. ``text_crc32`` tells rows of one id apart.
    """
    read = ids_and_texts(docs, id_col, text_col).select(
        "doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "text")
    cut = read.mapInArrow(tidy(_pieces(vocabulary, capacity, end)), PIECE)
    pieces = stored(cut.withColumn("place", F.monotonically_increasing_id()), "packing-pieces")
    return pack(pieces, capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "text_crc32")
