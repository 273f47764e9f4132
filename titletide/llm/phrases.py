"""Removes passages of words that occur more than once anywhere, by automata of repeated phrases.

Documents are read in blocks. Every window of ``window`` words names the least of its short runs of words by hash, its
seed; consecutive windows with one seed form a segment. Equal windows have equal seeds, so that only windows whose seed
recurs can recur. A seed whose segments are all alike confirms its segments whole; where segments differ the windows
themselves are counted, by two independent sums of 64 bits. The confirmed phrases of a block are compiled to Aho-Corasick
automata, sharded by size, and all its documents are streamed through them: the words that some phrase covers go.

What moves is a tenth of a hash for each word, the windows at the edges of repeats, and the compressed texts twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress, count

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titletide.llm.common import ids_and_texts, partitions_for, tied, untied
from titletide.session import stored

WINDOW = 35
SEED = 12  # words of a seed
BLOCK = 2 << 20  # bytes of text of a block
SHARD = 400_000  # words of the phrases of one automaton
OTHER = 0x10FFFF  # stands for words that no phrase has
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)  # odd, so that powers can be undone
BLOCKS = "block long, size long, body binary, seeds array<long>, segments array<long>, counts array<int>"
KEPT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,length:long>>, kept_text string"


# --- words, seeds and segments of a block ---------------------------------------------------------------------------------

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of a base modulo 2^64, and what undoes them."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 1 << 19)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _POWERS[base] = both[0], both[1]
    return _POWERS[base]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The place of the first least key among the ``width`` that start at each place."""
    values, places, have, done = keys, np.arange(len(keys)), 1, None

    def joined(a, b, shift):
        n = min(len(a[0]), len(b[0]) - shift)
        less = b[0][shift:shift + n] < a[0][:n]
        return np.where(less, b[0][shift:shift + n], a[0][:n]), np.where(less, b[1][shift:shift + n], a[1][:n])

    covered = 0
    while True:
        if width & have:
            done = (values, places) if done is None else joined(done, (values, places), covered)
            covered += have
        if covered == width:
            return done[1]
        values, places = joined((values, places), (values, places), have)
        have *= 2


class Block:
    """The words of some documents as numbers, the sums that tell runs of them apart, and the segments of their windows.

    ``starts`` are the places of all windows; segment i holds the windows ``first[i]`` to ``last[i]`` of them."""

    def __init__(self, texts: list[bytes], window: int):
        self.window = window
        self.words = [t.split() for t in texts]  # bytes are split at 0x20 and 0x09 to 0x0D, and nowhere else
        self.counts = np.array([len(w) for w in self.words], dtype=np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.counts)))
        flat = list(chain.from_iterable(self.words))
        numbers: dict[bytes, int] = {}  # a word's number is its first place
        self.ids = np.fromiter(map(numbers.setdefault, flat, count()), dtype=np.int32, count=len(flat))
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, numbers)), dtype=np.uint64).reshape(-1, 2)
        at = np.fromiter(numbers.values(), dtype=np.int64, count=len(numbers))
        self.sums = []
        for half, base in enumerate(BASES):
            hashes = np.zeros(len(flat), dtype=np.uint64)
            hashes[at] = digests[:, half]
            steps = hashes[self.ids] * _powers(base, len(flat) + 1)[0][:len(flat)]
            self.sums.append(np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(steps, dtype=np.uint64))))
        runs = [np.arange(low, high - window + 1) for low, high in zip(self.offsets.tolist(), self.offsets[1:].tolist()) if high - low >= window]
        self.starts = np.concatenate(runs) if runs else np.zeros(0, dtype=np.int64)
        if not len(self.starts):
            self.first = self.last = np.zeros(0, dtype=np.int64)
            self.seeds = self.segments = np.zeros(0, dtype=np.uint64)
            return
        short = min(SEED, window)
        keys = _mixed(self.runs(0, np.arange(len(flat) - short + 1), short))
        least = _least(keys, window - short + 1)[self.starts]
        cuts = np.flatnonzero(np.diff(least)) + 1
        self.first, self.last = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(least)])) - 1
        low, high = self.starts[self.first], self.starts[self.last]
        shape = ((least[self.first] - low) * window + high - low).astype(np.uint64)  # where the seed lies, and how many windows
        self.seeds = keys[least[self.first]]
        self.segments = _mixed(self.runs(1, low, high - low + window) ^ _mixed(shape))

    def runs(self, which: int, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """A sum of 64 bits of each run of words."""
        sums, undo = self.sums[which], _powers(BASES[which], len(self.ids) + 1)[1]
        return (sums[start + length] - sums[start]) * undo[start]

    def windows_of(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, first sum, second sum) of each window of the chosen segments."""
        sizes = (self.last - self.first + 1)[chosen]
        number = np.repeat(self.first[chosen] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        start = self.starts[number]
        return number, self.runs(0, start, self.window), self.runs(1, start, self.window)

    def phrases(self, confirmed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of each different phrase: consecutive confirmed windows of a segment as one run of words."""
        segment = np.repeat(np.arange(len(self.first)), self.last - self.first + 1)
        number = np.flatnonzero(confirmed)
        new = np.ones(len(number), dtype=bool)
        new[1:] = (np.diff(number) != 1) | (np.diff(segment[number]) != 0)
        at = np.flatnonzero(new)
        start = self.starts[number[at]]
        length = self.starts[number[np.concatenate((at[1:], [len(number)])) - 1]] - start + self.window
        keys = self.runs(0, start, length), self.runs(1, start, length)
        order = np.lexsort((length, *keys))
        apart = np.ones(len(order), dtype=bool)
        apart[1:] = np.logical_or.reduce([np.diff(k[order]) != 0 for k in (*keys, length)])
        return start[order[apart]], length[order[apart]]


# --- automata ---------------------------------------------------------------------------------------------------------

def _spelled(ids: np.ndarray, used: np.ndarray, words: int) -> tuple[str, int]:
    """(text, characters of a word): the words as characters of a small alphabet, so that no state of an automaton has
    many followers. The first character of a word is never one of the others, so nothing matches astride words."""
    width = 1 if len(used) <= 64 else 2 if len(used) <= 1 << 14 else 3
    base = next(b for b in range(1, len(used) + 2) if b ** width >= len(used))
    rank = np.arange(len(used))
    digits = np.stack([rank // base ** (width - 1 - i) % base + (1 if i == 0 else base + 1) for i in range(width)], axis=1)
    table = np.full((words, width), OTHER, dtype="<u4")
    table[used] = digits
    return table[ids].tobytes().decode("utf-32-le"), width


def covered(block: Block, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which words of the block lie in an occurrence of one of the phrases."""
    edges = np.zeros(len(block.ids) + 1, dtype=np.int64)
    shard = np.cumsum(length) // SHARD
    for number in np.unique(shard):
        mine = shard == number
        lows, sizes = start[mine], length[mine]
        places = np.repeat(lows - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        text, width = _spelled(block.ids, np.unique(block.ids[places]), len(block.ids))
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for low, size in zip(lows.tolist(), sizes.tolist()):
            automaton.add_word(text[low * width:(low + size) * width], size)
        automaton.make_automaton()
        ends, found = [], []
        for low, high in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist()):
            if high - low >= block.window:
                for end, size in automaton.iter(text, low * width, high * width):
                    ends.append(end)
                    found.append(size)
        last = np.array(ends, dtype=np.int64) // width
        np.add.at(edges, last + 1 - np.array(found, dtype=np.int64), 1)
        np.add.at(edges, last + 1, -1)
    return np.cumsum(edges[:-1]) > 0


# --- steps over all blocks ----------------------------------------------------------------------------------------------

def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _counted(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of some columns, and how often each comes."""
    order = np.lexsort(keys)
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    at = np.flatnonzero(new)
    return [k[order[at]] for k in keys], np.diff(np.concatenate((at, [len(order)]))).astype(np.int32)


def _among(one: np.ndarray, two: np.ndarray, known_one: np.ndarray, known_two: np.ndarray) -> np.ndarray:
    """Which pairs are among the known ones."""
    if not len(known_one):
        return np.zeros(len(one), dtype=bool)
    order = np.argsort(known_one)
    known_one, known_two = known_one[order], known_two[order]
    if (known_one[1:] == known_one[:-1]).any():
        known = set(zip(known_one.tolist(), known_two.tolist()))
        return np.fromiter((pair in known for pair in zip(one.tolist(), two.tolist())), dtype=bool, count=len(one))
    at = np.minimum(np.searchsorted(known_one, one), len(known_one) - 1)
    return (known_one[at] == one) & (known_two[at] == two)


def _blocks(window: int):
    """Documents become blocks of about ``BLOCK`` bytes, each with its different seeds and segments."""
    def made(number: int, ids: list[int | None], texts: list[bytes]) -> pa.RecordBatch:
        block = Block(texts, window)
        (seeds, segments), counts = _counted(block.seeds, block.segments)
        body = tied(np.array([i or 0 for i in ids], dtype=np.int64), np.array([i is None for i in ids], dtype=np.uint8),
                    np.array([len(t) for t in texts], dtype=np.int64), np.frombuffer(b"".join(texts), dtype=np.uint8))
        columns = [pa.array([number], pa.int64()), pa.array([len(body)], pa.int64()), pa.array([body], pa.binary())]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in (_signed(seeds), _signed(segments), pa.array(counts))]
        return pa.RecordBatch.from_arrays(columns + lists, names=["block", "size", "body", "seeds", "segments", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0
        for batch in batches:
            bodies = pc.fill_null(batch.column("text").cast(pa.binary()), b"").to_pylist()
            for doc, body in zip(batch.column("doc_id").to_pylist(), bodies):
                ids.append(doc)
                texts.append(body)
                held += len(body) + 16
                if held >= BLOCK:
                    yield made(number, ids, texts)
                    number += 1
                    ids, texts, held = [], [], 0
        if ids:
            yield made(number, ids, texts)
    return run


def _opened(body: bytes, window: int) -> tuple[list[int | None], Block]:
    ids, missing, lengths, text = untied(body)
    whole, ends = text.tobytes(), np.cumsum(lengths).tolist()
    texts = [whole[low:high] for low, high in zip([0, *ends], ends)]
    return [None if m else i for i, m in zip(ids.tolist(), missing.tolist())], Block(texts, window)


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list]:
    """One row at a time; lists of longs as arrays, missing ones empty."""
    for batch in batches:
        for i in range(batch.num_rows):
            values = [batch.column(n)[i] for n in names]
            yield [(np.zeros(0, dtype=np.int64) if not v.is_valid else v.values.to_numpy()) if pa.types.is_list(v.type) else v.as_py()
                   for v in values]


def _edges(window: int):
    """The different windows of segments whose seed has unlike segments, and how often the block has each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, body, unlike in _rows(batches, ["block", "body", "unlike"]):
            _, block = _opened(body, window)
            _, one, two = block.windows_of(np.isin(block.seeds.view(np.int64), unlike))
            (one, two), counts = _counted(one, two)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in (_signed(one), _signed(two), pa.array(counts))]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists], names=["block", "one", "two", "counts"])
    return run


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for body, alike, unlike, one, two in _rows(batches, ["body", "alike", "unlike", "one", "two"]):
            ids, block = _opened(body, window)
            seeds = block.seeds.view(np.int64)
            confirmed = np.repeat(np.isin(seeds, alike), block.last - block.first + 1)
            number, first, second = block.windows_of(np.isin(seeds, unlike))
            confirmed[number] = _among(first.view(np.int64), second.view(np.int64), one, two)
            gone = covered(block, *block.phrases(confirmed)) if confirmed.any() else np.zeros(len(block.ids), dtype=bool)
            edges = np.concatenate(([0], np.cumsum(gone)))
            removed = edges[block.offsets[1:]] - edges[block.offsets[:-1]]
            spans, texts = [], []
            for words, low, lost in zip(block.words, block.offsets.tolist(), removed.tolist()):
                mine = gone[low:low + len(words)]
                texts.append(b" ".join(words if not lost else compress(words, (~mine).tolist())))
                turns = np.flatnonzero(np.diff(np.concatenate(([0], mine.astype(np.int8), [0])))).tolist() if lost else []
                spans.append([{"start": a, "length": b - a} for a, b in zip(turns[::2], turns[1::2])])
            kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(block.counts), pa.array(removed.astype(np.int64)), pa.array(spans, kinds), pa.array(texts, pa.string())],
                names=["doc_id", "n_words", "n_removed", "spans", "kept_text"])
    return run


def without_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, spans and kept_text of every row.

    Words are runs of characters other than 0x20 and 0x09 to 0x0D, as they are; ``spans`` are the removed runs of words,
    ``kept_text`` the other words with one space between them. A window goes wherever its words start a second time, in
    another row or in the same one, so both of two equal documents lose all their words if they have ``window`` of them;
    every row is a document of its own, whether or not it repeats or lacks an id. Null counts as empty; documents with
    fewer words lose none; an empty table gives an empty result. A document has to fit a worker.
    """
    spark = docs.sparkSession
    blocks = stored(ids_and_texts(docs, id_col, text_col).mapInArrow(_blocks(window), BLOCKS), "phrases-blocks")
    size = blocks.agg(F.sum("size")).first()[0] or 0
    parts = partitions_for(spark, size, 16 << 20)
    seeds = blocks.select("block", F.explode(F.arrays_zip("seeds", "segments", "counts")).alias("s")).select(
        "block", F.col("s.seeds").alias("seed"), F.col("s.segments").alias("segment"), F.col("s.counts").alias("n"))
    recurring = seeds.groupBy("seed").agg(F.sum("n").alias("n"), F.min("segment").alias("low"), F.max("segment").alias("high")).where(
        "n > 1").select("seed", (F.col("low") != F.col("high")).alias("unlike"))
    found = seeds.select("block", "seed").join(recurring, "seed").groupBy("block").agg(
        _listed(F.when(~F.col("unlike"), F.col("seed"))).alias("alike"), _listed(F.when(F.col("unlike"), F.col("seed"))).alias("unlike"))
    found = stored(found, "phrases-seeds")  # a row for each block, no larger than the block
    bodies = blocks.select("block", "body")
    unsure = bodies.join(found.where(F.size("unlike") > 0).select("block", "unlike"), "block").repartition(parts, "block")
    edges = stored(unsure.mapInArrow(_edges(window), "block long, one array<long>, two array<long>, counts array<int>"), "phrases-edges")
    windows = edges.select("block", F.explode(F.arrays_zip("one", "two", "counts")).alias("w")).select(
        "block", F.col("w.one").alias("one"), F.col("w.two").alias("two"), F.col("w.counts").alias("n"))
    confirmed = windows.groupBy("one", "two").agg(F.sum("n").alias("n")).where("n > 1").select("one", "two")
    again = windows.select("block", "one", "two").join(confirmed, ["one", "two"]).groupBy("block").agg(
        F.collect_list(F.struct("one", "two")).alias("pairs")).select("block", F.col("pairs.one").alias("one"), F.col("pairs.two").alias("two"))
    whole = bodies.repartition(parts, "block").join(found, "block", "left").join(again, "block", "left")
    return whole.select("body", "alike", "unlike", "one", "two").mapInArrow(_kept(window), KEPT)


def _listed(value: Column) -> Column:
    return F.array_distinct(F.collect_list(value))
