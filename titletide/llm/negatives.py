"""Hard negatives for anchors, by exact integer scores.

A stated set of anchors is compared with all rows in blocks. Scores are inner products of integers and must be exact, so
each block product runs in a residue number system: float32 products modulo a few small primes, whose sums no float32
rounds, give the score's residues, and Chinese remaindering with signed digits gives the score itself. A first pass over
the blocks keeps each anchor's best rows of its own label, a second the best rows of other labels inside the window that
each of them opens. Every task keeps only its running best, so that what it sends on does not grow with its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titletide.llm.common import tied, untied
from titletide.session import stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH, WHOLE = 50, 95, 100  # LOW p <= WHOLE n <= HIGH p
ANCHORS = 4096  # of a block
ROWS = 1024  # of a message, and of a product
SPREAD = 2048  # rows of a group of rows, at least
STRIPE = 64  # dimensions that are summed before residues are taken
LIMIT = 1 << 56  # scores beyond it are refused
PAIR = "anchor long, anchor_id long, place long, other_id long, score long, positive long"


@lru_cache(maxsize=1)
def primes() -> list[int]:
    """The primes, falling, whose signed residues' products over a stripe stay below 2^24."""
    largest = next(p for p in range(4096, 2, -1) if STRIPE * (p // 2) ** 2 < 1 << 24)
    sieve = np.ones(largest + 1, dtype=bool)
    sieve[:2] = False
    for i in range(2, int(largest ** 0.5) + 1):
        sieve[i * i::i] &= not sieve[i]
    return np.flatnonzero(sieve)[::-1].tolist()


def _modulo(values: np.ndarray, prime: int) -> np.ndarray:
    """Signed residues of float32 integers below 2^24."""
    values -= prime * np.rint(values * np.float32(1 / prime))
    return values


def residues(matrix: np.ndarray, prime: int) -> np.ndarray:
    """Signed residues of a matrix of integers, as float32."""
    rest = matrix % prime
    return np.where(rest > prime // 2, rest - prime, rest).astype(np.float32)


class Residues:
    """A matrix of integers by its residues modulo as many primes as scores up to ``bound`` need."""

    def __init__(self, matrix: np.ndarray, bound: int):
        if bound >= LIMIT:
            raise OverflowError(f"scores may reach {bound}; components times {SCALE} must keep them below {LIMIT}")
        self.primes, product = [], 1
        for prime in primes():
            if product > 2 * bound + 1:
                break
            self.primes.append(prime)
            product *= prime
        self.parts = [residues(matrix, p) for p in self.primes]

    def scores(self, other: Residues) -> np.ndarray:
        """The exact products of all rows with all rows of the other, as int64."""
        score, base, digits = None, 1, []
        for prime, mine, its in zip(self.primes, self.parts, other.parts):
            rest = None
            for at in range(0, mine.shape[1], STRIPE):
                part = _modulo(mine[:, at:at + STRIPE] @ its[:, at:at + STRIPE].T, prime)
                rest = part if rest is None else _modulo(rest + part, prime)
            # The digit of this prime in mixed radix: what the residue lacks of the digits before it, over their primes.
            known, weight = np.float32(0), 1
            for digit, earlier in digits:
                known = _modulo(known + _modulo(digit * np.float32(_signed(weight, prime)), prime), prime)
                weight = weight * earlier % prime
            digit = _modulo(_modulo(rest - known, prime) * np.float32(_signed(pow(weight, -1, prime), prime)), prime)
            digits.append((digit, prime))
            score = digit.astype(np.int64) if score is None else score + digit.astype(np.int64) * base
            base *= prime
        return score


def _signed(value: int, prime: int) -> int:
    value %= prime
    return value - prime if value > prime // 2 else value


def largest_score(a: np.ndarray, b: np.ndarray) -> int:
    """A bound of all products of rows of ``a`` with rows of ``b``."""
    sums = max((sum(map(abs, row)) for row in a.tolist()), default=0) if _huge(a) else int(np.abs(a).sum(axis=1).max(initial=0))
    return sums * max(abs(int(b.max(initial=0))), abs(int(b.min(initial=0))))


def _huge(a: np.ndarray) -> bool:
    return bool((np.abs(a.astype(np.float64)) > 2.0 ** 40).any())


# --- running best -----------------------------------------------------------------------------------------------------

def best_of(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, whether they count) of each row's k best allowed scores; of equal scores the first column wins."""
    width = scores.shape[1]
    k = min(k, width)
    order = scores * width + np.arange(width - 1, -1, -1)  # scores stay below LIMIT / width
    order[~allowed] = np.iinfo(np.int64).min
    top = np.argpartition(order, width - k, axis=1)[:, width - k:]
    return top, np.take_along_axis(allowed, top, axis=1)


class Best:
    """The k best (score, id, place) of each of n rows, over all blocks so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.zeros((n, 0), dtype=np.int64)
        self.id, self.place, self.counts = self.score.copy(), self.score.copy(), np.zeros((n, 0), dtype=bool)

    def offer(self, score: np.ndarray, ids: np.ndarray, places: np.ndarray, counts: np.ndarray) -> None:
        score, ids = np.concatenate((self.score, score), axis=1), np.concatenate((self.id, ids), axis=1)
        places, counts = np.concatenate((self.place, places), axis=1), np.concatenate((self.counts, counts), axis=1)
        order = np.lexsort((places, ids, -score, ~counts), axis=1)[:, :self.k]
        self.score, self.id, self.place, self.counts = (
            np.take_along_axis(x, order, axis=1) for x in (score, ids, places, counts))


NO_ID = np.iinfo(np.int64).max  # stands for a missing id, the last of all


class Block:
    """The anchors of one block, and with a second pass their positives: (place, score) of up to ``POSITIVES``."""

    def __init__(self, messages: list[bytes], dimensions: int, windows: bool):
        parts = [np.concatenate(p) for p in zip(*(untied(m) for m in messages))]
        self.ids, self.place, self.label, x = parts[:4]
        self.matrix = x.reshape(-1, dimensions)
        self.windows = [p.reshape(-1, POSITIVES) for p in parts[4:]] if windows else None
        n = len(self.ids)
        self.best = [Best(n, NEGATIVES) for _ in range(POSITIVES)] if windows else [Best(n, POSITIVES)]
        self.known: tuple[int, Residues] | None = None

    def meet(self, message: bytes) -> None:
        ids, place, label, x = untied(message)
        order = np.lexsort((place, ids))
        ids, place, label, x = ids[order], place[order], label[order], x.reshape(-1, self.matrix.shape[1])[order]
        if not len(self.ids) or not len(ids):
            return
        bound = largest_score(x, self.matrix)
        if bound * len(ids) >= LIMIT:
            raise OverflowError(f"scores may reach {bound}; components times {SCALE} must keep them below {LIMIT // len(ids)}")
        if self.known is None or self.known[0] < bound:
            self.known = bound, Residues(self.matrix, bound)
        scores = self.known[1].scores(Residues(x, self.known[0]))
        same = self.label[:, None] == label[None]
        if self.windows is None:
            self._offer(self.best[0], scores, same & (self.place[:, None] != place[None]), POSITIVES, ids, place)
            return
        for best, low, high in zip(self.best, self.windows[0].T, self.windows[1].T):
            self._offer(best, scores, ~same & (scores >= low[:, None]) & (scores <= high[:, None]), NEGATIVES, ids, place)

    @staticmethod
    def _offer(best: Best, scores: np.ndarray, allowed: np.ndarray, k: int, ids: np.ndarray, place: np.ndarray) -> None:
        top, counts = best_of(scores, allowed, k)
        best.offer(np.take_along_axis(scores, top, axis=1), ids[top], place[top], counts)

    def rows(self) -> pa.RecordBatch:
        columns: list[list[np.ndarray]] = [[] for _ in range(6)]
        for number, best in enumerate(self.best):
            row, at = np.nonzero(best.counts)
            for column, values in zip(columns, (self.place[row], self.ids[row], best.place[row, at], best.id[row, at],
                                                best.score[row, at], np.full(len(row), number + 1, dtype=np.int64))):
                column.append(values)
        arrays = [np.concatenate(c) for c in columns]
        masks = [None, None, None, arrays[3] == NO_ID, None, None]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64(), mask=m) for a, m in zip(arrays, masks)],
                                          names=[x.split()[0] for x in PAIR.split(", ")])


def _meet(dimensions: int, windows: bool):
    """Messages of a unit arrive together, anchors first; rows are met one message at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, anchors, block = None, [], None
        for batch in batches:
            for unit, kind, body in zip(*(batch.column(n).to_pylist() for n in ("unit", "kind", "body"))):
                if unit != now:
                    if block is not None:
                        yield block.rows()
                    now, anchors, block = unit, [], None
                if kind == 0:
                    anchors.append(body)
                elif anchors:
                    block = block or Block(anchors, dimensions, windows)
                    block.meet(body)
        if block is not None:
            yield block.rows()
    return run


# --- tables -----------------------------------------------------------------------------------------------------------

def _packed(extra: int):
    """Rows become messages of at most ``ROWS`` of one group: ids, places, labels, components and further columns."""
    def sent(group: int, rows: pa.Table) -> tuple[int, bytes]:
        ids = rows.column("vec_id").fill_null(NO_ID).to_numpy()
        flat = [pa.chunked_array(rows.column(n)).combine_chunks().flatten().to_numpy(zero_copy_only=False)
                for n in ("x", *(("low", "high") if extra else ()))]
        return group, tied(ids, rows.column("place").to_numpy(), rows.column("label").to_numpy(), *flat, level=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        out: list[tuple[int, bytes]] = []
        for batch in batches:
            groups = batch.column("group").to_numpy()
            order = np.argsort(groups, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(groups[order])) + 1).tolist(), len(groups)]
            for low, high in zip(cuts, cuts[1:]):
                if high > low:
                    mine = held.setdefault(int(groups[order[low]]), [])
                    mine.append(batch.take(pa.array(order[low:high])))
                    if sum(b.num_rows for b in mine) >= ROWS:
                        table = pa.Table.from_batches(held.pop(int(groups[order[low]])))
                        out += [sent(int(groups[order[low]]), table.slice(at, ROWS)) for at in range(0, table.num_rows, ROWS)]
            if len(out) >= 16:
                yield _messages(out)
                out = []
        out += [sent(g, pa.Table.from_batches(parts).slice(at, ROWS)) for g, parts in held.items()
                for at in range(0, sum(b.num_rows for b in parts), ROWS)]
        if out:
            yield _messages(out)
    return run


def _messages(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                                      names=["group", "body"])


def _first(rows: DataFrame, key: list[str], k: int) -> DataFrame:
    """The k first rows of each key by score, id and place, numbered from 1."""
    order = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("other_id"), "place")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _one_length(rows: DataFrame, dimensions: int, modulus: int) -> DataFrame:
    spark = rows.sparkSession
    mine = rows.where(F.size("x") == dimensions)
    anchors = mine.where(F.col("vec_id") % modulus == 0)
    n, n_anchors = mine.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % modulus == 0)).first()
    blocks = max(1, -(-n_anchors // ANCHORS))
    wide = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, min(-(-n // SPREAD), -(-wide // blocks)))
    units = blocks * groups

    def dealt(table: DataFrame, count: int) -> DataFrame:
        return table.withColumn("group", F.pmod(F.xxhash64("place"), F.lit(count)).cast("int"))

    sent = stored(dealt(mine, groups).mapInArrow(_packed(0), "group int, body binary"), "negatives-rows")
    to_all_blocks = sent.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b * groups + F.col("group"))).alias("unit"),
                                F.lit(1).alias("kind"), "body")

    def met(some: DataFrame, windows: bool) -> DataFrame:
        placed = dealt(some, blocks).repartition(blocks, "group").mapInArrow(_packed(2 * windows), "group int, body binary")
        to_all_groups = placed.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.col("group") * groups + g)).alias("unit"),
                                      F.lit(0).alias("kind"), "body")
        both = to_all_groups.unionByName(to_all_blocks).repartition(units, "unit").sortWithinPartitions("unit", "kind")
        return both.mapInArrow(_meet(dimensions, windows), PAIR)

    positives = stored(_first(met(anchors, False), ["anchor"], POSITIVES).select(
        "anchor", "rank", F.col("place").alias("positive_place"), F.col("other_id").alias("positive_id"),
        F.col("score").alias("positive_score")), "negatives-positives")
    windows = positives.groupBy(F.col("anchor").alias("place")).agg(F.map_from_entries(F.collect_list(F.struct(
        "rank", F.struct(_least("positive_score").alias("low"), _most("positive_score").alias("high"))))).alias("windows"))
    numbers = range(1, POSITIVES + 1)  # a window from 1 to 0 is none
    limits = [F.array(*(F.coalesce(F.try_element_at("windows", F.lit(i))[side], F.lit(none).cast("long")) for i in numbers)).alias(side)
              for side, none in (("low", 1), ("high", 0))]
    chosen = anchors.join(windows, "place").select(*anchors.columns, *limits)
    found = _first(met(chosen, True), ["anchor", "positive"], NEGATIVES)
    return found.join(positives.withColumnRenamed("rank", "positive"), ["anchor", "positive"]).select(
        F.col("anchor_id"), "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def _least(score: str) -> Column:
    """The least whole n with LOW score <= WHOLE n."""
    return F.expr(f"-((-({LOW} * {score})) div {WHOLE}) + IF(({LOW} * {score}) % {WHOLE} > 0, 1, 0)").cast("long")


def _most(score: str) -> Column:
    """The largest whole n with WHOLE n <= HIGH score."""
    return F.expr(f"({HIGH} * {score}) div {WHOLE} - IF(({HIGH} * {score}) % {WHOLE} < 0, 1, 0)").cast("long")


def hard_negatives(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   scale: int = SCALE, anchors_at: int = 50, shifted_at: int = 7, labels: int = 10) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows without a label or a vector, or with a component that is null, not finite or, times the scale, beyond 2^62, take
    no part. Vectors meet only those of their own length; empty ones meet nothing. Anchors are the rows whose id is
    divisible by ``anchors_at``; a row without an id is no anchor, but may be a positive or negative, after all rows of
    its score that have one. Rows that repeat an id are rows of their own, equal in rank up to their place in the table.
    A positive below zero opens no window, one of zero the window of zero alone. Scores beyond about 2^46 are refused
    with an error, as they may not fit. An empty table gives an empty result. ``shifted_at``: rows whose id is divisible
    by it first get the label (label + 1) % ``labels``.
    """
    vector = F.col(vector_col).cast("array<double>")
    read = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), vector.alias("vector"))
    bad = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > 2.0 ** 62 / scale))
    fine = F.coalesce((F.size("vector") > 0) & ~bad & F.col("label").isNotNull(), F.lit(False))
    shifted = F.when(F.col("vec_id") % shifted_at == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    steps = F.transform("vector", lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    rows = stored(read.where(fine).select("vec_id", shifted.alias("label"), steps.alias("x"),
                                          F.monotonically_increasing_id().alias("place")), "negatives-read")
    out = None
    for (dimensions,) in rows.select(F.size("x")).distinct().collect():  # a row for each length of vectors
        part = _one_length(rows, dimensions, anchors_at)
        out = part if out is None else out.unionByName(part)
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return table.sparkSession.createDataFrame([], empty) if out is None else out
