"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Rotations are learned so that the signs of the rotated vectors make balanced codes. Each code is cut into parts, and
every part is the key of one table: vectors at a small angle agree on at least one part. How often they do depends on
the data, as signs are taken from the mean: it is measured with partners made for sampled vectors, and codes are added
until enough of them share a key. What meets in a bucket is compared with the vectors themselves, in double precision,
and a bucket gives a spanning forest of its links. The forests make components, and inside its component every
vector's links are counted with the vectors again.

Buckets and components above ``TILE`` vectors are cut into tiles, and each pair of tiles is a group of its own, so no
task holds more than two tiles. Equal vectors go through all this as one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titletide.llm.common import partitions_for
from titletide.operators.titles import components
from titletide.session import stored

THRESHOLD = 0.9
RECALL = 0.95  # aimed at for pairs right at the threshold
BITS = 64  # of a code, at most
SAMPLE = 8192  # vectors that the rotations are learned from, at most
TURNS = 40  # steps of a rotation's learning
TILE = 4096
PARTNERS = 2048  # more sampled vectors, which rotations are not learned from, that get partners at the threshold, at most
LEAST_BITS = 4  # of a key
ROW = 2000  # what sending a vector to one table costs, in comparisons of two vectors
FREE = 200_000  # comparisons a vector that keys may cost before all pairs are thought of



def table_plan(vectors: int, dimensions: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int, int]:
    """(bits of a key, keys of a code, codes) for vectors without a common direction: keys long enough that unlike vectors
    rarely meet, and as many as it takes for a pair at the threshold to agree on one of them with probability ``recall``.
    ``measured_plan`` makes no such assumption."""
    width = min(dimensions, BITS)
    bits = max(1, min(width, 24, max(8, math.ceil(math.log2(max(vectors, 2))) - 3)))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    tables = math.ceil(math.log(1 - recall) / math.log(1 - same)) if same < 1 else 1
    return bits, width // bits, -(-tables // (width // bits))


def _rotations(sample: np.ndarray, seed: int = 3) -> tuple[np.ndarray, Iterator[np.ndarray]]:
    """(centre, projections without end), as ``learn_rotations`` gives them."""
    centre = sample.mean(axis=0)
    moved = sample - centre
    width = min(sample.shape[1], BITS)
    _, directions = np.linalg.eigh(moved.T @ moved)
    main = directions[:, ::-1][:, :width]
    values = moved @ main
    draw = np.random.Generator(np.random.PCG64(seed))

    def learn() -> Iterator[np.ndarray]:
        while True:
            turn, _ = np.linalg.qr(draw.normal(size=(width, width)))
            for _ in range(TURNS):
                signs = np.where(values @ turn >= 0, 1.0, -1.0)
                left, _, right = np.linalg.svd(values.T @ signs)
                turn = left @ right
            yield main @ turn
    return centre, learn()


def learn_rotations(sample: np.ndarray, codes: int, seed: int = 3) -> tuple[np.ndarray, list[np.ndarray]]:
    """(centre, projections): principal directions of unit vectors, each time turned by a rotation that brings the signs
    as close to the values as it can, from another random start."""
    centre, learned = _rotations(sample, seed)
    return centre, list(islice(learned, codes))


def partners(some: np.ndarray, sample: np.ndarray, threshold: float, seed: int = 5) -> list[np.ndarray]:
    """Two unit vectors at the threshold for each of ``some``: one to any side, one to a side to which the data vary."""
    draw = np.random.Generator(np.random.PCG64(seed))
    sides = (draw.normal(size=some.shape), sample[draw.integers(len(sample), size=len(some))]
             - sample[draw.integers(len(sample), size=len(some))])
    out = []
    for side in sides:
        side = side - (some * side).sum(axis=1, keepdims=True) * some
        size = np.linalg.norm(side, axis=1, keepdims=True)
        fine = size[:, 0] > 1e-6  # none to a side along the vector, as of two equal samples, or in one dimension
        if fine.any():
            made = some.copy()
            made[fine] = threshold * some[fine] + math.sqrt(1 - threshold * threshold) * side[fine] / size[fine]
            made[~fine] = np.nan
            out.append(made)
    return out


def measured_plan(vectors: int, sample: np.ndarray, threshold: float = THRESHOLD,
                  recall: float = RECALL) -> tuple[int, int, np.ndarray, list[np.ndarray]]:
    """(bits of a key, keys of a code, centre, projections): codes are learned until, of sampled vectors and partners made
    for them at the threshold, the share ``recall`` agrees on a key, two standard errors on the safe side. Rotations push
    the vectors they are learned from away from zero, so others are sampled for this.

    Every length of keys is followed at once, and the one that costs least by what sampled vectors meet in its buckets is
    taken; a length that cannot cost least any more is left. Where keys would cost more than all pairs, as with vectors
    that differ less from each other than a pair at the threshold, the key has no bits: every vector meets every other.
    """
    held = min(PARTNERS, len(sample) // 4)
    some, taught = (sample[:held], sample[held:]) if held > 8 else (sample, sample)
    centre, learned = _rotations(taught)
    width = min(sample.shape[1], BITS)
    made = partners(some, sample, threshold)
    if not made:  # one dimension: a vector has no other direction but the opposite
        return 0, 1, centre, [next(learned)]
    lengths = range(min(LEAST_BITS, width), min(24, width) + 1)
    met = {bits: [np.zeros(len(some), dtype=bool) for _ in made] for bits in lengths}
    shared, meets = dict.fromkeys(lengths, 0.0), max(len(some) * (len(some) - 1), 1)
    best = max(vectors + ROW * -(-vectors // TILE), FREE), 0, 0
    projections: list[np.ndarray] = []
    while met:
        projections.append(next(learned))
        codes = len(projections)
        own, *others = ((rows - centre) @ projections[-1] >= 0 for rows in (some, *made))
        for bits in list(met):
            weights = 1 << np.arange(bits, dtype=np.int64)
            for i in range(width // bits):
                part = slice(i * bits, (i + 1) * bits)
                for seen, theirs in zip(met[bits], others):
                    seen |= (own[:, part] == theirs[:, part]).all(axis=1)
                sizes = np.unique(own[:, part] @ weights, return_counts=True)[1]
                shared[bits] += float((sizes * (sizes - 1)).sum()) / meets
            cost = ROW * codes * (width // bits) + vectors * shared[bits]
            shares = [(seen[fine].mean(), fine.sum()) for seen, rows in zip(met[bits], made) if (fine := ~np.isnan(rows[:, 0])).any()]
            if all(share - 2 * math.sqrt(share * (1 - share) / n) >= recall for share, n in shares):
                best = min(best, (cost, bits, codes))
                del met[bits]
            else:
                missed = 1 - min(min(share for share, _ in shares), 1 - 1e-9)
                wanted = max(1.0, math.log(1 - recall) / math.log(missed)) if missed < 1 else math.inf
                if cost * (wanted if codes >= 5 else 1) >= best[0]:
                    del met[bits]
    _, bits, codes = best
    return (bits, width // bits, centre, projections[:codes]) if bits else (0, 1, centre, projections[:1])


def _unit(packed: pa.Array, kind: str) -> np.ndarray:
    """The vectors of a column of equal binaries, at length one. They are scaled first, so no square leaves the range."""
    rows = np.frombuffer(b"".join(x.as_py() for x in packed), dtype=kind).astype(np.float64).reshape(len(packed), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _codes(centre: np.ndarray, projections: list[np.ndarray], bits: int, parts: int, kind: str):
    weights = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            moved = _unit(batch.column("body"), kind) - centre
            keys = [((moved @ p)[:, i * bits:(i + 1) * bits] >= 0) @ weights for p in projections for i in range(parts)]
            flat = pa.array(np.stack(keys, axis=1).ravel().astype(np.int64))
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(keys))
            yield pa.RecordBatch.from_arrays(
                [batch.column("class"), batch.column("body"), pa.ListArray.from_arrays(offsets, flat)],
                names=["class", "body", "keys"])
    return run


def _linked(rows: np.ndarray, threshold: float) -> np.ndarray:
    """Places of the vectors that have a link at all."""
    found = np.zeros(len(rows), dtype=bool)
    for low in range(0, len(rows), 512):
        near = rows[low:low + 512] @ rows[low:].T >= threshold - 1e-9  # the forest decides; products may round otherwise
        near[np.arange(len(near)), np.arange(len(near))] = False
        found[low:low + 512] |= near.any(axis=1)
        found[low:] |= near.any(axis=0)
    return np.flatnonzero(found)


def vector_forest(ids: np.ndarray, rows: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links that join whatever is linked, one fewer than members for each component."""
    links, rest = [], _linked(rows, threshold)
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            some, front = front[:256], front[256:]
            near = rows[some] @ rows[rest].T >= threshold
            met = near.any(axis=0)
            if met.any():
                by = some[near[:, met].argmax(axis=0)]
                links += zip(ids[by].tolist(), ids[rest[met]].tolist())
                front = np.concatenate((front, rest[met]))
                rest = rest[~met]
    return links


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Stretches of rows with the same ``unit``, which arrive in order."""
    held, now = [], None
    for batch in batches:
        units = batch.column("unit").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(units)) + 1).tolist(), len(units)]
        for low, high in zip(cuts, cuts[1:]):
            if high <= low:
                continue
            if held and units[low] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = units[low]
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def _by_key(group: pa.Table) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Units are hashes; the rows of one are told apart by their whole key."""
    keys = np.stack([group.column(n).to_numpy() for n in ("part", "key", "low", "high")], axis=1)
    if (keys == keys[0]).all():
        yield keys[0], group
        return
    _, which = np.unique(keys, axis=0, return_inverse=True)
    for i in range(which.max() + 1):
        yield keys[np.flatnonzero(which == i)[0]], group.filter(pa.array(which == i))


def _links(threshold: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in _groups(batches):
            if group.num_rows < 2:
                continue
            for _, rows in _by_key(group):
                if rows.num_rows > 1:
                    out += vector_forest(rows.column("class").to_numpy(), _unit(rows.column("body"), kind), threshold)
            if len(out) > 10_000:
                yield _pairs(out)
                out = []
        if out:
            yield _pairs(out)
    return run


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())],
                                      names=["a", "b"])


def _counts(threshold: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            for key, rows in _by_key(group):
                ids, copies = rows.column("class").to_numpy(), rows.column("copies").to_numpy()
                vectors, tile = _unit(rows.column("body"), kind), rows.column("tile").to_numpy()
                found = np.zeros(len(ids), dtype=np.int64)
                own = key[2] == key[3]
                for low in range(0, len(ids), 512):
                    near = vectors[low:low + 512] @ vectors.T >= threshold
                    if own:  # every pair but a vector with itself
                        near[np.arange(len(near)), low + np.arange(len(near))] = False
                    else:
                        near &= tile[low:low + 512, None] != tile[None]
                    found[low:low + 512] = near @ copies
                yield _pairs(list(zip(ids.tolist(), found.tolist())))
    return run


def _tiled(rows: DataFrame, columns: list[str], partitions: int) -> DataFrame:
    """Rows of (part, key) dealt to pairs of tiles: one pair for a group that fits a tile, else all pairs of its tiles.
    ``unit`` is what a task takes together."""
    sizes = rows.groupBy("part", "key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > TILE)
    tiles = F.ceil(F.coalesce("members", F.lit(1)) / F.lit(TILE)).cast("int")
    dealt = rows.join(sizes, ["part", "key"], "left").withColumn("tiles", tiles).withColumn(
        "tile", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "part", "key", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", *columns)
    met = pairs.withColumn("unit", F.xxhash64("part", "key", "low", "high"))
    return met.repartition(partitions, "unit").sortWithinPartitions("unit")


def _one_length(classes: DataFrame, dimensions: int, kind: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(links, classes with their packed vectors) of the vectors of one length."""
    spark = classes.sparkSession
    size = 4 if kind == "<f4" else 8
    packed = stored(classes.where(F.size("vector") == dimensions).select("class", "copies", "low_id", "vector").mapInArrow(
        _pack(kind), "class long, copies long, low_id long, body binary"), "itq-vectors")
    n = packed.count()
    sample = packed.select("class", "body").orderBy(F.xxhash64("body"), "class").limit(SAMPLE + PARTNERS).select("body").toArrow().column("body")
    bits, parts, centre, projections = measured_plan(n, _unit(sample.combine_chunks(), kind), threshold)
    coded = stored(packed.select("class", "body").mapInArrow(
        _codes(centre, projections, bits, parts, kind), "class long, body binary, keys array<long>"), "itq-codes")
    keyed = coded.select("class", "body", F.posexplode("keys").alias("part", "key"))
    copies = parts * len(projections) if bits else -(-n // TILE)  # of a vector
    partitions = max(64, partitions_for(spark, n * copies * (size * dimensions + 40), 16 << 20))
    links = _tiled(keyed, ["class", "body"], partitions).mapInArrow(_links(threshold, kind), "a long, b long")
    return stored(links.distinct(), "itq-links"), packed


def _pack(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(batch.num_rows, -1)
            body = pa.array([r.tobytes() for r in flat], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("copies"), batch.column("low_id"), body],
                                             names=["class", "copies", "low_id", "body"])
    return run


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do vectors of
    different lengths. Rotations are learned on at most ``SAMPLE`` vectors, drawn by hash; every vector is in the tables.
    Equal vectors link with each other. Rows that repeat an id count as vectors of their own; rows without an id never
    name a component. An empty table gives an empty result.
    """
    read = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    kind = "<f4" if dict(read.dtypes)["vector"] == "array<float>" else "<f8"
    if kind == "<f8":
        read = read.withColumn("vector", F.col("vector").cast("array<double>"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.coalesce((F.size("vector") > 0) & ~bad & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = stored(read.withColumn("fine", fine), "itq-rows")
    good = rows.where("fine")
    classes = stored(good.groupBy("vector").agg(F.min("vec_id").alias("low_id"), F.count(F.lit(1)).alias("copies"))
                     .withColumn("class", F.monotonically_increasing_id()), "itq-classes")
    named = None
    for (dimensions,) in classes.select(F.size("vector")).distinct().collect():  # a row for each length of vectors
        links, packed = _one_length(classes, dimensions, kind, threshold)
        nodes = links.select(F.explode(F.array("a", "b")).alias("key"))
        found = stored(components(nodes, links), "itq-components").select(F.col("key").alias("class"), F.col("root").alias("key"))
        members = packed.join(found, "class").withColumn("part", F.lit(0))
        partitions = max(64, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        counted = _tiled(members, ["class", "body", "copies"], partitions).mapInArrow(_counts(threshold, kind), "a long, b long")
        others = counted.groupBy(F.col("a").alias("class")).agg(F.sum("b").alias("others"))
        lows = members.groupBy("key").agg(F.min("low_id").alias("component_id"))
        part = packed.select("class", "copies", "low_id").join(found, "class", "left").join(lows, "key", "left").join(
            others, "class", "left").select("class", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                                            F.when(F.col("key").isNull(), F.col("low_id")).otherwise(F.col("component_id")).alias("component_id"))
        named = part if named is None else named.unionByName(part)
    alone = rows.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if named is None:
        out = alone
    else:

        answers = stored(classes.select("class", "vector").join(named, "class"), "itq-answers")
        out = good.select("vec_id", "vector").join(answers, "vector").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
