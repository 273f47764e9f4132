"""Document quality from a byte-level convolutional network, written in numpy.

Each position of a text gives, besides its bytes, one bit of input: whether its four bytes stood there shortly before.
Learned filters run over the bytes; their rectified answers are averaged over overlapping chunks that cover the whole
document; a hidden layer weighs the averages of each chunk; the strongest answer of every hidden unit anywhere in the
document is kept, and these are combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titletide.llm.common import crc_of, ids_and_texts

WIDTH = 6  # bytes under a filter
STRIDE = 2
FILTERS = 16
HIDDEN = 12
BLOCK = 64  # bytes; a chunk is two neighbouring blocks, so chunks overlap by half
ECHO = 32  # bytes that the recurrence bit looks back
GROUP = 1 << 18  # bytes of documents that are scored together
SAMPLE = 1500  # documents of either label that the network learns from, at most
LONGEST = 1 << 15  # bytes of a document that is learned from, at most
PASSES = 14
LIKELY = 0.7


class Packed:
    """Documents laid out in blocks, one after the other, each followed by zero bytes."""

    def __init__(self, bodies: list[bytes]):
        lengths = np.array([len(b) for b in bodies], dtype=np.int64)
        blocks = (lengths + WIDTH) // BLOCK + 1
        self.first = np.concatenate(([0], np.cumsum(blocks)))
        self.data = np.zeros(int(self.first[-1]) * BLOCK + ECHO + WIDTH, dtype=np.uint8)
        for body, at in zip(bodies, (self.first[:-1] * BLOCK).tolist()):
            self.data[at:at + len(body)] = np.frombuffer(body, dtype=np.uint8)
        size = int(self.first[-1]) * BLOCK
        inside = self.data[:size].reshape(-1, BLOCK) != 0
        self.valid = np.maximum(inside[:, ::STRIDE].sum(axis=1), 0).astype(np.float32)
        code = self.data[:size + 3].astype(np.uint32)
        code = code[:size] | code[1:size + 1] << 8 | code[2:size + 2] << 16 | code[3:size + 3] << 24
        echo = np.zeros(size, dtype=bool)
        for back in range(2, ECHO + 1):
            echo[back:] |= code[back:] == code[:-back]
        echo &= self.data[:size] != 0
        self.echo = echo.reshape(-1, BLOCK).mean(axis=1, dtype=np.float32)


class Network:
    """The weights, their use and their training."""

    def __init__(self, seed: int = 1):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.weights = {
            "filters": draw.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
            "filter_bias": np.zeros(FILTERS, dtype=np.float32),
            "hidden": draw.normal(0, 0.5, (FILTERS + 1, HIDDEN)).astype(np.float32),
            "hidden_bias": np.full(HIDDEN, 0.1, dtype=np.float32),
            "out": draw.normal(0, 0.3, HIDDEN).astype(np.float32),
            "out_bias": np.zeros(1, dtype=np.float32),
        }

    def _filtered(self, data: np.ndarray, positions: int) -> np.ndarray:
        w = self.weights
        total = np.repeat(w["filter_bias"][None], positions, axis=0)
        for k in range(WIDTH):
            total += w["filters"][k][data[k:k + positions * STRIDE:STRIDE]]
        return np.maximum(total, 0, out=total)

    def chunks(self, packed: Packed) -> tuple[np.ndarray, np.ndarray]:
        """(averages of every chunk, number of positions in it). A chunk is a block and the one after it in its document;
        the last block of a document stands alone."""
        blocks = len(packed.valid)
        answers = self._filtered(packed.data, blocks * BLOCK // STRIDE).reshape(blocks, BLOCK // STRIDE, FILTERS)
        inside = (packed.data[:blocks * BLOCK:STRIDE] != 0).reshape(blocks, BLOCK // STRIDE, 1)
        sums = (answers * inside).sum(axis=1)
        follows = np.ones(blocks, dtype=np.float32)
        follows[packed.first[1:] - 1] = 0
        after = np.roll(np.arange(blocks), -1)
        count = np.maximum(packed.valid + packed.valid[after] * follows, 1)
        means = (sums + sums[after] * follows[:, None]) / count[:, None]
        echo = (packed.echo + packed.echo[after] * follows) / (1 + follows)
        return np.concatenate([means, echo[:, None]], axis=1), count

    def scores(self, packed: Packed) -> np.ndarray:
        w = self.weights
        means, _ = self.chunks(packed)
        hidden = np.maximum(means @ w["hidden"] + w["hidden_bias"], 0)
        best = np.maximum.reduceat(hidden, packed.first[:-1], axis=0)
        return 1 / (1 + np.exp(-np.clip(best.astype(np.float64) @ w["out"] + w["out_bias"][0], -50, 50)))

    def gradients(self, packed: Packed, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss. Only the chunks that some unit answers to most strongly pass anything back."""
        w = self.weights
        means, count = self.chunks(packed)
        hidden = np.maximum(means @ w["hidden"] + w["hidden_bias"], 0)
        at = np.stack([low + hidden[low:high].argmax(axis=0) for low, high in zip(packed.first, packed.first[1:])])
        best = np.take_along_axis(hidden, at, axis=0)
        score = 1 / (1 + np.exp(-np.clip(best @ w["out"] + w["out_bias"][0], -50, 50)))
        error = ((score - labels) / len(labels)).astype(np.float32)
        back = {"out": best.T @ error, "out_bias": np.array([error.sum()], dtype=np.float32)}
        to_hidden = error[:, None] * w["out"] * (best > 0)
        back["hidden_bias"] = to_hidden.sum(axis=0)
        back["hidden"] = np.einsum("dhf,dh->fh", means[at], to_hidden)
        to_chunk = np.zeros((len(means), FILTERS), dtype=np.float32)
        np.add.at(to_chunk, at.ravel(), (to_hidden[:, :, None] * w["hidden"][:FILTERS].T[None]).reshape(-1, FILTERS))
        used = np.flatnonzero(np.abs(to_chunk).sum(axis=1))
        last = np.zeros(len(means), dtype=bool)
        last[packed.first[1:] - 1] = True
        back["filters"] = np.zeros_like(w["filters"])
        back["filter_bias"] = np.zeros_like(w["filter_bias"])
        steps = np.arange(0, 2 * BLOCK, STRIDE)
        places = used[:, None] * BLOCK + steps[None]
        keep = (steps[None] < BLOCK) | ~last[used][:, None]
        grads = np.repeat(to_chunk[used] / count[used][:, None], len(steps), axis=0)
        places, grads = places[keep], grads[keep.ravel()]
        real = packed.data[places] != 0
        places, grads = places[real], grads[real]
        answers = np.repeat(w["filter_bias"][None], len(places), axis=0)
        for k in range(WIDTH):
            answers += w["filters"][k][packed.data[places + k]]
        grads = grads * (answers > 0)
        back["filter_bias"] = grads.sum(axis=0)
        for k in range(WIDTH):
            under = packed.data[places + k]
            for f in range(FILTERS):
                back["filters"][k][:, f] = np.bincount(under, weights=grads[:, f], minlength=256)
        return back

    def learn(self, bodies: list[bytes], labels: np.ndarray, passes: int = PASSES, rate: float = 0.01,
              batch: int = 32, seed: int = 2) -> None:
        """Adam over shuffled batches, with the rate falling to a tenth."""
        draw = np.random.Generator(np.random.PCG64(seed))
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        steps, step = passes * -(-len(bodies) // batch), 0
        for _ in range(passes):
            order = draw.permutation(len(bodies))
            for low in range(0, len(order), batch):
                chosen = order[low:low + batch]
                back = self.gradients(Packed([bodies[i] for i in chosen]), labels[chosen])
                step += 1
                now = rate * (1 - 0.9 * step / steps)
                for name, grad in back.items():
                    first[name] += 0.1 * (grad - first[name])
                    second[name] += 0.01 * (grad * grad - second[name])
                    move = first[name] / (1 - 0.9 ** step) / (np.sqrt(second[name] / (1 - 0.99 ** step)) + 1e-6)
                    self.weights[name] -= (now * move).astype(np.float32)


def _score(network: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [x.as_py().replace(b"\0", b" ") for x in pc.fill_null(batch.column("text"), "").cast(pa.binary())]
            found, group, held = [], [], 0
            for body in bodies:
                group.append(body)
                held += len(body) + BLOCK
                if held > GROUP:
                    found.append(_scores_of(network, group))
                    group, held = [], 0
            if group:
                found.append(_scores_of(network, group))
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])
    return run


def _scores_of(network: Network | None, bodies: list[bytes]) -> np.ndarray:
    return np.full(len(bodies), 0.5) if network is None else network.scores(Packed(bodies))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from; rows without an id are among them."""
    return F.coalesce(F.pmod(crc_of(id_col), F.lit(4)) == 2, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Network | None:
    """A network learned from at most ``sample`` labelled documents of either label, drawn by hash of the id from the
    documents that have a label, are not held out and have at most ``longest`` bytes. None where one of the labels has
    no such document."""
    short = docs.where(F.octet_length("text") <= longest)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(
        "doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out()).join(short.select("doc_id"), "doc_id", "left_semi")
    order = F.xxhash64("doc_id")
    chosen = [usable.where(F.col("quality") == label).distinct().orderBy(order, "doc_id").limit(sample) for label in (0, 1)]
    # The drawn ids are at most two samples, whatever the tables hold.
    drawn = short.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    rows = drawn.orderBy(order, "doc_id", F.xxhash64("text"), "quality").limit(2 * sample).select("text", "quality").collect()
    known = np.array([r.quality for r in rows], dtype=np.float32)
    if len(set(known.tolist())) < 2:
        return None
    network = Network()
    network.learn([r.text.encode("utf-8", "replace").replace(b"\0", b" ") for r in rows], known)
    return network


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  sample: int = SAMPLE, longest: int = LONGEST) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    The network learns from at most ``sample`` documents of either label, of at most ``longest`` bytes each.

    ``labels``: doc_id, quality. Whole texts are scored; null counts as empty, and a zero byte as a space. Texts without
    a byte get the score of an empty chunk, all the same. Without labels of both kinds to learn from every score is 0.5.
    Rows that repeat an id are scored each on their own; an empty table gives an empty result.
    """
    read = ids_and_texts(docs, id_col, text_col)
    network = train(read, labels, sample, longest)
    scored = read.mapInArrow(_score(network), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= LIKELY).cast("int").alias("predicted"))
