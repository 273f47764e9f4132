"""Repeated passages across documents, by prefix-free parsing.

Every string of ``SPAN`` bytes that also starts in a document with a smaller id is removed, byte by byte.

Parsing. A rolling hash runs over each text; within a string of ``SPAN`` bytes the place with the smallest hash is its
trigger. Neighbouring strings with one trigger make a phrase, and phrases overlap by ``SPAN`` - 1 bytes, so each string
lies in exactly one phrase, no text position is left out and equal strings always have equal triggers. The parse says
which phrases a document has, the dictionary holds each different phrase once.

1. Blocks: texts are packed, compressed and written, some megabytes to a block.
2. Triggers of each block, each once, go to buckets by hash. A trigger that only one document has can hold no repeat; the
   others go back to the blocks that have them.
3. Blocks give the phrases at shared triggers to the buckets, each different phrase once with its smallest document.
   Occurrences in larger documents are repeats as they are. Phrases at triggers that very many documents have are given
   string by string, spread by the hash of the string, so that no bucket gets all of them.
4. A bucket makes the dictionary and its suffix array: the strings of the phrases in lexicographic order. Equal strings
   are neighbours there, the parse gives every one its smallest document, and so it is known which are repeats.
5. Blocks take out what the buckets found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titletide.llm.common import ids_and_texts, partitions_for, tidy, tied, untied, utf8_size
from titletide.session import stored

SPAN = 50  # bytes of a string
GRAM = 24  # bytes under the rolling hash
PLACES = SPAN - GRAM + 1  # where a string's trigger may be
BLOCK = 8 << 20  # bytes of text in a block
BUCKET = 16 << 20  # bytes of text whose triggers make a bucket
SLICE = 1 << 20  # bytes that are hashed at once
HOT = 2000  # documents from which on a trigger's phrases are spread string by string
TEXT_LEVEL = 9  # of compression, for messages that hold text
KEY_BITS = 36  # that tell the triggers of a bucket apart
SORTED = 400_000  # strings that are sorted at once
MESSAGE = "target long, kind int, source long, body binary"
FOUND, SHARED, PHRASES, TEXTS = 0, 1, 2, 3  # kinds of messages

_RULE = np.random.Generator(np.random.PCG64(11))
_TABLE = _RULE.integers(0, 1 << 64, 256, dtype=np.uint64)
FACTOR = 0x9E3779B97F4A7C15
_POWERS = {n: np.uint64(pow(FACTOR, n, 1 << 64)) for n in (1, 2, 4, 8, 16)}
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def _message(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                      names=["target", "kind", "source", "body"])


class Block:
    """Some documents: their ids, whether they have one, what is carried along, and their bytes one after the other."""

    def __init__(self, body: bytes):
        self.ids, self.known, sizes, self.data, carried, carried_sizes = untied(body)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        ends = np.cumsum(carried_sizes).tolist()
        raw = carried.tobytes()
        self.carried = [raw[a:b] for a, b in zip([0, *ends], ends)]

    @staticmethod
    def packed(ids: list, bodies: list[bytes], carried: list[bytes]) -> bytes:
        return tied(np.array([i or 0 for i in ids], dtype=np.int64), np.array([i is not None for i in ids], dtype=bool),
                    np.array(list(map(len, bodies)), dtype=np.int64), np.frombuffer(b"".join(bodies), dtype=np.uint8),
                    np.frombuffer(b"".join(carried), dtype=np.uint8), np.array(list(map(len, carried)), dtype=np.int64), level=TEXT_LEVEL)

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first string, number of strings, key of the trigger, document) of every phrase."""
        n = len(self.data)
        whole = np.zeros(n, dtype=bool)  # where a string starts that lies inside one document with an id
        for low, high, known in zip(self.starts.tolist(), self.ends.tolist(), self.known.tolist()):
            if known and high - low >= SPAN:
                whole[low:high - SPAN + 1] = True
        found = [[], [], []]
        for low in range(0, max(n - SPAN + 1, 0), SLICE):
            part = self.data[low:low + SLICE + SPAN - 1]
            at = np.flatnonzero(whole[low:low + len(part) - SPAN + 1])
            if not len(at):
                continue
            hashes = _rolling(part)
            trigger = _smallest(hashes)[at]
            cut = np.flatnonzero((np.diff(trigger) != 0) | (np.diff(at) != 1)) + 1
            first = np.concatenate(([0], cut))
            found[0].append(at[first] + low)
            found[1].append(np.diff(np.append(first, len(at))))
            found[2].append(_mixed(hashes[trigger[first]] ^ np.uint64(FACTOR)))
        if not found[0]:
            return tuple(np.zeros(0, dtype=d) for d in (np.int64, np.int64, np.uint64, np.int64))
        first = np.concatenate(found[0])
        return (first, np.concatenate(found[1]), np.concatenate(found[2]),
                np.searchsorted(self.starts, first, side="right") - 1)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


def _rolling(data: np.ndarray) -> np.ndarray:
    """The hash of the ``GRAM`` bytes at every place, from hashes of 1, 2, 4 and 8 bytes."""
    h = _TABLE[data]
    for step in (1, 2, 4):
        h = h[:-step] * _POWERS[step] + h[step:]
    return _mixed(h[:-16] * _POWERS[16] + h[8:-8] * _POWERS[8] + h[16:])


def _smallest(hashes: np.ndarray) -> np.ndarray:
    """For every string the place of its trigger; of equal hashes the first place counts."""
    low = (hashes & _HIGH) | np.arange(len(hashes), dtype=np.uint64)
    for step in (1, 2, 4, 8):
        low = np.minimum(low[:-step], low[step:])
    rest = PLACES - 16
    return (np.minimum(low[:-rest], low[rest:]) & _LOW).astype(np.int64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, bodies, carried, held = [], [], [], 0
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "").cast(pa.binary())
        for doc, body, extra in zip(batch.column("doc_id").to_pylist(), texts, batch.column("carried").to_pylist()):
            body = body.as_py()
            if ids and held + len(body) > BLOCK:
                yield pa.RecordBatch.from_arrays([pa.array([Block.packed(ids, bodies, carried)], pa.binary())], names=["body"])
                ids, bodies, carried, held = [], [], [], 0
            ids.append(doc)
            bodies.append(body)
            carried.append((extra or "").encode())
            held += len(body)
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([Block.packed(ids, bodies, carried)], pa.binary())], names=["body"])


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _shift(buckets: int) -> np.uint64:
    """The low bits of a key that are not sent. The high ones give the bucket, the next ``KEY_BITS`` tell its triggers
    apart, whatever the number of buckets, but for a few, and those only cost a look."""
    return np.uint64(max(0, 64 - KEY_BITS - (buckets - 1).bit_length()))


def _triggers(buckets: int):
    """Step 2, in blocks: every trigger once, and how many documents have it where it is more than one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("body")):
                _, _, keys, docs = Block(body.as_py()).phrases()
                order = np.argsort(keys, kind="stable")  # documents stay in order
                keys, docs = keys[order], docs[order]
                new_key = np.diff(keys, prepend=keys[:1] ^ np.uint64(1)) != 0
                first = np.flatnonzero(new_key)
                new_doc = new_key | (np.diff(docs, prepend=-1) != 0)
                counts = np.add.reduceat(new_doc, first) if len(first) else first
                keys = keys[first]
                places = _bucket_of(keys, buckets)
                edges = np.searchsorted(places, np.arange(buckets + 1))
                rows = []
                for bucket, (low, high) in enumerate(zip(edges.tolist(), edges[1:].tolist())):
                    if high > low:
                        rows.append((bucket, SHARED, block, _ascending(keys[low:high] >> _shift(buckets), counts[low:high])))
                yield _message(rows)
    return run


def _ascending(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys as differences, by planes of bytes, and the counts above one."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    several = np.flatnonzero(counts > 1)
    return tied(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).ravel(), several.astype(np.uint32),
                np.minimum(counts[several], 1 << 30).astype(np.uint32))


def _short_keys(planes: np.ndarray) -> np.ndarray:
    steps = np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(steps.astype(np.uint64), dtype=np.uint64)


def _by_target(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """The messages of each target, which arrive in order."""
    now, held = None, []
    for batch in batches:
        for target, kind, source, body in zip(*(batch.column(c) for c in ("target", "kind", "source", "body"))):
            target = target.as_py()
            if target != now:
                if held:
                    yield now, held
                now, held = target, []
            held.append((kind.as_py(), source.as_py(), body.as_py()))
    if held:
        yield now, held


def _shared(hot_from: int):
    """Step 2, in buckets: the triggers of two documents or more go back to their blocks, those of more than ``hot_from``
    marked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, messages in _by_target(batches):
            keys, sources, counts = [], [], []
            for _, source, body in messages:
                planes, several, number = untied(body)
                own = _short_keys(planes)
                count = np.ones(len(own), dtype=np.int64)
                count[several] = number
                keys.append(own)
                counts.append(count)
                sources.append(np.full(len(own), source, dtype=np.int64))
            keys, sources, counts = map(np.concatenate, (keys, sources, counts))
            order = np.argsort(keys, kind="stable")
            keys, sources, counts = keys[order], sources[order], counts[order]
            first = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ np.uint64(1)) != 0)
            sums = np.add.reduceat(counts, first)
            total = np.repeat(sums, np.diff(np.append(first, len(keys))))
            keep = total > 1
            keys, sources, hot = keys[keep], sources[keep], total[keep] > hot_from
            order = np.argsort(sources, kind="stable")
            keys, sources, hot = keys[order], sources[order], hot[order]
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(sources)) + 1, [len(sources)])).tolist()
            rows = [(int(sources[low]), SHARED, None, tied(keys[low:high], hot[low:high]))
                    for low, high in zip(cuts, cuts[1:]) if high > low]
            if rows:
                yield _message(rows)
    return run


def _phrases(buckets: int):
    """Step 3: what a block has at shared triggers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, messages in _by_target(batches):
            known = [untied(body) for kind, _, body in messages if kind == SHARED]
            texts = [body for kind, _, body in messages if kind == TEXTS]
            if not known or not texts:
                continue
            keys = np.concatenate([k[0] for k in known])
            order = np.argsort(keys)
            keys, hot = keys[order], np.concatenate([k[1] for k in known])[order]
            block = Block(texts[0])
            first, strings, own, docs = block.phrases()
            short = own >> _shift(buckets)
            at = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
            shared = np.flatnonzero(keys[at] == short)
            first, strings, own, docs, hot = first[shared], strings[shared], own[shared], docs[shared], hot[at[shared]]
            if hot.any():  # string by string
                many = np.flatnonzero(hot)
                low = np.repeat(first[many], strings[many])
                step = np.arange(len(low)) - np.repeat(np.cumsum(strings[many]) - strings[many], strings[many])
                single = low + step
                own_single = _string_keys(block.data, single)
                cold = ~hot
                first = np.concatenate((first[cold], single))
                own = np.concatenate((own[cold], own_single))
                docs = np.concatenate((docs[cold], np.repeat(docs[many], strings[many])))
                strings = np.concatenate((strings[cold], np.ones(len(single), dtype=np.int64)))
            rows = _dictionary_rows(block, number, buckets, first, strings, own, docs)
            if rows:
                yield _message(rows)
    return run


def _string_keys(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), dtype=np.uint64)
    for place in range(0, SPAN):
        out = out * np.uint64(FACTOR) + _TABLE[data[at + place]]
    return _mixed(out)


def _dictionary_rows(block: Block, number: int, buckets: int, first: np.ndarray, strings: np.ndarray, own: np.ndarray,
                     docs: np.ndarray) -> list[tuple]:
    """Messages to the buckets with each different phrase, and one with the repeats that the block sees by itself."""
    raw = block.data.tobytes()
    ids = block.ids[docs]
    table: dict[bytes, list[int]] = {}
    for i, (low, high) in enumerate(zip(first.tolist(), (first + strings + SPAN - 1).tolist())):
        table.setdefault(raw[low:high], []).append(i)
    place = np.zeros(len(first), dtype=np.int64)
    for p, members in enumerate(table.values()):
        place[members] = p
    least = np.full(len(table), np.iinfo(np.int64).max)
    np.minimum.at(least, place, ids)
    again = ids > least[place]
    rows = []
    if again.any():
        local = first[again] - block.starts[docs[again]]
        rows.append((number % buckets, FOUND, number, tied(docs[again], local, local + strings[again] + SPAN - 1)))
    kept = np.flatnonzero(~again)
    if len(kept):
        chosen = kept[np.argsort(place[kept], kind="stable")]
        head = np.flatnonzero(np.diff(place[chosen], prepend=-1) != 0)
        times = np.diff(np.append(head, len(chosen)))
        texts = list(table)
        keys = own[chosen[head]]
        targets = _bucket_of(keys, buckets)
        by_bucket = np.argsort(targets, kind="stable")
        edges = np.searchsorted(targets[by_bucket], np.arange(buckets + 1)).tolist()
        for bucket, (low, high) in enumerate(zip(edges, edges[1:])):
            if high == low:
                continue
            part = by_bucket[low:high]
            members = np.concatenate([chosen[head[p]:head[p] + times[p]] for p in part])
            bodies = [texts[place[chosen[head[p]]]] for p in part]
            rows.append((bucket, PHRASES, number, tied(
                np.frombuffer(b"".join(bodies), dtype=np.uint8), np.array(list(map(len, bodies)), dtype=np.int32), keys[part],
                ids[chosen[head[part]]], times[part].astype(np.int32), docs[members].astype(np.int32),
                first[members] - block.starts[docs[members]], level=TEXT_LEVEL)))
    return rows


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4: dictionary, suffix array and parse of a bucket."""
    for _, messages in _by_target(batches):
        passed = [(source, FOUND, None, body) for kind, source, body in messages if kind == FOUND]
        if passed:
            yield _message(passed)
        given = [(source, untied(body)) for kind, source, body in messages if kind == PHRASES]
        if given:
            rows = _bucket_repeats(given)
            if rows:
                yield _message(rows)


def _bucket_repeats(given: list[tuple[int, list[np.ndarray]]]) -> list[tuple]:
    number: dict[bytes, int] = {}  # the dictionary
    phrase, sources = [], []
    for source, (data, sizes, *_) in given:
        raw, ends = data.tobytes(), np.cumsum(sizes).tolist()
        phrase += [number.setdefault(raw[a:b], len(number)) for a, b in zip([0, *ends], ends)]
        sources.append(np.full(len(sizes), source, dtype=np.int64))
    phrase, sources = np.array(phrase, dtype=np.int64), np.concatenate(sources)
    keys, ids, times = (np.concatenate([g[1][i] for g in given]) for i in (2, 3, 4))
    docs, places = (np.concatenate([g[1][i] for g in given]) for i in (5, 6))
    begin = np.cumsum(times) - times
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, phrase, ids)
    texts = list(number)
    sizes = np.array(list(map(len, texts)), dtype=np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def take(entries: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """The bytes from low to high of these entries' phrases, wherever they occur."""
        n = times[entries].astype(np.int64)
        at = np.repeat(begin[entries] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out.append((np.repeat(sources[entries], n), docs[at], places[at] + np.repeat(low, n), places[at] + np.repeat(high, n)))

    again = np.flatnonzero(ids > least[phrase])
    take(again, np.zeros(len(again), dtype=np.int64), sizes[phrase[again]])
    one = np.zeros(len(number), dtype=np.uint64)
    one[phrase] = keys
    order = np.argsort(one, kind="stable")
    same = np.diff(one[order]) == 0
    several = np.zeros(len(order), dtype=bool)
    several[1:] |= same
    several[:-1] |= same
    order = order[several]  # phrases whose trigger others have too, trigger by trigger
    first_of = np.flatnonzero(ids == least[phrase])
    by_phrase = first_of[np.argsort(phrase[first_of], kind="stable")]
    low_entry = np.searchsorted(phrase[by_phrase], np.arange(len(number)), side="left")
    high_entry = np.searchsorted(phrase[by_phrase], np.arange(len(number)), side="right")
    at = 0
    while at < len(order):
        upto = at + int(np.searchsorted(np.cumsum(sizes[order[at:]] - SPAN + 1), SORTED)) + 1
        while upto < len(order) and one[order[upto]] == one[order[upto - 1]]:
            upto += 1
        for p, low, high in _earlier_strings([texts[i] for i in order[at:upto]], least[order[at:upto]]):
            chosen = order[at + p]
            entries = by_phrase[low_entry[chosen]:high_entry[chosen]]
            take(entries, np.full(len(entries), low), np.full(len(entries), high))
        at = upto
    blocks, docs_out, lows, highs = (np.concatenate([o[i] for o in out]) for i in range(4))
    order = np.argsort(blocks, kind="stable")
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(blocks[order])) + 1, [len(order)])).tolist()
    return [(int(blocks[order[a]]), FOUND, None, tied(docs_out[order[a:b]].astype(np.int64), lows[order[a:b]], highs[order[a:b]]))
            for a, b in zip(cuts, cuts[1:]) if b > a]


def _earlier_strings(texts: list[bytes], least: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(phrase, from, to) of the stretches of each phrase whose strings some phrase of a smaller document has too.

    The strings are put in lexicographic order: the suffix array of these phrases, each suffix cut at ``SPAN`` bytes.
    """
    sizes = np.array(list(map(len, texts)), dtype=np.int64)
    strings = sizes - SPAN + 1
    owner = np.repeat(np.arange(len(texts)), strings)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
    data = np.frombuffer(b"".join(texts) + bytes(8), dtype=np.uint8)
    start = (np.cumsum(sizes) - sizes)[owner] + inside
    words = np.zeros((7, len(owner)), dtype=np.uint64)
    for byte in range(SPAN):
        words[byte // 8] |= data[start + byte].astype(np.uint64) << np.uint64(56 - 8 * (byte % 8))
    array = np.lexsort(words[::-1])
    new = np.ones(len(array), dtype=bool)
    new[1:] = (words[:, array[1:]] != words[:, array[:-1]]).any(axis=0)
    head = np.flatnonzero(new)
    smallest = np.minimum.reduceat(least[owner[array]], head)
    found = np.zeros(len(array), dtype=bool)
    found[array] = np.repeat(smallest, np.diff(np.append(head, len(array)))) < least[owner[array]]
    at = np.flatnonzero(found)
    if len(at):
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(owner[at]) != 0)) + 1
        for low, high in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(at)]))):
            yield int(owner[at[low]]), int(inside[at[low]]), int(inside[at[high - 1]]) + SPAN


def merged(docs: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document put together where they touch or overlap."""
    order = np.lexsort((lows, docs))
    docs, lows, highs = docs[order], lows[order], highs[order]
    if not len(docs):
        return docs, lows, highs
    wide = int(highs.max()) + 2
    reach = np.maximum.accumulate(docs * wide + highs)
    new = np.ones(len(docs), dtype=bool)
    new[1:] = docs[1:] * wide + lows[1:] > reach[:-1]
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(docs)) - 1
    return docs[head], lows[head], reach[last] - docs[head] * wide


#: Carried timestamps keep their microseconds; who reads them back gives the same formats.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, carried string"


def _remove(keep: bool):
    """Step 5: the documents of a block without their repeats."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, messages in _by_target(batches):
            texts = [body for kind, _, body in messages if kind == TEXTS]
            if not texts:
                continue
            block = Block(texts[0])
            found = [untied(body) for kind, _, body in messages if kind == FOUND]
            empty = np.zeros(0, dtype=np.int64)
            docs, lows, highs = merged(*(np.concatenate([empty, *(f[i] for f in found)]) for i in range(3)))
            edges = np.searchsorted(docs, np.arange(len(block.ids) + 1)).tolist()
            raw, rows = block.data.tobytes(), []
            for i, (start, end) in enumerate(zip(block.starts.tolist(), block.ends.tolist())):
                at, kept, removed = start, [], 0
                for low, high in zip(lows[edges[i]:edges[i + 1]].tolist(), highs[edges[i]:edges[i + 1]].tolist()):
                    kept.append(raw[at:start + low])
                    at = start + high
                    removed += high - low
                kept.append(raw[at:end])
                body = b"".join(kept)
                rows.append((int(block.ids[i]) if block.known[i] else None, end - start, removed, edges[i + 1] - edges[i],
                             hashlib.sha256(body).hexdigest(),
                             body.decode("utf-8", "ignore") if keep else None, block.carried[i].decode() if keep else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            for low in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[low:low + 2000]], k) for i, k in enumerate(kinds)],
                                                 names=[x.split()[0] for x in RESULT.split(", ")])
    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None,
                    hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with ``carry`` (names of other columns, which may be
    an empty list) also kept, the remaining bytes, and carried, those columns as a JSON object.

    Texts are bytes in UTF-8, null counts as empty, and a removed stretch may part the bytes of a character. Strings are
    judged on the input. A string that only the same document repeats stays. Rows that share an id never take anything
    from each other; rows without an id stay whole and take nothing from others. Texts below ``SPAN`` bytes stay whole.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    names = [F.col(f"`{c}`") for c in carry or []]
    extra = F.to_json(F.struct(*names), {"ignoreNullFields": "false", **TIMES}) if names else F.lit(None).cast("string")
    read = docs.withColumn("carried", extra) if "carried" not in docs.columns else docs.select(
        id_col, text_col, extra.alias("carried"))
    read = read.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), "carried")
    size = ids_and_texts(docs, id_col, text_col).agg(F.sum(utf8_size(F.col("text")))).first()[0] or 0
    buckets = max(64, partitions_for(spark, size, BUCKET))
    blocks = stored(read.mapInArrow(tidy(_pack), "body binary").withColumn("block", F.monotonically_increasing_id()), "repeats-blocks")
    places = max(64, blocks.count())
    texts = blocks.select(F.col("block").alias("target"), F.lit(TEXTS).alias("kind"), F.lit(None).cast("long").alias("source"), "body")

    def at_buckets(rows: DataFrame) -> DataFrame:
        return rows.repartition(buckets, "target").sortWithinPartitions("target", "kind")

    def at_blocks(rows: DataFrame) -> DataFrame:
        return rows.unionByName(texts).repartition(places, "target").sortWithinPartitions("target", "kind")

    triggers = blocks.mapInArrow(tidy(_triggers(buckets)), MESSAGE)
    shared = at_buckets(triggers).mapInArrow(tidy(_shared(hot)), MESSAGE)
    phrases = at_blocks(shared).mapInArrow(tidy(_phrases(buckets)), MESSAGE)
    found = at_buckets(phrases).mapInArrow(tidy(_repeats), MESSAGE)
    result = at_blocks(found).mapInArrow(tidy(_remove(carry is not None)), RESULT)
    return result if carry is not None else result.drop("kept_text", "carried")
