"""Byte-pair encoding that encodes text shared by several documents once, and decoding.

A rolling hash over 16 bytes cuts texts into chunks, so equal passages give equal chunks wherever they stand.

1. Texts are scanned: each document tells which chunks it has. A chunk that several documents have is shared; the
   smallest block that holds it is its owner.
2. Texts go to blocks by a hash of the document. The owner encodes each of its shared chunks once and gives out the ids.
   A document without chunks of other owners is finished here; of the rest only the text outside shared chunks and the
   keys of these go on.
3. Blocks get the ids of the shared chunks they wait for and finish the rest.

A chunk is encoded from its first to its last safe boundary, a space that begins a word. Where two parts join, the text
between the last safe boundary of the one and the first of the other is encoded anew; if a part has no such boundary,
the window goes on through it. Both edges are places where the library's own encoding starts afresh, so the result is
exactly that of the whole text. Every result is decoded and held against the text, or against its hash where the text
did not go on; without agreement (two chunks under one key) the text is encoded anew as a whole.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titletide.llm.common import ids_and_texts, partitions_for, tied, untied, utf8_size
from titletide.llm.pieces import Pieces, encoder
from titletide.llm.tokens import VOCABULARY
from titletide.session import stored

SPARK_SEED = 42  # of Spark's xxhash64
WINDOW = 16  # bytes under the rolling hash
CUT_BITS = 8  # a chunk has about 2^8 bytes
FACTOR = 0x9E3779B97F4A7C15  # odd multiplier of the rolling hash
LONGEST = 1 << 14  # bytes after which a chunk ends in any case
STRETCH = 1 << 20  # bytes of text in one packed row
BLOCK = 8 << 20  # bytes of text in a block
SEEN = "block int, chunk long, docs long"
WORTH = 64  # bytes that a chunk must have to be shared
TEXT_LEVEL = 9  # of compression
WORK = "block int, kind int, chunk long, body binary"
DONE = "kind int, block int, doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, chunk long, body binary"
OWN, LOCAL, FOREIGN, TEXTS = 0, 1, 2, 3  # kinds of rows that a block gets: chunks to give out, to keep, to wait for; texts
RESULT, CODED, WAITING, FAILED = 0, 1, 2, 3  # kinds of rows that it gives


def chunk_ends(body: bytes) -> np.ndarray:
    """The end of every content-defined chunk of a text; cuts never part the bytes of a character."""
    n = len(body)
    data = np.frombuffer(body, dtype=np.uint8)
    if n <= WINDOW:
        return np.array([n] if n else [], dtype=np.int64)
    rolled = _TABLE[data]
    step, factor = 1, FACTOR
    while step < WINDOW:  # the hash of twice as many bytes from two neighbours
        longer = rolled[step:].copy()
        longer += rolled[:-step] * np.uint64(factor)
        rolled, factor, step = longer, factor * factor % (1 << 64), step * 2
    ends = np.flatnonzero(rolled >> np.uint64(64 - CUT_BITS) == 0) + WINDOW
    if len(ends) == 0 or ends[-1] != n:
        ends = np.append(ends, n)
    gaps = np.diff(ends, prepend=0)
    if gaps.max() > LONGEST:
        starts = ends - gaps
        ends = np.concatenate([np.append(np.arange(a + LONGEST, b, LONGEST), b) for a, b in zip(starts, ends)])
    for _ in range(3):
        inside = (ends < n) & (data[np.minimum(ends, n - 1)] & 0xC0 == 0x80)
        if not inside.any():
            break
        ends = ends + inside
    return np.unique(ends)


_RULE = np.random.Generator(np.random.PCG64(7))
_TABLE = _RULE.integers(0, 1 << 64, 256, dtype=np.uint64)


def _key(chunk: bytes) -> int:
    return xxhash.xxh3_64_intdigest(chunk) - (1 << 63)


def _block_of(doc: int | None, body: bytes, blocks: int) -> int:
    return xxhash.xxh64_intdigest(struct.pack("<qQ", doc or 0, xxhash.xxh64_intdigest(body))) % blocks


def _chunks(body: bytes) -> list[bytes]:
    ends = chunk_ends(body).tolist()
    return [body[a:b] for a, b in zip([0, *ends], ends)]


def _bodies(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    texts = pc.fill_null(batch.column("text"), "").cast(pa.binary())
    return zip(batch.column("doc_id").to_pylist(), (x.as_py() for x in texts))


def _has_special(body: bytes, special: list[bytes]) -> bool:
    return any(s in body for s in special)


def _scan(vocabulary: str, blocks: int):
    """For each chunk of a block, as far as a stretch of the input knows: how many documents have it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = [s.encode() for s in encoder(vocabulary).special]
        for batch in batches:
            seen: dict[tuple[int, int], int] = {}
            for doc, body in _bodies(batch):
                if _has_special(body, special):
                    continue
                block = _block_of(doc, body, blocks)
                for key in {_key(c) for c in _chunks(body) if len(c) >= WORTH}:
                    seen[block, key] = seen.get((block, key), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.int64()),
                 pa.array(seen.values(), pa.int64())], names=["block", "chunk", "docs"])
    return run


def _roles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``SEEN`` in order of chunk and block become the shared chunks' rows for their blocks."""
    def out(block: np.ndarray, chunk: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(chunk), dtype=bool)
        new[1:] = chunk[1:] != chunk[:-1]
        new_block = new.copy()
        new_block[1:] |= block[1:] != block[:-1]
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(chunk)))
        blocks, total = np.add.reduceat(new_block, first), np.add.reduceat(docs, first)
        kind = np.where(new, np.where(np.repeat(blocks, sizes) > 1, OWN, LOCAL), FOREIGN).astype(np.int32)
        keep = new_block & (np.repeat(total, sizes) > 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(block[keep]), pa.array(kind[keep]), pa.array(chunk[keep]), pa.nulls(int(keep.sum()), pa.binary())],
            names=["block", "kind", "chunk", "body"])

    held = [np.zeros(0, dtype=d) for d in (np.int32, np.int64, np.int64)]
    for batch in batches:
        rows = [np.concatenate((h, batch.column(c).to_numpy())) for h, c in zip(held, ("block", "chunk", "docs"))]
        edge = int(np.searchsorted(rows[1], rows[1][-1])) if len(rows[1]) else 0  # the last chunk may go on
        if edge:
            yield out(*(r[:edge] for r in rows))
        held = [r[edge:] for r in rows]
    if len(held[1]):
        yield out(*held)


def _packed(rows: list[tuple[int | None, bytes]]) -> bytes:
    head = b"".join(struct.pack("<?qq", doc is not None, doc or 0, len(body)) for doc, body in rows)
    whole = struct.pack("<q", len(rows)) + head + b"".join(body for _, body in rows)
    return zstandard.ZstdCompressor(level=TEXT_LEVEL).compress(whole)


def _unpacked(packed: bytes) -> Iterator[tuple[int | None, bytes]]:
    whole = zstandard.ZstdDecompressor().decompress(packed)
    (n,) = struct.unpack_from("<q", whole)
    at = 8 + 17 * n
    for i in range(n):
        known, doc, size = struct.unpack_from("<?qq", whole, 8 + 17 * i)
        yield (doc if known else None), whole[at:at + size]
        at += size


def _deal(blocks: int):
    """Texts, compressed together, on their way to their blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        sizes: dict[int, int] = {}

        def out(block: int) -> pa.RecordBatch:
            sizes.pop(block)
            return _work([(block, TEXTS, None, _packed(held.pop(block)))])

        for batch in batches:
            for doc, body in _bodies(batch):
                block = _block_of(doc, body, blocks)
                held.setdefault(block, []).append((doc, body))
                sizes[block] = sizes.get(block, 0) + len(body)
                if sizes[block] > STRETCH:
                    yield out(block)
                elif sum(sizes.values()) > 32 * STRETCH:
                    for b in list(held):
                        yield out(b)
        for b in list(held):
            yield out(b)
    return run


def _work(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                      names=["block", "kind", "chunk", "body"])


def _done(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                      names=[x.split()[0] for x in DONE.split(", ")])


def _safe(chunk: bytes) -> tuple[int, int]:
    """The first and the last safe boundary of a chunk; (-1, -1) without one. Only characters that are surely no white
    space count as the beginning of a word."""
    first = chunk.find(b" ")
    while 0 <= first and not _begins(chunk, first):
        first = chunk.find(b" ", first + 1)
    if first < 0:
        return -1, -1
    last = chunk.rfind(b" ")
    while not _begins(chunk, last):
        last = chunk.rfind(b" ", 0, last)
    return first, last


def _begins(chunk: bytes, space: int) -> bool:
    after = chunk[space + 1] if space + 1 < len(chunk) else 32
    return 0x21 <= after < 0x7F or 0xC3 <= after <= 0xDF


Part = tuple[bytes, bytes | None, bytes]  # text before the first safe boundary, ids, text after the last one


def encode_parts(texts: list[bytes], pieces: Pieces) -> list[Part]:
    """Each text with the ids between its first and last safe boundary; without one it is all in front, with no ids."""
    places = [_safe(t) for t in texts]
    inner = pieces.of_each([t[a:b].decode() if a >= 0 else "" for t, (a, b) in zip(texts, places)], b"".join)
    return [(t[:a], ids, t[b:]) if a >= 0 else (t, None, b"") for t, (a, b), ids in zip(texts, places, inner)]


def joined_ids(documents: list[list[Part]], pieces: Pieces) -> list[bytes]:
    """The ids of documents given in parts: inner ids as they are, and every window around a join encoded anew."""
    plans, windows = [], []
    for parts in documents:
        plan, open_text = [], b""
        for head, ids, tail in parts:
            if ids is None:
                open_text += head
                continue
            plan += [len(windows), ids]
            windows.append((open_text + head).decode())
            open_text = tail
        plan.append(len(windows))
        windows.append(open_text.decode())
        plans.append(plan)
    ids = list(pieces.of_each(windows, b"".join))
    return [b"".join(ids[p] if isinstance(p, int) else p for p in plan) for plan in plans]


def _part_as_bytes(part: Part) -> bytes:
    """Ids of small vocabularies take two bytes each."""
    head, ids, tail = part
    wide = np.frombuffer(ids or b"", dtype="<u4")
    width = 0 if ids is None else 2 if not len(wide) or wide.max() < 1 << 16 else 4
    return struct.pack("<BII", width, len(head), len(tail)) + head + tail + (wide.astype("<u2").tobytes() if width == 2 else ids or b"")


def _part_of(body: bytes) -> Part:
    width, head, tail = struct.unpack_from("<BII", body)
    at = 9 + head + tail
    ids = body[at:] if width == 4 else np.frombuffer(body, dtype="<u2", offset=at).astype("<u4").tobytes()
    return body[9:9 + head], ids if width else None, body[9 + head:at]


Segments = list[bytes | int]  # a document as plain text and the keys of shared chunks


def _segments(chunks: list[bytes], shared: set[int]) -> Segments:
    out: Segments = []
    for chunk in chunks:
        key = _key(chunk) if len(chunk) >= WORTH else None
        if key is not None and key in shared:
            out.append(key)
        elif out and isinstance(out[-1], bytes):
            out[-1] += chunk
        else:
            out.append(chunk)
    return out


def _waiting(rows: list[tuple[int | None, int, Segments]]) -> bytes:
    """Documents that wait, with the hash of their text."""
    plain = [s for _, _, segments in rows for s in segments if isinstance(s, bytes)]
    sizes = [len(s) if isinstance(s, bytes) else -1 for _, _, segments in rows for s in segments]
    keys = [s for _, _, segments in rows for s in segments if isinstance(s, int)]
    return tied(np.array([d or 0 for d, _, _ in rows], dtype=np.int64), np.array([d is not None for d, _, _ in rows], dtype=bool),
                np.array([h for _, h, _ in rows], dtype=np.int64), np.array([len(s) for _, _, s in rows], dtype=np.int64),
                np.array(sizes, dtype=np.int32), np.array(keys, dtype=np.int64), np.frombuffer(b"".join(plain), dtype=np.uint8),
                level=TEXT_LEVEL)


def _waited(body: bytes) -> Iterator[tuple[int | None, int, Segments]]:
    ids, known, hashes, counts, sizes, keys, plain = untied(body)
    sizes, keys, text = iter(sizes.tolist()), iter(keys.tolist()), plain.tobytes()
    at = 0
    for doc, has, digest, n in zip(ids.tolist(), known.tolist(), hashes.tolist(), counts.tolist()):
        segments: Segments = []
        for _ in range(n):
            size = next(sizes)
            segments.append(next(keys) if size < 0 else text[at:at + size])
            at += max(size, 0)
        yield (doc if has else None), digest, segments


def _text_key(body: bytes) -> int:
    key = xxhash.xxh64_intdigest(body, SPARK_SEED)
    return key - (1 << 64) if key >> 63 else key


class Decoder:
    """Turns ids back into text, by the bytes behind each id of a byte-level vocabulary."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that are written as themselves
        byte_of = {chr(b): b for b in plain} | {
            chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        added = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
        words = tokenizer.get_vocab()
        self.bytes_of = [b""] * (max(words.values()) + 1)
        for word, i in words.items():
            self.bytes_of[i] = added[i].encode() if i in added else bytes(byte_of[c] for c in word)

    def text(self, ids: bytes) -> str:
        at = np.frombuffer(ids, dtype="<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, at)).decode("utf-8", "replace")


_DECODERS: dict[str, Decoder] = {}


def decoder(vocabulary: str) -> Decoder:
    if vocabulary not in _DECODERS:
        _DECODERS[vocabulary] = Decoder(vocabulary)
    return _DECODERS[vocabulary]


def _result(block: int, doc: int | None, ids: bytes, text: str) -> tuple:
    return (RESULT, block, doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), None, None)


def _first(vocabulary: str):
    """A block's first turn: rows about its chunks, then its texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, back = encoder(vocabulary), decoder(vocabulary)
        special = [s.encode() for s in pieces.special]
        block, given, kept, foreign, known = None, set(), set(), set(), {}
        for batch in batches:
            for at, kind, chunk, packed in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "chunk", "body"))):
                if at != block:
                    block, given, kept, foreign, known = at, set(), set(), set(), {}
                if kind != TEXTS:
                    {OWN: given, LOCAL: kept, FOREIGN: foreign}[kind].add(chunk)
                    continue
                shared = given | kept | foreign
                ready, waiting, new = [], [], {}
                for doc, body in _unpacked(packed):
                    if _has_special(body, special):
                        ready.append((doc, body, None))
                        continue
                    chunks = _chunks(body)
                    segments = _segments(chunks, shared)
                    keys = {s for s in segments if isinstance(s, int)}
                    waits = not foreign.isdisjoint(keys)
                    if not keys.issubset(known):
                        wanted = (keys & given) if waits else keys
                        new |= {k: c for c in chunks if len(c) >= WORTH and (k := _key(c)) in wanted and k not in known}
                    if waits:
                        local = _segments(chunks, given | foreign)  # what only this block shares is not sent
                        waiting.append((doc, _text_key(body), local))
                    else:
                        ready.append((doc, body, segments))
                coded = dict(zip(new, encode_parts(list(new.values()), pieces)))
                known |= coded
                out = [(CODED, block, None, None, None, None, k, _part_as_bytes(p)) for k, p in coded.items() if k in given]
                plain = iter(encode_parts([s for _, _, g in ready for s in g or () if isinstance(s, bytes)], pieces))
                parts = [[known[s] if isinstance(s, int) else next(plain) for s in g] for _, _, g in ready if g is not None]
                joined = iter(joined_ids(parts, pieces))
                for doc, body, segments in ready:
                    text = body.decode()
                    ids = next(joined) if segments is not None else None
                    decoded = back.text(ids) if ids is not None else None
                    if decoded != text:
                        [ids] = pieces.encode([text])
                        decoded = back.text(ids)
                    out.append(_result(block, doc, ids, decoded))
                if waiting:
                    out.append((WAITING, block, None, None, None, None, None, _waiting(waiting)))
                yield _done(out)
        pieces.rest()
    return run


def _second(vocabulary: str):
    """A block's second turn: the shared chunks it waits for, then its waiting documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, back = encoder(vocabulary), decoder(vocabulary)
        block, known = None, {}
        for batch in batches:
            for at, kind, chunk, packed in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "chunk", "body"))):
                if at != block:
                    block, known = at, {}
                if kind != TEXTS:
                    known[chunk] = packed
                    continue
                rows = list(_waited(packed))
                plain = iter(encode_parts([s for _, _, g in rows for s in g if isinstance(s, bytes)], pieces))
                parts = [[_part_of(known[s]) if isinstance(s, int) else next(plain) for s in g] for _, _, g in rows]
                out = []
                for (doc, digest, _), ids in zip(rows, joined_ids(parts, pieces)):
                    text = back.text(ids)
                    if _text_key(text.encode()) == digest:
                        out.append(_result(block, doc, ids, text))
                    else:
                        out.append((FAILED, block, doc, None, None, None, digest, None))
                yield _done(out)
        pieces.rest()
    return run


def _whole(vocabulary: str):
    """Texts encoded as a whole, without any chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, back = encoder(vocabulary), decoder(vocabulary)
        for batch in batches:
            out = []
            for doc, body in _bodies(batch):
                [ids] = pieces.encode([body.decode()])
                out.append(_result(0, doc, ids, back.text(ids)))
            yield _done(out)
    return run


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row.

    Null counts as empty. Texts with a special string of the tokenizer are encoded whole. Rows that repeat or lack an id
    are encoded each on their own. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    read = ids_and_texts(docs, id_col, text_col)
    size = read.agg(F.sum(utf8_size(F.col("text")))).first()[0] or 0
    blocks = max(64, partitions_for(spark, size, BLOCK))
    seen = read.mapInArrow(_scan(vocabulary, blocks), SEEN)
    roles = stored(seen.repartition(blocks, "chunk").sortWithinPartitions("chunk", "block").mapInArrow(_roles, WORK), "reuse-roles")
    texts = read.mapInArrow(_deal(blocks), WORK)

    def met(rows: DataFrame) -> DataFrame:
        return rows.repartition(blocks, "block").sortWithinPartitions("block", "kind")

    first = stored(met(texts.unionByName(roles)).mapInArrow(_first(vocabulary), DONE), "reuse-first")
    coded = first.where(F.col("kind") == CODED).select("chunk", "body")
    sent = roles.where(F.col("kind") != LOCAL).select("block", "chunk").join(coded, "chunk").select(
        "block", F.lit(FOREIGN).alias("kind"), "chunk", "body")
    left = first.where(F.col("kind") == WAITING).select("block", F.lit(TEXTS).alias("kind"), F.lit(None).cast("long").alias("chunk"), "body")
    second = stored(met(left.unionByName(sent)).mapInArrow(_second(vocabulary), DONE), "reuse-second")
    columns = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    done = first.unionByName(second).where(F.col("kind") == RESULT).select(*columns)
    failed = second.where(F.col("kind") == FAILED).select(F.col("doc_id").alias("id"), F.col("chunk").alias("text_key"))
    if failed.isEmpty():
        return done
    keyed = read.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    again = keyed.join(failed, keyed["doc_id"].eqNullSafe(failed["id"]) & (keyed["key"] == failed["text_key"]), "left_semi")
    return done.unionByName(again.select("doc_id", "text").mapInArrow(_whole(vocabulary), DONE).select(*columns))
