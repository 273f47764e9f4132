"""Exact encoding of whole texts from pieces that are encoded once.

The tokenizer splits a text into words before it merges bytes, and a space that stands right before a character which
is no white space always begins a word there, whatever comes before it. So a text may be cut in front of every such
space, the pieces encoded apart and the results put together, and nothing changes. Texts that hold one of the
tokenizer's special strings are encoded whole, as those are looked for first. Most pieces are words seen before: their
result comes from a table of bounded size. A full table gives way to a new one, which takes over what is asked for
again. A piece that ends in marks is the piece without them, which may be known, and the marks. The rest go to the
library in batches of about equal bytes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

KNOWN = 300_000  # pieces of either table that a worker remembers
KEPT = 200_000  # of them that it keeps between tasks
LONGEST = 96  # characters of a piece that is worth remembering
BATCH = 1 << 15  # bytes that go to the library at once
GROUP = 1 << 21  # characters of texts whose different pieces are looked up at once
SLICE = 1 << 20  # characters of a text that are cut into pieces at once
CUT = re.compile(r" (?=\S)")
RUN = re.compile(r" (?!\S)")
MARKS = ".,;:!?"  # after a letter, at the end of a piece, they are a word of their own
LINE = "\n"
SPACE = "\u0120"  # how a byte-level vocabulary writes the space


def ids_as_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.array(ids, dtype="<u4").tobytes()


def number_of_ids(ids: bytes) -> int:
    return len(ids) // 4


def safe_slices(text: str, limit: int = SLICE) -> Iterator[str]:
    """The text in slices of about ``limit`` characters, cut only in front of a space that begins a word."""
    at = 0
    while len(text) - at > limit:
        found = CUT.search(text, at + limit)
        if found is None:
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:]


def _batches(texts: list[str]) -> Iterator[list[str]]:
    """The texts in batches of about ``BATCH`` characters."""
    sizes = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) // BATCH
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
    yield from (texts[low:high] for low, high in zip(cuts, cuts[1:]) if high > low)


def _at_line(piece: str) -> tuple[str, str] | None:
    """A piece cut in front of its only line break, if that stands between other characters than white space: there it
    is a word of its own, and another begins behind it."""
    head, _, tail = piece.partition(LINE)
    if not head or not tail or " " in piece or LINE in tail or head[-1].isspace() or tail[0].isspace() or tail[-1].isspace():
        return None
    return head, LINE + tail


class Pieces:
    """Encodes texts with a tokenizer of the ``tokenizers`` library; ``made`` turns a piece's ids, as bytes, into what is
    kept."""

    def __init__(self, vocabulary: str, made: Callable[[bytes], object]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives the task one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.made = made
        self.known: dict[str, object] = {}
        self.marks: dict[str, object] = {}
        self.before: dict[str, object] = {}  # the table that was full last
        words = self.tokenizer.get_vocab(with_added_tokens=False)
        self.begins = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=bool)
        self.begins[[i for word, i in words.items() if word[0] == SPACE]] = True
        self.lines = np.zeros(len(self.begins), dtype=bool)
        self.lines[self.tokenizer.encode(LINE, add_special_tokens=False).ids] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        """The library's own ids of each text, in batches of about equal bytes."""
        out = []
        for batch in _batches(texts):
            out += [ids_as_bytes(e.ids) for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
        return out

    def encode_pieces(self, pieces: list[str]) -> Iterator[tuple[list[str], list[bytes]]]:
        """Pieces with their ids. Pieces that hold no other space than the one they begin with are encoded as one
        text, in which only their first tokens begin with a space; those that begin with a line break likewise."""
        spaced, lined, plain = [], [], []
        for p in pieces:
            (spaced if " " in p else lined if p[0] == LINE else plain).append(p)
        yield spaced, self.encode([" " + p for p in spaced])
        yield from self._in_one(plain, " ", self.begins)
        for tails, ids in self._in_one([p[1:] for p in lined], LINE, self.lines):
            yield [LINE + p for p in tails], ids

    def _in_one(self, pieces: list[str], edge: str, first: np.ndarray) -> Iterator[tuple[list[str], list[bytes]]]:
        """Pieces with their ids and those of the ``edge`` in front of them; tokens that are ``first`` begin a piece."""
        for batch in _batches(pieces):
            [found] = self.tokenizer.encode_batch_fast([edge + edge.join(batch)], add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u4")
            starts = np.flatnonzero(first[ids])
            if len(starts) != len(batch):
                raise RuntimeError("a piece of this vocabulary does not begin with an edge of its own")
            packed = ids.tobytes()
            starts = (4 * starts).tolist()
            yield batch, [packed[a:b] for a, b in zip(starts, [*starts[1:], len(packed)])]

    def parts(self, texts: list[str]) -> Iterator[list[object]]:
        """For each text what was made of its pieces, in order. Pieces after the first are named without their space."""
        firsts, sizes, words, places = self._split(texts)
        found = list(map(self.known.get, words))
        lost = [i for i, value in enumerate(found) if value is None]
        made, known, before, once = self.made, self.known, self.before, {}
        new = {words[i] for i in lost}
        lined = {p: cut for p in new if LINE in p and (cut := _at_line(p))}
        new.difference_update(lined)
        new.update(p for cut in lined.values() for p in cut if p not in known)
        marked = {p: p[len(core):] for p in new if p[-1] in MARKS and p[0] != LINE and p not in before
                  and (core := p.rstrip(MARKS)) and core[-1].isascii() and core[-1].isalpha()}
        new.difference_update(marked)
        new.update(core for p, marks in marked.items() if (core := p[:-len(marks)]) not in known)
        known |= {p: before.pop(p) for p in new if p in before}
        fresh = [p for p in new if p not in known]
        long = [p for p in fresh if len(p) > LONGEST]
        for table, some in ((once, long), (known, [p for p in fresh if len(p) <= LONGEST] if long else fresh)):
            for coded, ids in self.encode_pieces(some):
                table |= zip(coded, map(made, ids))
        unmet = [m for m in {*marked.values()} if m not in self.marks]
        self.marks |= zip(unmet, map(made, self.encode(unmet)))
        for piece, marks in marked.items():
            core = piece[:-len(marks)]
            (known if len(piece) <= LONGEST else once)[piece] = (known[core] if core in known else once[core]) + self.marks[marks]
        for piece, (head, tail) in lined.items():  # most are met once, so only their parts are remembered
            once[piece] = (known[head] if head in known else once[head]) + (known[tail] if tail in known else once[tail])
        for i in lost:
            found[i] = known[words[i]] if words[i] not in once else once[words[i]]
        if len(known) > KNOWN:
            self.known, self.before = {}, known
        each = np.empty(len(found), dtype=object)
        each[:] = found
        each = each[places].tolist()
        low = 0
        for n, ids in zip(sizes, self.encode(firsts)):
            yield [made(ids), *each[low:low + n]]
            low += n

    def _split(self, texts: list[str]) -> tuple[list[str], list[int], list[str], np.ndarray]:
        """The first piece of each text, the number of its others, the different ones among all of these, and the place
        there of each. Arrow cuts at every space; where runs of white space show, only their last space is a cut."""
        whole = [any(s in t for s in self.special) for t in texts]
        if not any(whole):
            lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
            starts, pieces = lists.offsets.to_numpy(), lists.values
            others = np.ones(len(pieces), dtype=bool)
            others[starts[:-1]] = False
            coded = pieces.filter(pa.array(others)).dictionary_encode()
            words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist
            if "" not in words and not any(map(str.isspace, {w[0] for w in words})):
                return (pieces.take(pa.array(starts[:-1])).to_pylist(), (np.diff(starts) - 1).tolist(), words,
                        coded.indices.to_numpy())
        split = [[t] if w else CUT.split(t) if RUN.search(t) else t.split(" ") for w, t in zip(whole, texts)]
        coded = pa.array(list(chain.from_iterable(s[1:] for s in split)), pa.large_string()).dictionary_encode()
        return [s[0] for s in split], [len(s) - 1 for s in split], coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()

    def rest(self) -> None:
        """At the end of a task only pieces that were met early stay, most of them frequent ones, so that idle workers
        hold little."""
        self.before = {}
        if len(self.known) > KEPT:
            self.known = dict(islice(self.known.items(), KEPT))

    def of_each(self, texts: Iterable[str], join: Callable[[list[object]], object]) -> Iterator[object]:
        """``join`` of the parts of every text; texts are met in groups, and long ones in slices, of bounded size."""
        group, held = [], 0
        for text in texts:
            if len(text) > 2 * SLICE and not any(s in text for s in self.special):
                if group:
                    yield from map(join, self.parts(group))
                    group, held = [], 0
                yield join([join(p) for piece in safe_slices(text) for p in self.parts([piece])])
                continue
            group.append(text)
            held += len(text)
            if held > GROUP:
                yield from map(join, self.parts(group))
                group, held = [], 0
        if group:
            yield from map(join, self.parts(group))


_READY: dict[tuple[str, object], Pieces] = {}


def _ready(vocabulary: str, made: Callable[[bytes], object]) -> Pieces:
    """One encoder for each Python worker, so that tasks go on with the pieces that earlier ones met."""
    if (vocabulary, made) not in _READY:
        _READY[vocabulary, made] = Pieces(vocabulary, made)
    return _READY[vocabulary, made]


def counter(vocabulary: str) -> Pieces:
    """The worker's encoder that keeps numbers of tokens only."""
    return _ready(vocabulary, number_of_ids)


def encoder(vocabulary: str) -> Pieces:
    """The worker's encoder that keeps ids as bytes."""
    return _ready(vocabulary, bytes)
