"""Language identification by rank-order profiles of n-grams.

A profile is the most frequent n-grams of a language in order of frequency. A document's own most frequent n-grams are
held against each profile: every one adds the distance between its two ranks, or the largest distance where the profile
lacks it. The language with the smallest sum wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titletide.llm.common import crc_of, in_slices, tidy

ORDERS = (1, 2, 3)  # lengths of n-grams, in characters
PROFILE = 400  # n-grams of a language's profile
LEADING = 300  # n-grams of a document that are compared
SAMPLE = 2000  # documents a language that a profile is learned from, about
PIECE = 1 << 20  # characters of a text that are counted at once
UNKNOWN = "und"
SPACE = 32


def _letter_table() -> np.ndarray:
    """For every code point its lower-case letter, or a space."""
    table = np.full(0x110000, SPACE, dtype=np.uint32)
    for code in range(len(table)):
        if (c := chr(code)).isalpha():
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


_LETTERS: list[np.ndarray] = []


def _letters(text: str) -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(_letter_table())
    return _LETTERS[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].astype(np.uint64)


def _single_spaces(codes: np.ndarray) -> np.ndarray:
    kept = np.ones(len(codes), dtype=bool)
    kept[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE)
    return codes[kept]


def letters_of(text: str) -> np.ndarray:
    """Lower-case letters, with one space around and between words."""
    edge = np.array([SPACE], dtype=np.uint64)
    return _single_spaces(np.concatenate((edge, _letters(text), edge)))


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, counts) of a whole text. An n-gram is a number: 21 bits for each character. One that is only a space, or
    that has a space inside, is left out. A long text is met slice by slice; its last letters go on to the next slice."""
    grams, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    edge = np.array([SPACE], dtype=np.uint64)
    carried, old = edge, 0  # letters before this slice; how many of them were counted already
    for low in range(0, max(len(text), 1), PIECE):
        last = edge[:int(low + PIECE >= len(text))]
        codes = _single_spaces(np.concatenate((carried, _letters(text[low:low + PIECE]), last)))
        found = [np.zeros(0, dtype=np.uint64)]
        for n in ORDERS:
            own = codes[max(0, old - n + 1):]
            if len(own) < n:
                continue
            gram = own[: len(own) - n + 1].copy()
            clean = np.ones(len(gram), dtype=bool) if n > 1 else gram != SPACE
            for i in range(1, n):
                part = own[i: len(own) - n + 1 + i]
                gram = (gram << np.uint64(21)) | part
                if i < n - 1:
                    clean &= part != SPACE
            found.append(gram[clean])
        new, n_new = np.unique(np.concatenate(found), return_counts=True)
        if len(grams):
            new, place = np.unique(np.concatenate((grams, new)), return_inverse=True)
            n_new = np.bincount(place, weights=np.concatenate((counts, n_new))).astype(np.int64)
        grams, counts = new, n_new
        carried = codes[-(max(ORDERS) - 1):]
        old = len(carried)
    return grams, counts


def leading(grams: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent n-grams in order; of equally frequent ones the smaller number comes first."""
    if len(grams) > 4 * top:
        edge = np.partition(counts, len(counts) - top)[len(counts) - top]
        kept = counts >= edge
        grams, counts = grams[kept], counts[kept]
    return grams[np.lexsort((grams, -counts))[:top]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums: dict[str, tuple] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            grams, counts = ngram_counts(text)
            if lang in sums:
                old, n_old = sums[lang]
                grams, place = np.unique(np.concatenate((old, grams)), return_inverse=True)
                counts = np.bincount(place, weights=np.concatenate((n_old, counts))).astype(np.int64)
            sums[lang] = grams, counts
        for lang, (grams, counts) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts)],
                names=["lang", "gram", "n"])


def learn_profiles(docs: DataFrame, sample: int = SAMPLE, profile: int = PROFILE) -> DataFrame:
    """lang, gram, place: the profile of every language, learned from about ``sample`` of its documents.

    ``docs`` has doc_id, text and lang, none of them null. The draw is by hash of the id: the same at every run.
    """
    shares = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))  # a row for each language
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # As many rows as there are languages, each of which has a whole profile on the driver later; texts stay where they are.
    drawn = docs.join(F.broadcast(shares), "lang").where(draw * F.col("n") < sample).select("lang", "text")
    counts = drawn.mapInArrow(tidy(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= profile).select("lang", "gram", "place")


class Profiles:
    """Profiles ready for comparing: for each language sorted n-grams and their ranks."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.names = sorted({r[0] for r in rows})
        grams = np.array(sorted({r[1] for r in rows}), dtype=np.int64).view(np.uint64)
        self.grams = np.sort(grams)
        self.ranks = np.full((len(self.names), len(self.grams) + 1), -1, dtype=np.int64)
        for lang, gram, place in rows:
            at = np.searchsorted(self.grams, np.array([gram], dtype=np.int64).view(np.uint64)[0])
            self.ranks[self.names.index(lang), at] = place - 1

    def judge(self, text: str | None) -> tuple[str, float]:
        """(language, score). The score is the share of the largest possible distance that the winner stays below."""
        if not text or not self.names:
            return UNKNOWN, 0.0
        grams, counts = ngram_counts(text)
        if not len(grams):
            return UNKNOWN, 0.0
        top = leading(grams, counts, LEADING)
        at = np.searchsorted(self.grams, top)
        at = np.where((at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] == top), at, len(self.grams))
        found = self.ranks[:, at]
        apart = np.where(found < 0, PROFILE, np.minimum(np.abs(found - np.arange(len(top))), PROFILE)).sum(axis=1)
        best = int(np.argmin(apart))
        return self.names[best], float(1.0 - apart[best] / (PROFILE * len(top)))


def _judge(profiles: Profiles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.judge(x) for part in in_slices(batch) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "row", "lang_pred", "score"])
    return run


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from; rows without an id are among them."""
    return F.coalesce(F.pmod(crc_of(id_col), F.lit(5)) == 0, F.lit(True))


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                      sample: int = SAMPLE, whole_rows: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, and with ``whole_rows`` also row: all columns in one struct.

    Profiles are learned from about ``sample`` documents of each language, among those that are not held out and have a
    language and a text; they have ``PROFILE`` n-grams each, which is all that goes through the driver. Whole texts are
    judged. A text that is null, empty or without a letter is ``und`` with score 0; of languages at the same distance
    the first by name wins. Rows that repeat an id are judged each on their own. An empty table gives an empty result,
    and where there is nothing to learn from every row is ``und``.
    """
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                        F.col(lang_col).cast("string").alias("lang"))
    learn = known.where("text IS NOT NULL AND lang IS NOT NULL").where(~held_out())
    profiles = Profiles([tuple(r) for r in learn_profiles(learn, sample).collect()])
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if whole_rows else F.lit(None).cast("boolean")
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row.alias("row"))
    schema = T.StructType([read.schema["doc_id"], read.schema["row"], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    judged = read.mapInArrow(tidy(_judge(profiles)), schema)
    out = judged.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "row")
    return out if whole_rows else out.drop("row")
