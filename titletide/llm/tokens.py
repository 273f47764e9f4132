"""Token counts of whole texts, from Arrow functions that give back lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titletide.llm.common import ids_and_texts, utf8_size
from titletide.llm.pieces import counter

VOCABULARY = "byte_bpe_50k.json"


def _count(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(vocabulary)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            counts = pa.array(pieces.of_each(texts, sum), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), counts],
                                             names=["doc_id", "n_bytes", "n_tokens"])
        pieces.rest()
    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
                 limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, as the tokenizers library counts the whole text.

    Only ids, sizes and counts come back from Python. Texts go to the library in batches of about equal bytes; a long
    one is cut where a word begins, which changes no token. Special strings count as the library's default has them;
    null counts as empty, with no token. Rows that repeat or lack an id are counted like any other, and an empty table
    gives an empty result. ``vocabulary`` names a tokenizer file that every executor has.
    """
    read = ids_and_texts(docs, id_col, text_col).select("doc_id", utf8_size(F.col("text")).alias("n_bytes"), "text")
    counted = read.mapInArrow(_count(vocabulary), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
