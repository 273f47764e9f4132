"""From raw documents to packed training sequences.

Language: documents without a recognisable language go. Exact duplicates: the newest of equal texts stays. Near
duplicates: of each group the first document stays. Repeats: passages that an earlier document has are cut out.
Packing: what is left fills training sequences. Each stage reads what the stage before it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titletide.llm import exact, language, packing, repeats, simhash
from titletide.llm.common import lowered
from titletide.session import stored


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    while name in docs.columns:
        name += "_"
    return name


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows whose id and text are not among the dropped ones."""
    out = dropped.select(F.col("doc_id").alias(_unused(docs, "__id")), F.col("text_key").alias(_unused(docs, "__text")))
    same = docs["doc_id"].eqNullSafe(out[0]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == out[1])
    return docs.join(out, same, "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language is undetermined: null, empty, or without any letter."""
    judged = language.predict_languages(docs, whole_rows=True)
    return judged.where(F.col("lang_pred") != language.UNKNOWN).select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z the row with the largest id stays; of rows alike in both,
    any one."""
    found = exact.exact_duplicates(docs)
    key = _unused(docs, "__key")
    left = _without(docs, found.where("NOT kept")).withColumn(key, F.xxhash64(lowered(F.col("text"))))
    return left.dropDuplicates(["doc_id", key]).drop(key)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays; rows without an id stay."""
    found = simhash.near_duplicates(docs)
    return _without(docs, found.where("doc_id <> component_id"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its text shortened by the passages that earlier documents have; n_chars follows the text."""
    others = [f for f in docs.schema if f.name not in ("doc_id", "text")]
    found = repeats.without_repeats(docs, carry=[f.name for f in others])
    options = {**repeats.TIMES, "columnNameOfCorruptRecord": _unused(docs, "_corrupt_record")}
    row = F.from_json("carried", T.StructType(others), options)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.withColumn("row", row).select(
        *[new.get(name, F.col("row").getField(name)).alias(name) for name in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of at most 2048 tokens."""
    return packing.packed_sequences(docs).drop("text_crc32")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack_sequences),
]

#: SQL has neither the tokenizer nor the hash of the fingerprints; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
