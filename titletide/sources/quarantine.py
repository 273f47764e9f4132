"""Inputs of others, record by record: what fits its schema goes on, what does not goes to a table of problems.

A text is opened layer by layer, so one broken record costs neither its neighbours nor its file. Each layer takes the one
before in the same pass; a record that cannot be opened goes along as a single row that names its problem.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of every table of problems.
PROBLEM = ("file", "place", "problem", "kept", "raw")


class Intake(NamedTuple):
    """``rows``: records that can be used, with the parts that did not fit in ``rescued``. ``problems``: file, place (the
    positions of the record in its file, outermost first), problem, kept (the record is among the rows all the same), raw."""

    rows: DataFrame
    problems: DataFrame


def texts_of(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """file, place, raw, problem, fatal of every line, or of every whole file; blank ones are left out."""
    rows = spark.read.text(path, wholetext=whole)
    return rows.where(F.col("value").rlike(r"\S")).select(
        F.col("_metadata.file_path").alias("file"), F.lit("").alias("place"), F.col("value").alias("raw"),
        F.lit(None).cast("string").alias("problem"), F.lit(False).alias("fatal"))


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns worked out once a row: a generator, as filters that move below a projection would repeat its
    parsing in each of their terms."""
    return rows.select("*", F.inline_outer(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def opened(rows: DataFrame, schema: str, required: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """``rows`` with ``record``, the JSON text in ``raw`` by ``schema``, and ``rescued``, its fields that the schema does
    not know or that have another type, as texts.

    A text that is no object, or lacks a ``required`` field, is fatal. A field of another type is NULL and noted; it is
    fatal when it is required or the layer is ``strict``. An object that names a field twice counts with the last one.
    """
    shape = T.StructType.fromDDL(schema)
    known = [f.name for f in shape]
    parsed = F.from_json("raw", T.StructType([*shape, T.StructField("_unfit", T.StringType())]),
                         {"columnNameOfCorruptRecord": "_unfit"})
    kept = [c for c in rows.columns if c not in ("problem", "fatal")]
    keys = F.json_object_keys("raw")
    rows = _once(rows, parsed=parsed, **({"keys": keys} if strict else {}))
    empty = lambda name: F.col("parsed").getField(name).isNull()
    listed = lambda tests: F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))
    names = lambda some: F.array(*[F.lit(name) for name in some]).cast("array<string>")

    # An object whose fields were all read can be used, and nothing is to be said of it when its keys are known, each there
    # once. Only others are read again, as a map, and keys only where rows are strict or what is said of them is asked for.
    read = F.startswith("raw", F.lit("{")) & F.col("parsed").isNotNull() & F.col("parsed._unfit").isNull()
    for name in required:
        read = read & ~empty(name)
    fits = read & _let(F.col("keys") if strict else keys, lambda k: F.size(F.array_intersect(k, names(known))) == F.size(k))

    def lists(whole: Column) -> Column:
        there = lambda name: F.exists(F.map_entries(whole), lambda e: (e["key"] == name) & e["value"].isNotNull())
        return F.struct(
            whole.alias("whole"), listed([(name, empty(name) & there(name)) for name in known]).alias("mistyped"),
            (listed([(name, empty(name) & ~there(name)) for name in required]) if required else names(())).alias("missing"))

    def judged(of: Column) -> Column:
        whole, mistyped, missing = of["whole"], of["mistyped"], of["missing"]
        unreadable = F.coalesce(~F.col("raw").rlike(r"^\s*\{") | whole.isNull() | F.col("parsed").isNull(), F.lit(True))
        inner = F.col("parsed._unfit").isNotNull() & (F.size(mistyped) == 0)
        said = (
            F.when(unreadable, "unreadable")
            .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
            .when(F.size(mistyped) > 0, F.concat(F.lit("wrong type: "), F.array_join(mistyped, ", ")))
            .when(inner, "wrong type inside")
        )
        bad = unreadable | (F.size(missing) > 0)
        if required:
            bad = bad | F.arrays_overlap(mistyped, names(required))
        if strict:
            bad = bad | (F.size(mistyped) > 0) | inner
        odd = F.map_filter(whole, lambda k, v: ~k.isin(*known) | F.array_contains(mistyped, k))
        return F.struct(F.coalesce(bad, F.lit(False)).alias("bad"), said.alias("said"), odd.alias("odd"))

    verdict = _let(_let(F.from_json("raw", "MAP<STRING, STRING>"), lists), judged)
    unless = lambda known_good, part: F.when(~F.coalesce(known_good, F.lit(False)), verdict[part])
    said, odd = unless(fits, "said"), unless(fits, "odd")
    fatal = F.col("fatal") | F.coalesce(unless(fits if strict else read, "bad"), F.lit(False))
    return rows.select(
        *kept, F.when(~fatal, F.col("parsed").dropFields("_unfit")).alias("record"),
        F.when(~fatal, _let(odd, lambda found: F.when(F.size(found) > 0, found))).alias("rescued"),
        F.when(F.col("fatal"), F.col("problem")).otherwise(said).alias("problem"), fatal.alias("fatal"))


def inside(rows: DataFrame, entries: str, carry: Sequence[str] = ()) -> DataFrame:
    """The next layer: one row for each entry of the array of texts ``entries`` of a record, with the record's fields
    ``carry``. A fatal record stays one row, a sound one without entries none."""
    spread = rows.select("file", "place", F.col("raw").alias("outer_raw"), "problem", "fatal",
                         *[c for c in rows.columns if c.startswith("of_")],
                         *[F.col(f"record.{name}").alias(f"of_{name}") for name in carry],
                         F.posexplode_outer(F.when(~F.col("fatal"), F.col(f"record.{entries}"))).alias("at", "entry"))
    place = F.concat_ws("/", F.nullif("place", F.lit("")), F.col("at").cast("string"))
    return spread.where("fatal OR at IS NOT NULL").select(
        "file", F.when(F.col("fatal"), F.col("place")).otherwise(place).alias("place"),
        F.when(F.col("fatal"), F.col("outer_raw")).otherwise(F.col("entry")).alias("raw"),
        "problem", "fatal", *[c for c in spread.columns if c.startswith("of_")])


def taken(rows: DataFrame) -> Intake:
    """The last layer as usable rows and problems; fields of outer layers come first, under their own names."""
    outer = [F.col(c).alias(c[3:]) for c in rows.columns if c.startswith("of_")]
    return Intake(
        rows.where("NOT fatal").select(*outer, "record.*", "rescued"),
        rows.where("problem IS NOT NULL").withColumn("kept", ~F.col("fatal")).select(*PROBLEM))


def problem_rows(rows: DataFrame, problem: Column) -> DataFrame:
    """Rows of file, place and raw whose ``problem`` is not NULL, in the shape of a table of problems."""
    return rows.withColumn("problem", problem).withColumn("kept", F.lit(False)).where("problem IS NOT NULL").select(*PROBLEM)
