"""Readers: raw feeds, catalogs, listings, rates and our own tables as typed DataFrames.

Inputs of others are read record by record: ``read_*`` gives the rows that can be used, ``*_intake`` also a table of
problems with the records that cannot (``sources/quarantine.py``). Our own tables fail fast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titletide import schemas, vocab
from titletide.functions import text as X
from titletide.functions.numbers import view_count
from titletide.operators import matching, valuation
from titletide.operators.listings import first_listings
from titletide.operators.mentions import newest_per_feed
from titletide.sources.quarantine import Intake, inside, opened, problem_rows, taken, texts_of


def entries_intake(spark: SparkSession, path: str) -> Intake:
    """Raw feed entries, one JSON object a line. Entries without a title are read, as their links count, but become no items."""
    return taken(opened(texts_of(spark, path), schemas.ENTRIES))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Raw feed entries, one JSON object a line."""
    return entries_intake(spark, path).rows.drop("rescued")


def items_from_entries(entries: DataFrame) -> DataFrame:
    """Feed entries as items, the newest of each feed: label, link, body, flags, tone, views and time. Matching adds
    the titles later. Undated entries keep a NULL ``ts`` beside the time they were ``fetched``."""
    kept = newest_per_feed(entries.where("title IS NOT NULL"))
    repeats = entries.where("source_type = 'podcast' AND link IS NOT NULL AND link <> ''").groupBy("feed", "link").agg(
        (F.count(F.lit(1)) > 1).alias("shared"))
    rows = kept.join(repeats, ["feed", "link"], "left")
    headline = F.trim("title")
    body = F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.get("content.value", F.lit(0)))
    return rows.select(
        headline.alias("headline"),
        X.source_label(F.col("source_type"), F.col("source_name"), F.coalesce("link", F.lit("")),
                       F.get("tags.term", F.lit(0)), F.col("feed_title")).alias("source"),
        "source_type", "feed",
        X.item_link(F.col("source_type"), F.col("link"), F.col("comments"), F.col("id"),
                    F.get("enclosures.href", F.lit(0)), F.coalesce("shared", F.lit(False))).alias("link"),
        X.strip_tags(body).alias("body"),
        X.is_digital_only(headline).alias("is_digital_only"),
        X.tone(headline).alias("sentiment"),
        X.hype(headline).alias("hype"),
        F.when(F.col("source_type") == "youtube", view_count(F.col("views"))).alias("views"),
        F.coalesce("published", "updated").alias("ts"),
        "fetched",
    )


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """A stored snapshot with text stamps, as typed items; rows without a headline are left out."""
    raw = schemas.ITEMS.replace("ts TIMESTAMP_NTZ", "timestamp STRING")
    rows = spark.read.schema(raw).option("mode", "DROPMALFORMED").json(path)
    stamp = F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd HH:mm 'UTC'")).cast("timestamp_ntz")
    return rows.where("headline IS NOT NULL").withColumn("ts", stamp).drop("timestamp")


def threads_intake(spark: SparkSession, path: str, whole: bool = True) -> Intake:
    """Threads of board catalogs, one catalog a file, or a line unless ``whole``. A thread without a number cannot be
    used; a catalog or page that cannot be opened is one problem, and the other pages' threads go on."""
    catalogs = opened(texts_of(spark, path, whole), "board STRING, pages ARRAY<STRING>", required=["board"], strict=True)
    pages = opened(inside(catalogs, "pages", ["board"]), "threads ARRAY<STRING>", strict=True)
    return taken(opened(inside(pages, "threads"), schemas.THREAD, required=["no"]))


def read_threads(spark: SparkSession, path: str) -> DataFrame:
    """Threads of board catalogs, one catalog a file."""
    return threads_intake(spark, path).rows.drop("rescued")


def posts_of(threads: DataFrame) -> DataFrame:
    """thread, part, no, text, platform of each thread's subject, comment and last replies."""
    base = F.concat_ws(":", "board", "no").alias("thread")
    own = threads.select(base, F.explode(F.array(
        F.struct(F.lit("subject").alias("part"), F.lit(0).cast("bigint").alias("no"), F.col("sub").alias("text")),
        F.struct(F.lit("comment").alias("part"), F.lit(0).cast("bigint").alias("no"), F.col("com").alias("text")),
    )).alias("p")).select("thread", "p.*")
    replies = threads.select(base, F.inline("last_replies")).select(
        "thread", F.lit("reply").alias("part"), F.col("no"), F.col("com").alias("text"))
    return own.unionByName(replies).where("text IS NOT NULL AND text <> ''").withColumn("platform", F.lit(False))


def searches_intake(spark: SparkSession, path: str) -> Intake:
    """Listings of marketplace searches, one search a line: title, site, query, pos, item. A search without title or site
    is a problem as a whole, a listing that is no object one of its own."""
    searches = opened(texts_of(spark, path), "title STRING, site STRING, query INT, total BIGINT, itemSummaries ARRAY<STRING>",
                      required=["title", "site"], strict=True)
    found = opened(inside(searches, "itemSummaries", ["title", "site", "query"]), schemas.LISTING)
    usable = found.where("NOT fatal").select(
        F.col("of_title").alias("title"), F.col("of_site").alias("site"), F.col("of_query").alias("query"),
        F.col("place").cast("int").alias("pos"), F.col("record").alias("item"), "rescued")
    return Intake(usable, taken(found).problems)


def read_searches(spark: SparkSession, path: str) -> DataFrame:
    """Marketplace searches as one row per listing, title and site."""
    return first_listings(searches_intake(spark, path).rows)


def read_price_history(spark: SparkSession, path: str) -> DataFrame:
    """Our own price history, all months; a part that cannot be read stops the job."""
    return spark.read.schema(schemas.HISTORY + ", month STRING").parquet(path)


def import_price_history(spark: SparkSession, path: str) -> DataFrame:
    """History kept as arrays of [stamp, title, site, copies, lowest, median], one row a line; other shapes are left out."""
    lines = spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\[.*\]),?\s*$", 1).alias("row"))
    cells = F.from_json("row", "array<string>")
    rows = lines.where("row <> ''").select(cells.alias("c")).where(F.size("c") == 6)
    stamp = F.when(F.col("c")[0].rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}Z$"),
                   F.try_to_timestamp(F.col("c")[0], F.lit("yyyy-MM-dd'T'HH:mm'Z'")).cast("timestamp_ntz"))
    return rows.select(
        stamp.alias("stamp"), F.col("c")[1].alias("title"), F.col("c")[2].alias("site"),
        F.col("c")[3].try_cast("int").alias("copies"), F.col("c")[4].try_cast("double").alias("lowest"),
        F.col("c")[5].try_cast("double").alias("median"),
    ).where("stamp IS NOT NULL AND title IS NOT NULL AND site IS NOT NULL AND copies IS NOT NULL")


def fx_intake(spark: SparkSession, path: str, whole: bool = True) -> Intake:
    """date, currency, per_eur from the daily reference-rate XML, one day a file, or a line unless ``whole``. A day with a
    bad or missing rate of a currency in use gives no rows, and its problem names those currencies."""
    low, high = vocab.FX_SANE
    cube = ("Cube STRUCT<Cube: STRUCT<_time: STRING, Cube: ARRAY<STRUCT<_currency: STRING, _rate: STRING>>>>, "
            "_unfit STRING")
    days = texts_of(spark, path, whole).withColumn(
        "day", F.from_xml("raw", cube, {"ignoreNamespace": "true", "columnNameOfCorruptRecord": "_unfit"})).select(
        "file", "place", "raw", F.col("day._unfit").isNotNull().alias("unfit"),
        F.col("day.Cube.Cube._time").try_cast("date").alias("date"), F.col("day.Cube.Cube.Cube").alias("rates"))
    sane = lambda r: r["_rate"].try_cast("double").between(low, high)
    fine = lambda name: F.exists("rates", lambda r: r["_currency"] == name) & F.forall(
        "rates", lambda r: ~r["_currency"].eqNullSafe(F.lit(name)) | F.coalesce(sane(r), F.lit(False)))
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(fine(name), F.lit(False)), F.lit(name)) for name in vocab.FX_CURRENCIES]))
    problem = (F.when(F.col("unfit") | F.col("rates").isNull(), "unreadable").when(F.col("date").isNull(), "no date")
               .when(F.size(bad) > 0, F.concat(F.lit("rates: "), F.array_join(bad, ", "))))
    rates = days.select("date", F.inline("rates")).select(
        "date", F.col("_currency").alias("currency"), F.col("_rate").alias("per_eur"))
    return Intake(valuation.good_rates(rates), problem_rows(days, problem))


def read_fx(spark: SparkSession, path: str) -> DataFrame:
    """date, currency, per_eur from the daily reference-rate XML; files with a bad or missing rate give no rows."""
    return fx_intake(spark, path).rows


def read_dim(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small hand-made list kept as one JSON document."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_reference_prices(spark: SparkSession, path: str) -> DataFrame:
    """title, region, condition, price, currency, source of price points from articles."""
    shape = "prices ARRAY<STRUCT<title: STRING, region: STRING, condition: STRING, price: DOUBLE, currency: STRING, source: STRING>>"
    rows = read_dim(spark, path, shape).select(F.inline("prices"))
    return rows.where(F.col("currency").isin(*vocab.CURRENCIES) & (F.col("price") > 0))
