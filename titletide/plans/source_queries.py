"""Readers, sinks and item rules run over the warehouse tables: what others would send is written as files first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titletide.functions import text as X
from titletide.operators import listings
from titletide.operators import prices as pr
from titletide.operators import titles as tt
from titletide.session import shared_folder
from titletide.sources import adapters as ad
from titletide.sources import quarantine, readers, sinks


NUMBERS = ("555", "13", "7", "2")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/sources/{name}-{uuid.uuid4().hex}"


def entry_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw feed entries, one JSON object a line, read back as items: labels, links, views and times."""
    n, text = F.col("event_id"), lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    web = F.when(n % 5 != 0, F.when(n % 7 == 0, text("https://reddit.com/", n)).otherwise(text("https://web/", n % 50)))
    entries = ad.table(spark, sf_dir, "events").select(
        text("Feed ", F.col("user_id"), " | front").alias("feed_title"),
        ad.lookup(ad.TYPE_OF_EVENT, F.col("event_type")).alias("source_type"), text("user ", F.col("user_id")).alias("source_name"),
        text("feed ", F.col("user_id")).alias("feed"), F.when(n % 11 != 0, text(" note ", n, " ")).alias("title"),
        web.alias("link"), F.when(n % 2 == 0, text("https://talk/", n)).otherwise("none").alias("comments"), text("tag:", n).alias("id"),
        F.array(F.struct(text("sub", n % 9).alias("term"))).alias("tags"),
        F.when(n % 3 == 0, F.array(F.struct(text("https://audio/", n).alias("href")))).alias("enclosures"),
        F.floor(F.col("value") - 5).cast("string").alias("views"), F.when(n % 4 != 0, F.col("ts")).alias("published"),
        F.when(n % 8 == 0, F.col("ts")).alias("updated"), n.cast("int").alias("position"), F.col("ts").alias("fetched"))
    path = _folder(spark, "entries")
    entries.write.json(path)
    return readers.items_from_entries(readers.read_entries(spark, path)).select(
        "headline", "source", "source_type", "link", "views", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


def imported_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices kept as arrays in text lines, those of third lines in a shape that is no price."""
    lines = ad.table(spark, sf_dir, "lineitem").select(F.concat(
        F.lit('["'), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm'Z'"), F.lit('","title '), F.col("l_partkey").cast("string"),
        F.lit('","US",'), F.col("l_quantity").cast("int").cast("string"), F.lit(","),
        F.when(F.col("l_linenumber") == 2, "null").otherwise(F.col("l_tax").cast("string")), F.lit(","),
        F.col("l_discount").cast("string"), F.when(F.col("l_linenumber") == 3, F.lit(",0")).otherwise(""), F.lit("],")).alias("value"))
    path = _folder(spark, "history")
    lines.write.text(path)
    rows = readers.import_price_history(spark, path)
    return rows.groupBy("title").agg(F.count(F.lit(1)).alias("checks"), F.sum("copies").alias("copies"),
                                     F.count("lowest").alias("with_lowest"), F.round(F.sum("median"), 6).alias("medians"))


def _renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, site, renamed: large parts are known in the UK as the widget of their colour."""
    parts = ad.table(spark, sf_dir, "part")
    return parts.groupBy(F.col("p_name").alias("name")).agg(F.max("p_size").alias("size")).select(
        "name", F.lit("UK").alias("site"), F.when(F.col("size") > 40, F.concat_ws(" ", F.split_part("name", F.lit(" "), F.lit(1)), F.lit("widget")))
        .otherwise(F.col("name")).alias("renamed"))


def pairs_to_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names and sites without those whose name another part goes by on that site."""
    parts = ad.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    pairs = parts.withColumn("site", F.explode(F.array(F.lit("UK"), F.lit("US"))))
    renamed = _renamed(spark, sf_dir).where("renamed <> name")
    return tt.skip_renamed(pairs, renamed)


def pinned_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What mentioned brands count for when large ones are pinned under their type and small ones under a search."""
    parts = ad.table(spark, sf_dir, "part")
    mentioned = parts.select(F.col("p_type").alias("key"), F.col("p_name").alias("name")).distinct()
    pinned = parts.groupBy(F.col("p_brand").alias("key")).agg(
        F.when(F.max("p_size") >= 50, F.min("p_type")).alias("search_words"), F.min_by("p_name", "p_partkey").alias("search"))
    one = lambda df, c: df.groupBy(c).agg(F.min("key").alias("key"))
    by_words, by_name = one(pinned.where("search_words IS NOT NULL"), "search_words"), one(pinned, "search")
    both = by_words.withColumn("search", F.lit(None).cast("string")).unionByName(by_name.withColumn("search_words", F.lit(None).cast("string")))
    return tt.pin_aliases(mentioned, both)


def run_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History rows of one run: each pair's newest line against the one before it, recorded that day or the day before."""
    lines = ad.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("title"), F.col("l_suppkey").cast("string").alias("site"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("checked"), F.col("l_quantity").alias("copies"),
        F.lit(None).cast("double").alias("lowest"), F.floor(F.col("l_discount") * 20).cast("double").alias("median"), "l_orderkey", "l_linenumber")
    figures = F.struct("checked", F.floor(F.col("copies") / 10).alias("copies"), "lowest", "median")
    last = F.max_by(figures, F.struct("checked", "l_orderkey", "l_linenumber")).alias("r")
    first = F.min_by(figures, F.struct("checked", "l_orderkey", "l_linenumber")).alias("r")
    both = lines.groupBy("title", "site")
    new = both.agg(last).select("title", "site", "r.*")
    old = both.agg(first).select("title", "site", "r.copies", "r.lowest", "r.median", F.col("r.checked").cast("date").alias("recorded"))
    return pr.change_rows_against(new, old).select("title", "site", F.date_format("stamp", "yyyy-MM-dd").alias("day"),
                                                   F.col("copies").cast("bigint").alias("copies"), "median")


def number_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that write a number, as a title that is only a number must be written: as a word of its own."""
    rows = ad.texts(spark, sf_dir).select("doc_id", "text", F.explode(F.array(*[F.lit(n) for n in NUMBERS])).alias("title"))
    return rows.where(X.written_as_title(F.col("title"), F.col("text"))).select("doc_id", "title")


def kept_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history sink after two runs, by its month folders."""
    rows = ad.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("title"), F.col("user_id").cast("string").alias("site"), F.col("ts").alias("stamp"), "value")
    path = _folder(spark, "changes")
    sinks.append_history(rows.where("value >= 10"), path)
    sinks.append_history(rows.where("value < 10"), path)
    return spark.read.parquet(path).groupBy(F.col("month").cast("string").alias("month"), "title").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 4).alias("value"))


def left_out_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles left out of the index by either of two runs: once left out, always left out."""
    parts = ad.table(spark, sf_dir, "part")
    lines = parts.groupBy(F.col("p_brand").alias("site")).agg(F.count(F.lit(1)).alias("compared"))
    path = _folder(spark, "index")
    for low, high in ((1, 3), (40, 42)):
        sinks.write_index(lines, parts.where(F.col("p_size").between(low, high)).select(F.col("p_name").alias("title")), path)
    return sinks.left_out(spark, path)


def _noted(kind: str, intake: quarantine.Intake) -> DataFrame:
    return intake.problems.select(F.lit(kind).alias("input"), "place", "problem", "kept", F.length("raw").cast("bigint").alias("chars"))


def _catalogs(spark: SparkSession, sf_dir: str) -> quarantine.Intake:
    """A hundred events as one board's catalog of ten pages, one a line: some threads have a number or a picture count
    that is none, some are no objects, some carry a field nobody knows, and every tenth board's line is cut short."""
    n, text = F.col("event_id"), F.lit
    thread = F.when(n % 17 == 0, n.cast("string")).otherwise(F.concat(
        text('{"no":'), F.when(n % 13 == 0, F.concat(text('"n'), n, text('"'))).otherwise(n.cast("string")),
        text(',"time":'), F.unix_timestamp("ts").cast("string"), text(',"images":'),
        F.when(n % 19 == 0, '"many"').otherwise((n % 7).cast("string")),
        F.when(n % 23 == 0, ',"flag":"pinned"').otherwise(""), text("}")))
    in_order = lambda rows: F.array_join(F.transform(F.sort_array(F.collect_list(rows)), lambda e: e["json"]), ",")
    board, page = F.floor(n / 100).alias("board"), F.floor(n / 10).alias("page")
    pages = ad.table(spark, sf_dir, "events").groupBy(board, page).agg(
        F.concat(text('{"threads":['), in_order(F.struct("event_id", thread.alias("json"))), text("]}")).alias("json"))
    lines = pages.groupBy("board").agg(in_order(F.struct("page", "json")).alias("pages")).select(
        "board", F.concat(text('{"board":"b'), F.col("board"), text('","pages":['), F.col("pages"), text("]}")).alias("value"))
    path = _folder(spark, "catalogs")
    lines.select(F.when(F.col("board") % 10 == 3, F.substr("value", text(1), text(60))).otherwise(F.col("value")).alias("value")).write.text(path)
    return readers.threads_intake(spark, path, whole=False)


def catalog_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads that can be used from catalogs of which some are broken, with what did not fit their fields."""
    return _catalogs(spark, sf_dir).rows.select(
        "board", "no", "time", "images", F.coalesce(F.array_join(F.map_keys("rescued"), ","), F.lit("")).alias("rescued"))


def catalog_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What could not be read of those catalogs, and where it stood."""
    return _noted("catalog", _catalogs(spark, sf_dir))


def _searches(spark: SparkSession, sf_dir: str) -> quarantine.Intake:
    """Each order as a search whose lines it found: some lines are no listings, some prices no prices, some searches have
    a number that is none."""
    lines = ad.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("part"), F.sum("l_quantity").cast("bigint").alias("value"))
    order, number, text = F.col("l_orderkey"), F.col("l_linenumber"), F.lit
    price = F.when((number == 2) & (order % 7 == 0), F.col("value").cast("string")).otherwise(
        F.concat(text('{"value":"'), F.col("value"), text('","currency":"USD"}')))
    listing = F.when((number == 3) & (order % 5 == 0), '"gone"').otherwise(F.concat(
        text('{"itemId":"'), order, text("-"), number, text('","title":"part '), F.col("part"), text('","price":'), price, text("}")))
    # Lines are dealt out by their numbers, which are shorter than the texts made of them.
    found = lines.repartition("l_orderkey").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(
        F.struct("l_linenumber", listing.alias("json")))), lambda e: e["json"]), ",").alias("items"))
    path = _folder(spark, "searches")
    found.select(F.concat(
        text('{"title":"order '), order, text('","site":"US","query":'), F.when(order % 11 == 0, '"first"').otherwise("0"),
        text(',"itemSummaries":['), F.col("items"), text("]}")).alias("value")).write.text(path)
    return readers.searches_intake(spark, path)


def search_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings that can be used from searches of which some are broken."""
    rows = listings.first_listings(_searches(spark, sf_dir).rows)
    return rows.select("title", "site", "item_id", "text", "value", "currency")


def search_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What could not be read of those searches, and where it stood."""
    return _noted("search", _searches(spark, sf_dir))


def _rates(spark: SparkSession, sf_dir: str) -> quarantine.Intake:
    """Rates of every day with orders, one XML a line: some days have a rate that is no number, lack a currency, have no
    date, or are cut short."""
    days = ad.table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
        F.pmod(F.count(F.lit(1)), F.lit(90)).alias("n"))
    d, text = F.unix_date("date"), F.lit
    rate = lambda name, value: F.concat(text(f'<Cube currency="{name}" rate="'), value, text('"/>'))
    number = F.concat(text("1."), (F.col("n") + 10).cast("string"))
    line = F.concat(
        text('<Envelope><Cube><Cube time="'), F.when(d % 19 == 0, "soon").otherwise(F.col("date").cast("string")), text('">'),
        rate("USD", number), rate("GBP", F.when(d % 13 == 0, "n/a").otherwise(number)), rate("PLN", number),
        F.when(d % 17 == 0, "").otherwise(rate("CHF", number)), rate("JPY", text("170")), text("</Cube></Cube></Envelope>"))
    path = _folder(spark, "rates")
    days.select(F.when(d % 23 == 0, F.substr(line, text(1), text(70))).otherwise(line).alias("value")).write.text(path)
    return readers.fx_intake(spark, path, whole=False)


def fx_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of the days whose every currency in use has a believable one."""
    return _rates(spark, sf_dir).rows.select(F.col("date").cast("string").alias("day"), "currency", "per_eur")


def fx_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose rates were refused, and why."""
    return _noted("rates", _rates(spark, sf_dir))


QUERIES = {f.__name__: f for f in (entry_items, imported_history, pairs_to_search, pinned_targets, run_changes, number_titles,
                                   kept_history, left_out_titles, catalog_threads, catalog_problems, search_listings,
                                   search_problems, fx_rates, fx_problems)}
