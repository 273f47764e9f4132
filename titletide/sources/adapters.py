"""Views that put the warehouse tables into the engine's own shapes, so the same operators serve both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titletide.functions import text as X
from titletide.functions.numbers import pennies
from titletide.operators.medians import group_medians

# Which marketplace and currency each region stands for.
SITE_OF_REGION = {"AMERICA": "US", "EUROPE": "UK", "ASIA": "DE", "AFRICA": "FR", "MIDDLE EAST": "IT"}
CURRENCY_OF_SITE = {"US": "USD", "UK": "GBP", "DE": "EUR", "FR": "EUR", "IT": "EUR", "ES": "EUR"}
# Which source type each kind of event stands for.
TYPE_OF_EVENT = {"error": "news", "click": "reddit", "view": "youtube", "signup": "forum", "purchase": "podcast"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt to as many partitions as ``spark.titletide.partitions`` says, and as they are where it is unset: a
    local run over single small files would else work on one core."""
    partitions = df.sparkSession.conf.get("spark.titletide.partitions", None)
    return df.repartition(int(partitions)) if partitions else df


def lookup(pairs: dict[str, str], c: Column) -> Column:
    rule = None
    for key, value in pairs.items():
        rule = F.when(c == key, value) if rule is None else rule.when(c == key, value)
    return rule


def month_number(c: Column) -> Column:
    return (F.year(c) * 12 + F.month(c) - 1).cast("int")


def supplier_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_suppkey, site, currency."""
    site = lookup(SITE_OF_REGION, F.col("r_name"))
    sites = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), site.alias("site"),
                lookup(CURRENCY_OF_SITE, site).alias("currency"))
    )
    return sites


def priced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """title, site, currency, price, stamp: every sold line as an asking price of its brand."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_shipdate", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("title"))
    return (
        lines.join(brands, "l_partkey")
        .join(supplier_sites(spark, sf_dir), "l_suppkey")
        .select("title", "site", "currency", "price", F.col("l_shipdate").alias("stamp"))
    )


def history(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """stamp, title, site, period, copies, lowest, median: one figure per brand, site and month (or day)."""
    lines = priced_lines(spark, sf_dir)
    period = (month_number(F.col("stamp")) if unit == "month"
              else F.unix_date(F.col("stamp").cast("date")))
    figures = group_medians(lines.withColumn("period", period), ["title", "site", "period"], F.col("price"))
    stamp = (F.make_date(F.floor(F.col("period") / 12).cast("int"), F.pmod("period", F.lit(12)) + 1, F.lit(1))
             if unit == "month" else F.date_from_unix_date("period"))
    return figures.select(stamp.cast("timestamp_ntz").alias("stamp"), "title", "site", "period",
                          F.col("copies").cast("int").alias("copies"), "lowest", "median")


def rare_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """list, site, title, copies: both rare lists hold every brand; the estimate is fifty copies a size unit."""
    lists = F.explode(F.array(F.struct(F.lit("PAL").alias("list"), F.lit("UK").alias("site")),
                              F.struct(F.lit("US").alias("list"), F.lit("US").alias("site"))))
    return (
        table(spark, sf_dir, "part")
        .groupBy(F.col("p_brand").alias("title"))
        .agg((F.sum("p_size") * 50).alias("copies"))
        .withColumn("l", lists)
        .select("l.list", "l.site", "title", "copies")
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an item of a feed that names one title."""
    return items_of(table(spark, sf_dir, "events"))


def items_of(events: DataFrame) -> DataFrame:
    """Events, stored or streamed, as items."""
    kind = lookup(TYPE_OF_EVENT, F.col("event_type"))
    k = F.get_json_object("props", "$.k")
    title = F.concat(F.lit("title "), k)
    day = F.date_format("ts", "yyyy-MM-dd")
    return events.select(
        "event_id",
        F.concat(F.lit("note "), k, F.lit(" of "), F.col("event_type")).alias("headline"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("source"),
        kind.alias("source_type"),
        F.concat(kind, F.lit(":"), F.col("user_id").cast("string")).alias("feed"),
        F.concat(F.lit("https://feeds.example/"), kind, F.lit("/"), k, F.lit("/"), day).alias("link"),
        F.when(F.col("value") >= 2, F.array(title)).otherwise(F.array().cast("array<string>")).alias("matched_games"),
        F.when(F.col("event_type") == "signup", "body").otherwise("title").alias("matched_in"),
        F.when(F.col("event_type") == "error", "fuzzy").otherwise("exact").alias("match_method"),
        (F.col("value") >= 20).alias("is_remaster_rumor"),
        (F.col("value") < 1).alias("is_digital_only"),
        F.when(kind == "youtube", F.floor("value").cast("bigint")).alias("views"),
        "ts",
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, headline (the first line), body (the other lines), text, source, lang."""
    t = F.col("text")
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")).select(
        "doc_id",
        F.split_part(t, F.lit("\n"), F.lit(1)).alias("headline"),
        F.when(t.contains("\n"), F.regexp_replace(t, "^[^\n]*\n", "")).otherwise("").alias("body"),
        "text", "source", "lang",
    )


def now(spark: SparkSession, sf_dir: str) -> Column:
    """The newest event's time stands for the clock."""
    return table(spark, sf_dir, "events").agg(F.max("ts")).scalar()


def pageviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article, day, views: whole event value of each title and day."""
    title = F.concat(F.lit("title "), F.get_json_object("props", "$.k"))
    return (
        table(spark, sf_dir, "events")
        .groupBy(title.alias("article"), F.col("ts").cast("date").alias("day"))
        .agg(F.sum(F.floor("value")).alias("views"))
    )


def searches_spent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, level, site, title, searches: every order as one search for its customer."""
    site = lookup(SITE_OF_REGION, F.col("r_name"))
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderpriority").alias("level"),
                site.alias("site"), F.col("c_name").alias("title"), F.lit(1).alias("searches"))
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sold line as a marketplace listing of its part's name, its wording set by its own flags.

    The line's number says how the seller words it, its return flag whether it is complete, and its status
    whether the currency is the site's own.
    """
    lines = spread(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate"))
    # What follows from the name alone is worked out once a part, not once a line.
    parts = X.with_names(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type"), "p_name").select(
        "l_partkey", "p_name", "p_type", F.col("name").alias("search"))
    number = F.col("l_linenumber")
    wording = (
        F.when(number == 1, "ps2")
        .when(number == 2, "2 ps2")
        .when(number == 3, "ps2 japanese import")
        .when(number == 4, "PS2 + soundtrack")
        .when(number == 5, "Playstation 2 factory sealed")
        .when(number == 6, "xbox edition")
        .otherwise("soundtrack")
    )
    state = F.when(F.col("l_returnflag") == "A", "complete, with manual").when(
        F.col("l_returnflag") == "R", "disc only").otherwise("good")
    extra = F.when(F.col("p_type") == "PROMO", " bundle").otherwise("")
    value = pennies(F.col("l_extendedprice") / F.col("l_quantity")) / 100.0
    return (
        lines.join(parts, "l_partkey")
        .join(supplier_sites(spark, sf_dir), "l_suppkey")
        .select(
            F.col("p_name").alias("title"), "site",
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("item_id"),
            F.concat(F.initcap("p_name"), F.lit(" "), wording, F.lit(" - "), state, extra).alias("text"),
            value.cast("string").alias("value"),
            F.when((F.col("l_linestatus") == "F") & (F.col("l_tax") == 0), "CHF").otherwise(F.col("currency")).alias("currency"),
            F.col("currency").alias("site_currency"),
            F.array(F.struct(F.round(F.col("l_discount") * 100, 2).cast("string").alias("cost"),
                             F.col("currency").alias("currency"))).alias("postage_options"),
            F.when(F.col("l_discount") > 0, F.col("l_orderkey").cast("string")).alias("legacy_id"),
            F.lit(None).cast("string").alias("url"),
            F.lit("Used").alias("condition"),
            F.col("l_shipdate").alias("listed"),
            "search",
            F.when(F.col("p_name").startswith("new "), F.array(F.lit("ring edition"))).alias("siblings"),
            F.lit(None).cast("array<string>").alias("require"),
            F.when(F.col("p_name").endswith(" rod"), F.array(F.lit("good"))).alias("exclude"),
            F.when(F.col("p_name").endswith(" gear"), F.array(F.lit("bundle"))).alias("allow"),
            (F.col("site") != "US").alias("keyword"),
        )
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account, game, region, condition, currency, price, month: every sold line as a price its customer reports."""
    condition = F.when(F.col("l_returnflag") == "A", "complete").when(
        F.col("l_returnflag") == "R", "loose").otherwise("sealed")
    region = F.when(F.col("site") == "US", "US").otherwise("PAL")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return (
        lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
        .join(supplier_sites(spark, sf_dir), "l_suppkey")
        .select(F.col("o_custkey").alias("account"),
                F.lower(F.replace("p_brand", F.lit("#"), F.lit(" "))).alias("game"), region.alias("region"),
                condition.alias("condition"), "currency", "price", F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    )


def owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account, game, sealed, complete, loose: how many lines of each condition a customer bought of a brand."""
    rows = reports(spark, sf_dir)
    n = lambda c: F.least(F.lit(99), F.count_if(F.col("condition") == c)).cast("bigint").alias(c)
    return rows.groupBy("account", "game").agg(n("sealed"), n("complete"), n("loose"))
