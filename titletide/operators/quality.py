"""Checks of inputs: each turns rows into problems, and never stops the rows that are fine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titletide import vocab
from titletide.functions import text as X

# How often a source type may be polled, in hours.
QUARTERS = (0.25, 0.5)


def good_interval(hours: Column) -> Column:
    return hours.isin(*QUARTERS) | ((hours == F.floor(hours)) & hours.between(1, 24))


def problems(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """keys, problem: one row for every rule a row breaks."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(*keys, F.explode(broken).alias("problem"))


def validate_sources(sources: DataFrame, roles: DataFrame) -> DataFrame:
    """position, problem of every configured source: type, name, switch, role, weight, id pattern, repeats.

    ``sources``: position, type, name, enabled, role, weight, channel_id, channel_url, subreddit, group, board, url.
    """
    known = roles.select(F.col("role"), F.lit(True).alias("has_role")).distinct()
    rows = sources.join(known, "role", "left")
    kind = F.col("type")
    fits = (
        F.when(kind == "youtube", F.when(F.col("channel_id").isNotNull(), F.col("channel_id").rlike(vocab.CHANNEL_ID))
               .otherwise(F.col("channel_url").rlike(vocab.CHANNEL_URL)))
        .when(kind == "reddit", F.col("subreddit").rlike(vocab.SUBREDDIT) & (F.trim("group") != ""))
        .when(kind == vocab.BOARD_TYPE, F.col("board").rlike(vocab.BOARD))
        .otherwise(F.col("url").rlike(vocab.FEED_URL))
    )
    typed = kind.isin(*vocab.SOURCE_TYPES)
    either = lambda ok: ~F.coalesce(typed, F.lit(False)) | ok
    rules = {
        "type": typed,
        "missing name": either(F.trim("name") != ""),
        "enabled": either(F.col("enabled").isNotNull()),
        "unknown role": either(F.coalesce("has_role", F.lit(False))),
        "weight": either(F.col("weight").isNull() | F.col("weight").between(0, 10)),
        "invalid id": either(fits),
    }
    key = X.source_key(kind, F.col("channel_id"), F.col("channel_url"), F.col("subreddit"), F.col("board"), F.col("url"))
    sound = rows.where(typed & fits).withColumn("key", key)
    firsts = sound.groupBy("key").agg(F.min("position").alias("first"))
    repeats = sound.join(firsts, "key").where(F.col("position") != F.col("first")).select(
        "position", F.lit("duplicate source").alias("problem"))
    return problems(rows, ["position"], rules).unionByName(repeats)


def validate_roles(roles: DataFrame) -> DataFrame:
    return problems(roles, ["role"], {"weight": F.col("weight").between(0, 10)})


def validate_intervals(intervals: DataFrame) -> DataFrame:
    return problems(intervals, ["type"], {
        "type": F.col("type").isin(*vocab.SOURCE_TYPES), "hours": good_interval(F.col("hours"))})


def validate_listed(entries: DataFrame, edition: bool = False) -> DataFrame:
    """Listed entries with ``search_name`` and ``problem`` (NULL when usable). ``entries``: title, search, require, exclude, allow."""
    said = F.coalesce("search", "title")
    name = X.search_name(said)
    texts = lambda c: F.forall(F.coalesce(c, F.array().cast("array<string>")), lambda t: t.isNotNull() & (X.words(t) != ""))
    none = F.size(F.coalesce("require", F.array().cast("array<string>"))) == 0
    junk = F.array(*[F.lit(p) for p in vocab.JUNK_PHRASES])
    allowed = F.size(F.array_except(F.coalesce("allow", F.array().cast("array<string>")), junk)) == 0
    needed = F.array_join(F.coalesce("require", F.array().cast("array<string>")), " ")
    problem = (
        F.when(X.key_of(F.coalesce("title", F.lit(""))) == "", "no title")
        .when(~texts(F.col("require")) | ~texts(F.col("exclude")) | ~allowed, "word lists")
        .when(F.lit(edition) & none, "edition without required words")
        .when(~name.contains(" ") & ~name.isin(*vocab.ONE_WORD_TITLES) & none, "ordinary word")
        .when((name == "") | (F.length(name) + F.length(needed) + 5 > 100), "search words")
    )
    return entries.withColumn("search_name", name).withColumn("problem", problem)


def validate_watchlist(pins: DataFrame) -> DataFrame:
    """position, problem of pinned titles: a title, words to look for, word lists, no title twice. Any problem is fatal
    to the caller. ``pins``: position, title, search, exclude."""
    said = F.coalesce("search", "title")
    key = X.key_of(F.coalesce("title", F.lit("")))
    rules = {
        "title": F.trim("title") != "",
        "search": X.words(said) != "",
        "too long": F.length(X.search_name(said)) + 4 <= 100,
        "exclude": F.forall(F.coalesce("exclude", F.array().cast("array<string>")), lambda t: t.isNotNull()),
    }
    firsts = pins.withColumn("key", key).where("key <> ''")
    first = firsts.groupBy("key").agg(F.min("position").alias("first"))
    repeats = firsts.join(first, "key").where(F.col("position") != F.col("first")).select(
        "position", F.lit("listed twice").alias("problem"))
    return problems(pins, ["position"], rules).unionByName(repeats)


def validate_consoles(consoles: DataFrame) -> DataFrame:
    """Consoles with ``problem`` (NULL when usable). ``consoles``: name, queries, require, require_any, sites."""
    queries = F.coalesce("queries", F.array().cast("array<string>"))
    model = F.size(F.coalesce("require", F.array().cast("array<string>"))) + F.size(
        F.coalesce("require_any", F.array().cast("array<string>")))
    fine = F.size(queries).between(1, 3) & F.forall(queries, lambda q: (X.words(q) != "") & (F.length(q) <= 100))
    return consoles.withColumn("problem", F.when(X.key_of(F.coalesce("name", F.lit(""))) == "", "no name").when(
        ~fine | (model == 0), "search"))
