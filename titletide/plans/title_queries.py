"""Named text and title queries over the warehouse tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titletide.functions import text as X
from titletide.operators import titles as tt
from titletide.operators import prices as pr
from titletide.session import cut_lineage, shared_folder
from titletide.sources import adapters as ad


def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document in its two evened-out forms, as digests."""
    rows = ad.texts(spark, sf_dir)
    return rows.select("doc_id", F.md5(X.normalise(F.col("text"))).alias("normalised"),
                       F.md5(X.words(F.col("text"))).alias("words"), F.md5(X.name_words(F.col("text"))).alias("name_words"))


def text_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tone, announcements, remaster wording (weak wording counts for labelled good texts) and platform context."""
    good = ad.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit(True).alias("good"))
    rows = ad.texts(spark, sf_dir).join(good, "doc_id", "left")
    return rows.select(
        "doc_id", X.tone(F.col("text")).cast("bigint").alias("tone"), X.hype(F.col("text")).cast("bigint").alias("hype"),
        X.is_remaster(F.col("text"), F.coalesce("good", F.lit(False))).alias("remaster"),
        X.has_context(F.col("text")).alias("context"))


def digital_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digital-only wording of every document's headline (rows only: the patterns look ahead)."""
    return ad.texts(spark, sf_dir).select("doc_id", X.is_digital_only(F.col("headline")).alias("digital"))


def article_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document read as an article (rows only: sentences are split by looking behind)."""
    rows = ad.texts(spark, sf_dir).select("doc_id", X.article_check(F.col("text")).alias("c"))
    return rows.select("doc_id", "c.is_game", "c.names_platform", F.array_join("c.collectible", ", ").alias("collectible"))


def headline_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortened headline, de-duplication key and story key of every document."""
    h = F.col("headline")
    return ad.texts(spark, sf_dir).select(
        "doc_id", X.shorten(h).alias("short"), X.headline_key(h).alias("key"),
        F.md5(F.array_join(X.story_key(h), " ")).alias("story"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page without its markup, as a feed body and as a post."""
    rows = ad.table(spark, sf_dir, "pages")
    return rows.select("page_id", F.md5(X.strip_tags(F.col("html"))).alias("body"),
                       F.md5(X.post_text(F.col("html"))).alias("post"),
                       F.md5(X.first_words(X.strip_tags(F.col("html")), 120)).alias("lead"))


def filed_name() -> Column:
    """A part's name as an index files it: article last, a numeral, a bracket."""
    numeral = F.element_at(F.array(*[F.lit(x) for x in ("", " II", " IV", " X", " 2")]), (F.col("p_size") % 5 + 1))
    return F.concat(F.initcap("p_name"), numeral, F.when(F.col("p_size") > 25, ", The").otherwise(""),
                    F.lit(": "), F.initcap("p_type"), F.when(F.col("p_size") > 40, " [Demo]").otherwise(""))


def title_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.settled(ad.table(spark, sf_dir, "part"), title=filed_name()).select("p_partkey", "title")
    rows = X.with_names(X.with_clean(rows, "title"), "title")
    return rows.select("p_partkey", "clean", "readable", "key", "name", X.loose_key(F.col("name")).alias("loose"),
                       F.array_join("queries", "|").alias("queries"))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ad.table(spark, sf_dir, "part")
    fetched = parts.where("p_size > 10").select(filed_name().alias("title"))
    cached = parts.where("p_size > 5").select(filed_name().alias("title"))
    return tt.build_library(fetched, cached, parts.select(F.col("p_name").alias("title")))


def siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles whose name stands inside another title's: part names, and names with their type and brand around."""
    parts = ad.table(spark, sf_dir, "part")
    names = parts.select(F.col("p_name").alias("title"))
    filed = parts.select(F.concat("p_name", F.lit(" "), F.lower("p_type"), F.when(F.col("p_size") > 25, " edition").otherwise("")).alias("title"))
    front = parts.where("p_size <= 10").select(F.concat(F.lower("p_type"), F.lit(" "), "p_name").alias("title"))
    catalogue = names.union(filed).union(front).distinct()
    return tt.sibling_titles(catalogue, names.select("title", X.search_name(F.col("title")).alias("name")).distinct())


def renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names under the names other sites know them by: one rule for each colour, a stricter one first."""
    parts = ad.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    heads = parts.select(F.split_part("name", F.lit(" "), F.lit(1)).alias("old")).distinct()
    whole = parts.where("name LIKE '%ring'").select(F.col("name").alias("old")).distinct()
    rules = heads.select(F.lit("UK").alias("site"), F.lit(2).alias("position"), "old", F.concat(F.lit("project "), "old").alias("new")).union(
        whole.select(F.lit("UK").alias("site"), F.lit(1).alias("position"), "old", F.concat("old", F.lit(" zero")).alias("new")))
    return tt.rename(parts, rules)


def title_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of one title over names of parts, their reversed, joined and padded forms."""
    return tt.title_groups(_spellings(spark, sf_dir))


def _spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ad.table(spark, sf_dir, "part")
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    form = (F.when(F.col("p_size") % 4 == 0, F.concat_ws(" ", b, F.lit("of"), a)).when(F.col("p_size") % 4 == 1, F.concat(a, b))
            .when(F.col("p_size") % 4 == 2, F.concat_ws(" ", a, b, F.lit("04"))).otherwise(F.concat_ws(" ", a, b, F.lit("4"))))
    keys = parts.select(form.alias("key")).union(parts.select("p_name"))
    return keys.groupBy("key").agg(F.lit(True).alias("official")).withColumn("file", F.lit(None).cast("string"))


def group_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The connected components behind the groups, each by its smallest spelling."""
    rows = _spellings(spark, sf_dir)
    return tt.components(rows, tt.spelling_edges(rows))


def brand_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers of a nation joined by equal balances to the hundred: the same operator on many nodes."""
    whole = lambda df, c, t: df.select(F.concat(F.lit(t), F.col(c)).alias("key"))
    c, s = ad.table(spark, sf_dir, "customer"), ad.table(spark, sf_dir, "supplier")
    nodes = c.select(F.col("c_name").alias("key"), F.floor(F.col("c_acctbal") / 100).alias("v"), F.col("c_nationkey").alias("k")).union(
        s.select("s_name", F.floor(F.col("s_acctbal") / 100), "s_nationkey"))
    hubs = nodes.groupBy("v", "k").agg(F.min("key").alias("b"))
    edges = nodes.join(hubs.hint("merge"), ["v", "k"]).select(F.col("key").alias("a"), "b").where("a <> b")
    return tt.components(nodes.select("key"), edges)


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands whose number ends in the same digit as spellings of one title."""
    return ad.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("title"), F.concat(F.lit("g"), F.right("p_brand", F.lit(1))).alias("root")).distinct()


def _tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.sum("p_size") % 4
    level = F.when(size == 0, "dormant").when(size == 1, "surging").when(size == 2, "normal").otherwise("staple")
    return ad.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("title")).agg(
        level.alias("level"), (F.min("p_size") > 1).alias("pinned"), F.lit(False).alias("special"),
        F.count(F.lit(1)).alias("mentions"))


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(pr.latest_of(ad.history(spark, sf_dir)).withColumn("unmatched", F.lit(False)))


def spelling_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tt.merge_spellings(_tracked(spark, sf_dir), _latest(spark, sf_dir), _groups(spark, sf_dir))


def spelling_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q12: the merged spellings' own figures beside their keeper's, first of each group as the keeper."""
    groups = _groups(spark, sf_dir)
    keepers = groups.groupBy("root").agg(F.min("title").alias("keeper"))
    merged = groups.join(keepers, "root").where("title <> keeper").select(F.col("title").alias("spelling"), "keeper")
    latest = _latest(spark, sf_dir)
    return tt.audit_spellings(merged, latest, latest).withColumn("copies", F.col("copies").cast("bigint")).withColumn(
        "keeper_copies", F.col("keeper_copies").cast("bigint"))


def audited_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second of two runs of the audit loop: both merge by each brand's first figures, and the audit between them looks
    at the newest, so spellings that came to list clearly more than their keeper stand for themselves again."""
    history = ad.history(spark, sf_dir)
    first = cut_lineage(history.groupBy("title", "site").agg(F.min_by("copies", F.struct("period", "stamp")).alias("copies")))
    path = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    runs = [tt.audited_merge(path, _tracked(spark, sf_dir), _groups(spark, sf_dir), first, _latest(spark, sf_dir)) for _ in range(2)]
    return runs[-1].select("title", "keeper", "outcome")


def genre_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A genre for every part name, by majority of its parts' types."""
    kind = ad.lookup({"ECONOMY": "Racing", "SMALL": "Racing / Arcade", "MEDIUM": "Puzzle", "LARGE": "Sing",
                      "PROMO": "Unheard of"}, F.col("p_type"))
    votes = ad.table(spark, sf_dir, "part").select(
        F.col("p_name").alias("key"), F.coalesce(kind, F.lit("Gun")).alias("genre"), F.col("p_partkey").alias("position"))
    return tt.majority(votes.withColumn("genre", X.genre_bucket(F.col("genre"))))


def keyword_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The genre each document's whole text gives away, read as a key."""
    rows = X.settled(ad.texts(spark, sf_dir), key=X.words(F.col("text")))
    return rows.select("doc_id", X.keyword_genre(F.col("key")).alias("genre"))


def extra_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of small parts that big parts do not track yet, from the library of all."""
    parts = ad.table(spark, sf_dir, "part").select(F.col("p_name").alias("title"), "p_size")
    return tt.add_titles(parts.where("p_size > 49"), parts.where("p_size < 10"), parts, "underrated")


def collection_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ad.table(spark, sf_dir, "part").select(F.col("p_name").alias("title"), "p_size")
    names = parts.where("p_size < 25").select(X.search_name(F.col("title")).alias("name"))
    return tt.resolve_keys(names, parts.select("title"), parts.where("title LIKE 'old%'"))


def listed_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed entries (one a part) placed among the titles tracked on a site."""
    parts = ad.table(spark, sf_dir, "part")
    entries = parts.select(F.lit("PAL").alias("list"), F.col("p_partkey").alias("rank"), F.lit("UK").alias("site"),
                           F.col("p_name").alias("title"), F.concat("p_name", F.lit(" zero")).alias("search"),
                           F.when(F.col("p_size") > 40, F.array(F.lit("edition"))).alias("require"))
    tracked = parts.where("p_name LIKE '%ring' OR p_name LIKE 'hot%'").select(F.initcap("p_name").alias("title"), F.col("p_name").alias("name"))
    titles = tracked.distinct().withColumn("site", F.lit("UK")).withColumn(
        "search", F.when(F.col("name").endswith("ring"), F.concat("name", F.lit(" zero"))).otherwise(F.col("name")))
    return tt.place_listed(entries, titles)


def fresh_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the labelled documents with every document's headline merged in."""
    texts = ad.texts(spark, sf_dir).select("doc_id", "headline", "source")
    done = texts.join(ad.table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    merged = tt.merge_labels(done.select("headline", "source"), texts.select("headline", "source"))
    return merged.groupBy("fresh", "source").agg(F.count(F.lit(1)).alias("n"))


def lost_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as a multiset, without those of the small parts."""
    parts = ad.table(spark, sf_dir, "part")
    left = tt.multiset_diff(parts.select("p_name"), parts.where("p_size < 30").select("p_name"))
    return left.groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))


def typo_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with a letter doubled, matched back to the names (rows only)."""
    names = ad.table(spark, sf_dir, "part").select("p_name").distinct()
    broken = names.select(F.concat(F.substring("p_name", 1, 2), F.expr("substring(p_name, 2)")).alias("key"))
    return tt.typo_match(broken, names.select(F.col("p_name").alias("spelling")))


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling that no part name has, by the rule that finds its name (rows only)."""
    names = ad.table(spark, sf_dir, "part").select(F.col("p_name").alias("key")).distinct()
    return tt.alias_cascade(_spellings(spark, sf_dir), names)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part name the most similar of its candidate articles: the names of its own and the next parts (rows only)."""
    parts = ad.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    slots = parts.select(F.initcap("p_name").alias("title"), F.posexplode(F.array(
        "p_partkey", F.col("p_partkey") + 1, F.col("p_partkey") - 1)).alias("position", "p_partkey"))
    found = parts.select("p_partkey", F.concat(F.initcap("p_name"), F.lit(" (video game)")).alias("article"))
    return tt.resolve_articles(slots.join(found, "p_partkey").select("title", "article", "position"))


def headline_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of headlines over the buckets (rows only)."""
    rows = ad.texts(spark, sf_dir).select("headline", "source", F.array().cast("array<string>").alias("titles"))
    return tt.quota_sample(rows, 150, 7).drop("titles")


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as release files of several regions, best release of each (rows only)."""
    tag = F.element_at(F.array(*[F.lit(x) for x in ("USA", "Europe", "Japan", "UK", "Canada")]), F.col("p_size") % 5 + 1)
    files = ad.table(spark, sf_dir, "part").select(F.concat(
        F.initcap("p_name"), F.lit(" ("), tag, F.lit(")"), F.when(F.col("p_type") == "PROMO", " (Demo)").otherwise("")).alias("name"))
    return tt.best_releases(files)


QUERIES = {f.__name__: f for f in (
    text_forms, text_tone, digital_flags, article_checks, headline_forms, page_text, title_forms, library, siblings, renames,
    title_groups, group_roots, brand_components, spelling_merge, spelling_audit, audited_merge, genre_votes, keyword_genres, extra_titles,
    collection_keys, listed_places, fresh_labels, lost_mentions, typo_titles, aliases, articles, headline_sample, releases)}
