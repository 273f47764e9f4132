"""Marketplace listings: which ones count as a copy of a title, and the figures of those that do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titletide import vocab
from titletide.config import DEFAULTS, SITES, Settings
from titletide.functions import text as X
from titletide.functions.numbers import cheapest_postage, pennies, price_of
from titletide.operators.medians import median_of_counts, penny_counts, top_k


def first_listings(rows: DataFrame) -> DataFrame:
    """One row per listing of a title and site, each listing once over the title's queries; the first query wins.

    ``rows``: title, site, query, pos, item.
    """
    identity = F.coalesce("item.itemId", "item.legacyItemId", F.concat_ws(":", "query", "pos"))
    return (
        rows.groupBy("title", "site", identity.alias("item_id"))
        .agg(F.min_by("item", F.struct("query", "pos")).alias("item"))
        .select(
            "title", "site", "item_id",
            F.col("item.title").alias("text"),
            F.col("item.price.value").alias("value"),
            F.col("item.price.currency").alias("currency"),
            F.transform("item.shippingOptions", lambda o: F.struct(
                o["shippingCost"]["value"].alias("cost"), o["shippingCost"]["currency"].alias("currency"))
            ).alias("postage_options"),
            F.col("item.legacyItemId").alias("legacy_id"),
            F.col("item.itemWebUrl").alias("url"),
            F.col("item.condition").alias("condition"),
            F.col("item.itemCreationDate").alias("listed"),
        )
    )


# ---------------------------------------------------------------------------------------------
# tests on the words of a listing; ``text`` and ``phrase`` are evened-out names
# ---------------------------------------------------------------------------------------------


def _after(text: Column, phrase: Column) -> Column:
    """What follows the phrase's first place in the text, or NULL when it is not there."""
    wide = X.padded(text)
    at = F.position(X.padded(phrase), wide)
    return F.when((phrase != "") & (at > 0), F.trim(F.substr(wide, at + F.length(phrase) + 2)))


def names_this(text: Column, phrase: Column) -> Column:
    """The phrase stands in the text and does not run on into another single number (a disc count or a score may)."""
    rest = F.regexp_replace(_after(text, phrase), "^plus(?: |$)", "")
    discs = "|".join(vocab.DISC_WORDS)
    sequel = rest.rlike("^[1-9](?: |$)") & ~rest.rlike(f"^[1-9] (?:{discs}|10)(?: |$)")
    return F.coalesce(~sequel, F.lit(False))


def names_other_entry(text: Column, phrase: Column) -> Column:
    """A numbered title's listing that also names another number of the series."""
    number = F.regexp_extract(phrase, r" (\d+)$", 1)
    stem = F.regexp_replace(phrase, r" \d+$", "")
    marked = F.replace(X.padded(text), X.padded(stem), F.lit("\u0001"))
    found = F.regexp_extract_all(marked, F.lit("\u0001(\\d{1,2})(?=[ \u0001]|$)"), 1)
    return (number != "") & F.exists(found, lambda n: n != number)


def comes_with(title: Column, phrase: str) -> Column:
    """The title says the copy comes with the thing."""
    words = r"\s+".join(phrase.split())
    return F.lower(F.coalesce(title, F.lit(""))).rlike("(?U)" + vocab.COMES_WITH + words + r"\b")


def is_soundtrack(title: Column, name_text: Column, phrase: Column) -> Column:
    """The listing is the title's soundtrack, not a copy that comes with it."""
    lead = "|".join(vocab.SOUNDTRACK_LEAD_INS)
    sold = "|".join(vocab.SOUNDTRACK_WORDS)
    said = _after(name_text, phrase).rlike(f"^(?:(?:{lead}) )*(?:{sold})(?: |$)")
    return F.coalesce(said, F.lit(False)) & ~F.coalesce(title, F.lit("")).rlike(vocab.SOUNDTRACK_INCLUDED)


def respaced(text: Column, phrase: Column) -> Column:
    """The text with a differently spaced spelling of the phrase put right, or NULL when there is none.

    Only a word of five or more letters may be written as two or three words, so the phrase becomes one
    pattern in which those words may hold up to two spaces.
    """
    def loose(token: Column) -> Column:
        letters = F.array_join(F.split(token, "(?!^)(?!$)"), " ?")
        return F.when((F.length(token) >= 5) & token.rlike("^[a-z]+$"), letters).otherwise(token)

    pattern = F.concat(F.lit("(?<= )"), F.array_join(F.transform(F.split(phrase, " ", -1), loose), " "), F.lit("(?= )"))
    hits = F.slice(F.filter(F.regexp_extract_all(X.padded(text), pattern, F.lit(0)), lambda h: h != phrase), 1, 1)
    # No word may be split into more than three parts. The pattern is made and tried once, hence the list of one.
    few = lambda hit: F.length(hit) - F.length(phrase) <= 2 * F.size(F.split(phrase, " ", -1))
    glued = F.transform(hits, lambda hit: F.when(few(hit), F.trim(F.replace(X.padded(text), X.padded(hit), X.padded(phrase)))))
    # Without its spaces the text has the phrase's letters in a row.
    return F.when((phrase != "") & F.contains(X.compact(text), X.compact(phrase)), F.try_element_at(glued, F.lit(1)))


def near_miss(text: Column, phrase: Column, siblings: Column) -> Column:
    """Why a listing left out as another title still looks like this one; NULL when it looks like nothing."""
    wanted = F.split(phrase, " ", -1)
    present = F.size(F.filter(wanted, lambda t: F.array_contains(F.split(text, " ", -1), t)))
    several = F.size(wanted) > 1
    return (
        F.when(X.has_phrase(text, phrase) | names_other_entry(text, phrase), "number")
        .when(X.has_phrase_in(text, siblings), "sibling")
        .when(several & (present == F.size(wanted)), "scattered")
        .when(several & (present >= F.greatest(F.lit(2), F.floor((F.size(wanted) + 1) / 2))), "partial")
    )


def listing_link(site: Column, legacy_id: Column, url: Column) -> Column:
    """A plain link to the listing on its own site, or NULL."""
    rule = None
    for name, host, *_ in SITES:
        link = F.when(legacy_id.rlike("^[0-9]+$"), F.concat(F.lit(f"https://{host}/itm/"), legacy_id)).when(
            F.startswith(url, F.lit(f"https://{host}/")), url)
        rule = F.when(site == name, link) if rule is None else rule.when(site == name, link)
    return rule


def _by_site(site: Column, wide: Column, lists: dict[str, tuple[str, ...]]) -> Column:
    """Whether the padded text has one of its own site's phrases."""
    rule = F.lit(False)
    for name, phrases in lists.items():
        rule = F.when(site == name, X.holds_any(wide, phrases)).otherwise(rule)
    return rule


# ---------------------------------------------------------------------------------------------
# classification
# ---------------------------------------------------------------------------------------------


def with_reasons(listings: DataFrame, sealed_ok: bool = False) -> DataFrame:
    """Listings with ``reason`` (NULL when the listing counts), ``price``, ``postage``, ``link``, ``confirmed`` and ``near``.

    Needs: site, text, value, currency, site_currency, postage_options, legacy_id, url, and of the title looked
    for: search, siblings, require, exclude, allow (arrays), keyword (bool).
    """
    rows = (
        listings.withColumn("word_text", X.words(F.col("text")))
        .withColumn("wide", X.padded(F.col("word_text")))  # many tests read it
        .withColumn("name_text", X.even_names(F.col("word_text")))
        .withColumn("bare", X.the_less(F.col("name_text")))
        .withColumn("wanted", X.the_less(F.col("search")))
        .withColumn("named", names_this(F.col("bare"), F.col("wanted")))
        .withColumn("bare", F.when(F.col("named"), F.col("bare")).otherwise(
            F.coalesce(respaced(F.col("bare"), F.col("wanted")), F.col("bare"))))
        .withColumn("price", price_of(F.col("value"), F.col("currency"), F.col("site_currency")))
        .withColumn("postage", cheapest_postage(F.col("postage_options"), F.col("site_currency")))
        .withColumn("link", listing_link(F.col("site"), F.col("legacy_id"), F.col("url")))
    )
    words, wide, bare, wanted, site = F.col("word_text"), F.col("wide"), F.col("bare"), F.col("wanted"), F.col("site")
    siblings = F.transform(F.coalesce("siblings", F.array().cast("array<string>")), X.the_less)
    require = F.transform(F.coalesce("require", F.array().cast("array<string>")), X.the_less)
    other = (
        (F.col("keyword") & ~words.rlike(vocab.PLATFORM_WORDS))
        | ~(F.col("named") | names_this(bare, wanted))
        | names_other_entry(bare, wanted)
        | X.has_phrase_in(bare, siblings)
        | ~F.forall(require, lambda p: X.has_phrase(bare, p))
    )
    allow = F.coalesce("allow", F.array().cast("array<string>"))
    all_junk = F.lit(False)
    for phrase in vocab.JUNK_PHRASES:
        pardoned = F.array_contains(allow, phrase) & comes_with(F.col("text"), phrase)
        all_junk = all_junk | (X.holds_any(wide, [phrase]) & ~pardoned)
    junk = F.when(F.size(allow) == 0, X.holds_any(wide, vocab.JUNK_PHRASES)).otherwise(all_junk)
    not_a_copy = (
        junk
        | _by_site(site, wide, vocab.SITE_JUNK)
        | X.has_phrase_in(words, F.col("exclude"))
        | is_soundtrack(F.col("text"), F.col("name_text"), F.col("search"))
    )
    graded = X.holds_any(wide, vocab.GRADED_OR_SEALED) & ~X.holds_any(wide, vocab.NOT_GRADED)
    foreign = X.holds_any(wide, vocab.IMPORT_PHRASES) | _by_site(site, wide, vocab.FOREIGN)
    incomplete = X.holds_any(wide, vocab.INCOMPLETE_PHRASES) | _by_site(site, wide, vocab.SITE_INCOMPLETE)
    reason = (
        F.when(other, "other_game")
        .when(X.holds_any(wide, vocab.OTHER_PLATFORMS), "other_platform")
        .when(not_a_copy, "not_a_copy")
        .when(graded & F.lit(not sealed_ok), "graded_or_sealed")
        .when(foreign, "import")
        .when(incomplete, "incomplete")
        .when(F.col("price").isNull(), "no_price")
        .when(F.col("link").isNull(), "no_link")
    )
    return (
        X.settled(rows, reason=reason, confirmed=X.holds_any(wide, vocab.COMPLETE_PHRASES))
        .withColumn("near", F.when(F.col("reason") == "other_game", near_miss(X.the_less(F.col("name_text")), wanted, siblings)))
        .drop("wide", "named", "bare", "wanted")
    )


def console_reasons(listings: DataFrame) -> DataFrame:
    """Hardware listings with ``reason``. Needs: site, text, value, currency, site_currency, legacy_id, url,
    require, require_any, exclude."""
    words, wide = F.col("word_text"), F.col("wide")
    parts = F.lit(False)
    for part in vocab.CONSOLE_PARTS:
        parts = parts | (X.holds_any(wide, [part]) & ~comes_with(F.col("text"), part))
    rows = (
        listings.withColumn("word_text", X.words(F.col("text")))
        .withColumn("wide", X.padded(F.col("word_text")))
        .withColumn("price", price_of(F.col("value"), F.col("currency"), F.col("site_currency")))
        .withColumn("link", listing_link(F.col("site"), F.col("legacy_id"), F.col("url")))
    )
    model = F.forall("require", lambda p: X.has_phrase(words, p)) & (
        (F.size("require_any") == 0) | X.has_phrase_in(words, F.col("require_any")))
    reason = (
        F.when(~model, "other_game")
        .when(X.holds_any(wide, vocab.OTHER_CONSOLES), "other_platform")
        .when(X.holds_any(wide, vocab.CONSOLE_JUNK) | X.has_phrase_in(words, F.col("exclude")), "not_a_copy")
        .when(parts & ~X.holds_any(wide, vocab.CONSOLE_WORDS), "not_a_copy")
        .when(F.col("price").isNull(), "no_price")
        .when(F.col("link").isNull(), "no_link")
    )
    return X.settled(rows, reason=reason).drop("wide")


# ---------------------------------------------------------------------------------------------
# figures
# ---------------------------------------------------------------------------------------------


def summarise(classified: DataFrame, keys: list[str] = ["title", "site"]) -> DataFrame:
    """Per title and site: status, fetched, counted, lowest, median, postage figures and confirmed figures."""
    # One pass over the listings: each says what became of it and, when it counts, the amounts of three figures.
    kept = F.col("reason").isNull()
    fact = lambda name, amount: F.struct(name.alias("figure"), amount.cast("double").alias("amount"))
    facts = classified.select(*keys, F.inline(F.array(
        fact(F.concat(F.lit("listing "), F.coalesce("reason", F.lit("counted"))), F.lit(None)),
        fact(F.when(kept, "price"), F.col("price")),
        fact(F.when(kept & F.col("postage").isNotNull(), "postage"), F.col("postage")),
        fact(F.when(kept & F.col("confirmed"), "confirmed"), F.col("price")),
    ))).where("figure IS NOT NULL")
    counts = penny_counts(facts, [*keys, "figure"], F.col("amount"))
    figures = median_of_counts(counts, [*keys, "figure"])
    n_of = lambda hit: F.coalesce(F.sum(F.when(hit, F.col("copies"))), F.lit(0))
    of = lambda name, c: F.max(F.when(F.col("figure") == name, F.col(c)))
    wide = figures.groupBy(*keys).agg(
        n_of(F.col("figure").startswith("listing ")).alias("fetched"),
        n_of(F.col("figure") == "listing counted").alias("counted"),
        n_of(F.col("figure") == "listing other_game").alias("others"),
        of("price", "lowest").alias("lowest"),
        of("price", "median").alias("median"),
        n_of(F.col("figure") == "postage").alias("postage_known"),
        of("postage", "median").alias("median_postage"),
        n_of(F.col("figure") == "confirmed").alias("confirmed_counted"),
        of("confirmed", "median").alias("confirmed_median"),
    )
    status = F.when(F.col("counted") > 0, "ok").when(F.col("others") == F.col("fetched"), "unmatched").otherwise("none")
    return wide.select(
        *keys, status.alias("status"), "fetched", "counted", "lowest", "median", "postage_known", "median_postage",
        "confirmed_counted", "confirmed_median")


def skipped(classified: DataFrame, keys: list[str] = ["title", "site"]) -> DataFrame:
    """Per title, site and reason: how many listings were left out."""
    return classified.where("reason IS NOT NULL").groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))


def skipped_map(classified: DataFrame, keys: list[str] = ["title", "site"]) -> DataFrame:
    """The same as one map a pair; a pair has at most eight reasons."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n"))))
    return skipped(classified, keys).groupBy(*keys).agg(entries.alias("skipped"))


def numbers_of(summary: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The figures that are kept: none when unmatched; ``complete`` only when three or more, but not all, say so."""
    known = F.col("status") != "unmatched"
    complete = known & F.col("confirmed_counted").between(settings.confirmed_min, F.col("counted") - 1)
    keep = lambda c: F.when(known, F.col(c)).alias(c)
    return summary.select(
        "title", "site", (~known).alias("unmatched"),
        F.when(known, F.col("counted")).alias("copies"), keep("lowest"), keep("median"),
        F.when(known, F.col("median_postage")).alias("postage"),
        F.when(known, F.col("fetched")).alias("listed"),
        F.when(complete, F.col("confirmed_counted")).alias("complete_copies"),
        F.when(complete, F.col("confirmed_median")).alias("complete_median"),
    )


def cheapest_kept(classified: DataFrame, k: int = DEFAULTS.listings_kept) -> DataFrame:
    """The k cheapest counted listings of each pair."""
    return top_k(classified.where("reason IS NULL"), ["title", "site"], [F.col("price"), F.col("link")], k)


def skipped_examples(classified: DataFrame, k: int = DEFAULTS.skipped_examples) -> DataFrame:
    """k left-out listing titles per pair and reason."""
    rows = classified.where("reason IS NOT NULL").withColumn("example", X.squash(F.col("text")))
    return top_k(rows, ["title", "site", "reason"], [F.col("item_id")], k)


def near_misses(classified: DataFrame, summary: DataFrame) -> DataFrame:
    """title, site, near, n for the pairs that counted nothing."""
    empty = summary.where("counted = 0").select("title", "site")
    return (
        classified.where("near IS NOT NULL")
        .groupBy("title", "site", "near")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(empty, ["title", "site"], "left_semi")
    )


def two_pass(first: DataFrame, second: DataFrame) -> DataFrame:
    """The search by item specifics, and the keyword search's rows for the pairs whose first search was empty or
    found no copy of the title (unless the second does no better)."""
    a = first.groupBy("title", "site").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason") == "other_game").alias("others"))
    b = second.groupBy("title", "site").agg(
        F.count(F.lit(1)).alias("n2"), F.count_if(F.col("reason") == "other_game").alias("others2"))
    missed = F.col("n").isNull() | (F.col("n") == F.col("others"))
    better = F.col("n").isNull() | ~(F.col("n2") == F.col("others2"))
    swap = b.join(a, ["title", "site"], "left").where(missed & better).select("title", "site")
    return first.join(swap, ["title", "site"], "left_anti").unionByName(
        second.join(swap, ["title", "site"], "left_semi"))
