"""Text functions: each takes Columns and returns a Column, built only from JVM-side expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titletide import vocab

# ---------------------------------------------------------------------------------------------
# small building blocks
# ---------------------------------------------------------------------------------------------


def unicode_rlike(c: Column, pattern: str) -> Column:
    """Case-insensitive search whose word boundaries and classes follow Unicode."""
    return F.coalesce(c, F.lit("")).rlike("(?iU)" + pattern)


def squash(c: Column) -> Column:
    """One space between words, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def tokens(c: Column) -> Column:
    """The words of a space-separated text; an empty text has none."""
    return F.filter(F.split(c, " ", -1), lambda t: t != "")


def padded(c: Column) -> Column:
    return F.concat(F.lit(" "), c, F.lit(" "))


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """The rows with costly columns added behind a generator, so that later filters on them are neither pushed
    below nor worked out a second time."""
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def one_of(phrases: Iterable[str]) -> str:
    """An alternation of literal word phrases (letters, digits and spaces only), shared beginnings written once, so
    that a place in a text is tried against a few first letters and not against every phrase."""
    tails: dict[str, set[str]] = {}
    for phrase in phrases:
        tails.setdefault(phrase[:1], set()).add(phrase[1:])
    branches = []
    for head, rest in sorted(tails.items()):
        if head:
            branches.append(head + (one_of(rest) if len(rest) > 1 else next(iter(rest))))
    return "(?:" + "|".join(branches) + ")" + ("?" if "" in tails else "")


def has_any(c: Column, phrases: Iterable[str]) -> Column:
    """Whether one of the fixed phrases stands in the text as whole words."""
    return holds_any(padded(c), phrases)


def holds_any(wide: Column, phrases: Iterable[str]) -> Column:
    """The same for a text that is padded already."""
    phrases = tuple(phrases)
    return wide.rlike(" " + one_of(phrases) + " ") if phrases else F.lit(False)


def has_phrase(c: Column, phrase: Column) -> Column:
    """Whether the phrase of the same row stands in the text as whole words."""
    return (phrase != "") & F.contains(padded(c), padded(phrase))


def has_phrase_in(c: Column, phrases: Column) -> Column:
    """Whether any phrase of an array column stands in the text as whole words."""
    wide = padded(c)
    return F.exists(
        F.coalesce(phrases, F.array().cast("array<string>")),
        lambda p: (p != "") & F.contains(wide, padded(p)),
    )


def mapped(token: Column, table: Mapping[str, str]) -> Column:
    """The table's entry for a token, or the token itself."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, token), token)


def _numerals(c: Column, table: Mapping[str, str]) -> Column:
    """Roman numerals of a space-separated text as digits; texts without one are left alone."""
    swapped = F.array_join(F.transform(F.split(c, " ", -1), lambda t: mapped(t, table)), " ")
    return F.when(padded(c).rlike(" [ivx]+ "), swapped).otherwise(c)


@lru_cache
def _accents() -> tuple[str, str]:
    """Every character that decomposes to one ASCII letter or digit, and that letter or digit."""
    source, target = [], []
    for code in range(0x80, 0x2200):
        plain = "".join(x for x in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(x))
        if len(plain) == 1 and plain.isascii() and plain.isalnum():
            source.append(chr(code))
            target.append(plain)
    return "".join(source), "".join(target)


def fold_accents(c: Column) -> Column:
    """Accents folded into their letter."""
    source, target = _accents()
    folded = F.translate(F.regexp_replace(c, r"\p{Mn}+", ""), source, target)
    return F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(c)


# ---------------------------------------------------------------------------------------------
# names and words
# ---------------------------------------------------------------------------------------------


def normalise(c: Column) -> Column:
    """Lower case, letters and digits only, one space between words, roman numerals as digits."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return _numerals(plain, vocab.ROMAN_NUMERALS)


def words(c: Column) -> Column:
    """Plain ASCII words joined by one space: accents folded, apostrophes dropped."""
    plain = F.regexp_replace(F.lower(fold_accents(F.coalesce(c, F.lit("")))), "['’`]", "")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def name_words(c: Column) -> Column:
    """``words`` without "and" and with listing numerals as digits, so spellings compare equal."""
    return even_names(words(c))


def even_names(text: Column) -> Column:
    """The same, from plain words."""
    kept = F.array_join(F.filter(F.split(text, " ", -1), lambda t: t != "and"), " ")
    return _numerals(F.when(padded(text).contains(" and "), kept).otherwise(text), vocab.LISTING_NUMERALS)


def the_less(c: Column) -> Column:
    """A spaced name without any "the"."""
    bare = F.array_join(F.filter(F.split(c, " ", -1), lambda t: t != "the"), " ")
    return F.when(padded(c).contains(" the "), bare).otherwise(c)


# How indexes file an article after the name.
INVERTED_ARTICLE = r"^([^:]+?),\s*(The|A|An)(:.*)?$"


def readable(c: Column) -> Column:
    """"Name, The: Sub" as "The Name: Sub"."""
    plain = F.trim(F.coalesce(c, F.lit("")))
    turned = F.concat(
        F.regexp_extract(plain, INVERTED_ARTICLE, 2),
        F.lit(" "),
        F.regexp_extract(plain, INVERTED_ARTICLE, 1),
        F.regexp_extract(plain, INVERTED_ARTICLE, 3),
    )
    return F.when(plain.rlike(INVERTED_ARTICLE), turned).otherwise(plain)


def key_of(c: Column) -> Column:
    """One key per title however it is spelt."""
    return words(readable(c))


def _without_and(key: Column) -> Column:
    return F.array_join(F.filter(F.split(key, " ", -1), lambda t: t != "and"), " ")


def _without_article(title: Column, plain: Column) -> Column:
    article = title.rlike(r"(?i)^(?:the|a|an)\s") & plain.contains(" ")
    return F.when(article, F.regexp_replace(plain, "^[^ ]+ ", "")).otherwise(plain)


def _searches(bare: Column, name: Column) -> Column:
    both = F.when((name != bare) & bare.contains(" "), F.array(bare, name)).otherwise(F.array(bare))
    return F.filter(both, lambda q: q != "")


def search_name(c: Column) -> Column:
    """The name a listing must contain: key words without "and", without a leading article, numerals as digits."""
    title = readable(c)
    return _numerals(_without_article(title, _without_and(words(title))), vocab.LISTING_NUMERALS)


def search_queries(c: Column) -> Column:
    """The searches for a title: as spelt, and with digits when it has a roman numeral."""
    title = readable(c)
    bare = _without_article(title, _without_and(words(title)))
    return _searches(bare, _numerals(bare, vocab.LISTING_NUMERALS))


def with_names(df: DataFrame, title: str) -> DataFrame:
    """The rows with ``readable``, ``key``, ``name`` (the search name) and ``queries`` of a title. Each form is made from
    the one before it, and worked out once a row: as one expression every use of a form would work it out anew."""
    rows = settled(df, readable=readable(F.col(title)))
    rows = settled(rows, key=words(F.col("readable")))
    rows = settled(rows, _plain=_without_and(F.col("key")))
    rows = settled(rows, _bare=_without_article(F.col("readable"), F.col("_plain")))
    rows = settled(rows, name=_numerals(F.col("_bare"), vocab.LISTING_NUMERALS))
    return settled(rows, queries=_searches(F.col("_bare"), F.col("name"))).drop("_plain", "_bare")


def _unmarked(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(c, r"\s*\[[^\]]*\]", ""), r"\s+", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"^[. ]+", ""), r"\s+$", "")


def clean_title(c: Column) -> Column:
    """A library entry made fit to read; NULL when it is a disc or a tool."""
    title = readable(_unmarked(c))
    return F.when(~c.rlike(vocab.JUNK_TITLE) & (title != ""), title)


def with_clean(df: DataFrame, title: str) -> DataFrame:
    """The rows with ``clean``, the clean title, whose steps are worked out once a row."""
    rows = settled(df, _unmarked=_unmarked(F.col(title)))
    rows = settled(rows, _clean=readable(F.col("_unmarked")))
    clean = F.when(~F.col(title).rlike(vocab.JUNK_TITLE) & (F.col("_clean") != ""), F.col("_clean"))
    return rows.withColumn("clean", clean).drop("_unmarked", "_clean")


def written_as_title(title: Column, text: Column) -> Column:
    """Whether the text writes the title itself as a word of its own (for titles that are only a number)."""
    literal = F.regexp_replace(title, r"([^\p{L}\p{N} ])", r"\\$1")
    pattern = F.concat(F.lit(r"(?iU)(?<![\w.])"), literal, F.lit(r"(?!\w)(?!\.\d)"))
    return F.regexp_like(F.coalesce(text, F.lit("")), pattern)


def loose_key(name: Column) -> Column:
    """A search name with its order, small words, brand prefixes and number padding taken out."""
    key = F.regexp_replace(name, vocab.LOOSE_TRAILING, "")
    for phrase, plain in vocab.LOOSE_PHRASES:
        key = F.replace(key, F.lit(phrase), F.lit(plain))
    key = F.array_join(F.transform(F.split(key, " ", -1), lambda t: mapped(t, vocab.LOOSE_SUBS)), " ")
    key = F.regexp_replace(key, r"\b0+(\d)", "$1")
    for prefix in vocab.LOOSE_PREFIXES:
        key = F.regexp_replace(key, f"^{prefix} (?=.)", "")
    kept = F.filter(tokens(key), lambda t: ~t.isin(*vocab.LOOSE_STOP))
    return F.array_join(F.array_sort(kept), " ")


def compact(name: Column) -> Column:
    return F.replace(name, F.lit(" "), F.lit(""))


def unpadded(name: Column) -> Column:
    """Numbers without leading zeros."""
    return F.regexp_replace(name, r"\b0+(\d)", "$1")


def numbers_in(name: Column) -> Column:
    """The numbers of a name, in order."""
    return F.regexp_extract_all(name, F.lit(r"(\d+)"), 1)


def headline_key(c: Column) -> Column:
    """De-duplication key of a headline."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]+", ""))


def story_key(c: Column) -> Column:
    """The set of a headline's words: equal for the same story told in another order."""
    return F.array_sort(F.array_distinct(tokens(words(c))))


def shorten(c: Column, limit: int = 160) -> Column:
    """At most ``limit`` characters, cut at a word boundary and marked with an ellipsis."""
    text = squash(c)
    head = F.substring(text, 1, limit)
    cut = F.when(head.contains(" "), F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("…")))


# ---------------------------------------------------------------------------------------------
# markup
# ---------------------------------------------------------------------------------------------

# The named entities that are decoded, with the ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&amp;", "&"))


def decode_entities(c: Column) -> Column:
    for entity, plain in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def strip_tags(c: Column) -> Column:
    """Feed bodies: every tag is a space, whitespace squashed."""
    return squash(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "))


def post_text(c: Column) -> Column:
    """Posts: line breaks kept as lines, other tags out, entities decoded, blank lines dropped."""
    text = F.replace(F.coalesce(c, F.lit("")), F.lit("<wbr>"), F.lit(""))
    text = F.regexp_replace(text, r"(?i)<br\s*/?>", "\n")
    text = decode_entities(F.regexp_replace(text, "<[^>]+>", " "))
    lines = F.transform(F.split(text, "\r\n|\r|\n", -1), squash)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def first_words(c: Column, limit: int | None) -> Column:
    """The text up to the end of its ``limit``-th word; the whole text when there is no limit."""
    if limit is None:
        return c
    return F.regexp_extract(c, rf"(?s)^(\s*(?:\S+\s+){{0,{limit - 1}}}\S+)", 1)


# ---------------------------------------------------------------------------------------------
# tone and flags
# ---------------------------------------------------------------------------------------------


def _starts(token: Column, stems: Iterable[str]) -> Column:
    return token.rlike("^(?:" + "|".join(stems) + ")")


def letter_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z]+)"), 1)


def tone(c: Column) -> Column:
    """50, +10 a positive stem, -15 a negative one, flipped after a negator within three tokens; kept in 10..100."""
    found = letter_tokens(c)
    window = vocab.NEGATION_WINDOW

    def points(token: Column, i: Column) -> Column:
        before = F.slice(found, F.greatest(i - window + 1, F.lit(1)), F.least(i, F.lit(window)))
        negated = F.exists(before, lambda t: t.isin(*vocab.NEGATORS))
        return (
            F.when(_starts(token, vocab.POSITIVE_STEMS), F.when(negated, -10).otherwise(10))
            .when(_starts(token, vocab.NEGATIVE_STEMS), F.when(negated, 15).otherwise(-15))
            .otherwise(0)
        )

    total = F.aggregate(F.transform(found, points), F.lit(50), lambda acc, x: acc + x)
    toned = F.least(F.lit(100), F.greatest(F.lit(10), total))
    stems = "|".join(vocab.POSITIVE_STEMS + vocab.NEGATIVE_STEMS)
    return F.when(F.lower(F.coalesce(c, F.lit(""))).rlike(stems), toned).otherwise(F.lit(50))


def hype(c: Column) -> Column:
    """How many tokens start with an announcement stem."""
    return F.size(F.filter(letter_tokens(c), lambda t: _starts(t, vocab.HYPE_STEMS)))


def has_context(c: Column) -> Column:
    return unicode_rlike(c, vocab.CONTEXT)


def is_remaster(c: Column, matched: Column) -> Column:
    """Strong wording flags alone; everyday wording only beside a matched title."""
    return unicode_rlike(c, vocab.REMASTER_STRONG) | (matched & unicode_rlike(c, vocab.REMASTER_WEAK))


def is_digital_only(c: Column) -> Column:
    """Whether a headline is about a digital-only release or physical media going away."""
    going = unicode_rlike(c, vocab.PHYSICAL_GOING)
    worded = unicode_rlike(c, vocab.DIGITAL_WORDING) & ~unicode_rlike(c, vocab.DIGITAL_EVENT)
    return ~unicode_rlike(c, vocab.DIGITAL_HOWTO) & (going | worded)


def collectible_terms(c: Column, most: int | None = None) -> Column:
    """Labels for why an article calls a title a rare collectible, in order of appearance."""
    sentences = F.filter(
        F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?])\s+", -1),
        lambda s: ~unicode_rlike(s, vocab.IN_WORLD_WORDS),
    )

    def labels(sentence: Column) -> Column:
        hits = [F.when(unicode_rlike(sentence, p), F.lit(name)) for name, p in vocab.COLLECTIBLE]
        return F.array_compact(F.array(*hits))

    found = F.array_distinct(F.flatten(F.transform(sentences, labels)))
    return found if most is None else F.slice(found, 1, most)


def article_check(c: Column, lead: int | None = None, opening: int | None = None, labels: int | None = None) -> Column:
    """What an article says: is it about a video game (its lead says so, or its opening names a game), does it name the
    platform, which labels apply. The whole text counts as lead and opening unless their lengths are given."""
    text = F.lower(F.coalesce(c, F.lit("")))
    part = lambda n: text if n is None else F.substring(text, 1, n)
    about = part(lead).contains("video game") | part(opening).contains("game")
    return F.struct(
        about.alias("is_game"),
        F.coalesce(c, F.lit("")).rlike("(?U)" + vocab.ARTICLE_PLATFORM).alias("names_platform"),
        collectible_terms(c, labels).alias("collectible"),
    )


def keyword_genre(key: Column) -> Column:
    """The first genre whose words stand in the key."""
    rule = None
    for name, pattern in vocab.GENRE_KEYWORDS:
        hit = key.rlike(pattern)
        rule = F.when(hit, name) if rule is None else rule.when(hit, name)
    return rule


def genre_bucket(genre: Column) -> Column:
    first = F.trim(F.split_part(genre, F.lit(" / "), F.lit(1)))
    pairs = F.create_map(*[F.lit(x) for pair in vocab.GENRE_BUCKETS.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, first), F.lit("Other"))


def sample_bucket(headline: Column, titles: Column) -> Column:
    """Which sampling bucket a headline belongs to, by the titles matched in it."""
    common = F.array(*[F.lit(w) for w in vocab.COMMON_WORDS])

    def is_generic(title: Column) -> Column:
        found = F.regexp_extract_all(F.lower(title), F.lit("([a-z0-9']+)"), 1)
        plain = F.size(F.filter(found, lambda w: F.array_contains(common, w)))
        return (F.size(found) <= 2) | (plain >= F.greatest(F.lit(1), F.size(found) - 1))

    numbered = F.exists(titles, lambda t: t.rlike(r"\d") | t.rlike(vocab.ROMAN_IN_TITLE))
    return (
        F.when(F.size(titles) > 0, F.when(numbered, "sequel").when(F.exists(titles, is_generic), "generic")
               .otherwise("matched"))
        .when(unicode_rlike(headline, vocab.TITLE_HINT), "near_miss")
        .otherwise("unmatched")
    )


# ---------------------------------------------------------------------------------------------
# items
# ---------------------------------------------------------------------------------------------


def source_label(kind: Column, name: Column, link: Column, tag: Column, feed_title: Column) -> Column:
    """The label of an entry's source: prefixed configured name, subreddit, or the feed's own title."""
    prefix = F.create_map(*[F.lit(x) for pair in vocab.SOURCE_PREFIX.items() for x in pair])
    return (
        F.when(kind.isin(*vocab.SOURCE_PREFIX), F.concat(F.try_element_at(prefix, kind), name))
        .when(link.contains("reddit.com") & tag.isNotNull(), F.concat(F.lit("r/"), tag))
        .otherwise(F.split_part(F.coalesce(feed_title, F.lit("Unknown source")), F.lit(" | "), F.lit(1)))
    )


def source_key(kind: Column, channel_id: Column, channel_url: Column, subreddit: Column, board: Column,
               url: Column) -> Column:
    """The stable id that ties a configured source to its items."""
    return (
        F.when(kind == "youtube", F.concat(F.lit("youtube:"), F.coalesce(channel_id, F.lower(channel_url))))
        .when(kind == "reddit", F.concat(F.lit("reddit:"), F.lower(subreddit)))
        .when(kind == vocab.BOARD_TYPE, F.concat(F.lit(vocab.BOARD_TYPE + ":"), board))
        .otherwise(url)
    )


def item_link(kind: Column, link: Column, comments: Column, guid: Column, enclosure: Column,
              shared: Column) -> Column:
    """A forum item is its discussion; an episode without a page of its own is its audio file."""
    web = r"^https?://"
    own = F.coalesce(link, F.lit("#"))
    discussion = F.coalesce(F.when(comments.rlike(web), comments), F.when(guid.rlike(web), guid), own)
    episode = F.when(link.rlike(web) & ~shared, link).otherwise(
        F.coalesce(enclosure, F.when(link != "", link), F.lit("#")))
    return F.when(kind == "forum", discussion).when(kind == "podcast", episode).otherwise(own)


def item_key(link: Column, source: Column, headline: Column) -> Column:
    """An item is its link, or its source and headline when it has none."""
    own = F.concat(F.coalesce(source, F.lit("")), F.lit("|"), F.coalesce(headline, F.lit("")))
    return F.when(F.coalesce(link, F.lit("#")) == "#", own).otherwise(link)


def titles_of(matched: Column, single: Column) -> Column:
    """The titles an item names: the list, or the single title of older items; blanks and repeats dropped."""
    kept = F.array_distinct(F.filter(F.coalesce(matched, F.array().cast("array<string>")),
                                     lambda t: t.isNotNull() & (F.trim(t) != "")))
    lone = F.when(F.trim(single) != "", F.array(single)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(kept) > 0, kept).otherwise(F.coalesce(lone, F.array().cast("array<string>")))
