"""Text functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from titletide.functions import numbers as N
from titletide.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def of(spark, function, *values):
    return one(spark, function(*[F.lit(v) for v in values]))


@pytest.mark.parametrize("text, expected", [
    ("Jak II", "jak 2"), ("Final Fantasy X-2!", "final fantasy 10 2"), ("  ", ""), ("Ōkami", "ōkami"),
])
def test_normalise(spark, text, expected):
    assert of(spark, X.normalise, text) == expected


@pytest.mark.parametrize("text, expected", [
    ("Ōkami™ (PS2)", "okami ps2"), ("Director's Cut", "directors cut"), ("Okami⭐Complete", "okami complete"),
    ("Hülle für Straße", "hulle fur stra e"),
])
def test_words(spark, text, expected):
    assert of(spark, X.words, text) == expected


def test_names(spark):
    assert of(spark, X.name_words, "Jak & Daxter and Kingdom Hearts II") == "jak daxter kingdom hearts 2"
    assert of(spark, X.readable, "Godfather, The: Collector's Edition") == "The Godfather: Collector's Edition"
    assert of(spark, X.key_of, "Getaway, The: Black Monday") == "the getaway black monday"
    assert of(spark, X.search_name, "The Godfather") == "godfather"
    assert of(spark, X.search_queries, "Kingdom Hearts II") == ["kingdom hearts ii", "kingdom hearts 2"]
    assert of(spark, X.clean_title, "Thing, The [Platinum]") == "The Thing"
    assert of(spark, X.clean_title, "Jampack demo disc 3") is None
    assert of(spark, X.loose_key, "arsenal club football 2005") == of(spark, X.loose_key, "club football 2005 arsenal")
    assert of(spark, X.loose_key, "disneys finding nemo") == of(spark, X.loose_key, "disney pixar finding nemo")


def test_number_titles(spark):
    assert of(spark, X.written_as_title, "XIII", "I like XIII a lot")
    assert not of(spark, X.written_as_title, "XIII", "runs at 13.5-14.5V")


@pytest.mark.parametrize("text, expected", [
    ("This is a masterpiece", 60), ("not a masterpiece", 40), ("the worst bug", 20), ("not broken at all", 65), ("", 50),
    ("love love love love love love", 100), ("awful awful awful awful", 10),
])
def test_tone(spark, text, expected):
    assert of(spark, X.tone, text) == expected


def test_hype(spark):
    assert of(spark, X.hype, "Remaster announced, leak confirmed") == 4


@pytest.mark.parametrize("text, expected", [
    ("Phantom Blade Zero Confirmed Digital-Only Despite Promised Physical Release", True),
    ("No Physical Edition Is Coming", True), ("Studio is about to ditch discs", True),
    ("The physical media debate", True), ("Ditch the disc: install games to HDD", False),
    ("Digital Deluxe Edition announced", False), ("An all-digital showcase", False), ("no disc required", False),
    ("Discord adds voice chat", False),
])
def test_digital(spark, text, expected):
    assert of(spark, X.is_digital_only, text) is expected


def test_remaster(spark):
    assert one(spark, X.is_remaster(F.lit("A remake of Okami"), F.lit(False)))
    assert not one(spark, X.is_remaster(F.lit("my collection"), F.lit(False)))
    assert one(spark, X.is_remaster(F.lit("my collection"), F.lit(True)))


def test_shorten_and_keys(spark):
    text = "word " * 50
    short = of(spark, X.shorten, text)
    assert short.endswith("…") and len(short) <= 161 and not short[:-1].endswith(" ")
    assert of(spark, X.shorten, " a  b ") == "a b"
    assert of(spark, X.headline_key, "Okami: HD, out!") == "okami hd out"
    assert of(spark, X.story_key, "Okami gets a port") == of(spark, X.story_key, "A port gets Okami")


def test_markup(spark):
    assert of(spark, X.post_text, "one<br>two &amp; <b>three</b><br><br>four") == "one\ntwo & three\nfour"
    assert of(spark, X.strip_tags, "<p>a</p><p>b</p>") == "a b"
    assert one(spark, X.first_words(F.lit("a b c"), 2)) == "a b"


def test_collectible(spark):
    text = ("The game has since become very rare. Players can find a rare weapon. It went out of print in 2004. "
            "Used copies sell for $200 and more.")
    assert of(spark, X.collectible_terms, text) == ["rare", "out of print", "second-hand price"]
    check = one(spark, X.article_check(F.lit("Kuon is a video game for the PlayStation 2.")))
    assert check.is_game and check.names_platform and check.collectible == []


def test_genres(spark):
    assert of(spark, X.keyword_genre, "silent hill 2") == "Horror"
    assert of(spark, X.keyword_genre, "nba street") == "Sports"
    assert of(spark, X.keyword_genre, "zzz") is None
    assert of(spark, X.genre_bucket, "Racing / Driving") == "Racing"
    assert of(spark, X.genre_bucket, "Cooking") == "Other"


def test_buckets(spark):
    bucket = lambda h, t: one(spark, X.sample_bucket(F.lit(h), F.array(*[F.lit(x) for x in t]).cast("array<string>")))
    assert bucket("x", ["Hitman 2"]) == "sequel"
    assert bucket("x", ["Black"]) == "generic"
    assert bucket("x", ["Shadow Hearts Covenant Saga"]) == "matched"
    assert bucket("A PS2 classic", []) == "near_miss"
    assert bucket("Nothing here", []) == "unmatched"


def test_items(spark):
    link = lambda kind, link, comments, guid, audio, shared: one(spark, X.item_link(*[
        F.lit(v).cast("string") for v in (kind, link, comments, guid, audio)], F.lit(shared)))
    assert link("forum", "https://a.b/x", "https://f.g/1", None, None, False) == "https://f.g/1"
    assert link("podcast", "https://show", None, None, "https://a/1.mp3", True) == "https://a/1.mp3"
    assert link("podcast", "https://show/1", None, None, "https://a/1.mp3", False) == "https://show/1"
    assert link("news", None, None, None, None, False) == "#"
    assert of(spark, X.item_key, "#", "src", "head") == "src|head"
    titles = one(spark, X.titles_of(F.array(F.lit("A"), F.lit(" "), F.lit("A")), F.lit("B")))
    assert titles == ["A"]


def test_numbers(spark):
    assert one(spark, N.round_even(F.lit(12.25), 1)) == 12.2
    assert one(spark, N.momentum(F.lit(1), F.lit(5))) == pytest.approx(50, abs=6)
    assert one(spark, N.price_of(F.lit("0"), F.lit("USD"), F.lit("USD"))) is None
    assert one(spark, N.price_of(F.lit("5.5"), F.lit("USD"), F.lit("USD"))) == 5.5
    assert one(spark, N.price_of(F.lit("x"), F.lit("USD"), F.lit("USD"))) is None
    assert one(spark, N.view_count(F.lit("-1"))) is None
    frame = spark.createDataFrame([(24.99,), (31.50,)], "v DOUBLE")
    assert frame.agg(N.penny_median(F.col("v"))).first()[0] == 28.25
