"""Steps that scale and stages that count: near misses of pairs that counted nothing, near spellings by parts with errors."""

import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from tests.test_titles import listing
from titletide.functions.similarity import indel_ratio
from titletide.operators import spotting
from titletide.plans import listing_queries


def test_near_misses_are_those_of_pairs_that_counted_nothing(spark, monkeypatch):
    """Two sites left the same listings out as another title; on one of them a copy counted."""
    missed = [("Silent Hill 3 PS2", "5", "GBP"), ("Silent Hill homecoming PS2", "5", "GBP")]
    junk, copy = ("Silent Hill 2 PS2 case only", "5", "GBP"), ("Silent Hill 2 PS2", "40", "GBP")
    searches = [listing(spark, *missed, junk, site="UK"), listing(spark, *missed, copy, site="DE"), listing(spark, copy, site="FR"),
                listing(spark, missed[0], copy, site="IT").withColumn("legacy_id", F.lit(None).cast("string"))]
    monkeypatch.setattr(listing_queries.ad, "listings", lambda spark, sf_dir: reduce(lambda a, b: a.unionByName(b), searches))
    got = {(r["grouping"], r["title"], r["near"]): r["n"] for r in listing_queries.near_misses(spark, "").collect()}
    assert got == {("near", None, "number"): 2, ("near", None, "partial"): 1,
                   ("near_title", "Silent Hill 2", "number"): 2, ("near_title", "Silent Hill 2", "partial"): 1}


def brute(phrases, text, threshold, most_words=6):
    """Every near spelling of phrases that share a word with the text, run by run."""
    each = text.split(" ")
    known = [p for p in phrases if (set(p.split()) - set(spotting.vocab.STOPWORDS)) & set(each)]
    return {(s, e, p) for s in range(len(each)) for e in range(s + 2, min(s + most_words, len(each)) + 1) for p in known
            if len(gram := " ".join(each[s:e])) >= 8 and indel_ratio(gram, p) >= threshold}


def spoilt_text(draw, phrases, runs, share):
    spoil = lambda p: "".join(draw.choice(["", c + "a", "e", " "]) if draw.random() < share else c for c in p)
    return " ".join(" ".join(spoil(draw.choice(phrases)) for _ in range(runs)).split())


@pytest.mark.parametrize("threshold", [60, 75, 88, 93])
def test_parts_with_errors_lose_no_near_spelling(threshold):
    """Phrases of eight letters to fifty, so that every way to cut them is met, with letters and signs of two kinds."""
    draw = random.Random(threshold)
    word = lambda: "".join(draw.choice("aeioustéř4") for _ in range(draw.randrange(1, 9)))
    phrases = sorted({p for p in (" ".join(word() for _ in range(draw.randrange(2, 9))) for _ in range(60)) if 8 <= len(p) <= 50})
    text = spoilt_text(draw, phrases, 60, 0.06)
    for most_words in (6, 9):
        got = list(spotting._near_finder(threshold, 8, most_words)(phrases)(text))
        want = brute(phrases, text, threshold, most_words)
        assert want and want <= {(s, e, p) for s, e, _, p, *_ in got}
        assert len(got) == len({(s, e, p) for s, e, _, p, *_ in got})


def test_texts_are_looked_at_together_and_long_ones_in_slices(monkeypatch):
    """Neither groups of texts nor slices of one show in what is found."""
    draw = random.Random(3)
    phrases = ["silent hill 4 the room", "god hand of fate", "shadow colossus", "3 omega boost"]
    texts = [spoilt_text(draw, phrases, draw.randrange(1, 30), 0.04) for _ in range(20)] + [None, "", "shadow", phrases[1]]
    alone = [(i, find) for i, text in enumerate(texts) if text for find in spotting._near_finder(88, 8, 6)(phrases)(text)]
    assert {(i, s, e, p) for i, (s, e, _, p, *_) in alone} >= {
        (i, *found) for i, text in enumerate(texts) if text for found in brute(phrases, text, 88)}
    assert all(find[2] == " ".join(texts[i].split()[find[0]:find[1]]) for i, find in alone)
    assert all(find[4] == " ".join(texts[i].split()[find[1]:find[1] + 3]) for i, find in alone)
    for size in (1, 40, 300, 1 << 19):
        monkeypatch.setattr(spotting, "GROUP_CHARS", size)
        assert sorted(spotting._near_among(88, 8, 6)(phrases)(texts)) == sorted(alone)


def test_a_larger_library_is_not_met_at_every_letter(monkeypatch):
    """The runs that are compared with a phrase are few for each word of the text, however many phrases there are."""
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("eeettaaoinshrdlu") for _ in range(draw.randrange(3, 9)))
    phrases = sorted({" ".join(word() for _ in range(3)) for _ in range(3000)})
    text = " ".join(word() for _ in range(3000))
    looked_at = []
    ranges = spotting._ranges
    monkeypatch.setattr(spotting, "_ranges", lambda first, count: looked_at.append(int(count.sum())) or ranges(first, count))
    list(spotting._near_finder(88, 8, 6)(phrases)(text))
    assert sum(looked_at) < 5 * 3000
