"""Steps that scale: texts read once for a dictionary, long texts by their own phrases, medians without a second grouping."""

import random

from pyspark.sql import functions as F

from titletide.operators import matching, spotting
from titletide.operators.medians import middle_of_counts


def _scans(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_a_dictionary_without_numbers_reads_its_texts_once(spark):
    rows = matching.tokenised(spark.createDataFrame([(1, "God Hand and 1945 here", True)], "doc INT, text STRING, platform BOOLEAN"))
    words = spark.createDataFrame([("God Hand",)], "title STRING")
    both = spark.createDataFrame([("God Hand",), ("1945",)], "title STRING")
    entries = lambda titles: matching.dictionary(titles).where("method <> 'alias'")
    plain = matching.dictionary_matches(rows, entries(words))
    assert _scans(plain) == 1
    assert [r["title"] for r in plain.collect()] == ["God Hand"]
    assert sorted(r["title"] for r in matching.dictionary_matches(rows, entries(both)).collect()) == ["1945", "God Hand"]


def test_a_long_text_meets_its_own_phrases_only(monkeypatch):
    """Finds are looked at in blocks, and places of phrases without a word of the text are left out; neither shows."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("aeioust") for _ in range(draw.randrange(2, 6)))
    phrases = sorted({p for p in (" ".join(word() for _ in range(3)) for _ in range(200)) if len(p) >= 8})
    text = " ".join(draw.choice(phrases) + " " + word() for _ in range(150))
    want = sorted(spotting._near_finder(85, 8, 6)(phrases)(text))
    looked_at = []
    ranges = spotting._ranges
    monkeypatch.setattr(spotting, "_ranges", lambda first, count: looked_at.append(int(count.sum())) or ranges(first, count))
    monkeypatch.setattr(spotting, "AT_ONCE", 1 << 8)
    assert want and sorted(spotting._near_finder(85, 8, 6)(phrases)(text)) == want
    assert spotting._counted(spotting.np.array([0, 3]), 4).tolist() == [0, 1, 1, 1, 2, 2]
    assert max(looked_at) < 1 << 13


def test_a_post_is_taken_apart_once(spark):
    """However many claims a post has, its words are split before they are dealt to its claims."""
    posts = spark.createDataFrame([("a", "God Hand, then Ico 2. Kuon was god hand", True), ("b", "Ico", True), (None, "Ico", True)],
                                  "doc STRING, text STRING, platform BOOLEAN")
    library = spark.createDataFrame([("God Hand",), ("Ico",), ("Kuon",)], "title STRING")
    judged = matching.post_claims(posts, library)
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan
    got = {(r["doc"], r["title"], r["start"], r["reason"]) for r in judged.collect()}
    assert got == {("a", "God Hand", 0, None), ("a", "God Hand", 7, "not written as a name"), ("a", "Ico", 3, "runs into a number"),
                   ("a", "Kuon", 5, "not written as a name"), ("b", "Ico", 0, None)}


def test_the_row_in_the_middle_gives_the_median(spark):
    draw = random.Random(9)
    amounts = {key: [draw.randrange(12) for _ in range(size)] for key, size in enumerate((1, 2, 3, 8, 41, 60))}
    rows = spark.createDataFrame([(k, v) for k, vs in amounts.items() for v in vs] + [(None, 4), (None, 7), (9, None)], "k INT, penny INT")
    middles = middle_of_counts(rows.groupBy("k", "penny").agg(F.count(F.lit(1)).alias("n")).localCheckpoint(), ["k"])
    assert "Aggregate" not in middles._jdf.queryExecution().optimizedPlan().toString()
    got = {r["k"]: (r["copies"], r["low"], r["high"], r["twice"]) for r in middles.collect()}
    want = {k: (len(v), min(v), max(v), sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) for k, v in amounts.items()}
    assert got == {**want, None: (2, 4, 7, 11), 9: (1, None, None, None)}
