"""Steps that scale: near spellings by anchored pieces, windows from hours, names and paddings worked out once."""

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from titletide.functions import text as X
from titletide.functions.similarity import common_length, indel_ratio
from titletide.operators import spotting, titles
from titletide.streaming import jobs


def test_an_anchored_piece_stays_whole_where_it_may_stand():
    draw = random.Random(5)
    for _ in range(400):
        phrase = "".join(draw.choice("abc ") for _ in range(draw.randrange(8, 20))).strip().replace("  ", "ab")
        run = list(phrase)
        for _ in range(draw.randrange(5)):
            at = draw.randrange(len(run))
            if draw.random() < 0.5:
                run.insert(at, draw.choice("abc"))
            elif len(run) > 4:
                del run[at]
        run = "".join(run)
        shared = common_length(phrase, run)
        spare = len(phrase) + len(run) - 2 * shared
        if spare >= len(phrase):
            continue
        wide = f" {run} "
        stands = lambda left, place, letters: any(
            wide.startswith(letters, 1 + place + moved) and abs(len(run) - len(phrase) - moved) <= spare - left
            for moved in range(-left, left + 1, 2) if 1 + place + moved >= 0)
        assert any(stands(*piece) for piece in spotting.anchored(phrase, spare, Counter())), (phrase, run)


def test_the_finder_loses_no_near_spelling():
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("aeioust") for _ in range(draw.randrange(1, 6)))
    phrases = sorted({p for p in (" ".join(word() for _ in range(draw.randrange(2, 5))) for _ in range(60)) if len(p) >= 8})
    spoilt = lambda p: "".join(draw.choice(["", c, c + "a"]) if draw.random() < 0.08 else c for c in p)
    text = " ".join(" ".join(spoilt(draw.choice(phrases)) + " " + word() for _ in range(80)).split())
    for threshold in (80, 88, 93):
        got = {(s, e, p) for s, e, _, p, *_ in spotting._near_finder(threshold, 8, 6)(phrases)(text)}
        each = text.split(" ")
        want = {(s, e, p) for s in range(len(each)) for e in range(s + 2, min(s + 6, len(each)) + 1) for p in phrases
                if len(gram := " ".join(each[s:e])) >= 8 and indel_ratio(gram, p) >= threshold}
        known = {(s, e, p) for s, e, p in want if (set(p.split()) - set(spotting.vocab.STOPWORDS)) & set(each)}
        assert known and known <= got


def test_members_are_kept_once_an_hour(spark):
    """A mention is one state of each kind, not one for each window that it lies in."""
    at = dt.datetime(2026, 10, 14, 5, 30)
    rows = spark.createDataFrame([("a b", "s", ["Ico"], "Ico", "title", "exact", at)],
                                 "headline STRING, source STRING, matched_games ARRAY<STRING>, matched_game STRING, matched_in STRING, "
                                 "match_method STRING, ts TIMESTAMP")
    members = jobs.surge_members(rows)
    assert members.count() == 4
    assert jobs.surge_windows(members).count() == 24


def test_names_worked_out_once_are_the_same(spark):
    odd = ["Legend of X, The: II", "The A and the B", "Rock & Roll IV [Demo]", "  ..Odd  (Disc 2)", "", None, "A and", "Café III"]
    t = F.col("title")
    rows = X.with_names(X.with_clean(spark.createDataFrame([(x,) for x in odd], "title STRING"), "title"), "title")
    for r in rows.select("*", X.clean_title(t).alias("c"), X.readable(t).alias("r"), X.key_of(t).alias("k"),
                         X.search_name(t).alias("n"), X.search_queries(t).alias("q")).collect():
        assert (r.clean, r.readable, r.key, r.name, r.queries) == (r.c, r.r, r.k, r.n, r.q)


def test_components_send_no_table_of_nodes_to_the_driver(spark):
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(40)], "key STRING")
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(0, 30, 2)], "a STRING, b STRING")
    found = titles.components(nodes, edges)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.select("root").distinct().count() == 25
