"""Title operators and listings on literal cases."""

import pytest
from pyspark.sql import functions as F

from titletide.operators import listings as ls
from titletide.operators import titles as tt


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "key STRING")


def test_typos(spark):
    keys = names(spark, "alien homind", "space max", "combat 5", "yazuka dead souls")
    spellings = spark.createDataFrame([(v,) for v in ("alien hominid", "space x", "combat 4", "yakuza dead souls", "another")], "spelling STRING")
    got = {r.key: r.spelling for r in tt.typo_match(keys, spellings).collect()}
    assert got == {"alien homind": "alien hominid", "yazuka dead souls": "yakuza dead souls"}


def test_close_pairs_miss_nothing(spark):
    import random
    from difflib import SequenceMatcher
    draw = random.Random(8)
    base = ["".join(draw.choice("abcdef ") for _ in range(draw.randint(6, 24))).strip() for _ in range(60)]
    bent = []
    for b in base:
        i = draw.randrange(max(1, len(b)))
        bent.append((b[:i] + draw.choice(["", "z", "qq"]) + b[i + 1:]).strip())
    pairs = tt.close_pairs(names(spark, *bent), spark.createDataFrame([(b,) for b in base], "spelling STRING"), 0.88)
    got = {(r.key, r.spelling) for r in pairs.collect()}
    want = {(a, b) for a in bent for b in base if a != b and SequenceMatcher(None, b, a).ratio() >= 0.88}
    assert want and want <= got


def test_components(spark):
    nodes = names(spark, *[f"n{i:02d}" for i in range(40)], "z1", "z2")
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(39)] + [("z1", "z2")], "a STRING, b STRING")
    got = {r.key: r.root for r in tt.components(nodes, edges).collect()}
    assert {got[f"n{i:02d}"] for i in range(40)} == {"n00"} and got["z2"] == "z1"


def test_components_of_long_chains(spark):
    """Chains of 1,000 nodes whose keys are in no order, or in order, and a comb of stars."""
    import random
    draw = random.Random(3)
    keys = [f"c{i:04d}" for i in range(1000)]
    draw.shuffle(keys)
    edges = [*zip(keys, keys[1:]), *((f"d{i:04d}", f"d{i + 1:04d}") for i in range(999)),
             *((f"e{i % 10}z", f"e{i % 10}{i:03d}") for i in range(200)), *((f"e{i}z", f"e{i + 1}z") for i in range(9))]
    nodes = sorted({x for e in edges for x in e}) + ["f"]
    want = {n: {"c": "c0000", "d": "d0000", "e": "e0000", "f": "f"}[n[0]] for n in nodes}
    frame = spark.createDataFrame(edges, "a STRING, b STRING").repartition(8)
    for sizes in ({}, {"held": 7, "small": 0}, {"held": 40, "small": 9_000}):  # one task, rounds alone, rounds and then one task
        assert {r.key: r.root for r in tt.components(names(spark, *nodes), frame, **sizes).collect()} == want


def test_components_of_whole_numbers(spark):
    """Keys that are numbers, edges to nodes that are not there, loops, repeated edges and no edges."""
    nodes = spark.createDataFrame([(n,) for n in (-3, 1, 2, 9, 10, None)], "key BIGINT")
    edges = spark.createDataFrame([(2, 1), (1, 2), (10, 9), (9, 9), (9, 77), (77, 1), (None, 1)], "a BIGINT, b BIGINT")
    want = {-3: -3, 1: 1, 2: 1, 9: 9, 10: 9}
    for small in (0, 1 << 20):
        assert {r.key: r.root for r in tt.components(nodes, edges, small=small).collect()} == want
    assert {r.key: r.root for r in tt.components(nodes, edges.limit(0)).collect()} == {n: n for n in want}


def test_groups_show_the_real_spelling(spark):
    rows = spark.createDataFrame([("soul calibur 2", True, None), ("soulcalibur 2", True, None), ("calibur soul 2", False, None),
                                  ("ace combat 04", True, "f1"), ("ace combat 4", True, "f1"), ("combat", True, None)],
                                 "key STRING, official BOOLEAN, file STRING")
    got = {r.key: r.shown for r in tt.title_groups(rows).collect()}
    assert got == {"soulcalibur 2": "soul calibur 2", "calibur soul 2": "soul calibur 2", "ace combat 04": "ace combat 4"}


def test_alias_cascade(spark):
    known = names(spark, "18 wheeler american pro trucker", "off road fury", "ace combat 4", "club football 2005 arsenal")
    wanted = names(spark, "18 wheeler", "offroad fury", "ace combat 04", "arsenal club football 2005", "unknown")
    got = {r.key: (r.target, r.how) for r in tt.alias_cascade(wanted, known).collect()}
    assert got["18 wheeler"] == ("18 wheeler american pro trucker", "longer")
    assert got["offroad fury"][0] == "off road fury" and got["arsenal club football 2005"][1] == "loose"
    assert "unknown" not in got


def test_siblings(spark):
    catalogue = spark.createDataFrame([(t,) for t in (
        "Kingdom Hearts", "Kingdom Hearts II", "Ultimate Spider-Man", "Spider-Man", "Silent Hill 2", "Silent Hill 2: Director's Cut",
        "Tom Clancy's Splinter Cell", "Splinter Cell", "Jak X", "Jak X: Combat Racing", "Disney's Tarzan", "Tarzan")], "title STRING")
    wanted = spark.createDataFrame([("Kingdom Hearts", "kingdom hearts"), ("Spider-Man", "spider man"), ("Silent Hill 2", "silent hill 2"),
                                    ("Splinter Cell", "splinter cell"), ("Jak X", "jak x"), ("Tarzan", "tarzan")], "title STRING, name STRING")
    got = {(r.title, r.sibling) for r in tt.sibling_titles(catalogue, wanted).collect()}
    assert got == {("Kingdom Hearts", "kingdom hearts 2"), ("Spider-Man", "ultimate spider man")}


def test_rename_first_rule(spark):
    rules = spark.createDataFrame([("UK", 1, "fatal frame", "project zero"), ("UK", 2, "fatal", "other")],
                                  "site STRING, position INT, old STRING, new STRING")
    rows = spark.createDataFrame([("fatal frame 2 crimson butterfly",), ("fatalframe",)], "name STRING")
    assert [(r.name, r.renamed) for r in tt.rename(rows, rules).collect()] == [
        ("fatal frame 2 crimson butterfly", "project zero 2 crimson butterfly")]


def test_majority_and_releases(spark):
    votes = spark.createDataFrame([("a", "X", 1), ("a", "Y", 2), ("b", "Y", 3), ("b", "Y", 4), ("b", "X", 5)], "key STRING, genre STRING, position INT")
    assert {r.key: r.genre for r in tt.majority(votes).collect()} == {"a": "X", "b": "Y"}
    files = spark.createDataFrame([("Okami (USA)",), ("Okami (Europe)",), ("Okami (USA) (Demo)",), ("Ico (Japan) (Beta)",)], "name STRING")
    r = tt.best_releases(files).collect()
    assert [(x.key, x.us.strip(), x.pal.strip()) for x in r] == [("okami", "(USA)", "(Europe)")]


def test_labels(spark):
    old = spark.createDataFrame([("Okami out!", "s")], "headline STRING, source STRING")
    new = spark.createDataFrame([("okami OUT", "t"), ("New one", "t"), ("new one!", "u")], "headline STRING, source STRING")
    got = tt.merge_labels(old, new).collect()
    assert sorted((r.fresh, r.source) for r in got) == [(False, "s"), (True, "t")]


def listing(spark, *rows, search="silent hill 2", siblings=("silent hill 2 restless",), site="UK", keyword=True):
    frame = spark.createDataFrame([(i, t, v, c) for i, (t, v, c) in enumerate(rows)], "item_id INT, text STRING, value STRING, currency STRING")
    array = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return frame.select(
        "*", F.lit("Silent Hill 2").alias("title"), F.lit(site).alias("site"), F.lit("GBP").alias("site_currency"),
        F.array(F.struct(F.lit("3.5").alias("cost"), F.lit("GBP").alias("currency"))).alias("postage_options"),
        F.lit("123").alias("legacy_id"), F.lit(None).cast("string").alias("url"), F.lit(search).alias("search"),
        array(siblings).alias("siblings"), array([]).alias("require"), array(["banana"]).alias("exclude"), array([]).alias("allow"),
        F.lit(keyword).alias("keyword"))


REASONS = [
    ("Silent Hill 2 (PS2) complete", None), ("Silent Hill 2 PlayStation 2 w/ soundtrack", None),
    ("Silent Hill 3 (PlayStation 2)", "other_game"), ("Silent Hill 2 3 4 PS2", "other_game"), ("Silent Hill 2 2 disc PS2", None),
    ("Silent Hill 2 case with Silent Hill 3 manual PS2", "other_game"), ("Silent Hill 2 restless dreams PS2", "other_game"),
    ("Silent Hill 2", "other_game"), ("Silent Hill 2 Xbox PS2", "other_platform"), ("Silent Hill 2 PS2 case only", "not_a_copy"),
    ("Silent Hill 2 Original Soundtrack CD PS2", "not_a_copy"), ("Silent Hill 2 PS2 banana", "not_a_copy"),
    ("Silent Hill 2 PS2 factory sealed", "graded_or_sealed"), ("Silent Hill 2 PS2 Japan", "import"), ("Silent Hill 2 PS2 NTSC", "import"),
    ("Silent Hill 2 PS2 disc only", "incomplete"), ("Silenthill 2 ps2", "other_game"), ("Silent Hi ll 2 PS2", "other_game"),
]


def test_reasons(spark):
    rows = ls.with_reasons(listing(spark, *[(t, "10.00", "GBP") for t, _ in REASONS], ("Silent Hill 2 PS2", "0", "GBP"),
                                   ("Silent Hill 2 PS2", "5", "USD")))
    got = {r.item_id: r.reason for r in rows.collect()}
    assert {t: got[i] for i, (t, _) in enumerate(REASONS)} == dict(REASONS)
    assert got[len(REASONS)] == got[len(REASONS) + 1] == "no_price"


def test_respacing(spark):
    ask = lambda text, phrase: spark.range(1).select(ls.respaced(F.lit(text), F.lit(phrase)).alias("x")).first().x
    assert ask("time splitters future perfect ps2", "timesplitters future perfect") == "timesplitters future perfect ps2"
    assert ask("timesplitters future perfect", "timesplitters future perfect") is None
    assert ask("go d hand", "god hand") is None


def test_summary(spark):
    rows = [("Silent Hill 2 PS2", "40", "GBP"), ("Silent Hill 2 PS2 boxed", "20", "GBP"), ("Silent Hill 2 PS2", "300", "GBP"),
            ("Silent Hill 2 PS2 case only", "5", "GBP"), ("Silent Hill 3 PS2", "5", "GBP"), ("Silent Hill 2 PS2 bundle", "5", "GBP"),
            ("Silent Hill 2 PS2 japanese", "5", "GBP")]
    classified = ls.with_reasons(listing(spark, *rows))
    r = ls.summarise(classified).first()
    assert (r.status, r.fetched, r.counted, r.lowest, r.median) == ("ok", 7, 3, 20.0, 40.0)
    assert (r.postage_known, r.median_postage, r.confirmed_counted, r.confirmed_median) == (3, 3.5, 1, 20.0)
    assert ls.skipped_map(classified).first().skipped == {"import": 1, "not_a_copy": 2, "other_game": 1}
    assert ls.numbers_of(ls.summarise(classified)).first().complete_copies is None


@pytest.mark.parametrize("text, expected", [
    ("hill 2 silent ps2", "scattered"), ("silent hill 3 ps2", "number"), ("silent hill homecoming", "partial"), ("silent hill 2 3", "number"), ("a b c", None),
])
def test_near_misses(spark, text, expected):
    got = spark.range(1).select(ls.near_miss(F.lit(text), F.lit("silent hill 2"), F.array().cast("array<string>")).alias("x")).first().x
    assert got == expected


def test_a_flagged_spelling_is_unmerged_by_the_next_run(spark, tmp_path):
    titles = spark.createDataFrame([("A", "normal", False, False, 3), ("B", "normal", False, False, 2), ("C", "normal", False, False, 1)],
                                   "title STRING, level STRING, pinned BOOLEAN, special BOOLEAN, mentions BIGINT")
    groups = spark.createDataFrame([("A", "g"), ("B", "g"), ("C", "g")], "title STRING, root STRING")
    figures = spark.createDataFrame([("A", "US", 10), ("B", "US", 5), ("C", "US", 4)], "title STRING, site STRING, copies BIGINT")
    looks = spark.createDataFrame([("A", "US", 10, 1.0, False), ("B", "US", 40, 1.0, False), ("C", "US", 4, 1.0, False)],
                                  "title STRING, site STRING, copies BIGINT, median DOUBLE, unmatched BOOLEAN")
    run = lambda: {r.title: r.outcome for r in tt.audited_merge(str(tmp_path / "audit"), titles, groups, figures, looks).collect()}
    assert run() == {"A": "kept", "B": "dropped", "C": "dropped"}
    assert run() == {"A": "kept", "B": "apart", "C": "dropped"}
    assert run() == {"A": "kept", "B": "apart", "C": "dropped"}  # the verdict stays


def test_without_an_audit_nothing_is_unmerged(spark, tmp_path):
    none = spark.createDataFrame([], "title STRING, level STRING, pinned BOOLEAN, special BOOLEAN, mentions BIGINT")
    groups = spark.createDataFrame([], "title STRING, root STRING")
    figures = spark.createDataFrame([], "title STRING, site STRING, copies BIGINT")
    looks = spark.createDataFrame([], "title STRING, site STRING, copies BIGINT, median DOUBLE, unmatched BOOLEAN")
    assert tt.audited_merge(str(tmp_path / "audit"), none, groups, figures, looks).count() == 0
