"""Price index, rare lists, history rules: literal cases and properties."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from titletide.config import Settings
from titletide.operators import levels as lv
from titletide.operators import price_index as ix
from titletide.operators import prices as pr
from titletide.operators.medians import group_medians, keep_first

BASE = dt.datetime(2026, 10, 1)
SCHEMA = "stamp TIMESTAMP_NTZ, title STRING, site STRING, period INT, copies INT, lowest DOUBLE, median DOUBLE"


def row(day, title, median, site="US", copies=5, hour=9):
    stamp = BASE + dt.timedelta(days=day, hours=hour)
    return (stamp, title, site, day, copies, median, median)


def history(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def index(spark, rows, site="US"):
    found = ix.price_index(history(spark, rows)).where(F.col("site") == site).orderBy("period").collect()
    return [(r.period, r.index_value, r.compared) for r in found]


def titles(n, day, price, **more):
    return [row(day, f"t{i}", price, **more) for i in range(n)]


def test_geometric_mean(spark):
    assert index(spark, titles(12, 0, 10.0) + titles(12, 1, 11.0)) == [(0, 100.0, 12), (1, 110.0, 12)]


def test_moves_beyond_the_band_do_not_count(spark):
    rows = titles(12, 0, 10.0)
    rows += [row(1, f"t{i}", 12.0) for i in range(6)] + [row(1, f"t{i}", 9.0) for i in range(6, 10)]
    rows += [row(1, "t10", 25.0), row(1, "t11", 4.0)]
    expected = round(100 * (1.2**6 * 0.9**4) ** (1 / 10), 2)
    assert index(spark, rows)[1] == (1, expected, 10)


def test_last_figure_of_the_day(spark):
    rows = titles(12, 0, 10.0) + titles(12, 1, 11.0, hour=9) + titles(12, 1, 15.0, hour=23)
    assert index(spark, rows)[1][1] == 150.0


def test_joiners_and_gaps_never_move_it(spark):
    rows = titles(12, 0, 10.0) + titles(12, 1, 10.0) + [row(1, "new", 900.0)] + titles(11, 2, 10.0)
    assert [v for _, v, _ in index(spark, rows)] == [100.0, 100.0, 100.0]
    assert [n for _, _, n in index(spark, rows)] == [12, 12, 11]
    assert index(spark, titles(12, 0, 10.0) + titles(12, 12, 20.0)) == [(0, 100.0, 12), (12, 100.0, 0)]


def test_starts_on_the_first_full_day(spark):
    rows = titles(5, 0, 10.0) + titles(12, 1, 10.0) + titles(5, 2, 12.0)
    assert index(spark, rows) == [(1, 100.0, 12), (2, 100.0, 5)]


def test_pooled_sites(spark):
    rows = []
    for site, last in (("UK", 11.0), ("DE", 11.0), ("US", 15.0)):
        rows += titles(12, 0, 10.0, site=site) + titles(12, 1, last, site=site)
    assert index(spark, rows, "PAL") == [(0, 100.0, 24), (1, 110.0, 24)]
    assert index(spark, rows)[1][1] == 150.0
    assert index(spark, [r for r in rows if r[2] != "DE"], "PAL") == []


def test_market_cap_of_a_rare_list(spark):
    names = [f"t{i}" for i in range(12)]
    rows = [row(0, t, 100.0, copies=2) for t in names] + [row(1, t, 110.0, copies=2) for t in names]
    rows += [row(0, "big", 20.0, copies=2)]
    members = spark.createDataFrame([("US", "US", t, 1000) for t in names] + [("US", "US", "big", 500000)],
                                    "list STRING, site STRING, title STRING, copies BIGINT")
    got = ix.rare_index(history(spark, rows), members, survival=0.5).orderBy("period").collect()
    first = 12 * 100 * 1000 * 0.5 + 20 * 500000 * 0.5
    assert got[0].cap == first and got[0].core_cap == 12 * 100 * 1000 * 0.5
    move = (12 * 110 * 1000 + 20 * 500000) / (12 * 100 * 1000 + 20 * 500000)
    assert got[1].cap == pytest.approx(first * move, abs=1)
    assert got[1].core_cap == pytest.approx(12 * 110 * 1000 * 0.5, abs=1)
    assert (got[1].index_value, got[1].live) == (110.0, 13)


def reference_line(rows, members, survival):
    """A plain walk over the days, to check the windowed rare index against."""
    by_day = {}
    for stamp, title, _, day, copies, _, median in sorted(rows):
        if title in members:
            by_day.setdefault(day, {})[title] = (median, copies)
    out, value, seen, held, before = [], None, {}, {}, {}
    for day in sorted(by_day):
        thick = {t: m for t, (m, c) in by_day[day].items() if c >= 2}
        logs = [math.log(m / seen[t][1]) for t, m in thick.items()
                if t in seen and day - seen[t][0] <= 3 and 0.5 <= m / seen[t][1] <= 2]
        compared = len(thick) if value is None else len(logs)
        if value is None:
            value = 100.0 if compared >= 10 else None
        elif compared >= 10:
            value *= math.exp(sum(logs) / compared)
        seen.update({t: (day, m) for t, m in thick.items()})
        held.update({t: (day, m) for t, (m, _) in by_day[day].items()})
        live = {t: m for t, (d, m) in held.items() if day - d <= 7}
        both = [t for t in live if t in before and 0.5 <= live[t] / before[t] <= 2]
        then = sum(before[t] * members[t] for t in both)
        ratio = sum(live[t] * members[t] for t in both) / then if then else 1.0
        out.append([day, value and round(value, 2), compared, sum(m * members[t] * survival for t, m in live.items()), ratio, len(live)])
        before = live
    start = next(i for i, p in enumerate(out) if p[5] >= 0.8 * len(members) and p[1] is not None)
    out, base = out[start:], out[start][1]
    cap = out[0][3]
    lines = []
    for i, p in enumerate(out):
        cap = cap * p[4] if i else cap
        lines.append((p[0], round(p[1] / base * 100, 2), p[2], round(cap), p[5]))
    return lines


def test_rare_index_against_a_plain_walk(spark):
    draw = random.Random(5)
    members = {f"t{i}": draw.randint(100, 5000) for i in range(15)}
    rows = []
    for day in list(range(0, 14)) + [17, 18, 30, 31, 32]:
        for t in members:
            if draw.random() < 0.8:
                rows.append(row(day, t, float(draw.randint(50, 140)), copies=draw.choice([1, 2, 3, 9])))
    frame = spark.createDataFrame([("US", "US", t, c) for t, c in members.items()],
                                  "list STRING, site STRING, title STRING, copies BIGINT")
    got = ix.rare_index(history(spark, rows), frame, survival=0.65).orderBy("period").collect()
    want = reference_line(rows, members, 0.65)
    assert [(r.period, r.index_value, r.compared, r.live) for r in got] == [(d, v, n, k) for d, v, n, _, k in want]
    assert all(abs(r.cap - w[3]) <= 1 for r, w in zip(got, want))


def test_exact_medians_of_hot_groups(spark):
    draw = random.Random(3)
    rows = [("hot" if draw.random() < 0.5 else f"k{draw.randint(0, 9)}", draw.randint(1, 900000) / 100) for _ in range(4000)]
    got = {r.k: r for r in group_medians(spark.createDataFrame(rows, "k STRING, v DOUBLE"), ["k"], F.col("v")).collect()}
    for key in {k for k, _ in rows}:
        values = sorted(round(v * 100) for k, v in rows if k == key)
        assert got[key].copies == len(values) and got[key].lowest == values[0] / 100
        assert got[key].median == math.floor(statistics.median(values) + 0.5) / 100


def test_keep_first_is_the_global_order(spark):
    draw = random.Random(4)
    rows = [(i, draw.randint(0, 3), draw.randint(0, 50), i % 2 == 0) for i in range(500)]
    frame = spark.createDataFrame(rows, "id INT, a INT, b INT, g BOOLEAN")
    kept = keep_first(frame, F.col("g"), F.when(F.col("g"), 100).otherwise(37), [F.col("a"), F.col("b")], [F.col("id")]).collect()
    for group, n in ((True, 100), (False, 37)):
        want = sorted((a, b, i) for i, a, b, g in rows if g == group)[:n]
        assert sorted((r.a, r.b, r.id) for r in kept if r.g == group) == want


def test_week_before_picks_first_then_checks(spark):
    h = history(spark, [row(1, "a", 10.0), row(2, "a", 12.0), row(10, "a", 20.0),
                        row(2, "bad", float("nan")), row(1, "bad", 9.0), row(10, "bad", 9.0),
                        row(6, "young", 5.0), row(5, "young", 4.0), row(10, "young", 6.0), row(8, "new", 6.0), row(10, "new", 6.0)])
    got = {r.title: r.week_median for r in pr.week_before(pr.latest_of(h), h).collect()}
    assert got == {"a": 12.0, "bad": None, "young": 4.0, "new": None}


def test_change_rows(spark):
    h = history(spark, [row(0, "a", 5.0, hour=1), row(0, "a", 5.0, hour=2), row(0, "a", 6.0, hour=3), row(1, "a", 6.0, hour=1)])
    assert [r.stamp.hour for r in pr.change_rows(h).orderBy("stamp").collect()] == [1, 3, 1]


def test_daily_series(spark):
    h = history(spark, [row(5, "a", 10.0, hour=1), row(5, "a", 11.0, hour=5), row(6, "a", 9.0, copies=0), row(7, "a", 12.0), row(100, "a", 1.0)])
    rows = ix.daily_series(h, F.lit(90), 90).orderBy("period").collect()
    assert [(r.period, r.median) for r in rows] == [(5, 11.0), (7, 12.0)]


def test_index_change(spark):
    line = spark.createDataFrame([("UK", 6, 100.0, 145), ("UK", 7, 99.87, 135), ("UK", 8, 101.2, 167), ("UK", 13, 104.5, 170),
                                  ("UK", 14, 103.9, 160)], "site STRING, period INT, index_value DOUBLE, compared BIGINT")
    r = ix.index_change(line).first()
    assert (round(r.day_change, 1), r.week_period, round(r.week_change, 1)) == (-0.6, 7, 4.0)


def test_steady(spark):
    good = [row(d, "s", 10.0 + d / 10, copies=30) for d in range(6)]
    few = [row(d, "few", 10.0, copies=10) for d in range(6)]
    got = {r.title: r.steady for r in pr.steady_pairs(history(spark, good + few), F.lit(5)).collect()}
    assert got == {"s": True, "few": False}


def test_latest_update_keeps_old_rows(spark):
    shape = ("title STRING, site STRING, status STRING, checked TIMESTAMP_NTZ, copies INT, lowest DOUBLE, median DOUBLE, "
             "new_copies INT, new_median DOUBLE, new_checked TIMESTAMP_NTZ")
    old = spark.createDataFrame([("a", "US", "ok", BASE, 3, 1.0, 2.0, 4, 50.0, BASE), ("b", "US", "ok", BASE, 3, 1.0, 2.0, None, None, None),
                                 ("c", "US", "ok", BASE, 3, 1.0, 2.0, None, None, None)], shape)
    now = BASE + dt.timedelta(days=1)
    new = spark.createDataFrame([("a", "US", "ok", now, 5, 2.0, 3.0, None, None, None), ("b", "US", "error", now, None, None, None, None, None, None),
                                 ("c", "US", "unmatched", now, None, None, None, None, None, None)], shape)
    got = {r.title: r for r in pr.update_latest(old, new).collect()}
    assert (got["a"].copies, got["a"].new_copies) == (5, 4)
    assert (got["b"].checked, got["b"].copies) == (BASE, 3)
    assert (got["c"].checked, got["c"].copies) == (now, None)


def test_levels(spark):
    now = dt.datetime(2026, 10, 14, 12)
    at = lambda h: now - dt.timedelta(hours=h)
    rows = [("staple", at(24 * d), "s", f"story {d}", "title", "exact") for d in range(6)]
    rows += [("surge", at(2), "s1", "one thing", "title", "exact"), ("surge", at(5), "s2", "other thing", "title", "fuzzy")]
    rows += [("same", at(2), "s1", "one thing", "title", "exact"), ("same", at(5), "s2", "thing one", "title", "exact")]
    rows += [("text", at(2), "s1", "x", "body", "exact"), ("old", at(24 * 20), "s", "x", "title", "exact")]
    frame = spark.createDataFrame(rows, "title STRING, ts TIMESTAMP_NTZ, source STRING, headline STRING, matched_in STRING, match_method STRING")
    state = spark.createDataFrame([("held", now + dt.timedelta(hours=5), False), ("pinned", None, True), ("quiet", None, False)],
                                  "title STRING, held_until TIMESTAMP_NTZ, pinned BOOLEAN")
    got = {r.title: r for r in lv.levels(frame, F.lit(now).cast("timestamp_ntz"), state).collect()}
    assert {t: r.level for t, r in got.items()} == {"staple": "staple", "surge": "surging", "same": "normal", "text": "normal",
                                                   "held": "surging", "pinned": "normal", "quiet": "dormant"}
    assert got["surge"].held_until == at(2) + dt.timedelta(hours=48)


def test_budget(spark):
    due = spark.createDataFrame([(i, 2) for i in range(10)], "rank INT, cost INT")
    assert lv.within_budget(due, 7, [F.col("rank")]).count() == 3
    assert lv.allowance(4900) == 50 and lv.allowance(0) == 500
    assert Settings().searches_per_run == 500
