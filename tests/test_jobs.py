"""Mentions, snapshot, archive, demand, checks, readers, sinks and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from titletide import schemas, session
from titletide.config import Settings
from titletide.operators import archive as ar
from titletide.operators import demand as dm
from titletide.operators import mentions as mn
from titletide.operators import quality as q
from titletide.operators import snapshot as sn
from titletide.sources import readers, sinks
from titletide.streaming import jobs

NOW = dt.datetime(2026, 10, 14, 12)


def item(days, *titles, source="a", kind="news", where="title", views=None, digital=False, link=None, headline=None, feed=None, method="exact"):
    return (headline or f"{source} {days}", source, kind, feed or f"{kind}:{source}", link or f"https://x/{source}/{days}", titles[0] if titles else None,
            list(titles), 100 if titles else 0, method if titles else None, where if titles else None, False, digital, 50, 0, views, NOW - dt.timedelta(days=days))


def items(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.ITEMS)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def test_mention_stats(spark):
    frame = items(spark, item(0.5, "God Hand", source="n1"), item(2, "God Hand", source="n2"), item(8, "God Hand", source="n3"),
                  item(1, "God Hand", source="y", kind="youtube", views=5000), item(20, "Kuon"), item(5, "Kuon"), item(-3, "Kuon"))
    got = {r.title: r for r in mn.mention_stats(frame, now()).collect()}
    g = got["God Hand"]
    assert (g.mentions, g.recent, g.prior, g.last_day, g.sources, g.views, g.videos) == (4, 3, 1, 2, 4, 5000, 1)
    assert got["Kuon"].mentions == 1


def test_leaderboard(spark):
    frame = items(spark, item(0.1, "Okami"), item(0.2, "Okami", "Ico"), item(0.3, "Ico"), item(0.4, "Retro", where="body"), item(0.5, "Retro", where="body", source="b"),
                  item(0.6, "Okami"), item(1.01, "God Hand"), item(-0.02, "Haunting Ground"), item(-0.2, "Silent Hill 2"))
    got = [(r.title, r.headlines, r.texts) for r in mn.leaderboard(frame, now()).collect()]
    assert got == [("Okami", 3, 0), ("Ico", 2, 0), ("Haunting Ground", 1, 0), ("Retro", 0, 2)]


def test_snapshot_rules(spark):
    old = sn.with_key(items(spark, item(1, "Ico", link="https://l/1", headline="old"), item(20, "Ico", link="https://l/2")))
    new = sn.with_key(items(spark, item(0, "Ico", link="https://l/1", headline="new"), item(0, "Okami", kind="forum", source="f", link="https://l/1"),
                            item(0, link="https://l/3")))
    owned = sn.respect_owner(old, new)
    assert owned.count() == 2
    kept = {r.key: r.headline for r in sn.retain(sn.upsert(old, owned), now()).collect()}
    assert kept == {"https://l/1": "new", "https://l/3": "a 0"}


def test_trim_keeps_named_rows_first(spark):
    rows = [item(d / 10, "Ico", link=f"https://n/{d}") for d in range(6)] + [item(d / 10, link=f"https://o/{d}") for d in range(10)]
    settings = Settings(row_ceiling=8, ceiling_max=8, ceiling_step=2)
    kept = {r.key for r in sn.priority_trim(sn.with_key(items(spark, *rows)), settings).collect()}
    assert kept == {f"https://n/{d}" for d in range(6)} | {"https://o/0", "https://o/1"}
    ceilings = spark.createDataFrame([(100,), (27000,), (27001,), (50000,), (500000,)], "n INT").select(
        sn.ceiling_for(F.col("n"), Settings(row_ceiling=30000)).cast("int").alias("c"))
    assert [r.c for r in ceilings.collect()] == [30000, 30000, 35000, 60000, 80000]


def test_reclean(spark):
    frame = items(spark, item(0, "God of War", headline="God of War Ragnarok is out"), item(0, "Black", "Okami", headline="Black Okami"),
                  item(0, "Dragon Rage", headline="Dragon Age news", method="fuzzy"), item(0, "XIII", headline="13 things"), item(0, "Ico", headline="Ico"))
    got = [(r.matched_game, r.matched_games, r.match_score) for r in sn.reclean(frame).collect()]
    assert got == [(None, [], 0), ("Okami", ["Okami"], 100), (None, [], 0), (None, [], 0), ("Ico", ["Ico"], 100)]


def test_archive_once(spark, tmp_path):
    frame = items(spark, item(1, "Ico", "Okami", headline="Two"), item(1, "Ico", kind="4chan", headline="Thread"), item(2, "Ico", kind="4chan", headline="Thread"))
    path = str(tmp_path / "archive")
    assert sinks.append_archive(frame, path) == 4
    assert sinks.append_archive(frame, path) == 0
    rows = spark.read.parquet(path)
    assert {r.n for r in rows.where("t = '4chan'").collect()} == {None}
    top = ar.archive_index(rows).orderBy("rank").collect()
    assert [(r.title, r.n, r.mentions, r.titles) for r in top] == [("Ico", 3, 4, 2), ("Okami", 1, 4, 2)]


def test_digital_archive(spark, tmp_path):
    path = str(tmp_path / "digital")
    sinks.write_digital(items(spark, item(1, headline="no discs", digital=True), item(2, headline="gone soon", digital=True)), path)
    sinks.write_digital(items(spark, item(1, headline="no discs", digital=False), item(0, headline="fresh", digital=True)), path)
    assert {r.h for r in spark.read.parquet(path).collect()} == {"gone soon", "fresh"}
    index = {(r.grouping, r.key): r.stories for r in ar.digital_index(spark.read.parquet(path)).collect()}
    assert index[("total", "all")] == 2 and index[("month", "2026-10")] == 2


def test_a_month_without_stories_leaves_the_archive(spark, tmp_path):
    path = str(tmp_path / "digital")
    old, new = item(60, headline="no discs", digital=True), item(1, headline="all digital", digital=True)
    sinks.write_digital(items(spark, old, new), path)
    assert {r.month for r in spark.read.parquet(path).collect()} == {"2026-08", "2026-10"}
    sinks.write_digital(items(spark, item(60, headline="no discs"), new), path)
    assert {r.h for r in spark.read.parquet(path).collect()} == {"all digital"}
    sinks.write_digital(items(spark, item(60, headline="no discs"), item(1, headline="all digital")), path)
    assert sinks.stored(spark, path, ar.digital_rows(items(spark, old))).count() == 0


def test_long_headlines_are_told_apart(spark, tmp_path):
    start = "word " * 40
    path = str(tmp_path / "archive")
    frame = items(spark, item(1, "Ico", headline=start + "one"), item(1, "Ico", headline=start + "two"))
    assert sinks.append_archive(frame, path) == 2
    assert sinks.append_archive(frame, path) == 0


class Session:
    """A session of which only the settings that name the shared folder are asked."""

    def __init__(self, master, setting=None, folder=None):
        self.conf = {"spark.checkpoint.dir": setting} if setting else {}
        self.sparkContext = self
        self.master = master
        self.getCheckpointDir = lambda: folder


def test_shared_folder(spark):
    assert session.shared_folder(Session("yarn", "hdfs:///a", "hdfs:///b")) == "hdfs:///a"
    assert session.shared_folder(Session("yarn", None, "hdfs:///b")) == "hdfs:///b"
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(RuntimeError):
            session.shared_folder(Session(master))
    assert session.stored(spark.range(3), "trial").count() == 3


def test_demand(spark):
    stats = spark.createDataFrame([("A", 10, 8, 2, 2, 5, 1000, 1), ("B", 2, 0, 2, 0, 1, 0, 0)],
                                  "title STRING, mentions BIGINT, recent BIGINT, prior BIGINT, last_day BIGINT, sources BIGINT, views BIGINT, videos BIGINT")
    change = spark.createDataFrame([("A", 10.0)], "title STRING, change_pct DOUBLE")
    trend = spark.createDataFrame([("A", -50.0)], "title STRING, trend_pct DOUBLE")
    got = {r.title: r for r in dm.demand_index(stats, change, trend, F.lit(True)).collect()}
    a, b = got["A"], got["B"]
    assert (a.momentum, a.breadth, a.youtube, a.ebay, a.wikipedia) == (100.0, 100.0, 100.0, 75.0, 0.0)
    assert a.demand == round(0.3 * 100 + 0.15 * 100 + 0.2 * 100 + 0.2 * 75, 1)
    assert (b.breadth, b.youtube, b.ebay, b.wikipedia) == (20.0, 0.0, None, None)


def test_trend(spark):
    rows = [("a", dt.date(2026, 10, d), 10 if d <= 7 else 15) for d in range(1, 15)] + [("b", dt.date(2026, 10, 1), 5)]
    got = {r.article: r.trend_pct for r in dm.trend(spark.createDataFrame(rows, "article STRING, day DATE, views BIGINT")).collect()}
    assert got == {"a": 50.0, "b": None}


def test_articles_serve_one_title(spark):
    titles = spark.createDataFrame([("A", 9), ("B", 5), ("C", 1), ("D", 1)], "title STRING, mentions BIGINT")
    checks = spark.createDataFrame([("A", "Page", True, True), ("B", "Page", True, True), ("C", "Other", True, False)],
                                   "title STRING, article STRING, is_game BOOLEAN, names_platform BOOLEAN")
    resolved = spark.createDataFrame([("D", "Unread")], "title STRING, article STRING")
    overrides = spark.createDataFrame([("C", "Forced")], "title STRING, article STRING")
    got = {r.title: r.article for r in dm.usable_articles(titles, checks, resolved, overrides).collect()}
    assert got == {"A": "Page", "B": None, "C": "Forced", "D": "Unread"}


def test_source_checks(spark):
    shape = ("position INT, type STRING, name STRING, enabled BOOLEAN, role STRING, weight DOUBLE, channel_id STRING, channel_url STRING, "
             "subreddit STRING, `group` STRING, board STRING, url STRING")
    blank = (None,) * 6
    rows = [(1, "news", "A", True, "r", None, *blank[:5], "https://a.com/feed"), (2, "news", "B", True, "r", 11.0, *blank[:5], "https://a.com/feed"),
            (3, "reddit", "C", True, "x", None, None, None, "ok_sub", "g", None, None), (4, "video", None, None, None, None, *blank),
            (5, "youtube", " ", True, "r", None, "short", None, None, None, None, None)]
    roles = spark.createDataFrame([("r", 1.0)], "role STRING, weight DOUBLE")
    got = {(r.position, r.problem) for r in q.validate_sources(spark.createDataFrame(rows, shape), roles).collect()}
    assert got == {(2, "weight"), (2, "duplicate source"), (3, "unknown role"), (4, "type"), (5, "missing name"), (5, "invalid id")}


def test_listed_checks(spark):
    rows = [("Kuon", None, None, None, None), ("", None, None, None, None), ("Obscure", None, None, None, None), ("Obscure", None, ["horror"], None, None),
            ("Big Game", None, None, None, ["no such phrase"])]
    frame = spark.createDataFrame(rows, "title STRING, search STRING, require ARRAY<STRING>, exclude ARRAY<STRING>, allow ARRAY<STRING>")
    assert [r.problem for r in q.validate_listed(frame).collect()] == [None, "no title", "ordinary word", None, "word lists"]


def test_readers(spark, tmp_path):
    xml = ('<?xml version="1.0"?><gesmes:Envelope xmlns:gesmes="http://g" xmlns="http://e"><Cube><Cube time="2026-10-16">'
           '<Cube currency="USD" rate="1.1"/><Cube currency="GBP" rate="0.9"/><Cube currency="PLN" rate="4.2"/><Cube currency="CHF" rate="0.95"/>'
           '<Cube currency="JPY" rate="170"/></Cube></Cube></gesmes:Envelope>')
    (tmp_path / "fx.xml").write_text(xml)
    assert {r.currency: r.per_eur for r in readers.read_fx(spark, str(tmp_path / "fx.xml")).collect()} == {"USD": 1.1, "GBP": 0.9, "PLN": 4.2, "CHF": 0.95}
    (tmp_path / "history.json").write_text('[\n  ["2026-10-01T09:00Z","Ico","US",3,1.5,2.5],\n  ["bad","Ico","US",3,1,2],\n  ["2026-10-02T09:00Z","Ico","US",0,null,null]\n]\n')
    rows = readers.import_price_history(spark, str(tmp_path / "history.json")).orderBy("stamp").collect()
    assert [(r.title, r.copies, r.median) for r in rows] == [("Ico", 3, 2.5), ("Ico", 0, None)]
    entry = {"feed_title": "Site | News", "source_type": "news", "feed": "https://s/f", "title": " Okami remake ", "link": "https://s/1",
             "summary": "<p>Body</p>", "published": "2026-10-14T10:00:00", "position": 1}
    (tmp_path / "entries.json").write_text(json.dumps(entry) + "\n" + json.dumps({**entry, "title": None}) + "\n")
    r = readers.items_from_entries(readers.read_entries(spark, str(tmp_path / "entries.json"))).collect()
    assert len(r) == 1 and (r[0].headline, r[0].source, r[0].body, r[0].hype) == ("Okami remake", "Site", "Body", 1)
    search = {"title": "Ico", "site": "US", "query": 0, "itemSummaries": [{"itemId": "1", "title": "Ico PS2", "price": {"value": "5", "currency": "USD"}}]}
    (tmp_path / "s.json").write_text(json.dumps(search) + "\n" + json.dumps({**search, "query": 1}) + "\n")
    assert readers.read_searches(spark, str(tmp_path / "s.json")).count() == 1
    (tmp_path / "c.json").write_text(json.dumps({"board": "v", "pages": [{"threads": [{"no": 1, "time": 5, "com": "hi", "last_replies": [{"no": 2, "com": "yo"}]}]}]}))
    assert readers.posts_of(readers.read_threads(spark, str(tmp_path / "c.json"))).count() == 2


def test_index_sink_is_sticky(spark, tmp_path):
    line = spark.createDataFrame([("US", 1, 100.0, 10)], "site STRING, period INT, index_value DOUBLE, compared BIGINT")
    path = str(tmp_path / "index")
    sinks.write_index(line, spark.createDataFrame([("console",)], "title STRING"), path)
    sinks.write_index(line, spark.createDataFrame([("edition",)], "title STRING"), path)
    assert sinks.index_lines(spark, path, line).collect() == line.collect()
    assert {r.title for r in sinks.left_out(spark, path).collect()} == {"console", "edition"}


def run(stream, tmp_path, mode, write):
    query = (stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state"))
             .option("maxFilesPerTrigger", 1).foreachBatch(write).start())
    query.awaitTermination()


def test_stream_holds_and_health(spark, tmp_path):
    at = lambda h: NOW + dt.timedelta(hours=h)
    spark.createDataFrame([("a", at(0)), ("a", at(5)), ("b", at(1))], "title STRING, ts TIMESTAMP").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("title STRING, ts TIMESTAMP").parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
    run(jobs.surge_holds(stream), tmp_path / "h", "append", lambda b, n: b.write.mode("append").parquet(str(tmp_path / "out")))
    got = {r.title: r.held_until for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": at(5 + 48), "b": at(1 + 48)}
    shape = "feed STRING, at TIMESTAMP, ok BOOLEAN, latest TIMESTAMP"
    spark.createDataFrame([("f", at(0), False, None), ("f", at(1), False, None), ("g", at(0), True, at(-5)), ("g", at(1), True, at(-9))], shape).coalesce(1).write.parquet(str(tmp_path / "in2"))
    run(spark.readStream.schema(shape).parquet(str(tmp_path / "in2")), tmp_path / "s", "append",
        jobs.source_state_batches(str(tmp_path / "sources"), str(tmp_path / "out2")))
    got = {r.feed: (r.ok, r.failing_since, r.latest) for r in spark.read.parquet(str(tmp_path / "out2")).collect()}
    assert got == {"f": (False, at(0), None), "g": (True, None, at(-5))}


def test_stream_changes_over_several_batches(spark, tmp_path):
    at = lambda h: NOW + dt.timedelta(hours=h)
    shape = "title STRING, site STRING, stamp TIMESTAMP, copies DOUBLE, lowest DOUBLE, median DOUBLE"
    checks = [[("a", "US", at(0), 1.0, None, 2.0), ("a", "US", at(1), 1.0, None, 2.0), ("b", "US", at(0), 1.0, 1.0, 2.0)],
              [("a", "US", at(2), 1.0, None, 2.0), ("a", "US", at(3), 2.0, None, 2.0), ("b", "US", at(30), 1.0, 1.0, 2.0)],
              [("a", "US", at(4), 2.0, None, 2.0), ("a", "US", at(26), 2.0, None, 2.0)]]
    for batch in checks:
        spark.createDataFrame(batch, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
    run(stream, tmp_path / "c", "append", jobs.price_change_batches(str(tmp_path / "last"), str(tmp_path / "out")))
    got = sorted((r.title, r.stamp) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", at(0)), ("a", at(3)), ("a", at(26)), ("b", at(0)), ("b", at(30))]


def test_states_over_batches_that_are_repeated_or_cut_short(spark, tmp_path, monkeypatch):
    """Random fetches in batches against one walk through all of them; a batch is stopped before its state moves on."""
    import random

    from titletide.sources import tables

    draw, at = random.Random(4), lambda h: NOW + dt.timedelta(hours=h)
    write = jobs.source_state_batches(str(tmp_path / "state"), str(tmp_path / "out"))
    held, clock = {}, 0
    for batch_id in range(5):
        rows = []
        for _ in range(12):
            clock += 1
            ok = draw.random() < 0.5
            rows.append((draw.choice("fgh"), at(clock), ok, at(draw.randrange(-50, 50)) if ok else None))
        frame = spark.createDataFrame(rows, "feed STRING, at TIMESTAMP, ok BOOLEAN, latest TIMESTAMP").repartition(3)
        if batch_id == 2:
            with monkeypatch.context() as patch:
                patch.setattr(tables, "commit", lambda *_: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    write(frame, batch_id)
        for _ in range(2 if batch_id % 2 else 1):
            write(frame, batch_id)
        for feed, when, ok, latest in rows:
            _, since, newest = held.get(feed, (None, None, None))
            held[feed] = (ok, None if ok else since or when, max(filter(None, (newest, latest)), default=None))
        got = {r.feed: (r.ok, r.failing_since, r.latest) for r in spark.read.parquet(str(tmp_path / f"out/batch={batch_id}")).collect()}
        assert got == {feed: held[feed] for feed in {r[0] for r in rows}}


def test_a_key_with_very_many_rows_in_one_batch(spark, tmp_path):
    checks = spark.range(300_000).select(
        F.lit("a").alias("title"), F.lit("US").alias("site"), (F.lit(NOW).cast("timestamp") + F.make_dt_interval(secs=F.col("id") % 80_000)).alias("stamp"),
        F.lit(1.0).alias("copies"), F.lit(None).cast("double").alias("lowest"), F.floor(F.col("id") % 80_000 / 40_000).cast("double").alias("median"))
    jobs.price_change_batches(str(tmp_path / "last"), str(tmp_path / "out"))(checks, 0)
    got = sorted(r.stamp for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [NOW, NOW + dt.timedelta(seconds=40_000), NOW + dt.timedelta(seconds=43_200)]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    write, rows = jobs.batch_folders(str(tmp_path / "out")), spark.range(5)
    for batch_id in (0, 1, 1, 0):
        write(rows, batch_id)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    archive = jobs.archive_batches(str(tmp_path / "archive"))
    frame = items(spark, item(1, "Ico", headline="Two"), item(2, "Okami", headline="Three"))
    for _ in range(2):
        archive(frame, 0)
    assert spark.read.parquet(str(tmp_path / "archive")).count() == 2


def test_stream_snapshot_equals_batch(spark, tmp_path):
    first = items(spark, item(3, "Ico", link="https://l/1", headline="one"), item(1, link="https://l/2"))
    second = items(spark, item(0, "Ico", link="https://l/1", headline="two"), item(30, link="https://l/3"))
    write = jobs.snapshot_batches(str(tmp_path / "snap"), now())
    write(first, 0)
    write(second, 1)
    write(second, 1)
    got = {r.key: r.headline for r in jobs.rolling_snapshot(spark, str(tmp_path / "snap"), sn.with_key(first), now()).collect()}
    assert got == {"https://l/1": "two", "https://l/2": "a 1"}
