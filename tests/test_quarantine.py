"""Broken records go to the table of problems, and everything beside them is read."""

import json

from titletide.sources import readers


def kinds(intake):
    return sorted((r.place, r.problem, r.kept) for r in intake.problems.collect())


def test_threads(spark, tmp_path):
    threads = [{"no": 1, "sub": "a", "extra": {"x": 1}}, {"no": "one", "sub": "b"}, 7, None, {"sub": "c"}, {"no": 2, "images": "many"},
               {"no": 3, "last_replies": [{"no": "x", "com": "hi"}]}, {"no": 4, "time": None}]
    (tmp_path / "a.json").write_text(json.dumps({"board": "v", "pages": [{"threads": threads}, 5, {"threads": []}, {"threads": {"no": 9}},
                                                                         {"threads": [{"no": 5}]}]}, indent=1))
    (tmp_path / "b.json").write_text('{"board": "w", "pages": [{"threads": [{"no": 8}')
    (tmp_path / "c.json").write_text('{"pages": []}')
    (tmp_path / "d.json").write_text('[{"board": "x", "pages": []}]')
    (tmp_path / "e.json").write_text("")
    found = readers.threads_intake(spark, str(tmp_path))
    rows = {r.no: r for r in found.rows.collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5] and {r.board for r in rows.values()} == {"v"}
    assert rows[1].rescued == {"extra": '{"x":1}'} and rows[2].rescued == {"images": "many"} and rows[2].images is None
    assert rows[4].rescued is None
    assert kinds(found) == sorted([
        ("0/1", "wrong type: no", False), ("0/2", "unreadable", False), ("0/3", "unreadable", False), ("0/4", "missing: no", False),
        ("0/5", "wrong type: images", True), ("0/6", "wrong type: last_replies", True) if rows[3].last_replies is None else
        ("0/6", "wrong type inside", True), ("1", "unreadable", False), ("3", "wrong type: threads", False),
        ("", "unreadable", False), ("", "missing: board", False), ("", "unreadable", False)])
    files = {r.place: r.file for r in found.problems.where("place <> ''").collect()}
    assert all(f.endswith("a.json") for f in files.values())


def test_listings(spark, tmp_path):
    good = {"itemId": "1", "title": "Ico", "price": {"value": "5", "currency": "USD"}}
    lines = [{"title": "Ico", "site": "US", "query": 0, "itemSummaries": [good, "gone", {**good, "itemId": "2", "price": 7}]},
             {"title": "Ico", "site": "US", "query": "first", "itemSummaries": [{**good, "itemId": "3"}]},
             {"title": "Ico", "query": 0, "itemSummaries": []}, {"title": "Rez", "site": "US", "query": 0}]
    (tmp_path / "s.json").write_text("\n".join(json.dumps(x) for x in lines) + "\n\nnot json\n")
    found = readers.searches_intake(spark, str(tmp_path))
    assert sorted((r.item.itemId, r.item.price and r.item.price.value, r.pos) for r in found.rows.collect()) == [("1", "5", 0), ("2", None, 2)]
    assert kinds(found) == [("", "missing: site", False), ("", "unreadable", False), ("", "wrong type: query", False),
                            ("1", "unreadable", False), ("2", "wrong type: price", True)]
    assert {r.item_id for r in readers.read_searches(spark, str(tmp_path)).collect()} == {"1", "2"}


def test_repeated_and_missing_fields(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"title": "a", "title": "b", "odd": 1, "odd": 2}\n{"title": null}\n[1]\n{"title": "c", "tags": "t"}\n')
    found = readers.entries_intake(spark, str(tmp_path))
    assert sorted(r.title or "" for r in found.rows.collect()) == ["", "b", "c"]
    assert kinds(found) == [("", "unreadable", False), ("", "wrong type: tags", True)]


def test_rates(spark, tmp_path):
    day = lambda date, rates: f"<Envelope><Cube><Cube time='{date}'>" + "".join(
        f"<Cube currency='{c}' rate='{r}'/>" for c, r in rates.items()) + "</Cube></Cube></Envelope>"
    all_ = {"USD": 1.1, "GBP": 0.9, "PLN": 4.2, "CHF": 0.95}
    for name, text in {"good": day("2026-10-16", all_), "rate": day("2026-10-17", {**all_, "GBP": "n/a", "PLN": 5000}),
                       "gap": day("2026-10-18", {"USD": 1, "GBP": 1, "PLN": 1}), "date": day("soon", all_), "cut": day("2026-10-19", all_)[:80]}.items():
        (tmp_path / f"{name}.xml").write_text(text)
    found = readers.fx_intake(spark, str(tmp_path))
    assert {str(r.date) for r in found.rows.collect()} == {"2026-10-16"}
    assert {r.file.rsplit("/", 1)[1]: r.problem for r in found.problems.collect()} == {
        "rate.xml": "rates: GBP, PLN", "gap.xml": "rates: CHF", "date.xml": "no date", "cut.xml": "unreadable"}


def test_no_input(spark, tmp_path):
    (tmp_path / "e.json").write_text("\n")
    for read in (readers.entries_intake, readers.threads_intake, readers.searches_intake, readers.fx_intake):
        found = read(spark, str(tmp_path))
        assert found.rows.count() == 0 and found.problems.count() == 0


def test_odd_keys(spark, tmp_path):
    """Keys that are unknown, repeated, blank or named like the reader's own column; blanks and marks before the object."""
    lines = ['{"title": "a"}', '  {"title": "b", "odd": {"x": [1]}}', '{"title": "c", "title": null}', '{"title": null, "title": "d"}',
             '{"title": "e", "_unfit": "f"}', '{"title": "g", "tags": [{"term": 1, "more": 2}], "": 3}', '{}', '{"title": "h"} tail',
             '{"title": "i"', "{'title': 'j'}", '﻿{"title": "k"}', '{"title": "l", "position": 1.5, "tags": null}',
             '{"title": "m", "enclosures": [{"href": "n"}, 7]}', '{"tit\\u006ce": "o"}', '[{"title": "p"}]', '"q"']
    (tmp_path / "e.json").write_text("\n".join(lines) + "\n", encoding="utf-8")
    found = readers.entries_intake(spark, str(tmp_path))
    rows = found.rows.collect()
    assert sorted((r.title or "", sorted((r.rescued or {}).items())) for r in rows) == [
        ('', []), ('', [('title', None)]), ('a', []),
        ('b', [('odd', '{"x":[1]}')]), ('d', []), ('e', [('_unfit', 'f')]),
        ('g', [('', '3')]), ('h', []), ('j', []),
        ('l', [('position', '1.5')]), ('m', [('enclosures', '[{"href":"n"},7]')]), ('o', [])]
    assert kinds(found) == [
        ('', 'unreadable', False), ('', 'unreadable', False), ('', 'unreadable', False),
        ('', 'unreadable', False), ('', 'wrong type: enclosures', True), ('', 'wrong type: position', True),
        ('', 'wrong type: title', True)]


def test_fitting_records_are_read_once(spark, tmp_path):
    """Listings without a fault take one reading a layer, and no reading of their keys when nobody asks for them."""
    (tmp_path / "s.json").write_text(json.dumps({"title": "Ico", "site": "US", "query": 0, "itemSummaries": [{"itemId": "1"}]}) + "\n")
    plan = readers.read_searches(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    steps = [line for line in plan.split("\n") if "Generate " in line]
    assert len(steps) == 3 and not any("MapType" in step for step in steps)
    assert plan.lower().count("jsonobjectkeys") + plan.count("json_object_keys") == 1
