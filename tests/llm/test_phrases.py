"""Repeated phrases against every window written out."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.compare import compare, duck
from tests.llm.test_documents import ODD, frame
from titletide.llm import phrases, queries
from titletide.llm.sql import SQL

SF = "/root/testdata/sf0.001"


def brute(table, window=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in table]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(table, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((doc, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def same(got, wanted):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=key) == sorted(wanted, key=key)
    for r in got:
        assert sum(s.length for s in r.spans) == r.n_removed
        assert all(a.start + a.length < b.start for a, b in zip(r.spans, r.spans[1:]))


def drifting(seed, n=150, words=30):
    """Documents put together from passages, with edits, so that repeats begin and end anywhere."""
    draw = random.Random(seed)
    say = lambda k: [f"w{draw.randrange(words)}" for _ in range(k)]
    pool = [say(draw.randrange(20, 130)) for _ in range(25)]
    table = []
    for i in range(n):
        text = []
        for _ in range(draw.randrange(4)):
            p = draw.choice(pool)
            low = draw.randrange(len(p) // 2)
            part = p[low:low + draw.randrange(10, 120)]
            if draw.random() < 0.3 and part:
                part[draw.randrange(len(part))] = "edited"
            text += part + say(draw.randrange(8))
        table.append((i, draw.choice([" ", "\n", " \t "]).join(text)))
    return table


@pytest.mark.parametrize("seed, block, shard", [(1, 4 << 20, 400_000), (2, 2_000, 400_000), (3, 500, 120), (4, 9_000, 2_000)])
def test_against_brute_force(spark, monkeypatch, seed, block, shard):
    monkeypatch.setattr(phrases, "BLOCK", block)
    monkeypatch.setattr(phrases, "SHARD", shard)
    table = drifting(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in table], "doc_id long, text string, seeds string").repartition(3)
    same(phrases.without_phrases(df).collect(), brute(table))


def test_odd_rows(spark):
    periodic = [(100, "a " * 200), (101, "a b " * 100), (102, " ".join(["c"] * 35)), (103, " ".join(["d"] * 36)),
                (104, "x\x1cy\x85z w\xa0 " * 40), (105, "one two three " * 30 + "a " * 40)]
    table = ODD + periodic
    same(phrases.without_phrases(frame(spark, table)).collect(), brute(table))
    assert phrases.without_phrases(frame(spark, [])).count() == 0
    same(phrases.without_phrases(frame(spark, [(1, None), (None, None)])).collect(), [(1, 0, 0, ""), (None, 0, 0, "")])


@pytest.mark.parametrize("window", [1, 5, 12, 13])
def test_other_windows(spark, window):
    table = [(i, t[:400]) for i, t in drifting(9, 40, 400)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    same(phrases.without_phrases(df, window=window).collect(), brute(table, window))


def test_one_seed_with_like_and_unlike_segments(spark):
    """Two whole copies confirm a passage; a third document shares only half of it, ending inside a segment."""
    base = [f"v{i}" for i in range(90)]
    table = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(base[20:61])), (4, " ".join(["q", *base[40:75], "r"])),
             (5, " ".join(base[:34])), (6, " ".join([*base[60:90], *base[:30]]))]
    same(phrases.without_phrases(spark.createDataFrame(table, "doc_id long, text string")).collect(), brute(table))


def test_pairs_are_told_apart_by_both_sums():
    one, two = np.array([1, 1, 2, 3]), np.array([5, 6, 5, 9])
    for known in ([(1, 5), (2, 5)], [(1, 5), (1, 7), (3, 9)], []):
        pairs = np.array(known, dtype=np.int64).reshape(-1, 2)
        assert phrases._among(one, two, pairs[:, 0], pairs[:, 1]).tolist() == [p in known for p in zip([1, 1, 2, 3], [5, 6, 5, 9])]


def test_least_of_each_window():
    draw = np.random.default_rng(1)
    keys = draw.integers(0, 6, 300).astype(np.uint64)
    for width in (1, 2, 3, 7, 16, 24, 31):
        got = phrases._least(keys, width)
        assert [int(x) for x in got] == [i + int(np.argmin(keys[i:i + width])) for i in range(300 - width + 1)]


def test_words_of_many_kinds_are_spelled_apart():
    for n in (1, 64, 65, 5_000, 70_000):
        ids = np.arange(n + 1)
        text, width = phrases._spelled(ids, np.arange(n), n + 1)
        words = [text[i * width:(i + 1) * width] for i in range(n + 1)]
        assert len(set(words)) == n + 1 and not {w[0] for w in words} & {c for w in words[:-1] for c in w[1:]}


def test_digest_and_twin(spark):
    got = queries.op12_repeated_phrases(spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    wanted = [(d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in brute(docs)]
    assert sorted(map(tuple, got)) == sorted(wanted) and sum(r.n_removed for r in got) > 0
    assert compare(spark, duck(SF), SF, queries.op12_repeated_phrases, SQL["op12_repeated_phrases"]) is None
