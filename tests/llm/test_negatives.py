"""Hard negatives and their residue products against plain integers."""

import math
import random

import numpy as np
import pytest

from tests.compare import compare, duck
from titletide.llm import negatives, queries
from titletide.llm.sql import SQL

SF = "/root/testdata/sf0.001"


def brute(table):
    """Rows of (id, vector, label), written as the contract has it."""
    rows = []
    for place, (i, v, label) in enumerate(table):
        if label is None or v is None or not v or any(c is None or not math.isfinite(c) for c in v):
            continue
        label = int(math.fmod(label + 1, 10)) if i is not None and i % 7 == 0 else label
        rows.append((i, label, [math.floor(256 * float(c)) for c in v], place))
    out = []
    for i, label, x, place in rows:
        if i is None or i % 50:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(x, y)), math.inf if j is None else j, at, j, other)
                         for j, other, y, at in rows if at != place and len(y) == len(x)), key=lambda r: r[:3])
        for s, _, _, j, _ in [r for r in scored if r[4] == label][:5]:
            p = -s
            near = [r for r in scored if r[4] != label and 50 * p <= -100 * r[0] <= 95 * p][:3]
            out += [(i, j, rank, r[3], p, -r[0]) for rank, r in enumerate(near, 1)]
    return out


def same(got, wanted):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(wanted, key=key)


def run(spark, table, kind="float"):
    wide = [(i, v, label, 1, "x") for i, v, label in table]
    df = spark.createDataFrame(wide, f"vec_id long, embedding array<{kind}>, label int, place int, score string")
    return negatives.hard_negatives(df.repartition(3)).collect()


def odd_table(n=260, dimensions=10):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(4, dimensions)) + 1
    table = [(i, [float(np.float32(x)) for x in centres[i % 4] + draw.normal(scale=0.6, size=dimensions)], int(draw.integers(3)))
             for i in range(n)]
    table += [(1000 + i, table[50][1], i % 2) for i in range(12)]  # ties
    table += [(-50, table[3][1], 1), (2000, [0.0] * dimensions, 2), (2001, None, 1), (2002, table[1][1], None), (2003, [], 1),
              (2004, [math.nan] * dimensions, 1), (2005, [None] * dimensions, 1), (2006, [math.inf] * dimensions, 1),
              (None, table[50][1], 0), (None, table[50][1], 1), (2050, [1.0, 2.0], 1), (2051, [1.0, 2.0], 1), (2052, [0.75, 1.5], 2)]
    return table


@pytest.mark.parametrize("anchors, rows, spread", [(4096, 1024, 2048), (2, 16, 32)])
def test_against_brute_force(spark, monkeypatch, anchors, rows, spread):
    for name, value in (("ANCHORS", anchors), ("ROWS", rows), ("SPREAD", spread)):
        monkeypatch.setattr(negatives, name, value)
    table = odd_table()
    random.Random(3).shuffle(table)
    wanted = brute(table)
    assert len(wanted) > 60
    same(run(spark, table), wanted)


def test_repeated_ids_and_large_components(spark):
    draw = np.random.default_rng(8)
    table = [(50 * (i % 4), (900 * draw.normal(size=70) + 2000).tolist(), i % 3) for i in range(40)]
    got, wanted = run(spark, table, "double"), brute(table)
    key = lambda r: (r[0], r[2], r[4], r[5])  # noqa: E731 - places of equal ids follow the partitions
    assert sorted(map(key, got)) == sorted(map(key, wanted)) and got


def test_empty_and_no_anchor(spark):
    assert run(spark, []) == [] and run(spark, [(1, [1.0, 2.0], 1), (None, [1.0, 2.0], 2)]) == []
    assert run(spark, [(50, [1.0, 2.0], 1)]) == []


def test_windows_at_the_edges(spark):
    """Scores of exactly half and of 95 hundredths count; a positive of zero takes negatives of zero."""
    unit = 1 / 256
    table = [(50, [unit, 0.0], 1), (1, [100 * unit, 0.0], 1), (2, [50 * unit, 0.0], 2), (3, [95 * unit, 0.0], 2), (4, [96 * unit, 0.0], 2),
             (5, [49 * unit, 0.0], 2), (6, [0.0, 0.0], 1), (8, [0.0, unit], 3), (9, [-3 * unit, 0.0], 1), (10, [-2 * unit, 0.0], 2)]
    got = run(spark, table, "double")
    same(got, [(50, 1, 1, 3, 100, 95), (50, 1, 2, 2, 100, 50), (50, 6, 1, 8, 0, 0)])
    same(got, brute(table))


def test_refused_scores(spark):
    with pytest.raises(Exception, match="scores may reach"):
        run(spark, [(50, [1e9, 1.0], 1), (51, [1e9, 2.0], 1)], "double")


@pytest.mark.parametrize("size, dimensions", [(3, 5), (300, 64), (5000, 200), (1 << 22, 130)])
def test_residue_products(size, dimensions):
    draw = np.random.default_rng(2)
    a, b = draw.integers(-size, size + 1, (40, dimensions)), draw.integers(-size, size + 1, (50, dimensions))
    a[0], b[0], a[1], b[1] = size, size, -size, size
    bound = negatives.largest_score(b, a)
    assert (negatives.Residues(a, bound).scores(negatives.Residues(b, bound)) == a @ b.T).all()
    assert all(negatives.STRIPE * (p // 2) ** 2 < 1 << 24 for p in negatives.primes()) and negatives.primes()[0] == 1021


def test_twin(spark):
    assert compare(spark, duck(SF), SF, queries.op11_hard_negatives, SQL["op11_hard_negatives"]) is None
