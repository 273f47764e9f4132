"""Whitened vectors and their eigensolver against numpy's own, on odd rows too."""

import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from titletide.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def steps(vector):
    return tuple(math.floor(64 * float(c)) + 1_000_000 for c in vector)


def usable(vector):
    return vector is not None and len(vector) > 0 and all(c is not None and math.isfinite(c) for c in vector)


def brute(table, components=16):
    """For one length of vectors: {(id, component)}: (n, deviation, whitened up to sign, explained)."""
    rows = [(i, steps(v)) for i, v in table if usable(v)]
    fit = sorted({x for _, x in rows})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in fit])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    out = []
    for i, x in rows:
        off = [n * a - s for a, s in zip(x, sums)]
        for j in range(min(components, len(sums))):
            e, u = values[-1 - j], vectors[:, -1 - j]
            out.append((i, j + 1, n, sum(o * o for o in off), abs(float(np.array([float(Fraction(o, n)) for o in off]) @ u) / math.sqrt(e)),
                        e / np.trace(covariance)))
    return out


def check(got, wanted, close=1e-8):
    order = lambda r: (r[0] is None, r[0] or 0, r[1], abs(r[4]))
    got = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got), key=order)
    wanted = sorted(wanted, key=order)
    assert [r[:4] for r in got] == [r[:4] for r in wanted]
    assert np.allclose([r[4] for r in got], [r[4] for r in wanted], rtol=close, atol=close)
    assert np.allclose([r[5] for r in got], [r[5] for r in wanted], rtol=1e-10)


def test_against_brute_force(spark):
    draw = np.random.default_rng(3)
    table = [(i, (draw.normal(size=20) * np.arange(1, 21) / 3 + 5).tolist()) for i in range(300)]
    table += [(1000 + i, table[7][1]) for i in range(50)] + [(7, table[8][1]), (None, table[9][1])]
    bad = [(2000, None), (2001, []), (2002, [math.nan] * 20), (2003, [1.0] * 19 + [None]), (2004, [math.inf] + [1.0] * 19)]
    wide = [(i, v, 1, "x") for i, v in table + bad]
    df = spark.createDataFrame(wide, "vec_id long, embedding array<double>, component int, x string").repartition(5)
    got = whitening.whitened_vectors(df).collect()
    check(got, brute(table))
    assert {r.identity_error for r in got} == {got[0].identity_error} and 0 <= got[0].identity_error < 1e-9
    signs = defaultdict(set)
    for r in got:
        if r.vec_id == 7 and r.component == 1 or r.vec_id in (8, 1000):
            signs[r.component].add(r.whitened)
    assert all(signs.values())


def test_whole_table_of_the_query(spark):
    read = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check(queries.op13_embedding_whitening(spark, SF).collect(), brute([(r.vec_id, r.embedding) for r in read]))


def test_empty_equal_and_parted_lengths(spark):
    make = lambda rows: whitening.whitened_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert make([]).count() == 0
    assert make([(1, [1.0, 2.0]), (2, [1.0, 2.0])]).count() == 0  # no spread, no component
    two = [(1, [0.0, 0.0]), (2, [1.0, 0.5]), (3, [0.25, 2.0])]
    three = [(4, [0.0, 0.0, 1.0]), (5, [1.0, 0.5, 0.0]), (6, [0.25, 2.0, 0.5]), (7, [3.0, 1.0, 1.0])]
    check(make(two + three).collect(), brute(two) + brute(three))
    flat = make([(1, [0.0, 5.0]), (2, [1.0, 5.0])]).collect()  # one dimension without spread: one component
    assert sorted((r.vec_id, r.component, r.whitened) for r in flat) == [(1, 1, -1.0), (2, 1, 1.0)]
    assert {r.explained for r in flat} == {1.0}


def test_large_entries_keep_their_digits(spark):
    """Beyond 2^53 a deviation is exact still, and null where it does not fit a long."""
    table = [(1, [3.0e7, 1.0]), (2, [-2.0e7, 2.0]), (3, [1.0e6, 3.5]), (4, [1.0, 0.0])]
    got = whitening.whitened_vectors(spark.createDataFrame(table, "vec_id long, embedding array<double>")).collect()
    rows = [steps(v) for _, v in table]
    sums = [sum(c) for c in zip(*rows)]
    wanted = [sum((4 * a - s) ** 2 for a, s in zip(x, sums)) for x in rows]
    by_id = {r.vec_id: r.deviation for r in got}
    assert [by_id[i] for i, _ in table] == [d if d < 1 << 63 else None for d in wanted]
    assert None in by_id.values() and any(d and d > 1 << 53 for d in by_id.values())


@pytest.mark.parametrize("kind", ["random", "clusters", "equal", "parted", "graded", "wilkinson", "rank"])
def test_eigensolver(kind):
    draw = np.random.default_rng(5)
    n = 48
    turn = np.linalg.qr(draw.normal(size=(n, n)))[0]
    spectrum = {"random": draw.uniform(0.1, 9, n), "clusters": np.repeat([5.0, 2.0, 1.0], 16) + draw.uniform(0, 1e-9, n),
                "equal": np.repeat([4.0, 1.0], 24), "graded": 10.0 ** -np.arange(n), "rank": np.r_[np.arange(1, 6), np.zeros(n - 5)]}
    if kind == "parted":
        matrix = np.diag(np.r_[np.full(10, 3.0), np.arange(1, n - 9)])
    elif kind == "wilkinson":
        matrix = np.diag(np.abs(np.arange(n) - n / 2)) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
    else:
        matrix = turn @ np.diag(spectrum[kind]) @ turn.T
        matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.leading_components(matrix, 16)
    whole = np.linalg.eigvalsh(matrix)[::-1]
    assert len(values) == (5 if kind == "rank" else len(values)) and len(values) >= (5 if kind == "rank" else 14)
    size = np.abs(whole).max()
    assert np.allclose(values, whole[:len(values)], atol=1e-13 * size)
    assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12)
    assert np.allclose(matrix @ vectors.T, vectors.T * values, atol=1e-12 * size)
