"""Near-duplicate vectors against all pairs."""

import math
import random

import numpy as np
import pytest

from titletide.llm import embeddings


def brute(table, threshold=0.9):
    good = [i for i, (_, v) in enumerate(table)
            if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {i: [] for i in range(len(table))}
    for i in good:
        for j in good:
            if i != j and len(table[i][1]) == len(table[j][1]):
                a, b = np.array(table[i][1], dtype=np.float64), np.array(table[j][1], dtype=np.float64)
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                    near[i].append(j)
    out = []
    for i in range(len(table)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((table[j][0] for j in seen if table[j][0] is not None), default=None)
        out.append((table[i][0], len(near[i]), least, table[i][0] == least))
    return out


def near_table(seed=1):
    draw = np.random.default_rng(seed)
    table, centres = [], draw.normal(size=(12, 16))
    for i in range(150):
        v = centres[draw.integers(12)] + draw.normal(scale=0.08, size=16) if i % 2 else draw.normal(size=16)
        table.append((i, [float(np.float32(x)) for x in v]))
    table += [(200 + i, table[1][1]) for i in range(5)] + [(210, [2 * x for x in table[3][1]])]
    table += [(300, None), (301, []), (302, [0.0] * 16), (303, [math.nan] * 16), (304, [math.inf] + [0.0] * 15),
              (305, [None] + [1.0] * 15), (306, [1.0, 2.0]), (307, [1.0, 2.0]), (None, table[5][1]), (7, table[7][1])]
    return table


@pytest.mark.parametrize("kind, tile", [("float", 4096), ("double", 8)])
def test_links_and_components(spark, monkeypatch, kind, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    table = near_table()
    random.Random(1).shuffle(table)
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in table], f"vec_id long, embedding array<{kind}>, class string, key int")
    got = embeddings.near_vectors(df.repartition(3)).collect()
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(brute(table), key=order)


def test_empty_table(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_right_at_the_threshold():
    """Pairs at a cosine of 0.9 share a key with the probability that the plan aims at."""
    draw = np.random.default_rng(2)
    bits, parts, codes = embeddings.table_plan(50_000, 64)
    a = draw.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = draw.normal(size=(1500, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.9 * a + math.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    centre, projections = embeddings.learn_rotations(np.concatenate((a, b)), codes)
    met = np.zeros(1500, dtype=bool)
    for p in projections:
        same = ((a - centre) @ p >= 0) == ((b - centre) @ p >= 0)
        for part in range(parts):
            met |= same[:, part * bits:(part + 1) * bits].all(axis=1)
    assert met.mean() >= 0.9


def test_forest_joins_what_is_linked():
    rows = np.array([[1, 0], [0.95, 0.3], [0.8, 0.6], [0, 1]], dtype=np.float64)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    links = embeddings.vector_forest(np.array([10, 11, 12, 13]), rows, 0.9)
    assert {frozenset(x) for x in links} == {frozenset((10, 11)), frozenset((11, 12))}


@pytest.mark.parametrize("length, vectors", [(0.0, 50_000), (1.0, 50_000), (1.0, 10_000_000), (2.0, 3_000_000), (5.0, 50_000)])
def test_recall_with_a_common_direction(length, vectors):
    """A mean as long as the spread, or longer, and plans for millions of vectors: pairs at 0.9 still share a key."""
    draw = np.random.default_rng(4)
    common = length * np.eye(64)[0]
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    sample, a = (unit(common + draw.normal(scale=1 / 8, size=(n, 64))) for n in (2000, 3000))
    side = draw.normal(size=a.shape)
    side = unit(side - (a * side).sum(axis=1, keepdims=True) * a)
    b = 0.9 * a + math.sqrt(1 - 0.81) * side
    bits, parts, centre, projections = embeddings.measured_plan(vectors, sample)
    met = np.zeros(len(a), dtype=bool)
    for p in projections:
        same = ((a - centre) @ p >= 0) == ((b - centre) @ p >= 0)
        for part in range(parts):
            met |= same[:, part * bits:(part + 1) * bits].all(axis=1)
    assert met.mean() >= 0.94
    assert bits > 0 or length == 5.0


def test_links_with_a_common_direction(spark):
    """Pairs at 0.901 among vectors whose unlike pairs are at about 0.5; each pair is a component."""
    draw = np.random.default_rng(6)
    a = draw.normal(size=(400, 64)) / 8 + np.eye(64)[0]
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = draw.normal(size=a.shape)
    side -= (a * side).sum(axis=1, keepdims=True) * a
    b = 0.901 * a + math.sqrt(1 - 0.901 ** 2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    table = [(i, v.tolist()) for i, v in enumerate(np.concatenate((a, b)))]
    got = embeddings.near_vectors(spark.createDataFrame(table, "vec_id long, embedding array<double>")).collect()
    assert sum(r.n_links > 0 for r in got) >= 0.94 * len(table)
