"""Searches in cells against plain folds and all pairs: clusters, independent vectors, copies, ties, hot blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import match, metric

SCHEMA = "id int, b string, fp array<double>"


def made(kind, n=600, size=6, seed=5):
    rng = np.random.default_rng(seed)
    if kind == "clusters":
        marks = rng.uniform(-40, 40, (25, size))
        points = marks[rng.integers(0, 25, n)] + rng.normal(0, 0.25, (n, size))
    elif kind == "one hot cluster":
        points = np.where(rng.random((n, 1)) < 0.6, rng.normal(0, 0.05, (n, size)), rng.uniform(-9, 9, (n, size)))
    else:
        points = rng.normal(0, 1, (n, size))
    points[rng.integers(0, n, n // 10)] = points[:n // 10]  # copies
    block = ["big" if i % 3 else f"s{i % 5}" if i % 2 else None for i in range(n)]
    rows = [(i, block[i], points[i].tolist()) for i in range(n)]
    return [*rows, (n, "big", None), (n + 1, "big", []), (n + 2, "big", [1.0]), (n + 3, "big", [1.0]), (n + 4, "alone", [0.0] * size)]


KINDS = ["clusters", "one hot cluster", "independent"]


def by_block(rows, null=True):
    out = {}
    for i, b, v in rows:
        if v and (null or b is not None):
            out.setdefault((b, len(v)), []).append((i, np.array(v)))
    return out


@pytest.mark.parametrize("kind", KINDS)
def test_unique_is_the_fold(spark, kind):
    rows, want = made(kind), set()
    for members in by_block(rows).values():
        kept = []
        for i, v in members:
            if all(1 / (1 + np.abs(v - u).mean()) < 0.8 for u in kept):
                kept.append(v)
                want.add(i)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit("clash")).repartition(3)
    for cell_rows in (20, 10_000):
        found = match.unique(frame, ["b"], "id", 0.8, cell_rows=cell_rows)
        assert found.columns == ["b", "id"] and {r["id"] for r in found.collect()} == want
    assert match.unique(frame.limit(0), ["b"], "id", 0.8).count() == 0


@pytest.mark.parametrize("kind", KINDS)
def test_close_pairs_are_all(spark, kind):
    rows = made(kind)
    every = [(i, j, 1 / (1 + np.abs(u - v).mean())) for m in by_block(rows, False).values() for a, (i, u) in enumerate(m) for j, v in m[a + 1 :]]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("gap", F.lit("clash")).repartition(3)
    found = match.close_pairs(frame, ["b"], "id", 0.8, cell_rows=20)
    assert sorted((r["i"], r["j"]) for r in found.collect()) == sorted((i, j) for i, j, s in every if s >= 0.8)
    met = metric.candidates(frame, ["b"], "id", 0.8, cell_rows=20).count()
    assert met <= len(every)
    if kind == "clusters":  # where rows differ by many times the reach, few pairs meet
        assert met * 10 < len(every), (met, len(every))


@pytest.mark.parametrize("kind", KINDS)
def test_nearest_are_exact(spark, kind):
    rows = made(kind)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    targets = frame.where("id % 20 = 0").union(spark.createDataFrame([(-1, "nowhere", [0.0] * 6), (-2, "big", None)], SCHEMA))
    want = {}
    for members in by_block(rows, False).values():
        for i, u in members:
            if i % 20 == 0:
                gaps = sorted((round(float(np.sqrt(((u - v) ** 2).sum())), 9), j) for j, v in members if j != i)[:4]
                want[i] = [j for _, j in gaps]
    for cell_rows in (20, 10_000):
        found = {}
        for r in metric.nearest(targets, frame, ["b"], 4, others=True, cell_rows=cell_rows).collect():
            found.setdefault(r["target"], {})[r["n"]] = r["partner"]
        assert {t: [x[n] for n in sorted(x)] for t, x in found.items()} == {t: x for t, x in want.items() if x}


def test_nearest_in_a_unique_set(spark):
    rows = spark.createDataFrame([(i, "a", [v]) for i, v in enumerate((0.0, 0.001, 0.002, 5.0, 9.0))], SCHEMA)
    target = spark.createDataFrame([(7, "a", [0.002])], SCHEMA)
    plain = match.nearest_rescored(target, rows, ["b"], 2).orderBy("rank").collect()
    cut = match.nearest_rescored(target, rows, ["b"], 2, cut=0.99).orderBy("rank").collect()
    assert [r["partner"] for r in plain] == [2, 1] and [r["partner"] for r in cut] == [0, 3]
