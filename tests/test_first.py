"""Searches that end early or score few pairs: first matches, classes, the best by coded vectors; sums place by place."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.test_tiles import SCHEMA, sides  # noqa: F401  the same odd rows, in strips of 7 and of 8192
from weft.operators import match, tiles


def part(ids, data):
    return tiles.Part(pa.table({"_id": pa.array(ids), "_flag": pa.array([True] * len(ids)), "_fp": pa.array(data.tolist(), pa.list_(pa.float64()))}))


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 4), (70, 130, 3), (64, 11, 9)])
def test_sums_place_by_place(monkeypatch, shape):
    """Those of a fold to the last bit, in blocks of any size; a tile's places lie side by side, and aren't copied for each slab."""
    monkeypatch.setattr(tiles, "ACROSS", 7)
    monkeypatch.setattr(tiles, "SUMS", 200)
    n, m, width = shape
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(n, width)), rng.normal(size=(m, width))
    want = np.zeros((n, m))
    for x, y in zip(a.T, b.T, strict=True):
        want += np.abs(x[:, None] - y)
    held = part(list(range(m)), b)
    assert held.data.T.flags.c_contiguous and held.flagged_first().data.T.flags.c_contiguous
    for right in (b, held.data, held.data[1:], b[:0]):
        assert np.array_equal(tiles.l1_sum(a, right), want[:, m - len(right) :])


@pytest.mark.parametrize("kind", ["even", "ties", "outlier", "one place", "negative"])
def test_few_best_by_coded_vectors(monkeypatch, kind):
    """The k best with their scores to the last bit, ties by the least id; of even vectors few pairs are scored."""
    rng = np.random.default_rng(6)
    rows = {"even": lambda n: rng.normal(size=(n, 64)), "ties": lambda n: rng.integers(0, 2, (n, 5)) * 1.0, "one place": lambda n: rng.normal(size=(n, 1)), "negative": lambda n: -1e12 - rng.random((n, 8))}
    a, b = (rows.get(kind, rows["even"])(n) for n in (100, 500))
    if kind == "outlier":  # all others have one code
        b[7] = 1e9
    left, right = part(list(range(100)), a), part(list(range(50, 550)), b)
    score = tiles.l1(a, b)
    scored = []
    paired = tiles.l1_paired
    monkeypatch.setattr(tiles, "l1_paired", lambda x, y: scored.append(len(x)) or paired(x, y))
    for k, others in ((1, False), (3, True), (600, True)):
        scored.clear()
        found = [x for i, j, v in tiles._few(left, right, k, others, tiles._coded(left.data, right.data)) for x in zip(i.tolist(), j.tolist(), v.tolist(), strict=True)]
        want = [(i, j, score[i, j]) for i in range(100) for j in sorted((j for j in range(500) if not (others and i == j + 50)), key=lambda j: (-score[i, j], j))[:k]]
        assert found == want
        if kind == "even" and k < 600:
            assert 0 < sum(scored) < score.size / 20


def test_coded_where_it_tells_something():
    plain = np.ones((2, 4))
    for a in (plain, plain * np.inf, plain * np.nan, np.array([[0.0] * 4, [5e-324] * 4]), np.array([[-1.7e308] * 4, [1.7e308] * 4]), np.eye(2, 2000)):
        assert tiles._coded(a, a) is None
    assert tiles._coded(plain, 2 * plain)[1].max() == 65534 // 4


def test_first_matches_end_early(spark):
    """No target is scored with all of its block when its first matches are among the least ids; nor is a class."""
    seen = spark.sparkContext.accumulator(0)

    def test(score):
        seen.add(score.size)
        return score > 0.5

    rows = spark.range(6000).select("id", F.lit("b").alias("b"), F.array(F.rand(3), F.rand(4)).alias("fp"))
    some = rows.where("id % 100 = 0")
    assert tiles.within(some, rows, ["b"], test, others=True, first=2).count() == 120
    assert 0 < seen.value < 60 * 6000 / 4


def test_heads_hold_the_least_ids(spark, monkeypatch):
    monkeypatch.setattr(tiles, "STRIP", 64)
    rows = spark.range(6000).select(F.col("id"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("b"), F.array(F.rand(3)).alias("fp"))
    rows = rows.unionByName(spark.createDataFrame([(1, "few", [1.0]), (None, "hot", [1.0]), (5, None, [1.0]), (6, "hot", None), (7, "hot", [])], SCHEMA))
    head, rest = ({b: sorted((r["id"] for r in side.where(F.col("b") == b).collect()), key=lambda i: -1 if i is None else i) for b in ("hot", "cold", "few")} for side in tiles.headed(rows, ["b"]))
    assert head["few"] == [1] and not rest["few"] and head["hot"][0] is None
    for b in ("hot", "cold"):
        assert 0 < len(head[b]) < 1000 and head[b][-1] < rest[b][0]
        assert [i for i in head[b] + rest[b] if i is not None] == [i for i in range(6000) if (i % 3 > 0) == (b == "hot")]
    head, rest = tiles.headed(rows.drop("b"), [])
    assert 0 < head.count() < 1000 and head.count() + rest.count() == 6003


@pytest.mark.parametrize("threshold", [0.55, 2.0])
def test_classes_are_those_of_the_best(sides, threshold):  # noqa: F811
    _, frame = sides
    for others in (True, False):
        want = match.best_match(frame, frame, ["b"], threshold, others=others)
        found = match.classes(frame, frame, ["b"], threshold, others=others)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.select("target", "class").collect()))


def test_first_matches_of_an_id_in_two_blocks(spark, monkeypatch):
    """The least partners of both, though one block's come late in it."""
    monkeypatch.setattr(tiles, "STRIP", 16)
    population = [(i, "a" if i % 2 else "b", [1.0] if i % 2 or i > 600 else [9.0]) for i in range(1000)]
    targets = [(2000, "a", [1.0]), (2000, "b", [9.0]), (2001, "b", [1.0]), (2002, "b", [5.0])]
    found = match.first_matches(spark.createDataFrame(targets, SCHEMA), spark.createDataFrame(population, SCHEMA), ["b"], 0.9, 3)
    got = sorted((r["target"], r["rank"], r["partner"]) for r in found.collect())
    assert got == [(2000, 1, 0), (2000, 2, 1), (2000, 3, 2), (2001, 1, 602), (2001, 2, 604), (2001, 3, 606)]


@pytest.mark.parametrize("kind", ["int", "bigint", "string"])
def test_a_population_in_order_by_lists_of_bytes(spark, monkeypatch, kind):
    """Ids of any type; ties by the least partner. Numbers are moved as bytes."""
    monkeypatch.setattr(tiles, "STRIP", 16)
    rng = np.random.default_rng(9)
    rows = [(i, "ab"[i % 2], [float(x) for x in rng.integers(0, 3, 3)]) for i in range(80)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.col("id").cast(kind))
    found = match.below(frame, frame, 0.7, ["b"], others=True)
    name = str if kind == "string" else int
    pairs = [(name(t), name(p), 1 / (1 + sum(abs(x - y) for x, y in zip(u, v, strict=True)) / 3)) for t, b, u in rows for p, c, v in rows if b == c and t != p]
    assert [tuple(r) for r in found.collect()] == sorted((x for x in pairs if x[2] < 0.7), key=lambda x: (x[0], -x[2], x[1]))
    plan = found._jdf.queryExecution().analyzed().treeString()
    assert "octet_length(scores" in plan and "size(scores" not in plan
