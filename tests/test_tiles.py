"""Tiles against plain accounts: several strips, ties, copies of ids, NULLs, vectors of odd lengths; how a hot block is dealt."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import vectors
from weft.operators import match, metric, tiles

SCHEMA = "id int, b string, fp array<double>"


def likeness(u, v):
    return 1 / (1 + sum(abs(x - y) for x, y in zip(u, v, strict=True)) / len(u)) if len(u) == len(v) and None not in u and None not in v else None


@pytest.fixture(params=[7, 8192])
def sides(spark, monkeypatch, request):
    monkeypatch.setattr(tiles, "STRIP", request.param)
    rng = np.random.default_rng(1)
    rows = [(i, ("hot", "hot", "cold", None)[i % 4], [float(x) for x in rng.integers(0, 3, 4)]) for i in range(90)]
    rows += [(90, "hot", [1.0]), (91, "hot", None), (92, "hot", []), (93, "hot", [1.0, None, 2.0, 0.0]), (94, "odd", [1.0]), (95, "odd", [2.0, 3.0]), (5, "hot", [0.0] * 4)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def pairs(rows, others=True):
    return [(t, p, likeness(u, v)) for t, b, u in rows for p, c, v in rows if u and v and b is not None and b == c and not (others and t == p)]


def test_best_few(sides):
    rows, frame = sides
    want = {}
    for t, p, s in pairs(rows):
        want.setdefault(t, []).append((s is None, -(s or 0), p))
    found = {}
    for r in match.top_matches(frame, frame, ["b"], 3, others=True).collect():
        found.setdefault(r["target"], []).append((r["rank"], r["partner"], r["score"]))
    assert {t: [(p, s) for _, p, s in sorted(x, key=lambda y: y[0])] for t, x in found.items()} == {t: [(p, None if no else -s) for no, s, p in sorted(x)[:3]] for t, x in want.items()}


def test_bounds_counts_and_order(sides):
    rows, frame = sides
    all_pairs = pairs(rows)
    keyed = lambda found: sorted(map(tuple, found.collect()))
    assert keyed(match.similar(frame, frame, ["b"], 0.5, 0.8, others=True)) == sorted(x for x in all_pairs if x[2] is not None and 0.5 < x[2] <= 0.8)
    listed = [tuple(r) for r in match.below(frame, frame, 0.6, ["b"], others=True).collect()]
    assert listed == sorted((x for x in all_pairs if x[2] is not None and x[2] < 0.6), key=lambda x: (x[0], -x[2], x[1]))
    counts = match.counts_below(frame, frame, ["b"], {"a": 0.5, "c": 0.7}, others=True).groupBy("target", "t").agg(F.sum("n")).collect()
    assert {tuple(r) for r in counts} == {(t, n, sum(x == t and s is not None and s < at for x, _, s in all_pairs)) for t in {x[0] for x in all_pairs} for n, at in (("a", 0.5), ("c", 0.7))}
    first = {}
    for t, p, s in sorted((x for x in all_pairs if x[2] is not None and x[2] >= 0.6), key=lambda x: x[:2]):
        first.setdefault(t, []).append((p, s))
    assert keyed(match.first_matches(frame, frame, ["b"], 0.6, 2, others=True)) == sorted((t, i + 1, *x[i]) for t, x in first.items() for i in range(min(2, len(x))))
    free = [(t, p, likeness(u, v)) for t, _, u in rows for p, _, v in rows if u and v]
    assert sorted(map(tuple, match.below(frame, frame, 0.6).collect())) == sorted(x for x in free if x[2] is not None and x[2] < 0.6)


def test_close_pairs_in_strips(sides):
    rows, frame = sides
    one = [r for r in rows if r != rows[-1]]
    want = sorted((t, p) for t, p, s in pairs(one) if t < p and s is not None and s >= 0.6)
    assert sorted((r["i"], r["j"]) for r in match.close_pairs(frame.where("id <> 5 OR fp[0] + fp[1] + fp[2] + fp[3] > 0"), ["b"], "id", 0.6).collect()) == [x for x in want if 5 not in x or likeness(rows[5][2], [0.0] * 4) != 1.0]


def test_a_hot_block_is_many_tiles(spark, monkeypatch):
    """Neither side is broadcast, no task has more than two strips of rows, and no row holds a pair's vectors."""
    monkeypatch.setattr(tiles, "STRIP", 50)
    rows = spark.range(600).select("id", F.lit("b").alias("b"), F.array(F.rand(3), F.rand(4)).alias("fp"))
    met = tiles.crossed(rows.where("id % 5 = 0"), rows, ["b"]).groupBy("_s", "_t", "_right").count().collect()
    assert len({(r["_s"], r["_t"]) for r in met}) == 36 and max(r["count"] for r in met) < 100
    plan = match.best_match(rows, rows, ["b"], 0.9)._jdf.queryExecution().executedPlan().toString()
    assert "target_fp" not in plan and "partner_fp" not in plan


def test_no_cells_where_all_distances_are_alike(spark):
    """Independent vectors of many places: each row would go to every cell, and be written and searched that many times."""
    rng = np.random.default_rng(3)
    alike = {("a",): rng.normal(size=(160, 64))}
    assert metric.sparing(alike, 1 / 0.9 - 1) == {}
    apart = {("a",): (rng.uniform(-40, 40, (40, 1, 6)) + rng.normal(0, 0.1, (40, 4, 6))).reshape(-1, 6)}
    assert len(metric.sparing(apart, 0.25)[("a",)]) > 8


def test_letter_shares_and_one_reading(spark):
    """Shares are of characters, not bytes; close pairs make their vectors once, however often they look at them."""
    texts = [(1, "abba"), (2, "aé€𝄞b"), (3, ""), (4, None), (5, "ÀAa\n")]
    rows = spark.createDataFrame(texts, "id int, text string")
    found = {r["id"]: r["fp"] for r in vectors.letter_shares(rows, "text", "ab", "fp").collect()}
    assert found == {1: [0.5, 0.5], 2: [0.2, 0.2], 3: None, 4: None, 5: [0.25, 0.0]}
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    frame = spark.range(50).select("id", F.lit("b").alias("b"), F.array(F.col("id").cast("double")).alias("fp")).mapInArrow(count, "id long, b string, fp array<double>")
    assert match.close_pairs(frame, ["b"], "id", 0.5, cell_rows=5).count() == 49 and made.value == 50


@pytest.mark.parametrize("strip", [6, 8192])
def test_best_sets(spark, monkeypatch, strip):
    """Sets of texts in several strips against a plain account, and no join that carries both sets."""
    monkeypatch.setattr(tiles, "STRIP", strip)
    rng = np.random.default_rng(8)
    rows = [(i, "ab"[i % 2], [f"w{x}" for x in set(rng.integers(0, 30, 1 + i % 9).tolist())] if i % 11 else None) for i in range(60)]
    frame = spark.createDataFrame(rows, "id int, b string, fp array<string>").repartition(3)
    want = {}
    for t, b, u in rows:
        scored = sorted((-len(set(u) & set(v)) / len(set(u) | set(v)), p) for p, c, v in rows if u and v and b == c and t != p)
        want |= {(t, n + 1): (p, -s) for n, (s, p) in enumerate(scored[:3])}
    found = match.top_sets(frame, frame, ["b"], 3, others=True)
    assert {(r["target"], r["rank"]): (r["partner"], r["score"]) for r in found.collect()} == want
    assert "target_fp" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("common", "matrix", "long"), [(1, 1 << 24, 64), (4, 1 << 24, 2), (1 << 20, 1 << 24, 64), (1 << 20, 100, 3)])
def test_shared_members_by_products_and_lists(spark, monkeypatch, common, matrix, long):
    """Members that are in the matrix (none, some, all, as many as fit), in short lists and in long ones: the same best sets; words of texts as SQL parts them."""
    for name, value in (("COMMON", common), ("MATRIX", matrix), ("LONG", long), ("SET_SLAB", 7)):
        assert hasattr(tiles, name)
        monkeypatch.setattr(tiles, name, value)
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 1 + i % 23) % 300) + " " * (i % 3)) for i in range(80)] + [(90, ""), (91, None), (92, " ")]
    texts = spark.createDataFrame(rows, "id int, text string").repartition(2)
    frame = vectors.word_sets(texts, "text", "fp").withColumn("b", F.lit("b"))
    sets = {i: set(t.split(" ")) for i, t in rows if t is not None}
    assert {r["id"]: r["fp"] and (len(r["fp"]), set(r["fp"])) for r in frame.collect()} == {i: (len(sets[i]), sets[i]) if i in sets else None for i, _ in rows}
    want = {}
    for t, u in sets.items():
        scored = sorted((-len(u & v) / len(u | v), p) for p, v in sets.items() if t != p)
        want |= {(t, n + 1): (p, -s) for n, (s, p) in enumerate(scored[:3])}
    assert {(r["target"], r["rank"]): (r["partner"], r["score"]) for r in match.top_sets(frame, frame, ["b"], 3, others=True).collect()} == want


def test_a_long_block_is_folded_in_few_strips(spark, monkeypatch):
    """A row isn't moved more often the more rows there are, until strips are as long as a task can hold; pairs are the same in either case."""
    monkeypatch.setattr(tiles, "STRIP", 10)
    rng = np.random.default_rng(4)
    points = rng.uniform(0, 1, (300, 2))
    rows = spark.createDataFrame([(i, "b", p.tolist()) for i, p in enumerate(points)], "id int, b string, fp array<double>").repartition(3)
    want = sorted((i, j) for i in range(300) for j in range(i + 1, 300) if 1 / (1 + sum(abs(points[i] - points[j])) / 2) >= 0.9)
    for values, copies in ((1 << 22, 6), (60, 10)):
        monkeypatch.setattr(tiles, "STRIP_VALUES", values)
        assert tiles.folded(rows, ["b"], "id").count() == 300 * copies
        assert sorted((r["i"], r["j"]) for r in match.close_pairs(rows, ["b"], "id", 0.9).collect()) == want


@pytest.mark.parametrize("held", [1, 200, 1 << 24])
def test_lists_below_are_not_moved(spark, monkeypatch, held):
    """A task sorts its own targets' partners, few at a time: no list of pairs is shuffled; ids in two blocks, ties, NULLs and odd lengths as in plain."""
    monkeypatch.setattr(tiles, "STRIP", 9)
    monkeypatch.setattr(tiles, "HELD", held, raising=False)
    rng = np.random.default_rng(6)
    rows = [(i % 70, ("x", "y", None)[i % 3], [float(x) for x in rng.integers(0, 3, 3 + (i % 7 == 0))]) for i in range(90)] + [(91, "x", []), (92, "x", None), (93, "x", [1.0, None, 2.0])]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for block in (["b"], []):
        found = match.below(frame, frame, 0.7, block, others=True)
        met = [(t, p, likeness(u, v)) for t, b, u in rows for p, c, v in rows if u and v and t != p and (not block or b is not None and b == c)]
        assert [tuple(r) for r in found.collect()] == sorted((x for x in met if x[2] is not None and x[2] < 0.7), key=lambda x: (x[0], -x[2], x[1]))
        assert found._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1
