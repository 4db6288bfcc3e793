"""What is dealt over tasks against what one task would do: quantiles, parts of files, labels carried on, buckets."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import logs, match, stats
from weft.sources import files
from weft.streaming import ingest


def test_quantiles_by_brackets(spark, monkeypatch):
    rng = np.random.default_rng(2)
    n = 6000
    columns = {
        "even": np.arange(n) * 1.0, "far": rng.standard_cauchy(n) * 10.0 ** rng.integers(-200, 200, n), "hot": np.where(rng.random(n) < 0.7, 3.5, rng.normal(size=n)),
        "two": np.where(np.arange(n) < n // 2, -1.0, 7.0), "one": np.full(n, 2.0), "ends": np.where(rng.random(n) < 0.5, np.inf, -np.inf),
    }
    rows = spark.createDataFrame([(i, *(float(c[i]) for c in columns.values())) for i in rng.permutation(n).tolist()], "i int, " + ", ".join(f"{c} double" for c in columns)).repartition(5)
    shares = (0.0, 0.25, 0.5, 0.7, 0.999, 1.0)
    passes = []
    told = stats._told
    monkeypatch.setattr(stats, "_told", lambda rows, facts: passes.append(1) or told(rows, facts))
    found = stats.quantiles(rows, dict.fromkeys(columns, shares), few=50)
    for c, x in columns.items():
        x = np.sort(x)
        for p in shares:
            a, b = (x[f(p * (n - 1))] for f in (math.floor, math.ceil))
            at = p * (n - 1)
            want = a if a == b else (math.ceil(at) - at) * a + (at - math.floor(at)) * b
            assert found[c, p] == want or math.isnan(want) and math.isnan(found[c, p]), (c, p)
    assert len(passes) <= 10
    assert stats.quantiles(rows, dict.fromkeys(columns, (0.25,)), few=10_000) == {(c, 0.25): found[c, 0.25] for c in columns}


def test_quantiles_without_numbers(spark):
    rows = spark.createDataFrame([(1.0, None, float("nan")), (None, None, 1.0), (float("nan"), None, 2.0), (2.0, None, float("nan"))], "a double, b double, `c d` double")
    found = stats.quantiles(rows, {"a": (0.0, 0.5, 1.0), "b": (0.5,), "c d": (0.0, 0.25)})
    assert found["a", 0.0] == 1.0 and found["a", 0.5] == 2.0 and math.isnan(found["a", 1.0]) and found["b", 0.5] is None and found["c d", 0.0] == 1.0
    assert stats.quantiles(rows.limit(0), {"a": (0.5,)}) == {("a", 0.5): None}
    assert stats.outliers(rows.select("b"), ["b"]).count() == 0


@pytest.fixture
def splits(spark):
    """Files are read in many splits."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_parts_of_files_keep_their_places(spark, tmp_path, splits):
    rng = random.Random(6)
    want = {}
    for name in ("a", "b", "c"):
        parts = ["x" * rng.choice((0, 1, 5, 40, 700)) + str(i) for i in range(rng.choice((1, 60, 200)))]
        (tmp_path / name).write_text("$$$$".join(parts) + "$$$$")
        want |= {(name, i): p for i, p in enumerate(parts)}
    read = files.pieces(spark, f"file://{tmp_path}", "$$$$")
    assert read.rdd.getNumPartitions() > 3 or spark.read.text(f"file://{tmp_path}").rdd.getNumPartitions() > 3
    assert {(r["path"].rpartition("/")[2], r["pos"]): r["value"] for r in read.collect()} == want


def test_lines_and_records_in_splits(spark, tmp_path, splits):
    lines = [f"line {i}\r" if i % 2 else "" for i in range(300)]
    (tmp_path / "log").write_text("\n".join(lines) + "\n")
    found = files.lines(spark, f"file://{tmp_path}/log").orderBy("line").collect()
    assert [(r["line"], r["value"]) for r in found] == [(i, x.rstrip("\r")) for i, x in enumerate(lines)]
    (tmp_path / "m.sdf").write_text("".join(f"m{i}\n\n\n  2  1\nbody\n> <Similarity>\n0.{i % 10}5\n\n" + ("> <DistortedMatch>\ntrue\n\n" if i == 77 else "") + "$$$$\n" for i in range(150)) + "\n")
    (tmp_path / "n.sdf").write_text("k\n\n\n  2  1\n> <Similarity>\n0.99\n\n$$$$\n")
    records = files.sdf_records(spark, f"file://{tmp_path}/*.sdf").cache()
    by = {r["pos"]: r["record"] for r in records.where("path like '%m.sdf'").collect()}
    assert sorted(by) == list(range(150)) and all(by[i].startswith(f"m{i}\n") for i in by)
    lists = logs.distorted_lists(records, 3)
    assert [(r["end"], r["place"], r["similarity"], r["pos"]) for r in lists.orderBy("end", "place").collect()] == [("high", 1, 0.95, 9), ("high", 2, 0.95, 19), ("high", 3, 0.95, 29), ("low", 1, 0.05, 0), ("low", 2, 0.05, 10), ("low", 3, 0.05, 20)]
    assert logs.top_mean(lists).first()["top_mean"] == pytest.approx(0.95)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_labels_are_carried_over_stretches(spark, width):
    rng = random.Random(width)
    rows = [(f, i, f"{f}{i}" if rng.random() < 0.04 else None) for f in ("a", "b", None) for i in range(-5, 200)]
    want, last = {}, {}
    for f, i, x in rows:
        last[f] = x or last.get(f)
        want[f, i] = last[f]
    frame = spark.createDataFrame(rows, "file string, line long, mark string").withColumn("_n", F.lit(3)).repartition(4)
    found = logs.filled(frame, F.col("mark"), ["file"], "line", width)
    assert {(r["file"], r["line"]): r["section"] for r in found.collect()} == want and found.columns == ["file", "line", "mark", "_n", "section"]


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    schema = "k int, fp string, s string, t int"
    batch = lambda rows: spark.createDataFrame(rows, schema)
    path = f"{tmp_path}/table"
    upsert = lambda rows, v: ingest.upsert_buckets(batch(rows), path, v, ["k"], ["fp"], "t", 8)
    want = {i: (i, f"f{i}", "a", 0) for i in range(100)}
    assert upsert(list(want.values()), 0) == 8
    before = ingest.manifest(spark, path)
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "table/data/v=0").rglob("*.parquet")}
    one = [(5, None, "b", 1), (5, None, "c", 2), (500, "new", "b", 1)]
    want |= {5: (5, "f5", "c", 2), 500: (500, "new", "b", 1)}
    n = upsert(one, 1)
    assert 1 <= n <= 2 and sum(v == 1 for v in ingest.manifest(spark, path).values()) == n and len(list((tmp_path / "table/data/v=1").glob("bucket=*"))) == n
    assert upsert(one, 1) == n  # the batch comes again
    assert {r["k"]: tuple(r) for r in ingest.latest(spark, path).collect()} == want
    assert {p: p.stat().st_mtime_ns for p in stamps} == stamps  # still named by the manifest before
    assert upsert([], 2) == 0 and upsert([(5, None, "d", 3)], 3) == 1
    want[5] = (5, "f5", "d", 3)
    assert {r["k"]: tuple(r) for r in ingest.latest(spark, path).collect()} == want
    gone = [b for b in before if not (tmp_path / f"table/data/v=0/bucket={b}").exists()]
    assert gone and all(ingest.manifest(spark, path)[b] > 0 for b in gone)
    assert sorted(p.name for p in (tmp_path / "table/manifest").iterdir()) == ["v=2", "v=3"]
    with pytest.raises(ValueError, match="8 buckets"):
        ingest.upsert_buckets(batch(one), path, 4, ["k"], ["fp"], "t", 16)


def test_bucketed_join_moves_no_side(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, "hot" if i % 3 else f"f{i % 7}", int(i % 2), rng.normal(size=4).tolist()) for i in range(400)]
    frame = spark.createDataFrame(rows, "id int, formula string, n_atoms int, fp array<double>")
    block = ["formula", "n_atoms"]
    few = frame.where("id % 20 = 0")
    try:
        t = files.write_blocks(few, "weft_t", f"file://{tmp_path}/t", block, ["id"], 4, salts=3, copied=True)
        p = files.write_blocks(frame, "weft_p", f"file://{tmp_path}/p", block, ["id"], 4, salts=3)
        found = match.bucketed_best_match(t, p, block, 0.5, others=True)
        plan = match._pairs(t.hint("merge"), p, [*block, "salt"], None, True)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, match.best_match(few, frame, block, 0.5, others=True).collect()))
        assert p.where("formula = 'hot'").select(F.input_file_name()).distinct().count() > 2
    finally:
        spark.sql("DROP TABLE IF EXISTS weft_t")
        spark.sql("DROP TABLE IF EXISTS weft_p")
