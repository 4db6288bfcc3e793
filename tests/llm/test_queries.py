"""The registered queries against their SQL, the pipeline stage by stage, and every operator on tables of edges."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import DATA
from tests.llm.test_operators import words
from tests.test_catalogue import rows as plain
from weft.llm import _store, decontam, fim, html, license, lm, merkle, mix, neardup, pii, quality, queries, shard, tokens, warc


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, duck, name):
    found = queries.queries()[name](spark, DATA)
    cursor = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    assert plain(found.columns, found.collect()) == plain(columns, cursor.fetchall())


def sums_of(sizes):
    out = {0}
    for n in sizes:
        out |= {x + n for x in out}
    return out


def test_pipeline_stage_by_stage(spark, duck):
    """Every stage against a plain account of it, on what the stage before kept; run() gives the last one's rows."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda f: {r["doc_id"]: r["text"] for r in f.select("doc_id", "text").collect()}

    one = stages["quality_rules"](spark, docs, DATA)
    good = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({quality.ORACLE_SQL}) WHERE kept").fetchall()}
    assert set(texts(one)) == good and 0 < len(good) < docs.count() and one.columns == docs.columns

    two = stages["near_dedup"](spark, one, DATA)
    want = neardup.brute_force(texts(one), 5, 80)
    assert set(texts(two)) == {i for i, x in want.items() if x[2]} and two.columns == docs.columns

    three = stages["decontaminate"](spark, two, DATA)
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    hit = decontam.brute_force(texts(two), items)
    assert set(texts(three)) == {i for i, x in hit.items() if not x[4]} and three.columns == docs.columns

    four = stages["mix_sources"](spark, three, DATA)
    taken, sizes, source = Counter(r["doc_id"] for r in four.select("doc_id").collect()), {}, {}
    for r in three.collect():
        sizes[r["doc_id"]], source[r["doc_id"]] = len(words(r["text"])), r["source"]
    names = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    of = {s: sum(n for i, n in sizes.items() if source[i] == s) for s in names}
    for s, target in zip(names, mix.targets([of[s] for s in names], [1 + i % 3 for i in range(len(names))]), strict=True):
        got = sum(sizes[i] * n for i, n in taken.items() if source[i] == s)
        own = [n for i, n in sizes.items() if source[i] == s]
        rest = round(target) - min(3, round(target) // of[s]) * of[s]
        best = min(abs(x - rest) for x in sums_of(own))
        assert abs(got - target) <= max(best, min(own)) + 1
    assert four.columns == docs.columns and max(taken.values()) <= 3

    five = stages["training_order"](spark, four, DATA)
    with open(tokens.VOCABULARY, "rb") as f:
        bpe = tokens.encoding(f.read())
    found = sorted(five.collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in found] == list(range(len(found)))
    ids = np.concatenate([np.frombuffer(r["tokens"], "<u2") for r in found])
    every = Counter(ids.tolist())
    want = Counter()
    for r in four.select("text").collect():
        want.update(bpe.encode_ordinary(r["text"]))
    assert {k: v for k, v in every.items() if k != 50256} == dict(want) and every[50256] >= four.count()

    before = _store.mark()
    again = corpus_pipeline.run(spark, DATA).collect()
    assert sorted((r["slot"], bytes(r["tokens"])) for r in again) == sorted((r["slot"], bytes(r["tokens"])) for r in found)
    left = [p.rpartition("/")[2].rsplit("-", 1)[0] for p in _store._made[before:]]
    assert sum(p.startswith("pipeline-") for p in left) == 4 and len(left) <= 8


NAMES = ("node", "size", "n", "key", "mark", "kept", "block", "row", "shard", "slot", "p", "low", "rest", "pattern", "whole", "shift", "few", "bits", "digest", "license", "bucket", "part", "words", "component_id", "url")


@pytest.fixture(scope="module")
def edges(spark):
    """Null ids and texts, repeated rows, a text of 5 MB, one of 1 MB without white space, and columns named like the operators' own."""
    rng = random.Random(21)
    long = " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "omega", "zeta")) + str(rng.randint(0, 9999)) for _ in range(500_000))
    rows = [(None, None, None), (None, "", "a"), (None, "one two three four five six seven eight nine ten eleven", "a"), (None, "one two three four five six seven eight nine ten eleven", "a"), (1, long, "a"), (2, "x1" * 500_000, "b"), (3, " \t\n ", None), (3, "once more: mail a@b.org", "b"), (4, "\u2003\ufffd \U0001f600 ok", "b")]
    made = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)
    return made.withColumns({c: F.lit(c) for c in NAMES})


def test_every_operator_on_edges(spark, edges):
    benchmark = spark.createDataFrame([(None, "one two three four five six seven eight nine ten"), (1, None), (2, "")], "item_id long, text string")
    n = edges.count()
    score = lm.scored(edges).collect()
    assert len(score) == n and all(np.isfinite(r["score"]) and r["score"] < 0 for r in score)
    groups = neardup.near_duplicates(edges, 3, 85).collect()
    assert len(groups) == n
    judged = quality.judged(edges).collect()
    assert len(judged) == n and sum(r["n_words"] for r in judged) == sum(len(words(r["text"])) for r in edges.select("text").collect())
    assert quality.kept(edges).columns == edges.columns and neardup.kept(edges).columns == edges.columns
    spans = pii.report(edges).collect()
    assert len(spans) == n and sum(r["n_email"] for r in spans) == 1
    hits = decontam.decontaminate(edges, benchmark).collect()
    assert sorted(r["n_hit"] for r in hits) == [0] * (n - 2) + [10, 10]
    assert decontam.kept(edges, benchmark).count() == n - 2
    mixed = mix.report(edges).collect()
    assert len(mixed) == n and all(0 <= r["taken"] <= 3 * r["size"] for r in mixed) and mix.drawn(edges).columns == edges.columns
    placed = shard.sharded(edges, 3).collect()
    assert len(placed) == n and Counter(r["text_crc32"] for r in placed) == Counter(zlib.crc32((r["text"] or "").encode()) for r in edges.select("text").collect())
    slots = defaultdict(list)
    for r in placed:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert license.scanned(edges).count() == n
    made = tokens.materialised(edges, length=512, lanes=4).collect()
    assert sorted(r["slot"] for r in made) == list(range(len(made))) and len(made) * 512 > 1_000_000
    pages = edges.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), *(c for c in NAMES))
    assert html.extracted(pages).count() == n
    cut = fim.transformed(edges).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert Counter(r["back"] for r in cut) == Counter(r["text"] or "" for r in edges.select("text").collect())
    tree = merkle.checked(edges.withColumns({"lang": F.col("source"), "n_chars": F.length("text")})).collect()
    assert len(tree) == n and len({r["root"] for r in tree}) == 1 and all(r["verified"] for r in tree if r["doc_id"] is None)
    kept = warc.report(pages.withColumn("url", F.col("url"))).collect()
    assert sum(r["payload_bytes"] for r in kept) == sum(len((r["text"] or "").encode()) for r in edges.select("text").collect()) and len(kept) == n


def test_rows_of_one_id(spark):
    """Rows of an id that have the same words are one; others of the id all stay. Null ids have no group."""
    text = lambda w: " ".join(f"{w}{i}" for i in range(40))
    rows = [(1, text("a")), (1, text("b")), (1, text("A") + " "), (2, text("b")), (3, text("c")), (3, text("c")), (None, text("d")), (None, text("d")), (4, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r["doc_id"], (r["text"] or "")[:2].lower()) for r in neardup.kept(docs).collect()), key=str)
    assert found == sorted([(1, "a0"), (1, "b0"), (3, "c0"), (None, "d0"), (None, "d0"), (4, "")], key=str)


def test_mix_keeps_maps(spark):
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.concat(F.lit("s"), F.col("id") % 2).alias("source"), F.create_map(F.lit("k"), F.col("id")).alias("facts"), F.array(F.create_map(F.lit("k"), F.lit(1))).alias("more"))
    found = mix.drawn(docs)
    assert found.columns == docs.columns and all(r["facts"] == {"k": r["doc_id"]} for r in found.collect())


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_on_edges(spark, empty):
    """Every stage on an empty table, and on rows with nulls and a shared id."""
    real = decontam.kept(quality.kept(spark.read.parquet(f"{DATA}/documents.parquet")), spark.read.parquet(f"{DATA}/benchmark.parquet"))
    text = real.orderBy("doc_id").first()["text"]
    rows = [] if empty else [(None, None, None, None, None), (1, "", "en", "a", 0), (1, text, "en", None, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        n = docs.count()
        assert n == 0 if empty else n >= 1 and (name == "training_order" or {(r["doc_id"], r["text"]) for r in docs.collect()} == {(1, text)})
