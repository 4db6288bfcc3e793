"""Every operator on hard small tables (nulls, empty texts, copies, clashing columns, no rows) and against brute force."""

import hashlib
import math
import os
import random
import re
import textwrap
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.llm import decontam, html, license, lm, mix, neardup, pii, quality, shard, tokens

WORDS = "the of and river stone light walks under seven green houses while nobody looks at old clocks turning slowly home again".split()
WHITE = re.compile(r"[^\x20\x09-\x0D]+")


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(("", "", "x", "zo", "Qu")) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = [text(rng, 60) for _ in range(6)]
    near = base[0].split()
    near[30] = "changed"
    out = [(i, x, f"s{i % 3}") for i, x in enumerate(base)]
    out += [(10, base[0], "s1"), (11, " ".join(near), None), (12, None, "s0"), (13, "", "s0"), (14, " \t\n", "s2"), (15, "One", "s0"), (16, "one TWO", "s0"), (17, "One two", "s1"), (18, base[1], "s1"), (19, " ".join([base[2]] * 60), "s2")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With a copy of a row, and columns named like those of the operators."""
    made = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, source string")
    return made.withColumns({"node": F.lit("x"), "size": F.lit("y"), "n": F.lit(1.5), "key": F.lit(None).cast("string"), "mark": F.lit(3), "kept": F.lit("k"), "block": F.lit(0)})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words(x, pattern=WHITE):
    return pattern.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in x or ""))


def test_tokens_round_trip(docs, none):
    found = tokens.ordered(docs, key=5, length=64, lanes=3, per_shard=4).collect()
    assert sorted(r["slot"] for r in found) == list(range(len(found)))
    assert all(r["shard"] == r["slot"] // 4 and r["offset"] == r["slot"] % 4 * 129 and len(r["tokens"]) == 128 for r in found)
    with open(tokens.VOCABULARY, "rb") as f:
        bpe = tokens.encoding(f.read())
    got, lanes = Counter(), defaultdict(list)
    for r in sorted(found, key=lambda r: (r["lane"], r["number"])):
        lanes[r["lane"]].append(np.frombuffer(r["tokens"], "<u2")[: r["n_tokens"]])
    for parts in lanes.values():
        ids = np.concatenate(parts)
        ends = np.flatnonzero(ids == 50256)
        got.update(bpe.decode(ids[a:b].tolist()) for a, b in zip([0, *ends + 1], ends, strict=False))
    assert got == Counter(r["text"] or "" for r in docs.collect())
    again = tokens.ordered(docs.repartition(3), key=5, length=64, lanes=3, per_shard=4).collect()
    assert {r["slot"]: bytes(r["tokens"]) for r in again} == {r["slot"]: bytes(r["tokens"]) for r in found}
    assert tokens.ordered(none, length=64, lanes=3).count() == 0


def test_tasks_sort_a_bounded_number_of_bytes():
    """A range of shards a task, never more bytes than stated; few shards go to as many tasks as there are."""
    size = tokens.PER_SHARD * (2 * tokens.LENGTH + 1)
    for shards in (1, 7, 200, 201, 1000, 1601, 123_457):
        parts = tokens.tasks_of(shards, size, 200)
        each = Counter(s * parts // shards for s in range(shards))
        assert sorted(each) == list(range(parts)) and max(each.values()) * size <= tokens.TASK_BYTES
        assert parts >= min(shards, 200)
    assert tokens.tasks_of(0, size, 200) == 1 and tokens.tasks_of(9, 2 * tokens.TASK_BYTES, 2) == 9


def test_shards_are_files_of_fixed_stride(spark, docs, none, tmp_path, monkeypatch):
    """Every slot lies at its offset in its shard's file; a reader that goes on at a slot opens no file before it."""
    docs = docs.where("doc_id <> 19")
    rows = tokens.ordered(docs, length=32, lanes=2, per_shard=4)
    want = {r["slot"]: bytes(r["tokens"]) for r in rows.collect()}
    path = tmp_path / "shards"
    tokens.write_shards(rows, f"file://{path}")
    files = {int(f.parent.name.partition("=")[2]): f for f in path.glob("shard=*/part-*")}
    assert sorted(files) == list(range(-(-len(want) // 4)))
    for slot, ids in want.items():
        with open(files[slot // 4], "rb") as f:
            f.seek(slot % 4 * 65)
            assert f.read(65) == ids + b"\n"
    for shard in range(6 // 4):
        files[shard].write_bytes(b"never read")
    read = list(tokens.read_from(spark, f"file://{path}", 6, 32, per_shard=4))
    assert [s for s, _ in read] == list(range(6, len(want))) and all(ids.tobytes() == want[s] for s, ids in read)
    monkeypatch.setattr(tokens, "READ_BYTES", 130)
    parts = [list(tokens.read_from(spark, f"file://{path}", s, 32, per_shard=4)) for s in (6, len(want) - 1, len(want), len(want) + 9)]
    assert [[s for s, _ in p] for p in parts] == [list(range(6, len(want))), [len(want) - 1], [], []] and all(ids.tobytes() == want[s] for p in parts for s, ids in p)
    found = tokens.sequences_from(spark, f"file://{path}", 6, 32, per_shard=4)
    assert {r["slot"]: bytes(r["tokens"]) for r in found.collect()} == {s: x for s, x in want.items() if s >= 6}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    every = tokens.materialised(docs, length=32, lanes=2, per_shard=4).collect()
    assert {r["slot"]: (r["shard"], r["offset"], bytes(r["tokens"])) for r in every} == {s: (s // 4, s % 4 * 65, x) for s, x in want.items()}
    assert tokens.materialised(none, length=32).count() == 0


def test_lanes_follow_the_texts(docs, monkeypatch):
    assert tokens.lanes_of(docs) == tokens.LANES
    monkeypatch.setattr(tokens, "LANE_BYTES", 10)
    assert tokens.lanes_of(docs) == -(-sum(len((r["text"] or "").encode()) for r in docs.collect()) // 10)


def test_pieces_encode_as_whole_texts():
    with open(tokens.VOCABULARY, "rb") as f:
        bpe = tokens.encoding(f.read())
    rng = random.Random(2)
    texts = ["".join(rng.choice("  \n\tab.1'é 　\x85\x0b") for _ in range(rng.randint(0, 20))) for _ in range(2000)]
    ids, starts = tokens.encode(pa.array([*texts, None]), bpe)
    assert all(ids[starts[i] : starts[i + 1]].tolist() == bpe.encode_ordinary(x) for i, x in enumerate(texts))


@pytest.mark.parametrize("size", [1, 2, 3, 64, 65, 1000])
def test_permutation(size):
    order = tokens.Permutation(size, 9)
    slots = order.slots(np.arange(size))
    assert sorted(slots.tolist()) == list(range(size)) and (order.numbers(slots) == np.arange(size)).all()


def ppm(texts, order):
    """The log10 probability of a text (a list of words) by a trie of the given texts, symbol by symbol."""
    trie, symbols = defaultdict(Counter), lambda ws: [*"".join(f"{w} " for w in ws).encode(), 256]
    for ws in texts:
        seen = [256] * order
        for s in symbols(ws):
            for j in range(order + 1):
                trie[tuple(seen[len(seen) - j :])][s] += 1
            seen.append(s)

    def log10(ws):
        seen, out = [256] * order, 0.0
        for s in symbols(ws):
            gone = set()
            for j in range(order, -1, -1):
                here = trie.get(tuple(seen[len(seen) - j :]))
                if not here:
                    continue
                left = {k: v for k, v in here.items() if k not in gone}
                total = sum(left.values())
                if s in left:
                    out += math.log10((left[s] - 0.5) / total)
                    break
                out += math.log10(0.5 * len(left) / total) if left else 0.0
                gone |= set(here)
            else:
                out -= math.log10(257 - len(gone))
            seen.append(s)
        return out

    return log10


def lm_brute_force(docs, order):
    rows, counts = docs.collect(), Counter()
    held = lambda r: zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 5 == 1
    training = [words(r["text"]) for r in rows if not held(r)]
    for t in training:
        counts.update([*t, ""])
    n, v, model, want = sum(counts.values()), len(counts), ppm(training, order), []
    for r in rows:
        t = [*words(r["text"]), ""]
        want.append((r["doc_id"], held(r), len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), model(t[:-1])))
    return want


def lm_equal(docs, order):
    found, want = lm.scored(docs, order=order).collect(), lm_brute_force(docs, order)
    assert any(x[1] for x in want) and len(found) == len(want)
    for got, real in zip(sorted((tuple(r)[:7] for r in found), key=str), sorted(want, key=str), strict=True):
        assert got[:5] == real[:5] and got[5:] == pytest.approx(real[5:])


def test_lm_equals_brute_force(docs, none):
    lm_equal(docs, 4)
    lm_equal(docs, 2)
    assert lm.scored(none).count() == 0


def test_lm_over_many_blocks_chunks_and_parts(spark, monkeypatch):
    """Small blocks, chunks and parts, so that texts, buckets and counts are cut everywhere; null ids; no cap on the trie."""
    for name, value in (("BLOCK_BYTES", 300), ("CHUNK", 37), ("FAN", 2), ("LOAD", 100)):
        monkeypatch.setattr(lm, name, value)
    rng = random.Random(12)
    made = ["".join(rng.choice("abcdéfghij中") for _ in range(rng.randint(1, 9))) for _ in range(100)]
    docs = spark.createDataFrame([(i if i % 9 else None, " ".join(rng.choices(made, k=rng.randint(0, 30)))) for i in range(60)], "doc_id long, text string").repartition(3)
    lm_equal(docs, 5)


def test_lm_copies_follow_the_load(spark, monkeypatch):
    """The trie of a bucket that is asked for little goes to one task, however many blocks there are; a hot one to several."""
    asked = [(block, [(1, 10, b"x" * 10, b""), (2, 900, b"y" * 900, b"")]) for block in range(30)]
    encoded = spark.createDataFrame(asked, "block long, asked array<struct<bucket:int,size:int,places:binary,n:binary>>")
    trie = spark.createDataFrame([(1, b"", b""), (2, b"", b"")], "bucket int, places binary, n binary")
    monkeypatch.setattr(lm, "LOAD", 1000)
    tasks = lm.loads(encoded)
    assert {tuple(r) for r in tasks.collect()} == {(1, 1), (2, 27)}
    assert Counter(r["bucket"] for r in lm.copied(trie, tasks).collect()) == {1: 1, 2: 27}


def test_lm_knows_word_order(spark):
    """Contexts reach into the word before: a phrase of the training texts costs less than its words shuffled."""
    phrase = "seven green houses under a river stone"
    docs = spark.createDataFrame([(i, f"{phrase} {phrase}") for i in range(20)] + [(100, phrase), (101, "river stone a seven under houses green")], "doc_id long, text string")
    found = {r["doc_id"]: (r["score"], r["base_score"]) for r in lm.scored(docs).collect()}
    assert found[100][0] > found[101][0] + 3 and found[100][1] == pytest.approx(found[101][1])


def test_lm_without_training_texts(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    found = lm.scored(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert found["score"] == pytest.approx(-4 * math.log10(257)) and found["train_tokens"] == 0


def test_near_duplicates_equal_brute_force(docs, none, rows):
    for k, percent in ((3, 85), (5, 80)):
        want = neardup.brute_force({i: t for i, t, _ in rows}, k, percent)
        found = neardup.near_duplicates(docs, k, percent).collect()
        assert len(found) == docs.count()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == want
    assert neardup.near_duplicates(none).count() == 0
    one = neardup.kept(docs)
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.collect()) == sorted(i for i, (_, _, kept) in neardup.brute_force({i: t for i, t, _ in rows}, 5, 80).items() if kept)


def test_a_family_of_near_copies(spark):
    """A base and copies of growing distance: links go through members that a centre alone wouldn't join."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(60):
        x = list(base)
        for j in rng.sample(range(120), i // 6):
            x[j] = f"m{i}_{j}"
        texts[i] = " ".join(x)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, 3, 85).collect()}
    assert found == neardup.brute_force(texts, 3, 85)


def test_links_across_components_in_chunks_and_segments(spark, monkeypatch):
    """The members of a group pass every chunk in segments: each link between components is found, whatever task has it."""
    monkeypatch.setattr(neardup, "CHUNK", 3)
    monkeypatch.setattr(neardup, "SEGMENT", 4)
    texts = {i: f"{'one two three four five six seven eight nine ten ' * 3}{' '.join(f'g{i // 2}w{j}' for j in range(60))} tail{i % 2}" for i in range(0, 40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    nodes = neardup.signed(docs, 3, neardup.ROWS, neardup.BANDS).select(F.col("doc_id").alias("node"), "key")
    groups = spark.createDataFrame([(0, i, i, 0) for i in texts], "a long, node long, component long, own long")
    found = {tuple(sorted(r)) for r in neardup.settled(docs, nodes, groups, 3, 85).collect()}
    # the centre's own component is in no chunk, but it passes them all
    assert found == {(i, i + 1) for i in range(0, 40, 2)}


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate((a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)))
    s = neardup.superminhash(np.concatenate((np.sort(a), np.sort(b))), np.array([0, 400, 800]), 256)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.1


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 9)], "a long, b long")
    assert {tuple(r) for r in neardup.components(links).collect()} == {(2, 1), (3, 1), (4, 1), (5, 1), (8, 7), (9, 7)}


def test_quality_counts(docs, none):
    junk = docs.sparkSession.createDataFrame([(1, "a b c d e f g a b c d e x\na\n\na\n#1"), (2, "## ## " * 20)], "doc_id long, text string")
    a, b = quality.judged(junk).orderBy("doc_id").collect()
    assert (a["n_words"], a["n_repeat_words"], a["n_dup_lines"], a["n_symbols"], a["word_chars"], a["base_failed"]) == (16, 10, 1, 1, 17, True)
    assert b["n_symbols"] == 80 and not b["kept"]
    found = {r["doc_id"]: r["n_words"] for r in quality.judged(docs).collect()}
    assert found[12] == found[13] == found[14] == 0 and found[19] == 3600
    assert quality.kept(docs).columns == docs.columns and quality.judged(none).count() == 0
    assert sorted(r["doc_id"] for r in quality.kept(docs).collect()) == sorted(r["doc_id"] for r in quality.judged(docs).collect() if r["kept"])


def test_pii_base_spans():
    x = "mail a.b@c-d.org, ip 10.0.0.1 and 300.1.1.1, card 4111 1111 1111 1111 not 4111 1111 1111 1112, call +1 (269) 555-3296 é +44 1"
    want = []
    for kind, a, b in (("email", "a.b@c-d.org", 0), ("ip", "10.0.0.1", 0), ("card", "4111 1111 1111 1111", 0), ("phone", "+1 (269) 555-3296", 0)):
        at = x.index(a, b)
        want.append((at, at + len(a), kind))
    assert pii.base_spans(x) == want and pii.base_spans("") == []


def test_pii_base_spans_equal_the_patterns():
    """The linear search finds what the patterns find, leftmost and without overlap."""
    kinds = [re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")]
    rng = random.Random(5)
    for alphabet in ("a@.b ", "1.2 ", "12.3@a-+( ", "1+-. )", "é@a.1"):
        for _ in range(4000):
            x = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 24)))
            want = sorted((m.start(), m.end(), k) for k, p in enumerate(kinds) for m in p.finditer(x))
            assert sorted((a, b, k) for a, b, k, _ in pii._matches(x)) == want, x


def test_pii_long_texts_take_linear_time():
    for x in ("1" * 1_000_000, "a" * 1_000_000, "1." * 500_000, "a.b-" * 250_000, "a@" * 500_000, "1-" * 500_000, "+1(" * 330_000, "a1@b." * 200_000):
        began = time.time()
        pii.base_spans(x)
        found = list(pii.occurrences(x))
        assert time.time() - began < 5 and all(len(p) < 200 for *_, patterns, _ in found for p, _ in patterns)


def test_pii_bootstrap(spark, docs, none):
    known = [(i, f"please write to the person named a{i}@b{i}.org now") for i in range(40)]
    unseen = [(100 + i, f"please write to the person named u{i}@host now") for i in range(9)]
    clean = [(200 + i, f"room {i} has 12 chairs") for i in range(40)]
    seeds = [(300 + i, f"please write to the person named a{i}@host{i} now or a{i}@host{i}.net") for i in range(1)]
    table = spark.createDataFrame(known + unseen + clean + seeds, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.report(table).collect()}
    assert all(found[i]["n_email"] == 1 and found[i]["base_sha256"] == hashlib.sha256(found[i]["spans"].encode()).hexdigest() for i in range(40))
    assert all(not found[200 + i]["spans"] for i in range(40))
    at = len("please write to the person named ")
    assert all(found[100 + i]["spans"] == f"id:{at}:{at + len(f'u{i}@host')}" for i in range(9))
    trusted = {r["pattern"] for r in pii.confident(table).collect()}
    assert any(p.startswith("l named|x@x.a") for p in trusted)
    number = spark.createDataFrame([(i, f"ref card no {4111111111111111} ok") for i in range(9)] + [(50, "ref card no 4111111111111112 ok")], "doc_id long, text string")
    assert {r["spans"] for r in pii.report(number).where("doc_id = 50").collect()} == {""}
    assert pii.report(docs).count() == docs.count() and pii.report(none).count() == 0


def test_pii_counts_every_occurrence_in_every_round(spark):
    """Ten seeds among a thousand other numbers after the same word make no trusted pattern in any round."""
    seeds = [(i, f"word{i} ref {10**13 * (i + 1) + next(k for k in range(10) if pii.luhn(str(10**13 * (i + 1) + k)))} end{i}") for i in range(9)]
    other = [(100 + i, f"word{i} ref {20000000 + i} end{i}") for i in range(1000)]
    table = spark.createDataFrame(seeds + other, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.report(table).collect()}
    assert all(found[i].startswith("card:") for i in range(9)) and not any(found[100 + i] for i in range(1000))



def test_pii_finds_unseen_shapes(spark):
    """Identifiers whose shape no seed has come back as spans, by the words around them alone."""
    known = [(i, f"please write to the person named a{i}@b{i}.org now") for i in range(40)]
    unseen = [(100 + i, f"please write to the person named {x} now") for i, x in enumerate(["u1@host", "u2@host", "u3@host", "fe80::1:22", "AB-12/77", "77-x-99"])]
    clean = [(200 + i, f"room {i} has 12 chairs") for i in range(40)]
    found = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(known + unseen + clean, "doc_id long, text string")).collect()}
    for i, x in unseen:
        at = len("please write to the person named ")
        assert found[i] == f"id:{at}:{len(x) - len(' now')}"
    assert not any(found[200 + i] for i in range(40))



def secrets(rng, n):
    ways = ('token = "{}"', 'TOKEN = "{}"!!', "token={}", '"token": "{}",', "token = '{}'###", "token := {}")
    return [("".join(rng.choice(WORDS) + " " for _ in range(9)), ways[i % len(ways)], "".join(rng.choice("0123456789abcdef") for _ in range(40))) for i in range(n)]


def test_pii_finds_assigned_secrets(spark):
    """Secrets after a name come back, those of unseen forms too; numbers beside function words and other assigned values don't."""
    rng = random.Random(31)
    planted = [(i, a + way.format(x) + " then " + a, x) for i, (a, way, x) in enumerate(secrets(rng, 120))]
    unseen = [(200 + i, f"a stone token = {x} under", x) for i, x in enumerate(("k-77", "Zz9", "12:34"))]
    clean = [(300 + i, f"the {i} of the {7 * i} and {i} light, width = {i} and size: {i * i} for {' '.join(rng.choice(WORDS) for _ in range(30))}") for i in range(200)]
    mails = [(600 + i, f"the a{i}@b{i}.org of and {i} river") for i in range(30)]
    table = spark.createDataFrame([x[:2] for x in planted + unseen] + clean + mails, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.report(table).collect()}
    hit = 0
    for i, text, x in planted + unseen:
        spans = [tuple(map(int, s.split(":")[1:])) for s in found[i].split(",") if s.startswith("id:")]
        hit += any(a <= text.index(x) and text.index(x) + len(x) <= b for a, b in spans) and len(spans) == 1
    assert hit >= 0.9 * len(planted + unseen) and hit == len(planted + unseen), hit
    assert not any(found[300 + i] for i in range(200))
    assert all(found[600 + i].count(":") == 2 and found[600 + i].startswith("email") for i in range(30))
    assert not {"L the", "R of", "R and"} & {r["pattern"] for r in pii.confident(table).collect()}


def test_pii_scores_are_the_plain_ones(spark):
    """The rounds, worked out again over dictionaries."""
    rng = random.Random(5)
    texts = [f"{rng.choice(('named', 'mail', 'call', 'the'))} {rng.choice((f'a{i % 17}@b.org', f'u{i % 9}@h', f'{i % 23}-x', '+49 30 1234567'))} {rng.choice(('now', 'of', 'end'))}" for i in range(400)]
    graph, seeds = Counter(), set()
    context = {}
    for t in texts:
        for _, _, token, patterns, seed in pii.occurrences(t):
            for p, c in patterns:
                graph[p, token] += 1
                context[p] = c
            if seed:
                seeds.add(token)
    score = {x: float(x in seeds) for _, x in graph}
    for _ in range(pii.ROUNDS):
        rated = {}
        for p in context:
            mine = [(score[x], n) for (q, x), n in graph.items() if q == p]
            rated[p] = (sum(s * n for s, n in mine) / (sum(n for _, n in mine) + pii.SMOOTHING), sum(s > 0.5 for s, _ in mine))
        for x in score:
            best = defaultdict(float)
            for p, y in graph:
                if y == x and rated[p][1] >= pii.LEAST_SEEDS:
                    best[context[p]] = max(best[context[p]], rated[p][0])
            score[x] = 1.0 if x in seeds else 1 - math.prod(1 - min(s, 0.999) for s in best.values())
    words = Counter(w.lower() for t in texts for w in t.split())
    good = {p: rated[p][0] * (sum(n for (q, _), n in graph.items() if q == p) + pii.SMOOTHING) for p in rated}
    want = {p for p, (s, kinds) in rated.items() if s >= pii.CONFIDENCE and kinds >= pii.LEAST_SEEDS and (p[:2] not in ("L ", "R ") or good[p] >= pii.SHARE * words[p[2:]])}
    found = {r["pattern"]: r["score"] for r in pii.confident(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert set(found) == want and all(found[p] == pytest.approx(rated[p][0], abs=1e-9) for p in want) and len(want) > 2


def test_pii_is_the_same_for_any_number_of_patterns(spark, docs):
    """Trusted patterns beyond the broadcast limit still give their spans; repeated rows stay."""
    texts = [f"word{j} named {x} after{j}" for j in range(3) for x in [*(f"a{i}@b{i}.org" for i in range(5 + 20 * (j == 2))), f"u{j}@host", f"{j}-77-x"]]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[5]), (None, texts[5]), (900, None)], "doc_id long, text string").union(docs.select("doc_id", "text"))
    some, none, whole = (sorted(map(str, pii.report(table, patterns=n).collect())) for n in (1, 0, 200_000))
    assert some == whole and none == whole and any("id:" in x for x in whole)



def test_decontamination_equals_brute_force(spark, docs, none, rows):
    texts = {i: t for i, t, _ in rows}
    cut = texts[0].split()
    items = {1: " ".join(cut[5:20]), 2: " ".join(cut[40:50]), 3: "ONE, two!", 4: "", 5: None, 6: "nothing like this is anywhere in any of these texts", 7: " ".join(cut[5:14]), 8: "one"}
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = decontam.brute_force(texts, items)
    for size in (64 << 20, 0):
        found = decontam.digest(decontam.decontaminate(docs, benchmark, broadcast_bytes=size)).collect()
        assert len(found) == docs.count() and {r["doc_id"]: tuple(r)[1:] for r in found} == want
        kept = decontam.kept(docs, benchmark, broadcast_bytes=size)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, x in want.items() if not x[4]}
    assert decontam.decontaminate(none, benchmark).count() == 0
    assert {r["n_hit"] for r in decontam.decontaminate(docs, benchmark.limit(0)).collect()} == {0}


def test_decontamination_keeps_rows_not_ids(spark):
    """Ids that are shared or null: a clean row stays beside a dirty one of its id, whatever the benchmark's size."""
    dirty, clean = "one two three four five six seven eight nine ten eleven", "nothing of it"
    docs = spark.createDataFrame([(1, dirty, 7), (1, clean, 7), (None, dirty, 7), (None, clean, 7), (2, None, 7)], "doc_id long, text string, row int")
    benchmark = spark.createDataFrame([(1, dirty)], "item_id long, text string")
    for size in (64 << 20, 0):
        found = decontam.kept(docs, benchmark, broadcast_bytes=size)
        assert found.columns == docs.columns and sorted(map(str, found.collect())) == sorted(map(str, docs.where("text is null or text <> '" + dirty + "'").collect()))
        assert sorted((str(r["doc_id"]), r["n_hit"]) for r in decontam.decontaminate(docs, benchmark, broadcast_bytes=size).collect()) == [("1", 0), ("1", 11), ("2", 0), ("None", 0), ("None", 11)]


def test_decontamination_of_repeated_words(spark):
    """Long texts and items that repeat one word or phrase: the same hits, in time by their words."""
    ring = "la le lo".split()
    items = {1: "na " * 1000, 2: "na " * 12 + "end", 3: " ".join(ring * 40), 4: "na " * 9, 5: "na " * 1000, 6: "na " * 9 + "stop", 7: " ".join((ring * 8)[1:])}
    texts = {1: "na " * 60, 2: "so " + "na " * 9 + "stop", 3: " ".join(ring * 30) + " so " + "na " * 13, 4: "na " * 8, 5: " ".join((ring * 4)[2:])}
    index = decontam.Index(list(items), list(items.values()), 10, 6)
    words = decontam.Words(decontam.translated(pa.array(["na " * 200_000, "so " * 200_000]), decontam.LOWER_ALNUM))
    since = time.perf_counter()
    hit, found = index.matches(words.hashes(), words.starts)
    assert time.perf_counter() - since < 5
    assert hit[:200_000].all() and not hit[200_000:].any() and index.names(found[0]) == ["1", "2", "4", "5"] and not found[1]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = decontam.brute_force(texts, items)
    for size in (64 << 20, 0):
        got = decontam.digest(decontam.decontaminate(docs, benchmark, broadcast_bytes=size)).collect()
        assert {r["doc_id"]: tuple(r)[1:] for r in got} == want


def test_targets_and_flow():
    assert mix.targets([100, 100, 10], [1, 2, 3]) == [60.0, 120.0, 30.0]
    # 0 can only serve source 0; 1 may serve both: fresh words first
    routed = mix.flow({0: 10, 1: 10}, {0: [0], 1: [0, 1]}, [10, 10])
    assert routed == {0: {0: 10}, 1: {1: 10}}
    assert sum(sum(x.values()) for x in mix.flow({0: 10}, {0: [0]}, [25]).values()) == 25


def cheapest(supply, members, quota, copies=3):
    """The largest flow's size and least cost, by shortest paths unit by unit."""
    used, sent = dict.fromkeys(supply, 0), {}
    room = list(quota)
    total = cost = 0
    while True:
        best = None
        for start in sorted(supply, key=lambda p: used[p] // supply[p] if supply[p] else 9):
            if supply[start] == 0 or used[start] >= copies * supply[start]:
                continue
            seen, todo = {start: None}, [start]
            while todo and best is None:
                p = todo.pop()
                for s in members[p]:
                    if ("s", s) in seen:
                        continue
                    seen["s", s] = p
                    if room[s] > 0:
                        best = ("s", s)
                        break
                    for q, n in list(sent.items()):
                        if n > 0 and q[1] == s and q[0] not in seen:
                            seen[q[0]] = ("s", s)
                            todo.append(q[0])
            if best:
                break
        if best is None:
            return total, cost
        room[best[1]] -= 1
        total, cost = total + 1, cost + used[start] // supply[start]
        used[start] += 1
        x = best
        while x != start:
            p = seen[x]
            sent[p, x[1]] = sent.get((p, x[1]), 0) + 1
            if p == start:
                break
            back = seen[p]
            sent[p, back[1]] -= 1
            x = back


def test_flow_is_cheapest_among_largest():
    rng = random.Random(11)
    for _ in range(150):
        n, m = rng.randint(1, 6), rng.randint(1, 4)
        supply = {i: rng.randint(0, 5) for i in range(n)}
        members = {i: rng.sample(range(m), rng.randint(1, m)) for i in range(n)}
        quota = [rng.randint(0, 12) for _ in range(m)]
        routed = mix.flow(supply, members, quota)
        taken = {p: sum(x.values()) for p, x in routed.items()}
        assert all(0 < v and s in members[p] for p, x in routed.items() for s, v in x.items())
        assert all(taken[p] <= 3 * supply[p] for p in supply) and all(sum(x.get(s, 0) for x in routed.values()) <= q for s, q in enumerate(quota))
        cost = sum(sum(range(t // supply[p])) * supply[p] + t % supply[p] * (t // supply[p]) for p, t in taken.items() if supply[p])
        assert (sum(taken.values()), cost) == cheapest(supply, members, quota)


def test_flow_of_many_patterns():
    rng = random.Random(1)
    supply = {i: rng.randint(1, 1000) for i in range(100_000)}
    members = {i: rng.sample(range(60), rng.randint(1, 4)) for i in supply}
    quota = [int(sum(supply.values()) / 60 * rng.uniform(0.2, 2.5)) for _ in range(60)]
    began = time.time()
    routed = mix.flow(supply, members, quota)
    assert time.time() - began < 120 and all(sum(x.values()) <= 3 * supply[p] for p, x in routed.items())


def test_the_end_of_a_quota_comes_near():
    rng = random.Random(4)
    for _ in range(200):
        sizes = np.array([rng.choice((0, rng.randint(1, 30), rng.randint(1, 400))) for _ in range(rng.randint(1, 9))])
        quota = rng.randint(0, int(sizes.sum()))
        got = abs(int(sizes @ mix._exchanged(sizes, quota)) - quota)
        best = min(abs(sum(x for i, x in enumerate(sizes.tolist()) if m >> i & 1) - quota) for m in range(1 << len(sizes)))
        assert best <= got <= max(best, sizes[sizes > 0].min(initial=10**9)) and abs(int(sizes @ mix._nearest_sum(sizes.tolist(), quota)) - quota) == best


def test_mix_of_overlapping_sources(spark):
    """Documents in two sources: fresh words go where they are short, and each source comes near its target."""
    rng = random.Random(9)
    kinds = [["a"], ["b"], ["a", "b"], ["b", "c"], ["c", "a"], [None]]
    rows = [(i, rng.choice(kinds), rng.randint(1, 40)) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, of array<string>, words long")
    found = mix.mixed(docs, F.col("of"), F.col("words"), weights={"a": 1.0, "b": 1.0, "c": 2.0, None: 1.0})
    plan, taken = found.mix_plan, Counter()
    got = found.select("row.doc_id", "sources", "size", "times").collect()
    for r in got:
        assert r["times"] <= 3
        taken[tuple(r["sources"])] += r["size"] * r["times"]
    sums = Counter()
    for _, of, n in rows:
        sums[tuple(sorted(of, key=lambda s: (s is None, s or "")))] += n
    *_, want = mix.plan(sorted(sums.items(), key=lambda x: [(s is None, s or "") for s in x[0]]), {"a": 1.0, "b": 1.0, "c": 2.0, None: 1.0})
    for i, pattern in enumerate(sorted(sums, key=lambda x: [(s is None, s or "") for s in x])):
        assert abs(taken[pattern] - want[i]) <= 3
    assert set(plan) == {"a", "b", "c", None} and len(got) == 4000


def test_mix_clashing_names_null_ids_and_repeated_rows(spark):
    """Columns named as the operator's own, a third of all rows one repeated row without an id, and ids that are all null."""
    rows = [(None, f"w{i} " * (i % 7 + 1), "a") for i in range(1200)] + [(None, "the same four words", "a")] * 900 + [(None, f"x{i}", "b") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clash = docs.withColumns({c: F.lit(1) for c in ("p", "low", "rest", "pattern", "whole", "shift", "few", "bits", "size", "times", "sources", "row", "copy", "mark", "place", "lot", "name", "x.y")})
    one, two = mix.drawn(clash), mix.drawn(clash.repartition(7))
    assert one.columns == clash.columns
    count = lambda f: Counter(r["text"] for r in f.select("text").collect())
    assert count(one) == count(two) and max(count(one).values()) <= 3 * 900
    for r in mix.report(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("n")).collect():
        assert abs(r["n"] - r["target"]) <= 4
    tied = spark.createDataFrame([(None, "the same four words", "a")] * 1500 + [(None, f"x{i}", "b") for i in range(3000)], "doc_id long, text string, source string")
    for r in mix.report(tied).groupBy("source_size", "target").agg(F.sum("taken").alias("n")).collect():
        assert abs(r["n"] - r["target"]) <= 4


def test_mix(spark, docs, none):
    found = mix.report(docs).collect()
    assert len(found) == docs.count() and all(r["taken"] <= 3 * r["size"] for r in found)
    assert sum(r["size"] for r in found) == sum(len(words(r["text"])) for r in docs.collect())
    rng = random.Random(3)
    many = spark.createDataFrame([(i, text(rng, rng.randint(1, 40)), rng.choice(("a", "b", "c", None))) for i in range(1500)], "doc_id long, text string, source string")
    one, two = (sorted(map(tuple, mix.report(x).collect())) for x in (many, many.repartition(5)))
    assert one == two
    by = defaultdict(int)
    for r in mix.report(many).collect():
        by[r["source_size"], r["target"]] += r["taken"]
    assert all(abs(n - t) <= 2 for (_, t), n in by.items()) and len(by) == 4
    drawn = mix.drawn(docs)
    assert drawn.columns == docs.columns and drawn.count() == sum(r["taken"] // r["size"] for r in found if r["size"])
    assert mix.report(none).count() == 0


def test_shards(spark, docs, none):
    found = shard.sharded(docs, 4).collect()
    assert len(found) == docs.count() and {r["shard"] for r in found} <= set(range(4))
    rng = random.Random(6)
    many = spark.createDataFrame([(i, text(rng, 5) if i % 3 else "the same text in a third of all rows") for i in range(3000)], "doc_id long, text string")
    sizes, slots = Counter(), defaultdict(set)
    for r in shard.sharded(many, 7).collect():
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].add(r["slot"])
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 7 and len(sizes) == 7
    assert all(x == set(range(len(x))) for x in slots.values()) and sum(map(len, slots.values())) == 3000
    assert shard.sharded(none).count() == 0


def test_shards_keep_equal_texts_and_follow_the_tree(spark):
    """Groups of equal texts of any size: a cut parts at most one group; every node's cut is along one dimension."""
    rng = random.Random(16)
    texts = [text(rng, rng.randint(1, 60)) + "é" * rng.choice((0, 0, 9)) for _ in range(700)]
    rows = [(i if i % 50 else None, texts[int(rng.random() ** 3 * 700)]) for i in range(4000)] + [(None, None)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"size": F.lit(1), "node": F.lit("x"), "shard": F.lit(2)})
    found = shard.sharded(docs, 12).collect()
    assert Counter((r["doc_id"], r["text_crc32"], r["size"]) for r in found) == Counter((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t in rows)
    sizes, groups = Counter(), defaultdict(set)
    for r in found:
        sizes[r["shard"]] += r["size"]
        groups[r["text_crc32"]].add(r["shard"])
    assert len(sizes) == 12 and max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 12
    assert sum(len(x) - 1 for x in groups.values()) <= 11


def wrapped(x, n=70, lead=""):
    return "\n".join(lead + y for line in x.split("\n") for y in textwrap.wrap(line, n))


def published():
    """(text as published, its licence)."""
    x = license.LICENSES
    out = [
        (f"MIT License\n\nCopyright (c) 2020 Some One\n\n{wrapped(x['MIT'])}\n", "MIT"),
        (f"The MIT License (MIT)\n\nCopyright © 2011-2020 Some One <a@b.org>\nCopyright 2021 Other\n\n{wrapped(x['MIT'], 50)}", "MIT"),
        (f"Copyright (c) 2020 Me\n\n{x['MIT'].replace('sublicense', 'sub-licence').upper()}", "MIT"),
        (f"ISC License\n\nCopyright (c) 2004-2010, Some Consortium\n\n{wrapped(x['ISC'], 64)}", "ISC"),
        ("/*\n" + wrapped("Copyright (c) 2004 Someone\n" + x["ISC"].replace("provided that the above ", "provided that the above\n"), 75, " * ") + "\n */", "ISC"),
        (f"BSD 3-Clause License\n\nCopyright (c) 2020, Some One\nAll rights reserved.\n\n{wrapped(x['BSD-3-Clause'])}", "BSD-3-Clause"),
        (f"Copyright 2020 Some One. All rights reserved.\n\n{wrapped(x['BSD-2-Clause'].replace('1. ', '* ').replace('2. ', '* '))}", "BSD-2-Clause"),
        (f"zlib License\n\n(C) 1995 Some One\n\n{wrapped(x['Zlib'], 60)}", "Zlib"),
        (wrapped(x["Unlicense"]), "Unlicense"),
        (f"BSD Zero Clause License\n\nCopyright (C) 2006 by Some One\n\n{wrapped(x['0BSD'])}", "0BSD"),
        (f"{x['MIT']} and more", None), ("copyrighted works", None), ("Copyright notice and this permission", None), ("(c) me\n", None), ("MIT License\n", None), (None, None), ("", None),
    ]
    return out


def test_licences_as_published(spark, docs, none):
    """Texts with titles, notices and wraps as they are published match, here and in the SQL; whole long licences match where the machine has them."""
    rows = [(i, x) for i, (x, _) in enumerate(published())]
    found = {r["doc_id"]: (r["license"], r["digest"] is not None) for r in license.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: x for i, (x, _) in found.items()} == {i: x for i, (_, x) in enumerate(published())}
    assert [i for i, (_, d) in found.items() if not d] == [len(rows) - 4, len(rows) - 3, len(rows) - 2, len(rows) - 1]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    order = [d[0] for d in con.execute(license.ORACLE_SQL).description]
    want = {r[order.index("doc_id")]: tuple(r[order.index(c)] for c in ("n_canonical", "digest", "license", "is_license")) for r in con.execute(license.ORACLE_SQL).fetchall()}
    assert {r["doc_id"]: tuple(r)[1:] for r in license.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want
    assert license.scanned(docs).count() == docs.count() and license.scanned(none).count() == 0


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence files on this machine")
def test_long_licences(spark):
    files = license.folder(spark, "file:///usr/share/common-licenses")
    by = {r["digest"]: r["license"] for r in files.collect()}
    known = {r["digest"]: r["license"] for r in license.known(spark).collect()}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0"} <= {known.get(d) for d in by}
    text = open("/usr/share/common-licenses/MPL-2.0").read()
    rows = spark.createDataFrame([(1, text), (2, " ".join(text.split())), (3, text[:-200])], "doc_id long, text string")
    assert [r["license"] for r in license.scanned(rows).orderBy("doc_id").collect()][::2] == ["MPL-2.0", None]
    assert license.scanned(rows, files).where("doc_id = 1").first()["license"] == "MPL-2.0"


@pytest.fixture(scope="module")
def model():
    return html.trained()


def test_html_held_out(model):
    rng, same = random.Random(99), 0
    for _ in range(150):
        source = html.generated(rng)
        page = html.Page(source)
        same += page.text([x == 1 for x in html._labels(page)[0]]) == html.main_text([source], model)[0]
    assert same >= 0.9 * 150


def test_html_marked_by_hand(model):
    """Pages written and marked by hand, none from the generator: at least nine tenths of the blocks of text are told right."""
    right = total = exact = 0
    for source, want in MARKED:
        found = html.main_text([source], model)[0].split("\n\n")
        every = [b for b in html.Page(source).text([True] * 10_000).split("\n\n") if b]
        total += len(every)
        right += sum((b in found) == (b in want) for b in every)
        exact += found == want
    assert right >= 0.9 * total and exact >= 0.6 * len(MARKED), (right, total, exact)


def test_html_reads_hostile_pages_once(model):
    for x in ('<p a="x ' * 250_000, "<b>" * 100_000 + "</i>" * 400_000, "<p><html>" + "<b>" * 50_000 + "<h2>" * 50_000, "<" * 1_000_000, "<a href='" * 220_000, "<!--" * 500_000, "<script>" * 250_000, "</x " * 500_000, "<a b=' c=\" " * 150_000):
        began = time.time()
        html.Page(x)
        assert time.time() - began < 4


def test_html_only_void_elements_close_themselves():
    page = html.Page("<div data-u=http://x/>inside</div><br/><img src=a />after")
    assert [(page.tags[n], x) for n, _, x in page.pieces] == [("div", "inside"), ("#", " "), ("#", "after")]
    assert html.Page("a < b and <b title='x > y' c=\"d'\">c</b> d <").text([True] * 9) == "a < b and c d"


def test_html_pages(spark, model):
    page = "<html><head><title>T</title><script>var a='<p>';</script></head><body><nav><ul><li><a href=/>x,</a></li></ul></nav><article><h1>Head &amp; line</h1><p><b>One two three four,\n five six.<br>Seven<p>Eight nine ten &am</article><div class=\"comments\"><p>me too</p></div><footer>(c) x</footer></body"
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "<p"), (1, "u", page)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    found = html.extracted(rows, model).collect()
    assert [r["text"] for r in found if r["page_id"] == 1] == ["Head & line\n\nOne two three four, five six. Seven\n\nEight nine ten &am"] * 2
    assert all(r["text"] == "" and r["n_chars"] == 0 for r in found if r["page_id"] != 1) and len(found) == 5
    assert html.extracted(rows.limit(0), model).count() == 0


def test_html_implied_ends_do_not_silence():
    """Ends that markup may leave out: of option, of head before body or its first element, of p over a silent element."""
    article = "<article><p>Whole text.</p></article>"
    for before in ("<body><select><option>A<option>B</select>", "<html><head><title>T</title><body>", "<head><meta charset=x><title>T</title>", "<head><title>T</title><br>", "<body><p><button>B<div>x</div>"):
        pieces = [piece for _, _, piece in html.Page(before + article).pieces]
        assert "Whole text." in pieces and "A" not in pieces and "B" not in pieces and "T" not in pieces
    assert [piece for _, _, piece in html.Page("<head><title>T</title>Bare text").pieces] == ["Bare text"]


def test_html_svg_math_and_fallbacks():
    """Self-closed svg icons end where they stand, formulas and fallback content are text, and none of them parts a line."""
    whole = lambda x: html.Page(x).text([True] * 99)
    assert whole('<body><nav>menu</nav><svg class="i"/><article><p>The article.</p></article>') == "menu\n\nThe article."
    assert whole('<p>one <svg viewBox="0 0 1 1"><title>icon</title><path d="M0 0"/><g><circle r=1 /></g></svg> two</p><p>three</p>') == "one two\n\nthree"
    assert whole("<p>as <math><mi>a</mi><mo>=</mo><mspace/><mi>b</mi></math> says</p><p>next") == "as a=b says\n\nnext"
    assert whole("<svg><path d=x/><text>label</text></svg><p>after</p>") == "label\n\nafter"
    assert whole("<p>a <noscript>kept <b>too</b></noscript> b <canvas>drawn</canvas> <video src=v>no video</video><img src=x>c<wbr>d</p>") == "a kept too b drawn no videocd"
    assert whole("<p>x<script>var a = '<p>';</script><template>no</template><iframe><p>no</iframe>y") == "x\n\ny"
    assert whole("<div/>inside<svg>") == "inside"


#: Pages made and marked by hand: source, blocks of the main text.
MARKED = [
    (
        """<html><body class="home blog"><div id="page"><header class="site-header"><a href="/">The Daily Loaf</a><p class="tagline">Bread, slowly</p></header>
<div class="entry-content"><h1>Why I proof overnight</h1><p>Most recipes rush. I put the dough in the fridge at ten and forget it.</p><p>In the morning it has doubled, and it smells of apples.</p><h2>What you need</h2><ul><li>500 g of strong flour</li><li>Salt, water, patience</li></ul></div>
<div id="comments"><h3>2 thoughts</h3><div class="comment-body"><p>I tried this with rye and it worked very well for me, thank you for it.</p></div></div>
<div class="widget"><h3>Archives</h3><ul><li><a href="/a">May</a></li><li><a href="/b">June</a></li></ul></div><footer>Powered by a kitchen</footer></div></body></html>""",
        ["Why I proof overnight", "Most recipes rush. I put the dough in the fridge at ten and forget it.", "In the morning it has doubled, and it smells of apples.", "What you need", "500 g of strong flour", "Salt, water, patience"],
    ),
    (
        """<!doctype html><title>Harbour</title><nav><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport</a></nav><main><article><h1>Harbour reopens after storm</h1><p class=byline>By a reporter</p><p>The harbour reopened on Tuesday, three weeks after the storm that sank nine boats and closed the fish market.</p><aside class="related-links"><h2>More</h2><ul><li><a href=/1>Storm in pictures</a><li><a href=/2>Nine boats lost</a></ul></aside><p>Fishermen said that the damage would take months to mend. &ldquo;We go out anyway,&rdquo; said one.</p></article></main><section class="newsletter-signup"><p>Get our news by mail every morning.</p><form><input name=mail><button>Join</button></form></section>""",
        ["Harbour reopens after storm", "By a reporter", "The harbour reopened on Tuesday, three weeks after the storm that sank nine boats and closed the fish market.", "Fishermen said that the damage would take months to mend. \u201cWe go out anyway,\u201d said one."],
    ),
    (
        """<body><div class="sidebar"><ul><li><a href="i.html">Install</a></li><li><a href="u.html">Use</a></li><li><a href="a.html">API</a></li></ul></div><div role="main" class="document"><h1>Install</h1><p>Unpack the archive and run the script. It needs no rights of an administrator.</p><pre>tar xf tool.tar
./install --here</pre><p>If it fails, read the log. The last line says what is missing, and the one before says where it was looked for.</p></div><div class="footer">Made with a generator of manuals</div></body>""",
        ["Install", "Unpack the archive and run the script. It needs no rights of an administrator.", "tar xf tool.tar ./install --here", "If it fails, read the log. The last line says what is missing, and the one before says where it was looked for."],
    ),
    (
        """<html><head><title>Birds</title></head><body><h1>Notes on birds</h1><p>Crows keep accounts. A crow that was cheated once will not trade with the same hand again, and it tells its friends.</p><p>Wrens do not. They sing at anyone who passes, in rain and in sun, from the same post.</p><p>I have watched both from my window for eleven years.</p><hr><p><a href="index.html">Back</a> | <a href="next.html">Next</a></p></body></html>""",
        ["Notes on birds", "Crows keep accounts. A crow that was cheated once will not trade with the same hand again, and it tells its friends.", "Wrens do not. They sing at anyone who passes, in rain and in sun, from the same post.", "I have watched both from my window for eleven years."],
    ),
    (
        """<body><div class="cookie-banner"><p>We use cookies to make this site better. <button>Fine</button></p></div><div class="navbar-top"><a href="/">Start</a><a href="/preise">Preise</a></div><div class="story-body"><h1>Der lange Weg nach Hause</h1><p>Am Abend gingen sie los, &uuml;ber die Br&uuml;cke und dann am Fluss entlang.</p><p>Niemand sprach. Erst als das Dorf zu sehen war, lachte einer.</p><blockquote>Wir sind fast da.</blockquote></div><div class="share-buttons"><a href="#">Teilen</a></div><div class="advert-box">Neue Schuhe zum halben Preis, nur heute und nur hier!</div><div class="site-footer"><p>Impressum</p></div></body>""",
        ["Der lange Weg nach Hause", "Am Abend gingen sie los, \u00fcber die Br\u00fccke und dann am Fluss entlang.", "Niemand sprach. Erst als das Dorf zu sehen war, lachte einer.", "Wir sind fast da."],
    ),
    (
        """<body><header><h2>Town library</h2><ul><li><a href=/h>Hours</a></li><li><a href=/c>Catalogue</a></li></ul></header><div><div class="content-wrap"><article itemprop="articleBody"><p>The library lends tools now: drills, ladders, a press for apples. Bring your card and bring them back dry.</p><p>A saw may be kept for two weeks. <a href="/rules">The rules</a> say what happens after that.</p></article><aside><p>Children read on Mondays at four.</p></aside></div></div><div class="comments-area"><p class="comment">Finally! I have needed a ladder for years, and the shop is far away.</p></div></body>""",
        ["The library lends tools now: drills, ladders, a press for apples. Bring your card and bring them back dry.", "A saw may be kept for two weeks. The rules say what happens after that."],
    ),
]
