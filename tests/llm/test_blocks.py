"""Cuts into prefix, middle and suffix, hash trees, and web archives: against plain accounts, on edges, and on broken input."""

import gzip
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weft.llm import fim, merkle, warc

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
CLASHES = ("node", "leaf", "shown", "pos", "n", "block", "members", "levels", "path", "root", "form", "output", "payload", "digest", "page_key", "record_id", "copy", "segment", "salt", "all", "g0", "k0")


def texts():
    rng = random.Random(8)
    pieces = (" ", "  ", "\t\n", " ", "word", "é", "\U0001f600", "<", "P>", "S", "x\x00y", "\x1c", "\x85")
    out = [None, "", " ", "\n\n", "a", " a", "a ", "<P>", "so <M> what", "é" * 3, "  "]
    out += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    return [*out, "long " * 300_000, "x" * 3_000_000, " " * 2_000_000 + "y", "\U0001f600 é" * 200_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, x, f"s{i % 3}" if i % 4 else None, ("en", "de", None, "", "zh")[i % 5], len(x or "") if i % 6 else None) for i, x in enumerate(texts())]
    rows += [rows[14], rows[14], (None, "no id", None, None, None), (None, "no id", None, None, None), (None, None, None, None, None), (15, "same id, other text", "s1", "en", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(3).withColumns({c: F.lit(c) for c in CLASHES})


def plain_form(doc_id, text, rate=50, first=80, token=TOKEN):
    units = token.findall(text)
    hexed = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in fim.SENTINELS) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    lo, hi = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    form = "spm" if h4 % 100 < first else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("units", ["tokens", "chars"])
def test_fim_equals_a_list_of_units(docs, units):
    token = TOKEN if units == "tokens" else re.compile(r"(?s).")
    given = sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()), key=str)
    made = fim.transformed(docs, rate=90, units=units).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    found = made.collect()
    assert sorted(((r["doc_id"], r["back"]) for r in found), key=str) == given
    want = sorted(((i, *plain_form(i, x, rate=90, token=token)) for i, x in given), key=str)
    assert sorted((tuple(r)[:6] for r in found), key=str) == want
    assert {r["form"] for r in found} == {"plain", "spm", "psm"}


def test_fim_query_and_no_rows(docs):
    found = fim.digest(fim.transformed(docs)).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in docs.select("doc_id", "text").collect():
        *facts, output = plain_form(r["doc_id"], r["text"] or "")
        want.append((r["doc_id"], *facts, sha(output), sha(r["text"] or "")))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert fim.digest(fim.transformed(docs.limit(0))).count() == 0


@pytest.mark.parametrize(("step", "scan"), [(1, 8), (3, 16), (7, 64), (256, 1 << 20)])
def test_checkpoints_find_every_cut(step, scan):
    for text in texts()[1:50]:
        data = text.encode()
        found = fim.Checkpoints(data, fim.token_ends, step, scan)
        units = TOKEN.findall(text)
        assert found.count == len(units) and len(found.byte) == len(units) // step + 1
        at = 0
        for u in range(len(units) + 1):
            assert found.cut(u) == (len(text[:at].encode()), at)
            at += len(units[u]) if u < len(units) else 0


def plain_leaf(*fields):
    given = ["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields]
    return hashlib.sha256("".join(given).encode()).hexdigest()


def test_merkle_equals_a_plain_tree(docs, monkeypatch):
    rows = docs.select("doc_id", "source", "lang", "n_chars", "text").collect()
    leaves = [(r["lang"], r["doc_id"], plain_leaf(*r)) for r in rows]
    want = merkle.brute_force(leaves)
    for levels in (1, 2, 10):  # blocks of 2 and 4 leaves take many rounds
        monkeypatch.setattr(merkle, "LEVELS", levels)
        found = merkle.checked(docs).collect()
        assert len(found) == len(rows)
        tampered = 0
        for r, of in ((r, defaultdict(list)) for r in found):
            options = [(x, w) for x, w in want.items() if x[1] == r["doc_id"] and x[2] == r["leaf"]]
            for (g, o, x), (sub, root, sibs) in options:
                of[(sub, root)].append(sibs)
            assert (r["subroot"], r["root"]) in of
            n_chars = [q["n_chars"] for q in rows if plain_leaf(*q) == r["leaf"]][0]
            hit = r["doc_id"] is not None and n_chars is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            assert r["verified"] == (not hit) and (r["folded_root"] == r["root"]) == (not hit)
            tampered += hit
        assert 0 < tampered < len(rows)
        singles = {x: w for x, w in want.items() if sum(y[2] == x[2] for y in leaves) == 1}
        proofs = {r["leaf"]: r["proof_sha256"] for r in found}
        assert all(proofs[x[2]] == hashlib.sha256(w[2].encode()).hexdigest() for x, w in singles.items()) and len(singles) > 50
    assert merkle.checked(docs.limit(0)).count() == 0


def test_merkle_arity_and_many_rows(spark, monkeypatch):
    """Trees of runs of three over 3,000 rows in one hot group and several small ones, in many partitions and rounds."""
    monkeypatch.setattr(merkle, "LEVELS", 3)
    monkeypatch.setattr(merkle, "LEAST_ROWS", 400)
    rows = spark.range(3_000).repartition(7).select(F.col("id").alias("k"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("g"), F.col("id") % 10)).alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    want = merkle.brute_force([(r["g"], r["k"], r["leaf"]) for r in rows.collect()], 3)
    found = merkle.manifest(rows, ["g"], ["k"], keep=["g", "k"], arity=3).withColumn("sibs", merkle.siblings(F.col("path"))).withColumn("folded", merkle.folded(F.col("leaf"), F.col("path")))
    got = found.collect()
    assert {(r["g"], r["k"], r["leaf"]): (r["subroot"], r["root"], r["sibs"]) for r in got} == want
    assert all(r["folded"] == r["root"] for r in got)


def test_merkle_tells_what_changed(spark):
    rows = spark.range(300).select("id", (F.col("id") % 3).cast("string").alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    later = rows.where("id <> 4").withColumn("leaf", F.when(F.col("id") == 7, F.lit("0" * 64)).otherwise(F.col("leaf"))).union(spark.createDataFrame([(1000, "1", "1" * 64)], rows.schema))
    one, two = (merkle.manifest(x, ["g"], ["id"], keep=["g", "id"]) for x in (rows, later))
    assert sorted((r["id"], r["state"]) for r in merkle.changed(one, two, ["g"], ["id"]).collect()) == [(4, "removed"), (7, "altered"), (1000, "added")]
    assert merkle.changed(one, one, ["g"], ["id"]).count() == 0


HOSTILE = ["", None, "a\r\n\r\nb", "\r\n", "x\r\n\r\n\r\n\r\n", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 40, "0\r\n\r\n", "é\U0001f600" * 9000, "<p>" * 100_000, "\x00\x01", "z" * 32768, "q" * 8192]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h/{i}", x) for i, x in enumerate(HOSTILE)]
    rows += [(100 + i, None, HOSTILE[i % 5]) for i in range(40)] + [(200, "u\r\nv", "twice"), (200, "u\r\nv", "twice"), (None, "w", "lone"), (None, "w", "twice"), (201, "v", HOSTILE[8])]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).withColumns({c: F.lit(c) for c in CLASHES})


def plain_records(rows, least=0):
    import base64

    by = defaultdict(list)
    for i, h in rows:
        by[(h or "").encode()].append(i)
    out = []
    for data, ids in by.items():
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        ids.sort(key=lambda i: (i is not None, i or 0))
        out += [(i, len(data), digest, "response" if n + 1 == len(ids) or len(data) < least else "revisit", ids[-1] if n + 1 < len(ids) and len(data) >= least else None) for n, i in enumerate(ids)]
    return sorted(out, key=str)


def test_archives_give_the_pages_back(spark, pages, tmp_path):
    rows = [(r["page_id"], r["html"]) for r in pages.select("page_id", "html").collect()]
    path = f"file://{tmp_path}/a"
    found = warc.report(pages, path)
    columns = "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    assert sorted((tuple(r) for r in found.select(*columns).collect()), key=str) == plain_records(rows)
    assert found.where("problem is not null").count() == 0
    back = {(r["page_id"], bytes(r["payload"])) for r in warc.payloads(warc.parsed(spark, path)).collect()}
    assert {p for _, p in back} == {(h or "").encode() for _, h in rows}
    kinds = {r["type"]: r["n"] for r in warc.parsed(spark, path).groupBy("type").agg(F.count("*").alias("n")).collect()}
    assert kinds["continuation"] > 10 and kinds["response"] + kinds["revisit"] == len(rows)
    ids = [r["record_id"] for r in warc.parsed(spark, path, keep=False).select("record_id").collect()]
    assert len(ids) == len(set(ids))
    warc.archived(pages, f"file://{tmp_path}/b", segment=100, chunk=7, least=6)
    again = warc.resolved(spark, f"file://{tmp_path}/b")
    assert sorted((tuple(r) for r in again.select(*columns).collect()), key=str) == plain_records(rows, 6)
    assert warc.report(pages.limit(0), f"file://{tmp_path}/c").count() == 0


def archive(path, *records):
    path.mkdir(exist_ok=True)
    with gzip.open(path / f"{len(list(path.iterdir()))}.warc.gz", "wb") as f:
        f.write(b"".join(r + warc.BLANK for r in records))


def test_segments_from_anywhere_and_broken_ones(spark, tmp_path):
    """Segments in other archives and any order; one missing, one too short, one altered, one of two contents; a torn archive."""
    row = lambda i: {"record_id": f"<urn:uuid:{i}>", "page_id": i, "url": f"u{i}", "digest": warc._sha1(b"abcdefgh" * 50)[5:], "refers_id": None, "payload": b"abcdefgh" * 50}
    cut = {i: list(warc.records(row(i), 120, 33)) for i in range(8)}
    assert all(len(x) > 4 for x in cut.values())
    folder = tmp_path / "w"
    archive(folder, cut[0][3], cut[1][0], cut[0][0], cut[2][0], *cut[2][2:], cut[4][0], cut[7][0])
    archive(folder, *cut[0][:0:-1], *cut[1][1:-1], *cut[3][:-1], cut[3][-1].replace(b"WARC-Segment-Total-Length: ", b"WARC-Segment-Total-Length: 9"))
    archive(folder, *cut[4][1:], cut[4][2].replace(b"Number: 3", b"Number: 2"), *cut[5][:2], cut[5][2][:-1] + b"?", *cut[5][3:])
    archive(folder, next(warc.records(row(6), 1 << 20, 33)), b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 999\r\n\r\ntorn")
    archive(folder, *cut[7][1:])
    found = {r["page_id"]: (r["payload"] and bytes(r["payload"]), r["problem"]) for r in warc.payloads(warc.parsed(spark, f"file://{folder}")).collect()}
    good = (b"abcdefgh" * 50, None)
    assert found[0] == found[6] == found[7] == good
    assert found[1] == (None, "last segment missing") and found[2] == (None, "segment 2 missing")
    assert found[3][0] is None and "bytes of 9" in found[3][1] and found[4] == (None, "segment 2 twice") and found[5] == (None, "block digest")
    assert "torn" in found[None][1]


def test_framing():
    rng = random.Random(3)
    for n in (0, 1, 7, 8, 9, 1000):
        data = rng.randbytes(n)
        for size in (1, 7, 8, 4096):
            assert warc.unchunked(warc.chunked(data, size)) == data
    assert warc.unchunked(b"5;a=b\r\nhello\r\n0\r\nTrailer: x\r\n\r\n") == b"hello"
    for broken in (b"", b"5\r\nhell", b"x\r\n", b"5\r\nhelloo\r\n0\r\n\r\n", b"5\r\nhello\r\n", b"-1\r\n"):
        assert warc.unchunked(broken) is None
    assert warc.message_payload(b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nab") == b"ab"
    assert warc.message_payload(b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nab") is None
