"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and connected components.

A document's set holds its distinct word shingles. SuperMinHash gives element i the values r + j at place
p_i(j), for j = 0, 1, ..., where p_i is a random permutation of the signature's places; a place keeps its
least value. Values of step j are at least j, so a set stops as soon as all its places hold less than the
next j: long texts stop after one step.

1. Texts with equal sets become one class, whose node is its least doc_id (a group of copies is one row).
2. Bands of equal signature places give buckets. In each bucket the member that shares most buckets is the
   centre, and every other member is compared with it: pairs grow as the bucket, not as its square.
3. Pairs whose signatures agree enough are confirmed on full sets, streamed in chunks of one centre and a
   bounded number of members, so a hot centre is dealt over many tasks.
4. Components come from rounds of large-star and small-star over the confirmed links.
5. Members of a bucket outside its centre's component are compared on full sets with all members of the
   buckets of that centre, a chunk of them at a time, and components are taken again. Only links leave the
   comparison, one for a member and a component. No link within a bucket is left unseen.

A pair of similarity s shares a bucket with probability 1 - (1 - s^rows)^bands: 0.99998 at 0.8 for 5 and 28.

Edge cases: null, empty and blank texts have an empty set and link with nothing; a null doc_id links with
nothing and is kept; rows that share a doc_id count as one document for links; ties have no effect; a
very long text is a block alone and its set is whole; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._store import written
from weft.llm._text import LOWER_SPACE, MIX, Words, blocks, grams, scrambled, translated

BLOCK_BYTES = 4 << 20
ELEMENTS = 150_000
ROWS, BANDS = 5, 28
#: Signatures that agree in less are not compared on full sets: five standard errors below the threshold.
LEAST_AGREEMENT = 0.15
CHUNK = 250
#: Members of a group that one task counts against a chunk of them.
SEGMENT = 1_000
BROADCAST_ROWS = 4_000_000


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): the sorted distinct shingles of text i are hashes[starts[i]:starts[i + 1]]."""
    words = Words(translated(texts, LOWER_SPACE))
    each, starts, sizes = words.hashes(), words.starts, np.diff(words.starts)
    counts = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    out = np.empty(int(counts.sum()), np.uint64)
    ends = np.cumsum(counts)
    codes = grams(each, k)
    for a, n, b, m in zip(starts.tolist(), sizes.tolist(), ends.tolist(), counts.tolist(), strict=False):
        if n >= k:
            out[b - m : b] = codes[a : a + m]
            out[b - m : b].sort()
        elif n:
            out[b - 1] = grams(each[a : a + n], n)[0] ^ MIX
    docs = np.repeat(np.arange(len(counts)), counts)
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (docs[1:] != docs[:-1])
    return out[new], np.concatenate(([0], np.cumsum(np.bincount(docs[new], minlength=len(counts)))))


def superminhash(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Signatures of ``size`` places (at most 256), one row for each set; a row of an empty set means nothing."""
    n = len(starts) - 1
    out = np.full((n, size), np.iinfo(np.uint64).max, np.uint64)
    first = 0
    while first < n:  # a bounded number of elements at a time, at least one set
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + ELEMENTS, "right")) - 1)
        _signed(hashes[starts[first] : starts[last]], starts[first : last + 1] - starts[first], out[first:last])
        first = last
    return out


def _signed(elements: np.ndarray, starts: np.ndarray, out: np.ndarray) -> None:
    size, flat = out.shape[1], out.reshape(-1)
    docs = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    places = None
    for j in range(size):
        with np.errstate(over="ignore"):
            random = scrambled(elements + np.uint64(j + 1) * MIX)
        k = j + (((random >> np.uint64(32)) * np.uint64(size - j)) >> np.uint64(32)).astype(np.int64)
        value = (np.uint64(j) << np.uint64(32)) | (random & np.uint64(0xFFFFFFFF))
        if places is None:
            at = k
        else:
            row = np.arange(len(elements))
            at = places[row, k].astype(np.int64)
            places[row, k] = places[:, j]
            places[:, j] = at
        np.minimum.at(flat, docs * size + at, value)
        unfilled = out.max(axis=1) >= np.uint64(j + 1) << np.uint64(32)
        active = unfilled[docs]
        if not active.any():
            return
        if places is None:
            elements, docs, k = elements[active], docs[active], k[active]
            places = np.tile(np.arange(size, dtype=np.uint8), (len(elements), 1))
            row = np.arange(len(elements))
            places[row, k], places[row, 0] = 0, k
        elif not active.all():
            elements, docs, places = elements[active], docs[active], places[active]


def signed(docs: DataFrame, k: int, rows: int, bands: int) -> DataFrame:
    """doc_id, key (of the whole set; null if empty), n_shingles, bands and a byte of each signature place."""
    if rows * bands > 256:
        raise ValueError("rows * bands must be at most 256")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            hashes, starts = shingle_sets(block.column("text"), k)
            sizes = np.diff(starts)
            signature = scrambled(superminhash(hashes, starts, rows * bands))
            with np.errstate(over="ignore"):
                mixed = np.zeros((len(sizes), bands), np.uint64)
                for r in range(rows):
                    mixed = mixed * MIX + signature[:, r::rows]
                mixed = scrambled(mixed + np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            keys = [xxhash.xxh3_128_digest(hashes[a:b].tobytes()) if b > a else None for a, b in zip(starts[:-1], starts[1:], strict=True)]
            listed = pa.ListArray.from_arrays(np.arange(0, mixed.size + 1, bands, dtype=np.int32), pa.array(mixed.reshape(-1).view(np.int64)))
            small = (signature >> np.uint64(56)).astype(np.uint8)
            yield pa.record_batch(
                [block.column("doc_id").cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes.astype(np.int64)), listed, pa.array([x.tobytes() for x in small], pa.binary())],
                ["doc_id", "key", "n_shingles", "bands", "signature"],
            )

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, key binary, n_shingles long, bands array<long>, signature binary")


def _small(frame: DataFrame, rows: int) -> DataFrame:
    """Broadcast while it has few rows; else left to the shuffle."""
    return F.broadcast(frame) if rows <= BROADCAST_ROWS else frame


def _routed(docs: DataFrame, nodes: DataFrame, routes: DataFrame, k: int) -> DataFrame:
    """routes (node, a, chunk, role, ...) with the node's set, one (a, chunk) together and sorted by role.

    nodes (node, key) says which texts the ids mean; sets are made again from the whole texts.
    """
    n = routes.count()
    wanted = _small(routes.select("node").distinct().join(nodes, "node").select(F.col("node").alias("doc_id"), "key"), n)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            hashes, starts = shingle_sets(block.column("text"), k)
            found = [hashes[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
            same = [xxhash.xxh3_128_digest(x) == key for x, key in zip(found, block.column("key").to_pylist(), strict=True)]
            yield pa.record_batch([block.column("doc_id").cast(pa.int64()), pa.array(found, pa.binary())], ["node", "members"]).filter(pa.array(same, pa.bool_()))

    texts = docs.select("doc_id", "text").join(wanted, "doc_id").mapInArrow(sets, "node long, members binary")
    return texts.join(_small(routes, n), "node").repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role")


def confirmed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold: a chunk is one a and about CHUNK of its partners."""
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = written(
        pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / CHUNK)).cast("int").alias("chunk")),
        "neardup-pairs",
    )
    routes = dealt.select(F.col("b").alias("node"), "a", "chunk", F.lit(1).alias("role")).union(dealt.select("a", "a", "chunk", F.lit(0)).distinct())

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, mine = None, np.empty(0, np.uint64)
        for batch in batches:
            left, right = [], []
            for a, node, role, data in zip(*(batch.column(c).to_pylist() for c in ("a", "node", "role", "members")), strict=True):
                other = np.frombuffer(data, np.uint64)
                if role == 0:
                    centre, mine = a, other
                    continue
                if centre != a:
                    raise RuntimeError(f"the set of document {a} is missing")
                shared = 0
                if 100 * min(len(mine), len(other)) >= percent * max(len(mine), len(other)):
                    both = np.concatenate((mine, other))
                    both.sort()
                    shared = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * shared >= percent * (len(mine) + len(other) - shared):
                    left.append(a)
                    right.append(node)
            yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return _routed(docs, nodes, written(routes, "neardup-routes"), k).select("a", "node", "role", "members").mapInArrow(linked, "a long, b long")


def settled(docs: DataFrame, nodes: DataFrame, groups: DataFrame, k: int, percent: int) -> DataFrame:
    """Links across components in groups (a, node, component, own): own is the component of the group's centre a.

    A chunk holds about CHUNK members from other components, indexed by shingle; the members of the group
    pass it one by one, about SEGMENT in a task, and are counted against all of the chunk at once. Of a member's
    links to one component the first in a segment is returned, so rows grow as the group and not as its pairs.
    """
    outside = groups.where("component <> own")
    chunks = outside.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("n"))
    parts = chunks.join(groups.groupBy("a").agg(F.ceil(F.count("*") / SEGMENT).cast("int").alias("segments")), "a")
    spread = lambda x, by: F.pmod(F.xxhash64("node", F.lit(by)), x)
    # a task is a chunk and a segment: chunk * segments + segment
    first = spread(F.col("n"), "chunk") * F.col("segments")
    dealt = outside.join(parts, "a").select("node", "a", F.explode(F.sequence(first, first + F.col("segments") - 1)).alias("chunk"), F.lit(0).alias("role"), "component")
    own = spread(F.col("segments"), "segment")
    every = groups.join(parts, "a").select("node", "a", F.explode(F.sequence(own, own + (F.col("n") - 1) * F.col("segments"), F.col("segments").cast("long"))).alias("chunk"), F.lit(1).alias("role"), "component")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index, seen = None, [], None, set()
        for batch in batches:
            left, right = [], []
            for *here, node, role, component, data in zip(*(batch.column(c).to_pylist() for c in ("a", "chunk", "node", "role", "component", "members")), strict=True):
                if here != at:
                    at, held, index, seen = here, [], None, set()
                mine = np.frombuffer(data, np.uint64)
                if role == 0:
                    held.append((node, component, mine))
                    continue
                if not held:
                    continue
                if index is None:
                    sizes = np.array([len(x) for _, _, x in held])
                    flat, owner = np.concatenate([x for _, _, x in held]), np.repeat(np.arange(len(held)), sizes)
                    order = np.argsort(flat, kind="stable")
                    index, owner, parts = flat[order], owner[order], np.array([c for _, c, _ in held])
                low, high = np.searchsorted(index, mine, "left"), np.searchsorted(index, mine, "right")
                n = high - low
                rows = owner[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                shared = np.bincount(rows, minlength=len(held))
                for i in np.flatnonzero((100 * shared >= percent * (sizes + len(mine) - shared)) & (parts != component)).tolist():
                    if (i, component) not in seen:
                        seen.add((i, component))
                        left.append(held[i][0])
                        right.append(node)
            yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    routed = _routed(docs, nodes, written(dealt.union(every), "neardup-routes"), k)
    return routed.select("a", "chunk", "node", "role", "component", "members").mapInArrow(linked, "a long, b long")


def agreeing(pairs: DataFrame, signatures: DataFrame, least: float) -> DataFrame:
    """The pairs whose signatures agree in the given share of places."""
    both = pairs.join(signatures.select(F.col("node").alias("a"), F.col("signature").alias("x")), "a").join(signatures.select(F.col("node").alias("b"), F.col("signature").alias("y")), "b")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in "xy")
            yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= least))

    return both.select("a", "b", "x", "y").mapInArrow(close, "a long, b long")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the least id that each linked id reaches, by alternating large-star and small-star."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    total = _checksum(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("u <> m")).where("u <> v").distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = written(edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least).distinct(), name)
        if (now := _checksum(edges)) == total:
            break
        total = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text).

    Documents are linked when 100 * intersection >= percent * union; component_id is the least linked id.
    """
    table = written(signed(docs, k, rows, bands), "neardup-signed")
    real = table.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    nodes = written(real.groupBy("key").agg(F.min("doc_id").alias("node")), "neardup-nodes")
    chosen = real.select(F.col("doc_id").alias("node"), "key", "bands", "signature").join(nodes, ["key", "node"])
    buckets = chosen.select("node", F.explode("bands").alias("band")).distinct()
    shared = buckets.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = written(chosen.select("node", F.explode("bands").alias("band")).distinct().join(shared, "band"), "neardup-buckets")
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    ranked = members.select("band", "node").join(degree, "node")
    centres = ranked.groupBy("band").agg(F.max(F.struct("degree", (-F.col("node")).alias("low"))).alias("top")).select("band", (-F.col("top.low")).alias("a"))
    pairs = members.join(centres, "band").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    signatures = written(chosen.select("node", "signature").join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "neardup-signatures")
    least = percent / 100 - LEAST_AGREEMENT
    links = written(confirmed(docs, nodes, agreeing(pairs, signatures, least), k, percent), "neardup-links")
    labels = components(links)

    own = labels.toDF("a", "own")
    groups = members.select("band", "node").join(centres, "band").select("a", "node").distinct()
    groups = groups.join(labels, "node", "left").join(own, "a", "left").select("a", "node", F.coalesce("component", "node").alias("component"), F.coalesce("own", "a").alias("own"))
    groups = written(groups, "neardup-groups")
    more = written(settled(docs, nodes, groups, k, percent), "neardup-links")
    labels = components(links.union(more))

    classes = nodes.join(labels, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    found = table.select("doc_id", "n_shingles", "key").join(classes, "key", "left")
    named = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", named.alias("component_id"), F.coalesce(F.col("doc_id") == named, F.lit(True)).alias("kept"))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def kept(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with all its columns: a row whose id is the least of its component.

    Of rows of one id that have the same words in the same order one stays (any, where other columns differ); rows of one id
    with other words all stay, as nothing says that they are copies.
    """
    found = near_duplicates(docs, k, percent)
    others = written(found.where(~F.col("kept")).select("doc_id").distinct(), "neardup-others")
    one = docs.join(_small(others, others.count()), "doc_id", "left_anti")
    # rows of one id: those of the same words are one, found among the few ids that occur twice
    twice = written(found.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "neardup-twice")
    if not (n := twice.count()):
        return one.select(docs.columns)
    rest = one.join(_small(twice, n), "doc_id", "left_semi")
    same = F.trim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower()), r"[\x20\x09-\x0D]+", " "))
    first = rest.withColumn("_same_words", same).dropDuplicates(["doc_id", "_same_words"])
    return one.join(_small(twice, n), "doc_id", "left_anti").select(docs.columns).union(first.select(docs.columns))


def brute_force(texts: dict[int, str | None], k: int, percent: int) -> dict[int, tuple[int, int, bool]]:
    """The same by comparing all pairs; for tests."""
    import re

    sets: dict[int, frozenset] = {}
    for key, text in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[key] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())
    root = {key: key for key in texts}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {key: (len(sets[key]), find(key), find(key) == key) for key in texts}




#: For three-word shingles and 85 per cent; it compares all documents that share a shingle, so it is for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reached AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reached r JOIN both_ways b ON r.y = b.x),
least AS (SELECT x AS doc_id, least(x, min(y)) AS component_id FROM reached GROUP BY x)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, coalesce(component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""
