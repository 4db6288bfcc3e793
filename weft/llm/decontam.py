"""Benchmark decontamination by winnowing.

Both sides are cut to words. Of every ``window - gram + 1`` consecutive grams the one with the least
hash (the last of equals) is a fingerprint, so any ``window`` words that a document shares with an item
share a fingerprint too. A shared fingerprint is extended, word by word, to the windows around it that keep it;
those that equal a window of an item are hits, and together they cover every longer run. An item with fewer
words is one window of its own length.

The benchmark goes to the executors whole while its texts hold at most ``broadcast_bytes``; beyond that,
fingerprints are joined by shuffle and only the pairs that share one are compared.

Edge cases: null and empty texts have no words and no hits; a null doc_id is kept; rows are told
apart by row, never by id, so repeated rows give repeated rows; an empty benchmark hits nothing;
a very long text is searched whole, in time by its own words, also where it and an item repeat one word; a null item id counts as the empty string; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm._store import written
from weft.llm._text import LOWER_ALNUM, MIX, Words, blocks, grams, scrambled, translated

BLOCK_BYTES = 8 << 20
BROADCAST_BYTES = 64 << 20
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items array<string>"


def _valid(docs: np.ndarray, length: int) -> np.ndarray:
    """Whether the run of ``length`` words from each place stays within one text."""
    return docs[: len(docs) - length + 1] == docs[length - 1 :] if len(docs) >= length else np.empty(0, bool)


def winnowed(hashes: np.ndarray, docs: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows' first places, the place of the gram that each keeps, and the hashes of all grams. Kept places ascend."""
    whole = _valid(docs, window)
    if not len(whole):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    every = grams(hashes, gram)
    n = len(whole)
    least, at = every[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, window - gram + 1):
        other = every[j : j + n]
        better = other <= least
        least[better] = other[better]
        at[better] = j
    first = np.flatnonzero(whole)
    return first, first + at[whole], every


def fingerprints(hashes: np.ndarray, docs: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the grams that winnowing keeps."""
    _, chosen, every = winnowed(hashes, docs, window, gram)
    places = np.unique(chosen)
    return places, every[places]


def _found(index: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Where each code stands in a sorted index, -1 if it doesn't."""
    if not len(index):
        return np.full(len(codes), -1)
    at = np.minimum(np.searchsorted(index, codes), len(index) - 1)
    return np.where(index[at] == codes, at, -1)


class Runs:
    """Distinct runs of ``size`` words: by code one place of each, and the list of the items that hold it.

    Runs of the same items share a list, so that an item's own runs, or those of its copies, have one between them.
    """

    def __init__(self, size: int, codes: np.ndarray, places: np.ndarray, items: np.ndarray):
        self.size = size
        order = np.lexsort((items, codes))
        codes, places, items = codes[order], places[order], items[order]
        fresh, other = np.ones(len(codes), bool), np.ones(len(codes), bool)
        fresh[1:] = codes[1:] != codes[:-1]
        other[1:] = fresh[1:] | (items[1:] != items[:-1])
        self.codes, self.places = codes[fresh], places[fresh].astype(np.int32)
        items, starts = items[other], np.flatnonzero(fresh[other])
        ends = np.append(starts[1:], len(items))
        with np.errstate(over="ignore"):
            marks = np.add.reduceat(scrambled(items.astype(np.uint64) + MIX), starts) if len(starts) else np.empty(0, np.uint64)
        _, one, lists = np.unique(marks, return_index=True, return_inverse=True)
        self.lists = lists.astype(np.int32)
        self.items = [items[starts[i] : ends[i]].astype(np.int32) for i in one.tolist()]

    def hits(self, words: np.ndarray, hashes: np.ndarray, places: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places whose run is one of these, word by word, and its list."""
        at = _found(self.codes, codes)
        places, at = places[at >= 0], at[at >= 0]
        same = np.ones(len(places), bool)
        for j in range(self.size):
            same &= hashes[places + j] == words[self.places[at] + j]
        return places[same], self.lists[at[same]]


class Index:
    """The words of all items, their fingerprints, and their windows; a short item is one window of its own length."""

    def __init__(self, ids: list, texts: list[str | None], window: int, gram: int):
        self.window, self.gram = window, gram
        self.ids = ["" if i is None else str(i) for i in ids]
        words = Words(translated(pa.array(texts, pa.string()), LOWER_ALNUM))
        self.words = words.hashes()
        sizes, docs = np.diff(words.starts), words.docs()
        first, chosen, every = winnowed(self.words, docs, window, gram)
        self.marks = np.unique(every[chosen])
        self.long = Runs(window, grams(self.words, window)[first], first, docs[first])
        self.short = []
        for size in np.unique(sizes[(sizes > 0) & (sizes < window)]).tolist():
            which = np.flatnonzero(sizes == size)
            at = words.starts[which]
            self.short.append(Runs(size, grams(self.words, size)[at], at, which))

    def matches(self, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[set[int]]]:
        """(whether each word is hit, the items that each text hits) for the words of a block of texts.

        A shared fingerprint extends to the windows that keep it; those that an item has are hits. Work and memory
        follow the words of the block, however often a word or a window repeats.
        """
        docs = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        cover, found = np.zeros(len(hashes) + 1, np.int64), [set() for _ in range(len(starts) - 1)]
        first, chosen, every = winnowed(hashes, docs, self.window, self.gram)
        kept = np.unique(chosen)
        shared = _found(self.marks, every[kept]) >= 0
        near = first[shared[np.searchsorted(kept, chosen)]] if len(kept) else first
        looked = [(self.long, near, grams(hashes, self.window)[near] if len(near) else every[:0])]
        for runs in self.short:
            inside = np.flatnonzero(_valid(docs, runs.size))
            looked.append((runs, inside, grams(hashes, runs.size)[inside]))
        for runs, places, codes in looked:
            places, lists = runs.hits(self.words, hashes, places, codes)
            cover += np.bincount(places, minlength=len(cover)) - np.bincount(places + runs.size, minlength=len(cover))
            for pair in np.unique(docs[places] * max(1, len(runs.items)) + lists).tolist():
                doc, which = divmod(pair, max(1, len(runs.items)))
                found[doc].update(runs.items[which].tolist())
        return np.cumsum(cover[:-1]) > 0, found

    def names(self, items: set[int]) -> list[str]:
        return sorted({self.ids[i] for i in items})


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 6, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items and the sorted ``items`` for each row of docs (doc_id, text).

    ``gram`` is the length of the hashed runs; any shared run of ``window`` words is found whatever it is.
    """
    if not 0 < gram <= window:
        raise ValueError("gram must be between 1 and window")
    items = benchmark.select("item_id", "text")
    if _bytes(items) <= broadcast_bytes:
        return _against_all(docs, items, window, gram)
    return _by_join(docs, items, window, gram)


def _bytes(items: DataFrame) -> int:
    return items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 32)).first()[0] or 0


def _index(items: DataFrame, window: int, gram: int):
    """The items, of checked size, for the executors."""
    rows = items.toArrow()
    return items.sparkSession.sparkContext.broadcast(Index(rows["item_id"].to_pylist(), rows["text"].to_pylist(), window, gram))


def _against_all(docs: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    index = _index(items, window, gram)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            words = Words(translated(block.column("text"), LOWER_ALNUM))
            hit, found = index.value.matches(words.hashes(), words.starts)
            before = np.concatenate(([0], np.cumsum(hit)))
            names = [index.value.names(x) if x else [] for x in found]
            yield pa.record_batch(
                [block.column("doc_id").cast(pa.int64()), pa.array(np.diff(words.starts)), pa.array(np.diff(before[words.starts])), pa.array(map(len, names), pa.int64()), pa.array(names, pa.list_(pa.string()))],
                ["doc_id", "n_words", "n_hit", "n_items", "items"],
            )

    return docs.select("doc_id", "text").mapInArrow(hits, RESULT)


def _by_join(docs: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    """As ``_against_all`` for a benchmark of any size."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "decontam-docs")
    return _hits_of_rows(rows, items, window, gram).drop("row")


def _hits_of_rows(rows: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    """row and the columns of ``_against_all`` for stored rows (row, doc_id, text); texts are compared in pairs that share a fingerprint."""
    short = [r[0] for r in items.mapInArrow(_sizes, "n long").where((F.col("n") > 0) & (F.col("n") < window)).distinct().collect()]

    def marks_of(key: str, whole: bool):
        def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches, "text", BLOCK_BYTES):
                words = Words(translated(block.column("text"), LOWER_ALNUM))
                hashes, where, sizes = words.hashes(), words.docs(), np.diff(words.starts)
                places, codes = fingerprints(hashes, where, window, gram)
                keys, owners = [codes], [where[places]]
                for size in short:
                    inside = np.flatnonzero(_valid(where, size))
                    inside = inside[sizes[where[inside]] == size] if whole else inside
                    with np.errstate(over="ignore"):
                        keys.append(scrambled(grams(hashes, size)[inside] + np.uint64(size)))
                    owners.append(where[inside])
                mark, owner = np.concatenate(keys).view(np.int64), np.concatenate(owners)
                order = np.lexsort((owner, mark))
                mark, owner = mark[order], owner[order]
                first = np.ones(len(mark), bool)
                first[1:] = (mark[1:] != mark[:-1]) | (owner[1:] != owner[:-1])
                yield pa.record_batch([pa.array(mark[first]), block.column(key).take(pa.array(owner[first]))], ["mark", key])

        return marks

    named = items.withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit("")))
    pairs = (
        rows.select("row", "text").mapInArrow(marks_of("row", False), "mark long, row long")
        .join(named.mapInArrow(marks_of("item_id", True), "mark long, item_id string"), "mark")
        .select("row", "item_id").distinct()
    )
    both = pairs.join(rows.select("row", "text"), "row").join(named.select("item_id", F.col("text").alias("item")), "item_id")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, made, index = [], None, None
            for row, name, text, item in zip(*(batch.column(c).to_pylist() for c in ("row", "item_id", "text", "item")), strict=True):
                words = Words(translated(pa.array([text], pa.string()), LOWER_ALNUM))
                if index is None or made != (name, item):  # rows come by item
                    made, index = (name, item), Index([name], [item], window, gram)
                hit, found = index.matches(words.hashes(), words.starts)
                if found[0]:
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                    spans = [{"low": a, "high": b} for a, b in edges.reshape(-1, 2).tolist()]
                    out.append({"row": row, "item_id": name, "spans": spans})
            span = pa.struct([("low", pa.int64()), ("high", pa.int64())])
            yield pa.RecordBatch.from_pylist(out, pa.schema([("row", pa.int64()), ("item_id", pa.string()), ("spans", pa.list_(span))]))

    hits = both.mapInArrow(compared, "row long, item_id string, spans array<struct<low: long, high: long>>")
    # items with the same spans, such as copies, bring them once
    per_row = hits.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"), _covered(F.array_sort(F.flatten(F.collect_set("spans")))).alias("n_hit"))
    sizes = rows.select("row", "doc_id", "text").mapInArrow(_sized, "row long, doc_id long, n_words long")
    return sizes.join(per_row, "row", "left").select(
        "row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def _covered(spans: Column) -> Column:
    """How many places the sorted spans cover."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), x["high"] - F.greatest(a["to"], x["low"]))).alias("n"), F.greatest(a["to"], x["high"]).alias("to"))
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text", BLOCK_BYTES):
        yield pa.record_batch([pa.array(np.diff(Words(translated(block.column("text"), LOWER_ALNUM)).starts))], ["n"])


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text", BLOCK_BYTES):
        sizes = pa.array(np.diff(Words(translated(block.column("text"), LOWER_ALNUM)).starts))
        yield pa.record_batch([block.column("row"), block.column("doc_id").cast(pa.int64()), sizes], ["row", "doc_id", "n_words"])


def digest(names: DataFrame) -> DataFrame:
    """The columns of a report: the items as one digest, and the verdict."""
    return names.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def kept(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 6, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs without a hit, with all their columns; one pass while the benchmark is broadcast, the same rows beyond."""
    items = benchmark.select("item_id", "text")
    if _bytes(items) > broadcast_bytes:
        stored = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("whole")), "decontam-rows")
        rows = stored.select("row", F.col("whole.doc_id").alias("doc_id"), F.col("whole.text").alias("text"))
        bad = _hits_of_rows(rows, items, window, gram).where("n_hit > 0").select("row")
        return stored.join(bad, "row", "left_anti").select("whole.*")
    index = _index(items, window, gram)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            words = Words(translated(block.column("text"), LOWER_ALNUM))
            _, found = index.value.matches(words.hashes(), words.starts)
            yield block.filter(pa.array([not x for x in found]))

    return docs.mapInArrow(clean, docs.schema)


def brute_force(texts: dict, items: dict, window: int = 10) -> dict:
    """The same by comparing every place with every window; for tests."""
    import re

    def words(text: str | None) -> list[str]:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    out = {}
    for key, text in texts.items():
        mine, hit, names = words(text), set(), set()
        for name, item in items.items():
            other = words(item)
            size = min(window, len(other))
            spans = {tuple(other[i : i + size]) for i in range(len(other) - size + 1)} if other else set()
            for i in range(len(mine) - size + 1 if spans else 0):
                if tuple(mine[i : i + size]) in spans:
                    hit |= set(range(i, i + size))
                    names.add(str(name))
        listed = ",".join(sorted(names))
        out[key] = (len(mine), len(hit), len(names), hashlib.sha256(listed.encode()).hexdigest(), bool(hit))
    return out


ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
runs AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
found AS (SELECT doc_id, item_id, i, size FROM runs JOIN windows USING (size, g)),
hits AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM found) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY doc_id)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(names.n, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id)
"""
