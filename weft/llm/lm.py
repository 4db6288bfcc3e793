"""Language-model scores by prediction by partial matching (PPM) over bytes.

A text is its lower-cased words, each closed by a space, then one end symbol. A symbol's context is the ``order``
bytes before it, whatever words they belong to; before a text stand end symbols. Counts of the training texts make
the trie. A symbol is coded in the longest context that has it; escapes are of method D (each of a context's q
distinct symbols gives half a count to the escape), and symbols of the contexts escaped from are excluded from the
shorter ones.

1. Blocks of texts become word numbers, the block's vocabulary, and the block's distinct places (a place is a context
   of full order and a symbol: all that a price depends on) with their counts in training texts; written to the
   shared folder. A block holds far fewer distinct places than bytes.
2. Places are dealt over buckets by the last two bytes of the context: all contexts that a place falls back to end
   in the same bytes. Counts of a bucket are summed as a stream, ``FAN`` blocks at a time, into the trie's table.
   Contexts of order 0 and 1 (at most 257 * 257 pairs) go to every bucket. No pair is left out, at any size.
3. A bucket's trie prices the places of the blocks, as a stream again; a bucket is dealt to as many tasks as its blocks
   ask for times ``LOAD`` packed bytes of places, with its trie copied to each: a cold bucket's trie is not copied, and hot
   contexts are priced by many tasks.
4. Prices and word counts return to the blocks, which are spelt again and summed by text.

Edge cases: a null or empty text is one end token; a null doc_id is the empty text for the fold and is
kept; repeated rows give repeated rows; without training texts every symbol has probability 1/257; other
columns are ignored; a very long text is a block alone, spelt ``CHUNK`` symbols at a time.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._store import written
from weft.llm._text import LOWER_SPACE, MIX, Words, blocks, strings, translated

BLOCK_BYTES = 16 << 20
ORDER = 5
#: A context's key holds its bytes, the last lowest, and above them its order; with a symbol it is 60 bits.
ORDER_AT = 48
BUCKETS, FAN, CHUNK = 256, 64, 4 << 20
#: Packed bytes of places that a task prices: about 10 million places.
LOAD = 16 << 20
SYMBOLS = 257
#: The end symbol; as a byte of a context it is one that no text has left.
END, END_BYTE = 256, 0x0A
FOLDS, HELD_OUT = 5, 1


def fold(doc_ids: pa.Array) -> np.ndarray:
    """crc32 of the id as text, by FOLDS."""
    return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS for i in doc_ids.to_pylist()), np.int64, len(doc_ids))


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers or floats, their bytes of one rank together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()) if len(values) else b""


def _unpacked(data: bytes, dtype: type) -> np.ndarray:
    if not data:
        return np.empty(0, dtype)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


class Spelt:
    """The symbols of a block's texts, each text after ``order`` end symbols that only serve as contexts."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, vocabulary: pa.Array, order: int):
        """ids: of the texts' words; sizes: words of each text; vocabulary: without the end."""
        self.order = order
        closed = strings(pc.binary_join_element_wise(pa.concat_arrays([strings(vocabulary), pa.array([""], pa.large_string())]), *(pa.scalar(x, pa.large_string()) for x in (" ", ""))))
        _, offsets, data = closed.buffers()
        # the last spelling, a space alone, is no word's: it gives way to what stands before and after a text
        first = np.frombuffer(offsets, np.int64)[: len(closed) + 1]
        letters = np.concatenate((np.frombuffer(data, np.uint8)[: first[-2]], np.full(order + 1, END_BYTE, np.uint8)))
        words, n, ends = len(vocabulary), len(sizes), np.cumsum(sizes)
        lengths, first = np.append(np.diff(first[:-1]), (order, 1)), np.append(first[:-1], first[-2] + order)
        at = np.arange(n)
        tokens = np.empty(len(ids) + 2 * n, np.int32)
        edge = np.zeros(len(tokens), bool)
        edge[ends - sizes + 2 * at] = edge[ends + 2 * at + 1] = True
        tokens[~edge] = ids
        tokens[ends - sizes + 2 * at], tokens[ends + 2 * at + 1] = words, words + 1
        each = lengths[tokens]
        over = np.cumsum(each)
        total = int(over[-1]) if n else 0
        kind = np.int32 if max(total, len(letters)) < 2**31 else np.int64
        self.symbols = letters[np.repeat((first[tokens] - (over - each)).astype(kind), each) + np.arange(total, dtype=kind)]
        self.starts = over[ends - sizes + 2 * at]  # of each text's symbols, after its end symbols
        self.stops = over[ends + 2 * at + 1]

    def chunks(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(from, to, the place of each symbol between)."""
        for low in range(0, len(self.symbols), CHUNK):
            high = min(low + CHUNK, len(self.symbols))
            keys = np.full(high - low, self.order << ORDER_AT, np.int64)
            for j in range(1, self.order + 1):
                skip = max(j - low, 0)
                keys[skip:] |= self.symbols[low + skip - j : high - j].astype(np.int64) << 8 * (j - 1)
            own = self.symbols[low:high].astype(np.int64)
            own[own == END_BYTE] = END
            yield low, high, keys << 9 | own

    def marked(self, of_texts: np.ndarray) -> np.ndarray:
        """For each symbol whether its text has the mark; the end symbols before a text have none."""
        out = np.zeros(len(self.symbols) + 1, np.int8)
        np.add.at(out, self.starts[of_texts], 1)
        np.add.at(out, self.stops[of_texts], -1)
        return np.cumsum(out[:-1], dtype=np.int8)


def _summed(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order, with the sums of their counts."""
    by = np.argsort(pairs, kind="stable")
    pairs = pairs[by]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(pairs), 1), bool), pairs[1:] != pairs[:-1])))
    return pairs[first], np.add.reduceat(n[by], first) if len(first) else n


def _bucket(contexts: np.ndarray) -> np.ndarray:
    """By the last two bytes of the context: an odd factor spreads them, the high bits count."""
    return ((contexts & 0xFFFF) * 40503 & 0xFFFF) * BUCKETS >> 16


def _distinct(spelt: Spelt, training: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block's distinct places by bucket and in order, their counts in training texts, and the buckets' ends."""
    marks, parts = spelt.marked(training), [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for low, high, places in spelt.chunks():
        places = places << 1 | marks[low:high]
        places.sort()
        own = places >> 1
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        parts.append((own[first], np.add.reduceat(places & 1, first)))
    places, n = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    bucket = _bucket(places >> 9)
    by = np.argsort(bucket, kind="stable")
    return places[by], n[by], np.searchsorted(bucket[by], np.arange(BUCKETS + 1))


class Lookup:
    """Where keys stand among distinct keys that hold them all: a table by hash, a search for those that share a slot."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - min(26, len(keys).bit_length() + 4))
        self.table = np.zeros(1 << int(64 - self.shift), np.int32)
        self.table[self._slots(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view(np.uint64) * MIX >> self.shift).astype(np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.table[self._slots(keys)]
        other = np.flatnonzero(self.keys[at] != keys)
        at[other] = np.searchsorted(self.keys, keys[other])
        return at


ENCODED = "block long, doc_ids array<long>, sizes array<long>, ids binary, words array<string>, counts array<long>, asked array<struct<bucket:int,size:int,places:binary,n:binary>>"


def _encoded(order: int):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each block: its texts as word numbers, its vocabulary with each word's count in training texts, its places."""
        part, block_number = TaskContext.get().partitionId(), 0
        asked = pa.struct([("bucket", pa.int32()), ("size", pa.int32()), ("places", pa.binary()), ("n", pa.binary())])
        for block in blocks(batches, "text", BLOCK_BYTES):
            words = Words(translated(block.column("text"), LOWER_SPACE))
            training = fold(block.column("doc_id")) != HELD_OUT
            sizes = np.diff(words.starts)
            counts = np.bincount(words.ids[np.repeat(training, sizes)], minlength=len(words.vocabulary))
            places, n, ends = _distinct(Spelt(words.ids, sizes, words.vocabulary, order), training)
            full = np.flatnonzero(np.diff(ends)).tolist()
            own = [(_packed(np.diff(places[ends[b] : ends[b + 1]], prepend=0)), _packed(n[ends[b] : ends[b + 1]])) for b in full]
            found = [{"bucket": b, "size": len(p), "places": p, "n": k} for b, (p, k) in zip(full, own, strict=True)]
            yield pa.record_batch(
                [
                    pa.array([part << 20 | block_number]),
                    pa.array([block.column("doc_id").cast(pa.int64())], pa.list_(pa.int64())),
                    pa.array([sizes], pa.list_(pa.int64())),
                    pa.array([_packed(words.ids.astype(np.int32))], pa.binary()),
                    pa.array([[*words.vocabulary.to_pylist(), ""]], pa.list_(pa.string())),
                    pa.array([np.append(counts, training.sum())], pa.list_(pa.int64())),
                    pa.array([found], pa.list_(asked)),
                ],
                ["block", "doc_ids", "sizes", "ids", "words", "counts", "asked"],
            )
            block_number += 1

    return encoded


class Trie:
    """Sorted contexts and (context, symbol) pairs, with what coding needs of each."""

    def __init__(self, pairs: np.ndarray, n: np.ndarray, order: int):
        self.order = order
        by = np.argsort(pairs)
        self.pairs, self.n = pairs[by], n[by].astype(np.float64)
        owner = self.pairs >> 9
        self.contexts, first, self.q = np.unique(owner, return_index=True, return_counts=True)
        self.total = np.add.reduceat(self.n, first) if len(first) else np.empty(0)
        # what is left of the next shorter context once this one's symbols are excluded
        shorter = self._shorter(owner)
        at, there = self._find(self.pairs, shorter << 9 | (self.pairs & 511))
        lost = np.where(there & (owner >> ORDER_AT > 0), self.n[at] if len(at) else 0.0, 0.0)
        parent, known = self._find(self.contexts, self._shorter(self.contexts))
        excluded = np.add.reduceat(lost, first) if len(first) else np.empty(0)
        self.left = np.where(known, self.total[parent] if len(parent) else 0.0, 0.0) - excluded
        self.left_q = np.where(known, self.q[parent] if len(parent) else 0, 0) - self.q

    @staticmethod
    def _shorter(contexts: np.ndarray) -> np.ndarray:
        """The context without its first byte."""
        order = contexts >> ORDER_AT
        less = np.maximum(order - 1, 0)
        return contexts & ((np.int64(1) << 8 * less) - 1) | less << ORDER_AT

    @staticmethod
    def _find(index: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(index, keys), max(len(index) - 1, 0))
        return at, index[at] == keys if len(index) else np.zeros(len(keys), bool)

    def priced(self, places: np.ndarray) -> np.ndarray:
        """The log10 probability of each place's symbol after its context."""
        held, symbols, size = places >> 9, places & 511, len(places)
        out, before = np.zeros(size), np.full(size, -1, np.int64)  # before: the context escaped from
        todo = np.arange(size)
        for j in range(self.order, -1, -1):
            key = held[todo] & ((np.int64(1) << 8 * j) - 1) | np.int64(j) << ORDER_AT
            node, there = self._find(self.contexts, key)
            some, node, key = todo[there], node[there], key[there]
            if not len(some):
                continue
            last = before[some]
            total = np.where(last >= 0, self.left[last], self.total[node])
            kinds = np.where(last >= 0, self.left_q[last], self.q[node])
            pair, coded = self._find(self.pairs, key << 9 | symbols[some])
            with np.errstate(divide="ignore", invalid="ignore"):
                chance = np.where(coded, self.n[pair] - 0.5, 0.5 * kinds) / total
            out[some] += np.log10(np.where(kinds > 0, chance, 1.0))
            before[some] = node
            done = np.zeros(size, bool)
            done[some[coded]] = True
            todo = todo[~done[todo]]
        last = before[todo]
        out[todo] -= np.log10(SYMBOLS - np.where(last >= 0, self.q[last] if len(self.q) else 0, 0))
        return out


class Priced:
    """A trie's prices, worked out once for each distinct place that the blocks of a task ask for."""

    def __init__(self, trie: Trie):
        self.trie, self.places, self.prices = trie, np.empty(0, np.int64), np.empty(0, np.float32)

    def __call__(self, places: np.ndarray) -> np.ndarray:
        """places: in order and distinct."""
        at, known = Trie._find(self.places, places)
        if not known.all():
            new = places[~known]
            where = np.searchsorted(self.places, new)
            self.places = np.insert(self.places, where, new)
            self.prices = np.insert(self.prices, where, self.trie.priced(new).astype(np.float32))
            at = np.searchsorted(self.places, places)
        return self.prices[at]


def _levels(places: np.ndarray, n: np.ndarray, orders: range) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of the contexts of the given orders, longest first, and their counts."""
    pairs, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for j in orders:
        contexts = places >> 9 & ((np.int64(1) << 8 * j) - 1) | np.int64(j) << ORDER_AT
        places, n = _summed(contexts << 9 | places & 511, n)
        pairs.append(places)
        counts.append(n)
    return np.concatenate(pairs), np.concatenate(counts)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, part, places, n) rows in order of bucket and part: one row for each, its counts summed; counts of 0 go."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    own = None

    def row() -> pa.RecordBatch:
        places, n = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        return pa.record_batch([pa.array([own[0]], pa.int32()), pa.array([own[1]], pa.int64()), pa.array([_packed(np.diff(places, prepend=0))], pa.binary()), pa.array([_packed(n)], pa.binary())], ["bucket", "part", "places", "n"])

    for batch in batches:
        for bucket, part, places, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "part", "places", "n")), strict=True):
            if own != (bucket, part):
                if held:
                    yield row()
                own = (bucket, part)
            places, n = np.cumsum(_unpacked(places, np.int64)), _unpacked(n, np.int64)
            held.append((places[n > 0], n[n > 0]))
            if len(held) > 1 and sum(len(x) for x, _ in held[1:]) > max(1 << 20, len(held[0][0])):
                held[:] = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
    if held:
        yield row()


def trie_table(encoded: DataFrame, blocks_: int) -> DataFrame:
    """(bucket, places, n): the places of full order that training texts have, and their counts."""
    parts = -(-blocks_ // FAN)
    rows = encoded.select((F.pmod(F.xxhash64("block"), F.lit(max(parts, 1)))).alias("part"), F.inline("asked"))
    while True:
        dealt = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part").select("bucket", "part", "places", "n")
        merged = dealt.mapInArrow(_merged, "bucket int, part long, places binary, n binary")
        if parts <= 1:
            return written(merged.select("bucket", "places", "n"), "lm-trie")
        parts = -(-parts // FAN)
        rows = merged.withColumn("part", F.pmod("part", F.lit(parts)))


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of order 0 and 1 of each bucket."""
    for batch in batches:
        for places, n in zip(batch.column("places").to_pylist(), batch.column("n").to_pylist(), strict=True):
            pairs, n = _levels(np.cumsum(_unpacked(places, np.int64)), _unpacked(n, np.int64), range(1, -1, -1))
            yield pa.record_batch([pa.array(pairs), pa.array(n)], ["pair", "n"])


def loads(encoded: DataFrame) -> DataFrame:
    """(bucket, tasks): how many tasks price the places that the blocks ask of the bucket."""
    sizes = encoded.select(F.explode(F.map_from_arrays("asked.bucket", "asked.size")).alias("bucket", "size"))  # reads no places
    return sizes.groupBy("bucket").agg(F.ceil(F.sum("size") / LOAD).cast("long").alias("tasks"))


def copied(trie: DataFrame, tasks: DataFrame) -> DataFrame:
    """A bucket's trie for each of its tasks, as ``part``; a trie that no block asks for goes."""
    return trie.join(tasks, "bucket").select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("part"), "places", "n")


def prices(encoded: DataFrame, order: int = ORDER) -> DataFrame:
    """(block, bucket, prices): the log10 probabilities of the block's places of the bucket, in their order."""
    spark = encoded.sparkSession
    trie = trie_table(encoded, encoded.count())
    top = trie.mapInArrow(_short, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # 257 * 258 rows at most
    short = spark.sparkContext.broadcast([top.column(c).to_numpy() for c in ("pair", "n")])
    tasks = F.broadcast(loads(encoded))  # a row a bucket
    part = F.pmod(F.xxhash64("block"), "tasks").alias("part")
    asked = encoded.select("block", F.inline("asked")).join(tasks, "bucket").select("bucket", part, "block", "places", F.lit(None).cast("binary").alias("n"))
    copies = copied(trie, tasks).select("bucket", "part", F.lit(-1).cast("long").alias("block"), "places", "n")

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, None
        for batch in batches:
            out = []
            for bucket, part, block, places, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "part", "block", "places", "n")), strict=True):
                places = np.cumsum(_unpacked(places, np.int64))
                if own != (bucket, part):
                    own = (bucket, part)
                    pairs, counts = _levels(places, _unpacked(n, np.int64), range(order, 1, -1)) if block < 0 else (np.empty(0, np.int64), np.empty(0, np.int64))
                    held = Priced(Trie(np.concatenate((short.value[0], pairs)), np.concatenate((short.value[1], counts)), order))
                if block >= 0:
                    out.append((block, bucket, _packed(held(places))))
            columns = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["block", "bucket", "prices"])

    dealt = copies.union(asked).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "block")
    return dealt.mapInArrow(answered, "block long, bucket int, prices binary")


def _text_sums(spelt: Spelt, places: np.ndarray, price: np.ndarray) -> np.ndarray:
    """The sum of the prices of each text's symbols; places in any order, the end symbols before texts left out."""
    by = np.argsort(places)
    find, price = Lookup(places[by]), price[by].astype(np.float64)
    out = np.zeros(len(spelt.starts))
    for low, high, own in spelt.chunks():
        ran = np.concatenate(([0.0], np.cumsum(price[find(own)])))
        first, last = np.searchsorted(spelt.stops, low, "right"), np.searchsorted(spelt.starts, high, "left")
        a, b = (np.clip(x[first:last] - low, 0, high - low) for x in (spelt.starts, spelt.stops))
        out[first:last] += ran[b] - ran[a]
    return out


def scored(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """For each row of docs (doc_id, text): fold, counts, the unigram base and the model's log10 probability.

    bits is the code length of the text in bits.
    """
    if not 2 <= order <= ORDER_AT // 8:
        raise ValueError(f"order must be between 2 and {ORDER_AT // 8}")
    encoded = written(docs.select("doc_id", "text").mapInArrow(_encoded(order), ENCODED), "lm-blocks", maxRecordsPerFile="8")
    uses = encoded.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "x")).select("block", "pos", F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    words = written(uses.groupBy("word").agg(F.sum("c").alias("c")), "lm-words")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    below = n + 0.5 * (v + 1)
    known = uses.select("block", "pos", "word").join(words, "word").select("block", "pos", "c", F.lit(None).cast("binary").alias("prices"))
    facts = known.union(prices(encoded, order).select("block", F.col("bucket").alias("pos"), F.lit(None).cast("long").alias("c"), "prices"))

    def summed(block: pa.Table, facts: pa.Table) -> pa.Table:
        if not block.num_rows:
            return out_schema.empty_table()
        row = {c: block.column(c)[0] for c in ("doc_ids", "sizes", "ids", "words", "asked")}
        vocabulary = row["words"].values
        priced = facts.filter(facts.column("prices").is_valid())
        counted = facts.filter(facts.column("c").is_valid())
        count = np.zeros(len(vocabulary), np.int64)
        count[counted.column("pos").to_numpy()] = counted.column("c").to_numpy()
        ids, sizes = _unpacked(row["ids"].as_py(), np.int32), row["sizes"].values.to_numpy()
        ends = np.concatenate(([0], np.cumsum(sizes)))
        base = np.log10((count + 0.5) / below)

        def sums(x: np.ndarray) -> np.ndarray:
            """Over each text's words and its end, which is the last of the vocabulary."""
            each = np.add.reduceat(np.append(x[ids], x.dtype.type(0)), ends[:-1])
            return np.where(sizes > 0, each, 0) + x[-1]

        spelt = Spelt(ids, sizes, vocabulary.slice(0, len(vocabulary) - 1), order)
        asked = row["asked"].values
        places = np.concatenate([np.cumsum(_unpacked(x, np.int64)) for x in asked.field("places").to_pylist()])
        found = dict(zip(priced.column("pos").to_pylist(), priced.column("prices").to_pylist(), strict=True))
        each = np.concatenate([_unpacked(found[b], np.float32) for b in asked.field("bucket").to_pylist()])
        score = _text_sums(spelt, places, each)
        known, first = sums((count > 0).astype(np.int64)), sums(base)
        held = fold(row["doc_ids"].values) == HELD_OUT
        return pa.table(
            [row["doc_ids"].values, pa.array(held), pa.array(sizes + 1), pa.array(known), pa.array(np.full(len(sizes), n, np.int64)), pa.array(first), pa.array(score), pa.array(score * -math.log2(10))],
            schema=out_schema,
        )

    out_schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits", pa.float64())])
    left = encoded.select(F.col("block").alias("owner"), "doc_ids", "sizes", "ids", "words", F.transform("asked", lambda x: F.struct(x["bucket"].alias("bucket"), x["places"].alias("places"))).alias("asked")).groupBy("owner")
    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits double"
    return left.cogroup(facts.groupBy("block")).applyInArrow(summed, result)


#: The columns that don't need the model; crc32 is worked out bit by bit.
BASE_SQL = r"""
WITH d AS (SELECT doc_id, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '') AS w,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda b, z: xor(b >> 1, CASE WHEN b & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 5 = 1 AS held_out FROM documents),
each AS (SELECT doc_id, held_out, unnest(w) AS t FROM d),
c AS (SELECT t, count(*) AS c FROM each WHERE NOT held_out GROUP BY t),
n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c.c) AS n_known, CAST(any_value(n.n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 0.5) / (n.n + 0.5 * (n.v + 1)))), 3) AS base_score
FROM each LEFT JOIN c USING (t), n GROUP BY doc_id
"""
