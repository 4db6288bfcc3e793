"""Token ids in training order: fixed-length sequences, each at a slot that a keyed permutation gives it.

1. Texts become token ids of a public vocabulary (its path is a parameter). A text is cut before each space,
   where the vocabulary's own pattern cuts too, and each distinct piece of a block is encoded once.
2. Documents are dealt to ``lanes`` by a hash of id and text; a lane is its documents in order of id, each
   closed by the end token, cut into sequences of ``length`` ids. The last of a lane is filled with end tokens.
3. The sequences are numbered lane by lane. A Feistel network over the next power of four, walked until it
   falls below their number, permutes the numbers; the result is the slot. Nothing is kept for it but the key.
4. Partitions hold ranges of slots, sorted, and write one file a shard: its sequences end to end, each closed by a
   newline, so that slot s is at byte (s % per_shard) * stride of shard s // per_shard, whatever was read before.
   A reader that stopped at slot s opens that file, seeks that byte, and reads straight on; nothing before is read.

The number of lanes follows the texts' bytes (one for each ``LANE_BYTES``, at least ``LANES``), so that the largest
task doesn't grow with the corpus; a lane costs half a sequence. Tasks that sort slots follow the bytes too: none has
more than ``TASK_BYTES`` of sequences, or one shard where that is more.

Edge cases: a null or empty text is one end token; a null doc_id sorts first; repeated rows are tokenised
as often as they occur; a very long text is a block alone
and spans as many sequences as it needs; an empty table gives no sequence; other columns are ignored.
"""

from __future__ import annotations

import array
import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm._store import on_disk, temporary, written
from weft.llm._text import MIX, blocks, frugal, scrambled, strings

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WHITE = r"[\s\x0b\x{85}\p{Z}]"
#: A space within or at the end of a run of white space: the pattern may not cut before it.
INSIDE_WHITE = rf"{_WHITE} (?:{_WHITE}|\z)"
#: A piece that is empty or begins with white space.
WHITE_FIRST = rf"^(?:{_WHITE}|\z)"
LENGTH, LANES, LANE_BYTES, PER_SHARD, ROUNDS = 2048, 256, 128 << 20, 8192, 6
BLOCK_BYTES, TASK_BYTES, READ_BYTES = 2 << 20, 256 << 20, 4 << 20
SCHEMA = "slot long, shard long, offset long, lane int, number long, n_tokens int, tokens binary"

_encodings: dict[int, object] = {}
#: One vocabulary a process is in use at a time; ``encoding`` empties this when it makes another.
_pieces: dict[str, bytes] = {}
MOST_PIECES = 200_000


def encoding(ranks: bytes):
    """The vocabulary of a ranks file, made once a process."""
    import tiktoken

    key = hash(ranks)
    if key not in _encodings:
        _pieces.clear()
        _encodings.clear()
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encodings[key] = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encodings[key]


def _cached(piece: str, bpe) -> bytes:
    """The ids of a piece; the pieces met are kept while they are few."""
    known = _pieces.get(piece)
    if known is None:
        known = array.array("I", bpe.encode_ordinary(piece)).tobytes()
        if len(piece) < 32:
            if len(_pieces) >= MOST_PIECES:
                _pieces.clear()
            _pieces[piece] = known
    return known


@functools.lru_cache(maxsize=1)
def _widths(bpe) -> np.ndarray:
    """How many bytes each token stands for."""
    return np.fromiter((len(bpe.decode_single_token_bytes(i)) for i in range(bpe.n_vocab)), np.int64, bpe.n_vocab)


def _together(names: pa.Array, bpe) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes) of pieces that each follow a space and begin with no white space: the pattern cuts before
    each of these spaces, so all are encoded as one text, and the tokens' widths tell where a piece ends."""
    if not len(names):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    spaced = strings(pc.binary_join_element_wise(pa.scalar("", names.type), names, pa.scalar(" ", names.type)))
    lasts = np.cumsum(pc.binary_length(spaced).to_numpy().astype(np.int64))
    ids = np.array(bpe.encode_ordinary(spaced.buffers()[2].to_pybytes()[: lasts[-1]].decode()), np.uint32)
    ends = np.searchsorted(np.cumsum(_widths(bpe)[ids]), lasts) + 1
    return ids, np.diff(ends, prepend=0)


def encode(texts: pa.Array, bpe) -> tuple[np.ndarray, np.ndarray]:
    """(ids, starts): the ids of text i are ids[starts[i]:starts[i + 1]], the same as of encoding it whole."""
    texts = strings(texts)
    odd = pc.match_substring_regex(texts, INSIDE_WHITE)
    lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
    offsets = lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    coded = lists.flatten().dictionary_encode()
    opens = np.zeros(len(coded), np.int64)
    opens[offsets[:-1]] = 1
    codes, where = np.unique(coded.indices.to_numpy().astype(np.int64) * 2 + opens, return_inverse=True)
    names = coded.dictionary.take(pa.array(codes >> 1))
    alone = (codes & 1).astype(bool) | pc.match_substring_regex(names, WHITE_FIRST).to_numpy(zero_copy_only=False)
    sizes = np.empty(len(codes), np.int64)
    flat, sizes[~alone] = _together(names.filter(pa.array(~alone)), bpe)
    found = [_cached(x if c & 1 else " " + x, bpe) for x, c in zip(names.filter(pa.array(alone)).to_pylist(), codes[alone].tolist(), strict=True)]
    sizes[alone] = np.fromiter(map(len, found), np.int64, len(found)) // 4
    flat = np.concatenate((flat, np.frombuffer(b"".join(found), "<u4")))
    order = np.concatenate((np.flatnonzero(~alone), np.flatnonzero(alone)))  # as they lie in flat
    first = np.empty(len(codes), np.int64)
    first[order] = np.cumsum(sizes[order]) - sizes[order]
    each = sizes[where]
    ends = np.cumsum(each)
    ids = flat[np.repeat(first[where] - (ends - each), each) + np.arange(int(each.sum()))]
    starts = np.concatenate(([0], ends))[offsets]
    if pc.any(odd).as_py():
        parts = [ids[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            parts[i] = np.array(bpe.encode_ordinary(texts[int(i)].as_py()), np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        ids = np.concatenate(parts)
    return ids, starts


class Permutation:
    """A keyed permutation of 0 .. size - 1."""

    def __init__(self, size: int, key: int):
        self.size = size
        self.half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        with np.errstate(over="ignore"):
            self.keys = scrambled(np.uint64(key % 2**64) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * MIX)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        with np.errstate(over="ignore"):
            for key in self.keys[::-1] if back else self.keys:
                if back:
                    left, right = right ^ (scrambled(left + key) & self.mask), left
                else:
                    left, right = right, left ^ (scrambled(right + key) & self.mask)
        return left << np.uint64(self.half) | right

    def _walked(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x).astype(np.uint64), back)
        while (beyond := out >= np.uint64(self.size)).any():
            out[beyond] = self._once(out[beyond], back)
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walked(numbers, False)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walked(slots, True)


def lanes_of(docs: DataFrame) -> int:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(LANES, -(-total // LANE_BYTES))


def tokenised(docs: DataFrame, vocabulary: str, lanes: int) -> tuple[DataFrame, int, np.dtype]:
    """lane, doc_id, mark (of the text) and packed ids, end token included; the end token and the ids' type."""
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    end = len(ranks.splitlines())
    dtype = np.dtype("<u2" if end < 2**16 else "<u4")
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, pack = encoding(sent.value), zstandard.ZstdCompressor(level=1).compress
        for block in blocks(batches, "text", BLOCK_BYTES):
            ids, starts = encode(block.column("text"), bpe)
            ids = ids.astype(dtype)
            last = np.array([end], dtype).tobytes()
            packed = [pack(ids[a:b].tobytes() + last) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.record_batch([block.column("doc_id").cast(pa.int64()), block.column("mark"), pa.array(packed, pa.binary())], ["doc_id", "mark", "ids"])

    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(frugal(tokens), "doc_id long, mark long, ids binary")
    return marked.select(F.pmod(F.xxhash64("doc_id", "mark"), F.lit(lanes)).cast("int").alias("lane"), "doc_id", "mark", "ids"), end, dtype


def sequences(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, lanes: int | None = None) -> DataFrame:
    """lane, number within it, n_tokens (without filling) and ``length`` ids of every sequence; materialised."""
    lanes = lanes or lanes_of(docs)
    rows, end, dtype = tokenised(docs, vocabulary, lanes)
    width = length * dtype.itemsize

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        fill = np.array([end], dtype).tobytes()
        lane, number, rest, out = None, 0, b"", []

        def cut(data: bytes, last: bool) -> bytes:
            nonlocal number
            at = 0
            while len(data) - at >= width or last and at < len(data):
                piece = data[at : at + width]
                out.append((lane, number, len(piece) // dtype.itemsize, piece + fill * ((width - len(piece)) // dtype.itemsize)))
                number, at = number + 1, at + width
            return data[at:]

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            out.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["lane", "number", "n_tokens", "tokens"])

        for batch in batches:
            for own, data in zip(batch.column("lane").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if own != lane:
                    cut(rest, True)
                    lane, number, rest = own, 0, b""
                rest = cut(rest + unpack(data), False)
                if len(out) >= 2048:
                    yield flush()
        cut(rest, True)
        yield flush()

    laned = rows.repartition("lane").sortWithinPartitions("lane", "doc_id", "mark").select("lane", "ids")
    made = laned.mapInArrow(frugal(packed), "lane int, number long, n_tokens int, tokens binary")
    return written(made, "tokens-sequences", **{"parquet.compression.codec.zstd.level": "6"})


def _small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of few sequences, so that a worker holds little at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def tasks_of(shards: int, shard_bytes: int, least: int) -> int:
    """How many tasks sort the shards, each a range of them: ``least`` while none gets more than ``TASK_BYTES``, never more than shards."""
    return max(1, min(shards, max(least, -(-shards // max(1, TASK_BYTES // shard_bytes)))))


def ordered(docs: DataFrame, key: int = 0, vocabulary: str = VOCABULARY, length: int = LENGTH, lanes: int | None = None, per_shard: int = PER_SHARD) -> DataFrame:
    """The sequences of docs (doc_id, text) with slot, shard and byte offset, in partitions of slot ranges."""
    lanes = lanes or lanes_of(docs)
    made = sequences(docs, vocabulary, length, lanes)
    counts = made.groupBy("lane").agg(F.count("*").alias("n"))  # at most ``lanes`` rows
    firsts = counts.select("lane", (F.sum("n").over(W.orderBy("lane")) - F.col("n")).alias("first"), F.sum("n").over(W.partitionBy()).alias("total")).collect()
    first = np.zeros(lanes, np.int64)
    for r in firsts:
        first[r["lane"]] = r["first"]
    total = firsts[0]["total"] if firsts else 0
    order = Permutation(total, key)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in _small(batches):
            slot = order.slots(first[batch.column("lane").to_numpy()] + batch.column("number").to_numpy())
            width = len(batch.column("tokens")[0].as_py())
            packed = pa.array(map(pack, batch.column("tokens").to_pylist()), pa.binary())
            yield pa.record_batch([pa.array(slot), pa.array(slot // per_shard), pa.array(slot % per_shard * (width + 1)), *batch.columns[:-1], packed], ["slot", "shard", "offset", *batch.schema.names])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in _small(batches):
            yield pa.record_batch([*batch.columns[:-1], pa.array(map(unpack, batch.column("tokens").to_pylist()), pa.binary())], batch.schema.names)

    shards = -(-total // per_shard)
    # ids take four bytes at most
    parts = tasks_of(shards, per_shard * (4 * length + 1), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = made.mapInArrow(frugal(placed), SCHEMA)
    dealt = rows.repartitionById(parts, (F.col("shard") * parts / max(shards, 1)).cast("int"))
    return dealt.mapInArrow(frugal(unpacked), SCHEMA).sortWithinPartitions("shard", "slot")


def write_shards(rows: DataFrame, path: str) -> None:
    """Files of fixed stride, one for each shard in a folder named by it; rows: of ``ordered``. A failed write can be repeated whole."""
    raw = rows.select("shard", F.col("tokens").cast("string").alias("value"))  # the bytes as they are
    raw.write.mode("overwrite").partitionBy("shard").option("compression", "none").option("lineSep", "\n").text(path)


def shards_from(spark, path: str, slot: int = 0, per_shard: int = PER_SHARD) -> DataFrame:
    """shard and content of the files from the given slot's on; the folders before are not opened."""
    files = spark.read.format("binaryFile").load(path)
    shard = F.col("shard") if "shard" in files.columns else F.lit(None)  # nothing was written
    return files.where(shard >= slot // per_shard).select(shard.cast("long").alias("shard"), "content")


def sequences_from(spark, path: str, slot: int = 0, length: int = LENGTH, width: int = 2, per_shard: int = PER_SHARD) -> DataFrame:
    """slot, shard, offset and tokens from the given slot on, read from the files; within a partition in order, without a shuffle."""
    size = length * width
    files = shards_from(spark, path, slot, per_shard).where(F.length("content") > size)
    number = F.explode(F.sequence(F.lit(0), F.floor(F.length("content") / (size + 1)).cast("int") - 1)).alias("number")
    each = files.select("shard", "content", number).withColumn("offset", F.col("number").cast("long") * (size + 1))
    found = each.select(
        (F.col("shard") * per_shard + F.col("number")).alias("slot"),
        "shard",
        "offset",
        F.substring("content", (F.col("offset") + 1).cast("int"), size).alias("tokens"),
    )
    return found.where(F.col("slot") >= slot) if slot % per_shard else found


def read_from(spark, path: str, slot: int, length: int = LENGTH, dtype: str = "<u2", per_shard: int = PER_SHARD) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) from the given slot on: what a trainer calls to go on where it stopped.

    It opens the slot's file, seeks its byte, and reads on, ``READ_BYTES`` at a time, shard after shard.
    """
    size = length * np.dtype(dtype).itemsize
    read = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray
    shard, at = divmod(slot, per_shard)
    while True:
        files, folder = on_disk(spark, f"{path}/shard={shard}")
        if not files.exists(folder):
            return
        (file,) = (f for f in files.listStatus(folder) if f.getPath().getName().startswith("part-"))
        stream, n = files.open(file.getPath()), file.getLen() // (size + 1)
        try:
            stream.seek(min(at, n) * (size + 1))
            while at < n:
                some = min(n - at, max(1, READ_BYTES // (size + 1)))
                content = read(stream, some * (size + 1))
                for i in range(some):
                    yield shard * per_shard + at + i, np.frombuffer(content, dtype, length, i * (size + 1))
                at += some
        finally:
            stream.close()
        shard, at = shard + 1, 0


def materialised(docs: DataFrame, key: int = 0, vocabulary: str = VOCABULARY, length: int = LENGTH, lanes: int | None = None, per_shard: int = PER_SHARD, path: str | None = None) -> DataFrame:
    """Writes the shards of docs (doc_id, text), below the shared folder if no path is given, and reads them: slot, shard, offset, tokens."""
    spark = docs.sparkSession
    rows = ordered(docs, key, vocabulary, length, lanes, per_shard)
    path = path or temporary(spark, "shards")
    write_shards(rows, path)
    with open(vocabulary, "rb") as f:
        width = 2 if len(f.read().splitlines()) < 2**16 else 4
    return sequences_from(spark, path, 0, length, width, per_shard)
