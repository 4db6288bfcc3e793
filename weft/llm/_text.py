"""Vectorised text helpers shared by the operators that run in Arrow batches.

Whole value buffers are translated and split at once, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_UPPER = range(0x41, 0x5B)
#: A-Z lowered, the six ASCII white-space characters made a space.
LOWER_SPACE = bytes(0x20 if b in b"\t\n\x0b\x0c\r" else b + 32 if b in _UPPER else b for b in range(256))
#: A-Z lowered, everything in ASCII but letters and digits made a space.
LOWER_ALNUM = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if b in _UPPER else 0x20 for b in range(256))

MIX = np.uint64(0x9E3779B97F4A7C15)


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls and without an offset into a larger buffer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return pa.concat_arrays([column]) if column.offset else column


def translated(column: pa.Array, table: bytes) -> pa.Array:
    """The strings with every byte mapped; the table may only map ASCII to ASCII."""
    column = strings(column)
    if not len(column):
        return column
    _, offsets, data = column.buffers()
    changed = data.to_pybytes().translate(table) if data is not None else b""
    return pa.LargeStringArray.from_buffers(len(column), offsets, pa.py_buffer(changed))


class Words:
    """Words of a block of texts: ``ids`` into ``vocabulary`` and, per text, ``starts[i]:starts[i + 1]``."""

    def __init__(self, texts: pa.Array):
        """texts: separated by spaces already (see ``translated``)."""
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy()
        flat = lists.flatten()
        real = pc.not_equal(flat, "")
        before = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False), dtype=np.int64)))
        self.starts = before[offsets - offsets[0]]
        coded = flat.filter(real).dictionary_encode()
        self.vocabulary = coded.dictionary
        self.ids = coded.indices.to_numpy()

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same in every block."""
        of = xxhash.xxh64_intdigest
        each = np.fromiter(map(of, self.vocabulary.to_pylist()), np.uint64, len(self.vocabulary))
        return each[self.ids]

    def docs(self) -> np.ndarray:
        """The position of its text for each word."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix, so that any bits of the result may be used alone."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; the last k - 1 places have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * MIX + hashes[j : j + n]
    return scrambled(out)


def frugal(work):
    """The batch function, giving unused Arrow memory back where a partition ends: Spark keeps idle workers alive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()

    return run


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each hold about ``limit`` bytes; a longer text is a block alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start] - sizes[start]
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
