"""Fill-in-the-middle: texts cut at two places into prefix, middle and suffix, and put together in another order.

A text's units are counted once, front to back, in pieces of bounded bytes; every ``STEP`` units the byte and the
code-point offset are noted. A cut after u units is found by binary search in these checkpoints and a rescan from
the nearest one before, of at most ``STEP`` units; the text is then cut by bytes. Nothing is kept for each unit,
however long the text is.

What is drawn depends on the seed and the id alone: the first four 8-digit groups of the SHA-256 of "seed:id" say
where the two cuts are, whether the text is transformed at all, and into which form.

Edge cases: null and empty texts have no units and stay plain; a null doc_id counts as an empty id; texts that hold a
sentinel stay plain, so that ``restored`` gives any text back; very long texts cost one checkpoint each ``STEP``
units; both cuts may be equal or at an end, which leaves parts empty; repeated rows give repeated results; an empty table
gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm._text import blocks, frugal, strings

SEED = 42
#: Of a hundred texts so many are transformed, and of a hundred of these so many get the suffix first.
RATE, SUFFIX_FIRST = 50, 80
#: Before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
STEP = 256
SCAN_BYTES = 1 << 20
BLOCK_BYTES = 4 << 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def token_ends(data: np.ndarray, last: bool) -> np.ndarray:
    """Where tokens end: white space belongs to the word after it, and at the end of the text is a token of its own.

    data begins with a token; if it isn't the text's last piece, a word at its end isn't over for sure.
    """
    white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    ends = np.flatnonzero(white[1:] & ~white[:-1]) + 1
    return np.append(ends, len(data)) if last and len(data) else ends


def point_ends(data: np.ndarray, last: bool) -> np.ndarray:
    """Where code points end."""
    ends = np.flatnonzero((data[1:] & 0xC0) != 0x80) + 1
    return np.append(ends, len(data)) if last and len(data) else ends


UNITS: dict[str, Callable[[np.ndarray, bool], np.ndarray]] = {"tokens": token_ends, "chars": point_ends}


def _points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


class Checkpoints:
    """The units of a text, counted, with the offsets of every ``step``-th boundary between them."""

    def __init__(self, data: bytes, ends: Callable[[np.ndarray, bool], np.ndarray] = token_ends, step: int = STEP, scan: int = SCAN_BYTES):
        self.data, self.ends = np.frombuffer(data, np.uint8), ends
        units, byte, points = [0], [0], [0]
        at = count = 0  # the boundary that the scan goes on from, and the units before it
        width = scan
        while at < len(self.data):
            last = at + width >= len(self.data)
            found = ends(self.data[at : at + width], last)
            if not len(found):
                width *= 2  # a unit longer than the piece
                continue
            width = scan
            for end in found[step - 1 - count % step :: step].tolist():
                points.append(points[-1] + _points(self.data[byte[-1] : at + end]))
                byte.append(at + end)
                units.append(units[-1] + step)
            count += len(found)
            at += int(found[-1])
        self.count = count
        self.units, self.byte, self.points = (np.array(x, np.int64) for x in (units, byte, points))

    def cut(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset after so many units."""
        near = int(np.searchsorted(self.units, unit, "right")) - 1
        start, more = int(self.byte[near]), unit - int(self.units[near])
        if not more:
            return start, int(self.points[near])
        last = near + 1 == len(self.byte)
        piece = self.data[start:] if last else self.data[start : int(self.byte[near + 1])]
        end = int(self.ends(piece, True)[more - 1])
        return start + end, int(self.points[near]) + _points(piece[:end])


def drawn(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers below 2 ** 32."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def transformed(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, units: str = "tokens", sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars and the output text of each row of docs (doc_id, text)."""
    ends, (prefix, suffix, middle) = UNITS[units], (s.encode() for s in sentinels)

    def put(doc_id: int | None, data: bytes) -> tuple:
        text = Checkpoints(data, ends)
        h1, h2, h3, h4 = drawn(seed, doc_id)
        if not data or h3 % 100 >= rate or any(s in data for s in (prefix, suffix, middle)):
            return doc_id, text.count, "plain", None, None, data
        low, high = sorted((h1 % (text.count + 1), h2 % (text.count + 1)))
        (a, before), (b, upto) = text.cut(low), text.cut(high)
        if h4 % 100 < suffix_first:
            form, parts = "spm", (suffix, data[b:], prefix, data[:a], middle, data[a:b])
        else:
            form, parts = "psm", (prefix, data[:a], suffix, data[b:], middle, data[a:b])
        return doc_id, text.count, form, before, upto - before, b"".join(parts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            texts = strings(block.column("text")).cast(pa.large_binary()).to_pylist()
            rows = [put(i, x) for i, x in zip(block.column("doc_id").to_pylist(), texts, strict=True)]
            *facts, outputs = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(facts, kinds, strict=True)]
            yield pa.record_batch([*columns, pa.array(outputs, pa.binary()).view(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(work), SCHEMA)


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that an output was made of: the three parts stand between sentinels, which no transformed text holds."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels), -1)
    one, two, three = (F.get(parts, i) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)


def digest(rows: DataFrame) -> DataFrame:
    """The outputs of ``transformed`` as digests, with that of the text restored from each."""
    back = restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


#: Cuts by a list of all tokens, which no checkpoint takes part in.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, len(w) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT *, array_to_string(w[1:lo], '') AS p, array_to_string(w[lo + 1:hi], '') AS m, array_to_string(w[hi + 1:n], '') AS s FROM f),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o
"""
