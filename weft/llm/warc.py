"""Web archives: pages as WARC/1.1 records, and records read back into pages from their segments.

Writing: pages with the same payload are found by its digest; the one with the greatest page_id is a response record,
the others are revisit records that refer to it. A response's block is an HTTP message in chunked transfer framing. Blocks
above ``segment`` bytes are cut: the first segment is the response record, the others are continuation records that
name their origin and number, the last with the total length. Each task writes archives of its own, gzipped,
of at most ``ARCHIVE_RECORDS`` records.

Reading: an archive is one stream in one task (gzip can't be entered in the middle), cut by Spark at blank lines and
parsed by the lengths that records state, so nothing but one record is held and no content is taken for a header. Segments
are grouped by their origin, wherever they were written, put in order of number, their lengths held against the total, and
the chunked framing is undone. Records in one piece aren't shuffled.

Skew: hot payloads are counted before they meet (equal pages are one row, and a payload is moved once); revisits meet what they
refer to by salted keys.

Edge cases: a null html is an empty payload, which is a payload like any other; a null page_id comes first and a null url is
written as none; repeated rows are records each, of which one is the response; payloads may hold anything, blank lines and
whole WARC records too; an empty table gives archives without records; other columns are ignored. A segment that is missing,
contradicts another of its number, or doesn't give the total length, a broken framing and a digest that doesn't fit leave
the payload null and say so in ``problem``; a record that can't be read ends its archive with a row that says so.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm._store import temporary, written
from weft.llm._text import blocks, frugal

SEGMENT, CHUNK, ARCHIVE_RECORDS = 32 << 10, 8 << 10, 20_000
#: Bytes that a task's batch of records to be framed, or of framed ones, holds at most beside one record.
BATCH_BYTES = 8 << 20
SALTS = 16
#: Records end with a blank line, as their headers do.
BLANK = b"\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

#: A row of ``parsed``. block: of segments; payload_bytes and payload_digest: of responses in one piece.
RECORD = "record_id string, type string, origin_id string, segment int, total long, page_id long, url string, refers_id string, digest string, block binary, payload binary, payload_bytes long, payload_digest string, problem string"
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_SCHEMA = pa.schema([(c, _TYPES[k]) for c, k in (x.split() for x in RECORD.split(", "))])


def base32(sha1_hex: Column) -> Column:
    """The 40 hex digits of a SHA-1 in upper-case base 32: ten digits at a time are eight of these."""
    parts = [F.lpad(F.conv(F.substring(sha1_hex, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def uuid(*parts: Column) -> Column:
    """A record id that depends on the parts alone."""
    text = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]
    return F.regexp_replace(F.sha1(F.concat_ws("\n", *text)), r"^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "<urn:uuid:$1-$2-$3-$4-$5>")


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    out = []
    for i in range(0, len(payload), size):
        piece = payload[i : i + size]
        out += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join((*out, b"0\r\n\r\n"))


def unchunked(data: bytes, at: int = 0) -> bytes | None:
    """The payload of chunked framing that begins at a byte; None where it is broken. Extensions and trailers are passed over."""
    out = []
    while True:
        end = data.find(b"\r\n", at, at + 1024)
        size = data[at:end].partition(b";")[0].strip()
        if end < 0 or not size or size.strip(b"0123456789abcdefABCDEF"):
            return None
        n = int(size, 16)
        if not n:
            return b"".join(out)
        at = end + 2
        if data[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(data[at : at + n])
        at += n + 2


def message_payload(message: bytes) -> bytes | None:
    """The body of an HTTP message, without its framing; None if it isn't whole."""
    end = message.find(BLANK)
    if end < 0 or not message.startswith(b"HTTP/"):
        return None
    head = dict(_fields(message[:end].split(b"\r\n")[1:]))
    if "chunked" in head.get("transfer-encoding", "").lower():
        return unchunked(message, end + 4)
    body = message[end + 4 :]
    length = head.get("content-length")
    return body if length is None or length == str(len(body)) else None


def _fields(lines: list[bytes]) -> Iterator[tuple[str, str]]:
    for line in lines:
        name, _, value = line.partition(b":")
        yield name.decode("utf-8", "replace").strip().lower(), value.decode("utf-8", "replace").strip()


def records(row: dict, segment: int, chunk: int) -> Iterator[bytes]:
    """The record of a page, or its segments, each without the blank line that ends it."""

    def record(kind: str, record_id: str, block: bytes, *more: tuple[str, object]) -> bytes:
        url = None if row["url"] is None else row["url"].replace("\r", "%0D").replace("\n", "%0A")
        fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("Page-ID", row["page_id"]), *more, ("WARC-Block-Digest", _sha1(block)), ("Content-Length", len(block))]
        return "".join([f"{VERSION}\r\n", *(f"{k}: {v}\r\n" for k, v in fields if v is not None), "\r\n"]).encode() + block

    digest = ("WARC-Payload-Digest", "sha1:" + row["digest"])
    message = ("Content-Type", "application/http; msgtype=response")
    if row["refers_id"] is not None:
        yield record("revisit", row["record_id"], HTTP, ("WARC-Refers-To", row["refers_id"]), ("WARC-Profile", PROFILE), digest, message)
        return
    whole = HTTP + chunked(row["payload"], chunk)
    if len(whole) <= segment:
        yield record("response", row["record_id"], whole, digest, message)
        return
    starts = range(0, len(whole), segment)
    for number, at in enumerate(starts, 1):
        last = ("WARC-Segment-Total-Length", len(whole) if number == len(starts) else None)
        if number == 1:
            yield record("response", row["record_id"], whole[:segment], ("WARC-Segment-Number", 1), digest, message)
        else:
            own = row["record_id"][:-1] + f":{number}>"
            yield record("continuation", own, whole[at : at + segment], ("WARC-Segment-Origin-ID", row["record_id"]), ("WARC-Segment-Number", number), last)


def decided(pages: DataFrame, least: int = 0) -> DataFrame:
    """One row a record of pages (record_id, page_id, url, digest, payload_bytes, copy) with its payload's first row in ``first_id``:
    the record itself if it is the response, else that to which it is a revisit. Payloads below ``least`` bytes are all responses."""
    copies = pages.groupBy("page_key", "digest", "payload_bytes", "page_id", "url").agg(F.count("*").alias("n"))
    stored = written(copies, "warc-copies")
    own = F.struct("page_id", "url", "page_key")
    shared = stored.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.max(own).alias("first"), F.count("*").alias("pages")).where("pages > 1")
    salted = shared.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    each = stored.withColumn("salt", F.pmod(F.xxhash64("page_key"), F.lit(SALTS)).cast("int"))
    met = each.join(salted, ["digest", "salt"], "left").withColumn("first_key", F.coalesce("first.page_key", "page_key"))
    copy = met.select("page_key", "first_key", "digest", "payload_bytes", "page_id", "url", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    mine = F.when(F.col("copy") == 1, F.col("page_key")).otherwise(uuid(F.col("page_key"), F.col("copy")))
    response = (F.col("payload_bytes") < least) | ((F.col("copy") == 1) & (F.col("page_key") == F.col("first_key")))
    return copy.withColumn("record_id", mine).withColumn("first_id", F.when(response, F.col("record_id")).otherwise(F.col("first_key")))


def archived(pages: DataFrame, path: str, segment: int = SEGMENT, chunk: int = CHUNK, least: int = 0) -> None:
    """Writes the archives of pages (page_id, url, html) to a new folder."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", base32(F.sha1("payload"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    keyed = keyed.withColumn("page_key", uuid(F.col("digest"), F.col("page_id"), F.col("url")))
    rows = written(decided(keyed.drop("payload"), least), "warc-decided").withColumn("is_first", F.col("record_id") == F.col("first_id"))
    once = keyed.groupBy("page_key").agg(F.first("payload").alias("payload"))  # equal pages are one before they are moved
    facts = "record_id", "page_id", "url", "digest"
    responses = once.join(rows.where("is_first"), "page_key").select(*facts, F.lit(None).cast("string").alias("refers_id"), "payload")
    revisits = rows.where("not is_first").select(*facts, F.col("first_id").alias("refers_id"), F.lit(None).cast("binary").alias("payload"))

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "payload", BATCH_BYTES):
            out = [record for row in block.to_pylist() for record in records(row, segment, chunk)]
            yield pa.record_batch([pa.array(out, pa.binary())], ["record"])

    made = responses.unionByName(revisits).mapInArrow(frugal(framed), "record binary")
    lines = made.select(F.col("record").cast("string").alias("value"))  # the bytes as they are
    options = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "lineSep": BLANK.decode(), "maxRecordsPerFile": ARCHIVE_RECORDS}
    lines.write.options(**options).text(path)


class Reader:
    """Records of one archive's bytes, fed piece by piece."""

    def __init__(self):
        self.parts: list[bytes] = []
        self.held = self.need = 0
        self.broken = False

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        """Header fields and block of each record that is whole with these bytes; no fields where the archive can't be read on."""
        if self.broken:
            return
        self.parts.append(data)
        self.held += len(data)
        while self.held >= max(self.need, 1):
            whole = b"".join(self.parts) if len(self.parts) > 1 else self.parts[0]
            head = whole.find(BLANK)
            if head < 0:
                self.parts, self.need = [whole], 2 * len(whole)
                return
            version, *lines = whole[:head].split(b"\r\n")
            fields = dict(_fields(lines))
            size = fields.get("content-length", "")
            known = version.startswith(b"WARC/") and size.isascii() and size.isdigit()
            end = head + 4 + int(size) if known else 0
            self.need = end + 4
            if known and len(whole) < self.need:
                self.parts = [whole]
                return
            if not known or whole[end : self.need] != BLANK:
                self.broken = True
                yield {}, whole[:100]
                return
            yield fields, whole[head + 4 : end]
            rest = whole[self.need :]
            self.parts, self.held, self.need = [rest], len(rest), 0

    def rest(self) -> bytes:
        """What is left at the end: nothing, if the last record was whole."""
        return b"" if self.broken else b"".join(self.parts).strip(b"\r\n")


def _int(text: str | None) -> int | None:
    """The number in a header field; None for anything else."""
    return int(text) if text and text.lstrip("-").isdecimal() and len(text) < 19 else None


def _row(head: dict[str, str], block: bytes, name: str, keep: bool) -> tuple:
    """A record as a row of ``parsed``."""
    if not head:
        return (None, "unreadable", *[None] * 11, f"{name}: {block!r}")
    get, kind, record_id = head.get, head.get("warc-type"), head.get("warc-record-id")
    number, total, page = get("warc-segment-number"), get("warc-segment-total-length"), get("page-id")
    problem = "block digest" if get("warc-block-digest") not in (None, _sha1(block)) else None
    facts = record_id, kind, get("warc-segment-origin-id", record_id), _int(number), _int(total), _int(page), get("warc-target-uri"), get("warc-refers-to"), get("warc-payload-digest")
    if number or kind != "response":
        return (*facts, block if number else None, None, None, None, problem or ("segment number" if kind == "continuation" and facts[3] is None else None))
    return (*facts, None, *_payload([block], None, facts[-1], problem, keep))


def _payload(message: list[bytes], total: int | None, digest: str | None, problem: str | None, keep: bool) -> tuple[bytes | None, int | None, str | None, str | None]:
    """The payload of a message (None unless kept), its length and digest, and what is wrong with it."""
    whole = b"".join(message)
    if not problem and total is not None and total != len(whole):
        problem = f"{len(whole)} bytes of {total}" if total >= 0 else "last segment missing"
    payload = None if problem else message_payload(whole)
    if payload is None:
        return None, None, None, problem or "framing"
    found = _sha1(payload)
    if digest not in (None, found):
        return None, None, None, "payload digest"
    return payload if keep else None, len(payload), found[5:], None


def parsed(spark: SparkSession, path: str, keep: bool = True) -> DataFrame:
    """The records in the gzipped archives of a folder, read once; keep: with the payloads of responses in one piece."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, name, out, size = Reader(), None, [], 0

        def flush() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[] for _ in _SCHEMA]
            made = pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)
            out.clear()
            return made

        def close() -> None:
            if rest := reader.rest():
                out.append(_row({}, rest[:100], name, keep))

        for batch in batches:
            if any(batch.column("start").to_pylist()):
                raise ValueError("an archive is read in splits: archives must be gzipped")
            for file, piece in zip(batch.column("file").to_pylist(), batch.column("piece"), strict=True):
                if file != name:
                    close()
                    reader, name = Reader(), file
                for head, block in reader.feed(piece.as_py() + BLANK):
                    out.append(_row(head, block, name, keep))
                    size += len(block)
                if size > BATCH_BYTES:
                    yield flush()
                    size = 0
        close()
        yield flush()

    pieces = spark.read.option("lineSep", BLANK.decode()).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("piece"))
    return pieces.mapInArrow(frugal(read), RECORD)


def payloads(given: DataFrame, keep: bool = True) -> DataFrame:
    """record_id, page_id, url, payload (if kept), payload_bytes, payload_digest and problem of each response of ``parsed`` rows, reassembled."""
    columns = "record_id", "page_id", "url", "payload", "payload_bytes", "payload_digest", "problem"
    whole = given.where("segment is null and type in ('response', 'unreadable')").select(*columns)
    first = lambda c: F.max(F.when(F.col("type") == "response", F.col(c))).alias(c)
    parts = given.where("segment is not null").groupBy(F.col("origin_id").alias("record_id")).agg(
        first("page_id"), first("url"), first("digest"), F.max("problem").alias("problem"), F.collect_list(F.struct("segment", "block")).alias("segments"), F.max(F.coalesce("total", F.lit(-1))).alias("total")
    )
    schema = "record_id string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, problem string"

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a record's segments at a time
                row = batch.slice(i, 1)
                found = _assembled(row.column("segments")[0].as_py(), row.column("total")[0].as_py(), row.column("digest")[0].as_py(), row.column("problem")[0].as_py(), keep)
                made = [pa.array([x], t) for x, t in zip(found, (pa.binary(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.record_batch([*(row.column(c) for c in columns[:3]), *made], columns)

    return whole.unionByName(parts.mapInArrow(frugal(assembled), schema))


def _assembled(segments: list[dict], total: int, digest: str | None, problem: str | None, keep: bool) -> tuple[bytes | None, int | None, str | None, str | None]:
    """``_payload`` of a record's segments. total: -1 if no segment states it."""
    by: dict[int, bytes] = {}
    for s in segments:
        if by.setdefault(s["segment"], s["block"]) != s["block"]:
            problem = problem or f"segment {s['segment']} twice"
    missing = [n for n in range(1, max(by) + 1) if n not in by]
    if missing:
        problem = problem or f"segment {missing[0]} missing"
    return _payload([by[n] for n in sorted(by)], total, digest, problem, keep)


def resolved(spark: SparkSession, path: str) -> DataFrame:
    """One row a page of the archives: page_id, url, payload_bytes and payload_digest (of the response's payload for a revisit too),
    record_type, refers_to (the response's page_id) and problem."""
    given = written(parsed(spark, path, keep=False), "warc-parsed")
    columns = "page_id", "url", "payload_bytes", "payload_digest"
    responses = written(payloads(given, keep=False).select("record_id", *columns, "problem"), "warc-responses")
    salt = F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int").alias("salt")
    revisits = given.where("type = 'revisit'").select("page_id", "url", "refers_id", salt, F.col("problem").alias("own"))
    asked = revisits.groupBy(F.col("refers_id").alias("record_id")).agg(F.lit(1).alias("asked"))
    targets = responses.join(asked, "record_id").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest", "problem", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = revisits.join(targets.withColumn("there", F.lit(True)), ["refers_id", "salt"], "left")
    wrong = F.coalesce("own", F.when(F.col("there").isNull(), "response missing"), "problem")
    first = responses.select(*columns, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "problem")
    return first.unionByName(met.select(*columns, F.lit("revisit").alias("record_type"), "refers_to", wrong.alias("problem")))


def report(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the archives of pages, below the shared folder if no path is given, and reads them back."""
    spark = pages.sparkSession
    path = path or temporary(spark, "archives")
    archived(pages, path)
    return resolved(spark, path)


_DIGIT = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((v >> {}) & 31)]"
#: What the archives must give back, from the pages alone.
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || hex[5 * i + 1:5 * i + 5] AS INT)) AS vs FROM p),
e AS (SELECT *, array_to_string(list_transform(vs, lambda v: {" || ".join(_DIGIT.format(s) for s in (15, 10, 5, 0))}), '') AS digest FROM d),
r AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS most, row_number() OVER (PARTITION BY digest ORDER BY page_id DESC NULLS LAST) AS place FROM e)
SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN most END AS refers_to, CAST(NULL AS VARCHAR) AS problem FROM r
"""
