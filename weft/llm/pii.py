"""Personal data: patterns of known kinds, and identifiers of other kinds found by bootstrapped contexts.

Base spans come from fixed patterns (e-mail, IP address, card, phone). The bootstrap finds further tokens:

1. Every token that has a shape of an identifier (a digit, or "@" inside) is an occurrence. Its lexical
   patterns are the word before it, the word after it and the name it is assigned to, whether the sign stands in the token, at the
   end of the name or alone between them; the words both alone, so
   that other shapes are found by them, and with the token's form (letters and digits made classes). Tokens that a base pattern met but its test turned down take no part.
2. Patterns and instances make a weighted graph. Instances that base spans cover are seeds with score 1, and so are secrets by
   their form: long runs of mixed letters and digits that are assigned to a name.
   A round gives each pattern the share of its occurrences held by scored instances, smoothed, and each
   instance the chance that not all of its contexts are wrong, a context having its best pattern's score. Rounds are Spark aggregations over counts of
   (pattern, instance); the table is written between rounds. Every occurrence counts in every round, those of
   instances without a score as 0.
3. A word alone must also introduce or follow scored instances in at least ``SHARE`` of its occurrences before or after
   any word, so that function words, which say nothing, aren't trusted. The words are counted over all texts.
4. Occurrences of a pattern above the confidence become spans of kind "id", unless a base span touches them.
   Up to ``patterns`` trusted patterns go to the executors whole; more are joined to the occurrences by shuffle,
   with the same result.

Offsets are code points, ends exclusive. Base spans always stay.

Every step reads a text once, so that a long text or a long run without white space takes time in proportion.

Edge cases: null and empty texts have no spans; a null doc_id is kept; repeated rows give repeated rows
and count as often; ties need no order, as all patterns above the thresholds are trusted; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._store import written
from weft.llm._text import LOWER_SPACE, Words, blocks, translated

KINDS = ("email", "ip", "card", "phone")
#: An e-mail is looked for from its "@" to both sides: no other place can be its middle, and no run is read twice.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A run of digits that fails from its first digit fails from all others, so only its first is tried.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
#: What a token must have to be looked at.
SHAPED = re.compile(r"[0-9@]")
WHITE = re.compile(r"[\x20\x09-\x0D]|\Z")
EDGES = "\"'`()[]{}<>,;:.!?#*$%|~"
#: Between a name and its value.
SIGNS = frozenset(("=", ":", ":=", "=>", "->"))
SECRET = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
#: Kinds of occurrences: no seed, covered by a base span, a secret by its form.
PLAIN, BASE, FORM = 0, 1, 2
BLOCK_BYTES, LONG = 8 << 20, 64
ROUNDS, CONFIDENCE, LEAST_SEEDS, SMOOTHING, SHARE = 3, 0.8, 4, 2.0, 0.1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then by kind as listed; leftmost and without overlap within a kind."""
    return [(a, b, KINDS[k]) for a, b, k, good in _matches(text) if good]


def _matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, end, kind, whether its test passed) of every match of a base pattern."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        first = at
        while first > done and text[first - 1] in LOCAL:
            first -= 1
        if first < at and (host := HOST.match(text, at + 1)):
            out.append((first, host.end(), 0, True))
        done = out[-1][1] if first < at and host else at + 1
        at = text.find("@", max(done, at + 1))
    for m in IP.finditer(text):
        out.append((*m.span(), 1, all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        out.append((*m.span(), 2, 14 <= len(digits) <= 19 and luhn(digits)))
    if "+" in text:
        for m in PHONE.finditer(text):
            out.append((*m.span(), 3, 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15))
    return sorted(out, key=lambda x: (x[0], x[2]))


def _brief(part: str) -> str:
    """A long part of a pattern by its digest, so that patterns are short whatever the text."""
    return part if len(part) <= LONG else "#" + hashlib.blake2b(part.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def form(token: str) -> str:
    """The token with runs of letters and digits made classes, long runs alike."""
    return re.sub(r"[0-9A-Za-z]+", lambda m: ("9" if m.group().isdigit() else "a" if m.group().isalpha() else "x") + ("+" if len(m.group()) > 7 else ""), token)


def is_secret(token: str) -> bool:
    """Long, and of letters and digits in turn, as no word or number is."""
    return bool(SECRET.fullmatch(token)) and sum("0" <= c <= "9" for c in token) >= 4 and len(re.findall(r"[0-9]+", token)) >= 3 and len(re.findall(r"[A-Za-z]+", token)) >= 3


def occurrences(text: str) -> Iterator[tuple[int, int, str, list[tuple[str, str]], int]]:
    """(start, end, instance, (pattern, context) of each pattern, kind of seed) of each shaped token, punctuation around it left off."""
    spans, at, passed, failed, over = None, 0, 0, 0, 0
    for m in SHAPED.finditer(text):
        if m.start() < over:
            continue
        first, over = _first(text, m.start()), WHITE.search(text, m.start()).start()
        raw = text[first:over]
        core = raw.strip(EDGES)
        if not core or not any("0" <= c <= "9" for c in core) and "@" not in core[1:-1]:
            continue
        start = first + raw.index(core)
        end = start + len(core)
        if spans is None:
            # cards match any number; only long ones are turned down as cards
            spans = [(a, b, good) for a, b, k, good in _matches(text) if good or k != 2 or b - a >= 14]
        while at < len(spans) and spans[at][0] < end:
            passed, failed = (max(passed, spans[at][1]), failed) if spans[at][2] else (passed, max(failed, spans[at][1]))
            at += 1
        if passed <= start < failed:
            continue
        shape = _brief(form(core))
        before = _last(text, first)
        named = _last(text, text.rindex(before, 0, first)) if before in SIGNS else before if before[-1:] in ("=", ":") else ""
        patterns = []
        if before not in SIGNS:
            left = _brief(before.lower())
            patterns.append((f"l {left}|{shape}", f"l {left}"))
            if left:
                patterns.append((f"L {left}", f"l {left}"))
        if right := TOKEN.match(text, _skip(text, over)):
            word = _brief(right.group().lower())
            patterns += [(f"r {shape}|{word}", f"r {word}"), (f"R {word}", f"r {word}")]
        name, equals, value = core.partition("=")
        if not (equals and name and value.strip("=")):
            name, value = named.strip(EDGES + "="), core
        if name:
            name = _brief(name.lower())
            patterns.append((f"k {name}=", f"k {name}="))
        yield start, end, core, patterns, BASE if passed > start else FORM if name and is_secret(value.strip(EDGES)) else PLAIN


def _first(text: str, at: int) -> int:
    """Where the token around the given place begins."""
    while at > 0 and text[at - 1] not in " \t\n\x0b\f\r":
        at -= 1
    return at


def _skip(text: str, at: int) -> int:
    while at < len(text) and text[at] in " \t\n\x0b\f\r":
        at += 1
    return at


def _last(text: str, end: int) -> str:
    """The token that ends before the given place."""
    while end > 0 and text[end - 1] in " \t\n\x0b\f\r":
        end -= 1
    return text[_first(text, end) : end]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text", BLOCK_BYTES):
        found: dict[tuple[str, str, bytes, bool], int] = {}
        for text in block.column("text").to_pylist():
            if text:
                for _, _, token, patterns, seed in occurrences(text):
                    mark = hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=12).digest()
                    for p, context in patterns:
                        found[p, context, mark, seed > PLAIN] = found.get((p, context, mark, seed > PLAIN), 0) + 1
        columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
        yield pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.bool_()), pa.array(list(found.values()), pa.int64())], ["pattern", "context", "instance", "seed", "n"])


def _words_counted(docs: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """word and how often it occurs in all texts, of the wanted ones or of all."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            words = Words(translated(block.column("text"), LOWER_SPACE))
            own: dict[str, int] = {}
            for word, n in zip(words.vocabulary.to_pylist(), np.bincount(words.ids, minlength=len(words.vocabulary)).tolist(), strict=True):
                word = _brief(word.lower())
                if sent.value is None or word in sent.value:
                    own[word] = own.get(word, 0) + n
            yield pa.record_batch([pa.array(own.keys(), pa.string()), pa.array(own.values(), pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def confident(docs: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, most: int = 200_000) -> DataFrame:
    """The patterns (pattern, score) that the bootstrap trusts."""
    pairs = docs.select("text").mapInArrow(_counted, "pattern string, context string, instance binary, seed boolean, n long")
    graph = written(pairs.groupBy("pattern", "context", "instance").agg(F.sum("n").alias("n"), F.max("seed").alias("seed")), "pii-graph")
    score = graph.select("instance", F.col("seed").cast("double").alias("s")).groupBy("instance").agg(F.max("s").alias("s"))
    for _ in range(rounds):
        held = graph.join(score, "instance", "left").fillna(0.0, ["s"])
        patterns = held.groupBy("pattern").agg(F.sum(F.col("n") * F.col("s")).alias("good"), F.sum("n").alias("all"), F.sum((F.col("s") > 0.5).cast("int")).alias("kinds"))
        patterns = written(patterns.select("pattern", (F.col("good") / (F.col("all") + SMOOTHING)).alias("score"), "kinds", "good"), "pii-patterns")
        chance = 1 - F.exp(F.sum(F.log(F.lit(1.0) - F.least(F.col("score"), F.lit(0.999)))))
        score = written(graph.join(patterns.where(f"kinds >= {LEAST_SEEDS}"), "pattern", "left").fillna(0.0, ["score"]).groupBy("instance", "context").agg(F.max("score").alias("score"), F.max("seed").alias("seed")).groupBy("instance").agg(F.greatest(chance, F.max("seed").cast("double")).alias("s")), "pii-instances")
    trust = patterns.where((F.col("score") >= confidence) & (F.col("kinds") >= LEAST_SEEDS))
    alone = F.when(F.col("pattern").rlike("^[LR] "), F.substring("pattern", 3, 1 << 30))
    trust = written(trust.withColumn("word", alone), "pii-trusted")
    words = trust.select("word").where("word is not null").distinct().limit(most + 1).collect()  # bounded
    counts = _words_counted(docs, None if len(words) > most else frozenset(r["word"] for r in words))
    said = trust.join(counts, "word", "left").where(F.col("word").isNull() | (F.col("good") >= SHARE * F.coalesce("n", F.lit(0))))
    return written(said.select("pattern", "score", "kinds"), "pii-said")


def located(docs: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, patterns: int = 200_000) -> DataFrame:
    """doc_id, counts of base spans, base spans and all spans (arrays of kind:start:end) for each row of docs."""
    trust = confident(docs, rounds, confidence)
    if trust.count() > patterns:
        return _joined(docs, trust)
    trusted = docs.sparkSession.sparkContext.broadcast(frozenset(trust.toArrow()["pattern"].to_pylist()))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            based, every = _based(block), []
            for text, own in zip(block.column("text").to_pylist(), based.column("base").to_pylist(), strict=True):
                every.append(_every(own, [(a, b) for a, b, _, p, seed in occurrences(text or "") if seed != BASE and any(x in trusted.value for x, _ in p)]))
            yield based.append_column("every", pa.array(every, pa.list_(pa.string())))

    return docs.select("doc_id", "text").mapInArrow(spans, f"{BASED}, every array<string>")


BASED = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base array<string>"


def _based(block: pa.RecordBatch) -> pa.RecordBatch:
    """doc_id, counts of base spans and the base spans of each row."""
    counts, base = [], []
    for text in block.column("text").to_pylist():
        own = base_spans(text or "")
        counts.append([sum(k == kind for *_, k in own) for kind in KINDS])
        base.append([f"{k}:{a}:{b}" for a, b, k in own])
    return pa.record_batch([block.column("doc_id").cast(pa.int64()), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4)), pa.array(base, pa.list_(pa.string()))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base"])


def _every(base: list[str], more: list[tuple[int, int]]) -> list[str]:
    """Base spans and spans of kind id, by start and then by kind."""
    order = (*KINDS, "id")

    def at(span: str) -> tuple[int, int]:
        kind, start, _ = span.split(":")
        return int(start), order.index(kind)

    return sorted(base + [f"id:{a}:{b}" for a, b in more], key=at)


def _joined(docs: DataFrame, trust: DataFrame) -> DataFrame:
    """As ``located`` for trusted patterns of any number: each row's occurrences are written and meet them by shuffle."""

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 40
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.string())]))
        for block in blocks(batches, "text", BLOCK_BYTES):
            seen = [[(a, b, x) for a, b, _, p, seed in occurrences(text or "") if seed != BASE for x, _ in p] for text in block.column("text").to_pylist()]
            yield _based(block).append_column("seen", pa.array(seen, kind)).append_column("row", pa.array(range(n, n + block.num_rows), pa.int64()))
            n += block.num_rows

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [_every(own, [(x["start"], x["end"]) for x in more or []]) for own, more in zip(batch.column("base").to_pylist(), batch.column("more").to_pylist(), strict=True)]
            yield batch.drop_columns(["more"]).append_column("every", pa.array(every, pa.list_(pa.string())))

    rows = written(docs.select("doc_id", "text").mapInArrow(looked, f"{BASED}, seen array<struct<start:long,end:long,pattern:string>>, row long"), "pii-rows")
    seen = rows.select("row", F.inline("seen")).join(trust.select("pattern"), "pattern", "left_semi")
    more = seen.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("more"))
    return rows.drop("seen").join(more, "row", "left").drop("row").mapInArrow(ended, f"{BASED}, every array<string>")


def report(docs: DataFrame, **options) -> DataFrame:
    found = located(docs, **options)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join("every", ",").alias("spans"))


def _base_sql() -> str:
    """Counts and digest of base spans: matches are set between two marks that texts don't have, and lengths summed up."""
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "TRUE"),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || left(ltrim(p, '0'), 4) AS INTEGER) > 255)) = 0"),
        "card": (r"[0-9]([\x20-]?[0-9])+", "length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(string_split(reverse(digits), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INTEGER) WHEN CAST(c AS INTEGER) > 4 THEN 2 * CAST(c AS INTEGER) - 9 ELSE 2 * CAST(c AS INTEGER) END)) % 10 = 0"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) BETWEEN 10 AND 15"),
    }
    parts = " UNION ALL ".join(
        f"SELECT row, {k} AS k, '{name}' AS kind, unnest(range(2, len(x) + 1, 2)) AS i, x FROM (SELECT row, string_split(replace(regexp_replace(text, '({pattern})', chr(57344) || '\\1' || chr(57345), 'g'), chr(57345), chr(57344)), chr(57344)) AS x FROM d)" for k, (name, (pattern, _)) in enumerate(kinds.items())
    )
    good = " OR ".join(f"kind = '{name}' AND {test}" for name, (_, test) in kinds.items())
    counts = ", ".join(f"count(*) FILTER (kind = '{name}') AS n_{name}" for name in kinds)
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({parts}),
m AS (SELECT row, k, kind, x[i] AS m, regexp_replace(x[i], '[^0-9]', '', 'g') AS digits, CAST(coalesce(list_sum(list_transform(x[1:i - 1], lambda p: length(p))), 0) AS BIGINT) AS s FROM found),
good AS (SELECT row, kind, k, s, s + length(m) AS e FROM m WHERE {good})
SELECT any_value(doc_id) AS doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k), '')) AS base_sha256 FROM d LEFT JOIN good USING (row) GROUP BY d.row
"""


BASE_SQL = _base_sql()
