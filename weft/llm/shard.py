"""Shards by a k-d tree: weighted medians along the widest metadata dimension. Native expressions only.

A node of s shards is cut where its bytes divide as floor(s / 2) to the rest, along the dimension in which it
is widest relative to the whole table, until every leaf is one shard. All nodes of a depth are cut in the
same jobs: histograms of bounded width, each within the last one's bin, close in on the weighted quantile.
The dimensions are facts of the text, its bytes, its characters and the bytes beyond one a character (which tell
scripts and languages apart), so that equal texts have the same place; source and language columns may differ between
equal texts and would part them. Rows with the same value are cut by the next key (the text's checksum, a hash of the id, the row itself), so
equal texts stay together unless a cut would be out of balance without dividing them.

Edge cases: a null text has no bytes and the checksum 0; a null doc_id is a value like any other; repeated
rows are placed one by one; a very long text is one row, whose shard then holds more than its share; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm._store import written

SHARDS = 40
BINS = 512
#: Keys lie between.
MOST = (1 << 63) - 1
LEAST = -1
#: A cut may miss its place by this share of a shard.
TOLERANCE = 0.002
SLOT_PARTS = 256


class Cuts:
    """The cuts of a k-d tree in heap order: node n has the children 2n and 2n + 1.

    A cut is (dimension, value, tie values ...); rows below it, compared key by key, go left. A node without
    a cut sends all rows left.
    """

    def __init__(self, dimensions: Sequence[str], ties: Sequence[str], shards: int):
        self.dimensions, self.ties = list(dimensions), list(ties)
        self.depth = max(1, (shards - 1).bit_length())
        self.size = 2 << self.depth
        self.shards, self.first = {1: shards}, {1: 0}  # of each node: how many shards, and the first of them
        self.found: dict[int, list[int]] = {}
        for n in range(1, self.size // 2):
            s = self.shards.get(n, 0)
            if s:
                half = s // 2 if s > 1 else s
                self.shards |= {2 * n: half, 2 * n + 1: s - half}
                self.first |= {2 * n: self.first[n], 2 * n + 1: self.first[n] + half}

    def table(self, values: dict[int, int], otherwise: int | None) -> Column:
        each = (values.get(n, otherwise) for n in range(self.size))
        return F.expr(f"array({', '.join('null' if x is None else f'{x}L' for x in each)})").cast("array<long>")

    def key(self, dimension: Column, k: int) -> Column:
        """Key k of a row: the node's dimension, then the ties."""
        if k:
            return F.col(self.ties[k - 1])
        out = F.col(self.dimensions[-1])
        for i, name in enumerate(self.dimensions[:-1]):
            out = F.when(dimension == i, F.col(name)).otherwise(out)
        return out

    def below(self, rows: DataFrame) -> DataFrame:
        """rows with ``node`` replaced by its child."""
        get = lambda values, otherwise: F.get(self.table(values, otherwise), F.col("node"))
        dimension = get({n: c[0] for n, c in self.found.items()}, 0)
        left = F.lit(False)
        for k in reversed(range(len(self.ties) + 1)):
            mine, cut = self.key(dimension, k), get({n: c[1 + k] for n, c in self.found.items()}, MOST)
            left = (mine < cut) | ((mine == cut) & left)
        return rows.withColumn("node", 2 * F.col("node") + F.when(left, 0).otherwise(1))

    def shard(self) -> Column:
        return F.get(self.table(self.first, None), F.col("node")).cast("int")


class _Search:
    """Where a node's cut lies: the key looked at, the values of those before it, and a range of BINS bins."""

    def __init__(self, dimension: int, twice: bool, need: int, ranges: list[tuple[int, int]]):
        """twice: the dimension is the first tie too."""
        self.dimension, self.twice, self.need, self.ranges = dimension, twice, need, ranges
        self.fixed: list[int] = []
        self.cut: list[int] | None = None
        self._begin()

    def _begin(self) -> None:
        self.low, high = self.ranges[len(self.fixed)]
        self.width = max(1, -(-(high - self.low + 1) // BINS))

    def narrow(self, bins: list[tuple[int, int, int]], allowed: float) -> None:
        """bins: (number, weight, rows) in order; the cut lies in the one in which the needed weight is reached."""
        ran = 0
        for b, n, rows in bins:
            if ran + n > self.need or b == bins[-1][0]:
                break
            ran += n
        start, last = self.low + b * self.width, len(self.fixed) == len(self.ranges) - 1
        if n <= allowed or rows == 1 or (self.width == 1 and last):
            end = start + self.width if ran + n - self.need < self.need - ran else start
            self.cut = [self.dimension, *self.fixed, min(end, MOST), *[LEAST] * (len(self.ranges) - 1 - len(self.fixed))]
            return
        self.need -= ran
        if self.width == 1:
            self.fixed += [start, start] if self.twice and not self.fixed else [start]
            self._begin()
        else:
            self.low, self.width = start, max(1, -(-self.width // BINS))


def tree(rows: DataFrame, dimensions: Sequence[str], ties: Sequence[str], weight: str, shards: int) -> DataFrame:
    """rows, whose dimensions and ties are whole numbers, with ``shard``; stored anew at each depth."""
    cuts = Cuts(dimensions, ties, shards)
    names = list(dict.fromkeys([*dimensions, *ties]))
    total, whole = 0, {}
    at = rows.withColumn("node", F.lit(1))
    for depth in range(cuts.depth):
        measures = [f(k).alias(f"{s}{k}") for k in names for f, s in ((F.min, "_min_"), (F.max, "_max_"))]
        searches: dict[int, _Search] = {}
        for r in at.groupBy("node").agg(F.sum(weight).alias("_sum"), *measures).collect():  # fewer rows than shards
            n, ranges = r["node"], {k: (r[f"_min_{k}"], r[f"_max_{k}"]) for k in names}
            if depth == 0:
                total, whole = r["_sum"], ranges
            if cuts.shards[n] > 1:
                spread = lambda k: (ranges[k][1] - ranges[k][0]) / max(whole[k][1] - whole[k][0], 1)  # noqa: E731, B023
                wide = max(range(len(dimensions)), key=lambda i: spread(dimensions[i]))  # noqa: B023
                searches[n] = _Search(wide, dimensions[wide] == ties[0], r["_sum"] * cuts.shards[2 * n] // cuts.shards[n], [ranges[k] for k in (dimensions[wide], *ties)])
        allowed = TOLERANCE * total / shards
        while busy := {n: s for n, s in searches.items() if s.cut is None}:
            get = lambda values: F.get(cuts.table(values, None), F.col("node"))  # noqa: E731, B023
            dimension = get({n: s.dimension for n, s in busy.items()})
            looked = get({n: len(s.fixed) for n, s in busy.items()})
            mine, inside = cuts.key(dimension, 0), looked.isNotNull()
            for k in range(len(ties)):
                fixed = get({n: s.fixed[k] for n, s in busy.items() if len(s.fixed) > k})
                inside &= (looked <= k) | (cuts.key(dimension, k) == fixed)
                mine = F.when(looked == k + 1, cuts.key(dimension, k + 1)).otherwise(mine)
            seen = at.where(inside).select("node", mine.alias("v"), get({n: s.low for n, s in busy.items()}).alias("low"), get({n: s.width for n, s in busy.items()}).alias("width"), weight)
            counted = seen.where(f"v >= low and (v - low) div width < {BINS}").groupBy("node", F.expr("(v - low) div width").alias("b")).agg(F.sum(weight).alias("n"), F.count("*").alias("rows"))
            bins: dict[int, list] = {}
            for r in counted.collect():  # at most BINS for each of fewer nodes than shards
                bins.setdefault(r["node"], []).append((r["b"], r["n"], r["rows"]))
            for n, s in busy.items():
                s.narrow(sorted(bins[n]), allowed)
        cuts.found = {n: s.cut for n, s in searches.items()}
        at = written(cuts.below(at), "shard-rows")
    return at.withColumn("shard", cuts.shard())


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for each row of docs (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    facts = docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.length(text).cast("long").alias("n_chars"),
        F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("id_hash"), F.monotonically_increasing_id().alias("row"),
    )
    rows = written(facts.withColumn("n_wide", F.col("size") - 16 - F.col("n_chars")), "shard-rows")
    found = tree(rows, ["size", "n_chars", "n_wide"], ["text_crc32", "id_hash", "row"], "size", shards)
    placed = found.select("doc_id", "size", "text_crc32", "row", "shard", F.pmod("id_hash", F.lit(SLOT_PARTS)).cast("int").alias("part"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    # at most shards * SLOT_PARTS rows
    firsts = counts.select("shard", "part", (F.sum("n").over(W.partitionBy("shard").orderBy("part")) - F.col("n")).alias("first"))
    numbered = placed.withColumn("own", F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "row")))
    return numbered.join(F.broadcast(firsts), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("own") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
