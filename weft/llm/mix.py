"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources; those with the same set of sources form a pattern. A flow routes
each pattern's words, once, twice, ... up to ``copies`` times at costs 0, 1, 2, ..., to its sources' targets,
so a document is repeated only where fresh words run out. Only the patterns' sums reach the driver, and
their number is checked. Within a pattern every document is then taken the whole number of times that the
flow fills, and a seeded choice of documents once more: documents are ordered by a hash; histograms narrow
the place where the quota is reached down to a few documents, of which those that still fit are taken.
A flow of three times a pattern's size takes every document three times. The flow's time grows with patterns and their
sources, not with documents: 100,000 patterns take seconds to minutes on the driver.

Edge cases: a null, empty or blank text has size 0 and isn't drawn; a null source is a source of its own,
last in order; very long texts count by their words as any other, and a document of more words than its source may give is
first passed over; repeated rows are documents of their own, and any of them may be taken; an empty table
gives an empty result; a null doc_id is kept, and the text tells such rows apart; other columns are kept by ``drawn``
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm._store import written

COPIES, SEED = 3, 17
PATTERNS = 100_000
#: Documents among which the end of a quota is settled one by one; lots that repeated rows beyond that are counted in.
FEW, LOTS = 500, 997
#: Bits in which sums of few rows are searched; beyond, there are so many rows that exchanges come near.
SEARCHED = 1 << 29
BITS = 10


def words(text: str = "text") -> Column:
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+"))).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], copies: int = COPIES) -> list[float]:
    """Shares of the whole by weight, none above copies times its size; the excess is shared again."""
    out = [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        above = {i for i in open_ if left * weights[i] / total > copies * sizes[i]}
        if not above:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in above:
            out[i] = float(copies * sizes[i])
        left -= sum(out[i] for i in above)
        open_ -= above
    return out


def flow(supply: Mapping[int, int], members: Mapping[int, Sequence[int]], quota: Sequence[int], copies: int = COPIES) -> dict[int, dict[int, int]]:
    """Words of each pattern to each source: a cheapest flow among the largest, level l of a repeat costing l - 1.

    Costs lie on the patterns' levels alone, so shortest paths come in rounds: all of cost 0, then all of cost 1, and so
    on; a pattern that can't reach a source with room in its round never can again. A round is a largest flow, found by
    blocking flows (Dinic) over layered patterns and sources.
    """
    patterns = sorted(supply)
    at = {p: i for i, p in enumerate(patterns)}
    to = [list(dict.fromkeys(members[p])) for p in patterns]
    inflow: list[dict[int, int]] = [{} for _ in quota]  # of each source: what each pattern sends it
    room, left = list(quota), [0] * len(patterns)
    for _ in range(copies):
        for i, p in enumerate(patterns):
            left[i] += supply[p]
        while _blocked(to, inflow, room, left):
            pass
    out: dict[int, dict[int, int]] = {p: {} for p in patterns}
    for s, by in enumerate(inflow):
        for i, n in by.items():
            if n:
                out[patterns[i]][s] = n
    assert all(at[p] == i for i, p in enumerate(patterns))
    return out


def _blocked(to: list[list[int]], inflow: list[dict[int, int]], room: list[int], left: list[int]) -> int:
    """Adds one blocking flow along shortest paths; its size. A path goes pattern, source, pattern (taking back), ..., source with room."""
    far_p, far_s = [-1] * len(to), [-1] * len(room)
    layer, depth, ends = [i for i, n in enumerate(left) if n > 0], 0, False
    for i in layer:
        far_p[i] = 0
    while layer and not ends:
        sources = []
        for i in layer:
            for s in to[i]:
                if far_s[s] < 0:
                    far_s[s] = depth
                    sources.append(s)
                    ends = ends or room[s] > 0
        layer, depth = [], depth + 1
        if not ends:
            for s in sources:
                for i, n in inflow[s].items():
                    if n > 0 and far_p[i] < 0:
                        far_p[i] = depth
                        layer.append(i)
    if not ends:
        return 0
    next_p, next_s, total = [0] * len(to), [iter(list(x)) for x in inflow], 0
    held_s: list[int | None] = [next(x, None) for x in next_s]
    for start in [i for i, n in enumerate(left) if n > 0]:
        while left[start] > 0:
            path, i, found = [], start, -1  # (pattern, source) steps; between them the pattern that takes back
            while True:
                moved = False
                while next_p[i] < len(to[i]):
                    s = to[i][next_p[i]]
                    if far_s[s] == far_p[i]:
                        if room[s] > 0:
                            found, moved = s, True
                            break
                        while held_s[s] is not None and not (inflow[s].get(held_s[s], 0) > 0 and far_p[held_s[s]] == far_s[s] + 1):
                            held_s[s] = next(next_s[s], None)
                        if held_s[s] is not None:
                            path.append((i, s))
                            i, moved = held_s[s], True
                            break
                    next_p[i] += 1
                if found >= 0:
                    break
                if not moved:
                    if not path:
                        break
                    i, s = path.pop()
                    held_s[s] = next(next_s[s], None)
            if found < 0:
                break
            path.append((i, found))
            takers = [x for x, _ in path[1:]]
            n = min([left[start], room[found], *(inflow[s][x] for (_, s), x in zip(path[:-1], takers, strict=True))])
            for k, (x, s) in enumerate(path):
                inflow[s][x] = inflow[s].get(x, 0) + n
                if k < len(takers):
                    inflow[s][takers[k]] -= n
            left[start] -= n
            room[found] -= n
            total += n
    return total


def plan(sums: Sequence[tuple[tuple, int]], weights: Mapping | None = None, copies: int = COPIES) -> tuple[list, list[int], list[float], dict[int, int]]:
    """(sources in order, their sizes, targets, words to take of each pattern).

    sums: (sources of the pattern, size). Sources go by code point, null last; without weights they weigh
    1, 2, 3, repeating. A document of several sources counts in the size of each.
    """
    names = sorted({s for pattern, _ in sums for s in pattern}, key=lambda s: (s is None, s or ""))
    at = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for pattern, n in sums:
        for s in pattern:
            sizes[at[s]] += n
    chosen = [float(weights[s]) if weights else 1.0 + i % 3 for i, s in enumerate(names)]
    aims = targets(sizes, chosen, copies)
    routed = flow({i: n for i, (_, n) in enumerate(sums)}, {i: [at[s] for s in p] for i, (p, _) in enumerate(sums)}, [round(x) for x in aims], copies)
    return names, sizes, aims, {i: sum(x.values()) for i, x in routed.items()}


def mixed(docs: DataFrame, sources: Column, size: Column, weights: Mapping | None = None, copies: int = COPIES, seed: int = SEED) -> DataFrame:
    """``row`` (all columns of docs), ``sources``, ``size`` and ``times`` (whole copies to take) for each row of docs.

    sources is an array of names over docs' columns, size a number of words. The frame is read up to five times, so it
    should be a stored table. The order in which documents are chosen is a hash of all their columns: rows of one hash are
    repeated rows, and any of them may be taken.
    """
    plain = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]  # a map has no hash
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *plain), 1)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.array_sort(F.array_distinct(sources)).alias("sources"), size.alias("size"), order.alias("place"))
    slim = written(rows.select("sources", "size", "place"), "mix-slim")
    sums = slim.groupBy("sources").agg(F.sum("size").alias("n"), F.count("*").alias("c")).limit(PATTERNS + 1).collect()
    if len(sums) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} sets of sources; group them first")
    spark = docs.sparkSession
    sums = sorted(((tuple(r[0]), r[1], r[2]) for r in sums), key=lambda x: [(s is None, s or "") for s in x[0]])
    counts, sums = [c for *_, c in sums], [x[:2] for x in sums]
    names, sizes, aims, taken = plan(sums, weights, copies)
    bits = lambda count: min(BITS, max(1, (count // FEW).bit_length()))
    # each pattern: whole copies of all, and words still wanted of a seeded choice
    state = [{"p": i, "pattern": list(pattern), "whole": min(copies, taken[i] // n) if n else 0, "rest": taken[i] - n * min(copies, taken[i] // n) if n else 0, "low": 0, "shift": 63, "few": counts[i] <= FEW, "bits": bits(counts[i])} for i, (pattern, n) in enumerate(sums)]
    schema = "p int, pattern array<string>, whole int, rest long, low long, shift int, few boolean, bits int"

    def placed(rows: DataFrame) -> DataFrame:
        table = F.broadcast(spark.createDataFrame([tuple(s.values()) for s in state], schema))  # at most PATTERNS rows
        return rows.join(table, rows["sources"].eqNullSafe(table["pattern"])).drop("pattern")

    at = lambda shift: F.expr(f"shiftright(place, {shift})")
    here = (F.col("rest") > 0) & (at("shift") == F.expr("shiftright(low, shift)"))
    while any(not s["few"] and s["rest"] > 0 and s["shift"] > 0 for s in state):
        inside = placed(slim).where(here & ~F.col("few") & (F.col("shift") > 0))
        bins = inside.groupBy("p", "rest", at("greatest(shift - bits, 0)").alias("bin")).agg(F.sum("size").alias("n"), F.count("*").alias("c"), F.min("place").alias("least"), F.max("place").alias("most"))
        ran = bins.withColumn("upto", F.sum("n").over(W.partitionBy("p").orderBy("bin")))  # at most 2^BITS rows a pattern
        ends = ran.where("upto > rest").groupBy("p").agg(F.min(F.struct("bin", "upto", "n", "c", "least", "most")).alias("x")).collect()
        found = {r["p"]: r["x"] for r in ends}
        for s in state:
            if s["rest"] > 0 and not s["few"] and s["shift"] > 0:
                x = found[s["p"]]
                one = x["least"] == x["most"]  # repeated rows: no shift parts them
                s["shift"] = 0 if one else max(s["shift"] - s["bits"], 0)
                s["low"], s["rest"], s["few"] = x["least"] if one else x["bin"] << s["shift"], s["rest"] - (x["upto"] - x["n"]), x["c"] <= FEW
                s["bits"] = bits(x["c"])
    done = placed(rows)
    times = F.col("whole") + (F.col("low") > F.col("place")).cast("int")
    away = done.where(~here).withColumn("times", times)
    near = done.where(here & F.col("few")).withColumn("times", F.col("whole")).repartition("p").sortWithinPartitions("p", "place", "size").mapInArrow(_filled, _schema(done))
    every = away.unionByName(near)
    if any(not s["few"] and s["rest"] > 0 for s in state):
        every = every.unionByName(_tied(done.where(here & ~F.col("few"))))
    result = every.select("row", "sources", "size", F.when(F.col("size") > 0, F.col("times")).otherwise(0).alias("times"))
    result.__dict__["mix_plan"] = dict(zip(names, zip(sizes, aims, strict=True), strict=True))
    return result


def _schema(done: DataFrame):
    return done.withColumn("times", F.col("whole")).schema


def _tied(rows: DataFrame) -> DataFrame:
    """Repeated rows of one hash, more than FEW: as many as their quota has room for, counted by lot so that no task holds all."""
    lots = rows.withColumn("lot", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(LOTS)))
    lots = lots.withColumn("room", F.floor(F.col("rest") / F.greatest("size", F.lit(1))))
    counts = lots.groupBy("p", "lot").agg(F.count("*").alias("n"))
    before = counts.select("p", "lot", (F.sum("n").over(W.partitionBy("p").orderBy("lot")) - F.col("n")).alias("before"))  # LOTS rows a pattern
    ranked = lots.join(F.broadcast(before), ["p", "lot"]).withColumn("rank", F.row_number().over(W.partitionBy("p", "lot").orderBy("place")) + F.col("before"))
    return ranked.withColumn("times", F.col("whole") + (F.col("rank") <= F.col("room")).cast("int")).drop("lot", "room", "before", "rank")


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows at the end of each pattern's quota, FEW at most: each in order that still fits is taken once more, then exchanges come nearer."""

    def settled(rows: pa.Table) -> list[pa.RecordBatch]:
        more = _exchanged(rows.column("size").to_numpy(), rows.column("rest")[0].as_py())
        times = (rows.column("whole").to_numpy() + more).astype(np.int32)
        return rows.set_column(rows.schema.get_field_index("times"), "times", pa.array(times)).combine_chunks().to_batches()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        p = batch.column("p").to_numpy()
        cuts = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            if held and part.num_rows and held[0].column("p")[0] != part.column("p")[0]:
                yield from settled(pa.Table.from_batches(held))
                held.clear()
            if part.num_rows:
                held.append(part)
    if held:
        yield from settled(pa.Table.from_batches(held))


def _exchanged(sizes: np.ndarray, left: int) -> np.ndarray:
    """Which rows are taken once more; where exchanges end further off than the smallest row, the sums are searched."""
    quota, more = left, np.zeros(len(sizes), np.int32)
    for i in range(len(sizes)):
        if sizes[i] <= left:
            more[i], left = 1, left - sizes[i]
    while left:  # exchange a taken document, or none, for another while that comes nearer
        inside, others = np.append(np.flatnonzero(more), -1), np.flatnonzero(more == 0)
        change = sizes[others][:, None] - np.append(sizes[inside[:-1]], 0)[None, :] if len(others) else np.zeros((0, 1))
        if not change.size or (miss := np.abs(left - change)).min() >= abs(left):
            break
        i, j = np.unravel_index(miss.argmin(), miss.shape)
        left -= int(change[i, j])
        more[others[i]] = 1
        if inside[j] >= 0:
            more[inside[j]] = 0
    real = sizes[sizes > 0]
    if len(real) and abs(left) > real.min() and len(sizes) * (quota + int(real.max())) <= SEARCHED:
        found = _nearest_sum(sizes.tolist(), quota)
        if abs(int(sizes @ found) - quota) < abs(left):
            return found
    return more


def _nearest_sum(sizes: list[int], quota: int) -> np.ndarray:
    """The rows whose sum comes nearest to the quota: bit b of a number tells that a sum of b can be had."""
    most = (1 << quota + max(sizes) + 1) - 1
    sums = [1]
    for n in sizes:
        sums.append((sums[-1] | sums[-1] << n) & most)
    below = sums[-1] & ((1 << quota + 1) - 1)
    low, above = below.bit_length() - 1, sums[-1] >> quota + 1
    high = quota + (above & -above).bit_length() if above else None
    at = high if high is not None and high - quota < quota - low else low
    more = np.zeros(len(sizes), np.int32)
    for i in range(len(sizes) - 1, -1, -1):
        if not sums[i] >> at & 1:
            more[i], at = 1, at - sizes[i]
    return more


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken for each row of docs (doc_id, text, source)."""
    slim = written(docs.select("doc_id", "source", words().alias("size"), F.xxhash64("text").alias("mark")), "mix-sizes")
    found = mixed(slim, F.array("source"), F.col("size"), **options)
    known = docs.sparkSession.createDataFrame([(name, size, aim) for name, (size, aim) in found.mix_plan.items()], "name string, source_size long, target double")
    named = found.join(F.broadcast(known), found["row"]["source"].eqNullSafe(F.col("name")))  # a row a source, at most PATTERNS
    return named.select("row.doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).cast("long").alias("taken"))


def drawn(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as many times as it is taken, with its columns, whatever their names."""
    found = mixed(docs, F.array("source"), words(), **options)
    return found.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("row.*")
