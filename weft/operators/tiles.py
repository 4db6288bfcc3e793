"""Vectors against vectors of their block, dealt over tasks in tiles.

Each block's rows are parted in strips of at most STRIP rows; a tile is a strip of one side and a strip of the other, and is
one group of a shuffle, so that a hot block is many tasks' work and no side is broadcast. A task holds one tile's rows and scores a slab of them at a
time, place by place in the order of the vector: sums are those of a fold over the vector, to the last bit. What leaves a tile
is what its reducer takes from the scores: the best few, those within bounds, or counts; a pair never carries its vectors.

Rows whose block has a NULL meet none, nor do rows without a vector (NULL or empty). A pair of vectors of different lengths, or
with a NULL within, has no score (NULL).
"""

from __future__ import annotations

import functools
import itertools
import os
import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.store import written

#: Rows of a strip at most, and its numbers; rows of a slab; columns, and bytes of sums, that are scored at a time (they fit in a core's cache).
STRIP, STRIP_VALUES = 8192, 1 << 22
SLAB, ACROSS, SUMS = 64, 4096, 1 << 18
#: Sums of coded vectors are less than this, which stands for none; pairs that are scored at a time; columns in which a search for the first few goes on.
CODED, PAIRS, STEP = 65535, 1 << 14, 1024
#: Scores that a task holds at a time where it sorts all of a target's.
HELD = 1 << 24
#: Strips that a block is folded in where they hold no more than STRIP_VALUES: so often its rows are moved, however many they are.
FOLDS = 6
#: Members of a strip of sets at most; sets that meet at a time; pairs of which one at least shares a member that is in the matrix; numbers of that matrix at most; sets of a long list.
MEMBERS, SET_SLAB, COMMON, MATRIX, LONG = 1 << 23, 64, 250, 1 << 24, 64

#: Scores of all of a matrix of vectors with all of another: the greater, the nearer.
Score = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _summed(a: np.ndarray, b: np.ndarray, term: Callable[[np.ndarray], object], kind: type = np.float64) -> np.ndarray:
    """The sum over the places of ``term`` of the differences, first place first; term works in place.

    kind: of the sums, as wide as the numbers. Places of b that lie side by side in memory (a ``Part``'s) are used as they are.
    """
    out = np.empty((len(a), len(b)), kind)
    places = b.T if b.strides[0] == b.itemsize else np.ascontiguousarray(b.T)
    down = max(1, SUMS // (out.itemsize * max(1, min(len(b), ACROSS))))
    for top in range(0, len(a), down):
        left = np.ascontiguousarray(a[top : top + down].T)[:, :, None]
        for start in range(0, len(b), ACROSS):
            across = places[:, start : start + ACROSS]
            gap = np.empty((left.shape[1], across.shape[1]), a.dtype)
            total, plain = np.zeros(gap.shape, kind), gap.view(kind)
            for x, y in zip(left, across, strict=True):
                np.subtract(x, y, out=gap)
                term(gap)
                total += plain
            out[top : top + down, start : start + ACROSS] = total
    return out


def l1_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _summed(a, b, lambda gap: np.abs(gap, out=gap))


def l1(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 / (1 + mean |a - b|), as ``vectors.l1_similarity``."""
    return 1.0 / (1.0 + l1_sum(a, b) / a.shape[1])


def l1_paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same of one row with one row."""
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        total += np.abs(x - y)
    return 1.0 / (1.0 + total / a.shape[1])


def l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Euclidean distance less than zero, as the greater is the nearer."""
    return -np.sqrt(_summed(a, b, lambda gap: np.multiply(gap, gap, out=gap)))


def lengths(tolerance: float) -> Score:
    """1 - gap of two bond lengths (vectors of one place), -1 beyond the tolerance or where a length is missing (NaN)."""

    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        gap = np.abs(a - b.T)
        return np.where(gap <= tolerance, 1 - gap, -1.0)

    return score


def parallel(rows: DataFrame) -> int:
    return 4 * rows.sparkSession.sparkContext.defaultParallelism


def _strips(n: str, values: str, most: int | None = None) -> Column:
    return F.greatest(F.ceil(F.col(n) / STRIP), F.ceil(F.col(values) / (most or STRIP_VALUES))).cast("int")


def _side(rows: DataFrame, keys: Sequence[str], key: str, flag: str | None) -> DataFrame:
    there = functools.reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.size("fp") > 0)
    vector = F.col("fp") if dict(rows.dtypes)["fp"] == "array<string>" else F.col("fp").cast("array<double>")
    return rows.where(there).select(*keys, F.col(key).alias("_id"), vector.alias("_fp"), (F.col(flag) if flag else F.lit(True)).alias("_flag"))


def _sizes(side: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return side.groupBy(*keys).agg(F.count("*").alias(f"_n{name}"), F.sum(F.size("_fp")).alias(f"_v{name}"))


def _number(n: str) -> Column:
    return F.pmod(F.xxhash64("_id"), F.col(n)).cast("int")


def _every(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _tiles(parts: DataFrame, keys: Sequence[str], finer: int = 1) -> DataFrame:
    at = [*keys, "_s", "_t"]
    return parts.repartition(finer * parallel(parts), *at).sortWithinPartitions(*at, "_right", "_id")


def crossed(targets: DataFrame, population: DataFrame, block: Sequence[str], values: int | None = None, finer: int = 1) -> DataFrame:
    """Rows of both sides (id, fp, block columns) in the tiles in which they meet: every target with every row of its block once.

    values: of a strip at most; finer: so many times the usual tasks, for tiles that take long.
    """
    keys = [f"_k{i}" for i in range(len(block))]
    named = lambda rows: rows.select(*(F.col(b).alias(k) for b, k in zip(block, keys, strict=True)), "id", "fp")
    left, right = _side(named(targets), keys, "id", None), _side(named(population), keys, "id", None)
    sizes = _sizes(left, keys, "l").join(_sizes(right, keys, "r"), keys) if keys else _sizes(left, keys, "l").crossJoin(_sizes(right, keys, "r"))
    sizes = written(sizes.where("_nl > 0 AND _nr > 0").select(*keys, _strips("_nl", "_vl", values).alias("_l"), _strips("_nr", "_vr", values).alias("_r")), "tile-sizes")  # where they are seen to be few, rows aren't shuffled to meet them
    met = lambda side: side.join(sizes, keys) if keys else side.crossJoin(sizes)
    both = met(left).select(*keys, _number("_l").alias("_s"), _every("_r").alias("_t"), F.lit(False).alias("_right"), "_id", "_fp", "_flag")
    return _tiles(both.unionByName(met(right).select(*keys, _every("_l").alias("_s"), _number("_r").alias("_t"), F.lit(True).alias("_right"), "_id", "_fp", "_flag")), keys, finer)


def folded(rows: DataFrame, block: Sequence[str], key: str, flag: str | None = None) -> DataFrame:
    """Rows of one table in tiles of two of its strips: any two rows of a block meet in one tile; in a tile of a strip with itself all its rows are left.

    Strips are as long as a task can hold rather than more than FOLDS, as a row is moved once for each.
    """
    keys = [f"_k{i}" for i in range(len(block))]
    side = _side(rows.select(*(F.col(b).alias(k) for b, k in zip(block, keys, strict=True)), key, "fp", *([flag] if flag else [])), keys, key, flag)
    few = F.greatest(F.least(F.ceil(F.col("_nl") / STRIP), F.lit(FOLDS)), F.ceil(F.col("_vl") / STRIP_VALUES)).cast("int")
    sizes = written(_sizes(side, keys, "l").select(*keys, few.alias("_l")), "tile-sizes")
    numbered = side.join(sizes, keys).withColumn("_own", _number("_l"))
    met = numbered.select(*keys, "_own", _every("_l").alias("_other"), "_id", "_fp", "_flag")
    return _tiles(met.select(*keys, F.least("_own", "_other").alias("_s"), F.greatest("_own", "_other").alias("_t"), (F.col("_own") > F.col("_other")).alias("_right"), "_id", "_fp", "_flag"), keys)


class Part:
    """Rows of one side of a tile that have vectors of one length, in order of their ids."""

    def __init__(self, rows: pa.Table):
        self.ids = rows.column("_id").combine_chunks()
        self.flags = rows.column("_flag").to_numpy()
        column = rows.column("_fp").combine_chunks()
        self.data = np.asfortranarray(column.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1))

    def flagged_first(self) -> Part:
        """Rows with the flag before the others."""
        order = np.argsort(~self.flags, kind="stable")
        self.ids, self.flags, self.data = self.ids.take(pa.array(order)), self.flags[order], np.asfortranarray(self.data[order])
        return self


def _parts(rows: pa.Table) -> tuple[dict[int, Part], pa.Array]:
    """The rows by the length of their vectors, and all their ids; rows with a NULL within are in no part."""
    if not rows.num_rows:
        return {}, rows.column("_id").combine_chunks()
    column = rows.column("_fp").combine_chunks()
    width = pc.list_value_length(column).to_numpy(zero_copy_only=False).copy()
    if column.flatten().null_count:
        width[np.unique(pc.list_parent_indices(column).to_numpy()[column.flatten().is_null().to_numpy(zero_copy_only=False)])] = -1
    kinds = np.unique(width)
    return {int(w): Part(rows if len(kinds) == 1 else rows.take(np.flatnonzero(width == w))) for w in kinds if w > 0}, rows.column("_id").combine_chunks()


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted rows of one tile after the other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = [c for c in batch.schema.names if c.startswith("_k") or c in ("_s", "_t")]
        starts = np.zeros(batch.num_rows, bool)
        for c in at:
            column = batch.column(c)
            column = column.dictionary_encode().indices  # of which NaN is one value
            starts[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
        first = [repr(batch.column(c)[0]) for c in at]
        cuts = [0, *np.flatnonzero(starts).tolist(), batch.num_rows]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if held and (i or first != last):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = [repr(batch.column(c)[batch.num_rows - 1]) for c in at]
    if held:
        yield pa.Table.from_batches(held)


def _sides(tile: pa.Table) -> tuple[pa.Table, pa.Table]:
    right = tile.column("_right").to_numpy()
    n = len(right) - int(right.sum())
    return tile.slice(0, n), tile.slice(n)


def _own(left: Part, right: Part) -> tuple[np.ndarray, np.ndarray]:
    """A number for each id on the right, and the same for each id on the left, -1 for those that the right lacks."""
    coded = right.ids.dictionary_encode()
    return pc.fill_null(pc.index_in(left.ids, coded.dictionary), -1).to_numpy(), coded.indices.to_numpy()


def _slabs(left: Part, right: Part, score: Score, others: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Scores of a slab's rows with all of the right, and where the slab begins; -inf at a row and itself if others."""
    same, codes = _own(left, right)
    for start in range(0, len(left.ids), SLAB):
        found = score(left.data[start : start + SLAB], right.data)
        if others:
            found[_among(same[start : start + SLAB], codes)] = -np.inf
        yield start, found


def _among(own: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places (row, column) of a slab at which a row meets itself."""
    rows = np.flatnonzero(own >= 0)
    i, j = np.nonzero(own[rows, None] == codes)
    return rows[i], j


def _coded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Both as whole numbers of one scale, whose sums of differences fit in 16 bits and are off by no more than 1 a place; None where that tells little."""
    top = min(32767, (CODED - 1) // a.shape[1])
    low = np.minimum(a.min(axis=0), b.min(axis=0))
    with np.errstate(all="ignore"):
        scale = top / (np.maximum(a.max(axis=0), b.max(axis=0)) - low).max()
    if top < 64 or not 0 < scale < np.inf:  # long vectors; NaN, infinite or equal numbers
        return None
    return tuple(np.rint((x - low) * scale).astype(np.int16, order="F") for x in (a, b))


def _few(left: Part, right: Part, k: int, others: bool, coded: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of both sides and their ``l1``: the k best of each row on the left, ties by the least id.

    Coded vectors tell which pairs may be among them, in a sixth of the time of all scores; only those are scored.
    """
    same, codes = _own(left, right)
    n, width = len(right.ids), left.data.shape[1]
    for start in range(0, len(left.ids), SLAB):
        slab = left.data[start : start + SLAB]
        sums = _summed(coded[0][start : start + SLAB], coded[1], lambda gap: np.abs(gap, out=gap), np.uint16)
        if others:
            sums[_among(same[start : start + SLAB], codes)] = CODED
        least = sums[:, : n // 64 * 64].reshape(len(sums), -1, 64).min(axis=1) if n >= 128 and k <= 64 else sums  # the k-th least of some is at least that of all
        most = np.partition(least, k - 1, axis=1)[:, k - 1].astype(np.int64) + 2 * (width + 1) if k <= least.shape[1] else np.full(len(sums), CODED)
        i, j = np.divmod(np.flatnonzero(sums <= np.minimum(most, CODED - 1).astype(np.uint16)[:, None]), n)
        if 8 * len(i) > sums.size:
            value = l1(slab, right.data)[i, j]
        else:
            value = np.concatenate([np.empty(0), *(l1_paired(slab[i[x : x + PAIRS]], right.data[j[x : x + PAIRS]]) for x in range(0, len(i), PAIRS))])
        order = np.lexsort((j, -value, i))
        i, j, value = i[order], j[order], value[order]
        some = np.arange(len(i)) - np.searchsorted(i, i) < k
        yield start + i[some], j[some], value[some]


def _mapped(tiles: DataFrame, schema: str, of_tile: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(invalid="ignore"):
            for tile in _grouped(batches):
                yield from of_tile(*_sides(tile))

    return tiles.mapInArrow(run, schema)


def _kind(rows: DataFrame, column: str = "id") -> str:
    return rows.schema[column].dataType.simpleString()


def best(targets: DataFrame, population: DataFrame, block: Sequence[str], k: int, score: Score = l1, others: bool = False, paired: Score | None = None) -> DataFrame:
    """target, partner and score: of each tile the k best of each target, ties by the least partner; pairs without a score come last. The k best of all are among them.

    paired: also the similarity of each by this.
    """
    names = ["target", "partner", "score", *(["similarity"] if paired else [])]

    def top(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        (lefts, _), (rights, there) = _parts(left), _parts(right)
        for w in lefts.keys() & rights.keys():
            a, b = lefts[w], rights[w]
            coded = _coded(a.data, b.data) if score is l1 and not paired else None
            if coded:
                for i, j, value in _few(a, b, k, others, coded):
                    yield pa.record_batch([a.ids.take(pa.array(i)), b.ids.take(pa.array(j)), pa.array(value)], names)
                continue
            for start, found in _slabs(a, b, score, others):
                rows = np.arange(len(found))
                for _ in range(min(k, found.shape[1])):
                    pick = found.argmax(axis=1)  # NaN is the greatest, as in Spark
                    value = found[rows, pick]
                    real = value != -np.inf
                    yield pa.record_batch([a.ids.take(pa.array(start + rows[real])), b.ids.take(pa.array(pick[real])), pa.array(value[real]), *([pa.array(paired(a.data[start + rows[real]], b.data[pick[real]]))] if paired else [])], names)
                    found[rows, pick] = -np.inf
        if lefts.keys() == rights.keys() and all(len(p.ids) == side.num_rows for side, parts in ((left, lefts), (right, rights)) for p in parts.values()):
            return
        held = {w: set(p.ids.to_pylist()) for w, p in rights.items()}
        of = {t: w for w, p in lefts.items() for t in p.ids.to_pylist()}
        partners = there.to_pylist()
        for t in left.column("_id").to_pylist():
            some = held.get(of.get(t), ())
            if len(some) <= k:
                rest = list(itertools.islice((p for p in partners if p not in some and not (others and p == t)), k))
                yield pa.record_batch([pa.array([t] * len(rest), left.schema.field("_id").type), pa.array(rest, there.type), *([pa.nulls(len(rest), pa.float64())] * (len(names) - 2))], names)

    return _mapped(crossed(targets, population, block), f"target {_kind(targets)}, partner {_kind(population)}, score double" + ", similarity double" * bool(paired), top)


def best_sets(targets: DataFrame, population: DataFrame, block: Sequence[str], k: int, others: bool = False) -> DataFrame:
    """``best`` of sets of texts (fp: array<string> without copies or NULLs) by members shared over all members; each id stands once in a block.

    Members that many pairs share are places of a matrix of zeros and ones, whose products count them; the others are met by lists of the sets on the
    right that hold them. Which is which goes by their pairs, so that either part takes about as long.
    """

    def top(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        if not left.num_rows or not right.num_rows:
            return
        columns = [side.column("_fp").combine_chunks() for side in (left, right)]
        sizes = [pc.list_value_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
        ids, partners = left.column("_id").combine_chunks(), right.column("_id").combine_chunks()
        known = columns[0].flatten().dictionary_encode()
        mine, theirs = known.indices.to_numpy(), pc.fill_null(pc.index_in(columns[1].flatten(), known.dictionary), -1).to_numpy()
        n_codes, width = len(known.dictionary), len(partners)
        del columns, known
        met = theirs >= 0
        theirs, whose = theirs[met], np.repeat(np.arange(width), sizes[1])[met]
        held = np.bincount(theirs, minlength=n_codes)
        meetings = np.bincount(mine, minlength=n_codes) * held
        common = np.flatnonzero(meetings * COMMON > len(ids) * width)
        most = max(1, MATRIX // width)
        if len(common) > most:
            common = common[np.argpartition(-meetings[common], most)[:most]]
        place = np.full(n_codes, -1, np.int32)
        place[common] = np.arange(len(common))
        at = place[theirs]
        matrix = np.zeros((len(common), width), np.float32)  # sums of ones are whole up to 2 ** 24, more than a strip has members
        matrix[at[at >= 0], whose[at >= 0]] = 1
        theirs, whose = theirs[at < 0], whose[at < 0]
        listed = whose[np.argsort(theirs, kind="stable")]
        held[common] = 0
        stops = np.cumsum(held)
        begins = stops - held
        same = pc.fill_null(pc.index_in(ids, partners), -1).to_numpy()
        ends = np.concatenate(([0], np.cumsum(sizes[0])))
        for start in range(0, len(ids), SET_SLAB):
            n = min(SET_SLAB, len(ids) - start)
            own, row = mine[ends[start] : ends[start + n]], np.repeat(np.arange(n), sizes[0][start : start + n])
            at = place[own]
            holds = np.zeros((n, len(common)), np.float32)
            holds[row[at >= 0], at[at >= 0]] = 1
            shared = holds @ matrix
            for i in range(n):
                rare = mine[ends[start + i] : ends[start + i + 1]]
                few = held[rare]
                short, n_short, long = rare[few < LONG], few[few < LONG], rare[few >= LONG]
                sums = np.cumsum(n_short)
                lists = [listed[np.arange(n_short.sum()) + np.repeat(stops[short] - sums, n_short)]]
                lists += [listed[x:y] for x, y in zip(begins[long].tolist(), stops[long].tolist(), strict=True)]
                shared[i] += np.bincount(np.concatenate(lists), minlength=width)
            found = shared / (sizes[0][start : start + n, None] + sizes[1] - shared)
            i = np.arange(n)
            if others:
                self_at = same[start : start + n]
                found[i[self_at >= 0], self_at[self_at >= 0]] = -np.inf
            for _ in range(min(k, width)):
                pick = found.argmax(axis=1)
                value = found[i, pick]
                real = value != -np.inf
                yield pa.record_batch([ids.take(pa.array(start + i[real])), partners.take(pa.array(pick[real])), pa.array(value[real])], ["target", "partner", "score"])
                found[i, pick] = -np.inf

    return _mapped(crossed(targets, population, block, MEMBERS, 4), f"target {_kind(targets)}, partner {_kind(population)}, score double", top)


def _pairs(left: pa.Table, right: pa.Table, score: Score, others: bool) -> Iterator[tuple[Part, Part, int, np.ndarray]]:
    (lefts, _), (rights, _) = _parts(left), _parts(right)
    for w in lefts.keys() & rights.keys():
        for start, found in _slabs(lefts[w], rights[w], score, others):
            yield lefts[w], rights[w], start, found


def within(targets: DataFrame, population: DataFrame, block: Sequence[str], test: Callable[[np.ndarray], np.ndarray], score: Score = l1, others: bool = False, first: int | None = None) -> DataFrame:
    """target, partner and score of the pairs whose score passes the test; with first, of each tile that many of each target at most, the least partners."""

    def passed(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        for a, b, start, found in _pairs(left, right, score, others):
            i, j = np.nonzero(test(found) & (found != -np.inf))
            yield pa.record_batch([a.ids.take(pa.array(start + i)), b.ids.take(pa.array(j)), pa.array(found[i, j])], ["target", "partner", "score"])

    def least(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        (lefts, _), (rights, _) = _parts(left), _parts(right)
        for w in lefts.keys() & rights.keys():
            a, b = lefts[w], rights[w]
            same, codes = _own(a, b)
            n, wanting = np.zeros(len(a.ids), np.int64), np.arange(len(a.ids))
            for at in range(0, len(b.ids), STEP):  # partners in their order, for the targets that have too few
                part = np.asfortranarray(b.data[at : at + STEP])
                for start in range(0, len(wanting), SLAB):
                    rows = wanting[start : start + SLAB]
                    found = score(a.data[rows], part)
                    if others:
                        found[_among(same[rows], codes[at : at + STEP])] = -np.inf
                    good = test(found) & (found != -np.inf)
                    good &= good.cumsum(axis=1) <= first - n[rows, None]
                    n[rows] += good.sum(axis=1)
                    i, j = np.nonzero(good)
                    yield pa.record_batch([a.ids.take(pa.array(rows[i])), b.ids.take(pa.array(at + j)), pa.array(found[i, j])], ["target", "partner", "score"])
                wanting = wanting[n[wanting] < first]
                if not len(wanting):
                    break

    return _mapped(crossed(targets, population, block), f"target {_kind(targets)}, partner {_kind(population)}, score double", passed if first is None else least)


def headed(population: DataFrame, block: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with the least ids of each block, about a strip of them, and the others; a small block is all in the first.

    The last id of the first comes from eight samples of one row in STRIP: of their least ids the sixth.
    """
    there = population.where(F.size("fp") > 0)
    samples = [F.min(F.when(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(STRIP)) == 0, F.col("id"))) for i in range(8)]
    last = written(there.groupBy(*block).agg(F.array_sort(F.array(*samples))[5].alias("_last")), "tile-marks")
    marked = there.join(last, list(block)) if block else there.crossJoin(last)
    later = F.coalesce(F.col("id") > F.col("_last"), F.lit(False))
    return marked.where(~later).drop("_last"), marked.where(later).drop("_last")


def counts(targets: DataFrame, population: DataFrame, block: Sequence[str], below: Sequence[float], score: Score = l1, others: bool = False) -> DataFrame:
    """target, at (a place in ``below``) and n: how many of a tile's partners score less; targets without a partner have no row."""

    def counted(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, partners = left.column("_id").combine_chunks(), set(right.column("_id").to_pylist()) if others and right.num_rows < 2 else None
        if not right.num_rows:
            return
        some = ids if partners is None else ids.filter(pa.array([bool(partners - {t}) for t in ids.to_pylist()], pa.bool_()))
        for at in range(len(below)):  # every target with a partner is told of
            yield pa.record_batch([some, pa.array(np.full(len(some), at, np.int32)), pa.array(np.zeros(len(some), np.int64))], ["target", "at", "n"])
        for a, _, start, found in _pairs(left, right, score, others):
            real = found != -np.inf
            for at, limit in enumerate(below):
                n = ((found < limit) & real).sum(axis=1)
                yield pa.record_batch([a.ids.slice(start, len(n)), pa.array(np.full(len(n), at, np.int32)), pa.array(n.astype(np.int64))], ["target", "at", "n"])

    return _mapped(crossed(targets, population, block), f"target {_kind(targets)}, at int, n long", counted)


class Stored:
    """Vectors of one length of a block, in a file that goes with its task; strip by strip, a strip's places side by side."""

    def __init__(self, file, width: int):
        self.file, self.width, self.strips, self.rest, self.n = file, width, [], [], 0

    def add(self, part: Part) -> None:
        self.rest.append(part)
        self.n += len(part.ids)
        if sum(len(p.ids) for p in self.rest) >= STRIP:
            self.flush()

    def flush(self) -> None:
        if self.rest:
            ids, data = pa.concat_arrays([p.ids for p in self.rest]), np.concatenate([p.data for p in self.rest])
            self.strips.append((self.file.seek(0, 2), ids))
            self.file.write(np.ascontiguousarray(data.T))
            self.rest = []

    def __iter__(self) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Ids and vectors of each strip."""
        for at, ids in self.strips:
            self.file.seek(at)
            yield ids, np.frombuffer(self.file.read(8 * self.width * len(ids))).reshape(self.width, -1).T


def ranked(targets: DataFrame, population: DataFrame, block: Sequence[str], below: float, score: Score = l1, others: bool = False) -> DataFrame:
    """target, partner and score of the pairs that score less than ``below``, by target, the greatest score first, then partner.

    A task has a range of the targets' ids, and all rows of their blocks in a file of its own; it scores and sorts a few targets' partners at a time. So
    no pair is moved, only vectors are, once for each range of which there are two a core.
    """
    t, p = _kind(targets), _kind(population)
    keys = [f"_k{i}" for i in range(len(block))]
    named = lambda rows: rows.select(*(F.col(b).alias(k) for b, k in zip(block, keys, strict=True)), "id", "fp")

    def listed(rows: pa.Table, held: dict[tuple, dict[int, Stored]]) -> Iterator[pa.RecordBatch]:
        lists: dict[object, list[tuple[np.ndarray, pa.Array]]] = {}
        blocks = list(zip(*(map(repr, rows.column(k)) for k in keys), strict=True)) if keys else [()] * rows.num_rows
        for b in dict.fromkeys(blocks):
            for w, part in _parts(rows.take(pa.array([i for i, x in enumerate(blocks) if x == b])))[0].items():
                stored = held.get(b, {}).get(w)
                if stored is None:
                    continue
                for start in range(0, len(part.ids), step := max(1, min(SLAB, HELD // stored.n))):  # more than a step only where an id repeats
                    some, scores, at = part.ids.slice(start, step), np.empty((min(step, len(part.ids) - start), stored.n)), 0
                    for ids, data in stored:
                        found = score(part.data[start : start + step], data)
                        if others:
                            coded = ids.dictionary_encode()
                            found[_among(pc.fill_null(pc.index_in(some, coded.dictionary), -1).to_numpy(), coded.indices.to_numpy())] = -np.inf
                        scores[:, at : at + len(ids)] = np.where((found < below) & (found != -np.inf), found, np.inf)
                        at += len(ids)
                    partners = pa.chunked_array([ids for _, ids in stored.strips]).combine_chunks()
                    for target, row in zip(some.to_pylist(), scores, strict=True):
                        real = np.flatnonzero(row != np.inf)
                        lists.setdefault(target, []).append((row[real], partners.take(pa.array(real))))
        for target in dict.fromkeys(rows.column("_id").to_pylist()):
            if target not in lists:
                continue
            values, partners = np.concatenate([v for v, _ in lists[target]]), pa.concat_arrays([x for _, x in lists.pop(target)])
            order = np.argsort(-values)
            if (np.diff(values[order]) == 0).any():  # ties are for the least partner
                order = pc.sort_indices(pa.table([values, partners], ["s", "p"]), [("s", "descending"), ("p", "ascending")]).to_numpy()
            for a in range(0, len(order), 1 << 18):
                some = pa.array(order[a : a + (1 << 18)])
                yield pa.record_batch([pa.array([target], rows.schema.field("_id").type).take(pa.array(np.zeros(len(some), np.int32))), partners.take(some), pa.array(values[order[a : a + (1 << 18)]])], ["target", "partner", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        held: dict[tuple, dict[int, Stored]] = {}
        waiting: list[pa.Table] = []
        with np.errstate(invalid="ignore"), tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None) as file:
            for batch in batches:
                asks = batch.column("_right").to_numpy(zero_copy_only=False)
                n = len(asks) - int(asks.sum())
                for rows in _grouped(iter([batch.slice(0, n)])):  # the population, block by block
                    sets = held.setdefault(tuple(repr(rows.column(k)[0]) for k in keys), {})
                    for w, part in _parts(rows)[0].items():
                        sets.setdefault(w, Stored(file, w)).add(part)
                if n == len(asks):
                    continue
                for sets in held.values():
                    for stored in sets.values():
                        stored.flush()
                most = max(1, max((x.n for sets in held.values() for x in sets.values()), default=1))
                step = max(1, min(SLAB * len(held), HELD // most))  # a slab of each block
                rows = pa.concat_tables([*waiting, pa.Table.from_batches([batch.slice(n)])])
                ids = rows.column("_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                firsts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))  # an id's rows are kept together
                start = 0
                for first in firsts[1:].tolist():
                    if first - start >= step:
                        yield from listed(rows.slice(start, first - start), held)
                        start = first
                waiting = [rows.slice(start)]
            for rows in waiting:
                yield from listed(rows, held)

    n = parallel(targets) // 2
    ids = targets.select("id").where("id IS NOT NULL")
    spread = ids.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 100 * n / max(1, ids.count())))).distinct().limit(1000 * n)
    sample = sorted(r["id"] for r in spread.collect())
    marks = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []
    to = F.size(F.filter(F.array(*map(F.lit, marks)), lambda m: m <= F.col("_id"))) if marks else F.lit(0)
    left = _side(named(targets), keys, "id", None).withColumn("_to", to)
    asked = written(left.select(*keys, "_to").distinct(), "tile-ranges")
    right = _side(named(population), keys, "id", None)
    met = right.join(asked, keys) if keys else right.crossJoin(asked)
    columns = [*keys, "_to", "_id", "_fp", "_flag"]
    both = met.select(*columns, F.lit(False).alias("_right")).unionByName(left.select(*columns, F.lit(True).alias("_right")))
    placed = both.repartitionById(len(marks) + 1, "_to").sortWithinPartitions("_right", F.when(F.col("_right"), F.col("_id")), *keys)
    both = _kind(placed, "_id")  # the wider one, where the sides' ids differ in type
    return placed.mapInArrow(run, f"target {both}, partner {both}, score double").select(F.col("target").cast(t), F.col("partner").cast(p), "score")


def near_pairs(parts: DataFrame, kind: str, names: Sequence[str | None], least: float) -> DataFrame:
    """The block's columns that have a name, and i < j of the pairs of ``folded`` rows that are at least so similar, where the flag of i is set."""
    keys = [(f.name, n, f.dataType) for f, n in zip((f for f in parts.schema if f.name.startswith("_k")), names, strict=True) if n is not None]
    columns = [*(n for _, n, _ in keys), "i", "j"]

    def pairs(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        any_row = left if left.num_rows else right
        whole = any_row.column("_s")[0] == any_row.column("_t")[0]  # a strip with itself
        lefts = {w: p.flagged_first() for w, p in _parts(left)[0].items()}
        rights = lefts if whole else {w: p.flagged_first() for w, p in _parts(right)[0].items()}
        block = [any_row.column(k)[0] for k, _, _ in keys]
        for w in lefts.keys() & rights.keys():
            a, b = lefts[w], rights[w]
            lower, upper = _order(a.ids, b.ids)
            for start in range(0, len(a.ids), SLAB):
                skip = start if whole else 0
                end = len(b.ids) if a.flags[start] else int(b.flags.sum())  # of two rows one is at home, or the pair counts elsewhere
                for at in range(skip, end, STRIP):
                    i, j = np.nonzero(l1(a.data[start : start + SLAB], b.data[at : min(at + STRIP, end)]) >= least)
                    i, j = i + start, j + at
                    ahead = lower[i] < upper[j]
                    good = np.where(ahead, a.flags[i], b.flags[j]) & (lower[i] != upper[j])
                    if whole:
                        good &= i < j
                    i, j, ahead = pa.array(i[good]), pa.array(j[good]), pa.array(ahead[good])
                    x, y = a.ids.take(i), b.ids.take(j)
                    yield pa.record_batch([*(pa.repeat(v, len(i)) for v in block), pc.if_else(ahead, x, y), pc.if_else(ahead, y, x)], columns)

    schema = ", ".join([*(f"`{n}` {t.simpleString()}" for _, n, t in keys), f"i {kind}", f"j {kind}"])
    return _mapped(parts, schema, pairs)


def _order(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the ids of both sides among all of them."""
    both = pa.concat_arrays([a, b])
    ranks = pc.rank(both, tiebreaker="dense").to_numpy().astype(np.int64)
    return ranks[: len(a)], ranks[len(a) :]
