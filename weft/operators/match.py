"""Blocked similarity joins: best and top-k matches, classes, populations and greedy unique sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions.vectors import l1_similarity
from weft.operators import metric, tiles
from weft.store import written

#: Rows of a side that is sent to all executors at most, and their numbers and characters; beyond, the join shuffles on the block.
BROADCAST_ROWS, BROADCAST_VALUES = 100_000, 16_000_000


def checked(side: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The side with a broadcast hint if a bounded look at it shows that it is small, in rows and in what they hold."""
    kinds = dict(side.dtypes)
    wide = [F.coalesce(F.greatest(F.size(f"`{c}`"), F.lit(0)) if kinds[c].startswith("array") else F.length(f"`{c}`"), F.lit(0)) for c in side.columns if kinds[c].startswith("array") or kinds[c] in ("string", "binary")]
    held = sum(wide, F.lit(len(side.columns))).cast("long")
    n, values = side.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(held), F.lit(0))).first()
    return F.broadcast(side) if n <= most and values <= BROADCAST_VALUES else side


def biatomic_score(left: Column, right: Column, tolerance: float = 0.1) -> Column:
    """1 - gap of two bond lengths, -1 beyond the tolerance or where a length is missing."""
    gap = F.abs(left - right)
    return F.coalesce(F.when(gap <= tolerance, 1 - gap).otherwise(-1.0), F.lit(-1.0))


def scored_pairs(targets: DataFrame, population: DataFrame, block: Sequence[str], score: Column | None = None, others: bool = False) -> DataFrame:
    """Pairs (id, fp) x (id, fp) within a block, with score; the population isn't shuffled while the targets are few.

    others: a target isn't its own partner.

    A population row that repeats counts once in any best match; ``of_population`` keeps it to a population. Rows
    without a fingerprint (NULL or empty) meet nothing.
    """
    return _pairs(checked(targets), population, block, score, others)


def _pairs(targets: DataFrame, population: DataFrame, block: Sequence[str], score: Column | None, others: bool) -> DataFrame:
    there = F.size("fp") > 0  # texts that were no vectors have none
    left = targets.where(there).select(*block, F.col("id").alias("target"), F.col("fp").alias("target_fp"), *[c for c in targets.columns if c.startswith("t_")])
    right = population.where(there).select(*block, F.col("id").alias("partner"), F.col("fp").alias("partner_fp"), *[c for c in population.columns if c.startswith("p_")])
    found = l1_similarity(F.col("target_fp"), F.col("partner_fp")) if score is None else score
    pairs = right.join(left, list(block))
    return (pairs.where("target <> partner") if others else pairs).withColumn("score", found)


def best_match(targets: DataFrame, population: DataFrame, block: Sequence[str], threshold: float, score: Column | tiles.Score | None = None, others: bool = False) -> DataFrame:
    """target, partner, score and class: matched, distorted or no_match. Ties go to the least partner.

    score: of the tiles (none: similarity), or an expression over joined pairs.
    A score of -1 is a distorted match without a partner; a target whose block has none is no_match.
    """
    pairs = scored_pairs(targets, population, block, score, others) if isinstance(score, Column) else tiles.best(targets, population, block, 1, score or tiles.l1, others)
    return _classed(targets, pairs, threshold)


def _classed(targets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    best = pairs.groupBy("target").agg(F.max(F.struct("score", (-F.col("partner")).alias("low"))).alias("x"))
    found = targets.select(F.col("id").alias("target")).join(best, "target", "left")
    value = F.col("x.score")
    kind = F.when(F.col("x").isNull(), "no_match").when(value >= threshold, "matched").otherwise("distorted")
    return found.select("target", F.when(value > -1, -F.col("x.low")).alias("partner"), F.coalesce(value, F.lit(-1.0)).alias("score"), kind.alias("class"))


def bucketed_best_match(targets: DataFrame, population: DataFrame, block: Sequence[str], threshold: float, score: Column | None = None, others: bool = False) -> DataFrame:
    """``best_match`` of two tables by ``files.write_blocks`` (targets copied over the salts): the join reads matching buckets,
    neither side is shuffled or broadcast; only the best of each target and bucket moves."""
    tagged = [*block, "salt"]
    pairs = _pairs(targets.hint("merge"), population, tagged, score, others)
    return _classed(targets.where("salt = 0"), pairs, threshold)


def top_matches(targets: DataFrame, population: DataFrame, block: Sequence[str], k: int = 3, score: Column | None = None, others: bool = False) -> DataFrame:
    """The k best partners of each target, ranked; ties by the least partner."""
    return _ranked(tiles.best(targets, population, block, k, others=others) if score is None else scored_pairs(targets, population, block, score, others), k)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("target").orderBy(F.desc("score"), "partner")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("target", "rank", "partner", "score")


def top_sets(targets: DataFrame, population: DataFrame, block: Sequence[str], k: int = 3, others: bool = False) -> DataFrame:
    """``top_matches`` of sets of texts (fp: array<string>) by their Tanimoto similarity."""
    return _ranked(tiles.best_sets(targets, population, block, k, others), k)


def exact_matches(targets: DataFrame, population: DataFrame, block: Sequence[str]) -> DataFrame:
    """Targets whose fingerprint occurs verbatim in the block."""
    return targets.join(population.select(*block, "fp").distinct(), [*block, "fp"], "left_semi")


def below(targets: DataFrame, population: DataFrame, threshold: float, block: Sequence[str] = (), others: bool = False) -> DataFrame:
    """A starting population: partners less similar than the threshold, the most similar first by (score, partner).

    Every target meets every entry, or those of its block.
    """
    return tiles.ranked(targets, population, block, threshold, others=others)


def of_population(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of a population given by its ids."""
    return rows.join(checked(ids.select("id").distinct()), "id", "left_semi")


def with_payload(matches: DataFrame, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Matches with columns of their partners, fetched only now that the best are known.

    No look is taken at the matches first: it would search for all of them once more. Adaptive execution sees their size.
    """
    payload = rows.select(F.col("id").alias("partner"), *columns)
    return payload.join(matches, "partner", "right").select(*matches.columns, *columns)


def first_matches(targets: DataFrame, population: DataFrame, block: Sequence[str], threshold: float, k: int = 3, others: bool = False) -> DataFrame:
    """Up to k partners of each target at or above the threshold, the least ids first; targets with none have no row.

    A target meets the least ids of its block first, and the others only if it has found fewer than k there.
    """
    search = lambda some, among: _least(tiles.within(some, among, block, lambda score: ~(score < threshold), others=others, first=k), k)  # noqa: E731  NaN is the greatest
    head, rest = tiles.headed(population, block)
    early = written(search(targets, head), "match-early")
    full = early.where(F.col("rank") == k).select(F.col("target").alias("id"))
    once = targets.where(F.size("fp") > 0).groupBy("id").count().where("count = 1")  # an id in two blocks: either may hold lesser ids
    late = search(targets.join(full.join(once, "id"), "id", "left_anti"), rest)
    return _least(early.unionByName(late), k)


def _least(pairs: DataFrame, k: int) -> DataFrame:
    found = pairs.withColumn("rank", F.row_number().over(W.partitionBy("target").orderBy("partner")))
    return found.where(F.col("rank") <= k).select("target", "rank", "partner", "score")


def classes(targets: DataFrame, population: DataFrame, block: Sequence[str], threshold: float, others: bool = False) -> DataFrame:
    """target and class as ``best_match`` has them, without a search for the best: the first partner at or above the threshold settles a target."""
    ends = population.where(F.size("fp") > 0).groupBy(*block).agg(F.min("id").alias("_low"), F.max("id").alias("_high"))
    there = targets.where(F.size("fp") > 0)
    met = there.join(ends, list(block)) if block else there.crossJoin(ends)
    if others:
        met = met.where("_low <> id OR _high <> id")
    found = first_matches(targets, population, block, threshold, 1, others).select("target", F.lit("matched").alias("_matched"))
    tagged = targets.select(F.col("id").alias("target")).join(found, "target", "left").join(met.select(F.col("id").alias("target"), F.lit("distorted").alias("_met")).distinct(), "target", "left")
    return tagged.select("target", F.coalesce("_matched", "_met", F.lit("no_match")).alias("class"))


def nearest_rescored(targets: DataFrame, population: DataFrame, block: Sequence[str], k: int = 3, others: bool = False, cut: float | None = None, cell_rows: int = metric.CELL_ROWS) -> DataFrame:
    """The k nearest by Euclidean distance, then ranked by similarity: not always the k most similar.

    cut: of the population only a unique set is searched, by this similarity.
    """
    if cut is not None:
        population = population.join(unique(population, block, "id", cut, cell_rows), [*block, "id"], "left_semi")
    near = metric.nearest(targets, population, block, k, others, cell_rows)
    scored = near.select("target", "partner", F.col("similarity").alias("score"), F.col("l2").alias("gap"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("target").orderBy(F.desc("score"), "partner"))).select("target", "rank", "partner", "score", "gap")


def wide_top(top: DataFrame, threshold: float, k: int = 3) -> DataFrame:
    """A row a target from ``top_matches``: its scores as columns, and whether the best reaches the threshold."""
    scores = [F.max(F.when(F.col("rank") == i, F.col("score"))).alias(f"score_{i}") for i in range(1, k + 1)]
    return top.groupBy("target").agg(*scores, F.max(F.col("score") >= threshold).alias("matched"))


def distinct_matched(targets: DataFrame, wide: DataFrame) -> DataFrame:
    """How many different fingerprints the matched targets have (``wide``: target and matched)."""
    return targets.join(wide.where("matched").select(F.col("target").alias("id")), "id", "left_semi").select("fp").distinct().agg(F.count("*").alias("n_matched_fp"))


def similar(targets: DataFrame, population: DataFrame, block: Sequence[str], low: float, high: float, others: bool = False) -> DataFrame:
    """Pairs of a block whose similarity is above low and at most high."""
    return tiles.within(targets, population, block, lambda score: (score > low) & (score <= high), others=others)


def counts_below(targets: DataFrame, population: DataFrame, block: Sequence[str], thresholds: dict[str, float], others: bool = False) -> DataFrame:
    """target, t (a threshold's name) and n: partners less similar than it, counted in parts; their sums are the counts."""
    found = tiles.counts(targets, population, block, list(thresholds.values()), others=others)
    return found.select("target", F.element_at(F.array(*map(F.lit, thresholds)), F.col("at") + 1).alias("t"), "n")


def unique(rows: DataFrame, block: Sequence[str], order: str, threshold: float, cell_rows: int = metric.CELL_ROWS) -> DataFrame:
    """Greedy unique set: in order, a row stays if its similarity to every row kept of its block is below the threshold."""
    return metric.unique(rows, block, order, threshold, cell_rows)


def close_pairs(rows: DataFrame, block: Sequence[str], key: str, least: float, cell_rows: int = metric.CELL_ROWS) -> DataFrame:
    """Pairs i < j of a block whose similarity is at least ``least``."""
    return metric.close_pairs(rows, block, key, least, cell_rows)


def centroid(rows: DataFrame, block: Sequence[str], vector: str = "fp") -> DataFrame:
    """The mean of each place, as rows (block, pos, mean)."""
    return rows.select(*block, F.posexplode(vector).alias("pos", "v")).groupBy(*block, "pos").agg(F.avg(F.col("v").cast("double")).alias("mean"))
