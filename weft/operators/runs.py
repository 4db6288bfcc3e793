"""A comparison run, from targets and a population to counters and SDF files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import texts
from weft.operators import match, results, tiles
from weft.store import written


def bond_length(sdf: Column) -> Column:
    """The distance of the two atoms of a record; NULL for records of other sizes or without places."""
    lines = F.split(F.regexp_replace(sdf, r"^\n", ""), r"\r?\n")
    place = lambda line, i: F.trim(F.substring(F.get(lines, line), 1 + 10 * i, 10)).try_cast("double")
    gap = F.sqrt(sum(((place(4, i) - place(5, i)) * (place(4, i) - place(5, i)) for i in range(3)), F.lit(0.0)))
    return F.when(texts.sdf_atoms(sdf) == 2, gap)


def compared(targets: DataFrame, population: DataFrame, block: Sequence[str], threshold: float = 0.99, unique: float | None = 0.999, tolerance: float = 0.1) -> DataFrame:
    """The best partner of each unique environment of each owner: owner, target, partner, score, class, the records of both and their lengths' gap.

    targets (owner, id, block columns, n_atoms among them, fp, sdf), population (id, block columns, fp, sdf). Environments of two
    atoms are compared by their bond lengths, others by their fingerprints. Where no partner is within the tolerance,
    a target of two atoms is distorted, without one. unique: an owner's targets are first cut to those less similar than this.
    """
    lengths = lambda rows, name: rows.withColumn(name, bond_length(F.col("sdf")))
    if unique is not None:
        first = match.unique(targets, ["owner", *block], "id", unique)
        targets = targets.join(first.select("id"), "id", "left_semi")
    held = written(lengths(targets, "t_length").withColumn("t_two", F.col("n_atoms") == 2), "run-targets")
    there = lengths(population, "p_length")
    by_length = lambda rows, name: rows.withColumn("fp", F.when(F.size("fp") > 0, F.array(F.coalesce(F.col(name), F.lit(float("nan"))))))
    two = F.coalesce("t_two", F.lit(False))
    near = match.best_match(by_length(held.where(two), "t_length"), by_length(there, "p_length"), block, threshold, tiles.lengths(tolerance))
    best = written(near.unionByName(match.best_match(held.where(~two), population, block, threshold)), "run-best")
    facts = held.select(F.col("id").alias("target"), "owner", F.col("t_two").alias("two"), F.col("sdf").alias("target_sdf"), F.col("t_length").alias("length"))
    rows = best.join(facts, "target")
    found = match.with_payload(rows, lengths(population, "partner_length"), ["sdf", "partner_length"])
    kind = F.when(F.col("two") & (F.col("class") == "distorted") & F.col("partner").isNotNull(), "matched").otherwise(F.col("class"))
    return found.select("owner", "target", "partner", "score", kind.alias("class"), "two", "target_sdf", F.col("sdf").alias("partner_sdf"), F.abs(F.col("length") - F.col("partner_length")).alias("gap"))


def counters(run: DataFrame) -> DataFrame:
    """matched, distorted, no_match and total of each owner."""
    return results.class_counts(run, "owner")


def write_matches(run: DataFrame, path: str) -> None:
    """A folder a target, owner=.../target=...: its record, then its partner's with its tags; all owners in one job.

    A partner of two atoms has DistanceDifference, any other Similarity; DistortedMatch is there where the match is distorted.
    """
    plain = lambda text: F.concat(F.rtrim(F.regexp_replace(text, r"\s*\$\$\$\$\s*$", "")), F.lit("\n"))
    tag = lambda name, value: F.concat(F.lit(f"> <{name}>\n"), value, F.lit("\n\n"))
    likeness = F.when(F.col("two"), tag("DistanceDifference", F.coalesce(F.format_string("%.4f", F.col("gap")), F.lit("ERROR")))).otherwise(tag("Similarity", F.format_string("%.4f", F.col("score"))))
    distorted = F.when(F.col("class") == "distorted", tag("DistortedMatch", F.lit("True"))).otherwise("")
    partner = F.when(F.col("partner_sdf").isNotNull(), F.concat(plain(F.col("partner_sdf")), likeness, distorted, F.lit("$$$$")))
    records = F.filter(F.array(F.concat(plain(F.col("target_sdf")), F.lit("$$$$")), partner), lambda x: x.isNotNull())
    run.select("owner", "target", F.array_join(records, "\n").alias("value")).repartition("owner", "target").write.mode("overwrite").partitionBy("owner", "target").text(path)


def write_populations(rows: DataFrame, path: str, thresholds: Sequence[float]) -> None:
    """Lists "id smiles similarity" of several targets and thresholds in one job: a folder a target and threshold, the most similar first.

    rows (target, entry_id, smiles, similarity); an entry is in the list of every threshold above its similarity. A list is one file, as whoever
    reads it needs its order; lists are dealt over tasks.
    """
    named = F.array(*(F.struct(F.lit(t).alias("at"), F.lit(f"{t:g}".replace(".", "_")).alias("threshold")) for t in thresholds))
    each = rows.withColumn("_t", F.explode(named)).where(F.col("similarity") < F.col("_t.at"))
    line = F.concat_ws(" ", "entry_id", "smiles", texts.shown(F.col("similarity"), 4))
    dealt = each.select("target", "_t.threshold", "similarity", "entry_id", line.alias("value")).repartition("target", "threshold")
    dealt.sortWithinPartitions("target", "threshold", F.desc("similarity"), "entry_id").select("target", "threshold", "value").write.mode("overwrite").partitionBy("target", "threshold").text(path)
