"""Facts from logs, SDF files and sectioned texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions import texts

#: The messages of the match log and the population log.
TARGET = r"Target: (\S+)"
UNIQUE = r"Unique target CAEs: (\d+)"
MATCHED = r"Matched (\d+)/(\d+) CAEs"
DISTORTED = r"(\d+) matched only as Distorted Matches"
MISSING = r"(\d+) had no population CAE"
POPULATION = r"(?i)Number of final molecules for (\S+): (\d+)"


def filled(lines: DataFrame, label: Column, by: list[str], order: str, width: int = 1 << 16) -> DataFrame:
    """Each line with the last label at or before it in its file, as ``section``.

    A scan in two steps: stretches of ``width`` places of the order, a whole number, are filled alone, and the last label of each
    is carried to the ones after it as a line of its own before their first. No task orders more than one stretch, or one
    row a stretch of a file. Lines of a file may not share a place.
    """
    given = lines.select("*", label.alias("_label"), F.floor(F.col(order) / width).cast("long").alias("_stretch"), F.lit(False).alias("_carried"))
    last = given.where(F.col("_label").isNotNull()).groupBy(*by, "_stretch").agg(F.max_by("_label", order).alias("_last"))
    stretches = given.groupBy(*by, "_stretch").agg(F.count("*").alias("_n"))  # those without a label are carried over too
    every = stretches.drop("_n").withColumn("_last", F.lit(None).cast(last.schema["_last"].dataType)).unionByName(last).groupBy(*by, "_stretch").agg(F.max("_last").alias("_last"))
    before = W.partitionBy(*by).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    carried = every.select(*by, "_stretch", F.last("_last", ignorenulls=True).over(before).alias("_label")).where(F.col("_label").isNotNull())
    both = given.unionByName(carried.withColumn("_carried", F.lit(True)), allowMissingColumns=True)
    w = W.partitionBy(*by, "_stretch").orderBy(F.desc("_carried"), order).rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn("section", F.last("_label", ignorenulls=True).over(w)).where(~F.col("_carried"))
    return out.select(*lines.columns, "section")


def match_summary(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """target, matched, distorted, no_match, total and the check from lines (file, line, value)."""
    found = lambda pattern, i=1: F.nullif(F.regexp_extract("value", pattern, i), F.lit(""))
    own = filled(lines, found(TARGET), by or ["file"], "line").where(F.col("section").isNotNull())
    facts = own.groupBy("section").agg(
        F.max(found(UNIQUE).try_cast("int")).alias("total"), F.max(found(MATCHED).try_cast("int")).alias("matched"),
        F.max(found(DISTORTED).try_cast("int")).alias("distorted"), F.max(found(MISSING).try_cast("int")).alias("no_match"),
    )
    out = facts.withColumnRenamed("section", "target").na.fill(0, ["matched", "distorted", "no_match"])
    # matched as the log gives it includes none of the distorted
    return out.withColumn("check", F.when(F.col("total") == F.col("matched") + F.col("distorted") + F.col("no_match"), "OK").otherwise("MISMATCH"))


def population_sizes(whole: DataFrame) -> DataFrame:
    """target, threshold (from the path) and number of molecules from whole files (path, value)."""
    pairs = F.arrays_zip(F.regexp_extract_all("value", F.lit(POPULATION), F.lit(1)).alias("target"), F.regexp_extract_all("value", F.lit(POPULATION), F.lit(2)).alias("n"))
    return whole.select(texts.threshold_value(F.col("path")).alias("threshold"), F.explode(pairs).alias("x")).select("threshold", "x.target", F.col("x.n").cast("int").alias("n"))


def sections(lines: DataFrame, names: tuple[str, ...] = ("METALS", "GEOMETRIES")) -> DataFrame:
    """section, label and count of a text of sections with lines "label: count"."""
    label = F.when(F.trim("value").isin(*names), F.trim("value"))
    pattern = r"^\s*(.+?)\s*:\s*(\d+)\s*$"
    return filled(lines, label, ["file"], "line").where(F.col("value").rlike(pattern)).select("section", F.regexp_extract("value", pattern, 1).alias("label"), F.regexp_extract("value", pattern, 2).cast("int").alias("count"))


def sdf_files(records: DataFrame) -> DataFrame:
    """A row a file from records (path, pos, record): unmatched, biatomic, distorted, first tag, similarities."""
    tag = texts.has_field(F.col("record"), "DistortedMatch")
    atoms = texts.sdf_atoms(F.col("record"))
    similarity = texts.field(F.col("record"), "Similarity").try_cast("double")
    flag = F.nullif(texts.field(F.col("record"), "DistortedMatch"), F.lit(""))
    return records.groupBy("path").agg(
        F.count("*").alias("n_records"), F.max_by(atoms, -F.col("pos")).alias("n_atoms"), F.coalesce(F.bool_or(tag & (atoms == 2)), F.lit(False)).alias("biatomic_distorted"),
        F.coalesce(F.bool_or(tag), F.lit(False)).alias("tagged"), F.min_by(flag, F.when(flag.isNotNull(), F.col("pos"))).alias("first_flag"), F.collect_list(similarity).alias("similarities"),
    )


def distorted_lists(records: DataFrame, n: int = 5) -> DataFrame:
    """The n lowest and the n highest similarities in files that hold a distorted match: end (low, high), place, similarity, path and pos.

    records (path, pos, record). Every record of such a file counts; ties go by path and pos. The mean of the highest is ``top_mean``.
    """
    similarity = texts.field(F.col("record"), "Similarity").try_cast("double")
    facts = records.select("path", "pos", similarity.alias("similarity"), texts.has_field(F.col("record"), "DistortedMatch").alias("tagged"))
    held = facts.groupBy("path").agg(F.bool_or("tagged").alias("any")).where("any").select("path")
    rows = facts.join(held, "path", "left_semi").where("similarity is not null").select("similarity", "path", "pos")
    ends = (("low", F.col("similarity")), ("high", -F.col("similarity")))
    lists = [rows.orderBy(value, "path", "pos").limit(n).select(F.lit(end).alias("end"), F.row_number().over(W.orderBy(value, "path", "pos")).alias("place"), *rows.columns) for end, value in ends]  # n rows
    return lists[0].unionByName(lists[1])


def top_mean(lists: DataFrame) -> DataFrame:
    return lists.where("end = 'high'").agg(F.avg("similarity").alias("top_mean"))


def sdf_report(files: DataFrame, target: Column) -> DataFrame:
    """Per target: files without a match, matched and distorted by the first tag, and biatomic ones among them."""
    flagged = F.lower(F.coalesce("first_flag", F.lit("false"))) == "true"
    rows = files.withColumns({"target": target, "missing": F.col("n_records") < 2, "flagged": flagged})
    return rows.groupBy("target").agg(
        F.count_if("missing").alias("missing"), F.count_if(~F.col("missing") & F.col("flagged")).alias("distorted"), F.count_if(~F.col("missing") & ~F.col("flagged")).alias("matched"),
        F.count_if(F.col("missing") & (F.col("n_atoms") == 2)).alias("biatomic_missing"), F.count_if("biatomic_distorted").alias("biatomic_distorted"), F.count("*").alias("files"),
    )
