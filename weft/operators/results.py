"""Runs, success rates and wide tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def mean_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.avg(value).alias("mean_score"), F.count("*").alias("n")).orderBy(key)


def frequencies(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts and their share of all in percent."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    total = F.broadcast(rows.agg(F.count("*").alias("total")))  # one row
    return counts.join(total).select(*keys, "n", F.try_divide(100.0 * F.col("n"), "total").alias("percent"))


def long_methods(rows: DataFrame, keys: Sequence[str], methods: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """{method}_{field} columns as rows (keys, method, fields)."""
    each = ", ".join(f"'{m}', " + ", ".join(f"`{m}_{f}`" for f in fields) for m in methods)
    return rows.select(*keys, F.expr(f"stack({len(methods)}, {each}) AS (method, {', '.join(fields)})"))


def success(rows: DataFrame, keys: Sequence[str], ok: Column, expected: Column | int | None = None) -> DataFrame:
    """Successes and their rate per key; the denominator is the rows, or a constant."""
    found = rows.groupBy(*keys).agg(F.count_if(ok).alias("n_success"), F.count("*").alias("n_total"))
    below = F.col("n_total") if expected is None else expected if isinstance(expected, Column) else F.lit(expected)
    return found.withColumn("success_rate", F.try_divide(F.col("n_success").cast("double"), below))


def spread(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean and sample deviation (NULL for one row) of each value, NaN and NULL left out."""
    clean = rows.withColumns({v: F.nanvl(v, F.lit(None).cast("double")) for v in values})
    return clean.groupBy(*keys).agg(*(f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_samp))))


def grand_mean(rows: DataFrame, group: str, value: str, digits: int | None = None) -> DataFrame:
    """The mean of per-group means, these rounded first if digits are given."""
    each = rows.groupBy(group).agg(F.avg(value).alias("m"))
    return each.agg(F.avg(F.round("m", digits) if digits is not None else F.col("m")).alias("grand_mean"))


def three_levels(rows: DataFrame, task: str, run: str, failed: Column) -> DataFrame:
    """Per-task rates, their mean in each run, then mean, least and most over runs beside the pooled rate."""
    tasks = rows.groupBy(run, task).agg(F.count("*").alias("expected"), F.count_if(failed).alias("zero"))
    rated = tasks.withColumn("rate", F.try_divide((F.col("expected") - F.col("zero")).cast("double"), "expected"))
    runs = rated.groupBy(run).agg(F.avg("rate").alias("run_rate"), F.sum("expected").alias("expected"), F.sum("zero").alias("zero"))
    return runs.agg(
        F.avg("run_rate").alias("mean_rate"), F.min("run_rate").alias("min_rate"), F.max("run_rate").alias("max_rate"),
        F.try_divide((F.sum("expected") - F.sum("zero")).cast("double"), F.sum("expected")).alias("pooled_rate"), F.count("*").alias("n_runs"),
    )


def files_rates(files: DataFrame, scores: DataFrame, run: str, task: str, expected: int) -> DataFrame:
    """Rate of files found to files expected, and what neither a file nor a zero score explains."""
    found = files.groupBy(run, task).agg(F.count("*").alias("n_files"))
    zero = scores.groupBy(run, task).agg(F.count_if(F.col("score") == 0).alias("n_zero"))
    both = found.join(zero, [run, task], "full_outer").na.fill(0, ["n_files", "n_zero"])
    return both.select(run, task, "n_files", "n_zero", (F.col("n_files") / F.lit(expected)).alias("rate"), (F.lit(expected) - F.col("n_files") - F.col("n_zero")).alias("remainder"))


def class_counts(matches: DataFrame, *keys: str) -> DataFrame:
    counts = [F.count_if(F.col("class") == c).alias(c) for c in ("matched", "distorted", "no_match")]
    return matches.groupBy(*keys).agg(*counts, F.count("*").alias("total"))


def coverage(counts: DataFrame) -> DataFrame:
    """Percentages of each row, and of the sums: a ratio of sums, not a mean of ratios."""
    kinds = ("matched", "distorted", "no_match")
    sums = counts.agg(*(F.sum(k).alias(k) for k in (*kinds, "total")))
    return sums.select(*(F.try_divide(100.0 * F.col(k), "total").alias(f"{k}_percent") for k in kinds), "total")


def reported_totals(rows: DataFrame) -> DataFrame:
    return rows.withColumn("check", F.when(F.col("total") == F.col("matched") + F.col("distorted") + F.col("no_match"), "OK").otherwise("MISMATCH"))


def wide(rows: DataFrame, key: str, column: str, values: Sequence, cell: Column) -> DataFrame:
    return rows.groupBy(key).pivot(column, list(values)).agg(cell)


def score_matrix(rows: DataFrame, runs: Sequence, task: str = "task", run: str = "run", score: str = "score", order: str = "file") -> DataFrame:
    """Runs as columns; of a task's rows in a run the last by order counts; tasks in natural order."""
    from weft.functions.texts import natural_key

    return wide(rows, task, run, runs, F.max_by(score, order)).orderBy(natural_key(F.col(task)), task)


def reindexed(names: DataFrame, rows: DataFrame, key: str, fill: dict | None = None) -> DataFrame:
    """All names, in their own order ``pos``, with the rows' values or NULL or the fill."""
    out = names.join(rows, key, "left").orderBy("pos")
    return out.na.fill(fill) if fill else out


def added(tables: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """Values of several tables summed by key, one that is missing as 0."""
    out = tables[0].select(key, value)
    for t in tables[1:]:
        out = out.unionByName(t.select(key, value))
    return out.groupBy(key).agg(F.coalesce(F.sum(value), F.lit(0)).alias(value))


def first_seen(rows: DataFrame, key: str, line: str) -> DataFrame:
    """Keys numbered by where they first occur."""
    first = rows.groupBy(key).agg(F.min(line).alias("line"))
    lots = first.withColumn("lot", F.floor(F.log2(F.greatest(F.col("line"), F.lit(1))) * 64))  # grows with line, few values
    before = lots.groupBy("lot").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(W.orderBy("lot")) - F.col("n"))  # some thousand rows at most
    ranked = lots.join(F.broadcast(before.select("lot", "before")), "lot")
    return ranked.select(key, "line", (F.row_number().over(W.partitionBy("lot").orderBy("line")) + F.col("before")).cast("int").alias("order"))


def pairwise(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Methods side by side by key, never by position."""
    return left.join(right, list(keys))


def measures(rows: DataFrame, key: str, group: str, measure: str, value: str, names: Sequence[str]) -> DataFrame:
    """A row a group and key with a column a measure (its greatest value, NULL without one), of keys that every group has.

    Values of 0 alone count as none.
    """
    best = rows.groupBy(group, key, measure).agg(F.max(value).alias("v"), F.max(F.abs(F.col(value))).alias("any")).where(F.col("any") > 0)
    wide_ = best.groupBy(group, key).pivot(measure, list(names)).agg(F.first("v"))
    groups = best.select(group).distinct().agg(F.count("*").alias("groups"))  # one row
    shared = wide_.groupBy(key).agg(F.count("*").alias("n")).join(F.broadcast(groups)).where("n = groups").select(key)
    return wide_.join(shared, key, "left_semi").select(group, key, *names)


def task_configs(targets: DataFrame, benchmark: str) -> DataFrame:
    """A task file's content for each target (index, target), as ``schemas.TASK`` has it, with the file's name.

    Fixed values: names, defaults and paths of the task files.
    """
    label = F.concat_ws("_", "index", "target")
    parameters = F.struct(F.lit("rdkit").alias("generator"), F.lit(8).cast("long").alias("n_jobs"), F.col("target").alias("prefix"), F.concat(F.lit(f"configs/{benchmark}/targets/"), label, F.lit(".txt")).alias("ref_molecule"), F.lit(True).alias("save_files"), F.lit(10).cast("long").alias("timeout"))
    metric = F.struct(F.lit(False).alias("filter"), F.lit("raw").alias("modifier"), F.concat("target", F.lit("_HSR_score")).alias("name"), F.lit(1.0).alias("weight"), F.create_map().cast("map<string,string>").alias("parameters"))
    return targets.select(
        label.alias("task"), F.lit("./").alias("output_dir"), *(F.lit(False).alias(c) for c in ("load_from_previous", "logging", "monitor_app", "termination_exit")),
        F.struct(F.lit(False).alias("run")).alias("diversity_filter"), F.struct(F.lit("single").alias("method"), F.array(metric).alias("metrics")).alias("scoring"),
        F.array(F.struct(F.lit("HSR").alias("name"), F.lit(True).alias("run"), parameters.alias("parameters"))).alias("scoring_functions"),
        F.array(F.lit(f"molscore.configs.{benchmark}.starting_populations"), F.concat(label, F.lit("_init_pop.txt"))).alias("starting_population"), F.concat(label, F.lit(".json")).alias("file"),
    )


def metrics(spark, **values: float) -> DataFrame:
    """A row a metric, for ``files.append_metrics``."""
    return spark.createDataFrame(sorted((k, float(v)) for k, v in values.items()), "name string, value double").withColumn("at", F.current_timestamp())
