"""Readers and writers; paths may be any that Spark's readers open."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft import schemas
from weft.functions import texts


def viable_ids(spark: SparkSession, path: str, column: str = "Identifier") -> DataFrame:
    """Distinct identifiers of a CSV of viable structures."""
    return spark.read.csv(path, header=True, schema=schemas.VIABLE).select(column).dropna().distinct()


def write_csv(rows: DataFrame, path: str, sep: str = ",") -> None:
    rows.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def population_ids(spark: SparkSession, path: str) -> DataFrame:
    """The first token of each line that has one."""
    return spark.read.text(path).select(texts.first_token(F.col("value")).alias("entry_id")).where("entry_id <> ''")


def write_population(rows: DataFrame, path: str) -> None:
    """"id smiles similarity", most similar first, in one file: a list for one target and threshold."""
    line = F.concat_ws(" ", "entry_id", "smiles", texts.shown(F.col("similarity"), 4))
    rows.repartition(1).sortWithinPartitions(F.desc("similarity"), "entry_id").select(line.alias("value")).write.mode("overwrite").text(path)


def write_targets(rows: DataFrame, path: str) -> None:
    """"id smiles [fingerprint]" lines."""
    rows.select(F.concat_ws(" ", "entry_id", "smiles", F.to_json("fp")).alias("value")).write.mode("overwrite").text(path)


def run_results(spark: SparkSession, folder: str, name: str = "results.csv", schema: str | None = None) -> DataFrame:
    """CSV files exactly two folders deep, each read once, with run and file."""
    reader = spark.read.option("header", True)
    rows = (reader.schema(schema) if schema else reader).csv(f"{folder}/*/*/{name}")
    path = F.col("_metadata.file_path")
    return rows.select("*", path.alias("file"), F.element_at(F.split(path, "/"), -3).alias("run"))


def results_below(spark: SparkSession, folder: str, name: str = "results.csv", schema: str | None = None) -> DataFrame:
    """CSV files of the name at any depth, each read once, with run (the folder two above) and file."""
    reader = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", name)
    rows = (reader.schema(schema) if schema else reader).csv(folder)
    path = F.col("_metadata.file_path")
    return rows.select("*", path.alias("file"), F.element_at(F.split(path, "/"), -3).alias("run"))


def entries(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """The table of entries; the first n are a stop for trials."""
    rows = spark.read.parquet(path)
    return rows.limit(first) if first else rows


def looked_up(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of some ids."""
    return rows.join(ids.select(key).distinct(), key)


def registered(rows: DataFrame, name: str) -> DataFrame:
    """The rows, now a view for SQL too."""
    rows.createOrReplaceTempView(name)
    return rows


def write_environments(rows: DataFrame, path: str) -> None:
    """The environment table laid out by block: a folder a central atom, files sorted by size and formula, so that a
    block is read from few row groups. Hot atoms are dealt over files by formula.
    """
    dealt = rows.repartition("central_atom", "n_atoms", "formula_str")
    dealt.sortWithinPartitions("central_atom", "n_atoms", "formula_str", "entry_id", "cae_idx").write.mode("overwrite").partitionBy("central_atom").parquet(path)


def read_environments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CAES).parquet(path)


def write_blocks(rows: DataFrame, name: str, path: str, block: Sequence[str], key: Sequence[str], buckets: int, salts: int = 1, copied: bool = False) -> DataFrame:
    """A table in the session's catalogue, bucketed and sorted by block and salt, one file a bucket: two such tables of as
    many buckets and salts are joined on these columns without a shuffle.

    salts: a block's rows are dealt over so many buckets, so that a hot block is several tasks' work; the other side, ``copied``,
    has each row once a salt.
    """
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))) if copied else F.pmod(F.xxhash64(*key), F.lit(salts)).cast("int")
    salted = rows.withColumn("salt", salt)
    by = [*block, "salt"]
    salted.repartition(buckets, *by).write.mode("overwrite").option("path", path).bucketBy(buckets, *by).sortBy(*by).saveAsTable(name)
    return rows.sparkSession.table(name)


def fragments(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A fragment table in CSV, scanned in splits."""
    return spark.read.csv(path, header=True, schema=schema)


def structure_texts(spark: SparkSession, path: str, glob: str = "*.cif") -> DataFrame:
    """path, name without ending, and text of structure files at any depth."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1).alias("name"), F.col("value").alias("text"))


def stale(files: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Files (path, length) whose name is none of the ids: what a clean-up would delete."""
    named = files.withColumn(key, F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1))
    return named.join(ids.select(key).distinct(), key, "left_anti").select("path", key)


def append_metrics(rows: DataFrame, path: str) -> None:
    """Adds rows to a table of metrics; earlier ones stay."""
    rows.write.mode("append").parquet(path)


def scores(spark: SparkSession, path: str, suffix: str = "_HSR_score") -> DataFrame:
    """The first column with the suffix, whatever its name, as hsr_score; no rows if there is none."""
    rows = spark.read.option("header", True).csv(path)
    found = [c for c in rows.columns if c.endswith(suffix)]
    column = texts.number(F.col(f"`{found[0]}`")) if found else F.lit(None).cast("double")
    out = rows.select(column.alias("hsr_score"), F.lit(found[0].removesuffix(suffix) if found else None).alias("target"))
    return out if found else out.limit(0)


def has_columns(rows: DataFrame, *required: str) -> bool:
    return set(required) <= set(rows.columns)


def generator_runs(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, schema=schemas.GENERATOR_RUN)
    return rows.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"_(\w+)\.csv$", 1).alias("run"))


def tasks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TASK).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)


def write_tasks(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Paths and sizes of files below a folder, contents unread."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length")


def pieces(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """path, pos (from 0) and value of the parts of text files between separators: a large file is many tasks' work.

    Spark hands the parts of a split out in order; how many parts the splits of a file before it hold, one row a split,
    makes their places in the file.
    """
    given = spark.read.option("lineSep", sep).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"), "value")
    splits = given.groupBy("path", "_split").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("path").orderBy("_split")) - F.col("_n") - F.col("_first")
    return given.join(splits.select("path", "_split", before.alias("_shift")), ["path", "_split"]).select("path", (F.col("_at") + F.col("_shift")).alias("pos"), "value")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line number and value of text files, read in splits."""
    return pieces(spark, path, "\n").select(F.col("path").alias("file"), F.col("pos").alias("line"), F.regexp_replace("value", r"\r$", "").alias("value"))


def whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def sdf_records(spark: SparkSession, path: str) -> DataFrame:
    """path, pos and record of multi-record SDF files, read in splits; the newline after a separator is no part of a record."""
    record = F.when(F.col("pos") > 0, F.regexp_replace("value", r"^\r?\n", "")).otherwise(F.col("value"))
    return pieces(spark, path, "$$$$").select("path", "pos", record.alias("record")).where(F.col("record").rlike(r"\S"))


def sdf_text(body: str, fields: dict[str, str]):
    """A record with tags, as a column: the body column and the columns of the fields."""
    tags = [F.concat(F.lit(f"> <{name}>\n"), F.col(column).cast("string"), F.lit("\n\n")) for name, column in fields.items()]
    return F.concat(F.rtrim(F.col(body)), F.lit("\n"), *tags, F.lit("$$$$"))


def write_sdf(rows: DataFrame, path: str, body: str, fields: dict[str, str], file: str, order: str) -> None:
    """One folder for each value of ``file``, records in order."""
    made = rows.select(file, order, sdf_text(body, fields).alias("value"))
    made.repartition(file).sortWithinPartitions(file, order).select(file, "value").write.mode("overwrite").partitionBy(file).text(path)
