"""Tables between stages: written to the folder that all executors share, so a lost executor loses nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset (tests on one machine) a new folder is set for it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weft-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_made: list[str] = []


def temporary(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, gone when the application ends, or earlier by ``cleared``."""
    path = f"{shared_folder(spark)}/weft/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    files, at = on_disk(spark, path)
    files.deleteOnExit(at)
    return path


def on_disk(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def mark() -> int:
    return len(_made)


def cleared(spark: SparkSession, since: int, keep: str = "") -> None:
    """Deletes what was stored since a mark, but for the tables of the given name: whoever calls has read the rest."""
    for path in _made[since:]:
        if not keep or not path.rpartition("/")[2].startswith(f"{keep}-"):
            files, at = on_disk(spark, path)
            files.delete(at, True)
    _made[since:] = [p for p in _made[since:] if keep and p.rpartition("/")[2].startswith(f"{keep}-")]


def written(frame: DataFrame, name: str, **options: str) -> DataFrame:
    """The frame, materialised as Parquet in the shared folder and read again: lineage ends here."""
    spark = frame.sparkSession
    path = temporary(spark, name)
    frame.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
