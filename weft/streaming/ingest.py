"""The environment table kept up to date from a stream of batches."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weft.operators.molecules import last_wins, upsert
from weft.store import on_disk

#: Versions of the manifest that stay, so that a reader of the one before the newest finds its files.
KEPT = 2


def keep_table(stream: DataFrame, path: str, checkpoint: str, keys: list[str], keep_old: list[str], order: str, buckets: int = 64) -> StreamingQuery:
    """Upserts each batch into a Parquet table of hash buckets; ``latest`` reads it."""

    def step(batch: DataFrame, number: int) -> None:
        upsert_buckets(batch, path, number, keys, keep_old, order, buckets)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()


def upsert_buckets(batch: DataFrame, path: str, version: int, keys: list[str], keep_old: list[str], order: str, buckets: int = 64) -> int:
    """One batch: only the buckets that its keys fall into are read and written anew; how many these are.

    A version is its files, ``data/v=N/bucket=B``, and then a manifest, ``manifest/v=N``, that names for each bucket
    the version that holds its rows. A batch that failed or comes again starts from the manifest before it and
    gives the same table. Files that none of the last manifests names are deleted once the new one is there.
    """
    spark = batch.sparkSession
    live, had = manifest(spark, path, version), _buckets(spark, path, version)
    if had not in (None, buckets):
        raise ValueError(f"the table has {had} buckets, not {buckets}")
    hashed = last_wins(batch, keys, order).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    new = hashed.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        touched = sorted(r[0] for r in new.select("bucket").distinct().collect())  # no more than buckets
        old = _read(spark, path, {b: live[b] for b in touched if b in live})
        rows = new if old is None else upsert(old.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")), new, keys, keep_old).select(new.columns)
        if touched:
            rows.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/v={version}")
    finally:
        new.unpersist()
    named = live | dict.fromkeys(touched, version)
    spark.createDataFrame(sorted(named.items()), "bucket int, version long").withColumn("buckets", F.lit(buckets)).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v={version}")
    _clear(spark, path)
    return len(touched)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The manifests that are whole, oldest first."""
    fs, folder = on_disk(spark, f"{path}/manifest")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(on_disk(spark, f"{path}/manifest/{n}/_SUCCESS")[1]))


def _manifest(spark: SparkSession, path: str, before: int | None) -> list[Row]:
    """The newest manifest, or the newest before a batch: a row a bucket."""
    found = [v for v in _versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/manifest/v={found[-1]}").collect() if found else []


def manifest(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """The version that holds the rows of each bucket."""
    return {r["bucket"]: r["version"] for r in _manifest(spark, path, before)}


def _buckets(spark: SparkSession, path: str, before: int | None = None) -> int | None:
    return next((r["buckets"] for r in _manifest(spark, path, before)), None)


def _read(spark: SparkSession, path: str, live: dict[int, int]) -> DataFrame | None:
    files = [f"{path}/data/v={v}/bucket={b}" for b, v in sorted(live.items())]
    return spark.read.parquet(*files) if files else None


def _clear(spark: SparkSession, path: str) -> None:
    versions = _versions(spark, path)
    kept = {(v, b) for n in versions[-KEPT:] for b, v in manifest(spark, path, n + 1).items()}
    fs, data = on_disk(spark, f"{path}/data")
    if not fs.exists(data):
        return
    for folder in fs.listStatus(data):
        v = int(folder.getPath().getName()[2:])
        if v > versions[-1]:
            continue
        for bucket in fs.listStatus(folder.getPath()):
            name = bucket.getPath().getName()
            if name.startswith("bucket=") and (v, int(name[7:])) not in kept:
                fs.delete(bucket.getPath(), True)
    for n in versions[:-KEPT]:
        fs.delete(on_disk(spark, f"{path}/manifest/v={n}")[1], True)


def latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The table of the newest manifest, or the newest before a batch; None if there is none."""
    return _read(spark, path, manifest(spark, path, before))


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by type in event-time windows; ts must be a timestamp with a zone."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
