"""Columns of partners, fetched once the best are known."""

from pyspark.sql import functions as F

from weft.operators import match


def test_a_payload_is_fetched_after_one_search(spark):
    seen = spark.sparkContext.accumulator(0)

    def looked(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(50).select("id", F.lit("x").alias("kept"))
    matches = rows.select(F.col("id").alias("target"), (F.col("id") + 10).alias("partner")).repartition(3).mapInArrow(looked, "target long, partner long")
    found = {r["target"]: r["kept"] for r in match.with_payload(matches, rows, ["kept"]).collect()}
    assert found == {i: "x" if i < 40 else None for i in range(50)} and seen.value == 50
