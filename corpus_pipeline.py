"""A training corpus from raw documents: quality rules, near-duplicates, benchmark passages, mix, token order.

Edge cases, of every stage: an empty table gives an empty one; other columns are kept as they are (but by the last stage, which
returns sequences); texts are read whole, however long; a null doc_id is a document like any other. Null and empty
texts fail the quality rules; taken alone, later stages keep them: they are near to nothing, hold no passage, weigh nothing in
the mix, which then leaves them out, and are one end token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import _store, decontam, mix, neardup, quality, tokens
from weft.llm._store import written
from weft.session import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and every threshold; repeated rows pass or go alike."""
    ship(spark)
    return quality.kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the least id: five-word shingles, similarity 0.8. Repeated rows
    with an id are one; rows without an id all stay."""
    ship(spark)
    return neardup.kept(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with a benchmark item; items without words hit nothing."""
    ship(spark)
    return decontam.kept(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a repeated document is a repeated row."""
    ship(spark)
    return mix.drawn(docs)


def training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed-length token sequences at their slots, from the shards that are written."""
    ship(spark)
    return tokens.materialised(docs, key=20240229)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("training_order", training_order),
]

#: Near-duplicate components, seeded choices and token ids are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result but the last is stored and read again.

    What a stage stored on its way goes once its result is stored.
    """
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        since = _store.mark()
        rows = stage(spark, rows, sf_dir)
        if i < len(STAGES) - 1:
            rows = written(rows, f"pipeline-{name}")
            _store.cleared(spark, since, keep=f"pipeline-{name}")
    return rows


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
