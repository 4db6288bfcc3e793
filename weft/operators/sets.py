"""Semi- and anti-joins, set algebra and default-filling joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.match import checked


def within(rows: DataFrame, ids: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows whose key is among the ids; ids that repeat multiply nothing."""
    return rows.join(ids, key, "left_semi")


def without(rows: DataFrame, ids: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return rows.join(ids, key, "left_anti")


def marked(rows: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:
    """All rows with whether their key is among the ids."""
    flags = ids.select(key).distinct().withColumn(name, F.lit(True))
    return rows.join(flags, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def features(entries: DataFrame, hits: dict[str, DataFrame], key: str) -> DataFrame:
    """One boolean column for each named set of hits."""
    for name, ids in hits.items():
        entries = marked(entries, ids, key, name)
    return entries


def union_distinct(*sets: DataFrame) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.distinct()


def looked_up(rows: DataFrame, table: DataFrame, key: str, defaults: dict) -> DataFrame:
    """A left join with values for what is missing."""
    return rows.join(table, key, "left").na.fill(defaults)


def three_way(rows: DataFrame, ids: DataFrame, key: str, facts: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of some ids with the facts of their formula; each side is broadcast only where counting shows it small."""
    return rows.join(checked(ids.distinct()), key, "left_semi").join(checked(facts), list(on))
