"""Summaries, quantiles, outliers, histograms, and neighbours of a value."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Values that one aggregate may hold for one quantile, and how finely a round brackets the rest.
FEW, ACCURACY = 100_000, 2_000


def quantiles(rows: DataFrame, wanted: dict[str, Sequence[float]], few: int = FEW) -> dict[tuple[str, float], float | None]:
    """Exact quantiles of several columns at once, interpolated between neighbours, by (column, share); None without values.

    Each quantile lies between values of two ranks. An equal-depth histogram of bounded size brackets every rank; counts then
    say whether its value is an end of the bracket or within, and the next round looks at the values within only, until
    they are ``few``. A round leaves about a thousandth of the values of the one before, whatever their distribution, and
    settles values that repeat, so no task holds more than ``few`` of them. NULLs don't count; NaN is greater than any number.
    """
    numbers = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in wanted}
    first = _told(rows, [[F.count(F.col(f"`{c}`")), F.count(numbers[c])] for c in wanted])
    sizes = dict(zip(wanted, first, strict=True))
    places = {(c, p): p * (sizes[c][0] - 1) for c, shares in wanted.items() for p in shares if sizes[c][0]}
    ranks = sorted({(c, r) for (c, _), x in places.items() for r in (math.floor(x), math.ceil(x))})
    searches = {(c, r): _Rank(numbers[c], r, sizes[c][1]) for c, r in ranks if r < sizes[c][1]}
    while wide := [s for s in searches.values() if s.value is None and s.inside > few]:
        ends = _told(rows, [[F.percentile_approx(s.within(), s.shares(), ACCURACY)] for s in wide])
        for s, told in zip(wide, _told(rows, [s.counts(*e[0]) for s, e in zip(wide, ends, strict=True)]), strict=True):
            s.narrow(*told)
    if rest := [s for s in searches.values() if s.value is None]:
        for s, told in zip(rest, _told(rows, [[F.get(F.sort_array(F.collect_list(s.within())), F.lit(s.rank - s.below))] for s in rest]), strict=True):
            s.value = told[0]
    out: dict[tuple[str, float], float | None] = {(c, p): None for c, shares in wanted.items() for p in shares}
    for (c, p), place in places.items():
        a, b = (searches[c, r].value if (c, r) in searches else math.nan for r in (math.floor(place), math.ceil(place)))
        out[c, p] = a if a == b else (math.ceil(place) - place) * a + (place - math.floor(place)) * b
    return out


def _told(rows: DataFrame, facts: list[list[Column]]) -> list[list]:
    """Groups of aggregates, all in one job."""
    one = rows.agg(*(f.alias(f"x{i}_{j}") for i, group in enumerate(facts) for j, f in enumerate(group))).first()
    return [[one[f"x{i}_{j}"] for j in range(len(group))] for i, group in enumerate(facts)]


class _Rank:
    """A value by its rank: among ``inside`` values above ``low`` and under ``high`` (None: no end), ``below`` being less than these."""

    def __init__(self, number: Column, rank: int, inside: int):
        self.number, self.rank, self.below, self.inside = number, rank, 0, inside
        self.low = self.high = self.value = None

    def within(self) -> Column:
        out = self.number
        if self.low is not None:
            out = F.when(out > self.low, out)
        return out if self.high is None else F.when(self.number < self.high, out)

    def shares(self) -> list[float]:
        at = (self.rank - self.below) / self.inside
        return [max(0.0, at - 2 / ACCURACY), min(1.0, at + 2 / ACCURACY)]

    def counts(self, a: float, b: float) -> list[Column]:
        """The ends of a bracket, and how many values are below it, at its lower end, between, and at its upper end."""
        v = self.within()
        return [F.lit(a), F.lit(b), F.count_if(v < a), F.count_if(v == a), F.count_if((v > a) & (v < b)), F.count_if((v == b) & (v > a))]

    def narrow(self, a: float, b: float, under: int, first: int, between: int, last: int) -> None:
        at = self.rank - self.below
        parts = ((under, None, self.low, a), (first, a, a, a), (between, None, a, b), (last, b, b, b), (self.inside - under - first - between - last, None, b, self.high))
        for size, value, low, high in parts:
            if at < size:
                self.value, self.low, self.high, self.inside = value, low, high, size
                return
            at -= size
            self.below += size


def described(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a column: count, mean, deviation, least, exact quartiles, most."""
    shares = 0.25, 0.5, 0.75
    q = quantiles(rows, dict.fromkeys(columns, shares))
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("x.*")
    facts = long.groupBy("column").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    of = lambda p: F.element_at(F.create_map(*(F.lit(x) for c in columns for x in (c, q[c, p]))).cast("map<string,double>"), F.col("column"))
    return facts.select("column", "count", "mean", "std", "min", *(of(p).alias(f"q{int(100 * p)}") for p in shares), "max")


def correlations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = rows.agg(*(F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


def outliers(rows: DataFrame, columns: Sequence[str], reach: float = 1.5) -> DataFrame:
    """Rows of which any column lies beyond the quartiles by more than ``reach`` times their distance."""
    q = quantiles(rows, dict.fromkeys(columns, (0.25, 0.75)))
    beyond = F.lit(False)
    for c in columns:
        low, high = q[c, 0.25], q[c, 0.75]
        if low is not None:
            beyond |= (F.col(c) < low - reach * (high - low)) | (F.col(c) > high + reach * (high - low))
    return rows.where(beyond)


def histogram(rows: DataFrame, column: str, bins: int = 15) -> DataFrame:
    """Counts in bins of one width from the least to the most, the last closed on both sides."""
    ends = rows.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    bucket = F.least(F.floor((F.col(column) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)).cast("int")
    return rows.where(F.col(column).isNotNull()).join(F.broadcast(ends)).groupBy(bucket.alias("bin")).agg(F.count("*").alias("n"))  # ends is one row


def extremes(rows: DataFrame, value: str, key: str, n: int = 5) -> DataFrame:
    """The n lowest and the n highest."""
    low = rows.orderBy(value, key).limit(n).withColumn("end", F.lit("low"))
    return low.unionByName(rows.orderBy(F.desc(value), key).limit(n).withColumn("end", F.lit("high")))


def nearest(rows: DataFrame, value: str, key: str, to: float, n: int) -> DataFrame:
    return rows.withColumn("gap", F.abs(F.col(value) - to)).orderBy("gap", key).limit(n)


def band(rows: DataFrame, value: str, key: str, to: float, reach: int) -> DataFrame:
    """The rows that stand within ``reach`` places of the nearest to a value, by value."""
    up = rows.where(F.col(value) >= to).orderBy(value, key).limit(reach + 1)
    down = rows.where(F.col(value) < to).orderBy(F.desc(value), F.desc(key)).limit(reach + 1)
    some = up.unionByName(down).withColumn("rn", F.row_number().over(W.orderBy(value, key)))  # 2 * reach + 2 rows
    at = some.orderBy(F.abs(F.col(value) - to), key).limit(1).select(F.col("rn").alias("at"))
    return some.join(F.broadcast(at)).where(F.abs(F.col("rn") - F.col("at")) <= reach).drop("rn", "at")


def in_all(rows: DataFrame, key: str, group: str) -> DataFrame:
    """Keys that occur in every group."""
    groups = F.broadcast(rows.agg(F.count_distinct(group).alias("groups")))  # one row
    return rows.groupBy(key).agg(F.count_distinct(group).alias("n")).join(groups).where("n = groups").select(key)


def list_max(x: Column) -> Column:
    return F.array_max(F.filter(x, lambda v: v.isNotNull() & ~F.isnan(v)))


def top_mean(rows: DataFrame, value: str, n: int = 5) -> DataFrame:
    return rows.orderBy(F.desc(value)).limit(n).agg(F.avg(value).alias("top_mean"), F.min(value).alias("top_min"), F.max(value).alias("top_max"))


def sampled(rows: DataFrame, n: int, seed: int) -> DataFrame:
    return rows.orderBy(F.rand(seed)).limit(n)


def numeric_columns(rows: DataFrame) -> list[str]:
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [c for c, kind in rows.dtypes if kind in kinds or kind.startswith("decimal")]


def numeric_facts(rows: DataFrame) -> DataFrame:
    """A row for each numeric column: its number of values, least and greatest, NULLs and NaNs left out; one aggregate for all."""
    names = numeric_columns(rows)
    value = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) for c in names}
    facts = [F.struct(F.lit(c).alias("column"), F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("greatest")) for c, v in value.items()]
    if not facts:
        return rows.sparkSession.createDataFrame([], "column string, n long, least double, greatest double")
    return rows.agg(F.array(*facts).alias("x")).select(F.inline("x"))


def complete(rows: DataFrame, *numbers: str) -> DataFrame:
    """Rows without a NULL, and with a number in each of the given text columns, which become doubles."""
    return rows.dropna().withColumns({c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")) for c in numbers}).dropna()


def tolerant(rows: DataFrame, text: str, kind: str = "double") -> DataFrame:
    """The value of a text, and what is wrong with it where it has none."""
    value = F.col(text).try_cast(kind)
    return rows.withColumns({"value": value, "error": F.when(value.isNull() & F.col(text).isNotNull(), F.concat(F.lit(f"not a {kind}: "), F.col(text)))})


def ratios(rows: DataFrame, above: str, below: str) -> DataFrame:
    """Greatest, least and mean ratio of two columns; rows with nothing below have none."""
    ratio = F.try_divide(F.col(above).cast("double"), F.col(below))
    return rows.agg(F.max(ratio).alias("max_ratio"), F.min(ratio).alias("min_ratio"), F.avg(ratio).alias("avg_ratio"))


def most(rows: DataFrame, value: Column, key: str, n: int = 10) -> DataFrame:
    """The n rows with the greatest value, NULL as 0."""
    return rows.withColumn("measure", F.coalesce(value, F.lit(0.0))).orderBy(F.desc("measure"), key).limit(n)


def nearest_unique(rows: DataFrame, value: str, key: str, name: str, to: float, n: int) -> DataFrame:
    """The n nearest rows to a value that have different names; of a name's rows the nearest."""
    gap = F.abs(F.col(value) - to)
    first = rows.groupBy(name).agg(F.min(F.struct(gap.alias("gap"), F.col(key).alias(key))).alias("x"))
    return first.select(name, f"x.{key}", "x.gap").orderBy("gap", key).limit(n)
