"""Exact running totals, quantiles and buckets of groups of any size.

Rows are dealt by ranges of (group, order), so a group that fills the table is spread over all tasks;
one total per range and group, a few rows for each task, tells what precedes a range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promolens.sources.staging import stage


def with_before(df: DataFrame, by: list[str], order: list[str], weight: Column, name: str = "before") -> DataFrame:
    """df with the total weight of the rows that precede each in its group; equal rows count as they lie."""
    dealt = df.withColumn("__w", weight).repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id())
    dealt = stage(dealt, "ranged")
    inside = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    sums = dealt.groupBy(*by, "__part").agg(F.sum("__w").alias("__sum"))
    sums = sums.select(*by, "__part", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__earlier"))
    out = dealt.withColumn("__in", F.coalesce(F.sum("__w").over(inside), F.lit(0)))
    same = reduce(lambda a, b: a & b, [out[c].eqNullSafe(sums[c]) for c in [*by, "__part"]])
    return out.join(sums, same).select(*[out[c] for c in df.columns], (F.col("__earlier") + F.col("__in")).alias(name))


def quantiles(df: DataFrame, value: str, probabilities: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Per group n and the interpolated quantiles, by the names given. Equal values are counted before they
    are ordered; null values don't count."""
    by = by or []
    return counted_quantiles(value_counts(df, value, by), probabilities, by)


def value_counts(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__x")).agg(F.count("*").alias("__n"))


def counted_quantiles(counts: DataFrame, probabilities: dict[str, float], by: list[str]) -> DataFrame:
    """The same from value_counts(), whose groups may be finer than `by`."""
    counts = counts.groupBy(*by, "__x").agg(F.sum("__n").alias("__n"))
    placed = with_before(counts, by, ["__x"], F.col("__n"), "__before")
    n = placed.groupBy(*by).agg(F.sum("__n").alias("n"))
    if by:
        placed = placed.join(n, reduce(lambda a, b: a & b, [placed[c].eqNullSafe(n[c]) for c in by])).select(placed["*"], n["n"])
    else:
        placed = placed.withColumn("__k", F.lit(1)).join(F.broadcast(n.withColumn("__k", F.lit(1))), "__k").drop("__k")  # one row
    aggs = []
    for name, p in probabilities.items():
        at = (F.col("n") - 1) * float(p)
        of = lambda rank: F.max(F.when((F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__n")), F.col("__x")))
        low, high = of(F.floor(at)), of(F.ceil(at))
        aggs.append((low + (high - low) * (F.max(at) - F.floor(F.max(at)))).alias(name))
    return placed.groupBy(*by).agg(F.max("n").alias("n"), *aggs)


def buckets(df: DataFrame, order: list[str], n: int, name: str) -> DataFrame:
    """df with a bucket from 1 to n of equal numbers of rows in the order; the first ones hold the rest."""
    placed = with_before(df, [], order, F.lit(1).cast("long"), "__before")
    total = placed.agg(F.count("*").alias("__rows")).withColumn("__k", F.lit(1))  # one row
    at, size, rest = F.col("__before"), F.floor(F.col("__rows") / n), F.col("__rows") % n
    first = rest * (size + 1)
    bucket = F.when(at < first, F.floor(at / (size + 1))).otherwise(rest + F.floor((at - first) / F.greatest(size, F.lit(1)))) + 1
    out = placed.withColumn("__k", F.lit(1)).join(F.broadcast(total), "__k").withColumn(name, bucket.cast("int"))
    return out.drop("__k", "__rows", "__before")
