"""Positions in a global order without moving all rows to one partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def global_rank(df: DataFrame, score: str, key: str, name: str = "rank", buckets: int = 64) -> DataFrame:
    """Adds the row number by score, the highest first, nulls last, ties by key.

    Approximate quantiles cut the scores into ranges; the counts of the ranges, one row
    each, give every range its offset, and rows are numbered within their range.  The
    numbers are exact however rough the quantiles are.
    """
    bounds = sorted(set(df.approxQuantile(score, [i / buckets for i in range(1, buckets)], 0.01)))
    c = F.col(score).cast("double")
    above = F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b > c)) if bounds else F.lit(0)
    placed = df.withColumn("__range", F.when(c.isNull(), buckets + 1).otherwise(above))
    counts = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__range", before.alias("__before"))  # at most buckets + 1 rows
    w = Window.partitionBy("__range").orderBy(F.desc_nulls_last(score), F.asc(key))
    numbered = placed.withColumn("__place", F.row_number().over(w)).join(F.broadcast(offsets), "__range")
    return numbered.withColumn(name, F.col("__before") + F.col("__place")).drop("__range", "__place", "__before")
