"""Statistics over query and job logs: windows, rates, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moving(samples: DataFrame, value: str, order: list[str], by: list[str] = []) -> DataFrame:
    """Moving average of 5, current, average and peak of 10, and the trend of 3 against the 3 before."""
    w = Window.partitionBy(*by).orderBy(*order)
    new, old = F.avg(value).over(w.rowsBetween(-2, 0)), F.avg(value).over(w.rowsBetween(-5, -3))
    trend = F.when(old.isNull(), "stable").when(new > old * 1.1, "increasing").when(new < old * 0.9, "decreasing").otherwise("stable")
    return samples.withColumns({
        "moving_avg": F.avg(value).over(w.rowsBetween(-4, 0)), "avg_10": F.avg(value).over(w.rowsBetween(-9, 0)), "peak_10": F.max(value).over(w.rowsBetween(-9, 0)), "trend": trend,
    })


def percentiles(log: DataFrame, kind: str, took: str, accuracy: int = 10_000) -> DataFrame:
    """p50, p95 and p99 by query type, within 1 / accuracy of the rank; no group's values are held whole."""
    at = lambda p: F.percentile_approx(took, p, accuracy)
    return log.groupBy(kind).agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def report(log: DataFrame, kind: str, took: str, slow: float) -> DataFrame:
    """By query type: count, average, share of slow ones and percentiles, exactly."""
    return log.groupBy(kind).agg(F.count("*").alias("queries"), F.avg(took).alias("avg_took"), (100.0 * F.count_if(F.col(took) > slow) / F.count("*")).alias("slow_percent"), F.expr(f"percentile({took}, 0.5)").alias("p50"), F.expr(f"percentile({took}, 0.95)").alias("p95"), F.max(took).alias("max_took"))


def warm_order(log: DataFrame, kind: list[str], took: str, n: int = 50) -> DataFrame:
    """The queries most worth caching: frequency times average time."""
    g = log.groupBy(*kind).agg(F.count("*").alias("queries"), F.avg(took).alias("avg_took"))
    return g.withColumn("priority", F.col("queries") * F.col("avg_took")).orderBy(F.desc("priority"), *kind).limit(n)


def recent_count(log: DataFrame, ts: str, as_of: Column, seconds: int = 60) -> DataFrame:
    return log.where((F.col(ts) > as_of - F.expr(f"INTERVAL {seconds} SECONDS")) & (F.col(ts) <= as_of)).agg(F.count("*").alias("recent"))


def coverage(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.agg(*[F.try_divide(100.0 * F.count(c), F.count("*")).alias(f"{c}_percent") for c in columns])


def last_average(log: DataFrame, value: str, order: list[Column], n: int = 100) -> DataFrame:
    return log.orderBy(*order).limit(n).agg(F.avg(value).alias("average"))


def eta(pending: Column, per_minute: Column) -> Column:
    """Minutes until the backlog is done."""
    return F.when(per_minute > 0, pending / per_minute)
