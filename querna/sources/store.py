"""Document tables: scan, list, look up, upsert, delete, with Parquet as the store."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ["index_name", "document_id"]


def scan(spark: SparkSession, path: str, index: str | None = None) -> DataFrame:
    """One index is one partition directory, so others aren't read."""
    df = spark.read.parquet(path)
    return df if index is None else df.where(F.col("index_name") == index)


def list_documents(docs: DataFrame, limit: int = 10, offset: int = 0, equals: dict | None = None, key: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """A page in id order, and the total."""
    for f, v in (equals or {}).items():
        docs = docs.where(F.col(f).cast("string") == (str(v).lower() if isinstance(v, bool) else str(v)))
    return docs.orderBy(key).offset(offset).limit(limit), docs.agg(F.count("*").alias("total"))


def lookup(docs: DataFrame, ids: Iterable, key: str = "document_id") -> DataFrame:
    return docs.where(F.col(key).isin(list(ids)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str], skip_duplicates: bool = False) -> DataFrame:
    """The last write of each key; with skip_duplicates the old one stays.  Writes of one
    order are resolved by their other columns, the greatest first, so by no chance."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    side = F.asc("__new") if skip_duplicates else F.desc("__new")
    w = Window.partitionBy(*keys).orderBy(side, *[F.desc(c) for c in order], *_ties(both, keys, order))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__new")


def _ties(df: DataFrame, keys: list[str], order: list[str]) -> list:
    return [F.desc(F.col(f"`{f.name}`")) for f in df.schema if f.name not in (*keys, *order, "__new") and f.dataType.typeName() not in ("map", "variant")]


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; of rows of one order the one with the greatest other columns."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order], *_ties(log, keys, order))
    return log.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def joined(df: DataFrame, keys: list[str], value: str, order: str, separator: str = " ") -> DataFrame:
    """(keys, value): a group's values in order, as one text."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda x: x["v"]), separator).alias(value))


def delete(docs: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return docs.join(ids.select(*keys).distinct(), keys, "left_anti")


def split_valid(docs: DataFrame, errors) -> tuple[DataFrame, DataFrame]:
    """Rows to store, and rows with what is wrong with them."""
    e = docs.withColumn("errors", errors)
    return e.where(F.size("errors") == 0).drop("errors"), e.where(F.size("errors") > 0)


def write(docs: DataFrame, path: str, partition: str = "index_name") -> None:
    docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def word_list(spark: SparkSession, path: str, least: int = 3) -> DataFrame:
    """A .dic file's words: comments and blank lines dropped, flags after / cut off, lower case."""
    t = spark.read.text(path).where("trim(value) != '' and not startswith(value, '#')")
    return t.select(F.lower(F.trim(F.split_part("value", F.lit("/"), F.lit(1)))).alias("word")).where(F.length("word") >= least).distinct()
