"""The table of indices: one row an index, rewritten whole as it is small."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "index_name string, settings string, mappings string, status string, document_count long"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def create(c: DataFrame, name: str, settings: dict | None = None, mappings: dict | None = None) -> DataFrame:
    if not c.where(F.col("index_name") == name).isEmpty():
        raise ValueError(f"index {name!r} exists")
    row = c.sparkSession.createDataFrame([(name, json.dumps(settings or {}), json.dumps(mappings or {}), "open", 0)], SCHEMA)
    return c.unionByName(row)


def get(c: DataFrame, name: str) -> dict:
    row = c.where(F.col("index_name") == name).first()
    if row is None:
        raise KeyError(name)
    return {"name": name, "settings": json.loads(row["settings"]), "mappings": json.loads(row["mappings"]), "status": row["status"], "documentCount": row["document_count"]}


def update(c: DataFrame, name: str, settings: dict | None = None, mappings: dict | None = None, status: str | None = None) -> DataFrame:
    old, mine = get(c, name), F.col("index_name") == name
    return c.withColumns({
        "settings": F.when(mine, json.dumps(old["settings"] | (settings or {}))).otherwise(F.col("settings")),
        "mappings": F.when(mine, json.dumps(old["mappings"] | (mappings or {}))).otherwise(F.col("mappings")),
        "status": F.when(mine, status or old["status"]).otherwise(F.col("status")),
    })


def delete(c: DataFrame, docs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The index goes with its documents."""
    return c.where(F.col("index_name") != name), docs.where(F.col("index_name") != name)


def reconcile(c: DataFrame, docs: DataFrame) -> DataFrame:
    """Document counts as they are."""
    real = docs.groupBy("index_name").agg(F.count("*").alias("n"))
    return c.join(real, "index_name", "left").withColumn("document_count", F.coalesce("n", F.lit(0))).drop("n")
