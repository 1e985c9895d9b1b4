"""Incremental indexing with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querna.operators import index as I
from querna.operators import schema
from querna.sources.store import latest


def read(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def index_batches(stream: DataFrame, out: str, checkpoint: str, fields: list[str], key: str = "document_id", order: str = "ts", on_batch: Callable | None = None):
    """Each micro-batch is reduced to its last writes and written under its number, with its postings, the
    mapping of its columns and its count: a batch that runs again after a failure replaces its own files and
    nothing else."""

    def one(batch: DataFrame, number: int) -> None:
        last = latest(batch, [key], [order])
        last.write.mode("overwrite").parquet(f"{out}/docs/batch={number}")
        stored = batch.sparkSession.read.parquet(f"{out}/docs/batch={number}")
        I.postings(stored, fields, key).write.mode("overwrite").parquet(f"{out}/postings/batch={number}")
        rows = [(f, m["type"]) for f, m in schema.mapping_of(stored.schema).items()]
        counted = stored.agg(F.count("*").alias("documents"))
        mapping = batch.sparkSession.createDataFrame(rows, "path string, kind string").crossJoin(counted)  # one row of counts
        mapping.coalesce(1).write.mode("overwrite").parquet(f"{out}/mapping/batch={number}")
        if on_batch:
            on_batch(stored, number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str, key: str = "document_id", order: str = "ts", numbered: bool = False) -> DataFrame:
    """The last write of each document over all batches, by event order, then by batch: a late, older event of a
    later batch doesn't win."""
    last = latest(spark.read.parquet(f"{out}/docs"), [key], [order, "batch"])
    return last if numbered else last.drop("batch")


def current_postings(spark: SparkSession, out: str, key: str = "document_id", order: str = "ts") -> DataFrame:
    """The postings of the current documents; those of writes that were replaced stay out."""
    live = current(spark, out, key, order, numbered=True).select(key, "batch")
    return spark.read.parquet(f"{out}/postings").join(live, [key, "batch"]).drop("batch")


def progress(spark: SparkSession, out: str, key: str = "document_id") -> DataFrame:
    """(written, documents): rows over all batches, and the documents that they are of."""
    return spark.read.parquet(f"{out}/docs").agg(F.count("*").alias("written"), F.count_distinct(key).alias("documents"))


def event_rates(stream: DataFrame, ts: str = "ts", kind: str = "event_type", late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Events a minute and kind; later ones than the watermark are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("events"))
