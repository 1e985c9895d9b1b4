"""Session helpers shared by the training-data operators: the shared folder,
lineage cuts that survive lost executors, and Arrow slicing of long texts."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querna.session import reach_workers

#: Bytes of text that one numpy step handles at a time (working memory is some 40 times this).
SLICE_BYTES = 1 << 20
#: Tables of this session that are still there.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset and all of Spark
    runs in this process (tests, notebooks) a temporary one is chosen and remembered."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="querna-")
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder, so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder as Parquet and read it again: a lineage cut
    that keeps column pruning and compression."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    _written.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _written:
        _written.remove(path)


def drop(*tables: DataFrame) -> None:
    """Deletes what ``table`` wrote, once nothing reads it any more."""
    for t in tables:
        _delete(t.sparkSession, t.written_at)


@contextlib.contextmanager
def temporaries(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end, when their results have been written elsewhere."""
    before = set(_written)
    yield
    for path in [p for p in _written if p not in before]:
        _delete(spark, path)


def document_id() -> Column:
    return F.col("doc_id").cast("long").alias("doc_id")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone, so that no other column can clash; null text is empty."""
    reach_workers(docs.sparkSession)
    return docs.select(document_id(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def whole_rows(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct, whatever their names, so that none can clash."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias("row")


def with_texts(done: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``row`` again, with the text replaced by ``new`` where that isn't null;
    n_chars, where there is a numeric or string one, follows."""
    out = []
    for f in schema.fields:
        old = F.col("row").getField(f.name)
        if f.name == "text":
            old = F.coalesce(F.col("new").cast(f.dataType), old)
        elif f.name == "n_chars" and isinstance(f.dataType, T.NumericType | T.StringType):
            old = F.when(F.col("new").isNull(), old).otherwise(F.length("new").cast(f.dataType))
        out.append(old.alias(f.name))
    return done.select(*out)


def string_bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without copying; nulls are empty."""
    if a.null_count:
        a = a.fill_null("")
    wide = pa.types.is_large_string(a.type)
    _, offs, data = a.buffers()
    if offs is None or len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(a) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches of about max_bytes of text each (one row at least): working
    memory stays bounded however many rows Arrow sends at once."""
    for b in batches:
        if not b.num_rows:
            continue
        _, o = string_bytes(b.column(b.schema.get_field_index("text")))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(o, o[at] + max_bytes, "right")) - 1)
            yield b.slice(at, end - at)
            at = end
