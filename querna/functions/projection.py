"""Projections of JSON documents and hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_columns(docs: DataFrame, content: str, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds alias: (dotted path, type) columns of a JSON text, which is parsed once; values of another type are null."""
    v = docs.withColumn("__parsed", F.try_parse_json(F.col(content)))
    return v.withColumns({a: F.try_variant_get(F.col("__parsed"), "$." + path, kind) for a, (path, kind) in wanted.items()}).drop("__parsed")


def alternative(*columns: Column) -> Column:
    """The first of the columns that isn't null or empty, in lower case; empty where all are."""
    return F.lower(F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit("")))


def materialised(docs: DataFrame, name: str = "name", category: str = "category_name", flags: dict[str, Column] | None = None) -> DataFrame:
    """Adds the columns that searches filter and rank by, made once when documents are stored."""
    return docs.withColumns({"name_lower": F.lower(F.col(name)), "category_lower": F.lower(F.col(category)), **(flags or {})})


def envelope(hits: DataFrame, index_name: str, key: str = "document_id", score: str = "score", source: list[str] | None = None) -> DataFrame:
    """(id, index, score, source): a hit's score is 1.0 where it has no rank."""
    kept = source or [c for c in hits.columns if c not in (key, score)]
    s = F.coalesce(F.col(score).cast("double"), F.lit(1.0)) if score in hits.columns else F.lit(1.0)
    return hits.select(F.col(key).alias("id"), F.lit(index_name).alias("index"), s.alias("score"), F.struct(*kept).alias("source"))


def within_hours(ts: Column, as_of: Column, hours: int) -> Column:
    return ts > as_of - F.make_interval(hours=F.lit(hours))
