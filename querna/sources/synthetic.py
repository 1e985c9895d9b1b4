"""A generator of business documents: any number of rows, made where they are needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querna import constants as K


def _pick(xs: list[str], seed: int) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(F.xxhash64("document_id", F.lit(seed)), F.lit(len(xs))) + 1).cast("int"))


def _unit(seed: int) -> Column:
    return F.pmod(F.xxhash64("document_id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000


def businesses(spark: SparkSession, n: int, index_name: str = "businesses") -> DataFrame:
    cities = sorted(p for p, v in K.GAZETTEER.items() if v[2] == "city")
    kinds = sorted(K.BUSINESS_TYPES)
    at = F.create_map(*[x for c in cities for x in (F.lit(c), F.struct(F.lit(K.GAZETTEER[c][0]).alias("lat"), F.lit(K.GAZETTEER[c][1]).alias("lng")))])
    df = spark.range(n).select(F.lit(index_name).alias("index_name"), F.col("id").alias("document_id"))
    df = df.withColumns({"category_name": _pick(kinds, 1), "city": _pick(cities, 2), "adjective": _pick(K.MODIFIERS, 3)})
    df = df.withColumn("name", F.initcap(F.concat_ws(" ", "adjective", "city", "category_name")))
    return df.withColumns({
        "lat": F.element_at(at, F.col("city"))["lat"] + (_unit(4) - 0.5) / 5, "lng": F.element_at(at, F.col("city"))["lng"] + (_unit(5) - 0.5) / 5, "health": F.round(_unit(6) * 100, 1), "rating": F.round(_unit(7) * 5, 1),
        "is_verified": _unit(8) < 0.6, "is_featured": _unit(9) < 0.05, "is_active": _unit(10) < 0.95, "is_blocked": _unit(11) < 0.02,
    }).drop("adjective")
