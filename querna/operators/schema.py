"""Mapping inference, versioned schemas, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_EMAIL, _URL, _DATE = r"^[^ @]+@[^ @]+\.[^ @]+$", r"^https?://", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}|^[0-9]{13}$"


def string_type(name: Column, value: Column) -> Column:
    """The mapping type of a string by its name and shape."""
    return (
        F.when(name.rlike("(?i)e?mail") & value.rlike(_EMAIL), "keyword").when(value.rlike(_URL), "keyword").when(value.rlike(_DATE), "date")
        .when((F.length(value) <= 50) & ~value.contains(" "), "keyword").otherwise("text")
    )


def json_fields(docs: DataFrame, content: str, key: str) -> DataFrame:
    """(key, path, kind, value) of the JSON's own fields, one level deep a call, nulls skipped."""
    m = docs.select(key, F.explode(F.from_json(F.col(content), "map<string,string>")).alias("path", "value")).where("value is not null")
    kind = (
        F.when(F.col("value").rlike(r"^-?[0-9]+$"), "integer").when(F.col("value").rlike(r"^-?[0-9]*\.[0-9]+([eE][-+]?[0-9]+)?$"), "float")
        .when(F.col("value").isin("true", "false"), "boolean").when(F.col("value").startswith("{"), "object").when(F.col("value").startswith("["), "array")
        .otherwise(string_type(F.col("path"), F.col("value")))
    )
    return m.select(key, F.regexp_replace("path", "^source\\.", "").alias("path"), kind.alias("kind"), "value")


def infer_mapping(docs: DataFrame, content: str = "content", key: str = "document_id") -> DataFrame:
    """(path, kind): of several kinds the one of the last document, by id."""
    return json_fields(docs, content, key).groupBy("path").agg(F.max_by("kind", key).alias("kind"))


def mapping_of(schema) -> dict[str, dict]:
    """The mapping of typed columns, structs as dotted paths and arrays as <path>.array."""
    names = {"string": "text", "boolean": "boolean", "date": "date", "timestamp": "date"}
    out: dict[str, dict] = {}

    def walk(prefix: str, t) -> None:
        kind = t.typeName()
        if kind == "struct":
            for f in t.fields:
                walk(f"{prefix}.{f.name}" if prefix else f.name, f.dataType)
        elif kind == "array":
            walk(f"{prefix}.array", t.elementType)
        else:
            m = {"type": names.get(kind, "float" if kind in ("double", "float", "decimal") else "integer")}
            if m["type"] == "text" and prefix.split(".")[-1] in ("name", "title"):
                m["fields"] = {"keyword": {"type": "keyword", "ignore_above": 256}}
            out[prefix] = m

    walk("", schema)
    return out


def analyzers_of(mapping: dict[str, dict]) -> dict[str, dict]:
    return {f: {"analyzer": m.get("analyzer", "keyword" if m["type"] in ("keyword", "boolean", "integer", "float") else "standard"), "weight": m.get("boost", 1.0)} for f, m in mapping.items()}


def latest(versions: DataFrame) -> DataFrame:
    """The newest version of each name."""
    w = Window.partitionBy("name").orderBy(F.desc("version"))
    return versions.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def listed(versions: DataFrame) -> DataFrame:
    """(name, versions, newest) of all schemas."""
    return versions.groupBy("name").agg(F.count("*").alias("versions"), F.max("version").alias("newest"))


def deleted(versions: DataFrame, name: str, version: int | None = None) -> DataFrame:
    """Without a schema, or without one version of it."""
    gone = F.col("name") == name
    return versions.where(~(gone if version is None else gone & (F.col("version") == version)))


def register(versions: DataFrame, name: str, body: str) -> DataFrame:
    row = versions.where(F.col("name") == name).agg(F.coalesce(F.max("version") + 1, F.lit(1)).cast("int").alias("version"))
    return versions.unionByName(row.select(F.lit(name).alias("name"), "version", F.lit(body).alias("schema")))


def errors(rules: dict[str, dict], kinds: dict[str, str]) -> Column:
    """Validation messages of a row: required, type, min, max, pattern and enum."""
    out = []
    for f, r in rules.items():
        c = F.col(f) if f in kinds else F.lit(None).cast("string")
        if r.get("required"):
            out.append(F.when(c.isNull(), f"{f}: required"))
        if f not in kinds:
            continue
        want, have = r.get("type"), kinds[f]
        ok = {"string": have == "string", "number": have in ("int", "bigint", "double", "float", "smallint") or have.startswith("decimal"), "boolean": have == "boolean", "date": have in ("date", "timestamp"), "object": have.startswith("struct"), "array": have.startswith("array")}
        if want and not ok.get(want, True):
            out.append(F.when(c.isNotNull(), f"{f}: not a {want}"))
            continue
        size = F.length(c) if have == "string" else c
        for bound, bad in (("min", lambda s, b: s < b), ("max", lambda s, b: s > b)):
            if bound in r:
                out.append(F.when(bad(size, r[bound]), f"{f}: {bound} {r[bound]}"))
        if "pattern" in r:
            out.append(F.when(~c.cast("string").rlike(r["pattern"]), f"{f}: pattern"))
        if "enum" in r:
            out.append(F.when(~c.isin(r["enum"]), f"{f}: not allowed"))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def validate(docs: DataFrame, rules: dict[str, dict], strict: bool = False) -> DataFrame:
    """Adds errors; strict rejects fields that no rule names."""
    e = errors(rules, dict(docs.dtypes))
    if strict and (extra := [c for c in docs.columns if c not in rules]):
        e = F.concat(e, F.array(*[F.lit(f"{c}: unknown field") for c in extra]))
    return docs.withColumn("errors", e)


def stamp(docs: DataFrame, name: str, version: int) -> DataFrame:
    return docs.withColumn("_schema", F.struct(F.lit(name).alias("name"), F.lit(version).alias("version")))
