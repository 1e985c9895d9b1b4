"""Queries over stored indices and dictionaries, the whole search, and the smaller forms beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querna import constants as K
from querna.catalogue import _BIZ, _PARTS, _POST, _TERMS, _bm25_sql, _chars, _corr, _h, _query, _r, _sim, _std, _t, _tok, _wsim, businesses, parts, terms
from querna.functions import analysis, fuzzy, projection, ranking
from querna.operators import dictionary, monitor, schema, search, stored, suggest
from querna.operators import index as I
from querna.plans import predicates as P
from querna.session import shared_folder
from querna.sources import store

FIELDS = ["name", "category_name"]


def _indexed(spark, d) -> str:
    at = shared_folder(spark, "index")
    stored.build(parts(spark, d), at, FIELDS, buckets=8)
    return at


def documents(spark, d) -> DataFrame:
    return _t(spark, d, "documents").withColumnRenamed("doc_id", "document_id")


# the stored index


@_query(f"select document_id, field, term, tf, cast(field_length as int) as field_length from {_POST}")
def q_index_write_read(spark, d):
    return stored.read(spark, _indexed(spark, d)).drop("positions")


@_query(f"select document_id, field, term, tf from {_POST} where term in ('ring', 'promo')")
def q_index_term_lookup(spark, d):
    return stored.read(spark, _indexed(spark, d), ["ring", "promo"]).select("document_id", "field", "term", "tf")


@_query(_bm25_sql(_PARTS, ["small", "ring"], {"name": 3.0, "category_name": 1.0}))
def q_bm25_from_index(spark, d):
    return stored.bm25(spark, _indexed(spark, d), ["small", "ring"]).withColumn("score", _r(F.col("score")))


@_query(f"select doc_id as document_id, list(i order by i) as begins from (select doc_id, ts, unnest(range(1, len(ts))) - 1 as i from (select doc_id, {_tok('text')} as ts from documents)) where ts[i + 1] = 'oner' and ts[i + 2] = 'thea' group by 1")
def q_phrase_from_index(spark, d):
    at = shared_folder(spark, "index")
    stored.build(documents(spark, d), at, ["text"], buckets=8)
    return stored.phrase(spark, at, ["oner", "thea"], "text").select("document_id", F.transform("begins", lambda x: x.cast("long")).alias("begins"))


@_query(f"select field, term, count(*) as df from {_POST} where document_id not in (select p_partkey from part where p_size < 25) group by 1, 2")
def q_index_remove(spark, d):
    at = _indexed(spark, d)
    stored.remove(spark, at, parts(spark, d).where("size < 25"))
    return stored.read(spark, at).groupBy("field", "term").agg(F.count("*").alias("df"))


_CHANGED = "(select document_id, case when size < 10 then 'fresh ' || name else name end as name, category_name from " + _PARTS + ")"


@_query(f"select 'name' as field, count(*) as doc_count, cast(sum(len({_tok('name')})) as bigint) as total_length, count(*) filter (list_contains({_tok('name')}, 'fresh')) as fresh from {_CHANGED}")
def q_index_upsert(spark, d):
    at = _indexed(spark, d)
    stored.upsert(parts(spark, d).where("size < 10").withColumn("name", F.concat(F.lit("fresh "), "name")), at, FIELDS)
    fresh = stored.read(spark, at, ["fresh"], ["name"]).agg(F.count("*").alias("fresh"))
    return stored.field_statistics(spark, at).where("field = 'name'").select("field", "doc_count", "total_length").crossJoin(fresh)  # one row each


@_query(f"select document_id, field, term, tf from {_POST}")
def q_posting_lists(spark, d):
    """Through JSON and back."""
    return stored.deserialise(stored.serialise(stored.read(spark, _indexed(spark, d)))).select("document_id", "field", "term", "tf")


@_query(f"select document_id, field, term, cast(case when term = 'ring' then 7 else tf end as bigint) as tf from {_POST} where term <> 'bolt'")
def q_posting_frequencies(spark, d):
    p = stored.read(spark, _indexed(spark, d))
    new = p.where("term in ('ring', 'bolt')").select("document_id", "field", "term", F.when(F.col("term") == "ring", 7).otherwise(0).cast("long").alias("tf"))
    return stored.set_frequency(p, new).select("document_id", "field", "term", "tf")


# the stored dictionary and corrections


def _dictionary(spark, d) -> str:
    at = shared_folder(spark, "dictionary")
    dictionary.refresh(parts(spark, d), at, "parts", FIELDS, ["name"])
    return at


@_query(f"select 'parts' as index_name, term, total_frequency from {_TERMS} where not contains(term, 'bolt') union all select 'others', w, count(*) from (select unnest(string_split(lower(c_mktsegment), ' ')) as w from customer) where length(w) >= 3 group by w having count(*) >= 2")
def q_dictionary_refresh(spark, d):
    """Two indices; one is refreshed after documents went, the other stays."""
    at = _dictionary(spark, d)
    dictionary.refresh(_t(spark, d, "customer"), at, "others", [], ["c_mktsegment"])
    dictionary.refresh(parts(spark, d).where("not contains(lower(name), 'bolt')"), at, "parts", ["name"], ["name"])
    dictionary.refresh(parts(spark, d), at, "whole", FIELDS, ["name"])
    whole = dictionary.load(spark, at, "whole").where("not contains(term, 'bolt')").select(F.lit("parts").alias("index_name"), "term", "total_frequency")
    return whole.unionByName(dictionary.load(spark, at, "others").select(F.lit("others").alias("index_name"), "term", "total_frequency"))


@_query(f"select term, total_frequency from {_TERMS} where total_frequency >= 5 order by total_frequency desc, term limit 5000")
def q_dictionary_load(spark, d):
    return dictionary.load(spark, _dictionary(spark, d), "parts", 5, 5000).select("term", "total_frequency")


@_query(f"select term, total_frequency, field_types from {_TERMS}")
def q_dictionary_json(spark, d):
    at = shared_folder(spark, "json")
    dictionary.save_json(terms(spark, d), at)
    return dictionary.load_json(spark, at).select("term", "total_frequency", "field_types")


_ASK6 = "(values ('wigdet'), ('blt'), ('smal'), ('anvill'), ('gear'), ('plat')) q(query)"


@_query(f"""with c as (select query, term, {_corr('query', 'term', 'total_frequency')} as score from {_ASK6}, {_TERMS} where levenshtein(query, term) <= 2)
select query, term as corrected, score, n as n_suggestions from (select *, row_number() over (partition by query order by score desc, term) as r, count(*) over (partition by query) as n from c) where r = 1""")
def q_correct_from_stored(spark, d):
    x = dictionary.stored_correct(spark, _dictionary(spark, d), "parts", ["wigdet", "blt", "smal", "anvill", "gear", "plat"])
    return x.select("query", "corrected", "score", "n_suggestions")


_RAW = ["wigdet**", "Smal*", "resturant", "widgetish", "anvilly", "xqzv", "smoll"]
_CLEAN = "(select query, lower(trim(regexp_replace(query, '\\*+$', ''))) as c from (values " + ", ".join(f"('{q}')" for q in _RAW) + ") q(query))"
_TYPOS = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in sorted(K.COMMON_TYPOS.items())) + "}"


@_query(f"""with q as (select * from {_CLEAN}), t as (select * from {_TERMS}),
near as (select query, term, score, row_number() over (partition by query order by score desc, term) as r from (select query, term, {_corr('c', 'term', 'total_frequency')} as score from q, t where levenshtein(c, term) <= 2)),
s as (select query, c, term, greatest({_sim('term', 'c')}, {_wsim('term', 'c')}) as sim from q, (select distinct term from t)),
f as (select query, term, row_number() over (partition by query order by sim desc, term) as r, round(round(1000 * sim) + greatest(0, 100 - 20 * abs(length(query) - length(term))) + len(list_intersect({_chars('c')}, {_chars('term')})) / greatest(length(query), length(term)) * 200
 + case when sim > 0.7 and abs(length(query) - length(term)) <= 2 then 300 else 0 end) as score from s where sim > 0.4),
a as (select q.query, c, {_TYPOS}[c] as known, n.term as near, n.score as near_score, f.term as alike, f.score as alike_score from q left join near n on n.query = q.query and n.r = 1 left join f on f.query = q.query and f.r = 1 and f.score > 600)
select query, coalesce(known, near, alike, c) as corrected, round(case when known is not null then 0.95 when near is not null then least(0.95, near_score / 1000) when alike is not null then alike_score / 1000 else 0 end, 6)::double as confidence,
 case when known is not null then 'known' when near is not null then 'symspell' when alike is not null then 'similar' else 'none' end as source from a""")
def q_correct_cascade(spark, d):
    t = terms(spark, d)
    asked = spark.createDataFrame([(q,) for q in _RAW], "query string")
    return dictionary.correct_queries(asked, t, suggest.symspell_index(t)).withColumn("confidence", _r(F.col("confidence")))


_MANY = ["smal rinng", "red bolt", "bleu anvil gear", "qqqqqqqq plate"]
_WORDS = f"(select distinct unnest(string_split(name, ' ')) as w from {_PARTS})"


@_query(f"""with q as (select query, unnest(string_split(query, ' ')) as word, generate_subscripts(string_split(query, ' '), 1) as i from (values {", ".join(f"('{q}')" for q in _MANY)}) q(query)),
b as (select query, i, word, word in (select w from {_WORDS}) as known, (select list(w order by levenshtein(word, w), w) from {_WORDS} where levenshtein(word, w) between 1 and 2) as near from q)
select query, array_to_string(list(case when not known and near is not null then near[1] else word end order by i), ' ') as corrected, count(*) filter (not known and near is not null) as changed,
 round(avg(case when known then 1.0 when near is null then 0.0 else least(0.9, 0.5 + 0.1 * len(near)) end), 6)::double as confidence from b group by 1""")
def q_correct_words(spark, d):
    words = parts(spark, d).select(F.explode(F.split("name", " ")).alias("word")).distinct()
    x = dictionary.correct_words(spark.createDataFrame([(q,) for q in _MANY], "query string"), words)
    return x.withColumn("confidence", _r(F.col("confidence")))


def _score(q: str, t: str, f: str) -> str:
    return f"""greatest(0, 1000 * {_sim(q, t)} - 50 * levenshtein({q}, {t}) + 100 * ln(1 + {f}) + case when starts_with({t}, {q}) then 300 else 0 end + case when {t} = {q} then 600 else 0 end
 + case when abs(length({t}) - length({q})) <= 2 and levenshtein({q}, {t}) <= 2 and {t} <> {q} then 200 else 0 end)"""


_RIN = "'rin'"


@_query(f"""with v as (select term, total_frequency from (select *, {_sim(_RIN, 'term')} as s, levenshtein('rin', term) as l from {_TERMS}) where s >= 0.3 or starts_with(term, 'rin') or contains(term, 'rin') or l <= 3 order by s desc, total_frequency desc, l, term limit 5)
select term as text, term as id, round({_score(_RIN, 'term', 'total_frequency')}, 4)::double as score, levenshtein('rin', term) as distance, total_frequency as frequency from v""")
def q_suggestions(spark, d):
    x = dictionary.suggestions(terms(spark, d), parts(spark, d), "rin")
    return x.select("text", "id", _r(F.col("score"), 4).alias("score"), F.col("distance").cast("long").alias("distance"), "frequency")


def _auto(cond: str) -> str:
    return f"select name as text, min(document_id) as id, arg_min(category_name, document_id) as category from {_PARTS} where {cond} group by 1 order by 1 limit 5"


@_query(f"select 'prefix' as stage, * from ({_auto("starts_with(lower(name), 're')")}) union all select 'contains', * from ({_auto("contains(lower(name), 'lt')")}) union all select 'any', * from ({_auto('length(name) > 2')})")
def q_autocomplete(spark, d):
    p = parts(spark, d)
    at = lambda stage, text: dictionary.autocomplete(p, text).select(F.lit(stage).alias("stage"), "text", "id", "category")
    return at("prefix", "re").unionByName(at("contains", "lt")).unionByName(at("any", "zzzz"))


@_query(f"select term, case when term in ({', '.join(repr(w) for w in sorted(K.BUSINESS_WORDS))}) then 1000 when length(term) <= 3 then 500 when length(term) <= 6 then 100 else 10 end as frequency from {_TERMS}")
def q_estimated_frequency(spark, d):
    return terms(spark, d).select("term", dictionary.estimated_frequency(F.col("term")).alias("frequency"))


# search forms


@_query(f"select document_id, name from {_PARTS} where len(list_filter({_std('name')}, lambda x: levenshtein(x, 'bold') <= 1)) > 0 and len(list_filter({_std('name')}, lambda x: levenshtein(x, 'smal') <= 1)) > 0")
def q_match_fuzziness(spark, d):
    r = search.Request({"match": {"name": {"query": "smal bold", "fuzziness": 1}}})
    return search.matches(parts(spark, d), r).select("document_id", "name")


@_query(f"select document_id, name from {_PARTS} where {_sim(chr(39) + 'bolt ring' + chr(39), 'name')} >= 0.3 or {_sim(chr(39) + 'bolt ring' + chr(39), 'category_name')} >= 0.3")
def q_wildcard_trigram(spark, d):
    return parts(spark, d).where(P.trigram_matches("*bolt ring*", FIELDS)).select("document_id", "name")


@_query(r"select doc_id, list_transform(regexp_extract_all(text, '(?i)[^\n]{0,40}\b(?:thea|oner)\b[^\n]{0,40}'), lambda x: regexp_replace(x, '\b(thea|oner)\b', '<em>\1</em>', 'gi')) as fragments from documents where regexp_matches(text, '(?i)\b(?:thea|oner)\b')")
def q_highlight_fragments(spark, d):
    x = _t(spark, d, "documents").where(F.col("text").rlike(r"(?i)\b(?:thea|oner)\b"))
    return x.select("doc_id", P.highlight_fragments(F.col("text"), ["thea", "oner"]).alias("fragments"))


@_query(f"select count(*) as total, max(case when lower(name) = 'bolt' then 1000.0::double when starts_with(lower(name), 'bolt') then 500.0::double else 100.0::double end) as max_score from {_PARTS} where list_contains({_std('name')}, 'bolt')")
def q_max_score(spark, d):
    return search.search(parts(spark, d), search.Request({"term": {"name": "bolt"}})).summary


@_query(r"select doc_id, len(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda x: x = 'the')) as tf from documents")
def q_term_frequency_split(spark, d):
    return _t(spark, d, "documents").select("doc_id", analysis.term_count_split(F.col("text"), "the").alias("tf"))


@_query("select event_id, json_extract_string(j, '$.meta.k') as k, json_extract_string(j, '$.meta.none') as none from (select event_id, '{\"meta\":' || props || '}' as j from events)")
def q_dotted_path(spark, d):
    e = _t(spark, d, "events").select("event_id", F.concat(F.lit('{"meta":'), "props", F.lit("}")).alias("j"))
    return e.select("event_id", analysis.dotted(F.col("j"), "meta.k").alias("k"), analysis.dotted(F.col("j"), "meta.none").alias("none"))


@_query(f"select document_id, name, tf, n as length from (select document_id, name, len({_tok('name')}) as n, len(list_distinct({_tok('name')})) as tf from {_PARTS} where size <= 50)")
def q_keyword_ignore_above(spark, d):
    """Long keyword values have no posting; the others are one term, beside the analysed field."""
    p = parts(spark, d).where("size <= 50")
    n = I.postings(p, FIELDS, keyword=("category_name",), ignore_above=3).groupBy("document_id").agg(F.count("*").alias("tf"), F.max("field_length").cast("long").alias("length"))
    return p.join(n, "document_id").select("document_id", "name", "tf", "length")


@_query("select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99 from events group by 1")
def q_performance_percentiles(spark, d):
    return monitor.percentiles(_t(spark, d, "events"), "event_type", "value", 1_000_000)


@_query(f"""select name, tier, confirmed, health, round(score, 4) as score from (select name, 'OTHER_MATCH' as tier, is_verified as confirmed, health, document_id, 1000 + case when is_verified then 2000 else 0 end + health + 10 * rating + 5 + case when is_featured then 500 else 0 end + 0.0 as score from {_BIZ})
 order by score desc, health desc, document_id limit 10""")
def q_breakdown_top(spark, d):
    b = businesses(spark, d).withColumn("tier", F.lit(1))
    final = ranking.tiered_score(F.col("tier"), F.col("is_verified"), F.col("health"), F.col("rating"), F.lit(5), F.col("is_featured"), F.lit(1.0))
    x = ranking.breakdown_top(b.withColumn("final_score", final))
    return x.withColumn("score", _r(F.col("score"), 4))


_NEAR = f"(select *, 6.4 + (document_id % 40) / 100 as lat, 3.3 + (document_id % 30) / 100 as lng from {_BIZ})"


@_query(f"""select document_id, name, round(least(1, greatest(0, 1 - m / 5000)), 6)::double as location_score from (select *, {_h('lat', 'lng', '6.5083', '3.3833')} as m from {_NEAR})
 where m <= 5000 and list_contains({_std('name')}, 'customer') order by location_score desc, health desc, document_id limit 100""")
def q_search_near(spark, d):
    """Text, place, ranking and page in one call."""
    b = businesses(spark, d).withColumns({"lat": 6.4 + (F.col("document_id") % 40) / 100, "lng": 3.3 + (F.col("document_id") % 30) / 100, "updated_at": F.lit(None).cast("timestamp"), "name": F.lower("name")})
    x = search.search_near(b.withColumn("is_verified", F.lit(None).cast("boolean")).withColumn("is_featured", F.lit(None).cast("boolean")).withColumn("rating", F.lit(0.0)), "customer in yaba", F.lit("2024-01-01").cast("date"), size=100).hits
    back = _t(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("name"))
    return x.select("document_id", "location_score").join(F.broadcast(back), "document_id").select("document_id", "name", _r(F.col("location_score")).alias("location_score"))


@_query("select source as index_name, count(*) as documents from documents where source = 'src1' group by 1")
def q_scan_index(spark, d):
    at = shared_folder(spark, "documents")
    store.write(_t(spark, d, "documents").withColumnRenamed("source", "index_name"), at)
    return store.scan(spark, at, "src1").groupBy("index_name").agg(F.count("*").alias("documents"))


@_query("select vec_id, case when vec_id % 10 = 0 then list_transform(embedding, lambda x: cast(0 as float)) else embedding end as embedding from embeddings")
def q_embedding_store(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", "embedding")
    new = e.where("vec_id % 10 = 0").withColumn("embedding", F.transform("embedding", lambda x: F.lit(0).cast("float")))
    return store.upsert(e, new, ["vec_id"], [])


@_query(f"select document_id as id, 'parts' as index, case when size > 25 then price else 1.0::double end as score, name from {_PARTS}")
def q_envelope(spark, d):
    p = parts(spark, d).withColumn("score", F.when(F.col("size") > 25, F.col("price").cast("double")))
    return projection.envelope(p, "parts").select("id", "index", "score", "source.name")


@_query(f"""with x as (select document_id, w, label from (select document_id, unnest({_tok('name')}) as w, 'A' as label from {_PARTS} union all select document_id, unnest({_tok('category_name')}), 'B' from {_PARTS}) where length(w) >= 2),
m as (select document_id, w, min(label) as label from x group by 1, 2), a as (select document_id, list(w || '/' || label order by w) as lexemes from m group by 1)
select document_id, coalesce(lexemes, []) as lexemes, len({_tok('name')}) as name_length, case when size > 10 then 2.0::double else 1.0::double end as boost_factor from {_PARTS} left join a using (document_id)""")
def q_processed_business(spark, d):
    x = I.processed(parts(spark, d), {"name": "A", "category_name": "B"}, F.when(F.col("size") > 10, 2.0))
    lexemes = F.transform("lexemes", lambda s: F.concat_ws("/", s["term"], s["label"]))
    return x.select("document_id", lexemes.alias("lexemes"), F.col("field_lengths")["name"].cast("long").alias("name_length"), "boost_factor")


@_query(f"""with t as (select 'name' as field, unnest(string_split_regex(lower(name), '[^a-z0-9]+')) as term from {_PARTS} union all select 'tags', unnest(string_split_regex(lower(category_name), '[^a-z0-9]+')) from {_PARTS})
select field, term, count(*) as frequency from t where length(term) >= 3 and regexp_matches(term, '^[a-z]') and not regexp_matches(term, '[0-9]{{3}}') group by 1, 2""")
def q_field_terms(spark, d):
    """A string field and an array field."""
    p = parts(spark, d).select("name", F.split("category_name", " ").alias("tags"))
    return suggest.field_terms(p, ["name", "tags"])


@_query("select name, count(*) as versions, max(version) as newest from (select distinct p_brand as name, p_size as version from part where not (p_brand = 'Brand#4' or (p_brand = 'Brand#17' and p_size = 1))) group by 1")
def q_schema_versions(spark, d):
    v = _t(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_size").alias("version")).distinct()
    return schema.listed(schema.deleted(schema.deleted(v, "Brand#4"), "Brand#17", 1))


@_query("select c_custkey, 'customers' as name, 3 as version from customer")
def q_schema_stamp(spark, d):
    return schema.stamp(_t(spark, d, "customer"), "customers", 3).select("c_custkey", "_schema.*")


@_query(f"select term, {_sim(chr(39) + 'bolts' + chr(39), 'term')} >= 0.1 and levenshtein('bolts', term) <= 5 and abs(length(term) - 5) <= 3 as relevant from {_TERMS}")
def q_is_relevant(spark, d):
    return terms(spark, d).select("term", fuzzy.is_relevant(F.lit("bolts"), F.col("term")).alias("relevant"))


@_query("select event_type, pending, per_minute, round(case when per_minute > 0 then pending / per_minute end, 6) as minutes from (select event_type, count(*) filter (value <= 30) as pending, count(*) filter (value > 30) / 60 as per_minute from events group by 1)")
def q_eta(spark, d):
    e = _t(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") <= 30).alias("pending"), (F.count_if(F.col("value") > 30) / 60).alias("per_minute"))
    return e.withColumn("minutes", _r(monitor.eta(F.col("pending"), F.col("per_minute"))))
