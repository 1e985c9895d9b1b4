"""All search queries over the provided tables, by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querna import constants as K
from querna.functions import analysis, fuzzy, geo, nlp, projection, ranking
from querna.functions.porter import stem_tokens
from querna.operators import index as I
from querna.operators import monitor, schema, search, suggest, textsearch, vector
from querna.plans import predicates as P
from querna.plans import query as Q
from querna.session import shared_folder
from querna.sources import catalog, store, synthetic

Run = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Run] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Run) -> Run:
        name = f.__name__.removeprefix("q_")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Run]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# corpus views


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def parts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_partkey").alias("document_id"), F.col("p_name").alias("name"), F.col("p_type").alias("category_name"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))


def flagged(spark: SparkSession, d: str) -> DataFrame:
    """Documents with flags from their labels; unlabelled ones have none."""
    lab = _t(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("is_verified"), (F.col("toxic") == 1).alias("is_blocked"))
    return _t(spark, d, "documents").join(lab, "doc_id", "left").withColumn("is_active", F.col("n_chars") > 100).withColumnRenamed("doc_id", "document_id")


def businesses(spark: SparkSession, d: str) -> DataFrame:
    """Customers as businesses: health and flags derived from the balance and the key."""
    k = F.col("c_custkey")
    return _t(spark, d, "customer").select(
        k.alias("document_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category_name"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("c_acctbal") / 100)).alias("health"),
        ((k % 50) / 10).alias("rating"), (k % 3 == 0).alias("is_verified"), (k % 17 == 0).alias("is_featured"), ((k * 7) % 2000).cast("double").alias("views"),
    )


_PARTS = "(select p_partkey as document_id, p_name as name, p_type as category_name, p_brand as brand, p_retailprice as price, p_size as size from part)"
_BIZ = """(select c_custkey as document_id, c_name as name, c_mktsegment as category_name, greatest(0.0, least(100.0, c_acctbal / 100)) as health, (c_custkey % 50) / 10 as rating,
 c_custkey % 3 = 0 as is_verified, c_custkey % 17 = 0 as is_featured, cast((c_custkey * 7) % 2000 as double) as views from customer)"""
_FLAGGED = "(select doc_id as document_id, text, lang, source, n_chars, quality = 1 as is_verified, toxic = 1 as is_blocked, n_chars > 100 as is_active from documents left join labels using (doc_id))"
_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(K.STOP_WORDS)) + "]"


def _std(c: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower({c}), '[^a-z0-9_ \t\n\r\f\v]', ' ', 'g'), '[ \t\n\r\f\v]+'), lambda x: x <> '')"


def _tok(c: str) -> str:
    return f"list_filter({_std(c)}, lambda x: not list_contains({_STOP}, x))"


def _grams(c: str) -> str:
    return f"list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


def _sim(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({_grams(a)}, {_grams(b)})) / nullif(len(list_distinct(list_concat({_grams(a)}, {_grams(b)}))), 0), 0)"


def _wsim(q: str, c: str) -> str:
    """The greatest similarity of q to any run of neighbouring words."""
    ws = f"list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda z: z <> '')"
    runs = f"flatten(list_transform(range(1, len({ws}) + 1), lambda i: list_transform(range(i, len({ws}) + 1), lambda j: array_to_string(({ws})[i:j], ' '))))"
    return f"coalesce(list_max(list_transform({runs}, lambda r: {_sim(q, 'r')})), 0)"


def _soundex(c: str) -> str:
    """Letters to digits, h and w left out, runs as one, vowels dropped; for words that begin with another letter than h and w."""
    code = f"translate(replace(replace(upper({c}), 'H', ''), 'W', ''), 'ABCDEFGIJKLMNOPQRSTUVXYZ', '012301202245501262301202')"
    for k in range(7):
        code = f"regexp_replace({code}, '{k}+', '{k}', 'g')"
    return f"rpad(substring(upper({c}), 1, 1) || substring(replace(substring({code}, 2), '0', ''), 1, 3), 4, '0')"


def _chars(c: str) -> str:
    return f"list_distinct(string_split({c}, ''))"


def _simple(a: str, b: str) -> str:
    return f"(0.7 * len(list_intersect({_chars(a)}, {_chars(b)})) / len(list_distinct(list_concat({_chars(a)}, {_chars(b)}))) + 0.3 * least(length({a}), length({b})) / greatest(length({a}), length({b})))"


def _h(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2))"
    return f"(2 * {K.EARTH_RADIUS_M} * atan2(sqrt{a}, sqrt(1 - {a})))"


def _r(c: Column, n: int = 6) -> Column:
    return F.round(c, n)


# analysis


@_query(f"select doc_id, {_std('text')} as tokens from documents")
def q_tokenize_standard(spark, d):
    return _t(spark, d, "documents").select("doc_id", analysis.standard_tokens(F.col("text")).alias("tokens"))


@_query(r"select doc_id, list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') as tokens from documents")
def q_tokenize_whitespace(spark, d):
    return _t(spark, d, "documents").select("doc_id", analysis.whitespace_tokens(F.col("text")).alias("tokens"))


@_query("select p_partkey, flatten(list_transform(range(1, length(p_name)), lambda i: list_transform(range(2, least(3, length(p_name) - i + 1) + 1), lambda n: substring(p_name, i, n)))) as tokens from part")
def q_tokenize_ngram(spark, d):
    return _t(spark, d, "part").select("p_partkey", analysis.ngram_tokens(F.col("p_name")).alias("tokens"))


@_query("select p_partkey, [lower(trim(p_name))] as tokens from part")
def q_tokenize_keyword(spark, d):
    return _t(spark, d, "part").select("p_partkey", analysis.keyword_token(F.col("p_name")).alias("tokens"))


@_query(r"select p_partkey, list_filter(string_split_regex(lower(trim(p_name)), '[ \t\n\r\f\v]+'), lambda x: x <> '') as tokens from part")
def q_analyze_lowercase(spark, d):
    return _t(spark, d, "part").select("p_partkey", analysis.AnalyzerRegistry().get("lowercase")(F.col("p_name")).alias("tokens"))


@_query(f"select doc_id, {_tok('text')} as tokens from documents")
def q_analyze_standard(spark, d):
    return _t(spark, d, "documents").select("doc_id", analysis.AnalyzerRegistry().get("standard")(F.col("text")).alias("tokens"))


@_query(rf"select conv_id, turn, list_filter(string_split_regex(lower(text), '[ \t\n\r\f\v]+'), lambda x: x <> '' and not list_contains({_STOP}, x)) as tokens from conversations")
def q_analyze_custom(spark, d):
    a = analysis.custom_analyzer({"tokenizer": {"type": "whitespace"}, "filters": ["lowercase", "stopword"]})
    return _t(spark, d, "conversations").select("conv_id", "turn", a(F.col("text")).alias("tokens"))


@_query()
def q_porter_stem(spark, d):
    return _t(spark, d, "part").select("p_partkey", stem_tokens(analysis.standard_tokens(F.col("p_name"))).alias("stems"))


@_query(r"select doc_id, list_filter(string_split_regex(lower(text), '[ \t\n\r&.-]+'), lambda x: length(x) >= 3 and regexp_full_match(x, '[a-z0-9]+')) as words from documents")
def q_extract_words(spark, d):
    return _t(spark, d, "documents").select("doc_id", analysis.words_longer(F.col("text")).alias("words"))


@_query(r"select doc_id, len(regexp_extract_all(text, '(?i)\bthe\b')) as tf from documents")
def q_term_frequency(spark, d):
    return _t(spark, d, "documents").select("doc_id", analysis.term_count(F.col("text"), "the*").cast("long").alias("tf"))


@_query("select p_partkey, case when p_size >= 10 then 'A' when p_size >= 5 then 'B' when p_size >= 2 then 'C' else 'D' end as label from part")
def q_weight_label(spark, d):
    return _t(spark, d, "part").select("p_partkey", analysis.weight_label(F.col("p_size")).alias("label"))


@_query(r"""with t as (select distinct unnest(string_split(text, ' ')) as raw from documents), c as (select raw, regexp_replace(regexp_replace(lower(raw), '[^a-z0-9_-]', '', 'g'), '^-+|-+$', '', 'g') as x from t)
select raw, case when length(x) >= 2 and not regexp_full_match(x, '[0-9]+') then x end as token from c""")
def q_sanitize_tokens(spark, d):
    return _t(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("raw")).distinct().select("raw", analysis.clean_token(F.col("raw")).alias("token"))


# index and scoring

_POST = f"(select document_id, field, term, count(*) as tf, any_value(n) as field_length from (select document_id, field, unnest(ts) as term, len(ts) as n from (select document_id, 'name' as field, {_tok('name')} as ts from {_PARTS} union all select document_id, 'category_name', {_tok('category_name')} from {_PARTS})) group by 1, 2, 3)"


@_query(f"select document_id, field, term, tf, cast(field_length as int) as field_length from {_POST}")
def q_postings_build(spark, d):
    return I.postings(parts(spark, d), ["name", "category_name"])


@_query(f"select doc_id as document_id, 'text' as field, term, count(*) as tf, cast(any_value(n) as int) as field_length, list(i order by i) as positions from (select doc_id, unnest(ts) as term, len(ts) as n, cast(generate_subscripts(ts, 1) - 1 as int) as i from (select doc_id, {_tok('text')} as ts from documents)) group by doc_id, term")
def q_postings_positions(spark, d):
    return I.postings(_t(spark, d, "documents").withColumnRenamed("doc_id", "document_id"), ["text"], positions=True)


@_query(f"select term, count(*) as df from (select distinct doc_id, unnest({_tok('text')}) as term from documents) group by 1 order by df desc, term limit 100")
def q_term_df_top100(spark, d):
    return I.document_frequency(_t(spark, d, "documents"), ["text"]).orderBy(F.desc("df"), F.asc("term")).limit(100)


@_query(f"select 'text' as field, count(*) as doc_count, cast(sum(n) as bigint) as total_length, round(avg(n), 6) as avg_length from (select len({_tok('text')}) as n from documents)")
def q_field_stats(spark, d):
    return I.field_stats(I.doc_lengths(_t(spark, d, "documents").withColumnRenamed("doc_id", "document_id"), ["text"])).withColumn("avg_length", _r(F.col("avg_length")))


@_query(f"select doc_id as document_id, 'text' as field, cast(len({_tok('text')}) as int) as field_length from documents")
def q_doc_lengths(spark, d):
    return I.doc_lengths(_t(spark, d, "documents").withColumnRenamed("doc_id", "document_id"), ["text"])


def _bm25_sql(view: str, terms: list[str], fields: dict[str, float]) -> str:
    scan = ", ".join(f"len({_tok(f)}) as n_{f}, " + ", ".join(f"len(list_filter({_tok(f)}, lambda x: x = '{w}')) as t{i}_{f}" for i, w in enumerate(terms)) for f in fields)
    has = [" or ".join(f"t{i}_{f} > 0" for f in fields) for i in range(len(terms))]
    part = lambda i, f, w: f"case when t{i}_{f} > 0 then ln((N - df{i} + 0.5) / (df{i} + 0.5) + 1) * t{i}_{f} * 2.2 / (t{i}_{f} + 1.2 * (0.25 + 0.75 * n_{f} / avg_{f})) * {w} else 0 end"
    return f"""with s as (select document_id, {scan} from {view}),
g as (select count(*) as N, {", ".join(f"avg(n_{f}) as avg_{f}" for f in fields)}, {", ".join(f"count(*) filter ({h}) as df{i}" for i, h in enumerate(has))} from s)
select document_id, round({" + ".join(part(i, f, w) for i in range(len(terms)) for f, w in fields.items())}, 6) as score from s, g where {" or ".join(has)}"""


@_query(_bm25_sql(_PARTS, ["bolt"], {"name": 3.0}))
def q_bm25_term(spark, d):
    return I.bm25_search(parts(spark, d), ["bolt"], ["name"]).withColumn("score", _r(F.col("score")))


@_query(_bm25_sql(_PARTS, ["small", "bolt"], {"name": 3.0, "category_name": 1.0}))
def q_bm25_multi_field(spark, d):
    return I.bm25_search(parts(spark, d), ["small", "bolt"], ["name", "category_name"]).withColumn("score", _r(F.col("score")))


@_query(_bm25_sql("(select doc_id as document_id, text from documents)", ["attention", "oner", "ering"], {"text": 1.0}))
def q_bm25_documents(spark, d):
    return I.bm25_search(_t(spark, d, "documents").withColumnRenamed("doc_id", "document_id"), ["attention", "oner", "ering"], ["text"]).withColumn("score", _r(F.col("score")))


@_query(_bm25_sql(_PARTS, ["small", "ring"], {"name": 3.0, "category_name": 1.0}))
def q_bm25_from_postings(spark, d):
    p = I.postings(parts(spark, d), ["name", "category_name"])
    stats = I.field_stats(I.doc_lengths(parts(spark, d), ["name", "category_name"]))
    return I.bm25_from_postings(p, stats, None, ["small", "ring"]).withColumn("score", _r(F.col("score")))


@_query(f"""with b as ({_bm25_sql(_PARTS, ["bolt"], {"name": 3.0})}) select document_id, round(0.3 * case when name = 'bolt' then 1000 when starts_with(name, 'bolt') then 500 else 100 end + 0.7 * score, 4) as final_score from b join {_PARTS} using (document_id)""")
def q_bm25_rerank_blend(spark, d):
    hit = parts(spark, d).withColumn("db_score", P.base_rank(F.col("name"), "bolt")).join(I.bm25_search(parts(spark, d), ["bolt"], ["name"]).withColumn("score", _r(F.col("score"))), "document_id")
    return I.blend(hit).select("document_id", _r(F.col("final_score"), 4).alias("final_score"))


_AT = f"(select doc_id, x, row_number() over (partition by doc_id order by i) as k, i as pos from (select doc_id, unnest(ts) as x, generate_subscripts(ts, 1) - 1 as i from (select doc_id, {_tok('text')} as ts from documents)) where x in ('thea', 'oner'))"


@_query(f"""with w as (select doc_id, pos, max(case when x = 'thea' then pos end) over s as a, max(case when x = 'oner' then pos end) over s as b from {_AT} window s as (partition by doc_id order by pos rows unbounded preceding)),
c as (select doc_id, least(a, b) as low, min(pos) as high from w where a is not null and b is not null group by 1, 2) select doc_id as document_id, round(sum(1.0::double / (high - low + 1)), 6) as score from c group by 1""")
def q_cover_density(spark, d):
    p = I.postings(_t(spark, d, "documents").withColumnRenamed("doc_id", "document_id"), ["text"], positions=True)
    return I.cover_density(p, ["thea", "oner"]).withColumn("score", _r(F.col("score")))


@_query(f"select document_id, x as term, min(label) as label from (select document_id, unnest({_tok('name')}) as x, 'A' as label from {_PARTS} union all select document_id, unnest({_tok('category_name')}), 'B' from {_PARTS}) where length(x) >= 2 group by 1, 2")
def q_weighted_lexemes(spark, d):
    return I.weighted_lexemes(parts(spark, d), {"name": "A", "category_name": "B"})


@_query("select field, weight from (values ('name', 10.0), ('businessTitle', 10.0), ('category_name', 2.0), ('summary', 1.5), ('tags', 1.0), ('price', 1.0)) t(field, weight)")
def q_field_weights(spark, d):
    w = I.infer_weights(["name", "businessTitle", "category_name", "summary", "tags", "price"])
    return spark.createDataFrame(list(w.items()), "field string, weight double").withColumn("weight", F.col("weight").cast("decimal(3,1)"))


# matching


def _match(name: str, request: search.Request, where: str, rank: str = "case when lower(name) = '{q}' then 1000.0 when starts_with(lower(name), '{q}') then 500.0 else 100.0 end"):
    text = Q.text_of(request.query) if request.query is not None else ""
    rank = rank.replace("{q}", text.lower())

    def run(spark, d):
        hit = search.matches(parts(spark, d), request)
        return hit.select("document_id", "name", search.score_column(request).cast("double").alias("score"))

    _QUERIES[name] = run
    _SQL[name] = f"select document_id, name, cast({rank} as double) as score from {_PARTS} where {where}"


_match("match_all", search.Request({"match_all": {"boost": 2.0}}), "true", "2.0")
_match("match_and", search.Request({"match": {"name": "small bolt"}}), f"list_has_all({_std('name')}, ['small', 'bolt'])")
_match("match_or", search.Request({"match": {"name": {"query": "small bolt", "operator": "or"}}}), f"list_has_any({_std('name')}, ['small', 'bolt'])")
_match("term_exact", search.Request({"term": {"name": "gear"}}), f"list_contains({_std('name')}, 'gear')")
_match("phrase", search.Request('"red ring"'), r"regexp_matches(name, '\bred ring\b')", "100.0")
_match("wildcard_prefix", search.Request({"wildcard": {"field": "name", "value": "sm*"}}), "lower(name) like 'sm%'", f"1000 * {_wsim(chr(39) + 'sm' + chr(39), 'name')}")
_match("wildcard_suffix", search.Request({"wildcard": {"name": {"value": "*ring"}}}), "lower(name) like '%ring'", f"1000 * {_wsim(chr(39) + 'ring' + chr(39), 'name')}")
_match("wildcard_contains", search.Request("*d g*"), "lower(name) like '%d g%'", f"1000 * {_wsim(chr(39) + 'd g' + chr(39), 'name')}")
_match("wildcard_single", search.Request({"wildcard": {"field": "name", "value": "?ed ri?g"}}), "lower(name) like '_ed ri_g'", f"1000 * {_wsim(chr(39) + 'ed rig' + chr(39), 'name')}")
_match("query_bool", search.Request({"bool": {"must": [{"match": {"name": "bolt"}}], "should": [{"term": {"name": "red"}}], "must_not": [{"term": {"name": "old"}}]}}), f"list_contains({_std('name')}, 'bolt') and not list_contains({_std('name')}, 'old')", "case when lower(name) = 'bolt red' then 1000 when starts_with(lower(name), 'bolt red') then 500 else 100 end")
_match("query_range", search.Request({"range": {"price": {"gte": 950, "lt": 1000}}}), "price >= 950 and price < 1000", "case when name = '' then 1000 when starts_with(name, '') then 500 else 100 end")
_match("boost_clauses", search.Request({"bool": {"should": [{"match": {"field": "name^3", "value": "red"}}, {"match": {"field": "name", "value": "ring"}}]}}, rank="boost"), f"list_has_any({_std('name')}, ['red', 'ring'])", f"case when list_contains({_std('name')}, 'red') then 3 else 0 end + case when list_contains({_std('name')}, 'ring') then 1 else 0 end")


@_query(f"select document_id, is_verified, is_blocked from {_FLAGGED} where is_active and is_verified and not is_blocked")
def q_filter_visibility(spark, d):
    return flagged(spark, d).where(P.visible()).select("document_id", "is_verified", "is_blocked")


@_query(f"select document_id, is_verified, is_blocked from {_FLAGGED} where coalesce(is_active, true) and coalesce(is_verified, true) and not coalesce(is_blocked, false)")
def q_filter_visibility_lenient(spark, d):
    return flagged(spark, d).where(P.visible(strict=False)).select("document_id", "is_verified", "is_blocked")


@_query(f"select document_id, name from {_PARTS} where category_name ilike '%prom%' and price >= 905 and (brand = 'Brand#4' or brand = 'Brand#17' or size < 10) and not (name ilike '%old%')")
def q_filter_bool(spark, d):
    f = {"bool": {"must": [{"term": {"field": "category_name", "value": "prom"}}, {"range": {"price": {"gte": 905}}}], "should": [{"term": {"brand": "Brand#4"}}, {"term": {"brand": "Brand#17"}}, {"range": {"size": {"lt": 10}}}], "must_not": [{"term": {"name": "old"}}]}}
    return parts(spark, d).where(P.filter_condition(f)).select("document_id", "name")


@_query(f"select document_id, name from {_PARTS} where (size > 20 and (name ilike '%red%' or name ilike '%blue%')) and not (price > 950 and size = 30)")
def q_filter_nested_bool(spark, d):
    f = {"bool": {"must": [{"range": {"field": "size", "gt": 20}}, {"bool": {"should": [{"term": {"name": "red"}}, {"term": {"name": "blue"}}]}}], "must_not": [{"bool": {"must": [{"range": {"price": {"gt": 950}}}, {"range": {"size": {"eq": 30}}}]}}]}}
    return parts(spark, d).where(P.filter_condition(f)).select("document_id", "name")


@_query("select o_orderkey from orders where o_totalprice >= 1000 and o_totalprice < 200000 and o_orderpriority >= '3'")
def q_filter_range(spark, d):
    f = {"range": {"o_totalprice": {"gte": 1000, "lt": 200000}, "o_orderpriority": {"gte": "3"}}}
    return _t(spark, d, "orders").where(P.filter_condition(f)).select("o_orderkey")


@_query(f"select document_id from {_FLAGGED} where (is_verified or is_verified is null) and lang = 'fr' and not (source = 'src1')")
def q_filter_flags(spark, d):
    f = {"bool": {"must": [{"term": {"is_verified": True}}, {"term": {"lang.keyword": "fr"}}], "must_not": [{"term": {"source": "src1"}}]}}
    return flagged(spark, d).where(P.filter_condition(f)).select("document_id")


@_query(f"select document_id from {_PARTS} where list_has_any({_std('name')}, ['gear', 'ring'])")
def q_filter_array(spark, d):
    docs = parts(spark, d).withColumn("tags", analysis.standard_tokens(F.col("name")))
    return docs.where(P.filter_condition({"terms": {"tags": ["gear", "ring"]}}, arrays=frozenset({"tags"}))).select("document_id")


@_query(f"select document_id, name, price from {_PARTS} order by price desc, name, document_id limit 10")
def q_sort_field(spark, d):
    return search.search(parts(spark, d), search.Request(None, sort="price:desc,name:asc")).hits.select("document_id", "name", "price")


@_query(f"select document_id, name from {_PARTS} where list_contains({_std('name')}, 'bolt') order by document_id limit 10 offset 10")
def q_page_2(spark, d):
    return search.search(parts(spark, d), search.Request({"term": {"name": "bolt"}}, start=10)).hits.select("document_id", "name")


@_query(f"select count(*) as total from {_PARTS} where list_contains({_std('name')}, 'bolt')")
def q_count_total(spark, d):
    return search.search(parts(spark, d), search.Request({"term": {"name": "bolt"}})).total


@_query(f"select total, 2 as current_page, cast(ceil(total / 10.0) as int) as total_pages, 2 < ceil(total / 10.0) as has_next, true as has_previous from (select count(*) as total from {_PARTS} where list_contains({_std('name')}, 'bolt'))")
def q_page_meta(spark, d):
    t = search.search(parts(spark, d), search.Request({"term": {"name": "bolt"}})).total
    pages = F.ceil(F.col("total") / 10).cast("int")
    return t.select("total", F.lit(2).alias("current_page"), pages.alias("total_pages"), (F.lit(2) < pages).alias("has_next"), F.lit(True).alias("has_previous"))


@_query(f"select 'category_name' as field, category_name as key, count(*) as count from {_PARTS} where list_contains({_std('name')}, 'red') group by 2 union all select 'brand', brand, count(*) from {_PARTS} where list_contains({_std('name')}, 'red') group by 2")
def q_facet_counts(spark, d):
    return search.search(parts(spark, d), search.Request({"term": {"name": "red"}}, facets=["category_name", "brand"])).facets


@_query(f"select document_id, regexp_replace(name, '\\b(red|ring)\\b', '<em>\\1</em>', 'gi') as highlight_name from {_PARTS} where list_has_all({_std('name')}, ['red', 'ring']) order by document_id limit 10")
def q_highlight_terms(spark, d):
    return search.search(parts(spark, d), search.Request({"match": {"name": "red ring"}}, sort="document_id", highlight=["name"])).hits.select("document_id", "highlight_name")


@_query(f"select document_id, case when n = 'small' then 1.0 when starts_with(n, 'small') then 0.8 when contains(n, 'small') then 0.6 else 0.4 end as score from (select *, lower(name) as n, lower(category_name) as c from {_PARTS}) where contains(n, 'small') or contains(c, 'small')")
def q_fallback_ilike_rank(spark, d):
    return parts(spark, d).select("document_id", P.contains_rank(F.col("name"), F.col("category_name"), "small").cast("decimal(2,1)").alias("score")).where("score is not null")


@_query("select document_id, 'part' as index_name, 1.0 as score from " + _PARTS)
def q_hit_envelope(spark, d):
    return parts(spark, d).select("document_id", F.lit("part").alias("index_name"), F.coalesce(F.lit(None).cast("decimal(2,1)"), F.lit("1.0").cast("decimal(2,1)")).alias("score"))


# ranking

_LEV = lambda a, b: f"case when abs(length({a}) - length({b})) > 3 then abs(length({a}) - length({b})) else levenshtein({a}, {b}) end"
_CLS = f"""(select *, case when n = 'red rings' then 'perfect' when starts_with(n, 'red rings') then 'prefix' when contains(n, 'red rings') then 'substring'
 when len(list_filter(ws, lambda w: w = 'red' or starts_with(w, 'red'))) > 0 and len(list_filter(ws, lambda w: w = 'rings' or starts_with(w, 'rings'))) > 0 then 'all_words' end as ex,
 {_LEV("n", "'red rings'")} as lev, {_simple("n", "'red rings'")} as sim,
 (case when len(list_filter(ws, lambda w: {_LEV("w", "'red'")} <= 2)) > 0 then 1 else 0 end + case when len(list_filter(ws, lambda w: {_LEV("w", "'rings'")} <= 2)) > 0 then 1 else 0 end) / 2 as share
 from (select *, lower(trim(name)) as n, string_split_regex(lower(trim(name)), '\\s+') as ws from {_PARTS}))"""
_TIER = f"""(select document_id, name, category_name, price, size, case when ex is not null then 3 when (lev > 0 and lev <= 3) or sim > 0.6 or share >= 0.6 then 2 else 1 end as tier,
 case when ex is not null then ex when lev > 0 and lev <= 3 then 'fuzzy' when sim > 0.6 then 'similarity' when share >= 0.6 then 'partial_words' else 'other' end as match_type,
 case when ex is not null then 1.0 when lev > 0 and lev <= 3 then 1 - lev / 9 when sim > 0.6 then sim when share >= 0.6 then share else 0.5 end as confidence from {_CLS})"""


@_query(f"select document_id, tier, match_type, round(confidence, 6) as confidence from {_TIER}")
def q_classify_match(spark, d):
    return ranking.classify(parts(spark, d), "Red Rings").select("document_id", "tier", "match_type", _r(F.col("confidence")).alias("confidence"))


@_query(f"select tier, match_type, count(*) as hits, round(avg(confidence), 6) as avg_confidence from {_TIER} group by 1, 2")
def q_tier_stats(spark, d):
    return ranking.tier_statistics(ranking.classify(parts(spark, d), "red rings")).withColumn("avg_confidence", _r(F.col("avg_confidence")))


@_query(f"select tier, count(*) filter (size % 2 = 0) as confirmed, count(*) filter (size % 2 = 1) as unconfirmed from {_TIER} group by 1")
def q_ranking_breakdown(spark, d):
    return ranking.ranking_breakdown(ranking.classify(parts(spark, d).withColumn("is_verified", F.col("size") % 2 == 0), "red rings"))


@_query(f"""select document_id, round(case tier when 3 then 10000 when 2 then 5000 else 1000 end + case when size % 2 = 0 then 2000 else 0 end + size + 10 * (size % 5) + 5 + case when size % 7 = 0 then 500 else 0 end
 + least(10, 2.5 * log10(greatest(1, price))), 6) as final_score from {_TIER}""")
def q_tiered_rank(spark, d):
    s = F.col("size")
    x = ranking.classify(parts(spark, d), "red rings")
    return x.select("document_id", _r(ranking.tiered_score(F.col("tier"), s % 2 == 0, s, s % 5, ranking.freshness(F.lit(None).cast("date"), F.lit("2001-08-01").cast("date")), s % 7 == 0, F.col("price"))).alias("final_score"))


@_query("select o_orderkey, case when days <= 30 then 10 when days <= 90 then 8 when days <= 180 then 6 when days <= 365 then 4 else 2 end as freshness from (select o_orderkey, date_diff('day', cast(o_orderdate as date), date '2001-08-01') as days from orders)")
def q_freshness_bucket(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", ranking.freshness(F.col("o_orderdate"), F.lit("2001-08-01").cast("date")).alias("freshness"))


@_query(f"""select document_id, case when name = 'red ring' then 10.0 when starts_with(name, 'red ring') then 5.0 when contains(name, 'red ring') then 3.0 when share = 1 then 2.5 when share >= 0.5 then 1 + share else 1.0 end as score
 from (select *, (case when len(list_filter(ws, lambda w: contains(w, 'red') or contains('red', w))) > 0 then 1 else 0 end + case when len(list_filter(ws, lambda w: contains(w, 'ring') or contains('ring', w))) > 0 then 1 else 0 end) / 2 as share
 from (select *, string_split(name, ' ') as ws from {_PARTS}))""")
def q_text_score_boost(spark, d):
    return parts(spark, d).select("document_id", ranking.text_score(F.col("name"), "red ring", F.lit(1.0)).alias("score"))


@_query(f"select document_id, round(0.4 * greatest(0, least(1, health / 100)) + 0.3 * least(1, rating / 5) + 0.1 * least(1, views / 1000) + case when is_verified then 0.2 else 0 end + case when is_featured then 0.15 else 0 end, 6) as popularity from {_BIZ}")
def q_popularity(spark, d):
    c = F.col
    return businesses(spark, d).select("document_id", _r(ranking.popularity(c("health"), c("rating"), c("views"), c("is_verified"), c("is_featured"))).alias("popularity"))


@_query(f"""select document_id, round(base + case when lower(name) = 'customer#00000001' then 2000 when starts_with(lower(name), 'customer#00000001') then 1000 when contains(lower(name), 'customer#00000001') then 500 else 0 end
 + case when is_featured then 10000 when is_verified then 5000 else 0 end, 6) as score from (select *, case when is_verified and ex then 400 * t + 400 * h + 100 * 0.5 + 60 * 0.1 when is_verified then 0.2 * t + 700 * h + 50 * 0.5 + 30 * 0.1
 when ex then 500 * t + 300 * h + 100 * 0.5 + 60 * 0.1 else 0.4 * t + 300 * h + 150 * 0.5 + 100 * 0.1 end as base from (select *, health / 100 as h, views / 250 as t, starts_with(lower(name), 'customer#00000001') or views / 250 >= 5 as ex from {_BIZ}))""")
def q_multi_signal_rank(spark, d):
    c = F.col
    s = ranking.multi_signal_score(F.lower(c("name")), "customer#00000001", c("views") / 250, c("health"), F.lit(0.5), F.lit(0.1), F.lit(0.0), c("is_verified"), c("is_featured"))
    return businesses(spark, d).select("document_id", _r(s).alias("score"))


@_query(f"select document_id, round(health + case when lower(name) = 'customer#000000010' then 2000 when starts_with(lower(name), 'customer#000000010') then 1000 when contains(lower(name), 'customer#000000010') then 500 else 0 end + case when is_verified then 5000 else 0 end + case when is_featured then 10000 else 0 end, 6) as score from {_BIZ}")
def q_quick_rank(spark, d):
    c = F.col
    return businesses(spark, d).select("document_id", _r(ranking.quick_score(F.lower(c("name")), "Customer#000000010", c("health"), c("is_verified"), c("is_featured"))).alias("score"))


@_query(f"select document_id, views / 250 as text, rating / 5::double as semantic, round(1 - (document_id % 100) / 100::double, 6) as location, round(greatest(0.1::double, 1 - (document_id % 400) / 365::double), 6) as freshness, round(0.4 * greatest(0, least(1, health / 100)) + 0.3 * least(1, rating / 5) + 0.1 * least(1, views / 1000) + case when is_verified then 0.2 else 0 end + case when is_featured then 0.15 else 0 end, 6)::double as popularity, round(health, 6) as health, cast(rating as double) as rating from {_BIZ}")
def q_feature_vector(spark, d):
    c, as_of = F.col, F.lit("2024-01-01").cast("date")
    near = geo.location_score((c("document_id") % 100) * 50.0, 5000.0)
    old = ranking.signal_freshness(F.date_sub(as_of, (c("document_id") % 400).cast("int")), as_of)
    v = ranking.feature_vector(text=c("views") / 250, semantic=c("rating") / 5, location=_r(near), freshness=_r(old), popularity=_r(ranking.popularity(c("health"), c("rating"), c("views"), c("is_verified"), c("is_featured"))), health=_r(c("health")), rating=c("rating"))
    return businesses(spark, d).select("document_id", v.alias("v")).select("document_id", "v.*")


@_query(f"select name as document_id, price as score, size from (select *, row_number() over (partition by name order by price desc, document_id) as n from {_PARTS}) where n = 1")
def q_dedup_hits(spark, d):
    x = parts(spark, d).select(F.col("name").alias("document_id"), F.col("price").alias("score"), "size", F.col("document_id").alias("k"))
    return ranking.deduplicate(x, order=[F.desc("score"), F.asc("k")]).drop("k")


_LISTS = {"price": "price desc", "size": "size desc", "category": "length(category_name) desc"}


@_query(
    "select document_id, round(sum(1.0 / (60 + r)), 10) as rrf from ("
    + " union all ".join(f"select document_id, row_number() over (order by {o}, document_id) as r from {_PARTS}" for o in _LISTS.values())
    + ") group by 1"
)
def q_rrf_three_lists(spark, d):
    p = parts(spark, d)
    lists = [p.select("document_id", c.alias("score")) for c in (F.col("price"), F.col("size"), F.length("category_name"))]
    return ranking.fuse(lists).withColumn("rrf", _r(F.col("rrf"), 10))


_COS = "list_dot_product(e.embedding::double[], q.embedding::double[]) / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])))"


@_query(f"""with k as (select document_id, row_number() over (order by price desc, document_id) as r from {_PARTS} where contains(name, 'ring')),
s as (select vec_id as document_id, row_number() over (order by round(sim, 9) desc, vec_id) as r from (select e.vec_id, {_COS} as sim from embeddings e, (select embedding from embeddings where vec_id = 0) q))
select document_id, round(0.6 / (60 + k.r) + coalesce(0.4 / (60 + s.r), 0), 10) as score from k left join s using (document_id)""")
def q_hybrid_rrf(spark, d):
    kw = parts(spark, d).where(F.col("name").contains("ring")).select("document_id", F.col("price").alias("score"))
    e = _t(spark, d, "embeddings")
    first = e.where("vec_id = 0").select(F.col("embedding").alias("q"))  # one row
    sem = e.crossJoin(F.broadcast(first)).select(F.col("vec_id").alias("document_id"), F.round(vector.cosine(F.col("embedding"), F.col("q")), 9).alias("score"))
    return vector.hybrid(kw, sem).withColumn("score", _r(F.col("score"), 10))


@_query(f"select vec_id, round(similarity, 6) as similarity from (select e.vec_id, {_COS} as similarity from embeddings e, (select embedding from embeddings where vec_id = 0) q) where similarity >= 0.2 order by similarity desc, vec_id limit 10")
def q_cosine_topk(spark, d):
    e = _t(spark, d, "embeddings")
    q = e.where("vec_id = 0").first()["embedding"]
    return vector.semantic_search(e, q, 0.2).select("vec_id", _r(F.col("similarity")).alias("similarity"))


@_query(f"select vec_id, round(similarity, 6) as similarity, round(100 * similarity, 4) as score from (select e.vec_id, {_COS} as similarity from embeddings e, (select embedding from embeddings where vec_id = 0) q) where similarity >= 0.7 order by similarity desc, vec_id limit 10")
def q_semantic_search(spark, d):
    """At the threshold of the live search."""
    e = _t(spark, d, "embeddings")
    x = vector.semantic_search(e, e.where("vec_id = 0").first()["embedding"])
    return x.select("vec_id", _r(F.col("similarity")).alias("similarity"), _r(F.col("score"), 4).alias("score"))


@_query(f"select vec_id, round(similarity, 6) as similarity from (select e.vec_id, {_COS} as similarity from embeddings e, (select embedding from embeddings where vec_id = 0) q) where similarity >= 0.2 order by similarity desc, vec_id limit 10")
def q_inverted_lists(spark, d):
    """All lists probed, which is exact; tests measure the recall of fewer."""
    e = _t(spark, d, "embeddings")
    lists = vector.inverted_lists(e, 20)
    return vector.probe(lists, e.where("vec_id = 0").first()["embedding"], 20, 0.2).select("vec_id", _r(F.col("similarity")).alias("similarity"))


@_query("select label, count(*) as vectors, avg(len(embedding)) as avg_dimensions from embeddings group by 1")
def q_embedding_stats(spark, d):
    return vector.embedding_stats(_t(spark, d, "embeddings"), "label")


# fuzzy

_NAMES = "(select name, count(*) as freq from " + _PARTS + " group by 1)"


def names(spark, d) -> DataFrame:
    return parts(spark, d).groupBy("name").agg(F.count("*").alias("freq"))


@_query(f"select name, round({_sim('name', chr(39) + 'smal blot' + chr(39))}, 6) as similarity from {_NAMES}")
def q_trigram_similarity(spark, d):
    return names(spark, d).select("name", _r(fuzzy.similarity(F.col("name"), F.lit("smal blot"))).alias("similarity"))


@_query(f"select name, round(s, 6) as similarity from (select name, {_sim('name', chr(39) + 'larg plate' + chr(39))} as s from {_NAMES}) where s > 0.3 order by s desc, name limit 5")
def q_similar_terms(spark, d):
    s = names(spark, d).select("name", fuzzy.similarity(F.col("name"), F.lit("larg plate")).alias("similarity"))
    return s.where("similarity > 0.3").orderBy(F.desc("similarity"), "name").limit(5).withColumn("similarity", _r(F.col("similarity")))


@_query(f"""with r as (select name, unnest(flatten(list_transform(range(1, len(ws) + 1), lambda i: list_transform(range(i, len(ws) + 1), lambda j: array_to_string(ws[i:j], ' '))))) as run from (select name, string_split_regex(lower(name), '[^a-z0-9]+') as ws from {_NAMES}))
select name, round(max({_sim('run', chr(39) + 'widgit' + chr(39))}), 6) as word_similarity from r group by 1""")
def q_word_similarity(spark, d):
    return names(spark, d).select("name", _r(fuzzy.word_similarity(F.lit("widgit"), F.col("name"))).alias("word_similarity"))


@_query(f"select name, round({_simple('name', chr(39) + 'hot gaer' + chr(39))}, 6) as similarity, len(list_intersect({_chars('name')}, {_chars(chr(39) + 'hot gaer' + chr(39))})) as common from {_NAMES}")
def q_char_similarity(spark, d):
    q = F.lit("hot gaer")
    return names(spark, d).select("name", _r(fuzzy.simple_similarity(F.col("name"), q)).alias("similarity"), fuzzy.common_characters(F.col("name"), q).cast("long").alias("common"))


@_query(f"select name, levenshtein(name, 'read ring') as distance from {_NAMES} where levenshtein(name, 'read ring') <= 4")
def q_levenshtein_terms(spark, d):
    return names(spark, d).select("name", F.levenshtein("name", F.lit("read ring")).cast("long").alias("distance")).where("distance <= 4")


@_query(f"select name, freq from {_NAMES} where {_soundex(chr(39) + 'boalt' + chr(39))} = {_soundex("string_split(name, ' ')[2]")}")
def q_soundex_match(spark, d):
    return names(spark, d).where(F.soundex(F.split_part("name", F.lit(" "), F.lit(2))) == F.soundex(F.lit("boalt"))).select("name", "freq")


_SOUNDS = "ph>f f>ph c>k k>c s>z z>s ck>k k>ck qu>kw x>ks y>i i>y ee>ea ea>ee ou>oo tion>shun gh>g kn>n wr>r ae>e oe>e".split()


def _phonetic(a: str, b: str) -> str:
    said = lambda r: f"replace(lower({a}), '{r.partition('>')[0]}', '{r.partition('>')[2]}')"
    return "(" + " or ".join(f"({said(r)} <> lower({a}) and ({said(r)} = {b} or contains({said(r)}, {b}) or contains({b}, {said(r)})))" for r in _SOUNDS) + ")"


_BLUE = "'blue'"


@_query(f"""select name, {_phonetic('name', "'kold bolt'")} as similar, case when name = 'blue' then 'exact' when starts_with(name, 'blue') then 'prefix' when {_sim(_BLUE, 'name')} >= 0.3 then 'similarity' when contains(name, 'blue') then 'substring'
 when {_soundex(_BLUE)} = {_soundex("replace(name, ' ', 'A')")} then 'soundex' when levenshtein(name, 'blue') <= 3 then 'fuzzy' end as match_type from {_NAMES}""")
def q_phonetic_match(spark, d):
    return names(spark, d).select("name", fuzzy.phonetically_similar(F.col("name"), F.lit("kold bolt")).alias("similar"), fuzzy.match_type(F.lit("blue"), F.col("name")).alias("match_type"))


_TERMS = f"""(select term, list_sort(list(distinct ft)) as field_types, count(*) as total_frequency from (select 'name' as ft, lower(trim(name)) as term from {_PARTS} union all select 'category_name', lower(trim(category_name)) from {_PARTS} union all select 'name', unnest(string_split_regex(lower(name), '[^a-z0-9]+')) from {_PARTS})
 where length(term) between 3 and 100 and regexp_full_match(term, '[a-z][a-z0-9 &''.-]*') and term not in ({", ".join(f"'{w}'" for w in sorted(K.VIEW_STOP_WORDS))}) group by 1 having count(*) >= 2)"""


def terms(spark, d) -> DataFrame:
    return suggest.search_terms(parts(spark, d), ["name", "category_name"], ["name"])


@_query(f"select term, field_types, total_frequency, list_sort({_grams('term')}) as trigrams from {_TERMS}")
def q_search_terms_view(spark, d):
    return terms(spark, d)


@_query(f"select count(*) as terms, round(avg(total_frequency), 6) as avg_frequency, max(total_frequency) as max_frequency, (select list(term order by total_frequency desc, term) from (select * from {_TERMS} order by total_frequency desc, term limit 10)) as top_terms from {_TERMS}")
def q_dictionary_stats(spark, d):
    return suggest.dictionary_stats(terms(spark, d)).withColumn("avg_frequency", _r(F.col("avg_frequency")))


@_query(f"select term, total_frequency from {_TERMS} where starts_with(term, 'sm') order by (term <> 'sm'), length(term), total_frequency desc, term limit 5")
def q_prefix_suggest(spark, d):
    return suggest.prefix_search(terms(spark, d), "sm").select("term", "total_frequency")


@_query(f"select term, total_frequency, round(s, 6) as similarity, l as distance from (select *, {_sim('term', chr(39) + 'widgt' + chr(39))} as s, levenshtein('widgt', term) as l from {_TERMS}) where s >= 0.3 or starts_with(term, 'widgt') or contains(term, 'widgt') or l <= 3 order by s desc, total_frequency desc, l, term limit 10")
def q_similarity_suggest(spark, d):
    x = suggest.similarity_search(terms(spark, d), "widgt")
    return x.select("term", "total_frequency", _r(F.col("similarity")).alias("similarity"), F.col("distance").cast("long").alias("distance"))


@_query(f"select name as text, min(case when starts_with(name, 're') then 1 else 2 end) as stage, count(*) as frequency from {_PARTS} where contains(name, 're') group by 1 order by 2, 1 limit 5")
def q_suggest_cascade(spark, d):
    return suggest.suggest(parts(spark, d), "re")


_ASK = "(values ('wigdet'), ('blt'), ('smal'), ('anvill'), ('gear'), ('plat')) q(query)"


def asked(spark) -> DataFrame:
    return spark.createDataFrame([(x,) for x in ("wigdet", "blt", "smal", "anvill", "gear", "plat")], "query string")


@_query(f"select query, term, total_frequency, l as distance, rank from (select query, term, total_frequency, levenshtein(query, term) as l, row_number() over (partition by query order by levenshtein(query, term), total_frequency desc, term) as rank from {_ASK}, {_TERMS} where levenshtein(query, term) <= 2) where rank <= 10")
def q_symspell_candidates(spark, d):
    x = suggest.symspell(asked(spark), suggest.symspell_index(terms(spark, d)))
    return x.select("query", "term", "total_frequency", F.col("distance").cast("long").alias("distance"), F.col("rank").cast("long").alias("rank"))


def _corr(q: str, t: str, f: str) -> str:
    return f"""round(case when {q} = {t} then 1000 when levenshtein({q}, {t}) <= 2 then 1000 + 100 * {_simple(q, t)} when starts_with({t}, {q}) then 500 when contains({t}, {q}) then 600 else 400 * {_simple(q, t)} end
 + 20 * ln(1 + {f}) + 100 * least(length({q}), length({t})) / greatest(length({q}), length({t})) + 150 * len(list_intersect({_chars(q)}, {_chars(t)})) / greatest(length({q}), length({t})))"""


@_query(f"select term, {_corr(chr(39) + 'smal' + chr(39), 'term', 'total_frequency')} as score from {_TERMS}")
def q_typo_relevance_score(spark, d):
    return terms(spark, d).select("term", fuzzy.correction_score(F.lit("smal"), F.col("term"), F.col("total_frequency")).alias("score"))


@_query(f"""with c as (select query, term, {_corr('query', 'term', 'total_frequency')} as score from {_ASK}, {_TERMS} where levenshtein(query, term) <= 2)
select query, term as corrected, score, round(least(0.95, score / 1000), 6) as confidence, n as n_suggestions from (select *, row_number() over (partition by query order by score desc, term) as r, count(*) over (partition by query) as n from c) where r = 1""")
def q_correct_query(spark, d):
    x = suggest.correct(asked(spark), suggest.symspell_index(terms(spark, d)))
    return x.withColumn("confidence", _r(F.col("confidence")))


@_query(f"select query as word, list(w order by l, w) as suggestions, round(least(0.9::double, 0.5 + 0.1::double * count(*)), 6) as confidence from (select query, w, levenshtein(query, w) as l from {_ASK}, (select distinct unnest(string_split(name, ' ')) as w from {_PARTS}) where levenshtein(query, w) between 1 and 2) group by 1")
def q_spell_check(spark, d):
    words = parts(spark, d).select(F.explode(F.split("name", " ")).alias("word")).distinct()
    return suggest.spell_check(asked(spark).withColumnRenamed("query", "word"), words).withColumn("confidence", _r(F.col("confidence")))


@_query(f"""select text, frequency, round(score, 4) as score from (select name as text, freq as frequency, greatest(0, 1000 * {_sim(chr(39) + 'red rin' + chr(39), 'name')} - 50 * levenshtein('red rin', name) + 100 * ln(1 + freq) + case when starts_with(name, 'red rin') then 300 else 0 end
 + case when abs(length(name) - 7) <= 2 and levenshtein('red rin', name) <= 2 and name <> 'red rin' then 200 else 0 end) as score from {_NAMES} where length(name) between 4 and 20 and ({_sim(chr(39) + 'red rin' + chr(39), 'name')} > 0.2 or levenshtein('red rin', name) <= 2 or starts_with(name, 'red rin'))) where score > 100 order by score desc, text limit 5""")
def q_direct_suggestions(spark, d):
    return suggest.direct_suggestions(parts(spark, d), "red rin").withColumn("score", _r(F.col("score"), 4))


@_query(f"select name, round(least(1.0, 1 - levenshtein(name, 'old bolt') / greatest(length(name), 8) + case when length(name) = 8 and levenshtein(name, 'old bolt') = 1 then 0.2 else 0 end), 6) as chars, round(0.4 * {_sim('name', chr(39) + 'old bolt' + chr(39))} + 0.4 * len(list_intersect(string_split(name, ' '), ['old', 'bolt'])) / len(list_distinct(list_concat(string_split(name, ' '), ['old', 'bolt']))) + 0.2 * greatest(0, 1 - levenshtein(name, 'old bolt') / 10), 6) as combined from {_NAMES}")
def q_combined_similarity(spark, d):
    q = F.lit("old bolt")
    return names(spark, d).select("name", _r(fuzzy.character_similarity(F.col("name"), q)).alias("chars"), _r(fuzzy.combined_score(q, F.col("name"))).alias("combined"))


# geo


def places(spark, d) -> DataFrame:
    """Suppliers at coordinates derived from their keys, around Lagos."""
    k = F.col("s_suppkey")
    return _t(spark, d, "supplier").select(k.alias("document_id"), F.col("s_name").alias("name"), (6.4 + (k % 40) / 100).alias("lat"), (3.2 + (k % 30) / 100).alias("lng"))


_PLACES = "(select s_suppkey as document_id, s_name as name, 6.4::double + (s_suppkey % 40) / 100 as lat, 3.2::double + (s_suppkey % 30) / 100 as lng from supplier)"


@_query(f"select document_id, round({_h('lat', 'lng', '6.5244', '3.3792')}, 3) as metres from {_PLACES}")
def q_haversine(spark, d):
    return places(spark, d).select("document_id", _r(geo.haversine(F.col("lat"), F.col("lng"), F.lit(6.5244), F.lit(3.3792)), 3).alias("metres"))


@_query(f"select document_id from {_PLACES} where {_h('lat', 'lng', '6.6018', '3.3515')} <= 10000")
def q_geo_radius(spark, d):
    return places(spark, d).where(geo.within(F.col("lat"), F.col("lng"), (6.6018, 3.3515), 10_000)).select("document_id")


@_query(f"select document_id, round(least(1, greatest(0, 1 - a / 10000) + case when b <= 10000 then 0.3 * (1 - b / 10000) else 0 end), 6) as score from (select document_id, {_h('lat', 'lng', '6.5244', '3.3792')} as a, {_h('lat', 'lng', '6.5', '3.35')} as b from {_PLACES})")
def q_geo_score(spark, d):
    at = geo.parse_location("restaurants in Lagos")
    dist = lambda x, y: geo.haversine(F.col("lat"), F.col("lng"), F.lit(x), F.lit(y))
    return places(spark, d).select("document_id", _r(geo.location_score(dist(at["lat"], at["lng"]), at["radius"], dist(6.5, 3.35))).alias("score"))


@_query("select place, kind from (values ('lagos', 'city'), ('ikeja', 'area'), ('lagos island', 'area'), ('nowhere', null)) t(place, kind)")
def q_gazetteer_lookup(spark, d):
    g = spark.createDataFrame([(k, v[2]) for k, v in K.GAZETTEER.items()], "place string, kind string")
    ask = spark.createDataFrame([("lagos",), ("ikeja",), ("lagos island",), ("nowhere",)], "place string")
    return ask.join(F.broadcast(g), "place", "left")  # the gazetteer is a constant


@_query("select q, name, radius from (values ('food in lagos island', 'lagos island', 5000.0), ('hotels within abuja', 'abuja', 10000.0), ('bank near yaba 2 km', 'yaba', 2000.0)) t(q, name, radius)")
def q_location_parse(spark, d):
    rows = [(q, at["name"], float(at["radius"])) for q in ("food in lagos island", "hotels within abuja", "bank near yaba 2 km") if (at := geo.parse_location(q))]
    return spark.createDataFrame(rows, "q string, name string, radius double").withColumn("radius", F.col("radius").cast("decimal(6,1)"))


# query understanding


@_query("""select conv_id, turn, case when regexp_matches(lower(text), 'order|buy|book|reserve|appointment|delivery') then 'transactional' when regexp_matches(lower(text), 'where|location|address|directions|near|close to') then 'navigational' else 'informational' end as intent from conversations""")
def q_intent(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", nlp.intent(F.col("text")).alias("intent"))


def _texts(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _plurals(words) -> list[str]:
    return sorted({f for w in words for f in [w, w + "s", w + "es", *([w[:-1]] if w.endswith("s") and len(w) > 3 else [])]})


_ASKS = r"(select conv_id, turn, lower(text) as low, string_split_regex(lower(trim(text)), '\s+') as ws, case when regexp_matches(lower(text), 'order|buy|book|reserve|appointment|delivery') then 'transactional' when regexp_matches(lower(text), 'where|location|address|directions|near|close to') then 'navigational' else 'informational' end as intent from conversations)"
_KINDS = "list_filter([" + ", ".join(f"case when list_has_any(ws, {_texts(_plurals([k, *v]))}) then {_texts([k])[1:-1]} end" for k, v in sorted(K.BUSINESS_TYPES.items())) + "], lambda x: x is not null)"
_SERVED = f"list_filter({_texts(K.SERVICES)}, lambda x: contains(low, x))"
_SYN = "map {" + ", ".join(f"{_texts([k])[1:-1]}: {_texts(v)}" for k, v in sorted(K.SYNONYMS.items())) + "}"


@_query(f"""with e as (select conv_id, turn, intent, ws, low, {_KINDS} as business_types, list_filter({_texts(sorted(K.GAZETTEER))}, lambda x: contains(low, x)) as locations, {_SERVED} as services, list_filter({_texts(K.MODIFIERS)}, lambda m: list_contains(ws, m)) as modifiers from {_ASKS}),
x as (select *, ws || coalesce(({_SYN}[business_types[1]])[1:2], []) || coalesce(({_SYN}[services[1]])[1:1], []) as more from e)
select conv_id, turn, intent, business_types, locations, services, modifiers, list_filter(more, lambda w, i: list_position(more, w) = i) as expansion from x""")
def q_entities(spark, d):
    c = _t(spark, d, "conversations")
    return c.select("conv_id", "turn", nlp.understand(F.col("text")).alias("u")).select("conv_id", "turn", "u.*")


@_query("select conv_id, turn, list_filter(['affordable', 'best', 'budget', 'busy', 'cheap', 'crowded', 'expensive', 'famous', 'fast', 'luxury', 'new', 'old', 'popular', 'quick', 'quiet', 'rated', 'recommended', 'slow', 'top'], lambda m: list_contains(string_split_regex(lower(trim(text)), '\\s+'), m)) as modifiers from conversations")
def q_modifiers(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", nlp.modifiers(F.col("text")).alias("modifiers"))


# schema


_JSON_KIND = """case when regexp_full_match(v, '-?[0-9]+') then 'integer' when regexp_full_match(v, '-?[0-9]*\\.[0-9]+([eE][-+]?[0-9]+)?') then 'float' when v in ('true', 'false') then 'boolean' when starts_with(v, '{') then 'object' when starts_with(v, '[') then 'array'
 when regexp_matches(k, '(?i)e?mail') and regexp_matches(v, '^[^ @]+@[^ @]+\\.[^ @]+$') then 'keyword' when regexp_matches(v, '^https?://') then 'keyword' when regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}|^[0-9]{13}$') then 'date' when length(v) <= 50 and not contains(v, ' ') then 'keyword' else 'text' end"""


@_query("select k as path, arg_max(kind, event_id) as kind from (select event_id, k, " + _JSON_KIND + " as kind from (select event_id, k, json_extract_string(props, '$.' || k) as v from (select event_id, props, unnest(json_keys(props)) as k from events)) where v is not null) group by 1")
def q_mapping_inference(spark, d):
    return schema.infer_mapping(_t(spark, d, "events"), "props", "event_id")


@_query("select c_custkey, case when c_acctbal < 0 then ['c_acctbal: min 0'] else [] end || case when c_mktsegment not in ('BUILDING', 'MACHINERY') then ['c_mktsegment: not allowed'] else [] end as errors from customer")
def q_schema_validate(spark, d):
    rules = {"c_custkey": {"required": True, "type": "number"}, "c_name": {"type": "string", "max": 40, "pattern": "^Customer#[0-9]+$"}, "c_acctbal": {"type": "number", "min": 0}, "c_mktsegment": {"enum": ["BUILDING", "MACHINERY"]}}
    return schema.validate(_t(spark, d, "customer"), rules).select("c_custkey", "errors")


@_query("select p_brand as name, max(p_size) as version from part group by 1")
def q_schema_latest(spark, d):
    v = _t(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_size").alias("version")).distinct()
    return schema.latest(v)


# aggregates, windows, store


@_query(f"select round(100.0 * count(is_verified) / count(*), 6) as is_verified_percent, round(100.0 * count(is_blocked) / count(*), 6) as is_blocked_percent from {_FLAGGED}")
def q_coverage_percent(spark, d):
    return monitor.coverage(flagged(spark, d), ["is_verified", "is_blocked"]).select(*[_r(F.col(c)).alias(c) for c in ("is_verified_percent", "is_blocked_percent")])


@_query("select c_mktsegment, c_custkey, c_name from (select *, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as n from customer) where n = 1")
def q_distinct_on(spark, d):
    return store.first_per(_t(spark, d, "customer"), ["c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")]).select("c_mktsegment", "c_custkey", "c_name")


@_query("select conv_id, string_agg(role, ' ' order by turn) as roles from conversations group by 1")
def q_string_agg(spark, d):
    return store.joined(_t(spark, d, "conversations"), ["conv_id"], "role", "turn").withColumnRenamed("role", "roles")


@_query("select event_type, count(*) as queries, round(avg(value), 6) as avg_took, round(100.0 * count(*) filter (value > 30) / count(*), 6) as slow_percent, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, max(value) as max_took from events group by 1")
def q_performance_report(spark, d):
    r = monitor.report(_t(spark, d, "events"), "event_type", "value", 30.0)
    return r.select("event_type", "queries", *[_r(F.col(c)).alias(c) for c in ("avg_took", "slow_percent", "p50", "p95")], "max_took")


@_query("select event_type, user_id, count(*) as queries, round(avg(value), 6) as avg_took, round(count(*) * avg(value), 4) as priority from events group by 1, 2 order by count(*) * avg(value) desc, event_type, user_id limit 50")
def q_cache_warm_order(spark, d):
    w = monitor.warm_order(_t(spark, d, "events"), ["event_type", "user_id"], "value")
    return w.select("event_type", "user_id", "queries", _r(F.col("avg_took")).alias("avg_took"), _r(F.col("priority"), 4).alias("priority"))


@_query("""select event_id, round(avg(value) over w5, 6) as moving_avg, round(avg(value) over w10, 6) as avg_10, max(value) over w10 as peak_10,
 case when avg(value) over o is null then 'stable' when avg(value) over n > avg(value) over o * 1.1 then 'increasing' when avg(value) over n < avg(value) over o * 0.9 then 'decreasing' else 'stable' end as trend from events
 window w5 as (partition by user_id order by ts, event_id rows between 4 preceding and current row), w10 as (partition by user_id order by ts, event_id rows between 9 preceding and current row),
 n as (partition by user_id order by ts, event_id rows between 2 preceding and current row), o as (partition by user_id order by ts, event_id rows between 5 preceding and 3 preceding)""")
def q_moving_windows(spark, d):
    m = monitor.moving(_t(spark, d, "events"), "value", ["ts", "event_id"], ["user_id"])
    return m.select("event_id", _r(F.col("moving_avg")).alias("moving_avg"), _r(F.col("avg_10")).alias("avg_10"), "peak_10", "trend")


@_query("select count(*) as recent from events where ts > timestamp '2024-01-02 00:00:00' - interval 3600 seconds and ts <= timestamp '2024-01-02 00:00:00'")
def q_recent_events(spark, d):
    return monitor.recent_count(_t(spark, d, "events"), "ts", F.lit("2024-01-02 00:00:00").cast("timestamp"), 3600)


@_query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def q_upsert_latest(spark, d):
    return store.latest(_t(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@_query("select o_orderkey, case when o_orderstatus = 'F' then 'closed' else o_orderpriority end as o_orderpriority from orders")
def q_upsert_merge(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_orderstatus")
    new = o.where("o_orderstatus = 'F'").withColumn("o_orderpriority", F.lit("closed"))
    return store.upsert(o, new, ["o_orderkey"], ["o_orderdate"]).select("o_orderkey", "o_orderpriority")


@_query(f"select document_id from {_PARTS} where not (price < 950 and name ilike '%ring%')")
def q_delete_by_query(spark, d):
    q = {"bool": {"must": [{"range": {"price": {"lt": 950}}}, {"term": {"name": "ring"}}]}}
    return search.delete_by_query(parts(spark, d), q).select("document_id")


@_query("select doc_id from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def q_delete_by_ids(spark, d):
    bad = _t(spark, d, "labels").where("toxic = 1")
    return store.delete(_t(spark, d, "documents"), bad, ["doc_id"]).select("doc_id")


@_query("select source as index_name, 50 as document_count, count(*) as counted, count(*) = 50 as consistent from documents group by 1")
def q_recount(spark, d):
    docs = _t(spark, d, "documents").withColumnRenamed("source", "index_name")
    catalog = docs.select("index_name").distinct().withColumn("document_count", F.lit(50))
    return I.recount(docs, catalog)


@_query(f"select document_id, name from {_PARTS} where brand = 'Brand#4' order by document_id limit 20 offset 5")
def q_list_documents(spark, d):
    return store.list_documents(parts(spark, d), 20, 5, {"brand": "Brand#4"})[0].select("document_id", "name")


@_query(f"select document_id, name from {_PARTS} where document_id in (3, 5, 8, 999999999)")
def q_point_lookup(spark, d):
    return store.lookup(parts(spark, d), [3, 5, 8, 999_999_999]).select("document_id", "name")


@_query("select c_custkey, c_acctbal < 0 as rejected from customer")
def q_bulk_store_errors(spark, d):
    c = _t(spark, d, "customer")
    good, bad = store.split_valid(c, schema.errors({"c_acctbal": {"min": 0}}, dict(c.dtypes)))
    return good.select("c_custkey", F.lit(False).alias("rejected")).unionByName(bad.select("c_custkey", F.lit(True).alias("rejected")))


@_query("select document_id, name, ts from (select user_id as document_id, event_type as name, ts, row_number() over (partition by user_id order by ts desc, event_type desc) as n from events) where n = 1")
def q_stream_index_batches(spark, d):
    """Events as a stream of files, indexed by micro-batch into the shared folder; the last write of each user."""
    from querna.streaming import ingest

    at = shared_folder(spark, "stream")
    e = _t(spark, d, "events").select(F.col("user_id").alias("document_id"), "ts", F.col("event_type").alias("name"))
    e.repartition(4).write.parquet(f"{at}/in")
    ingest.index_batches(ingest.read(spark, f"{at}/in", e.schema, 2), f"{at}/out", f"{at}/checkpoint", ["name"]).awaitTermination()
    return ingest.current(spark, f"{at}/out").select("document_id", "name", "ts")


# more full-text forms


_BOTH = f"list_concat({_std('name')}, {_std('category_name')})"


@_query(f"select document_id from {_PARTS} where list_has_all({_BOTH}, ['promo', 'ring'])")
def q_fulltext_all(spark, d):
    return parts(spark, d).where(textsearch.all_terms(["name", "category_name"], "promo ring")).select("document_id")


@_query(f"select document_id from {_PARTS} where list_has_any({_BOTH}, ['promo', 'anvil'])")
def q_fulltext_all_or_any(spark, d):
    return parts(spark, d).where(textsearch.all_or_any(["name", "category_name"], "promo anvil")).select("document_id")


@_query(f"select document_id from {_PARTS} where len(list_filter({_BOTH}, lambda x: starts_with(x, 'wid'))) > 0")
def q_fulltext_prefix(spark, d):
    return parts(spark, d).where(textsearch.prefix_term(["name", "category_name"], "wid")).select("document_id")


@_query(f"select document_id, case when lower(name) = 'red ring' then 1000.0::double when starts_with(lower(name), 'red ring') then 500.0::double else 100.0::double end as score from {_PARTS} where starts_with(lower(name), 'red ring') or list_has_all({_BOTH}, ['red', 'ring'])")
def q_prefix_or_fulltext(spark, d):
    return textsearch.prefix_or_text(parts(spark, d), "red ring", F.col("name"), ["name", "category_name"]).select("document_id", "score")


_SPOTS = f"""(select document_id, x as t, pos, case when pos < n then 1.0::double else 0.4::double end as w, row_number() over (partition by document_id order by pos) as k from
 (select document_id, unnest(ts) as x, generate_subscripts(ts, 1) - 1 as pos, n from (select document_id, {_BOTH} as ts, len({_std('name')}) as n from {_PARTS})) where x in ('small', 'plated'))"""


@_query(f"""with e as (select *, sum(1 / w) over (partition by document_id order by k) as cum from {_SPOTS}),
l as (select *, max(case when t = 'small' then k end) over s as a, max(case when t = 'plated' then k end) over s as b from e window s as (partition by document_id order by k rows unbounded preceding)),
c as (select document_id, least(a, b) as low, min(k) as high from l where a is not null and b is not null group by 1, 2),
r as (select document_id, sum((high - low + 1) / (y.cum - x.cum + 1 / x.w) / (1 + (y.pos - x.pos) - (high - low))) as score from c join e x using (document_id) join e y using (document_id) where x.k = low and y.k = high group by 1)
select document_id, round(case when lower(name) = 'small plated' then 1000 when starts_with(lower(name), 'small plated') then 500 else score end, 6)::double as score from {_PARTS} left join r using (document_id) where score is not null or starts_with(lower(name), 'small plated')""")
def q_search_boosted(spark, d):
    return textsearch.boosted(parts(spark, d), "small plated", F.col("name"), ["name", "category_name"]).select("document_id", _r(F.col("score")).alias("score"))


@_query(f"select document_id, round(sum(w), 6)::double as score from (select document_id, case when i <= n then 1.0::double else 0.4::double end as w from (select document_id, unnest(ts) as x, generate_subscripts(ts, 1) as i, n from (select document_id, {_BOTH} as ts, len({_std('name')}) as n from {_PARTS})) where starts_with(x, 'pl')) group by 1")
def q_prefix_ranked(spark, d):
    hit = parts(spark, d).where(textsearch.prefix_term(["name", "category_name"], "pl"))
    return hit.select("document_id", _r(textsearch.prefix_rank(["name", "category_name"], "pl")).alias("score"))


@_query(f"select document_id, round(0.1::double * count(*), 6) as score from (select doc_id as document_id, unnest({_std('text')}) as x from documents) where x in ('thea', 'oner') group by 1")
def q_search_any_ranked(spark, d):
    hit, _ = textsearch.ranked_any(_t(spark, d, "documents").withColumnRenamed("doc_id", "document_id"), "thea oner", ["text"])
    return hit.select("document_id", _r(F.col("score")).alias("score"))


@_query(f"select document_id, 0.5 as score from {_PARTS} where contains(lower(name), 'bolt') or contains(lower(category_name), 'bolt') order by lower(name) = 'bolt' desc, starts_with(lower(name), 'bolt') desc, document_id limit 10")
def q_constant_fallback(spark, d):
    return textsearch.constant_fallback(parts(spark, d), "bolt", F.col("name"), F.col("category_name")).select("document_id", F.col("score").cast("decimal(2,1)").alias("score"))


@_query(f"select document_id, text as content from {_FLAGGED} where is_active and is_verified and not is_blocked")
def q_active_documents(spark, d):
    return textsearch.valid_results(textsearch.active_documents(flagged(spark, d)).select("document_id", F.col("text").alias("content")), "content")


@_query("select event_id, cast(json_extract(props, '$.k') as bigint) as k, event_type || ':' || json_extract_string(props, '$.k') as label from events")
def q_json_projection(spark, d):
    x = projection.json_columns(_t(spark, d, "events"), "props", {"k": ("k", "bigint"), "text": ("k", "string")})
    return x.select("event_id", "k", F.concat_ws(":", "event_type", "text").alias("label"))


@_query("select event_id, case when ts > timestamp '2024-01-20 00:00:00' - interval 24 hours then case when value > 30 then 'slow today' else 'today' end when value > 30 then 'slow' else 'old' end as state from events")
def q_admin_case(spark, d):
    new = projection.within_hours(F.col("ts"), F.lit("2024-01-20 00:00:00").cast("timestamp"), 24)
    return _t(spark, d, "events").select("event_id", F.when(new, F.when(F.col("value") > 30, "slow today").otherwise("today")).when(F.col("value") > 30, "slow").otherwise("old").alias("state"))


@_query("select conv_id, turn, w as word from (select conv_id, turn, unnest(case when role = 'user' then string_split(text, ' ') else [null] end) as w from conversations)")
def q_lateral_outer(spark, d):
    c = _t(spark, d, "conversations")
    return c.select("conv_id", "turn", F.explode_outer(F.when(F.col("role") == "user", F.split("text", " "))).alias("word"))


@_query(f"select document_id, field, term, cast(2 * tf as bigint) as tf from {_POST}")
def q_postings_merge(spark, d):
    p = I.postings(parts(spark, d), ["name", "category_name"])
    return I.merge_postings(p, p).select("document_id", "field", "term", "tf")


@_query(f"select document_id, field, term, tf from {_POST} where document_id not in (select p_partkey from part where p_size < 25)")
def q_postings_remove(spark, d):
    p = I.postings(parts(spark, d), ["name", "category_name"])
    return I.remove_documents(p, parts(spark, d).where("size < 25")).select("document_id", "field", "term", "tf")


@_query(f"select field, term, count(*) as df from {_POST} group by 1, 2")
def q_term_df_by_field(spark, d):
    return I.term_stats(I.postings(parts(spark, d), ["name", "category_name"]), per_field=True)


@_query(r"select doc_id, len(list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda x: x <> '')) as words from documents")
def q_field_word_count(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.size(analysis.whitespace_tokens(F.col("text"))).cast("long").alias("words"))


@_query("select p_partkey, cast(p_retailprice as varchar) as price_text, trim(p_name) || ' ' || p_type as content from part")
def q_field_text(spark, d):
    p = _t(spark, d, "part")
    return p.select("p_partkey", analysis.field_text(F.col("p_retailprice"), "double").alias("price_text"), analysis.field_text(F.array("p_name", "p_type"), "array<string>").alias("content"))


@_query("select c_custkey, case when c_acctbal < 0 then ['c_acctbal: min 0'] else [] end || case when c_custkey % 5 = 0 then ['note: required'] else [] end as errors from customer")
def q_document_validation(spark, d):
    c = _t(spark, d, "customer").withColumn("note", F.when(F.col("c_custkey") % 5 != 0, "x"))
    return schema.validate(c, {"c_acctbal": {"min": 0}, "note": {"required": True}}).select("c_custkey", "errors")


@_query(f"select term, case when term = 'bolt' then 'exact' when starts_with(term, 'bolt') then 'prefix' when {_sim(chr(39) + 'bolt' + chr(39), 'term')} >= 0.3 then 'similarity' when contains(term, 'bolt') then 'substring' end as kind from {_TERMS} where contains(term, 'bolt') or {_sim(chr(39) + 'bolt' + chr(39), 'term')} >= 0.3")
def q_match_type(spark, d):
    t = terms(spark, d).where(F.col("term").contains("bolt") | (fuzzy.similarity(F.lit("bolt"), F.col("term")) >= 0.3))
    return t.select("term", fuzzy.match_type(F.lit("bolt"), F.col("term")).alias("kind"))


def _like_word(q: str, w: str) -> str:
    sim = f"(1 - levenshtein({q}, {w}) / greatest(length({q}), length({w})) + case when length({q}) = length({w}) and levenshtein({q}, {w}) = 1 then 0.2 else 0 end)"
    return f"case when {sim} >= 0.7 then 1000 when {sim} >= 0.5 then 800 when {sim} >= 0.3 then 600 when {sim} >= 0.1 then 400 else 0 end + case when {_soundex(q)} = {_soundex(w)} then 500 else 0 end"


_BOLD = "'bold'"


@_query(f"""select term, case when term = 'bold' then 500 when starts_with(term, 'bold') then 400 when contains(term, 'bold') then 350 when levenshtein(term, 'bold') <= 1 then 300 when levenshtein(term, 'bold') <= 2 then 250 else 150 end
 + case when {_phonetic(_BOLD, 'term')} then 200 else 0 end - 25 * levenshtein(term, 'bold') - 5 * abs(length(term) - 4) as score, list_max(list_transform(string_split_regex(term, '\\s+'), lambda w: {_like_word(_BOLD, 'w')})) as best_word from {_TERMS}""")
def q_relevance_first(spark, d):
    t = F.col("term")
    return terms(spark, d).select("term", fuzzy.relevance_first_score(F.lit("bold"), t).alias("score"), fuzzy.best_word_score(F.lit("bold"), t).alias("best_word"))


@_query(f"select count(*) as keys, count(distinct term) as terms from (select distinct term, k from (select term, unnest(list_concat([term], list_transform(range(1, length(term) + 1), lambda i: term[1:i - 1] || term[i + 1:]))) as k from {_TERMS} where length(term) > 1))")
def q_symspell_stats(spark, d):
    return suggest.symspell_index(terms(spark, d), 1).agg(F.count("*").alias("keys"), F.count_distinct("term").alias("terms"))


@_query(f"select name, freq from (select name, freq, row_number() over (partition by lower(name) order by freq desc, name) as n from {_NAMES}) where n = 1 and name not in ('red ring') and not contains(name, '@')")
def q_valid_terms(spark, d):
    t = suggest.first_wins(names(spark, d).withColumnRenamed("name", "term"), [F.desc("freq"), F.asc("term")])
    return t.where(fuzzy.is_valid_term(F.col("term")) & (F.col("term") != "red ring")).withColumnRenamed("term", "name")


@_query(f"select document_id, round(1 - m / 5000, 6) as location_score from (select document_id, {_h('lat', 'lng', '6.5083', '3.3833')} as m from {_PLACES}) where m <= 5000")
def q_geo_filter(spark, d):
    x = geo.filter_by_location(places(spark, d), geo.parse_location("cafes in yaba"))
    return x.select("document_id", _r(F.col("location_score")).alias("location_score"))


@_query(f"select document_id, case when document_id % 3 = 0 then lat when document_id % 3 = 1 then lat + 1 end as lat, case when document_id % 3 = 0 then lng when document_id % 3 = 1 then lng + 1 end as lng from {_PLACES}")
def q_location_extract(spark, d):
    p, k = places(spark, d), F.col("document_id") % 3
    x = p.select("document_id", F.when(k == 0, F.col("lat").cast("string")).otherwise("0").alias("a"), F.when(k == 0, F.col("lng").cast("string")).alias("b"), F.when(k == 1, F.array(F.col("lng") + 1, F.col("lat") + 1)).alias("pair"))
    at = geo.extract_location(F.col("a"), F.col("b"), F.col("pair"))
    return x.select("document_id", at["lat"].alias("lat"), at["lng"].alias("lng"))


@_query("select q, kind from (values ('best hotels', 'business_type'), ('shops here', 'location_based'), ('where can i find a quiet place to read books today', 'semantic'), ('bolt', 'default')) t(q, kind)")
def q_query_type(spark, d):
    x = spark.createDataFrame([("best hotels", False), ("shops here", True), ("where can i find a quiet place to read books today", False), ("bolt", False)], "q string, at boolean")
    return x.select("q", nlp.query_type(F.col("q"), F.col("at")).alias("kind"))


@_query("select count(*) as rows, count(distinct index_name) as indices, true as consistent from (select unnest(range(500)), 'businesses' as index_name)")
def q_synthetic_catalog(spark, d):
    docs = synthetic.businesses(spark, 500)
    c = catalog.reconcile(catalog.create(catalog.empty(spark), "businesses"), docs)
    return docs.agg(F.count("*").alias("rows"), F.count_distinct("index_name").alias("indices")).crossJoin(c.select((F.col("document_count") == 500).alias("consistent")))


@_query("select date_trunc('minute', ts) as minute, event_type, count(*) as events from events group by 1, 2")
def q_event_rates(spark, d):
    from querna.streaming import ingest

    return ingest.event_rates(_t(spark, d, "events")).select(F.col("window.start").alias("minute"), "event_type", "events")


@_query("select round(avg(value), 6) as average from (select value from events order by ts desc, event_id desc limit 100)")
def q_last_jobs_average(spark, d):
    return monitor.last_average(_t(spark, d, "events"), "value", [F.desc("ts"), F.desc("event_id")]).select(_r(F.col("average")).alias("average"))


@_query(f"select document_id, name, price from (select *, row_number() over (partition by document_id order by price desc) as n from (select * from {_PARTS} where list_contains({_std('name')}, 'bolt') union all select * from {_PARTS} where list_contains({_std('name')}, 'red'))) where n = 1 order by price desc, document_id limit 20")
def q_merge_suggestions(spark, d):
    found = [search.matches(parts(spark, d), search.Request({"term": {"name": w}})).withColumn("score", F.col("price")) for w in ("bolt", "red")]
    return search.merge_suggestions(found, 20).select("document_id", "name", "price")


@_query(f"select document_id, lower(coalesce(nullif(case when size % 4 = 0 then null else name end, ''), category_name, '')) as label from {_PARTS}")
def q_alternative_field(spark, d):
    name = F.when(F.col("size") % 4 != 0, F.col("name"))
    return parts(spark, d).select("document_id", projection.alternative(name, F.col("category_name")).alias("label"))


@_query(f"select document_id, name, lower(name) as name_lower, lower(category_name) as category_lower, price > 950 as is_active from {_PARTS}")
def q_materialized_columns(spark, d):
    return projection.materialised(parts(spark, d), flags={"is_active": F.col("price") > 950}).select("document_id", "name", "name_lower", "category_lower", "is_active")


@_query(f"select term, source, total_frequency from (select term, 'exact' as source, total_frequency, 1.0 as s from {_TERMS} where term = 'ring' union all select term, 'similar', total_frequency, {_sim(chr(39) + 'ring' + chr(39), 'term')} from {_TERMS} where term <> 'ring' and {_sim(chr(39) + 'ring' + chr(39), 'term')} > 0.3)")
def q_exact_or_similar(spark, d):
    return suggest.exact_or_similar(terms(spark, d), "ring").select("term", "source", "total_frequency")


@_query(f"select ft as field_type, count(*) as terms, cast(sum(total_frequency) as bigint) as frequency, max(length(term)) as longest from (select unnest(field_types) as ft, term, total_frequency from {_TERMS}) group by 1")
def q_dictionary_by_field(spark, d):
    t = terms(spark, d).select(F.explode("field_types").alias("field_type"), "term", "total_frequency")
    return t.groupBy("field_type").agg(F.count("*").alias("terms"), F.sum("total_frequency").alias("frequency"), F.max(F.length("term")).cast("long").alias("longest"))


@_query(_bm25_sql(_PARTS, ["red", "anvil"], {"name": 9.0, "category_name": 1.0}))
def q_bm25_weight_power(spark, d):
    return I.bm25_search(parts(spark, d), ["red", "anvil"], ["name", "category_name"], weight_power=2).withColumn("score", _r(F.col("score")))


@_query("select o_orderkey, round(greatest(0.1::double, 1 - date_diff('day', cast(o_orderdate as date), date '2001-08-01') / 365), 6) as freshness from orders")
def q_signal_freshness(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", _r(ranking.signal_freshness(F.col("o_orderdate"), F.lit("2001-08-01").cast("date"))).alias("freshness"))


@_query(f"select doc_id as document_id, count(distinct t) as distinct_terms, count(*) as terms, max(n) as max_tf from (select doc_id, t, count(*) over (partition by doc_id, t) as n from (select doc_id, unnest({_tok('text')}) as t from documents)) group by 1")
def q_processed_documents(spark, d):
    p = I.postings(_t(spark, d, "documents").withColumnRenamed("doc_id", "document_id"), ["text"])
    return p.groupBy("document_id").agg(F.count("*").alias("distinct_terms"), F.sum("tf").alias("terms"), F.max("tf").alias("max_tf"))


@_query(f"select document_id, score, name from (select document_id, name, case when contains(name, 'gear') then 2.0::double else 1.0::double end as score from {_PARTS} where list_has_any({_std('name')}, ['gear', 'hot'])) order by score desc, document_id limit 15")
def q_two_phase_topk(spark, d):
    hit = parts(spark, d).where(textsearch.any_terms(["name"], "hot gear")).withColumn("score", F.when(F.col("name").contains("gear"), 2.0).otherwise(1.0))
    return hit.orderBy(F.desc("score"), "document_id").limit(15).select("document_id", "score", "name")


from querna import catalogue_stored  # noqa: E402, F401  (its queries register themselves)
