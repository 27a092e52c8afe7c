"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import batched
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.text import tokens
from ..operators import hnsw, knn, lexical
from ..operators.filters import And, ColumnLayout, Contains, Eq, Exists, Gt, Gte, In, Lt, Lte, MapLayout, Ne, Not, Or, compile_filter, condition
from ..operators.fusion import by_rank, fuse_rrf, hybrid
from ..session import work_dir
from ..sources import payloads
from ..sources.collection import Collection
from ..sources.database import Database
from ..streaming.ingest import bulk_upsert_stream
from ..types import CollectionMeta, HnswConfig, HybridQuery, Metric, SearchQuery

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TEXT = "clown Stupid missingword worthless, clown"
QUERY_IDS = (0, 10, 20, 30, 40)


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# -- the tables


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    """id, vector, document, has_payload and the payload fields as columns."""
    e = _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    t = _table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source", "n_chars")
    q = _table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    p = e.join(t, "id", "left").join(q, "id", "left")
    return p.select(
        "id", "vector", F.col("text").alias("document"), (F.col("id") % 10 != 9).alias("has_payload"), F.col("label").cast("long").alias("p_label"),
        F.col("lang").alias("p_lang"), F.col("source").alias("p_source"), F.col("n_chars").alias("p_n_chars"), (F.col("n_chars") / F.lit(1000.0)).alias("p_kchars"),
        (F.col("toxic") == 1).alias("p_toxic"), F.col("quality").cast("long").alias("p_quality"), F.when(F.col("lang").isNotNull(), F.array("lang", "source")).alias("p_tags"),
    )


def bare(spark: SparkSession, d: str) -> DataFrame:
    """id and vector, where nothing else of a point is asked for."""
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


FIELDS = {
    "label": "int", "lang": "text", "source": "text", "n_chars": "int", "kchars": "float", "toxic": "bool", "quality": "int", "tags": "[text]",
}


def with_payload(p: DataFrame) -> DataFrame:
    """The same points with the payload as a map."""
    fields = {k: (F.col(f"p_{k}"), t) for k, t in FIELDS.items()}
    return p.select("id", "vector", "document", payloads.from_columns(fields, F.col("has_payload")).alias("payload"))


def columns() -> ColumnLayout:
    return ColumnLayout({k: (F.col(f"p_{k}"), t) for k, t in FIELDS.items()}, F.col("has_payload"))


def vectors(spark: SparkSession, d: str, ids: Sequence[int] = (0,)) -> list[tuple[int, list[float]]]:
    rows = _table(spark, d, "embeddings").where(F.col("vec_id").isin(list(ids))).select("vec_id", "embedding").collect()
    return sorted((r.vec_id, r.embedding) for r in rows)


P = """p as (select e.vec_id as id, e.embedding as vector, d.text as document, (e.vec_id % 10 <> 9) as has_payload, cast(e.label as bigint) as p_label,
  d.lang as p_lang, d.source as p_source, d.n_chars as p_n_chars, d.n_chars / cast(1000 as double) as p_kchars, (l.toxic = 1) as p_toxic,
  cast(l.quality as bigint) as p_quality, case when d.doc_id is not null then [d.lang, d.source] end as p_tags
  from embeddings e left join documents d on d.doc_id = e.vec_id left join labels l on l.doc_id = e.vec_id)"""
_DOT = "list_reduce(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]), lambda x, y: x + y)"
_NORM = "cast(sqrt(list_reduce(list_transform({a}, lambda z: z * z), lambda x, y: x + y)) as float)"
_Q = "(select embedding from embeddings where vec_id = 0)"


def score_sql(metric: str, a: str = "vector", b: str = "q") -> str:
    if metric == "dot":
        return _DOT.format(a=a, b=b)
    if metric == "euclidean":
        return f"-cast(sqrt(list_reduce(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda x, y: x + y)) as float)"
    na, nb = _NORM.format(a=a), _NORM.format(a=b)
    return f"case when {na} = 0 or {nb} = 0 then cast(0 as float) else cast({_DOT.format(a=a, b=b)} / ({na} * {nb}) as float) end"


def top_sql(metric: str, where: str = "true", k: int = 10, source: str = "p") -> str:
    """(id, s) of the k best."""
    return f"select id, {score_sql(metric)} as s from (select *, {_Q} as q from {source}) where {where} order by s desc, id limit {k}"


def ranked_sql(inner: str, score: str = "cast(s as double)") -> str:
    return f"select cast(row_number() over (order by s desc, id) as int) as rank, id, {score} as score from ({inner})"


def shown(hits: DataFrame, digits: int | None = None) -> DataFrame:
    s = F.col("score").cast("double")
    return by_rank(hits).select("rank", "id", (s if digits is None else F.round(s, digits)).alias("score"))


# -- exact neighbours


def _knn(metric: Metric, k: int = 10) -> Query:
    return lambda spark, d: shown(knn.top_k(bare(spark, d), vectors(spark, d)[0][1], k, metric))


for _m in Metric:
    register(f"knn_{_m.value}", f"with {P} {ranked_sql(top_sql(_m.value))}")(_knn(_m))
register("knn_k_zero", f"with {P} {ranked_sql(top_sql('cosine', k=0))}")(_knn(Metric.COSINE, 0))
register("knn_k_gt_n", f"with {P} {ranked_sql(top_sql('cosine', k=1_000_000_000))}")(_knn(Metric.COSINE, 1_000_000_000))


@register("knn_metric_override", f"with {P} {ranked_sql(top_sql('euclidean', k=7))}")
def knn_metric_override(spark: SparkSession, d: str) -> DataFrame:
    c = _collection(spark, bare(spark, d))
    return shown(c.search(SearchQuery(vectors(spark, d)[0][1], 7, Metric.EUCLIDEAN)))


_ZERO = "z as (select id, case when id % 7 = 3 then list_transform(vector, lambda x: cast(0 as float)) else vector end as vector from p)"


@register("knn_zero_norm", f"with {P}, {_ZERO} {ranked_sql(top_sql('cosine', source='z', k=1_000_000_000))}")
def knn_zero_norm(spark: SparkSession, d: str) -> DataFrame:
    p = bare(spark, d).select("id", F.when(F.col("id") % 7 == 3, F.transform("vector", lambda x: x * F.lit(0).cast("float"))).otherwise(F.col("vector")).alias("vector"))
    return shown(knn.top_k(p, vectors(spark, d)[0][1], 1_000_000_000))


_QUERIES = f"s as (select q.vec_id as query_id, id, {score_sql('cosine', 'vector', 'q.embedding')} as s from p, embeddings q where q.vec_id in {QUERY_IDS})"
_BATCH = """select query_id, rank, id, cast(s as double) as score from
  (select *, cast(row_number() over (partition by query_id order by s desc, id) as int) as rank from s) where rank <= 5"""


@register("knn_batch_queries", f"with {P}, {_QUERIES} {_BATCH}")
def knn_batch_queries(spark: SparkSession, d: str) -> DataFrame:
    found = knn.batch_top_k(bare(spark, d), vectors(spark, d, QUERY_IDS), 5)
    return found.select(F.col("query_id").cast("long").alias("query_id"), "rank", "id", F.col("score").cast("double").alias("score"))


# -- payload filters

NAN = float("nan")
#: name -> (filter, SQL that is never null)
FILTERS: dict[str, tuple[Any, str]] = {
    "filter_eq": (Eq("lang", "en"), "coalesce(p_lang = 'en', false)"),
    "filter_ne": (Ne("lang", "en"), "coalesce(p_lang <> 'en', false)"),
    "filter_lt": (Lt("n_chars", 1000), "coalesce(p_n_chars < 1000, false)"),
    "filter_lte": (Lte("label", 3), "coalesce(p_label <= 3, false)"),
    "filter_gt": (Gt("kchars", 1.5), "coalesce(p_kchars > 1.5, false)"),
    "filter_gte": (Gte("source", "src5"), "coalesce(p_source >= 'src5', false)"),
    "filter_in": (In("label", (1, 4, 9, "x")), "coalesce(p_label in (1, 4, 9), false)"),
    "filter_in_empty": (In("label", ()), "false"),
    "filter_contains": (Contains("tags", "fr"), "coalesce(list_contains(p_tags, 'fr'), false)"),
    "filter_contains_scalar": (Contains("lang", "fr"), "false"),
    "filter_exists": (Exists("quality"), "p_quality is not null"),
    "filter_not_exists": (Not(Exists("quality")), "p_quality is null"),
    "filter_and_or_not": (
        And((Or((Eq("lang", "de"), Eq("lang", "fr"))), Not(Gt("n_chars", 3000)), Not(Eq("toxic", True)))),
        "coalesce(p_lang in ('de', 'fr'), false) and not coalesce(p_n_chars > 3000, false) and not coalesce(p_toxic, false)",
    ),
    "filter_empty_and": (And(()), "true"),
    "filter_empty_or": (Or(()), "false"),
    "filter_type_mismatch": (Not(Eq("lang", 3)), "true"),
    "filter_int_float_eq": (Or((Eq("label", 3.0), Eq("label", 4))), "coalesce(p_label = 4, false)"),
    "filter_int_float_order": (And((Gte("label", 2.5), Lt("kchars", 2))), "coalesce(p_label >= 2.5, false) and coalesce(p_kchars < 2, false)"),
    "filter_nan": (And((Ne("kchars", NAN), Not(Eq("kchars", NAN)), Not(Lt("kchars", NAN)), Not(Gt("label", NAN)))), "p_kchars is not null"),
    "filter_bool_order": (Or((Lt("toxic", True), Gte("toxic", False))), "false"),
    "filter_null_payload": (Not(Eq("lang", "zz")), "true"),
}


def _filter(node: Any) -> Query:
    return lambda spark, d: with_payload(points(spark, d)).where(compile_filter(node, MapLayout(F.col("payload")))).select("id")


for _n, (_f, _s) in FILTERS.items():
    register(_n, f"with {P} select id from p where has_payload and ({_s})")(_filter(_f))

_HIT = And((Eq("lang", "en"), Lt("n_chars", 2500), Not(Eq("toxic", True))))
_HIT_SQL = "has_payload and coalesce(p_lang = 'en', false) and coalesce(p_n_chars < 2500, false) and not coalesce(p_toxic, false)"


@register("knn_filtered", f"with {P} {ranked_sql(top_sql('cosine', _HIT_SQL))}")
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Over payload columns: the predicate reaches the scans."""
    return shown(knn.top_k(points(spark, d), vectors(spark, d)[0][1], 10, Metric.COSINE, condition(_HIT, columns())))


@register("knn_filtered_hydrated", f"with {P} select h.rank, h.id, h.score, p.p_lang as lang, p.p_n_chars as n_chars from ({ranked_sql(top_sql('dot', _HIT_SQL))}) h join p on p.id = h.id")
def knn_filtered_hydrated(spark: SparkSession, d: str) -> DataFrame:
    p = with_payload(points(spark, d))
    hits = shown(knn.top_k(p, vectors(spark, d)[0][1], 10, Metric.DOT, compile_filter(_HIT, MapLayout(F.col("payload")))))
    out = knn.hydrate(hits, p, ["payload"], 10)
    return out.select("rank", "id", "score", F.col("payload")["lang"]["s"]["t"].alias("lang"), F.col("payload")["n_chars"]["s"]["i"].alias("n_chars"))


# -- lexical

_TOKENS = r"list_filter(list_transform(regexp_split_to_array({t}, '[^\p{{L}}\p{{N}}]+'), lambda x: lower(x)), lambda x: x <> '')"


def documents(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document"), "lang")


@register("tokenize", f"select id, cast(len(t) as int) as n_tokens, md5(array_to_string(t, ' ')) as digest from (select doc_id as id, {_TOKENS.format(t='text')} as t from documents)")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    t = documents(spark, d).select("id", tokens(F.col("document")).alias("t"))
    return t.select("id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


_DOCS = f"docs as (select doc_id as id, lang, {_TOKENS.format(t='text')} as t from documents where text is not null)"
_TF = "tf as (select id, len, term, count(*) as tf from (select id, cast(len(t) as int) as len, unnest(t) as term from docs) group by id, len, term)"


@register("term_freq", f"with {_DOCS}, {_TF} select term, id, tf, len from tf")
def term_freq(spark: SparkSession, d: str) -> DataFrame:
    return lexical.term_frequencies(documents(spark, d))


@register("doc_freq", f"with {_DOCS}, {_TF} select term, count(*) as df from tf group by term")
def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return lexical.document_frequencies(lexical.term_frequencies(documents(spark, d)))


@register("corpus_stats", f"with {_DOCS} select count(*) as n, cast(sum(len(t)) as bigint) as total, avg(len(t)) as avgdl from docs")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.corpus_stats(documents(spark, d))


def bm25_sql(text: str, where: str = "true", k: int = 10, docs: str = "docs") -> str:
    """(id, s) over a relation docs(id, t, ...)."""
    terms = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    listed = ", ".join(f"({i}, '{t}')" for i, t in enumerate(terms))
    return f"""select id, s from (select c.id, sum(c.x order by c.pos) as s from (
      select d.id, q.pos, ln(1 + (g.n - f.df + 0.5::double) / (f.df + 0.5::double)) * (d.tf * 2.2::double) / (d.tf + 1.2::double * (0.25::double + 0.75::double * d.len / g.avgdl)) as x
      from (values {listed}) q(pos, term) join
        (select id, len(t) as len, u.term, len(list_filter(t, lambda y: y = u.term)) as tf from {docs}, (select distinct term from (values {listed}) v(pos, term)) u) d on d.term = q.term and d.tf > 0
        join (select u.term, count(*) filter (list_contains(t, u.term)) as df from {docs}, (select distinct term from (values {listed}) v(pos, term)) u group by u.term) f on f.term = q.term
        , (select count(*) as n, avg(len(t)) as avgdl from {docs}) g) c
      where c.id in (select id from {docs} where {where}) group by c.id) where s > 0 order by s desc, id limit {k}"""


def _rounded(inner: str) -> str:
    return ranked_sql(inner, "round(s, 9)")


@register("bm25_topk", f"with {_DOCS} {_rounded(bm25_sql('clown stupid worthless'))}")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return shown(lexical.search_text(documents(spark, d), "clown stupid worthless", 10), 9)


@register("bm25_repeated_term", f"with {_DOCS} {_rounded(bm25_sql(TEXT, k=25))}")
def bm25_repeated_term(spark: SparkSession, d: str) -> DataFrame:
    return shown(lexical.search_text(documents(spark, d), TEXT, 25), 9)


@register("bm25_filtered", f"with {_DOCS} {_rounded(bm25_sql(TEXT, where=chr(39).join(['lang = ', 'en', ''])))}")
def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    return shown(lexical.search_text(documents(spark, d), TEXT, 10, F.col("lang") == "en"), 9)


@register("bm25_postings", f"with {_DOCS} {_rounded(bm25_sql(TEXT))}")
def bm25_postings(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    row = lexical.corpus_stats(docs).first()
    return shown(lexical.search_postings(lexical.term_frequencies(docs), lexical.CorpusStats(row.n, row.total), TEXT, 10), 9)


# -- fusion and hybrid

_PDOCS = f"pdocs as (select *, {_TOKENS.format(t='document')} as t from p where document is not null)"


def fused_sql(dense: str, text: str, k: int) -> str:
    part = "select id, {c} as channel, 1.0::double / (60.0::double + row_number() over (order by s desc, id)) as x from ({i})"
    return f"select id, sum(x order by channel) as s from ({part.format(c=0, i=dense)} union all {part.format(c=1, i=text)}) group by id order by s desc, id limit {k}"


_AS_SINGLE = "round(cast(cast(s as float) as double), 9)"


@register("rrf_fuse", f"with {P}, {_PDOCS} {ranked_sql(fused_sql(top_sql('cosine', k=20), bm25_sql(TEXT, k=20, docs='pdocs'), 30), 'round(s, 9)')}")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    dense = knn.top_k(p, vectors(spark, d)[0][1], 20)
    text = lexical.search_text(p, TEXT, 20)
    return shown(fuse_rrf([by_rank(dense), by_rank(text)]).orderBy(F.desc("score"), "id").limit(30), 9)


def _hybrid(spark: SparkSession, d: str, q: HybridQuery, where: Column | None = None) -> DataFrame:
    p = points(spark, d)
    metric = q.metric or Metric.COSINE
    out = hybrid(q, lambda depth: knn.top_k(p, q.vector, depth, metric, where), lambda depth: lexical.search_text(p, q.text, depth, where))
    return out.select("rank", "id", F.round(F.col("score").cast("double"), 9).alias("score"))


@register("hybrid", f"with {P}, {_PDOCS} {ranked_sql(fused_sql(top_sql('cosine', k=40), bm25_sql(TEXT, k=40, docs='pdocs'), 10), _AS_SINGLE)}")
def hybrid_both(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, HybridQuery(10, vectors(spark, d)[0][1], TEXT))


@register("hybrid_filtered", f"with {P}, {_PDOCS} {ranked_sql(fused_sql(top_sql('cosine', _HIT_SQL, 40), bm25_sql(TEXT, _HIT_SQL, 40, 'pdocs'), 10), _AS_SINGLE)}")
def hybrid_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, HybridQuery(10, vectors(spark, d)[0][1], TEXT), condition(_HIT, columns()))


@register("hybrid_dense_only", f"with {P} {ranked_sql(top_sql('dot'), _AS_SINGLE)}")
def hybrid_dense_only(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, HybridQuery(10, vectors(spark, d)[0][1], None, Metric.DOT))


@register("hybrid_lexical_only", f"with {P}, {_PDOCS} {ranked_sql(bm25_sql(TEXT, docs='pdocs'), _AS_SINGLE)}")
def hybrid_lexical_only(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, HybridQuery(10, None, TEXT))


# -- collections


def _collection(spark: SparkSession, p: DataFrame | None = None, **meta: Any) -> Collection:
    c = Collection.create(spark, work_dir(spark, "collection"), CollectionMeta("points", Metric.COSINE, 64, **meta), "bigint")
    if p is not None:
        c.upsert(p)
    return c


def _shown(c: Collection) -> DataFrame:
    return c.live().select(
        "id", F.col("document").isNotNull().alias("has_document"), F.col("payload").isNotNull().alias("has_payload"),
        F.coalesce(F.size("payload"), F.lit(-1)).alias("n_fields"), F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"),
    )


_N_FIELDS = "(1 + " + " + ".join(f"cast(p_{k} is not null as int)" for k in FIELDS if k != "label") + ")"
_AS_SHOWN = f"""id, {{doc}} as has_document, {{has}} as has_payload, case when {{has}} then {_N_FIELDS} else -1 end as n_fields, round(cast(vector[1] as double), 6) as first"""
_WHOLE = _AS_SHOWN.format(doc="document is not null", has="has_payload")
_ERASED = _AS_SHOWN.format(doc="(document is not null and id % 7 <> 0)", has="(has_payload and id % 7 <> 0)")


@register("upsert_live_view", f"with {P} select {_ERASED} from p")
def upsert_erases(spark: SparkSession, d: str) -> DataFrame:
    """Points again without document and payload lose both."""
    p = with_payload(points(spark, d))
    c = _collection(spark, p)
    c.upsert(p.where("id % 7 = 0").select("id", "vector"))
    return _shown(c)


def _history(spark: SparkSession, d: str) -> Collection:
    p = with_payload(points(spark, d))
    c = _collection(spark, p)
    c.upsert(p.where("id % 7 = 0").select("id", "vector"))
    c.delete_many(p.where("id % 5 = 0").select("id"))
    c.upsert(p.where("id % 35 = 0"))
    return c


_LATER = _AS_SHOWN.format(doc="(document is not null and (id % 7 <> 0 or id % 35 = 0))", has="(has_payload and (id % 7 <> 0 or id % 35 = 0))")
_HISTORY = f"with {P} select {_LATER} from p where id % 5 <> 0 or id % 35 = 0"


@register("delete_then_upsert", _HISTORY)
def delete_then_upsert(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_history(spark, d))


@register("compact_equals_live", _HISTORY)
def compact_equals_live(spark: SparkSession, d: str) -> DataFrame:
    c = _history(spark, d)
    c.compact()
    return _shown(c)


@register("snapshot_equals_live", _HISTORY)
def snapshot_equals_live(spark: SparkSession, d: str) -> DataFrame:
    c = _history(spark, d).snapshot(work_dir(spark, "snapshot"))
    return _shown(Collection.open(spark, c.folder))


@register("delete_by_filter", f"with {P} select {_WHOLE} from p where not ({_HIT_SQL})")
def delete_by_filter(spark: SparkSession, d: str) -> DataFrame:
    c = _collection(spark, with_payload(points(spark, d)))
    c.delete_by_filter(_HIT)
    return _shown(c)


@register("describe_counts", "select 'all' as name, count(*) as count from embeddings union all select 'none', 0 union all select 'odd', count(*) filter (vec_id % 2 = 1) from embeddings")
def describe_counts(spark: SparkSession, d: str) -> DataFrame:
    db = Database(spark, work_dir(spark, "database"))
    p = bare(spark, d)
    for name, part in (("all", p), ("odd", p.where("id % 2 = 1")), ("none", None), ("gone", None)):
        db.create_collection(name, Metric.COSINE, 64, id_type="bigint")
        if part is not None:
            db.batch_upsert(name, part)
    db.drop_collection("gone")
    rows = [(x["name"], x["count"]) for x in Database(spark, db.root).list_collections()]
    return spark.createDataFrame(rows, "name string, count long")


@register("stream_bulk_upsert", "select vec_id as id, round(cast(embedding[1] as double), 6) as first from embeddings")
def stream_bulk_upsert(spark: SparkSession, d: str) -> DataFrame:
    source = spark.readStream.schema("vec_id long, embedding array<float>, label int").parquet(f"{d}/embeddings.parque[t]")  # a file or a folder of files; streams take a file by glob only
    c = _collection(spark)
    bulk_upsert_stream(source.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), c, work_dir(spark, "stream")).awaitTermination()
    return _shown(c).select("id", "first")


@register("collection_search", f"with {P} {ranked_sql(top_sql('cosine', _HIT_SQL))}")
def collection_search(spark: SparkSession, d: str) -> DataFrame:
    c = _collection(spark, with_payload(points(spark, d)))
    return shown(c.search(SearchQuery(vectors(spark, d)[0][1], 10, None, _HIT)))


@register("collection_hybrid", f"with {P}, {_PDOCS} {ranked_sql(fused_sql(top_sql('cosine', _HIT_SQL, 40), bm25_sql(TEXT, _HIT_SQL, 40, 'pdocs'), 10), _AS_SINGLE)}")
def collection_hybrid(spark: SparkSession, d: str) -> DataFrame:
    c = _collection(spark, with_payload(points(spark, d)))
    c.build_postings()
    q = HybridQuery(10, vectors(spark, d)[0][1], TEXT, None, _HIT).checked()
    return shown(c.search_hybrid(q), 9)


def _text_history(spark: SparkSession, d: str, delete: bool) -> DataFrame:
    """Postings are built first; the search after later writes reads them and the changes."""
    p = points(spark, d).select("id", "vector", "document")
    c = _collection(spark, p)
    c.build_postings()
    c.upsert(p.where("id % 3 = 0").select("id", "vector", F.concat(F.lit("a clown, stupid "), F.coalesce("document", F.lit(""))).alias("document")))
    if delete:
        c.delete_many(p.where("id % 5 = 0").select("id"))
    return shown(c.lexical(TEXT, 25), 9)


_LATER_TEXT = "q as (select id, case when id % 3 = 0 then 'a clown, stupid ' || coalesce(document, '') else document end as document from p where {w})"
_QDOCS = f"qdocs as (select id, {_TOKENS.format(t='document')} as t from q where document is not null)"
for _name, _delete, _w in (("bm25_after_upsert", False, "true"), ("bm25_after_delete", True, "id % 5 <> 0")):
    register(_name, f"with {P}, {_LATER_TEXT.format(w=_w)}, {_QDOCS} {_rounded(bm25_sql(TEXT, k=25, docs='qdocs'))}")(
        lambda spark, d, delete=_delete: _text_history(spark, d, delete)
    )


# -- approximate neighbours


def _graph(spark: SparkSession, d: str, least: int) -> DataFrame:
    """Shards grow in number with the table, so that none outgrows a worker."""
    path = work_dir(spark, "graph")
    hnsw.build(bare(spark, d), Metric.COSINE, HnswConfig(), least=least).write.parquet(path)
    return spark.read.parquet(path)


def _rescored(found: DataFrame, spark: SparkSession, d: str, queries: list[tuple[int, list[float]]]) -> DataFrame:
    """Hits with the exact score, as the graph's own comes from another order of additions."""
    hits = F.broadcast(found.select("query_id", "id"))
    both = bare(spark, d).join(hits, "id")
    s = reduce(lambda a, q: a.when(F.col("query_id") == q[0], metrics.score_to(Metric.COSINE, F.col("vector"), q[1])), queries, F.when(F.lit(False), F.lit(None).cast("float")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return both.select("query_id", "id", s.alias("score")).withColumn("rank", F.row_number().over(w)).select("query_id", "rank", "id", F.col("score").cast("double").alias("score"))


@register("hnsw_topk_full_ef", f"with {P}, {_QUERIES} {_BATCH}")
def hnsw_topk_full_ef(spark: SparkSession, d: str) -> DataFrame:
    q = vectors(spark, d, QUERY_IDS)
    found = hnsw.search(_graph(spark, d, 2), q, 5, Metric.COSINE, HnswConfig(), ef=1_000_000)
    return _rescored(found, spark, d, q)


#: Queries of one pass over points and graph.
RECALL_BLOCK = 1024


@register("hnsw_recall")
def hnsw_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of each point whose id is divisible by 50, whatever the size of the table."""
    graph, path = _graph(spark, d, 2), work_dir(spark, "recall")
    asked = _table(spark, d, "embeddings").where("vec_id % 50 = 0").select("vec_id", "embedding").orderBy("vec_id")
    rows = ((r.vec_id, r.embedding) for r in asked.toLocalIterator())
    for q in batched(rows, RECALL_BLOCK):
        exact = knn.batch_top_k(bare(spark, d), q, 10).select(F.col("query_id").cast("long").alias("query_id"), "id")
        found = hnsw.search(graph, q, 10, Metric.COSINE).select("query_id", "id", F.lit(1).alias("hit"))
        recall = exact.join(found, ["query_id", "id"], "left").groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))
        recall.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _recall_floor(metric: Metric, filtered: bool) -> Query:
    """Whether the mean recall at 10 of an HNSW collection is 0.9 or more, after writes that its graph has not seen."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        db = Database(spark, work_dir(spark, "database"))
        db.create_collection("points", metric, 64, "hnsw", id_type="bigint")
        p = with_payload(points(spark, d))
        db.batch_upsert("points", p)
        db.build_indexes("points")
        c = db.get("points")
        c.upsert(p.where("id % 11 = 0").select("id", F.transform("vector", lambda x: -x).alias("vector"), "document", "payload"))
        c.delete_many(p.where("id % 13 = 0").select("id"))
        node, shares = _HIT if filtered else None, []
        for _, v in vectors(spark, d, QUERY_IDS[::2]):
            exact = [r.id for r in knn.top_k(c.live(), v, 10, metric, c._where(node)).collect()]
            found = {r.id for r in c.search(SearchQuery(v, 10, None, node)).collect()}
            shares.append(len(found & set(exact)) / len(exact))
        return spark.createDataFrame([(sum(shares) >= 0.9 * len(shares),)], "reached boolean")

    return run


for _m in Metric:
    register(f"hnsw_recall_floor_{_m.value}", "select true as reached")(_recall_floor(_m, False))
register("hnsw_recall_floor_filtered", "select true as reached")(_recall_floor(Metric.COSINE, True))


# -- statistics of the bench


@register("latency_nearest_rank", "select quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.99) as p99 from events")
def latency_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    rank = "percentile_disc({}) within group (order by value)"
    return _table(spark, d, "events").agg(F.expr(rank.format(0.5)).alias("p50"), F.expr(rank.format(0.99)).alias("p99"))
