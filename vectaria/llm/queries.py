"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language_id, license_scan, mixing, quality_rules, simhash, token_counts, topk_search, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    protos = language_id.train(docs, ~language_id.held_out(F.col("doc_id")))
    return language_id.identify(docs, protos).select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(license_scan.path_of(_table(spark, sf_dir, "documents")))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(_table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").where("quality = 1")
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"), trusted)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.with_edits(_table(spark, sf_dir, "documents"), token_counts.sample_edits)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grade"))
    return toxicity.severity(docs, toxicity.fit(docs, labels))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(_table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_license_scan, op3_url_filter, op4_quality_rules, op5_token_counts, op6_simhash, op7_topk, op8_toxicity, op9_mixing, op10_bpe)
}


def _op3_sql() -> str:
    def regex(glob: str) -> str:
        out, k = "", 0
        while k < len(glob):
            if glob[k : k + 2] == "**":
                out, k = out + "(.|\\n)*", k + 2
            elif glob[k] == "*":
                out, k = out + "[^/]*", k + 1
            elif glob[k] == "?":
                out, k = out + "[^/]", k + 1
            else:
                out, k = out + ("\\" + glob[k] if not glob[k].isalnum() and glob[k] not in "-_/" else glob[k]), k + 1
        return "^" + out + "$"

    globs = " or ".join(f"regexp_matches(w, '{regex(r.glob)}')" for r in url_filter.GLOB_RULES)
    return f"""
    with a as (select page_id, case when url is not null and contains(url, '://') then substr(url, strpos(url, '://') + 3) end as rest from pages),
    b as (select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
                 coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from a),
    c as (select *, '.' || host as h, '.' || host || path as w from b),
    d as (select *, case
        when ends_with(h, '.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
        when ends_with(h, '.example.org') and starts_with(path, '/es/') then 'example.org/es/'
        when ends_with(h, '.com') and starts_with(path, '/fr/') then 'com/fr/'
        when ends_with(h, '.com') and starts_with(path, '/de/') then 'com/de/'
        when ends_with(h, '.org') and starts_with(path, '/') then 'org/' end as rule from c)
    select page_id, host, path, rule, case
        when rule in ('example.org/en/1', 'example.org/es/', 'com/de/') then 'block'
        when rule is not null then 'allow'
        when {globs} then 'block' else 'allow' end as verdict from d
    """


ORACLES: dict[str, str] = {
    "op3_url_filter": _op3_sql(),
    "op7_topk": """
    with p as (select vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 1024) as bigint)) as v from embeddings
               where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
    q as (select vec_id as query_id, v as q from p where vec_id % 100 = 0),
    s as (select query_id, vec_id, list_sum(list_transform(list_zip(q, v), lambda z: z[1] * z[2])) as score from q, p where vec_id <> query_id),
    r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
    select query_id, cast(rank as int) as rank, vec_id, cast(score as bigint) as score from r where rank <= 10
    """,
    "op9_mixing": r"""
    with d as (select doc_id, source, cast(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '')) as bigint) as size from documents),
    s as (select source, cast(sum(size) as bigint) as c from d group by source),
    o as (select source, c, [5, 2, 1][cast((row_number() over (order by source nulls last) - 1) % 3 as int) + 1] as w from s),
    -- Sources are full in the order of cap / weight: find how many.
    k as (select *, row_number() over (order by 3.0::double * c / w, source nulls last) as i from o),
    m as (select *, coalesce(sum(3 * c) over (order by i rows between unbounded preceding and 1 preceding), 0) as before_c,
                    sum(w) over (order by i rows between current row and unbounded following) as rest_w, sum(c) over () as total from k),
    f as (select *, cast(total - before_c as double) * w / cast(rest_w as double) as share from m),
    e as (select min(i) as first_open from f where share <= 3 * c),
    t as (select f.source, f.c, case when f.i < e.first_open then cast(3 * f.c as double)
              else cast(g.total - g.before_c as double) * f.w / cast(g.rest_w as double) end as target
          from f, e, (select total, before_c, rest_w, i from f) g where g.i = e.first_open),
    r as (select d.doc_id, d.size, t.c as source_size, t.target, case when t.c > 0 then least(t.target / t.c, 3.0::double) else 0.0::double end as rate,
                 cast(('0x' || substr(md5(coalesce(cast(d.doc_id as varchar), '')), 1, 13)) as bigint) / 4503599627370496.0::double as draw
          from d join t on d.source is not distinct from t.source)
    select doc_id, size, source_size, target, size * (cast(floor(rate) as bigint) + case when draw < rate - floor(rate) then 1 else 0 end) as taken from r
    """,
}
