"""BM25 retrieval, over texts as they are or over a stored postings table.

Corpus statistics are always those of the whole corpus, whatever a filter admits.  A repeated
query term counts repeatedly, and contributions add up in query order, so scores are the same
in every plan."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import share_code
from .knn import best

#: Ids that occur twice or more are told apart by name up to so many; with more all rows are shuffled.
REPEATED_IDS = 10_000
#: Tokens counted at a time in a worker, and rows it hands on at a time.
TOKENS_AT_ONCE, ROWS_AT_ONCE = 1 << 20, 50_000


@dataclass(frozen=True)
class CorpusStats:
    n: int
    total: int

    @property
    def avgdl(self) -> float:
        return self.total / self.n if self.n else 0.0


def term_frequencies(docs: DataFrame, id_column: str = "id", document: str = "document", unique: bool = False) -> DataFrame:
    """(term, id, tf, len): the postings.  `len` stands in every row, so scoring needs no second join.  A text's
    terms are counted where it lies.  Only rows whose id repeats are counted together, by a shuffle; one pass
    over the ids finds these, unless the ids are known to be `unique`."""
    share_code(docs.sparkSession)
    d = docs.where(F.col(document).isNotNull()).select(F.col(id_column).alias("id"), F.col(document).alias("document"))
    if unique:
        return _counted_alone(d)
    found = [r.id for r in d.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id").limit(REPEATED_IDS + 1).collect()]
    if not found:
        return _counted_alone(d)
    if len(found) > REPEATED_IDS:
        return _counted_together(d)
    again = F.coalesce(F.col("id").isin([x for x in found if x is not None]), F.lit(None in found))
    return _counted_alone(d.where(~again)).unionByName(_counted_together(d.where(again)))


def _counted_together(d: DataFrame) -> DataFrame:
    # An outer explode, as the optimizer would tokenise for a filter below any other.
    t = d.select("id", T.tokens(F.col("document")).alias("tokens")).select("id", F.size("tokens").alias("len"), F.explode_outer("tokens").alias("term"))
    return t.where(F.col("term").isNotNull()).groupBy("term", "id", "len").agg(F.count(F.lit(1)).alias("tf")).select("term", "id", "tf", "len")


def _counted_alone(d: DataFrame) -> DataFrame:
    return d.select("id", T.tokens(F.col("document")).alias("tokens")).mapInArrow(_count, f"term string, id {dict(d.dtypes)['id']}, tf long, len int")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Term counts of each row, some TOKENS_AT_ONCE tokens at a time."""
    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ends, first = np.cumsum(sizes), 0
        while first < len(ids):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + TOKENS_AT_ONCE, "right")))
            terms = lists.slice(first, last - first).flatten().dictionary_encode()
            kinds = max(1, len(terms.dictionary))
            place = np.repeat(np.arange(first, last), sizes[first:last])
            key, tf = np.unique(place * kinds + terms.indices.to_numpy(), return_counts=True)
            for at in range(0, len(key), ROWS_AT_ONCE):
                row, term = np.divmod(key[at : at + ROWS_AT_ONCE], kinds)
                columns = [terms.dictionary.take(pa.array(term)), ids.take(pa.array(row)), pa.array(tf[at : at + ROWS_AT_ONCE]), pa.array(sizes[row].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["term", "id", "tf", "len"])
            first = last


def document_lengths(docs: DataFrame, id_column: str = "id", document: str = "document") -> DataFrame:
    """(id, len) of the rows that have a document."""
    return docs.where(F.col(document).isNotNull()).select(F.col(id_column).alias("id"), F.size(T.tokens(F.col(document))).alias("len"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(docs: DataFrame, document: str = "document") -> DataFrame:
    """n, total, avgdl over the rows that have a document; one without tokens counts too."""
    sizes = docs.where(F.col(document).isNotNull()).select(F.size(T.tokens(F.col(document))).alias("len"))
    return sizes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avgdl"))


def _finish(scored: DataFrame, k: int) -> DataFrame:
    """The number is always true; it keeps the filter from being pushed below the score, where it would
    tokenise a text once for each mention."""
    return best(scored.withColumn("m", F.monotonically_increasing_id()).where("score > 0 and m >= 0").drop("m"), k)


def _score(terms: list[str], df: dict[str, int], stats: CorpusStats, tf: dict[str, Column], length: Column) -> Column:
    out = F.lit(0.0)
    for t in terms:
        if df.get(t):
            out = out + T.term_score(T.idf(stats.n, df[t]), F.coalesce(tf[t], F.lit(0)), length, stats.avgdl)
    return out


def search_text(docs: DataFrame, query: str, k: int, where: Column | None = None, id_column: str = "id", document: str = "document") -> DataFrame:
    """(id, score) from the texts: one pass for the statistics (a single row to the driver), one for
    the scores.  Term counts are taken inside the row; nothing is exploded or shuffled."""
    terms = T.query_tokens(docs.sparkSession, query)
    own = sorted(set(terms))
    d = docs.where(F.col(document).isNotNull())
    tokens = T.tokens(F.col(document))

    def occurrences(term: str) -> Column:
        return F.size(F.filter("__t", lambda x: x == term))

    def counted(frame: DataFrame) -> DataFrame:
        f = frame.select(F.col(id_column).alias("id"), tokens.alias("__t"))
        return f.select("id", F.size("__t").alias("len"), *[occurrences(w).alias(f"tf{i}") for i, w in enumerate(own)])

    row = counted(d).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total"),
        *[F.coalesce(F.sum((F.col(f"tf{i}") > 0).cast("long")), F.lit(0)).alias(f"df{i}") for i in range(len(own))],
    ).first()
    stats = CorpusStats(row.n, row.total)
    df = {w: row[f"df{i}"] for i, w in enumerate(own)}
    # A text that holds no query term as a mere piece of it has score 0; looking for that is far cheaper
    # than tokenising.
    low = F.lower(F.translate(F.col(document), "Σ", "σ"))
    may = reduce(or_, [low.contains(w) for w in own if df.get(w)], F.lit(False))
    c = counted((d if where is None else d.where(where)).where(may))
    tf = {w: F.col(f"tf{i}") for i, w in enumerate(own)}
    return _finish(c.select("id", _score(terms, df, stats, tf, F.col("len")).alias("score")), k)


def search_postings(postings: DataFrame, stats: CorpusStats, query: str, k: int, admitted: DataFrame | None = None) -> DataFrame:
    """(id, score) from a postings table; the term filter reaches its scan.  `admitted` has the ids
    that a payload filter lets through."""
    terms = T.query_tokens(postings.sparkSession, query)
    own = sorted(set(terms))
    hit = postings.where(F.col("term").isin(own)) if own else postings.limit(0)
    df = {r.term: r.df for r in document_frequencies(hit).collect()}  # a row a query term
    if admitted is not None:
        hit = hit.join(admitted.select("id"), "id", "left_semi")
    per = hit.groupBy("id").agg(F.max("len").alias("len"), *[F.max(F.when(F.col("term") == w, F.col("tf"))).alias(f"tf{i}") for i, w in enumerate(own)])
    tf = {w: F.col(f"tf{i}") for i, w in enumerate(own)}
    return _finish(per.select("id", _score(terms, df, stats, tf, F.col("len")).alias("score")), k)


def common_terms(docs: DataFrame, low: int, high: int, n: int, id_column: str = "id", document: str = "document") -> list[str]:
    """The n most frequent terms with a document frequency from low to high; for choosing queries."""
    df = document_frequencies(term_frequencies(docs, id_column, document))
    return [r.term for r in df.where(F.col("df").between(low, high)).orderBy(F.desc("df"), "term").limit(n).collect()]

