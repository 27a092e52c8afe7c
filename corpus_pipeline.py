"""The training-data pipeline: stages that each apply one corpus operator to the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectaria.llm import bpe, language_id, mixing, near_copies, quality_rules
from vectaria.llm.common import written

#: Cosine to the nearest language prototype under which a text counts as no language.
LEAST_COSINE = 0.2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules.  Null, empty and short texts do not; repeated rows are
    judged alike; all columns are carried, whatever their names.  Without trusted rows every ratio is
    0 and the base rules decide.  An empty table gives an empty result, here and below."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    ratios = quality_rules.fit(docs, trusted)
    return quality_rules.judge(docs, ratios, carry=True).where("kept").select("__row.*")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones have.  Null texts and texts without a letter go;
    without any labelled row every text with a letter stays.  Columns as they are."""
    return language_id.keep_identified(docs, language_id.train(docs), LEAST_COSINE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, texts linked at a Jaccard similarity of 0.8 of
    their 5-word shingles: the one with the smallest id, and among texts of one id the one with
    the smallest hash, and among rows of one id and text the smallest row.  A row without an id gets
    one from its text, behind all others.  Null and empty texts are one group.  Rows of one id with
    unrelated texts stay.  An empty table gives an empty result."""
    # The row travels as one struct, so no column of its own can clash with a name used here.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    own = F.coalesce(docs["doc_id"], F.shiftrightunsigned(F.xxhash64(docs["text"]), 2) + F.lit(1 << 62))
    keyed = docs.select(own.alias("id"), F.xxhash64(docs["text"]).alias("hash"), row.alias("row"))
    groups = near_copies.near_copies(keyed.select(F.col("id").alias("doc_id"), "row.text"))
    named = groups.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("x")).select(F.col("x.doc_id").alias("id"), F.col("x.text_hash").alias("hash"))
    # Rows of one id and text become one before they move, so none of them is a hot key.
    one = keyed.groupBy("id", "hash").agg(F.min("row").alias("row"))
    return one.join(named, ["id", "hash"], "left_semi").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.  A null source is a source; a row without id is
    drawn by its text; null and empty texts have size 0.  Columns as they are."""
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document of the mix, null texts as empty ones, repeated rows alike."""
    return bpe.encode_decode(docs)


STAGES = [("quality rules", quality), ("language ID", languages), ("SimHash near-dedup", near_duplicates), ("mixing", mix), ("BPE", encode)]

#: SQL has neither XXH64 nor the tokenizer; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
