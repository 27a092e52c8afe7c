"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a Java and Python regular expression class.
WHITE = r"[ \t-\r]+"

#: Rows and bytes of an Arrow batch handed to Python, at most (a single longer row excepted).
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20


def words(text: Column) -> Column:
    """The `[^\\x20\\x09-\\x0D]+` words of a text in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and give them small batches.  Spark reads these limits
    from the session when a plan runs, so they stay set; a smaller one of the caller's is kept."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    for limit, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        name = f"spark.sql.execution.arrow.{limit}"
        now = spark.conf.get(name)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; a folder of our own only where it is unset in a local
    session (tests).  On a cluster each machine would have its own, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="vectaria-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` as a table written to and read back from the shared folder: its lineage ends there."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_rows(df: DataFrame, fn: Callable[[Iterable[dict[str, list]]], Iterator[dict[str, list]]], schema: str) -> DataFrame:
    """Run `fn` over dictionaries of column lists, one per Arrow batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn({n: c.to_pylist() for n, c in zip(b.schema.names, b.columns)} for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def filter_rows(df: DataFrame, keep: Callable[[dict[str, list]], list[bool]], columns: list[str]) -> DataFrame:
    """The rows for which `keep`, called with lists of `columns`, is true; all columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(keep({c: b.column(b.schema.get_field_index(c)).to_pylist() for c in columns}), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def hot_join(df: DataFrame, small: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Inner join of `df` with `small`, which has one row per key and in `__n` the number of rows
    of `df` with it.  Keys with more than a `share`-th of all rows, `share` of them at most, go by
    broadcast and so are never gathered in one task; all others by an ordinary join."""
    total = small.agg(F.sum("__n")).first()[0] or 0
    hot = small.where(F.col("__n") * share > F.lit(total)).drop("__n").withColumn("__hot", F.lit(True))
    d = df.join(F.broadcast(hot), key, "left")
    cold = d.where("__hot is null").select(*df.columns).join(small.drop("__n"), key)
    return d.where("__hot").drop("__hot").unionByName(cold)
