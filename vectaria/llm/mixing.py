"""Mixing sources to target weights.

Sizes are words.  Sources in code-point order, null last, weigh 5, 2, 1, repeating, and share
the corpus; no target exceeds `CAP` times its source, and the excess is shared again by weight
until none does.  A source's rate is target / size; a document is taken floor(rate) times and
once more if a hash of its id falls under the fraction, so reruns and retried tasks agree.

Only DataFrame functions: one aggregate by source (partial sums before the shuffle) and a join
with the source table, which is broadcast only if counted to be small and otherwise joined on
salted keys, as one source may hold a third of all rows.

Null text: size 0, taken 0.  Null source: a source of its own.  Null doc_id: `emit` draws by the
text's hash; `mix` by default, as the SQL of op9_mixing, draws all such rows alike.
Repeated rows with one id are drawn alike.  An empty table gives an empty result.  A text of any
length is counted inside its row.  Columns but doc_id, text and source are carried by `emit`,
whatever their names, and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, written

WEIGHTS = (5, 2, 1)
CAP = 3
#: A source table of so many rows at most is broadcast (some 100 bytes a row).
BROADCAST_SOURCES = 20_000


def draw(doc_id: Column, text: Column | None = None) -> Column:
    """A number in [0, 1) from the md5 of the id, or of the hash of `text` if the id is null."""
    instead = F.lit("") if text is None else F.xxhash64(text).cast("string")
    digest = F.md5(F.coalesce(doc_id.cast("string"), instead).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def source_weights(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Add `weight` to one row per source, by its place in code-point order, null last.  Places
    are counted by range partition, so sources are never sorted in one task."""
    ranged = sizes.withColumn("is_null", F.col("source").isNull()).repartitionByRange("is_null", "source").withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "sources")
    w = Window.partitionBy("part").orderBy("is_null", "source")
    per = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    before, offsets = 0, []
    for p in sorted(per):
        offsets += [F.lit(p), F.lit(before)]
        before += per[p]
    place = F.row_number().over(w) - 1 + (F.create_map(*offsets)[F.col("part")] if offsets else F.lit(0))
    weight = F.element_at(F.array(*[F.lit(x) for x in weights]), (place % len(weights) + 1).cast("int"))
    return ranged.select("source", "source_size", weight.cast("long").alias("weight"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target.  Each round fixes the sources above their cap and shares the
    rest anew; what a round needs are three sums."""
    s = source_weights(sizes, weights)
    full = F.lit(False)
    total = s.agg(F.sum("source_size").alias("t")).first().t or 0
    limit = F.col("source_size") * cap
    share, fixed = F.lit(0.0), -1
    while True:
        got = s.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("open"),
            F.coalesce(F.sum(full.cast("long")), F.lit(0)).alias("n"),
        ).first()
        if not got.open or got.n == fixed:
            break
        fixed = got.n
        share = F.lit(float(total - got.capped)) * F.col("weight") / F.lit(float(got.open))
        full = full | (share > limit)
    return s.select("source", "source_size", F.when(full, limit.cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, carry: bool = False, by_text: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of every document; with `carry` also its whole row
    as a struct `row`, in which no name can clash.  `by_text`: rows without id are drawn by their text."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    d = docs.select("doc_id", n_words(docs["text"]).alias("size"), "source", draw(docs["doc_id"], docs["text"] if by_text else None).alias("draw"), *row)
    by = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = written(targets(written(by, "sizes"), weights, cap), "targets").withColumnRenamed("source", "s")
    if t.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        d = d.join(F.broadcast(t), F.col("source").eqNullSafe(F.col("s")), "left")
    else:
        salts = 16
        d = d.withColumn("salt", F.pmod(F.xxhash64("draw", "size"), F.lit(salts)).cast("int"))
        t = t.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        d = d.join(t, F.col("source").eqNullSafe(F.col("s")) & (F.col("salt") == F.col("t")), "left")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = whole + F.when(F.col("draw") < rate - whole, 1).otherwise(0)
    return d.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), *["row"] * carry)


def emit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mixed corpus itself: each document as often as it is taken, columns as in `docs`."""
    m = mix(docs, weights, cap, carry=True, by_text=True).where("copies > 0")
    return m.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
