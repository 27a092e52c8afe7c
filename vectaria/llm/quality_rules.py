"""Quality rules: base statistics and a hashed n-gram log-likelihood ratio between a trusted
target and the raw corpus (importance weights by hashed n-grams, Xie et al. 2023).

Only DataFrame functions.  Everything about one document is computed inside its row, so no
text and no shingle is ever shuffled; the only shuffle carries at most `buckets` counters from
each task.

Null text: no words, hence base_failed.  Empty text: likewise.  Repeated rows: each judged by
itself, alike.  A document's n-grams are its words and its pairs of neighbours, the last with the end.  No trusted row at all: both multinomials become equal and every ratio is 0.
Columns other than the three read are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

#: Hash buckets of the multinomials, a power of two.
BUCKETS = 1 << 14
#: Documents of the trusted set from which the target multinomial is fitted, at most.
TRUSTED_ROWS = 20_000
#: Nats per n-gram under which a document is rejected.
THRESHOLD = -0.05
SYMBOLS = "[#*$%&|<>]"


def pairs(w: Column) -> Column:
    """Every word with its successor, null for the last: structs (a, b)."""
    return F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))).alias("b"))


def bucket(x: Column, buckets: int) -> Column:
    return F.xxhash64(x).bitwiseAND(F.lit(buckets - 1).cast("long"))


def repeated_words(df: DataFrame) -> DataFrame:
    """Add `n_repeat_words` to a frame with the word array `__w` and its length `__n`.

    A window's 64-bit hash is cut to its high bits and packed with its position, so that one
    primitive sort brings equal windows together; what then has an equal neighbour is verified
    on whole hashes.  No row is exploded."""
    call = F.call_function
    m = F.greatest(F.col("__n") - 2, F.lit(0))
    df = df.withColumns({"__m": m, "__bits": F.length(F.bin(m.cast("long")))})
    windows = F.arrays_zip(*[F.slice("__w", F.lit(k), F.col("__m")) for k in (1, 2, 3)])
    df = df.withColumn("__h", F.transform(windows, lambda x: F.xxhash64(x)))
    packed = F.sort_array(F.transform("__h", lambda x, i: call("shiftleft", x, F.col("__bits")).bitwiseOR(i.cast("long"))))
    # Most texts repeat no window at all, which one pass with a hash set tells.
    df = df.withColumn("__p", F.when(F.size(F.array_distinct("__h")) < F.col("__m"), packed).otherwise(F.array().cast("array<bigint>")))
    high = lambda x, y: call("shiftright", x.bitwiseXOR(y), F.col("__bits")) == 0
    near = lambda a, k, same: same(F.get(a, k - 1)) | same(F.get(a, k + 1))  # a null beyond the ends is not true
    df = df.withColumn("__c", F.filter("__p", lambda x, k: near("__p", k, lambda y: high(x, y))))
    low = lambda x: x.bitwiseAND(call("shiftleft", F.lit(1).cast("long"), F.col("__bits")) - 1).cast("int")
    df = df.withColumn("__s", F.sort_array(F.transform("__c", lambda x: F.struct(F.get("__h", low(x)).alias("h"), low(x).alias("i")))))
    df = df.withColumn("__q", F.sort_array(F.transform(F.filter("__s", lambda x, k: near("__s", k, lambda y: y["h"] == x["h"])), lambda x: x["i"])))
    reach = F.transform("__q", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("__q", k + 1) - x, F.lit(3))))
    return df.withColumn("n_repeat_words", F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x))


def fit(docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS) -> list[float]:
    """Log ratio of target to raw probability for each bucket.

    The raw multinomial counts all n-grams of all documents.  The target's counts the documents
    whose ids are among the `trusted_rows` of `trusted_ids` (column doc_id) with the smallest
    hash: the bound makes their ids safe to broadcast (8 bytes each)."""
    ids = trusted_ids.select(F.col("doc_id").alias("__id")).where("__id is not null").distinct()
    ids = ids.orderBy(F.xxhash64("__id"), "__id").limit(trusted_rows).withColumn("__t", F.lit(1))
    d = docs.select(F.col("doc_id").alias("__id"), words(F.col("text")).alias("__w"))
    d = d.join(F.broadcast(ids), "__id", "left").select(F.coalesce("__t", F.lit(0)).alias("__t"), F.explode(pairs(F.col("__w"))).alias("p"))
    d = d.select("__t", F.stack(F.lit(2), bucket(F.col("p.a"), buckets), bucket(F.col("p"), buckets)).alias("b"))
    found = d.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("__t").alias("target")).collect()  # at most `buckets` rows
    raw, target = [0] * buckets, [0] * buckets
    for r in found:
        raw[r.b], target[r.b] = r.raw, r.target
    if not sum(target):
        return [0.0] * buckets
    t_all, r_all = sum(target) + buckets, sum(raw) + buckets
    # Raw probabilities stand behind the target's counts with the weight of one count a bucket, so
    # that a small trusted set gives ratios near 0 rather than noise.
    p = [(r + 1) / r_all for r in raw]
    return [math.log((t + buckets * q) / t_all) - math.log(q) for t, q in zip(target, p)]


def judge(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, the base statistics, base_failed, llr and kept; with `carry`,
    also the input row as a struct `__row`."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded to one literal
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if carry else F.lit(None)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text"), row.alias("__row"))
    d = d.withColumn("__w", words(F.col("__text")))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    d = d.select(
        "doc_id", "__row", "__w", F.size("__w").alias("__n"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
    )
    d = d.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")).drop("__lines")
    gain = lambda x: F.get(table, bucket(x, len(ratios)))
    d = d.withColumn("__llr", F.aggregate(pairs(F.col("__w")), F.lit(0.0), lambda a, x: a + gain(x["a"]) + gain(x)))
    d = repeated_words(d)
    n = F.col("__n").cast("long")
    d = d.select(
        "doc_id", *["__row"] * carry, n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((n < 50) | (100 * F.col("n_repeat_words") > 50 * n)).alias("base_failed"),
        F.when(n > 0, F.col("__llr") / (2 * n)).otherwise(F.lit(0.0)).alias("llr"),
    )
    # The row number is always true here.  It keeps a later filter on these columns from being
    # pushed below them, where it would repeat their expressions once for each mention.
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold) & (F.monotonically_increasing_id() >= 0))


def quality_rules(docs: DataFrame, trusted_ids: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Fit on `docs` and the trusted ids, then judge every row of `docs`."""
    return judge(docs, fit(docs, trusted_ids, buckets), threshold)
