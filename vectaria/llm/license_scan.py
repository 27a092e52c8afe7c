"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then
inheritance from the nearest ancestor directory by path joins.

Only DataFrame functions.  Units of comparison are the lines of a whole text, all its marked lines
together (a notice over several lines) and, for a licence file, the whole text.  A unit is marked
if it holds one of the terms that `marks` derives from the templates: a unit without any of
these can't reach the threshold with any template, so leaving it out loses nothing; nor can one
that `may_reach` rules out by how many of its terms no template has.  Term weights are
(1 + ln tf) x idf with idf from the template set, a fixed list of some hundred terms, so the term table is
broadcast.  A file with no licence of its own takes that of the nearest directory above it (or
its own) that has a licence file; directories are resolved once each before files join them, and an
ancestor that many directories share, as the root is, goes to them by broadcast.

Null path: the file has no directory and inherits nothing.  Null or empty text: no licence of its
own.  Null doc_id: no licence can be ascribed to it, but it may inherit one; rows with one doc_id are
one document.  Ties between templates: the higher cosine, then the smaller name; between licence files of
a directory likewise.  Repeated rows: each gets the same result.  An empty table gives an
empty result.  A very long text is split into lines and terms inside its row, of which only marked units leave it.
Columns other than doc_id, path, text are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, written
from .license_texts import TEMPLATES

TERM = r"[^a-z0-9.]+"
THRESHOLD = 0.6
#: Words that are left out of the marks first.
COMMON = "the of and to in a is it for that be this with not you or are as from by on was we an at no do our but so if may any all one its use other see work have will such can must under file".split()
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)"


def _terms(text: str) -> list[str]:
    return [t for t in (x.strip(".") for x in re.split(TERM, text.lower())) if t]


def model(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple[dict[str, float], list[tuple[str, int, str, float]], float]:
    """idf by term, unit template vectors as (term, template, licence, weight), idf of other terms."""
    bags = [Counter(_terms(t)) for _, t in templates]
    df = Counter(t for b in bags for t in b)
    n = len(bags)
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
    rows = []
    for k, (b, (name, _)) in enumerate(zip(bags, templates)):
        weight = {t: (1 + math.log(c)) * idf[t] for t, c in sorted(b.items())}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        rows += [(t, k, name, w / norm) for t, w in weight.items()]
    return idf, rows, math.log(1 + n) + 1


def marks(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> list[str]:
    """Terms of which a unit must hold one to reach the threshold.

    Of each template terms are left out, the commonest words first and then by weight, as long as their squared
    weights add up to less than the threshold's square: by the Cauchy-Schwarz inequality a unit that
    shares only these stays below it."""
    rows: dict[int, list[tuple[float, str]]] = {}
    for t, k, _, w in model(templates)[1]:
        rows.setdefault(k, []).append((w, t))
    out = set()
    for listed in rows.values():
        total = 0.0
        for w, t in sorted(listed, key=lambda x: (COMMON.index(x[1]) if x[1] in COMMON else len(COMMON), x)):
            total += w * w
            if total > threshold * threshold - 1e-6:
                out.add(t)
    return sorted(out)


def may_reach(found: Column, idf: dict[str, float], other: float, threshold: float) -> Column:
    """Whether a unit of these terms could reach the threshold: its squared cosine is at most the share that template
    terms have of its squared norm.  Of a class of terms with d distinct ones in n places the squared weights
    add up to d (1 + ln(n / d))^2 times the largest squared idf at most, as (1 + ln x)^2 is concave; each
    distinct term of no template adds the square of `other` at least."""
    low = sorted(t for t, x in idf.items() if x <= 2)
    high = sorted(t for t, x in idf.items() if x > 2)
    distinct, most, known = F.array_distinct(found), F.lit(0.0), F.lit(0)
    for listed in filter(None, (low, high)):
        d, n = (F.size(F.filter(x, lambda t: t.isin(listed))) for x in (distinct, found))  # noqa: B023
        f = 1 + F.log(n / F.greatest(d, F.lit(1)))
        most = most + F.when(d > 0, d * f * f * F.lit(max(idf[t] for t in listed) ** 2)).otherwise(F.lit(0.0))
        known = known + d
    square = threshold * threshold
    return most * F.lit(1 - square) >= (F.size(distinct) - known) * F.lit(square * other * other - 1e-6)


def terms(text: Column) -> Column:
    parts = F.transform(F.split(F.lower(text), TERM), lambda x: F.trim(x, F.lit(".")))
    return F.filter(parts, lambda x: x != "")


def own_licences(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, license_file: str = LICENSE_FILE) -> DataFrame:
    """doc_id, license, score of the documents that state one.  Only marked units leave their row."""
    spark = files.sparkSession
    idf, weights, other = model(templates)
    table: dict[str, list[tuple[int, str, float]]] = {}
    for t, k, name, w in weights:
        table.setdefault(t, []).append((k, name, w))
    kind = "term string, idf double, posts array<struct<template int, license string, w double>>"
    lexicon = F.broadcast(spark.createDataFrame([(t, idf[t], p) for t, p in sorted(table.items())], kind))
    listed = marks(templates, threshold)
    has_mark = lambda x: F.exists(terms(x), lambda t: t.isin(listed))
    whole = F.coalesce(F.substring_index("path", "/", -1).rlike(license_file), F.lit(False)) if "path" in files.columns else F.lit(False)
    marked = files.where("doc_id is not null and text is not null").select("doc_id", F.when(whole, F.col("text")).alias("all"), F.filter(F.split("text", "\n"), has_mark).alias("lines"))
    # The row number is always true here; it keeps the filter from being computed beside the lines once more.
    marked = marked.withColumn("m", F.monotonically_increasing_id()).where("size(lines) > 0 and m >= 0")
    parts = F.concat(F.col("lines"), F.array(F.array_join("lines", "\n")), F.when(F.col("all").isNotNull(), F.array("all")).otherwise(F.array().cast("array<string>")))
    units = marked.select("doc_id", F.explode(F.array_distinct(parts)).alias("unit"))
    near = units.select("doc_id", F.xxhash64("unit").alias("unit"), terms(F.col("unit")).alias("terms"), F.monotonically_increasing_id().alias("m"))
    near = near.where(may_reach(F.col("terms"), idf, other, threshold) & (F.col("m") >= 0))
    tf = near.select("doc_id", "unit", F.explode("terms").alias("term"))
    tf = tf.groupBy("doc_id", "unit", "term").agg(F.count(F.lit(1)).alias("tf")).join(lexicon, "term", "left")
    w = (F.lit(1.0) + F.log("tf")) * F.coalesce("idf", F.lit(other))
    # One aggregate: each term gives its square to the norm once, and its products to its templates.
    none = F.array(F.struct(F.lit(-1).alias("template"), F.lit(None).cast("string").alias("license"), F.lit(0.0).alias("w")))
    parts = tf.select("doc_id", "unit", w.alias("x"), F.explode(F.concat(F.coalesce("posts", F.array().cast("array<struct<template int, license string, w double>>")), none)).alias("p"))
    sums = parts.groupBy("doc_id", "unit", "p.template", "p.license").agg(
        F.sum(F.col("x") * F.col("p.w")).alias("dot"), F.sum(F.when(F.col("p.template") < 0, F.col("x") * F.col("x"))).alias("square")
    )
    dot = F.when(F.col("template") >= 0, F.struct((-F.round("dot", 9)).alias("m"), "license"))
    each = sums.groupBy("doc_id", "unit").agg(F.max("square").alias("square"), F.min(dot).alias("d")).where("d is not null")
    cos = each.select("doc_id", "d.license", F.round(-F.col("d.m") / F.sqrt("square"), 6).alias("score"))
    best = cos.where(F.col("score") >= threshold).groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("m"), "license")).alias("b"))
    return best.select("doc_id", "b.license", (-F.col("b.m")).alias("score"))


def parent(path: Column) -> Column:
    """The directory of a path, without a trailing slash; the root is ''."""
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def ancestors(directory: Column) -> Column:
    """The directory and all above it, nearest first."""
    parts = F.when(directory == "", F.array().cast("array<string>")).otherwise(F.split(directory, "/"))
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def license_scan(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, license_file: str = LICENSE_FILE) -> DataFrame:
    """doc_id, license, score, via (`own`, `inherited` or `none`) and from_dir for every row."""
    own = own_licences(files, templates, threshold, license_file)
    base = files.select("doc_id", "path", parent(F.col("path")).alias("dir"), F.substring_index("path", "/", -1).alias("name"))
    # Rows without id match nothing; they stay out of the join, where they would meet in one task.
    named = base.where("doc_id is not null").join(own.withColumn("via", F.lit("own")), "doc_id", "left")
    blank = [F.lit(None).cast(named.schema[c].dataType).alias(c) for c in ("license", "score", "via")]
    stated = written(named.unionByName(base.where("doc_id is null").select("*", *blank)), "stated")
    dirs = stated.where(F.col("via").isNotNull() & F.col("name").rlike(license_file) & F.col("dir").isNotNull())
    dirs = dirs.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("m"), "license")).alias("b")).select(F.col("dir").alias("from_dir"), F.col("b.license").alias("l"), (-F.col("b.m")).alias("s"))
    # Every directory once, with its number of files, however many files it has.
    each = base.where("dir is not null").groupBy("dir").agg(F.count(F.lit(1)).alias("__n"))
    up = each.select("dir", "__n", F.posexplode(ancestors(F.col("dir"))).alias("steps", "from_dir"))
    shared = dirs.join(up.groupBy("from_dir").agg(F.count(F.lit(1)).alias("__n")), "from_dir")
    near = hot_join(up.withColumnRenamed("__n", "files"), written(shared, "licensed"), "from_dir").withColumnRenamed("files", "__n").groupBy("dir", "__n").agg(F.min(F.struct("steps", "from_dir", "l", "s")).alias("d"))
    resolved = each.join(near.drop("__n"), "dir", "left").select("dir", "__n", "d")
    inside = hot_join(stated.where("dir is not null"), resolved, "dir")
    outside = stated.where("dir is null").select(*stated.columns, F.lit(None).cast(inside.schema["d"].dataType).alias("d"))
    out = inside.select(*stated.columns, "d").unionByName(outside)
    has, takes = F.col("via").isNotNull(), F.col("d").isNotNull()
    return out.select(
        "doc_id",
        F.when(has, F.col("license")).otherwise(F.col("d.l")).alias("license"),
        F.when(has, F.col("score")).when(takes, F.col("d.s")).otherwise(F.lit(0.0)).alias("score"),
        F.when(has, F.lit("own")).when(takes, F.lit("inherited")).otherwise(F.lit("none")).alias("via"),
        F.when(~has, F.col("d.from_dir")).alias("from_dir"),
    )


def path_of(docs: DataFrame) -> DataFrame:
    """doc_id, text and a path for a table that has none.  Files stand one to three directories below
    source/lang; short texts stand for licence files and lie at any level, the root included."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    small = F.length(F.coalesce("text", F.lit(""))) <= 400
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    levels = F.array(part("source"), part("lang"), F.concat(F.lit("a"), h % 5), F.concat(F.lit("b"), h % 7), F.concat(F.lit("c"), h % 11))
    kept = F.slice(levels, F.lit(1), F.when(small, (h % 997 + 4) % 6).otherwise(h % 3 + 3).cast("int"))
    name = F.concat(F.when(small, F.lit("LICENSE-")).otherwise(F.lit("file-")), part("doc_id"))
    return docs.select("doc_id", "text", F.array_join(F.concat(kept, F.array(name)), "/").alias("path"))
