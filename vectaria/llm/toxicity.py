"""Toxicity severity by cumulative-link (proportional odds) ordinal regression.

P(grade > j) = sigmoid(w.x - b_j) with one weight vector for all thresholds b_0 <= b_1 <= ...
Features are sparse: presence of lower-cased words.  The expected severity of a text is
sum over j of P(grade > j); it is `toxic` if P(grade > 0) exceeds `FLAG`.

The model is fitted from `FIT_ROWS` labelled rows at most (a documented bound; the labelled rows
with the smallest id hash).  Their words are counted by grade in a shuffle, the `VOCABULARY` words
whose mean grade departs most from the overall mean become features, and only those go to the
driver, where an L1 penalty leaves few a weight.  Prediction reads every whole text in one pass
without shuffle.

Null and empty texts have no feature: their severity is the base rate's, and they are never
toxic.  Repeated rows get the same result.  Of the rows of one labelled doc_id, one is in the sample (a
text with words before one without, then by hash).  Labels: one row per doc_id counts (the highest grade); null grades are left out.  Without labels every severity is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, prepare, written

FIT_ROWS = 20_000
#: Features at most, and the texts of the sample that one must occur in.
VOCABULARY, MIN_TEXTS = 3000, 3
#: Probability of any toxicity above which a text is flagged: under a half, as toxic texts are few and a miss costs more.
FLAG = 0.25
WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


class Ordinal:
    def __init__(self, weights: dict[str, float], cuts: list[float]) -> None:
        self.weights, self.cuts = weights, cuts

    @classmethod
    def fit(cls, rows: list[set[str]], grades: list[int], l1: float = 2e-4, rounds: int = 600) -> Ordinal:
        """Proximal gradient descent with momentum on the mean negative log likelihood."""
        if not rows:
            return cls({}, [])
        levels = max(grades)
        df = Counter(w for r in rows for w in r)
        vocab = {w: i for i, w in enumerate(sorted(w for w, n in df.items() if n >= min(MIN_TEXTS, len(rows))))}
        cols = [np.array(sorted(vocab[w] for w in r if w in vocab), np.int64) for r in rows]
        idx = np.concatenate([np.zeros(0, np.int64), *cols])
        row = np.repeat(np.arange(len(rows)), [len(c) for c in cols])
        y = np.array(grades)
        share = [np.clip(np.mean(y > j), 1e-3, 1 - 1e-3) for j in range(levels)]
        b = np.array([-np.log(p / (1 - p)) for p in share])
        w, prev, n = np.zeros(len(vocab)), np.zeros(len(vocab)), len(rows)
        # A step for each word by how common it is keeps rare but telling words as fast as others.
        scale = 1.0 / np.maximum(0.02, np.bincount(idx, minlength=len(vocab)) / n)
        for t in range(rounds):
            v = w + (t / (t + 3)) * (w - prev)
            s = np.bincount(row, v[idx], n)
            g_s, g_b = cls._gradient(s, b, y)
            grad = np.bincount(idx, g_s[row], len(vocab)) / n
            step = 0.5 * scale
            prev, z = w, v - step * grad
            w = np.sign(z) * np.maximum(np.abs(z) - step * l1, 0)
            b = np.maximum.accumulate(b - 0.5 * g_b / n)
        return cls({x: float(w[i]) for x, i in vocab.items() if w[i]}, b.tolist())

    @staticmethod
    def _gradient(s: np.ndarray, b: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the negative log likelihood by score and by cut."""
        levels = len(b)
        over = 1 / (1 + np.exp(-np.clip(s[:, None] - b, -50, 50)))  # P(y > j)
        p = np.hstack([np.ones((len(s), 1)), over, np.zeros((len(s), 1))])
        d = p * (1 - p)
        at = np.arange(len(s))
        prob = np.maximum(p[at, y] - p[at, y + 1], 1e-12)
        g_s = -(d[at, y] - d[at, y + 1]) / prob
        g_b = np.zeros(levels)
        up, down = d[at, y] / prob, -d[at, y + 1] / prob  # cut y-1 lowers P(y > y-1), cut y lowers P(y > y)
        np.add.at(g_b, y[y > 0] - 1, up[y > 0])
        np.add.at(g_b, y[y < levels], down[y < levels])
        return g_s, g_b

    def probabilities(self, text: str | None) -> list[float]:
        words = features(text)
        s = sum(sorted(self.weights[w] for w in words & self.weights.keys())) if words else 0.0
        return [1 / (1 + float(np.exp(-np.clip(s - c, -50, 50)))) for c in self.cuts]


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Ordinal:
    """`labels`: doc_id and an integer `grade` from 0."""
    ids = labels.select("doc_id", F.col("grade").cast("int").alias("grade")).where("doc_id is not null and grade >= 0")
    ids = ids.groupBy("doc_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    prepare(docs.sparkSession)

    def words(batches: Iterable[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b["doc_id"], "grade": b["grade"], "words": [sorted(features(t)) for t in b["text"]]}

    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "grade", "text")
    sample = map_rows(sample, words, f"doc_id {dict(docs.dtypes)['doc_id']}, grade int, words array<string>")
    sample = sample.groupBy("doc_id").agg(F.min(F.struct(F.size("words") == 0, F.xxhash64("words"), "words", "grade")).alias("x"))
    sample = written(sample.select("x.grade", "x.words"), "graded")
    whole = sample.agg(F.avg("grade").alias("mean"), F.var_pop("grade").alias("var")).first()
    if not whole.var:
        return Ordinal.fit([], [])
    by = sample.select("grade", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("grade").alias("g"))
    odd = F.abs(F.col("g") - F.col("n") * F.lit(whole.mean)) / F.sqrt(F.col("n") * F.lit(whole.var))
    picked = by.where(F.col("n") >= MIN_TEXTS).orderBy(odd.desc(), "word").limit(VOCABULARY).select("word").collect()
    vocabulary = F.array(*[F.lit(w) for w in sorted(r.word for r in picked)]).cast("array<string>")
    rows = sample.select("grade", F.array_intersect("words", vocabulary).alias("words")).orderBy("grade", F.xxhash64("words")).collect()
    return Ordinal.fit([set(r.words) for r in rows], [r.grade for r in rows])


def severity(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, severity (expected grade), grade (most likely) and toxic for every row."""
    prepare(docs.sparkSession)

    def run(batches: Iterable[dict]) -> Iterator[dict]:
        for b in batches:
            p = [model.probabilities(t) for t in b["text"]]
            yield {
                "doc_id": b["doc_id"],
                "severity": [float(sum(x)) for x in p],
                "grade": [sum(y > 0.5 for y in x) for x in p],
                "toxic": [bool(x) and x[0] > FLAG and bool(t) for x, t in zip(p, b["text"])],
            }

    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, severity double, grade int, toxic boolean")
