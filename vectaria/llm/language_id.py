"""Language identification with hyperdimensional profiles (after Joshi, Halseth and Kanerva 2016).

Each letter class has one random +1/-1 vector.  An n-gram's vector binds (multiplies) the
letters' vectors after rotating each by its place; a text's vector bundles (adds) those of all
its n-grams; a language's prototype bundles its training texts.  A text takes the language
whose prototype has the largest cosine to it, ties going to the smaller language name.

Bundling is linear, so training needs only n-gram counts per language: they are counted in
full over all training rows, `CELLS` counters at most from one task and language, and only the
counts move.  Prediction is one pass without shuffle.

Null text or text without a letter: `und`, score 0.  No training row: every text is `und`.
Repeated rows get the same prediction.  Columns other than doc_id, text, lang are not read.
Texts of any length are worked through in pieces of PIECE characters and slices of SLICE n-grams, so
beside the text itself memory does not grow with it.  The prototypes are the model: 8 KB a language,
held by the driver and sent to each task.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, map_rows, prepare

UND = "und"
#: Components of a vector, letter classes (class 0: a run of other characters), n-gram length.
DIM, CLASSES, N = 1024, 64, 3
CELLS = CLASSES**N
SEED = 20177
#: Characters worked on at a time.
PIECE = 1 << 18
#: n-grams bundled at a time, and n-grams whose vectors a worker keeps (1 KB each).
SLICE, KEPT = 4096, 32_768

_cache: dict[str, np.ndarray] = {}


def letter_classes() -> np.ndarray:
    """Class of every code point: 0 for non-letters; a-z have their own, other letters share."""
    if "classes" not in _cache:
        t = np.zeros(sys.maxunicode + 1, np.uint8)
        for c in range(sys.maxunicode + 1):
            if unicodedata.category(chr(c))[0] == "L":
                low = ord(chr(c).lower()[0])
                t[c] = low - 96 if 97 <= low <= 122 else 27 + low % (CLASSES - 27)
        _cache["classes"] = t
    return _cache["classes"]


def letter_vectors() -> np.ndarray:
    """Row (place, class): the class's vector rotated by its place in the n-gram."""
    if "letters" not in _cache:
        base = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (CLASSES, DIM))
        _cache["letters"] = np.stack([np.roll(base, N - 1 - p, axis=1) for p in range(N)])
    return _cache["letters"]


def weighted_sum(cells: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sum of the n-grams' bound vectors, each times its count, in slices of SLICE n-grams.  Vectors of
    the first KEPT n-grams that occur are kept; those of others are bound anew each time."""
    if "table" not in _cache:
        _cache["table"], _cache["place"], _cache["used"] = np.zeros((KEPT, DIM), np.int8), np.full(CELLS, -1, np.int32), np.zeros(1, np.int64)
    table, place, used = _cache["table"], _cache["place"], _cache["used"]
    out = np.zeros(DIM)
    for k in range(0, len(cells), SLICE):
        part, count = cells[k : k + SLICE], n[k : k + SLICE]
        at = place[part]
        new = np.unique(part[at < 0])
        if len(new):
            make = new[: max(0, KEPT - int(used[0]))]
            place[make] = np.arange(used[0], used[0] + len(make))
            table[place[make]] = bind(make)
            used[0] += len(make)
            at = place[part]
        kind = np.float32 if count.sum() < 1 << 24 else np.float64  # either way exact
        have = at >= 0
        out += count[have].astype(kind) @ table[at[have]].astype(kind)
        if not have.all():
            out += count[~have].astype(kind) @ bind(part[~have]).astype(kind)
    return out


def bind(cells: np.ndarray) -> np.ndarray:
    v = letter_vectors()
    return v[0][cells // (CLASSES * CLASSES)] * v[1][cells // CLASSES % CLASSES] * v[2][cells % CLASSES]


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, cell) of every n-gram, in pieces of about PIECE characters.  A text is read as if
    one non-letter stood before and after it; a run of non-letters counts once."""
    table, rows, parts, size = letter_classes(), [], [], 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        cls = table[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        row = np.repeat(np.array(rows, np.int64), [len(p) for p in parts])
        last = np.zeros(len(cls), bool)
        last[1:] = (cls[1:] == 0) & (cls[:-1] == 0) & (row[1:] == row[:-1])
        cls, row = cls[~last].astype(np.int64), row[~last]
        inside = row[2:] == row[:-2]
        return row[:-2][inside], ((cls[:-2] * CLASSES + cls[1:-1]) * CLASSES + cls[2:])[inside]

    for i, t in enumerate(texts):
        t = f" {t or ''} "
        at, carry = 0, ""
        while at < len(t):
            part = t[at : at + PIECE]
            at += len(part)
            # A long text goes in pieces that overlap by its last two kept characters.
            parts.append(carry + part)
            rows.append(i)
            size += len(part)
            if at < len(t) or size >= PIECE:
                carry = _tail(carry + part) if at < len(t) else ""
                yield flush()
                parts.clear(), rows.clear()
                size = 0
    if parts:
        yield flush()


def _tail(s: str) -> str:
    """The last two characters of `s` after runs of non-letters are taken as one."""
    table, kept = letter_classes(), []
    for c in reversed(s):
        if len(kept) == N - 1:
            break
        if table[ord(c)] or not kept or table[ord(kept[-1])]:
            kept.append(c)
    return "".join(reversed(kept))


def _count(batches: Iterable[dict]) -> Iterator[dict]:
    counts: dict[str, np.ndarray] = {}
    for b in batches:
        for lang in set(b["lang"]):
            texts = [t for t, x in zip(b["text"], b["lang"]) if x == lang]
            c = counts.setdefault(lang, np.zeros(CELLS, np.int64))
            for _, cells in _pieces(texts):
                c += np.bincount(cells, minlength=CELLS)
        if len(counts) > 64:  # many languages: hand on what has been counted
            yield from _emit(counts)
            counts = {}
    yield from _emit(counts)


def _emit(counts: dict[str, np.ndarray]) -> Iterator[dict]:
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        yield {"lang": [lang] * len(at), "cell": at.tolist(), "n": c[at].tolist()}


def train(docs: DataFrame, where: Column | None = None) -> dict[str, np.ndarray]:
    """Unit prototypes of the languages in the rows with a non-null lang (and `where`)."""
    prepare(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = (known if where is None else known.where(where)).select("text", "lang")
    counts = map_rows(known, _count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    sums = map_rows(counts, _bundle, "lang string, at int, x double")
    rows = sums.groupBy("lang", "at").agg(F.sum("x").alias("x"))
    protos: dict[str, np.ndarray] = {}
    for r in rows.toLocalIterator():  # the model itself: DIM numbers a language, as many languages as there are labels
        protos.setdefault(r.lang, np.zeros(DIM))[r.at] = r.x
    return {k: v / (np.linalg.norm(v) or 1.0) for k, v in sorted(protos.items())}


def _bundle(batches: Iterable[dict]) -> Iterator[dict]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        langs, cells, n = np.array(b["lang"], object), np.array(b["cell"], np.int64), np.array(b["n"], float)
        for lang in set(b["lang"]):
            at = langs == lang
            sums.setdefault(lang, np.zeros(DIM))
            sums[lang] += weighted_sum(cells[at], n[at])
    for lang, v in sums.items():
        yield {"lang": [lang] * DIM, "at": list(range(DIM)), "x": v.tolist()}


def text_vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bundled vector of each text, and whether it has a letter."""
    out, has = np.zeros((len(texts), DIM)), np.zeros(len(texts), bool)
    for row, cell in _pieces(texts):
        keys, n = np.unique(row * CELLS + cell, return_counts=True)
        row, cell = keys // CELLS, keys % CELLS
        letter = cell > 0
        has[row[letter]] = True
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else []
        for a, b in zip(starts, [*starts[1:], len(row)]):
            out[row[a]] += weighted_sum(cell[a:b], n[a:b])
    return out, has


def classify(texts: list[str | None], langs: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    if not langs:
        return [UND] * len(texts), [0.0] * len(texts)
    v, has = text_vectors(texts)
    norm = np.linalg.norm(v, axis=1)  # components are whole numbers, exact in any order of adding
    cos = (v @ matrix.T) / np.where(norm > 0, norm, 1)[:, None]
    best = cos.argmax(1)
    score = np.where(has, np.clip(cos[np.arange(len(v)), best], 0, 1), 0.0)
    return [langs[k] if h else UND for k, h in zip(best, has)], score.astype(float).tolist()


def as_matrix(protos: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    return list(protos), np.array(list(protos.values()), np.float32).reshape(len(protos), DIM)


def identify(docs: DataFrame, protos: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score (the cosine, 0 at least) for every row."""
    prepare(docs.sparkSession)
    langs, matrix = as_matrix(protos)

    def predict(batches: Iterable[dict]) -> Iterator[dict]:
        for b in batches:
            pred, score = classify(b["text"], langs, matrix)
            yield {"doc_id": b["doc_id"], "lang_pred": pred, "score": score}

    kind = dict(docs.dtypes)["doc_id"]
    return map_rows(docs.select("doc_id", "text"), predict, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, protos: dict[str, np.ndarray], least: float) -> DataFrame:
    """The rows whose text has a language with a cosine of `least` or more; columns as in `docs`.
    Without any prototype there is nothing to compare with: all texts that have a letter stay."""
    prepare(docs.sparkSession)
    langs, matrix = as_matrix(protos)

    def keep(b: dict) -> list[bool]:
        if not langs:
            return text_vectors(b["text"])[1].tolist()
        return [p != UND and s >= least for p, s in zip(*classify(b["text"], langs, matrix))]

    return filter_rows(docs, keep, ["text"])


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2.  A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
