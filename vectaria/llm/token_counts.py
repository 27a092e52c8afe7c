"""Edit-aware token counts.

A document is kept as a segment tree over runs of pre-tokens: each leaf has its text, its
character count and its token count; each inner node the sums of its subtree.  `plant` makes a
table with a tree a row, `edit` applies a batch of edits to such a table and gives the next one, so
a later batch starts from the trees of the one before.  An edit finds the leaves it touches by
the character sums, re-encodes only those and, where the edit disturbed their edges, the
neighbours that give boundary context, and updates the sums on the path to the root.  Counts
always equal those of encoding the whole edited text.

A leaf begins only where the pre-tokenizer cuts whatever stands around: behind a character that is
not white space, before one of another class (letter, number, white space, other), except behind an
apostrophe.  No pre-token before such a cut looks past it, so leaves encode independently, and whether a
cut is still safe after an edit depends on the two characters around it alone.  A leaf that grows is
split again, those around it keep their counts.  Only a single pre-token is never split: one of many
characters is a leaf by itself.

Null text: count 0, edits apply to the empty text.  Null or empty edits change nothing.  An
edit beyond the end is cut to the text (`at` and `cut` as in slicing, at least 0; null `put` is
empty).  Repeated rows are counted alike.  An empty table gives an empty result.  Columns but those
named are not read.  One document is held by a task at a time, whole.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, prepare, written

#: Characters of a leaf at least (where the text has a safe cut).
LEAF = 512
TREE = "texts array<string>, chars array<int>, tokens array<int>"


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_loaded: dict[str, Callable[[str], int]] = {}


def counter(path: str) -> Callable[[str], int]:
    """Number of tokens of a text under a rank file."""
    if path not in _loaded:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _loaded[path] = lambda t: len(encoding.encode_ordinary(t))
    return _loaded[path]


def safe(text: str, at: int) -> bool:
    """Whether the pre-tokenizer cuts before `at` whatever stands around these two characters."""
    if not 0 < at < len(text):
        return False
    a, b = _class(text[at - 1]), _class(text[at])
    return a != b and a not in " ?" and b != "?" and not (text[at - 1] == "'" and b != " ")


@cache
def _class(c: str) -> str:
    """L, N, white space or other (P); ? if Unicode versions differ about it."""
    if c.isspace() and not "\x1c" <= c <= "\x1f":
        return " "
    now, then = (x.category(c)[0] if x.category(c)[0] in "LN" else "P" for x in (unicodedata, unicodedata.ucd_3_2_0))
    return now if now == then and unicodedata.ucd_3_2_0.category(c) != "Cn" else "?"


def leaves(text: str) -> list[str]:
    out, start, at = [], 0, LEAF
    while at < len(text):
        if safe(text, at):
            out.append(text[start:at])
            start, at = at, at + LEAF
        else:
            at += 1
    return [*out, text[start:]]


class TokenTree:
    """Segment tree; node k has the children 2k and 2k+1, leaves start at `width`."""

    def __init__(self, text: str, count: Callable[[str], int]) -> None:
        self.count, self.encoded = count, 0
        texts = leaves(text)
        self._build(texts, [self._encode(t) for t in texts])

    @classmethod
    def stored(cls, texts: list[str], chars: list[int], tokens: list[int], count: Callable[[str], int]) -> TokenTree:
        """A tree as it was kept; nothing is encoded."""
        tree = cls.__new__(cls)
        tree.count, tree.encoded, tree.width = count, 0, len(chars) // 2
        tree.texts, tree.chars, tree.tokens = list(texts), list(chars), list(tokens)
        return tree

    def _build(self, texts: list[str], tokens: list[int]) -> None:
        self.texts = texts
        self.width = 1 << (len(texts) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        self.chars[self.width : self.width + len(texts)] = map(len, texts)
        self.tokens[self.width : self.width + len(texts)] = tokens
        for k in range(self.width - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def _encode(self, text: str) -> int:
        self.encoded += len(text)
        return self.count(text) if text else 0

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def _find(self, at: int) -> tuple[int, int]:
        """Leaf with character `at` (the last non-empty one for the end) and the place in it."""
        k = 1
        while k < self.width:
            k *= 2
            if at >= self.chars[k] and self.chars[k + 1]:
                at -= self.chars[k]
                k += 1
        return k - self.width, at

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.texts[leaf] = text
        k = self.width + leaf
        self.chars[k], self.tokens[k] = len(text), tokens
        while k > 1:
            k //= 2
            self._sum(k)

    def _beside(self, leaf: int, step: int) -> int | None:
        """The next leaf that way that has text."""
        leaf += step
        while 0 <= leaf < len(self.texts):
            if self.texts[leaf]:
                return leaf
            leaf += step
        return None

    def edit(self, at: int, cut: int, put: str) -> int:
        """Replace `cut` characters from `at` with `put`; returns the new count."""
        at = min(max(at, 0), self.chars[1])
        cut = min(max(cut, 0), self.chars[1] - at)
        first, inner = self._find(at)
        last, end = self._find(at + cut) if cut else (first, inner)
        region = self.texts[first][:inner] + put + self.texts[last][end:]
        low, high = first, last
        while (left := self._beside(low, -1)) is not None and not safe((t := self.texts[left])[-1] + region[:1], 1):
            low, region = left, t + region
        while (right := self._beside(high, 1)) is not None and not safe(region[-1:] + (t := self.texts[right])[:1], 1):
            high, region = right, region + t
        known = dict(zip(self.texts[low : high + 1], self.tokens[self.width + low : self.width + high + 1]))
        parts = leaves(region)
        counts = [known[p] if p in known else self._encode(p) for p in parts]
        room = high - low + 1
        if len(parts) <= room:
            for i, (p, n) in enumerate(zip([*parts, *[""] * (room - len(parts))], [*counts, *[0] * (room - len(parts))])):
                if p or self.texts[low + i]:
                    self._set(low + i, p, n)
        else:  # more leaves than places: the sums are added up again, the other leaves keep their counts
            old = [(t, n) for t, n in zip(self.texts, self.tokens[self.width :])]
            kept = [x for x in old[:low] if x[0]] + list(zip(parts, counts)) + [x for x in old[high + 1 :] if x[0]]
            self._build([t for t, _ in kept], [n for _, n in kept])
        return self.total


def plant(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The trees of `docs` (doc_id, text): doc_id, texts of the leaves, and characters and tokens of all
    nodes, the root's at place 1."""
    prepare(docs.sparkSession)
    file = path or default_file()

    def run(batches: Iterable[dict]) -> Iterator[dict]:
        count = counter(file)
        for b in batches:
            trees = [TokenTree(t or "", count) for t in b["text"]]
            yield {"doc_id": b["doc_id"]} | {k: [getattr(t, k) for t in trees] for k in ("texts", "chars", "tokens")}

    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, {TREE}")


def edit(trees: DataFrame, path: str | None = None) -> DataFrame:
    """`trees` with a column edits, array<struct<at, cut, put>>, after these edits in order: the same
    columns without edits, and n_reencoded, the characters that were encoded again."""
    prepare(trees.sparkSession)
    file = path or default_file()

    def run(batches: Iterable[dict]) -> Iterator[dict]:
        count = counter(file)
        for b in batches:
            done = [TokenTree.stored(*x, count) for x in zip(b["texts"], b["chars"], b["tokens"])]
            for tree, edits in zip(done, b["edits"]):
                for e in edits or []:
                    if e is not None:
                        tree.edit(e["at"] or 0, e["cut"] or 0, e["put"] or "")
            yield {"doc_id": b["doc_id"], "n_reencoded": [t.encoded for t in done]} | {k: [getattr(t, k) for t in done] for k in ("texts", "chars", "tokens")}

    t = trees.select("doc_id", "texts", "chars", "tokens", "edits")
    return map_rows(t, run, f"doc_id {dict(trees.dtypes)['doc_id']}, {TREE}, n_reencoded long")


def root(trees: DataFrame, what: str = "tokens") -> Column:
    """Sum of a whole document."""
    return F.get(trees[what], F.lit(1)).cast("long")


def with_edits(docs: DataFrame, make: Callable[[Column, Column], Column], path: str | None = None) -> DataFrame:
    """Trees of `docs` (doc_id, text), kept as a table, and the edits that `make` gives for id and length:
    doc_id, n_tokens, n_tokens_edited, n_chars_edited and n_reencoded."""
    trees = written(plant(docs, path), "trees")
    e = trees.withColumn("edits", make(F.col("doc_id"), F.get("chars", F.lit(1))))
    # What was before travels in the id, as a struct, past the edit.
    e = e.withColumn("doc_id", F.struct("doc_id", root(trees).alias("n")))
    out = edit(e, path)
    return out.select("doc_id.doc_id", F.col("doc_id.n").alias("n_tokens"), root(out).alias("n_tokens_edited"), root(out, "chars").alias("n_chars_edited"), "n_reencoded")


def sample_edits(doc_id: Column, size: Column) -> Column:
    """Three edits that depend on the row alone: an insertion, a deletion and a new ending."""
    place = lambda seed: F.pmod(F.xxhash64(doc_id, F.lit(seed)), (size + 1).cast("long")).cast("int")
    edit = lambda at, cut, put: F.struct(at.alias("at"), F.lit(cut).alias("cut"), F.lit(put).alias("put"))
    return F.array(edit(place(1), 0, " see note 7"), edit(place(2), 24, ""), edit(F.greatest(size - 5, F.lit(0)), 9, "...  The end.\n"))
