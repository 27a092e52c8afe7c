"""BPE encoding and decoding by a tokenization automaton (after Berglund, Martens and
van der Merwe 2024).

The automaton starts as one state with an arc to itself for every base symbol.  The merges are
compiled in order: the gadget of a merge (u, v) -> w redirects the arcs labelled u to a state
that lacks the arc v, and gives every state with a path u, v an arc w past it.  The finished
automaton accepts exactly the token sequences that BPE gives, so every prefix of a pre-split
word has one accepted path.

Arcs labelled u always lead to one and the same state, so a state is stored as its parent,
the time of its copying and the arcs it lost.  A word is read symbol by symbol through a table of
transitions, (row, symbol) -> row.  A row stands for the longest token's beginning that ends what
has been read, so there are no more rows than beginnings of tokens, however many words come.  The
last token of the only path is the longest of the tokens that end there whose arc the state before
it has, by a table of arcs; there is no search, and the tokens of the word are the last tokens of
the symbols passed, from the end backwards.  Rows and arcs are taken from the automaton when first
asked; both tables are bounded in bytes, and at its bound a table is emptied and filled anew.
Every distinct word goes through the table, tokens of the vocabulary too.  The distinct words of a
group of texts go together, one symbol of all at a time; a single text goes word by word, and what
a word gave is kept for its repetitions, bounded in bytes as well.  Decoding emits the labels of
the arcs named by the ids.

Null and empty texts have no tokens.  Special tokens in a text are found before anything else,
as the library does.  Texts of any length are worked through word by word.  Repeated rows give
equal rows; an empty table gives an empty result.  Columns but doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows, prepare

#: Bytes of the tables of transitions, of arcs and of words at most, by an estimate that errs on the
#: high side; a full word table becomes the older of two.
TABLE_BYTES, ARC_BYTES, WORD_BYTES = 96 << 20, 32 << 20, 48 << 20
#: Texts of these characters only are normalised and split by Python's own functions: below
#: U+0180 every character is in normal form C, and its class is the same in every Unicode version.
PLAIN_END = 0x180
#: Words with other characters go to the library in one piece if no more characters lie between them.
NEAR = 32
#: Words that are moved through the table together, in bytes each at most; longer ones go alone.
TOGETHER, LONGEST = 8192, 64
#: Slots of the table of arcs that many words ask at once; each holds the arc asked last.
SLOTS = 1 << 20
#: Characters of the texts whose distinct words are encoded together; a longer text goes word by word.
GROUP = 4 << 20


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Automaton:
    """States are numbers.  `to[t]` is where arcs labelled with token t lead.  `end` marks the last
    symbol of a word in labels."""

    def __init__(self, base: list[str], merges: list[tuple[str, str]], end: str = "") -> None:
        self.labels = list(base)
        at = {s: i for i, s in enumerate(base)}
        self.parts: list[tuple[int, int] | None] = [None] * len(base)  # u, v of a merged token
        self.born = [-1] * len(base)
        self.to = [0] * len(base)
        self.parent, self.copied, self.lost = [-1], [0], [{}]
        users = [len(base) + 1]  # arcs that lead to a state; the start state is in use anyway
        for time, (a, b) in enumerate(merges, 1):
            u, v = at.get(a), at.get(b)
            if u is None or v is None or not self._has(self.to[u], v, time):
                continue  # no path u, v: an earlier merge always breaks it
            if a + b in at:
                raise ValueError(f"two merges give {a + b!r}")
            w, old, past = len(self.labels), self.to[u], self.to[v]
            if users[old] > 1 or u == v:
                users[old] -= 1
                self.to[u] = len(self.parent)
                self.parent.append(old), self.copied.append(time), self.lost.append({}), users.append(1)
            self.lost[self.to[u]][v] = time
            at[a + b] = w
            self.labels.append(a + b), self.parts.append((u, v)), self.born.append(time), self.to.append(past)
            users[past] += 1
        self.time = len(merges) + 1
        self.arcs: dict[int, bool] = {}
        self._spell(end)
        self._empty()

    def _spell(self, end: str) -> None:
        """Tree of the spellings of all tokens.  A symbol is a number, even within a word and odd at its end."""
        self.symbols: dict[str, int] = {}
        self.child: dict[int, int] = {}
        self.pairs, self.token, self.above, self.shorter = [], [-1], [0], [0]
        for t, label in enumerate(self.labels):
            final = bool(end) and label.endswith(end)
            chars, node = label[: len(label) - len(end)] if final else label, 0
            self.pairs.append((t, len(chars)))
            for k, c in enumerate(chars):
                key = node << 16 | 2 * self.symbols.setdefault(c, len(self.symbols)) | (final and k == len(chars) - 1)
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1), self.above.append(key), self.shorter.append(-1)
                node = self.child[key]
            if node:
                self.token[node] = t
        self.width = 2 * len(self.symbols)
        self.lengths, self.states = np.array([n for _, n in self.pairs], np.int32), np.array(self.to, np.int64)
        self.slots = np.full(SLOTS, -1, np.int64)
        ends = [0] * len(self.labels)
        for node, t in enumerate(self.token):
            if t >= 0:
                ends[t] = node
        self.next = [self._ending(self._shorter(node)) for node in ends]
        self.nexts = np.array(self.next, np.int32)
        self.ends = bool(end)
        self.even = {c: 2 * k for c, k in self.symbols.items()}

    def _empty(self) -> None:
        """A table with the row of the root only.  Memory is taken by the rows that are filled."""
        most = TABLE_BYTES // (4 * self.width) + 2 * TOGETHER + 2
        self.rows: list[int] = []
        self.table: dict[int, int] = {}
        self.move, self.ending = np.empty((most, self.width), np.int32), np.empty(most, np.int32)
        self.moves, self.endings = memoryview(self.move.reshape(-1)), memoryview(self.ending)
        self.size = 0
        self._row(0)

    def _row(self, node: int) -> int:
        """The row of a node, without transitions if it is new."""
        row = self.table.get(node)
        if row is None:
            row = self.table[node] = len(self.rows)
            self.rows.append(node)
            self.move[row] = -1
            self.ending[row] = self._ending(node)
            self.size += 4 * self.width + 250
        return row

    def _has(self, state: int, token: int, time: int) -> bool:
        """Whether `state` has the arc `token` once the merges up to this time are compiled."""
        while True:
            lost = self.lost[state].get(token)
            if lost is not None and lost <= time:
                return False
            if self.born[token] >= self.copied[state]:  # an arc made while the state existed: as its first part was then
                time, token = self.born[token], self.parts[token][0]
            elif self.parent[state] < 0:
                return True
            else:
                time, state = self.copied[state], self.parent[state]

    def has(self, key: int) -> bool:
        """Whether the finished state key >> 24 has the arc labelled with the token in the lower bits."""
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) * 110 > ARC_BYTES - 8 * SLOTS:
                self.arcs.clear()
            found = self.arcs[key] = self._has(key >> 24, key & 0xFFFFFF, self.time)
        return found

    def _have(self, keys: np.ndarray) -> np.ndarray:
        """`has` of many keys."""
        slot = (keys * 0x9E3779B97F4A7C1 >> 24) & (SLOTS - 1)
        got = self.slots[slot]
        miss = np.flatnonzero(got >> 1 != keys)
        if len(miss):
            asked, which = np.unique(keys[miss], return_inverse=True)
            new = asked << 1 | np.fromiter(map(self.has, asked.tolist()), np.int64, len(asked))
            got[miss] = new[which]
            self.slots[slot[miss]] = got[miss]
        return (got & 1).astype(bool)

    def _ending(self, node: int) -> int:
        """The longest token that ends at a node, -1 if none does."""
        while node and self.token[node] < 0:
            node = self._shorter(node)
        return self.token[node]

    def _step(self, node: int, symbol: int) -> int:
        """The node of the longest spelling that ends what was read, read on by one symbol."""
        while True:
            to = self.child.get(node << 16 | symbol)
            if to is not None or not node:
                return to or 0
            node = self._shorter(node)

    def _shorter(self, node: int) -> int:
        """The node of the longest spelling that properly ends the one of `node`."""
        chain = []
        while self.shorter[node] < 0:
            chain.append(node)
            node = self.above[node] >> 16
        for node in reversed(chain):
            parent, symbol = self.above[node] >> 16, self.above[node] & 0xFFFF
            self.shorter[node] = self._step(self.shorter[parent], symbol) if parent else 0
        return self.shorter[node]

    def _compile(self, row: int, symbol: int) -> int:
        """Enter a transition in the table."""
        to = self.move[row, symbol] = self._row(self._step(self.rows[row], symbol))
        return int(to)

    def spell(self, word: str) -> list[int]:
        """The symbols of a word."""
        even = self.even
        s = [even[c] for c in word]
        s[-1] += self.ends
        return s

    def encode(self, word: str) -> list[int]:
        """Labels' numbers on the only path that spells `word`, which is not empty."""
        row, states, path = 0, [0], []
        moves, endings, width, pairs, to, arcs = self.moves, self.endings, self.width, self.pairs, self.to, self.arcs
        for symbol in self.spell(word):
            found = moves[row * width + symbol]
            if found < 0:
                if self.size > TABLE_BYTES:
                    node = self.rows[row]
                    self._empty()
                    moves, endings, row = self.moves, self.endings, self._row(node)
                found = self._compile(row, symbol)
            row, t = found, endings[found]
            while t >= 0:
                length = pairs[t][1]
                key = states[-length] << 24 | t
                if arcs.get(key) or self.has(key):
                    break  # the only path: no shorter token gives another
                t = self.next[t]
            else:
                raise ValueError("no path spells this word")
            states.append(to[t])
            path.append(t)
        out, at = [], len(path)
        while at:
            t = path[at - 1]
            out.append(t)
            at -= pairs[t][1]
        out.reverse()
        return out

    def encode_all(self, spelt: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for many words, each of one symbol at least and not long: `spelt` are the symbols of
        all (even ones), `lengths` how many each has.  All labels' numbers and how many each word has."""
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        counts, parts = np.zeros(len(lengths), np.int64), []
        for k in range(0, len(order), TOGETHER):
            which = order[k : k + TOGETHER]
            path = self._paths(spelt, starts[which], lengths[which])
            at, left, column, n = lengths[which], which, np.arange(len(which)), 0
            while len(left):  # from the ends backwards
                t = path[at - 1, column]
                n += 1
                counts[left] = n
                parts.append((left, n, t))
                at = at - self.lengths[t]
                on = at > 0
                at, left, column = at[on], left[on], column[on]
        ends = np.cumsum(counts)
        out = np.empty(int(counts.sum()), np.int32)
        for left, n, t in parts:
            out[ends[left] - n] = t
        return out, counts

    def _paths(self, spelt: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """By symbols read and word the last token on the only path; longer words come first."""
        n, most = len(starts), int(lengths[0])
        path, states = np.empty((most, n), np.int32), np.zeros((most + 1, n), np.int64)
        column, row = np.arange(n), np.zeros(n, np.int32)
        for p in range(most):
            m = int(np.searchsorted(-lengths, -p))
            if self.size + TOGETHER * (4 * self.width + 250) > TABLE_BYTES:
                nodes, back = np.unique(np.array(self.rows)[row[:m]], return_inverse=True)
                self._empty()
                row = np.array([self._row(x) for x in nodes.tolist()], np.int32)[back]
            symbol = spelt[starts[:m] + p] + (self.ends & (lengths[:m] == p + 1))
            to = self.move[row[:m], symbol]
            miss = np.flatnonzero(to < 0)
            if len(miss):
                pairs, back = np.unique(row[miss].astype(np.int64) * self.width + symbol[miss], return_inverse=True)
                to[miss] = np.array([self._compile(*divmod(x, self.width)) for x in pairs.tolist()], np.int32)[back]
            row, open_, t = to, column[:m], self.ending[to]
            while True:
                if (t < 0).any():
                    raise ValueError("no path spells this word")
                found = self._have(states[p + 1 - self.lengths[t], open_] << 24 | t)
                path[p, open_[found]] = t[found]
                open_, t = open_[~found], self.nexts[t[~found]]
                if not len(open_):
                    break
            states[p + 1, :m] = self.states[path[p, :m]]
        return path


class Known(dict):
    """A dictionary that makes what it lacks."""

    def __init__(self, make: Callable[[str], tuple[str, str]]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> tuple[str, str]:
        return self.make(key)


class Bpe:
    """A tokenizer file: normalise, split, encode by automaton; decode by labels."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = {a + b for a, b in merges}
        self.auto = Automaton([s for s in model["vocab"] if s not in made], merges, self.end)
        self.ids = [model["vocab"][s] for s in self.auto.labels]
        self.library = Tokenizer.from_file(path)
        self.strings = {i: s for s, i in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        direct = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in direct]
        self.bytes = {b: chr(b) for b in direct} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.odd = re.compile(f"[^\\x00-{chr(PLAIN_END - 1)}]")
        self.back = {ord(c): b for b, c in self.bytes.items()}
        kind = lambda k: "".join(re.escape(chr(c)) for c in range(PLAIN_END) if unicodedata.category(chr(c))[0] == k)
        white, letters, digits = "\\t-\\r \\x85\\xa0", kind("L"), kind("N")
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{white}{letters}{digits}]+").findall
        self.spelt = {b: c for b, c in self.bytes.items() if chr(b) != c}
        even = self.auto.even
        self.symbols = np.array([even.get(self.bytes[b], -1) for b in range(256)], np.int32)
        self.shown = [(str(i), self.strings[i]) for i in self.ids]
        self.known = Known(self.word)
        self.before: dict[str, tuple[str, str]] = {}
        self.known_size = 0

    def pieces(self, text: str) -> list[str]:
        """Normalised, pre-split words of a text without special tokens, in plain characters."""
        if text.isascii() or not self.odd.search(text):
            return self.split(text.lower())
        # Neither form C nor lower case nor a word reaches over a space, so the library gets what lies between two.
        out, at, found = [], 0, self.odd.search(text)
        while found:
            start = text.rfind(" ", at, found.start()) + 1 or at
            while found:
                end = text.find(" ", found.start())
                end = len(text) if end < 0 else end
                found = self.odd.search(text, end)
                if found and found.start() - end > NEAR:
                    break
            split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text[start:end]))
            out += self.split(text[at:start].lower())
            out += [s.translate(self.back).encode("latin-1").decode("utf-8", "replace") for s, _ in split]
            at = end
        return out + self.split(text[at:].lower())

    def word(self, word: str) -> tuple[str, str]:
        """Ids and decoded text of one pre-split word, each joined by spaces."""
        found = self.before.get(word)
        if found is None:
            spelt = word if word.isascii() and word.isprintable() else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.spelt)
            tokens = self.auto.encode(spelt)
            shown = self.shown
            if len(tokens) == 1:
                found = shown[tokens[0]]
            else:
                found = (" ".join([shown[t][0] for t in tokens]), " ".join([shown[t][1] for t in tokens]))
        cost = 400 + 4 * len(word) + len(found[0]) + 4 * len(found[1])
        if cost * 8 > WORD_BYTES:
            return found
        if self.known_size + cost > WORD_BYTES // 2:
            self.before = dict(self.known)
            self.known.clear()
            self.known_size = 0
        self.known[word] = found
        self.known_size += cost
        return found

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for s, _ in self._words(text) for x in s.split(" ")]

    def decode(self, ids: Iterable[int]) -> str:
        """Arc labels, joined as the library joins tokens where the file names no decoder."""
        return " ".join([self.strings[i] for i in ids])

    def _words(self, text: str | None) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        parts = self.cut.split(text or "") if self.cut else [text or ""]
        for part in parts:
            if part in self.special:
                out.append((str(self.special[part]), part))
            elif part:
                out += map(self.known.__getitem__, self.pieces(part))
        return out

    def digests(self, text: str | None) -> tuple[int, str, str]:
        w = self._words(text)
        return self._shown(*(" ".join(map(itemgetter(k), w)) for k in (0, 1)))

    @staticmethod
    def _shown(ids: str, decoded: str) -> tuple[int, str, str]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        return ids.count(" ") + bool(ids), sha(ids), sha(decoded)


    def digests_of(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """`digests` of each text; the distinct words of some texts are encoded together."""
        group, size = [], 0
        for text in texts:
            if size + len(text or "") > GROUP:
                yield from self._digests_of(group)
                group, size = [], 0
            group.append(text)
            size += len(text or "")
        yield from self._digests_of(group)

    def _digests_of(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        if len(texts) == 1:
            yield self.digests(texts[0])
            return
        split: list[list] = []
        for text in texts:
            words: list = []
            for part in self.cut.split(text or "") if self.cut else [text or ""]:
                if part in self.special:
                    words.append((part,))  # a tuple, so it is no word
                elif part:
                    words += self.pieces(part)
            split.append(words)
        ids: dict = {}
        for words in split:
            ids.update(dict.fromkeys(words))
        decoded = dict(ids)
        plain, flat = [], []
        for w in ids:
            if isinstance(w, tuple):
                ids[w], decoded[w] = str(self.special[w[0]]), w[0]
                continue
            b = w.encode("utf-8", "surrogatepass")
            if len(b) > LONGEST:
                ids[w], decoded[w] = self.word(w)
            else:
                plain.append(w)
                flat.append(b)
        if plain:
            spelt = self.symbols[np.frombuffer(b"".join(flat), np.uint8)]
            tokens, counts = self.auto.encode_all(spelt, np.fromiter(map(len, flat), np.int64, len(flat)))
            number, label = [x for x, _ in self.shown], [x for _, x in self.shown]
            tokens, at = tokens.tolist(), 0
            for w, n in zip(plain, counts.tolist()):
                t = tokens[at : at + n]
                at += n
                ids[w] = " ".join([number[x] for x in t])
                decoded[w] = " ".join([label[x] for x in t])
        for words in split:
            yield self._shown(" ".join(map(ids.__getitem__, words)), " ".join(map(decoded.__getitem__, words)))


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row."""
    prepare(docs.sparkSession)
    file = path or default_file()

    def run(batches: Iterable[dict]) -> Iterator[dict]:
        bpe = load(file)
        for b in batches:
            d = list(bpe.digests_of(b["text"]))
            yield {"doc_id": b["doc_id"], "n_tokens": [x[0] for x in d], "ids_sha256": [x[1] for x in d], "decoded_sha256": [x[2] for x in d]}

    kind = dict(docs.dtypes)["doc_id"]
    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the token ids themselves."""
    prepare(docs.sparkSession)
    file = path or default_file()

    def run(batches: Iterable[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b["doc_id"], "ids": [load(file).encode(t) for t in b["text"]]}

    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text decoded from `ids`; null ids give a null text."""
    prepare(tokens.sparkSession)
    file = path or default_file()

    def run(batches: Iterable[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b["doc_id"], "text": [None if x is None else load(file).decode(x) for x in b["ids"]]}

    return map_rows(tokens.select("doc_id", "ids"), run, f"doc_id {dict(tokens.dtypes)['doc_id']}, text string")
