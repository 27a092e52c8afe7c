"""URL filters by a bit-parallel wildcard automaton.

Glob rules are packed one after another into multiword Shift-And masks (after Navarro and
Raffinot's extended patterns): bit i of a rule says that its first i items have matched.  `B[c]`
has the bits whose item accepts character class c, `L[c]` those behind which a star may take c.
All rules are simulated at once over every canonical URL, and the URLs of a batch move in step:
one NumPy operation advances all of them by a character.

A glob is matched against the whole of `.host/path`: `*` stands for any run of characters but
`/`, `**` for any run, `?` for one character but `/`.  Of the rules that match, the longest wins
(host and path rules before globs), ties to the earlier one; a URL that none matches gets
`default`.

Null url or one without `://`: host and path are empty, no rule fits, verdict `default`.
Repeated rows get the same verdict.  Columns but page_id and url are not read.  URLs of any
length are read; those of a batch are taken by length, so that a long one delays no other.
The rule set is a parameter; its masks take `classes x words` machine words on each worker.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows, prepare


@dataclass(frozen=True)
class Rule:
    verdict: str
    glob: str
    #: What the result names; null for the method's own globs.
    name: str | None = None
    weight: int = 0


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """A host with all its subdomains, and a path prefix."""
    return Rule(verdict, f"*.{host}{path}**", host + path, 1_000_000 + len(host) + len(path))


def glob_rule(verdict: str, glob: str) -> Rule:
    return Rule(verdict, glob, None, len(glob))


#: The rules of the contract.
HOST_RULES = (
    host_rule("allow", "org", "/"),
    host_rule("block", "example.org", "/es/"),
    host_rule("block", "example.org", "/en/1"),
    host_rule("allow", "com", "/fr/"),
    host_rule("block", "com", "/de/"),
)
#: The method's own: host labels and paths of sites kept out of training corpora.
GLOB_RULES = tuple(
    glob_rule("block", g)
    for g in (
        "*.spam-*.*/**", "*.adult-*.*/**", "*.casino-*.*/**", "*.free-bets.*/**", "*.free-bets-*.*/**", "*.ads-*.*/**", "*.adserver.*/**",
        "*.porn*/**", "*.xxx/**", "*.xxx.*/**", "*.poker-*.*/**", "**/wp-login.php", "**/cgi-bin/**", "**/login?", "**/signup",
    )
)


def canonical(url: str | None) -> tuple[str, str]:
    """Host, with A-Z lower-cased, and path."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((k for k in (rest.find("?"), rest.find("#")) if k >= 0), default=len(rest))
    rest = rest[:end]
    cut = rest.find("/")
    host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
    return host.translate(_LOWER), path


_LOWER = {c: c + 32 for c in range(65, 91)}


class ShiftAnd:
    """All globs of one rule list, packed into words of 64 bits."""

    def __init__(self, globs: list[str]) -> None:
        items: list[list[tuple[str, str]]] = []  # per glob: (item, star behind it)
        lead: list[str] = []
        for g in globs:
            row, first, k = [], "", 0
            while k < len(g):
                if g[k] == "*":
                    star = "**" if g[k : k + 2] == "**" else "*"
                    k += len(star)
                    if row:
                        row[-1] = (row[-1][0], max(row[-1][1], star))
                    else:
                        first = max(first, star)
                else:
                    row.append((g[k], ""))
                    k += 1
            items.append(row)
            lead.append(first)
        chars = sorted({c for row in items for c, _ in row if c != "?"} | {"/"})
        self.classes = {c: i + 1 for i, c in enumerate(chars)}  # 0: any other character
        self.slash = self.classes["/"]
        bits = sum(len(r) + 1 for r in items)
        self.words = max(1, -(-bits // 64))
        n = len(chars) + 1
        take, loop = np.zeros((n, self.words * 64), bool), np.zeros((n, self.words * 64), bool)
        start, self.final, at = np.zeros(self.words * 64, bool), [], 0
        for row, first in zip(items, lead):
            start[at] = True
            for k, (c, star) in enumerate([("", first), *row]):
                if c == "?":
                    take[:, at + k] = True
                    take[self.slash, at + k] = False
                elif c:
                    take[self.classes[c], at + k] = True
                if star:
                    loop[:, at + k] = True
                    loop[self.slash, at + k] = star == "**"
            at += len(row) + 1
            self.final.append(at - 1)
        pack = lambda x: np.packbits(x, axis=-1, bitorder="little").view("<u8").astype(np.uint64)
        # A shift never enters a rule's first bit from its neighbour: no item stands there, so B lacks it.
        self.B, self.L, self.start = pack(take), pack(loop), pack(start)

    def classify(self, text: str) -> np.ndarray:
        get = self.classes.get
        return np.array([get(c, 0) for c in text], np.uint16)

    def run(self, texts: list[str]) -> np.ndarray:
        """(texts, globs) matrix of whole matches."""
        out = np.zeros((len(texts), len(self.final)), bool)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        for lo in range(0, len(order), 2048):
            part = order[lo : lo + 2048]
            lens = np.array([len(texts[i]) for i in part])
            state = np.tile(self.start, (len(part), 1))
            longest = int(lens[-1]) if len(part) else 0
            for base in range(0, longest, 512):  # classes of 512 places at a time
                alive = int(np.searchsorted(lens, base, side="right"))
                rows = [self.classify(texts[i][base : base + 512]) for i in part[alive:]]
                width = max((len(r) for r in rows), default=0)
                grid = np.zeros((len(rows), width), np.uint16)
                for k, r in enumerate(rows):
                    grid[k, : len(r)] = r
                for j in range(width):
                    k = int(np.searchsorted(lens, base + j, side="right"))  # shorter ones are done
                    c, s = grid[k - alive :, j], state[k:]
                    moved = s << np.uint64(1)
                    moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
                    state[k:] = (moved & self.B[c]) | (s & self.L[c])
            for g, bit in enumerate(self.final):
                out[part, g] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1
        return out


def judge(urls: list[str | None], rules: list[Rule], automaton: ShiftAnd, default: str) -> list[tuple[str, str, str | None, str]]:
    parts = [canonical(u) for u in urls]
    whole = [("." + h + p) if h or p else "" for h, p in parts]
    order = sorted(range(len(rules)), key=lambda k: -rules[k].weight)  # stable: ties to the earlier
    hits = automaton.run(whole)[:, order]
    first = hits.argmax(1) if len(rules) else np.zeros(len(urls), int)
    out = []
    for i, (h, p) in enumerate(parts):
        r = rules[order[first[i]]] if len(rules) and hits[i, first[i]] else None
        out.append((h, p, r.name if r else None, r.verdict if r else default))
    return out


def url_filter(pages: DataFrame, rules: tuple[Rule, ...] = HOST_RULES + GLOB_RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row."""
    prepare(pages.sparkSession)
    listed = list(rules)

    def run(batches: Iterable[dict]) -> Iterator[dict]:
        automaton = ShiftAnd([r.glob for r in listed])
        for b in batches:
            d = judge(b["url"], listed, automaton, default)
            yield {"page_id": b["page_id"]} | {k: [x[i] for x in d] for i, k in enumerate(("host", "path", "rule", "verdict"))}

    kind = dict(pages.dtypes)["page_id"]
    return map_rows(pages.select("page_id", "url"), run, f"page_id {kind}, host string, path string, rule string, verdict string")
