"""URL rules and glob lists in one bit-parallel automaton.

Every pattern takes a stretch of bits, one per literal byte and one to start from, packed into 64-bit words. All patterns
over all URLs of a slice advance together, one byte at a time: shift the states, keep those whose byte fits, and hold
those that stand before a `*`. The canonical URL is host, a zero byte, path; other bytes outside printable ASCII are
percent-encoded, so the zero byte is the one border and `*` does not cross it.

A rule (host, path) fits its host and all subdomains if the path starts with the rule's; of several the longest wins, then
the first listed. Where no rule fits, a page is blocked if a block glob matches, else allowed.

Defined cases: null urls and urls without `://` have an empty host and path and are judged like any other; repeated rows
are judged each; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hourloom.llm.arrow import map_texts, texts

_HOST, _PATH, _UNSAFE = re.compile(r"[^/?#]*"), re.compile(r"[^?#]*"), re.compile(rb"[^\x21-\x7e]")
SCHEMA = "page_id bigint, host string, path string, rule string, verdict string, pattern string"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Glob:
    """`*`: any run of bytes within the host or the path; `?`: any one byte."""

    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host} {self.path}"


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)
BLOCKED = (
    Glob("m.*", "*"),
    Glob("ads.*", "*"),
    Glob("*casino*", "*"),
    Glob("*", "*/login*"),
    Glob("*", "*/ads/*"),
    Glob("*", "*.exe"),
    Glob("*", "*.zip"),
)


def host_and_path(url: str | None) -> tuple[str, str]:
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    host = _HOST.match(rest).group()
    return host.encode().lower().decode(), _PATH.match(rest, len(host)).group()


def canonical(part: str) -> bytes:
    return _UNSAFE.sub(lambda m: b"%%%02X" % m.group()[0], part.encode())


_ANY, _RUN = object(), object()


def _globbed(text: str) -> list:
    return [_RUN if c == "*" else _ANY if c == "?" else b for c in text for b in ([c] if c in "*?" else canonical(c))]


class WildcardAutomaton:
    """Patterns are lists of bytes, `_ANY` and `_RUN`; `matches` tells which of them fit each subject whole."""

    def __init__(self, patterns: list[list]):
        bits = sum(1 + sum(x is not _RUN for x in p) for p in patterns)
        self.size = max(1, -(-bits // 64))
        fits, holds, start = [np.zeros((256, bits), bool) for _ in range(2)] + [np.zeros(bits, bool)]
        self.last, at = [], 0
        for pattern in patterns:
            start[at] = True
            for item in pattern:
                if item is _RUN:
                    holds[1:, at] = True
                    continue
                at += 1
                if item is _ANY:
                    fits[1:, at] = True
                else:
                    fits[item, at] = True
            self.last.append(at)
            at += 1
        self.fits, self.holds = self._packed(fits), self._packed(holds)
        self.start = self._packed(start[None])[0]

    def _packed(self, rows: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(rows), 64 * self.size), dtype=bool)
        wide[:, : rows.shape[1]] = rows
        return np.packbits(wide, axis=1, bitorder="little").view("<u8").astype(np.uint64)

    def matches(self, subjects: list[bytes]) -> np.ndarray:
        lengths = np.array([len(s) for s in subjects], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(subjects), dtype=np.uint8)
        begin = (np.cumsum(lengths) - lengths)[order]
        state = np.repeat(self.start[None], len(subjects), axis=0)
        longest_first = lengths[order]
        live, one, top = len(subjects), np.uint64(1), np.uint64(63)
        for step in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-longest_first[:live], -step, "left"))
            now, byte = state[:live], data[begin[:live] + step]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = (moved & self.fits[byte]) | (now & self.holds[byte])
        out = np.zeros((len(subjects), len(self.last)), dtype=bool)
        for k, bit in enumerate(self.last):
            out[order, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & one != 0
        return out


class UrlJudge:
    def __init__(self, rules: tuple[Rule, ...] = RULES, blocked: tuple[Glob, ...] = BLOCKED):
        self.rules = sorted(rules, key=lambda r: -len(r.name))
        self.blocked = blocked
        patterns = []
        for r in self.rules:
            own = [*canonical(r.host), 0, *canonical(r.path), _RUN]
            patterns += [own, [_RUN, ord("."), *own]]
        patterns += [[*_globbed(g.host), 0, *_globbed(g.path)] for g in blocked]
        self.automaton = WildcardAutomaton(patterns)

    def judge(self, urls: list[str | None]) -> list[tuple]:
        """(host, path, rule, verdict, pattern) of each url."""
        parts = [host_and_path(u) for u in urls]
        hits = self.automaton.matches([canonical(h) + b"\0" + canonical(p) for h, p in parts])
        n = 2 * len(self.rules)
        fitting = hits[:, 0:n:2] | hits[:, 1:n:2]
        globs = hits[:, n:]
        out = []
        for (host, path), rule, any_rule, glob, any_glob in zip(
            parts, _first(fitting), fitting.any(axis=1).tolist(), _first(globs), globs.any(axis=1).tolist()
        ):
            chosen = self.rules[rule] if any_rule else None
            pattern = self.blocked[glob].name if any_glob else None
            verdict = chosen.verdict if chosen else "block" if any_glob else "allow"
            out.append((host, path, chosen.name if chosen else None, verdict, pattern))
        return out


def _first(hits: np.ndarray) -> list[int]:
    return hits.argmax(axis=1).tolist() if hits.shape[1] else [0] * len(hits)


def judge_pages(pages: DataFrame, rules: tuple[Rule, ...] = RULES, blocked: tuple[Glob, ...] = BLOCKED, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) of every page."""

    def make():
        judge = UrlJudge(rules, blocked)

        def apply(piece):
            columns = list(zip(*judge.judge(texts(piece, 1)))) or [()] * 5
            return pa.RecordBatch.from_arrays(
                [piece.column(0), *[pa.array(c, pa.string()) for c in columns]], names=["page_id", "host", "path", "rule", "verdict", "pattern"]
            )

        return apply

    return map_texts(pages, [page_id], url, SCHEMA, make)
