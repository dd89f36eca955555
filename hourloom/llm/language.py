"""Language by cross-parsing: the language whose labelled text needs the fewest phrases to copy a text from wins.

A suffix automaton over labelled text of each language gives the longest match at every place. A text is parsed from left
to right into phrases, each the longest string that occurs in the language's text (or one letter that does not occur at
all); their number times log2 of the language's length, per letter, estimates the cross entropy. Texts are parsed whole,
as letters: A-Z and other letters in lower case, runs of anything else as one space. Texts are parsed in blocks of
`BLOCK` letters side by side, a phrase ending at the end of its block.

The score is the winner's share in a softmax over the negative entropies, with a steepness fitted on sampled documents
that are in no automaton.

What is learned is bounded by `LanguageBound`; scoring reads every whole text. Automata are rebuilt on the workers from the
sampled text.

Defined cases: null texts and texts without a letter are `und` with score 0, and so is every text if nothing was learned;
ties go to the language of the smaller name; with a single language the score is 1; rows without a doc_id or lang are not
learned from; repeated rows are scored each; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.llm.arrow import map_texts, texts
from hourloom.llm.training import fit_in_one_task

UNKNOWN = "und"
BLOCK = 2048
STEEPNESS = np.geomspace(0.25, 64.0, 33)


@dataclass(frozen=True)
class LanguageBound:
    """Of each of at most `languages` languages (the most frequent), `documents` of at most `max_bytes`.

    An automaton holds `letters` of them, and fewer where all tables together would hold over `table_entries`.
    """

    languages: int = 200
    documents: int = 300
    max_bytes: int = 16_384
    letters: int = 49_152
    alphabet: int = 160
    table_entries: int = 1 << 26


def _letter_table() -> np.ndarray:
    """For every code point below the surrogates its lower-case letter, or a space."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for point in range(0x110000):
        if chr(point).isalpha():
            low = chr(point).lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return _letter_table()


def letters(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts one after the other, runs of others as one space and none at the ends; and their bounds."""
    sizes = np.array([len(t) for t in values], dtype=np.int64)
    points = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    folded = letter_table()[points]
    ends = np.cumsum(sizes)
    begins = np.zeros(len(folded) + 1, dtype=bool)
    begins[ends - sizes] = True
    solid = folded != 32
    after_letter = np.zeros(len(folded), dtype=bool)
    after_letter[1:] = solid[:-1]
    next_letter = np.append(np.flatnonzero(solid), len(folded))[np.cumsum(solid)]
    # A space stays if it stands directly behind a letter and another letter of its text follows.
    keep = solid | (after_letter & ~begins[:-1] & (next_letter < np.repeat(ends, sizes)))
    kept = np.concatenate([[0], np.cumsum(keep)])
    return folded[keep], np.concatenate([[0], kept[ends]])


class SuffixAutomaton:
    """Suffix automaton of one string of codes 1..; a dense table with parsing built in.

    `steps[state, code]` is the next state, or, where the longest match ends, minus the state that the code alone leads to.
    """

    def __init__(self, codes: list[int], alphabet: int):
        after, link, length, last = [{}], [-1], [0], 0
        for c in codes:
            state = len(after)
            after.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in after[p]:
                after[p][c] = state
                p = link[p]
            if p >= 0:
                q = after[p][c]
                if length[q] == length[p] + 1:
                    link[state] = q
                else:
                    copy = len(after)
                    after.append(dict(after[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and after[p].get(c) == q:
                        after[p][c] = copy
                        p = link[p]
                    link[q] = link[state] = copy
            last = state
        root = np.zeros(alphabet, dtype=np.int32)
        for c, s in after[0].items():
            root[c] = s
        # State 0 has no code behind it, so a phrase that starts with an unknown code is told apart by state `unknown`.
        self.unknown = len(after)
        start = -np.where(root > 0, root, self.unknown).astype(np.int32)
        self.steps = np.tile(start, (len(after) + 1, 1))
        states = np.repeat(np.arange(len(after)), [len(a) for a in after])
        self.steps[states, np.array([c for a in after for c in a], dtype=np.int64)] = [s for a in after for s in a.values()]
        # The first phrase of a text starts at state 0 and is counted there.
        self.steps[0] = -np.abs(self.steps[0])
        self.bits = float(np.log2(max(2, len(codes))))


class Parsers:
    """All languages' automata in one table, so that texts are parsed for every language side by side.

    States are kept as places of their rows in the table.
    """

    def __init__(self, automata: list[SuffixAutomaton]):
        width = automata[0].steps.shape[1]
        rows = np.cumsum([0, *(len(a.steps) for a in automata)])
        tables = [np.where(a.steps < 0, a.steps - r, a.steps + r) * width for a, r in zip(automata, rows)]
        self.table = np.concatenate([t.astype(np.int32).ravel() for t in tables])
        self.roots = (rows[:-1] * width).astype(np.int32)
        self.bits = np.array([a.bits for a in automata])

    def phrases(self, codes: np.ndarray, low: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(block, language): phrases of every block codes[low:low + size]; `sizes` must fall."""
        states = np.repeat(self.roots[:, None], len(low), axis=1)
        phrases = np.zeros(states.shape, dtype=np.int32)
        longest = int(sizes[0]) if len(sizes) else 0
        alive = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
        for i, n in enumerate(alive.tolist()):
            if n < states.shape[1]:
                states = states[:, :n].copy()
            found = self.table.take(states + codes[low[:n] + i])
            phrases[:, :n] += found < 0
            states = np.abs(found)
        return phrases.T


def phrase_counts(parsers: Parsers, codes: np.ndarray, bounds: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """(text, language): phrases of every text codes[bounds[t]:bounds[t + 1]]."""
    sizes = np.diff(bounds)
    blocks = -(-sizes // block)
    row = np.repeat(np.arange(len(sizes)), blocks)
    number = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = bounds[:-1][row] + number * block
    length = np.minimum(block, bounds[1:][row] - low)
    order = np.argsort(-length, kind="stable")
    out = np.zeros((len(sizes), len(parsers.bits)), dtype=np.int64)
    np.add.at(out, row[order], parsers.phrases(codes, low[order], length[order]))
    return out


@dataclass(frozen=True)
class LanguageModel:
    """Learned languages by name, their sampled letters, the alphabet in code order, and the steepness of the score."""

    names: tuple[str, ...]
    samples: tuple[str, ...]
    alphabet: str
    steepness: float = 8.0

    def codes(self, points: np.ndarray) -> np.ndarray:
        """1, 2, ... for the alphabet, 0 for other letters."""
        table = np.zeros(0x110000, dtype=np.int32)
        table[[ord(c) for c in self.alphabet]] = np.arange(1, len(self.alphabet) + 1)
        return table[points]

    def parsers(self) -> Parsers:
        own = [self.codes(np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32)).tolist() for s in self.samples]
        return Parsers([SuffixAutomaton(s, len(self.alphabet) + 1) for s in own])


@lru_cache(maxsize=1)
def _built(names: tuple, samples: tuple, alphabet: str) -> Parsers:
    return LanguageModel(names, samples, alphabet).parsers()


def entropies(model: LanguageModel, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, language) bits per letter by cross-parsing, and the number of letters of each text."""
    parsers = _built(model.names, model.samples, model.alphabet)
    points, bounds = letters(values)
    counts = phrase_counts(parsers, model.codes(points), bounds)
    sizes = np.diff(bounds)
    return counts * parsers.bits / np.maximum(sizes, 1)[:, None], sizes


def shares(bits: np.ndarray, steepness: float) -> np.ndarray:
    raised = np.exp(-steepness * (bits - bits.min(axis=1, keepdims=True)))
    return raised / raised.sum(axis=1, keepdims=True)


def judge(model: LanguageModel, values: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and score of every text."""
    if not model.names:
        return [UNKNOWN] * len(values), np.zeros(len(values))
    bits, sizes = entropies(model, values)
    best = bits.argmin(axis=1)
    share = shares(bits, model.steepness)[np.arange(len(values)), best]
    known = sizes > 0
    return [model.names[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, share, 0.0)


def fit_model(rows: list[dict], bound: LanguageBound = LanguageBound()) -> LanguageModel:
    """`rows` hold lang, text and order; every fifth document of a language sets the steepness, the others fill its automaton."""
    by_lang: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["order"], r["text"])):
        by_lang.setdefault(r["lang"], []).append(r["text"])
    names, samples, held, truth = [], [], [], []
    for name, own in by_lang.items():
        points, _ = letters(["\n".join(t for i, t in enumerate(own) if i % 5 or len(own) < 5)])
        if len(points):
            names.append(name)
            samples.append(points[: bound.letters].tobytes().decode("utf-32-le"))
            held += own[::5]
            truth += [len(names) - 1] * len(own[::5])
    # An automaton has at most two states for a letter.
    room = bound.table_entries // (2 * (bound.alphabet + 1) * max(1, len(names)))
    samples = [t[: max(1, room)] for t in samples]
    counts: dict[str, int] = {}
    for s in samples:
        for c in s:
            counts[c] = counts.get(c, 0) + 1
    alphabet = "".join(sorted(counts, key=lambda c: (-counts[c], c))[: bound.alphabet])
    model = LanguageModel(tuple(names), tuple(samples), alphabet)
    if len(names) < 2:
        return model
    bits, sizes = entropies(model, held)
    use = sizes > 0
    loss = [-np.log(np.maximum(1e-12, shares(bits, b)[np.arange(len(held)), truth]))[use].mean() for b in STEEPNESS]
    return LanguageModel(model.names, model.samples, alphabet, float(STEEPNESS[int(np.argmin(loss))]))


def train(docs: DataFrame, learned: Column, bound: LanguageBound = LanguageBound(), doc_id="doc_id", text="text", lang="lang") -> LanguageModel:
    """A model of the rows for which `learned` is true; a bounded sample of each language, in hash order, is fitted in one task."""
    rows = docs.where(learned & F.col(lang).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(doc_id).alias("id"))
    common = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(bound.languages).select("lang")
    usable = rows.where((F.octet_length("text") <= bound.max_bytes) & F.rlike("text", F.lit(r"\p{L}"))).withColumn("order", F.xxhash64("id", "text"))
    place = Window.partitionBy("lang").orderBy("order", "id", "text")
    chosen = usable.withColumn("place", F.row_number().over(place)).where(F.col("place") <= bound.documents)
    sample = chosen.join(F.broadcast(common), "lang").select("lang", "text", "order")
    return fit_in_one_task(sample, lambda held: fit_model(held, bound))


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""

    def make():
        def apply(piece):
            found, scores = judge(model, texts(piece, 1))
            return pa.RecordBatch.from_arrays([piece.column(0), pa.array(found, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

        return apply

    return map_texts(docs, [doc_id], text, "doc_id bigint, lang_pred string, score double", make)
