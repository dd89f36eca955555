"""Encoding and decoding with SentencePiece merge-type vocabularies.

Encoding works on a prefix table: of the pieces that end at a position (found by one automaton), exactly one can be the
last token of that prefix, namely the one that the last token before it accepts as neighbour. Two tokens accept each other
if merging their joined text gives just these two; that is decided by undoing their merges, latest first, and asking at
each step whether the two symbols at the seam would have merged earlier. The ids are then read backwards.

No piece holds a space mark after another character, so no merge crosses the start of a word, and a character that is no
piece separates what is left and right of it. Texts are therefore cut there, and the ids of a word are remembered (up to
`memory` words per task). Runs of space marks have merges of equal score and are merged leftmost first, once per length.

Supported: BPE with identity normalisation, a leading space mark and byte fallback; anything else is refused.

Defined cases: null and empty texts give no ids and decode to an empty text; a long text is one row like any other;
repeated rows are returned each; other columns are not read.
"""

from __future__ import annotations

import codecs
import heapq
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from hourloom.llm.arrow import map_texts, texts, worker_memory

MARK = "▁"
MEMORY = 400_000
PAIRS = 600_000
_PROBES = ("", " ", "a  b", "  lead", "tail  ", "new\nline\tand é 日本 😀", "x" * 40, " " * 37 + "z", "1234 5,6.7!!", "▁mark ▁", "</s><s>")

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class _Node:
    """A merged symbol: its piece, the rank of the merge that made it (-1: a character), and its two parts."""

    __slots__ = ("piece", "rank", "left", "right")

    def __init__(self, piece, rank=-1, left=None, right=None):
        self.piece, self.rank, self.left, self.right = piece, rank, left, right


class _Words(dict):
    """Ids by word; a missing word is encoded and remembered. When full, the words become the old generation, from
    which those still in use return."""

    def __init__(self, encode, memory):
        super().__init__()
        self.encode, self.memory, self.old = encode, memory // 2, {}

    def __missing__(self, word):
        ids, lasting = self.old.get(word), True
        if ids is None:
            ids, lasting = self.encode(word)
        if lasting:
            if len(self) >= self.memory:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class MergeTokenizer:
    def __init__(self, model_file: str, memory: int = MEMORY):
        library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = library.get_piece_size()
        special = {i for i in range(size) if library.is_control(i) or library.is_unknown(i)}
        byte_ids = {int(library.id_to_piece(i)[3:5], 16): i for i in range(size) if library.is_byte(i)}
        self.pieces = {library.id_to_piece(i): i for i in range(size) if i not in special and not library.is_byte(i) and not library.is_unused(i)}
        if len(byte_ids) != 256 or any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a vocabulary with byte fallback and space marks in front is needed")
        order = sorted(self.pieces, key=lambda p: -library.get_score(self.pieces[p]))
        self.rank, last = {}, None
        for n, p in enumerate(order):
            if last is None or library.get_score(self.pieces[p]) != last[0]:
                last = (library.get_score(self.pieces[p]), n)
            self.rank[p] = last[1]
        self.text_of = {i: p for p, i in self.pieces.items()}
        self.bytes_of = [byte_ids[b] for b in range(256)]
        self.surface = [""] * size
        for i, p in self.text_of.items():
            self.surface[i] = p.replace(MARK, " ")
        for b, i in byte_ids.items():
            self.surface[i] = chr(b) if b < 128 else chr(0xDC00 + b)
        for i in special:
            self.surface[i] = library.decode([i]) if library.is_unknown(i) else ""
        self.known = {c for p in self.pieces for c in p if c in self.pieces}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.pieces.items():
            if len(p) == 1 or p.strip(MARK):
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.trees: dict[int, _Node | None] = {}
        self.accepted: dict[int, bool] = {}
        self.runs: dict[int, list[int]] = {}
        self.marked = _Words(lambda w: self._word(w, True), memory)
        self.plain = _Words(lambda w: self._word(w, False), memory)
        for probe in _PROBES:
            if self.encode(probe) != library.encode(probe) or self.decode(self.encode(probe)) != library.decode(library.encode(probe)):
                raise ValueError("this model is normalised or merged in a way that is not supported")

    # --- merges -----------------------------------------------------------------------------------------------------

    def _merged(self, text: str) -> list[_Node]:
        """Merge a short text: always the pair of the best score, the leftmost among equals."""
        nodes = [_Node(c) for c in text]
        while len(nodes) > 1:
            ranked = [(self.rank.get(a.piece + b.piece, -1), k) for k, (a, b) in enumerate(zip(nodes, nodes[1:]))]
            ranked = [x for x in ranked if x[0] >= 0]
            if not ranked:
                break
            rank, k = min(ranked)
            a, b = nodes[k], nodes[k + 1]
            nodes[k : k + 2] = [_Node(a.piece + b.piece, rank, a, b)]
        return nodes

    def _tree(self, token: int) -> _Node | None:
        """How the token's own text merges; None if it does not merge to the token."""
        if token not in self.trees:
            nodes = self._merged(self.text_of[token])
            self.trees[token] = nodes[0] if len(nodes) == 1 else None
        return self.trees[token]

    def _accepts(self, a: int, b: int) -> bool:
        left, right = self._tree(a), self._tree(b)
        if left is None or right is None:
            return False
        taken_left = taken_right = len(self.rank)
        while True:
            merge = self.rank.get(left.piece + right.piece)
            if merge is not None and merge < taken_left and merge <= taken_right:
                return False
            if left.left is None and right.left is None:
                return True
            if left.rank > right.rank:
                if left.rank > taken_left:
                    break
                taken_left, left = left.rank, left.right
            else:
                if right.rank > taken_right:
                    break
                taken_right, right = right.rank, right.left
        # A part with a worse rank than the whole: the order of undoing is not by rank, so merge the joined text.
        return [n.piece for n in self._merged(self.text_of[a] + self.text_of[b])] == [self.text_of[a], self.text_of[b]]

    def _run(self, n: int) -> list[int]:
        """Ids of n space marks: always the leftmost pair of the best score."""
        if n not in self.runs:
            size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
            heap = []

            def offer(k):
                if 0 <= k and after[k] < n:
                    rank = self.rank.get(MARK * (size[k] + size[after[k]]))
                    if rank is not None:
                        heapq.heappush(heap, (rank, k, size[k], size[after[k]]))

            for k in range(n):
                offer(k)
            while heap:
                _, k, a, b = heapq.heappop(heap)
                if size[k] != a or after[k] >= n or size[after[k]] != b:
                    continue
                gone = after[k]
                size[k], size[gone], after[k] = a + b, 0, after[gone]
                if after[k] < n:
                    before[after[k]] = k
                offer(k)
                offer(before[k])
            ids, k = [], 0
            while k < n:
                ids.append(self.pieces[MARK * size[k]])
                k = after[k]
            if len(self.runs) > 10_000:
                self.runs.clear()
            self.runs[n] = ids
        return self.runs[n]

    # --- encoding ---------------------------------------------------------------------------------------------------

    def _stretch(self, text: str) -> list[int]:
        """Ids of known characters without inner space marks, by the prefix table."""
        n = len(text)
        last, length = [-1] * (n + 1), [0] * (n + 1)
        accepted = self.accepted
        for end, (size, token) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if start == 0:
                if self._tree(token) is None:
                    continue
            else:
                key = last[start] << 20 | token
                good = accepted.get(key)
                if good is None:
                    if len(accepted) > PAIRS:
                        accepted.clear()
                    good = accepted[key] = self._accepts(last[start], token)
                if not good:
                    continue
            last[end], length[end] = token, size
        ids = []
        while n:
            ids.append(last[n])
            n -= length[n]
        return ids[::-1]

    def _word(self, word: str, marked: bool) -> tuple[list[int], bool]:
        """Ids of a word without spaces, and whether it is worth remembering."""
        text = MARK + word if marked else word
        if self.known.issuperset(text):
            return self._stretch(text), True
        ids, low, n = [], 0, len(text)
        for k, c in enumerate(chain(text, (None,))):
            if c is None or c not in self.known:
                if k > low:
                    ids += self.marked[word[: k - 1]] if marked and low == 0 else self.plain[text[low:k]]
                if k < n:
                    ids += [self.bytes_of[b] for b in c.encode()]
                low = k + 1
        return ids, False

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.encode_parts(text)))

    def encode_parts(self, text: str) -> list[list[int]]:
        """Ids of a text, as one list per word."""
        if not text:
            return []
        words = text.replace(MARK, " ").split(" ")
        marked = self.marked
        if "" not in words:
            return [marked[w] for w in words]
        parts, run = [], 0
        for k, word in enumerate(words):
            run += 1
            if not word and k + 1 < len(words):
                continue
            ids = marked[word] if word else [self.pieces[MARK]]
            if run == 1:
                parts.append(ids)
            elif ids[0] == self.pieces[MARK]:
                parts += [self._run(run), ids[1:]]
            else:
                parts += [self._run(run - 1), ids]
            run = 0
        return parts

    # --- decoding ---------------------------------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        text = "".join(map(self.surface.__getitem__, ids))
        if ids and self.text_of.get(ids[0], "").startswith(MARK):
            text = text[1:]
        try:
            text.encode()
        except UnicodeEncodeError:
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "each_byte")
        return text


def tokenizer(model_file: str, memory: int = MEMORY) -> MergeTokenizer:
    """One tokenizer per worker process; what it remembers serves the next task, until another operator's task comes."""
    held = worker_memory()
    key = f"held tokenizer {memory} {model_file}"
    if key not in held:
        held[key] = MergeTokenizer(model_file, memory)
    return held[key]


ENCODED = "doc_id bigint, ids array<int>, decoded string"


def encode_texts(docs: DataFrame, model_file: str, memory: int = MEMORY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every whole text."""

    def make():
        own = tokenizer(model_file, memory)

        def apply(piece):
            flat, sizes, decoded = [], [], []
            for t in texts(piece, 1):
                ids = list(chain.from_iterable(own.encode_parts(t)))
                sizes.append(len(ids))
                flat.append(np.array(ids, dtype=np.int32))
                decoded.append(own.decode(ids))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)))
            return pa.RecordBatch.from_arrays([piece.column(0), lists, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

        return apply

    return map_texts(docs, [doc_id], text, ENCODED, make, keeps="held tokenizer")
