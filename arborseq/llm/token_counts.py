"""Token counts by a compiled finite-state tokenizer.

A BPE vocabulary with ranked pieces is compiled, transition by transition and
only as far as texts ask for it, into a deterministic transducer that reads
characters and emits the change of the token count.  A state holds what can
still matter: the places where a piece may have begun (as nodes of the trie of
pieces), each with the last token before it and its count relative to now.  The
last token of a prefix is the one piece whose left neighbour it is stable with,
so no text is ever merged pair by pair.

No piece holds a word mark behind another character, so the state after such a
mark is always the same: there the state map of a chunk is constant.  Texts are
cut into chunks at these places; the maps of distinct chunks are computed once
and composed over a block by a prefix scan, which for constant maps is a running
sum of their counts.  Long words have no such places: their spans' maps are found for
the states they are met in, and composed one after the other.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import blocks
from .common import ship, texts

MARK = "▁"
MAX_TRANSITIONS = 600_000
MAX_CHUNKS = 400_000
#: Longer words are read by spans of SPAN characters, whose state maps are kept as they are found.
LONG, SPAN = 256, 32
MAX_SPANS = 200_000
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class Ambiguous(Exception):
    """No single last token is stable; the chunk is then merged pair by pair."""


class Transducer(dict):
    """Counts of chunks, by chunk without its first mark; itself the table of the state maps found so far."""

    def __init__(self, scores: dict[str, float], unknown_cost=lambda ch: len(ch.encode("utf-8", "surrogatepass"))):
        super().__init__()
        self.scores = scores
        if any(MARK in p.lstrip(MARK) for p in scores):
            raise ValueError("a piece holds a word mark behind another character; chunks can't be cut there")
        self.unknown_cost = unknown_cost
        self.children: list[dict[str, int]] = [{}]
        self.piece: list[str | None] = [None]
        for p in scores:
            node = 0
            for ch in p:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.piece.append(None)
                node = self.children[node][ch]
            self.piece[node] = p
        self.stable: dict[tuple[str | None, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [((0, None, 0),)]
        self.number = {self.states[0]: 0}
        self.step: dict[int, int] = {}
        self.spans: dict[tuple[int, str], tuple[int, int]] = {}

    def merged(self, text: str) -> list[str]:
        """The tokens of a text, merged pair by pair: best score first, then leftmost; n log n steps."""
        parts, scores = list(text), self.scores
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            whole = parts[i] + parts[j]
            if whole in scores:
                heapq.heappush(queue, (-scores[whole], i, j, whole))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, whole = heapq.heappop(queue)
            # a part that was merged away is empty, one that has grown spells another whole
            if not parts[i] or not parts[j] or after[i] != j or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j] = whole, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return [x for x in parts if x]

    def _stable(self, before: str | None, token: str) -> bool:
        if before is not None and token[0] == MARK and before[-1] != MARK:
            before = None
        key = (before, token)
        if key not in self.stable:
            if len(self.stable) > MAX_TRANSITIONS:
                self.stable.clear()
            self.stable[key] = self.merged((before or "") + token) == ([token] if before is None else [before, token])
        return self.stable[key]

    def _compile(self, state: int, ch: str) -> int:
        """Next state and emitted count, packed."""
        found, live = {}, []
        for node, before, count in self.states[state]:
            child = self.children[node].get(ch)
            if child is not None:
                token = self.piece[child]
                if token is not None and self._stable(before, token):
                    found[token] = count + 1
                if self.children[child]:
                    live.append((child, before, count))
        if ch not in self.scores:
            found[None] = self.unknown_cost(ch)
        if len(found) != 1:
            raise Ambiguous
        ((last, emitted),) = found.items()
        new = (*((n, b, c - emitted) for n, b, c in live), (0, last, 0))
        number = self.number.get(new)
        if number is None:
            number = self.number[new] = len(self.states)
            self.states.append(new)
        packed = number << 16 | (emitted + (1 << 15))
        self.step[state << 21 | ord(ch)] = packed
        return packed

    def read(self, state: int, text: str) -> tuple[int, int]:
        """The state map of a text at one state: the state after it and the tokens counted on the way."""
        step, total = self.step, 0
        for ch in text:
            packed = step.get(state << 21 | ord(ch))
            if packed is None:
                packed = self._compile(state, ch)
            state = packed >> 16
            total += (packed & 0xFFFF) - (1 << 15)
        return state, total

    def count(self, chunk: str) -> int:
        """Tokens of a chunk that begins with a mark; the state after it is the one before it."""
        if len(self.step) > MAX_TRANSITIONS or len(self.spans) > MAX_SPANS:
            self.reset()
        try:
            if len(chunk) <= LONG:
                return self.read(0, chunk)[1]
            state = total = 0
            for at in range(0, len(chunk), SPAN):
                key = (state, chunk[at : at + SPAN])
                found = self.spans.get(key)
                if found is None:
                    found = self.read(*key)
                    if len(self.spans) <= MAX_SPANS:
                        self.spans[key] = found
                state = found[0]
                total += found[1]
            return total
        except Ambiguous:
            return sum(1 if t in self.scores else self.unknown_cost(t) for t in self.merged(chunk))

    def __missing__(self, chunk: str) -> int:
        n = self.count(MARK + chunk)
        if len(chunk) <= 64:
            self[chunk] = n
        return n

    def chunks(self, text: str) -> list[str]:
        """The text's chunks, each without its first mark."""
        if not text:
            return []
        if "  " not in text and text[0] != " " and MARK not in text:
            return text.split(" ")
        return [x[1:] for x in _CHUNK.findall(MARK + text.replace(" ", MARK))]

    def totals(self, docs: list[str]) -> np.ndarray:
        """Token counts of documents: chunk maps, then a prefix scan over them."""
        if len(self) > MAX_CHUNKS:
            self.clear()
        cut = [self.chunks(x) for x in docs]
        counts = np.fromiter(map(self.__getitem__, chain.from_iterable(cut)), dtype=np.int64)
        scan = np.concatenate([[0], np.cumsum(counts)])
        ends = np.concatenate([[0], np.cumsum([len(x) for x in cut])]).astype(np.int64)
        return np.diff(scan[ends])


@lru_cache(maxsize=2)
def sentencepiece_transducer(path: str) -> Transducer:
    """Compile a sentencepiece BPE model with byte fallback, identity normalisation and a leading mark."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    if sp.normalize("  a  ﬁ ") != f"{MARK * 3}a{MARK * 2}ﬁ{MARK}":
        raise ValueError("the model normalises texts; only identity normalisation is compiled")
    special = [i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)]
    normal = set(range(n)) - set(special)
    return Transducer({sp.id_to_piece(i): sp.get_score(i) for i in normal})


def token_counts(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row.

    Null text counts as empty: no bytes, no tokens.  Rows may repeat; other columns are ignored.
    """
    ship(docs.sparkSession)
    narrow = docs.select(key, text)
    kind = dict(narrow.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = sentencepiece_transducer(path)
        for batch in batches:
            values = texts(batch.column(1))
            for a, b in blocks(values):
                n = machine.totals(values[a:b])
                size = [len(x.encode("utf-8", "surrogatepass")) for x in values[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    return narrow.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
