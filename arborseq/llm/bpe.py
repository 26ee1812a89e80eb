"""Byte-level BPE by corpus-level merge replay.

A block of documents is cut into pre-tokens and its distinct pre-tokens are laid
out once as one flat row of symbols.  An inverted index maps each merge rank to
the positions of the pairs it joins; ranks are replayed in order, and each merge
touches only the two neighbours of every joined pair, whose new ranks are posted
to the index.  Documents are then spelled from the ids of their pre-tokens.

Work is per block: no shuffle, memory bounded by the block and by the cache of
pre-tokens, which starts anew when full.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Numbers, ship, texts

#: No merge joins a pair of this rank.
NONE = np.int64(1 << 40)
CACHE_WORDS = 500_000
BLOCK_CHARS = 8_000_000


class Ranks:
    """The merges of a rank file, as a sorted table of pairs."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.words = regex.compile(pattern)
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        n = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * n
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, values = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.values = np.array(values, dtype=np.int64)[order]
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.clear()

    def clear(self) -> None:
        self.cache = Numbers()
        self.ids = np.zeros(0, dtype=np.uint32)
        self.word_starts = np.zeros(1, dtype=np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.values[at], NONE)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, concatenated, and where each word's begin."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        if not lengths.sum():
            return np.zeros(0, dtype=np.uint32), np.zeros(len(words) + 1, dtype=np.int64)
        n = int(lengths.sum())
        # a guard at either end keeps neighbours of the first and last symbol in range
        symbol = np.full(n + 2, -1, dtype=np.int64)
        symbol[1:-1] = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.full(n + 2, -1, dtype=np.int64)
        word[1:-1] = np.repeat(np.arange(len(words)), lengths)
        after, before = np.arange(1, n + 3), np.arange(-1, n + 1)
        after[-1], before[0] = n + 1, 0
        alive = np.ones(n + 2, dtype=bool)
        rank = np.full(n + 2, NONE, dtype=np.int64)
        inside = word[1:-2] == word[2:-1]
        rank[1:-2] = np.where(inside, self.pair_ranks(symbol[1:-2], symbol[2:-1]), NONE)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def post(positions: np.ndarray, ranks: np.ndarray) -> None:
            if not len(positions):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for r, p in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(p)

        first = np.flatnonzero(rank < NONE)
        post(first, rank[first])
        while heap:
            r = heapq.heappop(heap)
            at = index.pop(r)
            at = np.unique(np.concatenate(at)) if len(at) > 1 else np.sort(at[0])
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            linked = np.concatenate([[False], after[at[:-1]] == at[1:]])
            if linked.any():  # overlapping pairs, as in "aaa": the leftmost first
                run = np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            if len(at) > 1 and (word[at[1:]] == word[at[:-1]]).any():
                at, rest = self._in_order(at, r, symbol, word, after, before)
                post(rest, np.full(len(rest), r, dtype=np.int64))
            gone = after[at]
            symbol[at] = r
            alive[gone] = False
            rank[gone] = NONE
            after[at] = after[gone]
            before[after[at]] = at
            # an element whose neighbour was joined too takes that one's new symbol
            right, left = after[at], before[at]
            new = np.where(word[right] == word[at], self.pair_ranks(symbol[at], symbol[right]), NONE)
            rank[at] = new
            keep = new < NONE
            post(at[keep], new[keep])
            new = np.where(word[left] == word[at], self.pair_ranks(symbol[left], symbol[at]), NONE)
            ok = word[left] == word[at]
            rank[left[ok]] = new[ok]
            keep = ok & (new < NONE)
            post(left[keep], new[keep])
        alive[0] = alive[-1] = False
        counts = np.bincount(word[alive], minlength=len(words))
        return symbol[alive].astype(np.uint32), np.concatenate([[0], np.cumsum(counts)])

    def _in_order(self, at, r, symbol, word, after, before):
        """Split joins of one rank: those to do now, and those to take up again.

        Several joins in one word may go together only if none makes a pair of a lower rank, which would come first.
        """
        merged = np.full(len(at), r, dtype=np.int64)
        right, left = after[after[at]], before[at]
        was_joined = np.zeros(len(at), dtype=bool)
        was_joined[1:] = after[after[at[:-1]]] == at[1:]
        left_symbol = np.where(was_joined, r, symbol[left])
        low = np.minimum(
            np.where(word[right] == word[at], self.pair_ranks(merged, symbol[right]), NONE),
            np.where(word[left] == word[at], self.pair_ranks(left_symbol, merged), NONE),
        )
        if (low >= r).all():
            return at, at[:0]
        first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
        return at[first], at[~first]

    def spell(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, concatenated, and where each document's begin."""
        find = self.words.findall
        cut = [find(x) for x in docs]
        if len(self.cache) > CACHE_WORDS:
            self.clear()
        flat = np.fromiter(map(self.cache.__getitem__, chain.from_iterable(cut)), dtype=np.int64)
        if self.cache.fresh:
            ids, starts = self.replay([w.encode("utf-8", "surrogatepass") for w in self.cache.fresh])
            self.cache.fresh = []
            self.word_starts = np.concatenate([self.word_starts, starts[1:] + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
        lengths = self.word_starts[flat + 1] - self.word_starts[flat]
        ids = gather(self.ids, self.word_starts[flat], lengths)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        per_doc = np.concatenate([[0], np.cumsum([len(words) for words in cut])]).astype(np.int64)
        return ids, ends[per_doc]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        ids = ids.astype(np.int64)
        return gather(self.bytes, self.starts[ids], self.lengths[ids]).tobytes()


def gather(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of source[start:start+length] over all pairs."""
    total = int(lengths.sum())
    if not total:
        return source[:0]
    ends = np.cumsum(lengths)
    return source[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


@lru_cache(maxsize=4)
def ranks_of(path: str, pattern: str) -> Ranks:
    return Ranks(path, pattern)


def blocks(docs: list[str], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most about ``most`` characters; a longer document is a range of its own."""
    start = size = 0
    for i, x in enumerate(docs):
        if size and size + len(x) > most:
            yield start, i
            start, size = i, 0
        size += len(x)
    if docs:
        yield start, len(docs)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out`` (array of ids) to ``docs``: ``text`` by the ranks at ``path``, as tiktoken's encode_ordinary gives them.

    Null text counts as empty and gives an empty array.  All columns stay; rows may repeat.
    """
    from pyspark.sql import types as T

    ship(docs.sparkSession)
    schema = T.StructType([f for f in docs.schema if f.name != out] + [T.StructField(out, T.ArrayType(T.LongType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ranks_of(path, pattern)
        for batch in batches:
            values = texts(batch.column(text))
            for a, b in blocks(values):
                ids, starts = model.spell(values[a:b])
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.astype(np.int64)))
                part = batch.slice(a, b - a)
                keep = [n for n in part.schema.names if n != out]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in keep] + [lists], names=[*keep, out])

    return docs.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode, and return a digest of both by document: key, n_tokens, ids_sha256, decoded_sha256."""
    ship(docs.sparkSession)
    narrow = docs.select(key, text)
    kind = dict(narrow.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ranks_of(path, pattern)
        for batch in batches:
            values = texts(batch.column(1))
            for a, b in blocks(values):
                ids, starts = model.spell(values[a:b])
                pieces = [ids[i:j] for i, j in zip(starts[:-1], starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(np.diff(starts)),
                        pa.array([hashlib.sha256(p.astype("<u4").tobytes()).hexdigest() for p in pieces]),
                        pa.array([hashlib.sha256(model.decode(p)).hexdigest() for p in pieces]),
                    ],
                    names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return narrow.mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
