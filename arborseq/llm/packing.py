"""Cost-balanced packing of token documents into training sequences.

A sequence of n tokens costs ``linear * n + quadratic * n**2`` (projections and
attention; attention stays within a document's piece).  Documents are tokenised,
cut at the capacity, and the pieces, longest first, go to the sequence of least
cost so far that has room; a piece that fits nowhere whole is cut to fill the
sequence of least cost.  The number of sequences is the least that can hold the
tokens, so a block wastes less than one sequence.

Blocks are formed inside an input partition: no shuffle, and memory is bounded
by ``block_tokens``.  The sequences depend on how the input is partitioned, the
tokens in them don't.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import blocks, gather
from .common import Numbers, frugal, ship, texts

CACHE_WORDS = 450_000
BLOCK_TOKENS = 4_000_000
#: Characters spelled at a time, and tokens given on at a time, about: what a task holds besides a block's tokens.
SPELLED, SHOWN = 2_000_000, 500_000


#: Latin, Greek (but for the capital sigma, whose lower case depends on its place), Cyrillic, punctuation, kana, Han, Hangul.
AGREED = re.compile("[\t-\r -~\x85-\u02ff\u0300-\u0304\u0306-\u030c\u0370-\u0377\u0384-\u038a\u038e-\u03a1\u03a4-\u052f\u1e00-\u1eff\u2000-\u2064\u20a0-\u20bf\u2190-\u23fe\u2500-\u2b73\u3000-\u303f\u3041-\u3096\u30a1-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff9f\U0001f300-\U0001f5ff\U0001f600-\U0001f64f]*").fullmatch


class WordTokenizer:
    """A tokenizers model of lower-case words with word ends, by distinct words of a block.

    No word goes over white space, so texts are cut there; distinct chunks are split as the model's own pre-tokeniser
    does, and each distinct word goes through the library once.  Texts that hold a special token's string, or a
    character outside the ranges for which Python and the library surely agree, go through it whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        (split,) = (p for p in config["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        kinds = [n["type"] for n in config["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("not a model of lower-case words")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.special = [t["content"] for t in config["added_tokens"]]
        self.library = Tokenizer.from_file(path)
        # for words that are normalised and split already
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        end = config["model"]["end_of_word_suffix"]
        vocab = self.library.get_vocab(with_added_tokens=False)
        self.is_end = np.zeros(max(self.library.get_vocab().values()) + 1, dtype=bool)
        self.is_end[[i for t, i in vocab.items() if t.endswith(end)]] = True
        self.clear()

    def clear(self) -> None:
        self.cache = Numbers()
        self.ids = np.zeros(0, dtype=np.uint32)
        self.starts = np.zeros(1, dtype=np.int64)
        self.uses = np.zeros(0, dtype=np.int64)

    def trim(self) -> None:
        """Keep the chunks used most, at most half of what the cache may hold."""
        floor = max(2, int(np.sort(self.uses)[-CACHE_WORDS // 2])) if len(self.uses) > CACHE_WORDS // 2 else 2
        at = np.flatnonzero(self.uses > floor)
        chunks = list(self.cache)
        lengths = self.starts[at + 1] - self.starts[at]
        self.ids, self.starts, self.uses = gather(self.ids, self.starts[at], lengths), np.concatenate([[0], np.cumsum(lengths)]), self.uses[at]
        self.cache = Numbers((chunks[i], n) for n, i in enumerate(at.tolist()))

    @staticmethod
    def normal(text: str) -> str:
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, concatenated, and where each one's end."""
        found, ends, base = [], [], 0
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            ids = np.array(self.merges.encode(" ".join(part), add_special_tokens=False).ids, dtype=np.uint32)
            stops = np.flatnonzero(self.is_end[ids]) + 1
            if len(stops) != len(part):  # a word the library splits or joins otherwise: one by one
                each = [self.library.encode(w, add_special_tokens=False).ids for w in part]
                ids, stops = np.array(list(chain.from_iterable(each)), dtype=np.uint32), np.cumsum([len(x) for x in each])
            found.append(ids)
            ends.append(stops + base)
            base += len(ids)
        return np.concatenate(found or [self.ids[:0]]), np.concatenate([[0], *ends]).astype(np.int64)

    def _learn(self, fresh: list[str]) -> None:
        """Ids of chunks between white space: of their distinct words, once each."""
        find = self.words.findall
        cut = [(x,) if x.isalpha() else find(x) for x in fresh]
        words = list(set(chain.from_iterable(cut)))
        ids, at = self._words(words)
        number = dict(zip(words, range(len(words)), strict=True))
        flat = np.fromiter(map(number.__getitem__, chain.from_iterable(cut)), dtype=np.int64)
        lengths = at[flat + 1] - at[flat]
        scan = np.concatenate([[0], np.cumsum(lengths)])
        ends = scan[np.cumsum([len(x) for x in cut])]
        self.starts = np.concatenate([self.starts, ends + len(self.ids)])
        self.ids = np.concatenate([self.ids, gather(ids, at[flat], lengths)])

    def spell(self, docs: list[str], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, each followed by ``end_id``, and where each document's begin."""
        whole = {i for i, x in enumerate(docs) if not AGREED(x) or any(s in x for s in self.special)}
        cut = [[] if i in whole else self.normal(x).split() for i, x in enumerate(docs)]
        if len(self.cache) > CACHE_WORDS:
            self.trim()
        flat = np.fromiter(map(self.cache.__getitem__, chain.from_iterable(cut)), dtype=np.int64)
        if self.cache.fresh:
            self._learn(self.cache.fresh)
            self.cache.fresh = []
        uses = np.bincount(flat, minlength=len(self.cache))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        lengths = self.starts[flat + 1] - self.starts[flat]
        ids = gather(self.ids, self.starts[flat], lengths)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum([len(x) for x in cut])]).astype(np.int64)]
        pieces = [np.array(self.library.encode(docs[i], add_special_tokens=False).ids, dtype=np.uint32) if i in whole else ids[ends[i] : ends[i + 1]] for i in range(len(docs))]
        tail = [] if end_id is None else [np.array([end_id], dtype=np.uint32)]
        parts = [x for p in pieces for x in (p, *tail)]
        sizes = [len(p) + len(tail) for p in pieces]
        return (np.concatenate(parts) if parts else ids), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def balance(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1e-3) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths.

    Every token lies in one piece, offsets in a sequence are gapless from 0, no sequence exceeds ``capacity``, and there
    are ceil(total / capacity) sequences.
    """
    total = int(lengths.sum())
    n = -(-total // capacity)
    cost, room = np.zeros(n), np.full(n, capacity, dtype=np.int64)
    out: list[tuple[int, int, int, int, int]] = []
    pieces = []
    for d, size in enumerate(lengths.tolist()):
        pieces += [(min(capacity, size - s), d, s) for s in range(0, size, capacity)]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    full = sum(p[0] == capacity for p in pieces)
    for i, (size, d, s) in enumerate(pieces[:full]):  # one sequence each
        out.append((d, s, size, i, 0))
    cost[:full], room[:full] = np.inf, 0
    for size, d, s in pieces[full:]:
        fits = np.flatnonzero(room >= size)
        while size:
            if len(fits):
                at, take = int(fits[np.argmin(cost[fits])]), size
            else:
                at = int(np.argmin(np.where(room > 0, cost, np.inf)))
                take = min(size, int(room[at]))
            out.append((d, s, take, at, capacity - int(room[at])))
            room[at] -= take
            cost[at] += linear * take + quadratic * take * take
            s, size = s + take, size - take
            if size:
                fits = np.flatnonzero(room >= size)
    return out


def shown(keys: pa.Array, ids: np.ndarray, lengths: np.ndarray, pieces: list[tuple[int, int, int, int, int]], first: int, digest: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of a block's pieces, those of about ``SHOWN`` tokens at a time."""
    at = np.concatenate([[0], np.cumsum(lengths)])
    pieces = np.array(pieces, dtype=np.int64)
    group = (np.cumsum(pieces[:, 2]) - 1) // SHOWN
    for some in np.split(pieces, np.flatnonzero(group[1:] != group[:-1]) + 1):
        d, s, n, q, o = some.T
        cut = [ids[i : i + m] for i, m in zip((at[d] + s).tolist(), n.tolist(), strict=True)]
        if digest:
            column = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in cut], pa.int64())
        else:
            column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(cut).astype(np.int64)))
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(d)), pa.array(s), pa.array(n), column, pa.array(lengths[d]), pa.array(q + first), pa.array(o)], names=names)


SCHEMA = "start long, length long, ids array<long>, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int | None = None, key: str = "doc_id", text: str = "text", digest: bool = False, linear: float = 1.0, quadratic: float = 1e-3) -> DataFrame:
    """Pieces of all documents: key, start, length, ids, doc_tokens, sequence_id, offset.

    Null text counts as empty; with ``end_id`` such a document is one piece of one token, without it no piece.  Rows
    with one key are packed each for itself.  With ``digest`` the ids are given as ids_crc32 instead of an array.
    """
    ship(docs.sparkSession)
    narrow = docs.select(key, text)
    (key_field,) = (f for f in narrow.schema if f.name == key)
    tail = [("start", T.LongType()), ("length", T.LongType()), ("ids_crc32" if digest else "ids", T.LongType() if digest else T.ArrayType(T.LongType())), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]
    schema = T.StructType([key_field] + [T.StructField(n, t) for n, t in tail])

    def flush(held: list, first: int) -> Iterator[pa.RecordBatch]:
        lengths = np.concatenate([np.diff(starts) for _, _, starts in held])
        ids = np.concatenate([x for _, x, _ in held])
        keys = pa.concat_arrays([k for k, _, _ in held])
        held.clear()
        return shown(keys, ids, lengths, balance(lengths, capacity, linear, quadratic), first, digest, schema.names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_tokenizer(path)
        first, held, size = TaskContext.get().partitionId() << 36, [], 0
        for batch in batches:
            values = texts(batch.column(1))
            for a, b in blocks(values, SPELLED):
                ids, starts = model.spell(values[a:b], end_id)
                held.append((batch.column(0).slice(a, b - a), ids, starts))
                size += len(ids)
                if size >= BLOCK_TOKENS:
                    yield from flush(held, first)
                    first, held, size = first - (-size // capacity), [], 0
        if size:
            yield from flush(held, first)

    return narrow.mapInArrow(frugal(run), schema)
