"""Language identification with word-first backoff.

A known word is scored by its log frequency in each language.  An unseen word
backs off to its character n-grams, longest first: the first length of which any
n-gram is known decides, with the mean of the known ones.  A text's language is
the one with the largest sum over its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import blocks
from .common import Numbers, discard, ship, stored, texts

_WORD = re.compile(r"[^\W\d_]+")
LONGEST = 4
CACHE_WORDS = 400_000
UNKNOWN = "und"


class Backoff:
    """Log frequencies of words and of n-grams by length, for each language."""

    def __init__(self, words: list[tuple[str, str, int]], grams: list[tuple[str, str, int]]):
        self.langs = sorted({x[1] for x in words})
        at = {x: i for i, x in enumerate(self.langs)}
        self.words = self._table(words, at)
        by_length: dict[int, list] = {n: [] for n in range(1, LONGEST + 1)}
        for g in grams:
            by_length[len(g[0])].append(g)
        self.grams = {n: self._table(x, at) for n, x in by_length.items()}

    @staticmethod
    def _table(rows: list[tuple[str, str, int]], at: dict[str, int], smooth: float = 0.1) -> dict[str, np.ndarray]:
        counts: dict[str, np.ndarray] = {}
        total = np.zeros(len(at))
        for text, lang, n in rows:
            if lang in at:
                counts.setdefault(text, np.zeros(len(at)))[at[lang]] += n
                total[at[lang]] += n
        floor = total + smooth * max(1, len(counts))
        return {t: np.log((c + smooth) / floor) for t, c in counts.items()}

    def score(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is not None:
            return known
        marked = f"^{word}$"
        for n in range(LONGEST, 0, -1):
            table = self.grams[n]
            found = [table[g] for g in (marked[i : i + n] for i in range(len(marked) - n + 1)) if g in table]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(self.langs))


class Scorer:
    """Scores texts by the words of a block; distinct words are looked up once."""

    def __init__(self, model: Backoff):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.number = Numbers()
        self.rows = np.zeros((0, len(self.model.langs)))

    def sums(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log score of each text in each language, and whether it has a letter."""
        if len(self.number) > CACHE_WORDS:
            self.clear()
        cut = [_WORD.findall(x.lower()) for x in docs]
        flat = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), dtype=np.int64)
        if self.number.fresh:
            fresh, self.number.fresh = self.number.fresh, []
            new = np.array([self.model.score(w) if w.isalpha() else np.zeros(len(self.model.langs)) for w in fresh])
            self.rows = np.concatenate([self.rows, new])
        out = np.zeros((len(docs), len(self.model.langs)))
        at = 0
        for i, words in enumerate(cut):
            out[i] = self.rows[flat[at : at + len(words)]].sum(axis=0)
            at += len(words)
        return out, np.array([any(map(str.isalpha, chain.from_iterable(words))) or any(map(str.isalpha, x)) for words, x in zip(cut, docs, strict=True)], dtype=bool)


def in_share(key: str, salt: int, share: float) -> Column:
    """Whether a row's key falls in a share of all keys, the same rows in every run."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1 << 32)) < F.lit(int(share * (1 << 32)))


def in_sample(key: Column, rows: Column, most: float) -> Column:
    """Whether a row is among about ``most`` of ``rows``, any number of them, by a hash of its key."""
    return F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1 << 32)).cast("double") * rows.cast("double") < F.lit(float(1 << 32) * most)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_docs: int = 20_000, max_words: int = 60_000, max_grams: int = 60_000, least_count: int = 2, max_letters: int = 64) -> Backoff:
    """Fit on the rows of ``docs`` that have a language.

    The fit is bounded, each bound being dealt out evenly over the languages, so a rare one is learned at every size: of
    a language's more than about ``max_docs`` over all languages' number of rows, a share of that size drawn by a hash of
    the key; its most frequent of ``max_words`` words and ``max_grams`` n-grams (ties by text).  What one language chose
    is counted in all of them.  Words of more than ``max_letters`` letters, and those a language has fewer than
    ``least_count`` times, aren't learned.
    """
    known = docs.where(F.col(lang).isNotNull()).select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("body"))
    sizes = stored(known.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "languages")
    langs = max(1, sizes.count())
    drawn = known.join(sizes, "lang").where(in_sample(F.col("key"), F.col("rows"), max_docs / langs))
    spelled = F.filter(F.split("body", r"[^\p{L}]+"), lambda w: (F.length(w) > 0) & (F.length(w) <= max_letters))
    words = stored(drawn.select("lang", F.explode(spelled).alias("text")).groupBy("text", "lang").agg(F.count(F.lit(1)).alias("n")), "words")
    marked = F.concat(F.lit("^"), F.col("text"), F.lit("$"))

    def pieces(k: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(marked) - (k - 1)), lambda i: F.substr(marked, i, F.lit(k)))
        return F.when(F.length(marked) >= k, cut).otherwise(F.array().cast("array<string>"))

    grams = stored(words.select("lang", "n", F.explode(F.concat(*map(pieces, range(1, LONGEST + 1)))).alias("text")).groupBy("text", "lang").agg(F.sum("n").alias("n")), "grams")

    def most(df: DataFrame, k: int) -> list[tuple[str, str, int]]:
        first = Window.partitionBy("lang").orderBy(F.desc("n"), "text")  # of the bounded sample
        chosen = df.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= max(1, k // langs)).select("text").distinct()
        return [tuple(r) for r in df.join(chosen, "text", "left_semi").select("text", "lang", "n").collect()]

    out = Backoff(most(words.where(F.col("n") >= least_count), max_words), most(grams, max_grams))
    discard(sizes, words, grams)
    return out


def predict(docs: DataFrame, model: Backoff, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score (posterior of the language with equal priors) of every row.

    A null text or one without a letter is ``und`` with score 0; so is every text if nothing was learned.  Ties go to
    the first language by name.
    """
    spark = docs.sparkSession
    ship(spark)
    narrow = docs.select(key, text)
    kind = dict(narrow.dtypes)[key]
    shared = spark.sparkContext.broadcast(model)  # bounded by the fit's limits

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        langs = np.array([*scorer.model.langs, UNKNOWN], dtype=object)
        for batch in batches:
            values = texts(batch.column(1))
            for a, b in blocks(values):
                if len(langs) == 1:
                    best, p = np.zeros(b - a, dtype=int), np.zeros(b - a)
                else:
                    sums, letters = scorer.sums(values[a:b])
                    best = sums.argmax(axis=1)
                    p = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
                    best, p = np.where(letters, best, len(langs) - 1), np.where(letters, p, 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(langs[best], pa.string()), pa.array(p)], names=[key, "lang_pred", "score"])

    return narrow.mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def held_out(key: str = "doc_id") -> Column:
    """Whether crc32 of the key as text leaves 1 when divided by 3; a null key is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, held_out, lang_pred, score of every row, fitted on the rows not held out."""
    model = train(docs.where(~held_out(key)), key, text, lang)
    return predict(docs, model, key, text).select(key, held_out(key).alias("held_out"), "lang_pred", "score")
