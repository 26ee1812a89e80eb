"""Quality classifier with hierarchical empirical Bayes over sites.

A document's own evidence is a logistic regression on its shape (case, symbols,
repetition, ...) and on words that tell labelled documents apart.  A site's rate
is the mean evidence of its other documents shrunk toward the level above it: hosts
toward the global rate, paths toward their host.  How strongly is estimated for each
level from the spread of its means around the level above (method of moments), so few
documents barely move a site and a level without spread moves none.  A document's
posterior combines its evidence with its site's rate relative to the global one; its
own evidence takes no part in that rate, so it counts once.

Two such posteriors are formed, for good quality and for toxicity; a document is
rejected if it is more likely bad than good, or more likely toxic than not.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, ship, stored, texts
from .language_id import in_share

_TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+")
_UPPER, _DIGIT, _ASCII_WORD = bytes(range(65, 91)), bytes(range(48, 58)), bytes([*range(48, 58), *range(65, 91), *range(97, 123), 32, 10, 13, 9])
SHAPE = 8
HEADS = ("quality", "toxic")


def shape(text: str) -> list[float]:
    """Features of a text's form, each about 0 to 1."""
    data = text.encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    words = text.split()
    m = max(1, len(words))
    distinct = len(set(words))
    again = sum(map(str.__eq__, words, words[1:]))
    symbols = len(data.translate(None, _ASCII_WORD))
    letters_beyond = len(data) - len(text)  # continuation bytes of letters such as é
    return [
        (n - len(data.translate(None, _UPPER))) / n,
        (n - len(data.translate(None, _DIGIT))) / n,
        max(0, symbols - 2 * letters_beyond) / n,
        distinct / m / (1 + np.log1p(m) / 20),
        again / m,
        min(1.0, len(data) / m / 20),
        text.count("\n") / m,
        min(1.0, np.log1p(m) / 10),
    ]


@dataclass
class Head:
    """One logistic regression: log odds of telling words, standardised features, weights."""

    words: dict[str, float] = field(default_factory=dict)
    mean: np.ndarray = field(default_factory=lambda: np.zeros(SHAPE + 3))
    scale: np.ndarray = field(default_factory=lambda: np.ones(SHAPE + 3))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(SHAPE + 4))

    def features(self, form: list[float], tokens: set[str]) -> list[float]:
        odds = [self.words[t] for t in tokens if t in self.words] if len(tokens) < len(self.words) else [w for t, w in self.words.items() if t in tokens]
        return [*form, max(odds, default=0.0), min(odds, default=0.0), float(np.clip(sum(odds), -20, 20))]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.weights[0] + ((x - self.mean) / self.scale) @ self.weights[1:]

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> None:
        """Penalised maximum likelihood by Newton steps; with one class only, a constant that favours it."""
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = np.concatenate([np.ones((len(x), 1)), (x - self.mean) / self.scale], axis=1)
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[0] = 1e-3
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            gradient = z.T @ (y - p) - penalty * w
            hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(hessian, gradient)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w


@dataclass
class Model:
    heads: dict[str, Head]


def _tokens(text: str) -> set[str]:
    return set(_TOKEN.findall(text.lower()))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_docs: int = 12_000, max_words: int = 2_000, least_docs: int = 8) -> Model:
    """Fit both heads on labelled rows.

    The fit is bounded: of more than about ``max_docs`` labelled documents, a share of that size drawn by a hash of the
    key; per head the ``max_words`` words with the strongest log odds among those in ``least_docs`` documents at least.
    Null labels are left out; of several labels of a document the largest counts.  Without labels of both kinds a head
    is constant.
    """
    ship(docs.sparkSession)
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    n = known.count()
    known = known.where(in_share("_key", 11, min(1.0, max_docs / max(1, n))))
    rows = stored(docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("text <> ''").join(known, "_key").select("text", "quality", "toxic"), "labelled")
    kinds = "text string, quality int, toxic int"

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(_tokens(t)) for t in batch.column(0).to_pylist()]
            row = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([pa.array([t for x in found for t in x], pa.string()), batch.column(1).take(row), batch.column(2).take(row)], names=["text", "quality", "toxic"])

    words = rows.mapInArrow(spread, kinds)
    model = Model({h: Head() for h in HEADS})
    sizes = rows.agg(*[F.count(F.when(F.col(h) == v, 1)).alias(f"{h}{v}") for h in HEADS for v in (0, 1)]).first()
    counted = stored(words.groupBy("text").agg(*[F.count(F.when(F.col(h) == v, 1)).alias(f"{h}{v}") for h in HEADS for v in (0, 1)]), "label-words")
    for h in HEADS:
        n0, n1 = sizes[f"{h}0"], sizes[f"{h}1"]
        if n0 and n1:
            odds = F.log((F.col(f"{h}1") + 0.5) / (n1 + 1.0)) - F.log((F.col(f"{h}0") + 0.5) / (n0 + 1.0))
            top = counted.where(F.col(f"{h}0") + F.col(f"{h}1") >= least_docs).select("text", odds.alias("odds")).where(F.abs("odds") > 1).orderBy(F.desc(F.abs("odds")), "text").limit(max_words)
            model.heads[h].words = {r["text"]: r["odds"] for r in top.collect()}

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in texts(batch.column(0)):
                form, tokens = shape(t), _tokens(t)
                out.append([model.heads[h].features(form, tokens) for h in HEADS])
            lists = [pa.array([x[i] for x in out], pa.list_(pa.float64())) for i in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *lists], names=["quality", "toxic", "fq", "ft"])

    sample = rows.mapInArrow(measure, "quality int, toxic int, fq array<double>, ft array<double>").collect()  # bounded by max_docs
    for h, f in zip(HEADS, ("fq", "ft"), strict=True):
        pairs = [(r[f], r[h]) for r in sample if r[h] is not None]
        if pairs:
            model.heads[h].fit(np.array([x for x, _ in pairs]), np.array([y > 0 for _, y in pairs], dtype=float))
    return model


def with_evidence(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) with _quality and _toxic, the log odds of their texts; null for a null or blank text."""
    spark = docs.sparkSession
    ship(spark)
    keep = docs.columns if keep is None else keep
    fields = [docs.schema[c] for c in keep] + [T.StructField(f"_{h}", T.DoubleType()) for h in HEADS]
    shared = spark.sparkContext.broadcast(model)  # bounded by the fit's limits
    source = docs.select(*dict.fromkeys([*keep, text]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = [shared.value.heads[h] for h in HEADS]
        for batch in batches:
            rows: list[list] = [[] for _ in heads]
            values = texts(batch.column(text))
            blank = np.array([not v or v.isspace() for v in values], dtype=bool)
            for v in values:
                form, tokens = shape(v), _tokens(v)
                for out, head in zip(rows, heads, strict=True):
                    out.append(head.features(form, tokens))
            logits = [pa.array(np.clip(head.logits(np.array(x)), -12, 12) if len(x) else np.zeros(0), mask=blank) for head, x in zip(heads, rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *logits], names=[f.name for f in fields])

    return source.mapInArrow(frugal(run), T.StructType(fields))


def _rate(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def _logit(rate: Column) -> Column:
    return F.log(rate / (1 - rate))


def _strength(between: float, chance: float, most: float) -> float:
    """How many documents the level above weighs, if means differ by a variance of ``between`` and documents by one of ``chance``."""
    return min(most, max(2.0, chance / between - 1)) if between > 0 else most


def site_rates(evidence: DataFrame, host: str, path: str, most_strength: float = 1e4) -> tuple[DataFrame, dict[str, tuple[float, float, float]]]:
    """Sums of each site, stored, and for each head the global rate and the strengths of the host and the path level.

    ``evidence`` has ``host``, ``path``, _quality and _toxic.  Everything is grouped sums; what reaches the driver is one row.
    """
    sums = []
    for h in HEADS:
        p = _rate(F.col(f"_{h}"))
        sums += [F.sum(p).alias(f"{h}_sum"), F.count(p).alias(f"{h}_n")]
    paths = stored(evidence.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(*sums), "paths")
    of_paths = [F.sum(F.pow(F.col(f"{h}_{x}"), 2) / (1 if x == "n" else F.col(f"{h}_n"))).alias(f"{h}_path_{y}") for h in HEADS for x, y in (("n", "n2"), ("sum", "q"))]
    counts = [F.count(F.when(F.col(f"{h}_n") > 0, 1)).alias(f"{h}_paths") for h in HEADS]
    filled = paths.select("host", *[F.when(F.col(f"{h}_n") > 0, F.col(f"{h}_{x}")).alias(f"{h}_{x}") for h in HEADS for x in ("sum", "n")])
    hosts = stored(filled.groupBy("host").agg(*[F.coalesce(F.sum(f"{h}_{x}"), F.lit(0)).alias(f"{h}_host_{x}") for h in HEADS for x in ("sum", "n")], *of_paths, *counts), "hosts")
    need = []
    for h in HEADS:
        n, total, rate = F.col(f"{h}_host_n"), F.col(f"{h}_host_sum"), F.col(f"{h}_host_sum") / F.col(f"{h}_host_n")
        need += [
            F.sum(n).alias(f"{h}_n"), F.sum(total).alias(f"{h}_sum"), F.sum(n * n).alias(f"{h}_n2"), F.sum(total * rate).alias(f"{h}_q"), F.count(F.when(n > 0, 1)).alias(f"{h}_k"),
            # of paths within their hosts: squared distances, what chance gives, and the weight of the variance
            F.sum(F.col(f"{h}_path_q") - total * rate).alias(f"{h}_within"), F.sum((F.col(f"{h}_paths") - 1) * rate * (1 - rate)).alias(f"{h}_by_chance"),
            F.sum(n - F.col(f"{h}_path_n2") / n).alias(f"{h}_weight"), F.sum(n * rate * (1 - rate)).alias(f"{h}_spread"),
        ]
    row = hosts.agg(*need).first().asDict()
    levels = {}
    for h in HEADS:
        v = {k: float(row[f"{h}_{k}"] or 0) for k in ("n", "sum", "n2", "q", "k", "within", "by_chance", "weight", "spread")}
        mean = min(max(v["sum"] / v["n"] if v["n"] else 0.5, 1e-6), 1 - 1e-6)
        chance = mean * (1 - mean)
        weight = v["n"] - v["n2"] / v["n"] if v["n"] else 0
        hosts_apart = max(0.0, (v["q"] - v["n"] * mean * mean - (v["k"] - 1) * chance) / weight) if weight > 0 else 0.0
        paths_apart = max(0.0, (v["within"] - v["by_chance"]) / v["weight"]) if v["weight"] > 1e-9 else 0.0
        levels[h] = (mean, _strength(hosts_apart, chance, most_strength), _strength(paths_apart, v["spread"] / v["n"] if v["n"] else chance, most_strength))
    out = paths.join(hosts, paths.host.eqNullSafe(hosts.host)).drop(hosts.host)
    return stored(out.select("host", "path", *[f"{h}_{x}" for h in HEADS for x in ("sum", "n", "host_sum", "host_n")]), "sites"), levels


def judged(evidence: DataFrame, sites: tuple[DataFrame, dict[str, tuple[float, float, float]]], host: str, path: str) -> DataFrame:
    """``evidence`` with p_quality, p_toxic and keep; a text without evidence is kept, with its probabilities null.

    Sites are a stored table, so Spark broadcasts them only if their size allows it.
    """
    table, levels = sites
    names = [f"{h}_{x}" for h in HEADS for x in ("sum", "n", "host_sum", "host_n")]
    s = table.select(F.col("host").alias("_host"), F.col("path").alias("_path"), *[F.col(x).alias(f"_site_{x}") for x in names])
    rows = evidence.join(s, evidence[host].eqNullSafe(s._host) & evidence[path].eqNullSafe(s._path), "left")
    for h in HEADS:
        mean, host_strength, path_strength = levels[h]
        own = _rate(F.col(f"_{h}"))
        host_rate = (F.col(f"_site_{h}_host_sum") - own + host_strength * mean) / (F.col(f"_site_{h}_host_n") - 1 + host_strength)
        rate = (F.col(f"_site_{h}_sum") - own + path_strength * host_rate) / (F.col(f"_site_{h}_n") - 1 + path_strength)
        shift = _logit(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), rate))) - float(np.log(mean / (1 - mean)))
        rows = rows.withColumn(f"p_{h}", _rate(F.col(f"_{h}") + shift))
    bad = (F.col("p_quality") < 0.5) | (F.col("p_toxic") > 0.5)
    return rows.withColumn("keep", ~F.coalesce(bad, F.lit(False))).drop("_host", "_path", *[f"_site_{x}" for x in names])


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """One row per row of ``docs``: key, evidence_quality, evidence_toxic, p_quality, p_toxic, keep.

    A site's host and path are any two columns, here the source and the language in it; nulls are a site of their own.
    """
    model = train(docs, labels, key, text)
    narrow = stored(with_evidence(docs, model, text, list(dict.fromkeys([key, host, path]))), "evidence")
    out = judged(narrow, site_rates(narrow, host, path), host, path)
    return out.select(key, F.col("_quality").alias("evidence_quality"), F.col("_toxic").alias("evidence_toxic"), "p_quality", "p_toxic", "keep")


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns, whatever their names."""
    model = train(docs, labels, key, text)
    held = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    tagged = docs.select(*[F.col(c).alias(h) for c, h in held.items()])
    scored = stored(with_evidence(tagged, model, held[text]), "scored")  # texts are scored once and not shuffled
    out = judged(scored, site_rates(scored, held[host], held[path]), held[host], held[path]).where("keep")
    return out.select(*[F.col(h).alias(c) for c, h in held.items()])
