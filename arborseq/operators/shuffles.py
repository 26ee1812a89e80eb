"""Null models: shuffles of a branch's inputs over its fixed positions.

Branches are nested (one row each), and every draw is a stateless uniform of
(seed, trial, cell, branch, place).  So all trials of a model are one pass over
the branches, without a shuffle, and repeat exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normal import quantiles
from ..functions.rng import draw_key, uniform
from ..functions.shipping import ship

MODELS = ("original", "random", "type", "axon", "continuous")


def with_trials(branches: DataFrame, trials: int) -> DataFrame:
    return branches.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))


def _place(seq: Column, slot_of: Column) -> Column:
    """Elements moved: slot_of is an array of struct(slot, element) sorted by slot; positions stay with their slots."""
    def build(p):
        e, s = F.element_at(seq, p["element"] + 1), F.element_at(seq, p["slot"] + 1)
        return F.struct(e["syn_id"].alias("syn_id"), e["pre_cell"].alias("pre_cell"), e["cell_type"].alias("cell_type"), s["x"].alias("x"), s["y"].alias("y"), s["z"].alias("z"))

    return F.transform(slot_of, build)


def _keys(seed: int) -> Column:
    return F.transform(F.col("seq"), lambda e, i: F.struct(draw_key(seed, F.col("trial"), F.col("post_cell"), F.col("branch_id"), i).alias("key"), i.alias("element")))


def random(branches: DataFrame, trials: int = 1, seed: int = 0) -> DataFrame:
    """A uniform permutation of all inputs; the element of random rank r moves to slot r."""
    order = F.array_sort(_keys(seed))
    moved = F.transform(order, lambda p, slot: F.struct(slot.alias("slot"), p["element"].alias("element")))
    return with_trials(branches, trials).withColumn("seq", _place(F.col("seq"), moved)).withColumn("shuffle", F.lit("random"))


def by_type(branches: DataFrame, trials: int = 1, seed: int = 0) -> DataFrame:
    """A permutation among the slots of each type; the sequence of types stays."""
    seq = F.col("seq")
    shuffled = F.array_sort(F.transform(_keys(seed), lambda p: F.struct(F.element_at(seq, p["element"] + 1)["cell_type"].alias("t"), p["key"].alias("key"), p["element"].alias("element"))))
    slots = F.array_sort(F.transform(seq, lambda e, i: F.struct(e["cell_type"].alias("t"), i.alias("slot"))))
    moved = F.array_sort(F.zip_with(slots, shuffled, lambda s, e: F.struct(s["slot"].alias("slot"), e["element"].alias("element"))))
    return with_trials(branches, trials).withColumn("seq", _place(seq, moved)).withColumn("shuffle", F.lit("type"))


def clean_probs(p: Column) -> Column:
    """NaN, null and negative to 0, normalised to 1; uniform if nothing is left."""
    ok = F.transform(p, lambda v: F.when(v.isNull() | F.isnan(v) | (v < 0), 0.0).otherwise(v))
    total = F.aggregate(ok, F.lit(0.0), lambda s, v: s + v)
    return F.transform(ok, lambda v: F.when(total == 0, 1.0 / F.size(p)).otherwise(v / total))


def draw_without_replacement(scores: np.ndarray, u: np.ndarray) -> np.ndarray:
    """For each trial (row of ``u``) the columns drawn, row by row of the scores, used columns out.

    A row draws the first column whose cumulated weight exceeds its number; a row without weight left is uniform over
    what is left.  All trials take a row's draw together.
    """
    return _draws(scores[None], u[None])[0]


def _draws(scores: np.ndarray, u: np.ndarray) -> np.ndarray:
    """``draw_without_replacement`` for many branches of one length: scores (branch, row, column), numbers and results (branch, trial, row)."""
    branches, trials, n = u.shape
    weights = np.where(np.isfinite(scores) & (scores > 0), scores, 0.0)
    free = np.ones((branches, trials, n), dtype=bool)
    out = np.zeros((branches, trials, n), dtype=np.int32)
    b, t = np.ogrid[:branches, :trials]
    for i in range(n):
        p = np.where(free, weights[:, i, None], 0.0)
        total = p.sum(axis=2, keepdims=True)
        p = np.where(total > 0, p, free)
        reached = np.cumsum(p / p.sum(axis=2, keepdims=True), axis=2) > u[:, :, i, None]
        last = n - 1 - (p[:, :, ::-1] > 0).argmax(axis=2)
        out[:, :, i] = np.where(reached.any(axis=2), np.minimum(reached.argmax(axis=2), last), last)
        free[b, t, out[:, :, i]] = False
    return out


#: Entries of matrices and draws that are worked on at once, about.
ENTRIES = 2_000_000


def _permuted(scores: pa.ListArray, draws: pa.ListArray, invert: bool) -> pa.ListArray:
    """For each branch a permutation for each trial: branches of one length together."""
    n, trials, rows, lines = (x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (scores, draws, scores.flatten(), draws.flatten()))
    if not np.array_equal(rows, np.repeat(n, n)) or not np.array_equal(lines, np.repeat(n, trials)):
        raise ValueError("a score matrix doesn't fit its branch")
    m, u = (x.flatten().flatten().to_numpy(zero_copy_only=False) for x in (scores, draws))
    first, begin = np.cumsum(n * n) - n * n, np.cumsum(trials * n) - trials * n
    out = np.zeros(len(u), dtype=np.int32)
    order = np.lexsort((trials, n))
    for like in np.split(order, np.flatnonzero(np.diff(n[order]) | np.diff(trials[order])) + 1):
        k, t = (int(x[like[0]]) if len(like) else 0 for x in (n, trials))
        if not k * t:
            continue
        most = max(1, ENTRIES // (k * (k + t)))
        for some in np.split(like, range(most, len(like), most)):
            at = begin[some, None] + np.arange(t * k)
            p = _draws(m[first[some, None] + np.arange(k * k)].reshape(-1, k, k), u[at].reshape(-1, t, k))
            out[at] = (np.argsort(p, axis=2, kind="stable") if invert else p).reshape(-1, t * k)
    inner = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lines)).astype(np.int32)), pa.array(out))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(trials)).astype(np.int32)), inner)


def axon(branches: DataFrame, trials: int = 1, seed: int = 0, invert: bool = False) -> DataFrame:
    """Inputs drawn by their score at each place; ``branches`` has ``scores``, a row of the matrix for each element.

    Slot i takes the element that row i drew; ``invert`` puts element i at the place that row i drew.  A branch whose
    matrix doesn't fit its length is an error.  A branch's matrix goes to its task once, for all trials.
    """
    ship(branches.sparkSession)

    def permutations(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.drop_columns(["scores", "_draws"]).append_column("_perms", _permuted(batch.column("scores"), batch.column("_draws"), invert))

    every = F.sequence(F.lit(0), F.lit(trials - 1))
    draws = F.transform(every, lambda t: F.transform("seq", lambda e, i: uniform(seed, t, F.col("post_cell"), F.col("branch_id"), i, "axon")))
    rows = branches.withColumn("_draws", draws)
    kept = [f for f in rows.schema.fields if f.name not in ("scores", "_draws")]
    rows = rows.mapInArrow(permutations, T.StructType([*kept, T.StructField("_perms", T.ArrayType(T.ArrayType(T.IntegerType())))]))
    rows = with_trials(rows, trials).withColumn("_perm", F.element_at("_perms", F.col("trial") + 1)).drop("_perms")
    moved = F.transform("_perm", lambda p, slot: F.struct(slot.alias("slot"), p.alias("element")))
    return rows.withColumn("seq", F.when(F.size("seq") >= 2, _place(F.col("seq"), moved)).otherwise(F.col("seq"))).drop("_perm").withColumn("shuffle", F.lit("axon"))


def continuous(branches: DataFrame, trials: int = 1, seed: int = 0, move: bool = False, literal_positions: bool = False) -> DataFrame:
    """Each input falls on a segment by its probabilities and within it by a truncated normal; slots fill in that order.

    ``branches`` has ``segs``: for each element an array of struct(mu, sigma, prob) over the segments, or null for
    branches of fewer than three elements, which stay.  With ``move`` an input takes its own new position on the
    segment; ``literal_positions`` leaves the new positions in the old order of elements instead.
    """
    ship(branches.sparkSession)
    rows = with_trials(branches, trials)
    parts = [F.col("trial"), F.col("post_cell"), F.col("branch_id")]
    us = F.transform("segs", lambda e, i: uniform(seed, *parts, i, "segment"))
    within = F.transform("segs", lambda e, i: uniform(seed, *parts, i, "within"))

    @F.arrow_udf("array<struct<s:int,t:double>>")
    def fallen_on(segs: pa.Array, us: pa.Array, within: pa.Array) -> pa.Array:
        return falls(segs, us, within)

    rows = rows.withColumn("_on", fallen_on(F.col("segs"), us, within))
    # the draws go along with their elements, so no lambda reaches back for them
    rows = rows.withColumn("_fallen", F.transform("_on", lambda f, i: F.struct((f["s"] + f["t"]).alias("value"), i.alias("element"), f["s"].alias("s"), f["t"].alias("t"))))
    rows = rows.withColumn("_order", F.array_sort("_fallen"))
    seq = F.col("seq")
    moved = F.transform("_order", lambda p, slot: F.struct(slot.alias("slot"), p["element"].alias("element")))
    new = _place(seq, moved)
    if move:
        def build(p, q):
            e = F.element_at(seq, p["element"] + 1)
            a, b = F.element_at(seq, (q["s"] + 1).cast("int")), F.element_at(seq, (q["s"] + 2).cast("int"))
            return F.struct(e["syn_id"].alias("syn_id"), e["pre_cell"].alias("pre_cell"), e["cell_type"].alias("cell_type"), *[(a[c] + q["t"] * (b[c] - a[c])).alias(c) for c in "xyz"])

        new = F.zip_with("_order", "_fallen" if literal_positions else "_order", build)
    return rows.withColumn("seq", F.when(F.col("segs").isNotNull(), new).otherwise(seq)).drop("segs", "_on", "_fallen", "_order").withColumn("shuffle", F.lit("continuous"))


def falls(segs: pa.ListArray, us: pa.ListArray, within: pa.ListArray) -> pa.Array:
    """For each element of each row the first segment whose cumulated cleaned probability exceeds its number of ``us``, and where within it falls."""
    elements = segs.flatten()
    n = elements.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    first, each = np.cumsum(n) - n, elements.flatten()
    mu, sigma, prob = (each.field(c).to_numpy(zero_copy_only=False) for c in ("mu", "sigma", "prob"))
    u, inside = (x.flatten().to_numpy() for x in (us, within))
    ok = np.where(prob >= 0, prob, 0.0)
    most = int(n.max(initial=0))
    there = [np.flatnonzero(n > k) for k in range(most)]
    total, reached, chosen = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n), dtype=np.int32)
    for k, at in enumerate(there):
        total[at] += ok[first[at] + k]
    for k, at in enumerate(there):
        some = total[at] > 0
        reached[at] += np.where(some, ok[first[at] + k] / np.where(some, total[at], 1.0), 1.0 / n[at])
        chosen[at] += reached[at] <= u[at]
    chosen = np.minimum(chosen, n - 1).astype(np.int32)
    place = first + chosen
    t = quantiles(mu[place], sigma[place], inside)
    null = segs.is_null()
    sizes = segs.value_lengths().fill_null(0).to_numpy()
    rows = pa.StructArray.from_arrays([pa.array(chosen), pa.array(t)], names=["s", "t"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), rows, mask=null)


def shuffle(branches: DataFrame, model: str, trials: int = 1, seed: int = 0, **kw) -> DataFrame:
    """Shuffled branches with columns ``shuffle`` and ``trial``; 'original' is one trial of the branches as they are."""
    if model == "original":
        return with_trials(branches, 1).withColumn("shuffle", F.lit("original"))
    models = {"random": random, "type": by_type, "axon": axon, "continuous": continuous}
    if model not in models:
        raise ValueError(f"no shuffle is named {model!r}; there are {', '.join(MODELS)}")
    need = {"axon": "scores", "continuous": "segs"}.get(model)
    if need and need not in branches.columns:
        raise ValueError(f"{model} needs a column {need}")
    return models[model](branches, trials, seed, **kw)
