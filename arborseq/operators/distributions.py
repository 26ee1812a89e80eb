"""Tables that set real values beside those of null models: histograms, cumulative shares, statistics.

Values come as (shuffle, trial, value), the real ones as shuffle 'original'.  They are counted once, by (shuffle, trial,
value), into a stored table that all results read; counts of two runs add up, so tables of trials can be merged.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored
from .stats import z_score

REAL = "original"
GROUP = ["shuffle", "trial"]


class Distribution(NamedTuple):
    """``pdf`` (shuffle, bin, low, high, n, per_trial), ``cdf`` (shuffle, trial, value, n, percent) and ``stats`` (shuffle, n, trials, mean, median, std)."""

    pdf: DataFrame
    cdf: DataFrame
    stats: DataFrame


def counted(values: DataFrame, value: str) -> DataFrame:
    """(shuffle, trial, value, n), stored: how often each value occurs; null values and NaN are left out."""
    v = F.col(value).cast("double")
    return stored(values.where(v.isNotNull() & ~F.isnan(v)).groupBy(*GROUP, v.alias("value")).agg(F.count(F.lit(1)).alias("n")), "counts")


def _binned(v: Column, edges: list[float]) -> Column:
    """Place of the half-open bin a value is in, the last one closed; null outside."""
    last = len(edges) - 2
    return reduce(lambda c, i: c.when((v >= edges[i]) & ((v < edges[i + 1]) | ((v == edges[i + 1]) & F.lit(i == last))), i), range(len(edges) - 1), F)


def pdf(counts: DataFrame, edges: list[float], trials: int | None = None) -> DataFrame:
    """(shuffle, bin, low, high, n, per_trial): every bin of every model, empty ones too; values outside the edges are dropped.

    All trials of a model lie in one histogram.  ``per_trial`` divides by ``trials``, or by the model's trials that have
    values, so that it can be set beside the real histogram, which is one trial.
    """
    of = F.when(F.col("shuffle") == REAL, F.lit(1)).otherwise(F.lit(trials) if trials else F.col("_trials"))
    models = counts.groupBy("shuffle").agg(F.countDistinct("trial").alias("_trials"))
    ends = F.array(*[F.lit(float(e)) for e in edges])
    bins = models.select("shuffle", of.alias("_of"), F.explode(F.sequence(F.lit(0), F.lit(len(edges) - 2))).alias("bin"))
    full = counts.select("shuffle", "n", _binned(F.col("value"), [float(e) for e in edges]).alias("bin")).where("bin is not null").groupBy("shuffle", "bin").agg(F.sum("n").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return bins.join(full, ["shuffle", "bin"], "left").select("shuffle", "bin", F.element_at(ends, F.col("bin") + 1).alias("low"), F.element_at(ends, F.col("bin") + 2).alias("high"), n.alias("n"), (n / F.col("_of")).alias("per_trial"))


def _running(counts: DataFrame) -> DataFrame:
    """(shuffle, trial, value, n, end, total): running counts of each null trial and, with a null trial, of each model as a whole.

    Groups are cut by ranges of (model, trial, value) taken from the data, so one that holds most rows is many tasks' work;
    each range runs by itself, from where those before it end.
    """
    whole = counts.groupBy("shuffle", "value").agg(F.sum("n").alias("n")).select("shuffle", F.lit(None).cast(counts.schema["trial"].dataType).alias("trial"), "value", "n")
    every = counts.where(F.col("shuffle") != REAL).select(*GROUP, "value", "n").union(whole)
    parts = max(1, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = stored(every.repartitionByRange(parts, *GROUP, "value").withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(*GROUP, "_part").agg(F.sum("n").alias("_size"))  # a row for each range of a group
    group = Window.partitionBy(*GROUP)
    before = sizes.select(F.col("shuffle").alias("_s"), F.col("trial").alias("_t"), F.col("_part").alias("_p"), (F.sum("_size").over(group.orderBy("_part")) - F.col("_size")).alias("_before"), F.sum("_size").over(group).alias("total"))
    inner = Window.partitionBy(*GROUP, "_part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = ranged.withColumn("_end", F.sum("n").over(inner)).join(before, (F.col("shuffle") == F.col("_s")) & F.col("trial").eqNullSafe(F.col("_t")) & (F.col("_part") == F.col("_p")))
    return met.select(*GROUP, "value", "n", (F.col("_end") + F.col("_before")).alias("end"), "total")


def _cdf(running: DataFrame) -> DataFrame:
    return running.select(*GROUP, "value", "n", (F.col("end") * 100.0 / F.col("total")).alias("percent"))


def cdf(counts: DataFrame) -> DataFrame:
    """(shuffle, trial, value, n, percent): the share of values up to each value, with how many are equal to it.

    A row's trial is null where all trials of a model are taken together; the real values have such rows only.
    """
    return _cdf(_running(counts))


def _stats(counts: DataFrame, running: DataFrame) -> DataFrame:
    sums = counts.groupBy("shuffle").agg(F.sum("n").alias("n"), F.countDistinct("trial").alias("trials"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))  # a row for each model
    spread = counts.join(sums.select("shuffle", "mean"), "shuffle").groupBy("shuffle").agg(F.sqrt(F.sum(F.col("n") * (F.col("value") - F.col("mean")) ** 2) / F.sum("n")).alias("std"))
    # the values at the middle places, told by the running counts
    at = lambda place: F.min(F.when(F.col("end") >= place, F.col("value")))
    middle = running.where("trial is null").groupBy("shuffle").agg(((at(F.floor((F.col("total") + 1) / 2)) + at(F.ceil((F.col("total") + 1) / 2))) / 2).alias("median"))
    return sums.join(spread, "shuffle").join(middle, "shuffle").select("shuffle", "n", "trials", "mean", "median", "std")


def stats(counts: DataFrame) -> DataFrame:
    """(shuffle, n, trials, mean, median, std) over all trials of each model, with the population deviation."""
    return _stats(counts, _running(counts))


def distribution(values: DataFrame, value: str, edges: list[float], trials: int | None = None) -> Distribution:
    """All three tables of (shuffle, trial, ``value``); the values are evaluated once."""
    counts = counted(values, value)
    running = stored(_running(counts), "running")
    return Distribution(pdf(counts, edges, trials), _cdf(running), _stats(counts, running))


def count_histogram(counts: DataFrame, bins: int = 5, z_of: str | None = None) -> DataFrame:
    """(shuffle, bin, low, high, n, real, z_low, z_high) from the trials' counts (shuffle, trial, n).

    Each null model has ``bins`` equal bins over its own range, widened by a half both ways if that is one number.
    ``real`` is the real count; ``z_low`` and ``z_high`` are the bin's ends as z-scores of the model ``z_of``, null if
    it has no spread or isn't named.
    """
    null = counts.where(F.col("shuffle") != REAL)
    flat = F.min("n") == F.max("n")
    span = null.groupBy("shuffle").agg(*[(f("n") + F.when(flat, by).otherwise(0.0)).alias(c) for c, f, by in (("_lo", F.min, -0.5), ("_hi", F.max, 0.5))])
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.least(F.floor((F.col("n") - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    full = null.join(span, "shuffle").groupBy("shuffle", place.alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    scale = counts.agg(F.max(F.when(F.col("shuffle") == REAL, F.col("n"))).alias("real"), *[f(F.when(F.col("shuffle") == F.lit(z_of), F.col("n"))).alias(c) for c, f in (("_mean", F.avg), ("_std", F.stddev_pop))])
    rows = span.select("shuffle", "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).join(full, ["shuffle", "bin"], "left").crossJoin(F.broadcast(scale))  # scale is one row
    low, high = F.col("_lo") + F.col("bin") * width, F.col("_lo") + (F.col("bin") + 1) * width
    return rows.select("shuffle", "bin", low.alias("low"), high.alias("high"), F.coalesce("_n", F.lit(0)).alias("n"), "real", *[z_score(c, F.col("_mean"), F.col("_std")).alias(z) for c, z in ((low, "z_low"), (high, "z_high"))])
