"""Counting repeated sequences and comparing real data with null models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import polyline_length
from .sequences import ids, range_of, unique_only


def _counted(scored: DataFrame, least: int, unique: bool, basal: bool) -> DataFrame:
    out = scored.where(F.col("score") >= least).withColumn("key", ids("sub_a"))
    if basal:
        out = out.where(~F.col("apical_a") & ~F.col("apical_b"))
    return out.where(unique_only(F.col("key"))) if unique else out


def repeated(scored: DataFrame, by: list[str] | None = None, least: int = 3, unique: bool = False, basal: bool = False) -> DataFrame:
    """(by, key, n): how many pairs share each sequence of ids."""
    return _counted(scored, least, unique, basal).groupBy(*(by or []), "key").agg(F.count(F.lit(1)).alias("n"))


def repeated_branches(scored: DataFrame, by: list[str] | None = None, least: int = 3, unique: bool = False, basal: bool = False) -> DataFrame:
    """(by, key, n): each branch of the lower-id side counts once, by its best pair, the first by (cell_b, branch_b).

    A best pair that fails a filter is not replaced by the next one.
    """
    by = by or []
    order = F.struct(F.col("score"), -F.col("cell_b"), -F.col("branch_b"))
    rest = [c for c in scored.columns if c not in (*by, "cell_a", "branch_a")]
    best = scored.groupBy(*by, "cell_a", "branch_a").agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*by, "cell_a", "branch_a", "_r.*")
    return repeated(best, by, least, unique, basal)


def combinations(sequences: DataFrame, k: int) -> DataFrame:
    """(combo, n): over the repeated sequences ``key``, how many hold each ordered k-combination of places."""
    element = lambda i: F.element_at("key", i)
    rows = sequences.where(F.size("key") >= k)
    grown: Column = F.transform(F.sequence(F.lit(1), F.size("key")), lambda i: F.struct(i.alias("last"), F.array(element(i)).alias("c")))
    for _ in range(k - 1):
        grown = F.flatten(F.transform(grown, lambda p: F.transform(F.filter(F.sequence(F.lit(1), F.size("key")), lambda i: i > p["last"]), lambda i: F.struct(i.alias("last"), F.concat(p["c"], F.array(element(i))).alias("c")))))
    return rows.select(F.explode(grown).alias("p")).groupBy(F.col("p.c").alias("combo")).agg(F.count(F.lit(1)).alias("n"))


def distances(scored: DataFrame, by: list[str] | None = None, least: int = 3, basal: bool = False) -> DataFrame:
    """(by, key, n, mean_distance, per_synapse): mean length of the stretches that carry each sequence, and by its number of cells."""
    rows = _counted(scored, least, False, basal).select(*(by or []), "key", F.explode(F.array(polyline_length(F.col("sub_a")), polyline_length(F.col("sub_b")))).alias("d"))
    return rows.groupBy(*(by or []), "key").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_distance")).withColumn("per_synapse", F.col("mean_distance") / F.size("key"))


def summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, median and population deviation."""
    return df.groupBy(*(by or [])).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_pop(value).alias("std"))


def z_score(real: Column, mean: Column, std: Column) -> Column:
    """Null where the null model has no spread."""
    return F.when(std > 0, (real - mean) / std)


def from_z(z: Column, mean: Column, std: Column) -> Column:
    return z * std + mean


def histogram(df: DataFrame, value: str, edges: list[float] | None = None, bins: int = 5, by: list[str] | None = None, trials: int = 1) -> DataFrame:
    """(by, bin, low, high, n, per_trial); bins are half open but the last, and values outside are dropped.

    Without edges there are ``bins`` equal ones from the least to the largest value, of all rows together.
    """
    by = by or []
    rows = df.select(*by, F.col(value).cast("double").alias("v")).where("v is not null")
    if edges is not None:
        pairs = list(zip(edges, edges[1:], strict=False))
        last = len(pairs) - 1
        bin_ = reduce(lambda c, e: c.when((F.col("v") >= e[1][0]) & ((F.col("v") < e[1][1]) if e[0] < last else (F.col("v") <= e[1][1])), e[0]), enumerate(pairs), F)
        out = rows.withColumn("bin", bin_).where("bin is not null")
        low, high = F.array(*[F.lit(float(p[0])) for p in pairs]), F.array(*[F.lit(float(p[1])) for p in pairs])
        out = out.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
        return out.select(*by, "bin", F.element_at(low, F.col("bin") + 1).alias("low"), F.element_at(high, F.col("bin") + 1).alias("high"), "n", (F.col("n") / trials).alias("per_trial"))
    span = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    out = rows.crossJoin(F.broadcast(span)).withColumn("bin", bin_).groupBy(*by, "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))  # span is one row
    return out.select(*by, "bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n", (F.col("n") / trials).alias("per_trial"))


def log_edges(low: float, high: float, n: int) -> list[float]:
    """``n`` edges evenly spaced in the logarithm; the ends are exact."""
    import math

    a, b = math.log10(low), math.log10(high)
    return [low, *[10 ** (a + (b - a) * i / (n - 1)) for i in range(1, n - 1)], high]


def ecdf(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by, value, percent): 100 k / n for the k-th value; ties aren't merged.

    Values are first counted, then numbered through the running count, so a task holds distinct values of a range only.
    """
    by = by or []
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    if by:
        w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        numbered = counted.withColumn("_end", F.sum("_n").over(w)).withColumn("_total", F.sum("_n").over(Window.partitionBy(*by)))
    else:
        parts = counted.withColumn("_p", range_of(counted, value))
        sizes = parts.groupBy("_p").agg(F.sum("_n").alias("_s"))  # a row for each range
        before = sizes.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"), F.sum("_s").over(Window.partitionBy()).alias("_total"))
        w = Window.partitionBy("_p").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        numbered = parts.withColumn("_end", F.sum("_n").over(w)).join(before, "_p").withColumn("_end", F.col("_end") + F.col("_b"))
    k = F.explode(F.sequence(F.col("_end") - F.col("_n") + 1, F.col("_end")))
    return numbered.select(*by, value, "_total", k.alias("_k")).select(*by, value, (F.col("_k") * 100.0 / F.col("_total")).alias("percent"))
