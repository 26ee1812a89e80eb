"""Branches as sequences: collapsing runs, filters, projections, nested forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import polyline_length
from ..schemas import NO_CELL, UNKNOWN

BRANCH = ["post_cell", "branch_id"]
ELEMENT = ["syn_id", "pre_cell", "cell_type", "x", "y", "z"]


def with_cells_only(rows: DataFrame) -> DataFrame:
    """Rows whose pre-synaptic cell is known."""
    return rows.where(F.col("pre_cell").isNotNull() & (F.col("pre_cell") != NO_CELL))


def of_types(rows: DataFrame, valid: Sequence[str] | None, include_unknown: bool = False) -> DataFrame:
    """Rows of valid types, a missing type counting as 'Unknown'; no list, no filter."""
    if valid is None:
        return rows
    return rows.where(F.coalesce("cell_type", F.lit(UNKNOWN)).isin([*valid, *([UNKNOWN] if include_unknown else [])]))


def collapse(rows: DataFrame, valid: Sequence[str] | None = None, keys: Sequence[str] = tuple(BRANCH), recollapse: bool = False) -> DataFrame:
    """Collapse runs of equal pre-cells in each branch; seq_pos is numbered anew.

    A run leaves its first element, but the first of several runs its last.  Types are filtered afterwards, so equal
    neighbours may stand again unless ``recollapse`` collapses once more.  All windows share one partitioning.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("seq_pos")
    whole = Window.partitionBy(*keys)
    before = F.lag("pre_cell").over(w)
    out = with_cells_only(rows).withColumn("_new", (before.isNull() | (before != F.col("pre_cell"))).cast("int"))
    out = out.withColumn("_run", F.sum("_new").over(w)).withColumn("_runs", F.max("_run").over(whole)).withColumn("_next", F.lead("_new").over(w))
    chosen = F.when((F.col("_run") == 1) & (F.col("_runs") > 1), F.col("_next") == 1).otherwise(F.col("_new") == 1)
    out = of_types(out.where(chosen).drop("_new", "_run", "_runs", "_next"), valid)
    out = out.withColumn("seq_pos", F.row_number().over(w) - 1)
    return collapse(out, None, keys) if recollapse else out


def nested(rows: DataFrame, keys: Sequence[str] = tuple(BRANCH)) -> DataFrame:
    """keys and ``seq``, the array of elements in order."""
    ordered = F.array_sort(F.collect_list(F.struct("seq_pos", *ELEMENT)))
    seq = F.transform(ordered, lambda e: F.struct(*[e[c].alias(c) for c in ELEMENT]))
    return rows.groupBy(*keys).agg(seq.alias("seq"))


def nested_ids(rows: DataFrame, keys: Sequence[str] = tuple(BRANCH)) -> DataFrame:
    """keys and ``ids``, the array of pre-cells in order: all that comparisons of length or sequence need."""
    ordered = F.array_sort(F.collect_list(F.struct("seq_pos", "pre_cell")))
    return rows.groupBy(*keys).agg(F.transform(ordered, lambda e: e["pre_cell"]).alias("ids"))


def flat(branches: DataFrame, keys: Sequence[str] = tuple(BRANCH)) -> DataFrame:
    """The inverse of ``nested``.

    Exploded as outer ones, or Spark would work out the arrays once more, and all that they are made of, to tell empty ones.
    """
    rows = branches.select(*keys, F.posexplode_outer("seq").alias("seq_pos", "_e")).where("seq_pos is not null")
    return rows.select(*keys, "seq_pos", *[F.col(f"_e.{c}").alias(c) for c in ELEMENT])


def ids(seq: Column | str) -> Column:
    """The sequence of pre-cells of a nested branch."""
    return F.transform(F.col(seq) if isinstance(seq, str) else seq, lambda e: e["pre_cell"])


def subsequence(seq: Column | str, index: Column | str) -> Column:
    """The elements at the given places (from 0)."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    return F.transform(F.col(index) if isinstance(index, str) else index, lambda i: F.element_at(seq, (i + 1).cast("int")))


def reversed_branches(branches: DataFrame) -> DataFrame:
    return branches.withColumn("seq", F.reverse("seq"))


def unique_only(seq: Column) -> Column:
    """Whether no cell occurs twice in a sequence of ids."""
    return F.size(F.array_distinct(seq)) == F.size(seq)


def summary(raw: DataFrame, collapsed: DataFrame, length: str = "x") -> DataFrame:
    """Per branch: lengths of both variants, distinct cells, median ``length`` of the raw elements (0 where none is known), first and last cell."""
    a = raw.groupBy(*BRANCH).agg(F.count(F.lit(1)).alias("n_raw"), F.coalesce(F.median(length), F.lit(0.0)).alias("branch_length"))
    b = collapsed.groupBy(*BRANCH).agg(
        F.count(F.lit(1)).alias("n_collapsed"), F.countDistinct("pre_cell").alias("n_cells"),
        F.min_by("pre_cell", "seq_pos").alias("first_cell"), F.max_by("pre_cell", "seq_pos").alias("last_cell"),
    )
    return a.join(b, BRANCH, "left").select(*BRANCH, "n_raw", F.coalesce("n_collapsed", F.lit(0)).alias("n_collapsed"), F.coalesce("n_cells", F.lit(0)).alias("n_cells"), "first_cell", "last_cell", "branch_length", F.lit(False).alias("apical"))


def lengths(branches: DataFrame) -> DataFrame:
    """Number of elements and polyline length of nested branches."""
    return branches.select(*BRANCH, F.size("seq").alias("n"), polyline_length(F.col("seq")).alias("length"))


def range_of(df: DataFrame, column: str, ranges: int = 64) -> Column:
    """Number of the range a value falls in; the ranges' bounds are approximate quantiles, so they hold about as many rows each."""
    edges = sorted(set(df.where(F.col(column).isNotNull()).approxQuantile(column, [i / ranges for i in range(1, ranges)], 0.005)))
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>"), lambda e: e <= F.col(column)))


def codes(rows: DataFrame) -> DataFrame:
    """(pre_cell, code): cells numbered densely by id, for encoding sequences as text.

    Each range of ids is numbered by itself, from where the ranges before it end.
    """
    distinct = rows.select("pre_cell").distinct()
    parts = distinct.withColumn("_p", range_of(distinct, "pre_cell"))
    sizes = parts.groupBy("_p").count()  # a row for each range
    before = sizes.select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    w = Window.partitionBy("_p").orderBy("pre_cell")
    return parts.withColumn("_n", F.row_number().over(w)).join(before, "_p").select("pre_cell", (F.col("_start") + F.col("_n") - 1).alias("code"))


def as_text(rows: DataFrame, code_table: DataFrame, keys: Sequence[str] = tuple(BRANCH)) -> DataFrame:
    """Branches as strings of one mark per element, ``.`` before each code; cells without a code leave the mark alone."""
    coded = rows.join(code_table, "pre_cell", "left")
    return coded.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq_pos", F.concat(F.lit("."), F.coalesce(F.col("code").cast("string"), F.lit(""))).alias("m")))), lambda e: e["m"]), "").alias("text"))


def from_flat_data(data: DataFrame) -> DataFrame:
    """Branches from rows of four parallel arrays (cell_seq, syn_seq, pos_seq, type_seq); nothing is collapsed."""
    zipped = F.arrays_zip("cell_seq", "syn_seq", "pos_seq", "type_seq")
    seq = F.transform(zipped, lambda e: F.struct(e["syn_seq"].alias("syn_id"), e["cell_seq"].alias("pre_cell"), e["type_seq"].alias("cell_type"), *[e["pos_seq"][i].alias(c) for i, c in enumerate("xyz")]))
    return data.select(*BRANCH, seq.alias("seq"))
