"""Scans, lookups and sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import VOXEL_NM, rescaled
from ..schemas import EXCITATORY, INHIBITORY, UNKNOWN


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the tables in a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(n[: -len(".parquet")] for n in (f.getPath().getName() for f in found) if n.endswith(".parquet"))


def sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(name, n): the tables in a folder with their numbers of rows."""
    each = [table(spark, folder, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name in names(spark, folder)]
    return reduce(DataFrame.union, each)


def with_counts(df: DataFrame, key: str, count_name: str = "n") -> DataFrame:
    """Rows with how often their key occurs; counted apart and joined, so a frequent key is one row until then."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias(count_name))
    return df.join(counts, key)


def versioned(spark: SparkSession, root: str, version: str, name: str) -> DataFrame:
    """A table of one dataset version, kept in a folder of its own."""
    return table(spark, f"{root}/{version}", name)


def scan(df: DataFrame, columns: Sequence[str] | None = None, isin: dict[str, Sequence] | None = None, equal: dict | None = None, limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Project and filter by IN and equality predicates, which reach the source; a limit needs an order to be repeatable."""
    for c, values in (isin or {}).items():
        df = df.where(F.col(c).isin(list(values)))
    for c, value in (equal or {}).items():
        df = df.where(F.col(c) == F.lit(value))
    if columns is not None:
        df = df.select(*columns)
    if limit is not None:
        if not order:
            raise ValueError("a limit needs an order")
        df = df.orderBy(*order).limit(limit)
    return df


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row for each key, the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key, the last by ``order``; one aggregate, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def keys_repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).count().where("count > 1").select(*keys)


def cells(df: DataFrame, types: Sequence[str] | None = None, key: str = "pt_root_id", position: str = "pt_position", voxel=VOXEL_NM) -> DataFrame:
    """Cell table: filter by type, voxels to micrometres, one row per cell (the first by type, then position)."""
    if types is not None:
        df = df.where(F.col("cell_type").isin(list(types)))
    out = df.select(F.col(key).alias("cell_id"), "cell_type", *rescaled(F.col(position), voxel))
    return keep_first(out, ["cell_id"], ["cell_type", "x", "y", "z"])


def excitatory_cells(df: DataFrame, **kw) -> DataFrame:
    return cells(df, EXCITATORY, **kw)


def inhibitory_cells(df: DataFrame, **kw) -> DataFrame:
    return cells(df, INHIBITORY, **kw)


def with_cell_types(synapses: DataFrame, cell_types: DataFrame | None, pre: str = "pre_cell", post: str = "post_cell") -> DataFrame:
    """Add cell_type_pre and cell_type_post; a cell without an entry, or no table at all, gives 'Unknown'.

    Of several entries of a cell the first by name counts.  Whether the table is broadcast is Spark's choice by size.
    """
    out = synapses
    if cell_types is not None:
        one = cell_types.groupBy("cell_id").agg(F.min("cell_type").alias("cell_type"))
    for side, key in (("pre", pre), ("post", post)):
        name = f"cell_type_{side}"
        if cell_types is None:
            out = out.withColumn(name, F.lit(UNKNOWN))
        else:
            lookup = one.select(F.col("cell_id").alias(f"_{side}"), F.col("cell_type").alias(name))
            out = out.join(lookup, F.col(key) == F.col(f"_{side}"), "left").drop(f"_{side}").withColumn(name, F.coalesce(name, F.lit(UNKNOWN)))
    return out


def synapses(df: DataFrame, cell_types: DataFrame | None = None, post_ids: DataFrame | None = None, pre_ids: DataFrame | None = None, position: str = "ctr_pt_position", voxel=VOXEL_NM) -> DataFrame:
    """Synapse table: restricted to wanted post and pre cells, typed, voxels to micrometres.

    Both restrictions hold together and no number of rows is capped.
    """
    out = df.select(F.col("id").alias("syn_id"), F.col("pre_pt_root_id").alias("pre_cell"), F.col("post_pt_root_id").alias("post_cell"), "size", *rescaled(F.col(position), voxel))
    for ids, key in ((post_ids, "post_cell"), (pre_ids, "pre_cell")):
        if ids is not None:
            out = out.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")
    return with_cell_types(out, cell_types)


def csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; where there is none it is computed and written through."""
    if not exists(spark, f"{path}/_SUCCESS"):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def missing(wanted: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``wanted`` whose keys ``done`` lacks: what is left to do when a job is taken up again."""
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")


def write_trials(df: DataFrame, path: str) -> None:
    """Trial store, a folder for each shuffle and trial; only those in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shuffle", "trial").parquet(path)


def read_trials(spark: SparkSession, path: str, shuffle: str | None = None, trial: int | None = None) -> DataFrame:
    """Trials by partition discovery; the filters prune folders."""
    df = spark.read.parquet(path)
    if shuffle is not None:
        df = df.where(F.col("shuffle") == shuffle)
    if trial is not None:
        df = df.where(F.col("trial") == trial)
    return df


def with_root(nodes: DataFrame, root: DataFrame) -> DataFrame:
    """Nodes with a root row (-1) for each cell of ``root`` (cell_id, x, y, z)."""
    row = root.select("cell_id", F.lit(-1).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), "x", "y", "z", F.lit(UNKNOWN).alias("cell_type"))
    return nodes.unionByName(row, allowMissingColumns=True)
