"""Helpers shared by the training-data operators: shared storage, code shipping, Arrow plumbing."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship as ship_code
from ..sources.storage import shuffles_cleaned


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder in the storage all executors share.

    The cluster names that storage in ``spark.checkpoint.dir``.  Only where the
    session has none (tests in local mode) a temporary folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        base = "file://" + os.path.join(tempfile.gettempdir(), "arborseq-shared")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared storage and read it back: lineage ends there, and its shuffle files go.

    A lost executor costs only the tasks it ran; what is written stays until ``discard``.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    with shuffles_cleaned(spark):
        df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete ``stored`` tables that nothing reads any more."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Most words of 64 bits in the filter that ``parted`` broadcasts: 16 MB.
FILTER_WORDS = 1 << 20


def parted(rows: DataFrame, columns: list[str], wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of which none has its ``columns`` in ``wanted``, the others), told by a bit for each hash.

    The others hold all that are in ``wanted`` and some more, so joins that shuffle can be kept to them.  The filter has
    16 bits for each row of ``wanted``, a stored table that is counted here, up to a bound; where there are so many that
    it would fill up, it would save nothing, and all rows are others.
    """
    size = wanted.count()
    if size > 64 * FILTER_WORDS:
        return rows.where("1 = 0"), rows
    words = min(FILTER_WORDS, 1 << max(10, (size // 4).bit_length()))
    hashed = F.xxhash64(*columns)
    word, bit = F.pmod(hashed, F.lit(words)), F.shiftrightunsigned(hashed, 58).cast("int")
    bits = wanted.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    # the caller's columns travel in a struct, so their names can't clash with those of the filter
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), word.alias("at"), bit.alias("bit"))
    marked = packed.join(F.broadcast(bits), F.col("at") == F.col("word"), "left").withColumn("hit", F.coalesce(F.call_function("getbit", "bits", "bit"), F.lit(0)) == 1)
    return tuple(marked.where(F.col("hit") == x).select("row.*") for x in (False, True))


def ship(spark: SparkSession) -> None:
    """Prepare a session for Python workers: the package's code, and small batches, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(24 << 20))
    ship_code(spark)


def frugal(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that gives memory it has freed back to the system at its end, as workers outlive tasks."""

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


class Numbers(dict):
    """Numbers strings in the order they are first looked up; ``fresh`` gathers those new since it was last emptied."""

    def __init__(self, *args):
        super().__init__(*args)
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Arrow strings as Python strings; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def salted_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
