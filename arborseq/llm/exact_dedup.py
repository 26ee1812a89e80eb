"""Exact deduplication by a tree-merge of sorted digest runs, in DataFrame operations only.

Every row belongs to one of ``2**bits`` runs by its identifier, about as many as there
are partitions.  Level 0 makes a run's table of distinct digests with the identifier
to retain and the group's size.  In each round runs whose numbers agree above the next
``fan_bits`` bits are merged (``fan_bits=1`` gives the binomial rounds, more bits merge
several runs at once): entries are exchanged, each partition merges what it gets in the
order of run, digest and identifier (Spark's external sort, which spills and merges
sorted runs), and a pass over that order retains the first identifier of each digest
and adds up the sizes.  After the last round one logical run is left, still dealt over
all partitions by digest.

A digest is SHA-256; entries are merged only if an independent second hash and
the length agree too, so every level verifies what it merges.

Skew: a text with a third of all rows is one digest, but in level 0 it is one
entry for each run and task, and the way back from the result to the rows goes
through the runs as well, so its rows stay dealt over all runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import salted_partitions, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; texts of ASCII only take the quick way."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def run_bits(rows: DataFrame) -> int:
    """As many bits as number the partitions, so runs, and with them the salt of a hot digest, grow with the cluster."""
    return (salted_partitions(rows.sparkSession) - 1).bit_length()


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", normal=ascii_lower, bits: int = 6) -> DataFrame:
    """key, digest, check, size, run of every row; null text counts as empty."""
    body = normal(F.coalesce(F.col(text), F.lit("")))
    return docs.select(F.col(key).alias("id"), body.alias("body")).select(
        "id",
        F.unhex(F.sha2("body", 256)).alias("digest"),
        F.xxhash64("body").alias("check"),
        F.octet_length("body").cast("long").alias("size"),
        F.pmod(F.xxhash64("id"), F.lit(1 << bits)).cast("int").alias("run"),
    )


def retained(rows: DataFrame, largest: bool = False, bits: int = 6, fan_bits: int = 1) -> DataFrame:
    """digest, check, size, keep_id, group_size: the last merged run of ``digests`` rows.

    Of equal texts the smallest identifier is retained, or the largest; a null identifier only if there is no other.
    """
    best = F.max if largest else F.min
    n = salted_partitions(rows.sparkSession)
    entry = ["digest", "check", "size"]
    order = F.col("keep_id").desc_nulls_last() if largest else F.col("keep_id").asc_nulls_last()
    merged = Window.partitionBy("run", *entry).orderBy(order)
    whole = merged.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # level 0: partial sums before the exchange leave one entry of a digest for each run and task
    level = rows.groupBy("run", *entry).agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    left = bits
    while left:
        step = min(fan_bits, left)
        left -= step
        met = level.withColumn("run", F.shiftright("run", step)).repartition(n, "run", *entry)
        # a digest has at most 2**step entries here, one for each run that is merged
        met = met.select("run", *entry, "keep_id", F.sum("group_size").over(whole).alias("group_size"), F.row_number().over(merged).alias("_place"))
        level = met.where("_place = 1").drop("_place")
    return level.drop("run")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", normal=ascii_lower, largest: bool = False, bits: int | None = None, fan_bits: int = 1) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when equal after ``normal``.  Rows that repeat an identifier with an equal text are one document
    listed more than once: group_size counts them all, and all or none are kept.  A group of null identifiers only has
    a null keep_id and is kept.  Columns of ``docs`` other than the two named play no part.
    """
    bits = run_bits(docs) if bits is None else bits
    rows = stored(digests(docs, key, text, normal, bits), "digests")
    entry = ["digest", "check", "size"]
    last = retained(rows, largest, bits, fan_bits)
    # down the tree: a digest's result goes to each run that holds it, and rows meet it there
    runs = rows.groupBy("run", *entry).agg(F.count(F.lit(1)).alias("_n")).join(last, entry).drop("_n")
    out = rows.join(runs, ["run", *entry])
    return out.select(
        F.col("id").alias(key),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
