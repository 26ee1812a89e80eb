"""Filter interaction audit: what each filter of a chain removes, in every order the chain could have.

A document is reduced to a mask, a bit for each filter it fails; per part and mask the documents are counted, so what
follows has at most 2^filters rows for each part, whatever the number of documents.  Those mask cells are unpivoted
against the steps of every order.  Running bit-or windows over the steps tell what failed earlier, conditional sums give
each step's counts, and a window over all orders totals what a filter removes.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

#: Letters of the filters, in the order of their bits.
FILTERS = "ABCDE"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures(text: Column, least_words: int = 200, least_distinct: int = 50, most_upper: int = 2, banned: str = "[#$%&*|]") -> Column:
    """The mask of filters A to D (bits 0 to 3) that a text fails; null counts as empty.

    A: fewer than ``least_words`` words; B: under ``least_distinct`` percent of them distinct; C: over ``most_upper``
    percent of the code points are A-Z; D: a ``banned`` character.
    """
    words = F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")
    n = F.size(words).cast("long")
    upper = (F.octet_length(text) - F.octet_length(F.translate(text, UPPER, ""))).cast("long")
    fails = [n < least_words, F.size(F.array_distinct(words)) * 100 < n * least_distinct, upper * 100 > F.char_length(text) * most_upper, F.rlike(text, F.lit(banned))]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails[1:], 1)), F.when(fails[0], 1).otherwise(0)).cast("int")


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", **limits) -> DataFrame:
    """id, part, mask (A to D), digest, size, good, toxic of every row; narrow, so no text is shuffled.

    Labels join by key, one row for each: a document is good if any of its labels has quality 1, toxic if any has toxic 1.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("body"))
    rows = rows.select("id", "part", failures(F.col("body"), **limits).alias("mask"), F.unhex(F.sha2("body", 256)).alias("digest"), F.octet_length("body").alias("size"))
    marks = labels.groupBy(F.col("doc_id").alias("label")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return rows.join(marks, F.col("id") == F.col("label"), "left").select("id", "part", "mask", "digest", "size", *flags)


def cells(rows: DataFrame) -> DataFrame:
    """part, mask (A to E), n, good, toxic: how many of ``judged`` rows fail exactly which filters.

    Filter E fails rows whose text has a smaller key anywhere.  Of each text the smallest key is found by a grouping that
    is combined before its shuffle, and meets its rows on text and key together: copies of one text, however many, spread
    by their keys, and what doesn't meet fails.  A null key is neither smaller nor larger than others and never fails;
    rows that repeat a key and text don't fail each other.
    """
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")]
    counted = [F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")]
    total = rows.groupBy("part", "mask").agg(*counted)
    known = rows.where("id is not null")
    first = known.groupBy("digest", "size").agg(F.min("id").alias("id"))
    # repeated rows of one document are one row here
    alike = known.groupBy("id", "digest", "size", "part", "mask").agg(*counted)
    kept = alike.join(first, ["id", "digest", "size"], "left_semi").unionByName(rows.where("id is null").groupBy("id", "digest", "size", "part", "mask").agg(*counted))
    kept = kept.groupBy("part", "mask").agg(*sums)
    e = 1 << FILTERS.index("E")
    later = total.unionByName(kept.select("part", "mask", *[(-F.col(c)).alias(c) for c in ("n", "good", "toxic")])).groupBy("part", "mask").agg(*sums)
    return kept.unionByName(later.where("n > 0").withColumn("mask", F.col("mask").bitwiseOR(e)))


def interactions(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from mask cells (part, mask, n, good, toxic)."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    steps = masks.withColumn("filter_order", F.explode(orders))
    steps = steps.select("*", F.posexplode(F.split("filter_order", "")).alias("place", "filter"))
    bit = F.element_at(F.create_map(*[x for i, f in enumerate(filters) for x in (F.lit(f), F.lit(1 << i))]), F.col("filter"))
    steps = steps.withColumn("bit", bit).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    earlier = Window.partitionBy("part", "mask", "filter_order").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("before", F.coalesce(F.bit_or("fails").over(earlier), F.lit(0)))
    here = (F.col("fails") != 0) & (F.col("before") == 0)

    def total(c: str, when: Column, name: str) -> Column:
        return F.sum(F.when(when, F.col(c)).otherwise(0)).alias(name)

    out = steps.groupBy("part", "filter_order", (F.col("place") + 1).cast("int").alias("step"), "filter").agg(
        total("n", (F.col("fails") == 0) & (F.col("before") == 0), "kept"),
        total("n", here, "removed"),
        total("n", (F.col("fails") != 0) & (F.col("before") != 0), "redundant"),
        total("n", F.col("mask") == F.col("bit"), "unique_fails"),
        total("good", here, "good_lost"),
        total("toxic", here, "toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", **limits) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null part counts as an empty one, a null text as empty.  Every part has all orders and steps, zeros included; an
    empty table has no part and no rows.  Columns of ``docs`` other than the three named play no part.
    """
    rows = stored(judged(docs, labels, key, text, part, **limits), "judged")
    masks = stored(cells(rows), "mask-cells")  # at most 32 rows for each part
    discard(rows)
    return interactions(masks)
