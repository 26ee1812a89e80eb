"""Branch pairs of different cells that share input cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import discard, stored
from .sequences import BRANCH

PAIR = ["cell_a", "branch_a", "cell_b", "branch_b"]
#: A list of branches is extended by one more element if its pairs outnumber this many times the rows that makes.
PATIENCE = 4


def cell_sets(rows: DataFrame) -> DataFrame:
    """Sorted distinct input cells of each branch."""
    return rows.groupBy(*BRANCH).agg(F.sort_array(F.collect_set("pre_cell")).alias("s"))


def by_rarity(sets: DataFrame) -> DataFrame:
    """The same sets, each in the order in which its elements become more frequent over all branches; ties by element."""
    each = sets.select(*BRANCH, F.explode("s").alias("e"))
    often = each.groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    return each.join(often, "e").groupBy(*BRANCH).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "e"))), lambda x: x["e"]).alias("s"))


def _marks(s, first) -> Column:
    """64 bits, one for the hash of each element of ``s`` from place ``first`` on; all set where there are more elements than bits."""
    left = F.slice(s, first + 1, F.greatest(F.size(s) - first, F.lit(0)))
    bits = F.aggregate(left, F.lit(0).cast("long"), lambda m, e: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(e), F.lit(64)).cast("int"))))
    return F.when(F.size(s) - first > 64, F.lit(-1).cast("long")).otherwise(bits)


def candidates(sets: DataFrame, k: int, patience: float = PATIENCE) -> DataFrame:
    """PAIR of the branches that may share ``k`` elements, each once; ``sets`` hold theirs in one common order.

    Sets that share k elements share the first l of them within the first ``size - k + l``, for every l.  So an inverted
    index lists branches by single elements of their prefixes; where a list is so long that its pairs cost more than
    listing its branches anew under one further element each, that is done instead, up to k elements, where a meeting is
    a result.  Whether a list is extended is a property of its key, so two branches that share k elements follow their
    first ones in common through the same extensions and meet.  Lists hold keys, sizes, places and ``_marks`` of what
    comes after, no sets: two branches that need more elements in common than the key has a mark in common, too.
    """
    met: list[DataFrame] = []
    keys = ["e1"]
    size = F.size("s")
    level = sets.select(*BRANCH, size.alias("size"), "s", F.posexplode(F.slice("s", F.lit(1), size - (k - 1))).alias("at", "e1"))
    made: list[DataFrame] = []
    for n in range(1, k + 1):
        # what one further element makes of a list's branches, against its pairs
        more = F.sum(F.col("size") - (k - n) - F.col("at")) if n < k else F.lit(None).cast("long")
        lists = level.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), more.alias("more")).where("n > 1")
        long_ = F.coalesce(F.col("n").cast("double") * (F.col("n") - 1) / 2 > patience * F.col("more"), F.lit(False))
        level = level.withColumn("marks", _marks(F.col("s"), F.col("at") + 1)).drop("s")
        level = stored(level.join(lists.select(*keys, long_.alias("long")), keys), f"pairs-{n}")
        made.append(level)
        short = level.where(~F.col("long"))
        a, b = short.alias("a"), short.alias("b")
        same = reduce(lambda c, e: c & (F.col(f"a.{e}") == F.col(f"b.{e}")), keys, F.col("a.post_cell") < F.col("b.post_cell"))
        if n < k:
            same = same & (F.col("a.marks").bitwiseAND(F.col("b.marks")) != 0)
        met.append(a.join(b, same).select(*[F.col(f"{x}.{c}").alias(name) for (x, c), name in zip([(x, c) for x in "ab" for c in BRANCH], PAIR, strict=True)]))
        if n == k:
            break
        # extended lists: elements after the last one, within the longer prefix
        grown = level.where("long").select(*BRANCH, "size", "at", *keys)
        if grown.isEmpty():
            break
        rest = F.slice("s", F.col("at") + 2, F.greatest(F.col("size") - (k - n - 1) - F.col("at") - 1, F.lit(0)))
        grown = grown.join(sets, BRANCH).select(*BRANCH, "size", "s", *keys, "at", F.posexplode(rest).alias("step", f"e{n + 1}"))
        level = grown.withColumn("at", F.col("at") + 1 + F.col("step")).drop("step")
        keys = [*keys, f"e{n + 1}"]
    out = stored(reduce(DataFrame.union, met).distinct(), "pairs-met")
    discard(*made)
    return out


def similar(rows: DataFrame, k: int = 3, between: DataFrame | None = None, patience: float = PATIENCE, groups: DataFrame | None = None) -> DataFrame:
    """PAIR and n_shared: branches of different cells (cell_a < cell_b) with at least ``k`` input cells in common.

    ``candidates`` meet on their rarest elements, and sets are fetched for those only.  ``between`` (cell_a, cell_b) keeps
    listed cells only, in either order.  ``groups`` (cell, grp) keeps pairs of cells that are in a group together, without
    a list of all such pairs, whose number grows with the square of a group.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    sets = cell_sets(rows).where(F.size("s") >= k)
    if between is not None:
        wanted = between.select(F.least("cell_a", "cell_b").alias("cell_a"), F.greatest("cell_a", "cell_b").alias("cell_b")).where("cell_a <> cell_b").distinct()
        either = wanted.select(F.col("cell_a").alias("post_cell")).union(wanted.select(F.col("cell_b").alias("post_cell"))).distinct()
        sets = sets.join(either, "post_cell", "left_semi")
    if groups is not None:
        member = groups.select("cell", "grp").where("grp is not null").distinct()
        sets = sets.join(member.select(F.col("cell").alias("post_cell")), "post_cell", "left_semi")
    given = stored(sets, "pairs-given")  # counted and ordered from what is stored, not made twice
    sets = stored(by_rarity(given), "pairs-sets")
    discard(given)
    found = candidates(sets, k, patience)
    if between is not None:
        found = found.join(wanted, ["cell_a", "cell_b"], "left_semi")
    if groups is not None:
        a, b = (member.select(F.col("cell").alias(f"cell_{side}"), "grp") for side in "ab")
        found = found.join(a, "cell_a").join(b, ["cell_b", "grp"]).select(*PAIR).distinct()
    common = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    return fetch(found, sets, "s").select(*PAIR, common.alias("n_shared")).where(F.col("n_shared") >= k)


def fetch(pairs: DataFrame, branches: DataFrame, *columns: str) -> DataFrame:
    """Pairs with both branches' columns, suffixed _a and _b."""
    out = pairs
    for side in "ab":
        one = branches.select(F.col("post_cell").alias(f"cell_{side}"), F.col("branch_id").alias(f"branch_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        out = out.join(one, [f"cell_{side}", f"branch_{side}"])
    return out
