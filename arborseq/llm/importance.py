"""Target-distribution importance resampling: documents are drawn as likely as their n-grams look like the target's.

Features are hashed runs of one to three words.  A document's features become an array of buckets by higher-order
functions; its weight is the sum over that array of a literal array of gains, with nothing exploded.  What is shuffled
on the way is a total for each bucket and, for ranking, one narrow row for each document.  The arrays are needed twice,
for the totals and then for the weights: they are stored, 14 bits a feature, as making them takes most of the time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, salted_partitions, stored
from .exact_dedup import ascii_lower

BUCKETS = 10_000
#: Between words: all of ASCII but digits and letters (texts are lower case here).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _bound(value: Column, body) -> Column:
    """``body`` of a lambda variable that stands for ``value``, which so is evaluated once however often it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


def buckets_of(words: Column, n_buckets: int = BUCKETS) -> Column:
    """The bucket of every run of one to three words."""

    def runs(shorter: Column, words: Column, n: int) -> Column:
        """Runs of ``n`` words from those of one word less and the words that follow them."""
        m = F.greatest(F.size(words) - (n - 1), F.lit(0))
        return F.zip_with(F.slice(shorter, F.lit(1), m), F.slice(words, F.lit(n), m), lambda x, y: F.concat(x, F.lit(b" "), y))

    def all_runs(one: Column) -> Column:
        return _bound(runs(one, one, 2), lambda two: F.transform(F.concat(one, two, runs(two, one, 3)), lambda s: (F.crc32(s) % n_buckets).cast("int")))

    return _bound(words.cast("array<binary>"), all_runs)


def bucketed(rows: DataFrame, key: str, text: str, n_buckets: int = BUCKETS) -> DataFrame:
    """id, n_words, buckets of every row."""
    words = rows.select(F.col(key).alias("id"), words_of(F.col(text)).alias("words"))
    return words.select("id", F.size("words").alias("n_words"), buckets_of(F.col("words"), n_buckets).alias("buckets"))


def totals(rows: DataFrame, n_buckets: int = BUCKETS) -> list[int]:
    """How many features of ``bucketed`` rows fall in each bucket: tasks add up theirs before anything is shuffled.

    Empty arrays leave a null: Spark would tell them apart by making every array a second time.
    """
    counted = rows.select(F.explode_outer("buckets").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("b is not null")
    out = [0] * n_buckets
    for r in counted.collect():  # a row for each bucket
        out[r.b] = r.n
    return out


def gains(target: list[int], given: list[int]) -> list[int]:
    """floor(1000 ln) of how much likelier each bucket is in the target than in what is given, both smoothed by one."""
    t_all, s_all, n = float(sum(target)), float(sum(given)), len(given)
    return [math.floor(1000 * math.log((float(t) + 1) * (s_all + n) / ((float(s) + 1) * (t_all + n)))) for t, s in zip(target, given, strict=True)]


def weight(buckets: Column, gain: list[int]) -> Column:
    """Sum of the gains of an array of buckets; an empty one weighs 0."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded to a literal
    return F.aggregate(buckets, F.lit(0).cast("long"), lambda s, b: s + F.element_at(table, b + 1))


def perturbation(key: Column, seed: int) -> Column:
    """A Gumbel draw in thousandths, floored, from the key and seed alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, share: tuple[int, int]) -> DataFrame:
    """``rows`` (id, n_features, weight, score, able) with the rank of the drawn: the highest scores of the able ones.

    One exchange by ranges of the whole order, so equal scores are dealt out too; each partition numbers its rows, and
    where its numbers begin follows from the sizes of those before it, a row for each partition.
    """
    order = [F.col("able").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()]
    dealt = rows.repartitionByRange(salted_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the partition's number, then the row's
    dealt = stored(dealt.select("*", F.shiftright(at, 33).cast("int").alias("run"), at.bitwiseAND((1 << 33) - 1).alias("place")), "ranked")
    sizes = sorted(dealt.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count_if("able").alias("able")).collect())  # a row for each partition
    drawn, begins, at_ = share[0] * sum(r.able for r in sizes) // share[1], {}, 0
    for r in sizes:
        begins[r.run], at_ = at_, at_ + r.n
    starts = [begins.get(i, 0) for i in range(max(begins, default=-1) + 1)] or [0]
    start = F.element_at(F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>"), F.col("run") + 1)
    rank = start + F.col("place") + 1
    return dealt.withColumn("rank", F.when(F.col("able") & (rank <= drawn), rank)).drop("run", "place")


def resampled(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = 20, share: tuple[int, int] = (5, 100), seed: int = 42, n_buckets: int = BUCKETS
) -> DataFrame:
    """key, n_features, weight, score, rank of every row; rank is null but for the drawn ``share`` of those with enough words.

    Null and empty texts have no words, weigh 0 and are never drawn.  A null key draws like an empty one and comes last of
    equal scores; repeated rows are rows of their own, next to each other in the order.  Without a target every gain comes
    from the smoothing.  Columns other than key and text play no part.
    """
    rows = stored(bucketed(docs, key, text, n_buckets), "buckets")
    wanted = totals(bucketed(target.select(F.lit(None).alias("none"), F.col(text).alias("text")), "none", "text", n_buckets), n_buckets)
    weighed = weight(F.col("buckets"), gains(wanted, totals(rows, n_buckets))).alias("weight")
    scores = rows.select("id", (F.col("n_words") >= least_words).alias("able"), F.size("buckets").cast("long").alias("n_features"), weighed)
    scored = stored(scores.withColumn("score", F.col("weight") + perturbation(F.col("id"), seed)), "scored")
    out = ranked(scored, share).select(F.col("id").alias(key), "n_features", "weight", "score", "rank")
    discard(rows, scored)
    return out
