"""The repeated-sequence experiment: branches, pairs, null models, scores, counts, z-scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compare, mixture, pairs, sequences, shuffles, stats
from ..sources.storage import stored


def score_pairs(pair_table: DataFrame, branches: DataFrame, least: int = 3, method: str = "lcs", backwards: bool = False) -> DataFrame:
    """Pairs with score, sub_a, sub_b; ``branches`` are nested and may carry (shuffle, trial), whose rows stay apart.

    If they carry ``apical``, whether a branch belongs to the apical part, so do the pairs: apical_a, apical_b.
    """
    by = [c for c in ("shuffle", "trial") if c in branches.columns]
    more = ["apical"] if "apical" in branches.columns else []
    out = pair_table
    for n, side in enumerate("ab"):
        one = branches.select(F.col("post_cell").alias(f"cell_{side}"), F.col("branch_id").alias(f"branch_{side}"), F.col("seq").alias(f"seq_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in more], *by)
        out = out.join(one, [f"cell_{side}", f"branch_{side}", *(by if n else [])])
    run = {"lcs": lambda d: compare.lcs_scores(d, least, backwards), "substring": lambda d: compare.substring_scores(d, least), "cluster": lambda d: compare.cluster_scores(d, least)}[method]
    return run(out).select(*by, *pairs.PAIR, *[f"{c}_{side}" for c in more for side in "ab"], "score", "sub_a", "sub_b")


def null_branches(branches: DataFrame, models: Sequence[str], trials: int, seed: int, mixtures: DataFrame | None = None) -> DataFrame:
    """(shuffle, trial, branch, seq, apical if there): every trial of every model, from nested branches.

    The axon and the continuous model draw by the cells' ``mixtures``: their scores at the branch's places, and their
    probabilities on its segments.
    """
    keep = [*sequences.BRANCH, "seq", *[c for c in ("apical",) if c in branches.columns]]
    every = None
    for m in models:
        given = branches
        if m in ("axon", "continuous"):
            if mixtures is None:
                raise ValueError(f"{m} needs the cells' mixtures")
            given = mixture.with_scores(branches, mixtures) if m == "axon" else mixture.with_segments(branches, mixtures)
        one = shuffles.shuffle(given, m, trials, seed).select("shuffle", "trial", *keep)
        every = one if every is None else every.unionByName(one)
    return every


def paired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the branches that are in a pair of ``found``: a branch without one repeats nothing, whatever a shuffle does to it."""
    ends = [found.select(F.col(f"cell_{side}").alias("post_cell"), F.col(f"branch_{side}").alias("branch_id")) for side in "ab"]
    return rows.join(ends[0].union(ends[1]).distinct(), sequences.BRANCH, "left_semi")


def null_counts(
    rows: DataFrame, models: Sequence[str] = ("original", "random", "type"), trials: int = 5, seed: int = 0, k: int = 3, unique: bool = False,
    mixtures: DataFrame | None = None, backwards: bool = False, basal: bool = False,
) -> DataFrame:
    """(shuffle, trial, n): distinct sequences that pairs repeat, in the data and in each trial of each null model.

    Pairs are found once: a shuffle within a branch doesn't change which cells it holds.  Only branches in a pair are
    shuffled; they, the pairs and the counts are stored, as both sides of a pair and every model read them.  ``mixtures`` are for the axon
    and continuous models; ``backwards`` reads the second branch of a pair from its end; ``basal`` leaves out pairs with
    an apical branch, whose ``rows`` are marked in a column ``apical``.
    """
    found = pairs.similar(sequences.collapse(rows), k)
    if basal:
        apical = rows.where("apical").select(*sequences.BRANCH).distinct()
        for side in "ab":
            found = found.join(apical.withColumnsRenamed({"post_cell": f"cell_{side}", "branch_id": f"branch_{side}"}), [f"cell_{side}", f"branch_{side}"], "left_anti")
    found = stored(found, "pairs-found")
    branches = stored(sequences.nested(sequences.collapse(paired(rows, found))), "branches")
    every = null_branches(branches, models, trials, seed, mixtures).select("shuffle", "trial", *sequences.BRANCH, sequences.ids("seq").alias("ids"))
    keys = repeated_ids(found, every, backwards=backwards)
    if unique:
        keys = keys.where(sequences.unique_only(F.col("key")))
    return stored(keys.select("shuffle", "trial", "key").distinct().groupBy("shuffle", "trial").agg(F.count(F.lit(1)).alias("n")), "trial-counts")


def repeated_ids(pair_table: DataFrame, branches: DataFrame, least: int = 3, backwards: bool = False) -> DataFrame:
    """(shuffle and trial if there, PAIR, key): the common subsequence of each pair, as ids, where it has ``least`` of them.

    ``branches`` (``sequences.nested_ids``) carry ids only, so that is all the joins move.
    """
    by = [c for c in ("shuffle", "trial") if c in branches.columns]
    out = pair_table
    for n, side in enumerate("ab"):
        one = branches.select(F.col("post_cell").alias(f"cell_{side}"), F.col("branch_id").alias(f"branch_{side}"), F.col("ids").alias(f"ids_{side}"), *by)
        out = out.join(one, [f"cell_{side}", f"branch_{side}", *(by if n else [])])
    second = F.reverse("ids_b") if backwards else F.col("ids_b")
    scored = out.withColumn("_lcs", compare.lcs(out.sparkSession, F.col("ids_a"), second, least)).where(F.col("_lcs.score") >= least)
    return scored.select(*by, *pairs.PAIR, sequences.subsequence("ids_a", F.col("_lcs.idx_a")).alias("key"))


def sequence_distances(
    rows: DataFrame, models: Sequence[str] = ("original", "random", "type"), trials: int = 5, seed: int = 0, k: int = 3, mixtures: DataFrame | None = None, basal: bool = False
) -> DataFrame:
    """(shuffle, trial, key, n, mean_distance, per_synapse): how far apart the elements of each repeated sequence lie, in the data and in each trial.

    Elements lie where a shuffle puts them.  ``basal`` and what is stored as in ``null_counts``.
    """
    found = stored(pairs.similar(sequences.collapse(rows), k), "pairs-found")
    branches = sequences.nested(sequences.collapse(paired(rows, found)))
    if basal:
        apical = rows.groupBy(*sequences.BRANCH).agg(F.max("apical").alias("apical"))
        branches = branches.join(apical, sequences.BRANCH)
    every = null_branches(stored(branches, "branches"), models, trials, seed, mixtures)
    return stats.distances(score_pairs(found, every), ["shuffle", "trial"], k, basal)


def z_scores(counts: DataFrame) -> DataFrame:
    """(shuffle, real, mean, std, z) of each null model against 'original'; z is null without spread.

    A trial in which nothing repeats has no row in ``counts`` and isn't counted here.
    """
    real = counts.where("shuffle = 'original'").agg(F.max("n").alias("real"))
    null = stats.summary(counts.where("shuffle <> 'original'"), "n", ["shuffle"])
    return null.crossJoin(F.broadcast(real)).select("shuffle", "real", "mean", "std", stats.z_score(F.col("real"), F.col("mean"), F.col("std")).alias("z"))  # one row


def axon_lengths(rows: DataFrame, roots: DataFrame, trials: DataFrame, k: int = 8) -> DataFrame:
    """(shuffle, trial, pre_cell, length_mm): trees over each cell's synapses where the shuffles put them.

    ``rows`` are the elements with their own places, ``trials`` nested shuffled branches, ``roots`` a place per cell.
    """
    from ..operators import trees

    placed = sequences.flat(trials, [*sequences.BRANCH, "shuffle", "trial"]).select("shuffle", "trial", F.col("pre_cell"), "syn_id", *[F.col(c).alias(f"_{c}") for c in "xyz"])
    runs = trials.select("shuffle", "trial").distinct()
    nodes = rows.select("pre_cell", "syn_id", "x", "y", "z").crossJoin(runs)  # a row for each trial
    nodes = nodes.join(placed, ["shuffle", "trial", "pre_cell", "syn_id"], "left")
    for c in "xyz":
        nodes = nodes.withColumn(c, F.coalesce(f"_{c}", c))
    cell = F.xxhash64("shuffle", "trial", "pre_cell")
    # the trees, their edges' ends and the names all read these places
    named = stored(nodes.select("shuffle", "trial", "pre_cell", cell.alias("cell_id"), F.col("syn_id").alias("node_id"), "x", "y", "z"), "placed")
    at = roots.crossJoin(runs).select(cell.alias("cell_id"), "x", "y", "z")
    built = trees.build(named, at, k, k).join(named.select("cell_id", "node_id", "x", "y", "z"), ["cell_id", "node_id"])
    total = trees.total_length(built, at)
    names = named.select("cell_id", "shuffle", "trial", "pre_cell").distinct()
    return total.join(names, "cell_id").select("shuffle", "trial", "pre_cell", (F.col("length") / 1000).alias("length_mm"))
