"""Views that give star-schema tables the shape of sequences on trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import table

#: Types that count; the rest of the fixture's types stand for unknown ones.
VALID_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO"]
#: Elements of a task's branches, about.
PER_TASK = 200_000


def seq_orders(spark: SparkSession, folder: str) -> DataFrame:
    """A branch for each order: its lines' suppliers in order, typed by the part.

    The rows are dealt out by branch to as many tasks as their number asks for, so what a task sorts doesn't grow with
    the tables; windows and groups by branch keep that partitioning.
    """
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, folder, "part").select("p_partkey", "p_type")
    tasks = max(spark.sparkContext.defaultParallelism, -(-lines.count() // PER_TASK))  # counted from the files' footers
    typed = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).repartition(tasks, "l_orderkey")
    rows = typed.join(orders.repartition(tasks, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pos = F.row_number().over(w) - 1
    return rows.select(
        F.col("o_custkey").alias("post_cell"), F.col("l_orderkey").alias("branch_id"), pos.alias("seq_pos"),
        (F.col("l_orderkey") * 1000 + pos).alias("syn_id"), F.col("l_suppkey").alias("pre_cell"), F.col("p_type").alias("cell_type"),
        F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 100).alias("y"), F.round(F.col("l_tax") * 100).alias("z"),
    )


def seq_events(spark: SparkSession, folder: str) -> DataFrame:
    """A branch for each user and week: event types in order, numbered by name."""
    e = table(spark, folder, "events")
    week = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / (7 * 86400))
    w = Window.partitionBy("user_id", "branch_id").orderBy("ts", "event_id")
    code = F.array_position(F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")]), F.col("event_type")) - 1
    return e.withColumn("branch_id", week).select(
        F.col("user_id").alias("post_cell"), "branch_id", (F.row_number().over(w) - 1).alias("seq_pos"), F.col("event_id").alias("syn_id"),
        code.alias("pre_cell"), F.col("event_type").alias("cell_type"), F.col("value").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"),
    )


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("post_cell").orderBy("branch_id", "seq_pos")
    return seq_orders(spark, folder).withColumn("node_id", F.row_number().over(w).cast("long"))


def _tree(rows: DataFrame, parent) -> DataFrame:
    return rows.select(
        F.col("post_cell").alias("cell_id"), "node_id", F.when(parent == 0, F.lit(-1)).otherwise(parent).cast("long").alias("parent_id"),
        "x", "y", "z", "cell_type", "pre_cell", "syn_id",
    )


def tree_chain(spark: SparkSession, folder: str) -> DataFrame:
    """A tree per customer: a line hangs on the one before it, each tenth on the one of half its number."""
    n = F.col("node_id")
    return _tree(_numbered(spark, folder), F.when(n % 10 == 0, F.floor(n / 2)).otherwise(n - 1))


def tree_heap(spark: SparkSession, folder: str) -> DataFrame:
    """A tree per customer: a line hangs on the one of half its number."""
    return _tree(_numbered(spark, folder), F.floor(F.col("node_id") / 2))


def points(spark: SparkSession, folder: str) -> DataFrame:
    """(grp, id, x, y, z): the first three dimensions of the embeddings, by label."""
    e = table(spark, folder, "embeddings")
    return e.select(F.col("label").cast("long").alias("grp"), F.col("vec_id").alias("id"), *[F.round(F.col("embedding")[i].cast("double"), 6).alias(c) for i, c in enumerate("xyz")])


# ---- the same views as SQL text, for the oracle ----

SEQ_ORDERS = """seq_orders AS (
    SELECT o_custkey AS post_cell, l_orderkey AS branch_id,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS seq_pos,
           l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS syn_id,
           l_suppkey AS pre_cell, p_type AS cell_type, l_quantity AS x, round(l_discount * 100) AS y, round(l_tax * 100) AS z
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

SEQ_EVENTS = """seq_events AS (
    SELECT user_id AS post_cell, branch_id, row_number() OVER (PARTITION BY user_id, branch_id ORDER BY ts, event_id) - 1 AS seq_pos,
           event_id AS syn_id, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS pre_cell,
           event_type AS cell_type, value AS x
    FROM (SELECT *, CAST(floor(floor(epoch(ts)) / (7 * 86400)) AS BIGINT) AS branch_id FROM events))"""

TREES = SEQ_ORDERS + """, numbered AS (
    SELECT *, row_number() OVER (PARTITION BY post_cell ORDER BY branch_id, seq_pos) AS node_id FROM seq_orders),
tree_chain AS (
    SELECT post_cell AS cell_id, node_id, CASE WHEN p = 0 THEN -1 ELSE p END AS parent_id, x, y, z, cell_type, pre_cell, syn_id
    FROM (SELECT *, CASE WHEN node_id % 10 = 0 THEN node_id // 2 ELSE node_id - 1 END AS p FROM numbered)),
tree_heap AS (
    SELECT post_cell AS cell_id, node_id, CASE WHEN node_id = 1 THEN -1 ELSE node_id // 2 END AS parent_id, x, y, z, cell_type, pre_cell, syn_id
    FROM numbered)"""

POINTS = """points AS (
    SELECT CAST(label AS BIGINT) AS grp, vec_id AS id, round(CAST(embedding[1] AS DOUBLE), 6) AS x,
           round(CAST(embedding[2] AS DOUBLE), 6) AS y, round(CAST(embedding[3] AS DOUBLE), 6) AS z
    FROM embeddings)"""
