"""A training-data pipeline over ``documents``: quality, exact copies, near copies, repeated passages, packing.

Each stage works on all rows its predecessor kept and, but for the last, returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborseq.llm.common import discard, parted, stored
from arborseq.llm.exact_dedup import ascii_lower, exact_groups
from arborseq.llm.near_copies import near_rows, text_name
from arborseq.llm.packing import pack
from arborseq.llm.quality import accepted
from arborseq.llm.suffix_dedup import deduplicated


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier fitted on ``labels`` doesn't reject."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _without(docs: DataFrame, rows: DataFrame, name: Column) -> DataFrame:
    """``docs`` but for those of ``rows`` (id, name of the text, gone) that are gone; rows without an identifier stay.

    Another text under an identifier that is dropped stays: where rows of one identifier differ, names tell them apart.
    What is dropped is stored.  Most rows are told by a filter of fixed size to be none of these, and aren't shuffled.
    """
    each = stored(rows.where("id is not null").groupBy(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "name").agg(F.bool_and("gone").alias("gone")), "fates")
    fate = each.groupBy("doc_id").agg(F.bool_and("gone").alias("all"), F.bool_or("gone").alias("any"))
    whole = fate.where("all").select("doc_id", F.lit(None).cast("binary").alias("gone_name"))
    some = each.where("gone").join(fate.where("any and not all"), "doc_id", "left_semi").select("doc_id", F.col("name").alias("gone_name"))
    gone = stored(whole.union(some), "dropped")
    discard(each)
    untouched, others = parted(docs, ["doc_id"], gone)
    gone = gone.withColumnsRenamed({"doc_id": "_gone_id", "gone_name": "_gone_name"})
    left = others.join(gone, (others["doc_id"] == gone["_gone_id"]) & (gone["_gone_name"].isNull() | (name == gone["_gone_name"])), "left_anti")
    return untouched.union(left.select(*docs.columns))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the one with the smallest doc_id.

    A null text is equal to an empty one.  Rows without a doc_id stay, and so do further rows of the doc_id that stays
    with the same text, as nothing tells them apart.
    """
    rows = exact_groups(docs).select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("name"), (~F.col("kept")).alias("gone"))
    return _without(docs, rows, text_name(ascii_lower(F.coalesce(F.col("text"), F.lit("")))))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words, similarity 0.8), the document with the smallest doc_id.

    Rows without a doc_id and repeated rows of the one that stays are treated as by ``exact_dedup``.
    """
    rows = near_rows(docs, width=5, similarity=0.8).select("id", "name", (F.col("id") != F.col("component_id")).alias("gone"))
    return _without(docs, rows, text_name(F.col("text")))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that occur earlier, in a smaller doc_id (none is the smallest) or further left.

    Documents of which nothing but white space (space, tab to carriage return) is left go, and so do null and empty
    ones.  Of repeated rows one keeps its text.
    """
    out = deduplicated(docs, depth=100).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=2)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("packing", packing),
]

#: The classifier's and the tokenizer's rows can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
