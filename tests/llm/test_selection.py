"""Importance resampling, filter audit and line dedup against plain programs."""

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arborseq.llm import filter_audit, importance, line_dedup

from .cases import documents, empty
from .test_dedup import ascii_lower

BLANK = " \t\n\x0b\x0c\r"


# ---- line dedup ----


def brute_lines(rows, least_docs, least_chars):
    found = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            found.setdefault(ascii_lower(x.strip(BLANK)), set()).add((d, t or ""))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(ascii_lower(x.strip(BLANK))) < least_chars or len(found[ascii_lower(x.strip(BLANK))]) < least_docs]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def lined(spark):
    rng = random.Random(3)
    pool = ["All rights reserved.", "  all RIGHTS reserved.\t", "", " ", "É", "é", "x", "\x0b", "menu\x85", "long " * 2000]
    rows = [(i, "\n".join(rng.choice(pool + [f"own {i} {j}"]) for j in range(rng.randrange(1, 12)))) for i in range(60)]
    rows += [(None, None), (None, "x"), (None, "x"), (61, None), (62, ""), (63, "x\nx\nX "), (64, rows[0][1]), (5, rows[5][1]), (5, rows[6][1]), (65, "\n" * 3000 + "x")]
    return spark.createDataFrame([(d, t, 1, 2, "s") for d, t in rows], "doc_id long, text string, n_lines int, row int, bitmap string")


@pytest.mark.parametrize("least_docs, least_chars", [(1, 1), (2, 0), (3, 1), (10, 1), (10, 0), (30, 2)])
def test_lines(spark, least_docs, least_chars):
    docs = lined(spark)
    out = line_dedup.deduplicated_lines(docs, least_docs=least_docs, least_chars=least_chars)
    assert out.columns == ["doc_id", "text", "row", "bitmap", "n_lines", "n_dropped"]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()), key=repr)
    assert got == brute_lines([(r.doc_id, r.text) for r in docs.collect()], least_docs, least_chars)
    assert all(r.row == 2 and r.bitmap == "s" for r in out.collect())


def test_lines_of_odd_documents(spark):
    docs = documents(spark)
    got = line_dedup.deduplicated_lines(docs, least_docs=2)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()), key=repr) == brute_lines([(r.doc_id, r.text) for r in docs.collect()], 2, 1)
    assert line_dedup.deduplicated_lines(empty(spark)).count() == 0
    assert line_dedup.keep_bitmaps(empty(spark)).count() == 0


def test_a_bitmap_keeps_lines(spark):
    docs = spark.createDataFrame([(i, f"head\nown {i}\n\nhead") for i in range(10)], "doc_id long, text string")
    maps = line_dedup.keep_bitmaps(docs).collect()
    assert len(maps) == 10 and all((r.n_lines, r.n_dropped) == (4, 2) for r in maps)
    assert {zlib.decompress(r.bitmap) for r in maps} == {bytes([0b01100000])}


@pytest.mark.parametrize("seed", range(40))
def test_streams_settle_at_any_cut(seed):
    """Sorted rows cut into partitions and batches anywhere give what one pass over all gives."""
    rng = random.Random(seed)
    rows = sorted((rng.randrange(4), 0, rng.randrange(25), 0, rng.randrange(3), 3) for _ in range(rng.randrange(1, 120)))
    least = rng.randrange(1, 8)
    fields = ["h1", "h2", "d1", "d2", "pos", "n_lines"]
    cuts = sorted(rng.randrange(len(rows) + 1) for _ in range(rng.randrange(6)))
    dropped, left, marks = set(), [], set()
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        part, batches = rows[a:b], []
        while part:
            n = rng.randrange(1, 9)
            batches.append(pa.RecordBatch.from_arrays([pa.array([r[i] for r in part[:n]], pa.int64() if i < 4 else pa.int32()) for i in range(6)], names=fields))
            part = part[n:]
        open_docs = set()
        for batch in line_dedup.shared_lines(least)(iter(batches)):
            for r in batch.to_pylist():
                row = (r["h1"], r["d1"], r["pos"])
                if r["state"] == line_dedup.DROPPED:
                    dropped.add(row)
                elif r["state"] == line_dedup.MARK:
                    marks.add(r["h1"])
                else:
                    left.append(row)
                    open_docs.add((r["h1"], r["d1"]))
        assert len(open_docs) <= 2 * (least - 1)
    for h in {r[0] for r in left}:
        if h in marks or len({r[1] for r in left if r[0] == h}) >= least:
            dropped |= {r for r in left if r[0] == h}
    count = {h: len({r[2] for r in rows if r[0] == h}) for h in range(4)}
    assert dropped == {(r[0], r[2], r[4]) for r in rows if count[r[0]] >= least}


def test_a_line_with_most_rows_is_dealt_out(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("boilerplate\nown "), F.col("id")).alias("text")).repartition(8)
    rows = line_dedup.line_rows(docs, "doc_id", "text", 1)
    order = ["h1", "h2", "d1", "d2", "pos", "salt"]
    sizes = rows.where(F.col("pos") == 0).repartitionByRange(8, *order).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 1000


# ---- filter audit ----


def brute_mask(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), re.search("[#$%&*|]", text) is not None]
    return {f for f, x in zip("ABCD", fails, strict=True) if x}


def brute_audit(rows, labels):
    """rows: (doc_id, text, source); labels: {doc_id: (good, toxic)}."""
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    judged = []
    for d, t, s in rows:
        fails = brute_mask(t or "") | ({"E"} if d is not None and first[t or ""] < d else set())
        judged.append((s or "", fails, *labels.get(d, (False, False))))
    out = {}
    shapley = {}
    for order in permutations("ABCDE"):
        for step, f in enumerate(order, 1):
            for part in {j[0] for j in judged}:
                mine = [j for j in judged if j[0] == part]
                before = set(order[: step - 1])
                here = [j for j in mine if f in j[1] and not j[1] & before]
                out[part, "".join(order), step] = [
                    sum(not j[1] & (before | {f}) for j in mine), len(here), sum(f in j[1] and bool(j[1] & before) for j in mine),
                    sum(j[1] == {f} for j in mine), sum(j[2] for j in here), sum(j[3] for j in here),
                ]
                shapley[part, f] = shapley.get((part, f), 0) + len(here)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(spark):
    rng = random.Random(5)
    docs = documents(spark)
    more = [(300 + i, " ".join(rng.choice(["Ab", "c", "dé", "#", "EFG"]) + str(rng.randrange(rng.choice([5, 5000]))) for _ in range(rng.choice([150, 199, 200, 400]))), None, rng.choice(["s0", "", None]), 0, 1, "f", "d", 2, 0.5, 3) for i in range(40)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumn("mask", F.lit("clash")).withColumn("good", F.lit(7))
    marks = [(d, rng.randrange(2), rng.choice([0, 1, None])) for d in [*range(30), *range(200, 230), *range(300, 330)]] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    known = {}
    for d, q, t in marks:
        if d is not None:
            g, x = known.get(d, (False, False))
            known[d] = (g or q == 1, x or t == 1)
    want = brute_audit([(r.doc_id, r.text, r.source) for r in docs.collect()], known)
    got = filter_audit.audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == want
    assert filter_audit.audit(empty(spark), labels).count() == 0
    alone = filter_audit.audit(docs, labels.where("1 = 0")).collect()
    assert len(alone) == len(want) and all(r.good_lost == r.toxic_lost == 0 for r in alone)


def test_audit_adds_up(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    out = filter_audit.audit(docs, labels)
    bad = out.groupBy("part", "filter_order").agg(F.sum("removed").alias("r"), F.min_by("kept", -F.col("step")).alias("k")).join(docs.groupBy(F.coalesce("source", F.lit("")).alias("part")).count(), "part")
    assert bad.where("r + k <> count").count() == 0 and bad.count() == 120 * docs.select("source").distinct().count()


# ---- importance resampling ----


def brute_features(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or "")) if w]
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


def brute_resampled(rows, target, least_words, share):
    s, t = np.zeros(10000, dtype=int), np.zeros(10000, dtype=int)
    docs = [(d, *brute_features(x)) for d, x in rows]
    for _, _, b in docs:
        np.add.at(s, b, 1)
    for x in target:
        np.add.at(t, brute_features(x)[1], 1)
    gain = [math.floor(1000 * math.log((float(t[i]) + 1) * (float(t_s) + 10000) / ((float(s[i]) + 1) * (float(t_t) + 10000)))) for t_s, t_t in [(s.sum(), t.sum())] for i in range(10000)]
    out = []
    for d, n, b in docs:
        w = sum(gain[x] for x in b)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(b), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    for i, r in enumerate(able[: share[0] * len(able) // share[1]], 1):
        r[4] = i
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("least_words, share", [(20, (5, 100)), (1, (1, 1)), (3, (40, 100))])
def test_resampling(spark, data, least_words, share):
    docs, target = documents(spark).withColumnRenamed("fp", "weight").withColumnRenamed("start", "rank"), spark.read.parquet(f"{data}/benchmark.parquet")
    got = importance.resampled(docs, target, least_words=least_words, share=share)
    want = brute_resampled([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], least_words, share)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_resampling_of_nothing(spark, data):
    target = spark.read.parquet(f"{data}/benchmark.parquet")
    assert importance.resampled(empty(spark), target).count() == 0
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b c")], "doc_id long, text string")
    got = importance.resampled(docs, target.where("1 = 0"), least_words=1, share=(1, 1)).collect()
    assert sorted((r.doc_id, r.n_features, r["rank"]) for r in got) == [(1, 0, None), (2, 0, None), (3, 6, 1)]


def test_scoring_explodes_nothing(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    scored = importance.bucketed(docs, "doc_id", "text").select("id", importance.weight(F.col("buckets"), list(range(10000))).alias("weight"))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan and "Python" not in plan


def test_ranks_of_equal_scores(spark):
    rows = spark.range(3000).select(((F.col("id") * 7919) % 3000).alias("id"), F.lit(1).cast("long").alias("n_features"), F.lit(0).cast("long").alias("weight"), F.lit(5).cast("long").alias("score"), (F.col("id") % 3 > 0).alias("able"))
    got = {r.id: r["rank"] for r in importance.ranked(rows, (50, 100)).collect()}
    able = sorted(r.id for r in rows.where("able").collect())
    assert got == {i: None for i in range(3000)} | {d: n for n, d in enumerate(able[:1000], 1)}
