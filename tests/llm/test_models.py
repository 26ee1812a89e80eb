import base64
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arborseq.llm import language_id, neighbours, quality, warc

from .cases import documents, empty


def pages(spark):
    rows = [(5, "http://a", "<p>é</p>"), (3, "http://b", "<p>é</p>"), (9, None, "<p>é</p>"), (1, "http://c\r\nX: y", None), (2, "u", ""), (7, "u", "x" * 300_000), (8, "u", "\r\n\r\nHTTP"), (8, "u", "\r\n\r\nHTTP"), (None, "u", "<p>é</p>"), (None, "u", "only")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("record_type", F.lit(1))


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    rows = pages(spark).collect()
    want = []
    for r in rows:
        body = (r.html or "").encode()
        same = [x.page_id for x in rows if (x.html or "").encode() == body and x.page_id is not None]
        first = min(same, default=None)
        copies = sum((x.html or "").encode() == body for x in rows)
        revisit = len(body) >= least and copies > 1 and first is not None and r.page_id != first
        want.append((r.page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    got = warc.round_trip(pages(spark), least_bytes=least)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_warc_filters_reach_the_scan(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.archive_pages(pages(spark), path)
    df = warc.read_archives(spark, path)
    assert df.where("record_type = 'revisit'").count() == 4
    assert df.where(F.col("source_id").isin("5", "7")).count() == 2
    assert df.where("source_id is not null and record_type = 'response'").select(F.sum("payload_bytes")).first()[0] == sum((len(x) for x in (b"<p>\xc3\xa9</p>", b"", b"x" * 300_000, b"\r\n\r\nHTTP"))) + 0 + len(b"\r\n\r\nHTTP")
    bare = warc.read_archives(spark, path, payload=False).where("record_type = 'response'")
    assert bare.where("payload is null").count() == bare.count()
    reader = warc.WarcReader({"path": path})
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("payload_bytes",), 1)])) == [warc.EqualTo(("payload_bytes",), 1)]
    assert {b["record_type"][0].as_py() for p in reader.partitions() for b in reader.read(p)} == {"response"}


def test_warc_reads_committed_archives_only(spark, tmp_path):
    path = f"{tmp_path}/w"
    warc.archive_pages(pages(spark), f"file://{path}")
    n = warc.read_archives(spark, f"file://{path}").count()
    with open(f"{path}/part-lost.warc.gz", "wb") as f:
        f.write(warc.record({"WARC-Type": "response"}, b"of a lost attempt"))
    assert warc.read_archives(spark, f"file://{path}").count() == n
    with pytest.raises(EOFError):
        m = warc.Member(__import__("io").BytesIO(warc.record({"WARC-Type": "response"}, b"x" * 999)[:-30]))
        m.start()
        m.skip()


def test_warc_appends_to_a_folder(spark, tmp_path):
    path = f"file://{tmp_path}/more"
    rows = pages(spark)
    warc.archive_pages(rows, path)
    n = warc.read_archives(spark, path).count()
    warc.archive_pages(rows.limit(1), path)
    warc.archive_pages(rows.where("1 = 0"), path)
    assert n == rows.count() and warc.read_archives(spark, path).count() == n + 1


def test_warc_files_are_bounded_and_skipped_by_length(spark, tmp_path):
    import gzip
    import os

    rng = np.random.default_rng(1)
    noise = [bytes(rng.integers(97, 123, 300_000, dtype=np.uint8)).decode() for _ in range(6)]
    rows = spark.createDataFrame([(i, "u", noise[i]) for i in range(6)], "page_id long, url string, html string").coalesce(1)
    warc.archive_pages(rows, str(tmp_path / "a"), file_bytes=400_000)
    files = [f for f in os.listdir(tmp_path / "a") if f.endswith(".gz")]
    assert len(files) == 2
    assert sum(gzip.open(tmp_path / "a" / f).read().count(b"WARC/1.1") for f in files) == 6

    class Counted(__import__("io").BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            Counted.taken += len(out)
            return out

    data = b"".join(warc.record({"WARC-Type": "response", "WARC-Source-Id": str(i)}, x.encode()) for i, x in enumerate(noise))
    member, seen = warc.Member(Counted(data)), []
    while member.start():
        head = member.until(b"\r\n\r\n")
        if b"Source-Id: 3" in head:
            member.until(b"\r\n\r\n")
            seen.append(member.take(300_000).decode())
        member.skip()
    assert seen == [noise[3]] and Counted.taken < len(data) / 2
    foreign = gzip.compress(data[:0] + b"WARC/1.1\r\nWARC-Type: metadata\r\n\r\nx") * 2
    member, n = warc.Member(__import__("io").BytesIO(foreign)), 0
    while member.start():
        n += member.until(b"\r\n\r\n").count(b"metadata")
        member.skip()
    assert n == 2
    with pytest.raises(EOFError):
        member = warc.Member(__import__("io").BytesIO(data[:-10]))
        while member.start():
            member.until(b"\r\n\r\n")
            member.skip()


def test_warc_of_an_empty_table(spark):
    assert warc.round_trip(pages(spark).where("1 = 0")).count() == 0


def test_language_of_held_out_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = out.where("held_out and lang is not null")
    assert held.where("lang_pred = lang").count() >= 0.97 * held.count() > 0
    assert out.where("score < 0 or score > 1").count() == 0


def test_language_on_odd_documents(spark):
    docs = documents(spark)
    rows = {(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(docs).collect()}
    by = {d: p for d, p, _ in rows}
    assert by[200] == by[201] == by[202] == by[204] == "und" and by[203] != "und" and by[212] != "und"
    assert language_id.identify(docs).count() == docs.count()
    assert language_id.identify(empty(spark)).count() == 0
    nothing = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert nothing.where("lang_pred <> 'und'").count() == 0


def test_language_sample_at_any_size(spark):
    """Three billion rows of a language: about the wanted number of them is drawn, and nothing overflows."""
    drawn = spark.range(200_000).where(language_id.in_sample(F.col("id"), F.lit(3_000_000_000), 30_000_000.0)).count()
    assert 1700 < drawn < 2300
    assert spark.range(100).where(language_id.in_sample(F.col("id"), F.lit(100), 100.0)).count() == 100


def test_rare_languages_are_learned(spark):
    """However small a language's share, and whatever the bounds."""
    rows = [(i, "the quick brown fox jumps over it", "en") for i in range(3000)] + [(5000 + i, "nopea kettu hyppii sen yli", "fi") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, max_docs=200, max_words=12, max_grams=60)
    assert model.langs == ["en", "fi"]
    out = language_id.predict(docs, model).join(docs, "doc_id")
    assert out.where("lang_pred <> lang").count() == 0
    long = spark.createDataFrame([(0, "a" * 64 + " " + "b" * 65 + " " + "b" * 65 + " " + "a" * 64, "en")], docs.schema)
    assert set(language_id.train(long).words) == {"a" * 64}


def test_language_scores_equal_a_plain_program(spark):
    """Counts, log frequencies and posteriors from dictionaries and loops."""
    rng = random.Random(7)
    stems = {"en": ["the", "house", "and", "rain", "old"], "de": ["das", "haus", "und", "regen", "old"], "nl": ["het", "huis", "en", "regen", "oud"]}
    rows = [(i, " ".join(rng.choices(stems[x], k=rng.randrange(1, 12))), x) for i, x in enumerate(rng.choices(sorted(stems), k=120))]
    asked = [(1000 + i, t, None) for i, t in enumerate(["The houses", "regens", "haus 7 oudje", "xyz", "und the", "zzz old"])]
    docs = spark.createDataFrame(rows + asked, "doc_id long, text string, lang string")
    words, grams = {}, {}
    for _, text, lang in rows:
        for w in text.split():
            words[w, lang] = words.get((w, lang), 0) + 1
    for (w, lang), n in words.items():
        m = f"^{w}$"
        for k in range(1, 5):
            for i in range(len(m) - k + 1):
                grams[m[i : i + k], lang] = grams.get((m[i : i + k], lang), 0) + n
    words = {k: n for k, n in words.items() if n >= 2}

    def logs(table, key, same):
        names = {t for t, _ in table if same(t)}
        sums = {x: sum(n for (t, l), n in table.items() if l == x and same(t)) for x in stems}
        return [math.log((table.get((key, x), 0) + 0.1) / (sums[x] + 0.1 * len(names))) for x in sorted(stems)]

    def score(word):
        if any(t == word for t, _ in words):
            return logs(words, word, lambda t: True)
        m = f"^{word}$"
        for k in range(4, 0, -1):
            found = [logs(grams, g, lambda t: len(t) == k) for g in (m[i : i + k] for i in range(len(m) - k + 1)) if any(t == g for t, _ in grams)]
            if found:
                return [sum(x) / len(found) for x in zip(*found, strict=True)]
        return [0.0] * 3

    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, language_id.train(docs)).collect()}
    for d, text, _ in rows + asked:
        sums = [sum(x) for x in zip(*[score(w) for w in "".join(c if c.isalpha() else " " for c in text.lower()).split()], strict=True)]
        best = max(sums)
        assert got[d][0] == sorted(stems)[sums.index(best)] and abs(got[d][1] - 1 / sum(math.exp(x - best) for x in sums)) < 1e-9


def test_backoff_goes_from_words_to_shorter_grams():
    model = language_id.Backoff([("the", "en", 9), ("der", "de", 9)], [("^the", "en", 5), ("^der", "de", 5), ("er$", "de", 5), ("he$", "en", 5), ("e", "en", 1), ("t", "en", 9), ("e", "de", 3), ("d", "de", 3)])
    en = model.langs.index("en")
    assert model.score("the") is model.words["the"]
    assert model.score("them")[en] > model.score("them")[1 - en]
    assert model.score("wer")[en] < model.score("wer")[1 - en]
    assert model.score("xey")[en] < model.score("xey")[1 - en]
    assert (model.score("qq") == 0).all()


def test_quality_on_labelled_documents(spark, data):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.classify(docs, labels).join(labels, "doc_id")
    clean, bad = out.where("quality = 1 and toxic = 0"), out.where("quality = 0 or toxic = 1")
    assert clean.where("keep").count() >= 0.97 * clean.count()
    assert bad.where("not keep").count() >= 0.9 * bad.count()


def test_quality_on_odd_documents(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(40)] + [(None, 1, 1), (3, 0, 0), (3, 1, None), (999, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels)
    assert out.count() == docs.count()
    assert out.where("doc_id in (200, 201, 202) and (p_quality is not null or not keep)").count() == 0
    kept = quality.accepted(docs, labels)
    assert kept.dtypes == docs.dtypes and kept.where("fp = 'f' and id = 1").count() == kept.count()
    assert quality.classify(empty(spark), labels).count() == 0
    assert quality.accepted(docs, labels.where("1 = 0")).count() == docs.count()


def test_quality_on_held_out_labels(spark):
    """Fitted on two thirds of the labels, judged on the rest."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    out = quality.classify(docs, labels.where(~held)).join(labels.where(held), "doc_id")
    clean, bad = out.where("quality = 1 and toxic = 0"), out.where("quality = 0 or toxic = 1")
    assert clean.count() > 100 and bad.count() > 20
    assert clean.where("keep").count() >= 0.97 * clean.count()
    assert bad.where("not keep").count() >= 0.9 * bad.count()


def plain_posteriors(rows):
    """(host, path, logit) rows: their probabilities, from lists and loops."""
    rate = lambda x: 1 / (1 + math.exp(-x))
    p = [rate(x) for _, _, x in rows]
    n, mean = len(p), sum(p) / len(p)
    hosts, paths = {}, {}
    for (h, q, _), x in zip(rows, p, strict=True):
        hosts.setdefault(h, []).append(x)
        paths.setdefault((h, q), []).append(x)
    avg = lambda v: sum(v) / len(v)
    chance = mean * (1 - mean)
    between = (sum(len(v) * (avg(v) - mean) ** 2 for v in hosts.values()) - (len(hosts) - 1) * chance) / (n - sum(len(v) ** 2 for v in hosts.values()) / n)
    own = {h: sum(1 for k in paths if k[0] == h) for h in hosts}
    within = sum(len(v) * (avg(v) - avg(hosts[k[0]])) ** 2 for k, v in paths.items()) - sum((own[h] - 1) * avg(v) * (1 - avg(v)) for h, v in hosts.items())
    weight = n - sum(len(v) ** 2 / len(hosts[k[0]]) for k, v in paths.items())
    spread = sum(len(v) * avg(v) * (1 - avg(v)) for v in hosts.values()) / n
    strength = lambda b, c: min(1e4, max(2.0, c / b - 1)) if b > 0 else 1e4
    s, t = strength(between, chance), strength(within / weight if weight > 1e-9 else 0, spread)
    out = []
    for (h, q, x), mine in zip(rows, p, strict=True):
        host = (sum(hosts[h]) - mine + s * mean) / (len(hosts[h]) - 1 + s)
        site = (sum(paths[h, q]) - mine + t * host) / (len(paths[h, q]) - 1 + t)
        out.append(rate(x + math.log(site / (1 - site)) - math.log(mean / (1 - mean))))
    return out


def test_posteriors_equal_a_plain_program(spark):
    rng = random.Random(3)
    lean = {(h, q): rng.gauss(0.5, 1.5) for h in "abcdef" for q in ("x", "y", None)}
    rows = [(h, q, rng.gauss(lean[h, q], 1.0)) for h, q in lean for _ in range(rng.randrange(1, 30))] + [(None, "x", 2.0), ("lone", None, -2.0)]
    ev = spark.createDataFrame([(i, *r, -3.0) for i, r in enumerate(rows)] + [(-1, "a", "x", None, None)], "i long, h string, p string, _quality double, _toxic double")
    got = {r.i: (r.p_quality, r.keep) for r in quality.judged(ev, quality.site_rates(ev, "h", "p"), "h", "p").collect()}
    assert got.pop(-1) == (None, True)
    want = plain_posteriors(rows)
    assert all(abs(got[i][0] - w) < 1e-9 for i, w in enumerate(want))


def test_sparse_sites_are_shrunk(spark):
    rows = [("big", "p", 3.0 if i % 10 else -3.0) for i in range(400)] + [("bad", "p", -3.0) for _ in range(200)] + [("tiny", "p", -3.0), ("tiny", "p", -3.0)] + [(None, None, 3.0)]
    ev = spark.createDataFrame(rows, "h string, p string, _quality double").withColumn("_toxic", F.lit(-3.0))
    out = quality.judged(ev, quality.site_rates(ev, "h", "p"), "h", "p").where("_quality < 0")
    by = {r.h: r.p for r in out.groupBy("h").agg(F.avg("p_quality").alias("p")).collect()}
    assert by["bad"] < by["tiny"] < by["big"]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(0)).withColumn("perm", F.lit("x"))


def test_neighbours_are_exact_where_all_files_are_probed(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype("float32").tolist()) for i in range(300)]
    rows += [(300 + i, rows[20][1]) for i in range(60)]  # many copies of one vector
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [1.0] * 7 + [None]), (1003, [float("nan")] + [1.0] * 7), (1004, [float("inf")] * 8), (1020, [1.0] * 5), (None, [1.0] * 8)]
    got = {}
    for r in neighbours.search(vectors(spark, rows), probe=600, keep=1.0, block=50).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows[:360]]
    assert set(got) == {i for i, _ in good if i % 20 == 0}
    for q, found in got.items():
        v = dict(good)[q]
        want = sorted(((-float(w @ v), i) for i, w in good if i != q))[:20]
        assert [x[0] for x in sorted(found)] == list(range(1, 21))
        assert [x[1] for x in sorted(found)] == [i for _, i in want]
        assert np.allclose([x[2] for x in sorted(found)], [-s for s, _ in want], rtol=1e-12)


def test_neighbours_recall_and_small_tables(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    hits = n = 0
    got = {(r.query_id, r.vec_id) for r in neighbours.search(df).collect()}
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -9
        best = np.lexsort((ids, -s))[:20]
        hits += sum((int(ids[i]), int(ids[j])) in got for j in best)
        n += 20
    assert hits >= 0.9 * n
    assert neighbours.search(df.where("1 = 0")).count() == 0
    assert neighbours.search(df.where("vec_id = 20")).count() == 0
    assert neighbours.search(df.where("vec_id in (20, 40, 41)")).count() == 4


def test_neighbours_recall_where_the_index_prunes(spark):
    """More pivots than are probed, and longer files than are reranked whole."""
    n, every, k = 20_000, 80, 20
    assert 2 * n**0.5 > 5 * 48 and 8 * n / (2 * n**0.5) > 2 * 256
    x = np.random.default_rng(4).normal(size=(n, 64)).astype("float32")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": list(x)}))
    got = {(r.query_id, r.vec_id) for r in neighbours.search(df, every=every, k=k).collect()}
    asked = np.arange(0, n, every)
    scores = x[asked].astype("float64") @ x.T.astype("float64")
    scores[np.arange(len(asked)), asked] = -9
    hits = sum((int(q), int(j)) in got for q, s in zip(asked, scores, strict=True) for j in np.argpartition(-s, k)[:k])
    print("recall", hits / (k * len(asked)))
    assert hits >= 0.97 * k * len(asked)


def test_footrule_counts_displaced_pivots():
    def plain(a, b, n):
        place = lambda p, x: list(p).index(x) if x in p else len(p)
        return sum(abs(place(a, x) - place(b, x)) for x in range(n) if x in a or x in b)

    rng = np.random.default_rng(2)
    q = rng.permutation(12)[:5]
    others = np.stack([rng.permutation(12)[:5] for _ in range(50)])
    assert neighbours.footrule(q, others, 12).tolist() == [plain(q, o, 12) for o in others]
