import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborseq.llm import common, components, exact_dedup, near_copies, simhash, suffix_dedup

from .cases import documents, empty, words


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.mark.parametrize("largest", [False, True])
@pytest.mark.parametrize("bits, fan", [(0, 1), (3, 1), (6, 3)])
def test_exact_groups(spark, largest, bits, fan):
    docs = documents(spark)
    groups = {}
    given = [(r.doc_id, ascii_lower(r.text or "")) for r in docs.collect()]
    for d, t in given:
        groups.setdefault(t, []).append(d)
    want = []
    for d, t in given:
        known = [x for x in groups[t] if x is not None]
        keep = (max(known) if largest else min(known)) if known else None
        want.append((d, keep, len(groups[t]), d == keep, hashlib.sha256(t.encode()).hexdigest()))
    got = exact_dedup.exact_groups(docs, largest=largest, bits=bits, fan_bits=fan)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


def test_exact_dedup_runs_no_python(spark):
    plan = exact_dedup.exact_groups(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_every_round_merges_in_sorted_order(spark):
    """The optimiser leaves each round its exchange, its sort and the pass over the sorted entries."""
    rows = exact_dedup.digests(documents(spark), bits=4)
    plan = exact_dedup.retained(rows, bits=4)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window [") >= 4
    physical = exact_dedup.retained(rows, bits=4)._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Sort [run") >= 4


def union_find(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5)]
    got = dict(map(tuple, components.components(spark.createDataFrame([*links, (None, 3)], "a long, b long"), "a", "b").collect()))
    roots = union_find(200, links)
    assert got == {x: roots[x] for pair in links for x in pair}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def plain_fingerprint(text, shingle=3):
    import xxhash

    w = text.encode().lower().split()
    if not w:
        return 0
    parts = [b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_groups_on_odd_documents(spark):
    docs = documents(spark)
    given = [(r.doc_id, plain_fingerprint(r.text or "")) for r in docs.collect()]
    fps = sorted({f for _, f in given})
    roots = union_find(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    group = dict(zip(fps, roots, strict=True))
    least = {g: min((d for d, f in given if group[f] == g and d is not None), default=None) for g in set(roots)}
    want = sorted(((d, f, least[group[f]]) for d, f in given), key=repr)
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_groups(docs).collect()), key=repr)
    assert got == want
    assert simhash.near_groups(empty(spark)).count() == 0


def flipped(rng, x, n):
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x


@pytest.mark.parametrize("crowded, small", [(4096, 48), (4, 2)])
def test_links_lose_nothing(spark, monkeypatch, crowded, small):
    """All pairs of at most three bits are connected, in and between crowded keys."""
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(5)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randrange(4)):
            x = flipped(rng, x, rng.randrange(1, 5))
            fps.add(x)
    base = rng.getrandbits(64)
    fps |= {flipped(rng, base, rng.randrange(0, 9)) for _ in range(150)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
    at = {s: i for i, s in enumerate(signed)}
    want = union_find(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    for r in rows:
        assert (fps[at[r.a]] ^ fps[at[r.b]]).bit_count() <= 3
    assert union_find(len(fps), [(at[r.a], at[r.b]) for r in rows]) == want


def test_ring_keys_meet_every_near_pair():
    """The pigeonring condition that the keys stand for holds from some start for any three differing bits."""
    rng = random.Random(1)
    for _ in range(300):
        x = flipped(rng, 0, rng.randrange(4))
        d = [(x >> 8 * i & 255).bit_count() for i in range(8)]
        assert any(d[s] == d[(s + 1) % 8] == 0 and sum(d[(s + k) % 8] > 0 for k in (2, 3, 4)) <= 1 for s in range(8))


def jaccard(a, b):
    a, b = set(a.tolist()), set(b.tolist())
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies(spark):
    rng = random.Random(8)
    pool = [chr(97 + i) + chr(97 + j) for i in range(26) for j in range(26)]
    texts = [words(rng, 200, pool) for _ in range(60)]
    rows = list(enumerate(texts))
    for i in range(30):
        w = texts[i].split()
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = "edited"
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i, words(rng, 100, pool) + " " + " ".join(texts[50].split()[:100])) for i in range(5)]  # half alike only
    rows += [(300, None), (301, ""), (302, "one two"), (303, "ONE  two"), (None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(map(tuple, near_copies.near_copies(df).collect()))
    known = [(d, near_copies.shingles(t or "")) for d, t in rows if d is not None]
    roots = union_find(len(known), [(i, j) for i in range(len(known)) for j in range(i) if jaccard(known[i][1], known[j][1]) >= 0.8])
    assert got == {known[i][0]: known[r][0] for i, r in enumerate(roots) if r != i}
    assert near_copies.near_copies(df.where("1 = 0")).count() == 0


def test_near_copies_within_templates(spark):
    """A link must be found however many closer texts a common passage brings that aren't links."""
    rng = random.Random(21)
    pool = [chr(97 + i) + chr(97 + j) for i in range(26) for j in range(26)]
    template = words(rng, 150, pool).split()
    rows = []
    for member in range(200):
        w = template[:]
        for place in rng.sample(range(5, 145), 2):  # 0.76 between members
            w[place] = f"own{rng.random()}"
        rows.append((2 * member, " ".join(w)))
        if member % 5 == 0:  # 0.81
            for place in rng.sample(range(5, 145), 3):
                w[place] = f"other{rng.random()}"
            rows.append((2 * member + 1, " ".join(w)))
    got = dict(map(tuple, near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    sets = [set(near_copies.shingles(t).tolist()) for _, t in rows]
    roots = union_find(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    assert got == {rows[i][0]: rows[min(j for j, x in enumerate(roots) if x == r)][0] for i, r in enumerate(roots) if i != r}


def test_near_copies_around_a_large_family(spark):
    """Texts that are near to one member of thousands, and not to the others."""
    rng = random.Random(5)
    base = words(rng, 64, [chr(97 + i) + chr(97 + j) for i in range(26) for j in range(26)]).split()
    rows = [(i, " ".join([*base[:-1], f"own{i}"])) for i in range(4500)]
    for i in range(40):
        member = [*base[:-3], f"member{i}", *base[-2:]]  # 0.90 to the family
        rows += [(5000 + 2 * i, " ".join(member)), (5001 + 2 * i, " ".join([*base[:5], f"far{i}", *base[6:-3], *member[-3:]]))]  # 0.82 to it, 0.74 to the family
    got = dict(map(tuple, near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == {i: 0 for i, _ in rows[1:]}


def test_shared_keys_of_any_run(monkeypatch):
    """Keys of the same nodes get one number, lone ones go, and a crowded key is handed on however batches cut it."""
    import pyarrow as pa

    monkeypatch.setattr(near_copies, "CROWDED", 6)
    held = {5: [1], 6: [1, 2], 7: [1, 2], 8: [3], 9: list(range(20)), 10: [4, 5], 11: list(range(7)), 12: [8]}
    flat = [(k, 0, n) for k, nodes in held.items() for n in nodes]
    for size in (1, 2, 3, 5, 8, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*flat[i : i + size], strict=True)], names=["key", "at", "node"]) for i in range(0, len(flat), size)]
        out = [tuple(r.values()) for b in near_copies._shared_keys_task(batches) for r in b.to_pylist()]
        got = {}
        for k, _, n in out:
            got.setdefault(k, []).append(n)
        assert got.pop(9) == held[9] and got.pop(11) == held[11]
        assert sorted(map(sorted, got.values())) == [[1, 1, 2, 2], [4, 5]]


def test_prefixes_share_as_many_shingles_as_are_needed():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = rng.permutation(10_000)[:n].astype(np.uint64)
        b = np.concatenate([a[rng.random(n) < rng.uniform(0.8, 1)], rng.integers(20_000, 30_000, int(rng.integers(0, n // 5 + 1))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if len(np.intersect1d(a, b)) < 0.8 * len(np.union1d(a, b)):
            continue
        known = np.unique(rng.integers(0, 10_000, 50).astype(np.uint64))
        x, y = near_copies.prefixes([a, b], (known, rng.integers(3, 9, len(known))), 0.8)
        assert len(np.intersect1d(x, y)) >= near_copies.needed(min(len(a), len(b)))


def test_sketches_bound_differences():
    rng = np.random.default_rng(7)
    for n in (0, 1, 30, 350, 3000):
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for changed in (0, 1, n // 20, n // 3):
            other = np.unique(np.concatenate([base[changed:], rng.integers(0, 1 << 63, changed, dtype=np.uint64)]))
            sketch = near_copies.sketches([base, other])
            assert sketch.shape == (2, len(near_copies.SKETCH))
            folded = np.bitwise_xor.reduce(sketch.reshape(2, -1, near_copies.FOLDED), axis=1)
            differ = len(np.setxor1d(base, other))
            assert near_copies.apart(*folded) <= near_copies.apart(*sketch) <= differ
            if n == 350 and changed == n // 3:  # far below 0.8, which the full sketch tells
                assert near_copies.apart(*sketch) > 0.112 * (len(base) + len(other))


def test_near_copies_of_few_shingles(spark):
    """Pairs at just 0.8: four of five shingles, and twelve with three of their own."""
    rng = random.Random(6)
    pool = [chr(97 + i) + chr(97 + j) + chr(97 + k) for i in range(26) for j in range(26) for k in range(26)]
    rows = []
    for i in range(1500):
        w = words(rng, 9 if i % 2 else 19, pool).split()
        rows += [(2 * i, " ".join(w[:-1])), (2 * i + 1, " ".join(w))] if i % 2 else [(2 * i, " ".join(w[:-1])), (2 * i + 1, " ".join(w[2:]))]
    got = dict(map(tuple, near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == {2 * i + 1: 2 * i for i in range(1500)}


def test_bucket_links_span_a_family():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 2, dtype=np.uint64)
    fp = np.stack([base ^ np.array([1 << int(b), 0], dtype=np.uint64) for b in rng.integers(0, 60, 80)])
    links = near_copies.bucket_links(fp)
    assert len(set(union_find(len(fp), links.tolist()))) == 1 and len(links) < 8 * len(fp)


def test_chains_lose_no_near_pair_and_prune_others():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**64, (20_000, 2), dtype=np.uint64)
    flips = np.zeros((len(a), 128), dtype=np.uint8)
    for row, n in zip(flips, rng.integers(0, near_copies.MOST + 1, len(a)), strict=True):
        # half of the patterns crowd into a few segments
        row[rng.choice(128, n, replace=False) if n % 2 else (rng.integers(128) + rng.choice(48, n, replace=False)) % 128] = 1
    near = a ^ np.packbits(flips, axis=1, bitorder="little").view(np.uint64)
    assert near_copies.chained(a, near).all()
    assert (near_copies.distances(a, near) == flips.sum(axis=1)).all()
    # pairs that only share a key are mostly dropped by the chains, before the full check
    key = np.zeros((1, 128), dtype=np.uint8)
    key[0, near_copies.places(near_copies.KEY_BITS)[0]] = 1
    other = rng.integers(0, 2**64, a.shape, dtype=np.uint64) & ~np.packbits(key, axis=1, bitorder="little").view(np.uint64)
    far = near_copies.apart(a, a ^ other) > near_copies.MOST
    left = near_copies.chained(a, a ^ other)
    assert far.mean() > 0.99 and left[far].mean() < 0.1
    assert (near_copies.distances(a, a ^ other)[far] == 999).all()


def test_crowded_keys_are_dealt_in_blocks_and_lose_no_pair(spark, monkeypatch):
    """Every pair of different groups meets in some cell, and no cell is large."""
    monkeypatch.setattr(near_copies, "CROWDED", 5)
    rng = random.Random(2)
    groups = {1: [0] * 23 + [rng.randrange(1, 9) for _ in range(17)], 2: [7] * 30, 3: list(range(12)), 4: [1, 2]}
    rows = [(k, node, g, 0) for k, of in groups.items() for node, g in enumerate(of)]
    posted = spark.createDataFrame(rows, "key long, node long, grp long, at long")
    crowds = spark.createDataFrame([(1, 0, 5, 4), (2, 7, 6, 0), (3, 0, 1, 3)], "key long, top long, ins long, outs long")
    cells = {}
    for r in near_copies.dealt(posted, crowds).collect():
        cells.setdefault(r.key, []).append((r.node, r.grp, r.side))
    met = {(min(a, b), max(a, b)) for x in cells.values() for a, g, s in x for b, h, t in x if g != h and (s != t or s == 2)}
    want = {(min(i, j), max(i, j)) for of in groups.values() for i, g in enumerate(of) for j, h in enumerate(of) if g != h}
    assert met == want
    assert max(len(x) for x in cells.values()) <= 25


@pytest.mark.parametrize("crowded, small, large", [(6, 3, 5), (40, 8, 20)])
def test_near_copies_in_crowded_keys(spark, monkeypatch, crowded, small, large):
    for name, value in (("CROWDED", crowded), ("SMALL", small), ("LARGE", large)):
        monkeypatch.setattr(near_copies, name, value)
    test_near_copies_within_templates(spark)


def signed_hash(b):
    import xxhash

    h = xxhash.xxh64_intdigest(b, 42)
    return h - (1 << 64) if h >> 63 else h


def brute_removed(rows, depth):
    """By a set of all strings seen; rows in the order of keys (null first), those of one key by their texts' hashes."""
    seen, out = set(), []
    for d, b in sorted(((d, (t or "").encode()) for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, signed_hash(r[1]))):
        gone = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            w = b[i : i + depth]
            if w in seen:
                gone[i : i + depth] = b"\1" * depth
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("busy, segment", [(1000, 1 << 20), (3, 500), (1, 1 << 20)])
def test_removed_digest(spark, monkeypatch, busy, segment):
    monkeypatch.setattr(suffix_dedup, "BUSY", busy)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(map(tuple, suffix_dedup.removed_digest(docs).collect()), key=repr)
    assert got == sorted(brute_removed(rows, 100), key=repr)


def sorted_batch(batches, order):
    import pyarrow as pa

    t = pa.Table.from_batches(list(batches))
    return t.sort_by([(c, "ascending") for c in order]).combine_chunks()


@pytest.mark.parametrize("docs, batch", [(2_000, 500), (8_000, 500), (8_000, 2_000)])
def test_windows_at_the_edges_of_a_shared_passage_spread(docs, batch):
    """No window travels more often than segments are filled, however many documents have the passage; and all repeats are found."""
    import pyarrow as pa

    rng = random.Random(3)
    passage = words(rng, 200)[:400]
    texts = [f"{words(rng, 8)}{i} {passage} {words(rng, 8)}".encode() for i in range(docs)]

    def batches(rows, kinds, names):
        for i in range(0, len(rows), batch):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + batch], strict=True), kinds, strict=True)], names=names)

    given = [(i, 0, i, t) for i, t in enumerate(texts)]
    long = pa.int64()
    order = ["a", "u", "did", "tie", "row", "start"]
    met = sorted_batch(suffix_dedup._units_task(100)(batches(given, (long, long, long, pa.binary()), ["did", "tie", "row", "body"])), ["sure", *order])
    settled = pa.Table.from_batches(list(suffix_dedup._settle_task(met.to_batches(max_chunksize=700)))).to_pylist()
    number = {}
    for r in settled:
        if not r["whole"]:
            number[r["a"]] = number.get(r["a"], 0) + 1
    assert max(number.values()) > suffix_dedup.BUSY
    wanted = {}
    for r in settled:
        if not r["whole"]:
            wanted.setdefault(r["row"], []).append({**{k: r[k] for k in ("a", "off", "start", "n")}, "busy": number[r["a"]] > suffix_dedup.BUSY})
    asked = [(i, 0, i, t, wanted[i]) for i, _, _, t in given if i in wanted]
    struct = pa.list_(pa.struct([("a", long), ("off", pa.int32()), ("start", long), ("n", pa.int32()), ("busy", pa.bool_())]))
    fetched = sorted_batch(suffix_dedup._fetch_task(100)(batches(asked, (long, long, long, pa.binary(), struct), ["did", "tie", "row", "body", "wanted"])), ["kind", *order])
    kinds = np.array(fetched["kind"])
    _, sizes = np.unique(np.array(fetched["a"])[kinds == suffix_dedup.WINDOW], return_counts=True)
    segments = 1 + sum(len(t) - len(passage) + 2 * 176 for t in texts) // suffix_dedup.SEGMENT
    assert sizes.max() <= segments
    removed = [(r["row"], r["start"], r["n"]) for r in settled if r["whole"]]
    for b in suffix_dedup._sort_task(100)(fetched.to_batches(max_chunksize=700)):
        removed += [(r["row"], r["start"], r["n"]) for r in b.to_pylist()]
    gone = {(row, start + i) for row, start, n in removed for i in range(n)}
    seen, want = set(), set()
    for i, t in enumerate(texts):
        for j in range(len(t) - 99):
            if t[j : j + 100] in seen:
                want.add((i, j))
            seen.add(t[j : j + 100])
    assert gone == want


def test_many_rows_without_a_key_or_of_one(spark):
    rng = random.Random(13)
    passages = [words(rng, 40) for _ in range(6)]
    rows = [(rng.choice([None, None, 7, i]), " ".join([words(rng, rng.randrange(6)), rng.choice(passages), words(rng, rng.randrange(6))])) for i in range(900)]
    got = sorted(map(tuple, suffix_dedup.removed_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted(brute_removed(rows, 100), key=repr)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("suffix_texts")]


def test_repeated_rows_and_empty_tables(spark):
    text = words(random.Random(4), 60)
    df = spark.createDataFrame([(1, text), (1, text), (2, text[:90])], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in suffix_dedup.removed_digest(df).collect())
    n = len(text.encode())
    assert got == [(1, 0), (1, n), (2, 0)]
    assert suffix_dedup.removed_digest(empty(spark)).count() == 0


def test_deduplicated_keeps_rows_and_columns(spark):
    docs = documents(spark).withColumn("z", F.lit(1)).withColumn("c0", F.lit("x"))
    out = suffix_dedup.deduplicated(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert out.count() == docs.count() and out.where("c0 = 'x' and z = 1 and fp = 'f'").count() == docs.count()
    assert out.where("text is null").count() == docs.where("text is null").count()
    assert out.agg(F.sum(F.length("text"))).first()[0] < docs.agg(F.sum(F.length("text"))).first()[0]


def test_radix_passes_find_exactly_the_repeats():
    rng = random.Random(9)
    bodies = [bytes(rng.choice(b"ab") for _ in range(30)) for _ in range(40)]
    n = np.full(40, 30 - 12 + 1)
    row, window = suffix_dedup.repeated_windows(np.zeros(40, np.int64), np.full(40, 20), n, bodies, 12)
    got = set(zip(row.tolist(), window.tolist(), strict=True))
    want = {(r, w) for r in range(40) for w in range(19) if any(bodies[p][w : w + 12] == bodies[r][w : w + 12] for p in range(r))}
    assert got == want


def test_filtered_rows_keep_columns_of_any_name(spark):
    """The filter's own columns are kept apart from the caller's, and where it would fill up all rows are others."""
    names = ["_word", "_bits", "_hit", "_gone_id", "row", "word", "bits", "hit", "at", "bit"]
    rows = spark.range(200).select("id", *[F.concat(F.lit(n), F.col("id")).alias(n) for n in names])
    wanted = common.stored(spark.range(50, 60), "wanted")
    out, hit = common.parted(rows, ["id"], wanted)
    assert out.columns == hit.columns == rows.columns
    assert {r.id for r in hit.collect()} >= set(range(50, 60)) and hit.count() < 30
    every = sorted(map(tuple, out.union(hit).collect()))
    assert every == sorted(map(tuple, rows.collect()))
    common.FILTER_WORDS, before = 0, common.FILTER_WORDS
    try:
        none, every = common.parted(rows, ["id"], wanted)
        assert none.count() == 0 and every.count() == 200
    finally:
        common.FILTER_WORDS = before


def test_windows_are_sorted_in_little_more_than_their_numbers():
    import tracemalloc

    rng = np.random.default_rng(5)
    text = rng.integers(97, 123, 20_000, dtype=np.uint8).tobytes()
    bodies, n = [text] * 10, np.full(10, len(text) - 99)
    tracemalloc.start()
    row, window = suffix_dedup.repeated_windows(np.zeros(10, np.int64), np.full(10, 30_000), n, bodies, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(zip(row.tolist(), window.tolist(), strict=True)) == [(r, w) for r in range(1, 10) for w in range(len(text) - 99)]
    assert peak < 130 * int(n.sum())
