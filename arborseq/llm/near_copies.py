"""Near copies: groups of texts whose word shingles overlap by a given Jaccard similarity.

Links come in two rounds, and both are verified on the shingle sets themselves.

The first only saves work.  Texts meet on sampled keys of ``KEY_BITS`` bits of a
128-bit SimHash in ``TABLES`` tables.  A bucket's pairs pass the pigeonring's chains
before the full check: fingerprints are cut into ``RING`` segments on a ring, and two
that differ in at most ``MOST`` bits have a start from which every chain of l segments
differs in at most ``l * MOST / RING`` bits.  Of what is left each bucket proposes a few
short links, so that large groups are found with links in proportion to documents.
What it misses or proposes in vain is left to the second.

The second is exact.  Under any one order of all shingles, two sets of a similarity
of at least t have their first common shingle among the first ``n - ceil(t * n) + 1``
of each, n being its size, and the k-th among that many plus k - 1.  So sets meet on
these, and on the more of them the larger they are.  The order has the shingles that
are frequent in a sample last, others before them by hash.  In a bucket every pair of
sets of different groups is looked at, and is dropped only by proven bounds: where
the first common shingles may stand, and that sketches of parities differ in no more
bits than the sets differ in shingles.  Buckets beyond a size are dealt out in blocks,
each pair of blocks a task's; nothing is left out.

What is shuffled: three numbers for each posting, all of what is compared only for
postings whose shingle several sets have, and texts only of rows that have links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, frugal, parted, salted_partitions, ship, stored, texts
from .components import components

#: Tables of the first round, least bits of their keys, and rows that a key should have on average.
TABLES, KEY_BITS, KEY_ROWS = 12, 14, 8
#: Pairs that differ in more bits aren't proposed in the first round.
MOST = 36
#: Segments of the fingerprints' ring, and the lengths of the chains that pairs pass before the full check.
RING, CHAINS = 16, (1, 2, 4, 8)
NEAREST = 1
#: Of a larger bucket's rows, links to this many nearest are weighed for the forest.
AROUND = 6
#: Larger buckets of the first round are dealt out, in each table anew, so what one table parts another joins.
LARGE = 512
#: So many documents are drawn to tell the frequent shingles, and so many shingles at most are told.
SAMPLE, FREQUENT = 20_000, 100_000
SKETCH_BITS = 1024
#: Columns of a sketch's words, and how many of them remain when it is folded for a first look.
SKETCH, FOLDED = [f"p{i}" for i in range(SKETCH_BITS // 64)], 4
#: Larger buckets of the second round are compared each by itself, and those beyond CROWDED block by block.
SMALL, CROWDED = 48, 4096
#: Sets must meet on one more shingle for each so many that they have.
STEP = 12


def places(bits: int) -> np.ndarray:
    """For each table the fingerprint bits that make its key."""
    rng = np.random.default_rng(20240229)
    return np.stack([rng.choice(128, bits, replace=False) for _ in range(TABLES)])


def shingles(text: str, width: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one shingle, a wordless one has none."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(line, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = [0, *ends[: len(words) - width].tolist()]
    return np.unique(np.array([xxh64_intdigest(line[i:j], seed) for i, j in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64))


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """Two words: bit i is set if more than half of the hashes have it set."""
    second = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    second ^= second >> np.uint64(29)
    both = np.stack([h, second * np.uint64(0xBF58476D1CE4E5B9)], axis=1)
    counts = np.zeros(128, dtype=np.int64)
    for i in range(0, len(h), 1 << 14):
        counts += np.unpackbits(np.ascontiguousarray(both[i : i + (1 << 14)]).view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")


def needed(n):
    """How many common shingles must be among the first of a set of n and of any larger set that is so similar."""
    return 1 + n // STEP


def prefix_size(n: int, similarity: float) -> int:
    """How many shingles of a set, in any common order, hold the first ``needed`` ones in common with any set so similar."""
    return min(n, n - int(np.ceil(similarity * n - 1e-9)) + needed(n))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Words for each set: the parities of its numbers of shingles in ``SKETCH_BITS`` cells."""
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    cell = ((flat * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - SKETCH_BITS.bit_length())).astype(np.int64)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    odd = np.bincount(row * SKETCH_BITS + cell, minlength=len(sets) * SKETCH_BITS) & 1
    return np.packbits(odd.astype(bool).reshape(-1, SKETCH_BITS), axis=1, bitorder="little").view("<u8")


def prefixes(sets: list[np.ndarray], frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> list[np.ndarray]:
    """The first shingles of each set, those of no known frequency before the others, then by frequency and hash."""
    known, count = frequent
    out = []
    for x in sets:
        n = prefix_size(len(x), similarity)
        if len(known):
            at = np.minimum(np.searchsorted(known, x), len(known) - 1)
            x = x[np.argsort(np.where(known[at] == x, count[at], 0), kind="stable")]
        out.append(x[:n])
    return out


ROWS = ", ".join(["id long, name binary", *[f"{x} long" for x in ("d", "e", "f", "g", "size", *SKETCH)], "prefix array<long>"])


def _fingerprint_task(width: int, similarity: float, shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = [shingles(x, width) for x in texts(batch.column(2))]
            digest = np.frombuffer(b"".join(hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets), dtype=np.int64).reshape(-1, 2)
            fp = np.array([wide_fingerprint(x) for x in sets], dtype=np.uint64).reshape(-1, 2).view(np.int64)
            sketch, first = sketches(sets).view(np.int64), prefixes(sets, shared.value, similarity)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in first])])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *first]).view(np.int64)))
            numbers = [*digest.T, *fp.T, np.array([len(x) for x in sets], dtype=np.int64), *sketch.T]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(np.ascontiguousarray(x)) for x in numbers], lists], names=[x.split()[0] for x in ROWS.split(", ")])

    return run


def _keys_task(bits: int):
    chosen = places(bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, f, g = (batch.column(i).to_numpy() for i in range(3))
            each = np.unpackbits(np.stack([f, g], axis=1).view(np.uint8).reshape(-1, 16), axis=1, bitorder="little")
            for t, at in enumerate(chosen):
                key = np.zeros((len(ids), 8), dtype=np.uint8)
                packed = np.packbits(each[:, at], axis=1)
                key[:, : packed.shape[1]] = packed
                key[:, 7] = t
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), *[pa.array(x) for x in (ids, f, g)]], names=["key", "id", "f", "g"])

    return run


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def chained(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of fingerprints have a start on the ring whose chains keep within their shares of ``MOST``; all that differ in no more bits do."""
    chain = np.bitwise_count((a ^ b).view(np.uint8))  # by start; a segment is a byte
    ok = chain <= MOST // RING
    for n in CHAINS[1:]:
        chain = chain + np.roll(chain, -(n // 2), axis=-1)
        ok &= chain <= n * MOST // RING
    return ok.any(axis=-1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits pairs of fingerprints differ; 999 where in more than ``MOST``.  The chains come first, the full check is left to what passes them."""
    out = np.full(np.broadcast_shapes(a.shape, b.shape)[:-1], 999)
    at = np.nonzero(chained(a, b))
    a, b = (np.broadcast_to(x, (*out.shape, x.shape[-1]))[at] for x in (a, b))
    d = apart(a, b)
    out[at] = np.where(d <= MOST, d, 999)
    return out


def bucket_links(fp: np.ndarray) -> np.ndarray:
    """Links (i, j) within one bucket of the first round: of each row with its nearest, and a shortest forest."""
    pairs, sizes = [], []
    k = min(AROUND, len(fp))
    for lo in range(0, len(fp), 256):
        rows = np.arange(lo, min(lo + 256, len(fp)))
        d = distances(fp[rows][:, None], fp[None])
        d[np.arange(len(rows)), rows] = 999
        j = np.argpartition(d, k - 1, axis=1)[:, :k]
        i = np.repeat(np.arange(len(rows)), k)
        ok = d[i, j.ravel()] < 999
        i, j = i[ok], j.ravel()[ok]
        pairs.append(np.stack([rows[i], j], axis=1))
        sizes.append(d[i, j])
    return thinned(np.concatenate(pairs), np.concatenate(sizes), len(fp))


def thinned(pair: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Of pairs of n rows, shortest first, those that join two trees or are among the nearest of their rows."""
    parent, count, out = list(range(n)), [0] * n, []
    for a, b in pair[np.argsort(size, kind="stable")].tolist():
        x, y = a, b
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y or count[a] < NEAREST or count[b] < NEAREST:
            parent[max(x, y)] = min(x, y)
            count[a] += 1
            count[b] += 1
            out.append((a, b))
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def whole_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of batches sorted by the first one, cut so that no run of equal keys is parted."""
    held: list[list[np.ndarray]] = []  # batches of the run that goes on
    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
        if not len(cols[0]):
            continue
        if held and held[0][0][0] == cols[0][-1]:
            held.append(cols)
            continue
        cols = [np.concatenate(x) for x in zip(*held, cols, strict=True)]
        last = np.flatnonzero(cols[0] != cols[0][-1])
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield [x[:cut] for x in cols]
        held = [[x[cut:] for x in cols]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _proposed_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cols in whole_runs(batches):
        for pairs in _proposed(*cols):
            pairs = np.unique(np.sort(pairs, axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _met_task(similarity: float):
    work = met(similarity)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in whole_runs(batches):
            for pairs, need, keys in work(*cols):
                pairs = np.sort(pairs, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(need), pa.array(keys)], names=["a", "b", "need", "met"])

    return run


def _proposed(key, ids, f, g) -> Iterator[np.ndarray]:
    """Links of the first round within runs of equal keys."""
    fp = np.stack([f, g], axis=1).view(np.uint64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
    sizes = np.diff(cuts)
    # pairs of small buckets are checked together, by how far apart their rows stand
    size = np.repeat(sizes, sizes)
    close, bits = [], []
    for lag in range(1, 8):
        i = np.flatnonzero((key[:-lag] == key[lag:]) & (size[:-lag] <= 8)) if lag < len(key) else np.zeros(0, int)
        d = distances(fp[i], fp[i + lag])
        ok = d <= MOST
        close.append(np.stack([i[ok], i[ok] + lag], axis=1))
        bits.append(d[ok])
    pair, bits = np.concatenate(close), np.concatenate(bits)
    links = []
    if len(pair):
        rows = np.unique(pair)  # a row is in one bucket of a run, so trees don't mix
        links.append(rows[thinned(np.searchsorted(rows, pair), bits, len(rows))])
    for at in np.flatnonzero(sizes > 8):
        links.append(cuts[at] + bucket_links(fp[cuts[at] : cuts[at + 1]]))
    if links:
        yield ids[np.concatenate(links)]


def _shared_keys_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, at, node) sorted by key, those whose key several rows have, under a number that names the nodes which have it.

    So keys that the same nodes share become one.  A crowded key keeps its own number, and is handed on as it comes.
    """
    held: list[np.ndarray] | None = None
    crowded = None

    def told(cols: list[np.ndarray]) -> pa.RecordBatch:
        key, at, node = cols
        starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        name = mixed(np.add.reduceat(mixed(node.view(np.uint64)), starts)).view(np.int64)
        large = (sizes > CROWDED) | (key[starts] == crowded)
        name = np.repeat(np.where(large, key[starts], name), sizes)
        keep = np.repeat(large | (sizes > 1), sizes)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (name, at, node)], names=["key", "at", "node"])

    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(3)]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        last = cols[0][-1]
        cut = int(np.searchsorted(cols[0], last))  # where the last run begins, which may go on
        if last == crowded or len(cols[0]) - cut > CROWDED:
            if last != crowded and cut:
                yield told([x[:cut] for x in cols])
                cols = [x[cut:] for x in cols]
            held, crowded = None, last
            yield told(cols)
        else:
            if cut:
                yield told([x[:cut] for x in cols])
            held = [x[cut:] for x in cols]
    if held is not None:
        yield told(held)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def met(similarity: float) -> Callable[..., Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Of rows sorted by key: all pairs of one key but of different groups that may be so similar.

    With the pairs' ids goes on how many shingles the pair must meet, and for how many this key stands.
    ``at`` is the first place of these in the set's order, ``words`` are the set's sketch.  Rows of ``side`` 2 meet all, others
    those of the other side.
    """

    def work(key, ids, group, side, size, at, weight, *words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        sketch = np.stack(words, axis=1).view(np.uint64)
        folded = np.bitwise_xor.reduce(sketch.reshape(len(sketch), -1, FOLDED), axis=1)

        def may(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Whether places i and j may be a link; both bounds hold for the first keys in common of any that is one, as many as needed."""
            both = size[i] + size[j]
            least = np.ceil(both * (similarity / (1 + similarity)) - 1e-9).astype(np.int64)
            spare = needed(np.minimum(size[i], size[j])) - 1
            ok = np.flatnonzero((group[i] != group[j]) & (at[i] + least <= size[i] + spare) & (at[j] + least <= size[j] + spare))
            most = both - 2 * least  # shingles that are in one set only; cells of sketches, folded or not, differ in no more
            for each in (folded, sketch):
                parts = np.array_split(ok, 1 + len(ok) // 100_000)  # sketches of so many pairs are held at once
                ok = np.concatenate([x[apart(each[i[x]], each[j[x]]) <= most[x]] for x in parts])
            return ok

        def told(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return np.stack([ids[i], ids[j]], axis=1), needed(np.minimum(size[i], size[j])), weight[i]

        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        sizes = np.diff(cuts)
        own = np.repeat(sizes, sizes)
        some = np.flatnonzero((own > 1) & (own <= SMALL))
        for lag in range(1, SMALL):
            i = some[:-lag][key[some[:-lag]] == key[some[lag:]]]
            if not len(i):
                break
            ok = may(i, i + lag)
            if len(ok):
                yield told(i[ok], i[ok] + lag)
        for x in np.flatnonzero(sizes > SMALL):
            rows = np.arange(cuts[x], cuts[x + 1])
            if (side[rows] == 2).all():
                _, number, counts = np.unique(group[rows], return_inverse=True, return_counts=True)
                # pairs within the largest group are links already: only what isn't in it is compared with the rest
                inner = number == counts.argmax()
            else:
                inner = side[rows] != 0
            rows = np.concatenate([rows[~inner], rows[inner]])
            first = int((~inner).sum())
            free = bool((side[rows] == 2).any())
            step = max(1, 1_000_000 // len(rows))
            for lo in range(0, first, step):
                hi = min(lo + step, first)
                begin = lo if free else first
                i, j = np.repeat(np.arange(lo, hi), len(rows) - begin), np.tile(np.arange(begin, len(rows)), hi - lo)
                i, j = rows[i[i < j]], rows[j[i < j]]
                ok = may(i, j)
                if len(ok):
                    yield told(i[ok], j[ok])

    return work


def dealt(posted: DataFrame, crowds: DataFrame) -> DataFrame:
    """Postings with ``side``; those of crowded keys go to cells of at most about twice CROWDED rows, and any two that differ in group meet in one.

    ``crowds`` has key, top (its largest group), and into how many blocks that group (``ins``) and the rest (``outs``)
    are cut.  Rows of the largest group meet only the rest: key, block of the group, block of the rest is a cell.  Two
    blocks of the rest are a cell, and so is one by itself.
    """
    rows = posted.join(crowds, "key", "left")
    own, many = F.lit(2).cast("long"), F.col("top").isNotNull()
    inner = F.col("grp") == F.col("top")
    block = F.pmod(F.xxhash64("node"), F.when(inner, F.col("ins")).otherwise(F.col("outs")))

    def cell(kind: int, a: Column, b: Column, side: Column) -> Column:
        return F.struct(F.xxhash64("key", F.lit(kind), a, b).alias("key"), side.cast("long").alias("side"))

    def numbers(of: str) -> Column:
        return F.when(F.col(of) > 0, F.sequence(F.lit(0).cast("long"), F.col(of) - 1)).otherwise(F.array().cast("array<long>"))

    with_top = F.transform(numbers("outs"), lambda j: cell(0, block, j, F.lit(1)))
    with_rest = F.transform(numbers("ins"), lambda i: cell(0, i, block, F.lit(0)))
    among = F.transform(numbers("outs"), lambda j: cell(1, F.least(block, j), F.greatest(block, j), F.when(block == j, 2).when(block < j, 0).otherwise(1)))
    cells = F.when(~many, F.array(F.struct(F.col("key").alias("key"), own.alias("side")))).when(inner, with_top).otherwise(F.concat(with_rest, among))
    others = [c for c in posted.columns if c != "key"]
    return rows.select(F.explode(cells).alias("c"), *others).select("c.key", "c.side", *others)


def _sets_task(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x, width).view(np.int64) for x in texts(batch.column(1))]
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))], names=["id", "s"])

    return run


def _shingles_task(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in texts(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(x, width).view(np.int64))], names=["h"])

    return run


def frequent_shingles(narrow: DataFrame, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the shingles that occur in most texts of a bounded sample of ``n`` texts, three at least."""
    share = min(1.0, SAMPLE / max(1, n))
    drawn = narrow.where(F.pmod(F.xxhash64("name"), F.lit(1 << 32)) < F.lit(int(share * (1 << 32)))).select("text")
    counts = drawn.mapInArrow(frugal(_shingles_task(width)), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    told = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    known, count = told["h"].to_numpy().view(np.uint64), told["n"].to_numpy()
    order = np.argsort(known)
    return known[order], count[order]


def text_name(text: Column) -> Column:
    """A digest that names a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def near_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, name, component_id) of every row with a key: its key, its text's name, the smallest key of its group.

    Groups are connected by pairs of texts with at least this Jaccard similarity of their sets of word shingles (ASCII
    lower case); no such pair is left out.  Wordless texts, null or not, are one group, and equal texts are in one.
    Rows that share a key are told apart by their texts.  Rows without a key take no part.  Other columns play no part.
    """
    spark = docs.sparkSession
    ship(spark)
    n = salted_partitions(spark)
    narrow = docs.select(F.col(key).cast("long").alias("id"), text_name(F.col(text)).alias("name"), F.col(text).alias("text")).where("id is not null")
    many = narrow.count()
    shared = spark.sparkContext.broadcast(frequent_shingles(narrow, width, many))  # at most FREQUENT shingles
    rows = stored(narrow.mapInArrow(frugal(_fingerprint_task(width, similarity, shared)), ROWS), "wide-fingerprints")
    shared.unpersist()
    # a class is a set of shingles; all but its first row's key and name follow from the set
    sets_of = rows.groupBy("d", "e").agg(F.count(F.lit(1)).alias("n"))
    again = stored(sets_of.where("n > 1").select("d", "e"), "wide-again")
    alone, several = parted(rows, ["d", "e"], again)
    alike = ["f", "g", "size", *SKETCH, "prefix"]
    first = several.groupBy("d", "e").agg(F.min(F.struct("id", "name")).alias("r"), *[F.first(x).alias(x) for x in alike])
    several = first.select("d", "e", "r.id", "r.name", *alike)
    classes = stored(alone.select(*several.columns).union(several).select(F.monotonically_increasing_id().alias("node"), "*"), "wide-distinct")
    named_rows = stored(rows.select("id", "name", "d", "e"), "near-rows")
    discard(rows, again)

    def verified(links: DataFrame) -> DataFrame:
        """Those of the links (a, b) that hold on the shingle sets."""
        found = stored(links.distinct(), "near-links")
        ends = found.select(F.col("a").alias("node")).union(found.select(F.col("b").alias("node"))).distinct()
        ends = stored(classes.select("node", "id", "name").join(ends, "node", "left_semi"), "near-ends")
        wanted = parted(narrow, ["id", "name"], ends)[1]  # of the texts, only these and a few more are shuffled
        sets = wanted.join(ends, ["id", "name"]).select(F.col("node").alias("id"), "text").mapInArrow(frugal(_sets_task(width)), "id long, s array<long>")
        sets = stored(sets.groupBy("id").agg(F.first("s").alias("s")), "shingle-sets")  # of rows that repeat
        one = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
        two = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
        common = F.size(F.array_intersect("sa", "sb"))
        out = stored(found.join(one, "a").join(two, "b").where(common >= similarity * (F.size("sa") + F.size("sb") - common)).select("a", "b"), "near-verified")
        discard(found, ends, sets)
        return out

    # first round
    bits = min(56, max(KEY_BITS, (many // KEY_ROWS).bit_length()))
    keyed = classes.select("node", "f", "g").mapInArrow(frugal(_keys_task(bits)), "key long, id long, f long, g long")
    large = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LARGE)
    large = stored(large.select("key", F.ceil(F.col("_n") / LARGE).alias("parts")), "near-large")
    part = F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.pmod(F.xxhash64("id", "key"), F.col("parts"))))
    keyed = keyed.join(large, "key", "left").select(part.alias("key"), "id", "f", "g")
    some = verified(keyed.repartition(n, "key").sortWithinPartitions("key", "id").mapInArrow(frugal(_proposed_task), "a long, b long"))
    found = stored(components(some, "a", "b"), "near-first")
    # second round: postings of shingles that several sets have, then with what is to be compared
    slim = classes.select("node", F.posexplode("prefix").alias("at", "key")).select("key", F.col("at").cast("long"), "node")
    shared_keys = slim.repartition(n, "key").sortWithinPartitions("key").mapInArrow(frugal(_shared_keys_task), "key long, at long, node long")
    posted = stored(shared_keys.groupBy("key", "node").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("weight")), "near-postings")
    # a set that shares fewer than any partner needs has none
    least = 1 + F.floor(F.ceil(F.col("size") * F.lit(similarity) - 1e-9) / STEP)
    some_shared = posted.groupBy("node").agg(F.sum("weight").alias("_n"))
    info = classes.select("node", "size", *SKETCH).join(some_shared, "node").where(F.col("_n") >= least).drop("_n")
    info = stored(info.join(found, "node", "left").withColumn("grp", F.coalesce("root", "node")).drop("root"), "near-info")
    full = posted.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWDED).select("key")
    by_group = posted.join(full, "key").join(info.select("node", "grp"), "node").groupBy("key", "grp").agg(F.count(F.lit(1)).alias("_n"))
    crowds = by_group.groupBy("key").agg(F.max_by("grp", "_n").alias("top"), F.max("_n").alias("ins"), (F.sum("_n") - F.max("_n")).alias("outs"))
    blocks = [F.ceil(F.col(x) / CROWDED).cast("long").alias(x) for x in ("ins", "outs")]
    crowds = stored(crowds.select("key", "top", *blocks), "near-crowds")
    keyed = dealt(posted.join(info, "node"), crowds).select("key", "node", "grp", "side", "size", "at", "weight", *SKETCH)
    meetings = keyed.repartition(n, "key").sortWithinPartitions("key", "node").mapInArrow(frugal(_met_task(similarity)), "a long, b long, need long, met long")
    rest = verified(meetings.groupBy("a", "b").agg(F.sum("met").alias("_n"), F.first("need").alias("need")).where("_n >= need").select("a", "b"))
    groups = stored(components(some.union(rest), "a", "b"), "near-groups")
    least = groups.join(classes.select("node", "id"), "node").groupBy("root").agg(F.min("id").alias("least"))
    named = stored(groups.join(stored(least, "near-least"), "root").select("node", "least"), "near-named")
    named = stored(classes.join(named, "node", "left").select("d", "e", F.coalesce("least", "id").alias("component_id")), "near-classes")
    out = stored(named_rows.join(named, ["d", "e"]).select("id", "name", "component_id"), "near-components")
    discard(classes, named_rows, named, large, some, found, posted, info, crowds, rest, groups)
    return out


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(key, component_id) of the rows whose key isn't the smallest of their group; see ``near_rows``."""
    return near_rows(docs, key, text, width, similarity).where("id <> component_id").select(F.col("id").alias(key), "component_id")
