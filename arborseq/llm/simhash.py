"""SimHash near-duplicate groups with pigeonring filtering.

Fingerprints of 64 bits are cut into eight segments on a ring.  If two of them
differ in at most three bits, then from some start every chain of l consecutive
segments differs in at most ``l * 3 / 8`` bits: none in the first two, one in the
first three to five, two in six or seven, three in all.  So two segments and two
of the next three are equal: 8 starts with 3 choices give 24 keys of 32 bits by
which candidates meet.  Within a key, however many meet there, pairs pass the chains
from its start before the full check.

Equal fingerprints are one entry from the start, so a group of copies costs one
row for each task.  From a key's candidates only a spanning forest of links is
emitted, never all pairs; crowded keys are dealt out further by the segments not
yet used (of four segments with three differences one is equal).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_partitions, ship, stored, texts
from .components import components

SEGMENTS, BITS = 8, 3
#: Most differences in a chain of 1 to 8 segments.
BUDGET = np.array([n * BITS // SEGMENTS for n in range(1, SEGMENTS + 1)])
#: For each start, the bits of the chains whose budgets imply those of all others: two, five and seven segments.
CHAINS = tuple(
    (int(BUDGET[n - 1]), np.array([sum(255 << 8 * ((start + x) % SEGMENTS) for x in range(n)) for start in range(SEGMENTS)], dtype=np.uint64))
    for n in (2, 5, 7)
)
#: Keys with more fingerprints are dealt out by a further segment.
CROWDED = 4096
SMALL = 48


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of a text, unsigned: ASCII lower case, words between ASCII white space, XXH64 of word shingles."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = [0, *ends[: len(words) - shingle].tolist()]
    h = np.array([xxh64_intdigest(line[i:j], seed) for i, j in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 15):
        counts += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp) of every row, fp as a signed long; null or wordless text has fingerprint zero."""
    ship(docs.sparkSession)
    narrow = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = dict(narrow.dtypes)["id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x, shingle, seed) for x in texts(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return narrow.mapInArrow(run, f"id {kind}, fp long")


def ring_keys():
    """The 24 (key, start) columns of a fingerprint: number of the key and its four segments."""
    def segment(i):
        return F.shiftrightunsigned("fp", 8 * (i % SEGMENTS)).bitwiseAND(F.lit(255))

    out = []
    for start in range(SEGMENTS):
        for free in (2, 3, 4):
            used = [0, 1] + [x for x in (2, 3, 4) if x != free]
            key = F.lit((start * 3 + free - 2) << 32).cast("long")
            for at, x in enumerate(used):
                key = key + F.shiftleft(segment(start + x), 8 * at)
            out.append(key)
    return F.array(*out)


def free_segments(number: int) -> list[int]:
    """The segments that the key of this number leaves open."""
    start, free = divmod(number, 3)
    return [(start + x) % SEGMENTS for x in (free + 2, 5, 6, 7)]


class Forest:
    """Union-find over a task's fingerprints; keeps the links that joined two trees."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self.root(x), self.root(y)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                self.links.append((x, y))


def near(x: np.ndarray, start) -> np.ndarray:
    """Which of these exclusive-ors are links whose chains from ``start`` (one, or one each) keep within their budgets.

    The chains come first, the full check is left to what passes them.  Every link passes from some start, and its ends
    meet in a key of that start.
    """
    ok = np.ones(len(x), dtype=bool)
    for most, bits in CHAINS:
        ok &= np.bitwise_count(x & bits[start]) <= most
    ok[ok] = np.bitwise_count(x[ok]) <= BITS
    return ok


def link_crowd(fps: np.ndarray, start: int, open_segments: list[int], forest: Forest) -> None:
    """Link the distinct fingerprints of one key, however many, by the chains from its start."""
    if len(fps) > CROWDED and open_segments:
        bytes_ = fps.view(np.uint8).reshape(-1, SEGMENTS)
        for s in open_segments:  # one of them is equal in any linked pair, as at most three differ
            order = np.argsort(bytes_[:, s], kind="stable")
            for part in np.split(fps[order], np.flatnonzero(np.diff(bytes_[order, s])) + 1):
                if len(part) > 1:
                    link_crowd(part, start, [x for x in open_segments if x != s] if len(open_segments) > BITS + 1 else [], forest)
        return
    left = fps
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = near(left ^ x, start)
            if hit.any():
                found = left[hit]
                forest.join(np.full(len(found), x).view(np.int64), found.view(np.int64))
                queue.extend(found)
                left = left[~hit]


def link_sorted(keys: np.ndarray, fps: np.ndarray, numbers: np.ndarray, forest: Forest) -> None:
    """Link within runs of equal keys; fingerprints are distinct within a run."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
    sizes = np.diff(cuts)
    size = np.repeat(sizes, sizes)
    for at in np.flatnonzero(sizes > SMALL):
        a, b = cuts[at], cuts[at + 1]
        link_crowd(np.unique(fps[a:b]), int(numbers[a]) // 3, free_segments(int(numbers[a])), forest)
    for lag in range(1, SMALL):
        i = np.flatnonzero((keys[:-lag] == keys[lag:]) & (size[:-lag] <= SMALL)) if lag < len(keys) else np.zeros(0, dtype=int)
        if not len(i):
            break
        i = i[near(fps[i] ^ fps[i + lag], numbers[i] // 3)]
        forest.join(fps[i].view(np.int64), fps[i + lag].view(np.int64))


def _link_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task's rows (key, more, fp), sorted by key; a run that goes on is kept until it ends."""
    forest = Forest()
    held = None

    def work(k, m, f):
        same = k.astype(np.int64) * np.int64(1 << 11) + m  # the key's number and segments, then the further segment
        link_sorted(same, f.view(np.uint64), k >> 32, forest)

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        k, m, f = cols
        if not len(k):
            continue
        last = np.flatnonzero((k != k[-1]) | (m != m[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        work(k[:cut], m[:cut], f[:cut])
        held = [x[cut:] for x in cols]
    if held is not None:
        work(*held)
    if forest.links:
        a, b = zip(*forest.links, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough of them to connect every group."""
    n = salted_partitions(distinct.sparkSession)
    rows = distinct.select("fp", F.explode(ring_keys()).alias("key"))
    crowded = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWDED).select("key", F.lit(True).alias("_crowded")), "crowded")
    number = F.shiftright("key", 32)
    start, free = F.floor(number / 3), F.pmod(number, F.lit(3))
    further = []
    for j, at in enumerate((free + 2, F.lit(5), F.lit(6), F.lit(7))):
        shift = (F.pmod(start + at, F.lit(SEGMENTS)) * 8).cast("int")
        value = F.call_function("shiftrightunsigned", F.col("fp"), shift).bitwiseAND(F.lit(255)).cast("long")
        further.append(F.lit(1 + j * 256).cast("long") + value)
    dealt = rows.join(crowded, "key", "left").select("key", F.explode(F.when(F.col("_crowded"), F.array(*further)).otherwise(F.array(F.lit(0).cast("long")))).alias("more"), "fp")
    return dealt.repartition(n, "key", "more").sortWithinPartitions("key", "more", "fp").mapInArrow(_link_task, "a long, b long")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: key, fp (signed), component_id.

    component_id is the smallest key among all rows whose fingerprints are reachable by links of at most three bits,
    the row's own included; null only if all those keys are null.  Rows may repeat; other columns play no part.
    """
    rows = stored(fingerprints(docs, key, text, shingle, seed), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    groups = stored(components(links(distinct.select("fp")), "a", "b"), "fingerprint-groups")
    least = groups.join(distinct, groups.node == distinct.fp).groupBy("root").agg(F.min("first").alias("least"))
    named = groups.join(least, "root").select(F.col("node").alias("fp"), "least")
    classes = stored(distinct.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "classes")
    return rows.join(classes, "fp").select(F.col("id").alias(key), "fp", "component_id")
