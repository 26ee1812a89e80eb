"""Removal of repeated byte strings by a depth-limited, distributed radix sort of suffixes.

Two suffixes matter to each other only if they agree for ``depth`` bytes, so
suffixes are ordered no further than that, by passes over most significant digits,
and a group that shrinks to one suffix leaves the sort at once.

* The first digit is chosen by content: of all ``GRAM``-byte strings in a window of
  ``depth`` bytes, the one with the least hash (its anchor).  Equal windows have
  equal anchors at equal places.  A run of windows with one anchor is a unit; there
  is about one unit for 40 bytes, so what is shuffled is small beside the text.
* The second digit is the unit's whole string.  Equal units are equal window by
  window: all but the first are removed.  An anchor with a single unit is done.
* Only units that share an anchor but differ go on.  Their strings are fetched, and
  their windows, grouped by anchor and place, are sorted eight bytes a pass, most
  significant first, through ``depth`` bytes.  Groups left then are exactly the
  repeated windows; all but the first occurrence are removed.
* Where very many different units share an anchor, as at the edges of a passage that
  many documents have, they go on as single windows: the whole window is the digit, so
  what meets is equal, and one pass over the sorted rows tells the first of each.

Anchors and units are compared by 64-bit polynomial hashes of different bases, 128 bits
together, and so are single windows.

Texts are shuffled once, into a table bucketed by document; later steps bring only
positions to it.  Equal units and windows of a batch are settled before they are shuffled,
so a passage costs one task a row for each batch, not for each document.  Groups are
streamed in sorted order; what a task holds is a batch and at most BUSY strings.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, frugal, salted_partitions, shared_dir, ship, shuffles_cleaned, stored

GRAM = 24
SEGMENT = 1 << 20
#: Different units of one anchor from which on they are dealt out as single windows.
BUSY = 1_000
#: Windows sorted at a time.
SORTED = 2_000_000

_M = np.uint64(0x9E3779B97F4A7C15)
_N = np.uint64(0xA0761D6478BD642F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    known = _powers.get(int(base))
    if known is None or len(known[0]) < n:
        both = []
        for m in (base, np.uint64(pow(int(base), -1, 1 << 64))):
            p = np.full(n, m, dtype=np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers[int(base)] = tuple(both)
    return _powers[int(base)]


def scanned(data: np.ndarray, base: np.uint64) -> np.ndarray:
    """Running sums of bytes times powers of the base: the difference of two, shifted back, is a string's hash."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1, base)[0][: len(data)], dtype=np.uint64, out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(0xC2B2AE3D27D4EB4F)


def units(data: np.ndarray, bounds: np.ndarray, depth: int, gram: int = GRAM):
    """Units of the documents in ``data`` (bytes; document d is bounds[d]:bounds[d+1]).

    Returns anchor hash, unit hash, first window's start, number of windows, and anchor's offset in the first window.
    """
    n = len(data)
    if n < depth:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z.astype(np.uint64), z, z, z
    scan = scanned(data, _M)
    h = mix((scan[gram:] - scan[:-gram]) * powers(n + 1, _M)[1][: n - gram + 1])
    width = depth - gram + 1
    least = (h & ~np.uint64((1 << 28) - 1)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: span - width], least[width - span :])
    anchor = (least & np.uint64((1 << 28) - 1)).astype(np.int64)
    whole = np.ones(len(anchor), dtype=bool)
    for e in bounds[1:-1].tolist():
        whole[max(0, e - depth + 1) : e] = False
    at = np.flatnonzero(whole)
    if not len(at):
        return units(data[:0], bounds[:1], depth, gram)
    p = anchor[at]
    cut = np.flatnonzero((p[1:] != p[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    first, last = at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])]
    p = p[np.concatenate([[0], cut])]
    count, offset = last - first + 1, p - first
    scan = scanned(data, _N)  # a base of its own, so the two hashes don't fail together
    whole_hash = (scan[last + depth] - scan[first]) * powers(n + 1, _N)[1][first]
    u = mix(whole_hash ^ ((count << 16 | offset).astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)))
    return h[p], u, first, count, offset


def segments(bodies: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of documents of about SEGMENT bytes, longer ones in parts that overlap by depth - 1: bytes, bounds, row of each part and where it starts there."""
    parts, rows, starts, size = [], [], [], 0

    def out():
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64), np.array(rows), np.array(starts)

    for row, body in enumerate(bodies):
        if len(body) < depth:
            continue
        for s in range(0, len(body) - depth + 1, SEGMENT):
            parts.append(body[s : s + SEGMENT + depth - 1])
            rows.append(row)
            starts.append(s)
            size += len(parts[-1])
            if size >= SEGMENT:
                yield out()
                parts, rows, starts, size = [], [], [], 0
    if parts:
        yield out()


UNIT = "a long, u long, did long, tie long, row long, start long, n int, off int, sure boolean"


def spread(*x: np.ndarray) -> np.ndarray:
    """A number for each row that sends rows anywhere, for those that only travel along."""
    out = np.zeros(len(x[0]), np.uint64)
    for y in x:
        out = mix(out ^ y.astype(np.int64).view(np.uint64))
    return out.view(np.int64)


def _units_task(depth: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, tie, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            found = []
            for data, bounds, rows, starts in segments(batch.column(3).to_pylist(), depth):
                a, u, first, n, off = units(data, bounds, depth)
                part = np.searchsorted(bounds, first, side="right") - 1
                row = rows[part]
                found.append((a.view(np.int64), u.view(np.int64), did[row], tie[row], place[row], first - bounds[part] + starts[part], n, off))
            if not found:
                continue
            a, u, d, t, row, start, n, off = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((start, row, t, d, u, a))
            a, u, d, t, row, start, n, off = (x[order] for x in (a, u, d, t, row, start, n, off))
            # a unit that this batch has earlier is settled: it goes along only to reach its document
            sure = np.concatenate([[False], (a[1:] == a[:-1]) & (u[1:] == u[:-1])])
            a = np.where(sure, spread(row, start), a)
            columns = (a, u, d, t, row, start, n.astype(np.int32), off.astype(np.int32), sure)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "u", "did", "tie", "row", "start", "n", "off", "sure"])

    return run


UNIT_PLACE = ("row", "start", "n", "off", "a")


def _settle_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From units sorted by (sure, a, u, did, tie, row, start): repeated ones (``whole``), and the first of each unit whose anchor has several.

    Streams; of the rows before a batch only the last anchor, its first row and its last unit are remembered.
    """
    seen = None  # anchor, unit of the last row; the first row of its anchor while no other unit has come
    for batch in batches:
        if not batch.num_rows:
            continue
        c = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        m = len(c["a"])
        sure, a, u = c["sure"].astype(bool), c["a"], c["u"]
        same_a = np.zeros(m, bool)
        same_u = np.zeros(m, bool)
        same_a[1:] = (a[1:] == a[:-1]) & ~sure[1:] & ~sure[:-1]
        same_u[1:] = same_a[1:] & (u[1:] == u[:-1])
        extra = None
        if seen is not None and not sure[0]:
            same_a[0] = a[0] == seen["a"]
            same_u[0] = same_a[0] and u[0] == seen["u"]
        first_of_unit = ~sure & ~same_u
        group = np.cumsum(~same_a)
        other = np.zeros(int(group[-1]) + 1, bool)  # groups with more than one unit
        other[group[first_of_unit & same_a]] = True
        if same_a[0]:
            if seen["pending"] is not None:
                if other[group[0]]:
                    extra = seen["pending"]
            else:
                other[group[0]] = True
        whole = sure | same_u
        partial = first_of_unit & other[group]
        keep = whole | partial
        out = [c[n][keep] for n in UNIT_PLACE] + [whole[keep]]
        if extra is not None:
            out = [np.concatenate([[x], y]) for x, y in zip(extra, out, strict=True)]
        # what the last anchor leaves behind
        if sure[-1]:
            seen = None
        else:
            begin = int(np.flatnonzero(~same_a)[-1]) if (~same_a).any() else 0
            if same_a[begin]:  # the whole batch belongs to the anchor before it
                pending = None if other[group[-1]] else seen["pending"]
            else:
                pending = None if other[group[-1]] else [c[n][begin] for n in UNIT_PLACE] + [False]
            seen = {"a": a[-1], "u": u[-1], "pending": pending}
        kinds = (np.int64, np.int64, np.int32, np.int32, np.int64, bool)
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x, dtype=k)) for x, k in zip(out, kinds, strict=True)], names=[*UNIT_PLACE, "whole"])


#: Kinds of pieces: a unit's string, a window of a busy anchor (compared by a and u), windows that are already settled.
STRING, WINDOW, SETTLED = range(3)
PIECE = "kind int, a long, u long, off int, did long, tie long, row long, start long, n int, body binary"


def _pieces(kind: int, did, tie, row, start, n, a=None, u=None, off=None, bodies: list[bytes] | None = None) -> pa.RecordBatch:
    m = len(row)
    zero = np.zeros(m, np.int64)
    numbers = [np.full(m, kind, np.int32), a if a is not None else zero, u if u is not None else zero, off if off is not None else zero, did, tie, row, start, n]
    kinds = (np.int32, np.int64, np.int64, np.int32, np.int64, np.int64, np.int64, np.int64, np.int32)
    columns = [pa.array(np.asarray(x, dtype=k)) for x, k in zip(numbers, kinds, strict=True)] + [pa.array(bodies, pa.binary()) if bodies is not None else pa.nulls(m, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "a", "u", "off", "did", "tie", "row", "start", "n", "body"])


def single_windows(places: list[tuple], bodies: list[bytes], depth: int) -> Iterator[pa.RecordBatch]:
    """The windows of units (did, tie, row, start, n), each with its hashes; those that come earlier here are settled, as runs."""
    did, tie, row, start, n = (np.array(x, dtype=np.int64) for x in zip(*places, strict=True))
    data = np.frombuffer(b"".join(bodies), np.uint8)
    unit = np.repeat(np.arange(len(n)), n)
    window = np.arange(len(unit)) - np.repeat(np.cumsum(n) - n, n)
    p = (np.cumsum(n + depth - 1) - (n + depth - 1))[unit] + window
    hashes = []
    for base in (_M, _N):
        scan = scanned(data, base)
        hashes.append(mix((scan[p + depth] - scan[p]) * powers(len(data) + 1, base)[1][p]).view(np.int64))
    did, tie, row, start = did[unit], tie[unit], row[unit], start[unit] + window
    order = np.lexsort((start, row, tie, did, hashes[1], hashes[0]))
    a, u, did, tie, row, start = (x[order] for x in (*hashes, did, tie, row, start))
    again = np.concatenate([[False], (a[1:] == a[:-1]) & (u[1:] == u[:-1])])
    new = ~again
    yield _pieces(WINDOW, did[new], tie[new], row[new], start[new], np.ones(int(new.sum())), a[new], u[new])
    if again.any():
        order = np.flatnonzero(again)[np.lexsort((start[again], row[again]))]
        row, start = row[order], start[order]
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]))
        zero = np.zeros(len(first))
        yield _pieces(SETTLED, zero, zero, row[first], start[first], np.diff(np.concatenate([first, [len(row)]])), spread(row[first], start[first]))


def _fetch_task(depth: int):
    """The strings of a document's partial units; those of busy anchors as single windows, a segment's together."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: list[tuple] = []
        bodies: list[bytes] = []
        size = 0
        for batch in batches:
            quiet: list[tuple] = []
            for did, tie, row, body, wanted in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                for w in wanted:
                    place, string = (did, tie, row, w["start"], w["n"]), body[w["start"] : w["start"] + w["n"] + depth - 1]
                    if not w["busy"]:
                        quiet.append((*place, w["a"], 0, w["off"], string))
                        continue
                    places.append(place)
                    bodies.append(string)
                    size += len(string)
                    if size >= SEGMENT:
                        yield from single_windows(places, bodies, depth)
                        places, bodies, size = [], [], 0
            if quiet:
                *numbers, strings = zip(*quiet, strict=True)
                yield _pieces(STRING, *numbers, bodies=list(strings))
        if places:
            yield from single_windows(places, bodies, depth)

    return run


def repeated_windows(anchor: np.ndarray, off: np.ndarray, n: np.ndarray, bodies: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, window) of every window that an earlier row has too, rows being in the order of their occurrences.

    Windows are grouped by anchor and its place in them and sorted by passes of eight bytes, the most significant
    first; windows alone in their group drop out after each pass.
    """
    buffer = np.frombuffer(b"".join(bodies) + bytes(8), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])[:-1]
    row = np.repeat(np.arange(len(n)), n)
    window = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    begin, place = at[row] + window, off[row] - window
    _, number = np.unique(anchor, return_inverse=True)
    _, group = np.unique(number[row].astype(np.int64) * 65536 + place, return_inverse=True)
    live = np.arange(len(row))
    for d in range(0, depth, 8):
        size = np.bincount(group, minlength=1)
        keep = size[group] > 1
        live, group = live[keep], group[keep]
        if not len(live):
            break
        word = np.lib.stride_tricks.sliding_window_view(buffer, min(8, depth - d))[begin[live] + d]
        if word.shape[1] < 8:
            word = np.concatenate([word, np.zeros((len(word), 8 - word.shape[1]), np.uint8)], axis=1)
        digit = np.ascontiguousarray(word).view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((live, digit, group))
        live, group, digit = live[order], group[order], digit[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])])
        group = np.cumsum(new) - 1
    if not len(live):
        return live, live
    order = np.lexsort((live, group))
    live, group = live[order], group[order]
    again = np.concatenate([[False], group[1:] == group[:-1]])
    hit = np.sort(live[again])
    return row[hit], window[hit]


def _sort_task(depth: int):
    """Removed windows, as runs (row, start, n), from pieces sorted by (kind, a, u, did, tie, row, start)."""
    names = ["row", "start", "n"]

    def settled(rows: list[np.ndarray], bodies: list[bytes]) -> Iterator[pa.RecordBatch]:
        a, off, place, start, n = rows
        # bound what is sorted at once: windows with other places of the anchor never meet
        low, high = int((off - n).min()) + 1, int(off.max())
        parts = max(1, -(-int(n.sum()) // SORTED))
        for lo in range(low, high + 1, max(1, -(-(high - low + 1) // parts))):
            hi = min(high, lo + max(1, -(-(high - low + 1) // parts)) - 1)
            skip = np.maximum(0, off - hi)  # windows i with lo <= off - i <= hi
            m = np.minimum(n - 1, off - lo) - skip + 1
            use = np.flatnonzero(m > 0)
            if not len(use):
                continue
            cut = [bodies[i][skip[i] : skip[i] + m[i] + depth - 1] for i in use]
            r, w = repeated_windows(a[use], (off - skip)[use], m[use], cut, depth)
            if not len(r):
                continue
            r, w = use[r], w + skip[use[r]]
            new = np.concatenate([[True], (r[1:] != r[:-1]) | (w[1:] != w[:-1] + 1)])
            first = np.flatnonzero(new)
            sizes = np.diff(np.concatenate([first, [len(r)]]))
            at = r[first]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (place[at], start[at] + w[first], sizes.astype(np.int32))], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # strings of one anchor, which isn't busy
        held_bodies: list[bytes] = []
        last = None  # the hashes of the window before
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names) if n != "body"}
            kind = c["kind"]
            done = kind == SETTLED
            single = np.flatnonzero(kind == WINDOW)
            if len(single):
                a, u = c["a"][single], c["u"][single]
                again = np.concatenate([[last == (a[0], u[0])], (a[1:] == a[:-1]) & (u[1:] == u[:-1])])
                last = (a[-1], u[-1])
                done[single[again]] = True
            if done.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[n][done]) for n in names], names=names)
            strings = np.flatnonzero(kind == STRING)
            if not len(strings):
                continue
            rows = [c[n][strings] for n in ("a", "off", "row", "start", "n")]
            bodies = batch.column(batch.num_columns - 1).take(pa.array(strings)).to_pylist()
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
                bodies = held_bodies + bodies
            before = np.flatnonzero(rows[0] != rows[0][-1])
            cut = int(before[-1]) + 1 if len(before) else 0
            if cut:
                yield from settled([x[:cut] for x in rows], bodies[:cut])
            held, held_bodies = [x[cut:] for x in rows], bodies[cut:]
        if held is not None and len(held[0]):
            yield from settled(held, held_bodies)

    return run


def spans_of(found: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted, merged spans of bytes."""
    out: list[list[int]] = []
    for s, e in sorted((p["start"], p["end"]) for p in found or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = 100, columns: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs``: _did, _row, _body (bytes), _null_key, ``columns``, and _spans (start, end) of removed bytes.

    Every byte is removed that a ``depth``-byte string covers which also starts earlier: in a row that comes before, or
    in the same row further left.  Rows come in the order of their keys, a null key before any other, and rows that
    share a key, null or not, in the order of their texts' hashes; of rows equal in both one counts as the first, no
    matter which.
    Strings are judged on the input, and never cross rows.  Null text counts as empty.
    """
    spark = docs.sparkSession
    ship(spark)
    n = salted_partitions(spark)
    if dict(docs.dtypes)[key] not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError("keys must be integers")
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    none = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.coalesce(F.col(key).cast("long"), none).alias("_did"), F.monotonically_increasing_id().alias("_row"), F.col(key).isNull().alias("_null_key"), body.alias("_body"), F.xxhash64(body).alias("_tie"), *[F.col(c).alias(f"_col_{i}") for i, c in enumerate(columns)])
    name = f"suffix_texts_{uuid.uuid4().hex}"
    # a row's place makes its bucket, so rows without a key, or that share one, don't gather
    with shuffles_cleaned(spark):
        rows.repartition(n, "_row").write.bucketBy(n, "_row").option("path", shared_dir(spark, "texts")).option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only its name: the files are where the path says
    # first and second digit: anchors, then units
    order = ["a", "u", "did", "tie", "row", "start"]
    found = table.select("_did", "_tie", "_row", "_body").mapInArrow(frugal(_units_task(depth)), UNIT)
    met = found.repartition(n, "a").select("sure", *order, "n", "off").sortWithinPartitions("sure", *order)
    settled = stored(met.mapInArrow(frugal(_settle_task), "row long, start long, n int, off int, a long, whole boolean"), "units")
    # further digits: the windows of units that share an anchor and differ
    partial = settled.where(~F.col("whole"))
    busy = stored(partial.groupBy("a").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BUSY).select("a", F.lit(True).alias("busy")), "busy")
    wanted = partial.join(busy, "a", "left").groupBy("row").agg(F.collect_list(F.struct("a", "off", "start", "n", F.coalesce("busy", F.lit(False)).alias("busy"))).alias("wanted"))
    fetched = table.join(wanted, table._row == wanted.row).select("_did", "_tie", "_row", "_body", "wanted").mapInArrow(frugal(_fetch_task(depth)), PIECE)
    sorted_ = stored(fetched.repartition(n, "a").sortWithinPartitions("kind", *order).mapInArrow(frugal(_sort_task(depth)), "row long, start long, n int"), "windows")
    discard(busy)
    removed = settled.where("whole").select("row", "start", "n").union(sorted_)
    spans = removed.groupBy("row").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("n") + depth - 1).alias("end"))).alias("_spans"))
    return table.join(spans, table._row == spans.row, "left").drop("row")


def removed_digest(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = 100) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 of every row; see ``repeats``."""
    rows = repeats(docs, key, text, depth).select("_did", "_null_key", "_body", "_spans")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, z, x, s in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                cut = spans_of(s)
                out.append((None if z else d, len(x), sum(e - a for a, e in cut), len(cut), hashlib.sha256(keep(x, cut)).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(frugal(run), f"`{key}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def keep(body: bytes, cut: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for s, e in cut:
        out.append(body[at:s])
        at = e
    out.append(body[at:])
    return b"".join(out)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = 100) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``; see ``repeats``.

    A character cut in part goes whole; null texts stay null, and all columns and rows stay.
    """
    from pyspark.sql import types as T

    names = docs.columns
    others = [c for c in names if c not in (key, text)]
    held = [f"c{i}" for i in range(len(others))]
    tagged = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), *[F.col(c).alias(h) for c, h in zip(others, held, strict=True)], F.col(text).isNull().alias("z"))
    rows = repeats(tagged, "k", "t", depth, (*held, "z"))
    rows = rows.select("_did", "_null_key", "_body", "_spans", *[f"_col_{i}" for i in range(len(others) + 1)])
    schema = T.StructType([docs.schema[c] for c in (key, text, *others)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, null, body, spans = (batch.column(i).to_pylist() for i in range(4))
            gone = batch.column(batch.num_columns - 1).to_pylist()
            new = [None if g else keep(x, spans_of(s)).decode("utf-8", "ignore") for g, x, s in zip(gone, body, spans, strict=True)]
            ids = pa.array([None if z else d for d, z in zip(did, null, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(new, pa.string()), *[batch.column(4 + i) for i in range(len(others))]], names=[key, text, *others])

    key_long = T.StructType([T.StructField(key, T.LongType())] + schema.fields[1:])
    return rows.mapInArrow(frugal(run), key_long).withColumn(key, F.col(key).cast(docs.schema[key].dataType)).select(*names)
