"""Line dedup: lines that many documents share are cut out of every document.

Every line becomes a narrow row of its key's 128-bit hash, its document's 128-bit name and its position; texts don't
travel.  Rows are range-partitioned by hash, document and position, so a line with a third of all rows is dealt over as
many partitions as its rows need, and sorted in that order.  A task streams its rows once and passes on the first
occurrence of every (line, document, position) of lines it finds in enough documents; it holds the rows of fewer than
``least_docs`` documents at any time.  A line whose rows may go on in the next partition, and which isn't in enough
documents here, leaves those few rows undecided; they are settled by one small grouping.  What comes out for each
document that loses lines is a compressed bitmap of the lines to keep.

A document is told by its key and text: rows that repeat both are one document, listed more than once, and lose the same
lines; other texts under one key are documents of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, frugal, parted, salted_partitions, ship, stored
from .exact_dedup import ascii_lower

#: Stripped at both ends of a line before it is compared.
BLANK = " \t\n\x0b\x0c\r"
NAME = ["d1", "d2"]
LINE = ["h1", "h2"]
DROPPED, OPEN, MARK = 0, 1, 2
_ROW = pa.schema([(c, pa.int64()) for c in (*LINE, *NAME)] + [("pos", pa.int32()), ("n_lines", pa.int32()), ("state", pa.int32())])
_BITMAP = pa.schema([(c, pa.int64()) for c in (*NAME, "n_lines", "n_dropped")] + [("bitmap", pa.binary())])


def lines_of(text: Column) -> Column:
    """A text's lines; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """What is compared of a line: without blanks at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def names(key: str, text: str) -> list[Column]:
    """A document's 128-bit name, of its key and text."""
    given = [F.col(key).isNull(), F.col(key), F.coalesce(F.col(text), F.lit(""))]
    return [F.xxhash64(*given).alias("d1"), F.xxhash64(F.lit(1), *given).alias("d2")]


def line_rows(docs: DataFrame, key: str, text: str, least_chars: int) -> DataFrame:
    """h1, h2, d1, d2, pos, n_lines, salt of every line whose key has at least ``least_chars`` code points.

    The salt, the partition a row is read in, parts rows that repeat one document.
    """
    rows = docs.select(*names(key, text), lines_of(F.col(text)).alias("lines")).select(*NAME, F.size("lines").alias("n_lines"), F.transform("lines", line_key).alias("keys"))
    rows = rows.select(*NAME, "n_lines", F.posexplode("keys").alias("pos", "k")).where(F.char_length("k") >= least_chars)
    return rows.select(F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2"), *NAME, "pos", "n_lines", F.spark_partition_id().alias("salt"))


def shared_lines(least_docs: int):
    """A task over rows in the order of line, document and position: those of lines in at least ``least_docs`` documents.

    Rows leave as DROPPED.  Lines at the edges of the partition, which may go on elsewhere, leave their rows as OPEN if
    there are too few documents here, and else a MARK.
    """

    def out(c: dict[str, np.ndarray], state: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c[f.name] if f.name in c else np.full(len(c["h1"]), state), f.type) for f in _ROW], schema=_ROW)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [f.name for f in _ROW if f.name != "state"]
        held: dict[str, np.ndarray] = {}
        first = None  # the partition's first line, which may have begun in another
        decided = None  # the line the last rows belonged to, if it is in enough documents already
        last = None  # the last row that left, for telling repeats

        def line_at(c, i):
            return int(c["h1"][i]), int(c["h2"][i])

        for batch in batches:
            if not batch.num_rows:
                continue
            c = {n: batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in fields}
            if held and len(held["h1"]):
                c = {n: np.concatenate([held[n], c[n]]) for n in fields}
            if first is None:
                first = line_at(c, 0)
            new_line = np.ones(len(c["h1"]), dtype=bool)
            new_line[1:] = (c["h1"][1:] != c["h1"][:-1]) | (c["h2"][1:] != c["h2"][:-1])
            new_doc = new_line.copy()
            new_doc[1:] |= (c["d1"][1:] != c["d1"][:-1]) | (c["d2"][1:] != c["d2"][:-1])
            fresh = new_doc.copy()
            fresh[1:] |= c["pos"][1:] != c["pos"][:-1]
            if last is not None and last == tuple(int(c[n][0]) for n in (*LINE, *NAME, "pos")):
                fresh[0] = False
            starts = np.flatnonzero(new_line)
            enough = np.add.reduceat(new_doc.astype(np.int64), starts) >= least_docs
            if decided == line_at(c, 0):
                enough[0] = True
            of = np.cumsum(new_line) - 1
            drop = enough[of] & fresh
            if drop.any():
                yield out({n: v[drop] for n, v in c.items()}, DROPPED)
            edge = {n: v[:1] for n, v in c.items()}
            if line_at(c, 0) == first and enough[0] and decided != first:
                yield out(edge, MARK)
            if line_at(c, 0) == first and not enough[0] and len(starts) > 1:
                rows = (of == 0) & fresh
                yield out({n: v[rows] for n, v in c.items()}, OPEN)
            if enough[-1]:
                decided, last = line_at(c, -1), tuple(int(c[n][-1]) for n in (*LINE, *NAME, "pos"))
                held = {n: v[:0] for n, v in c.items()}
            else:
                decided = last = None
                rows = (of == len(starts) - 1) & fresh
                held = {n: v[rows] for n, v in c.items()}
            end = {n: v[-1:] for n, v in c.items()}
        if first is None:
            return
        yield out(end, MARK) if decided else out(held, OPEN)

    return run


def _bitmaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[] for _ in _BITMAP]
        for r in batch.to_pylist():
            keep = np.ones(r["n_lines"], dtype=bool)
            keep[r["places"]] = False
            for column, v in zip(rows, (r["d1"], r["d2"], r["n_lines"], len(r["places"]), zlib.compress(np.packbits(keep).tobytes())), strict=True):
                column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, _BITMAP, strict=True)], schema=_BITMAP)


def keep_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """d1, d2 (``names``), n_lines, n_dropped, bitmap of each document that loses lines.

    Lines lose their place in every document if their key (``line_key``) has at least ``least_chars`` code points and is
    found in at least ``least_docs`` documents.  A bitmap has a bit for each line, set if it stays, packed eight to a byte
    from the highest bit, compressed by zlib.  Null and empty texts have one empty line.  Repeated rows count as one
    document; a null key is a key like any other.  Columns other than the two named play no part.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = stored(line_rows(docs, key, text, least_chars), "lines")
    order = [*LINE, *NAME, "pos", "salt"]
    dealt = rows.repartitionByRange(salted_partitions(spark), *order).sortWithinPartitions(*order).drop("salt")
    seen = stored(dealt.mapInArrow(frugal(shared_lines(least_docs)), "h1 long, h2 long, d1 long, d2 long, pos int, n_lines int, state int"), "shared-lines")
    discard(rows)
    # at most the rows of 2 (least_docs - 1) documents and two marks from each partition
    edges = seen.where(F.col("state") != DROPPED)
    lines = edges.groupBy(*LINE).agg(F.max("state").alias("s"), F.countDistinct(F.struct(*NAME)).alias("n")).where((F.col("s") == MARK) | (F.col("n") >= least_docs))
    settled = edges.where(F.col("state") == OPEN).join(lines.select(*LINE), LINE, "left_semi")
    dropped = seen.where(F.col("state") == DROPPED).unionByName(settled)
    places = dropped.groupBy(*NAME).agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("places"))
    out = stored(places.mapInArrow(frugal(_bitmaps), "d1 long, d2 long, n_lines long, n_dropped long, bitmap binary"), "keep-bitmaps")
    discard(seen)
    return out


def kept_lines(text: str, bitmap: bytes) -> str:
    lines = text.split("\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), count=len(lines)).tolist()
    return "\n".join([x for x, k in zip(lines, keep, strict=True) if k])


def without_lines(docs: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with what their ``keep_bitmaps`` leave of their texts, and n_lines, n_dropped (which replace columns of these names).

    A text all lines of which go is left empty.  Texts of documents without a bitmap stay as they are, null too, and most
    of them aren't shuffled: a filter of the bitmaps' names tells them.
    """
    ship(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), *names(key, text))
    untouched, hit = parted(named, NAME, bitmaps)

    @F.pandas_udf("string")
    def cut(texts, maps):
        import pandas as pd

        return pd.Series([t if m is None else kept_lines(t, bytes(m)) for t, m in zip(texts, maps, strict=True)], dtype=object)

    def finished(rows: DataFrame, body: Column, n_lines: Column, n_dropped: Column) -> DataFrame:
        return rows.select(*[body.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in others], n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))

    body = F.col(f"row.`{text}`")
    n = F.size(lines_of(body)).cast("long")
    joined = hit.join(bitmaps.select(*NAME, "n_dropped", "bitmap"), NAME, "left")
    left = finished(joined, F.when(F.col("bitmap").isNull(), body).otherwise(cut(F.coalesce(body, F.lit("")), F.col("bitmap"))), n, F.coalesce("n_dropped", F.lit(0)).cast("long"))
    return finished(untouched, body, n, F.lit(0).cast("long")).unionByName(left)


def deduplicated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """``docs`` without the lines that at least ``least_docs`` documents share (``keep_bitmaps``, ``without_lines``)."""
    return without_lines(docs, keep_bitmaps(docs, key, text, least_docs, least_chars), key, text)
