"""Runs numpy functions over whole cells, many cells at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shipping import ship

Columns = dict[str, np.ndarray]
_TARGET = 200_000


def _numpy(table: pa.Table) -> Columns:
    return {n: table[n].combine_chunks().to_numpy(zero_copy_only=False) if table[n].num_chunks else np.array([]) for n in table.column_names}


def by_cell(df: DataFrame, order: list[str], fn: Callable[[Columns], dict], schema: str | T.StructType, cell: str = "cell_id") -> DataFrame:
    """Apply ``fn`` to runs of complete cells, sorted by cell and ``order``.

    One exchange by cell; a task holds about ``_TARGET`` rows at a time, or one cell if that is larger, so the cost of a
    call is shared by many small cells.  The exchange is by the cell's hash, not by the column: that of a column which
    rows are already dealt out by is left out, and as nothing that Spark knows of needs it here, partitions are then
    coalesced on each side of a union for itself, or split, so a cell's rows end up in different tasks.
    """
    ship(df.sparkSession)
    rows = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(cell)).sortWithinPartitions(cell, *order)
    schema = rows.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    kinds = pa.schema([(f.name, _arrow(f.dataType)) for f in schema])

    def apply(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        out = fn(_numpy(pa.concat_tables(tables)))
        arrays = [pa.array(out[f.name], f.type, from_pandas=True) for f in kinds]
        if len(arrays[0]):
            yield pa.RecordBatch.from_arrays(arrays, schema=kinds)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if size >= _TARGET:
                ids = batch.column(batch.schema.get_field_index(cell)).to_numpy(zero_copy_only=False)
                last = held[-1][cell][-1].as_py()
                new = np.flatnonzero(ids != last)
                if len(new):
                    cut = int(new[0])
                    if cut:
                        held.append(table.slice(0, cut))
                    yield from apply(held)
                    held, size, table = [], 0, table.slice(cut)
            held.append(table)
            size += table.num_rows
        if held:
            yield from apply(held)

    return rows.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.StringType: pa.string(), T.BooleanType: pa.bool_()}[type(kind)]


def cells_of(c: Columns, cell: str = "cell_id") -> list[tuple[int, int]]:
    """Where each cell's rows begin and end."""
    ids = c[cell]
    cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else [0]
    return list(zip(cuts, cuts[1:], strict=False))
