"""UDFs over pandas series that are made when first called, so that modules import without a session."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from strataquill.shipping import ship

#: Bytes of all arguments together that a function gets at once, but for single rows that are longer.
SLICE = 1 << 20


def _held(column: pa.Array) -> np.ndarray:
    """About how many bytes each row holds."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        sizes = pc.binary_length(column)
    elif pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        sizes = pc.multiply(pc.list_value_length(column), 8)
    else:
        return np.full(len(column), 8, np.int64)
    return sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 8


def cuts(columns: tuple[pa.Array, ...]) -> Iterator[tuple[int, int]]:
    """(start, length) of slices of a batch."""
    ends = np.cumsum(sum(_held(c) for c in columns))
    at = before = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
        yield at, end - at
        at, before = end, ends[end - 1]


def _series(column: pa.Array) -> pd.Series:
    flat = pa.types.is_primitive(column.type) or pa.types.is_list(column.type) or pa.types.is_large_list(column.type)
    return column.to_pandas() if flat else pd.Series(column.to_pylist(), dtype=object)


def _array(found: pd.Series | pd.DataFrame, kind: pa.DataType) -> pa.Array:
    if isinstance(found, pd.DataFrame):
        return pa.StructArray.from_arrays([_array(found[f.name], f.type) for f in kind], fields=list(kind))
    out = pa.array(found, type=kind, from_pandas=True)
    return pa.concat_arrays(out.chunks) if isinstance(out, pa.ChunkedArray) else out


def in_slices(f: Callable, kind: pa.DataType) -> Callable[[Iterator], Iterator[pa.Array]]:
    """``f`` on slices of Arrow batches: objects and results of one slice are held, not those of a batch of up to 10,000 rows."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)  # of one column, Spark gives the array
            for at, n in cuts(columns):
                yield _array(f(*(_series(c.slice(at, n)) for c in columns)), kind)
            del batch, columns

    return run


def vectorised(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    def wrap(f: Callable) -> Callable[..., Column]:
        def call(*columns: Column) -> Column:
            ship(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate())
            of = DataType.fromDDL(kind)
            return arrow_udf(in_slices(f, to_arrow_type(of)), of)(*columns)

        call.__doc__, call.__name__, call.plain = f.__doc__, f.__name__, f
        return call

    return wrap
