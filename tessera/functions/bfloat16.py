"""Floats narrowed to bfloat16: the nearest number of 8 significant bits, ties to even."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def round_bits(values: np.ndarray) -> np.ndarray:
    """The upper 16 bits of 32-bit floats, rounded to the nearest, ties to even. What is too large
    becomes infinite; any NaN becomes the quiet one."""
    raw = values.astype(np.float32).view(np.uint32)
    up = ((raw >> np.uint32(16)) & np.uint32(1)) + np.uint32(0x7FFF)
    bits = ((raw + up) >> np.uint32(16)).astype(np.uint16)
    return np.where(np.isnan(values), np.uint16(0x7FC0), bits)


def _leaf(array: pa.Array, as_bits: bool) -> pa.Array:
    missing = array.is_null().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        bits = round_bits(array.fill_null(0).to_numpy(zero_copy_only=False))
    if as_bits:
        return pa.array(bits.view(np.int16), mask=missing)
    return pa.array((bits.astype(np.uint32) << np.uint32(16)).view(np.float32), mask=missing)


def _narrow(array: pa.Array, as_bits: bool) -> pa.Array:
    kind = array.type
    if pa.types.is_floating(kind):
        return _leaf(array, as_bits)
    if pa.types.is_map(kind):
        return pa.MapArray.from_arrays(array.offsets, _narrow(array.keys, as_bits), _narrow(array.items, as_bits), mask=array.is_null() if array.null_count else None)
    if pa.types.is_list(kind):
        return pa.ListArray.from_arrays(array.offsets, _narrow(array.values, as_bits), mask=array.is_null() if array.null_count else None)
    if pa.types.is_struct(kind):
        parts = [_narrow(array.field(i), as_bits) for i in range(kind.num_fields)]
        fields = [pa.field(kind.field(i).name, p.type) for i, p in enumerate(parts)]
        return pa.StructArray.from_arrays(parts, fields=fields, mask=array.is_null())
    return array


def _kind(kind: T.DataType, to: T.DataType) -> T.DataType:
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return to
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_kind(kind.elementType, to), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(_kind(kind.keyType, to), _kind(kind.valueType, to), kind.valueContainsNull)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _kind(f.dataType, to), f.nullable) for f in kind])
    return kind


def narrow_bfloat16(df: DataFrame, keep: list[str] | None = None, as_bits: bool = False) -> DataFrame:
    """The columns of keep (all, if not given) that there are, every float or double in them narrowed,
    however deep in arrays, structs and maps. Doubles are made 32-bit floats first.

    The result's numbers are floats that bfloat16 holds exactly, or, as_bits, its 16 bits as smallint,
    a quarter of a double's size. Nulls and whole numbers stay. Batches are narrowed with numpy.
    """
    kept = df.select(*(c for c in df.columns if keep is None or c in keep))
    schema = _kind(kept.schema, T.ShortType() if as_bits else T.FloatType())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_narrow(c, as_bits) for c in batch.columns], batch.schema.names)

    return kept.mapInArrow(each, schema)
