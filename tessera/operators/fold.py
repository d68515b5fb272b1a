"""A fold over the rows of each key, in order: for what depends on all rows before and is no window."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], start: Callable, step: Callable, reads: list[str], out: str) -> DataFrame:
    """rows with the columns of out (as DDL): state = start() at a key's first row; then for each row, in
    order, (state, values of out) = step(state, *values of reads).

    Rows are dealt by keys and sorted, and pass one at a time: a task holds a batch and a state,
    however many rows a key has. Keys are independent; within one, a fold has no more to share out.
    Without keys, all rows are one sequence. A key may be null, and rows of equal order follow in any
    order. A task that is lost is folded anew.
    """
    dealt = rows.repartition(*keys) if keys else rows.repartition(1)
    added = T.StructType.fromDDL(out)
    schema = T.StructType([*rows.schema.fields, *added.fields])
    arrow = to_arrow_schema(added)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            made = []
            own = batch.select(keys).to_pylist() if keys else [{}] * batch.num_rows
            for k, values in zip(own, zip(*(batch[c].to_pylist() for c in reads), strict=True), strict=True):
                if key is None or k != key:
                    key, state = k, start()
                state, value = step(state, *values)
                made.append(value)
            columns = [pa.array([m[i] for m in made], f.type) for i, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *arrow.names])

    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(each, schema)
