"""Blocks in `.npy` files, one file an item: a reader by row ranges and a writer.

Headers are read and written with numpy's public format functions; data are read range by range, so
no task needs a whole file, and no folder is listed.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .file_scan import opened, save

#: Bytes of a file that hold any header, and of a row range, about.
HEAD_BYTES = 4096
RANGE_BYTES = 16 << 20


def _shape(head: bytes, size: int, width: int) -> tuple[int, int, np.dtype] | None:
    """(rows, where they begin, their type) of a file's first bytes; None if it is not usable: not 2-D
    and in rows, not of whole numbers, of another width, without rows, or shorter than it says."""
    stream = io.BytesIO(head)
    try:
        version = npy.read_magic(stream)
        shape, fortran, kind = (npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0)(stream)
    except (ValueError, OSError):
        return None
    if len(shape) != 2 or fortran or kind.kind not in "iu" or shape[1] != width or shape[0] < 1:
        return None
    begin = stream.tell()
    return (int(shape[0]), begin, kind) if size >= begin + shape[0] * width * kind.itemsize else None


def npy_counts(sized: DataFrame, seq_len: int, path: str = "path") -> DataFrame:
    """sized (path, size, ...) with n_blocks, null for a miss: no file, or not one of rows of seq_len + 1
    whole numbers. Only headers are read; a broken file is a miss and fails nothing."""
    schema = T.StructType([*sized.schema, T.StructField("n_blocks", T.LongType())])

    def count(p: str | None, size: int | None) -> int | None:
        if p is None or size is None:
            return None
        try:
            system, own = opened(p)
            with system.open_input_file(own) as file:
                found = _shape(file.read(HEAD_BYTES), size, seq_len + 1)
        except OSError:
            return None
        return found and found[0]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [count(p, s) for p, s in zip(batch[path].to_pylist(), batch["size"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], [*batch.schema.names, "n_blocks"])

    return sized.mapInArrow(each, schema)


def _rows(path: str, size: int, width: int, begin: int, step: int) -> np.ndarray:
    """Up to step rows from begin on; nothing else of the file but its header is read."""
    system, own = opened(path)
    with system.open_input_file(own) as file:
        rows, start, kind = _shape(file.read(HEAD_BYTES), size, width)
        n = min(step, rows - begin)
        file.seek(start + begin * width * kind.itemsize)
        return np.frombuffer(file.read(n * width * kind.itemsize), kind).astype(np.int64).reshape(n, width)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))


def read_npy(counted: DataFrame, seq_len: int, path: str = "path", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A row per block of counted (path, size, n_blocks, ...; see npy_counts): its columns, block_idx
    and block. Misses have no rows. Ranges of rows are dealt out, so a long file is read by many tasks."""
    width = seq_len + 1
    step = max(1, range_bytes // (8 * width))
    begins = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1, F.lit(step).cast("long")))
    dealt = counted.where(F.col("n_blocks") > 0).withColumn("block_idx", begins).repartition(path, "block_idx")
    schema = T.StructType([*dealt.schema, T.StructField("block", T.ArrayType(T.LongType()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (p, size, begin) in enumerate(zip(batch[path].to_pylist(), batch["size"].to_pylist(), batch["block_idx"].to_pylist(), strict=True)):
                rows = _rows(p, size, width, begin, step)
                at = batch.schema.get_field_index("block_idx")
                columns = [batch.column(j).take(pa.array(np.full(len(rows), i))) for j in range(batch.num_columns)]
                columns[at] = pa.array(np.arange(begin, begin + len(rows)))
                yield pa.RecordBatch.from_arrays([*columns, _lists(rows)], [*batch.schema.names, "block"])

    return dealt.mapInArrow(each, schema)


def write_npy(blocks: DataFrame, seq_len: int, path: str = "path") -> tuple[int, int]:
    """Write blocks (path, block_idx, block) as a `.npy` file of 16-bit numbers per path; returns the
    numbers of files and rows. Folders are made.

    An item's blocks meet in one task, in order, and one item at a time is held. A file appears under
    its name when it is whole, so a task that is run again does no harm.
    """
    width = seq_len + 1
    dealt = blocks.select(path, "block_idx", F.col("block").cast("array<smallint>").alias("block")).repartition(path).sortWithinPartitions(path, "block_idx")

    def put(p: str, rows: list[np.ndarray], made: set[str]) -> None:
        out = io.BytesIO()
        npy.write_array(out, np.concatenate(rows).reshape(-1, width), version=(1, 0), allow_pickle=False)
        save(p, out.getvalue(), made)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, files, n, made = None, [], 0, 0, set()
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch[path].to_pylist()
            values = batch["block"].flatten().to_numpy().astype(np.int16)
            if len(values) != len(names) * width:
                raise ValueError(f"every block must have {width} numbers")
            bounds = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if names[lo] != held:
                    if rows:
                        put(held, rows, made)
                        files += 1
                    held, rows = names[lo], []
                rows.append(values[lo * width : hi * width])
            n += len(names)
        if rows:
            put(held, rows, made)
            files += 1
        yield pa.RecordBatch.from_arrays([pa.array([files]), pa.array([n])], ["files", "n"])

    done = dealt.mapInArrow(each, "files long, n long").agg(F.sum("files"), F.sum("n")).first()
    return done[0] or 0, done[1] or 0


class RowRange(InputPartition):
    def __init__(self, path: str, size: int, begin: int, step: int):
        self.path, self.size, self.begin, self.step = path, size, begin, step


class NpySource(DataSource):
    """spark.read.format("npy_blocks").option("seq_len", n).load(path): all `.npy` files below a folder,
    or one file, a row per block (path, block_idx, block), a partition per range of rows.

    What is no file of blocks of this width is a miss and has no rows. The driver lists the files and
    reads their headers; for very many, take npy_counts and read_npy, where tasks do. Register it by
    spark.dataSource.register(NpySource). Option range_bytes: bytes of a range, about.
    """

    @classmethod
    def name(cls) -> str:
        return "npy_blocks"

    def schema(self) -> str:
        return "path string, block_idx long, block array<bigint>"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return NpyReader(self.options)


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.width = options["path"], int(options["seq_len"]) + 1
        self.step = max(1, int(options.get("range_bytes", RANGE_BYTES)) // (8 * self.width))

    def partitions(self) -> list[RowRange]:
        system, own = opened(self.path)
        top = system.get_file_info(own)
        infos = system.get_file_info(fs.FileSelector(own, recursive=True)) if top.type == fs.FileType.Directory else [top]
        files = sorted((x.path, x.size) for x in infos if x.type == fs.FileType.File and x.path.endswith(".npy"))
        out = []
        for path, size in files:
            named = path if "://" not in self.path else self.path[: len(self.path) - len(own)] + path
            with system.open_input_file(path) as file:
                found = _shape(file.read(HEAD_BYTES), size, self.width)
            out += [RowRange(named, size, begin, self.step) for begin in range(0, found[0] if found else 0, self.step)]
        return out

    def read(self, partition: RowRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # of no ranges, Spark reads none as one
            return
        rows = _rows(partition.path, partition.size, self.width, partition.begin, self.step)
        at = np.arange(partition.begin, partition.begin + len(rows))
        yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(rows), pa.string()), pa.array(at), _lists(rows)], ["path", "block_idx", "block"])
