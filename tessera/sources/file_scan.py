"""Reading the files that a manifest names, and no others."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow_batches import released, slices
from ..operators.block_index import running

#: Bytes that a task reads, about, and at a time where content isn't asked for.
TASK_BYTES = 64 << 20
CHUNK = 1 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def write_files(files: DataFrame, path: str = "path", content: str = "content") -> int:
    """Write each row's content (binary) to its path, and return how many. Folders are made; a file appears
    under its name when it is whole, so a task that is run again does no harm."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: set[str] = set()
        for part in slices(batches, content):
            for p, whole in zip(part[path].to_pylist(), part[content].to_pylist(), strict=True):
                save(p, whole, made)
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int64())], ["n"])

    return files.select(path, content).mapInArrow(released(each), "n long").agg(F.sum("n")).first()[0] or 0


def save(path: str, content: bytes, made: set[str]) -> None:
    """Write a file; made has the folders that the caller has made so far."""
    system, own = opened(path)
    folder = path.rpartition("/")[0]
    if folder not in made:
        system.create_dir(own.rpartition("/")[0], recursive=True)
        made.add(folder)
    part = f"{own}.{uuid4().hex}"
    with system.open_output_stream(part) as stream:
        stream.write(content)
    system.move(part, own)


def file_sizes(entries: DataFrame, path: str = "path") -> DataFrame:
    """entries with size, null where there is no such file. Files are asked for, not opened, and no folder is listed."""
    schema = T.StructType([*entries.schema, T.StructField("size", T.LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for p in batch[path].to_pylist():
                info = None
                if p is not None:
                    system, own = opened(p)
                    info = system.get_file_info(own)
                sizes.append(info.size if info is not None and info.type == fs.FileType.File else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], [*batch.schema.names, "size"])

    return entries.mapInArrow(each, schema)


def scan_files(sized: DataFrame, order: list[str], path: str = "path", with_content: bool = True, task_bytes: int = TASK_BYTES) -> DataFrame:
    """sized (path, size, ...; see file_sizes) with content_md5, content (if asked for) and missing: hash
    and bytes are of one read.

    Only the named files are opened, each task about task_bytes of them; what is dealt is names and
    sizes, never content. missing is null, `no file` or `unreadable: ...`, and such entries have
    neither hash nor content; a null path is no file. A file that is named twice is read twice. Paths
    are those of any store that pyarrow opens (local and shared folders, hdfs, s3, gs); they must be
    seen by all executors. order makes the dealing the same in every run; sized is read three times to
    deal, so it should be a table.
    """
    priced = sized.withColumn("_cost", F.coalesce("size", F.lit(0)) + CHUNK)  # opening costs, too
    # cells of a hash, as it doesn't matter which files share a task, only that tasks get alike
    dealt = running(priced, F.pmod(F.xxhash64(path), F.lit(4096)), order, "_cost", "_cum").withColumn("_task", F.floor(F.col("_cum") / task_bytes))
    total = priced.agg(F.sum("_cost")).first()[0] or 0
    dealt = dealt.repartition(1 + total // task_bytes, "_task").drop("_cost", "_cum", "_task")
    content = [T.StructField("content", T.BinaryType())] if with_content else []
    schema = T.StructType([*dealt.schema, T.StructField("content_md5", T.StringType()), *content, T.StructField("missing", T.StringType())])
    names = [f.name for f in schema]
    kinds = [pa.string(), *([pa.binary()] if with_content else []), pa.string()]

    def read(p: str) -> tuple[str, bytes | None]:
        system, own = opened(p)
        with system.open_input_stream(own) as stream:
            if with_content:
                whole = stream.readall()
                return md5(whole).hexdigest(), whole
            found = md5()
            while part := stream.read(CHUNK):
                found.update(part)
            return found.hexdigest(), None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, held, found = 0, 0, []
            for i, (p, size) in enumerate(zip(batch[path].to_pylist(), batch["size"].to_pylist(), strict=True)):
                digest = whole = None
                missing = "no file" if size is None else None
                if size is not None:
                    try:
                        digest, whole = read(p)
                    except OSError as e:
                        missing = f"unreadable: {type(e).__name__}"
                found.append((digest, whole, missing) if with_content else (digest, missing))
                held += len(whole or b"")
                # files go on together, but of content no more is held than CHUNK and a file
                if held >= CHUNK or i + 1 == batch.num_rows:
                    more = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*batch.slice(begin, len(found)).columns, *more], names)
                    begin, held, found = i + 1, 0, []

    return dealt.mapInArrow(released(each), schema)
