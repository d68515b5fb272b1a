"""Where outside code plugs in: codecs, generators and renderers, each run by Spark on batches.

Protocols, the functions that apply them to DataFrames, and toy versions for tests. The bodies of
real codecs and models are not part of this engine.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow_batches import released, slices


class Codec(Protocol):
    """Source bytes to program ids, and whether ids decode to a program."""

    def encode(self, content: bytes, subtune: int, frames: int) -> list[int]: ...

    def decodes(self, ids: list[int]) -> bool: ...


class Generator(Protocol):
    """A prompt to its continuation of n ids."""

    def generate(self, prompt: list[int], n: int) -> list[int]: ...


class Renderer(Protocol):
    """Program ids to register vectors, one a frame."""

    def render(self, ids: list[int]) -> list[list[int]]: ...


def recover(entries: DataFrame, codec: Codec) -> DataFrame:
    """entries (content, subtune, frames, ...) with ids, model ids from 1 on, and error in place of
    content: an entry that the codec refuses is skipped with its reason and does not fail the job. An
    entry without content is not tried and has neither. A worker holds the content and ids of a slice, not
    of a batch, as objects."""
    rest = [f for f in entries.schema if f.name != "content"]
    schema = T.StructType([*rest, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("error", T.StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "content"):
            ids, errors = [], []
            for content, subtune, n in zip(*(part[c].to_pylist() for c in ("content", "subtune", "frames")), strict=True):
                if content is None:
                    ids.append(None)
                    errors.append(None)
                    continue
                try:
                    ids.append([i + 1 for i in codec.encode(content, int(subtune), int(n))])
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  any refusal is a skip
                    ids.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            columns = [*(part[f.name] for f in rest), pa.array(ids, pa.list_(pa.int32())), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return entries.mapInArrow(released(each), schema)


def decodes(codec: Codec, ids: Column) -> Column:
    """Whether ids decode to a program; any exception is a no."""

    @F.pandas_udf("boolean")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(x) -> bool:
            try:
                return bool(codec.decodes(list(x)))
            except Exception:  # noqa: BLE001
                return False

        for s in batches:
            yield s.map(one)

    return each(ids)


def generate(generator: Generator, prompt: Column, n: int) -> Column:
    """The continuation of prompt; the model is loaded once per worker, by unpickling generator."""

    @F.pandas_udf("array<bigint>")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: generator.generate(list(x), n))

    return each(prompt)


def render(programs: DataFrame, renderer: Renderer, *keys: str) -> DataFrame:
    """(keys, frame, reg, val) of programs (keys, ids)."""
    rest = [f for f in programs.schema if f.name in keys]
    schema = T.StructType([*rest, *(T.StructField(n, T.LongType()) for n in ("frame", "reg", "val"))])

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                own = {k: getattr(row, k) for k in keys}
                cells = [(f, r, v) for f, vector in enumerate(renderer.render(list(row.ids))) for r, v in enumerate(vector)]
                yield pd.DataFrame(cells, columns=["frame", "reg", "val"]).assign(**own)[[*keys, "frame", "reg", "val"]]

    return programs.mapInPandas(each, schema)


class ToyCodec:
    """Bytes to ids below vocab; refuses empty sources. A stand-in, no real format."""

    def __init__(self, vocab: int):
        self.vocab = vocab

    def encode(self, content: bytes, subtune: int, frames: int) -> list[int]:
        if not content:
            raise ValueError("empty source")
        return [b % self.vocab for b in content[:frames]]

    def decodes(self, ids: list[int]) -> bool:
        if any(i < 0 or i >= self.vocab for i in ids):
            raise ValueError("id out of range")
        return len(ids) > 0


class ToyGenerator:
    """Continues with the prompt's last id counted up. A stand-in, no model."""

    def generate(self, prompt: list[int], n: int) -> list[int]:
        last = int(prompt[-1]) if prompt else 0
        return [last + 1 + i for i in range(n)]
