"""Packed token-id matrices: best fit decreasing with a segment tree over capacities.

Documents become token ids and a closing id; those longer than a row are split into whole rows and
a rest, so that no id is lost. Pieces are dealt by hash into blocks of about BLOCK_TOKENS tokens;
each block is packed on its own, longest piece first, into the row with the least room that still
fits. A segment tree over room sizes finds that row. A block gives rows of exactly `capacity` ids
with the cumulative lengths of their segments and position numbers that start anew in each.

Defined results: a null or empty text is a segment of the closing id alone; repeated rows are
packed one by one; a null doc_id stays null in the list of a row's documents; pieces of equal length
(ties) are packed by doc_id, piece and ids; a very long text is encoded whole and split; an empty
table gives an empty result; columns other than doc_id and text are ignored, whatever their names;
the ids after a row's last segment are the greatest number of their width and belong to no segment.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dominance_packing import CAPACITY, CLOSING, cuts
from .shared import shared_dir, slices, table, whole
from .token_ids import VOCABULARY, encoder

#: Tokens in a block, about, and bytes of text per token, at least: for the number of blocks.
BLOCK_TOKENS = 8_000_000
BYTES_PER_TOKEN = 2

#: Ids are 16 bits wide where the vocabulary leaves the greatest such number free for padding, else 32.
def width(vocabulary: str = VOCABULARY) -> str:
    return "<u2" if encoder(vocabulary).size < 1 << 16 else "<u4"


ROWS = "block long, row int, doc_ids array<long>, pieces array<int>, starts array<long>, cu_seqlens array<int>, n_tokens int, ids binary, positions binary"


class Rooms:
    """A segment tree over the sizes 0 to capacity: how many open rows have that much room."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = self.leaves + room
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (room, row) of a row with the least room of at least that much."""
        i = self.leaves + least
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):  # up until there is something to the right
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.leaves
        while i:
            self.count[i] -= 1
            i >>= 1
        return room, self.rows[room].pop()


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """The places in lengths (in decreasing order) that each row gets."""
    rooms, rows = Rooms(capacity), []
    for i, n in enumerate(lengths):
        found = rooms.take(n)
        if found:
            room, row = found
            rows[row].append(i)
        else:
            room, row = capacity, len(rows)
            rows.append([i])
        rooms.add(room - n, row)
    return rows


def token_pieces(docs: DataFrame, blocks: int, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(block, doc_id, piece, start, ids): ids as little-endian unsigned numbers of the width of the vocabulary.

    The block follows from doc_id, piece, content and the piece's place in its task, so pieces of
    one document spread, and so do repeated rows.
    """
    kind = width(vocabulary)
    kinds = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("ids", pa.binary())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, closing = encoder(vocabulary).encode, struct.pack("<I", CLOSING)
        for batch in slices(batches):
            out: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = np.frombuffer(encode(text) + closing, "<u4").astype(kind)
                out += ((doc_id, i, start, ids[start : start + n].tobytes()) for i, (start, n) in enumerate(cuts(len(ids), capacity)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, piece int, start long, ids binary")
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids", F.monotonically_increasing_id()), F.lit(blocks)).cast("long"))


def pack_block(frame: pd.DataFrame, capacity: int = CAPACITY, kind: str = "<u2") -> pd.DataFrame:
    size = np.dtype(kind).itemsize
    frame = frame.assign(n=frame["ids"].map(len) // size).sort_values(["n", "doc_id", "piece", "ids"], ascending=[False, True, True, True], kind="stable")
    n, ids, docs, pieces, starts = (frame[c].tolist() for c in ("n", "ids", "doc_id", "piece", "start"))
    out = []
    for row, places in enumerate(best_fit(n, capacity)):
        sizes = [n[i] for i in places]
        used = sum(sizes)
        packed = b"".join(ids[i] for i in places) + b"\xff" * (size * (capacity - used))
        positions = np.concatenate([np.arange(k, dtype="<u2") for k in (*sizes, capacity - used)])
        out.append((
            int(frame["block"].iloc[0]), row, [None if pd.isna(docs[i]) else int(docs[i]) for i in places], [pieces[i] for i in places], [starts[i] for i in places],
            [0, *np.cumsum(sizes).tolist()], used, packed, positions.tobytes(),
        ))
    return pd.DataFrame(out, columns=[x.split()[0] for x in ROWS.split(", ")])


def pack(docs: DataFrame, capacity: int = CAPACITY, block_tokens: int = BLOCK_TOKENS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The packed rows of docs (doc_id, text): ROWS."""
    size = docs.agg(F.sum(F.octet_length(whole("text")) + 1)).first()[0] or 0
    blocks = max(1, round(size / BYTES_PER_TOKEN / block_tokens))
    kind = width(vocabulary)
    return token_pieces(docs, blocks, capacity, vocabulary).groupBy("block").applyInPandas(lambda frame: pack_block(frame, capacity, kind), ROWS)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the rows as Parquet: ids is the row of the matrix, cu_seqlens and positions go with it."""
    packed.write.option("parquet.enable.dictionary", "false").parquet(path)  # no two rows are alike


def op2_packed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed and written; the matrices as checksums beside what describes them."""
    path = f"{shared_dir(spark)}/packed_{uuid.uuid4().hex}"
    write_packed(pack(table(spark, sf_dir, "documents")), path)
    return spark.read.schema(ROWS).parquet(path).select(
        "block", "row", "doc_ids", "pieces", "starts", "cu_seqlens", "n_tokens",
        F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"),
    )
