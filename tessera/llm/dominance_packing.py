"""Packing documents into as few sequences as possible: dominance reduction, then best fit.

Only the lengths matter to a plan, and there are at most `capacity` of them, so the plan is made
on counts per length, of bounded size however many documents there are. Sets that provably
dominate all others are fixed first (Martello and Toth): an item that nothing fits beside; a pair
that fills a sequence exactly; an item with the largest partner that fits, where no two others
fit together beside it. The instance shrinks, and best fit in decreasing order packs the rest.
Spark then numbers the pieces of each length and looks their places up in the plan.

Defined results: a null or empty text is one piece, the closing id alone; only documents longer
than the capacity are cut, and their first piece takes the odd length; repeated rows are packed
one by one; a null doc_id stays null; pieces of equal length (ties) are placed by salt, doc_id, piece and
checksum; a very long text is encoded whole and cut; an empty table gives an empty result; columns
other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, slices, table
from .token_ids import VOCABULARY, encoder

#: Tokens in a sequence, and the id that closes every document.
CAPACITY = 2048
CLOSING = 0
#: Groups that the pieces of one length are numbered in.
SALTS = 256


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; the first may be shorter."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt[, ids]) of docs (doc_id, text); salt counts a task's pieces round."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int" + ", ids binary" * with_ids
    types = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("salt", pa.int32())] + [("ids", pa.binary())] * with_ids)

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, closing, n = encoder(vocabulary).encode, struct.pack("<I", CLOSING), 0
        for batch in slices(batches):
            out: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                raw = encode(text) + closing
                for i, (start, length) in enumerate(cuts(len(raw) // 4, capacity)):
                    part = raw[4 * start : 4 * (start + length)]
                    out.append((doc_id, i, start, length, zlib.crc32(part), n % SALTS, part)[: len(types)])
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t.type) for t in types], schema=types)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tokenize, schema)


def reduce_by_dominance(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets, taking their items from left (count per length), until none is found.

    Returns (lengths in a sequence, number of such sequences).
    """
    fixed: list[tuple[tuple[int, ...], int]] = []

    def fix(lengths: tuple[int, ...], n: int) -> None:
        fixed.append((lengths, n))
        for w in lengths:
            left[w] -= n
            if not left[w]:
                del left[w]

    again = True
    while again:
        again = False
        for w in sorted(left, reverse=True):
            while left.get(w):
                n, room = left[w], capacity - w
                small = [s for s in sorted(left) for _ in range(min(3, left[s] - (s == w)))][:2] if left else []
                if not small or small[0] > room:
                    fix((w,), n)  # nothing fits beside it
                elif left.get(room) and (room != w or n > 1):
                    fix((w, room), n // 2 if room == w else min(n, left[room]))  # an exact pair
                elif len(small) < 2 or sum(small) > room:
                    k = max(s for s in left if s <= room and (s != w or n > 1))
                    fix((w, k), n // 2 if k == w else min(n, left[k]))  # one more fits, so the largest
                else:
                    break
                again = True
    return fixed


def best_fit_decreasing(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit of counts per length, equal sequences as one; the result is that of item by item."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms: list[int] = []  # those of open_, ascending

    def put(room: int, lengths: tuple[int, ...], n: int) -> None:
        if not open_[room]:
            rooms.insert(bisect_left(rooms, room), room)
        open_[room].append((lengths, n))

    for w in sorted(left, reverse=True):
        n = left[w]
        while n:
            i = bisect_left(rooms, w)
            if i < len(rooms):
                room = rooms[i]
                lengths, bins = open_[room].pop()
                if not open_[room]:
                    rooms.pop(i)
            else:
                room, lengths, bins = capacity, (), n  # new ones, as many as may be needed
            # the fullest sequence that takes w takes it again and again before another does
            each = room // w
            whole = min(bins, n // each)
            if whole:
                put(room - each * w, lengths + (w,) * each, whole)
            n, bins = n - whole * each, bins - whole
            if n and bins and n < each:
                put(room - n * w, lengths + (w,) * n, 1)
                n, bins = 0, bins - 1
            if bins and lengths:
                put(room, lengths, bins)
    return [x for found in open_.values() for x in found]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, number, first sequence, offset), sorted: pieces of a length with
    ranks from the first on lie in as many sequences, one in each."""
    left = {w: n for w, n in counts.items() if n}
    classes = reduce_by_dominance(left, capacity)
    classes += best_fit_decreasing(left, capacity)
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, n in classes:
        offset = 0
        for w in lengths:
            rows.append((w, rank[w], n, sequence, offset))
            rank[w] += n
            offset += w
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def ranked(rows: DataFrame) -> DataFrame:
    """rows (salt, length, ...; written already) with rank: 0, 1, ... among those of the same length.

    A length with a third of all rows is split by the salts, which don't depend on what the rows
    hold, so that repeated rows spread as well; salts count on from one to the next.
    """
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return rows.withColumn("i", F.row_number().over(within)).join(firsts, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("i") - 1).drop("salt", "first", "i")


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (doc_id, piece, start, length, ids_crc32, salt; written already) with sequence_id and offset.

    To the driver go at most `capacity` counts; the plan's size is bounded by them, too.
    """
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    made = plan(counts, capacity)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((n, pa.int64()) for n in (*names[2:], "sequence_id", "offset"))])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = np.searchsorted(made[:, 0], np.arange(capacity + 2))
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = np.empty(len(length), np.int64)
            for w in np.unique(length):
                own = length == w
                lo, hi = begins[w], begins[w + 1]
                at[own] = lo + np.searchsorted(made[lo:hi, 1], rank[own], "right") - 1
            found = made[at]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])], schema=out)

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked(rows).select(*names, "rank").mapInArrow(look_up, kinds)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most CAPACITY tokens."""
    return pack(cut(pieces(table(spark, sf_dir, "documents"))))
