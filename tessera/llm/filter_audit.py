"""How filters of documents interact: what each removes alone, after others, and in every order.

A document fails each filter or not, whatever comes first; so the documents of a part (a source) are
counted once per part and mask of failed filters, and all orders are worked out from these counts.
They are additive: counts of several tables, or of later batches of other texts, are summed.

The filter for duplicates sorts: documents are dealt by ranges of (fingerprint, doc_id), each range
is sorted by fingerprint, full text and doc_id, and a row is compared with its predecessor. A run of
equal texts that begins in an earlier range is known by that range's last fingerprint, of which there
is one a range. doc_id is part of the range, so a text of a third of all rows lies in many ranges.

Defined results:
- A null text counts as empty; null and empty texts are duplicates of one another.
- A document is a duplicate if an equal text has a smaller doc_id, wherever it is and whatever
  happens to it; a null doc_id is above all others, and rows that share a doc_id aren't smaller.
- A null source is the part of the empty string. Every part has a row per order and step.
- A document with several labels counts as good, or as toxic, if any of them says so; a null says
  nothing. Labels without documents don't count. Repeated rows count each.
- A very long text is measured whole within its row, and only it is held beside a batch.
- An empty table has no parts, and gives an empty result. Columns other than doc_id, text and
  source are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, partitions, split_words, table, whole

#: The letter of the filter for duplicates.
COPY = "E"
DEALT = "doc_id long, part string, mask int, edge binary, range int"


def failures(text: Column, words: Column) -> dict[str, Column]:
    """The letter of each filter that looks at one document, and whether the document fails it."""
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": F.regexp_like(text, F.lit("[#$%&*|]")),
    }


def _follows(batches: Iterator[pa.RecordBatch], bit: int) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order: adds bit to the mask of those whose text equals the predecessor's
    and that are not of the run's first doc_id. edge is set in the rows of the range's first
    fingerprint, and in one more row at the end, without a mask, of its last fingerprint."""
    at = TaskContext.get().partitionId()
    names, kinds = ["doc_id", "part", "mask", "edge", "range"], [pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int32()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    first = last = None  # the range's first fingerprint; the last row's fingerprint, text and its run's first doc_id
    for batch in batches:
        if not batch.num_rows:
            continue
        prints, texts, ids = (pa.concat_arrays([batch[c]]) for c in ("print", "text", "doc_id"))
        first = first or prints[0].as_py()
        n = batch.num_rows
        same = pc.and_(pc.equal(prints[1:], prints[: n - 1]), pc.equal(texts[1:], texts[: n - 1])).to_pylist()
        same.insert(0, bool(last) and last[0] == prints[0].as_py() and last[1] == texts[0].as_py())
        head = last[2] if last else None
        copy = []
        for equal, own in zip(same, ids.to_pylist(), strict=True):
            if not equal:
                head = own
            copy.append(bit if equal and own != head else 0)
        last = (prints[n - 1].as_py(), texts[n - 1].as_py(), head)
        edge = pc.if_else(pc.equal(prints, pa.scalar(first, pa.binary())), prints, pa.scalar(None, pa.binary()))
        mask = pc.add(batch["mask"], pa.array(copy, pa.int32()))
        yield pa.RecordBatch.from_arrays([ids, batch["part"], mask, edge, pa.array([at] * n, pa.int32())], schema=schema)
    if last:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([None, None, None, last[0], at], kinds, strict=True)], schema=schema)


def masks(docs: DataFrame, source: str = "source") -> DataFrame:
    """doc_id, part and mask of every row of docs: bit i is set if the document fails filter i."""
    spark = docs.sparkSession
    text = whole("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("print", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    # one partition at least for each of the session's; the sample that finds the ranges holds fingerprints, no texts
    dealt = rows.repartitionByRange(partitions(spark), F.col("print"), F.col("doc_id").asc_nulls_last())
    dealt = dealt.sortWithinPartitions("print", "text", F.col("doc_id").asc_nulls_last())
    split = dealt.withColumn("words", split_words(F.col("text")))
    failed = failures(F.col("text"), F.col("words"))
    if COPY in failed:
        raise ValueError(f"{COPY} is the filter for duplicates")
    mask = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(failed.values())), F.lit(0))
    bit = 1 << len(failed)
    seen = cut(split.select("doc_id", "part", mask.cast("int").alias("mask"), "print", "text").mapInArrow(lambda b: _follows(b, bit), DEALT))
    # at most one row a range: the first range that ends with a fingerprint, for the ranges after it
    ends = seen.where("mask IS NULL").groupBy("edge").agg(F.min("range").alias("ended"))
    rows = seen.where("mask IS NOT NULL").join(F.broadcast(ends), "edge", "left")
    go_on = F.coalesce(F.col("ended") < F.col("range"), F.lit(False))
    return rows.select("doc_id", "part", F.when(go_on, F.col("mask").bitwiseOR(F.lit(bit))).otherwise(F.col("mask")).alias("mask"))


def counters(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): additive counts, at most two to the number of filters a part."""
    says = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    few = masked.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    named = few.join(says, "doc_id", "left")
    of = lambda c: F.coalesce(F.sum(F.when(F.col(c) == 1, F.col("n"))), F.lit(0)).alias(c)
    return named.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def audit(counted: DataFrame, letters: str) -> DataFrame:
    """A row per part, order of the filters and step, worked out from counters (part, mask, n, good, toxic).

    The counters of a part, one per mask, meet in one row; orders and steps are fixed.
    """
    m = len(letters)
    steps = []
    for order in permutations(range(m)):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append((("".join(letters[i] for i in order)), step, f, before))
            before |= 1 << f
    fixed = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(f).alias("f"), F.lit(b).alias("before")) for o, s, f, b in steps))
    per = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("c"))
    rows = per.select("part", "c", F.inline(fixed))
    own = F.expr("shiftleft(1, f)")
    fails = lambda x: x["mask"].bitwiseAND(own) != 0
    earlier = lambda x: x["mask"].bitwiseAND(F.col("before")) != 0
    total = lambda when, what: F.aggregate(F.filter("c", when), F.lit(0).cast("long"), lambda a, x: a + what(x))
    n = lambda x: x["n"]
    here = lambda x: fails(x) & ~earlier(x)
    orders = F.lit(math.factorial(m)).cast("long")
    return rows.select(
        "part", "filter_order", "step",
        total(lambda x: ~fails(x) & ~earlier(x), n).alias("kept"),
        total(here, n).alias("removed"),
        total(lambda x: fails(x) & earlier(x), n).alias("redundant"),
        total(lambda x: x["mask"] == own, n).alias("unique_fails"),
        total(here, lambda x: x["good"]).alias("good_lost"),
        total(here, lambda x: x["toxic"]).alias("toxic_lost"),
        # of the orders, the filter comes first among those a document fails in one out of their number
        total(fails, lambda x: x["n"] * (orders / F.bit_count(x["mask"])).cast("long")).alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by source, under all labels."""
    masked = masks(table(spark, sf_dir, "documents"))
    return audit(cut(counters(masked, table(spark, sf_dir, "labels"))), "ABCD" + COPY)


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, len(w) < 200 AS A, 100 * len(list_distinct(w)) < 50 * len(w) AS B,
             100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) AS C, regexp_matches(t, '[#$%&*|]') AS D, doc_id > min(doc_id) OVER (PARTITION BY t) AS E FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT part, array_to_string(list_filter([CASE WHEN A THEN 'A' END, CASE WHEN B THEN 'B' END, CASE WHEN C THEN 'C' END, CASE WHEN D THEN 'D' END, CASE WHEN E THEN 'E' END], lambda v: v IS NOT NULL), '') AS fails,
             count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
s AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS s),
o AS (SELECT a.s || b.s || c.s || d.s || e.s AS filter_order FROM s a, s b, s c, s d, s e
      WHERE len(list_distinct([a.s, b.s, c.s, d.s, e.s])) = 5),
p AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
y AS (SELECT part, filter_order, step, own, n, good, toxic, contains(fails, own) AS failed, fails = own AS alone,
             len(list_filter(string_split(before, ''), lambda v: v <> '' AND contains(fails, v))) > 0 AS gone FROM x, p),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT failed AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (failed AND NOT gone), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (failed AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (failed AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (failed AND NOT gone), 0)::BIGINT AS toxic_lost FROM y GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r
"""
