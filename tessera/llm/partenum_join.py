"""Exact Jaccard join of documents' word shingles with PartEnum signatures.

Two sets with a Jaccard similarity of 3/4 or more differ in at most (|r| + |s|) / 7 elements, and
their sizes lie in the same band or in adjacent ones (a band's top is 4/3 of its bottom). The
feature domain is partitioned by hash into more parts than that; so two such sets agree on some
part in whole. A signature is the content of one part, for the set's own band and for the next,
and sets that share a signature are compared in full.

What keeps this linear:
- Equal sets are one class from the start, so copies make no pairs.
- Parts where a set is empty give no signature. A set with more parts in use than it may differ
  in (nearly all) agrees with any partner on one in use. The others name their empty parts, too.
- A signature of more than HOT classes (a passage that many documents share) is not paired. A set
  with enough parts left meets its partners elsewhere. For the few without, the members of a hot
  group are compared with its first one; what that leaves in different components, pair by pair.
- Pairs pass two tests before sets are fetched: the counts of their elements in BINS bins, then in
  as many bins as keep a few elements in each, may not differ by more than linked sets can.
- Each class is first compared with its smallest partner and with the first class of its hot groups,
  which brings a large group of near copies together at a pair or two a class; pairs that are in
  one component by then are neither tested nor compared.

Signatures travel packed in binary columns, a few million to a bucket, and are matched with numpy;
the number of buckets follows the number of shingles. Parts are named by 48 bits and the bucket,
which only costs a comparison where it errs; classes travel by 64 bits of a name of 128, and those
that agree in these are told apart before anything is compared.

What is probabilistic: two different words count as one if their XXH3 hashes of 128 bits agree (not
a cryptographic hash: among words not made to agree, that is no likelier than with one), two sets as equal if 128 bits over both hashes of their shingles do, and in an intersection two
shingles as one if a hash of 64 bits does (for two sets of 10,000 shingles, a chance of 1e-11).

Defined results: a document without words (or a null text) has an empty set and is linked with
nothing; a null doc_id has a null component and is linked with nothing; repeated rows are equal
sets; rows that share a doc_id are each judged by their own text; of rows with one smallest doc_id
the least class and digest is the one that stays; very long texts are read whole, each as a slice
of its own; an empty table gives an empty result; columns other than doc_id and text are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, release, slices, table

#: Words in a shingle.
SHINGLE = 5
#: Signatures in a bucket, about; classes of a signature beyond which it is hot; bins of the test before fetching.
BUCKET = 1_000_000
HOT = 16
BINS = 64
#: Rounds in which members of a hot group are compared with one of them.
ROUNDS = 2
#: Members and elements of a block where those of a hot group are compared with one another, about,
#: and the bins of the test before sets are compared there.
BLOCK = 512
BLOCK_ELEMENTS = 2_000_000
BLOCK_BINS = 512
#: Ids that a task links with their smallest at a time, about.
LINKED = 500_000
#: Rows of one key beyond which a join on it is salted.
FAN = 256
#: Elements per bin of the finer test, about, and the most classes whose numbers are broadcast to find them or their texts.
PER_BIN = 4
BROADCAST = 1_000_000
#: The most rows (of a few numbers and a name) that go whole to every task rather than have sets or hot members shuffled.
FEW = 100_000

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def released(each):
    """each, a function over the batches of a task, after which the worker gives back its memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each(batches)
        release()

    return run


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(elements, sizes, names): the sorted shingle hashes of each text, one text after the other,
    and 128 bits that name each set.

    Words are told apart by a hash of 128 bits, shingles by two hashes of 64 bits
    over different halves of these. Elements are the first; the name covers both.
    """
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]  # bytes: ASCII letters and white space only
    n_words = np.array([len(w) for w in words], np.int64)
    ids = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, chain.from_iterable(words))), "<u8").reshape(-1, 2)
    del words
    first = np.cumsum(n_words) - n_words
    size = max(0, len(ids) - SHINGLE + 1)
    rolled, other = np.zeros(size, _U), np.zeros(size, _U)
    for i in range(SHINGLE):
        rolled = mix(rolled * _P + ids[i : i + size, 0] + _U(1))
        other = other * _P + ids[i : i + size, 1]
    other = mix(other)
    n = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, (n_words > 0).astype(np.int64))
    begins = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(owner)) - begins[owner] + first[owner]
    out, more = np.zeros(len(owner), _U), np.zeros(len(owner), _U)
    long = n_words[owner] >= SHINGLE
    out[long], more[long] = rolled[at[long]], other[at[long]]
    for i in np.flatnonzero(~long):  # fewer words than a shingle: all of them as one
        d = owner[i]
        raw = ids[first[d] : first[d] + n_words[d]].tobytes()
        out[i], more[i] = np.frombuffer(hashlib.blake2b(raw, digest_size=16).digest(), "<u8")
    for d in np.flatnonzero(n > 1):
        own = slice(begins[d], begins[d + 1])
        order = out[own].argsort()
        out[own], more[own] = out[own][order], more[own][order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out, more = out[new], more[new]
    sizes = np.bincount(owner[new], minlength=len(texts))
    sums = _sums(more, np.cumsum(sizes) - sizes, sizes).astype("<u8").tobytes()
    raw, ends = out.astype("<u8").tobytes(), [0, *(8 * np.cumsum(sizes)).tolist()]
    names = [hashlib.blake2b(raw[b:e] + sums[8 * i : 8 * i + 8], digest_size=16).digest() for i, (b, e) in enumerate(zip(ends, ends[1:]))]  # noqa: B905
    return out, sizes, names


def short(names: list[bytes], bits: int) -> np.ndarray:
    """The first bits of names, as signed numbers of 64 bits."""
    return (np.frombuffer(b"".join(names), "<i8")[::2] >> np.int64(64 - bits)).astype("<i8")


@lru_cache(maxsize=4)
def _tops(largest: int) -> np.ndarray:
    """The largest size of each band."""
    tops, low = [], 1
    while not tops or tops[-1] < largest:
        tops.append(4 * low // 3)
        low = tops[-1] + 1
    tops.append(4 * low // 3)
    return np.array(tops, np.int64)


def difference_bound(sizes: np.ndarray, tops: np.ndarray, step: int) -> np.ndarray:
    """How many elements a set and a partner can differ in, for signatures of its own band
    (step 0: the partner may be as large as the band's top) or the next (step 1)."""
    largest = 4 * sizes // 3
    return (sizes + (np.minimum(largest, tops) if step == 0 else largest)) // 7


def signatures(elements: np.ndarray, sizes: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, signature, spare) for the sets' own band (step 0) or the next one (step 1).

    spare, per set: parts in use beyond those it may differ in from a partner. Where that is not
    above 0, empty parts have signatures, too. The lowest bit of a signature is the band's parity.
    """
    tops = _tops(int(sizes.max(initial=1)))
    band = np.searchsorted(tops, sizes) + step
    top = tops[np.minimum(band, len(tops) - 1)]
    parts = np.ceil(0.45 * top + 3 * np.sqrt(top)).astype(np.int64) + 16
    parts[(2 * top < 7) | (sizes == 0)] = 0  # so small sets are linked when equal only
    begin = np.cumsum(parts) - parts
    owner = np.repeat(np.arange(len(sizes)), sizes)
    use = parts[owner] > 0
    owner, x = owner[use], elements[use]
    x = mix(x ^ (band[owner].astype(_U) * _P))
    slot = begin[owner] + (((x >> _U(32)) * parts[owner].astype(_U)) >> _U(32)).astype(np.int64)
    content = mix(x + _P)
    n = int(parts.sum())
    low = np.bincount(slot, (content & _U(0xFFFFFFFF)).astype(np.float64), n)
    high = np.bincount(slot, (content >> _U(32)).astype(np.float64), n)
    held = np.bincount(slot, minlength=n)
    of = np.repeat(np.arange(len(sizes)), parts)
    spare = np.bincount(of[held > 0], minlength=len(sizes)) - difference_bound(sizes, top, step)
    named = (held > 0) | (spare[of] <= 0)
    of, low, high, held = of[named], low[named], high[named], held[named]
    part = (np.arange(n) - begin.repeat(parts))[named]
    s = mix(low.astype(_U) + mix(high.astype(_U) + mix(part.astype(_U) * _P + band[of].astype(_U)) + held.astype(_U)))
    return of, (s & ~_U(1)) | (band[of] & 1).astype(_U), spare


def _sums(x: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, _U), np.cumsum(x, dtype=_U)])
    return total[begins + sizes] - total[begins]


def _profiles(elements: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Per set, the counts of its elements in a power of two of bins, by their lowest bits; counts
    of 255 and more are one."""
    bins = BINS << np.maximum(0, np.ceil(np.log2(np.maximum(sizes, 1) / (PER_BIN * BINS)))).astype(np.int64)
    begin = np.cumsum(bins) - bins
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = begin[owner] + (elements & (bins[owner] - 1).astype(_U)).astype(np.int64)
    counts = np.minimum(np.bincount(at, minlength=int(bins.sum())), 255).astype(np.uint8)
    return np.split(counts, begin[1:])


def fold(profile: np.ndarray, bins: int) -> np.ndarray:
    """The same counts in fewer bins."""
    return np.minimum(profile.reshape(-1, bins).sum(axis=0, dtype=np.int64), 255)


def describe(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(doc_id, digest, n_shingles, name, cls, spare0, spare1, parity, bins, profile) of docs
    (doc_id, text); digest is the text's SHA-256, name 128 bits of its set and cls the first bits
    of these, parity that of the set's own band, bins and profile are counts of elements."""
    kinds = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_shingles", pa.int64()), ("name", pa.binary()), ("cls", pa.int64()), ("spare0", pa.int64()), ("spare1", pa.int64()), ("parity", pa.int64()), ("bins", pa.binary()), ("profile", pa.binary())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part["text"].to_pylist()
            elements, sizes, names = shingle_sets(texts)
            profiles = _profiles(elements, sizes)
            coarse = [fold(p, BINS).astype(np.uint8).tobytes() for p in profiles]
            spare = [signatures(elements, sizes, step)[2] for step in (0, 1)] + [np.searchsorted(_tops(int(sizes.max(initial=1))), sizes) & 1]
            digests = [None if t is None else hashlib.sha256(t.encode()).digest() for t in texts]
            columns = [part["doc_id"], digests, sizes, names, short(names, bits), *spare, coarse, [p.tobytes() for p in profiles]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(each), "doc_id long, digest binary, n_shingles long, name binary, cls long, spare0 long, spare1 long, parity long, bins binary, profile binary")


def bucketed_signatures(docs: DataFrame, buckets: int, bits: int = 64) -> DataFrame:
    """A row per slice of documents and bucket: packed signatures, places in the slice, and the
    slice's classes and sizes.

    A signature of more than HOT classes of one slice is hot already: the bucket gets one class of
    them, marked in the column hot, so that however many documents share a passage, a bucket gets
    HOT of a slice at most. All of them go to a bucket from `buckets` on, chosen by content, as
    pairs of the signature's number (column high) and class.
    """
    kinds = pa.schema([("bucket", pa.int32()), ("high", pa.binary()), ("low", pa.binary()), ("place", pa.binary()), ("hot", pa.binary()), ("cls", pa.binary()), ("size", pa.binary())])
    limit = HOT

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            elements, sizes, full = shingle_sets([t if i is not None else None for i, t in zip(ids, texts, strict=True)])
            names = short(full, bits)
            keep = np.zeros(len(names), bool)
            keep[list({n: i for i, n in enumerate(full)}.values())] = True  # copies within the slice go here
            elements, names, sizes = elements[np.repeat(keep, sizes)], names[keep], sizes[keep]
            both = [signatures(elements, sizes, step)[:2] for step in (0, 1)]
            owner, s = np.concatenate([x[0] for x in both]), np.concatenate([x[1] for x in both])
            # the bucket takes the upper bits' place, so 48 others are kept besides it
            bucket = ((s >> _U(48)) * _U(buckets) >> _U(16)).astype(np.int32) if buckets <= 1 << 16 else (s >> _U(16)).astype(np.int64) % buckets
            order = np.lexsort((s, bucket))
            owner, s, bucket = owner[order], s[order], bucket[order]
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (bucket[1:] != bucket[:-1])
            group = np.cumsum(new) - 1
            hot = (np.bincount(group, minlength=1)[group] > limit) if len(s) else np.zeros(0, bool)
            out = []
            if hot.any():
                numbers = (s[hot] & _U((1 << 48) - 1)) | (bucket[hot].astype(_U) << _U(48))
                out.append((buckets + int(names[0]) % buckets, numbers.astype("<u8").tobytes(), b"", b"", b"", names[owner[hot]].astype("<i8").tobytes(), b""))
            stays = ~hot | new
            owner, s, bucket, hot = owner[stays], s[stays], bucket[stays], hot[stays]
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(edges)):
                own = slice(edges[k], edges[k + 1])
                used, place = np.unique(owner[own], return_inverse=True)
                mark = hot[own].tobytes() if hot[own].any() else b""
                out.append((int(k), (s[own] >> _U(16)).astype("<u4").tobytes(), s[own].astype("<u2").tobytes(), place.astype("<u2").tobytes(), mark, names[used].astype("<i8").tobytes(), sizes[used].astype("<i4").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(each), "bucket int, high binary, low binary, place binary, hot binary, cls binary, size binary")


def match(packed: DataFrame, buckets: int) -> DataFrame:
    """(kind, a, b, first): kinds 0 and 2 are pairs of classes a < b that share a signature, 0 with the
    smallest class that has it; kind 1 is the class b of hot signature a. Where all classes of such a
    signature are here, first is the smallest of them; where slices have sent theirs elsewhere, first is
    null and a class may come more than once."""

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        get = lambda column, kind: [np.frombuffer(x, kind) for x in frame[column]]
        if frame["bucket"].iloc[0] >= buckets:  # classes of signatures that are hot within a slice
            numbers, members = np.concatenate(get("high", "<u8")).view(np.int64), np.concatenate(get("cls", "<i8"))
            return pd.DataFrame({"kind": np.ones(len(numbers), np.int32), "a": numbers, "b": members, "first": pd.array([pd.NA] * len(numbers), "Int64")})
        place = get("place", "<u2")
        s = np.concatenate(get("high", "<u4")).astype(_U) << _U(16) | np.concatenate(get("low", "<u2")).astype(_U)
        cls = np.concatenate([c[p] for c, p in zip(get("cls", "<i8"), place, strict=True)])
        size = np.concatenate([c[p] for c, p in zip(get("size", "<i4"), place, strict=True)])
        mark = np.concatenate([np.frombuffer(x, bool) if x else np.zeros(len(p), bool) for x, p in zip(frame["hot"], place, strict=True)])
        order = np.argsort(s)
        s, cls, size, mark = s[order], cls[order], size[order], mark[order]
        same = np.zeros(len(s) + 1, bool)
        same[1:-1] = s[1:] == s[:-1]
        keep = same[1:] | same[:-1]  # what shares its signature
        s, cls, size, mark = s[keep], cls[keep], size[keep], mark[keep]
        order = np.lexsort((~mark, size, cls, s))
        s, cls, size, mark = s[order], cls[order], size[order], mark[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (cls[1:] != cls[:-1]) | (size[1:] != size[:-1])
        s, cls, size, mark = s[new], cls[new], size[new], mark[new]
        _, which, n = np.unique(s, return_inverse=True, return_counts=True)
        spread = (np.bincount(which, mark, len(n)) > 0)[which] if len(s) else np.zeros(0, bool)
        hot = (n[which] > HOT) | spread if len(s) else spread
        gid = (s[hot & ~mark] | (_U(frame["bucket"].iloc[0]) << _U(48))).view(np.int64)
        members, open_ = cls[hot & ~mark], spread[hot & ~mark]
        least = cls[(np.cumsum(n) - n)[which[hot & ~mark]]]  # classes of a signature ascend
        s, cls, size = s[~hot], cls[~hot], size[~hot]
        start = np.ones(len(s), bool)
        start[1:] = s[1:] != s[:-1]
        found = [np.zeros((0, 3), np.int64)]
        for d in range(1, HOT):
            near = (s[d:] == s[:-d]) & (4 * np.minimum(size[d:], size[:-d]) >= 3 * np.maximum(size[d:], size[:-d]))
            kind = np.where(start[:-d], 0, 2)  # with the group's first class, or without
            found.append(np.stack([kind, cls[:-d], cls[d:]], 1)[near] if d < len(s) else found[0])
        pairs = np.unique(np.concatenate(found), axis=0)
        hot_rows = np.stack([np.ones(len(gid), np.int64), gid, members], 1)
        first = pd.arrays.IntegerArray(np.concatenate([np.zeros(len(pairs), np.int64), least]), np.concatenate([np.ones(len(pairs), bool), open_]))
        del s, cls, size, mark, found, order, keep, same, which, spread
        release()
        return pd.DataFrame(np.concatenate([pairs, hot_rows]), columns=["kind", "a", "b"]).astype({"kind": np.int32}).assign(first=first)

    return packed.groupBy("bucket").applyInPandas(each, "kind int, a long, b long, first long")


def hubs_of(rows: DataFrame, *keys: str) -> list[DataFrame | None]:
    """Of each key column (value, parts) of the values that more than FAN rows have, or None without any.

    They hold for any part of rows as well: there they only deal out more than they must.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(k).alias("value")) for i, k in enumerate(keys)]))
    degrees = rows.select(sides.alias("x")).groupBy("x.side", "x.value").agg(F.count("*").alias("n"))
    found = degrees.where(F.col("n") > FAN).select("side", "value", F.ceil(F.col("n") / FAN).cast("int").alias("parts"))
    found = cut(found)
    n = found.agg(F.sum("parts")).first()[0]
    if not n:
        return [None] * len(keys)
    small = F.broadcast(found) if n <= BROADCAST else found
    return [small.where(F.col("side") == i).drop("side") for i in range(len(keys))]


def beside(rows: DataFrame, key: str, other: DataFrame, hubs: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows joined with other (key once per value) on key; rows of a hub are dealt to several tasks,
    by a hash of the row, and its row of other goes to each of these."""
    if hubs is None:
        return rows.join(other, key, how)
    parts, hubs = F.coalesce("parts", F.lit(1)), hubs.withColumnRenamed("value", key)
    left = rows.join(hubs, key, "left").withColumn("salt", F.pmod(F.xxhash64(*rows.columns), parts).cast("int")).drop("parts")
    right = other.join(hubs, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left.join(right, [key, "salt"], how).drop("salt")


def screen(pairs: DataFrame, classes: DataFrame, counts: str, hubs: list) -> DataFrame:
    """The pairs (a, b) whose sizes and counts (bins or profile) allow a link. Counts differ by no
    more than the sets do, so no link is lost."""
    own = classes.select("cls", "n_shingles", counts)
    both = beside(pairs, "b", own.toDF("b", "nb", "cb"), hubs[1])
    both = beside(both, "a", own.toDF("a", "na", "ca"), hubs[0])
    both = both.where(4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in (part for batch in batches for part in slices([batch], 1 << 23, text="ca")):
            near = []
            for p, q, bound in zip(x["ca"].to_pylist(), x["cb"].to_pylist(), (x["na"].to_numpy() + x["nb"].to_numpy()) // 7, strict=True):
                p, q = np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)
                bins = min(len(p), len(q))
                near.append(np.abs(fold(p, bins) - fold(q, bins)).sum() <= bound)
            yield x.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return both.mapInArrow(released(each), "a long, b long")


def fetch_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, n_shingles, elements), once per class of wanted (cls, name, doc_id, n_shingles), from the texts of docs."""
    ids = wanted.select("doc_id").distinct()
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST else ids.hint("shuffle_hash")
    near = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            elements, sizes, names = shingle_sets(part["text"].to_pylist())
            raw, begins = elements.astype("<u8").tobytes(), np.cumsum(sizes) - sizes
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([raw[8 * b : 8 * (b + n)] for b, n in zip(begins.tolist(), sizes.tolist(), strict=True)], pa.binary())], ["name", "elements"])

    found = near.mapInArrow(released(each), "name binary, elements binary")
    names = wanted.select("cls", "name", "n_shingles")
    return found.join(F.broadcast(names) if wanted.count() <= FEW else names, "name").drop("name").dropDuplicates(["cls"])


def compare_sets(pairs: DataFrame, sets: DataFrame, hubs: list) -> DataFrame:
    """The pairs (a, b) of classes that are linked. Few pairs go to the sets, so that these are shuffled once."""
    few = hubs[1] is None and pairs.count() <= FEW
    both = beside(F.broadcast(pairs) if few else pairs, "b", sets.select("cls", "elements").toDF("b", "eb"), hubs[1])
    both = beside(both, "a", sets.select("cls", "elements").toDF("a", "ea"), hubs[0])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            linked = []
            for p, q in zip(x["ea"], x["eb"], strict=True):
                p, q = np.frombuffer(p.as_buffer(), "<u8"), np.frombuffer(q.as_buffer(), "<u8")
                common = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(100 * common >= 75 * (len(p) + len(q) - common))
            yield x.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return both.mapInArrow(released(each), "a long, b long")


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v), v < u, that connect what edges connects: within each run of LINKED ids of a
    partition, every id is linked with the smallest that it reaches there, and named once as u."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (above := up.get(x, x)) != x:
                up[x] = x = up.get(above, above)
            return x

        def stars() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([root(x) for x in list(up)], pa.int64())], ["u", "v"])

        for batch in batches:
            for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True):
                u, v = root(u), root(v)
                if u != v:
                    up[max(u, v)] = min(u, v)
            if len(up) > LINKED:
                yield stars()
                up.clear()
        yield stars()

    return edges.mapInArrow(released(each), "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of the ends of links (a, b): the smallest id that each can reach; ids that
    are this themselves may be missing.

    Alternating large and small stars over contracted edges: every round hands neighbours to the
    smallest one nearby, until each is linked with its component's smallest id alone. As soon as
    no more edges are left than one task contracts at a time anyway, one finishes them.
    """
    edges, contract = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), True
    while True:
        if (n := edges.count()) <= LINKED:
            done = cut(contracted(edges.coalesce(1)), n)
            return done.select(F.col("u").alias("id"), F.col("v").alias("component"))
        if contract:
            edges, contract = cut(contracted(edges)), False
            continue
        sides = edges.union(edges.select("v", "u"))
        least = cut(sides.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), (F.min("v") < F.max("v")).alias("several"), F.count("*").alias("n")))
        # done when each id but the smallest ones has one neighbour: then that is its component's smallest
        going, hubs = least.agg(F.count_if((F.col("m") < F.col("u")) & F.col("several")), F.sum(F.when(F.col("n") > FAN, F.ceil(F.col("n") / FAN)))).first()
        if not going:
            return cut(least.select(F.col("u").alias("id"), F.col("m").alias("component")))
        listed = least.where(F.col("n") > FAN).select(F.col("u").alias("value"), F.ceil(F.col("n") / FAN).cast("int").alias("parts"))
        listed = None if not hubs else F.broadcast(listed) if hubs <= BROADCAST else listed
        large = beside(sides.where("v > u"), "u", least.select("u", "m"), listed).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # an id has at most a row for each partition that named it, so these windows stay small
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        edges = cut(contracted(small.where("u <> v")))


def apart(pairs: DataFrame, found: DataFrame, hubs: list) -> DataFrame:
    """The pairs (a, b) that found (id, component) does not put together."""
    both = beside(pairs, "a", found.toDF("a", "ca"), hubs[0], "left")
    both = beside(both, "b", found.toDF("b", "cb"), hubs[1], "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def link(pairs: DataFrame, classes: DataFrame, docs: DataFrame, hubs: list | None = None) -> DataFrame:
    """Links (a, b) that span the components of those among pairs, whose hubs may be given."""
    hubs, n = hubs or hubs_of(pairs, "a", "b"), pairs.count()
    if 2 * n <= BROADCAST:  # of few pairs, only the classes they name are dealt out
        ends = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        classes = classes.join(F.broadcast(ends), "cls", "left_semi")
    near = cut(screen(screen(pairs, classes, "bins", hubs), classes, "profile", hubs), n)
    n = near.count()
    if not n:
        return near
    named = near.select(F.col("a").alias("cls")).union(near.select(F.col("b").alias("cls"))).distinct()
    wanted = cut(classes.join(named, "cls").select("cls", "name", "doc_id", "n_shingles"), 2 * n)
    sets = cut(fetch_sets(docs, wanted))
    least = cut(near.groupBy("b").agg(F.min("a").alias("least")), n)
    first = cut(compare_sets(least.select(F.col("least").alias("a"), "b"), sets, hubs), n)
    # pairs that their smallest partners, or those of these, put together are not compared
    once = first.select(F.col("b").alias("id"), F.col("a").alias("component"))
    twice = once.toDF("component", "further")
    labels = cut(beside(once, "component", twice, hubs[0], "left").select("id", F.coalesce("further", "component").alias("component")), n)
    other = beside(near, "b", least, hubs[1]).where("a <> least").select("a", "b")
    other = cut(apart(other, labels, hubs), n)
    m = other.count()
    return first.union(cut(compare_sets(other, sets, hubs), m)) if m else first


def joined(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components (id, component) of links together with those found before."""
    return components(links if found is None else links.union(found.where("id <> component").select("id", "component")))


def across(open_: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) of members of a star in different components, one of them outside of the largest.

    Members meet block by block: those outside in blocks of about BLOCK members and
    BLOCK_ELEMENTS elements at most, all members likewise, every two blocks in a task of their own. There
    whole sets are compared, and only links that bring components together leave the task.
    """
    wanted = cut(open_.select("cls").distinct().join(classes.select("cls", "name", "doc_id", "n_shingles"), "cls"))
    sets = cut(fetch_sets(docs, wanted))
    sized = open_.join(wanted.select("cls", "n_shingles"), "cls").withColumn("out", F.col("c") != F.col("largest"))
    blocks = lambda n, m: F.ceil(F.greatest(n / BLOCK, m / BLOCK_ELEMENTS)).cast("int")
    sizes = cut(sized.groupBy("a").agg(
        blocks(F.count("*"), F.sum("n_shingles")).alias("all_"),
        blocks(F.count_if("out"), F.sum(F.when(F.col("out"), F.col("n_shingles")).otherwise(0))).alias("out_"),
    ))
    rows = cut(open_.join(sets, "cls").join(sizes, "a"))
    at = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("c <> largest").select("a", at("out_").alias("i"), span("all_").alias("j"), "cls", "c", "n_shingles", "elements")
    right = rows.select("a", span("out_").alias("i"), at("all_").alias("j"), "cls", "c", "n_shingles", "elements")

    def each(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(x) and len(y):
            own, other = ([np.frombuffer(r, "<u8") for r in f["elements"]] for f in (x, y))
            p, q = (np.stack([np.bincount((r & _U(BLOCK_BINS - 1)).astype(np.int64), minlength=BLOCK_BINS) for r in sets]).astype(np.int32) for sets in (own, other))
            n, cls = y["n_shingles"].to_numpy(), y["cls"].to_numpy()
            # names of components, which links within this pair of blocks make one
            group, names = np.unique(np.concatenate([x["c"].to_numpy(), y["c"].to_numpy()]), return_inverse=True)[1], x["cls"].to_numpy()
            for k, (name, size) in enumerate(zip(names, x["n_shingles"], strict=True)):
                mine, theirs = group[: len(x)], group[len(x) :]
                near = np.flatnonzero((theirs != mine[k]) & (4 * np.minimum(n, size) >= 3 * np.maximum(n, size)))
                near = near[np.abs(q[near] - p[k]).sum(axis=1) * 7 <= n[near] + size]
                for o in near:
                    if theirs[o] != mine[k]:
                        common = len(np.intersect1d(own[k], other[o], assume_unique=True))
                        if 100 * common >= 75 * (size + n[o] - common):
                            found.append((min(name, cls[o]), max(name, cls[o])))
                            group[group == theirs[o]] = mine[k]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return left.groupBy("a", "i", "j").cogroup(right.groupBy("a", "i", "j")).applyInPandas(each, "a long, b long")


def settle(stars: DataFrame, found: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The components once the pairs within stars (a, b: compared already) are settled, too.

    Any two members of a hot group are members of the star of its first one. Where a star's
    members are in several components, a member of the largest is compared with all in others;
    so near copies come together at a row per member and round. After ROUNDS of them, or one that
    settles less than half of what was left, those left in different components meet in blocks.
    """
    if stars.isEmpty():
        return found
    tested = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    members = stars.select("a", F.col("b").alias("cls")).union(stars.select("a", F.col("a").alias("cls"))).distinct()
    n, before, turn = 2 * stars.count(), None, 0
    members = cut(members, n)
    while True:
        placed = cut(members.join(found.withColumnRenamed("id", "cls"), "cls", "left").select("a", "cls", F.coalesce("component", "cls").alias("c")), n)
        sizes = placed.groupBy("a", "c").agg(F.count("*").alias("n"))
        mixed = sizes.groupBy("a").agg(F.max(F.struct("n", "c"))["c"].alias("largest"), F.count("*").alias("k")).where("k > 1")
        open_ = cut(placed.join(mixed.drop("k"), "a"), n)
        outside = open_.where("c <> largest").count()
        if not outside:
            return found
        if turn == ROUNDS or (before is not None and 2 * outside > before):
            return joined(found, cut(across(open_, classes, docs)))
        own = F.struct(F.xxhash64("cls", F.lit(turn)).alias("h"), "cls")
        chosen = open_.where("c = largest").groupBy("a").agg(F.min(own)["cls"].alias("next"))
        pairs = open_.where("c <> largest").join(chosen, "a").select(F.least("next", "cls").alias("a"), F.greatest("next", "cls").alias("b"))
        pairs = cut(pairs.distinct().join(tested, ["a", "b"], "left_anti"), n)
        found = joined(found, link(pairs, classes, docs))
        tested, before, turn = tested.union(pairs), outside, turn + 1


def tell_apart(described: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """described and classes with a cls of its own for each name, and (name, was, cls) of those
    that changed, or None.

    Among very many classes a few pairs agree in the first bits of their names. These get another
    number, which is tried until it is free.
    """
    shared = classes.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select("cls")
    n = shared.count()
    if not n:
        return described, classes, None
    shared = cut(shared, n)
    twins = cut(classes.join(F.broadcast(shared) if n <= BROADCAST else shared, "cls").select("name", F.col("cls").alias("was")))
    for seed in count():
        renamed = cut(twins.withColumn("cls", F.xxhash64("name", F.lit(seed))))
        new = [df.join(renamed.select("name", F.col("cls").alias("new")), "name", "left").withColumn("cls", F.coalesce("new", "cls")).drop("new") for df in (described, classes)]
        if new[1].groupBy("cls").count().where("count > 1").isEmpty():
            return cut(new[0]), cut(new[1]), renamed


def translate(matched: DataFrame, renamed: DataFrame) -> DataFrame:
    """matched by the numbers that tell_apart() gave; classes that had shared one are pairs as well."""
    to = renamed.select("was", "cls")
    ends = lambda df, c: df.join(to.toDF(c, "new"), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
    both = ends(ends(matched.where("kind <> 1").drop("first"), "a"), "b")
    twins = to.toDF("was", "a").join(to.toDF("was", "b"), "was").select(F.lit(2).alias("kind"), "a", "b")
    pairs = both.select("kind", "a", "b").union(twins).where("a <> b").select("kind", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = pairs.withColumn("first", F.lit(None).cast("long"))
    return pairs.union(ends(ends(matched.where("kind = 1"), "b"), "first").select("kind", "a", "b", "first"))


def join_documents(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(doc_id, digest, n_shingles, cls, component_id, stays) of every row of docs (doc_id, text).

    Of the rows of a component one text stays: that of the smallest doc_id, where rows share this
    of the smallest class and digest. bits is how much of a name the signatures carry along.
    """
    described = cut(describe(docs, bits))
    best = F.struct("doc_id", "digest", "n_shingles", "cls", "spare0", "spare1", "parity", "bins", "profile")
    classes = cut(described.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("name").agg(F.min(best).alias("x")).select("name", "x.*"))
    shingles = classes.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(1, shingles // BUCKET)
    matched = cut(match(bucketed_signatures(docs, buckets, bits), buckets))
    described, classes, renamed = tell_apart(described, classes)
    if renamed is not None:
        matched = cut(translate(matched, renamed))
    pairs = matched.where("kind <> 1")

    # of hot groups, the members that may have no other signature in common with a partner; a group that
    # slices have as hot comes from many places, any other from one
    hot = matched.where("kind = 1").select(F.col("a").alias("gid"), F.col("b").alias("cls"), F.col("a").bitwiseAND(1).alias("bit"), "first")
    closed, spread = hot.where("first IS NOT NULL"), cut(hot.where("first IS NULL").drop("first").distinct())
    of_all = closed.drop("first").union(spread)
    lost = of_all.groupBy("cls", "bit").agg(F.count("*").alias("lost"))
    spare = F.when(F.col("bit") == F.col("parity"), F.col("spare0")).otherwise(F.col("spare1"))
    bound = cut(lost.join(classes.select("cls", "spare0", "spare1", "parity"), "cls").where(spare <= F.col("lost")).select("cls", "bit"))
    n_bound = bound.count()
    members = of_all.join(F.broadcast(bound) if n_bound <= FEW else bound, ["cls", "bit"]).select("gid", "cls")
    members = cut(members, of_all.count())
    firsts = lambda df: df.groupBy("gid").agg(F.min("cls").alias("a"))
    star_of = lambda df: beside(df, "gid", firsts(df), hubs_of(df, "gid")[0]).where("cls <> a").select("a", F.col("cls").alias("b"))
    stars = cut(star_of(members).distinct(), members.count())

    # first a pair or two of each class: with its smallest star and with the first of its hot groups;
    # then the other stars, then the other pairs, each only where they are in different components
    n = matched.count()
    star = cut(pairs.where("kind = 0").select("a", "b").union(stars).distinct(), n)
    heads = star_of(spread.select("gid", "cls")).union(closed.where("cls <> first").select("first", "cls"))
    heads = heads.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    least = star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    found = None
    for some in (least.union(heads).distinct(), star, pairs.where("kind = 2").select("a", "b").distinct()):
        some = cut(some, n)
        hubs = hubs_of(some, "a", "b")
        some = some if found is None else cut(apart(some, found, hubs), n)
        if found is None or not some.isEmpty():
            found = joined(found, link(some, classes, docs, hubs))
    found = settle(stars, found, classes, docs)

    row = F.struct("doc_id", "cls", "digest")
    named = cut(classes.select("cls", row.alias("row")).join(found.withColumnRenamed("id", "cls"), "cls", "left").select("cls", "row", F.coalesce("component", "cls").alias("c")))
    smallest = named.groupBy("c").agg(F.min("row").alias("first"))
    groups = beside(named, "c", smallest, hubs_of(named, "c")[0]).select("cls", "first")
    rows = beside(described.select("doc_id", "digest", "n_shingles", "cls"), "cls", groups, hubs_of(described, "cls")[0], "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    component = F.when(linked, F.col("first.doc_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "digest", "n_shingles", "cls", component.alias("component_id"), F.when(linked, row == F.col("first")).otherwise(True).alias("stays"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under a Jaccard similarity of 3/4 of their 5-word shingles."""
    return join_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
