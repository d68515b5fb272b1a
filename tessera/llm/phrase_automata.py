"""Phrase collocations, mined with suffix automata.

The texts of a task are cut into shards of about SHARD words. A shard's generalised suffix automaton,
to a depth of DEPTH words, is built level by level: a node of level k stands for a run of k words, and
knows at how many places it ends (endpos), its suffix link (the run without its first word) and its
hash. A state is a chain of nodes along suffix links that end at the same places.

Phrases that all shards together hold at least LEAST times are wanted, and every part of such a phrase
is held as often. So shards are read three times. The first reading counts all words and pairs. The
second adds the counts of the longer runs whose pairs are frequent to counters, one of which many runs
may share; Spark sums them over the shards. The third enumerates the states of three words and more and
counts those of their runs whose counters reach LEAST; a task sums them over its shards, and Spark over
tasks. What is frequent is told by filters of bits over hashes, which err only by letting too much pass,
and each run's own count decides in the end. No run is counted in two readings.

A run is named by the numbers of its words, 64 bits each. Words come with their text from the first
reading, every one of the table; should two of them have the same number, all is read again with
other numbers. So a run's number stands for its text, and text is joined to the frequent runs alone.

A phrase is dropped if a longer one holds it as often. Such a longer phrase can be shortened to one of
one word more, at the front or at the back, that is as frequent; so it is enough to follow each
phrase's suffix link and the link to its prefix, and compare counts there.

Defined results:
- A null text counts as empty; a null language is `und`, like that value itself. A language without
  words has no rows. Repeated rows count each. doc_id isn't used.
- Words are compared as bytes, with A-Z in lower case; a break between pieces is never crossed.
- Ties of scores end with the phrase's bytes; ranks have no gaps and no ties.
- A very long text is read as a whole, in the shard that it fills.
- An empty table gives an empty result. Columns other than text and lang are ignored.

The filter of words and pairs has 16 bits for each frequent one, of which PROBES are set, MAX_BITS (16 MB)
at most, whatever the data. Beyond 8 million of them more of the rare ones pass. There is a counter for each
16 words of the table, MAX_BITS at most. Beyond 2 billion words more runs share one, and more rare ones are
counted. Both cost time and change no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, partitions, release, slices, table

DEPTH = 5
#: Occurrences that a phrase has at least.
LEAST = 100
#: Phrases listed per language: the report's length.
TOP = 2000
#: Words in a shard, about: some 400 MB while its automaton is built. Fewer shards report a phrase fewer times.
SHARD = 5_000_000
MAX_BITS = 1 << 27
#: Words of the table for each counter of runs, about.
SHARED = 16
#: Ranges that the counters are summed in.
RANGES = 1024
#: Words that a task of the last reading reads at least, if that leaves TASKS of them for each core.
READ = 50_000_000
TASKS = 2
#: Runs that a task of the last reading holds before it reports them.
HELD = 1_000_000
#: Bits that a run sets, in one word of 64.
PROBES = 4
#: Salts of what is dealt by a word or a language.
SALTS = 16
#: A byte that no text in UTF-8 holds; it stands for a break.
END = 0xFF
BYTES = bytearray(range(256))
BYTES[65:91] = range(97, 123)
BYTES[9] = 32
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    BYTES[_c] = END
BYTES = bytes(BYTES)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits spread over 64: every bit of x moves all of the result."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Filter:
    """A set of hashes as bits: what was put in is always found, little else is. A hash's low bits name a
    word and a bit there; its highest ones, six at a time, the further bits that it sets in this word."""

    def __init__(self, words: np.ndarray, probes: int = 1):
        self.words, self.mask, self.probes = words, np.uint64(64 * len(words) - 1), probes

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        words = self.words[((hashes & self.mask) >> np.uint64(6)).astype(np.int64)]
        for k in range(self.probes):
            bit = (hashes >> np.uint64(64 - 6 * k) if k else hashes) & np.uint64(63)
            words = np.where((words >> bit) & np.uint64(1) == 1, words, np.uint64(0))
        return words != 0


def run_hashes(numbers: list[np.ndarray]) -> np.ndarray:
    """The hashes of runs, by the numbers of their first words, second words, ..."""
    out = numbers[0]
    for k, own in enumerate(numbers[1:], 1):
        out = _mixed(out + _mixed(own + np.uint64(k)))
    return out


class Level:
    """The nodes of one depth: at, the node that ends at each place (or -1); per node its count of
    places, suffix link, hash and one of the places."""

    def __init__(self, at: np.ndarray, count: np.ndarray, link: np.ndarray, hashes: np.ndarray, place: np.ndarray):
        self.at, self.count, self.link, self.hashes, self.place = at, count, link, hashes, place

    def keep(self, which: np.ndarray) -> Level:
        """The nodes of which alone; the others end nowhere."""
        new = np.append(np.where(which, np.cumsum(which) - 1, -1), -1).astype(np.int32)  # -1 names the last: no node
        return Level(new[self.at], self.count[which], self.link[which], self.hashes[which], self.place[which])


class SuffixAutomaton:
    """The suffix automaton of many pieces, to a bounded depth. ids has a word's number at each place
    and -1 between pieces; word_hashes has a hash per number."""

    def __init__(self, ids: np.ndarray, word_hashes: np.ndarray):
        self.ids, self.word_hashes = ids, word_hashes
        at = ids.astype(np.int32)
        count = np.bincount(at[at >= 0], minlength=len(word_hashes))
        place = np.zeros(len(word_hashes), np.int32)
        place[at[at >= 0]] = np.flatnonzero(at >= 0)
        self.levels = [Level(at, count, np.full(len(word_hashes), -1), word_hashes, place)]

    def prune(self, only: Filter) -> None:
        """Keep those nodes of the deepest level whose hashes the filter holds."""
        self.levels[-1] = self.levels[-1].keep(only.holds(self.levels[-1].hashes))

    def deepen(self) -> Level:
        """Add the runs of one word more, of which both parts of one word less are nodes."""
        above = self.levels[-1]
        before, own = np.concatenate([np.array([-1], np.int32), above.at[:-1]]), above.at
        ends = np.flatnonzero((before >= 0) & (own >= 0))
        # a run is its first k - 1 words and its last k - 1 words
        key = before[ends] * np.int64(len(above.count) + 1) + own[ends]  # 64 bits, as the factor has
        names, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        at, place = np.full(len(own), -1, np.int32), np.empty(len(names), np.int32)
        at[ends], place[inverse] = inverse, ends
        del key, inverse, ends, names
        words = self.word_hashes[self.ids[place]]
        hashes = _mixed(above.hashes[before[place]] + _mixed(words + np.uint64(len(self.levels))))  # as run_hashes has it
        self.levels.append(Level(at, count.astype(np.int32), own[place], hashes, place))
        return self.levels[-1]

    def numbers(self, place: np.ndarray, length: int) -> list[np.ndarray]:
        """The hashes of the words, first to last, of the runs that end at place."""
        return [self.word_hashes[self.ids[place - d]] for d in range(length - 1, -1, -1)]

    def states(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(longest, shortest, place, count) of all states, by their longest runs' lengths: the runs of
        all lengths between that end at place are those of the state, and end at count places."""
        n = len(self.levels)
        shortest = [np.full(len(lv.count), k + 1) for k, lv in enumerate(self.levels)]
        covered = [np.zeros(len(lv.count), bool) for lv in self.levels]
        for k in range(1, n):
            lv, up = self.levels[k], self.levels[k - 1]
            same = up.count[lv.link] == lv.count  # ends at the very places of its suffix
            covered[k - 1][lv.link[same]] = True
            shortest[k][same] = shortest[k - 1][lv.link[same]]
        for k, lv in enumerate(self.levels):
            top = ~covered[k]
            yield k + 1, shortest[k][top], lv.place[top], lv.count[top]


class Shard:
    """Some texts as numbers, as they come. A word of two languages is two words."""

    def __init__(self):
        self.known: dict[str, dict[bytes, int]] = {}
        self.words, self.langs, self.parts, self.size = [], [], [], 0

    def add(self, texts: list[bytes | None], langs: list[str | None]) -> None:
        by: dict[str, list[bytes]] = {}
        for text, lang in zip(texts, langs, strict=True):
            if text:
                by.setdefault("und" if lang is None else lang, []).append(text)
        end = bytes([END])
        for lang, own in by.items():
            known = self.known.setdefault(lang, {end: -1})
            words = (end + end.join(own)).translate(BYTES).replace(end, b" " + end + b" ").split()
            coded = pa.array(words, pa.large_binary()).dictionary_encode()
            numbers = []
            for word in coded.dictionary.to_pylist():
                number = known.get(word)
                if number is None:
                    number = known[word] = len(self.words)
                    self.words.append(word)
                    self.langs.append(lang)
                numbers.append(number)
            self.parts.append(np.array(numbers, np.int32)[coded.indices.to_numpy(zero_copy_only=False)])
            self.size += len(words)

    def automaton(self, seed: int = 0) -> SuffixAutomaton:
        """The automaton of the shard's words."""
        ids, self.parts, self.known = np.concatenate(self.parts), [], {}
        seeds = {lang: xxhash.xxh3_64_intdigest(b" " + lang.encode(), seed) for lang in set(self.langs)}  # no word: `de` of en isn't `en` of de
        plain = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.words], np.uint64)
        return SuffixAutomaton(ids, _mixed(plain + np.array([seeds[x] for x in self.langs], np.uint64)))


def shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Shard]:
    shard = Shard()
    for part in slices(batches):
        shard.add(part["text"].cast(pa.binary()).to_pylist(), part["lang"].to_pylist())
        if shard.size >= size:
            yield shard
            shard = Shard()
    if shard.size:
        yield shard


def _words_and_pairs(docs: DataFrame, depth: int, least: int, size: int, seed: int) -> DataFrame:
    """(a, b, lang, word, c): all words, by their number a and with their text, and the pairs of words a
    and b that are held at least so often."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "lang", "word", "c"]
        for shard in shards(batches, size):
            made = shard.automaton(seed)
            words, n = made.levels[0], len(shard.words)
            yield pa.RecordBatch.from_arrays([
                pa.array(words.hashes.view(np.int64)), pa.nulls(n, pa.int64()), pa.array(shard.langs, pa.string()),
                pa.array([w.decode() for w in shard.words], pa.string()), pa.array(words.count.astype(np.int64))], names)
            if depth > 1:
                pairs = made.deepen()
                n = len(pairs.count)
                both = [pa.array(x.view(np.int64)) for x in made.numbers(pairs.place, 2)]
                yield pa.RecordBatch.from_arrays([*both, pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.array(pairs.count.astype(np.int64))], names)
        release()

    counted = docs.mapInArrow(each, "a long, b long, lang string, word string, c long").repartition(partitions(docs.sparkSession), "a", "b")
    return counted.groupBy("a", "b", "lang", "word").agg(F.sum("c").alias("c")).where((F.col("c") >= least) | F.col("b").isNull())


def _deepened(shard: Shard, depth: int, seed: int, pairs: Filter, runs: Filter | None = None) -> SuffixAutomaton:
    """The shard's automaton of the runs whose words and pairs the first filter holds, and whose parts of
    three words and more, itself included, the second one does."""
    made = shard.automaton(seed)
    for k in range(1, depth + 1):
        if only := pairs if k < 3 else runs:
            made.prune(only)
        if k < depth:
            made.deepen()
    return made


def count_shared(docs: DataFrame, depth: int, pairs: Broadcast, n: int, least: int, size: int, seed: int) -> Filter:
    """The filter of the runs of three words and more whose counters, of n (a power of 2), reach least.

    A run adds its count to the counter that its hash names, so a counter is never less than any run's count.
    """
    ranges = min(RANGES, n)
    width = n // ranges

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, size):
            levels = _deepened(shard, depth, seed, pairs.value).levels[2:]
            own = (np.concatenate([lv.hashes for lv in levels]) & np.uint64(n - 1)).astype(np.int64)
            order = np.argsort(own)
            own, times = own[order], np.concatenate([lv.count for lv in levels])[order].astype(np.int64)
            begin = np.flatnonzero(np.diff(own, prepend=-1))
            own, times = own[begin], np.minimum(np.add.reduceat(times, begin), least) if len(begin) else times
            begin = np.flatnonzero(np.diff(own // width, prepend=-1))
            ends = np.append(begin, len(own)).astype(np.int64)
            for lo in range(0, len(begin), 64):
                part = ends[lo : lo + 65]
                inside, offsets = slice(part[0], part[-1]), pa.array((part - part[0]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    pa.array(own[part[:-1]] // width), pa.ListArray.from_arrays(offsets, pa.array((own[inside] % width).astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(times[inside].astype(np.int32)))], ["range", "at", "c"])
        release()

    def reached(number: int, total: np.ndarray) -> pa.RecordBatch:
        at = number * width + np.flatnonzero(total >= least)
        return pa.RecordBatch.from_arrays([pa.array(at)], ["h"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = None, np.zeros(width, np.int64)
        for batch in batches:
            for j, found in enumerate(batch["range"].to_pylist()):
                if found != number:
                    if number is not None:
                        yield reached(number, total)
                    number, total = found, np.zeros(width, np.int64)
                total[batch["at"][j].values.to_numpy()] += batch["c"][j].values.to_numpy()  # a row has a counter once
        if number is not None:
            yield reached(number, total)

    counters = docs.mapInArrow(each, "range long, at array<int>, c array<int>").repartition(partitions(docs.sparkSession), "range")
    return Filter(_bits(counters.sortWithinPartitions("range").mapInArrow(summed, "h long"), n, 1))


def _merged(ids: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of ids, and the sums of their times."""
    names, inverse = np.unique(ids.view(np.dtype((np.void, 8 * ids.shape[1]))).ravel(), return_inverse=True)
    total = np.zeros(len(names), np.int64)
    np.add.at(total, inverse, times)
    return names.view(np.int64).reshape(-1, ids.shape[1]), total


def _counted(docs: DataFrame, depth: int, pairs: Broadcast, runs: Broadcast, size: int, seed: int) -> DataFrame:
    """(ids, c): the runs of three words and more that pass the filters, by their words' numbers, as each task counts them."""

    def told(held: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for m, (ids, times) in held.items():
            for lo in range(0, len(times), 100_000):
                own, c = ids[lo : lo + 100_000], times[lo : lo + 100_000]
                ends = pa.array(np.arange(0, own.size + 1, m, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(own.ravel())), pa.array(c)], ["ids", "c"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for shard in shards(batches, size):
            made = _deepened(shard, depth, seed, pairs.value, runs.value)
            for most, fewest, place, times in made.states():
                for m in range(3, most + 1):  # all runs of a state
                    own = fewest <= m
                    ids = np.stack(made.numbers(place[own], m), axis=1).view(np.int64)
                    before = held.get(m, (ids[:0], times[:0]))
                    held[m] = _merged(np.concatenate([before[0], ids]), np.concatenate([before[1], times[own]]))
            if sum(len(c) for _, c in held.values()) > HELD:
                yield from told(held)
                held = {}
        yield from told(held)
        release()

    return docs.mapInArrow(each, "ids array<long>, c long")


def _longer(counted: DataFrame, shortest: int, longest: int, least: int) -> DataFrame:
    """(ids, c): the runs of these lengths that all tasks together count at least so often."""
    rows = counted.where(F.size("ids").between(shortest, longest)).repartition(partitions(counted.sparkSession), "ids")
    return rows.groupBy("ids").agg(F.sum("c").alias("c")).where(F.col("c") >= least)


def _bits(hashed: DataFrame, bits: int, probes: int) -> np.ndarray:
    """The words of the filter that has the hashes (h). At most MAX_BITS bits come to the driver."""
    marks = " | ".join(["shiftleft(1L, cast(h & 63 as int))", *(f"shiftleft(1L, cast(shiftright(h, {64 - 6 * k}) & 63 as int))" for k in range(1, probes))])
    got = hashed.groupBy(F.shiftright(F.col("h").bitwiseAND(F.lit(bits - 1)), 6).alias("i")).agg(F.bit_or(F.expr(marks)).alias("w")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[got["i"].to_numpy()] = got["w"].to_numpy().view(np.uint64)
    return words


def make_filter(runs: DataFrame) -> Filter:
    """The filter of the runs (ids)."""
    n = runs.count()
    bits = min(MAX_BITS, max(1 << 16, 1 << (16 * n - 1).bit_length() if n else 0))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = batch["ids"].flatten().to_numpy().view(np.uint64), batch["ids"].value_lengths().to_numpy()
            begin = np.cumsum(sizes) - sizes
            for m in np.unique(sizes):
                h = run_hashes([ids[begin[sizes == m] + k] for k in range(m)])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    hashed = runs.select("ids").mapInArrow(each, "h long")
    return Filter(_bits(hashed, bits, PROBES), PROBES)


def _named(runs: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, c) of runs (ids, c). A frequent word is in many of them: it is dealt to the salts that ask for it."""
    parts = runs.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS))).select("ids", "c", "salt", F.posexplode("ids").alias("i", "a"))
    asked = parts.select("a", "salt").distinct().join(words.select("a", "lang", "word"), "a")
    told = parts.join(asked, ["a", "salt"]).groupBy("ids", "c").agg(F.sort_array(F.collect_list(F.struct("i", "word", "lang"))).alias("w"))
    return told.select(F.col("w")[0]["lang"].alias("lang"), F.array_join(F.col("w.word"), " ").alias("phrase"), "c")


def count_runs(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, size: int = SHARD) -> DataFrame:
    """(lang, phrase, c) of all runs of up to depth words (space-joined) that are held at least so often
    in texts of a language, and with an empty phrase the number of all words of each language."""
    docs = docs.select("text", F.col("lang").cast("string").alias("lang"))
    send = docs.sparkSession.sparkContext.broadcast
    for seed in count():
        first = cut(_words_and_pairs(docs, depth, least, size, seed))
        every = first.where("b is null")
        if every.groupBy("a").count().where("count > 1").isEmpty():  # else two words have one number
            break
    words = every.where(F.col("c") >= least)
    runs = first.where("b is not null").select(F.array("a", "b").alias("ids"), "c")
    if depth > 2:
        pairs = send(make_filter(words.select(F.array("a").alias("ids")).unionByName(runs.select("ids"))))
        n = every.agg(F.sum("c")).first()[0] or 0
        shared = min(MAX_BITS, max(1 << 16, 1 << (n // SHARED).bit_length()))
        may = send(count_shared(docs, depth, pairs, shared, least, size, seed))
        # few tasks, as each reports the frequent runs once
        tasks = max(TASKS * docs.sparkSession.sparkContext.defaultParallelism, n // READ)
        counted = cut(_counted(docs.coalesce(tasks), depth, pairs, may, size, seed))
        for shortest, longest in ((3, 3), (4, depth)):
            if depth >= shortest:
                runs = runs.unionByName(cut(_longer(counted, shortest, longest, least)))
    totals = every.groupBy("lang").agg(F.sum("c").alias("c")).select("lang", F.lit("").alias("phrase"), "c")
    return words.select("lang", F.col("word").alias("phrase"), "c").unionByName(_named(runs, words)).unionByName(totals)


def collocations(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, top: int = TOP, size: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases. a, l and r are the counts
    of the phrase and of the two parts of its lowest-scoring cut, n is the language's number of words."""
    runs = cut(count_runs(docs, depth, least, size))
    words = F.size(F.split("phrase", " "))
    counted = runs.where("phrase <> ''").withColumn("m", words)
    phrases = counted.where("m >= 2")
    # the suffix link, and the link to the prefix, of every phrase that has them
    shorter = F.explode(F.array(F.expr("substring_index(phrase, ' ', 1 - m)"), F.expr("substring_index(phrase, ' ', m - 1)")))
    longer = phrases.where("m >= 3").select("lang", shorter.alias("phrase"), "c").groupBy("lang", "phrase").agg(F.max("c").alias("most"))
    kept = cut(phrases.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < 100 * F.col("c"))).select("lang", "phrase", "m", F.col("c").alias("a")))
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("left"), F.expr("substring_index(phrase, ' ', k - m)").alias("right"))
    cuts = cuts.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))

    def with_count(rows: DataFrame, part: str, out: str) -> DataFrame:
        """A frequent word is a part of many phrases: its count is dealt to the salts that ask for it."""
        asked = rows.select("lang", F.col(part).alias("phrase"), "salt").distinct().join(counted.select("lang", "phrase", F.col("c").alias(out)), ["lang", "phrase"])
        return rows.join(asked.withColumnRenamed("phrase", part), ["lang", part, "salt"])

    cuts = with_count(with_count(cuts, "left", "l"), "right", "r")
    totals = runs.where("phrase = ''").select("lang", F.col("c").alias("n"))
    cuts = cuts.join(_dealt(totals), ["lang", "salt"])
    number = lambda c: F.col(c).cast("decimal(18,0)")
    wide = cuts.withColumns({"above": F.lit(1000).cast("decimal(4,0)") * number("a"), "below": number("l") * number("r")})
    scored = wide.withColumn("score", F.expr("(above * cast(n as decimal(16,0))) div below"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n", "salt")).alias("b"))
    rows = best.select("lang", "phrase", "b.*")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    near = rows.withColumn("i", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("i") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _dealt(rows: DataFrame) -> DataFrame:
    """Each row once per salt."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def op12_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by language."""
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS piece_of, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, m, array_to_string(w[i + 1:i + m], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(0, len(w) - m + 1)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a FROM f WHERE m >= 2 AND f >= 100),
kept AS (SELECT * FROM c WHERE NOT EXISTS (FROM c AS q WHERE q.lang = c.lang AND q.m > c.m AND contains(' ' || q.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * q.a >= 100 * c.a)),
k AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM kept),
s AS (SELECT k.lang, k.phrase, k.a, x.f AS l, y.f AS r, n, k.k, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1:], ' ') JOIN n ON n.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM r WHERE rank <= 2000
"""
