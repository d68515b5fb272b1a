"""Benchmark decontamination by a prefix-filtered set join (native).

A window is WINDOW consecutive words of an item, or a shorter item as a whole. It is the set of its
shingles of SHINGLE words with their places (of a shorter item, the item itself is the only one).
A document contains a window only if it contains all of its shingles, so any one of them is a
necessary prefix; the rarest in the corpus is taken.

1. The items' shingles are met with the documents' shingles, on a hash and then on the words; what
   meets is (document, place, shingle). It is counted, and windows with a shingle that no document has go.
2. Places of a window's rarest shingle propose where the window begins; the document's ends bound it.
3. A candidate stands if the document has the window's first and last shingle where it must. Windows
   of up to twice SHINGLE words are covered by the two, so this is the exact test of all words.

Defined results:
- A null or empty text has no words: a document without hits, an item without windows. Only items
  with a window that occurs are counted; items that share a text each are.
- doc_id and item_id may be null or repeat: documents are told apart by doc_id and text, and each row
  gets its own; a null item_id is left out; an item_id with several texts has the windows of all.
- A very long text is one row throughout; its words are handled one place at a time.
- Empty tables: without documents no rows, without items no hits. Columns other than doc_id, item_id
  and text are ignored, whatever their names.

The items' shingles are broadcast only up to SMALL of them, by count; beyond that both sides are
shuffled by the shingle's hash, and the words of a shingle go along with each place. Nothing else is
broadcast on purpose. Frequent shingles are salted by place in the joins that are dealt by shingle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, partitions, repeated, table

WINDOW = 10
SHINGLE = 5
#: Shingles that are broadcast at most: about 60 MB of words.
SMALL = 500_000
#: Salts of what is dealt by shingle.
SALTS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case: maximal runs of digits, letters and all that is not ASCII."""
    text = F.coalesce(text, F.lit(""))
    # in a text of ASCII alone, lower() changes A-Z and nothing else, and is much faster
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, BREAK), "")


def _name(*parts: Column) -> Column:
    """128 bits of SHA-256 that stand for parts."""
    return F.substring(F.unhex(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)), 1, 16)


def _parts(words: str, size: Column | int) -> Column:
    """array<struct<at, part>>: all runs of size words and where they begin."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.struct(i.alias("at"), F.slice(words, i + 1, size).alias("part")))


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(wid, n, items, parts): each different window once, its number of words, the item_ids that have
    it and its shingles as array<struct<at, sid, part>>."""
    words = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    each = words.select("item_id", F.explode(_parts("words", F.least(F.lit(window), F.size("words")))).alias("w")).select("item_id", F.col("w.part").alias("words"))
    own = each.groupBy("words").agg(F.collect_set("item_id").alias("items"))
    named = lambda x: F.struct(x["at"].alias("at"), _name(F.array_join(x["part"], " ")).alias("sid"), x["part"].alias("part"))
    parts = F.transform(_parts("words", F.least(F.lit(shingle), F.size("words"))), named)
    return own.select(_name(F.array_join("words", " ")).alias("wid"), F.size("words").alias("n"), "items", parts.alias("parts"))


def _hash(words: str, size: int) -> Column:
    """Per place of words, a hash of the size words from there on."""
    at = lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(size)))
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), at))


def meet(docs: DataFrame, shingles: DataFrame, small: int = SMALL) -> DataFrame:
    """(key, n_words, at, sid): the places of docs (key, words) at which shingles (sid, part) stand."""
    sizes = {r["size"]: r["n"] for r in shingles.groupBy(F.size("part").alias("size")).agg(F.count("*").alias("n")).collect()}  # a row per length of shingles
    found = None
    for size, n in sorted(sizes.items()):
        hashed = F.xxhash64(*(F.get("part", F.lit(j)) for j in range(size)))
        wanted = shingles.where(F.size("part") == size).select("sid", "part", hashed.alias("h"))
        rows = docs.select("key", "words", F.size("words").alias("n_words"), F.posexplode(_hash("words", size)).alias("at", "h"))
        own = F.slice("words", F.col("at") + 1, F.lit(size))
        if n <= small:
            wanted = F.broadcast(wanted)
        else:
            rows, own = rows.withColumn("own", own).drop("words"), F.col("own")
        met = rows.join(wanted, (rows["h"] == wanted["h"]) & (own == F.col("part"))).select("key", "n_words", "at", "sid")
        found = met if found is None else found.unionByName(met)
    if found is None:
        found = docs.select("key", F.lit(0).alias("n_words"), F.lit(0).alias("at"), F.col("key").alias("sid")).where(F.lit(False))
    return found


def occurrences(met: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, start, stop, items): where the windows stand. met (key, n_words, at, sid) is read more than
    once, so it should be a table."""
    counts = met.groupBy("sid").agg(F.count("*").alias("c"))
    each = windows.select("wid", "n", F.inline("parts")).select("wid", "n", "at", "sid").join(counts, "sid", "left")
    rank = F.struct(F.col("c"), F.col("sid"), F.col("at"))
    # a window with a shingle of no document goes: c is null there
    prefix = each.groupBy("wid").agg(F.min(rank).alias("rarest"), F.count_if(F.col("c").isNull()).alias("absent")).where("absent = 0")
    first, last = F.col("parts")[0], F.element_at("parts", -1)
    keyed = windows.select("wid", "n", "items", first["sid"].alias("first"), last["sid"].alias("last"), last["at"].alias("last_at")).join(prefix, "wid")
    keyed = keyed.select("n", "items", "first", "last", "last_at", F.col("rarest.sid").alias("sid"), F.col("rarest.at").alias("off"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = met.withColumn("salt", F.pmod(F.xxhash64("key", "at"), F.lit(SALTS)).cast("int"))
    begun = salted.join(keyed, ["sid", "salt"]).withColumn("start", F.col("at") - F.col("off"))
    begun = begun.where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words")))
    begun = begun.select("key", "start", (F.col("start") + F.col("n")).alias("stop"), (F.col("start") + F.col("last_at")).alias("end_at"), "first", "last", "items")
    places = met.select("key", "at", "sid").distinct()
    there = lambda at, sid: places.select("key", F.col("at").alias(at), F.col("sid").alias(sid))
    stands = begun.join(there("start", "first"), ["key", "start", "first"], "left_semi").join(there("end_at", "last"), ["key", "end_at", "last"], "left_semi")
    return stands.select("key", "start", "stop", "items")


def hits(found: DataFrame) -> DataFrame:
    """(key, n_hit, items) of occurrences: words inside any of them, and the sorted item_ids."""
    per = found.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("s"), F.collect_set("items").alias("i"))
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop"))
    cover = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(a["stop"], x["start"]))).alias("n"), F.greatest(a["stop"], x["stop"]).alias("stop"))
    return per.select("key", F.aggregate("s", begin, cover)["n"].cast("long").alias("n_hit"), F.sort_array(F.array_distinct(F.flatten("i"))).alias("items"))


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, small: int = SMALL) -> DataFrame:
    """doc_id, n_words, n_hit and items (item_ids with occurring windows) of every row of docs."""
    if shingle > window or window > 2 * shingle:
        raise ValueError("a window must have at least as many words as a shingle and at most twice as many")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    key = _name(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")))
    texts = rows.select(key.alias("key"), words_of(F.col("text")).alias("words"))
    windows = cut(item_windows(items, window, shingle))
    shingles = cut(windows.select(F.inline("parts")).groupBy("sid").agg(F.first("part").alias("part")))
    found = hits(occurrences(cut(meet(texts, shingles, small)), windows))
    counted = rows.select(key.alias("key"), "doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    counted = counted.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count("*").alias("copies"))
    each = repeated(counted.join(found, "key", "left"), F.col("copies"), "copy")
    none = F.expr("cast(array() as array<string>)")
    return each.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"))


def op13_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all items."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP13_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS k, array_to_string(w[i + 1:i + least({WINDOW}, len(w))], ' ') AS s
       FROM (SELECT *, unnest(range(0, len(w) - least({WINDOW}, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i + 1:i + k], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, dw.k, i FROM dw JOIN bw USING (k, s)),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
