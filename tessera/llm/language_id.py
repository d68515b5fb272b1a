"""Language identification by nearest centroid.

A text is a vector of letter n-grams hashed into DIMENSIONS buckets, weighted by TF-IDF and
normalised. Each language has several centroids, found by spherical k-means over a bounded sample
of its labelled texts; document frequencies are counted over all training texts. A text gets the
language of the centroid with the greatest cosine, and is rejected if it is further away than
nearly all training texts of its length are from theirs. These distance limits come from a second
pass over all training texts, as cosines counted in bins.

Every label is learned. The centroids are a table, read in blocks of about BLOCK languages: a task
holds one block at a time, and with more than one the documents pass once for each and carry the
best language so far.

Defined results: a text that is null or has no letter is `und` with score 0, and rejected; with
nothing to learn from, every text is `und`; ties go to the language that sorts first; repeated
rows each get a row; a null doc_id is not held out, and its text may teach; a very long text is read
whole, as a batch of its own; an empty table gives an empty result. The results named lang_pred,
score and rejected take the place of input columns of these names, in whatever case; all other
columns are kept, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, release, table

DIMENSIONS = 4096
#: Letters in an n-gram, word boundaries counted as letters.
GRAMS = (1, 2, 3)
#: Centroids of a language, and the most training texts (in expectation) that they are fitted on.
CENTROIDS = 4
SAMPLE = 1500
#: Languages (in expectation) whose centroids a task holds at a time.
BLOCK = 1000
#: Bytes that the sizes of the languages with more than SAMPLE texts may have to be broadcast.
BROADCAST_SIZES = 4 << 20
#: Lengths in n-grams that part the bands with a distance limit of their own.
BANDS = (16, 32, 64, 128, 256, 1024)
#: The limit is the cosine that all but this share of the band's training texts reach, times MARGIN.
QUANTILE = 0.01
MARGIN = 0.5
#: Bins that cosines are counted in, and texts that a language's band needs for a limit of its own.
BINS = 1000
ENOUGH = 100

_LETTER = np.zeros(0x3000, bool)
_LETTER[[i for i in range(0x3000) if chr(i).isalpha()]] = True


def gram_counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed n-grams, a row per text, whatever texts are beside it."""
    joined = "".join("\n" + t.lower().replace("\n", " ") for t in texts)
    c = np.frombuffer((joined + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    doc = np.cumsum(c == 10) - 1  # the border before a text is its own
    letter = (c >= 0x3000) | _LETTER[np.minimum(c, 0x2FFF).astype(np.int64)]
    c = np.where(letter, c, 0)
    out = np.zeros(len(texts) * DIMENSIONS)
    letter = c > 0
    size = len(c)
    h = np.zeros(size, np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = (h[: size - n + 1] + c[n - 1 :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        # a single letter, a pair with a letter, a triple around a letter
        use = letter if n == 1 else letter[:-1] | letter[1:] if n == 2 else letter[1 : size - n + 2]
        if n in GRAMS and len(h):
            out += np.bincount(doc[: len(h)][use] * DIMENSIONS + (h[use] % np.uint64(DIMENSIONS)).astype(np.int64), minlength=len(out))
    return out.reshape(len(texts), DIMENSIONS).astype(np.float32)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def centroids(v: np.ndarray, k: int = CENTROIDS, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from the first text and then, each time, the one least covered."""
    chosen = [0]
    for _ in range(min(k, len(v)) - 1):
        chosen.append(int(np.argmin((v @ v[chosen].T).max(axis=1))))
    c = v[chosen]
    for _ in range(rounds):
        near = (v @ c.T).argmax(axis=1)
        c = np.stack([v[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _batches(frames: Iterator[pd.DataFrame], column: str = "text", chars: int = 1 << 20, rows: int = 256):
    """Slices of the frames with a bounded number of rows and, but for single long texts, characters."""
    for frame in frames:
        sizes = frame[column].str.len().fillna(0).to_numpy()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and (total + n > chars or i - start >= rows):
                yield frame.iloc[start:i]
                start, total = i, 0
            total += n
        if start < len(frame):
            yield frame.iloc[start:]


def _released(frames: Iterator[pd.DataFrame], task) -> Iterator[pd.DataFrame]:
    """What task makes of the frames; then the worker gives back what it has freed."""
    yield from task(frames)
    release()


def has_letter(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))


@dataclass
class Model:
    """Document frequencies' weights and a table of centroids (lang, c) and one of limits (lang, bands)."""

    idf: np.ndarray | None = None
    blocks: int = 0
    parts: DataFrame | None = None
    limits: DataFrame | None = None

    def centroids(self, block: int) -> dict[str, np.ndarray]:
        """The centroids of a block's languages, by language."""
        rows = self.parts.where(self.inside(block)).collect()
        return {r["lang"]: np.frombuffer(r["c"], "<f4").reshape(-1, DIMENSIONS) for r in sorted(rows, key=lambda r: r["lang"])}

    def block(self, block: int) -> dict:
        """What a task needs to score texts by the block's languages, a row per centroid."""
        parts = self.centroids(block)
        overall, *_ = [_by_band(r) for r in self.limits.where("lang IS NULL").collect()]
        bands = {r["lang"]: _by_band(r) for r in self.limits.where(F.col("lang").isNotNull() & self.inside(block)).collect()}

        def limit(lang: str, band: int) -> float:
            some = [x for x in (bands[lang].get(band), overall.get(band), bands[lang].get(-1), overall.get(-1)) if x]
            return next((y for n, y in some if n >= ENOUGH), some[-1][1])

        return {
            "langs": [lang for lang, c in parts.items() for _ in c], "idf": self.idf,
            "centroids": np.concatenate([*parts.values()]) if parts else np.zeros((0, DIMENSIONS), np.float32),
            "limits": np.array([[limit(lang, b) for b in range(len(BANDS) + 1)] for lang, c in parts.items() for _ in c]),
        }

    def inside(self, block: int) -> Column:
        return F.pmod(F.xxhash64("lang"), F.lit(self.blocks)) == block if self.blocks > 1 else F.lit(True)


def _by_band(row) -> dict[int, tuple[int, float]]:
    return {x["band"]: (x["n"], x["limit"]) for x in row["bands"]}


def fit(training: DataFrame) -> Model:
    """The model of training (key, text, lang; no nulls in text and lang).

    The key only helps to decide which texts are in the sample. Gathered on the driver: document
    frequencies (DIMENSIONS numbers) and, of one block at a time, centroids and distance limits.
    Only the centroids are fitted on the sample.
    """
    training = training.where(has_letter(F.col("text")))
    sizes = cut(training.groupBy("lang").agg(F.count("*").alias("n")))
    languages = sizes.count()
    if not languages:
        return Model()
    large = sizes.where(F.col("n") > SAMPLE).select("lang", (SAMPLE / F.col("n")).alias("share"))
    if (large.agg(F.sum(F.octet_length("lang") + 16).alias("n")).first()["n"] or 0) <= BROADCAST_SIZES:
        large = F.broadcast(large)
    # the row's place counts, too: rows that share a key, or are the same, enter one by one
    uniform = F.pmod(F.xxhash64("key", "text", F.monotonically_increasing_id()), F.lit(1_000_000)) / 1_000_000.0
    marked = training.select("text", "lang", uniform.alias("u")).join(large, "lang", "left")
    marked = marked.select("text", "lang", (F.col("u") < F.coalesce("share", F.lit(1.0))).alias("sampled"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(DIMENSIONS, np.int64), 0
        for part in _batches(frames):
            counts = gram_counts(part["text"].tolist())
            df += (counts > 0).sum(axis=0)
            n += len(part)
            own = part["sampled"].to_numpy()
            if own.any():
                yield pd.DataFrame({"lang": part["lang"].to_numpy()[own], "n": 1, "v": [x.tobytes() for x in counts[own].astype("<f4")]})
        yield pd.DataFrame({"lang": [None], "n": [n], "v": [df.astype("<i8").tobytes()]})

    rows = cut(marked.mapInPandas(partial(_released, task=count), "lang string, n long, v binary"))

    def total(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(DIMENSIONS, np.int64), 0
        for frame in frames:
            for one, x in zip(frame["n"], frame["v"], strict=True):
                df += np.frombuffer(x, "<i8")
                n += one
        yield pd.DataFrame({"n": [n], "v": [df.tobytes()]})

    sums = rows.where(F.col("lang").isNull()).select("n", "v")
    df, n = np.zeros(DIMENSIONS, np.int64), 0
    for r in sums.repartition(16).mapInPandas(total, "n long, v binary").collect():
        df, n = df + np.frombuffer(r["v"], "<i8"), n + r["n"]
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        counts = np.stack([np.frombuffer(x, "<f4") for x in sorted(frame["v"])])
        found = centroids(weighted(counts, idf)).astype("<f4").tobytes()
        del counts
        release()
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "c": [found]})

    sampled = rows.where(F.col("lang").isNotNull()).select("lang", "v")
    model = Model(idf, -(-languages // BLOCK), cut(sampled.groupBy("lang").applyInPandas(cluster, "lang string, c binary")))
    model.limits = distance_limits(training, model)
    return model


def distance_limits(training: DataFrame, model: Model) -> DataFrame:
    """(lang, bands): of each language and, as null, of all, the texts and the least cosine of each
    band, by all training texts; band -1 is any length. At most eight bands a language.

    A band with fewer than ENOUGH texts has the limit of all languages' texts of the band; where
    these are too few as well, of the language's texts of any length, then of all texts.
    """

    def measure(frames: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
        idf, parts = shared.value
        seen: Counter = Counter()
        for part in _batches(frames):
            counts, lang = gram_counts(part["text"].tolist()), part["lang"].to_numpy()
            v, band = weighted(counts, idf), np.searchsorted(BANDS, counts.sum(axis=1))
            for name in set(lang) & parts.keys():
                own = lang == name
                bins = np.clip((v[own] @ parts[name].T).max(axis=1) * BINS, 0, BINS - 1).astype(int)
                seen.update(zip([name] * len(bins), band[own].tolist(), bins.tolist(), strict=True))
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["lang", "band", "bin", "n"])

    counted = []
    for block in range(model.blocks):
        shared = training.sparkSession.sparkContext.broadcast((model.idf, model.centroids(block)))
        own = training.where(model.inside(block)).select("text", "lang")
        counted.append(own.mapInPandas(partial(_released, task=partial(measure, shared=shared)), "lang string, band int, bin int, n long").groupBy("lang", "band", "bin").agg(F.sum("n").alias("n")))
        if model.blocks > 1:
            counted[-1] = cut(counted[-1])
            shared.unpersist()
    binned = reduce(DataFrame.unionByName, counted)
    # null stands for all languages, -1 for any length
    scopes = F.array(*(F.struct(lang.alias("lang"), band.alias("band")) for lang in (F.col("lang"), F.lit(None).cast("string")) for band in (F.col("band"), F.lit(-1))))
    summed = binned.select(F.explode(scopes).alias("s"), "bin", "n").groupBy("s", "bin").agg(F.sum("n").alias("n"))
    summed = summed.groupBy("s").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"))

    def step(acc, x):
        below = acc["below"] + x["n"]
        return F.struct(below.alias("below"), F.when((acc["bin"] < 0) & (below > F.col("n") * QUANTILE), x["bin"]).otherwise(acc["bin"]).alias("bin"))

    least = F.aggregate("bins", F.struct(F.lit(0).cast("long").alias("below"), F.lit(-1).alias("bin")), step)["bin"]
    found = summed.select("s.lang", F.struct("s.band", "n", (least / BINS * MARGIN).alias("limit")).alias("x"))
    return cut(found.groupBy("lang").agg(F.collect_list("x").alias("bands")))


def predict(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """docs, without the text unless it is to be kept, with lang_pred, score and rejected; only
    the column text is an input."""
    results = ("lang_pred", "score", "rejected")
    rest = [c for c in docs.columns if (keep_text or c != "text") and c.lower() not in results]
    letter = "_letter"
    while letter in {c.lower() for c in docs.columns}:
        letter += "_"

    def nearest(frames: Iterator[pd.DataFrame], shared, kept: list[str], first: bool, last: bool) -> Iterator[pd.DataFrame]:
        m = shared.value
        names = np.array(m["langs"], object)
        for part in _batches(frames):
            if first:
                pred, score, rejected = np.full(len(part), None, object), np.zeros(len(part)), np.ones(len(part), bool)
            else:
                pred, score, rejected = (part[c].to_numpy(copy=True) for c in results)
            own = np.flatnonzero(part[letter].to_numpy())
            if len(own) and len(names):
                counts = gram_counts(part["text"].iloc[own].tolist())
                cosine = weighted(counts, m["idf"]) @ m["centroids"].T
                at, found = cosine.argmax(axis=1), np.clip(cosine.max(axis=1), 0, 1).astype(float)
                far = found < m["limits"][at, np.searchsorted(BANDS, counts.sum(axis=1))]
                better = [pred[i] is None or (-x, names[j]) < (-score[i], pred[i]) for i, j, x in zip(own, at, found)]
                own, at, found, far = own[better], at[better], found[better], far[better]
                pred[own], score[own], rejected[own] = names[at], found, far
            if last:
                pred[pd.isna(pred)] = "und"
            yield part[kept].assign(lang_pred=pred, score=score, rejected=rejected)

    docs = docs.select(*(c for c in docs.columns if c == "text" or c in rest)).withColumn(letter, has_letter(F.col("text")))
    blocks = max(model.blocks, 1)
    for block in range(blocks):
        last = block == blocks - 1
        kept = rest if last else [*(c for c in docs.columns if c not in results)]
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
        shared = docs.sparkSession.sparkContext.broadcast(model.block(block) if model.blocks else {"langs": []})
        task = partial(nearest, shared=shared, kept=kept, first=block == 0, last=last)
        docs = docs.mapInPandas(partial(_released, task=task), f"{kinds}, lang_pred string, score double, rejected boolean")
        if not last:
            docs = cut(docs)
            shared.unpersist()
    return docs


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    return known.select(F.col("doc_id").cast("string").alias("key"), "text", "lang")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, by a model of the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(named, fit(training_rows(docs)))
