"""Quality rules with risk-controlled cutoffs (native).

Each rule is a statistic of a document, in whole thousandths. PATH has a cutoff of each rule for
every level, from the most lenient to the strictest; at a level, a document above any rule's cutoff
is rejected. Labelled holdouts choose the level, per stratum (language), among the documents that
pass the base rules: a level is certified if the exact binomial test refutes, at its level of
significance, that all rules together reject more than RISK of the good ones. Multiple testing is
corrected by Bonferroni over strata and by a fixed sequence within: levels are tested from the most
lenient on, up to the first that is not certified. So with probability 1 - ALPHA the rules reject
at most RISK of the good documents of every stratum, or pool, that the base rules let pass (what the
base rules themselves reject is not bounded). Of the certified levels, the one that separates the labels
best is taken, the more lenient one of equal ones, or none if none separates.

Every stratum with enough labels to refute anything (149 good ones with ALPHA to itself, 252 among
eight strata) is tested by its own. Strata with fewer than LEAST good labels, or too few for that, those
without labels too, are tested together as well, as one pool. A stratum takes the level of its own
certificate or, if it is in the pool, the pool's where that is stricter: there the bound holds for the
pool's good documents as a whole, not for each of its strata. But a stratum whose own labels speak
against the pool's level (more than RISK of its good ones would go) does not take it.

Defined results: a null text has no words; a null stratum is the empty one; documents without
labels, and labels without documents, don't count; a document with several labels counts as good
only if all say so; repeated rows each get a row, and count each where labelled; a very long text is
measured whole within its row; empty tables give an empty result; columns other than doc_id, text
and lang are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, split_words, table, whole

#: At most this share of a stratum's good documents that pass the base is rejected by all rules together.
RISK = 0.02
#: The probability that this fails in some stratum.
ALPHA = 0.05
#: Good labels below which a stratum is tested in the pool, too.
LEAST = 300
#: Words in a window whose repetition counts.
WINDOW = 8
#: Per rule the cutoffs of the levels, in thousandths; a level's cutoffs are one step on one path.
PATH = {
    "symbols_per_word": (900, 700, 500, 300, 200, 150, 100, 50),
    "upper_share": (900, 700, 500, 400, 300, 250, 200, 150),
    "dup_line_share": (900, 800, 700, 600, 500, 400, 300, 200),
    "repeat_share": (300, 280, 250, 220, 190, 160, 130, 100),
    "same_word_share": (980, 960, 930, 900, 870, 840, 800, 750),
}
RULES = tuple(PATH)


def _share(part: Column, of: Column) -> Column:
    return F.floor(part * 1000 / F.greatest(of, F.lit(1))).cast("long")


def repeated_words(df: DataFrame, words: str, out: str, size: int = WINDOW) -> DataFrame:
    """Add column out: words that lie in a window of size words found twice or more in the text.

    Windows are hashed to 64 bits; only texts with equal hashes sort theirs. All is within the
    row, so no text's windows are shuffled.
    """
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    at = lambda i: F.xxhash64(*(F.get(F.col("_wh"), i + j) for j in range(size)))
    windows = F.when(F.size(words) > size, F.transform(F.sequence(F.lit(0), F.size(words) - size), at)).otherwise(F.expr("cast(array() as array<bigint>)"))
    pairs = F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    some = F.size(F.array_distinct("_h")) < F.size("_h")
    none = F.expr("cast(array() as array<struct<h:bigint,i:int>>)")
    near = lambda x, j: F.get(F.col("_s"), j)["h"] == x["h"]
    twice = F.filter("_s", lambda x, i: F.coalesce(near(x, i - 1), F.lit(False)) | F.coalesce(near(x, i + 1), F.lit(False)))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    cover = lambda acc, i: F.struct((acc["n"] + i + size - F.greatest(acc["end"], i)).alias("n"), (i + size).alias("end"))
    return (
        df.withColumn("_wh", hashed)
        .withColumn("_h", windows)
        .withColumn("_s", F.when(some, F.sort_array(pairs)).otherwise(none))
        .withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"])))
        .withColumn(out, F.aggregate("_p", start, cover)["n"].cast("long"))
        .drop("_wh", "_h", "_s", "_p")
    )


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, the base counts and each rule's statistic of every document."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("stratum"), whole("text").alias("text"))
    rows = rows.withColumn("words", split_words(text)).withColumn("lines", F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))))
    rows = rows.select(
        "doc_id", "stratum", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.size("words") - F.size(F.array_distinct("words"))).cast("long").alias("n_same_words"),
    )
    rows = repeated_words(rows, "words", "n_repeat_words").drop("words")
    return rows.select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        _share(F.col("n_symbols"), F.col("n_words")).alias("symbols_per_word"),
        _share(F.col("n_upper"), F.col("word_chars")).alias("upper_share"),
        _share(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_share"),
        _share(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_share"),
        _share(F.col("n_same_words"), F.col("n_words")).alias("same_word_share"),
    )


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exactly, by the recurrence of its terms in logarithms; 1 where k >= n p,
    as such a count never speaks against the rate p."""
    odds = F.log(F.lit(p / (1 - p)))
    first = n * F.log(F.lit(1 - p))
    start = F.struct(first.alias("t"), first.alias("s"))

    def step(acc, i):
        t = acc["t"] + F.log((n - i + 1) / i) + odds
        return F.struct(t.alias("t"), (F.greatest(acc["s"], t) + F.log1p(F.exp(-F.abs(acc["s"] - t)))).alias("s"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.expr("cast(array() as array<bigint>)"))
    return F.when(k < n * p, F.exp(F.aggregate(terms, start, step)["s"])).otherwise(F.lit(1.0))


def first_level(path: dict[str, tuple[int, ...]]) -> Column:
    """The first level that rejects a document; the number of levels if none does."""
    allowed = lambda rule, grid: F.size(F.filter(F.array(*map(F.lit, grid)), lambda c: c >= F.col(rule)))
    passed = [allowed(rule, grid) for rule, grid in path.items()]
    return F.least(*passed) if len(passed) > 1 else passed[0]


def choose_levels(measured: DataFrame, labels: DataFrame, path: dict[str, tuple[int, ...]] = PATH, risk: float = RISK, alpha: float = ALPHA, least: int = LEAST) -> DataFrame:
    """(stratum, level): the level of each stratum of measured that has one.

    Labelled documents are reduced to counts per stratum and level before anything else. The
    groups tested are single strata, named with a `=`, and the pool, `*`.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    seen = cut(measured.join(good, "doc_id").where(F.col("quality").isNotNull() & ~F.col("base_failed")).select("stratum", "quality", first_level(path).alias("first")).groupBy("stratum", "quality", "first").agg(F.count("*").alias("c")))
    sums = lambda q, when=F.lit(True): F.coalesce(F.sum(F.when((F.col("quality") == q) & when, F.col("c"))), F.lit(0))
    levels = len(next(iter(path.values())))
    tried = F.array(*(F.struct(F.lit(i).alias("level"), sums(1, F.col("first") <= i).alias("k"), sums(0, F.col("first") <= i).alias("b")) for i in range(levels)))
    strata = measured.select("stratum").distinct().join(seen, "stratum", "left").groupBy("stratum")
    strata = cut(strata.agg(sums(1).alias("n"), sums(0).alias("m"), tried.alias("t"), (F.count("quality") > 0).alias("labelled")))
    alone = F.pow(F.lit(1 - risk), F.col("n")) <= F.lit(alpha / max(1, strata.where("labelled").count()))
    groups = F.array_compact(F.array(F.when(alone, F.concat(F.lit("="), "stratum")), F.when((F.col("n") < least) | ~alone, F.lit("*"))))
    own = cut(strata.withColumn("group", F.explode(groups)).select("stratum", "group", "labelled", "n", "m", F.inline("t")))
    level = alpha / max(1, own.where("labelled").select("group").distinct().count())
    tests = own.groupBy("group", "level").agg(*(F.sum(c).alias(c) for c in ("n", "m", "k", "b")))
    lenient_first = Window.partitionBy("group").orderBy("level")
    sure = F.max(binomial_tail(F.col("k"), F.col("n"), risk)).over(lenient_first) <= F.lit(level)
    # b/m - k/n, compared in whole numbers
    gain = F.col("b") * F.col("n") - F.col("k") * F.col("m")
    best = F.max(F.struct(gain.alias("gain"), (-F.col("level")).alias("less")))
    chosen = tests.withColumn("sure", sure).where("sure").groupBy("group").agg(best.alias("best")).where("best.gain > 0").select("group", (-F.col("best.less")).alias("level"))
    fits = (F.col("group") != "*") | (F.col("k") <= F.col("n") * F.lit(risk))
    return cut(own.join(chosen, ["group", "level"]).where(fits).groupBy("stratum").agg(F.max("level").alias("level")))


def apply_levels(measured: DataFrame, chosen: DataFrame, path: dict[str, tuple[int, ...]] = PATH) -> DataFrame:
    """measured with level, rejected_by (rules above their cutoff) and kept."""
    rows = measured.join(chosen, "stratum", "left")
    above = F.array_compact(F.array(*(F.when(F.col(rule) > F.get(F.array(*map(F.lit, grid)), F.col("level")), F.lit(rule)) for rule, grid in path.items())))
    return rows.withColumn("rejected_by", F.array_join(above, ",")).withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == ""))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the level chosen by all labels, by language or for the pool of small ones."""
    measured = cut(measure(table(spark, sf_dir, "documents")))
    return apply_levels(measured, choose_levels(measured, table(spark, sf_dir, "labels"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def _oracle() -> str:
    shares = {
        "symbols_per_word": ("n_symbols", "n_words"), "upper_share": ("n_upper", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"),
        "repeat_share": ("n_repeat_words", "n_words"), "same_word_share": ("n_same_words", "n_words"),
    }
    stats = ", ".join(f"(1000 * {a}) // greatest({b}, 1) AS {r}" for r, (a, b) in shares.items())
    first = ", ".join(f"len(list_filter({list(grid)}, lambda c: c >= {r}))" for r, grid in PATH.items())
    above = ", ".join(f"CASE WHEN {r} > ({list(grid)})[level + 1] THEN '{r}' END" for r, grid in PATH.items())
    levels = len(PATH[RULES[0]])
    p = RISK
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
w AS (SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS s
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d)),
twice AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM twice) GROUP BY doc_id),
c AS (SELECT doc_id, stratum, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_upper,
             len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             (len(words) - len(list_distinct(words)))::BIGINT AS n_same_words, coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN covered USING (doc_id)),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {stats} FROM c),
g AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id),
x AS (SELECT stratum, quality, least({first}) AS first FROM m JOIN g USING (doc_id) WHERE quality IS NOT NULL AND NOT base_failed),
own AS (SELECT stratum, level, count(quality) > 0 AS labelled,
               count(*) FILTER (quality = 1 AND first <= level) AS k, count(*) FILTER (quality = 0 AND first <= level) AS b,
               count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 0) AS m
        FROM (SELECT DISTINCT stratum FROM m) LEFT JOIN x USING (stratum) CROSS JOIN (SELECT unnest(range({levels})) AS level) GROUP BY ALL),
sized AS (SELECT *, pow({1 - p}, n) <= {ALPHA} / (SELECT count(DISTINCT stratum) FROM own WHERE labelled) AS alone FROM own),
grouped AS (SELECT *, '=' || stratum AS grp FROM sized WHERE alone UNION ALL SELECT *, '*' FROM sized WHERE n < {LEAST} OR alone IS NOT TRUE),
k AS (SELECT grp, level, sum(k)::BIGINT AS k, sum(b)::BIGINT AS b, sum(n)::BIGINT AS n, sum(m)::BIGINT AS m FROM grouped GROUP BY grp, level),
p AS (SELECT *, CASE WHEN k < n * {p} THEN list_sum(list_transform(range(0, k + 1), lambda i:
        exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln({1 - p})))) ELSE 1 END AS p FROM k),
s AS (SELECT *, max(p) OVER (PARTITION BY grp ORDER BY level) <= {ALPHA} / (SELECT count(DISTINCT grp) FROM grouped WHERE labelled) AS sure FROM p),
top AS (SELECT grp, level FROM s WHERE sure AND b * n - k * m > 0
        QUALIFY row_number() OVER (PARTITION BY grp ORDER BY b * n - k * m DESC, level) = 1),
best AS (SELECT stratum, max(level) AS level FROM grouped JOIN top USING (grp, level) WHERE grp <> '*' OR k <= n * {p} GROUP BY stratum),
r AS (SELECT m.*, level FROM m LEFT JOIN best USING (stratum)),
z AS (SELECT *, array_to_string(list_filter([{above}], lambda r: r IS NOT NULL), ',') AS rejected_by FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rejected_by = '' AS kept, rejected_by
FROM z
"""


OP1_SQL = _oracle()
