"""Secret scans over an incremental blob ledger (native).

Every historical version of every path is content-addressed. The ledger has a row per blob and
rule version that was scanned; a run scans only the pairs it lacks, appends them, and joins the
findings back to all paths that hold the blob.

Defined results: a null text is the empty blob; spans are in code points with the end exclusive;
equal rows each get a row of the result; a null path is a path of its own; findings that start at
one place (ties) are listed by kind; a very long text is scanned whole, its findings in chunks; an
empty table gives an empty result; columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, shared_dir, table, whole


@dataclass(frozen=True)
class Kind:
    """A kind of secret: pattern (Java and RE2 alike), the group whose length counts, its least
    length, and a cheaper pattern without which a text can't hold a finding."""

    name: str
    pattern: str
    group: int
    least: int
    hint: str


#: In the order in which findings with the same start are listed.
KINDS = (
    Kind(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 12, r"""[DdTtNnYy]["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""",
    ),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 18, "AKIA[A-Z0-9]{14}"),
    # a maximal run of 16 or more is what [0-9a-f]+ finds once shorter matches are dropped
    Kind("hex", r"[0-9a-f]{16,}", 0, 16, "[0-9a-f]{16}"),
)


def rule_version(kinds: tuple[Kind, ...] = KINDS) -> str:
    """A name that changes whenever a rule does."""
    import hashlib

    return hashlib.sha256(repr(kinds).encode()).hexdigest()[:16]


#: Findings that are folded at once: a fold copies what it has gathered at every step.
CHUNK = 256


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def in_chunks(items: Column, total, begin, fold) -> Column:
    """fold(chunk, carry) of each chunk of items: carry is what begin makes of the totals of all chunks before.

    Only folds over CHUNK items, and one over the chunks, gather arrays; so the work hardly grows
    faster than the number of items.
    """
    size = F.ceil(F.size(items) / CHUNK).cast("int")
    chunk = lambda i: F.slice(items, i * CHUNK + 1, F.lit(CHUNK))
    numbers = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
    step = lambda acc, x: F.struct(begin(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    carries = F.aggregate(F.transform(numbers, lambda i: total(chunk(i))), start, step)["out"]
    return F.transform(carries, lambda at, i: fold(chunk(i), at))


def spans_of(text: Column, kind: Kind, order: int) -> Column:
    """array<struct<start long, kind int, stop long>> of a kind's findings in text.

    The pieces between the matches and the matches themselves give the places: a match starts
    after all pieces up to it and all matches before it.
    """
    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,stop:bigint>>)")
    found = F.arrays_zip(
        F.split(text, kind.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)).alias("value"),
    )
    sizes = F.transform(found, lambda x: F.struct(
        F.length(x["gap"]).cast("long").alias("gap"), F.coalesce(F.length(x["match"]), F.lit(0)).cast("long").alias("match"), F.coalesce(F.length(x["value"]) >= kind.least, F.lit(False)).alias("holds")))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        stop = begin + x["match"]
        one = F.array(F.struct(begin.alias("start"), F.lit(order).alias("kind"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(x["holds"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    total = lambda chunk: F.aggregate(chunk, F.lit(0).cast("long"), lambda n, x: n + x["gap"] + x["match"])
    spans = let(sizes, lambda items: F.flatten(in_chunks(items, total, lambda at, n: at + n, lambda chunk, at: F.aggregate(chunk, F.struct(at.alias("at"), none.alias("out")), step)["out"])))
    return F.when(F.regexp_like(text, F.lit(kind.hint)), spans).otherwise(none)


def scan(blobs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(blob, spans) of blobs (blob, text); spans by start, then kind."""
    each = [spans_of(F.col("text"), k, i) for i, k in enumerate(kinds)]
    return blobs.select("blob", F.array_sort(F.concat(*each)).alias("spans"))


class BlobLedger:
    """A Parquet table (blob, spans) at a shared path, partitioned by rule version.

    A blob without findings has a row with no spans, so it is not scanned again.
    """

    SCHEMA = "blob string, spans array<struct<start:bigint,kind:int,stop:bigint>>, rule_version string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], self.SCHEMA).write.mode("append").partitionBy("rule_version").parquet(path)

    def rows(self, version: str) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).where(F.col("rule_version") == version)

    def append(self, findings: DataFrame, version: str) -> None:
        findings.withColumn("rule_version", F.lit(version)).write.mode("append").partitionBy("rule_version").parquet(self.path)


def scan_versions(versions: DataFrame, ledger: BlobLedger, kinds: tuple[Kind, ...] = KINDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Findings of versions (path, text): a row per row of versions with path, blob and spans.

    Unseen blobs are found on digests alone. For each the row with the smallest path lends its
    text, found by a join on (path, blob), whose keys don't repeat, so a blob with a third of
    all rows goes through no task of its own; joining findings back reads both sides from
    tables, which lets Spark split a hot blob.
    """
    version = rule_version(kinds)
    text = whole("text")
    hashed = versions.select(F.col("path"), F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"))
    paths = cut(hashed.select("path", "blob"))
    unseen = cut(
        paths.groupBy("blob").agg(F.min("path").alias("path"))
        .join(ledger.rows(version).select("blob"), "blob", "left_anti")
    )
    same = hashed["blob"].eqNullSafe(unseen["blob"]) & hashed["path"].eqNullSafe(unseen["path"])
    lent = hashed.join(unseen.hint("shuffle_hash"), same, "left_semi").select("blob", "text")
    ledger.append(scan(lent, kinds).dropDuplicates(["blob"]), version)
    return paths.join(ledger.rows(version).select("blob", "spans"), "blob")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every span, overlapping ones as one, replaced by mark; spans are sorted by start.

    A chunk of spans is cut from its own part of the text, so no place is sought from the start of a
    long text again and again.
    """
    top = lambda chunk: F.array_max(F.transform(chunk, lambda s: s["stop"]))
    part = lambda t, a, b: F.substr(t, (a + 1).cast("int"), (b - a).cast("int"))

    def fold(chunk, at):
        def cut_out(own):
            def step(acc, s):
                longer = F.concat(acc["out"], part(own, acc["at"] - at, s["start"] - at), F.lit(mark))
                return F.struct(F.when(s["start"] >= acc["at"], longer).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["stop"]).alias("at"))

            return F.aggregate(chunk, F.struct(F.lit("").alias("out"), at.alias("at")), step)["out"]

        return let(part(text, at, F.greatest(at, top(chunk))), cut_out)

    pieces = in_chunks(spans, top, lambda at, n: F.greatest(at, n), fold)
    done = F.concat(F.array_join(pieces, ""), F.substr(text, (top(spans) + 1).cast("int")))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def listed(spans: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k.name) for k in kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a path with one version, over a new ledger."""
    ledger = BlobLedger(spark, f"{shared_dir(spark)}/ledger_{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("path"), "text")
    found = scan_versions(docs, ledger)
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    line = listed(F.col("spans"))
    return found.select(
        F.col("path").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(line.cast("binary"), 256).alias("base_sha256"), line.alias("spans"),
    )


def _oracle() -> str:
    """Places in DuckDB: the text is cut at each match in turn, so the length before it is known."""
    parts = []
    for i, k in enumerate(KINDS):
        pattern = k.pattern.replace("'", "''")
        parts.append(f"""
  SELECT doc_id, {i} AS kind, '{k.name}' AS name, m.start AS start, m.start + length(m.match) AS stop, length(m.value) AS n
  FROM (SELECT doc_id, unnest(list_transform(range(1, len(ms) + 1), lambda j: struct_pack(
          match := ms[j], value := vs[j],
          start := list_sum(list_transform(gs[1:j], lambda g: length(g)))::BIGINT + coalesce(list_sum(list_transform(ms[1:j - 1], lambda x: length(x))), 0)::BIGINT))) AS m
        FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS ms, regexp_extract_all(t, '{pattern}', {k.group}) AS vs,
                     regexp_split_to_array(t, '{pattern}') AS gs FROM d)) WHERE length(m.value) >= {k.least}""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(parts)}),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
             string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


OP8_SQL = _oracle()
