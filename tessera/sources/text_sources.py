"""Sources that are lines of text or files: manifests, evaluation specs, durations, listings."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines_of(df: DataFrame, value: Column, *keep: str) -> DataFrame:
    """keep, line_no (from 0) and line of each line of a text column; any line end counts."""
    return df.select(*keep, F.posexplode(F.split(value, "\r\n|\r|\n")).alias("line_no", "line"))


def parse_manifest(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with relpath and subtune in place of line; comments and blank lines go.

    A `#` anywhere starts a comment. A line with a tab is split at tabs, and the path keeps blanks
    before the tab; any other at white space. A subtune that is no number fails the query.
    """
    body = F.regexp_replace(F.split_part(F.col(line), F.lit("#"), F.lit(1)), r"^\s+|\s+$", "")
    parts = F.when(F.contains(body, F.lit("\t")), F.split(body, "\t")).otherwise(F.split(body, r"\s+"))
    rows = lines.withColumn("_parts", F.when(F.length(body) > 0, parts)).where(F.col("_parts").isNotNull())
    number = F.regexp_replace(F.get("_parts", 1), r"^\s+|\s+$", "").cast("int")
    return rows.select(
        *(c for c in lines.columns if c != line), F.get("_parts", 0).alias("relpath"),
        F.when(F.size("_parts") > 1, number).otherwise(F.lit(1)).alias("subtune"),
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, relpath, subtune) of a manifest file, duplicates kept; order is line_no. A missing
    manifest is an empty one."""
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        whole = spark.createDataFrame([], "value string")
    return parse_manifest(lines_of(whole, F.col("value")))


def parse_eval_spec(df: DataFrame, spec: str) -> DataFrame:
    """(ord, name, path) of the `name=path;name=path` text in column spec; blank parts go.

    The first `=` parts a name from its path; a part without one has an empty path.
    """
    part = F.trim(F.col("_part"))
    at = F.instr(part, "=")
    rows = df.select(*(c for c in df.columns if c != spec), F.posexplode(F.split(F.coalesce(F.col(spec), F.lit("")), ";")).alias("ord", "_part")).where(F.length(part) > 0)
    return rows.select(
        *(c for c in df.columns if c != spec), "ord",
        F.trim(F.when(at > 0, F.substr(part, F.lit(1), at - 1)).otherwise(part)).alias("name"),
        F.when(at > 0, F.trim(F.substr(part, at + 1))).otherwise(F.lit("")).alias("path"),
    )


def parse_durations(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with md5 and times in place of line: `key=time time ...`, the key in lower case.

    Only lines with `=` that don't start with `;` or `[` count; the test is on the line as it is.
    """
    raw = F.col(line)
    body = F.regexp_replace(raw, r"^\s+|\s+$", "")
    at = F.instr(body, "=")
    rows = lines.where((F.instr(raw, "=") > 0) & ~F.substring(raw, 1, 1).isin(";", "["))
    return rows.select(
        *(c for c in lines.columns if c != line), F.lower(F.substr(body, F.lit(1), at - 1)).alias("md5"),
        F.array_remove(F.split(F.substr(body, at + 1), r"\s+"), "").alias("times"),
    )


def last_wins(durations: DataFrame, order: str) -> DataFrame:
    """(md5, times): of several lines with a key, the last. Reduced map-side, one row a key."""
    return durations.groupBy("md5").agg(F.max_by("times", order).alias("times"))


def read_durations(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True)
    return last_wins(parse_durations(lines_of(whole, F.col("value"))), "line_no")


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, md5) of the files below path whose names match pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.md5("content").alias("md5"))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modified) of files; the content column is pruned, so no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"))
