"""URL filters: pattern rules indexed by their rarest literal token (native).

A rule is a pattern: `*` is any run of characters, `^` one separator character or the end,
`|` at either end an anchor, `||` at the start a host or any subdomain of it; all else is
literal. From each pattern the tokens that any matching url must hold whole are taken, and the
one that is rarest in the urls at hand becomes the rule's key. The tokens of a url fetch its
candidate rules, and regular expressions run on those alone. Rules without such a token are
candidates of every url, so nothing is missed. Rules are a table of any size: written in Python,
read from a list of lines (list_rules) or made otherwise and compiled (compile_rules).

Defined results: a url that is null or has no `://` has an empty host and path, matches no rule
and is allowed; of several fitting rules the lowest tier wins, then the longest pattern, then
the smallest (so ties are settled); repeated rows each get a row; a null page_id stays null; a very
long url is matched whole; an empty table gives an empty result; columns other than page_id and url
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, repeated, table

#: The index may be broadcast while its rules have no more bytes than this; a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Rules (in expectation) that a row of the index has at most, however many share a token.
CHUNK = 64
#: Runs of these are the tokens of urls and patterns.
TOKEN = "[a-z0-9]+"

#: (rule, verdict): host and path-prefix rules that come before all others.
SITE_RULES = [
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
]
#: (pattern, verdict): what else is not worth crawling.
PATTERN_RULES = [
    ("/login^", "block"), ("/signin^", "block"), ("/logout^", "block"), ("/cart^", "block"), ("/checkout^", "block"),
    ("/wp-admin/", "block"), ("/cgi-bin/", "block"), ("?replytocom=", "block"), ("?sessionid=", "block"), ("&sessionid=", "block"),
    ("||doubleclick.net^", "block"), ("||ads.*.com^", "block"), ("/banner/*.gif|", "block"), ("/feed/*/rss^", "block"),
]


def rule_table(spark: SparkSession, rows: list[tuple[str, str, str, int]]) -> DataFrame:
    """Rules (name, pattern, verdict, tier) as a table with their regular expression and tokens."""
    each = [F.struct(*(F.lit(v).alias(k) for k, v in zip(("name", "pattern", "verdict", "tier"), r, strict=True))) for r in rows]
    return compile_rules(spark.range(1).select(F.inline(F.array(*each))))


def list_rules(lines: DataFrame, tier: int = 1) -> DataFrame:
    """The rules of a filter list, a line (value) each, compiled.

    A line is a pattern to block, or after `@@` one to allow, which comes before all that block.
    White space around a line is not part of it; empty lines, those that begin with `!` and nulls
    are none; repeated lines are one rule.
    """
    line = F.regexp_replace(F.col("value"), r"^\s+|\s+$", "")
    rules = lines.select(line.alias("name")).where("name <> '' AND name <> '@@' AND NOT startswith(name, '!')").distinct()
    allow = F.col("name").startswith("@@")
    return compile_rules(rules.select(
        "name", F.when(allow, F.expr("substr(name, 3)")).otherwise(F.col("name")).alias("pattern"),
        F.when(allow, "allow").otherwise("block").alias("verdict"), F.when(allow, tier).otherwise(tier + 1).alias("tier"),
    ))


def compile_rules(rules: DataFrame) -> DataFrame:
    """Add regex and tokens to rules (name, pattern, verdict, tier)."""
    p = F.col("pattern")
    host = p.startswith("||")
    start = ~host & p.startswith("|")
    body = F.regexp_replace(p, r"^\|\|?", "")
    end = body.endswith("|")
    body = F.regexp_replace(body, r"\|$", "")
    regex = F.regexp_replace(body, r"[\\.+?${}()\[\]|\-]", r"\\$0")
    regex = F.regexp_replace(F.regexp_replace(regex, r"\*", ".*"), r"\^", r"(?:[^A-Za-z0-9_.%\\-]|\$)")
    prefix = F.when(host, F.lit(r"(?s)^(?:[^/?#]*\.)?")).when(start, F.lit("(?s)^")).otherwise(F.lit("(?s)"))
    regex = F.concat(prefix, regex, F.when(end, F.lit("$")).otherwise(F.lit("")))
    # a run counts only where the pattern itself bounds it on both sides
    bounded = F.regexp_extract_all(F.concat(p), F.lit(rf"(?<=[^A-Za-z0-9*]){TOKEN}(?=[^A-Za-z0-9*])"), F.lit(0))
    return rules.withColumns({"regex": regex, "tokens": F.array_distinct(bounded)})


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, subject): subject is what rules run on, the url from its host on."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"(?s)^[^?#]*", 0)
    return host, path, F.concat(host, F.substr(rest, F.length(raw) + 1))


def tokens(subject: Column) -> Column:
    """Distinct tokens of a subject, and the empty one, which keys rules without a token."""
    found = F.regexp_extract_all(subject, F.lit(f"(?<![A-Za-z0-9]){TOKEN}(?![A-Za-z0-9])"), F.lit(0))
    return F.array_distinct(F.concat(found, F.array(F.lit(""))))


def _measure(rules: DataFrame) -> tuple[int, bool]:
    """(parts, small): into how many parts a token's rules go, and whether all may be broadcast. A
    rule is in one row of the index, and its tokens are parts of its pattern, so that this bounds both."""
    width = sum(F.octet_length(c) for c in ("name", "pattern", "verdict", "regex")) + 100
    r = rules.agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return max(1, -(-r["n"] // CHUNK)), r["bytes"] <= BROADCAST_BYTES


def index_rules(rules: DataFrame, subjects: DataFrame, parts: int = 1, small: bool = False) -> DataFrame:
    """(token, candidates): the rules of each token, every rule under its rarest one, those of a token
    in one row or more.

    Counts are over the tokens of all subjects, reduced map-side, and only of tokens that
    occur in a rule. A token in no url comes first: such a rule can match nothing here.
    """
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    seen = subjects.select(F.explode(tokens(F.col("subject"))).alias("token")).join(F.broadcast(wanted) if small else wanted, "token").groupBy("token").agg(F.count("*").alias("n"))
    each = rules.select("name", "verdict", "tier", "regex", F.length("pattern").alias("width"), F.explode_outer("tokens").alias("token"))
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.length("token")).alias("l"), F.col("token").alias("token"))
    keyed = each.join(seen, "token", "left").groupBy("name", "verdict", "tier", "regex", "width").agg(F.min(rank)["token"].alias("token"))
    rule = F.struct((-F.col("tier")).alias("t"), F.col("width").alias("w"), F.col("name").alias("name"), F.col("verdict").alias("verdict"), F.col("regex").alias("regex"))
    part = F.pmod(F.xxhash64("name"), F.lit(parts))
    return keyed.groupBy(F.coalesce("token", F.lit("")).alias("token"), part.alias("part")).agg(F.collect_list(rule).alias("candidates")).drop("part")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, url, host, path, rule, tier, verdict) per row of pages (page_id, url).

    A row's candidates are reduced to its best rule in the task that made them, so what is
    shuffled is a row per page; equal rows are counted and come out as often as they went in.
    """
    host, path, subject = url_parts(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"), subject.alias("subject"))
    pieces, small = _measure(rules)
    index = cut(index_rules(rules, parts, pieces, small))
    fitting = F.filter("candidates", lambda r: (F.col("subject") != "") & F.regexp_like(F.col("subject"), r["regex"]))
    keyed = parts.withColumn("token", F.explode(tokens(F.col("subject"))))
    # rows without a token of a rule stay: one a page says how often it is there
    counted = parts.select("page_id", "url", "host", "path", F.lit(None).cast(index.schema["candidates"].dataType.elementType).alias("best"), F.lit(1).alias("one"))
    matched = keyed.join(F.broadcast(index) if small else index, "token")
    matched = matched.select("page_id", "url", "host", "path", F.array_max(fitting).alias("best"), F.lit(0).alias("one")).where("best IS NOT NULL")
    best = matched.unionByName(counted).groupBy("page_id", "url", "host", "path").agg(F.max("best").alias("best"), F.sum("one").alias("rows"))
    return repeated(best, F.col("rows"), "_").select(
        "page_id", "url", "host", "path", F.col("best.name").alias("rule"), (-F.col("best.t")).alias("tier"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )


def production_rules(spark: SparkSession) -> DataFrame:
    sites = [(name, f"||{name}", verdict, 0) for name, verdict in SITE_RULES]
    return rule_table(spark, sites + [(pattern, pattern, verdict, 1) for pattern, verdict in PATTERN_RULES])


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under the site rules (tier 0), then the pattern rules (tier 1)."""
    judged = judge(table(spark, sf_dir, "pages"), production_rules(spark))
    site = F.when(F.col("tier") == 0, F.col("rule"))
    return judged.select("page_id", "host", "path", site.alias("rule"), "verdict", F.when(F.col("tier") == 1, F.col("rule")).alias("pattern_rule"))


OP5_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, rest, regexp_extract(rest, '(?s)^[^/?#]*') AS raw FROM u),
p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '(?s)^[^?#]*') AS path, substr(rest, length(raw) + 1) AS tail FROM h),
site AS (
  SELECT * FROM (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                        ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) AS t(d, prefix, v)),
best AS (
  SELECT page_id, arg_max(d || prefix, length(d || prefix)) AS rule, arg_max(v, length(d || prefix)) AS v
  FROM p JOIN site ON (host = d OR ends_with(host, '.' || d)) AND starts_with(path, prefix) GROUP BY page_id),
pat AS (
  SELECT * FROM (VALUES
    ('/login^', '/login(?:[^A-Za-z0-9_.%\-]|$)'), ('/signin^', '/signin(?:[^A-Za-z0-9_.%\-]|$)'),
    ('/logout^', '/logout(?:[^A-Za-z0-9_.%\-]|$)'), ('/cart^', '/cart(?:[^A-Za-z0-9_.%\-]|$)'),
    ('/checkout^', '/checkout(?:[^A-Za-z0-9_.%\-]|$)'), ('/wp-admin/', '/wp-admin/'), ('/cgi-bin/', '/cgi-bin/'),
    ('?replytocom=', '\?replytocom='), ('?sessionid=', '\?sessionid='), ('&sessionid=', '&sessionid='),
    ('||doubleclick.net^', '^(?:[^/?#]*\.)?doubleclick\.net(?:[^A-Za-z0-9_.%\-]|$)'),
    ('||ads.*.com^', '(?s)^(?:[^/?#]*\.)?ads\..*\.com(?:[^A-Za-z0-9_.%\-]|$)'),
    ('/banner/*.gif|', '(?s)/banner/.*\.gif$'), ('/feed/*/rss^', '(?s)/feed/.*/rss(?:[^A-Za-z0-9_.%\-]|$)')) AS t(pattern, re)),
other AS (
  SELECT page_id, max(struct_pack(w := length(pattern), pattern := pattern)).pattern AS pattern_rule
  FROM p JOIN pat ON host || tail <> '' AND regexp_matches(host || tail, re) GROUP BY page_id)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN v WHEN pattern_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN rule IS NULL THEN pattern_rule END AS pattern_rule
FROM p LEFT JOIN best USING (page_id) LEFT JOIN other USING (page_id)
"""
