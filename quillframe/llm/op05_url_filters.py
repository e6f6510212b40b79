"""URL filters: host-suffix and path-prefix expressions, joined to a rule list by short hash prefixes.

Each URL is expanded into (host suffix, path prefix) expressions. They meet the rules in an
equi-join on the first four bytes of a SHA-256; the full digest and the rule's whole path then
confirm the match, and the longest rule decides.

Cases: a null URL or one without "://" has an empty host and path, no rule and the default
verdict. Repeated rows come out as often as they came in. Rules of equal length: the longer host
wins, then block before allow. An empty rule list leaves every URL at the default verdict. Only
the id and URL columns are read, so further columns and their names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import lower_ascii, read

#: (verdict, host, path). Fixed values of the query's contract.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Hex digits of a digest on which expressions and rules are joined.
PREFIX_DIGITS = 8
#: Rules of a list up to this length are broadcast; a longer list is joined by a shuffle.
BROADCAST_RULES = 100_000


def url_host(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0))).otherwise("")


def url_path(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    after = F.regexp_replace(rest, "^[^/?#]+", "")
    return F.when(at > 0, F.regexp_extract(after, "^[^?#]*", 0)).otherwise("")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules with their join key. A path counts up to its last slash; the rest of it is confirmed after the join."""
    rows = sorted({(verdict, host.lower(), path, path[: path.rfind("/") + 1]) for verdict, host, path in rules})
    table = spark.createDataFrame(rows, "verdict string, rule_host string, rule_path string, key_path string")
    digest = F.sha2(F.concat("rule_host", F.lit("\n"), "key_path"), 256)
    return table.select(
        "verdict", "rule_host", "rule_path", F.concat("rule_host", "rule_path").alias("rule"),
        digest.alias("rule_digest"), F.substring(digest, 1, PREFIX_DIGITS).alias("prefix"),
    )


def expressions(host: Column, path: Column, host_labels: list[int], path_slashes: list[int]) -> Column:
    """Host suffixes by path prefixes, of the label and slash counts that some rule has (others can't match)."""
    labels, parts = F.split(host, r"\."), F.split(path, "/", -1)
    suffixes = F.array(*[F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in host_labels])
    prefixes = F.array(
        *[F.lit("") if n == 0 else F.when(F.size(parts) > n, F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))) for n in path_slashes]
    )
    pairs = F.transform(F.array_compact(suffixes), lambda s: F.transform(F.array_compact(prefixes), lambda p: F.concat(s, F.lit("\n"), p)))
    return F.flatten(pairs)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict), one row for each row of pages."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    if rules:
        table = rule_table(spark, rules)
        small = len(rules) <= BROADCAST_RULES
        labels = sorted({host.count(".") + 1 for _, host, _ in rules})
        slashes = sorted({path.count("/") for _, _, path in rules})
        exprs = rows.withColumn("expr", F.explode_outer(expressions(F.col("host"), F.col("path"), labels, slashes)))
        exprs = exprs.withColumn("digest", F.sha2("expr", 256)).withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
        joined = exprs.join(F.broadcast(table) if small else table, "prefix", "left")
        fits = (F.col("digest") == F.col("rule_digest")) & F.startswith("path", "rule_path")
        rank = F.struct(F.length("rule").alias("len"), F.length("rule_host").alias("host_len"), (F.col("verdict") == "block").alias("block"), "rule", "verdict")
        rows = joined.groupBy("page_id", "url", "copies", "host", "path").agg(F.max(F.when(fits, rank)).alias("best"))
        rows = rows.withColumns({"rule": F.col("best.rule"), "verdict": F.coalesce("best.verdict", F.lit(default))})
    else:
        rows = rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(F.col("page_id").alias(id_col), "host", "path", "rule", "verdict")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, row_number() OVER () AS rid,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
h AS (
  SELECT page_id, rid,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(regexp_replace(rest, '^[^/?#]+', ''), '^[^?#]*') AS path
  FROM p),
r(verdict, rule_host, rule_path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (
  SELECT h.*, r.verdict, r.rule_host || r.rule_path AS rule,
    row_number() OVER (PARTITION BY rid ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS k
  FROM h LEFT JOIN r ON (h.host = r.rule_host OR ends_with(h.host, '.' || r.rule_host)) AND starts_with(h.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
