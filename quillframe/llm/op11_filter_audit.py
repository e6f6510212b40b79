"""Filter interaction audit: what each of five filters removes, under each of the 120 orders in which they could be applied.

A direct replay. Each document's failures are computed once, as bits. They are crossed with the 120 orders, which are broadcast; the step at
which a document first fails is found for each order; five steps are exploded; and counts are taken by part, order and step. These keys are
few (600 a part), so that the counts combine within the tasks and what is shuffled doesn't grow with the documents, nor
with how many of them one part holds.

Cases: a null text is the empty text, which fails A alone, and E if a smaller id has one. A null id is neither smaller than another nor has a smaller
one, and has no label. Rows that repeat an id each count; equal texts of one id are no copies of each other. Several labels of an id count as one, which says yes where one of them does. A null
lang is the empty string's part. A part has 600 rows, of zeros too; a table without rows has no part and no rows. Very long texts are looked at whole.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.llm.common import SPACES, UPPER, read, stored
from quillframe.sources.tables import spread

#: The last filter depends on other documents.
FILTERS = "ABCDE"
MIN_WORDS = 100
#: Percentages: the least of distinct words, the most of capital letters.
MIN_DISTINCT, MAX_CAPITALS = 80, 10
SIGNS = "[#$%&*|]"


def own_failures(text: Column, words: Column) -> Column:
    """Bits of the first four filters, which look at nothing but the text."""
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    fails = [
        F.size(words) < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * F.size(words),
        100 * capitals.cast("long") > MAX_CAPITALS * F.length(text).cast("long"),
        text.rlike(SIGNS),
    ]
    bits = F.lit(0)
    for k, fail in enumerate(fails):
        bits = bits + F.when(fail, 1 << k).otherwise(0)
    return bits


def with_failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, fails) for each row of docs: a bit for each filter that it fails."""
    text = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    split = text.withColumn("words", F.array_remove(F.split("text", f"[{SPACES}]+"), ""))
    own = split.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), own_failures(F.col("text"), F.col("words")).alias("own"))
    own = stored(own, "failures")
    # Written, so that the join is broadcast where few texts repeat, and else can split one that has many rows.
    firsts = own.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows")
    firsts = stored(firsts, "repeated-texts")
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    fails = F.col("own") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)
    return own.join(firsts, "digest", "left").select("doc_id", "part", fails.alias("fails"))


def with_labels(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """flagged, and whether a label says that the document is good or toxic."""
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    return flagged.join(marks, "doc_id", "left").select("part", "fails", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def orders(spark: SparkSession) -> DataFrame:
    """(filter_order, steps): every order of the filters, each step with its number and its filter's bit. 120 rows."""
    rows = [("".join(FILTERS[k] for k in order), [(step + 1, 1 << k) for step, k in enumerate(order)]) for order in permutations(range(len(FILTERS)))]
    return spark.createDataFrame(rows, "filter_order string, steps array<struct<step: int, bit: int>>").coalesce(1)


def replay(flagged: DataFrame) -> DataFrame:
    """flagged (part, fails, good, toxic) through every order: counts by part, order and step."""
    first = F.lit(len(FILTERS) + 1)
    for k in reversed(range(len(FILTERS))):
        step = F.get("steps", F.lit(k))
        first = F.when(F.col("fails").bitwiseAND(step["bit"]) != 0, step["step"]).otherwise(first)
    # Rows are few bytes and have much to do: dealt evenly, whatever their number of bytes.
    crossed = spread(flagged).crossJoin(F.broadcast(orders(flagged.sparkSession)))
    steps = crossed.withColumn("first", first).select("part", "filter_order", "fails", "good", "toxic", "first", F.inline("steps"))
    failing, removed = F.col("fails").bitwiseAND(F.col("bit")) != 0, F.col("first") == F.col("step")
    counts = steps.groupBy("part", "filter_order", "step").agg(
        F.count_if(F.col("first") > F.col("step")).alias("kept"),
        F.count_if(removed).alias("removed"),
        F.count_if(failing & (F.col("first") < F.col("step"))).alias("redundant"),
        F.count_if(F.col("fails") == F.col("bit")).alias("unique_fails"),
        F.count_if(removed & F.col("good")).alias("good_lost"),
        F.count_if(removed & F.col("toxic")).alias("toxic_lost"),
    )
    return counts


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley); the Shapley value of a filter is its
    share of 120 times the removals, which is a whole number."""
    counts = replay(with_labels(with_failures(docs), labels))
    whose = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return counts.withColumn("shapley", F.sum("removed").over(whose))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
f AS (
  SELECT doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(first_id < doc_id, false)] AS fails FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
k AS (SELECT unnest(range(1, 6)) AS k),
o AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
r AS (
  SELECT part, fails, good, toxic, o, coalesce(list_position(list_transform(o, lambda i: fails[i]), true), 6) AS first,
    len(list_filter(fails, lambda b: b)) AS n_fails FROM d, o),
s AS (
  SELECT part, list_aggregate(list_transform(o, lambda i: substr('ABCDE', i, 1)), 'string_agg', '') AS filter_order, step, substr('ABCDE', o[step], 1) AS filter,
    first, good, toxic, fails[o[step]] AS failing, n_fails FROM r, (SELECT unnest(range(1, 6)) AS step)),
c AS (
  SELECT part, filter_order, CAST(step AS INT) AS step, filter, count_if(first > step) AS kept, count_if(first = step) AS removed, count_if(failing AND first < step) AS redundant,
    count_if(failing AND n_fails = 1) AS unique_fails, count_if(first = step AND good) AS good_lost, count_if(first = step AND toxic) AS toxic_lost
  FROM s GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM c
"""
