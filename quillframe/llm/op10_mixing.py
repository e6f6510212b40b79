"""Mixing sources to target weights: Poisson replication with a hash-seeded inverse distribution.

The mean repetition of a source is its target share of the output over its share of the input; the
output has on average repeat times as many rows as the sources that have a target weight.
Each document draws its count by inverting the Poisson distribution at a uniform number hashed
from seed and id, is exploded by that count, and all copies are shuffled by a hashed key.

Cases: a null source is a source of its own. A null id hashes as the empty text. Rows that repeat
an id draw the same count and appear each on its own. A source without a target weight isn't
drawn. An empty table gives an empty result. Further columns pass through unchanged, but for those that
have the name of a new column: they are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import doc_key, read

SEED = 20
#: Without given weights a source's target weight is its document count to this power.
TEMPERATURE = 0.5
#: A mean above this is drawn as the sum of so many equal draws; below it, TERMS terms hold the whole distribution.
LAMBDA_STEP = 16.0
TERMS = 64
#: The table of sources is broadcast up to this many rows; beyond it, it is joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Columns that mixing adds; input columns of these names give way.
OWN = ["copy", "n_copies", "shuffle_key"]


def uniform(*parts: Column) -> Column:
    """52 bits of an MD5 as a number in [0, 1)."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_means(docs: DataFrame, target_weights: dict[str | None, float] | None, repeat: float) -> DataFrame:
    """(_mix_source, _mix_draws, _mix_cdf): per source the number of draws and the distribution of each; one row for each source."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if target_weights is None:
        weighted = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE)))
    else:
        given = docs.sparkSession.createDataFrame(sorted(target_weights.items(), key=str), "s string, weight double")
        weighted = counts.join(given, counts.source.eqNullSafe(given.s)).drop("s")
    totals = weighted.agg(F.sum("weight").alias("weights"), F.sum("n").alias("docs"))
    mean = weighted.crossJoin(F.broadcast(totals)).withColumn("mean", F.col("weight") / F.col("weights") * F.col("docs") * F.lit(float(repeat)) / F.col("n"))
    draws = F.greatest(F.ceil(F.col("mean") / LAMBDA_STEP), F.lit(1)).cast("int")
    mean = mean.withColumn("draws", draws).withColumn("lam", F.col("mean") / F.col("draws"))
    start = F.struct(F.exp(-F.col("lam")).alias("p"), F.array(F.exp(-F.col("lam"))).alias("cdf"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * F.col("lam") / k
        return F.struct(p.alias("p"), F.concat(state["cdf"], F.array(F.element_at(state["cdf"], -1) + p)).alias("cdf"))

    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step, lambda s: s["cdf"])
    return mean.select(F.col("source").alias("_mix_source"), F.col("draws").alias("_mix_draws"), cdf.alias("_mix_cdf"))


def mix_sources(docs: DataFrame, target_weights: dict[str | None, float] | None = None, repeat: float = 1.0, seed: int = SEED) -> DataFrame:
    """docs with copy (from 1), n_copies and shuffle_key; rows in the order of shuffle_key inside partitions dealt by its hash."""
    prefix = "_mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    source, draws, cdf, doc, first = (prefix + n for n in ("source", "draws", "cdf", "key", "u"))
    means = source_means(docs, target_weights, repeat).toDF(source, draws, cdf)
    n_sources = docs.select("source").distinct().limit(BROADCAST_SOURCES + 1).count()
    kept = [c for c in docs.columns if c.lower() not in OWN]
    keyed = docs.select(*kept, doc_key(F.col("doc_id")).alias(doc))
    drawn = keyed.join(F.broadcast(means) if n_sources <= BROADCAST_SOURCES else means, keyed["source"].eqNullSafe(F.col(source)))
    draw = lambda u: F.size(F.filter(cdf, lambda c: c <= u))
    later = F.when(F.col(draws) > 1, F.sequence(F.lit(2), F.col(draws))).otherwise(F.array().cast("array<int>"))
    more = F.aggregate(F.transform(later, lambda j: uniform(F.lit(seed), F.col(doc), j)), F.lit(0), lambda s, u: s + draw(u))
    drawn = drawn.withColumn(first, uniform(F.lit(seed), F.col(doc), F.lit(1)))
    drawn = drawn.withColumn("n_copies", (draw(F.col(first)) + more).cast("long")).filter("n_copies > 0")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}-shuffle"), F.col(doc), F.col("copy")).cast("binary"))
    out = copies.withColumn("shuffle_key", key).select(*kept, *OWN)
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"))


ORACLE = f"""
WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT source, n, pow(n::DOUBLE, {TEMPERATURE}) AS weight FROM c),
m AS (SELECT source, weight / (SELECT sum(weight) FROM w) * (SELECT sum(n) FROM w) * 1.0 / n AS mean FROM w),
l AS (SELECT source, greatest(ceil(mean / {LAMBDA_STEP}), 1)::INT AS draws, mean / greatest(ceil(mean / {LAMBDA_STEP}), 1) AS lam FROM m),
d(source, draws, lam, k, p, cdf) AS (
  SELECT source, draws, lam, 0, exp(-lam), exp(-lam) FROM l
  UNION ALL SELECT source, draws, lam, k + 1, p * lam / (k + 1), cdf + p * lam / (k + 1) FROM d WHERE k < {TERMS - 1}),
u AS (
  SELECT t.doc_id, t.source, j.j, ('0x' || substr(md5('{SEED}:' || t.doc_id || ':' || j.j), 1, 13))::BIGINT / {float(2**52)} AS u
  FROM documents t JOIN l ON t.source IS NOT DISTINCT FROM l.source, LATERAL (SELECT unnest(range(1, l.draws + 1)) AS j) j),
x AS (SELECT u.doc_id, count(*) AS n_copies FROM u JOIN d ON u.source IS NOT DISTINCT FROM d.source AND d.cdf <= u.u GROUP BY u.doc_id)
SELECT t.*, g.copy, x.n_copies, md5('{SEED}-shuffle:' || t.doc_id || ':' || g.copy) AS shuffle_key
FROM documents t JOIN x ON x.doc_id = t.doc_id, LATERAL (SELECT unnest(range(1, x.n_copies + 1)) AS copy) g
"""
