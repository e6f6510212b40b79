"""Packing: optimal length buckets by dynamic programming, then token-budget batches inside each bucket.

Every document is padded to the longest length of its bucket. The bucket ends come from a dynamic
program over the global length histogram that minimises the total padding. Inside a bucket, batches
hold as many rows as fit the token budget. Only ids, lengths and counts are shuffled: rows of one id and length are
counted together first, so that an id that repeats often is no hot key. Rows stand in a hashed order in which copies of a document are as far
apart as any others.

A document's length is its number of words plus one end token, so nothing is empty. The histogram has a row for each length that occurs:
never more than the longest text has tokens.

Cases: null and empty texts have length 1. A document longer than the budget is a batch of its own.
Rows that repeat an id are packed each on its own. Ties in the dynamic program take the smallest
bucket ends. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillframe.llm.common import doc_key, read, stored

BUCKETS = 8
TOKEN_BUDGET = 65_536
#: A bucket is cut into shards of about so many documents; batches form inside a shard.
SHARD_DOCS = 20_000
#: Characters of a word.
WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    return (F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)) + 1).cast("long")


def best_buckets(histogram: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """Bucket ends with the least padding. histogram: (length, documents, tokens) of each length, in order.

    least[j] is the least padding of the first j lengths. A last bucket over lengths i+1..j pads
    its documents to the length of j, which is a straight line in that length for each i, so the
    best i for growing lengths is found on the lower envelope of lines.
    """
    n, docs, toks = len(histogram), [0], [0]
    for _, count, tokens in histogram:
        docs.append(docs[-1] + count)
        toks.append(toks[-1] + tokens)
    least, cuts = [0.0] + [float("inf")] * n, []
    for _ in range(min(buckets, n)):
        lines: list[tuple[int, float, int]] = []  # (slope, intercept, i), slopes falling
        new, cut, at, added = [0.0] + [float("inf")] * n, [0] * (n + 1), 0, 0
        for j in range(1, n + 1):
            while added < j:
                if least[added] != float("inf"):
                    m, b = -docs[added], least[added] + toks[added]
                    while len(lines) >= 2 and (b - lines[-2][1]) * (lines[-2][0] - lines[-1][0]) <= (lines[-1][1] - lines[-2][1]) * (lines[-2][0] - m):
                        lines.pop()
                    lines.append((m, b, added))
                added += 1
            x = histogram[j - 1][0]
            at = min(at, len(lines) - 1)
            while at + 1 < len(lines) and lines[at + 1][0] * x + lines[at + 1][1] < lines[at][0] * x + lines[at][1]:
                at += 1
            new[j], cut[j] = lines[at][0] * x + lines[at][1] + x * docs[j] - toks[j], lines[at][2]
        least = new
        cuts.append(cut)
    ends, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        ends.append(histogram[j - 1][0])
        j = cut[j]
    return ends[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_len, batch_id, slot, padding), one row for each row of docs."""
    lengths = docs.select("doc_id", token_count(F.col("text")).alias("n_tokens")).groupBy("doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("copies"))
    lengths = stored(lengths, "lengths")
    counted = lengths.groupBy("n_tokens").agg(F.sum("copies").alias("docs"))
    histogram = sorted((r["n_tokens"], r["docs"], r["n_tokens"] * r["docs"]) for r in counted.collect())  # a row for each length
    ends = best_buckets(histogram, buckets) or [1]
    sizes = [sum(d for n, d, _ in histogram if lo < n <= hi) for lo, hi in zip([0, *ends], ends)]
    shards = [max(1, -(-size // SHARD_DOCS)) for size in sizes]

    def by_bucket(values: list[int], kind: str) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("bucket") + 1).cast(kind)

    bucket = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e < F.col("n_tokens")))
    dealt = lengths.withColumn("bucket", bucket).withColumn("bucket_len", by_bucket(ends, "long")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    dealt = dealt.withColumn("_order", F.md5(F.concat_ws(":", doc_key(F.col("doc_id")), "n_tokens", "copy").cast("binary")))
    dealt = dealt.withColumn("shard", (F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") % by_bucket(shards, "long")).cast("int"))
    rows = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("_order", "doc_id", "n_tokens", "copy")) - 1
    fit = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.col("bucket_len"))).cast("int")
    return dealt.withColumns({"_row": rows, "_fit": fit}).select(
        "doc_id", "n_tokens", "bucket", "bucket_len", F.concat_ws("-", "bucket", "shard", F.floor(F.col("_row") / F.col("_fit"))).alias("batch_id"),
        (F.col("_row") % F.col("_fit")).cast("int").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def oracle(buckets: int = BUCKETS) -> str:
    """The same in SQL: the dynamic program as one step for each bucket, over all pairs of lengths."""
    steps = ["d1 AS (SELECT j, n * d - t AS cost, 0 AS cut FROM c WHERE j > 0)"]
    for k in range(2, buckets + 1):
        steps.append(
            f"d{k} AS (SELECT c.j, min(p.cost + c.n * (c.d - q.d) - (c.t - q.t)) AS cost, arg_min(q.j, (p.cost + c.n * (c.d - q.d) - (c.t - q.t), q.j)) AS cut "
            f"FROM c JOIN (SELECT j, cost FROM d{k - 1} UNION ALL SELECT 0, 0) p ON p.j < c.j JOIN c q ON q.j = p.j GROUP BY c.j)"
        )
    steps.append(f"e{buckets} AS (SELECT max(j) AS j FROM c)")
    for k in range(buckets, 1, -1):
        steps.append(f"e{k - 1} AS (SELECT d.cut AS j FROM d{k} d JOIN e{k} USING (j) WHERE d.cut > 0)")
    ends = " UNION ALL ".join(f"SELECT j FROM e{k}" for k in range(1, buckets + 1))
    return f"""
WITH l AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) + 1 AS BIGINT) AS n_tokens FROM documents),
g AS (SELECT n_tokens AS n, count(*) AS docs, sum(n_tokens) AS toks FROM l GROUP BY n_tokens),
c AS (SELECT row_number() OVER (ORDER BY n) AS j, n, CAST(sum(docs) OVER (ORDER BY n) AS BIGINT) AS d, CAST(sum(toks) OVER (ORDER BY n) AS BIGINT) AS t FROM g
  UNION ALL SELECT 0, 0, 0, 0),
{', '.join(steps)},
b AS (SELECT row_number() OVER (ORDER BY n) - 1 AS bucket, n AS bucket_len, coalesce(lag(n) OVER (ORDER BY n), 0) AS above FROM c WHERE j IN ({ends}) AND j > 0),
w AS (SELECT l.*, b.bucket, b.bucket_len, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || n_tokens || ':' || row_number() OVER (PARTITION BY doc_id, n_tokens)) AS o, CAST(ceil(count(*) OVER (PARTITION BY b.bucket) / {SHARD_DOCS}.0) AS BIGINT) AS shards
  FROM l JOIN b ON l.n_tokens > b.above AND l.n_tokens <= b.bucket_len),
s AS (SELECT *, ('0x' || substr(o, 1, 8))::BIGINT % shards AS shard, greatest(1, {TOKEN_BUDGET} // bucket_len) AS fit FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket, shard ORDER BY o, doc_id, n_tokens) - 1 AS k FROM s)
SELECT doc_id, n_tokens, CAST(bucket AS INT) AS bucket, bucket_len, bucket || '-' || shard || '-' || (k // fit) AS batch_id, CAST(k % fit AS INT) AS slot, bucket_len - n_tokens AS padding FROM r
"""


ORACLE = oracle()
