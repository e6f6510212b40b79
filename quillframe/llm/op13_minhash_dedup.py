"""MinHash near-dedup by b-bit signatures: bands of minima find candidates, packed low bits estimate their similarity, full sets confirm.

Each set of shingles has HASHES minima. Bands of ROWS whole minima are hashed to bucket keys; of each minimum the lowest BITS bits are kept and packed
into words of 64 bits. In a bucket, texts whose packed signatures agree often enough are connected: differing bits are
folded to one for each minimum and counted, and of the share that agrees the chance collisions (2 ^ -BITS) are taken off. What
that connects makes a region, and inside regions links are confirmed on the full sets, as exactly as in the n-gram Jaccard join, whose
regions, pivots and cells this takes over. So every link given is one, and a link is lost only if no band finds it, or the estimate falls under LEAST: for a
similarity of exactly 0.8 once in twenty million and in five million, and more rarely above.

Buckets with the same members are one. No pairs come out of a bucket, only as many edges as connect it: each text is compared with those not
yet connected. Buckets of more than BUCKET texts connect all their members without an estimate, and their regions are cut by pivots in Spark; nothing
is left out of them. Copies with equal sets are one class throughout.

Cases: a null or empty text has no shingles, links with nothing, is its own component and kept. A text of fewer words than a shingle has one shingle, very long texts
all of theirs. Rows that repeat an id each come out, with their own text's component. A null id sorts last: its row has the smallest id that its text reaches, and null if it reaches none; it
is kept only then. A table without rows gives none. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import might_be_in, read, stored
from quillframe.llm.op07_ngram_jaccard_join import Shingler, digest, linked_in_regions, lists, mixed, set_classes

WORDS, PERCENT = 4, 80
HASHES, ROWS, BITS = 128, 4, 4
BANDS, PACKED = HASHES // ROWS, HASHES * BITS // 64
#: The least estimate that connects two texts of a bucket: more than five standard errors under the threshold.
LEAST = 0.6
#: Texts of a bucket that are compared by their signatures.
BUCKET = 2_000
#: Shingles hashed at a time.
CHUNK = 1_024

_LOW = np.uint64(int("0001" * 16, 2))


class MinHasher:
    """Minima of sets of 64-bit hashes under HASHES multiplications by odd numbers."""

    def __init__(self) -> None:
        self.factors = (mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1))[:, None]
        self.bands = mixed(np.arange(BANDS, dtype=np.uint64) + np.uint64(0x2545F491))

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(shingles), CHUNK):
            np.minimum(low, (shingles[k : k + CHUNK] * self.factors).min(axis=1), out=low)
        return mixed(low)

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """A bucket key for each band."""
        key = self.bands
        for column in minima.reshape(BANDS, ROWS).T:
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
        return key


def packed(minima: np.ndarray) -> np.ndarray:
    """The lowest bits of minima, side by side in 64-bit words."""
    low = (minima & np.uint64((1 << BITS) - 1)).reshape(PACKED, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity for each row of two arrays of packed signatures."""
    differ = a ^ b
    differ |= differ >> np.uint64(2)
    differ |= differ >> np.uint64(1)
    agree = 1 - np.bitwise_count(differ & _LOW).sum(axis=-1, dtype=np.int64) / HASHES
    chance = 2.0**-BITS
    return (agree - chance) / (1 - chance)


def spanning(signatures: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect the texts of a bucket wherever their estimates do: each text found is compared with those not yet found."""
    edges, rest = [], np.arange(len(signatures))
    while len(rest):
        found, rest = [int(rest[0])], rest[1:]
        while found and len(rest):
            i = found.pop()
            near = estimates(signatures[rest], signatures[i]) >= LEAST
            edges += [(i, j) for j in rest[near].tolist()]
            found += rest[near].tolist()
            rest = rest[~near]
    return edges


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, d1, d2, sigs): sigs holds the packed signature, and behind it a key for each band."""

    @F.arrow_udf("n_shingles long, d1 long, d2 long, sigs array<long>")
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shingler, hasher, none = Shingler(words), MinHasher(), np.zeros(0, np.uint64)
        for texts in batches:
            rows, sigs = [], []
            for text in texts.to_pylist():
                s = shingler(text)
                rows.append((len(s), digest(s), digest(s, 0x89ABCDEF01)))
                minima = hasher.minima(s) if len(s) else none
                sigs.append(np.concatenate([packed(minima), hasher.keys(minima)]) if len(s) else none)
            numbers = [pa.array(x, pa.int64()) for x in (zip(*rows) if rows else ((),) * 3)]
            yield pa.StructArray.from_arrays([*numbers, lists(sigs)], ["n_shingles", "d1", "d2", "sigs"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), sketch("text").alias("s")).select("doc_id", "text_hash", "s.*")


def bucket_members(reps: DataFrame) -> DataFrame:
    """(band, rep, packed, n, low) for each member of a bucket of several; of buckets with the same members, for one."""
    held = reps.select("rep", F.slice("sigs", 1, PACKED).alias("packed"), F.explode(F.slice("sigs", PACKED + 1, BANDS)).alias("band"))
    buckets = held.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("low"), F.max("rep").alias("high"), F.bit_xor(F.xxhash64("rep")).alias("members"))
    buckets = buckets.filter("low < high").groupBy("n", "low", "high", "members").agg(F.min("band").alias("band")).select("band", "n", "low")
    buckets = stored(buckets, "buckets")
    return stored(might_be_in(held, buckets, "band").join(buckets, "band").select("band", "rep", "packed", "n", "low"), "bucket-members")


def candidate_edges(members: DataFrame, bucket: int) -> DataFrame:
    """(a, b): edges that connect what may be linked in a bucket."""

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: pa.Table) -> pa.RecordBatch:
            rep, flat = (rows[c].combine_chunks() for c in ("rep", "packed"))
            rep, band, signatures = rep.to_numpy(), rows["band"].to_numpy(), flat.flatten().to_numpy().view(np.uint64).reshape(-1, PACKED)
            cuts = np.flatnonzero(np.diff(band)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(band)]])
            two = starts[ends - starts == 2]
            two = two[estimates(signatures[two], signatures[two + 1]) >= LEAST]
            edges = [np.stack([two, two + 1], 1)]
            for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist()):
                edges.append(np.array(spanning(signatures[s:e]), np.int64).reshape(-1, 2) + s)
            ends_of = rep[np.concatenate(edges).astype(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(ends_of[:, 0]), pa.array(ends_of[:, 1])], ["a", "b"])

        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            band = rows["band"].to_numpy()
            whole = int(np.searchsorted(band, band[-1])) if len(band) else 0  # the last bucket may go on
            if whole:
                yield told(rows.slice(0, whole))
            rest = rows.slice(whole)
        if rest is not None and len(rest):
            yield told(rest)

    small = members.filter(F.col("n") <= bucket).select("band", "rep", "packed")
    # A shuffle of its own, so that a bucket isn't split; no bucket is large here.
    connected = small.repartition("band").sortWithinPartitions("band", "rep").mapInArrow(connect, "a long, b long")
    return connected.union(members.filter((F.col("n") > bucket) & (F.col("rep") > F.col("low"))).select("rep", "low"))


def near_copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs."""
    sketched = stored(sketches(docs, words), "sketches")
    reps = stored(set_classes(sketched), "classes")
    members = bucket_members(reps)
    degrees = members.groupBy(F.col("rep").alias("node")).agg(F.sum("n").alias("degree"))
    found = linked_in_regions(docs, sketched, reps, candidate_edges(members, bucket), degrees, words, percent)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s
  FROM w),
c AS (SELECT s, min(doc_id) AS rep FROM (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0) GROUP BY s),
e AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM c),
p AS (
  SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
q AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(a, b) AS (SELECT a, b FROM q UNION SELECT r.a, q.b FROM r JOIN q ON r.b = q.a),
k AS (SELECT a AS rep, least(a, min(b)) AS root FROM r GROUP BY a)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(k.root, c.rep, s.doc_id) AS component_id, coalesce(k.root, c.rep, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON list_sort(s.s) = c.s LEFT JOIN k ON k.rep = c.rep
"""
