"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL-proximal updates.

Words, word pairs, word shapes and pairs of shapes are hashed to one weight vector; a document is
the sparse vector of their shares, and its score the logistic function of the dot product. The
weights (2 MB) are broadcast; scoring is a scalar pandas UDF, so any columns can be carried.

Training uses TRAIN_ROWS labelled documents at most, those with the lowest hash of their id, of
the folds that aren't held out. Everything else covers every row and every whole text.

Cases: a null or empty text has no features, and the bias alone scores it. Without labels every
score is 0.5. Several labels of one id: the lowest quality counts. Rows that repeat an id are
scored each on its own. An input column with the score's name is replaced by with_scores; keep_good
returns every input column as it was. Labels, lang, source and doc_id never enter a score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import fold, read

FOLDS, HELD_OUT = 4, 2
#: Labelled documents to train on, at most: the bound of the driver's sample.
TRAIN_ROWS = 3_000
BITS = 18
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.05
#: Shares are small numbers; this brings them near the size of the bias.
SCALE = 6.0
THRESHOLD = 0.7
#: Words whose hashes a worker remembers before it starts anew.
MEMO = 300_000

_CLASSES = bytes(
    ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256)
)
_RUNS = re.compile(rb"(.)\1+", re.S)
_MASK = np.uint64((1 << BITS) - 1)


class WordHashes(dict):
    """word: hash of the word in the high 32 bits, of its shape (runs of A, a, 0 and marks) in the low ones."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        shape = _RUNS.sub(rb"\1", word.translate(_CLASSES))
        self[word] = value = zlib.crc32(word) << 32 | zlib.crc32(shape)
        return value


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """Indexes into the weight vector."""
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - BITS)) & _MASK


def feature_blocks(text: str | None, hashes: WordHashes) -> list[np.ndarray]:
    """Indexes of the words, word pairs, shapes and shape pairs of a text."""
    words = (text or "").encode().split()
    if not words:
        return []
    both = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    raw, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    pair = lambda x: x[:-1] * np.uint64(0x100000001B3) + x[1:]
    blocks = [_mix(raw, 1), _mix(pair(raw), 2), _mix(shape, 3), _mix(pair(shape), 4)]
    return [b for b in blocks if len(b)]


def sparse_vector(text: str | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indexes and values: each block's shares, scaled."""
    blocks = feature_blocks(text, hashes)
    if not blocks:
        return np.zeros(0, np.int64), np.zeros(0)
    index = np.concatenate(blocks).astype(np.int64)
    value = np.concatenate([np.full(len(b), SCALE / len(b)) for b in blocks])
    distinct, where = np.unique(index, return_inverse=True)
    return distinct, np.bincount(where, weights=value)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """FTRL-proximal over (label, indexes, values); weights and bias."""
    size = (1 << BITS) + 1  # the last is the bias
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            label, index, value = rows[k]
            at, x = np.append(index, size - 1), np.append(value, 1.0)
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:-1], float(w[-1])


def training_rows(docs: DataFrame, labels: DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The sample: TRAIN_ROWS ids by hash, their documents found through a broadcast of so many rows."""
    known = labels.filter("quality in (0, 1) and doc_id is not null").filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # Only ids that occur count, lest labels of absent rows fill the sample.
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            found = [sparse_vector(t, hashes) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "at": [i.astype(np.int32).tobytes() for i, _ in found], "x": [v.astype(np.float32).tobytes() for _, v in found]})

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, quality int, at binary, x binary"
    found = rows.mapInPandas(vectors, schema).dropDuplicates(["doc_id"]).orderBy("doc_id").collect()  # TRAIN_ROWS at most
    return [(r["quality"], np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["x"], np.float32).astype(float)) for r in found]


def with_scores(docs: DataFrame, labels: DataFrame, column: str = "score") -> DataFrame:
    """docs and the score of each text, 0 to 1."""
    rows = training_rows(docs, labels)
    weights, bias = train(rows) if rows else (np.zeros(1 << BITS), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, b = shared.value
        hashes = WordHashes()
        for texts in batches:
            dots = [b + SCALE * sum(float(w[block.astype(np.int64)].mean()) for block in feature_blocks(t, hashes)) for t in texts]
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(np.array(dots), -35, 35))))

    return docs.withColumn(column, score("text"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score reaches THRESHOLD, with all their columns."""
    name = "_quality_score"
    while name in map(str.lower, docs.columns):
        name += "_"
    return with_scores(docs, labels, name).filter(F.col(name) >= THRESHOLD).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = with_scores(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
