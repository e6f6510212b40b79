"""LM scoring: a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

The WORDS most frequent words have vectors of their own; other words share those of SUFFIXES classes, by a hash of their last three bytes; start
and end are classes too. The two classes before a token each have a context vector and their position its own matrix:
score(next | before, before that) = (r[before] C1 + r[before that] C2) . q[next] + b[next]. Inside a class of several words a word has its
smoothed share of the class' tokens, with room for one unseen word, so that a text's probability is normalised.

Training sees every training token once, in STEPS steps: each step's texts are spread over all tasks, which draw SHARED noise classes
from the unigram distribution for each block of tokens and return the summed gradient of noise-contrastive
estimation (matrix products of the block's contexts with the noise vectors). A text's step, its place and the noise follow from hashes of id and text, and
gradients are added up in Spark as whole numbers, so that the model doesn't depend on how the texts are stored or dealt to tasks. Adam moves the
parameters, of a fixed size whatever the corpus. Scores are sums of a term for each context, so that one matrix product of their exponentials normalises
all pairs of contexts.

Word counts are a table in Spark. The HEAD most frequent words are broadcast, so that most
tokens are scored where they are; all others meet the count table in a join. A word of more than WORD_BYTES bytes goes by its MD5 and last three bytes.

Cases: a null or empty text is its end token alone. Without training rows every class is as likely. Rows that
repeat an id are scored each on its own. Words seen in no training text count 0 and have their class'
least probability. Words of equal counts rank by their bytes. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import fold, read, stored

FOLDS, HELD_OUT = 7, 2
WORDS, SUFFIXES = 1024, 128
END, START = WORDS + SUFFIXES, WORDS + SUFFIXES + 1
CLASSES = WORDS + SUFFIXES + 2
HEAD, WORD_BYTES = 131_072, 64
DIMENSIONS, STEPS, RATE = 32, 24, 0.03
#: Noise samples a token, and the noise classes that the tokens of a block share.
NOISE, SHARED, BLOCK = 10, 64, 2_048
#: Weight decay, in tokens: what it counts for falls as the corpus grows.
DECAY = 8.0
#: Tasks that add up a step's gradients, and the tokens of a row of training text.
ADDERS, ROW_TOKENS = 16, 131_072
#: Gradients are added as whole numbers of this part, so that their order and the tasks don't matter.
WHOLE = 1 << 20
#: Words whose class a worker remembers before it starts anew.
MEMO = 300_000


def suffix_class(word: bytes) -> int:
    return WORDS + zlib.crc32(word[-3:]) % SUFFIXES


class Vocabulary(dict):
    """word: place in the head, or minus one minus the suffix class of another word."""

    def __init__(self, head: list[bytes]) -> None:
        super().__init__(zip(head, range(len(head))))
        self.size = len(head)

    def __missing__(self, word: bytes) -> int:
        if len(self) < self.size + MEMO:
            self[word] = value = -1 - suffix_class(word)
            return value
        return -1 - suffix_class(word)


def head_classes(head: list[bytes]) -> np.ndarray:
    """The head is by frequency: its first WORDS words have classes of their own."""
    return np.array([k if k < WORDS else suffix_class(w) for k, w in enumerate(head)], np.int64)


def tokens(text: str | None) -> list[bytes]:
    found = (text or "").encode().lower().split()
    if found and max(map(len, found)) > WORD_BYTES:
        found = [w if len(w) <= WORD_BYTES else b" " + hashlib.md5(w).digest() + w[-3:] for w in found]
    return found


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c): every word of the training texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(0).to_pylist():
                counts.update(tokens(text))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

    return stored(train.select("text").mapInArrow(counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


def frequent_words(counts: DataFrame) -> list[tuple[bytes, int]]:
    """(word, count) of at most HEAD words, by falling count and then by word. The least count comes from a histogram of 1/32 octaves."""
    octave = F.floor(F.log2("c") * 32)
    total, least = 0, None
    for r in sorted(counts.groupBy(octave.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).collect(), key=lambda r: -r["k"]):  # 2,016 rows at most
        total += r["n"]
        if total > HEAD:
            break
        least = r["c"]
    if least is None:
        return []
    return sorted(((bytes(r["word"]), r["c"]) for r in counts.filter(F.col("c") >= least).collect()), key=lambda x: (-x[1], x[0]))


def class_ids(words: list[bytes], vocabulary: Vocabulary, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the head, or below 0; and classes."""
    at = np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))
    return at, np.where(at >= 0, classes[np.maximum(at, 0)], -1 - at) if len(classes) else -1 - at


def class_texts(train: DataFrame, head: list[bytes], n_tokens: int) -> DataFrame:
    """(step, ids), written by step: the classes of all training texts, each begun by two starts, as 16-bit numbers in rows of about ROW_TOKENS.

    A hash of id and text says in which step and row a text is, and where in the row: the rows are the same however the texts are stored.
    """
    shared = train.sparkSession.sparkContext.broadcast(head)
    h, rows_of_a_step = F.xxhash64("doc_id", "text"), max(1, -(-n_tokens // (STEPS * ROW_TOKENS)))
    dealt = train.select(h.alias("h"), F.pmod(h, F.lit(STEPS)).cast("int").alias("step"), F.pmod(F.xxhash64(h), F.lit(rows_of_a_step)).alias("row"), "text")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, classes = Vocabulary(shared.value), head_classes(shared.value)
        for batch in batches:
            found = [np.concatenate([[START, START], class_ids(tokens(text), vocabulary, classes)[1], [END]]).astype(np.uint16).tobytes() for text in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], ["h", "step", "row", "ids"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, size = [], None, 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([b"".join(held)], pa.binary())], ["step", "ids"])
        for batch in batches:
            for step, at, ids in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                if held and ((step, at) != now or size >= 2 * ROW_TOKENS):
                    yield row()
                    held, size = [], 0
                now = (step, at)
                held.append(ids)
                size += len(ids)
        if held:
            yield row()

    texts = dealt.mapInArrow(numbered, "h long, step int, row long, ids binary").repartition("step", "row").sortWithinPartitions("step", "row", "h", "ids")
    return stored(texts.mapInArrow(joined, "step int, ids binary"), "class-texts", by="step")


@dataclass
class Parameters:
    """Context vectors, target vectors, the matrices of the two positions, and biases."""

    r: np.ndarray
    q: np.ndarray
    c1: np.ndarray
    c2: np.ndarray
    b: np.ndarray

    @classmethod
    def start(cls, unigram: np.ndarray) -> Parameters:
        rng, shape = np.random.default_rng(11), (CLASSES, DIMENSIONS)
        return cls(rng.normal(0, 0.1, shape), rng.normal(0, 0.1, shape), np.eye(DIMENSIONS), 0.5 * np.eye(DIMENSIONS), np.log(unigram))

    def all(self) -> list[np.ndarray]:
        return [self.r, self.q, self.c1, self.c2, self.b]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.all()])

    @classmethod
    def of_flat(cls, flat: np.ndarray) -> Parameters:
        shapes = [(CLASSES, DIMENSIONS)] * 2 + [(DIMENSIONS, DIMENSIONS)] * 2 + [(CLASSES,)]
        cuts = np.cumsum([0, *(math.prod(s) for s in shapes)])
        return cls(*(flat[a:b].reshape(s) for a, b, s in zip(cuts, cuts[1:], shapes)))


def add(total: np.ndarray, index: np.ndarray, rows: np.ndarray) -> None:
    """Adds to each class of total the rows that have its index."""
    order = np.argsort(index, kind="stable")
    index = index[order]
    first = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    total[index[first]] += np.add.reduceat(rows[order], first, axis=0)


def gradient(ids: np.ndarray, p: Parameters, unigram: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """The summed gradient of noise-contrastive estimation over the tokens of ids, and how many there are.

    Each block of tokens shares SHARED noise classes, which count as NOISE samples a token.
    """
    rng = np.random.default_rng(seed)
    to_first, to_second, to_q, to_b = *(np.zeros((CLASSES, DIMENSIONS)) for _ in range(3)), np.zeros(CLASSES)
    r, q, c1, c2, b = (x.astype(np.float32) for x in p.all())
    by_first, by_second, offset = r @ c1, r @ c2, np.log(NOISE * unigram).astype(np.float32)
    at = np.flatnonzero(ids[2:] != START) + 2
    ids = ids.astype(np.int64)
    cumulated = np.cumsum(unigram)
    for k in range(0, len(at), BLOCK):
        here = at[k : k + BLOCK]
        x1, x2, w = ids[here - 1], ids[here - 2], ids[here]
        context = by_first[x1] + by_second[x2]
        noise = np.minimum(np.searchsorted(cumulated, rng.random(SHARED) * cumulated[-1]), CLASSES - 1)
        of_data = np.einsum("ij,ij->i", context, q[w]) + b[w] - offset[w]
        of_noise = context @ q[noise].T + (b[noise] - offset[noise])
        up = -1.0 / (1.0 + np.exp(np.clip(of_data, -30, 30)))
        down = np.float32(NOISE / SHARED) / (1.0 + np.exp(np.clip(-of_noise, -30, 30)))
        to_context = up[:, None] * q[w] + down @ q[noise]
        for total, index, rows in ((to_q, w, up[:, None] * context), (to_b, w, up), (to_first, x1, to_context), (to_second, x2, to_context)):
            add(total, index, rows)
        add(to_q, noise, down.T @ context)
        add(to_b, noise, down.sum(axis=0))
    return Parameters(to_first @ c1.T + to_second @ c2.T, to_q, r.T @ to_first, r.T @ to_second, to_b).flat(), len(at)


def train_nce(texts: DataFrame, unigram: np.ndarray) -> Parameters:
    """One pass over texts (step, ids), a step at a time."""
    params, spark = Parameters.start(unigram), texts.sparkSession
    flat = params.flat()
    first, second, trained = np.zeros_like(flat), np.zeros_like(flat), False
    for step in range(STEPS):
        shared = spark.sparkContext.broadcast((flat, unigram))

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, unigram = shared.value  # noqa: B023
            total, n = np.zeros(now.shape, np.int64), 0
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    g, m = gradient(np.frombuffer(raw, np.uint16), Parameters.of_flat(now), unigram, zlib.crc32(raw))
                    total, n = total + np.rint(g * WHOLE).astype(np.int64), n + m
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["g", "n"])

        def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = None, 0
            for batch in batches:
                for raw, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    g = np.frombuffer(raw, np.int64)
                    total, n = g if total is None else total + g, n + m
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["g", "n"])

        parts = texts.filter(F.col("step") == step).select("ids").mapInArrow(summed, "g binary, n long")
        found = parts.repartition(ADDERS).mapInArrow(more, "g binary, n long").collect()  # ADDERS rows of the parameters' size
        n = sum(x["n"] for x in found)
        if not n:
            continue
        trained = True
        grad = sum(np.frombuffer(x["g"], np.int64) for x in found) / (n * WHOLE)
        decayed = Parameters.of_flat(flat.copy())
        decayed.c1[:], decayed.c2[:], decayed.b[:] = 0, 0, 0
        grad += DECAY / (n * STEPS) * decayed.flat()
        first += 0.1 * (grad - first)
        second += 0.05 * (grad * grad - second)
        rate = RATE * min(1.0, 2.0 * (1.0 - step / (STEPS + 1)))
        flat = flat - rate * (first / (1 - 0.9 ** (step + 1))) / (np.sqrt(second / (1 - 0.95 ** (step + 1))) + 1e-6)
    return Parameters.of_flat(flat if trained else np.zeros_like(flat))


@dataclass
class Model:
    """What scores texts. log10 of a class' probability: by_first[before, next] + by_second[before that, next] - norm[before, before that]."""

    head: list[bytes]
    head_log: np.ndarray  # log10 of counts and one
    below: np.ndarray  # log10 of the tokens that share a class, and room for unseen ones; 0 where a word is its class
    by_first: np.ndarray
    by_second: np.ndarray
    norm: np.ndarray
    n_train: int
    n_all: int
    v_all: int


def tables(p: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 scores of each context and next class, and of the sums over next classes for each pair of contexts."""
    first, second = (p.r @ p.c1) @ p.q.T, (p.r @ p.c2) @ p.q.T + p.b
    second[:, START] = -np.inf  # never follows
    high1, high2 = first.max(axis=1, keepdims=True), second.max(axis=1, keepdims=True)
    norm = np.log(np.maximum(np.exp(first - high1) @ np.exp(second - high2).T, 1e-300)) + high1 + high2.T
    second[:, START] = -1e30
    return tuple((x / math.log(10)).astype(np.float32) for x in (first, second, norm))


def fit(train: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and (word, c) of all training words."""
    counts = word_counts(train)
    n_train = train.count()
    frequent = frequent_words(counts)
    head = [w for w, _ in frequent]
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    last = F.when(F.length("word") <= 3, F.col("word")).otherwise(F.substring("word", -3, 3))
    by_class = counts.groupBy((F.crc32(last) % SUFFIXES).cast("int").alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()  # SUFFIXES rows
    class_n, class_v = np.zeros(SUFFIXES), np.zeros(SUFFIXES)
    for r in by_class:
        class_n[r["k"]], class_v[r["k"]] = r["n"], r["v"]
    for word, c in frequent[:WORDS]:
        class_n[suffix_class(word) - WORDS] -= c
        class_v[suffix_class(word) - WORDS] -= 1
    below = np.zeros(CLASSES)
    below[WORDS:END] = np.log10(class_n + class_v + 1)
    unigram = np.full(CLASSES, 0.5)
    unigram[: len(frequent[:WORDS])] += [c for _, c in frequent[:WORDS]]
    unigram[WORDS:END] += class_n
    unigram[END] += n_train
    unigram /= unigram.sum()
    params = train_nce(class_texts(train, head, totals["n"] + n_train), unigram)
    return Model(head, np.log10(np.array([c for _, c in frequent], float) + 1), below, *tables(params), n_train, totals["n"] + n_train, totals["v"] + (n_train > 0)), counts


def score_texts(docs: DataFrame, train: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), one row for each row of docs."""
    return score_with(docs, *fit(train))


def score_with(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("n_tokens long, known long, base double, own double, rare array<struct<word:binary,n:long>>")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        vocabulary, classes = Vocabulary(m.head), head_classes(m.head)
        end_log, end_known = math.log10(m.n_train + 1), int(m.n_train > 0)
        for texts in batches:
            rows, rare = [], []
            for text in texts.to_pylist():
                words = tokens(text)
                at, ids = class_ids(words, vocabulary, classes)
                seen = at[at >= 0]
                before, that, then = np.append(START, ids), np.append([START, START], ids[:-1]) if len(ids) else np.array([START]), np.append(ids, END)
                log = m.by_first[before, then].astype(float) + m.by_second[that, then] - m.norm[before, that]
                logs = m.head_log[seen]
                rows.append((len(words) + 1, len(seen) + end_known, float(logs.sum()) + end_log, float(log.sum() + logs[seen >= WORDS].sum() - m.below[ids].sum())))
                rare.append([{"word": w, "n": n} for w, n in Counter(words[k] for k in np.flatnonzero(at < 0)).items()])
            n, known, base, own = zip(*rows) if rows else ((),) * 4
            columns = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64()), pa.array(rare, pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))]
            yield pa.StructArray.from_arrays(columns, ["n_tokens", "known", "base", "own", "rare"])

    parts = stored(docs.select("doc_id", scored("text").alias("s")).select(F.monotonically_increasing_id().alias("key"), "doc_id", "s.*"), "lm-parts")
    rare = parts.select("key", F.explode("rare").alias("r")).select("key", "r.word", "r.n").join(counts, "word")
    tails = rare.groupBy("key").agg(F.sum("n").alias("tail_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("tail"))
    found = parts.drop("rare").join(tails, "key", "left")
    tail = F.coalesce("tail", F.lit(0.0))
    return found.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(model.n_all).cast("long").alias("train_tokens"),
        (F.col("base") + tail - F.col("n_tokens") * F.lit(math.log10(model.n_all + model.v_all + 1))).alias("base_score"), (F.col("own") + tail).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    scored = score_texts(docs, docs.filter(~held_out))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
