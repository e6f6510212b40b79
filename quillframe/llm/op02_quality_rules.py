"""Quality rules: learned decision lists over text statistics, as ordered Spark conditional expressions.

Each text is reduced once to a row of counts. On the labelled rows, sequential covering learns an
ordered list of rules that reject: a rule grows condition by condition (feature <= or > threshold)
by FOIL gain on the growing rows, loses its last conditions while that helps on the pruning rows,
and stays if it is precise enough there. Every step is one aggregate over all labelled rows; the
driver sees histograms of FEATURES x BINS cells only.

Cases: a null or empty text has zero counts and fails the base test (fewer than 50 words). Without
labels, or with labels of one kind, no rule is learned and the base test alone decides. Several
labels of one id: the lowest quality counts. Rows that repeat an id get the same answer. Ties in
gain take the first feature and the lowest threshold. Further columns are ignored, or carried.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import SPACES, fold, read, stored

SPACE_RUN = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
BINS = 32
MAX_RULES, MAX_CONDITIONS = 6, 3
#: A rule stays if at least this share of the labelled rows that it rejects are bad.
MIN_PRECISION = 0.95
MIN_COVERED = 3

#: Rates that rules test, as SQL over the counts.
FEATURES = {
    "symbol_rate": "n_symbols / greatest(word_chars, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "digit_rate": "n_digits / greatest(word_chars, 1)",
    "mark_rate": "n_marks / greatest(word_chars, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
    "words": "cast(n_words as double)",
}


def three_word_windows(words: Column) -> Column:
    """A 64-bit hash of each window of three words."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 4, windows).otherwise(F.array().cast("array<bigint>"))


def text_counts(docs: DataFrame, carry: list[str]) -> DataFrame:
    """carry and the counts of each text."""
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed != "", F.split(trimmed, SPACE_RUN)).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    rows = docs.select(*carry, words.alias("_words"), lines.alias("_lines"), *[count(p).alias(n) for n, p in (("n_symbols", "[#*$%&|<>]"), ("n_upper", r"\p{Lu}"), ("n_digits", "[0-9]"), ("n_marks", "[!?]"))])
    rows = rows.select(*[c for c in rows.columns if c[0] != "_"], F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"), F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), three_word_windows(F.col("_words")).alias("_windows"))
    # Windows sorted with their places: those with an equal neighbour stand twice. By place, each covers
    # three words, less what the one before it covers.
    plain = F.size(F.array_distinct("_windows")) == F.size("_windows")
    rows = rows.withColumn("_sorted", F.when(plain, F.lit(None)).otherwise(F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda i: F.get(F.col("_sorted"), i)["h"]
    twice = F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda i: F.coalesce(at(i) == at(i - 1), F.lit(False)) | F.coalesce(at(i) == at(i + 1), F.lit(False)))
    rows = rows.withColumn("_places", F.when(F.col("_sorted").isNotNull(), F.sort_array(F.transform(twice, lambda i: F.get(F.col("_sorted"), i)["i"]))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate("_places", zero, lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"])
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_windows", "_sorted", "_places")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """feature > cut if above, else feature <= cut; place and bin say the same of the binned row."""

    feature: str
    above: bool
    cut: float
    place: int
    bin: int

    def of_counts(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.cut if self.above else value <= self.cut

    def of_bins(self) -> Column:
        value = F.get(F.col("bins"), F.lit(self.place))
        return value > self.bin if self.above else value <= self.bin

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule, of: str) -> Column:
    return reduce(lambda a, b: a & b, [getattr(c, of)() for c in rule], F.lit(True))


def learn_rules(counts: DataFrame, labels: DataFrame) -> list[Rule]:
    """An ordered list of rules that reject, from all labelled rows that pass the base test."""
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = counts.filter(~base_failed()).join(known, "doc_id").select(
        (F.col("quality") == 0).alias("bad"), (fold(F.col("doc_id"), 3) != 0).alias("grow"), *[F.expr(f).cast("double").alias(n) for n, f in FEATURES.items()]
    )
    rows = stored(rows, "rule-rows")
    shares = [(k + 1) / BINS for k in range(BINS - 1)]
    # Thresholds come from bad and good rows alike, so that the rarer kind is resolved too.
    found = rows.groupBy("bad").agg(*[F.percentile_approx(n, shares, 10_000).alias(n) for n in FEATURES]).collect()  # two rows
    if len(found) < 2:
        return []
    values = {n: sorted({v for r in found for v in r[n]}) for n in FEATURES}
    cuts = {n: [(a + b) / 2 for a, b in zip(v, v[1:])] for n, v in values.items()}  # in the middle of each gap

    def bin_of(name: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts[name]]).cast("array<double>"), lambda c: c < F.col(name)))

    bins = F.array(*map(bin_of, FEATURES))
    binned = stored(rows.select("bad", "grow", bins.alias("bins")), "rule-bins")
    rules: list[Rule] = []
    left = binned
    for _ in range(MAX_RULES):
        rule = grow(left, cuts)
        rule = prune(left, rule) if rule else ()
        if not rule:
            break
        rules.append(rule)
        left = left.filter(~holds(rule, "of_bins"))
    return rules


def grow(left: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    names, rule = list(cuts), ()
    for _ in range(MAX_CONDITIONS):
        cells = left.filter(F.col("grow") & holds(rule, "of_bins")).select("bad", F.posexplode("bins").alias("place", "bin")).groupBy("place", "bin").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).collect()
        table = {(r["place"], r["bin"]): (r["bad"], r["good"]) for r in cells}
        bad, good = (sum(v[k] for (place, _), v in table.items() if place == 0) for k in (0, 1))
        if not bad or not good:
            break
        best, gain = None, 1e-9
        for place, name in enumerate(names):
            below = [0, 0]
            for k, cut in enumerate(cuts[name]):
                one = table.get((place, k), (0, 0))
                below = [below[0] + one[0], below[1] + one[1]]
                for above, (p, n) in ((False, below), (True, (bad - below[0], good - below[1]))):
                    if p >= MIN_COVERED and (g := p * (math.log2(p / (p + n)) - math.log2(bad / (bad + good)))) > gain:
                        best, gain = Condition(name, above, cut, place, k), g
        if best is None:
            break
        rule = (*rule, best)
    return rule


def prune(left: DataFrame, rule: Rule) -> Rule:
    """The start of the rule that does best on the pruning rows; nothing if it isn't precise there and overall."""
    starts = [rule[: k + 1] for k in range(len(rule))]
    sums = [f for k, s in enumerate(starts) for kind, is_bad in (("bad", F.col("bad")), ("good", ~F.col("bad"))) for f in (F.count_if(holds(s, "of_bins") & is_bad & ~F.col("grow")).alias(f"{kind}{k}"), F.count_if(holds(s, "of_bins") & is_bad).alias(f"all_{kind}{k}"))]
    r = left.agg(*sums).first()
    worth = lambda k: (r[f"bad{k}"] - r[f"good{k}"]) / max(r[f"bad{k}"] + r[f"good{k}"], 1)
    k = max(range(len(starts)), key=lambda k: (worth(k), -k))
    bad, good = r[f"all_bad{k}"], r[f"all_good{k}"]
    precise = bad >= MIN_PRECISION * (bad + good) and r[f"bad{k}"] >= MIN_PRECISION * (r[f"bad{k}"] + r[f"good{k}"])
    return starts[k] if precise and bad >= MIN_COVERED else ()


def apply_rules(counts: DataFrame, rules: list[Rule]) -> DataFrame:
    """counts with base_failed, rule (the first that rejects, in words) and kept."""
    verdict = F.when(base_failed(), F.lit("base"))
    for rule in rules:
        verdict = verdict.when(holds(rule, "of_counts"), F.lit(" and ".join(map(str, rule))))
    return counts.withColumns({"base_failed": base_failed(), "rule": verdict}).withColumn("kept", F.col("rule").isNull())


def judge_quality(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """carry (doc_id by default), the counts, base_failed, rule and kept of every row of docs."""
    counts = stored(text_counts(docs, carry or ["doc_id"]), "text-counts")
    return apply_rules(counts, learn_rules(counts, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that base test and rules keep, with all their columns."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    return judge_quality(rows, labels, ["doc_id", "row"]).filter("kept").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
