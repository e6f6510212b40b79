"""Operators 1 and 2."""

import itertools
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillframe.llm import op01_quality_classifier as op1
from quillframe.llm import op02_quality_rules as op2
from quillframe.llm.common import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def graded(spark, frame, words):
    """Plain prose is good, shouted prose and prose with symbols is bad."""
    rows = [(i, words(70, i)) for i in range(240)] + [(i, words(70, i).upper().replace(" ", "!! ")) for i in range(240, 320)] + [(i, words(70, i).replace(" ", "### ")) for i in range(320, 400)]
    labels = spark.createDataFrame([(i, int(i < 240), 0) for i, _ in rows if i % 2 == 0], "doc_id long, quality int, toxic int")
    return frame(rows), labels


def test_classifier_on_held_out_rows(graded):
    docs, labels = graded
    scored = {r["doc_id"]: r["score"] for r in op1.with_scores(docs, labels).collect()}
    unseen = [(i, s) for i, s in scored.items() if i % 2]
    assert sum((s >= op1.THRESHOLD) == (i < 240) for i, s in unseen) >= 0.98 * len(unseen)


def test_classifier_trains_on_other_folds_only(graded):
    docs, labels = graded
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (op1.with_scores(docs, x).select("doc_id", "score").orderBy("doc_id").collect() for x in (labels, flipped))
    assert a == b


def plain_scores(docs, marks):
    """Hashing, FTRL updates and dot products one number at a time; docs are (id, text), marks label some of their ids."""

    def kind(b):
        return "A" if 65 <= b <= 90 else "a" if 97 <= b <= 122 or b >= 128 else "0" if 48 <= b <= 57 else chr(b)

    def vector(text):
        w = (text or "").encode().split()
        raw = [zlib.crc32(x) for x in w]
        shapes = [zlib.crc32(re.sub(r"(.)\1+", r"\1", "".join(map(kind, x)), flags=re.S).encode("latin-1")) for x in w]
        place = lambda h, salt: ((h + salt) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - op1.BITS)
        pairs = lambda h: [(a * 0x100000001B3 + b) % 2**64 for a, b in zip(h, h[1:])]
        out = Counter()
        for salt, block in enumerate((raw, pairs(raw), shapes, pairs(shapes)), 1):
            for h in block:
                out[place(h, salt)] += op1.SCALE / len(block)
        return out

    known = [(marks[i], {k: float(op1.np.float32(v)) for k, v in sorted(vector(t).items())}) for i, t in docs if i in marks and zlib.crc32(str(i).encode()) % 4 != 2]
    z, n = Counter(), Counter()

    def weight(k):
        return 0.0 if abs(z[k]) <= op1.L1 else -(z[k] - math.copysign(op1.L1, z[k])) / ((op1.BETA + math.sqrt(n[k])) / op1.ALPHA + op1.L2)

    order = op1.np.random.default_rng(7)
    for _ in range(op1.EPOCHS):
        for row in order.permutation(len(known)):
            label, x = known[row]
            x = {**x, "bias": 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - label) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / op1.ALPHA * w[k]
                n[k] += g * g
    return {i: 1 / (1 + math.exp(-weight("bias") - sum(weight(k) * v for k, v in vector(t).items()))) for i, t in docs}


def test_scores_against_plain_loops(spark, frame, words):
    docs = [(i, words(12, i) + (" Shout!! 9" if i % 3 == 0 else "")) for i in range(40)] + [(50, None), (51, "one")]
    marks = {i: int(i % 3 > 0) for i in range(30)}
    labels = spark.createDataFrame([(i, q, 0) for i, q in marks.items()], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in op1.with_scores(frame(docs), labels).collect()}
    assert got == {i: pytest.approx(s, abs=1e-6) for i, s in plain_scores(docs, marks).items()}


def test_classifier_odd_rows(spark, frame, odd_rows, graded):
    scored = op1.with_scores(frame(odd_rows, clash=True), graded[1]).collect()
    assert len(scored) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in scored)
    assert len({r["score"] for r in scored if r["doc_id"] in (2, 3, 4)}) == 1
    assert op1.with_scores(frame([]), graded[1]).count() == 0
    assert {r["score"] for r in op1.with_scores(frame(odd_rows), graded[1].limit(0)).collect()} == {0.5}


def test_classifier_stage_keeps_columns(graded):
    docs, labels = graded
    kept = op1.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id < 240").count() >= 238


def test_classifier_stage_on_odd_rows(frame, odd_rows, graded):
    docs = frame(odd_rows, clash=True).withColumn("_quality_score", F.lit(0.0)).withColumn("_QUALITY_score_", F.lit("x"))
    kept = op1.keep_good(docs, graded[1])
    rows = kept.collect()
    want = [r["doc_id"] for r in op1.with_scores(frame(odd_rows), graded[1]).collect() if r["score"] >= op1.THRESHOLD]
    assert kept.columns == docs.columns and sorted(map(str, want)) == sorted(str(r["doc_id"]) for r in rows) and rows
    assert {(r["score"], r["_quality_score"]) for r in rows} == {("x", 0.0)}
    assert op1.keep_good(frame([]), graded[1]).count() == 0


def counted(text):
    w = WORD.findall(text or "")
    seen = Counter(zip(w, w[1:], w[2:]))
    repeated = {k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_counts_against_brute_force(frame, odd_rows, words):
    rows = odd_rows + [(20, "x y z x y z w"), (21, "a a a a"), (22, "l one\nl one\n\nl one \nb"), (23, words(40, 3) + "\n" + words(60, 4) + "\n" + words(40, 3)), (24, "a b a b a b")]
    got = op2.text_counts(frame(rows), ["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counted(r["text"]), r["doc_id"]


def test_rules_reject_what_is_bad(graded):
    docs, labels = graded
    judged = op2.judge_quality(docs, labels)
    found = {(r["bad"], r["kept"]): r["count"] for r in judged.groupBy((F.col("doc_id") >= 240).alias("bad"), "kept").count().collect()}
    assert found == {(False, True): 240, (True, False): 160}
    rules = op2.learn_rules(stored(op2.text_counts(docs, ["doc_id"]), "counts"), labels)
    assert 1 <= len(rules) <= op2.MAX_RULES


def rates(text):
    """The features of a text, from its definition."""
    n, chars, symbols, dup, repeat = counted(text)
    lines = max(sum(WORD.search(x) is not None for x in (text or "").split("\n")), 1)
    share = lambda keep: sum(map(keep, text or "")) / max(chars, 1)
    return {
        "symbol_rate": symbols / max(chars, 1), "upper_rate": share(lambda c: unicodedata.category(c) == "Lu"), "digit_rate": share(lambda c: c in "0123456789"), "mark_rate": share(lambda c: c in "!?"),
        "dup_line_rate": dup / lines, "repeat_rate": repeat / max(n, 1), "word_length": chars / max(n, 1), "line_words": n / lines, "words": float(n),
    }


def covering(rows):
    """Sequential covering row by row: rows are (bad, grow, rates); a rule is a list of (feature, above, cut)."""
    cuts = {}
    for name in op2.FEATURES:
        found = set()
        for kind in (True, False):
            v = sorted(r[name] for bad, _, r in rows if bad == kind)
            if not v:
                return []
            found |= {v[math.ceil(len(v) * k / op2.BINS) - 1] for k in range(1, op2.BINS)}
        cuts[name] = [(a + b) / 2 for a, b in itertools.pairwise(sorted(found))]

    def covers(rule, r):
        return all(r[name] > cut if above else r[name] <= cut for name, above, cut in rule)

    def split(rule, which):
        hit = [bad for bad, _, r in which if covers(rule, r)]
        return sum(hit), len(hit) - sum(hit)

    rules, left = [], rows
    for _ in range(op2.MAX_RULES):
        growing, pruning = [x for x in left if x[1]], [x for x in left if not x[1]]
        rule = []
        for _ in range(op2.MAX_CONDITIONS):
            bad, good = split(rule, growing)
            best, most = None, 1e-9
            for one in ((name, above, cut) for name in cuts for cut in cuts[name] for above in (False, True)) if bad and good else ():
                p, n = split([*rule, one], growing)
                if p >= op2.MIN_COVERED and (gain := p * (math.log2(p / (p + n)) - math.log2(bad / (bad + good)))) > most:
                    best, most = one, gain
            if best is None:
                break
            rule.append(best)
        worth = []
        for k in range(len(rule)):
            p, n = split(rule[: k + 1], pruning)
            worth.append((p - n) / max(p + n, 1))
        rule = rule[: worth.index(max(worth)) + 1] if worth else []
        whole, part = split(rule, left), split(rule, pruning)
        if not rule or whole[0] < op2.MIN_COVERED or any(p < op2.MIN_PRECISION * (p + n) for p, n in (whole, part)):
            break
        rules.append(rule)
        left = [x for x in left if not covers(rule, x[2])]
    return rules


def plain_rules(rows, marks):
    """The rules that covering finds for rows (id, text) with labels marks (id, quality), and what they and the base test reject."""
    lowest = {}
    for i, q in marks:
        lowest[i] = min(q, lowest.get(i, 1))
    failed = lambda t: (c := counted(t))[0] < op2.MIN_WORDS or 100 * c[4] > 50 * c[0]
    rules = covering([(lowest[i] == 0, zlib.crc32(str(i).encode()) % 3 != 0, rates(t)) for i, t in rows if i in lowest and not failed(t)])
    rejects = lambda t: failed(t) or any(all(rates(t)[f] > cut if above else rates(t)[f] <= cut for f, above, cut in r) for r in rules)
    return rules, rejects


@pytest.mark.parametrize("seed", [1, 3])
def test_rules_against_row_by_row_covering(spark, frame, words, seed):
    """Several overlapping kinds of bad text, labels with errors, repeated rows and ids, and rows without labels."""
    rng = random.Random(seed)

    def text(i):
        w = words(rng.randint(40, 90), i + 1000 * seed).split()
        for kind, share in ((str.upper, rng.choice([0, 0, 0.1, 0.5])), (lambda x: x + "#", rng.choice([0, 0, 0.1, 0.4])), (lambda x: x + "?!", rng.choice([0, 0, 0.2]))):
            w = [kind(x) if rng.random() < share else x for x in w]
        return "".join(x + rng.choice([" ", " ", " ", "\n"]) for x in w) + (" " + " ".join(w[:12]) if rng.random() < 0.2 else "")

    rows = [(i, text(i)) for i in range(400)]
    rows += rows[:10] + [(3, text(900)), (900, None), (901, "")]
    shouts = {i for i, t in rows if (f := rates(t)) and (f["symbol_rate"] > 0.03 or f["upper_rate"] > 0.3 and f["words"] < 80)}
    marks = [(i, int((i not in shouts) != (rng.random() < 0.01))) for i in range(380)] + [(5, 0), (900, 0), (901, 1), (7000, 0)]
    labels = spark.createDataFrame([(i, q, 0) for i, q in marks], "doc_id long, quality int, toxic int")

    want, rejects = plain_rules(rows, marks)
    assert want
    counts = stored(op2.text_counts(frame(rows), ["doc_id", "text"]), "counts")
    got = op2.learn_rules(counts, labels)
    assert [[(c.feature, c.above, c.cut) for c in r] for r in got] == want
    judged = op2.apply_rules(counts, got).collect()
    assert len(judged) == len(rows) and all(r["kept"] != rejects(r["text"]) for r in judged)


def test_rules_odd_rows(frame, odd_rows, graded):
    labels = graded[1]
    judged = op2.judge_quality(frame(odd_rows, clash=True), labels).collect()
    assert len(judged) == len(odd_rows)
    assert all(r["base_failed"] and not r["kept"] for r in judged if r["doc_id"] in (2, 3, 4, 5, 6, 8, 9))
    assert all(r["kept"] for r in judged if r["doc_id"] == 1)
    assert op2.judge_quality(frame([]), labels).count() == 0
    assert op2.learn_rules(op2.text_counts(frame(odd_rows), ["doc_id"]), labels.limit(0)) == []
    kept = op2.keep_good(frame(odd_rows, clash=True), labels)
    assert kept.columns == frame(odd_rows, clash=True).columns and {r["doc_id"] for r in kept.collect()} == {1, 7}
