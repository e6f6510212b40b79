"""Operators 11, 12 and 13 against plain loops."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.llm import op11_filter_audit as op11
from quillframe.llm import op12_merkle_manifest as op12
from quillframe.llm import op13_minhash_dedup as op13
from quillframe.llm.op07_ngram_jaccard_join import Shingler

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


# 11: every row through every order, one by one


def audited(rows, labels):
    """rows of (doc_id, text, lang); labels of (doc_id, quality, toxic)."""
    firsts = {}
    for i, t, _ in rows:
        if i is not None:
            firsts[t or ""] = min(firsts.get(t or "", i), i)
    found = {}
    for i, t, lang in rows:
        t, part = t or "", lang or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and firsts[t] < i,
        }
        good = any(k == i and q == 1 for k, q, _ in labels if i is not None)
        toxic = any(k == i and x == 1 for k, _, x in labels if i is not None)
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                row = found.setdefault((part, "".join(order), step), dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"), 0))
                row["redundant"] += gone and fails[f]
                row["unique_fails"] += fails[f] and sum(fails.values()) == 1
                if not gone and fails[f]:
                    gone = True
                    row["removed"] += 1
                    row["good_lost"] += good
                    row["toxic_lost"] += toxic
                row["kept"] += not gone
    for (part, order, step), row in found.items():
        row["shapley"] = sum(r["removed"] for (p, o, s), r in found.items() if p == part and o[s - 1] == order[step - 1])
    return found


def collected(df):
    return {(r["part"], r["filter_order"], r["step"]): {k: v for k, v in r.asDict().items() if k not in ("part", "filter_order", "step")} for r in df.collect()}


def test_audit_against_replay(spark, odd_rows, words):
    rng = random.Random(11)
    texts = [words(120, 1), words(120, 1), words(120, 2) + " #", "SHOUT " * 110, "A B C " * 60, words(99, 3), words(100, 4), None, "", "same", "same", "same"]
    rows = [(k, t, rng.choice(["en", "de", None, ""])) for k, t in enumerate(texts)]
    rows += [(i, t, "en") for i, t in odd_rows]
    labels = [(0, 1, 0), (0, 0, 0), (1, 1, 1), (3, 0, 1), (4, None, None), (None, 1, 1), (7, 1, 0), (999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("fails", "part", "steps", "first", "good", "toxic", "digest", "quality", "words"):
        docs = docs.withColumn(name, F.lit("x"))
    marks = spark.createDataFrame(labels, LABELS).withColumn("text", F.lit("x"))
    got = collected(op11.audit(docs, marks))
    assert got == audited(rows, labels)
    assert {p for p, _, _ in got} == {"en", "de", ""} and len(got) == 600 * 3


def test_audit_of_no_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert op11.audit(none, spark.createDataFrame([], LABELS)).count() == 0
    one = spark.createDataFrame([(1, "x", "en")], "doc_id long, text string, lang string")
    assert collected(op11.audit(one, spark.createDataFrame([], LABELS))) == audited([(1, "x", "en")], [])


# 12: one list of leaves after another


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row):
    return digest(*map(told, (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"])))


def climbed(leaves):
    """The root, and each leaf's steps of (hashes to the left, to the right)."""
    level, paths, under = list(leaves), [[] for _ in leaves], [[k] for k in range(len(leaves))]
    while len(level) > 1:
        runs = [range(k, min(k + 3, len(level))) for k in range(0, len(level), 3)]
        for run in runs:
            for k in run:
                for at in under[k]:
                    paths[at].append(("".join(level[j] for j in run if j < k), "".join(level[j] for j in run if j > k)))
        under = [[at for k in run for at in under[k]] for run in runs]
        level = [digest(*(level[k] for k in run)) for run in runs]
    return level[0], paths


def manifest_of(rows):
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        mine = sorted((r for r in rows if r["source"] == s), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees.append((mine, *climbed([leaf_of(r) for r in mine])))
    root, outer = climbed([t[1] for t in trees])
    found = []
    for (mine, subroot, paths), above in zip(trees, outer):
        for r, path in zip(mine, paths):
            steps, text = path + above, r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            h = leaf_of({**r, "text": text})
            for left, right in steps:
                h = digest(left, h, right)
            found.append((r["doc_id"], leaf_of(r), subroot, root, digest(*(a + b for a, b in steps)), h, h == root))
    return found


def told_by_spark(docs, levels):
    tampers = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(tampers, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = op12.manifest(docs, {"tampered": op12.leaf(*map(F.col, op12.FIELDS[:-1]), text)}, levels)
    l, r = F.col("lefts"), F.col("rights")
    h = op12.folded(F.col("tampered"), l, r)
    return [tuple(x) for x in got.select("doc_id", "h", "subroot", "root", F.sha2(op12.proof_text(l, r), 256), h, h == F.col("root")).collect()]


@pytest.mark.parametrize("levels", [1, 2, op12.LEVELS])
def test_manifest_against_lists(spark, levels):
    """Sources of 1 to 40 documents, many small ones, null and empty ones; rounds of blocks of 3, 9 and 2,187."""
    rng = random.Random(12)
    rows = [(k, rng.choice(["a\nb", "é\U0001f600\n", "", None, "x", "\n"]), rng.choice(["en", None]), "hot" if k % 3 else rng.choice(["s0", "s1", None, ""]), rng.choice([k, None])) for k in range(60)]
    rows += [(1000 + k, f"t\n{k}", "en", f"lone{k}", k) for k in range(14)] + [(None, "n\n", None, "hot", None), (5, "again", "en", "hot", 1), (5, "again", "en", "hot", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = manifest_of([r.asDict() for r in docs.collect()])
    for name in ("tree", "pos", "n", "h", "pack", "block", "root", "under", "_id", "_0", "lefts"):
        docs = docs.withColumn(name, F.lit("x"))
    got = told_by_spark(docs.repartition(5), levels)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {True, False} == {r[-1] for r in got} and len({r[3] for r in got}) == 1


def test_manifest_of_one_row_and_of_none(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert told_by_spark(spark.createDataFrame([], schema), 2) == []
    one = spark.createDataFrame([(2, "a", "en", "s", 1)], schema)
    h = leaf_of(one.first().asDict())
    assert told_by_spark(one, 2) == [(2, h, h, h, digest(), h, True)]


def test_rows_are_told_apart(spark):
    """No field's content can pass for another's."""
    a = spark.createDataFrame([(1, "x", "en", "s1:", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    b = a.withColumns({"source": F.lit("s"), "lang": F.lit("1:en")})
    c = a.withColumn("text", F.lit(None).cast("string"))
    d = a.withColumn("text", F.lit("-"))
    leaves = [df.select(op12.leaf(*map(F.col, op12.FIELDS)).alias("h")).first()["h"] for df in (a, b, c, d)]
    assert len(set(leaves)) == 4


# 13: all pairs of sets


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def linked_groups(rows):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def edited(text, n, rng):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def copies(words):
    """Near copies on both sides of the threshold, chains, a passage that many texts share, a larger group, tiny and empty texts."""
    rng, rows, base = random.Random(13), [], [words(n, n) for n in (9, 14, 30, 80, 200, 500)]
    for text in base:
        rows += [text, text.upper()] + [edited(text, k, rng) for k in range(1, max(2, len(text.split()) // 12)) for _ in range(2)]
        chain = text
        for _ in range(5):
            chain = edited(chain, max(1, len(text.split()) // 40), rng)
            rows.append(chain)
    passage, core = words(60, 99), words(150, 77)
    rows += [passage + " " + words(30 + k, 200 + k) for k in range(12)] + [edited(core, k % 7, rng) for k in range(40)]
    rows += ["a", "A", "a b", "b a", "a b c d", "A B  C D", "a b c d e", "", None, " \n"]
    return [(k * 3 % 1009, t) for k, t in enumerate(rows)]


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


@pytest.mark.parametrize("bucket", [op13.BUCKET, 4])
def test_near_copies_against_brute_force(frame, copies, bucket):
    """With buckets compared by signatures, and with nearly all of them too large for that."""
    got = found(op13.near_copies(frame(copies, clash=True), bucket=bucket))
    assert got == linked_groups(copies)
    assert sum(not kept for _, _, kept in got.values()) > 60


def test_near_copies_of_odd_rows(spark, frame, odd_rows):
    assert op13.near_copies(frame([])).count() == 0
    rows = op13.near_copies(frame(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {(i, i) for i, _ in odd_rows} and all(r["kept"] for r in rows)
    with_null = frame([(7, "one two three four five"), (None, "One two three four five"), (None, "six seven eight nine"), (9, "six seven eight nine"), (3, "six seven eight nine")])
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in op13.near_copies(with_null).collect()) == [("3", 3, True), ("7", 7, True), ("9", 3, False), ("None", 3, False), ("None", 7, False)]


def test_estimates_are_corrected_for_chance(words):
    """Near the true similarity for texts alike and unlike, and never so far below 0.8 that a link is lost."""
    rng, hasher, shingler = random.Random(3), op13.MinHasher(), Shingler(4)
    off = []
    for k in range(60):
        a = words(300, 900 + k)
        b = words(300, 5000 + k) if k % 3 == 0 else edited(a, rng.randrange(1, 60), rng)
        x, y = shingler(a), shingler(b)
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        near = op13.estimates(op13.packed(hasher.minima(x))[None], op13.packed(hasher.minima(y)))[0]
        off.append(near - true)
        assert abs(near - true) < 0.25 and (true < 0.8 or near >= op13.LEAST)
    assert abs(np.mean(off)) < 0.03


def test_minima_in_chunks_and_packing(words, monkeypatch):
    hasher, s = op13.MinHasher(), Shingler(4)(words(700, 1))
    whole = hasher.minima(s)
    monkeypatch.setattr(op13, "CHUNK", 37)
    assert (hasher.minima(s) == whole).all() and len(hasher.keys(whole)) == op13.BANDS == len(set(hasher.keys(whole).tolist()))
    bits = [int(w) >> (op13.BITS * k) & (1 << op13.BITS) - 1 for w in op13.packed(whole) for k in range(64 // op13.BITS)]
    assert bits == [int(m) & (1 << op13.BITS) - 1 for m in whole]


def test_edges_connect_what_estimates_connect():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, (4, op13.PACKED)).astype(np.uint64)
    signatures = np.concatenate([np.repeat(c[None], 6, 0) for c in centres])
    for k in range(len(signatures)):
        signatures[k, k % op13.PACKED] ^= np.uint64(int(rng.integers(0, 2**60)))
    edges = op13.spanning(signatures)
    groups = {i: {i} for i in range(len(signatures))}
    for i, j in edges:
        both = groups[i] | groups[j]
        for k in both:
            groups[k] = both
    near = np.array([op13.estimates(signatures, s) >= op13.LEAST for s in signatures])
    assert len(edges) == 20 and all(j in groups[i] for i, j in zip(*np.nonzero(near)))
