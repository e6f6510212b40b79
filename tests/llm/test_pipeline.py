"""The whole pipeline on a small table, each stage's rows against plain loops over the rows of the stage before."""

import hashlib
import itertools
import math
import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from quillframe.llm import op01_quality_classifier as op1
from quillframe.llm import op09_packing as op9
from quillframe.llm import op10_mixing as op10

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def first_of_groups(rows):
    """Of rows that reach each other by links of 80 percent, the one with the smallest id."""
    sets, root = {r["doc_id"]: shingles(r["text"]) for r in rows}, {r["doc_id"]: r["doc_id"] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [r for r in rows if find(r["doc_id"]) == r["doc_id"]]


def mixed(rows):
    """Each row as often as a Poisson draw from hashes of its id says, for its source's mean."""
    n = Counter(r["source"] for r in rows)
    weight = {s: c**op10.TEMPERATURE for s, c in n.items()}
    kept = []
    for r in rows:
        mean = weight[r["source"]] / sum(weight.values()) * len(rows) / n[r["source"]]
        draws = max(math.ceil(mean / op10.LAMBDA_STEP), 1)
        for j in range(1, draws + 1):
            u = int(hashlib.md5(f"{op10.SEED}:{r['doc_id']}:{j}".encode()).hexdigest()[:13], 16) / 2.0**52
            p = cdf = math.exp(-mean / draws)
            k = 0
            while cdf <= u and k < op10.TERMS - 1:
                kept.append(r)
                k += 1
                p *= mean / draws / k
                cdf += p
            if cdf <= u:
                kept.append(r)
    return kept


@pytest.fixture(scope="module")
def tables(spark, words, tmp_path_factory):
    rng, texts = random.Random(21), []
    for i in range(110):
        texts.append(words(rng.randint(55, 120), 3000 + i))
    for i in range(60):
        w = words(rng.randint(55, 90), 5000 + i).split()
        how = i % 3
        texts.append(" ".join(x.upper() if how == 0 else x + "###" if how == 1 and rng.random() < 0.6 else x + "?!" if how == 2 and rng.random() < 0.7 else x for x in w))
    for i in range(40):
        w = texts[i * 2 % 30].split()
        for _ in range(rng.choice([0, 1, 2, 9])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += ["", None, "too short", words(60, 1) * 1 + " " + " ".join(["again and again"] * 60), words(4000, 8)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(k * 3 + 1, texts[at], "en", "hot" if rng.random() < 0.5 else f"s{rng.randrange(3)}", len(texts[at] or "")) for k, at in enumerate(order)]
    labels = [(k * 3 + 1, int(not 110 <= at < 170), 0) for k, at in enumerate(order) if rng.random() < 0.8]
    folder = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows], labels


def test_every_stage_against_plain_loops(spark, tables):
    from test_quality import plain_rules, plain_scores

    folder, rows, labels = tables
    key = lambda rs: sorted((r["doc_id"], r["text"] or "", r["source"]) for r in rs)
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{folder}/documents.parquet")
    marks = {i: q for i, q, _ in labels}
    scores = plain_scores(sorted(((r["doc_id"], r["text"]) for r in rows), key=lambda r: r[0]), marks)

    def classified(rs):
        return [r for r in rs if scores[r["doc_id"]] >= op1.THRESHOLD]

    def ruled(rs):
        _, rejects = plain_rules([(r["doc_id"], r["text"]) for r in rs], [(i, q) for i, q, _ in labels])
        return [r for r in rs if not rejects(r["text"])]

    plain = {"quality classifier": classified, "quality rules": ruled, "n-gram Jaccard join": first_of_groups, "mixing to target weights": mixed}
    for name, loops in plain.items():
        docs = op9.stored(stages[name](spark, docs, folder), "stage")
        before, rows = rows, loops(rows)
        assert key(r.asDict() for r in docs.collect()) == key(rows), name
        assert 0 < len(rows) and (len(rows) < len(before) or name.startswith("mix")), name
    # Packing has SQL; it is asked over what the stage before left.
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.sql(op9.ORACLE).df()
    got = corpus_pipeline.run(spark, folder).toPandas()
    names = sorted(want.columns)
    ordered = lambda d: d[names].astype(str).sort_values(names).to_numpy().tolist()
    assert set(names) <= set(got.columns) and ordered(got) == ordered(want)
