"""Operators 7, 9 and 10, and the pipeline."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quillframe.llm import op07_ngram_jaccard_join as op7
from quillframe.llm import op09_packing as op9
from quillframe.llm import op10_mixing as op10


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def linked_groups(rows):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 90 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(text, n, rng):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def copies(words):
    """Groups of near copies on both sides of the threshold, chains, common passages, tiny texts."""
    rng, rows, base = random.Random(5), [], [words(n, n) for n in (12, 25, 60, 140, 300, 650)]
    passage = words(60, 99)
    for text in base:
        rows += [text, text.upper()] + [edited(text, k, rng) for k in range(1, max(2, len(text.split()) // 20)) for _ in range(3)]
        chain = text
        for _ in range(5):
            chain = edited(chain, max(1, len(text.split()) // 100), rng)
            rows.append(chain)
    rows += [passage + " " + words(40, 200 + k) for k in range(10)]
    rows += ["a", "A", "a b", "b a", "a b c", "A B  C", "a b c d", "", None, " \n"]
    return [(k * 3 % 1009, t) for k, t in enumerate(rows)]


def test_links_against_brute_force(frame, copies):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op7.jaccard_components(frame(copies, clash=True)).collect()}
    assert got == linked_groups(copies)


def test_links_come_from_pivots_cells_and_windows(frame, copies, words, monkeypatch):
    """What joins groups is the distance to a pivot, in small regions and in one of 60 near copies that needs cells, windows and recursion."""
    rng, base = random.Random(6), words(400, 55)
    rows = [*copies, *((3000 + k, edited(base, 1 + k % 9, rng)) for k in range(60))]
    kept, cuts, stored, cut = {}, [], op7.stored, op7.Region.cut
    monkeypatch.setattr(op7, "stored", lambda df, name: kept.setdefault(name, stored(df, name)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op7.jaccard_components(frame(rows)).collect()}
    assert got == linked_groups(rows)
    how = {r["by_pivot"]: r["count"] for r in kept["links"].groupBy("by_pivot").count().collect()}
    assert how[True] >= 0.9 * sum(how.values())
    assert sum(how.values()) >= len({i for i, (n, c) in got.items() if n and c != i}) - len(rows) // 8
    sets = [op7.Shingler()(t) for _, t in rows if t and t.strip()]
    monkeypatch.setattr(op7.Region, "cut", lambda self, at: (cuts.append(len(at)), cut(self, at))[1])
    assert any(by_pivot for _, _, by_pivot in op7.Region(sets, 90).links) and cuts


def test_ids_of_text_and_rows_without_ids(spark, words):
    rng, a, b, c = random.Random(2), words(200, 601), words(200, 602), words(200, 603)
    near = {t: edited(t, 1, rng) for t in (a, b, c)}
    rows = [("x2", a), ("x1", near[a]), (None, a), (None, b), ("y", near[b]), (None, c), (None, near[c]), (None, c), (None, None), ("", ""), ("z", words(30, 604))]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in op7.jaccard_components(docs).collect()), key=str)
    assert got == sorted([("x2", "x1"), ("x1", "x1"), (None, "x1"), (None, "y"), ("y", "y"), (None, None), (None, None), (None, None), (None, None), ("", ""), ("z", "z")], key=str)
    kept = [(r["doc_id"], r["text"]) for r in op7.keep_first(docs).collect()]
    assert [k for k in kept if k[0]] and sorted(str(i) for i, _ in kept) == sorted(["x1", "y", "None", "None", "", "z"])
    assert sum(t in (c, near[c]) for _, t in kept) == 1 and (None, None) in kept


def test_filter_keeps_all_that_a_join_finds(spark):
    from quillframe.llm import common

    rows = spark.range(5000).selectExpr("if(id % 50 = 0, null, id) as a", "id * 7 as b", "id as c")
    keys = rows.filter("c % 31 = 0").select("a", "b")
    kept = {r["c"] for r in common.might_be_in(rows, keys, "a", "b").collect()}
    assert kept >= set(range(0, 5000, 31)) and len(kept) < 1000
    assert common.might_be_in(rows, keys.limit(0), "a", "b").count() == 0


def test_components_against_union_find(spark):
    """A path in the order of its ids, stars, random edges, loops and parallel ones."""
    from quillframe.llm.graph import components

    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(60)] + [(1000, 1001 + k) for k in range(80)] + [(2000 + rng.randrange(90), 2000 + rng.randrange(90)) for _ in range(70)] + [(5, 5), (7, 6), (9000, 9000)]
    root = {x: x for e in edges for x in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == nodes and all((got[a] == got[b]) == (find(a) == find(b)) for a in nodes for b in nodes)
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_cells_cut_by_pivots_and_blocks_give_the_same(frame, copies):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op7.jaccard_components(frame(copies), cell_docs=6, cell_shingles=2_000).collect()}
    assert got == linked_groups(copies)


def test_copies_around_a_text_with_outliers(frame, words):
    """Copies linked to what they were edited from and not to each other; two groups at a distance that share signatures; chains."""
    rng, base, rows = random.Random(8), words(300, 77), []
    rows += [base] + [edited(base, 4, rng) for _ in range(60)]
    far = edited(base, 9, rng)
    rows += [far] + [edited(far, 4, rng) for _ in range(20)] + [edited(base, k, rng) for k in range(5, 13)]
    numbered = [((k * 7) % 101 + 1, t) for k, t in enumerate(rows)]
    for cell_docs in (8, 30):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op7.jaccard_components(frame(numbered), cell_docs=cell_docs).collect()}
        assert got == linked_groups(numbered)


def test_links_of_odd_rows(frame, odd_rows):
    got = op7.jaccard_components(frame(odd_rows, clash=True)).collect()
    assert len(got) == len(odd_rows)
    assert all(r["component_id"] == r["doc_id"] for r in got)
    assert op7.jaccard_components(frame([])).count() == 0
    assert op7.keep_first(frame([])).count() == 0
    kept = op7.keep_first(frame(odd_rows + [(70, odd_rows[0][1])]))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "6", "7", "8", "9", "None", "None"])


def test_keep_first_by_five_words_and_80_percent(spark, frame, tmp_path, copies, words):
    """A block of 18 % inserted and scattered edits pass 0.8 over five words, and not 0.9 over three."""
    rng = random.Random(11)
    base, other = words(300, 401), words(400, 402)
    block = " ".join(base.split()[:150]) + " " + words(54, 403) + " " + " ".join(base.split()[150:])
    cut = other.split()
    for k in range(40, 400, 50):
        cut[k] = "changed"
    rows = [(2001, base), (2002, block), (2003, other), (2004, " ".join(cut)), *copies]
    five = lambda t: {tuple((t or "").lower().split()[i : i + 5]) for i in range(max(1, len((t or "").split()) - 4))} if (t or "").split() else set()
    sets = {i: five(t) for i, t in rows}
    assert all(0.8 <= len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 0.9 for a, b in ((2001, 2002), (2003, 2004)))
    root = {i: i for i in sets}
    pairs = [(i, j) for i, j in itertools.combinations(sorted(sets), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for i, j in pairs * 8:
        root[i] = root[j] = min(root[i], root[j])
    for cell_docs in (6, op7.CELL_DOCS):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op7.jaccard_components(frame(rows), words=5, percent=80, cell_docs=cell_docs).collect()}
        assert got == {i: (len(sets[i]), root[i]) for i in sets}
    kept = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, frame(rows), str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in sets if root[i] == i)


def test_texts_of_a_repeated_id_have_their_own_verdicts(frame, words):
    a, b, c = words(200, 501), words(200, 502), words(200, 503)
    rng = random.Random(12)
    near = {t: edited(t, 1, rng) for t in (a, b, c)}
    rows = [(1, a), (5, a), (5, b), (5, b.upper()), (6, near[b]), (7, c), (7, near[c]), (8, None), (8, words(20, 504))]
    kept = sorted((r["doc_id"], (r["text"] or "").lower()) for r in op7.keep_first(frame(rows)).collect())
    assert [k for k in kept if k[0] != 7] == sorted([(1, a), (5, b), (8, ""), (8, words(20, 504))])
    assert [t for i, t in kept if i == 7] in ([c], [near[c]])


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**40), min_size=1, max_size=120), st.sets(st.integers(2**41, 2**42), max_size=30), st.integers(0, 30), st.sampled_from([50, 80]))
def test_linked_sets_share_a_group_signature(common, more, less, percent):
    a = op7.mixed(np.array(sorted(common), np.uint64))
    b = np.concatenate([a[min(less, len(a) - 1) :], op7.mixed(np.array(sorted(more), np.uint64))])
    ends = op7.band_ends(percent, 1 << 20)
    if op7.linked(np.unique(a), np.unique(b), percent):
        assert set(op7.group_signatures(np.unique(a), ends, percent)) & set(op7.group_signatures(np.unique(b), ends, percent))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB \t\né\x0b", max_size=40))
def test_shingler_counts_as_brute_force(text):
    assert len(op7.Shingler()(text)) == len(shingles(text))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=25), min_size=1, max_size=14), st.sampled_from([50, 80, 90]))
def test_cell_join_against_brute_force(sets, percent):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    root = list(range(len(sets)))
    for _ in sets:
        for i, j in itertools.combinations(range(len(sets)), 2):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[i] = root[j] = min(root[i], root[j])
    region = op7.Region(arrays, percent)
    assert [region.find(i) for i in range(len(sets))] == root
    assert all(op7.linked(arrays[i], arrays[j], percent) for i, j, _ in region.links)


def least_padding(lengths, buckets):
    distinct = sorted(set(lengths))
    best = min((sum(min(e for e in (*ends, distinct[-1]) if e >= n) - n for n in lengths) for k in range(min(buckets, len(distinct))) for ends in itertools.combinations(distinct[:-1], k)), default=0)
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=25), st.integers(1, 4))
def test_buckets_are_optimal(lengths, buckets):
    histogram = [(n, lengths.count(n), n * lengths.count(n)) for n in sorted(set(lengths))]
    ends = op9.best_buckets(histogram, buckets)
    assert len(ends) <= buckets and sum(min(e for e in ends if e >= n) - n for n in lengths) == least_padding(lengths, buckets)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(8_150, 8_400), min_size=1, max_size=16), st.integers(1, 4))
def test_buckets_of_long_texts_are_optimal(lengths, buckets):
    histogram = [(n, lengths.count(n), n * lengths.count(n)) for n in sorted(set(lengths))]
    ends = op9.best_buckets(histogram, buckets)
    assert sum(min(e for e in ends if e >= n) - n for n in lengths) == least_padding(lengths, buckets)


def test_packing_of_long_texts_is_optimal(frame):
    lengths = [8_200, 8_201, 8_205, 8_211, 8_216, 8_217, 8_224, 8_231, 8_231, 20_000]
    got = op9.pack(frame([(k, "w " * (n - 1)) for k, n in enumerate(lengths)]), buckets=3).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(lengths) and sum(r["padding"] for r in got) == least_padding(lengths, 3)


def test_copies_of_a_document_are_spread(frame, words):
    """20 documents of 30 copies among 1,400 others: a batch holds 50 rows, and few of one document."""
    rows = [(i % 20, words(30, i % 20)) for i in range(600)] + [(1000 + i, words(30, 99)) for i in range(1400)]
    got = op9.pack(frame(rows), buckets=1, token_budget=50 * 31).collect()
    assert len(got) == len(rows)
    most = max(sum(r["batch_id"] == b and r["doc_id"] == i for r in got) for b in {r["batch_id"] for r in got} for i in range(20))
    assert most <= 7


def test_packing(frame, odd_rows, words):
    rows = odd_rows + [(100 + i, words(i % 50 + 1, i)) for i in range(300)]
    got = op9.pack(frame(rows, clash=True), buckets=4, token_budget=500).collect()
    assert len(got) == len(rows)
    assert sorted(r["n_tokens"] for r in got) == sorted(len((t or "").encode().split()) + 1 for _, t in rows)
    batches = {}
    for r in got:
        assert 0 <= r["padding"] == r["bucket_len"] - r["n_tokens"]
        batches.setdefault(r["batch_id"], []).append(r)
    for rows_of in batches.values():
        assert len({r["bucket"] for r in rows_of}) == 1 and (len(rows_of) == 1 or sum(r["bucket_len"] for r in rows_of) <= 500)
        assert sorted(r["slot"] for r in rows_of) == list(range(len(rows_of)))
    assert op9.pack(frame([])).count() == 0


def test_mixing_reaches_target_weights(frame):
    docs = frame([(i, "t") for i in range(9000)])
    mixed = op10.mix_sources(docs, {"src0": 0.6, "src1": 0.4}, repeat=1.0)
    shares = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert set(shares) == {"src0", "src1"} and abs(shares["src0"] / sum(shares.values()) - 0.6) < 0.03
    assert mixed.select("doc_id", "copy").distinct().count() == mixed.count()
    counts = [r["n_copies"] for r in mixed.select("doc_id", "n_copies").filter("source = 'src0'").distinct().collect()]
    spread = np.array(counts + [0] * (3000 - len(counts)))
    assert abs(spread.var() / spread.mean() - 1) < 0.12  # Poisson


def test_mixing_large_means(frame):
    docs = frame([(i, "t") for i in range(300)])
    one = op10.mix_sources(docs, {"src0": 1.0}, repeat=60.0)
    counts = np.array([r["n_copies"] for r in one.select("doc_id", "n_copies").distinct().collect()])
    assert len(counts) == 100 and abs(counts.mean() - 60) < 3 and abs(counts.var() / 60 - 1) < 0.5


def test_mixing_odd_rows(spark, frame, odd_rows):
    docs = frame(odd_rows, clash=True)
    mixed = op10.mix_sources(docs)
    assert set(mixed.columns) == set(docs.columns) | set(op10.OWN) and len(mixed.columns) == len(set(mixed.columns))
    a, b = (sorted(map(str, op10.mix_sources(docs).select("doc_id", "copy", "shuffle_key").collect())) for _ in range(2))
    assert a == b
    assert op10.mix_sources(frame([])).count() == 0
    named = frame([(i, "a b") for i in range(40)]).withColumns({"_mix_key": F.lit("x"), "_MIX_source": F.lit("y"), "Copy": F.lit("z")})
    plain = op10.mix_sources(frame([(i, "a b") for i in range(40)])).select("doc_id", "copy", "shuffle_key").collect()
    mixed = op10.mix_sources(named)
    assert sorted(mixed.select("doc_id", "copy", "shuffle_key").collect()) == sorted(plain)
    assert {(r["_mix_key"], r["_MIX_source"]) for r in mixed.collect()} == {("x", "y")}


def test_pipeline_stages(spark, frame, tmp_path, words):
    rng = random.Random(3)
    good = [(i, words(80, i)) for i in range(120)]
    bad = [(i, words(80, i).upper().replace(" ", "### ")) for i in range(120, 180)]
    near = [(i, edited(good[i - 180][1], 1, rng)) for i in range(180, 200)]
    frame(good + bad + near).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(not 120 <= i < 180), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert seen[0] >= set(range(120)) and not seen[0] & set(range(120, 180))
    assert seen[2] == set(range(120)) and seen[3] <= seen[2]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.count() == docs.count() and {r["doc_id"] for r in packed.select("doc_id").collect()} == seen[3]


def test_pipeline_on_odd_tables(spark, frame, tmp_path, odd_rows, words):
    """Null and repeated ids, empty and very long texts; empty tables."""
    rows = odd_rows + [(None, words(80, 900)), (None, words(80, 901)), (None, words(80, 900)), (70, words(80, 902)), (70, words(80, 903))] + [(200 + i, words(80, i)) for i in range(60)]
    frame(rows, clash=True).drop("score").write.parquet(str(tmp_path / "a/documents.parquet"))
    spark.createDataFrame([(200 + i, int(i % 4 > 0), 0) for i in range(60)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "a/labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "a/documents.parquet"))
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = op9.stored(stage(spark, docs, str(tmp_path / "a")), "stage")
        assert sorted(docs.columns) == sorted(names)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path / "a"))
    assert packed.count() == docs.count()
    for name, df in (("documents", frame([])), ("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int"))):
        df.write.parquet(str(tmp_path / f"b/{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
