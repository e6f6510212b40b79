"""Disk of the n-gram Jaccard join: filters that hold many keys, and tables that go early."""

from quillframe.llm import common
from quillframe.llm import op07_ngram_jaccard_join as O7
from quillframe.sources.tables import written


def test_filter_of_more_keys_than_it_has_room_for(spark, monkeypatch):
    monkeypatch.setattr(common, "FILTER_BITS", 1 << 15)
    rows = spark.range(40_000).withColumnRenamed("id", "a")
    keys = rows.filter("a % 8 = 0")  # 5,000: six bits each
    kept = {r["a"] for r in common.might_be_in(rows, keys, "a").collect()}
    assert kept >= set(range(0, 40_000, 8)) and len(kept) < 13_000
    assert common.might_be_in(rows, rows, "a").count() == 40_000


def test_signatures_go_when_they_have_been_compared(spark):
    text = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "quite another text"), (4, text), (5, None)], "doc_id long, text string")
    for percent, words in ((90, 3), (80, 5)):
        before = set(written())
        found = O7.jaccard_components(docs, percent, words=words)
        left = [p for p in written() if p not in before]
        assert not [p for p in left if "/sketches-" in p or "/classes-" in p] and any("/thinned-" in p for p in left)
        assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}
