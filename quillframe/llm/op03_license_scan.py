"""License scans: a positional index of licence words, looked up by each file's rarest ones.

Every text is read once, to the positions of the few words that licence templates hold; the corpus' document frequency of each
such word follows from them. The index holds, for each template's highest-IDF words, the template and the word's offset in it: the rarest word
of its key phrase, and as many words as it takes for the rest to weigh less than MIN_SCORE of the template. The places of indexed words in
a file give pairs of template and start; around each start, the file's words are intersected with the template's by relative position. The template fits if
MIN_SCORE of its IDF weight is in place and its key phrase stands word for word at its offset from that start. A base phrase is a template that
is its own key phrase.

Everything happens inside a row, so that no document, however hot its words, moves between tasks; a row costs its places of indexed words, not
the number of templates.

Cases: a null or empty text has no words and no labels. Repeated rows each get the same answer.
Places that overlap count each. Words that tie in IDF are indexed in the order of the template. Words that no document has count as the
rarest. Further columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import lower_ascii, read, stored

#: Phrase and label. Fixed values of the query's contract.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: (label, template, key phrase). "*" stands for a word too frequent to index; key phrases have none.
TEMPLATES = [
    ("agpl", "gnu affero general public license", "affero general public"),
    ("lgpl", "gnu lesser general public license", "lesser general public"),
    ("gpl-3.0", "gnu general public license version 3", "license version 3"),
    ("gpl-2.0", "gnu general public license version 2", "license version 2"),
    ("apache-2.0", "licensed under * apache license version 2 0", "apache license version 2"),
    ("mit-text", "permission * hereby granted free * charge * any person obtaining * copy", "hereby granted free"),
    ("bsd", "redistribution * use * source * binary forms * * without modification * permitted", "binary forms"),
    ("mpl", "source code form * subject * * terms * * mozilla public license", "mozilla public license"),
    ("isc", "permission * use copy modify * distribute * software", "use copy modify"),
    ("cc-by-sa", "cc by sa", "cc by sa"),
    ("cc-by-nc", "cc by nc", "cc by nc"),
]
MIN_SCORE = 0.8
#: What separates words, after A-Z are lower-cased.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def postings(docs: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, n_words, posts): posts are structs of position and index in words, by position.

    A word is told by a set, and its index from a slot of a table by its hash: neither takes longer for more words.
    """
    found = F.filter(F.split(lower_ascii(F.coalesce("text", F.lit(""))), GAPS), lambda w: w != "")
    at = F.sequence(F.lit(0), F.size("words") - 1)
    hits = F.filter(at, lambda i: F.get("words", i).isin(words))
    slot = lambda w: F.pmod(F.xxhash64(w), F.lit(2 * len(words))).cast("int")
    slots: list[list[dict]] = [[] for _ in range(2 * len(words))]
    for r in docs.sparkSession.createDataFrame([(w, k + 1) for k, w in enumerate(words)], "w string, i int").select("w", "i", slot("w").alias("s")).collect():  # a row for each word
        slots[r["s"]].append({"w": r["w"], "i": r["i"]})
    table = constant(slots, "array<array<struct<w:string,i:int>>>")
    index = lambda w: F.get(F.filter(F.get(table, slot(w)), lambda e: e["w"] == w), F.lit(0))["i"]
    posts = F.transform(hits, lambda i: F.struct(i.alias("pos"), index(F.get(F.col("words"), i)).alias("word")))
    empty = F.array().cast("array<struct<pos:int,word:int>>")
    return docs.select("doc_id", found.alias("words")).select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.size("words") > 0, posts).otherwise(empty).alias("posts"))


def indexed_offsets(weights: list[float], need: float) -> list[int]:
    """The offsets of the heaviest words, as few as leave the others less than need of the weight."""
    total, left, chosen = sum(weights), sum(weights), []
    for k in sorted(range(len(weights)), key=lambda k: (-weights[k], k)):
        if left < need * total - 1e-9:
            break
        chosen.append(k)
        left -= weights[k]
    return chosen


def constant(values: list, kind: str) -> Column:
    """A list as a constant of a Spark type."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row for each row of docs."""
    every = [(label, phrase, phrase) for phrase, label in phrases.items()] + templates
    words = sorted({w for _, text, _ in every for w in text.split()} - {"*"})
    posted = stored(postings(docs, words), "licence-postings")
    counts = posted.select(F.explode(F.array_distinct("posts.word")).alias("word")).groupBy("word").count().collect()  # a row for each licence word
    n_docs, df = posted.count(), {r["word"]: r["count"] for r in counts}
    index: list[list[dict]] = [[] for _ in words]
    known = []
    for t, (_, text, key) in enumerate(every):
        held = [0 if w == "*" else words.index(w) + 1 for w in text.split()]
        weights = [math.log((n_docs + 1) / (df.get(w, 0) + 1)) + 1.0 if w else 0.0 for w in held]
        size = len(key.split())
        at = next(k for k in range(len(held)) if text.split()[k : k + size] == key.split())
        rarest = max(range(at, at + size), key=lambda k: (weights[k], -k))
        for k in {rarest, *indexed_offsets(weights, MIN_SCORE)} if t >= len(phrases) else {rarest}:
            index[held[k] - 1].append({"t": t, "off": k})
        known.append({"words": held, "shares": [w / sum(weights) for w in weights], "key": at, "size": size})
    by_word = constant(index, "array<array<struct<t:int,off:int>>>")
    by_template = constant(known, "array<struct<words:array<int>,shares:array<double>,key:int,size:int>>")
    label = constant([name for name, _, _ in every], "array<string>")
    posts = F.col("posts")

    def starts(p: Column, i: Column) -> Column:
        return F.transform(F.get(by_word, p["word"] - 1), lambda e: F.struct(e["t"].alias("t"), (p["pos"] - e["off"]).alias("start"), F.greatest(i + 1 - e["off"], F.lit(1)).alias("near")))

    def intersected(c: Column) -> Column:
        """What of a template is in place from a start: its share, and words of its key phrase. Places of one file are at least one apart."""
        own = F.get(by_template, c["t"])
        near = F.slice(posts, c["near"], F.size(own["words"]))
        in_place = F.filter(near, lambda p: (p["pos"] >= c["start"]) & F.coalesce(F.get(own["words"], p["pos"] - c["start"]) == p["word"], F.lit(False)))
        offsets = F.transform(in_place, lambda p: p["pos"] - c["start"])
        share = F.aggregate(offsets, F.lit(0.0), lambda s, k: s + F.get(own["shares"], k))
        key = F.size(F.filter(offsets, lambda k: (k >= own["key"]) & (k < own["key"] + own["size"]))) == own["size"]
        return F.struct(c["t"].alias("t"), c["start"].alias("start"), F.round(F.least(share, F.lit(1.0)), 9).alias("share"), key.alias("keyed"))

    candidates = posted.withColumn("_starts", F.flatten(F.transform("posts", starts)))
    found = candidates.withColumn("_found", F.filter(F.transform("_starts", intersected), lambda c: c["keyed"]))
    is_base = lambda c: c["t"] < len(phrases)
    found = found.withColumns({"_base": F.filter("_found", is_base), "_own": F.filter("_found", lambda c: ~is_base(c))})
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda c: F.get(label, c["t"])))), ",")
    return found.select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"), F.array_min("_base.start").cast("long").alias("first_word"), F.array_max("_base.start").cast("long").alias("last_word"),
        joined(F.col("_base")).alias("base_labels"), joined(F.concat("_base", F.filter("_own", lambda c: c["share"] >= MIN_SCORE))).alias("labels"),
        F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("_own.share"), F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))
