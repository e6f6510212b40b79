"""N-gram Jaccard join: exact links between documents whose shingle sets are similar enough, in the metric space of Jaccard distance.

Inside a region, pivots make Voronoi cells; each document goes to its nearest pivot's cell and to each cell whose pivot is
at most 2 * (1 - threshold) further (by the triangle inequality no link can lie elsewhere), and cells are cut again. Distances
to pivots give the links: a cell of at most PIVOTS documents has every pair among them. Regions of at most CELL_DOCS documents are
cut in one task's memory (class Region), larger ones first by joins in Spark (cut_cells). A cell that
links to pivots connect is done. Where windows would send documents to more than REPLICAS cells on average (near copies that are all
about as far from each other), the cell's remaining pairs are compared through their rarest shingles, exactly.

Voronoi cells over the raw corpus don't work: documents that share little have distance near 1 to
every pivot, so the windows would send every document to every cell. So regions come first, from
pivots of another kind. For a size band with L the largest size, the universe of shingles is cut
into m = floor(2 L (1 - t) / (1 + t)) + 1 hash classes. Two linked sets differ in fewer than m shingles,
so they agree wholly on one class; the hash of a set's part in a class is a signature, and linked
sets of one band, or of neighbouring ones, share one. Components over shared signatures are the
regions. A signature stands for about ten shingles at once, so that common passages make no
regions.

Below a threshold of about 0.88 a class holds few shingles, and common passages would join unlike texts. There, (1) a text is
looked at further only if enough of a fixed sample of its shingles is in other texts: a link leaves at most 1 - t
of its shingles without a partner. (2) Classes come in groups of three parts. A group in which two linked sets differ by at
most one shingle agrees on two parts, whose hash is a signature. Some groups more than needed let each set leave
out as many of its poorest ones. Both are exact.

Copies with equal sets are one class throughout. Sets are held as 64-bit hashes of shingles. Ids can be of any type that sorts.

Cases: a null or empty text has no shingles, links with nothing, and its component is its own id.
A text of fewer words than a shingle has one shingle. Rows that repeat an id each come out, and have their own text's component. A null id
sorts last: its row has the smallest id that its text reaches, and null if that reaches none. Ties between pivots take the smaller
digest. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import freed, might_be_in, read, stored, thinned, told_apart, written
from quillframe.llm.graph import components

WORDS = 3
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 90
#: A cell of at most so many documents and shingles is joined in memory.
CELL_DOCS, CELL_SHINGLES = 1_500, 2_000_000
PIVOTS, LEVELS, REPLICAS = 8, 4, 2.0
#: Where classes hold fewer shingles than this, texts are sampled first (of TENTHS tenths of the hashes) and signatures come from groups of PARTS parts.
FEW, TENTHS, PARTS, SPARE = 8, 3, 3, 0.3

#: What texts of equal sets have in common.
SAME = ["d1", "d2", "n_shingles"]

_ONE = np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle sets of texts, as sorted distinct 64-bit hashes, without a loop over words.

    A word's hash is its bytes' polynomial in an odd base modulo 2^64, taken from prefix sums and
    shifted to its start by a power of the base's inverse.
    """

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, words: int = WORDS) -> None:
        self.words = words
        self.grow(1 << 16)

    def grow(self, size: int) -> None:
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.full(size, self.BASE, np.uint64))
            self.inverse = np.cumprod(np.full(size, pow(self.BASE, -1, 2**64), np.uint64))

    def __call__(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").encode().lower(), np.uint8)
        if len(raw) > len(self.powers):
            self.grow(2 * len(raw))
        space = np.ones(len(raw) + 2, np.int8)
        space[1:-1] = (raw == 32) | ((raw >= 9) & (raw <= 13))
        turn = np.diff(space)
        start, end = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
        if not len(start):
            return np.zeros(0, np.uint64)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + _ONE) * self.powers[: len(raw)], out=sums[1:])
        word = mixed((sums[end] - sums[start]) * self.inverse[start])
        n = min(self.words, len(word))
        shingle = np.full(len(word) - n + 1, n, np.uint64)
        for k in range(n):
            shingle = mixed(shingle * np.uint64(self.BASE) + word[k : len(word) - n + 1 + k])
        return np.unique(shingle)


def band_ends(percent: int, most: int) -> np.ndarray:
    """Largest sizes of the bands: a linked set is in the same band or in a neighbouring one."""
    ends = [1]
    while ends[-1] < most:
        ends.append(max(ends[-1] * 100 // percent, ends[-1] + 1))
    return np.array(ends, np.int64)


def signatures(shingles: np.ndarray, ends: np.ndarray, percent: int) -> np.ndarray:
    """One hash for each class of the set's own band and of the next."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    band, parts, spread = int(np.searchsorted(ends, len(shingles))), [], mixed(shingles + np.uint64(0x51ED2701))
    for b in (band, band + 1):
        m = int(2 * ends[b] * (100 - percent) // (100 + percent)) + 1
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, (shingles % np.uint64(m)).astype(np.int64), spread)
        parts.append(mixed(sums + mixed(np.arange(m, dtype=np.uint64) + np.uint64((b + 1) << 40))))
    return np.concatenate(parts)


def has_few(percent: int) -> bool:
    """Whether one class for each difference leaves a class fewer than FEW shingles."""
    return 100 + percent < FEW * 2 * (100 - percent)


def sampled(shingles: np.ndarray) -> np.ndarray:
    """The shingles of a fixed TENTHS tenths of all hashes."""
    return shingles[mixed(shingles ^ np.uint64(0x3C6EF372)) % np.uint64(10) < np.uint64(TENTHS)]


def group_signatures(shingles: np.ndarray, ends: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of the set's own band and of the next, each of a group of classes without one of its PARTS parts.

    At most half as many groups as there are differences have two of them or more, so that spare + 1 groups agree without one
    part. Signatures of fewer shingles than the poorest one of the group at place spare + 1 are left out: at most spare groups have such ones.
    """
    if not len(shingles):
        return np.zeros(0, np.uint64)
    band, found, spread = int(np.searchsorted(ends, len(shingles))), [], mixed(shingles + np.uint64(0x51ED2701))
    for b in (band, band + 1):
        most = int(2 * ends[b] * (100 - percent) // (100 + percent))
        spare = int(SPARE * most / 2)
        groups = most // 2 + 1 + spare
        part = (shingles % np.uint64(groups * PARTS)).astype(np.int64)
        sums = np.zeros(groups * PARTS, np.uint64)
        np.add.at(sums, part, spread)
        sums, counts = sums.reshape(groups, PARTS), np.bincount(part, minlength=groups * PARTS).reshape(groups, PARTS)
        rest, size = sums.sum(1, keepdims=True, dtype=np.uint64) - sums, counts.sum(1, keepdims=True) - counts
        name = mixed(np.arange(groups * PARTS, dtype=np.uint64) + np.uint64((b + 1) << 40)).reshape(groups, PARTS)
        found.append(mixed(rest + name)[size >= np.partition(size.min(1), spare)[spare]])
    return np.concatenate(found)


def digest(shingles: np.ndarray, salt: int = 0x1234567) -> int:
    return int(mixed(shingles ^ np.uint64(salt)).sum(dtype=np.uint64).view(np.int64))


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """64-bit numbers as an Arrow array of lists."""
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat))


def sketches(docs: DataFrame, percent: int, words: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, d1, d2, sigs): a 128-bit digest of each set, and its signatures; where classes hold few shingles, its sample."""

    @F.arrow_udf("n_shingles long, d1 long, d2 long, sigs array<long>")
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shingler, ends, few = Shingler(words), band_ends(percent, 1 << 31), has_few(percent)
        for texts in batches:
            rows, sigs = [], []
            for text in texts.to_pylist():
                s = shingler(text)
                rows.append((len(s), digest(s), digest(s, 0x89ABCDEF01)))
                sigs.append(sampled(s) if few else signatures(s, ends, percent))
            numbers = [pa.array(x, pa.int64()) for x in (zip(*rows) if rows else ((),) * 3)]
            yield pa.StructArray.from_arrays([*numbers, lists(sigs)], ["n_shingles", "d1", "d2", "sigs"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), sketch("text").alias("s")).select("doc_id", "text_hash", "s.*")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


class Region:
    """Links between the sets of one region, exactly; sets in the body are known to be connected.

    links has (i, j, by_pivot) for each pair of sets that joined two groups: by the distance to a pivot, or else by a comparison of pairs.
    """

    def __init__(self, sets: list[np.ndarray], percent: int, in_body: list[bool] | None = None) -> None:
        self.percent, self.eps, self.links, self.root = percent, 1 - percent / 100, [], list(range(len(sets)))
        body = [i for i, known in enumerate(in_body or ()) if known]
        for i in body:
            self.root[i] = body[0]
        if len(sets) < 2:
            return
        self.sizes = np.array(list(map(len, sets)))
        _, ids, self.counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        cuts = np.cumsum([0, *self.sizes])
        self.ids = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        self.shared = [s[self.counts[s] > 1] for s in self.ids]  # what no other set has is in no intersection
        self.mark = np.zeros(len(self.counts), bool)
        self.cut(np.arange(len(sets)))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def link(self, i: int, j: int, by_pivot: bool) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.root[max(a, b)] = min(a, b)
            self.links.append((i, j, by_pivot))

    def connected(self, at: np.ndarray) -> bool:
        first = self.find(int(at[0]))
        return all(self.find(i) == first for i in at.tolist())

    def cut(self, whole: np.ndarray) -> None:
        """Pivots, cells and windows, again and again. The first pivot shares most with the others; each next one is the farthest from those before."""
        work = [whole]
        while work:
            at = work.pop()
            if len(at) < 2 or self.connected(at):
                continue
            flat, ends = np.concatenate([self.shared[i] for i in at]), np.cumsum([len(self.shared[i]) for i in at])
            per_set = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], ends])])  # noqa: B023, E731
            sizes, far, away = self.sizes[at], np.full(len(at), np.inf), []
            pivot = int(np.argmax(per_set(self.counts[flat]) / sizes))
            while len(away) < PIVOTS and far[pivot] > 0:
                own = self.shared[at[pivot]]
                self.mark[own] = True
                common = per_set(self.mark[flat])
                self.mark[own] = False
                either = sizes + sizes[pivot] - common
                away.append(1 - common / either)
                for k in np.flatnonzero(100 * common >= self.percent * either).tolist():
                    self.link(int(at[pivot]), int(at[k]), True)
                far = np.minimum(far, away[-1])
                far[pivot] = 0.0
                pivot = int(np.argmax(far))
            if len(at) <= len(away) or self.connected(at):
                continue
            near = np.array(away)
            inside = near <= near.min(axis=0) + 2 * self.eps + 1e-9
            if inside.sum() <= REPLICAS * len(at) and not inside.all(axis=1).any():
                work += [at[cell] for cell in inside]
            else:
                self.compare(at)

    def compare(self, at: np.ndarray) -> None:
        """By size, each set meets the smaller ones that hold one of its first shingles, counted from the rarest on, if links don't connect
        the two already: sets that are linked share one of the first n - ceil(t n) + 1."""
        rank = np.empty(len(self.counts), np.int64)
        rank[np.argsort(self.counts, kind="stable")] = np.arange(len(self.counts))
        common = np.sort(self.counts, kind="stable") > 1
        by_first: dict[int, list[int]] = {}
        for i in sorted(at.tolist(), key=lambda i: (self.sizes[i], i)):
            n = int(self.sizes[i])
            first = np.sort(rank[self.ids[i]])[: n - -(-self.percent * n // 100) + 1]
            first = first[common[first]].tolist()
            for j in sorted({j for r in first for j in by_first.get(r, ())}):
                if self.find(i) != self.find(j) and 100 * int(self.sizes[j]) >= self.percent * n and linked(self.ids[i], self.ids[j], self.percent):
                    self.link(i, j, False)
            for r in first:
                by_first.setdefault(r, []).append(i)


def _set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def in_block_pairs(open_cells: DataFrame, cell_docs: int, cell_shingles: int) -> DataFrame:
    """Cells that pivots don't part, in hashed blocks: each block of outliers meets each block of the body, and each other.

    Members of the body (those that links to pivots connect) needn't meet, so the blocks grow with outliers times members only.
    """

    def blocks(docs: str, weight: str) -> Column:
        return F.ceil(F.greatest(F.col(docs) / F.lit(cell_docs / 2), F.col(weight) / F.lit(cell_shingles / 2))).cast("int")

    dealt = open_cells.withColumns({"in_body": F.expr("mask & body <> 0"), "bodies": blocks("body_docs", "body_weight"), "outs": blocks("out_docs", "out_weight")})
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("rep"), F.when(F.col("in_body"), F.col("bodies")).otherwise(F.col("outs"))).cast("int"))
    beside = F.expr("transform(filter(sequence(0, outs - 1), k -> k <> mine), k -> concat_ws('-', 'o', least(mine, k), greatest(mine, k)))")
    with_body = F.expr("transform(sequence(0, bodies - 1), k -> concat_ws('-', 'b', mine, k))")
    with_outliers = F.expr("transform(sequence(0, outs - 1), k -> concat_ws('-', 'b', k, mine))")
    pair = F.explode(F.when(F.col("in_body"), with_outliers).otherwise(F.concat(with_body, beside)))
    return dealt.withColumn("pair", pair).select(F.concat_ws("-", "parent", "pair").alias("cell"), "rep", "n", "shingles", "in_body")


def cell_plans(parted: DataFrame) -> DataFrame:
    """For each parent: how far the windows replicate it, and its body: the largest group that links to pivots connect.

    A member's mask has a bit for each pivot it links to. At most 2 ^ PIVOTS masks of a cell are grown into the body.
    """
    first = F.col("links").isNotNull()
    by_mask = parted.groupBy("parent", "mask").agg(F.count_if(first).alias("docs"), F.sum(F.when(first, F.col("n")).otherwise(0)).alias("weight"), F.count(F.lit(1)).alias("rows"), F.collect_set("cell").alias("parts"))
    whole = by_mask.groupBy("parent").agg(
        F.collect_list(F.struct("docs", "mask", "weight")).alias("masks"), F.sum("docs").alias("docs"), F.sum("weight").alias("weight"),
        F.sum("rows").alias("rows"), F.size(F.array_distinct(F.flatten(F.collect_list("parts")))).alias("parts"),
    )
    grown = f"aggregate(sequence(1, {PIVOTS}), array_max(filter(masks, m -> m.mask <> 0)).mask, (g, k) -> aggregate(masks, g, (h, m) -> if(m.mask & h <> 0, h | m.mask, h)))"
    out = "aggregate(filter(masks, m -> m.mask & body = 0), 0L, (s, m) -> s + m.{})"
    whole = whole.withColumn("body", F.expr(grown))
    whole = whole.withColumns({"out_docs": F.expr(out.format("docs")), "out_weight": F.expr(out.format("weight"))})
    return whole.select("parent", "body", "rows", "parts", "docs", "out_docs", "out_weight", (F.col("docs") - F.col("out_docs")).alias("body_docs"), (F.col("weight") - F.col("out_weight")).alias("body_weight"))


def cut_cells(members: DataFrame, percent: int, cell_docs: int, cell_shingles: int) -> tuple[DataFrame, DataFrame | None]:
    """members (cell, rep, degree, n, shingles) with large cells cut by pivots, again and again; and the links to pivots that this finds.

    A cell whose members links to pivots all connect is done. Where the windows send documents to more than REPLICAS cells
    on average, pivots don't part a cell (its documents are all about as far from each other), and pairs of blocks take
    their place.
    """
    eps, cells, links = 1 - percent / 100, [], []
    columns, made = ["cell", "rep", "degree", "n", "shingles"], ["cell", "rep", "n", "shingles", "in_body"]
    for level in range(LEVELS):
        sizes = members.groupBy("cell").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("weight"))
        large = stored(sizes.filter((F.col("docs") > cell_docs) | (F.col("weight") > cell_shingles)).select("cell"), "large-cells")
        if not large.limit(1).count():
            break
        cells.append(members.join(large, "cell", "left_anti").withColumn("in_body", F.lit(False)))
        many = members.join(large, "cell", "left_semi")
        # Of each of PIVOTS hashed parts of a cell, the document that shares the most signatures: those that edits of it surround.
        slot = F.pmod(F.xxhash64("rep", F.lit(level)), F.lit(PIVOTS))
        chosen = many.groupBy("cell", slot.alias("slot")).agg(F.max(F.struct("degree", (-F.col("rep")).alias("first"))).alias("top")).select("cell", (-F.col("top.first")).alias("rep"))
        # Both are written, so that their size is known: small ones are broadcast and the cells' sets aren't shuffled.
        pivots = many.join(stored(chosen, "chosen"), ["cell", "rep"], "left_semi").groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("rep", "shingles"))).alias("pivots"))
        pivots = stored(pivots, "pivots")

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for cell, rep, degree, n, raw, near in zip(*(batch[c] for c in [*columns, "pivots"])):
                    own, away, mask, linked_to = _set(raw), [], 0, []
                    for k, p in enumerate(near):
                        other = _set(p["shingles"])
                        common = len(np.intersect1d(own, other, assume_unique=True))
                        either = len(own) + len(other) - common
                        away.append(1 - common / either)
                        if 100 * common >= percent * either:
                            mask |= 1 << k
                            linked_to.append(p["rep"])
                    inside = [k for k, d in enumerate(away) if d <= min(away) + 2 * eps + 1e-9]
                    rows += [(cell, f"{cell}/{k}", rep, degree, n, raw, mask, linked_to if k == inside[0] else None) for k in inside]
                yield pd.DataFrame(rows, columns=["parent", *columns, "mask", "links"])

        schema = "parent string, cell string, rep long, degree long, n long, shingles binary, mask int, links array<long>"
        parted = stored(many.join(pivots, "cell").select(*columns, "pivots").mapInPandas(deal, schema), "parted")
        # Each document beside its first pivot, and pivots that one document links beside each other.
        links.append(parted.select(F.col("rep").alias("a"), F.get("links", F.lit(0)).alias("b")).filter("a <> b"))
        links.append(parted.filter("size(links) > 1").select("links").distinct().select(F.col("links")[0].alias("a"), F.explode("links").alias("b")).filter("a <> b"))
        plans = stored(cell_plans(parted).filter("out_docs > 0"), "cell-plans")
        parts = (F.col("rows") <= REPLICAS * F.col("docs")) & (F.col("parts") > 1) & F.lit(level + 1 < LEVELS)
        cells.append(in_block_pairs(parted.filter("links is not null").join(plans.filter(~parts).drop("rows", "parts", "docs"), "parent"), cell_docs, cell_shingles))
        members = stored(parted.join(plans.filter(parts).select("parent"), "parent", "left_semi").select(columns), "cells")
    cells.append(members.withColumn("in_body", F.lit(False)))
    return reduce(DataFrame.union, [c.select(made) for c in cells]), reduce(DataFrame.union, links) if links else None


def texts_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The columns of classes (node, first_id, first_hash and others) and each class' text."""
    mine = docs.select(F.col("doc_id").alias("first_id"), F.xxhash64("text").alias("first_hash"), "text")
    mine = might_be_in(mine, classes, "first_id", "first_hash")
    return mine.join(classes, mine["first_id"].eqNullSafe(classes["first_id"]) & (mine["first_hash"] == classes["first_hash"])).drop("first_id", "first_hash")


def signed_again(docs: DataFrame, reps: DataFrame, percent: int, words: int) -> DataFrame:
    """(rep, sigs): the group signatures of classes that have enough of their sample in common with others to be linked."""
    held = reps.select("rep", F.explode("sigs").alias("sig"))
    met = stored(held.groupBy("sig").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").select("sig"), "sample-met")
    freed(docs.sparkSession)
    shared = might_be_in(held, met, "sig").join(met, "sig").groupBy("rep").agg(F.count(F.lit(1)).alias("met"))
    alone = F.size("sigs") - F.coalesce("met", F.lit(0))
    likely = reps.join(shared, "rep", "left").filter(100 * alone <= (100 - percent) * F.col("n_shingles"))
    likely = stored(likely.select(F.col("rep").alias("node"), "first_id", "first_hash"), "likely")
    freed(docs.sparkSession)

    @F.arrow_udf("array<long>")
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shingler, ends = Shingler(words), band_ends(percent, 1 << 31)
        for texts in batches:
            yield lists([group_signatures(shingler(text), ends, percent) for text in texts.to_pylist()])

    return stored(texts_of(docs, likely).select(F.col("node").alias("rep"), sign("text").alias("sigs")).dropDuplicates(["rep"]), "signed")


def set_classes(sketched: DataFrame) -> DataFrame:
    """(d1, d2, n_shingles, rep, first_id, first_hash, sigs): a row for each set that some text has, and its first text.

    A class goes by its digest, as an id that repeats can be the first of several.
    """
    first = F.min_by(F.struct("doc_id", "text_hash", "sigs"), F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash"))
    classes = sketched.filter("n_shingles > 0").groupBy(*SAME).agg(first.alias("first"))
    return classes.select(*SAME, F.col("d1").alias("rep"), F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"), F.col("first.sigs").alias("sigs"))


def verdicts(docs: DataFrame, words: int, percent: int, cell_docs: int, cell_shingles: int) -> DataFrame:
    """(doc_id, text_hash, d1, d2, n_shingles, component_id, leads), one row for each row of docs; rows that lead are of the first set of their group."""
    sketched = stored(sketches(docs, percent, words), "sketches")
    whole = written()[-1]
    reps = stored(set_classes(sketched), "classes")
    classes = written()[-1]
    # Signatures are most of what is written: a text's are its class' from here on, and those of classes go when they have been compared.
    sketched = thinned(sketched, whole, "doc_id", "text_hash", *SAME)
    slim = [c for c in reps.columns if c != "sigs"]
    if has_few(percent):
        signed = signed_again(docs, reps, percent, words)
        reps = thinned(reps, classes, *slim)
    else:
        signed = reps.select("rep", "sigs")
    # Of each class, the smallest classes that have its signatures, and with how many others it shares them.
    by_sig = signed.select("rep", F.explode("sigs").alias("sig"))
    shared = by_sig.groupBy("sig").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count(F.lit(1)).alias("shares")).filter("low < high").drop("high")
    shared = stored(shared, "shared-signatures")
    freed(docs.sparkSession)
    beside = might_be_in(by_sig, shared, "sig").join(shared, "sig")
    beside = stored(beside.groupBy("rep").agg(F.sort_array(F.collect_set("low")).alias("lows"), F.sum("shares").alias("degree")), "beside")
    if not has_few(percent):
        reps = thinned(reps, classes, *slim)
    freed(docs.sparkSession)
    # A class beside the first of these, and each of them beside the next: members of a group mostly have the same ones.
    chain = F.expr("explode(transform(lows, (low, k) -> struct(if(k = 0, rep, lows[k - 1]) as a, low as b)))")
    edges = beside.select(chain.alias("e")).select("e.a", "e.b")
    return linked_in_regions(docs, sketched, reps, edges, beside.select(F.col("rep").alias("node"), "degree"), words, percent, cell_docs, cell_shingles)


def linked_in_regions(
    docs: DataFrame, sketched: DataFrame, reps: DataFrame, edges: DataFrame, degrees: DataFrame, words: int, percent: int, cell_docs: int = CELL_DOCS, cell_shingles: int = CELL_SHINGLES
) -> DataFrame:
    """What verdicts returns, where classes that could link are connected by edges (a, b); degrees (node, degree) says how near the middle of its group a class may be."""
    regions = components(edges)
    firsts = reps.select(F.col("rep").alias("node"), "first_id", "first_hash")
    # Written, so that its size is known: where it is small, it is broadcast and texts aren't shuffled.
    regions = stored(regions.join(degrees, "node").join(firsts, "node"), "regions")

    @F.arrow_udf("binary")
    def shingled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shingler = Shingler(words)
        for texts in batches:
            yield pa.array([shingler(text).tobytes() for text in texts.to_pylist()], pa.binary())

    members = texts_of(docs, regions).select(F.col("root").cast("string").alias("cell"), F.col("node").alias("rep"), "degree", shingled("text").alias("shingles"))
    members = members.select("cell", "rep", "degree", (F.length("shingles") / 8).cast("long").alias("n"), "shingles").dropDuplicates(["cell", "rep"])
    cells, to_pivots = cut_cells(stored(members, "members"), percent, cell_docs, cell_shingles)

    def join(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("rep", ignore_index=True).drop_duplicates("rep", ignore_index=True)
        found = Region([_set(s) for s in cell["shingles"]], percent, cell["in_body"].tolist()).links
        ids = cell["rep"].to_numpy()
        return pd.DataFrame({"a": ids[[i for i, _, _ in found]], "b": ids[[j for _, j, _ in found]], "by_pivot": np.array([by_pivot for _, _, by_pivot in found], bool)})

    links = cells.groupBy("cell").applyInPandas(join, "a long, b long, by_pivot boolean")
    links = stored(links if to_pivots is None else links.union(to_pivots.withColumn("by_pivot", F.lit(True))), "links")
    roots = components(links.select("a", "b"))
    order = F.struct(F.col("first_id").isNull().alias("last"), "first_id", "node")
    groups = roots.join(firsts, "node").groupBy("root").agg(F.min(order).alias("first"))
    classes = reps.select(*SAME, "rep", "first_id", "first_hash").join(roots.join(groups, "root").select(F.col("node").alias("rep"), "first"), "rep", "left")
    classes = classes.select(*SAME, F.coalesce("first.first_id", "first_id").alias("component_id"), F.coalesce(F.col("first.node") == F.col("rep"), F.lit(True)).alias("leads"))
    with_words = sketched.filter("n_shingles > 0").select("doc_id", "text_hash", *SAME).join(classes, SAME)
    without = sketched.filter("n_shingles = 0").select("doc_id", "text_hash", *SAME, F.col("doc_id").alias("component_id"), F.lit(True).alias("leads"))
    return with_words.unionByName(without)


def jaccard_components(docs: DataFrame, percent: int = PERCENT, cell_docs: int = CELL_DOCS, cell_shingles: int = CELL_SHINGLES, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of docs."""
    return verdicts(docs, words, percent, cell_docs, cell_shingles).select("doc_id", "n_shingles", "component_id")


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each group of linked sets, that of the smallest id, null being the last; rows whose text has no words all stay.

    Where an id repeats with different sets, each has its own verdict. Of rows with an equal id and text, any one stays.
    """
    keys = ["doc_id", "text_hash"]
    found = stored(verdicts(docs, words, percent, CELL_DOCS, CELL_SHINGLES).filter("n_shingles > 0"), "verdicts")
    order = F.struct(F.col("doc_id").isNull().alias("last"), *keys)
    kept = found.filter("leads").groupBy(*[F.col(c).alias(f"_{c}") for c in ("d1", "d2", "n_shingles")]).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    # Only rows that go, or that repeat, are looked up, so that most texts needn't be.
    marked = found.join(kept, [F.col(c) == F.col(f"_{c}") for c in ("d1", "d2", "n_shingles")], "left")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    marked = marked.select(*keys, (~F.col("leads") | (F.col("rows").isNotNull() & ~is_first)).alias("goes"), F.col("rows").isNotNull().alias("again"))
    marked = marked.groupBy(*[F.col(c).alias(f"_{c}") for c in keys]).agg(F.max("goes").alias("_goes"), F.count_if("again").alias("_again")).filter("_goes or _again > 1")
    marked = stored(marked, "marked")
    told = told_apart(docs.withColumns({"_doc_id": F.col("doc_id"), "_text_hash": F.xxhash64("text")}), marked, "_doc_id", "_text_hash")
    mark = marked.select(F.col("_doc_id").alias("_id"), F.col("_text_hash").alias("_hash"), "_goes", "_again")
    looked = told.filter("_might").join(mark, F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left").filter("not coalesce(_goes, false)")
    again = looked.filter("_again is not null").dropDuplicates(["_doc_id", "_text_hash"])
    parts = [told.filter("not _might"), looked.filter("_again is null"), again]
    return reduce(DataFrame.union, [part.select(*docs.columns) for part in parts])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM w),
c AS (SELECT s, min(doc_id) AS rep FROM (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0) GROUP BY s),
e AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM c),
p AS (
  SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
q AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(a, b) AS (SELECT a, b FROM q UNION SELECT r.a, q.b FROM r JOIN q ON r.b = q.a),
k AS (SELECT a AS rep, least(a, min(b)) AS root FROM r GROUP BY a)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(k.root, c.rep, s.doc_id) AS component_id
FROM s LEFT JOIN c ON list_sort(s.s) = c.s LEFT JOIN k ON k.rep = c.rep
"""
