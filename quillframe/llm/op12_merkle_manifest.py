"""Merkle dataset manifest: a hash for each document, a root for each source and one for all, and each document's proof.

Leaves are hashed where the texts are read; after that only hashes travel. They are sorted by ranges of (source, id), and a leaf's place in its
source follows from the counts of the ranges before: no source is one task's or one window's. A source is dealt out in aligned blocks of
3 ^ LEVELS places, sources smaller than that share a block, and DuckDB makes a block's levels from its Arrow table with
ordered string_agg and sha256. Spark takes the blocks' roots as the next round's nodes, until each source has one root; these are the nodes
of one more tree. Proofs come back down the same rounds: each block's own proof is joined to it, and DuckDB puts its inner levels before that.

A tree's number is the place of its first leaf among all. A block is written, read and hashed again from tables, so that a lost executor costs its blocks only.

Cases: a null field is hashed as `-`, unlike an empty one; null is a source of its own, before all others. Null ids come first in their source. Rows that repeat an
id are ordered by their leaves; rows that are wholly equal are alike, and each comes out. A source of one document has its leaf for a root, and a table of one source that
source's root. A table without rows has no rows. Very long texts are hashed whole. Other columns are no part of a leaf, whatever their names, and don't come out.
"""

from __future__ import annotations

from functools import cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.llm.common import read, stored

#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a run.
RUN = 3
#: Levels that one block makes: 2,187 nodes at its bottom.
LEVELS = 7

NODE = "tree long, pos long, n long, h string"
PATH = "lefts array<string>, rights array<string>, subroot string, root string"


def leaf(*fields: Column) -> Column:
    """The hash of a row's fields, each with its length, so that no two rows have the same input."""

    def told(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(told, fields)), 256)


def folded(h: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(F.arrays_zip(lefts.alias("l"), rights.alias("r")), h, lambda below, step: F.sha2(F.concat(step["l"], below, step["r"]), 256))


def proof_text(lefts: Column, rights: Column) -> Column:
    """A proof's hashes, level by level, left to right."""
    return F.array_join(F.zip_with(lefts, rights, lambda l, r: F.concat(l, r)), "")


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows and (tree, pos, n): the place of the group's first row among all, the row's place in its group, and the group's rows.

    Ranges, each sorted, are written with the row's number in its range; what comes before a range is the sum of a count for each.
    """
    sort = [group, *order]
    ranged = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_id", F.monotonically_increasing_id())
    ranged = stored(ranged, "ranged").withColumns({"_range": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)})
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("rows"))
    # A row for each range, and so as many as there are tasks.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_start"))
    placed = ranged.join(F.broadcast(stored(starts, "starts")), "_range").withColumn("_place", F.col("_start") + F.col("_at"))
    trees = stored(placed.groupBy(F.col(group).alias("_group")).agg(F.min("_place").alias("tree"), F.count(F.lit(1)).alias("n")), "trees")
    return placed.join(trees, F.col(group).eqNullSafe(F.col("_group"))).select(*rows.columns, "tree", (F.col("_place") - F.col("tree")).alias("pos"), "n")


def in_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes and their block (pack, block): small trees share one by where they start, others have one for each stretch of places."""
    size = RUN**levels
    small = F.col("n") <= size
    return nodes.withColumns({"pack": F.when(small, F.expr(f"tree div {size}")).otherwise(F.col("tree")), "block": F.when(small, -1).otherwise(F.expr(f"pos div {size}"))})


@cache
def engine() -> Any:
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})


def made_levels(nodes: pa.Table, levels: int) -> int:
    """Tables level_0, level_1 ... of this block's trees in the engine; returns the last one's number. A tree's last level is its depth in this block."""
    db = engine()
    db.register("nodes", nodes)
    depth = f"len(list_filter({[RUN**k for k in range(levels)]}, lambda below: below < n))"
    db.execute(f"CREATE OR REPLACE TEMP TABLE level_0 AS SELECT tree, pos, n, {depth} AS depth, h FROM nodes")
    top = db.execute("SELECT coalesce(max(depth), 0) FROM level_0").fetchall()[0][0]
    for k in range(top):
        db.execute(f"""CREATE OR REPLACE TEMP TABLE level_{k + 1} AS
            SELECT tree, pos // {RUN} AS pos, n, depth, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM level_{k} WHERE depth > {k} GROUP BY ALL""")
    return top


def fetched(sql: str, types: pa.Schema) -> pa.Table:
    return engine().sql(sql).to_arrow_table().select(types.names).cast(types)


def block_roots(nodes: DataFrame, levels: int) -> DataFrame:
    """(pack, block, tree, pos, n, h): for each block, its trees' roots, or nodes of the level above it."""
    types = pa.schema([("pack", pa.int64()), ("block", pa.int64()), ("tree", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("h", pa.string())])

    def roots(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        pack, number = (k.as_py() for k in key)
        tops = " UNION ALL ".join(f"SELECT tree, pos, n, h FROM level_{k} WHERE depth = {k}" for k in range(made_levels(block, levels) + 1))
        return fetched(f"SELECT {pack} AS pack, {number} AS block, tree, pos, (n + {RUN**levels - 1}) // {RUN**levels} AS n, h FROM ({tops})", types)

    return nodes.select("pack", "block", "tree", "pos", "n", "h").groupBy("pack", "block").applyInArrow(roots, f"pack long, block long, {NODE}")


def with_paths(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """nodes and the hashes to their left and right, level by level up to the root.

    above (pack, block, tree, pos and the path's columns) has this of each block's roots.
    """
    kept = [c for c in nodes.columns if c not in ("pack", "block")]
    schema = ", ".join(f"`{c}` {t}" for c, t in nodes.select(*kept).dtypes) + ", " + PATH
    texts = pa.list_(pa.string())
    path = [pa.field("lefts", texts), pa.field("rights", texts), pa.field("subroot", pa.string()), pa.field("root", pa.string())]

    def down(block: pa.Table, tops: pa.Table) -> pa.Table:
        top, db = made_levels(block, levels), engine()
        db.register("tops", tops)
        for k in range(top, -1, -1):
            known = f"SELECT a.tree, a.pos, t.lefts, t.rights, t.subroot, t.root FROM level_{k} a JOIN tops t USING (tree, pos) WHERE a.depth = {k}"
            lower = f"""SELECT a.tree, a.pos, list_prepend(a.l, b.lefts), list_prepend(a.r, b.rights), b.subroot, b.root FROM (
                SELECT tree, pos, coalesce(lag(h, 2) OVER run, '') || coalesce(lag(h) OVER run, '') AS l, coalesce(lead(h) OVER run, '') || coalesce(lead(h, 2) OVER run, '') AS r
                FROM level_{k} WHERE depth > {k} WINDOW run AS (PARTITION BY tree, pos // {RUN} ORDER BY pos)) a
                JOIN path_{k + 1} b ON a.tree = b.tree AND a.pos // {RUN} = b.pos"""
            db.execute(f"CREATE OR REPLACE TEMP TABLE path_{k} AS {known}" + (f" UNION ALL {lower}" if k < top else ""))
        own = ", ".join(f'n."{c}"' for c in kept)
        types = pa.schema([*(block.schema.field(c) for c in kept), *path])
        return fetched(f"SELECT {own}, p.lefts, p.rights, p.subroot, p.root FROM nodes n JOIN path_0 p USING (tree, pos)", types)

    above = above.select("pack", "block", "tree", "pos", "lefts", "rights", "subroot", "root")
    return nodes.groupBy("pack", "block").cogroup(above.groupBy("pack", "block")).applyInArrow(down, schema)


def climbed(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Each round's nodes, with the block that they were made by (under_pack, under_block), and the trees' roots (pack, block, tree, h) that it gave."""
    rounds, tops = [in_blocks(nodes, levels)], []
    while True:
        made = stored(block_roots(rounds[-1], levels), "block-roots")
        tops.append(made.filter("n = 1"))
        more = made.filter("n > 1")
        if more.isEmpty():
            return rounds, tops
        rounds.append(in_blocks(more.withColumnsRenamed({"pack": "under_pack", "block": "under_block"}), levels))


def manifest(docs: DataFrame, beside: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """(doc_id, h, subroot, root, lefts, rights) for each row of docs, and columns beside, computed from it: its leaf, its source's root, the
    root of all, and its proof: the hashes to the left and to the right of its own, for each level."""
    own = {f"_{k}": c for k, c in enumerate((beside or {}).values())}
    leaves = docs.select("doc_id", "source", leaf(*map(F.col, FIELDS)).alias("h"), *(c.alias(name) for name, c in own.items()))
    leaves = numbered(stored(leaves, "leaves"), "source", ["doc_id", "h"]).drop("source")
    rounds, tops = climbed(stored(leaves, "placed"), levels)
    # The roots of the sources are the leaves of one more tree, in the order of their first leaves.
    subroots = [t.select(F.lit(k).alias("round"), F.col("pack").alias("under_pack"), F.col("block").alias("under_block"), F.col("tree").alias("under"), "h") for k, t in enumerate(tops)]
    sources = subroots[0]
    for more in subroots[1:]:
        sources = sources.union(more)
    sources = numbered(sources.withColumn("all", F.lit(0)), "all", ["under"]).drop("all")
    outer, ends = climbed(stored(sources, "sources"), levels)
    none, unknown = F.array().cast("array<string>"), F.lit(None).cast("string")
    above = ends[-1].select("pack", "block", "tree", "pos", none.alias("lefts"), none.alias("rights"), unknown.alias("subroot"), F.col("h").alias("root"))
    for nodes in reversed(outer[1:]):
        above = stored(_under(with_paths(nodes, above, levels)), "outer-paths")
    of_sources = stored(with_paths(outer[0], above, levels), "source-paths")
    found = None
    for k in range(len(rounds) - 1, -1, -1):
        done = of_sources.filter(F.col("round") == k).select(
            F.col("under_pack").alias("pack"), F.col("under_block").alias("block"), F.col("under").alias("tree"), F.lit(0).cast("long").alias("pos"), "lefts", "rights", F.col("h").alias("subroot"), "root"
        )
        above = done if found is None else done.union(_under(stored(found, "paths")).select(*done.columns))
        found = with_paths(rounds[k], above, levels)
    names = [F.col(c).alias(name) for c, name in zip(own, beside or {})]
    return found.select("doc_id", "h", *names, "subroot", "root", "lefts", "rights")


def _under(nodes: DataFrame) -> DataFrame:
    """Paths of nodes as those of the roots of the blocks that made them."""
    return nodes.drop("pack", "block").withColumnsRenamed({"under_pack": "pack", "under_block": "block"})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    tampers = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(tampers, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    proofs = manifest(docs, {"tampered": leaf(*map(F.col, FIELDS[:-1]), text)})
    again = proofs.select(
        "doc_id", F.col("h").alias("leaf"), "subroot", "root", F.sha2(proof_text(F.col("lefts"), F.col("rights")), 256).alias("proof_sha256"),
        folded(F.col("tampered"), F.col("lefts"), F.col("rights")).alias("folded_root"),
    )
    return again.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = r"""
WITH RECURSIVE b AS (
  SELECT *, list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
      lambda i: list_transform(range(0, 8), lambda k: (ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) >> k) & 1)))),
    lambda c, x: CASE WHEN (xor(c, x) & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS crc FROM documents),
t AS (SELECT *, CASE WHEN (xor(crc, 4294967295) & 1) = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM b),
f AS (
  SELECT doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail, coalesce(strlen(changed) || ':' || changed, '-') AS changed FROM t),
h AS (SELECT doc_id, source, sha256(head || tail) AS leaf, sha256(head || changed) AS tampered FROM f),
p AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n FROM h),
i(s, lvl, pos, n, h) AS (
  SELECT s, 0, pos, n, leaf FROM p
  UNION ALL SELECT s, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM i WHERE n > 1 GROUP BY s, lvl, pos // 3, n),
u AS (SELECT s, h, count(*) OVER () AS n FROM i WHERE n = 1),
o(lvl, pos, n, h) AS (
  SELECT 0, s, n, h FROM u
  UNION ALL SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM o WHERE n > 1 GROUP BY lvl, pos // 3, n),
x AS (
  SELECT s, lvl, pos, h, n FROM i WHERE n > 1 UNION ALL SELECT -1, lvl, pos, h, n FROM o WHERE n > 1),
y AS (
  SELECT s, lvl, pos, coalesce(lag(h, 2) OVER w, '') || coalesce(lag(h) OVER w, '') AS l, coalesce(lead(h) OVER w, '') || coalesce(lead(h, 2) OVER w, '') AS r
  FROM x WINDOW w AS (PARTITION BY s, lvl, pos // 3 ORDER BY pos)),
k AS (SELECT unnest(range(0, 40)) AS lvl),
z AS (
  SELECT p.s AS leaf_s, p.pos AS leaf_pos, k.lvl AS place, p.s AS s, k.lvl AS lvl, p.pos // CAST(pow(3, k.lvl) AS BIGINT) AS pos FROM p, k WHERE k.lvl < 20
  UNION ALL SELECT p.s, p.pos, 100 + k.lvl, -1, k.lvl, p.s // CAST(pow(3, k.lvl) AS BIGINT) FROM p, k WHERE k.lvl < 20),
q AS (
  SELECT leaf_s, leaf_pos, string_agg(l || r, '' ORDER BY place) AS proof, list(l || '|' || r ORDER BY place) AS steps FROM z JOIN y USING (s, lvl, pos) GROUP BY leaf_s, leaf_pos),
v AS (
  SELECT p.doc_id, p.leaf, u.h AS subroot, (SELECT h FROM o WHERE n = 1) AS root, sha256(coalesce(q.proof, '')) AS proof_sha256,
    list_reduce(list_concat([p.tampered], coalesce(q.steps, [])), lambda a, c: sha256(split_part(c, '|', 1) || a || split_part(c, '|', 2))) AS folded_root
  FROM p JOIN u ON u.s = p.s LEFT JOIN q ON q.leaf_s = p.s AND q.leaf_pos = p.pos)
SELECT *, folded_root = root AS verified FROM v
"""
