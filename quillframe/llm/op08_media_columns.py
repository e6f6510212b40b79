"""Media columns: interleaved document sequences of text and media.

HTML becomes an ordered sequence of structs, one for each block of text and each media reference,
with captions attached to the reference they describe. References name payloads by digest; a join on
that digest resolves them, so positions and captions stay aligned with what was resolved. Digests that more than a
thousandth of all references name are at most a thousand: these are dealt over SALTS keys on both sides. Media are
stored apart, as binary PGM images: 8-bit samples in rows of 64, the exact length in a
header comment, so that every byte string comes back as it was. A task writes a digest it has seen once only, and features are
computed from what was written.

A document's page holds its own lines as paragraphs, a figure of the whole text behind the first of them and a figure of its last row behind the
last. The query takes its columns from the two figures, by the captions, and gives where they stand and a hash of the paragraphs in order. Pages are made and parsed in one
pass, and hashes of their paragraphs and their references are what is written of them.

Cases: null HTML gives no rows. A reference that no medium has keeps its row with null media columns.
Media that repeat a digest are equal and count once. A figure without a caption has a null caption;
one with several media gives its caption to each. A null text is stored as an empty one, of 64 zero bytes, and has no paragraphs. Very long texts are stored whole. Tables without
rows give none.
Rows that repeat an id, or have none, each come out. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import read, stored

ROW = 64
SCHEME = "media:"
#: Keys that a frequent digest is dealt over.
SALTS = 32
#: Digests that a task remembers to have written; beyond it, it begins anew and may write some again.
SEEN = 200_000
WHOLE, LAST = "whole text", "last row"

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1[^>]*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>"[^"]*"|'[^']*'|[^'">])*)>""", re.S | re.I)
_SOURCE = re.compile(r"""(?:^|\s)src\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_MEDIA = frozenset("img audio video source embed".split())
_INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em i ins kbd mark q s samp small span strong sub sup time u var wbr".split())


def pad(payload: bytes) -> bytes:
    """payload with zero bytes up to a positive multiple of ROW."""
    return payload + b"\0" * (max(-(-len(payload) // ROW), 1) * ROW - len(payload))


def encode(payload: bytes) -> bytes:
    """The stored form: a binary PGM of the padded payload, with the unpadded length in a comment."""
    samples = pad(payload)
    return b"P5\n#n_bytes=%d\n%d %d\n255\n" % (len(payload), ROW, len(samples) // ROW) + samples


def decode(medium: bytes) -> tuple[int, bytes]:
    """Unpadded length and samples of a stored form."""
    head = re.match(rb"P5\n#n_bytes=(\d+)\n(\d+) (\d+)\n255\n", medium)
    n, width, height = map(int, head.groups())
    samples = medium[head.end() :]
    if len(samples) != width * height:
        raise ValueError(f"{len(samples)} samples of {width} x {height}")
    return n, samples


def feature(samples: bytes) -> str:
    """Rows, mean, deviation, entropy in bits, and a 64-bit hash of whether each column is brighter than the mean."""
    grid = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    shares = np.bincount(grid.ravel(), minlength=256) / grid.size
    held = shares[shares > 0]
    columns = grid.mean(axis=0) > grid.mean()
    bits = int("".join("1" if c else "0" for c in columns), 2)
    return f"rows={len(grid)} mean={grid.mean():.3f} std={grid.std():.3f} entropy={abs(-(held * np.log2(held)).sum()):.4f} hash={bits:016x}"


def sequence(page: str | None) -> list[tuple[int, str, str | None, str | None, str | None]]:
    """(pos, kind, text, ref, caption) in page order; kind is text or media."""
    items: list[list] = []
    pieces: list[str] = []
    figures: list[dict] = []
    caption: list[str] | None = None

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            items.append(["text", text, None, None])

    def end_figure() -> None:
        flush()
        figure = figures.pop()
        for k in figure["media"]:
            items[k][3] = figure["caption"]

    page, at = page or "", 0
    while True:
        found = _TOKEN.search(page, at)
        text = entities.unescape(page[at : found.start() if found else len(page)])
        (pieces if caption is None else caption).append(text)
        if found is None:
            break
        at, tag = found.end(), (found.group(3) or "").lower()
        if not tag or tag in _INLINE:
            continue
        if tag == "figcaption" and figures:
            if found.group(2) and caption is not None:
                figures[-1]["caption"], caption = " ".join("".join(caption).split()) or None, None
            elif not found.group(2):
                flush()
                caption = []
        elif tag == "figure" and not found.group(2):
            flush()
            figures.append({"media": [], "caption": None})
        elif tag == "figure" and figures:
            if caption is not None:
                figures[-1]["caption"], caption = " ".join("".join(caption).split()) or None, None
            end_figure()
        elif tag in _MEDIA and not found.group(2) and (source := _SOURCE.search(found.group(4))):
            if caption is None:
                flush()
            ref = entities.unescape(next(g for g in source.groups() if g is not None))
            if figures:
                figures[-1]["media"].append(len(items))
            items.append(["media", None, ref, None])
        elif caption is not None:
            caption.append(" ")
        else:
            flush()
    if caption is not None and figures:
        figures[-1]["caption"] = " ".join("".join(caption).split()) or None
    while figures:
        end_figure()
    flush()
    return [(k, *item) for k, item in enumerate(items)]


ITEM = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])


def item_lists(pages: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """(id, items): each page's sequence as one array."""

    @F.arrow_udf("array<struct<pos:int,kind:string,text:string,ref:string,caption:string>>")
    def items_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = [f.name for f in ITEM]
        for html in batches:
            yield pa.array([[dict(zip(names, item)) for item in sequence(page)] for page in html.to_pylist()], pa.list_(ITEM))

    return pages.select(id_col, items_of(html_col).alias("items"))


def resolved(items: DataFrame, media: DataFrame, id_col: str) -> DataFrame:
    """items (id, pos, kind, text, ref, caption), which are read twice, with the media columns of each reference."""
    items = items.withColumn("_digest", F.when(F.startswith("ref", F.lit(SCHEME)), F.substring("ref", len(SCHEME) + 1, 1 << 30)))
    named = items.filter("_digest is not null").groupBy("_digest").agg(F.count(F.lit(1)).alias("n"))
    total = named.agg(F.sum("n").alias("n")).first()["n"] or 0
    frequent = named.filter(F.col("n") > max(total / 1000, 100)).select(F.col("_digest").alias("_hot"))  # 1,000 rows at most
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(id_col, "pos"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    items = items.join(F.broadcast(frequent), F.col("_digest") == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot")
    salts = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    known = media.dropDuplicates(["digest"]).join(F.broadcast(frequent), F.col("digest") == F.col("_hot"), "left").withColumn("_key", F.explode(salts)).drop("_hot")
    found = items.filter("_digest is not null").join(known, (F.col("_digest") == F.col("digest")) & (F.col("_salt") == F.col("_key")), "left").drop("_digest", "digest", "_salt", "_key")
    return found.unionByName(items.filter("_digest is null").drop("_digest", "_salt"), allowMissingColumns=True)


def interleave(pages: DataFrame, media: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """(id, pos, kind, text, ref, caption) and the media columns of each reference; media has a column digest."""
    return resolved(item_lists(pages, id_col, html_col).select(id_col, F.inline("items")), media, id_col)


def page_of(text: str | None) -> tuple[str, list[bytes]]:
    """A text's page, and the stored forms that it refers to."""
    payload = (text or "").encode()
    media = [encode(payload), encode(pad(payload)[-ROW:])]
    figures = [f'<figure><img src="{SCHEME}{hashlib.sha256(m).hexdigest()}"><figcaption>{c}</figcaption></figure>' for m, c in zip(media, (WHOLE, LAST))]
    lines = [f"<p>{entities.escape(line, quote=False)}</p>" for line in (text or "").split("\n") if line.split()]
    return "".join([*lines[:1], figures[0], *lines[1:], figures[1]]), media


def pages_of(docs: DataFrame) -> DataFrame:
    """(key, doc_id, html): a page for each row, with a key of its own."""

    @F.arrow_udf("string")
    def page(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([page_of(text)[0] for text in texts.to_pylist()], pa.string())

    return docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", page("text").alias("html"))


def store_texts(docs: DataFrame) -> DataFrame:
    """Written: (digest, medium), the stored forms that pages refer to."""

    def stored_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            found: dict[str, bytes] = {}
            for text in batch.column(0).to_pylist():
                for medium in page_of(text)[1]:
                    digest = hashlib.sha256(medium).hexdigest()
                    if digest not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(digest)
                        found[digest] = medium
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.binary())], ["digest", "medium"])

    return stored(docs.select("text").mapInArrow(stored_forms, "digest string, medium binary"), "media")


def media_features(media: DataFrame) -> DataFrame:
    """(digest, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), from the stored bytes."""
    kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    @F.arrow_udf("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    def computed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for media in batches:
            rows = []
            for medium in media.to_pylist():
                n, samples = decode(medium)
                rows.append((n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-ROW:]), len(medium), hashlib.sha256(medium).hexdigest(), feature(samples)))
            columns = zip(*rows) if rows else ((),) * len(kinds)
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))

    return media.select("digest", computed("medium").alias("f")).select("digest", "f.*")


def text_media(docs: DataFrame) -> DataFrame:
    """The media columns of each row's text, from its page's two figures, where these stand, and how many paragraphs there are and a hash of them in order."""
    lists = item_lists(pages_of(docs).select(F.struct("key", "doc_id").alias("row"), "html"), "row")
    blocks = F.transform(F.filter("items", lambda i: i["kind"] == "text"), lambda i: F.sha2(i["text"], 256))
    told = lists.select("row", F.size(blocks).cast("long").alias("n_blocks"), F.unhex(F.sha2(F.array_join(blocks, ""), 256)).alias("blocks_hash"), F.filter("items", lambda i: i["kind"] == "media").alias("items"))
    refs = stored(told, "references").select(F.struct("row.*", "n_blocks", "blocks_hash").alias("row"), F.inline("items"))
    items = resolved(refs, media_features(store_texts(docs)), "row")
    whole = F.struct("n_bytes", "payload_bytes", "payload_sha256", "media_bytes", "media_sha256", "feature", "pos")
    of = lambda caption, value: F.max(F.when(F.col("caption") == caption, value))
    found = items.groupBy("row").agg(of(WHOLE, whole).alias("w"), of(LAST, F.struct("tail_crc32", "pos")).alias("l"))
    return found.select("row.doc_id", "w.*", "l.tail_crc32", F.col("l.pos").alias("last_pos"), "row.n_blocks", F.lower(F.hex("row.blocks_hash")).alias("blocks_sha256"))


COLUMNS = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "last_pos", "n_blocks", "blocks_sha256"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(read(spark, sf_dir, "documents")).select(*COLUMNS)
