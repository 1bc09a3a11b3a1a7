"""Media columns: interleaved sequences of text and media references, with payloads resolved by digest.

HTML becomes an ordered list of items: text blocks, and media references with their captions. A reference names its payload by
digest (`sha256:` and hex digits, a data URI whose bytes are hashed, or an address looked up in a table of addresses and
digests). Exploded references join the media table on the digest and go back to their places, so positions and captions
stay with their payloads; unresolved references stay too, with null media. The store is content-addressed: equal payloads have
one digest, and the join carries facts about a payload, never its bytes, unless payloads are asked for.

Samples are kept as PNG, 64 RGB pixels of 8 bits a row: lossless, checksummed, self-describing.

Null and empty pages have no items, null and empty texts a payload of padding alone. Repeated rows give equal results; equal texts are one
payload. Very long texts are one medium. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import struct
import urllib.parse
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import in_arrow, split_by_ids, written
from clickloom.llm.html_tokens import INLINE, attributes, one_line, tokens

ROW_BYTES = 192
_PNG = b"\x89PNG\r\n\x1a\n"
_MEDIA = {"img", "video", "audio", "source", "embed", "object"}
_SILENT = {"script", "style", "noscript", "template", "head", "title", "svg"}
ITEM = "struct<position:int, kind:string, text:string, source:string, digest:string, caption:string>"
FACTS = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(text: str | None) -> bytes:
    """A text as UTF-8, with spaces up to a positive multiple of a row."""
    raw = (text or "").encode()
    return raw + b" " * (ROW_BYTES - len(raw) if not raw else -len(raw) % ROW_BYTES)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def to_png(payload: bytes) -> bytes:
    """Whole rows of samples as a PNG file."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES)
    lines = np.zeros((len(rows), ROW_BYTES + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW_BYTES // 3, len(rows), 8, 2, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of a PNG file of to_png's kind; every checksum is verified."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG file")
    at, data, size = 8, [], None
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("a chunk has another checksum")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[2:] != (8, 2, 0, 0, 0):
        raise ValueError("not 8-bit RGB")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], 3 * size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Average hash over an 8 by 8 grid of brightness, and the mean of each channel in thousandths."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES // 3, 3).astype(np.int64)
    bright = pixels.sum(axis=2).reshape(len(pixels), 8, -1).sum(axis=2)
    edges = np.arange(9) * len(bright) // 8
    sums = np.concatenate([np.zeros((1, 8), np.int64), np.cumsum(bright, axis=0)])
    low, high = edges[:-1], np.maximum(edges[1:], edges[:-1] + 1)
    grid = (sums[high] - sums[low]) * 840 // (high - low)[:, None]
    bits = (grid.ravel() * 64 > grid.sum()).astype(np.uint8)
    means = pixels.reshape(-1, 3).sum(axis=0) * 1000 // (len(pixels) * ROW_BYTES // 3)
    return np.packbits(bits).tobytes().hex() + ":" + ":".join(map(str, means.tolist()))


def items(page: str | None) -> list[dict]:
    """Text blocks and media references in page order; a figure's caption, or else the alternative text, goes with the reference."""
    out: list[dict] = []
    text: list[str] = []
    silent = caption = 0
    own_caption: list[str] = []
    figures: list[int] = []  # where each open figure's items begin
    open_tags: list[str] = []

    def end_block() -> None:
        block = one_line("".join(text))
        text.clear()
        if block:
            out.append({"kind": "text", "text": block, "source": None, "digest": None, "caption": None})

    def leave(tag: str) -> None:
        nonlocal silent, caption
        if tag in _SILENT:
            silent -= 1
        elif tag == "figcaption":
            caption -= 1
        elif tag == "figure" and figures:
            end_block()
            first, words = figures.pop(), one_line("".join(own_caption))
            own_caption.clear()
            for item in out[first:]:
                if item["kind"] == "media" and words:
                    item["caption"] = words
        if tag not in INLINE:
            end_block()

    for kind, value, raw in tokens(page or ""):
        if kind == "text":
            if not silent:
                (own_caption if caption else text).append(value)
        elif kind == "open":
            if value not in INLINE or value == "img":
                end_block()
            if value in _MEDIA and not silent:
                found = attributes(raw)
                if source := found.get("src") or found.get("data"):
                    out.append({"kind": "media", "text": None, "source": source, "digest": digest_of(source), "caption": one_line(found.get("alt", "")) or None})
            silent += value in _SILENT
            caption += value == "figcaption"
            if value == "figure":
                figures.append(len(out))
            open_tags.append(value)
        elif value in open_tags:
            while True:
                last = open_tags.pop()
                leave(last)
                if last == value:
                    break
    while open_tags:
        leave(open_tags.pop())
    end_block()
    return [{"position": k, **item} for k, item in enumerate(out)]


def digest_of(source: str) -> str | None:
    """The digest that a reference itself tells."""
    if re.fullmatch(r"sha256:[0-9a-f]{64}", source):
        return source[7:]
    if source.startswith("data:") and "," in source:
        head, body = source.split(",", 1)
        try:
            data = base64.b64decode(body, validate=True) if head.endswith(";base64") else urllib.parse.unquote_to_bytes(body)
        except (binascii.Error, ValueError):
            return None
        return hashlib.sha256(data).hexdigest()
    return None


_ARROW_ITEM = pa.struct([("position", pa.int32()), *((k, pa.string()) for k in ("kind", "text", "source", "digest", "caption"))])


def interleaved(pages: DataFrame, *carried: str) -> DataFrame:
    """page_id and its items in order, from columns page_id and html; other columns can be carried along."""
    kinds = "".join(f", {c} {pages.schema[c].dataType.simpleString()}" for c in carried)

    def run(batches):
        for batch in batches:
            own = pa.array([items(x) for x in batch.column(1).to_pylist()], pa.list_(_ARROW_ITEM))
            yield pa.RecordBatch.from_arrays([batch.column(0), own, *(batch.column(2 + k) for k in range(len(carried)))], names=["page_id", "items", *carried])

    return in_arrow(pages.select(F.col("page_id").cast("long"), F.col("html").cast("string"), *carried), run, f"page_id long, items array<{ITEM}>{kinds}")


def resolved(sequences: DataFrame, media: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    """Each sequence with a `media` struct in every item: the row of `media` (one per digest, see facts) that its digest names. addresses: source, digest."""
    columns = [c for c in media.columns if c != "digest"]
    placed = sequences.select("page_id", F.explode_outer("items").alias("item"))
    own = placed.select("page_id", "item", F.col("item.digest").alias("digest"))
    if addresses is not None:
        known = addresses.select(F.col("source").alias("address"), F.col("digest").alias("known")).dropDuplicates(["address"])
        own = own.join(known, F.col("item.source") == F.col("address"), "left").select("page_id", "item", F.coalesce("digest", "known").alias("digest"))
    found = own.join(media.select(F.col("digest").alias("key"), F.struct(*columns).alias("media")), F.col("digest") == F.col("key"), "left")
    item = F.struct(F.col("item.position").alias("position"), *(F.col(f"item.{c}").alias(c) for c in ("kind", "text", "source")), F.col("digest").alias("digest"), F.col("item.caption").alias("caption"), "media")
    return found.groupBy("page_id").agg(F.array_sort(F.collect_list(F.when(F.col("item").isNotNull(), item))).alias("items"))


def named(docs: DataFrame) -> DataFrame:
    """Written: doc_id, the size of each text and the digest of its payload."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len((x or "").encode()) for x in texts], pa.int64()), pa.array([hashlib.sha256(padded(x)).hexdigest() for x in texts], pa.string())], names=["doc_id", "n_bytes", "digest"]
            )

    return written(in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_bytes long, digest string"))


def stored(docs: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The media store, written: digest and the PNG that holds a text's bytes, once for each digest (rows that share a doc_id, or have none, are stored each).

    Copies are found on the digests alone; only texts that may be copies are shuffled to leave them out.
    """
    names = named(docs) if names is None else names
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    heads = names.groupBy("digest").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).where("n > 1").select("digest", "head")
    single = names.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("digest").alias("digest")).where("rows = 1")
    copies = written(single.join(heads, "digest").where("doc_id > head").select("doc_id"))
    likely, others = split_by_ids(docs, copies)
    once = likely.join(copies.hint("merge"), "doc_id", "left_anti").unionByName(others)

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at in range(0, len(texts), 500):
                payloads = [padded(x) for x in texts[at : at + 500]]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()), pa.array([to_png(p) for p in payloads], pa.binary())], names=["digest", "media"])

    return written(in_arrow(once.select("text"), run, "digest string, media binary"))


def facts(store: DataFrame) -> DataFrame:
    """Read every stored medium back; one row per digest with what its samples and its file show."""

    def run(batches):
        for batch in batches:
            digests, columns = batch.column(0).to_pylist(), [[] for _ in range(6)]
            for digest, media in zip(digests, batch.column(1).to_pylist(), strict=True):
                payload = from_png(media)
                sha = hashlib.sha256(payload).hexdigest()
                if sha != digest:
                    raise ValueError("a stored medium doesn't match its digest")
                for c, x in zip(columns, (len(payload), sha, zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)), strict=True):
                    c.append(x)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in FACTS.split(", ")])

    every = in_arrow(store.select("digest", "media"), run, FACTS)
    rest = [c for c in every.columns if c != "digest"]
    return every.groupBy("digest").agg(F.min(F.struct(*rest)).alias("x")).select("digest", "x.*")


#: Figures on one page of the query.
FIGURES = 32


def galleries(names: DataFrame) -> DataFrame:
    """page_id, html and members: documents on end shown on one page, each as a heading, a figure that refers to its payload by digest, and a note."""
    paged = names.withColumn("_row", F.monotonically_increasing_id()).withColumn("page_id", F.floor(F.col("_row") / FIGURES))
    pages = paged.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("_row", "doc_id", "n_bytes", "digest"))).alias("members"))
    one = lambda x: F.concat(F.lit("<h2>Row "), x["_row"].cast("string"), F.lit('</h2><figure><img src="sha256:'), x["digest"], F.lit('"><figcaption>Text of row '), x["_row"].cast("string"), F.lit("</figcaption></figure><p>End.</p>"))
    return pages.select("page_id", F.array_join(F.transform("members", one), "").alias("html"), "members")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every text stored as a medium; pages show the texts in order and refer to them by digest; from the pages' items the media are resolved, each figure in its place."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = named(docs)
    known = written(facts(stored(docs, names)))  # written, so that Spark may split the join of a hot digest
    shown = interleaved(galleries(names), "members")
    figures = F.filter("items", lambda x: x["kind"] == "media")
    placed = shown.select(F.explode(F.arrays_zip(figures.alias("item"), F.col("members").alias("member"))).alias("x")).select("x.item", "x.member")
    # a figure's caption tells whose it is: anything out of place is an error
    aligned = F.col("item.caption") == F.concat(F.lit("Text of row "), F.col("member._row").cast("string"))
    digest = F.when(aligned, F.col("item.digest")).otherwise(F.raise_error(F.lit("a figure has another's caption")).cast("string"))
    rows = placed.select(F.col("member.doc_id").alias("doc_id"), F.col("member.n_bytes").alias("n_bytes"), digest.alias("digest"))
    return rows.join(known, "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
