"""Media columns: HTML pages as interleaved sequences of text and media references, resolved by digest.

Parsing turns a page into ordered structs: text runs and media references (``img``, ``video``, ``audio``,
``source``), each with its position, and with the caption of its ``figure`` (or its ``alt`` text) beside it.
Payloads live in a media table keyed by the SHA-256 of their stored form.  A join by digest resolves the
references; positions are carried through it, so a sequence is put together again in its own order.

The media table stores payloads as 8-bit greyscale PNG images 64 samples wide, whose reader checks every
chunk's CRC.  What a query needs of a payload is computed where the stored bytes are read back, so the
join moves digests and figures, not payloads; it is a join on distinct digests, whose skew adaptive
execution can split because both sides are exchanged for it; items without a reference get keys of their own in
it, so they don't meet in one task.

Memory: a task holds an Arrow batch (4 MB, or one row where that is longer), the stored forms of some hundred rows and
one payload; texts up to about 1 GB fit a row.

Defined results: null text is the empty payload (64 zero bytes); equal texts give equal values; texts that end in NUL
may share payload and stored form with shorter ones, but keep their own ``n_bytes``; repeated rows keep their rows; a reference that no stored payload answers stays in its place unresolved; null html
is an empty sequence; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm._common import bounded_batches, materialize, text_bytes

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
ITEM = "array<struct<pos: int, kind: string, text: string, ref: string, caption: string>>"
MEDIA_TAGS = {"img", "video", "audio", "source"}
HIDDEN = {"script", "style", "template", "noscript"}


def padded(data: bytes) -> bytes:
    """``data`` followed by zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def to_png(payload: bytes) -> bytes:
    """An 8-bit greyscale image of ``WIDTH`` samples a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row begins with its filter type, 0
    raw[:, 1:] = rows
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of :func:`to_png`'s images; raises on damage."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG image")
    at, width, height, body = len(SIGNATURE), 0, 0, []
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + part):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows are not written here")
    return raw[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and an 8 x 8 average hash of the samples: each bit tells whether a cell is above the mean."""
    a = np.frombuffer(payload, np.uint8)
    total, squares = int(a.sum(dtype=np.int64)), int((a.astype(np.int64) ** 2).sum()) if len(a) < 1 << 20 else sum(int((p.astype(np.int64) ** 2).sum()) for p in np.array_split(a, len(a) >> 18))
    n = len(a)
    edges = np.linspace(0, n // WIDTH, 9).astype(int)
    rows = a.reshape(-1, WIDTH)
    bits = 0
    for i in range(8):
        part = rows[edges[i] : max(edges[i + 1], edges[i] + 1)] if edges[i] < len(rows) else rows[-1:]
        for j in range(8):
            cell = part[:, 8 * j : 8 * j + 8]
            bits = bits << 1 | (int(cell.sum(dtype=np.int64)) * n > total * cell.size)
    variance = max(0, squares * n - total * total) / (n * n)
    return f"{total / n:.4f}:{variance**0.5:.4f}:{bits:016x}"


class _Sequence(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.hidden = 0
        self.figure: list[int] = []  # where the items of each open figure begin
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "figure":
            self.flush()
            self.figure.append(len(self.items))
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in MEDIA_TAGS and dict(attrs).get("src"):
            self.flush()
            a = dict(attrs)
            self.items.append({"kind": "media", "text": None, "ref": a["src"], "caption": a.get("alt")})
        elif tag in {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "tr", "ul", "ol", "table", "nav", "header", "footer", "title"}:
            self.flush()

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            caption, self.caption = " ".join("".join(self.caption).split()), None
            for item in self.items[self.figure[-1] if self.figure else 0 :]:
                if item["kind"] == "media":
                    item["caption"] = caption
        elif tag == "figure" and self.figure:
            self.flush()
            self.figure.pop()
        elif tag not in {"a", "b", "i", "em", "strong", "span", "u", "small", "code", "sub", "sup"}:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def parse_sequence(html: str | None) -> list[dict]:
    """The ordered items of a page."""
    p = _Sequence()
    p.feed(html or "")
    p.close()
    p.flush()
    return [{"pos": i, **item} for i, item in enumerate(p.items)]


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Rows ``id, items``: each page's text runs and media references in order."""
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([parse_sequence(h) for h in part.column(1).to_pylist()], kind)], names=["id", "items"])

    return bounded_batches(pages).select(id_col, html_col).mapInArrow(run, f"id {pages.schema[id_col].dataType.simpleString()}, items {ITEM}")


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text's payload; rows ``uid, id, n_bytes, digest, media``, read back from the shared folder.

    ``uid`` tells rows apart, ``n_bytes`` is the text's length and ``digest`` the SHA-256 of the stored form.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = text_bytes(part.column(1))
                media = [to_png(padded(t)) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, texts), pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()), pa.array(media, pa.binary())], names=["id", "n_bytes", "digest", "media"]
                )

    shape = f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, digest string, media binary"
    stored = bounded_batches(docs).select(id_col, text_col).mapInArrow(run, shape)
    return materialize(stored.select(F.monotonically_increasing_id().alias("uid"), "*"), "media")


FIGURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_media(media: DataFrame) -> DataFrame:
    """Rows ``digest`` and the figures of the payload, computed from the stored bytes; one for each distinct digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[str] = set()
        for batch in batches:
            rows = []
            for digest, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if digest in done:
                    continue
                if len(done) < 100_000:  # only saves work; the distinct below is what counts
                    done.add(digest)
                p = from_png(data)
                rows.append((digest, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature(p)))
            if rows:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["digest", *[x.split()[0] for x in FIGURES.split(", ")]])

    return bounded_batches(media).select("digest", "media").mapInArrow(run, f"digest string, {FIGURES}").dropDuplicates(["digest"])


def resolve(seqs: DataFrame, figures: DataFrame, scheme: str = "media:") -> DataFrame:
    """Join the references of ``seqs`` by digest; rows ``id, pos, kind, text, caption, digest`` and ``figures``' columns."""
    flat = seqs.select("id", F.explode("items").alias("i")).select("id", "i.pos", "i.kind", "i.text", "i.caption", F.when(F.startswith("i.ref", F.lit(scheme)), F.substr("i.ref", F.lit(len(scheme) + 1))).alias("digest"))
    own = F.concat(F.lit("none:"), F.xxhash64("id", "pos").cast("string"))
    flat, known = flat.withColumn("answered", F.coalesce("digest", own)), figures.withColumnRenamed("digest", "answered")
    return flat.join(known, "answered", "left").drop("answered")


def aligned(resolved: DataFrame) -> DataFrame:
    """Resolved items put together again: one row per page, ``items`` in their order."""
    rest = [c for c in resolved.columns if c not in ("id", "pos")]
    return resolved.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", *rest))).alias("items"))


def gallery(media: DataFrame) -> DataFrame:
    """Rows ``id`` (struct ``uid, doc_id, n_bytes``), ``html``: for each stored text a page of a heading, its figure and a closing line."""
    size = F.concat(F.col("n_bytes").cast("string"), F.lit(" bytes"))
    html = F.concat(F.lit('<article><h1>stored text</h1><figure><img src="media:'), F.col("digest"), F.lit('" alt="payload"><figcaption>'), size, F.lit("</figcaption></figure><p>end of "), size, F.lit("</p></article>"))
    return media.select(F.struct("uid", F.col("id").alias("doc_id"), "n_bytes").alias("id"), html.alias("html"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = media_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    figures = materialize(read_media(media), "media-figures")
    pages = aligned(resolve(sequences(gallery(media), "id"), figures))
    item = F.filter("items", lambda i: i["kind"] == "media")[0]
    rows = pages.select("id.doc_id", "id.n_bytes", item.alias("m"), F.size("items").cast("long").alias("n_items"))
    return rows.select("doc_id", "n_bytes", *[f"m.{x.split()[0]}" for x in FIGURES.split(", ")], F.col("m.pos").cast("long").alias("pos"), "m.caption", "n_items")
