"""WARC archives: written as plain text records by Spark's own writer, read back by boundary-chain verification.

Writing: payload digests are SHA-1 in base32; of records with equal payloads the one with the smallest id is
the ``response``, the others ``revisit`` it and carry no payload.  A record is one string; the text writer ends
each with CRLF CRLF, which is just how WARC records end, so any store that Spark can write takes the archives.
Each task numbers its archives by the bytes written so far: one holds at most ``ARCHIVE_BYTES`` and one record.

Reading: tasks look through stretches of the archives for the version line and emit, for every candidate,
its offset and the offset of its successor (header + Content-Length + CRLF CRLF).  A payload may hold the
same version line, so a candidate proves nothing: per archive, pointer jumping from offset 0 (each round
doubles the length of the jumps) marks what the chain reaches, and only that is kept.  A candidate whose

header or payload is cut off by the end of its stretch is read again, alone, at the length it needs.

Memory: an archive is one value of the scan, at most ``ARCHIVE_BYTES`` and a record when written here; Python gets one stretch or
one long record at a time.  Archives of others above 2 GB are refused by the binary reader.

Defined results: null html is the empty payload; a null id sorts after all others and is written as an
empty field; rows with equal id and payload are responses together if theirs is the smallest id; extra
columns are ignored; an empty table gives empty archives and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm._common import bounded_batches, discard, materialize, new_path

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: Bytes from which an archive takes no more records.
ARCHIVE_BYTES = 64 << 20
STRETCH = 4 << 20
OVERLAP = 1 << 20
#: Archives with cut records up to which their table is broadcast (about 100 bytes each, and 16 for each such record).
BROADCAST_FILES = 50_000
#: Groups of equal payloads up to which their table is broadcast (about 60 bytes each).
BROADCAST_GROUPS = 200_000
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a digest in hex: five hex digits make four letters."""
    letters = []
    for k in range(8):
        n = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(ALPHABET), F.shiftright(n, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Rows ``record``: header and payload of one record for each row of ``pages``, without the closing CRLF CRLF."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    base = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    keyed = base.withColumn("digest", F.sha1(F.encode("payload", "UTF-8"))).withColumn("n", F.octet_length("payload").cast("long"))
    groups = keyed.groupBy("digest", "n").agg(F.min("id").alias("first"), F.count("*").alias("rows")).where("rows > 1 AND first IS NOT NULL").drop("rows")
    groups = materialize(groups, "warc-groups")
    side = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    rows = keyed.join(side, ["digest", "n"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    text_id = F.coalesce(F.col("id").cast("string"), F.lit(""))
    # A line break in a URL would end its header line.
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), text_id, F.lit(">"))),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", "%0A")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("digest")))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))), line("X-Payload-Length", F.col("n").cast("string")))).otherwise(F.lit("")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))),
        F.lit(CRLF),
    )
    return rows.select(F.concat(header, F.when(revisit, F.lit("")).otherwise(F.col("payload"))).alias("record"))


def _numbered(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number = size = 0
        for batch in batches:
            archives = []
            for n in pc.binary_length(batch.column(0)).to_pylist():
                if size >= limit:
                    number, size = number + 1, 0
                size += n + 2 * len(CRLF)
                archives.append(f"{task:06d}-{number:06d}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(archives, pa.string())], names=["record", "archive"])

    return run


def write_warc(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, **cols: str) -> None:
    """Write one record per row of ``pages`` as archives below ``path``."""
    records = bounded_batches(warc_records(pages, **cols)).mapInArrow(_numbered(archive_bytes), "record string, archive string")
    records.write.partitionBy("archive").option("lineSep", CRLF * 2).option("compression", "none").text(path)


def _candidates(stretch: int) -> object:
    kind = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("next", pa.int64()), ("cut", pa.bool_()), ("id", pa.string()), ("type", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, size, view in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows = []
                for m in MAGIC.finditer(view):
                    at = m.start()
                    if at >= stretch:
                        break  # belongs to the next stretch
                    end = view.find(b"\r\n\r\n", at)
                    if end < 0:
                        if start + len(view) < size:
                            rows.append((file, start + at, None, True) + (None,) * 5)
                        continue
                    fields = {k.lower(): v.strip() for k, _, v in (x.partition(b":") for x in view[m.end() : end].split(b"\r\n"))}
                    length = fields.get(b"content-length", b"")
                    if not length.isdigit():
                        continue
                    body, n = end + 4, int(length)
                    nxt = start + body + n + 4
                    if nxt > size:
                        continue
                    if body + n + 4 > len(view):
                        rows.append((file, start + at, nxt, True) + (None,) * 5)
                        continue
                    if view[body + n : body + n + 4] != b"\r\n\r\n":
                        continue
                    payload = view[body : body + n]
                    name = lambda k: fields.get(k, b"").removeprefix(b"<urn:page:").removesuffix(b">").decode("utf-8", "replace")  # noqa: B023, E731
                    kind_ = fields.get(b"warc-type", b"").decode("utf-8", "replace")
                    revisit = kind_ == "revisit"
                    digest = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode() if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    full = int(fields.get(b"x-payload-length") or 0) if revisit else n
                    rows.append((file, start + at, nxt, False, name(b"warc-record-id"), kind_, digest, name(b"warc-refers-to") if revisit else None, full))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    return run


CANDIDATE = "file string, offset long, next long, cut boolean, id string, type string, digest string, refers_to string, payload_bytes long"


def warc_candidates(spark: SparkSession, path: str, stretch: int = STRETCH, overlap: int = OVERLAP) -> DataFrame:
    """Every candidate record of the archives below ``path`` with the offset of its successor."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select(F.col("path").alias("file"), "length", "content")
    parts = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / stretch))).alias("k"), "length", "content")
    views = parts.select("file", (F.col("k") * stretch).alias("start"), F.col("length"), F.substring("content", (F.col("k") * stretch + 1).cast("int"), F.lit(stretch + overlap)).alias("view"))
    found = materialize(views.mapInArrow(_candidates(stretch), CANDIDATE), "warc-candidates")
    whole = found.where("NOT cut")
    while not (cut := found.where("cut")).isEmpty():  # a record is longer than the overlap, or a header is: read these at the length they need
        overlap *= 16
        of_file = materialize(cut.groupBy("file").agg(F.collect_list(F.struct("offset", F.coalesce(F.col("next") - F.col("offset"), F.lit(overlap)).alias("n"))).alias("cuts")), "warc-cuts")
        side = F.broadcast(of_file) if of_file.count() <= BROADCAST_FILES else of_file
        again = files.join(side, "file").select("file", "length", "content", F.explode("cuts").alias("c"))
        views = again.select("file", F.col("c.offset").alias("start"), "length", F.substring("content", (F.col("c.offset") + 1).cast("int"), F.col("c.n").cast("int")).alias("view"))
        found = materialize(views.mapInArrow(_candidates(1), CANDIDATE), "warc-candidates")
        discard(of_file)
        whole = whole.unionByName(found.where("NOT cut"))
    return whole


def reached(offsets: np.ndarray, nexts: np.ndarray) -> np.ndarray:
    """Which candidates the chain from offset 0 reaches, by pointer jumping; ``offsets`` ascend."""
    n = len(offsets)
    jump = np.searchsorted(offsets, nexts)
    jump = np.where((jump < n) & (offsets[np.minimum(jump, n - 1)] == nexts), jump, n)
    jump = np.append(jump, n)
    seen = np.zeros(n + 1, bool)
    seen[0] = n > 0 and offsets[0] == 0
    while True:
        more = seen.copy()
        more[jump[seen]] = True
        more[n] = False
        jump = jump[jump]
        if (more == seen).all() and (jump[seen] == n).all():
            return seen[:n]
        seen = more


def _chain(table: pa.Table) -> pa.Table:
    table = table.sort_by("offset")
    return table.filter(pa.array(reached(table["offset"].to_numpy(), table["next"].to_numpy())))


def read_warc(spark: SparkSession, path: str, **sizes: int) -> DataFrame:
    """The true records of the archives below ``path``: those on each archive's chain."""
    return warc_candidates(spark, path, **sizes).groupBy("file").applyInArrow(_chain, CANDIDATE).drop("cut")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    number = lambda c: F.when(F.col(c) != "", F.col(c).cast("long"))
    return read_warc(spark, path).select(number("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))
