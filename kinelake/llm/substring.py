"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

The corpus is its own reference.  A document is parsed as the sequence of its 50-word windows' fingerprints.  Every
window has an anchor, the least hash of its 10-word runs, which its words alone decide; a reference block is everything
filed under a range of (mixed) anchors, so all places where a passage of 50 words stands meet in one block, and every
document is parsed against every block that holds any of its windows.

A block's index holds each fingerprint once, with its place in the smallest document that has it.  The parse of a
stretch is greedy: at the first window that the index knows from a smaller document, the factor is extended along the reference,
window by window, for as long as both go on alike; ``k`` windows are a factor of ``k + 49`` words, all
removed.  The windows that straddle the factor's end are checked next: the parse goes on at the first window behind the factor's
last that the index knows.  All stretches of a block take their next factor at once.  Within a chunk a factor is also held
against the words themselves; between chunks a window's fingerprint is 104 bits (its anchor's 64 and 40 of its own).

Hot passages: each task first parses its own documents against each other and sends on, for each window,
only the rows with the smallest id it has, so a block gets at most one chunk's worth of rows from each chunk.  Where
there are more than ``FAN`` chunks, blocks are merged in a tree: ``FAN`` chunks at once, each merge sending on the smallest id's rows again.

Memory: a chunk or block holds about ``CHUNK_WINDOWS`` or ``BLOCK_WINDOWS`` windows (some 40 bytes each), or one longer text; a passage
adds at most ``FAN`` copies to a merge.

Defined results: null or blank text has no words; documents below 50 words lose none; rows that share an
id aren't smaller than each other, so they don't remove each other's words; a null id counts as larger
than any other; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm._common import bounded_batches, release, text_bytes
from kinelake.llm._hashing import mixed, sliding_min, window_hashes, word_hashes

LENGTH = 50
ANCHOR = 10
#: Windows that one task parses against each other, and that one reference block holds on average.
CHUNK_WINDOWS = 1_200_000
BLOCK_WINDOWS = 1_500_000
#: Chunks merged at once.
FAN = 4096
#: Fingerprints held against the reference at once for each factor.
STEP = 32
LAST = np.iinfo(np.int64).max
_SEGMENT = np.dtype([("anchor", "<u8"), ("id", "<i8"), ("key", "<i8"), ("start", "<i4"), ("n", "<i4")])
_SPAN = np.dtype([("id", "<i8"), ("key", "<i8"), ("start", "<i4"), ("end", "<i4")])


def _runs(same: np.ndarray) -> np.ndarray:
    """Where runs begin, given whether each element goes on with the one before (from the second on)."""
    return np.flatnonzero(np.concatenate([[True], ~same]))


def _index(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each window the place of the same window in the smallest document that has it, the first there."""
    order = np.lexsort((ids, key))
    k = key[order]
    first = _runs(k[1:] == k[:-1])
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(order[first], np.diff(first, append=len(k)))
    return out


def _common(x: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many values of ``x`` from ``a`` on equal those from ``b`` on, ``room`` at most."""
    n = np.zeros(len(a), np.int64)
    on = np.arange(len(a))
    while len(on):
        go = []
        for part in np.array_split(on, len(on) // 8192 + 1):
            step = n[part][:, None] + np.arange(STEP)
            inside = step < room[part][:, None]
            step = np.where(inside, step, 0)
            same = inside & (x[a[part][:, None] + step] == x[b[part][:, None] + step])
            length = np.where(same.all(axis=1), STEP, same.argmin(axis=1))
            n[part] += length
            go.append(part[length == STEP])
        on = np.concatenate(go)
    return n


def factors(key: np.ndarray, stretch: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The greedy factors (first window, its reference, number of windows) of all stretches against smaller documents.

    ``key``: fingerprints of windows, stretch by stretch; ``ids``: each stretch's document.
    """
    ref = _index(key, ids[stretch])
    at = np.flatnonzero(ids[stretch] > ids[stretch[ref]])
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none
    end = np.searchsorted(stretch, np.arange(len(ids)), "right")
    first = _runs(stretch[at][1:] == stretch[at][:-1])
    cur, last = first, np.append(first[1:], len(at))
    found = []
    while len(cur):  # every stretch takes its next factor
        i = at[cur]
        p = ref[i]
        n = _common(key, i, p, np.minimum(end[stretch[i]] - i, end[stretch[p]] - p))
        found.append((i, p, n))
        cur = np.searchsorted(at, i + n)
        go = cur < last
        cur, last = cur[go], last[go]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _marked(start: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` windows lie in a factor."""
    mark = np.zeros(size + 1, np.int64)
    np.add.at(mark, start, 1)
    np.add.at(mark, start + n, -1)
    return np.cumsum(mark[:-1]) > 0


def _spans(row: np.ndarray, pos: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one row at consecutive positions, as (row, start, end) of their words."""
    if not len(row):
        return row, pos, pos
    first = _runs((row[1:] == row[:-1]) & (pos[1:] == pos[:-1] + 1))
    last = np.append(first[1:], len(row)) - 1
    return row[first], pos[first], pos[last] + length


def _parse_chunk(ids: np.ndarray, keys: np.ndarray, texts: list[bytes], blocks: int, length: int, anchor: int) -> Iterator[tuple[int, bytes]]:
    """Parse a chunk against itself; yield (block, payload) of what other chunks must see, and its own spans."""
    words, counts = word_hashes(texts)
    n = len(words) - length + 1
    if n <= 0:
        return
    row = np.repeat(np.arange(len(texts)), counts)
    valid = row[:n] == row[length - 1 :]
    whole = window_hashes(words, length)
    least = sliding_min(window_hashes(words, anchor), length - anchor + 1)
    at = np.flatnonzero(valid)
    pos = (at - (np.cumsum(counts) - counts)[row[at]]).astype(np.int32)
    row, whole, least = row[at], whole[at], least[at]
    i, p, k = factors(whole, row, ids)
    same = _common(words, at[i], at[p], k + length - 1) == k + length - 1
    if not same.all():  # a hash stood for two windows; what its factor held goes on to the blocks
        i, k = i[same], k[same]
    known = _marked(i, k, len(row))
    r, s, e = _spans(row[known], pos[known], length)
    if len(r):
        spans = np.empty(len(r), _SPAN)
        spans["id"], spans["key"], spans["start"], spans["end"] = ids[r], keys[r], s, e
        yield int(mixed(np.array([len(r)], np.uint64))[0] % np.uint64(blocks)), _packed(spans, np.zeros(0, _SEGMENT), np.zeros((0, 5), np.uint8))
    row, pos, whole, least = row[~known], pos[~known], whole[~known], least[~known]
    if not len(row):
        return
    block = (mixed(least) % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    row, pos, whole, least, block = row[order], pos[order], whole[order], least[order], block[order]
    first = _runs((row[1:] == row[:-1]) & (pos[1:] == pos[:-1] + 1) & (least[1:] == least[:-1]))
    seg = np.empty(len(first), _SEGMENT)
    seg["anchor"], seg["id"], seg["key"], seg["start"], seg["n"] = least[first], ids[row[first]], keys[row[first]], pos[first], np.diff(first, append=len(row))
    low = np.ascontiguousarray(whole.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])  # 40 bits; the anchor tells apart the rest
    present, begins = np.unique(block, return_index=True)
    for b, i, j in zip(present.tolist(), begins.tolist(), [*begins[1:].tolist(), len(block)], strict=True):
        x, y = np.searchsorted(first, (i, j))
        yield b, _packed(np.zeros(0, _SPAN), seg[x:y], low[i:j])


def _packed(spans: np.ndarray, seg: np.ndarray, low: np.ndarray) -> bytes:
    import zstandard

    head = np.array([len(spans), len(seg)], "<i8").tobytes() + spans.tobytes() + seg.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head) + low.tobytes()


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    d = zstandard.ZstdDecompressor().decompressobj()
    head = d.decompress(payload)
    spans, segments = np.frombuffer(head, "<i8", 2)
    at = 16 + spans * _SPAN.itemsize
    low = np.frombuffer(d.unused_data, np.uint8).reshape(-1, 5)
    return np.frombuffer(head, _SPAN, spans, 16), np.frombuffer(head, _SEGMENT, segments, at), low


PAYLOAD = "block long, chunk long, payload binary"
SPANS = "id long, key long, start int, end int"


def _parse_block(length: int, last: bool = True):
    """Parse what is filed under one block; the last merge returns the spans, others send on what is left beside them."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpack(p) for p in table["payload"].to_pylist()]
        own = np.concatenate([p[0] for p in parts])
        seg = np.concatenate([p[1] for p in parts])
        low = np.concatenate([p[2] for p in parts])
        del parts
        n = seg["n"]
        which = np.repeat(np.arange(len(seg)), n)
        pos = seg["start"][which] + (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        wide = np.zeros((len(low), 8), np.uint8)
        wide[:, :5] = low
        key = mixed(seg["anchor"][which]) + wide.view("<u8").ravel() * np.uint64(0x9E3779B97F4A7C15)
        i, _, k = factors(key, which, seg["id"])
        spans = np.empty(len(i), _SPAN)
        w = which[i]
        spans["id"], spans["key"], spans["start"], spans["end"] = seg["id"][w], seg["key"][w], pos[i], pos[i] + k + length - 1
        spans = np.concatenate([own, spans])
        if last:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.Table.from_arrays([pa.array(np.ascontiguousarray(spans[f]), t) for f, t in zip(_SPAN.names, kinds, strict=True)], names=list(_SPAN.names))
        left = ~_marked(i, k, len(which))
        which, pos, low = which[left], pos[left], low[left]
        first = _runs((which[1:] == which[:-1]) & (pos[1:] == pos[:-1] + 1)) if len(which) else np.zeros(0, np.int64)
        rest = seg[which[first]]
        rest["start"], rest["n"] = pos[first], np.diff(first, append=len(which))
        return pa.table({"block": table["block"][:1], "chunk": table["chunk"][:1], "payload": pa.array([_packed(spans, rest, low)], pa.binary())})

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows ``id`` (null as the largest), ``key`` (hash of the text) and the text."""
    return bounded_batches(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST))).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))


def duplicate_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``id, key, start, end``: word spans of duplicate passages; spans of a row may overlap."""
    keyed = _keyed(docs, id_col, text_col).select("id", "key", "text")
    n_bytes = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(parts, n_bytes // 6 // BLOCK_WINDOWS + 1)
    anchor = min(ANCHOR, length)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, texts, size = [], [], [], 0
        number = TaskContext.get().partitionId() << 24

        def done() -> Iterator[pa.RecordBatch]:
            for b, payload in _parse_chunk(np.array(ids, np.int64), np.array(keys, np.int64), texts, blocks, length, anchor):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([number], pa.int64()), pa.array([payload], pa.binary())], names=["block", "chunk", "payload"])

        for batch in batches:
            for i, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
                ids.append(i)
                keys.append(k)
                texts.append(t)
                size += len(t)
                if size >= 6 * CHUNK_WINDOWS:
                    yield from done()
                    ids, keys, texts, size = [], [], [], 0
                    number += 1
        yield from done()
        release()

    filed = keyed.mapInArrow(chunks, PAYLOAD)
    groups = n_bytes // (6 * CHUNK_WINDOWS * FAN) + 1
    while groups > 1:
        filed = filed.withColumn("chunk", F.pmod(F.xxhash64("chunk"), F.lit(groups)))
        filed = filed.groupBy("block", "chunk").applyInArrow(_parse_block(length, last=False), PAYLOAD)
        groups = -(-groups // FAN) if groups > FAN else 1
    return filed.groupBy("block").applyInArrow(_parse_block(length), SPANS)


def remove_spans(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    """The words outside all spans."""
    if not spans:
        return words
    mark = np.zeros(len(words) + 1, np.int64)
    s, e = np.array(spans).T
    np.add.at(mark, s, 1)
    np.add.at(mark, e, -1)
    keep = np.cumsum(mark[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def without_duplicates(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, n_words, n_removed, kept``: every document's words without duplicate passages, joined by single spaces."""
    return _removed(docs, length, id_col, text_col, lambda kept: kept.decode("utf-8", "replace"), "kept string")


def _removed(docs: DataFrame, length: int, id_col: str, text_col: str, form, column: str) -> DataFrame:
    spans = duplicate_spans(docs, length, id_col, text_col).groupBy("id", "key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    rows = _keyed(docs, id_col, text_col).join(spans, ["id", "key"], "left").select("doc_id", "text", F.col("spans.start").alias("s"), F.col("spans.end").alias("e"))
    name, kind = column.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n, removed, out = [], [], []
                for t, s, e in zip(text_bytes(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    words = t.split()
                    kept = remove_spans(words, list(zip(s, e, strict=True)) if s else [])
                    n.append(len(words))
                    removed.append(len(words) - len(kept))
                    out.append(form(b" ".join(kept)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", name])

    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_removed long, {name} {kind}")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _removed(docs, LENGTH, "doc_id", "text", lambda kept: hashlib.sha256(kept).hexdigest(), "kept_sha256 string")
