"""N-gram Jaccard join with grouped prefixes.

A document's set is its distinct five-word shingles (lower-cased, hashed to 64 bits).  Two documents link when
their sets' Jaccard similarity is at least ``percent``.

1. Shingles are put in one global order: rare ones first.  The frequency of every shingle of the corpus is
   counted (hashes cut to a width that follows the corpus' size, packed and counted in ranges); the most frequent
   ones, as many as ``LISTED`` bounds, are broadcast with their counts and come last; the others go by hash.
2. Sets that link share a shingle of their prefixes, the first ``n - ceil(percent n) + 1`` in that order.
   Documents with equal sets form one class; classes with identical prefix and size are collapsed into one
   group, and only groups file their prefixes.
3. Ranges of shingles are joined in tasks of bounded size: groups that file the same shingle form a run (shingles
   of more than ``HOT_RUN`` documents, known from the counts, take a way of their own: rows instead of packed ranges, and
   stars around leaders found by aggregation).  Small
   runs give all their pairs; large runs give stars around a few of their groups.  Pairs are filtered by size and
   by the parity bitmaps of their sets (two sets differ in at least as many shingles as their bitmaps in bits),
   which for pairs of runs widen with the sets (2 to 4 bits a shingle, ``WIDEST`` at most),
   then verified on the whole texts, one class standing for each group and linked to the group's others.
4. The links found contract most large runs to one component each.  Runs that still hold several, with those of groups
   of several classes and of pairs of small runs with such a group, are dealt out in blocks of ``BLOCK`` members; a task meets
   two blocks, finds the pairs across components that pass the size and bitmap filters, and returns all of them if they are few
   for its members, else the nearest of each component and how many it held back.  They are verified and contracted, and
   rounds go on until nothing is held back: components are exact, and no task returns more than a multiple of its members.
   That multiple grows only after a round without links, or after ``ROUNDS``.

Memory: a task holds ``CHUNK`` bytes of text with their hashes (or one longer text), or about ``RANGE`` filed shingles, or
about ``MET`` members of runs with two blocks' bits; the driver and every worker hold at most ``LISTED`` counted shingles.

Defined results: null or blank text has the empty set, links with nothing and is its own component; fewer words
than a shingle make one shingle of the whole; rows that share an id but not the text are different documents; a null
id takes part, and a component of null ids has a null id; extra columns are ignored; an empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm._common import bounded_batches, discard, materialize, release, text_bytes
from kinelake.llm._hashing import mixed, powers, window_hashes, word_hashes
from kinelake.llm.components import components

SHINGLE = 5
PERCENT = 75
#: Shingles in the broadcast list of frequent ones (12 bytes each), and the least frequency worth listing.
LISTED = 400_000
FREQUENT = 12
#: Bytes of text handled at once by a task, and filed shingles of one range on average.
CHUNK = 4 << 20
RANGE = 1_000_000
#: Runs up to this size give all pairs; larger ones give stars around ``LEADERS`` groups.
SMALL_RUN = 4
LEADERS = 3
#: Pairs across components for each member up to which a task returns them all, and the nearest of each component it returns beyond.
WORTH = 1
NEAREST = 2
#: Rounds after which a task may return ``WIDER`` times as much each time; a round without links has the same effect.
ROUNDS = 4
WIDER = 8
#: Members of a block, of those of them compared at once, and of the blocks that one task meets on average.
BLOCK = 1024
STRIP = 256
MET = 20_000
#: Documents from which a shingle's run is too large for one task.
HOT_RUN = 1_000_000
#: Nodes and runs up to which a table of them is broadcast (about 30 bytes each).
BROADCAST_NODES = 1_000_000
BITS = 1024
#: Bits of the wide bitmaps of sets too large for ``BITS``, at most (8 KB).
WIDEST = 1 << 16
ONE = np.uint64(1)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of each text."""
    words, counts = word_hashes([t.lower() for t in texts])
    runs = window_hashes(words, size)
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            s = np.sort(runs[at : at + n - size + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n:
            out.append(mixed((words[at : at + n] * powers(size)[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)))
        else:
            out.append(words[:0])
        at += n
    return out


class Order:
    """The global order of shingles: listed ones last, by frequency; the others by hash."""

    def __init__(self, slots: np.ndarray, counts: np.ndarray, shift: int):
        self.slots, self.counts, self.shift = slots, counts, np.uint64(shift)
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(slots & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        self.any_hot = bool((counts > HOT_RUN).any())
        self.hot_run = HOT_RUN

    def hot(self, shingles: np.ndarray) -> np.ndarray:
        """Which shingles form runs that no single task may hold."""
        f = self.frequency(shingles) if self.any_hot else None
        return np.zeros(len(shingles), bool) if f is None else f > self.hot_run

    def frequency(self, shingles: np.ndarray) -> np.ndarray | None:
        """Counts of the listed shingles, 0 for the others; None if none is listed."""
        slot = shingles >> self.shift
        maybe = np.flatnonzero(self.sieve[(slot & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if not len(maybe):
            return None
        i = np.minimum(np.searchsorted(self.slots, slot[maybe]), len(self.slots) - 1)
        hit = self.slots[i] == slot[maybe]
        if not hit.any():
            return None
        out = np.zeros(len(shingles), np.int64)
        out[maybe[hit]] = self.counts[i[hit]]
        return out

    def prefix(self, s: np.ndarray, percent: int) -> np.ndarray:
        n = len(s)
        k = n - -(-percent * n // 100) + 1
        if len(self.slots) and (f := self.frequency(s)) is not None:
            return s[np.lexsort((s, f))[:k]]
        return s[:k]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def group_key(prefix: np.ndarray, n: int) -> int:
    return int(_signed(mixed((prefix * powers(len(prefix))).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)))[0])


def bitmap(s: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parity of the number of shingles that fall on each of ``bits`` bits (a power of two), as 64-bit words."""
    odd = (np.bincount((s >> np.uint64(7)).astype(np.int64) % bits, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def bitmaps(s: np.ndarray) -> tuple[np.ndarray, bytes | None]:
    """The bitmap of ``BITS`` bits, and that of 2 to 4 bits for each shingle if it is wider (up to ``WIDEST``)."""
    width = min(WIDEST, 1 << (2 * len(s)).bit_length())
    if width <= BITS:
        return bitmap(s), None
    wide = bitmap(s, width)
    return folded(wide, BITS // 64), wide.tobytes()


def folded(wide: np.ndarray, words: int) -> np.ndarray:
    """A bitmap brought to fewer bits: parities of bits that then fall together add up."""
    while len(wide) > words:
        wide = wide[: len(wide) // 2] ^ wide[len(wide) // 2 :]
    return wide


def _chunked(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        texts = text_bytes(batch.column(column))
        at = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= CHUNK or i == len(texts) - 1:
                yield batch.slice(at, i + 1 - at), texts[at : i + 1]
                at, size = i + 1, 0
    release()


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = np.array([len(a) for a in arrays], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack(payload: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(payload)
    at, out = 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(raw, "<i8", len(kinds)).tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


def frequent_shingles(texts: DataFrame, n_bytes: int, ranges: int, listed: int = LISTED) -> tuple[np.ndarray, np.ndarray, int]:
    """The most frequent shingles (as slots of cut hashes), their counts over all documents, and the cut."""
    bits = min(60, max(24, (n_bytes // 6 + 1).bit_length() + 9))
    shift = 64 - bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raw in _chunked(batches, 0):
            slots, counts = np.unique(np.concatenate(shingle_sets(raw)) >> np.uint64(shift), return_counts=True)
            edge = np.searchsorted(slots, (np.arange(ranges + 1, dtype=np.float64) * (2.0**bits / ranges)).astype(np.uint64))
            edge[-1] = len(slots)
            rows = [(b, _pack(np.array([slots[i]], "<u8"), np.diff(slots[i:j]).astype("<u4" if bits <= 32 or np.diff(slots[i:j]).max(initial=0) < 1 << 32 else "<u8").view(np.uint8), np.minimum(counts[i:j], (1 << 31) - 1).astype("<i4"))) for b, (i, j) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)) if j > i]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], names=["range", "payload"])

    def total(table: pa.Table) -> pa.Table:
        slots, counts = [], []
        for p in table["payload"].to_pylist():
            first, steps, c = _unpack(p, "<u8", "u1", "<i4")
            wide = len(c) > 1 and len(steps) == 8 * (len(c) - 1)
            s = np.empty(len(c), np.uint64)
            s[0] = first[0]
            s[1:] = first[0] + np.cumsum(steps.view("<u8" if wide else "<u4").astype(np.uint64))
            slots.append(s)
            counts.append(c)
        s, c = np.concatenate(slots), np.concatenate(counts).astype(np.int64)
        order = np.argsort(s)
        s, c = s[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        c = np.add.reduceat(c, first)
        keep = c >= FREQUENT
        return pa.table({"slot": pa.array(_signed(s[first][keep])), "n": pa.array(c[keep])})

    found = materialize(texts.mapInArrow(count, "range int, payload binary").groupBy("range").applyInArrow(total, "slot long, n long"), "frequent")
    steps = found.groupBy(F.floor(F.log2("n") * 8).alias("step")).count().orderBy(F.desc("step")).collect()  # at most a few hundred rows
    least, have = None, 0
    for step, n in steps:
        if have + n > listed:
            break
        least, have = step, have + n
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), shift
    t = found.where(F.floor(F.log2("n") * 8) >= least).toArrow()
    slots, counts = t["slot"].to_numpy().view(np.uint64), t["n"].to_numpy()
    order = np.argsort(slots)
    return slots[order], counts[order], shift


PROFILE = "doc_id {}, text_hash long, n long, h1 long, h2 long, g long, bits array<long>, wide binary"


def profiles(docs: DataFrame, order, percent: int, ranges: int) -> DataFrame:
    """Two kinds of rows from one pass over the texts.

    For every row of ``docs`` its set's size and two hashes, the group of its prefix, and its bitmaps; with ``range`` and
    ``payload``, packed (shingle, group, size): every group of a chunk files its prefix once.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    schema = f"{PROFILE.format(rows.schema['doc_id'].dataType.simpleString())}, range int, payload binary"
    names = ["doc_id", "text_hash", "n", "h1", "h2", "g", "bits", "wide", "range", "payload"]
    words = BITS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = order.value
        for part, raw in _chunked(batches, 2):
            n, h1, h2, g, bits, wide = [], [], [], [], [], []
            groups: dict[int, tuple[int, np.ndarray]] = {}
            for s in shingle_sets(raw):
                n.append(len(s))
                sums = [mixed(s + np.uint64(c)).sum(keepdims=True, dtype=np.uint64) for c in (1, 2)]
                h1.append(int(_signed(sums[0])[0]))
                h2.append(int(_signed(sums[1])[0]))
                g.append(0)
                if len(s):
                    p = o.prefix(s, percent)
                    g[-1] = group_key(p, len(s))
                    groups.setdefault(g[-1], (len(s), p))
                narrow, broad = bitmaps(s)
                bits.append(narrow)
                wide.append(broad)
            flat = pa.array(np.concatenate(bits) if bits else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * words, flat)
            none = [pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(x, pa.int64()) for x in (n, h1, h2, g)], lists, pa.array(wide, pa.binary()), *none], names=names)
            if out := _filed(groups, o, ranges):
                empty = [pa.nulls(len(out), t) for t in (part.column(0).type, *[pa.int64()] * 5, pa.list_(pa.int64()), pa.binary())]
                yield pa.RecordBatch.from_arrays([*empty, pa.array([b for b, _ in out], pa.int32()), pa.array([p for _, p in out], pa.binary())], names=names)

    return rows.mapInArrow(run, schema)


def _filed(groups: dict[int, tuple[int, np.ndarray]], o: Order, ranges: int) -> list[tuple[int, bytes]]:
    """The prefixes of groups, packed by range."""
    if not groups:
        return []
    keys = np.array(list(groups), np.int64)
    sizes = np.array([n for n, _ in groups.values()], np.int32)
    tokens = np.concatenate([p for _, p in groups.values()])
    owner = np.repeat(np.arange(len(groups), dtype=np.int32), [len(p) for _, p in groups.values()])
    at = np.flatnonzero(~o.hot(tokens))
    at = at[np.argsort(tokens[at])]
    tokens, owner = tokens[at], owner[at]
    where = (mixed(tokens) % np.uint64(ranges)).astype(np.int64)
    at = np.argsort(where, kind="stable")
    tokens, owner, where = tokens[at], owner[at], where[at]
    low = np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 3:])  # the upper 40 bits; the range holds some of the rest
    present, begins = np.unique(where, return_index=True)
    out = []
    for b, i, j in zip(present.tolist(), begins.tolist(), [*begins[1:].tolist(), len(where)], strict=True):
        used, index = np.unique(owner[i:j], return_inverse=True)
        out.append((b, _pack(keys[used], sizes[used].astype("<i4"), index.astype("<i4"), low[i:j].ravel())))
    return out


def hot_runs(texts: DataFrame, order, percent: int) -> DataFrame:
    """Rows ``run, a, b, small`` for shingles of very many documents: ``a`` files the shingle ``run``; with ``b``, a pair to check.

    The leaders of a run are its groups with the least hashes, found by partial aggregation; there are at most as many runs as
    listed shingles, so the leaders are broadcast, and no task holds a run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = order.value
        for _, raw in _chunked(batches, 0):
            rows = set()
            for s in shingle_sets(raw):
                if len(s):
                    p = o.prefix(s, percent)
                    if (h := o.hot(p)).any():
                        g = group_key(p, len(s))
                        rows |= {(t, g, len(s)) for t in _signed(p[h]).tolist()}
            if rows:
                t, g, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(g, pa.int64()), pa.array(n, pa.int64())], names=["run", "a", "n"])

    members = materialize(texts.mapInArrow(run, "run long, a long, n long").distinct(), "hot")
    no = F.lit(False).alias("small")
    out = members.select("run", "a", F.lit(None).cast("long").alias("b"), no)
    for seed in range(LEADERS):
        lead = members.groupBy("run").agg(F.min_by(F.struct("a", "n"), F.xxhash64(F.lit(seed), "a")).alias("l"))
        pairs = members.join(F.broadcast(lead), "run").where((F.col("a") != F.col("l.a")) & (100 * F.least("n", "l.n") >= percent * F.greatest("n", "l.n")))
        out = out.unionByName(pairs.select(F.lit(None).cast("long").alias("run"), F.least("a", "l.a").alias("a"), F.greatest("a", "l.a").alias("b"), no))
    return out


def _join_range(percent: int):
    def run(table: pa.Table) -> pa.Table:
        parts = [_unpack(p, "<i8", "<i4", "<i4", "u1") for p in table["payload"].to_pylist()]
        base = np.cumsum([0, *[len(p[0]) for p in parts]])
        keys, group = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        sizes = np.zeros(len(keys), np.int64)
        sizes[group] = np.concatenate([p[1] for p in parts])
        owner = group[np.concatenate([p[2] + b for p, b in zip(parts, base, strict=False)])]
        wide = np.zeros((len(owner), 8), np.uint8)
        wide[:, 3:] = np.concatenate([p[3] for p in parts]).reshape(-1, 5)
        token = wide.view("<u8").ravel()
        del parts, wide
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        same = token[1:] == token[:-1]
        shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        token, owner = token[shared], owner[shared]
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        if len(token):
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])])
            token, owner = token[new], owner[new]
        empty = np.zeros(0, np.int64)
        pairs, run_ids, members, n_small = [], empty, empty, 0
        if len(token):
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            length = np.diff(first, append=len(token))
            run = np.repeat(np.arange(len(first)), length)
            small = length[run] <= SMALL_RUN
            for gap in range(1, SMALL_RUN):
                ok = small[:-gap] & (run[:-gap] == run[gap:])
                pairs.append((owner[:-gap][ok], owner[gap:][ok]))
            n_small = sum(len(x) for x, _ in pairs)
            large = ~small
            if large.any():
                o, r = owner[large], run[large]
                # Runs with the same members are one run: its name is the sum of its members' hashes.
                name = mixed(np.bincount(r, minlength=len(first)).astype(np.uint64) + np.add.reduceat(mixed(keys.view(np.uint64))[owner], first))
                _, once = np.unique(name[r[np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))]], return_index=True)
                starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
                keep = np.isin(r, r[starts[once]])
                o, r = o[keep], r[keep]
                starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
                lengths = np.diff(starts, append=len(r))
                run_ids, members = _signed(name[r]), keys[o]
                for seed in range(LEADERS):
                    rank = mixed(keys.view(np.uint64) + np.uint64(seed * 7919 + 1))[o]
                    by = np.lexsort((rank, r))
                    lead = np.repeat(o[by[starts]], lengths)
                    pairs.append((lead, o))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (empty, empty)
        a, b = np.minimum(a, b), np.maximum(a, b)
        ok = (a != b) & (100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b]))
        both, once = np.unique(a[ok] * len(keys) + b[ok], return_index=True)  # the first of equal pairs: one of a small run, if any
        small = (np.flatnonzero(ok) < n_small)[once]
        a, b = keys[both // max(1, len(keys))], keys[both % max(1, len(keys))]
        none = pa.nulls(len(a), pa.int64())
        return pa.table(
            {"run": pa.chunked_array([none, pa.array(run_ids, pa.int64())]), "a": pa.chunked_array([pa.array(a, pa.int64()), pa.array(members, pa.int64())]), "b": pa.chunked_array([pa.array(b, pa.int64()), pa.nulls(len(members), pa.int64())]), "small": pa.chunked_array([pa.array(small, pa.bool_()), pa.array(np.zeros(len(members), bool))])}
        )

    return run


def _may_link(x: str, y: str, percent: int) -> Column:
    """Size and bitmap filters between aliases ``x`` and ``y``: necessary for a link."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = sum(F.bit_count(F.get(f"{x}.bits", F.lit(i)).bitwiseXOR(F.get(f"{y}.bits", F.lit(i)))) for i in range(BITS // 64))
    # inter / union >= p  <=>  (100 + p) * differing <= (100 - p) * (n + m)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * differ <= (100 - percent) * (n + m))


def _verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs of classes ``a, b`` whose whole texts link."""
    nodes = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(classes.select("node", "doc_id", "text_hash"), "node"), "nodes")
    side = F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    texts = rows.join(side, rows["doc_id"].eqNullSafe(side["doc_id"]) & (rows["text_hash"] == side["text_hash"])).select("node", "text")
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = dict(zip(part.column(0).to_pylist(), text_bytes(part.column(2)), strict=True)) | dict(zip(part.column(1).to_pylist(), text_bytes(part.column(3)), strict=True))
                sets = dict(zip(texts, shingle_sets(list(texts.values())), strict=True))  # a node of several pairs is hashed once
                x, y = ([sets[node] for node in part.column(k).to_pylist()] for k in (0, 1))
                common = [len(np.intersect1d(s, t, assume_unique=True)) for s, t in zip(x, y, strict=True)]
                yield part.select(["a", "b"]).filter(pa.array([100 * c >= percent * (len(s) + len(t) - c) for c, s, t in zip(common, x, y, strict=True)]))

    return both.mapInArrow(run, "a long, b long").distinct()


def _of_several(member: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """``member`` (``run, node, comp``, ...) of the runs that hold several components, with ``size``, the run's; ``sets`` adds ``n, bits, wide``."""
    several = member.groupBy("run").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    several = materialize(several.select("run", "size"), "mixed")
    few = F.broadcast(several) if several.count() <= BROADCAST_NODES else several
    out = member.join(few, "run")
    out = materialize(out if sets is None else out.join(sets, "node"), "members")
    discard(several)
    return out


def _wide_near(a: np.ndarray, b: np.ndarray, n: np.ndarray, wide: list[bytes | None], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs may link by their wide bitmaps (all of those without), and in how many bits these differ (else -1)."""
    length = np.array([len(w) if w else 0 for w in wide])
    size = np.minimum(length[a], length[b])
    differ = np.full(len(a), -1)
    for one in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == one)
        used, index = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
        rows = np.stack([folded(np.frombuffer(wide[k], np.uint64), one // 8) for k in used.tolist()])
        for lo in range(0, len(at), step := max(1, (8 << 20) // one)):
            x, y = index[lo : lo + step][: len(at) - lo], index[len(at) + lo : len(at) + lo + step]
            differ[at[lo : lo + step]] = np.bitwise_count(rows[x] ^ rows[y]).sum(1, dtype=np.int64)
    return (100 + percent) * differ <= (100 - percent) * (n[a] + n[b]), differ


def _near(comp: np.ndarray, n: np.ndarray, block: np.ndarray, bits: np.ndarray, wide: list[bytes | None], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the pairs across components that may link, and how far apart their bitmaps are for their sizes.

    With members of two blocks, pairs across the blocks only.  Members are met in the order of their sizes, each strip
    with those that are not too large for it.
    """
    order = np.argsort(n, kind="stable")
    comp, n, block, bits, wide = comp[order], n[order], block[order], bits[order], [wide[k] for k in order.tolist()]
    flat = np.unpackbits(bits.view(np.uint8), axis=1).astype(np.float32)
    ones, two, out = flat.sum(axis=1), block.min() < block.max(), []
    for at in range(0, len(n), STRIP):
        end = min(at + STRIP, len(n))
        rows, cols = slice(at, end), slice(at, np.searchsorted(n, 100 * n[end - 1] // percent, "right"))
        differ = ones[rows, None] + ones[cols] - 2 * (flat[rows] @ flat[cols].T)  # whole numbers below 2**24: exact
        x, y = n[rows, None], n[None, cols]
        ok = (comp[rows, None] != comp[cols]) & (100 * x >= percent * y) & (differ <= np.minimum((100 - percent) * (x + y) // (100 + percent), BITS).astype(np.float32))
        if two:
            ok &= block[rows, None] != block[cols]
        a, b = np.nonzero(np.triu(ok, 1))
        bits_apart = differ[a, b]
        a, b = a + at, b + at
        ok, wide_apart = _wide_near(a, b, n, wide, percent)
        far = np.where(wide_apart < 0, bits_apart, wide_apart) / (n[a] + n[b])
        out.append((order[a[ok]].astype(np.int32), order[b[ok]].astype(np.int32), far[ok].astype(np.float32)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _meet(percent: int, worth: int, nearest: int):
    def run(table: pa.Table) -> pa.Table:
        name, i, j, block, node, comp, n = (table[c].to_numpy() for c in ("run", "i", "j", "block", "node", "comp", "n"))
        bits = table["bits"].combine_chunks().flatten().to_numpy().reshape(-1, BITS // 64)
        wide = table["wide"].to_pylist()
        order = np.lexsort((j, i, name))
        name, i, j = name[order], i[order], j[order]
        edges = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), [True]]))
        pairs, held = [], 0
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            at = order[lo:hi]
            if i[lo] < j[lo] and block[at].min() == block[at].max():
                continue  # the other block is empty
            of = comp[at]
            a, b, far = _near(of, n[at], block[at], bits[at], [wide[k] for k in at.tolist()], percent)
            if len(a) > worth * len(at):  # too many: the nearest of each component
                both, pair = np.concatenate([of[a], of[b]]), np.tile(np.arange(len(a), dtype=np.int32), 2)
                by = np.lexsort((far[pair], both))
                both, pair = both[by], pair[by]
                first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
                rank = np.arange(len(both)) - np.repeat(first, np.diff(first, append=len(both)))
                kept = np.unique(pair[rank < nearest])
                held += len(a) - len(kept)
                a, b = a[kept], b[kept]
            x, y = node[at[a]], node[at[b]]
            pairs.append((np.minimum(x, y), np.maximum(x, y)))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (node[:0], node[:0])
        # the last row has no pair but the number of those held back
        return pa.table({"a": pa.array([*a.tolist(), None], pa.int64()), "b": pa.array([*b.tolist(), None], pa.int64()), "held": pa.array([0] * len(a) + [held], pa.int64())})

    return run


def _met(member: DataFrame, percent: int, worth: int, nearest: int) -> tuple[DataFrame, int]:
    """Pairs ``a, b`` across components that the members of one run may link, and how many more there are (some more than once)."""
    deals = F.ceil(F.col("size") / BLOCK).cast("long")
    dealt = member.withColumn("deals", deals).withColumn("block", F.pmod(F.xxhash64("node"), "deals")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)))
    dealt = dealt.select("run", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp", "n", "bits", "wide")
    rows = member.agg(F.sum(deals)).first()[0]
    tasks = max(int(member.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // MET + 1)
    found = dealt.groupBy(F.pmod(F.xxhash64("run", "i", "j"), F.lit(tasks)).alias("task")).applyInArrow(_meet(percent, worth, nearest), "a long, b long, held long")
    found = materialize(found, "met")
    return found.where("a IS NOT NULL").select("a", "b").distinct(), found.agg(F.sum("held")).first()[0]


def _contracted(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` (``node, comp``) after adding ``links``: the components that links join are renamed, nothing else is looked at."""
    of = lambda side: comp.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}"))
    met = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    met = met.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
    renamed = materialize(components(met), "renamed")
    old = comp.join(renamed.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return materialize(old.unionByName(renamed.join(comp, "node", "left_anti")), "components")


def jaccard_classes(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", listed: int = LISTED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, classes, links)``.

    ``rows``: ``doc_id, text_hash, n, node`` for every row of ``docs`` (``node`` null for empty sets);
    ``classes``: ``node, comp, component_id`` for every distinct set; ``links``: verified pairs of nodes that span the
    components.
    """
    spark = docs.sparkSession
    docs = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("text")
    ordering = Order(*frequent_shingles(texts, n_bytes, max(parts, n_bytes // 6 // (2 * RANGE) + 1), listed))
    order, any_hot = spark.sparkContext.broadcast(ordering), ordering.any_hot
    del ordering
    release()
    ranges = max(parts, n_bytes // 24 // RANGE + 1)
    profiled = materialize(profiles(docs, order, percent, ranges), "profiles")
    rows = profiled.where("range IS NULL").drop("range", "payload")
    full = rows.where("n > 0").groupBy("n", "h1", "h2").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("g").alias("g"), F.first("bits").alias("bits"), F.first("wide").alias("wide"))
    classes = materialize(full.select(F.monotonically_increasing_id().alias("node"), "n", "h1", "h2", "g", "bits", "wide", "rep.doc_id", "rep.text_hash"), "classes")
    filed = profiled.where("range IS NOT NULL").select("range", "payload")
    candidates = materialize(filed.groupBy("range").applyInArrow(_join_range(percent), "run long, a long, b long, small boolean"), "candidates")
    rows = materialize(rows.select("doc_id", "text_hash", "n", "h1", "h2"), "rows")
    discard(profiled)
    found = candidates.unionByName(materialize(hot_runs(texts, order, percent), "hot-runs")) if any_hot else candidates
    order.destroy()  # all tables that need it are written
    sets = classes.select("node", "n", "bits", "wide")
    groups = materialize(classes.groupBy("g").agg(F.min(F.struct("node", "n", "bits")).alias("lead"), F.count("*").alias("size")), "groups")
    of = lambda side, as_: groups.select(F.col("g").alias(side), F.col("lead").alias(as_))
    pairs = found.where("run IS NULL").select("a", "b").distinct().join(of("a", "x"), "a").join(of("b", "y"), "b").where(_may_link("x", "y", percent))
    several = groups.where("size > 1")
    inside = classes.select("g", F.struct("node", "n", "bits").alias("y")).join(several.select("g", F.col("lead").alias("x")), "g").where("x.node <> y.node").where(_may_link("x", "y", percent))
    pairs = materialize(pairs.select("x.node", "y.node").union(inside.select("x.node", "y.node")).toDF("a", "b"), "pairs")
    links = materialize(_verify(pairs, docs, classes, percent), "links")
    discard(pairs)
    comp = materialize(components(links), "components")
    # Runs, groups of several classes and pairs of small runs with such a group: what they hold of several components meets.
    runs = found.where("run IS NOT NULL").select("run", F.col("a").alias("g")).unionByName(several.select(F.col("g").alias("run"), "g"))
    if n_several := several.count():
        few = lambda side: (F.broadcast if n_several <= BROADCAST_NODES else lambda x: x)(several.select(F.col("g").alias(side), F.lit(True).alias(f"in_{side}")))
        small = found.where("small").select("a", "b").distinct().join(few("a"), "a", "left").join(few("b"), "b", "left").where("in_a OR in_b")
        runs = runs.unionByName(small.select(F.xxhash64("a", "b").alias("run"), F.explode(F.array("a", "b")).alias("g")))
    runs = materialize(runs.distinct(), "runs")
    named = classes.select("node", "g").join(comp, "node", "left").select("node", "g", F.coalesce("comp", "node").alias("comp"))
    all_members = materialize(runs.join(named, "g").select("run", "node", "comp"), "run-members")
    member = _of_several(all_members, sets)
    discard(all_members)
    worth, nearest, turn = WORTH, NEAREST, 0
    while not member.isEmpty():
        near, held = _met(member, percent, worth, nearest)
        more = materialize(_verify(near, docs, classes, percent), "links")
        none = more.isEmpty()
        if not none:
            comp = _contracted(comp, more)
            links = links.unionByName(more)
        if not held:
            break  # all pairs across components were verified
        turn += 1
        if none or turn >= ROUNDS:
            worth, nearest = WIDER * max(1, worth), WIDER * nearest
        if not none:
            again = member.drop("size", "comp").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            again = _of_several(materialize(again, "run-members"))
            discard(member)
            member = again
    named = classes.select("node", "n", "h1", "h2", "doc_id").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = materialize(named.drop("doc_id").join(least, "comp"), "named")
    discard(classes, candidates, groups, comp, member, runs)
    rows = rows.select("doc_id", "text_hash", "n", "h1", "h2").join(named.select("n", "h1", "h2", "node", "comp", "component_id"), ["n", "h1", "h2"], "left")
    return rows, named, links


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, _ = jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of linked documents, the one with the smallest id; documents without words stay."""
    rows, _, _ = jaccard_classes(docs)
    linked = rows.where("n > 0").groupBy("comp").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select(F.col("k.doc_id").alias("k"), F.col("k.text_hash").alias("h"))
    counts = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies"))
    keep = materialize(linked.join(counts, linked["k"].eqNullSafe(counts["doc_id"]) & (linked["h"] == counts["text_hash"])).select("k", "h", "copies"), "keep")

    def matching(side: DataFrame) -> DataFrame:
        return docs.join(side, docs["doc_id"].eqNullSafe(side["k"]) & (F.xxhash64(docs["text"]) == side["h"]), "left_semi")

    out = matching(keep.where("copies = 1"))
    again = keep.where("copies > 1")
    if not again.isEmpty():  # the same row more than once
        out = out.unionByName(matching(again).dropDuplicates(["doc_id", "text"]))
    return out.unionByName(docs.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))))
