"""BPE encoding and decoding through a pair occurrence index.

The distinct words of a stretch of a partition lie side by side in one symbol array.  An index maps
every rank that occurs as an adjacent pair to all positions of that pair; the active ranks are applied
in ascending order, each to all its positions at once, and only the lists of the pairs that appear left
and right of a merge are touched.  That equals merging word by word because every merge's parts are made
by earlier merges (checked when the vocabulary is loaded).

Normalisation follows the vocabulary file: special strings are split off first, then composed form,
white space to one space, lower case per character, and the letter/number/other split.  Texts with
characters from U+0250 on go through the tokenizer library's own normaliser and splitter, because
Unicode tables differ between versions; below that a compiled pattern gives the same pieces.

Memory: an index covers the words that an Arrow batch of at most 4 MB (or one longer text, ``STRETCH`` characters at a time) brings
anew; what a partition has encoded before is in a cache of ``CACHE`` words, so each distinct word of a partition goes through an index
once while it stays there.  One index over a whole partition would give the same ids and grow with the partition.

Defined results: null text is empty (no ids, empty decoded text); repeated rows and equal ids each keep
their row; extra columns are ignored; an empty table gives an empty one.  Texts are never truncated.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm._common import bounded_batches, text_bytes

CACHE = 200_000
LONGEST_CACHED = 64
#: Characters handled together; bounds the memory of one index.
STRETCH = 1_000_000
EDGE = 0xFFFF


def _byte_letters() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b] = chr(256 + extra)
            extra += 1
    return letters


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab = vocab = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        if size > EDGE:
            raise ValueError("symbols must fit in 16 bits")
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        letters = _byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + suffix] for c in letters]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        made_at: dict[int, int] = {}
        for r, (a, b) in enumerate(model["merges"]):
            x, y = vocab[a], vocab[b]
            new = vocab[a + b]
            if made_at.get(x, -1) >= r or made_at.get(y, -1) >= r or new in made_at:
                raise ValueError("a merge uses what only a later merge makes")
            made_at[new] = r
            self.rank[(x << 16) | y] = r
            self.made.append(new)
        self.splits = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.library = Tokenizer.from_file(path)
        self.high = re.compile("[^\x00-ɏ]")
        self.pieces = _low_pattern()
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """The pre-token pieces of a text, special strings among them as they are."""
        if not text:
            return []
        if "<|" in text:
            return [p for part in self.splits.split(text) for p in ([part] if part in self.special else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if self.high.search(text):
            back = {c: b for b, c in enumerate(_byte_letters())}
            normal = self.library.normalizer.normalize_str(text)
            return [bytes(back[c] for c in p).decode("utf-8", "replace") for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)] if normal else []
        return self.pieces.findall(text.lower())

    def learn(self, words: Iterable[str]) -> None:
        """Encode words that aren't known yet, all through one pair occurrence index."""
        todo = []
        for w in words:
            if (known := self.old.get(w)) is not None:
                self.new[w] = known
            elif w in self.special:
                self.new[w] = np.array([self.special[w]], "<u4").tobytes()
            else:
                todo.append(w)
        for w, ids in zip(todo, self.encode_words(todo), strict=True):
            self.new[w] = ids

    def encode_words(self, words: list[str]) -> list[bytes]:
        inner, last, rank, made = self.inner, self.last, self.rank, self.made
        sym, starts = [EDGE], []
        for w in words:
            raw = w.encode("utf-8", "replace")
            starts.append(len(sym))
            sym += [inner[b] for b in raw[:-1]]
            sym.append(last[raw[-1]])
            sym.append(EDGE)
        starts.append(len(sym))
        n = len(sym)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        known = rank.get
        before = EDGE
        for i, s in enumerate(sym):
            if (r := known((before << 16) | s)) is not None:
                if r in index:
                    index[r].append(i - 1)
                else:
                    index[r] = [i - 1]
            before = s
        active = list(index)
        heapify(active)
        pair_of = self._pairs()
        while active:
            r = heappop(active)
            places = index.pop(r)
            places.sort()
            pair, new = pair_of[r], made[r]
            a, b = pair >> 16, pair & 0xFFFF
            for i in places:
                if sym[i] != a or sym[j := right[i]] != b:
                    continue  # a neighbour has been merged meanwhile
                sym[i], sym[j] = new, -1
                right[i] = k = right[j]
                left[k] = i
                h = left[i]
                if (q := known((sym[h] << 16) | new)) is not None:
                    if q in index:
                        index[q].append(h)
                    else:
                        index[q] = [h]
                        heappush(active, q)
                if (q := known((new << 16) | sym[k])) is not None:
                    if q in index:
                        index[q].append(i)
                    else:
                        index[q] = [i]
                        heappush(active, q)
        arr = np.array(sym, np.int64)
        alive = arr >= 0
        ends = np.concatenate([[0], np.cumsum(alive)])
        flat = arr[alive].astype("<u4").tobytes()
        at = ends[starts].tolist()
        return [flat[4 * at[i] : 4 * (at[i + 1] - 1)] for i in range(len(words))]

    def _pairs(self) -> list[int]:
        if not hasattr(self, "_by_rank"):
            self._by_rank = list(self.rank)
        return self._by_rank

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        out: list[bytes] = []
        start, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= STRETCH or i == len(texts) - 1:
                split = [self.split(t) for t in texts[start : i + 1]]
                if len(self.new) >= CACHE:  # before these texts' words are looked up, never between
                    self.old, self.new = self.new, {}
                if unknown := set().union(*split) - self.new.keys():
                    self.learn(unknown)
                get = self.new.__getitem__
                out += [b"".join(map(get, s)) for s in split]
                start, size = i + 1, 0
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; this vocabulary has no decoder, so tokens are joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _low_pattern() -> re.Pattern:
    """The split of the vocabulary's pattern, for lower-cased characters below U+0250 and what lower case makes of them."""
    import regex

    chars = sorted({c for i in range(0x250) for c in chr(i).lower()})
    pick = lambda p: "".join(re.escape(c) for c in chars if regex.match(p, c))
    letter, number = pick(r"\p{L}"), pick(r"\p{N}")
    space = "\t\n\x0b\x0c\r \x85\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{letter}{number}{space}]+")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBpe:
    return WordBpe(path)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, ids array<int>``: the token ids of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for ids, part in _encoded(v, batch):
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                ends = np.cumsum([0, *[len(x) // 4 for x in ids]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part, pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "ids"])

    return bounded_batches(docs).select(id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """Rows ``doc_id, text``: what the ids of :func:`bpe_encode` decode to; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            texts = [v.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def _encoded(v: WordBpe, batch: pa.RecordBatch, rows: int = 500) -> Iterator[tuple[list[bytes], pa.Array]]:
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield v.encode([t.decode("utf-8", "replace") for t in text_bytes(part.column(1))]), part.column(0)


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass; digests of the ids and of the decoded text per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for ids, part in _encoded(v, batch):
                yield pa.RecordBatch.from_arrays(
                    [
                        part,
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(v.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return bounded_batches(docs).select(id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document with its token ids and their number."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = bpe_encode(docs, path)
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))
