"""Token counts by heap-and-linked-list byte-pair merging.

For each stretch of text a heap holds the adjacent pairs, a linked list holds the symbols, and the
lowest-rank pair is popped again and again.  No identifier is ever made: the count is the number of
initial symbols (a character outside the vocabulary counts its UTF-8 bytes) minus the merges.

A pair of neighbouring characters that stands inside no vocabulary piece can never be merged across,
so texts are cut there first; equal stretches are counted once per worker through a two-generation
cache of bounded size.  Nothing is truncated, whatever the length.

Memory: an Arrow batch (4 MB, or one longer text) and a cache of ``CACHE`` short stretches for each worker.

Defined results: null text counts as empty (0 bytes, 0 tokens); the empty text has 0 tokens; repeated
rows and equal ids each keep their own row; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kinelake.llm._common import bounded_batches, text_bytes

SPACE = "▁"
LIMIT = 4096
CACHE = 400_000
LONGEST_CACHED = 64


class PieceCounter:
    """Counts the tokens of a sentencepiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, model_path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = pb.ModelProto.SentencePiece.Type
        normal = [p for p in model.pieces if p.type in (kinds.Value("NORMAL"), kinds.Value("USER_DEFINED"))]
        norm = model.normalizer_spec
        if norm.name != "identity" or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or any(p.type == kinds.Value("USER_DEFINED") for p in model.pieces):
            raise ValueError("only identity-normalised models with a dummy prefix and no user symbols are supported")
        order = {s: i for i, s in enumerate(sorted({-p.score for p in normal}))}
        self.rank = {p.piece: order[-p.score] for p in normal}
        self.single = {p.piece for p in normal if len(p.piece) == 1}
        self.inside = {p.piece[i : i + 2] for p in normal for i in range(len(p.piece) - 1)}
        #: Word-like stretches: spaces, then what is neither space nor line break.  Only used where no piece crosses them.
        crossing = any(b[1] == SPACE and b[0] != SPACE for b in self.inside) or any("\n" in b for b in self.inside)
        self.stretch = re.compile(f".+" if crossing else f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n", re.S)
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def merged(self, text: str) -> int:
        """Tokens of ``text``: initial symbols minus merges."""
        rank = self.rank.get
        symbols = list(text)
        n = len(symbols)
        count = n if self.single.issuperset(symbols) else sum(1 if c in self.single else len(c.encode()) for c in symbols)
        heap = [(r << 32) | i for i in range(n - 1) if (r := rank(text[i : i + 2])) is not None]
        if not heap:
            return count
        heapify(heap)
        right = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            a = symbols[i]
            if a is None or (j := right[i]) == n:
                continue
            both = a + symbols[j]
            if rank(both) != top >> 32:
                continue  # one of the two has grown since this pair was pushed
            count -= 1
            symbols[i], symbols[j] = both, None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := rank(both + symbols[k])) is not None:
                    heappush(heap, (r << 32) | i)
            if (h := left[i]) >= 0 and (r := rank(symbols[h] + both)) is not None:
                heappush(heap, (r << 32) | h)
        return count

    def __missing(self, stretch: str) -> int:
        """Cut at pairs inside no piece, then merge each part."""
        if (n := self.old.get(stretch)) is None:
            inside, start, n = self.inside, 0, 0
            for i in range(1, len(stretch) + 1):
                if i == len(stretch) or stretch[i - 1 : i + 1] not in inside:
                    n += self.part(stretch[start:i])
                    start = i
        return self.keep(stretch, n)

    def part(self, text: str) -> int:
        if len(text) == 1:
            return 1 if text in self.single else len(text.encode())
        if (n := self.new.get(text)) is None and (n := self.old.get(text)) is None:
            n = self.merged(text)
        return self.keep(text, n)

    def keep(self, text: str, n: int) -> int:
        if len(text) <= LONGEST_CACHED:
            if len(self.new) >= CACHE:
                self.old, self.new = self.new, {}
            self.new[text] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        total = 0
        for stretch in self.stretch.findall(SPACE + text.replace(" ", SPACE)):
            n = self.new.get(stretch)
            total += self.__missing(stretch) if n is None else n
        return total


@lru_cache(maxsize=2)
def counter(model_path: str) -> PieceCounter:
    return PieceCounter(model_path)


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_path)
        for batch in batches:
            texts = text_bytes(batch.column(1))
            tokens = [c.count(t.decode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return bounded_batches(docs).select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
