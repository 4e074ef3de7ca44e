"""Quality rules: repetition and length rules, and n-gram perplexity bands by language.

The language model is a modified Kneser-Ney model of character 5-grams, one for each language.  A document
is read as one stream, its words joined by single spaces, with four start marks before it and an end mark behind,
so n-grams run across word boundaries: how words end, what stands between them and how the next begins all count.
Spark counts the n-grams of all whole documents, derives the continuation counts, discounts and interpolation
weights of every order as aggregations and joins, and gives each 5-gram that occurs its log probability.  The model
is held as sorted hash arrays: per language, ascending 64-bit hashes beside log probabilities, with the
place where each value of the leading bits begins.

Scoring leaves each occurrence out of the counts that judge it.  While the model's rows stay within
``BROADCAST_GRAMS`` (12 bytes each) the arrays are broadcast; beyond that, documents are dealt into blocks of bounded
size, and a join brings each block the part of the model that its streams use.  Both ways give the same figures.

Bands: a document's figure is its mean negative log probability per character (the log of its perplexity).  A short
document's figure scatters more, so its distance from the language's median is divided by ``sqrt(1 + STEADY / characters)``.
Per language, the median and the median of those distances come from histograms over all documents; a
document more than ``low`` such deviations below the median or ``high`` above it is rejected.

Memory: a task holds ``PIECE`` n-grams at once, at most ``FLUSH_GRAMS`` counted ones, and its model (12 bytes a row, or
what ``BLOCK_BYTES`` of text use of it).

Defined results: null text has no words (all counts 0, ``base_failed``); a null language is a language of
its own, shared with the empty string; documents without words have no perplexity; repeated rows and ids
keep their rows, each with its own verdict; extra columns, whatever their names, are ignored by the query and kept by the
stage; an empty table gives an empty one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kinelake.llm._common import bounded_batches, discard, discard_since, materialize, n_written, release, text_bytes
from kinelake.llm._hashing import mixed, window_hashes, word_hashes

ORDER = 5
START, END = "\x02", "\x03"
MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
#: Band widths in deviations below and above the median, and the least deviation, in nats per character.
LOW, HIGH, LEAST = 3.0, 3.0, 0.005
#: Characters at which a document's own draw adds as much variance as documents differ by.
STEADY = 2400
BIN = 0.001
BROADCAST_GRAMS = 2_000_000
#: Languages up to which their figures are broadcast (about 200 bytes each).
BROADCAST_LANGUAGES = 10_000
#: N-grams handled at once, and distinct ones counted by a task before they are emitted (about 50 bytes each).
PIECE = 1 << 19
FLUSH_GRAMS = 500_000
BLOCK_BYTES = 16 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words covered by ``size``-word windows whose sequence stands in ``words`` twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number = dict(zip(dict.fromkeys(words), range(len(words)), strict=False))
    if len(number) == len(words):
        return 0
    ids = np.fromiter(map(number.__getitem__, words), np.uint64, len(words))
    h = ids[:n].copy()
    for k in range(1, size):
        h = h * MULTIPLIER + ids[k : k + n]
    ascending = np.sort(h)
    if not (ascending[1:] == ascending[:-1]).any():
        return 0
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twin = np.zeros(n, bool)
    twin[order[1:][same]] = twin[order[:-1][same]] = True
    at: dict[bytes, list[int]] = defaultdict(list)
    for i in np.flatnonzero(twin).tolist():  # equal hashes are held against the words themselves
        at[ids[i : i + size].tobytes()].append(i)
    mark = np.zeros(len(words) + 1, np.int64)
    for places in at.values():
        if len(places) > 1:
            p = np.array(places)
            np.add.at(mark, p, 1)
            np.add.at(mark, p + size, -1)
    return int((np.cumsum(mark[:-1]) > 0).sum())


def base_figures(raw: bytes, n_words: int, repeated: int) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text."""
    blank = len(raw) - len(raw.translate(None, SPACES))
    chars = len(raw) if raw.isascii() else len(raw.decode("utf-8", "replace"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACES):
            seen.add(line)
    return n_words, chars - blank, symbols, dup, repeated


def all_base_figures(raws: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    """:func:`base_figures` of each text; only texts in which a window's hash comes twice are looked through for repeats."""
    words, counts = word_hashes(raws)
    h = window_hashes(words, WINDOW)
    row = np.repeat(np.arange(len(raws)), counts)
    inside = np.flatnonzero(row[: len(h)] == row[WINDOW - 1 :]) if len(h) else np.zeros(0, np.int64)
    of = row[inside]
    key = h[inside] ^ mixed(of.astype(np.uint64))
    order = np.argsort(key)
    key, of = key[order], of[order]
    suspect = set(of[1:][(key[1:] == key[:-1]) & (of[1:] == of[:-1])].tolist())
    return [base_figures(raw, n, repeated_words(raw.split()) if i in suspect else 0) for i, (raw, n) in enumerate(zip(raws, counts.tolist(), strict=True))]


def stream(raw: bytes) -> str:
    """A text's words joined by single spaces."""
    return b" ".join(raw.split()).decode("utf-8", "replace")


def grams_of(raw: bytes) -> list[str]:
    """The n-grams of a text, each with its last character's whole context."""
    s = START * (ORDER - 1) + stream(raw) + END
    return [s[i : i + ORDER] for i in range(len(s) - ORDER + 1)] if len(s) > ORDER else []


def _windows(streams: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of about ``PIECE`` n-grams: code points, where the n-grams begin, and the stream each belongs to."""
    parts, owners, size = [], [], 0

    def laid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        lengths = sizes - (ORDER - 1)
        first = np.repeat(np.cumsum(sizes) - sizes - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        return np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32), first, np.repeat(np.array(owners), lengths)

    for k, s in enumerate(streams):
        if not s:
            continue
        s = START * (ORDER - 1) + s + END
        for at in range(0, len(s) - ORDER + 1, PIECE):
            parts.append(s[at : at + PIECE + ORDER - 1])
            owners.append(k)
            size += len(parts[-1])
            if size >= PIECE:
                yield laid()
                parts, owners, size = [], [], 0
    if parts:
        yield laid()


class _Counts:
    """Counts of n-grams by hash, each with its code points."""

    def __init__(self) -> None:
        self.h, self.n, self.codes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, ORDER), np.uint32)

    def add(self, h: np.ndarray, codes: np.ndarray, first: np.ndarray) -> None:
        new, at, n = np.unique(h, return_index=True, return_counts=True)
        both, at2, which = np.unique(np.concatenate([self.h, new]), return_index=True, return_inverse=True)
        self.n = np.bincount(which, np.concatenate([self.n, n])).astype(np.int64)
        self.codes = np.concatenate([self.codes, codes[first[at][:, None] + np.arange(ORDER)]])[at2]
        self.h = both

    def rows(self, lang: str) -> pa.RecordBatch:
        text = self.codes.tobytes().decode("utf-32-le")
        grams = pa.array([text[i : i + ORDER] for i in range(0, len(text), ORDER)], pa.string())
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(self.n), pa.string()), grams, pa.array(self.n)], names=["lang", "gram", "n"])


def _by_language(langs: list[str], raws: list[bytes]) -> Iterator[tuple[str, list[int], list[str]]]:
    at: dict[str, list[int]] = defaultdict(list)
    for i, lang in enumerate(langs):
        at[lang].append(i)
    for lang, where in at.items():
        yield lang, where, [stream(raws[i]) for i in where]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, _Counts] = defaultdict(_Counts)
    for batch in batches:
        for lang, _, streams in _by_language(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
            for codes, first, _ in _windows(streams):
                counts[lang].add(gram_hashes(codes, first), codes, first)
                if sum(len(c.n) for c in counts.values()) > FLUSH_GRAMS:
                    yield from (c.rows(x) for x, c in counts.items() if len(c.n))
                    counts.clear()
    yield from (c.rows(x) for x, c in counts.items() if len(c.n))
    release()


def ngram_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Rows ``lang, gram, n``: how often each 5-gram occurs in the streams of all documents."""
    rows = bounded_batches(docs).select(F.coalesce(lang_col, F.lit("")).alias("lang"), text_col).mapInArrow(_count_grams, "lang string, gram string, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(grams: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts ``d1, d2, d3`` of each language from its counts of counts."""
    n = lambda k: F.count_if(F.col("n") == k).cast("double")
    c = grams.groupBy("lang").agg(n(1).alias("n1"), n(2).alias("n2"), n(3).alias("n3"), n(4).alias("n4"))
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    d = lambda k, plain: F.least(F.greatest(F.coalesce(k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")), F.lit(plain)), F.lit(0.05)), F.lit(float(k)))
    return c.select("lang", d(1, 0.5).alias("d1"), d(2, 1.0).alias("d2"), d(3, 1.5).alias("d3"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """Rows ``lang, gram, logp, logp_out`` for every 5-gram of ``counts``: interpolated modified Kneser-Ney.

    ``logp_out`` leaves one occurrence out: what the model would say of an occurrence had it not been counted itself.
    At every order the count and its context lose one if the order above lost its last, so rare strings of a
    document don't vouch for themselves.
    """
    orders = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: how many different characters stand before
        orders[k] = materialize(orders[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), f"grams{k}")
    of_lang = orders[1].groupBy("lang").agg((1.0 / F.count("*")).alias("uniform"))
    for k in orders:
        of_lang = of_lang.join(_discounts(orders[k]).select("lang", F.array("d1", "d2", "d3").alias(f"d{k}")), "lang")
    of_lang = materialize(of_lang, "discounts")
    of_lang = F.broadcast(of_lang) if of_lang.count() <= BROADCAST_LANGUAGES else of_lang
    lower = None
    for k in range(1, ORDER + 1):
        discount = lambda c, k=k: F.when(c > 0, F.get(F.col(f"d{k}"), F.least(c, F.lit(3)).cast("int") - 1)).otherwise(0.0)
        g = orders[k].join(of_lang, "lang").withColumn("d", discount(F.col("n"))).withColumn("context", F.substring("gram", 1, k - 1))
        context = g.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("held"))
        g = g.join(context, ["lang", "context"])
        if lower is None:
            g = g.withColumn("low", F.col("uniform")).withColumn("low_out", F.col("uniform"))
        else:
            g = g.withColumn("suffix", F.substring("gram", 2, k - 1)).join(lower, ["lang", "suffix"])
        p = (F.col("n") - F.col("d") + F.col("held") * F.col("low")) / F.col("total")
        less = F.col("n") - 1
        low = F.when(less > 0, F.col("low")).otherwise(F.col("low_out"))
        out = F.when(F.col("total") == 1, low).otherwise((less - discount(less) + (F.col("held") - F.col("d") + discount(less)) * low) / F.nullif(F.col("total") - 1, F.lit(0)))
        # Written at every order: one plan of all orders is large, and the driver keeps it and each of its revisions.
        last, lower = lower, materialize(g.select("lang", F.col("gram").alias("suffix"), p.alias("low"), out.alias("low_out")), f"lower{k}")
        discard(*[x for x in (last, orders[k] if k < ORDER else None) if x is not None])
    # The least positive number stands in where nothing is left to back off to.
    return lower.select("lang", F.col("suffix").alias("gram"), F.log("low").alias("logp"), F.log(F.greatest("low_out", F.lit(1e-12))).alias("logp_out"))


def gram_hashes(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ``ORDER`` code points from each place of ``first``."""
    n = len(codes) - ORDER + 1
    h = np.zeros(n, np.uint64)
    for k in range(ORDER):
        h = (h + codes[k : k + n] + np.uint64(1)) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return h[first]


def hashed(model: DataFrame) -> DataFrame:
    """Rows ``lang, h, logp`` for ``lang, gram, logp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer("".join(batch.column(1).to_pylist()).encode("utf-32-le"), np.uint32)
            h = gram_hashes(codes, np.arange(0, len(codes), ORDER)) if len(codes) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h.view(np.int64)), pc.cast(batch.column(2), pa.float32())], names=["lang", "h", "logp"])

    return model.mapInArrow(run, "lang string, h long, logp float")


class SortedHashes:
    """Log probabilities by ascending hash; ``starts`` tells where each value of the leading bits begins."""

    def __init__(self, h: np.ndarray, logp: np.ndarray):
        order = np.argsort(h)
        self.h = np.append(h[order], np.uint64(2**64 - 1))
        self.logp = np.append(logp[order], logp.min() if len(h) else np.float32(-np.log(1 << 21))).astype(np.float32)
        bits = min(24, max(1, len(h).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.h[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Log probabilities; an n-gram that isn't there (another corpus) gets the least one."""
        at = self.starts[(h >> self.shift).astype(np.int64)]
        ahead = np.flatnonzero(self.h[at] < h)
        while len(ahead):
            at[ahead] += 1
            ahead = ahead[self.h[at[ahead]] < h[ahead]]
        return self.logp[np.where(self.h[at] == h, at, len(self.h) - 1)]


Model = dict[str, SortedHashes]
NOTHING = SortedHashes(np.zeros(0, np.uint64), np.zeros(0, np.float32))


def sorted_arrays(table: pa.Table) -> Model:
    """The model of each language of a table ``lang, h, logp``."""
    table = table.select(["lang", "h", "logp"]).combine_chunks()
    out = {}
    for lang in pc.unique(table["lang"]).to_pylist():
        part = table.filter(pc.equal(table["lang"], lang))
        out[lang] = SortedHashes(part["h"].to_numpy().view(np.uint64), part["logp"].to_numpy())
    return out


def mean_nll(model: SortedHashes, streams: list[str]) -> list[float | None]:
    """Mean negative log probability per character, the end included; None for empty streams."""
    sums = np.zeros(len(streams))
    for codes, first, owner in _windows(streams):
        begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        sums[owner[begins]] -= np.add.reduceat(model.find(gram_hashes(codes, first)).astype(np.float64), begins)
    return [x / (len(s) + 1) if s else None for x, s in zip(sums.tolist(), streams, strict=True)]


SCORED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, nll double"


def _score(model: Model, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Figures beside the rows of ``batch`` (row, lang, and text where the row doesn't hold it), some hundred at a time."""
    for at in range(0, batch.num_rows, 400):
        part = batch.slice(at, 400)
        langs = part.column(1).to_pylist()
        raws = text_bytes(part.column(2) if part.num_columns > 2 else pc.struct_field(part.column(0), "text"))
        nll: list[float | None] = [None] * len(raws)
        for lang, where, streams in _by_language(langs, raws):
            for i, x in zip(where, mean_nll(model.get(lang, NOTHING), streams), strict=True):
                nll[i] = x
        figures = [pa.array(c, pa.int64()) for c in zip(*all_base_figures(raws), strict=True)]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *figures, pa.array(nll, pa.float64())], names=["row", "lang", *[x.split()[0] for x in SCORED.split(", ")]])


def score(docs: DataFrame, model: DataFrame, broadcast_grams: int = BROADCAST_GRAMS, out: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Rows ``row, lang``, the base figures and ``nll`` for every row of ``docs`` (``text``, ``lang``), written to the shared folder.

    ``row`` holds the columns ``keep``.  ``out`` leaves one occurrence out, as is right for documents that the
    model has counted.
    """
    spark = docs.sparkSession
    keep = ["doc_id"] if keep is None else keep
    model = materialize(hashed(model.select("lang", "gram", F.col("logp_out" if out else "logp").alias("logp"))), "model")
    rows = bounded_batches(docs).select(F.struct(*keep).alias("row"), F.coalesce("lang", F.lit("")).alias("lang"), *([] if "text" in keep else ["text"]))
    shape = T.StructType([rows.schema["row"], *T.StructType.fromDDL("lang string, " + SCORED)])
    if model.count() <= broadcast_grams:
        arrays = spark.sparkContext.broadcast(sorted_arrays(model.toArrow()))
        release()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _score(arrays.value, batch)
            release()

        scored = materialize(rows.mapInArrow(run, shape), "scored")
        arrays.destroy()  # its table is written
        discard(model)
        return scored
    text = F.col("text" if "text" in rows.columns else "row.text")
    n_bytes = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    # Written once: a row's block must not change between the two uses; copies of a text are dealt out like other rows.
    rows = materialize(rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_bytes // BLOCK_BYTES + 1))), "blocks")

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, where, streams in _by_language(list(zip(*[c.to_pylist() for c in batch.columns[:2]], strict=True)), text_bytes(batch.column(2))):
                for codes, first, _ in _windows(streams):
                    h = np.unique(gram_hashes(codes, first))
                    yield pa.RecordBatch.from_arrays([pa.array([lang[0]] * len(h), pa.int64()), pa.array([lang[1]] * len(h), pa.string()), pa.array(h.view(np.int64))], names=["block", "lang", "h"])

    parts = rows.select("block", "lang", text.alias("text")).mapInArrow(needed, "block long, lang string, h long").distinct().join(model, ["lang", "h"])

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [c for c in ("row", "lang", "text") if c in left.column_names]
        own = sorted_arrays(right)
        return pa.Table.from_batches([b for batch in left.select(names).combine_chunks().to_batches() for b in _score(own, batch)])

    scored = materialize(rows.groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(together, shape), "scored")
    discard(rows, model)
    return scored


def _scale(n_chars: Column) -> Column:
    return F.sqrt(1 + F.lit(float(STEADY)) / F.greatest(n_chars, F.lit(1)))


def bands(scored: DataFrame) -> DataFrame:
    """Rows ``lang, middle, deviation`` of ``nll`` for each language, from histograms over all documents."""

    def median(df: DataFrame, value: Column, name: str) -> DataFrame:
        h = df.where("nll IS NOT NULL").groupBy("lang", F.floor(value / BIN).alias("bin")).agg(F.count("*").alias("c"))
        w = Window.partitionBy("lang")  # a language's bins, not its documents
        h = h.withColumn("upto", F.sum("c").over(w.orderBy("bin"))).withColumn("all", F.sum("c").over(w))
        return h.where("2 * upto >= all").groupBy("lang").agg(((F.min("bin") + 0.5) * BIN).alias(name))

    middle = materialize(median(scored, F.col("nll"), "middle"), "bands")
    far = F.abs(F.col("nll") - F.col("middle")) / _scale(F.col("word_chars") + F.col("n_words"))
    spread = median(scored.join(middle, "lang"), far, "spread")
    return middle.join(spread, "lang").select("lang", "middle", F.greatest(F.col("spread") * 1.4826, F.lit(LEAST)).alias("deviation"))


def quality_verdicts(docs: DataFrame, broadcast_grams: int = BROADCAST_GRAMS, low: float = LOW, high: float = HIGH, keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``row`` (its columns ``keep``), figures, ``base_failed``, ``kept``, ``perplexity`` and its band."""
    mark = n_written()
    model = kneser_ney(materialize(ngram_counts(docs), "grams"))
    scored = score(docs, model, broadcast_grams, keep=keep)
    limits = materialize(bands(scored), "limits")
    discard_since(mark, scored, limits)
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_LANGUAGES else limits
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    wide = F.col("deviation") * _scale(F.col("word_chars") + F.col("n_words"))
    lower, upper = F.col("middle") - low * wide, F.col("middle") + high * wide
    inside = F.coalesce(F.col("nll").between(lower, upper), F.lit(False))
    return scored.join(limits, "lang", "left").select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & inside).alias("kept"), F.round(F.exp("nll"), 6).alias("perplexity"), "nll", lower.alias("lower"), upper.alias("upper"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("row.doc_id", *[c for c in rows.columns if c not in ("row", "nll", "lower", "upper")])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, unchanged.

    Rows travel with their figures, so each row gets its own verdict and no join by id is needed.
    """
    return quality_verdicts(docs, keep=docs.columns).where("kept").select("row.*")
