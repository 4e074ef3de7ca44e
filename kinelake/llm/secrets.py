"""Secret scans: fixed patterns, plus a password guess-cost dynamic programme over credential contexts.

Base patterns give ``assign``, ``access`` and ``hex`` spans.  The method looks at wider credential
contexts (``pwd``, ``passphrase``, ``bearer`` ...) and rates each value by the least number of guesses,
as log10, over all segmentations into dictionary words, dates, repeats, keyboard walks, character
sequences and brute-force spans.  The words are a ranked list: ``COMMON`` first, then the words of the documents
themselves, counted by Spark over all of them (a document's credential values don't count, so none vouches for
itself); words of fewer than ``FLOOR`` documents are no words, and if more than ``LISTED`` are left, the floor rises
until they fit the broadcast.  Values at or above ``threshold`` that base spans don't cover
wholly become ``guess`` spans, beside the base spans that touch them.  A value's cost is found by one left-to-right programme over its characters, so its time
grows with its length only.  Base spans are never removed.

Memory: a task holds an Arrow batch (4 MB, or one longer text), ``FLUSH_WORDS`` words while it counts, and the ranked list (at most ``LISTED``
words, also held by the driver).

Defined results: null text is empty; a document without findings has zero counts, the digest of the empty
string and empty ``spans``; repeated rows and ids keep their own rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm._common import bounded_batches, discard, materialize, release, text_bytes

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Wider contexts: a credential word, an assignment, a value without white space or quotes.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|auth(?:orization)?|bearer|credentials?|api[_-]?key|(?:access|private|signing|encryption)[_-]?key|client[_-]?secret)"""
    r"""["']?\x20*(?::=|=>|[:=])\x20*(?:(?:basic|bearer)\x20+)?["'`]?([^\s"'`<>,;]{8,})""",
    re.I | re.A,
)
HINTS = ("pass", "pwd", "secret", "token", "auth", "bearer", "credential", "key")
#: log10 of the guesses from which a value counts as a secret.
THRESHOLD = 10.0
#: Words a guesser tries first, most likely first.
COMMON = (
    "password passwd pass secret token admin login welcome letmein qwerty monkey dragon master hello freedom whatever "
    "shadow sunshine princess football baseball superman batman trustno iloveyou starwars computer internet server "
    "database root user guest test testing demo example sample default change changeme please none null undefined "
    "required optional placeholder your here value string enter insert secure private public access key api client "
    "summer winter spring autumn january february march april june july august september october november december "
    "monday tuesday wednesday thursday friday saturday sunday love money house green black white orange purple silver "
    "golden apple banana cookie flower summer tiger lion eagle horse happy lucky magic power strong super ninja "
    "the and for not with this that from have will open close new old my is it in on to of a"
).split()
RANK = {w: i + 1 for i, w in reversed(list(enumerate(COMMON)))}
#: Documents that a word of the list needs, the most words in it (about 150 bytes each), and words counted by a task before they are emitted.
FLOOR = 5
LISTED = 200_000
FLUSH_WORDS = 100_000
WORD = re.compile(r"(?<!\w)[^\W\d_]{3,}(?!\w)")
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
NEAR = {a + b for row in ROWS for x, y in zip(row, row[1:], strict=False) for a, b in ((x, y), (y, x))} | {
    a + b for up, low in zip(ROWS, ROWS[1:], strict=False) for x, y in zip(up[1:] if up is ROWS[0] else up, low, strict=False) for a, b in ((x, y), (y, x))
}
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
LEET = str.maketrans("@4301$57!", "aaeolss" + "ti")


class Words:
    """Words by rank; ``sizes`` are the lengths that occur."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks
        self.sizes = sorted({len(w) for w in ranks if len(w) > 1})


BASIC = Words(RANK)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def emit() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for raw in text_bytes(batch.column(0)):
            text = raw.decode("utf-8", "replace")
            if (":" in text or "=" in text) and any(h in text.lower() for h in HINTS):
                text = CONTEXT.sub(" ", text)
            counts.update(set(WORD.findall(text.lower())))
            if len(counts) > FLUSH_WORDS:
                yield emit()
    yield emit()
    release()


def ranked_words(docs: DataFrame, text_col: str = "text", listed: int = LISTED) -> Words:
    """``COMMON``, then the words of ``docs`` by the number of documents that hold them."""
    found = bounded_batches(docs).select(text_col).mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = materialize(found.where(F.col("n") >= FLOOR), "words")
    step = F.floor(F.log2("n") * 8)
    least, have = None, 0
    for s, n in found.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # at most a few hundred rows
        if have + n > listed:
            break
        least, have = s, have + n
    words = [] if least is None else found.where(step >= least).toArrow().sort_by([("n", "descending"), ("word", "ascending")])["word"].to_pylist()
    discard(found)
    release()
    new = (w for w in words if w not in RANK)
    return Words(RANK | {w: len(RANK) + 1 + i for i, w in enumerate(new)})


def _charset(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100)


class _Runs:
    """The run through the present character, and the starts in it that can still give the least cost.

    A start ``i`` costs ``open(i) + log10(end - i)``, and ``each`` for every character but the first.  Of two starts the earlier gains on the
    later as the end moves on, so the starts form a stack: its top is best now, and beside each start is the end from
    which the one below is better.
    """

    def __init__(self, kind: str, each: float):
        self.kind, self.each, self.first, self.stack = kind, each, 0, []

    def begin(self, at: int) -> None:
        self.first = at
        self.stack.clear()

    def open(self, i: int, cost: float, end: int) -> None:
        cost -= self.each * (i + 1)
        if self.stack and self.least(end)[0] <= cost + math.log10(end - i) + self.each * end:
            return  # never better than the present best
        while self.stack:
            below, at, until = self.stack[-1]
            ratio = 10 ** min(300.0, cost - below)
            since = (ratio * i - at) / (ratio - 1) if ratio > 1 else math.inf
            if since < until:
                break
            self.stack.pop()
        self.stack.append((cost, i, since if self.stack else math.inf))

    def least(self, end: int) -> tuple[float, int]:
        while self.stack and self.stack[-1][2] <= end:
            self.stack.pop()
        if not self.stack:
            return math.inf, 0
        cost, i, _ = self.stack[-1]
        return cost + math.log10(end - i) + self.each * end, i


def segments(value: str, words: Words = BASIC) -> tuple[float, list[tuple[int, int, str]]]:
    """The least log10 guesses of ``value`` and the segmentation (start, end, kind) that reaches it.

    Every segment costs the guesses of its kind times 2 (the guesser must also choose where it ends), but
    a brute-force span pays that once and then its alphabet for each character.
    """
    n = len(value)
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    cut = math.log10(2)
    ends: dict[int, list[tuple[int, float, str]]] = {}

    def add(i: int, j: int, cost: float, kind: str) -> None:
        ends.setdefault(j, []).append((i, cost + cut, kind))

    for i in range(n):
        for size in words.sizes:
            if (j := i + size) > n:
                break
            rank = words.ranks.get(low[i:j]) or words.ranks.get(plain[i:j])
            if rank:
                part = value[i:j]
                extra = (part != low[i:j]) + (low[i:j] not in words.ranks)
                add(i, j, math.log10(rank) + extra * math.log10(4), "word")
    for m in DATE.finditer(value):
        add(m.start(), m.end(), math.log10(365 * 120 if m.end() - m.start() > 4 else 120), "date")
    step = [ord(low[k]) - ord(low[k - 1]) for k in range(1, len(low))]
    runs = [_Runs("repeat", 0.0), _Runs("walk", 0.6), _Runs("up", 0.0), _Runs("down", 0.0)]  # one character again and again, keyboard walks, and abcd or 4321
    want = {"repeat": 0, "up": 1, "down": -1}
    best = [(0.0, 0, "")] + [(math.inf, 0, "")] * n
    brute = [math.inf] * (n + 1)  # the best cost with a brute-force span open at this end
    brute_from = [0] * (n + 1)
    for j in range(1, n + 1):
        one = _charset(value[j - 1])
        opened, going = best[j - 1][0] + cut + one, brute[j - 1] + one
        brute[j], brute_from[j] = (going, brute_from[j - 1]) if going <= opened else (opened, j - 1)
        best[j] = (brute[j], brute_from[j], "brute")
        for run in runs:
            if j > 1 and not (low[j - 2 : j] in NEAR if run.kind == "walk" else step[j - 2] == want[run.kind]):
                run.begin(j - 1)
            if (i := j - 3) >= run.first:
                run.open(i, best[i][0] + cut + (_charset(low[i]) if run.kind == "repeat" else math.log10(47 if run.kind == "walk" else 52)), j)
            cost, i = run.least(j)
            if cost < best[j][0]:
                best[j] = (cost, i, run.kind)
        for i, cost, kind in ends.get(j, ()):
            if best[i][0] + cost < best[j][0]:
                best[j] = (best[i][0] + cost, i, kind)
    out, j = [], n
    while j:
        out.append((best[j][1], j, best[j][2]))
        j = best[j][1]
    return best[n][0], out[::-1]


def guess_cost(value: str, words: Words = BASIC) -> float:
    return segments(value, words)[0]


def _covered(start: int, end: int, spans: list[tuple[int, int, str]]) -> bool:
    """Whether the union of ``spans`` holds every character from ``start`` to ``end``."""
    for a, b, _ in sorted(spans):
        if a <= start < b:
            start = b
    return start >= end


def find_spans(text: str, threshold: float = THRESHOLD, words: Words = BASIC) -> list[tuple[int, int, str]]:
    """All spans ``(start, end, kind)`` of a text by start, then kind; ends are exclusive, in code points."""
    if not text:
        return []
    low = text.lower()
    found: list[tuple[int, int, str]] = []
    assigning = ":" in text or "=" in text
    if assigning and any(w in low for w in WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if assigning and any(w in low for w in HINTS):
        base = list(found)
        for m in CONTEXT.finditer(text):
            s, e = m.span(1)
            if not _covered(s, e, base) and guess_cost(text[s:e], words) >= threshold:
                found.append((s, e, "guess"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def secret_spans(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, spans array<struct<kind, start, end, log10_guesses>>`` for every row of ``docs``."""
    listed = docs.sparkSession.sparkContext.broadcast(ranked_words(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("log10_guesses", pa.float64())]))
        words = listed.value
        for batch in batches:
            rows = []
            for b in text_bytes(batch.column(1)):
                text = b.decode("utf-8", "replace")
                rows.append([{"kind": k, "start": s, "end": e, "log10_guesses": guess_cost(_value(text, s, e, k), words)} for s, e, k in find_spans(text, threshold, words)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    shape = f"doc_id {docs.schema[id_col].dataType.simpleString()}, spans array<struct<kind: string, start: long, end: long, log10_guesses: double>>"
    return bounded_batches(docs).select(id_col, text_col).mapInArrow(run, shape)


def _value(text: str, start: int, end: int, kind: str) -> str:
    return ASSIGN.match(text, start).group(2) if kind == "assign" else text[start:end]


def redact(text: str, spans: list[tuple[int, int, str]], mask: str = "[secret]") -> str:
    """``text`` with every union of overlapping spans replaced by ``mask``."""
    out, at, end = [], 0, 0
    for s, e, _ in spans:
        if s >= end:
            out += [text[at:s], mask]
        at = end = max(end, e)
    return "".join(out) + text[at:]


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spans = secret_spans(docs)
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "guess")
    return spans.select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), n("guess"),
        F.array_max(F.transform("spans", lambda x: x["log10_guesses"])).alias("max_log10_guesses"),
    )


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays; its secrets are masked and ``n_chars`` follows the new text."""
    names = docs.columns
    listed = spark.sparkContext.broadcast(ranked_words(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = listed.value
        at = names.index("text")
        for batch in batches:
            texts = []
            for t in batch.column(at).to_pylist():
                spans = find_spans(t, words=words) if t else []
                texts.append(redact(t, spans) if spans else t)
            yield batch.set_column(at, pa.field("text", pa.string()), pa.array(texts, pa.string()))

    out = bounded_batches(docs).mapInArrow(run, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out
