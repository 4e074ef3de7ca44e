"""Secrets, tokens, BPE and URLs against brute force, libraries and edge cases."""

import hashlib
import re

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinelake.llm import bpe, url_rules
from kinelake.llm.secrets import KINDS, find_spans, guess_cost, redact, secret_spans, secrets_stage, segments
from kinelake.llm.token_counts import PieceCounter, token_counts

SP = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
COUNTER = PieceCounter(P.path("piece_bpe_32k.model"))
LIB = Tokenizer.from_file(P.path("word_bpe_49k.json"))
OWN = bpe.WordBpe(P.path("word_bpe_49k.json"))
ODD = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t▁<|>endoftxsar'ß\x85\x1cΣİ")), max_size=80)
TEXTS = [None, "", " ", "\n\n", "a", "hello world", "naïve café", "x" * 5000, "word " * 3000, "<s></s><|endoftext|>", "日本語 テスト", "▁▁ ▁"]


@given(ODD)
@settings(max_examples=300, deadline=None)
def test_tokens_equal_library(text):
    assert COUNTER.count(text) == len(SP.encode(text))


@given(st.lists(ODD, max_size=4))
@settings(max_examples=300, deadline=None)
def test_bpe_equals_library(texts):
    ids = [np.frombuffer(x, "<u4").tolist() for x in OWN.encode(texts)]
    assert ids == [e.ids for e in LIB.encode_batch(texts, add_special_tokens=False)]
    assert [OWN.decode(np.array(x, "<u4").tobytes()) for x in ids] == [LIB.decode(x, skip_special_tokens=False) for x in ids]


def test_every_low_character():
    texts = [f"a{chr(i)}B{chr(i)}{chr(i)} 1" for i in range(0x250)]
    assert [np.frombuffer(x, "<u4").tolist() for x in OWN.encode(texts)] == [e.ids for e in LIB.encode_batch(texts, add_special_tokens=False)]


def test_small_caches(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    monkeypatch.setattr(bpe, "STRETCH", 40)
    own = bpe.WordBpe(P.path("word_bpe_49k.json"))
    texts = [f"some words {i} and other words {i % 3}" for i in range(60)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [e.ids for e in LIB.encode_batch(texts, add_special_tokens=False)]


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_token_rows(spark):
    got = token_counts(frame(spark, TEXTS), P.path("piece_bpe_32k.model")).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in got] == [(len((t or "").encode()), n := len(SP.encode(t or "")), n > 4096) for t in TEXTS]
    assert token_counts(frame(spark, []), P.path("piece_bpe_32k.model")).count() == 0
    assert token_counts(frame(spark, ["a", "a"], [None, None]), P.path("piece_bpe_32k.model")).count() == 2


def test_bpe_rows(spark):
    got = bpe.bpe_digests(frame(spark, TEXTS), P.path("word_bpe_49k.json")).orderBy("doc_id").collect()
    for r, t in zip(got, TEXTS, strict=True):
        e = LIB.encode(t or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(e, skip_special_tokens=False).encode()).hexdigest()
    ids = bpe.bpe_encode(frame(spark, TEXTS), P.path("word_bpe_49k.json"))
    texts = bpe.bpe_decode(ids, P.path("word_bpe_49k.json")).orderBy("doc_id").collect()
    assert [r.text for r in texts] == [LIB.decode(LIB.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for t in TEXTS]
    assert bpe.bpe_digests(frame(spark, []), P.path("word_bpe_49k.json")).count() == 0


def brute_base(text):
    kinds = {
        "assign": r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "access": r"AKIA[A-Z0-9]+",
        "hex": r"[0-9a-f]+",
    }
    out = []
    for n, (k, p) in enumerate(kinds.items()):
        for m in re.finditer(p, text):
            if {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}[k](m):
                out.append((m.start(), n, m.end(), k))
    return [(s, e, k) for s, _, e, k in sorted(out)]


PIECES = ["password=", "PASSWD : ", "api_key='", "apikey=", "token\" = ", "secret:", "x", "ABC123def", "AKIA", "0123456789abcdef", "Q9", " ", "ſecret=abcdefg", "é", "\n", "==", "abcdef"]


@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
@settings(max_examples=500, deadline=None)
def test_base_spans_stay(text):
    spans = find_spans(text)
    assert [x for x in spans if x[2] != "guess"] == brute_base(text)
    assert spans == sorted(spans, key=lambda x: (x[0], KINDS.index(x[2])))


def test_guess_costs():
    weak = ["changeme", "qwertyuiop", "aaaaaaaaaaaa", "2024-01-02", "password123", "abcdefgh", "letmein"]
    strong = ["x9$kQ2!vLmP0", "c1f6c02f845bf3028d", "uP7)zz!kW-20d"]
    assert max(map(guess_cost, weak)) < 10 < min(map(guess_cost, strong))
    cost, parts = segments("summer2024!!!!")
    assert [value for _, _, value in parts][:2] == ["word", "date"] and parts[0][0] == 0 and parts[-1][1] == 14
    for v in ("", "a", "as" * 30000, "a" * 60000):
        total, parts = segments(v)
        assert sum(e - s for s, e, _ in parts) == len(v)


def test_guess_cost_is_the_minimum():
    """Against all segmentations, built from the costs of single segments."""
    from functools import lru_cache
    from itertools import pairwise

    for v in ("cat1999", "love12", "qwe77x", "aaab"):
        n = len(v)

        def one(i, j, v=v):
            best, parts = segments(v[i:j])
            return best if len(parts) == 1 else np.inf

        best = min(sum(one(i, j) for i, j in pairwise([0, *[k for k in range(1, n) if mask >> k & 1], n])) for mask in range(0, 2**n, 2))
        assert guess_cost(v) <= best + 1e-9
    lru_cache  # noqa: B018


def test_long_runs_give_the_minimum():
    """Against a quadratic programme over single segments, for values whose runs are long."""
    import random
    from math import inf, log10

    from kinelake.llm.secrets import NEAR, RANK, _charset

    def price(v, i, j):
        part = v[i:j]
        steps = {ord(b) - ord(a) for a, b in zip(part, part[1:], strict=False)}
        costs = [sum(map(_charset, part))]
        if j - i > 1 and part in RANK:
            costs.append(log10(RANK[part]))
        if j - i >= 3:
            costs += [(_charset(part[0]) if step == 0 else log10(52)) + log10(j - i) for step in (0, 1, -1) if steps == {step}]
            if all(part[k : k + 2] in NEAR for k in range(len(part) - 1)):
                costs.append(log10(47) + log10(j - i) + 0.6 * (j - i - 1))
        return log10(2) + min(costs)

    rng = random.Random(3)
    parts = ["sunshine", "pass", "dddd", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcb", "qwertyuiop", "q", "qaqaqaqaqaqaqaqaqaqaqaqaqaqaqaqa", "password"]
    values = ["s" * 29 + "sunshine", "s" * 14 + "sunshine", "a" * 24 + "pass", "password" + "d" * 30 + "dragon"]
    values += ["".join(rng.choice([rng.choice(parts), rng.choice("asdq") * rng.randint(1, 40)]) for _ in range(4)) for _ in range(40)]
    for v in values:
        best = [0.0] + [inf] * len(v)
        for j in range(1, len(v) + 1):
            best[j] = min(best[i] + price(v, i, j) for i in range(j))
        assert guess_cost(v) == pytest.approx(best[-1], abs=1e-9), v
    assert find_spans("passphrase: " + "s" * 29 + "sunshine") == []


def test_wider_contexts(spark):
    text = "pwd => 'kX9!pQ2#vL7m' and passphrase: changeme1 password=hunter22 bearer: the"
    spans = find_spans(text)
    assert [(k, text[s:e]) for s, e, k in spans] == [("guess", "kX9!pQ2#vL7m"), ("assign", "password=hunter22")]
    assert redact(text, spans) == "pwd => '[secret]' and passphrase: changeme1 [secret] bearer: the"
    df = frame(spark, [None, "", text, "x" * 100000 + " token=abcdefgh"])
    got = {r.doc_id: [(x.kind, x.start) for x in r.spans] for r in secret_spans(df).collect()}
    assert got == {0: [], 1: [], 2: [("guess", 8), ("assign", text.index("password"))], 3: [("assign", 100001)]}
    docs = spark.createDataFrame([(1, text, "en", "s", 5), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in secrets_stage(spark, docs, "").collect()}
    assert "hunter22" not in out[1].text and out[1].n_chars == len(out[1].text) and out[2].text is None


def test_partly_covered_values():
    """A value that base spans only touch is judged as a whole."""
    for text in ("password: Tr0ub4dor&3xQz!", "auth: zQ9!" + "0123456789abcdef" * 2 + "#kW7~"):
        spans = find_spans(text)
        assert [k for _, _, k in spans if k != "guess"] and [text[s:e] for s, e, k in spans if k == "guess"] == [text.split(": ")[1]]
        assert redact(text, spans) in ("[secret]", "auth: [secret]")
    assert [k for *_, k in find_spans("password=hunter22")] == ["assign"]


def test_ordinary_words_stay(spark):
    """Words of the corpus are words; values of credential contexts don't make words of themselves."""
    values = ["auth: middleware", "credentials: everyone", "bearer: responsible", "passphrase: something"]
    prose = "Everyone responsible for the middleware does something"
    secret = "pwd: kqxvzjwpbtgm"
    texts = [prose] * 6 + [" and ".join(values)] + [secret] * 8
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: [x.kind for x in r.spans] for r in secret_spans(docs).collect()}
    assert got == {i: ["guess"] if t == secret else [] for i, t in enumerate(texts)}
    out = {r.doc_id: r.text for r in secrets_stage(spark, docs, "").collect()}
    assert out == {i: "pwd: [secret]" if t == secret else t for i, t in enumerate(texts)}


def url_brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]
    best = None
    for verdict, name in url_rules.HOST_RULES:
        h, _, p = name.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(name) > len(best[1])):
            best = (verdict, name)
    return host, path, best


URLS = [None, "", "nope", "http://Example.COM/en/7x", "http://a.example.com/en/71?q", "http://a.example.com/en/8", "x://net/de/", "http://b.example.net/de/8#f", "http://xexample.net/de/8", "http://xnet/de/8", "http://org/es/?a=://com/en/", "http://com", "http://m.adult-x.example.org/fr/1", "http://www.CHEAP-pills.example.com/fr/2", "https://ads-help.example.com/fr", "http://ads-track.x/", "http://É.com/en/é", "://", "http://a b\nc.com/en/\n"]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    rows = url_rules.judge_urls(df).orderBy("page_id").collect()
    for r, u in zip(rows, URLS, strict=True):
        host, path, best = url_brute(u)
        assert (r.host, r.path, r.rule) == (host, path, best and best[1]), u
        if best:
            assert r.verdict == best[0]
    by = dict(zip(URLS, rows, strict=True))
    assert by["http://m.adult-x.example.org/fr/1"].verdict == by["http://www.CHEAP-pills.example.com/fr/2"].verdict == by["http://ads-track.x/"].verdict == "block"
    assert by["https://ads-help.example.com/fr"].verdict == "allow"
    assert url_rules.judge_urls(df.limit(0)).count() == 0
    pages = df.select("page_id", "url").toPandas()
    con = duckdb.connect()
    con.register("pages", pages.astype({"url": object}).where(pd.notna(pages), None))
    want = con.sql(url_rules.OP6_SQL).df().sort_values("page_id")
    got = url_rules.judge_urls(df).drop("n_candidates").toPandas().sort_values("page_id")[list(want.columns)]
    assert got.astype(object).where(got.notna(), None).values.tolist() == want.astype(object).where(want.notna(), None).values.tolist()


def test_host_rules_are_the_contracts(spark):
    """Each rule's word as the contract lists it, on urls that it decides."""
    want = {"http://com/en/1": "block", "http://example.com/en/7": "allow", "http://www.net/de/1": "allow", "http://b.example.net/de/7": "allow", "http://b.example.net/de/8": "block", "http://org/es/1": "block", "http://casino.net/de/1": "allow"}
    df = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    got = url_rules.judge_urls(df).orderBy("page_id").collect()
    assert [(u, r.verdict) for u, r in zip(want, got, strict=True)] == list(want.items()) and all(r.rule for r in got)


def test_index_fetches_every_rule_that_fits(spark):
    rules = [url_rules.pattern_rule(p) for p in url_rules.PATTERNS]
    assert all(r.tokens for r in rules)
    loose = [url_rules.pattern_rule("a*b"), url_rules.pattern_rule("xyz")]
    assert loose[0].tokens == () and loose[1].tokens == ()
    df = spark.createDataFrame([(1, "http://q/aXXb"), (2, "http://wxyzw/")], "page_id long, url string")
    got = url_rules.judge_urls(df, (), ("a*b", "xyz")).collect()
    assert [r.verdict for r in got] == ["block", "block"]


@pytest.mark.parametrize("value", ["a", "password", "P4ssw0rd"])
def test_costs_are_positive(value):
    assert guess_cost(value) > 0
