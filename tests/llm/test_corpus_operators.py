"""Quality, mixing, Jaccard, media, substrings and WARC against brute force and edge cases."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kinelake.llm import jaccard as J
from kinelake.llm import media, mixing, quality, substring, warc
from kinelake.llm._hashing import sliding_min, window_hashes, word_hashes
from kinelake.llm.components import components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, h string, size int"


def corpus(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "clash", 1) for i, t, lang, s in rows], COLUMNS)


def words(rng, n, pool=300):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    base = [words(rng, rng.randint(60, 200), 100000) for _ in range(25)]
    out = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    for k in range(60):  # near copies, passages, exact copies
        t = rng.choice(base).split()
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = "edit"
        out.append((100 + k, " ".join(t), "en", "s1"))
    passage = base[0].split()[:55]
    out += [(200 + k, " ".join(words(rng, 40, 10**6).split() + passage + words(rng, 40, 10**6).split()), "de", "s2") for k in range(12)]
    out += [(300, None, None, None), (301, "", "en", "s1"), (302, " \n\t", "en", None), (303, "one two", "en", "s1"), (304, "One  TWO", "en", "s1"), (305, "a b c d e", "en", "s1"), (306, "é\x85è x y z", "fr", "s1")]
    out += [(7, base[7], "en", "s1"), (None, base[3] + " tail", "en", "s1"), (400, words(rng, 6000, 10**6), "en", "s0"), (400, "other text with the same id " + base[5], "en", "s0")]
    rng.shuffle(out)
    return out


# Hashing and components


def test_word_hashes():
    texts = [b"", b" ", b"a b  c\n", b"a", b"x" * 5000 + b" a", "é a".encode(), b"\x0b\x0ca\r"]
    h, n = word_hashes(texts)
    assert n.tolist() == [len(t.split()) for t in texts]
    seen = {}
    for w, v in zip([w for t in texts for w in t.split()], h.tolist(), strict=True):
        assert seen.setdefault(w, v) == v
    assert len(set(seen.values())) == len(seen)
    x = np.random.default_rng(0).integers(0, 3, 200).astype(np.uint64)
    w = window_hashes(x, 4)
    for i in range(0, 190, 7):
        for j in range(0, 190, 5):
            assert (w[i] == w[j]) == (x[i : i + 4] == x[j : j + 4]).all()
    assert (sliding_min(x, 41) == [x[i : i + 41].min() for i in range(160)]).all()


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    import kinelake.llm._hashing as H

    text = b" ".join(b"w%d" % (i % 97) for i in range(4000))
    want = H.word_hashes([text, b"z"])
    monkeypatch.setattr(H, "PIECE", 500)
    got = H.word_hashes([text, b"z"])
    assert (got[0] == want[0]).all() and got[1].tolist() == want[1].tolist()


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(200)] + [(5, 5)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect())
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_components_of_many_links(spark, monkeypatch):
    monkeypatch.setattr("kinelake.llm.components.ONE_TASK", 0)
    test_components(spark)


# Quality


def brute_repeats(ws, n=8):
    at = defaultdict(list)
    for i in range(len(ws) - n + 1):
        at[tuple(ws[i : i + n])].append(i)
    marked = {k for places in at.values() if len(places) > 1 for i in places for k in range(i, i + n)}
    return len(marked)


def test_base_figures():
    rng = random.Random(0)
    for _ in range(200):
        t = "".join(rng.choice(["a ", "b ", "c", " ", "\n", "#", "é", "\x85", "x y z w v u t s r\n"]) for _ in range(rng.randint(0, 60)))
        raw = t.encode()
        ws = raw.split()
        lines = t.split("\n")
        dup = sum(1 for i, x in enumerate(lines) if x.encode().split() and x in lines[:i])
        want = (len(ws), sum(len(w.decode()) for w in ws), sum(c in "#*$%&|<>" for c in t), dup, brute_repeats(ws))
        assert quality.base_figures(raw, len(ws), quality.repeated_words(ws)) == want
        assert quality.all_base_figures([b"", raw, b"x y", raw]) == [(0,) * 5, want, (2, 2, 0, 0, 0), want]


def brute_kn(counter, out=None):
    """Modified Kneser-Ney by dictionaries; with ``out`` the probability of that n-gram with one occurrence removed.

    Discounts stay those of the whole counts, as in the operator.
    """
    orders = {5: Counter(counter)}
    for k in range(4, 0, -1):
        orders[k] = Counter(g[1:] for g in orders[k + 1])
    discounts = {}
    for k, c in orders.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        discounts[k] = [0.0] + [min(max(j - (j + 1) * y * n[j + 1] / n[j] if y is not None and n[j] else plain, 0.05), j) for j, plain in ((1, 0.5), (2, 1.0), (3, 1.5))]
    uniform = 1 / len(orders[1])
    if out is not None:
        orders[5][out] -= 1
        orders = {5: +orders[5]}
        for k in range(4, 0, -1):
            orders[k] = Counter(g[1:] for g in orders[k + 1])
    low = defaultdict(lambda: uniform)  # of the empty string
    for k in range(1, 6):
        total, held = Counter(), Counter()
        for g, c in orders[k].items():
            total[g[:-1]] += c
            held[g[:-1]] += discounts[k][min(c, 3)]
        wanted = [*orders[k], *([out[5 - k :]] if out else [])]
        low = {g: (orders[k][g] - discounts[k][min(orders[k][g], 3)] + held[g[:-1]] * low[g[1:]]) / total[g[:-1]] if total[g[:-1]] else low[g[1:]] for g in wanted}
    return low


def test_language_model(spark, rows, monkeypatch):
    docs = corpus(spark, rows)
    want = Counter()
    for _, t, lang, _ in rows:
        if lang == "en":
            want.update(quality.grams_of((t or "").encode()))
    counts = quality.ngram_counts(docs)
    assert {r.gram: r.n for r in counts.where("lang = 'en'").collect()} == dict(want)
    p = brute_kn(want)
    model = quality.kneser_ney(counts)
    got = {r.gram: r.logp for r in model.where("lang = 'en'").collect()}
    assert got.keys() == p.keys() and all(abs(got[g] - np.log(p[g])) < 1e-9 for g in p)
    by = defaultdict(float)
    for g, v in p.items():
        by[g[:-1]] += v
    assert max(by.values()) <= 1 + 1e-9
    outs = {r.gram: r.logp_out for r in model.where("lang = 'en'").collect()}
    for g in random.Random(0).sample(sorted(want), 20):
        assert outs[g] == pytest.approx(np.log(max(brute_kn(want, g)[g], 1e-12)))
    scored = {(r.row.doc_id, r.n_words): r.nll for r in quality.score(docs, model, out=False).where("lang = 'en'").collect()}
    for i, t, lang, _ in rows:
        if lang == "en":
            raw = (t or "").encode()
            nll = -sum(np.log(p[g]) for g in quality.grams_of(raw)) / len(quality.grams_of(raw)) if raw.split() else None
            assert scored[i, len(raw.split())] == (pytest.approx(nll, rel=1e-5) if raw.split() else None)
    one, two = (sorted((r.row.doc_id or -1, r.n_words, round(r.nll or -1, 9)) for r in x.collect()) for x in (quality.score(docs, model), quality.score(docs, model, broadcast_grams=0, keep=["doc_id", "text"])))
    assert one == two


def test_long_texts_are_scored_in_pieces(monkeypatch):
    rng = random.Random(5)
    streams = [words(rng, n) for n in (3, 700, 0, 40)]
    h = np.unique(np.concatenate([quality.gram_hashes(c, f) for c, f, _ in quality._windows(streams)]))
    model = quality.SortedHashes(h[::2], -np.arange(1, len(h[::2]) + 1, dtype=np.float32) / 100)
    logp = dict(zip(h[::2].tolist(), model.logp.tolist(), strict=False))
    probe = np.concatenate([h, h + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)])
    assert model.find(probe).tolist() == [logp.get(x, min(logp.values())) for x in probe.tolist()]
    whole = quality.mean_nll(model, streams)
    monkeypatch.setattr(quality, "PIECE", 50)
    assert quality.mean_nll(model, streams) == pytest.approx(whole)
    counts = quality._Counts()
    for c, f, _ in quality._windows(streams):
        counts.add(quality.gram_hashes(c, f), c, f)
    want = Counter(g for s in streams for g in quality.grams_of(s.encode()))
    got = counts.rows("x")
    assert dict(zip(got["gram"].to_pylist(), got["n"].to_pylist(), strict=True)) == dict(want)


PHRASES = ["the old house on the hill was quiet and still", "a small boat came slowly up the wide river", "they found no water below the dry stones", "every evening she walked home along the wall", "nobody had heard the bell since last winter"]


def prose(rng, n):
    return " ".join(rng.choice(PHRASES) if rng.random() < 0.5 else words(rng, 1, 3000) + " " + rng.choice(PHRASES) for _ in range(n))


def test_bands_reject_disorder_and_noise(spark):
    """Shuffled words, shouting, symbols behind words and half-noise go; clean documents of all lengths stay."""
    rng = random.Random(11)
    clean = [(k, prose(rng, rng.choice([4, 8, 20, 60])), "en", "s") for k in range(400)]
    noise = lambda n: " ".join("".join(rng.choice("qxzjkvwQXZ0189") for _ in range(6)) for _ in range(n))
    bad = []
    for k in range(6):
        shuffled = prose(rng, 20).split()
        rng.shuffle(shuffled)
        bad += [" ".join(shuffled), prose(rng, 20).upper().replace(" ", "!! "), " ".join(w + rng.choice(["$$$", "***", "&&&"]) for w in prose(rng, 20).split()), prose(rng, 10) + " " + noise(60)]
    got = {r.row.doc_id: r for r in quality.quality_verdicts(corpus(spark, [*clean, *[(1000 + i, t, "en", "s") for i, t in enumerate(bad)]])).collect()}
    assert not any(got[1000 + i].kept for i in range(len(bad)))
    judged = [got[k] for k in range(400) if not got[k].base_failed]
    assert sum(r.kept for r in judged) >= 0.98 * len(judged)


def test_quality_verdicts(spark, rows):
    got = quality.quality_verdicts(corpus(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
        if not r.base_failed:
            assert r.kept == (r.lower <= r.nll <= r.upper)
    rng = random.Random(0)
    noise = "".join(rng.choice("qxzjkvwQXZ0189") for _ in range(400))
    odd = " ".join(noise[i : i + 8] for i in range(0, 400, 8))
    verdicts = {r.row.doc_id: r.kept for r in quality.quality_verdicts(corpus(spark, [*rows, *[(5000 + k, "the old house on the hill was quiet and still " * 1 + words(rng, 30, 400), "en", "s") for k in range(200)], (999, odd, "en", "s")])).collect()}
    assert verdicts[999] is False and all(verdicts[5000 + k] for k in range(200))
    assert quality.quality_verdicts(corpus(spark, [])).count() == 0
    twice = [(1, prose(rng, 8), "en", "s"), *[(k, prose(rng, 8), "en", "s") for k in range(2, 60)]]
    got = quality.quality_stage(spark, corpus(spark, [*twice, twice[0], (1, twice[0][1], "xx", "s")]), "").where("doc_id = 1").collect()
    assert [r.lang for r in got].count("en") == 2 or not got  # rows that share id and text are judged one by one
    assert set(quality.quality_stage(spark, corpus(spark, rows), "").columns) == {c.split()[0] for c in COLUMNS.split(", ")}


# Mixing


def brute_targets(sizes, weights=(5, 2, 1), times=3):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left, ws = total - sum(fixed.values()), sum(w[s] for s in names if s not in fixed)
        over = [s for s in names if s not in fixed and left * w[s] / ws > times * sizes[s]]
        if not over:
            return {s: fixed.get(s, left * w[s] / ws if s not in fixed else 0) for s in names}
        fixed |= {s: times * sizes[s] for s in over}


def test_targets_and_permutations(spark):
    sizes = {"a": 10, "b": 5000, "c": 300, "é": 40, "z": 9000, None: 700, "y": 0}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r for r in mixing.source_table(df).collect()}
    want = brute_targets(sizes)
    for s in sizes:
        assert got[s].target == pytest.approx(want[s]) and got[s].source_size == sizes[s]
        assert got[s].quota <= 3 * got[s].blocks
    n = spark.range(1, 40).selectExpr("id AS n", "explode(sequence(0, id - 1)) AS i")
    from pyspark.sql import functions as F

    perm = n.withColumn("p", mixing.permuted(F.col("i"), F.col("n"), F.lit(3))).groupBy("n").agg(F.sort_array(F.collect_list("p")).alias("p"), F.count_if(F.col("p") == F.col("i")).alias("same"))
    for r in perm.collect():
        assert r.p == list(range(r.n)) and (r.n < 12 or r.same < r.n)


def test_mix(spark, rows, tmp_path):
    docs = corpus(spark, rows)
    docs.select("doc_id", "text", "source").write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op3_mixing(spark, str(tmp_path)).collect()
    again = mixing.op3_mixing(spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").encode().split())
    want = brute_targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source_size, round(r.target, 6)] += r.taken
    for s, t in want.items():
        assert abs(taken[sizes[s], round(t, 6)] - t) <= 2 * mixing.BLOCK
    assert mixing.op3_mixing(spark, _empty(spark, docs, tmp_path)).count() == 0


def _empty(spark, docs, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    return str(tmp_path / "empty")


def test_slots_meet_quotas_and_shards_vary(spark):
    df = spark.createDataFrame([("a", 4000), ("b", 9000), ("c", 100)], "source string, size long")
    src = mixing.source_table(df, block=8).persist()
    slots = mixing.slot_table(src, shard=64).collect()
    quota = {r.s: (r.quota, r.blocks) for r in src.collect()}
    for s, (q, blocks) in quota.items():
        mine = [r for r in slots if r.s == s]
        assert sorted(r.j for r in mine) == list(range(q))
        for p in {r["pass"] for r in mine}:
            seen = [r.block for r in mine if r["pass"] == p]
            assert len(set(seen)) == len(seen) and max(seen) < blocks
    per = Counter((r.shard, r.s) for r in slots)
    assert len({per[k, 0] for k in range(10)}) > 2
    assert all(sum(per[k, s] for s in quota) == 64 for k in range(len(slots) // 64))


def test_mix_row_by_row(spark, rows, monkeypatch):
    """The whole mix by loops; only the hashes (draws, permutations, chunks) come from Spark."""
    monkeypatch.setattr(mixing, "GROUP", 3)
    monkeypatch.setattr(mixing, "CHUNK", 4)
    block, shard = 8, 32
    sizes = mixing.with_sizes(corpus(spark, [*rows, *[(1000 + i, words(random.Random(i), 50 + i), "en", "s9") for i in range(30)]]))
    got = {r.uid: r for r in _words(*mixing.mix(sizes, block=block, shard=shard))}
    docs = sizes.collect()
    names = sorted({d.source for d in docs if d.source is not None}) + [None]
    total = [sum(d.size for d in docs if d.source == x) for x in names]
    weight = [mixing.WEIGHTS[k % 3] for k in range(len(names))]
    target, free, left = [None] * len(names), set(range(len(names))), sum(total)
    while True:  # water filling: sources that would pass their caps stop there
        share = {k: left * weight[k] / sum(weight[i] for i in free) for k in free}
        over = [k for k in free if share[k] > 3 * total[k]]
        if not over:
            break
        for k in over:
            target[k] = 3 * total[k]
            left -= target[k]
            free.remove(k)
    for k in free:
        target[k] = share[k]
    blocks = [-(-t // block) for t in total]
    quota = [min(int(target[k] * blocks[k] / total[k] + 0.5), 3 * blocks[k]) if total[k] else 0 for k in range(len(names))]
    draws = sum(quota)
    owner = [k for k, q in enumerate(quota) for _ in range(q)]
    from pyspark.sql import functions as F

    slots = spark.range(draws).select(F.col("id"), F.floor(F.col("id") / shard).alias("shard"), F.pmod("id", F.lit(shard)).alias("slot"))
    drawn = {r.id: r.u for r in slots.select("id", F.pmod(F.xxhash64(F.lit(mixing.SEED + 2), "shard", "slot"), F.lit(draws)).alias("u")).collect()}
    per = [Counter() for _ in range(-(-draws // shard))]
    used, spare = Counter(), []
    for i in range(draws):
        k = owner[drawn[i]]
        if used[k] < quota[k]:
            used[k] += 1
            per[i // shard][k] += 1
        else:
            spare.append(i // shard)
    short = [k for k, q in enumerate(quota) for _ in range(q - used[k])]
    for where, k in zip(spare, short, strict=True):
        per[where][k] += 1
    spans = [(k, p, blocks[k]) for k in range(len(names)) for p in range(3) if blocks[k]]
    table = spark.createDataFrame(spans, "s int, pass long, n long").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    perm = {(r.s, r["pass"], r.i): r.b for r in table.select("s", "pass", "i", mixing.permuted(F.col("i"), F.col("n"), F.col("s"), F.col("pass")).alias("b")).collect()}
    takes, number = Counter(), Counter()
    for c in per:
        for k, m in c.items():
            for _ in range(m):
                takes[k, perm[k, number[k] // blocks[k], number[k] % blocks[k]]] += 1
                number[k] += 1
    count = Counter(d.source for d in docs)
    chunk = {r.uid: r.c for r in sizes.select("uid", F.xxhash64("doc_id", "text_hash").alias("c")).collect()}
    null_first = lambda x: (x is not None, x or 0)
    for k, x in enumerate(names):
        own = sorted((d for d in docs if d.source == x), key=lambda d: (chunk[d.uid] % -(-count[d.source] // 4), null_first(d.doc_id), d.text_hash, d.size, d.uid))
        at = 0
        for d in own:
            want = sum(takes[k, w // block] for w in range(at, at + d.size))
            at += d.size
            assert (got[d.uid].taken if d.size else 0) == want, d.doc_id
            assert d.size == 0 or (got[d.uid].source_size == total[k] and got[d.uid].target == pytest.approx(target[k]))


def _words(docs, parts):
    from pyspark.sql import functions as F

    return parts.groupBy("uid", "source_size", "target").agg(F.sum(F.col("n") * F.col("takes")).alias("taken")).collect()


def test_mixing_stage(spark, rows):
    docs = corpus(spark, rows)
    out = mixing.mixing_stage(spark, docs, "")
    assert out.columns == docs.columns
    kept = mixing.with_sizes(docs)
    _, parts = mixing.mix(kept)
    want = parts.selectExpr("sum(n * takes)").first()[0]
    texts = [r.text for r in out.collect()]
    assert sum(len(t.encode().split()) for t in texts) == want


# Jaccard


def shingles(t):
    ws = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def brute_components(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(ids) if ids else None) for i in g]
    return sorted(out, key=str)


def test_jaccard(spark, rows, monkeypatch, tmp_path):
    docs = corpus(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = brute_components(rows)
    assert sorted((tuple(r) for r in J.op7_jaccard(spark, str(tmp_path)).collect()), key=str) == want
    # Everything small: runs go through stars and cross-component checks, frequent shingles are listed.
    for name, value in (("SMALL_RUN", 1), ("LEADERS", 1), ("FREQUENT", 2), ("CHUNK", 2000), ("RANGE", 50), ("WORTH", 0), ("ROUNDS", 1)):
        monkeypatch.setattr(J, name, value)
    assert sorted((tuple(r) for r in J.op7_jaccard(spark, str(tmp_path)).collect()), key=str) == want
    monkeypatch.setattr(J, "HOT_RUN", 3)  # and shingles of more than three documents take the way of the hot ones
    assert sorted((tuple(r) for r in J.op7_jaccard(spark, str(tmp_path)).collect()), key=str) == want
    kept = J.jaccard_stage(spark, docs, "")
    assert kept.columns == docs.columns
    out = kept.collect()
    full = [r for r in out if shingles(r.text)]
    comps = len({c for d, n, c in want if n})
    assert comps <= len(full) <= comps + 2  # two rows share the id 400 with different texts
    assert sum(1 for r in out if not shingles(r.text)) == 3
    again = [shingles(r.text) for r in full]
    assert not any(100 * len(a & b) >= 75 * len(a | b) for i, a in enumerate(again) for b in again[:i])


def test_groups_of_several_classes(spark, tmp_path):
    """Two unlinked classes with one prefix, each linked to a document of its own: both links are found at the default sizes."""
    rng = random.Random(5)
    fresh = lambda n: words(rng, n, 10**9).split()
    core, common = fresh(60), fresh(4)
    tails = [common + fresh(100), common + fresh(100)]  # frequent shingles come last, so no prefix holds them
    changed = [core[:at] + fresh(1) + core[at + 1 :] for at in (20, 40)]
    texts = [c + t for c, t in zip([core, core, *changed], tails * 2, strict=True)]
    texts += [fresh(400) + t + fresh(400) for t in tails for _ in range(14)]
    rows = [(i, " ".join(t), "en", "s") for i, t in enumerate(texts)]
    corpus(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    order = J.Order(*J.frequent_shingles(corpus(spark, rows).select("text"), 10**5, 4))
    one, two = J.shingle_sets([" ".join(t).encode() for t in texts[:2]])
    assert len(one) == len(two) and (order.prefix(one, 75) == order.prefix(two, 75)).all()
    got = sorted((tuple(r) for r in J.op7_jaccard(spark, str(tmp_path)).collect()), key=str)
    assert got == brute_components(rows)
    assert {c for d, _, c in got if d in (0, 2)} == {0} and {c for d, _, c in got if d in (1, 3)} == {1}


def join_rows(spark, run):
    """Rows that each join of what ``run`` executes makes, by the join's keys; those of equal keys together."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = store.executionsCount()
    run()
    bus.waitUntilEmpty()
    made, done = defaultdict(int), store.executionsList()
    for e in (done.apply(i).executionId() for i in range(before, done.size())):
        nodes, values = store.planGraph(e).allNodes(), store.executionMetrics(e)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size())) if "Join" in node.name() else ():
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    keys = re.sub(r"#\d+L?", "", " ".join(re.findall(r"\[[^\]]*\]", node.desc())[:2]))
                    made[keys] += int(values.apply(m.accumulatorId()).replace(",", ""))
    return made


def near_copies():
    """Copies of one text with up to seven words changed each: most link, many do not, and their prefixes share many shingles."""
    rng = random.Random(11)
    base = words(rng, 150, 10**9).split()
    rows = []
    for i in range(300):
        text = list(base)
        for at in rng.sample(range(150), rng.choice([1, *[2] * 3, *[3] * 10, *[4, 5, 6, 7] * 2])):
            text[at] = words(rng, 1, 10**9)
        rows.append((i, " ".join(text), "en", "s"))
    return rows


def memberships(spark, rows):
    """How many members the runs have that are too large to give all their pairs."""
    order = J.Order(*J.frequent_shingles(corpus(spark, rows).select("text"), 10**5, 4))
    count = Counter(t for s in J.shingle_sets([t.encode() for _, t, *_ in rows]) for t in order.prefix(s, 75).tolist())
    return sum(n for n in count.values() if n > J.SMALL_RUN)


def test_near_copies_across_components(spark, tmp_path):
    """No join pairs the members of a run with each other."""
    rows = near_copies()
    corpus(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = []
    made = join_rows(spark, lambda: got.extend(J.op7_jaccard(spark, str(tmp_path)).collect()))
    want = brute_components(rows)
    assert sorted((tuple(r) for r in got), key=str) == want and 20 < len({c for *_, c in want}) < 200
    assert 0 < made["[run] [run]"] <= 3 * memberships(spark, rows), dict(made)  # once in each round


def test_members_of_runs_joined_once(spark):
    """The runs' groups meet their classes once, however many rounds follow."""
    rows = near_copies()
    made = join_rows(spark, lambda: J.jaccard_stage(spark, corpus(spark, rows), "").collect())
    assert 0 < made["[g] [g]"] <= memberships(spark, rows), dict(made)


def test_long_texts_of_a_run_are_told_apart_by_bitmaps(spark, tmp_path, monkeypatch):
    """Long texts that share a third of their shingles fill any bitmap of 1,024 bits; wider ones spare the check of whole texts."""
    rng = random.Random(3)
    shared, near = words(rng, 1000, 10**9), words(rng, 3000, 10**9).split()
    texts = [f"{words(rng, 2000, 10**9)} {shared}" for _ in range(10)]
    texts += [" ".join(near[:at] + words(rng, n, 10**9).split() + near[at + n :]) for at, n in ((0, 0), (500, 40), (1500, 150), (2500, 300), (1000, 900))]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    corpus(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    verify, checked = J._verify, []
    monkeypatch.setattr(J, "_verify", lambda pairs, *rest: checked.append(pairs.count()) or verify(pairs, *rest))
    got = sorted((tuple(r) for r in J.op7_jaccard(spark, str(tmp_path)).collect()), key=str)
    assert got == brute_components(rows)
    assert sum(checked[1:]) <= 5, checked  # of the 45 pairs of the run


def test_near_keeps_every_link():
    """The pairs that the bitmaps leave hold all that link, whatever the sizes and widths, and each pair once."""
    rng = np.random.default_rng(4)
    sets = []
    for n in (1, 3, 50, 400, 511, 512, 513, 1000, 1024, 3000, 40_000):
        base = rng.integers(0, 1 << 64, n, np.uint64)
        sets += [np.unique(np.concatenate([base[int(n * cut) :], rng.integers(0, 1 << 64, int(n * more), np.uint64)])) for cut, more in ((0, 0), (0.1, 0), (0, 0.3), (0.24, 0), (0.1, 0.1), (0.5, 0.5))]
    n = np.array([len(s) for s in sets])
    bits, wide = zip(*(J.bitmaps(s) for s in sets), strict=True)
    assert all((b == J.bitmap(s)).all() for b, s in zip(bits, sets, strict=True))
    where = rng.permutation(len(sets))  # positions need not follow the sizes
    a, b, _ = J._near(np.arange(len(sets)), n[where], where % 1, np.array(bits)[where], [wide[k] for k in where], 75)
    got = [tuple(sorted(x)) for x in zip(where[a].tolist(), where[b].tolist(), strict=True)]
    common = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    links = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * (c := common(i, j)) >= 75 * (n[i] + n[j] - c)}
    assert len(set(got)) == len(got) and links <= set(got) and len(links) > 20


def test_jaccard_empty(spark, tmp_path):
    assert J.op7_jaccard(spark, _empty(spark, corpus(spark, []), tmp_path)).count() == 0


def test_bitmap_bounds():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], rng.integers(0, 2**63, 60).astype(np.uint64)]))
        bits = int(np.bitwise_count(J.bitmap(a).view(np.uint64) ^ J.bitmap(b).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(a, b))


# Substrings


def brute_removed(rows, length):
    ws = [(t or "").encode().split() for _, t, *_ in rows]
    first = {}
    big = float("inf")
    ids = [big if r[0] is None else r[0] for r in rows]
    for w, d in zip(ws, ids, strict=True):
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, big), d)
    out = []
    for w, d, r in zip(ws, ids, rows, strict=True):
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < d:
                gone |= set(range(k, k + length))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [5, 50])
def test_substrings(spark, rows, monkeypatch, length):
    monkeypatch.setattr(substring, "CHUNK_WINDOWS", 300)
    got = substring._removed(corpus(spark, rows), length, "doc_id", "text", lambda b: hashlib.sha256(b).hexdigest(), "kept_sha256 string")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_removed(rows, length)
    monkeypatch.setattr(substring, "FAN", 3)  # chunks are merged in a tree
    got = substring._removed(corpus(spark, rows).repartition(5), length, "doc_id", "text", lambda b: hashlib.sha256(b).hexdigest(), "kept_sha256 string")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_removed(rows, length)
    assert substring.without_duplicates(corpus(spark, [])).count() == 0


def test_factors_are_greedy(monkeypatch):
    rng = random.Random(2)
    for step in (32, 2):
        monkeypatch.setattr(substring, "STEP", step)
        for _ in range(100):
            seqs = [[rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 6))]
            ids = [rng.randrange(4) for _ in seqs]
            key = np.array([x for s in seqs for x in s], np.uint64)
            stretch = np.repeat(np.arange(len(seqs)), [len(s) for s in seqs])
            begin = np.cumsum([0, *[len(s) for s in seqs]])
            want = []
            places = [(ids[k], begin[k] + j, k, j) for k, s in enumerate(seqs) for j in range(len(s))]
            first = {x: min(p for p in places if seqs[p[2]][p[3]] == x) for x in range(4) if x in key}
            for k, s in enumerate(seqs):
                j = 0
                while j < len(s):
                    d, at, r, q = first[s[j]]
                    n = 0
                    while d < ids[k] and j + n < len(s) and q + n < len(seqs[r]) and s[j + n] == seqs[r][q + n]:
                        n += 1
                    if n:
                        want.append((begin[k] + j, at, n))
                    j += max(n, 1)
            got = substring.factors(key, stretch, np.array(ids))
            assert sorted(zip(*[x.tolist() for x in got], strict=True)) == sorted(want)


def test_straddling_windows(spark):
    a = [f"a{i}" for i in range(80)]
    b = a[40:] + [f"b{i}" for i in range(60)]
    c = a[:] + b[40:70]  # a phrase of a, continued by one of b
    rows = [(1, " ".join(a), "en", "s"), (2, " ".join(b), "en", "s"), (3, " ".join(c), "en", "s")]
    got = substring.without_duplicates(corpus(spark, rows)).orderBy("doc_id").collect()
    assert [r.n_removed for r in got] == [0, 0, 110]


# Media


def test_png_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 65, 5000):
        p = media.padded(rng.bytes(n))
        assert len(p) == max(64, -(-n // 64) * 64) and media.from_png(media.to_png(p)) == p
    broken = bytearray(media.to_png(media.padded(b"abc")))
    broken[-20] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.from_png(bytes(broken))


def test_media_rows(spark, rows, tmp_path):
    corpus(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = media.op8_media(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append((t or "").encode())
    for r in got:
        t = next(x for x in texts[r.doc_id] if hashlib.sha256(media.padded(x)).hexdigest() == r.payload_sha256)
        p = media.padded(t)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(t), len(p), zlib.crc32(p[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.to_png(p)).hexdigest() and r.media_bytes == len(media.to_png(p)) and r.feature == media.feature(p)
        assert (r.pos, r.n_items, r.caption) == (1, 3, f"{r.n_bytes} bytes")  # heading, figure, closing line
    nul = [(1, None, "en", "s"), (2, "\0", "en", "s"), (3, "a", "en", "s"), (4, "a\0\0", "en", "s"), (4, "a\0\0", "en", "s"), (5, "", None, None)]
    corpus(spark, nul).write.parquet(str(tmp_path / "nul" / "documents.parquet"))
    got = sorted((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256) for r in media.op8_media(spark, str(tmp_path / "nul")).collect())
    assert got == sorted((i, len(t or ""), 64, hashlib.sha256(media.padded((t or "").encode())).hexdigest()) for i, t, _, _ in nul)
    assert media.op8_media(spark, _empty(spark, corpus(spark, []), tmp_path)).count() == 0


def test_sequences(spark):
    html = '<h1>T</h1><p>one <b>two</b><img src="media:aa" alt="A">three<script>x</script></p><figure><img src="media:bb"><figcaption>cap <i>B</i></figcaption></figure><p>end'
    items = media.parse_sequence(html)
    assert [(i["kind"], i["text"] or i["ref"], i["caption"]) for i in items] == [("text", "T", None), ("text", "one two", None), ("media", "media:aa", "A"), ("text", "three", None), ("media", "media:bb", "cap B"), ("text", "end", None)]
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p"), (4, "plain")], "page_id long, html string")
    store = spark.createDataFrame([("aa", 3)], "digest string, n_bytes long")
    back = {r.id: r["items"] for r in media.aligned(media.resolve(media.sequences(pages), store)).collect()}
    assert [(i.pos, i.n_bytes) for i in back[1]] == [(0, None), (1, None), (2, 3), (3, None), (4, None), (5, None)]
    assert [i.text for i in back[4]] == ["plain"]


# WARC


def b32(t):
    return base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()


def test_warc(spark, tmp_path):
    trap = "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "u", trap), (2, "u", None), (3, "u", ""), (4, "u\r\nq", "dup"), (5, None, "dup"), (6, "b", "WARC/1.1\r\n" * 500), (None, "z", "dup"), (4, "u", "dup"), (9, "e", "é" * 3000), (10, "f", "A" * 200000), (None, "n", "lone")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    warc.write_warc(df.repartition(3), str(tmp_path / "w"), archive_bytes=1000)
    warc.write_warc(df.repartition(3), str(tmp_path / "single"), archive_bytes=1)
    assert len(list((tmp_path / "single").rglob("*.txt"))) == len(rows) > len(list((tmp_path / "w").rglob("*.txt"))) > 3
    for sizes in ({}, {"stretch": 1000, "overlap": 50}):
        got = sorted((r.id, r.payload_bytes, r.digest, r.type, r.refers_to) for r in warc.read_warc(spark, str(tmp_path / "w"), **sizes).collect())
        want = []
        for i, _, t in rows:
            t = t or ""
            same = [j for j, _, s in rows if (s or "") == t and j is not None]
            first = min(same, default=None)
            revisit = first is not None and i != first
            want.append(("" if i is None else str(i), len(t.encode()), b32(t), "revisit" if revisit else "response", str(first) if revisit else None))
        assert got == sorted(want)
    df.write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.op10_warc(spark, str(tmp_path)).count() == len(rows)
    df.limit(0).write.parquet(str(tmp_path / "none" / "pages.parquet"))
    assert warc.op10_warc(spark, str(tmp_path / "none")).count() == 0


def test_pointer_jumping():
    rng = random.Random(3)
    for _ in range(100):
        offsets = sorted(rng.sample(range(1, 500), rng.randint(0, 40)))
        offsets = ([0] if rng.random() < 0.9 else []) + offsets
        nxt = [rng.choice(offsets[k + 1 :] + [o + 1]) for k, o in enumerate(offsets)]
        at, want = 0, set()
        table = dict(zip(offsets, nxt, strict=True))
        while at in table:
            want.add(at)
            at = table[at]
        got = warc.reached(np.array(offsets, np.int64), np.array(nxt, np.int64))
        assert {o for o, k in zip(offsets, got.tolist(), strict=True) if k} == want


# Pipeline


def test_pipeline(spark, rows, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    import corpus_pipeline
    from kinelake.llm._common import materialize

    docs = corpus(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    df = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, df = df, materialize(stage(spark, df, str(tmp_path)), f"test{k}")
        if k < 4:
            assert df.columns == docs.columns, name
        assert df.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "secret scans", "mixing sources", "BPE encoding"]
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = sorted((r.doc_id or -1, lib.encode(r.text, add_special_tokens=False).ids) for r in before.collect())
    assert sorted((r.doc_id or -1, r.ids) for r in df.collect()) == want
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.count() == df.count()


def test_registered():
    import __spark_entry__ as entry
    from kinelake import llm

    names = set(llm.queries())
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 11)) and len(names) == 10
    assert names | {"pipeline"} <= set(entry.queries())
