"""Hand-computed answers for discrete trajectories, lags, sources and samples."""

import numpy as np
import pytest

from kinelake.functions.support import TimeUnit, bytes_to_string, combinations, confidence_interval, generate_lags, product, statistical_inefficiency, string_to_bytes
from kinelake.operators import dtrajs as D
from kinelake.operators import lag as G
from kinelake.operators import statistics as S
from kinelake.sources import frames as Fr


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def by_traj(df):
    out = {}
    for t, _, s in rows(df.select("traj_id", "t", "state"), "traj_id", "t"):
        out.setdefault(t, []).append(s)
    return out


@pytest.mark.parametrize(("dtrajs", "hist", "used"), [([[0] * 6], [6], 1), ([[1] * 6], [0, 6], 1), ([[0, 1, 2, 3, 4], [2, 2, 2, 2, 6]], [1, 1, 5, 1, 1, 0, 1], 6)])
def test_histogram(spark, dtrajs, hist, used):
    df = Fr.from_dtrajs(spark, dtrajs)
    assert [n for _, n in rows(D.state_histogram(df), "state")] == hist
    assert D.number_of_states(df) == len(hist)
    assert D.number_of_states(df, True) == used


def test_negative_states(spark):
    df = Fr.from_dtrajs(spark, [[0, -1, 1]])
    assert rows(D.state_histogram(df, True)) == [(0, 1), (1, 1)]
    with pytest.raises(Exception, match="negative"):
        D.state_histogram(df).collect()
    with pytest.raises(ValueError):
        Fr.from_dtrajs(spark, [[-2]])


def test_state_index(spark):
    df = D.state_index(Fr.from_dtrajs(spark, [[0, 1, 2, 3, 2, 1, 0], [3, 4, 5]]))
    got = {}
    for s, tr, t, _ in rows(df, "state", "rank"):
        got.setdefault(s, []).append((tr, t))
    assert got == {0: [(0, 0), (0, 6)], 1: [(0, 1), (0, 5)], 2: [(0, 2), (0, 4)], 3: [(0, 3), (1, 0)], 4: [(1, 1)], 5: [(1, 2)]}


@pytest.mark.parametrize(
    ("dtrajs", "core", "want", "offsets"),
    [
        ([[0, 0, 2, 0, 0, 3, 0, 5, 5, 5, 0, 0, 6, 8, 4, 1, 2, 0, 3]], [2, 3, 4, 5, 6], {0: [2, -1, -1, 3, -1, 5, 5, 5, -1, -1, 6, -1, 4, -1, 2, -1, 3]}, {0: 2}),
        ([[2, 0, 1, 1, 2]], [1, 2], {0: [2, -1, 1, 1, 2]}, {0: 0}),
        ([[0, 1, 2, 2, 2, 2, 2, 0]], [2], {0: [2, 2, 2, 2, 2, -1]}, {0: 2}),
        ([[1, 2, 1, 1, 1, 2, 2, 0]], [2], {0: [2, -1, -1, -1, 2, 2, -1]}, {0: 1}),
        ([[5, 4, 1, 3, 4, 4, 5, 3, 0, 1], [4, 4, 4, 5], [4, 4, 5, 1, 2, 3]], [0, 1, 3], {0: [1, 3, -1, -1, -1, 3, 0, 1], 2: [1, -1, 3]}, {0: 2, 1: None, 2: 3}),
    ],
)
def test_core_sets(spark, dtrajs, core, want, offsets):
    df = Fr.from_dtrajs(spark, dtrajs)
    assert by_traj(D.core_set_rewrite(df, core)) == want
    assert dict(rows(D.core_set_offsets(df, core))) == offsets
    filled = by_traj(D.core_set_milestones(df, core, block=3))
    for k, seq in want.items():
        last, full = None, []
        for s in seq:
            last = s if s >= 0 else last
            full.append(last)
        assert filled[k] == full


def test_counts_and_blocks(spark):
    rng = np.random.default_rng(0)
    dtrajs = [rng.integers(0, 4, n) for n in (57, 3, 1, 200)]
    df = Fr.from_dtrajs(spark, dtrajs)
    for lag in (1, 3, 10):
        want = np.zeros((4, 4))
        for d in dtrajs:
            np.add.at(want, (d[:-lag], d[lag:]), 1)
        for block in (5, 64, 100000):
            assert (D.counts_matrix(D.transition_counts(df, lag, block=block), 4) == want).all()
    every = D.counts_matrix(D.transition_counts(df, 3, "sample"), 4)
    want = np.zeros((4, 4))
    for d in dtrajs:
        s = d[::3]
        np.add.at(want, (s[:-1], s[1:]), 1)
    assert (every == want).all()
    many = {(r.lag, r.i, r.j): r.n for r in D.transition_counts_lags(df, (1, 3)).collect()}
    assert sum(n for (k, _, _), n in many.items() if k == 3) == sum(max(0, len(d) - 3) for d in dtrajs)
    parts = D.block_split(df, 10, 2)
    assert (D.counts_matrix(D.transition_counts(parts, 2), 4)).sum() == sum(max(0, len(d) - 2) for d in dtrajs)


def test_minimum_connectivity():
    from kinelake.functions.linalg import connected_sets

    c = np.array([[7.0, 1], [1, 0]])
    assert [s.tolist() for s in connected_sets(c, 0)] == [[0, 1]]
    assert connected_sets(c, 2)[0].tolist() == [0]
    chain = np.diag(np.ones(4), 1)
    assert len(connected_sets(chain, 0)) == 5
    assert connected_sets(chain, 0, strong=False)[0].tolist() == [0, 1, 2, 3, 4]


def test_ensembles(spark):
    df = spark.createDataFrame([(0, t, k, s) for t, (k, s) in enumerate([(0, 0), (0, 1), (1, 1), (1, 0), (1, 1), (0, 0), (0, 0)])], "traj_id int, t bigint, k int, state int")
    assert rows(D.ensemble_counts(df, 1)) == [(0, 0, 0, 1), (0, 0, 1, 1), (1, 0, 1, 1), (1, 1, 0, 1)]


def test_lags_and_windows(spark):
    x = Fr.from_arrays(spark, [np.arange(10.0), np.arange(3.0)])
    pairs = G.lagged_pairs(x, 4, block=5)
    assert [(r.traj_id, r.t, r.x[0], r.y[0]) for r in pairs.orderBy("traj_id", "t").collect()] == [(0, t, t, t + 4) for t in range(6)]
    strided = G.lagged_pairs(x, 4, stride=2, skip=1)
    assert sorted(r.t for r in strided.collect()) == [1, 3, 5]
    with pytest.raises(ValueError):
        G.long_enough(Fr.lengths(x), 100)


def test_sources(spark, tmp_path):
    rng = np.random.default_rng(1)
    a, b = rng.random((7, 2)).astype(np.float32).astype(float), rng.random((5, 2)).astype(np.float32).astype(float)
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "b.npy", b)
    np.savetxt(tmp_path / "a.dat", a, header="x y")
    np.savetxt(tmp_path / "b.csv", b, delimiter=",", header="x,y", comments="")
    for files in (["a.npy", "b.npy"], ["a.dat"], ["b.csv"]):
        got = Fr.get_output(Fr.source(spark, [str(tmp_path / f) for f in files]))
        for g, f in zip(got, files, strict=True):
            assert np.allclose(g, a if f[0] == "a" else b)
    joined = Fr.source(spark, [[str(tmp_path / "a.npy"), str(tmp_path / "b.npy")]])
    assert np.allclose(Fr.get_output(joined)[0], np.vstack([a, b]))
    np.savez(tmp_path / "c.npz", u=a, v=b)
    assert [len(x) for x in Fr.get_output(Fr.source(spark, str(tmp_path / "c.npz")))] == [7, 5]
    with pytest.raises(ValueError):
        Fr.source(spark, ["x.npy", "y.csv"])
    with pytest.raises(NotImplementedError):
        Fr.source(spark, "x.xtc")
    frames = Fr.from_arrays(spark, [a, b])
    Fr.write_parquet(frames, str(tmp_path / "out"))
    assert Fr.source(spark, frames) is frames
    back = spark.read.parquet(str(tmp_path / "out"))
    assert np.allclose(Fr.get_output(back)[1], b)
    with pytest.raises(Exception, match="(?i)exist"):
        Fr.write_csv(frames, str(tmp_path / "out"))
    d = Fr.from_dtrajs(spark, [[0, 1, 2], [2, 2]])
    names = Fr.save_dtrajs_npy(d, str(tmp_path / "d"))
    assert by_traj(Fr.read_dtrajs(spark, names)) == {0: [0, 1, 2], 1: [2, 2]}
    (tmp_path / "t.dtraj").write_text("0\n1\n1\n")
    assert by_traj(Fr.read_dtrajs(spark, [str(tmp_path / "t.dtraj")])) == {0: [0, 1, 1]}


def test_parquet_files_do_not_grow_with_trajectories(spark, tmp_path):
    trajs = [np.arange(3.0 + i % 4)[:, None] + i for i in range(60)]
    Fr.write_parquet(Fr.from_arrays(spark, trajs), str(tmp_path / "out"), stride=2)
    files = list((tmp_path / "out").rglob("*.parquet"))
    assert len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    back = Fr.get_output(spark.read.parquet(str(tmp_path / "out")))
    assert len(back) == 60 and all(np.array_equal(x, y[::2]) for x, y in zip(back, trajs, strict=True))
    held = [set(spark.read.parquet(str(f)).toPandas()["traj_id"]) for f in files]
    assert sum(map(len, held)) == 60  # a trajectory is in one file


def test_slices_and_merges(spark):
    a, b = np.arange(12.0).reshape(6, 2), np.arange(8.0).reshape(4, 2)
    x = Fr.from_arrays(spark, [a, b])
    assert np.allclose(Fr.get_output(Fr.cuboid(x, [0, 1], 1, None, 2, [1]))[0], a[1:4:2, 1:2])
    assert np.allclose(Fr.get_output(Fr.jagged(x, [0], 1, None, 2))[0], a[1::2])
    assert [r.pos for r in Fr.linear(x).orderBy("pos").collect()] == list(range(10))
    m = Fr.merge_sources(x, x)
    assert np.allclose(Fr.get_output(m)[0], np.hstack([a, a]))
    with pytest.raises(ValueError):
        Fr.merge_sources(x, Fr.from_arrays(spark, [a]))
    with pytest.raises(ValueError):
        Fr.from_arrays(spark, [a, b[:, :1]])
    assert Fr.n_frames_total(x, 4, 1) == 3
    bad = Fr.from_arrays(spark, [np.array([1.0, np.nan])])
    with pytest.raises(Exception, match="NaN"):
        Fr.assert_finite(bad).collect()
    index = spark.createDataFrame([(0, 0, 5), (1, 1, 0), (2, 0, 5)], "pos int, traj_id int, t bigint")
    assert [r.x[0] for r in Fr.gather(x, index).orderBy("pos").collect()] == [10, 0, 10]
    assert Fr.out_of_range(x, spark.createDataFrame([(0, 1, 4)], "pos int, traj_id int, t bigint")).count() == 1


def test_samples(spark):
    index = D.state_index(Fr.from_dtrajs(spark, [[0, 1, 0, 1, 1], [1]]))
    got = rows(D.sample_by_state(index, 3, replace=False))
    assert sum(s == 0 for s, *_ in got) == 2 and sum(s == 1 for s, *_ in got) == 3
    assert len(set(got)) == len(got)
    assert [s for _, s, *_ in rows(D.sample_by_sequence(index, [1, 0, 1]))] == [1, 0, 1]
    assert D.sample_by_distributions(index, [np.array([0, 1.0])], 4).where("state = 1").count() == 4


def test_statistics(spark):
    rng = np.random.default_rng(3)
    xs = [rng.random(50), rng.random(20)]
    df = spark.createDataFrame([(i, t, float(v)) for i, x in enumerate(xs) for t, v in enumerate(x)], "traj_id int, t bigint, v double")
    mean = np.concatenate(xs).mean()
    zero = [x - mean for x in xs]
    want = [sum((x[: len(x) - k] * x[k:]).sum() for x in zero) / sum(len(x) - k for x in zero) for k in range(5)]
    got = [a for _, a in rows(S.acf(df, 4, normalize=False), "lag")]
    assert np.allclose(got, want)
    assert S.statistical_inefficiency(df, 30) == pytest.approx(statistical_inefficiency(xs), rel=1e-6)
    counts = [n for _, n in rows(S.histogram(df, 7), "bin")]
    assert counts == np.histogram(np.concatenate(xs), 7)[0].tolist()


def test_support():
    assert generate_lags(1000) == [1, 2, 3, 5, 8, 12, 18, 27, 41, 62, 93, 140, 210, 315, 473, 710, 1000]
    assert string_to_bytes("256m") == 256 << 20 and bytes_to_string(1536) == "1.5KiB"
    assert str(TimeUnit.parse("10 ns").scaled(5)) == "50 ns"
    assert TimeUnit.parse("1 ps").rescaled([2000.0, 4000.0])[1] == "ns"
    assert len(combinations(range(4), 2)) == 6 and len(product([1, 2], [3])) == 2
    lo, hi = confidence_interval(np.random.default_rng(0).normal(size=(4000, 2)), 0.95)
    assert np.allclose(lo, -1.96, atol=0.2) and np.allclose(hi, 1.96, atol=0.2)


def test_effective_counts(spark):
    from kinelake.operators.msm import MSM

    d = MSM(np.array([[0.95, 0.05], [0.1, 0.9]])).simulate(3000, seed=2)
    lag = 4
    df = Fr.from_dtrajs(spark, [d[:1800], d[1800:]])
    got = {(r.i, r.j): r.n for r in D.effective_counts(df, lag, block=64).collect()}
    for i in range(2):
        series = [x[lag:][x[:-lag] == i] for x in (d[:1800], d[1800:])]
        visits = sum(map(len, series))
        for j in range(2):
            x = [(s == j).astype(float) for s in series]
            p = sum(v.sum() for v in x) / visits
            total = 0.0
            for k in range(1, lag + 1):
                a = (sum((v[:-k] * v[k:]).sum() for v in x) / sum(len(v) - k for v in x) - p * p) / (p - p * p)
                if a <= 0:
                    break
                total += a * (1 - k / visits)
            assert got[i, j] == pytest.approx(p * visits / (1 + 2 * total))
            assert got[i, j] < p * visits


def test_grid_nearest(spark):
    rng = np.random.default_rng(0)
    pts = rng.random((400, 2))
    df = spark.createDataFrame([(float(x), float(y), float(k)) for k, (x, y) in enumerate(pts)], "x double, y double, z double")
    got = S.grid_nearest(df, 6)
    gx, gy = (np.linspace(pts[:, k].min(), pts[:, k].max(), 6) for k in (0, 1))
    want = [[float(((pts - [a, b]) ** 2).sum(1).argmin()) for b in gy] for a in gx]
    assert np.array_equal(got, want)


def test_api(spark):
    from kinelake import api

    assert all(callable(getattr(api, n)) for n in api.__all__)
    x = np.random.default_rng(0).normal(size=(200, 2)).cumsum(0)
    frames = api.source(spark, x)
    assert np.allclose(api.load(spark, x)[0], x)
    d = api.cluster_kmeans(frames, 4, 3).transform(frames)
    e = api.estimate_markov_model(d, 1)
    assert np.allclose(e.model.p.sum(1), 1)
    assert api.timescales_msm(d, [1, 2]).kept
    c = api.covariance_lagged(frames, 1, remove_mean=True)
    assert c.c00.shape == (2, 2)
    assert api.pipeline(frames, [api.pca(frames, 1), api.cluster_uniform_time(frames, 2)]).transform(frames).count() == 200
    assert api.histogram(frames, [0, 1], [4, 4]).agg({"n": "sum"}).first()[0] == 200
