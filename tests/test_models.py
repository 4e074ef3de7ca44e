"""Numerical models against brute force, analytic chains and golden values."""

import numpy as np
import pytest

from kinelake.functions import linalg as A
from kinelake.operators import clustering as C
from kinelake.operators import decomposition as L
from kinelake.operators import moments as M
from kinelake.operators import msm as K
from kinelake.operators.amm import AugmentedMSM
from kinelake.operators.hmm import BayesianHMSM, HMSMEstimator
from kinelake.operators.oom import OOMEstimator
from kinelake.operators.tpt import tpt
from kinelake.plans.pipeline import Discretizer, estimate_param_scan, param_grid
from kinelake.sources import datasets
from kinelake.sources import frames as Fr
from kinelake.sources import models as Store

FIVE = np.array([[0.8, 0.15, 0.05, 0, 0], [0.1, 0.75, 0.05, 0.05, 0.05], [0.05, 0.1, 0.8, 0, 0.05], [0, 0.2, 0, 0.8, 0], [0, 0.02, 0.02, 0, 0.96]])


def chain(p, n, seed=0, start=0):
    return K.MSM(p).simulate(n, start, seed=seed)


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(0)
    out = []
    for n in (400, 300):
        x = np.zeros((n, 3))
        for t in range(1, n):
            x[t] = [0.95, 0.6, 0.1] * x[t - 1] + rng.normal(size=3)
        out.append(x @ rng.normal(size=(3, 3)) + 5)
    return out


def test_moments(spark, series):
    df = Fr.from_arrays(spark, series)
    lag = 3
    x, y = np.vstack([s[:-lag] for s in series]), np.vstack([s[lag:] for s in series])
    m = M.moments_lagged(df, lag, block=50)
    assert m.w == len(x)
    assert np.allclose(m.xy, (x - x.mean(0)).T @ (y - y.mean(0)))
    assert np.allclose(m.raw().xx, x.T @ x)
    s = m.symmetrized().raw()
    assert np.allclose(s.xx, x.T @ x + y.T @ y) and np.allclose(s.xy, x.T @ y + y.T @ x)
    c = M.LaggedCovariance(lag, remove="data").fit(df)
    assert np.allclose(c.ctt, np.cov(y.T)) and np.allclose(c.mean, x.mean(0))
    both = M.LaggedCovariance(lag, remove="data").partial_fit(df.where("traj_id = 0")).partial_fit(df.where("traj_id = 1"))
    assert np.allclose(both.c0t, c.c0t)
    w = df.withColumn("w", (df.t % 3).cast("double"))
    ww = np.concatenate([np.arange(len(s)) % 3 for s in series])
    z = np.vstack(series)
    assert np.allclose(M.moments_xx(w, "w").raw().xx, (z * ww[:, None]).T @ z)
    const = M.LaggedCovariance(lag, remove=np.ones(3), reversible=True, bessel=False).fit(df)
    assert np.allclose(const.c00, ((x - 1).T @ (x - 1) + (y - 1).T @ (y - 1)) / (2 * len(x)))
    assert M.variable_columns(df) == [0, 1, 2]


def test_decompositions(spark, series):
    df = Fr.from_arrays(spark, series)
    z = np.vstack(series)
    pca = L.PCA(dim=2).fit(df)
    assert np.allclose(pca.eigenvalues, np.linalg.eigvalsh(np.cov(z.T))[::-1])
    assert pca.transform(df).count() == len(z)
    tica = L.TICA(1, kinetic_map=False).fit(df)
    assert abs(tica.eigenvalues[0] - 0.95) < 0.05
    out = np.vstack(Fr.get_output(L.TICA(1, dim=3, kinetic_map=False).fit(df).transform(df)))
    assert abs(np.corrcoef(out.T)[0, 1]) < 0.05
    vamp = L.VAMP(1).fit(df)
    assert vamp.score() == pytest.approx(1 + (vamp.singular_values**2).sum(), rel=1e-6)
    assert vamp.score(method="VAMP1") == pytest.approx(1 + vamp.singular_values.sum(), rel=1e-6)
    assert vamp.score(method="VAMPE") == pytest.approx(vamp.score(), rel=1e-6)
    ck = vamp.cktest(df, np.eye(3), np.eye(3), (1,))
    assert np.allclose(ck[0][1], ck[0][2])
    w = L.Koopman(1).fit(df).weights(df).agg({"w": "avg"}).first()[0]
    assert w == pytest.approx(1, abs=0.05)
    ny = L.NystroemTICA(1, 3, dim=3, initial_columns=[0]).fit(df)
    assert np.allclose(np.sort(np.abs(ny.eigenvalues))[::-1][0], np.abs(tica.eigenvalues[0]), atol=0.05)
    values, r = A.eig_corr(tica.cov, tica.cov_tau)
    assert np.allclose(tica.cov_tau @ r, tica.cov @ r * values)


def test_clustering(spark):
    rng = np.random.default_rng(42)
    x = np.concatenate([rng.normal(m, 0.1, 200) for m in (-2, 0, 2)])
    df = Fr.from_arrays(spark, [x])
    km = C.KMeans(3, 20, seed=1).fit(df)
    assert np.allclose(np.sort(km.centers.ravel()), [-2, 0, 2], atol=0.1) and km.converged
    again = C.KMeans(centers=km.centers, max_iter=2).fit(df)
    assert np.allclose(again.centers, km.centers)
    mb = C.MiniBatchKMeans(3, 10, 0.5, seed=1).fit(df)
    assert np.allclose(np.sort(mb.centers.ravel()), [-2, 0, 2], atol=0.2)
    rs = C.RegularSpace(0.5).fit(df)
    d = np.abs(rs.centers - rs.centers.T) + np.eye(len(rs.centers)) * 9
    assert d.min() > 0.5
    assert rs.transform(df).agg({"distance": "max"}).first()[0] <= 0.5
    assert C.RegularSpace(1e-6, max_centers=10).fit(df).truncated
    ut = C.UniformTime(4).fit(df)
    assert np.allclose(ut.centers.ravel(), x[[75, 225, 375, 525]])
    a, b = C.assign(df, km.centers), C.assign_sql(df, km.centers)
    assert a.join(b, ["traj_id", "t"]).where(a.state != b.state).count() == 0
    with pytest.raises(Exception, match="dimensions"):
        C.assign(df, np.zeros((2, 3))).collect()
    y = rng.random((4, 5, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    assert np.allclose(C.min_rmsd(y.reshape(4, -1), (y @ q + 3).reshape(4, -1)).diagonal(), 0, atol=1e-6)
    disc = Discretizer(cluster=C.KMeans(3, 5)).fit(df)
    assert disc.dtrajs(df).count() == 600
    scan = estimate_param_scan(C.KMeans, df, param_grid(k=[2, 3], max_iter=[2]), lambda e: len(e.centers))
    assert scan == [2, 3]


def test_estimation(spark):
    rng = np.random.default_rng(5)
    c = rng.integers(1, 50, (5, 5)).astype(float)
    p, pi = K.mle_reversible(c)
    x = pi[:, None] * p
    assert np.allclose(x, x.T) and np.allclose(p.sum(1), 1)
    for _ in range(50):  # no feasible change raises the likelihood
        y = x * np.exp(rng.normal(0, 0.01, x.shape))
        y = y + y.T
        assert (c * np.log(y / y.sum(1, keepdims=True))).sum() <= (c * np.log(p)).sum() + 1e-9
    fixed = K.mle_fixed_pi(c, pi)
    assert np.allclose(fixed, p, atol=1e-4)
    uniform = K.mle_fixed_pi(c, np.full(5, 0.2))
    assert np.allclose(np.full(5, 0.2) @ uniform, 0.2) and np.allclose(uniform, uniform.T)
    d = chain(FIVE, 20000)
    e = K.MSMEstimator(1).fit(Fr.from_dtrajs(spark, d))
    assert np.allclose(e.model.p, FIVE, atol=0.06)
    assert e.active_state_fraction == 1
    none = K.MSMEstimator(1, reversible=False).fit(Fr.from_dtrajs(spark, d))
    assert np.allclose(none.model.p, none.counts / none.counts.sum(1, keepdims=True))
    its = K.ImpliedTimescales([1, 2, 4]).fit(Fr.from_dtrajs(spark, d))
    assert its.kept == [1, 2, 4] and np.allclose(its.timescales[:, 0], its.timescales[0, 0], rtol=0.2)
    short = K.ImpliedTimescales(range(1, 9), reversible=False).fit(Fr.from_dtrajs(spark, [0, 1, 1, 1, 0]))
    assert short.kept == [1, 2]
    b = K.BayesianMSM(1, 20).fit(Fr.from_dtrajs(spark, d))
    lo, hi = b.sample_conf("p")
    assert (lo <= hi + 1e-12).all() and np.abs(b.sample_mean("p") - FIVE).max() < 0.1
    ck = e.cktest(Fr.from_dtrajs(spark, d), 2, (1, 2))
    assert np.allclose(ck[0]["predicted"], ck[0]["estimated"]) and np.allclose(ck[1]["predicted"], ck[1]["estimated"], atol=0.05)
    assert 1 <= e.score(Fr.from_dtrajs(spark, chain(FIVE, 5000, 1))) <= 5


def test_spectra_and_kinetics():
    m = K.MSM(FIVE)
    assert np.allclose(m.pi @ FIVE, m.pi)
    assert np.allclose(m.eigenvectors_left() @ m.eigenvectors_right(), np.eye(5))
    two = K.MSM(np.array([[0.9, 0.1], [0.1, 0.9]]))
    assert np.allclose(two.timescales(), -1 / np.log(0.8))
    assert two.mfpt([0], [1]) == pytest.approx(10)
    a = np.array([0.0, 1])
    t, c = two.correlation(a, maxtime=5)
    assert np.allclose(c, 0.25 + 0.25 * 0.8**t)
    _, r = two.relaxation([1, 0], a, maxtime=4)
    assert np.allclose(r, 0.5 - 0.5 * 0.8 ** np.arange(5))
    assert np.allclose(two.propagate([1, 0], 3), [1, 0] @ np.linalg.matrix_power(two.p, 3))
    blocks = np.array([[0.95, 0.05, 0, 0], [0.05, 0.94, 0.01, 0], [0, 0.01, 0.94, 0.05], [0, 0, 0.05, 0.95]])
    sets = K.MSM(blocks).pcca(2)
    assert sorted(tuple(s) for s in sets.sets) == [(0, 1), (2, 3)]
    assert np.allclose(sets.memberships.sum(1), 1) and np.allclose(sets.coarse_transition_matrix.sum(1), 1)


def test_golden_flux():
    f = tpt(K.MSM(FIVE), [0], [4])
    assert np.allclose(f.qplus, [0, 0.35714286, 0.42857143, 0.35714286, 1])
    assert np.allclose(f.qminus, [1, 0.65384615, 0.53125, 0.65384615, 0])
    assert f.total_flux == pytest.approx(0.0108050847458)
    assert f.rate == pytest.approx(0.0272727272727) and f.mfpt == pytest.approx(36.6666666667)
    paths, c = f.pathways()
    assert [p.tolist() for p in paths] == [[0, 1, 4], [0, 2, 4], [0, 1, 2, 4]]
    assert np.allclose(c, [0.00720338983051, 0.00308716707022, 0.000514527845036])
    parts, cg = f.coarse_grain([[0], [1, 2, 3], [4]])
    assert [p.tolist() for p in parts] == [[0], [1, 2, 3], [4]] and cg.total_flux == pytest.approx(f.total_flux)


def test_hidden_models(spark):
    p, b = np.array([[0.98, 0.02], [0.03, 0.97]]), np.array([[0.85, 0.1, 0.05], [0.05, 0.1, 0.85]])
    from kinelake.operators.hmm import HMSM, forward_backward

    true = HMSM(p, b)
    _, obs = true.simulate(8000, seed=1)
    est = HMSMEstimator(2, 1, accuracy=1e-2, maxit=60).fit(Fr.from_dtrajs(spark, [obs[:4000], obs[4000:]]))
    order = np.argsort(-est.model.pobs[:, 0])
    assert np.allclose(est.model.p[np.ix_(order, order)], p, atol=0.03)
    assert np.allclose(est.model.pobs[order], b, atol=0.06)
    assert np.all(np.diff(est.likelihoods) > -1e-6)
    assert np.allclose(est.model.transition_matrix_obs().sum(1), 1) and np.allclose(est.model.metastable_memberships.sum(1), 1)
    ll, gamma, c = forward_backward(p, b, np.array([0.5, 0.5]), np.array([0, 2, 1]))
    total = 0.0
    for path in np.ndindex(2, 2, 2):
        total += 0.5 * b[path[0], 0] * p[path[0], path[1]] * b[path[1], 2] * p[path[1], path[2]] * b[path[2], 1]
    assert ll == pytest.approx(np.log(total)) and np.allclose(c.sum(), 2)
    bayes = BayesianHMSM(2, 1, 2, stride=1).fit(Fr.from_dtrajs(spark, obs[:2000]))
    assert bayes.sample_mean("p").shape == (2, 2)


def test_hidden_sequences_end_at_gaps(spark):
    from kinelake.operators.hmm import sequences

    frames = [(0, t, s) for t, s in enumerate([0, -1, -1, 1, 1])] + [(1, t, s) for t, s in ((0, 2), (1, 3), (5, 2), (6, 0))]
    df = spark.createDataFrame(frames, "traj_id long, t long, state int")
    got = sequences(df, 1).collect()
    assert sorted(r.states for r in got) == [[0], [1, 1], [2, 0], [2, 3]]
    assert len({(r.traj_id, r.phase) for r in got}) == len(got)
    assert sorted(r.states for r in sequences(df, 2).collect()) == [[0], [0], [1], [1], [2], [2], [3]]


def test_oom_and_augmented(spark):
    rng = np.random.default_rng(0)
    starts = [K.MSM(FIVE).simulate(40, int(s), seed=k) for k, s in enumerate(rng.choice(5, 300, p=[0.6, 0.1, 0.1, 0.1, 0.1]))]
    df = Fr.from_dtrajs(spark, starts)
    m = OOMEstimator(1, nbs=50, tol_rank=3).fit(df).model
    assert np.allclose(m.p.sum(1), 1) and np.abs(m.pi - K.MSM(FIVE).pi[m.active] / K.MSM(FIVE).pi[m.active].sum()).max() < 0.2
    e = np.array([[0.0], [0], [0], [0], [1]])
    base = K.MSMEstimator(1).fit(df)
    target = base.model.pi[4] * 1.1
    a = AugmentedMSM(1, e, np.array([target]), np.array([0.002]), maxiter=20).fit_msm(base)
    assert abs(a.expectations[0] - target) < abs(base.model.pi[4] - target)


def test_store(spark, tmp_path):
    m = K.MSM(FIVE, dt="10 ps")
    Store.save_model(m, str(tmp_path), "five")
    back = Store.load_model(str(tmp_path), "five")
    assert np.allclose(back.p, FIVE) and str(back.dt) == "10 ps" and np.allclose(back.eigenvalues(), m.eigenvalues())
    with pytest.raises(FileExistsError):
        Store.save_model(m, str(tmp_path), "five")
    Store.rename_model(str(tmp_path), "five", "six")
    assert list(Store.list_models(str(tmp_path))) == ["six"] and Store.main([str(tmp_path)]) == 0
    pca = L.PCA(dim=1).fit(Fr.from_arrays(spark, np.random.default_rng(0).random((20, 2))))
    Store.save_model(pca, str(tmp_path), "pca")
    assert np.allclose(Store.load_model(str(tmp_path), "pca").eigenvectors, pca.eigenvectors)
    Store.delete_model(str(tmp_path), "six")
    assert list(Store.list_models(str(tmp_path))) == ["pca"]


def test_datasets(spark):
    p, pi = datasets.double_well_matrix()
    assert np.allclose(pi @ p, pi)
    d = datasets.two_well_discrete(spark, 2, 500)
    assert d.count() == 1000 and d.collect() == datasets.two_well_discrete(spark, 2, 500).collect()
    us, centers, forces, md = datasets.umbrella_sampling(spark, 3, us_length=50, md_length=20, nmd=2)
    assert us.count() == 150 and md.count() == 40 and len(centers) == len(forces) == 3
    assert datasets.multi_temperature(spark, length0=30, length1=30, n0=1, n1=1).select("temp").distinct().count() == 2
    assert datasets.quadwell(spark, 1, 50).count() == 50


def test_seeds_see_every_frame(spark):
    """A far cluster of 5 in 20,005 frames gets a centre."""
    from kinelake.operators.clustering import KMeans, MiniBatchKMeans

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(20000, 2)) + [[0.0, 0.0], [10.0, 0.0]] * 10000, rng.normal(size=(5, 2)) + 1000])
    frames = spark.createDataFrame([(0, i, v) for i, v in enumerate(x.tolist())], "traj_id long, t long, x array<double>").repartition(4).persist()
    for kind in (KMeans, MiniBatchKMeans):
        for seed in range(2):
            m = kind(3, max_iter=3, seed=seed).fit(frames)
            assert np.linalg.norm(m.centers - 1000, axis=1).min() < 5
    assert len(np.unique(KMeans(3, max_iter=0).fit(frames).centers, axis=0)) == 3
    same = spark.createDataFrame([(0, t, [1.0]) for t in range(4)], "traj_id long, t long, x array<double>")
    assert KMeans(2).fit(same).centers.tolist() == [[1.0], [1.0]]
    frames.unpersist()


def test_log_sums():
    rng = np.random.default_rng(0)
    for x in (rng.normal(0, 300, 50), np.array([1000.0, 1000.0]), np.array([-np.inf, 3.0]), np.array([-np.inf])):
        want = A.logsumexp(x)
        assert A.logsumexp_kahan(x) == pytest.approx(want) and A.logsumexp_sorted(x) == pytest.approx(want) and A.logsumexp_sorted(x, kahan=True) == pytest.approx(want)
    assert A.logsumexp_kahan([]) == -np.inf == A.logsumexp_sorted([])


def test_parameters_and_samples():
    from kinelake.operators.base import Sampled

    k = C.KMeans(3, max_iter=4)
    assert k.get_params()["k"] == 3 and k.set_params(max_iter=7).max_iter == 7
    with pytest.raises(ValueError):
        k.set_params(clusters=2)

    class Draws(Sampled):
        conf = 0.95
        models = [K.MSM(np.array([[1 - a, a], [0.5, 0.5]])) for a in (0.2, 0.3, 0.4)]

    d = Draws()
    assert d.sample_f("nstates").tolist() == [2, 2, 2]
    assert d.sample_mean("mfpt", 0, 1) == pytest.approx(np.mean([5, 10 / 3, 2.5]))
    assert d.sample_std(lambda m: m.p[0, 1]) == pytest.approx(np.std([0.2, 0.3, 0.4]))


def test_hash_chunks_layout():
    from kinelake.functions.support import array_hash, n_chunks
    from kinelake.operators.tpt import network_layout

    x = np.arange(6.0)
    assert array_hash(x) == array_hash(x.copy()) and len({array_hash(y) for y in (x, x.reshape(2, 3), x.astype(int), x[::-1])}) == 4
    assert [n_chunks(10, 3), n_chunks(10, 3, 2), n_chunks(10, 0), n_chunks(3, 5, 1, 4), n_chunks(10, 5, 1, 5)] == [4, 2, 1, 0, 1]
    ring = np.eye(6)[:, [1, 2, 3, 4, 5, 0]] * 0.5 + np.eye(6)[:, [5, 0, 1, 2, 3, 4]] * 0.5
    at = network_layout(ring)
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(-1))
    assert at.min() >= 0 and at.max() <= 1 and np.mean([d[i, (i + 1) % 6] for i in range(6)]) < np.mean([d[i, (i + 3) % 6] for i in range(6)])


def test_info_cache(spark, tmp_path):
    from kinelake.sources.info_cache import TrajectoryInfoCache

    names = [str(tmp_path / f"x{i}.npy") for i in range(3)]
    for i, n in enumerate(names):
        np.save(n, np.zeros((5 + i, 2 + i)))
    reads = []

    def read(session, paths):
        reads.append(len(paths))
        return Fr.source(session, paths)

    cache = TrajectoryInfoCache(str(tmp_path / "info.db"))
    assert cache.get(spark, names, read) == [(5, 2), (6, 3), (7, 4)] == cache.get(spark, names, read)
    np.save(names[1], np.zeros((9, 3)))
    assert TrajectoryInfoCache(str(tmp_path / "info.db")).get(spark, names[::-1], read) == [(7, 4), (9, 3), (5, 2)]
    assert reads == [3, 1]
    small = TrajectoryInfoCache(max_entries=2)
    small.get(spark, names)
    assert len(small) == 2


def test_expected_counts_of_many_sequences():
    """Sequences that take their steps together count as one by one, whatever their lengths."""
    from kinelake.operators.hmm import expected_counts, forward_backward

    rng = np.random.default_rng(6)
    p, b, start = (rng.dirichlet(np.ones(n), size) for n, size in ((3, 3), (4, 3), (3, None)))
    seqs = [rng.integers(0, 4, n) for n in (1, 7, 0, 2, 200, 7, 1)]
    got = expected_counts(p, b, start, np.concatenate(seqs), np.cumsum([len(s) for s in seqs]))
    one = [(s, *forward_backward(p, b, start, s)) for s in seqs if len(s)]
    emit = np.zeros((3, 4))
    for s, _, gamma, _ in one:
        np.add.at(emit.T, s, gamma)
    want = (sum(x[1] for x in one), sum(x[2][0] for x in one), sum(x[3] for x in one), emit)
    assert all(np.allclose(x, y, rtol=1e-12) for x, y in zip(got, want, strict=True))
    assert expected_counts(p, b, start, seqs[0][:0], np.zeros(2, np.int64))[0] == 0
