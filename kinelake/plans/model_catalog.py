"""Queries of models and features, each with SQL that solves the same equations by another way.

Small linear problems are solved in SQL by iteration in recursive common table expressions (reversible estimates, stationary
vectors, committors, passage times, reweighting), or in closed form where a problem has two states or dimensions.
Features come out of the operators in 32 bits, and so does their SQL.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.functions.features import Featurizer
from kinelake.operators import clustering as C
from kinelake.operators import decomposition as L
from kinelake.operators import dtrajs as D
from kinelake.operators import msm as K
from kinelake.operators import thermo as T
from kinelake.operators.tpt import ReactiveFlux
from kinelake.plans.catalog import CENTERS, F_SQL, S_SQL, events, long_table, register, rounded, samples, states, value_frames
from kinelake.session import table

# Markov models: counts at lag 1, the non-reversible matrix, and the reversible one by the fixed point
# x_i = sum_j (c_ij + c_ji) / (c_i / x_i + c_j / x_j)

C_SQL = f"""{F_SQL}, l AS (SELECT s, lead(s, 1) OVER (PARTITION BY traj_id ORDER BY t) AS s2 FROM f),
c AS (SELECT s AS i, s2 AS j, CAST(count(*) AS DOUBLE) AS n FROM l WHERE s2 IS NOT NULL GROUP BY 1, 2), ci AS (SELECT i, sum(n) AS n FROM c GROUP BY i)"""
NONREV = C_SQL + ", p AS (SELECT c.i, c.j, c.n / ci.n AS p FROM c JOIN ci ON c.i = ci.i)"
REV = C_SQL + """, y AS (SELECT i, j, sum(n) AS n FROM (SELECT i, j, n FROM c UNION ALL SELECT j AS i, i AS j, n FROM c) GROUP BY 1, 2),
it(step, i, x) AS (SELECT 0, i, sum(n) FROM y GROUP BY i UNION ALL
  SELECT a.step + 1, a.i, sum(y.n / (ca.n / a.x + cb.n / b.x)) FROM it a JOIN y ON y.i = a.i JOIN it b ON b.i = y.j JOIN ci ca ON ca.i = a.i JOIN ci cb ON cb.i = b.i WHERE a.step < 300 GROUP BY 1, 2),
x AS (SELECT i, x FROM it WHERE step = 300),
xx AS (SELECT y.i, y.j, y.n / (ca.n / a.x + cb.n / b.x) AS x FROM y JOIN x a ON a.i = y.i JOIN x b ON b.i = y.j JOIN ci ca ON ca.i = y.i JOIN ci cb ON cb.i = y.j),
p AS (SELECT i, j, x / sum(x) OVER (PARTITION BY i) AS p FROM xx), pi AS (SELECT i, sum(x) / (SELECT sum(x) FROM xx) AS pi FROM xx GROUP BY i)"""
#: Forward committor from state 0 to state 4 and passage times to state 4, by iteration.
QPLUS = REV + """, q(step, i, q) AS (SELECT 0, i, CAST(i = 4 AS DOUBLE) FROM pi UNION ALL
  SELECT q.step + 1, p.i, CASE WHEN p.i = 0 THEN 0 WHEN p.i = 4 THEN 1 ELSE sum(p.p * q.q) END FROM q JOIN p ON p.j = q.i WHERE q.step < 300 GROUP BY 1, 2), qp AS (SELECT i, q FROM q WHERE step = 300)"""
FLUX = QPLUS + """, g AS (SELECT p.i, p.j, pi.pi * (1 - a.q) * p.p * b.q AS f FROM p JOIN pi ON pi.i = p.i JOIN qp a ON a.i = p.i JOIN qp b ON b.i = p.j WHERE p.i <> p.j),
net AS (SELECT a.i, a.j, a.f - b.f AS flux FROM g a JOIN g b ON a.i = b.j AND a.j = b.i WHERE a.f > b.f)"""
PASSAGE = REV + """, m(step, i, m) AS (SELECT 0, i, CAST(0 AS DOUBLE) FROM pi UNION ALL SELECT m.step + 1, p.i, CASE WHEN p.i = 4 THEN 0 ELSE 1 + sum(p.p * m.m) END FROM m JOIN p ON p.j = m.i WHERE m.step < 1500 GROUP BY 1, 2)"""
#: Powers of the reversible matrix applied to the observable i * i.
POWERS = REV + """, o(step, i, v) AS (SELECT 0, i, CAST(i * i AS DOUBLE) FROM pi UNION ALL SELECT o.step + 1, p.i, sum(p.p * o.v) FROM o JOIN p ON p.j = o.i WHERE o.step < 6 GROUP BY 1, 2)"""
STEPS = 6


def _model(spark, d, reversible: bool = True) -> K.MSM:
    e = K.MSMEstimator(1, reversible).fit(states(spark, d))
    assert e.active.tolist() == [0, 1, 2, 3, 4]
    return e.model


def _vector(spark, v, name: str, digits: int = 7) -> DataFrame:
    return long_table(spark, [(i, float(x)) for i, x in enumerate(v)], f"i int, {name} double").withColumn(name, rounded(name, digits))


@register(f"WITH RECURSIVE {REV} SELECT i, j, round(p, 7) AS p FROM p")
def msm_reversible(spark, d):
    m = _model(spark, d)
    return long_table(spark, [(i, j, float(m.p[i, j])) for i in range(5) for j in range(5)], "i int, j int, p double").withColumn("p", rounded("p", 7))


@register(f"WITH RECURSIVE {REV} SELECT i, round(pi, 8) AS pi FROM pi")
def msm_stationary(spark, d):
    return _vector(spark, _model(spark, d).pi, "pi", 8)


@register(f"WITH {NONREV} SELECT i, j, round(p, 9) AS p FROM p")
def msm_nonreversible_matrix(spark, d):
    m = _model(spark, d, False)
    return long_table(spark, [(i, j, float(m.p[i, j])) for i in range(5) for j in range(5)], "i int, j int, p double").withColumn("p", rounded("p", 9))


@register(f"WITH RECURSIVE {NONREV}, r(step, i, w) AS (SELECT 0, i, CAST(0.2 AS DOUBLE) FROM ci UNION ALL SELECT r.step + 1, p.j, sum(r.w * p.p) FROM r JOIN p ON p.i = r.i WHERE r.step < 300 GROUP BY 1, 2) SELECT i, round(w, 8) AS pi FROM r WHERE step = 300")
def msm_nonreversible_stationary(spark, d):
    return _vector(spark, _model(spark, d, False).pi, "pi", 8)


@register(f"WITH RECURSIVE {REV} SELECT round(sum(pi * i * i), 6) AS expectation FROM pi")
def msm_expectation(spark, d):
    m = _model(spark, d)
    return long_table(spark, [(m.expectation(np.arange(5.0) ** 2),)], "expectation double").select(rounded("expectation", 6).alias("expectation"))


@register(f"WITH RECURSIVE {POWERS} SELECT CAST(step AS INTEGER) AS step, round(sum(pi.pi * o.i * o.v), 6) AS correlation FROM o JOIN pi ON pi.i = o.i GROUP BY 1")
def msm_correlation(spark, d):
    a = np.arange(5.0)
    t, c = _model(spark, d).correlation(a, a**2, maxtime=STEPS)
    return long_table(spark, [(int(x), float(y)) for x, y in zip(t, c, strict=True)], "step int, correlation double").withColumn("correlation", rounded("correlation", 6))


@register(f"WITH RECURSIVE {POWERS} SELECT CAST(step AS INTEGER) AS step, round(v, 6) AS relaxation FROM o WHERE i = 2")
def msm_relaxation(spark, d):
    t, c = _model(spark, d).relaxation(np.eye(5)[2], np.arange(5.0) ** 2, maxtime=STEPS)
    return long_table(spark, [(int(x), float(y)) for x, y in zip(t, c, strict=True)], "step int, relaxation double").withColumn("relaxation", rounded("relaxation", 6))


@register(f"WITH RECURSIVE {REV}, r(step, i, w) AS (SELECT 0, i, CAST(i = 3 AS DOUBLE) FROM pi UNION ALL SELECT r.step + 1, p.j, sum(r.w * p.p) FROM r JOIN p ON p.i = r.i WHERE r.step < 3 GROUP BY 1, 2) SELECT i, round(w, 7) AS w FROM r WHERE step = 3")
def msm_propagate(spark, d):
    return _vector(spark, _model(spark, d).propagate(np.eye(5)[3], 3), "w")


@register(f"WITH RECURSIVE {PASSAGE} SELECT i, round(m, 5) AS mfpt FROM m WHERE step = 1500")
def msm_mfpt(spark, d):
    m = _model(spark, d)
    return _vector(spark, [m.mfpt(i, 4) for i in range(5)], "mfpt", 5)


@register(f"WITH RECURSIVE {QPLUS} SELECT i, round(q, 7) AS q FROM qp")
def committor_forward(spark, d):
    return _vector(spark, _model(spark, d).committor_forward(0, 4), "q")


@register(f"WITH RECURSIVE {QPLUS} SELECT i, round(1 - q, 7) AS q FROM qp")
def committor_backward(spark, d):
    return _vector(spark, _model(spark, d).committor_backward(0, 4), "q")


@register(f"WITH RECURSIVE {FLUX} SELECT i, j, round(flux, 8) AS flux FROM net WHERE flux > 1e-7")
def reactive_flux(spark, d):
    return ReactiveFlux(_model(spark, d), [0], [4]).edges(spark, 1e-7).withColumn("flux", rounded("flux", 8))


@register(f"WITH RECURSIVE {FLUX}, t AS (SELECT sum(flux) AS f FROM net WHERE i = 0), b AS (SELECT sum(pi.pi * (1 - qp.q)) AS w FROM pi JOIN qp ON pi.i = qp.i) SELECT round(f, 7) AS flux, round(f / w, 6) AS rate, round(w / f, 5) AS mfpt FROM t, b")
def flux_totals(spark, d):
    r = ReactiveFlux(_model(spark, d), [0], [4])
    return long_table(spark, [(r.total_flux, r.rate, r.mfpt)], "flux double, rate double, mfpt double").select(rounded("flux", 7).alias("flux"), rounded("rate", 6).alias("rate"), rounded("mfpt", 5).alias("mfpt"))


@register(f"""WITH RECURSIVE {FLUX}, w AS (SELECT i, CASE i WHEN 0 THEN 0 WHEN 4 THEN 2 ELSE 1 END AS s FROM pi), e AS (SELECT a.s AS i, b.s AS j, sum(flux) AS f FROM net JOIN w a ON a.i = net.i JOIN w b ON b.i = net.j WHERE a.s <> b.s GROUP BY 1, 2)
SELECT a.i, a.j, round(a.f - coalesce(b.f, 0), 7) AS flux FROM e a LEFT JOIN e b ON a.i = b.j AND a.j = b.i WHERE a.f > coalesce(b.f, 0)""")
def flux_coarse_grained(spark, d):
    """The flux between {0}, {4} and the states between, lumped."""
    _, r = ReactiveFlux(_model(spark, d), [0], [4]).coarse_grain([[1, 2, 3]])
    return r.edges(spark).withColumn("flux", rounded("flux", 7))


_SCORE = f"WITH {C_SQL}, cj AS (SELECT j, sum(n) AS n FROM c GROUP BY j) SELECT round(sum(c.n * c.n / (ci.n * cj.n)), 7) AS score FROM c JOIN ci ON c.i = ci.i JOIN cj ON c.j = cj.j"


def _score(spark, d, method: str) -> DataFrame:
    s = states(spark, d)
    return long_table(spark, [(K.MSMEstimator(1).fit(s).score(s, method, None),)], "score double").select(rounded("score", 7).alias("score"))


@register(_SCORE)
def msm_vamp2_score(spark, d):
    return _score(spark, d, "VAMP2")


@register(_SCORE)
def msm_vampe_score(spark, d):
    """On its own training data the VAMP-E score is the VAMP-2 score."""
    return _score(spark, d, "VAMPE")


# Two states: values above 20 or not, where spectra have closed forms


def _two(spark, d) -> DataFrame:
    return events(spark, d).select("traj_id", "t", F.when(F.col("value") > 20, 1).otherwise(0).alias("state"))


LAGS = (1, 2, 3)
TWO = F_SQL + ", b AS (SELECT traj_id, t, CASE WHEN v > 20 THEN 1 ELSE 0 END AS k FROM f), " + ", ".join(
    f"l{n} AS (SELECT {n} AS lag, k, lead(k, {n}) OVER (PARTITION BY traj_id ORDER BY t) AS k2 FROM b)" for n in LAGS
) + ", c2 AS (SELECT lag, k AS i, k2 AS j, CAST(count(*) AS DOUBLE) AS n FROM (" + " UNION ALL ".join(f"SELECT * FROM l{n}" for n in LAGS) + """) WHERE k2 IS NOT NULL GROUP BY 1, 2, 3),
p2 AS (SELECT lag, i, j, n / sum(n) OVER (PARTITION BY lag, i) AS p FROM c2), ev AS (SELECT lag, sum(p) - 1 AS ev FROM p2 WHERE i = j GROUP BY 1),
pi2 AS (SELECT i, p / sum(p) OVER () AS pi FROM (SELECT 1 - i AS i, p FROM p2 WHERE lag = 1 AND i <> j))"""


@register(f"WITH {TWO} SELECT CAST(lag AS INTEGER) AS lag, round(-lag / ln(abs(ev)), 6) AS timescale FROM ev")
def implied_timescales_two_state(spark, d):
    return K.ImpliedTimescales(list(LAGS)).fit(_two(spark, d)).table(spark).select("lag", rounded("value", 6).alias("timescale"))


@register(f"WITH {TWO} SELECT CAST(k AS INTEGER) AS k, round(CASE k WHEN 0 THEN CAST(1 AS DOUBLE) ELSE ev END, 8) AS eigenvalue FROM ev, (SELECT unnest([0, 1]) AS k) WHERE lag = 1")
def eigenvalues_two_state(spark, d):
    e = K.MSMEstimator(1).fit(_two(spark, d)).model.eigenvalues()
    return long_table(spark, [(k, float(v)) for k, v in enumerate(e)], "k int, eigenvalue double").withColumn("eigenvalue", rounded("eigenvalue", 8))


@register(f"WITH {TWO} SELECT i, round(pi, 8) AS left0, CAST(1 AS DOUBLE) AS right0, round(sqrt(pi * (1 - pi)), 8) AS left1, round(sqrt((1 - pi) / pi), 8) AS right1 FROM pi2")
def eigenvectors_two_state(spark, d):
    """The second vectors up to their sign."""
    m = K.MSMEstimator(1).fit(_two(spark, d)).model
    left, right = m.eigenvectors_left(), m.eigenvectors_right()
    rows = [(i, float(left[0, i]), float(right[i, 0]), float(abs(left[1, i])), float(abs(right[i, 1]))) for i in range(2)]
    return long_table(spark, rows, "i int, left0 double, right0 double, left1 double, right1 double").select("i", *[rounded(c, 8).alias(c) for c in ("left0", "right0", "left1", "right1")])


@register(f"WITH {TWO}, e AS (SELECT sum(pi * i) AS m FROM pi2) SELECT CAST(k AS INTEGER) AS k, round(CASE k WHEN 0 THEN m * m ELSE m - m * m END, 8) AS amplitude FROM e, (SELECT unnest([0, 1]) AS k)")
def fingerprint_correlation_two_state(spark, d):
    _, a = K.MSMEstimator(1).fit(_two(spark, d)).model.fingerprint_correlation(np.arange(2.0))
    return long_table(spark, [(k, float(v)) for k, v in enumerate(a)], "k int, amplitude double").withColumn("amplitude", rounded("amplitude", 8))


@register(f"WITH {TWO}, e AS (SELECT sum(pi * i) AS m FROM pi2) SELECT CAST(k AS INTEGER) AS k, round(CASE k WHEN 0 THEN m ELSE -m END, 8) AS amplitude FROM e, (SELECT unnest([0, 1]) AS k)")
def fingerprint_relaxation_two_state(spark, d):
    _, a = K.MSMEstimator(1).fit(_two(spark, d)).model.fingerprint_relaxation(np.array([1.0, 0.0]), np.arange(2.0))
    return long_table(spark, [(k, float(v)) for k, v in enumerate(a)], "k int, amplitude double").withColumn("amplitude", rounded("amplitude", 8))


@register(f"""WITH RECURSIVE {TWO}, w(k, i, j, p) AS (SELECT 1, i, j, p FROM p2 WHERE lag = 1 UNION ALL SELECT w.k + 1, w.i, p2.j, sum(w.p * p2.p) FROM w JOIN p2 ON p2.i = w.j AND p2.lag = 1 WHERE w.k < 3 GROUP BY 1, 2, 3)
SELECT CAST(w.k AS INTEGER) AS k, w.i, w.j, round(w.p, 8) AS predicted, round(p2.p, 8) AS estimated FROM w JOIN p2 ON p2.lag = w.k AND p2.i = w.i AND p2.j = w.j""")
def chapman_kolmogorov_two_state(spark, d):
    s = _two(spark, d)
    rows = [(r["k"], i, j, float(r["predicted"][i, j]), float(r["estimated"][i, j])) for r in K.MSMEstimator(1).fit(s).cktest(s, 2, LAGS, np.eye(2)) for i in range(2) for j in range(2)]
    return long_table(spark, rows, "k int, i int, j int, predicted double, estimated double").select("k", "i", "j", rounded("predicted", 8).alias("predicted"), rounded("estimated", 8).alias("estimated"))


@register(f"WITH {TWO}, o AS (SELECT ev FROM ev WHERE lag = 1) SELECT CAST(lag AS INTEGER) AS k, round(o.ev ** lag, 8) AS predicted, round(ev.ev, 8) AS estimated FROM ev, o")
def eigenvalue_decay_two_state(spark, d):
    s = _two(spark, d)
    rows = [(r["k"], float(r["predicted"][0]), float(r["estimated"][0])) for r in K.MSMEstimator(1).fit(s).eigenvalue_decay(s, 1, LAGS)]
    return long_table(spark, rows, "k int, predicted double, estimated double").select("k", rounded("predicted", 8).alias("predicted"), rounded("estimated", 8).alias("estimated"))


# Decompositions of one and two dimensions

PAIRS = f"{F_SQL}, q AS (SELECT v AS x, lead(v, 1) OVER (PARTITION BY traj_id ORDER BY t) AS y FROM f), r AS (SELECT x, y FROM q WHERE y IS NOT NULL)"


def _plane(spark, d) -> DataFrame:
    return events(spark, d).select("traj_id", "t", F.array(F.col("value") / 10, F.col("state").cast("double")).alias("x"))


@register(f"""WITH {F_SQL}, m AS (SELECT var_samp(v / 10) AS a, var_samp(CAST(s AS DOUBLE)) AS b, covar_samp(v / 10, CAST(s AS DOUBLE)) AS c FROM f), e AS (SELECT (a + b) / 2 AS h, sqrt((a - b) * (a - b) / 4 + c * c) AS r FROM m)
SELECT CAST(k AS INTEGER) AS k, round(h + (1 - 2 * k) * r, 7) AS eigenvalue, round(CASE k WHEN 0 THEN (h + r) / (2 * h) ELSE 1 END, 8) AS cumvar FROM e, (SELECT unnest([0, 1]) AS k)""")
def pca_spectrum(spark, d):
    m = L.PCA(dim=2).fit(_plane(spark, d))
    rows = [(k, float(m.eigenvalues[k]), float(m.cumvar[k])) for k in range(2)]
    return long_table(spark, rows, "k int, eigenvalue double, cumvar double").select("k", rounded("eigenvalue", 7).alias("eigenvalue"), rounded("cumvar", 8).alias("cumvar"))


@register(f"""WITH {F_SQL}, m AS (SELECT avg(v / 10) AS mv, avg(CAST(s AS DOUBLE)) AS ms, var_samp(v / 10) AS a, var_samp(CAST(s AS DOUBLE)) AS b, covar_samp(v / 10, CAST(s AS DOUBLE)) AS c FROM f), e AS (SELECT *, (a + b) / 2 + sqrt((a - b) * (a - b) / 4 + c * c) AS ev FROM m)
SELECT traj_id, t, round(abs((v / 10 - mv) * c + (s - ms) * (ev - a)) / sqrt(c * c + (ev - a) * (ev - a)), 6) AS y FROM f, e""")
def pca_first_component(spark, d):
    """Distances from the mean along the first axis (without the axis' sign)."""
    f = _plane(spark, d)
    return L.PCA(dim=1).fit(f).transform(f).select("traj_id", "t", rounded(F.abs(F.get(F.col("x").cast("array<double>"), F.lit(0))), 6).alias("y"))


_TICA = f"WITH {PAIRS}, m AS (SELECT (avg(x) + avg(y)) / 2 AS m FROM r), e AS (SELECT 2 * sum((x - m) * (y - m)) / sum((x - m) * (x - m) + (y - m) * (y - m)) AS ev FROM r, m) "


@register(_TICA + "SELECT round(ev, 8) AS eigenvalue, round(-1 / ln(abs(ev)), 6) AS timescale FROM e")
def tica_spectrum(spark, d):
    m = L.TICA(lag=1, dim=1).fit(value_frames(spark, d))
    return long_table(spark, [(float(np.real(m.eigenvalues[0])), float(np.real(m.timescales[0])))], "eigenvalue double, timescale double").select(rounded("eigenvalue", 8).alias("eigenvalue"), rounded("timescale", 6).alias("timescale"))


@register(_TICA.replace("e AS (SELECT", "sd AS (SELECT m, sqrt(avg((x - m) * (x - m) + (y - m) * (y - m)) / 2) AS sd FROM r, m GROUP BY m), e AS (SELECT") + "SELECT traj_id, t, round(abs(v - m) / sd, 6) AS y FROM f, sd")
def tica_component(spark, d):
    """The one component of a scalar: its distance from the mean in standard deviations."""
    f = value_frames(spark, d)
    return L.TICA(lag=1, dim=1, kinetic_map=False).fit(f).transform(f).select("traj_id", "t", rounded(F.abs(F.get(F.col("x").cast("array<double>"), F.lit(0))), 6).alias("y"))


@register(f"WITH {PAIRS} SELECT round(abs(corr(x, y)), 8) AS singular_value, round(1 + corr(x, y) * corr(x, y), 7) AS vamp2 FROM r")
def vamp_spectrum(spark, d):
    m = L.VAMP(lag=1, dim=1).fit(value_frames(spark, d))
    return long_table(spark, [(float(m.singular_values[0]), float(m.score()))], "singular_value double, vamp2 double").select(rounded("singular_value", 8).alias("singular_value"), rounded("vamp2", 7).alias("vamp2"))


# Draws: a key's first 15 hex digits of its MD5


def _key(*parts: str, seed: int = 42) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)})), 1, 15) AS BIGINT)"


INDEX = F_SQL + ", x AS (SELECT s AS state, traj_id, t, row_number() OVER (PARTITION BY s ORDER BY traj_id, t) - 1 AS rank FROM f), n AS (SELECT state, count(*) AS size FROM x GROUP BY 1)"


@register(f"WITH {INDEX}, w AS (SELECT n.state, CAST(d.d AS INTEGER) AS draw, {_key('n.state', 'd.d')} % size AS rank FROM n, range(10) AS d(d)) SELECT w.state, draw, traj_id, t FROM w JOIN x ON x.state = w.state AND x.rank = w.rank")
def sample_by_state(spark, d):
    return D.sample_by_state(D.state_index(states(spark, d)), 10)


@register(f"WITH {INDEX}, w AS (SELECT state, CAST(row_number() OVER (PARTITION BY state ORDER BY {_key('state', 'traj_id', 't')}) - 1 AS INTEGER) AS draw, traj_id, t FROM x) SELECT * FROM w WHERE draw < 10")
def sample_by_state_without_replacement(spark, d):
    return D.sample_by_state(D.state_index(states(spark, d)), 10, replace=False)


SEQUENCE = [0, 1, 2, 3, 4, 4, 3, 2, 1, 0]


@register(f"""WITH {INDEX}, q AS (SELECT unnest(range({len(SEQUENCE)})) AS pos, unnest({SEQUENCE}) AS state), w AS (SELECT q.pos, q.state, {_key('q.pos')} % size AS rank FROM q JOIN n ON n.state = q.state)
SELECT CAST(pos AS INTEGER) AS pos, w.state, traj_id, t FROM w JOIN x ON x.state = w.state AND x.rank = w.rank""")
def sample_by_sequence(spark, d):
    return D.sample_by_sequence(D.state_index(states(spark, d)), SEQUENCE)


@register(f"""WITH {INDEX}, q AS (SELECT k.k AS dist, CAST(p.p AS INTEGER) AS pos, CASE k.k WHEN 0 THEN 1 ELSE 3 END AS state FROM (SELECT unnest([0, 1]) AS k) k, range(20) AS p(p)),
w AS (SELECT dist, pos, q.state, CASE dist WHEN 0 THEN {_key('pos')} ELSE {_key('pos', seed=43)} END % size AS rank FROM q JOIN n ON n.state = q.state)
SELECT CAST(dist AS INTEGER) AS dist, pos, w.state, traj_id, t FROM w JOIN x ON x.state = w.state AND x.rank = w.rank""")
def sample_by_distributions(spark, d):
    """Distributions on one state each, so that SQL knows the states that NumPy draws."""
    return D.sample_by_distributions(D.state_index(states(spark, d)), [np.eye(5)[1], np.eye(5)[3]], 20)


_EDGES = np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 12)]))


@register(f"""WITH {F_SQL}, l AS (SELECT traj_id, s, lead(s, 1) OVER (PARTITION BY traj_id ORDER BY t) AS s2 FROM f), c AS (SELECT traj_id, s AS i, s2 AS j, count(*) AS n FROM l WHERE s2 IS NOT NULL GROUP BY 1, 2, 3),
u AS (SELECT CAST(k.k AS INTEGER) AS sample, i, j, n, CAST({_key('k.k', 'traj_id')} AS DOUBLE) / 1152921504606846976.0 AS u FROM c, range(10) AS k(k)),
w AS (SELECT sample, i, j, n * ({' + '.join(f'CASE WHEN u >= {float(e)!r} THEN 1 ELSE 0 END' for e in _EDGES)}) AS n FROM u) SELECT sample, i, j, CAST(sum(n) AS BIGINT) AS n FROM w WHERE n > 0 GROUP BY 1, 2, 3""")
def bootstrap_counts(spark, d):
    return D.bootstrap_counts(D.counts_by_trajectory(states(spark, d), 1), 10)


# Reweighting


@register(f"""WITH RECURSIVE {S_SQL}, c AS (SELECT k, s AS i, count(*) AS n FROM q GROUP BY 1, 2), l AS ({" UNION ALL ".join(f"SELECT {i} AS k, s AS i, b{i} AS e FROM q" for i in range(3))}),
lo AS (SELECT k, i, min(e) AS low FROM l GROUP BY 1, 2), b AS (SELECT l.k, l.i, max(low) - ln(avg(exp(low - e))) AS b FROM l JOIN lo ON l.k = lo.k AND l.i = lo.i GROUP BY 1, 2),
nk AS (SELECT k, CAST(sum(n) AS DOUBLE) AS n FROM c GROUP BY 1), ni AS (SELECT i, CAST(sum(n) AS DOUBLE) AS n FROM c GROUP BY 1),
w(step, k, i, fk, fi) AS (SELECT 0, b.k, b.i, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM b UNION ALL
  SELECT step + 1, k, i, -ln(sum(exp(-(b + f))) OVER (PARTITION BY k)), f FROM (
    SELECT step, k, i, b, g + ln(sum(exp(-g)) OVER (PARTITION BY k)) AS f FROM (
      SELECT w.step, w.k, w.i, b.b, ln(sum(exp(ln(nk.n) + w.fk - b.b)) OVER (PARTITION BY w.i)) - ln(ni.n) AS g FROM w JOIN b ON b.k = w.k AND b.i = w.i JOIN nk ON nk.k = w.k JOIN ni ON ni.i = w.i WHERE w.step < 400)))
SELECT i, round(fi, 6) AS f FROM w WHERE step = 400 AND k = 0""")
def wham_energies(spark, d):
    return _vector(spark, T.estimate(samples(spark, d), "wham", maxiter=20_000, maxerr=1e-13).f, "f", 6)


# Features: the first 63 numbers of an embedding are 21 atoms, three residues of seven

NAMES = ("N", "CA", "C", "O", "CB", "CG", "CD")
MASS = {"N": 14.007, "C": 12.011, "O": 15.999}
ATOMS = pd.DataFrame([(7 * r + k, n, n[0], MASS[n[0]], r, "LYS", 0) for r in range(3) for k, n in enumerate(NAMES)], columns=["atom", "name", "element", "mass", "residue", "resname", "chain"])
E_SQL = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
Vec = tuple[str, str, str]


def _atom(i: int) -> Vec:
    return tuple(f"e[{3 * i + k + 1}]" for k in range(3))


def _minus(u: Vec, v: Vec) -> Vec:
    return tuple(f"({a} - {b})" for a, b in zip(u, v, strict=True))


def _dot(u: Vec, v: Vec) -> str:
    return "(" + " + ".join(f"{a} * {b}" for a, b in zip(u, v, strict=True)) + ")"


def _cross(u: Vec, v: Vec) -> Vec:
    return tuple(f"({u[a]} * {v[b]} - {u[b]} * {v[a]})" for a, b in ((1, 2), (2, 0), (0, 1)))


def _distance(i: int, j: int) -> str:
    d = _minus(_atom(j), _atom(i))
    return f"sqrt({_dot(d, d)})"


def _angle(i: int, j: int, k: int) -> str:
    u, v = _minus(_atom(i), _atom(j)), _minus(_atom(k), _atom(j))
    return f"acos(greatest(-1, least(1, {_dot(u, v)} / sqrt({_dot(u, u)} * {_dot(v, v)}))))"


def _dihedral(*quad: int) -> str:
    a, b, c = (_minus(_atom(y), _atom(x)) for x, y in zip(quad, quad[1:], strict=False))
    n, m = _cross(a, b), _cross(b, c)
    return f"atan2(sqrt({_dot(b, b)}) * {_dot(a, m)}, {_dot(n, m)})"


def _center(atoms: list[int], k: int) -> str:
    mass = ATOMS["mass"].to_numpy()
    return "(" + " + ".join(f"{mass[i] / mass[atoms].sum():.17e} * e[{3 * i + k + 1}]" for i in sorted(atoms)) + ")"


def _features_sql(*columns: str) -> str:
    return f"WITH {E_SQL} SELECT vec_id, " + ", ".join(f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS f{k}" for k, c in enumerate(columns)) + " FROM e"


def _featured(spark, d, featurizer: Featurizer) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("traj_id"), F.lit(0).cast("bigint").alias("t"), F.slice("embedding", 1, 63).cast("array<double>").alias("x"))
    got = featurizer.transform(rows)
    return got.select(F.col("traj_id").alias("vec_id"), *[F.get("x", F.lit(k)).alias(f"f{k}") for k in range(featurizer.dimension)])


CA = [1, 8, 15]
BACKBONE = [7 * r + k for r in range(3) for k in range(3)]
RESIDUES = [list(range(7 * r, 7 * r + 7)) for r in range(3)]


def _nearest(a: list[int], b: list[int]) -> str:
    return "least(" + ", ".join(_distance(i, j) for i in a for j in b) + ")"


@register(_features_sql(*[c for i in range(21) for c in _atom(i)]))
def feature_all_coordinates(spark, d):
    return _featured(spark, d, Featurizer(ATOMS).add_all())


@register(_features_sql(*[c for i in BACKBONE for c in _atom(i)]))
def feature_backbone_selection(spark, d):
    f = Featurizer(ATOMS)
    return _featured(spark, d, f.add_selection(sorted(f.select_backbone())))


@register(_features_sql(_distance(0, 5), _distance(9, 2), *[_distance(i, j) for i in (3, 4) for j in (10, 11)]))
def feature_distances(spark, d):
    return _featured(spark, d, Featurizer(ATOMS).add_distances([[0, 5], [9, 2]]).add_distances([3, 4], indices2=[4, 10, 11]))


@register(_features_sql(_distance(1, 8), _distance(1, 15), _distance(8, 15)))
def feature_ca_distances(spark, d):
    return _featured(spark, d, Featurizer(ATOMS).add_distances_ca(excluded_neighbors=0))


@register(_features_sql(*[f"1 / {_distance(i, j)}" for i, j in ((0, 5), (0, 9), (5, 9))]))
def feature_inverse_distances(spark, d):
    return _featured(spark, d, Featurizer(ATOMS).add_inverse_distances([0, 5, 9]))


_NEAR = [f"CASE WHEN {_distance(i, j)} <= 0.25 THEN 1 ELSE 0 END" for i in (0, 1, 2) for j in (10, 11, 12)]


@register(_features_sql(*_NEAR, " + ".join(_NEAR)))
def feature_contacts(spark, d):
    f = Featurizer(ATOMS).add_contacts([0, 1, 2], [10, 11, 12], threshold=0.25)
    return _featured(spark, d, f.add_contacts([0, 1, 2], [10, 11, 12], threshold=0.25, count_contacts=True))


@register(_features_sql(*[_nearest(RESIDUES[a], RESIDUES[b]) for a, b in ((0, 1), (0, 2), (1, 2))], _distance(1, 15)))
def feature_residue_mindist(spark, d):
    return _featured(spark, d, Featurizer(ATOMS).add_residue_mindist([(0, 1), (0, 2), (1, 2)]).add_residue_mindist([(0, 2)], "ca"))


@register(_features_sql(_nearest([0, 1], [5, 6]), _nearest([0, 1], [20]), _nearest([5, 6], [20])))
def feature_group_mindist(spark, d):
    return _featured(spark, d, Featurizer(ATOMS).add_group_mindist([[0, 1], [5, 6], [20]]))


@register(_features_sql(*[_center(g, k) for g in ([0, 3, 7], [4, 20]) for k in range(3)]))
def feature_group_com(spark, d):
    return _featured(spark, d, Featurizer(ATOMS).add_group_com([[0, 3, 7], [4, 20]]))


@register(_features_sql(*[_center(g, k) for g in (RESIDUES[1], RESIDUES[2]) for k in range(3)], *[_center([7, 8, 9, 10], k) for k in range(3)], *[_center([4, 5, 6], k) for k in range(3)]))
def feature_residue_com(spark, d):
    return _featured(spark, d, Featurizer(ATOMS).add_residue_com([1, 2]).add_residue_com([1], "backbone").add_residue_com([0], "sidechain"))


@register(_features_sql(_angle(0, 1, 2), _angle(7, 3, 11), f"degrees({_angle(0, 1, 2)})", f"cos({_angle(4, 5, 6)})", f"sin({_angle(4, 5, 6)})"))
def feature_angles(spark, d):
    return _featured(spark, d, Featurizer(ATOMS).add_angles([[0, 1, 2], [7, 3, 11]]).add_angles([[0, 1, 2]], deg=True).add_angles([[4, 5, 6]], cossin=True))


@register(_features_sql(_dihedral(0, 1, 2, 7), f"degrees({_dihedral(3, 9, 12, 20)})", f"cos({_dihedral(4, 5, 6, 8)})", f"sin({_dihedral(4, 5, 6, 8)})"))
def feature_dihedrals(spark, d):
    return _featured(spark, d, Featurizer(ATOMS).add_dihedrals([[0, 1, 2, 7]]).add_dihedrals([[3, 9, 12, 20]], deg=True).add_dihedrals([[4, 5, 6, 8]], cossin=True))


_PHI_PSI = [_dihedral(0, 1, 2, 7), _dihedral(2, 7, 8, 9), _dihedral(7, 8, 9, 14), _dihedral(9, 14, 15, 16)]


@register(_features_sql(*_PHI_PSI))
def feature_backbone_torsions(spark, d):
    return _featured(spark, d, Featurizer(ATOMS).add_backbone_torsions())


@register(_features_sql(*[_dihedral(*(7 * r + k for k in (0, 1, 4, 5))) for r in range(3)]))
def feature_chi1_torsions(spark, d):
    return _featured(spark, d, Featurizer(ATOMS).add_chi1_torsions())


@register(_features_sql(*[_dihedral(*(7 * r + k for k in q)) for r in range(3) for q in ((0, 1, 4, 5), (1, 4, 5, 6))]))
def feature_sidechain_torsions(spark, d):
    return _featured(spark, d, Featurizer(ATOMS).add_sidechain_torsions())


def first_times_two(x: np.ndarray) -> np.ndarray:
    return 2 * x[:, 0, :]


@register(_features_sql(*[f"2 * {c}" for c in _atom(0)]))
def feature_custom(spark, d):
    return _featured(spark, d, Featurizer(ATOMS).add_custom_func(first_times_two, 3))


# Lloyd's steps from given centres


@register(f"""WITH RECURSIVE {F_SQL}, w(step, c, x) AS (SELECT * FROM (VALUES {', '.join(f'(0, {i}, CAST({v} AS DOUBLE))' for i, v in enumerate(CENTERS))}) UNION ALL
  SELECT step + 1, c, avg(v) FROM (SELECT w.step, f.traj_id, f.t, f.v, arg_min(w.c, abs(f.v - w.x)) AS c FROM w, f WHERE w.step < 6 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2)
SELECT CAST(c AS INTEGER) AS c, round(x, 7) AS center FROM w WHERE step = 6""")
def kmeans_resumed(spark, d):
    """Six iterations from given centres."""
    m = C.KMeans(max_iter=6, tolerance=0, centers=np.array(CENTERS)[:, None]).fit(value_frames(spark, d))
    return long_table(spark, [(c, float(x)) for c, x in enumerate(m.centers[:, 0])], "c int, center double").withColumn("center", rounded("center", 7))
