"""Queries over the driver's tables, each with the SQL it is held against where SQL can express it.

Trajectories are the users' events (state: type of event, value: a scalar), the embeddings by label (64 dimensions), and the
turns of conversations.  Fractions and sums of doubles are rounded on both sides, since engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions import features as X
from kinelake.operators import clustering as C
from kinelake.operators import decomposition as L
from kinelake.operators import dtrajs as D
from kinelake.operators import lag as G
from kinelake.operators import moments as M
from kinelake.operators import msm as K
from kinelake.operators import statistics as S
from kinelake.operators import thermo as T
from kinelake.operators.amm import state_expectations
from kinelake.operators.hmm import HMSMEstimator
from kinelake.operators.oom import OOMEstimator
from kinelake.session import table
from kinelake.sources import frames as Fr

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    query: Query
    sql: str | None


_all: dict[str, Entry] = {}

F_SQL = """f AS (SELECT user_id AS traj_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS t,
  CAST(list_position(['click','error','purchase','signup','view'], event_type) - 1 AS INTEGER) AS s, value AS v FROM events)"""
K_SQL = F_SQL + ", g AS (SELECT traj_id, t, s, v, CASE WHEN v > 20 THEN 1 ELSE 0 END AS k FROM f)"
CENTERS = (5.0, 15.0, 40.0)
UMBRELLAS, FORCES = (5.0, 20.0, 60.0), (0.02, 0.01, 0.005)
CORE = (0, 2)


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def put(query: Query) -> Query:
        _all[query.__name__] = Entry(query, sql)
        return query

    return put


def entries() -> dict[str, Entry]:
    """All queries; importing the other catalogues, which use this one, puts theirs here too."""
    from kinelake.plans import frame_catalog, model_catalog  # noqa: F401

    return _all


def queries() -> dict[str, Query]:
    return {name: e.query for name, e in entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: e.sql for name, e in entries().items() if e.sql}


def events(spark: SparkSession, d: str) -> DataFrame:
    return Fr.events_trajectories(table(spark, d, "events"))


def states(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("traj_id", "t", "state")


def values(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("traj_id", "t", F.col("value").alias("v"))


def value_frames(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("traj_id", "t", F.array("value").alias("x"))


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return Fr.embedding_trajectories(table(spark, d, "embeddings"))


def ensembles(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).withColumn("k", F.when(F.col("value") > 20, 1).otherwise(0)).select("traj_id", "t", "k", "state", "value")


def samples(spark: SparkSession, d: str) -> DataFrame:
    """``traj_id, t, k, i, b``: harmonic bias energies of the values, ensembles by value."""
    rows = ensembles(spark, d).withColumn("x", F.array("value"))
    return T.umbrella_bias(rows, np.array(UMBRELLAS)[:, None], np.array(FORCES)).select("traj_id", "t", F.when(F.col("value") > 40, 2).otherwise(F.col("k")).alias("k"), F.col("state").alias("i"), "b")


def rounded(c: Column | str, digits: int) -> Column:
    return F.round(c, digits)


def long_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# Discrete trajectories


@register(f"""WITH {F_SQL}, c AS (SELECT s, count(*) AS n FROM f GROUP BY s), e AS (SELECT CAST(unnest(range((SELECT max(s) + 1 FROM f))) AS INTEGER) AS s)
SELECT e.s AS state, coalesce(c.n, 0) AS n FROM e LEFT JOIN c ON e.s = c.s""")
def state_histogram(spark, d):
    return D.state_histogram(states(spark, d))


@register(f"WITH {F_SQL} SELECT DISTINCT s AS state FROM f")
def visited_states(spark, d):
    return D.visited_states(states(spark, d))


@register(f"WITH {F_SQL} SELECT max(s) + 1 AS nstates, count(DISTINCT s) AS used FROM f")
def number_of_states(spark, d):
    return states(spark, d).where("state >= 0").agg((F.max("state") + 1).alias("nstates"), F.count_distinct("state").alias("used"))


def _counts_sql(lag: int, extra: str = "") -> str:
    return f"""WITH {F_SQL}, l AS (SELECT s, t, lead(s, {lag}) OVER (PARTITION BY traj_id ORDER BY t) AS s2 FROM f)
SELECT s AS i, s2 AS j, count(*) AS n FROM l WHERE s2 IS NOT NULL {extra} GROUP BY 1, 2"""


@register(_counts_sql(3))
def transition_counts_sliding(spark, d):
    return D.transition_counts(states(spark, d), 3)


@register(_counts_sql(5, "AND t % 5 = 0"))
def transition_counts_sample(spark, d):
    return D.transition_counts(states(spark, d), 5, "sample")


@register(_counts_sql(10))
def transition_counts_lag10(spark, d):
    return D.transition_counts(states(spark, d), 10)


@register("WITH c AS (" + _counts_sql(3) + ") SELECT i, j, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY i), 9) AS p FROM c")
def transition_matrix_mle_nonrev(spark, d):
    return D.row_normalized(D.transition_counts(states(spark, d), 3)).withColumn("p", rounded("p", 9))


@register(f"""WITH {F_SQL}, l AS (SELECT s, lead(s, 2) OVER w AS a, lead(s, 4) OVER w AS b FROM f WINDOW w AS (PARTITION BY traj_id ORDER BY t))
SELECT s AS i, a AS mid, b AS j, count(*) AS n FROM l WHERE b IS NOT NULL GROUP BY 1, 2, 3""")
def two_step_counts(spark, d):
    return D.two_step_counts(states(spark, d), 2)


@register(f"""WITH {F_SQL}, l AS (SELECT traj_id, s, lead(s, 1) OVER (PARTITION BY traj_id ORDER BY t) AS s2 FROM f)
SELECT traj_id, s AS i, s2 AS j, count(*) AS n FROM l WHERE s2 IS NOT NULL GROUP BY 1, 2, 3""")
def counts_by_trajectory(spark, d):
    return D.counts_by_trajectory(states(spark, d), 1)


@register(" UNION ALL ".join(f"SELECT {k} AS lag, * FROM ({_counts_sql(k)})" for k in (1, 2, 5, 10)))
def its_counts_all_lags(spark, d):
    return D.transition_counts_lags(states(spark, d), (1, 2, 5, 10))


@register(f"""WITH {F_SQL}, o AS (SELECT traj_id, min(t) AS off FROM f WHERE s IN {CORE} GROUP BY 1),
c AS (SELECT f.traj_id, f.t - o.off AS t, CASE WHEN s IN {CORE} THEN s END AS c FROM f JOIN o ON f.traj_id = o.traj_id AND f.t >= o.off)
SELECT traj_id, t, last_value(c IGNORE NULLS) OVER (PARTITION BY traj_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS state FROM c""")
def core_set_milestones(spark, d):
    return D.core_set_milestones(states(spark, d), CORE)


@register(f"""WITH {F_SQL}, o AS (SELECT traj_id, min(t) AS off FROM f WHERE s IN {CORE} GROUP BY 1)
SELECT f.traj_id, f.t - o.off AS t, CASE WHEN s IN {CORE} THEN s ELSE -1 END AS state FROM f JOIN o ON f.traj_id = o.traj_id AND f.t >= o.off""")
def core_set_rewrite(spark, d):
    return D.core_set_rewrite(states(spark, d), CORE)


@register(f"WITH {F_SQL} SELECT traj_id, min(CASE WHEN s = 3 THEN t END) AS off FROM f GROUP BY 1")
def core_set_offsets(spark, d):
    return D.core_set_offsets(states(spark, d), (3,))


@register(f"""WITH {K_SQL}, r AS (SELECT *, CASE WHEN k <> lag(k) OVER (PARTITION BY traj_id ORDER BY t) THEN 1 ELSE 0 END AS brk FROM g),
q AS (SELECT *, sum(brk) OVER (PARTITION BY traj_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM r),
l AS (SELECT k, s, lead(s, 1) OVER (PARTITION BY traj_id, run ORDER BY t) AS s2 FROM q)
SELECT k, s AS i, s2 AS j, count(*) AS n FROM l WHERE s2 IS NOT NULL GROUP BY 1, 2, 3""")
def ensemble_counts(spark, d):
    return D.ensemble_counts(ensembles(spark, d), 1)


@register(f"WITH {K_SQL} SELECT k, s AS i, count(*) AS n FROM g GROUP BY 1, 2")
def ensemble_state_counts(spark, d):
    return D.ensemble_state_counts(ensembles(spark, d))


@register(f"WITH {F_SQL} SELECT s AS state, traj_id, t, CAST(row_number() OVER (PARTITION BY s ORDER BY traj_id, t) - 1 AS BIGINT) AS rank FROM f")
def state_index(spark, d):
    return D.state_index(states(spark, d))


@register(f"WITH {F_SQL} SELECT traj_id, t, CASE s WHEN 4 THEN 0 WHEN 1 THEN 1 WHEN 0 THEN 2 ELSE -1 END AS state FROM f")
def map_to_active(spark, d):
    return D.to_active(states(spark, d), (4, 1, 0))


@register("WITH c AS (" + _counts_sql(3) + ") SELECT CASE i WHEN 2 THEN 0 ELSE 1 END AS i, CASE j WHEN 2 THEN 0 ELSE 1 END AS j, n FROM c WHERE i IN (2, 4) AND j IN (2, 4)")
def count_submatrix(spark, d):
    return D.count_submatrix(D.transition_counts(states(spark, d), 3), (2, 4))


@register(f"""WITH {F_SQL}, n AS (SELECT traj_id, count(*) AS n FROM f GROUP BY 1), l AS (SELECT unnest([1, 50, 60, 70]) AS lag)
SELECT CAST(lag AS INTEGER) AS lag, round(CAST(sum(CASE WHEN n > lag THEN n ELSE 0 END) AS DOUBLE) / sum(n), 9) AS fraction FROM n, l GROUP BY 1""")
def fraction_of_frames(spark, d):
    return D.fraction_of_frames(states(spark, d), (1, 50, 60, 70)).withColumn("fraction", rounded("fraction", 9))


@register(f"""WITH {F_SQL}, l AS (SELECT s, lead(s, 2) OVER (PARTITION BY traj_id ORDER BY t) AS s2 FROM f)
SELECT s AS i, s2 AS j, count(*) AS n FROM l WHERE s2 IS NOT NULL GROUP BY 1, 2""")
def k_fold_split_counts(spark, d):
    """Counts after cutting trajectories into overlapping blocks equal the counts of the whole trajectories."""
    wide = G.lagged(states(spark, d), 2, ["state"], 10).where("state_2 IS NOT NULL")
    return wide.groupBy(F.col("state").alias("i"), F.col("state_2").alias("j")).agg(F.count("*").alias("n"))


@register(f"""WITH {F_SQL}, h AS (SELECT s, count(*) AS n FROM f GROUP BY 1)
SELECT traj_id, t, round(0.2 / n, 12) AS w FROM f JOIN h ON f.s = h.s""")
def trajectory_weights(spark, d):
    return D.trajectory_weights(states(spark, d), np.full(5, 0.2), range(5)).withColumn("w", rounded("w", 12))


@register(f"WITH {F_SQL} SELECT s AS state, round(avg(v), 6) AS mean, count(*) AS n FROM f GROUP BY 1")
def state_means(spark, d):
    return D.state_means(states(spark, d), values(spark, d)).withColumn("mean", rounded("mean", 6))


# Frames


@register(f"WITH {F_SQL} SELECT traj_id, CAST(floor((t - 3) / 4) AS BIGINT) AS t, s AS state FROM f WHERE t >= 3 AND (t - 3) % 4 = 0")
def frames_strided(spark, d):
    return Fr.strided(states(spark, d), 4, 3)


@register(f"WITH {F_SQL} SELECT traj_id, count(*) AS length FROM f WHERE t >= 3 AND (t - 3) % 4 = 0 GROUP BY 1")
def trajectory_lengths(spark, d):
    return Fr.lengths(states(spark, d), 4, 3)


@register(f"""WITH {F_SQL}, l AS (SELECT traj_id, t, v AS x, lead(v, 4) OVER (PARTITION BY traj_id ORDER BY t) AS y FROM f)
SELECT * FROM l WHERE y IS NOT NULL AND t % 3 = 0""")
def lagged_pairs(spark, d):
    return G.lagged_pairs(values(spark, d), 4, "v", stride=3)


@register(f"WITH {F_SQL} SELECT a.traj_id, a.t, a.v AS v, b.v AS y FROM f a JOIN f b ON a.traj_id = b.traj_id AND b.t = a.t + 7")
def lagged_pairs_equijoin(spark, d):
    return G.gapped_pairs(values(spark, d), 7, "v")


@register(f"""WITH {F_SQL}, i AS (SELECT * FROM (VALUES (0, 3, 7), (1, 1, 0), (2, 3, 7), (3, 2, 1000000)) AS i(pos, traj_id, t))
SELECT i.pos, i.traj_id, CAST(i.t AS BIGINT) AS t, f.v, f.t IS NOT NULL AS found FROM i LEFT JOIN f ON i.traj_id = f.traj_id AND i.t = f.t""")
def random_access_gather(spark, d):
    index = spark.createDataFrame([(0, 3, 7), (1, 1, 0), (2, 3, 7), (3, 2, 1_000_000)], "pos int, traj_id int, t bigint")
    return Fr.gather(values(spark, d), index)


@register(f"WITH {F_SQL} SELECT traj_id, t, v AS x0, CAST(s AS DOUBLE) AS x1 FROM f")
def merge_sources(spark, d):
    both = Fr.merge_sources(value_frames(spark, d), states(spark, d).select("traj_id", "t", F.array(F.col("state").cast("double")).alias("x")), check=False)
    return both.select("traj_id", "t", F.get("x", F.lit(0)).alias("x0"), F.get("x", F.lit(1)).alias("x1"))


@register(f"""WITH {F_SQL}, n AS (SELECT count(*) AS n FROM f WHERE traj_id = 1)
SELECT 0 AS traj_id, t, v FROM f WHERE traj_id = 1 UNION ALL SELECT 0 AS traj_id, t + n.n AS t, v FROM f, n WHERE traj_id = 2""")
def fragment_concat(spark, d):
    v = values(spark, d)
    return Fr.fragments([v.where("traj_id = 1"), v.where("traj_id = 2")])


@register(f"WITH {F_SQL}, m AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM f WHERE traj_id IN (1, 2, 3) GROUP BY traj_id)) SELECT traj_id, t, v FROM f, m WHERE traj_id IN (1, 2, 3) AND t >= 2 AND t < m.n AND (t - 2) % 5 = 0")
def cuboid_slice(spark, d):
    return Fr.cuboid(values(spark, d), (1, 2, 3), 2, None, 5)


@register(f"WITH {F_SQL} SELECT traj_id, t, v FROM f WHERE traj_id IN (1, 4) AND t >= 2 AND t < 30 AND (t - 2) % 5 = 0")
def jagged_slice(spark, d):
    return Fr.jagged(values(spark, d), (1, 4), 2, 30, 5)


@register(f"WITH {F_SQL} SELECT traj_id, t, v, CAST(row_number() OVER (ORDER BY traj_id, t) - 1 AS BIGINT) AS pos FROM f")
def linear_index(spark, d):
    return Fr.linear(values(spark, d))


@register(f"""WITH {F_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY traj_id, t) - 1 AS pos FROM f), n AS (SELECT count(*) AS total FROM f), c AS (SELECT CAST(unnest(range(7)) AS INTEGER) AS c)
SELECT c.c, traj_id, t, v FROM c, n JOIN p ON true WHERE p.pos = CAST(floor((2 * c.c + 1) * n.total / 14) AS BIGINT)""")
def uniform_time_centers(spark, d):
    return C.uniform_time_frames(value_frames(spark, d), 7).select("c", "traj_id", "t", F.get("x", F.lit(0)).alias("v"))


@register(f"""WITH {F_SQL}, c AS (SELECT * FROM (VALUES {', '.join(f'({i}, {v})' for i, v in enumerate(CENTERS))}) AS c(c, x)),
r AS (SELECT traj_id, t, c.c AS state, abs(v - c.x) AS dist, row_number() OVER (PARTITION BY traj_id, t ORDER BY abs(v - c.x), c.c) AS r FROM f, c)
SELECT traj_id, t, state, round(dist, 6) AS distance FROM r WHERE r = 1""")
def assign_to_centers(spark, d):
    got = C.assign_sql(value_frames(spark, d), np.array(CENTERS)[:, None])
    return got.withColumn("distance", rounded("distance", 6))


@register("""WITH e AS (SELECT vec_id, k, CAST(embedding[k + 1] AS DOUBLE) AS v FROM embeddings, range(64) AS r(k)),
r AS (SELECT e.vec_id, c.vec_id AS c, sqrt(sum((e.v - c.v) * (e.v - c.v))) AS dist FROM e JOIN e c ON e.k = c.k AND c.vec_id < 10 GROUP BY 1, 2)
SELECT vec_id, CAST(arg_min(c, dist) AS INTEGER) AS state, round(min(dist), 5) AS distance FROM r GROUP BY 1""")
def assign_embeddings(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("traj_id"), F.lit(0).cast("bigint").alias("t"), F.col("embedding").cast("array<double>").alias("x"))
    centers = np.array([r.x for r in rows.where("traj_id < 10").orderBy("traj_id").collect()])
    return C.assign(rows, centers).select(F.col("traj_id").alias("vec_id"), "state", rounded("distance", 5).alias("distance"))


# Moments


@register(f"WITH {F_SQL} SELECT CAST(count(*) AS DOUBLE) AS w, round(sum(v), 3) AS sx, round(sum(v * v), 2) AS xx FROM f")
def moments_xx(spark, d):
    m = M.moments_xx(value_frames(spark, d)).raw()
    return long_table(spark, [(m.w, float(m.sx[0]), float(m.xx[0, 0]))], "w double, sx double, xx double").select("w", rounded("sx", 3).alias("sx"), rounded("xx", 2).alias("xx"))


_PAIRS = f"WITH {F_SQL}, p AS (SELECT v AS x, lead(v, 2) OVER (PARTITION BY traj_id ORDER BY t) AS y FROM f)"


@register(_PAIRS + " SELECT CAST(2 * count(*) AS DOUBLE) AS w, round(sum(x) + sum(y), 3) AS s, round(sum(x * x) + sum(y * y), 2) AS xx, round(2 * sum(x * y), 2) AS xy FROM p WHERE y IS NOT NULL")
def moments_xy_symmetrized(spark, d):
    m = M.moments_lagged(value_frames(spark, d), 2, symmetrize=True).raw()
    rows = long_table(spark, [(m.w, float(m.sx[0]), float(m.xx[0, 0]), float(m.xy[0, 0]))], "w double, s double, xx double, xy double")
    return rows.select("w", rounded("s", 3).alias("s"), rounded("xx", 2).alias("xx"), rounded("xy", 2).alias("xy"))


@register(_PAIRS + " SELECT round(var_samp(x), 6) AS c00, round(covar_samp(x, y), 6) AS c0t, round(var_samp(y), 6) AS ctt FROM p WHERE y IS NOT NULL")
def covariance_lagged(spark, d):
    c = M.LaggedCovariance(2, remove="data").fit(value_frames(spark, d))
    rows = long_table(spark, [(float(c.c00[0, 0]), float(c.c0t[0, 0]), float(c.ctt[0, 0]))], "c00 double, c0t double, ctt double")
    return rows.select(*[rounded(n, 6).alias(n) for n in ("c00", "c0t", "ctt")])


@register("""WITH e AS (SELECT vec_id, CAST(k AS INTEGER) AS i, CAST(embedding[k + 1] AS DOUBLE) AS v FROM embeddings, range(64) AS r(k))
SELECT a.i, b.i AS j, round(covar_samp(a.v, b.v), 5) + 0.0 AS c FROM e a JOIN e b ON a.vec_id = b.vec_id GROUP BY 1, 2""")
def covariance_embeddings(spark, d):
    m = M.moments_xx(embeddings(spark, d))
    c = m.xx / (m.w - 1)
    return long_table(spark, [(i, j, float(c[i, j])) for i in range(64) for j in range(64)], "i int, j int, c double").withColumn("c", rounded("c", 5) + 0.0)


@register(f"""WITH {F_SQL}, m AS (SELECT avg(v) AS m FROM f), z AS (SELECT traj_id, t, v - m AS v FROM f, m),
r AS (SELECT b.t - a.t AS lag, sum(a.v * b.v) / count(*) AS c FROM z a JOIN z b ON a.traj_id = b.traj_id AND b.t BETWEEN a.t AND a.t + 9 GROUP BY 1)
SELECT CAST(lag AS INTEGER) AS lag, round(c / (SELECT c FROM r WHERE lag = 0), 8) AS acf FROM r""")
def acf(spark, d):
    return S.acf(values(spark, d), 9).withColumn("acf", rounded("acf", 8))


@register(f"""WITH {F_SQL}, e AS (SELECT min(v) AS lo, max(v) AS hi FROM f), h AS (SELECT CAST(least(floor((v - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM f, e GROUP BY 1),
b AS (SELECT CAST(unnest(range(20)) AS INTEGER) AS bin) SELECT b.bin, coalesce(h.n, 0) AS n FROM b LEFT JOIN h ON b.bin = h.bin""")
def histogram_1d(spark, d):
    return S.histogram(values(spark, d), 20)


_H2 = f"""WITH {F_SQL}, p AS (SELECT v AS x, lead(v, 1) OVER (PARTITION BY traj_id ORDER BY t) AS y FROM f), q AS (SELECT x, y FROM p WHERE y IS NOT NULL),
e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM q),
h AS (SELECT CAST(least(floor((x - x0) / ((x1 - x0) / 10)), 9) AS INTEGER) AS bx, CAST(least(floor((y - y0) / ((y1 - y0) / 10)), 9) AS INTEGER) AS byy, CAST(count(*) AS DOUBLE) AS z FROM q, e GROUP BY 1, 2)"""


def _plane(spark, d) -> DataFrame:
    return G.lagged_pairs(values(spark, d), 1, "v").select("x", "y")


@register(_H2 + ' SELECT bx, byy AS "by", z FROM h')
def histogram_2d(spark, d):
    return S.histogram_2d(_plane(spark, d), 10)


@register(_H2 + ' SELECT bx, byy AS "by", round(-ln(z / (SELECT sum(z) FROM h)) - (SELECT min(-ln(z / (SELECT sum(z) FROM h))) FROM h), 8) AS f FROM h')
def free_energy_2d(spark, d):
    return S.free_energy(S.histogram_2d(_plane(spark, d), 10), min_zero=True).withColumn("f", rounded("f", 8))


@register(_H2 + ' SELECT bx, byy AS "by", round(z / (SELECT sum(z) FROM h), 10) AS z FROM h')
def density_2d(spark, d):
    return S.density(S.histogram_2d(_plane(spark, d), 10)).withColumn("z", rounded("z", 10))


@register("""WITH e AS (SELECT CAST(k AS INTEGER) AS dim, CAST(embedding[k + 1] AS DOUBLE) AS v FROM embeddings, range(64) AS r(k)), m AS (SELECT dim, min(v) AS lo, max(v) AS hi FROM e GROUP BY dim),
h AS (SELECT e.dim, CAST(least(floor((v - lo) / ((hi - lo) / 12)), 11) AS INTEGER) AS bin, count(*) AS n FROM e JOIN m ON e.dim = m.dim GROUP BY 1, 2)
SELECT dim, bin, n, round(CAST(n AS DOUBLE) / max(n) OVER (PARTITION BY dim), 9) AS height FROM h""")
def histogram_features(spark, d):
    return S.histogram_features(embeddings(spark, d), 12).withColumn("height", rounded("height", 9))


@register(f"WITH {F_SQL}, a AS (SELECT s, max(-v) AS top FROM f GROUP BY s) SELECT f.s AS state, round(max(top) + ln(sum(exp(-v - top))), 8) AS lse FROM f JOIN a ON f.s = a.s GROUP BY 1")
def logsumexp_by_state(spark, d):
    rows = events(spark, d).select("state", (-F.col("value")).alias("v"))
    return S.logsumexp(rows, ["state"]).withColumn("lse", rounded("lse", 8))


@register("""SELECT CAST(label AS INTEGER) AS label, count(*) AS n FROM (SELECT label, sqrt((CAST(embedding[4] AS DOUBLE) - embedding[1]) * (CAST(embedding[4] AS DOUBLE) - embedding[1]) + (CAST(embedding[5] AS DOUBLE) - embedding[2]) * (CAST(embedding[5] AS DOUBLE) - embedding[2]) + (CAST(embedding[6] AS DOUBLE) - embedding[3]) * (CAST(embedding[6] AS DOUBLE) - embedding[3])) AS dist FROM embeddings) WHERE dist <= 0.2 GROUP BY 1""")
def contact_counts(spark, d):
    """Each embedding's first six numbers are taken as the positions of two atoms."""
    got = X.contact_counts(embeddings(spark, d), [(0, 1)], 0.2)
    return got.groupBy(F.col("traj_id").alias("label")).agg(F.sum("n").alias("n")).where("n > 0")


# Ensembles

_B = [f"0.5 * {f} * (v - {c}) * (v - {c})" for c, f in zip(UMBRELLAS, FORCES, strict=True)]
S_SQL = F_SQL + ", q AS (SELECT traj_id, t, s, CASE WHEN v > 40 THEN 2 WHEN v > 20 THEN 1 ELSE 0 END AS k, " + ", ".join(f"{b} AS b{i}" for i, b in enumerate(_B)) + " FROM f)"


@register(f"WITH {S_SQL} SELECT traj_id, t, round(b0, 9) AS b0, round(b1, 9) AS b1, round(b2, 9) AS b2 FROM q")
def umbrella_bias(spark, d):
    return samples(spark, d).select("traj_id", "t", *[rounded(F.get("b", F.lit(i)), 9).alias(f"b{i}") for i in range(3)])


@register(f"WITH {S_SQL}, l AS (" + " UNION ALL ".join(f"SELECT {i} AS k, s AS i, b{i} AS e FROM q" for i in range(3)) + "), m AS (SELECT k, i, min(e) AS low FROM l GROUP BY 1, 2) SELECT l.k, l.i, round(max(low) - ln(avg(exp(low - e))), 7) AS b FROM l JOIN m ON l.k = m.k AND l.i = m.i GROUP BY 1, 2")
def averaged_bias_matrix(spark, d):
    return T.averaged_bias(samples(spark, d)).withColumn("b", rounded("b", 7))


@register(f"""WITH {S_SQL}, c AS (SELECT k, s AS i, count(*) AS n FROM q GROUP BY 1, 2), l AS ({" UNION ALL ".join(f"SELECT {i} AS k, s AS i, b{i} AS e FROM q" for i in range(3))}),
m AS (SELECT k, i, min(e) AS low FROM l GROUP BY 1, 2), b AS (SELECT l.k, l.i, max(low) - ln(avg(exp(low - e))) AS b FROM l JOIN m ON l.k = m.k AND l.i = m.i GROUP BY 1, 2),
nk AS (SELECT k, sum(n) AS n FROM c GROUP BY 1), ni AS (SELECT i, sum(n) AS n FROM c GROUP BY 1),
f AS (SELECT b.i, ln(sum(exp(ln(nk.n) - b.b))) - ln(max(ni.n)) AS f FROM b JOIN nk ON b.k = nk.k JOIN ni ON b.i = ni.i GROUP BY 1)
SELECT i, round(f + ln((SELECT sum(exp(-f)) FROM f)), 7) AS f FROM f""".replace("f AS (SELECT b.i", "fi AS (SELECT b.i").replace("SELECT i, round(f + ln((SELECT sum(exp(-f)) FROM f)), 7) AS f FROM f", "SELECT i, round(f + ln((SELECT sum(exp(-f)) FROM fi)), 7) AS f FROM fi"))
def wham_one_step(spark, d):
    s = samples(spark, d)
    n = T.state_count_matrix(s)
    f, _ = T.wham_step(np.log(n.sum(1)), np.log(n.sum(0)), T.bias_matrix(s, *n.shape), np.zeros(len(n)))
    return long_table(spark, [(i, float(v)) for i, v in enumerate(f)], "i int, f double").withColumn("f", rounded("f", 7))


@register(None)
def mbar_energies(spark, d):
    m = T.mbar(samples(spark, d))
    return long_table(spark, [(k, float(v), float(m.increments[-1])) for k, v in enumerate(m.f_therm)], "k int, f double, increment double")


@register(None)
def dtram_energies(spark, d):
    m = T.estimate(samples(spark, d), "dtram", 1, maxiter=500)
    return long_table(spark, [(i, float(v)) for i, v in enumerate(m.f)], "i int, f double")


@register(None)
def tram_energies(spark, d):
    m = T.TRAM(1, connectivity="summed_count_matrix").fit(samples(spark, d)).model
    return long_table(spark, [(i, float(v), float(m.increments[-1])) for i, v in enumerate(m.f)], "i int, f double, increment double")


# Models


@register(None)
def pca_projection(spark, d):
    f = embeddings(spark, d)
    return L.PCA(dim=2).fit(f).transform(f)


@register(None)
def tica_projection(spark, d):
    f = embeddings(spark, d)
    return L.TICA(lag=1, dim=2).fit(f).transform(f)


@register(None)
def vamp_projection(spark, d):
    f = embeddings(spark, d)
    return L.VAMP(lag=1, dim=2).fit(f).transform(f)


@register(None)
def nystroem_tica(spark, d):
    m = L.NystroemTICA(1, 4, initial_columns=[0]).fit(embeddings(spark, d))
    return long_table(spark, [(k, int(c), float(v)) for k, (c, v) in enumerate(zip(m.columns, m.eigenvalues, strict=False))], "k int, column int, eigenvalue double")


@register(None)
def kmeans_dtrajs(spark, d):
    f = embeddings(spark, d)
    return C.KMeans(10).fit(f).transform(f)


@register(None)
def mini_batch_kmeans_dtrajs(spark, d):
    f = embeddings(spark, d)
    return C.MiniBatchKMeans(10).fit(f).transform(f)


@register(None)
def regular_space_dtrajs(spark, d):
    f = value_frames(spark, d)
    return C.RegularSpace(10.0).fit(f).transform(f)


def _msm(spark, d, lag: int = 1) -> K.MSMEstimator:
    return K.MSMEstimator(lag).fit(states(spark, d))


@register(f"""WITH c AS ({_counts_sql(1)}), s AS (SELECT i, j, n FROM c UNION ALL SELECT j AS i, i AS j, n FROM c)
SELECT i, round(CAST(sum(n) AS DOUBLE) / (SELECT sum(n) FROM s), 9) AS p FROM s GROUP BY 1""")
def symmetrized_stationary(spark, d):
    c = D.transition_counts(states(spark, d), 1)
    both = c.unionByName(c.select(F.col("j").alias("i"), F.col("i").alias("j"), "n"))
    total = both.agg(F.sum("n").alias("total"))
    return both.groupBy("i").agg(F.sum("n").alias("n")).join(F.broadcast(total)).select("i", rounded(F.col("n") / F.col("total"), 9).alias("p"))


@register(None)
def implied_timescales(spark, d):
    return K.ImpliedTimescales([1, 2, 3]).fit(states(spark, d)).table(spark)


@register(None)
def bayesian_msm(spark, d):
    return K.BayesianMSM(1).fit(states(spark, d)).table(spark)


@register(None)
def chapman_kolmogorov(spark, d):
    e = _msm(spark, d)
    rows = [(r["k"], i, j, float(r["predicted"][i, j]), float(r["estimated"][i, j])) for r in e.cktest(states(spark, d), 2, (1, 2, 3)) for i in range(2) for j in range(2)]
    return long_table(spark, rows, "k int, i int, j int, predicted double, estimated double")


@register(None)
def pcca_memberships(spark, d):
    e = _msm(spark, d)
    m = e.model.pcca(2).memberships
    return long_table(spark, [(int(e.active[i]), k, float(m[i, k])) for i in range(len(m)) for k in range(2)], "state int, k int, membership double")


@register(None)
def hidden_msm(spark, d):
    e = HMSMEstimator(2, 1).fit(states(spark, d))
    increment = float(e.likelihoods[-1] - e.likelihoods[-2]) if len(e.likelihoods) > 1 else None
    return long_table(spark, [(i, j, float(e.model.p[i, j]), increment) for i in range(2) for j in range(2)], "i int, j int, p double, increment double")


@register(None)
def oom_reweighted_msm(spark, d):
    m = OOMEstimator(1).fit(states(spark, d)).model
    return long_table(spark, [(int(m.active[i]), int(m.active[j]), float(m.p[i, j])) for i in range(m.nstates) for j in range(m.nstates)], "i int, j int, p double")


@register(f"WITH {F_SQL} SELECT s AS i, round(avg(v), 6) AS e FROM f GROUP BY 1")
def augmented_state_expectations(spark, d):
    e = state_expectations(states(spark, d), value_frames(spark, d), 5)
    return long_table(spark, [(i, float(v)) for i, v in enumerate(e[:, 0])], "i int, e double").withColumn("e", rounded("e", 6))


# Other trajectories


@register("""WITH f AS (SELECT o_custkey AS traj_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS t, CAST(list_position(['F','O','P'], o_orderstatus) - 1 AS INTEGER) AS s FROM orders),
l AS (SELECT s, lead(s, 1) OVER (PARTITION BY traj_id ORDER BY t) AS s2 FROM f) SELECT s AS i, s2 AS j, count(*) AS n FROM l WHERE s2 IS NOT NULL GROUP BY 1, 2""")
def order_status_counts(spark, d):
    from pyspark.sql.window import Window

    o = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = o.select(F.col("o_custkey").alias("traj_id"), (F.row_number().over(w) - 1).cast("bigint").alias("t"), (F.array_position(F.array(*map(F.lit, "FOP")), F.col("o_orderstatus")) - 1).cast("int").alias("state"))
    return D.transition_counts(rows, 1)


@register("""WITH r AS (SELECT conv_id, turn, role FROM conversations), s AS (SELECT role, CAST(row_number() OVER (ORDER BY role) - 1 AS INTEGER) AS s FROM (SELECT DISTINCT role FROM r)),
l AS (SELECT s, lead(s, 1) OVER (PARTITION BY conv_id ORDER BY turn) AS s2 FROM r JOIN s ON r.role = s.role) SELECT s AS i, s2 AS j, count(*) AS n FROM l WHERE s2 IS NOT NULL GROUP BY 1, 2""")
def conversation_role_counts(spark, d):
    c = table(spark, d, "conversations")
    roles = sorted(r[0] for r in c.select("role").distinct().collect())
    rows = c.select(F.col("conv_id").alias("traj_id"), F.col("turn").alias("t"), (F.array_position(F.array(*map(F.lit, roles)), F.col("role")) - 1).cast("int").alias("state"))
    return D.transition_counts(rows, 1)
