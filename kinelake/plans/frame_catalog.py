"""Queries of sources, frames, statistics, merged estimates and streams, each with its SQL."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions.support import register_lag_times
from kinelake.operators import clustering as C
from kinelake.operators import decomposition as L
from kinelake.operators import dtrajs as D
from kinelake.operators import moments as M
from kinelake.operators import msm as K
from kinelake.operators import statistics as S
from kinelake.operators import thermo as T
from kinelake.plans.catalog import CENTERS, CORE, F_SQL, S_SQL, events, long_table, register, rounded, samples, states, value_frames, values
from kinelake.plans.model_catalog import C_SQL, PAIRS, REV
from kinelake.session import table
from kinelake.sources import frames as Fr
from kinelake.sources import models as Store
from kinelake.streaming import incremental as I


def scratch(spark: SparkSession) -> str:
    """A new folder's name where all executors can write: below ``spark.checkpoint.dir``; a temporary one only in local mode."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="kinelake-")
    return f"{where.rstrip('/')}/kinelake-{uuid.uuid4().hex}"


# Sources and frames


@register(f"WITH {F_SQL} SELECT traj_id, count(*) AS length, 1 AS ndim FROM f GROUP BY 1")
def trajectory_info(spark, d):
    return Fr.traj_info(value_frames(spark, d))


@register(f"WITH {F_SQL} SELECT count(*) AS frames, count(*) FILTER (t % 3 = 2) AS strided FROM f")
def frame_totals(spark, d):
    f = states(spark, d)
    return long_table(spark, [(Fr.n_frames_total(f), Fr.n_frames_total(f, 3, 2))], "frames long, strided long")


@register("SELECT vec_id, CAST(embedding[10] AS DOUBLE) AS x0, CAST(embedding[3] AS DOUBLE) AS x1 FROM embeddings")
def selected_columns(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return Fr.select_columns(rows, [9, 2]).select("vec_id", F.get("x", F.lit(0)).alias("x0"), F.get("x", F.lit(1)).alias("x1"))


@register(f"WITH {F_SQL} SELECT traj_id, t, v FROM f WHERE isfinite(v)")
def finite_frames(spark, d):
    return Fr.assert_finite(value_frames(spark, d)).select("traj_id", "t", F.get("x", F.lit(0)).alias("v"))


@register(f"WITH {F_SQL}, i AS (SELECT * FROM (VALUES (0, 3, 7), (1, 1, 0), (2, 3, 1000000), (3, 999999, 0)) AS i(pos, traj_id, t)) SELECT pos, traj_id, CAST(t AS BIGINT) AS t FROM i WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.traj_id = i.traj_id AND f.t = i.t)")
def frames_out_of_range(spark, d):
    index = spark.createDataFrame([(0, 3, 7), (1, 1, 0), (2, 3, 1_000_000), (3, 999_999, 0)], "pos int, traj_id int, t bigint")
    return Fr.out_of_range(states(spark, d), index).select("pos", "traj_id", "t")


@register(f"WITH {F_SQL}, n AS (SELECT traj_id, count(*) AS n FROM f GROUP BY 1) SELECT traj_id, CAST(coalesce(sum(n) OVER (ORDER BY traj_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM n")
def trajectory_offsets(spark, d):
    got = Fr.linear_offsets(values(spark, d))
    return got.select("traj_id", F.col(next(c for c in got.columns if c not in ("traj_id", "n", "length", "count"))).cast("bigint").alias("off"))


@register(f"WITH {F_SQL}, o AS (SELECT traj_id, min(t) AS off FROM f WHERE s IN {CORE} GROUP BY 1) SELECT f.traj_id, f.t, f.s AS state FROM f JOIN o ON f.traj_id = o.traj_id AND f.t >= o.off")
def core_set_offsets_undone(spark, d):
    """Frames of rewritten trajectories under their first numbers, with the states that stood there."""
    s = states(spark, d)
    back = D.undo_offsets(D.core_set_rewrite(s, CORE).select("traj_id", "t"), D.core_set_offsets(s, CORE))
    return back.join(s, ["traj_id", "t"]).select("traj_id", "t", "state")


@register(f"WITH {F_SQL} SELECT 0 AS traj_id, CAST(row_number() OVER (ORDER BY traj_id, t) - 1 AS BIGINT) AS t, v FROM f WHERE s = 2 AND t % 2 = 0")
def frames_saved_as_one(spark, d):
    path = scratch(spark)
    index = D.state_index(states(spark, d).where("t % 2 = 0"), [2]).select(F.col("rank").alias("pos"), "traj_id", "t")
    Fr.save_traj(value_frames(spark, d), index, path)
    return spark.read.parquet(path).select("traj_id", "t", F.get("x", F.lit(0)).alias("v"))


@register(f"WITH {F_SQL} SELECT traj_id, CAST(floor(t / 3) AS BIGINT) AS t, v FROM f WHERE t % 3 = 0")
def parquet_round_trip(spark, d):
    path = scratch(spark)
    Fr.write_parquet(value_frames(spark, d), path, stride=3)
    return spark.read.parquet(path).select("traj_id", "t", F.get("x", F.lit(0)).alias("v"))


@register(f"WITH {F_SQL}, c AS (SELECT * FROM (VALUES {', '.join(f'({i}, {v})' for i, v in enumerate(CENTERS))}) AS c(c, x)), r AS (SELECT traj_id, t, c.c AS state, abs(v - c.x) AS dist, row_number() OVER (PARTITION BY traj_id, t ORDER BY abs(v - c.x), c.c) AS r FROM f, c), b AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY dist, traj_id, t) AS q FROM r WHERE r = 1) SELECT state, traj_id, t FROM b WHERE q = 1")
def closest_frames_to_centers(spark, d):
    return C.closest_frames(C.assign_sql(value_frames(spark, d), np.array(CENTERS)[:, None]))


@register(f"WITH {F_SQL} SELECT round(avg(CASE WHEN s IN (0, 4) THEN 1.0 ELSE 0.0 END), 9) AS fraction FROM f")
def active_count_fraction(spark, d):
    return long_table(spark, [(D.active_count_fraction(states(spark, d), (0, 4)),)], "fraction double").select(rounded("fraction", 9).alias("fraction"))


_STEPS = f"WITH {F_SQL}, l AS (SELECT traj_id, s AS i, lead(s, 1) OVER (PARTITION BY traj_id ORDER BY t) AS j FROM f), d AS (SELECT DISTINCT traj_id, i, j FROM l WHERE j IS NOT NULL AND traj_id IN (1, 2)) SELECT i, j FROM d WHERE traj_id = 1 {{}} SELECT i, j FROM d WHERE traj_id = 2"


def _steps(spark, d, traj: int) -> DataFrame:
    return D.counts_by_trajectory(states(spark, d).where(F.col("traj_id") == traj), 1).select("i", "j")


@register(_STEPS.format("INTERSECT"))
def common_transitions(spark, d):
    return _steps(spark, d, 1).intersect(_steps(spark, d, 2))


@register(_STEPS.format("EXCEPT"))
def exclusive_transitions(spark, d):
    return _steps(spark, d, 1).subtract(_steps(spark, d, 2))


@register("WITH RECURSIVE r(lag) AS (SELECT 1 UNION ALL SELECT lag * 2 FROM r WHERE lag * 2 <= 100) SELECT lag FROM r UNION SELECT 100 AS lag")
def lag_time_table(spark, d):
    register_lag_times(spark)
    return spark.sql("SELECT lag FROM lag_times(100, 2.0D)")


# Statistics


@register(f"WITH {F_SQL}, e AS (SELECT min(v) AS lo, max(v) AS hi, min(s) AS l2, max(s) AS h2 FROM f) SELECT CAST(least(floor((v - lo) / ((hi - lo) / 6)), 5) AS INTEGER) AS b0, CAST(least(floor((s - l2) / (CAST(h2 - l2 AS DOUBLE) / 3)), 2) AS INTEGER) AS b1, count(*) AS n FROM f, e GROUP BY 1, 2")
def histogram_of_dimensions(spark, d):
    rows = events(spark, d).select("traj_id", "t", F.array(F.col("value"), F.col("state").cast("double")).alias("x"))
    return S.histogram_nd(rows, [0, 1], [6, 3]).select(F.get("cell", F.lit(0)).alias("b0"), F.get("cell", F.lit(1)).alias("b1"), "n")


@register(f"WITH {PAIRS}, z AS (SELECT x, y, x * y AS z FROM r), e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM z) SELECT CAST(least(floor((x - x0) / ((x1 - x0) / 8)), 7) AS INTEGER) AS bx, CAST(least(floor((y - y0) / ((y1 - y0) / 8)), 7) AS INTEGER) AS \"by\", round(avg(z), 6) AS z FROM z, e GROUP BY 1, 2")
def grid_of_means(spark, d):
    from kinelake.operators.lag import lagged_pairs

    rows = lagged_pairs(values(spark, d), 1, "v").select("x", "y", (F.col("x") * F.col("y")).alias("z"))
    return S.grid_means(rows, 8).withColumn("z", rounded("z", 6))


@register(f"WITH {F_SQL} SELECT s AS state, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.05), 6) AS lo, round(quantile_cont(v, 0.95), 6) AS hi FROM f GROUP BY 1")
def sample_statistics(spark, d):
    got = S.sample_statistics(events(spark, d).select("state", F.col("value").alias("p")), ["state"], conf=0.9)
    return got.select("state", *[rounded(c, 6).alias(c) for c in ("mean", "std", "lo", "hi")])


# Ensembles


@register(f"WITH {S_SQL}, n AS (SELECT count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2 FROM q) SELECT traj_id, t, round(ln(n0 * exp(-b0) + n1 * exp(0.5 - b1) + n2 * exp(-0.25 - b2)), 7) AS f FROM q, n WHERE b0 < 500 AND b1 < 500 AND b2 < 500")
def mbar_pointwise_energies(spark, d):
    """Pointwise free energies under given ensemble energies."""
    s = samples(spark, d)
    n = [s.where(f"k = {k}").count() for k in range(3)]
    near = s.where(" AND ".join(f"get(b, {k}) < 500" for k in range(3)))
    return T.mbar_pointwise(near, np.array([0.0, 0.5, -0.25]), np.array(n)).withColumn("f", rounded("f", 7))


@register(f"WITH {S_SQL} SELECT traj_id, t, k, CASE WHEN (k, s) IN ((0, 1), (1, 2), (2, 0)) THEN s ELSE -1 END AS i FROM q")
def samples_restricted(spark, d):
    keep = np.zeros((3, 5), bool)
    keep[[0, 1, 2], [1, 2, 0]] = True
    return T.restrict_samples(samples(spark, d), keep).select("traj_id", "t", "k", "i")


@register(f"WITH {F_SQL}, h AS (SELECT traj_id, t, v, CASE WHEN traj_id % 2 = 0 THEN 300.0 ELSE 330.0 END AS temp FROM f) SELECT traj_id, t, CASE WHEN temp < 310 THEN 0 ELSE 1 END AS k, CAST(0 AS DOUBLE) AS b0, round((1 / (0.00198720425864083e0 * 330e0) - 1 / (0.00198720425864083e0 * 300e0)) * v, 9) AS b1 FROM h")
def multi_temperature_bias(spark, d):
    rows = values(spark, d).withColumn("temp", F.when(F.col("traj_id") % 2 == 0, 300.0).otherwise(330.0)).withColumnRenamed("v", "energy")
    got, _, _ = T.multi_temperature_data(rows)
    return got.select("traj_id", "t", "k", F.get("b", F.lit(0)).alias("b0"), rounded(F.get("b", F.lit(1)), 9).alias("b1"))


# Estimates merged from two halves of the trajectories


def _halves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("traj_id % 2 = 0"), rows.where("traj_id % 2 = 1")


def _merged(estimator, rows: DataFrame):
    for half in _halves(rows):
        estimator = estimator.partial_fit(half)
    return estimator


@register(f"WITH {PAIRS} SELECT round(var_samp(x), 6) AS c00, round(covar_samp(x, y), 6) AS c0t, round(var_samp(y), 6) AS ctt FROM r")
def incremental_covariance(spark, d):
    c = _merged(M.LaggedCovariance(1, remove="data"), value_frames(spark, d))
    return long_table(spark, [(float(c.c00[0, 0]), float(c.c0t[0, 0]), float(c.ctt[0, 0]))], "c00 double, c0t double, ctt double").select(*[rounded(n, 6).alias(n) for n in ("c00", "c0t", "ctt")])


@register(f"WITH {F_SQL} SELECT round(var_samp(v), 6) AS variance, round(avg(v), 7) AS mean FROM f")
def incremental_pca(spark, d):
    m = _merged(L.PCA(dim=1), value_frames(spark, d))
    return long_table(spark, [(float(m.eigenvalues[0]), float(m.center[0]))], "variance double, mean double").select(rounded("variance", 6).alias("variance"), rounded("mean", 7).alias("mean"))


@register(f"WITH {PAIRS}, m AS (SELECT (avg(x) + avg(y)) / 2 AS m FROM r) SELECT round(2 * sum((x - m) * (y - m)) / sum((x - m) * (x - m) + (y - m) * (y - m)), 9) AS eigenvalue FROM r, m")
def incremental_tica(spark, d):
    m = _merged(L.TICA(lag=1, dim=1), value_frames(spark, d))
    return long_table(spark, [(float(np.real(m.eigenvalues[0])),)], "eigenvalue double").select(rounded("eigenvalue", 9).alias("eigenvalue"))


@register(f"WITH {PAIRS} SELECT round(abs(corr(x, y)), 9) AS singular_value FROM r")
def incremental_vamp(spark, d):
    m = _merged(L.VAMP(lag=1, dim=1), value_frames(spark, d))
    return long_table(spark, [(float(m.singular_values[0]),)], "singular_value double").select(rounded("singular_value", 9).alias("singular_value"))


_KOOPMAN = f"WITH {PAIRS}, u AS (SELECT avg(x) AS mx, (avg(y) - avg(x)) / (var_pop(x) - covar_pop(x, y)) AS u FROM r) SELECT traj_id, t, round(1 + (v - mx) * u, 8) AS w FROM f, u"


@register(_KOOPMAN)
def koopman_weights(spark, d):
    f = value_frames(spark, d)
    return L.Koopman(1).fit(f).weights(f).select("traj_id", "t", rounded("w", 8).alias("w"))


@register(_KOOPMAN)
def incremental_koopman(spark, d):
    f = value_frames(spark, d)
    return _merged(L.Koopman(1), f).weights(f).select("traj_id", "t", rounded("w", 8).alias("w"))


@register(f"WITH {PAIRS}, u AS (SELECT avg(x) AS mx, (avg(y) - avg(x)) / (var_pop(x) - covar_pop(x, y)) AS u FROM r) SELECT round(sum(v * (1 + (v - mx) * u)) / sum(1 + (v - mx) * u), 6) AS mean FROM f, u")
def koopman_weighted_mean(spark, d):
    """Frames under their equilibrium weights: the weighted first moment."""
    f = value_frames(spark, d)
    m = M.moments_xx(L.Koopman(1).fit(f).weights(f), weight="w")
    return long_table(spark, [(float(m.mean_x[0]),)], "mean double").select(rounded("mean", 6).alias("mean"))


# A stored model, and streams


@register(f"WITH RECURSIVE {REV} SELECT i, round(pi, 8) AS pi FROM pi")
def model_store_round_trip(spark, d):
    m = K.MSMEstimator(1).fit(states(spark, d)).model
    with tempfile.TemporaryDirectory(prefix="kinelake-") as folder:  # the store is the driver's own
        Store.save_model(m, folder, "kinetics")
        m = Store.load_model(folder, "kinetics")
    return long_table(spark, [(i, float(x)) for i, x in enumerate(m.pi)], "i int, pi double").withColumn("pi", rounded("pi", 8))


@register(f"WITH {C_SQL} SELECT i, j, CAST(n AS BIGINT) AS n FROM c")
def streamed_transition_counts(spark, d):
    """Counts of keyed state over a stream of frames, summed over trajectories."""
    path, name = scratch(spark), f"counts_{uuid.uuid4().hex}"
    rows = states(spark, d)
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    q = I.streaming_counts(stream, 1).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).groupBy("traj_id", "i", "j").agg(F.max("n").alias("n")).groupBy("i", "j").agg(F.sum("n").alias("n"))


@register(f"WITH {C_SQL} SELECT i, j, CAST(n AS BIGINT) AS n FROM c")
def batch_merged_transition_counts(spark, d):
    """Counts of one micro-batch merged on the driver, a row for each pair of states."""
    path = scratch(spark)
    rows = states(spark, d)
    rows.write.parquet(path)
    got = I.run_available(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 10_000).parquet(path), I.CountMerger(1), scratch(spark))
    return long_table(spark, [(i, j, int(n)) for (i, j), n in sorted(got.counts.items())], "i int, j int, n long")


@register("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2")
def streamed_event_windows(spark, d):
    name = f"windows_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    q = I.windowed_events(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", rounded("v", 4).alias("v"))
