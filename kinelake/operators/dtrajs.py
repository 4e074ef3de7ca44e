"""Statistics of discrete trajectories: histograms, transition counts, core sets, samples of frames."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinelake.operators.lag import BLOCK, blocked, lagged


def state_histogram(dtrajs: DataFrame, ignore_negative: bool = False) -> DataFrame:
    """``state, n`` for every state from 0 to the largest; a negative state raises unless ignored."""
    seen = F.col("state") if ignore_negative else F.when(F.col("state") >= 0, F.col("state")).otherwise(F.raise_error(F.lit("negative state")).cast("int"))
    counts = dtrajs.select(seen.alias("state")).where("state >= 0").groupBy("state").agg(F.count("*").alias("n"))
    every = counts.agg(F.max("state").alias("m")).where("m IS NOT NULL").select(F.explode(F.sequence(F.lit(0), "m")).alias("state"))
    return every.join(counts, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def visited_states(dtrajs: DataFrame) -> DataFrame:
    return dtrajs.where("state >= 0").select("state").distinct()


def number_of_states(dtrajs: DataFrame, only_used: bool = False) -> int:
    top, used = dtrajs.where("state >= 0").agg(F.max("state"), F.count_distinct("state")).first()
    return used if only_used else (top + 1 if top is not None else 0)


def transition_counts(dtrajs: DataFrame, lag: int = 1, mode: str = "sliding", block: int = BLOCK) -> DataFrame:
    """``i, j, n``.  ``sliding`` counts every pair ``t, t + lag``; ``sample`` those with ``t`` a multiple of the lag.

    Pairs with an unassigned end aren't counted.
    """
    if mode not in ("sliding", "sample"):
        raise ValueError("count mode is sliding or sample; see effective_counts for the third")
    pairs = lagged(dtrajs.select("traj_id", "t", "state"), lag, ["state"], block).where(f"state >= 0 AND state_{lag} >= 0")
    if mode == "sample":
        pairs = pairs.where(F.col("t") % lag == 0)
    return pairs.groupBy(F.col("state").alias("i"), F.col(f"state_{lag}").alias("j")).agg(F.count("*").alias("n"))


def transition_counts_lags(dtrajs: DataFrame, lags: Sequence[int], block: int = BLOCK) -> DataFrame:
    """``lag, i, j, n`` for all lags from one pass over the frames."""
    wide = lagged(dtrajs.select("traj_id", "t", "state"), lags, ["state"], block).where("state >= 0")
    long = wide.select(F.col("state").alias("i"), F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"state_{k}").alias("j")) for k in lags])).alias("p"))
    return long.select("p.lag", "i", "p.j").where("j >= 0").groupBy("lag", "i", "j").agg(F.count("*").alias("n"))


def two_step_counts(dtrajs: DataFrame, lag: int, block: int = BLOCK) -> DataFrame:
    """``i, mid, j, n``: triples at ``t, t + lag, t + 2 lag``."""
    wide = lagged(dtrajs.select("traj_id", "t", "state"), [lag, 2 * lag], ["state"], block).where(f"state >= 0 AND state_{lag} >= 0 AND state_{2 * lag} >= 0")
    return wide.groupBy(F.col("state").alias("i"), F.col(f"state_{lag}").alias("mid"), F.col(f"state_{2 * lag}").alias("j")).agg(F.count("*").alias("n"))


def counts_by_trajectory(dtrajs: DataFrame, lag: int, block: int = BLOCK) -> DataFrame:
    """``traj_id, i, j, n``; the material of bootstraps over trajectories."""
    pairs = lagged(dtrajs.select("traj_id", "t", "state"), lag, ["state"], block).where(f"state >= 0 AND state_{lag} >= 0")
    return pairs.groupBy("traj_id", F.col("state").alias("i"), F.col(f"state_{lag}").alias("j")).agg(F.count("*").alias("n"))


def bootstrap_counts(by_traj: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``sample, i, j, n``: counts with every trajectory weighted by a Poisson draw, ``n`` times.

    A draw is a hash of sample and trajectory, so reruns agree and trajectories need not be gathered.
    """
    u = _random_key(seed, "sample", "traj_id") / float(1 << 60)
    edges = np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 12)]))
    weight = sum(F.when(u >= float(e), 1).otherwise(0) for e in edges)
    rows = by_traj.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("w", weight).where("w > 0")
    return rows.groupBy("sample", "i", "j").agg(F.sum(F.col("n") * F.col("w")).alias("n"))


def effective_counts(dtrajs: DataFrame, lag: int, max_visits: int | None = None, block: int = BLOCK) -> DataFrame:
    """``i, j, n``: sliding counts times the share of them that is independent.

    For every state the visits of a trajectory are a series, and whether a visit is followed by ``j`` a lag later is its
    indicator.  Its autocorrelation over up to ``max_visits`` visits (default: the lag, as far as windows overlap), summed to
    the first value that isn't positive, gives the statistical inefficiency that scales ``(i, j)``.
    """
    reach = max_visits or lag
    pairs = lagged(dtrajs.select("traj_id", "t", "state"), lag, ["state"], block).where(f"state >= 0 AND state_{lag} >= 0")
    pairs = pairs.select("traj_id", "t", F.col("state").alias("i"), F.col(f"state_{lag}").alias("j"), F.floor(F.col("t") / block).alias("b"))
    per = pairs.groupBy("traj_id", "i", "b").agg(F.count("*").alias("c"))
    before = Window.partitionBy("traj_id", "i").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("traj_id", "i", "b", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("traj_id", "i", "b").orderBy("t")
    visits = pairs.withColumn("r", F.row_number().over(inside) - 1).join(per, ["traj_id", "i", "b"]).select("traj_id", "i", "j", (F.col("r") + F.col("before")).cast("bigint").alias("t"))
    wide = lagged(visits, list(range(1, reach + 1)), ["j"], block, keys=("traj_id", "i"))
    steps = F.array(F.struct(F.lit(0).alias("k"), F.lit(True).alias("same")), *[F.struct(F.lit(k).alias("k"), (F.col(f"j_{k}") == F.col("j")).alias("same")) for k in range(1, reach + 1)])
    cells = wide.select("i", "j", F.explode(steps).alias("s")).where("s.same IS NOT NULL").groupBy("i", "j", "s.k").agg(F.count("*").alias("n"), F.count_if(F.col("s.same")).alias("same"))
    of_state = Window.partitionBy("i", "k")
    cells = cells.withColumn("all", F.sum("n").over(of_state))
    first = cells.where("k = 0").select("i", "j", F.col("n").alias("c"), (F.col("n") / F.col("all")).alias("p"), F.col("all").alias("visits"))
    acf = F.when(F.col("p") < 1, (F.col("same") / F.col("all") - F.col("p") * F.col("p")) / (F.col("p") - F.col("p") * F.col("p"))).otherwise(0.0)
    rows = cells.where("k > 0").join(first, ["i", "j"]).select("i", "j", "k", acf.alias("a"), "visits")
    stop = Window.partitionBy("i", "j").orderBy("k")
    rows = rows.withColumn("low", F.min("a").over(stop)).where("low > 0")
    sums = rows.groupBy("i", "j").agg(F.sum(F.col("a") * (1 - F.col("k") / F.col("visits"))).alias("sum"))
    return first.join(sums, ["i", "j"], "left").select("i", "j", (F.col("c") / (1 + 2 * F.greatest(F.coalesce("sum", F.lit(0.0)), F.lit(0.0)))).alias("n"))


def count_submatrix(counts: DataFrame, states: Sequence[int]) -> DataFrame:
    """Counts restricted to ``states`` and renumbered in their order."""
    spark = counts.sparkSession
    m = spark.createDataFrame([(int(s), k) for k, s in enumerate(states)], "state int, k int")
    a, b = F.broadcast(m.select(F.col("state").alias("i"), F.col("k").alias("ki"))), F.broadcast(m.select(F.col("state").alias("j"), F.col("k").alias("kj")))
    return counts.join(a, "i").join(b, "j").select(F.col("ki").alias("i"), F.col("kj").alias("j"), "n")


def row_normalized(counts: DataFrame) -> DataFrame:
    """``i, j, p``: the non-reversible maximum-likelihood transition matrix."""
    total = counts.groupBy("i").agg(F.sum("n").alias("total"))
    return counts.join(total, "i").select("i", "j", (F.col("n").cast("double") / F.col("total")).alias("p"))


def counts_matrix(counts: DataFrame, n: int | None = None, limit: int = 20_000) -> np.ndarray:
    """A dense matrix on the driver; refused above ``limit`` states."""
    rows = counts.toArrow()
    i, j, v = (rows[c].to_numpy() for c in ("i", "j", "n"))
    n = n if n is not None else int(max(i.max(initial=-1), j.max(initial=-1))) + 1
    if n > limit:
        raise ValueError(f"{n} states make no dense matrix")
    out = np.zeros((n, n))
    np.add.at(out, (i, j), v.astype(float))
    return out


# Core sets


def core_set_milestones(dtrajs: DataFrame, core: Sequence[int], block: int = BLOCK) -> DataFrame:
    """``traj_id, t, state``: states outside the core become the last core state visited; what comes before the first is cut.

    The last core state before a block is found once for each block, so a long trajectory needs no single task.
    """
    kept = core_set_rewrite(dtrajs, core).withColumn("b", F.floor(F.col("t") / block))
    known = F.when(F.col("state") >= 0, F.col("state"))
    inside = Window.partitionBy("traj_id", "b").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    ends = kept.groupBy("traj_id", "b").agg(F.max_by(known, F.when(known.isNotNull(), F.col("t"))).alias("end"))
    carried = ends.withColumn("carry", F.last("end", True).over(Window.partitionBy("traj_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))).drop("end")
    filled = kept.withColumn("f", F.last(known, True).over(inside)).join(carried, ["traj_id", "b"])
    return filled.select("traj_id", "t", F.coalesce("f", "carry").alias("state"))


def core_set_rewrite(dtrajs: DataFrame, core: Sequence[int]) -> DataFrame:
    """``traj_id, t, state``: states outside the core are -1, trajectories begin at their first core frame, those without go."""
    inside = F.col("state").isin([int(c) for c in core])
    first = core_set_offsets(dtrajs, core).where("off IS NOT NULL")
    return dtrajs.join(first, "traj_id").where("t >= off").select("traj_id", (F.col("t") - F.col("off")).alias("t"), F.when(inside, F.col("state")).otherwise(-1).alias("state"))


def core_set_offsets(dtrajs: DataFrame, core: Sequence[int]) -> DataFrame:
    """``traj_id, off``: the first core frame (null: none)."""
    inside = F.col("state").isin([int(c) for c in core])
    return dtrajs.groupBy("traj_id").agg(F.min(F.when(inside, F.col("t"))).alias("off"))


def undo_offsets(index: DataFrame, offsets: DataFrame) -> DataFrame:
    """Frame numbers of rewritten trajectories mapped back to the originals."""
    return index.join(offsets, "traj_id").withColumn("t", F.col("t") + F.col("off")).drop("off")


# Ensembles


def ensemble_runs(dtrajs: DataFrame) -> DataFrame:
    """``dtrajs`` with ``run``: the number of changes of the ensemble ``k`` so far, and ``t`` counted inside the run."""
    w = Window.partitionBy("traj_id").orderBy("t")
    rows = dtrajs.withColumn("brk", (F.col("k") != F.lag("k").over(w)).cast("int"))
    rows = rows.withColumn("run", F.coalesce(F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).drop("brk")
    return rows.withColumn("t0", F.col("t")).withColumn("t", F.col("t") - F.min("t").over(Window.partitionBy("traj_id", "run")))


def ensemble_counts(dtrajs: DataFrame, lag: int) -> DataFrame:
    """``k, i, j, n``: transitions inside each ensemble, broken at every change of ensemble."""
    rows = lagged(ensemble_runs(dtrajs), lag, ["state"], keys=("traj_id", "run")).where(f"state >= 0 AND state_{lag} >= 0")
    return rows.groupBy("k", F.col("state").alias("i"), F.col(f"state_{lag}").alias("j")).agg(F.count("*").alias("n"))


def ensemble_state_counts(dtrajs: DataFrame) -> DataFrame:
    """``k, i, n``."""
    return dtrajs.where("state >= 0").groupBy("k", F.col("state").alias("i")).agg(F.count("*").alias("n"))


# Frames by state


def state_index(dtrajs: DataFrame, subset: Sequence[int] | None = None, block: int = BLOCK) -> DataFrame:
    """``state, traj_id, t, rank``: the frames of each state in order; a row for each frame, so no state is gathered.

    The rank is found in three levels: inside (state, trajectory, block of frames), then over a trajectory's blocks, then over
    the trajectories of a state, so one long trajectory is many tasks.
    """
    rows = dtrajs.where("state >= 0") if subset is None else dtrajs.where(F.col("state").isin([int(s) for s in subset]))
    rows = rows.withColumn("block", F.floor(F.col("t") / block))
    per = rows.groupBy("state", "traj_id", "block").agg(F.count("*").alias("n"))
    of_traj = per.groupBy("state", "traj_id").agg(F.sum("n").alias("m"))
    earlier = lambda order, *by: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    of_traj = of_traj.select("state", "traj_id", F.coalesce(F.sum("m").over(earlier("traj_id", "state")), F.lit(0)).alias("of_traj"))
    of_block = F.coalesce(F.sum("n").over(earlier("block", "state", "traj_id")), F.lit(0))
    per = per.select("state", "traj_id", "block", of_block.alias("of_block")).join(of_traj, ["state", "traj_id"])
    inside = Window.partitionBy("state", "traj_id", "block").orderBy("t")
    ranked = rows.withColumn("r", F.row_number().over(inside) - 1).join(per, ["state", "traj_id", "block"])
    return ranked.select("state", "traj_id", "t", (F.col("r") + F.col("of_block") + F.col("of_traj")).cast("bigint").alias("rank"))


def _random_key(seed: int, *key: str):
    """A whole number from 0 below 2**60 that ``seed`` and ``key`` decide: the first 15 hex digits of an MD5."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def sample_by_state(index: DataFrame, n: int, replace: bool = True, seed: int = 42) -> DataFrame:
    """``state, draw, traj_id, t``: ``n`` frames of each state; without replacement at most all of them.

    Without replacement the frames of least hash are taken: a filter on the rank itself, so every task passes on ``n`` at most.
    """
    if not replace:
        w = Window.partitionBy("state").orderBy(_random_key(seed, "state", "traj_id", "t"))
        ranked = index.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
        return ranked.select("state", (F.col("r") - 1).alias("draw"), "traj_id", "t")
    sizes = index.groupBy("state").agg(F.count("*").alias("size"))
    draws = sizes.select("state", "size", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    draws = draws.withColumn("rank", F.pmod(_random_key(seed, "state", "draw"), "size"))
    return draws.join(index, ["state", "rank"]).select("state", "draw", "traj_id", "t")


def sample_by_sequence(index: DataFrame, sequence: Sequence[int], seed: int = 42) -> DataFrame:
    """``pos, state, traj_id, t``: a random frame for each element of a sequence of states."""
    seq = index.sparkSession.createDataFrame([(k, int(s)) for k, s in enumerate(sequence)], "pos int, state int")
    sizes = index.groupBy("state").agg(F.count("*").alias("size"))
    want = seq.join(sizes, "state").withColumn("rank", F.pmod(_random_key(seed, "pos"), "size"))
    return want.join(index, ["state", "rank"]).select("pos", "state", "traj_id", "t")


def sample_by_distributions(index: DataFrame, distributions: Sequence[np.ndarray], n: int, seed: int = 42) -> DataFrame:
    """``dist, pos, state, traj_id, t``: states drawn from each distribution, then a random frame of each."""
    rng = np.random.default_rng(seed)
    out = None
    for k, p in enumerate(distributions):
        p = np.asarray(p, float)
        got = sample_by_sequence(index, rng.choice(len(p), n, p=p / p.sum()), seed + k).select(F.lit(k).alias("dist"), "*")
        out = got if out is None else out.unionByName(got)
    return out


# Maps between full and active states


def active_table(spark, active: Sequence[int]) -> DataFrame:
    return spark.createDataFrame([(int(s), k) for k, s in enumerate(active)], "state int, active int")


def to_active(dtrajs: DataFrame, active: Sequence[int]) -> DataFrame:
    """States renumbered to the active set, -1 outside."""
    m = F.broadcast(active_table(dtrajs.sparkSession, active))
    return dtrajs.join(m, "state", "left").select("traj_id", "t", F.coalesce("active", F.lit(-1)).alias("state"))


def globalize(values: np.ndarray, active: Sequence[int], n: int, default: float = 0.0, axes: Sequence[int] = (0,)) -> np.ndarray:
    """Values over the active set scattered into all ``n`` states along ``axes``."""
    out = np.asarray(values)
    for axis in axes:
        shape = list(out.shape)
        shape[axis] = n
        full = np.full(shape, default, out.dtype if np.issubdtype(out.dtype, np.inexact) else float)
        place = [slice(None)] * out.ndim
        place[axis] = np.asarray(active)
        full[tuple(place)] = out
        out = full
    return out


def trajectory_weights(dtrajs: DataFrame, pi: np.ndarray, active: Sequence[int]) -> DataFrame:
    """``traj_id, t, w``: the stationary weight of each frame, in total 1; frames outside the active set weigh 0."""
    spark = dtrajs.sparkSession
    hist = dtrajs.where(F.col("state").isin([int(s) for s in active])).groupBy("state").agg(F.count("*").alias("n"))
    p = spark.createDataFrame([(int(s), float(v)) for s, v in zip(active, pi, strict=True)], "state int, pi double")
    w = hist.join(F.broadcast(p), "state")
    total = w.agg(F.sum("pi").alias("total"))
    w = w.join(F.broadcast(total)).select("state", (F.col("pi") / F.col("n") / F.col("total")).alias("w"))
    return dtrajs.join(F.broadcast(w), "state", "left").select("traj_id", "t", F.coalesce("w", F.lit(0.0)).alias("w"))


def active_count_fraction(dtrajs: DataFrame, active: Sequence[int]) -> float:
    inside = F.sum(F.col("state").isin([int(s) for s in active]).cast("int"))
    got = dtrajs.where("state >= 0").agg(inside, F.count("*")).first()
    return (got[0] or 0) / got[1] if got[1] else 0.0


def fraction_of_frames(dtrajs: DataFrame, lags: Sequence[int]) -> DataFrame:
    """``lag, fraction``: the share of frames in trajectories longer than the lag."""
    n = dtrajs.groupBy("traj_id").agg(F.count("*").alias("n"))
    rows = n.select("n", F.explode(F.array(*map(F.lit, lags))).alias("lag"))
    return rows.groupBy("lag").agg((F.sum(F.when(F.col("n") > F.col("lag"), F.col("n")).otherwise(0)) / F.sum("n")).alias("fraction"))


def block_split(dtrajs: DataFrame, size: int, lag: int = 1) -> DataFrame:
    """Trajectories cut into blocks that overlap by the lag, so that no transition is lost or counted twice."""
    rows = blocked(dtrajs, lag, size)
    return rows.select(F.xxhash64("traj_id", "block").alias("traj_id"), F.col("traj_id").alias("source"), "block", (F.col("t") - F.col("block") * max(size, lag)).alias("t"), "state")


def split_in_halves(dtrajs: DataFrame, seed: int = 0) -> DataFrame:
    """``dtrajs`` with ``half``: trajectories dealt to two halves by a hash."""
    return dtrajs.withColumn("half", F.pmod(F.xxhash64(F.lit(seed), "traj_id"), F.lit(2)).cast("int"))


def state_means(dtrajs: DataFrame, values: DataFrame) -> DataFrame:
    """``state, mean, n`` of a frame-wise value ``v``."""
    return dtrajs.join(values, ["traj_id", "t"]).where("state >= 0").groupBy("state").agg(F.avg("v").alias("mean"), F.count("*").alias("n"))
