import numpy as np

from kinelake.operators.moments import moments_lagged
from kinelake.sources import frames as Fr
from kinelake.streaming.incremental import CountMerger, MomentMerger, run_available, streaming_counts, windowed_events

D = [[0, 1, 1, 0, 2, 1, 0, 0], [2, 2, 1, 0, 1, 1, 1, 0]]


def files(spark, tmp_path, cut=4):
    df = Fr.from_dtrajs(spark, D)
    for k in range(2):
        df.where(f"t >= {cut * k} AND t < {cut * (k + 1)}").coalesce(1).write.parquet(str(tmp_path / "in" / f"b={k}"))
    return spark.readStream.schema("traj_id int, t bigint, state int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def test_state_joins_batches(spark, tmp_path):
    q = streaming_counts(files(spark, tmp_path), 2).writeStream.outputMode("update").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT i, j, sum(n) AS n FROM (SELECT traj_id, i, j, max(n) AS n FROM counts GROUP BY traj_id, i, j) GROUP BY i, j").collect()
    want = np.zeros((3, 3))
    for d in D:
        np.add.at(want, (d[:-2], d[2:]), 1)
    assert {(r.i, r.j): r.n for r in got} == {(i, j): want[i, j] for i, j in np.argwhere(want)}


def test_merging_batches(spark, tmp_path):
    merger = run_available(files(spark, tmp_path), CountMerger(1), str(tmp_path / "cp"))
    want = np.zeros((3, 3))
    for d in D:
        for part in (d[:4], d[4:]):
            np.add.at(want, (part[:-1], part[1:]), 1)
    assert (merger.matrix() == want).all()
    before = dict(merger.counts)
    merger(Fr.from_dtrajs(spark, D), next(iter(merger.done)))  # the same batch again
    assert merger.counts == before
    m = MomentMerger(1)
    x = Fr.from_arrays(spark, [np.arange(6.0), np.arange(4.0) ** 2])
    m(x.where("traj_id = 0"), 0)
    m(x.where("traj_id = 1"), 1)
    assert np.allclose(m.moments.xy, moments_lagged(x, 1).xy)


def test_event_windows(spark, tmp_path):
    rows = [("2024-01-01 00:00:01", "view", 1.0), ("2024-01-01 00:03:00", "view", 2.0), ("2024-01-01 00:06:00", "click", 4.0)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("CAST(ts AS timestamp) AS ts", "event_type", "value")
    df.write.parquet(str(tmp_path / "ev"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev"))
    q = windowed_events(s).writeStream.outputMode("complete").format("memory").queryName("wins").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.event_type, r.n, r.v) for r in spark.table("wins").collect()) == [("click", 1, 4.0), ("view", 2, 3.0)]
