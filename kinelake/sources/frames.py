"""Trajectories as DataFrames: ``frames(traj_id, t, x)`` and ``dtrajs(traj_id, t, state)``.

``t`` counts the frames of a trajectory from 0 without gaps.  Files become one trajectory each, in the order they
are named; a file is read by one task, and many files by many tasks.
"""

from __future__ import annotations

import glob
import io
import os
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FRAMES = "traj_id int, t bigint, x array<double>"
DTRAJS = "traj_id int, t bigint, state int"
#: Rows up to which a table of files is broadcast (about 200 bytes each).
BROADCAST_ROWS = 100_000
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def events_trajectories(events: DataFrame) -> DataFrame:
    """Each user's events in time order: ``traj_id, t, state, value``; the state is the place of the type in the alphabet."""
    # Renamed first: the window's partitioning is then by traj_id, which later windows by (traj_id, block) can use.
    rows = events.select(F.col("user_id").alias("traj_id"), "ts", "event_id", "event_type", "value")
    w = Window.partitionBy("traj_id").orderBy("ts", "event_id")
    state = (F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")) - 1).cast("int")
    return rows.select("traj_id", (F.row_number().over(w) - 1).cast("bigint").alias("t"), state.alias("state"), "value")


def embedding_trajectories(embeddings: DataFrame) -> DataFrame:
    """Embeddings as 64-dimensional frames: a trajectory for each label, ordered by ``vec_id``."""
    rows = embeddings.select(F.col("label").alias("traj_id"), "vec_id", F.col("embedding").cast("array<double>").alias("x"))
    w = Window.partitionBy("traj_id").orderBy("vec_id")
    return rows.select("traj_id", (F.row_number().over(w) - 1).cast("bigint").alias("t"), "x")


def from_arrays(spark: SparkSession, trajs: np.ndarray | Sequence[np.ndarray]) -> DataFrame:
    """In-memory trajectories; a one-dimensional array is one column, unequal dimensions raise."""
    trajs = [trajs] if isinstance(trajs, np.ndarray) else list(trajs)
    trajs = [np.asarray(x, float) for x in trajs]
    trajs = [x[:, None] if x.ndim == 1 else x.reshape(len(x), -1) for x in trajs]
    if len({x.shape[1] for x in trajs}) > 1:
        raise ValueError("all trajectories must have the same dimension")
    tables = [_frames_table(i, x) for i, x in enumerate(trajs)]
    if not tables:
        return spark.createDataFrame([], FRAMES)
    return spark.createDataFrame(pa.concat_tables(tables)).select(F.col("traj_id").cast("int"), "t", "x")


def _frames_table(traj_id: int, x: np.ndarray) -> pa.Table:
    ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.table({"traj_id": pa.array(np.full(len(x), traj_id, np.int32)), "t": pa.array(np.arange(len(x))), "x": pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x, float).ravel()))})


def from_dtrajs(spark: SparkSession, dtrajs: np.ndarray | Sequence) -> DataFrame:
    """In-memory discrete trajectories; ``-1`` is unassigned, anything below raises."""
    one = isinstance(dtrajs, np.ndarray) or (len(dtrajs) and np.ndim(dtrajs[0]) == 0)
    arrays = [np.asarray(d, int) for d in ([dtrajs] if one else dtrajs)]
    if any((d < -1).any() for d in arrays):
        raise ValueError("states below -1 are illegal")
    tables = [pa.table({"traj_id": pa.array(np.full(len(d), i, np.int32)), "t": pa.array(np.arange(len(d))), "state": pa.array(d.astype(np.int32))}) for i, d in enumerate(arrays) if len(d)]
    return spark.createDataFrame(pa.concat_tables(tables)) if tables else spark.createDataFrame([], DTRAJS)


def get_output(frames: DataFrame, column: str = "x", dimensions: Sequence[int] | None = None, stride: int = 1, skip: int = 0) -> list[np.ndarray]:
    """Materialise on the driver, trajectory by trajectory, on explicit request only."""
    rows = strided(frames, stride, skip)
    if dimensions is not None:
        rows = select_columns(rows, dimensions)
    out: dict[int, list] = {}
    for r in rows.select("traj_id", "t", column).orderBy("traj_id", "t").toLocalIterator(prefetchPartitions=True):
        out.setdefault(r[0], []).append(r[2])
    return [np.array(v) for v in out.values()]


# Row-level selections


def strided(frames: DataFrame, stride: int = 1, skip: int = 0) -> DataFrame:
    """Frames ``skip, skip + stride, ...`` of each trajectory, numbered anew."""
    if stride == 1 and skip == 0:
        return frames
    return frames.where((F.col("t") >= skip) & ((F.col("t") - skip) % stride == 0)).withColumn("t", F.floor((F.col("t") - skip) / stride))


def select_columns(frames: DataFrame, dims: Sequence[int]) -> DataFrame:
    return frames.withColumn("x", F.array(*[F.get("x", F.lit(int(d))) for d in dims]))


def lengths(frames: DataFrame, stride: int = 1, skip: int = 0) -> DataFrame:
    """``traj_id, length`` after stride and skip."""
    return strided(frames, stride, skip).groupBy("traj_id").agg(F.count("*").alias("length"))


def n_frames_total(frames: DataFrame, stride: int = 1, skip: int = 0) -> int:
    return strided(frames, stride, skip).count()


def assert_finite(frames: DataFrame) -> DataFrame:
    """The frames; the job fails if a value is NaN or infinite."""
    good = F.forall("x", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    return frames.withColumn("x", F.when(good, F.col("x")).otherwise(F.raise_error(F.lit("a frame holds NaN or an infinite value"))))


def assert_uniform(frames: DataFrame) -> int:
    """The dimension all frames share; raises if there are several."""
    lo, hi = frames.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if lo != hi:
        raise ValueError(f"frames have between {lo} and {hi} dimensions")
    return lo or 0


def gather(frames: DataFrame, index: DataFrame) -> DataFrame:
    """The frames of an index ``pos, traj_id, t`` in its order, duplicates kept; ``found`` is false out of range."""
    rows = index.join(frames.withColumn("found", F.lit(True)), ["traj_id", "t"], "left")
    return rows.withColumn("found", F.coalesce("found", F.lit(False)))


def out_of_range(frames: DataFrame, index: DataFrame) -> DataFrame:
    """Entries of an index that name no frame."""
    return index.join(frames, ["traj_id", "t"], "left_anti")


def save_traj(frames: DataFrame, index: DataFrame, path: str) -> None:
    """Write the frames of an index as one trajectory; raises if one is out of range."""
    if not out_of_range(frames, index).isEmpty():
        raise ValueError("the index names frames that do not exist")
    rows = gather(frames, index).select(F.lit(0).alias("traj_id"), F.col("pos").cast("bigint").alias("t"), "x")
    rows.repartitionByRange("t").sortWithinPartitions("t").write.mode("errorifexists").parquet(path)


def save_trajs(frames: DataFrame, index: DataFrame, path: str) -> None:
    """Write several index sets (``set_id, pos, traj_id, t``), a folder for each."""
    rows = gather(frames, index).select("set_id", F.col("pos").cast("bigint").alias("t"), "x")
    rows.repartition("set_id").sortWithinPartitions("set_id", "t").write.partitionBy("set_id").mode("errorifexists").parquet(path)


# Slices over (trajectory, frame, dimension)


def cuboid(frames: DataFrame, trajs: Sequence[int], start: int, stop: int | None = None, step: int = 1, dims: Sequence[int] | None = None) -> DataFrame:
    """The same frame range of several trajectories, no longer than the shortest of them."""
    chosen = frames.where(F.col("traj_id").isin(list(trajs)))
    shortest = chosen.groupBy("traj_id").count().agg(F.min("count").alias("n"))
    end = F.least(F.col("n"), F.lit(stop)) if stop is not None else F.col("n")
    rows = chosen.join(F.broadcast(shortest)).where((F.col("t") >= start) & (F.col("t") < end) & ((F.col("t") - start) % step == 0)).drop("n")
    return select_columns(rows, dims) if dims is not None else rows


def jagged(frames: DataFrame, trajs: Sequence[int], start: int = 0, stop: int | None = None, step: int = 1, dims: Sequence[int] | None = None) -> DataFrame:
    """A frame range of several trajectories, each as long as it is."""
    ok = F.col("traj_id").isin(list(trajs)) & (F.col("t") >= start) & ((F.col("t") - start) % step == 0)
    rows = frames.where(ok & (F.col("t") < stop) if stop is not None else ok)
    return select_columns(rows, dims) if dims is not None else rows


def linear_offsets(frames: DataFrame, trajs: Sequence[int] | None = None) -> DataFrame:
    """``traj_id, off``: where each trajectory begins on the concatenated time axis."""
    chosen = frames if trajs is None else frames.where(F.col("traj_id").isin(list(trajs)))
    n = chosen.groupBy("traj_id").agg(F.count("*").alias("n"))
    w = Window.orderBy("traj_id").rowsBetween(Window.unboundedPreceding, -1)
    return n.select("traj_id", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("off"))


def linear(frames: DataFrame, trajs: Sequence[int] | None = None) -> DataFrame:
    """The frames with ``pos``, their number on the (sub)set's concatenated time axis."""
    return frames.join(linear_offsets(frames, trajs), "traj_id").withColumn("pos", F.col("t") + F.col("off")).drop("off")


def fragments(parts: Sequence[DataFrame], traj_id: int = 0) -> DataFrame:
    """One trajectory out of several, end to end: every part's time is moved by the lengths before it."""
    out, numbered = None, []
    for k, p in enumerate(parts):
        numbered.append(p.withColumn("part", F.lit(k)))
    for p in numbered:
        out = p if out is None else out.unionByName(p)
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begin = out.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("off"))
    return out.join(F.broadcast(begin), "part").withColumn("t", F.col("t") + F.col("off")).withColumn("traj_id", F.lit(traj_id)).drop("part", "off")


def merge_sources(*sources: DataFrame, check: bool = True) -> DataFrame:
    """Features of several sources side by side; sources must have the same frames."""
    out = sources[0]
    for s in sources[1:]:
        if check and not out.select("traj_id", "t").exceptAll(s.select("traj_id", "t")).union(s.select("traj_id", "t").exceptAll(out.select("traj_id", "t"))).isEmpty():
            raise ValueError("sources differ in trajectories or lengths")
        out = out.join(s.withColumnRenamed("x", "x2"), ["traj_id", "t"]).withColumn("x", F.concat("x", "x2")).drop("x2")
    return out


# Files


def _paths(files: str | Sequence[str]) -> list[str]:
    names = [files] if isinstance(files, str) else list(files)
    out = [p for n in names for p in (sorted(glob.glob(n)) if any(c in n for c in "*?[") else [n])]
    return list(dict.fromkeys(out))  # a name given twice is one trajectory, at its first place


def _file_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, traj_id, content``: a row for each file, in one task each; any store Spark reads will do."""
    order = spark.createDataFrame([(os.path.basename(p), i) for i, p in enumerate(paths)], "name string, traj_id int")
    if len({os.path.basename(p) for p in paths}) < len(paths):
        order = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "name string, traj_id int")
        name = F.regexp_replace("path", "^[a-z]+:/*", "/")
    else:
        name = F.regexp_extract("path", "[^/]*$", 0)
    files = spark.read.format("binaryFile").load(paths)
    order = F.broadcast(order) if len(paths) <= BROADCAST_ROWS else order
    return files.withColumn("name", name).join(order, "name").select("traj_id", "content")


def sniff_csv(head: str, comment: str = "#") -> tuple[str | None, int]:
    """Delimiter (None: white space) and number of leading rows that are no data."""
    rows = [r for r in head.splitlines() if r.strip() and not r.lstrip().startswith(comment)]
    delimiter = next((d for d in (",", ";", "\t", "|") if rows and d in rows[-1]), None)
    skip = 0
    for r in rows:
        try:
            [float(v) for v in r.split(delimiter) if v.strip()]
            break
        except ValueError:
            skip += 1
    return delimiter, skip


def _parse_csv(raw: bytes, delimiter: str | None, comment: str) -> np.ndarray:
    text = raw.decode()
    found, skip = sniff_csv(text[:4096], comment)
    rows = [r for r in text.splitlines() if r.strip() and not r.lstrip().startswith(comment)][skip:]
    sep = delimiter or found
    return np.array([[float(v) for v in r.split(sep) if v.strip()] for r in rows], np.float32).astype(float)


def _each_file(parse):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, x in parse(raw):
                    x = x[:, None] if x.ndim == 1 else x.reshape(len(x), -1)
                    for at in range(0, len(x), 65536):
                        t = _frames_table(i + k, x[at : at + 65536])
                        t = t.set_column(1, "t", pa.array(np.arange(at, at + len(t))))
                        yield from t.to_batches()

    return run


def read_csv(spark: SparkSession, files: str | Sequence[str], delimiter: str | None = None, comment: str = "#") -> DataFrame:
    """Text tables, a trajectory for each file; header, comments and delimiter are found by looking, values are 32-bit."""
    return _file_table(spark, _paths(files)).mapInArrow(_each_file(lambda raw: [(0, _parse_csv(raw, delimiter, comment))]), FRAMES)


def read_npy(spark: SparkSession, files: str | Sequence[str]) -> DataFrame:
    """``.npy`` arrays, a trajectory for each file; more than two dimensions are flattened to rows.  Pickles are refused."""
    return _file_table(spark, _paths(files)).mapInArrow(_each_file(lambda raw: [(0, np.load(io.BytesIO(raw), allow_pickle=False))]), FRAMES)


def read_npz(spark: SparkSession, files: str | Sequence[str]) -> DataFrame:
    """``.npz`` archives: every array of every archive, in name order, is a trajectory."""
    paths = _paths(files)
    many = 1 << 16

    def parse(raw: bytes):
        with np.load(io.BytesIO(raw), allow_pickle=False) as z:
            return [(k, z[name]) for k, name in enumerate(sorted(z.files))]

    rows = _file_table(spark, paths).withColumn("traj_id", F.col("traj_id") * many).mapInArrow(_each_file(parse), FRAMES)
    ids = rows.select("traj_id").distinct().withColumn("new", F.row_number().over(Window.orderBy("traj_id")) - 1)
    return rows.join(ids, "traj_id").select(F.col("new").alias("traj_id"), "t", "x")


def read_hdf5(spark: SparkSession, files: str | Sequence[str], selection: str = "/*") -> DataFrame:
    """Datasets of HDF5 files whose path matches ``selection``; needs h5py."""
    try:
        import h5py  # noqa: F401
    except ImportError as e:
        raise NotImplementedError("HDF5 input needs the h5py package") from e
    import re

    pattern = re.compile(selection.replace("*", ".*"))

    def parse(raw: bytes):
        import h5py

        found: list[str] = []
        with h5py.File(io.BytesIO(raw), "r") as f:
            f.visititems(lambda name, item: found.append(name) if isinstance(item, h5py.Dataset) and pattern.fullmatch("/" + name) else None)
            return [(k, f[name][()]) for k, name in enumerate(sorted(found))]

    return _file_table(spark, _paths(files)).mapInArrow(_each_file(parse), FRAMES)


def source(spark: SparkSession, inp, **options) -> DataFrame:
    """Frames from arrays, a DataFrame, or files by suffix; a nested list of files is one trajectory for each inner list."""
    if isinstance(inp, DataFrame):
        return inp
    if isinstance(inp, np.ndarray) or (isinstance(inp, Sequence) and not isinstance(inp, str) and len(inp) and isinstance(inp[0], np.ndarray)):
        return from_arrays(spark, inp)
    if isinstance(inp, Iterable) and not isinstance(inp, str) and any(not isinstance(i, str) for i in inp):
        outs = [fragments([source(spark, f, **options) for f in _paths(part)], i) if not isinstance(part, str) else source(spark, part, **options).withColumn("traj_id", F.lit(i)) for i, part in enumerate(inp)]
        out = outs[0]
        for o in outs[1:]:
            out = out.unionByName(o)
        return out
    paths = _paths(inp)
    suffixes = {os.path.splitext(p.rstrip("/"))[1] for p in paths}
    if len(suffixes) != 1:
        raise ValueError(f"files of one kind are needed, not {sorted(suffixes)}")
    suffix = suffixes.pop()
    if suffix == ".pdb":
        raise ValueError("a structure file is no trajectory")
    readers = {".npy": read_npy, ".npz": read_npz, ".h5": read_hdf5, ".hdf5": read_hdf5}
    if suffix == ".parquet":
        return spark.read.parquet(*paths)
    if suffix in {".xtc", ".dcd", ".trr", ".nc", ".binpos"}:
        raise NotImplementedError(f"{suffix} files need a molecular reader; export coordinates as Parquet, CSV or npy")
    return readers.get(suffix, read_csv)(spark, paths, **options)


load = source


def write_parquet(frames: DataFrame, path: str, stride: int = 1, overwrite: bool = False) -> None:
    """Files of whole trajectories, frames in order; as many as the shuffle has partitions, however many the trajectories are."""
    rows = strided(frames, stride).repartition("traj_id").sortWithinPartitions("traj_id", "t")
    rows.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_csv(frames: DataFrame, path: str, stride: int = 1, overwrite: bool = False, delimiter: str = " ") -> None:
    """A folder of text files for each trajectory; refuses to overwrite unless asked."""
    rows = strided(frames, stride).repartition("traj_id").sortWithinPartitions("traj_id", "t")
    text = rows.select("traj_id", F.array_join(F.col("x").cast("array<string>"), delimiter).alias("line"))
    text.write.partitionBy("traj_id").mode("overwrite" if overwrite else "errorifexists").text(path)


def read_dtrajs(spark: SparkSession, files: str | Sequence[str]) -> DataFrame:
    """Discrete trajectories from text (a number on each line) or ``.npy`` files."""
    paths = _paths(files)

    def parse(raw: bytes):
        x = np.load(io.BytesIO(raw), allow_pickle=False) if raw[:6] == b"\x93NUMPY" else np.array(raw.split(), int)
        return [(0, x.astype(float))]

    return _file_table(spark, paths).mapInArrow(_each_file(parse), FRAMES).select("traj_id", "t", F.get("x", F.lit(0)).cast("int").alias("state"))


def write_dtrajs(dtrajs: DataFrame, path: str, overwrite: bool = False) -> None:
    """Text, a state on each line, a folder for each trajectory."""
    rows = dtrajs.repartition("traj_id").sortWithinPartitions("traj_id", "t").select("traj_id", F.col("state").cast("string").alias("line"))
    rows.write.partitionBy("traj_id").mode("overwrite" if overwrite else "errorifexists").text(path)


def save_dtrajs_npy(dtrajs: DataFrame, folder: str, prefix: str = "dtraj_") -> list[str]:
    """``.npy`` files on the driver's disk, one trajectory in memory at a time; returns their names."""
    os.makedirs(folder, exist_ok=True)
    names, current, values = [], None, []

    def flush() -> None:
        if current is not None:
            names.append(f"{folder}/{prefix}{current}.npy")
            np.save(names[-1], np.array(values, np.int32))

    for r in dtrajs.select("traj_id", "state", "t").orderBy("traj_id", "t").toLocalIterator():
        if r[0] != current:
            flush()
            current, values = r[0], []
        values.append(r[1])
    flush()
    return names


def traj_info(frames: DataFrame) -> DataFrame:
    """``traj_id, length, ndim``: what a reader would cache about each trajectory."""
    return frames.groupBy("traj_id").agg(F.count("*").alias("length"), F.max(F.size("x")).alias("ndim"))
