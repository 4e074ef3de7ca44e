"""Connected components of a graph of links, as DataFrame joins; nothing is gathered on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm._common import discard, materialize

#: Links up to which one task, holding them all, finds the components (about 200 bytes each).
ONE_TASK = 100_000


def _trees(batches: Iterator[pa.RecordBatch]) -> dict[int, int]:
    """The smallest node of the tree of each node that the links name."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        path = []
        while (y := root.setdefault(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            root[p] = x
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace each batch of links by stars around the smallest node of each of its trees."""
    for batch in batches:
        pairs = [(x, y) for x, y in _trees([batch]).items() if x != y]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["a", "b"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    roots = _trees(batches)
    yield pa.RecordBatch.from_arrays([pa.array(list(roots), pa.int64()), pa.array(list(roots.values()), pa.int64())], names=["node", "comp"])


def components(links: DataFrame) -> DataFrame:
    """Rows ``node, comp`` for every node of ``links`` (``a, b``): ``comp`` is the smallest node of its component.

    Up to ``ONE_TASK`` links are put together by one task.  Beyond, large-star and small-star steps alternate until nothing
    changes; the number of rounds grows with the logarithm of the longest path.  Self-links are ignored.
    """
    edges = materialize(links.where("a <> b").mapInArrow(_forest, "a long, b long").distinct(), "edges")
    if edges.count() <= ONE_TASK:
        return edges.coalesce(1).mapInArrow(_whole, "node long, comp long")
    before = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        # Written first: a node with very many neighbours can then be split in the joins, whose sides are plain exchanges.
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        down = materialize(down, "large")
        lower = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = down.join(lower, "u")
        new = materialize(small.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").union(lower.select("u", "m")).distinct(), "small")
        discard(edges, least, down, lower)
        edges = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return nodes.union(edges.select("b", "b").distinct())
