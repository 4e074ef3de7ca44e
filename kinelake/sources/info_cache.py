"""Lengths and dimensions of trajectory files, remembered between sessions.

An entry is valid for a file's path, size and modification time; files that changed are read again, all of them in one
pass.  The entries are in a small SQLite file of the driver, or in memory without one; beyond ``max_entries`` those
used longest ago go.
"""

from __future__ import annotations

import sqlite3
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from kinelake.sources import frames as Fr

MAX_ENTRIES = 50_000


class TrajectoryInfoCache:
    def __init__(self, path: str | None = None, max_entries: int = MAX_ENTRIES):
        self.max_entries = max_entries
        self.db = sqlite3.connect(path or ":memory:")
        self.db.execute("CREATE TABLE IF NOT EXISTS info (path TEXT PRIMARY KEY, size INTEGER, modified TEXT, length INTEGER, ndim INTEGER, used REAL)")

    def __len__(self) -> int:
        return self.db.execute("SELECT count(*) FROM info").fetchone()[0]

    def get(self, spark: SparkSession, files: str | Sequence[str], read: Callable[[SparkSession, list[str]], DataFrame] = Fr.source) -> list[tuple[int, int]]:
        """``(length, ndim)`` of each file, in order; only files that are new or changed are read."""
        paths = Fr._paths(files)
        listed = spark.read.format("binaryFile").load(paths).select("path", "length", "modificationTime").collect()  # names and sizes only
        plain = lambda p: "/" + p.split(":", 1)[-1].lstrip("/") if ":" in p else p
        now = {plain(r.path): (r.length, str(r.modificationTime)) for r in listed}
        known = {}
        for p in paths:
            row = self.db.execute("SELECT size, modified, length, ndim FROM info WHERE path = ?", (p,)).fetchone()
            if row and row[:2] == now.get(plain(p)):
                known[p] = row[2:]
        missing = [p for p in paths if p not in known]
        if missing:
            info = {r.traj_id: (r.length, r.ndim) for r in Fr.traj_info(read(spark, missing)).collect()}  # a row for each file
            for k, p in enumerate(missing):
                known[p] = info.get(k, (0, 0))
                self.db.execute("INSERT OR REPLACE INTO info VALUES (?, ?, ?, ?, ?, ?)", (p, *now.get(plain(p), (0, "")), *known[p], time.time()))
        self.db.executemany("UPDATE info SET used = ? WHERE path = ?", [(time.time(), p) for p in paths])
        self.db.execute("DELETE FROM info WHERE path NOT IN (SELECT path FROM info ORDER BY used DESC LIMIT ?)", (self.max_entries,))
        self.db.commit()
        return [known[p] for p in paths]

    def clear(self) -> None:
        self.db.execute("DELETE FROM info")
        self.db.commit()
