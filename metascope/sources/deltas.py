"""Tables that grow by commits: each writes only what it changes, takes its number by an atomic rename, and is compacted."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Other writers were always faster."""


class DeltaLog:
    """A table in a folder that all executors share, as a snapshot and the commits after it.

    A commit holds new rows and the keys whose older rows it replaces, by the first `level` of the key columns; level 0
    replaces the whole table. It is written aside and renamed to the next number (which the file system must do as one
    step); of two writers that start from the same number one loses and repeats. Readers never see a part of a commit,
    and a crash leaves the table as it was. After every `every` commits a snapshot is written and what came before the last
    snapshot but one is deleted, so that a reader of the current version has time to end. What a commit writes grows with its
    own rows, and with the table only once in `every` commits.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], every: int = 16):
        self.spark, self.folder, self.keys, self.every = spark, folder.rstrip("/"), keys, every
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _names(self, name: str = "") -> list[str]:
        at = self._path(name)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _numbers(self, kind: str) -> list[int]:
        return sorted(int(n[2:]) for n in self._names() if n.startswith(f"{kind}="))

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        return max(self._numbers("v") + self._numbers("s"), default=0)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows that hold at a version, or None before the first commit."""
        v = self.version() if version is None else version
        if not v:
            return None
        base = max([n for n in self._numbers("s") if n <= v], default=0)
        parts = [(base, self.spark.read.parquet(f"{self.folder}/s={base}"))] if base else []
        last: dict[int, list[DataFrame]] = {}
        for n in [n for n in self._numbers("v") if base < n <= v]:
            level = next(int(x[5:]) for x in self._names(f"v={n}") if x.startswith("keys-"))
            if level == 0:
                parts, last = [], {}
            else:
                k = self.spark.read.parquet(f"{self.folder}/v={n}/keys-{level}").select(*[F.col(c).alias(f"_k_{c}") for c in self.keys[:level]], F.lit(n).alias("_last"))
                last.setdefault(level, []).append(k)
            parts.append((n, self.spark.read.parquet(f"{self.folder}/v={n}/rows")))
        rows = None
        for n, df in parts:
            df = df.withColumn("_v", F.lit(n))
            rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
        for level, ks in last.items():
            k = ks[0]
            for more in ks[1:]:
                k = k.unionByName(more)
            cols = self.keys[:level]
            k = k.groupBy(*[f"_k_{c}" for c in cols]).agg(F.max("_last").alias("_last"))
            same = F.col("_v") < F.col("_last")
            for c in cols:
                same &= F.col(c).eqNullSafe(F.col(f"_k_{c}"))
            rows = rows.join(k, same, "left_anti")
        return rows.drop("_v")

    def _land(self, made: str, name: str) -> bool:
        """Renames a written folder to its number; False if another writer has it."""
        target = self._path(name)
        if not self._fs.exists(target) and self._fs.rename(self._path(made), target):
            inner = self._path(f"{name}/{made}")
            if not self._fs.exists(inner):
                return True
            self._fs.delete(inner, True)  # the rename fell into a folder made meanwhile
        else:
            self._fs.delete(self._path(made), True)
        return False

    def commit(self, change: Callable[[DataFrame | None, int], tuple[DataFrame, DataFrame | None]], level: int | None = None, tries: int = 5) -> int:
        """change(table, number of this commit) -> (rows, keys to replace; None: those of the rows). Returns the number."""
        level = len(self.keys) if level is None else level
        for _ in range(tries):
            v = self.version()
            rows, keys = change(self.read(v), v + 1)
            made = f"_new-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.folder}/{made}/rows")
            rows = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{made}/rows") if keys is None else rows
            cols = self.keys[:level]
            k = (rows if keys is None else keys).select(*cols).distinct() if cols else self.spark.createDataFrame([], "none int")
            k.write.parquet(f"{self.folder}/{made}/keys-{level}")
            if self._land(made, f"v={v + 1}"):
                if (v + 1) % self.every == 0:
                    self.compact(v + 1)
                return v + 1
        raise Conflict("other writers were always faster")

    def compact(self, version: int | None = None) -> None:
        """Writes the snapshot of a version and deletes what the snapshot before it stands for."""
        v = self.version() if version is None else version
        before = max([n for n in self._numbers("s") if n < v], default=0)
        made = f"_new-{uuid.uuid4().hex}"
        self.read(v).write.parquet(f"{self.folder}/{made}")
        if self._land(made, f"s={v}"):
            for kind in "vs":
                for n in self._numbers(kind):
                    if n < before or (kind == "v" and n == before):
                        self._fs.delete(self._path(f"{kind}={n}"), True)
