"""A table kept as a snapshot and the changes since, for streams that read what they have written so far."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SNAPSHOT, DELTA = "snapshot", "delta"


class VersionedTable:
    """Rows by version (a micro-batch id): a read takes the last snapshot and the open deltas after it.

    A version is written into its own folder and overwritten when a batch is replayed, so nothing is
    doubled. `compact` writes all rows up to a version as one snapshot; a reader of an earlier version still
    finds the snapshot before, so a batch that is replayed after a compaction sees the same rows as before.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: str, every: int = 10,
        merge: Callable[[DataFrame], DataFrame] | None = None,
    ):
        self.spark, self.path, self.schema, self.every, self.merge = spark, path.rstrip("/"), schema, every, merge

    def _versions(self) -> dict[str, list[int]]:
        """Complete versions of each kind, by the file system that Spark reads with."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found: dict[str, list[int]] = {SNAPSHOT: [], DELTA: []}
        if system.exists(folder):
            for status in system.listStatus(folder):
                kind, _, version = status.getPath().getName().partition("=")
                done = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
                if kind in found and version and system.exists(done):
                    found[kind].append(int(version))
        return {kind: sorted(versions) for kind, versions in found.items()}

    def folders(self, before: int | None = None) -> list[str]:
        """What a read of the versions before `before` (all without it) takes: a snapshot and open deltas."""
        found = self._versions()
        snapshots = [v for v in found[SNAPSHOT] if before is None or v < before]
        start = snapshots[-1] if snapshots else None
        deltas = [v for v in found[DELTA] if (start is None or v > start) and (before is None or v < before)]
        head = [] if start is None else [f"{self.path}/{SNAPSHOT}={start}"]
        return head + [f"{self.path}/{DELTA}={v}" for v in deltas]

    def read(self, before: int | None = None) -> DataFrame:
        """Rows of all versions before `before`."""
        folders = self.folders(before)
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def append(self, version: int, rows: DataFrame) -> None:
        """Write a version's rows, and a snapshot where enough deltas are open."""
        rows.select(*self.spark.createDataFrame([], self.schema).columns).write.mode("overwrite").parquet(
            f"{self.path}/{DELTA}={version}"
        )
        if sum(f"/{DELTA}=" in f for f in self.folders(version)) + 1 >= self.every:
            self.compact(version)

    def compact(self, version: int) -> None:
        """Write the rows up to `version` as a snapshot; `merge` may drop rows that no reader needs.

        The version's own rows are taken from its folder, so a replayed batch replaces its snapshot too.
        """
        own = self.spark.read.schema(self.schema).parquet(f"{self.path}/{DELTA}={version}")
        rows = self.read(version).unionByName(own)
        (self.merge(rows) if self.merge else rows).write.mode("overwrite").parquet(f"{self.path}/{SNAPSHOT}={version}")
