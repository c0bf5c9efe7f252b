"""Size-tiered compaction of immutable shards under a versioned manifest; DataFrame operations only."""

from __future__ import annotations

import math
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

from gleaner.llm.shared import hadoop_path

#: Shards whose sizes are within this factor of one another are of one tier.
FANOUT = 4


class Conflict(Exception):
    """Another writer has made the version that this one was to be."""


class ShardStore:
    """A table kept as immutable Parquet shards; its manifests say which shards each version has.

    Every version is a folder `manifests/v<N>` with a row (path, bytes) for each shard. It is written
    beside its place and put there by one rename that fails if the place is taken, so readers see whole
    versions only; of two writers of one version one fails, drops its manifest and starts anew from the
    other's. Shards that no manifest names, left by a writer that was lost, are never read, and vacuum()
    deletes them once they are old. Rows are kept as they are: nulls, repeats and empty texts too, and
    columns of any name.
    """

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20) -> None:
        self.spark, self.path, self.target = spark, path.rstrip("/"), target_bytes

    def _list(self, path: str) -> list[tuple[str, int]]:
        p, fs = hadoop_path(self.spark, path)
        if not fs.exists(p):
            return []
        found, out = fs.listFiles(p, True), []
        while found.hasNext():
            f = found.next()
            if f.getPath().getName().endswith(".parquet"):
                out.append((f.getPath().toString(), int(f.getLen())))
        return sorted(out)

    def version(self) -> int:
        """The newest version; 0 where there is none."""
        p, fs = hadoop_path(self.spark, f"{self.path}/manifests")
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return max([0, *(int(x[1:]) for x in names if x.startswith("v"))])

    def shards(self, version: int | None = None) -> list[tuple[str, int]]:
        """(path, bytes) of the shards of a version, metadata only."""
        version = self.version() if version is None else version
        if not version:
            return []
        rows = self.spark.read.parquet(f"{self.path}/manifests/v{version}").collect()
        return sorted((r["path"], r["bytes"]) for r in rows)

    def commit(self, shards: list[tuple[str, int]], base: int) -> int:
        """Make shards the version after base, or fail if another writer has made that one."""
        own, place = f"{self.path}/manifests/_try-{uuid.uuid4().hex}", f"{self.path}/manifests/v{base + 1}"
        self.spark.createDataFrame(shards, "path string, bytes long").coalesce(1).write.parquet(own)
        src, _ = hadoop_path(self.spark, own)
        dst, _ = hadoop_path(self.spark, place)
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(src.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        flags = self.spark.sparkContext._gateway.new_array(rename, 1)
        flags[0] = rename.NONE
        try:
            context.rename(src, dst, flags)
        except Exception as e:
            hadoop_path(self.spark, own)[1].delete(src, True)
            if hadoop_path(self.spark, place)[1].exists(dst):
                raise Conflict(f"version {base + 1} is taken") from e
            raise
        return base + 1

    def _drop(self, shards: list[tuple[str, int]]) -> None:
        for path, _ in shards:
            p, fs = hadoop_path(self.spark, path)
            fs.delete(p, False)

    def append(self, arrivals: DataFrame, by: Column | None = None) -> int:
        """Add the rows of arrivals as small shards, one run for each value of `by`, in one version.

        A table without rows adds shards without rows, which keep its schema, or none.
        """
        at, name = f"{self.path}/shards/{uuid.uuid4().hex}", "_arrival"
        while name in arrivals.columns:
            name += "_"
        writer = arrivals.write if by is None else arrivals.withColumn(name, by).write.partitionBy(name)
        writer.parquet(at)
        new = [x for x in self._list(at) if x[1]]
        while True:  # until no other writer is first
            base = self.version()
            if not new:
                return base
            try:
                return self.commit(self.shards(base) + new, base)
            except Conflict:
                continue

    def tier(self, size: int) -> int:
        """0 for shards of the target size, more for each factor FANOUT below it."""
        return max(0, math.ceil(math.log(self.target / max(size, 1), FANOUT) - 0.5))

    def plan(self, shards: list[tuple[str, int]]) -> list[list[tuple[str, int]]]:
        """The runs to merge: of each tier below the target its shards, once there are FANOUT of them.

        A run that is merged carries over what it yields: smaller tiers are merged together with the
        next larger one if their sum reaches it, so no row is written twice in one compaction.
        """
        tiers: dict[int, list[tuple[str, int]]] = {}
        for s in shards:
            tiers.setdefault(self.tier(s[1]), []).append(s)
        runs, carried = [], []
        for t in sorted(tiers, reverse=True):
            if not t:
                break
            carried = carried + tiers[t]
            if len(carried) >= FANOUT and sum(b for _, b in carried) >= self.target / FANOUT ** max(0, t - 1):
                runs.append(carried)
                carried = []
        return runs

    def compact(self) -> int:
        """Merge runs of similar shards into files of about the target size and commit one version.

        A run is read and written without a shuffle: its files are packed into tasks of the target size.
        Older versions keep their shards until vacuum().
        """
        while True:
            base = self.version()
            shards = self.shards(base)
            runs = self.plan(shards)
            if not runs:
                return base
            old, new = {p for run in runs for p, _ in run}, []
            for run in runs:
                at = f"{self.path}/shards/{uuid.uuid4().hex}"
                files = max(1, round(sum(b for _, b in run) / self.target))
                self._rows([p for p, _ in run]).coalesce(files).write.parquet(at)
                new += [x for x in self._list(at) if x[1]]
            while old <= {p for p, _ in shards}:  # what was merged is still there, whatever else was added
                try:
                    return self.commit([s for s in shards if s[0] not in old] + new, base)
                except Conflict:
                    base = self.version()
                    shards = self.shards(base)
            self._drop(new)  # another writer has merged some of it first

    def vacuum(self, orphans_after: float = 24 * 3600) -> None:
        """Delete the shards and manifests that only versions before the newest name, and what lost writers left.

        Shards that no version names, and manifests that were never put in place, go once they are
        `orphans_after` seconds old: younger ones may be of a writer at work.
        """
        version = self.version()
        live = {p for p, _ in self.shards(version)}
        for v in range(1, version):
            p, fs = hadoop_path(self.spark, f"{self.path}/manifests/v{v}")
            for path, _ in self.shards(v) if fs.exists(p) else []:
                if path not in live:
                    s, sfs = hadoop_path(self.spark, path)
                    sfs.delete(s, False)
            fs.delete(p, True)
        self._orphans(live, orphans_after)

    def _orphans(self, live: set[str], age: float) -> None:
        before = (time.time() - age) * 1000
        p, fs = hadoop_path(self.spark, f"{self.path}/shards")
        found = fs.listFiles(p, True) if fs.exists(p) else None
        while found is not None and found.hasNext():
            f = found.next()
            if f.getPath().toString() not in live and f.getModificationTime() < before:
                fs.delete(f.getPath(), False)
        p, fs = hadoop_path(self.spark, f"{self.path}/manifests")
        for f in fs.listStatus(p) if fs.exists(p) else []:
            if f.getPath().getName().startswith("_try-") and f.getModificationTime() < before:
                fs.delete(f.getPath(), True)

    def _rows(self, files: list[str]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/shards").option("recursiveFileLookup", "true").parquet(*files)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version; None where it has no shards."""
        shards = self.shards(version)
        return self._rows([p for p, _ in shards]) if shards else None
