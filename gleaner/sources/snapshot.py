"""An index of rows in hash buckets: a load finds what changed by content hash and rewrites only buckets with changes.

`current` under the index's folder is its manifest: the schema and the folder of each bucket. A load writes new folders
and puts a new manifest in place by one rename, so readers see the index before a load or after it. There is one writer
at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators.index import changes, row_hash

BUCKETS = 64


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file that readers see whole or not at all, in place of one of the same name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place, temp = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}.{uuid.uuid4().hex}"))
    out = place.getFileSystem(conf).create(temp, True)
    out.write(bytearray(data))
    out.close()
    flags = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    flags[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), conf).rename(temp, place, flags)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


@dataclass(frozen=True)
class Load:
    """What a load did: rows inserted, updated, deleted and kept, and the buckets that it wrote."""

    insert: int
    update: int
    delete: int
    keep: int
    buckets: tuple[int, ...]


class Index:
    def __init__(self, spark: SparkSession, path: str, key: str = "id", buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _manifest(self) -> dict | None:
        at = f"{self.path}/current"
        if not exists(self.spark, at):
            return None
        found = json.loads(self.spark.read.text(at, wholetext=True).first()[0])
        if (found["key"], found["buckets"]) != (self.key, self.buckets):
            raise ValueError(f"the index has {found['buckets']} buckets by {found['key']}")
        return found

    def _stored(self, manifest: dict | None, only: list[int] | None = None) -> DataFrame | None:
        """The rows and their content hashes; of some buckets alone, if they are named."""
        if manifest is None:
            return None
        schema = T.StructType.fromJson(manifest["schema"])
        paths = [p for b, p in manifest["folders"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        """The rows of the index, or None before its first load."""
        found = self._stored(self._manifest())
        return None if found is None else found.drop("content_hash")

    def load(self, rows: DataFrame, verified: Column | None = None, full: bool = True) -> Load:
        """Bring the index to the verified rows.

        A row whose key is new is inserted; one of a known key with other content replaces what is stored;
        a stored row whose key comes without a verified row goes. With `full` those whose key doesn't come
        at all go too, else they stay. Of several verified rows of a key the one with the least content hash is
        taken. Rows without a key take no part. Where nothing changed nothing is written.
        """
        manifest, key = self._manifest(), self.key
        stored = self._stored(manifest)
        own = rows.withColumn("content_hash", row_hash(rows.columns))
        if stored is not None and own.schema.simpleString() != stored.schema.simpleString():
            raise ValueError("the rows' columns are not those of the index")
        plan = changes(None if stored is None else stored.select(key, "content_hash"), own, key, verified, full)
        bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(self.buckets)).cast("int").alias("bucket")
        version = uuid.uuid4().hex
        at = f"{self.path}/plan-{version}"
        plan.write.parquet(at)
        plan = self.spark.read.parquet(at)
        counts = {r["change"]: r["count"] for r in plan.groupBy("change").count().collect()}
        changed = sorted(r["bucket"] for r in plan.where("change <> 'keep'").select(bucket).distinct().collect())  # as many as buckets at most
        if changed:
            self._write(manifest, own, plan, bucket, changed, version)
        elif manifest is None:
            self._publish(own.schema, {}, version)
        return Load(*(counts.get(c, 0) for c in ("insert", "update", "delete", "keep")), tuple(changed))

    def _write(self, manifest: dict | None, own: DataFrame, plan: DataFrame, bucket: Column, changed: list[int], version: str) -> None:
        new = own.join(plan.where("change IN ('insert', 'update')").select(self.key, F.col("hash").alias("content_hash")), [self.key, "content_hash"], "left_semi").dropDuplicates([self.key])
        stored = self._stored(manifest, changed)
        if stored is not None:
            new = new.unionByName(stored.join(plan.where("change = 'keep'"), self.key, "left_semi"))
        new = new.select(*own.columns, bucket).where(F.col("bucket").isin(changed))
        folder = f"{self.path}/rows-{version}"
        new.repartition(len(changed), "bucket").sortWithinPartitions("bucket", self.key).write.partitionBy("bucket").parquet(folder)
        folders = {b: p for b, p in (manifest or {"folders": {}})["folders"].items() if int(b) not in changed}
        folders |= {str(b): f"{folder}/bucket={b}" for b in changed if exists(self.spark, f"{folder}/bucket={b}")}
        self._publish(own.schema, folders, version)

    def _publish(self, schema: T.StructType, folders: dict[str, str], version: str) -> None:
        data = {"key": self.key, "buckets": self.buckets, "version": version, "schema": json.loads(schema.json()), "folders": folders}
        put(self.spark, f"{self.path}/current", json.dumps(data).encode())
