"""Shared-folder helpers: every intermediate table lives where all executors can read it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a fresh temporary one if Spark runs in one process only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            return set_dir.get()
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gleaner-")
        spark.sparkContext.setCheckpointDir(root)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, made: list[DataFrame] | None = None, **options: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back.

    A lost executor then costs a reread, not a recomputation of what came before. The table is added to `made`, for discard().
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    if made is not None:
        made.append(out)
    return out


def hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(*tables: DataFrame) -> None:
    """Delete what materialize() wrote for these."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path:
            p, fs = hadoop_path(df.sparkSession, path)
            fs.delete(p, True)


def by_size(texts: Sequence[str | None], most: int = 1 << 20) -> Iterator[slice]:
    """Slices of neighbouring texts of about `most` characters, so that what is made of one slice stays small."""
    start, n = 0, 0
    for i, text in enumerate(texts):
        n += len(text or "") + 1
        if n >= most:
            yield slice(start, i + 1)
            start, n = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def by_bytes(texts: pa.Array, most: int = 1 << 18) -> Iterator[slice]:
    """by_size() for a column of an Arrow batch, by bytes; unused memory is given back at its end."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start, before = 0, 0
    while start < len(sizes):
        end = min(int(np.searchsorted(sizes, before + most)) + 1, len(sizes))
        yield slice(start, end)
        start, before = end, int(sizes[end - 1])
    pa.default_memory_pool().release_unused()


def gathered(batches: Iterator[pd.DataFrame], text: str, most: int = 1 << 23) -> Iterator[pd.DataFrame]:
    """Neighbouring batches as one, of about `most` characters in the column `text`."""
    kept, n = [], 0
    for x in batches:
        kept.append(x)
        n += int(x[text].str.len().sum())
        if n >= most:
            yield pd.concat(kept, ignore_index=True)
            kept, n = [], 0
    if kept:
        yield pd.concat(kept, ignore_index=True)


def whole_groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of whole groups, and the first row of each, from rows that come sorted by the columns `by`."""
    kept: list[pd.DataFrame] = []  # the last group so far
    last: tuple | None = None

    def joined(parts: list[pd.DataFrame]) -> tuple[pd.DataFrame, np.ndarray]:
        x = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
        k = x[by].to_numpy()
        return x, np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]).any(1))))

    for x in batches:
        if not len(x):
            continue
        k = x[by].to_numpy()
        new = np.concatenate(([tuple(k[0]) != last], (k[1:] != k[:-1]).any(1)))
        last = tuple(k[-1])
        at = np.flatnonzero(new)
        if len(at):
            done = [*kept, x.iloc[: at[-1]]]
            if sum(map(len, done)):
                yield joined([p for p in done if len(p)])
            kept = [x.iloc[at[-1] :]]
        else:
            kept.append(x)
    if kept:
        yield joined(kept)


def dealt(members: DataFrame, counted: DataFrame, row: str, hot: int) -> DataFrame:
    """members(key, ...) with the parts p, i and j of their key: every two rows of a key meet in one group (key, i, j).

    counted has the number of rows, `size`, of each key that counts; members of others go. A key of more
    than `hot` rows is split by the hash of the column `row`; a row then meets those of its own part
    where i = j, and those of the other part where they differ.
    """
    parts = counted.select("key", F.ceil(F.col("size") / F.lit(hot)).cast("int").alias("parts"))
    x = members.join(parts, "key").withColumn("p", F.pmod(F.xxhash64(row), F.col("parts")).cast("int"))
    x = x.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return x.withColumns({"i": F.least("p", "q"), "j": F.greatest("p", "q")}).drop("q", "parts")
