"""Index lifecycle: the plan of a synchronisation and what the index holds after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of a row's columns by name; nulls and absent fields are told from empty ones."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def changes(stored: DataFrame | None, rows: DataFrame, key: str = "id", verified: Column | None = None, full: bool = True) -> DataFrame:
    """(key, change, hash) of every key: insert, update, delete or keep, and the content hash that is to be stored.

    stored(key, content_hash) or None for an empty index; rows(key, content_hash, ...). Unverified rows take what is stored
    of their key away, unless a verified row of it comes too; keys that don't come stay unless the load is full.
    """
    good = F.lit(True) if verified is None else F.coalesce(verified, F.lit(False))
    wanted = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.when(good, F.col("content_hash"))).alias("_want"), F.lit(True).alias("_came"))
    if stored is None:
        return wanted.where("_want IS NOT NULL").select(key, F.lit("insert").alias("change"), F.col("_want").alias("hash"))
    both = stored.select(key, F.col("content_hash").alias("_have")).join(wanted, key, "full").where("_have IS NOT NULL OR _want IS NOT NULL")
    gone = F.col("_want").isNull() & (F.lit(full) | F.col("_came").isNotNull())
    change = F.when(F.col("_have").isNull(), "insert").when(gone, "delete").when(F.col("_want") != F.col("_have"), "update").otherwise("keep")
    return both.select(key, change.alias("change"), F.coalesce("_want", "_have").alias("hash"))


def sync_plan(stored: DataFrame, desired: DataFrame, key: str = "id") -> DataFrame:
    """(key, change) by keys alone: insert what only `desired` has, delete what only `stored` has, keep the rest."""
    a = stored.select(key).distinct().withColumn("_s", F.lit(True))
    b = desired.select(key).distinct().withColumn("_d", F.lit(True))
    change = F.when(F.col("_s").isNull(), "insert").when(F.col("_d").isNull(), "delete").otherwise("keep")
    return a.join(b, key, "full").select(key, change.alias("change"))


def sync(stored: DataFrame, desired: DataFrame, key: str = "id", verified: Column | None = None) -> DataFrame:
    """The rows of the index after a synchronisation: the verified desired ones, one a key; stored rows that are equal stay."""
    columns = stored.columns
    own, old = (x.select(*columns).withColumn("content_hash", row_hash(columns)) for x in (desired, stored))
    if verified is not None:
        own = desired.where(verified).select(*columns).withColumn("content_hash", row_hash(columns))
    plan = changes(old.dropDuplicates([key]), own, key)
    kept = old.join(plan.where("change = 'keep'"), key, "left_semi").dropDuplicates([key])
    new = own.join(plan.where("change IN ('insert', 'update')").select(key, F.col("hash").alias("content_hash")), [key, "content_hash"], "left_semi").dropDuplicates([key])
    return kept.unionByName(new.select(*kept.columns)).drop("content_hash")
