"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import discard, materialize


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], int(row["s"] or 0)


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    edges has two bigint columns, a and b. Nulls and loops are ignored, repeated edges are harmless,
    and an empty table gives an empty result. Each round groups with map-side combining and joins on
    the node, so a node with very many links is only ever a skewed join key, which AQE splits. The
    state between rounds is a table in the shared folder.
    """
    e = (
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    e = materialize(e, label)
    before = _state(e)
    while before[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = (
            both.where("v > u").join(low, "u").where("v <> m")
            .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        )
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(low.select("hi", F.col("m").alias("lo"))).distinct()
        )
        after_df = materialize(small, label)
        discard(e)
        e, after = after_df, _state(after_df)
        if after == before:
            break
        before = after
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
