"""The flagship query: governed documents, normalised and deduplicated, searched with diversified sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import corpus, search
from gleaner.plans.canon import canonical
from gleaner.plans.registry import table


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, source_id, score): the five best of the verified documents that dedup keeps."""
    docs = canonical(spark, sf_dir).withColumn("content_hash", corpus.content_hash(F.col("content")))
    kept, _ = corpus.deduplicate(docs)
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    points = e.join(kept.select(F.col("doc_id").alias("vec_id"), "source_id", "status", F.array().cast("array<string>").alias("title_tokens")), "vec_id")
    questions = e.where(F.pmod("vec_id", F.lit(50)) == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return search.search(points, questions, threshold=None, titles=False).select("query_id", "rank", "vec_id", "source_id", F.round("score", 6).alias("score"))
