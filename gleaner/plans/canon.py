"""The generic tables seen as canonical documents, in Spark and in SQL.

A source's number decides its domain and type, a document's labels its status; everything else follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import stable_id
from gleaner.plans.registry import table


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    marks = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("l_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    n = F.substring("source", 4, 10).cast("int")
    kind = F.element_at(F.array(*map(F.lit, ("official_doc", "qa", "video", "internal_sop"))), n % 4 + 1)
    out = d.join(marks, d["doc_id"] == marks["l_id"], "left").withColumns({"n": n, "source_type": kind})
    return out.select(
        stable_id(F.col("source"), F.col("doc_id")).alias("id"), "doc_id", F.col("text").alias("content"),
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"),
        F.when(F.col("n") % 2 == 0, "software").otherwise("hotel").alias("domain"),
        F.element_at(F.array(*map(F.lit, ("general", "reservations", "payments", "billing", "guest_journey"))), F.col("n") % 5 + 1).alias("topic"),
        F.when(F.col("n") % 3 == 0, "refund").otherwise(F.lit(None)).alias("subtopic"), "source_type", F.col("source").alias("source_id"),
        F.when(F.col("source_type").isin("official_doc", "video"), "official").when(F.col("source_type") == "internal_sop", "verified_internal").otherwise("community").alias("authority"),
        F.when(F.col("toxic") == 1, "deprecated").when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "review_required").otherwise("draft").alias("status"),
        F.col("lang").alias("language"), "n_chars",
    )


CANON = """
marks AS (SELECT doc_id AS l_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
numbered AS (
  SELECT d.*, m.quality, m.toxic, CAST(substring(source, 4, 10) AS INTEGER) AS n,
    (['official_doc', 'qa', 'video', 'internal_sop'])[CAST(substring(source, 4, 10) AS INTEGER) % 4 + 1] AS source_type
  FROM documents d LEFT JOIN marks m ON d.doc_id = m.l_id),
canon AS (
  SELECT substring(sha1(source || '::' || CAST(doc_id AS VARCHAR)), 1, 16) AS id, doc_id, text AS content,
    split_part(text, chr(10), 1) AS title,
    CASE WHEN n % 2 = 0 THEN 'software' ELSE 'hotel' END AS domain,
    (['general', 'reservations', 'payments', 'billing', 'guest_journey'])[n % 5 + 1] AS topic,
    CASE WHEN n % 3 = 0 THEN 'refund' END AS subtopic, source_type, source AS source_id,
    CASE WHEN source_type IN ('official_doc', 'video') THEN 'official' WHEN source_type = 'internal_sop' THEN 'verified_internal' ELSE 'community' END AS authority,
    CASE WHEN toxic = 1 THEN 'deprecated' WHEN quality = 1 THEN 'verified' WHEN quality = 0 THEN 'review_required' ELSE 'draft' END AS status,
    lang AS language, n_chars
  FROM numbered)
"""
#: The accent-insensitive key of column content.
KEY = "trim(regexp_replace(lower(regexp_replace(strip_accents(content), '[^\\x00-\\x7F]+', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"
