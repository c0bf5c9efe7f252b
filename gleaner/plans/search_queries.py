"""Queries of vector search and its evaluation on the embeddings table; a label stands for a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions.folding import TITLE_STOP, title_tokens
from gleaner.operators import search
from gleaner.operators.sparse import impact_index, top_sparse
from gleaner.plans.registry import query, scratch, table

EVERY = 50


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points; the document of the same number gives the first line as title, and the labels a status."""
    e = table(spark, sf_dir, "embeddings")
    d = table(spark, sf_dir, "documents").groupBy(F.col("doc_id").alias("vec_id")).agg(F.min(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"))
    d = d.select("vec_id", title_tokens(F.col("title")).alias("title_tokens"))
    marks = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("vec_id")).agg(F.max("quality").alias("quality"))
    status = F.when((F.col("quality") == 0) | (F.col("vec_id") % 7 == 0), "review_required").otherwise("verified")
    return e.join(d, "vec_id", "left").join(marks, "vec_id", "left").select(
        "vec_id", "embedding", F.col("label").cast("string").alias("source_id"), F.coalesce("title_tokens", F.array().cast("array<string>")).alias("title_tokens"),
        F.when(F.col("label") % 2 == 0, "software").otherwise("hotel").alias("domain"), F.concat(F.lit("t"), F.col("label") % 3).alias("topic"), F.when(F.col("label") != 4, F.concat(F.lit("s"), "label")).alias("subtopic"), status.alias("status"))


def _questions(points: DataFrame) -> DataFrame:
    return points.where(F.pmod("vec_id", F.lit(EVERY)) == 0).select(F.col("vec_id").alias("query_id"), "embedding", F.col("title_tokens").alias("question_tokens"), "domain", "source_id")


SCORES = """
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS VARCHAR) AS source_id, CASE WHEN label % 2 = 0 THEN 'software' ELSE 'hotel' END AS domain FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, b.source_id, b.domain, a.source_id AS q_source, list_cosine_similarity(a.v, b.v) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 20)
"""


@query(f"WITH {SCORES} SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM top")
def tk1_dense_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK1, JO6."""
    p = _points(spark, sf_dir)
    hits = search.nearest(p, _questions(p), 20)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.select("query_id", F.row_number().over(w).alias("rank"), "vec_id", F.round("score", 6).alias("score"))


STOPS = "[" + ", ".join(f"'{x}'" for x in TITLE_STOP) + "]"
FOUND = """
marks AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
ok AS (SELECT vec_id FROM embeddings LEFT JOIN marks ON doc_id = vec_id WHERE NOT coalesce(quality = 0, false) AND vec_id % 7 <> 0 {0}),
vtop AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s JOIN ok USING (vec_id)) WHERE r <= 20),
t AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(strip_accents(replace(lower(text), 'ß', 'ss')), '[a-z0-9]+'), lambda x: len(x) >= 2 AND NOT list_contains({1}, x))) AS w FROM (SELECT doc_id, min(split_part(text, chr(10), 1)) AS text FROM documents GROUP BY doc_id)),
x AS (SELECT vtop.*, least(1.0, score + CASE WHEN len(coalesce(b.w, [])) > 0 THEN 0.06 * (len(list_intersect(coalesce(a.w, []), b.w)) / len(b.w)) ELSE 0 END) AS s2 FROM vtop LEFT JOIN t a ON a.doc_id = vtop.query_id LEFT JOIN t b ON b.doc_id = vtop.vec_id WHERE score >= 0.1),
y AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY s2 DESC, score DESC, vec_id) AS o FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, score DESC, vec_id) AS rank FROM y WHERE o <= 2)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, source_id, round(s2, 6) AS score FROM z WHERE rank <= 5"""


@query(f"WITH {SCORES}, {FOUND.format('', STOPS)}")
def tk3_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK2, TK3, TK4, WI1, FI1, FI3, TX9, TX17: verified points, threshold on the raw score, title bonus, at most two of a source, five hits."""
    p = _points(spark, sf_dir)
    return search.search(p, _questions(p), k=0, threshold=0.1, per_source=2).select("query_id", "rank", "vec_id", "source_id", F.round("score", 6).alias("score"))


@query(f"WITH {SCORES}, {FOUND.format('AND label % 2 = 0 AND label % 3 = 0 AND label <> 6', STOPS)}")
def fi2_filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FI2: one domain and topic, without one subtopic; a null subtopic stays."""
    p = _points(spark, sf_dir)
    return search.search(p, _questions(p), threshold=0.1, per_source=2, domain="software", topic="t0", exclude_subtopics=("s6",)).select("query_id", "rank", "vec_id", "source_id", F.round("score", 6).alias("score"))


@query(f"""
WITH {SCORES},
p AS (SELECT *, row_number() OVER (PARTITION BY query_id, domain ORDER BY score DESC, vec_id) AS h FROM top),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN h = 1 THEN 0 ELSE 1 END, CASE WHEN h = 1 THEN CASE domain WHEN 'hotel' THEN 1 ELSE 2 END ELSE 0 END, score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, domain, round(score, 6) AS score FROM z WHERE rank <= 5""")
def wi2_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    hits = search.nearest(p, _questions(p), 20).join(p.select("vec_id", "domain"), "vec_id")
    return search.balanced(hits, ("hotel", "software")).select("query_id", "rank", "vec_id", "domain", F.round("score", 6).alias("score"))


@query(f"""
WITH {SCORES},
terms AS (SELECT vec_id, i AS term, v[i] AS weight FROM (SELECT vec_id, v, unnest(generate_series(1, len(v))) AS i FROM e) WHERE abs(v[i]) > 0.25),
sp AS (SELECT a.vec_id AS query_id, b.vec_id, sum(a.weight * b.weight) AS score FROM terms a JOIN terms b ON a.term = b.term AND a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL),
sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS r FROM sp)
SELECT query_id, vec_id, round(score, 6) AS score, CAST(r AS INTEGER) AS rank FROM sr WHERE r <= 20""")
def jo8_sparse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JO8: components above 0.25 as the terms of a sparse vector; the 20 best of each question."""
    return _sparse(spark, sf_dir).withColumn("score", F.round("score", 6))


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return t.where(F.abs(F.col("x").cast("double")) > 0.25).select("vec_id", (F.col("i") + 1).alias("term"), F.col("x").cast("double").alias("weight"))


@query(f"""
WITH {SCORES},
terms AS (SELECT vec_id, i AS term, v[i] AS weight FROM (SELECT vec_id, v, unnest(generate_series(1, len(v))) AS i FROM e) WHERE abs(v[i]) > 0.25),
sp AS (SELECT a.vec_id AS query_id, b.vec_id, sum(a.weight * b.weight) AS score FROM terms a JOIN terms b ON a.term = b.term AND a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL),
sr AS (SELECT * FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS r FROM sp) WHERE r <= 20),
f AS (SELECT query_id, vec_id, sum(1.0::DOUBLE / (60 + r)) AS score FROM (SELECT query_id, vec_id, r FROM top UNION ALL SELECT query_id, vec_id, r FROM sr) GROUP BY ALL),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM f)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 9) AS score FROM z WHERE rank <= 5""")
def jo7_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JO7: dense and sparse rankings fused by reciprocal ranks."""
    return search.fuse([tk1_dense_top(spark, sf_dir), _sparse(spark, sf_dir)], 5).select("query_id", "rank", "vec_id", F.round("score", 9).alias("score"))


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _terms(spark, sf_dir)
    at = scratch(spark, "postings")
    impact_index(t).write.parquet(at)
    return top_sparse(spark.read.parquet(at), t, _asked(t), 20)


def _asked(terms: DataFrame) -> DataFrame:
    return terms.where(F.pmod("vec_id", F.lit(EVERY)) == 0).withColumnRenamed("vec_id", "query_id")


HYBRID = f"""
WITH {SCORES},
marks AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
ok AS (SELECT vec_id FROM embeddings LEFT JOIN marks ON doc_id = vec_id WHERE NOT coalesce(quality = 0, false) AND vec_id % 7 <> 0),
terms AS (SELECT vec_id, i AS term, v[i] AS weight FROM (SELECT vec_id, v, unnest(generate_series(1, len(v))) AS i FROM e) WHERE abs(v[i]) > 0.25),
dr AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s JOIN ok USING (vec_id)),
sp AS (SELECT a.vec_id AS query_id, b.vec_id, sum(a.weight * b.weight) AS score FROM terms a JOIN terms b ON a.term = b.term AND a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id WHERE b.vec_id IN (SELECT vec_id FROM ok) GROUP BY ALL),
sr AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS r FROM sp),
f AS (SELECT query_id, vec_id, round(sum(1.0::DOUBLE / (60 + r)), 12) AS score FROM (SELECT * FROM dr WHERE r <= 20 UNION ALL SELECT * FROM sr WHERE r <= 20) WHERE query_id IN (SELECT vec_id FROM terms) GROUP BY ALL),
g AS (SELECT f.*, e.source_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f.vec_id) AS a FROM f JOIN e USING (vec_id)),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY score DESC, vec_id) AS o FROM g WHERE a <= 20),
hybrid AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, source_id, score FROM h WHERE o <= 2)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, source_id, round(score, 9) AS score FROM hybrid WHERE rank <= 5"""


@query(HYBRID)
def tk3_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK3, JO7, JO8: the hybrid search of verified points, fused from vectors and terms, at most two of a source, five hits. Questions without terms aren't asked here."""
    p, t = _points(spark, sf_dir), _terms(spark, sf_dir)
    q = _asked(t)
    questions = _questions(p).join(q.select("query_id"), "query_id", "left_semi")
    return search.search(p, questions, per_source=2, terms=(t, q)).select("query_id", "rank", "vec_id", "source_id", F.round("score", 9).alias("score"))


@query(f"WITH {SCORES} SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, domain, round(score, 6) AS score FROM top WHERE r = 1")
def wi2_balanced_few(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WI2: with fewer hits than domains none is favoured."""
    p = _points(spark, sf_dir)
    hits = search.nearest(p, _questions(p), 20).join(p.select("vec_id", "domain"), "vec_id")
    return search.balanced(hits, ("hotel", "software"), 1).select("query_id", "rank", "vec_id", "domain", F.round("score", 6).alias("score"))


EVAL = f"""
{SCORES},
hits AS (SELECT * FROM top WHERE r <= 5 AND score >= 0.3),
c AS (SELECT vec_id AS query_id, [source_id, CAST((CAST(source_id AS INTEGER) + 1) % 10 AS VARCHAR)] AS expected, domain AS category, CAST(source_id AS INTEGER) < 8 AS answerable FROM e WHERE vec_id % 50 = 0),
per AS (SELECT c.query_id, min(CASE WHEN list_contains(c.expected, h.source_id) THEN h.r END) AS first, count(DISTINCT CASE WHEN list_contains(c.expected, h.source_id) THEN h.source_id END) AS found, count(h.source_id) AS retrieved FROM c LEFT JOIN hits h ON h.query_id = c.query_id GROUP BY c.query_id),
res AS (SELECT c.query_id, category, answerable, CASE WHEN first IS NULL THEN 0.0::DOUBLE ELSE 1.0 END AS hit, found / len(expected) AS recall, coalesce(1.0::DOUBLE / first, 0.0) AS reciprocal_rank, retrieved FROM c JOIN per USING (query_id))
"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    q = _questions(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    hits = search.nearest(p, q, 5).where("score >= 0.3").join(p.select("vec_id", "source_id"), "vec_id").withColumn("rank", F.row_number().over(w))
    n = F.col("source_id").cast("int")
    cases = q.select("query_id", F.array("source_id", ((n + 1) % 10).cast("string")).alias("expected"), F.col("domain").alias("category"), (n < 8).alias("answerable"))
    return search.evaluate(hits.select("query_id", "rank", "source_id"), cases)


@query(f"WITH {EVAL} SELECT query_id, category, answerable, hit, recall, round(reciprocal_rank, 6) AS reciprocal_rank, retrieved FROM res")
def ag8_query_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG8, WI3, SO3."""
    return _results(spark, sf_dir).withColumn("reciprocal_rank", F.round("reciprocal_rank", 6))


@query(f"WITH {EVAL} SELECT coalesce(category, 'GLOBAL') AS category, round(avg(hit), 3) AS hit_rate, round(avg(recall), 3) AS recall, round(avg(reciprocal_rank), 3) AS mrr, count(*) AS n FROM res WHERE answerable GROUP BY GROUPING SETS ((category), ())")
def ag7_retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.metrics(_results(spark, sf_dir))


@query(f"WITH {EVAL} SELECT round(avg(CASE WHEN retrieved = 0 THEN 1.0::DOUBLE ELSE 0.0 END), 3) AS abstention_accuracy, count(*) AS n FROM res WHERE NOT answerable")
def ag7_abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.abstention(_results(spark, sf_dir))
