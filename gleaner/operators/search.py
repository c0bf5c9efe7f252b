"""Filtered, thresholded, reranked and source-diversified vector search for batches of questions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.sparse import impact_index, top_sparse

#: Questions scored in one pass over the vectors; only their vectors are broadcast.
BLOCK = 1024
TOP_K, MULTIPLIER, THRESHOLD, PER_SOURCE, BONUS = 5, 4, 0.59, 1, 0.06


def eligible(points: DataFrame, domain: str | None = None, topic: str | None = None, exclude_subtopics: tuple[str, ...] = ()) -> DataFrame:
    """Verified points of the domain and topic; a null subtopic is not excluded."""
    out = points.where(F.col("status") == "verified")
    out = out if domain is None else out.where(F.col("domain") == domain)
    out = out if topic is None else out.where(F.col("topic") == topic)
    return out.where(~F.coalesce(F.col("subtopic").isin(*exclude_subtopics), F.lit(False))) if exclude_subtopics else out


def nearest(points: DataFrame, questions: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", others_only: bool = True) -> DataFrame:
    """(query_id, key, score): the k points of highest cosine for each question(query_id, vector).

    Questions come in blocks; each task scores its points against a block and keeps k of each question,
    so what is shuffled does not grow with the points times the questions. Null vectors take no part.
    """
    points, questions = points.where(F.col(vector).isNotNull()), questions.where(F.col(vector).isNotNull())
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    n = questions.count()
    parts = questions.select("query_id", vector).withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(-(-n // BLOCK) or 1)))
    out = None
    for b in range(-(-n // BLOCK)):
        block = parts.where(F.col("_b") == b).toPandas()
        if not len(block):
            continue
        ids, q = block["query_id"].to_numpy(), np.array(block[vector].tolist(), np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        some = _scored(points, ids, q, k, key, vector, others_only)
        out = some if out is None else out.unionByName(some)
    if out is None:
        return points.sparkSession.createDataFrame([], f"query_id long, {key} long, score double")
    return out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _scored(points: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, key: str, vector: str, others_only: bool) -> DataFrame:
    shared = points.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        for batch in batches:
            for i in range(0, len(batch), 4096):
                part = batch.iloc[i : i + 4096]
                own, v = part[key].to_numpy(), np.array(part[vector].tolist(), np.float64)
                s = q @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).T
                if others_only:
                    s[ids[:, None] == own[None, :]] = -np.inf
                n = min(k, len(own))
                kth = np.partition(s, -n, axis=1)[:, -n]
                row, col = np.nonzero((s >= kth[:, None]) & np.isfinite(s))
                x = pd.DataFrame({"query_id": ids[row], key: own[col], "score": s[row, col]}).sort_values(["query_id", "score", key], ascending=[True, False, True])
                yield x.groupby("query_id", sort=False).head(k)

    return points.select(key, vector).mapInPandas(run, f"query_id long, {key} long, score double")


def rerank(hits: DataFrame, question_tokens: Column, title_tokens: Column, weight: float = BONUS) -> DataFrame:
    """score plus weight times the share of the title's tokens in the question, 1 at most; equal scores keep their order."""
    share = F.when(F.size(title_tokens) > 0, F.size(F.array_intersect(question_tokens, title_tokens)) / F.size(title_tokens)).otherwise(0.0)
    return hits.withColumns({"_before": F.col("score"), "score": F.least(F.lit(1.0), F.col("score") + weight * share)})


def diversify(hits: DataFrame, k: int = TOP_K, per_source: int = PER_SOURCE, source: str = "source_id", tie: str = "vec_id") -> DataFrame:
    """The k best hits of each question with at most per_source of one source, with their rank."""
    order = [F.desc("score"), *([F.desc("_before")] if "_before" in hits.columns else []), F.col(tie)]
    own = Window.partitionBy("query_id", source).orderBy(*order)
    kept = hits.withColumn("_s", F.row_number().over(own)).where(F.col("_s") <= per_source)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).drop("_s", "_before")


def search(
    points: DataFrame, questions: DataFrame, k: int | None = TOP_K, threshold: float | None = THRESHOLD, per_source: int = PER_SOURCE, titles: bool = True,
    domain: str | None = None, topic: str | None = None, exclude_subtopics: tuple[str, ...] = (), terms: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """The whole search: verified points of the domain and topic, top 4k, threshold on the raw score, title bonus, diversification.

    points(vec_id, embedding, source_id, status, title_tokens), with domain, topic and subtopic where these
    are asked for; questions(query_id, embedding, question_tokens). A k of 0 or None is the default.

    With `terms`, sparse vectors of the points and of the questions, (vec_id, term, weight) and (query_id, term, weight),
    the search is hybrid: the top 4k by vectors and the top 4k by terms are fused by reciprocal ranks, of which 4k are
    diversified, without threshold and title bonus. Questions without terms are searched by vectors as before.
    """
    k = k or TOP_K
    points = eligible(points, domain, topic, exclude_subtopics)
    if terms is not None:
        own, asked = (t.where("weight <> 0") for t in terms)
        some = asked.select("query_id").distinct()
        hybrid = _hybrid(points, questions.join(some, "query_id", "left_semi"), own, asked, k, per_source)
        plain = search(points, questions.join(some, "query_id", "left_anti"), k, threshold, per_source, titles)
        return hybrid.unionByName(plain.select(*hybrid.columns))
    hits = nearest(points, questions, k * MULTIPLIER)
    hits = hits if threshold is None else hits.where(F.col("score") >= threshold)
    hits = hits.join(points.drop("embedding"), "vec_id")
    if titles:
        hits = rerank(hits.join(questions.select("query_id", "question_tokens"), "query_id"), F.col("question_tokens"), F.col("title_tokens"))
    return diversify(hits, k, per_source)


def _hybrid(points: DataFrame, questions: DataFrame, own: DataFrame, asked: DataFrame, k: int, per_source: int) -> DataFrame:
    dense = nearest(points, questions, k * MULTIPLIER)
    dense = dense.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    own = own.join(points.select("vec_id"), "vec_id", "left_semi")
    found = top_sparse(impact_index(own), own, asked.join(questions.select("query_id"), "query_id", "left_semi"), k * MULTIPLIER)
    fused = fuse([dense, found], k * MULTIPLIER).drop("rank").withColumn("score", F.round("score", 12))
    return diversify(fused.join(points.drop("embedding"), "vec_id"), k, per_source)


def balanced(pools: DataFrame, domains: tuple[str, ...], k: int = TOP_K) -> DataFrame:
    """Of pools(query_id, domain, vec_id, score) the best of each domain in domain order, then the rest by score.

    With fewer hits than domains no domain is favoured: the k best of all rows.
    """
    if k < len(domains):
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return pools.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    head = F.row_number().over(Window.partitionBy("query_id", "domain").orderBy(F.desc("score"), "vec_id"))
    at = F.array_position(F.array(*map(F.lit, domains)), F.col("domain"))
    first = F.col("_h") == 1
    order = Window.partitionBy("query_id").orderBy((~first).cast("int"), F.when(first, F.col("_at")).otherwise(0), F.desc("score"), "vec_id")
    out = pools.where(F.col("domain").isin(*domains)).withColumns({"_h": head, "_at": at})
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_h", "_at")


def fuse(rankings: list[DataFrame], k: int, rrf_k: int = 60, key: str = "vec_id") -> DataFrame:
    """Reciprocal rank fusion of rankings(query_id, key, rank)."""
    rows = rankings[0].select("query_id", key, "rank")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select("query_id", key, "rank"))
    fused = rows.groupBy("query_id", key).agg(F.sum(F.lit(1.0) / (rrf_k + F.col("rank"))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), key)
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def balanced_search(points: DataFrame, questions: DataFrame, domains: tuple[str, ...] = ("hotel", "software"), k: int | None = TOP_K, **options) -> DataFrame:
    """A search of each domain whose results are balanced; with fewer hits than domains one search of all points. options: as of search()."""
    k = k or TOP_K
    if k < len(domains):
        return search(points, questions, k, **options)
    pools = [search(points, questions, k, domain=d, **options) for d in domains]
    rows = pools[0]
    for p in pools[1:]:
        rows = rows.unionByName(p)
    return balanced(rows.drop("rank"), domains, k)


def evaluate(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """One row for each case: hit, recall, reciprocal rank, and how many sources were retrieved.

    hits(query_id, rank, source_id), cases(query_id, expected array, category, answerable).
    """
    pairs = cases.select("query_id", "expected").join(hits, "query_id", "left")
    good = F.array_contains("expected", F.col("source_id"))
    per = pairs.groupBy("query_id").agg(
        F.min(F.when(good, F.col("rank"))).alias("first"), F.count_distinct(F.when(good, F.col("source_id"))).alias("found"), F.count("source_id").alias("retrieved"))
    return cases.join(per, "query_id").select(
        "query_id", "category", "answerable", F.col("first").isNotNull().cast("double").alias("hit"),
        F.when(F.size("expected") > 0, F.col("found") / F.size("expected")).otherwise(0.0).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), "retrieved",
    )


def metrics(results: DataFrame) -> DataFrame:
    """Hit rate, mean recall and MRR over the answerable cases of each category and GLOBAL, to 3 digits."""
    ok = results.where("answerable")
    agg = [F.round(F.avg("hit"), 3).alias("hit_rate"), F.round(F.avg("recall"), 3).alias("recall"), F.round(F.avg("reciprocal_rank"), 3).alias("mrr"), F.count(F.lit(1)).alias("n")]
    return ok.rollup("category").agg(F.grouping("category").alias("_all"), *agg).where(F.col("n") > 0).withColumn("category", F.when(F.col("_all") == 1, "GLOBAL").otherwise(F.col("category"))).drop("_all")


def abstention(results: DataFrame) -> DataFrame:
    """The share of unanswerable cases that retrieved nothing."""
    return results.where("NOT answerable").agg(F.round(F.avg((F.col("retrieved") == 0).cast("double")), 3).alias("abstention_accuracy"), F.count(F.lit(1)).alias("n"))
