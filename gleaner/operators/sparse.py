"""Top-k search of sparse vectors by an impact-ordered inverted index that skips blocks which can't matter.

A list holds the postings of a term whose weights have one sign, from the largest down, in blocks that know
their largest weight. The first blocks of a question's lists give k documents and so a score that the
result has to reach; each list then has a share of that score, and a document that reaches the score
in all reaches the share in some list. So blocks below their list's share are never opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Postings of a block; scores are ranked to so many digits.
BLOCK, DIGITS = 128, 9


def impact_index(documents: DataFrame, key: str = "vec_id", block: int = BLOCK) -> DataFrame:
    """(term, positive, block, most, postings) of documents(key, term, weight): blocks of (key, size of weight), largest first.

    The range sort parts a term that many documents have, and a block is the rows of one partition whose
    running numbers lie together, so no task holds a whole list. Null and zero weights have no posting.
    """
    rows = documents.where("weight <> 0").select("term", (F.col("weight") > 0).alias("positive"), F.abs("weight").alias("size"), F.col(key).alias("key"))
    order = ["term", "positive", F.desc("size"), "key"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("block", F.floor(F.monotonically_increasing_id() / block))
    posting = F.struct(F.col("size").alias("weight"), F.col("key"))
    return rows.groupBy("term", "positive", "block").agg(F.max("size").alias("most"), F.collect_list(posting).alias("postings"))


def _scored(candidates: DataFrame, documents: DataFrame, questions: DataFrame, key: str) -> DataFrame:
    """(query_id, key, score): the whole scores of candidates(query_id, key)."""
    q = questions.select("query_id", "term", F.col("weight").alias("_w"))
    return candidates.join(documents.select(key, "term", "weight"), key).join(q, ["query_id", "term"]).groupBy("query_id", key).agg(F.sum(F.col("weight") * F.col("_w")).alias("score"))


def _ranked(scores: DataFrame, key: str, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DIGITS)), key)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _others(key: str, others_only: bool) -> Column:
    return F.col("query_id") != F.col(key) if others_only else F.lit(True)


def wanted_blocks(index: DataFrame, documents: DataFrame, questions: DataFrame, k: int, key: str = "vec_id", others_only: bool = True) -> DataFrame:
    """(query_id, share, block columns): the blocks that each question has to open, and what a posting there must contribute."""
    q = questions.where("weight <> 0").select("query_id", "term", F.abs("weight").alias("_size"), (F.col("weight") > 0).alias("_up"))
    heads = index.groupBy("term", "positive").agg(F.max_by(F.struct("block", "postings"), F.struct("most", -F.col("block"))).alias("head"), F.max("most").alias("top"))
    lists = q.join(heads, (heads["term"] == q["term"]) & (heads["positive"] == q["_up"])).drop(heads["term"])  # products above zero
    first = lists.select("query_id", F.explode("head.postings.key").alias(key)).where(_others(key, others_only)).distinct()
    least = _ranked(_scored(first, documents, questions, key), key, k).where(F.col("rank") == k).select("query_id", (F.col("score") - 10**-DIGITS).alias("_least"))
    whole = Window.partitionBy("query_id")
    share = F.col("_least") * (F.col("_size") * F.col("top") / F.sum(F.col("_size") * F.col("top")).over(whole)) * (1 - 1e-9)
    shares = lists.join(least.where("_least > 0"), "query_id").select("query_id", "term", "_up", "_size", share.alias("share"))
    # questions whose kth score isn't above zero, or that found fewer than k, open all blocks of their terms
    rest = q.join(least.where("_least > 0"), "query_id", "left_anti").select("query_id", "term", F.explode(F.array(F.lit(True), F.lit(False))).alias("_up"), "_size", F.lit(float("-inf")).alias("share"))
    need = shares.unionByName(rest).withColumnRenamed("term", "_t")
    fits = (F.col("term") == F.col("_t")) & (F.col("positive") == F.col("_up")) & (F.col("most") * F.col("_size") >= F.col("share"))
    return index.join(need, fits).select("query_id", "term", "positive", "block", "_size", "share", "postings")


def top_sparse(index: DataFrame, documents: DataFrame, questions: DataFrame, k: int, key: str = "vec_id", others_only: bool = True) -> DataFrame:
    """(query_id, key, score, rank): the k highest dot products for each question among the documents that share a term with it.

    documents(key, term, weight) and the impact_index() of them; questions(query_id, term, weight). The same rows
    as the plain sum over all postings: equal scores to DIGITS digits are ranked by key. Weights may be below zero.
    """
    opened = wanted_blocks(index, documents, questions, k, key, others_only).select("query_id", "_size", "share", F.explode("postings").alias("p"))
    good = F.col("p.weight") * F.col("_size") >= F.col("share")
    candidates = opened.where(good).select("query_id", F.col("p.key").alias(key)).where(_others(key, others_only)).distinct()
    return _ranked(_scored(candidates, documents, questions, key), key, k)
