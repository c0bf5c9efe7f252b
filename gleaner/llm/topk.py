"""Exact top-k inner products by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.shared import materialize

BINS = 256
#: Queries that are scored in one pass over the vectors; their vectors are all that is broadcast.
BLOCK = 1024
#: Once a query has at most this many times k candidates above its bound, it is refined no further.
ENOUGH = 8
LIMIT = (1 << 63) - 1


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x) for each component; rows with nulls or non-finite ones go."""
    x = F.col(vector_col)
    whole = x.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(whole).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long")).alias("v")
    )


def _matrix(rows: pd.Series, dim: int) -> np.ndarray:
    return np.array([x for x in rows], np.int64).reshape(len(rows), dim)


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer products; those that a 64-bit integer can't hold are the nearest one that it can.

    By floating point where every partial sum stays below 2**53, by Python's integers above 2**62.
    """
    most = float(_reach(queries)) * _reach(vectors) * queries.shape[1]
    if most < 2**53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return queries @ vectors.T
    exact = queries.astype(object) @ vectors.astype(object).T
    return np.clip(exact, -LIMIT - 1, LIMIT).astype(np.int64)


def _reach(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def _ordered(s: np.ndarray) -> np.ndarray:
    """64-bit integers as unsigned ones in the same order, whose differences never overflow."""
    return s.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def _block(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """The k best candidates of each query of one block, with ties at the kth value still in."""
    spark, dim = vectors.sparkSession, q.shape[1]
    reach = vectors.agg(F.max(F.array_max("v")).alias("hi"), F.min(F.array_min("v")).alias("lo")).first()
    reach = max(reach["hi"] or 0, -(reach["lo"] or 0))
    # no score of query i is beyond ±top[i]; bounds are Python's integers
    top = [min(LIMIT, reach * sum(abs(int(c)) for c in v)) for v in q]
    low, width = [-t for t in top], [-(-(2 * t + 1) // BINS) for t in top]
    above = np.zeros(len(q), np.int64)  # candidates known to lie above the range under refinement
    floor, open_ = [-LIMIT - 1] * len(q), np.ones(len(q), bool)
    query_block = spark.sparkContext.broadcast((ids, q))
    while open_.any():
        which = np.flatnonzero(open_)
        state = (which, _ordered(np.array([low[i] for i in which], np.int64)), np.array([width[i] for i in which], np.uint64))

        def count(batches: Iterator[pd.DataFrame], state=state) -> Iterator[pd.DataFrame]:
            ids, q = query_block.value
            which, low, width = state
            total = np.zeros((len(which), BINS), np.int64)
            for b in batches:
                for i in range(0, len(b), 2048):
                    part = b.iloc[i : i + 2048]
                    own = part["vec_id"].to_numpy()
                    s = _ordered(_scores(q[which], _matrix(part["v"], dim)))
                    at = (s - low[:, None]) // width[:, None]
                    ok = (s >= low[:, None]) & (at < BINS) & (ids[which][:, None] != own[None, :])
                    row = np.broadcast_to(np.arange(len(which))[:, None], at.shape)[ok]
                    total += np.bincount(row * BINS + at[ok].astype(np.int64), minlength=total.size).reshape(total.shape)
            yield pd.DataFrame({"i": which, "h": list(total)})

        parts = vectors.mapInPandas(count, "i int, h array<long>")
        summed = parts.select("i", F.posexplode("h").alias("bin", "n")).where("n > 0").groupBy("i", "bin").agg(F.sum("n").alias("n"))
        hist = np.zeros((len(q), BINS), np.int64)
        for r in summed.toLocalIterator():  # at most BLOCK x BINS small rows
            hist[r["i"], r["bin"]] = r["n"]
        for i in which:
            from_top = above[i] + np.cumsum(hist[i][::-1])
            if from_top[-1] < k:  # fewer than k candidates in all
                floor[i], open_[i] = -LIMIT - 1, False
                continue
            b = BINS - 1 - int(np.argmax(from_top >= k))
            floor[i] = low[i] + b * width[i]
            if from_top[BINS - 1 - b] <= ENOUGH * k or width[i] == 1:
                open_[i] = False
                continue
            above[i] = from_top[BINS - 1 - b] - hist[i][b]
            low[i], width[i] = floor[i], -(-width[i] // BINS)
    floor = np.array([min(f, LIMIT) for f in floor], np.int64)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = query_block.value
        for b in batches:
            for i in range(0, len(b), 2048):
                part = b.iloc[i : i + 2048]
                own = part["vec_id"].to_numpy()
                s = _scores(q, _matrix(part["v"], dim))
                row, col = np.nonzero((s >= floor[:, None]) & (ids[:, None] != own[None, :]))
                x = pd.DataFrame({"query_id": ids[row], "vec_id": own[col], "score": s[row, col]})
                # of many equal scores, only the k smallest ids of a batch can be among the k best
                x = x.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                yield x.groupby("query_id", sort=False).head(k)

    return vectors.mapInPandas(keep, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query row.

    Queries are the rows whose id is divisible by `every`; candidates are all rows but those of the
    query's own id. Equal scores go to the smaller id; repeated rows are separate candidates. Rows of one
    query id share one ranking, over the scores of each of their different vectors. Scaled components and
    scores beyond 64-bit integers are the nearest such integer. Rows with
    a null id, a null vector, or one that holds nulls or non-finite components take no part; vectors
    of another length than the block of queries meet only queries of their length. Queries come in
    blocks of bounded size; each pass counts the scores of all vectors into per-query histograms,
    whose sums locate the kth value, and a last pass keeps what reaches it.
    """
    spark = vectors.sparkSession
    v = materialize(scaled(vectors, id_col, vector_col, scale), "vectors")
    out = None
    for (dim,) in v.select(F.size("v").alias("d")).distinct().orderBy("d").collect():  # one row for each length
        same = v.where(F.size("v") == dim)
        queries = same.where(F.pmod("vec_id", F.lit(every)) == 0)
        for ids, q in _query_blocks(queries, dim):
            found = materialize(_block(same, ids, q, k), "top")
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _query_blocks(queries: DataFrame, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the different query rows, BLOCK at a time; the driver holds one partition of them."""
    rows: list = []
    for r in queries.dropDuplicates().orderBy("vec_id").toLocalIterator():
        rows.append(r)
        if len(rows) == BLOCK:
            yield np.array([x["vec_id"] for x in rows], np.int64), _matrix(pd.Series([x["v"] for x in rows]), dim)
            rows = []
    if rows:
        yield np.array([x["vec_id"] for x in rows], np.int64), _matrix(pd.Series([x["v"] for x in rows]), dim)
