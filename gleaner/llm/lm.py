"""Scoring of documents by a recurrent language model learned from the training folds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import recurrent
from gleaner.llm.hashing import spaced_words
from gleaner.llm.recurrent import REST, Weights
from gleaner.llm.shared import by_size, discard, materialize, whole_groups

#: The network tells at least so many words apart, and one in so many of the counted ones beyond that; every other
#: word is its token REST, refined by word counts.
HEAD, HEAD_SHARE = 2046, 128
#: Words, the most frequent ones, whose counts every task holds; the counts of others are joined.
COUNTED = 300_000
#: Training tokens of a shard, which one task learns from in one pass, and rounds of averaging the shards' weights.
SHARD, ROUNDS = 2_000_000, 2
#: The key of the token that ends a document; a word's key is a hash of its bytes.
END_KEY = np.uint64(1)
#: Characters that are scored at once.
SLICE = 1 << 22
LOG10 = float(np.log(10))


def keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the tokens of all texts, tokens of each): runs of all but the six ASCII space characters, A-Z lower-cased, and an end."""
    h, n = spaced_words(texts)
    out = np.full(len(h) + len(n), END_KEY)
    out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
    return out, n + 1


class Table:
    """The places of 64-bit keys in a list, looked up for many keys at once: open addressing by their highest bits."""

    def __init__(self, listed: np.ndarray) -> None:
        bits = max(8, int(4 * len(listed)).bit_length())
        self.listed, self.shift, self.slots = listed, np.uint64(64 - bits), np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(listed)), (listed >> self.shift).astype(np.int64)
        while len(left):
            free = self.slots[at[left]] < 0
            self.slots[at[left[free]]] = left[free]
            left = left[self.slots[at[left]] != left]
            at[left] = (at[left] + 1) & (len(self.slots) - 1)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each key in the list, or -1."""
        out, left, at = np.full(len(wanted), -1), np.arange(len(wanted)), (wanted >> self.shift).astype(np.int64)
        while len(left):
            place = self.slots[at]
            some = place >= 0
            left, at, place = left[some], at[some], place[some]
            hit = self.listed[place] == wanted[left]
            out[left[hit]] = place[hit]
            left, at = left[~hit], (at[~hit] + 1) & (len(self.slots) - 1)
        return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all rows of docs(text); a word is named by its key."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def counted() -> pa.RecordBatch:
            word, c = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(c)], ["word", "c"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for some in by_size(texts):
                k, _ = keys(texts[some])
                waiting.append(k)
                n += len(k)
                if n > 2_000_000:
                    yield counted()
                    waiting, n = [], 0
        if waiting:
            yield counted()

    return docs.select("text").mapInArrow(count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _sharded(docs: DataFrame, known: np.ndarray, ids: np.ndarray, shards: int) -> DataFrame:
    """(shard, own, tokens): the network's tokens of each row of docs(doc_id, text), 16 bits each, in a shard by a hash of id and text."""
    shared = docs.sparkSession.sparkContext.broadcast((known, ids))  # bounded by the counted words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids = shared.value
        table, ids = Table(known), np.append(ids, REST).astype(np.uint16)
        for batch in batches:
            own, texts = batch.column(0), batch.column(1).to_pylist()
            for some in by_size(texts):
                k, n = keys(texts[some])
                t = ids[table.find(k)].tobytes()
                ends = 2 * np.cumsum(n)
                yield pa.RecordBatch.from_arrays([own.slice(some.start, len(n)), pa.array([t[e - 2 * m : e] for e, m in zip(ends.tolist(), n.tolist(), strict=True)], pa.binary())], ["own", "tokens"])

    own = F.xxhash64("doc_id", "text").alias("own")
    return docs.select(own, "text").mapInArrow(run, "own long, tokens binary").select(F.pmod("own", F.lit(shards)).cast("int").alias("shard"), "own", "tokens")


def _averaged(sharded: DataFrame, weights: Weights) -> Weights:
    """Weights trained on each shard in one pass, in order of its hashes, and averaged by the tokens they saw."""
    size, piece = len(weights.flat()), 4096
    shared = sharded.sparkSession.sparkContext.broadcast(weights)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, total, n = shared.value, np.zeros(size), 0
        for x, begins in whole_groups(batches, ["shard"]):
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(x)], strict=True):
                own = x["tokens"].iloc[a:b]
                tokens, lengths = np.frombuffer(b"".join(own), np.uint16), np.array([len(t) // 2 for t in own])
                total += recurrent.train(start.load(start.flat()), tokens, lengths).flat().astype(np.float64) * len(tokens)
                n += len(tokens)
        if n:
            yield pd.DataFrame({"k": np.arange(-(-size // piece)), "n": n, "w": [total[i : i + piece] for i in range(0, size, piece)]})

    parts = sharded.repartition("shard").sortWithinPartitions("shard", "own").mapInPandas(fit, "k int, n long, w array<double>")
    summed = parts.select("k", "n", F.posexplode("w").alias("i", "x")).groupBy("k", "i").agg((F.sum("x") / F.sum("n")).alias("x"))
    flat = weights.flat().astype(np.float64)
    for r in summed.groupBy("k").agg(F.collect_list(F.struct("i", "x")).alias("w")).toLocalIterator():  # the weights of one network
        flat[r["k"] * piece + np.array([x["i"] for x in r["w"]])] = [x["x"] for x in r["w"]]
    return weights.load(flat)


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of the words of the highest counts, `most` at most, with all words of the lowest count taken or none."""
    by = counts.groupBy(F.least("c", F.lit(1_000_000)).alias("c")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("c", ascending=False)
    low = by["c"][by["n"].cumsum() <= most].min()
    if not low > 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    rows = counts.where((F.col("c") >= int(low)) & (F.col("word") != int(END_KEY))).toPandas().sort_values(["c", "word"], ascending=[False, True])
    return rows["word"].to_numpy(np.int64).view(np.uint64), rows["c"].to_numpy(np.int64)


def score(docs: DataFrame, held: Column, train_on: Column, rounds: int = ROUNDS, head: int | None = None, counted: int = COUNTED, shard: int = SHARD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of docs(doc_id, text).

    Words are counted over all rows where train_on holds, and these counts give base_score and the
    probabilities of words outside the network's head, which grows with the counted vocabulary where
    `head` is not given. The network is trained on every one of those rows: a hash of id and text puts
    each in a shard of about `shard` tokens, and each shard in one of the rounds; the shards of a round
    are learned from at once, each from the weights of the round before, and their weights are averaged.
    So the result depends on the rows only, not on files or cores, up to rounding. A null text is empty:
    its one token is the end. Rows with a null id or a null in a column are scored like any other; whether
    they are learned from is up to train_on (op7: they are held out). Rows that repeat are scored each and
    learned from each. Without training rows all counts are zero and the network is untrained. Other
    columns of docs are not returned.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", held.alias("held_out"), train_on.alias("train_on"))
    learned = docs.where("train_on").select("doc_id", "text")
    counts = materialize(word_counts(learned), "words")
    row = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = int(row["n"] or 0), int(row["v"])
    known, c = _frequent(counts, counted)
    end = counts.where(F.col("word") == int(END_KEY)).first()
    known, c = np.append(END_KEY, known), np.append(end["c"] if end else 0, c)
    in_head = min(len(known), 1 + (max(HEAD, len(known) // HEAD_SHARE) if head is None else head))
    # token 0 is the end, 1 is REST, then the head's words by frequency
    ids = np.where(np.arange(len(known)) < in_head, np.arange(len(known)) + 1, REST)
    ids[0] = recurrent.END
    other = n - int(c[:in_head].sum())
    weights = Weights.fresh(np.concatenate((c[:1], [other], c[1:in_head])).astype(np.float64))
    if n:
        shards = max(rounds, -(-n // shard))
        sharded = materialize(_sharded(learned, known, ids, shards), "shards")
        for r in range(rounds):
            weights = _averaged(sharded.where(F.col("shard") % rounds == r), weights)
        discard(sharded)

    spread, rest = n + 0.1 * (v + 1), other + 0.1 * max(1, v + 1 - in_head)
    shared = spark.sparkContext.broadcast((weights, known, c, ids))  # bounded by head and counted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known, c, ids = shared.value
        table, tokens_of = Table(known), np.append(ids, REST)
        log_c, seen = np.append(np.log10(c + 0.1), 0.0), np.append(c > 0, False)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for some in by_size(texts, SLICE):
                k, size = keys(texts[some])
                at = table.find(k)
                t, owner = tokens_of[at], np.repeat(np.arange(len(size)), size)
                logs, gone = log_c[at], at < 0

                def summed(x: np.ndarray, owner=owner, size=size) -> np.ndarray:
                    return np.bincount(owner, weights=x, minlength=len(size))

                net = recurrent.score(weights, t, size) / LOG10 + summed(np.where((t == REST) & ~gone, logs - np.log10(rest), 0))
                tails = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(summed(gone)))).astype(np.int32)), pa.array(k[gone].view(np.int64)))
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(i).slice(some.start, len(size)) for i in (0, 1)), pa.array(size.astype(np.int64)), pa.array(summed(seen[at]).astype(np.int64)),
                    pa.array(summed(np.where(gone, 0, logs - np.log10(spread)))), pa.array(net), tails,
                ], ["doc_id", "held_out", "n_tokens", "known", "base", "net", "tail"])

    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, known long, base double, net double, tail array<long>"
    scored = docs.select("doc_id", "held_out", "text").mapInArrow(run, kind)
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    # words that are not among the frequent ones: their counts are joined
    tail = scored.select("row", F.explode("tail").alias("word")).join(counts.hint("merge"), "word", "left").select("row", F.coalesce("c", F.lit(0)).alias("c"))
    tail = tail.groupBy("row").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("c") > 0).alias("t_known"), F.sum(F.log10(F.col("c") + 0.1)).alias("logs"))
    out = scored.drop("tail").join(tail.hint("merge"), "row", "left")
    logs, m = F.coalesce("logs", F.lit(0.0)), F.coalesce("m", F.lit(0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("t_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + logs - m * F.lit(float(np.log10(spread)))).alias("base_score"),
        (F.col("net") + logs - m * F.lit(float(np.log10(rest)))).alias("score"),
    )
