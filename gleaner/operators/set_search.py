"""The k sets of words most like each of many, by F1.

Equal sets are one, and their words are numbered from the rarest. Two ways lead to the pairs that count, both
exact; the numbers of sets that hold each word tell which is shorter.

Sets that share rare words, if any: every word has a head, the few sets that would be best if that word alone
were shared. Heads settle all pairs that share one word, and give each set a score that its k best have to reach.
Pairs that reach it share several words, and so one near the beginning of both: only these places are joined,
under bounds from what follows them. A word that all sets hold joins none of them.

Sets of prose, in which most pairs share words of every frequency: they are dealt into parts, every two of which meet in one
task that counts their shared words, the frequent ones as bits, and keeps the k best of each set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.plans.registry import scratch

EPS = 1e-12
#: Pairs of sets whose shared words are counted in the time that a joined pair takes.
COUNTED = 100
#: Sets of a part.
PART = 1 << 15
#: Words that are compared as bits, pairs of sets and places of rare words that are worked on at once.
BITS, CELLS, PLACES = 128, 1 << 19, 1 << 22
#: Sets from whose scores the others' least score is taken, and pairs that are held before the best of them are picked.
TRIED, HELD = 1024, 1 << 20


def _kept(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: what comes before it is not worked out again, and its numbers stay."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _sets(rows: DataFrame, key: list[str], k: int) -> DataFrame:
    """(set, n, words, keys, top): the different sets of words, with the k highest keys of each."""
    own = rows.select(F.struct(*key).alias("key"), F.array_sort(F.array_distinct("tokens")).alias("words"))
    own = own.withColumn("set", F.md5(F.array_join("words", " ")))
    best = own.withColumn("_r", F.row_number().over(Window.partitionBy("set").orderBy(F.desc("key")))).where(F.col("_r") <= k)
    sets = best.groupBy("set").agg(F.first("words").alias("words"), F.sort_array(F.collect_list("key"), asc=False).alias("keys"))
    return _kept(sets.withColumns({"n": F.size("words"), "top": F.col("keys")[0]}), "sets")


def _numbered(sets: DataFrame, words: DataFrame) -> DataFrame:
    """sets with an id, higher for a higher key, and the ids of their words that any reference holds, from the rarest; met: how often these are in a reference, without the most frequent one."""
    known = sets.select("set", F.explode("words").alias("w")).join(words, "w").groupBy("set").agg(F.array_sort(F.collect_list("w_id")).alias("order"), (F.sum("c") - F.max("c")).alias("met"))
    out = sets.drop("words").join(known, "set", "left").withColumns({"order": F.coalesce("order", F.array().cast("array<bigint>")), "met": F.coalesce("met", F.lit(0))})
    return _kept(out.orderBy("top").withColumn("id", F.monotonically_increasing_id()), "numbered-sets")


def _placed(sets: DataFrame, carry: list[str]) -> DataFrame:
    """A row for each word of a set that any reference holds: (id, n, ..., place, w), the rarest word first; words of none come before all."""
    x = sets.select("id", "n", *carry, (F.col("n") - F.size("order")).alias("none"), F.posexplode("order").alias("at", "w"))
    return x.select("id", "n", *carry, "w", (F.col("none") + F.col("at")).alias("place"))


def _f1(shared: Column, n: Column, m: Column) -> Column:
    return 2.0 * shared / (n + m)


def nearest_sets(queries: DataFrame, references: DataFrame, k: int, key: tuple[str, ...] = ("video_id", "step_number")) -> DataFrame:
    """(key..., r_key..., f1, rank): for each row of queries(key, tokens) the k rows of references(key, tokens) of highest F1, itself left out.

    F1 is twice the number of shared words over the sum of both numbers; two rows without words have 1. Equal
    scores go by the higher key. Where fewer than k share a word, the highest keys fill up at zero. Repeated words of a row
    count once; null tokens are none. Keys tell rows apart.
    """
    key, same = list(key), queries is references
    names = {c: f"r_{c}" for c in key}
    queries, references = (x.select(*key, F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")) for x in (queries, references))
    r = _sets(references, key, k + 1)
    words = r.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    words = _kept(words.orderBy("c", "w").withColumn("w_id", F.monotonically_increasing_id()), "set-words")
    r = _numbered(r, words)
    q = r if same else _numbered(_sets(queries, key, 1), words)
    asked, met = q.agg(F.count(F.lit(1)), F.sum("met")).first()
    held = r.count()
    scored = _counted(q, r, k + 1, asked, held, same) if (met or 0) * COUNTED > asked * held else _joined(q, r, k)

    rank = Window.partitionBy("id").orderBy(F.desc("f1"), F.desc("key"))
    keyed = scored.join(r.select(F.col("id").alias("r_id"), "keys"), "r_id").select("id", "f1", F.explode("keys").alias("key"))
    best = keyed.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= k + 1).groupBy("id").agg(F.collect_list(F.struct("f1", "key")).alias("best"))  # k + 1 rows each
    best = q.select("set", "id").join(best, "id").drop("id")

    rows = queries.select(F.struct(*key).alias("own"), F.array_sort(F.array_distinct("tokens")).alias("words"))
    rows = rows.select("own", F.md5(F.array_join("words", " ")).alias("set"), (F.size("words") == 0).alias("bare"))
    kind = best.schema["best"].dataType
    zero = [F.struct(F.when(F.col("bare") & F.lit(bare), 1.0).otherwise(0.0).alias("f1"), F.struct(*[F.lit(v).alias(c) for c, v in zip(key, values, strict=True)]).alias("key")) for values, bare in _highest(r, k + 1)]
    every = F.concat(F.coalesce("best", F.array().cast(kind)), F.array(*zero).cast(kind))
    x = rows.join(best, "set", "left").select("own", F.explode(every).alias("x")).where(F.col("own") != F.col("x.key"))
    x = x.groupBy("own", "x.key").agg(F.max("x.f1").alias("f1"))
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("own").orderBy(F.desc("f1"), F.desc("key")))).where(F.col("rank") <= k)
    return x.select("own.*", *[F.col("key")[c].alias(to) for c, to in names.items()], "f1", "rank")


def _joined(q: DataFrame, r: DataFrame, k: int) -> DataFrame:
    """(id, r_id, f1) of the pairs that may be among the k best keys of a set beside its own; joined by their rarer words."""
    asked = _placed(q, [])
    held = _placed(r, ["top"]).select(F.col("id").alias("r_id"), F.col("n").alias("m"), "top", "w", F.col("place").alias("r_place"))

    # what the heads give
    first = Window.partitionBy("w").orderBy("m", F.desc("top"))
    heads = held.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1).select("w", "r_id")
    sure = _with_scores(asked.join(heads, "w").select("id", "r_id").distinct(), q, r)
    rank = Window.partitionBy("id").orderBy(F.desc("f1"), F.desc("key"))
    keyed = sure.join(r.select(F.col("id").alias("r_id"), "keys"), "r_id").select("id", "f1", F.explode("keys").alias("key"))
    least = keyed.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") == k + 1).select("id", F.col("f1").alias("least"), F.col("key").alias("least_key"))

    # pairs that share two words or more and may reach that
    asked = asked.join(least, "id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    shared = F.greatest(F.lit(2), F.ceil(F.col("least") * F.col("n") / (2 - F.col("least")) - 1e-9))
    front, back = asked.where(F.col("place") <= F.col("n") - shared), held.where(F.col("r_place") <= F.col("m") - 2)
    most = _f1(F.least(F.col("n") - F.col("place"), F.col("m") - F.col("r_place")), F.col("n"), F.col("m"))
    may = (most > F.col("least") + EPS) | ((most >= F.col("least") - EPS) & (F.col("least_key").isNull() | (F.col("top") >= F.col("least_key"))))
    found = _with_scores(front.join(back, "w").where(may).select("id", "r_id").distinct(), q, r)
    return sure.unionByName(found).distinct()


def _counted(q: DataFrame, r: DataFrame, k: int, asked: int, held: int, same: bool) -> DataFrame:
    """(id, r_id, f1) of the k sets of r that share a word and have the highest F1 with each of q, of equal ones those of the highest id; every two parts meet."""
    i, j = (max(1, -(-n // PART)) for n in (asked, held))
    some = ("id", "n", "order")

    def part(sets: DataFrame, parts: int, others: int) -> DataFrame:
        x = sets.where(F.size("order") > 0).select(*some, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("p"))
        return x.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    if same:
        # each two parts meet once, for both
        x = part(r, j, j).select(*some, F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), (F.col("p") > F.col("o")).alias("r"))
    else:
        x = part(q, i, j).select(*some, F.col("p").alias("i"), F.col("o").alias("j"), F.lit(False).alias("r"))
        x = x.unionByName(part(r, j, i).select(*some, F.col("o").alias("i"), F.col("p").alias("j"), F.lit(True).alias("r")))
    group = F.col("j") * (F.col("j") + 1) / 2 + F.col("i") if same else F.col("i") * j + F.col("j")
    x = x.withColumn("group", group.cast("int")).repartitionById(j * (j + 1) // 2 if same else i * j, "group")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        rows = pa.Table.from_batches(batches) if batches else None
        for g in pc.unique(rows["group"]) if batches else ():
            own = rows.filter(pc.equal(rows["group"], g))
            alone = same and own["i"][0] == own["j"][0]
            a, b = (_block(own.filter(pc.equal(own["r"], side))) for side in (False, not alone))
            for ids, r_ids, f1 in _best(a, b, k, same and not alone):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(r_ids), pa.array(f1)], ["id", "r_id", "f1"])

    found = x.mapInArrow(compare, "id long, r_id long, f1 double")
    rank = Window.partitionBy("id").orderBy(F.desc("f1"), F.desc("r_id"))
    return found.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= k).drop("_r")


def _block(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ids of sets, their sizes, and the rows and ids of their words; dealt anew, so that the first ones are like the others."""
    rows = rows.take(np.random.default_rng(0).permutation(len(rows)))
    order = rows["order"].combine_chunks()
    size = pc.list_value_length(order).to_numpy(zero_copy_only=False)
    return rows["id"].to_numpy(), rows["n"].to_numpy().astype(np.int64), np.repeat(np.arange(len(rows)), size), pc.list_flatten(order).to_numpy(zero_copy_only=False)


def _pick(of: np.ndarray, other: np.ndarray, f1: np.ndarray, k: int) -> np.ndarray:
    """The places of the k pairs of each `of` that have the highest f1, then the highest `other`."""
    at = np.lexsort((-other, -f1, of))
    own = of[at]
    new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.empty(0, np.int64)
    return at[np.arange(len(own)) - np.repeat(new, np.diff(np.append(new, len(own)))) < k]


def _best(a: tuple, b: tuple, k: int, both: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, other ids, F1): for each set of the block a the k sets of b that share a word and have the highest F1, of equal ones those of the highest id; if `both`, for each of b those of a too."""
    (a_id, n, a_row, a_word), (b_id, m, b_row, b_word) = a, b
    if not len(a_id) or not len(b_id):
        return
    words, w = np.unique(np.concatenate((a_word, b_word)), return_inverse=True)
    w, v = w[: len(a_word)], w[len(a_word) :]
    in_a, in_b = (np.bincount(x, minlength=len(words)) for x in (w, v))
    often = np.argsort(-in_a * in_b, kind="stable")[:BITS]
    bit = np.full(len(words), -1)
    bit[often] = np.arange(len(often))

    def bits(size: int, row: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.zeros((BITS // 64, size), np.uint64)
        at = bit[word]
        row, at = row[at >= 0], at[at >= 0]
        np.bitwise_or.at(out, (at // 64, row), np.uint64(1) << (at % 64).astype(np.uint64))
        return out

    a_bits, b_bits = bits(len(a_id), a_row, w), bits(len(b_id), b_row, v)
    # where in b the other words are
    own = np.flatnonzero(bit[v] < 0)
    own = own[np.argsort(v[own], kind="stable")]
    places = b_row[own].astype(np.int32)
    first = np.concatenate(([0], np.cumsum(np.bincount(v[own], minlength=len(words)))))
    rare = np.flatnonzero((bit[w] < 0) & (in_b[w] > 0))
    a_row, w = a_row[rare], w[rare]
    begin = np.searchsorted(a_row, np.arange(len(a_id) + 1))
    reach = np.concatenate(([0], np.cumsum(in_b[w])))[begin]
    most = min(n.max(), m.max())
    kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32

    def shared(start: int, end: int) -> np.ndarray:
        """The numbers of words that the sets of a from start to end share with each of b."""
        out = np.zeros((end - start, len(b_id)), kind)
        for x, y in zip(a_bits, b_bits, strict=True):
            out += np.bitwise_count(x[start:end, None] & y[None, :])
        word = w[begin[start] : begin[end]]
        size = in_b[word].astype(np.int32)
        before = np.cumsum(size) - size
        at = places[np.repeat((first[word] - before).astype(np.int32), size) + np.arange(size.sum(), dtype=np.int32)]
        at += np.repeat(((a_row[begin[start] : begin[end]] - start) * len(b_id)).astype(np.int32), size)
        np.add.at(out.reshape(-1), at, kind(1))
        return out

    def chunks(stop: int) -> Iterator[tuple[int, int]]:
        start = 0
        while start < stop:
            end = min(stop, start + max(1, CELLS // len(b_id)), int(np.searchsorted(reach, reach[start] + PLACES, "right")) - 1)
            yield start, max(end, start + 1)
            start = max(end, start + 1)

    def reached(s: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The kth highest F1 of each row of s, the numbers of shared words of sets of x and y words; above zero."""
        if s.shape[1] < k:
            return np.full(len(s), 1e-30)
        f1 = 2 * s.astype(np.float32) / (x[:, None] + y[None, :]).astype(np.float32)
        return np.maximum(np.partition(f1, -k, axis=1)[:, -k].astype(np.float64), 1e-30)

    def least(score: np.ndarray) -> np.ndarray:
        return (score / 2 * (1 - 1e-5)).astype(np.float32)  # a little less, for the rounding of 32 bits

    a_size, b_size = n.astype(np.float32), m.astype(np.float32)
    if both:
        some = [shared(*x) for x in chunks(min(TRIED, len(a_id)))]
        some = np.concatenate(some)
        b_least = np.empty(len(b_id), np.float32)
        for c in range(0, len(b_id), TRIED):
            own = slice(c, c + TRIED)
            b_least[own] = least(reached(np.ascontiguousarray(some[:, own].T), m[own], n[: len(some)]))
        b_base, some = b_least * b_size, None
    back: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start, end in chunks(len(a_id)):
        s = shared(start, end)
        a_least = least(reached(s[:, :TRIED], n[start:end], m[:TRIED]))
        number = s.astype(np.float32)

        def above(limit: np.ndarray, s=s, number=number, start=start) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at = np.flatnonzero(number >= limit)
            x, y = np.divmod(at, len(b_id))
            return x + start, y, 2.0 * s.reshape(-1)[at] / (n[x + start] + m[y])

        limit = np.multiply.outer(a_least, b_size)
        limit += (a_least * a_size[start:end])[:, None]
        x, y, f1 = above(limit)
        at = _pick(x, b_id[y], f1, k)
        yield a_id[x[at]], b_id[y[at]], f1[at]
        if both:
            limit = np.multiply.outer(a_size[start:end], b_least)
            limit += b_base
            x, y, f1 = above(limit)
            back.append((y, x, f1))
            if sum(len(z[0]) for z in back) > HELD or end == len(a_id):
                y, x, f1 = (np.concatenate(z) for z in zip(*back, strict=True))
                at = _pick(y, a_id[x], f1, k)
                back = [(y[at], x[at], f1[at])]
    if both:
        y, x, f1 = back[0]
        yield b_id[y], a_id[x], f1


def _with_scores(pairs: DataFrame, q: DataFrame, r: DataFrame) -> DataFrame:
    """(id, r_id, f1) of pairs(id, r_id)."""
    x = pairs.join(q.select("id", "order", "n"), "id").join(r.select(F.col("id").alias("r_id"), F.col("order").alias("_order"), F.col("n").alias("m")), "r_id")
    return x.select("id", "r_id", _f1(F.size(F.array_intersect("order", "_order")), F.col("n"), F.col("m")).alias("f1"))


def _highest(r: DataFrame, k: int) -> list[tuple[tuple, bool]]:
    """The k highest keys of all, and the k highest of rows without words: 2k rows at most, with whether they are such."""
    rows = r.select(F.explode("keys").alias("key"), (F.col("n") == 0).alias("bare"))
    top = rows.orderBy(F.desc("key")).limit(k).unionByName(rows.where("bare").orderBy(F.desc("key")).limit(k)).distinct()
    return [(tuple(x["key"]), x["bare"]) for x in top.collect()]
