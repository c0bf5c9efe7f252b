"""Order min-hash: fingerprints of documents that tell apart what a few edits change and what they don't.

A text's k-mers are numbered by occurrence, so a repeated k-mer is as many elements. Each of SKETCHES hash functions
takes the TAKEN least elements, puts them in text order and hashes that tuple. Two texts agree in a
function where they share those elements in the same order, so the share of functions that agree
follows the edit distance, not the set of k-mers alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.hashing import mixed

#: Code points of a k-mer (a power of two), k-mers of a tuple, hash functions.
K, TAKEN, SKETCHES = 8, 2, 32
#: Characters of a partition of neighbouring documents, and the most partitions.
PART_CHARS, MOST_PARTS = 8_000_000, 20_000
_MULTIPLIERS = (mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64), 5) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Elements taken on at once, the elements a function should have below its first threshold, bits of the filter of repeats.
_BLOCK, _EXPECTED, _BITS = 2048, 12, 14
_products, _low = np.empty(SKETCHES * _BLOCK, np.uint32), np.empty(SKETCHES * _BLOCK, bool)


def kmers(text: str) -> np.ndarray:
    """The 64-bit hash of each run of K code points; of a shorter text that of the whole, of an empty one none."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    if 0 < len(code) < K:
        code = np.concatenate((code, np.zeros(K - len(code), np.uint64)))
    width, base = 1, _BASE
    while width < K and len(code):  # each round joins two neighbours of half the width
        code = code[:-width] * base + code[width:]
        width, base = 2 * width, np.uint64(int(base) ** 2 & (1 << 64) - 1)
    return mixed(code, 9)


def numbered(h: np.ndarray) -> np.ndarray:
    """32-bit hashes of the elements: each k-mer with the number of its like before it."""
    s = np.sort(h)
    again = s[1:][s[1:] == s[:-1]]
    count = None
    if len(again):
        table = np.zeros(1 << _BITS, bool)
        low = np.uint64((1 << _BITS) - 1)
        table[again & low] = True
        at = np.flatnonzero(table[h & low])  # all that repeat, and few others
        order = at[np.argsort(h[at], kind="stable")]
        new = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
        nth = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
        count = np.zeros(len(h), np.uint64)
        count[order] = nth
    return (mixed(h if count is None else h + count * _BASE, 3) >> np.uint64(32)).astype(np.uint32)


def _least(elements: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """(function, TAKEN) places of each function's least elements, in text order."""
    n, size = len(elements), len(multipliers)
    bound = min(1.0, _EXPECTED / n)
    while True:
        most = np.uint32(min(int(bound * 2**32), 2**32 - 1))
        found = []
        for a in range(0, n, _BLOCK):
            width = min(_BLOCK, n - a)
            x, low = _products[: size * width], _low[: size * width]
            np.multiply(multipliers[:, None], elements[None, a : a + width], out=x.reshape(size, width))
            at = np.flatnonzero(np.less_equal(x, most, out=low))
            j, i = np.divmod(at, width)
            found.append((j, i + a, x[at]))
        j, i, v = (np.concatenate(y) for y in zip(*found, strict=True))
        if bound == 1.0 or np.bincount(j, minlength=size).min() >= TAKEN:
            break
        bound = min(1.0, bound * 16)
    order = np.lexsort((i, v, j))
    first = np.searchsorted(j[order], np.arange(size))
    return np.sort(i[order][first[:, None] + np.arange(TAKEN)], axis=1)


def fingerprint(text: str | None) -> np.ndarray:
    """SKETCHES unsigned 32-bit numbers; a null text counts as empty."""
    h = kmers(text or "")
    if len(h) < TAKEN:
        tuples = np.zeros((SKETCHES, TAKEN), np.uint64)
        tuples[:, : len(h)] = h
    else:
        tuples = h[_least(numbered(h), _MULTIPLIERS)]
    out = np.arange(SKETCHES, dtype=np.uint64)
    for c in range(TAKEN):
        out = mixed(out * _BASE + tuples[:, c], 11 + c)
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def text_of(fp: np.ndarray) -> str:
    """8 hexadecimal digits for each function."""
    return fp.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of each row of docs, made by the task that reads the text. Null counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            x["text"] = [text_of(fingerprint(t)) for t in x["text"]]
            yield x

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"doc_id {kind}, text string").select("doc_id", F.col("text").alias("fingerprint"))


def _chained(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) sorted by id in partitions of about as many rows, each with the row that follows its last one.

    The row after the last of all is the first. Such rows are marked `guard` and come last in their `part`. Cut points are
    approximate quantiles of the ids; a part's first row is found by a grouping and known to all tasks: one row a
    part, MOST_PARTS at most.
    """
    spark = docs.sparkSession
    chars, rows = docs.agg(F.sum(F.length("text")), F.count(F.lit(1))).first()
    n = max(1, min(MOST_PARTS, -(-((chars or 0) + rows) // PART_CHARS)))
    cuts = docs.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.05 / n) if n > 1 else []
    cuts = np.array(sorted(int(c) for c in cuts), np.int64)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        low = np.iinfo(np.int64).min
        return pd.Series(np.searchsorted(cuts, ids.astype("Int64").fillna(low).to_numpy(np.int64), "right"))

    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), (part_of("doc_id") if len(cuts) else F.lit(0)).alias("part"))
    firsts = docs.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "hash")).alias("first")).orderBy("part").collect()
    before = [(r["part"], r["first"]["doc_id"], r["first"]["hash"], firsts[i - 1]["part"]) for i, r in enumerate(firsts)]
    known = F.broadcast(spark.createDataFrame(before, "part int, first_id long, first_hash long, previous int"))
    one, other = (F.struct(F.col(c).alias("part"), F.lit(g).alias("guard")) for c, g in (("part", False), ("previous", True)))
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("hash") == F.col("first_hash"))
    found = docs.join(known, "part").select("doc_id", "text", "hash", F.explode(F.when(is_first, F.array(one, other)).otherwise(F.array(one))).alias("x"))
    found = found.select("x.part", "x.guard", "doc_id", "text", "hash")
    return found.repartitionById(n, F.col("part")).sortWithinPartitions("part", "guard", "doc_id", "hash")


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as many code points of the beginning of the following one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row of docs.

    The edited text is a text whose last quarter is replaced by the beginning of the next row's, by ascending id; the first
    row follows the last. near_edited and near_next are the shares of hash functions in which a text's fingerprint agrees with
    that of its edited text and of the next row's.

    Null texts count as empty; empty texts agree with each other. Null ids come first; rows that repeat an id follow
    each other by a hash of their texts. A single row is followed by itself; an empty table gives an empty result. Texts
    are taken whole, and two are held at a time besides a batch. Columns other than the two are not read, whatever their
    names. Ids are integers.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple | None = None
        for x in batches:
            out = []
            for part, guard, i, text in zip(x["part"], x["guard"], x["doc_id"].astype(object), x["text"], strict=True):
                if guard and last is None:
                    continue  # a repeated row after the part's end
                text = text or ""
                own = fingerprint(text)
                if last is not None:
                    _, j, t, fp = last
                    new = edited(t, text)
                    other = fingerprint(new)
                    out.append((j, len(t), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), text_of(fp), text_of(other), likeness(fp, other), likeness(fp, own)))
                last = None if guard else (part, None if pd.isna(i) else int(i), text, own)
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _chained(rows).drop("hash").mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
