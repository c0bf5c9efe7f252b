"""SimHash fingerprints and their near-duplicate classes, linked by a binary-trie self-join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.components import connected_components
from gleaner.llm.shared import discard, materialize, whole_groups

SEED = 42
#: A group of fingerprints that agree on the exact blocks is split into parts once it is larger than this.
HOT_GROUP = 2048
#: Node pairs of the trie that are expanded at once; more of them wait on a stack.
FRONTIER = 1 << 17
#: Words up to which a root is one leaf, whose words are compared each with each.
LEAF = 1024


def bits_over_half(hashes: np.ndarray) -> int:
    """The 64-bit word whose bit is 1 where over half of the hashes (uint64) have it."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    packed = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(packed.view(np.int64)[0])


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    import xxhash

    words = (text or b"").lower().split()  # bytes: A-Z and the six ASCII space characters only
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-shingle]))
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    return bits_over_half(np.array(hashes, np.uint64))


def fingerprint_column(text: str, shingle: int = 3) -> Column:
    @F.pandas_udf(T.LongType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(x, shingle) for x in batch], dtype="int64")

    return run(F.col(text).cast("binary"))


def _layout(n: int, bits: int) -> tuple[int, int]:
    """(blocks, exact blocks): the fewest tables whose groups hold about 512 of n fingerprints or fewer."""
    for exact in range(1, 5):
        if n / 2 ** (64 * exact // (bits + exact)) <= 512:
            break
    return bits + exact, exact


def block_tables(n: int, bits: int) -> list[list[tuple[int, int]]]:
    """For each table the (offset, width) blocks, highest first, with the blocks that must agree in front.

    Two words that differ in at most `bits` bits agree on some choice of `exact` of the blocks whole.
    """
    blocks, exact = _layout(n, bits)
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    spans = [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(blocks)]
    return [[spans[i] for i in pick] + [s for i, s in enumerate(spans) if i not in pick] for pick in combinations(range(blocks), exact)]


def _arranged(word: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """The bits of word with the given spans set one after another from the top."""
    out, at = np.zeros(len(word), np.uint64), 64
    for offset, width in spans:
        at -= width
        out |= (word >> np.uint64(offset) & np.uint64((1 << width) - 1)) << np.uint64(at)
    return out


def _agreed(word: Column, table: int, spans: list[tuple[int, int]], shift: int) -> Column:
    """The number of a table from the bit `shift` on, with the bits of the given spans of word as the lowest ones."""
    out, at = F.lit((table << shift) - (1 << 64 if table << shift >> 63 else 0)).cast("bigint"), sum(width for _, width in spans)
    for offset, width in spans:
        at -= width
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(word, offset).bitwiseAND(F.lit((1 << width) - 1).cast("bigint")), at))
    return out


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class _Forest:
    """Labels of the words of one partition; joins keep the smaller label."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.of[a], self.of[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.of[self.of]
                if (up == self.of).all():
                    break
                self.of = up


def trie_links(words: np.ndarray, roots: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """Labels that link the words of a root within `bits` differing bits, directly or over others.

    words: uint64, sorted, distinct inside a root; roots: the bounds of each root's run. The words of a
    root share all but the lowest `depth` bits. Pairs of trie nodes are walked down together, bit by
    bit; a pair is dropped as soon as its prefixes differ in more than `bits` bits. A root of LEAF words or fewer is a
    leaf: all of its pairs are compared, those as far apart in order at once for all leaves.
    """
    forest = _Forest(len(words))
    lo, hi = roots[:-1], roots[1:]
    big = hi - lo > LEAF
    size = np.where(big, 0, hi - lo)
    before = np.cumsum(size) - size
    at = np.arange(size.sum()) + np.repeat(lo - before, size)
    left, far = np.repeat(hi, size) - at, 1
    while len(at):
        more = left > far
        at, left = at[more], left[more]
        near = at[popcount(words[at] ^ words[at + far]) <= bits]
        forest.join(near, near + far)
        far += 1
    stack = [(depth - 1, lo[big], hi[big], lo[big], hi[big], np.zeros(big.sum(), np.int8))]
    ones_at: dict[int, np.ndarray] = {}
    while stack:
        bit, alo, ahi, blo, bhi, err = stack.pop()
        if not len(alo):
            continue
        if len(alo) > FRONTIER:
            for i in range(0, len(alo), FRONTIER):
                s = slice(i, i + FRONTIER)
                stack.append((bit, alo[s], ahi[s], blo[s], bhi[s], err[s]))
            continue
        same = alo == blo
        single = (ahi - alo == 1) & (bhi - blo == 1)
        leaf = single & ~same
        if leaf.any():
            a, b = alo[leaf], blo[leaf]
            near = (forest.of[a] != forest.of[b]) & (popcount(words[a] ^ words[b]) <= bits)
            forest.join(a[near], b[near])
        go = ~single
        alo, ahi, blo, bhi, err, same = alo[go], ahi[go], blo[go], bhi[go], err[go], same[go]
        if not len(alo) or bit < 0:
            continue
        if bit not in ones_at:
            ones_at[bit] = np.concatenate(([0], np.cumsum((words >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        ones = ones_at[bit]
        am = ahi - (ones[ahi] - ones[alo])
        bm = bhi - (ones[bhi] - ones[blo])
        kids = (
            (alo, am, blo, bm, err, np.ones_like(same)),
            (am, ahi, bm, bhi, err, np.ones_like(same)),
            (alo, am, bm, bhi, err + 1, np.ones_like(same)),
            (am, ahi, blo, bm, err + 1, ~same),  # of a node with itself the mirrored pair is the same one
        )
        new = []
        for x0, x1, y0, y1, e, ok in kids:
            keep = ok & (x1 > x0) & (y1 > y0) & (e <= bits) & ~((x0 == y0) & (x1 - x0 == 1))
            new.append((x0[keep], x1[keep], y0[keep], y1[keep], e[keep]))
        stack.append((bit - 1, *(np.concatenate(x) for x in zip(*new, strict=True))))
    return forest.of


def hamming_links(words: DataFrame, bits: int = 3, hot: int = HOT_GROUP, n: int | None = None) -> DataFrame:
    """Edges (a, b) that connect the distinct bigint words of column `w` as all pairs within `bits` would.

    Pigeonhole tables deal the words out by the blocks that must agree; each task joins its part of
    the trie with itself and returns a spanning forest, so a dense group gives fewer edges than words.
    A group above `hot` is split into parts, and every two of its parts meet in one task.
    """
    n = words.count() if n is None else n
    tables = block_tables(n, bits)
    _, exact = _layout(n, bits)
    depths = [64 - sum(width for _, width in t[:exact]) for t in tables]
    shift = 64 - (len(tables) - 1).bit_length()
    # z: the table and the blocks that agree; the one number by which rows are dealt and sorted
    rows = words.select("w", F.explode(F.array(*[_agreed(F.col("w"), i, t[:exact], shift) for i, t in enumerate(tables)])).alias("z"))
    large = rows.groupBy("z").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot)
    large = materialize(large.select("z", F.ceil(F.col("c") / F.lit(hot / 2)).cast("int").alias("parts")), "hot-groups")
    by = ["z"]
    if not large.isEmpty():
        rows = rows.join(large, "z", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        part = F.pmod(F.xxhash64("w"), F.col("parts")).cast("int")
        rows = rows.withColumn("p", part).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.withColumn("i", F.least("p", "q")).withColumn("j", F.greatest("p", "q"))
        by = ["z", "i", "j"]

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x, starts in whole_groups(batches, by):
            word, t = x["w"].to_numpy(), np.array([z >> shift for z in x["z"].to_numpy().view(np.uint64)[starts].tolist()])
            bounds = np.append(starts, len(x))
            cuts = [0, *(np.flatnonzero(t[1:] != t[:-1]) + 1).tolist(), len(t)]  # rows come sorted by table
            for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                roots, table = bounds[first : last + 1] - bounds[first], int(t[first])
                w = word[bounds[first] : bounds[last]]
                key = _arranged(w.view(np.uint64), tables[table])
                order = np.lexsort((key, np.repeat(np.arange(last - first), np.diff(roots))))
                w = w[order]
                label = trie_links(key[order], roots, depths[table], bits)
                joined = label != np.arange(len(label))
                if joined.any():
                    yield pd.DataFrame({"a": w[joined], "b": w[label[joined]]})

    dealt = rows.repartition(*by).sortWithinPartitions(*by)
    return dealt.select(*by, "w").mapInPandas(link, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3, also: tuple[str, ...] = ()) -> DataFrame:
    """(id, fingerprint, component_id) of every row of docs; with the columns `also` of docs and the label `class`, if any are asked for.

    Null and blank texts have the fingerprint zero and are linked like any other. Rows that repeat an
    id are each returned. A null id takes no part in the minimum; a component whose ids are all null
    has a null component_id. A text is hashed whole by the task that reads it. Other columns of docs are not
    read. Rows of one class are of one component, also where ids are null or repeat.
    """
    carried = F.struct(*also).alias("also") if also else F.lit(None).cast("int").alias("also")
    fps = materialize(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(text_col, shingle).alias("w"), carried), "fingerprints")
    own = fps.groupBy("w").agg(F.min("doc_id").alias("least"))
    own = materialize(own, "classes")
    labels = connected_components(hamming_links(own.select("w"), bits), "simhash")
    labels = own.join(labels, own["w"] == labels["node"], "left").select("w", "least", F.coalesce("component", "w").alias("c"))
    labels = materialize(labels, "labels")
    discard(own)
    smallest = labels.groupBy("c").agg(F.min("least").alias("component_id"))
    classes = labels.join(smallest, "c").select("w", "component_id", F.col("c").alias("class"))
    more = ("also.*", "class") if also else ()
    return fps.join(classes, "w").select("doc_id", F.lpad(F.lower(F.hex("w")), 16, "0").alias("fingerprint"), "component_id", *more)
