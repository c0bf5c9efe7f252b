"""A Merkle manifest of a dataset: one tree for each value of a column, a tree over their roots, and a proof of every row.

A node is the lower-case hexadecimal SHA-256 of its up to eight children's digests one after another. Rows
are placed in their trees by a range sort and prefix sums; each leaf partition holds neighbouring leaves
of one tree. It works out which nodes its proofs need and can't be derived from its own leaves (the
octopus multiproof), gets those once by one join, derives the nodes above and expands every proof.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.shared import discard, materialize

FAN = 8
#: A leaf partition holds FAN ** HEIGHT leaves at most.
HEIGHT = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def row_digest(values: Iterable[Column]) -> Column:
    """SHA-256 of the values one after another: `-` for null, else the bytes of the text, a colon and the text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def missing(positions: np.ndarray, size: int) -> list[tuple[int, int]]:
    """The fewest nodes (level, place) that, with the leaves at `positions`, give the proofs of all of these in a tree of `size` leaves."""
    out, level, known = [], 0, np.unique(positions)
    while size > 1:
        runs = np.unique(known // FAN)
        mates = (runs[:, None] * FAN + np.arange(FAN)).ravel()
        out += [(level, int(i)) for i in np.setdiff1d(mates[mates < size], known)]
        known, size, level = runs, -(-size // FAN), level + 1
    return out


class Part:
    """Proofs of some leaves of a tree, from these leaves and the nodes that missing() names."""

    def __init__(self, leaves: dict[int, str], size: int, fetched: Iterable[tuple[int, int, str]] = ()) -> None:
        got: dict[int, dict[int, str]] = {}
        for level, i, h in fetched:
            got.setdefault(level, {})[i] = h
        self.sizes, self.levels, own = [], [], dict(leaves)
        while size > 1:
            level = own | got.get(len(self.levels), {})
            self.sizes.append(size)
            self.levels.append(level)
            own = {run: sha(*(level[i] for i in range(run * FAN, min(size, run * FAN + FAN)))) for run in {i // FAN for i in own}}
            size = -(-size // FAN)
        (self.root,) = own.values() if not self.levels or len(own) == 1 else (None,)
        self._sides: dict[tuple[int, int], tuple[str, str]] = {}

    def path(self, i: int) -> list[tuple[str, str]]:
        """The siblings before and after the nodes over leaf i, level by level."""
        out = []
        for level, (nodes, size) in enumerate(zip(self.levels, self.sizes, strict=True)):
            if (level, i) not in self._sides:
                a, b = i - i % FAN, min(size, i - i % FAN + FAN)
                self._sides[level, i] = "".join(nodes[x] for x in range(a, i)), "".join(nodes[x] for x in range(i + 1, b))
            out.append(self._sides[level, i])
            i //= FAN
        return out


def fold(leaf: str, path: Iterable[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for before, after in path:
        leaf = sha(before, leaf, after)
    return leaf


def numbered(rows: DataFrame, order: list[str], made: list[DataFrame]) -> DataFrame:
    """rows (t, ...) with `place`, from 0 by `order` in the tree t, and `size`, the rows of the tree.

    The sorted rows are written with a running number; a place is that number less what the row's partition
    and the partitions before it hold of other trees.
    """
    rows = rows.repartitionByRange("t", *order).sortWithinPartitions("t", *order).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "merkle-rows", made)
    part = F.shiftright("row", 33).alias("part")
    held = rows.groupBy("t", part).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    tree = Window.partitionBy("t")
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = materialize(held.select("t", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("size")), "merkle-counts", made)
    return rows.withColumn("part", part).join(held, ["t", "part"]).withColumn("place", F.col("row") + F.col("shift")).drop("row", "shift", "part")


def grow(leaves: DataFrame, made: list[DataFrame], height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """(nodes, roots) of the trees of leaves (t, place, size, h): nodes (t, level, i, h) from level `height` up, roots (t, h, size).

    Each block of FAN ** height leaves is folded in one task; the levels above are one small grouping each.
    """
    width = FAN**height

    def block(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("place")
        t, i, size, level = key[0], int(key[1]), int(x["size"].iloc[0]), 0
        h, n = x["h"].tolist(), size
        while n > 1 and level < height:
            h = [sha(*h[a : a + FAN]) for a in range(0, len(h), FAN)]
            n, level = -(-n // FAN), level + 1
        return pd.DataFrame({"t": [t], "i": [i], "h": h, "size": [size]})

    grouped = leaves.select("t", "place", "h", "size").groupBy("t", F.floor(F.col("place") / width).alias("b"))
    last = materialize(grouped.applyInPandas(block, "t string, i long, h string, size long"), "merkle-nodes", made)
    found, level = [last.withColumn("level", F.lit(height))], height
    largest = last.agg(F.max("size")).first()[0] or 0
    roots = last.where(F.col("size") <= width)
    while FAN**level < largest:
        kids = F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"])
        up = last.where(F.col("size") > FAN**level).groupBy("t", "size", F.floor(F.col("i") / FAN).alias("i")).agg(F.sha2(F.array_join(kids, ""), 256).alias("h"))
        last = materialize(up.select("t", "i", "h", "size"), "merkle-nodes", made)
        level += 1
        found.append(last.withColumn("level", F.lit(level)))
        roots = roots.unionByName(last.where(F.col("size") <= FAN**level))
    nodes = found[0]
    for x in found[1:]:
        nodes = nodes.unionByName(x)
    return nodes.select("t", "level", "i", "h"), roots.select("t", "h", "size")


def parts(leaves: DataFrame, nodes: DataFrame, made: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """(t, b, size, fetched): the leaf partitions, each with the nodes (level, i, h) that it is missing, got once.

    Many partitions ask for the nodes near a root, so those are skewed keys of a join, which AQE splits.
    """

    def ask(batches):
        for x in batches:
            out = [(r.t, r.b, *c) for r in x.itertuples() for c in missing(np.arange(r.lo, r.hi + 1), r.size)]
            yield pd.DataFrame(out, columns=["t", "b", "level", "i"])

    held = leaves.groupBy("t", F.floor(F.col("place") / FAN**height).alias("b")).agg(F.min("place").alias("lo"), F.max("place").alias("hi"), F.first("size").alias("size"))
    held = materialize(held, "merkle-parts", made)
    asked = held.mapInPandas(ask, "t string, b long, level int, i long")
    got = asked.join(nodes, ["t", "level", "i"]).groupBy("t", "b").agg(F.collect_list(F.struct("level", "i", "h")).alias("fetched"))
    return held.join(got, ["t", "b"], "left").select("t", "b", "size", "fetched")


def _fetched(x: pd.DataFrame) -> list[tuple[int, int, str]]:
    found = x["fetched"].iloc[0]
    return [] if found is None else [(f["level"], f["i"], f["h"]) for f in found]


def paths(leaves: DataFrame, nodes: DataFrame, made: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """(key, h, before, after) of every leaf (t, place, size, key, h): its siblings before and after it, an entry a level."""

    def expand(leaf: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
        part = Part(dict(zip(leaf["place"], leaf["h"], strict=True)), int(info["size"].iloc[0]), _fetched(info))
        found = [part.path(i) for i in leaf["place"]]
        return pd.DataFrame({"key": leaf["key"], "h": leaf["h"], "before": [[a for a, _ in p] for p in found], "after": [[b for _, b in p] for p in found]})

    by = leaves.withColumn("b", F.floor(F.col("place") / FAN**height)).select("t", "b", "place", "key", "h")
    return by.groupBy("t", "b").cogroup(parts(leaves, nodes, made, height).groupBy("t", "b")).applyInPandas(expand, "key string, h string, before array<string>, after array<string>")


def manifest(docs: DataFrame, columns: Iterable[str] = COLUMNS, id_col: str = "doc_id", tree_col: str = "lang", altered: dict[str, Column] | None = None, where: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of docs.

    A row is a leaf of the tree of its tree_col; leaves are ordered by id (null first), then digest. Where the
    condition `where` holds, the row is checked with the columns `altered` in place of its own: folded_root
    is the root that this leaf and the row's own siblings give, and verified says whether it is the root. Without
    both, every row is checked as it is.

    Nulls of any column are digested as `-`; a null tree_col is a tree of its own, the first. Empty and very
    long texts are digested whole. Rows that repeat all of `columns` are leaves each. An empty table gives an empty
    result. Columns other than those named are not read, whatever their names.
    """
    columns, altered, made = list(columns), altered or {}, []
    changed = row_digest([altered.get(c, F.col(c)) for c in columns])
    lead = F.when(F.col(tree_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(tree_col).cast("string")))  # null first
    rows = docs.select(lead.alias("t"), F.col(id_col).alias("doc_id"), row_digest([F.col(c) for c in columns]).alias("h"), (F.when(where, changed) if where is not None else F.lit(None).cast("string")).alias("changed"))
    leaves = numbered(rows, ["doc_id", "h"], made)
    nodes, roots = grow(leaves, made, height)
    tops = numbered(roots.select(F.lit("").alias("t"), F.col("t").alias("key"), "h"), ["key"], made)
    top_nodes, top_root = grow(tops, made, height)
    root = top_root.select("t", F.col("h").alias("root"))  # one row, if any
    tops = materialize(paths(tops, top_nodes, made, height).withColumn("t", F.lit("")).join(root, "t").select(F.col("key").alias("t"), F.col("h").alias("subroot"), "root", "before", "after"), "merkle-tops", made)
    info = parts(leaves, nodes, made, height).join(tops, "t")

    def prove(leaf: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
        one = info.iloc[0]
        part = Part(dict(zip(leaf["place"], leaf["h"], strict=True)), int(one["size"]), _fetched(info))
        above = list(zip(one["before"], one["after"], strict=True))
        proofs, folded = [], []
        for i, h, other in zip(leaf["place"].tolist(), leaf["h"], leaf["changed"], strict=True):
            path = part.path(i) + above
            proofs.append(sha(*(x for pair in path for x in pair)))
            folded.append(fold(h if other is None else other, path))
        return pd.DataFrame({"doc_id": leaf["doc_id"], "leaf": leaf["h"], "subroot": one["subroot"], "root": one["root"], "proof_sha256": proofs, "folded_root": folded, "verified": [x == one["root"] for x in folded]})

    by = leaves.withColumn("b", F.floor(F.col("place") / FAN**height)).select("t", "b", "place", "h", "changed", F.col("doc_id").cast("string").alias("doc_id"))
    found = by.groupBy("t", "b").cogroup(info.groupBy("t", "b")).applyInPandas(prove, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    out = materialize(found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType)), "merkle-proofs")
    discard(*made)
    return out


def lower_cased(text: str = "text") -> Column:
    """A text with A-Z lower-cased, and nothing else."""
    return F.translate(F.col(text), _UPPER, _LOWER)


def every_third(id_col: str = "doc_id") -> Column:
    """Whether 3 divides the unsigned crc32 of the id in decimal."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0
