"""Benchmark decontamination by winnowed fingerprints; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import materialize

#: Words of a window, and of the hashed grams of which the smallest in every window is kept.
WINDOW, GRAM = 10, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEYS = "array<struct<len:int,s:int,key:string>>"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of 0-9, a-z and non-ASCII characters after A-Z are lower-cased; none for null."""
    # lower() is the faster of the two and the same on ASCII text
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(F.coalesce(low, F.lit("")), NOT_WORD), lambda w: w != "")


def _shifted(x: Column, by: int) -> Column:
    """x without its first `by` elements."""
    return F.slice(x, by + 1, F.greatest(F.size(x) - by, F.lit(0)))


def _paired(x: Column, by: int, f) -> Column:
    """f(x[i], x[i + by]) for every i that has both."""
    return F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - by, F.lit(0))), _shifted(x, by), f)


def _steps(df: DataFrame, column: str, length: int, f) -> DataFrame:
    """Replace column by f over every `length` consecutive elements, by doubling."""
    reach = 1
    while reach < length:
        by = min(reach, length - reach)
        df = df.withColumn(column, _paired(F.col(column), by, f))
        reach += by
    return df


def grams(df: DataFrame, size: int, to: str) -> DataFrame:
    """Add the array `to` of hashes of every `size` consecutive elements of the array w."""
    df = df.withColumn(to, F.transform("w", lambda x: F.xxhash64(x)))
    return _steps(df, to, size, lambda a, b: F.xxhash64(a, b))


def winnowed(df: DataFrame, window: int, gram: int) -> DataFrame:
    """Add f: the distinct smallest gram hashes of all windows of the array w.

    Texts that share `window` consecutive words share the smallest hash in them, so they share an
    element of f.
    """
    df = _steps(grams(df, gram, "f"), "f", window - gram + 1, lambda a, b: F.least(a, b))
    return df.withColumn("f", F.array_distinct("f"))


def _windows(df: DataFrame, length: int) -> DataFrame:
    """Add x: every `length` consecutive words as one string, with its first position."""
    return df.withColumn(
        "x",
        F.when(
            F.size("w") >= length,
            F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.struct((i - 1).alias("s"), F.array_join(F.slice("w", i, length), " ").alias("key"))),
        ).otherwise(F.array()),
    )


def _candidates(df: DataFrame, n: int, gram: int) -> tuple[DataFrame, Column]:
    """df with work columns, and the windows of n words of w that hold a gram named in m."""
    own, hashes, f = f"o{n}", f"g{n}", f"f{n}"
    df = df.withColumn(own, F.transform(F.filter("m", lambda m: m["len"] == n), lambda m: m["f"]))
    df = df.withColumn(f, F.when(F.size(own) > 0, F.col("w")))
    df = df.withColumn(f, F.transform(f, lambda x: F.xxhash64(x)))
    df = _steps(df, f, gram, lambda a, b: F.xxhash64(a, b)).withColumnRenamed(f, hashes)
    at = F.filter(F.transform(hashes, lambda g, i: F.when(F.array_contains(F.col(own), g), i)), lambda i: i.isNotNull())
    first, last = lambda i: F.greatest(i - n + gram, F.lit(0)), lambda i: F.least(i, F.size("w") - n)
    starts = F.array_distinct(F.flatten(F.transform(at, lambda i: F.when(first(i) <= last(i), F.sequence(first(i), last(i))).otherwise(F.array().cast("array<int>")))))
    keys = F.transform(starts, lambda s: F.struct(F.lit(n).alias("len"), s.cast("int").alias("s"), F.array_join(F.slice("w", s + 1, n), " ").alias("key")))
    return df, F.coalesce(keys, F.array().cast(KEYS))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, with_hash: bool = False) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of docs; with_hash adds text_hash, the xxhash64 of the text.

    Windows are `window` consecutive words of an item; an item of fewer words, but not none, is one
    window. A document word inside any occurrence of a window is hit. Null and empty texts have no
    words and are never hit; an empty benchmark hits nothing. Rows that repeat are each returned.
    A window of an item with a null id counts for n_hit but adds no item. Other columns are not read. The
    words of a text are one array of its task, however long it is.

    Documents and items are first joined on winnowed fingerprints, which every shared window has in
    common; documents that share one are extended to their exact windows around it and joined with
    the items' windows as strings. Shorter items are found by all grams of their own length.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    own_hash = [F.col("h").alias("text_hash")] if with_hash else []
    items = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("len", F.least(F.size("w"), F.lit(window)))
    items = materialize(items, "items")
    lengths = sorted(r["len"] for r in items.select("len").distinct().collect())  # `window` values at most
    size_of = {n: (min(gram, n), n) for n in lengths}

    # the items' windows, each with the class of items that have it
    keys = None
    for n in lengths:
        part = _windows(items.where(F.col("len") == n), n).select("item_id", F.lit(n).alias("len"), F.explode("x.key").alias("key"))
        keys = part if keys is None else keys.unionByName(part)
    if keys is None:
        return docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"), *own_hash)
    keys = keys.distinct().groupBy("len", "key").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    keys = materialize(keys.withColumn("class", F.sha2(F.to_json("ids"), 256)), "windows")
    classes = keys.groupBy("class").agg(F.first("ids").alias("ids"))

    # documents that share a fingerprint with an item, with those they share
    matched = None
    for n in lengths:
        k, reach = size_of[n]
        # explode_outer: explode's filter on the size of f would be pushed down and multiply its expressions
        own = winnowed(items.where(F.col("len") == n), reach, k).select(F.explode_outer("f").alias("f")).distinct()
        found = winnowed(docs.select("doc_id", "h", words(F.col("text")).alias("w")), reach, k).select("doc_id", "h", F.explode_outer("f").alias("f"))
        found = found.join(own, "f", "left_semi").select("doc_id", "h", F.lit(n).alias("len"), "f")
        matched = found if matched is None else matched.unionByName(found)
    matched = matched.groupBy("doc_id", "h").agg(F.collect_set(F.struct("len", "f")).alias("m"))
    matched = materialize(matched, "matched")

    same = docs["doc_id"].eqNullSafe(matched["doc_id"]) & docs["h"].eqNullSafe(matched["h"])
    rows = docs.join(matched, same, "left").select(docs["doc_id"], docs["h"], words(docs["text"]).alias("w"), "m")
    x, at = F.array().cast(KEYS), rows
    for n in lengths:
        at, found = _candidates(at, n, size_of[n][0])
        x = F.concat(x, found)
    at = at.select("doc_id", "h", F.size("w").cast("long").alias("n_words"), x.alias("x"))
    at = materialize(at, "extended")  # the candidate windows; none for most documents

    hits = at.where(F.size("x") > 0).dropDuplicates(["doc_id", "h"]).select("doc_id", "h", F.explode("x").alias("x")).select("doc_id", "h", "x.len", "x.s", "x.key")
    hits = hits.join(keys.select("len", "key", "class"), ["len", "key"])
    per_doc = hits.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct(F.col("s"), (F.col("s") + F.col("len")).alias("e")))).alias("spans"), F.collect_set("class").alias("c"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (a["n"] + F.greatest(x["e"] - F.greatest(a["end"], x["s"]), F.lit(0))).alias("n")),
        lambda a: a["n"],
    )
    per_doc = materialize(per_doc.select("doc_id", "h", covered.alias("n_hit"), "c"), "hits")
    named = per_doc.select("doc_id", "h", F.explode("c").alias("class")).join(classes, "class")
    named = named.groupBy("doc_id", "h").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    named = named.select("doc_id", "h", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.transform("ids", lambda i: i.cast("string"))), ","), 256).alias("items_sha256"))

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.withColumnsRenamed({"doc_id": "b_id", "h": "b_h"})
        return a.join(b, F.col("doc_id").eqNullSafe(F.col("b_id")) & F.col("h").eqNullSafe(F.col("b_h")), "left").drop("b_id", "b_h")

    out = joined(joined(at.drop("x"), per_doc.drop("c")), named)
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"), *own_hash)
