"""Spelling variants: words one edit apart, found by a variable-length gram index.

The dictionary is made of grams of QMIN to QMAX code points: a gram is lengthened while it is frequent. A padded word
is decomposed, at every place, into the longest gram that the dictionary allows, without those that an earlier
one covers. An edit affects a few neighbouring grams; two words one edit apart share all the others, those before
with all that lies before them and those after with all that lies after. So for each place of an edit the lists
of the grams that it spares are merged beforehand into one, a join meets the words of a list, and what
meets is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import discard, materialize

#: Words have LEAST code points or more; with PAD at both ends that makes 2 * QMAX + 1, so no edit touches all grams of a word.
QMIN, QMAX, PAD, LEAST = 3, 5, 2, 7
#: A gram is frequent, and may be lengthened, above one in FREQUENT of all grams of its length. So there are fewer than FREQUENT of each length.
FREQUENT = 20_000
#: The most lists of a word for edits of a letter, and for letters added.
RANGES = 16
FRONT, BACK = "\x02", "\x03"
LETTER = "[A-Za-zÀ-ÿ]"


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = 31, least: int = LEAST, occurrences: int = 2) -> DataFrame:
    """(word, n): the lower-cased runs of letters of all texts, those of one_in by hash without one letter.

    A run loses its letter h % length where one_in divides h, the crc32 of its document's id, a colon and the run; one_in 0
    leaves all as they are. Words of fewer code points than `least` or fewer occurrences go.
    """
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"{LETTER}{{{least},}}"), F.lit(0)))
    rows = docs.select(F.col(id_col).cast("string").alias("id"), run.alias("w")).withColumn("w", _lower(F.col("w")))
    if one_in:
        h = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("w")).cast("binary"))
        at = (F.col("h") % F.length("w")).cast("int")
        cut = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))
        rows = rows.withColumn("h", h).select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("w")).alias("w")).where(F.length("w") >= least)
    return rows.groupBy(F.col("w").alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= occurrences)


def frequent_grams(vocabulary: DataFrame, most: int = FREQUENT) -> frozenset[str]:
    """The grams of QMIN to QMAX - 1 code points that are above one in `most` of all of their length: fewer than `most` of each."""
    padded = F.concat(F.lit(FRONT * PAD), F.col("word"), F.lit(BACK * PAD))
    out: set[str] = set()
    for q in range(QMIN, QMAX):
        grams = vocabulary.select(F.explode(F.transform(F.sequence(F.lit(1), F.length(padded) - q + 1), lambda i, q=q: F.substring(padded, i, F.lit(q)))).alias("g"))
        total = vocabulary.agg(F.sum(F.length("word") + 2 * PAD - q + 1)).first()[0] or 0
        out |= {r["g"] for r in grams.groupBy("g").count().where(F.col("count") * most > total).select("g").collect()}
    return frozenset(out)


def decompose(word: str, frequent: frozenset[str]) -> list[tuple[str, int]]:
    """(gram, place) of the padded word: at each place the longest gram whose beginnings are frequent, unless an earlier gram covers it."""
    s = FRONT * PAD + word + BACK * PAD
    out, covered = [], 0
    for i in range(len(s) - QMIN + 1):
        end = i + QMIN
        while end < len(s) and end - i < QMAX and s[i:end] in frequent:
            end += 1
        if end > covered:
            out.append((s[i:end], i))
            covered = end
    return out


def spared(word: str, frequent: frozenset[str]) -> tuple[set[str], set[str]]:
    """What is left of the padded word by each edit of a letter, and by each letter added: the grams before and after those that it affects.

    Whether a gram is there depends on the QMAX letters before its end alone: an earlier gram that covers it lies in
    them too. So an edit affects the grams whose last QMAX letters have its place in them, neighbours
    all. What is left is given as the letters up to the last gram before them and those from the first one after them. The
    places of a word above RANGES letters are taken a few together, so that its lists aren't more than RANGES.
    """
    s = FRONT * PAD + word + BACK * PAD
    grams = decompose(word, frequent)

    def rest(gap: bool) -> set[str]:
        out, before, after = set(), 0, 0
        width = -(-(len(word) + gap) // RANGES)
        for p in range(PAD, len(s) - PAD + gap, width):
            last = min(p + width, len(s) - PAD + gap) - 1
            while before < len(grams) and grams[before][1] + len(grams[before][0]) <= p:
                before += 1
            while after < len(grams) and grams[after][1] + len(grams[after][0]) - QMAX < last + (not gap):
                after += 1
            out.add((before, after))
        ends = [0, *(i + len(g) for g, i in grams)]
        starts = [*(i for _, i in grams), len(s)]
        return {f"{s[: ends[x]]}\x01{s[starts[y] :]}" for x, y in out}

    return rest(False), rest(True)


def near_pairs(vocabulary: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(a, m, b, n): the pairs of words of vocabulary (word, n), and their occurrences, that differ by one letter added, left out or replaced.

    Each pair once; a is the shorter, or the first of two as long. Two such words are left alike by the edit that parts
    them: a word meets those as long, and as one with a letter more those longer by one. The lists are joined, AQE
    splits long ones, and a pair is formed only after the comparison. Spark takes a word's lists for one row when it
    sizes them, so without the hint it would send millions of them to the driver for a broadcast.
    """
    longer = frequent_grams(vocabulary, frequent)
    shared = vocabulary.sparkSession.sparkContext.broadcast(longer)  # fewer than FREQUENT grams of each length

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = [(w, n, more, k) for w, n in zip(x["word"], x["n"], strict=True) for more, keys in enumerate(spared(w, shared.value)) for k in keys]
            yield pd.DataFrame(rows, columns=["word", "n", "more", "rest"])

    listed = vocabulary.mapInPandas(split, "word string, n long, more int, rest string")
    listed = listed.select("word", "n", "more", F.xxhash64("rest", F.length("word") + F.col("more")).alias("list"))
    one = listed.select("list", F.col("word").alias("a"), F.col("n").alias("m"), "more")
    other = listed.where("more = 0").select("list", F.col("word").alias("b"), "n")
    near = ((F.col("more") == 1) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    return one.join(other.hint("merge"), "list").where(near).select("a", "m", "b", "n").distinct()


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = 31, times: int = 10, frequent: int = FREQUENT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts that words() finds.

    form is the nearest word of most occurrences, the first in code-point order of several, if it has `times` those of
    the word; root is where the forms lead; n_near counts the words one edit apart.

    Null and empty texts have no words; an empty table gives an empty result. Rows are taken as they come, repeated
    ones too; a null id counts as an empty one. Long texts and words are taken whole. Columns other than the two are not
    read, whatever their names.
    """
    made: list[DataFrame] = []
    known = materialize(words(docs, id_col, text_col, one_in), "words", made)
    pairs = materialize(near_pairs(known, frequent), "near-words", made)
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("n")).alias("k"), F.col("b").alias("w")).alias("best")).unionByName(
        pairs.select(F.col("b").alias("word"), F.struct((-F.col("m")).alias("k"), F.col("a").alias("w")).alias("best")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("best").alias("best"))
    form = -F.col("best.k") >= times * F.col("n")
    out = known.join(near.hint("merge"), "word", "left").select(
        "word", F.when(form, F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, -F.col("best.k")).alias("form_n"))
    out = materialize(out, "forms", made)
    steps = out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    largest, depth = out.agg(F.max("n")).first()[0] or 0, 1
    while times**depth <= largest:  # forms have `times` the occurrences each, so a way has fewer steps than that
        depth += 1
    for _ in range((depth - 1).bit_length()):  # each round doubles the way
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = materialize(steps.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots", made)
    steps = steps.withColumnRenamed("word", "w")
    found = out.join(steps.hint("merge"), F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    found = materialize(found, "variants")
    discard(*made)
    return found
