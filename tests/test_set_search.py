"""Set-similarity search against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import set_search
from gleaner.operators.set_search import nearest_sets

R = random.Random(5)
KIND = "video_id long, step_number int, tokens array<string>"


def plain(queries, references, k):
    out = set()
    for v, s, words in queries:
        a, found = set(words or ()), []
        for w, t, other in references:
            b = set(other or ())
            if (v, s) != (w, t):
                found.append((2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0, w, t))
        for n, (f, w, t) in enumerate(sorted(found, reverse=True)[:k], 1):
            out.add((v, s, w, t, round(f, 9), n))
    return out


def got(spark, queries, references, k):
    x = nearest_sets(spark.createDataFrame(queries, KIND), spark.createDataFrame(references, KIND), k)
    return {tuple(r) for r in x.withColumn("f1", F.round("f1", 9)).collect()}


@pytest.mark.parametrize("k", [1, 3])
def test_all_pairs(spark, k):
    words = [f"w{i}" for i in range(40)]
    rows = [(i, i % 3, ["everywhere", *R.sample(words, min(int(R.expovariate(0.3)), 20))]) for i in range(150)]
    rows += [(200 + i, 0, list(rows[7][2])) for i in range(60)]  # a third of all are copies
    rows += [(300, 0, None), (301, 0, []), (302, 0, ["everywhere"]), (303, 0, ["alone"]), (304, 0, ["w1", "w1", "w2"]), (304, 1, ["w2", "w1"]), (-5, 2, ["w3", "everywhere"])]
    assert got(spark, rows, rows, k) == plain(rows, rows, k)


def test_others(spark):
    """Questions that are no references, with words that none holds; fewer references than k; none at all."""
    rows = [(1, 1, ["a", "b"]), (2, 1, ["a", "c"])]
    asked = [(9, 1, ["a", "never", "b"]), (9, 2, ["never"]), (9, 3, [])]
    assert got(spark, asked, rows, 5) == plain(asked, rows, 5)
    assert got(spark, asked, [], 3) == set() == got(spark, [], rows, 3)


def test_one_word_everywhere(spark):
    """A word in every row joins no pair of rows: what is made stays in proportion to the rows."""
    rows = [(i, 0, ["everywhere", f"own{i}", f"pair{i // 2}"]) for i in range(6000)]
    df = spark.createDataFrame(rows, KIND).repartition(4)
    found = nearest_sets(df, df, 3)
    assert found.count() == 18_000
    assert found.where("rank = 1 AND r_video_id = video_id + 1 - 2 * (video_id % 2)").count() == 6000


@pytest.mark.parametrize("part", [1 << 15, 60])
@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("counted", [0, 1 << 60])
def test_joined_and_counted(spark, monkeypatch, counted, same, part):
    """Both ways to the pairs, in one part and in several; with ties, copies, words above the bits and sets above a byte."""
    monkeypatch.setattr(set_search, "COUNTED", counted)
    monkeypatch.setattr(set_search, "PART", part)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, i % 3, R.sample(words[: 10 + 290 * (i % 2)], min(1 + int(R.expovariate(0.1)), 10))) for i in range(160)]
    rows += [(200 + i, 0, list(rows[5][2])) for i in range(9)] + [(300, 0, []), (301, 0, None), (302, 1, words), (303, 1, words[:-1]), (304, 1, ["alone"])]
    asked = rows if same else [(500, 1, ["w1", "never"]), (501, 1, words[:40]), (502, 1, []), *rows[:70]]
    held = spark.createDataFrame(rows, KIND).repartition(3)
    x = nearest_sets(held if same else spark.createDataFrame(asked, KIND), held, 3).withColumn("f1", F.round("f1", 9))
    assert {tuple(r) for r in x.collect()} == plain(asked, rows, 3)


def test_prose(spark):
    """Most pairs of these sets share rare words too; by the join they make 60 million rows."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    odds = [1 / (i + 20) for i in range(4000)]
    rows = [(i, 0, rng.choices(words, odds, k=80)) for i in range(5000)]
    df = spark.createDataFrame(rows, KIND)
    found = {}
    for v, w, f, n in nearest_sets(df, df, 3).select("video_id", "r_video_id", "f1", "rank").collect():
        found.setdefault(v, []).append((n, w, f))
    sets = [set(x[2]) for x in rows]
    for v in range(0, 5000, 250):
        best = sorted(((2 * len(sets[v] & b) / (len(sets[v]) + len(b)), w) for w, b in enumerate(sets) if w != v), reverse=True)[:3]
        assert [(w, round(f, 9)) for _, w, f in sorted(found[v])] == [(w, round(f, 9)) for f, w in best]
