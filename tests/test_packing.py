from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from gleaner.operators import corpus


def greedy(parts, most, glue):
    """The definition, one part after another."""
    out = []
    for p in parts:
        if out and len(out[-1]) + len(glue) + len(p) <= most:
            out[-1] += glue + p
        else:
            out.append(p)
    return out


def test_packed_is_the_greedy_rule():
    rng = random.Random(3)
    for _ in range(2000):
        parts = ["é" * rng.choice([0, 1, 2, 5, 9, 30]) for _ in range(rng.randrange(12))]
        most, glue = rng.randrange(1, 25), rng.choice([" ", "\n\n"])
        assert corpus.packed(parts, most, glue) == greedy(parts, most, glue)


def test_long_document(spark):
    parts = [f"Sentence number {i}." for i in range(100_000)]
    start = time.perf_counter()
    made = corpus.packed(parts, 2400, " ")
    assert time.perf_counter() - start < 1
    assert " ".join(made) == " ".join(parts) and max(map(len, made)) <= 2400
    df = spark.createDataFrame([("d", "s", "official_doc", " ".join(parts))], "id string, source_id string, source_type string, content string")
    got = corpus.chunk(df).orderBy("chunk_index").collect()
    assert [r["content"] for r in got] == made and {r["chunk_count"] for r in got} == {len(made)}


def test_edges(spark):
    rows = [(1, None), (2, []), (3, ["a"]), (4, ["a" * 9, "b", "c"])]
    got = spark.createDataFrame(rows, "id int, parts array<string>").select("id", corpus.pack(F.col("parts"), 4, "\n").alias("x"))
    assert {r["id"]: r["x"] for r in got.collect()} == {1: None, 2: [], 3: ["a"], 4: ["a" * 9, "b\nc"]}


def test_paragraphs_and_sentences(spark):
    text = "  One. Two two. Three three three!  \n \n\nShort.\n\n\n" + "z" * 40 + "\n\nEnd"
    got = spark.createDataFrame([(text,), (" \n\n ",), (None,)], "t string").select(corpus.structural_parts(F.col("t"), F.lit(20)).alias("p")).collect()
    assert got[0]["p"] == ["One. Two two.", "Three three three!", "Short.", "z" * 40, "End"]
    assert got[1]["p"] == [] and got[2]["p"] is None


def test_blank_and_null_documents_stay_whole(spark):
    rows = [("a", "s", "official_doc", " \n\n" * 20), ("b", "s", "official_doc", None), ("c", "s", None, "x" * 50)]
    got = corpus.chunk(spark.createDataFrame(rows, "id string, source_id string, source_type string, content string"), {"official_doc": 10}).collect()
    assert sorted((r["id"], r["chunk_count"], r["content"]) for r in got) == [("a", 1, " \n\n" * 20), ("b", 1, None), ("c", 1, "x" * 50)]
