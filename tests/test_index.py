"""The bucketed index and the impact-ordered one against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import index, search, sparse
from gleaner.sources.snapshot import Index

R = random.Random(3)


def test_index_sync(spark):
    stored, desired = (spark.createDataFrame([(i, v) for i, v in rows], "id string, v string") for rows in ([("a", "old"), ("b", "old"), ("d", "same")], [("b", "new"), ("c", "new"), ("c", "new"), ("d", "same")]))
    assert sorted(map(tuple, index.sync(stored, desired).collect())) == [("b", "new"), ("c", "new"), ("d", "same")]
    assert sorted(map(tuple, index.sync(stored, desired, verified=F.col("id") != "c").collect())) == [("b", "new"), ("d", "same")]


def test_index_loads(spark, tmp_path):
    """Insert, update, delete and keep; only buckets with changes are written, none by a load that repeats."""
    at = Index(spark, f"file://{tmp_path}/index", buckets=16)
    assert at.read() is None
    kind = "id string, text string, status string"
    good = F.col("status") == "verified"
    first = [(f"k{i}", f"text {i}", "verified" if i % 4 else "draft") for i in range(200)] + [(None, "no key", "verified")]
    load = at.load(spark.createDataFrame(first, kind), good)
    assert (load.insert, load.update, load.delete, load.keep) == (150, 0, 0, 0)
    again = at.load(spark.createDataFrame(first[::-1] + first, kind), good)  # repeated rows are one
    assert (again.insert, again.update, again.delete, again.keep, again.buckets) == (0, 0, 0, 150, ())
    folders = sorted(p.name for p in (tmp_path / "index").glob("rows-*"))
    assert len(folders) == 1
    second = [r for r in first if r[0] not in ("k1", "k2")] + [("k3", "text three", "verified"), ("k5", None, "verified")]
    second = [r for r in second if r not in (("k3", "text 3", "verified"), ("k5", "text 5", "verified"), ("k6", "text 6", "verified"))] + [("k6", "text 6", "draft"), ("new", "", "verified")]
    load = at.load(spark.createDataFrame(second, kind), good)
    assert (load.insert, load.update, load.delete, load.keep) == (1, 2, 3, 145)
    assert 0 < len(load.buckets) <= 6
    written = {int(p.name.split("=")[1]) for p in (tmp_path / "index").glob("rows-*/bucket=*") if p.parent.name not in folders}
    assert written <= set(load.buckets)
    want = {r for r in second if r[2] == "verified" and r[0] is not None}
    assert {tuple(r) for r in at.read().collect()} == want and at.read().count() == len(want)
    # a load of a part: what doesn't come stays, what comes unverified goes
    load = at.load(spark.createDataFrame([("k7", "text 7", "draft"), ("k9", "nine", "verified"), ("gone", "x", "draft")], kind), good, full=False)
    assert (load.insert, load.update, load.delete) == (0, 1, 1) and at.read().count() == len(want) - 1
    # of two verified rows of a key one is taken, the same whatever their order
    for rows in ([("d", "1", "verified"), ("d", "2", "verified")], [("d", "2", "verified"), ("d", "1", "verified")]):
        load = at.load(spark.createDataFrame(rows, kind), good, full=False)
    assert load.buckets == () and at.read().where("id = 'd'").count() == 1
    at.load(spark.createDataFrame([], kind))
    assert at.read().count() == 0
    with pytest.raises(ValueError):
        at.load(spark.createDataFrame([("a",)], "id string"))
    with pytest.raises(ValueError):
        Index(spark, f"file://{tmp_path}/index", buckets=8).load(spark.createDataFrame([], kind))


def test_index_failed_load(spark, tmp_path, monkeypatch):
    """A load that ends before the manifest is in place leaves the index as it was."""
    at = Index(spark, f"file://{tmp_path}/index", buckets=4)
    at.load(spark.createDataFrame([("a", "1")], "id string, v string"))
    monkeypatch.setattr(Index, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        at.load(spark.createDataFrame([("a", "2"), ("b", "2")], "id string, v string"))
    monkeypatch.undo()
    assert [tuple(r) for r in at.read().collect()] == [("a", "1")]
    assert at.load(spark.createDataFrame([("a", "2"), ("b", "2")], "id string, v string")).update == 1


@pytest.mark.parametrize("signed", [False, True])
def test_sparse(spark, signed):
    """The k best of the plain sum, with frequent terms, ties and weights below zero; frequent terms aren't read whole."""
    def vector():
        terms = {min(int(R.paretovariate(0.4)), 400) for _ in range(12)} | {1}
        return {t: round(R.expovariate(4.0), 2) * (R.choice((-1, 1)) if signed else 1) for t in terms}

    vectors = {i: vector() for i in range(3000)} | {3000: {}, 3001: {1: 0.0}, 3002: {999: 1.0}}
    vectors |= {4000 + i: dict(vectors[50]) for i in range(30)}
    rows = [(i, t, float(w)) for i, v in vectors.items() for t, w in v.items()] + [(5000, 1, None)]
    docs = spark.createDataFrame(rows, "vec_id long, term int, weight double")
    ask = {i: v for i, v in vectors.items() if i % 50 == 0}
    questions = docs.where("vec_id % 50 = 0 AND vec_id < 5000").withColumnRenamed("vec_id", "query_id")
    built = sparse.impact_index(docs, block=16).cache()
    got: dict = {}
    for r in sparse.top_sparse(built, docs, questions, 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 6)))
    for i, q in ask.items():
        scores = {j: sum(w * v[t] for t, w in q.items() if t in v) for j, v in vectors.items() if j != i and any(q.get(t) and v[t] for t in v if t in q)}
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:10]
        assert [(n, j, pytest.approx(s, abs=1e-6)) for n, (j, s) in enumerate(best, 1)] == sorted(got.get(i, []))
    read = sparse.wanted_blocks(built, docs, questions, 10).count()
    every = built.join(questions, "term").count()
    assert read < (0.5 if not signed else 0.8) * every
    none = docs.limit(0)
    assert sparse.top_sparse(sparse.impact_index(none), none, questions, 10).count() == 0


def test_hybrid_and_balanced(spark):
    """Hybrid search has neither threshold nor title bonus; a question without terms is searched by vectors; too few hits favour no domain."""
    points = spark.createDataFrame(
        [(i, [1.0, float(i)], f"s{i}", "verified" if i != 3 else "draft", ["room"], "hotel" if i % 2 else "software") for i in range(1, 7)],
        "vec_id long, embedding array<double>, source_id string, status string, title_tokens array<string>, domain string")
    questions = spark.createDataFrame([(100, [1.0, 0.0], ["room"]), (101, [1.0, 0.0], ["room"])], "query_id long, embedding array<double>, question_tokens array<string>")
    own = spark.createDataFrame([(6, 1, 5.0), (3, 1, 9.0), (5, 1, 1.0)], "vec_id long, term int, weight double")
    asked = spark.createDataFrame([(100, 1, 1.0)], "query_id long, term int, weight double")
    found = search.search(points, questions, 3, threshold=0.65, terms=(own, asked)).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in found] == [(100, 6), (100, 5), (100, 1), (101, 1)]
    assert round(found[0]["score"], 9) == round(1 / 61 + 1 / 65, 9)  # first by terms, fifth by vectors; the unverified point takes no place
    one = search.balanced_search(points, questions, ("software", "hotel"), 1, threshold=None, titles=False).collect()
    assert {(r["query_id"], r["vec_id"]) for r in one} == {(100, 1), (101, 1)}
    two = search.balanced_search(points, questions, ("software", "hotel"), 2, threshold=None, titles=False).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in two] == [2, 1, 2, 1]
