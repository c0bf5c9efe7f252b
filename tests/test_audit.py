"""Audits of step records and abstention, worked by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleaner.operators import answers, corpus, steps
from gleaner.sources import corpus as corpus_source


def test_risk_score(spark):
    """Two places out of sequence and four starts that go back are two kinds of issue: 50, not 150."""
    rows = [("v", n, t, p, 5) for p, (n, t) in enumerate([(1, 9.0), (3, 8.0), (2, 7.0), (4, 6.0), (5, 5.0)])] + [("w", 1, 0.0, 0, 3), ("w", 2, 0.0, 1, 2), ("ok", 1, 1.0, 0, 1)]
    x = spark.createDataFrame(rows, "video_id string, step_number int, timestamp_start double, position int, total_steps int")
    issues = {r["video_id"]: r["sequence_issues"] for r in steps.sequence_issues(x).collect()}
    assert issues == {"v": ["non_contiguous_step_numbers", "non_monotonic_timestamps"], "w": ["inconsistent_total_steps"], "ok": []}
    found = x.select("video_id", F.lit("low").alias("risk"), F.lit(0).alias("missing_assets"))
    bad = spark.createDataFrame([("ok", 2), ("none", 1)], "video_id string, invalid long")
    got = {r["video_id"]: (r["steps"], r["critical"], r["risk_score"]) for r in steps.audit(found, steps.sequence_issues(x), bad).collect()}
    assert got == {"v": (5, 0, 50), "w": (2, 0, 25), "ok": (1, 2, 200), "none": (0, 1, 100)}
    assert steps.audit(found, steps.sequence_issues(x)).agg(F.sum("risk_score")).first()[0] == 75


def test_recommended(spark):
    kind = "video_id int, category string, steps long, duration double, critical long, missing_assets long, risk_score long, review_required long"
    rows = [
        (1, "a", 5, 10.0, 1, 0, 100, 0),  # nothing under review
        (2, "a", 5, 10.0, 1, 0, 100, 1), (3, "a", 5, 20.0, 0, 2, 40, 1),  # critical; missing files
        (4, "b", 5, 20.0, 0, 0, 30, 1), (5, "b", 6, 15.0, 0, 0, 30, 1), (6, "b", 6, 15.0, 0, 0, 30, 1),  # riskiest of b by steps, then id: 6; longest 3 by id
        (7, "a", 9, 9.0, 0, 0, 1, 1), (8, "a", 9, 9.0, 0, 0, 1, 1),  # shortest and of most steps: 7
        (9, "a", 2, 10.0, 0, 0, 20, 1), (10, "a", 3, 10.0, 0, 0, 20, 1),
    ]
    x = spark.createDataFrame(rows, kind)
    got = {(r["video_id"], r["forced"]) for r in steps.recommended(x, 7).collect()}
    assert got == {(2, True), (3, True), (6, True), (7, True), (5, False), (4, False), (10, False)}
    assert {r["video_id"] for r in steps.recommended(x, 1).collect()} == {2, 3, 6, 7}
    assert steps.recommended(x.limit(0)).count() == 0


def test_spoken_text_is_looked_at(spark):
    x = spark.createDataFrame([("v", 1, ["f"], "Cliquez", "bad �", "wait", None, 1.0, 9.0, "draft", True, [])],
                              "video_id string, step_number int, frames array<string>, instruction string, spoken_instruction string, action_type string, action_target string, timestamp_end double, duration double, status string, confident boolean, quality_flags array<string>")
    row = steps.findings(x).first()
    assert row["risk"] == "critical" and row["issues"] == ["invalid_replacement_character"]
    assert steps.findings(x.drop("spoken_instruction")).first()["risk"] == "low"


def test_abstention(spark):
    texts = [f"Désolé. {answers.ABSTENTION}", "Je ne trouve pas cette page. [1]", answers.ABSTENTION.lower()]
    x = spark.createDataFrame([(i, 2, t) for i, t in enumerate(texts)], "doc_id int, n_hits int, answer string")
    assert [r["decision"] for r in answers.gate(x).orderBy("doc_id").collect()] == ["abstain", "supported", "invalid_citation"]


def test_screenshots_titles_and_ties(spark):
    """A screenshot that is listed stays in its place; an empty title is not in the breadcrumb; of equal rows one is taken, the same in any order."""
    kind = "id string, title string, content string, domain string, topic string, subtopic string, source_type string, source_id string, authority string, status string, language string, screenshot string, screenshots array<string>"
    row = ("a", "", "Un texte.", "hotel", "payments", None, "internal_sop", "src", "official", "verified", "fr", "b.png", ["a.png", "b.png"])
    rows = [row, ("b", "Titre", *row[2:11], "c.png", ["a.png", None, "a.png"]), ("c", "T", *row[2:11], None, ["x.png"])]
    got = {r["id"]: r for r in corpus.normalize(spark.createDataFrame(rows, kind)).collect()}
    assert [x.split("/")[-1] for x in got["a"]["screenshots"]] == ["a.png", "b.png"] and [x.split("/")[-1] for x in got["b"]["screenshots"]] == ["c.png", "a.png"] and len(got["c"]["screenshots"]) == 1
    assert "src" not in got["a"]["breadcrumb"] and got["b"]["breadcrumb"].endswith("> Titre") and got["a"]["title"] == "src"
    twice = [(*row[:2], content, *row[3:]) for content in ("Un texte.", "un  TEXTE", "UN texte !")]
    kept = {corpus.deduplicate(corpus.normalize(spark.createDataFrame(x, kind).repartition(3)))[0].select("content").collect()[0][0] for x in (twice, twice[::-1], twice[1:] + twice[:1])}
    assert len(kept) == 1


def test_required_corpus(spark, tmp_path):
    assert corpus_source.read_jsonl(spark, f"{tmp_path}/none", "id string").count() == 0
    with pytest.raises(FileNotFoundError):
        corpus_source.read_jsonl(spark, f"{tmp_path}/none", "id string", required=True)
