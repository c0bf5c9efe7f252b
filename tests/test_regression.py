"""Regression checks of recorded runs, worked by hand."""

from __future__ import annotations

from gleaner.operators import evaluation

CASES = "id string, answerable boolean, expected_route string, expected_sources array<string>, required_groups array<array<string>>, expected_domains array<string>, forbidden_sources array<string>, required_phrases array<string>, forbidden_phrases array<string>"


def test_regressions(spark):
    cases = spark.createDataFrame([
        ("good", True, "both", ["software-faq-1"], [["a", "software-faq-1"]], ["hotel"], ["b"], ["Réservé !"], ["secret"]),
        ("bad", True, "hotel", ["z"], [["z"], [], ["a", "y"]], ["hotel", "software"], ["generic_software-faq-1"], ["absent", None], ["Dit-Oui"]),
        ("empty", True, None, None, None, None, None, None, None), ("no", False, "hotel", ["z"], [["z"]], ["hotel"], ["a"], [], None), ("lost", True, "hotel", [], [], [], [], [], []),
    ], CASES)
    runs = spark.createDataFrame([("good", "both", ["a", "generic_software-faq-1"], ["hotel"]), ("bad", "software", ["a"], []), ("empty", None, None, None), ("no", "hotel", [], [])], "id string, route string, sources array<string>, domains array<string>")
    got = {r["id"]: r["failures"] for r in evaluation.retrieval_regressions(cases, runs).collect()}
    assert got == {"good": [], "bad": ["route:software", "expected_source", "source_groups:z", "domains:hotel+software"], "empty": [], "no": [], "lost": ["not_run"]}
    answers = spark.createDataFrame([
        ("good", "C'est RESERVE", False, True, ["a", "software-faq-1"], ["hotel"]), ("bad", "Il dit oui.", True, None, ["software-faq-1"], ["hotel"]),
        ("empty", None, False, True, ["q"], None), ("no", "Voilà", False, True, ["a"], []),
    ], "id string, text string, abstained boolean, citations_valid boolean, cited_sources array<string>, cited_domains array<string>")
    got = {r["id"]: r["failures"] for r in evaluation.answer_regressions(cases, answers).collect()}
    assert got == {
        "good": [], "empty": [], "no": ["answered"], "lost": ["not_run"],
        "bad": ["abstained", "citation", "expected_source", "source_groups:z,a+y", "domains:software", "forbidden_sources:software-faq-1", "phrases_absent:absent", "phrases_forbidden:dit oui"],
    }
