"""Evaluation sets, recorded judgements and release checks, and joins of records with their manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.folding import phrase_key, phrase_keys
from gleaner.functions.text import source_identity

CATEGORIES = ("software", "hotel")
#: The kinds of questions of an evaluation set.
QUESTION_TYPES = ("direct", "paraphrase", "procedurale", "case_pratique", "ambigue", "inconnue")


def audit(cases: DataFrame, sources: DataFrame, categories: tuple[str, ...] = CATEGORIES, types: tuple[str, ...] = QUESTION_TYPES) -> DataFrame:
    """cases(id, question, category, question_type, expected, answerable) with the errors of each.

    sources(source_id, domain) are those of the corpus. A question that repeats an earlier one but for
    case is an error of the later case.
    """
    key = F.lower(F.trim("question"))
    first = cases.groupBy(key.alias("_q")).agg(F.min("id").alias("_first"))
    domains = sources.groupBy("source_id").agg(F.collect_set("domain").alias("_domains"))
    e = cases.select("id", "category", F.explode("expected").alias("source_id")).join(domains, "source_id", "left")
    wrong = F.when(F.col("_domains").isNull(), F.concat(F.lit("source_absent:"), "source_id")).when(~F.coalesce(F.array_contains("_domains", F.col("category")), F.lit(False)), F.concat(F.lit("source_domain:"), "source_id"))
    wrong = e.groupBy("id").agg(F.array_compact(F.collect_list(wrong)).alias("_wrong"))
    x = cases.withColumn("_k", key).join(first, F.col("_k") == F.col("_q"), "left").join(wrong, "id", "left")
    blank = F.coalesce(F.col("_k"), F.lit("")) == ""
    own = F.array_compact(F.array(
        F.when(blank, "question_absent").when(F.col("id") != F.col("_first"), "question_repeated"), F.when(~F.coalesce(F.col("category").isin(*categories), F.lit(False)), "category"),
        F.when(F.col("expected").isNull() | F.exists("expected", lambda s: F.coalesce(s, F.lit("")) == ""), "expected_sources"), F.when(~F.coalesce(F.col("question_type").isin(*types), F.lit(False)), "question_type"),
        F.when(~F.coalesce(F.col("answerable") == (F.size("expected") > 0), F.lit(False)), "answerable"),
    ))
    return x.withColumn("errors", F.concat(own, F.coalesce("_wrong", F.array().cast("array<string>")))).drop("_k", "_q", "_first", "_wrong")


def profile(cases: DataFrame, each: int = 25) -> DataFrame:
    """One row: cases, those of each category, answerable or not, different expected sources, and whether the categories have `each` cases."""
    n = {c: F.count_if(F.col("category") == c) for c in CATEGORIES}
    own = cases.agg(F.count(F.lit(1)).alias("questions"), *[f.alias(c) for c, f in n.items()], F.count_if(F.size("expected") > 0).alias("answerable"), F.count_if(F.size("expected") <= 0).alias("unanswerable"))
    sources = cases.select(F.explode("expected").alias("s")).agg(F.count_distinct("s").alias("unique_sources"))
    fair = (F.col("questions") == each * len(CATEGORIES))
    for c in CATEGORIES:
        fair = fair & (F.col(c) == each)
    return own.crossJoin(F.broadcast(sources)).withColumn("balanced", fair)  # one row each


def id_errors(cases: DataFrame) -> DataFrame:
    """(id, problem, n): ids that are absent or that repeat."""
    g = cases.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return g.where("n > 1 OR id IS NULL").select("id", F.when(F.col("id").isNull(), "absent").otherwise("repeated").alias("problem"), "n")


def judge_summary(rows: DataFrame) -> DataFrame:
    """One row from rows(verdict, score, prompt_tokens), a null verdict being an error."""
    done = F.col("verdict").isNotNull()
    return rows.agg(
        F.count(F.lit(1)).alias("expected"), F.count("verdict").alias("completed"), F.count_if(~done).alias("errors"), F.count_if(F.col("verdict") == "pass").alias("passed"),
        F.round(F.coalesce(F.avg(F.when(done, F.col("score"))), F.lit(0.0)), 3).alias("mean_score"), F.sum(F.when(done, F.col("prompt_tokens"))).alias("prompt_tokens"))


def resume(items: DataFrame, judged: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """items with the verdicts that there are; those without one are to be judged."""
    return items.join(judged.where("verdict IS NOT NULL").dropDuplicates(list(key)), list(key), "left")


def release_failures(runs: DataFrame) -> DataFrame:
    """runs with the failures of each: abstention, citations, domains, text and video evidence against what is expected."""
    asked = ~F.col("expect_abstention")
    lacking = F.array_except("expected_domains", "cited_domains")
    failed = F.array_compact(F.array(
        F.when(F.col("expect_abstention") & ~F.col("abstained"), "abstention"), F.when(asked & F.col("abstained"), "abstained"), F.when(asked & (~F.col("citations_valid") | (F.size("cited_domains") == 0)), "citation"),
        F.when(asked & (F.size(lacking) > 0), F.concat(F.lit("domains:"), F.array_join(F.array_sort(lacking), "+"))), F.when(asked & (F.coalesce("expected_text", F.lit("")) != "") & ~F.contains("answer", "expected_text"), "text"),
        F.when(F.col("require_video"), F.when(F.col("videos") == 0, "video").when(F.col("videos_with_evidence") == 0, "video_evidence")),
    ))
    return runs.withColumn("failures", failed)


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def _identities(sources: Column) -> Column:
    return F.array_distinct(F.transform(sources, source_identity))


def _source_failures(sources: Column, domains: Column) -> list[Column]:
    """What a case expects of sources and domains and is not among these; sources that were renamed are the same."""
    found, asked = _identities(sources), F.col("answerable")
    groups = F.filter(F.coalesce("required_groups", F.array().cast("array<array<string>>")), lambda g: (F.size(g) > 0) & ~F.arrays_overlap(_identities(g), found))
    lacking = F.array_sort(F.array_except(_list("expected_domains"), domains))
    return [
        F.when(asked & (F.size(_list("expected_sources")) > 0) & ~F.arrays_overlap(_identities(_list("expected_sources")), found), "expected_source"),
        F.when(asked & (F.size(groups) > 0), F.concat(F.lit("source_groups:"), F.array_join(F.transform(groups, lambda g: F.array_join(g, "+")), ","))),
        F.when(asked & (F.size(lacking) > 0), F.concat(F.lit("domains:"), F.array_join(lacking, "+"))),
    ]


def retrieval_regressions(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, failures) of runs(id, route, sources, domains) of the cases: another route than expected, and of answerable cases no expected source,
    groups of sources of which none was found, and expected domains that were not.

    cases(id, answerable, expected_route, expected_sources, required_groups, expected_domains, ...); null lists are empty. A case
    that was not run has the failure not_run.
    """
    x = cases.join(runs.withColumn("_ran", F.lit(True)), "id", "left")
    route = F.when(~F.col("route").eqNullSafe(F.col("expected_route")), F.concat(F.lit("route:"), F.coalesce("route", F.lit("-"))))
    failures = F.array_compact(F.array(route, *_source_failures(_list("sources"), _list("domains"))))
    return x.select("id", F.when(F.col("_ran").isNull(), F.array(F.lit("not_run"))).otherwise(failures).alias("failures"))


def answer_regressions(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, failures) of answers(id, text, abstained, citations_valid, cited_sources, cited_domains) to the cases.

    Answerable cases are checked for abstention, citations, expected sources, groups and domains, and forbidden sources;
    the others for an answer that was given. Of all, the required phrases must be in the answer and the forbidden ones
    not, but for case, accents and punctuation. Null lists are empty; a case without an answer has the failure not_run.
    """
    x = cases.join(answers.withColumn("_ran", F.lit(True)), "id", "left")
    asked, cited = F.col("answerable"), _list("cited_sources")
    banned = _identities(_list("forbidden_sources"))
    shown = F.array_sort(F.array_distinct(F.filter(cited, lambda s: F.array_contains(banned, source_identity(s)))))
    x = x.withColumns({"_key": phrase_key(F.coalesce("text", F.lit(""))), "_must": phrase_keys(_list("required_phrases")), "_never": phrase_keys(_list("forbidden_phrases"))})
    absent, present = F.filter("_must", lambda p: ~F.contains("_key", p)), F.filter("_never", lambda p: F.contains("_key", p))
    sources = _source_failures(cited, _list("cited_domains"))
    failures = F.array_compact(F.array(
        F.when(asked & F.col("abstained"), "abstained").when(~asked & ~F.col("abstained"), "answered"),
        F.when(asked & (~F.coalesce("citations_valid", F.lit(False)) | (F.size(cited) == 0)), "citation"), *sources,
        F.when(asked & (F.size(shown) > 0), F.concat(F.lit("forbidden_sources:"), F.array_join(shown, "+"))),
        F.when(F.size(absent) > 0, F.concat(F.lit("phrases_absent:"), F.array_join(absent, "|"))), F.when(F.size(present) > 0, F.concat(F.lit("phrases_forbidden:"), F.array_join(present, "|"))),
    ))
    return x.select("id", F.when(F.col("_ran").isNull(), F.array(F.lit("not_run"))).otherwise(failures).alias("failures"))


def totals(results: DataFrame) -> DataFrame:
    """One row: passed, total, and whether all of results(passed) did."""
    return results.agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total")).withColumn("all_passed", F.col("passed") == F.col("total"))


def metric_deltas(first: DataFrame, second: DataFrame, digits: int = 4) -> DataFrame:
    """(metric, first, second, delta) of two reports(metric, value), over the metrics of both."""
    x = first.select("metric", F.col("value").alias("_a")).join(second.select("metric", F.col("value").alias("_b")), "metric")
    return x.select("metric", F.round("_a", digits).alias("first"), F.round("_b", digits).alias("second"), F.round(F.col("_b") - F.col("_a"), digits).alias("delta"))


def priority_steps(findings: DataFrame) -> DataFrame:
    """Of each video the step under review of the highest risk, then of the most flag categories, then the first."""
    rank = F.create_map(*[F.lit(x) for kv in (("critical", 3), ("high", 2), ("medium", 1), ("low", 0)) for x in kv])[F.col("risk")]
    w = Window.partitionBy("video_id").orderBy(F.desc(rank), F.desc(F.size("flag_categories")), "step_number", "timestamp_start")
    return findings.where("status = 'review_required'").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def manifest_differences(manifest: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """The keys of both sides with their manifest entry: both, not_in_manifest or not_processed."""
    m, p = manifest.withColumn("_m", F.lit(True)), processed.select(key).withColumn("_p", F.lit(True))
    place = F.when(F.col("_m").isNull(), "not_in_manifest").when(F.col("_p").isNull(), "not_processed").otherwise("both")
    return m.join(p, key, "full").withColumn("place", place).drop("_m", "_p")


def with_segments(frames: DataFrame, segments: DataFrame, key: str = "segment") -> DataFrame:
    """frames with their segment's columns, and `missing` where there is no such segment."""
    return frames.join(segments.withColumn("_s", F.lit(True)), key, "left").withColumn("missing", F.col("_s").isNull()).drop("_s")
